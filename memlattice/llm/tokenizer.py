"""Token counts by a public byte-level BPE vocabulary, with exact reuse of words."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: The pretokens of the vocabulary begin at a space that stands between two
#: characters other than white space, so a text may be cut there and its parts
#: counted one by one.
_WORD_START = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and newline, beside which that is not sure.
_OTHER_SPACE = tuple(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
#: Words kept with their counts; beyond it the cache is emptied.
CACHE_WORDS = 500_000


def default_vocabulary() -> str:
    """Path of the vocabulary file: MEMLATTICE_VOCABULARY, else that of the installed public tokenizers."""
    named = os.environ.get("MEMLATTICE_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Counts the tokens of texts; most words of a corpus are met again and again, so each is encoded once."""

    def __init__(self, path: str) -> None:
        self._encode = encoding(path).encode_ordinary
        self._known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        """Tokens of a text; 0 for an empty one."""
        words = text.split(" ")
        if " \n" in text or "\n " in text or "  " in text or any(map(text.__contains__, _OTHER_SPACE)):
            words = _WORD_START.split(text)
        known = self._known
        counts = list(map(known.get, words))
        # the first word has no space before it and isn't the word that stands elsewhere
        counts[0] = len(self._encode(words[0]))
        if None in counts:
            for i, c in enumerate(counts):
                if c is None:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    counts[i] = known[words[i]] = len(self._encode(" " + words[i]))
        return sum(counts)
