"""Keys, digests and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str) -> Column:
    """Key parts joined by a bar; parts that are plain text stand for themselves."""
    return F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def prefixed_uid(prefix: str, uid: Column) -> Column:
    """A user under another name, so that one transcript can be remembered twice."""
    return F.concat_ws("-", F.lit(prefix), uid)


def user_key(uid: Column) -> Column:
    return key(uid, "user")


def session_key(uid: Column, sid: Column) -> Column:
    return key(uid, "sess", sid)


def turn_key(uid: Column, sid: Column, idx: Column) -> Column:
    return key(uid, "turn", sid, idx)


def entity_key(uid: Column, canon: Column) -> Column:
    return key(uid, "e", canon)


def slot_key(uid: Column, canon: Column, attr: Column) -> Column:
    return key(uid, "s", canon, attr)


def claim_key(uid: Column, digest: Column) -> Column:
    return key(uid, "c", digest)


def token_key(uid: Column, stem: Column) -> Column:
    return key(uid, "t", stem)


def claim_digest(text: Column, session: Column, turn_idx: Column, cs: Column, ce: Column) -> Column:
    """Content identity of a claim: SHA-1 of its text and its span."""
    return F.sha1(F.concat(text, F.lit(" | "), key(session, turn_idx, cs, ce)))


def vertex_id(of: Column) -> Column:
    """The top 53 bits of the SHA-256 of a key."""
    return F.shiftright(F.conv(F.substring(F.sha2(of, 256), 1, 14), 16, 10).cast("bigint"), 3)


def edge_id(src: Column, kind: str, dst: Column) -> Column:
    return vertex_id(key(src, kind, dst))


def evidence_hash(keys: Column) -> Column:
    """Fingerprint of a set of claims that doesn't depend on their order."""
    return F.sha2(F.array_join(F.array_sort(keys), "\n"), 256)


def live_session_id(date: Column, contents: Column) -> Column:
    return F.concat(F.lit("live-"), F.substring(F.sha1(F.concat(date, F.array_join(contents, ""))), 1, 12))


def citation_id(ckey: Column) -> Column:
    return F.substring(ckey, -8, 8)
