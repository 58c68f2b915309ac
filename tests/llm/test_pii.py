import pytest
from pyspark.sql import functions as F

from memlattice.llm.pii import Finder, Plain, find_pii, redact, redacted

FIND = Finder()

CASES = [
    ("write to jane.doe@mail.example now", "email", "jane.doe@mail.example"),
    ("write to jane (at) mail dot example, thanks", "email", "jane (at) mail dot example"),
    ("mail klavskoa-wail[at]box.invalid into", "email", "klavskoa-wail[at]box.invalid"),
    ("mail tade @ inbox.example.net into", "email", "tade @ inbox.example.net"),
    ("it is jane at mail dot example ok", "email", "jane at mail dot example"),
    ("ｊａｎｅ＠mail.example", "email", "ｊａｎｅ＠mail.example"),
    ("jа​ne@mail.example", "email", "jа​ne@mail.example"),
    ("call five five five, zero one six one today", "phone", "five five five, zero one six one"),
    ("call +49 (0)30 23125 031 today", "phone", "+49 (0)30 23125 031"),
    ("call (651) 555-0150.", "phone", "(651) 555-0150"),
    ("call 452.555.0178 or", "phone", "452.555.0178"),
    ("call 020 7946 0581 or", "phone", "020 7946 0581"),
    ("call 07700900161", "phone", "07700900161"),
    ("call +33 1 99 00 66 46 or", "phone", "+33 1 99 00 66 46"),
    ("Passport X6637335 expires", "id_number", "X6637335"),
    ("says 974-63-4860.", "id_number", "974-63-4860"),
    ("says QQ 77 81 40 D on", "id_number", "QQ 77 81 40 D"),
    ("says qq778140d on", "id_number", "qq778140d"),
    ("says 55/848/80776 on", "id_number", "55/848/80776"),
    ("at 12b Zirzeand Row now", "address", "12b Zirzeand Row"),
    ("at 27 rue de Thavthind, B", "address", "27 rue de Thavthind"),
    ("at Gaerkjystraße 82, 67990", "address", "Gaerkjystraße 82"),
    ("at calle Rundhoan 17, L", "address", "calle Rundhoan 17"),
    ("ask Oliver Zaemvane today", "name", "Oliver Zaemvane"),
    ("ask oliver zaemvane today", "name", "oliver zaemvane"),
    ("ask Zaemvane, Oliver today", "name", "Zaemvane, Oliver"),
    ("ask Hattie B. Zaemvane today", "name", "Hattie B. Zaemvane"),
    ("ask T. Zaemvane today", "name", "T. Zaemvane"),
    ("ask Dr. Zaemvane today", "name", "Zaemvane"),
    ("call tel 07700 900123 or", "phone", "07700 900123"),
    ("call 03-1234-5678 or", "phone", "03-1234-5678"),
    ("ruf null eins sieben sechs fünf fünf vier drei an", "phone", "null eins sieben sechs fünf fünf vier drei"),
    ("llama al seis uno dos tres cuatro cinco seis siete ocho hoy", "phone", "seis uno dos tres cuatro cinco seis siete ocho"),
    ("wohnt im Musterweg 5, hinten", "address", "Musterweg 5"),
    ("ask " + "x" * 300 + "@mail.example now", "email", "x" * 300 + "@mail.example"),
    ("ask " + "x" * 300 + " (at) mail dot example now", "email", "x" * 300 + " (at) mail dot example"),
    ("ask S" + "o" * 100 + "vane, Oliver today", "name", "S" + "o" * 100 + "vane, Oliver"),
    ("I met Priya Sharma there", "name", "Priya Sharma"),
    ("Call Katarzyna Nowak tomorrow", "name", "Katarzyna Nowak"),
    ("und Mohammed Haddad war da", "name", "Mohammed Haddad"),
    ("lunch with Chloé Dubois.", "name", "Chloé Dubois"),
    ("Hiroshi Tanaka called", "name", "Hiroshi Tanaka"),
    ("ask Łukasz Wójcik-Malinowski today", "name", "Łukasz Wójcik-Malinowski"),
    ("Yesterday Ngozi A. Okonkwo's car broke", "name", "Ngozi A. Okonkwo"),
    ("Bitte an Jönäthän Brïlqüör schreiben", "name", "Jönäthän Brïlqüör"),
]


@pytest.mark.parametrize("text,kind,item", CASES)
def test_found(text, kind, item):
    found = [(k, text[a:b]) for k, a, b in FIND.find(text)]
    assert any(k == kind and part.startswith(item) for k, part in found), found
    assert len(found) == 1


@pytest.mark.parametrize(
    "text",
    ["Order 7482-13024 still has not left", "The ticket #5468367 was closed", "on 2024-09-16 at 12:10", "version 9.19.80 fixes it", "Ping @zurde_55 if the list changes.", "Meet at the corner of Saedorf Street around 11:45", "Holttiex the ferret sleeps", "It cost 355.56 euros or $512", "My coach gavve me a lamp", "It will bring two or three, five or six of one kind", "", "plan B. The rest", "Für Linsensuppe brauchst du 31 Minuten Geduld.", "Meet me at the corner of Klaefield Stree now", "Kinnend Coffee Roasters opens", "Before January I rest", "New York is large"],
)
def test_nothing_found(text):
    assert FIND.find(text) == []


def test_positions_count_code_points_behind_disguises():
    text = "🧑‍🚀 é — call five five five, zero one six one or jane (at) mail dot example"
    found = {k: text[a:b] for k, a, b in FIND.find(text)}
    assert found == {"phone": "five five five, zero one six one", "email": "jane (at) mail dot example"}
    assert redact(text, FIND.find(text)) == "🧑‍🚀 é — call [PHONE] or [EMAIL]"


def test_plain_keeps_places():
    text = "xéy zero one two three four five six z"
    p = Plain(text)
    p.digits()
    assert p.text == "xey 0123456 z" and text[p.source(p.text.index("z"))] == "z"


def test_tables(spark):
    long = "nothing here. " * 20000 + "ask Oliver Zaemvane"
    rows = [("a", "ask Oliver Zaemvane"), ("a", "ask Oliver Zaemvane"), ("b", None), ("c", ""), (None, "ask T. Zaemvane"), ("d", long)]
    df = spark.createDataFrame(rows, "k string, body string").withColumn("pii_type", F.lit(1))
    got = {(r.k, r.pii_type, r.start_pos) for r in find_pii(df, "k", "body").collect()}
    assert got == {("a", "name", 4), (None, "name", 4), ("d", "name", len(long) - 15)}
    assert find_pii(df.limit(0), "k", "body").collect() == []
    clean = [r.body for r in redacted(df, "body").collect()]
    assert clean[:5] == ["ask [NAME]", "ask [NAME]", None, "", "ask [NAME]"]
