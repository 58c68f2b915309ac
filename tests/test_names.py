import os

import duckdb
import pytest

import verify
from memlattice import queries
from memlattice.operators import memory

ROOT = "/root/testdata/sf0.001"


def test_names_lead_to_the_claims_that_mention_them(spark):
    claims = spark.createDataFrame([("u", "c1", " ".join(f"word{i}x" for i in range(30)), ["key", None], ["e2", "e1", "e2", None, "none"]), ("u", "c2", "plain text", None, None)], "uid string, ckey string, text string, keywords array<string>, mentions array<string>")
    entities = spark.createDataFrame([("u", "e1", "Nibbles", ["hamster"]), ("u", "e2", "Pretzel", [])], "uid string, ekey string, canon string, aliases array<string>")
    got = {r.ckey: r.tokens for r in memory.tokens_of(claims, entities).collect()}
    assert got == {"c1": ["key", "pretzel", "nibbl", "hamster", *(f"word{i}x" for i in range(20))], "c2": ["plain", "text"]}
    assert {(r.stem, r.ckey) for r in memory.hits_of(claims, entities).where("stem in ('hamster', 'plain')").collect()} == {("hamster", "c1"), ("plain", "c2")}


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
def test_the_sql_has_the_names(spark):
    """Claims with a stem that only the name of an entity gives them: the SQL must list it as well."""
    sql = duckdb.connect()
    for file in sorted(os.listdir(ROOT)):
        sql.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{ROOT}/{file}')")
    want = dict(sql.execute(queries.ORACLES["claim_tokens_capped"]).fetchall())
    with_names = {r.ckey: r.tokens for r in queries.claim_tokens_capped(spark, ROOT).collect()}
    bare = memory.tokens_of(queries._worded(spark, ROOT), queries._entities(spark, ROOT).limit(0))
    without = {r.ckey: " ".join(r.tokens) for r in bare.collect()}
    assert want == with_names and sum(without[k] != v for k, v in want.items()) > 50


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
def test_queries_with_names(spark):
    assert verify.main([ROOT, "claim_tokens_capped", "token_df", "one_hop_convergence", "verdicts", "user_stats"]) == 0
