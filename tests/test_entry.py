import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import verify

ROOT = "/root/testdata/sf0.001"
QUICK = ["p5_found", "p5_label_history", "session_order", "stems_per_turn", "token_df", "canon_components", "supersession_detected", "verdicts", "benchmark_slice", "span_locate"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test data")
def test_queries_equal_their_sql(spark):
    assert verify.main([ROOT, *QUICK]) == 0


def test_nothing_needs_the_llm_part():
    code = "import sys; sys.modules['memlattice.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'p5_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
