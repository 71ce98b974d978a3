import sys

import duckdb
import pytest

import __spark_entry__ as entry
from mosaiq.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["gram_gemm", "gemm_tiles", "hemm_right_upper", "trsm_run_unit", "potrf_gram", "syevd_laplace", "permute_rows"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    found = QUERIES[name](spark, DATA)
    wanted = con.execute(ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(wanted.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_works_without_the_corpus_part(spark, monkeypatch):
    for name in ("mosaiq.llm", "mosaiq.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    assert entry.entry(spark).count() == 4096
