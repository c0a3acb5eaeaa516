"""Every query with an oracle agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from codexa.plans.queries import ORACLES, QUERIES

TABLES = ["documents", "pages", "benchmark", "conversations", "embeddings", "labels"]


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def rows(records, names):
    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(plain(r[n]) for n in names) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    names = sorted(df.columns)
    got = duck.execute(ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    want = [dict(zip(columns, r, strict=True)) for r in got.fetchall()]
    assert rows([r.asDict() for r in df.collect()], names) == rows(want, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() >= 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "primary_type", "action", "reasons", "confidence"]
    assert df.count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
