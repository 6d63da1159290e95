import duckdb
import pytest

from curbside import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf_dir)
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted([plain(r[c]) for c in sorted(names)] for r in got.collect())
    assert rows == sorted([plain(v) for _, v in sorted(zip(names, r, strict=True))] for r in want.fetchall())
