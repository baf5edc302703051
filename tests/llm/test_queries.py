import duckdb
import pytest

from reviewlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    show = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(show(v) for v in r) for r in df.select(*names).collect()) == sorted(tuple(show(v) for v in r) for r in want.fetchall())


def test_every_number_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
