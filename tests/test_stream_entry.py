import duckdb
import pytest

import __spark_entry__
from reviewlake.plans.review import review
from reviewlake.sources.diffs import DIFFS
from reviewlake.streaming.stream import diff_stream, review_stream, windowed_counts

SF = "/root/testdata/sf0.001"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(f"d{i}", f"--- /dev/null\n+++ b/a{i}.py\n@@ -0,0 +1,2 @@\n+eval(x)\n+y\n", "", "") for i in range(4)] + [("bad", "", "", "")]
    df = spark.createDataFrame(rows, DIFFS)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # nothing new: nothing more
        review_stream(diff_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/findings"))
    pick = ["diff_id", "rule_id", "file", "line"]
    assert sorted(got.select(pick).collect()) == sorted(review(df).findings.select(pick).collect()) and got.count() == 4
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == 1


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "ts string, event_type string, value double")
    assert sorted(r["total"] for r in windowed_counts(df).collect()) == [3.0, 4.0]


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and "review_rules" in sql


@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op")))
def test_queries_agree_with_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    show = lambda v: round(v, 6) if isinstance(v, float) else str(v)
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(show(v) for v in r) for r in df.select(*names).collect()) == sorted(tuple(show(v) for v in r) for r in want.fetchall())
