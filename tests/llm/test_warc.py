import gzip

from pyspark.sql import functions as F

from reviewlake.llm.warc import PAGES_SQL, audit, damaged, laid_out, page_archive, read_warc, record_hashes, records, write_warc

PAGES = "page_id long, url string, html string"


def archive(spark, n=40):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i * 97 % 4000)}</p>\r\n\r\nWARC/1.1 not a record") for i in range(n)] + [(None, None, None), (3, "", "")]
    return spark.createDataFrame(rows, PAGES)


def test_written_files_read_back_the_same(spark, tmp_path):
    made = page_archive(archive(spark), per_file=15)
    write_warc(made, str(tmp_path / "w"))
    got = read_warc(spark, str(tmp_path / "w"))
    want = {(r["file"], r["offset"], r["length"], r["content"].encode()) for r in made.collect()}
    assert {(r["file"].split("file=")[1].split("/")[0], r["offset"], r["length"], bytes(r["content"])) for r in got.collect()} == want
    assert {bytes(x[0]).decode() for x in got.select("payload").collect()} == {x[0] or "" for x in archive(spark).select("html").collect()}


def test_gzip_members_and_broken_files():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    packed = gzip.compress(one) * 2
    got = list(records(packed))
    assert [(r[0], r[1], r[6]) for r in got] == [(0, len(packed) // 2, b"hello"), (len(packed) // 2, len(packed) // 2, b"hello")]
    assert [r[6] for r in records(b"junk" + one + b"WARC/1.1\r\nContent-Length: x\r\n\r\n" + one[:-6])] == [b"hello", b"hel"]
    assert list(records(b"")) == list(records(b"\x1f\x8bnot gzip")) == []


def differences(a, b):
    own = lambda df: {(r["file"], r["offset"], r["length"]): r["sha"] for r in df.collect()}
    x, y = own(a), own(b)
    return {(*k, "missing" if k not in y else "extra" if k not in x else "differs") for k in x.keys() | y.keys() if x.get(k) != y.get(k)}


def test_audit_agrees_with_brute_force(spark):
    rows = [("f" if i % 3 else None, i * 5000, 10 + i, str(i)) for i in range(400)] + [("g", 10**9, 5, "far")]
    a = spark.createDataFrame(rows, "file string, offset long, length long, content string")
    hit = F.col("offset").isin(0, 65_000, 70_000, 1_995_000)
    b = a.withColumn("content", F.when(hit, "changed").otherwise(F.col("content"))).filter("offset != 500000").unionByName(spark.createDataFrame([("h", 3, 4, "x"), ("f", 12, 4, "y")], a.schema))
    x, y = record_hashes(a), record_hashes(b)
    found = {(r["file"], r["offset"], r["length"], r["status"]) for r in audit(x, y).collect()}
    assert found == differences(x, y) and len(found) == 7
    assert audit(x, x).count() == 0 and audit(x.limit(0), x.limit(0)).count() == 0
    assert {r["status"] for r in audit(x, x.limit(0)).collect()} == {"missing"}


def test_drill(spark):
    pages = archive(spark, 120)
    x, y = record_hashes(page_archive(pages)), record_hashes(page_archive(damaged(pages)))
    found = audit(x, y)
    assert found.count() == 2 and {r["status"] for r in found.collect()} == {"differs"}
    assert laid_out(spark.createDataFrame([("f", "é", 1), ("f", "b", 1)], "file string, content string, length int"), "file", "content", ["length"]).agg(F.max("offset")).first()[0] in (1, 2)


def test_pages_without_an_id_are_dealt_over_files(spark):
    import duckdb

    rows = [(None, f"http://h/{i}", f"<p>{i}") for i in range(60)] + [(5, "u", "x"), (5, "u", "x"), (7, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = page_archive(df).select("page_id", "file", "offset", "length", F.col("sha").alias("sha256")).toPandas()
    assert len(set(got["file"])) > 20 and len(got) == len(rows)
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(PAGES_SQL).df()
    key = lambda x: sorted(zip(x["file"], x["offset"], x["length"], x["sha256"]))
    assert key(got) == key(want)
