import math
import re

from reviewlake.llm.decontaminate import clean, contained

ITEM = "one two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"w{i}" for i in range(3000))


def shingles(text):
    words = re.sub(r"[^\w]+|_+", " ", (text or "").lower()).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(docs, items):
    out = set()
    for d, text in {(r[0], r[1]) for r in docs}:
        have = shingles(text)
        for i, item in items:
            want = shingles(item)
            if want and len(want & have) >= max(1, math.ceil(0.8 * len(want) - 1e-9)):
                out.add((d, i, len(want), len(want & have)))
    return out


def rows():
    return [
        (1, LONG + " " + ITEM.upper().replace(" ", ", ") + " " + LONG, "en", "s", 1),
        (2, LONG, "en", "s", 1),
        (3, ITEM.replace("twelve", "changed"), "en", "s", 1),  # 7 of 8
        (4, " ".join(ITEM.split()[:9]), "en", "s", 1),  # 5 of 8
        (5, None, None, None, None),
        (6, "", "en", "s", 0),
        (7, "short item", "en", "s", 1),
        (None, ITEM, "en", "s", 1),
        (1, LONG, "en", "s", 1),  # an id again, with another text
        (3, ITEM.replace("twelve", "changed"), "en", "s", 1),
    ]


ITEMS = [(10, ITEM), (11, "Short, item!"), (12, None), (13, ""), (14, ITEM), (15, "w1 w2 w3 w4 w5 w6")]


def test_agrees_with_brute_force(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for bound in (1_000_000, 0):  # broadcast, and the way beyond it
        got = contained(docs(rows()), items, broadcast_rows=bound)
        assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_found"]) for r in got.collect()} == brute(rows(), ITEMS)


def test_clean_keeps_whole_rows(spark, docs):
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    df = docs(rows()).selectExpr("*", "1 AS item_id", "2 AS need")
    kept = clean(df, items)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:3]) for r in kept.collect()) == [(1, "w0 "), (2, "w0 "), (4, "one"), (5, ""), (6, ""), (7, "sho")]
    assert clean(docs([]), items).count() == 0
    assert clean(docs(rows()), items.limit(0)).count() == len(rows())
