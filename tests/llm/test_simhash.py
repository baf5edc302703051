import random
import re

import numpy as np
import xxhash

from reviewlake.llm.components import components
from reviewlake.llm.simhash import _NEARBY, codewords, fingerprint, fingerprint_roots, keys_of, near_duplicates, one_each


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["Ab", "c ", "\t", "É", " ", "\x0b", "x\xa0y", "\n", "Zz"]) for _ in range(rng.randint(0, 60)))
        assert fingerprint(text) == plain(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


def test_the_code_is_perfect():
    """Each syndrome has one pattern of weight 3 or less; two words within 2 share a codeword."""
    _, count = _NEARBY
    assert sorted(set(count.tolist())) == [1, 6] and (count == 1).sum() == 1 + 23 + 253
    rng = random.Random(1)
    for _ in range(500):
        x = rng.getrandbits(23)
        y = x ^ sum(1 << b for b in rng.sample(range(23), rng.randint(0, 2)))
        a, b = (set(codewords(np.array([v]))[0].tolist()) for v in (x, y))
        assert a & b


def test_links_of_four_bits_share_a_key():
    rng = random.Random(2)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        a, b = (set(keys_of(np.array([v], np.uint64))[1].tolist()) for v in (x, y))
        assert a & b


def test_chains_and_dense_groups_agree_with_brute_force(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):  # dense groups, chains that lead away from them, and neighbours just too far off
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        for step in (3, 4, 5):
            x = centre
            for _ in range(4):
                x ^= sum(1 << b for b in rng.sample(range(64), step))
                prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    want = roots({s: s & (1 << 64) - 1 for s in signed}, signed)
    got = {r["f"]: r["root"] for r in fingerprint_roots(spark.createDataFrame([(s,) for s in signed], "f long")).collect()}
    assert {s: got.get(s, s) for s in signed} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5), (7, 6), (200, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{i: 100 for i in range(101, 140)}, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text, "en", "s", 1), (2, text, "en", "s", 1), (9, text.upper(), "en", "s", 1), (4, None, None, None, None), (5, "", "en", "s", 0), (6, "other words entirely here now", "en", "s", 1), (6, "other words entirely here now", "en", "s", 1), (None, text, "en", "s", 1)]
    df = docs(rows).selectExpr("*", "1 AS f", "2 AS root", "3 AS component_id")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"]) for r in near_duplicates(df).collect())
    assert [c for _, c in got] == [2, 2, 4, 4, 6, 6, 2, 2]
    kept = one_each(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 6]
    assert near_duplicates(docs([])).count() == one_each(docs([])).count() == 0
