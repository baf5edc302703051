import numpy as np

from reviewlake.llm import media
from reviewlake.llm.media import MOST_BITS, SCALES, TURNS, across, class_roots, corners, decode, drawn, encode_png, image_copies

RNG = np.random.default_rng(9)


def picture(seed, size=96):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 200, (size // 4, size // 4)), np.ones((4, 4))).astype(np.uint8)


def test_decoders():
    x = picture(1, 32)
    assert np.array_equal(decode(encode_png(x)), x)
    assert np.array_equal(decode(b"P5 32 32 255\n" + x.tobytes()), x)
    colour = np.repeat(x[..., None], 3, axis=2)
    assert np.allclose(decode(b"P6 32 32 255\n" + colour.tobytes()), x, atol=1e-2)
    assert [decode(b) for b in (None, b"", b"junk", encode_png(x)[:60], b"P5 9 9 255\n1")] == [None] * 5


def test_copies_are_found_and_others_left_alone(spark):
    rows = []
    for i in range(12):
        x = picture(i)
        rows.append((i, encode_png(x)))
        noise = np.random.default_rng(i).integers(-3, 4, x.shape)
        rows.append((100 + i, encode_png(np.clip(x.astype(int) + 15 + noise, 0, 255).astype(np.uint8)[6:, 4:-5])))
    rows += [(200, encode_png(picture(0))), (200, encode_png(picture(0))), (300, None), (301, b""), (302, b"broken"), (303, encode_png(np.full((64, 64), 9, np.uint8))), (None, encode_png(picture(3)))]
    df = spark.createDataFrame(rows, "id long, image binary").selectExpr("*", "1 AS c", "2 AS sha")
    got = image_copies(df).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for i in range(12):
        assert by[i]["component_id"] == by[100 + i]["component_id"] == i
    assert (by[200]["class_id"], by[200]["component_id"], by[None]["component_id"]) == (0, 0, 3)
    assert [(by[i]["n_corners"], by[i]["component_id"], by[i]["class_id"]) for i in (300, 301, 302, 303)] == [(0, 300, 300), (0, 300, 300), (0, 302, 302), (0, 303, 303)]
    assert image_copies(df.limit(0)).count() == 0


def test_dense_groups_and_large_buckets(spark):
    """Corners of 30 classes with one descriptor at the same six places; of 5 more at other places."""
    base = [[int(w) for w in RNG.integers(-(1 << 62), 1 << 62, 4)] for _ in range(6)]
    rows = [(c, n, base[n], (20.0 * n + c % 3, 10.0 * n * n, 0, 0)) for c in range(30) for n in range(6)]
    rows += [(100 + c, n, base[n], (float(RNG.integers(0, 4000)), float(RNG.integers(0, 4000)), 0, 0)) for c in range(5) for n in range(6)]
    each = spark.createDataFrame(rows, "c long, n int, words array<long>, t struct<x:float,y:float,turn:int,scale:int>")
    for large in (64, 4):
        assert {(r["c"], r["root"]) for r in class_roots(each, 5, large).collect()} == {(c, 0) for c in range(1, 30)}


def test_large_buckets_compare_corners_that_differ(spark):
    """Every bucket holds 20 classes; only classes 2 i and 2 i + 1 agree on places, with 6 differing bits in the last word."""
    base = [[int(w) for w in RNG.integers(-(1 << 62), 1 << 62, 4)] for _ in range(6)]
    rows = []
    for c in range(20):
        at = np.random.default_rng(c // 2).integers(0, 4000, (6, 2)).astype(float)
        rows += [(c, n, [*base[n][:3], base[n][3] ^ (63 << 6 * (c % 2))], (float(at[n, 0]), float(at[n, 1]), 0, 0)) for n in range(6)]
    each = spark.createDataFrame(rows, "c long, n int, words array<long>, t struct<x:float,y:float,turn:int,scale:int>")
    for large in (64, 4, 1):
        assert {(r["c"], r["root"]) for r in class_roots(each, 5, large, 0).collect()} == {(c, c - 1) for c in range(1, 20, 2)}


def test_corners_with_errors_in_every_word_are_compared(spark):
    """Seven errors, one in each of the first seven halves: no word is whole."""
    errors = [1 << 5 | 1 << 40, 1 << 9 | 1 << 50, 1 << 3 | 1 << 33, 1 << 7]
    rows = []
    for n in range(6):
        words = [int(w) for w in RNG.integers(-(1 << 62), 1 << 62, 4)]
        rows += [(c, n, [w ^ e * c for w, e in zip(words, errors)], (20.0 * n, 10.0 * n * n, 0, 0)) for c in range(2)]
    each = spark.createDataFrame(rows, "c long, n int, words array<long>, t struct<x:float,y:float,turn:int,scale:int>")
    assert [(r["c"], r["root"]) for r in class_roots(each, 5).collect()] == [(1, 0)]


def test_corners_grow_with_the_image_and_crops_are_found(spark):
    rows = []
    for i in range(4):
        x = picture(50 + i, 320)
        edited = x.copy()
        edited[:60, :60] = np.kron(np.random.default_rng(i).integers(0, 2, (10, 10)), np.ones((6, 6))) * 255  # a stronger pattern
        rows += [(i, encode_png(x)), (100 + i, encode_png(x[37:190, 51:204])), (200 + i, encode_png(edited))]
    got = {r["id"]: r for r in image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert got[0]["n_corners"] > 3 * 36
    assert [(got[100 + i]["component_id"], got[200 + i]["component_id"]) for i in range(4)] == [(i, i) for i in range(4)]


def test_drawing(spark):
    df = spark.createDataFrame([(50, [0.1, -0.2, 0.3]), (51, [0.5]), (52, None), (53, [])], "vec_id long, embedding array<float>")
    got = {r["id"]: r["image"] for r in drawn(df).collect()}
    assert set(got) == {50, 51, 52, 53, -51} and got[52] is None and got[53] is None
    assert decode(bytes(got[50])).shape == (64, 64) and decode(bytes(got[-51])).shape == (59, 61)


def blobs(seed, size=192):
    """A smooth picture, which survives being resized."""
    rng, k = np.random.default_rng(seed), np.fft.fftfreq(size)
    low = np.exp(-2 * (np.pi * 2.5) ** 2 * (k[:, None] ** 2 + k**2))
    x = np.fft.ifft2(np.fft.fft2(rng.normal(0, 1, (size, size))) * low).real
    return np.clip(110 + 60 * x / x.std(), 0, 255).astype(np.uint8)


def halved(x, ratio):
    """Bilinear, to the given ratio."""
    n = int(len(x) * ratio)
    at = (np.arange(n) + 0.5) / ratio - 0.5
    i = np.clip(at.astype(int), 0, len(x) - 2)
    f = np.clip(at - i, 0, 1)
    rows = x[i] * (1 - f)[:, None] + x[i + 1] * f[:, None]
    return (rows[:, i] * (1 - f) + rows[:, i + 1] * f).astype(np.uint8)


EDITS = {
    "quarter crop": lambda x: x[40:136, 60:156],
    "turned": lambda x: np.rot90(x),
    "upside down": lambda x: x[::-1, ::-1],
    "scaled": lambda x: halved(x, 0.7071),
    "contrast": lambda x: (x * 0.6 + 40).astype(np.uint8),
    "noise": lambda x: np.clip(x + np.random.default_rng(1).integers(-4, 5, x.shape), 0, 255).astype(np.uint8),
}


def test_recall_of_edits(spark):
    """At least nine of ten copies by each kind of edit are found, and no two unlike images are joined."""
    n, rows = 20, []
    for i in range(n):
        x = blobs(i)
        rows.append((i, encode_png(x)))
        rows += [(1000 * (k + 1) + i, encode_png(np.ascontiguousarray(edit(x)))) for k, edit in enumerate(EDITS.values())]
    got = {r["id"]: r["component_id"] for r in image_copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    for k, name in enumerate(EDITS):
        assert sum(got[1000 * (k + 1) + i] == i for i in range(n)) >= 0.9 * n, name
    assert all(c % 1000 == i % 1000 for i, c in got.items())


def linked(p, q, least=5):
    """Whether corners of two images agree, every corner of the one compared with every one of the other."""
    distance = np.bitwise_count(p[4][:, None] ^ q[4][None]).sum(axis=2)
    i, j = np.nonzero(distance <= MOST_BITS)
    turn, scale = (q[2][j] - p[2][i]) % TURNS, q[3][j] - p[3][i]
    # Number k of a scale is 0.7071 ** k, so a corner at k that is found at k + 1 lies in an image larger by 1.4142.
    ratio, angle = 2.0 ** (scale / 2), turn * 2 * np.pi / TURNS
    dx = q[0][j] - (p[0][i] * np.cos(angle) - p[1][i] * np.sin(angle)) * ratio
    dy = q[1][j] - (p[0][i] * np.sin(angle) + p[1][i] * np.cos(angle)) * ratio
    bins = {}
    for k in range(len(i)):
        for h in (0, 1):
            for a in (0, 1):
                for b in (0, 1):
                    key = (h, a, b, scale[k], (turn[k] + h) // 2 % (TURNS // 2), np.floor(dx[k] / 12 + a / 2), np.floor(dy[k] / 12 + b / 2))
                    own = bins.setdefault(key, (set(), set()))
                    own[0].add((p[0][i[k]] // 6, p[1][i[k]] // 6))
                    own[1].add((q[0][j[k]] // 6, q[1][j[k]] // 6))
    share = 0.1 * min(len(set(zip((x[0] // 6).tolist(), (x[1] // 6).tolist()))) for x in (p, q))
    return any(min(map(len, own)) >= max(least, share) for own in bins.values())


def test_tables_against_all_pairs_of_corners(spark):
    """Links as tables and votes find them, against a comparison of all corners of all pairs of images."""
    images = []
    for i in range(14):
        x = blobs(200 + i, 96)
        rng = np.random.default_rng(i)
        images += [x, np.clip(x + rng.integers(-12, 13, x.shape), 0, 255).astype(np.uint8), np.ascontiguousarray(np.rot90(x)[8:, 5:])]
    found = []
    for x in images:
        c = corners(x[None].astype(np.float32), 12)
        found.append([np.asarray(c[1], np.float32), np.asarray(c[2], np.float32), c[3], c[4], c[5]])
    n = len(images)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if linked(found[i], found[j])}
    rows = [(k, m, [int(w) for w in c[4][m]], (float(c[0][m]), float(c[1][m]), int(c[2][m]), int(c[3][m]))) for k, c in enumerate(found) for m in range(len(c[0]))]
    each = spark.createDataFrame(rows, "c long, n int, words array<long>, t struct<x:float,y:float,turn:int,scale:int>")
    roots = {r["c"]: r["root"] for r in class_roots(each, 5).collect()}
    top = [roots.get(i, i) for i in range(n)]
    kept = [(i, j) for i, j in want if top[i] == top[j]]
    assert len(want) >= 20 and len(kept) >= 0.9 * len(want)
    reach = list(range(n))
    for _ in range(n):
        for i, j in want:
            reach[i] = reach[j] = min(reach[i], reach[j])
    assert all(reach[i] == reach[top[i]] for i in range(n))
    assert set(c for x in found for c in x[3].tolist()) <= set(range(len(SCALES)))


def test_surroundings_keep_links_of_copies(spark):
    """As test_tables_against_all_pairs_of_corners, with the words of what is around corners, and stronger edits."""
    images = []
    for i in range(10):
        x = blobs(300 + i, 96)
        rng = np.random.default_rng(i)
        pasted = blobs(700 + i, 96)
        pasted[20:84, 16:80] = x[10:74, 20:84]
        images += [x, np.clip(x * 0.7 + 30 + rng.integers(-12, 13, x.shape), 0, 255).astype(np.uint8), np.ascontiguousarray(np.rot90(x)[8:, 5:]), pasted]
    found = [corners(x[None].astype(np.float32), 12)[1:] for x in images]
    n = len(images)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if linked(found[i], found[j])}
    rows = [(k, m, [int(w) for w in (*c[4][m], *c[5][m])], (float(c[0][m]), float(c[1][m]), int(c[2][m]), int(c[3][m]))) for k, c in enumerate(found) for m in range(len(c[0]))]
    each = spark.createDataFrame(rows, "c long, n int, words array<long>, t struct<x:float,y:float,turn:int,scale:int>")
    roots = {r["c"]: r["root"] for r in class_roots(each, 5).collect()}
    top = [roots.get(i, i) for i in range(n)]
    assert len(want) >= 30 and sum(top[i] == top[j] for i, j in want) >= 0.9 * len(want)


def test_corners_in_unlike_surroundings_do_not_meet(spark):
    """Equal descriptors, of which what is around differs, are no pair; what counts in one alone says nothing."""
    words = [int(w) for w in RNG.integers(-(1 << 62), 1 << 62, 4)]
    around = [[0, 0, -1, -1], [-1, -1, -1, -1], [-1, -1, 0, 0], [1, 0, -1, -1]]
    rows = [(7, c, 0, words + a, 0, 4, c) for c, a in enumerate(around)] + [(7, 4, 0, words, 0, 4, 4)]
    members = spark.createDataFrame(rows, "k long, c long, n int, words array<long>, g long, size long, r long")
    got = {(r["a"], r["b"]) for r in across(members, 64, hot=False).collect()}
    assert got == {(0, 2), (0, 3), (0, 4), (1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}


def test_links_inside_of_components_are_not_compared(spark, monkeypatch):
    """Forty copies with the same six corners: a pair or so for each is compared whole, not all 780, by stars or without."""
    base = [[int(w) for w in RNG.integers(-(1 << 62), 1 << 62, 4)] for _ in range(6)]
    rows = [(c, n, base[n], (20.0 * n + c % 3, 10.0 * n * n, 0, 0)) for c in range(40) for n in range(6)]
    each = spark.createDataFrame(rows, "c long, n int, words array<long>, t struct<x:float,y:float,turn:int,scale:int>")
    compared, whole = [], media.verified
    monkeypatch.setattr(media, "verified", lambda pairs, *rest: (compared.extend(pairs.collect()), whole(pairs, *rest))[1])
    for large in (64, 4):
        compared.clear()
        assert {(r["c"], r["root"]) for r in class_roots(each, 5, large).collect()} == {(c, 0) for c in range(1, 40)}
        assert 39 <= len(compared) <= 80


def test_merging_loses_no_link_of_pairs_that_are_not_picked(spark, monkeypatch):
    """Whatever pairs are links, components are those of all links, and no pair is compared twice."""
    rng = np.random.default_rng(4)
    pairs = [(a, b, int(rng.integers(2, 9))) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.3]
    pairs += [(100, 100 + i, 9 - (i == 20)) for i in range(1, 21)]  # the one link has the fewest votes
    links = {(a, b) for a, b, _ in pairs if rng.random() < 0.04} - {(100, 100 + i) for i in range(1, 20)} | {(100, 120)}
    frame = spark.createDataFrame(sorted(links), "a long, b long")
    compared = []
    monkeypatch.setattr(media, "verified", lambda some, *_: (compared.extend(map(tuple, some.select("a", "b").collect())), some.join(frame, ["a", "b"], "left_semi"))[1])
    top = {c: c for p in pairs for c in p[:2]}
    earlier = [(1, 0), (7, 0), (30, 29)]
    for _ in top:
        for a, b in [*links, *earlier]:
            top[a] = top[b] = min(top[a], top[b])
    roots = spark.createDataFrame([(a, b) for a, b in earlier] + [(0, 0), (29, 29)], "c long, root long")
    got = {r["c"]: r["root"] for r in media.merged(roots, spark.createDataFrame(pairs, "a long, b long, m long"), None, 5).collect()}
    assert {c: got.get(c, c) for c in top} == top
    assert len(set(compared)) == len(compared) < len(pairs)
