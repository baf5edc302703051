from collections import Counter

import pytest

from reviewlake.llm.mixing import mix, pfair_period, quantised, schedule


def test_period_keeps_every_source_within_one_block():
    for weights in ({"a": 1}, {"a": 5, "b": 3, "c": 1}, {str(i): i * i + 1 for i in range(12)}):
        a = quantised(weights, 101)
        assert sum(a.values()) == 101
        slots = pfair_period(a)
        assert sorted(s for own in slots.values() for s in own) == list(range(101))
        for k, w in a.items():
            for t in range(102):
                assert abs(sum(s < t for s in slots[k]) - t * w / 101) < 1


def test_schedule_fills_every_slot_once_and_lets_the_rest_go_on():
    blocks = {"a": 7, "b": 40, "c": 1, "d": 3}
    phases, periods = schedule(blocks, {"a": 5.0, "b": 1.0, "c": 1.0, "d": 0.0}, 31)
    at = {(k, p, i): s for k, p, i, s in periods}
    place = {}
    for k, p, first, n, base, a, total in phases:
        for j in range(first, first + n):
            place[k, j] = base + (j - first) // a * total + at[k, p, (j - first) % a]
    assert sorted(place.values()) == list(range(51))
    assert min(place["d", j] for j in range(3)) > max(place[k, j] for k in "abc" for j in range(blocks[k]))


def test_schedule_keeps_to_the_targets_themselves_over_many_periods():
    for weights in ({"hot": 0.9, **{str(i): 0.005 for i in range(20)}}, {"hot": 1.0, "rare": 1e-4, "x": 0.3}, {"hot": (1 / 3) ** 0.7, **{str(i): (1 / 30) ** 0.7 for i in range(20)}}):
        total, span = sum(weights.values()), 20_000
        phases, places = schedule({k: span for k in weights}, weights, 1024)
        at = sorted((s, k) for k, p, _, s in places if p == 0)
        seen, worst = dict.fromkeys(weights, 0), 0.0
        for t, (s, k) in enumerate(at[:span], 1):
            seen[k] += 1
            worst = max(worst, abs(seen[k] - t * weights[k] / total), *(abs(seen[x] - t * weights[x] / total) for x in weights) if t % 64 == 0 else (0,))
        assert worst < 1.000001


def test_mix_places_every_row_and_keeps_columns(docs):
    rows = [(i, "t", "en", ["x", "y", None, ""][i % 7 % 4], 10) for i in range(200)] + [(5, "t", "en", "y", 10)] * 2 + [(None, None, None, "x", None)]
    got = mix(docs(rows), {"x": 1, "y": 3, None: 1, "": 1}, block=20, period=64).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(rows)
    # Slots hold one block of one source each, and are all filled.
    owner = {}
    for r in got:
        assert owner.setdefault(r["slot"], r["source"]) == r["source"]
    assert sorted(owner) == list(range(len(owner)))
    # While no source has run out, y has three of six slots, within one block.
    for t in range(1, 20):
        assert abs(sum(owner[s] == "y" for s in range(t)) - t / 2) < 1 + t / 64
    assert {tuple(r) for r in mix(docs(rows), {"x": 1, "y": 3, None: 1, "": 1}, block=20, period=64).collect()} == {tuple(r) for r in got}


def test_mix_of_more_than_256_sources(docs):
    got = mix(docs([(i, "t", "en", f"s{i % 300}", 10) for i in range(600)]), block=10).collect()
    assert sorted(r["slot"] for r in got) == list(range(600)) and len({r["source"] for r in got}) == 300


def test_mix_of_nothing_and_of_too_many_sources(docs):
    assert mix(docs([])).count() == 0
    with pytest.raises(ValueError):
        mix(docs([(i, "", "", str(i), 1) for i in range(5)]), max_sources=4)
    # Columns of the result's names are replaced, others may have any name.
    df = docs([(1, "", "", "s", 1)]).selectExpr("*", "7L AS slot", "'z' AS _p2")
    assert mix(df).select("slot", "_p2").first() == (0, "z")
