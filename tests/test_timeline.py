import random

import pytest

from tidewave.operators import segments, timeline

SCHEMA = "station long, id long, begin_us long, end_us long"


def frame(spark, rows):
    return spark.createDataFrame([(1, i, b, e) for i, (b, e) in enumerate(rows)], SCHEMA)


def chain(rows):
    """The greedy chain, straight from its description."""
    left = sorted(rows, key=lambda r: (r[0], -r[1]))
    out = []
    while left:
        cur, rest = left[0], left[1:]
        near = [x for x in rest if x[0] < cur[1] and x[1] > cur[0]]
        if not near:
            out.append(cur)
            left = rest
            continue
        nxt = max(near, key=lambda x: x[1])
        if nxt[1] > cur[1]:
            out.append((cur[0], nxt[0]))
            left = [nxt] + [x for x in rest if x not in near and x[0] >= nxt[0]]
        else:
            left = [cur] + [x for x in rest if x not in near]
    return sorted(out)


@pytest.mark.parametrize(
    "rows, kept",
    [
        ([(0, 10)], [(0, 10)]),
        ([(10, 25), (0, 15), (20, 35)], [(0, 10), (10, 20), (20, 35)]),
        ([(0, 100), (20, 40), (90, 120)], [(0, 90), (90, 120)]),
        ([(0, 10), (10, 20)], [(0, 10), (10, 20)]),
        ([(0, 10), (0, 10)], [(0, 10)]),
        ([(0, 10), (2, 18), (5, 30)], [(0, 5), (5, 30)]),
    ],
)
def test_remove_overlaps(spark, rows, kept):
    got = timeline.remove_overlaps(frame(spark, rows), "station").select("begin_us", "end_us").collect()
    assert sorted(map(tuple, got)) == kept


def test_remove_overlaps_random(spark):
    rng = random.Random(4)
    rows = list({(b := rng.randrange(0, 4000), b + rng.randrange(1, 120)) for _ in range(160)})
    got = timeline.remove_overlaps(frame(spark, rows), "station").select("begin_us", "end_us").collect()
    assert sorted(map(tuple, got)) == chain(rows)


def test_interval_join_counts_each_pair_once_and_keeps_borders_out(spark):
    rng = random.Random(5)
    rows = [(b := rng.randrange(0, 500), b + rng.randrange(0, 90)) for _ in range(60)]
    own = frame(spark, rows)
    got = timeline.interval_join(own, own, ["station"], 16).select("l_id", "r_id").collect()
    want = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] < b[1] and a[1] > b[0]]
    assert sorted(map(tuple, got)) == want


def test_interval_join_of_mixed_durations(spark):
    """One interval of a year among seconds: the rows it takes follow the levels, not the seconds."""
    rng = random.Random(6)
    second, year = 1_000_000, 365 * timeline.DAY_US
    rows = [(0, year), (5 * second, 5 * second), (7, year // 3)] + [(b := rng.randrange(0, year), b + rng.choice([0, 1, second, 90 * second, 4_000 * second, timeline.DAY_US])) for _ in range(300)]
    own = frame(spark, rows)
    bucketed = timeline._buckets(own, own, second, "x").groupBy("id").count()
    assert bucketed.agg({"count": "max"}).first()[0] <= 3 * 26
    want = sorted((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] < b[1] and a[1] > b[0])
    for width in (second, 3_600 * second):
        got = timeline.interval_join(own, own, ["station"], width)
        assert sorted(map(tuple, got.select("l_id", "r_id").collect())) == want
        assert sorted(got.columns) == sorted(f"{s}_{c}" for s in "lr" for c in own.columns)
    hit = {i for i, _ in want}
    assert {r["id"] for r in timeline.interval_join(own, own, ["station"], second, "left_semi").collect()} == hit
    assert {r["id"] for r in timeline.interval_join(own, own, ["station"], second, "left_anti").collect()} == set(range(len(rows))) - hit


def test_gaps_and_islands(spark):
    own = frame(spark, [(0, 10), (10, 20), (30, 40)])
    assert [tuple(r) for r in timeline.fill_gaps(own, "station").select("begin_us", "end_us").collect()] == [(20, 30)]
    assert timeline.coverage_islands(own, "station").count() == 3


def test_nearest_looks_both_ways(spark):
    rng = random.Random(7)
    right = [(k, rng.randrange(2_000), rng.choice([None, *range(50)])) for k in (1, 2) for _ in range(60)] + [(3, 5, None)]
    left = [(k, rng.randrange(-100, 2_200), i) for i, k in enumerate([1, 2, 3, 4] * 60)]
    a = spark.createDataFrame(left, "station long, at_us long, id long")
    b = spark.createDataFrame(right, "station long, at_us long, value long")
    for width in (50, 10**6):
        found = {r["id"]: (r["found_us"], r["value"]) for r in timeline.nearest(a, b, "station", "value", width).collect()}
        assert len(found) == len(left)
        for k, at, i in left:
            own = [(abs(t - at), t, -v) for s, t, v in right if s == k and v is not None]
            assert found[i] == ((min(own)[1], -min(own)[2]) if own else (None, None))


def test_windows(spark):
    own = frame(spark, [(0, 50)])
    got = segments.windows_total(own.select("station", "begin_us", "end_us"), 20).select("begin_us", "end_us").collect()
    assert [tuple(r) for r in got] == [(0, 20), (20, 40), (40, 60)]
    anchored = segments.windows_file_anchored(frame(spark, [(0, 70), (80, 120)]), "station", 60).select("begin_us", "end_us").collect()
    assert sorted(map(tuple, anchored)) == [(0, 60), (60, 120)]
    apart = segments.windows_file_anchored(frame(spark, [(0, 50), (70, 120)]), "station", 60).select("begin_us", "end_us").collect()
    assert sorted(map(tuple, apart)) == [(0, 60), (70, 130)]
    with pytest.raises(ValueError):
        segments.hop_us(10, 1.0)


def test_batches_spread_the_remainder(spark):
    own = frame(spark, [(i, i + 1) for i in range(10)])
    got = segments.batches(own, ["begin_us"], 3).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 4), (1, 3), (2, 3)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert timeline.remove_overlaps(none, "station").count() == 0
    assert timeline.coverage_islands(none, "station").count() == 0
    assert segments.windows_file_anchored(none, "station", 10).count() == 0
