"""Folds spread over blocks, against the folds themselves."""

import random
from itertools import islice
from statistics import median

import numpy as np
import pytest

from tidewave.operators import chains, ranges, segments, timeline

SCHEMA = "station string, id long, begin_us long, end_us long"


def greedy(rows):
    """The furthest-reaching chain over (begin, end, id), straight from its description."""
    left, out = sorted(rows, key=lambda r: (r[0], -r[1], r[2])), []
    while left:
        cur, rest = left[0], left[1:]
        near = [x for x in rest if x[0] < cur[1]]
        best = max(near, key=lambda x: x[1], default=cur)  # the first of several
        if best[1] > cur[1]:
            out.append((cur[2], cur[0], best[0]))
            left = [best] + [x for x in rest if x[0] >= cur[1]]
        else:
            out.append((cur[2], cur[0], cur[1]))
            left = [x for x in rest if x[0] >= cur[1]]
    return sorted(out)


def anchored(rows, duration, hop):
    out, chunk = [], None
    for b, e, _ in sorted(rows):
        if chunk and chunk[0] + hop * (-(-(chunk[1] - chunk[0]) // hop) - 1) + duration >= b:
            chunk = (chunk[0], e)
        else:
            out += [chunk] if chunk else []
            chunk = (b, e)
    return sorted([*out, chunk])


def cut(rng, n, parts):
    cuts = [0, *sorted(rng.sample(range(1, n), min(parts - 1, n - 1))), n]
    return list(zip(cuts[:-1], cuts[1:]))


def test_steps_equal_an_array():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randrange(1, 30)
        steps, plain = chains.Steps(size), [None] * size
        for v in range(rng.randrange(12)):
            low, length = rng.randrange(0, 3 * size), rng.randrange(1, size + 3)
            steps.put(low, low + length, v)
            for x in range(min(length, size)):
                plain[(low + x) % size] = v
            assert [steps[x] for x in range(size)] == plain and steps.at == sorted(set(steps.at))


def test_blocks_of_overlaps_equal_the_fold():
    rng = random.Random(2)
    for trial in range(300):
        rows = sorted({(b := rng.randrange(300), b + rng.randrange(1, rng.choice([5, 60, 200]))): None for _ in range(rng.randrange(2, 60))}, key=lambda r: (r[0], -r[1]))
        records, reach = [], -1
        for k, (b, e) in enumerate(rows):
            if e > reach:
                records.append((b, e, k))
            reach = max(reach, e)
        found, handed = [], None
        parts = cut(rng, len(records), rng.randrange(1, 6)) if len(records) > 1 else [(0, len(records))]
        for a, z in parts:
            arrays = [np.array(c, dtype=np.int64) for c in zip(*records[a:z])]
            border = {"before_us": records[a - 1][1] if a else None, "after_us": records[z][0] if z < len(records) else None, "handed": handed}
            found += list(chains._chosen(border, *arrays))
            lows, values = zip(*chains._overlap_steps(border, *arrays))
            handed = chains._handed_end(handed, list(lows), list(values), border)
        trimmed = [(i, b, min(e, nxt)) for (b, e, i), nxt in zip(found, [f[0] for f in found[1:]] + [10**9])]
        assert sorted(trimmed) == greedy([(b, e, k) for k, (b, e) in enumerate(rows)])


def test_blocks_with_records_of_no_length_equal_the_fold():
    rng = random.Random(6)
    for trial in range(300):
        rows = [(b := rng.randrange(120), b + rng.choice([0, 0, 1, 7, rng.randrange(40)])) for _ in range(rng.randrange(2, 60))]
        rows = sorted(rows, key=lambda r: (r[0], -r[1]))
        records, reach = [], -1
        for k, (b, e) in enumerate(rows):
            if e > reach or b >= reach:
                records.append((b, e, k))
            reach = max(reach, e)
        found, handed = [], None
        parts = cut(rng, len(records), rng.randrange(1, 6)) if len(records) > 1 else [(0, len(records))]
        for a, z in parts:
            arrays = [np.array(c, dtype=np.int64) for c in zip(*records[a:z])]
            border = {"before_us": records[a - 1][1] if a else None, "after_us": records[z][0] if z < len(records) else None, "handed": handed}
            chosen = list(islice(chains._chosen(border, *arrays), z - a + 1))  # a walk that goes back would never end
            assert len(chosen) <= z - a
            found += chosen
            lows, values = zip(*chains._overlap_steps(border, *arrays))
            handed = chains._handed_end(handed, list(lows), list(values), border)
        trimmed = [(i, b, min(e, nxt)) for (b, e, i), nxt in zip(found, [f[0] for f in found[1:]] + [10**9])]
        assert sorted(trimmed) == greedy([(b, e, k) for k, (b, e) in enumerate(rows)])


def test_blocks_of_files_equal_the_fold():
    rng = random.Random(3)
    for trial in range(400):
        rows, at = [], rng.randrange(50)
        for k in range(rng.randrange(2, 50)):
            length = rng.randrange(0, 30)
            rows.append((at, at + length, k))
            at += length + rng.choice([0, 0, 1, 2, 5, 40, -3 if length > 4 else 0])
        rows.sort()
        duration = rng.randrange(1, 40)
        hop = rng.randrange(1, duration + 1)
        found, handed = [], None
        for a, z in cut(rng, len(rows), rng.randrange(1, 6)):
            arrays = [np.array(c, dtype=np.int64) for c in zip(*rows[a:z])]
            border = {"before_us": rows[a - 1][1] if a else None, "handed": handed}
            found += list(chains._anchors(duration, hop)(border, *arrays))
            lows, values = zip(*chains._anchored_steps(duration, hop)(border, *arrays))
            handed = chains._handed_residue(handed, list(lows), list(values), border)
        closed = [(b, c) for (b, _), c in zip(found, [f[1] for f in found[1:]] + [rows[-1][1]])]
        assert sorted(closed) == anchored(rows, duration, hop)


@pytest.fixture
def ranged(spark):
    """Small ranges are not put together, so that there are several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def one_island():
    """Stations with one run of overlapping intervals each, and one with a few rows."""
    rng = random.Random(4)
    rows = [("long", k, b := rng.randrange(400_000), b + rng.randrange(1, 2_000)) for k in range(6_000)]
    rows = list({r[2:]: r for r in rows}.values())
    rows += [("ties", k, 10 * (k // 3), 10 * (k // 3) + 5 * (k % 3) + 7) for k in range(900)]
    return rows + [("few", 1, 0, 10), ("few", 2, 5, 9), ("few", 3, 10, 20)]


def test_one_island_is_spread_over_blocks(ranged, one_island):
    frame = ranged.createDataFrame(one_island, SCHEMA)
    found = [tuple(r) for r in timeline.remove_overlaps(frame, "station").select("station", "id", "begin_us", "end_us").collect()]
    for station in ("long", "ties", "few"):
        own = [(b, e, i) for s, i, b, e in one_island if s == station]
        assert sorted(r[1:] for r in found if r[0] == station) == greedy(own)
    # each task holds one range of rows: no range is over twice the median
    sizes = [r["count"] for r in ranges.placed(frame.where("station = 'long'"), ["station", "begin_us"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * median(sizes)


def test_one_run_of_files_is_spread_over_blocks(ranged):
    rng = random.Random(5)
    rows, at = [], 0
    for k in range(4_000):
        length = rng.randrange(50, 70)
        rows.append(("s", k, at, at + length))
        at += length + rng.choice([0, 1, 2, 9])
    rows += [("t", 1, 5, 50), ("t", 2, 51, 60)]
    frame = ranged.createDataFrame(rows, SCHEMA)
    for duration, overlap in ((60, 0.0), (100, 0.5), (7, 0.0)):
        found = chains.anchored_chunks(frame, "station", duration, segments.hop_us(duration, overlap)).collect()
        for station in "st":
            own = [(b, e, i) for s, i, b, e in rows if s == station]
            assert sorted((r["begin_us"], r["end_us"]) for r in found if r["station"] == station) == anchored(own, duration, segments.hop_us(duration, overlap))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert timeline.remove_overlaps(none, "station").count() == 0 == chains.anchored_chunks(none, "station", 10, 10).count()
    assert timeline.remove_overlaps(none, "station").columns == ["station", "id", "begin_us", "end_us"]


def test_intervals_of_no_length_and_without_an_end(ranged):
    rows = [("a", 1, 0, 10), ("a", 2, 10, 10), ("a", 3, 10, 10), ("a", 4, 12, 12), ("a", 5, 12, 20), ("a", 6, 15, 15), ("a", 7, 18, 25), ("a", 8, 30, 30)]
    rows += [("b", 1, 0, None), ("b", 2, 5, 9), ("b", 3, 7, None), ("b", 4, 9, None), ("b", 5, 11, 12)]
    kept = timeline.remove_overlaps(ranged.createDataFrame(rows, SCHEMA), "station")
    assert sorted(tuple(r) for r in kept.where("station = 'a'").select("id", "begin_us", "end_us").collect()) == greedy([(b, e, i) for s, i, b, e in rows if s == "a"])
    assert {tuple(r) for r in kept.where("station = 'b'").select("id", "begin_us", "end_us").collect()} == {(1, 0, None), (2, 5, 9), (4, 9, None), (5, 11, 12)}
