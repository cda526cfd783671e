"""Windows of a grid with what items cover in them, against plain loops."""

import math

import pytest

from tidewave.operators import datasets, segments

ITEMS = [
    ("a", 3, 17), ("a", 20, 20), ("a", 25, 25), ("a", 31, 900), ("a", 905, None), ("a", None, 950), ("a", 990, 1001),
    ("b", 7, 7), (None, 0, 50), ("c", 5, 6),
]
BOUNDS = [("a", 0, 1001), ("b", 7, 7), ("c", 0, 40), ("d", 10, 640), (None, 0, 30)]


@pytest.mark.parametrize(("duration", "overlap"), [(10, 0.0), (10, 0.5), (40, 0.75)])
def test_populated_total(spark, duration, overlap):
    bounds = spark.createDataFrame(BOUNDS, "station string, begin_us long, end_us long")
    items = spark.createDataFrame([(*x, k) for k, x in enumerate(ITEMS)], "station string, begin_us long, end_us long, id long")
    hop, wanted = round(duration * (1 - overlap)), []
    for station, low, high in BOUNDS:
        for w in range(math.ceil((high - low) / hop)):
            begin, end = low + w * hop, low + w * hop + duration
            met = [min(e, end) - max(b, begin) for s, b, e in ITEMS if s == station is not None and None not in (b, e) and begin < e and end > b]
            wanted.append((station, w, begin, end, sum(met), len(met), round(sum(met) / duration, 6)))
    got = segments.populated_total(bounds, items, "station", duration, overlap)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))


def test_windows_are_not_dealt_out(spark):
    """60 copies of the events of sf0.1 have 63 million windows; only stretches of them, and items, may pass an exchange."""
    bounds = spark.createDataFrame([("a", 0, 1_000_000)], "station string, begin_us long, end_us long")
    items = spark.createDataFrame([("a", 3, 17)], "station string, begin_us long, end_us long")
    plan = segments.populated_total(bounds, items, "station", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence((_stretch") < plan.index("Join LeftOuter")


def test_filled_is_never_null(spark):
    rows = spark.createDataFrame([(0.3,), (0.25,), (None,)], "ratio double")
    kept, removed = datasets.drop_empty(rows, rows.ratio, 0.25)
    assert (kept.count(), removed.count()) == (1, 2)


@pytest.mark.parametrize("duration", [10, 37, 2000])
def test_items_total(spark, duration):
    bounds = spark.createDataFrame(BOUNDS, "station string, begin_us long, end_us long")
    items = spark.createDataFrame([(*x, k) for k, x in enumerate([*ITEMS, ("c", -9, 3), ("c", 30, 60), ("c", 95, 99)])], "station string, begin_us long, end_us long, id long")
    known, wanted = [x for x in items.collect() if None not in tuple(x)], []
    for station, low, high in BOUNDS:
        for w in range(math.ceil((high - low) / duration)):
            begin, end = low + w * duration, low + (w + 1) * duration
            reached = begin
            for _, b, e, k in sorted(x for x in known if x.station == station and x.begin_us < end and x.end_us > begin):
                wanted += [(station, begin, reached, b, None)] * (b > reached) + [(station, begin, max(b, begin), min(e, end), k)]
                reached = min(e, end)
            wanted += [(station, begin, reached, end, None)] * (reached < end)
    got = segments.items_total(bounds, items, "station", duration)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, wanted))


def test_windows_of_items_are_not_dealt_out(spark):
    """60 copies of the events of sf0.1 have 10 million windows of six hours; only items and one mark of a grid may pass an exchange."""
    bounds = spark.createDataFrame([("a", 0, 1_000_000)], "station string, begin_us long, end_us long")
    items = spark.createDataFrame([("a", 3, 17, 1)], "station string, begin_us long, end_us long, id long")
    plan = segments.items_total(bounds, items, "station", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence(") < min(plan.index(x) for x in ("Join", "Window"))
