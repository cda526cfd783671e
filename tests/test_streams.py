"""Streams whose events arrive in any order, against the same events at once."""

import random

import pytest

from tidewave.operators import segments
from tidewave.streaming import windows

SCHEMA = "key long, id long, begin_us long, end_us long"
LATE = 10_000_000


def arriving(spark, folder, batches):
    """A stream that takes one batch of rows a trigger."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def events(rng, n):
    """Events of three keys, each at most about LATE after the ones around it, in batches; and a last one that lets all others have their turn."""
    rows = [(k, 100 * k + i, b := i * 900_000 + rng.randrange(500_000), b + rng.randrange(0, 3_000_000)) for k in range(3) for i in range(n)]
    # a row moves by less than LATE
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(LATE - 1_000_000))
    size = len(rows) // 5
    batches = [shuffled[k : k + size] for k in range(0, len(rows), size)]
    return rows, [*batches, [(k, 9_000 + k, 10**12, 10**12 + 1) for k in range(3)], [(7, 1, 2 * 10**12, 2 * 10**12)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_trimming_does_not_depend_on_arrival(spark, tmp_path, seed):
    rows, batches = events(random.Random(seed), 40)
    stream = windows.trim_in_order(arriving(spark, f"{tmp_path}/in", batches), LATE)
    windows.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    wanted = []
    for key in range(3):
        reach = 0
        for _, i, b, e in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[3], r[1])):
            if max(b, reach) < e:
                wanted.append((key, i, max(b, reach), e, False))
            reach = max(reach, e)
    found = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("id < 9000 and key < 7").collect()]
    assert sorted(found) == sorted(wanted)


def test_chunks_equal_those_of_the_batch(spark, tmp_path):
    rows, batches = events(random.Random(3), 40)
    duration = 2_500_000
    chunks = windows.anchored_in_order(arriving(spark, f"{tmp_path}/in", batches), LATE, duration)
    live = segments.windows_total(chunks.where("not late").select("key", "begin_us", "end_us"), duration)
    windows.run_available(live, f"{tmp_path}/out", f"{tmp_path}/state")
    last = [(k, 9_000 + k, 10**12, 10**12 + 1) for k in range(3)]
    whole = segments.windows_file_anchored(spark.createDataFrame(rows + last, SCHEMA), "key", duration)
    wanted = sorted((r["key"], r["begin_us"], r["end_us"]) for r in whole.where("begin_us < 1000000000000").collect())
    found = sorted((r["key"], r["begin_us"], r["end_us"]) for r in spark.read.parquet(f"{tmp_path}/out").where("begin_us < 1000000000000").collect())
    assert found == wanted


def test_late_rows_go_aside(spark, tmp_path):
    second = 1_000_000
    batches = [[(1, 1, 100 * second, 101 * second)], [(1, 2, 115 * second, 116 * second)], [(1, 3, 99 * second, 130 * second), (1, 4, 108 * second, 109 * second)], [(1, 5, 10**12, 10**12 + 1)]]
    stream = windows.trim_in_order(arriving(spark, f"{tmp_path}/in", batches), LATE)
    windows.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    found = {r["id"]: (r["begin_us"] // second, r["end_us"] // second, r["late"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {1: (100, 101, False), 2: (115, 116, False), 3: (99, 130, True), 4: (108, 109, False)}
