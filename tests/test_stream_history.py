import random

import pytest

from pairsim.operators.history import early_stop
from pairsim.streaming import history as streams

SCHEMA = "run_id string, epoch long, value double"
NAN = float("nan")


def made(seed):
    rng = random.Random(seed)
    rows = []
    for run in range(12):
        for epoch in range(rng.randint(1, 40)):
            value = rng.choice([0.1, 0.2, 0.3, epoch / 40, epoch / 20])
            rows.append((f"r{run}", epoch, NAN if rng.random() < 0.01 else value))
    return rows


def followed(spark, folder, parts, source):
    """Each part as a file of its own; the query runs anew for every one."""
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        streams.stream_early_stop(stream, folder, f"{folder}-checkpoint").awaitTermination()
    return {r.run_id: r for r in streams.read_state(spark, folder).collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_the_table(spark, tmp_path, parts):
    rows = made(parts)
    want = {r.run_id: (r.stop_epoch, r.epochs) for r in early_stop(spark.createDataFrame(rows, SCHEMA)).collect()}
    cut = [[r for r in rows if r[1] * parts // 40 == i] for i in range(parts)]
    random.Random(3).shuffle(cut[0])
    got = followed(spark, str(tmp_path / "out"), cut, str(tmp_path / "in"))
    assert {k: (r.stop_epoch, r.epochs) for k, r in got.items()} == want
    assert all(r.late == 0 for r in got.values())


def test_late_and_repeated_epochs_change_nothing(spark, tmp_path):
    first = [("a", e, 1.0 - e) for e in range(3)] + [("a", 1, -9.0)]
    second = [("a", 0, 99.0), ("a", 2, 99.0), ("a", 3, 0.0), ("b", 0, None)]
    got = followed(spark, str(tmp_path / "out"), [first, second], str(tmp_path / "in"))
    assert (got["a"].epochs, got["a"].late, got["a"].stop_epoch, got["a"].best) == (4, 3, None, 1.0)
    assert (got["b"].epochs, got["b"].stop_epoch, got["b"].best) == (1, 0, None)


def test_a_repeated_batch_gives_the_same_state(spark):
    before = spark.createDataFrame([("a", 1.0, 2, 5, None, 6, 0, 0)], streams.STATE)
    rows = spark.createDataFrame([("a", 6, 0.5), ("a", 7, 0.5)], SCHEMA)
    runs = [streams.advance(before, rows, 1).collect() for _ in range(2)]
    assert runs[0] == runs[1] and runs[0][0].stop_epoch == 7 and runs[0][0].epochs == 8


def test_blocks_do_not_show(spark):
    rows = spark.createDataFrame([r for r in made(5)], SCHEMA)
    empty = spark.createDataFrame([], streams.STATE)
    one, many = (sorted(streams.advance(empty, rows, 0, block=b).collect()) for b in (1000, 3))
    assert [r.stop_epoch for r in one] == [r.stop_epoch for r in many]
