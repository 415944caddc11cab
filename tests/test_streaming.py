"""A drained stream gives what the batch gives."""

from sieveline.operators.calls import detect
from sieveline.streaming import logs

KIND = "turn_id long, seq long, tool string, args_hash string, result_hash string"


def test_loop_verdicts(spark, tmp_path):
    rows = [(t, i, "t", "ab"[i % 2] if t else "a", "r") for t in range(3) for i in range(11)]
    calls = spark.createDataFrame(rows, KIND)
    calls.coalesce(1).write.parquet(str(tmp_path / "calls"))
    found = []
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls"))
    logs.loop_verdicts(stream, lambda frame, _: found.extend(map(tuple, frame.collect())), str(tmp_path / "state")).awaitTermination()
    assert sorted(found) == sorted(map(tuple, detect(calls).collect()))


def test_usage_totals(spark, tmp_path):
    steps = spark.createDataFrame([("a", 3, 0.5), ("b", 4, 1.0), ("a", 5, 0.25)], "model string, tokens long, cost double")
    steps.repartition(2).write.parquet(str(tmp_path / "steps"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps"))
    assert sorted(map(tuple, logs.drain(logs.usage_totals(stream)).collect())) == sorted(map(tuple, logs.usage_totals(steps).collect()))
