"""Loop detection over tool calls.

Each call is judged by the (up to) 30 calls before it in its turn.  Calls: turn_id,
seq, tool, args_hash, result_hash (null: not yet resolved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY, WARNING, CRITICAL, BREAKER = 30, 5, 8, 10


def detect(calls: DataFrame, history: int = HISTORY) -> DataFrame:
    """Calls with their repeat count, no-progress streak, ping-pong count and verdict.

    The frame has a fixed number of rows, so its lists are small whatever a turn's
    length.
    """
    before = Window.partitionBy("turn_id").orderBy("seq").rowsBetween(-history, -1)
    rows = calls.withColumn("past", F.collect_list(F.struct("tool", "args_hash", "result_hash")).over(before))
    past = F.reverse("past")  # the latest first
    same = F.filter(past, lambda c: (c["tool"] == F.col("tool")) & (c["args_hash"] == F.col("args_hash")))
    solved = F.transform(F.filter(same, lambda c: c["result_hash"].isNotNull()), lambda c: c["result_hash"])
    rows = rows.withColumns({"_past": past, "repeats": F.size(same), "_solved": solved})
    # calls until the result differs from the latest one
    unlike = F.filter(F.transform("_solved", lambda r, i: F.when(r != F.element_at("_solved", 1), i)), lambda i: i.isNotNull())
    streak = F.when(F.size("_solved") == 0, 0).otherwise(F.coalesce(F.element_at(F.when(F.size(unlike) > 0, unlike), 1), F.size("_solved")))
    last = F.element_at(F.when(F.size("_past") > 0, F.col("_past")), 1)["args_hash"]
    others = F.filter("_past", lambda c: c["args_hash"] != last)
    rows = rows.withColumns({"streak": streak, "_last": last, "_other": F.element_at(F.when(F.size(others) > 0, others), 1)["args_hash"]})
    broken = F.filter(F.transform("_past", lambda c, i: F.when(c["args_hash"] != F.when(i % 2 == 0, F.col("_last")).otherwise(F.col("_other")), i)), lambda i: i.isNotNull())
    run = F.coalesce(F.element_at(F.when(F.size(broken) > 0, broken), 1), F.size("_past"))
    counts = F.col("_other").isNotNull() & (F.size("_past") >= 3) & (F.col("args_hash") == F.col("_other")) & (run >= 2)
    rows = rows.withColumn("ping_pong", F.when(counts, run + 1).otherwise(0))
    verdict = (
        F.when(F.col("streak") >= BREAKER, "critical:breaker")
        .when(F.col("ping_pong") >= CRITICAL, "critical:ping_pong")
        .when(F.col("ping_pong") >= WARNING, "warning:ping_pong")
        .when(F.col("repeats") >= CRITICAL, "critical:repeat")
        .when(F.col("repeats") >= WARNING, "warning:repeat")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict).select(*calls.columns, "repeats", "streak", "ping_pong", "verdict")
