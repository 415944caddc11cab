"""Context management over message logs: pruning, truncation, budgets and splits.

Messages: conv_id, idx (0, 1, ... in the conversation), role, tool, text, and ts
(milliseconds) where ages count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import is_failure
from sieveline.operators.usage import FLOOR, TRIGGER, WINDOW_OVERRIDE, text_tokens, with_model

KEEP_RESULTS, MIN_CLEAR, KEEP_MESSAGES = 3, 500, 6
SOFT_MS, HARD_MS, KEEP_ENDS = 5 * 60_000, 10 * 60_000, 1_500
SINGLE_SHARE, TOTAL_SHARE, BUFFER_SHARE = 0.5, 0.75, 0.05

_TOOL = "tool"

def _conversation():
    return Window.partitionBy("conv_id")



def _is_tool() -> Column:
    return F.col("role") == _TOOL


def microcompact(messages: DataFrame, keep: int = KEEP_RESULTS, least: int = MIN_CLEAR) -> DataFrame:
    """Tool results but the last ``keep`` become a placeholder if they have ``least`` characters or more."""
    back = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("idx")))
    cleared = _is_tool() & (back > keep) & (F.length("text") >= least)
    note = F.concat(F.lit("["), F.coalesce("tool", F.lit("unknown")), F.lit(" result cleared, "), F.length("text").cast("string"), F.lit(" characters]"))
    return messages.withColumn("cleared", cleared).withColumn("text", F.when(F.col("cleared"), note).otherwise(F.col("text")))


def truncate_results(messages: DataFrame, window: int = WINDOW_OVERRIDE) -> DataFrame:
    """Tool results beyond half the window keep 60 % of that at the head and 40 % at the tail.

    Needs ``model``.  A tail of no characters is empty.
    """
    limit = int(window * SINGLE_SHARE)
    rows = with_model(messages).withColumn("tokens", text_tokens(F.col("text")))
    budget = F.floor(F.lit(limit) * F.length("text") / F.greatest("tokens", F.lit(1)))
    head, tail = F.floor(budget * 6 / 10).cast("int"), F.floor(budget * 4 / 10).cast("int")
    over = _is_tool() & (F.col("tokens") > limit)
    kept = F.concat(F.left("text", head), F.lit("\n\n[truncated: "), F.col("tokens").cast("string"), F.lit(f" → ~{limit} tokens]\n\n"), F.right("text", tail))
    out = rows.withColumn("truncated", over).withColumn("text", F.when(over, kept).otherwise(F.col("text")))
    return out.select(*messages.columns, "tokens", "truncated")


def budget_compact(messages: DataFrame, budget: int) -> DataFrame:
    """Tool results go, oldest first, until the conversation's sizes fit ``budget``.

    ``messages`` has ``size``.  A tool message goes exactly if what is left after all
    earlier tool messages is still too much, so no loop is needed.
    """
    earlier = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    gone_before = F.coalesce(F.sum(F.when(_is_tool(), F.col("size")).otherwise(0)).over(earlier), F.lit(0))
    compacted = _is_tool() & (F.sum("size").over(_conversation()) - gone_before > budget)
    return messages.withColumn("compacted", compacted)


def ttl_prune(messages: DataFrame, as_of: int, soft: int = SOFT_MS, hard: int = HARD_MS, ends: int = KEEP_ENDS) -> DataFrame:
    """Old tool results: a placeholder after ``hard`` ms, head and tail after ``soft``; failures and rows without ts stay."""
    age = F.lit(as_of) - F.col("ts")
    prunable = _is_tool() & F.col("ts").isNotNull() & ~is_failure(F.col("text"))
    action = F.when(prunable & (age >= hard), "hard").when(prunable & (age >= soft) & (F.length("text") > 2 * ends), "soft").otherwise("keep")
    note = F.concat(F.lit("[tool result expired: "), F.coalesce("tool", F.lit("unknown")), F.lit("]"))
    middle = F.concat(F.left("text", F.lit(ends)), F.lit("\n\n[soft pruned: "), (F.length("text") - 2 * ends).cast("string"), F.lit(f" chars removed, content older than {round(soft / 60000)}min]\n\n"), F.right("text", F.lit(ends)))
    rows = messages.withColumn("action", action)
    return rows.withColumn("text", F.when(F.col("action") == "hard", note).when(F.col("action") == "soft", middle).otherwise(F.col("text")))


def defend(messages: DataFrame, as_of: int, window: int = WINDOW_OVERRIDE) -> DataFrame:
    """Truncate, fit the budget, prune by age; with the tokens of what is left."""
    cut = truncate_results(messages, window).drop("tokens", "truncated")
    sized = with_model(cut).withColumn("size", text_tokens(F.col("text"))).select(*messages.columns, "size")
    fit = budget_compact(sized, int(window * TOTAL_SHARE))
    note = F.concat(F.lit("[compacted: "), F.coalesce("tool", F.lit("unknown")), F.lit(" output removed to free context]"))
    fit = fit.withColumn("text", F.when(F.col("compacted"), note).otherwise(F.col("text"))).drop("size", "compacted")
    pruned = ttl_prune(fit, as_of).drop("action")
    return with_model(pruned).withColumn("tokens", text_tokens(F.col("text"))).select(*messages.columns, "tokens")


def summary_split(messages: DataFrame, keep: int = KEEP_MESSAGES, window: int = WINDOW_OVERRIDE) -> DataFrame:
    """(conv_id, n, tokens, split_at, compact): where the part to summarise ends (0: nothing to do).

    The split is the last user message at or before the ``keep`` last ones; short or
    small conversations are left alone.  Needs ``model``.
    """
    rows = with_model(messages).withColumn("tokens", F.col("w_message").cast("long") + text_tokens(F.col("text"))).withColumn("n", F.count("*").over(_conversation()))
    at = F.max(F.when((F.col("role") == "user") & (F.col("idx") <= F.col("n") - keep), F.col("idx")))
    out = rows.groupBy("conv_id").agg(F.max("n").alias("n"), F.sum("tokens").alias("tokens"), F.coalesce(at, F.lit(0)).alias("at"))
    act = (F.col("tokens") >= int(window * FLOOR)) & (F.col("n") > keep)
    return out.select("conv_id", "n", "tokens", F.when(act, F.col("at")).otherwise(0).alias("split_at"), (F.col("tokens") > int(window * TRIGGER)).alias("compact"))


def assemble(parts: DataFrame) -> DataFrame:
    """(prompt_id, prompt): parts in order of ``seq``, nulls skipped, joined by a blank line."""
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("seq", "part")))), lambda p: p["part"])
    return parts.groupBy("prompt_id").agg(F.array_join(ordered, "\n\n").alias("prompt"))


def snapshot(slices: DataFrame, window: int, cells: int = 256) -> DataFrame:
    """Each category's tokens and cells of the context map (at least one if it has any).  ``slices``: conv_id, category, tokens."""
    sums = slices.groupBy("conv_id", "category").agg(F.sum("tokens").alias("tokens"))
    used = F.sum("tokens").over(_conversation())
    n = F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.floor(F.col("tokens") * cells / window + 0.5))).otherwise(0).cast("long")
    return sums.select("conv_id", "category", "tokens", n.alias("cells"), used.alias("used"), F.lit(int(window * BUFFER_SHARE)).cast("long").alias("buffer"))
