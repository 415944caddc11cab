"""Usage accounting: prices, normalised token counts, costs, totals, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.tokenizers import token_estimate

# Price per million tokens (input, output, cache write, cache read),
# token weights (CJK, ASCII, other, per message) by family, context window.
PRICES = {
    "claude-opus-4-7": (15.0, 75.0, 18.75, 1.5),
    "claude-sonnet-4-7": (3.0, 15.0, 3.75, 0.3),
    "claude-haiku-4-5": (1.0, 5.0, 1.25, 0.1),
    "gpt-5-5": (5.0, 20.0, 5.0, 0.5),
    "gpt-5": (5.0, 15.0, 5.0, 1.25),
    "gemini-3-pro": (2.5, 12.0, 2.5, 0.625),
    "gemini-3-flash": (0.3, 1.2, 0.3, 0.075),
    "deepseek-v3-2": (0.27, 1.1, 0.27, 0.027),
    "deepseek-v4-flash": (1.0, 2.0, 1.0, 0.1),
    "qwen3-6-plus": (0.4, 1.2, 0.4, 0.04),
    "kimi-k2-6": (0.6, 2.5, 0.6, 0.15),
    "doubao-2-0-pro": (0.3, 0.9, 0.3, 0.12),
    "mock-model": (1.0, 5.0, 1.25, 0.1),
}
WEIGHTS = {"bpe": (1.5, 0.27, 0.5, 3), "deepseek": (0.6, 0.3, 0.5, 3)}
BPE_MODELS = ("claude-opus-4-7", "claude-sonnet-4-7", "claude-haiku-4-5", "gpt-5-5", "gpt-5", "gemini-3-pro", "gemini-3-flash")
WINDOWS = {
    "claude-opus-4-7": 200_000,
    "claude-sonnet-4-7": 200_000,
    "claude-haiku-4-5": 200_000,
    "gpt-5-5": 400_000,
    "gpt-5": 272_000,
    "gemini-3-pro": 1_000_000,
    "gemini-3-flash": 1_000_000,
    "deepseek-v3-2": 128_000,
    "deepseek-v4-flash": 128_000,
    "qwen3-6-plus": 262_144,
    "kimi-k2-6": 262_144,
    "doubao-2-0-pro": 262_144,
    "mock-model": 8_000,
}
DEFAULT_MODEL, WINDOW_OVERRIDE, TRIGGER, FLOOR = "mock-model", 4_000, 0.85, 0.10
TURN_BUDGET, TURN_WARNING = 15_000, 0.9


def dimensions(spark: SparkSession) -> DataFrame:
    """One row per model: prices, weights, window."""
    rows = [(m, *PRICES[m], *map(float, WEIGHTS["bpe" if m in BPE_MODELS else "deepseek"]), WINDOWS[m]) for m in PRICES]
    return spark.createDataFrame(rows, "model string, p_input double, p_output double, p_write double, p_read double, w_cjk double, w_ascii double, w_other double, w_message double, window long")


def with_model(frame: DataFrame) -> DataFrame:
    """``frame`` (model, ...) with its model's dimensions; unknown models have the default's."""
    table = dimensions(frame.sparkSession)  # as many rows as PRICES has
    known = F.when(F.col("model").isin(*PRICES), F.col("model")).otherwise(DEFAULT_MODEL)
    return frame.withColumn("_known", known).join(F.broadcast(table.withColumnRenamed("model", "_known")), "_known").drop("_known")


def normalise(usage: DataFrame) -> DataFrame:
    """Four token counts from raw fields of differing names.

    ``usage``: input_tokens, output_tokens, cached_input_tokens, provider_cached_tokens,
    cache_creation_tokens, provider_creation_tokens (any null).  Cached tokens that
    the input includes are taken out of it.
    """
    read = F.coalesce("cached_input_tokens", "provider_cached_tokens", F.lit(0))
    given = F.coalesce("input_tokens", F.lit(0))
    fresh = F.when((read != 0) & (given >= read), given - read).otherwise(given)
    return usage.withColumns(
        {
            "fresh_input": F.greatest(fresh, F.lit(0)),
            "output": F.coalesce("output_tokens", F.lit(0)),
            "cache_read": read,
            "cache_write": F.coalesce("cache_creation_tokens", "provider_creation_tokens", F.lit(0)),
        }
    )


def cost(steps: DataFrame) -> DataFrame:
    """Steps (model and the four counts) with their cost."""
    total = F.col("fresh_input") * F.col("p_input") + F.col("output") * F.col("p_output") + F.col("cache_read") * F.col("p_read") + F.col("cache_write") * F.col("p_write")
    return with_model(steps).withColumn("cost", total / 1e6)


def totals(steps: DataFrame, *keys: str) -> DataFrame:
    """Sums, cache hit rate, cost without a cache and what the cache saved."""
    whole = (F.col("fresh_input") + F.col("cache_read") + F.col("cache_write")) * F.col("p_input") + F.col("output") * F.col("p_output")
    sums = cost(steps).withColumn("baseline", whole / 1e6).groupBy(*keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("fresh_input", "output", "cache_read", "cache_write")), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("baseline"), F.lit(0.0)).alias("baseline"), F.count("*").alias("steps"))
    rate = F.coalesce(F.try_divide("cache_read", F.col("fresh_input") + F.col("cache_read") + F.col("cache_write")), F.lit(0.0))
    return sums.withColumn("hit_rate", rate).withColumn("saved", F.col("baseline") - F.col("cost"))


def recent(steps: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The last ``n`` steps."""
    return steps.orderBy(F.desc(order)).limit(n)


def text_tokens(text: Column) -> Column:
    """Estimate with the weights at hand (w_cjk, w_ascii, w_other)."""
    return token_estimate(text, F.col("w_cjk"), F.col("w_ascii"), F.col("w_other"))


def message_tokens(messages: DataFrame) -> DataFrame:
    """(conv_id, tokens): estimates of the texts and the overhead of each message.  ``messages``: conv_id, model, text."""
    return with_model(messages).groupBy("conv_id").agg(F.sum(F.col("w_message").cast("long") + text_tokens(F.col("text"))).alias("tokens"))


def thresholds(models: DataFrame, override: int | None = WINDOW_OVERRIDE) -> DataFrame:
    """Window, and from which token counts on to compact, and below which not to.  ``models``: model."""
    window = F.lit(override).cast("long") if override is not None else F.col("window")
    share = lambda s: F.floor(F.col("window_tokens") * F.lit(s).cast("decimal(4,2)")).cast("long")
    return with_model(models).withColumn("window_tokens", window).select("model", "window_tokens", share(TRIGGER).alias("trigger_tokens"), share(FLOOR).alias("floor_tokens"))


def rough_tokens(chars: Column, tool_parts: Column | int = 0) -> Column:
    """Alternative estimate: 3.5 characters a token, 80 more characters for each tool part."""
    return F.ceil((chars + 80 * (F.lit(tool_parts) if isinstance(tool_parts, int) else tool_parts)) * 2 / 7).cast("long")


def budget_stop(steps: DataFrame, budget: int = TURN_BUDGET, warn: float = TURN_WARNING) -> DataFrame:
    """Running tokens of each turn, whether the step warns, and whether it is the one that stops.

    ``steps``: turn_id, seq, tokens.
    """
    sofar = Window.partitionBy("turn_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("used", F.sum("tokens").over(sofar))
    over = F.col("used") > budget
    return run.withColumn("warned", F.col("used") > budget * warn).withColumn("stops", over & (F.col("used") - F.col("tokens") <= budget))


def pending_estimate(log: DataFrame, alarm: float = 0.75, window: int = WINDOW_OVERRIDE) -> DataFrame:
    """Last precise count plus a quarter of the characters since.

    ``log``: conv_id, seq, precise (null: none), chars.
    """
    upto = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    island = log.withColumn("island", F.count("precise").over(upto))
    within = Window.partitionBy("conv_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce(F.max("precise").over(within), F.lit(0))
    pending = F.sum(F.when(F.col("precise").isNull(), F.col("chars")).otherwise(0)).over(within)
    tokens = (base + F.ceil(pending / 4)).cast("long")
    return island.withColumn("tokens", tokens).withColumn("alarm", tokens >= alarm * window).drop("island")
