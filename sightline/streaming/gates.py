"""Readiness, error and performance state, over batch or streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def visual(event_type: Column, noise: tuple[str, ...]) -> Column:
    return ~event_type.isin(*noise)


def quiet_periods(events: DataFrame, key: str, time_col: str, gap: str, late: str | None = None) -> DataFrame:
    """Bursts of events that a pause of `gap` ends; with `late`, a watermark lets a stream append finished ones."""
    rows = events.withWatermark(time_col, late) if late else events
    burst = rows.groupBy(key, F.session_window(time_col, gap).alias("burst")).agg(F.count("*").alias("n"))
    return burst.select(key, F.col("burst.start").alias("started"), F.col("burst.end").alias("ready"), "n")


def quality(waited_ms: Column, stable_ms: int = 500, timeout_ms: int = 1000) -> Column:
    """How a page's readiness was reached: within one quiet window, before the hard timeout, or by it."""
    return F.when(waited_ms <= stable_ms, "OPTIMAL").when(waited_ms < timeout_ms, "STABLE").otherwise("DEGRADED")


def error_counts(errors: DataFrame, code: Column, message: Column, time_col: str) -> DataFrame:
    """Errors by code and message with count, first and last time; as a stream its state is one row per key."""
    return errors.groupBy(F.concat_ws(":", code, message).alias("key")).agg(F.count("*").alias("n"), F.min(time_col).alias("first_seen"), F.max(time_col).alias("last_seen"))


def nearest_rank(sorted_values: Column, p: float) -> Column:
    n = F.size(sorted_values)
    return F.get(sorted_values, F.greatest(F.ceil(n * p).cast("int"), F.lit(1)) - 1)


def performance(samples: DataFrame, key: str, value: str, order: str, last: int = 100) -> DataFrame:
    """All-time count, sum and extremes by key; nearest-rank percentiles and the spread around the all-time mean of the last samples.

    The newest samples are picked by a top-k window, so no more than `last` of a key are ever gathered.
    """
    whole = samples.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    recent = samples.withColumn("__place", place).filter(F.col("__place") <= last).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("__xs"))
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.aggregate("__xs", F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / F.size("__xs"))
    return whole.join(recent, key).select(key, "n", "total", "least", "most", spread.alias("spread"), *[nearest_rank(F.col("__xs"), p).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)])


def compare_arrivals(arrivals: DataFrame, compare, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs compare(batch, epoch) for each micro-batch of arriving reports."""
    writer = arrivals.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
