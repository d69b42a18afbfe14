"""Counters, gauges, histograms and their text format, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import in_ranges

# Default bounds of a latency histogram, in seconds.
BOUNDS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(values: DataFrame, column: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(le, cumulative count) for each bound and +Inf (null): one pass, conditional sums."""
    bounds = tuple(sorted(bounds))
    row = values.agg(*(F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(column).alias("b"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("b").alias("cum")))
    return row.select(F.inline(F.array(*cells)))


def histogram_totals(values: DataFrame, column: str) -> DataFrame:
    """One row: the sum and the count that stand beside a histogram's buckets."""
    return values.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("sum"), F.count(column).alias("count"))


def counters(events: DataFrame, name: str, amount: Column) -> DataFrame:
    return events.groupBy(F.col(name).alias("name")).agg(F.sum(amount).alias("value"))


def gauges(events: DataFrame, name: str, value: str, at: str) -> DataFrame:
    """The last value of each name."""
    return events.groupBy(F.col(name).alias("name")).agg(F.max_by(value, at).alias("value"))


def percentile_exclusive(values: DataFrame, column: str, percents: tuple[int, ...]) -> DataFrame:
    """(percent, value) by the exclusive rank p (n + 1) / 100, clamped, with linear interpolation.

    Values are counted first; ranks run over the distinct values, which lie in sorted ranges."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts, starts = in_ranges(counts, "v", F.col("n"))
    total = counts.agg(F.sum("n").alias("total"))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("v"))
    ranked = counts.withColumn("hi", upto).join(F.broadcast(starts), "_part").withColumn("hi", F.col("hi") + F.col("_start")).withColumn("lo", F.col("hi") - F.col("n") + 1)
    want = total.select("total", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    want = want.withColumn("r", F.least(F.greatest(F.col("percent") * (F.col("total") + 1) / 100.0, F.lit(1.0)), F.col("total").cast("double")))
    want = want.withColumns({"a": F.floor("r"), "b": F.ceil("r")})
    at = ranked.join(F.broadcast(want), ((F.col("a") >= F.col("lo")) & (F.col("a") <= F.col("hi"))) | ((F.col("b") >= F.col("lo")) & (F.col("b") <= F.col("hi"))))
    ends = at.groupBy("percent", "r", "a").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return ends.select("percent", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("r") - F.col("a"))).alias("value"))


def number_text(v: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def exposition(metrics: DataFrame) -> DataFrame:
    """metrics (name, help, type, labels or null, value) -> (name, text): the text format's block of each metric."""
    line = F.concat("name", F.coalesce(F.concat(F.lit("{"), "labels", F.lit("}")), F.lit("")), F.lit(" "), number_text(F.col("value")))
    blocks = metrics.groupBy("name", "help", "type").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "type", F.lit("\n"))
    return blocks.select("name", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))
