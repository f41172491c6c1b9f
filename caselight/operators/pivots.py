"""Rollups, pivots with totals, cohorts, histograms, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight.functions.text import rounded, text_of

from .signals import is_serious

#: Confidences are summed as decimals, so the order of summing decides nothing.
EXACT = "decimal(18,6)"


def medicine_rollup(cases: DataFrame, values: tuple[str, ...] = ("reaction", "gender", "age_band", "weight_band")) -> DataFrame:
    """Metrics of each medicine and its most frequent values. The rows are grouped once, by all values; all else
    is made of these sums, whose exchange is read twice."""
    sums = cases.groupBy("medicine", *values).agg(F.count("*").alias("n"), F.min("case_key").alias("seen"), F.count_if(is_serious()).alias("serious"), F.sum("score").alias("score"), F.sum(F.col("confidence").cast(EXACT)).alias("sure"))
    n = F.sum("n").cast("double")
    base = sums.groupBy("medicine").agg(F.sum("n").alias("reports"), rounded(100.0 * F.sum("serious") / n, 1).alias("serious_percent"), rounded(F.sum("score") / n, 2).alias("avg_score"), rounded(F.sum("sure").cast("double") / n, 4).alias("avg_confidence"))
    long = sums.select("medicine", "n", "seen", F.inline(F.array(*[F.struct(F.lit(v).alias("dimension"), F.col(v).alias("value")) for v in values])))
    counts = long.groupBy("medicine", "dimension", "value").agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    first = lambda v: F.max_by(F.when(F.col("dimension") == v, F.col("value")), F.when(F.col("dimension") == v, F.struct("n", (-F.col("seen")).alias("s")))).alias(f"top_{v}")
    return base.join(counts.groupBy("medicine").agg(*[first(v) for v in values]), "medicine")


CUBE = ("medicine", "reaction", "gender", "age_band", "weight_band", "seriousness")


def cells(cases: DataFrame) -> DataFrame:
    return cases.groupBy(*CUBE).agg(F.count("*").alias("reports"), F.count_if(is_serious()).alias("serious"), F.sum("score").alias("score_sum"), rounded(F.sum("confidence"), 2).alias("confidence_sum"))


def pivot_long(table: DataFrame, row: str, column: str) -> DataFrame:
    """Any two dimensions of :func:`cells`, with count, serious rate and weighted averages."""
    return table.groupBy(F.col(row).alias("row_value"), F.col(column).alias("column_value")).agg(F.sum("reports").alias("reports"), rounded(F.sum("serious") / F.sum("reports").cast("double"), 4).alias("serious_rate"), rounded(F.sum("score_sum") / F.sum("reports").cast("double"), 3).alias("avg_score"))


def pivot_wide(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with a column for each listed value; the list is given, so no job looks for it."""
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def pivot_totals(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Counts with row, column and grand totals, from grouping sets."""
    return rows.cube(row, column).agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select(F.when(F.col("level").isin(2, 3), "Total").otherwise(F.col(row)).alias("row_value"), F.when(F.col("level").isin(1, 3), "Total").otherwise(F.col(column)).alias("column_value"), "n")


def any_by_any(rows: DataFrame, dimensions: tuple[str, ...], serious: Column) -> DataFrame:
    """``row_dimension, column_dimension, row_value, column_value`` and four metrics, for every two of the
    ``dimensions``: reports, percent serious, mean score and mean confidence. Rows are summed by all dimensions
    first, so pairs are made of the sums alone."""
    base = rows.groupBy(*dimensions).agg(F.count("*").alias("n"), F.count_if(serious).alias("serious"), F.sum("score").alias("score"), F.sum(F.col("confidence").cast(EXACT)).alias("sure"))
    pairs = [F.struct(F.lit(a).alias("row_dimension"), F.lit(b).alias("column_dimension"), F.col(a).alias("row_value"), F.col(b).alias("column_value")) for k, a in enumerate(dimensions) for b in dimensions[k + 1 :]]
    long = base.select(F.explode(F.array(*pairs)).alias("p"), "n", "serious", "score", "sure")
    g = long.groupBy("p").agg(*[F.sum(c).alias(c) for c in ("n", "serious", "score", "sure")])
    n = F.col("n").cast("double")
    return g.select("p.*", F.col("n").alias("reports"), rounded(100.0 * F.col("serious") / n, 1).alias("serious_percent"), rounded(F.col("score") / n, 2).alias("avg_score"), rounded(F.col("sure").cast("double") / n, 4).alias("avg_confidence"))


def presence(rows: DataFrame, fields: list[str], centre: str = "centre", first: int = 5) -> DataFrame:
    """Share of rows per centre (the first few by name) that have each field."""
    chosen = rows.select(centre).distinct().orderBy(centre).limit(first)
    kept = rows.join(F.broadcast(chosen), centre, "left_semi")  # at most ``first`` rows
    wide = kept.groupBy(centre).agg(*[rounded(100.0 * F.avg(F.when(text_of(f) != "", 1.0).otherwise(0.0)), 1).alias(f) for f in fields])
    return wide.select(centre, F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', `{f}`" for f in fields) + ") AS (field, percent)"))


def cohort(rows: DataFrame, medicine: str, dimensions: tuple[str, ...] = ("gender", "age_band", "weight_band")) -> DataFrame:
    return _dimensions(rows.where(F.col("medicine") == medicine), dimensions)


def cohort_of(rows: DataFrame, chosen: DataFrame, dimensions: tuple[str, ...] = ("gender", "age_band", "weight_band")) -> DataFrame:
    """The cohort of the medicine in the one row of ``chosen``."""
    return _dimensions(rows.join(F.broadcast(chosen), "medicine", "left_semi"), dimensions)


def _dimensions(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    long = rows.select(F.expr(f"stack({len(dimensions)}, " + ", ".join(f"'{d}', {d}" for d in dimensions) + ") AS (dimension, value)"))
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """All bins, empty ones too."""
    counts = rows.select(value.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def latency(events: DataFrame, route: str, at: str, value: str, last: int = 100) -> DataFrame:
    """Mean and percentiles of the newest ``last`` samples a route. The window's limit is pushed
    into the tasks, so a busy route ships ``last`` rows from each."""
    rank = F.row_number().over(Window.partitionBy(route).orderBy(F.desc(at), F.desc("event_id")))
    recent = events.withColumn("_rank", rank).where(F.col("_rank") <= last)
    g = recent.groupBy(route).agg(F.count("*").alias("samples"), rounded(F.avg(value), 3).alias("mean"), F.array_sort(F.collect_list(value)).alias("v"))
    at_share = lambda p: F.element_at("v", F.greatest(F.lit(1), F.floor(F.size("v") * p)).cast("int"))
    return g.select(route, "samples", "mean", at_share(0.5).alias("p50"), at_share(0.95).alias("p95"), at_share(0.99).alias("p99"))


def confidence_stats(cases: DataFrame) -> DataFrame:
    return cases.agg(rounded(F.avg("confidence"), 4).alias("confidence"), rounded(F.avg("parser_confidence"), 4).alias("parser"), rounded(F.avg("trace_share"), 4).alias("trace"), F.count_if(F.col("confidence") < 0.65).alias("low"))


def most_frequent(rows: DataFrame, row: str, rows_kept: int, column: str, columns_kept: int) -> DataFrame:
    """Counts of the pairs of the most frequent values of two columns, ties by value. The pairs are
    counted once; both lists come from their counts."""
    counts = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    top = lambda c, k: counts.groupBy(c).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), c).limit(k).select(c)
    # two lists of so many values
    return counts.join(F.broadcast(top(row, rows_kept)), row, "left_semi").join(F.broadcast(top(column, columns_kept)), column, "left_semi").select(row, column, "n")
