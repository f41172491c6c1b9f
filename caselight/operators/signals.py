"""Drug-event signals: pair counts, 2x2 tables, disproportionality, priorities, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.text import rounded

# Labels that count as serious, and thresholds.
SERIOUS = ("Death", "Life-threatening", "Hospitalisation", "Disability/incapacity", "Congenital anomaly", "Other medically important")
MIN_PRR, MIN_REPORTS = 2.0, 3


def is_serious(label: str = "seriousness") -> Column:
    return F.col(label).isin(*SERIOUS)


def predicted_serious() -> Column:
    """By label, fatal outcome, or a complete report."""
    return is_serious() | (F.col("outcome") == "Fatal") | (F.col("score") >= 85)


def predicted_ready() -> Column:
    return (F.col("n_missing") == 0) & (F.col("confidence") >= 0.65)


def pairs(cases: DataFrame) -> DataFrame:
    return cases.groupBy("medicine", "reaction").agg(F.count("*").alias("reports"), F.count_if(is_serious()).alias("serious"), F.avg("confidence").alias("avg_confidence"), F.avg("score").alias("avg_score"))


def contingency(cases: DataFrame) -> DataFrame:
    """``a, b, c, d`` of each pair. The pair counts are the only aggregate of the input; margins
    and total are windows and sums of it."""
    from pyspark.sql.window import Window

    counts = pairs(cases)
    n_m = F.sum("reports").over(Window.partitionBy("medicine"))
    n_r = F.sum("reports").over(Window.partitionBy("reaction"))
    total = cases.agg(F.count("*").alias("total"))
    a = F.col("reports")
    return counts.withColumn("n_m", n_m).withColumn("n_r", n_r).crossJoin(F.broadcast(total)).select(
        "medicine", "reaction", "reports", "serious", "avg_confidence", "avg_score", "total", a.alias("a"), (F.col("n_m") - a).alias("b"), (F.col("n_r") - a).alias("c"), (F.col("total") - F.col("n_m") - F.col("n_r") + a).alias("d")
    )


def disproportionality(cases: DataFrame) -> DataFrame:
    """PRR and ROR to two digits, IC to three, and the signal flag from the rounded PRR."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    t = contingency(cases)
    t = t.withColumn("prr", F.when(F.col("c") == 0, 0.0).otherwise(rounded((a / (a + b)) / (c / F.greatest(c + d, F.lit(1.0))), 2)))
    t = t.withColumn("ror", F.when((F.col("b") == 0) | (F.col("c") == 0), F.lit(None).cast("double")).otherwise(rounded(F.try_divide(a * d, b * c), 2)))
    t = t.withColumn("ic", rounded(F.log2(a * F.col("total") / ((a + b) * (a + c))), 3))
    return t.withColumn("is_signal", (F.col("prr") >= MIN_PRR) & (F.col("a") >= MIN_REPORTS))


def top_signals(cases: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` best by prevalence, seriousness and confidence, with a priority label."""
    share = F.col("reports") / F.greatest(F.col("total"), F.lit(1)).cast("double")
    score = rounded(0.45 * share + 0.35 * (F.col("serious") / F.col("reports").cast("double")) + 0.20 * rounded(F.col("avg_confidence"), 4), 2)
    t = disproportionality(cases).withColumn("signal_score", score)
    label = F.when(F.col("signal_score") >= 0.7, "high").when(F.col("signal_score") >= 0.45, "medium").otherwise("low")
    return t.withColumn("priority", label).orderBy(F.desc("signal_score"), F.desc("reports"), "medicine", "reaction").limit(k)


def dataset_stats(cases: DataFrame) -> DataFrame:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return cases.agg(F.count("*").alias("reports"), F.count_distinct(blank("medicine")).alias("medicines"), F.count_distinct(blank("reaction")).alias("reactions"))


def insights(cases: DataFrame) -> DataFrame:
    """Three rows: best signal, share of low confidence, share with missing fields."""
    best = top_signals(cases, 1).select(F.lit("top-signal").alias("insight"), F.concat("medicine", F.lit(" / "), "reaction").alias("detail"), F.col("signal_score").alias("value"))
    share = lambda c: rounded(F.avg(F.when(c, 1.0).otherwise(0.0)), 3)
    shares = cases.agg(share(F.col("confidence") < 0.65).alias("low"), share(F.col("n_missing") > 0).alias("missing"))
    rest = shares.select(F.expr("stack(2, 'low-confidence', '', low, 'missing-fields', '', missing) AS (insight, detail, value)"))
    return best.unionByName(rest)


def prediction_basis(cases: DataFrame) -> DataFrame:
    """Why a report was predicted as it was, with the number of its anchor's other reports."""
    from pyspark.sql.window import Window

    others = F.count("*").over(Window.partitionBy("patient_token", "medicine", "reaction")) - 1
    parts = [F.concat(F.lit("seriousness "), "seriousness"), F.when(F.col("score") >= 85, "score at least 85"), F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" missing"))), F.when(F.col("others") > 0, F.concat(F.col("others").cast("string"), F.lit(" duplicate candidates")))]
    return cases.withColumn("others", others).select("case_key", predicted_serious().alias("serious"), predicted_ready().alias("ready"), (F.col("others") > 0).alias("duplicate"), F.concat_ws("; ", *parts).alias("basis"))


def monthly(cases: DataFrame) -> DataFrame:
    return cases.groupBy(F.date_format("created_at", "yyyy-MM").alias("month"), "medicine", "reaction").agg(F.count("*").alias("reports"), F.count_if(is_serious()).alias("serious"), rounded(F.avg("confidence"), 4).alias("avg_confidence"))


def relations(cases: DataFrame, k: int = 50) -> DataFrame:
    """Pairs by serious reports, then reports, with deaths."""
    t = cases.groupBy("medicine", "reaction").agg(F.count("*").alias("reports"), F.count_if(is_serious()).alias("serious"), F.count_if((F.col("seriousness") == "Death") | (F.col("outcome") == "Fatal")).alias("deaths"))
    return t.orderBy(F.desc("serious"), F.desc("reports"), "medicine", "reaction").limit(k)
