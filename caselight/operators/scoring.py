"""Completeness, confidence, routing, review priority, guideline previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.text import rounded, text_of

# Mandatory fields and their labels, penalties and thresholds, weights of severity.
MANDATORY = (("initials", "Patient initials"), ("age", "Patient age"), ("reaction", "Adverse reaction"), ("medicine", "Suspected medication"), ("contact", "Reporter contact"))
FIELD_PENALTY, CONFIDENCE_PENALTY = 14, 12
LOW_CONFIDENCE, REVIEW_BELOW = 0.6, 0.65
SEVERITY_WEIGHT = {"death": 1.0, "disability": 0.85, "hospitalisation": 0.7, "others": 0.3}


def _present(c: str) -> Column:
    return text_of(c) != ""


def completeness(rows: DataFrame) -> DataFrame:
    """``missing_fields`` (ordered), ``score`` and ``route`` from the mandatory fields and
    ``confidence``."""
    missing = F.filter(F.array(*[F.when(~_present(c), F.lit(label)) for c, label in MANDATORY]), lambda x: x.isNotNull())
    rows = rows.withColumn("missing_fields", missing)
    n = F.size("missing_fields")
    score = F.greatest(F.lit(0), 100 - FIELD_PENALTY * n - F.when(F.col("confidence") < LOW_CONFIDENCE, CONFIDENCE_PENALTY).otherwise(0)).cast("int")
    route = F.when(n > 0, "needs_followup").when(F.col("confidence") < REVIEW_BELOW, "manual_review").otherwise("ready_for_processing")
    return rows.withColumn("score", score).withColumn("route_name", route)


def confidence(coverage: Column, parser: Column, trace: Column) -> Column:
    return rounded(0.45 * coverage + 0.35 * parser + 0.20 * trace, 2)


def synthetic_score(coverage: Column, narrative: Column) -> Column:
    """The generator's variant: narratives under 80 characters parse worse."""
    return rounded(coverage * 0.55 + F.when(F.length(narrative) < 80, 0.55).otherwise(0.72) * 0.45, 2)


def severity_of_label() -> Column:
    s = F.col("seriousness")
    return F.when(s.isin("Death", "Life-threatening", "Fatal"), "death").when(s.isin("Disability/incapacity", "Congenital anomaly"), "disability").when(s.contains("ospitalisation"), "hospitalisation").otherwise("others")


def priority(cases: DataFrame) -> DataFrame:
    """Score, tier and ordered reasons; ``relation`` as linkage gives it."""
    weight = F.when(F.lit(False), 0.0)
    for name, w in SEVERITY_WEIGHT.items():
        weight = weight.when(F.col("severity") == name, w)
    rows = cases.withColumn("severity", severity_of_label())
    score = rounded(weight.otherwise(0.3) * 0.60 + F.least(F.col("n_missing") / 5.0, F.lit(1.0)) * 0.25 + (F.lit(1.0) - F.col("confidence")) * 0.15, 3)
    rows = rows.withColumn("priority_score", score)
    tier = F.when(F.col("priority_score") >= 0.75, "urgent").when(F.col("priority_score") >= 0.5, "high").when(F.col("priority_score") >= 0.3, "normal").otherwise("low")
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("severity") == "death", "fatal or life-threatening").when(F.col("severity") == "disability", "disability").when(F.col("severity") == "hospitalisation", "hospitalisation"),
        F.when(F.col("n_missing") > 0, F.concat(F.col("n_missing").cast("string"), F.lit(" mandatory missing"))),
        F.when(F.col("confidence") < REVIEW_BELOW, F.concat(F.lit("confidence "), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%"))),
        F.when(F.col("relation").isin("duplicate", "followup"), "possible duplicate or follow-up"),
    )
    return rows.withColumn("tier", tier).withColumn("reasons", F.when(reasons == "", "routine review").otherwise(reasons))


def tiers(queue: DataFrame) -> DataFrame:
    return queue.groupBy("tier").agg(F.count("*").alias("n"))


def field_report(rows: DataFrame, fields: list[tuple[str, str, bool]]) -> DataFrame:
    """Of each field (column, label, mandatory) how many rows have it: one pass, then unpivoted."""
    counts = rows.agg(F.count("*").alias("_n"), *[F.count_if(_present(c)).alias(c) for c, _, _ in fields])
    cells = ", ".join(f"'{label}', {str(mandatory).lower()}, `{c}`, _n" for c, label, mandatory in fields)
    return counts.select(F.expr(f"stack({len(fields)}, {cells}) AS (field, mandatory, present, total)"))


# The fields of a completeness report: column, label, mandatory, section.
REPORTED = (
    ("initials", "Patient initials", True, "Patient"), ("age", "Patient age", True, "Patient"), ("gender", "Patient gender", False, "Patient"), ("weight", "Patient weight (kg)", False, "Patient"),
    ("reaction", "Adverse reaction", True, "Clinical"), ("medicine", "Suspected medication", True, "Clinical"), ("onset", "Reaction onset date", False, "Clinical"), ("dose", "Dose", False, "Clinical"),
    ("route", "Route", False, "Clinical"), ("seriousness", "Seriousness", False, "Clinical"), ("outcome", "Outcome", False, "Clinical"), ("reporter", "Reporter name", True, "Reporter"),
    ("email", "Reporter email", False, "Reporter"), ("phone", "Reporter phone", False, "Reporter"),
)


def completeness_report(fields: DataFrame) -> DataFrame:
    """``doc_id, fields`` (label, value, mandatory, present, section), the number of mandatory and optional
    ones that are present and in all, and of findings of personal data, for extracted documents. A reporter
    is present by name, email or phone."""
    from .identifiers import found

    any_reporter = reduce(lambda a, c: a | (text_of(c) != ""), ("email", "phone"), text_of("reporter") != "")
    cells = [F.struct(F.lit(label).alias("label"), text_of(c).alias("value"), F.lit(must).alias("mandatory"), (any_reporter if c == "reporter" else text_of(c) != "").alias("present"), F.lit(section).alias("section")) for c, label, must, section in REPORTED]
    rows = fields.select("doc_id", F.array(*cells).alias("fields"), F.size(found(structured=True)).alias("findings"))
    count = lambda f: F.size(F.filter("fields", f))
    return rows.select(
        "doc_id", "fields", count(lambda x: x["mandatory"] & x["present"]).alias("mandatory_present"), count(lambda x: x["mandatory"]).alias("mandatory_total"),
        count(lambda x: ~x["mandatory"] & x["present"]).alias("optional_present"), count(lambda x: ~x["mandatory"]).alias("optional_total"), "findings",
    )


#: A guideline's mandatory rules at most.
MOST_RULES = 1000


def guideline_scores(rows: DataFrame, rules: DataFrame, threshold: float = REVIEW_BELOW, penalty: int = CONFIDENCE_PENALTY) -> DataFrame:
    """Score under a guideline's rules ``(field, weight, mandatory)`` and its difference to the
    stored score. Rules become one expression; more than ``MOST_RULES`` of them are an error."""
    chosen = [(r["field"], r["weight"]) for r in rules.where("mandatory").select("field", "weight").take(MOST_RULES + 1)]
    if len(chosen) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} mandatory rules")
    lost = sum((F.when(~_present(f), w).otherwise(0) for f, w in chosen), F.lit(0))
    score = F.greatest(F.lit(0), 100 - lost - F.when(F.col("confidence") < threshold, penalty).otherwise(0)).cast("int")
    return rows.withColumn("preview", score).withColumn("delta", F.col("preview") - F.col("score"))


def reviewer_flag() -> Column:
    cannot = (F.col("status") == "needs_ocr") | (F.col("score") < 30) | (F.col("confidence") < 0.25)
    follow = F.col("status").isin("needs_followup", "manual_review") | (F.col("n_missing") > 0) | (F.col("score") < 70)
    return F.when(cannot, "cannot-compute").when(follow, "follow-up").otherwise("ready")


def overview(cases: DataFrame) -> DataFrame:
    """One row of counts; with a column ``relation``, also of duplicates and follow-ups."""
    flag = reviewer_flag()
    linked = [F.count_if(F.col("relation") == k).alias(n) for k, n in (("duplicate", "duplicates"), ("followup", "follow_up_reports"))] if "relation" in cases.columns else []
    return cases.agg(*linked, F.count("*").alias("reports"), F.count_if(flag == "ready").alias("ready"), F.count_if(flag == "follow-up").alias("follow_up"), F.count_if(flag == "cannot-compute").alias("cannot_compute"), F.floor(F.avg("score") + 0.5).cast("int").alias("average_score"))
