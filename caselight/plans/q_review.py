"""Queries over the case table: scoring, review, pivots, paging, evaluation; and over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.functions import banding
from caselight.operators import anchors, evaluation, linkage, paging, pivots, scoring
from caselight.session import held, once

from .cases import cases, d, r, sql, table
from .q_cases import _REL, SERIOUS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return put


SEVERITY = "CASE seriousness WHEN 'Death' THEN 'death' WHEN 'Disability/incapacity' THEN 'disability' WHEN 'Hospitalisation' THEN 'hospitalisation' ELSE 'others' END"


@query("completeness", sql("""SELECT case_key, concat_ws('|', CASE WHEN age = '' THEN 'Patient age' END, CASE WHEN contact = '' THEN 'Reporter contact' END) AS missing, score, status AS route_name FROM cases"""))
def completeness(spark, sf):
    rows = cases(spark, sf).withColumn("initials", F.lit("A.B."))
    return scoring.completeness(rows).select("case_key", F.array_join("missing_fields", "|").alias("missing"), "score", "route_name")


@query("confidence", sql("SELECT case_key, confidence FROM cases"))
def confidence(spark, sf):
    c = cases(spark, sf)
    return c.select("case_key", scoring.confidence(F.lit(1.0) - F.col("n_missing") / 5.0, F.col("parser_confidence"), F.col("trace_share")).alias("confidence"))


@query("synthetic_score", sql(f"SELECT case_key, {r(f'(({d(1)} - n_missing / {d(5)}) * {d(0.55)} + CASE WHEN length(narrative) < 80 THEN {d(0.55)} ELSE {d(0.72)} END * {d(0.45)})', 2)} AS confidence FROM cases"))
def synthetic_score(spark, sf):
    return cases(spark, sf).select("case_key", scoring.synthetic_score(F.lit(1.0) - F.col("n_missing") / 5.0, F.col("narrative")).alias("confidence"))


_QUEUE = _REL + f""", sev AS (SELECT *, {SEVERITY} AS severity FROM cases JOIN rel USING (case_key)),
pri AS (SELECT *, {r(f"(CASE severity WHEN 'death' THEN {d(1.0)} WHEN 'disability' THEN {d(0.85)} WHEN 'hospitalisation' THEN {d(0.7)} ELSE {d(0.3)} END * {d(0.6)} + least(n_missing / {d(5)}, {d(1)}) * {d(0.25)} + ({d(1)} - confidence) * {d(0.15)})", 3)} AS priority_score FROM sev),
queue AS (SELECT case_key, priority_score, CASE WHEN priority_score >= 0.75 THEN 'urgent' WHEN priority_score >= 0.5 THEN 'high' WHEN priority_score >= 0.3 THEN 'normal' ELSE 'low' END AS tier,
concat_ws('; ', CASE severity WHEN 'death' THEN 'fatal or life-threatening' WHEN 'disability' THEN 'disability' WHEN 'hospitalisation' THEN 'hospitalisation' END, CASE WHEN n_missing > 0 THEN n_missing || ' mandatory missing' END,
CASE WHEN confidence < 0.65 THEN 'confidence ' || CAST(floor(confidence * {d(100)} + {d(0.5)}) AS BIGINT) || '%' END, CASE WHEN relation IN ('duplicate', 'followup') THEN 'possible duplicate or follow-up' END) AS why FROM pri)
"""


def _queue(spark, sf):
    c = cases(spark, sf)
    return scoring.priority(c.join(linkage.relations(c).select("case_key", "relation"), "case_key"))


@query("priority_queue", sql(_QUEUE + "SELECT case_key, priority_score, tier, CASE WHEN why = '' THEN 'routine review' ELSE why END AS reasons FROM queue "))
def priority_queue(spark, sf):
    return _queue(spark, sf).select("case_key", "priority_score", "tier", "reasons")


@query("priority_tiers", sql(_QUEUE + "SELECT tier, count(*) AS n FROM queue GROUP BY 1"))
def priority_tiers(spark, sf):
    return scoring.tiers(_queue(spark, sf))


_REPORTED = [("age", "Patient age", True), ("contact", "Reporter contact", True), ("medicine", "Suspected medication", True), ("gender", "Patient gender", False), ("dose", "Dose", False)]


@query("field_report", sql(" UNION ALL ".join(f"SELECT '{label}' AS field, {str(m).lower()} AS mandatory, count(*) FILTER (WHERE {c} <> '') AS present, count(*) AS total FROM cases" for c, label, m in _REPORTED)))
def field_report(spark, sf):
    return scoring.field_report(cases(spark, sf), _REPORTED)


@query("guideline_preview", sql("SELECT case_key, CAST(greatest(0, 100 - CASE WHEN age = '' THEN 20 ELSE 0 END - CASE WHEN contact = '' THEN 15 ELSE 0 END - CASE WHEN confidence < 0.65 THEN 12 ELSE 0 END) AS INTEGER) AS preview, CAST(greatest(0, 100 - CASE WHEN age = '' THEN 20 ELSE 0 END - CASE WHEN contact = '' THEN 15 ELSE 0 END - CASE WHEN confidence < 0.65 THEN 12 ELSE 0 END) AS INTEGER) - score AS delta FROM cases"))
def guideline_preview(spark, sf):
    rules = spark.sql("SELECT * FROM VALUES ('age', 20, true), ('contact', 15, true), ('medicine', 30, true), ('dose', 50, false) AS t(field, weight, mandatory)")
    return scoring.guideline_scores(cases(spark, sf), rules).select("case_key", "preview", "delta")


FLAG = "CASE WHEN score < 30 OR confidence < 0.25 THEN 'cannot-compute' WHEN status IN ('needs_followup', 'manual_review') OR n_missing > 0 OR score < 70 THEN 'follow-up' ELSE 'ready' END"


@query("reviewer_flags", sql(f"SELECT {FLAG} AS flag, {SEVERITY} AS severity, count(*) AS n FROM cases GROUP BY 1, 2"))
def reviewer_flags(spark, sf):
    return cases(spark, sf).groupBy(scoring.reviewer_flag().alias("flag"), scoring.severity_of_label().alias("severity")).agg(F.count("*").alias("n"))


@query("overview", sql(_REL + f"SELECT (SELECT count(*) FROM rel WHERE relation = 'duplicate') AS duplicates, (SELECT count(*) FROM rel WHERE relation = 'followup') AS follow_up_reports, count(*) AS reports, count(*) FILTER (WHERE {FLAG} = 'ready') AS ready, count(*) FILTER (WHERE {FLAG} = 'follow-up') AS follow_up, count(*) FILTER (WHERE {FLAG} = 'cannot-compute') AS cannot_compute, CAST(floor(avg(score) + {d(0.5)}) AS INTEGER) AS average_score FROM cases"))
def overview(spark, sf):
    c = cases(spark, sf)
    with held(anchors.points(c)) as rows:
        linked = anchors.labelled(rows, anchors.states(rows), anchors.hash_states(rows)).select("case_key", "relation")
        return once(scoring.overview(c.join(linked, "case_key")))


# --- pivots ---

_TOP = "".join(f", top_{v} AS (SELECT medicine, {v} AS top_{v} FROM (SELECT medicine, {v}, row_number() OVER (PARTITION BY medicine ORDER BY count(*) DESC, min(case_key)) AS n FROM cases GROUP BY medicine, {v}) WHERE n = 1)" for v in ("reaction", "gender", "age_band", "weight_band"))


@query("medicine_rollup", sql(_TOP + f"SELECT * FROM (SELECT medicine, count(*) AS reports, {r(f'({d(100)} * count(*) FILTER (WHERE seriousness IN {SERIOUS}) / count(*))', 1)} AS serious_percent, {r('avg(score)', 2)} AS avg_score, {r('(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*))', 4)} AS avg_confidence FROM cases GROUP BY 1) JOIN top_reaction USING (medicine) JOIN top_gender USING (medicine) JOIN top_age_band USING (medicine) JOIN top_weight_band USING (medicine)"))
def medicine_rollup(spark, sf):
    return pivots.medicine_rollup(cases(spark, sf))


@query("cube_cells", sql(f"SELECT {', '.join(pivots.CUBE)}, count(*) AS reports, count(*) FILTER (WHERE seriousness IN {SERIOUS}) AS serious, CAST(sum(score) AS BIGINT) AS score_sum, {r('sum(confidence)', 2)} AS confidence_sum FROM cases GROUP BY {', '.join(pivots.CUBE)}"))
def cube_cells(spark, sf):
    return pivots.cells(cases(spark, sf))


@query("pivot_long", sql(f"SELECT medicine AS row_value, age_band AS column_value, count(*) AS reports, {r(f'(count(*) FILTER (WHERE seriousness IN {SERIOUS}) / CAST(count(*) AS DOUBLE))', 4)} AS serious_rate, {r('(sum(score) / CAST(count(*) AS DOUBLE))', 3)} AS avg_score FROM cases GROUP BY 1, 2"))
def pivot_long(spark, sf):
    return pivots.pivot_long(pivots.cells(cases(spark, sf)), "medicine", "age_band")


_AGES = ["Under-18", "18-35", "36-55", "56-70", "70+", "Unknown"]


@query("pivot_age_gender", sql("SELECT gender, " + ", ".join(f"count(*) FILTER (WHERE age_band = '{a}') AS \"{a}\"" for a in _AGES) + " FROM cases GROUP BY 1"))
def pivot_age_gender(spark, sf):
    return pivots.pivot_wide(cases(spark, sf), "gender", "age_band", _AGES)


@query("pivot_totals", sql("SELECT CASE WHEN grouping(reaction) = 1 THEN 'Total' ELSE reaction END AS row_value, CASE WHEN grouping(outcome) = 1 THEN 'Total' ELSE outcome END AS column_value, count(*) AS n FROM cases GROUP BY CUBE (reaction, outcome)"))
def pivot_totals(spark, sf):
    return pivots.pivot_totals(cases(spark, sf), "reaction", "outcome")


@query("score_band_severity", sql(f"SELECT CASE WHEN score < 40 THEN '0-39' WHEN score < 70 THEN '40-69' WHEN score < 90 THEN '70-89' ELSE '90-100' END AS band, {SEVERITY} AS severity, count(*) AS n FROM cases GROUP BY 1, 2"))
def score_band_severity(spark, sf):
    return cases(spark, sf).groupBy(banding.score_band(F.col("score")).alias("band"), scoring.severity_of_label().alias("severity")).agg(F.count("*").alias("n"))


@query("presence_heatmap", sql(", c5 AS (SELECT DISTINCT centre FROM cases ORDER BY centre LIMIT 5) " + " UNION ALL ".join(f"SELECT centre, '{f}' AS field, {r(f'({d(100)} * avg(CASE WHEN {f} <> chr(0) AND length({f}) > 0 THEN {d(1)} ELSE {d(0)} END))', 1)} AS percent FROM cases JOIN c5 USING (centre) GROUP BY 1" for f in ("age", "contact", "dose"))))
def presence_heatmap(spark, sf):
    return pivots.presence(cases(spark, sf), ["age", "contact", "dose"])


@query("cohort", sql(" UNION ALL ".join(f"SELECT '{v}' AS dimension, {v} AS value, count(*) AS n FROM cases WHERE medicine = (SELECT min(medicine) FROM cases) GROUP BY 2" for v in ("gender", "age_band", "weight_band"))))
def cohort(spark, sf):
    rows = cases(spark, sf)
    return pivots.cohort_of(rows, rows.agg(F.min("medicine").alias("medicine")))


@query("score_hist", sql(f"SELECT CAST(bin AS INTEGER) AS bin, count(case_key) AS n FROM range(10) AS t(bin) LEFT JOIN (SELECT case_key, least(9, CAST(floor(score / {d(10)}) AS INTEGER)) AS b FROM cases) ON b = bin GROUP BY 1"))
def score_hist(spark, sf):
    return pivots.histogram(cases(spark, sf), banding.decile(F.col("score"), 10.0))


@query("confidence_stats", sql(f"SELECT {r('avg(confidence)', 4)} AS confidence, {r('avg(parser_confidence)', 4)} AS parser, {r('avg(trace_share)', 4)} AS trace, count(*) FILTER (WHERE confidence < 0.65) AS low FROM cases"))
def confidence_stats(spark, sf):
    return pivots.confidence_stats(cases(spark, sf))


@query("latency_percentiles", f"""SELECT event_type, count(*) AS samples, {r('avg(value)', 3)} AS mean, list_sort(list(value))[greatest(1, CAST(floor(count(*) * {d(0.5)}) AS INTEGER))] AS p50,
list_sort(list(value))[greatest(1, CAST(floor(count(*) * {d(0.95)}) AS INTEGER))] AS p95, list_sort(list(value))[greatest(1, CAST(floor(count(*) * {d(0.99)}) AS INTEGER))] AS p99
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100 GROUP BY 1""")
def latency_percentiles(spark, sf):
    return pivots.latency(table(spark, sf, "events"), "event_type", "ts", "value")


# --- paging, searches, set operations ---


@query("report_page", sql(", p AS (SELECT * FROM cases WHERE case_key < 1000 ORDER BY case_key DESC LIMIT 26), k AS (SELECT * FROM p ORDER BY case_key DESC LIMIT 25) SELECT case_key, status, (SELECT count(*) FROM p) > 25 AS has_more, CASE WHEN (SELECT count(*) FROM p) > 25 THEN (SELECT min(case_key) FROM k) END AS next_cursor FROM k"))
def report_page(spark, sf):
    return paging.page(cases(spark, sf).select("case_key", "status"), "case_key", 1000, 25)


@query("offset_page", sql("SELECT case_key, medicine FROM cases ORDER BY medicine, case_key LIMIT 10 OFFSET 40"))
def offset_page(spark, sf):
    return paging.offset_page(cases(spark, sf).select("case_key", "medicine"), ["medicine", "case_key"], 40, 10)


@query("scoped_reports", sql("SELECT case_key, uploader FROM cases WHERE uploader = 'BUILDING'"))
def scoped_reports(spark, sf):
    return paging.scoped(cases(spark, sf), "BUILDING", False).select("case_key", "uploader")


@query("record_search", sql(f"SELECT case_key FROM cases WHERE (contains(lower(medicine), 'brand#1') OR contains(lower(report_number), 'brand#1')) AND outcome = 'Recovering' AND {FLAG} = 'ready'"))
def record_search(spark, sf):
    rows = cases(spark, sf).withColumn("flag", scoring.reviewer_flag())
    return paging.search(rows, "Brand#1", ["medicine", "report_number"], outcome="Recovering", flag="ready").select("case_key")


@query("present_report", sql("SELECT report_number, medicine, reaction, score, CASE WHEN parser_confidence < 0.25 THEN 'needs_ocr' ELSE status END AS status, CASE WHEN uploader = 'BUILDING' THEN substr(source_hash, 1, 12) || '...restricted' END AS review_token FROM cases"))
def present_report(spark, sf):
    snap = F.array(F.struct(F.lit(0).alias("score"), F.lit("old").alias("route")), F.struct(F.col("score").alias("score"), F.col("status").alias("route")))
    rows = cases(spark, sf).withColumn("score_snapshots", snap).withColumn("needs_ocr", F.col("parser_confidence") < 0.25).withColumn("review_token", paging.masked(F.col("source_hash")))
    return paging.presented(rows, "member", "BUILDING")


@query("report_detail", sql("SELECT case_key, patient_token || '|Not displayed||' || age || '|' || gender || '|' || weight AS patient, 'Reporter token only' AS reporter, centre || '|' || uploader || '|new' AS pvpi, 1 AS medications, medicine || '|Suspected|' || dose || '|' || route || '|' || frequency AS medication, 1 AS reactions, reaction || '|' || onset || '|' || outcome || '|' || seriousness AS reaction FROM cases"))
def report_detail(spark, sf):
    """Parts of the nested view, flat again for comparison."""
    flat = lambda c, *names: F.concat_ws("|", *[F.col(c)[n] for n in names])
    rows = paging.detailed(cases(spark, sf)).withColumn("m", F.get("medications", F.lit(0))).withColumn("r", F.get("reactions", F.lit(0)))
    return rows.select(
        "case_key", flat("patient", "token", "name", "initials", "age", "sex", "weight").alias("patient"), F.col("reporter.name").alias("reporter"), flat("pvpi", "centre", "submitted_by", "lineage").alias("pvpi"),
        F.size("medications").alias("medications"), flat("m", "name", "role", "dose", "route", "frequency").alias("medication"), F.size("reactions").alias("reactions"), flat("r", "term", "onset", "outcome", "seriousness").alias("reaction"),
    )


@query("distinct_lists", sql("SELECT DISTINCT 'medicine' AS list, medicine AS value FROM cases UNION ALL SELECT DISTINCT 'centre', centre FROM cases"))
def distinct_lists(spark, sf):
    rows = cases(spark, sf)
    return rows.select(F.lit("medicine").alias("list"), F.col("medicine").alias("value")).distinct().unionByName(rows.select(F.lit("centre").alias("list"), F.col("centre").alias("value")).distinct())


# --- evaluation ---


@query("eval_binary", f"""SELECT tp, fp, fn, tn, {r('coalesce((tp + tn) / CAST(nullif(tp + fp + fn + tn, 0) AS DOUBLE), 0)', 3)} AS accuracy, {r('p', 3)} AS precision, {r('c', 3)} AS recall, {r('coalesce(2 * p * c / nullif(p + c, 0), 0)', 3)} AS f1 FROM (
SELECT *, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS p, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS c FROM (SELECT count(*) FILTER (WHERE t AND g) AS tp, count(*) FILTER (WHERE NOT t AND g) AS fp, count(*) FILTER (WHERE t AND NOT g) AS fn, count(*) FILTER (WHERE NOT t AND NOT g) AS tn
FROM (SELECT quality = 0 AS t, contains(text, '###') OR contains(text, ' | ') AS g FROM labels JOIN documents USING (doc_id))))""")
def eval_binary(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return evaluation.binary(rows, F.col("quality") == 0, F.col("text").contains("###") | F.col("text").contains(" | "))


_TRUTH = f"{SEVERITY}"
_GUESS = "CASE WHEN score >= 100 THEN 'others' WHEN outcome = 'Recovering' THEN 'hospitalisation' WHEN n_missing > 0 THEN 'disability' ELSE 'death' END"
_MATRIX = f", m AS (SELECT {_TRUTH} AS truth, {_GUESS} AS guess, count(*) AS n FROM cases GROUP BY 1, 2), cl AS (SELECT unnest(['death', 'disability', 'hospitalisation', 'others']) AS class) "


def _matrix(spark, sf):
    guess = F.when(F.col("score") >= 100, "others").when(F.col("outcome") == "Recovering", "hospitalisation").when(F.col("n_missing") > 0, "disability").otherwise("death")
    return evaluation.confusion(cases(spark, sf).select(scoring.severity_of_label().alias("truth"), guess.alias("guess")), "truth", "guess")


@query("eval_confusion", sql(_MATRIX + "SELECT a.class AS truth, b.class AS guess, coalesce(n, 0) AS n FROM cl a CROSS JOIN cl b LEFT JOIN m ON truth = a.class AND guess = b.class"))
def eval_confusion(spark, sf):
    return _matrix(spark, sf)


@query("eval_multiclass", sql(_MATRIX + f"""SELECT *, {r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)', 3)} AS f1, tp + fn AS support FROM (SELECT class, tp, fp, fn, {r('coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)', 3)} AS precision, {r('coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)', 3)} AS recall FROM (
SELECT class, CAST(coalesce(sum(n) FILTER (WHERE truth = class AND guess = class), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (WHERE truth <> class AND guess = class), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (WHERE truth = class AND guess <> class), 0) AS BIGINT) AS fn FROM cl CROSS JOIN m GROUP BY 1))"""))
def eval_multiclass(spark, sf):
    return evaluation.per_class(_matrix(spark, sf), "truth", "guess")


_CLASS_SCORES = f"""SELECT *, {r('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)', 3)} AS f1, tp + fn AS support FROM (SELECT class, tp, fp, fn, {r('coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)', 3)} AS precision, {r('coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)', 3)} AS recall FROM (
SELECT class, CAST(coalesce(sum(n) FILTER (WHERE truth = class AND guess = class), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (WHERE truth <> class AND guess = class), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (WHERE truth = class AND guess <> class), 0) AS BIGINT) AS fn FROM cl CROSS JOIN m GROUP BY 1))"""


@query("eval_macro", sql(f"{_MATRIX.rstrip()}, pc AS ({_CLASS_SCORES}) SELECT count(*) AS classes, CAST(sum(support) AS BIGINT) AS support, CASE WHEN count(*) >= 2 THEN {r('avg(precision)', 3)} END AS macro_precision, CASE WHEN count(*) >= 2 THEN {r('avg(recall)', 3)} END AS macro_recall, CASE WHEN count(*) >= 2 THEN {r('avg(f1)', 3)} END AS macro_f1 FROM pc WHERE support > 0"))
def eval_macro(spark, sf):
    return evaluation.macro(evaluation.per_class(_matrix(spark, sf), "truth", "guess"))


@query("severity_flag", sql(f"SELECT {SEVERITY} AS severity, {FLAG} AS flag, count(*) AS n FROM cases GROUP BY 1, 2"))
def severity_flag(spark, sf):
    return cases(spark, sf).groupBy(scoring.severity_of_label().alias("severity"), scoring.reviewer_flag().alias("flag")).agg(F.count("*").alias("n"))


def _most(column: str, n: int) -> str:
    return f"SELECT {column} FROM cases GROUP BY 1 ORDER BY count(*) DESC, {column} LIMIT {n}"


@query("medicine_reaction", sql(f"SELECT medicine, reaction, count(*) AS n FROM cases WHERE medicine IN ({_most('medicine', 10)}) AND reaction IN ({_most('reaction', 8)}) GROUP BY 1, 2"))
def medicine_reaction(spark, sf):
    """The ten most frequent medicines by the eight most frequent reactions."""
    return pivots.most_frequent(cases(spark, sf), "medicine", 10, "reaction", 8)


@query("eval_mcc", sql(_MATRIX + f""", z AS (SELECT CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n) FILTER (WHERE truth = guess) AS DOUBLE) AS c FROM m), tm AS (SELECT truth AS k, CAST(sum(n) AS DOUBLE) AS t FROM m GROUP BY 1), pm AS (SELECT guess AS k, CAST(sum(n) AS DOUBLE) AS p FROM m GROUP BY 1)
SELECT CAST(s AS BIGINT) AS support, {r('((c * s - (SELECT sum(t * p) FROM tm JOIN pm USING (k))) / (sqrt(s * s - (SELECT sum(p * p) FROM pm)) * sqrt(s * s - (SELECT sum(t * t) FROM tm))))', 3)} AS mcc FROM z"""))
def eval_mcc(spark, sf):
    return evaluation.mcc(_matrix(spark, sf), "truth", "guess")


@query("eval_routing", sql(f"SELECT status = 'needs_followup' AS truth, {FLAG} = 'follow-up' AS guess, count(*) AS n FROM cases GROUP BY 1, 2"))
def eval_routing(spark, sf):
    return cases(spark, sf).groupBy((F.col("status") == "needs_followup").alias("truth"), (scoring.reviewer_flag() == "follow-up").alias("guess")).agg(F.count("*").alias("n"))


_DIMENSIONS = ("medicine", "reaction", "gender", "age_band", "weight_band", "seriousness")


@query("pivot_any", sql(" " + " UNION ALL ".join(f"SELECT '{a}' AS row_dimension, '{b}' AS column_dimension, {a} AS row_value, {b} AS column_value, count(*) AS reports, {r(f'({d(100)} * count(*) FILTER (WHERE seriousness IN {SERIOUS}) / count(*))', 1)} AS serious_percent, {r('(sum(score) / CAST(count(*) AS DOUBLE))', 2)} AS avg_score, {r('(CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*))', 4)} AS avg_confidence FROM cases GROUP BY {a}, {b}" for k, a in enumerate(_DIMENSIONS) for b in _DIMENSIONS[k + 1 :])))
def pivot_any(spark, sf):
    """Four metrics for every two of six dimensions."""
    return pivots.any_by_any(cases(spark, sf), _DIMENSIONS, F.col("seriousness").isin(*banding.SERIOUS_LABELS))
