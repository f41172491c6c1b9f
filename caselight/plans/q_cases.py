"""Queries over the derived case table: signals, privacy, linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.operators import anchors, linkage, privacy, signals
from caselight.session import held, once

from .cases import cases, d, r, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return put


SERIOUS = "('Death', 'Life-threatening', 'Hospitalisation', 'Disability/incapacity', 'Congenital anomaly', 'Other medically important')"
PAIRS = f"""
, pairs AS (SELECT medicine, reaction, count(*) AS reports, count(*) FILTER (WHERE seriousness IN {SERIOUS}) AS serious, avg(confidence) AS avg_confidence FROM cases GROUP BY ALL),
m AS (SELECT medicine, count(*) AS n_m FROM cases GROUP BY ALL), re AS (SELECT reaction, count(*) AS n_r FROM cases GROUP BY ALL), tot AS (SELECT count(*) AS total FROM cases),
tab AS (SELECT pairs.*, total, reports AS a, n_m - reports AS b, n_r - reports AS c, total - n_m - n_r + reports AS d FROM pairs JOIN m USING (medicine) JOIN re USING (reaction), tot),
dis AS (SELECT *, CASE WHEN c = 0 THEN {d(0)} ELSE {r("((CAST(a AS DOUBLE) / (a + b)) / (CAST(c AS DOUBLE) / greatest(c + d, 1)))", 2)} END AS prr,
  CASE WHEN b = 0 OR c = 0 THEN NULL ELSE {r("(CAST(a AS DOUBLE) * d / (CAST(b AS DOUBLE) * c))", 2)} END AS ror,
  {r("log2(CAST(a AS DOUBLE) * total / (CAST(a + b AS DOUBLE) * (a + c)))", 3)} AS ic FROM tab),
sig AS (SELECT *, prr >= 2 AND a >= 3 AS is_signal, {r(f"({d(0.45)} * (reports / CAST(total AS DOUBLE)) + {d(0.35)} * (serious / CAST(reports AS DOUBLE)) + {d(0.20)} * {r('avg_confidence', 4)})", 2)} AS signal_score FROM dis)
"""


@query("case_table", sql("SELECT * FROM cases"))
def case_table(spark, sf):
    columns = "case_key report_number created_at patient_token medicine reaction region gender age weight seriousness outcome dose route frequency onset centre uploader contact parser_confidence trace_share n_missing confidence score status age_band weight_band source_hash narrative".split()
    return cases(spark, sf).select(*columns)


@query("signal_contingency", sql(PAIRS + "SELECT medicine, reaction, a, b, c, d FROM tab"))
def signal_contingency(spark, sf):
    return signals.contingency(cases(spark, sf)).select("medicine", "reaction", "a", "b", "c", "d")


@query("signal_prr", sql(PAIRS + "SELECT medicine, reaction, a, prr, ror, ic, is_signal FROM sig"))
def signal_prr(spark, sf):
    return signals.disproportionality(cases(spark, sf)).select("medicine", "reaction", "a", "prr", "ror", "ic", "is_signal")


@query("signal_top25", sql(PAIRS + "SELECT medicine, reaction, reports, serious, signal_score, CASE WHEN signal_score >= 0.7 THEN 'high' WHEN signal_score >= 0.45 THEN 'medium' ELSE 'low' END AS priority FROM sig ORDER BY signal_score DESC, reports DESC, medicine, reaction LIMIT 25"))
def signal_top25(spark, sf):
    return signals.top_signals(cases(spark, sf)).select("medicine", "reaction", "reports", "serious", "signal_score", "priority")


@query("dataset_stats", sql("SELECT count(*) AS reports, count(DISTINCT medicine) AS medicines, count(DISTINCT reaction) AS reactions FROM cases"))
def dataset_stats(spark, sf):
    return signals.dataset_stats(cases(spark, sf))


@query("insights", sql(PAIRS + f"""SELECT 'top-signal' AS insight, medicine || ' / ' || reaction AS detail, signal_score AS value FROM (SELECT * FROM sig ORDER BY signal_score DESC, reports DESC, medicine, reaction LIMIT 1)
UNION ALL SELECT 'low-confidence', '', {r("avg(CASE WHEN confidence < 0.65 THEN 1.0 ELSE 0.0 END)", 3)} FROM cases UNION ALL SELECT 'missing-fields', '', {r("avg(CASE WHEN n_missing > 0 THEN 1.0 ELSE 0.0 END)", 3)} FROM cases"""))
def insights(spark, sf):
    return signals.insights(cases(spark, sf))


@query("prediction_basis", sql(f"""SELECT case_key, seriousness IN {SERIOUS} OR outcome = 'Fatal' OR score >= 85 AS serious, n_missing = 0 AND confidence >= 0.65 AS ready, n > 1 AS duplicate,
concat_ws('; ', 'seriousness ' || seriousness, CASE WHEN score >= 85 THEN 'score at least 85' END, CASE WHEN n_missing > 0 THEN n_missing || ' missing' END, CASE WHEN n > 1 THEN (n - 1) || ' duplicate candidates' END) AS basis
FROM (SELECT *, count(*) OVER (PARTITION BY patient_token, medicine, reaction) AS n FROM cases)"""))
def prediction_basis(spark, sf):
    return signals.prediction_basis(cases(spark, sf))


@query("monthly_signals", sql(f"SELECT strftime(created_at, '%Y-%m') AS month, medicine, reaction, count(*) AS reports, count(*) FILTER (WHERE seriousness IN {SERIOUS}) AS serious, {r('avg(confidence)', 4)} AS avg_confidence FROM cases GROUP BY 1, 2, 3"))
def monthly_signals(spark, sf):
    return signals.monthly(cases(spark, sf))


@query("relation_signals", sql(f"SELECT medicine, reaction, count(*) AS reports, count(*) FILTER (WHERE seriousness IN {SERIOUS}) AS serious, count(*) FILTER (WHERE seriousness = 'Death' OR outcome = 'Fatal') AS deaths FROM cases GROUP BY ALL ORDER BY serious DESC, reports DESC, medicine, reaction LIMIT 50"))
def relation_signals(spark, sf):
    return signals.relations(cases(spark, sf))


# --- privacy ---

FIVE, THREE = ", ".join(privacy.FIVE), ", ".join(privacy.THREE)


def _classes(ids: str) -> str:
    return f", g AS (SELECT {ids}, count(*) AS size, count(DISTINCT outcome) AS ov, count(DISTINCT seriousness) AS sv FROM cases GROUP BY {ids}) "


@query("privacy_k", sql(_classes(FIVE) + "SELECT count(*) AS classes, min(size) AS k, count(*) FILTER (WHERE size < 5) AS small_classes, CAST(sum(CASE WHEN size < 5 THEN size ELSE 0 END) AS BIGINT) AS suppressed_rows FROM g"))
def privacy_k(spark, sf):
    return privacy.k_anonymity(cases(spark, sf))


@query("privacy_k3", sql(_classes(THREE) + "SELECT count(*) AS classes, min(size) AS k, count(*) FILTER (WHERE size < 5) AS small_classes, CAST(sum(CASE WHEN size < 5 THEN size ELSE 0 END) AS BIGINT) AS suppressed_rows FROM g"))
def privacy_k3(spark, sf):
    return privacy.k_anonymity(cases(spark, sf), privacy.THREE)


@query("privacy_ksuppress", sql(_classes(FIVE) + f"SELECT {FIVE}, size FROM g WHERE size >= 5"))
def privacy_ksuppress(spark, sf):
    return privacy.k_suppressed(cases(spark, sf))


@query("privacy_lsuppress", sql(_classes(FIVE) + f"SELECT {FIVE}, size, ov AS outcome_values, sv AS seriousness_values FROM g WHERE size >= 5 AND ov >= 2 AND sv >= 2"))
def privacy_lsuppress(spark, sf):
    return privacy.released_classes(cases(spark, sf))


@query("privacy_ldiv", sql(_classes(FIVE) + f""", ok AS (SELECT *, concat_ws('|', {FIVE}) AS worst_class FROM g WHERE size >= 5 AND ov >= 2 AND sv >= 2)
(SELECT 'outcome' AS attribute, ov AS l, worst_class, size AS class_size FROM ok ORDER BY ov, size, {FIVE} LIMIT 1) UNION ALL (SELECT 'seriousness', sv, worst_class, size FROM ok ORDER BY sv, size, {FIVE} LIMIT 1)"""))
def privacy_ldiv(spark, sf):
    return privacy.l_diversity(cases(spark, sf))


def _t(attribute: str) -> str:
    return f"""SELECT '{attribute}' AS attribute, t, t <= 0.2 AS strict, t <= 0.35 AS loose FROM (SELECT {r("max(t)", 4)} AS t FROM (
SELECT {FIVE}, sum(abs(coalesce(n, 0) / CAST(size AS DOUBLE) - q)) / 2 AS t FROM (SELECT * FROM ok, (SELECT {attribute} AS v, count(*) / CAST((SELECT count(*) FROM rel) AS DOUBLE) AS q FROM rel GROUP BY 1))
LEFT JOIN (SELECT {FIVE}, {attribute} AS v, count(*) AS n FROM rel GROUP BY ALL) USING ({FIVE}, v) GROUP BY {FIVE}))"""


@query("privacy_tclose", sql(_classes(FIVE) + f", ok AS (SELECT {FIVE}, size FROM g WHERE size >= 5 AND ov >= 2 AND sv >= 2), rel AS (SELECT cases.* FROM cases JOIN ok USING ({FIVE})) {_t('outcome')} UNION ALL {_t('seriousness')}"))
def privacy_tclose(spark, sf):
    return privacy.t_closeness(cases(spark, sf))


_OK = "size >= 5 AND ov >= 2 AND sv >= 2"


@query("privacy_record", sql(_classes(FIVE) + f""", ok AS (SELECT {FIVE}, size FROM g WHERE {_OK}), rel AS (SELECT cases.* FROM cases JOIN ok USING ({FIVE})), t AS ({_t('outcome')} UNION ALL {_t('seriousness')}),
b AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total, count(*) AS classes, coalesce(min(size), 0) AS k_before, coalesce(min(size) FILTER (WHERE size >= 5), 0) AS k_after_k, CAST(coalesce(sum(size) FILTER (WHERE size < 5), 0) AS BIGINT) AS k_suppressed, count(*) FILTER (WHERE size < 5) AS k_suppressed_classes,
count(*) FILTER (WHERE size >= 5 AND NOT ({_OK})) AS l_suppressed_classes, coalesce(min(size) FILTER (WHERE {_OK}), 0) AS k_after, CAST(coalesce(sum(size) FILTER (WHERE {_OK}), 0) AS BIGINT) AS released, count(*) FILTER (WHERE {_OK}) AS released_classes,
min(ov) FILTER (WHERE {_OK}) AS l_outcome, min(sv) FILTER (WHERE {_OK}) AS l_seriousness FROM g),
n AS (SELECT coalesce(max(t) FILTER (WHERE attribute = 'outcome'), 0) AS t_outcome, coalesce(max(t) FILTER (WHERE attribute = 'seriousness'), 0) AS t_seriousness FROM t)
SELECT *, k_before >= 5 AS k_compliant, k_after_k >= 5 AS k_after_k_compliant, total - released AS suppressed, k_suppressed_classes + l_suppressed_classes AS suppressed_classes, t_outcome <= 0.2 AS t_outcome_strict, t_seriousness <= 0.2 AS t_seriousness_strict, t_outcome <= 0.35 AS t_outcome_loose, t_seriousness <= 0.35 AS t_seriousness_loose, total < 20 AS insufficient,
format('k-suppression removed {{}} group(s) (<5 records). l-suppression removed {{}} group(s) (l<2). Released dataset: {{}}/{{}} records across {{}} equivalence classes.', k_suppressed_classes, l_suppressed_classes, released, total, released_classes) AS note, '{",".join(privacy.FIVE)}' AS identifiers FROM b, n"""))
def privacy_record(spark, sf):
    return privacy.record(cases(spark, sf))


def _study_t(ids: str, attribute: str) -> str:
    size = f"SELECT {ids}, count(*) AS size FROM cases GROUP BY {ids} HAVING count(*) >= 5"
    return f"""(SELECT {r("max(t)", 4)} FROM (SELECT {ids}, sum(abs(coalesce(n, 0) / CAST(size AS DOUBLE) - q)) / 2 AS t FROM (SELECT * FROM ({size}), (SELECT {attribute} AS v, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM cases JOIN ({size}) USING ({ids}) GROUP BY 1))
LEFT JOIN (SELECT {ids}, {attribute} AS v, count(*) AS n FROM cases GROUP BY ALL) USING ({ids}, v) GROUP BY {ids}))"""


def _study(name: str, ids: str) -> str:
    return f"""SELECT '{name}' AS strategy, min(size) AS k_before, min(size) FILTER (WHERE size >= 5) AS k_after, count(*) FILTER (WHERE size >= 5) AS kept_classes, {r("(count(*) FILTER (WHERE size >= 5) / CAST(count(*) AS DOUBLE))", 4)} AS compliant_share,
CAST(coalesce(sum(size) FILTER (WHERE size < 5), 0) AS BIGINT) AS suppressed, {r("(coalesce(sum(size) FILTER (WHERE size < 5), 0) / CAST(sum(size) AS DOUBLE))", 4)} AS suppression_rate,
min(ov) FILTER (WHERE size >= 5) AS l_outcome, min(sv) FILTER (WHERE size >= 5) AS l_seriousness, {_study_t(ids, 'outcome')} AS t_outcome, {_study_t(ids, 'seriousness')} AS t_seriousness
FROM (SELECT {ids}, count(*) AS size, count(DISTINCT outcome) AS ov, count(DISTINCT seriousness) AS sv FROM cases GROUP BY {ids})"""


@query("privacy_study", sql(f"{_study('A', THREE)} UNION ALL {_study('B', FIVE)}"))
def privacy_study(spark, sf):
    return privacy.study(cases(spark, sf), {"A": privacy.THREE, "B": privacy.FIVE})


# --- linkage ---

_FIELDS = linkage.FIELDS
_KEYED = ", k AS (SELECT case_key, created_at, source_hash, patient_token, lower(medicine) AS medicine, lower(reaction) AS reaction, " + ", ".join(f"lower({f}) AS {f}" for f in _FIELDS) + " FROM cases)"
_PAIRS = _KEYED + ", p AS (SELECT a.case_key, b.case_key AS prior_key, concat_ws(',', " + ", ".join(f"CASE WHEN a.{f} <> '' AND a.{f} <> b.{f} THEN '{f}' END" for f in _FIELDS) + ") AS changes, a.source_hash = b.source_hash AS same FROM k a JOIN k b ON a.patient_token = b.patient_token AND a.medicine = b.medicine AND a.reaction = b.reaction AND (b.created_at < a.created_at OR b.created_at = a.created_at AND b.case_key < a.case_key))"
_REL = _PAIRS + """, h AS (SELECT a.case_key, count(*) AS hash_seen FROM k a JOIN k b ON a.source_hash = b.source_hash AND (b.created_at < a.created_at OR b.created_at = a.created_at AND b.case_key < a.case_key) GROUP BY 1),
s AS (SELECT case_key, count(*) AS anchor_seen, concat_ws(',', """ + ", ".join(f"CASE WHEN bool_or(list_contains(string_split(changes, ','), '{f}')) THEN '{f}' END" for f in _FIELDS) + """) AS changed FROM p GROUP BY 1),
rel AS (SELECT k.case_key, CASE WHEN coalesce(hash_seen, 0) > 0 THEN 'duplicate' WHEN coalesce(anchor_seen, 0) = 0 THEN 'new' WHEN changed <> '' THEN 'followup' ELSE 'duplicate' END AS relation, coalesce(hash_seen, 0) AS hash_seen, coalesce(anchor_seen, 0) AS anchor_seen, coalesce(changed, '') AS changed FROM k LEFT JOIN h USING (case_key) LEFT JOIN s USING (case_key))
"""


@query("link_relation", sql(_REL + "SELECT * FROM rel"))
def link_relation(spark, sf):
    return linkage.relations(cases(spark, sf))


@query("link_changes", sql(_PAIRS + " SELECT case_key, prior_key, changes FROM p"))
def link_changes(spark, sf):
    return linkage.matched_pairs(cases(spark, sf))


@query("link_history", sql(_REL + "SELECT case_key, relation, count(*) AS matches, string_agg(CAST(prior_key AS VARCHAR), ',' ORDER BY prior_key) AS prior_keys FROM p JOIN rel USING (case_key) WHERE hash_seen = 0 AND (relation = 'duplicate' OR changes <> '') GROUP BY 1, 2"))
def link_history(spark, sf):
    return linkage.history(cases(spark, sf))


@query("link_states", sql(_REL + "SELECT case_key, relation, changed FROM rel"))
def link_states(spark, sf):
    """Relations by the states of anchors and hashes, without windows."""
    with held(anchors.points(cases(spark, sf))) as rows:
        return once(anchors.labelled(rows, anchors.states(rows), anchors.hash_states(rows)))


_EARLIER = "(b.created_at < a.created_at OR b.created_at = a.created_at AND b.case_key < a.case_key)"


@query("link_incremental", sql(_REL + f"SELECT case_key, relation, changed, case_key % 5 = 0 OR EXISTS (SELECT 1 FROM k a JOIN k b ON b.case_key % 5 = 0 AND {_EARLIER} AND (a.source_hash = b.source_hash OR a.patient_token = b.patient_token AND a.medicine = b.medicine AND a.reaction = b.reaction) WHERE a.case_key = rel.case_key) AS touched FROM rel"))
def link_incremental(spark, sf):
    """Four fifths of the cases as they are stored, and the rest as a load."""
    with held(anchors.points(cases(spark, sf))) as rows:
        stored, new = rows.where("case_key % 5 <> 0"), rows.where("case_key % 5 = 0")
        with held(anchors.states(stored)) as known, held(anchors.hash_states(stored)) as hashes:
            return once(anchors.relabel(stored, anchors.labelled(stored, known, hashes), known, hashes, new)[0])


_VALUES = "concat_ws('|', " + ", ".join(_FIELDS) + ")"


@query("link_versions", sql(_KEYED + f""", o AS (SELECT case_key, patient_token || '|' || medicine || '|' || reaction AS anchor, {_VALUES} AS v, row_number() OVER (PARTITION BY patient_token, medicine, reaction ORDER BY created_at, case_key) AS seq FROM k),
f AS (SELECT anchor, v, dense_rank() OVER (PARTITION BY anchor ORDER BY min(seq)) AS version FROM o GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY anchor ORDER BY seq) = v THEN 0 ELSE 1 END AS begins, row_number() OVER (PARTITION BY anchor, v ORDER BY seq) - 1 AS same_before FROM o)
SELECT case_key, seq, version, sum(begins) OVER (PARTITION BY m.anchor ORDER BY seq) AS run, same_before FROM m JOIN f ON m.anchor = f.anchor AND m.v = f.v"""))
def link_versions(spark, sf):
    """A row a case, from which all its matches follow."""
    return anchors.versions(cases(spark, sf)).drop("anchor_id")


@query("dup_exists", sql("SELECT case_key, count(*) OVER (PARTITION BY patient_token, medicine, reaction) > 1 AS duplicate FROM cases"))
def dup_exists(spark, sf):
    return linkage.has_other(cases(spark, sf))


@query("link_candidates", sql("""SELECT case_key, prior_key, rank FROM (SELECT a.case_key, b.case_key AS prior_key, row_number() OVER (PARTITION BY a.case_key ORDER BY b.created_at DESC, b.case_key DESC) AS rank
FROM cases a JOIN cases b ON a.patient_token = b.patient_token AND a.uploader = b.uploader AND (b.created_at < a.created_at OR b.created_at = a.created_at AND b.case_key < a.case_key)) WHERE rank <= 50"""))
def link_candidates(spark, sf):
    """The hash holds the patient here, so equal hashes are among equal patients."""
    return linkage.candidates(cases(spark, sf))


@query("link_relabel", sql(_REL + "SELECT case_key, relation, 'new' AS stored FROM rel WHERE relation <> 'new'"))
def link_relabel(spark, sf):
    c = cases(spark, sf)
    return linkage.relabelled(c, c.select("case_key", F.lit("new").alias("relation")))


@query("case_lineage", sql(_REL + "SELECT patient_token, medicine, reaction, count(*) AS reports, string_agg(relation, ' -> ' ORDER BY created_at, case_key) AS chain FROM cases JOIN rel USING (case_key) GROUP BY 1, 2, 3 HAVING count(*) > 1"))
def case_lineage(spark, sf):
    return linkage.lineage(cases(spark, sf))


@query("patient_anchors", sql("SELECT patient_token, count(*) AS reports, " + ", ".join(f"string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS {c}s" for c in ("medicine", "reaction", "outcome")) + " FROM cases GROUP BY 1 HAVING count(*) > 1"))
def patient_anchors(spark, sf):
    return linkage.patients(cases(spark, sf))


@query("merge_latest", sql("SELECT patient_token, case_key, status FROM (SELECT *, row_number() OVER (PARTITION BY patient_token ORDER BY (case_key % 2) DESC, case_key DESC) AS n FROM cases) WHERE n = 1"))
def merge_latest(spark, sf):
    c = cases(spark, sf).select("patient_token", "case_key", "status")
    return linkage.merged(c.where("case_key % 2 = 0"), c.where("case_key % 2 = 1"), "patient_token", "case_key")
