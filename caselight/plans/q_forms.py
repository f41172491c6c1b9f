"""Queries over forms, pairs and evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.operators import evaluation, forms, signals

from .cases import cases, d, r, sql
from .q_text import _rouge, sents, toks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return put


_NEXT = ", p AS (SELECT case_key AS base, lead(case_key) OVER (PARTITION BY patient_token ORDER BY case_key) AS other FROM cases), q AS (SELECT base, other, a.source_hash = b.source_hash AS by_hash, a.gender = b.gender AND a.medicine = b.medicine AND a.reaction = b.reaction AS by_rule, a.patient_token = b.patient_token AND a.medicine = b.medicine AS truth FROM p JOIN cases a ON a.case_key = base JOIN cases b ON b.case_key = other)"


def _judged(spark, sf):
    from pyspark.sql.window import Window

    c = cases(spark, sf)
    pairs = c.select(F.col("case_key").alias("base"), F.lead("case_key").over(Window.partitionBy("patient_token").orderBy("case_key")).alias("other")).where("other is not null")
    return c, forms.pair_rules(pairs, c)


@query("pair_rules", sql(_NEXT + " SELECT base, other, by_hash, by_rule, by_hash OR by_rule AS by_either FROM q"))
def pair_rules(spark, sf):
    return _judged(spark, sf)[1]


def _same(f: str) -> str:
    return f"CAST(lower(b.{f}) = lower(o.{f}) AS INTEGER)"


_AGE = "coalesce(TRY_CAST({}.age AS DOUBLE), 0)"


@query("pair_features", sql(f""", p AS (SELECT case_key AS base, lead(case_key) OVER (PARTITION BY patient_token ORDER BY case_key) AS other FROM cases)
SELECT base, other, {_same('gender')} AS same_sex, {_same('medicine')} AS same_drug, {_same('reaction')} AS same_reaction, CAST(split_part(b.reaction, ' ', 1) = split_part(o.reaction, ' ', 1) AS INTEGER) AS same_group, {_same('outcome')} AS same_outcome, {_same('seriousness')} AS same_seriousness,
least(abs({_AGE.format('b')} - {_AGE.format('o')}), {d(20)}) / {d(20)} AS age_gap, {_same('source_hash')} AS same_hash FROM p JOIN cases b ON b.case_key = base JOIN cases o ON o.case_key = other"""))
def pair_features(spark, sf):
    c, judged = _judged(spark, sf)
    return forms.pair_features(judged.select("base", "other"), c, F.split("reaction", " ")[0])


@query("pair_metrics", sql(_NEXT + " " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, {r('p', 4)} AS precision, {r('c', 4)} AS recall, {r('coalesce(2 * p * c / nullif(p + c, 0), 0)', 4)} AS f1 FROM (SELECT coalesce(count(*) FILTER (WHERE truth AND ({e})) / CAST(nullif(count(*) FILTER (WHERE {e}), 0) AS DOUBLE), 0) AS p, coalesce(count(*) FILTER (WHERE truth AND ({e})) / CAST(nullif(count(*) FILTER (WHERE truth), 0) AS DOUBLE), 0) AS c FROM q)" for n, e in (("by_hash", "by_hash"), ("by_rule", "by_rule"), ("by_either", "by_hash OR by_rule")))))
def pair_metrics(spark, sf):
    c, judged = _judged(spark, sf)
    same = c.select(F.col("case_key").alias("base"), F.col("medicine").alias("m1")), c.select(F.col("case_key").alias("other"), F.col("medicine").alias("m2"))
    return forms.pair_metrics(judged.join(same[0], "base").join(same[1], "other"), F.col("m1") == F.col("m2"))


@query("expected_evidence", sql(", q AS (SELECT medicine || '/' || reaction AS query_id, medicine, reaction FROM cases GROUP BY ALL), h AS (SELECT query_id, case_key, row_number() OVER (PARTITION BY query_id ORDER BY case_key) AS n FROM q JOIN cases USING (medicine, reaction)) SELECT query_id, string_agg(CAST(case_key AS VARCHAR), ',' ORDER BY case_key) AS evidence FROM h WHERE n <= 8 GROUP BY 1"))
def expected_evidence(spark, sf):
    c = cases(spark, sf)
    asked = c.select("medicine", "reaction").distinct().withColumn("query_id", F.concat("medicine", F.lit("/"), "reaction"))
    return forms.expected_evidence(asked, c)


_REPORTS = "SELECT case_key AS id, narrative, 'Patient received ' || medicine || '.' AS summary FROM cases"


def _reports(spark, sf):
    return cases(spark, sf).select(F.col("case_key").alias("id"), "narrative", F.concat(F.lit("Patient received "), "medicine", F.lit(".")).alias("summary"))


_LEAD_PAIRS = f"SELECT id, summary AS hypothesis, reference FROM (SELECT id, summary, array_to_string(list_slice({sents('narrative', 20)}, 1, 3), ' ') AS reference FROM (SELECT * FROM ({_REPORTS}) WHERE length(narrative) > 80)) WHERE length(summary) > 10 AND length(reference) > 10"
_LEAD = _rouge(1, _LEAD_PAIRS)


@query("lead3_rouge", sql(f", sm AS (SELECT count(*) AS samples, {r('avg(precision)', 4)} AS precision, {r('avg(recall)', 4)} AS recall, {r('avg(f1)', 4)} AS f1 FROM ({_LEAD})) SELECT * FROM sm"))
def lead3_rouge(spark, sf):
    return evaluation.batch_mean(evaluation.rouge_n(forms.lead_pairs(_reports(spark, sf)), 1))


@query("compression_stats", sql(f"SELECT count(*) AS samples, {r(f'avg({d(100)} * length(summary) / length(narrative))', 2)} AS percent FROM (SELECT * FROM ({_REPORTS}) WHERE length(narrative) > 80)"))
def compression_stats(spark, sf):
    return forms.compression(_reports(spark, sf))


@query("metrics_rollup", sql("SELECT 'dataset' AS source, unnest(['reports', 'medicines', 'reactions']) AS metric, unnest([CAST(count(*) AS DOUBLE), CAST(count(DISTINCT medicine) AS DOUBLE), CAST(count(DISTINCT reaction) AS DOUBLE)]) AS value FROM cases UNION ALL SELECT 'confidence', 'low', CAST(count(*) FILTER (WHERE confidence < 0.65) AS DOUBLE) FROM cases"))
def metrics_rollup(spark, sf):
    c = cases(spark, sf)
    return forms.rollup(dataset=signals.dataset_stats(c), confidence=c.agg(F.count_if(F.col("confidence") < 0.65).alias("low")))


@query("narrow_serious", sql("SELECT medicine, count(*) AS reports, count(*) FILTER (WHERE seriousness IN ('Death', 'Life-threatening', 'Hospitalisation', 'Disability/incapacity')) AS serious FROM cases GROUP BY 1"))
def narrow_serious(spark, sf):
    """The fallback's shorter list of serious labels."""
    return cases(spark, sf).groupBy("medicine").agg(F.count("*").alias("reports"), F.count_if(F.col("seriousness").isin("Death", "Life-threatening", "Hospitalisation", "Disability/incapacity")).alias("serious"))


@query("token_sets", f"SELECT a.item_id, len(list_distinct(list_concat({toks('a.text')}, {toks('b.text')}))) AS n_union, len(list_intersect(list_distinct({toks('a.text')}), list_distinct({toks('b.text')}))) AS n_common FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def token_sets(spark, sf):
    from caselight.functions import text

    from .cases import table

    a = table(spark, sf, "benchmark").select("item_id", text.tokens(F.col("text")).alias("x"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y"))
    return a.join(b, "item_id").select("item_id", F.size(F.array_union("x", "y")).cast("long").alias("n_union"), F.size(F.array_intersect("x", "y")).cast("long").alias("n_common"))
