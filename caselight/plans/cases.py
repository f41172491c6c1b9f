"""The case table derived from the star schema: one row per order that has line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions import banding, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items roll up first, so the joins see one row an order; the dimensions are left to
    the optimizer, which broadcasts those below its threshold and else shuffles."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("part"), F.count("*").alias("n_lines"), F.max("l_discount").alias("discount"),
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"), F.min("l_shipdate").alias("shipped"),
    )
    joined = (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "part"), F.col("part") == F.col("p_partkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    seriousness = (
        F.when(F.col("o_orderpriority").startswith("1"), "Death")
        .when(F.col("o_orderpriority").startswith("2"), "Hospitalisation")
        .when(F.col("o_orderpriority").startswith("3"), "Disability/incapacity")
        .when(F.col("o_orderpriority").startswith("4"), "Other medically important")
        .otherwise("Non-serious")
    )
    outcome = F.when(F.col("o_orderstatus") == "F", "Recovered").when(F.col("o_orderstatus") == "O", "Not recovered").otherwise("Recovering")
    parser = F.when(F.col("n_lines") % 4 == 0, 0.95).when(F.col("n_lines") % 4 == 1, 0.78).when(F.col("n_lines") % 4 == 2, 0.72).otherwise(0.20)
    base = joined.select(
        F.col("o_orderkey").alias("case_key"),
        F.concat(F.lit("RPT-"), F.col("o_orderkey").cast("string")).alias("report_number"),
        F.col("o_orderdate").alias("created_at"),
        text.token_for("patient", F.col("c_custkey").cast("string")).alias("patient_token"),
        F.col("p_brand").alias("medicine"),
        F.col("p_type").alias("reaction"),
        F.col("r_name").alias("region"),
        F.when(F.col("c_custkey") % 3 == 0, "Male").when(F.col("c_custkey") % 3 == 1, "Female").otherwise("Unknown").alias("gender"),
        F.when(F.col("c_acctbal") < 0, "").otherwise((F.col("c_custkey") % 92).cast("string")).alias("age"),
        (F.col("c_custkey") % 75 + 30).cast("string").alias("weight"),
        seriousness.alias("seriousness"),
        outcome.alias("outcome"),
        F.col("n_lines").cast("string").alias("dose"),
        F.col("flag").alias("route"),
        F.col("status").alias("frequency"),
        F.date_format("shipped", "yyyy-MM-dd").alias("onset"),
        F.col("n_name").alias("centre"),
        F.col("c_mktsegment").alias("uploader"),
        F.when(F.col("discount") < 0.02, "").otherwise(F.concat(F.lit("contact-"), F.col("c_custkey").cast("string"))).alias("contact"),
        parser.alias("parser_confidence"),
        ((F.col("n_lines") % 10 + 5).cast("double") / 14.0).alias("trace_share"),
    )
    missing = F.when(F.col("age") == "", 1).otherwise(0) + F.when(F.col("contact") == "", 1).otherwise(0)
    scored = base.withColumn("n_missing", missing).withColumn(
        "confidence", text.rounded(F.lit(0.45) * (F.lit(1.0) - F.col("n_missing") / 5.0) + F.lit(0.35) * F.col("parser_confidence") + F.lit(0.20) * F.col("trace_share"), 2)
    )
    scored = scored.withColumn("score", F.greatest(F.lit(0), 100 - 14 * F.col("n_missing") - F.when(F.col("confidence") < 0.6, 12).otherwise(0)).cast("int"))
    status = F.when(F.col("n_missing") > 0, "needs_followup").when(F.col("confidence") < 0.65, "manual_review").otherwise("ready_for_processing")
    narrative = F.concat(F.lit("Patient received "), "medicine", F.lit(" and reported "), "reaction", F.lit(" after exposure. Outcome was "), F.lower("outcome"), F.lit(". Criteria: "), F.lower("seriousness"), F.lit("."))
    return scored.select(
        "*",
        status.alias("status"),
        banding.age_band(F.col("age")).alias("age_band"),
        banding.weight_band(F.col("weight")).alias("weight_band"),
        F.sha2(F.concat_ws("|", "patient_token", "medicine", "reaction", "outcome", "seriousness"), 256).alias("source_hash"),
        narrative.alias("narrative"),
    )


CASES_SQL = """
lines AS (
  SELECT l_orderkey, min(l_partkey) AS part, count(*) AS n_lines, max(l_discount) AS discount, min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_shipdate) AS shipped
  FROM lineitem GROUP BY l_orderkey),
case_base AS (
  SELECT o_orderkey AS case_key, 'RPT-' || o_orderkey AS report_number, o_orderdate AS created_at,
    'PATIENT_TKN_' || upper(substr(sha256('patient:' || c_custkey), 1, 10)) AS patient_token,
    p_brand AS medicine, p_type AS reaction, r_name AS region,
    CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS gender,
    CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_custkey % 92 AS VARCHAR) END AS age,
    CAST(c_custkey % 75 + 30 AS VARCHAR) AS weight,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Death' WHEN '2' THEN 'Hospitalisation' WHEN '3' THEN 'Disability/incapacity' WHEN '4' THEN 'Other medically important' ELSE 'Non-serious' END AS seriousness,
    CASE o_orderstatus WHEN 'F' THEN 'Recovered' WHEN 'O' THEN 'Not recovered' ELSE 'Recovering' END AS outcome,
    CAST(n_lines AS VARCHAR) AS dose, flag AS route, status AS frequency, strftime(shipped, '%Y-%m-%d') AS onset,
    n_name AS centre, c_mktsegment AS uploader,
    CASE WHEN discount < CAST(0.02 AS DOUBLE) THEN '' ELSE 'contact-' || c_custkey END AS contact,
    CAST(CASE n_lines % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.78 WHEN 2 THEN 0.72 ELSE 0.20 END AS DOUBLE) AS parser_confidence,
    CAST(n_lines % 10 + 5 AS DOUBLE) / CAST(14 AS DOUBLE) AS trace_share
  FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN part ON part = p_partkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
case_missing AS (SELECT *, (CASE WHEN age = '' THEN 1 ELSE 0 END) + (CASE WHEN contact = '' THEN 1 ELSE 0 END) AS n_missing FROM case_base),
case_sure AS (
  SELECT *, floor((CAST(0.45 AS DOUBLE) * (CAST(1 AS DOUBLE) - CAST(n_missing AS DOUBLE) / CAST(5 AS DOUBLE)) + CAST(0.35 AS DOUBLE) * parser_confidence + CAST(0.20 AS DOUBLE) * trace_share) * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS confidence
  FROM case_missing),
cases AS (
  SELECT *,
    CAST(greatest(0, 100 - 14 * n_missing - CASE WHEN confidence < CAST(0.6 AS DOUBLE) THEN 12 ELSE 0 END) AS INTEGER) AS score,
    CASE WHEN n_missing > 0 THEN 'needs_followup' WHEN confidence < CAST(0.65 AS DOUBLE) THEN 'manual_review' ELSE 'ready_for_processing' END AS status,
    CASE WHEN age IN ('', '0') THEN 'Unknown' WHEN CAST(age AS INTEGER) < 18 THEN 'Under-18' WHEN CAST(age AS INTEGER) <= 35 THEN '18-35' WHEN CAST(age AS INTEGER) <= 55 THEN '36-55' WHEN CAST(age AS INTEGER) <= 70 THEN '56-70' ELSE '70+' END AS age_band,
    CASE WHEN CAST(weight AS INTEGER) < 45 THEN '<45kg' WHEN CAST(weight AS INTEGER) <= 65 THEN '45-65kg' WHEN CAST(weight AS INTEGER) <= 85 THEN '66-85kg' ELSE '86kg+' END AS weight_band,
    sha256(patient_token || '|' || medicine || '|' || reaction || '|' || outcome || '|' || seriousness) AS source_hash,
    'Patient received ' || medicine || ' and reported ' || reaction || ' after exposure. Outcome was ' || lower(outcome) || '. Criteria: ' || lower(seriousness) || '.' AS narrative
  FROM case_sure)
"""


def sql(body: str) -> str:
    """``body`` with the case table in front, as ``cases``."""
    return f"WITH {CASES_SQL.strip()}{body}" if body.lstrip().startswith(",") else f"WITH {CASES_SQL.strip()} {body}"


def d(x: float) -> str:
    """A double literal."""
    return f"CAST({x} AS DOUBLE)"


def r(x: str, digits: int) -> str:
    """Rounding as :func:`caselight.functions.text.rounded` does it."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(sign({x}) * floor(abs({x}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"
