"""Keyset and offset pages, role scope, searches, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.text import text_of


def scoped(rows: DataFrame, user: str, admin: bool, column: str = "uploader") -> DataFrame:
    return rows if admin else rows.where(F.col(column) == user)


def page(rows: DataFrame, key: str, cursor: int | None, size: int) -> DataFrame:
    """The next ``size`` rows below ``cursor``, newest first, with ``has_more`` and
    ``next_cursor`` on each; one row more than asked for is read to know."""
    rows = rows if cursor is None else rows.where(F.col(key) < cursor)
    probe = rows.orderBy(F.desc(key)).limit(size + 1)
    from pyspark.sql.window import Window

    # at most size + 1 rows
    numbered = probe.withColumn("_n", F.row_number().over(Window.orderBy(F.desc(key)))).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(1))))
    numbered = numbered.withColumn("has_more", F.col("_all") > size).where(F.col("_n") <= size)
    return numbered.withColumn("next_cursor", F.when(F.col("has_more"), F.min(key).over(Window.partitionBy(F.lit(1))))).drop("_n", "_all")


def offset_page(rows: DataFrame, keys: list, offset: int, size: int) -> DataFrame:
    return rows.orderBy(*keys).offset(offset).limit(size)


def contains(column: str, typed: str) -> Column:
    """What a user typed, as a literal, whatever the case; its first 60 characters."""
    return F.lower(column).contains(typed[:60].lower())


def search(rows: DataFrame, typed: str, columns: list[str], **equal: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit |= contains(c, typed)
    rows = rows.where(hit)
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows


def masked(token: Column, keep: int = 12) -> Column:
    return F.concat(F.substring(token, 1, keep), F.lit("...restricted"))


def presented(rows: DataFrame, role: str, user: str) -> DataFrame:
    """Flat rows with defaults; the review token only for the member who made them. The last score
    snapshot counts."""
    snapshot = F.element_at("score_snapshots", -1)
    mine = F.lit(role == "member") & (F.col("uploader") == user)
    return rows.select("report_number", F.coalesce(F.nullif("medicine", F.lit("")), F.lit("Not extracted")).alias("medicine"), F.coalesce(F.nullif("reaction", F.lit("")), F.lit("Not extracted")).alias("reaction"), snapshot["score"].alias("score"), F.when(F.col("needs_ocr"), "needs_ocr").otherwise(snapshot["route"]).alias("status"), F.when(mine, F.col("review_token")).alias("review_token"))


def upserted(profiles: DataFrame, changed: DataFrame, key: str = "version") -> DataFrame:
    """``changed`` in place of rows with its key, and what has a new key."""
    return profiles.join(changed.select(key), key, "left_anti").unionByName(changed)


# What the detail view says where a report has nothing to show.
NOT_DISPLAYED, TOKEN_ONLY, REMOVED = "Not displayed", "Reporter token only", "Generalised or removed"
FOLLOW_UP_ONLY = "Visible only through PvPI follow-up workflow."
REPORT_TYPE, NEW, SUSPECTED, TRACED = "Processed ADR report", "new", "Suspected", "extracted source trace"


def detailed(rows: DataFrame, key: str = "case_key") -> DataFrame:
    """``key`` and the nested view of a report: ``patient``, ``reporter``, ``pvpi``, ``clinical``,
    ``medications[]``, ``reactions[]``. Columns that ``rows`` lacks are empty."""
    of = lambda c, none="": F.coalesce(F.nullif(text_of(c), F.lit("")), F.lit(none)) if c in rows.columns else F.lit(none)
    part = lambda **fields: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in fields.items()])
    patient = part(token=of("patient_token"), name=NOT_DISPLAYED, initials=of("initials"), age=of("age"), sex=of("gender"), weight=of("weight"), address=REMOVED, history=of("narrative"))
    reporter = part(token=of("reporter_token"), name=of("reporter", TOKEN_ONLY), institution=of("institution"), department=of("department"), phone=of("phone"), email=of("email"), policy=FOLLOW_UP_ONLY)
    pvpi = part(centre=of("centre"), received=of("created_at"), kind=REPORT_TYPE, submitted_by=of("uploader"), lineage=of("relation", NEW))
    clinical = part(onset=of("onset"), seriousness=of("seriousness"), outcome=of("outcome"), narrative=of("narrative"))
    medication = part(name=of("medicine"), role=SUSPECTED, dose=of("dose"), route=of("route"), frequency=of("frequency"), source=TRACED)
    reaction = part(term=of("reaction"), onset=of("onset"), outcome=of("outcome"), seriousness=of("seriousness"), source=TRACED)
    return rows.select(key, patient.alias("patient"), reporter.alias("reporter"), pvpi.alias("pvpi"), clinical.alias("clinical"), F.array(medication).alias("medications"), F.array(reaction).alias("reactions"))
