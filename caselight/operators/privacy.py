"""k-anonymity, l-diversity and t-closeness over equivalence classes of quasi-identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.text import rounded

# The two sets of quasi-identifiers, and targets.
FIVE = ("age_band", "gender", "region", "medicine", "reaction")
THREE = ("age_band", "gender", "region")
SENSITIVE = ("outcome", "seriousness")
K, L, MIN_ROWS = 5, 2, 20
T_STRICT, T_LOOSE = 0.2, 0.35


def counted(rows: DataFrame, ids: tuple[str, ...] = FIVE, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """Rows by class and sensitive values, ``n``: the one pass over the rows; all else is made from
    it, and the optimizer reuses its exchange."""
    return rows.groupBy(*ids, *sensitive).agg(F.count("*").alias("n"))


def _classes(counts: DataFrame, ids: tuple[str, ...], sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    return counts.groupBy(*ids).agg(F.sum("n").alias("size"), *[F.count_distinct(s).alias(f"{s}_values") for s in sensitive])


def _fine(k: int = K, l: int = L, sensitive: tuple[str, ...] = SENSITIVE) -> Column:  # noqa: E741
    return reduce(lambda a, s: a & (F.col(f"{s}_values") >= l), sensitive, F.col("size") >= k)


def classes(rows: DataFrame, ids: tuple[str, ...] = FIVE, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:
    """A row per equivalence class: size and distinct values of each sensitive attribute. Counts
    by class and values come first, so no class is gathered as rows."""
    return _classes(counted(rows, ids, sensitive), ids, sensitive)


def k_anonymity(rows: DataFrame, ids: tuple[str, ...] = FIVE) -> DataFrame:
    g = rows.groupBy(*ids).agg(F.count("*").alias("size"))
    return g.agg(F.count("*").alias("classes"), F.min("size").alias("k"), F.count_if(F.col("size") < K).alias("small_classes"), F.sum(F.when(F.col("size") < K, F.col("size")).otherwise(0)).alias("suppressed_rows"))


def k_suppressed(rows: DataFrame, ids: tuple[str, ...] = FIVE, k: int = K) -> DataFrame:
    """Classes of at least ``k`` rows."""
    return rows.groupBy(*ids).agg(F.count("*").alias("size")).where(F.col("size") >= k)


def released_classes(rows: DataFrame, ids: tuple[str, ...] = FIVE, k: int = K, l: int = L, sensitive: tuple[str, ...] = SENSITIVE) -> DataFrame:  # noqa: E741
    """Classes of ``k`` rows in which every sensitive attribute has ``l`` values."""
    return classes(rows, ids, sensitive).where(_fine(k, l, sensitive))


def released(rows: DataFrame, ids: tuple[str, ...] = FIVE, k: int = K, l: int = L) -> DataFrame:  # noqa: E741
    return rows.join(released_classes(rows, ids, k, l).select(*ids), list(ids), "left_semi")


def l_diversity(rows: DataFrame, ids: tuple[str, ...] = FIVE) -> DataFrame:
    """Per sensitive attribute the least diverse class (the smallest, then the first by its
    identifiers)."""
    g = released_classes(rows, ids)
    out = []
    for s in SENSITIVE:
        worst = g.agg(F.min_by(F.struct(*ids, "size", f"{s}_values"), F.struct(f"{s}_values", "size", *ids)).alias("w"))
        out.append(worst.select(F.lit(s).alias("attribute"), F.col(f"w.{s}_values").alias("l"), F.concat_ws("|", *[f"w.{i}" for i in ids]).alias("worst_class"), F.col("w.size").alias("class_size")))
    return reduce(DataFrame.unionByName, out)


def _released_counts(counts: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    return counts.join(_classes(counts, ids).where(_fine()).select(*ids, "size"), list(ids))


def t_closeness(rows: DataFrame, ids: tuple[str, ...] = FIVE, data: DataFrame | None = None) -> DataFrame:
    """Per sensitive attribute the greatest total variation distance of a class from all released
    rows (or of the classes of ``data``). Values that a class lacks add their global share, so no
    grid of class by value is made: half of (sum over present values of |p - q| + 1 - sum of their
    q)."""
    counts = _released_counts(counted(rows, ids), ids) if data is None else counted(data, ids)
    if data is not None:
        counts = counts.join(_classes(counts, ids).select(*ids, "size"), list(ids))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    out = []
    for s in SENSITIVE:
        local = counts.groupBy(*ids, "size", s).agg(F.sum("n").alias("n"))
        whole = counts.groupBy(s).agg(F.sum("n").alias("n_all")).crossJoin(F.broadcast(total))
        parts = local.join(whole, s).withColumn("q", F.col("n_all") / F.col("total").cast("double"))
        distance = parts.groupBy(*ids).agg(((F.sum(F.abs(F.col("n") / F.col("size").cast("double") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("t"))
        out.append(distance.agg(rounded(F.max("t"), 4).alias("t")).select(F.lit(s).alias("attribute"), "t", (F.col("t") <= T_STRICT).alias("strict"), (F.col("t") <= T_LOOSE).alias("loose")))
    return reduce(DataFrame.unionByName, out)


def record(rows: DataFrame, ids: tuple[str, ...] = FIVE) -> DataFrame:
    """The whole result as one row: k before and after each suppression, what was suppressed, l and
    t of what is released. Without rows, counts and k are 0 and ``insufficient`` is true."""
    g = classes(rows, ids)
    fine, big, zero = _fine(), F.col("size") >= K, F.lit(0)
    one = g.agg(
        F.coalesce(F.sum("size"), zero).alias("total"), F.count("*").alias("classes"), F.coalesce(F.min("size"), zero).alias("k_before"),
        F.coalesce(F.min(F.when(big, F.col("size"))), zero).alias("k_after_k"),
        F.coalesce(F.sum(F.when(~big, F.col("size"))), zero).alias("k_suppressed"), F.count_if(~big).alias("k_suppressed_classes"),
        F.count_if(big & ~fine).alias("l_suppressed_classes"),
        F.coalesce(F.min(F.when(fine, F.col("size"))), zero).alias("k_after"), F.coalesce(F.sum(F.when(fine, F.col("size"))), zero).alias("released"), F.count_if(fine).alias("released_classes"),
        F.min(F.when(fine, F.col("outcome_values"))).alias("l_outcome"), F.min(F.when(fine, F.col("seriousness_values"))).alias("l_seriousness"),
    )
    t = t_closeness(rows, ids)
    near = t.agg(*[F.max(F.when(F.col("attribute") == s, F.coalesce("t", F.lit(0.0)))).alias(f"t_{s}") for s in SENSITIVE])
    one = one.crossJoin(F.broadcast(near))  # one row each
    note = F.format_string("k-suppression removed %d group(s) (<%d records). l-suppression removed %d group(s) (l<%d). Released dataset: %d/%d records across %d equivalence classes.", "k_suppressed_classes", F.lit(K), "l_suppressed_classes", F.lit(L), "released", "total", "released_classes")
    return one.select(
        "*", (F.col("k_before") >= K).alias("k_compliant"), (F.col("k_after_k") >= K).alias("k_after_k_compliant"), (F.col("total") - F.col("released")).alias("suppressed"),
        (F.col("k_suppressed_classes") + F.col("l_suppressed_classes")).alias("suppressed_classes"), *[(F.col(f"t_{s}") <= T_STRICT).alias(f"t_{s}_strict") for s in SENSITIVE], *[(F.col(f"t_{s}") <= T_LOOSE).alias(f"t_{s}_loose") for s in SENSITIVE],
        (F.col("total") < MIN_ROWS).alias("insufficient"), note.alias("note"), F.lit(",".join(ids)).alias("identifiers"),
    )


def _greatest_t(counts: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """One row, ``t_<attribute>``: the greatest distance of a class of ``counts`` (with its ``size``) from all of
    them, null without rows."""
    total = counts.agg(F.sum("n").alias("total"))  # one row
    one = []
    for s in SENSITIVE:
        local = counts.groupBy(*ids, "size", s).agg(F.sum("n").alias("n"))
        whole = counts.groupBy(s).agg(F.sum("n").alias("n_all")).crossJoin(F.broadcast(total))
        parts = local.join(whole, s).withColumn("q", F.col("n_all") / F.col("total").cast("double"))
        distance = parts.groupBy(*ids).agg(((F.sum(F.abs(F.col("n") / F.col("size").cast("double") - F.col("q"))) + 1 - F.sum("q")) / 2).alias("t"))
        one.append(distance.agg(rounded(F.max("t"), 4).alias(f"t_{s}")))
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)  # one row each


def study(rows: DataFrame, strategies: dict[str, tuple[str, ...]]) -> DataFrame:
    """k-suppression only, for several sets of identifiers, with l and t of what is kept."""
    out = []
    for name, ids in strategies.items():
        counts = counted(rows, ids)
        g = _classes(counts, ids)
        fine = F.col("size") >= K
        kept = counts.join(g.where(fine).select(*ids, "size"), list(ids))
        out.append(g.agg(
            F.lit(name).alias("strategy"), F.min("size").alias("k_before"), F.min(F.when(fine, F.col("size"))).alias("k_after"), F.count_if(fine).alias("kept_classes"),
            rounded(F.count_if(fine) / F.count("*").cast("double"), 4).alias("compliant_share"),
            F.sum(F.when(fine, 0).otherwise(F.col("size"))).alias("suppressed"),
            rounded(F.sum(F.when(fine, 0).otherwise(F.col("size"))) / F.sum("size").cast("double"), 4).alias("suppression_rate"),
            F.min(F.when(fine, F.col("outcome_values"))).alias("l_outcome"), F.min(F.when(fine, F.col("seriousness_values"))).alias("l_seriousness"),
        ).crossJoin(F.broadcast(_greatest_t(kept, ids))))
    return reduce(DataFrame.unionByName, out)
