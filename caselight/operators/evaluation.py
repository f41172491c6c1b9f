"""Classifier, routing, extraction and summary metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions import text
from caselight.functions.stemming import stems
from caselight.functions.text import rounded

CLASSES = ("death", "disability", "hospitalisation", "others")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary(rows: DataFrame, truth: Column, guess: Column, digits: int = 3) -> DataFrame:
    c = rows.select(truth.alias("t"), guess.alias("g")).agg(F.count_if(F.col("t") & F.col("g")).alias("tp"), F.count_if(~F.col("t") & F.col("g")).alias("fp"), F.count_if(F.col("t") & ~F.col("g")).alias("fn"), F.count_if(~F.col("t") & ~F.col("g")).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn", rounded(ratio(tp + tn, tp + fp + fn + tn), digits).alias("accuracy"), rounded(p, digits).alias("precision"), rounded(r, digits).alias("recall"), rounded(ratio(2 * p * r, p + r), digits).alias("f1"))


def confusion(rows: DataFrame, truth: str, guess: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """All pairs of classes, zero-filled: the grid is made of the few classes, not of rows."""
    spark = rows.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias(truth), F.lit(b).alias(guess)) for a in classes for b in classes])).alias("c")).select("c.*")
    counts = rows.groupBy(truth, guess).agg(F.count("*").alias("n"))
    return grid.join(counts, [truth, guess], "left").select(truth, guess, F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame, truth: str, guess: str, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One against the rest. Precision and recall are rounded to three digits before F1."""
    one = matrix.select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"), truth, guess, "n")
    t, g = F.col(truth) == F.col("class"), F.col(guess) == F.col("class")
    c = one.groupBy("class").agg(F.sum(F.when(t & g, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~t & g, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(t & ~g, F.col("n")).otherwise(0)).alias("fn"))
    c = c.withColumn("precision", rounded(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 3)).withColumn("recall", rounded(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 3))
    return c.withColumn("f1", rounded(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 3)).withColumn("support", F.col("tp") + F.col("fn"))


def macro(scores: DataFrame) -> DataFrame:
    """Means over the classes of :func:`per_class` that occur; three digits. Under two such classes
    there is nothing to compare, and the means are null."""
    some = scores.where("support > 0")
    several = F.count("*") >= 2
    return some.agg(F.count("*").alias("classes"), F.sum("support").alias("support"), *[F.when(several, rounded(F.avg(c), 3)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def mcc(matrix: DataFrame, truth: str, guess: str) -> DataFrame:
    """Multiclass correlation in closed form from the matrix's margins."""
    t = matrix.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("tt"))
    p = matrix.groupBy(guess).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("pp"))
    both = matrix.groupBy(F.col(truth).alias("k")).agg(F.sum("n").alias("t")).join(matrix.groupBy(F.col(guess).alias("k")).agg(F.sum("n").alias("p")), "k").agg(F.sum(F.col("t") * F.col("p")).cast("double").alias("tp"))
    whole = matrix.agg(F.sum("n").cast("double").alias("s"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).cast("double").alias("c"))
    one = whole.crossJoin(t).crossJoin(p).crossJoin(both)  # four single rows
    bottom = F.sqrt(F.col("s") * F.col("s") - F.col("pp")) * F.sqrt(F.col("s") * F.col("s") - F.col("tt"))
    return one.select(F.col("s").cast("long").alias("support"), rounded(F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), bottom), F.lit(0.0)), 3).alias("mcc"))


def _runs(grams: str, side: int) -> tuple[Column, Column]:
    """Of a sorted array, where its runs of equal values begin; and, from that column named ``<grams>_at``, each value
    with its number, as ``struct<g,side,n>``."""
    begin = F.filter(F.when(F.size(grams) > 0, F.sequence(F.lit(0), F.size(grams) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(grams, i) != F.get(grams, F.greatest(i - 1, F.lit(0)))))
    at = f"{grams}_at"
    return begin.alias(at), F.transform(at, lambda p, k: F.struct(F.get(grams, p).alias("g"), F.lit(side).alias("side"), (F.coalesce(F.get(at, k + 1), F.size(grams)) - p).alias("n")))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """Clipped overlap of ``hypothesis`` and ``reference`` per row, with its ``id``; four digits. The grams of a pair
    are sorted and counted within the row, nothing is shuffled."""
    words = lambda c: text.tokens(F.col(c), 1)
    grams = lambda c: F.sort_array(words(c) if n == 1 else text.ngrams(words(c), n))
    rows = pairs.select("id", grams("hypothesis").alias("h"), grams("reference").alias("r"))
    (h_at, h), (r_at, r) = _runs("h", 0), _runs("r", 1)
    rows = rows.select("*", h_at, r_at).select("id", F.size("h").alias("nh"), F.size("r").alias("nr"), F.sort_array(F.concat(h, r)).alias("all"))
    # the two sides of a gram are neighbours
    shared = F.transform("all", lambda x, i: F.when(x["g"] == F.get("all", i + 1)["g"], F.least(x["n"], F.get("all", i + 1)["n"])).otherwise(0))
    t = rows.select("id", "nh", "nr", F.aggregate(shared, F.lit(0), lambda a, x: a + x).alias("o"))
    p, r = ratio(F.col("o"), F.col("nh")), ratio(F.col("o"), F.col("nr"))
    t = t.select("id", p.alias("p"), r.alias("r"))
    p, r = F.col("p"), F.col("r")
    return t.select("id", rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(ratio(2 * p * r, p + r), 4).alias("f1"))


def _lcs(a: list[str], b: list[str]) -> int:
    """By bit vectors: a row of the table is one integer."""
    places: dict[str, int] = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        m = places.get(w, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _lengths(rows: DataFrame) -> DataFrame:
    """``id, lcs, nh, nr`` of the word arrays ``h`` and ``r``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            yield pd.DataFrame({"id": x.id, "lcs": [_lcs(list(a), list(b)) for a, b in zip(x.h, x.r, strict=True)], "nh": [len(a) for a in x.h], "nr": [len(b) for b in x.r]})

    return rows.select("id", "h", "r").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, lcs long, nh long, nr long")


def rouge_l(pairs: DataFrame) -> DataFrame:
    t = _lengths(pairs.select("id", text.tokens(F.col("hypothesis"), 1).alias("h"), text.tokens(F.col("reference"), 1).alias("r")))
    p, r = ratio(F.col("lcs"), F.col("nh")), ratio(F.col("lcs"), F.col("nr"))
    return t.select("id", rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(ratio(2 * p * r, p + r), 4).alias("f1"))


def rouge_stemmed(pairs: DataFrame) -> DataFrame:
    """``id, rouge1_f, rouge2_f, rougel_f`` of stemmed words; four digits. A pair of which one text has no words
    scores zero."""
    rows = stems(pairs.select("id", "hypothesis", "reference"), {"hypothesis": "h", "reference": "r"})

    def overlap(a: list[str], b: list[str], n: int) -> tuple[int, int, int]:
        x, y = (Counter(zip(*(w[k:] for k in range(n)))) for w in (a, b))
        return sum((x & y).values()), x.total(), y.total()

    def f(shared: int, na: int, nb: int) -> float:
        return 2 * (shared / na) * (shared / nb) / (shared / na + shared / nb) if shared else 0.0

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            both = [(list(a), list(b)) for a, b in zip(x.h, x.r, strict=True)]
            yield pd.DataFrame({"id": x.id, "one": [f(*overlap(a, b, 1)) for a, b in both], "two": [f(*overlap(a, b, 2)) for a, b in both], "lcs": [f(_lcs(a, b), len(a), len(b)) for a, b in both]})

    t = rows.select("id", "h", "r").mapInPandas(run, f"id {dict(rows.dtypes)['id']}, one double, two double, lcs double")
    return t.select("id", *[rounded(F.col(c), 4).alias(n) for c, n in (("one", "rouge1_f"), ("two", "rouge2_f"), ("lcs", "rougel_f"))])


def cosine(pairs: DataFrame) -> DataFrame:
    """TF-IDF cosine of each pair on the corpus of its two texts; four digits."""
    side = lambda c: pairs.select("id", text.tokens(F.col(c), 1).alias("t")).select("id", F.size("t").alias("n"), F.explode("t").alias("w")).groupBy("id", "n", "w").agg(F.count("*").alias("c"))
    h, r = side("hypothesis"), side("reference")
    both = h.select("id", "w", (F.col("c") / F.col("n").cast("double")).alias("h")).join(r.select("id", "w", (F.col("c") / F.col("n").cast("double")).alias("r")), ["id", "w"], "full")
    idf = F.log(3.0 / (1 + F.when(F.col("h").isNotNull(), 1).otherwise(0) + F.when(F.col("r").isNotNull(), 1).otherwise(0))) + 1
    v = both.select("id", (F.coalesce("h", F.lit(0.0)) * idf).alias("a"), (F.coalesce("r", F.lit(0.0)) * idf).alias("b"))
    s = v.groupBy("id").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    return pairs.select("id").join(s, "id", "left").select("id", rounded(F.coalesce(F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)), 4).alias("cosine"))


def batch_mean(scores: DataFrame) -> DataFrame:
    """Of already rounded scores."""
    return scores.agg(F.count("*").alias("samples"), *[rounded(F.avg(c), 4).alias(c) for c in scores.columns if c != "id"])


def fields(rows: DataFrame, names: list[str], soft: bool = False) -> DataFrame:
    """Per field P/R/F1 of ``x_<name>`` against ``g_<name>``, and their micro average; a wrong value
    is a false positive only. Soft: either holds the other."""
    long = rows.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', x_{n}, g_{n}" for n in names) + ") AS (field, x, g)"))
    x, g = F.lower(F.trim(text.text_of("x"))), F.lower(F.trim(text.text_of("g")))
    same = (x == g) | (x.contains(g) | g.contains(x) if soft else F.lit(False))
    c = long.groupBy("field").agg(F.count_if((x != "") & (g != "") & same).alias("tp"), F.count_if((x != "") & ~((g != "") & same)).alias("fp"), F.count_if((x == "") & (g != "")).alias("fn"))
    every = c.unionByName(c.agg(F.lit("micro").alias("field"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return every.select("field", "tp", "fp", "fn", rounded(p, 4).alias("precision"), rounded(r, 4).alias("recall"), rounded(ratio(2 * p * r, p + r), 4).alias("f1"))
