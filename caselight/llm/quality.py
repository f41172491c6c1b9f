"""Quality rules: a decision list learned by sequential covering, applied as a Spark conditional.

Statistics of a text are DataFrame expressions only. The list is learned from statistics of a
bounded sample of labelled documents (``SAMPLE`` rows, by hash of the id): a rule grows one
threshold after another by information gain on two thirds of the sample, is pruned from its end
on the other third, and is kept if it is precise there; the documents it covers are set aside and
the next rule grows on the rest. What an imprecise rule covered seeds no other. The list becomes one ordered ``CASE`` expression.

Defined results: null and empty texts have no words (so the base fails); labels that are missing,
null or of one class only give an empty list, which keeps all that the base keeps; repeated rows
each give a row; an empty table gives an empty table; other columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS

MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: The learner's bounds: labelled rows, thresholds a statistic, rules, rules tried, conditions a rule, and the
#: precision and support that a rule needs on the rows that it did not grow on.
SAMPLE = 20_000
THRESHOLDS = 40
MAX_RULES = 8
MAX_TRIES = 40
MAX_CONDITIONS = 3
MIN_PRECISION = 0.97
MIN_SUPPORT = 5

FEATURES = ("symbol_share", "mean_word", "dup_line_share", "repeat_share", "upper_share", "mark_share", "n_words")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "!?;:=\"'(){}[]/\\~^_+"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics and the learner's features; text's columns come last."""
    rest = F.struct(*[F.col(c) for c in docs.columns]).alias("rest")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(rest, text.alias("_t"), F.btrim(text, F.lit(SPACE_CHARS)).alias("_s"))
    two = one.select(
        "rest",
        F.length("_t").alias("_chars"),
        F.length(F.translate("_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        _without(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("_t"), _UPPER).alias("_upper"),
        _without(F.col("_t"), _MARKS).alias("_marks"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0).alias("_lines"),
        F.when(F.length("_s") > 0, F.split("_s", r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("_w"),
    )
    two = two.withColumn("_w", F.transform("_w", lambda x: F.xxhash64(x)))
    # (element by element: in a lambda, slice() copies the whole array each time)
    windows = F.when(F.size("_w") >= REPEAT_WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - REPEAT_WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(REPEAT_WINDOW)])))
    three = two.select(
        "rest", "word_chars", "n_symbols", "_upper", "_marks",
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    # only texts in which some window comes twice need to know which
    four = three.withColumn("_p", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter("_p", lambda x, k: ((k > 0) & (F.get("_p", k - 1)["h"] == x["h"])) | F.coalesce(F.get("_p", k + 1)["h"] == x["h"], F.lit(False)))
    five = four.withColumn("_q", F.sort_array(F.transform(again, lambda x: x["i"])))
    reach = F.transform("_q", lambda i, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("_q", k + 1) - i, F.lit(REPEAT_WINDOW))))
    six = five.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return six.select(
        "rest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_upper") / chars).alias("upper_share"),
        (F.col("_marks") / chars).alias("mark_share"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def holds(self, row: dict) -> bool:
        return (row[self.feature] >= self.threshold) == self.above


Rule = tuple[Condition, ...]


def learn(rows: list[dict]) -> list[Rule]:
    """Rules for ``bad`` rows, from dicts of the features, ``bad`` and ``fold`` (0, 1, 2)."""
    if len({r["bad"] for r in rows}) < 2:
        return []

    def mask(of) -> int:
        return int("".join("1" if of(r) else "0" for r in rows), 2)

    bad, held_out = mask(lambda r: r["bad"]), mask(lambda r: r["fold"] == 2)
    everything = (1 << len(rows)) - 1
    conditions: dict[Condition, int] = {}
    for name in FEATURES:
        values = sorted({r[name] for r in rows})
        step = max(1, len(values) // THRESHOLDS)
        for v in values[step::step]:
            # (a number of few digits, so that the list can be read)
            for above in (True, False):
                c = Condition(name, above, float(f"{v:.4g}"))
                conditions[c] = mask(c.holds)

    def covered(rule: Rule, among: int) -> tuple[int, int]:
        for c in rule:
            among &= conditions[c]
        return (among & bad).bit_count(), (among & ~bad & everything).bit_count()

    rules: list[Rule] = []
    left = everything
    skipped = 0  # bad rows that no precise rule was found for: they seed no other
    for _ in range(MAX_TRIES):
        if len(rules) == MAX_RULES:
            break
        grow, prune = left & ~held_out & ~skipped & everything, left & held_out
        rule: Rule = ()
        p, n = covered(rule, grow)
        if not p:
            break
        while n and p and len(rule) < MAX_CONDITIONS:
            here = grow
            for c in rule:
                here &= conditions[c]
            best, gained = None, 1e-9
            base = log2(p / (p + n))
            for c, m in conditions.items():
                q = (here & m & bad).bit_count()
                if q:
                    gain = q * (log2(q / (here & m).bit_count()) - base)
                    if gain > gained:
                        best, gained = c, gain
            if best is None:
                break
            rule = (*rule, best)
            p, n = covered(rule, grow)
        tried = grow & bad
        for c in rule:
            tried &= conditions[c]
        worth = {}
        for k in range(1, len(rule) + 1):
            p, n = covered(rule[:k], prune)
            if p + n:
                worth[k] = (p - n) / (p + n)
        if not worth:
            if not rule:
                break
            skipped |= tried
            continue
        rule = rule[: max(worth, key=lambda k: (worth[k], -k))]
        p, n = covered(rule, prune)
        q, m = covered(rule, grow)
        if p < MIN_SUPPORT or p < MIN_PRECISION * (p + n) or q < MIN_PRECISION * (q + m):
            skipped |= tried
            continue
        rules.append(rule)
        for_all = left
        for c in rule:
            for_all &= conditions[c]
        left &= ~for_all & everything
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for a document that no rule rejects; the rules are tried in order."""
    out = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        all_hold = rule[0].column()
        for c in rule[1:]:
            all_hold &= c.column()
        out = out.when(all_hold, F.lit(False))
    return out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The decision list for ``quality`` 0 from at most ``sample`` labelled documents."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    # at most ``sample`` rows of two numbers
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")
    rows = statistics(chosen).select(*FEATURES, "base_failed", (F.col("rest.quality") == 0).alias("bad"), F.pmod(F.xxhash64("rest.doc_id", F.lit(3)), F.lit(3)).alias("fold")).limit(sample).collect()
    return learn([r.asDict() for r in rows if not r["base_failed"]])


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """:func:`statistics` of ``docs`` with ``kept``.

    The partition's number makes ``kept`` non-deterministic for the optimizer: a filter on it is
    else pushed below the projections, where all statistics would be made once more, some of them
    once for each element of an array.
    """
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & verdict(rules) & (F.spark_partition_id() >= 0))
