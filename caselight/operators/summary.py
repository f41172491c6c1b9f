"""Extractive summaries: TextRank, TF-IDF sentence scores, MMR; and OCR word boxes.

Ranking and selection are per-document algorithms on a few hundred sentences, so they run in Arrow
batches; everything before and after is DataFrame work.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from caselight.functions import text
from caselight.functions.text import rounded, text_of

# Keywords of each kind of source, and the ranking's constants.
CLINICAL = "adverse reaction drug medication dose onset serious hospital death fatal report patient outcome recovery dechallenge rechallenge causality seriousness reporter".split()
CHECKLIST = "checklist mandatory required submit application approval clinical trial licence import biological schedule annex deficiency missing document attached form section".split()
MEETING = "decision action resolved agreed pending minutes agenda follow-up deadline responsible review approved noted assigned owner next step discussed concluded".split()
KEYWORDS = {"sae": CLINICAL, "checklist": CHECKLIST, "meeting": MEETING}
DAMPING, ROUNDS, TEXTRANK_BOOST, MMR = 0.85, 30, 0.15, 0.6
LEAST_CHARS, TEXTRANK_FROM = 50, 6
EXACT = 11
TFIDF_BOOST = 1.8


def keyword_hits(c: Column, kind: str = "sae") -> Column:
    low = F.lower(c)
    return F.size(F.filter(F.array(*[F.lit(k) for k in KEYWORDS[kind]]), lambda k: low.contains(k)))


def _scored(docs: DataFrame, kind: str) -> DataFrame:
    """``docs`` with ``sentences`` and their ``scores``, made document by document: nothing is shuffled, and a text's
    memory grows with its words."""
    rows = docs.select("*", text.capital_sentences(F.col("text")).alias("sentences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([_own_scores(x, kind).tolist() for x in b.column("sentences").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "scores"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("scores", ArrayType(DoubleType()))]))


def sentence_scores(docs: DataFrame, kind: str = "sae") -> DataFrame:
    """TF-IDF score of each sentence: mean of frequency times idf, and keywords, weighted by
    position and length. A row is a document."""
    return _scored(docs.select("doc_id", "text"), kind).select("doc_id", F.posexplode("scores").alias("position", "score"))


_PUNCT = re.compile(r"[^a-z0-9\s]")


def _tokens(s: str) -> list[str]:
    return [w for w in _PUNCT.sub(" ", s.lower()).split() if len(w) > 2]


def _sentence_counts(places: dict[str, np.ndarray]) -> dict[str, int]:
    """In how many sentences each word occurs as a substring, from the sentences of each distinct token. A
    word of letters and digits lies within one token, so tokens are cut at the lengths that words have."""
    lengths = sorted({len(w) for w in places})
    holders: dict[str, list[str]] = {}
    for token in places:
        held = {token[k : k + n] for n in lengths if n <= len(token) for k in range(len(token) - n + 1)}
        for w in held & places.keys():
            holders.setdefault(w, []).append(token)
    return {w: len(places[w]) if len(tokens) == 1 else len(np.unique(np.concatenate([places[t] for t in tokens]))) for w, tokens in holders.items()}


class SentenceGraph:
    """Sentences that are linked by the cosine of their TF-IDF vectors, never written out pair by pair: the
    vectors are columns of (sentence, word, weight), and sums over links are two passes over them, so memory
    grows with the tokens. A word's document frequency counts sentences that contain it as a substring."""

    def __init__(self, sentences: list[str]):
        bags = [_tokens(s) for s in sentences]
        numbers: dict[str, int] = {}
        rows, words, weights = [], [], []
        for n, bag in enumerate(bags):
            for w, count in Counter(bag).items():
                rows.append(n)
                words.append(numbers.setdefault(w, len(numbers)))
                weights.append(count / len(bag))
        self.n, self.rows, self.words = len(bags), np.array(rows, np.int64), np.array(words, np.int64)
        order = np.argsort(self.words, kind="stable")
        starts = np.searchsorted(self.words[order], np.arange(len(numbers) + 1))
        places = {w: self.rows[order[starts[k] : starts[k + 1]]] for w, k in numbers.items()}
        df = _sentence_counts(places)
        idf = np.array([log((self.n + 1) / (df[w] + 1)) + 1 for w in numbers])
        values = np.array(weights) * idf[self.words] if len(rows) else np.zeros(0)
        norm = np.sqrt(self._by_sentence(values * values))
        self.values = values / np.maximum(norm, 1e-300)[self.rows]
        self.own = self._by_sentence(self.values * self.values)
        self.vocabulary = len(numbers)

    def _by_sentence(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=x, minlength=self.n)

    def linked(self, u: np.ndarray) -> np.ndarray:
        """For each sentence the sum of ``u`` over the others, weighted by their cosines."""
        by_word = np.bincount(self.words, weights=self.values * u[self.rows], minlength=self.vocabulary)
        return self._by_sentence(self.values * by_word[self.words]) - self.own * u

    def similar(self, at: int) -> np.ndarray:
        """The cosine of each sentence with one."""
        mine = self.rows == at
        vector = np.zeros(self.vocabulary)
        vector[self.words[mine]] = self.values[mine]
        return self._by_sentence(self.values * vector[self.words])


def _textrank(graph: SentenceGraph) -> np.ndarray:
    total = graph.linked(np.ones(graph.n))
    some = total > 0
    scores = np.full(graph.n, 1 / graph.n)
    for _ in range(ROUNDS):
        scores = (1 - DAMPING) / graph.n + DAMPING * graph.linked(np.divide(scores, total, out=np.zeros(graph.n), where=some))
    return scores


def _choose(scores: np.ndarray, graph: SentenceGraph, k: int) -> list[int]:
    """Greedy by relevance less redundancy; the earlier in rank wins ties. Numbers that differ by less
    than sums are exact to are ties, so the order of summing decides nothing."""
    scores = np.round(scores, EXACT)
    rank = np.argsort(-scores, kind="stable")
    chosen = [int(rank[0])]
    nearest = graph.similar(chosen[0])
    while len(chosen) < min(k, len(scores)):
        worth = np.round(MMR * scores - (1 - MMR) * nearest, EXACT)
        worth[chosen] = float("-inf")
        chosen.append(int(rank[np.argmax(worth[rank])]))
        nearest = np.maximum(nearest, graph.similar(chosen[-1]))
    return sorted(chosen)


def _own_scores(sentences: list[str], kind: str) -> np.ndarray:
    """:func:`sentence_scores` of one document."""
    bags = [_tokens(s) for s in sentences]
    freq, df = Counter(w for bag in bags for w in bag), Counter(w for bag in bags for w in set(bag))
    out = []
    for n, (s, bag) in enumerate(zip(sentences, bags, strict=True)):
        if not bag:
            out.append(0.0)
            continue
        x = sum(freq[w] * (log((len(bags) + 1) / (df[w] + 1)) + 1) for w in bag) / len(bag)
        place = 2.5 if n == 0 else 1.5 if n < len(bags) * 0.25 else 0.8 if n > len(bags) * 0.75 else 1.0
        length = 0.5 if len(bag) < 5 else 0.8 if len(bag) > 50 else 1.0
        out.append(floor((x + sum(k in s.lower() for k in KEYWORDS[kind]) * TFIDF_BOOST) * place * length * 1000 + 0.5) / 1000)
    return np.array(out)


def _summary(source: str, sentences: list[str], kind: str, most: int) -> tuple[str, str, int]:
    if len(source.strip()) < LEAST_CHARS:
        return source, "passthrough", 100
    if len(sentences) <= most:
        return source.strip(), "full-text", 100
    graph = SentenceGraph(sentences)
    if len(sentences) >= TEXTRANK_FROM:
        method = "textrank-mmr"
        scores = _textrank(graph) + np.array([TEXTRANK_BOOST * sum(k in s.lower() for k in KEYWORDS[kind]) for s in sentences])
    else:
        method, scores = "tfidf-mmr", _own_scores(sentences, kind)
    out = re.sub(r"\.\s*\.", ".", ". ".join(sentences[n] for n in _choose(scores, graph, most))).rstrip()
    return (out if out.endswith(".") else out + "."), method, int(100 * len(out) / len(source) + 0.5)


def leading_by_score(docs: DataFrame, kind: str = "sae", most: int = 3) -> DataFrame:
    """``doc_id, summary`` and the other columns but ``text``: the ``most`` best sentences by :func:`sentence_scores`, in
    their order, the earlier of equal ones; the whole text where it has no more. Documents without sentences have
    their text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    ranked = F.array_sort(F.transform("scores", lambda x, i: F.struct((-x).alias("order"), i.alias("position"))))
    rows = _scored(docs, kind).select("*", F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: x["position"])).alias("_best"))
    joined = F.concat(F.array_join(F.transform("_best", lambda i: F.get("sentences", i)), ". "), F.lit("."))
    return rows.select("doc_id", F.when(F.size("sentences") > most, joined).otherwise(text.trimmed(text_of("text"))).alias("summary"), *rest)


def summarise(docs: DataFrame, kind: str = "sae", most: int | None = None) -> DataFrame:
    """``doc_id, summary, method, compression`` (summary over source, in percent). A text's memory grows with
    its words; nothing is joined."""
    most = most or (5 if kind == "meeting" else 3)
    rows = docs.select("doc_id", text_of("text").alias("source"), text.capital_sentences(F.col("text")).alias("sentences"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            made = [_summary(s, list(parts), kind, most) for s, parts in zip(x.source, x.sentences, strict=True)]
            yield pd.DataFrame({"doc_id": x.doc_id, "summary": [m[0] for m in made], "method": [m[1] for m in made], "compression": [m[2] for m in made]})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, summary string, method string, compression int")


# Patterns for a window of words, the first that fits wins.
BOX_PATTERNS = (("Aadhaar", r"\d{4}\s?\d{4}\s?\d{4}"), ("PAN", r"[A-Z]{5}\d{4}[A-Z]"), ("Indian phone", r"(\+91[\s-]?)?[6-9]\d{9}"), ("Email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"), ("MRN/UHID", r"(?i)(MRN|UHID|IP|OP|CR|HID)[-/]?\s*\d{4,12}"))


BOX_WORDS, BOX_CHARS = 5, 60
#: Layout of words that have no boxes of their own: words to a row, and the sizes of cells, rows and letters.
ROW_WORDS, CELL, ROW, LETTER = 10, 120, 14, 6


def laid_out(docs: DataFrame) -> DataFrame:
    """``doc_id, words``: a document's words with boxes on a grid, by their place, and a confidence that grows with
    their length; for texts that come without a scan."""
    words = F.filter(F.split(text_of("text"), r"\s+"), lambda w: w != "")
    box = lambda w, i: F.struct(
        w.alias("text"), F.least(F.lit(1.0), F.length(w) / 10.0).alias("confidence"), (i % ROW_WORDS * CELL).cast("int").alias("x0"), (F.floor(i / ROW_WORDS) * ROW).cast("int").alias("y0"),
        (i % ROW_WORDS * CELL + F.length(w) * LETTER).cast("int").alias("x1"), (F.floor(i / ROW_WORDS) * ROW + ROW - 2).cast("int").alias("y1"),
    )
    return docs.select("doc_id", F.transform(words, box).alias("words"))


def pii_boxes(pages: DataFrame) -> DataFrame:
    """Boxes around identifiers in ``words`` (array of text, x0, y0, x1, y1): windows of up to ``BOX_WORDS`` words and
    ``BOX_CHARS`` characters, emptied after a hit. One fold over a page's words, tried only where its words,
    joined, match at all (patterns know no borders, so what a window matches the page matches too)."""
    whole = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    some = whole.rlike("|".join(f"(?:{pattern})" for _, pattern in BOX_PATTERNS))
    none = F.array().cast(pages.schema["words"].dataType)

    def kind(window: Column) -> Column:
        """(No pattern fits where there is neither a digit nor an at sign.)"""
        out = F.when(F.lit(False), "")
        for name, pattern in BOX_PATTERNS:
            out = out.when((window.contains("@") if "@" in pattern else F.lit(True)) & window.rlike(pattern), name)
        return F.when(window.rlike("[0-9@]"), out)

    def let(value: Column, body) -> Column:
        """``body`` of a value that is made once."""
        return F.get(F.transform(F.array(value), body), 0)

    empty = F.struct(F.lit("").alias("window"), none.alias("held"), F.expr("CAST(array() AS array<struct<kind:string,x0:int,y0:int,x1:int,y1:int,words:int>>)").alias("out"))

    def step(state: Column, w: Column) -> Column:
        joined = F.trim(F.concat(state["window"], F.lit(" "), w["text"]))
        window = F.substring(joined, F.greatest(F.length(joined) - (BOX_CHARS - 1), F.lit(1)), F.lit(BOX_CHARS))
        held = F.concat(F.slice(state["held"], F.greatest(F.size(state["held"]) - (BOX_WORDS - 2), F.lit(1)), F.lit(BOX_WORDS - 1)), F.array(w))

        def moved(x: Column) -> Column:
            edge = lambda f, name: f(F.transform(x["held"], lambda h: h[name]))
            hit = F.struct(x["kind"].alias("kind"), edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"), F.size(x["held"]).alias("words"))
            found = F.struct(F.lit("").alias("window"), F.slice(x["held"], F.lit(1), F.lit(0)).alias("held"), F.concat(state["out"], F.array(hit)).alias("out"))
            return F.when(x["kind"].isNull(), F.struct(x["window"].alias("window"), x["held"].alias("held"), state["out"].alias("out"))).otherwise(found)

        return let(window, lambda v: let(F.struct(v.alias("window"), held.alias("held"), kind(v).alias("kind")), moved))

    rows = pages.select("doc_id", "words").where(some)
    folded = rows.select("doc_id", F.aggregate("words", empty, step)["out"].alias("out"))
    # (the outer form: else the optimizer adds a filter on the fold's size, and folds again for it)
    return folded.select("doc_id", F.explode_outer("out").alias("x")).where("x is not null").select("doc_id", "x.*")


def ocr_confidence(pages: DataFrame) -> DataFrame:
    """Mean confidence of the words above one half; 0.3 where there is none."""
    good = F.filter("words", lambda w: w["confidence"] > 0.5)
    total = F.aggregate(good, F.lit(0.0), lambda a, w: a + w["confidence"])
    return pages.select("doc_id", rounded(F.coalesce(F.try_divide(total, F.size(good).cast("double")), F.lit(0.3)), 4).alias("confidence"))
