"""Personal data: fixed patterns, and bootstrapped contextual extraction.

The fixed patterns give base spans. They are the seeds of four kinds; a fifth kind, ``secret``, has
seeds of its own: long mixed values set to a name that says so. Around each seed, and around each
other string that is no plain word (a token with a digit, ``@``, ``_`` or marks between letters, or
a run of groups of digits, of any length), patterns are recorded: the two words before it, the words
on either side, the label before it (a word with its marks), and its own shape. Spark then scores
the pattern-instance graph in rounds: a pattern's score for a kind is the smoothed share of the
kind's confidence in all its instances (an unknown string counts against it, so a number that has a
card's shape but fails its checksum weakens the shape), an instance's confidence the noisy-or of its
patterns. In each round the support of every pattern is counted anew, from instances that are
confident by then, so that what was found induces patterns in turn. Patterns that are precise and
met enough distinct confident instances vote; strings they reach with enough confidence become spans
of that kind. Only contexts travel, never texts, and copies of a document count as one instance.

The base patterns are applied exactly as leftmost, non-overlapping, greedy matches but without a
backtracking engine where that is quadratic on long runs.

Defined results: null texts count as empty; rows with a null ``doc_id`` and repeated rows give a
row each; a string of two kinds is of the one it is more surely of, ties to the kind listed first;
an empty table gives an empty table; other columns are ignored (``masked`` passes them on).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import checkpointed, drop, saved

#: Kinds of the fixed patterns, then those that only this method has.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
ROUNDS = 3
#: A voting pattern's least score and number of distinct confident instances; an instance's least
#: confidence.
MIN_SCORE = 0.8
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
#: Added to a pattern's number of instances.
SMOOTHING = 0.5
#: Code points next to an instance in which its context is read, widened to whole words.
CONTEXT = 40
#: Longer patterns go by their hash.
LONG_PATTERN = 80

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9.]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LEXEME = re.compile(r"[^\W\d_]+|[^\w\s]")
_EDGE = "\"'.,;:!?()[]{}<>#$%&*|="
#: Where a string that is no plain word shows itself: runs of groups of digits, or such a character.
_GROUPS = re.compile(r"[(+]{0,2}[0-9]+(?:[ ().-]{1,3}[0-9]+)*")
_ODD = re.compile(r"[0-9@_]|[^\W\d_](?=[^\w\s'’-]{1,3}[^\W\d_])")
#: A label: a word, then its marks, right before an instance.
_LABEL = re.compile(r"([^\W\d_]+)\s{0,2}([:=#]{1,2})\s{0,2}([\"']?)$")
#: Seeds of secrets: names that say so, and values of letters and digits.
_SECRET = re.compile(r"(?:token|secret|password|passwd|pwd|(?:api|access|private)[ _-]?key)[\"']?\s{0,2}[:=]\s{0,2}([\"']?)([A-Za-z0-9+/_-]{16,})\1", re.IGNORECASE)


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts: list[tuple[int, int]] = []
        at = run.start()
        for part in run[0].split("."):
            if part:
                parts.append((at, at + len(part)))
            else:
                parts = []
            if len(parts) == 4:
                a, b = parts[0][0], parts[3][1]
                if all(len(p := text[x:y].lstrip("0")) <= 3 and int(p or 0) <= 255 for x, y in parts):
                    yield a, b
                parts = []
            at += len(part) + 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)``, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(k, a, b) for k, of in ((1, addresses), (2, cards), (3, phones)) for a, b in of(text)]
    return out


def secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        if _DIGIT.search(m[2]) and not m[2].isdigit():
            yield m.span(2)


def shape(token: str) -> str:
    """Digits as their number, letters as a class; a long mixed value by its length alone."""
    if len(token) >= 16 and token.isalnum() and not token.isdigit() and not token.isalpha():
        return f"x{len(token)}"
    return re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", lambda m: f"9{{{len(m[0])}}}", token))


def _patterns(text: str, start: int, end: int) -> list[str]:
    at, to = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    while at and start - at < 2 * CONTEXT and not text[at - 1].isspace():
        at -= 1
    while to < len(text) and to - end < 2 * CONTEXT and not text[to].isspace():
        to += 1
    left = text[at:start].lower()
    before, after = _LEXEME.findall(left)[-2:], [x.lower() for x in _LEXEME.findall(text[end:to])[:1]]
    out = [f"L {' '.join(before)}"] if len(before) == 2 else []
    # marks on both sides are a layout, not a context
    out += [f"M {before[-1]} _ {after[0]}"] if before and after and (before[-1].isalpha() or after[0].isalpha()) else []
    label = _LABEL.search(left)
    out += [f"P {' '.join(label.groups())}"] if label else []
    out.append(f"S {shape(text[start:end])}")
    return [p if len(p) <= LONG_PATTERN else f"{p[0]} #{xxhash.xxh3_128_hexdigest(p.encode())}" for p in out]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Strings that are no plain words and meet no span."""
    taken = sorted((a, b) for _, a, b in spans)
    k = done = 0
    at = 0
    while m := _ODD.search(text, at):
        a = m.start()
        while a > done and not text[a - 1].isspace():
            a -= 1
        b = _WORD.match(text, m.start()).end()
        groups = _GROUPS.match(text, a) or _GROUPS.match(text, m.start())
        if groups and (groups.end() >= b or text[groups.end() : b].strip(_EDGE) == ""):
            a, b = groups.span()
        at = max(b, m.end())
        token = text[a:b]
        a, b = a + len(token) - len(token.lstrip(_EDGE)), b - len(token) + len(token.rstrip(_EDGE))
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a < b and not (k < len(taken) and taken[k][0] < b):
            yield a, b
        done = at


_FOUND = "doc_id long, text_key long, spans array<struct<kind:int,start:int,end:int>>, contexts array<struct<kind:int,start:int,end:int,instance:long,patterns:array<string>>>"


def found(docs: DataFrame) -> DataFrame:
    """Base spans of each row, and the contexts of seeds and candidates (kind -1)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    like = to_arrow_schema(StructType.fromDDL(_FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_spans, all_contexts = [], []
            for x in b.column("text"):
                text = x.as_py()
                spans = base_spans(text)
                seeds = [*spans, *((len(KINDS), s, e) for s, e in secrets(text) if not any(a < e and s < b for _, a, b in spans))]
                marked = [*seeds, *((-1, s, e) for s, e in candidates(text, seeds))]
                all_spans.append([{"kind": k, "start": s, "end": e} for k, s, e in seeds])
                all_contexts.append([{"kind": k, "start": s, "end": e, "instance": xxhash.xxh3_64_intdigest(text[s:e].encode()) >> 1, "patterns": p} for k, s, e in marked if (p := _patterns(text, s, e))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(all_spans, like.field("spans").type), pa.array(all_contexts, like.field("contexts").type)], names=like.names)

    return docs.mapInArrow(run, _FOUND)


def scores(links: DataFrame, known: DataFrame) -> DataFrame:
    """``(pattern, kind, score, support)`` of the patterns that confident instances support, from
    ``links(instance, pattern)`` and ``known(instance, kind, confidence)``."""
    sure = F.col("confidence") >= MIN_CONFIDENCE
    held = links.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"), F.count(F.when(sure, 1)).alias("support"))
    size = links.groupBy("pattern").agg(F.count("*").alias("size"))
    both = held.where(F.col("support") >= MIN_SUPPORT).join(size, "pattern")
    return both.select("pattern", "kind", "support", (F.col("mass") / (F.col("size") + SMOOTHING)).alias("score"))


def bootstrap(contexts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(instance, kind)`` of candidates that high-confidence patterns reach, from rows
    ``(kind, instance, pattern)``."""
    edges = saved(contexts.select("kind", "instance", "pattern").distinct())
    seeds = saved(edges.where("kind >= 0").groupBy("instance").agg(F.min("kind").alias("kind"), F.lit(1.0).alias("confidence")))
    links = saved(edges.select("instance", "pattern").distinct())
    known, old = seeds, []
    for _ in range(rounds):
        # (written before it is joined: Spark splits a plain join's hot pattern)
        voting = saved(scores(links, known).where(F.col("score") >= MIN_SCORE))
        belief = links.join(voting, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("confidence"))
        best = belief.join(seeds.select("instance"), "instance", "left_anti").groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("m"))
        old += [voting, known]
        known = saved(seeds.unionByName(best.select("instance", (-F.col("m.k")).alias("kind"), F.col("m.confidence").alias("confidence"))))
    found = checkpointed(known.where(F.col("confidence") >= MIN_CONFIDENCE).join(seeds.select("instance"), "instance", "left_anti").select("instance", "kind"))
    drop(edges, links, known, *old)
    return found


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, base, spans``: arrays of ``struct<kind,start,end>`` by kind, then start."""
    first = checkpointed(found(docs))
    contexts = first.select(F.explode("contexts").alias("c")).select("c.kind", "c.instance", F.explode("c.patterns").alias("pattern"))
    learned = bootstrap(contexts).withColumnRenamed("kind", "learned")
    open_rows = first.select("doc_id", "text_key", F.explode("contexts").alias("c")).where("c.kind < 0").select("doc_id", "text_key", "c.start", "c.end", "c.instance").distinct()
    extra = open_rows.join(learned, "instance").groupBy(F.col("doc_id").alias("x_doc"), F.col("text_key").alias("x_key")).agg(F.collect_set(F.struct(F.col("learned").alias("kind"), "start", "end")).alias("extra"))
    both = first.join(extra, F.col("doc_id").eqNullSafe(F.col("x_doc")) & (F.col("text_key") == F.col("x_key")), "left")
    return both.select("doc_id", "text_key", F.filter("spans", lambda s: s["kind"] < len(KINDS)).alias("base"), F.when(F.col("extra").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "extra"))).alias("spans"))


def listed(spans: str) -> F.Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; spans that meet
    are replaced as one, by the first one's kind."""
    spans = extract(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("s_doc"), F.col("text_key").alias("s_key"), "spans").dropDuplicates(["s_doc", "s_key"])
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("rest"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    both = rows.join(spans, F.col("id").eqNullSafe(F.col("s_doc")) & (F.col("key") == F.col("s_key")), "left").select("rest", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
                text = x.as_py()
                if spans:
                    out, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            out += [text[at : s["start"]], f"<{ALL_KINDS[s['kind']].upper()}>"]
                        at = max(at, s["end"])
                    text = "".join([*out, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])

    return both.mapInArrow(run, f"rest {both.schema['rest'].dataType.simpleString()}, text string").select("rest.*", "text")
