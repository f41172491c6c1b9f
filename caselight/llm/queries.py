"""The queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_blocks, licenses, lines, merkle, negatives, packing, pii, quality, simhash, substring, suffixes, topk
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_every(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("rest.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_blocks.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.extract(table(spark, sf_dir, "documents"))
    # (a second parameter of the lambda would be the place in the array)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % negatives.ANCHOR_EVERY == 0, label)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places, base = F.transform("places", lambda x: x["place"]), F.transform("places", lambda x: x["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), text(base).alias("base_labels"), text(F.concat(base, "notices")).alias("labels"), "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``folded_root`` is made anew for every row, from the tampered leaf or else its own, by its proof."""
    out = merkle.manifest(table(spark, sf_dir, "documents"))
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_topk": op2_topk,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op6_lines": op6_lines,
    "op7_suffixes": op7_suffixes,
    "op8_substring": op8_substring,
    "op9_html": op9_html,
    "op10_pii": op10_pii,
    "op11_negatives": op11_negatives,
    "op12_licenses": op12_licenses,
    "op13_merkle": op13_merkle,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"'[\x20\x09-\x0D]+'"
#: Words of each document with their positions, from 1.
_WORDS = rf"w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {_SPACE}), lambda x: x <> '') AS words FROM documents)"


def _windows(size: int) -> str:
    """Windows that also start in a smaller document: ``doc_id, i, first``."""
    return f"""{_WORDS}, x AS (SELECT doc_id, unnest(range(1, len(words) - {size - 2})) AS i, words FROM w WHERE len(words) >= {size}),
h AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + {size - 1}], ' ')) AS h FROM x), f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY 1),
gone AS (SELECT doc_id, i, first FROM h JOIN f USING (h) WHERE doc_id > first)"""


def _licenses() -> str:
    """Every block with every template of its length, without filters."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for label, text in licenses.TEMPLATES:
        words = re.findall("[a-z0-9]+", text.lower())
        run, held = max(licenses.LEAST_RUN, 2 ** math.ceil(math.log2(len(words)))), sorted(set(words))
        rows.append(f"('{label}', {run}, {math.ceil(licenses.THRESHOLD * len(held) - 1e-9)}, {quoted(held)})")
    places = " UNION ALL ".join(f"SELECT rid, '{label}' AS label, i FROM (SELECT rid, words, unnest(range(0, len(words))) AS i FROM w) WHERE words[i + 1:i + {len(phrase.split())}] = {quoted(phrase.split())}" for phrase, label in licenses.PHRASES)
    return rf"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
t(label, run, k, words) AS MATERIALIZED (VALUES {", ".join(rows)}),
b AS MATERIALIZED (SELECT rid, run, s, list_distinct(words[s + 1:s + 2 * run]) AS held FROM (SELECT rid, run, words, unnest(range(0, len(words), run)) AS s FROM w, (SELECT DISTINCT run FROM t))),
m AS MATERIALIZED (SELECT rid, b.run, s, label, list_intersect(held, t.words) AS shared, len(list_intersect(held, t.words)) / len(t.words) AS share FROM b JOIN t ON b.run = t.run AND len(list_intersect(held, t.words)) >= k),
z AS (SELECT rid, label, share FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS o WHERE o.rid = m.rid AND o.run = m.run AND o.s = m.s AND (len(o.shared), o.share) > (len(m.shared), m.share) AND list_has_all(o.shared, m.shared))),
p AS MATERIALIZED ({places}),
q AS (SELECT rid, count(*) AS n, min(i) AS a, max(i) AS e, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY 1),
a AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (SELECT rid, label, 1.0 AS share FROM p UNION ALL SELECT * FROM z) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, e AS last_word, coalesce(q.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CAST(coalesce(share, 0) AS DOUBLE) AS score FROM w LEFT JOIN q USING (rid) LEFT JOIN a USING (rid)"""


def _merkle(lower: int = 8, upper: int = 4) -> str:
    """Levels are written out: enough for 8 ** ``lower`` rows of a language and 8 ** ``upper`` languages."""
    fan = merkle.FAN
    text = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
    head = " || ".join(text.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bit = "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    crc = f"list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda x, b: list_reduce(range(8), lambda a, i: {bit}, xor(x, b)), 4294967295)"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256({head} || {text.format('text')}) AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN sha256({head} || {text.format(_LOWER.format('text'))}) END AS spoilt FROM documents)",
        "a0 AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d)",
    ]

    def levels(name: str, runs: str, count: int) -> None:
        for k in range(count):
            steps.append(f"{runs}{k} AS MATERIALIZED (SELECT tree, pos // {fan} AS pos, list(h ORDER BY pos) AS kids, max(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // {fan})")
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, pos, sha256(array_to_string(kids, '')) AS h, (n + {fan - 1}) // {fan} AS n FROM {runs}{k})")

    levels("a", "b", lower)
    tops = " UNION ALL ".join(f"SELECT tree, h FROM a{k} WHERE n = 1" for k in range(lower + 1))
    steps.append(f"s AS MATERIALIZED (SELECT tree AS name, h AS subroot FROM ({tops}))")
    steps.append("u0 AS MATERIALIZED (SELECT name, '' AS tree, subroot AS h, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM s)")
    levels("u", "v", upper)
    steps.append("r AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT h AS root FROM u{k} WHERE n = 1" for k in range(upper + 1)) + ")")
    steps.append("f0 AS (SELECT a0.doc_id, a0.tree, leaf, subroot, a0.pos, u0.pos AS top, '' AS proof, coalesce(spoilt, leaf) AS f FROM a0 JOIN s ON tree = name JOIN u0 USING (name))")
    for j, (runs, place, k) in enumerate([("b", "pos", k) for k in range(lower)] + [("v", "top", k) for k in range(upper)]):
        own = f"(x.{place} // {fan**k}) % {fan}"
        left, right = f"coalesce(array_to_string(kids[1:{own}], ''), '')", f"coalesce(array_to_string(kids[{own} + 2:], ''), '')"
        tree = "y.tree = x.tree" if runs == "b" else "true"
        steps.append(f"f{j + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (proof, f), proof || {left} || {right} AS proof, CASE WHEN kids IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f FROM f{j} AS x LEFT JOIN {runs}{k} AS y ON {tree} AND y.pos = x.{place} // {fan ** (k + 1)})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{lower + upper}, r"


SQL: dict[str, str] = {
    "op11_negatives": """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op12_licenses": _licenses(),
    "op13_merkle": _merkle(),
    "op2_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10""",
    "op6_lines": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1""",
    "op7_suffixes": f"""WITH {_windows(suffixes.WINDOW)},
o AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffixes.WINDOW} THEN 0 ELSE 1 END AS new FROM gone),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o)
SELECT doc_id, min(i) - 1 AS start_word, max(i) - min(i) + {suffixes.WINDOW} AS n_words, arg_min(first, i) AS first_doc_id FROM p GROUP BY doc_id, span""",
    "op8_substring": f"""WITH {_windows(substring.WINDOW)}, c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring.WINDOW})) AS j FROM gone),
p AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS j, unnest(words) AS word FROM w),
m AS (SELECT p.*, c.j IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.j = c.j),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)""",
}
