"""Queries over documents, pages, conversations and small inline inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions import banding, text
from caselight.operators import documents as docs_ops
from caselight.operators import evaluation, extraction, identifiers, severity, summary
from caselight.session import once, spread
from caselight.sources import readers, writers

from .cases import cases, d, r, sql, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return put


def quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: list[tuple], names: str) -> str:
    """Inline rows for DuckDB."""
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, x)) + ')' for x in rows)}) AS t({names})"


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CLEAN = TRIM.format(r"regexp_replace(regexp_replace(replace({}, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
VALUE = TRIM.format(r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '[:|]+$', '', 'g')")
KEY = "lower(" + TRIM.format(r"regexp_replace({}, '\s+', ' ', 'g')") + ")"


def toks(x: str, more: int = 2) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) > {more})"


def sents(x: str, more: int = 10) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {TRIM.format('s')}), lambda s: length(s) > {more})"


@query("text_clean", f"SELECT doc_id, sha256({CLEAN.format('text')}) AS cleaned FROM documents")
def text_clean(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("cleaned"))


@query("text_value", f"SELECT doc_id, sha256({VALUE.format('text')}) AS cleaned FROM documents")
def text_value(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(text.clean_value(F.col("text")), 256).alias("cleaned"))


@query("text_tokens", f"SELECT doc_id, len({toks('text')}) AS n, len(list_distinct({toks('text')})) AS n_distinct, len({toks('text', 1)}) AS n_short FROM documents")
def text_tokens(spark, sf):
    t = text.tokens(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.size(text.tokens(F.col("text"), 1)).cast("long").alias("n_short"))


@query("token_frequency", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({toks('text')}) AS token FROM documents) GROUP BY 1")
def token_frequency(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token", "doc_id").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("documents"))


@query("bigrams", f"SELECT doc_id, greatest(0, len(t) - 1) AS n, sha256(array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|')) AS grams FROM (SELECT doc_id, {toks('text', 1)} AS t FROM documents)")
def bigrams(spark, sf):
    g = text.ngrams(F.col("t"), 2)
    return documents(spark, sf).select("doc_id", text.tokens(F.col("text"), 1).alias("t")).select("doc_id", F.size(g).cast("long").alias("n"), F.sha2(F.array_join(g, "|"), 256).alias("grams"))


@query("sentences", f"SELECT doc_id, len({sents('text')}) AS n, sha256(array_to_string({sents('text')}, '|')) AS joined FROM documents")
def sentences(spark, sf):
    s = text.sentences(F.col("text"))
    return documents(spark, sf).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "|"), 256).alias("joined"))


_CAPITAL = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*([A-Z])', chr(10) || chr(1) || '\1', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '\n+', ' ', 'g')), lambda s: length(s) > 20)"


@query("capital_sentences", f"SELECT doc_id, len({_CAPITAL}) AS n FROM documents")
def capital_sentences(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(text.capital_sentences(F.col("text"))).cast("long").alias("n"))


@query("hash_token", "SELECT doc_id, sha256(text) AS hash, CASE WHEN source = '' THEN '' ELSE 'SOURCE_TKN_' || upper(substr(sha256('source:' || source), 1, 10)) END AS token FROM documents")
def hash_token(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.sha256(F.col("text")).alias("hash"), text.token_for("source", F.col("source")).alias("token"))


_ASCII = "(SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM benchmark)"


@query("edit_distance", f"SELECT a.item_id, levenshtein(a.text, b.text) AS distance, {r('(levenshtein(' + KEY.format('a.text') + ', ' + KEY.format('b.text') + ') / CAST(nullif(length(' + KEY.format('b.text') + '), 0) AS DOUBLE))', 4)} AS cer FROM {_ASCII} a JOIN {_ASCII} b ON b.item_id = a.item_id + 1")
def edit_distance(spark, sf):
    """Characters beyond ASCII become one sign: the other engine counts bytes."""
    a = table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("text"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return a.join(b, "item_id").select("item_id", F.levenshtein("text", "other").cast("long").alias("distance"), text.cer(F.col("text"), F.col("other")).alias("cer"))


@query("wrapped_text")
def wrapped_text(spark, sf):
    """Lines of up to 105 characters; a fold over words that SQL has no short form for."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.wrapped(F.col("text")), "\n").alias("wrapped"), text.initials(F.col("text")).alias("initials"))


# --- bands ---


@query("bands", sql("""SELECT case_key, age_band, weight_band,
CASE WHEN age IN ('', '0') THEN 'Unknown' WHEN CAST(age AS INT) < 18 THEN 'Under-18' WHEN CAST(age AS INT) <= 40 THEN '18-40' WHEN CAST(age AS INT) <= 60 THEN '41-60' WHEN CAST(age AS INT) <= 70 THEN '61-70' ELSE '71+' END AS eval_band,
CASE WHEN age = '' THEN 'Unknown' WHEN CAST(age AS INT) < 18 THEN '<18' WHEN CAST(age AS INT) < 30 THEN '18-29' WHEN CAST(age AS INT) < 45 THEN '30-44' WHEN CAST(age AS INT) < 60 THEN '45-59' WHEN CAST(age AS INT) < 75 THEN '60-74' ELSE '75+' END AS study_band,
CASE WHEN outcome IN ('Recovered', 'Recovering') THEN 'Recovered' ELSE 'Not-recovered/Unknown' END AS outcome_band, 'Recovered' AS study_outcome,
CASE WHEN seriousness = 'Non-serious' THEN 'Non-serious' ELSE 'Serious' END AS serious_band, CASE seriousness WHEN 'Death' THEN 'death' WHEN 'Hospitalisation' THEN 'hospitalisation' WHEN 'Disability/incapacity' THEN 'disability' ELSE 'others' END AS study_serious FROM cases"""))
def bands(spark, sf):
    c = cases(spark, sf)
    return c.select("case_key", "age_band", "weight_band", banding.eval_age_band(F.col("age")).alias("eval_band"), banding.study_age_band(F.col("age")).alias("study_band"), banding.outcome_band(F.col("outcome")).alias("outcome_band"), banding.study_outcome_band(F.col("outcome")).alias("study_outcome"), banding.seriousness_band(F.col("seriousness")).alias("serious_band"), banding.study_seriousness_band(F.col("seriousness")).alias("study_serious"))


# --- sources ---


@query("markup_text", f"SELECT page_id, length(t) AS n, sha256(t) AS hash FROM (SELECT page_id, {CLEAN.format(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))} AS t FROM pages)")
def markup_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", readers.markup_text(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("hash"))


@query("json_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(readers.json_rows(F.col("props"))).alias("m")).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


@query("synthetic_cases")
def synthetic_cases(spark, sf):
    """Hash-drawn cases; the hash is Spark's."""
    return writers.synthetic_cases(spark, 2200)


# --- extraction ---


@query("extract_documents")
def extract_documents(spark, sf):
    """The whole cascade over all documents; RE2 lacks the look-arounds."""
    return extraction.extract(spread(documents(spark, sf))).drop("text")


@query("rag_chunks", sql("SELECT case_key AS doc_id, 0 AS chunk_index, concat_ws(' | ', medicine, reaction, dose, route, frequency, seriousness, outcome, narrative) AS chunk FROM cases UNION ALL SELECT case_key, 1, narrative FROM cases"))
def rag_chunks(spark, sf):
    rows = cases(spark, sf).withColumn("doc_id", F.col("case_key")).withColumn("text", F.col("narrative"))
    return extraction.chunks(rows).select("doc_id", "chunk_index", "chunk")


@query("span_agreement", sql("SELECT case_key AS doc_id, 4 AS filled, CAST(2 + (CASE WHEN contains(lower(narrative), lower(outcome)) THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(narrative), lower(seriousness)) THEN 1 ELSE 0 END) AS INTEGER) AS agreed, CAST(1 AS DOUBLE) AS agreement FROM cases"))
def span_agreement(spark, sf):
    rows = cases(spark, sf).select(F.col("case_key").alias("doc_id"), F.col("narrative").alias("text"), "medicine", "reaction", "outcome", "seriousness")
    return extraction.span_agreement(rows)


_COMMON = ", ".join(f"'{w}'" for w in extraction.EVAL_COMMON)


@query("suspect_drugs", rf"SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '(?:^|[^A-Za-z0-9_])([A-Z][a-z]+\b)', 1), lambda w: length(w) > 3 AND w NOT IN ({_COMMON}))[1] AS drug FROM documents")
def suspect_drugs(spark, sf):
    """The evaluation's drug extractor on every document."""
    return documents(spark, sf).select("doc_id", extraction.evaluation_drug("text").alias("drug"))


# --- identifiers ---


def _count(p: str) -> str:
    return f"len(regexp_extract_all(text, '{p}'))"


@query("identifier_counts", rf"SELECT doc_id, {_count(r'\b\d{4}\s?\d{4}\s?\d{4}\b')} AS aadhaar, {_count(r'\b[A-Z]{5}\d{4}[A-Z]\b')} AS pan, {_count(r'(?i)\b(?:MRN|MR|UHID|IP|OP|CR|HID)[-/]?\s*\d{4,12}\b')} AS record, {_count(r'[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}')} AS email, {_count(r'\b[1-9]\d{5}\b')} AS pin_code, {_count(r'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')} AS ipv4 FROM documents")
def identifier_counts(spark, sf):
    return identifiers.counts(documents(spark, sf)).drop("mobile", "date")


@query("masked_text", rf"SELECT doc_id, sha256(regexp_replace(text, '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{{2,}}', '[EMAIL]', 'g')) AS masked FROM documents")
def masked_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2(F.regexp_replace("text", identifiers.EMAIL, "[EMAIL]"), 256).alias("masked"))


# --- checklists, meetings, inspections, comparison, retrieval ---


@query("long_lines", r"SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\n+'), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')) > 5)) AS n FROM conversations")
def long_lines(spark, sf):
    c = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    n = docs_ops.lines(c, 5, "key").groupBy("key").agg(F.count("*").alias("n"))
    return c.join(n, "key", "left").select("conv_id", "turn", F.coalesce("n", F.lit(0)).alias("n"))


def _re2(p: str) -> str:
    """A pattern for RE2, whose word boundary is ASCII's."""
    return p.replace(text.WB, r"\b").replace(text.WE, r"\b").removeprefix("(?i)")


def _hit(x: str, *patterns: str) -> str:
    return f"regexp_matches({x}, '{'|'.join(f'(?:{_re2(p)})' for p in patterns)}', 'i')"


_EVERY = rf"""WITH l AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS position, unnest(ls) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n+'), lambda x: {TRIM.format('x')}), lambda x: length(x) > 15) AS ls FROM documents)),
t AS (SELECT *, {_hit('line', docs_ops.NUMBERED)} OR {_hit('line', docs_ops.SENTINEL)} AS telling FROM l), u AS (SELECT *, bool_or(telling) OVER (PARTITION BY doc_id) AS any_telling FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS k FROM u WHERE telling OR NOT any_telling AND length(line) > 30),
c AS (SELECT doc_id, position, line, CASE WHEN {_hit('line', *docs_ops.CRITICAL)} THEN 'critical' WHEN {_hit('line', *docs_ops.MAJOR)} THEN 'major' ELSE 'minor' END AS severity,
CASE {' '.join(f"WHEN {' OR '.join(f'contains(lower(line), {quoted(w)})' for w in words)} THEN '{name}'" for name, words in docs_ops.SECTIONS.items())} ELSE 'documentation' END AS section FROM o"""
_OBSERVED = f"{_EVERY} WHERE k <= 50)"


def _observed(spark, sf, most: int | None = 50) -> DataFrame:
    return docs_ops.deficiencies(docs_ops.observations(spread(documents(spark, sf)), most))


@query("inspection_documents", f"{_OBSERVED} SELECT doc_id, position, sha256(line) AS line, severity, section FROM c")
def inspection_documents(spark, sf):
    """The observations of every document, classed."""
    return _observed(spark, sf).select("doc_id", "position", F.sha2("line", 256).alias("line"), "severity", "section")


@query("inspection_reports", f"{_EVERY}) SELECT doc_id, count(*) AS observations, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'major') AS major, count(*) FILTER (WHERE severity = 'minor') AS minor, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'Reject / Immediate Action Required' WHEN count(*) FILTER (WHERE severity = 'major') >= 3 THEN 'Major Non-Compliance - CAPA Required' WHEN count(*) FILTER (WHERE severity = 'major') > 0 THEN 'Conditional Approval - CAPA Required' ELSE 'Acceptable with Minor Observations' END AS recommendation FROM c GROUP BY 1")
def inspection_reports(spark, sf):
    """Counts and advice of all observations of a document, however many."""
    return docs_ops.inspection_summary(_observed(spark, sf, None))


_GRID = ", ".join(f"'{t}'" for t in docs_ops.TEMPLATE)


@query("inspection_sections", rf"""{_OBSERVED}, n AS (SELECT doc_id, section, count(*) AS n FROM (SELECT doc_id, unnest([section, 'deficiencies']) AS section FROM c) GROUP BY ALL),
g AS (SELECT doc_id, length({TRIM.format("coalesce(text, '')")}) < 30 AS short, CAST(unnest(range({len(docs_ops.TEMPLATE)})) AS INTEGER) AS number, unnest([{_GRID}]) AS section FROM documents)
SELECT doc_id, number, section, CASE WHEN short THEN 0 ELSE coalesce(n, 0) END AS n, CASE WHEN short THEN 'pending' WHEN n > 0 THEN 'observations-found' ELSE 'no-observations' END AS status FROM g LEFT JOIN n USING (doc_id, section)""")
def inspection_sections(spark, sf):
    return docs_ops.inspection_template(documents(spark, sf), _observed(spark, sf))


_SECTION_TEXT = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS section, list_filter(ls, lambda x: {' OR '.join(f'contains(lower(x), {quoted(w)})' for w in words)}) AS kept FROM l" for name, words in docs_ops.SECTIONS.items())


@query("inspection_texts", rf"WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\n+') AS ls FROM documents) SELECT doc_id, section, sha256(substr({TRIM.format("array_to_string(list_slice(kept, 1, 3), ' ')")}, 1, 300)) AS extracted FROM ({_SECTION_TEXT})")
def inspection_texts(spark, sf):
    """What a report's template quotes of every document."""
    return docs_ops.section_texts(documents(spark, sf)).withColumn("extracted", F.sha2("extracted", 256))


_CHECKED = rf"""SELECT doc_id, position, item, CASE WHEN {_hit('line', r'^\[x\]')} THEN 'provided' WHEN regexp_matches(line, '^\[\s\]') THEN 'missing' WHEN {_hit('lower(item)', docs_ops.MISSING_WORDS)} THEN 'missing' WHEN {_hit('lower(item)', docs_ops.INCOMPLETE_WORDS)} THEN 'incomplete' WHEN {_hit('lower(item)', docs_ops.PROVIDED_WORDS)} THEN 'provided' ELSE 'review' END AS status
FROM (SELECT doc_id, position, line, {TRIM.format("regexp_replace(line, '^(?:\\d+[.):]|-|\\*|•|\\[x?\\])\\s*', '', 'i')").replace(chr(92) * 2, chr(92))} AS item FROM (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS position, unnest(ls) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n+'), lambda x: {TRIM.format('x')}), lambda x: length(x) > 5) AS ls FROM documents))) WHERE item <> ''"""


@query("checklist_documents", f"SELECT doc_id, position, sha256(item) AS item, status, CASE status WHEN 'missing' THEN 'Request from applicant' WHEN 'incomplete' THEN 'Review and complete' ELSE 'No action' END AS action FROM ({_CHECKED})")
def checklist_documents(spark, sf):
    """Every line of every document as a checklist's."""
    return docs_ops.checklist(documents(spark, sf)).withColumn("item", F.sha2("item", 256))


_TURN_LINES = rf"SELECT conv_id, turn, CAST(unnest(range(len(ls))) AS INTEGER) AS position, unnest(ls) AS line FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n+'), lambda x: {TRIM.format('x')}), lambda x: length(x) > 5) AS ls FROM conversations)"


@query("meeting_turns", "SELECT conv_id, turn, position, CASE " + " ".join(f"WHEN {_hit('line', p)} THEN '{name}'" for name, p in docs_ops.PREFIXES.items()) + f" END AS kind FROM ({_TURN_LINES}) WHERE {_hit('line', *docs_ops.PREFIXES.values())}")
def meeting_turns(spark, sf):
    """Labelled lines of every turn of every conversation."""
    c = table(spark, sf, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    return docs_ops.meeting(c, "key").select("key.conv_id", "key.turn", "position", "kind")


def _new_sentences(other: str, at: str) -> str:
    """Of each document, its first three sentences that the other lacks, in order."""
    return f"""SELECT doc_id, string_agg(s, '|' ORDER BY p) AS joined FROM (SELECT {at} AS doc_id, p, s, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = {other} AND k.low = lower(s.s))) WHERE n <= 3 GROUP BY 1"""


@query("sentence_diff", f"""WITH s AS (SELECT doc_id, unnest(range(len(x))) AS p, unnest(x) AS s FROM (SELECT doc_id, {sents("coalesce(text, '')")} AS x FROM documents)), k AS (SELECT DISTINCT doc_id, lower(s) AS low FROM s),
a AS ({_new_sentences('s.doc_id - 1', 'doc_id - 1')}), b AS ({_new_sentences('s.doc_id + 1', 'doc_id')})
SELECT d.doc_id, coalesce(a.joined, '') AS added, coalesce(b.joined, '') AS removed FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""")
def sentence_diff(spark, sf):
    """Documents of every length, both ways."""
    a = documents(spark, sf)
    return docs_ops.sentence_changes(a, a.select((F.col("doc_id") - 1).alias("doc_id"), "text"))


@query("token_jaccard", f"SELECT doc_id, {r('(CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))))', 3)} AS similarity FROM (SELECT a.doc_id, list_distinct({toks('a.text')}) AS x, list_distinct({toks('b.text')}) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) WHERE len(x) + len(y) > 0")
def token_jaccard(spark, sf):
    a = documents(spark, sf).select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("x"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return a.join(b, "doc_id").where(F.size("x") + F.size("y") > 0).select("doc_id", text.rounded(text.jaccard(F.col("x"), F.col("y")), 3).alias("similarity"))


_QUERY = "The reti of erand, with that!"


@query("rag_search", rf"SELECT doc_id, 0 AS chunk_index, {r('(len(h) / CAST(4 AS DOUBLE))', 3)} AS score, array_to_string(h, ',') AS terms FROM (SELECT doc_id, list_filter(['the', 'reti', 'erand', 'with'], lambda w: list_contains({toks('text')}, w)) AS h FROM documents) WHERE len(h) / CAST(4 AS DOUBLE) > 0.15 ORDER BY len(h) DESC, doc_id LIMIT 8".replace("CAST(4 AS DOUBLE)", "CAST(5 AS DOUBLE)").replace("['the', 'reti', 'erand', 'with']", "['the', 'reti', 'erand', 'with', 'that']"))
def rag_search(spark, sf):
    chunks = documents(spark, sf).select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk"))
    return docs_ops.keyword_search(chunks, _QUERY).drop("snippet")


@query("case_slots", sql("SELECT case_key, 'Suspect drug: ' || medicine || '. Dose: ' || dose || '. Route: ' || route || '. Reaction: ' || reaction || '. Onset: ' || onset || '. Seriousness: ' || seriousness || '. Outcome: ' || outcome || '. Reporter: ' || CASE WHEN contact = '' THEN 'Unknown' ELSE contact END || '. Centre: Unknown. Dechallenge: Not documented. Rechallenge: Not documented. WHO-UMC: Not documented. Narrative available: true.' AS summary, 4 AS complete FROM cases"))
def case_slots(spark, sf):
    return docs_ops.slots(cases(spark, sf))


# --- summaries ---


_SENTENCE_SCORES = f"""WITH s AS (SELECT doc_id, {_CAPITAL} AS x FROM documents), e AS (SELECT doc_id, len(x) AS total, CAST(unnest(range(len(x))) AS INTEGER) AS position, unnest(x) AS sentence FROM s),
w AS (SELECT doc_id, position, total, w, count(*) AS n FROM (SELECT doc_id, position, total, unnest({toks('sentence')}) AS w FROM e) GROUP BY ALL), st AS (SELECT doc_id, w, sum(n) AS freq, count(*) AS df FROM w GROUP BY ALL),
b AS (SELECT doc_id, position, CAST(sum(n) AS DOUBLE) AS words, sum(n * CAST(freq AS DOUBLE) * (ln(CAST(total + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + 1)) AS x FROM w JOIN st USING (doc_id, w) GROUP BY 1, 2),
f AS (SELECT e.*, words, x, len(list_filter([{', '.join(map(quoted, summary.CLINICAL))}], lambda k: contains(lower(sentence), k))) AS hits, CAST(CASE WHEN position = 0 THEN 2.5 WHEN position < total * {d(0.25)} THEN 1.5 WHEN position > total * {d(0.75)} THEN 0.8 ELSE 1 END AS DOUBLE) AS place, CAST(CASE WHEN words < 5 THEN 0.5 WHEN words > 50 THEN 0.8 ELSE 1 END AS DOUBLE) AS length FROM e LEFT JOIN b USING (doc_id, position)),
g AS (SELECT doc_id, position, coalesce((x / words + hits * {d(1.8)}) * place * length, 0) AS score FROM f) SELECT doc_id, position, {r('score', 3)} AS score FROM g"""


@query("sentence_scores", _SENTENCE_SCORES)
def sentence_scores(spark, sf):
    return summary.sentence_scores(spread(documents(spark, sf)))


@query("textrank_summary")
def textrank_summary(spark, sf):
    return summary.summarise(spread(documents(spark, sf)))


@query("keyword_hits", "SELECT doc_id, len(list_filter(['adverse', 'reaction', 'drug', 'medication', 'dose', 'onset', 'serious', 'hospital', 'death', 'fatal', 'report', 'patient', 'outcome', 'recovery', 'dechallenge', 'rechallenge', 'causality', 'seriousness', 'reporter'], lambda k: contains(lower(text), k)) ) AS hits FROM documents")
def keyword_hits(spark, sf):
    return documents(spark, sf).select("doc_id", summary.keyword_hits(F.col("text")).cast("long").alias("hits"))


# --- severity ---

_SEVERE = r"""CASE seriousness WHEN 'Death' THEN 'death' WHEN 'Disability/incapacity' THEN 'disability' WHEN 'Hospitalisation' THEN 'hospitalisation' ELSE 'others' END"""


@query("severity_cascade", sql(f"SELECT case_key, {_SEVERE} AS class, CASE WHEN {_SEVERE} = 'others' THEN 'seriousness-label-others' ELSE 'seriousness-label-map' END AS basis, CAST(CASE WHEN {_SEVERE} = 'others' THEN 0.7 ELSE 0.95 END AS DOUBLE) AS confidence FROM cases"))
def severity_cascade(spark, sf):
    return severity.cascade(cases(spark, sf))


_NB = f""", tk AS (SELECT {_SEVERE} AS class, unnest({toks('narrative')}) AS token FROM cases), cn AS (SELECT class, token, count(*) AS n FROM tk GROUP BY ALL), vc AS (SELECT DISTINCT token FROM cn), tt AS (SELECT class, sum(n) AS total FROM cn GROUP BY 1),
nb AS (SELECT class, token, ln(CAST(coalesce(n, 0) + 1 AS DOUBLE) / CAST(total + (SELECT count(*) FROM vc) AS DOUBLE)) AS log_prob FROM tt CROSS JOIN vc LEFT JOIN cn USING (class, token))"""


def _nb(spark, sf):
    rows = cases(spark, sf).select("case_key", "narrative", severity.mapped(F.col("seriousness"), severity.SERIOUSNESS_CLASS).alias("class"))
    return rows, severity.nb_train(rows.where("class is not null"), "class", "narrative")


@query("nb_train", sql(_NB + f" SELECT class, token, {r('log_prob', 6)} AS log_prob FROM nb"))
def nb_train(spark, sf):
    """The final model, of all labelled cases."""
    return _nb(spark, sf)[1].select("class", "token", text.rounded(F.col("log_prob"), 6).alias("log_prob"))


@query("nb_score", sql(_NB + f""", q AS (SELECT case_key, unnest({toks('narrative')}) AS token FROM cases), s AS (SELECT case_key, class, sum(log_prob) AS s FROM q JOIN nb USING (token) GROUP BY ALL),
p AS (SELECT case_key, class, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY case_key) AS p FROM (SELECT *, max(s) OVER (PARTITION BY case_key) AS m FROM s)) SELECT case_key, arg_max(class, p) AS class, {r('max(p)', 3)} AS confidence FROM p GROUP BY 1"""))
def nb_score(spark, sf):
    """Every case, by the final model."""
    rows, model = _nb(spark, sf)
    return severity.nb_score(rows, model, "case_key", "narrative")


@query("severity_cascade_models")
def severity_cascade_models(spark, sf):
    """All five tiers, with both models trained on all labelled cases, which every pass reads from one table."""
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    c = once(cases(spark, sf).select("case_key", "seriousness", "outcome", "narrative", "reaction").repartition(tasks, "case_key"))
    words = F.concat_ws(" ", *[text.text_of(x) for x in ("seriousness", "outcome", "narrative", "reaction")])
    rows = c.select("case_key", words.alias("words"), severity.mapped(F.col("seriousness"), severity.SERIOUSNESS_CLASS).alias("class"))
    nb = severity.nb_score(rows, severity.nb_train(rows.where("class is not null"), "class", "words"), "case_key", "words")
    return severity.cascade(c, nb, lr=severity.lr_results(rows, "case_key", "class", "words"))


@query("stratified_folds", sql("SELECT case_key, seriousness, CAST((row_number() OVER (PARTITION BY seriousness ORDER BY md5(CAST(case_key AS VARCHAR)), case_key) - 1) % 5 AS INTEGER) AS fold FROM cases"))
def stratified_folds(spark, sf):
    return severity.folds(cases(spark, sf), "case_key", "seriousness")


# --- summary metrics ---


def _pairs(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("hypothesis")).join(b.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("reference")), "id")


_BENCH_PAIRS = "SELECT a.item_id AS id, a.text AS hypothesis, b.text AS reference FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


def _rouge(n: int, pairs: str = _BENCH_PAIRS, start: str = "WITH") -> str:
    gram = "t[i]" if n == 1 else "t[i] || ' ' || t[i + 1]"
    side = lambda c: f"SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(range(1, len(t) + {2 - n}), lambda i: {gram})) AS g FROM (SELECT id, {toks(c, 1)} AS t FROM pairs)) GROUP BY ALL"
    return f"""{start} pairs AS ({pairs}), h AS ({side('hypothesis')}), e AS ({side('reference')}),
o AS (SELECT pairs.id, coalesce((SELECT sum(least(h.c, e.c)) FROM h JOIN e USING (id, g) WHERE h.id = pairs.id), 0) AS o, (SELECT sum(c) FROM h WHERE h.id = pairs.id) AS nh, (SELECT sum(c) FROM e WHERE e.id = pairs.id) AS nr FROM pairs),
p AS (SELECT id, CAST(o AS DOUBLE) / CAST(nh AS DOUBLE) AS p, CAST(o AS DOUBLE) / CAST(nr AS DOUBLE) AS c FROM o) SELECT id, {r('p', 4)} AS precision, {r('c', 4)} AS recall, {r('coalesce(2 * p * c / nullif(p + c, 0), 0)', 4)} AS f1 FROM p"""


@query("rouge_1", _rouge(1))
def rouge_1(spark, sf):
    return evaluation.rouge_n(_pairs(spark, sf), 1)


@query("rouge_2", _rouge(2))
def rouge_2(spark, sf):
    return evaluation.rouge_n(_pairs(spark, sf), 2)


@query("rouge_l")
def rouge_l(spark, sf):
    return evaluation.rouge_l(_pairs(spark, sf))


@query("tfidf_cosine", f"""WITH pairs AS ({_BENCH_PAIRS}), h AS (SELECT id, len(t) AS n, unnest(t) AS w FROM (SELECT id, {toks('hypothesis', 1)} AS t FROM pairs)), e AS (SELECT id, len(t) AS n, unnest(t) AS w FROM (SELECT id, {toks('reference', 1)} AS t FROM pairs)),
x AS (SELECT id, w, count(*) / CAST(n AS DOUBLE) AS f FROM h GROUP BY id, w, n), y AS (SELECT id, w, count(*) / CAST(n AS DOUBLE) AS f FROM e GROUP BY id, w, n),
v AS (SELECT id, w, coalesce(x.f, 0) AS a, coalesce(y.f, 0) AS b, ln(CAST(3 AS DOUBLE) / (1 + (x.f IS NOT NULL)::INT + (y.f IS NOT NULL)::INT)) + 1 AS idf FROM x FULL JOIN y USING (id, w)),
c AS (SELECT id, sum(a * b * idf * idf) AS ab, sum(a * a * idf * idf) AS aa, sum(b * b * idf * idf) AS bb FROM v GROUP BY 1)
SELECT pairs.id, {r('coalesce(ab / nullif(sqrt(aa) * sqrt(bb), 0), 0)', 4)} AS cosine FROM pairs LEFT JOIN c USING (id)""")
def tfidf_cosine(spark, sf):
    return evaluation.cosine(_pairs(spark, sf))


@query("rouge_batch", f"SELECT count(*) AS samples, {r('avg(precision)', 4)} AS precision, {r('avg(recall)', 4)} AS recall, {r('avg(f1)', 4)} AS f1 FROM ({_rouge(1)})")
def rouge_batch(spark, sf):
    return evaluation.batch_mean(evaluation.rouge_n(_pairs(spark, sf), 1))


@query("source_duplicates", "SELECT hash, count(*) AS copies, min(doc_id) AS first FROM (SELECT doc_id, sha256(text) AS hash FROM documents) GROUP BY 1 HAVING count(*) > 1")
def source_duplicates(spark, sf):
    return documents(spark, sf).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """The batch form of the streaming operator."""
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
