import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from caselight.llm import pii, queries
from tests.llm import brute


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_patterns_are_the_plain_ones():
    r = random.Random(4)
    for alphabet in ("a@.-1 +", "12.3", "0123456789 -", "+1 ().-2é", "a.@b+1-2 9()é\n"):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == plain(text), text
    for text in ("a" * 100_000, "1" * 100_000, "1." * 50_000, "+1 " * 50_000, "@" * 50_000, "a@" * 50_000):
        pii.base_spans(text)


def test_query_rows(spark):
    rows = [(1, "mail bob@x.org or 1.2.3.4, 4111-1111 1111 1111; +1 (555) 555-0100"), (2, None), (3, ""), (None, "é a@b.co"), (4, "a@b.co"), (4, "a@b.co"), (5, "999.1.1.1 4111111111111112 +12")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    out = pii.extract(df).select("doc_id", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect()
    want = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or ""))) for i, t in rows]
    assert sorted([(r["doc_id"], r["b"]) for r in out], key=str) == sorted(want, key=str)
    assert all(r["b"] == r["s"] for r in out)
    assert pii.extract(df.where("false")).count() == 0
    text = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert text[1] == "mail <EMAIL> or <IP>, <CARD>; <PHONE>" and text[5] == rows[-1][1]


def test_query_counts_each_kind(spark, tmp_path):
    rows = [(1, "call +1 (555) 555-0100"), (2, "a@b.co c@d.org e@f.net +1 (555) 555-0100"), (3, "1.2.3.4 and 5.6.7.8, 4111-1111 1111 1111"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = plain(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(kind == k for kind, *_ in want) for k in pii.KINDS], t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_bootstrapping_finds_unseen_identifiers(spark):
    r = random.Random(2)
    rows = [(k, f"{r.choice('abcdef') * 3} please call my phone number +1 (555) 555-{1000 + k} today {k}") for k in range(12)]
    rows += [(50, "well please call my phone number 5550123456 today"), (51, "the order total came to 5550123457 units"), (52, "please call my phone number 5550123456 again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x["doc_id"]: x["s"] for x in pii.extract(df).select("doc_id", pii.listed("spans").alias("s")).collect()}
    assert out[50] == f"phone:{rows[12][1].index('555')}:{rows[12][1].index('555') + 10}"
    assert out[51] == ""


def brute_bootstrap(edges):
    """Plain rounds over (kind, instance, pattern); what candidates become."""
    seeds = {}
    for k, i, _ in edges:
        if k >= 0:
            seeds[i] = min(seeds.get(i, k), k)
    links = {(i, p) for _, i, p in edges}
    of_pattern = {}
    for i, p in links:
        of_pattern.setdefault(p, set()).add(i)
    known = {i: (k, 1.0) for i, k in seeds.items()}
    for _ in range(pii.ROUNDS):
        voting = {}
        for p, held in of_pattern.items():
            for kind in range(len(pii.ALL_KINDS)):
                sure = [known[i][1] for i in held if i in known and known[i][0] == kind]
                score = sum(sure) / (len(held) + pii.SMOOTHING)
                if sum(c >= pii.MIN_CONFIDENCE for c in sure) >= pii.MIN_SUPPORT and score >= pii.MIN_SCORE:
                    voting[p, kind] = score
        found = {}
        for i, p in links:
            for kind in range(len(pii.ALL_KINDS)):
                if i not in seeds and (p, kind) in voting:
                    found.setdefault(i, {}).setdefault(kind, []).append(voting[p, kind])
        known = {i: (k, 1.0) for i, k in seeds.items()}
        for i, kinds in found.items():
            best = max((1 - math.prod(1 - min(x, 1) for x in v), -k) for k, v in kinds.items())
            known[i] = (-best[1], best[0])
    return {i: k for i, (k, c) in known.items() if i not in seeds and c >= pii.MIN_CONFIDENCE}


def context_rows():
    """Texts of identifiers in contexts of their kind, with others that no fixed pattern knows."""
    r = random.Random(6)
    filler = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 9)))
    card = lambda: next(c for c in iter(lambda: "".join(r.choice("0123456789") for _ in range(16)), "") if luhn(c))
    shapes = {"email": ("write to me at", lambda k: f"p{k}x@mail{k}.example.org"), "phone": ("phone number:", lambda k: f"+1 (555) 555-{1000 + k}"), "card": ("charged to card", lambda k: card())}
    rows = [(100 * n + k, f"{filler()} {words} {make(k)} {filler()}") for n, (words, make) in enumerate(shapes.values()) for k in range(14)]
    unseen = {"email": ["jane.doe(at)example(dot)com", "jane.doe@localhost"], "phone": ["017 555 7713", "5557714"], "card": ["4111 1111 1111 1112"]}
    planted = [(kind, x) for kind, xs in unseen.items() for x in xs]
    rows += [(1000 + n, f"{filler()} {shapes[kind][0]} {x} {filler()}") for n, (kind, x) in enumerate(planted)]
    rows += [(2000 + n, f"{filler()} order {x} {filler()}") for n, x in enumerate(["12345678", "3.14.15", "v2.0", "http://x.org/a_b", "20 30 40"])]
    return rows, planted


def test_contexts_find_identifiers_of_any_shape(spark):
    rows, planted = context_rows()
    out = {x["doc_id"]: x["s"] for x in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed("spans").alias("s")).collect()}
    texts = dict(rows)
    for n, (kind, x) in enumerate(planted):
        at = texts[1000 + n].index(x)
        assert out[1000 + n] == f"{kind}:{at}:{at + len(x)}", x
    assert not any(out[i] for i in out if i >= 2000)


@pytest.mark.parametrize("source", ["given", "contexts"])
def test_scores_are_the_plain_ones(spark, source):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if source == "given" else spark.createDataFrame(context_rows()[0], "doc_id long, text string")
    contexts = pii.found(docs).select(F.explode("contexts").alias("c")).select("c.kind", "c.instance", F.explode("c.patterns").alias("pattern")).distinct()
    got = {r["instance"]: r["kind"] for r in pii.bootstrap(contexts).collect()}
    assert got == brute_bootstrap([tuple(r) for r in contexts.collect()])


def test_secrets_are_spans_but_not_base(spark):
    text = 'see token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and Password: aB3dE5gH7jK9mN1p, token = "short1" but no token here'
    out = pii.extract(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed("base").alias("b"), pii.listed("spans").alias("s")).first()
    assert out["b"] == "" and [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in out["s"].split(","))] == ["9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "aB3dE5gH7jK9mN1p"]


def test_long_texts_and_ties(spark):
    long = "1" * 50_000 + " " + "a.b" * 20_000 + " " + "x@y.org " * 5_000
    got = pii.extract(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(len(r["base"]) == 5_000 == len(r["spans"]) for r in got)
    # a phone's digits can be a card's too: both spans stay, in the order of kinds
    both = pii.extract(spark.createDataFrame([(1, "+4111111111111111")], "doc_id long, text string")).select(pii.listed("spans").alias("s")).first()["s"]
    assert both == ",".join(f"{k}:{a}:{b}" for k, a, b in plain("+4111111111111111"))
