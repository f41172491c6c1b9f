"""Boxes around identifiers against a plain loop."""

import random
import re

from caselight.operators import summary


def plain(words):
    found = [(n, re.compile(p, re.ASCII)) for n, p in summary.BOX_PATTERNS]
    out, window, held = [], "", []
    for w in words:
        window = f"{window} {w[0]}".strip(" ")[-summary.BOX_CHARS :]
        held = [*held, w][-summary.BOX_WORDS :]
        kind = next((n for n, p in found if p.search(window)), None)
        if kind:
            out.append((kind, min(h[2] for h in held), min(h[3] for h in held), max(h[4] for h in held), max(h[5] for h in held), len(held)))
            window, held = "", []
    return out


def test_loop(spark):
    r = random.Random(8)
    bits = ["9876543210", "+91", "98765", "43210", "1234", "5678", "9012", "ABCDE1234F", "mail", "a.b@c.org", "MRN", "MRN-1234", "UHID", "12345", "word", "é", "x" * 70, "the", "of"]
    pages = {k: [(r.choice(bits), 0.9, r.randrange(50), r.randrange(50), r.randrange(50, 99), r.randrange(50, 99)) for _ in range(r.randrange(60))] for k in range(150)}
    pages[900], pages[901] = [], [("none", 0.1, 1, 1, 2, 2)]
    df = spark.createDataFrame(list(pages.items()), "doc_id long, words array<struct<text:string,confidence:double,x0:int,y0:int,x1:int,y1:int>>")
    got = {}
    for x in summary.pii_boxes(df).collect():
        got.setdefault(x["doc_id"], []).append(tuple(x)[1:])
    assert got == {k: plain(w) for k, w in pages.items() if plain(w)}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    laid = summary.laid_out(docs)
    pages = {x["doc_id"]: [tuple(w) for w in x["words"]] for x in laid.collect()}
    got = {}
    for x in summary.pii_boxes(laid).collect():
        got.setdefault(x["doc_id"], []).append(tuple(x)[1:])
    want = {k: plain(w) for k, w in pages.items()}
    assert got == {k: v for k, v in want.items() if v} and got
