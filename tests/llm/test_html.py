import html
import re

import pyarrow.parquet as pq

from caselight.llm import html_blocks


def test_tree_on_held_out_pages():
    held = html_blocks.training_rows(300, seed=99)
    right = sum(html_blocks.decide(html_blocks.tree(), x) == y for x, y in held)
    assert right >= 0.99 * len(held)


def test_given_pages_are_their_articles(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    got = {r["page_id"]: r["text"] for r in html_blocks.extract(spark.read.parquet(path)).collect()}
    for page_id, page in zip(*pq.read_table(path, columns=["page_id", "html"]).to_pydict().values()):
        article = re.split("<article>", page)[1]
        article = re.split("</article>|<footer>", article)[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("<h1>|</?p>|</h1>", article)]
        assert got[page_id] == "\n\n".join(x for x in parts if x)


def test_odd_pages(spark):
    story = "One two three four five six seven eight nine ten eleven twelve."
    pages = [
        (1, None, None),
        (2, "u", ""),
        (3, "u", f"<p>{story}"),
        (4, "u", f"{story} no markup &amp; no &lt;tags&gt;"),
        (5, "u", f"<nav><a href=x>Home</a> <a href=y>News</a></nav><div class='entry'><p>{story}<br>more<p>{story}</div><div id=comments><p>{story}</p></div><script>if (a < b) '</p>'</script><style>p{{}}</style>"),
        (6, "u", f"<!-- x --><article><p>{story}</p><section class='comment-list'><p>{story}</p></section></article><form><p>{story}</p></form>"),
        (7, "u", "<" * 1000 + "<div" * 1000),
        (8, "u", f"<form id=aspnetForm><div>{story}</div><article><header><h1>Head line</h1></header><p>{story}</p><figure><figcaption>A caption.</figcaption></figure></article><div><p>{story}</p></div></form>"),
        (7, "u", f"<body class='sidebar-left'><div class='cookie-notice'>{story}</div><h1>Head</h1><p>A \n b</p>"),
    ]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id long, url string, html string, text string")
    out = [r["text"] for r in html_blocks.extract(df).collect()]
    assert out[:2] == ["", ""] and out[2] == story and out[3] == f"{story} no markup & no <tags>"
    assert out[4] == f"{story} more\n\n{story}"
    assert out[5] == story
    assert out[7] == f"Head line\n\n{story}\n\nA caption."
    assert out[8] == "Head\n\nA b"
    assert html_blocks.extract(df.where("false")).count() == 0


LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam"


def test_words_and_links_decide_in_bare_pages():
    page = f"<div>Subscribe to our newsletter today</div><p>{LONG}</p><div>Copyright 2024 Example</div>"
    assert html_blocks.main_text(page) == LONG
    page = f"<div><a href=a>Home</a> <a href=b>World</a></div><div><h1>A big headline here</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><ul><li><a href=c>More of it</a></li><li><a href=d>And more</a></li></ul>"
    assert html_blocks.main_text(page) == f"A big headline here\n\n{LONG}\n\nShort one.\n\n{LONG}"


def test_links_inside_an_article_stay():
    page = f"<article><h1><a href=x>The linked headline</a></h1><p>{LONG}</p><p>See <a href=y>the whole of this linked paragraph with many words in it</a></p></article>"
    assert html_blocks.main_text(page) == f"The linked headline\n\n{LONG}\n\nSee the whole of this linked paragraph with many words in it"


def test_names_around_a_whole_page_say_nothing():
    page = f"<div class='post legal'><h1>Head</h1><p>{LONG}</p></div><div class='legal'>All rights reserved</div>"
    assert html_blocks.main_text(page) == f"Head\n\n{LONG}"
    assert html_blocks.main_text(f"<div class='post legal'><article><h1>Head</h1><p>{LONG}</p></article></div>") == f"Head\n\n{LONG}"


def test_text_features_carry_the_tree():
    """Without what tags and names say against a block, words and links still tell most; without
    words and links, less."""
    rows, held = html_blocks.training_rows(600, seed=5), html_blocks.training_rows(300, seed=99)

    def share(without):
        tree = html_blocks.train(rows, without)
        blank = lambda x: tuple(0.0 if f in without else v for f, v in zip(html_blocks.FEATURES, x))
        return sum(html_blocks.decide(tree, blank(x)) == y for x, y in held) / len(held)

    assert share(html_blocks.NAME_FEATURES) >= 0.95 > share(tuple(f for f in html_blocks.FEATURES if "words" in f or "density" in f or "longest" in f))


def test_very_long_page():
    page = "<nav><a href=x>Menu</a></nav><article>" + f"<p>{LONG}</p>" * 20_000 + "</article><footer>Foot</footer>" + "<div>" * 50_000
    assert html_blocks.main_text(page) == "\n\n".join([LONG] * 20_000)


def test_names_of_remarks_empty_no_article():
    story = f"<h1>Head line</h1><p>{LONG}</p><p>{LONG}</p>"
    want = f"Head line\n\n{LONG}\n\n{LONG}"
    for start, stop in (("<article class='review'>", "</article>"), ("<div class='review'>", "</div>"), ("<div id='feedback'>", "</div>"), ("<main class='discussion'>", "</main>"), ("<div class='comments'>", "</div>")):
        assert html_blocks.main_text(f"<html><body>{start}{story}{stop}</body></html>") == want
        assert html_blocks.main_text(f"<nav><a href=x>Home</a></nav>{start}{story}{stop}<footer>Foot</footer>") == want
    remarks = f"<div class='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    assert html_blocks.main_text(f"<article>{story}</article>{remarks}") == want
    assert html_blocks.main_text(f"<article>{story}{remarks}</article>") == want


def test_sections_of_an_article_stay():
    page = f"<article><h1>A paper</h1><section id='methods'><h2>Methods</h2><p>{LONG}</p></section><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>"
    assert html_blocks.main_text(page) == f"A paper\n\nMethods\n\n{LONG}\n\nDiscussion\n\n{LONG}"


def test_skipped_elements_end_no_block():
    page = f"<article><h1>Head</h1><p>Alpha <script>1 < 2</script>beta <svg><path d='x'/><text>no</text></svg>gamma <button>Press</button>delta {LONG}</p><p>{LONG}</p></article>"
    assert html_blocks.main_text(page) == f"Head\n\nAlpha beta gamma delta {LONG}\n\n{LONG}"


def test_formulas_are_text():
    page = f"<article><h1>Head</h1><p>Let <math><mi>x</mi><mo>=</mo><msup><mi>y</mi><mn>2</mn></msup><annotation>x=y^2</annotation></math> be so. {LONG}</p></article>"
    assert html_blocks.main_text(page) == f"Head\n\nLet x=y2 be so. {LONG}"
