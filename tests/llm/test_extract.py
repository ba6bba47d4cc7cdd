import html
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.llm import extract, markup


@pytest.fixture(scope="module")
def model(spark):
    return extract.train_tree(extract.labelled_blocks(spark))


@pytest.fixture(scope="module")
def text_of(spark, model):
    def run(*pages):
        rows = spark.createDataFrame([(k, page) for k, page in enumerate(pages)], "page_id long, html string")
        found = {r["page_id"]: r["text"] for r in extract.extract_text(rows.repartition(2), model).collect()}
        return [found[k] for k in range(len(pages))]

    return run


def plain_version(page):
    """The article of a page of the given tables: its heading and paragraphs."""
    body = page.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", body)
    lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", part.replace("<br>", " "))).split()) for part in parts)
    return "\n".join(line for line in lines if line)


def test_query_equals_the_plain_version(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet").collect()
    got = {r["page_id"]: r for r in extract.op13_html_text(spark, medium).collect()}
    assert len(got) == len(pages)
    for r in pages:
        mine = got[r["page_id"]]
        assert mine["text"] == plain_version(r["html"]), r["page_id"]
        assert (mine["url"], mine["n_chars"]) == (r["url"], len(mine["text"]))


LONG = "One of the longer sentences of this small page says nothing much, but it does so at some length, with commas and all."
LAYOUTS = [
    (  # landmarks, and everything that an article is without
        f"""<html><head><title>Not this</title><style>p {{}}</style></head><body class="has-sidebar">
        <header><h1>Site</h1><p>A tagline that is long enough to look like a sentence, more or less.</p></header>
        <nav><a href=/>Home</a> <a href=/b>About us</a></nav>
        <main><article><header><h1>The  title</h1></header><p>{LONG}</p><p>Short.</p><h2>Part two</h2>
        <ul><li>One <a href=x>link</a></li><li>Two</li></ul><aside class="pull">{LONG}</aside>
        <div class="advertisement"><p>Buy this and that, it is good for you and cheap as well, they say.</p></div>
        <p>We use cookies, said the cook.</p></article>
        <section id="comments"><h2>2 comments</h2><article><p>{LONG} I think.</p></article></section></main>
        <aside><h3>Related</h3><article><h4><a href=q>Another story</a></h4><p>{LONG}</p></article></aside>
        <form><label>Name</label><p>Sign up for news and more news every day.</p><button>Go</button></form>
        <footer><p>{LONG}</p></footer><script>var a = "<p>no</p>";</script></body></html>""",
        f"The title\n{LONG}\nShort.\nPart two\nOne link\nTwo\nWe use cookies, said the cook.",
    ),
    (  # classes alone
        f"""<body><div id="masthead">Site name and motto</div><ul class="main-menu"><li><a href=a>A</a><li><a href=b>B</a></ul>
        <div class="cookie-banner">This site uses cookies to do things that you would rather not know of.</div>
        <div class="post-content"><h1>Title</h1><p>{LONG}<p>Two.<blockquote>A quote</blockquote><table><tr><td>1<td>2</table></div>
        <div class="sidebar"><div class="content"><p>{LONG}</p></div></div>
        <div class="comments"><div class="comment-content"><p>{LONG}</p></div></div><div id="footer">© me</div>""",
        f"Title\n{LONG}\nTwo.\nA quote\n1\n2",
    ),
    (  # nothing named: length and links decide
        f"""<body><ul><li><a href=a>Menu one</a></li><li><a href=b>Menu two</a></li><li><a href=c>Three</a></li></ul>
        <h1>A title of some words</h1><p>{LONG}</p><p>{LONG} Again.</p><p>{LONG} And again.</p>
        <ul><li><a href=d>Next</a></li><li><a href=e>Previous</a></li></ul><div>© 2024 Somebody. All rights reserved.</div></body>""",
        f"A title of some words\n{LONG}\n{LONG} Again.\n{LONG} And again.",
    ),
]


@pytest.mark.parametrize("page, wanted", LAYOUTS)
def test_layouts_that_the_tree_has_not_seen(text_of, page, wanted):
    assert text_of(page) == [wanted]


def article(inner):
    return f"<body><nav><a>x</a></nav><article><p>{LONG}</p>{inner}</article>"


@pytest.mark.parametrize(
    "inner, wanted",
    [
        ("<p>a &lt;b&gt; &amp;amp; &eacute;&#233;&#xe9; &copy &nbsp; z</p>", "a <b> &amp; ééé © z"),
        ("<p>a\n\t b<br>c<br/>d</p>", "a b c d"),
        ("<p>x <!-- <p>no</p> --> y<!----> z<!--> w", "x y z w"),
        ("<p>1 < 2 and 3 > 2, a<3</p>", "1 < 2 and 3 > 2, a<3"),
        ("<p title=\"a > b\">one</p><p title='<p>'>two</p><P CLASS=x>three</P>", "one\ntwo\nthree"),
        ("<p title=don't>one</p><p>it's</p>", "one\nit's"),
        ("<p>wo<b>rd</b><i>s</i> <my-tag>here</my-tag></p>", "words here"),
        ("</div></span><p>still</p></b>", "still"),
        ("<script>if (a < b) '</p>'</script ><style>x</STYLE><p>after</p>", "after"),
        ("<p>before</p><script>never closed <p>no</p>", "before"),
        ("<p>before</p><!-- never closed <p>no</p>", "before"),
        ("<p>before</p><p cl", "before"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<p><![CDATA[ no ]]>yes<?php no ?></p>", "yes"),
        ("<p>\x00 　 é</p><p>\xa0</p><p></p>", "\x00 é"),
        ("<p>&#0; &#xD800; &notit; &bogus; &</p>", "� � ¬it; &bogus; &"),
    ],
)
def test_broken_and_odd_markup(text_of, inner, wanted):
    assert text_of(article(inner)) == [f"{LONG}\n{wanted}"]


def test_nulls_repeats_other_columns_and_empty_tables(spark, model):
    page = article("<p>yes</p>")
    rows = [(1, None, "a", 1, "t"), (1, "", "b", 2, "t"), (2, page, "c", 3, "t"), (2, page, "c", 3, "t"), (None, "plain", None, None, None), (5, "<<<>>> </", "d", 1, "t")]
    table = spark.createDataFrame(rows, "page_id long, html string, url string, blocks long, text string")
    got = extract.extract_text(table.repartition(3), model)
    assert got.columns == ["page_id", "url", "text"]
    texts = sorted((str(r["page_id"]), r["url"], r["text"]) for r in got.collect() if r["page_id"] != 5 and r["page_id"])
    assert texts == [("1", "a", ""), ("1", "b", ""), ("2", "c", f"{LONG}\nyes"), ("2", "c", f"{LONG}\nyes")]
    assert extract.extract_text(table.limit(0), model).count() == 0


def test_very_long_pages_take_time_in_proportion():
    for unit in ("<p>word <b>word</b>", "<div>", "<a b=\"", "<!--x", "</p>", "<li>x", "&amp;", "<", "<a href='x'>y", "<p a='", "<table><tr><td>x"):
        start = time.time()
        markup.cut_blocks(unit * 20_000)
        assert time.time() - start < 6, unit


def test_the_tree_is_right_on_layouts_held_out(spark, model):
    held = extract.labelled_blocks(spark, 200, seed=2).withColumn("taken", extract.verdict(model, F.col("features")))
    counts = {(r["label"], r["taken"]): r["count"] for r in held.groupBy("label", "taken").count().collect()}
    precision = counts[1.0, True] / (counts[1.0, True] + counts.get((0.0, True), 0))
    recall = counts[1.0, True] / (counts[1.0, True] + counts.get((1.0, False), 0))
    assert precision > 0.98 and recall > 0.98


def test_the_column_equals_the_model(spark, model):
    from pyspark.ml.functions import array_to_vector

    held = extract.labelled_blocks(spark, 60, seed=3)
    both = model.transform(held.withColumn("vector", array_to_vector("features")))
    assert both.where((F.col("prediction") == 1.0) != extract.verdict(model, F.col("features"))).count() == 0
