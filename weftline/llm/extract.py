"""Main text of HTML pages: flat text blocks and a decision tree.

Pages are cut into text blocks (``markup``). A decision tree over word counts and link
densities of a block and its neighbours, and over the containers that a block lies in, says
which blocks are the article. The tree is trained by Spark on a small labelled table and
then read as one column expression, so the verdicts are part of the plan.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from weftline.llm.markup import FEATURES, cut_blocks
from weftline.llm.registry import query
from weftline.sources.tables import table

BLOCKS = ArrayType(StructType([StructField("text", StringType()), StructField("features", ArrayType(DoubleType()))]))
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("features", pa.list_(pa.float64()))]))


def find_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but ``html``, and ``blocks``: the page's text blocks in
    order, each a ``text`` and its ``features``. A null page has none. A column that is
    called ``blocks`` already is replaced."""
    kept = pages.drop(html, "blocks")
    names = kept.columns
    rows = pages.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(html).cast("string"), F.lit("")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                cut = [
                    [{"text": text, "features": features} for text, features in cut_blocks(page)]
                    for page in part.columns[-1].to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(cut, _BLOCKS)], names=[*names, "blocks"])

    return rows.mapInArrow(run, StructType([*kept.schema, StructField("blocks", BLOCKS)]))


def train_tree(labelled: DataFrame, *, depth: int = 10):
    """A decision tree from ``features`` (array) and ``label`` (1.0: article)."""
    tree = DecisionTreeClassifier(featuresCol="vector", maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=13)
    return tree.fit(labelled.select(array_to_vector("features").alias("vector"), "label"))


def verdict(model, features: Column) -> Column:
    """The model's verdict on an array of features as one expression."""

    def of(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        below = F.get(features, F.lit(split.featureIndex())) <= split.threshold()
        left, right = of(node.leftChild()), of(node.rightChild())
        return F.when(below, left).otherwise(right)

    return of(model._java_obj.rootNode())


def extract_text(pages: DataFrame, model, html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but ``html``, with the page's main ``text``: the blocks
    that the tree takes, in page order, a line each. Empty where there is none, as of a null or
    empty page. Rows that repeat give the same text each; a column ``text`` is replaced."""
    found = find_blocks(pages.drop("text") if html != "text" else pages, html)
    taken = F.filter("blocks", lambda block: verdict(model, block["features"]))
    return found.withColumn("text", F.array_join(F.transform(taken, lambda block: block["text"]), "\n")).drop("blocks")


# -- the labelled table ----------------------------------------------------

LABELLED_PAGES = 800

# How layouts wrap the article, and its surroundings by kind.
ARTICLES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post'>", "</article></main>"),
    ("<div id='content'><article>", "</article></div>"), ("<div id='content'>", "</div>"), ("<div role='main'>", "</div>"),
    ("<div class='post entry'>", "</div>"), ("<div class='story-body'>", "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", ""),
)
MENUS = (
    ("<nav><ul>", "</ul></nav>"), ("<ul class='menu'>", "</ul>"), ("<div id='nav'><ul>", "</ul></div>"), ("<ul>", "</ul>"),
    ("<div><ul>", "</ul></div>"), ("<header><nav><ul>", "</ul></nav></header>"), ("<ol class='breadcrumbs'>", "</ol>"),
)
HEADERS = (("<header>", "</header>"), ("<div id='header'>", "</div>"), ("<div class='site-header'>", "</div>"), ("<div role='banner'>", "</div>"))
ADVERTS = (("<div class='ad'>", "</div>"), ("<div class='advert'>", "</div>"), ("<aside class='promo'>", "</aside>"), ("<p class='sponsored'>", "</p>"), ("<div id='ad-1'>", "</div>"))
SIDEBARS = (("<aside>", "</aside>"), ("<div class='sidebar'>", "</div>"), ("<div role='complementary'>", "</div>"), ("<section class='widget related'>", "</section>"))
NOTICES = (("<div class='cookie-notice'>", "</div>"), ("<div role='alert'>", "</div>"), ("<div id='consent'>", "</div>"), ("<dialog>", "</dialog>"), ("<div class='notice'>", "</div>"))
FORMS = (("<form>", "</form>"), ("<form class='newsletter'><fieldset>", "</fieldset></form>"), ("<div class='login'><form>", "</form></div>"))
COMMENTS = (("<section id='comments'>", "</section>"), ("<div class='comments'>", "</div>"), ("<ol class='commentlist'>", "</ol>"), ("<div id='disqus-thread'>", "</div>"))
# What notices say, and articles about them too.
SAYINGS = ("We use cookies", "All rights reserved", "Sign up", "our privacy policy", "Subscribe now", "© 2020", "Advertisement", "Log in")
FOOTERS = (("<footer>", "</footer>"), ("<div id='footer'>", "</div>"), ("<div class='site-footer'>", "</div>"), ("<div role='contentinfo'>", "</div>"), ("<div>", "</div>"))


class _Page:
    """A made page, and which of its texts are the article."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.html: list[str] = []
        self.labels: dict[str, set[float]] = {}

    def words(self, least: int, most: int, sentence: bool = True) -> str:
        made = ["".join(self.rng.choice("abdegilmnorstu") for _ in range(self.rng.randrange(2, 9))) for _ in range(self.rng.randrange(least, most + 1))]
        if sentence and self.rng.random() < 0.06:
            made.insert(self.rng.randrange(len(made)), self.rng.choice(SAYINGS))
        return " ".join(made).capitalize() + "." * sentence

    def text(self, label: int, text: str, before: str = "", after: str = "") -> None:
        self.labels.setdefault(text, set()).add(float(label))
        self.html.append(f"{before}{text}{after}")

    def links(self, label: int, many: int, item: str = "li") -> None:
        for _ in range(many):
            self.text(label, self.words(1, 4, False), f"<{item}><a href='/x'>", f"</a></{item}>")

    def paragraph(self, label: int, least: int, most: int) -> None:
        text = self.words(least, most)
        close = "</p>" if self.rng.random() < 0.8 else ""
        self.labels.setdefault(text, set()).add(float(label))
        cut = text.split(" ")
        if len(cut) > 12 and self.rng.random() < 0.3:
            k = self.rng.randrange(2, len(cut) - 3)
            cut[k] = f"<a href='/y'>{cut[k]}"
            cut[k + 1] += "</a>"
        self.html.append(f"<p>{' '.join(cut)}{close}")

    def article(self, bare: bool) -> None:
        """Headings, paragraphs of any length, lists and tables; inside it, now and then, other things."""
        rng = self.rng
        self.text(1, self.words(2, 12, False), "<header><h1>" if not bare and rng.random() < 0.2 else "<h1>", "</h1>")
        if self.html[-1].startswith("<header>"):
            self.html.append("</header>")
        for _ in range(rng.randrange(1, 9)):
            kind = rng.random()
            # Where nothing names the article, its length has to.
            least = 12 if bare else rng.choice([1, 4, 20])
            if kind < 0.7:
                self.paragraph(1, least, 90 if rng.random() < 0.6 else max(least, 12))
            elif kind < 0.78:
                self.text(1, self.words(2, 6, False), "<h2>", "</h2>")
                self.paragraph(1, max(8, least), 60)
            elif kind < 0.84 and not bare:
                self.html.append("<ul>")
                for _ in range(rng.randrange(2, 6)):
                    self.text(1, self.words(1, 9, False), "<li>", "</li>")
                if rng.random() < 0.4:
                    self.links(1, 2)
                self.html.append("</ul>")
            elif kind < 0.88 and not bare:
                self.html.append("<table><tr>")
                for _ in range(4):
                    self.text(1, self.words(1, 3, False), "<td>", "</td>")
                self.html.append("</tr></table>")
            elif kind < 0.92:
                self.text(1, self.words(max(least, 6), 40), "<blockquote>", "</blockquote>")
            elif kind < 0.96:
                self.around(ADVERTS, 4, 25)
            else:
                self.around(rng.choice([SIDEBARS, FORMS, NOTICES]), 2, 25)

    def around(self, wraps: tuple, least: int, most: int, links: int = 0) -> None:
        before, after = self.rng.choice(wraps)
        self.html.append(before)
        if not before.startswith("<p") and self.rng.random() < 0.3:
            self.text(0, self.words(1, 4, False), "<h3>", "</h3>")
        if before in ("<div>", "<div role='contentinfo'>"):
            self.text(0, f"© {self.words(least, most)}")
        elif wraps is NOTICES and self.rng.random() < 0.6:
            self.text(0, f"{self.rng.choice(SAYINGS)} {self.words(least, most)}")
        elif self.rng.random() < 0.5 or before.startswith("<p"):
            self.text(0, self.words(least, most))
        else:
            self.paragraph(0, least, most)
        if links:
            self.html.append("<ul>")
            self.links(0, links)
            self.html.append("</ul>")
        self.html.append(after)

    def menu(self) -> None:
        before, after = self.rng.choice(MENUS)
        self.html.append(before)
        self.links(0, self.rng.randrange(3, 9))
        # Now and then nothing closes it, which an article's own container makes good.
        self.html.append("" if self.named and self.rng.random() < 0.04 else after)

    def teasers(self) -> None:
        self.html.append("<aside class='related'>")
        self.text(0, self.words(1, 3, False), "<h2>", "</h2>")
        for _ in range(self.rng.randrange(1, 4)):
            self.text(0, self.words(3, 8, False), "<article><h3><a href='/z'>", "</a></h3>")
            self.text(0, self.words(8, 30), "<p>", "</p></article>")
        self.html.append("</aside>")

    def comments(self) -> None:
        before, after = self.rng.choice(COMMENTS)
        self.html.append(before)
        if self.rng.random() < 0.5:
            self.text(0, self.words(1, 3, False), "<h2>", "</h2>")
        for _ in range(self.rng.randrange(1, 5)):
            inner = self.rng.choice([("<p>", "</p>"), ("<article><p>", "</p></article>"), ("<li>", "</li>"), ("<article class='comment'><p>", "</p></article>")])
            self.text(0, self.words(3, 60), *inner)
        self.html.append(after)

    def made(self) -> _Page:
        rng = self.rng
        before, after = rng.choice(ARTICLES)
        self.named = "<article" in before or "<main" in before
        for part in rng.sample([self.menu, lambda: self.around(HEADERS, 2, 10), lambda: self.around(ADVERTS, 4, 30), lambda: self.around(NOTICES, 6, 40)], rng.randrange(5)):
            part()
        self.html.append(before)
        self.article(bare=not any(word in before for word in ("article", "main", "content", "post", "story")))
        if before and rng.random() < 0.25:
            self.comments()
        self.html.append(after)
        after_parts = [self.menu, self.comments, self.teasers, lambda: self.around(SIDEBARS, 3, 40, rng.randrange(8)), lambda: self.around(FORMS, 2, 20), lambda: self.around(ADVERTS, 4, 30)]
        for part in rng.sample(after_parts, rng.randrange(5)):
            part()
        if rng.random() < 0.85:
            self.around(FOOTERS, 3, 25, rng.choice([0, 0, 4]))
        return self


def labelled_blocks(spark: SparkSession, pages: int = LABELLED_PAGES, seed: int = 1) -> DataFrame:
    """The labelled table: ``text, features, label`` of the blocks of ``pages`` made pages (some
    16 a page), in layouts as they are common. Texts that occur with both labels are left out."""
    rows = []
    for k in range(pages):
        page = _Page(seed * 1_000_003 + k).made()
        for text, features in cut_blocks("".join(page.html)):
            label = page.labels.get(text, ())
            if len(label) == 1:
                rows.append((text, features, next(iter(label))))
    return spark.createDataFrame(rows, "text string, features array<double>, label double").coalesce(1)


@query()
def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    text = extract_text(pages, train_tree(labelled_blocks(spark)))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
