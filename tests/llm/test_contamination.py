import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import contamination

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_definition(text, items, window):
    mine, hit, found = words(text), set(), set()
    for item, source in items:
        theirs = words(source)
        size = min(window, len(theirs))
        if item is None or not size:
            continue
        spans = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)}
        for i in range(len(mine) - size + 1):
            if tuple(mine[i : i + size]) in spans:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(mine), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [100_000, 60])
@pytest.mark.parametrize("seed", range(3))
def test_equals_the_definition(spark, documents, seed, block_words):
    rng = random.Random(seed)
    letters = [*"abc", "été", "X9"][: 3 + seed]
    some = lambda n: [rng.choice(letters) for _ in range(n)]
    items = [(k, rng.choice([" ", ", ", "\n"]).join(some(rng.choice([0, 1, 2, 5, 6, 9, 20])))) for k in range(1, 25)]
    items += [(3, "a b"), (None, "c c c c c c"), (77, None), (78, "...")]
    rows = []
    for k in range(60):
        text = some(rng.randrange(12))
        for _ in range(rng.randrange(3)):
            text += words(rng.choice(items)[1]) + some(rng.randrange(4))
        rows.append((k, "; ".join(text).upper() if k % 3 else " ".join(text)))
    rows += [(100, None), (101, ""), (rows[0][0], rows[0][1]), (None, "a b c")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    got = contamination.benchmark_hits(documents(rows).withColumn("items", F.lit(1)), benchmark, window=6, block_words=block_words)
    found = sorted((str(r["_row"]), r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), r["items"]) for r in got.collect())
    assert found == sorted((str(d), *by_definition(t, items, 6)) for d, t in rows)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    row = contamination.contamination(documents([(1, "a b")]), none).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)
    assert contamination.contamination(documents([]), none).count() == 0
    assert contamination.decontaminate(documents([(1, "a b"), (None, "c")]), none).count() == 2


def test_spans_are_cut_and_contaminated_rows_go(spark, documents):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, long + " One, two THREE four\nfive six! end"), (1, "one two three four five six"), (None, long), (2, None)]
    got = contamination.decontaminate(documents(rows).withColumn("spans", F.lit(1)), items, window=6)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans"]
    found = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert found == {(1, long + " ! end"), (None, long), (2, None)}
    assert got.where("n_chars <> length(text)").isEmpty()
