import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import jaccard
from weftline.llm.graph import components
from weftline.scratch import written


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def smallest_reachable(links, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_definition(documents, seed):
    rng = random.Random(seed)
    texts = {}
    for group in range(14):
        text = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 4, 5, 20, 60, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            changed = list(text)
            for _ in range(rng.randrange(1 + len(text) // 14)):
                changed[rng.randrange(len(changed))] = f"n{rng.randrange(10**6)}"
            texts[rng.randrange(10**9)] = rng.choice([" ", "\n"]).join(changed)
    ids = list(texts)
    texts |= {10**9 + k: texts[ids[k]].upper() for k in range(5)}
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [
        (a, b) for a in texts for b in texts
        if a < b and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])
    ]
    wanted = smallest_reachable(links, texts)
    rows = [*texts.items(), (-5, None), (-4, ""), (-3, " \n"), (None, "a b c d e f")]
    rows.append(rows[0])
    got = jaccard.jaccard_components(documents(rows).withColumn("component", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_shingles"], r["component_id"]) == (2, None)
        else:
            assert r["n_shingles"] == len(sets.get(r["doc_id"], ()))
            assert r["component_id"] == wanted.get(r["doc_id"], r["doc_id"])


def test_one_of_each_keeps_rows_without_links(documents):
    rows = [(3, "a b c d e f"), (2, "A b c d e f"), (5, None), (None, "a b c d e f"), (7, ""), (8, "other words")]
    kept = jaccard.one_of_each(documents(rows)).collect()
    assert sorted((str(r["doc_id"]) for r in kept)) == ["2", "5", "7", "8", "None"]
    assert jaccard.one_of_each(documents([])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1100)]
    links += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(150)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links + [(None, 4), (9, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(frame).collect()}
    ids = {i for pair in links for i in pair if pair[0] != pair[1]}
    assert got == {i: c for i, c in smallest_reachable(links, ids).items()}


def test_an_id_with_several_texts_keeps_all_its_links(documents):
    rng = random.Random(6)
    a, b, c = ([f"{name}{rng.randrange(10**6)}" for _ in range(60)] for name in "abc")
    near = [*b[:30], "changed", *b[31:]]
    rows = [(3, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, " ".join(near)), (8, " ".join(c)), (8, None), (9, ""), (11, " ".join(c)), (5, " ".join(b))]
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(documents(rows)).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 3), (8, 8), (8, 8), (9, 9), (11, 8)]
    kept = sorted((r["doc_id"], r["text"] or "") for r in jaccard.one_of_each(documents(rows[::-1])).collect())
    # The other text of 5 is a copy of nothing that stays.
    assert kept == sorted([(3, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (8, " ".join(c)), (8, ""), (9, "")])


def test_texts_stay_where_they_are_read(documents, spark):
    """Copies are left out without an exchange of the texts, however many there are."""
    rows = [(k, f"the same {k // 2} few words in two texts") for k in range(40)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = written(documents([*rows, (None, rows[0][1]), (77, None)]))
        kept = jaccard.one_of_each(docs)
        assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [*range(0, 40, 2), 77]
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
