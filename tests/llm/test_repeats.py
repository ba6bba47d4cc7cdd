import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import repeats


def by_definition(rows):
    """The first document of each string of 50 bytes, then every byte by looking."""
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for doc, text in texts:
        if doc is not None:
            for i in range(len(text) - 49):
                s = text[i : i + 50]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in texts:
        gone = [False] * len(text)
        if doc is not None:
            for i in range(len(text) - 49):
                if first[text[i : i + 50]] < doc:
                    gone[i : i + 50] = [True] * 50
        left = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r))


def result(frame):
    rows = frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_definition(documents, seed):
    rng = random.Random(seed)
    letters = "abé \n" if seed else "ab"
    passages = ["".join(rng.choices(letters, k=rng.choice([48, 49, 50, 51, 80, 400]))) for _ in range(12)]
    rows = []
    for doc in rng.sample(range(500), 60):
        text = "".join(rng.choice([rng.choice(passages), "".join(rng.choices(letters, k=rng.randrange(70)))]) for _ in range(rng.randrange(6)))
        rows.append((doc, text))
    rows += [(900, rows[0][1]), (901, rows[1][1]), (rows[2][0], rows[2][1]), (902, None), (903, ""), (None, passages[5]), (904, passages[5] * 3), (905, "x" * 49), (906, "x" * 49), (907, "x" * 60), (908, "x" * 200)]
    assert result(repeats.remove_repeats(documents(rows))) == by_definition(rows)


def test_kept_bytes_and_further_columns(documents):
    shared = "".join(chr(97 + (i * i) % 26) for i in range(60))
    rows = [(1, "before " + shared), (2, shared + " after")]
    got = repeats.remove_repeats(documents(rows).withColumn("key", F.lit("x")).withColumn("kept", F.lit(1)))
    assert {r["doc_id"]: bytes(r["kept"]) for r in got.collect()} == {1: rows[0][1].encode(), 2: b" after"}


def test_every_difference_is_covered():
    differences = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert differences == set(range(repeats.PERIOD))


def test_empty_table(documents):
    assert repeats.remove_repeats(documents([])).count() == 0
