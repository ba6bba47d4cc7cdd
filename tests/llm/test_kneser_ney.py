import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import kneser_ney as kn
from weftline.llm import mapped
from weftline.scratch import shared_folder

START = "<start>"
END = "<end>"


def tokens(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in words] + [END]


class Plain:
    """The model from its definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        lists = [tokens(t) for t in texts]
        self.unigrams = Counter(w for t in lists for w in t)
        self.tokens, self.types = sum(self.unigrams.values()), len(self.unigrams)
        top = Counter()
        for t in lists:
            full = [START] * (order - 1) + t
            for i in range(len(t)):
                top[tuple(full[i : i + order])] += 1
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discounts = {
            n: kn.discounts_of(*(sum(c == k for c in self.counts[n].values()) for k in (1, 2, 3, 4)))
            for n in self.counts
        }
        self.followers = {n: defaultdict(list) for n in self.counts}
        for n, counts in self.counts.items():
            for g, c in counts.items():
                self.followers[n][g[:-1]].append(c)

    def p(self, gram):
        if not gram:
            return 1 / (self.types + 1)
        n = len(gram)
        seen = self.followers[n].get(gram[:-1])
        lower = self.p(gram[1:])
        if not seen:
            return lower
        cut = lambda c: (0.0, *self.discounts[n])[min(c, 3)]
        c = self.counts[n].get(gram, 0)
        return (c - cut(c)) / sum(seen) + sum(map(cut, seen)) / sum(seen) * lower

    def score(self, text):
        t = tokens(text)
        full = [START] * (self.order - 1) + t
        return sum(math.log10(self.p(tuple(full[i : i + self.order]))) for i in range(len(t)))

    def base(self, text):
        return sum(math.log10((self.unigrams[w] + 1) / (self.tokens + self.types + 1)) for w in tokens(text))


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "Bär", "x", "y,", "été", "zz"] + [f"w{k}" for k in range(40)]
    return [
        (k, None if k == 3 else rng.choice([" ", "\n", "\t "]).join(rng.choices(words[: rng.choice([5, 49])], k=rng.randrange(0, 60))))
        for k in range(n)
    ]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_the_definition(documents, order):
    train, other = corpus(1), [(900, "the of NEVER seen the"), (901, ""), (902, None), (903, "The  of\tof")]
    model = kn.train(documents(train), order)
    plain = Plain([t for _, t in train], order)
    assert (model.tokens, model.types) == (plain.tokens, plain.types)
    rows = {r["doc_id"]: r for r in kn.score(documents(train + other), model).collect()}
    for i, text in train + other:
        assert rows[i]["n_tokens"] == len(tokens(text))
        assert rows[i]["n_known"] == sum(w in plain.unigrams for w in tokens(text))
        assert rows[i]["base_score"] == pytest.approx(plain.base(text), rel=1e-9)
        assert rows[i]["score"] == pytest.approx(plain.score(text), rel=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain([t for _, t in corpus(2)], 3)
    for context in [(START, START), ("the", "of"), ("unseen", "w3"), ("of", "the")]:
        total = sum(plain.p((*context, w)) for w in plain.unigrams) + plain.p((*context, "unseen"))
        assert total == pytest.approx(1)


def test_frequent_contexts_are_split_and_still_whole(documents):
    # Every context is made of frequent words here, so all n-grams are dealt one by one.
    train = [(k, "a b a b b a") for k in range(60)] + [(99, "a a a c")]
    model = kn.train(documents(train), 2)
    assert len(model.frequent) > 2
    plain = Plain([t for _, t in train], 2)
    rows = kn.score(documents(train), model).collect()
    for r in rows:
        assert r["score"] == pytest.approx(plain.score(dict(train)[r["doc_id"]]), rel=1e-9)


def test_empty_tables_and_repeats(documents):
    model = kn.train(documents([]), 2)
    row = kn.score(documents([(1, "a b"), (1, "a b")]), model).collect()
    assert [r["n_known"] for r in row] == [0, 0] and row[0]["score"] == 0
    assert kn.score(documents([]), model).count() == 0


def test_long_text_and_extra_columns(documents):
    long = " ".join(f"k{n % 977}" for n in range(300_000))
    model = kn.train(documents([(1, long), (2, "k1 k2")]), 2)
    rows = kn.score(documents([(1, long)]).withColumn("score", F.lit(1)), model).collect()
    assert rows[0]["n_tokens"] == 300_001 and np.isfinite(rows[0]["score"])


def test_query_beats_the_base_on_held_out_text(spark, small):
    rows = kn.op2_kneser_ney(spark, small).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_blocks_are_narrow_and_come_back_whole():
    rng = np.random.default_rng(2)
    blocks, grams, counts = [], [], []
    for size, most in ((5, 9), (0, 1), (300, 1 << 40)):
        grams.append(rng.integers(0, 1 << 32, (size, 3), dtype=np.uint32))
        counts.append(rng.integers(1, most, size) if size else np.zeros(0, np.int64))
        row = kn._block(kn.NUMBERS, 0, grams[-1], [counts[-1]])
        blocks.append(dict(zip(kn._BLOCK.names, row)))
    assert np.array_equal(kn._grams(blocks, "uint32", 3), np.concatenate(grams))
    assert np.array_equal(kn._counts(blocks, "a"), np.concatenate(counts))
    assert len(blocks[0]["a"]) == 6


def test_packed_tables_give_back_what_they_hold(tmp_path):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    keys = np.unique(np.append(keys, keys[:400] + np.uint64(2**32)))  # neighbours with equal low bits
    values = rng.integers(1, 9, len(keys)), rng.random(len(keys)).round(1)
    packed = mapped.PackedTable(f"file://{tmp_path}/packed", 1, ("uint32", "float64"))
    for shard in range(2):
        at = packed.shard(keys) == shard
        packed.write(shard, keys[at], *(v[at] for v in values))
    asked = np.concatenate([keys, rng.integers(0, 2**64, 3000, dtype=np.uint64), [np.uint64(0), np.uint64(2**64 - 1)]])
    one, other, there, _ = packed.find(asked)
    assert (there == np.isin(asked, keys)).all() and there[: len(keys)].all()
    assert (one[: len(keys)] == values[0]).all() and (other[: len(keys)] == values[1]).all()
    assert sum(f.stat().st_size for f in (tmp_path / "packed").iterdir()) < 10 * len(keys)


def test_frequent_words_have_small_numbers_and_no_table_of_counts_is_left(documents, spark):
    texts = documents([(k, " ".join(f"w{j}" for j in range(k % 40))) for k in range(200)])
    before = set(Path(shared_folder(spark).removeprefix("file://")).glob("*/grams[23]-*"))
    model = kn.train(texts)
    words = [f"w{j}".encode() for j in range(39)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    tokens, _ = kn.tokens_of(data, np.array([0, len(data)]))
    ids, counts = kn.numbers(model.vocabulary, model.base, tokens)
    assert sorted(ids) == list(range(40))
    assert (np.diff(kn.class_of(counts[np.argsort(ids)])) <= 0).all()
    folder = Path(model.vocabulary.folder.removeprefix("file://")).parent.parent
    assert set(folder.glob("grams3-*")) <= before and set(folder.glob("grams2-*")) <= before


def test_texts_of_a_batch_are_scored_at_once_not_in_small_pieces():
    # Every piece looks into all shards of all tables.
    batch = pa.RecordBatch.from_arrays([pa.array(["some words " * 2000] * 100)], names=["text"])
    assert len(list(kn._texts(iter([batch]), kn.SCORED))) == 1


@pytest.mark.parametrize("frequent", [[], [kn.START_ID], [3, 5, kn.START_ID], [0, 9]])
def test_frequent_numbers_are_those_listed(frequent):
    ids = np.array([[0, 3], [9, 5], [10, kn.START_ID], [kn.UNKNOWN_ID, 4]], np.uint32)
    frequent = np.array(frequent, np.uint32)
    assert (kn._frequent(ids, frequent) == np.isin(ids, frequent)).all()
