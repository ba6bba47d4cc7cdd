"""An interpolated modified Kneser-Ney n-gram model over documents.

Words get numbers from a counted vocabulary, frequent ones the small numbers, which
pack well. Every task counts the n-grams of its own
texts and sends them in blocks of arrays, shard by shard; a shard's blocks are merged,
stored as sorted hash arrays in the shared folder, and give the continuation counts of
the next lower order. Scoring maps the arrays and looks up each text's n-grams.
Shards follow the context, so its totals come out in one place; contexts made of
frequent words only are dealt by the whole n-gram, and their totals summed after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textbytes
from weftline.llm.mapped import PackedTable, Table, opened
from weftline.llm.registry import query
from weftline.scratch import fresh_path, removed, written
from weftline.sources.tables import table

ROUTE_BITS = 16
HELD_ENTRIES = 2_000_000
# Bytes of texts scored at once: every shard is looked into for each.
SCORED = 4 << 20

# The end of a text as a hash, and word numbers of text starts and of
# words outside the vocabulary.
END = np.uint64(0xE0D0F0A0C0B0E0D1)
START_ID = np.uint32(0xFFFFFFFF)
UNKNOWN_ID = np.uint32(0xFFFFFFFE)

BLOCK = "kind int, shard int, grams binary, a binary, b binary, c binary, d binary, n1 long, n2 long, n3 long, n4 long"
NUMBERS, CONTEXTS, STATISTICS = 0, 1, 2


@dataclass(frozen=True)
class Level:
    """Counts of one order, its contexts, and the discounts of counts 1, 2 and more."""

    counts: Table
    contexts: Table | None
    discounts: tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    order: int
    vocabulary: Table
    base: np.ndarray  # number of the first word of each shard (a row) and class of counts
    tokens: int
    types: int
    frequent: np.ndarray  # numbers of the words that split contexts
    levels: tuple[Level, ...]  # from order 1
    start_total: float  # of the empty context
    start_gamma: float


def _block(kind: int, shard, grams=None, values=(), stats=(None,) * 4) -> tuple:
    packed = [_narrow(v) for v in values]
    packed += [None] * (4 - len(packed))
    return (kind, shard, None if grams is None else _squeezed(_planes(grams)), *packed, *stats)


def _sorted_block(kind: int, shard: int, grams: np.ndarray, values: list[np.ndarray]) -> tuple:
    """A block whose n-grams lie by their first words, where they pack best."""
    first = grams[:, 0].astype(np.uint64)
    order = np.argsort(first << np.uint64(32) | grams[:, 1] if grams.shape[1] > 1 else first)
    return _block(kind, shard, grams[order], [v[order] for v in values])


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosened(packed: bytes) -> bytes:
    return pa.decompress(bytes(packed[8:]), int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _planes(grams: np.ndarray) -> bytes:
    """All first bytes, then all second ones: the high bytes of word numbers compress well so."""
    return np.ascontiguousarray(grams).view(np.uint8).reshape(len(grams), -1 if len(grams) else 1).T.tobytes()


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, after its letter; after ``z`` packed,
    where that is shorter."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    plain = kind.char.encode() + counts.astype(kind).tobytes()
    packed = b"z" + _squeezed(plain)
    return packed if len(packed) < len(plain) else plain


_BLOCK = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32()), ("grams", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("n4", pa.int64())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCK)], schema=_BLOCK)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and the sums of their values."""
    order = np.argsort(keys)
    ordered = keys[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values]
    return ordered[heads], order[heads], sums


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the ends of texts, and the text of each."""
    start, end, text = textbytes.word_spans(data, offsets)
    words = textbytes.hash_spans(data, start, end)
    after = np.searchsorted(text, np.arange(len(offsets) - 1), side="right")
    return np.insert(words, after, END), np.insert(text, after, np.arange(len(offsets) - 1))


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers; of rows without numbers a constant."""
    h = np.full(len(grams), 7, np.uint64)
    for column in range(grams.shape[1]):
        h = textbytes.mix(h * np.uint64(31) + grams[:, column].astype(np.uint64) + np.uint64(1))
    return h


def gram_key(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Where an n-gram is stored: top bits by its context (or by all of it, if all words
    of the context are frequent), the rest by all of it."""
    whole = gram_hash(grams)
    context = grams[:, :-1]
    split = _frequent(context, frequent).all(axis=1)
    route = np.where(split, whole, gram_hash(context))
    top = np.uint64(64 - ROUTE_BITS)
    return ((textbytes.mix(route) >> top) << top) | (whole >> np.uint64(ROUTE_BITS))


def _frequent(ids: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Whether each number is one of ``frequent``, which are small but for that of text starts."""
    small = frequent[frequent != START_ID]
    marks = np.zeros(int(small.max(initial=0)) + 2, bool)
    marks[small] = True
    out = marks[np.minimum(ids, np.uint32(len(marks) - 1))]
    return out | (ids == START_ID) if len(small) < len(frequent) else out


CLASSES = 64


def class_of(counts: np.ndarray) -> np.ndarray:
    """Counts from one power of two to the next are a class."""
    return np.frexp(counts.astype(np.float64))[1]


def numbers(model_vocabulary: Table, base: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and training counts of tokens."""
    count, place, there, _ = model_vocabulary.find(tokens)
    ids = (base[model_vocabulary.shard(tokens), class_of(count)] + place).astype(np.uint32)
    return np.where(there, ids, UNKNOWN_ID), count


def histories(ids: np.ndarray, text: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each token; before a text's first token stand starts."""
    grams = np.empty((len(ids), order), np.uint32)
    grams[:, -1] = ids
    for back in range(1, order):
        shifted = np.full(len(ids), START_ID, np.uint32)
        if back < len(ids):
            same = text[back:] == text[:-back]
            shifted[back:][same] = ids[:-back][same]
        grams[:, -1 - back] = shifted
    return grams


def _texts(batches: Iterator[pa.RecordBatch], limit: int = textbytes.PIECE) -> Iterator[tuple]:
    for batch in batches:
        for first, last, data, offsets in textbytes.pieces(batch.column("text"), limit):
            yield batch, first, last, data, offsets


def _count_words(bits: int):
    """Blocks of word counts, by top bits of the word's hash."""
    place = Table("", bits, ())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            keys, _, (sums,) = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            bounds = np.searchsorted(place.shard(keys), np.arange((1 << bits) + 1))
            return _batch([_block(NUMBERS, s, keys[x:y], [sums[x:y]]) for s, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x])

        for _, _, _, data, offsets in _texts(batches):
            keys, counts = np.unique(tokens_of(data, offsets)[0], return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size > HELD_ENTRIES:
                yield flush()
                held, size = [], 0
        if held and size:
            yield flush()

    return count


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The blocks of each shard, from batches sorted by shard."""
    shard, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != shard:
                if held:
                    yield shard, held
                shard, held = row["shard"], []
            held.append(row)
    if held:
        yield shard, held


def _grams(blocks: list[dict], kind: str, width: int = 1) -> np.ndarray:
    """The rows that ``_planes`` took apart."""
    size = np.dtype(kind).itemsize * width
    planes = [np.frombuffer(_loosened(b["grams"]), np.uint8).reshape(size, -1) for b in blocks]
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(kind)


def _counts(blocks: list[dict], name: str) -> np.ndarray:
    raw = [_loosened(b[name][1:]) if b[name][:1] == b"z" else b[name] for b in blocks]
    return np.concatenate([np.frombuffer(r[1:], bytes(r[:1]).decode()).astype(np.int64) for r in raw])


def _merge_words(store: Table):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            keys, _, (counts,) = _summed(_grams(blocks, "uint64")[:, 0], _counts(blocks, "a"))
            kinds = class_of(counts)
            order, sizes = np.argsort(kinds, kind="stable"), np.bincount(kinds, minlength=CLASSES)
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys)) - (np.cumsum(sizes) - sizes)[kinds[order]]
            store.write(shard, keys, counts, place)
            yield _batch([_block(STATISTICS, shard, values=[sizes], stats=(len(keys), int(counts.sum()), 0, 0))])

    return merge


def _frequent_words(vocabulary: Table, base: np.ndarray, least: float):
    """Numbers and hashes of words with more than ``least`` uses, from the stored shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                keys, (counts, place) = opened(vocabulary, shard)
                at = np.flatnonzero(counts > least)
                ids = base[shard, class_of(counts[at])] + place[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(keys[at].view(np.int64))], names=["id", "hash"]
                )

    return read


def _count_grams(order: int, vocabulary: Table, base, frequent, bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Table("", bits, ())
        held, size = [], 0

        def flush():
            keys, first, (sums,) = _summed(*(np.concatenate(x) for x in ([k for k, _, _ in held], [c for _, _, c in held])))
            grams = np.concatenate([g for _, g, _ in held])[first]
            bounds = np.searchsorted(place.shard(keys), np.arange((1 << bits) + 1))
            return _batch([_sorted_block(NUMBERS, s, grams[x:y], [sums[x:y]]) for s, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x])

        for _, _, _, data, offsets in _texts(batches):
            tokens, text = tokens_of(data, offsets)
            grams = histories(numbers(vocabulary, base, tokens)[0], text, order)
            keys, first, (counts,) = _summed(gram_key(grams, frequent), np.ones(len(grams), np.int64))
            held.append((keys, grams[first], counts))
            size += len(keys)
            if size > HELD_ENTRIES:
                yield flush()
                held, size = [], 0
        if held and size:
            yield flush()

    return count


def _merge_grams(order: int, counts: Table, frequent, bits: int):
    """Stores a shard's counts; gives its contexts' totals, its counts of counts and, one
    for each n-gram, the counts of the order below."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            grams = _grams(blocks, "uint32", order)
            keys, first, (sums,) = _summed(gram_key(grams, frequent), _counts(blocks, "a"))
            grams = grams[first]
            counts.write(shard, keys, sums)
            out = [_block(STATISTICS, shard, stats=tuple(int((sums == n).sum()) for n in (1, 2, 3, 4)))]
            if order > 1:
                contexts = grams[:, :-1]
                where = gram_hash(contexts)
                found, at, totals = _summed(where, sums, *((test(sums)).astype(np.int64) for test in _CLASSES))
                out += _dealt(CONTEXTS, found, contexts[at], totals, bits)
                lower = grams[:, 1:]
                found, at, ways = _summed(gram_key(lower, frequent), np.ones(len(lower), np.int64))
                out += _dealt(NUMBERS, found, lower[at], ways, bits)
            else:
                out.append(_block(CONTEXTS, 0, grams[:0], [np.array([sums.sum()]), *(np.array([test(sums).sum()]) for test in _CLASSES)]))
            yield _batch(out)

    return merge


_CLASSES = (lambda c: c == 1, lambda c: c == 2, lambda c: c > 2)


def _dealt(kind: int, keys: np.ndarray, grams: np.ndarray, values: list[np.ndarray], bits: int) -> list[tuple]:
    bounds = np.searchsorted(Table("", bits, ()).shard(keys), np.arange((1 << bits) + 1))
    return [_sorted_block(kind, s, grams[x:y], [v[x:y] for v in values]) for s, (x, y) in enumerate(zip(bounds, bounds[1:])) if y > x]


def _merge_contexts(width: int, store: Table, discounts: tuple[float, float, float]):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blocks in _by_shard(batches):
            grams = _grams(blocks, "uint32", width)
            keys, _, sums = _summed(gram_hash(grams), *(_counts(blocks, c) for c in "abcd"))
            store.write(shard, keys, sum(d * n for d, n in zip(discounts, sums[1:])) / sums[0], sums[0])
            yield _batch([_block(STATISTICS, shard, stats=(len(keys), 0, 0, 0))])

    return merge


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from how many n-grams have counts 1 to 4. Where
    too few are seen for the estimate, half of each count up to 3."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _exchange(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard")


@dataclass(frozen=True)
class Vocabulary:
    """Counted words: their table, the number of the first word of each shard and class,
    and how many tokens and types there are."""

    table: Table
    base: np.ndarray
    tokens: int
    types: int

    @property
    def shards(self) -> int:
        return 1 << self.table.bits


def count_vocabulary(texts: DataFrame, folder: str) -> Vocabulary:
    """All words and text ends of the column ``text``, counted into a table."""
    bits = max(4, min(ROUTE_BITS, int(texts.rdd.getNumPartitions()).bit_length() + 1))
    store = Table(f"{folder}/words", bits, ("int64", "uint32"))
    blocks = _exchange(texts.mapInArrow(_count_words(bits), BLOCK), 1 << bits)
    words = written(blocks.mapInArrow(_merge_words(store), BLOCK), "words")
    rows = words.select("shard", "n1", "n2", "a").collect()  # a row a shard
    sizes = np.zeros((1 << bits, CLASSES), np.int64)
    for r in rows:
        sizes[r["shard"]] = _counts([r], "a")
    ordered = sizes[:, ::-1].T.ravel()  # the most frequent class of all shards first
    base = (np.cumsum(ordered) - ordered).reshape(CLASSES, -1).T[:, ::-1]
    return Vocabulary(store, base, sum(r["n2"] for r in rows), sum(r["n1"] for r in rows))


def frequent_words(spark: SparkSession, words: Vocabulary, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and hashes of the words that are more than ``share`` of all tokens: fewer
    than ``1 / share``."""
    shards = spark.range(0, words.shards, 1, min(words.shards, 64)).select(F.col("id").cast("int").alias("shard"))
    found = shards.mapInArrow(_frequent_words(words.table, words.base, words.tokens * share), "id long, hash long")
    rows = sorted((r["id"], r["hash"]) for r in found.collect())
    return np.array([i for i, _ in rows], np.uint32), np.array([h for _, h in rows], np.int64).view(np.uint64)


def train(documents: DataFrame, order: int = 3) -> Model:
    """Learn from the column ``text`` of all rows; null counts as empty.

    Two passes over the texts: one for the vocabulary, one for the n-grams. No rows give
    a model that knows no word.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    spark = documents.sparkSession
    folder = fresh_path(spark, "model")
    texts = documents.select(F.col("text").cast("string").alias("text"))
    words = count_vocabulary(texts, folder)
    vocabulary, base, tokens, types = words.table, words.base, words.tokens, words.types
    bits, shards = vocabulary.bits, words.shards
    # Words with more than an eighth of a shard's share of tokens.
    frequent = np.append(frequent_words(spark, words, 1 / (8 * shards))[0], START_ID)

    counted = texts.mapInArrow(_count_grams(order, vocabulary, base, frequent, bits), BLOCK)
    levels: list[Level] = []
    above = None
    # No count or total is above the number of tokens.
    whole = "uint32" if tokens < 1 << 32 else "int64"
    for n in range(order, 0, -1):
        counts = PackedTable(f"{folder}/counts{n}", bits, (whole,))
        merged = _exchange(counted, shards).mapInArrow(_merge_grams(n, counts, frequent, bits), BLOCK)
        merged = written(merged, f"grams{n}")
        if above is not None:
            removed(above)
        above = merged
        seen = merged.where(F.col("kind") == STATISTICS).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n1", "n2", "n3", "n4")]).first()
        discounts = discounts_of(*seen)
        contexts = None
        found = merged.where(F.col("kind") == CONTEXTS)
        if n > 1:
            contexts = PackedTable(f"{folder}/contexts{n}", bits, ("float64", whole))
            stored = _exchange(found, shards).mapInArrow(_merge_contexts(n - 1, contexts, discounts), BLOCK)
            written(stored, "contexts")
        else:
            parts = [[_counts([r], c)[0] for c in "abcd"] for r in found.collect()]  # a row a shard
            total, *kinds = np.sum(parts, axis=0) if parts else (0, 0, 0, 0)
        levels.append(Level(counts, contexts, discounts))
        counted = merged.where(F.col("kind") == NUMBERS)
    gamma = float(sum(d * k for d, k in zip(levels[-1].discounts, kinds)) / total) if total else 1.0
    return Model(order, vocabulary, base, tokens, types, frequent, tuple(reversed(levels)), float(total), gamma)


def probabilities(model: Model, grams: np.ndarray) -> np.ndarray:
    """Of the last word of each n-gram, given the others."""

    def kept(level: Level, counts: np.ndarray) -> np.ndarray:
        return counts - np.array((0.0, *level.discounts))[np.minimum(counts, 3)]

    p = np.full(len(grams), model.start_gamma / (model.types + 1))
    if model.start_total:
        p += kept(model.levels[0], model.levels[0].counts.find(gram_key(grams[:, -1:], model.frequent))[0]) / model.start_total
    for n in range(2, model.order + 1):
        level, part = model.levels[n - 1], grams[:, -n:]
        gamma, total, known, _ = level.contexts.find(gram_hash(part[:, :-1]))
        counts = level.counts.find(gram_key(part, model.frequent))[0]
        p = np.where(known, kept(level, counts) / np.maximum(total, 1) + gamma * p, p)
    return p


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row; null texts are empty
    and score their end. Rows that repeat are scored each."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, last, data, offsets in _texts(batches, SCORED):
            tokens, text = tokens_of(data, offsets)
            ids, counts = numbers(model.vocabulary, model.base, tokens)
            p = probabilities(model, histories(ids, text, model.order))
            size = last - first
            plain = np.log10((counts + 1) / (model.tokens + model.types + 1))
            columns = [
                batch.column("doc_id").slice(first, size),
                np.bincount(text, minlength=size),
                np.bincount(text[counts > 0], minlength=size),
                np.bincount(text, plain, size),
                np.bincount(text, np.log10(p), size),
            ]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
                schema=schema,
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORES)


def held_out(doc_id: Column) -> Column:
    """One document in seven, by checksum of its id; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


@query()
def op2_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    """Every document scored by a model of the documents that are not held out."""
    documents = table(spark, folder, "documents")
    model = train(documents.where(~held_out(F.col("doc_id"))))
    scored = score(documents, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
