"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items build one automaton of all their substrings. Each
text's words are streamed through it while the longest match that ends at each
word is tracked; a match as long as a window marks its words. Items come in blocks of a
bounded number of words, one automaton a block, so what is sent to the workers has
a fixed bound whatever the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm import textbytes
from weftline.llm.registry import query
from weftline.scratch import written
from weftline.sources.tables import table

WINDOW = 13
BLOCK_WORDS = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of a text in any case


class Automaton:
    """All substrings of several sequences of words.

    States stand for sets of substrings that end at the same places. ``marks`` gives
    for a state the items that hold its window: for states of ``window`` words or
    more the items of their last ``window`` words, for others those shorter items
    that are this very string.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.marks: dict[int, set[str]] = {}
        self.exact: dict[int, dict[int, set[str]]] = {}
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # Which items hold which window, and which states short items end in.
        for item, words in items:
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if len(words) >= window and at + 1 >= window:
                    self.marks.setdefault(self._cut(state), set()).add(item)
            if 0 < len(words) < window:
                self.exact.setdefault(state, {}).setdefault(len(words), set()).add(item)
        # The nearest state on the way to the root, itself included, with a short item.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.short = [-1] * len(self.link)
        for state in order:
            above = self.link[state]
            self.short[state] = state if state in self.exact else (self.short[above] if above >= 0 else -1)
        self.pairs = {pair for _, words in items for pair in zip(words, words[1:])}
        self.least = min([min(len(w), window) for _, w in items if w], default=window)

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            known = self.next[last][word]
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            known = self.next[at][word]
            whole = self.length[known] == self.length[at] + 1
            self.link[new] = known if whole else self._split(at, word, known)
        return new

    def _state(self, length: int, following: dict[bytes, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, word: bytes, known: int) -> int:
        """Sets the shorter strings of ``known``, those that follow ``at``, apart."""
        copy = self._state(self.length[at] + 1, dict(self.next[known]))
        self.link[copy] = self.link[known]
        self.link[known] = copy
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _cut(self, state: int) -> int:
        """The state of the last ``window`` words of a state's strings."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """First and last word of each match as long as a window, and its items."""
        state = length = 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if length >= self.window:
                yield at - length + 1, at, self.marks[self._cut(state)]
            found = self.short[state]
            while found >= 0:
                for size, items in self.exact[found].items():
                    if size <= length:
                        yield at - size + 1, at, items
                above = self.link[found]
                found = self.short[above] if above >= 0 else -1


def item_words(text: Column) -> Column:
    """Normalised words of a text: letters in lower case (A-Z only), digits and other scripts."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, NOT_WORD), lambda w: F.length(w) > 0)


def item_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The items, each with its words, in blocks of about ``block_words`` words."""
    items = benchmark.select(F.col("item_id").cast(StringType()).alias("item_id"), item_words(F.col("text")).alias("words"))
    items = written(items.where(F.col("item_id").isNotNull() & (F.size("words") > 0)), "items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    if blocks == 1:
        return [items]
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    return [items.where(dealt == k) for k in range(blocks)]


FOUND = "_row string, text string, n_words long, spans array<struct<first:long,last:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FOUND = pa.schema(
    [("_row", pa.string()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]
)


def benchmark_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    key: str = "doc_id",
) -> DataFrame:
    """One row a row of ``documents``: its key as text (``_row``), ``n_words``, the hit
    ``spans`` (word numbers, joined where they touch) and the ``items`` with a window in it.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Null
    texts have no words; items without words or id hit nothing; repeated items count
    once an id. Repeated rows give a row each. An empty benchmark hits nothing.

    Beyond one block of items the rows pass through each block in turn, and are
    written in between, so a worker holds one automaton at a time.
    """
    rows = documents.select(
        F.col(key).cast("string").alias("_row"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<first:long,last:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = item_blocks(benchmark, block_words)
    for k, block in enumerate(blocks):
        # Bounded by block_words, and by the longest item.
        items = [(r["item_id"], [w.encode() for w in r["words"]]) for r in block.collect()]
        last = k == len(blocks) - 1
        rows = rows.mapInArrow(_scanner(documents.sparkSession, items, window, not last), FOUND)
        if not last:
            rows = written(rows, "hits")
    return rows.drop("text")


def _scanner(spark: SparkSession, items: list[tuple[str, list[bytes]]], window: int, keep_text: bool):
    automaton = Automaton(items, window)
    vocabulary = sorted({w for _, words in items for w in words})
    joined = np.frombuffer(b"".join(vocabulary), np.uint8)
    ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64) if vocabulary else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if vocabulary else ends
    known = np.sort(textbytes.hash_spans(joined, starts, ends))

    def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return textbytes.mix(first * np.uint64(3) + second)

    by_word = dict(zip(vocabulary, textbytes.hash_spans(joined, starts, ends)))
    pairs = np.array([(by_word[a], by_word[b]) for a, b in automaton.pairs], np.uint64).reshape(-1, 2)
    pair_table = np.sort(pair_hashes(pairs[:, 0], pairs[:, 1]))
    least = automaton.least
    # Plain values only, so that workers need not import this module to load them.
    state = {k: v for k, v in vars(automaton).items() if k != "pairs"}
    shared = spark.sparkContext.broadcast((state, known, pair_table))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known, pair_table = shared.value
        automaton = Automaton.__new__(Automaton)
        vars(automaton).update(state)
        for batch in batches:
            for first, last, data, offsets in textbytes.pieces(batch.column("text")):
                part = batch.slice(first, last - first)
                start, end, text = textbytes.word_spans(data, offsets, textbytes.ALPHANUMERIC)
                spans = [[(s["first"], s["last"]) for s in row] for row in part.column("spans").to_pylist()]
                items = [set(row) for row in part.column("items").to_pylist()]
                for a, b in _runs(data, start, end, text, known, pair_table, pair_hashes, least):
                    doc = int(text[a])
                    shift = a - int(np.searchsorted(text, doc))
                    base = start[a]
                    low = textbytes.LOWER[data[base : end[b]]].tobytes()
                    words = [low[s:e] for s, e in zip(start[a : b + 1] - base, end[a : b + 1] - base)]
                    for x, y, hit in automaton.matches(words):
                        items[doc] |= hit
                        spans[doc].append((x + shift, y + shift))
                merged = [[{"first": x, "last": y} for x, y in _joined(row)] for row in spans]
                texts = part.column("text") if keep_text else pa.nulls(last - first, pa.string())
                counts = np.bincount(text, minlength=last - first)
                columns = [
                    part.column("_row"),
                    texts,
                    pa.array(counts, pa.int64()),
                    pa.array(merged, _SPANS),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    return scan


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def _member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _runs(data, start, end, text, known, pair_table, pair_hashes, least: int) -> Iterator[tuple[int, int]]:
    """First and last word of the runs in which a window can lie.

    Two neighbouring words that are neighbours in no item end every match of more than
    one word, so the automaton would fall back there; only runs without such a break,
    and of the least window's length, are streamed through it.
    """
    if not len(start):
        return
    hashes = textbytes.hash_spans(data, start, end)
    inside = _member(known, hashes)
    follows = np.zeros(len(start), bool)  # the word carries on from the one before
    both = np.flatnonzero(inside[1:] & inside[:-1] & (text[1:] == text[:-1])) + 1
    follows[both] = _member(pair_table, pair_hashes(hashes[both - 1], hashes[both]))
    heads = np.flatnonzero(inside & ~follows)
    tails = np.flatnonzero(inside & ~np.append(follows[1:], False))
    long = tails - heads + 1 >= least
    yield from zip(heads[long].tolist(), tails[long].tolist())


def _judged(hits: DataFrame) -> DataFrame:
    """Adds ``n_hit`` and ``contaminated``: a twentieth or more of the words hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    judged = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return hits.withColumn("n_hit", n_hit).withColumn("contaminated", judged)


def contamination(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated``; contaminated are those with a twentieth or more of their words hit.
    See ``benchmark_hits`` for odd input."""
    return _judged(benchmark_hits(documents, benchmark, **settings)).select(
        F.col("_row").cast(documents.schema["doc_id"].dataType).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@F.pandas_udf(StringType())
def _without_words(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of their spans, from each first word to the last."""
    out = []
    for text, mine in zip(texts, spans):
        words = [m.span() for m in _WORD.finditer(text)]
        kept, at = [], 0
        for span in mine:
            kept.append(text[at : words[span["first"]][0]])
            at = words[span["last"]][1]
        out.append("".join(kept) + text[at:])
    return pd.Series(out)


def decontaminate(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, all columns. Spans of the benchmark in
    them are cut from their texts, and ``n_chars``, if there is such a column, is brought
    up to date. Each row is judged by itself, whatever its id; see ``benchmark_hits``."""
    keyed = documents.withColumn("_key", F.xxhash64("doc_id", "text").cast("string"))
    hits = _judged(benchmark_hits(keyed, benchmark, key="_key", **settings)).where("n_hit > 0")
    hits = written(
        hits.select(F.col("_row").alias("_key"), F.col("spans").alias("_spans"), F.col("contaminated").alias("_bad"))
        .dropDuplicates(["_key"]),
        "hits",
    )
    untouched = keyed.join(hits, "_key", "left_anti").select(*documents.columns)
    cut = keyed.join(hits.where("NOT _bad"), "_key").withColumn("text", _without_words("text", "_spans"))
    if "n_chars" in documents.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return untouched.unionByName(cut.select(*documents.columns))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark
), spans AS (
  SELECT item_id, words, least(13, len(words)) AS size, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS i
  FROM b WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS w FROM spans
), sizes AS (SELECT DISTINCT size FROM windows
), starts AS (
  SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM d, sizes
), hits AS (
  SELECT doc_id, i, s.size, item_id
  FROM (SELECT doc_id, i, size, array_to_string(words[i : i + size - 1], ' ') AS w FROM starts) s
  JOIN windows ON windows.w = s.w AND windows.size = s.size
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
"""


@query(OP10_SQL)
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against every benchmark item."""
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
