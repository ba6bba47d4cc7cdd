"""Removal of repeated byte strings, with suffixes sampled by a difference cover.

A string of 50 bytes is removed from a document where it also starts in a document of
smaller id. Comparing all suffixes would move every byte of the corpus many times
over, so they are sampled: the residues of a difference cover modulo 31 are such that any
two places have a common distance below 31 at which both are sampled. Two equal
strings of 50 bytes therefore hold equal sampled tuples of 20 bytes at the same distance.
Sampled tuples are dealt by their hash and grouped by equality, and within a group strings of 50
bytes are grouped by theirs. So of the difference-cover algorithm the sampling is kept, and
grouping by hashes stands in for naming by rank, for the recursion on names and for the merge
with comparison of neighbours: at a fixed depth equality is all that is asked, and no order.

Before the sort, passages without a repeated fingerprint (the smallest hash of every 31
neighbouring tuples) are set aside, whole equal texts are one text, and equal
surroundings within a task are one sample, so a passage of a third of all documents
sends one sample a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import textbytes
from weftline.llm.mapped import Table, key_table
from weftline.llm.passages import sliding
from weftline.llm.registry import query
from weftline.scratch import fresh_path, written
from weftline.sources.tables import table

LENGTH = 50
PERIOD = 31
TUPLE = LENGTH - PERIOD + 1
# Every difference modulo 31 is one of two of these.
COVER = (1, 5, 11, 24, 25, 27)
BEFORE = PERIOD - 1
FLUSH_BYTES = 3 << 20
GROUP_ROWS = 16_000
STEP = 256 << 10

_SAMPLED = np.zeros(PERIOD, bool)
_SAMPLED[list(COVER)] = True
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(127, textbytes.BASE, np.uint64)))

BLOCK = "kind int, shard int, file string, a binary, b binary, c binary"
SAMPLES, SPANS = 0, 1
_BLOCK = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _BLOCK]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)


def string_hashes(data: np.ndarray, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width the hashes of all strings of so many bytes, along the last axis.

    Strings of a power of two come from two halves; other widths from such parts. Long
    data is worked through in overlapping steps, so the parts stay small.
    """
    if data.ndim == 1 and len(data) > 2 * STEP:
        over = max(widths) - 1
        steps = [string_hashes(data[at : at + STEP + over], widths) for at in range(0, len(data), STEP)]
        return [np.concatenate([s[k][:STEP] for s in steps]) for k in range(len(widths))]
    parts = {1: textbytes.LETTERS[data]}
    n, size = data.shape[-1], 1
    while size * 2 <= min(max(widths), n):
        half = parts[size]
        parts[size * 2] = half[..., : n - 2 * size + 1] + half[..., size:][..., : n - 2 * size + 1] * _POWERS[size]
        size *= 2
    out = []
    for width in widths:
        if width > n:
            out.append(np.zeros((*data.shape[:-1], 0), np.uint64))
            continue
        total, at = np.zeros((*data.shape[:-1], n - width + 1), np.uint64), 0
        for size in sorted(parts, reverse=True):
            if (width - at) & size:
                total += parts[size][..., at : at + n - width + 1] * _POWERS[at]
                at += size
        out.append(textbytes.mix(total))
    return out


def _store(path: str, *arrays: np.ndarray) -> None:
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    made = f"{name}.{TaskContext.get().taskAttemptId()}"
    with store.open_output_stream(made) as out:
        for array in arrays:
            out.write(np.int64(array.nbytes).tobytes())
            out.write(np.ascontiguousarray(array).tobytes())
            out.write(b"\0" * (-array.nbytes % 8))
    store.move(made, name)


_loaded: dict[str, list[np.ndarray]] = {}


def _load(path: str, *kinds: str) -> list[np.ndarray]:
    if path not in _loaded:
        store, name = fs.FileSystem.from_uri(path)
        raw = store.open_input_file(name).read_buffer() if not isinstance(store, fs.LocalFileSystem) else np.memmap(name, np.uint8, "r")
        raw, at, out = np.frombuffer(raw, np.uint8) if not isinstance(raw, np.ndarray) else raw, 0, []
        for kind in kinds:
            size = int(raw[at : at + 8].view(np.int64)[0])
            out.append(raw[at + 8 : at + 8 + size].view(kind))
            at += 8 + size + (-size % 8)
        _loaded[path] = out
    return _loaded[path]


def _fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tuple hashes of all places, and the places (and their texts) whose hash is the
    smallest of some ``PERIOD`` neighbours, all within one text."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    (hashes,) = string_hashes(data, (TUPLE,))
    starts = offsets[:-1]
    low = sliding(hashes, PERIOD, np.minimum, 2**64 - 1)
    # Windows that run over the end of their text do not count.
    for end in offsets[1:]:
        low[max(0, end - LENGTH + 1) : end] = 0
    edge = np.zeros(PERIOD - 1, np.uint64)
    high = sliding(np.concatenate([edge, low, edge]), PERIOD, np.maximum, 0)
    places = np.flatnonzero((high == hashes) & (high > 0))
    return hashes, places, np.searchsorted(starts, places, side="right") - 1


def _fresh(batches: Iterator[pa.RecordBatch], copies: Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of texts that are long enough and no copies: keys, ids, bytes and offsets."""
    for batch in batches:
        keys = batch.column("key").to_numpy().view(np.uint64)
        ids = batch.column("doc_id")
        batch = batch.filter(pa.array(~copies.find(keys)[-2] & ids.is_valid().to_numpy(zero_copy_only=False)))
        keys = batch.column("key").to_numpy()
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in textbytes.pieces(batch.column("text")):
            yield keys[first:last], ids[first:last], data, offsets


def _by_shard(values: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Where each shard's part lies in sorted values."""
    bounds = np.searchsorted(Table("", bits, ()).shard(values), np.arange((1 << bits) + 1))
    for shard, (x, y) in enumerate(zip(bounds, bounds[1:])):
        if y > x:
            yield shard, slice(x, y)


def _count_fingerprints(copies: Table, bits: int):
    """Blocks of fingerprints, and whether two texts or more of the task have them. The
    top bits name the shard; 40 of the others are enough to sieve."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, many = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for shard, part in _by_shard(values, bits):
                rest = (values[part] << np.uint64(bits)) >> np.uint64(24)
                rows.append((SAMPLES, shard, None, rest.astype(np.uint32).tobytes(), (rest >> np.uint64(32)).astype(np.uint8).tobytes(), (many[part] > 1).tobytes()))
            return _batch(rows)

        for _, _, data, offsets in _fresh(batches, copies):
            hashes, places, text = _fingerprints(data, offsets)
            if len(places):
                order = np.lexsort((hashes[places], text))
                found, owner = hashes[places][order], text[order]
                first = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))
                held.append(found[first])
                size += len(held[-1])
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return count


def _repeated(store: Table):
    """Stores the fingerprints of each shard that more than one text has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            a, b, c = (np.concatenate([np.frombuffer(r[n], k) for r in rows]) for n, k in (("a", "uint32"), ("b", "uint8"), ("c", "bool")))
            values = a.astype(np.uint64) | (b.astype(np.uint64) << np.uint64(32))
            values, first, many = np.unique(values, return_inverse=True, return_counts=True)
            twice = (many > 1) | (np.bincount(first, c, len(values)) > 0)
            store.write(shard, (np.uint64(shard) << np.uint64(64 - store.bits)) | (values[twice] << np.uint64(24 - store.bits)))
            yield _batch([(SAMPLES, shard, None, None, None, None)])

    return merge


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
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


def _sieved(values: np.ndarray, repeated: Table) -> np.ndarray:
    low = np.uint64(24 - repeated.bits)
    return repeated.find((values >> low) << low)[-2]


def _sample(copies: Table, repeated: Table, folder: str, bits: int):
    """Writes the passages with repeated fingerprints; gives their samples by tuple, and
    the spans that a smaller document of the same task settles."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number = size = 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            text = np.concatenate([h[0] for h in held])
            keys, ids, begins, sizes = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            starts = np.cumsum(sizes) - sizes
            name = f"{part}-{number}"
            _store(f"{folder}/{name}", text, starts, sizes, ids, keys, begins)
            hashes, around = string_hashes(text, (TUPLE, BEFORE + LENGTH))
            region = np.repeat(np.arange(len(sizes)), sizes)
            within = np.arange(len(text)) - starts[region]
            take = _SAMPLED[(begins[region] + within) % PERIOD] & (within + TUPLE <= sizes[region])
            places = np.flatnonzero(take)
            whole = (within[places] >= BEFORE) & (within[places] + LENGTH <= sizes[region[places]])
            # Equal surroundings: all but those of the smallest document are covered.
            inner = places[whole]
            owner = ids[region[inner]]
            surroundings = around[inner - BEFORE]
            order = np.lexsort((owner, surroundings))
            head = np.append(True, surroundings[order][1:] != surroundings[order][:-1]) if len(order) else np.zeros(0, bool)
            least = owner[order][head][np.cumsum(head) - 1] if len(order) else owner
            covered = np.zeros(len(text), bool)
            covered[inner[order][owner[order] > least]] = True
            sent = places[~covered[places]]
            sent = sent[np.argsort(hashes[sent], kind="stable")]
            out = [(SAMPLES, s, name, hashes[sent[x]].tobytes(), sent[x].astype(np.uint32).tobytes(), None) for s, x in _by_shard(hashes[sent], bits)]
            done = np.flatnonzero(covered)
            at = begins[region[done]] + within[done]
            out += _spans(keys[region[done]], at - BEFORE, at + LENGTH, bits)
            yield _batch(out)

        for keys, ids, data, offsets in _fresh(batches, copies):
            hashes, places, _ = _fingerprints(data, offsets)
            if not len(places):
                continue
            places = places[_sieved(hashes[places], repeated)]
            marks = np.zeros(len(data) + 1, np.int32)
            owner = np.searchsorted(offsets, places, side="right") - 1
            np.add.at(marks, np.maximum(places - BEFORE, offsets[owner]), 1)
            np.add.at(marks, np.minimum(places + LENGTH, offsets[owner + 1]), -1)
            inside = np.cumsum(marks[:-1]) > 0
            text_starts = np.zeros(len(data) + 1, bool)
            text_starts[offsets[:-1]] = True
            begins = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | text_starts[:-1]))
            ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | text_starts[1:])) + 1
            if len(begins):
                doc = np.searchsorted(offsets, begins, side="right") - 1
                held.append((data[inside], keys[doc], ids[doc], begins - offsets[doc], ends - begins))
                size += int((ends - begins).sum())
            if size > FLUSH_BYTES:
                yield from flush()
                held, size, number = [], 0, number + 1
        if held:
            yield from flush()

    return sample


def _spans(keys: np.ndarray, first: np.ndarray, last: np.ndarray, bits: int) -> list[tuple]:
    """Blocks of covered spans, by document; those that touch are one."""
    keys = keys.view(np.uint64)
    order = np.lexsort((first, keys))
    keys, first, last = _joined(keys[order], first[order], last[order])
    return [(SPANS, s, None, keys[x].tobytes(), first[x].astype(np.int64).tobytes(), last[x].astype(np.int64).tobytes()) for s, x in _by_shard(keys, bits)]


def _joined(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted spans, overlapping and touching ones of a key as one."""
    if not len(keys):
        return keys, first, last
    heads = np.append(True, keys[1:] != keys[:-1])
    # Running ends within a key: shift each key's spans beyond all those before.
    group = np.cumsum(heads) - 1
    shift = group * (int(last.max()) + 2)
    reach = np.maximum.accumulate(last + shift)
    new = np.append(True, (first + shift)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(keys)) - 1
    return keys[at], first[at], (reach - shift)[ends]


def _compare(folder: str, bits: int):
    """Sorts each shard's samples by tuple and compares those that are equal, over all the
    strings that hold them; passes spans on."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            spans = [(SPANS, *[r[n] for n in ("shard", "file", "a", "b", "c")]) for r in rows if r["kind"] == SPANS]
            if spans:
                yield _batch(spans)
            rows = [r for r in rows if r["kind"] == SAMPLES]
            if not rows:
                continue
            names = sorted({r["file"] for r in rows})
            number = {n: k for k, n in enumerate(names)}
            tuples = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
            places = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows])
            files = np.concatenate([np.full(len(r["b"]) // 4, number[r["file"]], np.int32) for r in rows])
            order = np.argsort(tuples, kind="stable")
            tuples, places, files = tuples[order], places[order], files[order]
            # Names: the rank of each distinct tuple. A name met once has no partner.
            heads = np.flatnonzero(np.append(True, tuples[1:] != tuples[:-1]))
            size = np.diff(np.append(heads, len(tuples)))
            keep = np.repeat(size > 1, size)
            places, files = places[keep], files[keep]
            ends = np.cumsum(size[size > 1])
            at = 0
            while at < len(places):
                to = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + GROUP_ROWS))])
                found = _repeats(folder, names, files[at:to], places[at:to])
                if found:
                    yield _batch(_spans(*found, bits))
                at = to

    return compare


def _repeats(folder: str, names: list[str], files: np.ndarray, places: np.ndarray):
    """Of samples with equal tuples: key and span of the strings around each that also
    start in a smaller document."""
    n = len(places)
    around = np.zeros((n, BEFORE + LENGTH), np.uint8)
    doc, key, begin, room, left = (np.zeros(n, np.int64) for _ in range(5))
    for f in np.unique(files):
        mine = np.flatnonzero(files == f)
        text, starts, sizes, ids, keys, begins = _load(f"{folder}/{names[f]}", "uint8", "int64", "int64", "int64", "int64", "int64")
        at = places[mine].astype(np.int64)
        region = np.searchsorted(starts, at, side="right") - 1
        window = np.clip(at[:, None] + np.arange(-BEFORE, LENGTH), 0, len(text) - 1)
        around[mine] = text[window]
        doc[mine], key[mine] = ids[region], keys[region]
        left[mine] = at - starts[region]
        room[mine] = sizes[region] - left[mine]
        begin[mine] = begins[region] + left[mine]
    (strings,) = string_hashes(around, (LENGTH,))  # column k starts BEFORE - k before the sample
    back = BEFORE - np.arange(PERIOD)
    valid = (back <= left[:, None]) & (LENGTH - back <= room[:, None])
    who, column = np.nonzero(valid)
    values, owner = strings[who, column], doc[who]
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    heads = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    least = owner[heads][np.cumsum(heads) - 1] if len(values) else owner
    hit = order[owner > least]
    if not len(hit):
        return None
    start = begin[who[hit]] - back[column[hit]]
    # The strings around one sample overlap: from the first to the end of the last.
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(first, who[hit], start)
    np.maximum.at(last, who[hit], start + LENGTH)
    some = np.flatnonzero(last >= 0)
    return key[some], first[some], last[some]


def _merge_spans(store: Table):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            keys, first, last = (np.concatenate([np.frombuffer(r[n], k) for r in rows]) for n, k in (("a", "uint64"), ("b", "int64"), ("c", "int64")))
            order = np.lexsort((first, keys))
            keys, first, last = _joined(keys[order], first[order], last[order])
            # A document's spans stand together; its key leads to the first of them.
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            count = np.diff(np.append(heads, len(keys)))
            _store(f"{store.folder}/spans-{shard}", first, last)
            store.write(shard, keys[heads], heads, count)
            yield _batch([(SPANS, shard, None, None, None, None)])

    return merge


@dataclass(frozen=True)
class Repeats:
    """Where the covered spans of each document lie, and which texts are copies."""

    spans: Table
    copies: Table

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        start, count, there, _ = self.spans.find(keys)
        shards = self.spans.shard(keys)
        none = np.zeros(0, np.int64)
        out = []
        for s, n, hit, shard in zip(start, count, there, shards):
            if hit:
                first, last = _load(f"{self.spans.folder}/spans-{shard}", "int64", "int64")
                out.append((first[s : s + n], last[s : s + n]))
            else:
                out.append((none, none))
        return self.copies.find(keys)[-2], out


def _keyed(documents: DataFrame) -> DataFrame:
    """Ids and texts with a key for each different row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def find_repeats(documents: DataFrame) -> Repeats:
    """The spans of each document to remove, stored in the shared folder."""
    spark = documents.sparkSession
    folder = fresh_path(spark, "repeats")
    rows = _keyed(documents)
    bits = max(4, min(16, int(rows.rdd.getNumPartitions()).bit_length() + 1))
    marks = written(
        rows.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull()).select(
            "doc_id", "key", F.md5(F.col("text").cast("binary")).alias("mark")
        ),
        "marks",
    )
    firsts = marks.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    again = marks.join(firsts, "mark").where("doc_id > rep").select("key")
    copies = key_table(again, f"{folder}/copies", bits)

    def exchange(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(1 << bits, "shard").sortWithinPartitions("shard")

    repeated = Table(f"{folder}/fingerprints", bits, ())
    counted = exchange(rows.mapInArrow(_count_fingerprints(copies, bits), BLOCK))
    written(counted.mapInArrow(_repeated(repeated), BLOCK), "fingerprints")
    samples = rows.mapInArrow(_sample(copies, repeated, f"{folder}/passages", bits), BLOCK)
    compared = exchange(samples).mapInArrow(_compare(f"{folder}/passages", bits), BLOCK)
    spans = Table(f"{folder}/spans", bits, ("int64", "int64"))
    written(exchange(compared).mapInArrow(_merge_spans(spans), BLOCK), "spans")
    return Repeats(spans, copies)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(documents: DataFrame, *, keep_text: bool = True) -> DataFrame:
    """A row a row of ``documents``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``
    and ``kept``, the bytes that are left (null unless ``keep_text``).

    Texts are UTF-8 bytes, null is empty. A byte goes where a string of 50 bytes that
    covers it also starts in a document of smaller id; matches never cross documents and
    are judged on the input. Rows without an id lose nothing and take nothing from others;
    rows of one id do not count against each other. No rows in, no rows out. Strings are
    compared by 64-bit hashes.
    """
    repeats = find_repeats(documents)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in textbytes.pieces(batch.column("text")):
                keys = batch.column("key").slice(first, last - first).to_numpy().view(np.uint64)
                ids = batch.column("doc_id").slice(first, last - first)
                copies, spans = repeats.of(keys)
                rows = []
                for k, doc in enumerate(ids.to_pylist()):
                    text = data[offsets[k] : offsets[k + 1]]
                    starts, ends = spans[k]
                    if doc is None:
                        starts = ends = starts[:0]
                    elif copies[k]:
                        starts, ends = np.array([0]), np.array([len(text)])
                    keep, at = [], 0
                    for s, e in zip(starts.tolist(), ends.tolist()):
                        keep.append(text[at:s])
                        at = e
                    keep.append(text[at:])
                    left = b"".join(x.tobytes() for x in keep)
                    rows.append((doc, len(text), len(text) - len(left), len(starts), hashlib.sha256(left).hexdigest(), left if keep_text else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _keyed(documents).mapInArrow(cut, REMOVED)


@query()
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 50 bytes that start in one of smaller id."""
    return remove_repeats(table(spark, folder, "documents"), keep_text=False).drop("kept")
