"""Near-duplicate passages by compact windows.

A text is the sequence of its word shingles. Under one hash function every run of
shingles has a smallest hash; all runs of some length or more whose smallest hash is at
one place form one compact window, and the tree of smaller and smaller hashes
(the Cartesian tree) lists them: about 2 windows a least length, however many runs
there are. Windows of two documents with the same smallest hash agree under that
function. Documents whose windows agree under enough functions are compared shingle by
shingle, from their places in files of the shared folder: pairs move as ids.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import sketches, textbytes
from weftline.llm.graph import components
from weftline.llm.mapped import Table, key_table
from weftline.llm.registry import query
from weftline.llm.sieve import Sieve, sieve_of
from weftline.scratch import fresh_path, written
from weftline.sources.tables import table

SHINGLE = 5
FUNCTIONS = 6
ENOUGH = 3
ROUNDS = 2
LETTERS = 6  # bytes of a word, about
_SEEDS = np.random.default_rng(3).integers(1, 2**63, 64, dtype=np.uint64)


def shingle_sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in order, and where each text's begin."""
    start, end, text = textbytes.word_spans(data, offsets)
    values, first = textbytes.windows(textbytes.hash_spans(data, start, end), text, SHINGLE)
    return values, np.searchsorted(text[first], np.arange(len(offsets)))


def sliding(values: np.ndarray, width: int, reduce: np.ufunc, fill: int) -> np.ndarray:
    """The smallest or largest of every ``width`` neighbours, from running extremes of
    blocks seen from both sides."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = reduce.accumulate(grid, axis=1).ravel()
    back = reduce.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(back[: n - width + 1], ahead[width - 1 : n])


def compact_windows(
    values: np.ndarray, bounds: np.ndarray, least: int, owner: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """Compact windows of ``least`` or more values: first, place of the smallest, and last.

    ``bounds`` says where each sequence begins (and the last ends). Of equal values the
    leftmost counts. Only values that are smallest among ``least`` neighbours can have
    a window that wide, and what bounds such a window is of that kind too, so the tree
    is built over those alone.
    """
    if len(values) < least:
        return (np.zeros(0, np.int64),) * 3
    low = sliding(values, least, np.minimum, 2**64 - 1)
    if owner is None:
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low[owner[: len(low)] != owner[least - 1 :]] = 0
    edge = np.zeros(least - 1, np.uint64)
    high = sliding(np.concatenate([edge, low, edge]), least, np.maximum, 0)
    places = np.flatnonzero((high == values) & (high > 0))
    begin, end = bounds[:-1][owner[places]].tolist(), bounds[1:][owner[places]].tolist()
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int, int, int]] = []  # value, place, first, end of sequence
    for place, value, first, stop in zip(places.tolist(), values[places].tolist(), begin, end):
        if stack and stack[-1][3] != stop:
            out += [(f, p, s - 1) for _, p, f, s in stack if s - f >= least]
            stack = []
        while stack and stack[-1][0] > value:
            _, p, f, _ = stack.pop()
            if place - f >= least:
                out.append((f, p, place - 1))
        stack.append((value, place, stack[-1][1] + 1 if stack else first, stop))
    out += [(f, p, s - 1) for _, p, f, s in stack if s - f >= least]
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


WINDOWS = "v long, f int, doc long, l int, c int, r int"
SMALLEST = "v long, f int, doc long, c int"
_SMALLEST = pa.schema([("v", pa.int64()), ("f", pa.int32()), ("doc", pa.int64()), ("c", pa.int32())])


def _fresh(batches: Iterator[pa.RecordBatch], copies: Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Of runs of texts whose ``key`` is not in ``copies``: ids, shingles in order, and where each
    text's begin, and at last the end."""
    for batch in batches:
        batch = batch.filter(pa.array(~copies.find(batch.column("key").to_numpy().view(np.uint64))[-2]))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for first, last, data, offsets in textbytes.pieces(batch.column("text")):
            values, bounds = shingle_sequences(data, offsets)
            yield ids[first:last], values, np.append(bounds, len(values))[: last - first + 1]


def repeated_shingles(documents: DataFrame, copies: Table) -> Sieve:
    """The shingles that two documents or more have, and some others."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, values, bounds in _fresh(batches, copies):
            yield values, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), bounds[:-1]

    return sieve_of(documents.select("doc_id", "text", "key"), hashes, size // LETTERS, "repeated")


def _before_in(values: np.ndarray, owner: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where each value stood before in its own sequence, or -1; ``order`` sorts the values."""
    out = np.full(len(values), -1)
    same = np.flatnonzero((values[order[1:]] == values[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]))
    out[order[same + 1]] = order[same]
    return out


def _runs_of(marks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marked places, the run of neighbours of one owner that each is in, and where these begin
    among them, and at last the end."""
    places = np.flatnonzero(marks)
    heads = np.append(True, (np.diff(places) > 1) | (np.diff(owner[places]) != 0))[: len(places)]
    return places, np.cumsum(heads) - 1, np.append(np.flatnonzero(heads), len(places))


def in_reach(hits: np.ndarray, before: np.ndarray, owner: np.ndarray, bounds: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """Which places can be in a stretch of ``least`` places or more of one sequence of whose different
    values ``threshold`` or more are hits. No place of such a stretch is left out.

    First each hit counts, and of the others those that stand once. Then, among what is left,
    no ``least`` neighbours may have more different others than all hits of their run allow.
    """
    if len(hits) < least:
        return np.zeros(len(hits), bool)
    again = np.flatnonzero(before >= 0)
    once = np.ones(len(hits), bool)
    once[again] = once[before[again]] = False
    size = np.diff(bounds)
    # Sums before and after each place. From one sequence to the next they fall by more than any stretch gains.
    weights = np.zeros(len(hits) + len(size))
    weights[np.arange(len(hits)) + owner + 1] = np.where(hits, 1 - threshold, np.where(once, -threshold, 0.0))
    weights[(bounds[:-1] + np.arange(len(size)))[1:]] = -(size[:-1] + size[1:] + 1.0)
    sums = np.cumsum(weights)
    starts = _first_starts(sums, np.arange(len(sums)), 0.0)
    stops = np.flatnonzero(starts <= np.arange(len(sums)) - least)
    of = np.repeat(np.arange(len(size)), size + 1)[stops]
    marks = _covered(starts[stops] - of, stops - of, len(hits))
    others = _different(np.where(hits, len(hits), before), least)
    for _ in range(2):
        places, run, edges = _runs_of(marks, owner)
        if not len(places):
            break
        new = hits[places] & (before[places] < places[edges[:-1]][run])
        allowed = np.bincount(run[new], minlength=len(edges) - 1) * (1 - threshold) / threshold + 1e-6
        first = np.flatnonzero(run[: len(run) - least + 1] == run[least - 1 :])
        first = places[first[others[places[first]] <= allowed[run[first]]]]
        marks = _covered(first, first + least, len(hits))
    return marks


def _covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """The places that stretches hold."""
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1))[:n] > 0


def window_rows(documents: DataFrame, copies: Table, repeated: Sieve, functions: int, least: int, threshold: float) -> DataFrame:
    """The smallest hash of each compact window and its place, of all documents whose ``key``
    is not in ``copies``. Windows lie where ``repeated`` leaves room for a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values, bounds in _fresh(batches, copies):
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = np.argsort(values, kind="stable")
            hits = np.zeros(len(values), bool)
            hits[order] = repeated.known(values[order])
            places, part, edges = _runs_of(in_reach(hits, _before_in(values, owner, order), owner, bounds, least, threshold), owner)
            for f in range(functions):
                hashes = textbytes.mix(values[places] ^ _SEEDS[f])
                _, c, _ = compact_windows(hashes, edges, least, part)
                c = c[hits[places[c]]]  # no other document has the rest
                doc = owner[places[c]]
                columns = [hashes[c].view(np.int64), np.full(len(c), f), ids[doc], places[c] - bounds[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _SMALLEST)], schema=_SMALLEST)

    return documents.select("doc_id", "text", "key").mapInArrow(run, SMALLEST)


def sequences(documents: DataFrame, ids: DataFrame, folder: str, least: int) -> DataFrame:
    """Writes the shingle hashes of the documents in ``ids`` (``doc``), and of some others, to
    files in ``folder``, and gives ``doc, key, file, at, n``: where those of each text
    (``doc_id, text, key``) are. A task writes a file of its own, so nothing is shuffled and
    what a failed attempt left is never read."""
    sieve = documents.sparkSession.sparkContext.broadcast(sketches.id_filter(ids))
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, at = uuid.uuid4().hex, 0
        with store.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                batch = batch.filter(pa.array(sketches.known(sieve.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))
                for first, last, data, offsets in textbytes.pieces(batch.column("text")):
                    values, bounds = shingle_sequences(data, offsets)
                    bounds = np.append(bounds, len(values))[: len(offsets)]
                    out.write(values.tobytes())
                    size = np.diff(bounds)
                    columns = [*(batch.column(c).slice(first, last - first) for c in ("doc_id", "key")), pa.array([name] * len(size), pa.string()), pa.array(at + bounds[:-1], pa.int64()), pa.array(size, pa.int64())]
                    at += len(values)
                    yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(size >= least))

    places = documents.select("doc_id", "text", "key").mapInArrow(run, "doc long, key long, file string, at long, n long")
    return places.dropDuplicates(["doc", "key"])


class Places:
    """Reads sequences from the files of ``sequences``, some of which stay open."""

    def __init__(self, folder: str, most: int = 64):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.most, self.files = most, {}

    def read(self, file: str, at: int, n: int) -> np.ndarray:
        if file not in self.files:
            if len(self.files) == self.most:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.store.open_input_file(f"{self.path}/{file}")
        return np.frombuffer(self.files[file].read_at(8 * n, 8 * at), np.int64)


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences with their values as small numbers, so that sets of them are arrays."""
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    return codes[: len(a)], codes[len(a) :]


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each coded value is one of the others."""
    marks = np.zeros(int(max(values.max(initial=0), others.max(initial=0))) + 1, bool)
    marks[others] = True
    return marks[values]


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs equal in both begin, and where they end, in ``a``."""
    order = np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    many = high - low
    i = np.repeat(np.arange(len(a)), many)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + low[i]]
    begins, ends = (i == 0) | (j == 0), (i == len(a) - 1) | (j == len(b) - 1)
    begins[~begins] = a[i[~begins] - 1] != b[j[~begins] - 1]
    ends[~ends] = a[i[~ends] + 1] != b[j[~ends] + 1]
    return np.unique(i[begins]), np.unique(i[ends]) + 1


def _before(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _widened(before: np.ndarray, start: int, stop: int, least: int) -> tuple[int, int]:
    """The run widened to ``least`` places, where that adds the fewest different values."""
    if stop - start >= least:
        return start, stop
    first, last = max(0, stop - least), min(start, len(before) - least)
    ways = np.lib.stride_tricks.sliding_window_view(before[first : last + least], least)
    first += int((ways < np.arange(first, last + 1)[:, None]).sum(axis=1).argmin())
    return first, first + least


def _weighed(values: np.ndarray, hits: np.ndarray, gain: float, loss: float) -> np.ndarray:
    """Sums of ``gain`` for each hit and ``loss`` for each other value that stands once. A hit
    counts each time and a repeated other value not at all, so the sum over a stretch is at
    least what its different values would give."""
    weights = np.where(hits, gain, -loss)
    if not hits.all():
        weights[~hits & (np.bincount(values)[values] > 1)] = 0.0
    return np.concatenate([[0.0], np.cumsum(weights)])


def _first_starts(sums: np.ndarray, stops: np.ndarray, floor: float) -> np.ndarray:
    """For each end the first start from which the sum is not below ``floor``, near enough for
    rounding; past the end where none is."""
    return np.searchsorted(-np.minimum.accumulate(sums), floor - sums[stops] - 1e-6, side="left")


def _highest(sums: np.ndarray, least: int) -> float:
    """The highest sum of any stretch of ``least`` places or more."""
    return float((sums[least:] - np.minimum.accumulate(sums[: len(sums) - least])).max())


def open_segments(
    a: np.ndarray, b: np.ndarray, least: int, threshold: float
) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Where in each of two sequences stretches of ``least`` places or more can lie that hold
    to the threshold t, and how many values they can share; nothing that can pass is left out.

    Of a stretch's different values at least t are in the other sequence. And of both together,
    (1 + t) / 2 for each of those less t for each value is not below 0, so what one lacks
    at its best is the most that the other may.
    """
    sides = []
    if min(len(a), len(b)) < least:
        return [], [], 0
    for values, others in ((a, b), (b, a)):
        hits = _among(values, others)
        own = _weighed(values, hits, 1 - threshold, threshold)
        if _highest(own, least) < -1e-6:
            return [], [], 0
        both = _weighed(values, hits, (1 - threshold) / 2, threshold)
        sides.append((own, both, _highest(both, least), hits))
    if sides[0][2] + sides[1][2] < -1e-6:
        return [], [], 0
    out, shared = [], []
    for (own, both, _, hits), (_, _, other, _) in zip(sides, sides[::-1]):
        stops = np.arange(least, len(own))
        starts = np.maximum(_first_starts(own, stops, 0.0), _first_starts(both, stops, -other))
        fits = starts <= stops - least
        starts, stops = starts[fits], stops[fits]
        cover = np.zeros(len(own) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, stops, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover)[: len(own)] > 0])))
        out.append(list(zip(edges[0::2].tolist(), edges[1::2].tolist())))
        before = np.concatenate([[0], np.cumsum(hits)])
        shared.append(int((before[stops] - before[starts]).max(initial=0)))
    return out[0], out[1], min(shared)


def _with_few_misses(values: np.ndarray, others: np.ndarray, least: int, threshold: float) -> list[tuple[int, int]]:
    """Where stretches can lie that have no more different values of their own than all shared
    ones together allow, from what each ``least`` places have: repeats count once here."""
    hits = _among(values, others)
    allowed = np.count_nonzero(np.bincount(values[hits])) * (1 - threshold) / threshold + 1e-6
    few = _different(np.where(hits, len(values), _before(values)), least) <= allowed
    cover = np.zeros(len(values) + 1, np.int64)
    cover[: len(few)] += few
    cover[least : least + len(few)] -= few
    edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover) > 0])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def chained_stretch(a: np.ndarray, b: np.ndarray, least: int, threshold: float) -> tuple[tuple | None, bool]:
    """A pair of stretches with the similarity along the longest run of values that both
    sequences have once and in one order, as a first answer: shared values, places of both and the
    similarity; None where that does not give one. And whether no pair can share more: where
    nothing repeats and the shared values are in one order, what two stretches share is such a run."""
    size = int(max(a.max(), b.max())) + 1
    single = (np.bincount(a, minlength=size) == 1) & (np.bincount(b, minlength=size) == 1)
    place = np.zeros(size, np.int64)
    place[b] = np.arange(len(b))
    i = np.flatnonzero(single[a])
    j = place[a[i]]
    if not len(i):
        return None, False
    plain = np.bincount(a).max() == 1 and np.bincount(b).max() == 1
    if (np.diff(j) < 0).any():
        plain = False
        kept = _longest_rising(j.tolist())
        i, j = i[kept], j[kept]
    # From match k to match m: (1 + t) * matches - t * places is not below 0.
    f = (1 + threshold) * np.arange(len(i)) - threshold * (i + j)
    first = np.searchsorted(-np.minimum.accumulate(f), -(f + (1 - threshold) + 1e-9), side="left")
    span = np.arange(len(i)) - first
    m = int(np.argmax(span))
    k = int(first[m])
    if plain and (1 + threshold) * (m - k + 1) < 2 * threshold * least - 1e-9:
        return None, True
    mine = _widened(_before(a), int(i[k]), int(i[m]) + 1, least)
    theirs = _widened(_before(b), int(j[k]), int(j[m]) + 1, least)
    shared, similar = _similarity(a[slice(*mine)], b[slice(*theirs)])
    return ((shared, (*mine, *theirs, similar)), plain) if similar >= threshold else (None, False)


def _longest_rising(values: list[int]) -> list[int]:
    """Where the values of a longest rising subsequence stand."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for k, value in enumerate(values):
        x = bisect_left(tails, value)
        before[k] = at[x - 1] if x else -1
        if x == len(tails):
            tails.append(value)
            at.append(k)
        else:
            tails[x], at[x] = value, k
    out, k = [], at[-1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Different values that two coded stretches share, and their Jaccard similarity."""
    size = int(max(a.max(), b.max())) + 1
    one, other = np.bincount(a, minlength=size) > 0, np.bincount(b, minlength=size) > 0
    both = int((one & other).sum())
    return both, both / int((one | other).sum())


def best_stretch(a: np.ndarray, b: np.ndarray, least: int, threshold: float) -> tuple[int, int, int, int, float] | None:
    """Of all pairs of stretches of ``least`` or more places, one in each sequence, whose sets
    have the similarity, one that shares the most values; None where there is no such pair.

    Places that no passing stretch can hold are cut away first, in turn in both, which settles
    most regions in a few passes. In what is left, values that both have once and in
    one order give a first answer, and only stretches that could share more are tried.
    """
    if min(len(a), len(b)) < least:
        return None
    return _best_stretch(*_coded(a, b), least, threshold)


def _best_stretch(a: np.ndarray, b: np.ndarray, least: int, threshold: float) -> tuple[int, int, int, int, float] | None:
    best: tuple | None = None
    hits, hits_b = _among(a, b), _among(b, a)
    if not hits.any():
        return None
    for values, met in ((a, hits), (b, hits_b)):
        if _highest(_weighed(values, met, 1 - threshold, threshold), least) < -1e-6:
            return None
    if np.bincount(a).max() == 1 and np.bincount(b).max() == 1:
        chain, most = chained_stretch(a, b, least, threshold)
        if most:
            return chain[1] if chain else None
    if whole := whole_stretch(a, b, hits, hits_b, least, threshold):
        return whole[1]
    todo = [(len(a), 0, len(a), 0, len(b))]
    while todo:
        bound, la, ra, lb, rb = todo.pop()
        if bound <= (best[0] if best else 0):
            continue
        one, other = a[la:ra], b[lb:rb]
        cuts, cuts_b, most = open_segments(one, other, least, threshold)
        if most <= (best[0] if best else 0):
            continue
        if cuts == [(0, ra - la)] and cuts_b == [(0, rb - lb)]:
            cuts, cuts_b = _with_few_misses(one, other, least, threshold), _with_few_misses(other, one, least, threshold)
        if cuts != [(0, ra - la)] or cuts_b != [(0, rb - lb)]:
            shared = np.minimum(_shared_by_cut(one, other, cuts, cuts_b), most)
            parts = [(int(shared[i, k]), la + x, la + y, lb + p, lb + q) for i, (x, y) in enumerate(cuts) for k, (p, q) in enumerate(cuts_b) if shared[i, k]]
            todo += sorted(parts)  # those that can share the most are tried first
            continue
        found = _best_within(one, other, least, threshold, best[0] if best else 0, most)
        if found:
            x, y, p, q, similar = found[1]
            best = (found[0], (la + x, la + y, lb + p, lb + q, similar))
    return best[1] if best else None


def _shared_by_cut(a: np.ndarray, b: np.ndarray, cuts: list[tuple[int, int]], cuts_b: list[tuple[int, int]]) -> np.ndarray:
    """How many different values each cut of ``a`` shares with each of ``b``, the second sequence."""
    both = np.flatnonzero(np.bincount(a[_among(a, b)]))
    out = np.zeros((len(cuts), len(cuts_b)), np.int64)
    step = max(1, CELLS // max(1, len(cuts) + len(cuts_b)))
    for first in range(0, len(both), step):
        some = both[first : first + step]
        place = np.full(int(max(a.max(), b.max())) + 1, len(some))
        place[some] = np.arange(len(some))
        sides = []
        for values, parts in ((a, cuts), (b, cuts_b)):
            held = np.zeros((len(parts), len(some) + 1), np.float32)
            for k, (x, y) in enumerate(parts):
                held[k, place[values[x:y]]] = 1
            sides.append(held[:, :-1])
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def whole_stretch(a: np.ndarray, b: np.ndarray, hits: np.ndarray, hits_b: np.ndarray, least: int, threshold: float) -> tuple | None:
    """Stretches that hold all values that both sequences have: nothing shares more, so where
    they hold to the threshold there is nothing to search."""
    sides = []
    for values, met in ((a, hits), (b, hits_b)):
        at = np.flatnonzero(met)
        _, back = np.unique(values[at][::-1], return_index=True)
        start = int(at[::-1][back].min())  # from here on each value stands once more
        _, ahead = np.unique(values[start:][met[start:]], return_index=True)
        stop = int(at[at >= start][ahead].max()) + 1
        sides.append(_grown(values, *_widened(_before(values), start, stop, least)))
    mine, theirs = sides
    shared, similar = _similarity(a[slice(*mine)], b[slice(*theirs)])
    return (shared, (*mine, *theirs, similar)) if similar >= threshold else None


CELLS = 1 << 18
HELD_CELLS = 1 << 20


@dataclass(frozen=True)
class Cells:
    """Stretches of a sequence: first and past-last place, different values that the other
    sequence has too, and all different values (of the fewest when widened)."""

    start: np.ndarray
    stop: np.ndarray
    most: np.ndarray
    size: np.ndarray

    def of(self, chosen: np.ndarray) -> Cells:
        return Cells(self.start[chosen], self.stop[chosen], self.most[chosen], self.size[chosen])


def cells(
    values: np.ndarray, hits: np.ndarray, edges: tuple[np.ndarray, np.ndarray], least: int, threshold: float, floor: int
) -> Iterator[Cells]:
    """The stretches between edges that can share more than ``floor``, some at a time.

    A stretch that has all its shared values without its first or last run is left out for the
    shorter one, and of those with the same shared values one with the fewest others stays,
    so a text of repeats has few. Memory is that of ``CELLS`` and ``HELD_CELLS``, not of all stretches.
    """
    starts, stops = edges
    before, ways = _before(values), None
    code = textbytes.mix(values.astype(np.uint64) + np.uint64(1))
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    step = max(1, CELLS // max(1, len(stops)))
    for first in range(0, len(starts), step):
        # The row after a block's last says what that one adds.
        rows = starts[first : first + step + 1]
        most = np.zeros((min(step, len(starts) - first) + 1, len(stops) + 1), np.int32)
        size, mark = np.zeros_like(most), np.zeros(most.shape, np.uint64)
        for k, start in enumerate(rows.tolist()):
            low = int(np.searchsorted(stops, start, side="right"))
            new = before[start:] < start
            shared = new & hits[start:]
            at = stops[low:] - start - 1
            most[k, low + 1 :] = np.cumsum(shared)[at]
            size[k, low + 1 :] = np.cumsum(new)[at]
            mark[k, low + 1 :] = np.cumsum(np.where(shared, code[start:], np.uint64(0)))[at]
        own = most[:-1, 1:]
        fits = (own > floor) & (own > most[1:, 1:]) & (own > most[:-1, :-1])
        fits &= own >= threshold * np.where(stops - starts[first : first + len(own), None] < least, 0, size[:-1, 1:]) - 1e-9
        x, y = np.nonzero(fits)
        found = [starts[first + x], stops[y], own[x, y], size[:-1, 1:][x, y], mark[:-1, 1:][x, y]]
        short = np.flatnonzero(found[1] - found[0] < least)
        if len(short):  # counts as widened
            ways = ways or _levels(before, least)
            found[3][short] = _fewest(ways, least, found[0][short], found[1][short])
        held.append(_told_apart([f[found[2] >= threshold * found[3] - 1e-9] for f in found]))
        count += len(held[-1][0])
        if count > HELD_CELLS:
            held = [_told_apart([np.concatenate(c) for c in zip(*held)])]
            count = len(held[0][0])
            if count > HELD_CELLS // 2:
                yield Cells(*held[0][:4])
                held, count = [], 0
    if count:
        yield Cells(*_told_apart([np.concatenate(c) for c in zip(*held)])[:4])


def _told_apart(found: list[np.ndarray]) -> list[np.ndarray]:
    """One of those with the same mark: the smallest, and of these the longest."""
    start, stop, _, size, mark = found
    order = np.lexsort((start - stop, size, mark))
    ordered = mark[order]
    kept = order[np.append(True, ordered[1:] != ordered[:-1])] if len(order) else order
    return [f[kept] for f in found]


def _grown(values: np.ndarray, start: int, stop: int) -> tuple[int, int]:
    """The run with what lies around it and is in it already: repeats stay together."""
    outside = np.flatnonzero(~_among(values, values[start:stop]))
    k = int(np.searchsorted(outside, start))
    return int(outside[k - 1]) + 1 if k else 0, int(outside[k]) if k < len(outside) else len(values)


def _best_within(a: np.ndarray, b: np.ndarray, least: int, threshold: float, floor: int, limit: int) -> tuple | None:
    """Shared values and places of a pair of stretches that shares more than ``floor``, the most
    of all such pairs, which is ``limit`` at most.

    A stretch pair that cuts a run equal in both grows no less similar with the rest of the
    run, and one that begins or ends outside such runs grows no less similar without
    that edge while it is longer than ``least``. So only beginnings and ends of runs are
    tried, and shorter stretches of that kind with what they lack. Stretches
    that their own values rule out are passed over, the others taken by how much they can share.
    """
    hits, hits_b = _among(a, b), _among(b, a)
    every = np.count_nonzero(np.bincount(a[hits]))
    if every <= floor:
        return None
    if whole := whole_stretch(a, b, hits, hits_b, least, threshold):
        return whole
    best, most = chained_stretch(a, b, least, threshold)
    if best and best[0] <= floor:
        best = None
    if most:
        return best
    if best and best[0] >= min(limit, every):
        return best
    floor = best[0] if best else floor
    edges, edges_b = _runs(a, b), _runs(b, a)
    for mine in cells(a, hits, edges, least, threshold, floor):
        for theirs in cells(b, hits_b, edges_b, least, threshold, floor):
            found = _search(a, b, mine, theirs, least, threshold, best[0] if best else floor)
            best = found or best
    return best


def _search(a: np.ndarray, b: np.ndarray, mine: Cells, theirs: Cells, least: int, threshold: float, floor: int) -> tuple | None:
    """The best pair of one of ``mine`` in ``a`` and one of ``theirs`` in ``b``."""
    best = None
    before, before_b = _before(a), _before(b)
    # Similar sets share (1 + t) / t of half their sizes together: one side's lack is the other's to make up.
    weigh = lambda c: (1 + threshold) / 2 * c.most - threshold * c.size
    mine = mine.of(np.flatnonzero(weigh(mine) + weigh(theirs).max() >= -1e-9))
    mine = mine.of(np.lexsort((mine.start - mine.stop, mine.size, -mine.most)))
    theirs = theirs.of(np.argsort(theirs.start, kind="stable"))
    lack, lack_b = weigh(mine), weigh(theirs)
    # By places: what a stretch of b can gain at most, no value that repeats counting as lacking.
    lacking = np.where(np.bincount(b)[b] == 1, -threshold, 0.0)
    marks = np.zeros(int(max(a.max(), b.max())) + 1, bool)
    for x in range(len(lack)):
        if mine.most[x] <= floor:
            break
        # A stretch with more than it lacks can only gain by the whole of the other side's runs.
        tried = np.flatnonzero((theirs.most > floor) & (lack_b + lack[x] >= -1e-9))
        if not len(tried):
            continue
        start, stop, size = int(mine.start[x]), int(mine.stop[x]), int(mine.size[x])
        marks[a[start:stop]] = True
        met = marks[b]
        marks[a[start:stop]] = False
        sums = np.concatenate([[0.0], np.cumsum(np.where(met, 1.0, lacking))])
        if (sums - np.minimum.accumulate(sums)).max() < threshold * size - 1e-6:
            continue
        others = theirs.of(tried)
        shared = np.empty(len(tried), np.int64)
        heads = np.flatnonzero(np.append(True, others.start[1:] != others.start[:-1]))
        for p, q in zip(heads.tolist(), [*heads[1:].tolist(), len(tried)]):
            first, last = int(others.start[p]), int(others.stop[p:q].max())
            sums = np.cumsum(met[first:last] & (before_b[first:last] < first))
            shared[p:q] = sums[others.stop[p:q] - first - 1]
        near = np.flatnonzero((shared > floor) & (shared >= threshold * (size + others.size - shared) - 1e-9))
        for k in near[np.lexsort((others.start[near] - others.stop[near], others.size[near], -shared[near]))].tolist():
            one = _grown(a, *_widened(before, start, stop, least))
            other = _grown(b, *_widened(before_b, int(others.start[k]), int(others.stop[k]), least))
            _, similar = _similarity(a[slice(*one)], b[slice(*other)])
            if similar >= threshold:
                floor = int(shared[k])
                best = (floor, (*one, *other, similar))
                break
    return best


def _levels(before: np.ndarray, least: int) -> list[np.ndarray]:
    """How many different values each ``least`` neighbouring places hold, and the fewest of
    2, 4, 8 and more such neighbours."""
    n = len(before) - least + 1
    levels = [_different(before, least)]
    while 2 ** len(levels) <= min(n, least):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def _different(before: np.ndarray, least: int) -> np.ndarray:
    """How many different values each ``least`` neighbouring places hold, from where each
    stood before; past the end for what does not count."""
    n = len(before) - least + 1
    # A value is new to the stretches that begin after its last place before.
    added = np.zeros(n + 1, np.int64)
    places = np.arange(len(before))
    low, high = np.maximum(before + 1, places - least + 1), np.minimum(places, n - 1)
    fits = low <= high
    np.add.at(added, low[fits], 1)
    np.add.at(added, high[fits] + 1, -1)
    return np.cumsum(added)[:n]


def _fewest(levels: list[np.ndarray], least: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The fewest different values in any ``least`` neighbouring places that hold the run from a
    start to before a stop, which is no longer than that."""
    first, last = np.maximum(stops - least, 0), np.minimum(starts, len(levels[0]) - 1)
    width = last - first + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.zeros(len(starts), np.int64)
    # The least of any neighbours from that of two overlapping powers of two of them.
    for k, table in enumerate(levels):
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[first[here]], table[last[here] - 2**k + 1])
    return out


def agreeing_regions(m: dict[str, np.ndarray], enough: int) -> list[tuple[int, int, int, int]]:
    """Regions of both documents in which windows of ``enough`` functions agree: a run that
    holds one window's smallest place lies within windows of the others, in both."""
    regions: list[list[int]] = []
    order = np.argsort(m["c"], kind="stable")
    m = {k: v[order] for k, v in m.items()}
    for at in range(len(order)):
        last = regions[-1] if regions else None
        if last and last[0] <= m["l"][at] and m["r"][at] <= last[1] and last[2] <= m["l2"][at] and m["r2"][at] <= last[3]:
            continue  # it could add nothing
        near = (m["l"] <= m["c"][at]) & (m["c"][at] <= m["r"]) & (m["l2"] <= m["c2"][at]) & (m["c2"][at] <= m["r2"])
        if len(np.unique(m["f"][near])) < enough:
            continue
        box = [int(m["l"][near].min()), int(m["r"][near].max()), int(m["l2"][near].min()), int(m["r2"][near].max())]
        if last and box[0] <= last[1] and box[2] <= last[3] and last[2] <= box[3]:
            regions[-1] = [min(last[0], box[0]), max(last[1], box[1]), min(last[2], box[2]), max(last[3], box[3])]
        else:
            regions.append(box)
    return [tuple(r) for r in regions]


def near_passages(
    a: np.ndarray, b: np.ndarray, matches: dict | None = None, *, least: int, enough: int, threshold: float, still: np.ndarray | None = None
) -> list[tuple]:
    """Verified passages: first and past-last shingle in ``a`` and in ``b``, and their
    similarity. The stretches that share the most come first, then what lies beside them in
    either document: of the regions where windows agree, or of the whole documents
    without ``matches``. With ``still``, only where ``a`` has places of that kind that no passage
    found before holds."""
    found: dict[tuple, float] = {}
    todo = [(0, len(a), 0, len(b))] if matches is None else [(la, ra + 1, lb, rb + 1) for la, ra, lb, rb in agreeing_regions(matches, enough)]
    a, b = _coded(a, b)
    if still is not None:
        still = still.copy()
        todo = [(la + x, la + y, lb, rb) for la, ra, lb, rb in todo for x, y in open_segments(a[la:ra], b[lb:rb], least, threshold)[0]]
    while todo:
        la, ra, lb, rb = todo.pop()
        if min(ra - la, rb - lb) < least or still is not None and not still[la:ra].any():
            continue
        best = _best_stretch(a[la:ra], b[lb:rb], least, threshold)
        if best is None:
            continue
        x, y, p, q = best[0] + la, best[1] + la, best[2] + lb, best[3] + lb
        found[(x, y, p, q)] = best[4]
        if still is not None:
            still[x:y] = False
        todo += [(la, x, lb, rb), (y, ra, lb, rb), (x, y, lb, p), (x, y, q, rb)]
    return [(*k, s) for k, s in sorted(found.items())]


def _loss(known: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """What each place takes from a sum if it does not count, from ``np.unique``: nothing where
    its value stands again."""
    _, code, count = known
    return np.where(count[code] > 1, 0.0, -threshold)


def _sums(met: np.ndarray, loss: np.ndarray, gain: float) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.where(met, gain, loss))])


class Against:
    """A document that others are held against: its different values in order."""

    def __init__(self, values: np.ndarray, threshold: float):
        self.values, self.threshold = values, threshold
        self.known, self.code, _ = known = np.unique(values, return_inverse=True, return_counts=True)
        self.loss = _loss(known, threshold)
        self.before: np.ndarray | None = None
        self.leads: np.ndarray | None = None

    def met(self, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which places hold a value that the other has too; for each place of the other where
        its value is among the different ones, and whether it is."""
        at = np.searchsorted(self.known, other)
        at[at == len(self.known)] = 0
        there = self.known[at] == other
        marks = np.zeros(len(self.known), bool)
        marks[at[there]] = True
        return marks[self.code], at, there

    def can_hold(self, met: np.ndarray, least: int) -> bool:
        """Whether any stretch has enough of its different values in the other document."""
        return _highest(_sums(met, self.loss, 1 - self.threshold), least) >= -1e-6

    def can_share(self, met: tuple, loss: np.ndarray, least: int, x: int, y: int) -> bool:
        """Whether a stretch between ``x`` and ``y`` and one of the other document, of whose places
        ``loss`` tells the weights, can hold to the threshold: each by itself and both together."""
        mine, at, there = met
        marks = np.zeros(len(self.known), bool)
        marks[self.code[x:y]] = True
        sides = ((mine[x:y], self.loss[x:y]), (there & marks[at], loss))
        if len(loss) < least or any(_highest(_sums(*side, 1 - self.threshold), least) < -1e-6 for side in sides):
            return False
        return sum(_highest(_sums(*side, (1 - self.threshold) / 2), least) for side in sides) >= -1e-6

    def in_both(self, met: tuple, before: np.ndarray, least: int, x: int, y: int) -> bool:
        """Whether ``in_reach`` leaves anything of the places between ``x`` and ``y``, and of the other
        document, whose values stood ``before`` at these places."""
        mine, at, there = met
        if self.before is None:
            self.before = _before(self.values)
        marks = np.zeros(len(self.known), bool)
        marks[self.code[x:y]] = True
        sides = ((mine[x:y], np.maximum(self.before[x:y] - x, -1)), (there & marks[at], before))
        return all(
            in_reach(hits, b, np.zeros(len(hits), np.int64), np.array([0, len(hits)]), least, self.threshold).any() for hits, b in sides
        )

    def leading(self, functions: int, least: int) -> np.ndarray:
        """For each function and place, whether a window has its smallest hash there."""
        if self.leads is None:
            self.leads = np.zeros((functions, len(self.values)), bool)
            for f in range(functions):
                hashes = textbytes.mix(self.values.view(np.uint64) ^ _SEEDS[f])
                self.leads[f, compact_windows(hashes, np.array([0, len(hashes)]), least)[1]] = True
        return self.leads


PAIRS = "doc long, leader long, a0 int, a1 int, b0 int, b1 int, similarity double"
_PAIRS = pa.schema([("doc", pa.int64()), ("leader", pa.int64()), *((n, pa.int32()) for n in ("a0", "a1", "b0", "b1")), ("similarity", pa.float64())])
_MATCH = ("f", "l", "c", "r", "l2", "c2", "r2")
LANES = 8
TASKS = 4
HELD = 256  # leaders that a task keeps


def _verify(pairs: DataFrame, texts: DataFrame, folder: str, settled: DataFrame | None, functions: int, least: int, enough: int, threshold: float) -> DataFrame:
    """The passages of ``pairs`` (``doc, leader, functions, component, other``: the components of
    both). ``settled`` has passages found before.

    A document meets those that agree most first. Once it is in one component with a
    leader, only stretches of ``least`` places or more that no passage holds are still looked for there.
    """
    places = ("key", "file", "at", "n")
    for side in ("doc", "leader"):
        named = {"doc": side} | {n: f"{side}_{n}" for n in places}
        pairs = pairs.join(texts.withColumnsRenamed(named), side)
    if settled is None:
        pairs = pairs.withColumn("boxes", F.array().cast("array<struct<a0:int,a1:int>>"))
    else:
        pairs = pairs.join(_boxes(settled), "doc", "left")
    # Documents of one component meet in one lane, so that one link spares the others.
    lane = F.pmod(F.xxhash64("other"), F.lit(LANES))
    group = ["doc", "doc_key", "lane"]
    # Most pairs of the first round have passages: tests for those that have none would only add to it.
    sifted = settled is not None
    # Rows are few and their work is not: left alone, Spark would put all into a task or two.
    tasks = TASKS * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("lane", lane).repartition(tasks, *group).sortWithinPartitions(*group, F.desc("functions"), "leader", "leader_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, places = None, Places(folder)

        @lru_cache(HELD)
        def others(*place) -> tuple[np.ndarray, ...]:
            values = places.read(*place)
            if not sifted:
                return values, None, None
            return values, _loss(np.unique(values, return_inverse=True, return_counts=True), threshold), _before(values)

        for batch in batches:
            rows = []
            boxes = batch.column("boxes")
            columns = [batch.column(n).to_pylist() for n in (*group, "component", "leader", "other", "doc_file", "doc_at", "doc_n", "leader_file", "leader_at", "leader_n")]
            for k, (doc, key, lane, component, leader, other, *place) in enumerate(zip(*columns)):
                if current != (doc, key, lane):
                    current = (doc, key, lane)
                    a = Against(places.read(*place[:3]), threshold)
                    joined = {component}
                    still = np.ones(len(a.values), bool)
                    for box in boxes[k].as_py() or ():
                        still[box["a0"] : box["a1"]] = False
                stretches = _stretches(still, least) if other in joined else [(0, len(still))]
                if not stretches:
                    continue
                b, loss, before = others(*place[3:])
                met, found = a.met(b), []
                if not a.can_hold(met[0], least):
                    continue
                for x, y in stretches:
                    sought = None
                    if other in joined:
                        leads = a.leading(functions, least)[:, x:y] & met[0][x:y]
                        if np.count_nonzero(leads.any(axis=1)) < enough:
                            continue
                        sought = leads.any(axis=0)
                    if sifted and not (a.can_share(met, loss, least, x, y) and a.in_both(met, before, least, x, y)):
                        continue
                    near = near_passages(a.values[x:y], b, least=least, enough=enough, threshold=threshold, still=sought)
                    found += [(x + a0, x + a1, *rest) for a0, a1, *rest in near]
                rows += [(doc, leader, *f) for f in found]
                for a0, a1, *_ in found:
                    still[a0:a1] = False
                if found:
                    joined.add(other)
            columns = zip(*rows) if rows else [[] for _ in _PAIRS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PAIRS)], schema=_PAIRS)

    return dealt.mapInArrow(run, PAIRS)


def _meeting(windows: DataFrame, other: Column, enough: int) -> DataFrame:
    """The pairs of documents whose windows and ``other`` agree under ``enough`` functions, the
    larger id as ``doc``."""
    sides = windows.select("f", F.greatest("doc", other["doc"]).alias("doc"), F.least("doc", other["doc"]).alias("leader"))
    met = sides.groupBy("doc", "leader").agg(F.expr("bit_count(bit_or(shiftleft(1L, f)))").alias("functions"))
    return met.where(F.col("functions") >= enough).withColumns({"component": F.col("doc"), "other": F.col("leader")})


def _boxes(passages: DataFrame) -> DataFrame:
    return passages.groupBy("doc").agg(F.collect_set(F.struct("a0", "a1")).alias("boxes"))


def _settled(windows: DataFrame, passages: DataFrame) -> DataFrame:
    """Adds ``settled``: whether a window's smallest place lies in a passage that is matched
    with one of a smaller document. The places of that other one stay open."""
    boxes = _boxes(passages)
    here = F.exists("boxes", lambda b: (b["a0"] <= F.col("c")) & (F.col("c") < b["a1"]))
    return windows.join(boxes, "doc", "left").withColumn("settled", F.coalesce(here, F.lit(False))).drop("boxes")


def _working(windows: DataFrame, passages: DataFrame, labels: DataFrame) -> DataFrame:
    """The windows with ``settled`` and ``component``, of hashes under which documents may still
    have to meet: the larger one's window is open, or they are in different components."""
    line = Window.partitionBy("v", "f")
    marked = _settled(windows, passages).join(labels.withColumnRenamed("id", "doc"), "doc", "left")
    marked = marked.withColumn("component", F.coalesce("component", "doc"))
    work = (F.min("component").over(line) < F.max("component").over(line)) | (
        F.max(F.when(~F.col("settled"), F.col("doc"))).over(line) > F.min("doc").over(line)
    )
    return marked.withColumn("work", work).where("work").drop("work")


def _agreeing(lines: DataFrame, enough: int) -> DataFrame:
    """Pairs of documents (``doc, leader, functions, component, other``) with ``enough`` functions under
    which they have windows of one hash that no passage settles: the larger document's is
    ``open``, or they are in different components."""
    others = lines.select("v", "f", F.col("doc").alias("leader"), F.col("component").alias("other"))
    met = lines.join(others, ["v", "f"]).where("doc > leader AND (open OR component <> other)")
    met = met.groupBy("doc", "leader").agg(
        F.expr("bit_count(bit_or(shiftleft(1L, f)))").alias("functions"), F.first("component").alias("component"), F.first("other").alias("other")
    )
    return met.where(F.col("functions") >= enough)


READ = 100_000
MEETING = 50_000_000
LEFT = "v long, f int, doc long, component long, run int, across boolean"
_LEFT = pa.schema([("v", pa.int64()), ("f", pa.int32()), ("doc", pa.int64()), ("component", pa.int64()), ("run", pa.int32()), ("across", pa.bool_())])


def _together(batches: Iterator[pa.RecordBatch], folder: str, *columns: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[list]]]:
    """The sequences of some rows at a time: values, where each row's begin and at last the end,
    and the rows' ``columns``."""
    places = Places(folder)
    for batch in batches:
        sizes = batch.column("n").to_numpy()
        at, files, offsets = 0, batch.column("file").to_pylist(), batch.column("at").to_pylist()
        while at < len(sizes):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), READ)))
            values = np.concatenate([places.read(files[k], offsets[k], int(sizes[k])) for k in range(at, min(to, len(sizes)))])
            bounds = np.append(0, np.cumsum(sizes[at:to]))
            yield values.view(np.uint64), bounds, [batch.column(c).slice(at, to - at).to_pylist() for c in columns]
            at = to


def _pairs_left(texts: DataFrame, folder: str, repeated: Sieve, windows: DataFrame, passages: DataFrame, labels: DataFrame, functions: int, least: int, enough: int, threshold: float) -> Iterator[DataFrame]:
    """Pairs of documents (``doc, leader, functions, component, other``) that may still have to meet, as
    windows of ``enough`` functions agree: in different components where both have room for a passage
    of what other components have, in one component where the larger one has a stretch that is open.
    They come in parts by the larger document, of some ``MEETING`` meetings of components each, so
    what a part's shuffles take for these does not grow with their number. Of open stretches only the windows count.
    """
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda docs: docs.repartition(tasks, "doc", "key").sortWithinPartitions("file", "at")
    docs = texts.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    size = texts.agg(F.sum("n")).first()[0] or 0

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for values, bounds, (component,) in _together(batches, folder, "component"):
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = np.argsort(values)
            met = order[repeated.known(values[order])]
            ids, of = np.unique(np.array(component, np.int64), return_inverse=True)
            yield values[met], of[owner[met]], ids

    shared = sieve_of(dealt(docs), hashes, size, "shared", spread=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, bounds, (ids, component, boxes) in _together(batches, folder, "doc", "component", "boxes"):
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            order = np.argsort(values, kind="stable")
            before = _before_in(values, owner, order)
            hits, across, still = np.zeros(len(values), bool), np.zeros(len(values), bool), np.ones(len(values), bool)
            hits[order], across[order] = repeated.known(values[order]), shared.known(values[order])
            for first, found in zip(bounds.tolist(), boxes):
                for box in found or ():
                    still[first + box["a0"] : first + box["a1"]] = False
            ids, component = np.array(ids, np.int64), np.array(component, np.int64)
            for kind, known, marks in (
                (True, across, in_reach(across, before, owner, bounds, least, threshold)),
                (False, hits, _open_reach(hits, still, before, owner, least, threshold)),
            ):
                places, part, edges = _runs_of(marks, owner)
                for f in range(functions):
                    smallest = textbytes.mix(values[places] ^ _SEEDS[f])
                    _, c, _ = compact_windows(smallest, edges, least, part)
                    c = c[known[places[c]]]
                    c = c[np.lexsort((smallest[c], part[c]))]
                    # A run once a hash, however many windows of it there are.
                    c = c[np.append(True, (smallest[c[1:]] != smallest[c[:-1]]) | (part[c[1:]] != part[c[:-1]]))[: len(c)]]
                    doc = owner[places[c]]
                    columns = [smallest[c].view(np.int64), np.full(len(c), f), ids[doc], component[doc], places[edges[part[c]]] - bounds[doc], np.full(len(c), kind)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, _LEFT)], schema=_LEFT)

    lines = written(dealt(docs.join(_boxes(passages), "doc", "left")).mapInArrow(run, LEFT), "lines")
    met = lines.where("across").groupBy("v", "f").agg(F.count("*").alias("n"))
    many = (met.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0) + (lines.where("NOT across").count())
    parts = max(1, math.ceil(many / MEETING))
    for part in range(parts):
        mine = lines.where(F.pmod(F.xxhash64("doc"), F.lit(parts)) == part)
        yield _met(mine, lines, windows, labels, enough)


def _met(mine: DataFrame, lines: DataFrame, windows: DataFrame, labels: DataFrame, enough: int) -> DataFrame:
    """The pairs of ``_pairs_left`` with the windows ``mine`` of the larger document."""
    agreed = F.expr("bit_count(bit_or(shiftleft(1L, f)))").cast("int").alias("functions")
    theirs = lines.where("across").drop("across").withColumnsRenamed({"doc": "leader", "component": "other", "run": "there"})
    met = mine.where("across").join(theirs, ["v", "f"]).where("doc > leader AND component <> other")
    far = met.groupBy("doc", "run", "leader", "there").agg(agreed, F.first("component").alias("component"), F.first("other").alias("other"))
    theirs = windows.select("v", "f", F.col("doc").alias("leader"))
    near = mine.where("NOT across").join(theirs, ["v", "f"]).where("doc > leader").groupBy("doc", "run", "leader").agg(agreed, F.first("component").alias("component"))
    near = near.where(F.col("functions") >= enough).join(labels.select(F.col("id").alias("leader"), F.col("component").alias("other")), "leader").where("component = other")
    columns = ["doc", "leader", "functions", "component", "other"]
    pairs = far.where(F.col("functions") >= enough).select(columns).unionByName(near.select(columns))
    return pairs.groupBy("doc", "leader").agg(*(F.max(c).alias(c) for c in columns[2:]))


def _open_reach(hits: np.ndarray, still: np.ndarray, before: np.ndarray, owner: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """``in_reach`` within runs of ``least`` places or more that are all open."""
    places, run, edges = _runs_of(still, owner)
    long = np.diff(edges)[run] >= least
    places, run, edges = _runs_of(_marked(places[long], len(still)), owner)
    number = np.full(len(still) + 1, -1)
    number[places] = np.arange(len(places))
    out = np.zeros(len(still), bool)
    out[places] = in_reach(hits[places], number[before[places]], run, edges, least, threshold)
    return out


def _stretches(marks: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and past-last place of the runs of ``least`` marked places or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]])))
    return [(x, y) for x, y in zip(edges[0::2].tolist(), edges[1::2].tolist()) if y - x >= least]


def _marked(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def _left_over(windows: DataFrame, passages: DataFrame, labels: DataFrame, enough: int) -> DataFrame:
    """The pairs of ``_pairs_left`` with the windows of both by hash as ``met``: those of the
    larger document that are open, or all in different components."""
    box = F.struct("l", "c", "r")
    lines = written(
        _working(windows, passages, labels).groupBy("v", "f", "doc").agg(
            F.first("component").alias("component"), (~F.min("settled")).alias("open"), F.collect_list(box).alias("every"),
            F.collect_list(F.when(~F.col("settled"), box)).alias("free"),
        ),
        "lines",
    )
    others = lines.select("v", "f", F.col("doc").alias("leader"), F.col("every").alias("theirs"))
    both = _agreeing(lines, enough).drop("component").join(lines, "doc").join(others, ["v", "f", "leader"])
    mine = F.when(F.col("component") != F.col("other"), F.col("every")).otherwise(F.col("free")).alias("mine")
    both = both.where("open OR component <> other")
    return both.groupBy("doc", "leader").agg(F.collect_list(F.struct("f", mine, "theirs")).alias("met"))


def _crossed(met: pa.StructArray) -> dict[str, np.ndarray]:
    """All pairs of one window of ``mine`` and one of ``theirs`` of each hash."""
    mine, theirs = met.field("mine"), met.field("theirs")
    n, m = (x.value_lengths().to_numpy().astype(np.int64) for x in (mine, theirs))
    at = np.arange((n * m).sum()) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    i = np.repeat(np.cumsum(n) - n, n * m) + at // np.repeat(m, n * m)
    k = np.repeat(np.cumsum(m) - m, n * m) + at % np.repeat(m, n * m)
    out = {"f": np.repeat(met.field("f").to_numpy(), n * m)}
    for name in ("l", "c", "r"):
        out[name] = mine.flatten().field(name).to_numpy()[i]
        out[f"{name}2"] = theirs.flatten().field(name).to_numpy()[k]
    return out


def near_duplicate_passages(
    documents: DataFrame,
    *,
    least_words: int = 50,
    threshold: float = 0.75,
    functions: int = FUNCTIONS,
    enough: int = ENOUGH,
) -> DataFrame:
    """A row a passage of ``least_words`` or more words that is near one of another
    document: ``doc_id, start, stop`` (words, the last past the end), ``match_id,
    match_start, match_stop, similarity`` (Jaccard, of distinct shingles) and
    ``class_id``, the smallest id of all documents that such passages link.

    Passages are matched with the one of the smallest id that shares their hash (then with
    another), so a passage of many documents gives a row for each, not for each pair.
    Stretches of ``least_words`` that stay unmatched, and documents in different classes, then
    meet pair by pair: no pair whose windows agree there under enough functions is left out for
    its leader's sake. In a class, a passage that a matched one overlaps can stay without a row
    where fewer words than that are left of it. Documents equal as a whole give one row to the smallest id.
    Recall is that of ``functions`` min-hashes of which ``enough`` must agree: an
    identical passage is always found, one of just ``threshold`` in 96 of 100.

    Null and short texts have no passages; rows without an id are left out; rows that
    repeat an id and text count once. Matches within one document are not reported.
    """
    least = least_words - SHINGLE + 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL")
    marked = rows.withColumns({"mark": F.md5(F.col("text").cast("binary")), "key": F.xxhash64("doc_id", "text")})
    groups = written(
        marked.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last"),
        "equal-texts",
    )
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    same = written(
        marked.select("doc_id", "mark", "key", n_words.alias("n"))
        .join(groups.drop("last"), "mark")
        .where("doc_id <> rep")
        .select("doc_id", "key", "rep", "n")
        .distinct(),
        "copies",
    )
    # A copy's windows are those of the first of its kind.
    copies = key_table(same, fresh_path(rows.sparkSession, "copies"), 4)
    line = Window.partitionBy("v", "f")

    def led_by(windows: DataFrame, order: Column) -> DataFrame:
        first = F.min(F.struct(order.alias("o"), F.col("doc"))).over(line)
        return windows.withColumns({"first": first, "high": F.max("doc").over(line)})

    repeated = repeated_shingles(marked, copies)
    opened = led_by(window_rows(marked, copies, repeated, functions, least, threshold), F.col("doc"))
    all_rows = written(opened.where("first.doc < high").drop("high"), "windows")
    folder = fresh_path(rows.sparkSession, "shingles")
    texts = written(sequences(marked, all_rows.select("doc").distinct(), folder, least), "sequences")
    open_rows, found, met = all_rows, None, None
    for k in range(ROUNDS):
        pairs = _meeting(open_rows.where("first.doc <> doc"), F.col("first"), enough)
        pairs = written(pairs if met is None else pairs.join(met, ["doc", "leader"], "left_anti"), "meeting")
        met = pairs.select("doc", "leader") if met is None else met.unionByName(pairs.select("doc", "leader"))
        passages = written(_verify(pairs, texts, folder, found, functions, least, enough, threshold), "passages")
        found = passages if found is None else found.unionByName(passages)
        if k < ROUNDS - 1:
            rest = _settled(all_rows, found).where("NOT settled").drop("settled", "first")
            open_rows = written(led_by(rest, F.xxhash64("doc", F.lit(k + 1))).where("first.doc <> doc").drop("high"), "windows")
    links = found.select(F.col("doc").alias("a"), F.col("leader").alias("b")).unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    before, labels = found, components(links)
    for left in _pairs_left(texts, folder, repeated, all_rows, before, labels, functions, least, enough, threshold):
        left = written(left.join(met, ["doc", "leader"], "left_anti"), "agreeing")
        passages = written(_verify(left, texts, folder, before, functions, least, enough, threshold), "passages")
        found = found.unionByName(passages)
    passages = found.select(
        F.col("doc").alias("doc_id"), F.col("a0").alias("start"), (F.col("a1") + SHINGLE - 1).alias("stop"),
        F.col("leader").alias("match_id"), F.col("b0").alias("match_start"), (F.col("b1") + SHINGLE - 1).alias("match_stop"),
        "similarity",
    )
    whole = same.where(F.col("n") >= least_words).select(
        "doc_id", F.lit(0).alias("start"), F.col("n").alias("stop"), F.col("rep").alias("match_id"),
        F.lit(0).alias("match_start"), F.col("n").alias("match_stop"), F.lit(1.0).alias("similarity"),
    )
    passages = written(passages.unionByName(whole).distinct(), "passages")
    labels = components(passages.select(F.col("doc_id").alias("a"), F.col("match_id").alias("b")))
    return passages.join(labels.select(F.col("id").alias("doc_id"), F.col("component").alias("class_id")), "doc_id")


@query()
def op3_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate passages of 50 words or more of all documents."""
    return near_duplicate_passages(table(spark, folder, "documents"))
