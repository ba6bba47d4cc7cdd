"""Best-fit packing of documents into bins of bounded length, under conflicts.

A bin never holds two documents of one source or of one duplicate cluster. Each
bin carries two bitmaps, its sources and its clusters; bins are ordered by what is
left in them, and the successor search walks up from the length wanted until it
meets the tightest bin that has room and no conflict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.registry import query
from weftline.scratch import written
from weftline.sources.tables import table


class Bins:
    """Open bins of one block, ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.by_residual: dict[int, list[int]] = {}
        self.occupied = 0  # bit r is set while a bin has residual r

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin taken and the offset in it. ``source`` and ``cluster`` are single
        bits, or 0 where nothing conflicts."""
        above = self.occupied >> length
        rest = length
        while above:
            step = (above & -above).bit_length() - 1
            rest += step
            for at, b in enumerate(self.by_residual[rest]):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._take(rest, at)
                    return b, self._fill(b, length, source, cluster)
            above >>= step + 1
            rest += 1
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        b = len(self.residual) - 1
        return b, self._fill(b, length, source, cluster)

    def _take(self, rest: int, at: int) -> None:
        bins = self.by_residual[rest]
        del bins[at]
        if not bins:
            del self.by_residual[rest]
            self.occupied ^= 1 << rest

    def _fill(self, b: int, length: int, source: int, cluster: int) -> int:
        offset = self.capacity - self.residual[b]
        self.residual[b] -= length
        self.sources[b] |= source
        self.clusters[b] |= cluster
        rest = self.residual[b]
        if rest:  # a full bin can take nothing more
            self.by_residual.setdefault(rest, []).append(b)
            self.occupied |= 1 << rest
        return offset


def pack_block(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece of one block, longest pieces first."""
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    # Only clusters that a block holds twice can conflict in it.
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1)}
    source_bit: dict = {}
    bins = Bins(capacity)
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        source = source_bit.setdefault(sources[i], 1 << len(source_bit))
        placed[i] = bins.place(lengths[i], source, cluster_bit.get(clusters[i], 0))
    return placed


PACKED = "block int, doc_id long, piece int, start long, length int, source string, cluster long, bin int, bin_offset int"


def best_fit_packing(
    documents: DataFrame,
    length: Column,
    *,
    source: Column,
    cluster: Column,
    capacity: int = 2048,
    block_rows: int = 8192,
) -> DataFrame:
    """Every document as one or more pieces, each in a bin of at most ``capacity``.

    Returns ``bin_id`` (string, unique), ``doc_id``, ``piece`` and ``start`` (a document
    longer than a bin is cut into pieces of whole bins and a rest), ``length``,
    ``bin_offset``, ``source`` and ``cluster``. Documents of length 0 or less, or null,
    become one piece of length 1. Null sources are one source, null clusters conflict
    with nothing. Repeated rows are packed each. No rows in, no rows out.

    Pieces are dealt in blocks of about ``block_rows``, at random by hash of the
    document, so a source or cluster with a third of all rows is spread evenly; a
    block is one unit of sequential work and leaves few bins open. Best fit runs
    within each block, blocks run in parallel.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("n"),
        F.coalesce(source.cast("string"), F.lit("")).alias("source"),
        cluster.cast("long").alias("cluster"),
    )
    pieces = rows.select(
        "doc_id", "source", "cluster", "n",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity))).alias("piece"),
    ).select(
        "doc_id", "source", "cluster", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"),
    )
    # Written, so that the count and the blocks see the same rows and texts are read once.
    pieces = written(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))
    spread = pieces.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "piece", "length", "source"), F.lit(blocks)).cast("int")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            got = block.to_pydict()
            clusters = [(-1, i) if c is None else c for i, c in enumerate(got["cluster"])]
            placed = pack_block(got["length"], got["source"], clusters, capacity)
            columns = {name: block.column(name) for name in block.column_names}
            columns["bin"] = pa.array([b for b, _ in placed], pa.int32())
            columns["bin_offset"] = pa.array([o for _, o in placed], pa.int32())
            yield from pa.table(columns).to_batches()

    order = ["block", "length", "doc_id", "piece", "start", "source", "cluster"]
    packed = (
        spread.repartition("block")
        .sortWithinPartitions("block", F.desc("length"), *order[2:])
        .select("block", "doc_id", "piece", "start", "length", "source", "cluster")
        .mapInArrow(pack, PACKED)
    )
    return packed.select(
        F.concat_ws("-", "block", "bin").alias("bin_id"),
        "doc_id", "piece", "start", "length", "bin_offset", "source", "cluster",
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from batches sorted by block."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        ids = batch.column("block").to_numpy()
        start = 0
        while start < len(ids):
            end = start + int((ids[start:] == ids[start]).sum())
            if current is not None and ids[start] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = ids[start]
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield pa.Table.from_batches(held)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def pack_documents(documents: DataFrame, **settings) -> DataFrame:
    """``best_fit_packing`` of documents by words and an end mark, equal lower-cased
    texts being one duplicate cluster."""
    text = F.coalesce("text", F.lit(""))
    return best_fit_packing(
        documents,
        word_count(F.col("text")) + 1,
        source=F.col("source"),
        cluster=F.xxhash64(F.lower(text)),
        **settings,
    )


@query()
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into bins of 2,048 words."""
    return pack_documents(table(spark, folder, "documents"))
