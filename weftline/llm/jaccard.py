"""N-gram Jaccard join by vertical partitioning, as components of near-equal documents.

All shingles have one global order: by how often they occur (estimated by a table of
counters of fixed size), then by hash. The order is cut into fragments. Documents
meet through the rarest shingles of each, its prefix: sets similar enough share one.
For the pairs that meet, each fragment counts its own partial overlap, and the counts
are summed per pair against the exact bound.

Equal sets are one class from the start. Links are looked for between different
components only: each document first tries a common partner of its prefix, so a group
of near copies becomes one component by stars; what is left between components
is then taken pair by pair, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm import sketches, textbytes
from weftline.llm.graph import components
from weftline.llm.mapped import Table, key_table
from weftline.llm.registry import query
from weftline.scratch import fresh_path, written
from weftline.sources.tables import table

SHINGLE = 5
COUNTER_BITS = 21
FRAGMENTS = 8
STAR_ROUNDS = 2
COPY_BITS = 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct shingle hashes, in order, of each text that has a word. A text of
    fewer words than a shingle is one shingle."""
    start, end, text = textbytes.word_spans(data, offsets)
    words = textbytes.hash_spans(data, start, end)
    values, first = textbytes.windows(words, text, SHINGLE)
    owner = text[first]
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    word_bounds = np.searchsorted(text, np.arange(len(offsets)))
    for doc in range(len(offsets) - 1):
        if bounds[doc] < bounds[doc + 1]:
            yield doc, np.unique(values[bounds[doc] : bounds[doc + 1]])
        elif word_bounds[doc] < word_bounds[doc + 1]:
            few = words[word_bounds[doc] : word_bounds[doc + 1]]
            one, _ = textbytes.windows(few, np.zeros(len(few)), len(few))
            yield doc, textbytes.mix(one + np.uint64(len(few)))


def counters(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _records(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("slice", pa.int32()), ("packed", pa.binary())])


def _signature(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    spread = textbytes.mix(values + np.uint64(1))
    return int(spread.sum().view(np.int64)), int(np.bitwise_xor.reduce(textbytes.mix(spread ^ np.uint64(77))).view(np.int64))


def profiles(documents: DataFrame) -> DataFrame:
    """A row a row (``doc_id, mark, n, s1, s2``; the mark is of its text), and a task's
    shingle counters as slices."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in batches:
            for first, last, data, offsets in textbytes.pieces(batch.column("text")):
                n, s1, s2 = (np.zeros(last - first, np.int64) for _ in range(3))
                seen = []
                for doc, values in shingle_sets(data, offsets):
                    n[doc] = len(values)
                    s1[doc], s2[doc] = _signature(values)
                    seen.append(counters(values))
                if seen:
                    counts += np.bincount(np.concatenate(seen), minlength=len(counts)).astype(np.uint32)
                size = last - first
                yield _records(
                    {"doc_id": batch.column("doc_id").slice(first, size), "mark": batch.column("mark").slice(first, size), "n": n, "s1": s1, "s2": s2, "slice": pa.nulls(size, pa.int32()), "packed": pa.nulls(size, pa.binary())},
                    _PROFILE,
                )
        packed = sketches.slices(counts)
        none = [None] * len(packed)
        yield _records(
            {"doc_id": none, "mark": none, "n": none, "s1": none, "s2": none, "slice": [k for k, _ in packed], "packed": [p for _, p in packed]},
            _PROFILE,
        )

    schema = "doc_id long, mark long, n long, s1 long, s2 long, slice int, packed binary"
    rows = documents.select(F.col("doc_id").cast("long"), text_mark(F.col("text")).alias("mark"), F.col("text").cast("string"))
    return rows.mapInArrow(profile, schema)


def text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def prefix_rows(documents: DataFrame, counts, several, threshold: tuple[int, int]) -> DataFrame:
    """``h, doc, t, place`` for the rarest shingles of each set: as many as leave the rest
    too few for the similarity. A shingle whose counter is 1 occurs nowhere else.
    ``place`` packs the set's size and the shingle's position in the order. ``t`` tells
    apart the sets of an id that the sieve ``several`` knows, and is 0 for others."""
    over, under = threshold
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("place", pa.int64())])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        met: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in textbytes.pieces(batch.column("text")):
                docs = ids.slice(first, last - first).to_numpy(zero_copy_only=False)
                apart = sketches.known(several.value, docs)
                hashes, owners, kinds, places = [], [], [], []
                for doc, values in shingle_sets(data, offsets):
                    key = _signature(values)
                    if key in met:
                        continue
                    met.add(key)
                    n = len(values)
                    seen = table[counters(values)]
                    rare = np.argsort(seen, kind="stable")[: n - -(-over * n // under) + 1]
                    at = np.flatnonzero(seen[rare] > 1)
                    hashes.append(values[rare[at]])
                    owners.append(np.full(len(at), docs[doc], np.int64))
                    kinds.append(np.full(len(at), key[0] if apart[doc] else 0, np.int64))
                    places.append((n << 31) + at)
                if hashes:
                    yield _records(
                        {"h": np.concatenate(hashes).view(np.int64), "doc": np.concatenate(owners), "t": np.concatenate(kinds), "place": np.concatenate(places)},
                        schema,
                    )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.where("doc_id IS NOT NULL").mapInArrow(prefixes, "h long, doc long, t long, place long")


def row_key(doc: Column, s1: Column) -> Column:
    """Id and signature in one number, for a sieve."""
    return s1.bitwiseXOR(F.shiftleft(doc, 20)).bitwiseXOR(F.shiftrightunsigned(doc, 44))


def _row_keys(docs: np.ndarray, s1: np.ndarray) -> np.ndarray:
    ids = docs.astype(np.int64).view(np.uint64)
    return (s1.view(np.uint64) ^ (ids << np.uint64(20)) ^ (ids >> np.uint64(44))).view(np.int64)


def segments(documents: DataFrame, counts, cuts: np.ndarray, wanted) -> DataFrame:
    """``doc, s1, parts`` (a list of shingle hashes for each fragment) of the sets that a
    sieve of row keys lets through; rows that repeat give one."""
    kind = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("doc", pa.int64()), ("s1", pa.int64()), ("parts", kind)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sieve = counts.value, wanted.value
        for batch in batches:
            # Set signatures are not known before the sets are; a first sieve takes the ids.
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(sketches.known(sieve[0], ids)))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, _, data, offsets in textbytes.pieces(batch.column("text")):
                docs, marks, parts, ends = [], [], [], []
                for doc, values in shingle_sets(data, offsets):
                    s1 = _signature(values)[0]
                    if not sketches.known(sieve[1], _row_keys(ids[first + doc : first + doc + 1], np.array([s1])))[0]:
                        continue
                    place = np.searchsorted(cuts, table[counters(values)])
                    docs.append(ids[first + doc])
                    marks.append(s1)
                    parts.append(values[np.argsort(place, kind="stable")])
                    ends.append(np.bincount(place, minlength=len(cuts) + 1))
                if docs:
                    inner = np.concatenate([[0], np.cumsum(np.concatenate(ends))])
                    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))
                    outer = pa.array(np.arange(len(docs) + 1) * (len(cuts) + 1), pa.int32())
                    yield _records({"doc": docs, "s1": marks, "parts": pa.ListArray.from_arrays(outer, lists)}, schema)

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.where("doc_id IS NOT NULL").mapInArrow(cut, "doc long, s1 long, parts array<array<long>>")
    return found.dropDuplicates(["doc", "s1"])


def _enough(overlap: Column, a: Column, b: Column, threshold: tuple[int, int]) -> Column:
    over, under = threshold
    return under * overlap >= over * (a + b - overlap)


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, counts, cuts, threshold) -> DataFrame:
    """The pairs (``a, b, na, nb``) whose overlaps, counted fragment by fragment and summed,
    are enough. ``nodes`` names a row that has the set of each node."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("rep").alias(f"doc_{k}"), F.col("s1").alias(f"s1_{k}"))
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b"), "pairs")
    rows = pairs.select(F.explode(F.array(*[F.struct(F.col(f"doc_{k}").alias("doc"), F.col(f"s1_{k}").alias("s1")) for k in "ab"])).alias("r")).select("r.*")
    sieves = (sketches.id_filter(rows.select("doc")), sketches.id_filter(rows.select(row_key(F.col("doc"), F.col("s1")).alias("key"))))
    sieve = pairs.sparkSession.sparkContext.broadcast(sieves)
    parts = segments(documents, counts, cuts, sieve)
    both = pairs
    for k in "ab":
        both = both.join(parts.withColumnsRenamed({"doc": f"doc_{k}", "s1": f"s1_{k}", "parts": f"of_{k}"}), [f"doc_{k}", f"s1_{k}"])
    partial = F.zip_with("of_a", "of_b", lambda x, y: F.size(F.array_intersect(x, y)))
    overlap = F.aggregate(partial, F.lit(0), lambda total, part: total + part)
    found = written(both.where(_enough(overlap, F.col("na"), F.col("nb"), threshold)).select("a", "b").distinct(), "found")
    sieve.destroy()
    return found


def link_sets(documents: DataFrame, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``jaccard_components`` and ``one_of_each`` stand on: rows (``doc_id, mark, n, node``,
    null where a row has no shingles or no id), nodes (``node, rep, n, s1, s2``: the different
    sets, each with the smallest id that has it) and links (``a, b``) that connect the
    nodes of each group of similar sets. All are written."""
    spark = documents.sparkSession
    profile = written(profiles(documents), "profiles")
    counts = sketches.merged(
        profile.where("slice IS NOT NULL").select("slice", "packed"), "uint32", np.add, 1 << COUNTER_BITS
    )
    # Fragments: cuts of the global order that leave about as many shingles in each.
    ordered = np.sort(counts)
    weight = np.cumsum(ordered, dtype=np.float64)
    cuts = np.unique(
        ordered[np.searchsorted(weight, weight[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS)]
    )
    shared_counts = spark.sparkContext.broadcast(counts)

    rows = profile.where("slice IS NULL").drop("slice", "packed")
    sets = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    # Numbers in the order of ids, so that a star's centre is the first of its kind; they stay
    # as they are, as the table is written.
    ordered = sets.repartitionByRange("rep", "s1").sortWithinPartitions("rep", "s1", "s2", "n")
    nodes = written(ordered.withColumn("node", F.monotonically_increasing_id()), "nodes")
    named = nodes.select("n", "s1", "s2", "node").withColumn("named", F.lit(True))
    placed = rows.join(named, ["n", "s1", "s2"], "left")
    placed = written(placed.withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node"))).drop("named", "s2"), "rows")
    of_ids = placed.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    several = spark.sparkContext.broadcast(sketches.id_filter(written(of_ids.where("low < high").select("doc_id"), "several")))

    by_shingle = Window.partitionBy("h")
    meeting = (
        prefix_rows(documents, shared_counts, several, threshold)
        .withColumns({f"{side}_{c}": least(c).over(by_shingle) for c in ("doc", "t") for side, least in (("low", F.min), ("high", F.max))})
        .where("low_doc < high_doc OR low_t < high_t")
        .select("h", "doc", "t", "place")
    )
    homes = placed.where("node IS NOT NULL").select(F.col("doc_id").alias("doc"), "s1", "node").distinct()
    postings = written(
        meeting.join(homes, "doc")
        .where("t = 0 OR t = s1")
        .select(
            "h",
            F.col("node").alias("doc"),
            F.shiftright("place", 31).alias("n"),
            F.col("place").bitwiseAND((1 << 31) - 1).alias("at"),
        )
        .dropDuplicates(["h", "doc"]),
        "postings",
    )
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "id long, component long")
    for k in range(STAR_ROUNDS + 1):
        apart = postings.join(labels.withColumnRenamed("id", "doc"), "doc", "left").withColumn(
            "component", F.coalesce("component", "doc")
        )
        if k:  # before the first round every set is apart
            low, high = F.min("component").over(by_shingle), F.max("component").over(by_shingle)
            apart = apart.withColumns({"low": low, "high": high}).where("low < high").drop("low", "high")
            apart = written(apart, "apart")
            if apart.isEmpty():
                break
        pairs = _star_pairs(apart, k, threshold) if k < STAR_ROUNDS else _all_pairs(apart, threshold)
        pairs = _meeting_often(pairs, apart, threshold)
        found = verified(pairs, nodes, documents, shared_counts, cuts, threshold)
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = written(components(links), "labels")
        postings = apart.select("h", "doc", "n", "at")
    for held in (shared_counts, several):
        held.destroy()
    return placed, nodes, links


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, first``: the smallest id that has a set of the node's component."""
    labels = components(links).withColumnsRenamed({"id": "node"})
    inside = nodes.select("node", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    inside = written(inside, "inside")
    firsts = inside.groupBy("component").agg(F.min("rep").alias("first"))
    return inside.join(firsts, "component").select("node", "first")


def jaccard_components(documents: DataFrame, *, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """One row a row of ``documents``: ``doc_id, n_shingles, component_id``.

    Two documents link when their sets' Jaccard similarity is at least ``threshold`` (a
    fraction). The component is named by its smallest id. Null and blank texts have
    no shingles and their own component; rows without an id are counted but link with
    nothing, and their component is null. Rows that repeat an id are a row each; an id with
    several texts links whatever is linked with any of them, and all its rows have one
    component. No rows in, no rows out; other columns of the input are not read. Sets are
    compared by 64-bit shingle hashes.
    """
    placed, nodes, links = link_sets(documents, threshold)
    ids = placed.where("doc_id IS NOT NULL").groupBy("doc_id")
    # The nodes of an id with several sets belong together, and its rows without a set too.
    apart = ids.agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("n").alias("least"))
    apart = written(apart.where("low < high OR (least = 0 AND low IS NOT NULL)").select(F.col("doc_id").alias("_doc"), "low"), "apart")
    bridges = placed.join(apart, F.col("doc_id") == F.col("_doc")).where("node <> low")
    links = links.unionByName(bridges.select(F.col("node").alias("a"), F.col("low").alias("b")))
    firsts = written(_grouped(nodes, links), "firsts")
    node = F.coalesce("node", "low")
    found = placed.join(apart, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "n", node.alias("node"))
    return found.join(firsts, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id")
    )


def _may_link(n: Column, at: Column, m: Column, other_at: Column, threshold: tuple[int, int]) -> Column:
    """Whether a shingle at these positions of two sets can be their first in common.

    Sets of sizes n and m that link share ``least`` shingles or more, so the first of
    them in the order leaves at least that many from there on in both.
    """
    over, under = threshold
    least = F.ceil(over * (n + m) / (over + under))
    fits = (under * F.least(n, m)) >= (over * F.greatest(n, m))
    return fits & (n - at >= least) & (m - other_at >= least)


def _star_pairs(apart: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """For each document the partner of another component that it meets most often, out of
    the first of every shingle's documents (in an order of round ``k``)."""
    order = F.col("doc") if k == 0 else F.xxhash64("doc", F.lit(k))
    line = Window.partitionBy("h")
    first = F.min(F.struct(order.alias("o"), F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at"), F.col("component").alias("cb"))).over(line)
    met = (
        apart.withColumn("first", first)
        .where(F.col("first.cb") != F.col("component"))
        .where(_may_link(F.col("n"), F.col("at"), F.col("first.nb"), F.col("first.at"), threshold))
        .groupBy(F.col("doc").alias("a"), F.col("n").alias("na"), "first.b", "first.nb")
        .agg(F.count("*").alias("times"))
    )
    best = F.max(F.struct("times", (-F.col("b")).alias("minus_b"), "nb"))
    return met.groupBy("a", "na").agg(best.alias("m")).select("a", "na", (-F.col("m.minus_b")).alias("b"), F.col("m.nb").alias("nb"))


def _all_pairs(apart: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """All pairs of different components that can have a first shingle in common."""
    left, right = (apart.select("h", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "n", "at", "component")]) for s in "ab")
    may = _may_link(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b"), threshold)
    return (
        left.join(right, "h")
        .where((F.col("doc_a") < F.col("doc_b")) & (F.col("component_a") != F.col("component_b")) & may)
        .select(F.col("doc_a").alias("a"), F.col("n_a").alias("na"), F.col("doc_b").alias("b"), F.col("n_b").alias("nb"))
        .distinct()
    )


def _meeting_often(pairs: DataFrame, postings: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose prefixes, the first fragment to be counted, overlap enough.

    Shingles common to two sets lie in both prefixes or in the rest of one, so the
    whole overlap is at most the meetings and the longer rest.
    """
    over, under = threshold
    pairs = written(pairs, "candidates")
    rest = lambda n: F.ceil(over * n / under) - 1
    met = (
        pairs.join(postings.select(F.col("doc").alias("a"), "h"), "a")
        .join(postings.select(F.col("doc").alias("b"), "h"), ["b", "h"])
        .groupBy("a", "na", "b", "nb")
        .agg(F.count("*").alias("times"))
    )
    most = F.col("times") + F.greatest(rest(F.col("na")), rest(F.col("nb")))
    most = F.least(most, "na", "nb")
    return met.where(_enough(most, F.col("na"), F.col("nb"), threshold)).select("a", "na", "b", "nb")


def one_of_each(documents: DataFrame, *, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """One document of each group of similar texts, the one with the smallest id, all columns.

    Rows are judged each by its own text: one of an id whose other texts are copies stays
    where its text is none. Of rows that repeat an id within a group all are kept, and so
    are rows without an id or without words."""
    placed, nodes, links = link_sets(documents, threshold)
    rows = placed.join(_grouped(nodes, links), "node")
    gone = rows.where("doc_id <> first").select(F.xxhash64("doc_id", "mark").alias("key"))
    # Looked up where rows are read: a join would move every text.
    copies = key_table(gone, fresh_path(documents.sparkSession, "copies"), COPY_BITS)
    return documents.where(~_listed(copies)(F.xxhash64(F.col("doc_id").cast("long"), text_mark(F.col("text")))))


def _listed(keys: Table):
    """Whether a key is in a table of keys."""

    @F.arrow_udf("boolean")
    def listed(values: pa.Array) -> pa.Array:
        return pa.array(keys.find(values.to_numpy(zero_copy_only=False).view(np.uint64))[-2])

    return listed


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) AS i FROM d WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 75 * (na.n + nb.n - k)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query(OP8_SQL)
def op8_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the component of its near copies, similarity 0.75."""
    return jaccard_components(table(spark, folder, "documents"))
