import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import sharding


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims), -1).reshape(-1, dims)
    index = sharding.hilbert_index(cells, bits)
    assert sorted(index) == list(range(2 ** (bits * dims)))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_query_keeps_its_law(spark, medium):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = sharding.op9_hilbert_shards(spark, medium).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) == set(range(16))
    assert max(held.values()) - min(held.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Equal texts lie in one shard.
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r["doc_id"]]].add(r["shard"])
    assert len(homes) < len(rows) and all(len(shards) == 1 for shards in homes.values())


def test_string_edges_cut_whole_strings_into_even_cells(spark):
    values = [f"https://example.org/a-long-common-prefix/{k % 40:03}" for k in range(400)] + [None] * 50 + ["zz"] * 300
    edges = sharding.string_edges(spark.createDataFrame([(v,) for v in values], "v string"), 8)
    cells = Counter(sum(e < v for e in edges) for v in values if v is not None)
    assert len(edges) <= 7 and all(v <= 90 for k, v in cells.items() if k != max(cells)) and 300 <= cells[max(cells)] <= 390
    assert sharding.string_edges(spark.createDataFrame([], "v string"), 8) == []
    assert sharding.string_edges(spark.createDataFrame([("same",)] * 9, "v string"), 8) == []


def test_sources_of_one_prefix_are_told_apart(spark):
    rows = [(k, f"https://{'az'[k % 2]}.example/{k % 2}", 1) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    got = sharding.hilbert_shards(frame, {"source": F.col("source")}, F.col("size"), 4, row_id=F.col("doc_id"), group=F.col("doc_id"))
    held = defaultdict(set)
    for r in got.collect():
        held[r["shard"]].add(r["source"])
    assert all(len(sources) == 1 for sources in held.values())


def test_odd_rows(spark):
    rows = [(k, "hot", 5) for k in range(50)] + [(None, None, None), (7, "hot", 5), (7, "a", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, size long").withColumn("shard", F.lit("clash"))

    def run(df):
        dims = {"lang": F.col("lang"), "size": F.col("size")}
        return sharding.hilbert_shards(df, dims, F.coalesce("size", F.lit(1)), 4, row_id=F.col("doc_id"), group=F.col("lang"))

    got = run(frame).collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} == {0, 1, 2, 3}
    assert run(frame.limit(0)).count() == 0
