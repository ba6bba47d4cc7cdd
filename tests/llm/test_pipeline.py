import random

import corpus_pipeline
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_hand_on_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).persist()
        assert docs.columns == COLUMNS, name
        assert 0 < docs.count() <= before, name
        assert docs.where(F.col("n_chars") != F.length("text")).isEmpty(), name
        before = docs.count()
    bins = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert bins.select("doc_id").distinct().count() == before


def test_planted_cases(spark, documents, small):
    rng = random.Random(8)
    text = lambda n=120: "\n".join(" ".join(f"w{rng.randrange(10**5)}" for _ in range(12)) for _ in range(n // 12))
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    clean = [(k, text()) for k in range(1, 31)]
    copy = text()
    near = copy.split(" ")
    near[50] = "changed"
    rows = clean + [
        (40, copy), (41, copy), (42, " ".join(near)),
        (50, text(60) + "\n" + item), (51, text(4800) + "\n" + item),
        (60, text() + "\npassword=506fa6770ab87573ba end"), (61, "too short"), (62, None), (63, ""), (None, text()),
    ]
    docs = documents(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == {k for k, _ in clean} | {40, 51, 60, None}
    assert all(kept[k] == t for k, t in clean)


def test_empty_table_and_further_columns(spark, documents, small):
    docs = documents([]).withColumn("line", F.lit(1)).withColumn("a", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == [*COLUMNS, "line", "a"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 0
