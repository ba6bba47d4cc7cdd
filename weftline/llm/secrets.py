"""Secret scans with a random forest that removes false positives.

Patterns propose candidates; each gets features of its length, its character
transitions, how much of it dictionary words cover, its path and its neighbouring
words. A random forest trained on labelled findings decides which are secrets. The
dictionary and the transition frequencies are counted over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import kneser_ney, sketches, textbytes
from weftline.llm.registry import query
from weftline.scratch import fresh_path, written
from weftline.sources.tables import table

# Forms of well-known credentials, and names that one is assigned to.
PATTERNS = (
    ("cloud_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("code_host_token", r"\bgh[pousr]_[0-9A-Za-z]{36}\b"),
    ("payment_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    ("chat_token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}"),
    ("web_token", r"\beyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{5,}"),
    ("assigned", r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[^\s\"',;]{6,})"),
    ("long_string", r"(?<!\w)[0-9A-Za-z+/_-]{16,}={0,2}(?!\w)"),
)
_SCAN = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS))
CONTEXT = 48
BUCKETS = 16
BLOCK = 512
SHORTEST, LONGEST = 3, 12  # bytes of a dictionary word within a candidate
CLASSES = 38  # a-z, 0-9, upper case and others

_CLASS = np.full(256, 37, np.int64)
_CLASS[0x61:0x7B] = np.arange(26)
_CLASS[0x30:0x3A] = np.arange(26, 36)
_CLASS[0x41:0x5B] = 36


@dataclass(frozen=True)
class Knowledge:
    """What all documents say about ordinary text: log10 chances of one character class
    after another, and hashes of dictionary words."""

    transitions: np.ndarray
    dictionary: frozenset[int]


def learn_text(documents: DataFrame, share: float = 1e-5) -> Knowledge:
    """Counts over all documents. Dictionary words are those with more than ``share`` of
    all words, so there are fewer than ``1 / share``; the transition table is of fixed size."""
    spark = documents.sparkSession
    texts = documents.select(F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CLASSES * CLASSES + 12, np.int64)  # a multiple of the slices
        for batch in batches:
            for _, _, data, _ in textbytes.pieces(batch.column("text")):
                kinds = _CLASS[data]
                seen += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=len(seen))
        packed = sketches.slices(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary())],
            names=["slice", "packed"],
        )

    size = CLASSES * CLASSES + 12
    seen = sketches.merged(texts.mapInArrow(count, "slice int, packed binary"), "int64", np.add, size)
    pairs = seen[: CLASSES * CLASSES].reshape(CLASSES, CLASSES) + 1.0
    words = kneser_ney.count_vocabulary(texts, fresh_path(spark, "dictionary"))
    _, hashes = kneser_ney.frequent_words(spark, words, share)
    return Knowledge(np.log10(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(hashes.tolist()))


def _hash(words: list[bytes]) -> list[int]:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return textbytes.hash_spans(data, np.append(0, ends[:-1]), ends).tolist()


def covered(candidate: str, dictionary: frozenset[int]) -> float:
    """The share of a candidate's characters that lie in dictionary words of 3 to 12
    letters, the longest taken first from the left."""
    letters = candidate.lower().encode()
    found: dict[int, int] = {}
    # Words begin in a block of bytes and may end beyond it.
    for block in range(0, len(letters), BLOCK):
        starts = range(block, min(block + BLOCK, len(letters)))
        spans = [(s, e) for s in starts for e in range(min(len(letters), s + LONGEST), s + SHORTEST - 1, -1)]
        if not spans:
            continue
        for (s, e), h in zip(spans, _hash([letters[s:e] for s, e in spans])):
            if h in dictionary and s not in found:
                found[s] = e
    at = total = 0
    while at < len(letters):
        end = found.get(at, at)
        total += end - at
        at = max(end, at + 1)
    return total / len(letters) if letters else 0.0


def features(candidate: str, path: str, before: str, after: str, knowledge: Knowledge) -> list[float]:
    raw = np.frombuffer(candidate.encode(), np.uint8)
    kinds = _CLASS[raw]
    steps = knowledge.transitions[kinds[:-1], kinds[1:]] if len(raw) > 1 else np.zeros(1)
    broad = np.digitize(kinds, [26, 36, 37])
    share = np.bincount(broad, minlength=4) / len(raw)
    counts = np.bincount(raw)
    p = counts[counts > 0] / len(raw)
    out = [
        float(len(candidate)), float(steps.mean()), float(steps.min()), float((broad[1:] != broad[:-1]).mean() if len(raw) > 1 else 0),
        *share.tolist(), float(-(p * np.log2(p)).sum()), covered(candidate, knowledge.dictionary),
        float("=" in before[-4:] or ":" in before[-4:]), float(before[-1:] in ("'", '"')),
        float(path.count("/")), float(any(w in path.lower() for w in ("test", "example", "sample", "doc"))),
    ]
    for words in (re.findall(r"[a-z]+", before.lower())[-2:], re.findall(r"[a-z]+", after.lower())[:2], [path]):
        buckets = [0.0] * BUCKETS
        for h in _hash([w.encode() for w in words if w]) if any(words) else []:
            buckets[h % BUCKETS] = 1.0
        out += buckets
    return out


FINDINGS = "doc_id long, text_hash long, start long, stop long, kind string, candidate string, features array<double>"


def find_candidates(documents: DataFrame, knowledge: Knowledge, *, path: str = "source") -> DataFrame:
    """A row a candidate: ``doc_id, text_hash, start, stop`` (code points of the text),
    ``kind, candidate, features``. Null and empty texts have none, a null path is empty.
    Rows that repeat give their candidates each."""
    known = documents.sparkSession.sparkContext.broadcast(knowledge.transitions), knowledge.dictionary
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("candidate", pa.string()), ("features", pa.list_(pa.float64()))]
    )
    transitions, dictionary = known

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = Knowledge(transitions.value, dictionary)
        for batch in batches:
            out: list[tuple] = []
            for doc, mark, text, where in zip(*(c.to_pylist() for c in batch.columns)):
                for m in _SCAN.finditer(text):
                    start, stop = m.span("value") if m.lastgroup == "value" or m.group("assigned") else m.span()
                    kind = next(name for name, _ in PATTERNS if m.group(name) is not None)
                    got = text[start:stop]
                    near = features(got, where, text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT], facts)
                    out.append((doc, mark, start, stop, kind, got, near))
            columns = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
    )
    return rows.mapInArrow(find, FINDINGS)


def label_findings(findings: DataFrame) -> DataFrame:
    """Findings whose form settles what they are, with ``label`` 1 or 0: credentials of a
    known issuer and mixed strings assigned to a name are secrets; long strings of
    letters alone, as long words are, are not. The rest stay unlabelled and go."""
    issued = ~F.col("kind").isin("assigned", "long_string")
    mixed = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    letters = F.col("candidate").rlike("^[A-Za-z_-]+$")
    label = F.when(issued | ((F.col("kind") == "assigned") & mixed), 1).when(letters, 0)
    return findings.withColumn("label", label.cast("double")).where("label IS NOT NULL")


def train_forest(labelled: DataFrame, *, max_rows: int = 20_000, trees: int = 40, depth: int = 8):
    """A forest from labelled findings (``features``, ``label``), or the label that all have
    (0 where there are none). At most ``max_rows`` of each label are used, the first by
    hash; they are a sample to fit on, everything else covers all rows."""
    order = F.xxhash64("text_hash", "start")
    parts = [labelled.where(F.col("label") == k).orderBy(order, "text_hash", "start", "doc_id").limit(max_rows) for k in (0, 1)]
    sample = written(parts[0].unionByName(parts[1]).select("features", "label"), "labelled")
    kinds = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    forest = RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=7)
    return forest.fit(sample.withColumn("vector", array_to_vector("features")))


def judge(findings: DataFrame, forest) -> DataFrame:
    """Adds ``probability`` of being a secret."""
    if isinstance(forest, float):
        return findings.withColumn("probability", F.lit(forest))
    scored = forest.transform(findings.withColumn("vector", array_to_vector("features")))
    return scored.withColumn("probability", vector_to_array("probability")[1]).select(*findings.columns, "probability")


def scan_secrets(documents: DataFrame, *, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """All candidates of all documents with their probability and ``is_secret``."""
    findings = written(find_candidates(documents, learn_text(documents), path=path), "findings")
    forest = train_forest(label_findings(findings))
    return judge(findings, forest).withColumn("is_secret", F.col("probability") >= threshold)


def mask_secrets(documents: DataFrame, *, mask: str = "[secret]", **settings) -> DataFrame:
    """All documents, all columns, each secret in a text replaced by ``mask`` and
    ``n_chars``, if there is such a column, brought up to date."""
    secrets = scan_secrets(documents, **settings).where("is_secret")
    spans = written(
        secrets.groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
        .withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"}),
        "secrets",
    )
    same = documents["doc_id"].eqNullSafe(spans["_doc"]) & (
        F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == spans["_hash"]
    )
    rows = documents.join(spans, same, "left")
    last = F.get("_spans", F.size("_spans") - 1)["stop"]
    kept = F.transform(
        "_spans",
        lambda s, k: F.substring(
            F.col("text"),
            F.coalesce(F.get("_spans", k - 1)["stop"], F.lit(0)).cast("int") + 1,
            (s["start"] - F.coalesce(F.get("_spans", k - 1)["stop"], F.lit(0))).cast("int"),
        ),
    )
    masked = F.concat(
        F.array_join(kept, mask), F.lit(mask), F.substring("text", last.cast("int") + 1, F.length("text"))
    )
    result = rows.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(masked))
    if "n_chars" in documents.columns:
        result = result.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return result.select(*documents.columns)


@query()
def op7_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates in all documents, each with the forest's verdict."""
    found = scan_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "start", "stop", "kind", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret"
    )
