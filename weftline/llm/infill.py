"""Fill-in-the-middle by repeated captures.

One full match of ``(unit)*`` against a text keeps the end of every repetition: their
number is the number of units, and the ends themselves give both cuts. Where to
cut, and in which form a text is written, comes from a hash of its id, so any task
that runs again writes the same row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftline.llm.registry import query
from weftline.sources.tables import table

# Fixed value: a word with the white space before it, or white space that ends a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Sentinels:
    """What stands before the prefix, the suffix and the middle.

    No sentinel may hold another, nor begin as one ends: then text that has none of
    them cannot make one at an edge, and an output can be cut again without doubt.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        for a, b in permutations(self.all, 2):
            if a in b:
                raise ValueError(f"the sentinel {a!r} lies in {b!r}")
        for a in self.all:
            for b in self.all:
                if not a or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + 1))):
                    raise ValueError(f"the sentinel {b!r} can begin where {a!r} ends")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def fill_in_middle(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    unit: str = UNIT,
    sentinels: Sentinels = Sentinels(),
) -> DataFrame:
    """All rows and columns of ``documents``, with ``n`` (units of the text), ``form``,
    ``prefix_chars``, ``middle_chars`` (code points; null in the form plain) and ``output``.

    Two hashes of seed and id choose two cuts between units, each of the n + 1 places
    equally likely; a third chooses the ``percent`` of rows that are cut at all, a
    fourth the ``spm_percent`` of those with the suffix first. Empty texts and texts that
    hold a sentinel stay plain. ``unit`` has to match every text piece by piece, without gaps.

    A null text is empty, a null id has the digits of none (the hash is of ``seed:``).
    Rows that repeat an id are cut at the same units. Columns of ``documents`` that have
    the name of an added one are replaced. A row is one match, whatever its length:
    memory is one integer a unit of the batch's longest text.
    """
    units = f"({unit})*+"
    prefix, suffix, middle = sentinels.all
    # Hashes of this id, made by the engine: four unsigned numbers of 8 hex digits.
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    kept = documents.drop(*ADDED)
    rows = kept.withColumn("_work", F.struct(F.coalesce(F.col(text_column).cast("string"), F.lit("")), *parts))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def cut(text: str, h1: int, h2: int, h3: int, h4: int, match) -> tuple:
        ends = match(text).ends(1)
        n = len(ends)
        if not n or h3 % 100 >= percent or prefix in text or suffix in text or middle in text:
            return n, PLAIN, None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (low, high))
        if h4 % 100 < spm_percent:
            return n, SPM, a, b - a, f"{suffix}{text[b:]}{prefix}{text[:a]}{middle}{text[a:b]}"
        return n, PSM, a, b - a, f"{prefix}{text[:a]}{suffix}{text[b:]}{middle}{text[a:b]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = regex.compile(units).fullmatch
        for batch in batches:
            for part in _slices(batch):
                work = zip(*(c.to_pylist() for c in part.columns[-1].flatten()))
                done = list(zip(*(cut(*w, match) for w in work)))
                added = [pa.array(c, kind) for c, kind in zip(done, kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], names=[*part.schema.names[:-1], *ADDED])

    types = (LongType(), StringType(), LongType(), LongType(), StringType())
    schema = StructType([*kept.schema, *(StructField(name, kind) for name, kind in zip(ADDED, types))])
    return rows.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def restored(form: Column, output: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that ``fill_in_middle`` was given, from its form and output alone."""
    marks = "|".join(rf"\Q{s}\E" for s in sentinels.all)
    parts = F.split(output, marks, -1)
    # After the empty string before the first sentinel: two pieces by form, and the middle.
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (
        F.when(form == PSM, F.concat(first, middle, second))
        .when(form == SPM, F.concat(second, middle, first))
        .otherwise(output)
    )


@query()
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut for infilling, and their texts rebuilt from the outputs."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return fill_in_middle(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
