"""Writing tables to files and reading them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weftline.scratch import fresh_path, written_buckets

# Options under which a value read back equals the value written. Text formats that
# cannot tell null from empty, or keep blanks and line ends, hold strings encoded: see
# _encoded. Files stay splittable, since no value holds a line end.
LOSSLESS = {
    "csv": {
        "header": "true",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
        "escape": '"',
        "multiLine": "false",
    },
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "xml": {"rowTag": "row", "ignoreSurroundingSpaces": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"},
    "orc": {},
    "parquet": {"compression": "zstd"},
}


ENCODED = ("csv", "xml")


def _encoded(value: Column) -> Column:
    """A string between bars, with backslashes, line ends and other control characters
    written as a backslash and a letter; null is a backslash and N."""
    for plain, letter in _CONTROLS:
        value = F.replace(value, F.lit(plain), F.lit("\\" + letter))
    return F.coalesce(F.concat(F.lit("|"), value, F.lit("|")), F.lit("\\N"))


def _decoded(value: Column) -> Column:
    body = F.substring(value, F.lit(2), F.length(value) - 2)
    for plain, letter in reversed(_CONTROLS):
        body = F.replace(body, F.lit("\\" + letter), F.lit(plain))
    return F.when(value != F.lit("\\N"), body)


# Backslashes come first when encoding and last when decoding.
_CONTROLS = (("\\", "s"), ("\n", "n"), ("\r", "r"), ("\t", "t"), ("\v", "v"), ("\f", "f"), ("\0", "0"))


def _strings(df: DataFrame, change, skip: Sequence[str] = ()) -> DataFrame:
    names = [n for n, kind in df.dtypes if kind == "string" and n not in skip]
    return df.withColumns({n: change(F.col(n)) for n in names}) if names else df


def write_files(
    df: DataFrame, path: str, kind: str, *, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """Write ``df`` as csv, json, xml, orc or parquet.

    With ``partition_by``, rows are first gathered by those columns, and a large
    value is split over several tasks, so that each folder gets few large files.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if kind in ENCODED:
        df = _strings(df, _encoded, partition_by)
    writer = df.write.format(kind).options(**LOSSLESS[kind]).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_files(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """Read what ``write_files`` wrote, with a known schema, which spares a pass to infer
    one. Give columns that the files are partitioned by as other types than string."""
    rows = spark.read.format(kind).options(**LOSSLESS[kind]).schema(schema).load(path)
    return _strings(rows, _decoded) if kind in ENCODED else rows


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    path = fresh_path(df.sparkSession, kind)
    write_files(df, path, kind)
    return read_files(df.sparkSession, path, kind, df.schema)


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` hashed into buckets by ``keys``, one file to a bucket, and
    return the written table. Tables bucketed alike join and group on those keys
    without an exchange, as often as they are read."""
    return written_buckets(df.repartition(buckets, *keys), keys, buckets)
