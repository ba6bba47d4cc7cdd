"""A data source for labelled tab-separated values: ``name:value`` fields, one
record per line. Absent labels are null.

Register with ``spark.dataSource.register(LtsvSource)``, then use
``spark.read.format("ltsv").schema(...)`` and ``df.write.format("ltsv")``.
Paths go through pyarrow's file systems, so shared storage works as well.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DateType, IntegralType, StringType, StructType

# How control characters are written inside a field.
_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))

ROWS_PER_BATCH = 10_000
SPLIT_BYTES = 64 * 1024 * 1024
BLOCK_BYTES = 4 * 1024 * 1024


class LtsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ltsv"

    def schema(self):
        raise ValueError("give the ltsv reader a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        return _Reader(self.options["path"], schema, split)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


@dataclass
class _Split(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self._path, self._schema, self._split_bytes = path, schema, split_bytes
        self._filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what Arrow compares as Spark does, by columns of whole values; the rest goes back."""
        kinds = {f.name: f.dataType for f in self._schema}
        for f in filters:
            column = f.attribute[0] if isinstance(f, (*_COMPARED, IsNull, IsNotNull, In)) and len(f.attribute) == 1 else None
            if isinstance(kinds.get(column), (StringType, IntegralType, BooleanType, DateType)):
                self._filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Split]:
        store, root = fs.FileSystem.from_uri(_uri(self._path))
        files = store.get_file_info(fs.FileSelector(root))
        return [
            _Split(f.path, start, min(start + self._split_bytes, f.size))
            for f in files
            if f.is_file and f.base_name.endswith(".ltsv")
            for start in range(0, f.size, self._split_bytes)
        ]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self._schema)
        for lines in self._lines(split):
            for at in range(0, len(lines), ROWS_PER_BATCH):
                batch = _parsed(pa.array(lines[at : at + ROWS_PER_BATCH], pa.string()), arrow)
                for f in self._filters:
                    batch = batch.filter(_holds(f, batch.column(f.attribute[0])))
                if batch.num_rows:
                    yield batch

    def _lines(self, split: _Split) -> Iterator[list[str]]:
        """The lines that start inside the split, a block at a time."""
        store, _ = fs.FileSystem.from_uri(_uri(self._path))
        with io.BufferedReader(store.open_input_file(split.path), 1 << 20) as file:
            if split.start:
                # The line across the boundary belongs to the split before.
                file.seek(split.start - 1)
                file.readline()
            while (at := file.tell()) < split.end:
                block = file.read(min(BLOCK_BYTES, split.end - at))
                if not block:
                    return
                if not block.endswith(b"\n"):
                    block += file.readline()
                yield block.decode("utf-8").removesuffix("\n").split("\n")


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    """Tasks write under temporary names; the commit gives files their own, so
    a failed or repeated task leaves nothing that a reader would see."""

    def __init__(self, path: str, overwrite: bool):
        self._path, self._overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, root = fs.FileSystem.from_uri(_uri(self._path))
        store.create_dir(root, recursive=True)
        final = f"{root}/part-{uuid.uuid4().hex}.ltsv"
        with store.open_output_stream(f"{final}.tmp") as out:
            for batch in batches:
                if batch.num_rows:
                    out.write(("\n".join(_lines(batch)) + "\n").encode("utf-8"))
        return _Written(f"{final}.tmp", final)

    def commit(self, messages: list[_Written]) -> None:
        store, root = fs.FileSystem.from_uri(_uri(self._path))
        old = []
        if self._overwrite:
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            old = [f.path for f in found if f.base_name.endswith(".ltsv")]
        for message in messages:
            if message:
                store.move(message.temporary, message.final)
        # Last, so that a failure on the way leaves the old rows.
        for path in old:
            store.delete_file(path)

    def abort(self, messages: list[_Written]) -> None:
        store, _ = fs.FileSystem.from_uri(_uri(self._path))
        for message in messages:
            if message:
                store.delete_file(message.temporary)


def _uri(path: str) -> str:
    return path if "://" in path or not path.startswith("/") else f"file://{path}"


def _parsed(lines: pa.Array, arrow: pa.Schema) -> pa.RecordBatch:
    """The wanted labels of each line, typed. Of a label that repeats the last counts; one
    without a colon is empty."""
    split = pc.split_pattern(lines, "\t")
    fields = split.values
    owner = np.repeat(np.arange(len(lines)), np.diff(split.offsets.to_numpy()))
    columns = []
    for field in arrow:
        mark = f"{field.name}:"
        hits = pc.or_(pc.starts_with(fields, mark), pc.equal(fields, field.name))
        found = np.flatnonzero(hits.to_numpy(zero_copy_only=False))
        last = np.full(len(lines), -1)
        last[owner[found]] = found
        values = fields.take(pa.array(last, mask=last < 0))
        columns.append(_unescaped(pc.utf8_slice_codeunits(values, len(mark))).cast(field.type))
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def _unescaped(values: pa.Array) -> pa.Array:
    escaped = pc.fill_null(pc.match_substring(values, "\\"), False)
    if not pc.any(escaped).as_py():
        return values
    # Double backslashes go first, from the left; what is between them has single marks only.
    pieces = pc.split_pattern(values.filter(escaped), "\\\\")
    plain = pieces.values
    for raw, written in _ESCAPES[1:]:
        plain = pc.replace_substring(plain, written, raw)
    whole = pc.binary_join(pa.ListArray.from_arrays(pieces.offsets, plain), "\\")
    return pc.replace_with_mask(values, escaped, whole)


_COMPARED = {
    EqualTo: pc.equal,
    GreaterThan: pc.greater,
    GreaterThanOrEqual: pc.greater_equal,
    LessThan: pc.less,
    LessThanOrEqual: pc.less_equal,
}


def _holds(f: Filter, column: pa.Array) -> pa.Array:
    if isinstance(f, IsNull):
        return column.is_null()
    if isinstance(f, IsNotNull):
        return column.is_valid()
    if isinstance(f, In):
        values = pa.array([v for v in f.value if v is not None], column.type)
        return pc.and_(column.is_valid(), pc.is_in(column, values))
    return _COMPARED[type(f)](column, pa.scalar(f.value, column.type))


def _lines(batch: pa.RecordBatch) -> list[str]:
    """A line for each row: its fields that are not null."""
    fields = []
    for name, column in zip(batch.schema.names, batch.columns):
        text = column.cast(pa.string())
        for plain, written in _ESCAPES:
            text = pc.replace_substring(text, plain, written)
        fields.append(pc.binary_join_element_wise(f"{name}:", text, ""))
    return pc.binary_join_element_wise(*fields, "\t", null_handling="skip").to_pylist()
