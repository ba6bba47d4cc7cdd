"""Sorted hash arrays in the shared folder, memory-mapped by the workers.

A table is one file a shard: keys in order, then a column of values for each kind.
Shards are ranges of the key's top bits. Workers map what they look up; pages are
shared by all workers of a machine and can be dropped at any time. Where the
folder is a remote store, a shard is first copied to an unlinked local file.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.scratch import written


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class Table:
    """Where a table lies: ``2 ** bits`` shards and the types of its value columns."""

    folder: str
    bits: int
    columns: tuple[str, ...]

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def write(self, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        """Write a shard; a second attempt replaces the file by an equal one."""
        columns = [np.ascontiguousarray(c, kind) for c, kind in zip(values, self.columns, strict=True)]
        self.store(shard, [np.ascontiguousarray(keys, np.uint64), *columns])

    def store(self, shard: int, parts: list[np.ndarray]) -> None:
        store, path = _at(self.folder)
        store.create_dir(path, recursive=True)
        name = f"{path}/{shard}"
        made = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(made) as out:
            for part in parts:
                out.write(part.tobytes())
        store.move(made, name)

    def seek(self, shard: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of a shard's wanted keys, in order: whether each is there, its place, and the
        values of those that are."""
        known, values = opened(self, shard)
        if not len(known):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64), [v[:0] for v in values]
        at = np.searchsorted(known, wanted)
        at[at == len(known)] = 0
        hit = known[at] == wanted
        return hit, at, [stored[at[hit]] for stored in values]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of each key, 0 where it is missing, and last whether it is there,
        and its place in its shard."""
        order = np.argsort(keys)
        wanted = keys[order]
        new = np.append(True, wanted[1:] != wanted[:-1]) if len(keys) else np.zeros(0, bool)
        wanted = wanted[new]
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(new) - 1
        found = [np.zeros(len(wanted), kind) for kind in self.columns]
        there = np.zeros(len(wanted), bool)
        place = np.zeros(len(wanted), np.int64)
        shards = self.shard(wanted)
        heads = np.flatnonzero(np.diff(shards, prepend=-1))
        for start, end in zip(heads, [*heads[1:], len(wanted)]):
            hit, at, values = self.seek(int(shards[start]), wanted[start:end])
            there[start:end] = hit
            place[start:end] = at
            for column, stored in zip(found, values):
                column[start:end][hit] = stored
        return [*(column[back] for column in found), there[back], place[back]]


RUN = 32


@dataclass(frozen=True)
class PackedTable(Table):
    """A table of some 5 bytes a key, and 1 to 4 for all its values.

    Of each run of 32 keys the first is stored whole and all by their low 40 bits, so a
    missing key is taken for one of its run in one of ``2 ** 35`` cases, no more often than
    64-bit hashes of some billions of things meet. Values are codes into a list of the
    different ones.
    """

    def write(self, shard: int, keys: np.ndarray, *values: np.ndarray) -> None:
        columns = [np.ascontiguousarray(c, kind) for c, kind in zip(values, self.columns, strict=True)]
        code = np.zeros(len(keys), np.int64)
        for column in columns:
            _, of = np.unique(column, return_inverse=True)
            code = np.unique(code * (int(of.max(initial=0)) + 1) + of, return_inverse=True)[1]
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
        padded = np.zeros(-(-len(keys) // RUN) * RUN, np.uint64)
        padded[: len(keys)] = keys
        low = padded.astype(np.uint32)
        high = (padded >> np.uint64(32)).astype(np.uint8)
        code = code.astype(np.min_scalar_type(len(first)))
        sizes = np.array([len(keys), len(first), code.itemsize], np.int64)
        self.store(shard, [sizes, padded[::RUN], *(c[first] for c in columns), low, code, high])

    def seek(self, shard: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n, heads, kinds, low, code, high = _opened_packed(self, shard)
        if not n:
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64), [k[:0] for k in kinds]
        run = np.searchsorted(heads, wanted, side="right") - 1
        asked = np.flatnonzero(run >= 0)
        run = run[asked]
        hit, at = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        # Equal low 32 bits come first, which two keys of a run can have in common.
        same = np.flatnonzero((np.take(low, run, axis=0) == wanted[asked].astype(np.uint32)[:, None]).ravel())
        row = same // RUN
        found = run[row] * RUN + same % RUN
        right = (found < n) & (high.reshape(-1)[found] == (wanted[asked[row]] >> np.uint64(32)).astype(np.uint8))
        row, found = asked[row[right]], found[right]
        hit[row], at[row[::-1]] = True, found[::-1]
        return hit, at, [k[code[at[hit]]] for k in kinds]


_open: dict[tuple[str, int], tuple] = {}


def _opened_packed(table: PackedTable, shard: int) -> tuple:
    key = (table.folder, shard)
    if key not in _open:
        store, path = _at(table.folder)
        name = f"{path}/{shard}"
        if not store.get_file_info(name).size:  # a shard without keys has no file
            none = np.zeros(0, np.uint64)
            _open[key] = (0, none, [np.zeros(0, k) for k in table.columns], none, none, none)
        else:
            if not isinstance(store, fs.LocalFileSystem):
                name = _copied(store, name)
            n, kinds, width = np.memmap(name, np.int64, "r", 0, (3,)).tolist()
            runs = -(-n // RUN)
            layout = [(np.uint64, runs), *((k, kinds) for k in table.columns), (np.uint32, runs * RUN), (f"u{width}", n), (np.uint8, runs * RUN)]
            parts, offset = [], 24
            for kind, size in layout:
                parts.append(np.asarray(np.memmap(name, kind, "r", offset, (size,))))
                offset += size * np.dtype(kind).itemsize
            *values, low, code, high = parts[1:]
            _open[key] = (n, parts[0], values, low.reshape(-1, RUN), code, high.reshape(-1, RUN))
    return _open[key]


def opened(table: Table, shard: int) -> tuple[np.ndarray, list[np.ndarray]]:
    key = (table.folder, shard)
    if key not in _open:
        store, path = _at(table.folder)
        name = f"{path}/{shard}"
        size = store.get_file_info(name).size or 0  # a shard without keys has no file
        width = 8 + sum(np.dtype(kind).itemsize for kind in table.columns)
        n = size // width
        if not n:
            _open[key] = (np.zeros(0, np.uint64), [np.zeros(0, k) for k in table.columns])
        else:
            if not isinstance(store, fs.LocalFileSystem):
                name = _copied(store, name)
            keys = np.asarray(np.memmap(name, np.uint64, "r", 0, (n,)))
            values, offset = [], 8 * n
            for kind in table.columns:
                values.append(np.asarray(np.memmap(name, kind, "r", offset, (n,))))
                offset += n * np.dtype(kind).itemsize
            _open[key] = (keys, values)
    return _open[key]


def mapped_bytes(folder: str, shard: int) -> np.ndarray:
    """The bytes of a shard without keys, empty where there is no file."""
    key = (folder, shard)
    if key not in _open:
        store, path = _at(folder)
        name = f"{path}/{shard}"
        if not store.get_file_info(name).size:
            _open[key] = (np.zeros(0, np.uint8),)
        else:
            if not isinstance(store, fs.LocalFileSystem):
                name = _copied(store, name)
            _open[key] = (np.asarray(np.memmap(name, np.uint8, "r")),)
    return _open[key][0]


def _copied(store: fs.FileSystem, name: str):
    local = tempfile.TemporaryFile()
    with store.open_input_stream(name) as source:
        while block := source.read(8 << 20):
            local.write(block)
    local.flush()
    return local


def key_table(keys: DataFrame, folder: str, bits: int) -> Table:
    """The column ``key`` (long) as sorted arrays, for an exact semi join within a scan."""
    store = Table(folder, bits, ())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            of = batch.column("shard").to_numpy()
            values = batch.column("key").to_numpy()
            for s in np.unique(of):
                if s != shard and held:
                    store.write(int(shard), np.unique(np.concatenate(held)))
                    held = []
                shard = s
                held.append(values[of == s].view(np.uint64))
        if held:
            store.write(int(shard), np.unique(np.concatenate(held)))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["done"])

    shard = F.shiftrightunsigned("key", 64 - bits).cast("int")
    dealt = keys.select("key", shard.alias("shard")).repartition(1 << bits, "shard").sortWithinPartitions("shard")
    written(dealt.mapInArrow(write, "done int"), "keys")
    return store
