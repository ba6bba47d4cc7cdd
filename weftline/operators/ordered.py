"""Window calculations that survive a partition key holding most of the rows.

A Spark window sends every row of a key to one task. ``order_rows`` counts the
keys first. Small keys get plain windows with one exchange. Rows of large keys
are set apart and range-partitioned on key and order, so that each large key
spans many slices. A slice is calculated on its own, and what earlier slices
contribute arrives by joining a table of about one row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from weftline.functions.columns import same
from weftline.scratch import written, written_buckets

# One task orders and keeps a slice, or a key of that many rows, at a time.
ROWS_PER_SLICE = 500_000
# The most slices for which the driver's sample for the range bounds stays small.
MAX_SLICES = 20_000

SLICE = "_slice"
HALO = "_halo"

# How the results of two adjacent runs of rows combine.
RUNNING = ("sum", "count", "min", "max", "last")


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a partition key and an order, ready for window calculations.

    ``order`` lists column names, each optionally followed by " desc". When the
    order has ties, only calculations that do not depend on them are stable.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    # The (key, slice) pairs of keys that span slices, or None for plain windows.
    spanning: DataFrame | None = None
    # The rows of small keys, when these are only those of large ones.
    rest: OrderedRows | None = None

    @property
    def sliced(self) -> bool:
        return self.spanning is not None

    # -- results -----------------------------------------------------------

    def result(self) -> DataFrame:
        rows = self.df.drop(SLICE) if self.sliced else self.df
        return rows.unionByName(self.rest.result()) if self.rest else rows

    def with_columns(self, **outputs: Column) -> OrderedRows:
        """Add row-wise columns; keys and order stay as they are."""
        return self._each(lambda part: part._with(outputs))

    def with_row_number(self, name: str) -> OrderedRows:
        return self._each(lambda part: part._numbered(name))

    def with_running(self, **outputs: tuple[str, str]) -> OrderedRows:
        """Aggregates from the first row of the key to the current row.

        Each output is ``name=(kind, column)`` with a kind from ``RUNNING``;
        ``last`` is the latest value that is not null.
        """
        for kind, _ in outputs.values():
            if kind not in RUNNING:
                raise ValueError(f"unknown running aggregate {kind!r}")
        return self._each(lambda part: part._accumulated(outputs))

    def with_frame(self, before: int = 0, after: int = 0, **outputs: Column) -> OrderedRows:
        """Aggregates over the rows from ``before`` rows back to ``after`` rows ahead.

        Outputs are aggregates without a window, such as ``F.sum("x")``; the frame
        is set here, so that no output can look beyond what a slice borrows from
        its neighbours.
        """
        return self._each(
            lambda part: part._framed(
                before,
                after,
                lambda w: {n: c.over(w.rowsBetween(-before, after)) for n, c in outputs.items()},
            )
        )

    def with_shifted(self, **outputs: tuple[str, int]) -> OrderedRows:
        """Values of rows nearby: ``name=(column, rows)``, negative rows being earlier.
        Null where the key has no such row."""
        before = max([0, *(-n for _, n in outputs.values())])
        after = max([0, *(n for _, n in outputs.values())])
        return self._each(
            lambda part: part._framed(
                before, after, lambda w: {k: F.lead(c, n).over(w) for k, (c, n) in outputs.items()}
            )
        )

    # -- one part ----------------------------------------------------------

    def _each(self, step: Callable[[OrderedRows], OrderedRows]) -> OrderedRows:
        return replace(step(self), rest=self.rest and step(self.rest))

    def _numbered(self, name: str) -> OrderedRows:
        local = F.row_number().over(self._window()).cast("bigint")
        if not self.sliced:
            return self._with({name: local})
        carried = self._carried(
            {"_carry_rows": F.count(F.lit(1))},
            lambda w: {"_carry_rows": F.sum("_carry_rows").over(w)},
        )
        earlier = F.coalesce(F.col("_carry_rows"), F.lit(0))
        return self._with({name: local})._adding(carried, {name: F.col(name) + earlier})

    def _accumulated(self, outputs: Mapping[str, tuple[str, str]]) -> OrderedRows:
        upto = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {n: _running(kind, F.col(c)).over(upto) for n, (kind, c) in outputs.items()}
        if not self.sliced:
            return self._with(local)

        # The last value of a slice is that of its highest row number, whatever the order.
        placed = self._with({"_slice_place": F.row_number().over(self._window())})
        summary = {
            f"_carry_{n}": F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_slice_place")))
            if kind == "last"
            else _running(kind, F.col(c))
            for n, (kind, c) in outputs.items()
        }
        carried = placed._carried(
            summary,
            lambda w: {
                f"_carry_{n}": _running(
                    "sum" if kind == "count" else kind, F.col(f"_carry_{n}")
                ).over(w)
                for n, (kind, _) in outputs.items()
            },
        )
        step = self._with(local)
        types = {f.name: f.dataType for f in step.df.schema.fields}
        merged = {
            n: _merge(kind, F.col(f"_carry_{n}"), F.col(n)).cast(types[n])
            for n, (kind, _) in outputs.items()
        }
        return step._adding(carried, merged)

    def _framed(self, before: int, after: int, make) -> OrderedRows:
        if not self.sliced:
            return self._with(make(self._window()))
        rows = self.df.withColumn(HALO, F.lit(False))
        if before:
            rows = rows.unionByName(self._borrowed(before, from_earlier=True))
        if after:
            rows = rows.unionByName(self._borrowed(after, from_earlier=False))
        framed = rows.withColumns(make(self._window()))
        return replace(self, df=framed.where(~F.col(HALO)).drop(HALO))

    def _partition(self) -> tuple[str, ...]:
        return (*self.keys, SLICE) if self.sliced else self.keys

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self._partition()).orderBy(*_sort(self.order))

    def _with(self, columns: Mapping[str, Column]) -> OrderedRows:
        return replace(self, df=self.df.withColumns(dict(columns)))

    def _carried(
        self,
        summary: Mapping[str, Column],
        combine: Callable[[WindowSpec], Mapping[str, Column]],
    ) -> DataFrame:
        """What all earlier slices of the same key add up to: one row at most
        for each slice."""
        per = self.df.groupBy(*self.keys, SLICE).agg(
            *[column.alias(name) for name, column in summary.items()]
        )
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = (
            per.withColumns({**combine(earlier), "_slice_seen": F.count(F.lit(1)).over(earlier)})
            .where("_slice_seen > 0")
            .drop("_slice_seen")
        )
        # Written, so that the join with it is planned by its true size.
        return written(carried, "carried")

    def _adding(self, carried: DataFrame, outputs: Mapping[str, Column]) -> OrderedRows:
        extra = [c for c in carried.columns if c not in (*self.keys, SLICE)]
        joined = self._join_spanning(self.df, carried, extra, "left")
        return replace(self, df=joined.withColumns(dict(outputs)).drop(*extra))

    def _join_spanning(
        self, rows: DataFrame, small: DataFrame, extra: Sequence[str], how: str
    ) -> DataFrame:
        on = self._partition()
        right = small.select(*[F.col(c).alias(f"_slice_on_{c}") for c in on], *extra)
        matched = same((rows[c], right[f"_slice_on_{c}"]) for c in on)
        return rows.join(right, matched, how).drop(*[f"_slice_on_{c}" for c in on])

    def _borrowed(self, reach: int, from_earlier: bool) -> DataFrame:
        """The rows within ``reach`` of a slice's start (or end), relabelled
        with that slice."""
        toward = [_flip(name) for name in self.order] if from_earlier else self.order
        edge = Window.partitionBy(*self.keys, SLICE).orderBy(*_sort(toward))
        columns = self.df.columns
        near = self.df.withColumn("_slice_reach", F.row_number().over(edge)).where(
            F.col("_slice_reach") <= reach
        )
        place = ["_slice_index", "_slice_rows", "_slice_through", "_slice_parts"]
        near = self._join_spanning(near, self.spanning, place, "inner")
        # Slices are mostly longer than the reach, so most hops find no target near enough;
        # a key has no more slices than parts to pass.
        step = F.sequence(F.lit(1), F.least(F.lit(reach), F.col("_slice_parts").cast("int")))
        sign = 1 if from_earlier else -1
        near = near.withColumn("_slice_hop", F.explode(step)).withColumn(
            "_slice_target", F.col("_slice_index") + sign * F.col("_slice_hop")
        )
        targets = self.spanning.select(
            *[F.col(k).alias(f"_slice_to_{k}") for k in self.keys],
            F.col(SLICE).alias("_slice_to_slice"),
            F.col("_slice_index").alias("_slice_to_index"),
            (F.col("_slice_through") - F.col("_slice_rows")).alias("_slice_to_start"),
            F.col("_slice_through").alias("_slice_to_end"),
        )
        matched = same((near[k], targets[f"_slice_to_{k}"]) for k in self.keys) & (
            near["_slice_target"] == targets["_slice_to_index"]
        )
        if from_earlier:
            between = F.col("_slice_to_start") - F.col("_slice_through")
        else:
            between = F.col("_slice_through") - F.col("_slice_rows") - F.col("_slice_to_end")
        return (
            near.join(targets, matched)
            .where(F.col("_slice_reach") + between <= reach)
            .withColumn(SLICE, F.col("_slice_to_slice"))
            .select(*columns, F.lit(True).alias(HALO))
        )


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    rows_per_slice: int = ROWS_PER_SLICE,
    slices: int | None = None,
    max_slices: int = MAX_SLICES,
) -> OrderedRows:
    """Prepare ``df`` for window calculations by ``keys`` in ``order``.

    Keys of more than ``rows_per_slice`` rows are cut into slices of about that
    size. Give ``slices`` to cut all keys into so many, without counting. Where more
    than ``max_slices`` would be needed this raises: allow more, or larger slices.

    The large keys' rows are read to be sampled and again to be written, with
    one exchange; calculations then find each slice in place. Project ``df`` to
    the columns in use, and write it beforehand if it is costly to compute.
    """
    keys, order = tuple(keys), tuple(order)
    if slices is not None:
        return _sliced(df, keys, order, slices)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if not keys:
        rows = sizes.first()[0]
        if rows <= rows_per_slice:
            return OrderedRows(df, keys, order)
        return _sliced(df, keys, order, _slice_count(rows, rows_per_slice, max_slices))
    # At most one key in every rows_per_slice rows; Spark knows the written table's size.
    large = written(sizes.where(F.col("_rows") > rows_per_slice), "large")
    rows = large.agg(F.sum("_rows")).first()[0]
    if rows is None:
        return OrderedRows(df, keys, order)
    named = large.select(*[F.col(k).alias(f"_large_{k}") for k in keys])
    is_large = same((df[k], named[f"_large_{k}"]) for k in keys)
    apart = df.join(named, is_large, "left_semi")
    rest = df.join(named, is_large, "left_anti")
    split = _sliced(apart, keys, order, _slice_count(rows, rows_per_slice, max_slices))
    return replace(split, rest=OrderedRows(rest, keys, order))


def spread(df: DataFrame) -> Column:
    """A last order column for rows whose order among equals does not matter.
    Rows equal in the other order columns share a slice; this lets them part."""
    return F.xxhash64(*[name for name, kind in df.dtypes if "map<" not in kind])


def _slice_count(rows: int, rows_per_slice: int, most: int) -> int:
    slices = ceil(rows / rows_per_slice)
    if slices > most:
        raise ValueError(f"{slices} slices of {rows_per_slice} rows: allow more slices or larger ones")
    return slices


def _sliced(
    df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], slices: int
) -> OrderedRows:
    ranged = df.repartitionByRange(slices, *[F.col(k) for k in keys], *_sort(order))
    labels = F.lit(bucket_labels(df.sparkSession, slices)).cast("array<int>")
    numbered = ranged.withColumn(SLICE, F.get(labels, F.spark_partition_id()))
    rows = written_buckets(numbered, [SLICE], slices, "slices")
    return OrderedRows(rows, keys, order, _spanning_slices(rows, keys))


def bucket_labels(spark: SparkSession, buckets: int) -> list[int]:
    """Rising numbers that hash into different buckets, one for each: numbered from 0 on,
    several slices would share a bucket, and one task would hold them all."""
    tried = buckets
    while True:
        tried *= 2
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets)).alias("b")
        first = spark.range(0, tried, 1, 1).groupBy(bucket).agg(F.min("id").alias("id"))
        labels = sorted(r["id"] for r in first.collect())  # a row a bucket
        if len(labels) == buckets:
            return labels


def _spanning_slices(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Positions and row counts of the slices of keys that span several. Slices
    are consecutive ranges and share at most one key with the slice before, so
    there are fewer than two of these rows per slice."""
    per = rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_slice_rows"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(SLICE)
    counted = per.withColumns(
        {
            "_slice_parts": F.count(F.lit(1)).over(whole),
            "_slice_index": F.row_number().over(upto),
            "_slice_through": F.sum("_slice_rows").over(upto),
        }
    )
    columns = (*keys, SLICE, "_slice_index", "_slice_rows", "_slice_through", "_slice_parts")
    return written(counted.where("_slice_parts > 1").select(*columns), "spanning")


def _sort(order: Sequence[str]) -> list[Column]:
    return [
        F.col(name[:-5]).desc() if name.endswith(" desc") else F.col(name).asc()
        for name in order
    ]


def _flip(name: str) -> str:
    return name[:-5] if name.endswith(" desc") else f"{name} desc"


def _running(kind: str, column: Column) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True)
    return getattr(F, kind)(column)


def _merge(kind: str, earlier: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(earlier + local, earlier, local)
    if kind == "min":
        return F.least(earlier, local)
    if kind == "max":
        return F.greatest(earlier, local)
    return F.coalesce(local, earlier)
