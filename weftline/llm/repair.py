"""Repair of conversations by iterative-deepening A*.

Damaged conversations have blank, repeated and cut-off messages, and roles out of
turn. A search over edits (keep, give another role, delete, insert) finds the cheapest
repair: depth first, in the order of the edits' initials, under a cost bound that grows
to the least cost at which the last round was cut off. A table of failed states, kept
over all rounds, says for a row and a role state how much cost was left in vain.
The first accepting path is the cheapest repair, and of equal ones the first in order.

A conversation is searched in blocks of rows, in parallel: for each state at a block's
beginning and end, the same search. The blocks are then chained. Most conversations
are one block; one that holds a third of all rows is many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftline.functions.columns import same
from weftline.llm.registry import query
from weftline.operators.ordered import order_rows
from weftline.scratch import written
from weftline.sources.tables import table

BLOCK = 64
FLUSH_ROWS = 1024
# White space, what ends a sentence, and the costs of edits.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

# States of the roles so far, which have to be (s?(ua)+)?: none, after s, u and a.
START, SYSTEM, USER, ASSISTANT = range(4)
DONE = (START, ASSISTANT)
# From each state: the state that a kept row's initial leads to, and the one that a row
# of a role free to choose leads to.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
CHOSEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# From any state all that another can still reach costs at most this much more: two
# inserted messages, or one and the deletion of a system message.
SLACK = 2 * INSERT


def search(rows: str, start: int = START, ends: tuple[int, ...] = DONE, most: int | None = None) -> tuple[int, str] | None:
    """The least cost, and the edits' initials, that lead from ``start`` over all rows to
    one of ``ends``; None where no repair of at most ``most`` does.

    ``rows`` has two characters a row: the role's initial and the fault's number.
    """
    initials, faults = rows[0::2], [int(f) for f in rows[1::2]]
    n = len(faults)
    # What rows cost at least, whatever the roles around them.
    least = [0] * (n + 1)
    for i in reversed(range(n)):
        lone = DELETE if faults[i] else 0 if initials[i] in "sua" else REROLE
        least[i] = least[i + 1] + lone
    failed: dict[tuple[int, int], int] = {}
    if most is None:
        most = DELETE * n + SLACK
    beyond = most + 1

    def visit(i: int, state: int, left: int) -> str | None:
        """The first accepting path from here that costs no more than ``left``."""
        nonlocal beyond
        lacking = max(least[i], failed.get((i, state), -1) + 1) - left
        if lacking > 0:
            beyond = min(beyond, bound + lacking)
            return None
        if i == n and state in ends:
            return ""
        usable = i < n and faults[i] not in (BLANK, DUPLICATE)
        extra = CUT_OFF if i < n and faults[i] == TRUNCATED else 0
        if i < n and (path := visit(i + 1, state, left - DELETE)) is not None:
            return "D" + path
        if (path := visit(i, CHOSEN[state], left - INSERT)) is not None:
            return "I" + path
        if usable and initials[i] in KEPT[state]:
            if (path := visit(i + 1, KEPT[state][initials[i]], left - extra)) is not None:
                return "K" + path
        if usable and (path := visit(i + 1, CHOSEN[state], left - REROLE - extra)) is not None:
            return "R" + path
        failed[i, state] = max(left, failed.get((i, state), -1))
        return None

    bound = least[0]
    while bound <= most:
        beyond = most + 1
        if (path := visit(0, start, bound)) is not None:
            return bound, path
        bound = beyond
    return None


def summary(rows: str, first: bool) -> list[tuple[int, int, int, str]]:
    """For a block of a longer conversation: start, end, cost and edits of the cheapest
    repairs. Ends that cost ``SLACK`` more than another from the same start are left out."""
    out = []
    for start in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
        cheapest = search(rows, start, (START, SYSTEM, USER, ASSISTANT))
        for end in (START, SYSTEM, USER, ASSISTANT):
            if found := search(rows, start, (end,), cheapest[0] + SLACK):
                out.append((start, end, *found))
    return out


class Chain:
    """The cheapest edits up to a block's end, by state, block after block.

    Of each state it holds the cost, the edits since all states agreed, and the last link
    of (link before, block, start, cost, edits of the block)."""

    def __init__(self) -> None:
        self.states: dict[int, tuple[int, str, tuple | None]] = {START: (0, "", None)}

    def add(self, block: int, ways: list[tuple[int, int, int, str]]) -> None:
        new: dict[int, tuple[int, str, tuple | None]] = {}
        for start, end, cost, edits in ways:
            if start in self.states:
                before, since, link = self.states[start]
                way = (before + cost, since + edits, (link, block, start, cost, edits))
                if end not in new or way[:2] < new[end][:2]:
                    new[end] = way
        best = min(way[0] for way in new.values())
        new = {end: way for end, way in new.items() if way[0] <= best + SLACK}
        agreed = len(commonprefix([way[1] for way in new.values()]))
        self.states = {end: (cost, since[agreed:], link) for end, (cost, since, link) in new.items()}

    def links(self) -> Iterator[tuple[int, int, int, str]]:
        """Block, start, cost and edits of every block of the answer, the last first."""
        ways = []
        for end, (cost, since, link) in self.states.items():
            # What is still to be inserted after the last row.
            rest = search("", end)
            ways.append((cost + rest[0], since + rest[1], link, rest))
        _, _, link, rest = min(ways, key=lambda way: way[:2])
        while link:
            before, block, start, cost, edits = link
            yield block, start, cost + rest[0], edits + rest[1]
            link, rest = before, (0, "")


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults of a careless log, by a checksum of
    conversation and turn: in 20 rows each, one is lost, one is emptied, one loses its
    sentence ends, one comes twice and one is given the role of a user. Null roles and
    texts are one space, and so is a null in what the checksum is of."""
    space = F.lit(" ")
    marked = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(marked) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    hurt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return conversations.where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        hurt.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def find_faults(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, turn, role, text, initial, previous, fault``, written.

    Rows are placed by turn, nulls first, then by role and text; null roles and texts are
    one space. The first that holds of a row is its fault: ``BLANK`` (white space only),
    ``DUPLICATE`` (an earlier row has its role and text), ``TRUNCATED`` (the last character
    but white space ends no sentence). ``previous`` is the role initial of the row before.
    """
    space = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text"))
    conv, turn = (F.col(c).cast("long").alias(c) for c in ("conv_id", "turn"))
    rows = conversations.select(conv, turn, role, text, F.substring(role, 1, 1).alias("initial"))
    ordered = order_rows(rows, keys=["conv_id"], order=["turn", "role", "text"])
    placed = ordered.with_row_number("place").with_shifted(previous=("initial", -1)).result()
    mark = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    placed = written(placed.withColumn("mark", mark), "placed")
    # Counted apart: one message may be repeated any number of times.
    first = placed.groupBy("conv_id", "mark").agg(F.min("place").alias("_first"), F.count("*").alias("_rows"))
    repeated = written(
        first.where("_rows > 1").select(F.col("conv_id").alias("_conv"), F.col("mark").alias("_mark"), "_first"), "repeated"
    )
    seen = same([(placed["conv_id"], repeated["_conv"]), (placed["mark"], repeated["_mark"])])
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(trimmed == "", BLANK)
        .when(F.col("place") > F.col("_first"), DUPLICATE)
        .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    found = placed.join(repeated, seen, "left").withColumn("fault", fault)
    return written(found.drop("mark", "_conv", "_mark", "_first"), "faults")


def plan_repairs(faults: DataFrame) -> DataFrame:
    """``conv_id, block, start, cost, edits``: the edits of each block of ``BLOCK`` rows, the
    role state that it starts in, and what they cost."""
    row = F.struct("place", F.concat("initial", F.col("fault").cast("string")).alias("row"))
    block = F.floor((F.col("place") - 1) / BLOCK).cast("long")
    # A role may be empty; its row keeps two characters.
    filled = faults.withColumn("initial", F.when(F.col("initial") == "", " ").otherwise(F.col("initial")))
    blocks = filled.groupBy("conv_id", block.alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["row"]), "").alias("rows")
    )
    ways_type = "array<struct<start:int,end:int,cost:long,edits:string>>"
    ways_arrow = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                if not number and len(rows) < 2 * BLOCK:
                    ways = [(START, ASSISTANT, *search(rows))]  # the whole conversation
                else:
                    ways = summary(rows, not number)
                out.append([dict(zip(("start", "end", "cost", "edits"), way)) for way in ways])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("block"), pa.array(out, ways_arrow)], names=["conv_id", "block", "ways"]
            )

    names = ("conv_id", "block", "start", "cost", "edits")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation: object = object()
        held: Chain | None = None
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for conv, block, ways in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != conversation or held is None:
                    if held is not None:
                        out += [(conversation, *link) for link in held.links()]
                    conversation, held = conv, Chain()
                held.add(block, [(w["start"], w["end"], w["cost"], w["edits"]) for w in ways])
            if len(out) >= FLUSH_ROWS:
                yield batch_of()
                out = []
        if held is not None:
            out += [(conversation, *link) for link in held.links()]
        yield batch_of()

    solved = blocks.mapInArrow(solve, f"conv_id long, block long, ways {ways_type}")
    dealt = solved.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.mapInArrow(chain, "conv_id long, block long, start int, cost long, edits string")


REPAIRED = "conv_id long, step long, edit string, role string, text string, cost long"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64())])


def repair_conversations(faults: DataFrame) -> DataFrame:
    """A row an edit, of all that ``find_faults`` has found: ``conv_id, step, edit, role,
    text, cost``. ``step`` counts a conversation's edits from 1; ``edit`` is the initial of
    Keep, Rerole, Delete or Insert; role and text are those after it (of a deleted row, its
    own). The rows that are not deleted, in order, are the repaired conversation.

    Any role whose initial is not s, u or a can only be deleted or given another. A
    conversation's rows stream through one task, which holds a block's edits only.
    """
    plans = plan_repairs(faults).select(
        "conv_id", (F.col("block") * BLOCK + 1).alias("place"), F.lit(0).alias("kind"), "start", "edits",
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("fault"),
    )
    rows = faults.select(
        "conv_id", "place", F.lit(1).alias("kind"), F.lit(0).alias("start"), F.lit("").alias("edits"), "role", "text", "fault"
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conversation: object = object()
        step = state = at = 0
        edits = ""
        for batch in batches:
            out: list[tuple] = []

            def insert() -> None:
                """The inserted messages that come next."""
                nonlocal step, state, at
                while edits[at : at + 1] == "I":
                    step, state, at = step + 1, CHOSEN[state], at + 1
                    out.append((conversation, step, "I", NAMES[state], "", INSERT))

            for conv, kind, start, plan, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if conv != conversation:
                        step = 0
                    conversation, state, edits, at = conv, start, plan, 0
                    insert()
                    continue
                edit, step, at = edits[at], step + 1, at + 1
                cost = 0
                if edit == "D":
                    cost = DELETE
                else:
                    cost = CUT_OFF if fault == TRUNCATED else 0
                    if edit == "R":
                        state = CHOSEN[state]
                        role, cost = NAMES[state], cost + REROLE
                    else:
                        state = KEPT[state][role[0]]
                out.append((conv, step, edit, role, text, cost))
                insert()
            columns = list(zip(*out)) if out else [[] for _ in _REPAIRED]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPAIRED)], schema=_REPAIRED)

    return (
        plans.unionByName(rows)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "kind")
        .select("conv_id", "kind", "start", "edits", "role", "text", "fault")
        .mapInArrow(apply, REPAIRED)
    )


_DIGEST = StructType([StructField("conv_id", LongType()), StructField("cost", LongType()), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, cost, audit, repaired_sha256`` of each repaired conversation: all its edits'
    initials, and the hash of its messages as ``role:text``, a line each."""
    names, kinds = _DIGEST.names, (pa.int64(), pa.int64(), pa.string(), pa.string())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: list | None = None
        for batch in batches:
            for conv, edit, role, text, cost in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state:
                        out.append((state[0], state[1], "".join(state[2]), state[3].hexdigest()))
                    state = [conv, 0, [], hashlib.sha256(), ""]
                state[1] += cost
                state[2].append(edit)
                if edit != "D":
                    state[3].update(f"{state[4]}{role}:{text}".encode())
                    state[4] = "\n"
            if len(out) >= FLUSH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if state:
            out.append((state[0], state[1], "".join(state[2]), state[3].hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "step")
    return dealt.select("conv_id", "edit", "role", "text", "cost").mapInArrow(digest, _DIGEST)


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """A row for every ``conv_id`` of ``conversations`` (null is one of them): what is found
    in its damaged rows, and its repair. See ``damage``, ``find_faults`` and
    ``repair_conversations``. Rows that repeat count each; where no row is left after the
    damage, counts are 0 and the texts those of nothing. Other columns are not read."""
    faults = find_faults(damage(conversations))

    def rows_with(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    pair = F.concat("previous", "initial")
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    facts = faults.groupBy("conv_id").agg(
        span.alias("gaps"),
        rows_with(F.col("fault") == BLANK).alias("blank"),
        rows_with(F.col("fault") == DUPLICATE).alias("duplicate"),
        rows_with(F.col("fault") == TRUNCATED).alias("truncated"),
        rows_with((F.col("place") > 1) & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )
    repaired = digests(repair_conversations(faults))
    result = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part, label in ((facts, "facts"), (repaired, "repairs")):
        part = written(part.withColumnRenamed("conv_id", "_conv"), label)
        result = result.join(part, same([(result["conv_id"], part["_conv"])]), "left").drop("_conv")
    nothing = hashlib.sha256().hexdigest()
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    filled = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(nothing))}
    return result.withColumns({**zero, **filled})


@query()
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, damaged, audited and repaired."""
    return audit_conversations(table(spark, folder, "conversations"))
