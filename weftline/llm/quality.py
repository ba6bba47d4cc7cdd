"""Quality rules: lines that many documents of a host share are removed, and
documents that are left with too little are rejected.

DataFrame functions only. A line is compared by the 64-bit hash of its host and its
normalised form, so the counts cost one row a distinct line and document, reduced
before the exchange; a line that a third of all documents hold is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.registry import query
from weftline.scratch import written
from weftline.sources.tables import table

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for null or blank texts."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)


def plain_lines(text: Column) -> Column:
    """All lines in the form in which they are compared, one for each line of the text:
    lower case, no punctuation, runs of spaces cut to their first."""
    plain = F.regexp_replace(
        F.lower(F.coalesce(text, F.lit(""))), r"\p{Punct}+|(?<=[ \t\x0B\f\r])[ \t\x0B\f\r]+", ""
    )
    return F.transform(F.split(plain, "\n"), lambda line: F.btrim(line, F.lit(SPACES)))


def line_key(host: Column, plain: Column) -> Column:
    """Hash of a line within its host; a null host is a host of its own."""
    return F.xxhash64(F.xxhash64(F.coalesce(host, F.lit(""))), plain)


# Fixed value: bits of a packed window that hold its position.
POSITION_BITS = 24


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words that a text holds twice or more.

    Two steps, both within the row, so nothing is exchanged and the work is n log n.
    Hashes cut short, packed with their positions into one long, are sorted; windows
    without an equal neighbour are unique. The few that are left are sorted by their
    whole hash. Texts whose positions do not fit go to the second step at once.
    """
    starts = F.size(words) - width + 1
    whole = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
    mask = (1 << POSITION_BITS) - 1
    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), starts - 1),
            lambda i: F.shiftleft(whole(i), POSITION_BITS).bitwiseOR(i.cast("long")),
        )
    )

    def perhaps_twice(ordered: Column) -> Column:
        cut = lambda v: F.shiftright(v, POSITION_BITS)
        near = F.filter(
            ordered,
            lambda v, k: (cut(v) == cut(F.get(ordered, k - 1))) | (cut(v) == cut(F.get(ordered, k + 1))),
        )
        return F.transform(near, lambda v: v.bitwiseAND(F.lit(mask)).cast("int"))

    def covered(ordered: Column) -> Column:
        hash_at = lambda k: F.get(ordered, k)["h"]  # noqa: E731  null beyond the ends
        twice = F.filter(
            F.transform(
                ordered,
                lambda window, k: F.when(
                    window["h"].eqNullSafe(hash_at(k - 1)) | window["h"].eqNullSafe(hash_at(k + 1)), window["i"]
                ),
            ),
            lambda start: start.isNotNull(),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda s: F.array(*[s + k for k in range(width)])))))

    # A one-element array binds a value to a name, so that it is made once a row.
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    left = F.when(starts > mask, F.sequence(F.lit(0), starts - 1)).otherwise(bind(packed, perhaps_twice))
    sorted_left = lambda i: F.sort_array(F.transform(i, lambda p: F.struct(whole(p).alias("h"), p.alias("i"))))
    found = bind(left, lambda i: F.when(F.size(i) > 0, bind(sorted_left(i), covered)).otherwise(F.lit(0)))
    return F.when(starts > 1, found).otherwise(F.lit(0))


def row_mark(host: Column, text: Column) -> Column:
    """Tells apart the rows of one id; rows equal in host and text are judged alike."""
    return F.xxhash64(F.coalesce(host, F.lit("")), F.coalesce(text, F.lit("")))


def repeated_ids(documents: DataFrame) -> DataFrame:
    """``_again, repeated``: the ids that more than one row has, written; mostly none."""
    ids = documents.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    return written(ids.select(F.col("doc_id").alias("_again"), F.lit(True).alias("repeated")), "repeated-ids")


def count_documents(rows: DataFrame, keys: list[str], **smallest: str) -> DataFrame:
    """Distinct ids (null is one) per ``keys`` as ``n``, and the smallest value of columns.

    A row is a document where its id is its own, so counts are reduced in every task. Only
    rows of repeated ids (``repeated``, where there is such a column) are made distinct first.
    """
    least = [F.min(column).alias(name) for name, column in smallest.items()]
    if "repeated" not in rows.columns:
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), *least)
    own = F.when(F.col("repeated"), F.struct("doc_id"))
    apart = rows.groupBy(*keys, own.alias("own")).agg(F.count("*").alias("n"), *least)
    documents = F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(1)).alias("n")
    return apart.groupBy(*keys).agg(documents, *[F.min(name).alias(name) for name in smallest])


def limited_lines(
    documents: DataFrame, *, host: str = "source", min_documents: int = 20, share: float = 0.002
) -> DataFrame:
    """Lines held by more documents of a host than the limit allows.

    The limit is ``min_documents`` or ``share`` of the host's documents, whichever is
    more. Documents are ids: rows that repeat one count once. Returns ``line`` (the key)
    and ``first_doc``, the smallest id that holds it. Written once, so that joins with it
    are planned by its true size.
    """
    host_key = F.xxhash64(F.coalesce(F.col(host), F.lit("")))
    rows = documents.select("doc_id", host_key.alias("host_key"), "text")
    again = repeated_ids(documents)
    marks = ["doc_id", "host_key"]
    if not again.isEmpty():
        rows = rows.join(again, rows["doc_id"].eqNullSafe(again["_again"]), "left").drop("_again")
        marks.append("repeated")
    hosts = count_documents(rows.drop("text"), ["host_key"]).select(
        "host_key", F.greatest(F.lit(min_documents), F.ceil(F.col("n") * F.lit(share))).alias("limit")
    )
    held = F.array_distinct(F.filter(plain_lines(F.col("text")), lambda line: F.length(line) > 0))
    lines = rows.select(*marks, F.explode(held).alias("plain"))
    lines = lines.select(*marks, F.xxhash64("host_key", "plain").alias("line"))
    counted = count_documents(lines, ["line"], first_doc="doc_id", host_key="host_key")
    counted = counted.where(F.col("n") > min_documents)
    over = counted.join(hosts, "host_key").where(F.col("n") > F.col("limit"))
    return written(over.select("line", "first_doc"), "lines")


def removed_lines(documents: DataFrame, limited: DataFrame, *, host: str = "source") -> DataFrame:
    """One row for each line that goes: ``doc_id, mark, place, line, words``. The document
    with the smallest id keeps the line, so that no content leaves the host altogether."""
    pairs = F.zip_with(
        F.split(F.coalesce("text", F.lit("")), "\n"),
        plain_lines(F.col("text")),
        lambda line, plain: F.struct(line.alias("text"), plain.alias("plain")),
    )
    mark = row_mark(F.col(host), F.col("text"))
    lines = (
        documents.select("doc_id", mark.alias("mark"), F.col(host).alias("host"), F.posexplode(pairs).alias("place", "l"))
        .where(F.length("l.plain") > 0)
        .select(
            "doc_id", "mark", "place",
            line_key(F.col("host"), F.col("l.plain")).alias("line"),
            F.regexp_count("l.text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        )
    )
    return lines.join(limited, "line").where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).drop("first_doc")


def quality_facts(documents: DataFrame, *, host: str = "source") -> DataFrame:
    """Word and line counts of every text with the verdict that they allow by themselves,
    and the row's ``mark``."""
    text = F.coalesce("text", F.lit(""))
    mark = row_mark(F.col(host), F.col("text"))
    words = documents.select("doc_id", mark.alias("mark"), text.alias("text"), words_of(text).alias("words"))
    lines = lines_of(F.col("text"))
    return words.select(
        "doc_id",
        "mark",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).cast("long").alias("n_repeat_words"),
    ).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def judge_documents(
    documents: DataFrame,
    *,
    host: str = "source",
    min_documents: int = 20,
    share: float = 0.002,
    min_left: float = 0.5,
    limited: DataFrame | None = None,
) -> DataFrame:
    """One row a row: the facts, ``mark``, ``n_removed_words`` and ``kept``.

    A document is kept unless its base rules fail or removing lines above the limit
    leaves less than ``min_left`` of its words. Null and empty texts have no words and
    fail. Rows that repeat an id are judged each by its own host and text, and count as one
    document towards the limits. A null host is a host of its own, a null id an id. No rows
    in, no rows out; other columns of the input are not read. ``limited`` may hand over
    the lines above the limit where they are known.
    """
    if limited is None:
        limited = limited_lines(documents, host=host, min_documents=min_documents, share=share)
    # Rows equal in id, host and text lose the same lines; each line is counted once for them.
    lost = removed_lines(documents, limited, host=host).groupBy("doc_id", "mark", "place").agg(F.first("words").alias("words"))
    removed = (
        lost.groupBy("doc_id", "mark")
        .agg(F.sum("words").alias("n_removed_words"))
        .withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})
    )
    # Written, so that a filter on the verdict is not pushed into the counting, where it
    # would cut the words of a text again for each of them.
    facts = written(quality_facts(documents, host=host), "facts")
    same_row = facts["doc_id"].eqNullSafe(removed["_id"]) & (facts["mark"] == removed["_mark"])
    judged = facts.join(removed, same_row, "left").drop("_id", "_mark")
    left = F.col("n_words") - F.coalesce("n_removed_words", F.lit(0))
    return judged.withColumns(
        {
            "n_removed_words": F.coalesce("n_removed_words", F.lit(0)).cast("long"),
            "kept": ~F.col("base_failed") & (left >= min_left * F.col("n_words")),
        }
    )


def keep_good_documents(
    documents: DataFrame, *, host: str = "source", min_documents: int = 20, share: float = 0.002, min_left: float = 0.5
) -> DataFrame:
    """The kept documents, all columns, with the lines above the limit cut from their
    texts and ``n_chars``, if there is such a column, brought up to date. Every row goes or
    stays by its own verdict, whatever others have its id."""
    limited = limited_lines(documents, host=host, min_documents=min_documents, share=share)
    verdicts = judge_documents(documents, host=host, min_left=min_left, limited=limited)
    cut = removed_lines(documents, limited, host=host).groupBy("doc_id", "mark").agg(F.collect_set("line").alias("_cut"))
    cut = cut.withColumnsRenamed({"doc_id": "_of", "mark": "_of_mark"})
    stay = verdicts.where("kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    kept = stay.join(cut, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_mark") == F.col("_of_mark")), "left")
    kept = written(kept.drop("_of", "_of_mark"), "kept")
    mark = row_mark(documents[host], documents["text"])
    rows = documents.join(kept, documents["doc_id"].eqNullSafe(kept["_id"]) & (mark == kept["_mark"]))
    pairs = F.zip_with(
        F.split("text", "\n"),
        plain_lines(F.col("text")),
        lambda line, plain: F.when(
            (F.length(plain) == 0) | ~F.array_contains("_cut", line_key(F.col(host), plain)), line
        ),
    )
    shorter = F.array_join(F.filter(pairs, lambda line: line.isNotNull()), "\n")
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(shorter)
    result = rows.withColumn("text", text)
    if "n_chars" in documents.columns:
        result = result.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return result.select(*documents.columns)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), raw_lines AS (
  SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT doc_id, host, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
    trim(regexp_replace(regexp_replace(lower(line), '([ \t\x0B\f\r])[ \t\x0B\f\r]+', '\1', 'g'), '[[:punct:]]+', '', 'g'),
      ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS plain
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), limits AS (
  SELECT host, greatest(20, ceil(count(*) * 0.002)) AS most FROM d GROUP BY host
), limited AS (
  SELECT l.host, plain, min(doc_id) AS first_doc
  FROM lines l JOIN limits USING (host) WHERE plain <> '' GROUP BY l.host, plain, most
  HAVING count(DISTINCT doc_id) > most
), removed AS (
  SELECT doc_id, sum(words) AS n FROM lines JOIN limited USING (host, plain)
  WHERE doc_id <> first_doc GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), facts AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM facts
"""


@query(OP6_SQL)
def op6_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its counts and verdict; the source is the host."""
    return judge_documents(table(spark, folder, "documents")).drop("mark")
