import hashlib
import re

import pytest

from weftline.llm import infill

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def units_of(text):
    """The units from left to right, character by character."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in SPACES:
            end += 1
        while end < len(text) and text[end] not in SPACES:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def plain_version(doc_id, text):
    text = text or ""
    units = units_of(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, " ", "a", " a ", "\x0b\x0ca\tb\r\nc", "été 漢字 😀 x", "   ", "x <P> y", "<M>", "<S", "P>", "a\x00b \x1f c", "<<P >S>< ", "w " * 50_000, "z" * 200_000]


def test_equals_the_plain_version(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 12)] + [(None, "one two three"), (3, "again"), (3, "again"), (-5, "a b c d")]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = got.withColumn("back", infill.restored(got["form"], got["output"])).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    wanted = [(d, t, *plain_version(d, t), t or "") for d, t in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(wanted, key=key)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_query_equals_the_plain_version(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = infill.op11_fill_in_middle(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, prefix, middle, output = plain_version(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_other_sentinels_columns_and_empty_tables(spark):
    marks = infill.Sentinels("[[pre.]+", "[[suf.]+", "[[mid.]+")
    rows = [(k, f"word {k} and more \\E of it", k, "kept", None) for k in range(60)]
    table = spark.createDataFrame(rows, "key long, body string, n long, other string, output string")
    got = infill.fill_in_middle(table, id_column="key", text_column="body", percent=100, spm_percent=50, sentinels=marks)
    assert got.columns == ["key", "body", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = infill.restored(got["form"], got["output"], marks)
    assert got.where(back != got["body"]).count() == 0
    assert got.where("form = 'plain'").count() == 0 and got.where("n <> 7 OR other <> 'kept'").count() == 0
    assert infill.fill_in_middle(table.limit(0), id_column="key", text_column="body").count() == 0


@pytest.mark.parametrize("marks", [("aa", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("<P>", "P>y", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>", "<M>")])
def test_sentinels_that_can_be_confused_are_refused(marks):
    with pytest.raises(ValueError):
        infill.Sentinels(*marks)
