import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


@pytest.mark.parametrize("bits", [24, 2])
def test_facts_equal_the_definition(documents, monkeypatch, bits):
    # With two bits of position every text of more than four words takes the whole sort.
    monkeypatch.setattr(quality, "POSITION_BITS", bits)
    rng = random.Random(4)
    words = ["a", "b", "été", "x#", "$", "漢字"]
    rows = [
        (k, "".join(w + rng.choice([" ", "\n", "\t", "\r\n", " \x0b"]) for w in rng.choices(words[: rng.choice([2, 6])], k=rng.randrange(40))))
        for k in range(60)
    ]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "a a a a"), (104, "a b"), (None, "a b c a b c"), (5, "again")]
    rows += [(105, " ".join(f"w{k % 5000}" for k in range(30_000)))]
    got = quality.quality_facts(documents(rows).withColumn("words", F.lit(1)))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = sorted((str(r["doc_id"]), *(r[c] for c in columns), r["base_failed"]) for r in got.collect())
    wanted = []
    for doc, text in rows:
        f = plain(text)
        wanted.append((str(doc), *f, f[0] < 50 or 100 * f[4] > 50 * f[0]))
    assert found == sorted(wanted)


def body(rng):
    return "\n".join(" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) + f" {rng.random()}" for _ in range(8))


def test_lines_above_the_limit_go_but_for_the_first(documents):
    rng = random.Random(1)
    banner = "Subscribe to our letter, now!"
    rows = [(k, body(rng) + "\n" + banner.upper() + "\n", "host1") for k in range(10)]
    rows += [(20, "\n".join([banner] * 60), "host1"), (21, "\n".join([banner] * 60), "host2"), (22, body(rng), None)]
    got = {r["doc_id"]: r for r in quality.judge_documents(documents(rows), min_documents=5).collect()}
    assert [got[k]["n_removed_words"] for k in (0, 1, 9, 20, 21, 22)] == [0, 5, 5, 300, 0, 0]
    assert all(got[k]["kept"] for k in range(10)) and got[22]["kept"] and not got[20]["kept"]
    texts = {r["doc_id"]: r["text"] for r in quality.keep_good_documents(documents(rows), min_documents=5).collect()}
    assert set(texts) == {*range(10), 22}
    assert texts[0] == rows[0][1] and texts[3] == rows[3][1].replace(banner.upper() + "\n", "")


def test_repeated_rows_are_one_document_and_judged_apart(documents):
    rng = random.Random(2)
    line = "Subscribe to our letter, now!"
    # One document of many rows and one other hold the line: two documents.
    rows = [(1, line + "\n" + body(rng), "h")] * 25 + [(2, line + "\n" + body(rng), "h"), (3, body(rng), "h")]
    got = quality.judge_documents(documents(rows))
    assert got.where("n_removed_words > 0").count() == 0 and got.count() == len(rows)
    # Nine documents hold it; of one id one row is nothing else, one does not have it.
    good = body(rng)
    rows = [(k, body(rng) + "\n" + line, "h") for k in range(8)] + [(9, line, "h"), (9, good, "h"), (9, good + "\n" + line, "h"), (9, good + "\n" + line, "h"), (None, good, "h"), (None, good + "\n" + line, "h")]
    got = sorted((r["n_words"], r["n_removed_words"], r["kept"]) for r in quality.judge_documents(documents(rows), min_documents=5).where("doc_id = 9 OR doc_id IS NULL").collect())
    assert got == [(5, 5, False), (80, 0, True), (80, 0, True), (85, 5, True), (85, 5, True), (85, 5, True)]
    kept = quality.keep_good_documents(documents(rows), min_documents=5).where("doc_id = 9 OR doc_id IS NULL").collect()
    assert [r["text"] for r in kept] == [good] * 5


def test_empty_table(documents):
    assert quality.judge_documents(documents([])).count() == 0
    assert quality.keep_good_documents(documents([])).count() == 0
