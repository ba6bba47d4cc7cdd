import random
import string

from pyspark.sql import functions as F

from weftline.llm import secrets


def prose(rng, n):
    return [rng.choice(["the", "of", "and", "thing", "value", "because", "internationalization", "counterproductive"]) for _ in range(n)]


def planted(rng, k):
    text = prose(rng, 60)
    kind = k % 4
    if kind == 0:
        text.insert(20, "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)))
    elif kind == 1:
        text.insert(30, "password=" + "".join(rng.choices("0123456789abcdef", k=18)))
    return " ".join(text)


def test_secrets_are_told_from_long_words(documents):
    rng = random.Random(0)
    rows = [(k, planted(rng, k)) for k in range(400)]
    found = secrets.scan_secrets(documents(rows).withColumn("probability", F.lit(1))).collect()
    texts = dict(rows)
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["stop"]] == r["candidate"]
    hit = {r["doc_id"] for r in found if r["is_secret"]}
    assert hit == {k for k in range(400) if k % 4 < 2}
    assert any(r["kind"] == "long_string" and not r["is_secret"] for r in found)


def test_held_out_accuracy(documents):
    rng = random.Random(1)
    docs = documents([(k, planted(rng, k)) for k in range(400)])
    found = secrets.label_findings(secrets.find_candidates(docs, secrets.learn_text(docs)))
    even, odd = found.where("doc_id % 8 < 4"), found.where("doc_id % 8 >= 4")
    judged = secrets.judge(odd, secrets.train_forest(even))
    right = judged.where((F.col("probability") >= 0.5) == (F.col("label") == 1)).count()
    assert right >= 0.95 * odd.count()


def test_masking(documents):
    rng = random.Random(2)
    rows = [(k, planted(rng, k)) for k in range(80)]
    extra = [(90, None), (91, ""), (92, "password=0a1b2c3d4e5f"), (None, "x password=0a1b2c3d4e5f y password=99aabbcc11 z"), (0, rows[0][1])]
    got = secrets.mask_secrets(documents(rows + extra).withColumn("start", F.lit(0)))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "start"]
    texts = {}
    for r in got.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert texts[92] == ["password=[secret]"] and texts[90] == [None] and texts[91] == [""]
    assert texts[None] == ["x password=[secret] y password=[secret] z"] and len(texts[0]) == 2
    assert "AKIA" not in " ".join(t for row in texts.values() for t in row if t)


def test_no_candidates(documents):
    assert secrets.scan_secrets(documents([(1, "plain words")])).count() == 0
    assert secrets.scan_secrets(documents([])).count() == 0
    assert secrets.mask_secrets(documents([(1, "plain words")])).first()["text"] == "plain words"


def test_coverage_reads_the_whole_candidate():
    words = frozenset(secrets._hash([b"password", b"secret"]))

    def plain(candidate):
        at = total = 0
        while at < len(candidate):
            end = next((e for e in range(min(len(candidate), at + 12), at + 2, -1) if candidate[at:e].lower() in ("password", "secret")), at)
            total, at = total + end - at, max(end, at + 1)
        return total / len(candidate)

    long = "x" * 512 + "password" * 64
    assert secrets.covered(long, words) == 0.5
    rng = random.Random(3)
    for _ in range(20):
        made = "".join(rng.choice(["password", "Secret", "x", "pass", "9"]) for _ in range(rng.randrange(1, 400)))
        assert secrets.covered(made, words) == plain(made)
    assert secrets.covered("", words) == 0.0
