import hashlib
import random

import pytest

from weftline.llm import chat

TEMPLATE = chat.Template()
TRAPS = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[INST", "<", "<s", "<<s>", "<<SYS>>", "<</SYS>>x\\", "<|role|> a <|text|> b", "a \\", " ", "", "été\n漢 [/INST]"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "<s> odd\\"])
@pytest.mark.parametrize("text", TRAPS)
def test_every_text_reads_back(role, text):
    formatted, start, end = TEMPLATE.render(role, text)
    assert [(r, t) for r, t, _, _ in TEMPLATE.read(formatted)] == [(role, text)]
    assert TEMPLATE.unescape(formatted[start:end]) == text
    both = formatted + TEMPLATE.render("assistant", text[::-1])[0]
    assert [t for _, t, _, _ in TEMPLATE.read(both)] == [text, text[::-1]]


def folded(events):
    """The fold in the order of the log, one conversation."""
    messages = []  # [message, role, text, alive, seq]
    for seq, kind, number, role, text in sorted(events, key=lambda e: (e[0], e[2], e[3], e[4])):
        mine = next((m for m in reversed(messages) if m[0] == number), None)
        if kind == "message":
            messages.append([number, role, text, True, seq])
        elif mine is None:
            continue
        elif kind == "delta":
            mine[2] += text
        elif kind == "edit":
            mine[2] = text
        elif kind == "regenerate":
            mine[2] = ""
            for m in messages:
                if m is not mine and m[0] >= number:
                    m[3] = False
    return [(n, r, t) for n, r, t, alive, _ in messages if alive]


@pytest.mark.parametrize("seed", range(4))
def test_folding_equals_the_log_in_order(spark, seed):
    rng = random.Random(seed)
    rows, wanted = [], {}
    for conv in range(25):
        events, open_messages = [], []
        for seq in range(rng.randrange(1, 14)):
            if not open_messages or rng.random() < 0.4:
                open_messages.append(len(open_messages))
                events.append((seq, "message", open_messages[-1], rng.choice(["user", "assistant"]), f"m{seq} "))
            else:
                kind = rng.choice(["delta", "delta", "edit", "regenerate", "noise"])
                events.append((seq, kind, rng.choice(open_messages), "", f"{kind[0]}{seq} "))
        wanted[conv] = folded(events)
        rows += [(conv, *e) for e in events]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {}
    for r in sorted(chat.fold_events(log).collect(), key=lambda r: (r["conv_id"], r["seq"])):
        got.setdefault(r["conv_id"], []).append((r["message"], r["role"], r["text"]))
    assert got == {k: v for k, v in wanted.items() if v}


def test_query_equals_plain_digests(spark, small):
    turns = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    turns[-7] = [(0, "user", TRAPS[0]), (1, "assistant", TRAPS[0])]
    got = {r["conv_id"]: r for r in chat.op4_chat_events(spark, small).collect()}
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        text = "".join(f"{role}\n{t}\n" for _, role, t in rows)
        learned = "".join(t for _, role, t in rows if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(rows) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(TEMPLATE.render(role, t)[0]) for _, role, t in rows)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, kind string"
    rows = [(1, 0, "user", None, "x"), (1, 1, None, "t", "x"), (None, 0, "assistant", "a", "x"), (2, 0, "user", "a", "x"), (2, 0, "user", "a", "x")]
    folded_rows = chat.fold_events(chat.events_of(spark.createDataFrame(rows, schema)))
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.render_messages(folded_rows)).collect()}
    assert got == {1: 2, None: 1, 2: 2}
    empty = chat.events_of(spark.createDataFrame([], schema))
    assert chat.read_back(chat.render_messages(chat.fold_events(empty))).count() == 0


def test_repeated_rows_and_rows_without_a_turn_keep_their_texts(spark):
    rows = [(1, 0, "user", "q")] + [(1, 1, "assistant", "abcd")] * 3 + [(1, 1, "assistant", "abXY"), (1, 2, "assistant", None)]
    rows += [(2, None, "assistant", "zebra apple!"), (2, None, "assistant", "b a"), (2, 0, None, "x"), (None, None, "assistant", "zebra apple!")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.render_messages(chat.fold_events(chat.events_of(table)))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for *_, r, x in mine)
        learned = "".join(x for *_, r, x in mine if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(text.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
