"""Chat formatting against a plain version, its round trip and its edge cases."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lifegrid.llm import chat

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
ODD = ["", "plain", "\\", "a\\", "\\\\x", "</turn>", "\n</turn>\n", "\\</turn>", "<turn user>\nhi\n</turn>\n", "<turn ", "x\n", "\\n", "ä日😀", "> <", None]
ROLES = ["user", "assistant", "system", "", None, "a>b", "a>\nb\\", "<turn x>", "Assistant"]


def plain(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    esc = lambda t: t.replace("\\", "\\\\").replace("<turn ", "\\<turn ").replace("</turn>", "\\</turn>")
    out, examples = {}, {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0], r[1] or 0, r[2], r[3]))
        text, n = "", 0
        examples[conv] = []
        for i, (_, _, role, body) in enumerate(turns):
            text += "<turn " + esc(role).replace(">", "\\>").replace("\n", "\\\n") + ">\n"
            lo = len(text)
            text += esc(body)
            hi = len(text)
            text += "\n</turn>\n"
            if role == "assistant":
                examples[conv].append((text, text[lo:hi]))
            elif i == len(turns) - 1:
                examples[conv].append((text, ""))
        loss = "".join(b for _, _, r, b in turns if r == "assistant")
        out[conv] = (len(turns), H("".join(f"{r}\n{b}\n" for _, _, r, b in turns)), len(loss), H(loss), sum(len(t) for t, _ in examples[conv]))
    return out, examples


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "no"), (2, 5, "user", "unanswered"), (3, 1, "assistant", None), (3, 1, "assistant", None),
    (None, 1, "user", "no conversation"), (None, None, "assistant", "first"), (4, None, None, None), (5, 2, "assistant", "b"), (5, 2, "assistant", "a"), (5, 2, "user", "c"), (6, 1, "assistant", "y" * 200_000 + "</turn>"),
    *[(7, i, ROLES[i % len(ROLES)], ODD[i % len(ODD)]) for i in range(300)], *[(8, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(2000)],
]
SCHEMA = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="\\</turn >\nab", max_size=30), st.text(alphabet="\\</turn >\nab", max_size=12))
@settings(max_examples=400, deadline=None)
def test_parse_is_the_inverse(text, role):
    esc = lambda t: t.replace("\\", "\\\\").replace("<turn ", "\\<turn ").replace("</turn>", "\\</turn>")
    piece = "<turn " + esc(role).replace(">", "\\>").replace("\n", "\\\n") + ">\n" + esc(text) + chat.END
    assert chat.parse_turn(piece) == (role, text)
    assert (piece + piece).count(chat.END) == 2


def test_chats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as g", "2 as seq", "'x' as piece", "3 as part").repartition(7)
    written = chat.format_chats(df)
    want, examples = plain(ROWS)
    assert {r[0]: tuple(r[1:]) for r in chat.read_chats(written).collect()} == want
    texts = {}
    for r in written.texts(written.examples.filter("g <> '=8'")).collect():
        texts.setdefault(r["conv_id"], {})[r["example"]] = (r["text"], r["text"][r["loss_start"] : r["loss_end"]])
    del examples[8]
    assert {c: [x[i] for i in range(len(x))] for c, x in texts.items()} == examples


def test_one_reply_is_learnt_in_each_example(spark):
    df = spark.createDataFrame(ROWS[:4], SCHEMA)
    rows = sorted(chat.format_chats(df).texts().collect(), key=lambda r: r["example"])
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in rows] == ["yes", "no"]
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[1]["text"].count("<turn ") == 4


def test_a_long_conversation_is_spread(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.lit("t" * 50).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = chat.format_chats(df).turns
        assert len(turns.select(F.input_file_name().alias("f")).groupBy("f").count().collect()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    written = chat.format_chats(spark.createDataFrame([], SCHEMA))
    assert chat.read_chats(written).count() == 0 and written.examples.count() == 0 and written.texts().count() == 0
