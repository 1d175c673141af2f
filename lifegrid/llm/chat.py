"""Chat formatting: every assistant turn becomes an example of its own.

A turn is written as

    <turn ROLE>
    TEXT
    </turn>

In texts a backslash stands before each backslash, ``<turn `` and ``</turn>``; in roles also before ``>`` and line
ends. So an unescaped ``</turn>`` is never part of a text, and taking one backslash from each pair gives the text back.

An example is a prefix of its conversation's formatted text that ends with the reply to be learnt; its loss mask is one span, the escaped
text of that reply. All examples of a conversation are prefixes of one text, so this is written once, turn by turn, and an example is a row of
offsets into it: a conversation of n turns costs n rows, not the n * n / 2 of repeated contexts, and a conversation of any
length is spread over tasks. Turns are numbered and placed by ranges of (conversation, turn): each range counts, a running sum over
the ranges' sums gives each its base.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_side, table

OPEN, CLOSE, END = "<turn ", "</turn>", "\n</turn>\n"
REPLY = "assistant"
#: What the query formats beside the table.
EXTRA = (-7, [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")])


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


def escaped_role(role: Column) -> Column:
    out = escaped(role)
    for mark in (">", "\n"):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return out


_PAIR = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.DOTALL)


def unescaped(text: str) -> str:
    return _PAIR.sub(r"\1", text) if "\\" in text else text


def parse_turn(piece: str) -> tuple[str, str]:
    """Role and text of a written turn."""
    head = _HEAD.match(piece)
    if head is None or not piece.endswith(END, head.end() - 1):
        raise ValueError("not a written turn")
    return unescaped(head[1]), unescaped(piece[head.end() : len(piece) - len(END)])


class Chat:
    """Written conversations.

    ``turns``: g, conv_id, seq (from 0), start (code points of the conversation before), piece (the written turn).
    ``examples``: g, conv_id, example (from 0), n_turns, chars, loss_start, loss_end: the first ``chars`` code points of the
    conversation, ``n_turns`` turns, of which [loss_start, loss_end) is learnt. Turns behind the last reply, and conversations
    without one, are in a last example that learns nothing. g is conv_id as text behind '=', '' for null.
    """

    def __init__(self, turns: DataFrame, examples: DataFrame):
        self.turns, self.examples = turns, examples

    def texts(self, wanted: DataFrame | None = None) -> DataFrame:
        """conv_id, example, text, loss_start, loss_end of the wanted examples (g, example; all by default) as training rows.
        Contexts are repeated here, as such rows must."""
        chosen = self.examples if wanted is None else self.examples.join(wanted.select("g", "example"), ["g", "example"], "left_semi")
        parts = chosen.join(self.turns.select("g", "seq", "piece"), "g").filter("seq < n_turns")
        pieces = F.array_sort(F.collect_list(F.struct("seq", "piece")))
        out = parts.groupBy("g", "conv_id", "example", "loss_start", "loss_end").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"))
        return out.select("conv_id", "example", "text", "loss_start", "loss_end")


def format_chats(rows: DataFrame) -> Chat:
    """Writes conversations (conv_id, turn, role, text; other columns aren't read).

    Turns ascend by turn, nulls first, then by role and text; repeated rows are turns each. A null role or text is empty. Rows of
    null conv_id are one conversation. An empty table gives empty tables. A reply is a turn whose role is exactly 'assistant'.
    """
    scratch = Scratch(rows.sparkSession, "chats")
    named = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("g"), "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    ranges = named.repartitionByRange("g", "turn", "role", "text").sortWithinPartitions("g", "turn", "role", "text")
    head, body = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(">\n")), escaped(F.col("text"))
    cut = ranges.select("g", "conv_id", F.spark_partition_id().alias("part"), (F.col("role") == REPLY).cast("int").alias("reply"), head.alias("head"), body.alias("body"))
    cut = cut.select("g", "conv_id", "part", "reply", F.char_length("head").cast("long").alias("lo"), F.char_length("body").cast("long").alias("size"), F.concat("head", "body", F.lit(END)).alias("piece"))
    cut = cut.withColumn("chars", F.col("lo") + F.col("size") + len(END))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """seq, start and the replies before, within a range's part of each conversation."""
        last, seq, start, replies = None, 0, 0, 0
        for b in batches:
            out: tuple[list[int], list[int], list[int]] = ([], [], [])
            for g, reply, chars in zip(*(b.column(c).to_pylist() for c in ("g", "reply", "chars")), strict=True):
                if g != last:
                    last, seq, start, replies = g, 0, 0, 0
                for to, x in zip(out, (seq, start, replies), strict=True):
                    to.append(x)
                seq, start, replies = seq + 1, start + chars, replies + reply
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in out)], [*b.schema.names, "seq", "start", "before"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", seq long, start long, before long"
    placed = scratch.put(cut.mapInArrow(place, schema), "ranges")
    key = Window.partitionBy("g")
    runs = placed.groupBy("g", "part").agg(F.count("*").alias("n"), F.sum("chars").alias("c"), F.sum("reply").cast("long").alias("r"))
    bases = runs.select("g", "part", *[(F.sum(x).over(key.orderBy("part")) - F.col(x)).alias(f"{x}0") for x in "ncr"], F.sum("n").over(key).alias("whole"))
    whole = placed.join(small_side(scratch.put(bases, "bases")), ["g", "part"])
    whole = whole.withColumns({"seq": F.col("seq") + F.col("n0"), "start": F.col("start") + F.col("c0"), "before": F.col("before") + F.col("r0")})
    end = F.col("start") + F.col("chars")
    examples = whole.filter("reply = 1 or seq = whole - 1").select(
        "g", "conv_id", F.col("before").alias("example"), (F.col("seq") + 1).alias("n_turns"), end.alias("chars"),
        F.when(F.col("reply") == 1, F.col("start") + F.col("lo")).otherwise(end).alias("loss_start"), F.when(F.col("reply") == 1, F.col("start") + F.col("lo") + F.col("size")).otherwise(end).alias("loss_end"),
    )
    return Chat(scratch.put(whole.select("g", "conv_id", "seq", "start", "piece"), "turns"), scratch.put(examples, "examples"))


def read_chats(chat: Chat) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation as read from what was written.

    formatted_chars is the length of all its examples together. A digest goes through a text in order, so the
    turns of a conversation stream through one task, of which it holds a batch.
    """
    last = chat.examples.select("g", (F.col("n_turns") - 1).alias("seq"), "chars", "loss_start", "loss_end")
    rows = chat.turns.join(last, ["g", "seq"], "left").repartition("g").sortWithinPartitions("g", "seq")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at = None  # g, conv_id, turns, digest, loss code points, loss digest, formatted code points, code points so far

        def closed() -> tuple:
            return (at[1], at[2], at[3].hexdigest(), at[4], at[5].hexdigest(), at[6])

        def batch() -> pa.RecordBatch:
            types = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            conv = b.schema.field("conv_id").type
            for r in b.to_pylist():
                if at is None or r["g"] != at[0]:
                    if at is not None:
                        done.append(closed())
                    at = [r["g"], r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = parse_turn(r["piece"])
                if r["start"] != at[7] or r["seq"] != at[2]:
                    raise ValueError("a turn is missing or out of place")
                at[2] += 1
                at[3].update(f"{role}\n{text}\n".encode())
                at[7] += len(r["piece"])
                if r["chars"] is not None:
                    if r["chars"] != at[7]:
                        raise ValueError("an example does not end with its turn")
                    learnt = unescaped(r["piece"][r["loss_start"] - r["start"] : r["loss_end"] - r["start"]])
                    at[4] += len(learnt)
                    at[5].update(learnt.encode())
                    at[6] += at[7]
            if done:
                yield batch()
                done = []
        if at is not None:
            done.append(closed())
            yield batch()

    kind = chat.turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, turns = EXTRA
    extra = spark.createDataFrame([(conv, i, role, text) for i, (role, text) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(rows.unionByName(extra)))


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
  SELECT *, row_number() OVER w AS seq, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(replace(replace(replace(replace(replace(role, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>'), '>', '\>'), chr(10), '\' || chr(10)))
      + length(replace(replace(replace(text, '\', '\\'), '<turn ', '\<turn '), '</turn>', '\</turn>')) + 17) OVER w AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR seq = n))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
