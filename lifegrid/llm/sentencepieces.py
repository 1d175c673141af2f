"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant texts.

The public model is a BPE model. A sequence of its pieces is the encoding of a text exactly if
each two neighbours, joined, encode to themselves: the first merge across a piece's edge would
also happen in the pair alone. So encoding is a best-path problem whose path scores are 0
(allowed) or minus infinity, with the last piece as state. For any last piece there is at most one path to it.

A giant text is split into chunks. Each chunk, alone, yields the transfer matrix between the
pieces that may cross its left edge and those that may cross its right edge, over (max, +).
Matrices of neighbours combine associatively, so a tree does: going up, each ``FAN`` neighbours become one matrix, until
a text is one; going down, the pieces at the two ends of a node fix those at the edges of its
children. Each chunk is then traced again independently between its two fixed pieces. No task holds more than FAN
matrices of a text at once. Other texts are encoded by the library in units that no piece can cross.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, numbered_schema, table
from .linededup import row_key
from .pieces import Units, default_path, groups, hold

SPACE = "▁"
_ODD = re.compile(f" {{2}}|^ | $|{SPACE}|\x00")
State = tuple[int, int]  # a piece's start and end, in code points of the normalised text
Matrix = dict[State, frozenset[State]]  # the entries that are 0; all others are minus infinity
START: State = (-1, 0)
#: Neighbours that a node of the tree combines.
FAN = 32


class Model:
    """The pieces of a SentencePiece BPE model, as a library and as a lattice."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.vocab_size()
        plain = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))]
        self.ids = {self.lib.id_to_piece(i): i for i in plain}
        self.rank = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.allowed: dict[tuple[str, str], bool] = {}
        # units are cut before spaces; that needs that no piece has a space after another character
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this model crosses words")
        self.units = Units(lambda us: [np.array(x, "<u2").tobytes() for x in self.lib.encode(us, num_threads=1)] if us else [], 120_000)

    # the library's own encoding, for all but giant texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        out = []
        for a, b in groups(texts):
            parts = [None if not t or _ODD.search(t) else t.split(" ") for t in texts[a:b]]
            self.units.load([u for us in parts if us for u in us])
            for t, us in zip(texts[a:b], parts, strict=True):
                out.append(b"".join(self.units.values(us)) if us else np.array(self.lib.encode(t), "<u2").tobytes() if t else b"")
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.lib.decode([np.frombuffer(x, "<u2").tolist() for x in ids])

    # the lattice

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: again and again the best-scored neighbours, the leftmost of equals."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                r = self.rank.get(s[i] + s[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Whether b may stand behind a; a = '' for the start of the text."""
        got = self.allowed.get((a, b))
        if got is None:
            if len(self.allowed) > 100_000:
                self.allowed.clear()
            got = self.allowed[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return got

    def ending(self, s: str, i: int, least: int) -> list[int]:
        """Starts j >= least of the pieces s[j:i]; any single character counts."""
        return [j for j in range(i - 1, max(least, i - self.longest) - 1, -1) if j == i - 1 or s[j:i] in self.ids]

    def crossing(self, s: str, p: int) -> list[State]:
        """The pieces with start < p <= end: what may be the piece at an edge p."""
        return [(j, i) for i in range(p, min(len(s), p + self.longest - 1) + 1) for j in self.ending(s, i, 0) if j < p]

    def sweep(self, s: str, states: list[State], q: int) -> dict[int, dict[int, int]]:
        """From the states at the left edge, all reachable pieces up to the right edge q: end -> start -> bits of
        the states that reach it."""
        reach: dict[int, dict[int, int]] = {}
        for k, (a, b) in enumerate(states):
            reach.setdefault(b, {})[a] = reach.get(b, {}).get(a, 0) | 1 << k
        first = min(b for _, b in states)
        for i in range(first + 1, min(len(s), q + self.longest - 1) + 1):
            for j in self.ending(s, i, first):
                if j < q and (before := reach.get(j)):
                    piece, bits = s[j:i], 0
                    for a, m in before.items():
                        if self.follows(s[a:j] if a >= 0 else "", piece):
                            bits |= m
                    if bits:
                        reach.setdefault(i, {})[j] = reach.get(i, {}).get(j, 0) | bits
        return reach

    def matrix(self, s: str, p: int, q: int) -> Matrix:
        """The transfer matrix of the chunk [p, q) of s; p = 0 is the text's start."""
        states = [START] if p == 0 else self.crossing(s, p)
        reach = self.sweep(s, states, q)
        outs = [(j, i, bits) for i in reach if i >= q for j, bits in reach[i].items() if j < q]
        return {x: frozenset((j, i) for j, i, bits in outs if bits >> k & 1) for k, x in enumerate(states)}

    def trace(self, s: str, left: State, right: State) -> list[str]:
        """The pieces after the left edge's piece up to and with the right edge's piece."""
        reach = self.sweep(s, [left], right[1])
        (j, i), out = right, []
        while (j, i) != left:
            out.append(s[j:i])
            i, piece = j, s[j:i]
            j = next(a for a in reach[i] if self.follows(s[a:i] if a >= 0 else "", piece))
        return out[::-1]

    def piece_ids(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.byte[b] for b in p.encode()])]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The (max, +) product of two transfer matrices with entries 0 and minus infinity."""
    return {x: frozenset().union(*(b.get(y, frozenset()) for y in mid)) for x, mid in a.items()}


def between(chunks: list[Matrix], left: State, right: State) -> list[State]:
    """The piece at every edge of neighbouring chunks from left to right: prefix products say what left reaches, then one
    step back from right at a time."""
    prefix = [m.get(left, frozenset()) for m in accumulate(chunks, combine)]
    at, out = right, [right]
    for k in range(len(chunks) - 1, 0, -1):
        at = next(x for x in prefix[k - 1] if at in chunks[k].get(x, ()))
        out.append(at)
    return [left, *out[::-1]]


def ending_at(whole: Matrix, n: int) -> State:
    """The last piece of a text of n characters, from its whole matrix."""
    return next(x for x in whole[START] if x[1] == n)


def pack(m: Matrix) -> str:
    return json.dumps([[x, sorted(ys)] for x, ys in sorted(m.items())])


def unpack(m: str) -> Matrix:
    return {tuple(x): frozenset(map(tuple, ys)) for x, ys in json.loads(m)}


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode_scanned(model: Model, text: str, chunk: int) -> list[int]:
    """The scan in one process, for tests and for small use."""
    s = normalised(text)
    cuts = [*range(0, max(len(s) - 1, 1), chunk), len(s)]
    spans = list(zip(cuts, cuts[1:], strict=False))
    chunks = [model.matrix(s, p, q) for p, q in spans]
    at = between(chunks, START, ending_at(reduce(combine, chunks), len(s)))
    return [i for a, b in zip(at, at[1:], strict=False) for i in (model.piece_ids(model.trace(s, a, b)) if a != b else [])]


def _model(path: str | None) -> Model:
    path = path or default_path("piece_bpe_32k.model")
    return hold(("pieces", path), lambda: Model(path))


def _chunks(chunk: int, margin: int):
    """Cuts texts into chunks with margins; a text is held by one task, its chunks go on one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["r1", "r2", "k", "n", "p", "q", "off", "part"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for r1, r2, text in zip(*(b.column(c).to_pylist() for c in ("r1", "r2", "text")), strict=True):
                s = normalised(text)
                n, rows = len(s), []
                for k, p in enumerate(range(0, max(n - 1, 1), chunk)):
                    # the last chunk ends with the text, also where one character is left over
                    q, off = (n if p + chunk >= n - 1 else p + chunk), max(0, p - margin)
                    rows.append((r1, r2, k, n, p, q, off, s[off : q + margin]))
                    if len(rows) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _giant(docs: DataFrame, path: str | None, chunk: int, margin: int) -> DataFrame:
    """r1, r2 and ids of the giant texts, whose chunks are spread over tasks."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "giant")
    parts = scratch.put(docs.dropDuplicates(["r1", "r2"]).mapInArrow(_chunks(chunk, margin), "r1 long, r2 long, k int, n long, p long, q long, off long, part string"), "parts")
    size = parts.agg(F.count("*"), F.max("k")).first()
    # a number of partitions that is given isn't merged by adaptive execution: four chunks a task
    tasks = min(20_000, max(1, size[0] // 4))
    spread = lambda t: t.repartition(tasks, "r1", "r2", "k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        if m.longest > margin:
            raise ValueError(f"margin must be at least {m.longest}, the longest piece of this model")
        for b in batches:
            out = []
            for p, q, off, part in zip(*(b.column(c).to_pylist() for c in ("p", "q", "off", "part")), strict=True):
                # positions are kept in those of the whole text
                move = lambda x: x if x == START else (x[0] + off, x[1] + off)  # noqa: B023, E731
                out.append(pack({move(x): frozenset(map(move, ys)) for x, ys in m.matrix(part, p - off, q - off).items()}))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("r1", "r2", "k", "n")), pa.array(out, pa.string())], ["r1", "r2", "k", "n", "m"])

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        whole = reduce(combine, map(unpack, t.column("m").to_pylist()))
        return pa.table({"r1": t.column("r1")[:1], "r2": t.column("r2")[:1], "k": t.column("up")[:1], "n": t.column("n")[:1], "m": [pack(whole)]})

    def down(nodes: pa.Table, over: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("k")
        left, right = ((over.column(a)[0].as_py(), over.column(b)[0].as_py()) for a, b in (("a0", "a1"), ("b0", "b1")))
        at = np.array(between(list(map(unpack, nodes.column("m").to_pylist())), left, right), np.int64)
        return pa.table({"r1": nodes.column("r1"), "r2": nodes.column("r2"), "k": nodes.column("k"), "a0": at[:-1, 0], "a1": at[:-1, 1], "b0": at[1:, 0], "b1": at[1:, 1]})

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = np.array([ending_at(unpack(m), n) for m, n in zip(b.column("m").to_pylist(), b.column("n").to_pylist(), strict=True)], np.int64).reshape(-1, 2)
            one = lambda x: pa.array(np.full(b.num_rows, x), pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("r1"), b.column("r2"), b.column("k"), one(START[0]), one(START[1]), pa.array(last[:, 0]), pa.array(last[:, 1])], ["r1", "r2", "k", "a0", "a1", "b0", "b1"])

    matrix, states = "r1 long, r2 long, k int, n long, m string", "r1 long, r2 long, k int, a0 long, a1 long, b0 long, b1 long"
    levels, nodes = [], int(size[1] or 0) + 1
    levels.append(scratch.put(spread(parts).mapInArrow(matrices, matrix), "matrices"))
    over = lambda t: t.withColumn("up", F.floor(F.col("k") / FAN).cast("int"))
    while nodes > 1:
        levels.append(scratch.put(over(levels[-1]).groupBy("r1", "r2", "up").applyInArrow(up, matrix), "nodes"))
        nodes = -(-nodes // FAN)
    at = levels[-1].mapInArrow(root, states)
    for below in reversed(levels[:-1]):
        at = over(below).groupBy("r1", "r2", "up").cogroup(scratch.put(at, "states").withColumnRenamed("k", "up").groupBy("r1", "r2", "up")).applyInArrow(down, states)

    def retrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for b in batches:
            out = []
            for off, part, a0, a1, b0, b1 in zip(*(b.column(c).to_pylist() for c in ("off", "part", "a0", "a1", "b0", "b1")), strict=True):
                left = START if a0 < 0 else (a0 - off, a1 - off)
                right = (b0 - off, b1 - off)
                out.append(np.array(m.piece_ids(m.trace(part, left, right)) if left != right else [], "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("r1"), b.column("r2"), b.column("k"), pa.array(out, pa.binary())], ["r1", "r2", "k", "ids"])

    traced = scratch.put(spread(parts.join(at, ["r1", "r2", "k"])).mapInArrow(retrace, "r1 long, r2 long, k int, ids binary"), "ids")
    whole_ids = F.array_sort(F.collect_list(F.struct("k", F.hex("ids").alias("h"))))
    return traced.groupBy("r1", "r2").agg(F.unhex(F.array_join(F.transform(whole_ids, lambda x: x["h"]), "")).alias("ids"))


def encode_documents(docs: DataFrame, path: str | None = None, giant: int = 65_536, chunk: int = 16_384, margin: int = 64, with_ids: bool = True) -> DataFrame:
    """docs (without text) plus ids (array of int, if asked), n_tokens, ids_crc32 and round_trip.

    The ids are those of the sentencepiece library, without begin and end ids. Texts of more than ``giant`` code
    points go through the scan. ids_crc32 is over the ids as little-endian unsigned 32-bit integers;
    round_trip says that decoding gives the text back. A null text is empty and has no ids. Repeated rows
    give repeated rows; columns of docs named like the new ones are replaced; an empty
    table gives an empty one. margin must be the longest piece at least; a shorter one is refused.
    """
    made = {"ids": "ids array<int>", "n_tokens": "n_tokens long", "ids_crc32": "ids_crc32 long", "round_trip": "round_trip boolean"}
    new = [c for c in made if with_ids or c != "ids"]
    keep = [c for c in docs.columns if c != "text" and c not in made]
    rows = numbered(docs, keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = numbered_schema(docs, keep, *[made[c] for c in new])
    inner = [f"c{i}" for i in range(len(keep))]

    def finish(b: pa.RecordBatch, texts: list[str], ids: list[bytes], m: Model) -> pa.RecordBatch:
        wide = [np.frombuffer(x, "<u2") for x in ids]
        cols = [b.column(c) for c in inner]
        if with_ids:
            flat = np.concatenate([*wide, np.empty(0, "<u2")]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in wide])]).astype(np.int32)), pa.array(flat)))
        cols += [pa.array([len(x) for x in wide], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in wide], pa.int64())]
        cols.append(pa.array([a == c for a, c in zip(m.decode(ids) if ids else [], texts, strict=True)], pa.bool_()))
        return pa.RecordBatch.from_arrays(cols, [*inner, *new])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for whole in batches:
            sizes = whole.column("text").to_pylist()
            for a, z in groups(sizes):
                yield finish(whole.slice(a, z - a), sizes[a:z], m.encode(sizes[a:z]), m)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(path)
        for b in batches:
            yield finish(b, b.column("text").to_pylist(), b.column("given").to_pylist(), m)

    small = rows.filter(F.length("text") <= giant).mapInArrow(plain, schema)
    large = rows.filter(F.length("text") > giant).select("*", *row_key(F.lit(0), F.col("text")))
    ids = _giant(large.select("r1", "r2", "text"), path, chunk, margin).withColumnRenamed("ids", "given")
    return small.unionByName(large.join(ids, ["r1", "r2"]).select(*inner, "text", "given").mapInArrow(given, schema)).toDF(*keep, *new)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
