"""Alignment of two tokenizers' tokens of the same texts.

Both token sequences of a text are sorted lists of end offsets in bytes. Merging them gives everything: between two neighbouring ends
lies one overlap of one A and one B token, and an end that both lists have closes a group. The merge is cut by merge paths: the
diagonal d of the (A, B) grid holds the states after d steps, a binary search on it finds where the merge crosses it, and the
crossings of every ``work``-th diagonal cut the merge into pieces of equal work that know nothing of each other. A piece
emits its overlaps, its whole groups, and the tokens of the groups open at its two edges; these are stitched in order. The documents
of a batch are merged as one sequence, so that short ones share pieces. A document of more than ``giant`` steps goes on as
piece rows, which tasks all over the cluster merge.

Corpus counts are by document: each document's distinct pairs are summed up in its task and then by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, join_heavy, table
from .pieces import _SPACE_EDGE, Units, byte_units, default_path, groups, hold
from .sentencepieces import _ODD, Model
from .tokenfiles import Encoder, open_folder

#: Steps of a piece, and steps from which a document's pieces are dealt out.
WORK, GIANT = 1 << 16, 1 << 18
#: Ids below this number, so that a pair is one unsigned 32-bit integer.
IDS = 1 << 16
#: Pairs of the counts that a worker may hold (13 bytes each); more are joined by a shuffle.
HELD_PAIRS = 6_000_000
#: Pairs that a counting task holds before it hands them on.
COUNTED = 2_000_000


# merge paths


def crossings(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """How many ends of a come before each work-th diagonal, first and last diagonal included; equal ends: a's first."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        # a[mid] comes before b[d - mid - 1]: the crossing lies behind it
        before = np.zeros(len(d), bool)
        before[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        lo, hi = np.where(open_ & before, mid + 1, lo), np.where(open_ & ~before, mid, hi)
    return lo


def merge_piece(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A piece's overlaps, as positions of their A and B tokens from the piece's first ones, and its common ends.

    before is the last end before the piece. If the piece begins with it again, b ends there where a did at
    the piece's edge: no overlap, but a common end. Positions may point one behind the piece, to a token that ends later.
    """
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    twice = ends[1:][ends[1:] == ends[:-1]]
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    if len(ends) and ends[0] == before:
        ends, twice = ends[1:], np.append(before, twice)
    return np.searchsorted(a, ends), np.searchsorted(b, ends), twice


def merge(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merge_piece`` over all pieces of two lists of ends: positions of the overlaps' tokens, and common ends."""
    i = crossings(a, b, work)
    j = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b)) - i
    out = []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        x, y, cuts = merge_piece(a[i0:i1], b[j0:j1], last_end(a, b, i0, j0))
        out.append((x + i0, y + j0, cuts))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def last_end(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    return max(int(a[i - 1]) if i else 0, int(b[j - 1]) if j else 0)


# groups as text

#: Ids in decimal behind which a mark stands, at id + IDS * mark.
MARKS = ",|;"


def _decimals() -> np.ndarray:
    return np.array([f"{i}{m}" for m in MARKS for i in range(IDS)], dtype="S6")


def group_codes(a_ids: np.ndarray, b_ids: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> np.ndarray:
    """Ids with their marks (id + IDS * mark) in the order of the text: group by group, A's before B's."""
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (ga, gb))
    codes[np.arange(len(ga)) + np.searchsorted(gb, ga, "left")] = a_ids + IDS * last_a
    codes[np.arange(len(gb)) + np.searchsorted(ga, gb, "right")] = b_ids + 2 * IDS * last_b
    return codes


def group_text(codes: np.ndarray) -> bytes:
    """The text, with a semicolon behind each group."""
    return hold_decimals()[codes].tobytes().replace(b"\0", b"")


_table: list[np.ndarray] = []


def hold_decimals() -> np.ndarray:
    if not _table:
        _table.append(_decimals())
    return _table[0]


# tokens


class Pair:
    """Both tokenizers; a text's ids as 16-bit integers, None where its tokens' bytes aren't its own."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder(a_path, "<u2"), Model(b_path)
        self.a.lib.encode_special_tokens = True
        letter = {c: b for b, c in self.a.letters.items()}
        names = [self.a.lib.id_to_token(i) or "" for i in range(self.a.lib.get_vocab_size())]
        self.a_bytes = [bytes(letter[c] for c in t) if all(c in letter for c in t) else b"" for t in names]
        lib = self.b.lib
        self.b_bytes = []
        for i in range(lib.vocab_size()):
            p = lib.id_to_piece(i)
            self.b_bytes.append(bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) else p.replace("▁", " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > IDS:
            raise ValueError(f"ids must be below {IDS}")
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_units = Units(lambda us: [self.kept(x, self.a_bytes, u) for x, u in zip(self.a.fresh(us), us, strict=True)], 200_000)
        self.b_units = Units(lambda us: [self.kept(np.array(x, "<u2").tobytes(), self.b_bytes, " " + u) for x, u in zip(self.b.lib.encode(us, num_threads=1), us, strict=True)] if us else [], 120_000)

    @staticmethod
    def kept(ids: bytes, names: list[bytes], text: str) -> bytes | None:
        return ids if b"".join([names[i] for i in np.frombuffer(ids, "<u2").tolist()]) == text.encode() else None

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        a_parts = [None if not t else _SPACE_EDGE.split(" " + t) if t[0].isspace() else led(byte_units(t)) for t in texts]
        b_parts = [None if not t or _ODD.search(t) else t.split(" ") for t in texts]
        self.a_units.load([u for us in a_parts if us for u in us])
        self.b_units.load([u for us in b_parts if us for u in us])
        out: list[tuple[bytes, bytes] | None] = []
        for t, ua, ub in zip(texts, a_parts, b_parts, strict=True):
            if not t:
                out.append(None)
                continue
            a = list(self.a_units.values(ua))
            b = list(self.b_units.values(ub)) if ub else [self.kept(np.array(self.b.lib.encode(t), "<u2").tobytes(), self.b_bytes, " " + t)]
            out.append(None if None in a or None in b else (b"".join(a), b"".join(b)))
        return out


def led(units: list[str]) -> list[str]:
    units[0] = " " + units[0]
    return units


def _pair(a_path: str | None, b_path: str | None) -> Pair:
    a_path, b_path = a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")
    return hold(("alignment", a_path, b_path), lambda: Pair(a_path, b_path))


def distinct(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys once each, ascending, and the sums of their times (1 each by default)."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first) if len(keys) else times


RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
PIECE = "piece int, a_ids binary, b_ids binary, a_ends binary, b_ends binary, edge long"


def align_batch(pair: Pair, encoded: list[tuple[bytes, bytes] | None], work: int) -> list[tuple]:
    """A RESULT row of each document of a batch, merged as one sequence."""
    tokens = [e or (b"", b"") for e in encoded]
    a_ids, b_ids = (np.frombuffer(b"".join(t[k] for t in tokens), "<u2").astype(np.int64) for k in (0, 1))
    n_a, n_b = (np.array([len(t[k]) // 2 for t in tokens], np.int64) for k in (0, 1))
    ea, eb = np.cumsum(pair.a_len[a_ids]), np.cumsum(pair.b_len[b_ids])
    la, lb, cuts = merge(ea, eb, work)
    to_a, to_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    # the document of an overlap is that of its A token, the document of a cut likewise
    doc = np.repeat(np.arange(len(tokens)), n_a)
    links = np.bincount(doc[la], minlength=len(tokens))
    n_groups = np.bincount(doc[np.searchsorted(ea, cuts)], minlength=len(tokens))
    keys, times = distinct(doc[la] << 32 | a_ids[la] << 16 | b_ids[lb])
    at = np.searchsorted(keys, np.arange(len(tokens) + 1) << 32)
    keys, times = (keys & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
    codes = group_codes(a_ids, b_ids, np.searchsorted(cuts, ea), np.searchsorted(cuts, eb))
    out = []
    for k in range(len(tokens)):
        text = group_text(codes[to_a[k] + to_b[k] : to_a[k + 1] + to_b[k + 1]])
        out.append((int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(links[k]), hashlib.sha256(text[:-1]).hexdigest() if text else "", keys[at[k] : at[k + 1]].tobytes(), times[at[k] : at[k + 1]].tobytes()))
    return out


def pieces_of(pair: Pair, tokens: tuple[bytes, bytes], work: int) -> Iterator[tuple]:
    """The PIECE rows of a document, each with one token more of A and B, which may be the one that its last overlap is of."""
    a_ids, b_ids = (np.frombuffer(t, "<u2") for t in tokens)
    ea, eb = np.cumsum(pair.a_len[a_ids]), np.cumsum(pair.b_len[b_ids])
    i = crossings(ea, eb, work)
    j = np.append(np.arange(0, len(ea) + len(eb), work), len(ea) + len(eb)) - i
    for k, (i0, i1, j0, j1) in enumerate(zip(i[:-1], i[1:], j[:-1], j[1:], strict=True)):
        yield k, a_ids[i0 : i1 + 1].tobytes(), b_ids[j0 : j1 + 1].tobytes(), ea[i0:i1].astype("<i8").tobytes(), eb[j0:j1].astype("<i8").tobytes(), last_end(ea, eb, i0, j0)


MERGED = "n_a long, n_b long, n_groups long, n_links long, pairs binary, times binary, head_a binary, head_b binary, whole binary, tail_a binary, tail_b binary"


def align_piece(a_ids: bytes, b_ids: bytes, a_ends: bytes, b_ends: bytes, edge: int) -> tuple:
    """A MERGED row: overlaps, whole groups as text, and the ids of the groups open at both edges. A piece without a common end
    has one open group, in its head."""
    a, b = (np.frombuffer(x, "<u2").astype(np.int64) for x in (a_ids, b_ids))
    ea, eb = np.frombuffer(a_ends, "<i8"), np.frombuffer(b_ends, "<i8")
    la, lb, cuts = merge_piece(ea, eb, edge)
    keys, times = distinct(a[la] << 16 | b[lb])
    a, b = a[: len(ea)], b[: len(eb)]
    ga, gb = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)
    last = max(len(cuts), 1)
    inner_a, inner_b = (ga > 0) & (ga < last), (gb > 0) & (gb < last)
    whole = group_text(group_codes(a[inner_a], b[inner_b], ga[inner_a], gb[inner_b]))
    raw = lambda ids: ids.astype("<u2").tobytes()
    return (
        len(ea), len(eb), len(cuts), len(la), keys.astype("<u4").tobytes(), times.astype("<u4").tobytes(),
        raw(a[ga == 0]), raw(b[gb == 0]), whole, raw(a[ga >= last]), raw(b[gb >= last]),
    )


def stitch(rows: list[dict]) -> tuple:
    """The RESULT row of a document from the MERGED rows of its pieces in order."""
    sha, empty = hashlib.sha256(), True
    open_a, open_b = b"", b""

    def put(text: bytes) -> None:
        nonlocal empty
        if text:
            sha.update(text[:-1] if empty else b";" + text[:-1])
            empty = False

    for r in rows:
        open_a, open_b = open_a + r["head_a"], open_b + r["head_b"]
        if r["n_groups"]:
            ids = [np.frombuffer(x, "<u2").tolist() for x in (open_a, open_b)]
            put((",".join(map(str, ids[0])) + "|" + ",".join(map(str, ids[1])) + ";").encode())
            put(r["whole"])
            open_a, open_b = r["tail_a"], r["tail_b"]
    if open_a or open_b:
        raise ValueError("a document ends within a group")
    keys, times = distinct(np.frombuffer(b"".join(r["pairs"] for r in rows), "<u4"), np.frombuffer(b"".join(r["times"] for r in rows), "<u4"))
    return (*(sum(r[c] for r in rows) for c in ("n_a", "n_b", "n_groups", "n_links")), sha.hexdigest(), keys.tobytes(), times.astype("<u4").tobytes())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)] if rows else [pa.array([], t) for t in schema.types], schema.names)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, work: int = WORK, giant: int = GIANT) -> DataFrame:
    """part, row, doc_id and RESULT of every document, written once: its tokens, groups and overlaps.

    A reads a space and the text, B the text (before which it puts a space itself), both without special tokens. pairs are the distinct
    overlapping (A id, B id) as unsigned 32-bit integers (A id * 65,536 + B id), ascending; times says how often each. A null or empty text,
    and one whose tokens' bytes aren't a space and the text, has zeros, no pairs and ''. Repeated rows give repeated rows; other
    columns aren't read; an empty table gives an empty one. Both vocabularies have at most 65,536 ids.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = "part int, row long"
    made, cut = _arrow(RESULT), _arrow(PIECE)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, row = _pair(a_path, b_path), TaskContext.get().partitionId(), 0

        def out(ids: pa.Array, first: int, results: list[tuple], pieces: list[tuple]) -> pa.RecordBatch:
            n = len(ids)
            head = [pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), ids]
            return pa.RecordBatch.from_arrays([*head, *_batch(results or [(None,) * len(made)] * n, made).columns, *_batch(pieces or [(None,) * len(cut)] * n, cut).columns], ["part", "row", "doc_id", *made.names, *cut.names])

        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id")
            for lo, hi in groups(texts):
                encoded = pair.encode(texts[lo:hi])
                large = [k for k, e in enumerate(encoded) if e and len(e[0]) + len(e[1]) > 2 * giant]
                small = sorted(set(range(hi - lo)) - set(large))
                if small:
                    yield out(ids.take(pa.array([lo + k for k in small])), row, align_batch(pair, [encoded[k] for k in small], work), [])
                    row += len(small)
                for k in large:
                    for p in pieces_of(pair, encoded[k], work):
                        yield out(ids.slice(lo + k, 1), row, [], [p])
                    row += 1

    rows = scratch.put(docs.select("doc_id", "text").mapInArrow(encode, f"{key}, doc_id {kind}, {RESULT}, {PIECE}"), "encoded")
    whole = rows.filter("piece is null").select("part", "row", "doc_id", *made.names)
    parts = rows.filter("piece is not null").select("part", "row", "doc_id", *cut.names)
    n = parts.count()
    if not n:
        return whole
    merged = _arrow(MERGED)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [align_piece(*(r[c] for c in cut.names[1:])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "row", "doc_id", "piece")), *_batch(done, merged).columns], ["part", "row", "doc_id", "piece", *merged.names])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        done = _batch([stitch(t.select(merged.names).to_pylist())], made)
        return pa.Table.from_arrays([*(t.column(c)[:1] for c in ("part", "row", "doc_id")), *done.columns], ["part", "row", "doc_id", *made.names])

    spread = parts.repartition(min(20_000, max(1, n // 4)), "part", "row", "piece").mapInArrow(each, f"{key}, doc_id {kind}, piece int, {MERGED}")
    joined = spread.groupBy("part", "row").applyInArrow(join, f"{key}, doc_id {kind}, {RESULT}")
    return whole.unionByName(scratch.put(joined, "stitched"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked) and best (n is the highest of its A id), written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, waiting = np.empty(0, np.uint32), np.empty(0, np.int64), []

        def compact() -> tuple[np.ndarray, np.ndarray]:
            new = distinct(np.concatenate([np.empty(0, np.uint32), *waiting]))
            waiting.clear()
            return distinct(np.concatenate([keys, new[0]]), np.concatenate([times, new[1]]))

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].astype(np.int64)), pa.array(times[k : k + 100_000].astype(np.int64))], ["pair", "n"])

        for b in batches:
            waiting += [np.frombuffer(p, "<u4") for p in b.column("pairs").to_pylist()]
            if sum(map(len, waiting)) > COUNTED:
                keys, times = compact()
                if len(keys) > COUNTED:
                    yield from out()
                    keys, times = keys[:0], times[:0]
        keys, times = compact()
        yield from out()

    n = aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / IDS)))
    return Scratch(aligned.sparkSession, "pairs").put(n.withColumn("best", best), "counts")


def _held_counts(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.dataset as ds

    def load():
        store, at = open_folder(uri)
        t = ds.dataset(at, filesystem=store, format="parquet").to_table(columns=["pair", "n", "best"])
        keys = t.column("pair").to_numpy().astype(np.uint32)
        order = np.argsort(keys)
        return keys[order], t.column("n").to_numpy()[order], t.column("best").to_numpy()[order]

    return hold(("pairs", uri), load)


def scored(aligned: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """aligned without pairs and times, plus n_best and count_sum over its links.

    Counts of at most ``held`` pairs are read by each worker; more are joined to the pairs of the documents by shuffles.
    """
    counts = pair_counts(aligned)
    keep = [c for c in aligned.columns if c not in ("pairs", "times")]
    if counts.count() <= held:
        uri = counts._scratch_path

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = _held_counts(uri)
            for b in batches:
                pairs, times = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").astype(np.int64) for c in ("pairs", "times"))
                of = np.append(0, np.cumsum([len(p) // 4 for p in b.column("pairs").to_pylist()]))
                at = np.searchsorted(keys, pairs)
                sums = [np.append(0, np.cumsum(x)) for x in (times * best[at], times * n[at])]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array((s[of[1:]] - s[of[:-1]]).astype(np.int64)) for s in sums)], [*keep, "n_best", "count_sum"])

        schema = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in keep)
        return aligned.mapInArrow(look_up, f"{schema}, n_best long, count_sum long")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, row, pairs, times in zip(*(b.column(c).to_pylist() for c in ("part", "row", "pairs", "times")), strict=True):
                keys, n = np.frombuffer(pairs, "<u4"), len(pairs) // 4
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([row] * n, pa.int64()), pa.array(keys.astype(np.int64)), pa.array(np.frombuffer(times, "<u4").astype(np.int64))], ["part", "row", "pair", "t"])

    links = aligned.select("part", "row", "pairs", "times").mapInArrow(single, "part int, row long, pair long, t long")
    sums = join_heavy(links, counts, ["pair"], "n").groupBy("part", "row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    return aligned.select(keep).join(sums, ["part", "row"], "left").na.fill(0, ["n_best", "count_sum"])


def align_documents(docs: DataFrame, held: int = HELD_PAIRS, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document; see ``align`` for nulls,
    repeats and empty tables, and for the options."""
    out = scored(align(docs, **options), held)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
