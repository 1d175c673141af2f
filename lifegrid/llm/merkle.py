"""A Merkle manifest of a dataset, stored in van Emde Boas order.

Each document is a leaf. The documents of a language, in order, make a tree of runs of ``FAN`` nodes; the languages'
subroots make a tree over these. A tree is stored as blocks: aligned subtrees of ``height`` levels of
edges, one row each. The roots of the blocks are the leaves of the next round of blocks, until one is left. Within a block
the digests stand in van Emde Boas order: the levels are cut at half, the upper tree comes first, then each lower
tree, each stored in the same way. Addresses follow from depth and index alone, so construction fills, and proofs read,
a block without any links between nodes.

Documents are numbered by ranges of their order: each range counts its rows, and a running sum over the few counts gives each its
base. So no task holds a language. A task holds one block.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_side, table

FAN = 8
#: Levels of edges in a block: 8 ** 4 leaves.
HEIGHT = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(hexes: list[str]) -> str:
    """H of digests as hex text."""
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


# addresses


def nodes_in(levels: int, fan: int = FAN) -> int:
    return (fan**levels - 1) // (fan - 1)


def address(depth: int, index: int, levels: int, fan: int = FAN) -> int:
    """The place of a node (depth 0: the root) in a whole tree of so many levels."""
    at = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, levels = depth - upper, levels - upper
        tree, index = divmod(index, fan**depth)
        at += nodes_in(upper, fan) + tree * nodes_in(levels, fan)
    return at


@cache
def addresses(levels: int, fan: int = FAN) -> tuple[np.ndarray, ...]:
    """``address`` of all nodes, by depth."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    below = addresses(levels - upper, fan)
    starts = nodes_in(upper, fan) + nodes_in(levels - upper, fan) * np.arange(fan**upper, dtype=np.int64)
    return (*addresses(upper, fan), *((starts[:, None] + b[None, :]).ravel() for b in below))


def levels_of(n: int, height: int = HEIGHT, fan: int = FAN) -> int:
    """Levels of nodes of a block in a tree with n leaves: as few as give one root, else height + 1."""
    levels = 1
    while levels <= height and fan ** (levels - 1) < n:
        levels += 1
    return levels


def build_block(leaves: list[str], levels: int, fan: int = FAN) -> tuple[bytes, str]:
    """The stored digests and the root of an aligned subtree; places of nodes that the tree doesn't have are zero."""
    store, where = np.zeros((nodes_in(levels, fan), 32), np.uint8), addresses(levels, fan)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        store[where[depth][: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        if depth:
            row = [digest(row[i : i + fan]) for i in range(0, len(row), fan)]
    return store.tobytes(), row[0]


def read_block(stored: bytes, leaves: int, levels: int, fan: int = FAN) -> list[list[str]]:
    """The digests of a block by depth, as hex text."""
    store, counts = np.frombuffer(stored, np.uint8).reshape(-1, 32), [leaves]
    for _ in range(levels - 1):
        counts.insert(0, -(-counts[0] // fan))
    out = []
    for where, n in zip(addresses(levels, fan), counts, strict=True):
        whole = store[where[:n]].tobytes().hex()
        out.append([whole[i : i + 64] for i in range(0, len(whole), 64)])
    return out


#: A path is, level by level upwards, the digests left and right of the path's own node in its run.
Path = list[tuple[list[str], list[str]]]


def path_in(rows: list[list[str]], index: int, fan: int = FAN) -> Path:
    """The path of a leaf to the root of its block."""
    out = []
    for row in rows[:0:-1]:
        run = index - index % fan
        out.append((row[run:index], row[index + 1 : run + fan]))
        index //= fan
    return out


def pack(path: Path) -> bytes:
    return b"".join(bytes([len(a), len(b)]) + bytes.fromhex("".join(a + b)) for a, b in path)


def unpack(raw: bytes) -> Path:
    out, at = [], 0
    while at < len(raw):
        a, b = raw[at], raw[at + 1]
        hexes = [raw[i : i + 32].hex() for i in range(at + 2, at + 2 + 32 * (a + b), 32)]
        out.append((hexes[:a], hexes[a:]))
        at += 2 + 32 * (a + b)
    return out


def fold(own: str, path: Path) -> str:
    for a, b in path:
        own = digest([*a, own, *b])
    return own


# trees over tables


def numbered_by(scratch: Scratch, df: DataFrame, *order: str) -> DataFrame:
    """df (with a key ``g``) plus k, its number within g by the order, and n, the rows of g.

    Rows go to ranges of (g, order); a running sum over the ranges' counts (a row a range and key) gives the bases.
    """
    ranges = df.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("m", F.monotonically_increasing_id())
    rows = scratch.put(ranges, "ranges").withColumn("part", F.shiftright("m", 33))
    key = Window.partitionBy("g")
    runs = rows.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("m").alias("first"))
    runs = runs.select("g", "part", (F.sum("rows").over(key.orderBy("part")) - F.col("rows") - F.col("first")).alias("base"), F.sum("rows").over(key).alias("n"))
    return rows.join(small_side(scratch.put(runs, "bases")), ["g", "part"]).withColumn("k", F.col("m") + F.col("base")).drop("m", "part", "base")


def tree(scratch: Scratch, nodes: DataFrame, height: int = HEIGHT, fan: int = FAN) -> list[DataFrame]:
    """The rounds of blocks over nodes of g, k (from 0), n (nodes of g) and h (hex digest).

    A block has g, b (its number), n, leaves, levels, stored (digests in van Emde Boas order) and root. Groups of one block are done.
    """
    size, rounds = fan**height, []

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        levels = levels_of(t.column("n")[0].as_py(), height, fan)
        stored, root = build_block(t.column("h").to_pylist(), levels, fan)
        return pa.table(
            {"g": t.column("g")[:1], "b": t.column("b")[:1], "n": t.column("n")[:1], "leaves": pa.array([t.num_rows], pa.int32()), "levels": pa.array([levels], pa.int32()), "stored": pa.array([stored], pa.binary()), "root": [root]}
        )

    while True:
        keyed = nodes.select("g", F.floor(F.col("k") / size).alias("b"), "k", "n", "h")
        rounds.append(scratch.put(keyed.groupBy("g", "b").applyInArrow(build, "g string, b long, n long, leaves int, levels int, stored binary, root string"), "blocks"))
        more = rounds[-1].filter(F.col("n") > size)
        if more.isEmpty():
            return rounds
        nodes = more.select("g", F.col("b").alias("k"), F.ceil(F.col("n") / size).alias("n"), F.col("root").alias("h"))


def tops(rounds: list[DataFrame], height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """g and root of every group."""
    done = [r.filter(F.col("n") <= fan**height).select("g", "root") for r in rounds]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def paths_down(scratch: Scratch, rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """The blocks of the first round with their roots' paths, from the groups' own (g, path), round by round downwards."""

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = read_block(r["stored"], r["leaves"], r["levels"], fan)
                paths = [pack(path_in(rows, i, fan)) + r["path"] for i in range(r["leaves"])]
                ks = pa.array(range(r["b"] * fan**height, r["b"] * fan**height + len(paths)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(paths), pa.string()), ks, pa.array(paths, pa.binary())], ["g", "b", "path"])

    below = None
    for blocks in reversed(rounds):
        single = blocks.filter(F.col("n") <= fan**height).join(small_side(above), "g")
        inner = blocks.filter(F.col("n") > fan**height)
        if below is not None:
            single = single.unionByName(inner.join(below, ["g", "b"]))
        placed = scratch.put(single, "placed")
        below = scratch.put(placed.select("g", "b", "leaves", "levels", "stored", "path").mapInArrow(children, "g string, b long, path binary"), "paths") if blocks is not rounds[0] else None
    return placed


def leaf_paths(scratch: Scratch, rounds: list[DataFrame], above: DataFrame, height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """g, k and path of every leaf."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = read_block(r["stored"], r["leaves"], r["levels"], fan)
                paths = [pack(path_in(rows, i, fan)) + r["path"] for i in range(r["leaves"])]
                ks = pa.array(range(r["b"] * fan**height, r["b"] * fan**height + len(paths)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * len(paths), pa.string()), ks, pa.array(paths, pa.binary())], ["g", "k", "path"])

    return paths_down(scratch, rounds, above, height, fan).select("g", "b", "leaves", "levels", "stored", "path").mapInArrow(each, "g string, k long, path binary")


# the manifest


def leaf_of(text: Column | None = None) -> Column:
    """H of a document's fields, each '-' if null, else its UTF-8 byte count, ':' and itself."""
    parts = [(text if c == "text" and text is not None else F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def tampered_text() -> Column:
    """The text of each third document, by crc32 of its id, with A-Z lower-cased; null for the others."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, low)


class Manifest:
    """The written trees of a table: ``languages`` (rounds of blocks by language), ``top`` (rounds over the subroots), ``root``."""

    def __init__(self, leaves: DataFrame, height: int = HEIGHT, fan: int = FAN):
        """leaves: g (the language behind '=', '' for null), doc_id, leaf (hex)."""
        self.height, self.fan = height, fan
        self.scratch = Scratch(leaves.sparkSession, "merkle")
        self.leaves = self.scratch.put(numbered_by(self.scratch, leaves, "doc_id", "leaf"), "leaves")
        self.languages = tree(self.scratch, self.leaves.withColumnRenamed("leaf", "h"), height, fan)
        self.subroots = self.scratch.put(tops(self.languages, height, fan), "subroots")
        named = self.subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("h"))
        self.names = self.scratch.put(numbered_by(self.scratch, named, "name"), "names")
        self.top = tree(self.scratch, self.names, height, fan)
        root = tops(self.top, height, fan).first()
        self.root = root["root"] if root else None

    def placed(self) -> DataFrame:
        """The blocks of leaves, each with the path from its root to the dataset's and the subroot of its language."""
        start = self.leaves.sparkSession.createDataFrame([("", bytearray())], "g string, path binary")
        up = leaf_paths(self.scratch, self.top, start, self.height, self.fan).withColumnRenamed("g", "_g").join(self.names.select(F.col("g").alias("_g"), "k", "name"), ["_g", "k"])
        up = self.scratch.put(up.select(F.col("name").alias("g"), "path"), "up")
        blocks = paths_down(self.scratch, self.languages, up, self.height, self.fan)
        return blocks.join(small_side(self.subroots.select("g", F.col("root").alias("subroot"))), "g").select("g", "b", "leaves", "levels", "stored", "path", "subroot")

    def verified(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf; what is folded is ``seen``, if the
        leaves have it and it isn't null, else the leaf."""
        fan, root = self.fan, self.root
        doc_type = self.leaves.schema["doc_id"].dataType.simpleString()
        seen = F.col("seen") if "seen" in self.leaves.columns else F.lit(None).cast("string").alias("seen")
        leaves = self.leaves.select("g", F.floor(F.col("k") / fan**self.height).alias("b"), "k", "doc_id", "leaf", seen)

        def prove(mine: pa.Table, block: pa.Table) -> pa.Table:
            mine = mine.sort_by("k")
            (r,) = block.to_pylist()
            rows, above = read_block(r["stored"], r["leaves"], r["levels"], fan), unpack(r["path"])
            shared = [h for a, b in above for h in (*a, *b)]
            proofs, folded = [], []
            for i, (leaf, seen) in enumerate(zip(mine.column("leaf").to_pylist(), mine.column("seen").to_pylist(), strict=True)):
                path = path_in(rows, i, fan)
                proofs.append(digest([h for a, b in path for h in (*a, *b)] + shared))
                folded.append(fold(fold(seen or leaf, path), above))
            same = lambda x: pa.array([x] * mine.num_rows, pa.string())
            return pa.table(
                {"doc_id": mine.column("doc_id"), "leaf": mine.column("leaf"), "subroot": same(r["subroot"]), "root": same(root), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())}
            )

        schema = f"doc_id {doc_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return leaves.groupBy("g", "b").cogroup(self.placed().groupBy("g", "b")).applyInArrow(prove, schema)


def leaves_of(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """g, doc_id, leaf and, if a later text is given, seen: the leaf that it makes (null where the text is null)."""
    g = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    extra = [] if seen is None else [F.when(seen.isNotNull(), leaf_of(seen)).alias("seen")]
    return docs.select(g.alias("g"), "doc_id", leaf_of().alias("leaf"), *extra)


def manifest(docs: DataFrame, seen: Column | None = None, height: int = HEIGHT, fan: int = FAN) -> Manifest:
    """Builds and writes the manifest of docs (doc_id, source, lang, n_chars, text; other columns aren't read).

    Leaves ascend by doc_id within a language, nulls first, then by digest, so repeated rows stand side by side. Nulls in
    any column have their own mark; a null language is a language of its own and comes first. An empty table has no root and no leaves. Texts
    are read once; from then on rows hold digests.
    """
    scratch = Scratch(docs.sparkSession, "digests")
    return Manifest(scratch.put(leaves_of(docs, seen), "digests"), height, fan)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered_text()).verified()


OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
      lambda s, x: CASE WHEN x >= 256 THEN xor(s, x - 256) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)) AS crc
  FROM documents
), d AS (
  SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS later FROM c
), leaves AS (
  SELECT rid, doc_id, lang, later IS NOT NULL AS changed,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS seen
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n,
    coalesce('=' || lang, '') AS g FROM leaves
), low(g, level, k, n, h) AS (
  SELECT g, 0, k, n, leaf FROM placed
  UNION ALL
  SELECT g, max(level) + 1, k // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM low WHERE n > 1 GROUP BY g, k // 8
), subs AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n FROM low WHERE n = 1
), high(level, k, n, h) AS (
  SELECT 0, k, n, subroot FROM subs
  UNION ALL
  SELECT max(level) + 1, k // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY k // 8
), walk(rid, g, level, k, own, proof, done) AS (
  SELECT rid, g, 0, k, CASE WHEN changed THEN seen ELSE leaf END, '', n = 1 FROM placed
  UNION ALL
  SELECT w.rid, w.g, w.level + 1, w.k // 8, sha256(string_agg(CASE WHEN l.k = w.k THEN w.own ELSE l.h END, '' ORDER BY l.k)),
    w.proof || coalesce(string_agg(l.h, '' ORDER BY l.k) FILTER (WHERE l.k <> w.k), ''), max(l.n) <= 8
  FROM walk w JOIN low l ON l.g = w.g AND l.level = w.level AND l.k // 8 = w.k // 8 WHERE NOT w.done
  GROUP BY w.rid, w.g, w.level, w.k, w.own, w.proof
), upper(rid, level, k, own, proof, done) AS (
  SELECT w.rid, 0, s.k, w.own, w.proof, s.n = 1 FROM walk w JOIN subs s USING (g) WHERE w.done
  UNION ALL
  SELECT w.rid, w.level + 1, w.k // 8, sha256(string_agg(CASE WHEN l.k = w.k THEN w.own ELSE l.h END, '' ORDER BY l.k)),
    w.proof || coalesce(string_agg(l.h, '' ORDER BY l.k) FILTER (WHERE l.k <> w.k), ''), max(l.n) <= 8
  FROM upper w JOIN high l ON l.level = w.level AND l.k // 8 = w.k // 8 WHERE NOT w.done
  GROUP BY w.rid, w.level, w.k, w.own, w.proof
)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.own AS folded_root, u.own = t.h AS verified
FROM placed p JOIN subs s USING (g) JOIN upper u ON u.rid = p.rid AND u.done CROSS JOIN (SELECT h FROM high WHERE n = 1) t
"""
