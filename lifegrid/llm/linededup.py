"""Line dedup by levelled sorted runs of line hashes (DataFrame functions only).

Documents come in batches. Each batch's distinct line hashes are anti-joined against the runs
already held: a hash that no run holds becomes an entry of the batch's own run, the only entry that it will ever have; a hash that
is held becomes an update of its entry. When a level holds ``fanout`` runs they are merged into one run of the
next level. Entries and updates hold in how many documents of their batches the hash was found and the largest of their ids; a
hash's count is its entry's with all its updates'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, free_names, join_heavy, quoted, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The \\n-separated lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z (no other letters) in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart; rows equal in id and text are treated alike."""
    return [F.xxhash64(doc_id, text).alias("r1"), F.xxhash64(F.lit("row"), text, doc_id).alias("r2")]


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key has at least min_chars code points: r1, r2, doc_id, at (from 0), h1, h2."""
    split = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    key = split.select("doc_id", "r1", "r2", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return key.select("doc_id", "r1", "r2", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """The levelled runs in the shared folder. Documents of one id must come in one batch."""

    def __init__(self, spark: SparkSession, min_chars: int = 20, fanout: int = 3):
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.scratch = Scratch(spark, "line-runs")
        self.levels: dict[int, list[DataFrame]] = {}

    def runs(self) -> list[DataFrame]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def merged(self) -> DataFrame | None:
        both = None
        for r in self.runs():
            both = r if both is None else both.unionByName(r)
        return both

    def add(self, batch: DataFrame) -> None:
        """Anti-joins the batch's hashes against the entries of the runs and adds the batch as a run of
        new entries and of updates."""
        run = keyed_lines(batch, self.min_chars).groupBy("h1", "h2").agg(F.countDistinct(F.coalesce("doc_id", F.lit(-(2**63)))).alias("n"), F.max("doc_id").alias("top"))
        held = self.merged()
        if held is None:
            run = run.withColumn("entry", F.lit(True))
        else:
            # the anti-join's two sides in one pass: without a partner an entry, else an update
            known = held.filter("entry").select("h1", "h2", F.lit(True).alias("known"))
            run = run.join(known, ["h1", "h2"], "left").select("h1", "h2", "n", "top", F.col("known").isNull().alias("entry"))
        self.levels.setdefault(0, []).append(self.scratch.put(run.sortWithinPartitions("h1", "h2"), "run0"))
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(old := self.levels.get(level, [])) >= self.fanout:
            both = old[0]
            for r in old[1:]:
                both = both.unionByName(r)
            one = both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.bool_or("entry").alias("entry")).select("h1", "h2", "n", "top", "entry")
            self.levels.setdefault(level + 1, []).append(self.scratch.put(one.sortWithinPartitions("h1", "h2"), f"run{level + 1}"))
            self.scratch.drop(*old)
            self.levels[level] = []
            level += 1

    def frequent(self, min_docs: int) -> DataFrame | None:
        """h1, h2, n and top (the largest document id) of the lines found in n >= min_docs documents."""
        held = self.merged()
        if held is None:
            return None
        entries = held.filter("entry").drop("entry")
        more = held.filter("not entry").groupBy("h1", "h2").agg(F.sum("n").alias("m"), F.max("top").alias("last"))
        total = entries.join(more, ["h1", "h2"], "left").select("h1", "h2", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("top", "last").alias("top"))
        return total.filter(F.col("n") >= min_docs)


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """The documents in n ranges of doc_id; null ids come with the first. Range filters reach the scan."""
    cuts = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(1000))).first()[0] or []
    cuts = sorted(set(cuts))
    at = F.col("doc_id")
    out = []
    for k in range(len(cuts) + 1):
        keep = F.lit(True)
        if k:
            keep = keep & (at > cuts[k - 1])
        if k < len(cuts):
            keep = (keep & (at <= cuts[k])) if k else ((at <= cuts[k]) | at.isNull())
        elif not k:
            keep = F.lit(True)
        out.append(docs.filter(keep))
    return out


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, n_batches: int = 4) -> DataFrame:
    """Drops lines that many documents hold, except in the document of the largest id.

    A line's key is the line without blanks at its ends, A-Z in lower case. A key of at least
    ``min_chars`` code points in at least ``min_docs`` documents loses all its lines except in the
    largest doc_id holding it. Returns the columns of docs with ``text`` cut, plus ``n_lines``
    (before), ``n_dropped``. A null text counts as one empty line and comes back as ''. Rows of
    null id count together as one document, below all others. Rows repeated with the same id
    are one document. Other columns pass through; extra columns named n_lines or n_dropped are replaced.
    """
    spark = docs.sparkSession
    bare = docs.select("doc_id", "text")
    held = LineRuns(spark, min_chars)
    for b in batches(bare, n_batches):
        held.add(b)
    often = held.scratch.put(held.frequent(min_docs), "often")
    keyed = keyed_lines(bare, min_chars)
    # a line is in a document once at least, so n bounds its rows but for repeats within documents
    drop = join_heavy(keyed, often, ["h1", "h2"], "n").filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("top")))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    k1, k2, cut, lines = free_names(docs.columns, "r1", "r2", "cut", "lines")
    drop = drop.groupBy("r1", "r2").agg(F.collect_set("at").alias(cut)).withColumnsRenamed({"r1": k1, "r2": k2})
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    full = docs.select(*[quoted(c) for c in rest], r1.alias(k1), r2.alias(k2))
    out = full.join(drop, [k1, k2], "left").withColumn(lines, lines_of(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    text = F.when(F.col(cut).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return out.select(
        *[text.alias("text") if c == "text" else quoted(c) for c in rest],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col(cut).isNull(), F.lit(0)).otherwise(F.size(cut)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), often AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, pos, line, (top IS NOT NULL AND k.doc_id < top) AS cut FROM k LEFT JOIN often ON k.key = often.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
