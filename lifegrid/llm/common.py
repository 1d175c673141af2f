"""What the corpus operators share: the scratch folder, sized broadcasts, small SQL helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: The white space of the word and line contracts: space and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows up to which a side may be broadcast; its row width is bounded by the caller.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder is used, which is right only for a local master; any other master is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lifegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written once under the shared folder, so that nothing behind them is computed twice.

    A written table survives lost executors, unlike cached blocks. ``drop`` frees a table
    early; what is left goes when the driver's Python ends, or a ``released`` block that it was made in.
    """

    all: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.open = True
        Scratch.all.append(self)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.remove(t._scratch_path)

    def remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self) -> None:
        if self.open:
            self.open = False
            try:
                self.remove(self.root)
            except Exception:  # the JVM may be gone by now
                pass


@contextmanager
def released() -> Iterator[None]:
    """Drops, at the end of the block, the scratch tables that operators made in it: for results that are written by then."""
    before = len(Scratch.all)
    try:
        yield
    finally:
        for s in Scratch.all[before:]:
            s.clear()
        del Scratch.all[before:]


@atexit.register
def _clear_all() -> None:
    for s in Scratch.all:
        s.clear()


def quoted(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that no taken one equals, in any case of letters."""
    low, out = {c.lower() for c in taken}, []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def numbered(df: DataFrame, keep: list[str], *extra: Column) -> DataFrame:
    """The kept columns as c0, c1, ... and the extra ones: what goes through Arrow code, which needs no names then."""
    return df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)], *extra)


def numbered_schema(df: DataFrame, keep: list[str], *new: str) -> StructType:
    """The schema of ``numbered`` and new fields, as Arrow code returns it; ``toDF`` then gives the names back."""
    return StructType([StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + StructType.fromDDL(", ".join(new)).fields)


def join_heavy(left: DataFrame, right: DataFrame, on: list[str], weight: str, heavy: int = 50_000) -> DataFrame:
    """An inner join with a written table of one row a key, where few keys may hold most rows of left.

    weight is how many rows of left a key has at most. A small right side is broadcast whole. Of a large one, the keys of at least
    1 / heavy of all weight are broadcast (there are at most ``heavy`` of them), so that no key
    of the rest, which is joined by a shuffle, holds more than that share.
    """
    whole = small_side(right)
    if whole is not right:
        return left.join(whole, on)
    least = (right.agg(F.sum(weight)).first()[0] or 0) / heavy
    big, rest = right.filter(F.col(weight) >= least), right.filter(F.col(weight) < least)
    return left.join(F.broadcast(big), on).unionByName(left.join(big.select(*on).hint("broadcast"), on, "left_anti").join(rest, on))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (materialised) table has at most so many rows, else the table as it is,
    which Spark then joins by shuffles that adaptive execution splits where keys are skewed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once for each row, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    flat = F.coalesce(text, F.lit(""))
    for c in BLANKS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def running_sum(xs: Column) -> Column:
    """Sums before each element of an array of longs, plus the whole sum at the end.

    Two levels of blocks of about sqrt(n) elements keep it at n * sqrt(n) steps in one row.
    """
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    return let(
        xs,
        lambda v: let(
            F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v).cast("double")))).cast("int"),
            lambda b: let(
                F.transform(F.sequence(F.lit(0), (F.size(v) / b).cast("int")), lambda k: F.aggregate(F.slice(v, k * b + 1, b), zero, add)),
                lambda blocks: let(
                    F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), lambda k: F.aggregate(F.slice(blocks, F.lit(1), k), zero, add)),
                    lambda base: F.transform(
                        F.sequence(F.lit(0), F.size(v)),
                        lambda i: F.element_at(base, (i / b).cast("int") + 1) + F.aggregate(F.slice(v, (i / b).cast("int") * b + 1, i % b), zero, add),
                    ),
                ),
            ),
        ),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
