"""Token ids as flat unsigned integer files with 64-bit document offsets.

The documents are dealt to partitions by ranges of doc_id; each partition's task encodes its
documents in order and writes one ``ids-*.bin``. The partitions' token totals are summed up in
order, which gives each its base; a second task per partition adds the base to its local
offsets, writes ``offsets-*.bin`` and reads the ids back through a memory map. Files are named by
the attempt that wrote them and taken from the rows that Spark committed, so a lost or
repeated task leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_side, table
from .pieces import Units, byte_units, default_path, groups, hold


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE of the tokenizers library; ids as little-endian bytes of the given type.

    New units that are one word of letters go straight to the library's BPE model, as its pattern would cut nothing
    in them; other units without a line end go to the library joined by line ends; what is left goes one by one.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.lib, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model, self.letters = self.lib.model, _byte_letters()
        self.space, self.code = self.letters[32], {2: "H", 4: "I"}[self.dtype.itemsize]
        (self.line,) = self.lib.encode("\n", add_special_tokens=False).ids
        self.units = Units(self.fresh, 600_000)

    def fresh(self, units: list[str]) -> list[bytes]:
        out: dict[str, list[int]] = {}
        lines, odd = [], []
        for u in units:
            word = u[1:] if u[:1] == " " else u
            if word.isalpha() and max(word) < "\u0250":
                raw = u.replace(" ", self.space) if u.isascii() else u.encode().decode("latin-1").translate(self.letters)
                out[u] = [t.id for t in self.model.tokenize(raw)]
            elif word.split() == [word]:
                lines.append(u)
            else:
                odd.append(u)
        if lines:
            ids = np.array(self.lib.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids)
            cuts = np.flatnonzero(ids == self.line)
            parts = np.split(ids, cuts)
            for u, part in zip(lines, [parts[0], *[x[1:] for x in parts[1:]]], strict=True):
                out[u] = part.tolist()
        for u, e in zip(odd, self.lib.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            out[u] = e.ids
        return [array(self.code, out[u]).tobytes() for u in units]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for a, b in groups(texts):
            units = [byte_units(t) if t else [] for t in texts[a:b]]
            self.units.load([u for us in units for u in us])
            out += [b"".join(self.units.values(us)) for us in units]
        return out


def _encoder(path: str, dtype: str) -> Encoder:
    return hold(("files", path, dtype), lambda: Encoder(path, dtype))


def open_folder(uri: str):
    """The file system and path of a URI; any store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def mapped(uri: str, name: str, dtype: str) -> np.ndarray:
    """A file's integers: memory-mapped where it is local, else read."""
    from pyarrow import fs

    store, folder = open_folder(uri)
    if isinstance(store, fs.LocalFileSystem):
        try:
            return np.memmap(f"{folder}/{name}", dtype=dtype, mode="r")
        except ValueError:  # an empty file can't be mapped
            return np.empty(0, dtype)
    with store.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, dtype: str = "<u2") -> DataFrame:
    """Writes the files into folder (a URI that all executors share); returns the committed rows of
    part, file, row, doc_id, n_tokens, as a lazily evaluated table to be written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        store, at = open_folder(folder)
        store.create_dir(at, recursive=True)
        encoder = _encoder(path or default_path("byte_bpe_50k.json"), dtype)
        end, size = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        name, row, sink = f"ids-{part:06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin", 0, None
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                sink = sink or store.open_output_stream(f"{at}/{name}")
                counts = []
                for ids in encoder.encode(b.column("text").to_pylist()):
                    sink.write(ids)
                    sink.write(end)
                    counts.append(len(ids) // size + 1)
                n = b.num_rows
                rows = pa.array(range(row, row + n), pa.int64())
                row += n
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([name] * n), rows, b.column("doc_id"), pa.array(counts, pa.int64())], ["part", "file", "row", "doc_id", "n_tokens"])
        finally:
            if sink is not None:
                sink.close()

    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, f"part int, file string, row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def bases(rows: DataFrame) -> DataFrame:
    """part, file, base: the tokens of all parts before. One row a partition goes through the window."""
    totals = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", "file", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def read_back(rows: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """Writes each part's offsets (64 bits, one more than documents) and reads every document from the maps."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.join(small_side(bases(rows)).withColumnRenamed("file", "_f"), "part").drop("_f")

    def read(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        name, base = t.column("file")[0].as_py(), t.column("base")[0].as_py()
        counts = t.column("n_tokens").to_numpy()
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8") + np.uint64(base)
        store, at = open_folder(folder)
        final = name.replace("ids-", "offsets-")
        with store.open_output_stream(f"{at}/{final}") as f:  # every attempt writes the same bytes
            f.write(offsets.tobytes())
        ids = mapped(folder, name, dtype)
        local = (offsets - np.uint64(base)).astype(np.int64)
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local[:-1], local[1:], strict=True)]
        return pa.table({"doc_id": t.column("doc_id"), "start": pa.array(offsets[:-1].astype(np.int64)), "n_tokens": t.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})

    return keyed.groupBy("part").applyInArrow(read, f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2, dtype: str = "<u2") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document as read back from its files.

    Order is ascending doc_id (nulls first, ties by text); repeated rows are written each. A null text is empty
    and has the end id alone. Other columns aren't read. An empty table writes no files and gives no rows.
    ids must fit dtype. folder defaults to one of its own below the session's shared folder.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    folder = folder or scratch.path("files")
    rows = scratch.put(write_token_files(docs, folder, path, end_id, dtype), "rows")
    return read_back(rows, folder, dtype)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
