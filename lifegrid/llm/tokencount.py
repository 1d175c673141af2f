"""Token counts by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets, and the tokens of each chunk's own encoding between its two
splices are counted. Two neighbours are spliced in their overlap at a boundary that both have and that is proven stable: a
token edge where the tokenizer cuts whatever stands around, with the same token before and after it in both. Such edges are behind white
space and where letters, digits and marks meet; they are found beforehand, and chunks begin and end at them. If an overlap
has no splice, it is widened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, numbered_schema, table
from .pieces import Units, default_path, groups, hold, word_units


#: Where the word BPE's pattern always cuts: behind a space or line end; between letters, digits and marks. What follows is no character that
#: composes with the one before, an apostrophe may begin a suffix with the letters behind it, and the lower case of U+0130 ends in a mark.
_EDGE = regex.compile(
    r"(?<=[ \n])(?=\S)|(?<=\p{L})(?=[0-9])|(?<=\p{N})(?=[A-Za-z0-9\u4E00-\u9FFF])|(?<=[\p{L}--\u0130])(?=[!-/:-@\[-`{-~])|(?<=\p{N})(?=[!-/:-@\[-`{-~])"
    r"|(?<=[!-&(-/:-@\[-`{-~\u3001-\u3029\uFF01-\uFF0F])(?=[A-Za-z0-9\u4E00-\u9FFF])",
    regex.V1,
)


class Counter:
    """Counts of one tokenizer file, with chunks of so many code points for texts beyond that."""

    def __init__(self, path: str, chunk: int, overlap: int):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.units = Units(lambda us: [len(e.ids) for e in self.lib.encode_batch_fast(us, add_special_tokens=False)])
        self.widened = 0

    def encoded(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a chunk encoded by itself: (start, end) in code points of the whole text, and ids."""
        e = self.lib.encode(text[start:end], add_special_tokens=False)
        return np.array(e.offsets, np.int64).reshape(-1, 2) + start, np.array(e.ids, np.int64)

    def count(self, texts: list[str | None]) -> list[int]:
        out = []
        for a, b in groups(texts):
            small = [word_units(t) if t and len(t) <= self.chunk else [] for t in texts[a:b]]
            self.units.load([u for us in small for u in us])
            counts = [sum(self.units.values(us)) for us in small]
            out += [self.spliced(t) if t and len(t) > self.chunk else c for t, c in zip(texts[a:b], counts, strict=True)]
        return out

    def edges(self, text: str) -> np.ndarray:
        """Positions where the tokenizer cuts whatever stands around, ascending; none is within a special token's string."""
        at = np.array([m.start() for m in _EDGE.finditer(text)], np.int64)
        for name in self.special:
            k = text.find(name)
            while k >= 0:
                at = at[(at <= k) | (at >= k + len(name))]
                k = text.find(name, k + 1)
        return at

    def spliced(self, text: str) -> int:
        """The tokens of each chunk's encoding between the splices at its two ends.

        A chunk ends at the first edge behind its size, and the next one begins at an edge before the overlap: a stretch without edges,
        however long, is encoded with its chunk once. If the overlap gives no splice, it begins an edge further back; where no edge is left, the chunks
        meet at the one between them.
        """
        n, edges = len(text), self.edges(text)
        reach = lambda p: n if (k := int(np.searchsorted(edges, p))) == len(edges) else int(edges[k])
        start, cut, total = 0, 0, 0
        end = reach(self.chunk)
        left = self.encoded(text, start, end)
        while end < n:
            lap, at = self.overlap, None
            while at is None:
                k = int(np.searchsorted(edges, end - lap, "right")) - 1
                if k < 0 or (begin := int(edges[k])) <= max(start, cut):
                    break
                stop = reach(begin + self.chunk + lap)
                right = self.encoded(text, begin, stop)
                at = self.splice(edges, left, right, begin, end)
                if at is None:
                    self.widened += 1
                    lap *= 2
            if at is None:
                at = begin = end
                stop = reach(begin + self.chunk)
                right = self.encoded(text, begin, stop)
            spans = left[0]
            total += int(((spans[:, 0] >= cut) & (spans[:, 0] < at)).sum())
            start, end, cut, left = begin, stop, at, right
        return total + int((left[0][:, 0] >= cut).sum())

    def splice(self, edges: np.ndarray, left: tuple, right: tuple, begin: int, end: int) -> int | None:
        """A stable boundary in the overlap [begin, end), nearest to its middle, or None; it is the start of a token."""

        def inside(side: tuple) -> list[tuple[int, int, int]]:
            spans, ids = side
            k = np.flatnonzero((spans[:, 0] >= begin) & (spans[:, 1] <= end))
            return [(int(a), int(b), int(i)) for (a, b), i in zip(spans[k], ids[k], strict=True)]

        mine, theirs = inside(left), inside(right)
        follows, proven = set(zip(mine, mine[1:], strict=False)), set(edges[np.searchsorted(edges, begin) : np.searchsorted(edges, end)].tolist())
        middle, best = (begin + end) // 2, None
        for pair in zip(theirs, theirs[1:], strict=False):
            a = pair[1][0]
            # neighbours in both encodings, with an edge between them
            if a in proven and pair in follows and (best is None or abs(a - middle) < abs(best - middle)):
                best = a
        return best


def _counter(path: str, chunk: int, overlap: int) -> Counter:
    return hold(("count", path, chunk, overlap), lambda: Counter(path, chunk, overlap))


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = 65_536, overlap: int = 512, limit: int = 2048) -> DataFrame:
    """docs (without text) plus n_bytes, n_tokens and over_limit.

    Counts are those of the tokenizers library for the whole text, without added tokens; texts of more than
    ``chunk`` code points are counted in overlapping chunks. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows give repeated rows; columns of docs named like the new ones are replaced; an empty table gives an empty one.
    """
    new = ["n_bytes", "n_tokens", "over_limit"]
    keep = [c for c in docs.columns if c != "text" and c not in new]
    rows = numbered(docs, keep, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path or default_path("word_bpe_49k.json"), chunk, overlap)
        for b in batches:
            texts = b.column("text").to_pylist()
            counts = counter.count(texts)
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            cols = [*b.columns[: len(keep)], pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[: len(keep)], *new])

    return rows.mapInArrow(run, numbered_schema(docs, keep, "n_bytes long", "n_tokens long", "over_limit boolean")).toDF(*keep, *new)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
