"""Public tokenizers applied through a store of already encoded units.

A text is cut into units at places where the tokenizer always cuts, whatever stands around
them; each distinct unit is encoded once by the library and its ids are kept in the worker.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units in a generation of a worker's store; it keeps two.
KEEP = 400_000
#: Longer units are not kept.
KEEP_CHARS = 64
#: Code points of texts whose units are looked up together.
GROUP_CHARS = 500_000


_held: dict = {}


def hold(key: tuple, make):
    """What a worker keeps between tasks: the one thing made last, so that operators that follow each other in the
    same worker don't pile up their stores."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Units:
    """unit -> value, with the library asked for the units not seen lately.

    Two generations: what is used moves to the young one; when that is full it becomes the old one.
    """

    def __init__(self, encode, keep: int = KEEP):
        self.encode, self.keep, self.young, self.old, self.long = encode, keep, {}, {}, []

    def load(self, units: list[str]) -> None:
        """Makes the values of these units available to ``values``."""
        for u in self.long:
            del self.young[u]
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for u in set(units):
            if u not in young:
                if (v := old.get(u)) is None:
                    new.append(u)
                else:
                    young[u] = v
        young.update(zip(new, self.encode(new), strict=True))
        self.long = [u for u in new if len(u) > KEEP_CHARS]

    def values(self, units: list[str]):
        return map(self.young.__getitem__, units)


def groups(texts: list[str | None]) -> list[tuple[int, int]]:
    """Ranges of texts of about GROUP_CHARS together, one text at least."""
    out, start, chars = [], 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= GROUP_CHARS:
            out.append((start, i + 1))
            start, chars = i + 1, 0
    return [*out, (start, len(texts))] if start < len(texts) else out


#: Where byte-level BPE always cuts: before a space with no white space at either side.
_SPACE_EDGE = re.compile(r"(?<=\S)(?= \S)")


def evenly_spaced(text: str) -> bool:
    """Whether all white space is single spaces and line ends between other characters."""
    return " ".join(text.split()) == text.replace("\n", " ") != ""


def byte_units(text: str) -> list[str]:
    """Units of the byte-level BPE pattern: parts before a space, and before a full stop or comma between a letter
    or digit and a space. Within a run of white space, and next to other white space than one space, nothing is cut."""
    if not evenly_spaced(text) or "\0" in text:
        return _SPACE_EDGE.split(text)
    cut = text
    for mark in (". ", ", "):
        if all(part[-1:].isalnum() for part in text.split(mark)[:-1]):  # else the mark may belong to those before it
            cut = cut.replace(mark, "\0" + mark)
    return cut.replace(" ", "\0 ").split("\0")


def word_units(text: str) -> list[str]:
    """Units of the lower-casing word BPE, which drops white space: parts between spaces and line ends."""
    return [w for w in text.replace("\n", " ").split(" ") if w]
