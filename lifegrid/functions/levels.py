"""Order of category levels, reference level first."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Family:
    """Names that have an order: one pattern for each place in it, on the level in lower case without blanks and signs.
    ``column`` restricts the family to columns (or levels) whose name it is found in."""

    places: tuple[str, ...]
    column: str = ""

    def place(self, column: str, level: str) -> int | None:
        if self.column and not re.search(self.column, column) and not re.search(self.column, level):
            return None
        return next((k for k, p in enumerate(self.places) if re.search(p, level)), None)


def _whole(words: str) -> str:
    return f"^(?:{'|'.join(words.split())})$"


# The names of each family, in order.
STAGE = Family(tuple(f"^(?:stage)?{s}$" for s in ["0", *[number + letter for number in ("i", "ii", "iii", "iv") for letter in ("", "a", "b", "c")]]))
MUTATION = Family(("wildtype|^wt$", "mutated|mutant"))
CONTRAST = Family((_whole("negative neg no absent control reference baseline normal none"), _whole("positive pos yes present case abnormal")))
SEX = Family(("^female$", "^male$"), "sex|gender")
SMOKING = Family(("nonsmoker|neversmoker", "^former|formersmoker", "^current|currentsmoker"), "smok")
UNKNOWN = "unknown|missing|" + _whole("notavailable na")

#: In this order among each other, should one column mix them.
FAMILIES = (STAGE, MUTATION, CONTRAST, SEX, SMOKING)


def bare(name: object) -> str:
    return re.sub(r"[^a-z0-9]+", "", str(name).lower())


def level_key(column: str, value: object) -> tuple:
    """Sort key of a level: known families by their places, then other names by their text, unknown ones last."""
    level, name = bare(value), bare(column)
    if re.search(UNKNOWN, level):
        return (len(FAMILIES) + 1, 0, level)
    for rank, family in enumerate(FAMILIES):
        place = family.place(name, level)
        if place is not None:
            return (rank, place, level)
    return (len(FAMILIES), 0, str(value).strip().lower())


def ordered_levels(column: str, values: list) -> list[str]:
    """Levels in order; wholly numeric ones by value."""
    texts = [str(v) for v in values if v is not None]
    try:
        return sorted(texts, key=float)
    except ValueError:
        return sorted(texts, key=lambda v: level_key(column, v))
