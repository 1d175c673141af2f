"""Published cohorts by name. Their files aren't part of the library: they are read from a folder, given or named by LIFEGRID_COHORTS."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..errors import NotFoundError, UserInputError
from . import readers


@dataclass(frozen=True)
class Bundled:
    """What a cohort's file has to hold; which columns are its outcome."""

    title: str
    time: str
    event: str
    columns: tuple[str, ...]


# Names of the published columns.
COHORTS = {
    "gbsg2": Bundled("German Breast Cancer Study Group 2: recurrence-free survival", "rfs_days", "rfs_event", ("age", "estrec", "horTh", "menostat", "pnodes", "progrec", "tgrade", "tsize")),
    "tcga_luad": Bundled("TCGA lung adenocarcinoma: overall survival", "os_months", "os_event", ("age", "sex", "stage_group")),
}


def load(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """The cohort's table from NAME.csv in the folder, with its columns checked."""
    if name not in COHORTS:
        raise NotFoundError(f"unknown cohort {name}; one of {', '.join(COHORTS)}")
    folder = folder or os.environ.get("LIFEGRID_COHORTS")
    if not folder:
        raise NotFoundError(f"no folder of cohorts: put {name}.csv into one and name it in LIFEGRID_COHORTS")
    df, want = readers.load(spark, f"{folder.rstrip('/')}/{name}.csv"), COHORTS[name]
    missing = [c for c in (want.time, want.event, *want.columns) if c not in df.columns]
    if missing:
        raise UserInputError(f"{name}.csv lacks " + ", ".join(missing))
    return df
