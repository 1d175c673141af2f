"""Loading a cohort table: format by suffix, delimiter and encoding by a look at the first bytes."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession

from ..errors import DependencyError, NotFoundError, UserInputError
from ..scratch import new_file

DELIMITED = (".csv", ".tsv", ".txt")


def unique_names(names: list[str]) -> list[str]:
    """Stripped names; blanks are 'unnamed', repeats (also in another case) get the next free _2, _3."""
    out: list[str] = []
    for n in names:
        base = str(n).strip() or "unnamed"
        name, k = base, 2
        while name.lower() in (x.lower() for x in out):
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


LOOK = 65_536


def _head(spark: SparkSession, path: str, n: int = LOOK) -> bytes:
    """The first bytes of a file, by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise NotFoundError(f"No such file: {path}")
    if fs.getFileStatus(at).isDirectory():
        raise UserInputError(f"{path} is a folder")
    s = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(s, n)))
    finally:
        s.close()


def sniff(head: bytes, suffix: str) -> tuple[str, str]:
    """(encoding, delimiter) from the first bytes."""
    if not head.strip():
        raise UserInputError("The file is empty.")
    encoding = "UTF-8"
    try:
        text = head.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        # a character may be cut at the end of the look
        if len(head) >= LOOK and e.start > len(head) - 4:
            text = head[: e.start].decode("utf-8-sig")
        else:
            encoding, text = "ISO-8859-1", head.decode("latin-1")
    if suffix == ".tsv":
        return encoding, "\t"
    line = text.splitlines()[0]
    try:
        return encoding, csv.Sniffer().sniff(line, delimiters=",;\t|").delimiter
    except csv.Error:
        return encoding, ","


def load(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, TSV, TXT, Parquet or (with openpyxl) Excel file as a DataFrame with clean, distinct column names."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".parquet":
        df = spark.read.parquet(path)
    elif suffix in DELIMITED:
        head = _head(spark, path)
        encoding, sep = sniff(head, suffix)
        df = spark.read.csv(path, header=True, inferSchema=True, sep=sep, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, escape='"')
        # Spark numbers repeated names in its own way, so they are taken from the file
        text = head.decode("utf-8-sig" if encoding == "UTF-8" else "latin-1", errors="ignore")
        names = next(csv.reader(text.splitlines(True), delimiter=sep), [])
        if len(names) == len(df.columns):
            df = df.toDF(*unique_names(names))
    elif suffix in (".xlsx", ".xls"):
        try:
            import openpyxl  # noqa: F401
            import pandas as pd
        except ImportError as e:
            raise DependencyError("Excel files need openpyxl") from e
        df = spark.createDataFrame(pd.read_excel(path))
    else:
        raise UserInputError(f"Unsupported file type {suffix or path}; use csv, tsv, txt, parquet or xlsx")
    if not df.columns:
        raise UserInputError("The table has no columns.")
    df = df.toDF(*unique_names(df.columns))
    if not df.limit(1).count():
        raise UserInputError("The table has no rows.")
    return df


#: Bytes of an upload. Fixed value.
MAX_UPLOAD = 200 * 1024 * 1024


def load_bytes(spark: SparkSession, content: bytes, name: str) -> DataFrame:
    """A table from an uploaded file's bytes, whose kind follows from its name; it is written below the shared folder, so that tasks can read it."""
    if not content.strip():
        raise UserInputError("The file is empty.")
    if len(content) > MAX_UPLOAD:
        raise UserInputError(f"The file is larger than {MAX_UPLOAD // 1024**2} MB.")
    suffix = os.path.splitext(os.path.basename(name))[1].lower()
    return load(spark, new_file(spark, content, suffix))
