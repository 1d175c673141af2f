"""A corpus pipeline over ``documents``: quality, lines, near duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifegrid.llm.common import Scratch, quoted, released, table
from lifegrid.llm.linededup import dedup_lines
from lifegrid.llm.mixing import mix_documents
from lifegrid.llm.neardup import keep_one
from lifegrid.llm.quality import score_documents, train
from lifegrid.llm.sentencepieces import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.3 go. Null texts are scored as empty ones; rows of null id are scored but not
    learnt from; repeated rows fare alike."""
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score_documents(docs, model, keep_text=True)
    return scored.filter("predicted = 1").select([quoted(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the one of the largest id; n_chars follows the text. A null text
    becomes an empty one; rows of null id count as one document below all others."""
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select([quoted(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id stays of each class of near duplicates. Texts without words and rows of null id stay."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the target weights; one taken in two epochs comes twice. Documents without words are never
    taken; null lang and source count as ''; of an id's repeated rows, or of null id, all come if one is taken."""
    return mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each document, and whether they decode to its text. A null text has no ids; null ids pass through."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("token_ids", token_ids)]
#: The first stage fits a model, which SQL can't express; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written before the next one reads it; what a stage left on disk goes once it is written,
    and its documents once the next stage has."""
    scratch = Scratch(spark, "pipeline")
    docs = None
    for name, stage in STAGES[:-1]:
        with released():
            new = scratch.put(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir), name)
        if docs is not None:
            scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
