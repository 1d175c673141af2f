"""One table of odd rows and clashing names through every operator, and through the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lifegrid.llm import alignment, linededup, merkle, mixing, neardup, neighbours, outliers, privacy, quality, sentencepieces, tokencount, tokenfiles

ROWS = [
    (1, "same text of six words here", "en", "src1"), (1, "same text of six words here", "en", "src1"), (2, "same text of six words here", "en", "src1"),
    (3, None, "en", "src1"), (4, "", None, None), (5, " \n\t", "de", "src2"), (None, "no id but me@mail.org in it", "en", "src2"), (None, None, None, None),
    (6, "x" * 40_000 + " " + "word " * 9_000, "en", "src3"),
]
#: Names that operators use inside, in other cases too, and names that need quotes.
CLASH = ["a.b", "odd name", "tick`ed", "r1", "R2", "_ids", "_text", "_cut", "_lines", "_spans", "_times", "_copy", "cut", "Lines", "spans", "times", "copy", "own", "c0", "c1", "part", "k", "h1", "n", "top", "given", "bucket", "epoch", "key"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).repartition(3).cache()


def through(df):
    """Pass-through operators: name, function, whether text stays."""
    return {
        "quality": (lambda d: quality.score_documents(d, None, keep_text=True), {"score", "predicted"}),
        "lines": (linededup.dedup_lines, {"n_lines", "n_dropped"}),
        "near": (neardup.keep_one, set()),
        "mix": (mixing.mix_documents, set()),
        "sanitise": (privacy.sanitise, set()),
        "counts": (tokencount.count_tokens, {"n_bytes", "n_tokens", "over_limit"}),
        "pieces": (lambda d: sentencepieces.encode_documents(d, giant=30_000), {"ids", "n_tokens", "ids_crc32", "round_trip"}),
    }


@pytest.mark.parametrize("name", list(through(None)))
def test_clashing_names_and_odd_rows(spark, odd, name):
    run, new = through(odd)[name]
    out = run(odd)
    drops = {"text"} if name in ("counts", "pieces") else set()
    assert set(out.columns) - new == set(odd.columns) - drops
    rows = out.collect()
    for r in rows:
        assert [r[c] for c in CLASH if c not in new] == [i for i, c in enumerate(CLASH) if c not in new]
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
    every = sorted(-1 if r[0] is None else r[0] for r in ROWS)
    if name == "near":
        assert ids == [i for i in every if i != 2]
    elif name == "mix":
        assert set(ids) <= {1, 2, 6, -1} and len(ids) >= 3
    else:
        assert ids == every
    assert run(odd.limit(0)).count() == 0


def test_own_results(spark, odd):
    """Operators that return tables of their own."""
    every = sorted(-1 if r[0] is None else r[0] for r in ROWS)
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
    assert ids(outliers.quality_outliers(odd)) == every
    assert ids(privacy.find_private(odd)) == every
    assert ids(neardup.near_duplicates(odd)) == every
    assert ids(tokenfiles.token_files(odd)) == every
    assert ids(alignment.align_documents(odd)) == every
    assert ids(merkle.manifest(odd, merkle.tampered_text()).verified()) == every
    vectors = odd.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("n_chars").cast("double")).alias("embedding"), "`a.b`", "r1", F.lit(1).alias("v"), F.lit(2).alias("dim"))
    found = neighbours.nearest(vectors, vectors.filter("vec_id = 1")).collect()
    assert {r.query_id for r in found} == {1} and [r.vec_id for r in sorted(found, key=lambda r: r["rank"])][:2] == [1, 2]


def test_pipeline_with_odd_rows_and_without_any(spark, odd, tmp_path):
    plain = odd.select(*[f"`{c}`" for c in odd.columns if c not in ("a.b", "odd name", "tick`ed", "R2")])
    plain.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r.doc_id for r in out} <= {1, 2, 6, None}
    plain.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
