"""Places in a global order against plain sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifegrid.errors import UserInputError
from lifegrid.operators import positions


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, None if i % 50 == 7 else float(rng.integers(0, 9)), "hot" if i % 3 else [None, "b"][i % 2]) for i in range(301)]
    return spark.createDataFrame(data, "_row_id long, score double, g string").repartition(5), data


def plain(data, group=None):
    some = [d for d in data if d[2] == group] if group is not False else data
    return sorted(some, key=lambda d: (d[1] is not None, d[1] or 0, d[0]))


def test_numbered(spark, rows):
    df, data = rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        got = positions.numbered(df, ["g"], [F.col("score"), F.col("_row_id")]).collect()
        whole = positions.numbered(df, [], [F.col("score"), F.col("_row_id")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("hot", None, "b"):
        assert [r._row_id for r in sorted((r for r in got if r.g == g), key=lambda r: r.position)] == [d[0] for d in plain(data, g)]
        assert {r.size for r in got if r.g == g} == {len(plain(data, g))}
    assert [r._row_id for r in sorted(whole, key=lambda r: r.position)] == [d[0] for d in plain(data, False)]
    assert positions.numbered(df.limit(0), ["g"], [F.col("score")]).count() == 0


def test_representatives(rows):
    df, data = rows
    got = {(r.g, r.representative): r._row_id for r in positions.representatives(df, "score", ["g"]).collect()}
    for g in ("hot", None, "b"):
        some = [d for d in plain(data, g) if d[1] is not None]
        assert [got[g, n] for n in ("low", "median", "high")] == [some[0][0], some[len(some) // 2][0], some[-1][0]]
    one = positions.representatives(df.filter("_row_id = 3"), "score").collect()
    assert sorted(r.representative for r in one) == ["high", "low", "median"]


def test_even_subsample_and_chunks(rows):
    df, data = rows
    order = [d[0] for d in plain(data, False)]
    got = sorted(r._row_id for r in positions.even_subsample(df, "score", 40).collect())
    assert got == sorted(order[i] for i in np.round(np.linspace(0, 300, 40)).astype(int))
    assert positions.even_subsample(df, "score", 500).count() == 301
    chunks = {r._row_id: r.chunk for r in positions.equal_chunks(df, "score", 7).collect()}
    assert [chunks[i] for i in order] == [min(p // 43, 6) for p in range(301)]
    assert {r.chunk for r in positions.equal_chunks(df.limit(2), "score", 5).collect()} == {0, 1}
    for bad in (lambda: positions.even_subsample(df, "score", 0), lambda: positions.equal_chunks(df, "score", 0)):
        with pytest.raises(UserInputError):
            bad()
