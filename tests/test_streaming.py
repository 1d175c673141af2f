"""Curves over a stream equal those of all rows that have come."""

from pyspark.sql import functions as F

from lifegrid.operators import km
from lifegrid.streaming import km_state


def test_curves_follow_the_stream(spark, tmp_path):
    rows = spark.range(90).selectExpr("id as _row_id", "cast(1 + id % 13 as double) as time", "cast(id % 3 > 0 as int) as event", "concat('g', id % 2) as g")
    for i in range(3):
        rows.filter(F.col("_row_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = km_state.stream_curves(stream, ["g"], lambda df, n: seen.update({n: df.collect()}), f"{tmp_path}/checkpoint")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {(r.g, r.time): (r.n_risk, r.n_event, r.survival) for r in km.curve(rows, ["g"]).collect()}
    got = {(r.g, r.time): (r.n, r.d, r.surv) for r in seen[max(seen)] if r.d}
    assert got.keys() == want.keys() and all(abs(got[k][2] - want[k][2]) < 1e-12 and got[k][:2] == want[k][:2] for k in want)
