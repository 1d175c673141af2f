"""A seeded Weibull proportional-hazards cohort of any size, drawn from row numbers on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, name: str) -> Column:
    """In (0, 1), from the row number alone, so partitions don't matter."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(2**52)) + 0.5) / float(2**52)


def _normal(seed: int, name: str) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, name + "/r"))) * F.cos(2 * F.pi() * _uniform(seed, name + "/a"))


def _choice(u: Column, shares: dict[str, float]) -> Column:
    out, upto = F.lit(list(shares)[-1]), 1.0
    for name in reversed(list(shares)[:-1]):
        upto = sum(list(shares.values())[: list(shares).index(name) + 1])
        out = F.when(u < upto, name).otherwise(out)
    return out


def make_cohort(spark: SparkSession, n: int = 360, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """patient_id, os and pfs times and events, age, sex, stage, treatment, smoking_status, biomarker_score, immune_index."""
    # The shares, means, spreads, risks and shapes of the distributions.
    u, z = (lambda name: _uniform(seed, name)), (lambda name: _normal(seed, name))
    age = F.round(F.greatest(F.lit(29.0), F.least(F.lit(87.0), 61.5 + 10.2 * z("age"))), 1)
    df = spark.range(0, n, 1, partitions or max(1, n // 1_000_000)).select(
        "id", age.alias("age"), _choice(u("sex"), {"Female": 0.44, "Male": 0.56}).alias("sex"),
        _choice(u("stage"), {"I": 0.16, "II": 0.30, "III": 0.34, "IV": 0.20}).alias("stage"), _choice(u("arm"), {"Standard": 0.52, "Combination": 0.48}).alias("treatment"),
        _choice(u("smoke"), {"Never": 0.43, "Former": 0.33, "Current": 0.24}).alias("_smoke"), F.round(z("bio"), 3).alias("biomarker_score"), F.round(0.4 + 0.9 * z("immune"), 3).alias("_immune"),
    )
    pick = lambda c, m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(c))
    lp = 0.028 * (F.col("age") - 60) + 0.48 * F.col("biomarker_score") - 0.24 * F.col("_immune") + pick("stage", {"I": 0.0, "II": 0.3, "III": 0.78, "IV": 1.2}) + pick("treatment", {"Standard": 0.0, "Combination": -0.36}) + pick("sex", {"Female": 0.0, "Male": 0.12}) + pick("_smoke", {"Never": 0.0, "Former": 0.16, "Current": 0.34})
    pfs = lp + 0.18 * F.col("biomarker_score") + 0.12 * (F.col("stage") == "IV").cast("double")
    weibull = lambda name, risk, shape, scale: scale * F.pow(-F.log(u(name)) / F.exp(risk), F.lit(1 / shape))
    df = df.withColumns({"_os": weibull("os", lp, 1.32, 39.0), "_pfs": weibull("pfs", pfs, 1.18, 24.0), "_c": 7 + 65 * u("censor")})
    time = lambda c: F.greatest(F.lit(0.01), F.round(F.least(F.col(c), F.col("_c")), 2))
    return df.select(
        F.concat(F.lit("PT-"), F.lpad((F.col("id") + 1).cast("string"), 4, "0") if n < 10_000 else (F.col("id") + 1).cast("string")).alias("patient_id"),
        time("_os").alias("os_months"), (F.col("_os") <= F.col("_c")).cast("int").alias("os_event"), time("_pfs").alias("pfs_months"), (F.col("_pfs") <= F.col("_c")).cast("int").alias("pfs_event"),
        "age", "sex", "stage", "treatment", F.when(u("gap1") >= 0.03, F.col("_smoke")).alias("smoking_status"), "biomarker_score", F.when(u("gap2") >= 0.05, F.col("_immune")).alias("immune_index"),
    )
