"""The baseline cohort table: overall and by group, typed columns first, text last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import is_number


def _with_overall(df: DataFrame, group: str | None) -> DataFrame:
    """Each row under its group and under Overall, which holds the rows with a group. Expanded before the partial aggregation."""
    if not group:
        return df.withColumn("grp", F.lit("Overall"))
    g = F.col(f"`{group}`").cast("string")
    return df.filter(g.isNotNull()).withColumn("grp", F.explode(F.array(F.lit("Overall"), g)))


def numeric_table(df: DataFrame, variables: list[str], group: str | None = None) -> DataFrame:
    """grp, variable, n, missing, mean, sd (n - 1; 0 where not finite), median, q1, q3. Quantiles are exact."""
    rows = _with_overall(df.select(*variables, *([group] if group else [])), group)
    aggs = []
    for i, v in enumerate(variables):
        x = F.col(f"`{v}`").cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x.isNull().cast("long")).alias(f"m{i}"), F.avg(x).alias(f"a{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s{i}"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}")]
    one = rows.groupBy("grp").agg(*aggs)
    each = [F.struct(F.lit(v).alias("variable"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("missing"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("sd"), F.get(f"q{i}", 1).alias("median"), F.get(f"q{i}", 0).alias("q1"), F.get(f"q{i}", 2).alias("q3")) for i, v in enumerate(variables)]
    return one.select("grp", F.explode(F.array(*each)).alias("r")).select("grp", "r.*")


def categorical_table(df: DataFrame, variables: list[str], group: str | None = None) -> DataFrame:
    """grp, variable, level, n, denominator (the variable's non-missing rows), percent; 'Missing' rows have no percent."""
    rows = _with_overall(df.select(*variables, *([group] if group else [])), group)
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").cast("string").alias("level")) for v in variables]))
    n = rows.select("grp", pairs.alias("p")).groupBy("grp", "p.variable", "p.level").agg(F.count(F.lit(1)).alias("n"))
    total = n.filter(F.col("level").isNotNull()).groupBy("grp", "variable").agg(F.sum("n").alias("denominator"))
    both = n.join(total, ["grp", "variable"], "left")
    return both.select("grp", "variable", F.coalesce("level", F.lit("Missing")).alias("level"), "n", F.coalesce("denominator", F.lit(0)).alias("denominator"), F.when(F.col("level").isNotNull(), 100.0 * F.col("n") / F.col("denominator")).alias("percent"))


def table_one(df: DataFrame, variables: list[str], group: str | None = None) -> list[dict]:
    """The printed table: a row per variable or level, a column per group; numbers with two values count as categories."""
    from ..functions.levels import ordered_levels

    kinds = dict(df.dtypes)
    few = {v: df.select(v).dropna().distinct().limit(3).count() <= 2 for v in variables if is_number(kinds[v])}
    numeric, levels = [v for v in variables if few.get(v) is False], [v for v in variables if few.get(v) is not False]
    num = {(r.grp, r.variable): r for r in numeric_table(df, numeric, group).collect()} if numeric else {}
    cat = {(r.grp, r.variable, r.level): r for r in categorical_table(df, levels, group).collect()} if levels else {}
    counts = {r.grp: r["count"] for r in _with_overall(df, group).groupBy("grp").count().collect()}
    heads = ["Overall", *ordered_levels(group or "", [g for g in counts if g != "Overall"])]
    out = [{"Variable": "N", **{h: str(counts.get(h, 0)) for h in heads}}]
    for v in variables:
        if v in numeric:
            cells = {h: num.get((h, v)) for h in heads}
            out.append({"Variable": v, **{h: f"{c.mean:.2f} ± {c.sd:.2f} | {c.median:.2f} [{c.q1:.2f}, {c.q3:.2f}]" if c and c.n else "NA" for h, c in cells.items()}})
            if any(c and c.missing for c in cells.values()):
                out.append({"Variable": f"{v}: Missing", **{h: str(c.missing if c else 0) for h, c in cells.items()}})
            continue
        found = {k[2] for k in cat if k[1] == v}
        for level in [*ordered_levels(v, [x for x in found if x != "Missing"]), *(["Missing"] if "Missing" in found else [])]:
            cells = {h: cat.get((h, v, level)) for h in heads}
            out.append({"Variable": f"{v}: {level}", **{h: "0" + (" (0.0%)" if level != "Missing" else "") if not c else f"{c.n}" + (f" ({c.percent:.1f}%)" if c.percent is not None else "") for h, c in cells.items()}})
    return out
