"""Search of AND / OR rules over candidate indicators.

Rows shrink to cells of (time, event, bit pattern of the indicators) with counts; the cells are what tasks get.
Rules are index tuples listed on the driver; each batch of rules is scored, resampled and permuted in a task, with draws
seeded by the rule, so results don't depend on the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from ..functions.levels import ordered_levels
from ..functions.stats import chi2_upper, normal_quantile
from ..scratch import written
from . import local
from .patterns import Patterns
from .profile import is_number

MAX_RULES = 5000
MAX_LEVELS = 8
#: Cells and indicators up to which tasks get all cells and share out the rules; larger searches share out the cells (``patterns``).
TASK_CELLS, TASK_INDICATORS = 2_000_000, 62


@dataclass(frozen=True)
class Indicator:
    column: str
    label: str
    op: str
    value: object

    def test(self) -> Column:
        c = F.col(f"`{self.column}`")
        return c > self.value if self.op == ">" else c.cast("string") == self.value


def indicators(df: DataFrame, columns: list[str], least: int) -> list[Indicator]:
    """Numeric columns above their quartiles (equal ones once), categorical ones of at most 8 levels against the most
    frequent level; both sides need at least so many rows."""
    kinds, found = dict(df.dtypes), []
    nums = [c for c in columns if is_number(kinds[c]) and kinds[c] != "boolean"]
    if nums:
        r = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, c in enumerate(nums)]).first()
        found += [Indicator(c, f"{c} > {q:g}", ">", float(q)) for i, c in enumerate(nums) for q in sorted({round(x, 10) for x in r[f"q{i}"] or []})]
    for c in [c for c in columns if c not in nums]:
        counts = df.groupBy(F.col(f"`{c}`").cast("string").alias("v")).count().dropna().orderBy(F.desc("count"), "v").limit(MAX_LEVELS + 1).collect()
        if 2 <= len(counts) <= MAX_LEVELS:
            found += [Indicator(c, f"{c} = {v}", "=", v) for v in ordered_levels(c, [r.v for r in counts]) if v != counts[0].v]
    if not found:
        return []
    r = df.agg(*[F.sum(x.test().cast("long")).alias(f"a{i}") for i, x in enumerate(found)], *[F.sum((~x.test()).cast("long")).alias(f"b{i}") for i, x in enumerate(found)]).first()
    order = {c: i for i, c in enumerate(columns)}
    return sorted((x for i, x in enumerate(found) if min(r[f"a{i}"] or 0, r[f"b{i}"] or 0) >= least), key=lambda x: order[x.column])


def rules(found: list[Indicator], size: int, operator: str = "mixed") -> list[tuple[tuple[int, ...], str]]:
    """Index tuples over distinct columns with AND or OR, in input order, at most 5,000."""
    out = []
    for k in range(1, size + 1):
        for combo in combinations(range(len(found)), k):
            if len({found[i].column for i in combo}) < k:
                continue
            for op in ["AND"] if k == 1 else ["AND", "OR"] if operator == "mixed" else [operator.upper()]:
                out.append((combo, op))
                if len(out) >= MAX_RULES:
                    return out
    return out


def cells(cohort: DataFrame, found: list[Indicator]) -> pd.DataFrame | None:
    """time, event, bits, k, or None where they are too many for a task. Rows with a null in any candidate column are left out."""
    if len(found) > TASK_INDICATORS:
        return None
    bits = F.lit(0).cast("long")
    for i, x in enumerate(found):
        bits = bits + F.when(x.test(), F.lit(1 << i).cast("long")).otherwise(F.when(x.test().isNotNull(), F.lit(0).cast("long")))
    t = cohort.select("time", "event", bits.alias("bits")).filter(F.col("bits").isNotNull()).groupBy("time", "event", "bits").agg(F.count(F.lit(1)).alias("k"))
    t = written(t)
    if t.count() > TASK_CELLS:
        return None
    return t.orderBy("time", "event", "bits").toPandas()


def rule_mask(bits: np.ndarray, combo: tuple[int, ...], op: str) -> np.ndarray:
    want = sum(1 << i for i in combo)
    return (bits & want) == want if op == "AND" else (bits & want) != 0


def _hazard_ratio(time, event, mask, weight) -> tuple[float, float, float] | None:
    got = local.cox_newton(mask.astype(float)[:, None], time, event, weight)
    if got is None:
        return None
    b, se = float(got[0][0]), math.sqrt(float(got[1][0, 0]))
    z = normal_quantile(0.975)
    return tuple(math.exp(max(-700, min(700, v))) for v in (b, b - z * se, b + z * se))


def score_rules(c: pd.DataFrame, some: list[tuple[int, tuple[int, ...], str]], least: int, least_events: int) -> list[dict]:
    t, e, bits, k = c.time.to_numpy(float), c.event.to_numpy(int), c.bits.to_numpy(np.int64), c.k.to_numpy(float)
    out = []
    for rid, combo, op in some:
        m = rule_mask(bits, combo, op)
        n1, d1 = k[m].sum(), (k * e)[m].sum()
        n0, d0 = k.sum() - n1, (k * e).sum() - d1
        if min(n0, n1) < least or min(d0, d1) < least_events:
            continue
        chisq = local.logrank(t, e, m, k)
        out.append({"rule_id": rid, "n_in": int(n1), "events_in": int(d1), "n_out": int(n0), "events_out": int(d0), "chisq": chisq, "p_value": chi2_upper(chisq, 1), "median_in": local.median_time(t[m], e[m], k[m]), "median_out": local.median_time(t[~m], e[~m], k[~m])})
    return out


def resample_rule(c: pd.DataFrame, rid: int, combo: tuple[int, ...], op: str, how: dict) -> dict:
    """Cox ratio, bootstrap support, permutation p and validation support of one rule."""
    t, e, bits, k = c.time.to_numpy(float), c.event.to_numpy(int), c.bits.to_numpy(np.int64), c.k.to_numpy(np.int64)
    m, n, alpha = rule_mask(bits, combo, op), int(c.k.sum()), how["alpha"]
    base = _hazard_ratio(t, e, m, k.astype(float))
    out = {"rule_id": rid, "hazard_ratio": base and base[0], "ci_lower": base and base[1], "ci_upper": base and base[2]}

    def enough(w: np.ndarray) -> bool:
        return min(w[m].sum(), w[~m].sum()) >= how["least"] * w.sum() / n and min((w * e)[m].sum(), (w * e)[~m].sum()) >= 1

    def support(draw, rounds: int, strict: bool) -> tuple[float | None, float | None, int]:
        hits = same = done = 0
        for i in range(rounds):
            w = draw(i).astype(float)
            if not enough(w):
                continue
            keep = w > 0
            p, hr = chi2_upper(local.logrank(t[keep], e[keep], m[keep], w[keep]), 1), _hazard_ratio(t[keep], e[keep], m[keep], w[keep])
            if hr is None:
                continue
            done += 1
            hits += (p <= alpha and (hr[1] > 1 or hr[2] < 1)) if strict else p < alpha
            same += base is not None and (hr[0] > 1) == (base[0] > 1)
        return (hits / done, same / done, rounds - done) if done else (None, None, rounds)

    rng = lambda kind, i: np.random.default_rng([how["seed"], kind, rid, i])
    boot = lambda i: rng(1, i).multinomial(max(1, int(how["bootstrap_fraction"] * n)), k / n)
    part = lambda i: rng(2, i).multivariate_hypergeometric(k, max(1, int(how["validation_fraction"] * n)), method="marginals")
    out["bootstrap_support"], out["direction"], out["bootstrap_skipped"] = support(boot, how["bootstrap"], False)
    out["validation_support"], _, out["validation_skipped"] = support(part, how["validation"], True)
    if how["permutations"]:
        seen, size = local.logrank(t, e, m, k.astype(float)), int(k[m].sum())
        stats = []
        for i in range(how["permutations"]):
            inside = rng(3, i).multivariate_hypergeometric(k, size, method="marginals")
            tt, ee, ww = np.concatenate([t, t]), np.concatenate([e, e]), np.concatenate([inside, k - inside]).astype(float)
            stats.append(local.logrank(tt, ee, np.arange(len(tt)) < len(t), ww))
        out["permutation_p"] = (sum(s >= seen - 1e-9 for s in stats) + 1) / (len(stats) + 1)
    else:
        out["permutation_p"] = None
    return out


def stability_score(row: dict, size: int) -> float:
    """Evidence, effect and support, less a price for length and a weak permutation p."""
    # The coefficients.
    bh, hr = row["p_adjusted"], row.get("hazard_ratio")
    score = min(-math.log10(max(bh, 1e-300)), 10.0)
    score += 0.35 * abs(math.log(hr)) if hr and hr > 0 else 0.0
    score += 0.85 * (row.get("bootstrap_support") or 0) + 0.55 * (row.get("direction") or 0) + 1.05 * (row.get("validation_support") or 0)
    return score - 0.18 * (size - 1) - 0.65 * max((row.get("permutation_p") or 0.0) - 0.05, 0.0)


def is_significant(row: dict, how: dict) -> bool:
    ci = row.get("ci_lower") is not None and (row["ci_lower"] > 1 or row["ci_upper"] < 1)
    ok = row["p_adjusted"] <= how["alpha"] and ci
    if how["permutations"]:
        ok = ok and row["permutation_p"] is not None and row["permutation_p"] <= how["alpha"]
    if how["bootstrap"]:
        ok = ok and (row["direction"] or 0) >= 0.6
    if how["validation"]:
        ok = ok and (row["validation_support"] or 0) >= 0.5
    return bool(ok)


def rule_table(cohort: DataFrame, columns: list[str], size: int = 2, min_fraction: float = 0.1, operator: str = "mixed") -> tuple[DataFrame, list[Indicator], list, pd.DataFrame | Patterns, int]:
    """The scored rules: rule_id, rule, n_in, events_in, n_out, events_out, chisq, p_value, medians; and what they were scored on, cells or
    ``Patterns``, which the caller releases."""
    if not 1 <= size <= 4 or not 0.02 <= min_fraction <= 0.45:
        raise UserInputError("rules have 1 to 4 parts and a group fraction between 0.02 and 0.45")
    whole = cohort.dropna(subset=columns)
    n = whole.count()
    least, least_events = max(8, math.ceil(n * min_fraction)), max(3, math.ceil(0.03 * n))
    found = indicators(whole, columns, least)
    todo = rules(found, size, operator)
    if not todo:
        raise UserInputError("no candidate indicator has enough rows on both sides")
    c = cells(whole, found)
    spark = cohort.sparkSession
    schema = "rule_id long, n_in long, events_in long, n_out long, events_out long, chisq double, p_value double, median_in double, median_out double"
    names = spark.createDataFrame([(i, f" {op} ".join(found[j].label for j in combo), len(combo)) for i, (combo, op) in enumerate(todo)], "rule_id long, rule string, size int")
    if c is None:
        c = Patterns(whole, [x.test() for x in found])
        rows = [tuple(r.values()) for r in c.score(todo, least, least_events)]
        return spark.createDataFrame(rows, schema).join(F.broadcast(names), "rule_id"), found, todo, c, least

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = score_rules(c, [(int(i), *todo[int(i)]) for i in b.id], least, least_events)
            yield pd.DataFrame(rows, columns=["rule_id", "n_in", "events_in", "n_out", "events_out", "chisq", "p_value", "median_in", "median_out"])

    parts = max(1, min(64, len(todo) // 16))
    got = spark.range(0, len(todo), 1, parts).mapInPandas(run, schema)
    return got.join(F.broadcast(names), "rule_id"), found, todo, c, least


def discover(cohort: DataFrame, columns: list[str], size: int = 2, top_k: int = 10, min_fraction: float = 0.1, operator: str = "mixed", bootstrap: int = 30, permutations: int = 100, validation: int = 20, alpha: float = 0.05, bootstrap_fraction: float = 1.0, validation_fraction: float = 0.5, seed: int = 42) -> dict:
    """The ranked rules. All are scored and adjusted; the costly resampling is for the best max(80, 4 top_k) and all nominally
    significant ones. Ranked by significance, stability score, adjusted p, p."""
    if not 3 <= top_k <= 50 or bootstrap > 120 or permutations > 400 or validation > 80:
        raise UserInputError("top_k 3 to 50, at most 120 bootstraps, 400 permutations, 80 validations")
    from ..functions.stats import bh_adjust

    table, found, todo, c, least = rule_table(cohort, columns, size, min_fraction, operator)
    rows = [r.asDict() for r in table.orderBy("rule_id").collect()]
    for r, p in zip(rows, bh_adjust([r["p_value"] for r in rows]), strict=True):
        r["p_adjusted"] = p
    rows.sort(key=lambda r: (r["p_adjusted"], r["p_value"], -r["chisq"], r["rule_id"]))
    chosen = rows[: max(80, 4 * top_k)] + [r for r in rows[max(80, 4 * top_k) :] if r["p_value"] <= alpha]
    how = {"alpha": alpha, "bootstrap": bootstrap, "permutations": permutations, "validation": validation, "bootstrap_fraction": bootstrap_fraction, "validation_fraction": validation_fraction, "seed": seed, "least": least}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([resample_rule(c, int(i), *todo[int(i)], how) for i in b.rule_id])

    spark = cohort.sparkSession
    if isinstance(c, Patterns):
        more = c.resample([(r["rule_id"], todo[r["rule_id"]]) for r in chosen], how)
        c.release()
        return ranked(rows, chosen, more, how, top_k, found, todo)
    ids = spark.createDataFrame([(r["rule_id"],) for r in chosen], "rule_id long").repartition(max(1, min(64, len(chosen))), "rule_id")
    schema = "rule_id long, hazard_ratio double, ci_lower double, ci_upper double, bootstrap_support double, direction double, bootstrap_skipped long, validation_support double, validation_skipped long, permutation_p double"
    more = {r.rule_id: r.asDict() for r in ids.mapInPandas(run, schema).collect()}
    return ranked(rows, chosen, more, how, top_k, found, todo)


def ranked(rows: list[dict], chosen: list[dict], more: dict[int, dict], how: dict, top_k: int, found: list[Indicator], todo: list) -> dict:
    """The result of a search from the scored rules, the chosen ones and what resampling says of these."""
    for r in chosen:
        r |= {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in more[r["rule_id"]].items()}
        r["stability"] = stability_score(r, r["size"])
        r["significant"] = is_significant(r, how)
    chosen.sort(key=lambda r: (not r["significant"], -r["stability"], r["p_adjusted"], r["p_value"], r["rule_id"]))
    return {"rules": chosen[:top_k], "tested": len(rows), "truncated": len(todo) >= MAX_RULES, "indicators": [x.label for x in found], "_found": found, "_todo": todo}


def apply_rule(df: DataFrame, result: dict, rank: int = 0, new: str = "signature") -> DataFrame:
    """df with the rule's label, Signature+ or Signature-; null if any of its inputs is null, also for OR."""
    combo, op = result["_todo"][result["rules"][rank]["rule_id"]]
    tests = [result["_found"][i].test() for i in combo]
    known, hit = tests[0].isNotNull(), tests[0]
    for t in tests[1:]:
        known, hit = known & t.isNotNull(), (hit & t) if op == "AND" else (hit | t)
    return df.withColumn(new, F.when(known, F.when(hit, "Signature+").otherwise("Signature-")))
