"""Quality rules by robust multivariate outliers (DataFrame functions only).

Every text gets a few statistics. Texts that pass the fixed base rules are judged against the
others of their language and source: a minimum-covariance-determinant (MCD) estimate of centre
and scatter of the transformed statistics is found by concentration steps from several deterministic
starts, of which the least determinant wins and goes on until its determinant falls no more. It is reweighted once, and
texts whose squared Mahalanobis distance exceeds a chi-square quantile are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, let, small_side, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Least standard deviation of each transformed statistic, added to every scatter estimate:
#: what differs less from the centre than a few of these is never an outlier. Each is small enough that
#: its statistic can reject alone among the texts that pass the base rules.
FLOORS = {"len": 0.03, "sym": 0.025, "dup": 0.02, "rep": 0.05}
DIMS = list(FLOORS)
P = range(len(DIMS))
#: A start: medians with quartile distances; correlations of the hyperbolic tangents of standardised statistics; of their spatial signs;
#: and those of the half of the rows next to the medians.
STARTS = ["quartiles", "tanh", "signs", "central"]


def chi2_cdf(x: float, df: float) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= y / k
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi2_quantile(p: float, df: float) -> float:
    lo, hi = 0.0, 10.0
    while chi2_cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < p else (lo, mid)
    return hi


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the text holds twice or more; the first such window counts too."""
    n = F.size(words)
    window = lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)])
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), window)).otherwise(F.expr("array(bigint(0))"))

    def covered(h: Column) -> Column:
        sorted_ = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.get(s, j + 1)["h"] == x["h"], F.get(s, j - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

        def width(p: Column) -> Column:
            step = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(sorted_, lambda s: let(starts(s), width)))

    return let(hashes, covered)


def text_stats(text: Column) -> Column:
    """A struct of the statistics of a text; a null text has no words."""
    full = F.coalesce(text, F.lit(""))
    bare = full
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(full, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(full) - F.length(bare)).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def transformed() -> dict[str, Column]:
    """The statistics as rates, on scales where good text is near symmetric."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "len": F.log(chars / words),
        "sym": F.sqrt(F.col("n_symbols") / chars),
        "dup": F.sqrt(F.col("n_dup_lines") / words),
        "rep": F.sqrt(F.col("n_repeat_words") / words),
    }


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]


def _whitened(params: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """From m0.. and c00.. of each group to m0.., the inverse w00.. of the Cholesky factor and ln_det."""
    t = params
    for i in P:
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            t = t.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in P:
        for j in range(i + 1):
            value = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            t = t.withColumn(f"w{i}{j}", value / F.col(f"l{i}{i}"))
    ln_det = sum((F.log(F.col(f"l{i}{i}")) for i in P), F.lit(0.0)) * 2
    return t.select(*keys, *more, *[f"m{i}" for i in P], *[f"w{i}{j}" for i, j in _pairs()], ln_det.alias("ln_det"))


def _distance(rows: DataFrame, params: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, for each estimate of their group; null where the group has none."""
    both = rows.join(small_side(params), ["g1", "g2"], "left")
    d2 = F.lit(0.0)
    for i in P:
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(DIMS[j]) - F.col(f"m{j}"))
        d2 = d2 + y * y
    return both.select(*rows.columns, *[c for c in params.columns if c == "start"], d2.alias("d2"))


def _moments(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre and scatter of each group; factor makes the scatter of a central part that of the whole."""
    sums = [F.avg(d).alias(f"m{i}") for i, d in enumerate(DIMS)] + [F.avg(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"s{i}{j}") for i, j in _pairs()]
    t = rows.groupBy(*keys).agg(*sums)
    cov = []
    for i, j in _pairs():
        c = (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
        cov.append((F.greatest(c, F.lit(0.0)) + FLOORS[DIMS[i]] ** 2 if i == j else c).alias(f"c{i}{j}"))
    return t.select(*keys, *[f"m{i}" for i in P], *cov)


def _starts(good: DataFrame, scratch: Scratch, min_rows: int) -> DataFrame:
    """Whitened first estimates of every group with min_rows rows, by start."""
    spread = lambda d, q: F.percentile(F.round(F.col(d), 3), F.lit(q))
    mid = good.groupBy("g1", "g2").agg(
        *[spread(d, 0.5).alias(f"m{i}") for i, d in enumerate(DIMS)],
        *[(F.pow((spread(d, 0.75) - spread(d, 0.25)) / 1.349, 2.0) + FLOORS[d] ** 2).alias(f"v{i}") for i, d in enumerate(DIMS)],
        F.count("*").alias("n"),
    )
    mid = scratch.put(mid.filter(F.col("n") >= min_rows), "medians")
    z = [(F.col(d) - F.col(f"m{i}")) / F.sqrt(f"v{i}") for i, d in enumerate(DIMS)]
    at = good.join(small_side(mid), ["g1", "g2"]).select("g1", "g2", *[x.alias(f"z{i}") for i, x in enumerate(z)])
    norm2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in P), F.lit(0.0))
    at = at.withColumn("ln", F.round(F.log(norm2 + 1e-9), 2))
    half = at.groupBy("g1", "g2").agg(F.percentile("ln", F.lit(0.5)).alias("half"))
    near = F.when(F.col("ln") <= F.col("half"), 1.0)
    size = F.sqrt(norm2 + 1e-12)
    shapes = {"tanh": lambda i: F.tanh(f"z{i}"), "signs": lambda i: F.col(f"z{i}") / size, "central": lambda i: F.col(f"z{i}") * near}
    sums = [F.avg(f(i) * f(j)).alias(f"{k}{i}{j}") for k, f in shapes.items() for i, j in _pairs()]
    sums = scratch.put(at.join(small_side(scratch.put(half, "half")), ["g1", "g2"]).groupBy("g1", "g2").agg(*sums), "shapes").join(mid, ["g1", "g2"])
    out = None
    for k in STARTS:
        cov = []
        for i, j in _pairs():
            # a correlation of these, at most 0.95 so that it stays a scatter, on the scale of the quartile distances
            r = F.lit(0.0) if k == "quartiles" else F.coalesce(F.col(f"{k}{i}{j}") / F.nullif(F.sqrt(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}")), F.lit(0.0)), F.lit(0.0)) * 0.95
            cov.append((F.col(f"v{i}") if i == j else r * F.sqrt(F.col(f"v{i}") * F.col(f"v{j}"))).alias(f"c{i}{j}"))
        one = sums.select("g1", "g2", F.lit(k).alias("start"), *[f"m{i}" for i in P], *cov)
        out = one if out is None else out.unionByName(one)
    return scratch.put(_whitened(out, ["g1", "g2", "start"]), "starts")


def least_scatter(good: DataFrame, scratch: Scratch, h: float = 0.75, first_steps: int = 2, min_rows: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """g1, g2 and the whitened estimate of least determinant among the concentration steps from all starts.

    A step takes distances from the current estimate, the h-quantile of them (exact on logarithms rounded to 0.01, so its
    state stays small), then the moments of the rows within. Every start makes first_steps of them; the best one of each group
    goes on until its log-determinant falls by less than tolerance.
    """
    q = len(DIMS)
    factor = h / chi2_cdf(chi2_quantile(h, q), q + 2)

    def step(params: DataFrame, keys: list[str]) -> DataFrame:
        at = _distance(good.join(small_side(params.select("g1", "g2").distinct()), ["g1", "g2"], "left_semi"), params).withColumn("ln_d2", F.round(F.log(F.col("d2") + 1e-9), 2))
        limit = scratch.put(at.groupBy(*keys).agg(F.percentile("ln_d2", F.lit(h)).alias("limit")), "limit")
        core = at.join(small_side(limit), keys).filter(F.col("ln_d2") <= F.col("limit"))
        return scratch.put(_whitened(_moments(core, keys, factor), keys), "step")

    params = _starts(good, scratch, min_rows)
    for _ in range(first_steps):
        params = step(params, ["g1", "g2", "start"])
    # equal determinants: the start that is first by name
    best = params.groupBy("g1", "g2").agg(F.min_by(F.struct(*[c for c in params.columns if c not in ("g1", "g2", "start")]), F.struct(F.round("ln_det", 6), "start")).alias("best"))
    done = best = scratch.put(best.select("g1", "g2", "best.*"), "best")
    keys = ["g1", "g2"]
    while best.limit(1).count():
        new = step(best, keys)
        lower = new.join(best.select(*keys, F.col("ln_det").alias("was")), keys).filter(F.col("ln_det") < F.col("was") - tolerance).drop("was")
        best = scratch.put(lower, "lower")
        done = scratch.put(done.join(best.select(*keys), keys, "left_anti").unionByName(best), "done")
    return done


def judge(stats: DataFrame, alpha: float = 1e-3, h: float = 0.75, min_rows: int = 100) -> DataFrame:
    """Adds base_failed, d2 and kept to a written table of doc_id, lang, source and STATS.

    Rows that pass the base rules are estimated per (lang, source). Sources with fewer than
    min_rows such rows are judged by all such rows of their language, and where these are fewer too, by those of
    the whole table; only a table of fewer rejects nothing beyond the base rules. Null lang or source form
    groups of their own.
    """
    spark = stats.sparkSession
    scratch = Scratch(spark, "mcd")
    base = F.coalesce((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), F.lit(True))
    rows = stats.withColumn("base_failed", base)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = rows.withColumns({"k1": key("lang"), "k2": key("source")})
    counts = rows.filter(~F.col("base_failed")).groupBy("k1", "k2").count()
    # the group that judges a row, and the groups that it is an observation of
    sums = counts.join(counts.groupBy("k1").agg(F.sum("count").alias("of_lang")), "k1")
    own = F.col("count") >= min_rows
    sums = sums.withColumn("g1", F.when(own | (F.col("of_lang") >= min_rows), F.col("k1")).otherwise("*")).withColumn("g2", F.when(own, F.col("k2")).otherwise("*"))
    home = scratch.put(sums.select("k1", "k2", "g1", "g2"), "home")
    used = home.select("g1", "g2").distinct()
    joins = ((F.col("x1") == F.col("g1")) | (F.col("g1") == "*")) & ((F.col("x2") == F.col("g2")) | (F.col("g2") == "*"))
    feeds = scratch.put(home.select(F.col("k1").alias("x1"), F.col("k2").alias("x2")).join(F.broadcast(used.filter("g2 = '*'")), joins)
                        .unionByName(home.filter("g2 <> '*'").select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), "g1", "g2")), "feeds")
    rows = rows.join(small_side(home), ["k1", "k2"], "left").withColumns(transformed())
    good = rows.filter(~F.col("base_failed")).drop("g1", "g2").join(small_side(feeds.withColumnsRenamed({"x1": "k1", "x2": "k2"})), ["k1", "k2"]).drop("k1", "k2")
    rows = rows.drop("k1", "k2")
    good = scratch.put(good.select("g1", "g2", *DIMS), "good")
    params = least_scatter(good, scratch, h, min_rows=min_rows)
    # one reweighting by all rows that are not extreme under the raw estimate
    p = len(DIMS)
    near = _distance(good, params).filter(F.col("d2") <= chi2_quantile(0.975, p))
    factor = 0.975 / chi2_cdf(chi2_quantile(0.975, p), p + 2)
    params = scratch.put(_whitened(_moments(near, ["g1", "g2"], factor), ["g1", "g2"]), "params")
    out = _distance(rows, params)
    verdict = ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= chi2_quantile(1 - alpha, p)))
    return out.withColumn("kept", verdict)


def quality_outliers(docs: DataFrame, **how) -> DataFrame:
    """Statistics and verdict of every document: doc_id, lang, source, STATS, base_failed, d2, kept.

    docs has doc_id, text, lang, source; other columns are not read. Null and empty texts have
    no words and fail the base rules. Repeated rows give repeated rows. An empty table gives none.
    """
    spark = docs.sparkSession
    stats = docs.select("doc_id", "lang", "source", text_stats(F.col("text")).alias("s")).select("doc_id", "lang", "source", *[f"s.{c}" for c in STATS])
    return judge(Scratch(spark, "text-stats").put(stats, "stats"), **how)


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_outliers(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *STATS, "base_failed", "kept", F.round("d2", 6).alias("d2"))
