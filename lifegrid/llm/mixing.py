"""Mixing sources to target weights by hierarchical budgets (DataFrame functions only).

The leaves of the tree domain - language - source hold the documents. A budget of tokens goes down the
tree: each node's budget is shared among its children by weight, and what a child can't use (its tokens
times the epochs allowed) goes to its siblings, again by weight, until all have what they can use or
the budget is gone. Only what a whole family can't use was taken from it by its own level before,
so shortages are made up by siblings before ancestors. A leaf's budget is met by whole seeded epochs
over its documents and a prefix of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_names, quoted, small_side, table, words_of

LEVELS = ["domain", "lang", "source"]
#: Buckets of a leaf's order, so that no task orders a whole leaf; the first three hexadecimal digits.
BUCKET_DIGITS = 3
#: The fixed weights of the production mix; what isn't listed weighs 1.
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "news": 2, "forum": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
DOMAIN_OF = ["web", "books", "news", "forum"]


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number at the end of its name, in turn; 'other' without one."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999"))
    pick = F.element_at(F.array(*[F.lit(d) for d in DOMAIN_OF]), (number % len(DOMAIN_OF) + 1).cast("int"))
    return F.coalesce(pick, F.lit("other"))


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def pour(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Shares budget of each parent among its rows by weight w, none above its cap.

    The children in order of cap / w: the first ones that a proportional share would overfill get their cap, the others
    whole-number shares of the rest. With integers throughout: the share of child i is B_left * w_i div W_left.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), key)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    t = children.withColumns(
        {
            "_cap": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    left = F.greatest(F.col("budget") - F.col("_cap"), F.lit(0))
    big = lambda c: c.cast("decimal(38,0)")
    full = big(F.col("cap")) * F.col("_w") <= big(left) * F.col("w")
    t = t.withColumn("_full", full)
    # the caps come in rising order of cap / w, so the full children are the first ones
    t = t.withColumns({"_used": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole), "_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(whole)})
    share = F.floor(big(F.col("budget") - F.col("_used")) * F.col("w") / F.nullif(F.col("_open"), F.lit(0)).cast("decimal(18,0)")).cast("long")
    return t.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(F.coalesce(share, F.lit(0)))).drop("_cap", "_w", "_full", "_used", "_open", "budget")


def budgets(leaves: DataFrame, budget: int, epochs: int) -> DataFrame:
    """leaves (domain, lang, source, w_domain, w_lang, w_source, tokens) with the share of each in tokens."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    top = caps.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("w_domain").alias("w")).withColumns({"budget": F.lit(budget).cast("long"), "_all": F.lit(0)})
    top = pour(top, ["_all"], "domain").select("domain", F.col("share").alias("budget"))
    mid = caps.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.first("w_lang").alias("w")).join(top, "domain")
    mid = pour(mid, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = caps.select("domain", "lang", "source", "tokens", "cap", F.col("w_source").alias("w")).join(mid, ["domain", "lang"])
    return pour(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "share")


def mix(docs: DataFrame, seed: int = 7, budget_part: float = 0.8, epochs: int = 2) -> DataFrame:
    """Columns of docs (without text: see ``mix_documents``) that are selected, with domain, tokens and epoch.

    docs has doc_id, lang, source and tokens; null lang or source count as ''. The budget is budget_part of all tokens.
    In epoch e a leaf's documents are ordered by md5 of 'seed:e:doc_id', then doc_id; a document is taken in epoch e
    while the tokens before it, in this and earlier epochs, are less than the leaf's share. So a leaf gets its share or up to one document
    more. Documents without tokens are never taken. Rows repeated with the same id stand next to each other, those of fewer
    tokens first; rows of null id count as such repeats of one id. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "tokens").withColumn("domain", domain_of(F.col("source")))
    leaf = [F.col(c) for c in LEVELS]
    lists = rows.filter(F.col("tokens") > 0).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    lists = lists.select("doc_id", *leaf, "tokens", "epoch", key).withColumn("bucket", F.substr("key", F.lit(1), F.lit(BUCKET_DIGITS)))
    lists = scratch.put(lists, "lists")
    sums = scratch.put(lists.groupBy(*leaf, "epoch", "bucket").agg(F.sum("tokens").alias("n")), "sums")
    total = sums.filter(F.col("epoch") == 0).groupBy(*leaf).agg(F.sum("n").alias("tokens"))
    leaves = total.withColumns({"w_domain": weight_of(F.col("domain"), DOMAIN_WEIGHTS), "w_lang": weight_of(F.col("lang"), LANG_WEIGHTS), "w_source": F.lit(1).cast("long")})
    all_tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    share = scratch.put(budgets(leaves, int(all_tokens * budget_part), epochs), "shares")
    # tokens before each bucket: at most 16 ** BUCKET_DIGITS rows an epoch of a leaf; earlier epochs are whole
    upto = Window.partitionBy(*LEVELS, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(small_side(share), LEVELS)
    starts = starts.withColumn("start", F.col("start") + F.col("epoch") * F.col("tokens")).filter(F.col("start") < F.col("share")).select(*LEVELS, "epoch", "bucket", "start", "share")
    within = Window.partitionBy(*LEVELS, "epoch", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    at = lists.join(starts, [*LEVELS, "epoch", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return at.filter(F.col("before") < F.col("share")).select("doc_id", *LEVELS, "tokens", "epoch")


def with_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and tokens: the words of the text, as the measure that budgets are in."""
    return docs.select("doc_id", "lang", "source", F.size(words_of(F.col("text"))).cast("long").alias("tokens"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose ids the mix selects, once for each epoch they are selected in; all columns of docs.

    Where the mix takes one of the rows of an id, null included, all rows of that id come.
    """
    own, times, copy = free_names(docs.columns, "own", "times", "copy")
    chosen = mix(with_tokens(docs), **how).groupBy(F.col("doc_id").alias(own)).agg(F.countDistinct("epoch").cast("int").alias(times))
    both = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(own)))
    return both.select(*[quoted(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_tokens(table(spark, sf_dir, "documents")))


def op8_sql(docs: str = "documents", seed: int = 7, budget_part: float = 0.8, epochs: int = 2) -> str:
    case = lambda c, ws: f"CASE {' '.join(f"WHEN {c} = '{k}' THEN {v}" for k, v in ws.items())} ELSE 1 END"

    def pour_sql(t: str, parent: str, key: str) -> str:
        over = f"PARTITION BY {parent}"
        return f"""
          SELECT *, CASE WHEN fits THEN cap ELSE coalesce(CAST((budget - used) * w // nullif(open, 0) AS BIGINT), 0) END AS share FROM (
            SELECT *, sum(CASE WHEN fits THEN cap ELSE 0 END) OVER ({over}) AS used, sum(CASE WHEN fits THEN 0 ELSE w END) OVER ({over}) AS open FROM (
              SELECT *, CAST(cap AS HUGEINT) * (all_w - w_before) <= CAST(greatest(budget - cap_before, 0) AS HUGEINT) * w AS fits FROM (
                SELECT *, sum(w) OVER ({over}) AS all_w,
                       coalesce(sum(w) OVER ({over} ORDER BY CAST(cap AS DOUBLE) / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
                       coalesce(sum(cap) OVER ({over} ORDER BY CAST(cap AS DOUBLE) / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before
                FROM {t})))"""

    names = ", ".join(f"'{d}'" for d in DOMAIN_OF)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM {docs}
), r AS (
  SELECT *, coalesce([{names}][TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % {len(DOMAIN_OF)} + 1], 'other') AS domain FROM d WHERE tokens > 0
), leaf AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS n, CAST(sum(tokens) AS BIGINT) * {epochs} AS cap FROM r GROUP BY ALL
), b AS (SELECT CAST(floor(sum(n) * CAST({budget_part} AS DOUBLE)) AS BIGINT) AS budget FROM leaf
), t1 AS (SELECT domain, sum(cap) AS cap, {case('domain', DOMAIN_WEIGHTS)} AS w, max(budget) AS budget FROM leaf, b GROUP BY domain
), s1 AS ({pour_sql('t1', '1', 'domain')}
), t2 AS (SELECT l.domain, l.lang, sum(l.cap) AS cap, {case('l.lang', LANG_WEIGHTS)} AS w, max(s1.share) AS budget FROM leaf l JOIN s1 ON l.domain = s1.domain GROUP BY l.domain, l.lang
), s2 AS ({pour_sql('t2', 'domain', 'lang')}
), t3 AS (SELECT l.domain, l.lang, l.source, l.n, l.cap, 1 AS w, s2.share AS budget FROM leaf l JOIN s2 ON l.domain = s2.domain AND l.lang = s2.lang
), s3 AS ({pour_sql('t3', 'domain, lang', 'source')}
), o AS (
  SELECT r.*, e.epoch, md5('{seed}:' || CAST(e.epoch AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM r CROSS JOIN (SELECT unnest(range({epochs})) AS epoch) e
), c AS (
  SELECT o.*, s3.share, o.epoch * s3.n + coalesce(sum(tokens) OVER (PARTITION BY o.domain, o.lang, o.source, o.epoch ORDER BY k, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM o JOIN s3 ON o.domain = s3.domain AND o.lang = s3.lang AND o.source = s3.source
)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch AS INTEGER) AS epoch FROM c WHERE before < share
"""


OP8_SQL = op8_sql()
