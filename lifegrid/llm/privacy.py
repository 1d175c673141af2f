"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them
(DataFrame functions only).

The protected entities are the values found by the base patterns and key-like strings (secrets), and, as single
values are rare, what they have in common: their group (an address's domain, the first digits of a number) and their
kind. A term t (a word outside these spans, in lower case and without punctuation at its ends) of a text that holds an
entity e discloses it as far as it lowers e's information content: with N distinct texts (so that copies count once
everywhere), c(e) those with e, c(e, t) those with both and df(t) those with t,

    IC(e) = log2(N / c(e)),   PMI(e, t) = log2(N c(e, t) / (c(e) df(t))).

Near copies of one text would make all of its words disclose what it holds. So texts get a sketch, two least hashes of three
neighbouring terms, which most near copies share; the texts with e and t must have enough different sketches, and half as
many as there are texts.

Where PMI(e, t) >= threshold * IC(e), with support in enough texts, t is generalised in the documents that hold e, or removed. Its
generalisations are its first 3, 2 and 1 characters: the first one that discloses less than the threshold whatever it
co-occurs with. A prefix g is in at least as many texts as the most frequent term that begins with it, low(g), so that
PMI(e, g) <= log2(N / low(g)). A term without such a prefix is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, free_names, let, quoted, running_sum, small_side, table
from .linededup import row_key

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, written so that no start is tried twice within a run of characters and nothing is given
#: back, which changes no match: a start within a run fails or succeeds as the run's first character does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
}
TERM, SECRET = 4, 5
#: All kinds of spans by their number; the base ones first.
NAMES = [*KINDS, "term", "secret"]
#: Prefixes that a term is generalised to, the longest first.
PREFIXES = [3, 2, 1]
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}
PUNCT = ".,;:!?\"'()[]{}<>|*#"
SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches as structs of start, end (code points, end exclusive) and m.

    What lies between the matches comes from splitting at the same pattern; positions are running sums of lengths.
    """

    def place(m: Column) -> Column:
        def sums(gaps: Column) -> Column:
            step = F.transform(m, lambda x, i: (F.length(F.get(gaps, i)) + F.length(x)).cast("long"))
            return let(running_sum(step), lambda s: F.transform(m, lambda x, i: F.struct((F.get(s, i) + F.length(F.get(gaps, i))).alias("start"), F.get(s, i + 1).alias("end"), x.alias("m"))))

        return let(F.split(text, pattern, -1), sums)

    none = F.expr("array_remove(array(named_struct('start', 0L, 'end', 0L, 'm', '')), named_struct('start', 0L, 'end', 0L, 'm', ''))")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(place(m)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "secret":  # letters and digits mixed, as in no word, number or date
        return (F.length(_digits(m)) >= 4) & (F.length(F.regexp_replace(m, "[0-9_]", "")) >= 4)
    return F.length(_digits(m)).between(8, 15)


def base_spans(text: Column) -> Column:
    """All valid matches of the base kinds and secrets, in order of kind and start, with their normalised value."""
    return F.concat(*[_of_kind(text, NAMES.index(kind), kind) for kind in PATTERNS])


def _of_kind(text: Column, k: int, kind: str) -> Column:
    value = F.lower if kind == "email" else _digits if kind in ("card", "phone") else lambda m: m
    right = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["m"]))
    spans = F.transform(
        right,
        lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value(s["m"]).alias("value")),
    )
    if NEEDS[kind] is None:
        return spans
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(F.expr(f"cast(array() as {SPAN})"))


def term(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(PUNCT))


def _terms(chunk: Column) -> Column:
    flat = chunk
    for c in BLANKS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.split(flat, " ")


def outside(text: Column, spans: Column) -> Column:
    """The text with its spans blanked, so that positions stay and a word that touches a span keeps its rest."""

    def blank(t: Column, own: Column) -> Column:
        end = lambda i: F.coalesce(F.get(own, i)["end"], F.lit(0).cast("long"))
        gap = lambda s, i: F.substr(t, (end(i - 1) + 1).cast("int"), (s["start"] - end(i - 1)).cast("int"))
        done = F.transform(own, lambda s, i: F.concat(gap(s, i), F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int"))))
        last = end(F.size(own) - 1)
        return F.concat(F.array_join(done, ""), F.substr(t, (last + 1).cast("int"), (F.length(t) - last).cast("int")))

    for k in map(NAMES.index, PATTERNS):  # the spans of one kind don't overlap
        own = F.filter(spans, lambda s: s["kind"] == k)  # noqa: B023
        text = let(F.struct(text.alias("t"), own.alias("own")), lambda x: F.when(F.size(x["own"]) == 0, x["t"]).otherwise(blank(x["t"], x["own"])))
    return text


def free_text(text: Column) -> Column:
    return let(F.struct(text.alias("t"), base_spans(text).alias("s")), lambda x: F.when(F.size(x["s"]) == 0, x["t"]).otherwise(outside(x["t"], x["s"])))


def words_outside(text: Column) -> Column:
    """The distinct terms of a text outside its base spans."""
    return F.filter(F.array_distinct(F.transform(_terms(free_text(text)), term)), lambda t: t != "")


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart: the unit of all counts, whatever rows hold the text."""
    return [F.xxhash64(text).alias("u1"), F.xxhash64(F.lit("text"), text).alias("u2")]


def once(texts: DataFrame, twice: DataFrame) -> DataFrame:
    """A row for each distinct text of u1, u2, text; twice holds the keys that several rows have, so that only their texts move."""
    twice = small_side(twice)
    return texts.join(twice, ["u1", "u2"], "left_anti").unionByName(texts.join(twice, ["u1", "u2"], "left_semi").dropDuplicates(["u1", "u2"]))


def entities(span: Column) -> Column:
    """What a span reveals: its value, its group and its kind, as structs of e (a hash) and whether many values are pooled."""
    value, kind = span["value"], span["kind"]
    group = (
        F.when(kind == NAMES.index("email"), F.substring_index(value, "@", -1))
        .when(kind == NAMES.index("ip"), F.substring_index(value, ".", 2))
        .when(kind == NAMES.index("card"), F.substring(value, 1, 6))
        .otherwise(F.substring(value, 1, 4))
    )
    named = [(value, "value", False), (group, "group", True), (F.lit(""), "kind", True)]
    return F.array(*[F.struct(F.xxhash64(kind, F.lit(w), v).alias("e"), F.lit(pooled).alias("pooled")) for v, w, pooled in named])


def prefixes(t: Column) -> Column:
    """A term's generalisations, none as long as the term itself."""
    return F.filter(F.array(*[F.substring(t, 1, k) for k in PREFIXES]), lambda g: F.length(g) < F.length(t))


def sketch(words: Column) -> Column:
    """The least of two hashes each of three neighbouring terms (of all, if fewer): texts of similarity J share it in J squared of all cases."""
    at = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    some = F.when(F.size(words) > 2, F.slice(at, F.lit(1), F.size(words) - 2)).otherwise(F.array(F.xxhash64(words)))
    return let(some, lambda h: F.xxhash64(F.array_min(h), F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(1))))))


def disclosing_terms(near: DataFrame, texts: DataFrame, base: DataFrame, each: DataFrame, scratch: Scratch, threshold: float = 0.8, support: int = 3, pooled: int = 8) -> DataFrame:
    """e, term, put: the terms that disclose an entity, and the prefix that each is generalised to ('' to remove it).

    Everything is counted over distinct texts: near has u1, u2, words of those with spans, texts has u1, u2, text of every row, base the
    keys of every row, each the distinct u1, u2, e, pooled of the spans. A term and a value must be in ``support`` texts of
    different sketches together, a term and a group or kind in ``pooled`` ones, as chance brings those together more often.
    """
    least = F.when(F.col("pooled"), pooled).otherwise(support)
    of_entity = scratch.put(each.groupBy("e", "pooled").agg(F.count("*").alias("ce")).filter(F.col("ce") >= least), "entities")
    units = scratch.put(base.groupBy("u1", "u2").agg(F.count("*").alias("k")), "units")
    single = once(texts, scratch.put(units.filter("k > 1").select("u1", "u2"), "twice"))
    holds = each.join(small_side(of_entity.select("e")), "e", "left_semi").groupBy("u1", "u2").agg(F.collect_list("e").alias("es"))
    pairs = near.withColumn("sketch", sketch(F.col("words"))).join(holds, ["u1", "u2"]).select("es", "sketch", F.explode("words").alias("term")).select(F.explode("es").alias("e"), "term", "sketch")
    pairs = pairs.groupBy("e", "term", "sketch").agg(F.count("*").alias("n")).groupBy("e", "term").agg(F.sum("n").alias("cet"), F.count("*").alias("sketches"))
    pairs = pairs.filter((F.col("sketches") >= min(support, pooled)) & (2 * F.col("sketches") >= F.col("cet"))).join(small_side(of_entity), "e").filter(F.col("sketches") >= least)
    pairs = scratch.put(pairs, "pairs")
    # a term in fewer texts than the support is in no pair
    df = single.select(F.explode(words_outside(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min(support, pooled))
    df = scratch.put(df, "terms")
    total = F.lit(float(max(units.count(), 2)))
    pmi = F.log2(total * F.col("cet") / (F.col("ce") * F.col("df")))
    ic = F.log2(total / F.col("ce"))
    shown = scratch.put(pairs.join(df, "term").filter((ic > 0) & (pmi >= threshold * ic)).select("e", "term", ic.alias("ic")), "disclosing")
    low = df.select("df", F.explode(prefixes(F.col("term"))).alias("g")).groupBy("g").agg(F.max("df").alias("low"))
    safe = shown.select("e", "term", "ic", F.explode(prefixes(F.col("term"))).alias("g")).join(low, "g").filter(F.log2(total / F.col("low")) < threshold * F.col("ic"))
    put = safe.groupBy("e", "term").agg(F.max_by("g", F.length("g")).alias("g"))
    return shown.join(put, ["e", "term"], "left").select("e", "term", F.coalesce(F.concat("g", F.lit("*")), F.lit("")).alias("put"))


def find_private(docs: DataFrame, **how) -> DataFrame:
    """doc_id, r1, r2 (the row's key) and spans: an array of (kind, start, end, put), kinds by the place in NAMES.

    ``put`` is what ``sanitise`` writes there. The keywords are those of ``disclosing_terms``. A null text is empty and has no
    spans. Rows repeated with the same id and text get the same spans. Spans of different kinds may overlap. Other columns of
    docs are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "private")
    text = F.coalesce("text", F.lit(""))
    base = scratch.put(docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), *text_key(text), base_spans(text).alias("spans")), "base")
    each = base.filter(F.size("spans") > 0).select("u1", "u2", F.explode(F.array_distinct(F.flatten(F.transform("spans", entities)))).alias("e"))
    each = scratch.put(each.select("u1", "u2", "e.*").distinct(), "each")
    texts = docs.select(text.alias("text"), *text_key(text))
    holders = small_side(scratch.put(each.select("u1", "u2").distinct(), "holders"))
    near = texts.join(holders, ["u1", "u2"], "left_semi").dropDuplicates(["u1", "u2"]).select("u1", "u2", words_outside(F.col("text")).alias("words"))
    near = scratch.put(near, "near")
    shown = scratch.put(disclosing_terms(near, texts, base, each, scratch, **how), "shown")
    # each text's own words are looked up, so that rows grow with the words of texts and not with texts times terms
    held_by = each.groupBy("u1", "u2").agg(F.collect_list("e").alias("es"))
    own = near.join(held_by, ["u1", "u2"]).select("u1", "u2", "es", F.explode("words").alias("term"))
    own = own.join(small_side(shown), "term").filter(F.array_contains("es", F.col("e")))
    # of the prefixes that a text's entities ask for, the most general one is right for all of them
    terms = own.groupBy("u1", "u2", "term").agg(F.min_by("put", F.length("put")).alias("put"))
    per_text = scratch.put(terms.groupBy("u1", "u2").agg(F.map_from_entries(F.collect_list(F.struct("term", "put"))).alias("terms")), "texts")
    held = texts.join(small_side(per_text.select("u1", "u2")), ["u1", "u2"], "left_semi").dropDuplicates(["u1", "u2"])
    free = held.join(per_text, ["u1", "u2"]).select("u1", "u2", "terms", free_text(F.col("text")).alias("free"))
    found = free.select("u1", "u2", "terms", F.filter(matches(F.col("free"), r"[^\x20\x09-\x0D]+"), lambda s: F.map_contains_key(F.col("terms"), term(s["m"]))).alias("hits"))
    cut = lambda s: s["start"] + F.length(s["m"]) - F.length(F.ltrim(s["m"], F.lit(PUNCT)))
    span = lambda k, a, b, put: F.struct(F.lit(k).cast("int").alias("kind") if isinstance(k, int) else k.alias("kind"), a.alias("start"), b.alias("end"), put.alias("put"))
    more = found.select("u1", "u2", F.transform("hits", lambda s: span(TERM, cut(s), cut(s) + F.length(F.btrim(s["m"], F.lit(PUNCT))), F.element_at(F.col("terms"), term(s["m"])))).alias("more"))
    tag = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES]), s["kind"] + 1)
    plain = lambda keep: F.transform(F.filter("spans", keep), lambda s: span(s["kind"], s["start"], s["end"], tag(s)))
    spans = F.when(F.col("more").isNull(), plain(lambda s: F.lit(True))).otherwise(F.concat(plain(lambda s: s["kind"] < TERM), F.col("more"), plain(lambda s: s["kind"] > TERM)))
    return base.join(more, ["u1", "u2"], "left").select("doc_id", "r1", "r2", spans.alias("spans"))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """docs with text sanitised: base spans become [EMAIL] and so on, disclosing terms a prefix with * or nothing.

    Where spans overlap, the one that starts first is replaced whole, and the rest of a later one with it.
    Rows without spans come back as they are (null texts too); all columns of docs stay.
    """
    k1, k2, spans = free_names(docs.columns, "r1", "r2", "spans")
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    found = find_private(docs.select("doc_id", "text"), **how).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("r1").alias(k1), F.col("r2").alias(k2)).agg(F.first("spans").alias(spans))
    both = docs.select(*[quoted(c) for c in docs.columns], r1.alias(k1), r2.alias(k2)).join(found, [k1, k2], "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).otherwise("")
        put = F.when(s["start"] >= acc["at"], s["put"]).otherwise("")
        return F.struct(F.concat(acc["out"], gap, put).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["put"].alias("put"))))
    done = F.aggregate(order, zero, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), F.greatest(F.length(text) - a["at"], F.lit(0)).cast("int"))))
    return both.select(*[F.when(F.col(spans).isNull(), text).otherwise(done).alias("text") if c == "text" else quoted(c) for c in docs.columns])


def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.array(*[F.lit(k) for k in NAMES])
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(say(F.filter("spans", lambda s: s["kind"] < 4)), 256).alias("base_sha256"),
        say(F.col("spans")).alias("spans"),
        count(TERM).alias("n_term"),
        F.size(F.filter("spans", lambda s: (s["kind"] == TERM) & (s["put"] != ""))).cast("long").alias("n_generalised"),
        count(SECRET).alias("n_secret"),
        F.size("spans").cast("long").alias("n_spans"),
    )
