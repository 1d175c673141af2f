"""The DataFrame-only operators against brute force, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifegrid.llm import linededup, mixing, outliers, privacy
from lifegrid.llm.common import Scratch

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
TEXTS = [
    None, "", "   \n\t ", "one two three four five six", "a b c d e a b c d e a b c d e", "x\ny\nx\n\nx\n y", "Long enough line to count here\nshort",
    "  LONG enough line to count here  \nother", "long ENOUGH line to count here", "long enough line to count here", "é ß 日本 # * | <b> $5 100% &amp;", "w " * 3000,
    "same same", "same same",
]


def table(spark, texts, extra=False):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' as line", "1 as n_lines", "array(1) as spans", "0 as at", "2 as tokens", "'k' as `odd name`")
    return df.repartition(3)


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, cover, seen, dup = Counter(wins), set(), set(), 0
    for i, x in enumerate(wins):
        if c[x] > 1:
            cover.update(range(i, i + 5))
    for line in (t or "").split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), dup, len(cover)


def test_text_statistics(spark):
    df = table(spark, TEXTS, True)
    got = {r.doc_id: r for r in outliers.quality_outliers(df).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(got[i][c] for c in outliers.STATS) == brute_stats(t), t
        n, _, _, _, rep = brute_stats(t)
        assert got[i].base_failed == (n < 10 or 100 * rep > 20 * n)
        assert not (got[i].base_failed and got[i].kept)


def test_outliers_empty(spark):
    assert outliers.quality_outliers(table(spark, TEXTS).limit(0)).count() == 0


def fast_mcd(m, rng, tries=60):
    """Least determinant over random starts of five rows, each concentrated until nothing changes: centre, scatter, ln det."""
    floor = np.diag(np.array(list(outliers.FLOORS.values())) ** 2)
    fix = 0.75 / outliers.chi2_cdf(outliers.chi2_quantile(0.75, 4), 6)
    best = None
    for _ in range(tries):
        core = m[rng.choice(len(m), 5, replace=False)]
        was = np.inf
        while True:
            center, cov = core.mean(0), np.cov(core.T, bias=True) * fix + floor
            det = np.linalg.slogdet(cov)[1]
            if len(core) > 5 and (best is None or det < best[2]):
                best = center, cov, det
            if len(core) > 5 and det >= was - 1e-9:
                break
            was = det if len(core) > 5 else np.inf
            d = np.einsum("ij,jk,ik->i", m - center, np.linalg.inv(cov), m - center)
            core = m[d <= np.quantile(d, 0.75)]
    return best


def test_mcd_against_random_starts(spark):
    """The deterministic starts find what a plain FAST-MCD finds, in determinant, distances and verdicts."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        n = int(rng.integers(100, 400))
        shift = float(rng.normal(0, 1))  # statistics that go together
        rows.append((i, "en", "a" if i % 2 else "b", n, int(n * (5 + 0.3 * shift + rng.normal(0, 0.1))), int(n * 2 if bad else max(0, 10 + 4 * shift + rng.normal(0, 1))), int(rng.integers(0, 3)), int(n * 0.15) if bad else int(rng.integers(0, 2))))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r.doc_id: r for r in outliers.judge(stats).collect()}
    x = {r[0]: np.array([np.log(r[4] / r[3]), np.sqrt(r[5] / r[4]), np.sqrt(r[6] / r[3]), np.sqrt(r[7] / r[3])]) for r in rows}
    floor = np.diag(np.array(list(outliers.FLOORS.values())) ** 2)
    good = stats.withColumns(outliers.transformed()).select(F.lit("=en").alias("g1"), F.col("source").alias("g2"), *outliers.DIMS)
    found = {r.g2: r.ln_det for r in outliers.least_scatter(good, Scratch(spark, "t")).collect()}
    for g in "ab":
        ids = [r[0] for r in rows if r[2] == g]
        m = np.array([x[i] for i in ids])
        center, cov, det = fast_mcd(m, rng)
        assert found[g] <= det + 0.01
        d = np.einsum("ij,jk,ik->i", m - center, np.linalg.inv(cov), m - center)
        near = m[d <= outliers.chi2_quantile(0.975, 4)]
        center, cov = near.mean(0), np.cov(near.T, bias=True) * 0.975 / outliers.chi2_cdf(outliers.chi2_quantile(0.975, 4), 6) + floor
        d = np.einsum("ij,jk,ik->i", m - center, np.linalg.inv(cov), m - center)
        np.testing.assert_allclose([got[i].d2 for i in ids], d, rtol=0.03, atol=0.05)
        assert sum(got[i].kept != (x <= outliers.chi2_quantile(0.999, 4)) for i, x in zip(ids, d, strict=True)) <= 2
    assert not any(got[i].kept for i in range(0, 900, 5)) and sum(r.kept for r in got.values()) > 690


def test_small_groups_are_judged(spark):
    """Few rows of a language or source are judged by all rows of the language or table."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(660):
        lang, source = ("en", "big") if i < 600 else ("en", "rare") if i < 630 else (None, "big")
        bad = i in (610, 640)
        rows.append((i, lang, source, 200, int(200 * rng.normal(5, 0.3)), 600 if bad else int(rng.integers(0, 3)), 0, 0))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r.doc_id: r for r in outliers.judge(stats).collect()}
    assert len(got) == 660 and all(r.d2 is not None for r in got.values())
    assert not got[610].kept and not got[640].kept and sum(r.kept for r in got.values()) > 640


@pytest.mark.parametrize("column, value", [(5, 50), (6, 10), (7, 40)])
def test_each_statistic_rejects_alone(spark, column, value):
    """5 % symbols, a twentieth duplicate lines or 20 % repeated words, where the others have none, are outliers."""
    rng = np.random.default_rng(3)
    rows = [[i, "en", "a", 200, int(200 * rng.normal(5, 0.1)), 0, 0, 0] for i in range(300)]
    rows[7][4], rows[7][column] = 1000, value
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r.doc_id: r for r in outliers.judge(stats).collect()}
    assert not got[7].base_failed and not got[7].kept and sum(r.kept for r in got.values()) >= 298


def test_chi2_quantile():
    assert abs(outliers.chi2_quantile(0.95, 1) - 3.841458820694124) < 1e-9
    assert abs(outliers.chi2_cdf(9.487729036781154, 4) - 0.95) < 1e-12


def brute_lines(texts):
    docs, held = {}, defaultdict(set)
    for i, t in enumerate(texts):
        docs[i] = (t or "").split("\n")
        for line in docs[i]:
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
            if len(key) >= 20:
                held[key].add(i)
    out = {}
    for i, lines in docs.items():
        keep = []
        for line in lines:
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
            if not (len(held.get(key, ())) >= 3 and max(held[key]) != i):
                keep.append(line)
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_line_dedup(spark, parts):
    texts = [*TEXTS, "\n".join(["shared passage number one is long"] * 3 + ["own"]), "shared passage number one is long", "SHARED passage NUMBER one is long\t", "ÉÉÉÉ shared ünïcode line", "éééé shared ünïcode line"]
    df = table(spark, texts, True)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(df, n_batches=parts).collect()}
    assert got == brute_lines(texts)


def test_line_dedup_repeated_rows_and_nulls(spark):
    line = "this line is in enough documents"
    rows = [(1, line), (1, line), (2, line), (None, "x\n" + line), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in linededup.dedup_lines(df).collect()))
    assert out == [(False, 1, ""), (False, 1, ""), (False, 2, line), (True, 0, ""), (True, 0, "x")]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_runs_levels(spark):
    runs = linededup.LineRuns(spark, min_chars=3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, "common line\nown line %d" % i)], "doc_id long, text string"))
    assert {k: len(v) for k, v in runs.levels.items() if v} == {0: 1, 2: 1}
    often = runs.frequent(5).collect()
    assert len(often) == 1 and often[0].top == 4
    held = runs.merged().collect()
    assert sum(r.entry for r in held) == 6  # each line has one entry
    # the count of the common line comes from its one entry and its updates, which only the anti-join tells apart
    assert [r.n for r in held if r.entry and r.n > 1] == [4] and sum(not r.entry for r in held) == 1 and often[0].n == 5


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_private(t):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if ok(k, m.group())]


def test_private_base(spark):
    rng = np.random.default_rng(0)
    atoms = ["a", "b@", "@c.d", "x.y@z-w.co.uk", "_q@a.b", "1.2.3.4", ".5", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+", " ", "\n", "é日", "007", "-", "..", "999999999999"]
    texts = [*TEXTS, *["".join(rng.choice(atoms, rng.integers(1, 25))) for _ in range(400)], "9" * 20000, "a" * 20000 + "@" + "b" * 20000, ("mail%d@x.org, " * 1 % 5) * 2000]
    got = {r.doc_id: r.spans for r in privacy.find_private(table(spark, texts, True)).collect()}
    name = privacy.KINDS
    for i, t in enumerate(texts):
        assert [f"{name[s.kind]}:{s.start}:{s.end}" for s in got[i] if s.kind < 4] == brute_private(t), t


def test_private_terms(spark):
    """A name that stands only near one address discloses it; a common word near it doesn't."""
    mine = ["maple", "birch", "aspen", "cedar", "alder", "beech", "larch", "holly"]
    texts = [f"start {w} words here common call Zanzibarius at secret@home.org now common {w}s again word" for w in mine]
    texts += [f"common text number {i} with nothing else to see other{i}" for i in range(200)]
    df = table(spark, texts)
    got = {r.doc_id: r.spans for r in privacy.find_private(df).collect()}
    found = {texts[i][s.start : s.end] for i in range(8) for s in got[i] if s.kind == 4}
    assert "Zanzibarius" in found and "common" not in found
    assert not any(s.kind == 4 for i in range(8, 208) for s in got[i])
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "Zanzibarius" not in clean[0] and clean[20] == texts[20]


def test_private_copies_do_not_disclose(spark):
    texts = ["copied words here alphaword call Zanzibarius at secret@home.org now"] * 9 + [f"plain {i} text" for i in range(50)]
    assert not any(s.kind == 4 for r in privacy.find_private(table(spark, texts)).collect() for s in r.spans)


def test_private_near_copies_do_not_disclose(spark):
    rng = np.random.default_rng(1)
    base = [f"word{x}" for x in range(90)] + ["at", "secret@home.org"]
    texts = [" ".join([*base[:k], f"own{i}", *base[k:]]) for i, k in enumerate(rng.integers(0, 90, 40))]
    texts += [f"plain {i} text of its own" for i in range(400)]
    assert not any(s.kind == privacy.TERM for r in privacy.find_private(table(spark, texts)).collect() for s in r.spans)


def test_private_copies_do_not_suppress(spark):
    """Copies of one of the documents that prove a disclosure don't take it back."""
    mine = ["maple", "birch", "aspen", "cedar", "alder"]
    texts = [f"start {w} words here common call Zanzibarius at secret@home.org now common {w}s again word" for w in mine]
    texts += [texts[0]] * 60 + [f"common text number {i} with nothing else to see other{i}" for i in range(200)]
    got = {r.doc_id: r.spans for r in privacy.find_private(table(spark, texts)).collect()}
    for i in range(65):
        assert "Zanzibarius" in {texts[i][s.start : s.end] for s in got[i] if s.kind == 4}


def test_private_terms_anywhere(spark):
    """Terms at the text's ends, short ones, ones with digits, ones touching the span or far from it are candidates; the span isn't."""
    mine = ["maple", "birch", "aspen", "cedar", "alder"]
    far = " ".join(["plain"] * 60)
    texts = [f"Wilberforce {w} staff A7713 Kim <{'mailto:'}{w} 李明 at x1@y.org,Quill {far} Montgomery {w}s secret@home.org Thaddeus" for w in mine]
    texts += [f"{w} of all plain x{i} staff at <mailto:" for i, w in enumerate(mine * 40)]
    df = table(spark, texts)
    got = {r.doc_id: r.spans for r in privacy.find_private(df).collect()}
    for i in range(5):
        terms = [(s.start, s.end) for s in got[i] if s.kind == 4]
        assert {"Wilberforce", "A7713", "Kim", "李明", "Quill", "Montgomery", "Thaddeus"} == {texts[i][a:b] for a, b in terms}
        assert not any(a < s.end and s.start < b for a, b in terms for s in got[i] if s.kind < 4)
    assert not any(got[i] for i in range(5, 205))
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert not any(w in clean[0] for w in ("Kim", "Quill", "Thaddeus", "secret")) and clean[0].count("[EMAIL]") == 2


def brute_terms(texts, sketches, threshold, support, pooled):
    """Term spans with what is put there, from the definitions, counting over distinct texts."""
    def spans(t):
        out = []
        for kind, p in [*PATTERNS.items(), ("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}")]:
            for m in re.finditer(p, t):
                v = m.group()
                d = re.sub("[^0-9]", "", v)
                if kind == "secret":
                    if len(d) >= 4 and len(re.sub("[0-9_]", "", v)) >= 4:
                        out.append((kind, *m.span(), v))
                elif f"{kind}:{m.start()}:{m.end()}" in brute_private(t):
                    out.append((kind, *m.span(), v.lower() if kind == "email" else v if kind == "ip" else d))
        return out

    def reveals(kind, v):
        group = v.split("@")[-1] if kind == "email" else ".".join(v.split(".")[:2]) if kind == "ip" else v[:6] if kind == "card" else v[:4]
        return {("value", kind, v), ("group", kind, group), ("kind", kind, "")}

    def blanked(t):
        for _, a, b, _ in spans(t):
            t = t[:a] + " " * (b - a) + t[b:]
        return t

    bare = lambda w: w.lower().strip(privacy.PUNCT)
    once = sorted(set(texts))
    words = {t: {bare(w) for w in blanked(t).split()} - {""} for t in once}
    ents = {t: set().union(*(reveals(k, v) for k, _, _, v in spans(t))) for t in once}
    n = len(once)

    def key(t):  # texts of the same words in the same order, in place of a hash; the test's texts have no near copies
        return tuple(dict.fromkeys(bare(w) for w in blanked(t).split() if bare(w)))

    different = defaultdict(set)
    for t in once:
        for e in ents[t]:
            for w in words[t]:
                different[e, w].add(sketches[key(t)])
    df, ce, cet = Counter(w for t in once for w in words[t]), Counter(e for t in once for e in ents[t]), Counter((e, w) for t in once for e in ents[t] for w in words[t])
    low = defaultdict(int)
    for w, k in df.items():
        for size in (1, 2, 3):
            if len(w) > size and k >= support:
                low[w[:size]] = max(low[w[:size]], k)
    put = {}
    for (e, w), k in cet.items():
        need = support if e[0] == "value" else pooled
        ic = np.log2(n / ce[e])
        seen = len(different[e, w])
        if seen >= need and 2 * seen >= k and ic > 0 and np.log2(n * k / (ce[e] * df[w])) >= threshold * ic:
            fit = [w[:size] for size in (3, 2, 1) if len(w) > size and low[w[:size]] and np.log2(n / low[w[:size]]) < threshold * ic]
            put[e, w] = fit[0] + "*" if fit else ""
    out = {}
    for t in once:
        found = set()
        for m in re.finditer(r"\S+", blanked(t)):
            ways = [put[e, bare(m.group())] for e in ents[t] if (e, bare(m.group())) in put]
            if ways:
                a = m.start() + len(m.group()) - len(m.group().lstrip(privacy.PUNCT))
                found.add((a, a + len(bare(m.group())), min(ways, key=len)))
        out[t] = found
    return out


def test_private_terms_brute(spark):
    """Pointwise mutual information by value, group and kind, generalisation and removal, against the definitions."""
    rng = np.random.default_rng(8)
    vocab = [f"{a}{b}{c}" for a in "pqr" for b in "ae" for c in ("lo", "mix", "stu")] + ["common", "cat"]
    hints = {"email": "Mailbox", "ip": "server:", "phone": "(calling)", "secret": "token"}
    texts = []
    for i in range(260):
        w = list(rng.choice(vocab, int(rng.integers(4, 12))))
        kind = str(rng.choice(["email", "ip", "phone", "secret", "none", "none", "none", "none"]))
        value = {"email": f"u{rng.integers(0, 40)}@mail{rng.integers(0, 3)}.org", "ip": f"10.{rng.integers(0, 3)}.7.{rng.integers(0, 20)}", "phone": f"+49 30 555-{rng.integers(100, 130)}", "secret": f"ab{rng.integers(0, 9)}cd0123456789ef012345", "none": ""}[kind]
        w.insert(int(rng.integers(0, len(w))), value)
        if kind != "none" and rng.random() < 0.9:
            w.insert(int(rng.integers(0, len(w))), hints[kind])
        if rng.random() < 0.4:
            w.append("tomato")
        texts.append(" ".join(w))
    texts += texts[:30]
    words = table(spark, texts).select(privacy.words_outside(F.col("text")).alias("w"))
    sketches = {tuple(r.w): r.s for r in words.select("w", privacy.sketch(F.col("w")).alias("s")).collect()}
    assert len(set(sketches.values())) > 100
    for how in ({"threshold": 0.8, "support": 3, "pooled": 8}, {"threshold": 0.4, "support": 2, "pooled": 4}):
        want = brute_terms(texts, sketches, **how)
        got = {r.doc_id: {(s.start, s.end, s.put) for s in r.spans if s.kind == privacy.TERM} for r in privacy.find_private(table(spark, texts), **how).collect()}
        assert got == {i: want[t] for i, t in enumerate(texts)}
        puts = {p for found in want.values() for _, _, p in found}
        assert ("to*" in puts) == (how["threshold"] > 0.5)


def test_private_digest_of_nothing(spark, tmp_path):
    table(spark, ["no data", None]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in privacy.op4_private(spark, str(tmp_path)).collect():
        assert r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" and r.n_email == 0


def brute_mix(rows, seed, part, epochs):
    def pour(budget, kids):  # name -> (cap, weight)
        left, open_ = budget, dict(kids)
        share = {}
        while open_:
            w = sum(v[1] for v in open_.values())
            full = [k for k, (cap, wk) in open_.items() if cap * w <= left * wk]
            if not full:
                return share | {k: left * wk // w for k, (_, wk) in open_.items()}
            k = min(full, key=lambda k: (open_[k][0] / open_[k][1], k))
            share[k] = open_.pop(k)[0]
            left -= share[k]
        return share

    leaf = defaultdict(int)
    for _, dom, lang, src, n in rows:
        leaf[dom, lang, src] += n
    cap = lambda pre: sum(v * epochs for k, v in leaf.items() if k[: len(pre)] == pre)
    total = int(sum(leaf.values()) * part)
    out = {}
    top = pour(total, {d: (cap((d,)), mixing.DOMAIN_WEIGHTS.get(d, 1)) for d in {k[0] for k in leaf}})
    for d, b in top.items():
        mid = pour(b, {x: (cap((d, x)), mixing.LANG_WEIGHTS.get(x, 1)) for x in {k[1] for k in leaf if k[0] == d}})
        for x, b2 in mid.items():
            out |= {(d, x, s): v for s, v in pour(b2, {k[2]: (cap(k), 1) for k in leaf if k[:2] == (d, x)}).items()}
    chosen = []
    for k, b in out.items():
        used = 0
        for e in range(epochs):
            for r in sorted((r for r in rows if r[1:4] == k), key=lambda r: (hashlib.md5(f"{seed}:{e}:{r[0]}".encode()).hexdigest(), r[0])):
                if used < b:
                    chosen.append((r[0], e))
                used += r[4]
    return sorted(chosen)


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.choice(["en", "de", "fr"])), f"src{int(rng.integers(0, 7))}", int(rng.integers(1, 90))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, tokens long")
    for part in (0.3, 0.8, 1.7):
        got = sorted((r.doc_id, r.epoch) for r in mixing.mix(df, budget_part=part).collect())
        full = [(i, mixing.DOMAIN_OF[int(s[3:]) % 4], lang, s, n) for i, lang, s, n in rows]
        assert got == brute_mix(full, 7, part, 2)


def test_mixing_edges(spark):
    df = table(spark, TEXTS, True)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} <= {i for i, t in enumerate(TEXTS) if (t or "").strip()}
    assert mixing.mix_documents(df.limit(0)).count() == 0
