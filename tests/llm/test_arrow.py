"""The operators with Arrow code against libraries and brute force, and their edge cases."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lifegrid.llm.common import Scratch
from lifegrid.llm import neardup, neighbours, pieces, quality, sentencepieces, shingles, tokencount, tokenfiles

RNG = np.random.default_rng(11)
WORDS = ["the", "of", "Ünder", "thing", "hea", "réal", "x1", "日本", "#tag", "don't", "a.b,c", "<|endoftext|>", "UPPER", "ß", "é"]
TEXTS = [None, "", "  ", "\n\n", "one", "  lead", "trail ", "a  b\t\x1cc", "<|startoftext|> y", *[" ".join(RNG.choice(WORDS, 60)) + RNG.choice(["", ".", "\n", ", x. y"]) for _ in range(40)], "z" * 5000, "ab " * 3000]


def docs(spark, texts=TEXTS, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return (df.selectExpr("*", "7 as n_tokens", "'s' as score", "array(1) as ids", "2 as part") if extra else df).repartition(3)


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pieces.default_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pieces.default_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def model():
    return sentencepieces.Model(pieces.default_path("piece_bpe_32k.model"))


ODD = st.text(alphabet=st.sampled_from(list("aB1.,'!_ \n\t\x1c　é²ß日́▁$")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_byte_units(byte_bpe, text):
    e = tokenfiles.Encoder(pieces.default_path("byte_bpe_50k.json"), "<u2") if not hasattr(test_byte_units, "e") else test_byte_units.e
    test_byte_units.e = e
    assert np.frombuffer(e.encode([text])[0], "<u2").tolist() == byte_bpe.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(ODD, st.integers(8, 40))
def test_spliced_counts(word_bpe, text, chunk):
    c = tokencount.Counter(pieces.default_path("word_bpe_49k.json"), chunk, 4) if not hasattr(test_spliced_counts, "c") else test_spliced_counts.c
    test_spliced_counts.c = c
    c.chunk = chunk
    assert c.count([text])[0] == len(word_bpe.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(ODD, st.integers(5, 50))
def test_scan_is_the_library(model, text, chunk):
    assert sentencepieces.encode_scanned(model, text, chunk) == model.lib.encode(text)
    assert np.frombuffer(model.encode([text])[0], "<u2").tolist() == model.lib.encode(text)


def test_combine_is_associative(model):
    s = sentencepieces.normalised("thethinghéa real 日本 x" * 4)
    a, b, c = (model.matrix(s, p, q) for p, q in ((0, 20), (20, 45), (45, len(s))))
    left, right = sentencepieces.combine(sentencepieces.combine(a, b), c), sentencepieces.combine(a, sentencepieces.combine(b, c))
    assert left == right


@pytest.mark.parametrize("giant", [10**6, 30])
def test_sentencepiece(spark, model, giant, monkeypatch):
    monkeypatch.setattr(sentencepieces, "FAN", 4)  # several levels of the tree
    got = {r.doc_id: r for r in sentencepieces.encode_documents(docs(spark), giant=giant, chunk=17).collect()}
    for i, t in enumerate(TEXTS):
        ids = model.lib.encode(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[i].round_trip and got[i].part == 2
    assert sentencepieces.encode_documents(docs(spark).limit(0)).count() == 0


def test_huge_texts_are_counted_from_their_chunks(word_bpe, monkeypatch):
    """The count of a huge text comes from the chunk encodings alone, and widening finds splices in long words."""
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abcdeé"), int(rng.integers(1, 12)))) for _ in range(3000)) + "x" * 700 + " tail " + "y z " * 300
    c = tokencount.Counter(pieces.default_path("word_bpe_49k.json"), 512, 16)
    monkeypatch.setattr(c, "units", None)
    assert c.spliced(text) == len(word_bpe.encode(text, add_special_tokens=False).ids)
    assert c.widened > 0
    whole = c.splice
    monkeypatch.setattr(c, "splice", lambda edges, left, right, begin, end: whole(edges, left, right, begin, end) if end - begin > 60 else None)
    assert c.spliced(text) == len(word_bpe.encode(text, add_special_tokens=False).ids) and c.widened > 10
    monkeypatch.setattr(c, "splice", lambda *_: None)  # the chunks meet at their edges
    assert c.spliced(text) == len(word_bpe.encode(text, add_special_tokens=False).ids)


class Spy(tokencount.Counter):
    """Counts the code points that go to the library."""

    sent = 0

    def encoded(self, text, start, end):
        self.sent += end - start
        return super().encoded(text, start, end)


@pytest.mark.parametrize("kind", ["no edge", "few edges", "marks", "special"])
def test_huge_texts_without_blanks_take_linear_work(word_bpe, kind):
    rng = np.random.default_rng(1)
    han = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FFF, n)))
    text = {"no edge": lambda: han(300_000), "few edges": lambda: "7".join(han(90_000) for _ in range(4)), "marks": lambda: "。".join(han(40) for _ in range(25_000)), "special": lambda: "<|endoftext|>".join(han(400) for _ in range(700))}[kind]()
    c = Spy(pieces.default_path("word_bpe_49k.json"), 65_536, 512)
    assert c.count([text]) == [len(word_bpe.encode(text, add_special_tokens=False).ids)]
    assert c.sent <= 2.2 * len(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("aİB1２½.,'!s_ \n\t　éé́ßㄱ가日゙。、！́$") + ["<|endoftext|>", "'ll", "　"]), max_size=60).map("".join))
def test_edges_are_certain(word_bpe, text):
    """Tokens of both sides of an edge are those of the whole."""
    c = tokencount.Counter(pieces.default_path("word_bpe_49k.json"), 16, 4) if not hasattr(test_edges_are_certain, "c") else test_edges_are_certain.c
    test_edges_are_certain.c = c
    ids = lambda t: word_bpe.encode(t, add_special_tokens=False).ids
    for at in c.edges(text).tolist():
        assert ids(text[:at]) + ids(text[at:]) == ids(text)


def test_short_margin_is_refused(spark):
    with pytest.raises(Exception, match="margin"):
        sentencepieces.encode_documents(docs(spark), giant=100, chunk=50, margin=2).collect()


def test_token_counts(spark, word_bpe):
    got = {r.doc_id: r for r in tokencount.count_tokens(docs(spark), chunk=100, overlap=8, limit=50).collect()}
    for i, t in enumerate(TEXTS):
        n = len(word_bpe.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 50)


def test_token_files(spark, byte_bpe, tmp_path):
    folder = f"file://{tmp_path}/files"
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.token_files(docs(spark), folder).collect())
    want, at, every = [], 0, []
    for i, t in enumerate(TEXTS):
        ids = [*byte_bpe.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        every += ids
    assert got == want
    files = sorted((tmp_path / "files").glob("ids-*.bin"))
    assert np.concatenate([np.memmap(f, "<u2", "r") for f in files]).tolist() == every
    offsets = [np.fromfile(f, "<u8") for f in sorted((tmp_path / "files").glob("offsets-*.bin"))]
    assert [int(x) for o in offsets for x in o[:-1]] == [w[1] for w in want] and int(offsets[-1][-1]) == at
    assert tokenfiles.token_files(docs(spark).limit(0)).count() == 0


def test_token_files_ties_and_nulls(spark):
    df = spark.createDataFrame([(3, "b"), (3, "a"), (None, "c"), (3, "a")], "doc_id long, text string")
    got = sorted(((r.start, r.doc_id) for r in tokenfiles.token_files(df).collect()))
    assert got == [(0, None), (2, 3), (4, 3), (6, 3)]


def slow_similarity(a, b):
    """J_P from the definition."""

    def bag(t):
        w, out = (t or "").lower().split(), {}
        for s in [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w):
            out[s] = out.get(s, 0) + 1
        return out

    x, y = bag(a), bag(b)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())


def make_copies():
    rng = np.random.default_rng(5)
    out = []
    for _ in range(12):
        base = rng.integers(0, 40, 120).tolist()
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for p in rng.integers(0, 120, int(rng.integers(0, 8))):
                t[p] = int(rng.integers(1000, 9999))
            out.append(" ".join(f"w{x}" for x in t))
    out += [out[0], out[0], None, "", " ", "one two", "One  TWO", "one", "e f g h i " * 30, "e f g h i " * 31]
    return out


def test_prob_jaccard_and_signatures():
    texts = [t for t in make_copies() if t]
    d, h, c = neardup.weighted_sets(texts)
    part = lambda i: (h[d == i], c[d == i])
    sig = neardup.signatures(len(texts), d, h, c.astype(float), 512)
    for i in range(0, 20):
        for j in range(i):
            exact = slow_similarity(texts[i], texts[j])
            assert neardup.prob_jaccard(*part(i), *part(j)) == pytest.approx(exact, abs=1e-12)
            assert abs((sig[i] == sig[j]).mean() - exact) < 0.12


def test_near_duplicates(spark):
    texts = make_copies()
    n = len(texts)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if texts[i] and texts[j] and texts[i].strip() and texts[j].strip() and slow_similarity(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(label))
    kept = sorted(r.doc_id for r in neardup.keep_one(docs(spark, texts)).collect())
    assert kept == sorted(set(label))


def test_near_duplicates_of_one_template(spark):
    """Many copies of one text with changed words: all links between different components are found without all pairs being verified."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 400, 130)]
    texts = []
    for i in range(160):
        t = list(base)
        for p in rng.integers(0, 130, int(rng.integers(1, 9))):
            t[p] = f"n{rng.integers(0, 60 if i % 2 else 100000)}"
        texts.append(" ".join(t))
    label = list(range(160))
    d, h, c = neardup.weighted_sets(texts)
    part = [(h[d == i], c[d == i]) for i in range(160)]
    alike = {(i, j) for i in range(160) for j in range(i) if neardup.prob_jaccard(*part[i], *part[j]) >= 0.8}
    for i, j in sorted(alike):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 150
    # each node a component of its own: every link is among the pairs that the bounds allow, and few others are
    scratch = Scratch(spark, "t")
    sets = scratch.put(docs(spark, texts, False).mapInArrow(neardup._sets, "node long, h array<long>, c array<long>, bits array<long>"), "sets")
    pairs = {(r.b, r.a) for r in neardup.alike_by_prefix(sets, sets.selectExpr("node", "node as comp"), 0.8, scratch).collect()}
    assert alike <= pairs and len(alike) < len(pairs) < 3 * len(alike) < 160 * 159 / 16


def test_near_duplicates_odd_rows(spark):
    t = "a b c d e f g"
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (2, t + " h"), (9, t)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(-1, None), (2, 2), (4, 4), (4, 4), (9, 4)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_word_hashes_long_texts(monkeypatch):
    texts = [" ".join(f"w{i % 97}" for i in range(5000)), "x", None, "A b"]
    whole = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "BLOCK", 512)
    parts = shingles.word_hashes(texts)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert (shingles.word_hashes(["ABC é"])[1] == shingles.word_hashes(["abc é"])[1]).all()


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 16)) + 3 * rng.standard_normal((12, 16))[rng.integers(0, 12, 3000)]
    v[100:140] = v[100]
    rows = [(i, v[i].tolist()) for i in range(3000)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [float("inf")] * 16), (3004, [None] + [1.0] * 15), (3050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, df.filter("vec_id % 50 = 0"), block_rows=700, query_rows=25).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    norm, hit = np.sqrt((v * v).sum(1)), 0
    assert set(got) == set(range(0, 3000, 50))
    for q, found in got.items():
        s = (v * v[q]).sum(1) / (norm * norm[q])
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5].tolist()
        hit += len({i for i, _ in found} & set(best))
        assert all(abs(s[i] - x) < 1e-12 for i, x in found)
    assert hit >= 0.9 * 5 * len(got)
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    few = df.filter("vec_id < 3")
    assert neighbours.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_verify_few():
    """On vectors without any structure, the hardest case, one in twenty is verified and nine in ten neighbours are found."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((4000, 64))
    block = neighbours.Block(np.arange(4000), v, 256, 1.9, 5)
    norm, hit = np.sqrt((v * v).sum(1)), 0
    for q, (ids, _) in zip(range(0, 4000, 100), block.search(np.arange(0, 4000, 100), v[::100], 1.02), strict=True):
        s = (v @ v[q]) / (norm * norm[q])
        s[q] = -9
        hit += len(set(ids.tolist()) & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 5 * 40 and block.verified <= 0.05 * 4000 * block.asked


def test_neighbours_extreme_lengths_and_own_rows(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [5e-324, 0.0]), (0, [1e200, 1e200]), (0, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as `a.b`", "2 as rank")
    got = [(r.vec_id, round(r.score, 12)) for r in sorted(neighbours.nearest(df, df.filter("vec_id = 0").limit(1)).collect(), key=lambda r: r["rank"])]
    assert got == [(0, 1.0), (1, round(3 / 10**0.5, 12)), (0, round(0.5**0.5, 12)), (2, round(0.5**0.5, 12))]


def test_repeated_queries(spark):
    """A query row that is there twice is one query; another vector of the same id is another."""
    rows = [(i, [1.0, 0.1 * i]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = spark.createDataFrame([rows[0], rows[0]], df.schema)
    got = sorted(neighbours.nearest(df, twice).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r.vec_id) for r in got] == [(i, i) for i in range(1, 6)]
    other = neighbours.nearest(df, twice.union(spark.createDataFrame([(0, [0.0, 1.0])], df.schema))).collect()
    assert sorted(r.vec_id for r in other) == [1, 2, 3, 4, 4, 5, 5, 6, 7, 8]


def test_quality_learns(spark):
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "with", "some", "friends"], 60))
    bad = lambda: " ".join(rng.choice(["THE!!", "CAT###", "$$$", "|||", "BUY"], 60))
    truth = rng.random(600) < 0.75
    df = spark.createDataFrame([(i, good() if g else bad()) for i, g in enumerate(truth)] + [(600, None), (601, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(truth) if i % 2] + [(5000, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels, sample=300)
    assert abs(model.prior - 0.75) < 0.15
    got = {r.doc_id: r for r in quality.score_documents(df, model).collect()}
    assert np.mean([got[i].predicted == int(g) for i, g in enumerate(truth)]) > 0.95
    assert got[600].score == got[601].score and 0 <= got[600].score <= 1
    assert quality.train(df, labels.filter("quality = 0")) is None
    assert {r.score for r in quality.score_documents(df, None).collect()} == {0.5}
    assert quality.score_documents(df.limit(0), model).count() == 0


def slow_risk(w, b, p, u, prior):
    """The risk's two parts, a row at a time."""
    loss = lambda z: math.log1p(math.exp(-z))
    z = lambda x: sum(float(a) * float(c) for a, c in zip(x, w, strict=True)) + b
    plus = prior * sum(loss(z(x)) for x in p) / len(p)
    minus = sum(loss(-z(x)) for x in u) / len(u) - prior * sum(loss(-z(x)) for x in p) / len(p)
    return plus, minus


def slow_fit(p, u, prior, steps, l2, rate=0.02):
    """The non-negative risk by Adam, with gradients by differences; says how often it stepped against the negative part."""
    dim = p.shape[1] + 1
    at, m, v, back = np.zeros(dim), np.zeros(dim), np.zeros(dim), 0
    for k in range(1, steps + 1):
        negative = slow_risk(at[:-1], at[-1], p, u, prior)[1] < 0
        back += negative
        goal = lambda t: -slow_risk(t[:-1], t[-1], p, u, prior)[1] if negative else sum(slow_risk(t[:-1], t[-1], p, u, prior))  # noqa: B023, E731
        g = np.array([(goal(at + 1e-5 * e) - goal(at - 1e-5 * e)) / 2e-5 for e in np.eye(dim)]) + l2 * np.append(at[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return at, back


@pytest.mark.parametrize("prior, corrected", [(0.1, False), (0.4, True), (0.95, True)])
def test_risk_against_differences(prior, corrected):
    rng = np.random.default_rng(2)
    p = rng.normal(1, 1, (30, 3)).astype(np.float32)
    u = np.concatenate([rng.normal(1, 1, (20, 3)), rng.normal(-1, 1, (30, 3))]).astype(np.float32)
    want, back = slow_fit(p, u, prior, 60, 0.01, 0.05)
    w, b = quality._minimise(p, u, prior, 60, 0.01, 0.05)
    np.testing.assert_allclose(np.append(w, b), want, atol=5e-3)
    assert (back > 0) == corrected


def test_prior_of_scores():
    rng = np.random.default_rng(7)
    sp = rng.normal(2, 1, 4000)
    for prior in (0.2, 0.6, 0.9):
        n = int(4000 * prior)
        su = np.concatenate([rng.normal(2, 1, n), rng.normal(-3, 1, 4000 - n)])
        cuts = [c for c in np.quantile(sp, np.linspace(0, 0.98, 99))]
        slack = 2 * math.sqrt(math.log(40) / 8000)
        ways = [((su >= c).mean() / (sp >= c).mean(), slack / (sp >= c).mean()) for c in cuts]
        want = min(ways, key=sum)[0]
        assert quality.estimate_prior(sp, su) == pytest.approx(want) and abs(want - prior) < 0.05


def test_held_out(spark):
    from pyspark.sql import functions as F

    got = {r.id: r.h for r in spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
