"""Alignment of two tokenizers against a brute-force version, its merge paths and its edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lifegrid.llm import alignment
from lifegrid.llm.pieces import default_path

ENDS = st.lists(st.integers(1, 4), min_size=1, max_size=40)


@given(ENDS, ENDS, st.integers(1, 50))
@settings(max_examples=300, deadline=None)
def test_merge_paths(a, b, work):
    a, b = np.cumsum(a), np.cumsum(b)
    top = max(a[-1], b[-1])
    a, b = (np.append(x[x < top], top) for x in (a, b))
    spans = lambda e: list(zip([0, *e[:-1].tolist()], e.tolist(), strict=True))
    want = [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (p, q) in enumerate(spans(b)) if max(s, p) < min(e, q)]
    x, y, cuts = alignment.merge(a, b, work)
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == want
    assert cuts.tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_pieces_have_equal_work():
    a, b = np.arange(1, 100_001) * 3, np.arange(1, 150_001) * 2
    i = alignment.crossings(a, b, 1000)
    j = np.append(np.arange(0, 250_000, 1000), 250_000) - i
    assert set((np.diff(i) + np.diff(j)).tolist()) == {1000} and (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()


@pytest.fixture(scope="module")
def libs():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain(libs, texts):
    """One row a text, by the definitions, token by token."""
    a_lib, b_lib = libs
    letter = letters()
    docs = []
    for t in texts:
        none = (0, 0, 0, 0, "", Counter())
        if not t:
            docs.append(none)
            continue
        a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
        ab = [bytes(letter[c] for c in a_lib.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            docs.append(none)
            continue
        ends = lambda xs: np.cumsum([len(x) for x in xs]).tolist()
        ea, eb = ends(ab), ends(bb)
        cuts = sorted(set(ea) & set(eb))
        text = ";".join(",".join(str(i) for i, e in zip(a, ea, strict=True) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, eb, strict=True) if lo < e <= hi) for lo, hi in zip([0, *cuts], cuts, strict=False))
        links, j = Counter(), 0
        for i, (s, e) in enumerate(zip([0, *ea], ea, strict=False)):
            while eb[j] <= s:
                j += 1
            k = j
            while k < len(eb) and (eb[k - 1] if k else 0) < e:
                links[a[i], b[k]] += 1
                k += 1
        docs.append((len(a), len(b), len(cuts), sum(links.values()), hashlib.sha256(text.encode()).hexdigest(), links))
    n = Counter(p for d in docs for p in d[5])
    top: dict[int, int] = {}
    for (x, _), c in n.items():
        top[x] = max(top.get(x, 0), c)
    return [(*d[:4], sum(t for p, t in d[5].items() if n[p] == top[p[0]]), sum(t * n[p] for p, t in d[5].items()), d[4]) for d in docs]


RNG = np.random.default_rng(5)
WORDS = ["the", "of", "Ünder", "thing", "hea", "réal", "x1", "日本語", "#tag", "don't", "a.b,c", "<|endoftext|>", "</s>", "<0x41>", "UPPER", "ß", "é", "😀", "supercalifragilistic"]
TEXTS = [
    None, "", " ", "\n\n", "one", "  lead", "trail ", "a  b\t\x1cc", "▁mark", "a\0b", "<|endoftext|>", ". x, y", "é", "ﬁ ligature", " nbsp", "same text", "same text",
    *[" ".join(RNG.choice(WORDS, 50)) + RNG.choice(["", ".", "\n", ", x. y"]) for _ in range(30)], "z" * 3000, "日本" * 800, "ab " * 2000,
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB1.,'!_ \n\t\x1c　é²ß日́▁$<|>")), max_size=40), min_size=1, max_size=5), st.integers(1, 60))
def test_batches(libs, texts, work):
    pair = alignment._pair(None, None)
    rows = alignment.align_batch(pair, pair.encode(texts), work)
    assert [r[:5] for r in rows] == [(*r[:4], r[6]) for r in plain(libs, texts)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1., \né日́$")), min_size=1, max_size=80), st.integers(1, 30))
def test_stitched_pieces(text, work):
    pair = alignment._pair(None, None)
    (tokens,) = pair.encode([text])
    if tokens is not None:
        names = ("n_a", "n_b", "n_groups", "n_links", "pairs", "times", "head_a", "head_b", "whole", "tail_a", "tail_b")
        rows = [dict(zip(names, alignment.align_piece(*p[1:]), strict=True)) for p in alignment.pieces_of(pair, tokens, work)]
        assert alignment.stitch(rows) == alignment.align_batch(pair, [tokens], 1000)[0]


@pytest.mark.parametrize(("giant", "held", "work"), [(1 << 18, 10**6, 1 << 16), (40, 0, 16)])
def test_align_documents(spark, libs, giant, held, work):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (15, "same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as row", "3 as pairs", "4 as n_a").repartition(3)
    got = sorted(map(tuple, alignment.align_documents(df, held, work=work, giant=giant).collect()), key=str)
    want = plain(libs, [t for _, t in rows])
    assert got == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=str)


def test_empty(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
