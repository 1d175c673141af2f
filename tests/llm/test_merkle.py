"""The Merkle manifest against a plain recursion, its addresses, and its edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lifegrid.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


@given(st.integers(1, 6), st.integers(2, 4))
@settings(max_examples=30, deadline=None)
def test_addresses_are_a_layout(levels, fan):
    table = merkle.addresses(levels, fan)
    assert sorted(np.concatenate(table).tolist()) == list(range(merkle.nodes_in(levels, fan)))
    for depth, row in enumerate(table):
        assert row.tolist() == [merkle.address(depth, i, levels, fan) for i in range(fan**depth)]


def test_subtrees_are_contiguous():
    """Four levels: the upper two first, then each lower tree of two levels in one piece."""
    assert [merkle.address(d, i, 4, 2) for d, i in [(0, 0), (1, 0), (1, 1)]] == [0, 1, 2]
    for tree in range(4):
        at = 3 + 3 * tree
        assert [merkle.address(2, tree, 4, 2), merkle.address(3, 2 * tree, 4, 2), merkle.address(3, 2 * tree + 1, 4, 2)] == [at, at + 1, at + 2]


@given(st.integers(1, 70), st.data())
@settings(max_examples=40, deadline=None)
def test_block_round_trip(n, data):
    leaves = [H(str(i)) for i in range(n)]
    levels = merkle.levels_of(n)
    stored, root = merkle.build_block(leaves, levels)
    rows = merkle.read_block(stored, n, levels)
    assert rows[-1] == leaves and rows[0] == [root]
    path = merkle.path_in(rows, i := data.draw(st.integers(0, n - 1)))
    assert merkle.fold(leaves[i], path) == root and merkle.unpack(merkle.pack(path)) == path


def plain(rows, fan=8):
    """doc_id -> set of results, by the definitions."""

    def leaf(r, low=False):
        out = []
        for i in (0, 3, 2, 4, 1):
            v = r[i]
            if v is not None and low and i == 1:
                v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
            out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
        return H("".join(out))

    def up(nodes):
        """root, and each node's levels of (left, right) siblings."""
        paths, at, row = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(row) > 1:
            for i in range(len(nodes)):
                run = at[i] // fan * fan
                paths[i].append((row[run : at[i]], row[at[i] + 1 : run + fan]))
                at[i] //= fan
            row = [H("".join(row[j : j + fan])) for j in range(0, len(row), fan)]
        return row[0], paths

    by = {}
    for r in rows:
        by.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    langs = sorted(by, key=lambda g: g.encode())
    trees = {g: (rs := sorted(by[g], key=lambda r: (-1 if r[0] is None else r[0], leaf(r))), up([leaf(r) for r in rs])) for g in langs}
    root, above = up([trees[g][1][0] for g in langs])
    out = []
    for g, over in zip(langs, above, strict=True):
        rs, (sub, paths) = trees[g]
        for r, path in zip(rs, paths, strict=True):
            changed = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            own = leaf(r, changed)
            for a, b in path + over:
                own = H("".join([*a, own, *b]))
            out.append((r[0], leaf(r), sub, root, H("".join(h for a, b in path + over for h in (*a, *b))), own, own == root))
    return sorted(out, key=str)


ROWS = [
    (1, "Same Text", "en", "a", 9), (1, "Same Text", "en", "a", 9), (2, None, "en", None, None), (None, "No Id", "en", "a", 5), (None, None, None, None, None), (3, "", "de", "b", 0), (4, "ÄÖ é ABC", "zz", "b", 8), (5, "-", "", "b", 1),
    *[(i, f"Text {i} OF many", "en" if i % 3 else "fr", "hot", i) for i in range(10, 150)], (200, "Y" * 300_000, "en", "b", 300_000),
]


@pytest.mark.parametrize("height", [1, 2, 4])
def test_manifest(spark, height):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "1 as k", "2 as g", "3 as leaf", "4 as seen", "5 as n", "6 as b").repartition(5)
    m = merkle.manifest(df, merkle.tampered_text(), height)
    got = m.verified().collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)
    assert 0 < sum(r["verified"] for r in got) < len(ROWS)
    if height == 4:
        assert all(r["verified"] for r in merkle.manifest(df, height=height).verified().collect())


def test_empty_and_single(spark):
    df = spark.createDataFrame(ROWS[:0], "doc_id long, text string, lang string, source string, n_chars long")
    m = merkle.manifest(df)
    assert m.root is None and m.verified().count() == 0
    one = spark.createDataFrame([(7, "x", "en", "s", 1)], df.schema)
    (r,) = merkle.manifest(one).verified().collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == H("") and r["verified"]


def test_many_languages(spark):
    """More languages than a block of the upper tree holds."""
    rows = [(i, f"T{i}", f"l{i % 30}", "s", 1) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, merkle.manifest(df, merkle.tampered_text(), 1).verified().collect()), key=str) == plain(rows)
