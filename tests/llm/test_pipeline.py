"""Each stage of the pipeline against a brute-force version of what it does."""

import numpy as np
from test_arrow import slow_similarity
from test_native import brute_lines, brute_mix

import corpus_pipeline
from lifegrid.llm import mixing, quality, sentencepieces
from lifegrid.llm.pieces import default_path

SHARED = ["a passage that many of the documents have in common", "another passage of that kind, with other words in it"]


def make(spark, folder):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(160):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 90)))]
        good = i % 7 != 3
        text = " ".join(words) if good else " ".join(w.upper() + "###" for w in words)
        if good and i % 5 == 0:
            text += "\n" + SHARED[i % 2]
        if good and i % 11 == 0 and i:
            text = docs[i - 1][1] + " tail"
        docs.append((i, text, "en" if i % 3 else "de", f"src{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(200, None, None, None, 0), (201, "", "en", "src1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, tmp_path):
    make(spark, tmp_path)
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mixture", "token_ids"]
    step = dict(corpus_pipeline.STAGES)

    kept = step["quality"](spark, docs, folder).cache()
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    every = rows(docs)
    scores = {i: float(model.score(quality.features([r.text]))[0]) for i, r in every.items()}
    assert kept.columns == docs.columns
    assert set(rows(kept)) == {i for i, s in scores.items() if s >= 0.3}

    cut = step["lines"](spark, kept, folder).cache()
    ids = sorted(rows(kept))
    place = dict(enumerate(ids))
    want = {place[k]: v[2] for k, v in brute_lines([every[i].text for i in ids]).items()}
    got = rows(cut)
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values()) and cut.columns == docs.columns

    single = step["near_duplicates"](spark, cut, folder).cache()
    label = {i: i for i in want}
    for a in sorted(want):
        for b in sorted(want):
            if a < b and want[a].split() and want[b].split() and slow_similarity(want[a], want[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    assert set(rows(single)) == set(label.values()) and len(rows(single)) < len(want)

    mixed = step["mixture"](spark, single, folder).cache()
    full = [(i, mixing.DOMAIN_OF[int(r.source[3:]) % 4] if r.source else "other", r.lang or "", r.source or "", len(r.text.split())) for i, r in rows(single).items() if r.text.split()]
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, _ in brute_mix(full, 7, 0.8, 2)) and mixed.columns == docs.columns

    lib = sentencepieces.Model(default_path("piece_bpe_32k.model")).lib
    ends = step["token_ids"](spark, mixed, folder).collect()
    assert len(ends) == mixed.count() and all(r.ids == lib.encode(want[r.doc_id]) and r.round_trip for r in ends)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()) == sorted(r.doc_id for r in ends)
