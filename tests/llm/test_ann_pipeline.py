"""Nearest neighbours against brute force, and the pipeline's stages one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import ann, queries

SF = "/root/testdata/sf0.01"


def brute(ids, x, qids, k=10):
    out = {}
    for q in qids:
        own = np.nonzero(ids == q)[0][0]
        d = np.sqrt(((x - x[own]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[i]), d[i]) for i in best if d[i] < np.inf]
    return out


def test_recall_on_the_table(spark):
    got = queries.op1_ann_one_bit_codes(spark, SF)
    assert got.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    e = queries.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    want = brute(ids, x, ids[ids % 100 == 0])
    rows, hit = got.collect(), 0
    for r in rows:
        place = {v: d for v, d in want[r["query_id"]]}
        hit += r["vec_id"] in place
        if r["vec_id"] in place:
            assert abs(place[r["vec_id"]] - r["score"]) < 1e-12
    assert hit / sum(map(len, want.values())) >= 0.9
    assert len(rows) == 10 * len(want)


@pytest.mark.parametrize("lists,probes", [(1, 1), (6, 6)])
def test_odd_vectors_blocks_and_ties(spark, monkeypatch, lists, probes):
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 3)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 7))
    x[100:160] = x[100]  # one vector a fifth of all rows
    rows = [(int(i), [float(v) for v in r], "q") for i, r in enumerate(x)]
    odd = [(1000, None, "q"), (1100, [0.0] * 7, "q"), (1200, [1.0, float("nan")] + [0.0] * 5, "q"), (1300, [float("inf")] + [1.0] * 6, "q"), (1400, [1.0, None] + [1.0] * 5, "q"), (1500, [1.0, 2.0], "q"), (None, [1.0] * 7, "q"), (1600, [], "q")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, query_id string")
    got = ann.search(df, F.col("vec_id") % 20 == 0, eps=6.0, lists=lists, probes=probes).collect()
    want = brute(np.arange(300), x, np.arange(0, 300, 20))
    mine = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert mine.keys() == want.keys()
    for q in want:
        assert [v for v, _ in mine[q]] == [v for v, _ in want[q]]
        assert np.allclose([d for _, d in mine[q]], [d for _, d in want[q]], atol=1e-12)


def test_bounds_choose_few_rows_of_the_larger_table(spark):
    """sf0.1, all rows against 100 queries: recall, and the share of the rows that is measured on the vectors."""
    e = queries.table(spark, "/root/testdata/sf0.1", "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    turn, centre = ann.rotation(256, 11), x.mean(0)
    codes, length, own = ann.encode(x - centre, turn)
    picked = np.arange(0, len(ids), 20)
    q, i, d, n = ann.cell_search(ids, x, codes, length, own, ids[picked], x[picked], centre, turn, 10, 1.9)
    want = brute(ids, x, ids[picked])
    hit = sum(any(v == b for v, _ in want[a]) for a, b in zip(q, i))
    assert hit / (10 * len(picked)) >= 0.9
    share = n[::10].mean() / len(ids)
    print("recall", hit / (10 * len(picked)), "reranked", share)
    assert share < 0.1
    # The estimate from packed bits is the inner product of the code itself, up to the query's steps.
    words, signs = ann.words_of(codes), np.unpackbits(codes, axis=1) * 2.0 - 1
    asked = ann.Asked(x[:3] - centre, turn)
    for j in range(3):
        guess, slack = ann.estimate(words, length, own, asked, j, 256, 1.9)
        inner = signs @ ((x[j] - centre) @ turn[:64]) / 16 / own
        exact = length**2 + length[j] ** 2 - 2 * length * inner
        assert np.abs(guess - exact).max() < 0.12 and (slack >= 0).all()


def test_few_and_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0])], kind)
    got = ann.search(two, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 1)]
    assert ann.search(spark.createDataFrame([], kind), F.col("vec_id") == 0).count() == 0
    assert ann.search(two, F.col("vec_id") == 7).count() == 0


def test_pipeline_stages(spark):
    """Each stage's decisions hold in what it returns, judged by brute force on its own input."""
    import corpus_pipeline as P
    from test_documents import plain_contained
    from test_simhash_components import plain_similar_groups

    assert [n for n, _ in P.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = queries.table(spark, SF, "documents")
    columns, made = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        docs = P.written(stage(spark, docs, SF), f"test{i}")
        made.append(docs.collect())
        assert docs.columns == columns or i == 4
    ids = [sorted(r["doc_id"] for r in rows) for rows in made]
    first = made[0]
    assert ids[1] == sorted(set(plain_similar_groups([(r["doc_id"], r["text"]) for r in first])))
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    bad = {w.split(",")[0][1:] for w in plain_contained([(r["doc_id"], r["text"]) for r in made[1]], items)}
    assert ids[2] == [d for d in ids[1] if str(d) not in bad] and bad
    assert set(ids[3]) <= set(ids[2]) and len(ids[3]) > 0.5 * len(ids[2])
    assert ids[4] == ids[3]
    assert {r["start"] for r in made[4]} == set(np.cumsum([0, *[r["n_tokens"] for r in sorted(made[4], key=lambda r: r["start"])]])[:-1].tolist())


def test_pipeline_of_no_documents(spark):
    import corpus_pipeline as P

    docs = queries.table(spark, SF, "documents").limit(0)
    for i, (_, stage) in enumerate(P.STAGES):
        docs = P.written(stage(spark, docs, SF), f"none{i}")
        assert docs.count() == 0
