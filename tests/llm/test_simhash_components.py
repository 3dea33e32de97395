"""Components, fingerprints and near-duplicate groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from filigree.llm import simhash
from filigree.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else (least[r] if d is None else min(least[r], d))
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprint_is_the_contracts():
    rng = random.Random(1)
    texts = ["", None, " \n\t", "One", "one TWO", "a b c", "ÀÉ Ünïcode words here", "x " * 70000]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_fingerprint_agrees_with_spark(spark):
    got = spark.sql("select xxhash64('a b c') h").first()["h"]
    assert np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)) == np.int64(got).view(np.uint64)


@pytest.mark.parametrize("seed", [0, 1])
def test_links_keep_components(spark, monkeypatch, seed):
    """Random fingerprints with crowded halves; small thresholds so that the grid of blocks is used."""
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set()
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    edges = [(r["u"], r["v"]) for r in found.collect()]
    far = [bin((u ^ v) & (2**64 - 1)).count("1") for u, v in edges]
    assert max(far) <= 3
    root = {s: s for s in signed}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        root[find(u)] = find(v)
    want = plain_components(list(range(len(fps))), fps)
    mine = {}
    for s, w in zip(signed, want):
        assert mine.setdefault(find(s), w) == w
    assert len(set(want)) == len(mine)


def test_components_of_chains_stars_and_repeats(spark):
    rows = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (2, 1), (2, 1), (None, 5)]
    got = dict(components(spark.createDataFrame(rows, "u long, v long")).collect())
    assert all(got[i] == 1 for i in range(2, 41))
    assert all(got[100 + i] == 100 for i in range(1, 30))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_with_nulls_copies_and_near_copies(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(400)]
    base = " ".join(rng.choice(words) for _ in range(1500))
    rows = [(10, base), (4, base), (11, base.replace("w7 ", "w8 ", 1)), (3, ""), (8, None), (None, "only this"), (20, "something else entirely"), (20, "something else entirely")]
    rows += [(30 + i, " ".join(rng.choice(words) for _ in range(40))) for i in range(20)]
    df = frame(spark, [(d, t, "en", None, None) for d, t in rows])
    got = simhash.simhash_components(df).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip([d for d, _ in rows], plain_components([d for d, _ in rows], fps))))
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {3, 4, 20} <= set(ids) and not {8, 10} & set(ids)


def test_empty_table_and_clashing_columns(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    assert simhash.keep_one(frame(spark, [])).count() == 0
    clash = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a b c d", 5, 6, 8)], "doc_id long, text string, fp long, component_id long, rows int")
    assert {r["component_id"] for r in simhash.simhash_components(clash).collect()} == {1}
    assert simhash.keep_one(clash).select(F.max("rows")).first()[0] == 7


def plain_similar_groups(rows, similarity=0.8, recall=0.95):
    """For each row the smallest id of its group, from the complete distances of all pairs of long fingerprints."""
    wide = simhash.Wide.of(len(rows), similarity, recall)
    bits = np.array([simhash.wide_fingerprint(t, 5, wide, simhash._Hashes()) for _, t in rows])
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in np.nonzero((bits[:i] != bits[i]).sum(1) <= wide.radius)[0]:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_bit_counts():
    rng = np.random.default_rng(2)
    for n in (0, 1, 254, 255, 256, 511, 5000):
        rows = rng.integers(0, 256, (n, 8), dtype=np.uint8)
        rows[: n // 2] = 255
        assert (simhash.bit_counts(rows) == np.unpackbits(rows, axis=1).sum(0)).all()


@pytest.mark.parametrize("crowded", [False, True])
def test_similar_texts_keep_one(spark, monkeypatch, crowded):
    """Texts with a few words changed go, others stay; groups of many differing texts too, by the grid of blocks."""
    if crowded:
        monkeypatch.setattr(simhash, "SMALL", 3)
        monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(7)
    word = lambda: "w%d" % rng.randrange(3000)
    rows = [(1000, None), (1001, ""), (None, "only this one"), (None, "only that one"), (1002, "two words"), (1003, "Two words"), (1004, "two  words")]
    for g in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for k in range(12 if g < 2 else 3):
            own = list(base)
            for at in rng.sample(range(len(own)), k % 3):
                own[at] = word()
            rows.append((10 * len(rows), " ".join(own)))
    rows += [(5, rows[20][1]), (5, rows[20][1]), (6, " ".join(word() for _ in range(60000)))]
    out = simhash.keep_similar_one(frame(spark, [(d, t, "en", None, None) for d, t in rows]))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = plain_similar_groups(rows)
    want = {g for g in groups if g is not None}
    assert len(got) == len(set(got)) and {d for d, _ in got if d is not None} == want
    assert sorted(t for d, t in got if d is None) == ["only that one", "only this one"]
    assert {5, 6, 1000, 1002} <= want and not {1001, 1003, 1004} & want and len(want) < 25
    assert simhash.keep_similar_one(frame(spark, [])).count() == 0


def test_recall_of_similar_pairs(spark):
    """Of the pairs of sf0.01 at a Jaccard similarity of 0.8 or more in five words, few are left; hardly a text goes that has no near one."""
    from filigree.llm import queries

    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in simhash.keep_similar_one(docs).select("doc_id").collect()}
    sets = {}
    for d, t in rows.items():
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(rows)
    best, left, pairs = dict.fromkeys(ids, 0.0), 0, 0
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both:
                j = both / (len(sets[a]) + len(sets[b]) - both)
                best[a], best[b] = max(best[a], j), max(best[b], j)
                pairs += j >= 0.8
                left += j >= 0.8 and a in kept and b in kept
    gone = [best[d] for d in ids if d not in kept]
    print("pairs", pairs, "left", left, "gone", len(gone), "gone below 0.7", sum(j < 0.7 for j in gone))
    assert left <= 0.1 * pairs and sum(j < 0.7 for j in gone) <= 0.1 * len(gone)


def test_query_has_the_contracts_columns(spark):
    from filigree.llm import queries

    got = queries.op5_simhash_components(spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    rows = got.collect()
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert all(r["fingerprint"] == f"{plain_fingerprint(docs[r['doc_id']]):016x}" for r in rows)
    ids = [r["doc_id"] for r in rows]
    assert [r["component_id"] for r in rows] == plain_components(ids, [int(r["fingerprint"], 16) for r in rows])
