"""Whole toxicity scores against a plain version over dictionaries; no label, no score of 0.5 or more."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from filigree.llm import toxicity
from test_documents import docs, words


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 0


def plain_scores(rows, labels, k=25):
    """Scores by comparing each text with every example."""
    count = [Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for _, t in rows]
    of = {}
    for d, y in labels:
        if d is not None and y is not None and not held(d):
            of[d] = max(of.get(d, 0), y)
    text = {}
    for (d, t), c in zip(rows, count):
        if d in of and (d not in text or (t or "") < text[d][0]):
            text[d] = (t or "", c)
    ex = sorted(text)
    bad, total = sum(of[d] for d in ex), len(ex)
    df = Counter(w for c in count for w in c)
    n = Counter(w for d in ex for w in text[d][1])
    kk = Counter(w for d in ex for w in text[d][1] if of[d])

    def weight(w):
        a, b, share = n[w], kk[w], bad / total
        cells = [(b, a * share), (a - b, a * (1 - share)), (bad - b, (total - a) * share), (total - bad - a + b, (total - a) * (1 - share))]
        g = 2 * sum(o * math.log(o / e) for o, e in cells if o > 0) if b > a * share else 0.0
        return (math.log((1 + len(rows)) / (1 + df[w])) + 1) * ((max(g, 0) / (max(g, 0) + 50)) ** 2 + 1e-3)

    def unit(c):
        v = {w: (1 + math.log(m)) * weight(w) for w, m in c.items() if w in n}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    units = {d: unit(text[d][1]) for d in ex}
    prior = (bad + 1) / (total + 2)
    none = [of[d] for d in ex if not units[d]]
    without = (sum(none) + prior) / (len(none) + 1)

    def logit(u, copies=True):
        cos = [(round(sum(x * units[d].get(w, 0.0) for w, x in u.items()), 12), d) for d in ex]
        near = sorted((c for c in cos if c[0] > 0 and (copies or c[0] < 1 - 1e-9)), key=lambda c: -c[0])
        kth = near[min(k, len(near)) - 1][0] if near else 0
        assert len({of[d] for c, d in near if c == kth}) < 2 or sum(c >= kth for c, _ in near) <= k  # no ties between labels
        near = near[:k]
        v = [1 / (0.1 + math.sqrt(max(0, 2 - 2 * c))) for c, _ in near]
        p = (sum(x * of[d] for x, (_, d) in zip(v, near)) + prior) / (sum(v) + 1)
        return math.log(p / (1 - p)), near

    x = np.array([logit(units[d], False)[0] for d in ex if units[d]])
    y, a, b = np.array([of[d] for d in ex if units[d]], float), 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
        h = p * (1 - p) + 1e-9
        a, b = np.array([a, b]) - np.linalg.solve(np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]]), g)
    out = []
    for c in count:
        z, near = logit(unit(c))
        out.append(1 / (1 + math.exp(-(max(a, 0.05) * z + b))) if near else without)
    return out


def test_scores_are_those_of_all_pairs(spark):
    rng = random.Random(21)
    rows, labels = [], []
    for d in range(260):
        bad = rng.random() < 0.25
        text = words(rng, rng.randint(5, 60), 300).replace("w", "w" + "abcdefghij"[d % 10])
        text = re.sub(r"\d", lambda m: "klmnopqrst"[int(m[0])], text)
        rows.append((d, text + (" Idiot! " + rng.choice(["moron", "scum"]) if bad and rng.random() < 0.9 else "")))
        if d < 200:
            labels.append((d, 1, int(bad)))
    rows += [(300, None), (301, ""), (302, "12 34"), (303, "zzzz"), (304, rows[7][1]), (None, rows[8][1]), (305, rows[9][1] + " " + words(rng, 30000, 50))]
    got = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = sorted(zip([str(d) for d, _ in rows], plain_scores(rows, [(d, y) for d, _, y in labels])))
    mine = sorted((str(r["doc_id"]), r["score"]) for r in got)
    assert [m[0] for m in mine] == [w[0] for w in want]
    assert np.allclose([m[1] for m in mine], [w[1] for w in want], rtol=1e-6)
    assert len({round(s, 9) for _, s in mine}) > 100


def test_without_labels_nothing_is_toxic(spark):
    for labels in ([], [(5, 1, 1)], [(1, 1, None)]):  # none, none with a text, none with a label
        lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = toxicity.toxicity(docs(spark, [(1, "a"), (2, None), (2, "b c")]), lab).collect()
        assert [(r["score"], r["predicted"]) for r in got] == [(0.25, 0)] * 3


def test_held_out_rows_of_the_table(spark):
    """On sf0.01 held-out rows; on sf0.1 the query gives recall 0.93 at 0.1 % of false alarms."""
    from filigree.llm import queries

    sf = "/root/testdata/sf0.01"
    lab = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    got = [(r["predicted"], lab[r["doc_id"]]) for r in queries.op7_toxicity_neighbours(spark, sf).collect() if r["held_out"] and r["doc_id"] in lab]
    assert sum(p == y for p, y in got) / len(got) > 0.85
