"""Decontamination, repeated passages, token counts, token files, toxicity and quality against brute force, with the odd cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filigree.llm import decontam, quality, queries, substring, tokenbin, tokencount, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, start long"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None, 0.0, 0) for d, t in rows], DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- decontamination ----------------------------------------------------------


def plain_contained(rows, items, n=5, threshold=0.8):
    cut = lambda t: re.findall(decontam.WORD, (t or "").lower())
    sh = lambda t, n: {tuple(w[i : i + n]) for w in [cut(t)] for i in range(len(w) - n + 1)}
    sets = [(i, m, sh(u, m)) for i, u in items if (m := min(n, len(cut(u))))]  # short items are one shingle of all their words
    out = []
    for d, t in rows:
        all_own = {m: sh(t, m) for m in {m for _, m, _ in sets}}
        for i, m, s in sets:
            own = all_own[m]
            if s and len(s & own) >= threshold * len(s) - 1e-9:
                out.append(str((d, i, len(s), len(s & own))))
    return sorted(out)


def test_contained_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    rng = random.Random(2)
    items = [(i, words(rng, rng.randint(3, 45))) for i in range(25)] + [(None, words(rng, 20)), (7, None), (8, ""), (9, "A, b! c? D; e"), (11, "Two words"), (12, "?!")]
    rows = [(1, None), (2, ""), (None, "x " + items[0][1]), (3, "a B C d E"), (3, "a B C d E"), (5, "one, TWO; words"), (4, words(rng, 30000) + " " + (items[25][1]).upper() + ". " + words(rng, 100))]
    for d in range(10, 60):
        own = items[rng.randrange(25)][1].split()
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = "changed"
        rows.append((d, words(rng, 40) + "\n" + ", ".join(own) + " " + words(rng, 40)))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(str((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"])) for r in decontam.contained_items(docs(spark, rows), bench).collect())
    want = plain_contained(rows, items)
    assert got == want and len(want) > 20
    bad = {w.split(",")[0][1:] for w in want}
    clean = decontam.without_items(docs(spark, rows), bench)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in rows if str(d) not in bad)
    none = bench.limit(0)
    assert decontam.contained_items(docs(spark, rows), none).count() == 0
    assert decontam.without_items(docs(spark, rows), none).count() == len(rows)
    assert decontam.contained_items(docs(spark, []), bench).count() == 0


# ---- repeated passages ----------------------------------------------------------


def plain_repeats(rows, min_words):
    seen, units = {}, []
    own = {}
    for d, t in rows:
        own.setdefault((d, t), None)
    order = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, int(np.uint64(__import__("xxhash").xxh3_64_intdigest(r[1] or "")).astype(np.int64))))
    out = []
    for d, t in order:
        run = []
        for u in [*substring.units_of(t), None]:
            if u is not None and u[3] in seen:
                run.append(u)
                continue
            if run and sum(x[2] for x in run) >= min_words:
                out.append((d, run[0][0], run[-1][1], sum(x[2] for x in run), len(run)))
            run = []
            if u is not None:
                seen[u[3]] = d
    return sorted(map(str, out)), units


def test_repeated_passages(spark):
    rng = random.Random(4)
    sentence = lambda: words(rng, rng.randint(3, 9)).capitalize() + rng.choice(".,;!?")
    passages = [" ".join(sentence() for _ in range(12)) for _ in range(4)]
    rows = [(None, passages[0]), (5, None), (6, ""), (7, " .,;\n"), (8, passages[3]), (8, passages[3]), (9, "common line here.\n" * 3)]
    for d in range(20, 70):
        text = [sentence() for _ in range(20)]
        if rng.random() < 0.6:
            text.insert(rng.randrange(20), "and then " + rng.choice(passages))
        rows.append((d, "\n".join(text) + "\ncommon line here."))
    rows.append((90, rows[-1][1]))
    rows.append((91, words(rng, 60000)))
    got = sorted(str((r["doc_id"], r["start"], r["end"], r["n_words"], r["n_units"])) for r in substring.repeats(docs(spark, rows), min_words=20).collect())
    assert got == plain_repeats(rows, 20)[0]
    kept = substring.without_repeats(docs(spark, rows), min_words=20)
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    for d, t in rows:
        for g in (g for g in got if g.startswith(f"({d},")):
            _, a, b, *_ = eval(g)
            assert t[a:b] not in (texts[d] or "") or texts[d] == t[:a] + t[b:]
    assert substring.repeats(docs(spark, [])).count() == 0


# ---- token counts ------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


ODD = st.text(st.sampled_from("ab' \n\tsé1.,!<>tllreveмир　"), max_size=120)


@settings(max_examples=150, deadline=None)
@given(ODD, st.lists(st.tuples(st.integers(0, 140), st.integers(0, 20), st.text(st.sampled_from("a 'sl\n1é"), max_size=12)), max_size=4), st.integers(1, 5))
def test_edits_count_like_the_whole_text(text, edits, leaf):
    c = tokencount.Counter.at(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    before, tokencount.LEAF = tokencount.LEAF, leaf
    try:
        tree = tokencount.build(c, text)
        assert tree.total == c.whole(text)
        for start, n, new in edits:
            start = min(start, len(text))
            text, _ = tokencount.edit(c, tree, text, start, min(len(text), start + n), new)
            assert tree.total == c.whole(text)
            assert int(tree.chars[0].sum()) == len(text)
    finally:
        tokencount.LEAF = before


def test_long_text_encodes_little(counter):
    rng = random.Random(3)
    text = words(rng, 40000) + " mail me@example.com now " + words(rng, 40000)
    tree = tokencount.build(counter, text)
    (start, end, new), *more = tokencount.masks(text)
    after, n = tokencount.edit(counter, tree, text, start, end, new)
    assert not more and tree.total == counter.whole(after) and n < 300


def test_edit_query(spark):
    c = tokencount.Counter.at(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = queries.op4_edit_token_counts(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    assert len(got) == len(texts) and any(r["n_edits"] for r in got)
    for r in got:
        t = texts[r["doc_id"]]
        after = tokencount._MASK.sub(lambda m: tokencount.MASKS[m.lastindex - 1][1], t)
        assert (r["n_tokens"], r["n_tokens_after"]) == (c.whole(t), c.whole(after))
    odd = tokencount.counts_after_edits(docs(spark, [(1, None), (None, ""), (2, "a"), (2, "a")]), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(r["n_tokens_after"] for r in odd.collect()) == [0, 0, 1, 1]
    assert tokencount.counts_after_edits(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# ---- token files -------------------------------------------------------------------


def test_chunks_encode_like_the_whole_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    e = tokenbin.Encoder(path)
    texts = ["", None, "Hello  World's end\n\x0b\x0c\r x", "Σίγμας ΣΑΣ", "é ́x  y　z\x85w\x1cq", "<|endoftext|> a<|startoftext|>b", "1234 a1b2 ٣", "word " * 30000, "x" * 5000]
    for t, ids in zip(texts, e.ids(texts)):
        assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text_encodes_like_the_whole(texts):
    e = tokenbin.Encoder.at(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for t, ids in zip(texts, e.ids(texts)):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(6)
    rows = [(None, "no id"), (3, None), (2, ""), (9, words(rng, 30000)), (4, "same"), (4, "same")] + [(100 + i, words(rng, rng.randint(1, 80))) for i in range(300)]
    out = f"file://{tmp_path}/shards"
    made = tokenbin.write_shards(docs(spark, rows), out, path, 2, shard_docs=64)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in tokenbin.read_shards(made, out).collect())
    tok = tokenbin.Encoder.at(path).tokenizer
    start, order = 0, []
    for (s, n, crc, d) in got:
        assert s == start
        start += n
        order.append(d)
    assert order[0] is None and order[1:] == sorted(order[1:]) and len(order) == len(rows)
    want = Counter()
    for d, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert want == Counter((d, n, crc) for _, n, crc, d in got)
    shard = next(p for p in sorted((tmp_path / "shards").iterdir()) if p.suffix == ".tok")
    raw = bytearray(shard.read_bytes())
    raw[-20] ^= 1
    (tmp_path / "broken.tok").write_bytes(raw)
    with pytest.raises(ValueError):
        tokenbin.Shard(tokenbin.FileSystem.from_uri(out)[0], str(tmp_path / "broken.tok"))
    assert tokenbin.token_table(docs(spark, []), path, 2).count() == 0


# ---- toxicity ------------------------------------------------------------------------


def test_block_max_finds_the_nearest():
    rng = np.random.default_rng(0)
    vectors = [(np.sort(rng.choice(40, rng.integers(0, 6), replace=False)), None) for _ in range(700)]
    vectors = [(t, rng.integers(1, 5, len(t)).astype(float)) for t, _ in vectors]
    index = toxicity.Index(np.arange(700), (rng.random(700) < 0.3).astype(int), vectors, rng.random(40) + 0.5)
    dense = np.zeros((len(index.ids), 40))
    for i, (t, w) in enumerate(index.vectors):
        dense[i, t] = w
    for t, n in vectors[:200]:
        if len(t):
            t, w = index.weights(t, n)
            q = np.zeros(40)
            q[t] = w
            cos = dense @ q
            at, got = index.nearest(t, w, 25)
            assert np.allclose(got, np.sort(cos[cos > 0])[::-1][:25])
            assert np.allclose(cos[at], got)


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for d in range(1500):
        bad = d % 8 == 0
        rows.append((d, words(rng, 60) + (" Idiot! " + rng.choice(["moron", "scum"]) if bad else "")))
        labels.append((d, 1, int(bad)))
    rows += [(None, "idiot moron"), (5000, None), (5001, ""), (5001, ""), (5002, "idiot " * 50000)]
    labels += [(None, 1, 1), (3, 1, None), (8, 1, 0), (8, 1, 0), (9999, 0, 1)]
    df = docs(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in rows if d is not None}
    assert all(r["held_out"] == held.get(r["doc_id"], False) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 8 == 0) for r in got if r["held_out"] and r["doc_id"] < 1500]
    assert sum(right) / len(right) > 0.98
    by = {r["doc_id"]: r for r in got}
    assert by[5002]["predicted"] == 1 and by[None]["predicted"] == 1 and by[5000]["score"] == by[5001]["score"] < 0.5
    assert all(not held[e] for r in got for e in r["evidence"])
    # Labels of held-out rows change nothing.
    turned = spark.createDataFrame([(d, q, 1 - t if t is not None and d is not None and held.get(d) else t) for d, q, t in labels], "doc_id long, quality int, toxic int")
    again = {str(r["doc_id"]): round(r["score"], 9) for r in toxicity.toxicity(df, turned).collect()}
    assert again == {str(r["doc_id"]): round(r["score"], 9) for r in got}


def test_toxicity_without_labels_or_documents(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, [(1, "a"), (2, None)]), lab).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    some = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs(spark, []), some).count() == 0


# ---- quality ----------------------------------------------------------------------------


def plain_kneser_ney(trusted, texts):
    """Perplexities by the textbook recursion over dictionaries."""
    n = quality.ORDER
    cut = lambda t: ["\2"] * (n - 1) + list((t or "").replace("\2", " ").replace("\3", " ")) + ["\3"]
    grams = lambda t: [tuple(c[i : i + n]) for c in [cut(t)] for i in range(len(c) - n + 1)]
    levels = {n: Counter(g for t in trusted for g in grams(t))}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    less, total, back = {}, {}, {}
    for k, level in levels.items():
        c = Counter(level.values())
        d = [0.5, 1.0, 1.5]
        if all(c[i] for i in (1, 2, 3, 4)):
            y = c[1] / (c[1] + 2 * c[2])
            d = [min(max(i - (i + 1) * y * c[i + 1] / c[i], 0.05), i - 0.01) for i in (1, 2, 3)]
        less[k], total[k], back[k] = d, defaultdict(int), defaultdict(float)
        for g, v in level.items():
            total[k][g[:-1]] += v
            back[k][g[:-1]] += d[min(v, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(levels[1]) + 1)
        if not total[k][g[:-1]]:
            return p(g[1:])
        v = levels[k].get(g, 0)
        own = (v - less[k][min(v, 3) - 1]) / total[k][g[:-1]] if v else 0.0
        return own + back[k][g[:-1]] / total[k][g[:-1]] * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / len(grams(t))) for t in texts]


def test_perplexity_is_kneser_neys(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(1, 30), 30)) for i in range(60)] + [(100, "ZZZ!! QQ$$$ ééé 漢字 \U0001f600 \2\3"), (101, ""), (102, None), (None, "w1 w2"), (103, "x" * 5000), (104, "same w1"), (104, "same w1")]
    labels = [(i, 1, 0) for i in range(40)] + [(41, 0, 0), (42, 1, 0), (42, 0, 0), (None, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = [t for d, t in rows if d is not None and d < 40]
    for hot in (1, 50, 1 << 18):  # whatever part goes by the shards
        got = quality.score_quality(docs(spark, rows), lab, hot_size=hot).collect()
        want = sorted(zip([str(d) for d, _ in rows], [round(v, 6) for v in plain_kneser_ney(trusted, ["".join(c if ord(c) < 0x10000 else "￿" for c in t or "") for _, t in rows])]))
        mine = sorted((str(r["doc_id"]), round(r["perplexity"], 6)) for r in got)
        assert [m[0] for m in mine] == [w[0] for w in want]
        assert np.allclose([m[1] for m in mine], [w[1] for w in want], rtol=1e-6)
    kept = {r["doc_id"] for r in got if r["keep"]}
    assert set(range(40)) <= kept and not {101, 102} & kept


def test_quality_keeps_all_without_trusted_text_and_columns(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "some text"), (2, "other"), (3, None)]
    out = quality.kept(docs(spark, rows), lab)
    assert out.columns == docs(spark, rows).columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]
    assert quality.score_quality(docs(spark, []), lab).count() == 0


def test_quality_tells_junk(spark):
    found = {r["doc_id"]: r["keep"] for r in queries.op6_quality_perplexity(spark, "/root/testdata/sf0.01").collect()}
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels").collect()
    good = [found[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [found[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.4
