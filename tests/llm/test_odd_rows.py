"""Odd rows and settings: columns with the operators' own names, null ids, long texts, edits one after another, no shared folder."""

import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filigree.llm import decontam, mixing, quality, substring, tokenbin, tokencount
from test_documents import docs, words

ROOT = Path(__file__).resolve().parent.parent.parent
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CLASH = "doc_id long, text string, lang string, source string, _id long, _hash long, _times int, _cuts string, key long, cuts int, c0 int, `a.b` int"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1, 2, 3, "x", 5, 6, 7, 8) for d, t in rows], CLASH)


# ---- clashing columns -----------------------------------------------------------


def test_columns_with_the_operators_names(spark):
    rng = random.Random(1)
    line = "the very same line\n"
    rows = [(i, line * (i % 2) + words(rng, 30)) for i in range(12)] + [(None, line + "x"), (None, line + "y"), (3, None), (4, "")]
    df = clashing(spark, rows)
    lab = spark.createDataFrame([(0, 1), (2, 1)], "doc_id long, quality int")
    for out in (quality.kept(df, lab), mixing.repeated(df, mixing.mix(df)), substring.without_repeats(df), decontam.without_items(df, spark.createDataFrame([(1, rows[0][1])], "item_id long, text string"))):
        assert out.columns == df.columns
        for r in out.collect():
            assert tuple(r)[2:] == ("en", "s", 1, 2, 3, "x", 5, 6, 7, 8)


def test_rows_without_an_id_are_cut_by_their_own_text(spark):
    line = "one line that stands often"
    rows = [(None, f"{line}\nown text {i}") for i in range(40)] + [(7, f"{line}\nother"), (7, f"more\n{line}"), (None, None), (None, "")]
    kept = substring.without_repeats(docs(spark, rows)).collect()
    assert len(kept) == len(rows)
    texts = [r["text"] for r in kept]
    assert sum(line in (t or "") for t in texts) == 1
    assert all(sum(f"own text {i}" == (t or "")[-len(f"own text {i}"):] for t in texts) >= 1 for i in range(40))
    assert texts.count(None) == 1 and sorted(t for t in texts if t and "o" in t and line not in t)[:1] == ["\nother"]


def test_every_later_line_goes_and_nothing_else(spark):
    rng = random.Random(3)
    lines = [words(rng, rng.randint(1, 12), 5000) for _ in range(60)]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for d in range(80)] + [(100, words(rng, 40000, 100000))]
    seen, want = set(), {}
    for d, t in rows:
        left, cut = [], False
        for piece in t.split("\n"):
            low = tuple(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", piece.lower()))
            cut = bool(low) and low in seen
            left += [] if cut else [piece]
            seen.add(low)
        want[d] = [p for p in left if p]
    got = {r["doc_id"]: [p for p in r["text"].split("\n") if p] for r in substring.without_repeats(docs(spark, rows)).collect()}
    assert got == want
    again = substring.without_repeats(docs(spark, rows), spans=substring.passages(docs(spark, rows)))
    assert {r["doc_id"]: [p for p in r["text"].split("\n") if p] for r in again.collect()} == want
    assert substring.without_repeats(docs(spark, [])).count() == 0


# ---- quality --------------------------------------------------------------------


def test_texts_without_words_go_and_long_ones_are_whole(spark):
    long_ = words(random.Random(2), 300_000, 50)  # beyond what is handled at once
    rows = [(1, "  "), (2, "\t\n"), (3, "a"), (4, long_), (5, None)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs(spark, rows), none).collect()}
    assert {d for d, r in got.items() if r["keep"]} == {3, 4}
    assert got[4]["n_chars"] == len(long_)


def test_limits_are_quantiles_by_language_and_band(spark):
    """``keep`` against limits from all perplexities, found by sorting."""
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([8, 40]), 60), "abc"[i % 3]) for i in range(360)] + [(900, "zq xj " * 30, "a"), (901, "w1 " * 40, None), (902, words(rng, 40, 60), "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.score_quality(df, lab, least=45, low=0.1, high=0.9).collect()}
    n = {d: len(t) + 1 for d, t, _ in rows}
    band = {d: int(np.floor(np.log2(n[d]))) for d in n}
    lang = {d: x for d, _, x in rows}

    def limits(ids):
        p = sorted(got[d]["perplexity"] for d in ids)
        return p[max(0, int(np.ceil(0.1 * len(p))) - 1)], p[max(0, int(np.ceil(0.9 * len(p))) - 1)]

    levels = set()
    for d in got:
        groups = [[i for i in range(300) if lang[i] == lang[d] and band[i] == band[d]], [i for i in range(300) if lang[i] == lang[d]], list(range(300))]
        level = next(k for k, g in enumerate(groups) if k == 2 or len(g) >= 45)
        levels.add(level)
        low, high = limits(groups[level])
        wide = np.exp(2 / np.sqrt(n[d]))
        assert np.isclose(got[d]["low"], low / wide) and np.isclose(got[d]["high"], high * wide)
        assert got[d]["keep"] == (low / wide <= got[d]["perplexity"] <= high * wide)
    assert levels == {0, 2} or levels == {0, 1, 2}


# ---- mixing ---------------------------------------------------------------------


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"text {i} " + "w " * (i % 7)) for i in range(400)]
    mixed = mixing.mix(docs(spark, rows)).collect()
    assert sum(r["taken"] for r in mixed) == sum(r["size"] for r in mixed)
    out = mixing.mix(docs(spark, rows + [(5, "a b c")]), weights=spark.createDataFrame([("s", 1)], "source string, weight int"))
    assert out.count() == 401


# ---- edits ----------------------------------------------------------------------

ODD = st.text(st.sampled_from("ab' \n\r\t.1é!"), max_size=80)


@settings(max_examples=300, deadline=None)
@given(ODD, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 12), st.text(st.sampled_from("a 's\n1é"), max_size=6)), max_size=6), st.integers(1, 4), st.sampled_from([PATTERN, r"[^\S\r\n]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"]))
def test_many_edits_at_once(text, edits, leaf, pattern):
    """Two patterns, one of which looks to the end of white space."""
    c = tokencount.Counter.at(VOCABULARY, pattern)
    before, tokencount.LEAF = tokencount.LEAF, leaf
    try:
        todo, done = [], 0
        for start, n, new in sorted(edits):
            start = max(done, min(start, len(text)))
            end = min(len(text), start + n)
            todo.append((start, end, new))
            done = end
        tree = tokencount.build(c, text)
        after, _ = tokencount.apply_edits(c, tree, text, todo)
        plain, at = "", 0
        for start, end, new in todo:
            plain, at = plain + text[at:start] + new, end
        assert after == plain + text[at:]
        whole = tokencount.build(c, after)
        assert tree.total == whole.total == c.whole(after)
        assert int(tree.chars[0].sum()) == len(after)
        for levels in (tree.chars, tree.tokens):
            assert all(int(level.sum()) == int(levels[0].sum()) for level in levels)
    finally:
        tokencount.LEAF = before


def test_a_second_run_edits_stored_trees(spark, tmp_path):
    """Trees are written once; a later run reads them, encodes what its edits touch and writes the new ones."""
    rng = random.Random(6)
    rows = [(i, words(rng, 3000) + f" a{i}@example.com " + words(rng, 3000) + " 10.0.0.1") for i in range(6)] + [(90, None), (91, ""), (None, "x 1.2.3.4"), (5, words(rng, 9))]
    tokencount.build_trees(docs(spark, rows), VOCABULARY, PATTERN).write.parquet(f"{tmp_path}/one")
    first = tokencount.edit_trees(spark.read.parquet(f"{tmp_path}/one"), VOCABULARY, PATTERN)
    first.write.parquet(f"{tmp_path}/two")
    second = tokencount.edit_trees(spark.read.parquet(f"{tmp_path}/two"), VOCABULARY, PATTERN, edits=lambda t: [(0, 1, "Q")] if len(t) > 50 else []).collect()
    c = tokencount.Counter.at(VOCABULARY, PATTERN)
    state = {r["text"]: r for r in spark.read.parquet(f"{tmp_path}/two").collect()}
    for d, t in rows:
        after = tokencount._MASK.sub(lambda m: tokencount.MASKS[m.lastindex - 1][1], t or "")
        r = state[after if t else t]
        assert r["n_tokens_after"] == c.whole(after) == sum(r["tokens"]) and sum(r["chars"]) == len(after)
        assert r["n_encoded"] <= 500
    for r in second:
        assert r["n_tokens_after"] == c.whole(r["text"] or "") and r["n_encoded"] < 200


def test_many_edits_in_a_long_text_take_no_square(spark):
    c = tokencount.Counter.at(VOCABULARY, PATTERN)
    text = "plain words and then a@b.de " * 40_000
    tree, todo = tokencount.build(c, text), tokencount.masks(text)
    import time

    start = time.time()
    after, n = tokencount.apply_edits(c, tree, text, todo)
    assert len(todo) == 40_000 and tree.total == c.whole(after)
    assert time.time() - start < 60


# ---- token files ----------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    e = tokenbin.Encoder(public_tokenizers.path(name))
    assert e.apart == name.startswith("word")
    texts = ["", None, "Hello  World's end\n x.", "A" * 3000, " lead and trail  ", "über Straße"]
    for t, ids in zip(texts, e.ids(texts)):
        assert ids.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_stale_attempts_are_deleted(spark, tmp_path):
    out = f"file:{tmp_path}/shards"  # as Spark writes local paths
    os.makedirs(f"{tmp_path}/shards")
    Path(f"{tmp_path}/shards/_attempt-of-a-lost-executor").write_bytes(b"half")
    made = tokenbin.write_shards(docs(spark, [(1, "a b"), (2, None)]), out, public_tokenizers.path("word_bpe_49k.json"), 2)
    got = tokenbin.read_shards(made, out).collect()
    assert [r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])] == [3, 1]
    assert not [p for p in os.listdir(f"{tmp_path}/shards") if p.startswith("_attempt")]


def test_token_files_without_a_configured_folder(tmp_path):
    """A session of its own without spark.checkpoint.dir, as a user on one machine has it."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
from filigree.session import ship
ship(spark)
from filigree.llm import tokenbin
import public_tokenizers
df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
rows = tokenbin.token_table(df, public_tokenizers.path("word_bpe_49k.json"), 2).collect()
print("counts", sorted(r["n_tokens"] for r in rows))
"""
    conf = tmp_path / "conf"
    conf.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_CONF")} | {"SPARK_CONF_DIR": str(conf)}
    done = subprocess.run([sys.executable, "-c", code, str(ROOT)], env=env, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "counts [1, 3]" in done.stdout, done.stderr[-2000:]


# ---- pipeline -------------------------------------------------------------------


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names: no stage fails, clean rows stay."""
    import corpus_pipeline as P

    rng = random.Random(9)
    rows = [(i, words(rng, 80, 3000), "en", "s%d" % (i % 2), 1) for i in range(30)]
    rows += [(None, words(rng, 60, 3000), None, None, None), (40, None, "en", "s0", 0), (41, "", "en", "s1", 0), (42, words(rng, 60000, 3000), "en", None, 1)]
    rows += [rows[3], rows[3], (50, rows[4][1], "de", "s1", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[7][1].split()[10:40])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("_id", F.lit(1)).withColumn("key", F.lit("k")).withColumn("root", F.lit(2))
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = P.written(stage(spark, df, str(tmp_path)), f"odd{k}")
        assert k == 4 or out.columns == df.columns
        df = out
        seen.append({r["doc_id"] for r in out.collect()})
    assert not {40, 41} & seen[0]
    assert 50 not in seen[1] and {3, 4, 42, None} & seen[1] == {3, 4, 42, None} & seen[0]
    assert 7 in seen[1] and seen[2] == seen[1] - {7}
    assert P.run(spark, str(tmp_path)).count() > 0
