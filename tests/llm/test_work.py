"""Work that operators must not do: plans that turn with the size, patterns that cannot match, texts encoded one by one, bounds that spare nothing."""

from __future__ import annotations

import itertools
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given
from hypothesis import strategies as st

from filigree.llm import quality, tokenbin, tokencount, toxicity


def test_texts_are_flagged_by_the_same_plan_whatever_the_number_of_trusted_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, frame string")
    for ids in ([], [2], [2, 3]):
        found = quality.flagged(rows, spark.createDataFrame([(i,) for i in ids], "doc_id long"))
        assert sorted((r.frame, r.trusted) for r in found.collect()) == [(f, f in "bc" and 2 in ids) for f in "abcd"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


PIECES = ["a.b+c@d-e.fr", "@", "1.2.3.4", "1234.5", ".7", "0123456789abcdef" * 2, "0123456789abcdef" * 5, "4" * 12, "4" * 20, "+33 (123) 456-7890", "(123) 456-78", ") 123-", " ", "x", "-", "٣.٤.٥.٦"]


@given(st.lists(st.sampled_from(PIECES), max_size=8))
def test_masks_without_patterns_that_cannot_match_are_those_of_all_patterns(pieces):
    text = "".join(pieces)
    assert tokencount.masks(text) == [(m.start(), m.end(), tokencount.MASKS[m.lastindex - 1][1]) for m in tokencount._MASK.finditer(text)]


def test_masks_spare_patterns_that_cannot_match():
    text = "Some words, and a number like 1234; nothing to mask here. " * 2000

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: tokencount.masks(text)) < 0.5 * least(lambda: list(tokencount._MASK.finditer(text)))


class Counted:
    """A tokenizer that counts the texts it is given in batches."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def test_letters_with_marks_behind_them_are_encoded_together():
    encoder = tokenbin.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.tokenizer = Counted(encoder.tokenizer)
    letters = ["word", "naïve", "Éß", "straße", "x" * 30, "ÀÖØÞ", "l'eau", "don't", "e\u0301t", "Ж", "12"]
    marks = ["", "!!", "$$$", ".***", "-", "_", "`^", "''", "'s", "<|", "(=)", "…"]
    chunks = [a + m for a in letters for m in marks]
    got = [ids.tolist() for ids in encoder.ids(chunks + [" ".join(chunks)])]
    assert got == [encoder.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks + [" ".join(chunks)]]
    encoder.tokenizer.texts = 0
    list(encoder.ids([" ".join(f"wörd{a}{b}$$$ Çe{a}{b}!!" for a in "abcdefghij" for b in "abcdefghij")]))
    assert encoder.tokenizer.texts == 1


@pytest.mark.parametrize("memo", [300_000, 150, 0])
def test_ascii_words_go_to_the_model_alone_whatever_is_remembered(monkeypatch, memo):
    monkeypatch.setattr(tokenbin, "MEMO", memo)
    encoder = tokenbin.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    whole, encoder.tokenizer = encoder.tokenizer, Counted(encoder.tokenizer)
    made = ["".join(p) for p in itertools.product("abcd", "xyz", "eio", ["", "n", "_", "!?", "$[", "~."])]
    texts = [" ".join(made[i : i + 60]) for i in range(0, len(made), 40)] + ["Zq" * 40 + " zqzq", None, " ".join(made), "it is x!- 's y"]
    for n, text in enumerate(texts):  # one after another: words of the text before are remembered, or forgotten
        (ids,) = encoder.ids([text])
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids
        assert encoder.tokenizer.texts == 0 or n > 6  # no chunk is empty or begins with an apostrophe before the eighth text
    assert pa.compute.max(pa.compute.binary_length(encoder.known)).as_py() <= tokenbin.LONGEST
    got = [ids.tolist() for ids in encoder.ids(texts * 2)]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts * 2]


def test_a_query_of_few_postings_is_added_up_at_once_and_has_the_neighbours_that_bounds_give(monkeypatch):
    rng, calls = np.random.default_rng(3), []
    vectors = [(t := np.unique(rng.zipf(1.3, 40).clip(1, 400) - 1), rng.integers(1, 4, len(t)).astype(float)) for _ in range(500)]
    index = toxicity.Index(np.arange(500), rng.integers(0, 2, 500), vectors, rng.random(400) ** 3 + 0.01)
    add = toxicity.Index._add
    monkeypatch.setattr(toxicity.Index, "_add", lambda self, *a: calls.append(1) or add(self, *a))
    queries = [index.weights(*v) for v in vectors[:50]]
    whole = [index.nearest(*v, 25) for v in queries]
    assert len(calls) == 50
    monkeypatch.setattr(toxicity, "WHOLE", 0)
    for (at, cos), v in zip(whole, queries):
        bounded = index.nearest(*v, 25)
        assert bounded[0].tolist() == at.tolist() and np.allclose(bounded[1], cos)
    assert len(calls) > 100


@given(st.lists(st.sets(st.text("abcé", max_size=3)), max_size=4), st.sets(st.text("abcé", max_size=2)), st.integers(1, 5))
def test_words_have_their_dimensions_however_few_are_remembered(parts, known, memo):
    vocabulary = np.array(sorted(map(toxicity.term_hash, known)), np.int64)
    before, toxicity.MEMO = toxicity.MEMO, memo
    try:
        places = toxicity._Places(vocabulary)
        for words in parts:
            places.learn(words)
            for w in words:
                assert places[w] == (vocabulary.tolist().index(toxicity.term_hash(w)) if w in known else -1)
    finally:
        toxicity.MEMO = before
