"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a sample of the labelled rows of stated size.  Every term of theirs is
a dimension; document frequencies are counted over all documents, and a term's
weight grows with its evidence for the label among the examples (a likelihood
ratio), down to a small floor for terms without any, so that words which say
nothing decide only where nothing else does.  The index keeps a term's postings
by block of examples with the largest weight in each block: a query with many postings
adds up its strongest terms first, and blocks whose best sum plus what the other terms can
add stays below the k-th best are left out, which changes no neighbour.  Votes
weigh by distance, and a logistic curve fitted on the examples' own
leave-one-out votes calibrates them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, trimmed, written

#: Fixed value: a term is a run of letters.
_TERMS = re.compile(r"[^\W\d_]+").findall
#: Labelled rows that examples are taken from at most, examples in a block, votes, words that a task remembers.
EXAMPLES, BLOCK, NEIGHBOURS, MEMO = 6_000, 64, 25, 200_000
#: Postings up to which a query adds all of its terms at once: bounds by block would cost more than they spare.
WHOLE = 1 << 18
#: A term's weight is (g / (g + HALF)) ** 2 + FLOOR for a likelihood ratio of g towards the label.
HALF, FLOOR = 50.0, 1e-3


def terms_of(text: str | None) -> list[str]:
    return _TERMS((text or "").lower())


def term_hash(term: str) -> int:
    """A term's 64-bit hash as a signed integer."""
    return (xxhash.xxh3_64_intdigest(term) ^ 1 << 63) - (1 << 63)


def relevance(n: np.ndarray, k: np.ndarray, rows: int, bad: int) -> np.ndarray:
    """Weights of terms that occur in ``n`` of ``rows`` examples and ``k`` of the ``bad`` ones."""
    if not 0 < bad < rows:
        return np.ones(len(n))
    expected = lambda o, e: np.where(o > 0, o * np.log(np.where(o > 0, o, 1) / e), 0.0)
    share = bad / rows
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (expected(k, n * share) + expected(n - k, n * (1 - share)) + expected(bad - k, (rows - n) * share) + expected(rows - bad - n + k, (rows - n) * (1 - share)))
    g = np.where(k > n * share, np.maximum(g, 0), 0.0)
    return (g / (g + HALF)) ** 2 + FLOOR


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Examples as unit vectors in an inverted index whose postings are cut by block, with each block's largest weight."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.idf = idf
        made = [self.weights(t, n) for t, n in vectors]
        some = np.array([len(t) > 0 for t, _ in made], bool)
        # Without any example nothing speaks for the label.
        self.prior = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.25
        none = labels[~some]
        self.without = (none.sum() + self.prior) / (len(none) + 1)
        order = sorted(np.nonzero(some)[0], key=lambda i: (int(made[i][0][np.argmax(made[i][1])]), ids[i]))
        self.ids, self.labels = ids[order], labels[order].astype(float)
        self.vectors = [made[i] for i in order]
        sizes = np.array([len(t) for t, _ in self.vectors], np.int64)
        flat = lambda j, kind: np.concatenate([v[j] for v in self.vectors] or [np.empty(0)]).astype(kind)
        terms, w, at = flat(0, np.int64), flat(1, float), np.repeat(np.arange(len(sizes)), sizes)
        by = np.argsort(terms, kind="stable")
        terms, self.w, self.at = terms[by], w[by], at[by].astype(np.int32)  # small: every worker holds it
        block = self.at // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        self.start = np.append(np.nonzero(new)[0], len(terms)).astype(np.int32 if len(terms) < 1 << 31 else np.int64)
        self.block = block[self.start[:-1]].astype(np.int32)
        starts = self.start[:-1]
        self.most = np.maximum.reduceat(self.w, starts) if len(terms) else np.empty(0)
        self.first = np.searchsorted(terms[starts], np.arange(len(idf) + 1)).astype(self.start.dtype)
        self.top = np.zeros(len(idf))
        np.maximum.at(self.top, terms[starts], self.most)
        self.slope, self.bias = 1.0, 0.0
        self.slope, self.bias = self._curve()

    def __getstate__(self) -> dict:
        """Without the vectors, which only the fit of the curve needs."""
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / np.linalg.norm(w) if len(w) else w

    def _add(self, w: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums per example over ranges of postings, each with its weight."""
        rows = _ranges(starts, lengths)
        return np.bincount(self.at[rows], np.repeat(w, lengths) * self.w[rows], len(self.ids))

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int, copies: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` nearest examples that share a term; ties by position.

        Without ``copies``, examples whose vector is the query's own are left out.
        """
        impact = w * self.top[terms]
        some = impact > 0
        if not some.any():
            return np.empty(0, np.int64), np.empty(0)
        terms, w, impact = terms[some], w[some], impact[some]
        begin = self.start[self.first[terms]].astype(np.int64)
        length = self.start[self.first[terms + 1]] - begin
        strong = len(terms)
        if length.sum() > WHOLE:
            order = np.argsort(-impact, kind="stable")
            terms, w, begin, length, left = terms[order], w[order], begin[order], length[order], np.cumsum(impact[order][::-1])[::-1]
            strong = int(np.searchsorted(-left, -left[0] / 4)) or 1  # terms before which more than a quarter may still come
        cos = self._add(w[:strong], begin[:strong], length[:strong])
        if strong < len(terms):
            kth = np.partition(cos, -k)[-k] if len(cos) >= k and copies else 0.0
            alive = None
            if kth > 0:
                blocks = -(-len(cos) // BLOCK)
                n = (self.first[terms[strong:] + 1] - self.first[terms[strong:]]).astype(np.int64)
                rest, own = _ranges(self.first[terms[strong:]], n), np.repeat(w[strong:], n)
                more = np.bincount(self.block[rest], own * self.most[rest], blocks)
                best = np.pad(cos, (0, blocks * BLOCK - len(cos))).reshape(blocks, BLOCK).max(1)
                alive = best + more >= kth - 1e-9
            if alive is not None and 2 * alive.sum() < len(alive):
                fine = alive[self.block[rest]]
                begin = self.start[rest[fine]].astype(np.int64)
                cos = cos + self._add(own[fine], begin, self.start[rest[fine] + 1] - begin)
                cos[~np.repeat(alive, BLOCK)[: len(cos)]] = 0
            else:
                cos = cos + self._add(w[strong:], begin[strong:], length[strong:])
        if not copies:
            cos[cos >= 1 - 1e-9] = 0
        fine = np.nonzero(cos > 0)[0]
        if len(fine) > k:
            least = np.partition(cos[fine], -k)[-k]
            fine = fine[cos[fine] >= least - 1e-12]
        best = np.lexsort((fine, -np.round(cos[fine], 12)))[:k]
        return fine[best], cos[fine[best]]

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        """Logit of the neighbours' votes, each by the inverse of its distance, with one vote for the prior."""
        w = 1 / (0.1 + np.sqrt(np.maximum(0, 2 - 2 * cos)))
        p = ((w * self.labels[at]).sum() + self.prior) / (w.sum() + 1)
        return float(np.log(p / (1 - p)))

    def _curve(self) -> tuple[float, float]:
        """A logistic curve from leave-one-out votes to labels, by Newton's steps with a weak pull to the identity; no example is judged by its own copies."""
        at = np.arange(0, len(self.ids), max(1, len(self.ids) // 2000))
        if len(at) < 20:
            return 1.0, 0.0
        x = np.array([self.vote(*self.nearest(*self.vectors[i], NEIGHBOURS, copies=False)) for i in at])
        y, a, b = self.labels[at], 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum() + b])
            h = p * (1 - p) + 1e-9
            step = np.linalg.solve(np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1]]), g)
            a, b = a - step[0], b - step[1]
        return max(a, 0.05), b

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[int]]:
        """Score and the ids of the three nearest examples; without a term in common the share of toxic examples without terms."""
        at, cos = self.nearest(*self.weights(terms, counts), NEIGHBOURS) if len(terms) else ((), ())
        if not len(at):
            return float(self.without), []
        return float(1 / (1 + np.exp(-(self.slope * self.vote(at, cos) + self.bias)))), [int(i) for i in self.ids[at[:3]]]


class _Places(dict):
    """The dimension of each word, or -1; remembered for as many words as MEMO, or those of one call."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary

    def learn(self, words: set[str]) -> None:
        """Looks up all words that are not known yet, in one search."""
        if len(self) + len(words) > MEMO:
            self.clear()
        new = list(words - self.keys())
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64).view(np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        found = np.append(self.vocabulary, 0)[at] == hashes
        self.update(zip(new, np.where(found & (at < len(self.vocabulary)), at, -1).tolist()))


def _counted(docs: DataFrame, vocabulary=None) -> DataFrame:
    """``(doc_id, terms, counts)``: hashes of each text's terms, ascending, with counts.

    With a broadcast vocabulary instead the terms' dimensions in it, each as the step from the one before: small
    numbers, which a written table packs well.  ``_dimensions`` adds them up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else _Places(vocabulary.value)
        for b in trimmed(batches):
            for i in range(0, len(b), 512):
                part, terms, counts = b.slice(i, 512), [], []
                for k in range(0, len(part), 64):
                    some = [Counter(terms_of(t.as_py())) for t in part.column(1).slice(k, 64)]
                    if known is not None:
                        known.learn(set().union(*some))
                    for held in some:
                        at = np.fromiter(map(term_hash if known is None else known.__getitem__, held), np.int64, len(held))
                        n = np.fromiter(held.values(), np.int32, len(held))
                        if known is not None:
                            n, at = n[at >= 0], at[at >= 0]
                        order = np.argsort(at)
                        terms.append(at[order] if known is None else np.diff(at[order], prepend=0))
                        counts.append(n[order])
                offsets = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
                lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x)))
                kind = np.int64 if known is None else np.int32
                yield pa.RecordBatch.from_arrays([part.column(0), lists([t.astype(kind) for t in terms]), lists(counts)], ["doc_id", "terms", "counts"])

    return docs.mapInArrow(run, f"doc_id long, terms array<{'long' if vocabulary is None else 'int'}>, counts array<int>")


def _dimensions(steps: pa.ListArray) -> np.ndarray:
    """The dimensions of all rows of ``_counted``'s steps, one row after another."""
    ends = np.cumsum(steps.flatten().to_numpy().astype(np.int64))
    at = steps.offsets.to_numpy() - steps.offsets[0].as_py()
    before = np.append(0, ends)[at[:-1]]
    return ends - np.repeat(before, np.diff(at))


def _frequencies(slim: DataFrame, size: int) -> np.ndarray:
    """In how many rows of ``slim (terms)`` each dimension occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in trimmed(batches):
            n += np.bincount(_dimensions(b.column(0)), minlength=size)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["t", "n"])

    out = np.zeros(size, np.int64)
    if size:
        found = slim.select("terms").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the examples have terms
        out[found["t"].to_numpy()] = found["n"].to_numpy()
    return out


def held_out(doc_id) -> F.Column:
    """Whether a row's label is kept from the learning: crc32 of the id as text, modulo 5, is 0; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` for every row of ``docs``.

    Labels are learnt from rows of ``labels (doc_id, toxic)`` that are not held
    out and whose id has a text: of those, ``examples`` at most, picked by a
    hash of the id.  An id that is labelled twice is toxic if one label says so;
    null ids and null labels teach nothing; of several texts of an id the
    smallest is taken.  Only texts are scored, whole: null and empty ones, and texts
    that share no term with an example, get the rate of toxic examples without
    terms, drawn to the prior.  ``evidence``: ids of the nearest examples, ties to
    the one placed first.  Without any example every score is 0.25; repeated rows
    stay and score alike; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = cut(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    taught = written(_counted(texts), "examples").join(F.broadcast(sample), "doc_id")
    rows = taught.select("doc_id", "toxic", "terms", "counts").toArrow().sort_by("doc_id")  # EXAMPLES at most
    ids, toxic = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(np.int64)
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
    sizes = np.array([len(t) for t in rows["terms"]], np.int64)
    vocabulary, place = np.unique(flat("terms") if len(ids) else np.empty(0, np.int64), return_inverse=True)
    counts = flat("counts").astype(float) if len(ids) else np.empty(0)
    of = np.repeat(np.arange(len(ids)), sizes)
    n = np.bincount(place, minlength=len(vocabulary)).astype(float)
    k = np.bincount(place, toxic[of].astype(float), len(vocabulary))

    # All documents: dimensions and counts of their terms, read from the texts once.
    slim = written(_counted(docs, spark.sparkContext.broadcast(vocabulary)), "terms", "zstd")
    idf = np.log((1 + slim.count()) / (1 + _frequencies(slim, len(vocabulary)))) + 1
    ends = np.cumsum(sizes)
    vectors = [(place[e - s : e], counts[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
    shared = spark.sparkContext.broadcast(Index(ids, toxic, vectors, idf * relevance(n, k, len(ids), int(toxic.sum()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = shared.value, {}
        for b in trimmed(batches):
            scores, near = [], []
            for terms, counts in zip(b.column(1), b.column(2)):
                t, c = np.cumsum(terms.values.to_numpy().astype(np.int64)), counts.values.to_numpy()
                key = xxhash.xxh3_128_digest(t.tobytes() + c.tobytes())
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = index.score(t, c.astype(float))
                scores.append(memo[key][0])
                near.append(memo[key][1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    scored = slim.mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
