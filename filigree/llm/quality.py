"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of characters, ORDER of them at a time: its types are far fewer than
those of words, which keeps the tables that documents are joined with small
against the text.  A gram is one 64-bit integer, 16 bits a character, so keys
are exact for those; all characters beyond 16 bits count as one and the same.  A
context is a shift.

1. One pass counts the grams of all documents, and apart those of trusted text.
2. Counts and continuation counts of the trusted grams, and every gram's
   probability with its back-off, come from joins that are sharded by gram and by
   context.  Every gram of the corpus gets its probability, seen in trusted text or not.
3. The HOT most frequent grams, a bounded table, go to all tasks; what else a
   document holds is joined with its shard.  Nothing is dropped: both parts add
   up to the document's log-probability.
4. Per language and length band, quantiles of the trusted documents' perplexity are
   the limits; a document outside them goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, small, trimmed, written

ORDER = 4
#: Grams in the table that all tasks hold; grams counted in a task before it passes them on; characters and rows handled at once.
HOT, COUNTED, AT_ONCE, ROWS = 1 << 18, 1 << 19, 1 << 19, 512
#: Characters that stand for the start and the end of a text and for what lies beyond 16 bits.
START, END, BEYOND = 2, 3, 0xFFFF


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all grams of all texts, one after another, and how many each text has (its characters and the end)."""
    pad = "".join(chr(START) for _ in range(ORDER - 1))
    parts = [pad + (t or "").replace(chr(START), " ").replace(chr(END), " ") + chr(END) for t in texts]
    lengths = np.array([len(p) for p in parts], np.int64)
    code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code > BEYOND, BEYOND, code).astype(np.uint64)
    keys = code[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        keys |= code[ORDER - 1 - k : len(code) - k] << np.uint64(16 * k)
    # Windows that reach over a text's end.
    own = np.ones(len(keys), bool)
    own[(np.cumsum(lengths)[:-1, None] - 1 - np.arange(ORDER - 1)).ravel()] = False
    return keys[own].view(np.int64), lengths - (ORDER - 1)


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, frame)``: texts as zstandard frames, so that dealing them by id moves a third of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in trimmed(batches):
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                frames = [pack.compress((t.as_py() or "").encode("utf-8", "replace")) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(frames, pa.binary())], ["doc_id", "frame"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, frame binary")


def flagged(rows: DataFrame, good: DataFrame) -> DataFrame:
    """``rows`` with ``trusted``: whether ``good (doc_id)`` has their id. Rows without an id stay where they are.

    Always a sort-merge join: a plan that changes with the number of trusted ids would move nothing of a small table and all texts of a larger one.
    """
    mark = good.withColumn("trusted", F.lit(True)).hint("merge")
    known = rows.where("doc_id is not null").join(mark, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return known.unionByName(rows.where("doc_id is null").withColumn("trusted", F.lit(False)))


def count_grams(rows: DataFrame) -> DataFrame:
    """``(gram, n, trusted)`` of ``rows (frame, trusted)``: occurrences in all and in trusted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            add = lambda j: np.bincount(at, np.concatenate([h[j] for h in held]), len(keys)).astype(np.int64)
            return keys, add(1), add(2)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["gram", "n", "trusted"])

        for b in trimmed(batches):
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for flag in (False, True):
                    frames = part.column(0).filter(pa.array(good == flag)).to_pylist()
                    texts = [unpack.decompress(f).decode() for f in frames]
                    for i, j in pieces(texts):
                        own, n = np.unique(grams(texts[i:j])[0], return_counts=True)
                        held.append((own, n, n * flag))
                if len(held) >= 16:
                    held = [merged()]
                    if len(held[0][0]) > COUNTED:
                        yield out()
                        held = []
        if held:
            held = [merged()]
            yield out()

    per = rows.select("frame", "trusted").mapInArrow(run, "gram long, n long, trusted long")
    return per.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted"))


def discounts(table: DataFrame, count: str) -> list[float]:
    """The three discounts of modified Kneser-Ney from the counts of counts 1 to 4; 0.5, 1 and 1.5 where those are too few."""
    n = dict(table.where(F.col(count).between(1, 4)).groupBy(count).count().collect())
    n = [n.get(k, 0) for k in range(1, 5)]
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.01) for k in (1, 2, 3)]


def _mask(length: int) -> int:
    """Of a gram the last ``length`` characters."""
    return (1 << (16 * length)) - 1


def probabilities(counted: DataFrame) -> DataFrame:
    """``(gram, n, logp)``: of every gram of ``counted`` the natural logarithm of its last character's probability after the others.

    The highest order takes counts, the lower ones the numbers of distinct
    characters before; below single characters lies the uniform distribution
    over the trusted characters and one unknown.
    """
    levels: list[DataFrame] = [counted.where("trusted > 0").select("gram", F.col("trusted").alias("c"))]
    for length in range(ORDER - 1, 0, -1):
        before = levels[0]
        key = F.col("gram").bitwiseAND(F.lit(_mask(length)))
        levels.insert(0, cut(before.select(key.alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))))
    uniform = 1.0 / (levels[0].count() + 1)

    # p of the suffixes of length 1, 2, ... of every gram that occurs anywhere.
    wanted = counted.select("gram", "n")
    known = None
    for length, level in enumerate(levels, 1):
        d = discounts(level, "c")
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = level.withColumn("ctx", F.shiftrightunsigned("gram", 16)).withColumn("less", less)
        contexts = rows.groupBy("ctx").agg(F.sum("c").alias("total"), (F.sum("less") / F.sum("c")).alias("back"))
        own = rows.select("gram", (F.col("c") - F.col("less")).alias("kept"))
        mask = _mask(length) if length < ORDER else -1
        asked = wanted.select(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).distinct() if length < ORDER else wanted
        asked = asked.withColumn("ctx", F.shiftrightunsigned("gram", 16))
        if known is None:
            asked = asked.withColumn("below", F.lit(uniform))
        else:
            asked = asked.withColumn("short", F.col("gram").bitwiseAND(F.lit(_mask(length - 1))))
            asked = asked.join(known.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short").drop("short")
        joined = asked.join(contexts, "ctx", "left").join(own, "gram", "left")
        p = F.coalesce(F.col("kept") / F.col("total"), F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("below")
        known = joined.select(*(["gram"] if length < ORDER else ["gram", "n"]), p.alias("p"))
        known = cut(known) if length < ORDER else known
    return known.select("gram", "n", F.log("p").alias("logp"))


class Hot:
    """A bounded table of grams and log-probabilities with a direct-address front."""

    BITS = 21

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.logp = keys[order], logp[order]

    def front(self) -> np.ndarray:
        slots = np.full(1 << self.BITS, -1, np.int32)
        slots[self.slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        return slots

    @classmethod
    def slot(cls, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def find(self, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions of the keys in the table, -1 where it lacks them."""
        at = slots[self.slot(keys)]
        fine = (at >= 0) & (self.keys[at] == keys)
        out = np.where(fine, at, -1)
        rest = np.nonzero(~fine & (at >= 0))[0]  # an empty slot means that the table lacks the key
        if len(rest):
            p = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            out[rest] = np.where(self.keys[p] == keys[rest], p, -1)
        return out


def perplexities(docs: DataFrame, model: DataFrame, hot_size: int = HOT) -> DataFrame:
    """``docs (doc_id, lang, text, text_hash, some)`` as ``(row_id, doc_id, lang, text_hash, some, n, logp)``, texts given up.

    ``n``: characters and the end; ``logp``: the text's log-probability.
    """
    spark = docs.sparkSession
    top = model.orderBy(F.desc("n"), "gram").limit(hot_size).select("gram", "logp").toArrow()
    shared = spark.sparkContext.broadcast(Hot(top["gram"].to_numpy(), top["logp"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, done = shared.value, TaskContext.get().partitionId() << 36
        slots = hot.front()
        logp = np.append(hot.logp, 0.0)
        for whole in trimmed(batches):
            for first_row in range(0, len(whole), ROWS):
                b = whole.slice(first_row, ROWS)
                texts = b.column(2).to_pylist()
                for i, j in pieces(texts):
                    keys, lengths = grams(texts[i:j])
                    at = hot.find(slots, keys) if len(hot.keys) else np.full(len(keys), -1)
                    rows = np.repeat(np.arange(j - i, dtype=np.int32), lengths)
                    sums = np.bincount(rows, logp[at], j - i)
                    rare = np.nonzero(at < 0)[0]
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows[rare], minlength=j - i))]).astype(np.int32)
                    left = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[rare]))
                    part = b.slice(i, j - i)
                    ids = pa.array(done + np.arange(j - i))
                    done += j - i
                    yield pa.RecordBatch.from_arrays([ids, part.column(0), part.column(1), part.column(3), part.column(4), pa.array(lengths), pa.array(sums), left], ["row_id", "doc_id", "lang", "text_hash", "some", "n", "logp", "rare"])

    first = written(docs.select("doc_id", "lang", "text", "text_hash", "some").mapInArrow(run, "row_id long, doc_id long, lang string, text_hash long, some boolean, n long, logp double, rare array<long>"), "scores")
    rare = first.select("row_id", F.explode("rare").alias("gram")).groupBy("row_id", "gram").agg(F.count("*").alias("k"))
    added = rare.join(model.select("gram", F.col("logp").alias("lp")), "gram").groupBy("row_id").agg(F.sum(F.col("k") * F.col("lp")).alias("more"))
    out = first.drop("rare").join(added, "row_id", "left")
    return out.withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0))).drop("more")


def trusted_ids(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """``(doc_id)`` of the rows that labels call good; an id with differing labels is not trusted."""
    per = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).alias("q"))
    return per.where("q = 1").select("doc_id")


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = 0.02, high: float = 0.98, slack: float = 1.0, least: int = 200, hot_size: int = HOT
) -> DataFrame:
    """``(doc_id, text_hash, lang, n_chars, perplexity, low, high, keep)`` for every row of ``docs``.

    Trusted text: rows whose id ``labels (doc_id, quality)`` calls 1.  A
    document is kept if its perplexity per character lies between the ``low`` and the
    ``high`` quantile of the trusted documents of its language and length band
    (a band doubles the length), widened by the factor ``slack`` and, as a
    mean over ``n`` characters is the less certain the shorter the text, by
    ``exp(2 / sqrt(n))``; bands with fewer than ``least``
    trusted documents take those of the language, then of all trusted
    documents; without any trusted document every row is kept.  Null and empty
    texts are scored by their end alone and have no quality to keep: ``keep`` is false
    for texts without a word.  A null language is one of its own; null ids and
    repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("some"))
    good = cut(trusted_ids(labels))
    model = cut(probabilities(cut(count_grams(flagged(packed(docs), good)))))
    scored = perplexities(docs, model, hot_size).withColumn("ppl", F.exp(-F.col("logp") / F.col("n"))).withColumn("band", F.floor(F.log2("n")).cast("int"))
    scored = cut(flagged(scored, good))
    teach = scored.where("trusted")
    both = F.percentile_approx("ppl", F.array(F.lit(low), F.lit(high)), 100000).alias("q")
    name = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("_lang")
    by_band = teach.groupBy(name, "band").agg(both, F.count("*").alias("m")).where(F.col("m") >= least).select("_lang", "band", F.col("q").alias("q1"))
    by_lang = teach.groupBy(name).agg(both, F.count("*").alias("m")).where(F.col("m") >= least).select("_lang", F.col("q").alias("q2"))
    overall = teach.agg(both).first()["q"]
    limits = F.coalesce("q1", "q2", F.array(*map(F.lit, overall)) if overall else F.lit(None).cast("array<double>"))
    out = scored.withColumn("_lang", name).join(small(cut(by_band)), ["_lang", "band"], "left").join(small(cut(by_lang)), "_lang", "left").withColumn("q", limits)
    wide = slack * F.exp(2 / F.sqrt("n"))
    lower, upper = F.col("q")[0] / wide, F.col("q")[1] * wide
    keep = F.col("some") & F.coalesce(F.col("ppl").between(lower, upper), F.lit(True))
    return out.select("doc_id", "text_hash", "lang", (F.col("n") - 1).alias("n_chars"), F.col("ppl").alias("perplexity"), lower.alias("low"), upper.alias("high"), keep.alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``score_quality`` keeps; all columns unchanged, whatever their names.

    Rows with the same id and text go together; null ids, null and empty texts
    and empty tables as there.
    """
    good = score_quality(docs, labels, id_col, text_col, **options).where("keep").select("doc_id", "text_hash").distinct()
    on = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("k.text_hash"))
    return docs.alias("d").join(good.alias("k"), on, "left_semi")
