"""Passages that repeat: hashing of normalised units, the earliest occurrence kept.

A unit is a line, a paragraph, a sentence or a clause.  Units are normalised
(lower case, words only) and hashed, digests are grouped over all documents, and
every occurrence but the one that ranks first, by document id and place, is a
repeat.  Repeats are what is removed, given by their offsets in the original text;
consecutive ones form a run.  ``repeats`` takes lines unless told otherwise.

Passages are often spliced into the middle of a line, where hashed lines would
not find them.  ``passages`` misses nothing: besides every line it compares every
window of ``min_words`` words, wherever it begins.

Digests have 64 bits.  Among 10^9 different units one pair in 37 tables of that
size would be taken for equal by chance; where that matters, a corpus of more units is
to be compared by parts of its digests, or the cuts checked against the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup, trimmed, written
from .decontam import _Hashes, shingle_hashes, words_of

#: What a unit of each kind looks like.
UNITS = {
    "paragraph": r"(?:[^\n]|\n(?!\s*\n))+",
    "line": r"[^\n]+",
    "sentence": r"[^.!?\n]+[.!?]*",
    "clause": r"[^.!?,;:\n]+[.!?,;:]*",
}
#: Documents handled at once, share of the units that is looked at for hot digests.
AT_ONCE, PEEK = 512, 0.02
#: Words of the grams that pick the windows to compare.
GRAM = 16
#: Windows in one stretch, at most.
STRETCH = 32
#: What occurrences rank by.
RANK = ("doc_id", "_key", "_at")
#: ASCII characters that belong to words, as in decontam.WORD.
_IN_WORD = np.array([chr(c).isalnum() for c in range(128)])


def units_of(text: str | None, unit: str = "line") -> list[tuple[int, int, int, int]]:
    """``(start, end, words, digest)`` of every unit that holds a word."""
    out = []
    for m in re.finditer(UNITS[unit], text or ""):
        words = words_of(m[0])
        if words:
            out.append((m.start(), m.end(), len(words), xxhash.xxh3_64_intdigest(" ".join(words))))
    return out


def _units(docs: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for i in range(0, len(b), AT_ONCE):
                part = b.slice(i, AT_ONCE)
                texts = part.column(1).to_pylist()
                found = [units_of(t, unit) for t in texts]
                counts = np.array([len(f) for f in found])
                flat = np.array([u for f in found for u in f], np.uint64).reshape(-1, 4)
                rows = np.repeat(np.arange(len(part)), counts)
                pos = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                keys = np.array([xxhash.xxh3_64_intdigest(t or "") for t in texts], np.uint64).view(np.int64)
                span = (flat[:, 0] << np.uint64(32) | (flat[:, 1] - flat[:, 0])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(keys[rows]), pa.array(pos << 32 | flat[:, 2].astype(np.int64)), pa.array(span), pa.array(flat[:, 3].copy().view(np.int64))],
                    ["doc_id", "_key", "_at", "_span", "_digest"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, _key long, _at long, _span long, _digest long")


def _frequent(every: DataFrame, digest: str, total: int) -> list[int]:
    """Digests that a 1/2000 of the ``total`` units or more have; their number has that bound, so they are handled without a shuffle of their rows."""
    least = max(20, int(total * PEEK / 1500))
    return [r[0] for r in every.select(digest).sample(PEEK, 5).groupBy(digest).count().where(F.col("count") >= least).select(digest).collect()]


def _later(every: DataFrame, total: int) -> DataFrame:
    """The rows of ``every (doc_id, _key, _at, _digest, ...)`` but the first of each digest, with ``_first``, the first one's rank."""
    rank = F.struct(*RANK)
    hot = _frequent(every, "_digest", total)
    is_hot = F.col("_digest").isin(hot) if hot else F.lit(False)
    first = F.min(rank).over(Window.partitionBy("_digest")).alias("_first")
    again = every.where(~is_hot).select("*", first)
    if hot:
        table = every.where(is_hot).groupBy("_digest").agg(F.min(rank).alias("_first"))
        again = again.unionByName(every.where(is_hot).join(F.broadcast(table), "_digest"))
    return again.where(~rank.eqNullSafe(F.col("_first")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1) -> DataFrame:
    """``(doc_id, text_hash, start, end, n_words, n_units, first_doc_id)``: the passages to remove.

    ``start`` and ``end`` are character offsets in the original text;
    ``first_doc_id`` is a document that keeps an earlier occurrence of the
    passage's first unit.  Every later copy of a unit is given; ``min_words``
    leaves out runs of fewer words, if wanted.  Occurrences rank by id (null first), then text hash,
    then place.  A text is kept whole within a run: gaps between its units are
    removed with it.  Null or empty texts have no units; rows that repeat id and
    text count as one document; an empty table gives no rows; other columns are
    ignored.
    """
    every = written(_units(docs, id_col, text_col, unit), "units")
    again = _later(every, every.count())
    own = ["doc_id", "_key"]
    again = again.groupBy(*own, "_at").agg(F.min(F.struct("_span", "_first")).alias("m"))
    place = F.shiftrightunsigned("_at", 32)
    runs = again.withColumn("_run", place - F.row_number().over(Window.partitionBy(*own).orderBy("_at")))
    start = F.shiftrightunsigned("m._span", 32)
    low = F.lit(0xFFFFFFFF)
    found = runs.groupBy(*own, "_run").agg(
        F.min(start).alias("start"),
        F.max(start + F.col("m._span").bitwiseAND(low)).alias("end"),
        F.sum(F.col("_at").bitwiseAND(low)).alias("n_words"),
        F.count("*").alias("n_units"),
        F.min_by("m._first.doc_id", "_at").alias("first_doc_id"),
    )
    found = found.where(F.col("n_words") >= min_words)
    return found.select("doc_id", F.col("_key").alias("text_hash"), "start", "end", "n_words", "n_units", "first_doc_id")


def _key_of(texts: list[str | None]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh3_64_intdigest(t or "") for t in texts], np.uint64).view(np.int64))


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``words_of``, as offsets in the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[False], (code >= 128) | _IN_WORD[np.minimum(code, 127)], [False]]).astype(np.int8))
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def pickers(words: list[str], min_words: int, memo: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all GRAM-word grams, and for every window of ``min_words`` words the least of its grams' hashes.

    Equal windows have equal least hashes, so only windows whose hash occurs again need to be compared.
    """
    n = min(GRAM, min_words)
    grams = shingle_hashes(words, n, memo)
    least, size, wide = grams, 1, min_words - n + 1
    if len(grams) < wide:
        return grams, grams[:0]
    while 2 * size <= wide:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < wide:
        least = np.minimum(least[: size - wide], least[wide - size :])
    return grams, least


def _anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, _key, _gram, n)``: the grams that pick a window and how often each stands in the text; a null gram for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for b in trimmed(batches):
            for i in range(0, len(b), AT_ONCE):
                part = b.slice(i, AT_ONCE)
                texts, found = part.column(1).to_pylist(), []
                for t in texts:
                    grams, least = pickers(words_of(t), min_words, memo)
                    found.append(np.unique(grams[np.isin(grams, least)], return_counts=True))
                own = np.arange(len(part))
                rows = pa.array(np.concatenate([own, np.repeat(own, [len(f[0]) for f in found])]))
                grams = pa.concat_arrays([pa.nulls(len(part), pa.int64()), pa.array(np.concatenate([f[0] for f in found]).view(np.int64))])
                n = pa.array(np.concatenate([np.zeros(len(part), np.int64), *[f[1] for f in found]]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), _key_of(texts).take(rows), grams, n], ["doc_id", "_key", "_gram", "n"])

    return docs.mapInArrow(run, "doc_id long, _key long, _gram long, n int")


def _frames(docs: DataFrame) -> DataFrame:
    """``(doc_id, _key, frame)``: texts as zstandard frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in trimmed(batches):
            for i in range(0, len(b), AT_ONCE):
                part = b.slice(i, AT_ONCE)
                texts = part.column(1).to_pylist()
                frames = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), _key_of(texts), pa.array(frames, pa.binary())], ["doc_id", "_key", "frame"])

    return docs.mapInArrow(run, "doc_id long, _key long, frame binary")


def stretches(at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where stretches begin in ``at``, the first words of windows: windows one word apart that the same gram picks, STRETCH at most.

    Where they end depends on the words in and next to them alone, so copies of a passage have the same stretches but at its ends.
    """
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
    begin = np.nonzero(new)[0]
    new[(np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))) % STRETCH == 0] = True
    return np.nonzero(new)[0]


def _compared(rows: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, _key, _at, _span, _digest, _n, _stretch, _windows)`` of ``rows (doc_id, _key, frame, grams)``: stretches of windows that one of the grams picks, and lines.

    ``_n`` counts the windows of a stretch, ``_stretch`` is a digest of them all, ``_windows`` has the span and digest of each;
    ``_at`` and ``_digest`` are the first one's.  Lines have an ``_n`` of 0 and their places, spans and digests as in ``_units``, by their first word.
    One row more for each text with words, at -1, has the span of all its lines and, for a digest, its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, unpack = _Hashes(), zstandard.ZstdDecompressor()
        for b in trimmed(batches):
            for i in range(0, len(b), 64):
                part, out, counts, each = b.slice(i, 64), [], [], [np.empty((2, 0), np.int64)]
                for frame, grams in zip(part.column(2), part.column(3)):
                    text = unpack.decompress(frame.as_py()).decode("utf-8", "surrogatepass")
                    words, (starts, ends) = words_of(text), places(text)
                    again = np.asarray(grams.values.to_numpy()).view(np.uint64) if grams.is_valid else np.empty(0, np.uint64)
                    least = pickers(words, min_words, memo)[1] if len(again) else np.empty(0, np.uint64)
                    at = np.nonzero(np.isin(least, again))[0]
                    digests = shingle_hashes(words, min_words, memo)[at] if len(at) else np.empty(0, np.uint64)
                    last = at + min_words - 1
                    each.append(np.stack([starts[at] << 32 | (ends[last] - starts[at]), digests.view(np.int64)]))
                    head = stretches(at, least)
                    n = np.diff(head, append=len(at))
                    whole = np.array([xxhash.xxh3_64_intdigest(digests[j : j + k].tobytes()) for j, k in zip(head, n)], np.uint64)
                    a = at[head]
                    found = [np.stack([a << 32 | min_words, starts[a] << 32 | (ends[last[head + n - 1]] - starts[a]), digests[head].view(np.int64), n, whole.view(np.int64)])]
                    edges = np.array([m.span() for m in re.finditer(UNITS["line"], text)], np.int64).reshape(-1, 2)
                    first, stop = np.searchsorted(starts, edges[:, 0]), np.searchsorted(starts, edges[:, 1])
                    held = stop > first
                    edges, first, stop = edges[held], first[held], stop[held]
                    digests = np.array([xxhash.xxh3_64_intdigest(" ".join(words[j:k])) for j, k in zip(first, stop)], np.uint64)
                    none = np.zeros(len(first), np.int64)
                    found.append(np.stack([first << 32 | (stop - first), edges[:, 0] << 32 | (edges[:, 1] - edges[:, 0]), digests.view(np.int64), none, none]))
                    if len(words):
                        found.append(np.array([[-1], [edges[0, 0] << 32 | (edges[-1, 1] - edges[0, 0])], [len(words)], [0], [0]], np.int64))
                    out.append(np.concatenate(found, axis=1))
                    counts.append(out[-1].shape[1])
                rows_, flat = pa.array(np.repeat(np.arange(len(part)), counts)), np.concatenate(out, axis=1)
                windows = pa.StructArray.from_arrays(list(map(pa.array, np.concatenate(each, axis=1))), ["_span", "_digest"])
                windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(flat[3])]).astype(np.int32)), windows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_), part.column(1).take(rows_), *map(pa.array, flat), windows], names)

    names = ["doc_id", "_key", "_at", "_span", "_digest", "_n", "_stretch", "_windows"]
    return rows.mapInArrow(run, f"{', '.join(f'{name} long' for name in names[:-1])}, _windows array<struct<_span: long, _digest: long>>")


def _units_of(every: DataFrame) -> DataFrame:
    """``(doc_id, _key, _at, _span, _digest, _n)``: what is to be compared of the rows of ``_compared``, lines and windows one by one.

    A frequent stretch that another text holds before stays whole, as its first window with the span of all ``_n``: every window of
    it repeats, and none of them is a first occurrence, since the first of those stretches is taken apart.
    """
    held, apart, out = every.where("_n > 0"), F.lit(True), ["doc_id", "_key", "_at", "_span", "_digest", "_n"]
    if hot := _frequent(held, "_stretch", held.count()):
        table = cut(held.where(F.col("_stretch").isin(hot)).groupBy("_stretch").agg(F.min_by("_key", F.struct(*RANK)).alias("_of")))
        held = held.join(F.broadcast(table), "_stretch", "left")
        apart = F.coalesce(F.col("_of") == F.col("_key"), F.lit(True))
    windows = F.when(apart, F.col("_windows")).otherwise(F.array(F.struct("_span", "_digest")))
    held = held.select("doc_id", "_key", "_at", F.when(apart, 1).otherwise(F.col("_n")).alias("_n"), F.posexplode(windows).alias("_pos", "_w"))
    held = held.withColumn("_at", F.col("_at") + F.shiftleft(F.col("_pos").cast("long"), 32)).select("*", "_w.*")
    return every.where("_n = 0 and _at >= 0").withColumn("_n", F.lit(1).cast("long")).select(*out).unionByName(held.select(*out))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``(doc_id, text_hash, start, end, n_words, n_units, first_doc_id)``: all words in a window of ``min_words`` words, or in a line, that occurs earlier.

    Columns, ranks and odd rows as in ``repeats``; a unit is a window or a line,
    whatever the line's length, and units that overlap or adjoin form one
    passage.  A window that overlaps its own first occurrence is no repeat.  A copy
    of a whole text is one passage and one unit.

    Only windows that can repeat are compared: a window is picked by the least
    hash of its grams (winnowing), and those whose pick stands once only in all
    texts are left out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    each = written(_anchors(docs, min_words), "anchors")
    anchors, ids = each.where("_gram is not null").select("_key", "_gram", "n"), each.where("_gram is null").select("doc_id", "_key")
    often = anchors.groupBy("_gram").agg(F.count("*").alias("rows"), F.min("_key").alias("a"), F.max("_key").alias("b"), F.max("n").alias("n"))
    often = cut(often.where("a <> b or n > 1").select("_gram", "rows", F.lit(True).alias("again")))
    mine = lookup(anchors.drop("n"), often, "_gram", "rows").where("again").select(F.lit(None).cast("long").alias("doc_id"), "_key", F.lit(None).cast("binary").alias("frame"), "_gram")
    texts = _frames(docs).withColumn("_gram", F.lit(None).cast("long"))
    first = F.min(F.when(F.col("frame").isNotNull(), F.struct("doc_id"))).alias("own")
    rows = texts.unionByName(mine).groupBy("_key").agg(first, F.first("frame", ignorenulls=True).alias("frame"), F.collect_set("_gram").alias("grams"))
    every = written(_compared(rows.select("own.doc_id", "_key", "frame", "grams"), min_words), "windows")

    low = F.lit(0xFFFFFFFF)
    begin = F.shiftrightunsigned("_span", 32)
    finish = begin + F.col("_span").bitwiseAND(low)
    total = every.where("_at >= 0").agg(F.sum(F.greatest("_n", F.lit(1)))).first()[0]
    again = _later(_units_of(every), total or 0)
    word, size = F.shiftrightunsigned("_at", 32), F.col("_at").bitwiseAND(low) + F.col("_n") - 1
    within = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_key") == F.col("_first._key"))
    again = again.where(~within | (word >= F.shiftrightunsigned("_first._at", 32) + size))
    own = ["doc_id", "_key"]
    order = Window.partitionBy(*own).orderBy("_at")
    again = again.select(*own, "_at", "_span", "_n", F.col("_first.doc_id").alias("_of"))
    reach = F.max(word + size).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("_new", F.coalesce(word > reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*own, "_run").agg(
        F.min(begin).alias("start"),
        F.max(finish).alias("end"),
        (F.max(word + size) - F.min(word)).alias("n_words"),
        F.sum("_n").alias("n_units"),
        F.min_by("_of", "_at").alias("first_doc_id"),
    )
    # Copies of whole texts: all their lines repeat.
    held = ids.distinct()
    whole = every.where("_at < 0").select("_key", begin.alias("start"), finish.alias("end"), F.col("_digest").alias("n_words"), F.col("doc_id").alias("first_doc_id"))
    whole = cut(whole.join(held.groupBy("_key").agg(F.count("*").alias("rows")).where("rows > 1"), "_key"))
    copies = lookup(held, whole, "_key", "rows").where(F.col("n_words").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_doc_id")))
    copies = copies.withColumn("n_units", F.lit(1).cast("long"))
    out = ["doc_id", F.col("_key").alias("text_hash"), "start", "end", "n_words", "n_units", "first_doc_id"]
    return written(found.select(*out), "passages").unionByName(copies.select(*out))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1, spans: DataFrame | None = None) -> DataFrame:
    """``docs`` with the passages of ``repeats``, or the given ``spans`` of ``passages``, cut out of their texts.

    Every row and all other columns stay, whatever their names; a text that
    repeats as a whole becomes empty.  Spans are joined by id and text hash, so
    rows that share an id, or have none, are cut each by its own text; rows that
    share both are one document and keep the same text.  Null and empty texts
    stay as they are; an empty table stays empty.
    """
    spans = repeats(docs, id_col, text_col, unit, min_words) if spans is None else spans
    cuts = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    at, width = docs.columns.index(text_col), len(docs.columns)
    plain = docs.toDF(*[f"c{i}" for i in range(width)])
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for i in range(0, len(b), AT_ONCE):
                part = b.slice(i, AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns, _key_of(part.column(at).to_pylist())], [*(f"c{k}" for k in range(width)), "key"])

    own = F.col(f"d.c{docs.columns.index(id_col)}").cast("long")
    held = plain.mapInArrow(keyed, f"{kinds}, key long").alias("d")
    held = held.join(cuts.alias("k"), own.eqNullSafe(F.col("k.doc_id")) & (F.col("d.key") == F.col("k.text_hash")), "left").select("d.*", "k.cuts").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            texts = b.column(at).to_pylist()
            for i, known in enumerate(b.column(width).to_pylist()):
                if known:
                    ends = [0, *(c["end"] for c in known)]
                    texts[i] = "".join(texts[i][e:s] for e, s in zip(ends, [*(c["start"] for c in known), len(texts[i])]))
            columns = [b.column(k) for k in range(width)]
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(width)])

    return held.mapInArrow(run, kinds).toDF(*docs.columns)
