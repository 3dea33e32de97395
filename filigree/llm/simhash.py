"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints link at ``radius`` (3) or fewer differing bits.  Two fingerprints
that close agree in one 32-bit half up to one bit, so each fingerprint is filed
under both halves and probes, per half, the half itself and the halves with one
zero bit set (of two halves that differ in one bit, one has the zero there, so
one side's probe suffices).  Complete distances decide.

Only distinct fingerprints take part, so copies cost nothing.  A half that
gathers many fingerprints (a large group of near copies) is dealt in a grid of
blocks; a block pair returns the links of a spanning forest of its matches, not
the matches, which leaves the components as they are.

For a similarity of shingle sets, 64 bits and 3 of them are too few:
``keep_similar_one`` takes long fingerprints, files them under all their segments,
asks balls of radius 1 in the same way and verifies complete distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, cut, lookup, trimmed
from .components import components
from .decontam import _Hashes, shingle_hashes

SEED = 42
#: Entries of a key up to which all are compared in one join; beyond, in a grid of blocks of BLOCK.
SMALL, BLOCK = 16, 2048


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows of 8 bytes have each of the 64 bits; eight counters are added at once, 255 rows before any can overflow."""
    bits = np.unpackbits(rows, axis=1).view(np.uint64)
    whole = len(bits) // 255 * 255
    parts = [bits[:whole].reshape(-1, 255, 8).sum(axis=1, dtype=np.uint64), bits[whole:].sum(axis=0, dtype=np.uint64, keepdims=True)]
    return np.concatenate(parts).view(np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of one text as an unsigned 64-bit integer; 0 without words.

    A-Z are lower-cased; words are runs of other than white space; a text with
    fewer words than ``shingle`` is one shingle; repeated shingles count again.
    """
    words = (text or "").translate(LOWER_TABLE).encode().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n < 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_digest, b" ".join
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, n, step):  # bounded memory for very long texts
        hashed = b"".join([digest(join(words[k : k + shingle]), SEED) for k in range(i, min(n, i + step))])
        ones += bit_counts(np.frombuffer(hashed, np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash long, fp long)``: one row per row of ``docs``; a null text counts as empty. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(F.col(text_col)).alias("_text_hash"), text_col).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def _forest(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of the pairs (x of a, y of b) at ``radius`` or fewer bits; ``a`` and ``b`` are rows of 64-bit words.

    Vertices are taken by ascending id, so that groups that meet under several keys give the same few hubs and mostly the same links.
    """
    verts, pos = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    ia, ib = pos[: len(a)], pos[len(a) :]
    root, out = np.arange(len(verts)), []
    for i in np.argsort(ia, kind="stable"):
        near = ib[np.bitwise_count(b ^ a[i]).sum(axis=1, dtype=np.int64) <= radius]
        mine = root[ia[i]]
        met, at = np.unique(root[near], return_index=True)
        if (other := met != mine).any():
            out.append(np.stack([np.full(other.sum(), verts[ia[i]]), verts[near[at[other]]]], axis=1))
            root[np.isin(root, met)] = mine
            if (root == mine).all():  # nothing is left to join
                break
    return np.concatenate([np.empty((0, 2), np.int64), *out])


def _dense(filed: DataFrame, probes: DataFrame, crowded: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Links among what meets in crowded keys: row i of a grid holds block i of what is filed there, column j block j of what is filed or asks."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    grid = crowded.select("seg", "val", blocks(F.col("n")).alias("rows"), blocks(F.col("n") + F.col("p")).alias("cols"))
    deal = lambda k: F.pmod(F.xxhash64("fp"), F.col(k)).cast("int")
    kept = filed.join(grid, ["seg", "val"])
    own = list(dict.fromkeys(["fp", *words]))
    left = kept.select("seg", "val", deal("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), *own, F.lit(True).alias("filed"))
    right = kept.unionByName(probes.join(grid, ["seg", "val"])).select(
        "seg", "val", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), deal("cols").alias("j"), *own, F.lit(False).alias("filed")
    )

    def forest(t: pa.Table) -> pa.Table:
        fp, side = t.column("fp").to_numpy(), t.column("filed").to_numpy(zero_copy_only=False)
        w = np.stack([t.column(c).to_numpy() for c in words], axis=1).view(np.uint64)
        found = _forest(fp[side], w[side], fp[~side], w[~side], radius)
        return pa.table({"u": pa.array(found[:, 0], pa.int64()), "v": pa.array(found[:, 1], pa.int64())})

    cell = ["seg", "val", "i", "j"]
    # Dealt anew by hand: Spark 4.1 takes the union of equally partitioned sides for partitioned, which adaptive reads may undo.
    return left.unionByName(right).repartition(*cell).groupBy(*cell).applyInArrow(forest, "u long, v long")


def _asked(filed: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Probes of ``filed (seg, val, fp, ...)``, its values with one zero of ``bits`` bits set, and the crowded keys ``(seg, val, n, p)``."""
    each = F.array(*[F.lit(1 << k) for k in range(bits)])
    flips = F.transform(F.filter(each, lambda b: F.col("val").bitwiseAND(b) == 0), lambda b: F.col("val").bitwiseOR(b))
    size = filed.groupBy("seg", "val").agg(F.count("*").alias("n"))
    # Most probes meet nothing; what does is dealt once and kept.
    probes = cut(filed.withColumn("val", F.explode(flips)).join(size.select("seg", "val"), ["seg", "val"]))
    asked = probes.groupBy("seg", "val").agg(F.count("*").alias("p")).where(F.col("p") > SMALL)
    crowded = size.join(asked, ["seg", "val"], "left").where(f"n > {SMALL} or p is not null")
    return probes, cut(crowded.select("seg", "val", "n", F.coalesce("p", F.lit(0)).alias("p")))


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``(u, v)``: links between the distinct ``fp`` that join what lies within ``radius`` (at most 3) bits.

    Every pair within the radius is connected by the links returned; in crowded
    halves not each such pair is a link itself.
    """
    if radius > 3:
        raise ValueError("two halves with balls of radius 1 find distances up to 3")
    low = F.lit(0xFFFFFFFF)
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("val")),
        F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(low).alias("val")),
    )
    filed = cut(fps.select("fp", F.explode(halves).alias("h")).select(F.col("h.seg").alias("seg"), F.col("h.val").alias("val"), "fp"))
    probes, crowded = _asked(filed, 32)
    alone = lambda df: df.join(crowded.select("seg", "val"), ["seg", "val"], "left_anti")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    one = alone(filed).withColumnRenamed("fp", "u")
    same = one.join(one.withColumnRenamed("u", "v"), ["seg", "val"]).where(F.col("u") < F.col("v")).where(near)
    other = alone(probes).withColumnRenamed("fp", "v").join(one, ["seg", "val"]).where(near)
    out = same.select("u", "v").unionByName(other.select("u", "v"))
    return out.unionByName(_dense(filed, probes, crowded, ["fp"], radius))


@dataclass(frozen=True)
class Wide:
    """Long fingerprints for a similarity: ``words`` of 64 bits, ``segments`` of ``width`` bits, and the ``radius`` of that similarity.

    Segments are as wide as the logarithm of the rows and two bits more, so that
    few unlike texts meet, and as many as it takes for two texts of the given
    Jaccard similarity to agree in one of them up to a bit with probability
    ``recall``.  Up to ``2 * segments - 1`` bits none is missed.
    """

    words: int
    segments: int
    width: int
    radius: int

    @classmethod
    def of(cls, rows: int, similarity: float, recall: float) -> "Wide":
        width = min(31, max(16, rows.bit_length() + 2))
        off = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of one bit, for sets of equal size
        meet = (1 - off) ** width + width * off * (1 - off) ** (width - 1)
        words = max(4, -(-width * math.ceil(math.log(1 - recall) / math.log(1 - meet)) // 64))  # the fewer bits, the rougher the radius
        return cls(words, 64 * words // width, width, int(64 * words * off) + 1)


def wide_fingerprint(text: str | None, shingle: int, wide: Wide, memo: _Hashes) -> np.ndarray:
    """The bits of the SimHash of a text's distinct shingles; none set without words, one shingle where words are too few."""
    words = (text or "").translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(64 * wide.words, np.uint8)
    h = np.unique(shingle_hashes(words, min(shingle, len(words)), memo))
    out = []
    for k in range(wide.words):  # one more hash of each shingle per word
        x = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(2 * bit_counts((x ^ x >> np.uint64(31)).view(np.uint8).reshape(-1, 8)) > len(h))
    return np.concatenate(out).astype(np.uint8)


def wide_fingerprints(docs: DataFrame, wide: Wide, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(doc_id, text_hash, fp, w0, w1, ..., segs)``: the words of the fingerprint, a hash of them, and the values of the segments."""
    names = [f"w{k}" for k in range(wide.words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, scale = _Hashes(), 1 << np.arange(wide.width, dtype=np.int64)
        for b in trimmed(batches):
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                bits = np.array([wide_fingerprint(t.as_py(), shingle, wide, memo) for t in part.column(2)], np.uint8).reshape(len(part), 64 * wide.words)
                packed = np.packbits(bits, axis=1)
                ids = np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in packed], np.uint64).view(np.int64)
                segs = (bits[:, : wide.segments * wide.width].reshape(len(part), wide.segments, wide.width) @ scale).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * wide.segments, pa.int32()), pa.array(segs.ravel()))
                words = packed.view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids), *(pa.array(words[:, k].copy()) for k in range(wide.words)), lists], ["doc_id", "text_hash", "fp", *names, "segs"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, fp long, {', '.join(f'{n} long' for n in names)}, segs array<int>"
    return docs.select(id_col, F.xxhash64(F.col(text_col)).alias("_text_hash"), text_col).mapInArrow(run, schema)


def wide_links(fps: DataFrame, wide: Wide) -> DataFrame:
    """``(u, v)`` between the distinct ``fp`` of ``fps (fp, w0, ..., segs)`` that join what meets in a segment and lies within the radius."""
    names = [f"w{k}" for k in range(wide.words)]
    filed = cut(fps.select("fp", F.posexplode("segs").alias("seg", "val")))
    probes, crowded = _asked(filed, wide.width)
    alone = lambda df: df.join(crowded.select("seg", "val"), ["seg", "val"], "left_anti")
    one = alone(filed).withColumnRenamed("fp", "u")
    same = one.join(one.withColumnRenamed("u", "v"), ["seg", "val"]).where(F.col("u") < F.col("v")).select("u", "v")
    other = alone(probes).withColumnRenamed("fp", "v").join(one, ["seg", "val"]).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    # Rows that meet carry ids only; words are fetched for pairs, once each.
    pairs = same.unionByName(other).repartition("u").dropDuplicates(["u", "v"])
    words = fps.select("fp", *names)
    both = pairs.join(words.withColumnsRenamed({"fp": "u"} | {n: f"u_{n}" for n in names}), "u").join(words.withColumnRenamed("fp", "v"), "v")
    far = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"u_{n}"))) for n in names), F.lit(0))
    out = both.where(far <= wide.radius).select("u", "v")
    hot = crowded.select("seg", "val")
    with_words = lambda df: df.join(hot, ["seg", "val"], "left_semi").join(words, "fp")
    return out.unionByName(_dense(with_words(filed), with_words(probes), crowded, names, wide.radius))


def _grouped(own: DataFrame, links_of) -> DataFrame:
    """``own (doc_id, fp, ...)`` with ``component_id`` and ``root``, the fingerprint that stands for the component."""
    own = cut(own)
    more = [c for c in own.columns if c not in ("doc_id", "text_hash", "fp")]
    each = cut(own.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), *[F.any_value(c).alias(c) for c in more]))
    rooted = components(links_of(each.select("fp", *more)))
    own, each = own.drop(*more), each.select("fp", "rep", "rows")
    moved = cut(each.join(rooted.withColumnRenamed("u", "fp"), "fp").select("fp", "rep", "rows", "root"))
    ids = moved.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("members"))
    ids = ids.join(each.select(F.col("fp").alias("root"), "rep"), "root")
    ids = cut(ids.select("root", F.least("least", "rep").alias("component_id"), "members"))
    linked = lookup(moved, ids, "root", "members").select("fp", "root", "component_id", "rows")
    roots = each.join(ids.select(F.col("root").alias("fp"), "component_id"), "fp", "left").join(moved.select("fp"), "fp", "left_anti")
    table = linked.unionByName(roots.select("fp", F.col("fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"), "rows"))
    return lookup(own, cut(table), "fp", "rows")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp long, component_id)`` for every row of ``docs``.

    ``component_id``: the smallest ``doc_id`` among the rows reachable over
    links, the row itself included.  Null or empty texts have fingerprint 0 and
    are linked like any other; a null id keeps its row and never is a
    component's id unless all ids of the component are null; repeated rows stay
    repeated; no rows give no rows; other columns are ignored.
    """
    own = fingerprints(docs, id_col, text_col, shingle).drop("text_hash")
    return _grouped(own, lambda fps: links(fps, radius)).select("doc_id", "fp", "component_id")


def _one_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row per root of ``found (doc_id, text_hash, root)``: smallest id, then text hash."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m"))
    first = cut(first.select("m.doc_id", "m.text_hash"))
    at = F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("k.text_hash"))
    kept = docs.alias("d").join(first.alias("k"), at, "left_semi")
    again = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")).where("rows > 1").alias("a")
    both = F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.text_hash") == F.col("a.text_hash"))
    again = cut(first.alias("f").join(again, both, "left_semi"))
    if again.isEmpty():
        return kept
    rest = kept.alias("d").join(again.alias("k"), at, "left_anti")
    return rest.unionByName(kept.alias("d").join(again.alias("k"), at, "left_semi").dropDuplicates([id_col, text_col]))


def keep_similar_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """``docs`` with one row of each group of texts whose fingerprints are as near as those of sets of shingles of ``similarity``.

    The similarity is the Jaccard similarity of the sets of ``shingle`` words as
    the complete distance of long fingerprints tells it (``Wide``); groups are
    what links reach.  The row with the smallest id stays, of equal ids that
    with the smallest text hash.  Rows that share id and text count as one;
    texts without words are alike; a text with fewer words than a shingle is one
    shingle; null ids are ids, the last ones.  All columns come back unchanged;
    an empty table stays empty.
    """
    wide = Wide.of(docs.count(), similarity, recall)
    found = _grouped(wide_fingerprints(docs, wide, id_col, text_col, shingle), lambda fps: wide_links(fps, wide))
    return _one_each(docs, cut(found.select("doc_id", "text_hash", "root")), id_col, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of equal ids that with the smallest text hash.

    Rows that share id and text count as one; rows without words have fingerprint 0.
    All columns come back unchanged; an empty table stays empty.
    """
    found = _grouped(fingerprints(docs, id_col, text_col, shingle), lambda fps: links(fps, radius))
    return _one_each(docs, cut(found.select("doc_id", "text_hash", "root")), id_col, text_col)
