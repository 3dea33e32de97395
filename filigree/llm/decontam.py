"""Benchmark decontamination: MinHash containment search, partitioned by size, exact shingles to confirm.

A document contains an item if it holds at least ``threshold`` (0.8) of the
item's distinct shingles (5 words).  A short item inside a long document has a
tiny Jaccard similarity, so signatures of whole documents would miss it.
The sketch is therefore taken of the item: its ``k`` smallest shingle hashes.
Items are partitioned by the number of their shingles, and a partition's ``k``
is one more than the shingles that its items may lack; whatever the document's
length, one of those ``k`` must then be among its shingles.  That makes the
search free of false negatives.  The share of the sketch that a document holds
is the MinHash estimate of its containment; the shingles themselves decide.
An item with fewer words than a shingle is one shingle, of its whole words.

Items are the small side and are dealt in blocks of bounded size, each block
sent to all tasks in its turn; documents are read once per block, never shuffled
and never gathered.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import trimmed, written

#: Fixed value: a word is a run of letters and digits of ASCII and of anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = re.compile(WORD).findall
#: Words of items in one block, and words whose hashes a task remembers.
BLOCK_WORDS, MEMO = 2_000_000, 100_000


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


class _Hashes(dict):
    """The 64-bit hash of each word, remembered for as many words as MEMO."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_hashes(words: list[str], n: int, memo: _Hashes) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    many = len(words) - n + 1
    out = each[:many].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += each[k : k + many]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Block:
    """Some items, ready to be looked for in documents."""

    def __init__(self, items: Iterable[tuple], shingle: int = 5, threshold: float = 0.8):
        self.items, memo = [], _Hashes()
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            n = min(shingle, len(words))
            if n:
                by_hash = {int(h): tuple(words[i : i + n]) for i, h in enumerate(shingle_hashes(words, n, memo))}
                distinct = len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
                need = int(np.ceil(threshold * distinct - 1e-9))
                parts[n, distinct.bit_length()].append(len(self.items))
                self.items.append((item_id, by_hash, distinct, need))
        found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.sketch = np.ones(len(self.items), np.int64)
        for (n, _), members in parts.items():  # items of m to 2m - 1 shingles share a sketch size
            k = max(self.items[i][2] - self.items[i][3] + 1 for i in members)
            for i in members:
                least = sorted(self.items[i][1])[:k]
                self.sketch[i] = len(least)
                for h in least:
                    found[n][h].append(i)
        #: Per length of shingles: sorted hashes, their items, and a first sieve by 16 bits.
        self.tables = []
        for n, owners in sorted(found.items()):
            table, quick = np.array(sorted(owners), np.uint64), np.zeros(1 << 16, bool)
            quick[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.tables.append((n, table, [owners[int(h)] for h in table], quick))

    def search(self, text: str | None, memo: _Hashes) -> list[tuple]:
        """``(item_id, shingles, found, estimate)`` of every item that the text contains."""
        words, out = words_of(text), []
        for n, table, owners, quick in self.tables:
            hashes = shingle_hashes(words, n, memo)
            likely = hashes[quick[(hashes & np.uint64(0xFFFF)).astype(np.int64)]]
            if not len(likely):
                continue
            at = np.searchsorted(table, likely)
            at[at == len(table)] = 0
            hits = Counter(i for k in np.unique(at[table[at] == likely]) for i in owners[k])
            for i, held in hits.items():
                item_id, by_hash, distinct, need = self.items[i]
                places = np.nonzero(np.isin(hashes, np.array(list(by_hash), np.uint64)))[0]
                own = set(by_hash.values())
                m = len({s for p in places if (s := tuple(words[p : p + n])) in own})
                if m >= need:
                    out.append((i, item_id, distinct, m, held / int(self.sketch[i])))
        return [x[1:] for x in sorted(out, key=lambda x: x[0])]


def blocks(items: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> Iterator[Block]:
    """The items in blocks of at most BLOCK_WORDS words (or one item), streamed to the driver."""
    held, words = [], 0
    for item_id, text in items.select(id_col, text_col).toLocalIterator():
        n = len(words_of(text))
        if held and words + n > BLOCK_WORDS:
            yield Block(held, shingle, threshold)
            held, words = [], 0
        held.append((item_id, text))
        words += n
    yield Block(held, shingle, threshold)


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment, estimate)`` for every row of ``docs`` and every item that it contains.

    Words are compared in lower case and without ASCII punctuation.  Null or
    empty texts contain nothing; an item with fewer words than a shingle is found
    where its words stand one after another, one without words nowhere;
    ``estimate`` is the share of the item's sketch in the text; null ids and
    repeated rows on either side keep their rows; empty tables give no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    kinds = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id_col].dataType.simpleString()}"
    item_type, out, shared = _arrow_type(items, item_id_col), None, None
    for block in blocks(items, item_id_col, item_text_col, shingle, threshold):
        if out is not None:  # one block at a time is held by the tasks
            out = written(out, "contained")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memo, block = _Hashes(), shared.value
            for b in trimmed(batches):
                found = [(i, *x) for i, t in enumerate(b.column(1)) for x in block.search(t.as_py(), memo)]
                rows, items_, n, m, guess = zip(*found) if found else ((), (), (), (), ())
                ids = b.column(0).take(pa.array(rows, pa.int64()))
                share = pa.array([y / x for x, y in zip(n, m)], pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(items_, item_type), pa.array(n, pa.int32()), pa.array(m, pa.int32()), share, pa.array(guess, pa.float64())],
                    ["doc_id", "item_id", "n_shingles", "n_found", "containment", "estimate"],
                )

        part = docs.select(id_col, text_col).mapInArrow(run, f"{kinds}, n_shingles int, n_found int, containment double, estimate double")
        out = part if out is None else out.unionByName(part)
    return out


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that contain an item, as ``contained_items`` finds them; no shuffle.

    All columns come back unchanged, whatever their names; null and empty texts, null ids and
    repeated rows stay; without items every row stays, and no rows give no rows.
    """
    spark, at, shared, names = docs.sparkSession, docs.columns.index(text_col), None, docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # any names
    for block in blocks(items, item_id_col, item_text_col, shingle, threshold):
        if shared is not None:
            docs = written(docs, "clean")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memo, block = _Hashes(), shared.value
            for b in trimmed(batches):
                clean = [not block.search(t.as_py(), memo) for t in b.column(at)]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
