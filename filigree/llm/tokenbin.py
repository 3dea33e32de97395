"""Token ids in binary shards: one shared zstandard dictionary, every document a frame of its own.

A shard is: magic, length and text of a JSON header (id type, SHA-256 of the
dictionary), the frames, the index, a footer.  The index holds per document its
id, whether the id is null, the frame's offset and length and the number of
ids, so that one document is read with two short reads.  The dictionary lies
beside the shards under the name of its digest.  Shards and the documents in
them are in ascending order of the id (null first).

Files are written under a name of the attempt and then moved into place, so a
task that is repeated on another executor leaves the same file.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow.fs import FileSelector, FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_path, trimmed, uri, written

MAGIC = b"FGTOK001"
LEVEL = 1
#: Documents of a shard, of the dictionary's sample, bytes of the dictionary, chunks that a worker remembers, bytes of the longest, chunks encoded as one text.
SHARD_DOCS, SAMPLE_DOCS, DICT_BYTES, MEMO, LONGEST, JOINED = 4096, 1024, 1 << 16, 300_000, 48, 1024
#: Marks that a tokenizer sets apart from the letter or digit before them, and letters of Latin-1, marks of ASCII behind them or not
#: (no apostrophe, which may begin a contraction, and no sign of special tokens).
MARKED = r"([a-z0-9])([.,;:?!])([\x20\x09-\x0D]|\z)"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = r"[!-&(-/:;=?@\[-`{}~]"
PLAIN = rf"^[A-Za-zÀ-ÖØ-öø-ÿ]+{MARKS}*\z"
ENDING = rf"^([^\x00-@\[-`{{-~]+)({MARKS}+)\z"
#: Bytes of text handled at once.
TEXT = 2_000_000
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n", "<u4")])


def looks_at_words_alone(spec: dict) -> bool:
    """Whether a tokenizer's description is of the one kind that ``Encoder`` cuts texts for: lower case, words and marks apart, white space dropped."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in cuts] != ["Split", "ByteLevel"]:
        return False
    space = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    split = cuts[0]["pattern"] == {"Regex": SPLIT} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    plain = not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    return space and split and plain and not spec.get("post_processor") and all("<|" in t["content"] for t in spec.get("added_tokens") or [])


class Encoder:
    """Ids of whole texts, fast for a tokenizer that lower-cases and never looks across ASCII white space.

    Any other tokenizer encodes texts whole, ``looks_at_words_alone`` tells.  The one named gives a text the ids of its white-space-separated chunks one after another, and a chunk that ends
    in one mark after an ASCII letter or digit those of the two parts.  ASCII letters, marks behind them or not, go to the tokenizer's model without its
    normaliser and its search for words, which do nothing more to them than is done here.  Ids of short chunks are remembered, when there are
    too many those of the last texts alone.  Texts that may hold the tokenizer's own special tokens are encoded whole.
    """

    _of: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.apart = looks_at_words_alone(spec)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        most = max(vocabulary.values())
        self.kind, self.closes = "<u2" if most < 1 << 16 else "<u4", None
        if suffix and self.apart:
            self.closes = np.zeros(1 + most, bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            self.words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self._forget()

    def _forget(self) -> None:
        """Remembered chunks, their ids one after another, where those of each begin and how many they are."""
        self.known, self.pool = pa.array([], pa.string()), np.empty(0, self.kind)
        self.first, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def at(cls, path: str) -> "Encoder":
        """One per Python worker: workers are used again for later tasks."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _by_chunk(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of chunks, one by one, and how many each has."""
        ids = [np.array(e.ids, self.kind) for i in range(0, len(chunks), JOINED) for e in self.tokenizer.encode_batch_fast(chunks.slice(i, JOINED).to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.kind), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def _by_word(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks that are PLAIN: one id ends the letters, one the marks behind them, so many go to the model as one text."""
        parts = pc.replace_substring_regex(chunks, ENDING, r"\1 \2")
        last = np.cumsum(1 + (pc.binary_length(parts).to_numpy() > pc.binary_length(chunks).to_numpy())) - 1
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), " ")[0].as_py()
        (e,) = (self.words if text.isascii() else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(e.ids, self.kind)
        ends = np.nonzero(self.closes[ids])[0] + 1
        if len(ends) != last[-1] + 1:
            return self._by_chunk(chunks)
        return ids, np.diff(ends[last], prepend=0)

    def _new(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Chunks in an order of their own, all their ids, how many each has."""
        odd, made = chunks, []
        if self.closes is not None:
            plain = pc.match_substring_regex(chunks, PLAIN)
            odd, ascii = chunks.filter(pc.invert(plain)), pc.string_is_ascii(chunks)
            for own in (chunks.filter(pc.and_(plain, ascii)), chunks.filter(pc.and_not(plain, ascii))):
                made += [(p, *self._by_word(p)) for p in (own.slice(i, JOINED) for i in range(0, len(own), JOINED))]
        made.append((odd, *self._by_chunk(odd)))
        return pa.concat_arrays([p for p, _, _ in made]), np.concatenate([ids for _, ids, _ in made]), np.concatenate([n for _, _, n in made])

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct chunks: ids, where those of each begin among them, how many they are."""
        at = pc.index_in(chunks, self.known)
        new, ids, sizes = self._new(chunks.filter(at.is_null()))
        known, pool = pa.concat_arrays([self.known, new]), np.concatenate([self.pool, ids])
        every = np.append(self.sizes, sizes)
        first = np.append(self.first, len(self.pool) + np.cumsum(sizes) - sizes)
        place = at.to_numpy(zero_copy_only=False)
        if len(new):
            lost = at.is_null()
            place = place.copy()
            place[lost.to_numpy(zero_copy_only=False)] = len(self.known) + pc.index_in(chunks.filter(lost), new).to_numpy()
        place = place.astype(np.int64)
        out = pool, first[place], every[place]
        if len(known) > MEMO:  # those of these texts alone
            known, pool, first, every = chunks, *_gathered(pool, first[place], every[place])
        if len(new):
            short = pc.less_equal(pc.binary_length(known), LONGEST)
            if not pc.all(short).as_py():
                keep = short.to_numpy(zero_copy_only=False)
                known, pool, first, every = known.filter(short), *_gathered(pool, first[keep], every[keep])
            self.known, self.pool, self.first, self.sizes = known, pool, first, every
        return out

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; none for null."""
        return (np.frombuffer(raw, self.kind) for raw in self.raw(pa.array(texts, pa.string())))

    def raw(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as little-endian integers of ``kind``."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first, done = 0, 0
        while first < len(texts):  # at most TEXT bytes at once, or one text
            last = max(first + 1, int(np.searchsorted(ends, done + TEXT, "right")))
            yield from self._raw(pc.fill_null(texts.slice(first, last - first), ""))
            first, done = last, int(ends[last - 1])

    def _raw(self, texts: pa.Array) -> Iterator[bytes]:
        if not self.apart:
            for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.array(e.ids, self.kind).tobytes()
            return
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), MARKED, r"\1 \2\3")
        split = pc.ascii_split_whitespace(apart)
        coded = split.values.dictionary_encode()
        pool, first, sizes = self._chunk_ids(coded.dictionary)
        at = coded.indices.to_numpy()
        out, begins, _ = _gathered(pool, first[at], sizes[at])
        bounds = np.append(begins, len(out))[split.offsets.to_numpy()]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        for k in range(len(texts)):
            if special[k]:
                yield np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, self.kind).tobytes()
            else:
                yield out[bounds[k] : bounds[k + 1]].tobytes()


def _gathered(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of ``pool`` one after another, where each now begins, and their sizes."""
    begins = np.cumsum(sizes) - sizes
    take = np.repeat(first - begins, sizes)
    take += np.arange(len(take))
    return pool[take], begins, sizes


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary, or none where the samples are too few or too small for one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_shards(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes ``docs`` to ``out_dir`` (a URI that all executors reach) and returns ``(shard, path, n_docs, n_tokens, base)``.

    ``base``: ids in the shards before.  A null or empty text is the end id
    alone; null and repeated ids keep their rows; an empty table gives no
    shards; other columns are ignored.  The dictionary is trained on the ids of
    about SAMPLE_DOCS documents picked by a hash of their id.
    """
    spark = docs.sparkSession
    out_dir = uri(spark, out_dir)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = docs.count()
    every = max(1, total // SAMPLE_DOCS)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").limit(2 * SAMPLE_DOCS)
    kind = Encoder.at(tokenizer).kind
    if end_id > np.iinfo(kind).max:
        raise ValueError(f"the end id {end_id} is no id of this tokenizer")
    raw = train_dictionary(list(Encoder.at(tokenizer).raw(pa.array([r[0] for r in picked.toLocalIterator()], pa.string()))))
    digest = hashlib.sha256(raw).hexdigest()
    fs, root = FileSystem.from_uri(out_dir)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/{digest}.dict") as f:
        f.write(raw)
    shared = spark.sparkContext.broadcast(raw)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, encoder, pack = np.array([end_id], kind).tobytes(), Encoder.at(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(shared.value), write_checksum=True)
        for b in trimmed(batches):
            for i in range(0, len(b), 1024):
                part, frames, counts = b.slice(i, 1024), [], []
                for ids in encoder.raw(part.column(1)):
                    counts.append(len(ids) // len(end) + 1)
                    frames.append(pack.compress(ids + end))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])

    coded = written(docs.mapInArrow(encode, "doc_id long, n long, frame binary"), "frames")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(out_dir)
        shard = TaskContext.get().partitionId()
        path, own = f"{root}/shard-{shard:08d}.tok", f"{root}/_attempt-{uuid.uuid4().hex}"
        index, at, out, tokens, count = [], 0, None, 0, 0
        for b in trimmed(batches):
            if not len(b):
                continue
            if out is None:
                out = fs.open_output_stream(own)  # what a lost executor leaves of it is deleted below
                head = json.dumps({"ids": kind, "dictionary": digest, "end": end_id}).encode()
                out.write(MAGIC + struct.pack("<I", len(head)) + head)
                at = len(MAGIC) + 4 + len(head)
            entries = np.zeros(len(b), INDEX)
            frames = b.column(2).to_pylist()
            entries["length"] = list(map(len, frames))
            entries["offset"] = at + np.cumsum(entries["length"], dtype=np.uint64) - entries["length"]
            entries["null"] = b.column(0).is_null().to_numpy(zero_copy_only=False)
            entries["id"] = b.column(0).fill_null(0).to_numpy()
            entries["n"] = b.column(1).to_numpy()
            out.write(b"".join(frames))
            at += int(entries["length"].sum(dtype=np.int64))
            tokens, count = tokens + int(entries["n"].sum(dtype=np.int64)), count + len(b)
            index.append(entries.tobytes())
        if out is not None:
            raw = b"".join(index)
            out.write(raw + struct.pack("<QQI", at, count, zlib.crc32(raw)) + MAGIC)
            out.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "n_docs": count, "n_tokens": tokens}])

    shards = max(1, -(-total // shard_docs))
    order = [F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("frame")]
    dealt = coded.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = cut(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"))
    for left in fs.get_file_info(FileSelector(root)):  # of attempts that failed or came second
        if left.base_name.startswith("_attempt-"):
            fs.delete_file(left.path)
    # One row per shard of shard_docs documents, numbered in one task: 250 million rows for a million million documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Shard:
    """A shard open for reading; the dictionary's digest is verified."""

    def __init__(self, fs: FileSystem, path: str):
        self.file, size = fs.open_input_file(path), fs.get_file_info(path).size
        foot = self.file.read_at(28, size - 28)
        at, count, crc = struct.unpack("<QQI", foot[:20])
        raw = self.file.read_at(size - 28 - at, at)
        if foot[20:] != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError(f"{path} is not a whole shard")
        self.index = np.frombuffer(raw, INDEX, count)
        (length,) = struct.unpack("<I", self.file.read_at(4, len(MAGIC)))
        self.head = json.loads(self.file.read_at(length, len(MAGIC) + 4))
        with fs.open_input_stream(f"{path.rpartition('/')[0]}/{self.head['dictionary']}.dict") as f:
            known = f.read()
        if hashlib.sha256(known).hexdigest() != self.head["dictionary"]:
            raise ValueError(f"{path}: its dictionary has changed")
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dict(known))

    def ids(self, k: int) -> np.ndarray:
        """The ids of document ``k`` of the shard: one short read."""
        e = self.index[k]
        raw = self.unpack.decompress(self.file.read_at(int(e["length"]), int(e["offset"])))
        return np.frombuffer(raw, self.head["ids"])


def read_shards(manifest: DataFrame, out_dir: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files: place and checksum of its ids.

    ``manifest``: what ``write_shards`` returned.  Rows without an id come back with a null one, repeated rows repeat; no shards give no rows;
    a file that is cut short or changed raises an error.
    """
    out_dir = uri(manifest.sparkSession, out_dir)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = FileSystem.from_uri(out_dir)
        for b in trimmed(batches):
            for row in b.to_pylist():
                shard = Shard(fs, row["path"])
                n = len(shard.index)
                sums, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k in range(n):
                    ids = shard.ids(k)
                    sums[k], counts[k] = zlib.crc32(ids.astype("<u4").tobytes()), len(ids)
                start = row["base"] + np.cumsum(counts) - counts
                ids = pa.array(shard.index["id"].copy(), mask=shard.index["null"].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(counts), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartitionByRange(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as shards and reads them back: see ``write_shards`` and ``read_shards``, also for odd rows.

    Without ``out_dir`` the files lie in the shared folder until the driver ends.
    """
    spark: SparkSession = docs.sparkSession
    out_dir = out_dir or new_path(spark, "tokens")
    return read_shards(write_shards(docs, out_dir, tokenizer, end_id, id_col, text_col), out_dir)
