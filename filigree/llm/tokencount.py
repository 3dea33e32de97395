"""Token counts that follow edits without encoding the whole text again.

Byte-pair encoding works within pre-tokens, and pre-tokens are found from left
to right by a pattern that looks only a few characters ahead.  A document keeps
a segment tree over leaves of some pre-tokens each: characters and tokens per
leaf and their sums above.  Trees are kept as a table beside the texts.  An edit
finds its leaf by the character sums, starts CONTEXT characters earlier, and before
any white space there, at a leaf's start, encodes on until a boundary of the
new pre-tokens meets a leaf's start beyond the edit (from there on nothing can
differ), puts the new leaves in and updates the sums.  Patterns may look ahead
over white space or CONTEXT characters, and never back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import trimmed, written

#: Pre-tokens of a leaf, characters that a boundary may depend on, pre-tokens that a worker remembers, longest of them.
LEAF, CONTEXT, MEMO, LONGEST = 64, 8, 400_000, 64
#: Personal data and secrets that the masking query replaces.
MASKS = [
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
    (r"\b[0-9a-f]{32,64}\b", "<key>"),
    (r"\b\d{12,19}\b", "<card>"),
    (r"(?:\+\d{1,3} )?\(\d{3}\) \d{3}-\d{4}\b", "<phone>"),
]
_MASK = regex.compile("|".join(f"({p})" for p, _ in MASKS))
#: What a text needs, in the order of MASKS, for the pattern to match anywhere in it.
_NEEDS = [regex.compile(p) for p in ("@", r"\.\d", "[0-9a-f]{32}", r"\d{12}", r"\) \d{3}-")]


class Counter:
    """Tokens of a pre-token, by a byte-pair vocabulary with ranks; remembered for the commonest lengths."""

    _of: dict[tuple, "Counter"] = {}

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.memo = regex.compile(pattern), {}

    @classmethod
    def at(cls, path: str, pattern: str) -> "Counter":
        if (path, pattern) not in cls._of:
            cls._of[path, pattern] = cls(path, pattern)
        return cls._of[path, pattern]

    def tokens(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = n
        return n

    def whole(self, text: str) -> int:
        """Tokens of the whole text, without the tree: what the tree must agree with."""
        return len(self.encoding.encode_ordinary(text))


@dataclass
class Tree:
    """Leaves and the sums above: ``chars[0]`` and ``tokens[0]`` are the leaves, each level above adds pairs."""

    chars: list[np.ndarray]
    tokens: list[np.ndarray]
    pieces: int = 0

    @classmethod
    def of(cls, chars: np.ndarray, tokens: np.ndarray, pieces: int) -> "Tree":
        tree = cls([chars], [tokens], pieces)
        tree._raise(0)
        return tree

    def _raise(self, leaf: int) -> None:
        """Sums above the leaves from ``leaf`` on; what lies left of it stays."""
        for levels in (self.chars, self.tokens):
            at, k = leaf, 0
            while len(levels[k]) > 1:
                at //= 2
                below = levels[k][2 * at :]
                pairs = np.append(below, 0)[: len(below) + len(below) % 2].reshape(-1, 2).sum(1)
                kept = levels[k + 1][:at] if k + 1 < len(levels) else np.empty(0, np.int64)
                levels[k + 1 :] = [np.concatenate([kept, pairs]), *levels[k + 2 :]]
                k += 1
            del levels[k + 1 :]

    @property
    def total(self) -> int:
        return int(self.tokens[-1][0]) if len(self.tokens[-1]) else 0

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at ``offset`` (the last leaf beyond the end) and where it starts."""
        at = start = 0
        for level in reversed(self.chars[:-1]):
            at *= 2
            if at + 1 < len(level) and offset >= start + level[at]:
                start += int(level[at])
                at += 1
        return at, start


def build(counter: Counter, text: str | None) -> Tree:
    """The segment tree of a text; null counts as empty."""
    pieces = counter.pattern.findall(text or "")
    tokens = np.fromiter(map(counter.tokens, pieces), np.int64, len(pieces))
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    cuts = np.arange(0, len(pieces), LEAF)
    add = lambda x: np.add.reduceat(x, cuts) if len(x) else x
    return Tree.of(add(chars), add(tokens), len(pieces))


def apply_edits(counter: Counter, tree: Tree, text: str, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
    """Replaces ``text[start:end]`` by ``new`` for all ``(start, end, new)``, ascending and apart; updates the tree.

    Returns the new text and how many pre-tokens were encoded.  The text is put
    together once and the sums above the leaves are added up once, however many
    edits there are; what lies between two edits is neither cut nor encoded.
    """
    if not edits:
        return text, 0
    back, shift, parts, done = [], [0], [], 0
    for start, end, new in edits:
        at = max(0, start - CONTEXT)
        while at > 0 and text[at : at + 1].isspace():  # a pattern may look to the end of white space
            at -= 1
        back.append(at)
        shift.append(shift[-1] + len(new) - (end - start))
        parts += [text[done:start], new]
        done = end
    after = "".join([*parts, text[done:]])
    starts = np.concatenate([[0], np.cumsum(tree.chars[0])])
    leaves, total = len(tree.chars[0]), 0
    held_chars, held_tokens, kept, i, first = [], [], 0, 0, None
    while i < len(edits):
        leaf = min(int(np.searchsorted(starts, back[i], "right")) - 1, max(0, leaves - 1))
        first = leaf if first is None else first
        held_chars.append(tree.chars[0][kept:leaf])
        held_tokens.append(tree.tokens[0][kept:leaf])
        kept, chars, tokens, c, t, n = leaves, [], [], 0, 0, 0
        for m in counter.pattern.finditer(after, int(starts[leaf]) + shift[i]):
            piece = m[0]
            c, t, n = c + len(piece), t + counter.tokens(piece), n + 1
            while i + 1 < len(edits) and m.end() - shift[i + 1] > back[i + 1]:
                i += 1
            old = m.end() - shift[i + 1]
            met = leaves
            if old >= edits[i][1]:  # beyond the edit an old leaf's start that is a new boundary: from here on nothing differs
                at = int(np.searchsorted(starts, old))
                met = at if at < leaves and starts[at] == old else leaves
            if n % LEAF == 0 or met < leaves:
                chars.append(c)
                tokens.append(t)
                c = t = 0
            if met < leaves:
                kept = met
                break
        else:
            i = len(edits) - 1
        if c:
            chars.append(c)
            tokens.append(t)
        held_chars.append(np.array(chars, np.int64))
        held_tokens.append(np.array(tokens, np.int64))
        total, i = total + n, i + 1
    tree.chars[0] = np.concatenate([*held_chars, tree.chars[0][kept:]])
    tree.tokens[0] = np.concatenate([*held_tokens, tree.tokens[0][kept:]])
    tree._raise(min(first, max(0, len(tree.chars[0]) - 1)))
    return after, total


def edit(counter: Counter, tree: Tree, text: str, start: int, end: int, new: str) -> tuple[str, int]:
    """One edit: see ``apply_edits``."""
    return apply_edits(counter, tree, text, [(start, end, new)])


@lru_cache(None)
def _mask(which: tuple[int, ...]) -> regex.Pattern:
    return regex.compile("|".join(f"({MASKS[i][0]})" for i in which))


def masks(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, replacement)`` of all personal data and secrets in a text.

    The patterns are looked for together, those left out that the text cannot match.
    """
    which = tuple(i for i, need in enumerate(_NEEDS) if need.search(text))
    return [(m.start(), m.end(), MASKS[which[m.lastindex - 1]][1]) for m in _mask(which).finditer(text)] if which else []


TREE = "text string, chars array<int>, tokens array<int>, pieces long"


def build_trees(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, chars, tokens, pieces)``: every row of ``docs`` with the leaves of its tree, to be written and kept.

    Null and empty texts have no leaves and come back as they are; null ids and repeated rows stay; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(vocabulary, pattern)
        for b in trimmed(batches):
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                trees = [build(counter, t.as_py()) for t in part.column(1)]
                yield _batch(part.column(0), part.column(1), trees, [])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {TREE}")


def _batch(ids: pa.Array, texts: pa.Array, trees: list[Tree], more: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    lists = lambda name: pa.array([getattr(t, name)[0].astype(np.int32) for t in trees], pa.list_(pa.int32()))
    pieces = pa.array([t.pieces for t in trees], pa.int64())
    return pa.RecordBatch.from_arrays([ids, texts, lists("chars"), lists("tokens"), pieces, *(a for _, a in more)], ["doc_id", "text", "chars", "tokens", "pieces", *(n for n, _ in more)])


def edit_trees(trees: DataFrame, vocabulary: str, pattern: str, edits=masks, state: bool = True) -> DataFrame:
    """What ``build_trees`` made, as read from where it was written, after ``edits(text)``: only what these touch is encoded.

    With ``state`` the rows have the new texts and leaves, to be written for the next edits, and ``n_tokens``, ``n_edits``, ``n_encoded``,
    ``n_tokens_after``; without it the counts alone.  ``pieces`` is left as it was when the tree was built.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()
    names = ["n_tokens", "n_edits", "n_encoded", "n_tokens_after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(vocabulary, pattern)
        for whole in trimmed(batches):
            for i in range(0, len(whole), 256):
                b = whole.slice(i, 256)
                out, texts, after = np.zeros((len(b), 4), np.int64), [], []
                for k, (value, chars, tokens, pieces) in enumerate(zip(b.column(1), b.column(2), b.column(3), b.column(4))):
                    text = value.as_py()
                    todo = edits(text or "")
                    own = [x.values.to_numpy().astype(np.int64) for x in (chars, tokens)]
                    tree = Tree.of(*own, pieces.as_py())
                    out[k, :2] = tree.total, len(todo)
                    if todo:
                        text, out[k, 2] = apply_edits(counter, tree, text or "", todo)
                    out[k, 3] = tree.total
                    texts.append(text)
                    after.append(tree)
                counts = [(n, pa.array(out[:, j].copy())) for j, n in enumerate(names)]
                if state:
                    yield _batch(b.column(0), pa.array(texts, pa.string()), after, counts)
                else:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), *(a for _, a in counts)], ["doc_id", "pieces", *names])

    counts = ", ".join(f"{n} long" for n in names)
    return trees.select("doc_id", "text", "chars", "tokens", "pieces").mapInArrow(run, f"doc_id {kind}, {TREE + ', ' if state else 'pieces long, '}{counts}")


def counts_after_edits(docs: DataFrame, vocabulary: str, pattern: str, edits=masks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_edits, n_pretokens, n_encoded, n_tokens_after)`` for every row of ``docs``.

    Trees are built and written to the shared folder, read again and edited.
    ``edits(text)`` returns ``(start, end, replacement)`` that do not overlap, in ascending
    order.  ``n_pretokens``: pre-tokens of the text as it
    was; ``n_encoded``: those that the edits made necessary to encode.  Null
    and empty texts count 0; null ids and repeated rows stay; an empty table
    gives no rows; other columns are ignored.
    """
    kept = written(build_trees(docs, vocabulary, pattern, id_col, text_col), "trees")
    return edit_trees(kept, vocabulary, pattern, edits, state=False).withColumnRenamed("pieces", "n_pretokens")
