"""Repeated passages and lines against brute force over words."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from filigree.llm import queries, substring
from filigree.llm.decontam import WORD
from test_documents import docs, words


def plain_passages(rows, min_words):
    """Character spans of the words in a window or a line that occurs earlier, by word tuples."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh3_64_intdigest(r[1] or "") ^ 1 << 63) - (1 << 63)))
    seen, lines, out = {}, set(), []
    for d, t in order:
        marks, spans = [m.span() for m in re.finditer(WORD, t or "")], []
        low = [t[a:b].lower() for a, b in marks]
        for s in range(len(low) - min_words + 1):
            first = seen.setdefault(tuple(low[s : s + min_words]), (d, t, s))
            if first[:2] != (d, t) or s >= first[2] + min_words:
                spans.append((s, s + min_words, marks[s][0], marks[s + min_words - 1][1]))
        for m in re.finditer(r"[^\n]+", t or ""):
            held = [i for i, (a, _) in enumerate(marks) if m.start() <= a < m.end()]
            line = tuple(low[i] for i in held)
            if held and line in lines:
                spans.append((held[0], held[-1] + 1, m.start(), m.end()))
            lines.add(line)
        runs = []
        for s, e, a, b in sorted(spans):
            if runs and s <= runs[-1][1]:
                old = runs[-1]
                runs[-1] = (old[0], max(old[1], e), min(old[2], a), max(old[3], b))
            else:
                runs.append((s, e, a, b))
        out += [str((d, a, b, e - s)) for s, e, a, b in runs]
    return sorted(out)


def test_passages_between_any_words(spark):
    """Long clauses whose ends differ, passages inside lines, text that repeats itself."""
    rng = random.Random(11)
    plain = [words(rng, rng.randint(50, 90)) for _ in range(6)]
    rows = [(None, plain[0]), (5, None), (6, ""), (7, " .,;\n"), (8, plain[1]), (8, plain[1]), (9, "der " * 300), (9, plain[2].upper())]
    for d in range(20, 70):
        text = [words(rng, rng.randint(1, 40)) for _ in range(8)]
        text.insert(rng.randrange(8), f"Été {words(rng, 20)}, {rng.choice(plain)} {words(rng, 14)}")
        rows.append((d, ".\n".join(text)))
    rows.append((90, rows[-1][1]))
    got = sorted(str((r["doc_id"], r["start"], r["end"], r["n_words"])) for r in substring.passages(docs(spark, rows)).collect())
    assert got == plain_passages(rows, 50) and len(got) > 40
    assert substring.passages(docs(spark, [])).count() == 0


def test_query_finds_a_passage_without_whole_clauses(spark, tmp_path):
    """Of 59 words, 25 and 14 stand in clauses that differ at their other end."""
    rng = random.Random(12)
    text = words(rng, 25) + ", " + words(rng, 20) + ". " + words(rng, 14)
    docs(spark, [(1, "one " + text + " two."), (2, "three " + text + " four.")]).write.parquet(f"{tmp_path}/documents.parquet")
    (found,) = queries.op9_repeated_passages(spark, str(tmp_path)).collect()
    assert (found["doc_id"], found["start"], found["end"], found["n_words"]) == (2, 6, 6 + len(text), 59)


def test_query_finds_a_repeated_line(spark, tmp_path):
    """A line under 35 words between lines that differ."""
    docs(spark, [(1, "alpha\nthe same line of eight words here\nbeta"), (2, "gamma\nThe same line of eight words here\ndelta")]).write.parquet(f"{tmp_path}/documents.parquet")
    (found,) = queries.op9_repeated_passages(spark, str(tmp_path)).collect()
    assert (found["doc_id"], found["start"], found["end"], found["n_words"], found["first_doc_id"]) == (2, 6, 39, 7, 1)


def test_a_phrase_repeated_in_many_texts_is_compared_by_stretches(spark, monkeypatch):
    """The rows compared do not follow the words of the repetition, and all of it is given but its first occurrence."""
    rng, compared = random.Random(13), []
    later = substring._later
    monkeypatch.setattr(substring, "_later", lambda every, *total: compared.append(every.count()) or later(every, *total))
    rows = [(d if d else None, f"{words(rng, rng.randint(1, 20))}\n{words(rng, 3)} " + "Is onhe. " * rng.randint(500, 700)) for d in range(100)]
    got = sorted(str((r["doc_id"], r["start"], r["end"], r["n_words"])) for r in substring.passages(docs(spark, rows)).collect())
    assert got == plain_passages(rows, 50) and len(got) >= 100
    assert compared[0] < 20_000  # of 120,000 windows or so


def test_stretches_kept_whole_give_the_rows_of_their_windows(spark, monkeypatch):
    """Texts that share, overlap and repeat passages, each stretch that occurs twice taken for a frequent one."""
    rng = random.Random(14)
    parts = [words(rng, rng.randint(10, 60)) for _ in range(5)] + ["is onhe " * 40, "der " * 90]
    rows = [(d // 2 if d else None, " ".join(rng.choice([words(rng, 5), *parts]) for _ in range(8)) + "\n" + rng.choice(parts)) for d in range(80)]
    plain = substring._frequent
    found = []
    for most in (10**9, 2):
        again = lambda every, digest, total, most=most: plain(every, digest, total) if digest == "_digest" else [r[0] for r in every.groupBy(digest).count().where(F.col("count") >= most).collect()]
        monkeypatch.setattr(substring, "_frequent", again)
        found.append(sorted(substring.passages(docs(spark, rows), min_words=20).collect(), key=str))
    assert found[0] == found[1] and any(r["n_units"] > 50 for r in found[0])
    assert sorted(str((r["doc_id"], r["start"], r["end"], r["n_words"])) for r in found[1]) == plain_passages(rows, 20)


def test_stretches_end_with_their_gram_or_at_a_gap():
    least = np.array([7] * 3 + [9] * 70 + [5, 5, 5, 5], np.uint64)
    at = np.array([*range(75), 76])
    assert substring.stretches(at, least).tolist() == [0, 3, 35, 67, 73, 75]
    assert substring.stretches(at[:0], least[:0]).tolist() == []
