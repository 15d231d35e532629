"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased with runs of white space as one space.  A test item is taken in passages:
itself and, if it has more than `PASSAGE` words, every window of that many words, so that a part of an
item is caught too.  A passage of n characters may differ by k = floor(n * RATE) edits; of its k + 1
pieces at least one must then occur unchanged.  An automaton finds all pieces in one pass over the text;
each hit is verified by Myers' bit-parallel distance around its diagonal.

The test items are taken in blocks of bounded size, each against all documents.

Defined cases: null or empty text, null or empty item: no match; items under `MIN_WORDS` words match only
unchanged and as whole words (no edits); equal items each get their rows; rows that share a doc_id are versions
of one document; a null doc_id or item_id is reported as null; extra columns are ignored.
"""

from __future__ import annotations

import os

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_in, id_out

PASSAGE, MIN_WORDS = 16, 5
RATE = 0.05
#: Characters of test items that are matched in one pass; each stands in up to PASSAGE windows.
BLOCK_CHARS = 500_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def passages(item: str) -> list[str]:
    words = plain(item).split(" ")
    if len(words) < MIN_WORDS:
        return [f" {' '.join(words)} "] if words[0] else []
    if len(words) <= PASSAGE:
        return [" ".join(words)]
    return [" ".join(words), *(" ".join(words[a : a + PASSAGE]) for a in range(len(words) - PASSAGE + 1))]


def pieces(passage: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 nearly equal pieces."""
    cuts = [len(passage) * j // (k + 1) for j in range(k + 2)]
    return [(a, passage[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def peq(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for j, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << j
    return masks


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of `text`, and where that substring ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, at
    return best, end


def nearest_whole(a: str, b: str, most: int | None = None) -> int:
    """Edit distance of two whole texts, bit-parallel; with `most`, some number above it where the distance is.

    Where they agree at their ends nothing is compared.  With `most`, only the diagonals that far from the middle one are
    walked; the distance never falls along the last cell's diagonal, which ends it early.
    """
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return max(len(a), len(b))
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    if most is not None and 2 * most + 1 < len(a):
        return _banded(a, b, most)
    masks, m = peq(a), len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in b:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
    return score


def _banded(a: str, b: str, most: int) -> int:
    """Edit distance up to `most`, at least the difference of the lengths; bit i stands for row (column - most + i)."""
    masks = {c: x << most for c, x in peq(a).items()}
    full, up, down = (1 << 2 * most + 1) - 1, (1 << most + 1) - 1 << most, 0
    off = len(a) - len(b)
    cell, score = 1 << most + off, abs(off)
    for j, c in enumerate(b):
        eq = masks.get(c, 0) >> j & full
        d = ((eq & up) + up ^ up | eq | down) & full
        if not d & cell and j >= -off:
            score += 1
            if score > most:
                return score
        ph, mh = down | full ^ (d | up), d & up
        d >>= 1
        up, down = mh | full ^ (d | ph), d & ph
    return score


class Matcher:
    """All passages of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.parts: list[tuple[str, int, list[int]]] = []
        seen: dict[str, int] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            for p in passages(text):
                if p in seen:
                    if item not in self.parts[seen[p]][2]:
                        self.parts[seen[p]][2].append(item)
                    continue
                seen[p] = len(self.parts)
                k = 0 if p[0] == " " else int(len(p) * rate)
                for off, piece in pieces(p, k):
                    found.setdefault(piece, []).append((len(self.parts), off))
                self.parts.append((p, k, [item]))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()
        self.empty = not found
        self.masks: dict[int, dict[str, int]] = {}

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(passage number, distance, end in the plain text with a space around it), one for each matching passage."""
        text = f" {plain(text)} "
        if self.empty:
            return []
        best: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.auto.iter(text):
            for part, off in where:
                p, k, _ = self.parts[part]
                start = end + 1 - size - off
                if part in best and best[part][0] == 0 or (part, start) in tried:
                    continue
                tried.add((part, start))
                if text.startswith(p, max(start, 0)) and start >= 0:
                    best[part] = (0, start + len(p))
                    continue
                if part not in self.masks:
                    self.masks[part] = peq(p)
                lo = max(0, start - k)
                d, at = nearest(self.masks[part], len(p), text[lo : start + len(p) + k])
                if d <= k and (part not in best or d < best[part][0]):
                    best[part] = (d, lo + at)
        return [(part, d, at) for part, (d, at) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[int, str]]]:
    items = benchmark.where("text is not null").select(id_in("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_chars) or 1
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield sorted((r["item_id"], r["text"]) for r in rows)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document and test item that share a passage: doc_id, item_id, n_passages matched, distance (least)."""
    import pyarrow as pa

    spark, out = docs.sparkSession, None
    body = docs.where("text is not null").select(id_in().alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in _blocks(benchmark, block_chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            m = Matcher(held.value, rate)
            for batch in batches:
                got = []
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    for part, d, _ in m.matches(t.as_py()):
                        got += [(i, item, part, d) for item in m.parts[part][2]]
                cols = list(zip(*got, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "passage", "distance"])

        one = body.mapInArrow(run, "doc_id long, item_id long, passage long, distance long")
        out = one if out is None else out.unionByName(one)
    got = out.groupBy("doc_id", "item_id").agg(F.count_distinct("passage").alias("n_passages"), F.min("distance").alias("distance"))
    return got.select(id_out().alias("doc_id"), id_out("item_id").alias("item_id"), "n_passages", "distance")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs`, all columns, without the documents that hold a passage of the benchmark.

    Rows that share a doc_id go or stay together, also those with a null one; rows without text stay otherwise.
    """
    name = fresh("leaked", docs)
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
