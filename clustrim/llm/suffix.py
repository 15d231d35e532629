"""Suffix-array dedup over bytes: distributed prefix doubling on suffixes that the text picks.

Ranking every byte position would move at least 8 bytes a position and round, some 13 times the input
before the first doubling.  Instead a text picks its own suffixes, its anchors: each window of SPREAD
positions picks the place of its least GRAM-byte hash (the first of equals), so equal strings pick equal
places, about one in SPREAD / 2 bytes.  The windows of `length` bytes that pick one anchor are a run.

1. The first rank of an anchor is the name of its SPREAD + GRAM bytes, which every window of its run
   holds.  Suffixes with a unique rank are done: their windows repeat nowhere.
2. Doubling: rank t covers 2^t anchors.  Spark pairs it with the rank 2^t anchors on, sorts the repeated
   pairs and reranks.  A suffix leaves when its pair is unique or past the threshold, that is longer than
   any run with its windows; rounds go on while any suffix is left.
3. A run with its windows is the string over c anchors: the pair of its rank t and the rank t of the anchor
   c - 2^t on, with 2^t <= c < 2^(t+1).  Runs with a repeated pair repeat in full.
4. Other runs may repeat in part, at the ends of a longer repeat.  They, and one run of each repeated
   pair beside them, are opened: single windows go by their names through hash buckets.  Windows that repeat
   within the task that names them are marked at once and one of each goes on, so a bucket never holds a window
   more often than there are chunks of CHUNK_WINDOWS.
5. Marks travel back packed by document and merge into maximal runs.

Why this is exact.  Equal windows have the same anchor place, so equal first ranks, and are compared in
3 or 4.  From an anchor on, the next one depends only on the SPREAD + GRAM bytes behind it, so equal pairs
mean equal strings.  One run never repeats itself: equal windows pick equal places in themselves.

Defined cases: null or empty text: no bytes, no spans; shorter than `length`: nothing removed; rows that
share a doc_id but not the text are documents of their own; rows equal in both are one document, each
returned; a null doc_id is one more document; extra columns are ignored.  Names of strings have 64 bits: two
different strings share one with probability 2^-64 a pair.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import EXCHANGE, PACKED, Scratch, bucket_of, buckets_for, byte_prefix, chunk, covered, dealt, entry_buckets, marked, pack, ranked, settings, text_bytes, window_hash, with_marks

GRAM = 16
#: Bytes of text whose anchors are found at once, and positions hashed at once within a longer text.
FLUSH_BYTES, SEGMENT = 1 << 20, 1 << 20
CHUNK_WINDOWS = 1_000_000


class Geometry:
    def __init__(self, length: int):
        self.length = length
        self.gram = min(GRAM, max(1, length // 8))
        #: Positions that pick one anchor; an anchor's first rank then ends within each of its windows.
        self.spread = (length - self.gram) // 2
        self.tail = self.spread + self.gram
        #: No run with its windows is longer.
        self.most = length + 2 * self.spread


def picks(raw: np.ndarray, ends: np.ndarray, g: Geometry):
    """Anchors of the texts that end at `ends` in `raw`: first position that picks it, place, name, left name."""
    out, bad = [], g.spread + g.gram - 2
    for a in range(0, len(raw), SEGMENT):
        b = min(a + SEGMENT, len(raw) - bad)
        if b <= a:
            break
        prefix = byte_prefix(raw[a : b + g.spread + g.tail])
        grams = window_hash(prefix, np.arange(b - a + g.spread - 1), g.gram)
        low = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= g.spread:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = g.spread - width
        low = np.minimum(low[: len(low) - rest], low[rest:])
        valid = np.ones(b - a, bool)
        for e in ends[np.searchsorted(ends, a) : np.searchsorted(ends, b + bad, side="right") + 1].tolist():
            valid[max(0, e - bad - a) : max(0, e - a)] = False
        q = np.flatnonzero(valid)
        place = (low[q] & np.uint64(0xFFFFFF)).astype(np.int64)
        new = np.ones(len(q), bool)
        new[1:] = place[1:] != place[:-1]
        q, place = q[new], place[new]
        if len(q):
            end = ends[np.searchsorted(ends, q + a, side="right")] - a
            size = np.minimum(g.tail, end - place)
            name = window_hash(prefix, place, size) + size.astype(np.uint64)
            left = window_hash(prefix, q, place - q) + (place - q).astype(np.uint64)
            out.append((q + a, place + a, name, left))
    first, place, name, left = (np.concatenate(x) for x in zip(*out, strict=True))
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]  # a segment may begin within a run
    return first[new], place[new], name[new], left[new]


_ANCHORS = "key long, j int, p int, f int, n int, c int, inner int, name long, left long"


def _anchors(g: Geometry):
    """key, text -> anchors: number j in the text, place p, windows f .. f + n - 1, anchors c of a run with its windows, anchors `inner` within each window."""
    import pyarrow as pa

    def rows(keys, texts):
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        f, p, name, left = picks(raw, ends, g)
        text = np.searchsorted(ends, f, side="right")
        begin, end = (ends - size)[text], ends[text]
        lead = np.searchsorted(text, text)
        here = np.arange(len(f))
        until = np.minimum(np.append(f[1:], len(raw)), end - g.length + 1)
        n = np.maximum(until - f, 0)
        c = np.maximum(np.searchsorted(p, f + n + g.length - 1 - g.tail) - here + 1, 1)
        inner = np.searchsorted(p, f + g.length - g.tail, side="right") - here
        real = n > 0
        ints = [here - lead, p - begin, f - begin, n, np.where(real, c, 0), np.where(real, inner, 0)]
        arrays = [pa.array(np.array(keys, np.int64)[text]), *[pa.array(x.astype(np.int32)) for x in ints], pa.array(name.view(np.int64)), pa.array(left.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _ANCHORS.split(", ")])

    def run(batches):
        keys, texts, held = [], [], 0
        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text")), strict=True):
                if len(t) >= g.length:
                    keys.append(k)
                    texts.append(t)
                    held += len(t)
                    if held >= FLUSH_BYTES:
                        yield rows(keys, texts)
                        keys, texts, held = [], [], 0
        if keys:
            yield rows(keys, texts)

    return run


def _windows(length: int, n_parts: int):
    """Texts with the runs to open -> packed (key, start, name) of their single windows; repeats in a chunk as marks."""

    def run(batches):
        def flush():
            keys, starts, prints = (np.concatenate(x) for x in held)
            order = np.argsort(prints)
            p = prints[order]
            same = p[1:] == p[:-1]
            head = np.append(True, ~same)
            twin = np.append(False, same) | np.append(same, False)
            part = lambda x: ((x >> np.uint64(24)) % np.uint64(n_parts)).astype(np.int64)
            lone, lead, more = order[~twin], order[twin & head], order[twin]
            more.sort()
            if len(lone):
                yield chunk(0, pack(part(prints[lone]), n_parts, keys[lone], starts[lone], prints[lone]))
            if len(more):
                yield chunk(1, pack(part(prints[lead]), n_parts, keys[lead], starts[lead], prints[lead]))
                yield chunk(2, pack(bucket_of(keys[more], n_parts), n_parts, keys[more], starts[more]))

        held, size = [[], [], []], 0
        for batch in batches:
            for k, t, f, n in zip(batch.column("key").to_pylist(), text_bytes(batch.column("text")), batch.column("starts").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                raw = np.frombuffer(t, np.uint8)
                f, n = np.array(f, np.int64), np.array(n, np.int64)
                order = np.argsort(f)
                f, n = f[order], n[order]
                for a in range(0, len(raw), SEGMENT):
                    lo, hi = np.searchsorted(f, [a, a + SEGMENT])
                    if lo == hi:
                        continue
                    base, m = int(f[lo]), n[lo:hi]
                    at = np.repeat(f[lo:hi] - base - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    prefix = byte_prefix(raw[base : base + int(at[-1]) + length])
                    for x, y in zip(held, (np.full(len(at), k, np.int64), at + base, window_hash(prefix, at, length)), strict=True):
                        x.append(y)
                    size += len(at)
                    if size >= CHUNK_WINDOWS:
                        yield from flush()
                        held, size = [[], [], []], 0
        if size:
            yield from flush()

    return run


def _repeated(n_buckets: int):
    """Marks of the windows whose name stands at two places; those that repeat in their chunk are marked already."""

    def run(batches):
        for marks, got in entry_buckets(batches):
            if marks is not None:
                yield marks
                continue
            keys, starts, prints, kind = got
            order = np.argsort(prints)
            p = prints[order]
            same = p[1:] == p[:-1]
            keep = order[np.append(False, same) | np.append(same, False)]
            keep = keep[kind[keep] == 0]
            if len(keep):
                keep = keep[np.lexsort((starts[keep], keys[keep]))]
                yield pack(bucket_of(keys[keep], n_buckets), n_buckets, keys[keep], starts[keep])

    return run


def ranks_by_doubling(first: DataFrame, g: Geometry, scratch: Scratch) -> list[DataFrame]:
    """Tables (key, j, p, reach, rank) of rank 0, 1, 2, ...; a suffix is in table t while its rank t repeats."""
    levels = [first]
    while True:
        step = 1 << len(levels) - 1
        ahead = Window.partitionBy("key").orderBy("j").rangeBetween(step, step)
        pairs = levels[-1].select("key", "j", "p", "rank", F.first("rank").over(ahead).alias("next"), F.first("reach").over(ahead).alias("reach"))
        pairs = scratch.write(pairs.where(F.col("next").isNotNull() & (F.col("reach") - F.col("p") <= g.most)), "pairs")
        repeated = pairs.groupBy("rank", "next").agg(F.count("*").alias("k")).where("k > 1").select("rank", "next")
        order = ranked(repeated, ["rank", "next"], scratch, "new")
        new = scratch.write(pairs.join(order, ["rank", "next"]).select("key", "j", "p", "reach", F.col("new").alias("rank")), f"rank{len(levels)}")
        scratch.drop("pairs", "ranked")
        if new.isEmpty():
            return levels
        levels.append(new)


def _named(ranks: DataFrame, rows: DataFrame, count: str) -> DataFrame:
    """`rows` (key, j, ...) with r1, r2: the ranks that together name the `count` anchors from j on, where both repeat.

    ranks: (key, j, t, rank).  Both joins stay within the partitions by key of one exchange of either side.
    """
    rows = rows.withColumn("t", F.floor(F.log2(F.col(count) + 0.5)).cast("int")).withColumn("at", F.expr(f"j + {count} - shiftleft(1, t)"))
    ranks = ranks.repartition("key")
    r1, r2 = ranks.withColumnRenamed("rank", "r1"), ranks.select("key", F.col("j").alias("at"), "t", F.col("rank").alias("r2"))
    return rows.repartition("key").join(r1, ["key", "j", "t"]).join(r2, ["key", "at", "t"]).drop("at", "t")


def repeat_marks(docs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """docs: key, text.  Runs that repeat in full (key, f, n), packed single repeated starts, bucket count."""
    n, g = buckets_for(docs), Geometry(length)
    anchors = scratch.write(docs.mapInArrow(_anchors(g), _ANCHORS), "anchors")
    # aggregates are written before they are joined back: a join of two plain exchanges can split a hot rank
    seen = scratch.write(anchors.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name"), "seen")
    base = anchors.join(seen, "name")
    if not docs.groupBy("key").count().where("count > 1").isEmpty():  # equal rows
        base = base.dropDuplicates(["key", "j"])
    base = scratch.write(base, "base")
    scratch.drop("anchors", "seen")
    levels = ranks_by_doubling(base.select("key", "j", "p", (F.col("p") + g.tail).alias("reach"), F.col("name").alias("rank")), g, scratch)

    ranks = functools.reduce(DataFrame.unionByName, [x.select("key", "j", F.lit(t).alias("t"), "rank") for t, x in enumerate(levels)])
    runs = base.where("n > 0").select("key", "j", "f", "n", "c", "inner", "name", "left")
    with settings(docs.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        whole = scratch.write(_named(ranks, runs.drop("inner"), "c"), "whole")
    kind = ["name", "c", "left", "r1", "r2"]
    classes = whole.groupBy(*kind).agg(F.count("*").alias("k"), F.min(F.struct("key", "f", "n")).alias("one")).where("k > 1")
    classes = scratch.write(classes.drop("k"), "classes")
    full = scratch.write(whole.join(classes.drop("one"), kind).select("key", "j", "f", "n"), "full")
    scratch.drop("whole")

    with settings(docs.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        part = _named(ranks, runs.join(full.select("key", "j"), ["key", "j"], "left_anti"), "inner")
        part = scratch.write(part.select("key", "f", "n", "name"), "part")
    groups = part.select("name", F.lit(1).alias("u"), F.lit(0).alias("v")).unionByName(classes.select("name", F.lit(0).alias("u"), F.lit(1).alias("v")))
    groups = groups.groupBy("name").agg(F.sum("u").alias("u"), F.sum("v").alias("v")).where("u > 0 and u + v > 1").select("name")
    groups = scratch.write(groups, "groups")
    beside = part.unionByName(classes.select("one.key", "one.f", "one.n", "name")).join(groups, "name")
    beside = scratch.write(beside.groupBy("key").agg(F.collect_list("f").alias("starts"), F.collect_list("n").alias("counts")), "open")
    scratch.drop("base", "part", "classes", "groups", *[f"rank{t}" for t in range(1, len(levels))])
    single = docs.join(beside, "key").dropDuplicates(["key"]).mapInArrow(_windows(length, n), EXCHANGE)
    single = scratch.write(dealt(single, n).mapInArrow(_repeated(n), PACKED), "single")
    return full.drop("j"), single, n


def _pack_runs(n_buckets: int):
    """Runs -> packed marks: the starts of all windows of a run."""

    def run(batches):
        for batch in batches:
            d = batch.column("key").to_numpy(zero_copy_only=False)
            s = batch.column("f").to_numpy(zero_copy_only=False)
            c = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            step = max(1, int(CHUNK_WINDOWS // max(1, c.max(initial=1))))
            for a in range(0, len(d), step):
                k = c[a : a + step]
                local = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                docs = np.repeat(d[a : a + step], k)
                yield pack(bucket_of(docs, n_buckets), n_buckets, docs, np.repeat(s[a : a + step], k) + local)

    return run


def digest(docs: DataFrame, length: int = 400) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that remain."""
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"), F.col("doc_id").cast("long").alias("real"), text.alias("text"))
    full, single, n = repeat_marks(rows.select("key", "text"), length, scratch)
    marks = single.unionByName(full.mapInArrow(_pack_runs(n), PACKED))

    def run(batches):
        for rows, starts in marked(batches):
            out = []
            for t, s in zip(text_bytes(rows.column("text")), starts, strict=True):
                gone = spans = 0
                kept = t
                if len(s):
                    mask = covered(len(t), np.unique(s), length)
                    gone = int(mask.sum())
                    spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
                out.append((len(t), gone, spans, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column("real"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_marks(rows.withColumnRenamed("key", "doc_id"), marks, n).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
