"""Shared pieces of the text operators: scratch tables, word hashing, hash exchanges.

Every operator reads only the columns it names, so extra columns of any name are ignored.
A null doc_id is carried as the smallest long and turned back into null on the way out;
a null text counts as the empty text.  Rows that share a doc_id are versions of one document.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import Scratch, settings  # noqa: F401  the operators take them from here

NULL_ID = -(2**63)
#: Rows that `marked` hands on at once.
MARKED_ROWS = 1000
#: Input bytes that one hash bucket is meant to hold, and the most shuffle partitions that buckets are dealt to.
BUCKET_BYTES, MAX_TASKS = 16 << 20, 60_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_in(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_out(name: str = "doc_id") -> Column:
    return F.when(F.col(name) == F.lit(NULL_ID), None).otherwise(F.col(name))


def keyed_columns() -> list[Column]:
    return [id_in().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without nulls."""
    return docs.select(*keyed_columns())


def crc_mod(mod: int) -> Column:
    """crc32 of the doc_id as text, modulo `mod`; a null doc_id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def buckets_for(docs: DataFrame, per: int = BUCKET_BYTES) -> int:
    """Hash buckets for work over all of `docs`: follows its size, at least the session's shuffle partitions.

    The plan knows the size of what it reads from files; else the bytes of the texts are counted.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per))


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, or with underscores before it until no column of `frames` is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ranked(df: DataFrame, by: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """`df`, whose rows differ in `by`, with their rank (from 0) in that order.

    A range sort numbers the rows of each partition; only one row a partition meets in one task.
    """
    df = scratch.write(df.repartitionByRange(*by).withColumn("pid", F.spark_partition_id()), "ranked")
    sizes = df.groupBy("pid").count().withColumn("before", F.sum("count").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("pid").orderBy(*by)) - 1
    return df.withColumn("own", own).join(sizes.select("pid", F.coalesce("before", F.lit(0)).alias("before")), "pid").withColumn(name, F.col("own") + F.col("before")).drop("pid", "own", "before")


# --- words ------------------------------------------------------------------------------------


def text_bytes(column) -> list[bytes]:
    """UTF-8 of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((BASE, _INV)):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the Rabin-Karp polynomial over 64-bit symbols, modulo 2^64."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def window_hash(prefix: np.ndarray, starts: np.ndarray, length) -> np.ndarray:
    """Hash of the windows of `length` symbols at `starts`; equal windows hash alike anywhere."""
    _, down = _powers(len(prefix))
    return mix((prefix[starts + length] - prefix[starts]) * down[starts])


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_LOWER = _SYMBOL.copy()  # A-Z as a-z
_LOWER[65:91] = _SYMBOL[97:123]
#: Words whose bytes are hashed at once.
SLICE_WORDS = 250_000


def byte_prefix(raw: np.ndarray) -> np.ndarray:
    """`rolling` over bytes."""
    return rolling(_SYMBOL[raw])


def slices(column, size: int = 1 << 20):
    """Runs of an Arrow string column of about `size` bytes, one text at least."""
    import pyarrow.compute as pc

    ends, a = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield column.slice(a, b - a)
        a = b


def word_hashes(column, lower: bool, classes: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the words of an Arrow string column, text after text, and the words of each text.

    With `classes`, a byte for each byte, also the hashes of the words' shapes: their bytes' classes, runs of one
    class taken as one.  Words are runs without ASCII white space; a null text has none.  All in array operations: no Python
    object a word.  Memory beside the result follows SLICE_WORDS, also within one long text.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(column)
    bounds = lists.offsets.to_numpy()
    flat = lists.flatten()
    spans = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    size = np.diff(spans)
    real = size > 0  # leading and trailing white space leaves empty words
    out, table = np.empty(len(size), np.uint64), _LOWER if lower else _SYMBOL
    shapes = None if classes is None else np.empty(len(size), np.uint64)
    for a in range(0, len(size), SLICE_WORDS):
        s = spans[a : a + SLICE_WORDS + 1] - spans[a]
        prefix = rolling(table[raw[spans[a] : spans[a] + s[-1]]])
        n = s[1:] - s[:-1]
        out[a : a + len(n)] = window_hash(prefix, s[:-1], n) + n.astype(np.uint64)
        if shapes is not None:
            kind = classes[raw[spans[a] : spans[a] + s[-1]]]
            first = np.ones(len(kind), bool)
            first[1:] = kind[1:] != kind[:-1]
            first[s[:-1][n > 0]] = True
            ends = np.concatenate([[0], np.cumsum(first)])[s]
            n = ends[1:] - ends[:-1]
            shapes[a : a + len(n)] = window_hash(rolling(_SYMBOL[kind[first]]), ends[:-1], n) + n.astype(np.uint64)
    before = np.concatenate([[0], np.cumsum(real)])
    at = bounds - bounds[0]
    counts = before[at[1:]] - before[at[:-1]]
    return (out[real], counts) if shapes is None else (out[real], counts, shapes[real])


# --- exchanges --------------------------------------------------------------------------------


def bucket_column(name: str, n: int) -> Column:
    x = F.col(name)
    y = x.bitwiseXOR(F.shiftrightunsigned(x, 9)).bitwiseXOR(F.shiftrightunsigned(x, 21)).bitwiseXOR(F.shiftrightunsigned(x, 37))
    return F.pmod(y, F.lit(n)).cast("int")


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """bucket_column for an int64 array."""
    x = ids.astype(np.int64).view(np.uint64)
    y = x ^ (x >> np.uint64(9)) ^ (x >> np.uint64(21)) ^ (x >> np.uint64(37))
    return np.mod(y.view(np.int64), n).astype(np.int32)


def planes(a: np.ndarray) -> bytes:
    """Bytes of `a`, all first bytes first: small deltas become long runs for the shuffle's codec."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(raw: memoryview, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).reshape(n)


PACKED = "part int, n int, payload binary"
#: Packed rows on their way to a hash bucket.  kind 0: entries; 1: entries whose hash stands in their chunk more
#: than once and that stand for the others; 2: marks, which only pass through, to the document bucket `part`.
EXCHANGE = PACKED + ", kind int"


def chunk(kind: int, packed):
    """Packed rows with their kind."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*packed.columns, pa.array([kind] * packed.num_rows, pa.int32())], names=[*packed.schema.names, "kind"])


def entry_buckets(batches):
    """For the partitions of dealt EXCHANGE rows: (marks, None) as they come, (None, (docs, starts, prints, kind)) a bucket."""
    import pyarrow.compute as pc

    now, got = None, []
    for batch in batches:
        passing = pc.equal(batch.column("kind"), 2)
        marks = batch.select(["part", "n", "payload"]).filter(passing)
        if marks.num_rows:
            yield marks, None
        for part, n, p, kind in zip(*[pc.filter(batch.column(c), pc.invert(passing)).to_pylist() for c in ("part", "n", "payload", "kind")], strict=True):
            if got and part != now:
                yield None, _joined(got)
            now = part
            got.append((*unpack(n, p, True), np.full(n, kind, np.int8)))
    if got:
        yield None, _joined(got)


def stretches(keys: np.ndarray):
    """(key, first, end) of every stretch of equal neighbours."""
    if len(keys):
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        yield from zip(keys[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True)


def pack(part: np.ndarray, n_parts: int, docs: np.ndarray, starts: np.ndarray, prints: np.ndarray | None = None):
    """One row per bucket: (doc, start[, fingerprint]) of its entries, in the given order."""
    import pyarrow as pa

    order = np.argsort(part.astype(np.uint16) if n_parts <= 1 << 16 else part, kind="stable")  # radix up to 16 bits
    part, docs, starts = part[order], docs[order], starts[order].astype(np.uint32)
    if prints is not None:
        prints = prints[order]
    numbers, counts, blobs = [], [], []
    for p, a, b in stretches(part):
        d = docs[a:b].copy()
        d[1:] -= docs[a : b - 1]
        blobs.append(b"".join([planes(d), planes(starts[a:b])] + ([prints[a:b].tobytes()] if prints is not None else [])))
        numbers.append(p)
        counts.append(b - a)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "n", "payload"])


def unpack(n: int, payload, prints: bool):
    raw = memoryview(payload)
    docs = np.cumsum(unplanes(raw, n, np.int64))
    starts = unplanes(raw[8 * n :], n, np.uint32)
    return (docs, starts, np.frombuffer(raw[12 * n :], np.uint64)) if prints else (docs, starts)


def dealt(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """`rows` dealt out by bucket (`part`, below n), buckets one after the other in each shuffle partition.

    Tasks work through their buckets one at a time, so their memory follows a bucket, not a partition.
    """
    tasks = min(n, MAX_TASKS)
    out = rows.repartitionById(tasks, F.pmod("part", F.lit(tasks)))
    return out.sortWithinPartitions("part", *order) if order or tasks < n else out


def _joined(got: list) -> tuple:
    out = tuple(np.concatenate(x) for x in zip(*got, strict=True))
    got.clear()
    return out


def with_marks(docs: DataFrame, marks: DataFrame, n: int) -> DataFrame:
    """Deal packed marks and the texts out by document, marks first in each bucket.

    docs: keyed, further columns stay.  Result: part, n, payload (marks), then the documents' columns.
    """
    extra = [c for c in docs.columns]
    left = marks.select("part", "n", "payload", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in extra])
    right = docs.select(bucket_column("doc_id", n).alias("part"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("payload"), *extra)
    return dealt(left.unionByName(right), n, F.col("n").asc_nulls_last())


def marked(batches):
    """For the partitions of with_marks: yields (batch of documents, function doc_id -> mark starts)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    now, got_d, got_s, index = None, [], [], None
    for batch in (whole.slice(a, MARKED_ROWS) for whole in batches for a in range(0, whole.num_rows, MARKED_ROWS)):
        for part, first, end in stretches(batch.column("part").to_numpy()):
            if part != now:
                now, got_d, got_s, index = part, [], [], None
            piece = batch.slice(first, end - first)
            is_mark = pc.is_valid(piece.column("n"))
            for n, p in zip(pc.filter(piece.column("n"), is_mark).to_pylist(), pc.filter(piece.column("payload"), is_mark).to_pylist(), strict=True):
                d, s = unpack(n, p, False)
                got_d.append(d)
                got_s.append(s)
            rows = pa.Table.from_batches([piece]).filter(pc.invert(is_mark)).combine_chunks().to_batches()
            if not rows:
                continue
            if index is None:
                d = np.concatenate(got_d) if got_d else np.zeros(0, np.int64)
                s = np.concatenate(got_s) if got_s else np.zeros(0, np.uint32)
                order = np.argsort(d, kind="stable")
                index = d[order], s[order]
                got_d, got_s = [], []
            for r in rows:
                if r.num_rows:
                    ids = r.column("doc_id").to_numpy(zero_copy_only=False)
                    lo, hi = np.searchsorted(index[0], ids), np.searchsorted(index[0], ids, side="right")
                    yield r, [index[1][a:b].astype(np.int64) for a, b in zip(lo, hi, strict=True)]


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Boolean mask of the n places covered by windows of `length` at `starts`."""
    starts = starts[starts + length <= n]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, starts + length, 1)
    return np.cumsum(step[:-1]) > 0
