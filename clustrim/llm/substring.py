"""Substring dedup: Rabin-Karp hashes of every window of `length` words, counted in Spark.

Each document task hashes all its windows.  Of equal windows in one chunk of CHUNK_WORDS words all but the first, by
(doc_id, start), are marked at once; the first travels on as a (hash, doc, start) entry, packed and dealt out by
hash, so that no bucket gets a window more often than there are chunks, however common it is.  Each bucket
sorts its entries and marks all but the first occurrence; the marks travel back packed by document, where
they merge into maximal removal intervals.

Defined cases: null or empty text has no words; texts shorter than a window lose nothing; rows that
share a doc_id are versions of one document, so a window at the same place in two of them is one
window; a null doc_id sorts before all others.  Two different windows share a 64-bit hash with
probability 2^-64 a pair.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import EXCHANGE, PACKED, Scratch, bucket_of, buckets_for, chunk, covered, dealt, entry_buckets, id_out, keyed, keyed_columns, marked, pack, rolling, slices, text_bytes, window_hash, with_marks, word_hashes

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Words that are hashed and packed at once.
CHUNK_WORDS = 1_000_000


def _firsts(docs: np.ndarray, starts: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries to keep, one for each hash, the least by (doc, start); which stand at a later place."""
    order = np.argsort(prints)
    twin = np.zeros(len(order), bool)
    same = prints[order[1:]] == prints[order[:-1]]
    twin[1:] |= same
    twin[:-1] |= same
    lone, more = order[~twin], order[twin]
    more = more[np.lexsort((starts[more], docs[more], prints[more]))]
    head = np.ones(len(more), bool)
    head[1:] = prints[more[1:]] != prints[more[:-1]]
    lead = more[np.maximum.accumulate(np.where(head, np.arange(len(more)), 0))]
    later = (docs[more] != docs[lead]) | (starts[more] != starts[lead])
    return np.sort(np.concatenate([lone, more[head]])), more[later]


def _marks(docs: np.ndarray, starts: np.ndarray, n_buckets: int):
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    return pack(bucket_of(docs, n_buckets), n_buckets, docs, starts)


def _windows(n_parts: int, length: int):
    """Entries of the first windows of their kind in a chunk; the others are marks at once."""

    def run(batches):
        def flush():
            words, sizes = (np.concatenate(x) for x in held[1:])
            counts = np.maximum(sizes - length + 1, 0)
            first = np.cumsum(sizes) - sizes
            local = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            prints = window_hash(rolling(words), np.repeat(first, counts) + local, length)
            docs = np.repeat(np.concatenate(held[0]), counts)
            keep, later = _firsts(docs, local, prints)
            if len(keep):
                part = (prints[keep] >> np.uint64(24)) % np.uint64(n_parts)
                yield chunk(0, pack(part.astype(np.int64), n_parts, docs[keep], local[keep], prints[keep]))
            if len(later):
                yield chunk(2, _marks(docs[later], local[later], n_parts))

        held, size = [[], [], []], 0
        for batch in batches:
            at = 0
            for column in slices(batch.column("text")):
                words, sizes = word_hashes(column, False)
                for x, y in zip(held, (batch.column("doc_id").slice(at, len(column)).to_numpy(), words, sizes), strict=True):
                    x.append(y)
                at += len(column)
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield from flush()
                    held, size = [[], [], []], 0
        if size:
            yield from flush()

    return run


def _later(n_buckets: int):
    """Marks of all but the first of equal windows."""

    def run(batches):
        for marks, got in entry_buckets(batches):
            if marks is not None:
                yield marks
                continue
            docs, starts, prints, _ = got
            _, later = _firsts(docs, starts, prints)
            if len(later):
                yield _marks(docs[later], starts[later], n_buckets)

    return run


def repeat_marks(docs: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Packed (doc_id, start) of the windows that also start earlier, by document bucket; bucket count."""
    n = buckets_for(docs)
    out = dealt(keyed(docs).mapInArrow(_windows(n, length), EXCHANGE), n).mapInArrow(_later(n), PACKED)
    return scratch.write(out, "marks"), n


def digest(docs: DataFrame, length: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space."""
    scratch = Scratch(docs.sparkSession)
    marks, n = repeat_marks(docs, length, scratch)

    def run(batches):
        import pyarrow as pa

        for rows, starts in marked(batches):
            out = []
            for t, s in zip(text_bytes(rows.column("text")), starts, strict=True):
                words, total = t.split(), 0
                total = len(words)
                if len(s):
                    gone = covered(total, s, length)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = with_marks(keyed(docs), marks, n).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", id_out())


def cut(text: bytes, starts: np.ndarray, length: int) -> bytes:
    """`text` without the words that the windows cover; what surrounds the kept words stays."""
    spans = [m.span() for m in WORD.finditer(text)]
    gone = covered(len(spans), starts, length)
    out, at = [], 0
    for (a, b), g in zip(spans, gone.tolist(), strict=True):
        if g:
            out.append(text[at:a].rstrip(b" "))
            at = b
    out.append(text[at:])
    return b"".join(out)


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """`docs` with all its columns; text loses what also starts earlier, n_chars (if there) follows.

    Rows come back once each, also those with no text left.  A null text stays null.
    """
    import pyarrow as pa

    scratch = Scratch(docs.sparkSession)
    marks, n = repeat_marks(docs, length, scratch)
    body = docs.select(*keyed_columns(), F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row"), F.col("text").isNull().alias("no_text"))

    def run(batches):
        for rows, starts in marked(batches):
            texts = [cut(t, s, length) if len(s) else t for t, s in zip(text_bytes(rows.column("text")), starts, strict=True)]
            texts = [None if null else t.decode() for t, null in zip(texts, rows.column("no_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = with_marks(body, marks, n).mapInArrow(run, f"row {body.schema['row'].dataType.simpleString()}, text string")
    cols = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*cols)
