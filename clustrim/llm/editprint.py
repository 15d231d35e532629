"""Document fingerprints by randomised edit embedding.

All texts walk under the same random bits: at step j the walk stands on one character and moves on by
R[j, class of the character], 0 or 1, so an edit shifts the walk only until the random bits bring it back
together; edit distance becomes Hamming distance between walks.  The walk's steps are sampled at fixed
places, `SAMPLES` per octave, and each sample keeps four bits of the character: the fingerprint is that
string of hex digits, as long as the walk.  Likeness is the weighted share of agreeing digits, an octave
weighing as its width, corrected for chance agreement; what one walk lacks disagrees.

Neighbours (next smaller doc_id) come from one range deal of the texts: every part gets the first
document of the part below as a guest, so no order over the whole table is needed in one task.  The ranges come
from a range exchange of the ids and text hashes alone.

A walk has 3 n + 64 steps for n characters; it ends the text after 2 n on average, and stops short of its end
with probability below 2^-60 for 1 character and less for any other number.

Defined cases: null text is empty; an empty text has an empty fingerprint, likeness 1 to an empty one and
0 to any other; rows that share a doc_id stand in the order of a hash of their texts; a null doc_id comes after
all others; extra columns are ignored; a single document is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, MAX_TASKS, Scratch, buckets_for, id_out, keyed, mix
from .graph import components
from .leak import nearest_whole

PERIOD, SAMPLES, SEED = 8192, 32, 20240229
#: Characters (texts and edited texts apart) that one batch of walks holds.
BATCH_CHARS = 5_000_000

_rng = np.random.default_rng(SEED)
_MOVE = _rng.integers(0, 2, (PERIOD, 256)).astype(np.int64)
_MOVE[:, 0] = 0
_DIGIT = _rng.integers(0, 16, (1024, 256)).astype(np.uint8)
_DIGIT[:, 0] = 255


def sample_steps(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps below `limit`, ascending, and their weights; the same prefix for every limit."""
    steps, weights, octave = [0], [1.0], 0
    while 1 << octave < limit:
        lo = 1 << octave
        if lo <= SAMPLES:
            own = np.arange(lo, 2 * lo)
        else:
            own = lo + np.arange(SAMPLES) * (lo // SAMPLES) + np.random.default_rng(SEED + octave).integers(0, lo // SAMPLES, SAMPLES)
        steps.extend(own.tolist())
        weights.extend([lo / len(own)] * len(own))
        octave += 1
    s, w = np.array(steps), np.array(weights)
    return s[s < limit], w[s < limit]


def prints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrix (samples x texts) of digits, 255 past a walk's end; the samples' weights."""
    n = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-n, kind="stable")
    flat = np.frombuffer("\0".join([texts[k].replace("\0", " ") for k in order] + [""]).encode("utf-32-le"), np.uint32)
    buf = (mix(flat.astype(np.uint64) * np.uint64(BASE)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    buf[flat == 0] = 0
    size = n[order]
    pos = np.cumsum(size + 1) - size - 1
    reach = np.where(size > 0, 3 * size + 64, 0)
    limit = int(reach[0]) if len(size) else 0
    steps, weights = sample_steps(limit)
    rec = np.full((len(steps), len(texts)), 255, np.uint8)
    alive, k = np.arange(len(texts)), 0
    for j in range(limit):
        if j & 255 == 0:
            on = buf[pos] != 0
            alive, pos = alive[on], pos[on]
            if not len(alive):
                break
        c = buf[pos]
        if k < len(steps) and steps[k] == j:
            rec[k, alive] = _DIGIT[k & 1023][c]
            k += 1
        pos += _MOVE[j % PERIOD][c]
    rec[steps[:, None] >= reach[None, :]] = 255
    out = np.empty_like(rec)
    out[:, order] = rec
    return out, weights


def likeness(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Column by column, 0 to 1."""
    w = weights[:, None]
    either, both = (a != 255) | (b != 255), (a != 255) & (b != 255)
    total = (w * either).sum(0)
    agree = ((w * (both & (a == b))).sum(0) - (w * both).sum(0) / 16) * 16 / 15
    return np.where(total == 0, 1.0, np.clip(agree / np.where(total == 0, 1, total), 0, 1))


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def as_text(column: np.ndarray) -> str:
    return _HEX[column[column != 255]].tobytes().decode()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _work(batches):
    import pyarrow as pa

    def flush(ids, texts, after):
        following = [*texts[1:], after]
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        m, w = prints([*texts, after, *changed])
        n = len(texts)
        own, nxt, new = m[:, :n], m[:, 1 : n + 1], m[:, n + 1 :]
        cols = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([as_text(own[:, k]) for k in range(n)]),
            pa.array([as_text(new[:, k]) for k in range(n)]),
            pa.array(likeness(own, new, w)),
            pa.array(likeness(own, nxt, w)),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t, guest in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("guest").to_pylist(), strict=True):
            if texts and (guest or held >= BATCH_CHARS):
                yield flush(ids, texts, t)
                ids, texts, held = [], [], 0
            if guest:
                return
            ids.append(i)
            texts.append(t)
            held += len(t)


def _ordered(doc_id: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """16 bytes a row that sort as (doc_id, text_hash)."""
    both = np.stack([doc_id, text_hash], 1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return both.astype(">u8").view("S16").reshape(-1)


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = keyed(docs).withColumn("h", F.xxhash64("text"))
    n = min(buckets_for(docs), MAX_TASKS)
    # the last key of each range, from a range exchange of the keys alone: one row a range
    keys = rows.select("doc_id", "h").repartitionByRange(n, "doc_id", "h").select(F.spark_partition_id().alias("part"), "doc_id", "h")
    tops = sorted((r["top"]["doc_id"], r["top"]["h"]) for r in keys.groupBy("part").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect())
    cuts = spark.sparkContext.broadcast(_ordered(*np.array(tops[:-1], np.int64).reshape(-1, 2).T))

    @F.pandas_udf("int")
    def part(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, _ordered(ids.to_numpy(), h.to_numpy())).astype(np.int32))

    cols = ["part", "guest", "doc_id", "h", "text"]
    own = rows.withColumn("part", part("doc_id", "h")).withColumn("guest", F.lit(False)).select(*cols)
    if tops:
        to = spark.createDataFrame([(*tops[k - 1], k) for k in range(len(tops))], "doc_id long, h long, part int")  # MAX_TASKS rows at most
        own = own.unionByName(rows.join(F.broadcast(to), ["doc_id", "h"]).withColumn("guest", F.lit(True)).select(*cols))
    dealt = own.repartitionById(max(1, len(tops)), F.col("part")).sortWithinPartitions("guest", F.desc("doc_id"), F.desc("h"))
    out = dealt.mapInArrow(_work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", id_out())


# --- near groups ------------------------------------------------------------------------------

#: Digits of a band and the step from one band to the next; rows and characters of a block.
BAND, BAND_STEP = 8, 4
BLOCK_ROWS, BLOCK_CHARS = 2048, 8_000_000
#: Classes of a text's character counts; bytes of its SHA-256 that name it.
CLASSES, NAME = 32, 16
#: Length of the runs whose counts bound a distance; counts of how many texts a block keeps at hand.
RUN, HELD_RUNS = 8, 1000
#: Places from which a walk over two texts looks for where they meet again, and the characters that must agree there, near and far.
REACH, MEET, MEET_FAR = 12, 8, 24


def bands(fingerprint: str) -> list[str]:
    """Bit-sampled band keys: overlapping runs of BAND digits, of long walks from the octaves past the dense ones."""
    first = 2 * SAMPLES if len(fingerprint) >= 4 * SAMPLES else 0
    return [f"{a}:{fingerprint[a : a + BAND]}" for a in range(first, len(fingerprint) - BAND + 1, BAND_STEP)] or [f"={fingerprint}"]


def _banded(batches):
    """doc_id, text -> doc_id, sha (of the text), n_chars, character counts, band keys; empty texts have no bands."""
    import pyarrow as pa

    def flush(ids, texts):
        m, _ = prints(texts)
        keys = [[xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in bands(as_text(m[:, k]))] if t else [] for k, t in enumerate(texts)]
        shas = [hashlib.sha256(t.encode()).digest()[:NAME] for t in texts]
        cols = [pa.array(ids, pa.int64()), pa.array(shas, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([char_counts(t) for t in texts], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "sha", "n_chars", "counts", "bands"])

    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= BATCH_CHARS:
                yield flush(ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield flush(ids, texts)


def char_counts(text: str) -> bytes:
    """Characters by class, two bytes a class; an edit takes away one at most and adds one at most."""
    u = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.minimum(np.bincount(u % CLASSES, minlength=CLASSES), 65535).astype("<u2").tobytes()


def unlike_by_counts(a: np.ndarray, b: np.ndarray, longer: np.ndarray, least: float) -> np.ndarray:
    """Rows whose character counts show that the distance is too large for `least`."""
    gap = a.astype(np.int32) - b
    return np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1)) > (1 - least) * longer + 1e-9


def counts_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, CLASSES)


def pair_counts(text: str, classes: int = 512, size: int = 2) -> np.ndarray:
    """Runs of `size` neighbouring characters by hash class; an edit takes away `size` at most and adds `size` at most."""
    u = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(0, len(u) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(BASE) + u[k : k + n]
    return np.bincount((mix(h) % np.uint64(classes)).astype(np.int64), minlength=classes)


def run_counts(text: str, longer: int) -> np.ndarray:
    """Counts of runs of RUN characters, in more classes where the longer text has more than 16,384; 255 at most."""
    return np.minimum(pair_counts(text, 1 << 14 if longer <= 1 << 14 else 1 << 16, RUN), 255).astype(np.uint8)


def stepwise(a: str, b: str, most: int) -> int:
    """Number of edits that turn a into b, not always the fewest; some number above `most` once it passes that.

    Walks over both texts as far as they agree, then to the nearest place where they meet again.
    """
    i, j, cost, m, n = 0, 0, 0, len(a), len(b)
    while True:
        w = 16
        while i + w <= m and j + w <= n and a[i : i + w] == b[j : j + w]:
            i, j, w = i + w, j + w, 2 * w
        while w > 1:
            w //= 2
            if i + w <= m and j + w <= n and a[i : i + w] == b[j : j + w]:
                i, j = i + w, j + w
        rest = max(m - i, n - j)
        if i == m or j == n or cost > most:
            return cost + rest
        for s in range(1, min(REACH, rest) + 1):
            x, y = a[i + s : i + s + MEET], b[j + s : j + s + MEET]
            at = (s, s) if x == y else next(((s, t) if x == b[j + t : j + t + MEET] else (t, s) for t in range(s) if x == b[j + t : j + t + MEET] or y == a[i + t : i + t + MEET]), None)
            if at:
                i, j, cost = min(m, i + at[0]), min(n, j + at[1]), cost + s
                break
        else:
            left = most - cost + 1
            for s in range(REACH + 1):
                at, to = b.find(a[i + s : i + s + MEET_FAR], j, j + left + MEET_FAR) - j, a.find(b[j + s : j + s + MEET_FAR], i, i + left + MEET_FAR) - i
                if at >= 0 and max(s, at) < left:
                    left, go = max(s, at), (s, at)
                if to >= 0 and max(s, to) < left:
                    left, go = max(s, to), (to, s)
            if left > most - cost:
                return cost + rest
            i, j, cost = min(m, i + go[0]), min(n, j + go[1]), cost + left


def alike(a: str, b: str, least: float, runs=run_counts) -> bool:
    """1 - edit distance / longer length >= `least`, exactly.

    Edits that are found by a walk settle most links and counts of runs most others; the bit-parallel distance
    on whole texts settles the rest.
    """
    longer = max(len(a), len(b), 1)
    most = math.floor((1 - least) * longer + 1e-6)
    if abs(len(a) - len(b)) > (1 - least) * longer + 1e-9:
        return False
    enough = lambda d: 1 - d / longer >= least - 1e-12
    if enough(stepwise(a, b, most)):
        return True
    x, y = runs(a, longer), runs(b, longer)
    both = int(np.minimum(x, y).sum(dtype=np.int64))
    if max(int(x.sum(dtype=np.int64)), int(y.sum(dtype=np.int64))) - both > RUN * most:
        return False
    return enough(nearest_whole(a, b, most))


def _near_stars(least: float):
    """Pairs with the counts of both: those that the counts leave."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            if b.num_rows:
                longer = pc.max_element_wise(b.column("n_chars"), b.column("centre_chars")).to_numpy()
                off = unlike_by_counts(counts_of(b.column("counts")), counts_of(b.column("centre_counts")), longer, least)
                yield b.select(["rep", "sha", "centre", "centre_sha"]).filter(pa.array(~off))

    return run


def _verify_stars(least: float):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ok = [alike(x, y, least) for x, y in zip(b.column("text").to_pylist(), b.column("centre_text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("centre")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _grouped(batches, key: tuple[str, ...]):
    """Tables of the rows of each group, for rows sorted by `key`."""
    import pyarrow as pa

    now, got = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], 1)
        edges = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1).tolist(), len(cols)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if got and tuple(cols[a]) != now:
                yield pa.Table.from_batches(got).combine_chunks()
                got = []
            now = tuple(cols[a])
            got.append(batch.slice(a, b - a))
    if got:
        yield pa.Table.from_batches(got).combine_chunks()


def _open_pairs(rows, least: float):
    """(i, those before it that length and counts leave as partners), over rows in the order of their lengths.

    Partners are in another component and, where the group holds two blocks, in the other block.
    """
    n, component, block, counts = rows["n_chars"].to_numpy(), rows["component"].to_numpy(), rows["block"].to_numpy(), counts_of(rows["counts"])
    across = len(np.unique(block)) > 1
    first = np.searchsorted(n, n - (1 - least) * n - 1e-9)
    for i in range(1, len(n)):
        near = np.flatnonzero(component[first[i] : i] != component[i]) + first[i]
        if across:
            near = near[block[near] != block[i]]
        if len(near):
            near = near[~unlike_by_counts(counts[near], counts[i], n[i], least)]
        if len(near):
            yield i, near


def _edges(a, b):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _open_forest(least: float):
    """Rows sorted by (bucket, bi, bj): edges that join all pairs still to be compared, one forest a block pair."""

    def run(batches):
        for rows in _grouped(batches, ("bucket", "bi", "bj")):
            rows = rows.sort_by([("n_chars", "ascending"), ("rep", "ascending"), ("sha", "ascending")])
            rep, label, a, b = rows["rep"].to_numpy(), np.arange(rows.num_rows), [], []
            for i, near in _open_pairs(rows, least):
                near = near[label[near] != label[i]]
                which, at = np.unique(label[near], return_index=True)
                for w, j in zip(which.tolist(), near[at].tolist(), strict=True):
                    a.append(rep[i])
                    b.append(rep[j])
                    label[label == w] = label[i]
            if a:
                yield _edges(a, b)

    return run


def _verify_blocks(least: float):
    """Rows sorted by (cluster, bi, bj): links that join components which are still apart, one forest a block pair."""

    def solve(rows):
        rows = rows.sort_by([("n_chars", "ascending"), ("rep", "ascending"), ("sha", "ascending")])
        rep, component, texts = rows["rep"].to_pylist(), rows["component"].to_pylist(), rows["text"].to_pylist()
        keys = [frozenset(x) for x in rows["bands"].to_pylist()]
        parent, held = {c: c for c in component}, {}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        def runs(text, longer):
            key = text, longer <= 1 << 14
            if key not in held:
                if len(held) >= HELD_RUNS:
                    held.clear()
                held[key] = run_counts(text, longer)
            return held[key]

        a, b = [], []
        for i, near in _open_pairs(rows, least):
            for j in near.tolist():
                if keys[i].isdisjoint(keys[j]) or (x := root(component[i])) == (y := root(component[j])):
                    continue
                if alike(texts[i], texts[j], least, runs):
                    parent[x] = y
                    a.append(rep[i])
                    b.append(rep[j])
        return _edges(a, b)

    def run(batches):
        for rows in _grouped(batches, ("cluster", "bi", "bj")):
            yield solve(rows)

    return run


def _block_pairs(rows: DataFrame, key: str) -> DataFrame:
    """Every row, with its block of `blocks`, in each pair of blocks (bi, bj) that it belongs to; pairs together, sorted."""
    out = rows.withColumn("block", F.pmod(F.xxhash64("sha", F.lit(7)), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    return out.drop("other", "blocks").repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def near_groups(docs: DataFrame, least: float = 0.95) -> DataFrame:
    """Per row of `docs`: doc_id, component_id (smallest doc_id reachable over links), kept (both equal).

    Texts are linked when 1 - edit distance / longer length >= `least`, verified on whole texts, and they
    share a band; equal texts always are.  Of pairs of texts of 300 to 6,000 characters with edits at random places,
    0.99 share a band at 1 % edits, 0.94 at 5 %, 0.81 at 10 %; of texts of 20 to 300 characters 1.00, 0.92 and 0.85.
    At the default threshold of 0.95 that is above 0.9; a lower one finds fewer of its links.  Band buckets first link their members to their smallest one.  Texts of a
    bucket that are then still apart, and that neither their lengths nor their character counts tell apart, form clusters
    over all buckets; the texts of a cluster go to blocks of bounded size, each pair of blocks in a group of its own,
    which gives back a forest, so rows grow with the members.  Every pair that shares a band is linked
    or found unlike, unless other links join it already.  Empty texts are linked with nothing; rows that
    share a doc_id are one node; a null doc_id is a node that comes before all others, its component null.
    """
    scratch = Scratch(docs.sparkSession)
    base = scratch.write(keyed(docs).mapInArrow(_banded, "doc_id long, sha binary, n_chars long, counts binary, bands array<long>"), "banded")

    def with_texts(wanted: DataFrame, name: str) -> DataFrame:
        """(rep, sha, text) of the texts of `wanted`."""
        whole = keyed(docs).select(F.col("doc_id").alias("rep"), F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, NAME).alias("sha"), "text")
        return scratch.write(whole.join(wanted.select("rep", "sha").distinct(), ["rep", "sha"], "left_semi").dropDuplicates(["rep", "sha"]), name)

    # equal texts
    rep = scratch.write(base.where("n_chars > 0").groupBy("sha").agg(F.min("doc_id").alias("rep")), "rep")
    same = scratch.write(base.select("doc_id", "sha").join(rep, "sha").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same")
    firsts = scratch.write(base.join(rep.withColumnRenamed("rep", "doc_id"), ["doc_id", "sha"], "left_semi").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "sha"]), "firsts")
    scratch.drop("rep")
    sketch = firsts.select("rep", "sha", "counts")
    keys = firsts.select("rep", "sha", "n_chars", F.explode(F.array_distinct("bands")).alias("bucket"))

    # stars; aggregates are written before they are joined back, so that hot keys can be split
    groups = keys.groupBy("bucket").agg(F.min(F.struct("rep", "sha", "n_chars")).alias("c"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.write(groups.select("bucket", F.col("c.rep").alias("centre"), F.col("c.sha").alias("centre_sha"), F.col("c.n_chars").alias("centre_chars")), "groups")
    slots = scratch.write(keys.join(groups, "bucket"), "slots")
    scratch.drop("groups")
    close = F.abs(F.col("n_chars") - F.col("centre_chars")) <= (1 - least) * F.greatest("n_chars", "centre_chars") + 1e-9
    pairs = slots.where("sha != centre_sha").where(close).drop("bucket").distinct()
    pairs = pairs.join(sketch, ["rep", "sha"]).join(sketch.toDF("centre", "centre_sha", "centre_counts"), ["centre", "centre_sha"])
    pairs = scratch.write(pairs.mapInArrow(_near_stars(least), "rep long, sha binary, centre long, centre_sha binary"), "pairs")
    texts = with_texts(pairs.select("rep", "sha").union(pairs.select("centre", "centre_sha")), "texts")
    pairs = pairs.join(texts, ["rep", "sha"]).join(texts.toDF("centre", "centre_sha", "centre_text"), ["centre", "centre_sha"])
    links = scratch.write(pairs.select("rep", "centre", "text", "centre_text").mapInArrow(_verify_stars(least), "a long, b long"), "links")
    scratch.drop("pairs", "texts")

    # buckets still apart: which texts are still to be compared, by lengths and character counts alone
    part = scratch.write(components(links, scratch).withColumnRenamed("node", "rep"), "part")
    held = slots.select("bucket", "rep", "sha", "n_chars").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = scratch.write(held, "held")
    scratch.drop("slots")
    apart = held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.bit_xor(F.xxhash64("sha")).alias("x"), F.min("sha").alias("first")).where("lo < hi")
    apart = apart.groupBy("n", "chars", "x", "first").agg(F.min("bucket").alias("bucket"))  # equal buckets once
    weight = scratch.write(apart.select("bucket", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "weight")
    todo = _block_pairs(held.join(weight, "bucket").join(sketch, ["rep", "sha"]), "bucket")
    todo = scratch.write(todo.mapInArrow(_open_forest(least), "a long, b long").distinct(), "open")
    scratch.drop("held")

    # clusters of those, each text once a pair of blocks, compared where they share a band
    cluster = scratch.write(components(todo, scratch).toDF("rep", "cluster"), "cluster")
    members = scratch.write(firsts.join(cluster, "rep").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "members")
    scratch.drop("firsts")
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    size = scratch.write(size.select("cluster", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int").alias("blocks")), "size")
    texts = with_texts(members, "texts")
    more = scratch.write(_block_pairs(members.join(size, "cluster").join(texts, ["rep", "sha"]), "cluster").mapInArrow(_verify_blocks(least), "a long, b long"), "more")
    scratch.drop("texts", "members")

    final = components(links.union(more).union(same).distinct(), scratch)
    out = base.select("doc_id").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.select(id_out().alias("doc_id"), id_out("component_id").alias("component_id"), "kept")
