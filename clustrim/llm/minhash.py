"""MinHash near-dedup with b-bit signatures.

1. Every document: the set of its 64-bit shingle hashes gives `PERMS` minima; their low `BITS` bits are
   packed as signature, runs of `ROWS` full minima are hashed to `BANDS` band keys.
2. Equal sets (128-bit digest and size) collapse to their smallest doc_id.
3. Stars: each bucket links its members to its smallest member; the signature's bit counts, corrected
   for chance collisions, drop hopeless pairs; the others are confirmed on full sets.
4. Buckets whose members are still in several components go to pairs of blocks of bounded size, by signature (32
   bytes a member): each member's likeliest partner in another component is confirmed on full sets.  In buckets
   that are still apart after that, only members with a likely partner in another component bring their sets to
   their pairs of blocks, which are confirmed all at once by a sparse set product; a spanning forest comes back,
   so the rows grow with the members, not with their pairs.
5. Components of all confirmed links.

A link of similarity 0.85 shares no band with probability (1 - 0.85^5)^25 < 5e-7, one of 0.8 with
probability (1 - 0.8^5)^25 < 5e-5; both fail the bit count of step 3 (six standard deviations) with
probability < 1e-8.

Defined cases: null or empty text, or text without words, has an empty set and no links; fewer words
than a shingle make one shingle; rows that share a doc_id are one node, linked by the texts of each of them;
a null doc_id is a node of its own that comes before all others and gets a null component; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Scratch, fresh, id_out, keyed, mix, slices, word_hashes
from .graph import components

PERMS, BANDS, ROWS, BITS = 128, 25, 5, 2
#: Members and set elements of a block in step 4.
BLOCK_ROWS, BLOCK_ITEMS = 512, 1 << 20
#: Members of a block of signatures.
SIGN_ROWS = 2048
#: Bytes of text whose sets are held at once.
CHUNK_BYTES = 2 << 20

_ODD = (mix(np.arange(1, PERMS + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)).astype(np.uint64)


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text of an Arrow string column (A-Z lower-cased)."""
    flat, counts = word_hashes(column, True)
    b = np.uint64(BASE)
    roll = np.zeros(max(len(flat) - width + 1, 0), np.uint64)
    for j in range(width):
        roll = roll * b + flat[j : j + len(roll)]
    roll = mix(roll)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(roll[at : at + n - width + 1]))
        elif n:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in flat[at : at + n]:
                    h = h * b + x
            out.append(mix(np.array([h ^ np.uint64(0x5BF03635)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """PERMS x len(sets) minima of the non-empty `sets`."""
    flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    out, buf = np.empty((PERMS, len(sets)), np.uint64), np.empty_like(flat)
    for k in range(PERMS):
        np.multiply(flat, _ODD[k], out=buf)
        out[k] = np.minimum.reduceat(buf, first)
    return out


def _sign(width: int):
    import pyarrow as pa

    def rows(ids, texts):
        sets = shingle_sets(texts, width)
        full = [k for k, s in enumerate(sets) if len(s)]
        n = len(sets)
        key = digests(sets)
        sig = np.zeros((n, PERMS * BITS // 64), np.uint64)
        bands = np.zeros((n, BANDS), np.uint64)
        if full:
            m = minima([sets[k] for k in full])
            low = mix(m.copy()) & np.uint64(2**BITS - 1)
            per = 64 // BITS
            for w in range(sig.shape[1]):
                word = np.zeros(len(full), np.uint64)
                for j in range(per):
                    word |= low[w * per + j] << np.uint64(BITS * j)
                sig[full, w] = word
            for b in range(BANDS):
                h = np.full(len(full), b + 1, np.uint64)
                for r in range(ROWS):
                    h = mix(h * np.uint64(BASE) + m[b * ROWS + r])
                bands[full, b] = h
        sig, bands, key = sig.view(np.int64), bands.view(np.int64), key.view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
        cols = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(key[0]), pa.array(key[1]), *[pa.array(np.ascontiguousarray(sig[:, w])) for w in range(sig.shape[1])], lists]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "k1", "k2", "s0", "s1", "s2", "s3", "bands"])

    def run(batches):
        for batch in batches:
            at = 0
            for column in slices(batch.column("text"), CHUNK_BYTES):
                yield rows(batch.column("doc_id").slice(at, len(column)), column)
                at += len(column)

    return run


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit digests of each set."""
    out = np.zeros((2, len(sets)), np.uint64)
    for k, x in enumerate(sets):
        if len(x):
            out[0, k], out[1, k] = np.bitwise_xor.reduce(mix(x.copy())), np.add.reduce(mix(x ^ np.uint64(0xA5A5A5A5)))
    return out


def _sets(width: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for column in slices(batch.column("text"), CHUNK_BYTES):
                sets = shingle_sets(column, width)
                ends = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
                k1, k2 = digests(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends)), pa.array(k1), pa.array(k2), lists], names=["n_shingles", "k1", "k2", "items"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= percent * union."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    item = np.cumsum(new) - 1
    count = np.bincount(item)
    shared = count[item] > 1
    item, owner = item[shared], owner[shared]
    _, item = np.unique(item, return_inverse=True)
    inter = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for a in range(0, int(item.max()) + 1 if len(item) else 0, step):
        lo, hi = np.searchsorted(item, [a, a + step])
        x = np.zeros((len(sets), step), np.float32)
        x[owner[lo:hi], item[lo:hi] - a] = 1
        inter += x @ x.T
    inter = inter.astype(np.int64)
    return 100 * inter >= percent * (n[:, None] + n[None, :] - inter)


def forest(adj: np.ndarray) -> np.ndarray:
    """Smallest row index reachable from each row."""
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _allowed(floor: float) -> float:
    """Differing signature slots that an estimate of at least `floor` allows."""
    return PERMS * (1 - 2.0**-BITS) * (1 - floor) + 1e-9


def _misses(table, rows: slice) -> np.ndarray:
    """Differing signature slots of some rows to all rows; 255 within a component."""
    component = table["component"].to_numpy()
    out = np.zeros((len(component[rows]), len(component)), np.uint8)
    for w in range(PERMS * BITS // 64):
        s = table[f"s{w}"].to_numpy().view(np.uint64)
        x = s[rows, None] ^ s[None, :]
        out += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    out[component[rows, None] == component[None, :]] = 255
    return out


def _by_place(solve):
    """mapInArrow function: solve(table of all rows of one (bucket, bi, bj)) -> record batches, for rows sorted by these."""
    import pyarrow as pa

    def run(batches):
        key, rows = None, []
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "bi", "bj")], 1)
            new = np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(places)], strict=True):
                if a == b:
                    continue
                if rows and tuple(places[a]) != key:
                    yield from solve(pa.Table.from_batches(rows).combine_chunks())
                    rows = []
                key = tuple(places[a])
                rows.append(batch.slice(a, b - a))
        if rows:
            yield from solve(pa.Table.from_batches(rows).combine_chunks())

    return run


def _best(floor: float):
    """Each row's likeliest partner in another component: sa, rep, sb, centre, misses."""
    import pyarrow as pa

    def solve(t):
        for a in range(0, t.num_rows, 256):
            d = _misses(t, slice(a, a + 256))
            other = d.argmin(1)
            least = d[np.arange(len(d)), other]
            keep = np.flatnonzero(least <= _allowed(floor))
            own, far = t.take(pa.array(a + keep)), t.take(pa.array(other[keep]))
            cols = [own["sid"], own["rep"], far["sid"], far["rep"], pa.chunked_array([pa.array(least[keep].astype(np.int32))])]
            yield from pa.table(cols, names=["sa", "rep", "sb", "centre", "misses"]).to_batches()

    return _by_place(solve)


def _likely(floor: float):
    """Rows with a partner in another component that the signatures allow."""
    import pyarrow as pa

    def solve(t):
        keep = [(_misses(t, slice(a, a + 256)) <= _allowed(floor)).any(1) for a in range(0, t.num_rows, 256)]
        yield from t.filter(pa.array(np.concatenate(keep))).select(["bucket", "bi", "bj", "sid", "rep"]).to_batches()

    return _by_place(solve)


def _confirm_blocks(percent: int):
    """Sorted rows (bucket, bi, bj, sid, rep, items): links that span the components of each block pair."""
    import pyarrow as pa

    def solve(ids, sets):
        if len(ids) < 2:
            return None
        label = forest(linked(sets, percent))
        pairs = [(ids[k], ids[j]) for k, j in enumerate(label.tolist()) if j != k]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["a", "b"])

    def run(batches):
        key, ids, sets = None, [], []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("bucket", "bi", "bj")], strict=True))
            col = batch.column("items")
            flat, ends = col.flatten().to_numpy().view(np.uint64), col.offsets.to_numpy() - col.offsets[0].as_py()
            for r, (k, i) in enumerate(zip(keys, batch.column("rep").to_pylist(), strict=True)):
                if k != key:
                    if ids and (out := solve(ids, sets)):
                        yield out
                    key, ids, sets = k, [], []
                ids.append(i)
                sets.append(flat[ends[r] : ends[r + 1]].copy())
        if ids and (out := solve(ids, sets)):
            yield out

    return run


def _agreement(a: str, b: str):
    """Similarity estimated from two signatures: agreeing b-bit slots, corrected for chance agreement."""
    low = F.lit(0x5555555555555555)
    misses = sum((F.bit_count((x := F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low)) for w in range(PERMS * BITS // 64)), F.lit(0))
    chance = 2.0**-BITS
    return ((1 - misses / PERMS) - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept, n_links (confirmed links found at it)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    base = scratch.write(keyed(docs).mapInArrow(_sign(width), "doc_id long, n_shingles long, k1 long, k2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"), "base")

    # 2: equal sets; a set is known by sid, its smallest doc_id is rep, and links are between reps
    sid = F.xxhash64("n_shingles", "k1", "k2").alias("sid")
    base = base.select("*", sid)
    real = base.where("n_shingles > 0")
    one = scratch.write(real.groupBy("sid").agg(F.min("doc_id").alias("rep")), "one")
    member = real.join(one, "sid")
    same = scratch.write(member.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same")
    reps = scratch.write(member.where("doc_id = rep").select("sid", "rep", "n_shingles", "s0", "s1", "s2", "s3", "bands").dropDuplicates(["sid"]), "reps")

    # 3: stars of the buckets
    keys = reps.select("sid", "rep", F.posexplode("bands").alias("band", "key")).select("sid", "rep", F.xxhash64("band", "key").alias("bucket"))
    groups = keys.groupBy("bucket").agg(F.min(F.struct("rep", "sid")).alias("centre"), F.count("*").alias("n")).where("n > 1")
    slots = scratch.write(keys.join(scratch.write(groups.drop("n"), "groups"), "bucket"), "slots")
    pairs = slots.where("sid != centre.sid").select(F.col("sid").alias("sa"), "rep", F.col("centre.sid").alias("sb"), F.col("centre.rep").alias("centre")).distinct()
    wanted = scratch.write(slots.select("sid", "rep").distinct(), "wanted")
    # by exchange at every size: the ids wanted grow with the documents
    texts = keyed(docs).join(wanted.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(width), "n_shingles long, k1 long, k2 long, items array<long>").select(sid, "items")
    sets = scratch.write(sets.join(wanted.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    side = lambda p: reps.select(F.col("sid").alias(f"s{p}"), *[F.col(f"s{w}").alias(f"{p}{w}") for w in range(4)])
    floor = percent / 100 - 6 * (0.25 / PERMS) ** 0.5 / (1 - 2.0**-BITS)
    pairs = scratch.write(pairs.join(side("a"), "sa").join(side("b"), "sb").where(_agreement("a", "b") >= floor).select("sa", "sb", "rep", "centre"), "pairs")
    have = lambda p: sets.select(F.col("sid").alias(f"s{p}"), F.col("items").alias(f"{p}_items"))
    common = F.size(F.array_intersect("a_items", "b_items"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Links (a, b) of the pairs (sa, rep, sb, centre) whose full sets are alike."""
        got = pairs.join(have("a"), "sa").join(have("b"), "sb").where(100 * common >= percent * (F.size("a_items") + F.size("b_items") - common))
        return scratch.write(got.select(F.col("rep").alias("a"), F.col("centre").alias("b")), name)

    links = confirmed(pairs, "links")

    # 4: buckets still apart; aggregates are written before they are joined back: a join of two plain exchanges can split hot keys
    place, sign = ["bucket", "bi", "bj"], reps.select("sid", "n_shingles", "s0", "s1", "s2", "s3")

    def apart(links: DataFrame, blocks, name: str) -> DataFrame:
        """Members of buckets in several components, with signatures, dealt into pairs of blocks: sorted by place."""
        part = components(links, scratch)
        held = slots.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "sid", "rep", F.coalesce("component", "rep").alias("component"))
        held = scratch.write(held, f"held{name}")
        open_ = held.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.min("sid").alias("first"))
        open_ = open_.where("lo < hi").groupBy("n", "x", "first").agg(F.min("bucket").alias("bucket"))  # equal buckets once
        todo = scratch.write(held.join(scratch.write(open_.select("bucket"), f"open{name}"), "bucket").join(sign, "sid"), f"todo{name}")
        weight = todo.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items")).select("bucket", blocks.cast("int").alias("blocks"))
        todo = todo.drop("n_shingles").join(scratch.write(weight, f"weight{name}"), "bucket")
        todo = todo.withColumn("block", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        todo = todo.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("blocks", "block", "other")
        return todo.repartition(*place).sortWithinPartitions(*place)

    # 4a: each member's likeliest partner by signature, confirmed like the stars
    near = apart(links, F.ceil(F.col("n") / SIGN_ROWS), "1").mapInArrow(_best(floor), "sa long, rep long, sb long, centre long, misses int")
    near = near.groupBy("sa", "rep").agg(F.min(F.struct("misses", "sb", "centre")).alias("to")).select("sa", "rep", "to.sb", "to.centre")
    links = links.union(confirmed(scratch.write(near, "near_pairs"), "links2"))

    # 4b: what is still apart
    todo = apart(links, F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("items") / BLOCK_ITEMS)), "2")
    todo = scratch.write(todo.mapInArrow(_likely(floor), "bucket long, bi int, bj int, sid long, rep long"), "likely")
    todo = todo.join(sets, "sid").drop("sid").repartition(*place).sortWithinPartitions(*place, "rep")
    more = scratch.write(todo.mapInArrow(_confirm_blocks(percent), "a long, b long"), "more")

    # 5: all links
    every = links.union(more).distinct()
    final = components(every.union(same), scratch)
    out = base.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    degree = every.union(same).select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    out = out.join(degree, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.select(id_out().alias("doc_id"), "n_shingles", id_out("component_id").alias("component_id"), "kept", "n_links")


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """`docs` with all its columns, one document of each group: the smallest doc_id.

    Rows that share the kept doc_id stay; rows with a null doc_id stay if they lead their group.
    """
    name = fresh("kept_id", docs)
    kept = near_duplicates(docs, percent, width).where("kept").select(F.col("doc_id").alias(name)).distinct()
    cond = F.col("doc_id").cast("long").eqNullSafe(F.col(name))
    return docs.join(kept, cond, "left_semi")
