"""LM scoring with a hidden Markov model over words.

Counts: exact, of every word of the training documents, kept as a table that grows with the corpus.
Emission symbols: the end of a text, the OWN most frequent words each for itself, all other words by one
of HASHED buckets; within a bucket a word has its smoothed share of the bucket's counts, so the model is
a proper distribution over words (unknown words together take one part of each bucket).
Training: the states start from the counts of all words, shaken apart; then Baum-Welch rounds over all
training documents until the likelihood settles: each task runs scaled forward-backward over its texts, the
expected counts are summed over the partitions in Spark, and only the summed statistics (STATES x symbols)
come back.  A text of more than SPAN symbols is trained on whole, in consecutive pieces, of which only the
first counts as a start, so that memory and the number of steps are bounded.
Scoring: the scaled forward recursion gives the exact likelihood of the whole text's symbols; words beyond
the broadcast head (at most HEAD words, a proven bound) get their counts by a join with the count table.

Sequences of one batch advance in lockstep, longest first, state by state, so that every step is a few
array operations over all sequences that are long enough.

Defined cases: null or empty text is one token, the end; no training documents: N = V = 0, every word is
unknown; rows that share a doc_id are scored one by one; a null doc_id counts as the empty string for the
held-out rule; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, id_in, id_out, slices, word_hashes

STATES, OWN, HASHED, HEAD = 6, 16_384, 1024, 131_072
#: Rounds end when the log likelihood moves by less than this share of itself; MAX_ROUNDS without that are an error.
SETTLED, MAX_ROUNDS = 1e-4, 1000
#: Symbols of a piece in training; longer texts are taken in such pieces, whole.
SPAN = 4096
#: Tasks of a training round, for each core.
TASKS_A_CORE = 2
#: Weight of the unigram prior in an emission row, and of each transition.
PRIOR, MOVE_PRIOR = 50.0, 1.0
BATCH_WORDS = 1_000_000
#: Words that are counted at once, before their counts are handed on.
COUNT_WORDS = 4_000_000
#: Emission statistics travel in pieces of this many numbers.
PIECE = 4096


# --- counts -----------------------------------------------------------------------------------


def _count(batches):
    import pyarrow as pa

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    held, size = [], 0
    for batch in batches:
        for column in slices(batch.column("text")):
            held.append(word_hashes(column, True)[0])
            size += len(held[-1])
            if size >= COUNT_WORDS:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


def counts(train: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, c, bin): hash, count and logarithmic count class of every word."""
    out = train.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    return scratch.write(out.withColumn("bin", F.floor(F.log2("c") * 8).cast("int")), "counts")


class Head:
    """What every task needs of the counts: bounded, broadcast."""

    def __init__(self, h: np.ndarray, c: np.ndarray, own: np.ndarray, bucket_c, bucket_v, n_end: int):
        self.order = self.sorted = None
        self.h, self.c = h, c
        self.symbol = np.where(own, 0, OWN + 1 + (h % np.uint64(HASHED)).astype(np.int64)).astype(np.int32)
        self.symbol[own] = 1 + np.arange(own.sum())
        self.bucket_c, self.bucket_v, self.n_end = bucket_c, bucket_v, n_end

    def encode(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot in the head (or -1) and symbol of each word hash."""
        if self.order is None:
            self.order = np.argsort(self.h)
            self.sorted = np.append(self.h[self.order], np.uint64(2**64 - 1))
        at = np.searchsorted(self.sorted[:-1], words)
        known = (self.sorted[at] == words) & (at < len(self.h))
        slot = np.where(known, self.order[np.minimum(at, max(len(self.h) - 1, 0))] if len(self.h) else 0, -1)
        rest = OWN + 1 + (words % np.uint64(HASHED)).astype(np.int64)
        return slot, np.where(known, self.symbol[slot] if len(self.h) else 0, rest)


def head_of(table: DataFrame, n_docs: int) -> tuple[Head, int, int, int]:
    """The head; its least count class; N and V without the end token."""
    bins = sorted(((r["bin"], r["w"], r["s"]) for r in table.groupBy("bin").agg(F.count("*").alias("w"), F.sum("c").alias("s")).collect()), reverse=True)

    def least(limit: int) -> int:
        total, bound = 0, 1 << 30
        for b, w, _ in bins:
            total += w
            if total > limit:
                break
            bound = b
        return bound

    cut, own_cut = least(HEAD), least(OWN)
    rows = table.where(F.col("bin") >= cut).toArrow()  # at most HEAD rows
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    b = rows.column("bin").to_numpy()
    order = np.lexsort((h, -c))
    h, c, b = h[order], c[order], b[order]
    rest = table.where(F.col("bin") < own_cut).groupBy(_bucket().alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
    bc, bv = np.zeros(HASHED), np.zeros(HASHED)
    for r in rest:
        bc[r["k"]], bv[r["k"]] = r["c"], r["v"]
    return Head(h, c, b >= own_cut, bc, bv, n_docs), cut, sum(s for _, _, s in bins), sum(w for _, w, _ in bins)


def _bucket():
    """h mod HASHED of the unsigned hash (HASHED is a power of two)."""
    return F.col("h").bitwiseAND(F.lit(HASHED - 1)).cast("int")


# --- the model --------------------------------------------------------------------------------


class Packed:
    """Symbol sequences laid out step by step, longest first: at step t the lanes that are longer than t."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        size = sizes[self.order]
        first = (np.cumsum(sizes) - sizes)[self.order]
        steps = int(size[0])
        self.width = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
        self.at = np.cumsum(self.width) - self.width
        local = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        lane = np.repeat(np.arange(len(size)), size)
        self.ids = np.empty(len(flat), np.intp)
        self.ids[self.at[local] + lane] = flat[np.repeat(first, size) + local]

    @staticmethod
    def of(seqs: list[np.ndarray]) -> Packed:
        return Packed(np.concatenate(seqs), np.array([len(x) for x in seqs], np.int64))


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def forward(self, p: Packed) -> np.ndarray:
        """Natural log likelihood of each sequence, in packed order: the scaled forward recursion."""
        out, move, a = np.zeros(p.width[0]), np.ascontiguousarray(self.move.T), None
        for o, m in zip(p.at.tolist(), p.width.tolist(), strict=True):
            e = np.take(self.emit, p.ids[o : o + m], axis=1)
            a = self.start[:, None] * e if a is None else (move @ a[:, :m]) * e
            s = a.sum(0)
            a /= s
            out[:m] += np.log(s)
        return out

    def expect(self, p: Packed, opens: np.ndarray | None = None):
        """Expected start, transition and emission counts, and the log likelihood.

        `opens`: which sequences (not in packed order) begin a text; only these count as starts.  Single
        precision inside a batch: every row is scaled to sum to one, and the sums are double.
        """
        start, move, emit = (x.astype(np.float32) for x in (self.start, self.move, self.emit))
        back_move, ahead = np.ascontiguousarray(move), np.ascontiguousarray(move.T)
        alpha, scale, a = np.empty((STATES, len(p.ids)), np.float32), np.empty(len(p.ids), np.float32), None
        steps = list(zip(p.at.tolist(), p.width.tolist(), strict=True))
        for o, m in steps:
            e = np.take(emit, p.ids[o : o + m], axis=1)
            a = start[:, None] * e if a is None else (ahead @ a[:, :m]) * e
            s = a.sum(0)
            a /= s
            alpha[:, o : o + m], scale[o : o + m] = a, s
        moves, beta = np.zeros((STATES, STATES)), np.zeros((STATES, 0), np.float32)
        for o, m in reversed(steps):
            k = beta.shape[1]
            x = np.take(emit, p.ids[o : o + m], axis=1)
            x /= scale[o : o + m]
            if k:
                back = back_move @ beta
                moves += alpha[:, o : o + k] @ beta.T
                x[:, :k] *= back
                alpha[:, o : o + k] *= back
            beta = x
        symbols = self.emit.shape[1]
        emits = np.stack([np.bincount(p.ids, alpha[k], symbols) for k in range(STATES)])
        lead = alpha[:, : p.width[0]]
        if opens is not None:
            lead = lead[:, opens[p.order]]
        return lead.sum(1, dtype=float), moves * self.move, emits, float(np.log(scale).sum(dtype=float))

    @staticmethod
    def estimate(start, moves, emits, prior: np.ndarray) -> Model:
        s = start + 1.0
        m = moves + MOVE_PRIOR
        e = emits + PRIOR * prior
        return Model(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(1, keepdims=True))


_ENCODED = "doc_id long, held_out boolean, version long, n_tokens long, known long, all_log double, in_log double, rooms double, ids binary, rare array<long>, times array<long>"


def _encode(held):
    """Rows (doc_id, held_out, version, text) -> symbols (16 bits each, end included), sums over the head's words, rare words."""
    import pyarrow as pa

    def rows(h, part):
        log_c, inner = np.log10(h.c + 1.0), h.symbol > OWN
        room, end = np.log10(h.bucket_c + h.bucket_v + 1.0), np.log10(h.n_end + 1.0)
        flat, n = word_hashes(part.column("text"), True)
        texts = part.num_rows
        doc = np.repeat(np.arange(texts), n)
        slot, symbol = h.encode(flat)
        sums = lambda at, v=None: np.bincount(doc[at], v, texts)
        good = np.flatnonzero(slot >= 0)
        hit = slot[good]
        deep = inner[hit]
        other = np.flatnonzero(symbol > OWN)
        known = sums(good).astype(np.int64) + (h.n_end > 0)
        all_log, in_log = sums(good, log_c[hit]) + end, sums(good[deep], log_c[hit[deep]])
        rooms = sums(other, room[symbol[other] - OWN - 1])
        # words beyond the head, each once a text, with its count there
        far = np.flatnonzero(slot < 0)
        key, own = flat[far], doc[far]
        order = np.lexsort((key, own))
        key, own = key[order], own[order]
        lead = np.ones(len(key), bool)
        lead[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(lead)
        times = np.diff(np.append(first, len(key)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(own[first], minlength=texts))])
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (key[first].view(np.int64), times.astype(np.int64))]
        ids = np.zeros(len(flat) + texts, np.uint16)  # the end is symbol 0
        ids[np.arange(len(flat)) + doc] = symbol
        edges = np.concatenate([[0], np.cumsum(2 * (n + 1))]).astype(np.int32)
        blob = pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer(edges), pa.py_buffer(ids)])
        arrays = [*[part.column(c) for c in ("doc_id", "held_out", "version")], pa.array(n + 1), pa.array(known)]
        arrays += [pa.array(x.astype(float)) for x in (all_log, in_log, rooms)] + [blob] + lists
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _ENCODED.split(", ")])

    def run(batches):
        for batch in batches:
            at = 0
            for column in slices(batch.column("text")):
                yield rows(held.value, batch.slice(at, len(column)))
                at += len(column)

    return run


def _symbols(column) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a binary Arrow column, and the length of each sequence."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint16)[edges[0] // 2 : edges[-1] // 2]
    return flat, np.diff(edges) // 2


def _sequences(batches):
    """Groups of about BATCH_WORDS symbols: record batches without `ids`, the symbols, the lengths."""
    held, flats, sizes, total = [], [], [], 0

    def group():
        return held, np.concatenate(flats), np.concatenate(sizes).astype(np.int64)

    for whole in batches:
        at = whole.schema.get_field_index("ids")
        ends = np.cumsum(_symbols(whole.column(at))[1], dtype=np.int64)
        a = 0
        while a < whole.num_rows:
            spare = BATCH_WORDS - total + (int(ends[a - 1]) if a else 0)
            b = max(a + 1, min(int(np.searchsorted(ends, spare, side="right")) + 1, whole.num_rows))
            part = whole.slice(a, b - a)
            flat, size = _symbols(part.column(at))
            flats.append(flat)
            sizes.append(size)
            held.append(part)
            total += len(flat)
            a = b
            if total >= BATCH_WORDS:
                yield group()
                held, flats, sizes, total = [], [], [], 0
    if total:
        yield group()


def pieces_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of consecutive pieces of at most SPAN symbols, and which of them begin a text."""
    n = -(-sizes // SPAN)
    out = np.full(int(n.sum()), SPAN, np.int64)
    last = np.cumsum(n) - 1
    out[last] = sizes - (n - 1) * SPAN
    opens = np.zeros(len(out), bool)
    opens[last - n + 1] = True
    return out, opens


def fit(train: DataFrame, head: Head) -> Model:
    """`train`: doc_id, ids (symbols) of the training documents."""
    import pyarrow as pa

    symbols = OWN + 1 + HASHED
    prior = np.zeros(symbols)
    prior[0] = head.n_end
    own = head.symbol <= OWN
    prior[head.symbol[own]] = head.c[own]
    prior[OWN + 1 :] = head.bucket_c
    prior = (prior + 1) / (prior + 1).sum()

    rng = np.random.default_rng(11)
    move = np.full((STATES, STATES), 0.02) + np.eye(STATES)
    model = Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), None)
    e = prior * rng.gamma(1.0, size=(STATES, symbols)) + 0.1 * prior
    model.emit = e / e.sum(1, keepdims=True)

    spark, last = train.sparkSession, None
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    for _ in range(MAX_ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def expect(batches, now=now):
            total = None
            for _, flat, sizes in _sequences(batches):
                sizes, opens = pieces_of(sizes)
                got = now.value.expect(Packed(flat, sizes), opens)
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
            if total is not None:
                flat = np.concatenate([np.reshape(x, -1) for x in total])
                cuts = range(0, len(flat), PIECE)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([flat[a : a + PIECE].tobytes() for a in cuts], pa.binary())], names=["piece", "sums"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for k, x in zip(b.column("piece").to_pylist(), b.column("sums").to_pylist(), strict=True):
                    v = np.frombuffer(x)
                    sums[k] = sums[k] + v if k in sums else v
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["piece", "sums"])

        kind = "piece int, sums binary"
        # a few tasks a core, however many files: the sums that travel grow with the tasks
        stats = train.select("ids").coalesce(tasks).mapInArrow(expect, kind).repartition("piece").mapInArrow(add, kind).toArrow()
        pieces = dict(zip(stats.column("piece").to_pylist(), stats.column("sums").to_pylist(), strict=True))
        if not pieces:
            break
        flat = np.concatenate([np.frombuffer(pieces[k]) for k in sorted(pieces)])
        a, b = STATES, STATES + STATES * STATES
        model = Model.estimate(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:-1].reshape(STATES, symbols), prior)
        if last is not None and abs(flat[-1] - last) <= SETTLED * abs(last):
            break
        last = flat[-1]
    else:
        raise RuntimeError("the model did not settle")
    return model


def score(docs: DataFrame, mod: int = 7, out_class: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import pyarrow as pa

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(id_in().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (crc_mod(mod) == out_class).alias("held_out"))
    train = rows.where("not held_out").select("doc_id", "text")
    n_train = docs.select("doc_id").where(crc_mod(mod) != out_class).count()
    table = counts(train, scratch)
    head, cut, n_words, v_words = head_of(table, n_train)
    n_all, v_all = n_words + n_train, v_words + bool(n_train)
    body = rows.select("doc_id", "held_out", F.xxhash64("text").alias("version"), "text")
    coded = scratch.write(body.mapInArrow(_encode(spark.sparkContext.broadcast(head)), _ENCODED), "coded")
    now = spark.sparkContext.broadcast(fit(coded.where("not held_out").select("doc_id", "ids"), head))

    def run(batches):
        for held, flat, sizes in _sequences(batches):
            packed = Packed(flat, sizes)
            like = np.empty(len(sizes))
            like[packed.order] = now.value.forward(packed) / np.log(10)
            at = 0
            for part in held:
                own = pa.array(like[at : at + part.num_rows])
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], own], names=[*names, "hmm"])

    names = ["doc_id", "held_out", "version", "n_tokens", "known", "all_log", "in_log", "rooms"]
    kind = ", ".join(_ENCODED.split(", ")[:8]) + ", hmm double"
    got = coded.select(*names, "ids").mapInArrow(run, kind)
    rare = coded.select("doc_id", "version", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("doc_id", "version", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    tail = table.where(F.col("bin") < cut).select("h", "c")
    rare = rare.join(tail, "h").groupBy("doc_id", "version", "h").agg(F.first("times").alias("times"), F.first("c").alias("c"))
    log = F.col("times") * F.log10(F.col("c") + 1.0)
    rare = rare.groupBy("doc_id", "version").agg(F.sum("times").alias("r_known"), F.sum(log).alias("r_log"))
    out = got.join(rare, ["doc_id", "version"], "left").na.fill(0, ["r_known"]).na.fill(0.0, ["r_log"])
    return out.select(
        id_out().alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("r_known")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("all_log") + F.col("r_log") - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))).alias("base_score"),
        (F.col("hmm") + F.col("in_log") + F.col("r_log") - F.col("rooms")).alias("score"),
    )
