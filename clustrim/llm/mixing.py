"""Mixing sources to target weights by entropy balancing.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; a target stops at `limit`
times its source's size and the excess is shared again by weight (a water level found by scalar
aggregates).  Rates: the relative entropy of the mix, weighted by size, is least under the token
constraints; distributed Newton iterations solve its convex dual, one multiplier a value of each margin (the
source, and others if they are given), and documents are tilted by its exponential.  Rounding: every document takes the whole part of its rate;
one more copy goes to the documents that come first in hash order until the source's target is met as
nearly as it can be; the place where that happens is found by two histograms of hash bins and an exact
order inside one bin, so no source is ever gathered in one task.

Defined cases: null text has size 0; a null source is one source; empty table: empty result; all sizes
0: targets 0; rows that share doc_id and source stand at the same place of the order; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, fresh, ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Share of a target by which a constraint may be off, and steps after which that is an error.
SETTLED, MAX_STEPS = 1e-11, 500
#: Multipliers of a margin that the driver holds between steps at most; more are written.
FEW = 10_000
#: Bits of the hash order, and of one histogram level.
BITS, LEVEL = 52, 12


def hash_place(*cols: str) -> Column:
    """52 bits of md5, the same in any engine."""
    text = F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, scratch: Scratch, weights=(5, 2, 1), limit: int = 3) -> DataFrame:
    """(skey, source_size, target) from (skey, size)."""
    src = ranked(sizes.groupBy("skey").agg(F.sum("size").alias("source_size")), ["skey"], scratch)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    src = scratch.write(src.select("skey", "source_size", w.alias("w")), "sources")
    first = src.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total = first["t"] or 0
    level = total / first["w"] if first["w"] else 0.0
    while True:
        full = F.col("w") * F.lit(float(level)) > limit * F.col("source_size")
        got = src.agg(F.sum(F.when(full, limit * F.col("source_size")).otherwise(0)).alias("s"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w")).first()
        new = (total - (got["s"] or 0)) / got["w"] if got["w"] else level
        if new <= level:
            break
        level = new
    return src.select("skey", "source_size", F.least((limit * F.col("source_size")).cast("double"), F.col("w") * F.lit(float(level))).alias("target"))


def balance(rows: DataFrame, margins: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """(margin columns, cell_size, rate): the tilt of every combination of margin values in `rows`.

    rows: a column for each margin, size.  margins: column -> table (column, target).  Minimises the relative
    entropy of the mix to the documents, weighted by size, under sum(size * rate) = target for each value of
    each margin: rate = exp(sum of a document's multipliers), one multiplier a value.  Newton on the convex dual,
    margin by margin: a document has one value of a margin, so the margin's block of the Hessian is diagonal, and
    gradient and Hessian of a block are one Spark aggregate over the documents with their present rates.  It ends
    when every constraint is met to SETTLED of its target.  Values of target 0 or without words have rate 0.
    """
    names = list(margins)
    null = F.lit(None).cast("double")
    tilt = {c: scratch.write(t.select(c, "target", F.when(F.col("target") > 0, 0.0).otherwise(null).alias("m")), f"tilt_{c}") for c, t in margins.items()}

    few = {c: t.limit(FEW + 1).count() <= FEW for c, t in tilt.items()}

    def tilted(df: DataFrame) -> DataFrame:
        for c in names:
            own = tilt[c].select(c, F.col("m").alias(f"m_{c}"))
            df = df.join(F.broadcast(own) if few[c] else own, c)  # FEW rows at most, else an exchange that Spark can split
        return df.withColumn("rate", F.coalesce(F.exp(sum((F.col(f"m_{c}") for c in names), F.lit(0.0))), F.lit(0.0)))

    for _ in range(MAX_STEPS):
        off = 0.0
        for c in names:
            now = tilted(rows).groupBy(c).agg(F.sum(F.col("size") * F.col("rate")).alias("mass"))  # the Hessian's diagonal; less the target, the gradient
            step = F.least(F.lit(2.0), F.greatest(F.lit(-2.0), F.col("target") / F.col("mass") - 1))
            far = F.abs(F.col("mass") - F.col("target")) / F.col("target")
            new = tilt[c].join(now, c, "left").select(c, "target", F.when(F.col("mass") > 0, far).alias("far"), F.when(F.col("mass") > 0, F.when(far > SETTLED, F.col("m") + step).otherwise(F.col("m"))).alias("m"))
            if few[c]:
                got = new.collect()
                tilt[c] = rows.sparkSession.createDataFrame(got, new.schema)
                off = max([off, *(r["far"] for r in got if r["far"] is not None)])
            else:
                tilt[c] = scratch.write(new, f"tilt_{c}")
                scratch.drop(f"tilt_{c}", keep=1)
                off = max(off, tilt[c].agg(F.max("far")).first()[0] or 0.0)
        if off <= SETTLED:
            break
    else:
        raise RuntimeError("the multipliers did not settle; the targets may contradict each other")
    return tilted(rows.groupBy(*names).agg(F.sum("size").alias("cell_size"))).select(*names, "cell_size", "rate")


def source_key() -> Column:
    """Orders as the source by code point, null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def mix(docs: DataFrame, weights=(5, 2, 1), limit: int = 3) -> DataFrame:
    """Per row of `docs`: doc_id, skey, size, source_size, target, taken, copies."""
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch.write(docs.select("doc_id", source_key().alias("skey"), size.alias("size"), hash_place("doc_id").alias("u")), "rows")
    src = targets(rows, scratch, weights, limit)
    rate = balance(rows, {"skey": src.select("skey", "target")}, scratch)
    src = src.join(rate.drop("cell_size"), "skey")
    src = src.withColumn("base", F.floor(F.col("rate") + 1e-9)).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    src = scratch.write(src, "rates")

    shift1, shift2 = BITS - LEVEL, BITS - 2 * LEVEL
    bin1, bin2 = F.shiftright("u", shift1), F.shiftright("u", shift2)

    def boundary(hist: DataFrame, before: Column, name: str) -> DataFrame:
        """First bin whose running size reaches the need, and what lies before it."""
        run = before + F.sum("s").over(Window.partitionBy("skey").orderBy("bin"))
        got = hist.withColumn("run", run).where("run >= need")
        return got.groupBy("skey").agg(F.min("bin").alias(name), F.min_by(F.col("run") - F.col("s"), "bin").alias("before"))

    hist = rows.groupBy("skey", bin1.alias("bin")).agg(F.sum("size").alias("s")).join(src.select("skey", "need"), "skey")
    at1 = boundary(hist, F.lit(0), "at1")
    src = scratch.write(src.join(at1, "skey", "left"), "level1")
    inner = rows.join(src.select("skey", "need", "at1", "before"), "skey").where(bin1 == F.col("at1"))
    inner = scratch.write(inner, "inner")
    hist = inner.groupBy("skey", bin2.alias("bin"), "need", "before").agg(F.sum("size").alias("s"))
    at2 = boundary(hist, F.col("before"), "at2")
    src = scratch.write(src.drop("before").join(at2, "skey", "left"), "level2")
    last = inner.drop("before", "at1").join(src.select("skey", "at2", "before"), "skey").where(bin2 == F.col("at2"))
    run = F.col("before") + F.sum("size").over(Window.partitionBy("skey").orderBy("u", "doc_id"))
    stop = last.withColumn("run", run).where("run - size / 2 <= need").groupBy("skey").agg(F.max(F.struct("u", "doc_id")).alias("stop"))
    src = scratch.write(src.join(stop, "skey", "left").drop("need", "before", "rate"), "stops")

    here = F.struct("u", "doc_id")
    more = F.when(F.col("at1").isNull(), True).when(bin2 != F.col("at2"), bin2 < F.col("at2")).otherwise(F.coalesce(here <= F.col("stop"), F.lit(False)))
    out = rows.join(src, "skey").withColumn("copies", (F.col("base") + more.cast("int")).cast("long"))
    return out.select("doc_id", "skey", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take(docs: DataFrame, weights=(5, 2, 1), limit: int = 3) -> DataFrame:
    """`docs`, all columns, one row a copy taken, numbered from 1 in `copy` (which replaces such a column)."""
    i, k, n = (fresh(c, docs) for c in ("mix_id", "mix_key", "mix_copies"))
    plan = mix(docs, weights, limit).where("copies > 0").select(F.col("doc_id").alias(i), F.col("skey").alias(k), F.col("copies").alias(n)).distinct()
    found = docs.drop("copy").join(plan, docs["doc_id"].eqNullSafe(F.col(i)) & (source_key() == F.col(k)))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(i, k, n)
