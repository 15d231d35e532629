"""URL filters: host rules first, then link-graph propagation over hosts.

Trust starts from the hosts with allowed pages and follows the links; distrust starts from the hosts
with blocked pages and follows them backwards (who links to bad hosts is suspect).  Both are
personalised PageRanks, iterated in Spark over the host edges that the pages' absolute links give until no
host's rank moves by more than `SETTLED` of itself, so that every host that a seed reaches has its share; a
host whose share of distrust is above `threshold` is blocked.

Defined cases: a null url, or one without ://, has empty host and path, no rule, and is judged by the
method like any host; null html has no links; links of a page to its own host do not count; hosts that
nothing reaches are allowed; repeated pages count once each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""
DAMPING, SETTLED = 0.85, 1e-9
#: Ranks that have not settled by then are an error.
MAX_ROUNDS = 10_000
#: Rounds of the SQL form, which cannot stop by itself; it agrees where the ranks settle within them.
ROUNDS = 12


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping=DAMPING, rounds=MAX_ROUNDS, settled=SETTLED) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, good, bad), each seed column summing to 1 or 0.

    A host without links onward hands its rank back to the seeds.  That only scales all ranks alike, so the
    rounds leave it out and the result is scaled to the sum of the seeds.
    """
    e = edges
    out_ = e.groupBy("src").agg(F.sum("n").alias("out"))
    in_ = e.groupBy("dst").agg(F.sum("n").alias("inn"))
    e = scratch.write(e.join(out_, "src").join(in_, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("f"), (F.col("n") / F.col("inn")).alias("b")), "edges")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("host")).union(seeds.select("host")).distinct().join(seeds, "host", "left")
    rank = scratch.write(nodes.select("host", F.coalesce("good", F.lit(0.0)).alias("good"), F.coalesce("bad", F.lit(0.0)).alias("bad")).select("*", F.col("good").alias("t"), F.col("bad").alias("d")), "rank")
    for _ in range(rounds):
        ahead = e.join(rank.where("t > 0").select(F.col("host").alias("src"), "t"), "src").select(F.col("dst").alias("host"), (F.col("t") * F.col("f")).alias("t"), F.lit(0.0).alias("d"))
        back = e.join(rank.where("d > 0").select(F.col("host").alias("dst"), "d"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("d") * F.col("b")).alias("d"))
        flow = ahead.union(back).groupBy("host").agg(F.sum("t").alias("ft"), F.sum("d").alias("fd"))
        step = lambda seed, flow: F.col(seed) + damping * F.coalesce(flow, F.lit(0.0))
        new = rank.join(flow, "host", "left").select("host", "good", "bad", step("good", "ft").alias("t"), step("bad", "fd").alias("d"), F.col("t").alias("t0"), F.col("d").alias("d0"))
        new = scratch.write(new, "rank")
        scratch.drop("rank", keep=1)
        moved = new.agg(F.count_if((F.abs(F.col("t") - F.col("t0")) > settled * F.col("t")) | (F.abs(F.col("d") - F.col("d0")) > settled * F.col("d"))).alias("m")).first()["m"]
        rank = new.drop("t0", "d0")
        if not moved:
            break
    else:
        raise RuntimeError("host ranks did not settle")
    sums = rank.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("t").alias("t"), F.sum("d").alias("d")).first()
    scaled = lambda c, seed: F.col(c) * F.lit((sums[seed] or 0.0) / (sums[c] or 1.0))
    return rank.select("host", scaled("t", "good").alias("trust"), scaled("d", "bad").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Per row of `pages`: page_id, host, path, rule, verdict, trust, distrust."""
    scratch = Scratch(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rows = rows.withColumn("rule", by_rule(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2])).withColumn("ruled", by_rule(F.col("host"), F.col("path"), rules, lambda r: r[0]))
    links = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    edges = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    seeds = rows.where("ruled is not null").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    seeds = scratch.write(seeds, "seeds")
    sums = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    share = lambda c: (F.col(c) / F.lit(float(sums[c] or 1) or 1.0)).alias(c) if sums[c] else F.lit(0.0).alias(c)
    scores = propagate(edges, seeds.select("host", share("good"), share("bad")), scratch)
    out = rows.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > (F.col("trust") + F.col("distrust")) * threshold * (1 + 1e-9)
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def sql(rules=RULES) -> str:
    """The same in DuckDB: unrolled rounds."""
    host = f"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in longest) + " END"
    link = LINK.replace("'", "''")
    parts = [
        f"p AS MATERIALIZED (SELECT page_id, html, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"r AS MATERIALIZED (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled FROM p)",
        f"l AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p)",
        "g AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND src <> dst GROUP BY ALL)",
        "e AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS f, n / sum(n) OVER (PARTITION BY dst) AS b FROM g)",
        "s AS (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM r WHERE ruled IS NOT NULL GROUP BY host)",
        "v AS MATERIALIZED (SELECT host, coalesce(good / nullif((SELECT sum(good) FROM s), 0), 0)::DOUBLE AS good, coalesce(bad / nullif((SELECT sum(bad) FROM s), 0), 0)::DOUBLE AS bad, host IN (SELECT src FROM e) AS o, host IN (SELECT dst FROM e) AS i FROM (SELECT host FROM s UNION SELECT src FROM e UNION SELECT dst FROM e) LEFT JOIN s USING (host))",
        "k0 AS (SELECT host, good AS t, bad AS d FROM v)",
    ]
    for k in range(ROUNDS):
        keep = f"{1 - DAMPING!r} + {DAMPING} * coalesce((SELECT sum({{0}}) FROM k{k} JOIN v USING (host) WHERE NOT {{1}}), 0)"
        parts.append(
            f"k{k + 1} AS MATERIALIZED (SELECT host, ({keep.format('t', 'o')}) * good + {DAMPING} * coalesce(ft, 0) AS t, ({keep.format('d', 'i')}) * bad + {DAMPING} * coalesce(fd, 0) AS d FROM v"
            f" LEFT JOIN (SELECT dst AS host, sum(t * f) AS ft FROM e JOIN k{k} ON src = host GROUP BY dst) USING (host)"
            f" LEFT JOIN (SELECT src AS host, sum(d * b) AS fd FROM e JOIN k{k} ON dst = host GROUP BY src) USING (host))"
        )
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(d, 0) > (coalesce(t, 0) + coalesce(d, 0)) * 0.5 * (1 + 1e-9) THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN k{ROUNDS} USING (host)"
