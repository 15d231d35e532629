"""Queries of the text operators: opN_<name>(spark, sf_dir), each over its whole table."""

from __future__ import annotations

from . import editprint, hmm, hostrank, leak, licenses, minhash, mixing, quality, substring, suffix
from .common import documents

#: The word pattern and its SQL form.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def op1_quality_classifier(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), 85, 3).drop("n_links")


def op3_edit_fingerprint(spark, sf_dir):
    return editprint.digest(documents(spark, sf_dir))


def edit_groups(spark, sf_dir):
    """The second half of op3's method on the same table: banding of the fingerprints and verification."""
    return editprint.near_groups(documents(spark, sf_dir))


def op4_hmm_scoring(spark, sf_dir):
    return hmm.score(documents(spark, sf_dir))


def op5_host_rank_filter(spark, sf_dir):
    return hostrank.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("trust", "distrust")


def op6_suffix_array_dedup(spark, sf_dir):
    return suffix.digest(documents(spark, sf_dir), 400)


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).drop("copies", "skey")


def op8_substring_dedup(spark, sf_dir):
    return substring.digest(documents(spark, sf_dir), 20)


def op9_benchmark_decontamination(spark, sf_dir):
    return leak.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_license_scan(spark, sf_dir):
    return licenses.scan(documents(spark, sf_dir))


SQL_SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
wins AS (SELECT doc_id, s, array_to_string(list_slice(words, s, s + 19), ' ') AS win
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)),
spread AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept
         FROM spread ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SQL_SUFFIX = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
pieces AS (SELECT doc_id, n, a, substring(h, 2 * a + 1, 2 * (1024 + 399)) AS piece FROM (SELECT *, unnest(range(0, n - 399, 1024)) AS a FROM d WHERE n >= 400)),
wins AS (SELECT doc_id, a + i AS s, hash(substring(piece, 2 * i + 1, 800)) AS win FROM (SELECT *, unnest(range(0, least(1024, n - 399 - a))) AS i FROM pieces)),
again AS (SELECT doc_id, s FROM wins JOIN (SELECT win FROM wins GROUP BY win HAVING count(*) > 1) USING (win)),
lead AS (SELECT doc_id, s, coalesce(s - lag(s) OVER w > 400, true) AS opens FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
spans AS (SELECT doc_id, min(s) AS b, max(s) + 400 AS e FROM (SELECT doc_id, s, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM lead) GROUP BY doc_id, g),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM (
         SELECT doc_id, e AS f, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY b), n) AS t FROM spans JOIN d USING (doc_id)
         UNION ALL SELECT doc_id, 0, min(b) FROM spans GROUP BY doc_id) JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, CASE WHEN n_removed IS NULL THEN h ELSE '' END))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

SQL_MINHASH = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(words, s, s + 2)) AS h FROM (
       SELECT doc_id, words, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [1] ELSE range(1, len(words) - 1) END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = w.doc_id
"""

SQL_MIXING = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len({WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u FROM documents),
s AS MATERIALIZED (SELECT source, source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
      FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
lv AS (SELECT 0 AS k, (SELECT sum(source_size)::DOUBLE / sum(w) FROM s) AS level
       UNION ALL
       SELECT k + 1, (SELECT (sum(source_size) - sum(CASE WHEN w * level > 3 * source_size THEN 3 * source_size ELSE 0 END))::DOUBLE
                             / sum(CASE WHEN w * level > 3 * source_size THEN 0 ELSE w END) FROM s)
       FROM lv WHERE k < 30),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, w * (SELECT max(level) FROM lv)) AS target FROM s),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size + 1e-9) END AS base FROM t),
c AS (SELECT d.*, r.* EXCLUDE (source), sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id) AS run FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (base + CASE WHEN run - size / 2 <= target - base * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_edit_fingerprint": op3_edit_fingerprint,
    "op4_hmm_scoring": op4_hmm_scoring,
    "op5_host_rank_filter": op5_host_rank_filter,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_license_scan": op10_license_scan,
    "edit_groups": edit_groups,
}
SQL = {
    "op2_minhash_near_dedup": SQL_MINHASH,
    "op6_suffix_array_dedup": SQL_SUFFIX,
    "op7_source_mixing": SQL_MIXING,
    "op8_substring_dedup": SQL_SUBSTRING,
    "op5_host_rank_filter": hostrank.sql(),
    "op10_license_scan": licenses.sql(),
}
