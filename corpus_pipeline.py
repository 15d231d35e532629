"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last adds
`copy`); between the stages the rows are written and read again.  Labels come from the labels table, test
items from the benchmark table of `sf_dir`.

Defined cases of every stage: an empty table gives an empty result; a null text is kept as null and counts as the
empty text; extra columns stay, whatever they are called, as the stages' own columns take names that are free.
"""

from __future__ import annotations

from clustrim.llm import leak, minhash, mixing, quality, substring
from clustrim.llm.common import Scratch

#: Words of a passage that the substring stage removes when it also stands earlier.
PASSAGE_WORDS = 20


def quality_classifier(spark, docs, sf_dir):
    """Rows that score 0.7 or more; rows are judged one by one, by their text alone, so repeated rows fare alike."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of links, 80 % of the shingles of five words: that of the smallest doc_id.

    Texts without words are in no group and stay; rows that share the kept doc_id stay; a null doc_id is the smallest.
    """
    return minhash.keep_one(docs, percent=80, width=5)


def substring_dedup(spark, docs, sf_dir):
    """All rows; a text loses every word of a window of PASSAGE_WORDS words that also starts earlier, n_chars follows.

    Rows that share a doc_id are one document, whose windows at one place are one window.
    """
    return substring.remove_repeats(docs, PASSAGE_WORDS)


def benchmark_decontamination(spark, docs, sf_dir):
    """Rows without a passage of a test item; rows that share a doc_id go together, also those with a null one."""
    return leak.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark, docs, sf_dir):
    """A row for each copy that the mix takes, numbered from 1 in `copy`; a column of that name is replaced.

    A null source is a source; documents without words have size 0 and as many copies as their source's rate gives.
    """
    return mixing.take(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
