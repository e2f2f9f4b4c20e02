"""A corpus pipeline over `documents`: each stage takes all that the one before it kept.

1. toxicity: documents predicted toxic go.
2. near_duplicates: of each SimHash component the row of the smallest doc_id stays.
3. substrings: repeated lines and passages are cut out of all documents but the first; n_chars follows.
4. decontamination: documents that hold a benchmark passage, within a fifth of its words, go.
5. mixing: every document left gets its rate and number of copies.

A document without an id takes part in all stages by its text; as a near duplicate it comes after all
with an id. Null and empty texts are not toxic, are near duplicates of each other, and have
nothing to cut; an empty table gives no rows; columns other than those of documents are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm import decontaminate, lines, mixing, simhash, toxicity
from tarnbeck.llm.tables import bound_batches, drop_since, mark, newest, read, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic; null and empty texts aren't."""
    labels = read(spark, sf_dir, "labels")
    scored = toxicity.toxicity_scores(docs, labels, carry=COLUMNS)
    return scored.filter("predicted = 0").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; of null and empty texts, all near duplicates, one row stays."""
    bound_batches(spark)
    return simhash.one_of_each(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text cut; null texts stay null, and rows that lose nothing keep their n_chars."""
    bound_batches(spark)
    cut = lines.dedup_lines(docs.select(*COLUMNS))
    n_chars = F.when(F.size("removed_starts") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage; null and empty texts hold none."""
    return decontaminate.remove_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its tokens, posteriors, rate and copies; null and empty texts have 0 tokens."""
    domains = mixing.label_domains(read(spark, sf_dir, "labels"), toxic=False)
    mixed = mixing.mix_sources(docs, domains, mixing.CLEAN_TARGETS)
    shares = [F.col("domain_posterior")[d].alias(f"p_{d}") for d in mixing.CLEAN_TARGETS]
    return mixed.select(*COLUMNS, "tokens", *shares, "rate", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Trained classifiers, reachability and edit distances are beyond SQL; the tests hold each stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each returns is written and read again. What a stage wrote
    on its way goes once its result is there, and that result once the next one is."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_since(spark, max(0, since - 1) if name != STAGES[0][0] else since, [newest()])
    return STAGES[-1][1](spark, docs, sf_dir)
