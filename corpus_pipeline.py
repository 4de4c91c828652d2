"""A corpus from documents: rules, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
keep the columns of documents, whatever others there are beside doc_id, text and
source. Defined results, for each stage: an empty table gives an empty table;
ids may be null or repeated; what the stage's operator says of null, empty and
very long texts, ties and equal rows holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, mixing, packing, pii, quality_rules, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; equal
    rows all stay or all go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of a similarity of 0.8 or
    more on five-word shingles: that of the smallest id, null ids last. Texts
    that are null or empty are one group."""
    return simhash.keep_one(docs, **simhash.SIMILAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in such part, as the mix takes them. A null
    source is a source of its own; documents without words are not taken."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids. A null or empty text is the
    end token alone; equal rows are packed as often as they occur."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_rules", rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written in the shared folder and read
    again as the next one's documents, after which it is deleted. The last one
    stays for the reader."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


#: The near-duplicate components and the tokenizer have no SQL form.
ORACLE_SQL = None
