"""A corpus from raw documents to packed training sequences, in stages that each write their result.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Columns are found by name,
whatever others there are, and all but the last stage give back the columns they got. Null, empty and very long texts,
nulls in other columns, ties and repeated rows have the results that each stage's docstring states; an empty table
gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import mcd, mil, mixing, packing, simhash
from weftgraph.llm.cluster import discard_on_exit, shared_folder

#: Token weights of the mixture by domain; low quality is gone by then.
TARGETS = {"quality 1, toxic 0": 0.97, "quality 1, toxic 1": 0.03}
#: Ids that a worker keeps while packing: few, since workers also serve the other stages.
KEPT_WORDS = 100_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more. A null or empty text is scored as one passage without words;
    repeated rows get one score and go or stay together; rows without doc_id are scored and teach nothing."""
    return mil.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group's robust ellipsoid. A null or empty text has no
    words and goes; null lang or source form groups of their own; a distance equal to the limit is within."""
    return mcd.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest doc_id; of rows of one doc_id the one of the
    smallest fingerprint and hashes, of repeated rows any one. All texts without words are one group, and rows without
    doc_id stay only where their group has no other."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mixture's rates say, a rate's fraction rounded by a hash of doc_id, so that
    repeated rows are taken alike. A text without words has a rate like others of its posterior."""
    return mixing.resample(docs, mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences. A null or empty text is its end token alone; repeated
    rows are packed as often as they are there; long texts are cut into pieces of 2048 tokens."""
    return packing.pack(docs, kept_words=KEPT_WORDS)


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("simhash near-dedup", near_duplicates), ("mixing", mixture), ("best-fit packing", packing_stage)]

#: Learned and iterative stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{i}.parquet")
        discard_on_exit(spark, f"{at}/{i}.parquet")
        docs = spark.read.parquet(f"{at}/{i}.parquet")
    return docs
