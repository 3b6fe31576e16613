"""The corpus pipeline: toxic documents go, repeated passages go, one of near-duplicate documents stays, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents.

Defined cases: a row whose text is null counts as one with an empty text in every stage; such rows are near-duplicates of
each other, and one stays. A null doc_id comes after all others in near-duplicates and before them in repeated passages;
ties go to the smaller doc_id. Rows that repeat doc_id and text are one document to the passages, and one of them
stays after near-duplicates. Very long texts are read whole. An empty table gives an empty result in every stage, and
without labels nothing is toxic. Further columns go through to the near-duplicate stage, a column named removed_lines
replaced by the passages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cavern.llm import linededup, packing, simhash, toxicity
from cavern.llm.common import passing_folder, table
from cavern.llm.queries import vocabulary_path

#: The toxicity models have no SQL, so neither has the pipeline; tests hold it against brute force.
ORACLE_SQL = None

#: Near-duplicates of the pipeline: five-word shingles and their similarity.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents predicted toxic go. The models learn from the labelled rows of the folder's documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages an earlier document has go from the later one; n_chars follows, and no document goes."""
    found = linededup.dedup_lines(docs)
    n_chars = F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*(n_chars if c == "n_chars" else c for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component of near-duplicates, the document of the least doc_id stays."""
    return simhash.one_of_each(docs, SHINGLE_WORDS, SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the pieces of the documents left, and their places in sequences."""
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written as Parquet beside the checkpoints and read again."""
    folder = passing_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
