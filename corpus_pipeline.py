"""From raw documents to packed sequences, stage by stage.

Each stage works on all rows that the one before kept. The toxicity machine
learns from the labels of the rows that ``op1_toxicity`` learns from, near
duplicates share 0.8 of their five-word shingles, and the last stage packs the
ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skilltrend.llm.common import held_out, table, tokenizer_path
from skilltrend.llm.decontaminate import without_copies
from skilltrend.llm.exact_dedup import without_exact_duplicates
from skilltrend.llm.minhash import without_near_duplicates
from skilltrend.llm.packing import packed_sequences
from skilltrend.llm.toxicity import fit_toxicity, without_toxic
from skilltrend.plans.checkpoints import staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the machine, fitted on labelled rows, predicts toxic.

    Null and empty texts are scored by the constant term alone; repeated rows stay or
    go together; without any label in the table nothing is learnt and all rows score 0.5.
    All columns stay, an empty table gives none.
    """
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return without_toxic(docs, fit_toxicity(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of the documents whose texts are equal but for white space.

    Null counts as empty, so one row without text stays; rows that repeat an id stay or
    go together.
    All columns stay, an empty table gives none.
    """
    return without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each component of documents that share 0.8 of their five-word shingles.

    Texts without words are linked with nothing and stay; rows that repeat an id stay or
    go together. All columns stay, an empty table gives none.
    """
    return without_near_duplicates(docs, words=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that copy a benchmark item or a part of one.

    Null and empty texts copy nothing and stay; repeated rows stay or go together.
    All columns stay, an empty table or benchmark drops nothing.
    """
    return without_copies(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents into sequences: one row per piece.

    A null or empty text is one piece, its end id; repeated rows and rows with a null id
    are packed one by one. Further columns stay behind, an empty table gives none.
    """
    return packed_sequences(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_copies),
    ("best_fit_packing", pack),
]

#: A fitted model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
