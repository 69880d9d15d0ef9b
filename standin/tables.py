"""The test tables dressed as job postings.

An order is a posting, its priority the level code, its customer's segment the
profession, and the names of the parts in its line items are its skills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.operators.extract import distinct_texts
from skilltrend.operators.matrix import evolution_matrix, share_by_level, skill_posting_counts
from skilltrend.operators.postings import clean_postings, level_totals
from skilltrend.plans.checkpoints import staged
from skilltrend.sources.tables import read_table

STATUSES = ("F", "O")
CONTRACT_TYPES = ("FULL_TIME", "CONTRACT")
LEVEL_CODES = {
    "1-URGENT": "Junior",
    "2-HIGH": "Junior",
    "3-MEDIUM": "Mid-level",
    "4-NOT SPECIFIED": "Senior",
}
DATES = ("1996-01-01", "2000-12-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    kind = (
        F.when(price >= 100000, "FULL_TIME").when(price >= 50000, "CONTRACT").otherwise("INTERNSHIP")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias(C.serial),
            F.col("c_mktsegment").alias(C.raw_profession),
            F.col("o_orderstatus").alias(C.status),
            kind.alias(C.contract_type),
            F.col("o_orderdate").alias(C.submitted),
            F.col("o_orderpriority").alias(C.level),
            F.col("c_name").alias(C.title),
        )
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_postings(
        raw_postings(spark, sf_dir),
        DATES,
        statuses=STATUSES,
        contract_types=CONTRACT_TYPES,
        level_map=LEVEL_CODES,
    )


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw postings, pages as their HTML.

    Three documents in a row are copies of one posting with dates of their own,
    every tenth row comes twice, and levels may be null or unknown.
    """
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    doc_id = F.col("doc_id")
    codes = F.array(*map(F.lit, [*LEVEL_CODES, "INTERN"]))
    level = F.when(doc_id % 17 != 0, F.element_at(codes, (doc_id % (len(LEVEL_CODES) + 1) + 1).cast("int")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc_id * 37 % 300).cast("int"))
    raw = docs.join(pages, doc_id == F.col("page_id"), "left").select(
        (doc_id - doc_id % 3).alias(C.serial),
        F.when(doc_id % 50 != 0, F.col("lang")).alias(C.raw_profession),
        F.when(doc_id % 11 == 0, "DRAFT").otherwise(STATUSES[0]).alias(C.status),
        F.when(doc_id % 13 == 0, "INTERNSHIP").otherwise(CONTRACT_TYPES[0]).alias(C.contract_type),
        F.date_format(day, "M/d/yyyy").alias(C.submitted),
        level.alias(C.level),
        F.col("source").alias(C.title),
        F.coalesce(F.col("html"), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))).alias(C.scope),
        doc_id,
    )
    return raw.unionAll(raw.where(doc_id % 10 == 0))


def skill_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(serial, skill) for every line item."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias(C.serial), F.col("p_name").alias(C.skill))
    )


def tagged(spark: SparkSession, sf_dir: str, cleaned: DataFrame | None = None) -> DataFrame:
    cleaned = cleaned or postings(spark, sf_dir)
    return cleaned.join(skill_links(spark, sf_dir), C.serial)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_totals(postings(spark, sf_dir))


def share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerators and denominators from one cleaning run, which is staged."""
    cleaned = staged(postings(spark, sf_dir), "postings")
    counts = skill_posting_counts(tagged(spark, sf_dir, cleaned))
    return share_by_level(counts, level_totals(cleaned))


def matrix(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return evolution_matrix(share(spark, sf_dir), **options)


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: text, title and profession from their own columns."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(C.serial),
        F.col("source").alias(C.title),
        F.col("lang").alias(C.profession),
        F.col("text").alias(C.text),
        F.sha2("text", 256).alias(C.text_id),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_texts(document_postings(spark, sf_dir))
