"""Cleaning postings and counting them per profession and level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skilltrend.columns import (
    DEFAULT_COLUMNS,
    KEPT_CONTRACT_TYPES,
    KEPT_STATUSES,
    LEVEL_MAP,
    PROFESSION_RULES,
    PostingColumns,
)
from skilltrend.functions.values import (
    in_date_range,
    map_values,
    parse_month_first,
    replace_patterns,
    submitted_timestamp,
)
from skilltrend.plans.checkpoints import staged_at
from skilltrend.plans.stages import Stages

#: Keys with copies, and bytes of these keys, that are broadcast at most.
BROADCAST_KEYS, BROADCAST_BYTES = 500_000, 32 << 20


def normalize_profession(
    df: DataFrame,
    rules: Sequence[tuple[str, str]] = PROFESSION_RULES,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """Fold profession variants into one code."""
    return df.withColumn(cols.profession, replace_patterns(F.col(cols.raw_profession), rules))


def keep_status_and_type(
    df: DataFrame,
    statuses: Sequence[str] = KEPT_STATUSES,
    contract_types: Sequence[str] = KEPT_CONTRACT_TYPES,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """Keep rows whose status and contract type are both listed."""
    return df.where(
        F.col(cols.status).isin(list(statuses)) & F.col(cols.contract_type).isin(list(contract_types))
    )


def keep_professions(
    df: DataFrame, professions: Sequence[str] | None, cols: PostingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Keep the listed professions; ``None`` keeps all."""
    if professions is None:
        return df
    return df.where(F.col(cols.profession).isin(list(professions)))


def one_row_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; null keys share one row.

    All columns break the ties that ``order`` leaves, so the survivor does not
    depend on partitioning. Spark cuts the rank before the shuffle, so each
    task sends at most one row per key however often a key repeats.
    """
    ties = [F.col(name).asc_nulls_last() for name in df.columns if name not in keys]
    window = Window.partitionBy(*keys).orderBy(*order, *ties)
    return (
        df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")
    )


def _small(df: DataFrame, key: str) -> bool:
    number, size = df.agg(F.count("*"), F.sum(F.octet_length(F.col(key).cast("string")) + 24)).first()
    return number <= BROADCAST_KEYS and (size or 0) <= BROADCAST_BYTES


def latest_row_per_key(df: DataFrame, key: str, latest: Column, stages: Stages | None = None) -> DataFrame:
    """The row of each key with the greatest ``latest``; null keys share one row, null comes last.

    For rows with long texts, which never go through a sort here, and through a
    shuffle only if very many keys have copies. Counts of the key and ``latest``
    alone tell which keys have copies and when their last one is from; the rows
    are then held against these few. Rows that tie go on to a hash of all their
    columns, and equal rows are folded, so the survivor does not depend on
    partitioning. Runs a job for the keys with copies, whose small folder goes
    with the run ``stages`` if there is one.
    """
    narrow = df.select(F.col(key).alias("_key"), latest.alias("_at"))
    times = narrow.groupBy("_key", "_at").agg(F.count("*").alias("_rows"))
    # A struct with a null comes before all others.
    last = times.groupBy("_key").agg(F.max(F.struct("_at", "_rows")).alias("_last"), F.sum("_rows").alias("_copies"))
    repeated = last.where("_copies > 1").select("_key", F.col("_last._at").alias("_at"), F.col("_last._rows").alias("_ties"))
    repeated, path = staged_at(repeated, "repeated-keys")
    if stages is not None:
        stages.adopt(repeated, path)
    side = F.broadcast(repeated) if _small(repeated, "_key") else repeated.hint("shuffle_hash")
    joined = df.join(side, F.col(key).eqNullSafe(F.col("_key")), "left")
    wanted = joined.where(F.col("_ties").isNull() | latest.eqNullSafe(F.col("_at")))
    single = wanted.where(F.col("_ties").isNull() | (F.col("_ties") == 1)).select(df.columns)
    ties = repeated.where("_ties > 1")
    if ties.isEmpty():
        return single
    tied = wanted.where("_ties > 1").select(*df.columns, F.xxhash64(*df.columns).alias("_hash"))
    least = tied.groupBy(F.col(key).alias("_key")).agg(F.min("_hash").alias("_least"))
    least = F.broadcast(least) if _small(ties, "_key") else least.hint("shuffle_hash")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_least"))
    return single.unionAll(tied.join(least, same).select(df.columns).distinct())


def dedupe_postings(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS, stages: Stages | None = None) -> DataFrame:
    """One row per posting key, the latest submission winning.

    Rows with the HTML scope or its text are wide: they are not sorted. Others
    are ranked, all their columns breaking ties.
    """
    submitted = F.col(cols.submitted)
    if dict(df.dtypes)[cols.submitted] == "string":
        # Only ranks the copies; the survivor's date is parsed strictly later.
        submitted = parse_month_first(submitted, strict=False)
    if cols.scope in df.columns or cols.text in df.columns:
        return latest_row_per_key(df, cols.serial, submitted, stages)
    return one_row_per_key(df, [cols.serial], [submitted.desc_nulls_last()])


def map_levels(
    df: DataFrame,
    mapping: Mapping[str, str] | DataFrame = LEVEL_MAP,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """Overwrite level codes by level names; unknown codes pass through.

    The names may also come as a table with two columns, the code and what it
    stands for (the least, if it is named twice).
    """
    if isinstance(mapping, DataFrame):
        table = mapping.toDF("_code", "_name").groupBy("_code").agg(F.min("_name").alias("_name"))
        joined = df.join(table, F.col(cols.level) == F.col("_code"), "left")
        return joined.withColumn(cols.level, F.coalesce("_name", cols.level)).select(df.columns)
    return df.withColumn(cols.level, map_values(F.col(cols.level), mapping))


def clean_postings(
    df: DataFrame,
    date_range: Sequence | None = None,
    *,
    professions: Sequence[str] | None = None,
    statuses: Sequence[str] = KEPT_STATUSES,
    contract_types: Sequence[str] = KEPT_CONTRACT_TYPES,
    profession_rules: Sequence[tuple[str, str]] = PROFESSION_RULES,
    level_map: Mapping[str, str] | DataFrame = LEVEL_MAP,
    strict_dates: bool = True,
    end_inclusive_day: bool = False,
    cols: PostingColumns = DEFAULT_COLUMNS,
    stages: Stages | None = None,
) -> DataFrame:
    """Raw postings to unique cleaned postings.

    The order matters: the date range is tested on the surviving copy, after
    duplicates are gone.
    """
    df = normalize_profession(df, profession_rules, cols)
    df = keep_professions(df, professions, cols)
    df = keep_status_and_type(df, statuses, contract_types, cols)
    df = dedupe_postings(df, cols, stages)
    df = df.withColumn(cols.submitted_at, submitted_timestamp(df, cols.submitted, strict_dates))
    df = df.where(in_date_range(F.col(cols.submitted_at), date_range, end_inclusive_day))
    return map_levels(df, level_map, cols)


def level_totals(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Postings per (profession, level), with or without skills."""
    return df.groupBy(cols.profession, cols.level).agg(F.count("*").alias(cols.total))
