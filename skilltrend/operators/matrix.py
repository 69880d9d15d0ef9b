"""Shares of postings per level, pivoted into a skill matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skilltrend.columns import (
    DEFAULT_COLUMNS,
    LEVELS,
    MATRIX_SIZE,
    STOP_WORDS,
    SYNONYMS,
    PostingColumns,
)
from skilltrend.functions.values import map_values, percentage
from skilltrend.plans.checkpoints import staged_at
from skilltrend.plans.stages import Stages

JUNIOR, MID, SENIOR = LEVELS
DIFF = "Junior_to_Senior_Diff"
CHANGE = "Total_Rel_Change_Pct"
MID_DIFF = "Junior_to_Mid_Diff"
SENIOR_DIFF = "Mid_to_Senior_Diff"
RANK = "rank"
MAX_LEVELS = 1000


def standardize_skills(
    df: DataFrame,
    synonyms: Mapping[str, str] | DataFrame = SYNONYMS,
    stop_words: Sequence[str] | DataFrame = STOP_WORDS,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """Fold synonyms in one pass, then drop stop-words.

    Both may also come as tables: stop-words with one column, synonyms with two,
    the spelling and what it stands for (the least, if it is named twice).
    """
    if isinstance(synonyms, DataFrame):
        table = synonyms.toDF("_spelling", "_name").groupBy("_spelling").agg(F.min("_name").alias("_name"))
        joined = df.join(table, F.col(cols.skill) == F.col("_spelling"), "left")
        df = joined.withColumn(cols.skill, F.coalesce("_name", cols.skill)).select(df.columns)
    else:
        df = df.withColumn(cols.skill, map_values(F.col(cols.skill), synonyms))
    if isinstance(stop_words, DataFrame):
        words = stop_words.toDF(cols.skill).distinct()
        return df.dropna(subset=[cols.skill]).join(words, cols.skill, "left_anti").select(df.columns)
    return df.where(~F.col(cols.skill).isin(list(stop_words)))


def skill_posting_counts(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Distinct postings per (profession, level, skill); a null key counts once."""
    serial = F.col(cols.serial)
    distinct = F.count_distinct(serial) + F.max(serial.isNull().cast("bigint"))
    return df.groupBy(cols.profession, cols.level, cols.skill).agg(distinct.alias("jobs_with_skill"))


def tagged_totals(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Distinct postings per (profession, level) among tagged rows only."""
    serial = F.col(cols.serial)
    distinct = F.count_distinct(serial) + F.max(serial.isNull().cast("bigint"))
    return df.groupBy(cols.profession, cols.level).agg(distinct.alias(cols.total))


def share_by_level(
    counts: DataFrame, totals: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Percentage of a level's postings that need each skill.

    No broadcast is forced: both sides are aggregates, and adaptive execution
    broadcasts the totals once it has measured them.
    """
    share = percentage(F.col("jobs_with_skill"), F.col(cols.total))
    return counts.join(totals, [cols.profession, cols.level], "left").withColumn("share_pct", share)


def found_levels(
    share: DataFrame, max_levels: int = MAX_LEVELS, cols: PostingColumns = DEFAULT_COLUMNS
) -> list[str | None]:
    """All level values in the data, null last.

    More than ``max_levels`` raise: so many columns are no table to look at. The
    long form that goes into the pivot answers the same questions at any number.
    """
    level = F.col(cols.level).alias("level")
    rows = share.select(level).distinct().orderBy(F.asc_nulls_last("level")).limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} levels: raise max_levels or use the long form")
    return [row["level"] for row in rows]


def level_names(levels: Sequence[str | None], cols: PostingColumns = DEFAULT_COLUMNS) -> list[str]:
    """Column names of levels: their own, with ``_level`` appended while another column has it.

    Column names do not tell upper from lower case. A null level is called ``null``.
    """
    used = {name.lower() for name in (cols.profession, cols.skill, DIFF, CHANGE, MID_DIFF, SENIOR_DIFF, RANK)}
    names = []
    for level in levels:
        name = "null" if level is None else level
        while name.lower() in used:
            name += "_level"
        used.add(name.lower())
        names.append(name)
    return names


def level_pivot(
    share: DataFrame,
    levels: Sequence[str | None] | None = LEVELS,
    cols: PostingColumns = DEFAULT_COLUMNS,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """One row per (profession, skill), one share column per level, 0.0 if none.

    A skill seen only at other levels keeps its row. ``levels=None`` gives every
    level of the data its column next to the three usual ones, named as
    ``level_names`` says. Written as conditional sums, which shuffle once where
    ``pivot`` shuffles twice.
    """
    if levels is None:
        extra = [level for level in found_levels(share, max_levels, cols) if level not in LEVELS]
        levels = [*LEVELS, *extra]
    sums = [
        F.coalesce(F.sum(F.when(F.col(cols.level).eqNullSafe(F.lit(level)), F.col("share_pct"))), F.lit(0.0)).alias(name)
        for level, name in zip(levels, level_names(levels, cols))
    ]
    return share.groupBy(cols.profession, cols.skill).agg(*sums)


def add_changes(pivot: DataFrame) -> DataFrame:
    """Junior to Senior difference and relative change; 100.0 where Junior is 0."""
    for name in LEVELS:
        if name not in pivot.columns:
            pivot = pivot.withColumn(name, F.lit(0.0))
    junior, senior = F.col(JUNIOR), F.col(SENIOR)
    change = F.when(junior == 0, F.lit(100.0)).otherwise((senior - junior) / junior * 100)
    return pivot.withColumns({DIFF: senior - junior, CHANGE: change})


def add_step_changes(pivot: DataFrame) -> DataFrame:
    """Junior to Mid and Mid to Senior differences."""
    return pivot.withColumns(
        {MID_DIFF: F.col(MID) - F.col(JUNIOR), SENIOR_DIFF: F.col(SENIOR) - F.col(MID)}
    )


def in_level_order(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """The columns of a matrix with all changes, from Junior to Senior."""
    return df.select(
        cols.profession, cols.skill, *LEVELS, MID_DIFF, SENIOR_DIFF, DIFF, CHANGE, RANK
    )


def rank_within(
    df: DataFrame, by: str, k: int | None, cols: PostingColumns = DEFAULT_COLUMNS, stages: Stages | None = None
) -> DataFrame:
    """Rank rows of each profession by ``by``, highest first, and keep ``k``.

    The limit is applied before the shuffle too, so a profession that fills the
    table sends only ``k`` rows per task. Without a limit ranks are counted in
    ranges, so that no task sorts a whole profession.
    """
    if k is None:
        return _ranked_in_ranges(df, by, cols, stages)
    window = Window.partitionBy(cols.profession).orderBy(F.desc(by), F.asc(cols.skill))
    ranked = df.withColumn(RANK, F.row_number().over(window).cast("bigint"))
    return ranked.where(F.col(RANK) <= k)


def _ranked_in_ranges(df: DataFrame, by: str, cols: PostingColumns, stages: Stages | None) -> DataFrame:
    """``df`` with each row's rank, from places within ranges of a sort and how many rows come before a range.

    The ranges are stored at once: a second run of the sort might cut them
    elsewhere. Their folder goes with the run ``stages`` if there is one.
    """
    order = [F.asc(cols.profession), F.desc(by), F.asc(cols.skill)]
    # The increasing id's upper bits name the range, its lower ones the place in it.
    cut = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    cut = cut.withColumn("_range", F.shiftright("_id", 33))
    cut, path = staged_at(cut, "ranges")
    if stages is not None:
        stages.adopt(cut, path)
    parts = cut.groupBy(cols.profession, "_range").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    ahead = Window.partitionBy(cols.profession).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per profession and range.
    starts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).select(
        F.col(cols.profession).alias("_profession"), F.col("_range").alias("_part"), "_first", "_before"
    )
    same = F.col(cols.profession).eqNullSafe(F.col("_profession")) & (F.col("_range") == F.col("_part"))
    ranked = cut.join(starts, same).withColumn(RANK, F.col("_before") + F.col("_id") - F.col("_first") + 1)
    return ranked.select(*df.columns, RANK)


def evolution_matrix(
    share: DataFrame,
    top_k: int | None = MATRIX_SIZE,
    levels: Sequence[str | None] | None = LEVELS,
    cols: PostingColumns = DEFAULT_COLUMNS,
    max_levels: int = MAX_LEVELS,
    stages: Stages | None = None,
) -> DataFrame:
    """The matrix of all professions, ranked by Junior share in each."""
    named = share.where(F.col(cols.profession).isNotNull())
    return rank_within(add_changes(level_pivot(named, levels, cols, max_levels)), JUNIOR, top_k, cols, stages)


def mention_counts(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Mentions, not postings, per (profession, level, skill)."""
    return df.groupBy(cols.profession, cols.level, cols.skill).agg(F.count("*").alias("len"))


def most_mentioned(counts: DataFrame, k: int | None = None, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Mention counts, highest first; ties by profession, level and skill. ``k`` keeps the first rows."""
    ordered = counts.orderBy(F.desc("len"), cols.profession, cols.level, cols.skill)
    return ordered if k is None else ordered.limit(k)


def merge_mentions(counts: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Add up mention counts after skills were renamed."""
    return counts.groupBy(cols.profession, cols.level, cols.skill).agg(F.sum("len").alias("len"))


def mention_share(counts: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Share of a level's mentions that go to each skill."""
    keys = [cols.profession, cols.level]
    totals = counts.groupBy(*keys).agg(F.sum("len").alias("total_mentions_at_level"))
    return counts.join(totals, keys).withColumn(
        "share_pct", percentage(F.col("len"), F.col("total_mentions_at_level"))
    )
