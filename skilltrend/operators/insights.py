"""What a reader asks of the matrix, the totals and the tagged postings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS, LEVELS, PostingColumns
from skilltrend.functions.values import percent_label
from skilltrend.operators.matrix import DIFF, JUNIOR, MID, RANK, SENIOR, rank_within
from skilltrend.operators.postings import one_row_per_key
from skilltrend.plans.checkpoints import discard, staged_at

ALL = "All"
#: Postings whose keys go into the scan of the texts as a list, and those whose rows are broadcast.
LISTED, BROADCAST = 2000, 200_000


def profession_list(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Sorted distinct professions, nulls left out."""
    names = df.select(cols.profession).where(F.col(cols.profession).isNotNull())
    return names.distinct().orderBy(cols.profession)


def level_list(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Sorted distinct levels; a null level comes last."""
    return df.select(cols.level).distinct().orderBy(F.col(cols.level).asc_nulls_last())


def _levels_to_rows(df: DataFrame, keys: Sequence[str], level: str, value: str) -> DataFrame:
    rows = df.unpivot(list(keys), list(LEVELS), level, value)
    order = F.array_position(F.array(*map(F.lit, LEVELS)), F.col(level))
    return rows.withColumn("level_no", order.cast("bigint"))


def denominator_cards(totals: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Postings of every profession at the three levels, 0 where there are none."""
    sums = [
        F.coalesce(F.sum(F.when(F.col(cols.level) == name, F.col(cols.total))), F.lit(0)).alias(name)
        for name in LEVELS
    ]
    wide = totals.where(F.col(cols.profession).isNotNull()).groupBy(cols.profession).agg(*sums)
    return _levels_to_rows(wide, [cols.profession], "level", "postings")


def skill_trajectory(
    matrix: DataFrame,
    profession: str | None = None,
    skill: str | None = None,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """(level, share, label) rows for one skill, or for every skill."""
    if profession is not None:
        matrix = matrix.where(F.col(cols.profession) == profession)
    if skill is not None:
        matrix = matrix.where(F.col(cols.skill) == skill)
    rows = _levels_to_rows(
        matrix.select(cols.profession, cols.skill, *LEVELS),
        [cols.profession, cols.skill],
        "level",
        "share_pct",
    )
    return rows.withColumn("label", percent_label(F.col("share_pct")))


def filter_level(df: DataFrame, level: str | None, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Keep one level; ``None`` or "All" keeps every row."""
    return df if level in (None, ALL) else df.where(F.col(cols.level) == level)


def search_text(
    df: DataFrame, query: str | None, literal: bool = False, cols: PostingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Case-insensitive search in title or text.

    The query is a regular expression unless ``literal`` is set. A null title
    does not hide a text that matches.
    """
    if not query:
        return df
    pattern = "(?iu)" + (re.escape(query) if literal else query)
    return df.where(F.col(cols.title).rlike(pattern) | F.col(cols.text).rlike(pattern))


def evidence_rows(
    tagged: DataFrame,
    profession: str,
    skill: str,
    postings: DataFrame | None = None,
    level: str | None = ALL,
    query: str | None = None,
    literal: bool = False,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """Postings behind one number of the matrix, one row per posting.

    Where the tagged table has no text column, texts come from ``postings``,
    which hold them once per posting and not once per skill. The level is cut
    before, and the hits are staged and counted: the keys of a few are pushed into
    the scan of the texts, where sorted files skip all other row groups; more are
    broadcast, so that no text is moved; beyond that both sides are shuffled.
    Staged hits make the tagged rows once, however dear these are; a few are then
    held by the result itself and leave no folder.
    Of copies of a key the first by title and level is shown.
    """
    wanted = tagged.where(
        (F.col(cols.skill) == skill) & (F.col(cols.profession) == profession)
    )
    names = [cols.serial, cols.title, cols.level]
    if cols.text in tagged.columns:
        evidence = one_row_per_key(wanted.select(*names, cols.text), [cols.serial], [])
        return search_text(filter_level(evidence, level, cols), query, literal, cols)
    if postings is None:
        raise ValueError("tagged rows carry no text: pass the postings that do")
    spark = tagged.sparkSession
    hits, path = staged_at(filter_level(one_row_per_key(wanted.select(*names), [cols.serial], []), level, cols), "hits")
    texts = postings.select(F.col(cols.serial).alias("_serial"), cols.text)
    rows = hits.limit(LISTED + 1).collect()
    if len(rows) <= LISTED:
        found = [row[0] for row in rows]
        listed = F.col("_serial").isin([key for key in found if key is not None])
        texts = texts.where(listed | F.col("_serial").isNull() if None in found else listed)
        hits = F.broadcast(spark.createDataFrame(rows, hits.schema))
        discard(spark, path)
    elif hits.limit(BROADCAST + 1).count() <= BROADCAST:
        hits = F.broadcast(hits)
    same = F.col(cols.serial).eqNullSafe(F.col("_serial"))
    return search_text(texts.join(hits, same).select(*names, cols.text), query, literal, cols)


def row_count(df: DataFrame) -> DataFrame:
    """The number of rows as a one-row table."""
    return df.agg(F.count("*").alias("rows"))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def _top(matrix: DataFrame, by: str, k: int, shown: Sequence[str], cols: PostingColumns) -> DataFrame:
    ranked = rank_within(matrix.drop(RANK), by, k, cols)
    return ranked.select(cols.profession, RANK, cols.skill, *shown)


def top_emerging(matrix: DataFrame, k: int = 5, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Largest Junior to Senior growth in each profession.

    Sees the skills of the matrix it is given: a matrix built with
    ``top_k=None`` widens the scope to all skills.
    """
    return _top(matrix, DIFF, k, [JUNIOR, SENIOR, DIFF], cols)


def top_core(matrix: DataFrame, k: int = 5, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Skills that Juniors need most."""
    return _top(matrix, JUNIOR, k, [JUNIOR, SENIOR], cols)


def gatekeepers(
    matrix: DataFrame, below: float = -1.5, k: int = 5, cols: PostingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Entry-heavy skills: the share falls by more than the cut."""
    return _top(matrix.where(F.col(DIFF) < below), JUNIOR, k, [JUNIOR, SENIOR, DIFF], cols)


def differentiators(
    matrix: DataFrame, above: float = 0.5, k: int = 5, cols: PostingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Senior-heavy skills: the share grows by more than the cut."""
    return _top(matrix.where(F.col(DIFF) > above), SENIOR, k, [JUNIOR, SENIOR, DIFF], cols)


def bridge_skills(matrix: DataFrame, k: int = 5, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Skills whose share peaks at the middle level."""
    peak: Column = (F.col(MID) > F.col(JUNIOR)) & (F.col(MID) > F.col(SENIOR))
    return _top(matrix.where(peak), MID, k, list(LEVELS), cols)


def matrix_top_n(
    matrix: DataFrame, profession: str, n: int = 50, cols: PostingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """First ``n`` rows of one profession's matrix."""
    return matrix.where((F.col(cols.profession) == profession) & (F.col(RANK) <= n))


def sample_rows(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
