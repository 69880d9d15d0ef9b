"""The whole analysis, from raw postings to matrix, totals and tagged rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from skilltrend.columns import (
    DEFAULT_COLUMNS,
    LEVELS,
    MATRIX_SIZE,
    SIMILARITY_THRESHOLD,
    STOP_WORDS,
    SYNONYMS,
    WORDS_PER_CHUNK,
    PostingColumns,
)
from skilltrend.operators.canonical import apply_spelling_map, spelling_map
from skilltrend.operators.extract import (
    Extractor,
    add_clean_text,
    add_text_id,
    distinct_texts,
    explode_skills,
    extract_skills,
    skill_vocabulary,
)
from skilltrend.operators.matrix import (
    evolution_matrix,
    share_by_level,
    skill_posting_counts,
    standardize_skills,
)
from skilltrend.operators.postings import clean_postings, level_totals
from skilltrend.plans.stages import Stages, publish, published
from skilltrend.sources.tables import rename_if_missing


@dataclass(frozen=True)
class Analysis:
    """Results of one run.

    ``tagged`` has one row per (posting, raw skill) without the long text
    columns, which stay in ``postings``; ``tagged_with_text`` joins them.
    """

    matrix: DataFrame
    totals: DataFrame
    tagged: DataFrame
    postings: DataFrame


def tag_postings(
    postings: DataFrame,
    extractor: Extractor,
    *,
    threshold: int = SIMILARITY_THRESHOLD,
    processor: str = "alnum",
    words_per_chunk: int = WORDS_PER_CHUNK,
    cols: PostingColumns = DEFAULT_COLUMNS,
    stages: Stages | None = None,
) -> DataFrame:
    """One row per (posting, raw skill) with its canonical spelling.

    The extractor sees each distinct text once. Its output is staged, since the
    vocabulary and the postings both read it. Spellings are merged per text, on
    far fewer rows than the postings have. The result reads a staged table of
    the skills of each text, which goes with the run ``stages`` if there is one.
    """
    with Stages(postings.sparkSession) as own:
        postings = rename_if_missing(postings, cols.raw_profession, cols.profession)
        if cols.text not in postings.columns:
            postings = add_clean_text(postings, cols)
        if cols.text_id not in postings.columns:
            postings = add_text_id(postings, cols)
        found = extract_skills(
            distinct_texts(postings, cols), extractor, words_per_chunk=words_per_chunk, cols=cols
        )
        found = own.put(found, "text-skills", readers=2)
        merged = spelling_map(skill_vocabulary(found, cols), threshold, processor, stages=own)
        own.read(found)
        skills = apply_spelling_map(explode_skills(found, cols), merged, cols)
        keep = own.keep if stages is None else stages.put
        skills = keep(skills, "named-skills")
        own.read(found)
    # Few skills per text but any number of postings: only the postings' side
    # can be skewed, and adaptive execution splits that side.
    return postings.join(skills, cols.text_id)


def analyze(
    raw: DataFrame,
    extractor: Extractor,
    date_range: Sequence | None = None,
    *,
    synonyms: Mapping[str, str] = SYNONYMS,
    stop_words: Sequence[str] | DataFrame = STOP_WORDS,
    threshold: int = SIMILARITY_THRESHOLD,
    processor: str = "alnum",
    words_per_chunk: int = WORDS_PER_CHUNK,
    top_k: int | None = MATRIX_SIZE,
    levels: Sequence[str] | None = LEVELS,
    target: str | None = None,
    cols: PostingColumns = DEFAULT_COLUMNS,
    **cleaning,
) -> Analysis:
    """Clean, extract, merge spellings, count, pivot and rank.

    Everything but the results is deleted when this returns. With ``target``
    they are published there, for ``read_analysis``; without, each lies in a
    folder of its own in the shared folder.
    """
    spark = raw.sparkSession
    with Stages(spark) as stages:
        cleaned = clean_postings(raw, date_range, cols=cols, stages=stages, **cleaning)
        # The HTML is done with; left in, it would be most of what is written.
        postings = add_clean_text(cleaned, cols).drop(cols.scope)
        postings = stages.put(postings, "postings") if target else stages.keep(postings, "postings")
        totals = level_totals(postings, cols)
        totals = stages.put(totals, "totals") if target else stages.keep(totals, "totals")
        tagged = tag_postings(
            postings,
            extractor,
            threshold=threshold,
            processor=processor,
            words_per_chunk=words_per_chunk,
            cols=cols,
            stages=stages,
        )
        tagged = standardize_skills(tagged, synonyms, stop_words, cols)
        narrow = [name for name in tagged.columns if name != cols.text]
        tagged = tagged.select(narrow)
        tagged = stages.put(tagged, "tagged") if target else stages.keep(tagged, "tagged")
        share = share_by_level(skill_posting_counts(tagged, cols), totals, cols)
        matrix = evolution_matrix(share, top_k, levels, cols, stages=stages)
        if not target:
            return Analysis(stages.keep(matrix, "matrix"), totals, tagged, postings)
        tables = {"matrix": matrix, "totals": totals, "tagged": tagged, "postings": postings}
        # Readers ask for one profession's skill, and for the texts of a few postings.
        publish(spark, target, tables, {"tagged": [cols.profession, cols.skill], "postings": [cols.serial]})
    return read_analysis(spark, target)


def read_analysis(spark: SparkSession, target: str) -> Analysis:
    """The results that were published last below ``target``."""
    return Analysis(**published(spark, target))


def tagged_with_text(result: Analysis, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Tagged rows with the plain text next to each skill."""
    texts = result.postings.select(cols.text_id, cols.text).dropna(subset=[cols.text]).distinct()
    return result.tagged.join(texts, cols.text_id)
