"""Skill extraction: distinct texts, chunks, a pluggable extractor, join back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltrend.columns import (
    DEFAULT_COLUMNS,
    SKILL_ENTITY_GROUPS,
    WORDS_PER_CHUNK,
    PostingColumns,
)
from skilltrend.functions.text import (
    clean_tokens,
    html_to_text,
    normal_words,
    word_chunks,
    word_ngrams,
)
from skilltrend.functions.values import once
from skilltrend.plans.checkpoints import spread

# An extractor turns (text_id, chunk_no, chunk) rows into
# (text_id, entity_group, word) rows.
Extractor = Callable[[DataFrame], DataFrame]

# What a model returns for one chunk: records with "entity_group" and "word".
Model = Callable[[str], Iterable[Mapping[str, Any]]]
# A model that takes several chunks at once and returns such records for each.
BatchModel = Callable[[list[str]], Iterable[Iterable[Mapping[str, Any]]]]


def add_clean_text(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Add the plain text of the HTML scope, and a short key for joins on it."""
    df = df.withColumn(cols.text, html_to_text(F.col(cols.scope)))
    return add_text_id(df, cols)


def add_text_id(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    return df.withColumn(cols.text_id, F.sha2(cols.text, 256))


def distinct_texts(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Each non-null text once.

    Copies fold inside each task before the shuffle, so a text that fills a
    third of the table still sends one row per task.
    """
    return df.select(cols.text_id, cols.text).dropna(subset=[cols.text]).distinct()


def text_chunks(
    texts: DataFrame,
    words_per_chunk: int = WORDS_PER_CHUNK,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """One row per chunk; a text without words has none."""
    return texts.select(
        cols.text_id,
        F.posexplode(word_chunks(F.col(cols.text), words_per_chunk)).alias("chunk_no", "chunk"),
    )


#: Phrases of up to so many words are looked up as they are, longer ones by such a run in them.
RUN_WORDS = 2


@dataclass(frozen=True)
class DictionaryExtractor:
    """Finds the phrases of a (phrase, entity_group) table in each chunk.

    Phrases and texts are normalised alike, word by word. A chunk is broken into
    its words and pairs of words whatever the phrases are like. A phrase of more
    words is indexed by the rarest pair in it, and checked in the chunks that
    have that pair; so one long phrase costs the other rows nothing. A phrase
    longer than ``max_words`` is an error, if that is given. The joins carry no
    hint: adaptive execution broadcasts the table if its measured bytes allow.
    """

    phrases: DataFrame
    max_words: int | None = None
    cols: PostingColumns = DEFAULT_COLUMNS

    def __call__(self, chunks: DataFrame) -> DataFrame:
        table = self.phrases.select(normal_words(F.col("phrase")).alias("_words"), "entity_group")
        table = table.where(F.size("_words") > 0).distinct()
        longest = table.agg(F.max(F.size("_words"))).first()[0] or 1
        if self.max_words is not None and longest > self.max_words:
            raise ValueError(f"a phrase has {longest} words, more than max_words={self.max_words}")
        keys = [self.cols.text_id, "chunk_no"]
        words = chunks.select(*keys, normal_words(F.col("chunk")).alias("_words"))
        runs = words.select(*keys, F.explode(once(F.col("_words"), lambda w: word_ngrams(w, min(RUN_WORDS, longest)))).alias("_run"))
        whole = F.array_join("_words", " ")
        short = table.where(F.size("_words") <= RUN_WORDS).select(whole.alias("_run"), whole.alias("word"), "entity_group")
        found = runs.join(short, "_run").select(self.cols.text_id, "entity_group", "word")
        if longest <= RUN_WORDS:
            return found
        indexed = _by_rarest_pair(table.where(F.size("_words") > RUN_WORDS))
        candidates = runs.join(indexed, "_run").select(*keys, "entity_group", "word")
        padded = F.concat(F.lit(" "), whole, F.lit(" "))
        holds = F.contains(F.col("_text"), F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
        # Never null, and no filter on the words: a test on either would make them once more.
        texts = words.select(*keys, F.coalesce(padded, F.lit("")).alias("_text"))
        return found.unionAll(candidates.join(texts, keys).where(holds).select(self.cols.text_id, "entity_group", "word"))


def _by_rarest_pair(phrases: DataFrame) -> DataFrame:
    """``_run``, ``word``, ``entity_group``: each phrase under that of its pairs of words which the fewest phrases have."""
    whole = phrases.select(F.array_join("_words", " ").alias("word"), "_words").distinct()
    pairs = whole.select("word", F.explode(F.filter(word_ngrams(F.col("_words"), RUN_WORDS), lambda run: F.contains(run, F.lit(" ")))).alias("_run"))
    uses = pairs.groupBy("_run").agg(F.count("*").alias("_uses"))
    # Of pairs in equal use the longest one: it is rarer in texts, as a rule.
    rank = F.struct("_uses", (-F.length("_run")).alias("_size"), "_run")
    rarest = pairs.join(uses, "_run").groupBy("word").agg(F.min(rank).alias("_rarest"))
    named = phrases.select(F.array_join("_words", " ").alias("word"), "entity_group")
    return rarest.select("word", F.col("_rarest._run").alias("_run")).join(named, "word")


_loaded: dict[str, Model] = {}


def loaded_model(key: str, load: Callable[[], Model]) -> Model:
    """The model of this Python worker, which later tasks find again."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = load()
    return _loaded[key]


@dataclass(frozen=True)
class ModelExtractor:
    """Runs a user's model on every chunk, loading it once per Python worker.

    Chunks, not texts, are spread over the tasks, since texts differ a lot in
    length. ``partitions`` fixes how many tasks share the work; else all shuffle
    partitions do, as chunks are small in bytes but dear in model time. With a
    ``batch_size`` the model gets lists of up to so many chunks.
    """

    load: Callable[[], Model] | Callable[[], BatchModel]
    partitions: int | None = None
    batch_size: int | None = None
    cols: PostingColumns = DEFAULT_COLUMNS
    key: str = field(default_factory=lambda: uuid4().hex)

    def __call__(self, chunks: DataFrame) -> DataFrame:
        load, key_of_model, text_id, size = self.load, self.key, self.cols.text_id, self.batch_size

        def records(model: Model | BatchModel, chunks: list[str]) -> Iterator[Iterable[Mapping[str, Any]]]:
            if size is None:
                yield from map(model, chunks)
                return
            for start in range(0, len(chunks), size):
                yield from model(chunks[start : start + size])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                model = loaded_model(key_of_model, load)
                found = [
                    (key, record["entity_group"], record["word"])
                    for key, of_chunk in zip(batch[text_id], records(model, list(batch["chunk"])))
                    for record in of_chunk
                ]
                yield pd.DataFrame(found, columns=[text_id, "entity_group", "word"])

        keys = [text_id, "chunk_no"]
        dealt = chunks.repartition(self.partitions, *keys) if self.partitions else spread(chunks, *keys)
        return dealt.mapInPandas(run, f"{text_id} string, entity_group string, word string")


def extract_skills(
    texts: DataFrame,
    extractor: Extractor,
    *,
    entity_groups: Sequence[str] = SKILL_ENTITY_GROUPS,
    words_per_chunk: int = WORDS_PER_CHUNK,
    cols: PostingColumns = DEFAULT_COLUMNS,
) -> DataFrame:
    """(text_id, raw_skills) for the texts in which a skill was found."""
    found = extractor(text_chunks(texts, words_per_chunk, cols))
    return (
        found.where(F.col("entity_group").isin(list(entity_groups)))
        .select(cols.text_id, clean_tokens(F.col("word")).alias("_skill"))
        .groupBy(cols.text_id)
        .agg(F.sort_array(F.collect_set("_skill")).alias(cols.raw_skills))
    )


def attach_skills(
    df: DataFrame, text_skills: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS
) -> DataFrame:
    """Give every posting the skills of its text.

    A text without skills gets an empty list, a null text gets null.
    """
    joined = df.join(text_skills, cols.text_id, "left")
    empty = F.when(F.col(cols.text).isNotNull(), F.array().cast("array<string>"))
    return joined.withColumn(cols.raw_skills, F.coalesce(F.col(cols.raw_skills), empty))


def explode_skills(df: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row per (posting, raw skill); empty and null lists vanish."""
    return df.withColumn(cols.raw_skills, F.explode(cols.raw_skills))


def skill_vocabulary(text_skills: DataFrame, cols: PostingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Distinct spellings over all texts, as one ``skill`` column."""
    return text_skills.select(F.explode(cols.raw_skills).alias("skill")).distinct()
