"""One query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.columns import SYNONYMS
from skilltrend.functions.similarity import comparison_key
from skilltrend.functions.text import (
    clean_token,
    clean_tokens,
    decode_entities,
    entity_table,
    html_to_text,
    normal_word,
    split_words,
    word_chunks,
    word_ngrams,
)
from skilltrend.functions.values import in_date_range, once, parse_month_first, submitted_timestamp
from skilltrend.operators import insights, matrix, postings
from skilltrend.operators.canonical import apply_spelling_map, similar_keys, spelling_map
from skilltrend.operators.extract import (
    DictionaryExtractor,
    ModelExtractor,
    attach_skills,
    explode_skills,
    extract_skills,
)
from skilltrend.plans.checkpoints import scratch_path, staged
from skilltrend.plans.pipeline import analyze
from skilltrend.plans.stages import publish, published
from skilltrend.sources.tables import read_table, rename_if_missing, to_local, write_table
from standin import tables as t

Query = Callable[[SparkSession, str], DataFrame]

STANDIN_SYNONYMS = {**SYNONYMS, "old": "vintage", "gizmo": "widget"}
EVIDENCE = ("BUILDING", "blue gear")
SEARCH = r"\bth(e|is) .*src1|tion\b"
DOCUMENT_EVIDENCE = ("en", "the that")
DOCUMENT_SEARCH = r"src[12]|\btion"


# --- Sources and cleaning --------------------------------------------------


def csv_roundtrip(spark: SparkSession, sf_dir: str, name: str = "nation") -> DataFrame:
    df = t.table(spark, sf_dir, name)
    path = scratch_path(spark, f"csv-{name}")
    write_table(df, path, "csv")
    return read_table(spark, path, "csv", df.schema, multiline=True)


def normalize_profession(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias(C.raw_profession))
    return postings.normalize_profession(docs, [(r"src1.+", "src1")])


def status_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.raw_postings(spark, sf_dir)
    return postings.keep_status_and_type(raw, t.STATUSES, t.CONTRACT_TYPES).select(
        C.serial, C.status, C.contract_type
    )


def profession_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = postings.normalize_profession(t.raw_postings(spark, sf_dir))
    return postings.keep_professions(named, ["BUILDING", "MACHINERY"]).select(C.serial, C.profession)


def parse_date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "M/d/yyyy")
    return t.table(spark, sf_dir, "events").select(
        "event_id", text.alias("day_text"), parse_month_first(text).cast("timestamp_ntz").alias(C.submitted_at)
    )


def typed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission times from a column of text and from one of real times."""
    events = t.table(spark, sf_dir, "events")
    real = events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("at"))
    text = events.select("event_id", F.date_format("ts", "M/d/yyyy").alias("at"))
    parts = [df.select("event_id", F.lit(kind).alias("kind"), submitted_timestamp(df, "at").alias(C.submitted_at)) for kind, df in (("real", real), ("text", text))]
    return parts[0].unionAll(parts[1])


def rename_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column takes the wanted name, unless another one has it already."""
    nation = t.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    renamed = rename_if_missing(nation, "n_name", C.profession)
    return rename_if_missing(renamed, "n_regionkey", "n_nationkey")


def dedupe_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with text dates and long texts."""
    kept = postings.keep_status_and_type(t.raw_documents(spark, sf_dir), t.STATUSES, t.CONTRACT_TYPES)
    return postings.dedupe_postings(kept).select("doc_id", C.serial, C.submitted, C.level, F.sha2(C.scope, 256).alias("scope"))


def level_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level codes from a table."""
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias(C.level))
    codes = orders.select(C.level).distinct().withColumn("name", F.concat(F.lit("L"), F.substring(C.level, 1, 1)))
    return postings.map_levels(orders, codes.where(F.col(C.level) != "5-LOW"))


def published_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs published one after the other: a reader sees the whole of the later one."""
    target = scratch_path(spark, "published")
    totals = t.totals(spark, sf_dir)
    publish(spark, target, {"totals": totals.limit(1), "cards": insights.denominator_cards(totals)})
    publish(spark, target, {"totals": totals, "cards": insights.denominator_cards(totals)}, {"totals": [C.profession, C.level]})
    return published(spark, target)["totals"]


def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return orders.where(in_date_range(F.col("o_orderdate"), t.DATES))


def dedupe_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return postings.one_row_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")])


def level_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias(C.level))
    return postings.map_levels(orders, t.LEVEL_CODES)


# --- Text ------------------------------------------------------------------


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = t.table(spark, sf_dir, "pages")
    return pages.select("page_id", html_to_text(F.col("html"), collapse=True).alias(C.text))


def entity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every kind: numbers, common and rare names, with and without semicolon."""
    names = sorted(entity_table())
    name = F.element_at(F.array(*map(F.lit, names[::9])), (F.col("event_id") * 7 % len(names[::9]) + 1).cast("int"))
    number = F.col("event_id") * 37 % 70_000
    hexed = F.lower(F.hex(F.col("event_id") % 1_200_000))
    mark = F.when(F.col("event_id") % 3 != 0, ";").otherwise(" ")
    text = F.concat(F.lit("a &"), name, mark, F.lit("&#"), number.cast("string"), mark, F.lit("&#x"), hexed, F.lit("; & &amp &nosuch; &lt;b&gt;"))
    return t.table(spark, sf_dir, "events").select("event_id", decode_entities(text).alias(C.text))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", F.explode(split_words(F.col("text"))).alias("word"))


def token_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_words(spark, sf_dir).select("word").unionAll(
        t.table(spark, sf_dir, "part").select(F.col("p_name").alias("word"))
    )
    return words.distinct().select("word", clean_token(F.col("word")).alias("token"))


def word_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(word_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


# --- Extraction ------------------------------------------------------------


def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One- and two-word phrases of the benchmark items; their length sets the group."""
    words = F.array_remove(F.transform(split_words(F.col("text")), normal_word), "")
    pairs = t.table(spark, sf_dir, "benchmark").select(
        F.explode(once(words, lambda w: word_ngrams(w, 2))).alias("phrase")
    )
    size = F.length("phrase")
    group = F.when(size >= 12, "HSKILL").when(size >= 8, "SSKILL").otherwise("OTHER")
    return pairs.distinct().withColumn("entity_group", group)


def dictionary_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    extractor = DictionaryExtractor(phrase_table(spark, sf_dir))
    return extract_skills(t.document_texts(spark, sf_dir), extractor)


def long_phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items and their runs of three to six words."""
    words = F.array_remove(F.transform(split_words(F.col("text")), normal_word), "")
    items = t.table(spark, sf_dir, "benchmark").select(words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - 5, F.lit(1)))
    runs = items.select(F.explode(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(3), F.lit(6)), lambda n: F.array_join(F.slice("w", i, n), " "))))).alias("phrase"))
    whole = items.select(F.array_join("w", " ").alias("phrase"))
    return runs.unionAll(whole).distinct().withColumn("entity_group", F.lit("HSKILL"))


def long_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    extractor = DictionaryExtractor(long_phrase_table(spark, sf_dir))
    found = extract_skills(t.document_texts(spark, sf_dir), extractor)
    return found.select(C.text_id, F.size(C.raw_skills).cast("long").alias("skills"), F.sha2(F.array_join(C.raw_skills, "|"), 256).alias("digest"))


def load_ending_model():
    """A stand-in model that tags words by their ending."""

    def model(chunk: str) -> list[dict]:
        return [
            {"entity_group": "HSKILL" if word.endswith("tion") else "SSKILL", "word": word}
            for word in chunk.split(" ")
            if word.endswith(("tion", "ble"))
        ] + [{"entity_group": "OTHER", "word": word} for word in chunk.split(" ") if word.endswith("th")]

    return model


def _joined(df: DataFrame) -> DataFrame:
    return df.select(C.text_id, F.array_join(C.raw_skills, "|").alias(C.raw_skills))


def dictionary_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(dictionary_skills(spark, sf_dir))


def model_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(extract_skills(t.document_texts(spark, sf_dir), ModelExtractor(load_ending_model)))


def attach_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.document_postings(spark, sf_dir).drop(C.title)
    tagged = explode_skills(attach_skills(docs, dictionary_skills(spark, sf_dir)))
    return tagged.select(C.serial, C.profession, C.raw_skills)


# --- Spellings -------------------------------------------------------------


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_words(spark, sf_dir).select("word").distinct()
    return words.select(clean_tokens(F.col("word")).alias("skill")).distinct()


def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_keys(spellings(spark, sf_dir).select(comparison_key(F.col("skill")).alias("key")))


def fuzzy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_map(spellings(spark, sf_dir))


def apply_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("uses"))
    tokens = words.select("uses", clean_tokens(F.col("word")).alias(C.raw_skills))
    named = apply_spelling_map(tokens, spelling_map(spellings(spark, sf_dir)))
    return named.groupBy(C.skill).agg(
        F.count_distinct(C.raw_skills).alias("spellings"), F.sum("uses").alias("uses")
    )


def synonyms_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = t.table(spark, sf_dir, "part")
    words = parts.select("p_partkey", F.explode(split_words(F.col("p_name"))).alias(C.skill))
    return matrix.standardize_skills(words, STANDIN_SYNONYMS)


# --- Matrix ----------------------------------------------------------------


def matrix_all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.matrix(spark, sf_dir, levels=None)


def mention_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = matrix.mention_counts(t.tagged(spark, sf_dir))
    renamed = matrix.standardize_skills(counts, {"old gizmo": "old widget"}, ["red anvil"])
    return matrix.mention_share(matrix.merge_mentions(renamed))


def most_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.most_mentioned(matrix.mention_counts(t.tagged(spark, sf_dir)), 50)


def full_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, extract, merge spellings, count, pivot, rank and publish."""
    extractor = DictionaryExtractor(phrase_table(spark, sf_dir))
    dates = ("2024-01-01", "2024-09-30")
    cleaning = {"statuses": t.STATUSES, "contract_types": t.CONTRACT_TYPES, "level_map": t.LEVEL_CODES}
    target = scratch_path(spark, "analysis")
    raw = t.raw_documents(spark, sf_dir).drop("doc_id")
    return analyze(raw, extractor, dates, synonyms=STANDIN_SYNONYMS, target=target, **cleaning).matrix


def ranks_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.matrix(spark, sf_dir, top_k=None)


def odd_level_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that are null or named like other columns get columns of their own."""
    cleaned = staged(t.postings(spark, sf_dir), "postings")
    odd = F.when(F.col(C.level) == "5-LOW", "rank").when(F.col(C.serial) % 5 != 0, F.col(C.level))
    cleaned = cleaned.withColumn(C.level, odd)
    counts = matrix.skill_posting_counts(t.tagged(spark, sf_dir, cleaned))
    shares = matrix.share_by_level(counts, postings.level_totals(cleaned))
    return matrix.evolution_matrix(shares, levels=[*matrix.LEVELS, "rank", None])


def step_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.in_level_order(matrix.add_step_changes(t.matrix(spark, sf_dir, top_k=50)))


# --- Insights --------------------------------------------------------------


def document_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as postings with levels, and their skills without the texts, which are stored as an analysis stores them."""
    level = F.element_at(F.array(*map(F.lit, matrix.LEVELS)), (F.col(C.serial) % 3 + 1).cast("int"))
    docs = t.document_postings(spark, sf_dir).withColumn(C.level, level)
    skills = explode_skills(dictionary_skills(spark, sf_dir)).withColumnRenamed(C.raw_skills, C.skill)
    return docs, staged(docs.drop(C.text).join(skills, C.text_id), "tagged")


def evidence_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tagged = document_tags(spark, sf_dir)
    return insights.evidence_rows(tagged, *DOCUMENT_EVIDENCE, docs, level=insights.ALL, query=DOCUMENT_SEARCH)


def evidence_of_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one level, and of all levels, as the filter gives them."""
    docs, tagged = document_tags(spark, sf_dir)
    found = [insights.evidence_rows(tagged, *DOCUMENT_EVIDENCE, docs, level=level) for level in ("Senior", insights.ALL, None)]
    parts = [df.select(C.serial, C.level, F.lit(k).alias("part")) for k, df in enumerate(found)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def evidence_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tagged = document_tags(spark, sf_dir)
    wanted = tagged.where((F.col(C.profession) == DOCUMENT_EVIDENCE[0]) & (F.col(C.skill) == DOCUMENT_EVIDENCE[1]))
    return insights.sample_rows(wanted.select(C.serial, C.title, C.level), 5, [C.serial])


def empty_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each profession has skills that grow, peak or fall by much."""
    whole = staged(t.matrix(spark, sf_dir), "matrix")
    rows = []
    for row in insights.profession_list(whole).collect():  # a handful of professions
        own = whole.where(F.col(C.profession) == row[0])
        kinds = {"gatekeepers": insights.gatekeepers(own), "bridge": insights.bridge_skills(own), "grown": insights.differentiators(own, above=0.6)}
        rows += [(row[0], kind, insights.is_empty(df)) for kind, df in kinds.items()]
    return spark.createDataFrame(rows, f"{C.profession} string, kind string, empty boolean")


def local_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded result as the local client gets it."""
    top = insights.sample_rows(t.totals(spark, sf_dir), 12, [F.desc(C.total), C.profession, C.level])
    return spark.createDataFrame(to_local(top, 7), top.schema)


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = t.tagged(spark, sf_dir).withColumn(C.text, F.col(C.skill))
    return insights.evidence_rows(tagged, *EVIDENCE, level="Senior")


def searched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.search_text(t.document_postings(spark, sf_dir), SEARCH)


def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched_documents(spark, sf_dir).select(C.serial, C.title)


def queries() -> dict[str, Query]:
    on_matrix = {
        "skill_trajectory": insights.skill_trajectory,
        "top_emerging": insights.top_emerging,
        "top_core": insights.top_core,
        "gatekeepers": lambda m: insights.gatekeepers(m, below=-0.2),
        "differentiators": lambda m: insights.differentiators(m, above=0.2),
        "bridge_skills": insights.bridge_skills,
        "matrix_top_n": lambda m: insights.matrix_top_n(m, "BUILDING", 10),
    }
    found: dict[str, Query] = {
        "scan_postings": t.raw_postings,
        "csv_roundtrip": csv_roundtrip,
        "csv_roundtrip_documents": lambda s, d: csv_roundtrip(s, d, "documents"),
        "normalize_profession": normalize_profession,
        "status_type_filter": status_type_filter,
        "profession_subset": profession_subset,
        "parse_date_strings": parse_date_strings,
        "typed_dates": typed_dates,
        "rename_column": rename_column,
        "dedupe_copies": dedupe_copies,
        "level_table": level_table,
        "published_totals": published_totals,
        "date_range_filter": date_range_filter,
        "dedupe_postings": dedupe_postings,
        "level_map": level_map,
        "level_totals": t.totals,
        "distinct_texts": t.document_texts,
        "html_to_text": page_text,
        "entity_references": entity_references,
        "token_cleanup": token_cleanup,
        "word_chunks": word_chunk_rows,
        "dictionary_extract": dictionary_extract,
        "long_phrases": long_phrases,
        "model_extract": model_extract,
        "attach_entities": attach_entities,
        "similarity_pairs": similarity_pairs,
        "fuzzy_groups": fuzzy_groups,
        "apply_spelling_map": apply_map,
        "synonyms_stopwords": synonyms_stopwords,
        "skill_posting_counts": lambda s, d: matrix.skill_posting_counts(t.tagged(s, d)),
        "share_by_level": t.share,
        "level_pivot": lambda s, d: matrix.level_pivot(t.share(s, d)),
        "evolution_matrix": t.matrix,
        "matrix_all_levels": matrix_all_levels,
        "ranks_of_all": ranks_of_all,
        "odd_level_names": odd_level_names,
        "mention_share": mention_share,
        "most_mentioned": most_mentioned,
        "full_analysis": full_analysis,
        "tagged_denominator": lambda s, d: matrix.tagged_totals(t.tagged(s, d)),
        "step_deltas": step_deltas,
        "denominator_cards": lambda s, d: insights.denominator_cards(t.totals(s, d)),
        "evidence_rows": evidence_rows,
        "evidence_full": evidence_full,
        "evidence_of_level": evidence_of_level,
        "evidence_sample": evidence_sample,
        "empty_results": empty_results,
        "local_rows": local_rows,
        "evidence_levels": lambda s, d: insights.level_list(t.tagged(s, d)),
        "evidence_search": evidence_search,
        "evidence_count": lambda s, d: insights.row_count(searched_documents(s, d)),
        "profession_list": lambda s, d: insights.profession_list(t.totals(s, d)),
    }
    for name, insight in on_matrix.items():
        found[name] = lambda s, d, insight=insight: insight(t.matrix(s, d))
    return found
