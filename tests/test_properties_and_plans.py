"""Properties that hold for any input, and the shape of the physical plans."""

import contextlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.columns import LEVELS
from skilltrend.functions.similarity import common_subsequence
from skilltrend.functions.text import clean_token
from skilltrend.operators import matrix
from skilltrend.operators.canonical import spelling_map
from skilltrend.operators.extract import add_text_id, attach_skills, distinct_texts
from skilltrend.operators.postings import level_totals
from tests.test_canonical import near_words, plain_lcs

ROWS = [
    (str(i), f"p{i % 3}", [*LEVELS, "INTERN", None][i * 7 % 5], f"s{i * i % 11}") for i in range(400)
] + [(str(i), "p0", "Junior", "s1") for i in range(300)]


@contextlib.contextmanager
def conf(spark, **values):
    old = {key: spark.conf.get(key.replace("_", ".")) for key in values}
    for key, value in values.items():
        spark.conf.set(key.replace("_", "."), value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key.replace("_", "."), value)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def tagged(spark):
    return spark.createDataFrame(
        ROWS, f"{C.serial} string, {C.profession} string, {C.level} string, {C.skill} string"
    )


def share(spark):
    df = tagged(spark)
    totals = level_totals(df.dropDuplicates([C.serial, C.profession, C.level]))
    return matrix.share_by_level(matrix.skill_posting_counts(df), totals)


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text("abc", max_size=40), st.text("abcd", max_size=40))
def test_subsequence(a, b):
    assert common_subsequence(a, b) == plain_lcs(a, b) == common_subsequence(b, a)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=12), min_size=50, max_size=50))
def test_cleaning_twice_changes_nothing(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    once = df.select(clean_token(F.col("w")).alias("w")).where(F.length("w") >= 2).where("not w rlike '^[0-9]+$'")
    # "##" goes before other characters do, so one that arises later stays.
    once = once.where("not contains(w, '##')")
    assert once.where(~clean_token(F.col("w")).eqNullSafe(F.col("w"))).isEmpty()


def test_double_hash_that_arises_late(spark):
    df = spark.createDataFrame([("#{#",), ("##",)], "w string")
    assert [r[0] for r in df.select(clean_token(F.col("w"))).collect()] == ["##", None]


def test_shares_are_percentages(spark):
    rows = share(spark).where("share_pct is not null").collect()
    assert rows and all(0 < r["share_pct"] <= 100 and r["jobs_with_skill"] <= r[C.total] for r in rows)


def test_results_do_not_depend_on_partitions(spark):
    words = near_words(4, 60, (4, 14))
    results = []
    for partitions in (1, 13):
        with conf(spark, spark_sql_shuffle_partitions=partitions):
            df = spark.createDataFrame([(w,) for w in words], "skill string").repartition(partitions)
            merged = {tuple(r) for r in spelling_map(df, task_rows=0).collect()}
            board = {tuple(r) for r in matrix.evolution_matrix(share(spark), top_k=5).collect()}
            results.append((merged, board))
    assert results[0] == results[1] and results[0][0] and results[0][1]


def test_totals_are_broadcast_after_being_measured(spark):
    assert "BroadcastHashJoin" in executed(share(spark))


def test_large_sides_are_not_broadcast(spark):
    with conf(spark, spark_sql_autoBroadcastJoinThreshold=-1):
        plan = executed(share(spark))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_distinct_count_spreads_over_postings(spark):
    plan = executed(matrix.skill_posting_counts(tagged(spark)))
    assert f"hashpartitioning({C.profession}" in plan
    assert any(C.serial in line for line in plan.split("\n") if "hashpartitioning" in line)


def test_texts_fold_before_the_shuffle_and_join_by_hash(spark):
    df = add_text_id(spark.createDataFrame([("1", "a b"), ("2", "a b")], f"{C.serial} string, {C.text} string"))
    plan = executed(distinct_texts(df))
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")
    skills = spark.createDataFrame([], f"{C.text_id} string, {C.raw_skills} array<string>")
    assert attach_skills(df, skills).where(F.size(C.raw_skills) == 0).count() == 2


def test_scan_reads_only_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "t")
    tagged(spark).withColumn("long_text", F.lit("x" * 100)).write.parquet(path)
    df = spark.read.parquet(path).where(F.col(C.profession) == "p1")
    plan = executed(matrix.skill_posting_counts(df))
    assert "long_text" not in plan and "PushedFilters: [IsNotNull(jobOpening_professionFinal), EqualTo" in plan
