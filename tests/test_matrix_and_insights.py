"""Shares, matrix and the questions asked of it, on hand-worked rows."""

import random

import pytest
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.operators import insights, matrix
from skilltrend.operators.insights import ALL
from skilltrend.operators.matrix import rank_within
from skilltrend.operators.postings import map_levels

KEYS = f"{C.serial} string, {C.profession} string, {C.level} string, {C.skill} string"


def tagged(spark, rows):
    return spark.createDataFrame(rows, KEYS)


def totals(spark, rows):
    return spark.createDataFrame(rows, f"{C.profession} string, {C.level} string, {C.total} long")


def shares(spark, rows):
    return spark.createDataFrame(rows, f"{C.profession} string, {C.level} string, {C.skill} string, share_pct double")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_synonyms_come_before_stop_words(spark):
    rows = [("1", "p", "Junior", s) for s in ["native", "skills", "reactjs", "react", "red", "java", "c +"]]
    df = tagged(spark, rows)
    got = sorted(r[C.skill] for r in matrix.standardize_skills(df).collect())
    assert got == ["c++", "java", "react", "react", "react native"]
    user = spark.createDataFrame([("java",), ("c++",)], "w string")
    got = sorted(r[C.skill] for r in matrix.standardize_skills(df, stop_words=user).collect())
    assert got == ["react", "react", "react native", "red", "skills"]


def test_counts_and_shares(spark):
    rows = [
        ("1", "p", "Junior", "java"), ("1", "p", "Junior", "java"), ("2", "p", "Junior", "java"),
        (None, "p", "Junior", "java"), (None, "p", "Junior", "java"), ("3", None, "Junior", "java"),
        ("4", "p", None, "java"),
    ]
    counts = matrix.skill_posting_counts(tagged(spark, rows))
    got = {(r[0], r[1]): r["jobs_with_skill"] for r in counts.collect()}
    assert got == {("p", "Junior"): 3, (None, "Junior"): 1, ("p", None): 1}
    # Postings without skills still count in the denominator.
    share = matrix.share_by_level(counts, totals(spark, [("p", "Junior", 12), (None, "Junior", 4)]))
    got = {(r[C.profession], r[C.level]): r["share_pct"] for r in share.collect()}
    assert got == {("p", "Junior"): 25.0, (None, "Junior"): None, ("p", None): None}
    assert matrix.tagged_totals(tagged(spark, rows)).where("total_unique_jobs = 3").count() == 1


def test_matrix_changes(spark):
    share = shares(spark, [
        ("p", "Senior", "new", 5.0), ("p", "Mid-level", "mid", 3.0),
        ("p", "Junior", "old", 4.0), ("p", "Senior", "old", 1.0),
        ("p", "INTERN", "only", 9.0), (None, "Junior", "x", 1.0), ("q", "Junior", "z", 1.0),
    ])
    rows = {(r[C.profession], r[C.skill]): r for r in matrix.evolution_matrix(share).collect()}
    assert set(rows) == {("p", "new"), ("p", "mid"), ("p", "old"), ("p", "only"), ("q", "z")}
    assert rows["p", "new"][matrix.CHANGE] == 100.0 and rows["p", "mid"][matrix.CHANGE] == 100.0
    assert rows["p", "old"][matrix.DIFF] == -3.0 and rows["p", "old"][matrix.CHANGE] == -75.0
    assert rows["q", "z"]["Senior"] == 0.0 and rows["p", "only"]["Junior"] == 0.0
    assert rows["p", "old"]["rank"] == 1 and rows["p", "mid"]["rank"] == 2
    wide = matrix.evolution_matrix(share, levels=None)
    assert wide.columns.index("INTERN") > wide.columns.index("Senior")
    assert as_dict(wide, C.skill, "INTERN")["only"] == 9.0
    steps = matrix.add_step_changes(matrix.evolution_matrix(share))
    assert as_dict(steps, C.skill, matrix.SENIOR_DIFF)["mid"] == -3.0


def test_level_columns_do_not_clash(spark):
    share = shares(spark, [("p", "rank", "a", 3.0), ("p", "null", "a", 2.0), ("p", None, "a", 5.0), ("p", "JUNIOR", "a", 7.0), ("p", "Junior", "a", 1.0)])
    row = matrix.evolution_matrix(share, levels=None).first().asDict()
    assert row["rank_level"] == 3.0 and row["null"] == 2.0 and row["null_level"] == 5.0
    assert row["JUNIOR_level"] == 7.0 and row["Junior"] == 1.0 and row["rank"] == 1


def test_synonyms_as_a_table(spark):
    rows = [("1", "p", "Junior", s) for s in ["a", "b", "c"]]
    table = spark.createDataFrame([("b", "a"), ("b", "z"), (None, "q")], "x string, y string")
    named = matrix.standardize_skills(tagged(spark, rows), table, [])
    assert sorted(r[C.skill] for r in named.collect()) == ["a", "a", "c"]


def test_most_mentioned(spark):
    rows = [("1", "p", "Junior", s) for s in ["a", "b", "b", "c"]]
    counts = matrix.mention_counts(tagged(spark, rows))
    assert [r[C.skill] for r in matrix.most_mentioned(counts, 2).collect()] == ["b", "a"]


def test_too_many_levels_stop(spark):
    share = shares(spark, [("p", f"L{i}", "s", 1.0) for i in range(5)])
    with pytest.raises(ValueError):
        matrix.found_levels(share, max_levels=4)


def test_ties_at_the_cut(spark):
    share = shares(spark, [("p", "Junior", f"s{i:03d}", 1.0) for i in range(120)])
    kept = matrix.evolution_matrix(share)
    assert sorted(r[C.skill] for r in kept.collect()) == [f"s{i:03d}" for i in range(100)]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_mention_share(spark):
    rows = [("1", "p", "Junior", s) for s in ["a", "a", "b", "c"]]
    counts = matrix.mention_counts(tagged(spark, rows))
    merged = matrix.merge_mentions(matrix.standardize_skills(counts, {"c": "a"}, []))
    assert as_dict(matrix.mention_share(merged), C.skill, "share_pct") == {"a": 75.0, "b": 25.0}


def board(spark):
    values = [("up", 1.0, 2.0, 9.0), ("down", 8.0, 4.0, 2.0), ("mid", 2.0, 6.0, 2.1), ("flat", 3.0, 3.0, 3.0)]
    rows = [("p", level, s, v) for s, *vs in values for level, v in zip(("Junior", "Mid-level", "Senior"), vs)]
    return matrix.evolution_matrix(shares(spark, rows))


def test_insights(spark):
    m = board(spark)
    names = lambda df: [r[C.skill] for r in df.orderBy("rank").collect()]
    assert names(insights.top_emerging(m, 2)) == ["up", "mid"]
    assert names(insights.top_core(m, 2)) == ["down", "flat"]
    assert names(insights.gatekeepers(m)) == ["down"]
    assert names(insights.differentiators(m)) == ["up"]
    assert names(insights.bridge_skills(m)) == ["mid"]
    assert names(insights.matrix_top_n(m, "p", 1)) == ["down"]
    path = insights.skill_trajectory(m, "p", "up").orderBy("level_no").collect()
    assert [(r["level"], r["label"]) for r in path] == [("Junior", "1.0%"), ("Mid-level", "2.0%"), ("Senior", "9.0%")]
    assert insights.is_empty(insights.matrix_top_n(m, "none"))


def test_cards_and_lists(spark):
    t = totals(spark, [("p", "Junior", 3), ("p", "INTERN", 2), ("q", "Senior", 1), (None, "Senior", 7)])
    got = {(r[0], r["level"]): r["postings"] for r in insights.denominator_cards(t).collect()}
    assert got == {
        ("p", "Junior"): 3, ("p", "Mid-level"): 0, ("p", "Senior"): 0,
        ("q", "Junior"): 0, ("q", "Mid-level"): 0, ("q", "Senior"): 1,
    }
    assert [r[0] for r in insights.profession_list(t).collect()] == ["p", "q"]
    levels = totals(spark, [("p", None, 1), ("p", "b", 1), ("p", "a", 1)])
    assert [r[0] for r in insights.level_list(levels).collect()] == ["a", "b", None]


def test_evidence(spark):
    rows = [
        ("1", "p", "Junior", "java", "Dev", "uses c++ daily"), ("1", "p", "Junior", "java", "Dev", "uses c++ daily"),
        ("2", "p", "Senior", "java", None, "FINTECH c"), ("3", "p", "Senior", "java", "Fintech Lead", None),
        ("4", "q", "Senior", "java", "Fintech", "x"), ("5", "p", "Senior", "go", "Fintech", "x"),
    ]
    wide = spark.createDataFrame(rows, f"{KEYS}, {C.title} string, {C.text} string")
    postings = wide.select(C.serial, C.text).distinct()
    for df in (wide, wide.drop(C.text)):
        find = lambda **o: sorted(r[C.serial] for r in insights.evidence_rows(df, "p", "java", postings, **o).collect())
        assert find() == find(level=ALL) == ["1", "2", "3"]
        assert find(level="Senior") == ["2", "3"]
        assert find(query="fintech") == ["2", "3"]
        assert find(query="c++", literal=True) == ["1"]
        assert find(query="^(dev|fintech c)$") == ["1", "2"]
    with pytest.raises(ValueError):
        insights.evidence_rows(wide.drop(C.text), "p", "java")
    assert insights.row_count(wide).first()["rows"] == 6
    assert [r[0] for r in insights.sample_rows(wide, 2, [F.desc(C.serial)]).select(C.serial).collect()] == ["5", "4"]


def test_ranks_without_a_limit(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["p", "p", "p", "q", None]), f"s{k:03d}", rng.choice([0.0, 1.5, 2.5, None])) for k in range(500)]
    df = spark.createDataFrame(rows, f"{C.profession} string, {C.skill} string, Junior double").repartition(7)
    by_window = rank_within(df, "Junior", 1000).collect()
    by_ranges = rank_within(df, "Junior", None)
    assert sorted(map(str, by_ranges.collect())) == sorted(map(str, by_window))
    assert rank_within(df.limit(0), "Junior", None).count() == 0
    # Windows see a profession's ranges, of which there are few, and never its rows.
    for line in by_ranges._jdf.queryExecution().executedPlan().toString().splitlines():
        assert "Window [" not in line or "_rows" in line


def test_evidence_beyond_the_list(spark, monkeypatch):
    rows = [(str(k % 40) if k % 9 else None, "p", "Senior", "java", f"t{k % 3}") for k in range(120)]
    tagged = spark.createDataFrame(rows, f"{KEYS}, {C.title} string")
    texts = tagged.select(C.serial).distinct().withColumn(C.text, F.concat(F.lit("text "), F.coalesce(C.serial, F.lit("none"))))
    found = {}
    for listed, broadcast in ((2000, 200_000), (5, 200_000), (5, 5)):
        monkeypatch.setattr(insights, "LISTED", listed)
        monkeypatch.setattr(insights, "BROADCAST", broadcast)
        df = insights.evidence_rows(tagged.repartition(3), "p", "java", texts)
        found[listed, broadcast] = sorted(map(str, df.collect()))
        plan = df._jdf.queryExecution().analyzed().toString()
        assert (" IN (" in plan) == (listed == 2000) and ("ResolvedHint" in plan) == (broadcast > 5)
    assert len(set(map(tuple, found.values()))) == 1 and len(found[5, 5]) == 41


@pytest.mark.parametrize("listed, broadcast", [(2000, 200_000), (5, 200_000), (5, 5)])
def test_evidence_makes_dear_tags_once(spark, monkeypatch, listed, broadcast):
    monkeypatch.setattr(insights, "LISTED", listed)
    monkeypatch.setattr(insights, "BROADCAST", broadcast)
    rows = [(str(k), "p", "Senior", "java", "t") for k in range(30)]
    made = spark.sparkContext.accumulator(0)

    def dear(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows, f"{KEYS}, {C.title} string")
    texts = df.select(C.serial).withColumn(C.text, F.lit("text"))
    assert len(insights.evidence_rows(df.mapInPandas(dear, df.schema), "p", "java", texts).collect()) == 30
    assert made.value == 30


def test_levels_from_a_table(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], f"{C.level} string")
    table = spark.createDataFrame([("A", "y"), ("A", "x"), (None, "n")], "code string, name string")
    assert sorted(str(r[0]) for r in map_levels(df, table).collect()) == ["B", "None", "x"]
