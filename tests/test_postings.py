"""Cleaning postings: hand-worked rows for every edge the cleaning has."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.columns import posting_schema
from skilltrend.functions.values import in_date_range, parse_month_first, percent_label, replace_patterns
from skilltrend.columns import PROFESSION_RULES
from skilltrend.operators import postings as module
from skilltrend.operators.postings import clean_postings, dedupe_postings, level_totals

RANGE = ("2024-01-01", "2024-12-31")


def posting(serial, **changes):
    row = {
        C.serial: serial,
        C.raw_profession: "SOFTWARE_ENGINEER_WEB",
        C.status: "APPROVED",
        C.contract_type: "FULL_TIME",
        C.submitted: "3/1/2024",
        C.level: "NO_EXPERIENCE",
        C.scope: "<p>java</p>",
        C.title: "Engineer",
    }
    return {**row, **changes}


def frame(spark, rows):
    schema = posting_schema()
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)


def cleaned(spark, rows, **options):
    out = clean_postings(frame(spark, rows), options.pop("date_range", RANGE), **options)
    return {r[C.serial]: r for r in out.collect()}


def test_profession_rule(spark):
    values = ["SOFTWARE_ENGINEER_WEB", "SOFTWARE_ENGINEER", "X_SOFTWARE_ENGINEER_WEB", "AI_ENGINEER", None]
    values += ["SOFTWARE_ENGINEER_A\nSOFTWARE_ENGINEER_B"]
    df = spark.createDataFrame([(v,) for v in values], "p string")
    got = [r[0] for r in df.select(replace_patterns(F.col("p"), PROFESSION_RULES)).collect()]
    assert got == ["SOFTWARE_ENGINEER", "SOFTWARE_ENGINEER", "X_SOFTWARE_ENGINEER", "AI_ENGINEER", None,
                   "SOFTWARE_ENGINEER\nSOFTWARE_ENGINEER_B"]


def test_filters_levels_and_copies(spark):
    rows = [
        posting("a"),
        posting("b", **{C.status: None}),
        posting("c", **{C.status: "DRAFT"}),
        posting("d", **{C.contract_type: "INTERN"}),
        posting("e", **{C.level: "INTERN", C.submitted: "1/5/2024"}),
        posting("f", **{C.submitted: None}),
        posting("g", **{C.submitted: "12/1/2023"}),
        posting("g", **{C.submitted: "2/1/2024", C.level: "SIX_TEN_YEARS"}),
        posting(None),
        posting(None, **{C.submitted: "5/1/2024"}),
    ]
    got = cleaned(spark, rows)
    assert set(got) == {"a", "e", "g", None}
    assert got["a"][C.level] == "Junior" and got["a"][C.profession] == "SOFTWARE_ENGINEER"
    assert got["e"][C.level] == "INTERN"
    assert got["e"][C.submitted_at] == dt.datetime(2024, 1, 5)
    # The latest copy survives, and only then is the range tested.
    assert got["g"][C.level] == "Senior"
    assert got[None][C.submitted_at] == dt.datetime(2024, 5, 1)
    # Without exactly two dates nothing is tested.
    assert set(cleaned(spark, rows, date_range=None)) == {"a", "e", "f", "g", None}
    assert set(cleaned(spark, rows, date_range=["2024-01-01"])) == {"a", "e", "f", "g", None}


def test_range_is_tested_on_the_survivor(spark):
    rows = [posting("a", **{C.submitted: "5/1/2024"}), posting("a", **{C.submitted: "5/1/2025"})]
    assert cleaned(spark, rows) == {}


def test_bad_dates(spark):
    rows = [posting("a", **{C.submitted: "garbage"})]
    with pytest.raises(Exception, match="(?i)parse|date"):
        cleaned(spark, rows)
    assert cleaned(spark, rows, strict_dates=False) == {}
    df = spark.createDataFrame([("1/5/2024",), ("01/05/2024",)], "d string")
    assert {r[0] for r in df.select(parse_month_first(F.col("d"))).collect()} == {dt.date(2024, 1, 5)}


def test_strict_dates_do_not_depend_on_ansi_mode(spark):
    df = spark.createDataFrame([("garbage",)], "d string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="date"):
            df.select(parse_month_first(F.col("d"))).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_rules_with_groups(spark):
    df = spark.createDataFrame([("X_DATA_ENGINEER_WEB",), ("AI_ENGINEER_AI_ENGINEER_",), ("other",)], "p string")
    rule = [(r"(DATA|AI)_ENGINEER_", "$1-")]
    got = [r[0] for r in df.select(replace_patterns(F.col("p"), rule)).collect()]
    assert got == ["X_DATA-WEB", "AI-AI_ENGINEER_", "other"]


def test_real_dates_and_last_day(spark):
    df = frame(spark, [posting("a"), posting("b")]).withColumn(
        C.submitted,
        F.when(F.col(C.serial) == "a", F.lit("2024-12-31 00:00:00")).otherwise("2024-12-31 10:00:00").cast("timestamp_ntz"),
    )
    assert [r[C.serial] for r in clean_postings(df, RANGE).collect()] == ["a"]
    assert clean_postings(df, RANGE, end_inclusive_day=True).count() == 2
    assert df.where(in_date_range(F.col(C.submitted), (1, 2, 3))).count() == 2


def test_totals_and_null_groups(spark):
    rows = [posting("a"), posting("b"), posting("c", **{C.level: None}), posting("d", **{C.raw_profession: None})]
    totals = level_totals(clean_postings(frame(spark, rows)))
    got = {(r[0], r[1]): r[2] for r in totals.collect()}
    assert got == {("SOFTWARE_ENGINEER", "Junior"): 2, ("SOFTWARE_ENGINEER", None): 1, (None, "Junior"): 1}
    assert clean_postings(frame(spark, rows), professions=["AI_ENGINEER"]).isEmpty()


def test_survivor_does_not_depend_on_partitioning(spark):
    rows = [posting(str(i % 7), **{C.title: f"t{i}", C.level: f"L{i % 5}"}) for i in range(200)]
    df = frame(spark, rows)
    one = {tuple(r) for r in clean_postings(df.coalesce(1)).collect()}
    many = {tuple(r) for r in clean_postings(df.repartition(13)).collect()}
    assert one == many and len(one) == 7


def test_percent_label(spark):
    values = [0.0, 100.0, 6.25, 6.75, 0.15, 0.05, 12.35, 99.95, -1.25, 1e-9, 2048.25, 2048.35, 4095.75, 1e6 + 0.25, 2.0**60, -2048.75, 0.96, 9.999, 2047.96] + [i / 20 for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(percent_label(F.col("v"))).collect()] == [f"{v:.1f}%" for v in values]


def test_dedupe_prunes_before_the_shuffle(spark):
    plan = clean_postings(frame(spark, [posting("a")]).drop(C.scope))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_long_texts_are_neither_sorted_nor_moved(spark):
    rows = [posting(str(k % 30), **{C.submitted: f"{k % 12 + 1}/1/2024", C.scope: f"<p>{k}</p>"}) for k in range(60)]
    kept = dedupe_postings(frame(spark, rows))
    lines = kept._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [line for line in lines if ("Sort [" in line or "Exchange" in line) and C.scope in line]
    assert not moved and any("BroadcastHashJoin" in line for line in lines)
    best = {}
    for row in rows:
        month = int(row[C.submitted].split("/")[0])
        best[row[C.serial]] = max(best.get(row[C.serial], (0, "")), (month, row[C.scope]))
    assert {r[C.serial]: r[C.scope] for r in kept.collect()} == {key: scope for key, (_, scope) in best.items()}


def test_wide_copies_that_tie(spark, monkeypatch):
    rows = [posting("a", **{C.title: t}) for t in ("x", "y", "x", "x")] + [posting("b"), posting("b")]
    rows += [posting("c", **{C.submitted: s}) for s in (None, "2/1/2024", "junk")] + [posting(None, **{C.title: t}) for t in ("p", "p", "q")]
    rows += [posting("d", **{C.submitted: None, C.scope: None})] * 3
    some = [dedupe_postings(frame(spark, rows).repartition(n)).collect() for n in (1, 3, 7)]
    monkeypatch.setattr(module, "BROADCAST_KEYS", 0)
    some.append(dedupe_postings(frame(spark, rows)).collect())
    assert all(sorted(map(str, found)) == sorted(map(str, some[0])) for found in some)
    assert sorted(str(r[C.serial]) for r in some[0]) == ["None", "a", "b", "c", "d"]
    assert {r[C.serial]: r[C.submitted] for r in some[0]}["c"] == "2/1/2024"
    assert dedupe_postings(frame(spark, [])).count() == 0
