"""Reading, writing, staging, and the analysis from end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.operators import insights
from skilltrend.operators.extract import DictionaryExtractor
from skilltrend.plans.checkpoints import broadcast_if_small, shared_folder, staged
from skilltrend.plans.pipeline import analyze, read_analysis, tagged_with_text
from skilltrend.plans.stages import MANIFEST, Stages, publish, published
from skilltrend.sources.tables import (
    read_postings,
    read_table,
    rename_if_missing,
    require_columns,
    to_local,
    write_table,
)
from tests.test_postings import frame, posting


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_roundtrip(spark, tmp_path, fmt):
    rows = [
        (1, 'say "hi", \\n', "  edge  ", dt.datetime(2024, 1, 2, 3, 4, 5, 678901)),
        (2, "two\nlines", "", None),
        (3, None, "ünï", dt.datetime(1999, 12, 31)),
    ]
    schema = "id long, a string, b string, t timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / fmt)
    write_table(df, path, fmt)
    back = read_table(spark, path, fmt, df.schema, multiline=True)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_partitioned_output_and_many_paths(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "profession string, n int")
    write_table(df, str(tmp_path / "t"), partition_by=["profession"])
    assert sorted(p.name for p in (tmp_path / "t").glob("profession=*")) == ["profession=x", "profession=y"]
    both = read_table(spark, [str(tmp_path / "t" / f"profession={p}") for p in "xy"])
    assert both.agg(F.sum("n")).first()[0] == 3


def test_guards(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "a string, n int")
    with pytest.raises(ValueError, match="missing columns: b, c"):
        require_columns(df, ["a", "b", "c"])
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "csv")
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path), "xlsx")
    assert rename_if_missing(df, "a", "z").columns == ["z", "n"]
    assert rename_if_missing(df, "a", "n").columns == ["a", "n"]
    assert len(to_local(spark.range(10), 3)) == 3


def test_staging_uses_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder in shared_folder(spark)
    assert staged(spark.range(3), "x").count() == 3
    big, small = broadcast_if_small(spark.range(11), 10), broadcast_if_small(spark.range(10), 10)
    hinted = [df._jdf.queryExecution().analyzed().toString() for df in (big, small)]
    assert ["ResolvedHint" in text for text in hinted] == [False, True]


def test_end_to_end(spark, tmp_path):
    html = {
        "j": "<p>ReactJS &amp; Java</p>",
        "k": "<div>communication<br>java</div>",
        "l": "communications, python",
        "n": "<b>nothing</b>",
    }
    rows = [
        posting("1", **{C.scope: html["j"]}),
        posting("2", **{C.scope: html["k"]}),
        posting("3", **{C.scope: html["l"], C.level: "SIX_TEN_YEARS"}),
        posting("4", **{C.scope: html["n"]}),
        posting("5", **{C.scope: None}),
        posting("6", **{C.scope: html["j"], C.raw_profession: "AI_ENGINEER"}),
        posting("7", **{C.scope: html["j"], C.status: "DRAFT"}),
    ]
    path = str(tmp_path / "postings")
    write_table(frame(spark, rows), path, "csv")
    phrases = spark.createDataFrame(
        [(w, "HSKILL") for w in ["reactjs", "java", "communication", "communications", "python"]],
        "phrase string, entity_group string",
    )
    result = analyze(
        read_postings(spark, path, "csv", multiline=True), DictionaryExtractor(phrases), ("2024-01-01", "2024-12-31")
    )
    got = {(r[C.profession], r[C.skill]): (r["Junior"], r["Mid-level"], r["Senior"]) for r in result.matrix.collect()}
    assert got == {
        ("SOFTWARE_ENGINEER", "react"): (25.0, 0.0, 0.0),
        ("SOFTWARE_ENGINEER", "java"): (50.0, 0.0, 0.0),
        # Two spellings became one skill.
        ("SOFTWARE_ENGINEER", "communication"): (25.0, 0.0, 100.0),
        ("SOFTWARE_ENGINEER", "python"): (0.0, 0.0, 100.0),
        ("AI_ENGINEER", "react"): (100.0, 0.0, 0.0),
        ("AI_ENGINEER", "java"): (100.0, 0.0, 0.0),
    }
    assert {(r[0], r[1]): r[2] for r in result.totals.collect()} == {
        ("SOFTWARE_ENGINEER", "Junior"): 4, ("SOFTWARE_ENGINEER", "Senior"): 1, ("AI_ENGINEER", "Junior"): 1,
    }
    assert result.tagged.count() == 8
    assert C.text not in result.tagged.columns and C.text in tagged_with_text(result).columns
    rows = insights.evidence_rows(
        result.tagged, "SOFTWARE_ENGINEER", "java", result.postings, query="communication"
    ).collect()
    assert [r[C.serial] for r in rows] == ["2"]


# --- Staged folders and published results --------------------------------------


def folders(spark):
    return set(spark._jvm.java.io.File(shared_folder(spark).removeprefix("file:")).list())


def test_stages_go_after_their_last_reader(spark):
    before = folders(spark)
    with Stages(spark) as stages:
        a = stages.put(spark.range(3), "a", readers=2)
        b = stages.put(a.selectExpr("id + 1 AS id"), "b", after=[a])
        assert len(stages.open_folders()) == 2
        kept = stages.keep(a.join(b, "id"), "kept", after=[a])
        assert [path.split("/")[-1].split("-")[0] for path in stages.open_folders()] == ["b"]
        with pytest.raises(ValueError):
            stages.read(a)
    assert sorted(r[0] for r in kept.collect()) == [1, 2]
    assert [name.split("-")[0] for name in folders(spark) - before] == ["kept"]
    with pytest.raises(RuntimeError), Stages(spark) as stages:
        stages.put(spark.range(3), "lost")
        raise RuntimeError
    assert not any(name.startswith("lost") for name in folders(spark))


def test_published_tables_change_together(spark, tmp_path):
    target = str(tmp_path / "results")
    with pytest.raises(FileNotFoundError):
        published(spark, target)
    opened = []
    for run in range(4):
        df = spark.range(5).selectExpr(f"id + {run} AS n", "cast(id as string) AS s")
        publish(spark, target, {"x": df, "y": df.limit(run)}, {"x": ["s", "n"]})
        opened.append(published(spark, target))
        assert opened[-1]["x"].agg(F.min("n")).first()[0] == run and opened[-1]["y"].count() == run
        assert opened[-1]["x"].dtypes == df.dtypes
    # The run before stays for those who read it; older ones are gone.
    assert opened[-2]["x"].agg(F.min("n")).first()[0] == 2
    names = sorted(p.name for p in (tmp_path / "results").iterdir() if not p.name.startswith("."))
    assert len(names) == 3 and MANIFEST in names


def test_analysis_leaves_its_results_only(spark, tmp_path):
    rows = [posting(str(k), **{C.scope: f"<p>java &amp; python{k % 3}</p>", C.level: "SIX_TEN_YEARS" if k % 2 else "NO_EXPERIENCE"}) for k in range(12)]
    rows += [posting("1", **{C.submitted: "1/1/2024"}), posting("x", **{C.level: None})]
    phrases = spark.createDataFrame([("java", "HSKILL"), ("python1", "HSKILL"), ("python2", "HSKILL")], "phrase string, entity_group string")
    before = folders(spark)
    target = str(tmp_path / "analysis")
    options = {"top_k": None, "levels": None}
    result = analyze(frame(spark, rows), DictionaryExtractor(phrases), ("2024-01-01", "2024-12-31"), target=target, **options)
    assert folders(spark) == before
    again = read_analysis(spark, target)
    assert sorted(map(str, again.matrix.collect())) == sorted(map(str, result.matrix.collect())) and again.matrix.count() == 3
    assert {r[C.skill]: r["null"] for r in again.matrix.collect()}["java"] == 0.0
    evidence = insights.evidence_rows(again.tagged, "SOFTWARE_ENGINEER", "java", again.postings, query="python2")
    assert sorted(r[C.serial] for r in evidence.collect()) == ["11", "2", "5", "8"]
    plan = insights.evidence_rows(again.tagged, "SOFTWARE_ENGINEER", "java", again.postings)._jdf.queryExecution().executedPlan().toString()
    assert "In(" in plan.split("PushedFilters")[1] or "PushedFilters: [In(" in plan or "In(jobOpening" in plan
    # Without a target every result has a folder, and nothing else is left.
    analyze(frame(spark, rows), DictionaryExtractor(phrases))
    assert sorted(name.split("-")[0] for name in folders(spark) - before) == ["matrix", "postings", "tagged", "totals"]
