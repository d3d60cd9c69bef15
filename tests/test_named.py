"""Files of given names: all of a job or none; extraction refreshed by what changed; summaries under a budget."""

import os

import pytest
from pyspark.sql import functions as F

from dossier_spark.operators import answers as A
from dossier_spark.operators import sections as S
from dossier_spark.operators import transcripts as T
from dossier_spark.plans import registry
from dossier_spark.sources import files as S5
from dossier_spark.sources.named import read_named, write_named


def below(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_named_files(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i % 3}/n {i}.json", f'{{"é": {i}}}') for i in range(20)] + [("top.txt", "")], "name string, content string").repartition(4)
    write_named(df, f"file://{tmp_path}/out")
    assert below(tmp_path / "out") == sorted([f"c{i % 3}/n {i}.json" for i in range(20)] + ["top.txt"])
    assert (tmp_path / "out" / "c1" / "n 7.json").read_text() == '{"é": 7}'


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(f"a/{i}", "x") for i in range(50)] + [("../outside", "x")], "name string, content string").repartition(3)
    with pytest.raises(Exception, match="not below"):
        write_named(df, f"file://{tmp_path}/out")
    assert below(tmp_path) == []


def test_refresh(spark, tmp_path):
    root = tmp_path / "in"
    (root / "c").mkdir(parents=True)
    for i in range(6):
        (root / "c" / f"f {i}.txt").write_text(f"text {i}")
    (root / "c" / "x.bin").write_text("skipped")
    first = S5.written(S5.refresh(S5.listed(spark, str(root)), S5.extract(spark, str(root)).limit(0)), "snapshot")
    assert {r.was_read for r in first.collect()} == {True} and first.count() == 6
    (root / "c" / "f 2.txt").write_text("changed, and longer")
    (root / "c" / "f 3.txt").unlink()
    (root / "c" / "f 9.txt").write_text("new")
    second = {os.path.basename(r.path): (r.was_read, r.text) for r in S5.refresh(S5.listed(spark, str(root)), first).collect()}
    assert second == {"f 0.txt": (False, "text 0"), "f 1.txt": (False, "text 1"), "f 2.txt": (True, "changed, and longer"), "f 4.txt": (False, "text 4"), "f 5.txt": (False, "text 5"), "f 9.txt": (True, "new")}
    for f in (root / "c").iterdir():  # nothing that is unchanged is opened
        f.chmod(0)
    third = S5.refresh(S5.listed(spark, str(root)), S5.written(S5.refresh(S5.listed(spark, str(root)), first), "again") if os.geteuid() else first)
    assert third.count() == 6


def test_reports_stay_under_the_budget(spark):
    docs = spark.createDataFrame([("big", f"d/{i:03d}.txt", f"body {i} " * (400 if i == 7 else 30)) for i in range(90)] + [("small", "d/x.txt", "one"), ("small", "d/y.txt", None)], "client_id string, path string, text string")
    lengths = spark.sparkContext.accumulator(0)

    def model(prompt):
        assert len(prompt) <= 2500
        lengths.add(1)
        return "s" * 120

    got = {r.client_id: r for r in A.reports(docs, model, F.lit("Jo"), 2500, 120).collect()}
    assert got["big"].levels > 2 and got["small"].levels == 2 and got["big"].report == "s" * 120
    with pytest.raises(ValueError):
        A.reports(docs, model, F.lit("Jo"), 1200, 120)


def test_ten_thousand_anchors(spark):
    """As many anchors as a dictionary has, against the same ones as columns of the plan."""
    anchors = tuple((f"s{i % 40}", ("exact", "contains")[i % 2], f"{'Mot' if i % 3 else 'mot é'} {i:05d}") for i in range(10_000)) + (("s1", "regex", "^fin"), ("s2", "contains", "mot 1"), ("s3", "exact", "FIN"))
    rules = S.Ruleset(tuple((f"s{i}", False, 1.0, "copy") for i in range(40)), anchors, method_order=("exact", "contains", "regex"))
    few = S.Ruleset(rules.sections, tuple(a for a in anchors if a[2] in ("Mot 00001", "Mot 00002", "mot é 00003", "mot é 00006") or a[1] == "regex" or a[2] in ("mot 1", "FIN")), method_order=rules.method_order)
    titles = ["xx MOT 00001 yy", "Mot 00002", "mot É 00003 !", "MOT E 00006", "fin de tout", "fin", "rien", "", "ymot 1z"]
    df = spark.createDataFrame([(t,) for t in titles] + [(None,)], "title string")
    get = lambda r: [x.m and (x.m.section_id, x.m.method, x.m.confidence) for x in df.select("title", S.match_title(F.col("title"), r).alias("m")).orderBy("title").collect()]
    assert get(rules) == get(few) and sum(x is not None for x in get(rules)) == 7
    plan = df.select(S.match_title(F.col("title"), rules).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5000


def test_markdown_of_textual_names_and_manifest_names(spark):
    b = spark.createDataFrame([("Dupont Jean", "error", "Bad", "no zip")], "doc_id string, status string, error_type string, error_message string")
    for c in ("profile string", "gate_status string", "required_coverage_ratio double", "weighted_coverage double", "missing_required_sections array<string>", "unknown_titles_count int", "placeholders_count int", "reasons array<string>"):
        b = b.withColumn(c.split()[0], F.lit(None).cast(c.split()[1]))
    text = "".join(r.text for r in S.markdown_report(b, "t", "r", "y").orderBy("part", "client").collect())
    assert "### ✗ Dupont Jean\n" in text and text.endswith("## Errors\n- **Dupont Jean**: no zip\n") and "Profile Override" not in text
    segs = spark.createDataFrame([("s", 0, 0.0, 1.0, " "), ("t", 0, 0.0, 1.0, "hi")], "source_id string, seq long, start double, end double, text string")
    names = {r.name: r.content for r in T.audio_files(segs, spark.createDataFrame([("s", "/a/My talk.mp3"), ("t", "/a/b.wav")], "source_id string, audio_path string"), "now").collect()}
    assert set(names) == {"s/sources/ingested_audio/My_talk.txt", "s/sources/ingested_audio/My_talk.json", "t/sources/ingested_audio/b.txt", "t/sources/ingested_audio/b.json"}
    assert names["t/sources/ingested_audio/b.txt"].endswith("\n\n[t=0s-1s] hi\n")


def test_names_that_clash_leave_nothing(spark, tmp_path):
    """A file cannot be moved to its name: those that were go again."""
    df = spark.createDataFrame([("a", "x"), ("b/c", "x"), *[(f"a/{i}", "x") for i in range(20)]], "name string, content string").repartition(3)
    with pytest.raises(Exception, match="a"):
        write_named(df, f"file://{tmp_path}/out")
    assert below(tmp_path) == []


def test_the_driver_lists_no_named_files(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i % 3}/ü {i}", f"{i} " * 400_000 if i == 7 else f"é{i}") for i in range(60)], "name string, content string").repartition(4)
    names = write_named(df, f"file://{tmp_path}/out")
    assert len(names.inputFiles()) < 20
    got = {r["name"]: r["content"].decode() for r in read_named(names, f"file://{tmp_path}/out").collect()}
    assert got == {r["name"]: r["content"] for r in df.collect()}
    (tmp_path / "out" / "c1" / "ü 1").unlink()
    with pytest.raises(Exception, match="ü 1"):
        read_named(names, f"file://{tmp_path}/out").collect()


@pytest.mark.parametrize("name", ["S10", "S16"])
def test_queries_of_named_files_list_none(spark, sf, name):
    read = registry.queries()[name](spark, sf).inputFiles()
    assert len(read) < 100 and not [f for f in read if f.endswith((".json", ".txt"))]
