import pytest

from dossier_spark.operators import sections as S

RAW = {
    "heading_detection": {"by_style": {"styles": [{"name": "Heading 1", "level": 1}]}},
    "title_matching": {"fuzzy_threshold": 0.8},
    "sections": [
        {"id": "identity", "required": True, "anchors": {"any": [{"exact": "Identité"}]}},
        {"id": "tests", "anchors": {"any": [{"contains": "Tests"}]}, "children": [{"id": "tests.vocation", "anchors": {"any": [{"regex": "(?i)^vocation\\b"}]}}]},
        {"id": "conclusion", "required": True, "anchors": {"any": [{"exact": "Conclusion"}]}},
    ],
}


def test_ruleset():
    r = S.Ruleset.from_mapping(RAW)
    assert [s[0] for s in r.sections] == ["identity", "tests", "tests.vocation", "conclusion"]
    assert r.required == ["identity", "conclusion"] and r.styles == {"Heading 1": 1}
    with pytest.raises(ValueError):
        S.Ruleset.from_mapping({"sections": []})


def test_titles(spark):
    r = S.Ruleset.from_mapping(RAW)
    titles = ["IDENTITE :", "Mes tests", "Vocation perso", "Conclusions", "rien", "Bilan d'orientation tests", "École"]
    got = {x.title: (x.section_id, x.method) for x in S.map_titles(spark.createDataFrame([(t,) for t in titles], "title string"), r).collect()}
    assert got["IDENTITE :"] == ("identity", "exact") and got["Mes tests"] == ("tests", "contains") and got["Vocation perso"] == ("tests.vocation", "regex")
    assert got["Conclusions"] == ("conclusion", "fuzzy") and got["rien"] == (None, None) and got["Bilan d'orientation tests"] == (None, None)


CASE = S.Ruleset(
    sections=(("identity", True, 2.0, "copy"), ("profession_formation", True, 3.0, "copy"), ("profession_formation.profession", False, 1.0, "copy"), ("profession_formation.formation", False, 1.0, "copy"), ("tests", False, 2.0, "copy"), ("competences", False, 1.5, "copy"), ("orientation_formation", True, 3.0, "copy"), ("orientation_formation.orientation", True, 1.0, "copy"), ("conclusion", False, 1.5, "copy")),
    anchors=(("identity", "exact", "Identité"), ("profession_formation", "exact", "Profession & Formation"), ("profession_formation.profession", "exact", "Profession"), ("tests", "exact", "Tests"), ("competences", "exact", "Compétences"), ("orientation_formation", "exact", "Orientation & Formation"), ("conclusion", "exact", "Conclusion")),
    styles={"H": 1},
    method_order=("exact",),
    weighted=("profession_formation.profession", "profession_formation.formation"),
)


def paragraphs(spark, docs):
    """docs: lists of (is heading, text)."""
    rows = [(d, i, text, "H" if head else "Normal", False) for d, parts in enumerate(docs) for i, (head, text) in enumerate(parts)]
    return spark.createDataFrame(rows, "doc_id int, pos int, text string, style_name string, is_bold boolean")


def test_document_from_sections(spark):
    """Inline parts, a parent after and before its child, the nested-node rule, identity."""
    docs = [
        [(1, "Identité"), (0, "Madame Anna Beta – 756 1234 5678 90"), (1, "Profession & Formation"), (0, "Profession"), (0, "15 ans"), (0, "Formation:"), (0, "CFC en 2005."), (1, "Orientation & Formation"), (0, "Orientation"), (0, "vers la cyber"), (0, "Stage"), (0, "3 mois TODO"), (1, "Inconnu"), (0, "x")],
        [(0, "no heading at all")],
        [(1, "Profession & Formation"), (0, "texte sans parties"), (1, "Profession"), (0, "maçon")],
        [(1, "Profession"), (0, "maçon"), (1, "Profession & Formation"), (0, "texte sans parties")],
        [(1, "Identité"), (0, "personne"), (1, "Tests"), (0, " "), (1, "Compétences"), (0, "Sociales: bonnes")],
    ]
    r = {x.doc_id: x for x in S.report(paragraphs(spark, docs), CASE).collect()}
    leaves = {d: {p.path: p.text for p in x.leaves} for d, x in r.items()}
    assert leaves[0]["profession_formation.profession"] == "15 ans" and leaves[0]["profession_formation.formation"] == "CFC en 2005."
    assert leaves[0]["orientation_formation.stage"] == "3 mois TODO" and leaves[0]["identity.name"] == "Anna" and leaves[0]["identity.avs"] == "756.1234.5678.90"
    assert list(r[0].missing_required) == [] and r[0].required_coverage == 1.0 and r[0].placeholders == 1 and r[0].unknown_titles == 1 and list(r[0].failed) == []
    assert r[0].weighted_coverage == pytest.approx((2 + 3 + 3 + 2) / 17)
    # an empty document: only the node that holds nodes counts
    assert r[1].weighted_coverage == pytest.approx(2 / 17) and list(r[1].found) == [] and r[1].status == "NO-GO"
    # a child after its parent keeps the parent's text as _raw; before it, the child is lost and the parts are not found
    assert leaves[2] == {"profession_formation._raw": "texte sans parties", "profession_formation.profession": "maçon"} and list(r[2].failed) == []
    assert leaves[3] == {} and list(r[3].failed) == ["profession_formation"] and "Inline split failed for profession_formation (expected: profession, formation)" in r[3].warnings
    assert "Weighted section missing (not blocking): profession_formation.profession" in r[3].warnings and "profession_formation.profession" not in r[2].missing_weighted
    # text that is only blank replaces the node and does not fill it; identity without number or name is not filled
    assert "identity" in r[4].missing_required and leaves[4]["competences.sociales"] == "bonnes" and r[4].weighted_coverage == pytest.approx(1.5 / 17)
    strict = {x.doc_id: x.weighted_coverage for x in S.report(paragraphs(spark, docs), CASE, strict=True).collect()}
    assert strict[1] == 0


@pytest.mark.parametrize(
    "parent,content,want",
    [
        ("profession_formation", "Profession\nLe bénéficiaire a 15 ans.\n\nFormation\nCFC obtenu.\nAutre titre", {"profession": "Le bénéficiaire a 15 ans.", "formation": "CFC obtenu."}),
        ("orientation_formation", "Orientation:\nvers\n\n\nla cyber\nStage :\n3 mois\nTitre", {"orientation": "vers\nla cyber", "stage": "3 mois\nTitre"}),
        ("competences", "Professionnelles\nExpertise", {"sociales": "", "professionnelles": "Expertise"}),
        ("competences", "rien", None),
        ("tests", "Profession\nx", None),
        ("profession_formation", "Formation continue suivie", None),
    ],
)
def test_inline(spark, parent, content, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(content,)], "t string").select(S.inline_split(parent, F.col("t")).alias("m")).first().m == want


@pytest.mark.parametrize("old,new,want", [("abc", "abc", "abc"), ("abc", "", "abc"), ("", "x", "x"), ("abcdef", "bcd", "abcdef"), ("abcd", "xabcdx"[:5], "abcd"), ("abc", "abcdefg", "abcdefg"), ("abcd", "wxyz", "abcd\n\nwxyz")])
def test_merge(spark, old, new, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(old, new)], "a string, b string").select(S.merged(F.col("a"), F.col("b"))).first()[0] == want


def test_placeholder_context(spark):
    text = "q" * 60 + " todo\n" + "y" * 60 + " a...b [ ] c"
    got = sorted(tuple(r) for r in S.placeholder_hits(spark.createDataFrame([(1, "tests", text), (2, "tests", "plain")], "doc_id int, path string, text string")).collect())
    assert [(d, p, n) for d, p, n, _ in got] == [(1, "tests", "..."), (1, "tests", "TODO"), (1, "tests", "[ ]")]
    assert dict((n, c) for *_, n, c in got)["TODO"] == "q" * 49 + " todo " + "y" * 49


def test_batch(spark):
    docs = [[(1, "Identité"), (0, "Madame Anna Beta – 756 1234 5678 90")], [(1, "Inconnu"), (0, "x")]]
    failed = spark.createDataFrame([(9, "BadZipFile", "not a zip")], "doc_id int, error_type string, error_message string")
    b = S.batch_rows(S.report(paragraphs(spark, docs), CASE), failed).cache()
    rows = {r.doc_id: r for r in b.collect()}
    assert rows[9].status == "error" and rows[9].gate_status is None and rows[0].required_coverage_ratio == 0.25
    s = S.batch_summary(b).first()
    assert (s.total, s.successful, s.errors, s.go, s.no_go, s.mean_coverage) == (3, 2, 1, 0, 2, 0.083)
    chosen = spark.createDataFrame([(0,), (9,)], "doc_id int")
    assert S.selection_summary(b, chosen).first().mean_coverage == 0.25
    csv = {r.client_folder: r for r in S.csv_rows(b).collect()}
    assert (csv["9"].profile_selected, csv["9"].required_coverage, csv["0"].required_coverage) == ("-", "0.000", "0.250")
    md = {r.doc_id: r.text for r in S.markdown(b).collect()}
    assert "- **Message**: not a zip" in md[9] and "  - `profession_formation`" in md[0] and "- **Reasons**:" in md[0]


def test_report_is_one_scan_and_one_shuffle(spark, tmp_path):
    """The whole report within one clustering by document."""
    paragraphs(spark, [[(1, "Identité"), (0, "x")]]).write.parquet(str(tmp_path / "p"))
    plan = S.report(spark.read.parquet(str(tmp_path / "p")), CASE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
