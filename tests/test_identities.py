"""Identities and id number candidates: no document is left out, and whole texts are searched."""

import pytest

from dossier_spark.plans import retrieval_queries as Q
from dossier_spark.plans import section_queries as S

LONG = "prose " * 50
DOCS = [
    (1, "plain", "de", "a", 5),
    (2, f"{LONG}\nMonsieur Jean Dupont – 756 1234 5678 90\nrest", "fr", "a", 5),
    (3, f"{LONG}756.7777.7777.77", "fr", "b", 5),
    (4, "", "fr", "b", 5),
    (5, "756.8888.8888.88", "fr", "b", 5),
    (6, "756.0000.0000.01", "fr", "b", 5),
    (7, "756.0000.0000.02", "fr", "b", 5),
    (8, "756.9999.9999.99", "fr", "b", 5),
    (11, "756.6666.6666.66", "fr", "b", 5),
]


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_identity_of_every_document(spark, small):
    got = {r.doc_id: (r.avs, r.full_name, r.surname) for r in S.identities(spark, small).collect()}
    assert set(got) == {d[0] for d in DOCS}
    assert got[1] == ("7561234567890", "Jean-Luc de Beta1", "Beta1")
    assert got[2] == ("756.1234.5678.90", "Jean Dupont", "Dupont")
    assert got[3] == ("756.7777.7777.77", "", "") and got[4] == ("", "", "")
    assert got[7] == ("756.0000.0000.02", "Beta7", "Beta7")


@pytest.mark.parametrize(
    "text,want",
    [("Madame Anna Beta – 756 1234 5678 90", ("756.1234.5678.90", "Anna", "Beta", "Anna Beta")), ("mme  Li —756-1234", ("", "", "Li", "Li")), ("M. A B\n- 756", ("", "A", "B", "A B")), ("756.12X4.5678.90", ("", "", "", "")), ("Madame A\nB - 756", ("", "", "", ""))],
)
def test_identity_fields(spark, text, want):
    from pyspark.sql import functions as F

    from dossier_spark.operators import sections

    assert tuple(spark.createDataFrame([(text,)], "t string").select(sections.identity(F.col("t"), F.lit("x")).alias("i")).first().i) == want


def test_first_five_sources_then_text(spark, small):
    """Of a: 1 (.pdf) and 2 (.txt). Of b: the first five are 3 to 7, of which only 5 is .txt; 8 and 11 are .txt but too late."""
    got = {r.client_id: r.numbers.split(",") for r in Q.id_candidates(spark, small).collect()}
    assert got == {"a": ["756.1111.2222.12", "756.3333.4444.55"], "b": ["756.1111.2222.15", "756.3333.4444.55", "756.8888.8888.88"]}
