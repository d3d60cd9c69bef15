"""Titles whose first word goes on with a letter outside ASCII: the queries end words where their SQL does."""

import duckdb
import pytest

from dossier_spark.plans import registry

TEXTS = ["Dießteie", "die é", "Undé x", "dieſ", "Diese", "die", "UND_1", "und-ß", "dieß\nund"]


@pytest.mark.parametrize("name", ["A10", "A11", "A13", "A14", "A29", "A30", "A31", "A6", "A7", "A8", "H4", "J3", "J5", "J6", "S9", "U3", "W2"])
def test_word_ends(spark, tmp_path, name):
    rows = [(i, t, "fr", "src1", len(t)) for n, t in enumerate(TEXTS) for i in (3 * n, 3 * n + 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(con.sql(registry.oracle_sql()[name]).select(*[f'"{c}"' for c in df.columns]).fetchall(), key=str)
