import json
import zipfile

from dossier_spark.sources import files as S

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')


def test_extract(spark, tmp_path):
    root = tmp_path / "clients"
    (root / "a" / "06 Rapport final").mkdir(parents=True)
    (root / "a" / ".git").mkdir()
    (root / "a" / "notes.txt").write_bytes("été\r\nfin".encode("latin-1"))
    (root / "a" / ".hidden").write_text("x")
    (root / "a" / ".git" / "config.txt").write_text("x")
    (root / "a" / "broken.docx").write_text("not a zip")
    docx(root / "a" / "06 Rapport final" / "source.docx", '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="28"/></w:rPr><w:t>2.1 TITRE</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Texte</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>')
    inv = {r.name: (r.client_id, r.folder, r.suffix) for r in S.inventory(spark, str(root)).collect()}
    assert inv == {"notes.txt": ("a", "", ".txt"), "broken.docx": ("a", "", ".docx"), "source.docx": ("a", "06 Rapport final", ".docx")}
    p = {r.pos: r for r in S.read_docx(spark, str(root)).filter("error is null").collect()}
    assert (p[0].text, p[0].style_name, p[0].is_bold, p[0].font_size, p[0].numbering_prefix) == ("2.1 TITRE", "Heading 1", True, 14.0, "2.1")
    assert (p[1].text, p[1].is_bold, p[2].text) == ("Texte", False, "a | b")
    got = {r.path.rsplit("/", 1)[1]: r for r in S.extract(spark, str(root)).collect()}
    assert set(got) == {"notes.txt", "broken.docx", "source.docx"} and got["broken.docx"].error == "BadZipFile"
    assert got["notes.txt"].text == "été\nfin" and got["broken.docx"].extractor == "error" and got["source.docx"].text == "2.1 TITRE\nTexte\na | b"
    assert [r.folder.rsplit("/", 1)[1] for r in S.parse_targets(S.inventory(spark, str(root))).collect()] == ["06 Rapport final"]


def test_payload_and_sinks(spark, tmp_path):
    one = tmp_path / "payload.json"
    one.write_text(json.dumps({"counts": {"ok": 1}, "documents": [{"path": "p", "text": "t", "text_sha256": "h", "mtime_iso": "2025"}]}, indent=1))
    r = S.read_payload(spark, str(one), multi_line=True).first()
    assert (r.path, r.text, r.text_sha256, r.mtime, r.extractor) == ("p", "t", "h", "2025", None)
    df = spark.createDataFrame([("a", "x", None)], "path string, text string, note string")
    S.write_corpus(df, str(tmp_path / "corpus"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "corpus")).collect()] == ["===== FILE: a =====", "x", ""]
    S.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().note == "-"
