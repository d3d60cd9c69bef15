"""Registered queries: files and sinks, written from the documents and read back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier_spark.sources import files as S

from .base import CHUNKS_SQL, N1, STRIP, documents, place, query, table
from .retrieval_queries import chunked


TREE = "source || '/' || case doc_id % 4 when 0 then '06 Rapport final/' when 1 then '.hidden/' when 2 then 'a/b/' else '' end || case when doc_id % 7 = 0 then '.' else '' end || 'doc_' || doc_id || case when doc_id % 3 = 0 then '.txt' else '.docx' end"


def folder_tree(spark, sf, name):
    """The documents as files of client folders, some hidden or in hidden folders: (root, rows that were written). Each task
    writes its own files through the file system of the shared folder."""
    root = place(spark, name)
    S.write_files(as_files(spark, sf), root)
    return root


def as_files(spark, sf):
    """Documents as file contents (rel, content): texts in UTF-8 or Latin-1, others as DOCX of which every 13th is broken."""
    d = table(spark, sf, "documents").select("doc_id", F.expr(TREE).alias("rel"), "text")
    txt = d.filter("doc_id % 3 = 0").select("rel", F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.concat(F.lit("é"), F.regexp_replace("text", r"[^\x00-\xFF]", "?")), "ISO-8859-1")).alias("content"))
    return txt.unionByName(d.filter("doc_id % 3 <> 0").select("rel", docx_bytes("doc_id", clean_text()).alias("content")))


LISTED = f"listed as (select doc_id, source as client_id, rel, text from (select *, {TREE} as rel from documents) where doc_id % 4 <> 1 and doc_id % 7 <> 0)"


@query("S1", f"with {LISTED} select client_id, rel, string_split(rel, '/')[-1] as name, case when len(string_split(rel, '/')) > 2 then string_split(rel, '/')[2] else '' end as folder, case when doc_id % 3 = 0 then '.txt' else '.docx' end as suffix from listed")
def listing(spark, sf):
    """Documents written as files, then listed without reading them; hidden ones are left out."""
    root = folder_tree(spark, sf, "tree")
    inv = S.inventory(spark, root)
    return inv.select("client_id", F.concat_ws("/", "client_id", F.col("rel")).alias("rel"), "name", "folder", "suffix")


@query("S2", "select doc_id, case when doc_id % 2 = 0 then text else 'é' || regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g') end as text from documents")
def decoding(spark, sf):
    """Whole texts in UTF-8, and in Latin-1, which their accent makes invalid UTF-8."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(F.concat(F.lit("é"), F.regexp_replace("text", r"[^\x00-\xFF]", "?")), "ISO-8859-1"))
    return table(spark, sf, "documents").select("doc_id", S.as_text(raw).alias("text"))


@query("S6", r"select path, coalesce(string_agg(t, chr(10) || chr(10) order by page) filter (where not regexp_matches(t, '^\s*$')), '') as text, count(*) as n_pages from (select doc_id::varchar as path, i as page, case when i % 3 = 1 then ' ' else substr(text, i * 500 + 1, 500) end as t from (select doc_id, text, unnest(range(0, (length(text) + 499) // 500 + 1)) as i from documents)) group by 1")
def pages(spark, sf):
    """Documents laid out in pages of 500 characters, every third one blank, and joined again."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.expr("int((length(text) + 499) / 500)"))).alias("page"))
    return S.joined_pages(d.select(F.col("doc_id").cast("string").alias("path"), "page", F.when(F.col("page") % 3 == 1, F.lit(" ")).otherwise(F.substring("text", F.col("page") * 500 + 1, F.lit(500))).alias("text")))


@query("S7", "select doc_id::varchar as path, text, sha256(text) as text_sha256 from documents")
def payload(spark, sf):
    """Documents written as payloads of a hundred documents at most, and read back."""
    one = F.struct(F.col("doc_id").cast("string").alias("path"), "text", F.sha2("text", 256).alias("hash"))
    path = place(spark, "payload")
    S.write_json(table(spark, sf, "documents").groupBy("source", F.floor(F.col("doc_id") / 100).alias("part")).agg(F.collect_list(one).alias("documents")), path)
    return S.read_payload(spark, path).select("path", "text", "text_sha256")


@query("S8", "select distinct source as folder from documents where doc_id % 11 = 3 order by 1")
def targets(spark, sf):
    f = table(spark, sf, "documents").select(F.expr("concat(source, '/', if(doc_id % 11 = 3, 'source.docx', 'x.docx'))").alias("path"), F.expr("if(doc_id % 11 = 3, 'source.docx', 'x.docx')").alias("name"))
    return S.parse_targets(f)


@query("S13", f"with {CHUNKS_SQL} select path, chunk_no, chunk from chunks")
def chunk_dump(spark, sf):
    path = place(spark, "chunks")
    S.write_json(chunked(spark, sf), path)
    return spark.read.schema("path string, chunk_no long, chunk string").json(path)


@query("S15", r"select unnest(regexp_split_to_array('===== FILE: ' || source || '/doc_' || doc_id || '.txt =====' || chr(10) || text || chr(10), '\r\n|\r|\n')) as line from documents where trim(text) <> ''")
def corpus(spark, sf):
    """The corpus file, written and read back."""
    path = place(spark, "corpus")
    S.write_corpus(documents(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def pack_docx(i: int, text: str) -> bytes:
    """A text as DOCX: a paragraph a line, the first one a bold heading, and it and a cell as a row of a table; every 13th is broken."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buf, lines = io.BytesIO(), text.split("\n")
    body = "".join(f"<w:p>{'<w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>' if n == 0 else ''}<w:r>{'<w:rPr><w:b/></w:rPr>' if n == 0 else ''}<w:t>{escape(t)}</w:t></w:r></w:p>" for n, t in enumerate(lines))
    cells = "".join(f"<w:tc><w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p></w:tc>" for t in (lines[0], "cell"))
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}<w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>")
    return buf.getvalue() if i % 13 else b"broken"


def docx_bytes(ids: str, texts: Column) -> Column:
    @F.arrow_udf("binary")
    def pack(i: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([pack_docx(x.as_py(), y.as_py()) for x, y in zip(i, t, strict=True)], pa.binary())

    return pack(ids, texts)


def clean_text():
    return F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", " ")


def as_docx(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), docx_bytes("doc_id", clean_text()).alias("content"))


CLEAN = "regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', ' ', 'g')"
LINES = f"l0 as (select doc_id, unnest(string_split({CLEAN}, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents where doc_id % 13 > 0), l as (select doc_id, doc_id::varchar as path, n, {STRIP.format('t')} as t, false as in_table from l0 where {STRIP.format('t')} <> '' union all select doc_id, doc_id::varchar, 1000000000, {STRIP.format('t')} || ' | cell', true from l0 where n = 0)"


@query("S3", f"with {LINES} select path, string_agg(t, chr(10) order by n) as text from l group by 1")
def docx_text(spark, sf):
    return S.docx_texts(S.parse_docx(as_docx(spark, sf))).filter("error is null").select("path", "text")


@query("S4", f"with {LINES} select path, row_number() over (partition by path order by n) - 1 as pos, case when in_table then 'Table' when n = 0 then 'Heading1' else 'Normal' end as style_name, n = 0 as is_bold, in_table from l")
def docx_rows(spark, sf):
    return S.parse_docx(as_docx(spark, sf)).filter("error is null").select("path", F.col("pos").cast("long").alias("pos"), "style_name", "is_bold", "in_table")


LATIN = r"case when doc_id % 2 = 0 then listed.text else 'é' || regexp_replace(listed.text, '[^\x00-\x{FF}]', '?', 'g') end"


@query("S5", rf"""with {LISTED}, {LINES}, dx as (select doc_id, {N1.format("string_agg(t, chr(10) order by n)")} as text from l group by 1),
  x as (select rel, case when doc_id % 3 = 0 then '.txt' else '.docx' end as ext, case when doc_id % 3 = 0 then 'text' when doc_id % 13 = 0 then 'error' else 'docx' end as extractor,
   case when doc_id % 3 = 0 then {N1.format(LATIN)} else coalesce(dx.text, '') end as text, case when doc_id % 3 > 0 and doc_id % 13 = 0 then 'BadZipFile' end as error from listed left join dx using (doc_id))
  select rel, ext, extractor, text, sha256(text) as text_sha256, error from x""")
def extracted(spark, sf):
    """All files of the client folders extracted by their suffix; failures stay as rows."""
    root = folder_tree(spark, sf, "sources")
    d = S.extract(spark, root)
    return d.select(F.regexp_replace("path", "^.*?/sources-[0-9a-f]+/", "").alias("rel"), "ext", "extractor", "text", "text_sha256", "error")


@query("F10_refresh", rf"""with {LISTED}, {LINES}, dx as (select doc_id, {N1.format("string_agg(t, chr(10) order by n)")} as text from l group by 1)
  select rel, ends_with(rel, '0.txt') as was_read, sha256(case when ends_with(rel, '0.txt') then 'new text of ' || rel when doc_id % 3 = 0 then {N1.format(LATIN)} else coalesce(dx.text, '') end) as text_sha256
  from listed left join dx using (doc_id) where not ends_with(rel, '1.txt')""")
def refreshed(spark, sf):
    """An extraction brought up to date: a tenth of the text files changed, another tenth gone; only the former are read."""
    root = folder_tree(spark, sf, "refreshed")
    before = S.written(S.extract(spark, root), "snapshot")
    rel = F.regexp_replace("path", "^.*?/refreshed-[0-9a-f]+/", "")
    S.write_files(before.select(rel.alias("rel")).filter("endswith(rel, '0.txt')").withColumn("content", F.encode(F.concat(F.lit("new text of "), "rel"), "UTF-8")), root)
    listing = S.listed(spark, root).filter("not endswith(path, '1.txt')")
    return S.refresh(listing, before).select(rel.alias("rel"), "was_read", "text_sha256")
