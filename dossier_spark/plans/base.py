"""Registry of queries and their SQL, and adapters from the shared tables to library inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_spark.sources.files import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Client documents: client is the source, the path names the document."""
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("client_id"), F.format_string("%s/doc_%d.txt", "source", "doc_id").alias("path"), F.lit(None).cast("int").alias("page"), "text", "doc_id")


# What is added to some documents so that they have the sections of a case file.
CASE = "text || case doc_id % 4 when 1 then '{0}SUITE UNIQUE{0}Orientation{0}vers ' || source || '{0}Stage :{0}trois mois TODO' when 2 then '{0}IDENTITE DU CLIENT{0}Monsieur Jean Bon' || doc_id || ' – 756.1234-5678.9' || doc_id % 10 else '' end"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of documents: the non-empty lines, in order; bold where doc_id + pos is a multiple of 5."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.expr(CASE.format("\\n")), "\n")).alias("pos", "text"))
    return d.filter("text <> ''").withColumn("is_bold", F.expr("(doc_id + pos) % 5 = 0")).withColumn("style_name", F.expr("case when pos = 0 and doc_id % 3 = 0 then 'Heading 1' else 'Normal' end"))


SUFFIX = "element_at(array('.docx', '.pdf', '.txt'), cast(doc_id % 3 as int) + 1)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """A file inventory derived from documents: folder by doc_id % 8, name by % 11, suffix by % 3."""
    folder = "element_at(array('01 Dossier personnel', '02 CV', '03 Tests et bilans', '04 Stages', '05 Mesures AI', '06 Rapport final', '07 Suivi', ''), cast(doc_id % 8 as int) + 1)"
    name = f"concat(element_at(array('rapport_final_', 'bilan_', 'notes_', 'template_', 'cv_', 'lettre_', 'synthese_', 'copie_rapport_', 'photo_', 'evaluation_', 'doc_'), cast(doc_id % 11 as int) + 1), doc_id, {SUFFIX})"
    d = table(spark, sf, "documents").selectExpr("source as client_id", f"{folder} as folder", f"{name} as name", f"{SUFFIX} as suffix", "n_chars as size_bytes", "doc_id as mtime", "doc_id")
    return d.withColumn("path", F.expr("concat_ws('/', client_id, nullif(folder, ''), name)"))


FILES_SQL = """
files as (select *, client_id || '/' || case when folder = '' then '' else folder || '/' end || name as path from (
  select source as client_id, ['01 Dossier personnel', '02 CV', '03 Tests et bilans', '04 Stages', '05 Mesures AI', '06 Rapport final', '07 Suivi', ''][doc_id % 8 + 1] as folder,
    ['rapport_final_', 'bilan_', 'notes_', 'template_', 'cv_', 'lettre_', 'synthese_', 'copie_rapport_', 'photo_', 'evaluation_', 'doc_'][doc_id % 11 + 1] || doc_id || ['.docx', '.pdf', '.txt'][doc_id % 3 + 1] as name,
    ['.docx', '.pdf', '.txt'][doc_id % 3 + 1] as suffix, n_chars as size_bytes, doc_id as mtime, doc_id from documents))
"""
LINES_SQL = rf"""
lines as (select doc_id, pos - 1 as pos, text, (doc_id + pos - 1) % 5 = 0 as is_bold, case when pos = 1 and doc_id % 3 = 0 then 'Heading 1' else 'Normal' end as style_name
  from (select doc_id, unnest(string_split(t, chr(10))) as text, generate_subscripts(string_split(t, chr(10)), 1) as pos from (select doc_id, {CASE.format("' || chr(10) || '")} as t from documents)) where text <> '')
"""
N1 = r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
CHUNKS_SQL = rf"""
norm as (select doc_id, source as client_id, source || '/doc_' || doc_id || '.txt' as path, {N1.format('text')} as t from documents),
pieces as (select doc_id, client_id, path, i, {STRIP.format("substr(t, i * 1000 + 1, 1200)")} as chunk
  from (select *, unnest(range(0, case when length(t) <= 1200 then 1 else cast(1 + ceil((length(t) - 1200) / 1000.0) as bigint) end)) as i from norm)),
chunks as (select doc_id, client_id, path, row_number() over (partition by path order by i) - 1 as chunk_no, chunk from pieces where chunk <> '')
"""
# The longest common block of a and b, as 10000 times its length plus 9999 less its first place in a; then the same to its
# left and its right. `pairs` has a and b.
BLOCK = "list_max(flatten([[k * 10000 + 9999 - i for k in range(1, length(a) - i + 2) if contains(b, substr(a, i, k))] for i in range(1, length(a) + 1)]))"
ALIKE_SQL = f"""
blocks as (select a as x, b as y, a, b, {BLOCK} as m from (select distinct a, b from pairs)
  union all select x, y, a, b, {BLOCK} as m from (
    select x, y, case s when 1 then substr(a, 1, i - 1) else substr(a, i + k) end as a, case s when 1 then substr(b, 1, j - 1) else substr(b, j + k) end as b
    from (select *, instr(b, substr(a, i, k)) as j from (select *, m // 10000 as k, 9999 - m % 10000 as i from blocks where m is not null)), (values (1), (2)) sides(s)) where a <> '' and b <> ''),
alike as (select x as a, y as b, case when length(x) + length(y) = 0 then 1.0::double else 2.0::double * coalesce(sum(m // 10000), 0)::double / (length(x) + length(y))::double end as ratio from blocks group by x, y)
"""
