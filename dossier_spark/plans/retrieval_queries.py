"""Registered queries: chunks, tokens, BM25, prompts, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_spark.functions import text as X
from dossier_spark.operators import retrieval as R
from dossier_spark.sources import files as S
from dossier_spark.sources.files import write_context

from .base import CHUNKS_SQL, FILES_SQL, LINES_SQL, N1, STRIP, SUFFIX, documents, files, lines, place, query, table

STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOK = f"list_filter(list_transform(regexp_extract_all({{0}}, '[A-Za-zÀ-ÖØ-öø-ÿ0-9'']+'), lambda x: lower(x)), lambda x: length(x) > 1 and not list_contains([{STOP}], x))"
BM25_SQL = rf"""with {CHUNKS_SQL},
tok as (select client_id, path, chunk_no, {TOK.format('chunk')} as t from chunks),
post as (select client_id, path, chunk_no, term, count(*) as tf, any_value(dl) as dl from (select client_id, path, chunk_no, len(t) as dl, unnest(t) as term from tok) group by all),
stats as (select client_id, count(*) as n, avg(len(t)) as avgdl from tok group by 1),
dfs as (select client_id, term, count(*) as df from post group by 1, 2),
q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({TOK.format('text')}) as term from benchmark) group by 1, 2),
scored as (select client_id, query_id, path, chunk_no, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * qtf), 6) as score
  from post join q using (term) join dfs using (client_id, term) join stats using (client_id) group by all),
ranked as (select *, row_number() over (partition by client_id, query_id order by score desc, path, chunk_no) as rank from scored where score > 0)
"""


def chunked(spark, sf):
    return R.chunks(documents(spark, sf))


def questions(spark, sf):
    """The whole text of each benchmark item."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def top(spark, sf, k=5):
    return R.best_passages(chunked(spark, sf), questions(spark, sf), k)


@query("N1", f"select doc_id, {N1.format('text')} as text from documents")
def newlines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.normalise_newlines(F.col("text")).alias("text"))


@query("N2", f"with {CHUNKS_SQL} select doc_id, count(*) as n_chunks, sum(length(chunk)) as n_chars, max(length(chunk)) as longest from chunks group by 1")
def chunking(spark, sf):
    d = documents(spark, sf).select("doc_id", F.explode(R.chunk_array(X.normalise_newlines(F.col("text")))).alias("chunk"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.max(F.length("chunk")).cast("long").alias("longest"))


@query("N3", f"with {CHUNKS_SQL} select client_id, path, string_split(path, '/')[-1] || '::c' || chunk_no as chunk_id from chunks")
def chunk_ids(spark, sf):
    return chunked(spark, sf).select("client_id", "path", "chunk_id")


@query("W5", f"with {CHUNKS_SQL} select path, max(chunk_no) + 1 as n, min(chunk_no) as first_no, count(distinct chunk_no) as distinct_no from chunks group by 1")
def dense_numbers(spark, sf):
    return chunked(spark, sf).groupBy("path").agg((F.max("chunk_no") + 1).cast("long").alias("n"), F.min("chunk_no").cast("long").alias("first_no"), F.countDistinct("chunk_no").alias("distinct_no"))


@query("N4", f"select doc_id, array_to_string({TOK.format('text')}, ' ') as tokens from documents")
def tokenise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query("N5", "select doc_id, sha256(text) as sha from documents")
def sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("A1", BM25_SQL + "select client_id, path, chunk_no, term, tf from post")
def term_frequency(spark, sf):
    return R.postings(R.chunk_tokens(chunked(spark, sf))).select("client_id", "path", F.col("chunk_no").cast("long").alias("chunk_no"), "term", "tf")


@query("A2", BM25_SQL + "select client_id, n as n_chunks, avgdl from stats")
def chunk_stats(spark, sf):
    return R.chunk_stats(R.chunk_tokens(chunked(spark, sf))).select("client_id", "n_chunks", "avgdl")


@query("A3", BM25_SQL + "select client_id, term, df from dfs")
def document_frequency(spark, sf):
    return R.document_frequency(R.postings(R.chunk_tokens(chunked(spark, sf))))


@query("A4", BM25_SQL + "select client_id, query_id, path, chunk_no, score from scored")
def scores(spark, sf):
    return R.bm25(chunked(spark, sf), questions(spark, sf)).select("client_id", "query_id", "path", F.col("chunk_no").cast("long").alias("chunk_no"), "score")


@query("J13", BM25_SQL + "select client_id, query_id, term, qtf, df from q join dfs using (term)")
def query_term_join(spark, sf):
    df = R.document_frequency(R.postings(R.chunk_tokens(chunked(spark, sf))))
    return R.query_document_frequency(questions(spark, sf), df).select("client_id", "query_id", "term", "qtf", "df")


@query("W3", BM25_SQL + "select client_id, query_id, rank, path, chunk_no, score from ranked where rank <= 5")
def top_k(spark, sf):
    return top(spark, sf).select("client_id", "query_id", F.col("rank").cast("long").alias("rank"), "path", F.col("chunk_no").cast("long").alias("chunk_no"), "score")


@query("T5", BM25_SQL + "select client_id, query_id, rank, path from (select *, count(*) over (partition by client_id, query_id) as n from ranked where rank <= 9) where rank <= greatest(3, n // 2)")
def retry(spark, sf):
    return R.retry_passages(top(spark, sf, 9)).select("client_id", "query_id", F.col("rank").cast("long").alias("rank"), "path")


@query("S14", BM25_SQL + """select client_id, query_id, query, 5 as topk, rank, score, string_split(path, '/')[-1] || '::c' || chunk_no as chunk_id, path as source_path, null::int as page, chunk as text
  from ranked join chunks using (client_id, path, chunk_no) join (select item_id as query_id, text as query from benchmark) using (query_id) where rank <= 5""")
def context_export(spark, sf):
    """Contexts written as JSON, read back and laid out by result."""
    path = place(spark, "contexts")
    write_context(R.context_export(top(spark, sf), chunked(spark, sf), questions(spark, sf), 5), path)
    back = spark.read.schema("client_id string, query_id long, query string, topk int, results array<struct<rank:long,score:double,chunk_id:string,source_path:string,page:int,text:string>>").json(path)
    return back.select("client_id", "query_id", "query", "topk", F.explode("results").alias("r")).select("client_id", "query_id", "query", "topk", "r.*")


NAMED = "string_split(path, '/')[-1]"


@query("N26", BM25_SQL + rf""", asked as (select client_id, item_id as query_id, 1 + item_id % 3 as max_lines, case when item_id % 4 = 0 then 'A1, B' || item_id end as allowed, 'item ' || item_id as instruction from benchmark, (select distinct source as client_id from documents)),
  got as (select client_id, query_id, string_agg('[' || rank || '] ' || {NAMED} || ' : ' || case when length(flat) > 500 then substr(flat, 1, 500) || '…' else flat end, chr(10) order by rank) as passages
  from ranked join (select *, {STRIP.format("regexp_replace(chunk, '[' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ]+', ' ', 'g')")} as flat from chunks) using (client_id, path, chunk_no) where rank <= 3 and query_id % 5 <> 0 group by 1, 2)
  select client_id, query_id, {" || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in R.PROMPT_RULES)} || chr(10) || case when max_lines = 1 then '{R.ONE_LINE}' else '{R.FEW_LINES}' end || chr(10) ||
  case when allowed is not null then 'Choisis uniquement parmi : ' || allowed || '.' || chr(10) else '' end || chr(10) || 'Champ : F' || query_id || chr(10) || 'Consigne : ' || instruction || chr(10) ||
  coalesce('{R.SOURCES}' || chr(10) || passages, '{R.NO_PASSAGE.replace("'", "''")}') || chr(10) || chr(10) || '{R.ANSWER_NOW}' as prompt from asked left join got using (client_id, query_id)""")
def prompt_texts(spark, sf):
    """Every client and field has a prompt, also the fifth of the fields that are given no passages."""
    b = table(spark, sf, "benchmark")
    fields = b.select(F.col("item_id").alias("query_id"), F.format_string("F%d", "item_id").alias("key"), F.format_string("item %d", "item_id").alias("instruction"), (1 + F.col("item_id") % 3).alias("max_lines"), F.when(F.col("item_id") % 4 == 0, F.array(F.lit("A1"), F.format_string("B%d", "item_id"))).alias("allowed"))
    c = chunked(spark, sf)
    best = R.best_passages(c, questions(spark, sf), 3).filter("query_id % 5 <> 0")
    return R.prompts(best, c, fields, table(spark, sf, "documents").select(F.col("source").alias("client_id")))


@query("F1", "select doc_id from documents where not contains(lower(source || '/' || lang), '/de') and (contains(lower(source || '/' || lang), 'src1') or contains(lower(source || '/' || lang), '/fr'))")
def path_filter(spark, sf):
    path = F.concat("source", F.lit("/"), "lang")
    return table(spark, sf, "documents").filter(R.path_allowed(path, F.array(F.lit("SRC1"), F.lit("/fr")), F.array(F.lit("/De")))).select("doc_id")


@query("F2", "select event_id, array_to_string(list_filter(list_transform(regexp_split_to_array(event_type || ', ' || user_id || chr(10) || ' ,x', '[,\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') as parts from events")
def filter_list(spark, sf):
    c = F.concat("event_type", F.lit(", "), "user_id", F.lit("\n ,x"))
    return table(spark, sf, "events").select("event_id", F.array_join(X.list_of(c), "|").alias("parts"))


NUMBERED = "text || ' ' || case doc_id % 5 when 0 then '756.1234.' || (1000 + doc_id % 9000) || '.90 x' when 1 then '756' || (1000000000 + doc_id) || ' y 756.0000.0000.00' when 2 then '756-1234-56' || (10 + doc_id % 90) || '-90' when 3 then '756 12 34 56 78 ' || (10 + doc_id % 90) || '1' else 'none 756  1234 5678' end"
DIGITS = rf"regexp_replace(regexp_extract({NUMBERED}, '756(?:[ .\-]?\d){{10}}'), '\D', '', 'g')"
DOTTED = "substr(d, 1, 3) || '.' || substr(d, 4, 4) || '.' || substr(d, 8, 4) || '.' || substr(d, 12, 2)"


@query("N12", f"select doc_id, case when d <> '' then {DOTTED} end as id_number from (select doc_id, {DIGITS} as d from documents)")
def id_numbers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.id_number(F.expr(NUMBERED)).alias("id_number"))


@query("W7", f"select client_id, arg_min({DOTTED}, doc_id) as id_number from (select doc_id, source as client_id, {DIGITS} as d from documents) where d <> '' group by 1")
def first_id_number(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("client_id"), "doc_id", X.id_number(F.expr(NUMBERED)).alias("n")).filter("n is not null")
    return d.groupBy("client_id").agg(F.min_by("n", "doc_id").alias("id_number"))


STRICT = "'756.1111.2222.' || (10 + doc_id % 89) || ' ' || text || ' 756.3333.4444.55'"


@query("A21", rf"""with r as (select *, row_number() over (partition by source order by doc_id) as k from documents), c as (select distinct source as client_id from r where k <= 5 and doc_id % 3 = 2),
  t as (select source as client_id, unnest(regexp_extract_all(substr({STRICT}, 1, 10000), '\b756\.\d{{4}}\.\d{{4}}\.\d{{2}}\b')) as n from r where k <= 5 and doc_id % 3 = 2)
  select client_id, coalesce(string_agg(distinct n, ',' order by n), '') as numbers from c left join t using (client_id) group by 1""")
def id_candidates(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("client_id"), F.col("doc_id").alias("place"), F.expr(SUFFIX).alias("suffix"), F.expr(STRICT).alias("text"))
    return R.id_candidates(d).select("client_id", F.array_join("numbers", ",").alias("numbers"))


@query("N28", "select p_partkey, upper(substr(t, 1, 1)) || lower(substr(t, 2)) as q from (select p_partkey, trim(replace(replace(upper(p_name) || '_ET_X', '_', ' '), 'ET', 'et')) as t from part)")
def sentence_queries(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.sentence_query(F.concat(F.upper("p_name"), F.lit("_ET_X"))).alias("q"))


@query("N27", "select event_id, case when event_id % 3 = 0 then 'manual ' || event_id when event_id % 3 = 1 then 'Lausanne, le ' || strftime(ts, '%d/%m/%Y') else strftime(ts, '%d/%m/%Y') end as v from events")
def place_date(spark, sf):
    e = table(spark, sf, "events")
    v = X.place_and_date(F.expr("case when event_id % 3 = 1 then 'Lausanne ' end"), F.format_string(" manual %d", "event_id"), F.expr("event_id % 3 <> 0"), F.col("ts"))
    return e.select("event_id", v.alias("v"))


@query("N8", "select doc_id, strip_accents(lower(replace(text, 'ß', 'ss'))) as t from documents")
def folded(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fold(F.col("text")).alias("t"))


@query("N7", r"select doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(replace(text, 'ß', 'ss'))), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) as t from documents")
def robust(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.robust(F.col("text")).alias("t"))


@query("N6", rf"""with {LINES_SQL}, x as (select doc_id, pos, '  ' || text || ' :: ' as t from lines) select doc_id, pos, trim(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), ':+$', '')) as t, regexp_replace(t, '\s+', ' ', 'g') as spaced, upper(replace(trim(regexp_replace(t, ':+$', '')), 'ß', 'SS')) as upper from x""")
def titles(spark, sf):
    """Titles by the usual switches and by two other sets of them."""
    t = F.concat(F.lit("  "), "text", F.lit(" :: "))
    loud = {"strip_trailing_colon": True, "uppercase": True}
    return lines(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), X.title(t).alias("t"), X.title(t, {"collapse_whitespace": True}).alias("spaced"), X.title(t, loud).alias("upper"))


@query("N9", rf"""with {LINES_SQL} select doc_id, pos, regexp_replace(regexp_replace(regexp_replace(f, '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '_', 'g'), '^_+|_+$', '', 'g') as a,
  case when regexp_replace(regexp_replace(f, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'client' else regexp_replace(regexp_replace(f, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') end as b, regexp_replace(text, '[^\p{{L}}\p{{N}}]', '_', 'g') as c
  from (select doc_id, pos, text, strip_accents(lower(replace(text, 'ß', 'ss'))) as f from lines)""")
def slugs(spark, sf):
    t = F.col("text")
    return lines(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), X.slug_words(t).alias("a"), X.slug_client(t).alias("b"), X.slug_alnum(t).alias("c"))


@query("N10", "select c_custkey, case when s = '' then 'audio' else s end as s from (select c_custkey, regexp_replace(regexp_replace(case when c_custkey % 7 = 0 then '##' else c_name || ' (1).m4a' end, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') as s from customer)")
def stems(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.safe_stem(F.expr("case when c_custkey % 7 = 0 then '##' else concat(c_name, ' (1).m4a') end")).alias("s"))


NUMBERED_LINE = "case when doc_id % 2 = 0 then (doc_id % 9) || '.' || (pos % 4) || '. ' else '' end || case when pos % 3 = 0 then upper(replace(text, 'ß', 's')) else text end"


@query("N11", rf"with {LINES_SQL} select doc_id, pos, nullif(regexp_extract(t, '^\s*(\d+(?:\.\d+)*)\.?\s+', 1), '') as num, upper(t) = t and lower(t) <> t and length(t) > 3 as caps from (select doc_id, pos, {NUMBERED_LINE} as t from lines)")
def numbering(spark, sf):
    t = F.expr(NUMBERED_LINE)
    return lines(spark, sf).select("doc_id", F.col("pos").cast("long").alias("pos"), X.numbering(t).alias("num"), X.all_caps(t).alias("caps"))


@query("N30", "select c_custkey, case when contains(n, ' ') then split_part(n, ' ', 1) end as surname, case when contains(n, ' ') then substr(n, strpos(n, ' ') + 1) end as first_name from (select c_custkey, case c_custkey % 3 when 0 then replace(c_name, '#', ' ') when 1 then replace(c_name, '#', ' ') || ' x' else c_name end as n from customer)")
def persons(spark, sf):
    p = X.person(F.expr("case c_custkey % 3 when 0 then replace(c_name, '#', ' ') when 1 then concat(' ', replace(c_name, '#', '  '), ' x ') else c_name end"))
    return table(spark, sf, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.surname", "p.first_name")


ASKING = "case c_custkey % 6 when 0 then 'Fais un bilan de @' when 1 then 'Rédige le RAPPORT de stage de @ ' when 2 then 'peux-tu préparer le rapport de stage DE @ ?' when 3 then 'le rapport de stage' when 4 then 'Le rapport de stage de  ... ' else 'le rapport de son stage, celui De \"@\".!' end"


@query("N31", "select c_custkey, case when c_custkey % 6 = 0 then null when c_custkey % 6 = 3 then 'stage' when c_custkey % 6 = 4 then 'nobody' else c_name end as who from customer")
def requested(spark, sf):
    s = F.expr(f"replace({ASKING}, '@', c_name)")
    return table(spark, sf, "customer").select("c_custkey", X.requested_name(s, "nobody").alias("who"))


@query("F3", "with " + FILES_SQL + """ select path, case when lower(s) in ('.pdf', '.docx', '.txt') then substr(lower(s), 2) else 'skipped' end as n from (select path, case when doc_id % 5 = 0 then '.JPG' when doc_id % 7 = 0 then upper(suffix) else suffix end as s from files)""")
def routing(spark, sf):
    """How each file of the inventory is read."""
    s = F.expr("case when doc_id % 5 = 0 then '.JPG' when doc_id % 7 = 0 then upper(suffix) else suffix end")
    return files(spark, sf).select("path", S.route(s).alias("n"))


PLACED = "select doc_id, source as client_id, doc_id % 4 > 0 and doc_id % 40 not in (1, 2, 3) as in_sources, case when doc_id % 6 = 0 or source like '%1' and doc_id % 2 = 0 then ' ' else text end as text from documents"


@query("F4", f"with d as ({PLACED}), ok as (select * from d where {STRIP.format('text')} <> '') select doc_id, client_id, length(text) as n_chars from ok where in_sources or client_id not in (select client_id from ok where in_sources)")
def source_fallback(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "source as client_id", "doc_id % 4 > 0 and doc_id % 40 not in (1, 2, 3) as in_sources", "case when doc_id % 6 = 0 or source like '%1' and doc_id % 2 = 0 then ' ' else text end as text")
    return S.with_text(d).select("doc_id", "client_id", F.length("text").cast("long").alias("n_chars"))


BLANKED = "case when source like '%1' or doc_id % 6 = 0 then ' ' else text end as text"


@query("F4_none", f"select source as client_id, 'no document with text' as error from (select source, {BLANKED} from documents) group by 1 having count(*) filter (where {STRIP.format('text')} <> '') = 0")
def no_text_at_all(spark, sf):
    """Clients none of whose documents has text."""
    return S.clients_without_text(table(spark, sf, "documents").selectExpr("source as client_id", BLANKED))


@query("A22", "select count(*) filter (where k = 0) as errors, count(*) filter (where k in (1, 2)) as ok, count(*) filter (where k = 3) as skipped, count(*) as total from (select case when doc_id % 17 = 0 then 0 when doc_id % 4 = 3 then 3 else 1 end as k from documents)")
def extraction_counts(spark, sf):
    state = F.expr("case when doc_id % 17 = 0 then 'error' when doc_id % 4 < 3 then 'text' end")
    return S.extraction_counts(table(spark, sf, "documents").select(state.alias("extractor")))
