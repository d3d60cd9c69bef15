"""Registered queries: folder scan, over a file inventory derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier_spark.operators import scan as S
from dossier_spark.sources.files import write_json

from .base import ALIKE_SQL, FILES_SQL, files, place, query, table

SCAN = f"""with {FILES_SQL},
roled as (select *, case when folder = '' then null else ['01_personnel', '02_cv', '03_tests', '04_stages', '05_mesures', '06_rapport', '07_suivi'][doc_id % 8 + 1] end as role,
  greatest(0.0, least(1.0, (folder = '06 Rapport final')::int * 0.3::double + least(0.15::double * (contains(name, 'rapport')::int + contains(name, 'bilan')::int + contains(name, 'orientation')::int + contains(name, 'synthese')::int + contains(name, 'final')::int + contains(name, 'conclusion')::int + contains(name, 'evaluation')::int), 0.45::double)
   + (suffix = '.docx')::int * 0.15::double - (contains(name, 'template') or contains(name, 'copie'))::int * 0.5::double)) as score from files),
tiered as (select *, case when role = '06_rapport' then 1 when score > 0.1 then 2 else 3 end as tier from roled where suffix in ('.docx', '.doc')),
cand as (select * replace (case when tier = 3 then 0.5 else score end as score), row_number() over (partition by client_id order by tier, case when tier = 3 then 0 else -score end, case when tier = 3 then -mtime else 0 end, path) = 1 as selected from tiered),
gold as (select client_id, path, score, ['06_rapport_final', 'recursive_scan', 'most_recent_fallback'][tier] as strategy, size_bytes from cand where selected),
src as (select client_id, path, name, suffix, size_bytes, case when folder = '' then 'root' else role end as category from roled where (role in ('01_personnel', '03_tests', '04_stages', '05_mesures') or folder = '') and path not in (select path from gold)),
sc as (select client_id, count(*) as n_sources, sum(size_bytes) as bytes from src group by 1),
rl as (select client_id, count(distinct role) as roles_found, bool_or(role = '01_personnel') as r1, bool_or(role = '06_rapport') as r6 from roled group by 1),
scan as (select rl.client_id, gold.path as gold, coalesce(score, 0.0) as gold_score, strategy, coalesce(n_sources, 0) as n_sources, round_even((coalesce(bytes, 0) + coalesce(gold.size_bytes, 0)) / 1048576.0, 2) as total_mb, roles_found, 7 - roles_found as roles_missing, r1, r6,
  coalesce(score >= 0.3 and coalesce(n_sources, 0) > 0, false) as ready, case when coalesce(n_sources, 0) >= 5 and score >= 0.6 then 'high' when coalesce(n_sources, 0) >= 2 and score >= 0.4 then 'medium' else 'low' end as quality
  from rl left join sc using (client_id) left join gold using (client_id))
"""


def scanned(spark, sf):
    return S.scan(files(spark, sf), spark)


@query("N15", SCAN + "select doc_id, round(score, 6) as score from roled")
def gold_scores(spark, sf):
    return files(spark, sf).select("doc_id", F.round(S.gold_score(F.col("name"), F.col("folder"), F.col("suffix")), 6).alias("score"))


@query("J10", SCAN + "select client_id, role, f.folder from (select distinct client_id, unnest(['01_personnel', '02_cv', '03_tests', '04_stages', '05_mesures', '06_rapport', '07_suivi']) as role from files) left join (select distinct client_id, role, folder from roled where role is not null) f using (client_id, role)")
def role_lookup(spark, sf):
    return S.roles(files(spark, sf), spark)


@query("W4", SCAN + "select client_id, path, round(score, 6) as score, tier, selected from cand")
def gold_tiers(spark, sf):
    return S.gold_candidates(files(spark, sf)).select("client_id", "path", F.round("score", 6).alias("score"), "tier", "selected")


@query("U1", SCAN + "select client_id, path, case when folder = '' then 'root' else role end as category from roled where role in ('01_personnel', '03_tests', '04_stages', '05_mesures') or folder = ''")
def listed_sources(spark, sf):
    f = files(spark, sf)
    return S.sources(f, S.gold(f).filter("false")).select("client_id", "path", "category")


@query("J11", SCAN + "select client_id, path from src")
def sources_without_gold(spark, sf):
    f = files(spark, sf)
    return S.sources(f, S.gold(f)).select("client_id", "path")


@query("U5", SCAN + "select client_id, count(*) as n from src group by 1")
def source_difference(spark, sf):
    f = files(spark, sf)
    return S.sources(f, S.gold(f)).groupBy("client_id").agg(F.count("*").alias("n"))


@query("A15", SCAN + "select client_id, suffix, n, row_number() over (partition by client_id order by n desc, suffix) as place from (select client_id, suffix, count(*) as n from files group by 1, 2)")
def extensions(spark, sf):
    return S.extension_counts(files(spark, sf)).withColumn("place", F.col("place").cast("long"))


@query("A16", SCAN + "select client_id, round(gold_score, 6) as gold_score, n_sources, total_mb, roles_found, roles_missing from scan")
def scan_stats(spark, sf):
    return scanned(spark, sf).select("client_id", F.round("gold_score", 6).alias("gold_score"), "n_sources", "total_mb", "roles_found", "roles_missing")


@query("A17", SCAN + """select client_id, ready, concat_ws('|', case when gold is null then 'no reference document' when gold_score < 0.5 then 'weak reference document (' || printf('%.2f', round_even(gold_score, 2)) || ')' end, case when n_sources = 0 then 'no sources' when n_sources < 3 then 'few sources (' || n_sources || ')' end,
  case when not r1 or not r6 then 'missing folders: ' || concat_ws(', ', case when not r1 then '01_personnel' end, case when not r6 then '06_rapport' end) end) as warnings from (select * replace (coalesce(r1, false) as r1, coalesce(r6, false) as r6) from scan)""")
def readiness(spark, sf):
    return scanned(spark, sf).select("client_id", "ready", F.array_join("warnings", "|").alias("warnings"))


@query("A20", SCAN + "select client_id, quality from scan")
def quality(spark, sf):
    return scanned(spark, sf).select("client_id", "quality")


@query("F8", SCAN + "select client_id from scan where ready")
def ready_clients(spark, sf):
    return scanned(spark, sf).filter("ready").select("client_id")


@query("A18", SCAN + "select count(*) as total, count(*) filter (where ready) as ready, count(*) filter (where not ready) as not_ready, round_even(100.0 * count(*) filter (where ready) / count(*), 1) as rate from scan")
def scan_summary(spark, sf):
    return S.readiness_summary(scanned(spark, sf))


NAMES = "asked as (select distinct case when doc_id % 7 = 0 then 'nobody' || doc_id else source end as client_id from documents), outcomes as (select client_id, case when ready is null then 'error' when ready then 'success' else 'not_ready' end as outcome from asked left join scan using (client_id))"


def asked(spark, sf):
    return table(spark, sf, "documents").select(F.expr("case when doc_id % 7 = 0 then concat('nobody', doc_id) else source end").alias("client_id")).distinct()


@query("J19", SCAN + f", {NAMES} select client_id, outcome from outcomes")
def requested(spark, sf):
    return S.requested(asked(spark, sf), scanned(spark, sf)).select("client_id", "outcome")


@query("A19", SCAN + f", {NAMES} select count(*) as total, count(*) filter (where outcome = 'success') as success, count(*) filter (where outcome = 'not_ready') as not_ready, count(*) filter (where outcome = 'error') as errors, round_even(100.0 * count(*) filter (where outcome = 'success') / count(*), 1) as rate from outcomes")
def outcomes(spark, sf):
    return S.outcome_summary(S.requested(asked(spark, sf), scanned(spark, sf)))


@query("U2", SCAN + f", {NAMES} select client_id, outcome, case when outcome = 'error' then 'not found' end as message from outcomes where outcome <> 'not_ready'")
def success_and_errors(spark, sf):
    return S.success_and_errors(S.requested(asked(spark, sf), scanned(spark, sf)))


NUMBERED = "(select *, row_number() over (partition by client_id order by category, path) as n from src)"
TARGET = r"category || '_' || printf('%03d', n) || '_' || regexp_replace(name, '\.[^.]*$', '') || suffix"


@query("W6", SCAN + f"select client_id, path, {TARGET} as target from {NUMBERED}")
def sandbox_names(spark, sf):
    f = files(spark, sf)
    return S.sandbox_names(S.sources(f, S.gold(f))).select("client_id", "path", "target")


@query("S17", SCAN + f"""select client_id, part, {{'batch': 'b1', 'slug': client_id, 'gold': any_value(g), 'file_counts': {{'gold': 1, 'sources': any_value(total), 'total': any_value(total) + 1}}}}::json::varchar as meta, string_agg(target, ',' order by target) as sources
  from (select client_id, gold.path as g, ((n - 1) // 20)::int as part, {TARGET} as target, count(*) over (partition by client_id) as total from {NUMBERED} join gold using (client_id)) group by 1, 2""")
def manifests(spark, sf):
    """Manifests written as JSON in a folder for each client and read back; 20 sources a part."""
    path = place(spark, "meta")
    write_json(S.manifest(files(spark, sf), "b1", 20), path, "client_id")
    m = spark.read.schema("part int, n_sources long, meta string, client_id string").json(path)
    meta = F.from_json("meta", "batch string, slug string, gold string, sources array<string>, file_counts struct<gold:int,sources:long,total:long>")
    m = m.select("client_id", "part", meta.alias("m"))
    return m.select("client_id", "part", F.to_json(F.struct("m.batch", "m.slug", "m.gold", "m.file_counts")).alias("meta"), F.array_join("m.sources", ",").alias("sources"))


@query("A26", SCAN + "select client_id, 1 as gold, count(*) as sources, count(*) + 1 as total from src where client_id in (select client_id from gold) group by 1")
def file_counts(spark, sf):
    return S.file_counts(files(spark, sf))


@query("F10", SCAN + "select client_id from files group by 1 having max(mtime) > 900 or substr(client_id, 4)::int % 3 = 0")
def stale(spark, sf):
    f = files(spark, sf)
    runs = f.select("client_id").distinct().filter("int(substr(client_id, 4)) % 3 <> 0").withColumn("extracted_at", F.lit(900))
    return S.stale(f, runs)


@query("F11", SCAN + "select client_id, bool_or(folder = '' and suffix = '.docx') as has_docx, bool_or(folder = '' and suffix = '.pdf') as has_pdf, bool_or(folder = '' and suffix = '.txt') as has_txt, false as has_audio, bool_or(folder = '') as has_files from files group by 1")
def kinds(spark, sf):
    return S.by_type(files(spark, sf))


@query("F12", SCAN + "select distinct client_id, folder from files where folder <> '' and folder not in ('02 CV')")
def visible(spark, sf):
    return S.visible_folders(files(spark, sf), ("02 CV",))


@query("T3", SCAN + "select client_id, name, is_dir, row_number() over (partition by client_id order by is_dir desc, lower(name), name) as place from (select distinct client_id, folder as name, true as is_dir from files where folder <> '' union all select client_id, name, false from files where folder = '')")
def directory_order(spark, sf):
    return S.directory_order(files(spark, sf))


AUDIO_SQL = "select source as client_id, source || case when doc_id % 5 = 0 then '/ingested_audio/' else '/' end || 'a' || doc_id || ['.m4a', '.MP3', '.txt'][doc_id % 3 + 1] as path from documents"


def audio(spark, sf):
    return table(spark, sf, "documents").selectExpr("source as client_id", "concat(source, if(doc_id % 5 = 0, '/ingested_audio/', '/'), 'a', doc_id, element_at(array('.m4a', '.MP3', '.txt'), cast(doc_id % 3 as int) + 1)) as path", "doc_id")


@query("F9", f"select client_id, path from ({AUDIO_SQL}) where regexp_matches(lower(path), '\\.(m4a|mp3|wav)$') and not contains(path, 'ingested_audio/')")
def candidates(spark, sf):
    a = audio(spark, sf)
    return S.new_audio(a, a.filter("false")).select("client_id", "path")


@query("J12", f"select client_id, path from ({AUDIO_SQL}) where regexp_matches(lower(path), '\\.(m4a|mp3|wav)$') and not contains(path, 'ingested_audio/') and path not in (select path from ({AUDIO_SQL} where doc_id % 4 = 0))")
def not_ingested(spark, sf):
    a = audio(spark, sf)
    return S.new_audio(a, a.filter("doc_id % 4 = 0")).select("client_id", "path")


@query("T2", f"select client_id, path from (select *, row_number() over (partition by client_id order by path) as r from ({AUDIO_SQL}) where regexp_matches(lower(path), '\\.(m4a|mp3|wav)$') and not contains(path, 'ingested_audio/')) where r <= 3")
def capped(spark, sf):
    a = audio(spark, sf)
    return S.new_audio(a, a.filter("false"), 3).select("client_id", "path")


@query("J18", """with c as (select distinct c_name as folder, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') as b from customer), q as (select unnest(['Customer#000000007', '000000012', 'customer 9', 'zz']) as asked), s as (select asked, folder, regexp_replace(lower(asked), '[^a-z0-9]+', '_', 'g') as a, b from q, c),
  t as (select asked, folder, case when a = b then 3 when contains(a, b) or contains(b, a) then 2 when len(list_filter(string_split(a, '_'), lambda p: not contains(b, p))) = 0 then 1 else 0 end as score from s) select asked, arg_min(folder, (-score, folder)) as folder, max(score) as score from t where score > 0 group by 1""")
def slugs(spark, sf):
    return S.best_slug(["Customer#000000007", "000000012", "customer 9", "zz"], table(spark, sf, "customer"), "c_name")


def alike(asked: list[str], table_name: str, col: str) -> str:
    """SQL up to `scored`: (asked, folder, score) of every asked name and folder."""
    bonus = "case when contains(b, a) then 0.3::double else 0.0::double end + case when starts_with(b, a) then 0.2::double else 0.0::double end + case when len(string_split(trim(a), ' ')) > 0 and trim(a) <> '' and list_has_all(regexp_split_to_array(trim(b), '\\s+'), regexp_split_to_array(trim(a), '\\s+')) then 0.3::double else 0.0::double end"
    return f"""with recursive pairs as (select asked, folder, strip_accents(lower(asked)) as a, strip_accents(lower(folder)) as b from (select distinct {col} as folder from {table_name}), (select unnest({asked!r}) as asked)),
  {ALIKE_SQL}, scored as (select asked, folder, least(1.0::double, ratio + ({bonus})) as score from pairs join alike using (a, b))"""


CLIENTS, EXACTLY, FEW, GOODS = ["customer 12", "Customer#000000100", "suplier"], ["Customer#000000010", "costumer 44", "CUSTOMER#00000010"], ["supplier 1", "Supplier#000000003"], ["antique puff", "steel", "Lime"]
BEST = "select *, row_number() over (partition by asked order by score desc, folder) as rank from scored where score >= 0.3"


@query("J17", alike(CLIENTS, "customer", "c_name") + f"select asked, folder, rank, round(score, 6) as score from ({BEST}) where rank <= 10")
def names(spark, sf):
    return S.find_clients(CLIENTS, table(spark, sf, "customer"), "c_name").select("asked", "folder", "rank", F.round("score", 6).alias("score"))


@query("F7", alike(EXACTLY, "customer", "c_name") + "select asked, case when max(score) >= 0.95 then arg_min(folder, (-score, folder)) end as folder, round(max(score), 6) as score, count(*) as matches from scored where score >= 0.9 group by 1")
def exact_match(spark, sf):
    """The exact search: 0.9 or more counts, 0.95 or more is accepted."""
    return S.find_client(EXACTLY, table(spark, sf, "customer"), "c_name", exact=True).select("asked", "folder", F.round("score", 6).alias("score"), "matches")


@query("T1", alike(FEW, "supplier", "s_name") + f"select asked, folder, rank from ({BEST}) where rank <= 3")
def first_few(spark, sf):
    return S.find_clients(FEW, table(spark, sf, "supplier"), "s_name", n=3).select("asked", "folder", "rank")


@query("N14", alike(GOODS, "part", "p_name") + "select asked, folder, round(score, 6) as score from scored")
def fuzzy_scores(spark, sf):
    return S.find_clients(GOODS, table(spark, sf, "part"), "p_name", least=0.0, n=None).select("asked", "folder", F.round("score", 6).alias("score"))
