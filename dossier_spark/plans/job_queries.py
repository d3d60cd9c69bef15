"""Registered queries: answers, templates, transcripts, job events, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier_spark.functions import text as X
from dossier_spark.operators import answers as A
from dossier_spark.operators import jobs as J
from dossier_spark.operators import transcripts as T
from dossier_spark.sources.files import write_json
from dossier_spark.sources.named import read_named, write_named
from dossier_spark.streaming import jobs as stream

from .base import STRIP, place, query, table

# ---------------------------------------------------------------- answers

# Replies to process: the whole texts, wrapped as models wrap them.
RAW = "case conv_id % 8 when 0 then '```json{0}' || text || '{0}```' when 1 then 'json: ' || text when 2 then 'See {{{{X}}}} (source b) a::b ' || text when 3 then text || '{0}{0}  second: a: b{0}third source 12' when 4 then '[' || text || ']' when 5 then 'jsonify ' || text || chr(8203) || ' ressource 12' when 6 then text || ' the NAME' else ' __VIDE__ ' end"
RAW_SQL = RAW.format("' || chr(10) || '")
SAN = STRIP.format(f"regexp_replace({STRIP.format('replace(replace(r, ' + repr('```') + ', ' + repr(' ') + '), chr(8203), ' + repr(' ') + ')')}, '^(?i)json[:\\s]+', '')")
ANY_LINE = r"regexp_split_to_array(r, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
REASONS = r"concat_ws(',', case when regexp_matches(r, '\{\{|\}\}') then 'PLACEHOLDER' end, case when regexp_matches(r, '(?i)\bXX\b|\bNAME\b|\bsurname\b') then 'TOKENS' end, case when regexp_matches(r, '(?i)\bsource\s*\d+\b|\(\s*source\b') then 'SOURCE_REF' end, case when contains(r, '::') or len(list_filter(" + ANY_LINE + ", lambda l: length(l) - length(replace(l, ':', '')) > 1)) > 0 then 'MULTI_COLON' end)"


def raw(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.expr(RAW.format("\\n").replace("chr(8203)", "'​'")).alias("r"))


@query("N19", f"select conv_id, turn, {SAN} as t from (select conv_id, turn, {RAW_SQL} as r from conversations)")
def sanitised(spark, sf):
    return raw(spark, sf).select("conv_id", "turn", X.sanitise(F.col("r")).alias("t"))


@query("N20", rf"select conv_id, turn, regexp_matches({STRIP.format('r')}, '^[\[{{]') or regexp_matches(r, '(?i)```|\bjson\b') as marked from (select conv_id, turn, {RAW_SQL} as r from conversations)")
def marked(spark, sf):
    return raw(spark, sf).select("conv_id", "turn", X.looks_marked_up(F.col("r")).alias("marked"))


@query("N21", f"select conv_id, turn, {REASONS} as reasons from (select conv_id, turn, {RAW_SQL} as r from conversations)")
def forbidden(spark, sf):
    return raw(spark, sf).select("conv_id", "turn", F.array_join(X.forbidden_reasons(F.col("r")), ",").alias("reasons"))


FIRST_LINES = f"array_to_string(list_filter(list_transform({ANY_LINE}, lambda l: {STRIP.format('l')}), lambda l: l <> '')[1:3], chr(10))"
FIRST_CHARS = r"case when length(l) <= 120 then l else regexp_replace(substr(l, 1, 119), '\s+$', '') || '…' end"


@query("N23", f"select conv_id, turn, {FIRST_CHARS} as t from (select conv_id, turn, {FIRST_LINES} as l from (select conv_id, turn, {RAW_SQL} as r from conversations))")
def truncated(spark, sf):
    return raw(spark, sf).select("conv_id", "turn", X.first_chars(X.first_lines(F.col("r"), 3), 120).alias("t"))


@query("N24", "select conv_id, turn, case when lower(trim(v)) in ('user', 'assistant') then upper(substr(trim(v), 1, 1)) || lower(substr(trim(v), 2)) end as value from (select conv_id, turn, case turn % 3 when 0 then upper(role) when 1 then ' ' || role || ' ' else text end as v from conversations)")
def allowed(spark, sf):
    """Roles and whole texts against the roles."""
    v = F.expr("case turn % 3 when 0 then upper(role) when 1 then concat(' ', role, ' ') else text end")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.allowed_value(v, F.array(F.lit("User"), F.lit("Assistant"))).alias("value"))


@query("N25", """select conv_id, turn, case when conv_id % 3 = 0 then 'v' || turn when conv_id % 3 = 1 then text else '{"turn":' || turn || ',"role":"' || role || '"}' end as t from conversations""")
def stringified(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", A.as_text(F.expr("case when conv_id % 3 = 0 then concat('v', turn) end"), F.expr("case when conv_id % 3 = 1 then text end"), F.struct("turn", "role")).alias("t"))


NAMED = "['NOM', 'prenom', 'LIEU_ET_DATE', 'Autre'][conv_id % 4 + 1]"
TEMPLATE = "'Dear {{{{' || {0} || '}}}} {{{{NOM}}}} {{{{nom}}}} ' || text || ' {{{{ ' || {0} || ' }}}}'"


def templates(spark, sf):
    t = F.expr(TEMPLATE.format("element_at(array('NOM', 'prenom', 'LIEU_ET_DATE', 'Autre'), cast(conv_id % 4 as int) + 1)"))
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("template_id"), F.col("turn").alias("pos"), t.alias("text"))


@query("A25", rf"with f as (select conv_id as template_id, turn as pos, regexp_extract_all({TEMPLATE.format(NAMED)}, '\{{\{{\s*([^{{}}]+?)\s*\}}\}}', 1) as ks from conversations), k as (select template_id, pos, unnest(ks) as key, generate_subscripts(ks, 1) - 1 as i from f) select template_id, key, (min((pos, i))).pos as pos, (min((pos, i))).i as i from (select template_id, key, pos, i from k) group by 1, 2".replace("(min((pos, i))).pos", "min({'pos': pos, 'i': i}).pos").replace("(min((pos, i))).i", "min({'pos': pos, 'i': i}).i"))
def placeholders(spark, sf):
    return A.template_keys(templates(spark, sf))


@query("J14", "select conv_id as template_id, turn as pos, ['the name', 'the first name', 'Lieu et date', 'special'][conv_id % 4 + 1] as query, ['short', 'short', '', 'as told'][conv_id % 4 + 1] as instructions from conversations")
def specified(spark, sf):
    keys = table(spark, sf, "conversations").select(F.col("conv_id").alias("template_id"), F.col("turn").alias("pos"), F.expr("element_at(array('NOM', 'prenom', 'LIEU_ET_DATE', 'Autre'), cast(conv_id % 4 as int) + 1)").alias("key"))
    specs = spark.createDataFrame([("NOM", "the name", "short"), ("PRENOM", "the first name", "short")], "key string, query string, instructions string")
    over = spark.createDataFrame([("Autre", "special", "as told")], "key string, query string, instructions string")
    return A.with_specs(keys, specs, over).select("template_id", "pos", "query", "instructions")


@query("J15", f"select template_id, pos, case when template_id % 2 = 0 then replace(replace(t, '{{{{NOM}}}}', 'N' || template_id), '{{{{nom}}}}', 'N' || template_id) else t end as text from (select conv_id as template_id, turn as pos, {TEMPLATE.format(NAMED)} as t from conversations)")
def filled(spark, sf):
    a = table(spark, sf, "conversations").select(F.col("conv_id").alias("template_id")).distinct().select("template_id", F.lit("nom").alias("key"), F.expr("case when template_id % 2 = 0 then concat('N', template_id) else '' end").alias("value"))
    return A.filled_templates(templates(spark, sf), a)


@query("N22", "select conv_id, turn, replace(replace(replace(text || ' {A}1 {A} {T} ' || text, '{A}1', 'b1'), '{A}', 'B'), '{T}', turn::varchar) as t from conversations")
def filling(spark, sf):
    m = F.array(F.struct(F.lit("{A}").alias("key"), F.lit("B").alias("value")), F.struct(F.lit("{A}1").alias("key"), F.lit("b1").alias("value")), F.struct(F.lit("{T}").alias("key"), F.col("turn").cast("string").alias("value")))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.fill(F.concat("text", F.lit(" {A}1 {A} {T} "), "text"), m).alias("t"))


@query("N32", r"select conv_id, turn, trim(regexp_replace(replace(lower(text), ':', ' '), '\s+', ' ', 'g')) as key, '• ' || replace(text, chr(10), chr(10) || '• ') as body from conversations")
def headings(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.heading_key(F.col("text")).alias("key"), X.bullets(F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))).alias("body"))


# How each reply came: its kind, a failed call, passages found, and the values it may have.
REPLIES = """select conv_id, turn, case when turn % 5 = 4 then 'deterministic' when turn % 5 = 3 then 'constrained' else 'short' end as kind, case when turn % 5 = 3 then case conv_id % 3 when 0 then ' oui' when 1 then text else '' end else r end as answer,
  case when conv_id % 3 = 0 then ' Lausanne ' when conv_id % 3 = 1 then text end as deterministic, conv_id % 2 as n_passages, turn % 3 = 1 as require_sources, case when conv_id % 7 = 6 then 'LLM_TIMEOUT' end as failure from raws"""
PROCESSED = rf"""with raws as (select conv_id, turn, text, {RAW_SQL} as r from conversations), replies as ({REPLIES}),
s1 as (select *, kind = 'deterministic' as det, kind <> 'deterministic' and require_sources and n_passages = 0 as no_context from replies), s2 as (select *, not det and not no_context and failure is null as live from s1),
s3 as (select conv_id, turn, kind, deterministic, det, no_context, failure, live, answer as r, {REASONS.replace('(r,', '(answer,')} as bad0 from s2), s4 as (select *, live and bad0 <> '' as bad from s3), s5 as (select * replace (case when bad then '__VIDE__' else r end as r) from s4),
s6 as (select * replace (case when {SAN} = '__VIDE__' then '' else {SAN} end as r) from s5), s7 as (select *, {FIRST_LINES.replace('[1:3]', '[1:2]')} as l0 from s6), s8 as (select *, case when length(l0) <= 400 then l0 else regexp_replace(substr(l0, 1, 399), '\s+$', '') || '…' end as clean from s7),
s9 as (select *, live and kind = 'constrained' as limited, case lower(clean) when 'oui' then 'Oui' when 'non' then 'Non' end as fine from s8),
s10 as (select *, case when det then {STRIP.format("coalesce(deterministic, '')")} when limited then coalesce(fine, '') when live then clean else '' end as value from s9),
done as (select conv_id, turn, kind, value, concat_ws(',', case when det and value = '' then 'DETERMINISTIC_EMPTY' end, case when no_context then 'NO_CONTEXT' end, case when not det and not no_context then failure end, case when bad then 'FORBIDDEN_OUTPUT' end, case when limited and fine is null then 'NON_AUTORISE' end,
  case when live and value = '' and not bad and not (limited and fine is null) then 'EMPTY' end) as codes from s10)
"""


def processed(spark, sf):
    """The replies, processed."""
    d = table(spark, sf, "conversations").withColumn("r", F.expr(RAW.format("\\n").replace("chr(8203)", "'​'")))
    d.createOrReplaceTempView("raws")
    r = spark.sql(REPLIES).withColumn("max_lines", F.lit(2)).withColumn("allowed", F.when(F.col("kind") == "constrained", F.array(F.lit("Oui"), F.lit("Non"))))
    return A.processed(r)


@query("N35", PROCESSED + "select conv_id, turn, value, codes from done")
def answer_pipeline(spark, sf):
    return processed(spark, sf).select("conv_id", "turn", "value", F.array_join("missing_info", ",").alias("codes"))


@query("J16", PROCESSED + "select conv_id, turn, value from done where kind = 'deterministic'")
def deterministic(spark, sf):
    return processed(spark, sf).filter("kind = 'deterministic'").select("conv_id", "turn", "value")


@query("S18", PROCESSED + "select conv_id, turn, codes from done where codes <> ''")
def missing_info(spark, sf):
    """Fields with missing information, written as JSON and read back."""
    path = place(spark, "missing")
    write_json(A.missing_info(processed(spark, sf)).select("conv_id", "turn", "missing_info"), path)
    return spark.read.schema("conv_id long, turn long, missing_info array<string>").json(path).select("conv_id", "turn", F.array_join("missing_info", ",").alias("codes"))


def _stub(prompt: str) -> str:
    """A model that is late for long prompts, and answers others by their first word and length."""
    kind, _, rest = prompt.partition(" ")
    if kind == "long":
        raise TimeoutError
    if kind == "broken":
        raise OSError("no connection")
    if kind == "marker" and "Check before you answer" not in prompt:
        return "so {{bad}}"
    if kind == "list" and "plain text" not in prompt:
        return "[1, 2]"
    return f"{kind} {len(rest)}"


KINDS = "['long', 'marker', 'prompt', 'broken', 'list', 'late'][conv_id % 6 + 1]"
ASKED = len(A.CORRECTED), len(A.PLAIN)


@query("H1", f"""select conv_id, turn, case k when 'long' then 'short ' || (n + 1) when 'marker' then 'marker ' || (n + {ASKED[0]}) when 'prompt' then 'prompt ' || n when 'broken' then '' when 'list' then 'list ' || (n + {ASKED[1]}) else '' end as answer, case k when 'prompt' then 1 when 'broken' then 1 when 'late' then 1 else 2 end as attempts,
  case k when 'broken' then 'LLM_ERROR' when 'late' then 'LLM_TIMEOUT' end as failure from (select conv_id, turn, length(text) as n, {KINDS} as k from conversations)""")
def generated(spark, sf):
    """Prompts of whole texts through the retry ladder: timeout with and without a shorter prompt, error, wrong format, forbidden content."""
    kind = F.expr("element_at(array('long', 'marker', 'prompt', 'broken', 'list', 'late'), cast(conv_id % 6 as int) + 1)")
    p = table(spark, sf, "conversations").withColumn("k", kind)
    p = p.select("conv_id", "turn", F.concat(F.when(F.col("k") == "late", F.lit("long")).otherwise(F.col("k")), F.lit(" "), "text").alias("prompt"), F.when(F.col("k") == "long", F.concat(F.lit("short x"), "text")).alias("retry_prompt"))
    return A.generate(p, _stub).select("conv_id", "turn", "answer", "attempts", "failure")


BUDGET, REPLY = 3000, 150


def _summary_stub(prompt: str) -> str:
    return f"{len(prompt)} " + prompt[-100:].strip("\n").replace("\n", " ")


def tree_sql(levels: int = 6) -> str:
    """The levels of summaries, one after the other; a level beyond a client's last has no rows of it."""
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    step = BUDGET - len("".join(A.OF_DOCUMENT)) - A.LONGEST_NAME
    widest = REPLY + A.LONGEST_NAME + len("".join(A.ENTRY))
    room = BUDGET - max(len(A.OF_PART), len("".join(A.OF_REPORT)) + A.LONGEST_NAME) - widest
    reply = f"substr(length(prompt) || ' ' || replace(trim(right(prompt, 100), chr(10)), chr(10), ' '), 1, {REPLY})"
    out = [f"""p1 as (select source as client_id, doc_id::varchar as path, i as piece, {quote(A.OF_DOCUMENT[0])} || doc_id || {quote(A.OF_DOCUMENT[1])} || substr(coalesce(text, ''), i * {step} + 1, {step}) as prompt, doc_id::varchar as name, false as final
      from (select *, unnest(range(0, greatest(1, cast(ceil(length(coalesce(text, '')) / {step}.0) as bigint)))) as i from documents))"""]
    for k in range(2, levels + 1):
        out.append(f"""e{k} as (select *, sum(length(entry)) over (partition by client_id order by path, piece) - length(entry) as before from (
          select client_id, path, piece, {quote(A.ENTRY[0])} || name || {quote(A.ENTRY[1])} || {reply} || {quote(A.ENTRY[2])} as entry from p{k - 1} where not final)),
        g{k} as (select client_id, before // {room} as part, string_agg(entry, '' order by path, piece) as packed from e{k} group by 1, 2),
        p{k} as (select client_id, '' as path, part as piece, case when final then {quote(A.OF_REPORT[0])} || 'client ' || client_id || {quote(A.OF_REPORT[1])} else {quote(A.OF_PART)} end || packed as prompt, 'partie ' || (part + 1)::bigint as name, final
          from (select *, max(part) over (partition by client_id) = 0 as final from g{k}))""")
    ends = " union all ".join(f"select client_id, {k} as levels, length(prompt) as longest_prompt, {reply} as report from p{k} where final" for k in range(2, levels + 1))
    return "with " + ",\n".join(out) + ends


@query("A28", tree_sql())
def map_reduce(spark, sf):
    """Reports from summaries of summaries, by a stub model: the prompts are so short that it takes several levels."""
    d = table(spark, sf, "documents").select(F.col("source").alias("client_id"), F.col("doc_id").cast("string").alias("path"), "text")
    return A.reports(d, _summary_stub, F.concat(F.lit("client "), "client_id"), BUDGET, REPLY)


# ---------------------------------------------------------------- transcripts

SEG = "seg as (select user_id::varchar as source_id, event_id as seq, epoch_ms(ts) // 60000 * 1.0::double as start, epoch_ms(ts) // 60000 * 1.0::double + value / 4.0 as \"end\", case when event_id % 11 = 0 then ' ' else event_type || event_id end as text from events)"


def timed(spark, sf):
    return timed_of(table(spark, sf, "events"))


def timed_of(e):
    start = F.expr("cast(unix_millis(cast(ts as timestamp)) div 60000 as double)")  # towards 0, as in SQL
    return e.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("seq"), start.alias("start"), (start + F.col("value") / 4.0).alias("end"), F.expr("case when event_id % 11 = 0 then ' ' else concat(event_type, event_id) end").alias("text"), "ts")


@query("W8", f"with {SEG} select source_id, seq, round(start - lag(\"end\") over (partition by source_id order by start, seq), 6) as gap from seg")
def pauses(spark, sf):
    return T.gaps(timed(spark, sf)).select("source_id", "seq", F.round("gap", 6).alias("gap"))


@query("A27", f"with {SEG} select source_id, part, string_agg(t, ' ' order by start, seq) as text from (select source_id, start, seq, trim(text) as t, ((row_number() over (partition by source_id order by start, seq) - 1) // 40)::int as part from seg where trim(text) <> '') group by 1, 2")
def transcripts(spark, sf):
    return T.transcript(timed(spark, sf), 40)


FOLD = f"""with recursive {SEG}, s as (select source_id, row_number() over (partition by source_id order by start, seq) as i, start, "end" as e, trim(text) as t from seg where trim(text) <> ''),
w as (select source_id, i, start as ws, e as we, e as last_end, t as txt, 0 as no, false as closed from s where i = 1
  union all select s.source_id, s.i, case when fresh then s.start else w.ws end, case when fresh then s.e else greatest(w.we, s.e) end, s.e, case when fresh then s.t else w.txt || ' ' || s.t end,
   case when fresh then w.no + 1 else w.no end, not fresh and greatest(w.we, s.e) - w.ws >= 40 from (select w.*, s2.start - w.last_end >= 2 or w.closed as fresh from w join s s2 on s2.source_id = w.source_id and s2.i = w.i + 1) w join s on s.source_id = w.source_id and s.i = w.i + 1)
select source_id, no as window_no, round(arg_max(ws, i), 6) as start, round(arg_max(we, i), 6) as "end", arg_max(txt, i) as text from w group by 1, 2"""


@query("ST3", FOLD)
def windows(spark, sf):
    return T.windows(timed(spark, sf)).select("source_id", "window_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


@query("S16", rf"""with f as ({FOLD.replace("round(arg_max(ws, i), 6)", "arg_max(ws, i)").replace("round(arg_max(we, i), 6)", "arg_max(we, i)")}), {SEG},
  s as (select *, ((row_number() over (partition by source_id order by start, seq) - 1) // 60)::int as part from seg),
  spoken as (select source_id, part, count(*) as n_segments, coalesce(string_agg(trim(text), ' ' order by start, seq) filter (where trim(text) <> ''), '') as transcript_text from s group by 1, 2),
  c as (select source_id, window_no // 60 as part, count(*) as n_chunks, string_agg('[t=' || round_even(start, 0)::bigint || 's-' || round_even("end", 0)::bigint || 's] ' || text, chr(10) order by window_no) as lines from f group by 1, 2)
  select source_id, part, 'talk ' || source_id || '.m4a' as original_filename, n_segments, transcript_text, coalesce(n_chunks, 0) as n_chunks,
    regexp_replace('Transcription audio (local) — talk ' || source_id || '.m4a' || chr(10) || 'Date: 2024-01-01' || chr(10) || 'SourceId: ' || source_id || chr(10) || chr(10) || coalesce(lines, transcript_text), '\s+$', '') || chr(10) as text
  from spoken left join c using (source_id, part)""")
def manifests(spark, sf):
    """Transcripts and manifests written with one commit, in parts of 60 segments, and read back. Segments without a source
    have no files; their parts come from the table."""
    path, segs = place(spark, "audio"), timed(spark, sf)
    audio = segs.select("source_id").distinct().withColumn("audio_path", F.format_string("/in/talk %s.m4a", "source_id"))
    there = write_named(T.audio_files(segs, audio, "2024-01-01", 60), path)
    read = lambda suffix: read_named(there.filter(F.col("name").endswith(suffix)), path).select(F.regexp_replace("name", r"\.[a-z]+$", "").alias("stem"), F.col("content").cast("string").alias("c"))
    kind = "source_id string, part int, original_filename string, audio_path string, transcript_text string, segments array<struct<start:double,end:double,text:string>>, chunks array<struct<start:double,end:double,text:string>>"
    m = read(".json").select("stem", F.from_json("c", kind).alias("m")).select("stem", "m.*")
    size = lambda c: F.size(c).cast("long")
    texts = read(".txt").select("stem", F.col("c").alias("text"))
    none = F.lit(None).cast("string")
    unnamed = T.spoken(segs.filter("source_id is null"), 60).select("source_id", "part", none.alias("original_filename"), size("segments").alias("n_segments"), "transcript_text", F.lit(0).cast("long").alias("n_chunks"), none.alias("text"))
    return m.join(texts, "stem").select("source_id", "part", "original_filename", size("segments").alias("n_segments"), "transcript_text", size("chunks").alias("n_chunks"), "text").unionByName(unnamed)


@query("N29", f"with {SEG} select source_id, seq, '[t=' || round_even(start % 1000, 0)::bigint || 's-' || round_even(start % 1000 + 7.3, 0)::bigint || 's] ' || text as line from seg")
def window_lines(spark, sf):
    t = timed(spark, sf)
    return t.select("source_id", "seq", T.window_line(F.col("start") % 1000, F.col("start") % 1000 + 7.3, F.col("text")).alias("line"))


def _speech(path: str) -> list[tuple[float, float, str]]:
    return [(0.0, float(len(path)), "from " + path), (float(len(path)), 99.0, "end")]


@query("H2", "select c_custkey::varchar as source_id, unnest([0, 1]) as seq, unnest([0.0, length(c_name) * 1.0]) as start, unnest(['from ' || c_name, 'end']) as text from customer")
def transcribed(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.col("c_name").alias("path"))
    return A.transcribe(a, _speech).select("source_id", "seq", "start", "text")


@query("H3", "select p_partkey, case when p_partkey % 2 = 0 then 'mine ' || (p_partkey % 4) else 'Cle ' || (p_partkey % 4) end as query from part")
def overridden(spark, sf):
    keys = table(spark, sf, "part").select("p_partkey", F.expr("concat('CLE_', p_partkey % 4)").alias("key"))
    over = table(spark, sf, "part").selectExpr("concat('CLE_', p_partkey % 4) as key", "concat('mine ', p_partkey % 4) as query", "'' as instructions", "p_partkey").filter("p_partkey % 2 = 0").drop("p_partkey").distinct()
    return A.with_specs(keys, over.filter("false"), over).select("p_partkey", "query")


# ---------------------------------------------------------------- job events

EV = "ev as (select user_id::varchar as job_id, ts, event_id as seq, event_type as status, case when event_id % 3 = 0 then 'm' || event_id % 7 end as message, case when event_id % 2 = 0 then event_id % 100 end as progress, case when event_id % 4 = 0 then event_id // 50 end as version from events)"


def events(df: DataFrame) -> DataFrame:
    return df.selectExpr("cast(user_id as string) as job_id", "cast(ts as timestamp) as ts", "event_id as seq", "event_type as status", "case when event_id % 3 = 0 then concat('m', event_id % 7) end as message", "case when event_id % 2 = 0 then event_id % 100 end as progress", "case when event_id % 4 = 0 then event_id div 50 end as version")


LATEST = f"with {EV} select job_id, arg_max(status, (ts, seq)) as status, arg_max(message, (ts, seq)) filter (where message is not null) as message, arg_max(progress, (ts, seq)) filter (where progress is not null) as progress from ev group by 1"
PRIOR = ", ".join(f"last_value({c} ignore nulls) over (partition by job_id order by ts, seq rows between unbounded preceding and 1 preceding) as last_{c}" for c in J.SEEN)
CHANGED = f"""with {EV} select job_id, seq, coalesce(status, last_status) as status, coalesce(message, last_message) as message, coalesce(version, last_version) as version from (select *, {PRIOR} from ev)
  where (status is not null and status is distinct from last_status) or (message <> '' and message is distinct from last_message) or (version is not null and version is distinct from last_version)"""


@query("W9", LATEST)
def latest(spark, sf):
    return J.current(events(table(spark, sf, "events"))).select("job_id", "status", "message", "progress")


@query("W10", CHANGED)
def changed(spark, sf):
    return J.changes(events(table(spark, sf, "events"))).select("job_id", "seq", "status", "message", "version")


STG = "st as (select user_id::varchar as job_id, 'f' || event_id % 5 as field_key, event_id as seq, 'label ' || event_id % 3 as label, case event_id % 4 when 0 then 'done' when 1 then 'error' when 2 then 'warning' else 'running' end as stage from events), g as (select job_id, field_key, min(seq) as first_seq, arg_min(label, seq) as label, arg_max(stage, seq) as stage from st group by 1, 2)"


def stages(spark, sf):
    e = table(spark, sf, "events").selectExpr("cast(user_id as string) as job_id", "concat('f', event_id % 5) as field_key", "event_id as seq", "concat('label ', event_id % 3) as label", "case event_id % 4 when 0 then 'done' when 1 then 'error' when 2 then 'warning' else 'running' end as stage")
    return J.field_stages(e)


@query("W11", f"with {STG} select job_id, field_key, label, stage, row_number() over (partition by job_id order by first_seq) as place from g")
def field_stages(spark, sf):
    return stages(spark, sf).select("job_id", "field_key", "label", "stage", F.col("place").cast("long").alias("place"))


@query("A24", f"with {STG} select job_id, round(greatest(0.4, least(0.7, 0.4 + 0.3 * count(*) filter (where stage in ('done', 'warning', 'error')) / count(*))), 6) as progress from g group by 1")
def progress(spark, sf):
    return J.progress(stages(spark, sf)).withColumn("progress", F.round("progress", 6))


@query("N33", "select event_id, coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in J.STATUS.items()) + "}[lower(s)], 'pending') as shown from (select event_id, coalesce(['Queued', 'deferred', 'SCHEDULED', 'started', 'finished', 'Failed', 'stopped', 'canceled'][event_id % 10 + 1], event_type) as s from events)")
def shown(spark, sf):
    """Every state of a queue, and words that are none."""
    s = F.expr("coalesce(try_element_at(array('Queued', 'deferred', 'SCHEDULED', 'started', 'finished', 'Failed', 'stopped', 'canceled'), cast(event_id % 10 as int) + 1), event_type)")
    return table(spark, sf, "events").select("event_id", J.shown_status(s).alias("shown"))


@query("N34", "select event_id, case when event_id % 4 > 0 then json_extract_string(props, '$.k') end as k from events")
def metadata(spark, sf):
    p = F.expr("case event_id % 4 when 0 then '[1, oops' else props end")
    return table(spark, sf, "events").select("event_id", F.try_element_at(J.metadata(p), F.lit("k")).alias("k"))


@query("A23", "select user_id as source, count(*) filter (where event_type = 'view') as txt, count(*) filter (where event_type = 'click') as json from events group by 1")
def ingestion_counts(spark, sf):
    kind = F.expr("case event_type when 'view' then '.txt' when 'click' then '.json' else '.pdf' end")
    return J.ingestion_counts(table(spark, sf, "events").select(F.col("user_id").alias("source"), kind.alias("suffix")))


# ---------------------------------------------------------------- streams


def drained(spark: SparkSession, streamed: DataFrame, mode: str, schema: str) -> DataFrame:
    """Run a stream over what is there and return what it wrote, from the shared folder."""
    base = place(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/n={n}")

    q = streamed.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema + ", batch long").parquet(f"{base}/out/n=*")


def event_stream(spark, sf):
    t = table(spark, sf, "events")
    return spark.readStream.schema(t.schema).parquet(f"{sf}/events.parquet*")


@query("ST1", LATEST)
def live_state(spark, sf):
    out = drained(spark, stream.current_state(events(event_stream(spark, sf))), "update", stream.STATE)
    last = out.groupBy("job_id").agg(F.max_by(F.struct("status", "message", "progress"), F.struct("updated_at", "batch")).alias("s"))
    return last.select("job_id", "s.status", "s.message", "s.progress")


@query("ST4", CHANGED)
def live_changes(spark, sf):
    return drained(spark, stream.change_feed(events(event_stream(spark, sf))), "append", stream.FEED).select("job_id", "seq", "status", "message", "version")


@query("ST2", "select user_id || '/' || event_type as path, 1::bigint as n from events group by 1")
def ingest_once(spark, sf):
    """Listings that arrive as JSON files, read two files at a time; each path counts once."""
    folder = place(spark, "listing")
    table(spark, sf, "events").selectExpr("concat(user_id, '/', event_type) as path", "cast(ts as timestamp) as mtime").repartition(6).write.json(folder)
    s = stream.new_files(spark, folder, "path string, mtime timestamp", per_trigger=2, late="3650 days")
    return drained(spark, s, "append", "path string, mtime timestamp").groupBy("path").agg(F.count("*").alias("n"))


@query("ST3_stream", FOLD)
def live_windows(spark, sf):
    """The windows of ST3 from a stream of segments. A segment of a source of its own, a day later, lets the watermark pass
    the others, so that their last windows close."""
    folder = place(spark, "segments")
    segs = timed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    last = segs.agg(F.lit("~").alias("source_id"), F.lit(0).cast("long").alias("seq"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit("~").alias("text"), (F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    segs.unionByName(last).write.parquet(folder)
    out = drained(spark, stream.transcript_windows(spark.readStream.schema(segs.schema).parquet(folder)), "append", "source_id string, window_no int, start double, end double, text string")
    return out.filter("source_id <> '~'").select("source_id", "window_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")
