"""Generated answers: field specifications, prompts' responses, cleaning, validation, template fill."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier_spark.functions import text as X
from dossier_spark.sources.files import written

from .ordering import counted, spread_by_order

EMPTY, NOT_ALLOWED = "__VIDE__", "NON_AUTORISE"


def template_keys(templates: DataFrame) -> DataFrame:
    """Distinct {{KEY}} markers of each template in first-seen order: templates (template_id, pos, text)."""
    found = templates.select("template_id", "pos", F.posexplode(F.regexp_extract_all("text", F.lit(r"\{\{\s*([^{}]+?)\s*\}\}"), F.lit(1))).alias("i", "key"))
    first = found.groupBy("template_id", "key").agg(F.min(F.struct("pos", "i")).alias("at"))
    return first.select("template_id", "key", F.col("at.pos").alias("pos"), F.col("at.i").alias("i"))


def with_specs(keys: DataFrame, specs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """keys (key) with their specification: exact key, then upper-cased key, else a default whose query is the key as a
    sentence; an override's query and instructions win (J14, H3). specs: key, query, instructions."""
    s = specs.select(F.col("key").alias("k"), F.col("query").alias("q"), F.col("instructions").alias("ins"))
    u = s.select(F.col("k").alias("ku"), F.col("q").alias("qu"), F.col("ins").alias("insu"))
    d = keys.join(s, keys["key"] == F.col("k"), "left").join(u, F.upper(keys["key"]) == F.col("ku"), "left")
    out = d.select(*keys.columns, F.coalesce("q", "qu", X.sentence_query(F.col("key"))).alias("query"), F.coalesce("ins", "insu", F.lit("")).alias("instructions"))
    if overrides is None:
        return out
    o = overrides.select(F.col("key").alias("ko"), F.col("query").alias("qo"), F.col("instructions").alias("inso"))
    return out.join(o, out["key"] == F.col("ko"), "left").select(*keys.columns, F.coalesce("qo", "query").alias("query"), F.coalesce("inso", "instructions").alias("instructions"))


def looks_marked_up(text: str) -> bool:
    """As functions.text.looks_marked_up, for a model's reply within a task."""
    return re.match(r"\s*[{\[]", text) is not None or re.search(r"```|\bjson\b", text, re.I) is not None


def is_forbidden(text: str) -> bool:
    """As functions.text.forbidden_reasons, for a model's reply within a task."""
    return "::" in text or any(line.count(":") > 1 for line in text.splitlines()) or any(re.search(p, text, re.I) for _, p in X.FORBIDDEN)


PLAIN = "\n\nThe format was wrong. Answer again in plain text, without JSON or Markdown."
CORRECTED = "\n\nCheck before you answer: no placeholders, no source numbers, no titles, no '::' and one ':' a line at most. Answer again in plain text."


def generate(prompts: DataFrame, model: Callable[[str], str], timeout_retries: int = 1) -> DataFrame:
    """prompts (…, prompt, retry_prompt) with answer, attempts and failure (H1). After a timeout the model gets the shorter
    retry_prompt (null where there are no passages to leave out), up to timeout_retries times; a reply like JSON or
    Markdown is asked for once more as plain text; one with forbidden content is corrected once. A reply that is still
    forbidden is returned as it is, for processed() to empty. failure is LLM_TIMEOUT or LLM_ERROR, the answer then ''.

    The model is the caller's: a function from prompt to text, raising TimeoutError when it is late.
    """

    def ask(prompt: str) -> tuple[str | None, str | None]:
        try:
            return model(prompt), None
        except TimeoutError:
            return None, "LLM_TIMEOUT"
        except Exception:  # noqa: BLE001  one failed reply must not end the job
            return None, "LLM_ERROR"

    def ladder(prompt: str, shorter: str | None) -> tuple[str, int, str | None]:
        answer, failure = ask(prompt)
        n = 1
        while failure == "LLM_TIMEOUT" and shorter and n <= timeout_retries:
            again, late = ask(shorter)
            n += 1
            if late is None:
                answer, failure, prompt = again, None, shorter
        if failure:
            return "", n, failure
        if looks_marked_up(answer):
            again, _ = ask(prompt + PLAIN)
            answer, n = answer if again is None else again, n + 1
        if is_forbidden(answer):
            again, _ = ask(prompt + CORRECTED)
            answer, n = answer if again is None else again, n + 1
        return answer, n, None

    def run(batches):
        for pdf in batches:
            rows = [ladder(p, s if isinstance(s, str) else None) for p, s in zip(pdf["prompt"], pdf["retry_prompt"], strict=True)]
            got = pd.DataFrame({"answer": [r[0] for r in rows], "attempts": pd.array([r[1] for r in rows], dtype="int32"), "failure": pd.array([r[2] for r in rows], dtype="object")}, index=pdf.index)
            yield pd.concat([pdf, got], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{kinds}, answer string, attempts int, failure string")


def transcribe(audio: DataFrame, model: Callable[[str], list[tuple[float, float, str]]]) -> DataFrame:
    """audio (source_id, path) to timed segments by the caller's speech model (H2)."""

    def run(batches):
        for pdf in batches:
            rows = [(s, i, a, b, t) for s, p in zip(pdf["source_id"], pdf["path"], strict=True) for i, (a, b, t) in enumerate(model(p))]
            yield pd.DataFrame(rows, columns=["source_id", "seq", "start", "end", "text"])

    return audio.select("source_id", "path").mapInPandas(run, "source_id string, seq int, start double, end double, text string")


def cleaned(answer: Column, max_lines: Column, max_chars: int) -> Column:
    """Sanitised, cut to lines, then characters."""
    t = X.sanitise(answer)
    return X.first_chars(X.first_lines(F.when(t == EMPTY, F.lit("")).otherwise(t), max_lines), max_chars)


def processed(responses: DataFrame, max_chars: int = 400) -> DataFrame:
    """responses (…, kind, answer, deterministic, n_passages, require_sources, max_lines, allowed, failure) with value and
    missing_info codes (N35, J16): a deterministic field takes its value; no passages where sources are required; a failed
    call; forbidden output is emptied; where values are allowed, only those; EMPTY if nothing else says why."""
    det = F.col("kind") == "deterministic"
    no_context = ~det & F.col("require_sources") & (F.col("n_passages") == 0)
    live = ~det & ~no_context & F.col("failure").isNull()
    d = responses.withColumn("_bad", live & (F.size(X.forbidden_reasons(F.coalesce("answer", F.lit("")))) > 0))
    d = d.withColumn("_text", cleaned(F.when(F.col("_bad"), F.lit(EMPTY)).otherwise(F.coalesce("answer", F.lit(""))), F.col("max_lines"), max_chars))
    limited = live & F.coalesce(F.size("allowed") > 0, F.lit(False))
    d = d.withColumn("_ok", X.allowed_value(F.col("_text"), F.col("allowed"))).withColumn("_denied", limited & F.col("_ok").isNull())
    value = F.when(det, X.strip(F.coalesce("deterministic", F.lit("")))).when(limited, F.coalesce("_ok", F.lit(""))).when(live, F.col("_text")).otherwise(F.lit(""))
    d = d.withColumn("value", value)
    codes = F.array_compact(
        F.array(
            F.when(det & (F.col("value") == ""), F.lit("DETERMINISTIC_EMPTY")),
            F.when(no_context, F.lit("NO_CONTEXT")),
            F.when(~det & ~no_context & F.col("failure").isNotNull(), F.col("failure")),
            F.when(F.col("_bad"), F.lit("FORBIDDEN_OUTPUT")),
            F.when(F.col("_denied"), F.lit(NOT_ALLOWED)),
            F.when(live & (F.col("value") == "") & ~F.col("_bad") & ~F.col("_denied"), F.lit("EMPTY")),
        )
    )
    return d.withColumn("missing_info", codes).drop("_bad", "_text", "_ok", "_denied")


def missing_info(answers: DataFrame) -> DataFrame:
    """The fields of which something is missing, with the codes."""
    return answers.filter(F.size("missing_info") > 0)


def as_text(value: Column, answer: Column, other: Column) -> Column:
    """An answer's value, else its answer, else the whole as JSON."""
    return F.coalesce(value, answer, F.to_json(other))


def filled_templates(templates: DataFrame, answers: DataFrame) -> DataFrame:
    """templates (template_id, pos, text) with {{KEY}} and {{key}} of non-empty answers (template_id, key, value) filled in;
    the markers of empty ones stay (J15, N22)."""
    a = answers.filter("value <> ''").select("template_id", F.explode(F.array(F.struct(F.concat(F.lit("{{"), F.upper("key"), F.lit("}}")).alias("key"), "value"), F.struct(F.concat(F.lit("{{"), F.lower("key"), F.lit("}}")).alias("key"), "value"))).alias("m"))
    m = a.groupBy("template_id").agg(F.collect_set("m").alias("markers"))  # bounded by the template's own markers
    d = templates.join(m, "template_id", "left")
    return d.select("template_id", "pos", F.when(F.col("markers").isNull(), F.col("text")).otherwise(X.fill(F.col("text"), F.col("markers"))).alias("text"))


# The texts of the prompts for summaries and of the report that they become.
OF_DOCUMENT = ("Voici le contenu du document « ", " ».\nRésume les informations importantes pour un rapport de stage (missions, contexte, compétences, résultats, etc.).\n\nCONTENU DU DOCUMENT :\n")
OF_REPORT = (
    "À partir des résumés ci-dessous, rédige un rapport de stage complet pour ",
    ". Structure le rapport avec des titres clairs :\n1. Introduction\n2. Présentation de l'entreprise et du contexte\n3. Missions réalisées\n4. Compétences développées\n5. Bilan et perspectives\n\n"
    "Le ton doit être professionnel, mais accessible. N'écris pas de bullet points, uniquement des paragraphes.\n\nRÉSUMÉS DE DOCUMENTS :\n",
)
OF_PART = "Résume en un seul texte les résumés ci-dessous, sans rien perdre d'important.\n\nRÉSUMÉS DE DOCUMENTS :\n"
ENTRY = ("--- Résumé de ", " ---\n", "\n\n")
LONGEST_NAME = 100


def replies(prompts: DataFrame, model: Callable[[str], str], longest: int) -> DataFrame:
    """prompts (…, prompt) with reply: the model's, cut to `longest` characters; '' where it fails."""

    def ask(prompt: str) -> str:
        try:
            return (model(prompt) or "")[:longest]
        except Exception:  # noqa: BLE001  one failed reply must not end the job
            return ""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(reply=[ask(p) for p in pdf["prompt"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{kinds}, reply string")


def summary_prompts(docs: DataFrame, budget: int) -> DataFrame:
    """(client_id, path, piece, name, prompt): a prompt for each document, for each piece of one that is longer than the budget."""
    name = F.right(F.element_at(F.split("path", "/"), -1), F.lit(LONGEST_NAME))
    step = budget - len("".join(OF_DOCUMENT)) - LONGEST_NAME
    text = F.coalesce("text", F.lit(""))
    last = F.greatest(F.ceil(F.length(text) / step) - 1, F.lit(0)).cast("int")
    pieces = docs.select("client_id", "path", name.alias("name"), text.alias("text"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return pieces.select("client_id", "path", "piece", "name", F.concat(F.lit(OF_DOCUMENT[0]), "name", F.lit(OF_DOCUMENT[1]), F.substring("text", F.col("piece") * step + 1, F.lit(step))).alias("prompt"))


def merge_prompts(summaries: DataFrame, person: Column, budget: int, longest: int) -> DataFrame:
    """(client_id, path, piece, name, prompt, final): summaries (client_id, path, piece, name, reply) in order, packed into prompts
    of at most `budget` characters. A client whose summaries fit in one has its report's prompt, final. person may use client_id.

    Running lengths of a client are added over ranges of its order (ordering.counted), so none is packed in one task.
    """
    head = max(len(OF_PART), len("".join(OF_REPORT)) + LONGEST_NAME)
    widest = longest + LONGEST_NAME + len("".join(ENTRY))
    room = budget - head - widest
    if room < 2 * widest:
        raise ValueError("the budget is too small for two summaries")
    entry = F.concat(F.lit(ENTRY[0]), "name", F.lit(ENTRY[1]), "reply", F.lit(ENTRY[2]))
    order = ["path", "piece"]
    spread = spread_by_order(summaries.select("client_id", *order, entry.alias("entry")), "client_id", order)
    placed = counted(spread, "client_id", order, F.length("entry"), "_upto")
    # an entry goes to the prompt in whose room it begins, so a prompt is over its room by less than one entry
    part = F.floor((F.col("_upto") - F.length("entry")) / room).cast("int")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, "entry"))), lambda x: x["entry"])
    packed = written(placed.groupBy("client_id", part.alias("piece")).agg(F.array_join(ordered, "").alias("all")), "packed")
    last = packed.groupBy("client_id").agg((F.max("piece") == 0).alias("final"))
    p = packed.join(last, "client_id")
    text = F.when(F.col("final"), F.concat(F.lit(OF_REPORT[0]), F.left(person, F.lit(LONGEST_NAME)), F.lit(OF_REPORT[1]), "all")).otherwise(F.concat(F.lit(OF_PART), "all"))
    return p.select("client_id", F.lit("").alias("path"), "piece", F.format_string("partie %d", F.col("piece") + 1).alias("name"), text.alias("prompt"), "final")


def reports(docs: DataFrame, model: Callable[[str], str], person: Column, budget: int = 24_000, longest: int = 2_000) -> DataFrame:
    """(client_id, levels, longest_prompt, report): documents (client_id, path, text) summarised one by one, summaries merged as
    often as it takes until one prompt holds a client's, and that one's reply, the report (A28). No prompt is longer than
    the budget (characters, about four a token). The driver loops over levels, whose number grows with the logarithm
    of the documents; each level is written."""
    level, out = 1, None
    asked = summary_prompts(docs, budget).withColumn("final", F.lit(False))
    while True:
        done = written(replies(asked, model, longest), "replies")
        some = done.filter("final").select("client_id", F.lit(level).alias("levels"), F.length("prompt").alias("longest_prompt"), F.col("reply").alias("report"))
        out = some if out is None else out.unionByName(some)
        rest = done.filter("not final")
        if not rest.limit(1).count():
            return out
        asked, level = merge_prompts(rest, person, budget, longest), level + 1
