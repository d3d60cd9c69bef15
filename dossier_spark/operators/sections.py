"""Documents to sections: headings, segments, canonical section by title, one winner per section."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier_spark.functions import text as X

BOUNDED_ANCHORS = 64  # anchors whose common letters with a title are counted before the sequence ratio
CONFIDENCE = {"exact": 1.0, "contains": 0.9, "regex": 0.85}
# Generic document titles, which stay unmapped.
GENERIC_TITLES = (r"^BILAN\s+D['’]ORIENTATION", r"^RAPPORT\s+D['’]ORIENTATION", r"^DOCUMENT\s+D['’]ORIENTATION", r"^BILAN\s+PROFESSIONNEL")
# The usual patterns of headings, and how headings are found unless a ruleset says otherwise.
NUMBERED = r"^\s*\d+(\.\d+){1,6}\.?\s+.+$"
UPPERCASE = r"^[A-ZÀ-ÖØ-Þ0-9\s'’\-,:]{8,}$"
HEADINGS = {"by_style": {"enabled": True}, "by_regex": {"enabled": True, "patterns": [{"regex": NUMBERED}, {"regex": UPPERCASE}]}, "by_heuristics": {"enabled": True, "max_length": 90, "prefer_bold": True}}
MOST_WORDS = 15
DICTIONARY = 64  # from so many anchors on, exact and contained ones are looked up in a dictionary and an automaton
# The top level of a normalised document, those of its nodes that hold nodes, and the weights of the key ones.
TEMPLATE = (
    "identity", "participation_programme", "profession_formation", "tests", "discussion_assure", "competences",
    "incertitudes_obstacles", "orientation_formation", "dossier_presentation", "conclusion",
)
TEMPLATE_NESTED = ("tests", "tests.ressources_professionnelles")
WEIGHTS = {"identity": 2.0, "profession_formation": 3.0, "orientation_formation": 3.0, "tests": 2.0, "competences": 1.5, "conclusion": 1.5}
# The parents that hold two labelled parts in one text, and the patterns of these parts.
INLINE = {
    "profession_formation": (
        ("profession", r"(?ims)\bProfession\b\s*(?:\n|:)\s*(.+?)(?=\n\s*\bFormation\b\s*(?:\n|:)|\z)"),
        ("formation", r"(?ims)\bFormation\b\s*(?:\n|:)\s*(.+?)(?=\n\s*\b[A-ZÀ-ÖØ-Þ].{2,}|\z)"),
    ),
    "orientation_formation": (
        ("orientation", r"(?ims)\bOrientation\b\s*(?:\n|:)\s*(.+?)(?=\n\s*\bStage\b\s*(?:\n|:)|\z)"),
        ("stage", r"(?ims)\bStage\b\s*(?:\n|:)\s*(.+?)\z"),
    ),
    "competences": (
        ("sociales", r"(?ims)\bSociales\b\s*(?:\n|:)\s*(.+?)(?=\n\s*\bProfessionnelles\b\s*(?:\n|:)|\z)"),
        ("professionnelles", r"(?ims)\bProfessionnelles\b\s*(?:\n|:)\s*(.+?)\z"),
    ),
}


@dataclass(frozen=True)
class Ruleset:
    """A ruleset as small dimensions. sections: (id, required, weight, fill) in pre-order; anchors: (section id, kind, pattern);
    weighted: the sections that are missed but not blocking; never_invent: those left empty where nothing was written; headings
    and normalize: how headings are found and titles written, with their switches."""

    sections: tuple[tuple[str, bool, float, str], ...]
    anchors: tuple[tuple[str, str, str], ...]
    styles: dict[str, int] = field(default_factory=dict)
    method_order: tuple[str, ...] = ("exact", "contains", "regex", "fuzzy")
    fuzzy_threshold: float = 0.84
    profiles: dict[str, dict] = field(default_factory=dict)
    default_profile: str = "placement_suivi"
    generic_titles: tuple[str, ...] = GENERIC_TITLES
    weighted: tuple[str, ...] = ()
    never_invent: tuple[str, ...] = ()
    headings: dict[str, dict] = field(default_factory=lambda: HEADINGS)
    normalize: dict[str, bool] = field(default_factory=lambda: X.NORMALIZE)

    def __post_init__(self):
        ids = [s[0] for s in self.sections]
        if not ids or len(set(ids)) != len(ids):
            raise ValueError("sections must be present and unique")
        if bad := {a[0] for a in self.anchors} - set(ids):
            raise ValueError(f"anchors of unknown sections: {sorted(bad)}")

    @classmethod
    def from_mapping(cls, raw: dict, weights: dict[str, float] | None = None) -> Ruleset:
        """From the nested form (S9): sections with anchors and children, flattened in pre-order."""
        for key in ("sections", "title_matching", "heading_detection"):
            if key not in raw:
                raise ValueError(f"ruleset lacks {key}")
        weights = WEIGHTS if weights is None else weights
        sections, anchors, weighted, todo = [], [], [], list(raw["sections"])
        while todo:
            s = todo.pop(0)
            sections.append((s["id"], bool(s.get("required")), weights.get(s["id"], 1.0), s.get("fill_strategy", "copy")))
            anchors += [(s["id"], kind, pattern) for a in s.get("anchors", {}).get("any", []) for kind, pattern in a.items() if kind in CONFIDENCE]
            weighted += [s["id"]] if s.get("weighted") else []
            todo = list(s.get("children", [])) + todo
        match, gate = raw["title_matching"], raw.get("production_gate", {})
        styles: dict[str, int] = {}
        for s in raw["heading_detection"].get("by_style", {}).get("styles", []):
            styles.setdefault(s["name"], s["level"])
        for p in raw["heading_detection"].get("by_regex", {}).get("patterns", []):
            re.compile(p.get("regex", ""))
        return cls(tuple(sections), tuple(anchors), styles, tuple(match.get("method_order", ("exact", "contains", "regex", "fuzzy"))), match.get("fuzzy_threshold", 0.84), gate.get("profiles", {}), gate.get("default_profile", "placement_suivi"), weighted=tuple(weighted), never_invent=tuple(raw.get("never_invent", ())), headings=raw["heading_detection"], normalize=raw.get("normalize", {}))

    @property
    def required(self) -> list[str]:
        return [s[0] for s in self.sections if s[1]]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(ord, section_id, required, weight, fill)"""
        return spark.createDataFrame([(i, *s) for i, s in enumerate(self.sections)], "ord int, section_id string, required boolean, weight double, fill string")


# ---------------------------------------------------------------- segments


def heading_level(rules: Ruleset) -> Column:
    """Level of a heading paragraph (text, style_name, is_bold), null for others: the ruleset's styles, then its patterns, which
    match from the beginning, then short paragraphs, bold ones if those are preferred (F5). Each part has its switch; a part
    without one is off."""
    on = lambda part: rules.headings.get(part, {}).get("enabled", False)
    t, found = F.col("text"), [F.lit(None).cast("int")]
    if on("by_style"):
        found += [F.when(F.col("style_name") == name, F.lit(level)) for name, level in rules.styles.items()]
    if on("by_regex"):
        level = F.coalesce(F.regexp_count(X.numbering(t), F.lit(r"\.")) + 1, F.lit(1))
        found += [F.when(t.rlike(f"(?U)^(?:{p.get('regex', '')})"), level) for p in rules.headings["by_regex"].get("patterns", [])]
    if on("by_heuristics"):
        rule = rules.headings["by_heuristics"]
        sentence = X.strip(t).endswith(".") | (F.size(F.split(X.collapse(t), " ")) > MOST_WORDS)
        short = (F.length(t) <= rule.get("max_length", 90)) & ~sentence
        found.append(F.when(short & F.col("is_bold") if rule.get("prefer_bold", True) else short, F.lit(2)))
    return F.coalesce(*found).cast("int")


def segments(paragraphs: DataFrame, rules: Ruleset) -> DataFrame:
    """paragraphs (doc_id, pos, text, style_name, is_bold) to (doc_id, seg_no, raw_title, title, level, paragraphs, content).

    One shuffle by doc_id; what stands before the first heading is dropped (W1, A9).
    """
    return _segments(paragraphs, rules).filter("seg_no > 0")


def _segments(paragraphs: DataFrame, rules: Ruleset) -> DataFrame:
    """segments(), and as number 0 what stands before the first heading, so that every document has a row."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = paragraphs.withColumn("level", heading_level(rules))
    numbered = level.withColumn("seg_no", F.count("level").over(w))
    body = F.array_sort(F.collect_list(F.when(F.col("level").isNull() & (F.col("seg_no") > 0), F.struct("pos", "text"))))
    g = numbered.groupBy("doc_id", "seg_no").agg(F.min_by("text", "pos").alias("raw_title"), F.min_by("level", "pos").alias("level"), F.transform(body, lambda x: x["text"]).alias("paragraphs"))
    return g.select("doc_id", "seg_no", "raw_title", X.title(F.col("raw_title"), rules.normalize).alias("title"), "level", "paragraphs", F.array_join("paragraphs", "\n").alias("content"))


# ---------------------------------------------------------------- titles to sections


def ignored_title(title: Column, rules: Ruleset) -> Column:
    """Generic document titles."""
    return F.exists(F.array(*[title.rlike("(?iu)" + p) for p in rules.generic_titles]), lambda x: x)


def _ranked_anchors(rules: Ruleset, kinds: tuple[str, ...]) -> list[tuple[tuple, str, str]]:
    """(rank, kind, pattern) of the anchors of these kinds; rank is (method, section, anchor, section id, method name, confidence)."""
    order = {s[0]: i for i, s in enumerate(rules.sections)}
    own = [(n, *a) for n, a in enumerate(rules.anchors) if a[1] in kinds and a[1] in rules.method_order]
    return [((rules.method_order.index(kind), order[section], n, section, kind, CONFIDENCE[kind]), kind, pattern) for n, section, kind, pattern in own]


RANK = "struct<method_ord:int,section_ord:int,anchor_ord:int,section_id:string,method:string,confidence:double>"


def anchor_lookup(ranked: list[tuple[tuple, str, str]], robust_patterns: list[str]):
    """The first of many exact and contained anchors that hits a title: exact ones by a dictionary of compared forms, contained
    ones by one automaton over all of them, so that neither plan nor time grows with their number. The titles come as
    (lower-cased, compared form)."""
    exact: dict[str, tuple] = {}
    for (rank, kind, _), form in zip(ranked, robust_patterns, strict=True):
        if kind == "exact":
            exact[form] = min(rank, exact.get(form, rank))
    contained: dict[str, tuple] = {}
    for rank, kind, pattern in ranked:
        if kind == "contains":
            contained[pattern.lower()] = min(rank, contained.get(pattern.lower(), rank))
    anywhere = contained.pop("", None)

    @F.pandas_udf(RANK)
    def first(titles: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machine = automaton(contained)
        for low, norm in titles:
            rows = []
            for a, b in zip(low, norm, strict=True):
                hits = [] if a is None else [*machine(a), *([anywhere] if anywhere else [])]
                if b is not None and b in exact:
                    hits.append(exact[b])
                rows.append(min(hits) if hits else (None,) * 6)
            yield pd.DataFrame(rows, columns=["method_ord", "section_ord", "anchor_ord", "section_id", "method", "confidence"])

    return first


def automaton(words: dict[str, tuple]):
    """A function from a text to the values of the words in it, by following one state machine over all words (goto, failure and
    output links over a trie)."""
    step: list[dict[str, int]] = [{}]
    fail, value = [0], [()]
    for word, v in words.items():
        at = 0
        for ch in word:
            if ch not in step[at]:
                step[at][ch] = len(step)
                step.append({}), fail.append(0), value.append(())
            at = step[at][ch]
        value[at] = (*value[at], v)
    level = list(step[0].values())
    while level:
        following = []
        for at in level:
            for ch, to in step[at].items():
                back = fail[at]
                while back and ch not in step[back]:
                    back = fail[back]
                fail[to] = step[back].get(ch, 0)
                best = (*value[to], *value[fail[to]])
                value[to] = (min(best),) if best else ()  # of all words that end here the first counts
                following.append(to)
        level = following

    def run(text: str) -> list[tuple]:
        at, out = 0, []
        for ch in text:
            while at and ch not in step[at]:
                at = fail[at]
            at = step[at].get(ch, 0)
            out.extend(value[at])
        return out

    return run


def match_title(title: Column, rules: Ruleset, kinds: tuple[str, ...] = ("exact", "contains", "regex")) -> Column:
    """struct(method_ord, section_ord, anchor_ord, section_id, method, confidence) of the first anchor that hits, in the
    order of methods, then sections, then anchors; null if none (J1, J2, J3, J5). Few anchors are constants of the plan; from
    DICTIONARY exact and contained ones on, these are looked up."""
    ranked = _ranked_anchors(rules, kinds)
    norm, low, hits = X.robust(title), F.lower(title), []
    plain = [a for a in ranked if a[1] != "regex"]
    if len(plain) >= DICTIONARY:
        spark = SparkSession.getActiveSession()
        forms = [r["f"] for r in spark.createDataFrame([(i, p) for i, (_, _, p) in enumerate(plain)], "i int, p string").select("i", X.robust(F.col("p")).alias("f")).orderBy("i").collect()]
        found = anchor_lookup(plain, forms)(low, norm)
        hits.append(F.when(found["section_id"].isNotNull(), found))
        ranked = [a for a in ranked if a[1] == "regex"]
    for (method_ord, section_ord, n, section, method, confidence), kind, pattern in ranked:
        if kind == "exact":
            hit = norm == X.robust(F.lit(pattern))
        elif kind == "contains":
            hit = F.contains(low, F.lower(F.lit(pattern)))
        else:
            hit = title.rlike("(?iu)" + pattern.replace("(?i)", ""))
        hits.append(F.when(hit, F.struct(F.lit(method_ord).alias("method_ord"), F.lit(section_ord).alias("section_ord"), F.lit(n).alias("anchor_ord"), F.lit(section).alias("section_id"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))))
    return F.array_min(F.array_compact(F.array(*hits))) if hits else F.lit(None).cast(RANK)


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def fuzzy_matcher(rules: Ruleset):
    """Best anchor of a title by sequence ratio, the first of equals, pruned by the length bound (J4). The anchors are the
    ruleset's; a task keeps the titles it has met."""
    anchors = [(s, p.lower()) for s, kind, p in rules.anchors if kind in ("exact", "contains")]
    threshold = rules.fuzzy_threshold

    def find(low: str) -> tuple[str | None, float | None]:
        found, score = None, 0.0
        for section, a in anchors:
            if low and 2 * min(len(low), len(a)) / (len(low) + len(a)) >= max(threshold, score) and (r := ratio(low, a)) >= threshold and r > score:
                found, score = section, r
        return found, score if found else None

    @F.pandas_udf("section_id string, confidence double")
    def best(titles: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}
        for block in titles:
            out = []
            for t in block:
                low = (t or "").lower()
                if low not in known:
                    if len(known) >= KNOWN_TITLES:
                        known.clear()
                    known[low] = find(low)
                out.append(known[low])
            yield pd.DataFrame(out, columns=["section_id", "confidence"])

    return best


def map_titles(segs: DataFrame, rules: Ruleset) -> DataFrame:
    """segments with section_id, method and confidence (null, null, 0 if unmapped), in place: no shuffle."""
    m = segs.withColumn("_m", F.when(~ignored_title(F.col("title"), rules), match_title(F.col("title"), rules)))
    if "fuzzy" not in rules.method_order:
        return m.select(*segs.columns, "_m.section_id", "_m.method", F.coalesce("_m.confidence", F.lit(0.0)).alias("confidence"))
    names = [p.lower() for _, kind, p in rules.anchors if kind in ("exact", "contains")]
    n = F.length("title")
    if len(names) <= BOUNDED_ANCHORS:
        near = reduce(or_, [X.most_alike(F.lower("title"), F.lit(a)) >= rules.fuzzy_threshold for a in names], F.lit(False))
    else:  # by lengths alone: letter counts of so many anchors cost more than they save
        near = F.exists(F.lit(sorted({len(a) for a in names})), lambda a: 2 * F.least(n, a) >= rules.fuzzy_threshold * (n + a))
    m = m.withColumn("_f", fuzzy_matcher(rules)(F.when(F.col("_m").isNull() & ~ignored_title(F.col("title"), rules) & near, F.col("title"))))
    fuzzy = F.when(F.col("_f.section_id").isNotNull(), F.lit("fuzzy"))
    return m.select(*segs.columns, F.coalesce("_m.section_id", "_f.section_id").alias("section_id"), F.coalesce("_m.method", fuzzy).alias("method"), F.coalesce("_m.confidence", "_f.confidence", F.lit(0.0)).alias("confidence"))


def _ranked(mapped: DataFrame) -> DataFrame:
    """mapped with r, 1 for the winner of its document and section, and first_seg, where the section first appears. The
    winner is the most confident, then that of most paragraphs, then the first; for identity, the first title with an id
    number before all. Clustered by doc_id alone, as what follows is."""
    by = Window.partitionBy("doc_id", "section_id")
    has = F.coalesce((F.col("section_id") == "identity") & F.col("raw_title").rlike(r"756[\s.\-]?\d{4}"), F.lit(False))
    m = mapped.withColumn("has_id", has)
    first = F.when(F.col("has_id"), F.lit(0))
    return m.withColumn("r", F.row_number().over(by.orderBy(F.desc("has_id"), first.otherwise(F.col("confidence")).desc(), first.otherwise(F.size("paragraphs")).desc(), "seg_no"))).withColumn("first_seg", F.min("seg_no").over(by)).drop("has_id")


def winners(mapped: DataFrame) -> DataFrame:
    """One segment for each document and section."""
    return _ranked(mapped.filter("section_id is not null")).filter("r = 1").drop("r")


def deduped(mapped: DataFrame) -> DataFrame:
    """Winners, and all unmapped segments."""
    return winners(mapped).drop("first_seg").unionByName(mapped.filter("section_id is null"))


def provenance(win: DataFrame) -> DataFrame:
    """Where each filled section came from."""
    return win.select("doc_id", "section_id", F.col("raw_title").alias("source_title"), F.bround("confidence", 2).alias("confidence"), F.size("paragraphs").alias("n_paragraphs"), "level", X.snippet(F.col("paragraphs"), F.col("raw_title")).alias("snippet"))


def section_lists(mapped: DataFrame) -> DataFrame:
    """(doc_id, found, unknown): arrays of the found sections (id, title, confidence) and of unknown titles, in order."""
    each = lambda when, s: F.array_sort(F.collect_list(F.when(when, s)))
    known = F.col("section_id").isNotNull()
    d = deduped(mapped).groupBy("doc_id").agg(each(known, F.struct("seg_no", "section_id", "title", "confidence")).alias("f"), each(~known, F.struct("seg_no", "title")).alias("u"))
    return d.select("doc_id", F.transform("f", lambda x: F.struct(x["section_id"].alias("section_id"), x["title"].alias("title"), x["confidence"].alias("confidence"))).alias("found"), F.transform("u", lambda x: x["title"]).alias("unknown"))


def fill_strategies(win: DataFrame, rules: Ruleset) -> DataFrame:
    """Winners with the fill strategy of their section and the content it gives: in this version every strategy copies,
    and a section that must not be invented is '' where nothing stands below its title (J6)."""
    fill = F.lit(None).cast("string")
    for sid, _, _, how in rules.sections:
        fill = F.when(F.col("section_id") == sid, F.lit(how)).otherwise(fill)
    empty = F.col("section_id").isin(list(rules.never_invent)) & (F.size("paragraphs") == 0) if rules.never_invent else F.lit(False)
    return win.withColumn("fill", fill).withColumn("content", F.when(empty, F.lit("")).otherwise(F.col("content")))


# ---------------------------------------------------------------- content


def identity(content: Column, title: Column) -> Column:
    """(avs, name, surname, full_name) of an identity section's text, or of its title where it has none: the id number as
    written, with dots for spaces and hyphens, and the name between its form of address and the number; '' if missing (N13)."""
    t = F.when(content != "", content).otherwise(title)
    number = F.translate(F.regexp_extract(t, r"(?U)(756[\s.\-]?\d{4}[\s.\-]?\d{4}[\s.\-]?\d{2})", 1), " -", "..")
    name = X.strip(F.regexp_extract(t, "(?iudU)(?:Monsieur|Madame|M\\.|Mme)\\s+(.+?)\\s*[\u2013\u2014\\-]\\s*756", 1))
    words = F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")
    return F.struct(number.alias("avs"), F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("name"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("surname"), name.alias("full_name"))


def inline_split(parent: str, content: Column) -> Column:
    """Map of the two labelled parts of a parent section's text, blank lines removed, '' where one is missing; null if
    both are or the section has no parts (N17)."""
    if parent not in INLINE:
        return F.lit(None).cast("map<string,string>")
    part = lambda p: F.regexp_replace(X.strip(F.regexp_extract(content, p.replace("(?ims)", "(?imsuU)"), 1)), r"(?U)\n\s*\n", "\n")
    parts = [(name, part(p)) for name, p in INLINE[parent]]
    both = F.create_map(*[x for name, c in parts for x in (F.lit(name), c)])
    return F.when(F.exists(F.map_values(both), lambda v: v != ""), both)


def merged(old: Column, new: Column) -> Column:
    """Repeated content of one section: an empty one adds nothing, a much longer one replaces, one that contains the other
    leaves the first, else both (N18). In a report one segment fills a section, so nothing is left to merge."""
    same = new.isNull() | (new == "") | (new == old)
    return F.when(old.isNull() | (old == ""), new).when(same, old).when(F.length(new) > 1.5 * F.length(old), new).when(F.contains(old, new) | F.contains(new, old), old).otherwise(F.concat(old, F.lit("\n\n"), new))


# ---------------------------------------------------------------- coverage and gate

# What marks a place that waits to be filled in, and its label.
PLACEHOLDERS = ((r"\bMETTRE\b", "METTRE"), (r"\bÀ COMPLÉTER\b", "À COMPLÉTER"), (r"\bTODO\b", "TODO"), (r"\bXXXX+\b", "XXXX"), (r"\.{3,}", "..."), (r"\[\s*\]", "[ ]"), (r"\b__+\b", "___"))
# Title words of the stage profile and of the measures.
STAGE = ("stage", "bilan de stage", "orientation formation stage")
LAI = ("lai 15", "lai15", "lai 18", "lai18", "lai-15", "lai-18")
CONTEXT, KNOWN_TITLES = 50, 100_000
LEAF = "struct<path:string,text:string>"


def placeholders(text: Column) -> Column:
    """How many places of a text still wait to be filled in."""
    total = F.lit(0)
    for p, _ in PLACEHOLDERS:
        total = total + F.regexp_count(text, F.lit("(?iuU)" + p))
    return total


def placeholder_hits(leaves: DataFrame, width: int = CONTEXT) -> DataFrame:
    """Every waiting place of leaves (doc_id, path, text): path, pattern (its label) and context, `width` characters to
    either side (A12). Only texts that have one reach Python."""
    found = [(re.compile(p, re.I), label) for p, label in PLACEHOLDERS]

    @F.pandas_udf("array<struct<pattern:string,context:string>>")
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"pattern": label, "context": t[max(0, m.start() - width) : m.end() + width].replace("\n", " ").strip()} for p, label in found for m in p.finditer(t)] for t in texts])

    d = leaves.filter((X.strip(F.col("text")) != "") & (placeholders(F.col("text")) > 0))
    return d.select("doc_id", "path", F.explode(hits("text")).alias("h")).select("doc_id", "path", "h.pattern", "h.context")


def normalised(mapped: DataFrame, rules: Ruleset) -> DataFrame:
    """One row for each document: found (section ids), leaves (path and text of every filled place of the normalised
    document), failed (parents whose inline parts were not found), and what coverage and profile need. One aggregation by
    doc_id over the winners and the unmapped segments of `mapped`; rows of segment 0 only keep their document.

    Winners fill the document in the order in which their sections first appear. A parent's text replaces what was filled
    below it before; what comes below it later keeps that text as _raw; inline parts are split out of a parent's text
    where nothing came later.
    """
    known = F.col("section_id").isNotNull()
    kept = fill_strategies(_ranked(mapped).filter((known & (F.col("r") == 1)) | ~known), rules)
    real = F.col("seg_no") > 0
    won = F.array_sort(F.collect_list(F.when(known, F.struct(F.col("first_seg").alias("o"), F.col("section_id").alias("sid"), F.col("content").alias("c"), F.col("raw_title").alias("title")))))
    d = kept.groupBy("doc_id").agg(won.alias("won"), F.count_if(~known & real).alias("unknown_titles"), *_signals(real))
    below = lambda a, b: a.startswith(F.concat(b, F.lit(".")))  # noqa: E731  a is a place below b
    leaf = lambda path, text: F.struct(path.alias("path"), text.alias("text"))
    nothing = F.array().cast(f"array<{LEAF}>")
    later = lambda x: F.exists("won", lambda y: below(y["sid"], x["sid"]) & (y["o"] > x["o"]))
    lost = lambda x: F.exists("won", lambda a: below(x["sid"], a["sid"]) & (a["c"] != "") & (a["o"] > x["o"]))

    def parts_of(parent: str, text: Column) -> Column:
        return F.transform(F.map_entries(inline_split(parent, text)), lambda e: leaf(F.concat(F.lit(parent), F.lit("."), e["key"]), e["value"]))

    def leaves_of(x: Column) -> Column:
        who = identity(x["c"], x["title"])
        own = F.filter(F.array(*[leaf(F.lit(f"identity.{k}"), who[k]) for k in ("avs", "name", "surname", "full_name")]), lambda y: y["text"] != "")
        out = F.when(later(x), F.array(leaf(F.concat(x["sid"], F.lit("._raw")), x["c"])))
        for parent in INLINE:
            out = out.when(x["sid"] == parent, F.coalesce(F.filter(parts_of(parent, x["c"]), lambda y: y["text"] != ""), nothing))
        plain = out.otherwise(F.array(leaf(x["sid"], x["c"])))
        return F.when(x["sid"] == "identity", own).when((x["c"] == "") | lost(x), nothing).otherwise(plain)

    unsplit = lambda x: (x["c"] != "") & ~lost(x) & ~later(x) & F.coalesce(*[F.when(x["sid"] == p, inline_split(p, x["c"]).isNull()) for p in INLINE], F.lit(False))
    failed = F.transform(F.filter("won", unsplit), lambda x: x["sid"])
    overwritten = F.transform(F.filter("won", lambda x: x["c"] != ""), lambda x: x["sid"])
    return d.select("doc_id", F.transform("won", lambda x: x["sid"]).alias("found"), F.flatten(F.transform("won", leaves_of)).alias("leaves"), failed.alias("failed"), overwritten.alias("texts"), "unknown_titles", *SIGNALS)


def filled_test(section: str | Column, strict: bool = False) -> Column:
    """Whether a section of a normalised document is filled: it or a place below it has text. Identity needs a number or a
    name. A node that holds nodes counts as filled even when all these are empty, unless strict (A8, T5)."""
    sid = F.lit(section)
    if section == "identity":
        return F.exists("leaves", lambda p: p["path"].isin("identity.avs", "identity.full_name", "identity.name"))
    text = lambda p: X.strip(p["text"]) != ""
    deep = lambda p: p["path"].startswith(section + ".") & (F.contains(F.substring(p["path"], len(section) + 2, 1 << 20), F.lit(".")) | text(p))
    out = F.exists("leaves", lambda p: ((p["path"] == sid) & text(p)) | deep(p))
    if section in TEMPLATE_NESTED and not strict:
        out = out | ~F.exists("texts", lambda t: (t == sid) | sid.startswith(F.concat(t, F.lit("."))))
    return out


def coverage(d: DataFrame, rules: Ruleset, strict: bool = False) -> DataFrame:
    """normalised() with missing_required, missing_weighted, and the ratios coverage (found of all sections),
    required_coverage (0 if none is required) and weighted_coverage (of the document's top level: the template's keys, and
    others where something was filled) (A6, A7, J7)."""
    missing = lambda ids: F.array_compact(F.array(*[F.when(~filled_test(s, strict), F.lit(s)) for s in ids])) if ids else F.array().cast("array<string>")
    made = lambda top: F.exists("found", lambda s: s.startswith(top + ".")) | F.exists("texts", lambda s: s == top)
    weights = {s[0]: s[2] for s in rules.sections}
    total, have = F.lit(0.0), F.lit(0.0)
    others = dict.fromkeys(s[0].split(".")[0] for s in rules.sections if s[0].split(".")[0] not in TEMPLATE)
    for top in (*TEMPLATE, *others):
        w = F.lit(float(weights.get(top, WEIGHTS.get(top, 1.0))))
        there = F.lit(True) if top in TEMPLATE else made(top)
        total = total + F.when(there, w).otherwise(F.lit(0.0))
        have = have + F.when(there & filled_test(top, strict), w).otherwise(F.lit(0.0))
    n = len(rules.required)
    d = d.withColumn("missing_required", missing(rules.required)).withColumn("missing_weighted", missing(rules.weighted))
    required = (F.lit(float(n)) - F.size("missing_required")) / F.lit(float(n)) if n else F.lit(0.0)
    return d.withColumn("coverage", F.size("found") / F.lit(float(len(rules.sections)))).withColumn("required_coverage", required).withColumn("weighted_coverage", have / total)


SIGNALS = ("has_stage", "has_lai15", "has_lai18", "has_orientation", "n_bilan")


def _signals(real: Column) -> list[Column]:
    """Aggregates of the profile signals over the deduplicated segments of a document."""
    low, sid = F.when(real, F.lower("title")), F.coalesce(F.lower("section_id"), F.lit(""))
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(c, x))
    first_lai = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k[-2:])) for k in LAI])
    family = sid.startswith("tests").cast("int") + F.contains(sid, F.lit("vocation")).cast("int") + F.contains(sid, F.lit("profil_emploi")).cast("int") + F.contains(sid, F.lit("ressources_professionnelles")).cast("int")
    no = F.lit(False)
    return [
        F.coalesce(F.bool_or(F.coalesce(has(low, STAGE), no) | F.contains(sid, F.lit("stage"))), no).alias("has_stage"),
        F.coalesce(F.bool_or(first_lai == "15"), no).alias("has_lai15"),
        F.coalesce(F.bool_or(first_lai == "18"), no).alias("has_lai18"),
        F.coalesce(F.bool_or(F.contains(sid, F.lit("orientation"))), no).alias("has_orientation"),
        F.sum(family).cast("int").alias("n_bilan"),
    ]


def signals(mapped: DataFrame) -> DataFrame:
    """Profile signals from the titles and section ids of winners and unmapped segments, and the number of unknown titles (A10)."""
    real = F.lit(True)
    return deduped(mapped).groupBy("doc_id").agg(*_signals(real), F.count_if(F.col("section_id").isNull()).alias("unknown_titles"))


# Fixed values in profile(): what each signal adds to or takes from a profile's score.
def profile(sig: DataFrame, default: str) -> DataFrame:
    """Scores of the three profiles, the winner (ties in this order), ranking and margin."""
    lai = F.col("has_lai15") | F.col("has_lai18")
    n = F.col("n_bilan")
    i = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    s = sig.withColumn("stage", i(F.col("has_stage"), 100) + i(F.col("has_orientation"), 20))
    s = s.withColumn("bilan_complet", n * 30 + i(lai, 25) - i(n < 2, 20)).withColumn("placement_suivi", F.lit(10) + i(lai, 15) + i(n == 0, 20))
    order = F.array_sort(F.array(*[F.struct((-F.col(p)).alias("s"), F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(("stage", "bilan_complet", "placement_suivi"))]))
    s = s.withColumn("o", order)
    best, second = -F.col("o")[0]["s"], -F.col("o")[1]["s"]
    return s.withColumn("profile", F.when(best > 0, F.col("o")[0]["p"]).otherwise(F.lit(default))).withColumn("margin", F.when(best > 0, best - second).otherwise(F.lit(0))).withColumn("ranking", F.transform("o", lambda x: x["p"])).drop("o")


def gate(docs: DataFrame, rules: Ruleset) -> DataFrame:
    """docs (doc_id, profile, missing_required, unknown_titles, placeholders) with what counts for the profile, the four
    criteria, the reasons and GO or NO-GO (A13, J8, J9). An unknown profile keeps its name and takes the default's thresholds."""
    fallback = rules.profiles.get("placement_suivi", {})

    def choose(value):
        c = F.lit(value(fallback))
        for name, p in rules.profiles.items():
            c = F.when(F.col("profile") == name, F.lit(value(p))).otherwise(c)
        return c

    limit = lambda key, default: choose(lambda p: p.get("thresholds", {}).get(key, default))
    most_missing, least_covered, most_unknown, most_open = limit("max_missing_required", 0), limit("min_required_coverage_ratio", 0.9), limit("max_unknown_titles", 5), limit("max_placeholders", 3)
    prefixes = F.split(choose(lambda p: "|".join(p.get("ignore_required_prefixes", []))), r"\|")
    counts = lambda ids: F.filter(ids, lambda s: ~F.exists(prefixes, lambda p: (p != "") & s.startswith(p)))
    every = F.array(*map(F.lit, rules.required)) if rules.required else F.array().cast("array<string>")
    d = docs.withColumn("effective", counts(F.col("missing_required"))).withColumn("n_required", F.size(counts(every)))
    d = d.withColumn("n_missing", F.size("effective")).withColumn("coverage_effective", F.when(F.col("n_required") > 0, (F.col("n_required") - F.col("n_missing")) / F.col("n_required")).otherwise(F.lit(1.0)))
    d = d.withColumn("sections_ok", F.col("n_missing") <= most_missing).withColumn("coverage_ok", F.col("coverage_effective") >= least_covered)
    d = d.withColumn("titles_ok", F.col("unknown_titles") <= most_unknown).withColumn("placeholders_ok", F.col("placeholders") <= most_open)
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("sections_ok"), F.format_string("Missing %d required section(s) for profile '%s' (max: %d): %s", "n_missing", "profile", most_missing, F.array_join(F.slice("effective", 1, 3), ", "))),
            F.when(~F.col("coverage_ok"), F.format_string("Required coverage too low: %.1f%% < %.0f%% (profile: %s)", F.col("coverage_effective") * 100, least_covered * 100, "profile")),
            F.when(~F.col("titles_ok"), F.format_string("Too many unknown titles: %d > %d (profile: %s)", "unknown_titles", most_unknown, "profile")),
            F.when(~F.col("placeholders_ok"), F.format_string("Many placeholders found: %d > %d (profile: %s)", "placeholders", most_open, "profile")),
        )
    )
    return d.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, F.lit("GO")).otherwise(F.lit("NO-GO")))


def warnings(d: DataFrame) -> DataFrame:
    """What the report warns of: required and weighted sections missing, inline parts not found."""
    each = lambda c, text: F.transform(c, lambda s: F.concat(F.lit(text), s))

    def inline(p: Column) -> Column:
        out = F.lit("")
        for parent, parts in INLINE.items():
            out = F.when(p == parent, F.lit(f"Inline split failed for {parent} (expected: {', '.join(n for n, _ in parts)})")).otherwise(out)
        return out

    return d.withColumn("warnings", F.concat(each("missing_required", "Required section missing: "), each("missing_weighted", "Weighted section missing (not blocking): "), F.transform("failed", inline)))


def _mapped(paragraphs: DataFrame, rules: Ruleset) -> DataFrame:
    """Mapped segments, and of every document what stands before its first heading, which is none."""
    mapped = map_titles(_segments(paragraphs, rules), rules)
    lead = F.col("seg_no") > 0
    return mapped.withColumn("section_id", F.when(lead, F.col("section_id"))).withColumn("confidence", F.when(lead, F.col("confidence")).otherwise(F.lit(0.0)))


def filled_sections(paragraphs: DataFrame, rules: Ruleset) -> DataFrame:
    """(doc_id, section_id, filled) of every document and section, also of documents without a heading."""
    ids = [s[0] for s in rules.sections]
    d = normalised(_mapped(paragraphs, rules), rules)
    return d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("section_id"), F.coalesce(filled_test(i), F.lit(False)).alias("filled")) for i in ids])))


def report(paragraphs: DataFrame, rules: Ruleset, forced: str | None = None, strict: bool = False) -> DataFrame:
    """The flagship plan: paragraphs to one gated row for each document. `forced` sets the profile of all (H4).

    One scan and one shuffle, by doc_id: segments, winners and the document are windows and aggregates within it.
    """
    d = normalised(_mapped(paragraphs, rules), rules)
    holes = F.aggregate("leaves", F.lit(0), lambda n, p: n + placeholders(p["text"]))
    d = profile(warnings(coverage(d, rules, strict)), rules.default_profile).withColumn("placeholders", holes)
    d = d.withColumn("forced", F.lit(forced is not None))
    return gate(d.withColumn("profile", F.lit(forced)) if forced else d, rules)


# ---------------------------------------------------------------- batches


def gate_metrics() -> Column:
    """What the gate measured: required coverage and missing sections, as they are and as the profile counts them."""
    return F.struct(
        F.bround("required_coverage", 2).alias("required_coverage_ratio"), F.bround("coverage_effective", 2).alias("required_coverage_ratio_effective"), F.col("unknown_titles").cast("int").alias("unknown_titles_count"),
        F.col("placeholders").alias("placeholders_count"), F.size("missing_required").alias("missing_required_sections_count"), F.col("n_missing").alias("missing_required_sections_count_effective"),
    )


def batch_rows(reported: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """One result row for each document (A31, U2): success with profile, gate, ratios as reported (2 digits), counts,
    reasons, warnings, signals (those of a forced profile say only that it is), criteria and metrics; failures (doc_id, error_type, error_message) as error rows."""
    ok = reported.select(
        "doc_id", F.lit("success").alias("status"), "profile", F.col("status").alias("gate_status"), F.bround("required_coverage", 2).alias("required_coverage_ratio"), F.bround("weighted_coverage", 2).alias("weighted_coverage"),
        F.col("effective").alias("missing_required_sections"), F.col("unknown_titles").cast("int").alias("unknown_titles_count"), F.col("placeholders").alias("placeholders_count"), "reasons", "warnings",
        F.struct(*[F.when(~F.col("forced"), F.col(s)).alias(s) for s in SIGNALS], "forced").alias("signals"), F.struct("sections_ok", "coverage_ok", "titles_ok", "placeholders_ok").alias("criteria"),
        gate_metrics().alias("metrics"),
    )
    if failures is None:
        return ok.withColumn("error_type", F.lit(None).cast("string")).withColumn("error_message", F.lit(None).cast("string"))
    bad = failures.select("doc_id", F.lit("error").alias("status"), "error_type", "error_message")
    return ok.unionByName(bad, allowMissingColumns=True)


def batch_summary(batch: DataFrame) -> DataFrame:
    """Totals over batch_rows(): the mean of the required ratio is taken over all rows, errors as 0 (A5)."""
    ok = F.col("status") == "success"
    mean = F.coalesce(F.sum(F.when(ok, F.col("required_coverage_ratio"))), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))
    return batch.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("errors"),
        F.count_if(ok & (F.col("gate_status") == "GO")).alias("go"), F.count_if(ok & (F.col("gate_status") == "NO-GO")).alias("no_go"), F.round(mean, 3).alias("mean_coverage"),
    )


def selection_summary(batch: DataFrame, chosen: DataFrame) -> DataFrame:
    """The summary of the chosen documents (doc_id): here the mean is over the successful ones."""
    ok = F.col("status") == "success"
    mean = F.coalesce(F.sum(F.when(ok, F.col("required_coverage_ratio"))), F.lit(0.0)) / F.greatest(F.count_if(ok), F.lit(1))
    d = batch.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    return d.agg(F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("errors"), F.count_if(ok & (F.col("gate_status") == "GO")).alias("go"), F.round(mean, 3).alias("mean_coverage"))


def csv_rows(batch: DataFrame) -> DataFrame:
    """The batch table of nine columns, ratios with three digits, - and 0 for errors; a weighted coverage of 0 shows the
    required one (S11)."""
    ok = F.col("status") == "success"
    ratio3 = lambda c: F.when(ok, F.format_string("%.3f", c)).otherwise(F.lit("0.000"))
    count = lambda c: F.when(ok, c).otherwise(F.lit(0))
    w = F.when(F.col("weighted_coverage") == 0, F.col("required_coverage_ratio")).otherwise(F.col("weighted_coverage"))
    return batch.select(
        F.col("doc_id").cast("string").alias("client_folder"), F.when(ok, F.col("profile")).otherwise(F.lit("-")).alias("profile_selected"), F.when(ok, F.col("gate_status")).otherwise(F.lit("-")).alias("gate_status"),
        ratio3(F.col("required_coverage_ratio")).alias("required_coverage"), ratio3(w).alias("weighted_coverage"), count(F.col("unknown_titles_count")).alias("unknown_titles_count"),
        count(F.size("missing_required_sections")).alias("missing_required_sections_count"), count(F.col("placeholders_count")).alias("placeholders_count"), "status",
    )


def preview(items: Column, n: int) -> Column:
    """(first, rest): the first n of an array, and how many more there are (T4)."""
    return F.struct(F.slice(items, 1, n).alias("first"), F.greatest(F.size(items) - n, F.lit(0)).alias("rest"))


def error_list(batch: DataFrame) -> DataFrame:
    """(client, error) of the rows that failed (A5)."""
    return batch.filter("status = 'error'").select(F.col("doc_id").cast("string").alias("client"), F.col("error_message").alias("error"))


def markdown(batch: DataFrame) -> DataFrame:
    """(doc_id, text): the Markdown block of each result, with the first five missing sections and three reasons."""
    line = lambda form, *c: F.format_string(form + "\n", *c)
    name = F.col("doc_id").cast("string")
    seen = preview(F.col("missing_required_sections"), 5)
    listed = F.array_join(F.transform(seen["first"], lambda m: F.concat(F.lit("  - `"), m, F.lit("`\n"))), "")
    more = F.when(seen["rest"] > 0, line("  - ... et %d autres", seen["rest"])).otherwise(F.lit(""))
    why = F.when(F.size("reasons") > 0, F.concat(F.lit("- **Reasons**:\n"), F.array_join(F.transform(F.slice("reasons", 1, 3), lambda r: F.concat(F.lit("  - "), r, F.lit("\n"))), ""))).otherwise(F.lit(""))
    done = F.concat(
        line("### ✓ %s", name), line("- **Profile**: `%s`", "profile"), line("- **Gate Status**: **%s**", "gate_status"), line("- **Coverage**: %.1f%%", F.col("required_coverage_ratio") * 100),
        line("- **Missing Required**: %d", F.size("missing_required_sections")), listed, more, line("- **Unknown Titles**: %d", "unknown_titles_count"), line("- **Placeholders**: %d", "placeholders_count"), why, F.lit("\n"),
    )
    failed = F.concat(line("### ✗ %s", name), F.lit("- **Status**: ERROR\n"), line("- **Error Type**: `%s`", "error_type"), line("- **Message**: %s", "error_message"), F.lit("\n"))
    return batch.select("doc_id", F.when(F.col("status") == "success", done).otherwise(failed).alias("text"))


def markdown_report(batch: DataFrame, timestamp: str, root: str, ruleset: str, override: str | None = None) -> DataFrame:
    """(part, client, text): the pieces of a batch's Markdown report, which follow each other by part and client: header, summary,
    results, and errors if there are any (S12)."""
    head = f"# Batch Parser Report\n**Timestamp**: {timestamp}\n**Root Directory**: `{root}`\n**Ruleset**: `{ruleset}`\n" + (f"**Profile Override**: {override}\n" if override else "") + "\n---\n"
    names = (("Total Processed", "total"), ("Successful", "successful"), ("Errors", "errors"), ("Production Gate GO", "go"), ("Production Gate NO-GO", "no_go"))
    totals = F.concat(F.lit("## Summary\n"), *[F.format_string(f"- **{n}**: %d\n", c) for n, c in names], F.format_string("- **Average Coverage**: %.1f%%\n\n---\n", F.col("mean_coverage") * 100))
    summary = batch_summary(batch)
    piece = lambda df, part, client, text: df.select(F.lit(part).alias("part"), client.alias("client"), text.alias("text"))
    none = F.lit("")
    errors = error_list(batch)
    out = piece(summary, 1, none, F.lit(head)).unionByName(piece(summary, 2, none, totals)).unionByName(piece(summary, 3, none, F.lit("## Detailed Results\n")))
    out = out.unionByName(piece(markdown(batch), 4, F.col("doc_id").cast("string"), F.col("text"))).unionByName(piece(summary.filter("errors > 0"), 5, none, F.lit("---\n## Errors\n")))
    return out.unionByName(piece(errors, 6, F.col("client"), F.format_string("- **%s**: %s\n", "client", "error")))


def documents_out(reported: DataFrame) -> DataFrame:
    """(doc_id, normalized, report): the normalised document as a map from path to text, and its report."""
    return reported.select("doc_id", F.map_from_arrays(F.transform("leaves", lambda p: p["path"]), F.transform("leaves", lambda p: p["text"])).alias("normalized"), F.struct("found", "missing_required", "coverage", "required_coverage", "weighted_coverage", "unknown_titles", "placeholders", "warnings", "profile", "status", "reasons").alias("report"))


RESULTS_PER_FILE = 10_000


def batch_files(reported: DataFrame, batch: DataFrame, names: DataFrame, run: dict[str, str | None], per_file: int = RESULTS_PER_FILE) -> DataFrame:
    """(name, content) of a batch's files, for sources.named.write_named (S10): <folder>/normalized.json and report.json of each document,
    batch_report.json with the run and its totals, and its results and errors as JSON lines, about per_file in each of
    batch_report/results_<n>.jsonl and errors_<n>.jsonl, since a list of all grows with the batch.

    names: doc_id, folder. run: timestamp, root_dir, ruleset_path, gate_profile_override.
    """
    docs = documents_out(reported).join(names, "doc_id")
    one = lambda name, value: docs.select(F.concat("folder", F.lit(f"/{name}.json")).alias("name"), F.to_json(value).alias("content"))
    summary = batch_summary(batch).select(*[F.lit(v).cast("string").alias(k) for k, v in run.items()], F.col("total").alias("discovered_count"), F.struct("*").alias("summary"))
    whole = summary.select(F.lit("batch_report.json").alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("content"))

    def parts(rows: DataFrame, kind: str) -> DataFrame:
        n = max(1, -(-rows.count() // per_file))
        lines = rows.select(F.pmod(F.xxhash64(rows.columns[0]), F.lit(n)).alias("part"), F.to_json(F.struct("*")).alias("line"))
        return lines.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("content")).select(F.format_string(f"batch_report/{kind}_%d.jsonl", "part").alias("name"), "content")

    results = batch.join(names, "doc_id", "left").select("folder", *[c for c in batch.columns if c != "doc_id"])
    return one("normalized", F.col("normalized")).unionByName(one("report", F.col("report"))).unionByName(whole).unionByName(parts(results, "results")).unionByName(parts(error_list(batch), "errors"))
