"""Text functions as columns. Patterns are Unicode-aware like those they stand for: (?U) and (?iu)."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-zÀ-ÖØ-öø-ÿ0-9']+"
# French stop words dropped from queries and passages.
STOP_WORDS = (
    "le la les un une des de du d et en à a au aux pour par sur dans avec sans ce cet cette ces il elle ils elles on "
    "que qui quoi dont où se sa son ses leur leurs plus moins est sont été être avoir avait ont y ne pas comme"
).split()


# White space as it is stripped: that of Unicode, and the four separators.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalise_newlines(c: Column) -> Column:
    """CRLF and CR to LF, three or more LF to two, stripped."""
    lf = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(lf, "\n{3,}", "\n\n"))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column, drop_stop: bool = True) -> Column:
    """Lower-cased Latin words; optionally without stop words and single letters."""
    words = F.transform(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)
    return F.filter(words, lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1)) if drop_stop else words


@cache
def accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from Unicode's decompositions."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0xC0, 0x250)]
    pairs += [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in range(0x1E00, 0x1F00)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(c: Column) -> Column:
    a, b = accent_table()
    return F.regexp_replace(F.translate(c, a, b), r"\p{M}", "")


def fold(c: Column) -> Column:
    """Without accents and case."""
    return F.replace(F.lower(unaccent(c)), F.lit("ß"), F.lit("ss"))


def fold_spaces(c: Column) -> Column:
    return collapse(fold(c))


def robust(c: Column) -> Column:
    """Folded, punctuation to spaces, collapsed: the form in which titles are compared."""
    return collapse(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_\s]+", " "))


# What a ruleset's normalisation does unless it says otherwise.
NORMALIZE = {"trim": True, "collapse_whitespace": True, "strip_trailing_colon": True, "uppercase": False, "remove_nbsp": True}


def title(c: Column, switches: dict[str, bool] | None = None) -> Column:
    """A title by the switches of a ruleset, in their order; by default trimmed, one space between words, no colons at the end
    (N6). A switch that is absent is off."""
    on = (NORMALIZE if switches is None else switches).get
    t = strip(c) if on("trim") else c
    t = F.regexp_replace(t, r"(?U)\s+", " ") if on("collapse_whitespace") else t
    t = strip(F.regexp_replace(t, ":+$", "")) if on("strip_trailing_colon") else t
    t = F.upper(t) if on("uppercase") else t
    return F.replace(t, F.lit("\u00a0"), F.lit(" ")) if on("remove_nbsp") else t


def slug_words(c: Column) -> Column:
    """Folded; word characters, spaces and hyphens stay; runs of spaces and hyphens become _ (N9, first form)."""
    kept = F.regexp_replace(fold(c), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[-\s]+", "_"), "^_+|_+$", "")


def slug_client(c: Column) -> Column:
    """Folded; all but letters and digits to _; 'client' if nothing is left (N9, second form)."""
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("client")).otherwise(s)


def slug_alnum(c: Column) -> Column:
    """Letters and digits stay, all else becomes _ (N9, third form)."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")


def safe_stem(c: Column, default: str = "audio") -> Column:
    s = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(default)).otherwise(s)


def numbering(c: Column) -> Column:
    """Leading 2.1.1 of a title, null if none."""
    return F.nullif(F.regexp_extract(c, r"(?U)^\s*(\d+(?:\.\d+)*)\.?\s+", 1), F.lit(""))


def all_caps(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) > 3)


# Fixed value: an id number, 756 and ten digits with at most one separator before each.
ID_NUMBER = r"(?U)756(?:[ .\-]?\d){10}"


def id_number(c: Column) -> Column:
    """First 756 number as 756.xxxx.xxxx.xx, null if none."""
    digits = F.regexp_replace(F.regexp_extract(c, f"({ID_NUMBER})", 1), r"(?U)\D", "")
    return F.when(digits != "", F.concat_ws(".", F.substring(digits, 1, 3), F.substring(digits, 4, 4), F.substring(digits, 8, 4), F.substring(digits, 12, 2)))


def sentence_query(key: Column) -> Column:
    """A field key as a sentence: _ to space, ET to et, first letter upper, the others lower."""
    t = strip(F.replace(F.replace(key, F.lit("_"), F.lit(" ")), F.lit("ET"), F.lit("et")))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 1 << 30)))


def list_of(c: Column) -> Column:
    """Comma or newline separated values, trimmed, without empty ones (F2)."""
    return F.filter(F.transform(F.split(c, "[,\n]"), strip), lambda x: x != "")


def place_and_date(place: Column, manual: Column, auto: Column, at: Column) -> Column:
    """'City, le dd/MM/yyyy', the date alone, or the manual value."""
    day = F.date_format(at, "dd/MM/yyyy")
    p = strip(F.coalesce(place, F.lit("")))
    return F.when(~auto, strip(F.coalesce(manual, F.lit("")))).when(p != "", F.concat(p, F.lit(", le "), day)).otherwise(day)


# ---------------------------------------------------------------- answers


def split_lines(c: Column) -> Column:
    """Lines by any line boundary; the empty rest after a last one may follow."""
    return F.split(c, "\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]")


def sanitise(c: Column) -> Column:
    """Fences and zero-width spaces become spaces; a leading json and what separates it goes."""
    t = strip(F.replace(F.replace(c, F.lit("```"), F.lit(" ")), F.lit("\u200b"), F.lit(" ")))
    return strip(F.regexp_replace(t, r"(?iU)^json[:\s]+", ""))


def looks_marked_up(c: Column) -> Column:
    """Begins like JSON, or has a fence or the word json."""
    return strip(c).rlike(r"^[{\[]") | c.rlike(r"(?iuU)```|\bjson\b")


# What may not stand in an answer.
FORBIDDEN = (
    ("PLACEHOLDER", r"\{\{|\}\}"),
    ("TOKENS", r"\bXX\b|\bNAME\b|\bsurname\b"),
    ("SOURCE_REF", r"\bsource\s*\d+\b|\(\s*source\b"),
)


def forbidden_reasons(c: Column) -> Column:
    """Why a text may not be used as an answer; at most one colon may stand in a line."""
    colons = F.exists(split_lines(c), lambda line: F.regexp_count(line, F.lit(":")) > 1)
    found = [F.when(c.rlike("(?iuU)" + pattern), F.lit(reason)) for reason, pattern in FORBIDDEN]
    return F.array_compact(F.array(*found, F.when(c.contains("::") | colons, F.lit("MULTI_COLON"))))


def first_lines(c: Column, n: Column | int) -> Column:
    """The first n non-empty lines, each trimmed; all of them if n is 0."""
    lines = F.filter(F.transform(split_lines(c), strip), lambda x: x != "")
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(lines, F.lit(1), F.when(n > 0, n).otherwise(F.greatest(F.size(lines), F.lit(0)))), "\n")


def first_chars(c: Column, n: Column | int) -> Column:
    """At most n characters, all if n is 0; a cut text ends with an ellipsis."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when((n == 0) | (F.length(c) <= n), c).otherwise(F.concat(F.regexp_replace(F.substring(c, F.lit(1), n - 1), r"(?U)\s+$", ""), F.lit("…")))


def allowed_value(c: Column, allowed: Column) -> Column:
    """The allowed value equal to the text but for accents and case (the last such), null if none."""
    same = F.filter(allowed, lambda v: fold_spaces(v) == fold_spaces(c))
    return F.try_element_at(same, F.lit(-1))


def heading_key(c: Column) -> Column:
    """How answer headings are compared: lower case, no-break spaces and colons out, one space."""
    return collapse(F.regexp_replace(F.lower(F.replace(c, F.lit(" "), F.lit(" "))), ":", " "))


def bullets(c: Column) -> Column:
    """Lines that begin with '- ' begin with '• ' (N32)."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, "^- ", "• ")), "\n")


def snippet(paragraphs: Column, heading: Column, n: int = 200) -> Column:
    """The first three paragraphs joined, n characters, ... if cut; the title if there are none."""
    t = F.array_join(F.slice(paragraphs, 1, 3), " ")
    cut = F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)
    return F.when(F.size(paragraphs) == 0, heading).otherwise(cut)


def fill(template: Column, markers: Column) -> Column:
    """All markers (array of struct key, value) replaced in a text, longest first."""
    ordered = F.array_sort(F.transform(markers, lambda m: F.struct((-F.length(m["key"])).alias("n"), m["key"].alias("key"), m["value"].alias("value"))))
    return F.aggregate(ordered, template, lambda t, m: F.replace(t, m["key"], m["value"]))


def person(name: Column) -> Column:
    """(surname, first_name) of a folder name: its first word and the rest; neither of a name of one word."""
    parts = F.filter(F.split(name, r"(?U)\s+"), lambda p: p != "")
    two = F.size(parts) >= 2
    return F.struct(F.when(two, parts[0]).alias("surname"), F.when(two, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ")).alias("first_name"))


def requested_name(sentence: Column, default: str) -> Column:
    """The name in a request for a placement report: what follows the last 'de ', in any case, without spaces and punctuation
    around it; the default where no name follows, null where nothing is asked (N31)."""
    low = F.lower(sentence)
    n = F.length(F.substring_index(low, "de ", -1))
    name = F.when(low.contains("de ") & (n > 0), F.btrim(F.right(sentence, n), F.lit(" .!?\"'")))
    return F.when(low.contains("rapport") & low.contains("stage"), F.coalesce(F.nullif(name, F.lit("")), F.lit(default)))


def most_alike(a: Column, b: Column) -> Column:
    """An upper bound of the sequence ratio of two texts: the letters that they have in common, however placed."""
    count = lambda c, letter: F.length(c) - F.length(F.replace(c, letter, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    common = F.aggregate(letters, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    total = F.length(a) + F.length(b)
    short = 2 * F.least(F.length(a), F.length(b)) / total  # cheaper, and no less
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(short, 2 * common / total))
