"""Text functions as Column expressions; they stay on the JVM unless their name says otherwise."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """All runs of a-z and 0-9 in lower case, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    """Distinct tokens of three characters or more."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 2))


def content_words(text: Column) -> Column:
    return F.array_except(words(text), strings(V.STOP_WORDS))


def collection_words(text: Column) -> Column:
    return F.array_except(words(text), strings(V.COLLECTION_STOP_WORDS))


def falsy_chain(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def collapse(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def any_contains(text: Column, parts: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts]) if parts else F.lit(False)


def overlap_score(query_words: Column, title: Column, haystack: Column, in_title: int, elsewhere: int) -> Column:
    """Sum over the words found (as substrings) in the haystack, more for those in the title."""
    t, h = F.lower(title), F.lower(haystack)
    return F.aggregate(query_words, F.lit(0), lambda s, w: s + F.when(F.contains(h, w), F.when(F.contains(t, w), in_title).otherwise(elsewhere)).otherwise(0))


def sentences(text: Column, longer_than: int) -> Column:
    """Split after . ! ? before a capital or digit; trimmed pieces longer than a bound."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: F.length(s) > longer_than)


def is_boilerplate(sentence: Column) -> Column:
    return F.lower(sentence).rlike("|".join(V.BOILERPLATE))


def domain_flags(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {f"is_{d}": any_contains(low, parts) for d, parts in V.DOMAINS.items()}


def label_hit(section: Column, kind: Column, labels: dict[str, list[str]]) -> Column:
    """Whether a label of the question type is a substring of the section."""
    low = F.lower(F.coalesce(section, F.lit("")))
    out = F.lit(False)
    for k, parts in labels.items():
        out = F.when(kind == k, any_contains(low, parts)).otherwise(out)
    return out


def nul_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\x00"), F.lit("")))


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; everything else unchanged. Encoding is guarded: it raises otherwise."""
    latin = text.rlike("^[\\x{00}-\\x{FF}]+$") & text.rlike("[\\x{80}-\\x{FF}]")
    again = F.try_validate_utf8(F.encode(F.when(latin, text), "ISO-8859-1").cast("string"))
    return F.when(latin & again.isNotNull() & ~F.contains(again, F.lit("�")), again).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Null becomes empty; mojibake is repaired, NULs are removed (surrogates cannot occur in a Spark string)."""
    return F.replace(repair_mojibake(F.coalesce(text, F.lit(""))), F.lit("\x00"), F.lit(""))


def text_invalid_reason(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\x00")), F.lit("nul"))


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")


def first_title(text: Column, filename: Column) -> Column:
    """The first line of 8 to 180 characters that is no bare heading, else the file name without its ending."""
    found = F.filter(F.transform(lines(text), collapse), lambda l: F.length(l).between(8, 180) & ~F.lower(l).isin(*V.BARE_HEADINGS))
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.get(found, F.lit(0)), F.nullif(stem, F.lit("")), F.lit("Uploaded paper"))


def labelled_line(text: Column, labels: str, most: int) -> Column:
    """What follows a label (and : or -) in one of the first 35 lines."""
    pattern = rf"(?i)^(?:{labels})\s*[:\-–]\s*(.+)$"
    hits = F.filter(F.transform(F.slice(lines(text), 1, 35), collapse), lambda l: l.rlike(pattern) & F.length(F.trim(F.regexp_extract(l, pattern, 1))).between(3, most))
    return F.coalesce(F.trim(F.regexp_extract(F.get(hits, F.lit(0)), pattern, 1)), F.lit(""))


def first_authors(text: Column) -> Column:
    return labelled_line(text, V.AUTHOR_LABELS, 300)


def first_venue(text: Column) -> Column:
    return labelled_line(text, V.VENUE_LABELS, 200)


def parse_mdy(text: Column) -> Column:
    """M/D/YY to ISO; two-digit years from 69 on lie in the last century."""
    d = F.to_date(F.trim(text), "M/d/yy")
    return F.date_format(F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d), "yyyy-MM-dd")


def outer_json(text: Column) -> Column:
    """The JSON object or array within an answer: fences go, then everything outside the first and last bracket of its kind."""
    t = F.trim(text)
    t = F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)
    kind = F.regexp_extract(t, r"([{\[])", 1)
    return F.trim(F.when(kind == "{", F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")), t)).when(kind == "[", F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)(\[.*\])", 1), F.lit("")), t)).otherwise(t))


def repaired_json(text: Column) -> Column:
    """The outer JSON as it is if it parses, else without commas before closing brackets; null if neither parses."""
    j = outer_json(text)
    fixed = F.regexp_replace(j, r",\s*([\]}])", "$1")
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(ok(j), j).when(ok(fixed), fixed)


def safe_filename(name: Column) -> Column:
    """The last part of a path with everything but letters, digits and _ . - replaced; 200 characters at most."""
    clean = F.substring(F.regexp_replace(F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1), r"[^a-zA-Z0-9_.-]", "_"), 1, 200)
    return F.when(clean == "", "document.pdf").otherwise(clean)


def object_key(owner: Column, paper: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("papers"), falsy_chain(owner, F.lit("public")), paper, safe_filename(filename))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^\s*(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\s*$"), F.lit(False))


def title_case(text: Column) -> Column:
    """A capital after every non-letter, small letters after letters, which initcap does not give."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")
