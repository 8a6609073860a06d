"""Several values packed in one field: infer the delimiter, split, explode with position.

Three passes. The first is pure SQL: per source it counts, for every candidate delimiter, in how many values
it occurs and how regular the piece counts are. The second lets every value score its candidate readings by
the regularity of their piece types and counts, per source and set of candidates, which reading wins. Where one
wins nearly always, the source decides; the third pass lets a value of such a source depart only if its own
score speaks clearly against it, and scores each value of a mixed source by itself, with the source's counts as
a prior. Group names with a delimiter of their own are learned where quotes or a strong delimiter bound them and
joined with the spans of the other values, however many there are.

Defined results: null, empty and blank values give no rows; empty places and remarks that there are
further names give no rows and take no position; extra columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The candidate delimiters, with the regular expression that splits at each.
STRONG = {
    "newline": r"[\r\n]+",
    "semicolon": r"\s*;\s*",
    "wide_semicolon": r"\s*；\s*",
    "wide_comma": r"\s*、\s*",
    "bar": r"\s*\|\s*",
    "tab": r"\t+",
    "slash": r"\s+/\s+",
    "dot": r"\s+·\s+",
}
WEAK = {"comma": ",", "and": r"\sand\s", "amp": "&"}
_STRONG_RE = {k: re.compile(v) for k, v in STRONG.items()}
_ANY_STRONG = re.compile(r"[\r\n;；、|\t]|\s[/·]\s")

# Particles of surnames, suffixes, words that mark a group of people, remarks.
PARTICLES = {"van", "von", "de", "der", "den", "la", "le", "el", "al", "di", "da", "du", "del", "della", "dos", "ten", "ter", "bin", "ibn", "af", "av", "zu", "zum"}
ORG_WORDS = (
    "Station Stations Institute Institutes Team Consortium Collaboration Group Network Survey Centre Center "
    "Laboratory Laboratories Lab Labs University Department Council Society Association Committee Agency "
    "Academy Office Ministry School Faculty Foundation Union Initiative Project Alliance Observatory Panel Board"
).split()
_ORG = re.compile(r"\b(?:" + "|".join(ORG_WORDS) + r")\b")
_ORG_OF = re.compile(
    r"\b(?:Institute|Department|Centre|Center|School|Faculty|Society|Laboratory|Office|Ministry|Academy|Council|Association|Agency|Committee|Board|Panel)"
    r" (?:of|for|on)(?: the)? [^\W\d_][\w'’-]*(?: [A-Z][\w'’-]*)*(?:, [A-Z][\w'’-]*(?: [A-Z][\w'’-]*)*)*,?(?: (?:and|&) [A-Z][\w'’-]*)"
)
_ORG_AMP = re.compile(r"(?:^|(?<=[,;&] )|(?<=\band )|(?<=,))([A-Z][\w'’-]* & [A-Z][\w'’-]*(?: [A-Z][\w'’-]*)* (?:" + "|".join(ORG_WORDS) + r"))\b")
_SUFFIX = re.compile(r",\s*((?:Jr|Sr)\.?|I{2,3}|Ph\.?D\.?)(?=\s*(?:$|[,;&|/·\r\n\t；、'\"\]]|and\b|et al))")
_REMARK_TAIL = re.compile(r"[\s,;]*(?:\b(?:and|&)\s+)?\(?\b(?:et\s+al\b\.?|others\b\.?|(?:\d+\s+)?more\b(?:\s+authors)?\.?)\)?[\s,;.]*$|[\s,;]*(?:…|\.\.\.)$", re.I)
_REMARK = re.compile(r"^(?:and\s+|&\s*)?(?:\(?(?:et\.?\s+al|others|u\.\s?a|(?:\+?\d+\s+)?more(?:\s+authors)?)\.?\)?|…|\.\.\.|\[?\.\.\.\]?)$", re.I)
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?(?:[\s-]?[^\W\d_]\.)*|[^\W\d_]\.?|[A-Z]{1,3}|(?:[A-Z]\.?[\s-]?){1,3})$")
_TRIM = " \t\r\n\xa0　\"'“”„«»,;；、|"
_COMMA, _AND, _AMP = "", "", ""  # stand for delimiters that belong to a name
_UNMASK = str.maketrans({_COMMA: ",", _AMP: "&"})
_LEAD_CONJ = re.compile(r"^(?:and\s+|&\s*)")
_CONJ = re.compile(r"\s+and\s+|\s*&\s*")
_COMMA_OR_CONJ = re.compile(r",|\s+and\s+|\s*&\s*")
_ANY_WEAK = re.compile(r",|&|\sand\s")
_WITHIN_GROUP = re.compile(r"[,&]|\sand\s")
_SEVERAL = re.compile(r"\sand\s|&|[;|]")
_STRONG_MARKS = {"newline": "\r\n", "semicolon": ";", "wide_semicolon": "；", "wide_comma": "、", "bar": "|", "tab": "\t", "slash": "/", "dot": "·"}  # a candidate needs one of them
_AFTER_REMARK = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + ",;.)"
_REMARK_ENDS = ("al", "others", "more", "authors")


def _mask(text: str) -> str:
    return text.replace(",", _COMMA).replace(" and ", f" {_AND} ").replace("&", _AMP)


def _unmask(text: str) -> str:
    return text if text.isascii() else text.translate(_UNMASK).replace(_AND, "and")


def _bare(piece: str) -> str:
    """Without separators, quotes and white space of any kind around it."""
    while (p := piece.strip().strip(_TRIM)) != piece:
        piece = p
    return piece


def _quoted(text: str) -> list[str]:
    """Items between quotes, of a list literal or a quoted row; a quote closes only before , ; ] or the end."""
    out, i, n = [], 0, len(text)
    while i < n:
        q = text[i]
        if q not in "\"'":
            i += 1
            continue
        j = i + 1
        while j < n and not (text[j] == q and re.match(r"\s*(?:[,;|\]]|$)", text[j + 1 :])):
            j += 1
        out.append(text[i + 1 : j])
        i = j + 1
    return out


def _surname(piece: str) -> bool:
    words = piece.split()
    while words and words[0].lower() in PARTICLES:
        words = words[1:]
    return 1 <= len(words) <= 2 and not any("." in w for w in words) and not (len(words) == 2 and _INITIALS.match(words[1]) and len(words[1]) <= 2 and words[1].isupper())


def _given(piece: str) -> bool:
    words = piece.split()
    if not words:
        return False
    if _INITIALS.match(piece.strip()):
        return True
    head = 1
    return all(_INITIALS.match(w) for w in words[head:]) and not _INITIALS.match(words[0]) or len(words) == 1


@lru_cache(1 << 16)
def piece_type(piece: str) -> str:
    """full: given and family name in either order; inverted: family, given; group; mono; other."""
    p = piece.strip()
    if _ORG.search(p):
        return "group" if not _WITHIN_GROUP.search(p) else "other"
    if "," in p:
        a, _, b = p.partition(",")
        single = len([w for w in a.split() if w.lower() not in PARTICLES]) == 1
        return "inverted" if "," not in b and " and " not in b and _surname(a) and _given(b) and (single or len(b.split()) == 1 or bool(_INITIALS.match(b.strip()))) else "other"
    if _SEVERAL.search(p):
        return "other"
    words = p.split()
    if not words or _INITIALS.match(p):
        return "other"
    return "full" if len(words) > 1 and words[0].lower() not in PARTICLES or len(words) > 2 else "full" if len(words) == 2 and (_INITIALS.match(words[1]) is not None) else "mono"


_WEIGHT = {"full": 1.0, "inverted": 1.0, "group": 1.0, "mono": 0.35, "other": 0.0}


def _weak_readings(text: str) -> dict[str, list[str]]:
    """The ways to read a value without a strong delimiter."""
    comma = [_LEAD_CONJ.sub("", x.strip()) for x in text.split(",")]
    out = {"single": [text]}
    if "," in text:
        out["comma"] = [y for x in comma for y in _CONJ.split(x)]
        flat = [x for x in (y for x in _COMMA_OR_CONJ.split(text) for y in [x.strip()]) if x]
        if len(flat) % 2 == 0:
            out["comma_pairs"] = [f"{a}, {b}" for a, b in zip(flat[::2], flat[1::2])]
    if _CONJ.search(text):
        out["and"] = [x.strip(" ,") for x in _CONJ.split(text)]
    return out


CLEARLY = 0.15  # by how much a value's own score must be higher to depart from its source


def _remark_may_end(text: str) -> bool:
    """Whether the text ends as a value does to which a remark of further names is added."""
    return text.endswith(("…", "...")) or text.rstrip(_AFTER_REMARK)[-8:].casefold().endswith(_REMARK_ENDS)


def _prepared(value: str | None, spans: list[str] | None = None) -> tuple[list[str] | None, str, dict[str, list[str]]]:
    """(pieces that need no choice, else None; the text with masked names; its readings)."""
    text = (value or "").strip()
    if not text:
        return [], "", {}
    if text[0] == "[" and re.match(r"\[\s*[\"'\]]", text):
        return _quoted(text[1:]), text, {}
    if text[0] == '"' and text.count('"') > 1:
        return _quoted(text), text, {}
    # Most values hold nothing that these patterns need.
    if _remark_may_end(text):
        text = _REMARK_TAIL.sub("", text)
    if "Jr" in text or "Sr" in text or "II" in text or "Ph" in text:
        text = _SUFFIX.sub(lambda m: f"{_COMMA} {m[1]}", text)
    for g in spans or ():
        text = text.replace(g, _mask(g))
    if " of " in text or " for " in text or " on " in text:
        text = _ORG_OF.sub(lambda m: _mask(m[0]), text)
    if " & " in text:
        text = _ORG_AMP.sub(lambda m: _mask(m[0]), text)
    bare = text.strip(_TRIM)
    if _ANY_STRONG.search(bare):
        readings = {k: r.split(text) for k, r in _STRONG_RE.items() if any(c in bare for c in _STRONG_MARKS[k]) and r.search(bare)}
    else:
        body = text.strip(" ,\t")
        readings = _weak_readings(body) if _ANY_WEAK.search(body) else {"single": [body]}
    if len(readings) == 1:
        (name, pieces), *_ = readings.items()
        return pieces, text, {}
    return None, text, readings


def _scores(readings: dict[str, list[str]], prior: dict[str, float]) -> dict[str, float]:
    """How regular the piece types of each reading are; the prior only settles what is nearly equal."""
    out = {}
    for name, pieces in readings.items():
        kinds = [piece_type(p.strip(_TRIM)) for p in pieces if p.strip(_TRIM)]
        out[name] = sum(_WEIGHT[k] for k in kinds) / len(kinds) - 0.05 * (len(set(kinds) - {"group"}) > 1) + 0.02 * prior.get(name.split("_")[0], 0.0) - 0.001 * (name == "comma_pairs") if kinds else -1.0
    return out


def split_value(value: str | None, prior: dict[str, float] | None = None, spans: list[str] | None = None, decided: dict[str, str] | None = None) -> list[str]:
    """The values of one field, in order.

    ``prior``: of the source, by delimiter; ``decided``: of the source, the reading by set of candidates; ``spans``: group names in it.
    """
    pieces, text, readings = _prepared(value, spans)
    if pieces is None:
        scores = _scores(readings, prior or {})
        best = max(scores, key=scores.get)
        of_source = (decided or {}).get(" ".join(sorted(readings)))
        if of_source is not None and scores[best] - scores[of_source] < CLEARLY:
            best = of_source
        pieces = readings[best]
        if best == "comma_pairs":
            pieces = _as_written(text, pieces)
    out = []
    for p in pieces:
        p = _unmask(_bare(p))
        p = _REMARK_TAIL.sub("", _LEAD_CONJ.sub("", p)).strip(_TRIM) if ("al" in p or "other" in p or "more" in p or "…" in p or ".." in p or p[:4] == "and " or p[:1] == "&") else p
        p = _bare(p)
        if p and not _REMARK.match(p):
            out.append(p)
    return out


def _as_written(text: str, pairs: list[str]) -> list[str]:
    """The inverted names as they stand in the text (its own spacing after the comma)."""
    out, at = [], 0
    for pair in pairs:
        a, _, b = pair.partition(", ")
        i = text.find(a, at)
        j = text.find(b, i + len(a))
        out.append(text[i : j + len(b)])
        at = j + len(b)
    return out


def delimiter_profile(df: DataFrame, value: str, source: str) -> DataFrame:
    """Per source and candidate: share of values that hold it, mean and spread of the piece counts.

    One aggregation with map-side combine and a column for each candidate; its result has sources x candidates rows.
    """
    cands = {**STRONG, **WEAK}
    v = F.col(value)
    counted = df.where(F.length(F.trim(v)) > 0).select(F.coalesce(F.col(source), F.lit("")).alias("source"), *[F.size(F.split(v, p)).alias(k) for k, p in cands.items()])
    held = lambda k: F.when(F.col(k) > 1, F.col(k))
    wide = counted.groupBy("source").agg(F.count("*").alias("n_values"), *[x for k in cands for x in (F.count(held(k)).alias(f"{k}_n"), F.avg(held(k)).alias(f"{k}_m"), F.stddev_pop(held(k)).alias(f"{k}_s"))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("delimiter"), F.col(f"{k}_n").alias("n_with"), F.col(f"{k}_m").alias("mean_pieces"), F.col(f"{k}_s").alias("sd_pieces")) for k in cands]))
    return wide.select("source", "n_values", each.alias("c")).select("source", "c.delimiter", "n_values", "c.n_with", "c.mean_pieces", "c.sd_pieces")


def priors(profile: DataFrame) -> dict[str, dict[str, float]]:
    """log share, less the relative spread of the piece counts: rows are sources x 11 candidates."""
    out: dict[str, dict[str, float]] = {}
    for r in profile.collect():
        share = (r.n_with + 0.5) / (r.n_values + 1)
        out.setdefault(r.source, {})[r.delimiter] = math.log(share) - (r.sd_pieces or 0) / (r.mean_pieces or 1)
    return out


DECIDES, ENOUGH = 0.95, 30  # share of a source's values that one reading must win, and least number of values


def source_decisions(df: DataFrame, value: str, source: str, prior: dict[str, dict[str, float]]) -> dict[str, dict[str, str]]:
    """Per source and set of candidate readings: the reading that wins in nearly all values, where there is one.

    Counted per batch and then summed; rows are sources x sets of candidates x readings.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            won: Counter = Counter()
            for v, s in zip(b["v"], b["s"]):
                pieces, _, readings = _prepared(v)
                if pieces is None:
                    scores = _scores(readings, prior.get(s, {}))
                    won[s, " ".join(sorted(readings)), max(scores, key=scores.get)] += 1
            if won:
                yield pd.DataFrame([(*k, n) for k, n in won.items()], columns=["source", "candidates", "reading", "n"])

    rows = df.where(F.length(F.trim(value)) > 0).select(F.col(value).alias("v"), F.coalesce(F.col(source), F.lit("")).alias("s")).mapInPandas(run, "source string, candidates string, reading string, n long")
    total = rows.groupBy("source", "candidates", "reading").agg(F.sum("n").alias("n")).collect()
    of: dict[tuple[str, str], dict[str, int]] = {}
    for r in total:
        of.setdefault((r.source, r.candidates), {})[r.reading] = r.n
    out: dict[str, dict[str, str]] = {}
    for (s, c), won in of.items():
        best = max(sorted(won), key=won.get)
        if sum(won.values()) >= ENOUGH and won[best] >= DECIDES * sum(won.values()):
            out.setdefault(s, {})[c] = best
    return out


_ORG_SQL = r"\b(" + "|".join(ORG_WORDS) + r")\b"


def group_names(df: DataFrame, value: str) -> DataFrame:
    """g: group names with a delimiter of their own, learned where quotes or a strong delimiter bound them in more than one value."""
    v = F.col(value)
    bounded = F.when(v.rlike(r"^\s*\["), F.regexp_extract_all(v, F.lit(r"[\"']([^\"']*)[\"']"), F.lit(1))).otherwise(F.split(F.regexp_replace(v, r'^\s*"|"\s*$', ""), r'"?\s*[;；、|\t\r\n]+\s*"?|\s+[/·]\s+|","'))
    strong = v.rlike(r"[\r\n;；、|\t]|\s[/·]\s|^\s*[\[\"]")
    return (
        df.where(strong & v.rlike(_ORG_SQL))
        .select(F.explode(bounded).alias("g"))
        .select(F.trim("g").alias("g"))
        .where(F.col("g").rlike(r",|&|\sand\s") & F.col("g").rlike(_ORG_SQL) & ~F.col("g").rlike(r"^(and|&)\s|\bet al\b"))
        .groupBy("g").count().where("count > 1").select("g")
    )


_BOUND = re.compile(r"\s*[,;&]\s*(?:and\s+)?|\s+and\s+")


def group_spans(value: str) -> list[str]:
    """What may be a group name with a delimiter of its own: all runs of pieces, from bound to bound, that hold a group word."""
    text = _REMARK_TAIL.sub("", value.strip())
    marks = [(0, 0), *[m.span() for m in _BOUND.finditer(text)], (len(text), len(text))]
    words = [m.start() for m in _ORG.finditer(text)]
    out = []
    for i in range(len(marks) - 1):
        for j in range(i + 2, len(marks)):
            a, b = marks[i][1], marks[j][0]
            if any(a <= w < b for w in words):
                out.append(text[a:b])
    return out


def group_matches(df: DataFrame, value: str, names: DataFrame) -> DataFrame:
    """value, spans: the learned group names that stand in a value, longest first. An equi-join, whatever the number of names."""
    v = F.col(value)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def spans(values: pd.Series) -> pd.Series:
        return pd.Series([list(dict.fromkeys(group_spans(t))) for t in values], dtype=object)

    spans = spans.asNondeterministic()
    asked = df.where(v.rlike(_ORG_SQL) & v.rlike(r",|&|\sand\s") & ~v.rlike(r"^\s*[\[\"]")).select(v.alias("value")).distinct()
    each = asked.select("value", F.explode(spans("value")).alias("g"))
    met = each.join(names, "g").groupBy("value").agg(F.collect_set("g").alias("spans"))  # of one value
    return met.select("value", F.transform(F.array_sort(F.transform("spans", lambda g: F.struct((-F.length(g)).alias("l"), g.alias("g")))), lambda x: x["g"]).alias("spans"))


def split_packed(df: DataFrame, keys: list[str], value: str, source: str) -> DataFrame:
    """``keys`` + pos (from 1) + piece; one row per value named in the field."""
    prior = priors(delimiter_profile(df, value, source))
    decided = source_decisions(df, value, source, prior)
    met = group_matches(df, value, group_names(df, value))
    rows = df.select(*keys, F.col(value).alias("_value"), F.col(source).alias("_source")).join(met.withColumnRenamed("value", "_value"), "_value", "left")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, sources, spans in parts:
            memo: dict[tuple, list[str]] = {}
            out = []
            for v, s, g in zip(values, sources, spans):
                k = (v, s)
                if k not in memo:
                    memo[k] = split_value(v, prior.get(s or "", {}), list(g) if g is not None else None, decided.get(s or "", {}))
                out.append(memo[k])
            yield pd.Series(out, dtype=object)

    pieces = pieces.asNondeterministic()  # else the filter inferred for explode runs it a second time

    return rows.select(*keys, pieces("_value", "_source", "spans").alias("_pieces")).select(*keys, F.posexplode("_pieces").alias("pos0", "piece")).select(*keys, (F.col("pos0") + 1).cast("long").alias("pos"), "piece")
