"""Text cut off by field limits.

A stack automaton reads each text once and tells whether its end is complete: no quote, bracket, markup
element or escape is left open and no sign of a cut stands there. A missing terminator is judged by the
source: where texts end with one as a rule, a text without is cut; where they do not, only at a length
limit or after a word that never ends a phrase in the corpus. What the end alone cannot tell (a number,
the last item of a list, an address, a text exactly at a length limit) is decided by evidence counted over
the whole corpus and by the length baseline of the source. Only rows that need the corpus are joined with it.

Defined results: null, empty and blank texts are complete (nothing was cut); repeated rows count
once; a text that ends with a whole sentence is complete, however short.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, stored

# Signs that a writer or a system puts where it cut.
SIGNS = re.compile(r"(?:…|\.\.\.|&hellip;|\[(?:\.\.\.|…|cut|more|truncated)\]|\((?:cut|truncated|continued|cont\.?|\.\.\.|…)\)|\b[Rr]ead more|\b[Ss]ee more|\(more\))$")
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st fig figs tab tabs eq eqs sec secs vol vols no nos pp p cf vs ca approx al i.e e.g a.m p.m "
    "u.s.r u.s u.k ph.d resp ref refs ed eds viz ch app gen col lt sgt rev hon jan feb mar apr jun jul aug sept oct nov dec".split()
)
TERMINATORS = ".!?。！？।؟॥"
_CLOSERS = "\"'”’»›)]}）」』】"
_PAIR = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "』": "『", "）": "（"}
_OPEN = set(_PAIR.values())
_MARKS = re.compile(r'["()\[\]{}“”«»「」『』（）]|<[a-zA-Z/!][^<>]{0,200}(?:>|$)')
_ELEMENT = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^<>]*?(/?)>$")
_NO_END_TAG = frozenset("br hr img input meta link wbr p li td tr th dt dd option".split())  # fixed values: elements that need not be closed
USUAL_STOPS = 0.5  # share of a source's texts with a terminator from which a missing one tells
_ANY_MARK = re.compile(r'["(\[{“«「『（<]')
_LIST_LABEL = re.compile(r"(?:^|[\s,;])\w{1,3}\)")
_BROKEN = re.compile(r"(?:\\u?[0-9a-fA-F]{0,3}|&#?\w{0,8}|%[0-9A-Fa-f]?|�|[ÃÂ]|[\ud800-\udfff])$")
_NUMBER_END = re.compile(r"(?:^|[\s(])((?:\S+\s+){0,2})(\d[\d.,]*)\.$")
_NUMBER_IN = re.compile(r"(?<=[ (])\d+(?:[.,]\d+)*(?=(\.?)\s+(\S))")
_DIGITS = re.compile(r"[0-9][0-9.,]*")
_ADDRESS = re.compile(r"(?:https?://|www\.)\S*$")
_HEADS = re.compile(r"[Kk]ey ?words|[Ii]ndex terms|Subjects|Topics")
_LIST_END = re.compile(r"(?:Keywords|Key words|Index terms|Subjects|Topics)\s*[:–-]\s*([^.!?]*)$", re.I)
_BEFORE_STOP = re.compile(r"(?<![^\W\d_])([^\W\d_][\w-]*+)[.,;!?)](?!\.)")
_QUOTE_END = re.compile(r'(^|\S)\s*["“«]([^"“”«»]{1,300}[.!?])["”»]$')
_QUOTE_IN = re.compile(r'["“«]([^"“”«»]{1,300}[.!?])["”»](?=\s+(\S))')
_REMARK_END = re.compile(r"(^|\S+)\s*\([^()]*\)$")
_WORD_DOT = re.compile(r"(\S+?)\.$")


def unclosed(text: str) -> bool:
    """The stack automaton: True if a quote, bracket or tag is still open at the end."""
    stack: list[str] = []
    if not _ANY_MARK.search(text):
        return False
    for m in _MARKS.finditer(text):
        c = m[0]
        if c[0] == "<":
            e = _ELEMENT.match(c)
            if not e:
                if c[-1] != ">":
                    return True  # within a tag
            elif not e[3] and e[2].lower() not in _NO_END_TAG:
                tag = "<" + e[2].lower()
                if not e[1]:
                    stack.append(tag)
                elif tag in stack:
                    while stack.pop() != tag:
                        pass
            continue
        if c == '"':
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            else:
                stack.append('"')
        elif c in _OPEN:
            stack.append(c)
        elif stack and _PAIR[c] in stack:
            while stack.pop() != _PAIR[c]:
                pass
    return bool(stack)


def _shape(text: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", text))


def _number_key(before: str, number: str) -> str:
    """The two words before a number, and whether the number has decimals."""
    return f"N {_DIGITS.sub('0', ' '.join(before.lower().split()))} {'f' if '.' in number or ',' in number else 'i'}"


def _quote_key(before: str, inside: str) -> str:
    """What stands before a quotation (an end, a colon, a word), and its last mark."""
    kind = "end" if not before or before in TERMINATORS + _CLOSERS else "colon" if before == ":" else "word"
    return f"Q {kind} {inside[-1]}"


def judge(text: str | None) -> tuple[str, str]:
    """(verdict, key): cut, whole, or what the corpus must decide: number, list, address, quote, bare (no terminator), with its key."""
    t = (text or "").rstrip()
    if not t:
        return "whole", ""
    tail = t[-80:]  # what the end patterns look at; brackets and lists are followed through the whole text
    if SIGNS.search(tail):
        return "cut", "sign"
    if _BROKEN.search(tail):
        return "cut", "escape"
    if unclosed(t):
        return "cut", "open"
    if _HEADS.search(t) and (m := _LIST_END.search(t)):
        return "list", "E " + m[1].rpartition(",")[2].strip().rpartition(" ")[2].lower()
    if m := _ADDRESS.search(t, max(0, t.rfind(" "))):
        tail = m[0].rpartition("/")[2]
        return ("address", "A " + _shape(tail)) if re.match(r"(?:https?://|www\.)[^/\s]+/\S+", m[0]) else ("cut", "address")
    if t[-1] == ")":
        # A remark stands on its own after a whole sentence; a bracket within a sentence leaves it open.
        m = _REMARK_END.search(t)
        if m and m[1]:
            before = m[1]
            w = _WORD_DOT.match(before.lstrip("(\"'“«["))
            if before[-1] not in TERMINATORS + _CLOSERS + ":" or (w and w[1].lower() in ABBREVIATIONS):
                return "cut", "word"
    if t[-1] in '"”»' and (m := _QUOTE_END.search(t)):
        return "quote", _quote_key(m[1], m[2])
    body = t.rstrip(_CLOSERS)
    end = body[-1:] if body else ""
    if end and end in TERMINATORS:
        if end == "." and body == t:
            if m := _NUMBER_END.search(tail):
                return "number", _number_key(m[1], m[2])
            last = t.rsplit(None, 1)[-1].lstrip("(\"'“«[")
            w = _WORD_DOT.match(last)
            if w and (w[1].lower() in ABBREVIATIONS or re.fullmatch(r"[A-ZА-Я]", w[1])):
                return "cut", "abbreviation"
        return "whole", ""
    if t[-1] in ")]）】" and len(t) > 2:
        return "whole", "remark"
    if end in ",;:-" or end.isspace():
        return "cut", "word"
    return "bare", "E " + re.sub(r"^\W+|\W+$", "", t.rpartition(" ")[2]).lower()


def evidence(text: str, into: Counter, words: Counter) -> None:
    """What stands within the text, away from its end: numbers that end a sentence or do not, words (as written) that end a phrase."""
    for m in _NUMBER_IN.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()].split()[-2:]
        ends = m[1] == "." and (m[2].isupper() or m[2] in "\"“«([")
        into[_number_key(" ".join(before), m[0]), ends] += 1
    if '"' in text or "”" in text or "»" in text:
        for m in _QUOTE_IN.finditer(text):
            before = text[max(0, m.start() - 20) : m.start()].rstrip()[-1:]
            if before != '"':
                into[_quote_key(before, m[1]), not m[2].islower()] += 1
    words.update(_BEFORE_STOP.findall(text))


_STORED = "part string, tbl string, record_key string, source string, verdict string, key string, digest long, n long, yes long, no long"


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: Counter = Counter()
        verdicts = [judge(t) for t in b["text"]]
        words: Counter = Counter()
        for t in set(b["text"]):
            if t:
                evidence(t, seen, words)
        for w, n in words.items():
            seen["E " + w.lower(), True] += n
        yield pd.DataFrame({"part": "v", "tbl": b["tbl"], "record_key": b["record_key"], "source": b["source"], "verdict": [v for v, _ in verdicts], "key": [k for _, k in verdicts], "digest": [_digest(t) if v in ("cut", "bare") else 0 for t, (v, _) in zip(b["text"], verdicts)], "n": [len(t) if t else 0 for t in b["text"]], "yes": 0, "no": 0})
        shapes = Counter(k for v, k in verdicts if v == "address")
        rows = [(k, n if e else 0, 0 if e else n) for (k, e), n in seen.items()] + [(k, n, 0) for k, n in shapes.items()]
        if rows:
            ks, ys, ns = zip(*rows)
            yield pd.DataFrame({"part": "e", "tbl": None, "record_key": None, "source": None, "verdict": None, "key": ks, "digest": 0, "n": 0, "yes": ys, "no": ns})


def judged(texts: DataFrame) -> DataFrame:
    """tbl, record_key, source, text -> tbl, record_key, source, is_cut, why; one row per distinct record."""
    part = stored(spread(texts.select("tbl", "record_key", "source", "text")).mapInPandas(_read, _STORED))
    seen = part.where("part = 'e'").groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    rows = part.where("part = 'v'").select("tbl", "record_key", "source", "verdict", "key", "digest", "n").distinct()

    # Length baseline of a source: a length at which far more texts lack an end than at the lengths around it.
    rows = rows.withColumn("origin", F.coalesce("source", F.lit("")))
    near = Window.partitionBy("tbl", "origin").orderBy("n")  # a row per length
    lengths = rows.where("verdict = 'bare' or verdict = 'cut' and key in ('word', 'open')").groupBy("tbl", "origin", "n").agg(F.countDistinct("digest").alias("at"))
    limits = (
        lengths.withColumn("around", F.coalesce(F.sum("at").over(near.rangeBetween(-20, -1)), F.lit(0)) + F.coalesce(F.sum("at").over(near.rangeBetween(1, 20)), F.lit(0)))
        .where("at >= 8 and at * 40 > around * 6")
        .select("tbl", "origin", "n", F.lit(True).alias("at_limit"))
    )
    # Terminator baseline of a source: how many of its texts end with one.
    stops = rows.where("n > 0").groupBy("tbl", "origin").agg((1 - F.avg((F.col("verdict") == "bare").cast("double"))).alias("stops"))
    # A whole number where decimals are usual is a decimal cut at its point.
    decimals = seen.where("key like 'N % f'").select(F.expr("concat(substring(key, 1, length(key) - 1), 'i')").alias("key"), (F.col("yes") + F.col("no")).alias("decimals"))
    addresses = seen.where("key like 'A %'").agg(F.sum("yes").alias("n")).first().n or 0
    open_rows = rows.where("verdict not in ('cut', 'whole')")
    asked = open_rows.select("key").distinct()
    told = asked.join(seen, "key", "left").join(decimals, "key", "left")
    joined = open_rows.join(limits, ["tbl", "origin", "n"], "left").join(stops, ["tbl", "origin"], "left").join(told, "key", "left")
    yes, no, at = F.coalesce("yes", F.lit(0)), F.coalesce("no", F.lit(0)), F.coalesce("at_limit", F.lit(False))
    is_cut = (
        F.when(F.col("verdict") == "bare", (F.col("stops") >= USUAL_STOPS) | at | ((yes == 0) & F.col("key").rlike(r"^E .*\p{L}")))
        .when(F.col("verdict") == "number", (no > yes) | ((yes == 0) & at) | (yes * 20 < F.coalesce("decimals", F.lit(0))))
        .when(F.col("verdict") == "quote", no > yes)
        .when(F.col("verdict") == "list", at | (yes < 2))
        .otherwise(at | (yes * 50 < addresses))
    )
    settled = rows.where("verdict in ('cut', 'whole')").select("tbl", "record_key", "source", (F.col("verdict") == "cut").alias("is_cut"), F.when(F.col("verdict") == "cut", F.col("key")).alias("why"))
    return settled.unionByName(joined.select("tbl", "record_key", "source", is_cut.alias("is_cut"), F.when(is_cut, F.when(F.col("verdict") == "bare", "word").otherwise(F.col("verdict"))).alias("why")))


def cut_rates(judged_rows: DataFrame) -> DataFrame:
    """Per table and source: records, cut records and their share."""
    return judged_rows.groupBy("tbl", "source").agg(F.count("*").alias("records"), F.count_if("is_cut").alias("cut_records"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("share"))
