"""Noise in text from scanned pages: parted words, misread characters, running headers and page numbers.

Pass one reads every record line by line, sets page furniture aside, joins words parted at line ends
and counts the words of all running text. Spellings seen three times or more form the vocabulary. Every
spelling is looked up once: a weighted Levenshtein automaton (one insertion, deletion or substitution of
any letter, and the visual confusions of scanners) is intersected with the vocabulary trie, which gives
all candidates; they are ranked by edit cost, frequency and, where several remain, by the words that stand
before them in the corpus. The trie is sharded, and the look-ups are spread over tasks: no vocabulary
travels to the driver or with the tasks. Pass two emits the repairs of every record; which spellings have
a candidate it learns from a bitmap of fixed size, whose chance hits a join takes out again. ``reflowed``
applies the repairs and gives continuous paragraphs.

Defined results: null, empty and blank texts have no repairs and no paragraphs; rows that repeat whole
count once; a compound parted at its own hyphen keeps it; a cut-off last word is no misreading.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread, stored

HYPHENS = "-‐¬­"
_EDGE = ".,;:?!()[]{}\"“”„«»'‘’…*"
_NUM = r"[\dlIoOSB|]{0,3}\d[\dlIoOSB|]{0,3}|[lI|]"
_PAGE_NUMBER = re.compile(rf"^\W*(?:[Pp][a@]g[ec]\s+)?(?:{_NUM})\W*$")
_PAGE_AND_NAME = re.compile(rf"^\s*(?:{_NUM})\s*[|•·]\s*\S.*$|^\s*[A-Z].*\S\s*[|•·]\s*(?:{_NUM})\s*$")
_ET_AL = re.compile(r"^(?:(?:[a-zA-Z@]{1,3} ){0,2})?[^\W\d_a-z]\S*(?:\s[^\W\d_a-z]\S*)?\s[ec]t\s[a@][l1I]\W*$")
_VOLUME = re.compile(r"^([^\W\d_a-z].*),\s*v[o0][l1I]\W*\s*\S{1,4}$")
_PAGE_TITLE = re.compile(rf"^\s*(?:{_NUM})\s{{2,}}([^\W\d_a-z].*)$|^([^\W\d_a-z].*\S)\s{{2,}}(?:{_NUM})\s*$")
_SMALL = {"of", "and", "on", "the", "for", "in", "&", "in:", "to", "et", "de", "0f", "@nd", "f0r"}
_AL_LAST = re.compile(r"[a@][l1I]\W*$")
_GAP = re.compile(r"\s\s")
_FREQUENT = "etaoinsrlcdmup"

# What scanners read (right) for what is printed (left).
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("l", "I"), ("l", "|"), ("i", "|"), ("s", "5"), ("g", "9"), ("q", "9"), ("a", "@"),
    ("b", "6"), ("z", "2"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("v", "y"), ("o", "c"),
    ("m", "rn"), ("rn", "m"), ("cl", "d"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("in", "m"), ("ni", "m"), ("m", "in"), ("m", "nn"), ("li", "h"), ("h", "li"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("n", "ri"), ("ri", "n"), ("k", "lc"), ("b", "8"), ("s", "$"), ("e", "€"), ("t", "+"), ("nn", "m"), ("h", "ln"), ("vv", "w"), ("ii", "u"), ("d", "ci"), ("ti", "h"), ("e", "o"), ("a", "o"), ("o", "a"), ("a", "e"),
]
_BY_SEEN: dict[str, list[tuple[str, str]]] = {}
for _true, _seen in CONFUSIONS:
    _BY_SEEN.setdefault(_seen[0].lower(), []).append((_seen.lower(), _true))
_ODD = re.compile(r"[0-9@|$€ﬀ-ﬄ+]")
_LETTER = re.compile(r"[^\W\d_]")


def _title_like(text: str) -> bool:
    words = text.split()
    low = sum(len(w) > 3 and w.lower() not in _SMALL and w[0].islower() for w in words)
    return 1 <= len(words) <= 14 and low <= (len(words) >= 5)  # one may be a misread small word


def _alike(a: str, b: str) -> bool:
    """Equal but for case and misread characters (same length within two, few positions differ)."""
    a, b = a.lower(), b.lower()
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or not a:
        return False
    import difflib

    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.88


def _may_be_alike(a: str, b: str) -> bool:
    """Cheap and necessary for ``_alike``: its ratio leaves fewer than 0.12 of all characters unmatched, and a letter's surplus is unmatched."""
    if abs(len(a) - len(b)) > 2:
        return False
    a, b = a.lower(), b.lower()
    room = 0.12 * (len(a) + len(b))
    for ch in _FREQUENT:
        room -= abs(a.count(ch) - b.count(ch))
        if room < -1e-9:
            return a == b
    return True


def furniture(lines: list[str], titles: tuple[str, ...] = ()) -> list[bool]:
    """Which lines are running headers, footers or page numbers. ``titles``: known titles of the document."""
    out = []
    for l in lines:
        t = l.strip()
        f = False
        if t:
            if _PAGE_NUMBER.match(t):
                f = True
            elif ("|" in t or "•" in t or "·" in t) and _PAGE_AND_NAME.match(t):
                f = True
            elif ("et" in t or "ct" in t) and _AL_LAST.search(t) and _ET_AL.match(t):
                f = True
            elif "," in t and (m := _VOLUME.match(t)):
                f = _title_like(m[1])
            elif _GAP.search(t) and (m := _PAGE_TITLE.match(l)):
                f = _title_like(m[1] or m[2])
        out.append(f)
    body = [i for i, l in enumerate(lines) if l.strip() and not out[i]]
    known = [t for t in titles if t]
    if len(body) > 1 and not known:
        a, b = lines[body[0]].strip(), lines[body[1]].strip()
        if 12 <= len(a) <= len(b) and _may_be_alike(a, b[: len(a)]) and _alike(a, b[: len(a)]) and not b[:1].islower():
            known = [b]
        else:
            known = [a]
    for t in known:
        if len(t) < 12:
            continue
        for n, i in enumerate(body):
            l = lines[i].strip()
            if len(l) < min(20, len(t)) or not _may_be_alike(l, t[: len(l)]) or not _alike(l, t[: len(l)]):
                continue
            if n == 1 and out[body[0]] and len(lines[body[0]].strip()) + 2 < len(l) and abs(len(l) - len(t)) <= 2:
                continue  # the title itself, under a running title cut short
            if n > 0 or len(l) + 2 < len(t) or (len(body) > 1 and _alike(lines[body[1]].strip()[: len(l)], l)):
                out[i] = True
    return out


def title_of(text: str) -> str:
    """The first line of running text that opens with a capital: the title of a document's first page."""
    lines = text.split("\n")
    at, body = 0, 0
    while at < len(lines):
        # Only the first lines of running text decide about the next one: no more are read than that takes.
        while at < len(lines) and body < 6:
            body += bool(lines[at].strip())
            at += 1
        for l, f in zip(lines[:at], furniture(lines[:at])):
            if l.strip() and not f:
                return l.strip()
        body = 0
    return ""


def _core(token: str) -> str:
    return token.strip(_EDGE)


def running(text: str, titles: tuple[str, ...] = ()) -> tuple[list[bool], list[tuple[int, list[str]]]]:
    lines = text.split("\n")
    flags = furniture(lines, titles)
    return flags, [(i, l.split()) for i, (l, f) in enumerate(zip(lines, flags)) if not f and l.strip()]


def parted(run: list[tuple[int, list[str]]]) -> list[tuple[int, str, str]]:
    """Words parted at line ends, as (place in ``run``, left part, rest); their tokens are taken out of ``run``."""
    out = []
    for n in range(len(run) - 1):
        words = run[n][1]
        if not words or words[-1][-1] not in HYPHENS or len(words[-1]) < 2 or not run[n + 1][1]:
            continue
        left = words[-1][:-1].lstrip(_EDGE)
        rest = _core(run[n + 1][1][0])
        if not left or not rest or (rest[0].isupper() and left[-1].islower()):
            continue  # in the last case the page ends here: what follows opens with a title
        if not (_LETTER.match(left[-1]) or left[-1] in "0159@|") or not (_LETTER.match(rest[0]) or (_ODD.match(rest[0]) and _LETTER.search(rest))):
            continue
        out.append((n, left, rest))
    for n, _, _ in out:
        run[n][1].pop()
        run[n + 1][1].pop(0)
    return out


def _is_word(w: str) -> bool:
    return bool(_LETTER.search(w)) and "/" not in w and "." not in w and not re.fullmatch(r"v?\d[\d.]*\w?", w)


class Trie:
    """The vocabulary, and its intersection with the automaton of one word."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.root: dict = {}
        for w in counts:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node["$$"] = w

    def _walk(self, node: dict, true: str) -> dict | None:
        for ch in true:
            node = node.get(ch)
            if node is None:
                return None
        return node

    def candidates(self, word: str, most: int = 3) -> dict[str, float]:
        """Vocabulary words within ``most`` confusions, or one free edit (in words of four letters or more) and one confusion; with the least cost.

        A confusion costs 1, a free substitution 2.5, a free insertion or deletion 2.75.
        """
        out: dict[str, float] = {}
        n = len(word)
        best: dict[tuple[int, int], float] = {}
        todo = [(self.root, 0, 0.0, 0, n < 4)]
        while todo:
            node, i, cost, edits, free = todo.pop()
            if edits:  # states without an edit are met once
                state = (id(node), (i * 2 + free) * 4 + edits)
                if best.get(state, 99.0) <= cost:
                    continue
                best[state] = cost
            # An open state may yet take an edit; a closed one only follows the word.
            may_free = not free and edits < 2
            if edits >= most or (free and n >= 4 and edits >= 2):
                while i < n and node is not None:
                    node = node.get(word[i])
                    i += 1
                w = node.get("$$") if node is not None else None
                if w is not None and cost < out.get(w, 99.0):
                    out[w] = cost
                continue
            if i == n:
                w = node.get("$$")
                if w is not None and cost < out.get(w, 99.0):
                    out[w] = cost
            else:
                ch = word[i]
                nxt = node.get(ch)
                if nxt is not None:
                    todo.append((nxt, i + 1, cost, edits, free))
                for seen, true in _BY_SEEN.get(ch, ()):
                    if word.startswith(seen, i):
                        to = self._walk(node, true)
                        if to is not None:
                            todo.append((to, i + len(seen), cost + 1.0, edits + 1, free))
                if may_free:
                    todo.append((node, i + 1, cost + 2.75, edits + 1, True))  # a letter too many
                    for other, to in node.items():
                        if other != "$$" and other != ch:
                            todo.append((to, i + 1, cost + 2.5, edits + 1, True))
            if may_free:
                for other, to in node.items():
                    if other != "$$":
                        todo.append((to, i, cost + 2.75, edits + 1, True))  # a letter lost
        out.pop(word, None)
        return out


def choose(word: str, count: int, trie: Trie) -> list[tuple[str, float]]:
    """All right words a spelling may stand for, best first without context; empty if it stands for itself.

    The more an edit costs, the more frequent than the spelling a right word must be. What only adds or drops
    a letter at the end is an inflection, not a misreading.
    """
    odd = bool(_ODD.search(word))
    if len(word) < 3:
        return []
    found = []
    for c, cost in trie.candidates(word).items():
        n = trie.counts[c]
        shifted = cost % 1 == 0.75
        need = 2 if odd and cost == int(cost) else 25 if cost <= 2 else 60
        if cost != int(cost) and odd:
            need = 400
        elif cost == 2.5 and len(word) < 6 or shifted:
            need = 400
        if n < need * count or len(c) < 3:
            continue
        if shifted and (cost > 2.75 or word.startswith(c) or c.startswith(word) or c[:-1] == word[:-1] or word[: min(len(c), len(word)) - 1] == c[: min(len(c), len(word)) - 1]):
            continue
        found.append((c, math.log(n) - 3.0 * cost))
    found.sort(key=lambda x: (-x[1], x[0]))
    return found


def _with_case(right: str, seen: str, opens: bool, upper_share: float) -> str:
    letters = [ch for ch in seen if ch.isalpha()]
    if len(letters) > 2 and all(ch.isupper() for ch in letters):
        return right.upper()
    first = seen[:1]
    if first.isupper() or (not first.isalpha() and (opens or upper_share > 0.5)):
        return right[:1].upper() + right[1:]
    return right


_COUNTS = "word string, n long, upper long"


def word_counts(records: DataFrame) -> DataFrame:
    """word, n, upper: words of all running text; counted per batch before the shuffle. What parted words may be comes with n = 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw: Counter = Counter()
            n: Counter = Counter()
            up: Counter = Counter()
            for text, title in zip(b["text"], b["title"]):
                if text:
                    lines = running(text, (title,) if title else ())[1]
                    for _, left, rest in parted(lines):
                        n[(left + rest).lower()] += 0
                        n[f"{left}-{rest}".lower()] += 0
                    for _, words in lines:
                        raw.update(words)
            for w, c in raw.items():
                core = _core(w)
                if core and _is_word(core):
                    n[core.lower()] += c
                    if core[0].isupper():
                        up[core.lower()] += c
            words = list(n)
            if words:  # a frame without rows has no types
                yield pd.DataFrame({"word": words, "n": [n[w] for w in words], "upper": [up[w] for w in words]})

    return records.mapInPandas(run, _COUNTS).groupBy("word").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"))


LEAST_SEEN = 3  # spellings seen less often are no right words
SHARD_WORDS, PART_WORDS = 60_000, 20_000  # words of a trie, look-ups of a task
BITS = 26  # the bitmap has so many address bits: 8 MB


def look_up(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, right_word, score of every spelling (word, n) that may stand for a word of ``vocabulary`` (word, n).

    Each shard of the vocabulary meets each part of the spellings in a task of its own.
    """
    shards = max(1, math.ceil(vocabulary.count() / SHARD_WORDS))
    asked = words.where(F.length("word") >= 3)
    parts = max(words.sparkSession.sparkContext.defaultParallelism, math.ceil(asked.count() / PART_WORDS))
    place = lambda n: F.pmod(F.xxhash64("word"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("word", F.greatest("n", F.lit(1)).alias("n"), place(parts).alias("part"), every(shards).alias("shard")).repartition(shards * parts, "part", "shard")
    right = vocabulary.select("word", "n", place(shards).alias("shard"), every(parts).alias("part")).repartition(shards * parts, "part", "shard")

    def meet(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(dict(zip(known["word"], known["n"].tolist())))
        rows = [(w, r, s) for w, n in zip(asked["word"], asked["n"].tolist()) for r, s in choose(w, n, trie)]
        return pd.DataFrame(rows, columns=["word", "right_word", "score"])

    return left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInPandas(meet, "word string, right_word string, score double")


def bitmap(words: DataFrame, word: str) -> bytes:
    """Which hashes occur; of one size whatever the number of words."""
    slot = F.pmod(F.crc32(F.col(word).cast("binary")), F.lit(1 << BITS))
    got = words.select(slot.alias("s")).groupBy(F.shiftright("s", 5).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toPandas()  # at most 2 ** (BITS - 5) rows
    out = np.zeros(1 << (BITS - 5), "<u4")
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype("<u4")
    return out.tobytes()


def _has(bits: bytes, word: str) -> bool:
    s = zlib.crc32(word.encode("utf-8", "replace")) % (1 << BITS)
    return bool(bits[s >> 3] >> (s & 7) & 1)


def whole_words(breaks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``breaks`` (found = left + rest) with found and word set to the whole word: with its hyphen where that is the more usual form."""
    both = [F.concat("left_part", "rest"), F.concat_ws("-", "left_part", "rest"), F.col("left_part"), F.col("rest")]
    names = ["joined", "compound", "l", "r"]
    rows = breaks.select("*", *[F.lower(c).alias(n) for c, n in zip(both, names)])
    known = stored(rows.select(F.explode(F.array(*names)).alias("word")).distinct().join(vocabulary.select("word", "n"), "word"))
    for n in names:
        rows = rows.join(known.select(F.col("word").alias(n), F.col("n").alias(f"n_{n}")), n, "left")
    seen = lambda n: F.coalesce(f"n_{n}", F.lit(0))
    hyphen = (seen("compound") > seen("joined")) | ((seen("joined") == 0) & (F.least(seen("l"), seen("r")) > 0) & (F.length("left_part") > 3) & (F.length("rest") > 3))
    return rows.withColumn("found", F.when(hyphen, both[1]).otherwise(both[0])).withColumn("word", F.lower("found")).drop(*names, *[f"n_{n}" for n in names])


def with_titles(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """tbl, record_key, text, title: the title on a document's first page tells the running titles of its chunks."""

    @F.pandas_udf("string")
    def title(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: title_of(t) if t else "")

    title = title.asNondeterministic()  # one evaluation
    titles = stored(spread(docs.where("length(content) > 0").select("id", "content")).select("id", title("content").alias("title")).where("length(title) >= 12").groupBy("id").agg(F.min("title").alias("title")))
    a = docs.select(F.lit("paper_documents").alias("tbl"), F.col("id").alias("record_key"), F.col("content").alias("text"), F.lit(None).cast("string").alias("title"))
    b = chunks.select(F.lit("document_chunks").alias("tbl"), F.col("id").alias("record_key"), F.col("text"), F.col("document_id")).join(titles.withColumnRenamed("id", "document_id"), "document_id", "left").select("tbl", "record_key", "text", "title")
    return a.unionByName(b).where("length(text) > 0")


_RAW = "tbl string, record_key string, item_kind string, line_no long, found string, word string, prev string, opens boolean, left_part string, rest string, n long"


def repairs(records: DataFrame) -> DataFrame:
    """tbl, record_key, item_kind, line_no, found, repaired; ``records`` as from ``with_titles``."""
    records = spread(records)
    spark = records.sparkSession
    counted = stored(word_counts(records))
    vocabulary = counted.where(F.col("n") >= LEAST_SEEN).where(~F.col("word").rlike(r"[0-9@|$€ﬀ-ﬄ]"))
    looked = stored(look_up(counted, vocabulary))
    # A spelling that stands for another word is no right word itself.
    fixes = stored(looked.join(looked.select(F.col("word").alias("right_word")).distinct(), "right_word", "left_anti").select("word", "right_word", "score"))
    several = fixes.groupBy("word").agg(F.count("*").alias("c")).where("c > 1")
    fixable, rivals = (spark.sparkContext.broadcast(x) for x in (bitmap(fixes, "word"), bitmap(fixes.join(several, "word", "left_semi"), "right_word")))  # 8 MB each

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sound: set[str] = set()  # tokens as written that need no second look
        has_fix, is_rival = fixable.value, rivals.value
        for b in batches:
            out: list[tuple] = []
            pairs: Counter = Counter()
            if len(sound) > 1_000_000:
                sound.clear()
            for tbl, key, text, title in zip(b["tbl"], b["record_key"], b["text"], b["title"]):
                flags, run = running(text, (title,) if title else ())
                out += [(tbl, key, "furniture", i + 1, "", "", "", False, "", "", 1) for i, f in enumerate(flags) if f]
                before = {n: (run[n][1][-2] if len(run[n][1]) > 1 else "") for n in range(len(run))}
                for n, left, rest in parted(run):
                    out.append((tbl, key, "break", run[n][0] + 1, "", "", _core(before[n]).lower(), before[n][-1:] in ".!?:", left, rest, 1))
                prev_line = ""
                for n, (i, words) in enumerate(run):
                    for k, w in enumerate(words):
                        if w in sound:
                            continue
                        # A title cut at its end and the rest of a word at the start of a chunk are no misreadings.
                        if n == 0 and not _ODD.search(w):
                            follows = run[1][1][0][:1] if len(run) > 1 and run[1][1] else ""
                            if k == len(words) - 1 and w[-1].isalpha() and words[0][0].isupper() and not follows.islower() or k == 0 and w[0].islower() and len(w) <= 5:
                                continue
                        core = _core(w)
                        low = core.lower()
                        if not core or not _is_word(core):
                            sound.add(w)
                            continue
                        prev = words[k - 1] if k else prev_line
                        rival = _has(is_rival, low)
                        if rival:
                            pairs[_core(prev).lower(), low] += 1
                        if _has(has_fix, low):
                            out.append((tbl, key, "glyph", i + 1, core, low, _core(prev).lower(), not prev or prev[-1] in ".!?:" or prev[-2:] in ('."', '?"', '!"'), "", "", 1))
                        elif not rival:
                            sound.add(w)
                    prev_line = words[-1] if words else prev_line
            out += [(None, None, "pair", None, None, w, p, False, None, None, c) for (p, w), c in pairs.items()]
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _RAW.split(", ")]).astype({"line_no": "Int64"})

    raw = stored(records.mapInPandas(items, _RAW))
    breaks = stored(whole_words(raw.where("item_kind = 'break'"), vocabulary))
    words = breaks.unionByName(raw.where("item_kind = 'glyph'"))

    # Context: where a spelling has several candidates, the one seen after the same word elsewhere comes first.
    doubtful = words.join(several, "word", "left_semi").select("word", "prev").distinct().join(fixes, "word")
    pairs = raw.where("item_kind = 'pair'").groupBy("prev", F.col("word").alias("right_word")).agg(F.sum("n").alias("seen"))
    ranked = doubtful.join(pairs, ["prev", "right_word"], "left").withColumn("r", F.row_number().over(Window.partitionBy("word", "prev").orderBy((F.col("score") + F.log1p(F.coalesce("seen", F.lit(0)))).desc(), "right_word")))
    by_context = ranked.where("r = 1").select("word", "prev", F.col("right_word").alias("by_context"))
    by_word = fixes.groupBy("word").agg(F.max_by("right_word", F.struct("score", "right_word")).alias("by_word"))

    @F.pandas_udf("string")
    def cased(right: pd.Series, seen: pd.Series, opens: pd.Series, upper: pd.Series) -> pd.Series:
        return pd.Series([_with_case(r, s, bool(o), u) if r else r for r, s, o, u in zip(right, seen, opens, upper)], dtype=object)

    fixed = words.join(by_word, "word", "left").join(by_context, ["word", "prev"], "left").withColumn("right_word", F.coalesce("by_context", "by_word")).where((F.col("item_kind") != "glyph") | F.col("right_word").isNotNull())
    shares = counted.where("upper > 0").select(F.col("word").alias("right_word"), (F.col("upper") / F.col("n")).alias("upper_share"))
    fixed = fixed.join(shares, "right_word", "left")
    repaired = F.when(F.col("right_word").isNotNull(), cased("right_word", "found", "opens", F.coalesce("upper_share", F.lit(0.0)))).otherwise(F.col("found"))
    furniture_rows = raw.where("item_kind = 'furniture'").select("tbl", "record_key", "item_kind", "line_no", F.lit("").alias("found"), F.lit("").alias("repaired"))
    return fixed.select("tbl", "record_key", "item_kind", "line_no", "found", repaired.alias("repaired")).unionByName(furniture_rows)


# ---- reflow ----
_STOPS = ".!?:"
_ORDINAL = re.compile(r"\d+(?:\.\d+)*\.?$")


def _lead(token: str) -> str:
    return token[: len(token) - len(token.lstrip(_EDGE))]


def _tail(token: str) -> str:
    return token[len(token.rstrip(_EDGE)) :]


def reflow(text: str, items: list[tuple[str, int, str, str]]) -> list[str]:
    """The paragraphs of a record with its repairs (item_kind, line_no, found, repaired) applied.

    Furniture is left out and parts no paragraph. A paragraph ends at a blank line after a whole sentence, and
    before and after a heading: a short line, with or without a number, that opens with a capital and has no stop.
    """
    gone = {n for k, n, _, _ in items if k == "furniture"}
    joined = {n: r for k, n, _, r in items if k == "break"}
    right: dict[tuple[int, str], str] = {(n, f): r for k, n, f, r in items if k == "glyph"}
    lines = []
    for n, l in enumerate(text.split("\n"), 1):
        if n not in gone:
            lines.append((n, [_lead(w) + right[n, c] + _tail(w) if (n, c := _core(w)) in right else w for w in l.split()]))
    pending = None
    for n, words in lines:
        if pending is not None and words:
            at, whole = pending
            at[-1] = _lead(at[-1]) + whole + _tail(words.pop(0))
            pending = None
        if n in joined and words:
            pending = (words, joined[n])
    out: list[list[str]] = []
    now: list[str] = []
    filled = [w for _, w in lines if w]
    goes_on = {k for k, n in enumerate(n for n, w in lines if w) if n in joined}
    longest = max((sum(map(len, w)) + len(w) for w in filled), default=0)

    def heading(k: int) -> bool:
        words = filled[k][1:] if _ORDINAL.match(filled[k][0]) else filled[k]
        ahead = filled[k + 1][0][:1] if k + 1 < len(filled) else "A"
        return k not in goes_on and 1 <= len(words) <= 6 and words[0][:1].isupper() and words[-1][-1:] not in ".,;:!?-" and not ahead.islower() and sum(map(len, filled[k])) + len(filled[k]) < 0.6 * longest

    heads = [heading(k) for k in range(len(filled))]
    k, blank = -1, False
    for _, words in lines:
        if not words:
            blank = True
            continue
        k += 1
        whole = not now or now[-1].rstrip("\"'”’»)]")[-1:] in tuple(_STOPS)
        title = k == 1 and not whole and words[0][:1].isupper()  # what stands above the text
        if now and (heads[k] or heads[k - 1] or title or (blank and (whole or words[0][:1].isupper()))):
            out.append(now)
            now = []
        now += words
        blank = False
    if now:
        out.append(now)
    return [" ".join(w) for w in out]


def reflowed(records: DataFrame, found: DataFrame) -> DataFrame:
    """tbl, record_key, paragraph_no (from 1), text: the readable text of every record; ``found`` as from ``repairs``."""
    each = found.distinct().groupBy("tbl", "record_key").agg(F.sort_array(F.collect_list(F.struct("item_kind", "line_no", "found", "repaired"))).alias("items"))  # of one record
    rows = records.select("tbl", "record_key", "text").distinct().join(each, ["tbl", "record_key"], "left")

    @F.pandas_udf("array<string>")
    def paragraphs(texts: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([reflow(t, [(x["item_kind"], x["line_no"], x["found"], x["repaired"]) for x in i] if i is not None else []) if t else [] for t, i in zip(texts, items)], dtype=object)

    paragraphs = paragraphs.asNondeterministic()  # one evaluation
    return rows.select("tbl", "record_key", paragraphs("text", "items").alias("p")).select("tbl", "record_key", F.posexplode("p").alias("at", "text")).select("tbl", "record_key", (F.col("at") + 1).cast("long").alias("paragraph_no"), "text")
