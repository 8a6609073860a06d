"""Entities across sources without keys: works described by papers and by provider records.

Rows that agree in all normalised attributes form one signature. Signatures are blocked by MinHash bands
over the title's character trigrams, by the identifier and by author pair and year. Pairs of signatures get
similarity features in two views that know nothing of each other: the text (title, authors, year) and the
identifier.

A logistic classifier learns the text view from weak labels that only the identifier gives: pairs of alike
titles whose identifiers agree, or differ. Its scores are calibrated on pairs it was not fitted on (four
folds). The reverse gives the identifier's error rates: how often it agrees where the text is sure of one
work, and where it is sure of two. As those labels err at that rate, the text's probability is corrected by
it; both views together give the confidence of a pair, by Bayes' rule. Links above one half are closed to
works. Where labels are few, prior weights (``PRIOR``) and a few typical pairs (``PROTOTYPES``) outweigh them.

All pairs of signatures that share a block are scored, at any size of the block. Signatures are stored in chunks
and have numbers; a task scores the pairs of two chunks, which it reads from the shared folder. Blocks send it the
numbers of their signatures, not pairs with what they compare, so pairs exist only in its memory, a bounded number
at a time. The cost in time of a hot block still grows with the square of its size. Only what links is kept, and
meetings are scored a part of the signatures at a time, each so large that its disk follows their number.

Defined results: rows without a title match only by identifier, half as surely as their authors agree; titles
that share less than ``ALIKE`` of their words are of two works; null attributes are missing, not equal; sequels,
corrections and replies are works of their own; repeated rows count once.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.packed import PARTICLES, split_value
from ..session import discard, release, spread, stored
from .graph import components
from .nicknames import FULL as FULL_NAME
from .vectors import _uri

BANDS, ROWS_PER_BAND = 16, 8  # for the title alone: nearly equal titles
LOOSE_BANDS, LOOSE_ROWS = 8, 4  # for the title together with an author token
FIT_PAIRS = 20_000  # bound of the sample the classifier is fitted on
FIT_REPS = 32_768  # about so many signatures with an identifier at most, drawn by hash, give the pairs for it
CHUNK_REPS, FEW_CHUNKS = (25_000, 400_000), 6  # signatures of a chunk: the fewer up to so many chunks, then as many as two of which a task holds
SHIFT = 20  # bits of a signature's place in its chunk
BUCKET_ENTRIES = 400_000  # entries of block keys that are gathered together
MEETINGS = 24  # of signatures in blocks, scored at a time: so many times the signatures
FEW = 60_000  # as many signatures as fewer count as
AT_ONCE = 1_000_000  # pairs that a task lays out at a time

_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "one": 1, "two": 2, "three": 3, "four": 4}
# What may stand before or after a title and makes it another work.
_KINDS = ("correction", "corrigendum", "erratum", "errata", "addendum", "retraction", "retracted", "withdrawn", "reply", "response", "comment", "comments", "notes", "remarks")
_STRONG_KINDS = _KINDS[:8]
_TAILS = ("sequel", "followup", "continuation", "continued", "revisited", "reply", "response", "correction", "erratum", "corrigendum", "addendum")
_SAME_KIND = {"corrigendum": "correction", "erratum": "correction", "errata": "correction", "response": "reply", "comments": "comment", "retracted": "retraction", "withdrawn": "retraction"}
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,20}>|&[a-z]+;")
_WORD = re.compile(r"[^\W_]+")
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_JOINED_NAMES = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_NAME_GAP = re.compile(r"[\s,.\-]+")
_YEAR = re.compile(r"(?:19|20)\d\d")


def fold(text: str) -> str:
    """Small letters without marks."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text.casefold()).replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae").replace("œ", "oe")
    return "".join(ch for ch in t if not unicodedata.combining(ch))


def title_parts(title: str | None) -> tuple[str, str]:
    """(core words, marker): the marker tells parts, corrections and replies from the work itself."""
    t = title or ""
    t = fold(_TAG.sub(" ", t).replace("&", " and ") if "<" in t or "&" in t else t).strip(" \"'“”«»`")
    marker = ""
    words = _WORD.findall(t)
    if len(words) > 3:
        k = _kind(words[0])
        linked = words[1] in ("to", "on", "of", "for")
        if k and (linked or k in _STRONG_KINDS or re.match(rf"\W*{words[0]}\s*[:–—-]", t)):
            marker = _SAME_KIND.get(k, k)
            words = words[2 if linked else 1 :]
    if len(words) > 3 and (words[-1] in ("ii", "iii", "iv") or words[-1] in _ROMAN or words[-1].isdigit()) and near_words(words[-2], "part"):
        marker += f" part{_ROMAN.get(words[-1], words[-1])}"
        words = words[:-2]
    elif len(words) > 3 and words[-1] in ("ii", "iii", "iv"):
        marker += f" part{_ROMAN[words[-1]]}"
        words = words[:-1]
    elif len(words) > 4 and (near_words(words[-1], "sequel") or words[-2] in ("a", "the", "an") and any(near_words(words[-1], k) for k in _TAILS)):
        marker += f" {next(k for k in _TAILS if near_words(words[-1], k))}"
        words = words[: -2 if words[-2] in ("a", "the", "an") else -1]
    return " ".join(words), marker.strip()


@lru_cache(1 << 14)
def _kind(word: str) -> str:
    return next((k for k in _KINDS if near_words(word, k)), "")


def doi_of(text: str | None) -> str:
    m = _DOI.search((text or "").lower().replace("%2f", "/"))
    return m[0].rstrip(".,; )") if m else ""


def author_keys(value: str | None) -> str:
    """One word list per author, joined by ';': tokens of three letters or more, then initials in capitals."""
    return ";".join(x for x in map(_author_key, split_value(value)) if x)


@lru_cache(1 << 16)
def _author_key(name: str) -> str:
    name = _JOINED_NAMES.sub(" ", name)  # VanBuren
    words = [w for w in _NAME_GAP.split(fold(name.replace("'", "").replace("’", ""))) if w and w not in PARTICLES and w not in ("jr", "sr", "dela")]
    return " ".join([FULL_NAME.get(w, w) for w in words if len(w) > 2] + [w.upper() for w in words if len(w) <= 2])


def near_words(a: str, b: str, long_most: int = 2) -> bool:
    """Equal but for one edit (``long_most`` in words of nine letters or more), swaps of neighbours counting one."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 2 or la < 4 or lb < 4:
        return False
    if a[0] != b[0] and a[-1] != b[-1] and (la < 9 or lb < 9):
        return False  # one edit leaves one end as it is
    return _near_words(a, b, long_most)


@lru_cache(1 << 16)
def _near_words(a: str, b: str, long_most: int) -> bool:
    la, lb = len(a), len(b)
    most = long_most if la >= 9 and lb >= 9 else 1
    one, other = _letters(a), _letters(b)
    if (one & ~other).bit_count() > most or (other & ~one).bit_count() > most:
        return False  # a letter the other word lacks is an edit
    # What the two share at either end cannot hold an edit.
    i, n = 0, min(la, lb)
    while i < n and a[i] == b[i]:
        i += 1
    while la > i and lb > i and a[la - 1] == b[lb - 1]:
        la -= 1
        lb -= 1
    x, y = a[i:la], b[i:lb]
    if a.isdigit() or b.isdigit():
        return False
    if len(x) <= 1 and len(y) <= 1 or len(x) == 2 and x == y[::-1]:
        return True
    if most == 1 or len(x) > 2 * most + 4 and not (x[:1] == y[1:2] or x[1:2] == y[:1]):
        return False
    return _distance(x, y) <= most


def _distance(a: str, b: str) -> int:
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            c = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, prev2[j - 2] + 1)
            row.append(c)
        prev2, prev = prev, row
    return prev[-1]


LOOSELY = 0.45  # edits a letter up to which a word may still be the other one, badly typed


@lru_cache(1 << 17)
def _unlike(w: str, v: str) -> float:
    """Edits a letter; 1 if they are more than ``LOOSELY``. Letters without a partner are edits, which is cheap to see."""
    m = max(len(w), len(v))
    room = LOOSELY * m
    if abs(len(w) - len(v)) > room or m - (Counter(w) & Counter(v)).total() > room:
        return 1.0
    d = _distance(w, v) / m
    return d if d <= LOOSELY else 1.0


@lru_cache(1 << 16)
def _letters(w: str) -> int:
    """The set of a word's letters as bits: a letter that the other word lacks is an edit."""
    out = 0
    for ch in w:
        out |= 1 << (ord(ch) & 63)
    return out


def title_features(a: str, b: str, common: frozenset[str] | set[str] = frozenset()) -> tuple[float, float, float]:
    """(share of matched words, words replaced, words left out).

    A badly typed word still matches the right one, unless both are common words of the corpus.
    """
    if not a or not b:
        return 0.0, 0.0, 0.0
    if a == b:
        return 1.0, 0.0, 0.0
    x, y = a.split(), b.split()
    left = list(y)
    rest = []
    for w in x:
        if w in left:
            left.remove(w)
        else:
            rest.append(w)
    if rest and left and "".join(rest) == "".join(left):
        rest, left = [], []
    own, other = sum(w in common and w not in _SMALL for w in rest), sum(w in common and w not in _SMALL for w in left)
    if own >= 3 and other >= 3:  # three common words replaced by others: no misspelling explains that
        return 1 - (len(rest) + len(left)) / (len(x) + len(y)), 3.0, float(abs(len(rest) - len(left)))
    lone = []
    known = [(v, len(v), _letters(v), v in common) for v in left]
    for w in rest:
        m, k, usual = _letters(w), len(w), w in common
        near = []
        for v, o, l, c in known:
            if -3 <= k - o <= 3 and not (usual and c):
                room = LOOSELY * (k if k > o else o)
                if (m & ~l).bit_count() <= room and (l & ~m).bit_count() <= room:
                    near.append(v)
        hit = None
        if near:
            hit = next((v for v in near if near_words(w, v)), None)
            if hit is None and not w.isdigit():
                close = min(((_unlike(w, v), v) for v in near if not v.isdigit()), default=(1.0, None))
                hit = close[1] if close[0] <= LOOSELY else None
        if hit is None:
            lone.append(w)
        else:
            left.remove(hit)
            known.remove(next(x for x in known if x[0] == hit))
    n = len(x) + len(y)
    lone = [w for w in lone if w not in _SMALL]
    left = [w for w in left if w not in _SMALL]
    replaced = min(len(lone), len(left))
    if replaced == 1 and ((x[0] in lone and x[0] not in common and y[0] in x[1:3]) or (y[0] in left and y[0] not in common and x[0] in y[1:3])):
        return 1 - (len(lone) + len(left)) / n, 0.0, float(len(lone) + len(left))  # the name before the colon and another word are left out
    return (1 - (len(lone) + len(left)) / n if n else 0.0), float(replaced), float(abs(len(lone) - len(left)))


_SMALL = {"a", "an", "the", "of", "in", "on", "for", "and", "to", "with", "at", "by", "from"}
COMMON = 1e-4  # share of all title words from which a word is common: at most 1 / COMMON words


def common_words(reps: DataFrame) -> frozenset[str]:
    words = reps.select(F.explode(F.split("core", " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n").alias("t")).first().t or 0
    return frozenset(r.w for r in words.where(F.col("n") >= max(5, COMMON * total)).collect())


@lru_cache(1 << 16)
def _person(name: str) -> tuple[tuple[str, ...], int, int]:
    """The words of an author without initials; as bits, the forms that a word near one of them shares; the letters of the first two words."""
    words = tuple(w for w in name.split() if not w.isupper())
    forms = 0
    for w in words:
        # One edit or a swap leaves a form with one letter less in common, or the word itself; two edits are allowed from nine letters on.
        for f in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] if len(w) >= 4 else [w]:
            forms |= 2 << (hash(f) & 4095)
        forms |= len(w) >= 9
    return words, forms, _letters("".join(words[:2]))


@lru_cache(1 << 15)
def _people(names: str) -> tuple[tuple[tuple[str, ...], int, int], ...]:
    return tuple(map(_person, names.split(";")))


def _same_author(p: tuple[tuple[str, ...], int, int], q: tuple[tuple[str, ...], int, int]) -> float:
    x, forms_x, letters_x = p
    y, forms_y, letters_y = q
    if not forms_x & forms_y:  # no word is near any: only the names as a whole may be
        if (letters_x & ~letters_y).bit_count() > 2 or (letters_y & ~letters_x).bit_count() > 2:
            return 0.0
        return 1.0 if x and y and near_words("".join(x[:2]), "".join(y[:2])) else 0.0
    return _same_words(x, y)


@lru_cache(1 << 17)
def _same_words(x: tuple[str, ...], y: tuple[str, ...]) -> float:
    if x == y and x:
        return 1.0
    left = list(y)
    lone = []
    for w in x:
        hit = next((v for v in left if near_words(w, v)), None)
        if hit is None:
            lone.append(w)
        else:
            left.remove(hit)
    if len(x) == len(lone):
        return 1.0 if x and y and near_words("".join(x[:2]), "".join(y[:2])) else 0.0
    if not lone or not left:
        return 1.0
    return 0.6 if {w[0] for w in lone} & {w[0] for w in left} else 0.2  # one name agrees, the other does not


def author_similarity(a: str, b: str) -> float:
    """Share of the shorter list that agrees at its place (or anywhere, for less)."""
    x, y = _people(a), _people(b)
    n = min(len(x), len(y))
    at_place = sum(map(_same_author, x, y)) / n
    if at_place == 1.0:
        return 1.0
    if at_place >= 0.7:  # no agreement elsewhere counts for more
        return at_place - (0.1 if len(x) != len(y) and n == 1 else 0.0)
    anywhere = sum(max(_same_author(p, q) for q in y) for p in x) / len(x) if len(x) <= len(y) else sum(max(_same_author(p, q) for p in x) for q in y) / len(y)
    return max(at_place, 0.7 * anywhere) - (0.1 if len(x) != len(y) and n == 1 else 0.0)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_RNG = np.random.default_rng(11)
_SEEDS = _RNG.integers(2**40, 2**63 - 1, size=(2, BANDS * ROWS_PER_BAND), dtype=np.uint64) | np.uint64(1)
_WEIGHTS = _RNG.integers(2**40, 2**63 - 1, size=16, dtype=np.uint64) | np.uint64(1)


def _word_hash(w: str) -> int:
    b = w.encode("utf-8", "replace")
    return zlib.crc32(b) << 32 | zlib.crc32(b[::-1])


def _minima(cores: list[str], most: int = 20_000, at_once: int = 256) -> np.ndarray:
    """MinHash values of each text's character trigrams: the least of its words' and of the trigrams between two words, each computed once for many texts."""
    out = np.empty((len(cores), _SEEDS.shape[1]), np.uint64)
    i = 0
    while i < len(cores):
        place: dict[str, int] = {}
        of = []
        while i + len(of) < len(cores) and len(place) < most:
            c = cores[i + len(of)]
            words = c.split(" ")
            pieces = [f" {c} "] if "" in words else [f" {w} " for w in words] + [f"{v[-1]} {w[0]}" for v, w in zip(words, words[1:])]
            of.append([place.setdefault(p, len(place)) for p in pieces])
        low = _lowest(list(place))
        order = sorted(range(len(of)), key=lambda k: -len(of[k]))
        for s in range(0, len(of), at_once):
            some = order[s : s + at_once]
            got = low[[of[k][0] for k in some]]
            for p in range(1, len(of[some[0]])):
                ids = [of[k][p] for k in some if len(of[k]) > p]
                np.minimum(got[: len(ids)], low[ids], out=got[: len(ids)])
            out[np.array(some) + i] = got
        i += len(of)
    return out


def _lowest(texts: list[str], at_once: int = 16_384) -> np.ndarray:
    """MinHash values of the trigrams within each text of three characters or more."""
    out = np.empty((len(texts), _SEEDS.shape[1]), np.uint64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= at_once):
            size += len(texts[j])
            j += 1
        c = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        grams = _mix(c[:-2] * _WEIGHTS[0] + c[1:-1] * _WEIGHTS[1] + c[2:] * _WEIGHTS[2])
        ends = np.cumsum([len(t) for t in texts[i:j]])
        starts = np.r_[0, ends[:-1]]
        # Trigrams that reach into the next text take no part: the one before stands for them.
        over = np.concatenate([ends[:-1] - 2, ends[:-1] - 1]).astype(np.int64)
        inner = np.ones(len(grams), bool)
        inner[over[over < len(grams)]] = False
        kept = np.cumsum(inner) - 1
        h = grams[inner]
        at = np.r_[0, kept[starts[1:]]].astype(np.int64)
        for k in range(0, _SEEDS.shape[1], 32):  # odd multipliers modulo 2^64: the high bits decide
            out[i:j, k : k + 32] = np.minimum.reduceat(h[:, None] * _SEEDS[0, k : k + 32] + _SEEDS[1, k : k + 32], at, axis=0)
        i = j
    return out


def band_keys(cores: list[str], names: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Block keys of signatures: MinHash bands of the titles' trigrams, and looser ones joined with author tokens; each as (places, keys)."""
    place = {c: i for i, c in enumerate(dict.fromkeys(c for c in cores if c))}
    if not place:
        none = np.empty(0, np.int64)
        return (none, none), (none, none)
    low = _minima(list(place))
    tight = _mix((low.reshape(len(low), BANDS, ROWS_PER_BAND) * _WEIGHTS[:ROWS_PER_BAND]).sum(2) + np.arange(BANDS, dtype=np.uint64))
    loose = _mix((low[:, : LOOSE_BANDS * LOOSE_ROWS].reshape(len(low), LOOSE_BANDS, LOOSE_ROWS) * _WEIGHTS[8 : 8 + LOOSE_ROWS]).sum(2) + np.arange(100, 100 + LOOSE_BANDS, dtype=np.uint64))
    head = np.array([_word_hash(" ".join(c.split()[:6])) for c in place], np.uint64)  # titles given with and without their second half
    loose = np.c_[loose, head]
    rows = np.array([k for k, c in enumerate(cores) if c], np.int64)
    at = np.array([place[c] for c in cores if c], np.int64)
    who, tokens = [], []
    for k, (core, people) in enumerate(zip(cores, names)):
        if core and people:
            words = [[w for w in p.split() if not w.isupper()] for p in people.split(";", 2)[:2]]
            mine = dict.fromkeys([w for p in words[:1] for w in p[:2]] + [w for p in words[1:] for w in p[:1]])
            tokens += [_word_hash(w) for w in mine]
            who += [k] * len(mine)
    own = np.array([place[cores[k]] for k in who], np.int64)
    joined = _mix(loose[own] + np.array(tokens, np.uint64)[:, None] * _WEIGHTS[15])
    return (np.repeat(rows, BANDS), tight[at].ravel().view(np.int64)), (np.repeat(np.array(who, np.int64), loose.shape[1]), joined.ravel().view(np.int64))


_SIG = "nid string, sig string, core string, marker string, doi string, year int, names string"


def signatures(rows: DataFrame) -> DataFrame:
    """rows (nid, title, authors, date, doi) -> normalised attributes and a key of them all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for nid, title, authors, date, doi in zip(b["nid"], b["title"], b["authors"], b["date"], b["doi"]):
                core, marker = title_parts(title)
                y = _YEAR.match(date or "")
                d, names = doi_of(doi), author_keys(authors)
                year = int(y[0]) if y else 0
                out.append((nid, f"{core}|{marker}|{d}|{year}|{names}", core, marker, d, year, names))
            yield pd.DataFrame(out, columns=["nid", "sig", "core", "marker", "doi", "year", "names"])

    return spread(rows.select("nid", "title", "authors", "date", "doi")).mapInPandas(run, _SIG)


@dataclass
class Chunks:
    """Signatures stored in chunks by their key, a folder each, in order: a signature's number is its chunk and its place there.

    Tasks read them from the shared folder, so what is shuffled of a signature is its number.
    """

    reps: DataFrame
    uri: str
    n: int  # chunks

    @classmethod
    def of(cls, reps: DataFrame, most: int) -> Chunks:
        """``most``: the number of signatures, or more."""
        few, many = CHUNK_REPS
        n = max(1, min(most // few, FEW_CHUNKS), -(-most // many))
        placed = reps.withColumn("chunk", F.pmod("rep", F.lit(n)).cast("int"))
        out = stored(placed.repartition(n, "chunk").sortWithinPartitions("chunk", "rep"), "chunk")
        return cls(out, _uri(reps.sparkSession, out._quill_path), n)

    def reader(self):
        """chunk, columns -> an Arrow table, on any machine."""
        return partial(_read_chunk, self.uri)


def _read_chunk(uri: str, chunk: int, columns: list[str]) -> pa.Table | None:
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    found = files.get_file_info(fs.FileSelector(f"{path}/chunk={chunk}", allow_not_found=True))
    tables = []
    for name in sorted(i.path for i in found if i.path.endswith(".parquet")):
        with files.open_input_file(name) as f:
            tables.append(pq.ParquetFile(f).read(columns=columns))
    if sum(map(len, tables)) >= 1 << SHIFT:
        raise ValueError("a chunk holds too many signatures")
    return pa.concat_tables(tables).combine_chunks() if tables else None


def block_keys(cores: list[str], names: list[str], dois: list[str], years: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of every block that signatures belong to: bands, the identifier, the first two authors with the year."""
    (i, tight), (j, loose) = band_keys(cores, names)
    by_doi = [(k, _word_hash("d " + d)) for k, d in enumerate(dois) if d]
    people = [(k, x.split(";", 2)) for k, x in enumerate(names) if years[k] > 0]
    by_pair = [(k, _word_hash(f"ay {x[0].split(' ', 1)[0]};{x[1].split(' ', 1)[0]};{years[k]}")) for k, x in people if len(x) > 1]
    more = np.array(by_doi + by_pair, np.uint64).reshape(-1, 2)
    return np.r_[i, j, more[:, 0].astype(np.int64)], np.r_[tight.view(np.uint64), loose.view(np.uint64), _mix(more[:, 1])]


def block_lists(chunks: Chunks, n: int) -> DataFrame:
    """Stored: the signatures' numbers of each block of two or more, in order; many blocks in a row (sizes, ids), with the times that two meet in them. ``n``: the number of signatures."""
    spark, read = chunks.reps.sparkSession, chunks.reader()
    cuts = -(-3 * spark.sparkContext.defaultParallelism // chunks.n)
    buckets = max(12, 40 * n // BUCKET_ENTRIES)

    def keyed(batches: Iterator[pa.RecordBatch], step: int = 5_000) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b["id"].to_pylist():
                chunk, cut = divmod(task, cuts)
                t = read(chunk, ["core", "names", "doi", "year"])
                size = 0 if t is None else len(t)
                for s in range(size * cut // cuts, size * (cut + 1) // cuts, step):
                    part = t.slice(s, min(step, size * (cut + 1) // cuts - s))
                    at, key = block_keys(*(part[c].to_pylist() for c in ("core", "names", "doi", "year")))
                    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                    order = np.lexsort((at, bucket))
                    at, key, bucket = at[order].astype("<u2"), key[order].astype("<u4"), bucket[order]  # half of a key: its bucket tells the rest
                    ends = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
                    spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]], pa.int32()), pa.array([chunk << SHIFT | s] * len(spans), pa.int64()), pa.array([at[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([key[x:y].tobytes() for x, y in spans], pa.binary())], ["bucket", "base", "at", "key"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for b in batches for row in zip(*(b[c].to_pylist() for c in ("bucket", "base", "at", "key")))]
        if not held:
            return
        ids = np.concatenate([np.frombuffer(at, "<u2").astype(np.uint32) + np.uint32(base) for _, base, at, _ in held])
        key = np.concatenate([np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(bucket << 32) for bucket, _, _, k in held])
        order = np.lexsort((ids, key))
        ids, key = ids[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        once = new | np.r_[True, ids[1:] != ids[:-1]]
        ids, new = ids[once], new[once]
        sizes = np.diff(np.r_[np.flatnonzero(new), len(ids)])
        ids, sizes = ids[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
        if len(sizes):
            yield _binary(sizes=[sizes.astype("<u4")], ids=[ids.astype("<u4")], met=[int((sizes * (sizes - 1)).sum())])

    tasks = spark.range(0, chunks.n * cuts, 1, chunks.n * cuts)
    entries = tasks.mapInArrow(keyed, "bucket int, base long, at binary, key binary")
    return stored(entries.repartition("bucket").mapInArrow(gather, "sizes binary, ids binary, met long"))


def _binary(**columns: list) -> pa.RecordBatch:
    """Arrays as bytes, numbers as they are."""
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v], pa.binary()) if isinstance(v[0], np.ndarray) else pa.array(v, pa.int64()) for v in columns.values()], list(columns))


def drawn(ids: np.ndarray, share: float) -> np.ndarray:
    return _mix(ids.astype(np.uint64) + np.uint64(1)) >> np.uint64(32) < np.uint64(int(share * (1 << 32)))


def cells(lists: DataFrame, n: int, part: int = 0, parts: int = 1, share: float = 1.0) -> DataFrame:
    """Every block's signatures of two chunks that meet (cell, place of both), those of a part of the ones ahead, among a share of all.

    A block sends its signatures to the cells, not its pairs: a hot one costs their number times the ``n`` chunks, not its square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sizes, ids in zip(b["sizes"].to_pylist(), b["ids"].to_pylist()):
                ids = np.frombuffer(ids, "<u4")
                block = np.repeat(np.arange(len(sizes) // 4), np.frombuffer(sizes, "<u4"))
                if share < 1:
                    some = drawn(ids, share)
                    ids, block = ids[some], block[some]
                if not len(ids):
                    continue
                chunk, place = (ids >> SHIFT).astype(np.int64), ids & np.uint32((1 << SHIFT) - 1)
                first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])])
                size, of = np.diff(np.r_[first, len(ids)]), block[first]
                chunk = chunk[first]
                ahead = size
                if parts > 1:
                    mine = place % parts == part
                    ahead = np.add.reduceat(mine, first, dtype=np.int64)
                    kept, before = place[mine], np.r_[0, ahead.cumsum()[:-1]]
                else:
                    kept, before = place, first
                for d in range(n):
                    left = np.arange(max(0, len(of) - d))
                    left = left[(of[left] == of[left + d]) & (ahead[left] > 0) & (size[left] > (d == 0))]
                    if d and not len(left):
                        break
                    cell = _cell(chunk[left], chunk[left + d])
                    order = np.argsort(cell, kind="stable")
                    left, cell = left[order], cell[order]
                    for x in np.split(np.arange(len(left)), np.flatnonzero(cell[1:] != cell[:-1]) + 1) if len(left) else ():
                        i, j = left[x], left[x] + d
                        yield _binary(cell=[int(cell[x[0]])], n_left=[ahead[i].astype("<u4")], n_right=[size[j].astype("<u4")], left=[kept[_spans(before[i], ahead[i])]], right=[place[_spans(first[j], size[j])]])

    return lists.mapInArrow(run, "cell long, n_left binary, n_right binary, left binary, right binary")


def _cell(x, y):
    """The number of the cell of two chunks, x <= y."""
    return y * (y + 1) // 2 + x


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, so many each."""
    return np.repeat(starts - (sizes.cumsum() - sizes), sizes) + np.arange(sizes.sum())


def _pairs(n_left: np.ndarray, n_right: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of a cell in order, about ``AT_ONCE`` at a time; ``same``: of a chunk with itself."""
    of = np.repeat(np.arange(len(n_left)), n_left)
    starts = n_right.cumsum() - n_right
    turns = int(-(-(n_left * n_right).sum() // AT_ONCE))
    turn = _mix(left.astype(np.uint64) + np.uint64(1)) % np.uint64(max(1, turns))
    for k in range(turns):
        some = turn == k
        block = of[some]
        a, b = np.repeat(left[some], n_right[block]), right[_spans(starts[block], n_right[block])]
        if same:
            a, b = a[b > a], b[b > a]
        both = np.unique(a.astype(np.int64) << SHIFT | b)
        if len(both):
            yield both >> SHIFT, both & ((1 << SHIFT) - 1)


def meet(chunks: Chunks, met: DataFrame, columns: list[str], found, schema: str) -> DataFrame:
    """What ``found`` makes of the pairs of signatures of each cell: two Arrow tables of ``columns``, a row for each signature that meets another, and the places of the pairs in them."""
    read = chunks.reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("cell", "n_left", "n_right", "left", "right"))):
                held.setdefault(row[0], []).append(row[1:])
        for cell in sorted(held):
            y = (math.isqrt(8 * cell + 1) - 1) // 2
            x = cell - _cell(0, y)
            n_left, n_right, left, right = (np.frombuffer(b"".join(v), "<u4") for v in zip(*held.pop(cell)))
            sides = []
            for chunk, places in ((x, left), (y, right)):
                some, at = np.unique(places, return_inverse=True)
                sides.append((read(chunk, columns).take(some), at))
            if x == y:  # both sides count in one table
                some, at = np.unique(np.r_[left, right], return_inverse=True)
                table = read(x, columns).take(some)
                sides = [(table, at[: len(left)]), (table, at[len(left) :])]
            for a, b in _pairs(n_left.astype(np.int64), n_right.astype(np.int64), sides[0][1], sides[1][1], x == y):
                yield from found(sides[0][0], sides[1][0], a, b)

    return met.repartitionById(_cell(0, chunks.n), F.col("cell").cast("int")).mapInArrow(run, schema)


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of signatures that share a block."""
    n = reps.count()
    chunks = Chunks.of(reps, n)

    def found(x: pa.Table, y: pa.Table, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = x["rep"].to_numpy()[a], y["rep"].to_numpy()[b]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return meet(chunks, cells(block_lists(chunks, n), chunks.n), ["rep"], found, "a long, b long")


FEATURES = ["ts", "poor", "sub1", "sub2", "drop", "au", "ad", "aum", "am", "y0", "y1", "y2", "ta"]
# What the classifier starts from (the last is the intercept); the labels of a corpus pull it away.
PRIOR = [0.6, -1.8, 0.0, -2.5, 0.3, 1.0, -1.7, 1.1, 1.1, 0.0, -0.1, -1.0, 2.1, -1.7]
# Twenty pairs of each kind that every corpus is taken to hold: equal in all, of which a tenth has a wrong identifier, and of two works.
PROTOTYPES = [{"ts": 1.0, "au": 1.0, "ta": 1.0, "y0": 1.0}, {"ts": 0.6, "poor": 1.0, "sub2": 1.0, "ad": 1.0, "y2": 1.0}]
ALIKE = 0.4  # share of matched title words from which a pair has something in common
FOLDS = 4


def pair_features(chunks: Chunks, met: DataFrame, common: frozenset[str], told: bool = False, known: Evidence | None = None) -> DataFrame:
    """a, b, the text view, and the identifiers' view: de (equal), dd (different), tm (a title is missing); ``told``: only pairs of two identifiers.

    Pairs of titles that are not alike are settled here as two works and have no row; with ``known``, neither have
    those that no agreement of their authors could link, whose authors are not compared.
    """
    names = ["a", "b", *FEATURES, "de", "dd", "tm"]

    def found(x: pa.Table, y: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Another part, a correction or a reply is another work whatever else agrees.
        (mark_x, mark_y), _ = _codes(x, y, "marker")
        (doi_x, doi_y), dois = _codes(x, y, "doi")
        fit = mark_x[left] == mark_y[right]
        has = np.array([bool(d) for d in dois], bool)
        if told:
            fit &= has[doi_x][left] & has[doi_y][right]
        left, right = left[fit], right[fit]
        rep_x, rep_y = x["rep"].to_numpy(), y["rep"].to_numpy()
        turned = rep_x[left] > rep_y[right]  # the lesser key comes first

        def ahead(of_x: np.ndarray, of_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            one, other = of_x[left], of_y[right]
            return np.where(turned, other, one), np.where(turned, one, other)

        (core_x, core_y), cores = _codes(x, y, "core")
        core_a, core_b = ahead(core_x, core_y)
        ts, sub, drop = _of_each(lambda v, w: title_features(v, w, common), core_a, core_b, cores, 3).T
        titled = np.array([bool(c) for c in cores], bool)
        tm = ~(titled[core_a] & titled[core_b])
        alike = tm | ~(ts < ALIKE)  # others are of two works whatever else agrees (see Evidence.confidence)
        left, right, turned, ts, sub, drop, tm = (v[alike] for v in (left, right, turned, ts, sub, drop, tm))
        (names_x, names_y), people = _codes(x, y, "names")
        names_a, names_b = ahead(names_x, names_y)
        named = np.array([bool(p) for p in people], bool)
        both = named[names_a] & named[names_b]
        year_a, year_b = ahead(x["year"].to_numpy().astype(np.int64), y["year"].to_numpy().astype(np.int64))
        dy = np.where((year_a != 0) & (year_b != 0), np.abs(year_a - year_b), -1)
        doi_a, doi_b = ahead(doi_x, doi_y)
        ids = has[doi_a] & has[doi_b]
        f = {"ts": ts, "poor": ts < 0.7, "sub1": sub == 1, "sub2": sub >= 2, "drop": np.minimum(drop, 3.0), "am": ~both, "y0": dy == 0, "y1": dy == 1, "y2": dy > 1, "de": ids & (doi_a == doi_b), "dd": ids & (doi_a != doi_b), "tm": tm}
        f["a"], f["b"] = ahead(rep_x, rep_y)
        if known is not None:
            may = known.may_link(f)
            f, both, names_a, names_b = {k: v[may] for k, v in f.items()}, both[may], names_a[may], names_b[may]
        au = np.zeros(len(both))
        au[both] = _of_each(lambda v, w: (author_similarity(v, w),), names_a[both], names_b[both], people, 1)[:, 0]
        f |= {"au": au, "ad": both & (au < 0.34), "aum": both & (au >= 0.34) & (au < 0.8), "ta": f["ts"] * au}
        for s in range(0, len(au), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(f[k][s : s + 10_000].astype(np.int64 if k in ("a", "b") else np.float64)) for k in names], names)

    return meet(chunks, met, ["rep", "core", "marker", "doi", "year", "names"], found, "a long, b long, " + ", ".join(f"{f} double" for f in names[2:]))


def _codes(x: pa.Table, y: pa.Table, column: str) -> tuple[tuple[np.ndarray, np.ndarray], list[str]]:
    """A number for each value of two tables' column, equal for equal values, and the values by number."""
    both = pa.chunked_array([*x[column].chunks, *y[column].chunks], x.schema.field(column).type).combine_chunks().dictionary_encode("encode")
    codes = both.indices.to_numpy().astype(np.int64)
    return (codes[: len(x)], codes[len(x) :]), both.dictionary.to_pylist()


def _of_each(f, a: np.ndarray, b: np.ndarray, values: list[str], width: int) -> np.ndarray:
    """The ``width`` numbers that ``f`` gives for each pair of values by number; equal pairs are computed once."""
    pairs, at = np.unique(a * len(values) + b, return_inverse=True)
    return np.fromiter((f(values[k // len(values)], values[k % len(values)]) for k in pairs.tolist()), np.dtype((float, width)), len(pairs))[at]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights and intercept by Newton steps; an L2 term draws them to ``prior`` (zero unless given)."""
    x = np.c_[x, np.ones(len(x))]
    start = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, float)
    w = start.copy()
    reg = np.diag([l2] * (x.shape[1] - 1) + [1e-3 if prior is None else l2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg @ (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + reg
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Evidence:
    """The calibrated text view and the error rates of identifiers."""

    weights: np.ndarray
    agree_same: float  # how often the identifiers of one work agree
    agree_other: float  # how often those of two works do
    reliability: list[tuple[float, int, float, float]]  # of held-out pairs: bin, pairs, mean probability, share of equal identifiers

    @classmethod
    def fit(cls, f: pd.DataFrame) -> Evidence:
        """``f``: labelled pairs, that is, of alike titles with two identifiers."""
        x, y = f[FEATURES].to_numpy(float).reshape(len(f), len(FEATURES)), f["de"].to_numpy(float)
        fold = (f["a"].to_numpy(np.int64) ^ f["b"].to_numpy(np.int64)) % FOLDS
        prior = np.array(PRIOR)
        more = np.array([[p.get(k, 0.0) for k in FEATURES] for p in PROTOTYPES for _ in range(20)])
        told = np.array([1.0] * 18 + [0.0] * 22)
        learn = lambda k: fit_logistic(np.vstack([x[k], more]), np.r_[y[k], told], prior=prior)
        apart = np.zeros(len(f))
        for k in range(FOLDS):
            apart[fold == k] = np.c_[x[fold == k], np.ones((fold == k).sum())] @ learn(fold != k)
        scale = fit_logistic(apart[:, None], y, l2=20.0, prior=np.array([1.0, 0.0]))
        w = learn(fold >= 0) * scale[0]
        w[-1] += scale[1]
        p = 1 / (1 + np.exp(-(apart * scale[0] + scale[1])))
        order = np.argsort(p, kind="stable")
        sure, other = y[order[len(y) // 2 :]], y[p < 0.05]
        sure = sure[p[order[len(y) // 2 :]] > 0.7]
        bins = np.array([0, 0.05, 0.2, 0.5, 0.7, 0.8, 0.86, 0.9, 1.0])
        at = np.digitize(p, bins[1:-1])
        reliability = [(float(bins[k + 1]), int((at == k).sum()), float(p[at == k].mean()), float(y[at == k].mean())) for k in range(len(bins) - 1) if (at == k).any()]
        return cls(w, float((sure.sum() + 9) / (len(sure) + 10)), float((other.sum() + 0.05) / (len(other) + 10)), reliability)

    def confidence(self, get) -> Column:
        """Of a pair; ``get`` gives the column of a feature."""
        z: Column = F.lit(float(self.weights[-1]))
        for f, v in zip(FEATURES, self.weights):
            z = z + F.lit(float(v)) * get(f)
        q, r = self.agree_same, self.agree_other
        text = (1 / (1 + F.exp(-z)) - r) / (q - r)  # the labels agree with the truth but for the identifiers' errors
        text = F.when(get("tm") == 1, get("au") / 2).when(get("ts") < ALIKE, 0.0).otherwise(text)  # with 1e-4 no identifier outweighs it
        text = F.least(F.greatest(text, F.lit(1e-4)), F.lit(1 - 1e-3))
        told = F.when(get("de") == 1, float(np.log(q / r))).when(get("dd") == 1, float(np.log((1 - q) / (1 - r)))).otherwise(0.0)
        return 1 / (1 + F.exp(-(F.log(text / (1 - text)) + told)))

    def may_link(self, f: dict[str, np.ndarray]) -> np.ndarray:
        """Whether some agreement of the authors, which ``f`` does not have yet, gives a pair a confidence of one half."""
        w, q, r = dict(zip(FEATURES, self.weights.tolist())), self.agree_same, self.agree_other
        if q <= r:
            return np.ones(len(f["ts"]), bool)
        z = self.weights[-1] + sum(w[k] * f[k] for k in ("ts", "poor", "sub1", "sub2", "drop", "am", "y0", "y1", "y2"))
        # Between these agreements, the weights' sum is linear: it is highest at one of them.
        ends = [(au, kind) for lo, hi, kind in ((-0.1, 0.34, w["ad"]), (0.34, 0.8, w["aum"]), (0.8, 1.0, 0.0)) for au in (lo, hi)]
        z = z + np.where(f["am"], 0.0, np.max([(w["au"] + w["ta"] * f["ts"]) * au + kind for au, kind in ends], axis=0))
        text = np.clip((1 / (1 + np.exp(-np.clip(z, -500, 500))) - r) / (q - r), 1e-4, 1 - 1e-3)
        told = np.where(f["de"], np.log(q / r), np.where(f["dd"], np.log((1 - q) / (1 - r)), 0.0))
        return f["tm"] | (np.log(text / (1 - text)) + told > -1e-6)

    def of_equals(self) -> Column:
        """The confidence that two rows of one signature (core, doi, year, names) are of one work."""
        flag = lambda c: F.when(c, 1.0).otherwise(0.0)
        own = {"ts": flag(F.col("core") != ""), "au": flag(F.col("names") != ""), "am": flag(F.col("names") == ""), "y0": flag(F.col("year") > 0), "de": flag(F.col("doi") != ""), "tm": flag(F.col("core") == "")}
        own |= {"ta": own["ts"] * own["au"], "poor": own["tm"]}
        return self.confidence(lambda f: own.get(f, F.lit(0.0)))


def evidence(features: DataFrame) -> Evidence:
    """Fitted on at most about ``FIT_PAIRS`` labelled pairs, drawn by hash from all."""
    labelled = features.where((F.col("ts") >= ALIKE) & (F.col("de") + F.col("dd") > 0))
    n = labelled.count()
    share = 1_000_000 if n <= FIT_PAIRS else int(1e6 * FIT_PAIRS / n)
    return Evidence.fit(labelled.where(F.pmod(F.xxhash64("a", "b"), F.lit(1_000_000)) < share).toPandas().sort_values(["a", "b"]))


def linked_at(scored: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """id, level, comp: the works at rising levels. Two rows that share one are linked by a path of links as sure as the level."""
    out = None
    for t in levels:
        c = components(scored.where(F.col("confidence") >= t).select("a", "b")).select("id", F.lit(t).alias("level"), "comp")
        out = c if out is None else out.unionByName(c)
    return out


def works(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Evidence]:
    """rows (nid, title, authors, date, doi) -> (nid, work, rep), the linked pairs of signatures (a, b, confidence of one half or more), the signatures, the evidence."""
    spark = rows.sparkSession
    sig = stored(signatures(rows).withColumn("rep", F.xxhash64("sig")).drop("sig"))
    chunks = Chunks.of(sig.groupBy("rep").agg(*[F.first(c).alias(c) for c in ("core", "marker", "doi", "year", "names")]), sig.count())
    reps = chunks.reps
    rep_of = stored(sig.select("nid", "rep").distinct())
    discard(sig)
    release(spark)
    n, common = reps.count(), common_words(reps)
    lists = block_lists(chunks, n)
    release(spark)
    told = reps.where("doi <> ''").count()  # only these give labels
    share = min(1.0, FIT_REPS / max(1, told))
    features = stored(pair_features(chunks, cells(lists, chunks.n, share=share), common, told=True))
    known = evidence(features)
    discard(features)
    release(spark)
    met = lists.agg(F.sum("met")).first()[0] or 0
    parts = max(1, -(-met // (2 * MEETINGS * max(n, FEW))))
    linked = []
    for p in range(parts):  # what the meetings of a part take is released before the next
        scored = pair_features(chunks, cells(lists, chunks.n, p, parts), common, known=known).withColumn("confidence", known.confidence(F.col))
        linked.append(stored(scored.where("confidence >= 0.5").select("a", "b", "confidence")))
        release(spark)
    discard(lists)
    links = reduce(DataFrame.unionByName, linked)
    comp = components(links)
    nodes = rep_of.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("nid", F.coalesce("comp", "rep").alias("work"), "rep")
    return nodes, links, reps, known
