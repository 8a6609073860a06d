"""Sentence units of documents in many languages and scripts.

Lines are first joined into blocks: a line break within a hard-wrapped paragraph is white space, any
other ends a unit (headings, titles, paragraphs). Within a block a linear-chain conditional random field
tags every candidate position (a terminator with its closing quotes and brackets; in scripts written
without full stops, a space) as boundary or inside; all other characters are inside by construction. Its
emissions are log-linear in what stands around the candidate, among it a log-likelihood ratio counted
over the whole corpus: how often the token before the mark, or the letters around the space, stand at the
edge of a block, where the boundary is certain. Its transitions depend on the two tags and on what lies
between the two candidates. All weights are learned; none is set by hand.

Training needs no labels from people. Blocks of a bounded sample are put end to end, so the seam is a
certain boundary; for scripts without full stops they are stripped of punctuation first. ``clue`` tags what
is certain either way (a small letter after a full stop, a mark within a quotation, a word that never ends
a block) and leaves the rest open; the likelihood of the clues, summed over all taggings that agree with
them, is maximised. Viterbi decoding gives the best tagging of a block.

Positions are code points from 0, end exclusive, without white space at either end. Defined results:
null, empty and blank texts give no rows; repeated rows count once; an empty table gives no rows. What
precedes a candidate is looked at up to 60 characters back, what follows up to 12 (a feature window).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, stored

# Marks that end sentences, quotes and brackets with their partners.
STOPS = ".!?。！？।॥؟…․｡"
FULL = "。！？।॥؟｡"
_OPENERS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "‘": "’"}
_CLOSERS = set(_OPENERS.values()) | {'"', "'", "”", "»", "“"}
# Scripts written without full stops: Thai, Lao, Burmese, Khmer, Tibetan.
_BARE = "฀-๿຀-໿က-႟ក-៿ༀ-࿿"
_BARE_RE = re.compile(f"[{_BARE}]")
_CANDIDATE = re.compile(rf"[{re.escape(STOPS)}]+|(?<=[{_BARE}])\s+|\s+(?=[{_BARE}])")
_WORD_BEFORE = re.compile(r"[^\s.!?。！？।॥؟…,;:()\[\]\"“”„«»「」]+(?:\.[^\s.!?,;:()\[\]\"“”„«»]+)*$")
_HARD = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_JUNK = re.compile(r"[\x00-\x08\x0e-\x1f​-‏⁠﻿­\U0001F000-\U0001FAFF☀-➿]")
_DIGITS = re.compile(r"\d+(?:[.,:/-]\d+)*")
_INNER_DOT = re.compile(r"[\w]\.$")
_SLACK = 10  # characters added or lost after a text was wrapped
MIN_SHARE = 1e-6  # keys rarer than this are not kept, so the model has at most 1 / MIN_SHARE keys


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans of text whose line breaks are only white space."""
    lines, at = [], 0
    for m in _HARD.finditer(text):
        lines.append((at, m.start(), m.end()))
        at = m.end()
    lines.append((at, len(text), len(text)))
    if len(lines) == 1:
        return [(0, len(text))]
    width = _wrap_width(text, lines)
    out, start = [], None
    for n, (a, b, _) in enumerate(lines):
        if not text[a:b].strip():
            if start is not None:
                out.append((start, lines[n - 1][1]))
                start = None
            continue
        if start is None:
            start = a
        elif not _soft(text, lines[n - 1], (a, b), width):
            out.append((start, lines[n - 1][1]))
            start = a
    if start is not None:
        out.append((start, lines[-1][1]))
    return out


def _wrap_width(text: str, lines: list[tuple[int, int, int]]) -> int:
    """The width at which the lines were wrapped, 0 if they were not: some line goes on in the next with a small letter."""
    def full(n: int) -> bool:
        (a, b, _), (c, d, _) = lines[n], lines[n + 1]
        head, tail = text[a:b].rstrip(), _JUNK.sub("", text[c:d]).lstrip()
        return bool(head) and bool(tail) and (tail[0].islower() or tail[0] in "),;»?!—" or (tail[0].isdigit() and head[-1] not in STOPS)) and head[-1] not in FULL + "!?" and b - a >= 30

    went_on = [lines[n][1] - lines[n][0] for n in range(len(lines) - 1) if full(n)]
    if not went_on:
        # Scripts without case: several unfinished lines of nearly one length.
        lens = [(b - a, text[a:b].rstrip()[-1:]) for a, b, _ in lines[:-1]]
        loose = [n for n, end in lens if n >= 30 and end and end not in STOPS and end not in _CLOSERS and not end.isascii()]
        if len(loose) >= 2 and max(loose) - min(loose) <= 14 and max(n for n, _ in lens) <= max(loose) + 14:
            return max(n for n, _ in lens)
        return 0
    top = max(went_on)
    longest = max(b - a for a, b, _ in lines)
    return longest if longest <= top + 25 else top


def _soft(text: str, line: tuple[int, int, int], nxt: tuple[int, int], width: int) -> bool:
    """Whether a break is only the wrapping of a line (in a text that is wrapped at about ``width``)."""
    if not width:
        return False
    a, b, _ = line
    tail = _JUNK.sub("", text[nxt[0] : nxt[1]]).lstrip()
    head = text[a:b].rstrip()
    if b - a >= 20 and (tail[:1].islower() or tail[:1] in "?!»”)—") and head[-1:] not in FULL + ".!?":
        return True
    word = re.match(r"\S+", tail)
    return (b - a) + 1 + (len(word[0]) if word else 0) > width - _SLACK


def _key_before(block: str, i: int) -> str:
    """The token before a mark, in lower case; a number goes with the word before it."""
    head = _JUNK.sub("", block[max(0, i - 60) : i])
    m = _WORD_BEFORE.search(head, max(head.rfind(" "), head.rfind("\n")) + 1)  # a word holds no space
    if not m:
        return "S "
    w = m[0].lower()
    if w[0].isdigit() and _DIGITS.fullmatch(w):
        p = head[: m.start()].split()
        return f"N {p[-1].lower()[-20:] if p else ''} {'f' if re.search(r'[.,]', w) else 'i'}"
    return "W " + w[-24:]


def _bare_keys(block: str, i: int, j: int) -> tuple[str, str]:
    left = _DIGITS.sub("0", re.sub(r"[^\w\s]", "", block[max(0, i - 12) : i])).rstrip()[-5:]
    right = _DIGITS.sub("0", re.sub(r"[^\w\s]", "", block[j : j + 12])).lstrip()[:5]
    left = left[-1:] if left[-1:].isdigit() or left[-1:].isascii() else left
    right = right[:1] if right[:1].isdigit() or right[:1].isascii() else right
    return "L " + left, "R " + right


def learn(text: str, into: Counter) -> None:
    """Count keys: (key, True) at the edge of a block, (key, False) anywhere a candidate stands."""
    for a, b in blocks(text):
        block = text[a:b].strip()
        if not block:
            continue
        bare = bool(_BARE_RE.search(block))
        for m in _CANDIDATE.finditer(block):
            if not m[0].isspace():
                if m[0] == ".":
                    k = _key_before(block, m.start())
                    into[k, False] += 1
                    if m.end() >= len(block.rstrip("\"'”’»)] ")):
                        into[k, True] += 1
            elif bare:
                left, right = _bare_keys(block, m.start(), m.end())
                into[left, False] += 1
                into[right, False] += 1
        if bare:
            left, right = _bare_keys(block, len(block), len(block))[0], _bare_keys(block, 0, 0)[1]
            for k in (left, right):
                into[k, True] += 1
                into[k, False] += 1


class Keys:
    """What the corpus tells of the tokens at candidates: how surely they stand at the edge of a block."""

    def __init__(self, counts: dict[str, tuple[int, int]], edge: float, bare_edge: float):
        self.counts, self.edge, self.bare_edge = counts, max(1e-5, min(0.5, edge)), max(1e-5, min(0.5, bare_edge))
        self.memo: dict[str, float] = {}

    def ratio(self, key: str) -> float:
        """log P(counts | ends sentences) / P(counts | does not)."""
        got = self.memo.get(key)
        if got is None:
            e, n = self.counts.get(key, (0, 0))
            p, q = (self.bare_edge, self.bare_edge / 40) if key[0] in "LR" else (self.edge, self.edge / 60)  # other tokens reach an edge only by chance
            got = e * math.log(p / q) + (n - e) * math.log((1 - p) / (1 - q))
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[key] = got = max(-9.0, min(9.0, got))
        return got


def _first(block: str, j: int) -> str:
    """The first character after a mark that tells something."""
    for k in range(j, min(len(block), j + 12)):
        ch = block[k]
        if not ch.isspace() and not _JUNK.match(ch) and ch not in _OPENERS and ch not in "\"'¿¡—–-":
            return ch
    return ""


def _nesting(block: str) -> list[tuple[int, int]]:
    """Spans of balanced quotes and brackets, from opening to closing mark."""
    stack: list[tuple[str, int]] = []
    spans = []
    for i, ch in enumerate(block):
        if ch == '"':
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if hit is None:
                stack.append(('"', i))
            else:
                spans.append((stack[hit][1], i))
                del stack[hit:]
        elif ch in "“”„«»‹›「」『』（）()[]【】":
            hit = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == ch), None)
            if hit is not None:
                spans.append((stack[hit][1], i))
                del stack[hit:]
            elif ch in _OPENERS:
                stack.append((_OPENERS[ch], i))
    return spans


_ANY_QUOTE = re.compile(r'["“”„«»「」『』（）()\[\]]')
_LATE_CLOSER = re.compile(r"\s+[»›]")
_DASH = re.compile(r"\s+[—–]\s")


def _kind_of(nxt: str) -> str:
    """The class of the character after a mark."""
    if not nxt:
        return "none"
    return "lower" if nxt.islower() else "upper" if nxt.isupper() else "digit" if nxt.isdigit() else "comma" if nxt in ",;:" else "letter" if nxt.isalpha() else "other"


def _gap(block: str, a: int, e: int) -> str:
    """How much text lies between two candidates."""
    if e - a >= 50:
        return "much"
    n = 0
    for ch in block[a:e]:
        n += ch.isalnum()
    return "none" if not n else "brief" if n <= 2 else "short" if n <= 12 else "some" if n <= 30 else "much"


def observe(block: str, keys: Keys, seam: int = -1) -> tuple[list[int], list[list[tuple[str, float]]], list[str], list[int]]:
    """Candidates of a block: their ends, emission features, transition classes and clues (1 boundary, 0 inside, -1 open).

    ``seam``: the place where two blocks were put together; a candidate that ends there is a boundary.
    """
    spans = _nesting(block) if _ANY_QUOTE.search(block) else []
    ends: list[int] = []
    feats: list[list[tuple[str, float]]] = []
    between: list[str] = []
    clues: list[int] = []
    n = len(block)
    ratio = keys.ratio
    last = 0
    for m in _CANDIDATE.finditer(block):
        i, j = m.span()
        clue = -1
        if m[0].isspace():
            if i == 0 or j == n or block[i - 1] in STOPS or (block[i - 1] in _CLOSERS and i > 1 and block[i - 2] in STOPS):
                continue
            left, right = _bare_keys(block, i, j)
            a, b = ratio(left), ratio(right)
            before, after = bool(_BARE_RE.match(block[i - 1])), bool(_BARE_RE.match(block[j]))
            if before and after:
                f = [("space", 1.0), ("space sum", (a + b) / 3), ("space left", min(a, b) / 3)]
                if min(a, b) >= 1.5 and a + b >= 5:
                    clue = 1
                elif a + b <= -4:
                    clue = 0
            else:  # another script on one side: only the other side tells
                other = block[j] if before else block[i - 1]
                one = a if before else b
                c = "digit" if other.isdigit() else "upper" if other.isupper() else "quote" if other in "\"“¿¡" else "other"
                f = [(f"mixed {before} {c}", 1.0), (f"mixed sum {c == 'digit'}", one / 3)]
                if one >= 6 and c != "digit":
                    clue = 1
                elif one <= -3 or c == "digit" and one < 3:
                    clue = 0
            if any(x < i <= y for x, y in spans):
                f, clue = [("space within", 1.0)], 0
            e = i
            gap = "s " + _gap(block, last, e)
        else:
            e = j
            # Closing quotes and brackets go with the sentence; French sets a space before them.
            while e < n:
                if block[e] in _CLOSERS and (block[e] != "'" or e + 1 == n or not block[e + 1].isalpha()) and not (block[e] == '"' and not any(b == e for _, b in spans)) and not (block[e] == "“" and not any(b == e for _, b in spans)):
                    e += 1
                elif block[e].isspace() and (late := _LATE_CLOSER.match(block, e)) and any(a < i and b == late.end() - 1 for a, b in spans):
                    e = late.end() - 1
                elif _JUNK.match(block[e]) and e + 1 < n and block[e + 1] in _CLOSERS:
                    e += 1
                else:
                    break
            if e >= n or not block[e:].strip():
                continue
            spaced = block[e].isspace()
            if not spaced and _JUNK.match(block[e]):
                spaced = _JUNK.sub("", block[e : e + 8])[:1].isspace()
            nxt = _first(block, e)
            kind = _kind_of(nxt)
            mark = m[0]
            if mark[0] in FULL or mark[-1] in FULL:
                f, clue = [("full", 1.0), (f"full {kind}", 1.0)], 1
            elif "…" in mark or mark.count(".") >= 2 and not mark.strip("."):
                f = [("dots", 1.0), (f"dots {kind} {spaced}", 1.0)]
                clue = 1 if kind == "upper" and spaced else 0
            elif "!" in mark or "?" in mark:
                f = [("call", 1.0), (f"call {kind} {spaced} {e > j}", 1.0)]
                clue = (0 if e > j or not spaced else -1) if kind == "lower" else 1 if spaced or e > j else -1 if kind == "upper" or nxt and not nxt.isascii() else 0
            else:
                k = _key_before(block, i)
                r = ratio(k)
                word = k[2:]
                if not spaced and e == j:
                    before = block[max(0, i - 3) : i]
                    close = bool(nxt) and block[e] == nxt and kind == "upper" and before[-2:].isalpha() and before[-2:].islower() and "." not in before
                    opens = bool(nxt) and block[e] in _OPENERS and before[-1:].isalpha()
                    where = "close" if close else "opens" if opens else f"tight {kind}"
                    clue = (1 if r > 1 else 0 if r <= -2 else -1) if close or opens else 0
                elif kind in ("lower", "comma"):
                    where = f"before {kind} {k[0]}"
                    clue = -1 if kind == "lower" and r > 2.5 and k[0] == "W" else 0
                else:
                    shape = "initial" if k[0] == "W" and (len(word) == 1 and word.isalpha() or "." in word) else "brief" if k[0] == "W" and len(word) <= 3 else "first" if k[0] == "N" and i <= 4 else k[0]
                    where = f"dot {shape} {'digit' if kind == 'digit' else ''}"
                    clue = 1 if r >= (1 if shape not in ("initial", "first") else 5) else 0 if r <= (1 if shape in ("initial", "first") else -3) else -1
                family = where.partition(" ")[0]  # what a rare case shares with its like
                f = [(where, 1.0), (f"ratio {where}", r / 3), (f"{family} all", 1.0), (f"ratio {family} all", r / 3)]
            gap = "m " + _gap(block, last, e)
            within = bool(spans) and any(a < i and b >= e for a, b in spans)
            closed = [a for a, b in spans if i < b < e and a < i] if spans else []
            if within:
                f, clue = [("within", 1.0)], 0
            elif closed and block[min(closed)] not in "([（【" and kind != "upper" and (spaced or nxt and block[e] not in _OPENERS):
                # Direct speech that opens a unit, and who spoke after it: the tag before the quotation tells.
                direct = not block[last : min(closed)].strip()
                gap = "speech" if direct else gap
                f = [("speech", 1.0), (f"speech {kind}", 1.0)] if direct else f
                clue = 0 if direct else clue
            if block[e] in ",，、;；:：—" or _DASH.match(block, e):
                f, clue = [("goes on", 1.0)], 0
        if seam >= 0 and last < seam <= e + 1 and e <= seam:
            clue = 1
        ends.append(e)
        feats.append(f)
        between.append(gap)
        clues.append(clue)
        last = e
    return ends, feats, between, clues


class Chain:
    """A linear-chain conditional random field over two tags: 0 inside, 1 boundary."""

    def __init__(self, emit: dict[str, float], move: dict[str, tuple[float, float, float, float]]):
        self.emit, self.move = emit, move  # move: inside to inside, inside to boundary, boundary to inside, boundary to boundary

    @classmethod
    def fit(cls, sequences: list[tuple[list[list[tuple[str, float]]], list[str], list[int]]], rounds: int = 60, l2: float = 0.02, rate: float = 0.3) -> Chain:
        """Weights that maximise the likelihood of the clues; open tags are summed over. All sequences step together."""
        sequences = [s for s in sequences if s[2] and max(s[2]) >= 0]
        if not sequences:
            return cls({}, {})
        names = {k: i for i, k in enumerate(sorted({k for fs, _, _ in sequences for f in fs for k, _ in f}))}
        gaps = {k: i for i, k in enumerate(sorted({g for _, gs, _ in sequences for g in gs}))}
        sequences = sorted(sequences, key=lambda s: -len(s[2]))
        lens = np.array([len(s[2]) for s in sequences])
        top, many = int(lens.max()), len(sequences)
        width = max(len(f) for fs, _, _ in sequences for f in fs)
        at = np.full((top, many, width), len(names), np.int64)
        val = np.zeros((top, many, width))
        gap = np.zeros((top, many), np.int64)
        may = np.ones((top, many, 2))  # which tags the clues allow
        for s, (fs, gs, cs) in enumerate(sequences):
            for t, (f, g, c) in enumerate(zip(fs, gs, cs)):
                for w, (k, v) in enumerate(f):
                    at[t, s, w], val[t, s, w] = names[k], v
                gap[t, s] = gaps[g]
                if c >= 0:
                    may[t, s, 1 - c] = 0.0
        here = np.arange(top)[:, None] < lens[None, :]
        alive = here.sum(1)  # sequences are ordered by length, so those alive come first

        def expected(allow: np.ndarray, e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Expected tags (top, many) and moves (top, many, 2, 2) under the allowed taggings."""
            up = np.exp(np.clip(e, -30, 30))
            step = np.exp(np.clip(m, -20, 20))[gap]  # top, many, from, to
            f = np.zeros((top, many, 2))
            b = np.ones((top, many, 2))
            for t in range(top):
                n = alive[t]
                came = step[t, :n, 1] if t == 0 else np.einsum("sp,spc->sc", f[t - 1, :n], step[t, :n])
                came = came * allow[t, :n]
                came[:, 1] *= up[t, :n]
                f[t, :n] = came / came.sum(1, keepdims=True)
            for t in range(top - 2, -1, -1):
                n = alive[t + 1]
                ahead = b[t + 1, :n] * allow[t + 1, :n]
                ahead[:, 1] *= up[t + 1, :n]
                back = np.einsum("spc,sc->sp", step[t + 1, :n], ahead)
                b[t, :n] = back / back.sum(1, keepdims=True)
            tag = f * b
            tag = tag[:, :, 1] / tag.sum(2).clip(1e-300)
            prev = np.concatenate([np.broadcast_to(np.array([0.0, 1.0]), (1, many, 2)), f[:-1]])
            cur = b * allow
            cur[:, :, 1] *= up
            pair = prev[:, :, :, None] * step * cur[:, :, None, :]
            return tag * here, pair / pair.sum((2, 3), keepdims=True).clip(1e-300) * here[:, :, None, None]

        w, m = np.zeros(len(names) + 1), np.zeros((len(gaps), 2, 2))
        mw, vw, mm, vm = np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)
        every = np.ones_like(may)
        for k in range(1, rounds + 1):
            e = (w[at] * val).sum(2)
            tag, pair = (x - y for x, y in zip(expected(may, e, m), expected(every, e, m)))
            gw = np.bincount(at.ravel(), (val * tag[:, :, None]).ravel(), len(w)) - l2 * w
            gm = np.zeros_like(m)
            np.add.at(gm, gap.ravel(), pair.reshape(-1, 2, 2))
            gm -= l2 * m
            gw[-1] = 0.0
            for x, g, a, v in ((w, gw, mw, vw), (m, gm, mm, vm)):
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                x += rate * (a / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls({k: float(w[i]) for k, i in names.items()}, {k: tuple(m[i].ravel().tolist()) for k, i in gaps.items()})

    def scores(self, feats: list[list[tuple[str, float]]]) -> list[float]:
        """Emission of the boundary tag against inside, per candidate."""
        get = self.emit.get
        return [sum([get(k, 0.0) * v for k, v in f]) for f in feats]

    def viterbi(self, emit: list[float], between: list[str]) -> list[int]:
        """The best tags."""
        still = (0.0, 0.0, 0.0, 0.0)
        back: list[tuple[int, int]] = []
        a, b = -1e30, 0.0  # a block opens after a boundary
        for s, g in zip(emit, between):
            ii, ib, bi, bb = self.move.get(g, still)
            p, q, x, y = a + ii, b + bi, a + ib, b + bb
            back.append((1 if q > p else 0, 1 if y > x else 0))
            a, b = (q if q > p else p), (y if y > x else x) + s
        tag = 1 if b > a else 0
        out = [0] * len(emit)
        for t in range(len(emit) - 1, -1, -1):
            out[t] = tag
            tag = back[t][tag]
        return out


class Model:
    """The corpus counts and the chain."""

    def __init__(self, keys: Keys, chain: Chain):
        self.keys, self.chain = keys, chain


def decode(block: str, model: Model) -> list[int]:
    """Ends of the units within one block (its own end left out)."""
    ends, feats, between, _ = observe(block, model.keys)
    if not ends:
        return []
    return [e for e, tag in zip(ends, model.chain.viterbi(model.chain.scores(feats), between)) if tag]


_PUNCTUATION = re.compile(r"[.,;:!?…\"'“”„«»()\[\]]")
_SEAM_CHARS, _SEAM_MOST = 500, 20  # training only: characters on either side of a seam, candidates of a sequence


def training(text: str, keys: Keys) -> list[tuple[list[list[tuple[str, float]]], list[str], list[int]]]:
    """Training sequences of a text: each block put before the next one (the last before the first)."""
    own = [block for a, b in blocks(text) if (block := text[a:b].strip())]
    out = []
    for k, block in enumerate(own):
        nxt = own[(k + 1) % len(own)][:_SEAM_CHARS]
        left = block[-_SEAM_CHARS:]
        bare = bool(_BARE_RE.search(block))
        if bare:
            left, nxt = _PUNCTUATION.sub("", left).strip(), _PUNCTUATION.sub("", nxt).strip()
        elif left.rstrip("\"'”’»)] ")[-1:] not in STOPS:  # a heading or a list item: no seam, but what stands in it
            nxt = ""
        gap = "" if left[-1:] in FULL and not left[-1:].isascii() and "\u3000" < nxt[:1] < "\uffff" else " "
        if left and nxt:
            _, f, g, c = observe(left + gap + nxt, keys, len(left))
            out.append((f[:_SEAM_MOST], g[:_SEAM_MOST], c[:_SEAM_MOST]))
        if bare or not nxt:  # abbreviations and quotations as they are written
            _, f, g, c = observe(block[:_SEAM_CHARS], keys)
            out.append((f[:_SEAM_MOST], g[:_SEAM_MOST], c[:_SEAM_MOST]))
    return out


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    if not text or not text.strip():
        return out
    for a, b in blocks(text):
        block = text[a:b]
        at = 0
        for e in [*decode(block, model), len(block)]:
            piece = block[at:e]
            s = piece.strip()
            if s:
                lead = len(piece) - len(piece.lstrip())
                out.append((a + at + lead, a + at + lead + len(s)))
            at = e
    return out


FIT_TEXTS = 250  # of each script so many texts at most (by hash) train the chain; the counts cover all texts
# The scripts whose texts are sampled apart, by a character of theirs.
SCRIPTS = {"bare": f"[{_BARE}]", "kana": "[\u3040-\u30ff]", "han": "[\u4e00-\u9fff]", "deva": "[\u0900-\u097f]", "arab": "[\u0600-\u06ff]", "cyrl": "[\u0400-\u04ff]"}


def _script(text: Column) -> Column:
    """The script of the first character of such a script; one scan of the text."""
    ch = F.regexp_extract(text, "[" + "".join(rx[1:-1] for rx in SCRIPTS.values()) + "]", 0)
    out = F.lit("other")
    for name, rx in reversed(SCRIPTS.items()):
        out = F.when(ch.rlike(rx), name).otherwise(out)
    return out


def count_keys(docs: DataFrame, text: str) -> Keys:
    """Counts over all documents, aggregated per batch and then by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter = Counter()
            for t in b[text]:
                if t:
                    learn(t, c)
            keys = sorted({k for k, _ in c})
            if keys:  # a frame without rows has no types
                yield pd.DataFrame({"key": keys, "e": [c[k, True] for k in keys], "n": [c[k, False] for k in keys]})

    counted = stored(docs.select(text).mapInPandas(run, "key string, e long, n long").groupBy("key").agg(F.sum("e").alias("e"), F.sum("n").alias("n")))
    bare = F.col("key").rlike("^[LR] ")
    totals = counted.agg(F.sum(F.when(~bare, F.col("n"))).alias("n"), F.sum(F.when(~bare, F.col("e"))).alias("e"), F.sum(F.when(F.col("key").startswith("L "), F.col("n"))).alias("bn"), F.sum(F.when(F.col("key").startswith("L "), F.col("e"))).alias("be")).first()
    every = (totals.n or 0) + 2 * (totals.bn or 0)
    rows = counted.where(F.col("n") >= max(2, math.ceil(every * MIN_SHARE))).toPandas()  # at most 1 / MIN_SHARE rows; the rest count as unseen
    return Keys(dict(zip(rows["key"], zip(rows["e"].tolist(), rows["n"].tolist()))), 1.5 * (totals.e or 0) / max(1, totals.n or 0), 1.2 * (totals.be or 0) / max(1, totals.bn or 0))


def train(docs: DataFrame, text: str) -> Model:
    """Keys from all documents, the chain from a bounded sample of each script."""
    keys = count_keys(docs, text)
    texts = docs.where(F.length(text) > 0).select(F.col(text).alias("t"), _script(F.col(text)).alias("script"))
    sizes = {r.script: r.n for r in texts.groupBy("script").agg(F.count("*").alias("n")).collect()}  # a row per script
    if not sizes:
        return Model(keys, Chain({}, {}))
    place = F.pmod(F.xxhash64("t"), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1_000_000, math.ceil(1e6 * FIT_TEXTS / n)))])
    chosen = place < share[F.col("script")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [json.dumps(x) for t in b["t"] for x in training(t, keys)]
            if rows:
                yield pd.DataFrame({"sequence": rows})

    sample = texts.where(chosen).select(F.substring("t", 1, 8 * _SEAM_CHARS).alias("t")).mapInPandas(run, "sequence string").toPandas()
    return Model(keys, Chain.fit(sorted((json.loads(x) for x in sample["sequence"]), key=str)))


def sentence_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_char, end_char of every sentence of every document."""
    docs = spread(docs.select(key, text))
    model = train(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 1 / MIN_SHARE counts and some hundred weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for b in batches:
            ks, ss, es = [], [], []
            for k, t in zip(b[key], b[text]):
                for s, e in split(t, model):
                    ks.append(k)
                    ss.append(s)
                    es.append(e)
            if ks:
                yield pd.DataFrame({key: ks, "start_char": ss, "end_char": es})

    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInPandas(run, f"`{key}` {kind}, start_char long, end_char long")
