"""Encoding of a whole corpus with the vocabulary of a public byte-level BPE tokenizer.

Corpus-level merge replay: the distinct words of a batch lie end to end in one array of tokens. An
inverted index maps each adjacent token pair to the positions where it stands; merges are applied in
rank order to all positions of a pair at once, and only the two neighbours of each merged position
are updated in the index. Words never touch each other, so every task replays the merges for its own
share of the corpus and nothing is shuffled; words seen in an earlier batch are not replayed again.

Defined results: null and empty texts give the empty list; text that looks like a special token is
plain text; no special tokens are added.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

# Fixed value: the pattern that parts text into words before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_MEMO_MOST = 400_000


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 as it is, the rest from 256 on."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


def read_tables(path: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The ids of the bytes, and the merges (left, right, made) in rank order, of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = (p.split(" ") if isinstance(p, str) else p for p in model["merges"])
    return [vocab[c] for c in _byte_letters()], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]


class MergeReplay:
    """The vocabulary, and the replay of its merges over many words at once."""

    def __init__(self, path: str = DEFAULT_VOCABULARY, tables: tuple[list[int], list[tuple[int, int, int]]] | None = None):
        byte_id, merges = tables or read_tables(path)
        self.byte_id = byte_id
        self.merges = {(a, b): (rank, made) for rank, (a, b, made) in enumerate(merges)}
        self.memo: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        """Replay all merges over ``words`` and keep their ids."""
        merges, byte_id = self.merges, self.byte_id
        order = list(words)
        tok: list[int] = []
        starts: list[int] = []
        for w in order:
            starts.append(len(tok))
            tok.extend([byte_id[b] for b in w.encode("utf-8", "surrogatepass")])
            tok.append(-1)  # no pair crosses the end of a word
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            pair = (tok[i], tok[i + 1])
            if pair in merges:
                index.setdefault(pair, []).append(i)
        heap = [(merges[p][0], p) for p in index]
        heapq.heapify(heap)
        while heap:
            _, pair = heapq.heappop(heap)
            at = index.pop(pair, None)
            if at is None:
                continue
            a, b = pair
            made = merges[pair][1]
            at.sort()
            for i in at:
                j = nxt[i]
                if tok[i] != a or j >= n or tok[j] != b:
                    continue
                tok[i], tok[j] = made, -2
                k = nxt[i] = nxt[j]
                if k < n:
                    prv[k] = i
                    right = (made, tok[k])
                    if right in merges:
                        if right not in index:
                            index[right] = []
                            heapq.heappush(heap, (merges[right][0], right))
                        index[right].append(i)
                h = prv[i]
                if h >= 0:
                    left = (tok[h], made)
                    if left in merges:
                        if left not in index:
                            index[left] = []
                            heapq.heappush(heap, (merges[left][0], left))
                        index[left].append(h)
        for w, s in zip(order, starts):
            ids, i = [], s
            while tok[i] != -1:
                ids.append(tok[i])
                i = nxt[i]
            self.memo[w] = ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        import regex

        find = regex.compile(PATTERN).findall
        parted = [find(t) if t else [] for t in texts]
        new = {w for words in parted for w in words if w not in self.memo}
        if len(self.memo) + len(new) > _MEMO_MOST:  # the memo only saves time
            self.memo.clear()
            new = {w for words in parted for w in words}
        if new:
            self.learn(new)
        memo = self.memo
        return [np.array([i for w in words for i in memo[w]], dtype=np.int32) for words in parted]


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, chars: int = 4_000_000) -> DataFrame:
    """``key`` and ids (array<int>) of every document; map-only.

    ``chars``: texts are replayed in slices of about so many characters, which bounds memory. The vocabulary is read by
    the driver and broadcast (a few MB); executors need no file.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_tables(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replay = MergeReplay(tables=sent.value)
        for b in batches:
            keys, texts = b[key], list(b[text])
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t) if t else 0
                if size >= chars or i == len(texts) - 1:
                    yield pd.DataFrame({key: keys.iloc[start : i + 1].to_numpy(), "ids": replay.encode(texts[start : i + 1])})
                    start, size = i + 1, 0

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInPandas(run, f"`{key}` {kind}, ids array<int>")
