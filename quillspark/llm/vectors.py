"""Most similar vectors for every vector, by additive quantisation.

The index is fitted on a bounded sample: two coarse codebooks (a cell is a word of the first and one of the
second, which quantises what the first leaves over) and, on what both leave over, full-dimensional residual
codebooks. The number of cells follows the number of vectors. Where the sample would be too small a share of
them to know their clusters, the executors learn the first codebook from a fixed share. Every vector is encoded by beam search over all residual codebooks; its codes, the squared norm of their
sum and the vector itself go to files by cell in the shared folder, a large cell to several. The search runs
over those files: each query builds its lookup table of inner products with all codewords, scores the vectors of
the cells it probes by table lookups and stored norms, and reranks the best exactly, a bounded number of
candidates at a time. A block of queries of one cell probes the cells that most of them are near to; a query also
meets the cells that are almost as near to it as its nearest, whatever the others of its block are near to. Only vectors are shuffled, once, by cell; candidates are never materialised as rows.

Exact copies of one vector (however many) are represented by their first ids; the others take those as
neighbours, so no group of copies is paired with itself. Defined results: null, empty, all-zero,
non-finite vectors and vectors of another length take no part; rows that repeat whole count once; equal
similarities are ordered by id.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, release, shared_dir, spread, stored

FIT_ROWS = 12_288  # bound of the sample the codebooks are fitted on
CELL_ROWS = 350  # wanted vectors in a cell
FIRST_WORDS = 2_048  # bound of the first coarse codebook; FIT_ROWS / 8 bounds it too
FILE_ROWS = 8_192  # vectors of a file; a larger cell has several
AT_ONCE = 16_384  # candidates that a block of queries meets at a time
STAGES, WORDS, BEAM = 6, 64, 4
PROBES, RERANK = 10, 384
NEAR, ALMOST = 16, 0.3  # of a query's so many nearest cells, one is almost as near as the nearest if it lacks less than this share of what the nearest is above the mean
LEARN_BEYOND = 8  # times FIT_ROWS vectors, from which the executors learn the cells
LEARN_SHARE, LEARN_SLICES, LEARN_ROUNDS = 0.6, 4, 8  # from that share of the vectors, a slice of it in each round of k-means
MOST_CELLS = 65_536  # bound of the learned codebook, which is broadcast; from there on the second codebook grows
_ANTI_ROWS = 1_000_000  # ids of surplus copies up to here are broadcast


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=k)
        starts = np.r_[0, counts.cumsum()[:-1]]
        full = counts > 0
        c[full] = np.add.reduceat(x[order], starts[full], axis=0) / counts[full, None]
        empty = np.flatnonzero(~full)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    return c


@dataclass
class Codebooks:
    first: np.ndarray  # k1 x d
    second: np.ndarray  # k2 x d; cell = place in first * k2 + place in second
    words: np.ndarray  # (stages * words) x d, full-dimensional

    @classmethod
    def fit(cls, sample: np.ndarray, n: int, seed: int = 7, first: np.ndarray | None = None) -> Codebooks:
        rng = np.random.default_rng(seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        cells = max(1, n // CELL_ROWS)
        k1 = int(min(cells, FIRST_WORDS, max(1, len(x) // 8))) if first is None else len(first)
        k2 = int(min(-(-cells // k1), max(1, len(x) // 8)))
        first = _by_nearness(_kmeans(x, k1, 8, rng) if first is None else first).astype(np.float32)
        rest = x - first[_closest(x, first)]
        second = _kmeans(rest, k2, 8, rng).astype(np.float32) if k2 > 1 else np.zeros((1, x.shape[1]), np.float32)
        rest = rest - second[_closest(rest, second)]
        books = []
        for _ in range(STAGES):
            book = _kmeans(rest, min(WORDS, len(rest)), 5, rng)
            book = np.vstack([book, np.zeros((WORDS - len(book), x.shape[1]), x.dtype)])
            rest = rest - book[_closest(rest, book)]
            books.append(book)
        return cls(first, second, np.vstack(books).astype(np.float32))

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def coarse_dots(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Inner products of x with the decoded ``cells``."""
        return (x @ self.first.T)[:, cells // len(self.second)] + (x @ self.second.T)[:, cells % len(self.second)]

    def place(self, x: np.ndarray) -> np.ndarray:
        one = _closest(x, self.first)
        if len(self.second) == 1:
            return one
        return one * len(self.second) + _closest(x - self.first[one], self.second)

    def probes(self, x: np.ndarray, own: int, most: int) -> tuple[list[int], dict[int, np.ndarray]]:
        """Of a block of queries of one cell: the cells all of them meet, by votes of each query's nearest ones, then by
        nearness; and the further cells that single queries meet, with the places of those queries."""
        k2 = len(self.second)
        near = x @ self.first.T - 0.5 * (self.first * self.first).sum(1)
        ids = np.arange(near.shape[1])
        if k2 > 1:  # both parts of the cells under the first words that most queries are near to
            heads = np.argsort(-self._votes(near, 8), kind="stable")[: 4 * most]
            ids = (heads[:, None] * k2 + np.arange(k2)[None, :]).ravel()
            norm = ((self.first[heads][:, None, :] + self.second[None, :, :]) ** 2).sum(2).ravel()
            near = self.coarse_dots(x, ids) - 0.5 * norm
        votes = self._votes(near, 4)
        chosen = {*ids[np.argsort(-votes, kind="stable")[:most]].tolist(), own}
        p = min(max(NEAR, most), near.shape[1])
        top = np.argpartition(-near, p - 1, axis=1)[:, :p]
        score = np.take_along_axis(near, top, 1)
        best = score.max(1)
        query, at = np.nonzero(score >= (best - ALMOST * (best - near.mean(1)))[:, None])
        cell = ids[top[query, at]]
        order = np.argsort(cell, kind="stable")
        cells, starts = np.unique(cell[order], return_index=True)
        return sorted(chosen), {c: q for c, q in zip(cells.tolist(), np.split(query[order], starts[1:])) if c not in chosen}

    @staticmethod
    def _votes(near: np.ndarray, each: int) -> np.ndarray:
        p = min(each, near.shape[1])
        return np.bincount(np.argpartition(-near, p - 1, axis=1)[:, :p].ravel(), minlength=near.shape[1]) + near.mean(0) * 1e-3

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cell, codes (n x stages), squared norm of the decoded vector, by beam search over all codebooks."""
        n = len(x)
        cell = self.place(x)
        base = self.first[cell // len(self.second)] + self.second[cell % len(self.second)]
        dots = x @ self.words.T  # with every codeword
        gram = self.words @ self.words.T
        cross = base @ self.words.T
        w2 = np.diag(gram)
        along = np.einsum("nd,nd->n", x, base)
        # err = |decoded|^2 - 2 x.decoded, kept for each beam
        err = ((base * base).sum(1) - 2 * along)[:, None]
        codes = np.zeros((n, 1, STAGES), np.int64)
        rows = np.arange(n)[:, None]
        for m in range(STAGES):
            at = slice(m * WORDS, (m + 1) * WORDS)
            gain = (w2[at] + 2 * cross[:, at] - 2 * dots[:, at])[:, None, :]
            for j in range(m):
                gain = gain + 2 * gram[codes[:, :, j] + j * WORDS, at]
            total = (err[:, :, None] + gain).reshape(n, -1)
            keep = min(BEAM, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            err = total[rows, best]
            codes = codes[rows, best // WORDS].copy()
            codes[:, :, m] = best % WORDS
        first = err.argmin(1)
        final = codes[np.arange(n), first]
        dot = along + np.take_along_axis(dots, final + np.arange(STAGES) * WORDS, 1).sum(1)
        return cell, final.astype(np.uint8), (err[np.arange(n), first] + 2 * dot).astype(np.float32)


def _closest(x: np.ndarray, c: np.ndarray, at_once: int = 8_000_000) -> np.ndarray:
    half, step = 0.5 * (c * c).sum(1), max(1, at_once // len(c))
    return np.concatenate([(x[s : s + step] @ c.T - half).argmax(1) for s in range(0, max(1, len(x)), step)])


def _learned(rows: DataFrame, n: int, d: int) -> np.ndarray:
    """Centres of the cells, by rounds of k-means on the executors, each over another slice of the vectors; what a round found counts half in the next. The driver holds the centres only."""
    spark = rows.sparkSession
    k = min(n // CELL_ROWS, MOST_CELLS)
    mark = F.pmod(F.xxhash64(F.lit("learn"), "id"), F.lit(1_000_000_000))
    read = lambda vs: np.frombuffer(b"".join(vs), np.float16).reshape(-1, d).astype(np.float32)

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array(b["v"].tolist(), np.float32).reshape(-1, d)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({"mark": b["mark"], "v": [r.tobytes() for r in v.astype(np.float16)]})

    sample = stored(spread(rows.select(mark.alias("mark"), "v").where(F.col("mark") < int(1e9 * LEARN_SHARE))).mapInPandas(unit, "mark long, v binary"))
    centres = read(sample.where(F.col("mark") < math.ceil(1e9 * k / n)).orderBy("mark").toArrow()["v"].to_pylist())
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / (CELL_ROWS * 256)))
    weights = np.zeros(len(centres), np.float32)
    for k in range(LEARN_ROUNDS):
        sent = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"cell": _closest(read(b["v"]), sent.value), "v": b["v"]})

        def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, tuple[np.ndarray, int]] = {}
            for b in batches:
                order = np.argsort(b["cell"].to_numpy(), kind="stable")
                cells, starts = np.unique(b["cell"].to_numpy()[order], return_index=True)
                parts = np.add.reduceat(read(b["v"])[order], starts, axis=0)
                for c, part, size in zip(cells.tolist(), parts, np.diff(np.r_[starts, len(order)]).tolist()):
                    total, count = sums.get(c, (0.0, 0))
                    sums[c] = (total + part, count + size)
            if sums:
                yield pd.DataFrame({"cell": list(sums), "size": [m for _, m in sums.values()], "v": [(t / m).astype(np.float32).tobytes() for t, m in sums.values()]})

        part = sample.where(F.pmod(F.hash("mark"), F.lit(LEARN_SLICES)) == k % LEARN_SLICES).select("v")
        got = part.mapInPandas(place, "cell int, v binary").repartition(tasks, "cell").mapInPandas(mean, "cell int, size int, v binary").toArrow()
        at, size = got["cell"].to_numpy(), got["size"].to_numpy().astype(np.float32)
        weights *= 0.5
        centres = centres.copy()  # a centre without vectors stays
        old = (weights[at] / (weights[at] + size))[:, None]
        centres[at] = old * centres[at] + (1 - old) * np.frombuffer(b"".join(got["v"].to_pylist()), np.float32).reshape(-1, d)
        weights[at] += size
        sent.destroy()
        del got
        release(spark)  # the shuffled vectors of the round
    discard(sample)
    return centres


def _by_nearness(c: np.ndarray) -> np.ndarray:
    """Order the cells so that neighbours in number are neighbours in space (halving along the main direction)."""
    if len(c) <= 2:
        return c
    d = c - c.mean(0)
    v = d[np.argmax((d * d).sum(1))]
    for _ in range(8):
        v = d.T @ (d @ v)
        v = v / (np.linalg.norm(v) + 1e-12)
    order = np.argsort(d @ v, kind="stable")
    half = len(c) // 2
    return np.vstack([_by_nearness(c[order[:half]]), _by_nearness(c[order[half:]])])


def _pack(v: np.ndarray) -> list[bytes]:
    """Rows as bytes; in half precision where that loses nothing."""
    half = v.astype(np.float16)
    same = (half.astype(np.float32) == v).all(1)
    return [h.tobytes() if s else r.tobytes() for h, r, s in zip(half, v, same)]


def _unpack(rows: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(rows), d), np.float32)
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, np.float16 if len(r) == 2 * d else np.float32)
    return out


def usable(chunks: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    v = F.col(vector)
    good = (F.size(v) == d) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return chunks.where(good).select(F.col(key).alias("id"), v.cast("array<float>").alias("v"))


class _Files:
    """Files of cells read from the shared folder; the latest stay in memory up to a bound."""

    def __init__(self, path: str, d: int, most: int = 96_000_000):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.d, self.most, self.size = d, most, 0
        self.kept: OrderedDict[str, tuple] = OrderedDict()
        self.listed: dict[int, list[str]] = {}

    def of(self, cell: int) -> list[str]:
        from pyarrow import fs

        if cell not in self.listed:
            if len(self.listed) > 100_000:
                self.listed.clear()
            found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/cell={cell}", allow_not_found=True))
            self.listed[cell] = sorted(i.path for i in found if i.path.endswith(".parquet"))
        return self.listed[cell]

    def get(self, path: str):
        import pyarrow.parquet as pq

        if path in self.kept:
            self.kept.move_to_end(path)
            return self.kept[path]
        with self.fs.open_input_file(path) as f:
            t = pq.ParquetFile(f).read(columns=["id", "v", "codes", "norm2"])
        ids, first = np.unique(np.array(t["id"].to_pylist(), dtype=object), return_index=True)  # repeated rows count once
        v = _unpack(t["v"].take(first).to_pylist(), self.d)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(-1, STAGES)[first]
        got = ids, v, codes.astype(np.int64) + np.arange(STAGES) * WORDS, t["norm2"].to_numpy()[first]
        self.kept[path] = got
        self.size += got[1].nbytes
        while self.size > self.most and len(self.kept) > 1:
            _, old = self.kept.popitem(last=False)
            self.size -= old[1].nbytes
        return got


def _groups(files: list[tuple[int, str]], store: _Files, most: int):
    """The files, read in groups of about ``most`` vectors."""
    now, size = [], 0
    for cell, path in files:
        got = store.get(path)
        if now and size + len(got[0]) > most:
            yield now
            now, size = [], 0
        now.append((cell, got))
        size += len(got[0])
    if now:
        yield now


def _search_files(store: _Files, books: Codebooks, files: list[tuple[int, tuple]], k: int, probes: int, rerank: int, block: int = 256):
    """The nearest of all vectors of ``files``: blocks of them meet their cells in turn; then each cell that single ones meet is read once for all."""
    mine: list[str] = []
    blocks: list[np.ndarray] = []
    best: list[list[tuple[float, str]]] = []
    alone: dict[int, list[np.ndarray]] = {}
    for cell, (ids, q, _, _) in files:
        for s in range(0, len(q), block):
            x = q[s : s + block]
            together, single = books.probes(x, cell, probes)
            for c, some in single.items():
                alone.setdefault(c, []).append(some + len(mine))
            best += _met(store, books, x, together, k, rerank)
            blocks.append(x)
            mine += ids[s : s + block].tolist()
    x = np.concatenate(blocks)
    for c in sorted(alone):  # few candidates each: no table is needed to choose among them
        for oid, v, _, _ in map(store.get, store.of(c)):
            queries = np.concatenate(alone[c])
            for some in np.split(queries, range(block, len(queries), block)):
                sims = x[some] @ v.T
                few = np.argpartition(-sims, k + 8, axis=1)[:, : k + 9] if len(oid) > k + 9 else np.tile(np.arange(len(oid)), (len(some), 1))
                exact = np.einsum("nkd,nd->nk", v[few], x[some], dtype=np.float64, casting="same_kind")
                for i, es, js in zip(some.tolist(), exact.tolist(), few):
                    best[i] += zip(es, oid[js])
    for i, own in enumerate(mine):
        seen: dict[str, float] = {}  # repeated rows count once
        for e, o in sorted(best[i], key=lambda r: (-round(r[0], 7), r[1])):
            if o != own and o not in seen:
                seen[o] = e
                if len(seen) == k:
                    break
        for rank, (o, e) in enumerate(seen.items(), 1):
            yield own, o, rank, e


def _met(store: _Files, books: Codebooks, x: np.ndarray, cells: list[int], k: int, rerank: int) -> list[list[tuple[float, str]]]:
    """Of each query of a block, its best candidates in ``cells`` with their exact similarities."""
    table = x @ books.words.T
    best: list[list[tuple[float, str]]] = [[] for _ in range(len(x))]
    for others in _groups([(c, f) for c in cells for f in store.of(c)], store, AT_ONCE):
        oid = np.concatenate([o[0] for _, o in others])
        v = np.concatenate([o[1] for _, o in others]) if len(others) > 1 else others[0][1][1]
        coarse = books.coarse_dots(x, np.array([c for c, _ in others]))
        # Lookup-table scoring: 2 x.decoded - |decoded|^2 orders as the distance to the decoded vector does.
        score = np.empty((len(x), len(oid)), np.float32)
        at = 0
        for g, (_, (_, _, codes, norm2)) in enumerate(others):
            part = score[:, at : at + len(norm2)]
            part[:] = coarse[:, g][:, None]
            for m in range(codes.shape[1]):
                part += np.take(table, codes[:, m], axis=1)
            part *= 2
            part -= norm2
            at += len(norm2)
        take = min(rerank, at)
        top = np.argpartition(-score, take - 1, axis=1)[:, :take] if take < at else np.tile(np.arange(at), (len(x), 1))
        for i in range(len(x)):
            near = top[i]
            sims = v[near] @ x[i]
            few = near[np.argpartition(-sims, k + 8)[: k + 9]] if len(near) > k + 9 else near
            exact = v[few].astype(np.float64) @ x[i].astype(np.float64)
            best[i] += [(float(e), oid[j]) for e, j in zip(exact, few)]
    return best


def _uri(spark, path: str) -> str:
    """The path with the scheme of its file system, as pyarrow wants it: executors open it without Hadoop's settings."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    if full.startswith("file:"):
        return "file://" + full[5:].replace("//", "/") if not full.startswith("file:///") else full
    return "s3" + full[3:] if full.startswith(("s3a:", "s3n:")) else full


def nearest(chunks: DataFrame, key: str, vector: str, d: int, k: int = 5, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """id, neighbour, rank, similarity (cosine): the ``k`` most similar others of every usable vector."""
    spark = chunks.sparkSession
    rows = usable(chunks, key, vector, d)
    # Copies: the first k + 1 ids of each distinct vector stand for it.
    digest = rows.select("id", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b")).alias("h")).distinct()
    ranked = digest.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id")))
    crowded = digest.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    surplus_n, n = (digest.select("h").join(crowded, "h", "left_semi").count(), digest.count())
    if n == 0:
        return spark.createDataFrame([], "id string, neighbour string, rank int, similarity double")
    if surplus_n:
        members = ranked.join(crowded, "h", "left_semi")
        surplus = members.where(F.col("r") > k + 1)
        copies = surplus.select("id", "h").join(members.where(F.col("r") <= k).select("h", F.col("id").alias("neighbour"), F.col("r").alias("rank")), "h").select("id", "neighbour", "rank", F.lit(1.0).alias("similarity"))
        out = surplus.select("id")
        rows = rows.join(F.broadcast(out) if surplus_n <= _ANTI_ROWS else out, "id", "left_anti")
    share = min(1_000_000, math.ceil(1e6 * FIT_ROWS / n))  # by the hash of the id: about FIT_ROWS rows, the same in every run
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("v").toArrow()["v"].combine_chunks()
    first = _learned(rows, n, d) if n > LEARN_BEYOND * FIT_ROWS else None
    books = Codebooks.fit(sample.flatten().to_numpy().reshape(-1, d).astype(np.float32), n, first=first)
    del sample

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 2048):
                part = b.iloc[s : s + 2048]
                v = np.array(part["v"].tolist(), np.float32).reshape(-1, d)
                cell, codes, norm2 = books.encode(v / np.linalg.norm(v, axis=1, keepdims=True))
                yield pd.DataFrame({"cell": cell, "id": part["id"].to_numpy(), "v": _pack(v), "codes": [c.tobytes() for c in codes], "norm2": norm2})

    path = shared_dir(spark)
    encoded = spread(rows).mapInPandas(encode, "cell int, id string, v binary, codes binary, norm2 float")
    encoded.hint("rebalance", "cell").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(path)  # a cell too large for one task is split
    where = _uri(spark, path)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, books = _Files(where, d), sent.value
        for b in batches:
            files = [(int(cell), f"{store.path}/cell={int(cell)}/{file}") for cell, file in zip(b["cell"], b["file"])]
            for some in _groups(files, store, FILE_ROWS):  # what is held at a time
                found = list(_search_files(store, books, some, k, probes, rerank))
                if found:
                    a, o, r, s = zip(*found)
                    yield pd.DataFrame({"id": a, "neighbour": o, "rank": r, "similarity": s})

    sent = spark.sparkContext.broadcast(books)  # at most MOST_CELLS + FIT_ROWS / 8 + 384 vectors
    # A task takes a run of neighbouring cells, so it reads few files twice; a cell of many files goes to several tasks.
    written = spark.read.schema("id string, cell int").parquet(path)
    files = written.select("cell", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).distinct()
    tasks = max(spark.sparkContext.defaultParallelism * 3, math.ceil(n / (CELL_ROWS * 16)))
    out = files.repartitionByRange(tasks, "cell", "file").mapInPandas(search, "id string, neighbour string, rank int, similarity double")
    return out.unionByName(copies) if surplus_n else out


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Undirected pairs: one is among the other's most similar."""
    return found.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()
