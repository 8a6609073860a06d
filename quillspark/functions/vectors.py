"""Vector functions."""

from __future__ import annotations

import math
import re
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSION = 384


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length; empty or null vectors give 0."""
    pad = F.zip_with(F.coalesce(a, F.array().cast("array<double>")).cast("array<double>"), F.coalesce(b, F.array().cast("array<double>")).cast("array<double>"), lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(pad, F.lit(0.0), lambda s, x: s + x)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    """Token counts hashed by BLAKE2b into 384 buckets, at unit length; no tokens give the zero vector.

    Every distinct token of a batch is hashed once, and the counts of all its texts are one matrix.
    """
    found = [re.findall("[a-z0-9]+", (t or "").lower()) for t in text]
    place = {t: int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "big") % DIMENSION for t in {t for ts in found for t in ts}}
    row = np.repeat(np.arange(len(found)), [len(ts) for ts in found])
    column = np.fromiter((place[t] for ts in found for t in ts), np.int64, len(row))
    counts = np.bincount(row * DIMENSION + column, minlength=len(found) * DIMENSION).reshape(len(found), DIMENSION).astype(float)
    length = np.sqrt((counts * counts).sum(1, keepdims=True))
    return pd.Series(list(counts / np.where(length > 0, length, 1.0)), dtype=object)


def blocked_topk(queries: DataFrame, vectors: DataFrame, k: int, query_rows: int = 2_048, vector_rows: int = 50_000) -> DataFrame:
    """query_id, vec_id, sim, rank: the k vectors (vec_id, v) of highest inner product for every query (query_id, q), itself left out.

    Exact: each block of queries meets each block of vectors in a task of its own (one matrix product), which
    keeps k rows a query; these are merged. Inner products are rounded to six places, ties go by id.
    """
    nq, nv = queries.count(), vectors.count()
    qp, vp = max(1, math.ceil(nq / query_rows)), max(1, math.ceil(nv / vector_rows))
    vp = max(vp, math.ceil(queries.sparkSession.sparkContext.defaultParallelism / qp))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "q", place("query_id", qp).alias("qp"), every(vp).alias("vp")).repartition(qp * vp, "qp", "vp")
    right = vectors.select("vec_id", "v", place("vec_id", vp).alias("vp"), every(qp).alias("qp")).repartition(qp * vp, "qp", "vp")

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "sim": []})
        v = v.sort_values("vec_id")
        sims = np.stack(q["q"].to_numpy()).astype(float) @ np.stack(v["v"].to_numpy()).astype(float).T
        sims = np.round(sims, 6)
        sims[q["query_id"].to_numpy()[:, None] == v["vec_id"].to_numpy()[None, :]] = -np.inf
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # stable: equal ones stay in order of id
        row = np.repeat(np.arange(len(q)), top.shape[1])
        out = pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "vec_id": v["vec_id"].to_numpy()[top.ravel()], "sim": sims[row, top.ravel()]})
        return out[np.isfinite(out["sim"])]

    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *vectors.schema]}
    met = left.groupBy("qp", "vp").cogroup(right.groupBy("qp", "vp")).applyInPandas(meet, f"query_id {kind['query_id']}, vec_id {kind['vec_id']}, sim double")
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "vec_id"))).where(F.col("rank") <= k)
