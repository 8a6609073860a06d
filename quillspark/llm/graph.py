"""Connected components by minimum labels, distributed; the lineage is cut through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a, b) -> id, comp: comp is the least id of its component. Ids without an edge are left out.

    Each round takes the least label among the neighbours and then the label's own label, so chains
    shrink geometrically. ``most`` only guards against an endless loop; reaching it raises.
    """
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"))
    before = labels = stored(labels)
    for _ in range(most):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("comp", "c").alias("new"), F.col("comp").alias("old"))
        jump = step.join(labels.select(F.col("id").alias("new"), F.col("comp").alias("up")), "new", "left")
        new = stored(jump.select("id", F.least("new", F.coalesce("up", "new")).alias("comp"), "old"))
        discard(before)
        if new.where("comp <> old").isEmpty():
            return new.select("id", "comp")
        before, labels = new, new.select("id", "comp")
    raise RuntimeError("components did not settle")


def block_pairs(rows: DataFrame, block: str, key: str, carry: list[str] = [], most: int = 1_000) -> DataFrame:  # noqa: B006
    """key_a < key_b (and the carried columns of both) of every two rows that share a block; a pair may come more than once.

    A block of any size spreads over tasks: it is cut into squares of about ``most`` by ``most`` rows, each joined apart.
    """
    parts = rows.groupBy(block).agg(F.count("*").alias("_n")).where("_n > 1").select(block, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    placed = rows.join(parts, block).withColumn("_part", F.expr(f"cast(pmod(xxhash64(`{key}`), _parts) as int)"))
    side = lambda p: [F.col(c).alias(f"{c}_{p}") for c in carry]
    left = placed.select(block, F.col(key).alias("_a"), *side("x"), F.col("_part").alias("_i"), F.explode(F.expr("sequence(_part, _parts - 1)")).alias("_j"))
    right = placed.select(block, F.col(key).alias("_b"), *side("y"), F.explode(F.expr("sequence(0, _part)")).alias("_i"), F.col("_part").alias("_j"))
    met = left.join(right, [block, "_i", "_j"]).where("(_i < _j or _a < _b) and _a <> _b")
    turn = F.col("_a") > F.col("_b")
    return met.select(F.least("_a", "_b").alias("key_a"), F.greatest("_a", "_b").alias("key_b"), *[x for c in carry for x in (F.when(turn, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")).alias(f"{c}_a"), F.when(turn, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(f"{c}_b"))])
