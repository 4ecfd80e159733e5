"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine c or more lie within eps = sqrt(2 - 2c). Vectors are rotated
to principal axes (fitted on a bounded sample; any rotation is exact), sorted by their
grid cells of width eps on the leading axes, and cut into sequence intervals of
bounded size. Pairs of intervals are refined from large intervals to small ones, and a
pair whose bounding boxes are further apart than eps is skipped with all it holds.
Interval pairs that are left are compared block by block. Pairs whose blocks are
neighbours on both sides form a tile that one task compares, so that a block is shipped
once for each tile it is in and not once for each pair; a tile has as many blocks as fit
a byte bound. Of each pair, only link counts and star links leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheafline.llm.common import components, materialize, settled, ship

ship(__name__)

#: Vectors in a block, blocks below an interval of the next level, leading axes of the grid.
BLOCK, FAN, AXES = 2048, 8, 4
#: Vectors and numbers that the axes are fitted on at most, about; bytes of a tile's blocks, and tiles a side at least.
SAMPLE, SAMPLE_NUMBERS, TILE_BYTES, TILES = 20_000, 1 << 22, 64 << 20, 8


def unit(vector) -> np.ndarray | None:
    """The vector in double precision at length one; None for those that link with nothing."""
    if vector is None:
        return None
    x = np.asarray(vector, np.float64)  # a null component becomes nan
    with np.errstate(all="ignore"):
        top = np.abs(x).max() if len(x) else 0.0
        if not np.isfinite(top) or top == 0:
            return None
        x = x / top  # so that squares neither overflow nor vanish
        return x / np.sqrt((x * x).sum())


def axes(vectors: DataFrame, sample: int, seed: int = 3) -> dict[int, np.ndarray]:
    """Principal axes by dimension, of a hash sample of about `sample` vectors or SAMPLE_NUMBERS numbers.

    Dimensions that the sample lacks have no entry and keep their own axes.
    """
    n, widest = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    sample = max(1, min(sample, SAMPLE_NUMBERS // max(1, widest)))
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    picked = vectors.where(draw * n < sample).select("embedding").limit(2 * sample)
    by: dict[int, list] = {}
    for x in picked.toPandas()["embedding"]:
        x = unit(x)
        if x is not None:
            by.setdefault(len(x), []).append(x)
    return {d: np.linalg.eigh(np.cov(np.array(rows).T) if len(rows) > 1 and d > 1 else np.eye(d))[1][:, ::-1] for d, rows in by.items()}


def near_groups(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links and components of all rows of vectors by cosine in double precision.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different dimensions do not link. Rows repeated with one id are
    rows of their own and link. component_id is the smallest id reachable (nulls last).
    Other columns are not read; an empty table gives an empty result.

    Returns vec_id, n_links long, component_id, kept boolean (it is its component's id).
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    turns = rows.sparkSession.sparkContext.broadcast(axes(rows, SAMPLE))

    def place(batches):
        for pdf in batches:
            out = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"]):
                x = unit(v)
                i = None if pd.isna(i) else int(i)
                if x is None:
                    out.append((i, 0, None, [0] * AXES))
                else:
                    y = (x @ turns.value[len(x)] if len(x) in turns.value else x)[:AXES]
                    cells = np.floor(np.r_[y, np.zeros(AXES - len(y))] / eps).astype(int).tolist()
                    raw = np.array(v, np.float64)
                    small = raw.astype(np.float32)
                    out.append((i, len(x), small.tobytes() if (small == raw).all() else raw.tobytes(), cells))
            yield pd.DataFrame(out, columns=["vec_id", "dim", "data", "cells"]).astype({"vec_id": "Int64"})

    placed = materialize(rows.mapInPandas(place, "vec_id long, dim int, data binary, cells array<int>"))
    n = placed.count()

    def grouped() -> DataFrame:
        """(vec_id, row, n_links, component) of every vector that may link."""
        grid = [F.col("dim"), *(F.col("cells")[k] for k in range(AXES)), F.col("vec_id")]
        # Equal cells are dealt on by id, so that no cell is one task's. Written once, as a
        # range partitioning that is drawn again could cut elsewhere.
        ordered = placed.where("data IS NOT NULL").repartitionByRange(*grid).sortWithinPartitions(*grid)
        ordered = materialize(ordered.select("vec_id", "dim", "data", F.monotonically_increasing_id().alias("at")), n)
        # The position in the whole sequence: that in the partition, behind the partitions before it.
        ordered = ordered.withColumn("part", F.shiftright("at", 33))
        sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ordered = ordered.join(sizes.select("part", before.alias("before")), "part")
        ordered = ordered.withColumn("row", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).select("vec_id", "dim", "data", "row")
        ordered = ordered.withColumn("block", F.floor(F.col("row") / BLOCK))

        def pack(key, pdf):
            out = []
            for dim, part in pdf.sort_values("row").groupby("dim"):
                x = units(part["data"], dim)
                y = x @ turns.value[dim] if dim in turns.value else x
                data = [d if len(d) == 8 * dim else np.frombuffer(d, np.float32).astype(np.float64).tobytes() for d in part["data"]] if part["data"].map(len).nunique() > 1 else list(part["data"])
                out.append((int(key[0]), int(dim), part["row"].to_numpy(np.int64).tobytes(), b"".join(data), y.min(axis=0).tolist(), y.max(axis=0).tolist()))
            return pd.DataFrame(out, columns=["block", "dim", "rows", "data", "lo", "hi"])

        blocks = materialize(ordered.groupBy("block").applyInPandas(pack, "block long, dim int, rows binary, data binary, lo array<double>, hi array<double>"), n)
        pairs = interval_pairs(blocks.select("dim", F.col("block").alias("pos"), "lo", "hi"), eps)

        # The blocks of a tile's pairs meet in one group.
        top = -(-n // BLOCK)
        wide = F.greatest(F.lit(1), F.least(F.floor(F.lit(TILE_BYTES) / (F.col("dim") * (16 * BLOCK))), F.lit(max(1, top // TILES)).cast("long")))
        tiled = pairs.withColumn("wide", wide).withColumns({"ta": F.floor(F.col("a") / F.col("wide")), "tb": F.floor(F.col("b") / F.col("wide"))})
        tiled = materialize(tiled.select("dim", "ta", "tb", "a", "b"), top * top)
        sides = tiled.select("dim", "ta", "tb", F.explode(F.array("a", "b")).alias("block")).distinct()
        shipped = sides.join(blocks.select("dim", "block", "rows", "data"), ["dim", "block"]).select("dim", "ta", "tb", "rows", "data", "block", F.lit(None).cast("long").alias("other"))
        # What is to be compared travels along, in rows without data.
        asked = tiled.select("dim", "ta", "tb", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("data"), F.col("a").alias("block"), F.col("b").alias("other"))

        def compare(key, pdf):
            dim = int(key[0])
            ask = pdf["other"].notna()
            packed = {int(n): unpacked(r, d, dim) for n, r, d in zip(pdf["block"][~ask], pdf["rows"][~ask], pdf["data"][~ask])}
            out = [matches(*packed[a], *packed[b], a == b) for a, b in sorted(zip(pdf["block"][ask].astype(int), pdf["other"][ask].astype(int)))]
            return pd.concat(out)

        def matches(ra, xa, rb, xb, same):
            """(row, n, to) of two blocks: link counts, and a star link from each linked row."""
            names = ra if same else np.r_[ra, rb]
            links, labels = np.zeros(len(names), np.int64), np.arange(len(names))
            shift = 0 if same else len(ra)
            for k in range(0, len(ra), 256):
                i, j = np.nonzero(xa[k : k + 256] @ xb.T >= cosine)
                i, j = i + k, j + shift
                if same:
                    i, j = i[i < j], j[i < j]
                links += np.bincount(i, minlength=len(names)) + np.bincount(j, minlength=len(names))
                while len(i):
                    p, q = labels[i], labels[j]
                    if (p == q).all():
                        break
                    low = np.minimum(p, q)
                    for at in (p, q, i, j):
                        np.minimum.at(labels, at, low)
                    while (labels[labels] != labels).any():
                        labels = labels[labels]
            while (labels[labels] != labels).any():
                labels = labels[labels]
            at = np.flatnonzero(links)
            return pd.DataFrame({"row": names[at], "n": links[at], "to": names[labels[at]]})

        found = materialize(shipped.unionByName(asked).groupBy("dim", "ta", "tb").applyInPandas(compare, "row long, n long, to long"))
        counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
        member = components(found.where("row <> to").select(F.col("row").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("row"), "component")
        return ordered.select("vec_id", "row").join(counts, "row", "left").join(member, "row", "left").withColumn("component", F.coalesce("component", "row"))

    ids = settled(rows.sparkSession, grouped, n)
    least = ids.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    valid = ids.join(least, "component").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id")
    other = placed.where("data IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(other).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def unpacked(rows: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of a packed block."""
    kind = np.float32 if len(data) == len(rows) // 8 * dim * 4 else np.float64
    return np.frombuffer(rows, np.int64), normal(np.frombuffer(data, kind).reshape(-1, dim))


def normal(x: np.ndarray) -> np.ndarray:
    """Rows of x in double precision at length one."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def units(data, dim: int) -> np.ndarray:
    """Packed vectors, each of float32 or float64, at length one."""
    return normal(np.stack([np.frombuffer(d, np.float32 if len(d) == 4 * dim else np.float64).astype(np.float64) for d in data]))


def interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(dim, a, b), a <= b, of every two blocks whose boxes are within eps.

    blocks: dim, pos, lo, hi. Blocks are gathered into intervals of FAN, FAN^2, ...
    neighbours. From the top, a pair of intervals that are near enough is replaced by
    the pairs of their parts; only parts of pairs that are left are ever paired.
    """
    gaps = F.zip_with(F.zip_with("a_lo", "b_hi", lambda x, y: x - y), F.zip_with("b_lo", "a_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d * d) <= eps * eps + 1e-9  # the margin covers rounding
    boxes = [blocks]
    top = (blocks.agg(F.max("pos")).first()[0] or 0) + 1
    while top > FAN:
        up = boxes[-1].groupBy("dim", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))  # FAN boxes at most
        lo = F.aggregate("los", F.col("los")[0], lambda s, x: F.zip_with(s, x, lambda p, q: F.least(p, q)))
        hi = F.aggregate("his", F.col("his")[0], lambda s, x: F.zip_with(s, x, lambda p, q: F.greatest(p, q)))
        boxes.append(materialize(up.select("dim", "pos", lo.alias("lo"), hi.alias("hi")), top))
        top = -(-top // FAN)

    def side(level: DataFrame, x: str) -> DataFrame:
        return level.select("dim", F.col("pos").alias(x), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"))

    pairs = side(boxes[-1], "a").join(side(boxes[-1], "b"), "dim").where((F.col("a") <= F.col("b")) & near).select("dim", "a", "b")  # FAN intervals a dimension at most
    for level in boxes[-2::-1]:
        parts = lambda x: F.explode(F.sequence(F.col(x) * FAN, F.col(x) * FAN + FAN - 1))
        pairs = materialize(pairs).select("dim", parts("a").alias("a"), "b").select("dim", "a", parts("b").alias("b")).where("a <= b")
        pairs = pairs.join(side(level, "a"), ["dim", "a"]).join(side(level, "b"), ["dim", "b"]).where(near).select("dim", "a", "b")
    return pairs
