"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

Vectors of a label are dealt to cells by their nearest pivot (pivots: a bounded sample). Each vector lives in its home
cell and visits the cells whose pivots are nearly as close. A vector is stored as the sign bits of its randomly rotated
residual from the home pivot, the residual's length and the inner product of code and residual. From these a visitor
gets an unbiased estimate of its inner product with each resident and a confidence bound; pairs whose upper bound
misses the threshold are done, all others are computed anew from the vectors in double precision, and only that
decides. Equal vectors are one weighted vector. Cells with more residents or visitors than a block holds are compared
block by block, in as many groups as there are pairs of blocks, so no group grows with the data. Groups give counts
and a spanning forest, never all links.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors without a label, link
with nothing (no links, own component); vectors of different lengths are never compared. Rows that repeat an id with
equal vectors are separate vectors that link; a null id counts as a partner and has a null component. An empty table
gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

THRESHOLD = 0.93
#: Pivots over all labels at most: they are broadcast. Labels with fewer vectors than this are one cell.
PIVOTS, ONE_CELL = 65_536, 512
#: Numbers in all pivots at most, 64 MB: longer vectors have fewer pivots.
PIVOT_VALUES = 1 << 23
#: A vector visits pivots whose inner product is this much below its home's, at most.
MARGIN = 0.16
#: Width of the confidence bound in standard deviations.
SIGMAS = 4.0
BLOCK = 1024
#: Products of vectors and pivots that are held at once, 16 MB.
TILE = 1 << 21
SEED = 7


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(residual: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign bits packed, correction factor <code, residual/|residual|>, |residual|) of each row."""
    length = np.linalg.norm(residual, axis=1)
    turned = (residual / np.maximum(length, 1e-30)[:, None]) @ turn.T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1]), length


def estimate(queries: np.ndarray, pivot: np.ndarray, codes: np.ndarray, factor: np.ndarray, length: np.ndarray, resident_pivot: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of ``queries`` (rows) with the coded residents (columns), and half a bound's width.

    <u, v> = <u, c> + <v - c, c> + |u - c| |v - c| <q, o>, and <code, q> / factor estimates <q, o> without bias.
    """
    d = queries.shape[1]
    rest = queries - pivot
    away = np.linalg.norm(rest, axis=1)
    bits = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    dot = ((rest / np.maximum(away, 1e-30)[:, None]) @ turn.T).astype(np.float32) @ bits.T / np.sqrt(d)
    safe = np.maximum(factor, 1e-6)
    scale = away[:, None] * length[None, :]
    width = SIGMAS * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / np.sqrt(max(1, d - 1))
    return (queries @ pivot)[:, None] + resident_pivot[None, :] + scale * dot / safe, scale * width + 1e-6


def linked(queries: np.ndarray, residents: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs in ``near``, those whose cosine in double precision reaches the threshold. Rows have length 1."""
    i, j = np.nonzero(near)
    keep = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 200_000):
        s = slice(a, a + 200_000)
        keep[s] = np.einsum("ij,ij->i", queries[i[s]], residents[j[s]]) >= THRESHOLD
    return i[keep], j[keep]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the class of their vector (null if it can't link), and the classes with weights."""
    v = F.col("v")
    sound = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    key = F.md5(F.concat_ws(",", F.lit("v"), F.col("label"), F.col("v").cast("array<string>")))
    rows = rows.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), key))
    found = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"), F.first("label").alias("label"))
    return rows.select("id", "key"), found.withColumn("group", F.concat_ws("/", F.size("v").cast("string"), F.col("label"))).drop("label")


def pivots(found: DataFrame) -> dict[str, np.ndarray]:
    """Unit vectors per group: at most about PIVOTS (and PIVOT_VALUES numbers) in all, more for larger groups. Groups of one cell have none."""
    sizes = found.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    facts = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    total, most = facts["n"], max(1, min(PIVOTS, PIVOT_VALUES // max(1, facts["dim"] or 1)))
    share = sizes.where(F.col("n") > ONE_CELL).withColumn("rate", F.least(F.least(4 * F.sqrt("n"), F.lit(most) * F.col("n") / max(1, total)) / F.col("n"), F.lit(1.0)))
    chosen = found.join(share, "group").where(F.pmod(F.xxhash64(F.lit(SEED), "key"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("group", "key", "v").toPandas()
    out = {}
    for g, pdf in chosen.sort_values(["group", "key"]).groupby("group"):
        out[g] = unit(np.array(pdf["v"].tolist()))
    return out


def dealt(found: DataFrame, points, spark) -> DataFrame:
    """A row for each home and visit: (group, cell, home, key, weight, v, cells, code, factor, length, resident)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = {}
        for pdf in batches:
            for g, part in pdf.groupby("group", sort=False):
                x = unit(np.array(part["v"].tolist()))
                dim = x.shape[1]
                turn = turns.setdefault(dim, rotation(dim))
                p = points.value.get(g)
                p = np.zeros((1, dim)) if p is None else p
                step = max(1, TILE // len(p))
                for a in range(0, len(x), step):
                    y, own = x[a : a + step], part.iloc[a : a + step]
                    dot = y @ p.T
                    home = dot.argmax(axis=1)
                    near = dot >= dot[np.arange(len(y)), home][:, None] - MARGIN
                    code, factor, length = encode(y - p[home], turn)
                    resident = np.einsum("ij,ij->i", y - p[home], p[home])
                    who, where = np.nonzero(near)
                    cells = np.split(where.astype(np.int32), np.cumsum(near.sum(axis=1))[:-1])
                    yield pd.DataFrame({
                        "group": g, "cell": where, "home": where == home[who], "key": own["key"].to_numpy()[who], "weight": own["weight"].to_numpy()[who], "v": [own["v"].iloc[i] for i in who], "own": home[who], "cells": [cells[i] for i in who],
                        "code": [code[i].tobytes() for i in who], "factor": factor[who], "length": length[who], "resident": resident[who],
                    })

    kind = "group string, cell int, home boolean, key string, weight long, v array<double>, own int, cells array<int>, code binary, factor double, length double, resident double"
    return found.select("group", "key", "weight", "v").mapInPandas(run, kind)


def compare(points):
    """Links of one block of residents with one block of visitors: per vector its partners' weight and a root."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g, cell = pdf["group"].iloc[0], int(pdf["cell"].iloc[0])
        none = pd.DataFrame({"key": [], "links": [], "root": []}).astype({"key": object, "links": "int64", "root": object})
        stay, come = pdf[pdf["home"] & (pdf["side"] == 0)], pdf[pdf["side"] == 1]
        if not len(stay) or not len(come):
            return none
        residents, queries = unit(np.array(stay["v"].tolist())), unit(np.array(come["v"].tolist()))
        dim = residents.shape[1]
        p = points.value.get(g)
        pivot = np.zeros(dim) if p is None else p[cell]
        codes = np.frombuffer(b"".join(stay["code"]), dtype=np.uint8).reshape(len(stay), -1)
        about, width = estimate(queries, pivot, codes, stay["factor"].to_numpy(), stay["length"].to_numpy(), stay["resident"].to_numpy(), rotation(dim))
        i, j = linked(queries, residents, about + width >= THRESHOLD)
        a, b = come["key"].to_numpy()[i], stay["key"].to_numpy()[j]
        # A pair that both visits would find counts once, at the visit of the lesser key.
        visits = [set(c) for c in stay["cells"]]
        own = come["own"].to_numpy()
        keep = np.array([x != y and (x < y or own[u] not in visits[v]) for x, y, u, v in zip(a, b, i.tolist(), j.tolist(), strict=True)], dtype=bool)
        a, b, i, j = a[keep], b[keep], i[keep], j[keep]
        if not len(a):
            return none
        names, index = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = index[: len(a)], index[len(a) :]
        links = np.bincount(x, stay["weight"].to_numpy()[j], len(names)) + np.bincount(y, come["weight"].to_numpy()[i], len(names))
        root = np.arange(len(names))
        while True:  # least label among neighbours, with jumps
            low = root.copy()
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, y, root[x])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"key": names, "links": links.astype(np.int64), "root": names[root]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    rows, found = classes(vectors, id_col, vec_col, label_col)
    found = materialise(found, "vectors")
    points = spark.sparkContext.broadcast(pivots(found))
    deal = materialise(dealt(found, points, spark), "cells")
    sizes = deal.groupBy("group", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("stays"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("comes")).where("stays > 0")
    placed = deal.join(sizes, ["group", "cell"]).withColumn("h", F.xxhash64("key"))
    number = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["group", "cell", "home", "key", "weight", "v", "own", "cells", "code", "factor", "length", "resident"]
    stay = placed.where("home").select(*kept, F.lit(0).alias("side"), number("stays").alias("sb"), every("comes").alias("cb"))
    come = placed.select(*kept, F.lit(1).alias("side"), every("stays").alias("sb"), number("comes").alias("cb"))
    pairs = materialise(stay.union(come).groupBy("group", "cell", "sb", "cb").applyInPandas(compare(points), "key string, links long, root string"), "near")
    ids = found.select("key", "id", "weight")
    links = pairs.groupBy("key").agg(F.sum("links").alias("links"))
    comp = components(pairs.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = ids.join(comp, ids["key"] == comp["node"], "left").select(ids["key"], "id", "weight", F.coalesce("component", ids["key"]).alias("component"))
    # Written, so that a component with a great many members is split where it is joined.
    named = materialise(named, "named")
    least = materialise(named.groupBy("component").agg(F.min("id").alias("component_id")), "least")
    final = named.join(least, "component").join(links, "key", "left").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.where("key is not null").join(final, "key", "left").select("id", "n_links", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = out.union(rows.where("key is null").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
