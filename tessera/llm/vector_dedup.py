"""Embedding near-dedup as an exact metric range join.

Cosine >= c of two vectors is distance <= r = sqrt(2 - 2c) of their unit vectors. Pivots cut the vectors into cells; the
triangle inequality says which vectors near a boundary must also be seen by a neighbouring cell; the cells then join on
their own, in blocks, and return counts and a spanning set of links rather than pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_draw, stored
from tessera.llm.components import connected_components, union_find
from tessera.llm.vectors import matrix, unit, usable_rows

#: A label of n vectors has about sqrt(n) / ROOT cells, and no more than CELL vectors in one as long as MAX_PIVOTS allows; larger
#: cells are joined in blocks.
ROOT = 4
CELL = 4000
MAX_PIVOTS = 4096
BLOCK = 4096
#: Vectors whose distances to all pivots a task holds at a time.
STEP = 1024
#: Added to the radius, well above rounding of double distances.
SLACK = 1e-6


def _cells(batches: Iterator[pd.DataFrame], pivots: dict[int, np.ndarray], radius: float) -> Iterator[pd.DataFrame]:
    between = {d: np.sqrt(np.maximum(1e-30, 2 - 2 * p @ p.T)) for d, p in pivots.items()}
    for pdf in batches:
        for dim, rows in ((d, g.iloc[a : a + STEP]) for d, g in pdf.groupby(pdf["embedding"].map(len)) for a in range(0, len(g), STEP)):
            known = pivots.get(dim)
            u = unit(matrix(rows["embedding"]))
            if known is None or len(known) < 2:
                yield rows.assign(dim=dim, cell=0, home=True)
                continue
            far = np.sqrt(np.maximum(0, 2 - 2 * u @ known.T))
            own = far.argmin(axis=1)
            best = far[np.arange(len(u)), own][:, None]
            apart = between[dim][own]
            # distance from a vector to the plane between its pivot and another: no vector behind it is nearer
            border = (far**2 - best**2) / (2 * apart)
            seen = (border <= radius + SLACK) & (far - best <= 2 * (radius + SLACK))
            seen[np.arange(len(u)), own] = True
            at, cell = np.nonzero(seen)
            yield rows.iloc[at].assign(dim=dim, cell=cell, home=cell == own[at])


def _join(cosine: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        left, right = pdf[side == 0], pdf[side == 1]
        empty = pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        if left.empty or right.empty:
            return empty
        a, b = unit(matrix(left["embedding"])), unit(matrix(right["embedding"]))
        ids, other = left["rep"].to_numpy(), right["rep"].to_numpy()
        near = (a @ b.T >= cosine) & (ids[:, None] != other[None, :])
        counts = near @ right["copies"].to_numpy().astype(np.float64)
        i, j = np.nonzero(near)
        if len(i) == 0:
            return empty
        nodes, at = np.unique(np.concatenate([ids[i], other[j]]), return_inverse=True)
        root = nodes[union_find(len(nodes), at[: len(i)], at[len(i) :])]
        links = pd.Series(counts.astype(np.int64), index=ids)
        return pd.DataFrame({"rep": nodes, "links": links.reindex(nodes, fill_value=0).to_numpy(), "root": root})

    return run


def _pivots(classes: DataFrame, largest: int) -> dict[int, np.ndarray]:
    """At most MAX_PIVOTS vectors, drawn by hash, to the driver; by their length."""
    n = min(MAX_PIVOTS, max(math.ceil(largest / CELL), math.ceil(math.sqrt(largest) / ROOT)))
    if n < 2:
        return {}
    drawn = bounded_draw(classes, "rep", n, 5).select("embedding").collect()
    by: dict[int, list] = {}
    for (v,) in drawn:
        by.setdefault(len(v), []).append(v)
    return {k: np.unique(unit(matrix(v)), axis=0) for k, v in by.items()}


def vector_links(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors with an id.

    Two rows link when their labels are equal and not null and their cosine, in double precision, is at least `cosine`.
    Null vectors, zero vectors and vectors with null or non-finite components link with nothing, as do vectors of different
    length. Equal vectors of a label (repeated rows too) are one class: joined once, counted by their number. n_links: other
    rows linked directly. component_id: smallest id that links reach. Rows without id are dropped; other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")).filter("vec_id is not null")
    fit = usable_rows(rows, "vec_id", "embedding", "label").filter("label is not null")
    classes = stored(fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    pivots = _pivots(classes, largest)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    label = classes.schema["label"].dataType.simpleString()
    cells = classes.mapInPandas(lambda it: _cells(it, pivots, radius), f"label {label}, embedding array<float>, rep long, copies long, dim int, cell int, home boolean")
    cells = stored(cells, "cells")  # read to count, and for both sides of the join
    sizes = cells.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    sized = cells.join(sizes, ["label", "dim", "cell"])
    block, every = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    key = ["label", "dim", "cell", "i", "j"]
    left = sized.filter("home").select("label", "dim", "cell", block.alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), "rep", "copies", "embedding")
    right = sized.select("label", "dim", "cell", F.explode(every).alias("i"), block.alias("j"), F.lit(1).alias("side"), "rep", "copies", "embedding")
    found = stored(left.unionByName(right).groupBy(*key).applyInPandas(_join(cosine), "rep long, links long, root long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    described = (
        classes.join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.col("label").alias("l"), F.col("embedding").alias("e"), "copies", "links", F.coalesce("component", "rep").alias("component"))
    )
    out = rows.join(described, (rows["label"] == described["l"]) & (rows["embedding"] == described["e"]), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        F.col("vec_id").alias(id_col),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
