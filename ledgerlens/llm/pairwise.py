"""Comparing bounded blocks of rows: what the two similarity operators share.

Rows meet in blocks, never as pairs: a block goes to one Python call, which compares its rows as
matrices and returns, per row, how many rows it links with and the least row of its
component inside the block. So a group whose rows are all linked costs its comparisons but
moves and returns only rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut

FOUND = "node long, links long, root long"


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component under the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def compare(rows: pd.DataFrame, linked: Callable[[list, list], np.ndarray]) -> pd.DataFrame:
    """rows: node, copies, side, payload. Rows of side 0 meet those of side 1; rows of side 2 meet each other."""
    rows = rows.sort_values(["side", "node"], kind="stable").reset_index(drop=True)
    alone = bool((rows.side == 2).all())
    one, other = np.flatnonzero(rows.side != 1), np.flatnonzero(rows.side != 0)
    payload, copies, node = list(rows.payload), rows.copies.to_numpy(), rows.node.to_numpy()
    if len(one) == 0 or len(other) == 0:
        return pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
    mine = [payload[i] for i in one]
    hit = linked(mine, mine if alone else [payload[i] for i in other])
    if alone:
        np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    a, b = one[a], other[b]
    links = np.bincount(a, copies[b], len(rows))
    if not alone:
        links = links + np.bincount(b, copies[a], len(rows))
    by_node = np.argsort(node, kind="stable")
    place = np.empty(len(rows), int)
    place[by_node] = np.arange(len(rows))
    root = by_node[roots_of(len(rows), place[a], place[b])][place] if len(a) else np.arange(len(rows))
    got = np.flatnonzero(links > 0)
    return pd.DataFrame({"node": node[got], "links": links[got].astype("int64"), "root": node[root[got]]})


def settle(blocks: DataFrame, linked: Callable[[list, list], np.ndarray]) -> DataFrame:
    """blocks: (block, part, node, copies, side, payload) -> (node, links, root) over all blocks. Rows of different parts of a block don't meet."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([compare(own, linked) for _, own in rows.groupby("part", sort=False)], ignore_index=True)

    found = cut(blocks.groupBy("block").applyInPandas(run, FOUND), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    return links.join(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "node")


def per_row(rows: DataFrame, classes: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """rows (id, class_key or null), classes (class_key, class_id, copies), found (node, links, root) ->
    id, class_id, n_links, component_id, kept of every row."""
    settled = cut(classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left"), "settled")
    # rows without a class would meet in one task of the join
    out = rows.where("class_key is not null").join(settled, "class_key", "left")
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in settled.dtypes if c != "class_key"]
    out = out.unionByName(rows.where("class_key is null").select("*", *nothing))
    return out.select(
        id_col,
        F.coalesce("class_id", id_col).alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("root", "class_id", id_col).alias("component_id"),
        F.coalesce(F.col(id_col) == F.coalesce("root", "class_id", id_col), F.lit(True)).alias("kept"),
    )
