"""Connected components of links by alternating large and small stars, as joins and aggregates.

Every round writes its links to the shared folder, so lineage stays short and a lost executor re-reads them. Only a row count
and a checksum of the links reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeflow.session import staged


def large_star(links: DataFrame) -> DataFrame:
    """Every node ties its larger neighbours to the least of its neighbours and itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(links: DataFrame) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    out = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node that links reach, itself included.

    Links may be repeated, in either direction or to the node itself; nodes without links do not appear.
    """
    links = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = staged(links)
    before = None
    for _ in range(most_rounds):
        mark = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
        links = staged(small_star(large_star(links).distinct()).distinct())
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())


def dealt_cells(members: DataFrame, keep: list[str]) -> DataFrame:
    """(cell, side, *keep) of rows (key, node, blocks, ...): pairs of blocks of each key.

    A row goes to the cell of its own block, on side 2, where pairs inside the block are found; and to a cell with each other
    block, on side 0 or 1, where pairs have one row of each side.
    """
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.select("key", *keep, own.alias("own"), "blocks").select("*", other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), side.alias("side"), *keep)


def class_facts(firsts: DataFrame, found: DataFrame) -> DataFrame:
    """(node, class_id, n_links, copy_of) of every node.

    ``firsts`` has (node, rep, copies): the least id and the rows of each node; ``found`` has (node, links, root) for some nodes,
    several times for some, where links counts rows of other nodes.
    """
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = firsts.join(group, "node")
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = named.select("node", "component").join(least, "component").join(links, "node", "left").select("node", "class_id", "links")
    return firsts.join(named, "node", "left").select(
        "node",
        F.coalesce("class_id", "rep").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("rep").alias("copy_of"),
    )


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member reached by each of n members through the links (i, j), for links that fit one task."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    return root
