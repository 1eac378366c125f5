"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Nodes that a task holds at most, and links that it is given at most after the first pass.
TASK_NODES, TASK_LINKS = 1_000_000, 500_000


def _local_forest(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Per task, replace its links by links to the smallest node of their local component.

    At most one link per node and task is left, so a dense group leaves as a star. With ``roots`` the
    smallest nodes are linked to themselves, so that every node of ``edges`` is an ``a``.
    """
    import pyarrow as pa

    def run(batches):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def out():
            got = [(x, r) for x in list(parent) if (r := root(x)) != x or roots]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([r for _, r in got], pa.int64())}
            )

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > TASK_NODES:  # bound a task's memory; the rounds join the parts
                yield from out()
                parent.clear()
        yield from out()

    return edges.mapInArrow(run, "a long, b long")


def _all_stars(links: DataFrame) -> bool:
    """Whether every node with a link to a smaller one has just that link, to a node without any."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def _star(both: DataFrame, write: Callable) -> DataFrame:
    """(node, smallest neighbour), written so that the join to it can split a hub."""
    return write(both.groupBy(F.col("a").alias("_node")).agg(F.min("b").alias("_low")), "component_low")


def connected_components(edges: DataFrame, write: Callable = written) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Links to itself give a component of one. Rounds of large-star and small-star steps run until only
    stars are left. After each step, tasks of up to ``TASK_LINKS`` links contract what they hold: a node's
    smallest neighbour never grows by that, and links that fit in one task are done with it. Each round is
    written to the shared folder by ``write`` (df, name), which may delete a table once another has its
    name. ``edges`` is computed once. An empty table gives no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    nodes = write(_local_forest(edges, roots=True).distinct(), "component_nodes")
    now = nodes.filter("a != b")
    while links := now.count():
        contracted = _local_forest(now.coalesce(-(-links // TASK_LINKS)))
        now = write(contracted.distinct(), "component_links")
        if _all_stars(now):
            break
        both = now.union(now.select("b", "a"))
        large = both.join(_star(both, write), F.col("a") == F.col("_node")).select(
            F.col("b").alias("a"), F.least("_low", F.col("a")).alias("b"), F.col("a").alias("was")
        )
        large = large.filter("a > was and a != b").select("a", "b").distinct()
        large = write(large, "component_large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.join(_star(down, write), F.col("a") == F.col("_node"))
        small = small.select(F.col("b").alias("a"), F.col("_low").alias("b")).union(
            small.select("a", F.col("_low").alias("b"))
        )
        now = write(small.filter("a != b").distinct(), "component_links")
    roots = now.select(F.col("a").alias("_a"), F.col("b").alias("_root"))
    return nodes.select("a").distinct().join(roots, F.col("a") == F.col("_a"), "left").select(
        F.col("a").alias("node"), F.coalesce("_root", "a").alias("root")
    )
