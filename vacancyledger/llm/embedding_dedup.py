"""Embedding near-dedup: NN-descent on a neighbour graph, then components of the close links."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .graph import connected_components
from .vectors import directions, matrix, packed

#: Neighbours per vector, at first and at most, and rounds of refinement per attempt.
NEIGHBOURS, MOST_NEIGHBOURS, ROUNDS = 8, 32, 3
#: Random trees that give the first graph, the rows of a leaf and the most of them.
TREES, LEAF_ROWS, MOST_LEAF_ROWS = 6, 128, 512
#: Vectors compared with all others to audit recall, at first and at most, and the true links that an
#: audit needs to count; the share of links to find, and attempts.
AUDIT_VECTORS, MOST_AUDIT_VECTORS, AUDIT_LINKS, AUDIT_RECALL, ATTEMPTS = 256, 4096, 100, 0.99, 3
#: Nodes joined in one task, and rows of a comparison block.
NODES_PER_TASK, BLOCK_ROWS = 512, 1024


def _rows(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    import pandas as pd

    cols = [np.concatenate(c) if out else np.array([]) for c in (zip(*out, strict=True) if out else ([], [], []))]
    return pd.DataFrame({"id": cols[0], "other": cols[1], "cosine": cols[2]})


def _leaf_neighbours(kind: str, dim: int, most: int):
    """Each vector's nearest others in its leaf."""

    def run(leaf):
        ids = leaf["id"].to_numpy()
        unit = directions(matrix(leaf["vec"], kind, dim))
        near = unit @ unit.T
        np.fill_diagonal(near, -2)
        k = min(most, len(ids) - 1)
        if k < 1:
            return _rows([])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        return _rows([(np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(near, at, 1).ravel())])

    return run


def first_graph(nodes: DataFrame, kind: str, dim: int, total: int, seed: int, trees: int = TREES) -> DataFrame:
    """(id, other, cosine): neighbours in the leaves of random hyperplane trees.

    A leaf is a sign pattern; one of very many vectors is dealt to several, differently in each tree.
    """
    bits = max(0, math.ceil(math.log2(max(1.0, total / LEAF_ROWS))))
    planes = np.random.default_rng(seed).normal(size=(trees, bits, dim))

    def leaves(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            unit = directions(matrix(b.column(1).to_pylist(), kind, dim))
            signs = (np.einsum("nd,tbd->ntb", unit, planes) > 0).astype(np.int64)
            found = list(signs @ (1 << np.arange(bits, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], ["id", "vec", "leaves"])

    rows = nodes.mapInArrow(leaves, "id long, vec binary, leaves array<long>")
    rows = rows.select("id", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = rows.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / MOST_LEAF_ROWS).cast("int").alias("_parts"))
    large = written(sizes.filter("_parts > 1"), "leaves")
    rows = rows.join(large, ["tree", "leaf"], "left")
    part = F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.coalesce("_parts", F.lit(1))).alias("part")
    rows = rows.select("id", "vec", "tree", "leaf", part)
    return rows.groupBy("tree", "leaf", "part").applyInPandas(
        _leaf_neighbours(kind, dim, NEIGHBOURS), "id long, other long, cosine double"
    )


def _best(edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The nearest ``k`` others of each id; an edge seen before is not new."""
    merged = edges.groupBy("id", "other").agg(F.max("cosine").alias("cosine"), F.min("is_new").alias("is_new"))
    by = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    ranked = merged.withColumn("_rank", F.row_number().over(by))
    if sizes is None:
        return ranked.filter(F.col("_rank") <= NEIGHBOURS).drop("_rank")
    ranked = ranked.join(sizes.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    return ranked.filter(F.col("_rank") <= F.coalesce("k", F.lit(NEIGHBOURS))).drop("_rank", "_id", "k")


def _local_join(kind: str, dim: int):
    """Compare the neighbours of each node with one another, where one of the two is new."""

    def run(rows):
        rows = rows.sort_values("node", kind="stable")
        node, ids = rows["node"].to_numpy(), rows["id"].to_numpy()
        unit = directions(matrix(rows["vec"], kind, dim))
        new, worst = rows["is_new"].to_numpy(), rows["worst"].to_numpy()
        cuts = np.flatnonzero(np.diff(node)) + 1
        out = []
        for at, to in zip([0, *cuts], [*cuts, len(node)], strict=True):
            part = slice(at, to)
            near = unit[part] @ unit[part].T
            fresh = (new[part][:, None] | new[part][None, :]) & (ids[part][:, None] != ids[part][None, :])
            i, j = np.nonzero(fresh & (near > worst[part][:, None]))
            if len(i):
                out.append((ids[part][i], ids[part][j], near[i, j]))
        found = _rows(out)
        return found.drop_duplicates(["id", "other"]) if len(found) else found

    return run


def _refine(graph: DataFrame, nodes: DataFrame, kind: str, dim: int, total: int, sizes: DataFrame, seed: int) -> DataFrame:
    """One round: each node's neighbours, and the nodes it is a neighbour of, meet at the node."""
    forward = graph.select(F.col("id").alias("node"), F.col("other").alias("id"), "is_new")
    # Of the reverse lists a seeded choice as long as the forward ones, so that hubs stay bounded;
    # a link lost to this choice is found from its other end or in the next round.
    by = Window.partitionBy("node").orderBy(F.desc("is_new"), F.xxhash64(F.lit(seed), "id"))
    reverse = graph.select(F.col("other").alias("node"), "id", "is_new")
    reverse = reverse.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= NEIGHBOURS).drop("_r")
    meet = forward.unionByName(reverse).groupBy("node", "id").agg(F.max("is_new").alias("is_new"))
    own = graph.groupBy(F.col("id").alias("_w")).agg(F.min("cosine").alias("worst"), F.count("*").alias("n"))
    own = own.join(sizes.withColumnRenamed("id", "_s"), F.col("_w") == F.col("_s"), "left")
    worst = F.when(F.col("n") >= F.coalesce("k", F.lit(NEIGHBOURS)), F.col("worst")).otherwise(-2.0)
    known = nodes.join(own.select("_w", worst.alias("worst")), F.col("id") == F.col("_w"), "left")
    known = written(known.select(F.col("id").alias("_id"), "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst")), "known")
    tasks = max(1, -(-total // NODES_PER_TASK))
    rows = meet.join(known, F.col("id") == F.col("_id")).drop("_id")
    rows = rows.withColumn("_task", F.pmod(F.xxhash64("node"), F.lit(tasks)))
    found = rows.groupBy("_task").applyInPandas(_local_join(kind, dim), "id long, other long, cosine double")
    old = graph.withColumn("is_new", F.lit(False))
    return _best(old.unionByName(found.withColumn("is_new", F.lit(True))), sizes)


def neighbour_graph(nodes: DataFrame, kind: str, dim: int, total: int, least: float, seed: int = 0) -> tuple[DataFrame, DataFrame, float]:
    """(graph of (id, other, cosine), ids whose lists are still full of links, audited recall).

    Rounds run until none finds a new link or ``ROUNDS`` are done. The list of a vector whose
    neighbours are all links doubles, up to ``MOST_NEIGHBOURS``. Then the links of a bounded sample
    are counted against all vectors; while too few were found, more trees are added and rounds run.
    A recall below ``AUDIT_RECALL`` says that the graph is not to be used: too few links were found after
    all attempts, or the largest sample holds too few true links to tell (recall 0).
    """
    graph, recall = None, 0.0
    sizes = written(nodes.limit(0).select("id", F.lit(NEIGHBOURS).alias("k")), "sizes")
    for attempt in range(ATTEMPTS):
        start = first_graph(nodes, kind, dim, total, seed + 101 * attempt).withColumn("is_new", F.lit(True))
        if graph is not None:
            start = start.unionByName(graph.withColumn("is_new", F.lit(False)))
        graph = written(_best(start, sizes), "graph")
        rounds, k = 0, NEIGHBOURS
        while True:
            full = graph.groupBy("id").agg(F.min("cosine").alias("low"), F.count("*").alias("n"))
            full = full.join(sizes.withColumnRenamed("id", "_s"), F.col("id") == F.col("_s"), "left")
            full = written(
                full.filter((F.col("low") >= least) & (F.col("n") >= F.coalesce("k", F.lit(NEIGHBOURS)))).select("id"),
                "full",
            )
            grown = k < MOST_NEIGHBOURS and not full.isEmpty()
            if rounds >= ROUNDS and not grown:
                break
            if grown:
                k *= 2
                larger = sizes.join(full, "id", "left_anti").unionByName(full.select("id", F.lit(k).alias("k")))
                sizes = written(larger, "sizes")
            before = graph.filter(F.col("cosine") >= least).count()
            graph = written(_refine(graph, nodes, kind, dim, total, sizes, seed + rounds), "graph")
            rounds += 1
            if graph.filter(F.col("cosine") >= least).count() == before and not grown:
                break
        size = AUDIT_VECTORS
        found, true = audit(graph, full, nodes, kind, dim, least, seed, size)
        while true < AUDIT_LINKS and size < min(total, MOST_AUDIT_VECTORS):
            size = min(4 * size, MOST_AUDIT_VECTORS)
            found, true = audit(graph, full, nodes, kind, dim, least, seed, size)
        if true < AUDIT_LINKS and size < total:
            recall = 0.0
            break
        recall = found / true if true else 1.0
        if recall >= AUDIT_RECALL:
            break
    return graph.drop("is_new"), full, recall


def audit(
    graph: DataFrame, full: DataFrame, nodes: DataFrame, kind: str, dim: int, least: float, seed: int, vectors: int = AUDIT_VECTORS
) -> tuple[int, int]:
    """Of a bounded sample of vectors, the links that the graph holds, either way round, and the true links.

    Vectors whose lists are full are left out: their links are counted in blocks, inside their component
    by :func:`dense_counts` and to all others by :func:`cross_links`, not from the graph.
    """
    some = nodes.join(full, "id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(vectors)
    sample = some.collect()
    if not sample:
        return 0, 0
    ids = np.array([r["id"] for r in sample])
    unit = directions(matrix([r["vec"] for r in sample], kind, dim))

    def links(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                at = b.column(0).to_numpy(zero_copy_only=False)
                i, j = np.nonzero(unit @ directions(matrix(b.column(1).to_pylist(), kind, dim)).T >= least)
                keep = ids[i] != at[j]
                yield pa.RecordBatch.from_pydict({"a": ids[i][keep], "b": at[j][keep]})

    true = nodes.mapInArrow(links, "a long, b long").join(full.withColumnRenamed("id", "b"), "b", "left_anti")
    close = graph.filter(F.col("cosine") >= least)
    have = close.select(F.col("id").alias("a"), F.col("other").alias("b")).union(close.select("other", "id"))
    row = true.join(have.distinct().withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("*"), F.count("hit")).first()
    return row[1], row[0]


def _angles(kind: str, dim: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                one = directions(matrix(b.column(2).to_pylist(), kind, dim))
                two = directions(matrix(b.column(3).to_pylist(), kind, dim))
                angle = np.arccos(np.clip((one * two).sum(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(angle), b.column(4)], ["root", "id", "vec", "angle", "copies"])

    return run


def dense_counts(members: DataFrame, kind: str, dim: int, least: float) -> DataFrame:
    """(id, n): exact number of vectors linked to each member of components with saturated lists.

    ``members`` has root, id, vec, copies (rows of that vector). If a member's angle to the smallest
    member and the widest such angle together stay within the threshold's angle, it is linked to all
    members, by the triangle inequality, and nothing is compared. The others are compared with all
    members in blocks, each block pair a task; only counts leave a task.
    """
    centre = members.groupBy("root").agg(F.min(F.struct("id", "vec")).alias("_c"))
    centre = written(centre.select(F.col("root").alias("_root"), F.col("_c.vec").alias("centre")), "centres")
    turned = members.join(centre, F.col("root") == F.col("_root")).select("root", "id", "vec", "centre", "copies")
    turned = written(turned.mapInArrow(_angles(kind, dim), "root long, id long, vec binary, angle double, copies long"), "angles")
    whole = turned.groupBy(F.col("root").alias("_root")).agg(
        F.max("angle").alias("widest"), F.sum("copies").alias("all"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")
    )
    whole = written(whole, "whole")
    known = turned.join(whole, F.col("root") == F.col("_root"))
    sure = F.col("angle") + F.col("widest") <= math.acos(least) - 1e-9
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    shell = known.filter(~sure).select("root", "id", "vec", "copies", block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    own = [F.col(c).alias(c) for c in ("root", "id", "vec", "copies")]
    members_ = known.select(*own, block.alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))

    def count(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": []})
        near = directions(matrix(left["vec"], kind, dim)) @ directions(matrix(right["vec"], kind, dim)).T >= least
        near &= left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None, :]
        return pd.DataFrame({"id": left["id"].to_numpy(), "n": near @ right["copies"].to_numpy()})

    key = ["root", "i", "j"]
    counted = shell.groupBy(*key).cogroup(members_.groupBy(*key)).applyInPandas(count, "id long, n long")
    counted = counted.groupBy("id").agg(F.sum("n").alias("n"))
    return known.filter(sure).select("id", (F.col("all") - F.col("copies")).alias("n")).unionByName(counted)


def _met(kind: str, dim: int, least: float):
    """Links between two blocks: for each vector that has any, their number ``n`` and ``other``, a
    vector that links in the blocks join it with. Of a block with itself each link counts once a side."""

    def run(left, right):
        import pandas as pd

        nothing = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "n", "other")})
        if not len(left) or not len(right):
            return nothing
        one, two = left["id"].to_numpy(), right["id"].to_numpy()
        near = directions(matrix(left["vec"], kind, dim)) @ directions(matrix(right["vec"], kind, dim)).T >= least
        near &= one[:, None] != two[None, :]
        rows, cols = near.any(axis=1), near.any(axis=0)
        seed_l, seed_r = np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)
        open_ = rows.copy()
        while open_.any():
            start = int(np.argmax(open_))
            in_l, in_r = np.zeros(len(one), bool), np.zeros(len(two), bool)
            edge = np.array([start])
            while len(edge):
                in_l[edge] = True
                more = near[edge].any(axis=0) & ~in_r
                in_r |= more
                edge = np.flatnonzero(near[:, more].any(axis=1) & ~in_l)
            seed_l[in_l], seed_r[in_r] = one[start], one[start]
            open_ &= ~in_l
        out = [(one[rows], (near @ right["copies"].to_numpy())[rows], seed_l[rows])]
        # A block with itself has counted each link on the left; its right side only joins.
        counted = left["block"].iloc[0] != right["block"].iloc[0]
        out.append((two[cols], (left["copies"].to_numpy() @ near)[cols] * counted, seed_r[cols]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("id", "n", "other"), zip(*out, strict=True), strict=True)})

    return run


def cross_links(members: DataFrame, everyone: DataFrame, total: int, kind: str, dim: int, least: float) -> DataFrame:
    """(id, n, other): exact links between components with saturated lists and all vectors outside them.

    ``members`` is that of :func:`dense_counts`; ``everyone`` has id, vec, copies, label (its component)
    and dense (whether that has saturated lists). A vector can link to a member only if its angle to
    the component's centre is at most the threshold's angle and the component's widest angle together.
    Those vectors are compared with all members in blocks; of two such components the one of the
    smaller root visits the other, so that no link counts twice.
    """
    centre = members.groupBy("root").agg(F.min(F.struct("id", "vec")).alias("_c"))
    centre = written(centre.select(F.col("root").alias("_root"), F.col("_c.vec").alias("centre")), "centres")
    turned = members.join(centre, F.col("root") == F.col("_root")).select("root", "id", "vec", "centre", "copies")
    turned = turned.mapInArrow(_angles(kind, dim), "root long, id long, vec binary, angle double, copies long")
    whole = turned.groupBy("root").agg(F.max("angle").alias("widest"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    whole = written(whole.join(centre, F.col("root") == F.col("_root")).drop("_root"), "whole")

    groups, parts = (max(1, -(-n // BLOCK_ROWS)) for n in (whole.count(), total))
    centres = whole.select("root", "centre", "widest", F.pmod(F.xxhash64("root"), F.lit(groups)).cast("int").alias("i"))
    centres = centres.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    seen = everyone.select("id", "vec", "label", "dense", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("j"))
    seen = seen.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    widest = math.acos(least) + 1e-6

    def reach(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("root", "id")})
        cosine = directions(matrix(left["vec"], kind, dim)) @ directions(matrix(right["centre"], kind, dim)).T
        label, root = left["label"].to_numpy()[:, None], right["root"].to_numpy()[None, :]
        may = (label != root) & (~left["dense"].to_numpy()[:, None] | (label < root))
        may &= np.arccos(np.clip(cosine, -1, 1)) <= widest + right["widest"].to_numpy()[None, :]
        at, to = np.nonzero(may)
        return pd.DataFrame({"root": right["root"].to_numpy()[to], "id": left["id"].to_numpy()[at]})

    visits = seen.groupBy("i", "j").cogroup(centres.groupBy("i", "j")).applyInPandas(reach, "root long, id long")
    visits = written(visits, "visits")
    sizes = visits.groupBy("root").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    sizes = written(whole.select("root", "blocks").join(sizes, "root").withColumnRenamed("root", "_root"), "sizes")

    def dealt(rows: DataFrame, own: str, other: str, i: str, j: str, block: int) -> DataFrame:
        rows = rows.join(sizes, F.col("root") == F.col("_root"))
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(i)
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j)
        return rows.select("root", "id", "vec", "copies", F.lit(block).alias("block"), mine, theirs)

    visitors = visits.withColumnRenamed("id", "_id").join(everyone, F.col("_id") == F.col("id"))
    visitors = dealt(visitors, "parts", "blocks", "i", "j", 0)
    at_home = dealt(members, "blocks", "parts", "j", "i", 1)
    key = ["root", "i", "j"]
    return visitors.groupBy(*key).cogroup(at_home.groupBy(*key)).applyInPandas(_met(kind, dim, least), "id long, n long, other long")


def all_links(nodes: DataFrame, total: int, kind: str, dim: int, least: float) -> DataFrame:
    """(id, n, other) as in :func:`_met`, of all vectors with all in blocks: what is left if the search fails."""
    parts = max(1, -(-total // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    rows = written(nodes.select("id", "vec", "copies", own.alias("block")), "blocks")
    one = rows.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.lit(parts - 1))))
    two = rows.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block"))))
    return one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInPandas(_met(kind, dim, least), "id long, n long, other long")


def _counted(
    close: DataFrame, full: DataFrame, nodes: DataFrame, total: int, kind: str, dim: int, least: float
) -> tuple[DataFrame, DataFrame]:
    """((id, n) links of each vector, (node, root) components) of the close links of a good graph."""
    links = close.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    links = written(links, "links")
    parts = written(connected_components(links), "parts")

    copies = nodes.select(F.col("id").alias("_id"), "copies")
    ways = links.union(links.select("b", "a"))
    counts = ways.join(copies, F.col("b") == F.col("_id")).groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("n"))
    dense = parts.join(full, F.col("node") == F.col("id"), "left_semi").select("root").distinct()
    dense = written(dense, "dense")
    if not dense.isEmpty():
        inside = written(parts.join(dense, "root", "left_semi"), "inside")
        members = nodes.join(inside, F.col("id") == F.col("node")).select("root", "id", "vec", "copies")
        members = written(members, "members")
        exact = dense_counts(members, kind, dim, least)
        counts = counts.join(inside, F.col("id") == F.col("node"), "left_anti").unionByName(exact)
        everyone = nodes.join(parts, F.col("id") == F.col("node"), "left").withColumnRenamed("root", "_label")
        everyone = everyone.join(dense, F.col("_label") == F.col("root"), "left").select(
            "id", "vec", "copies", F.coalesce("_label", "id").alias("label"), F.col("root").isNotNull().alias("dense")
        )
        across = written(cross_links(members, written(everyone, "everyone"), total, kind, dim, least), "across")
        counts = counts.unionByName(across.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
        joined = across.select(F.col("id").alias("a"), F.col("other").alias("b"))
        parts = written(connected_components(links.unionByName(joined)), "parts")
    return counts, parts


def near_duplicates(
    embeddings: DataFrame, least: float = 0.95, seed: int = 0, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``embeddings``.

    Two vectors link at a cosine of at least ``least``, in doubles. Vectors with the same components
    are one node of the graph and link with one another. Vectors that cannot be measured (see
    :func:`vectors.packed`) link with nothing and are their own component; a null id has a null
    component. Rows that repeat an id are one vector (of two different ones, the larger in bytes) and
    get the same result. An empty table gives no rows.
    """
    vectors, kind, dim = packed(embeddings, id_column, vector_column)
    vectors = written(vectors.groupBy("id").agg(F.max("vec").alias("vec")), "vectors")
    nodes = vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = written(nodes.select("id", "vec", "copies"), "nodes")
    total = nodes.count()
    graph, full, recall = neighbour_graph(nodes.select("id", "vec"), kind, dim, total, least, seed)
    close = graph.filter(F.col("cosine") >= least)
    if recall < AUDIT_RECALL:
        exact = written(all_links(nodes, total, kind, dim, least), "exact")
        counts = exact.groupBy("id").agg(F.sum("n").alias("n"))
        parts = written(connected_components(exact.select(F.col("id").alias("a"), F.col("other").alias("b"))), "parts")
    else:
        counts, parts = _counted(close, full, nodes, total, kind, dim, least)
    counts = counts.withColumnRenamed("id", "_n")
    result = (
        nodes.join(counts, F.col("id") == F.col("_n"), "left")
        .join(parts, F.col("id") == F.col("node"), "left")
        .select(F.col("vec").alias("_vec"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    found = vectors.join(written(result, "result"), F.col("vec") == F.col("_vec")).select(
        F.col("id").alias("_id"), "n_links", "component_id"
    )
    rows = embeddings.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"))
    joined = rows.join(written(found, "found"), F.col("vec_id") == F.col("_id"), "left")
    part = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        part.alias("component_id"),
        F.coalesce(F.col("vec_id") == part, F.lit(True)).alias("kept"),
    )
