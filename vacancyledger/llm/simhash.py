"""SimHash near-duplicate detection with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, columns_of, written
from .graph import connected_components

#: Buckets above this size, and above four times what chance puts into one, are linked by stars first, see
#: :func:`links`. Where a pair may meet in many tables, :func:`deduplicated` takes the smaller size.
PAIRWISE_BUCKET, PAIRWISE_BUCKET_WIDE = 256, 32
#: Shingles hashed at a time, so that a very long text needs bounded memory.
BLOCK = 1 << 15
#: Two texts are near copies if they share at least this part of their distinct shingles (Jaccard).
ALIKE = (4, 5)
#: Documents whose shingles are counted, and how many frequent shingles are put last in the order of
#: :func:`sketches`. They change what is compared, not what is found.
COUNTED_DOCUMENTS, FREQUENT = 1 << 16, 1 << 17
#: Of these, how many a task counts, and how many of their shingles it holds at a time.
COUNTED_TOGETHER, COUNTED_SHINGLES = 1 << 13, 1 << 23
#: Rounds in which each node is compared with one partner only, see :func:`_confirmed`.
THIN_ROUNDS = 3
#: Odd multiplier that spreads one hash to further lanes (2^64 / golden ratio).
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included.

    A-Z are lower-cased, words are split at space and \\x09-\\x0D, shingles are ``words`` words joined
    by a space; fewer words make one shingle, none make no shingle.
    """
    from xxhash import xxh64_intdigest

    split = (text or b"").lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(split) - words + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in spans), dtype=np.uint64, count=n)


def fingerprint(text: bytes | None, words: int, lanes: int = 1) -> list[int]:
    """``lanes`` 64-bit words; a bit is 1 if set in over half the hashes of all shingles, none give zero.

    Lane 0 is made of the hashes of :func:`shingle_hashes`, further lanes are mixed from them.
    """
    return _majority(shingle_hashes(text, words), lanes)


def _majority(hashes: np.ndarray, lanes: int) -> list[int]:
    counts = np.zeros((lanes, 64), dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        for lane in range(lanes):
            h = hashes[at : at + BLOCK]
            if lane:
                h = (h + np.uint64(lane * GOLDEN % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                h = h ^ (h >> np.uint64(29))
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts[lane] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(hashes), axis=1).view(">u8").astype(np.uint64).astype(np.int64)[:, 0].tolist()


def fingerprints(documents: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id, ``f0`` .. (one long per lane) and ``digest`` (a hash of the text) of every row."""
    docs = columns_of(documents, doc_id="long", text="string").select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest")
    )
    names = [f"f{j}" for j in range(lanes)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [fingerprint(t.as_py(), words, lanes) for t in b.column(1)]
            cols = list(zip(*found, strict=True)) if found else [()] * lanes
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), *[pa.array(list(c), pa.int64()) for c in cols]],
                ["doc_id", "digest", *names],
            )

    return docs.mapInArrow(run, ", ".join(["doc_id long", "digest long", *[f"{n} long" for n in names]]))


def _offsets(bits: int, segments: int) -> list[int]:
    """Where each of nearly equal segments starts, and the end."""
    sizes = [bits // segments + (i < bits % segments) for i in range(segments)]
    return [sum(sizes[:i]) for i in range(segments + 1)]


def _by_table(values: list[int], kind: str = "long") -> str:
    return f"element_at(array({', '.join(f'CAST({v} AS {kind})' for v in values)}), i + 1)"


def _ring_index(nodes: DataFrame, lanes: int, segments: int, key_segments: int) -> DataFrame:
    """(i, key, node, r0 ..): per segment i of the ring, the fingerprint turned so that it comes first.

    ``key`` holds the first ``key_segments`` segments of the turned fingerprint. Distances between two
    fingerprints do not change by turning both.
    """
    cut = _offsets(64 * lanes, segments)
    turned = nodes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    lane, shift = _by_table([c // 64 for c in cut[:-1]], "int"), _by_table([c % 64 for c in cut[:-1]], "int")
    turned = turned.withColumn("_l", F.expr(lane)).withColumn("_s", F.expr(shift))
    all_ = f"array({', '.join(f'f{j}' for j in range(lanes))})"

    def word(j: int) -> str:
        this, following = (f"element_at({all_}, pmod(_l + {j + k}, {lanes}) + 1)" for k in (0, 1))
        return f"if(_s = 0, {this}, shiftleft({this}, _s) | shiftrightunsigned({following}, 64 - _s))"

    width = [sum(cut[(i + k) % segments + 1] - cut[(i + k) % segments] for k in range(key_segments)) for i in range(segments)]
    return (
        turned.select("i", "node", *[F.expr(word(j)).alias(f"r{j}") for j in range(lanes)])
        .withColumn("key", F.expr(f"shiftrightunsigned(r0, {_by_table([64 - w for w in width], 'int')})"))
    )


def _close(lanes: int, segments: int, most: int, chain: int) -> F.Column:
    """The pigeonring condition on rows a and b of one table, then the whole Hamming distance.

    Going round the ring from segment i, the first l segments together differ in no more than
    l * most / segments bits, for every l up to ``chain``.
    """
    cut = _offsets(64 * lanes, segments)
    within = F.lit(True)
    for length in range(1, chain + 1):
        widths = [sum(cut[(i + k) % segments + 1] - cut[(i + k) % segments] for k in range(length)) for i in range(segments)]
        if max(widths) > 64:
            break
        drop = F.expr(_by_table([64 - w for w in widths], "int").replace("i + 1", "a.i + 1"))
        ahead = F.call_function("shiftrightunsigned", F.col("a.r0").bitwiseXOR(F.col("b.r0")), drop)
        within = within & (F.bit_count(ahead) <= length * most // segments)
    whole = F.lit(0)
    for j in range(lanes):
        whole = whole + F.bit_count(F.col(f"a.r{j}").bitwiseXOR(F.col(f"b.r{j}")))
    return within & (whole <= most)


def links(
    nodes: DataFrame, lanes: int, segments: int, most: int, chain: int = 3, pairwise: int = PAIRWISE_BUCKET, write: Callable = written
) -> DataFrame:
    """Links (a, b) between nodes (``node``, ``f0`` ..; distinct fingerprints) that join exactly the
    nodes which chains of pairs of at most ``most`` differing bits join, each pair found by the ring.

    For ``most`` < ``segments`` every such pair shares the key of some chain, so none is missed. For
    more it must share one whole segment: a filter that misses some of the farthest pairs, which
    :func:`alike` finds by their shingles.

    A bucket of up to ``pairwise`` nodes (or four times the mean of a bucket by chance) is joined with itself. In a larger one all nodes are compared
    with the smallest; components of what was found so far then show which nodes of the bucket are
    still apart, and those outside its largest component are compared with all the rest. Within a
    component no further link can change a result, so none is lost, and no bucket lists all pairs.
    """
    cut = _offsets(64 * lanes, segments)
    key_segments = max([1, *(n for n in range(1, segments + 1) if n * most // segments == 0)])
    index = _ring_index(nodes, lanes, segments, key_segments)
    close = _close(lanes, segments, most, chain)
    by_chance = nodes.count() / 2 ** (key_segments * min(b - a for a, b in zip(cut, cut[1:], strict=False)))
    hot = index.groupBy("i", "key").agg(F.count("*").alias("n")).filter(F.col("n") > max(pairwise, 4 * by_chance))
    hot = write(hot.select("i", "key"), "hot")
    some_hot = not hot.isEmpty()
    small = index.join(hot, ["i", "key"], "left_anti") if some_hot else index
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.key") == F.col("b.key"))
    near = small.alias("a").join(small.alias("b"), same & (F.col("a.node") < F.col("b.node")) & close)
    near = write(near.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "ring")
    if not some_hot:
        return near
    large = write(index.join(hot, ["i", "key"]), "large")
    row = F.struct("node", *[f"r{j}" for j in range(lanes)])
    leaders = large.groupBy("i", "key").agg(F.min(row).alias("_row")).select("i", "key", "_row.*")
    leaders = write(leaders, "leaders")
    star = large.alias("a").join(leaders.alias("b"), same & (F.col("a.node") > F.col("b.node")) & close)
    star = star.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    near = write(near.unionByName(star).distinct(), "ring_and_stars")
    labels = write(connected_components(near, write), "labels")
    known = large.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    known = write(known.withColumn("label", F.coalesce("root", "node")).drop("_node", "root"), "known")
    most_of = (
        known.groupBy("i", "key", "label").agg(F.count("*").alias("n"))
        .groupBy("i", "key").agg(F.max_by("label", "n").alias("_main"))
    )
    apart = write(known.join(write(most_of, "main"), ["i", "key"]).filter("label != _main").drop("_main"), "apart")
    rest = apart.alias("a").join(known.alias("b"), same & (F.col("a.label") != F.col("b.label")) & close)
    return near.unionByName(rest.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))


def near_duplicates(
    documents: DataFrame, words: int = 3, lanes: int = 1, segments: int = 5, most: int = 2, pairwise: int = PAIRWISE_BUCKET
) -> DataFrame:
    """doc_id, digest, f0 .. and ``component_id``: the smallest doc_id reachable by links.

    Rows link at ``most`` or fewer differing bits, rows without words (fingerprint zero) like any
    other. Rows with the same fingerprint are one node, so copies are never paired. A row without
    doc_id has a fingerprint but takes no part in links (component_id null). Repeated rows are kept.
    An empty table gives no rows.
    """
    names = [f"f{j}" for j in range(lanes)]
    found = written(fingerprints(documents, words, lanes), "fingerprints")
    nodes = found.filter("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("node"))
    nodes = written(nodes, "nodes")
    roots = connected_components(links(nodes, lanes, segments, most, pairwise=pairwise))
    parts = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    parts = written(parts.select(*[F.col(n).alias("_" + n) for n in names], F.coalesce("root", "node").alias("_part")), "parts")
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col("_" + n))
    joined = found.join(parts, same, "left")
    return joined.select(
        "doc_id", "digest", *names, F.when(F.col("doc_id").isNotNull(), F.col("_part")).alias("component_id")
    )


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that occur in several of a bounded sample of documents, the least frequent first.

    A task counts blocks of documents and leaves out what only one of a block holds, so few shingles move.
    """
    total = docs.count()
    every = max(1, -(-total // COUNTED_DOCUMENTS))
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    some = some.repartition(max(1, total // every // COUNTED_TOGETHER))

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def counted():
            key, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.uint64),) * 2
            key, n = key[n > 1].view(np.int64), n[n > 1].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        for b in batches:
            for t in b.column(0):
                held.append(np.unique(shingle_hashes(t.as_py(), words)))
                size += len(held[-1])
                if size > COUNTED_SHINGLES:
                    yield counted()
                    held, size = [], 0
        yield counted()

    counts = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).collect()
    return np.array([r["key"] for r in reversed(top)], dtype=np.int64).view(np.uint64)


def sketches(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """doc_id, digest, f0 .., ``same`` (128 bits of the set of shingles), ``n`` (its size), ``prefix`` and
    ``last_rank`` (the place of its last shingle among the frequent ones, 0 for others).

    All sets are ordered alike: by hash, frequent shingles last. Two sets that share at least ``ALIKE``
    of their union share a shingle of their prefixes, the first n - ceil(ALIKE * n) + 1 shingles: without
    one, the larger set has more shingles outside the other than it may.
    """
    frequent = _frequent(docs, words)
    by_hash = np.argsort(frequent)
    ordered, (over, under) = frequent[by_hash], ALIKE

    def row(text: bytes | None) -> tuple:
        import hashlib

        hashes = shingle_hashes(text, words)
        distinct = np.unique(hashes)
        same = hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()
        n = len(distinct)
        rank = np.zeros(n, dtype=np.int64)
        if len(ordered):
            at = np.minimum(np.searchsorted(ordered, distinct), len(ordered) - 1)
            rank = np.where(ordered[at] == distinct, by_hash[at] + 1, 0)
        first = np.argsort(rank, kind="stable")[: n + (-over * n // under) + 1 if n else 0]
        last = int(rank[first[-1]]) if n else 0
        return same, n, distinct[first].view(np.int64), last, _majority(hashes, lanes)

    names = [f"f{j}" for j in range(lanes)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [row(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.int32()),
                    *[pa.array([r[4][j] for r in rows], pa.int64()) for j in range(lanes)],
                ],
                ["doc_id", "digest", "same", "n", "prefix", "last_rank", *names],
            )

    kinds = "doc_id long, digest long, same binary, n int, prefix array<long>, last_rank int, "
    return docs.mapInArrow(run, kinds + ", ".join(f"{n} long" for n in names))


def _alike(pairs: DataFrame, texts: DataFrame, words: int, tmp: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are alike, counted exactly from both texts.

    Texts are shorter than their sets. They lie in buckets of their node, so only those of pairs move:
    ``b``'s to its pairs, and these to ``a``'s text, which is read once for all pairs that follow.
    """
    first = texts.join(pairs.select(F.col("a").alias("_a")).distinct(), F.col("node") == F.col("_a"), "left_semi")
    first = tmp.written(first.select(F.col("node").alias("_a"), F.col("text").alias("one")), "first_texts")
    both = pairs.join(texts, F.col("b") == F.col("node")).select("a", "b", F.col("text").alias("two"))
    both = both.join(first, F.col("a") == F.col("_a")).select("a", "b", "one", "two")
    over, under = ALIKE

    def run(batches):
        import pyarrow as pa

        known, one = None, None
        for batch in batches:
            found = []
            for row, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if known != a:
                    known, one = a, np.unique(shingle_hashes(batch.column(2)[row].as_py(), words))
                two = np.unique(shingle_hashes(batch.column(3)[row].as_py(), words))
                shared = len(np.intersect1d(one, two, assume_unique=True))
                if (over + under) * shared >= over * (len(one) + len(two)):
                    found.append((a, b))
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate("ab")}
            )

    return both.mapInArrow(run, "a long, b long")


def _confirmed(near: DataFrame | None, pairs: DataFrame, texts: DataFrame, words: int, tmp: Scratch) -> DataFrame:
    """``near`` and those of ``pairs`` that are alike, without pairs which components join already.

    At first each node is compared with its smallest partner only, so that large groups come together
    at a price that grows with their size; then all pairs that are still apart are compared.
    """
    rest = tmp.written(pairs.distinct(), "pairs")
    for turn in range(THIN_ROUNDS + 1):
        if near is not None and not near.isEmpty():
            labels = tmp.written(connected_components(near, tmp.written), "labels")
            one, two = (labels.select(F.col("node").alias("_" + s), F.col("root").alias("root_" + s)) for s in "ab")
            rest = rest.join(one, F.col("a") == F.col("_a"), "left").join(two, F.col("b") == F.col("_b"), "left")
            apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
            rest = tmp.written(rest.filter(apart).select("a", "b"), "pairs")
        if rest.isEmpty():
            break
        some = rest
        if turn < THIN_ROUNDS:
            some = tmp.written(rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "thin")
            rest = tmp.written(rest.join(some, ["a", "b"], "left_anti"), "pairs")
        found = _alike(some, texts, words, tmp)
        near = tmp.written(found if near is None else near.unionByName(found), "alike")
    return near if near is not None else rest


def _may_be_alike(a_shared, a_n, b_shared, b_n) -> F.Column:
    """Whether sets of ``a_n`` and ``b_n`` shingles that share at most ``a_shared`` and ``b_shared`` may be ``ALIKE``."""
    over, under = ALIKE
    return (over + under) * F.least(a_shared, b_shared) >= over * (a_n + b_n)


def _prefix_keys(nodes: DataFrame, labels: DataFrame, tmp: Scratch) -> DataFrame:
    """The shingles of all prefixes by which a set may be found alike to one of another label.

    ``at`` is the shingle's place in the prefix, ``private`` says how many of the prefix's later shingles stand in
    no prefix of another label. If two sets share a shingle first at ``at``, none of those before it is shared, so
    a set that is no longer alike to the shortest holder of the shingle (``least``) is left out there.
    """
    over, under = ALIKE
    known = nodes.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    label = F.coalesce("root", "node").alias("label")
    keys = known.select("id", "n", label, F.posexplode("prefix").alias("at", "key"))
    several = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"))
    several = tmp.written(several.filter("low < high").select("key", "least"), "several")
    held = keys.select("id", "at", "key").join(several, "key")
    # Written first, so that the join to it moves few rows.
    held = tmp.written(held.withColumnRenamed("id", "_id"), "held")
    last = F.element_at("prefix", -1).bitwiseXOR(F.lit(-(2**63)))
    ends = known.select("id", "node", "n", label, F.size("prefix").alias("size"), F.struct("last_rank", last.alias("last")).alias("end"))
    later = Window.partitionBy("id").orderBy(F.desc("at"))
    private = F.col("size") - F.col("at") - F.row_number().over(later)
    keys = held.join(ends, F.col("id") == F.col("_id")).withColumn("private", private)
    shortest = F.greatest(under * F.col("least"), over * F.col("n"))
    keys = keys.filter((over + under) * under * (F.col("n") - F.col("at")) >= over * (under * F.col("n") + shortest))
    keys = tmp.written(keys.select("key", "id", "node", "label", "n", "at", "private", "end"), "keys")
    several = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return tmp.written(keys.join(tmp.written(several.select("key"), "several"), "key"), "keys")


def _by_prefix(nodes: DataFrame, labels: DataFrame, tmp: Scratch) -> DataFrame:
    """Pairs of nodes of different labels that share a shingle of their prefixes and may be alike.

    Of the first shingle that two sets share, only what follows it can be shared as well; and the prefix that ends
    first in the order of all shingles shares none of its private ones, see :func:`_prefix_keys`. Pairs that
    cannot be alike by this are not listed: else all members of a group of loosely similar texts would meet.

    Whichever prefix ends first, what its set holds beyond is all that the other can share besides shingles of both
    prefixes. So a pair that shares too few of these is left out before its texts move.

    ``nodes`` without ``id`` has one row a node, without ``last_rank`` no frequent shingles.
    """
    over, under = ALIKE
    if "id" not in nodes.columns:
        nodes = nodes.withColumn("id", F.col("node"))
    if "last_rank" not in nodes.columns:
        nodes = nodes.withColumn("last_rank", F.lit(0))
    nodes = nodes.withColumn("n", F.col("n").cast("long"))
    keys = _prefix_keys(nodes, labels, tmp)
    rest = {s: F.col(f"{s}.n") - F.col(f"{s}.at") for s in "ab"}
    first = {s: F.when(F.col(f"{s}.end") <= F.col(f"{o}.end"), F.col(f"{s}.private")).otherwise(0) for s, o in ("ab", "ba")}
    may = _may_be_alike(rest["a"] - first["a"], F.col("a.n"), rest["b"] - first["b"], F.col("b.n"))
    apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    # A shorter set than over / under of the other cannot be alike, wherever they meet.
    sized = (under * F.col("a.n") >= over * F.col("b.n")) & (under * F.col("b.n") >= over * F.col("a.n"))
    met = keys.alias("a").join(keys.alias("b"), (F.col("a.key") == F.col("b.key")) & apart & sized & may)
    pairs = tmp.written(met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct(), "met")
    one, two = (nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "node", "n", "prefix")]) for s in "ab")
    pairs = pairs.join(one, "id_a").join(two, "id_b")
    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    beyond = F.greatest(F.col("n_a") - F.size("prefix_a"), F.col("n_b") - F.size("prefix_b"))
    enough = (over + under) * (shared + beyond) >= over * (F.col("n_a") + F.col("n_b"))
    return pairs.filter(enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def alike(documents: DataFrame, words: int, lanes: int, segments: int, most: int) -> DataFrame:
    """doc_id, digest and ``component_id``: the smallest doc_id reached by pairs that are ``ALIKE``.

    The ring of fingerprints names most pairs, and all are confirmed by their sets of shingles. Near
    copies that the ring misses (it is not complete here) share a shingle of their prefixes, so every
    pair of different components that does is compared as well: none is lost.
    """
    docs = columns_of(documents, doc_id="long", text="string").select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest")
    )
    names = [f"f{j}" for j in range(lanes)]
    with Scratch(documents.sparkSession) as tmp:
        found = tmp.written(sketches(docs, words, lanes), "sketches")
        values = F.struct("digest", "n", "prefix", "last_rank", *names)
        nodes = found.filter("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("node"), F.min_by(values, "doc_id").alias("_v"))
        nodes = tmp.written(nodes.select(F.monotonically_increasing_id().alias("id"), "same", "node", "_v.*"), "nodes")
        found = tmp.written(found.select("doc_id", "digest", "same"), "found")
        tmp.drop("sketches")
        # Joined by the node alone, so that the buckets of nodes come out of the join; a row may stand several times.
        own = (F.col("doc_id") == F.col("node")) & (F.col("_d").bitwiseXOR(F.col("digest")) == 0)
        texts = docs.join(nodes.select("node", F.col("digest").alias("_d")), own).select("node", "text")
        texts = tmp.bucketed(texts.dropDuplicates(["node"]), "node", "texts")
        ring = links(nodes.select("node", *names), lanes, segments, most, pairwise=PAIRWISE_BUCKET_WIDE, write=tmp.written)
        ring = tmp.written(ring.filter("a != b").distinct(), "named")
        tmp.drop("ring", "ring_and_stars", "hot", "large", "leaders", "known", "main", "apart", "labels")
        near = _confirmed(None, ring, texts, words, tmp)
        near = tmp.written(near, "by_ring")
        labels = tmp.written(connected_components(near, tmp.written), "ring_labels")
        near = _confirmed(near, _by_prefix(nodes, labels, tmp), texts, words, tmp)
        tmp.drop("texts", "held", "keys", "several", "met")
        roots = connected_components(near, tmp.written).withColumnRenamed("node", "_node")
        parts = nodes.join(roots, F.col("node") == F.col("_node"), "left")
        parts = tmp.written(parts.select(F.col("same").alias("_same"), F.coalesce("root", "node").alias("_part")), "parts")
        joined = found.join(parts, F.col("same") == F.col("_same"), "left")
        return written(
            joined.select("doc_id", "digest", F.when(F.col("doc_id").isNotNull(), F.col("_part")).alias("component_id")), "alike"
        )


def deduplicated(documents: DataFrame, words: int = 5, lanes: int = 6, segments: int = 24, most: int = 62) -> DataFrame:
    """``documents`` without near copies: of each component the row of the smallest doc_id stays.

    Near copies share at least 0.8 of their distinct five-word shingles (Jaccard), counted exactly, see
    :func:`alike`. Of 384 bits such texts of the same length differ in about 58, with a deviation of 7,
    and texts that share none in 192. Rows without doc_id stay. Rows that repeat a doc_id and its text stay once; rows that
    share a doc_id but not the text are one document's versions, and those of the kept id stay.
    """
    found = alike(documents, words, lanes, segments, most)
    keep = found.filter("doc_id is not null and doc_id = component_id").groupBy("doc_id", "digest").agg(
        F.count("*").alias("_n")
    )
    keep = written(keep.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"), "_n"), "keep")
    # All columns in one, so that none can clash with ours.
    docs = documents.select(
        F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("d")
    )
    own = (F.col("id") == F.col("_id")) & (F.col("d") == F.col("_d"))
    kept = docs.join(keep.filter("_n = 1"), own, "left_semi").select("doc")
    repeated = keep.filter("_n > 1")
    if not repeated.isEmpty():
        again = docs.join(repeated, own, "left_semi").groupBy("id", "d").agg(F.first("doc").alias("doc"))
        kept = kept.unionByName(again.select("doc"))
    return kept.unionByName(docs.filter("id is null").select("doc")).select("doc.*")
