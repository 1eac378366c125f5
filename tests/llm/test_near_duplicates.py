"""SimHash, components, substring dedup and embeddings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vacancyledger.llm import ann, common, embedding_dedup, graph, simhash, substring
from vacancyledger.llm.graph import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("held", [500_000, 60])
@pytest.mark.parametrize("shape", ["path", "star", "random", "empty", "self"])
def test_components(spark, shape, held, monkeypatch):
    monkeypatch.setattr(graph, "TASK_LINKS", held)  # with few links a task, star rounds must do the rest
    rng = random.Random(2)
    edges = {
        "path": [(i, i + 1) for i in range(200)],
        "star": [(7, i) for i in range(300)],
        "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)],
        "empty": [],
        "self": [(5, 5), (-3, 9), (9, -3)],
    }[shape]
    rng.shuffle(edges)
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {n: sets.root(n) for n in sets.up}


def plain_fingerprint(text, words):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    split = WORDS.findall(lower)
    shingles = [" ".join(split[i : i + words]) for i in range(len(split) - words + 1)] or ([" ".join(split)] if split else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows, most):
    """Components of (doc_id, fingerprint) by comparing all pairs."""
    sets = Sets({i for i, _ in rows})
    for n, (i, f) in enumerate(rows):
        for j, g in rows[:n]:
            if (f ^ g).bit_count() <= most:
                sets.join(i, j)
    return {i: sets.root(i) for i, _ in rows}


def test_fingerprints_and_components(sample):
    rows = {r.doc_id: r.text for r in sample("documents").collect()}
    got = {r.doc_id: r for r in simhash.near_duplicates(sample("documents")).collect()}
    prints = {i: plain_fingerprint(t, 3) for i, t in rows.items()}
    assert {i: r.f0 % 2**64 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == linked(sorted(prints.items()), 2)


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(5000)).encode()
    whole = simhash.fingerprint(text, 5, 3)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text, 5, 3) == whole


@pytest.mark.parametrize(("lanes", "segments", "most"), [(1, 5, 2), (1, 7, 3), (2, 9, 4)])
@pytest.mark.parametrize("pairwise", [256, 3])
def test_ring_loses_no_link(spark, lanes, segments, most, pairwise):
    """Clouds of fingerprints around few centres, with buckets below and above the pairwise size."""
    rng = random.Random(most)
    rows, bits = {}, 64 * lanes
    for centre in range(4):
        start = rng.getrandbits(bits)
        for _ in range(60 if centre else 150):
            value = start
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(bits)
            rows.setdefault(value, len(rows))
    for _ in range(200):
        rows.setdefault(rng.getrandbits(bits), len(rows))

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    table = [(n, *[signed(v >> 64 * (lanes - 1 - j) & (2**64 - 1)) for j in range(lanes)]) for v, n in rows.items()]
    df = spark.createDataFrame(table, "node long, " + ", ".join(f"f{j} long" for j in range(lanes)))
    got = connected_components(simhash.links(df, lanes, segments, most, pairwise=pairwise))
    want = linked([(n, v) for v, n in rows.items()], most)
    found = {n: n for n in want} | {r.node: r.root for r in got.collect()}
    assert found == want


def test_simhash_of_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    part = {r.doc_id: r.component_id for r in rows}
    assert part[1] == part[2] == part[3] == 1 and part[4] == part[5] == 4 and part[None] is None
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicated(awkward)
    assert kept.dtypes == awkward.dtypes
    assert sorted((str(r.doc_id), str(r.text)[:9]) for r in kept.collect()) == sorted(
        [("1", "None"), ("4", "one"), ("6", "word word"), ("7", "é中😀 mixed"), ("None", "no id"), ("None", "None")]
    )
    assert simhash.deduplicated(nothing).count() == 0


def test_stage_finds_near_copies_and_keeps_others(documents):
    rng = random.Random(1)
    rows, groups = [], defaultdict(set)
    for base in range(60):
        text = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(150, 400))]
        for copy in range(4):
            words = list(text)
            if copy:  # about 0.93 of the shingles stay
                words[rng.randrange(len(words))] = f"edit{copy}"
            rows.append((len(rows), " ".join(words)))
            groups[base].add(len(rows) - 1)
    kept = {r.doc_id for r in simhash.deduplicated(documents(rows)).collect()}
    assert kept == {min(g) for g in groups.values()}


def shingle_set(text):
    split = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(split[i : i + 5]) for i in range(max(1, len(split) - 4))} if split else set()


def kept_by_jaccard(rows):
    """Smallest ids of the components of pairs that share 4/5 of their shingles, by comparing all."""
    ids, sets = Sets({i for i, _ in rows}), [(i, shingle_set(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if 5 * len(a & b) >= 4 * len(a | b):
                ids.join(i, j)
    return {ids.root(i) for i, _ in rows}


def test_stage_links_at_the_threshold(documents):
    """Isolated pairs just above 0.8, exactly at it and well under it; lengths equal and different."""
    rng = random.Random(8)
    rows, shared = [], []
    while len(shared) < 240:
        text = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([60, 139, 229, 400]))]
        copy = list(text) + [f"z{rng.randint(0, 10**6)}" for _ in range(rng.choice([0, 0, len(text) // 9]))]
        for at in rng.sample(range(len(text)), rng.randint(1, len(text) // 25)):
            copy[at] = f"y{rng.randint(0, 10**6)}"
        a, b = shingle_set(" ".join(text)), shingle_set(" ".join(copy))
        similarity = len(a & b) / len(a | b)
        if (0.8 <= similarity <= 0.85, 0.7 <= similarity <= 0.78)[len(shared) % 2]:
            rows += [(2 * len(shared), " ".join(text)), (2 * len(shared) + 1, " ".join(copy))]
            shared.append(similarity)
    kept = {r.doc_id for r in simhash.deduplicated(documents(rows)).collect()}
    want = {i for n, s in enumerate(shared) for i in ([2 * n] if s >= 0.8 else [2 * n, 2 * n + 1])}
    assert kept == want


def test_stage_equals_brute_force(sample, documents, monkeypatch):
    """Real rows, a large group with links only between neighbours, and texts that share a frequent passage."""
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET_WIDE", 4)
    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    rng = random.Random(5)
    words = [f"c{rng.randint(0, 10**6)}" for _ in range(100)]
    for n in range(60):
        rows.append((10_000 + n, " ".join(words)))
        words = words[3:] + [f"c{rng.randint(0, 10**6)}" for _ in range(3)]
    passage = [f"p{n}" for n in range(80)]
    rows += [(20_000 + n, " ".join(passage + [f"q{rng.randint(0, 10**6)}" for _ in range(n % 40)])) for n in range(80)]
    # The same majority of shingles, but few different ones in common.
    rows += [(30_000, "a b c d e " * 50), (30_001, "a b c d e " * 50 + " ".join(f"r{n}" for n in range(20)))]
    kept = {r.doc_id for r in simhash.deduplicated(documents(rows)).collect()}
    assert kept == kept_by_jaccard(rows)


def repeated(rows, window):
    """n_words, n_removed and digest of the kept words per row, by all windows of all smaller ids."""
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = WORDS.findall(text or "")
        if doc_id is not None:
            for j in range(len(words) - window + 1):
                seen.setdefault(tuple(words[j : j + window]), doc_id)
    for doc_id, text in rows:
        words = WORDS.findall(text or "")
        gone = set()
        for j in range(len(words) - window + 1):
            first = seen.get(tuple(words[j : j + window]))
            if doc_id is not None and first is not None and first < doc_id:
                gone |= set(range(j, j + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def substring_rows(df, window):
    rows = substring.without_repeats(df, window)
    return sorted((tuple(r) for r in rows.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("window", [50, 6])
def test_substrings_equal_brute_force(sample, window):
    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    assert substring_rows(sample("documents"), window) == repeated(rows, window)


def test_substrings_of_shared_passages(documents, monkeypatch):
    """Passages of exactly and just under the window, chains of owners, self-repeats, small shards."""
    monkeypatch.setattr(substring, "SHARD_WORDS", 300)
    monkeypatch.setattr(substring, "STREAM_WORDS", 200)
    monkeypatch.setattr(substring, "BLOCK", 16)
    rng = random.Random(3)

    def noise(n):
        return [f"n{rng.randint(0, 10**9)}" for _ in range(n)]

    passages = [noise(n) for n in (9, 10, 11, 35, 80)]
    rows = []
    for i in range(150):
        words = noise(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            words += p[a:] if rng.random() < 0.5 else p
            words += noise(rng.randint(0, 12))
        rows.append((i * 3 % 151, " ".join(words)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, "a b " * 40), (503, "a b " * 60), (503, "b a " * 9)]
    assert substring_rows(documents(rows), 10) == repeated(rows, 10)


def test_substrings_of_awkward_rows(awkward, nothing, documents):
    from .conftest import AWKWARD

    rows = [(i, t) for i, t, _ in AWKWARD]
    assert substring_rows(awkward, 50) == repeated(rows, 50)
    assert substring.without_repeats(nothing).count() == 0
    spans = substring.without_repeats(documents([(1, "a b c d e"), (2, "x a b c d e y")]), 3)
    assert [r.removed for r in spans.filter("doc_id = 2").collect()] == [[(1, 6)]]


def test_automaton_knows_every_substring():
    rng = random.Random(9)
    for _ in range(40):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 25))] for _ in range(4)]
        machine = substring.Automaton(window=3)
        for owner, text in enumerate(texts):
            machine.add(text, owner + 10)
        machine.finish()
        probe = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(30)]
        for i, (size, state) in enumerate(machine.statistics(probe)):
            longest = max((n for n in range(i + 2) if any(tuple(probe[i + 1 - n : i + 1]) in windows(t, n) for t in texts)), default=0)
            assert size == longest
            if size >= 3:
                owners = [o + 10 for o, t in enumerate(texts) if tuple(probe[i - 2 : i + 1]) in windows(t, 3)]
                assert machine.owner[machine.top[state]] == min(owners)


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else {()}


def vectors(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "1 AS label", "2 AS id", "'x' AS vec", "3 AS n", "4 AS bucket") if extra else df


def cloud(rng, groups, alone, dim=16, spread=0.02):
    out = []
    for size in groups:
        centre = rng.normal(size=dim)
        out += [centre + spread * rng.normal(size=dim) for _ in range(size)]
    out += list(rng.normal(size=(alone, dim)))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]


def cosine_links(rows, least):
    ids = [i for i, _ in rows]
    units = np.array([np.float32(v) for _, v in rows], dtype=float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    near = units @ units.T >= least
    np.fill_diagonal(near, False)
    sets = Sets(ids)
    for a, b in zip(*np.nonzero(near), strict=True):
        sets.join(ids[a], ids[b])
    return {i: (int(n), sets.root(i), sets.root(i) == i) for i, n in zip(ids, near.sum(axis=1), strict=True)}


@pytest.mark.parametrize("spread", [0.02, 0.16])
def test_embedding_links_equal_brute_force(spark, spread, monkeypatch):
    """Tight and loose groups, some larger than the longest neighbour list."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    rows = cloud(np.random.default_rng(4), [2, 2, 3, 5, 9, 20, 150], 300, spread=spread)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    want = cosine_links(rows, 0.95)
    true, found = sum(v[0] for v in want.values()), sum(v[0] for v in got.values())
    assert found <= true and found >= 0.99 * true
    if spread == 0.02:
        assert got == want


@pytest.mark.parametrize("spread", [0.001, 0.01])
def test_embedding_links_between_dense_groups(spark, spread, monkeypatch):
    """A chain of groups that fill every list by themselves, all or some of whose vectors link across."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(7)
    rows = []
    for n, size in enumerate([60, 70, 50]):
        turn = np.zeros(16)
        turn[:2] = np.cos(np.radians(16 * n)), np.sin(np.radians(16 * n))
        rows += [turn + spread * rng.normal(size=16) for _ in range(size)]
    rows += list(rng.normal(size=(60, 16)))
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert got == cosine_links(rows, 0.95)


def test_embedding_links_of_a_search_that_fails(spark, monkeypatch):
    """Without a first graph nothing is found: all links come from the blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "first_graph", lambda nodes, *a: nodes.limit(0).selectExpr("id", "id AS other", "0D AS cosine"))
    rows = cloud(np.random.default_rng(5), [2, 3, 9, 60], 100)
    rows.append((999, rows[0][1]))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert got == cosine_links(rows, 0.95)


def test_an_audit_without_enough_links_does_not_pass(spark, monkeypatch):
    """One pair among vectors that the largest sample cannot hold."""
    monkeypatch.setattr(embedding_dedup, "AUDIT_VECTORS", 8)
    monkeypatch.setattr(embedding_dedup, "MOST_AUDIT_VECTORS", 16)
    rows = cloud(np.random.default_rng(6), [2], 200)
    nodes, kind, dim = embedding_dedup.packed(vectors(spark, rows))
    assert embedding_dedup.neighbour_graph(nodes, kind, dim, len(rows), 0.95)[2] < embedding_dedup.AUDIT_RECALL


AWKWARD_VECTORS = [
    (1, [1.0, 0.0, 0.0]),
    (2, [1.0, 0.0, 0.0]),
    (3, [2.0, 0.0, 0.0]),
    (4, [0.0, 1.0, 0.0]),
    (4, [0.0, 1.0, 0.0]),
    (5, None),
    (6, [0.0, 0.0, 0.0]),
    (7, [None, 1.0, 0.0]),
    (8, [float("nan"), 1.0, 0.0]),
    (9, [float("inf"), 1.0, 0.0]),
    (10, []),
    (11, [1.0, 0.0]),
    (None, [1.0, 0.0, 0.0]),
]


def test_embedding_links_of_awkward_rows(spark):
    rows = embedding_dedup.near_duplicates(vectors(spark, AWKWARD_VECTORS)).collect()
    got = sorted(map(tuple, rows), key=str)
    alone = [(i, 0, i, True) for i in (4, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 0, None, True), *alone], key=str)
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def exact_neighbours(rows, k, is_query):
    out = {}
    units = {i: np.array(np.float32(v), dtype=float) for i, v in rows}
    for q in units:
        if is_query(q):
            scores = sorted((-(units[q] * v).sum() / np.sqrt((units[q] ** 2).sum()) / np.sqrt((v * v).sum()), i) for i, v in units.items() if i != q)
            out[q] = scores[:k]
    return out


def test_search_recall_and_scores(spark, sample):
    table = sample("embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = defaultdict(list)
    for r in ann.nearest(table, lambda c: c % 5 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = exact_neighbours(rows, 5, lambda i: i % 5 == 0)
    assert got.keys() == want.keys()
    hits = 0
    for q, best in want.items():
        assert [x[0] for x in got[q]] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in got[q]] == sorted((-s, i) for _, i, s in got[q])
        hits += len({i for _, i in best} & {i for _, i, _ in got[q]})
        exact = dict((i, -s) for s, i in exact_neighbours(rows, len(rows), lambda i, q=q: i == q)[q])
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in got[q])
    assert hits >= 0.9 * 5 * len(want)


def test_search_of_dense_groups(spark, monkeypatch):
    """Most vectors in one tight group, dealt to several blocks; ties go to the smaller id."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(6)
    rows = cloud(rng, [300], 100)
    rows += [(1000 + i, rows[0][1]) for i in range(10)]
    got = defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), lambda c: c % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = exact_neighbours(rows, 5, lambda i: i % 20 == 0)
    assert got[0] == [1000, 1001, 1002, 1003, 1004]
    hits = sum(len({i for _, i in best} & set(got[q])) for q, best in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_search_of_awkward_rows(spark):
    rows = ann.nearest(vectors(spark, AWKWARD_VECTORS), lambda c: c > 0, k=5).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert got == {
        1: [(2, 1.0), (3, 1.0), (4, 0.0)],
        2: [(1, 1.0), (3, 1.0), (4, 0.0)],
        3: [(1, 1.0), (2, 1.0), (4, 0.0)],
        4: [(1, 0.0), (2, 0.0), (3, 0.0)],
    }
    assert ann.nearest(vectors(spark, []), lambda c: c > 0).count() == 0
    assert ann.nearest(vectors(spark, AWKWARD_VECTORS[:1]), lambda c: c > 0).count() == 0


def test_chances_are_those_of_the_model():
    """Share of simulated neighbours that fall in each bucket against the estimate."""
    rng = np.random.default_rng(8)
    sample = rng.normal(size=(2000, 32))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    index = ann.fit_index(sample, 100_000, 5, seed=1)
    unit, c = sample[0], index.cosine
    side = rng.normal(size=(20_000, 32))
    side -= (side @ unit)[:, None] * unit
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = c * unit + np.sqrt(1 - c * c) * side
    chance = index.chances(unit)
    assert chance.sum(axis=1) == pytest.approx([1.0] * ann.TABLES, abs=1e-4)
    probes = index.probes(unit)
    hit = np.zeros(len(near), bool)
    for t, buckets in enumerate(index.buckets(near).T):
        hit |= np.isin(buckets + t * ann.CELLS**ann.HASHES, probes)
    assert hit.mean() > ann.SUCCESS - 0.04


def test_fallback_compares_with_everything(spark, monkeypatch):
    monkeypatch.setattr(ann.Index, "probes", lambda self, unit: np.array([0]))
    rows = cloud(np.random.default_rng(3), [], 60)
    got = ann.nearest(vectors(spark, rows), lambda c: c < 3).collect()
    want = exact_neighbours(rows, 5, lambda i: i < 3)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(q, n + 1, i) for q, best in want.items() for n, (_, i) in enumerate(best)}


def test_prefix_pairs_leave_out_chance_meetings_and_lose_none(spark):
    """Sets that share one frequent shingle of their prefixes are not compared; all that are alike are."""
    rng = random.Random(5)
    sets = [sorted({0, *rng.sample(range(1, 4000), 60)}) for _ in range(40)]
    for base in list(sets[:20]):
        copy = set(base) - set(rng.sample(base, rng.randint(1, 6)))
        sets.append(sorted(copy | set(rng.sample(range(1, 4000), rng.randint(0, 4)))))
    rows = [(i, len(s), s[: len(s) - -(-4 * len(s) // 5) + 1]) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n int, prefix array<long>")
    labels = spark.createDataFrame([], "node long, root long")
    with common.Scratch(spark) as tmp:
        named = {(r.a, r.b) for r in simhash._by_prefix(nodes, labels, tmp).collect()}
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    near = {(i, j) for i, j in pairs if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert near and near <= named and len(named) < 2 * len(near)


@pytest.mark.parametrize("mixed", [False, True])
def test_prefix_keys_leave_out_members_of_loose_groups_and_lose_none(spark, mixed):
    """A large group around one passage, most of whose members are not alike: they do not all meet."""
    rng = random.Random(6)
    core = rng.sample(range(2000), 100) if mixed else range(5000, 5100)
    own, sets = iter(rng.sample(range(2000, 4000) if not mixed else [x for x in range(4000) if x not in set(core)], 1900)), []
    for i in range(100):
        changed = rng.randint(1, 8) if i < 12 else rng.randint(13, 18)
        sets.append(sorted(set(rng.sample(core, 100 - changed)) | {next(own) for _ in range(changed)}))
    rows = [(i, len(s), s[: len(s) - -(-4 * len(s) // 5) + 1]) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n int, prefix array<long>")
    labels = spark.createDataFrame([], "node long, root long")
    tables = {}

    class Kept(common.Scratch):
        def written(self, df, name="table"):
            tables[name] = super().written(df, name)
            return tables[name]

    with Kept(spark) as tmp:
        named = {(r.a, r.b) for r in simhash._by_prefix(nodes, labels, tmp).collect()}
        held = [r.m for r in tables["keys"].groupBy("key").agg(F.count("*").alias("m")).collect()]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    near = {(i, j) for i, j in pairs if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert near and near <= named
    assert mixed or sum(m * (m - 1) // 2 for m in held) < 10 * len(sets)
