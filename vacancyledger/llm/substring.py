"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, written, written_by

WINDOW = 50
#: Reference words per automaton and streamed words per task and automaton.
SHARD_WORDS, STREAM_WORDS = 16_384, 65_536
#: Window starts per block of a reference document.
BLOCK = 2048
# Odd multipliers of the two rolling hashes and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)


class _Hashes(dict):
    """Word to 64-bit hash, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxh64_intdigest(word, 9)
        return value


_hash_of = _Hashes()
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64; the longest table asked for is kept up to a million."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n]


def rolling(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k words (uint64, mixed); empty for fewer words."""
    n = len(hashes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _power(_INVERSES[which], n), out=prefix[1:])
    found = (prefix[k:] - prefix[:-k]) * _power(_BASES[which], n - k + 1)
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash_of.__getitem__, words), dtype=np.uint64, count=len(words))


def window_anchors(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per window, the smallest hash of its runs of a third as many words.

    It depends on the window's words alone, so equal windows have equal anchors wherever they stand,
    and neighbouring windows mostly share theirs.
    """
    k = max(1, window // 3)
    low, reach, need = rolling(hashes, k), 1, window - k + 1
    while reach * 2 <= need:
        low = np.minimum(low[:-reach], low[reach:]) if len(low) > reach else low[:0]
        reach *= 2
    over = need - reach
    if over:
        low = np.minimum(low[:-over], low[over:]) if len(low) > over else low[:0]
    return low


class Automaton:
    """Suffix automaton of several word sequences, each with an owner (a number)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link, self.owner = [0], [-1], [None]

    def add(self, words: list[bytes], owner: int) -> None:
        ids, last = self.ids, 0
        for word in words:
            last = self._extend(last, ids.setdefault(word, len(ids)), owner)

    def _state(self, length: int, owner: int) -> int:
        self.next.append({})
        self.length.append(length)
        self.link.append(0)
        self.owner.append(owner)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, word: int, owner: int) -> int:
        """Split off q the part that follows p, and move the shorter suffixes to it."""
        copy = self._state(self.length[p] + 1, owner)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int, owner: int) -> int:
        following, length = self.next, self.length
        q = following[last].get(word)
        if q is not None:  # known from an earlier sequence
            if length[q] != length[last] + 1:
                q = self._clone(last, q, word, owner)
            self.owner[q] = owner if self.owner[q] is None else min(owner, self.owner[q])
            return q
        new = self._state(length[last] + 1, owner)
        p = last
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = following[p][word]
            self.link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, word, owner)
        return new

    def finish(self) -> None:
        """Owner of a state: the smallest of all places it occurs at. ``top``: the shortest suffix's
        state that still has a whole window."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:
            up = self.link[v]
            if up > 0 and (self.owner[up] is None or self.owner[v] < self.owner[up]):
                self.owner[up] = self.owner[v]
        self.top = list(range(len(self.length)))
        for v in reversed(order):
            if self.length[self.link[v]] >= self.window:
                self.top[v] = self.top[self.link[v]]

    def statistics(self, words: list[bytes]):
        """Per word, (length of the longest match that ends there, its state)."""
        ids, following, link, length = self.ids.get, self.next, self.link, self.length
        state = size = 0
        for word in words:
            at = ids(word, -1)
            while state and at not in following[state]:
                state = link[state]
                size = length[state]
            if at in following[state]:
                state = following[state][at]
                size += 1
            else:
                size = 0
            yield size, state

    def spans(self, words: list[bytes], doc: int) -> list[tuple[int, int]]:
        """Maximal runs [start, end) of words covered by windows of an owner smaller than ``doc``."""
        found: list[tuple[int, int]] = []
        for i, (size, state) in enumerate(self.statistics(words)):
            if size >= self.window and self.owner[self.top[state]] < doc:
                start = i + 1 - self.window
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], i + 1)
                else:
                    found.append((start, i + 1))
        return found


def _digest() -> F.Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.col("text")).alias("digest")


def _scan(documents: DataFrame, window: int) -> DataFrame:
    """doc_id, digest, text_sha256, n_words, sha256 of all words, and the document's anchors. One pass, no
    shuffle."""
    docs = columns_of(documents, doc_id="long", text="string").select(
        "doc_id", _digest(), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"),
        F.col("text").cast("binary").alias("text"),
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            counts, shas, anchors = [], [], []
            for text in b.column(3):
                words = (text.as_py() or b"").split()
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(window_anchors(word_hashes(words), window)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(anchors, pa.list_(pa.int64()))],
                ["doc_id", "digest", "text_sha256", "n_words", "sha256", "anchors"],
            )

    return docs.mapInArrow(
        run, "doc_id long, digest long, text_sha256 string, n_words long, sha256 string, anchors array<long>"
    )


_SPAN = "doc_id long, digest long, span long"


def _spans(suspects: DataFrame, window: int) -> DataFrame:
    """Spans of windows whose anchor several documents have, each with its runs.

    ``span`` is the first word; a run is the windows next to one another that share their anchor, as
    (anchor, run: a hash of its windows' hashes, hashes: those of the windows).
    """
    import pyarrow as pa

    run_type = pa.struct([("anchor", pa.int64()), ("run", pa.int64()), ("hashes", pa.list_(pa.int64()))])
    names = ["doc_id", "digest", "span", "words", "n_words", "runs"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(run_type)]

    def runs(anchors: np.ndarray, hashes: np.ndarray) -> list[dict]:
        cuts = [0, *(np.flatnonzero(np.diff(anchors)) + 1).tolist(), len(anchors)]
        weights = _power(_BASES[1], max(b - a for a, b in zip(cuts, cuts[1:], strict=False)))
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            total = np.uint64((hashes[a:b] * weights[: b - a]).sum(dtype=np.uint64)) ^ np.uint64(b - a)
            out.append({"anchor": int(anchors[a].view(np.int64)), "run": int(total.view(np.int64)), "hashes": hashes[a:b].view(np.int64)})
        return out

    def batch(rows):
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            out = []
            for doc_id, digest, text, known in zip(*(b.column(i) for i in range(4)), strict=True):
                words = text.as_py().split()
                hashed = word_hashes(words)
                shared = np.asarray(known.values, dtype=np.int64).view(np.uint64)
                anchors = window_anchors(hashed, window)
                hit = np.flatnonzero(np.isin(anchors, shared))
                if not len(hit):
                    continue
                hashes = rolling(hashed, window)
                for part in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    # A very long span is cut, so that rows stay small; each window is in one part.
                    for at in range(int(part[0]), int(part[-1]) + 1, BLOCK):
                        to = min(at + BLOCK, int(part[-1]) + 1)
                        own = words[at : to + window - 1]
                        out.append(
                            (doc_id.as_py(), digest.as_py(), at, b" ".join(own), len(own), runs(anchors[at:to], hashes[at:to]))
                        )
                        if len(out) >= 1000:
                            yield batch(out)
                            out = []
            yield batch(out)

    schema = f"{_SPAN}, words binary, n_words long, runs array<struct<anchor: long, run: long, hashes: array<long>>>"
    return suspects.select("doc_id", "digest", "text", "shared").mapInArrow(run, schema)


def _routes(spans: DataFrame) -> DataFrame:
    """(doc_id, digest, span, owner): the spans (of smaller doc_ids, or of the document itself where it is
    the first) that hold the repeated windows of a span, such that each of them stands in one.

    Runs with the same windows are one: its first document has all of them, and other documents need no
    other reference for it. Windows are compared one by one only where an anchor has several distinct
    runs, as equal windows have equal anchors; of each, the first document counts.
    """
    place = F.struct("doc_id", "digest", "span")
    runs = spans.select("doc_id", "digest", "span", F.inline("runs"))
    distinct = runs.groupBy("anchor", "run").agg(
        F.min(place).alias("first"), F.max("doc_id").alias("last"), F.min_by("hashes", place).alias("hashes")
    )
    distinct = written(distinct, "runs")
    mixed = distinct.groupBy(F.col("anchor").alias("_mixed")).agg(F.count("*").alias("_n")).filter("_n > 1")
    mixed = written(mixed.select("_mixed"), "mixed")
    several = distinct.join(mixed, F.col("anchor") == F.col("_mixed"))
    windows = several.select("anchor", "run", "first", "last", F.explode("hashes").alias("hash"))
    windows = written(windows, "one_by_one")
    # Anchor and hash together tell windows apart, by 128 bits.
    firsts = windows.groupBy(F.col("anchor").alias("_anchor"), F.col("hash").alias("_hash")).agg(
        F.min("first").alias("owner"), F.max("last").alias("_last")
    )
    firsts = written(firsts.filter("_last > owner.doc_id").select("_anchor", "_hash", "owner"), "firsts")
    held = windows.select("anchor", "run", "hash").join(
        firsts, (F.col("anchor") == F.col("_anchor")) & (F.col("hash") == F.col("_hash"))
    )
    held = held.groupBy(F.col("anchor").alias("_anchor"), F.col("run").alias("_run")).agg(F.collect_set("owner").alias("owners"))
    known = distinct.select("anchor", "run", "first", "last").join(
        held, (F.col("anchor") == F.col("_anchor")) & (F.col("run") == F.col("_run")), "left"
    )
    # A run that no other document shares, nor any of its windows, needs no reference.
    known = known.filter("owners is not null or last > first.doc_id").select(
        F.col("anchor").alias("_anchor"), F.col("run").alias("_run"), "first",
        F.coalesce("owners", F.array("first")).alias("owners"),
    )
    known = written(known, "known")
    own = runs.select("doc_id", "digest", "span", "anchor", "run").join(
        known, (F.col("anchor") == F.col("_anchor")) & (F.col("run") == F.col("_run"))
    )
    copied = F.col("first.doc_id") < F.col("doc_id")
    chosen = F.when(copied, F.array("first")).otherwise(F.col("owners"))
    return own.select("doc_id", "digest", "span", F.explode(chosen).alias("owner")).distinct()


def repeated_spans(scan: DataFrame, documents: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, found) with the spans [start, end) of words to remove, and the texts (doc_id,
    digest, text) of the documents in question.

    ``scan`` has one row per document of distinct text. Reference are the first documents of repeated
    windows: rolling hashes over all documents say which windows repeat and where each stands first.
    Those passages are dealt to shards of bounded size. A shard's automaton goes to every task that
    streams documents for it, and the passages of any document that may match it are streamed there.
    """
    anchors = scan.select("doc_id", F.explode("anchors").alias("anchor"))
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b")
    several = written(several.select(F.col("anchor").alias("_anchor")), "anchors")
    hits = anchors.join(several, F.col("anchor") == F.col("_anchor"))
    marked = hits.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("anchor").alias("shared"))
    docs = columns_of(documents, doc_id="long", text="string").select("doc_id", _digest(), F.col("text").cast("binary").alias("text"))
    suspects = docs.join(written(marked, "marked"), F.col("doc_id") == F.col("_id")).drop("_id")
    # Repeated rows of a document are one text.
    suspects = written_by(suspects.dropDuplicates(["doc_id", "digest"]), "doc_id")
    spans = written(_spans(suspects, window), "spans")

    key = ["doc_id", "digest", "span"]
    routes = written(_routes(spans), "routes")
    lengths = spans.select(*key, "n_words").join(routes.select(F.col("owner.*")).distinct(), key, "left_semi")
    total = lengths.agg(F.sum("n_words")).first()[0] or 0
    shards = int(max(1, -(-total // SHARD_WORDS)))

    def shard(prefix: str = ""):
        return F.pmod(F.xxhash64(*[F.col(prefix + k) for k in key]), F.lit(shards)).cast("int").alias("shard")

    # Where a span is streamed, and the shard it is a reference of: one way each, so words move once.
    streamed = routes.filter(F.col("owner.doc_id") < F.col("doc_id")).select(*key, shard("owner."), F.lit(False).alias("reference"))
    referred = routes.select(F.col("owner.*")).select(*key, shard(), F.lit(True).alias("reference"))
    ways = written(streamed.unionByName(referred).distinct(), "ways")
    placed = written(spans.select(*key, "words", "n_words").join(ways, key), "placed")
    stream, reference = placed.filter("not reference"), placed.filter("reference")
    load = stream.groupBy("shard").agg(F.ceil(F.sum("n_words") / STREAM_WORDS).cast("int").alias("salts"))
    load = written(load, "load")
    split = stream.join(load, "shard").select(
        "shard", F.pmod(F.xxhash64(*key, F.lit(1)), F.col("salts")).cast("int").alias("salt"), *key, "words"
    )
    copies = reference.select(F.col("shard").alias("shard"), F.col("doc_id").alias("doc_id"), F.col("words").alias("words"))
    copies = copies.join(load, "shard")
    copies = copies.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "doc_id", "words")

    def match(reference_, streamed):
        import pandas as pd

        automaton = Automaton(window)
        for doc_id, words in zip(reference_["doc_id"], reference_["words"], strict=True):
            automaton.add(words.split(), int(doc_id))
        automaton.finish()
        rows = [
            (doc_id, digest, span + a, span + b)
            for doc_id, digest, span, words in zip(*(streamed[k] for k in [*key, "words"]), strict=True)
            for a, b in automaton.spans(words.split(), int(doc_id))
        ]
        return pd.DataFrame(rows, columns=["doc_id", "digest", "start", "end"])

    matched = copies.groupBy("shard", "salt").cogroup(split.groupBy("shard", "salt"))
    found = matched.applyInPandas(match, "doc_id long, digest long, start long, end long")
    removed = found.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"))
    return removed, suspects.select("doc_id", "digest", "text")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and ``removed`` (spans [start, end) of words).

    A word goes if it lies in ``window`` consecutive words that a document with a smaller doc_id has
    as well; windows are judged on the input. Null and empty texts have no words. Texts of fewer words
    than ``window`` stay whole. A text that a smaller doc_id has as a whole needs no search: all its
    words go. Rows that repeat a doc_id are judged each on its own text, and never against one
    another; rows without doc_id stay whole and remove nothing. An empty table gives no rows.
    """
    scan = written(_scan(documents, window), "scan")
    known = scan.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    copies = known.groupBy(F.col("text_sha256").alias("_sha")).agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    copies = written(copies.filter("_last > _first").select("_sha", "_first"), "copies")
    is_copy = F.coalesce((F.col("doc_id") > F.col("_first")) & (F.col("n_words") >= window), F.lit(False))
    flagged = scan.drop("anchors").join(copies, F.col("text_sha256") == F.col("_sha"), "left")
    flagged = written(flagged.withColumn("is_copy", is_copy).drop("_sha", "_first", "text_sha256"), "flagged")
    repeated = flagged.filter("is_copy").select("doc_id", "digest").distinct()
    distinct = known.select("doc_id", "digest", "anchors").join(repeated, ["doc_id", "digest"], "left_anti")
    removed, texts = repeated_spans(distinct, documents, window)
    removed = written(removed, "removed")
    # Joined by doc_id alone, the texts stay in their buckets; the digest tells a doc_id's texts apart.
    mine = (F.col("doc_id") == F.col("_of")) & (F.col("digest").bitwiseXOR(F.col("_text")) == 0)
    removed = removed.select(F.col("doc_id").alias("_of"), F.col("digest").alias("_text"), "found")
    rows = texts.join(removed, mine)

    def cut(batches):
        import pyarrow as pa

        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            out = []
            for doc_id, digest, text, found in zip(*(b.column(i) for i in range(4)), strict=True):
                words = text.as_py().split()
                spans: list[dict] = []
                for f in found.as_py():
                    if spans and f["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], f["end"])
                    else:
                        spans.append(dict(f))
                at, kept = 0, []
                for s in spans:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
                out.append((doc_id.as_py(), digest.as_py(), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pair)]
            names = ["_id", "_digest", "n_removed", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    spans_type = "array<struct<start: long, end: long>>"
    done = rows.select("doc_id", "digest", "text", "found").mapInArrow(
        cut, f"_id long, _digest long, n_removed long, kept string, spans {spans_type}"
    )
    done = written(done, "done")
    out = flagged.join(done, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    all_words = F.expr(f"cast(array(named_struct('start', 0L, 'end', n_words)) as {spans_type})")
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("is_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("is_copy"), nothing).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
        F.when(F.col("is_copy"), all_words).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {spans_type})"))).alias("removed"),
    )
