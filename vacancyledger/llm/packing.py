"""Best-fit packing of token sequences by exact-complement hashing."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, map_rows, uniform_key, with_positions, written

CAPACITY, END_ID = 1024, 2
#: Longest unbroken text that the faster library is given; beyond it both must agree on less common paths.
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level vocabulary, without special tokens added."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def __call__(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class FastEncoder(Encoder):
    """The same ids by the rank form of the same vocabulary, where both agree by construction.

    Texts with a special token's string, with characters beyond U+024F (whose classes depend on the
    library's Unicode version) or with very long unbroken runs go to the tokenizer itself.
    """

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str):
        import base64
        import re

        import tiktoken

        super().__init__(tokenizer_file)
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile(r"[\x00-ɏ]*").fullmatch
        self.long_run = re.compile(r"\S{1000}|\s{1000}").search

    def __call__(self, text: str) -> list[int]:
        if SPECIAL in text or not self.plain(text) or self.long_run(text):
            return super().__call__(text)
        return self.fast.encode_ordinary(text)


def vocabulary() -> dict[str, str]:
    """The installed byte-level vocabulary, by its package's own paths."""
    import public_tokenizers

    return {
        "tokenizer_file": public_tokenizers.path("byte_bpe_50k.json"),
        "rank_file": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


_encoders: dict[tuple, Encoder] = {}


def _encoder(files: tuple) -> Encoder:
    """One encoder per Python worker."""
    if files not in _encoders:
        known = dict(files)
        _encoders[files] = FastEncoder(**known) if "rank_file" in known else Encoder(**known)
    return _encoders[files]


def pieces(documents: DataFrame, files: dict[str, str] | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids_crc32, ids are not kept.

    A document is its ids, then ``end_id``; a null or empty text is ``end_id`` alone. One longer than
    ``capacity`` is cut so that only its first piece is shorter. Texts are taken one at a time.
    """
    key = tuple(sorted((files or vocabulary()).items()))

    def rows(columns):
        encode = _encoder(key)
        for doc_id, text in zip(columns["doc_id"], columns["text"], strict=True):
            ids = np.array((encode(text) if text else []) + [end_id], dtype="<u4")
            first = len(ids) % capacity or min(capacity, len(ids))
            ends = range(first, len(ids) + 1, capacity)
            start = 0
            for n, end in enumerate(ends):
                yield doc_id, n, start, end - start, zlib.crc32(ids[start:end].tobytes())
                start = end

    docs = columns_of(documents, doc_id="long", text="string")
    return map_rows(docs, rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Which lengths share a sequence, and how often: [(lengths, times)], from a count per length.

    Exact complements are consumed as often as the counts allow, what is left goes by best fit. Short
    pieces fill gaps that nothing else fits, and complements that use them up early cost sequences; so
    plans are made that leave pieces below a growing length out of the complements, at last all, and
    the one with the fewest sequences is taken (of equals, that with the most complements). There are
    at most ``capacity`` lengths, so neither the input nor the work depends on the number of pieces.
    """
    best, fewest = None, None
    for shortest in (1, *(max(1, capacity // part) for part in (64, 32, 16, 8, 4, 3, 2)), capacity + 1):
        full, rest = _complements(counts, capacity, shortest)
        plan = full + _best_fit(rest, capacity)
        size = sum(times for _, times in plan)
        if fewest is None or size < fewest:
            best, fewest = plan, size
    return best


def _complements(counts: dict[int, int], capacity: int, shortest: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences filled exactly by pieces of at least ``shortest``, and the counts of what is left.

    For all lengths, from the largest, the gap that one leaves is looked up among the single lengths;
    then, for all that are left, among the sums of two; then of three.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    short = have[:shortest].copy()
    have[:shortest] = 0
    full: list[tuple[tuple[int, ...], int]] = []
    for parts in (1, 2, 3):
        for top in range(capacity, 0, -1):
            while have[top] and (found := _complement(have, top, capacity - top, parts)) is not None:
                group = (top, *found)
                times = min(int(have[x]) // group.count(x) for x in set(group))
                for x in group:
                    have[x] -= times
                full.append((group, times))
    have[: len(short)] += short
    return full, {int(x): int(have[x]) for x in np.flatnonzero(have)}


def _complement(have: np.ndarray, top: int, gap: int, parts: int) -> tuple[int, ...] | None:
    """``parts`` available lengths that add up to the gap, the largest first; () for no gap."""
    if gap == 0:
        return ()
    left = have.copy()
    left[top] -= 1
    if parts == 1:
        return (gap,) if left[gap] > 0 else None
    if parts == 2:
        return _pair(left, gap)
    for a in range(gap - 2, 0, -1):
        if left[a] > 0:
            left[a] -= 1
            if (pair := _pair(left, gap - a)) and pair[0] <= a:
                return (a, *pair)
            left[a] += 1
    return None


def _pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two available lengths that add up to the gap, the more even ones first."""
    if gap < 2:
        return None
    a = np.arange((gap + 1) // 2, gap)
    b = gap - a
    ok = np.flatnonzero((left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1)))
    return (int(a[ok[0]]), int(b[ok[0]])) if len(ok) else None


def _best_fit(rest: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: sequences that hold the same lengths are handled as one."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(rest, reverse=True):
        todo = rest[length]
        while todo:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                group, n = (), todo
                gap = capacity
            else:
                group, n = open_[gap].popitem()
                if not open_[gap]:
                    del open_[gap]
            times = min(n, todo)
            if group and n > times:
                open_.setdefault(gap, {})[group] = n - times
            if not group:
                # As many to a sequence as fit, so that equal lengths need no second look.
                fit = min(capacity // length, todo)
                times = todo // fit
                group, used = (length,) * fit, fit
            else:
                group, used = (*group, length), 1
            todo -= times * used
            left = capacity - sum(group)
            at = open_.setdefault(left, {})
            at[group] = at.get(group, 0) + times
    return [(group, n) for at in open_.values() for group, n in at.items()]


def _runs(plan: Iterable[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): ranks of a length are handed out run after run."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for group, times in plan:
        offset = 0
        for length in group:
            first = rank.get(length, 0)
            out.append((length, first, sequence, offset))
            rank[length] = first + times
            offset += length
        sequence += times
    return sorted(out)


def pack(cut: DataFrame, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, start, length, ...).

    The plan is made from the number of pieces of each length (at most ``capacity`` numbers, on the
    driver); pieces are numbered within their length, in key ranges, and look their place up in the
    plan. Repeated rows are pieces like others. An empty table gives no rows. Rerunning gives the same
    plan; pieces of the same length may be taken for one another.
    """
    cut = written(cut, "pieces")
    counts = {int(n): int(c) for n, c in cut.groupBy("length").count().collect()}
    runs = _runs(packing_plan(counts, capacity))
    spark = cut.sparkSession
    sizes = spark.createDataFrame(list(counts.items()), "length long, _n long")
    rows = cut.join(F.broadcast(sizes), "length").withColumn(
        "_key", uniform_key("doc_id", "piece", "start", "ids_crc32", seed=seed)
    )
    ranked = with_positions(rows, "length", "_key", ["doc_id", "piece", "start", "ids_crc32"], "_n")
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    shift = int(max(counts.values(), default=0)).bit_length() + 1
    starts = (table[:, 0] << shift) + table[:, 1]
    sequences, offsets, firsts = table[:, 2], table[:, 3], table[:, 1]

    def place(batches):
        import pyarrow as pa

        for b in batches:
            names = b.schema.names
            length = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(names.index("position")).to_numpy(zero_copy_only=False)
            run = np.searchsorted(starts, (length << shift) + rank, side="right") - 1
            keep = [i for i, n in enumerate(names) if n not in ("position", "_n", "_key")]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in keep], pa.array(sequences[run] + rank - firsts[run]), pa.array(offsets[run])],
                [*[names[i] for i in keep], "sequence_id", "offset"],
            )

    schema = [f"{n} {t}" for n, t in ranked.dtypes if n not in ("position", "_n", "_key")]
    return ranked.mapInArrow(place, ", ".join([*schema, "sequence_id long", "offset long"]))
