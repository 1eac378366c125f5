"""Periodic runs of words: Lyndon arrays under both orders by Baier grouping, roots extended to runs."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns_of

#: A run counts if it has so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the windows that tell which parts of a text can hold a run.
PROBE = 8
#: Characters of text after which a task sends its rows on.
BLOCK_BYTES = 4 << 20


class _Ids(dict):
    """Word to a number that no other word has."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the first phase of Baier's sorter.

    Suffixes are grouped by their first letter. Groups are finished from the highest down. For every
    suffix of the group at hand the nearest earlier suffix of a lower group is looked up; the word of
    that one goes on with as many copies of the group's word as name it, so it moves, with those of
    its group that have as many, to a new group just above the rest of its own. When no group is
    left, a suffix's group is that of its longest Lyndon prefix, and no suffix had to be sorted.
    ``ranks`` are the letters as 0, 1, ... with none left out.
    """
    n = len(ranks)
    if not n:
        return []
    letters = np.asarray(ranks)
    order: list[int] = np.argsort(letters, kind="stable").tolist()
    counts = np.bincount(letters)
    first = np.cumsum(counts) - counts
    # A group is a stretch of ``order`` and is known by where it starts.
    group: list[int] = first[letters].tolist()
    place = [0] * n
    for at, suffix in enumerate(order):
        place[suffix] = at
    size, length = [0] * n, [1] * n
    for start, count in zip(first.tolist(), counts.tolist(), strict=True):
        size[start] = count
    before, found = [-1] * n, [1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        word = length[start]
        named: dict[int, int] = {}
        for suffix in sorted(order[start:end]):
            found[suffix] = word
            at = suffix - 1
            while at >= 0 and group[at] >= start:
                at = before[at]
            before[suffix] = at
            if at >= 0:
                named[at] = named.get(at, 0) + 1
        end = start
        alike: dict[tuple[int, int], list[int]] = {}
        for suffix, times in named.items():
            alike.setdefault((-times, group[suffix]), []).append(suffix)
        for times, old in sorted(alike):
            moved = alike[times, old]
            left = size[old] - len(moved)
            new, at = old + left, old + size[old]
            for suffix in moved:
                at -= 1
                other, here = order[at], place[suffix]
                order[here], place[other] = other, here
                order[at], place[suffix] = suffix, at
                group[suffix] = new
            longer = length[old] - times * word
            size[old] = left
            size[new], length[new] = len(moved), longer
    return found


class Extension:
    """Longest common extension of two places, to the right and to the left, by names of equal blocks.

    Blocks of 1, 2, 4 ... letters get the same number exactly when they are equal.
    """

    def __init__(self, letters: np.ndarray):
        self.names = [letters]
        reach = 1
        while 2 * reach <= len(letters):
            last = self.names[-1]
            both = last[: len(last) - reach].astype(np.int64) * len(letters) + last[reach:]
            self.names.append(np.unique(both, return_inverse=True)[1])
            reach *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal letters from i and j on; i < j."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            a, b = i + got, j + got
            fits = b < len(names)
            same = fits.copy()
            same[fits] = names[a[fits]] == names[b[fits]]
            got[same] += 1 << k
        return got

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal letters before i and j; i < j."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            a, b = i - got - (1 << k), j - got - (1 << k)
            fits = a >= 0
            same = fits.copy()
            same[fits] = names[a[fits]] == names[b[fits]]
            got[same] += 1 << k
        return got


def runs_of(letters: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period.

    Under one of the two orders of the letters, a run holds a Lyndon word of its period's length that
    is the longest one to start at its place. So every longest Lyndon word, under either order, is
    taken for a period and extended to both sides.
    """
    n = len(letters)
    if n < least:
        return []
    ranks = np.unique(letters, return_inverse=True)[1]
    extension, found = Extension(ranks), set()
    for ordered in (ranks, ranks.max() - ranks):
        period = np.array(lyndon_lengths(ordered), dtype=np.int64)
        at = np.flatnonzero((periods * period <= n) & (np.arange(n) + period < n))
        period = period[at]
        right, left = extension.right(at, at + period), extension.left(at, at + period)
        length = left + period + right
        run = length >= np.maximum(least, periods * period)
        found.update(zip((at - left)[run].tolist(), length[run].tolist(), period[run].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(letters: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """Parts [from, to) outside which no run can lie, each run being whole within one.

    With three periods and 24 words, a run of period q is at least 2 q + 8 words long, so each window
    of 8 words in it stands in it again, q words before or after. A run therefore lies where windows
    that stand more than once in the text follow one another, and so does what would extend it.
    """
    n = len(letters)
    if n < least:
        return []
    if periods < 3 or least < 3 * PROBE:
        return [(0, n)]
    windows = np.zeros(n - PROBE + 1, dtype=np.uint64)
    for k in range(PROBE):  # equal windows have equal sums
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + letters[k : n - PROBE + 1 + k].astype(np.uint64)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(len(windows) + 2, dtype=np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edges = np.diff(again)
    spans = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    return [(a, b + PROBE - 1) for a, b in spans if b + PROBE - 1 - a >= least]


def document_runs(words: list[bytes], ids: dict | None = None, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS):
    """(start, length, period) of the runs among the words of one text."""
    ids = _Ids() if ids is None else ids
    letters = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
    found = []
    for low, high in _stretches(letters, least, periods):
        found += [(low + start, length, period) for start, length, period in runs_of(letters[low:high], least, periods)]
    # Stretches may overlap by the last words of their windows.
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]


def _row(words: list[bytes], ids: dict) -> tuple:
    runs = document_runs(words, ids)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    best = None
    for run in runs:  # by start, then period, so the first of equals stays; lengths / periods as fractions
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    best = best and (*best, 1000 * best[1] // best[2])
    return len(words), len(runs), *(best or (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), collapsed(words, runs)


def periodic_runs(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_runs, start, length, period, exponent_milli of the run
    with the greatest length / period (ties: smallest start, then period), runs_sha256 (of every run's
    ``start,length,period`` and a line feed) and text, without the words that a run repeats.

    A run is a stretch of words with smallest period q, of at least 24 words and 3 q, that no
    neighbouring word extends keeping the period. Null and empty texts have no words and no runs;
    start, length, period and exponent_milli are null without runs. Each row stands for itself, so
    repeated rows and null ids are kept as they are and ties between rows mean nothing. Texts are
    read whole, one at a time, in memory that grows with the words of one text (times the binary
    logarithm of the longest stretch that may hold runs). Nothing is shuffled. Other columns of the
    table are not read, so none can clash. An empty table gives no rows.
    """
    rows = columns_of(documents, doc_id="long", text="string")

    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "text"]

    def run(batches):
        import pyarrow as pa

        def block(part: list[tuple]) -> pa.RecordBatch:
            kinds = [*[pa.int64()] * 7, pa.string(), pa.binary()]
            columns = zip(*part, strict=True) if part else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        ids, part, held = _Ids(), [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                if len(ids) > 500_000:
                    ids.clear()
                *row, kept = _row((text.as_py() or b"").split(), ids)
                part.append((doc_id.as_py(), *row, b" ".join(kept)))
                held += len(part[-1][-1])
                if held > BLOCK_BYTES or len(part) >= 2000:
                    yield block(part)
                    part, held = [], 0
        yield block(part)

    kinds = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    found = rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, kinds + "runs_sha256 string, text binary")
    return found.withColumn("text", F.col("text").cast("string"))


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document, by the checksum h of its id, becomes periodic.

    With g = h div 10 and n words, each word i from a = g mod n on becomes word a + (i - a) mod p of
    the text as it was, p = 1 + (n - a) div (3 + g mod 8). Rows without id or words stay as they are.
    """
    rows = columns_of(documents, doc_id="long", text="string")
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = checksum % 10 == 0
    rows = rows.withColumn("_g", F.floor(checksum / 10).cast("long"))
    rows = rows.withColumn("_words", F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("_n", F.size("_words").cast("long")).withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)"))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    word = F.expr("transform(_words, (w, i) -> if(i < _a, w, _words[int(_a + (i - _a) % _p)]))")
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.concat_ws(" ", word)).otherwise(F.col("text")).alias("text"))
