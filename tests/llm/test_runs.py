"""Runs: Lyndon arrays, runs and the query against brute force, awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from vacancyledger.llm import runs
from vacancyledger.llm.queries import QUERIES


def plain_lyndon(word):
    """The longest Lyndon word from each place: smaller than all its proper suffixes."""
    n = len(word)
    return [max(j - i for j in range(i + 1, n + 1) if all(word[i:j] < word[k:j] for k in range(i + 1, j))) for i in range(n)]


def plain_runs(word, least, periods):
    """Period by period, the maximal stretches whose words are equal that far apart."""
    found = []
    for q in range(1, len(word) // periods + 1):
        same = [a == b for a, b in zip(word, word[q:], strict=False)]
        start = None
        for i, equal in enumerate([*same, False]):
            if equal and start is None:
                start = i
            elif not equal and start is not None:
                part = word[start : i + q]
                long = len(part) >= max(least, periods * q)
                if long and not any(part[d:] == part[: len(part) - d] for d in range(1, q)):
                    found.append((start, len(part), q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(600):
        word = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 22))]
        letters = sorted(set(word))
        word = [letters.index(x) for x in word]
        assert runs.lyndon_lengths(word) == plain_lyndon(word)


@pytest.mark.parametrize("least, periods", [(24, 3), (4, 2), (1, 3), (30, 4)])
def test_runs(least, periods):
    rng = random.Random(least)
    for _ in range(300):
        word = []
        for _ in range(rng.randint(1, 5)):
            root = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(1, 12))]
            word += (root * 60)[: rng.randint(1, 60)]
        expected = plain_runs(word, least, periods)
        assert runs.runs_of(np.array(word), least, periods) == expected
        assert runs.document_runs([b"%d" % x for x in word], None, least, periods) == expected


def test_known_words():
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 3000:
        fibonacci, last = fibonacci + last, fibonacci
    thue = [i.bit_count() % 2 for i in range(4096)]
    for word in (fibonacci, thue, [0] * 3000, list(range(3000))):
        assert runs.runs_of(np.array(word)) == plain_runs(word, 24, 3)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24, 3)
    best = min(found, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_query_equals_brute_force(spark):
    """All documents of the folder up to 1500 words; the longer ones by the next test."""
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_baier_runs"][0](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    short = [r for r in rows if len((r.text or "").split()) <= 1500]
    assert all(got[r.doc_id] == plain_row(r.doc_id, r.text) for r in short)
    assert sum(got[r.doc_id][1] > 0 for r in short) > 50


def test_long_text(spark, documents):
    rng = random.Random(5)
    word = [rng.randrange(9) for _ in range(700)] * 6 + [rng.randrange(900) for _ in range(9000)] + [1, 2] * 400
    text = " ".join(f"w{x}" for x in word)
    row = runs.periodic_runs(documents([(3, text)])).first()
    found = runs.runs_of(np.array(word))
    assert {(0, 4200, 700), (13200 - (word[13199] == 2), 800 + (word[13199] == 2), 2)} <= set(found)
    assert row.n_runs == len(found) and row.n_words == len(word)
    assert len(row.text.split()) == len(runs.collapsed([b"x"] * len(word), found))


def test_awkward_rows(spark, awkward, nothing):
    got = runs.periodic_runs(awkward)
    assert got.columns == ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "text"]
    rows = got.collect()
    assert len(rows) == awkward.count()
    long = next(r for r in rows if r.doc_id == 6)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli, long.text) == (1, 0, 30_000, 1, 30_000_000, "word")
    assert all(r.start is None and r.n_runs == 0 for r in rows if r.doc_id != 6)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.n_words == 0 and r.text == "" and r.runs_sha256 == empty for r in rows if r.doc_id in (1, 2, 3))
    planted = runs.with_planted_periods(awkward)
    assert planted.columns == ["doc_id", "text"] and planted.count() == awkward.count()
    assert runs.periodic_runs(nothing).count() == 0 and runs.with_planted_periods(nothing).count() == 0
