"""Term and token relations against brute force; page index and seeks against offsets; numbering."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vacancyledger.functions.text import tokens
from vacancyledger.operators import feed, terms, windows


def test_contained_terms_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("aAbB \U0001f600é") for _ in range(rng.randint(0, 60)))) for i in range(120)] + [(999, None)]
    asked = [(i, "".join(rng.choice("abé \U0001f600") for _ in range(rng.randint(0, 5)))) for i in range(80)] + [(500, None), (501, "zzz")]
    got = terms.contained_terms(
        spark.createDataFrame(asked, "term_id long, term string"), spark.createDataFrame(texts, "text_id long, text string")
    )
    expected = {
        (i, j) for i, term in asked for j, text in texts
        if term and term.strip() and text is not None and term.strip().casefold() in text.casefold()
    }
    rows = [(r.term_id, r.text_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_contained_terms_cut_texts_once(spark):
    """Pieces of texts are written and read back: none is cut again. Repeated and null ids have a fixed result."""
    texts = [(1, "senior data engineer"), (None, "big data engine"), (2, None), (3, "Straße \u1e9e"), (4, "at")]
    asked = [(7, "data"), (7, "ta"), (8, "Data Eng"), (9, "at"), (9, "at"), (None, "r d"), (10, "x" * 40), (11, "STRASSE"), (12, "\u00df"), (13, " ")]

    def found(rows):
        return terms.contained_terms(
            spark.createDataFrame(asked, "term_id long, term string"), spark.createDataFrame(rows, "text_id long, text string")
        )

    key = lambda r: tuple((x is None, x) for x in r)
    once = [
        (i, j) for i, term in dict.fromkeys(asked) for j, text in texts
        if j is not None and term.strip() and text and term.strip().casefold() in text.casefold()
    ]
    got = found(texts)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(once, key=key)
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()
    # Two copies of a text under one id: each meets each.
    twice = once + 3 * [r for r in once if r[1] == 1]
    assert sorted(map(tuple, found(texts + texts[:1]).collect()), key=key) == sorted(twice, key=key)


@pytest.mark.parametrize("least", [0.3, 0.7, 0.9, 1.0])
def test_overlaps_equal_brute_force(spark, least):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["hot"] * 40
    make = lambda n, size: [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, size)))) for i in range(n)]
    left, right = spark.createDataFrame(make(40, 8), "left_id long, text string"), spark.createDataFrame(make(90, 60), "right_id long, text string")
    got = {tuple(r) for r in terms.overlapping_tokens(left, right, least).collect()}
    a = {r.left_id: set(r.t) for r in left.select("left_id", tokens(F.col("text")).alias("t")).collect()}
    b = {r.right_id: set(r.t) for r in right.select("right_id", tokens(F.col("text")).alias("t")).collect()}
    expected = {(i, j, len(s), len(s & o)) for i, s in a.items() for j, o in b.items() if s and len(s & o) >= least * len(s) - 1e-9}
    assert got == expected and expected


def test_no_cross_join(spark):
    left, right = spark.createDataFrame([(1, "a b")], "left_id long, text string"), spark.createDataFrame([(1, "a b")], "right_id long, text string")
    plan = terms.overlapping_tokens(left, right, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pages_by_index_equal_offsets(spark):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"j{i}", start + datetime.timedelta(days=rng.randint(0, 9), seconds=rng.randint(0, 3))) for i in range(230)]
    jobs = spark.createDataFrame(rows, "job_id string, first_discovered_at timestamp")
    index = feed.jobs_page_index(jobs, 20)
    order = [F.col("first_discovered_at").desc(), F.col("job_id")]
    assert index.count() == 12
    for number in (1, 2, 7, 12):
        expected = windows.page(jobs, order, number, 20).collect()
        assert feed.jobs_page_from(jobs, index, number, 20).collect() == expected
    second = windows.page(jobs, order, 2, 20).collect()
    first = windows.page(jobs, order, 1, 20).collect()
    assert feed.jobs_page_after(jobs, (first[-1].first_discovered_at, first[-1].job_id), 20).collect() == second
    assert feed.jobs_page_from(jobs, index, 13, 20).count() == 0
    plan = feed.jobs_page_after(jobs, (start, "j1"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Offset" not in plan


def test_numbering_by_chunks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.randint(0, 999)) for i in range(500)] + [(None, 600, 5)]
    df = spark.createDataFrame(rows, "k string, id long, v long")
    got = windows.numbered(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 100), "place").collect()
    for key in ("a", "b", None):
        places = [r.place for r in sorted((r for r in got if r.k == key), key=lambda r: (r.v, r.id))]
        assert places == list(range(1, len(places) + 1))
