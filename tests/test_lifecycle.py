"""Identity, reconcile and history: scenarios, and equality with a step-by-step loop."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vacancyledger.operators import lifecycle, quality, windows
from vacancyledger.sources import tables

T0 = datetime.datetime(2026, 1, 1)


def posting(scan, seq, external, fingerprint, url=None, source="s"):
    return {
        "source_id": source, "scan_run_id": f"{source}{scan}", "scan_seq": scan, "seq": seq,
        "external_id": external, "canonical_url": url or f"https://e/{external}",
        "identity_key": f"external:{external}" if external else f"url:{url}",
        "title": "t", "content_fingerprint": fingerprint,
    }


def observations(spark, rows):
    schema = tables.SCHEMAS["observations"]
    return spark.createDataFrame([{**r, "observed_at": T0} for r in rows], schema)


def scan(number, complete=True, source="s", prior=True):
    return {
        "source_id": source, "scan_run_id": f"{source}{number}", "scan_seq": number,
        "complete": complete, "observed_at": T0 + datetime.timedelta(days=number), "prior_success": prior,
    }


SCAN = "source_id string, scan_run_id string, scan_seq bigint, complete boolean, observed_at timestamp, prior_success boolean"


def apply(spark, jobs, rows, step):
    scans = spark.createDataFrame([step], SCAN)
    out, metrics = lifecycle.reconcile(jobs, observations(spark, rows), scans)
    kept = out.collect()
    return spark.createDataFrame(kept, out.schema), kept, metrics.first()


def test_open_update_close_reopen(spark):
    jobs = tables.empty(spark, "jobs")
    jobs, rows, m = apply(spark, jobs, [posting(1, 0, "1", "a")], scan(1, prior=False))
    assert (m.jobs_created, m.jobs_updated, m.jobs_found) == (1, 0, 1)
    assert rows[0].initial_import and rows[0].lifecycle_status == "active"
    first_id, born = rows[0].job_id, rows[0].first_discovered_at
    jobs, rows, m = apply(spark, jobs, [posting(2, 0, "1", "b")], scan(2))
    assert (m.jobs_created, m.jobs_updated) == (0, 1)
    jobs, rows, m = apply(spark, jobs, [], scan(3))
    assert rows[0].lifecycle_status == "possibly_closed" and m.jobs_missing == 1
    jobs, rows, m = apply(spark, jobs, [], scan(4))
    assert rows[0].lifecycle_status == "closed" and m.jobs_missing == 1
    jobs, rows, m = apply(spark, jobs, [], scan(5))
    assert rows[0].consecutive_successful_absences == 2 and m.jobs_missing == 0
    jobs, rows, m = apply(spark, jobs, [posting(6, 0, "1", "b")], scan(6))
    assert rows[0].lifecycle_status == "active" and rows[0].consecutive_successful_absences == 0
    assert m.jobs_reopened == 1 and rows[0].job_id == first_id and rows[0].first_discovered_at == born


def test_partial_scan_adds_but_never_closes(spark):
    jobs = tables.empty(spark, "jobs")
    jobs, _, _ = apply(spark, jobs, [posting(1, 0, "1", "a")], scan(1))
    _, rows, m = apply(spark, jobs, [posting(2, 0, "2", "a")], scan(2, complete=False))
    assert {r.external_id: r.lifecycle_status for r in rows} == {"1": "active", "2": "active"}
    assert (m.jobs_created, m.jobs_missing) == (1, 0)


def test_last_copy_wins_and_counts(spark):
    rows = [posting(1, 0, "1", "a"), posting(1, 1, "2", "x"), posting(1, 2, "1", "b"), posting(1, 3, "3", "c", url="https://e/2")]
    _, out, m = apply(spark, tables.empty(spark, "jobs"), rows, scan(1))
    assert (m.jobs_found, m.jobs_persisted, m.duplicate_urls) == (4, 2, 1)
    assert {r.external_id: r.content_fingerprint for r in out} == {"1": "b", "3": "c"}


def test_job_keeps_history_when_it_gets_an_id(spark):
    jobs = tables.empty(spark, "jobs")
    jobs, before, _ = apply(spark, jobs, [posting(1, 0, None, "a", url="https://e/x")], scan(1))
    jobs, after, m = apply(spark, jobs, [posting(2, 0, "9", "a", url="https://e/x")], scan(2))
    assert m.jobs_created == 0 and after[0].job_id == before[0].job_id
    assert after[0].identity_key == "external:9"


def test_identity_claim_beats_url(spark):
    jobs = tables.empty(spark, "jobs")
    jobs, before, _ = apply(spark, jobs, [posting(1, 0, "1", "a", url="https://e/x")], scan(1))
    rows = [posting(2, 0, "2", "b", url="https://e/x"), posting(2, 1, "1", "a", url="https://e/y")]
    _, after, m = apply(spark, jobs, rows, scan(2))
    by_id = {r.external_id: r for r in after}
    assert by_id["1"].job_id == before[0].job_id and by_id["2"].job_id != before[0].job_id
    assert m.jobs_created == 1


def test_unclaimed_job_at_a_shared_url_is_found(spark):
    jobs = tables.empty(spark, "jobs")
    rows = [posting(1, 0, "1", "a", url="https://e/x"), posting(1, 1, "2", "a", url="https://e/y")]
    jobs, before, _ = apply(spark, jobs, rows, scan(1))
    shared = jobs.withColumn("canonical_url", F.lit("https://e/x"))
    known = {r.external_id: r.job_id for r in before}
    later = observations(spark, [posting(2, 0, "1", "a", url="https://e/z"), posting(2, 1, "9", "a", url="https://e/x")])
    got = {r.external_id: (r.job_id, r.match_kind) for r in lifecycle.resolve_identity(later, shared).collect()}
    assert got == {"1": (known["1"], "identity"), "9": (known["2"], "url")}


def test_reconcile_twice_is_the_same(spark):
    jobs, _, _ = apply(spark, tables.empty(spark, "jobs"), [posting(1, 0, "1", "a")], scan(1))
    once, a, _ = apply(spark, jobs, [posting(2, 0, "1", "a"), posting(2, 1, "2", "a")], scan(2))
    _, b, m = apply(spark, once, [posting(2, 0, "1", "a"), posting(2, 1, "2", "a")], scan(2))
    assert sorted(a, key=str) == sorted(b, key=str) and m.jobs_created == 0


def test_zero_guard_holds_absences(spark):
    jobs, _, _ = apply(spark, tables.empty(spark, "jobs"), [posting(1, 0, "1", "a")], scan(1))
    scans = spark.createDataFrame([scan(2)], SCAN)
    held = scans.select("scan_run_id")
    out, _ = lifecycle.reconcile(jobs, observations(spark, []), scans, zero_guard=held)
    assert out.first().lifecycle_status == "active"


def random_history(seed, sources=3, scans=18, jobs=7):
    rng = random.Random(seed)
    scan_rows, obs = [], []
    for s in range(sources):
        for n in range(scans):
            kind = rng.choice(["complete", "complete", "partial", "failed"])
            scan_rows.append((f"s{s}", f"s{s}:{n}", n, kind == "complete", kind))
            if kind == "failed":
                continue
            for j in range(jobs):
                for copy in range(rng.choice([0, 0, 1, 2])):
                    obs.append((f"s{s}", f"s{s}:{n}", n, j * 10 + copy, f"external:{j}", rng.choice("ab")))
    return scan_rows, obs


def loop(scan_rows, obs):
    """Plain re-enactment of scan after scan."""
    state, events, metrics = {}, [], {}
    for source, run, number, complete, kind in scan_rows:
        listed = sorted((o for o in obs if o[1] == run), key=lambda o: o[3])
        unique = {o[4]: o[5] for o in listed}
        created = updated = missing = 0
        for key, fp in unique.items():
            old = state.get((source, key))
            if old is None:
                created += 1
                events.append((source, key, number, "discovered"))
            else:
                updated += old["fp"] != fp
                if old["absences"]:
                    events.append((source, key, number, "reopened"))
            state[source, key] = {"fp": fp, "absences": 0, "last": number}
        if complete:
            for (src, key), job in state.items():
                if src == source and key not in unique and job["absences"] < 2:
                    job["absences"] += 1
                    missing += 1
                    events.append((source, key, number, ["", "possibly_closed", "closed"][job["absences"]]))
        metrics[run] = (len(listed), len(unique), created, updated, missing)
    return state, events, metrics


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_equals_loop(spark, seed):
    scan_rows, obs = random_history(seed)
    scans = spark.createDataFrame(scan_rows, "source_id string, scan_run_id string, scan_seq bigint, complete boolean, kind string")
    shuffled = random.Random(seed).sample(obs, len(obs))
    listing = spark.createDataFrame(
        shuffled, "source_id string, scan_run_id string, scan_seq bigint, seq bigint, identity_key string, content_fingerprint string"
    )
    state, events, metrics = loop(scan_rows, obs)
    got = lifecycle.lifecycle_history(listing, scans).collect()
    assert {(r.source_id, r.identity_key): (r.content_fingerprint, r.absences) for r in got} == {
        k: (v["fp"], v["absences"]) for k, v in state.items()
    }
    chunk = F.floor(F.col("scan_seq") / 4)
    changes = lifecycle.lifecycle_events(listing, scans, chunk).collect()
    assert sorted((r.source_id, r.identity_key, r.at_seq, r.change) for r in changes) == sorted(events)
    counted = lifecycle.scan_metrics(listing, scans, chunk).collect()
    assert {
        r.scan_run_id: (r.jobs_found, r.jobs_persisted, r.jobs_created, r.jobs_updated, r.jobs_missing)
        for r in counted
    } == metrics


def test_history_as_of(spark):
    scan_rows, obs = random_history(9)
    scans = spark.createDataFrame(scan_rows, "source_id string, scan_run_id string, scan_seq bigint, complete boolean, kind string")
    listing = spark.createDataFrame(
        obs, "source_id string, scan_run_id string, scan_seq bigint, seq bigint, identity_key string, content_fingerprint string"
    )
    cut = 8
    state, _, _ = loop([s for s in scan_rows if s[2] <= cut], obs)
    got = lifecycle.lifecycle_history(listing, scans, as_of=cut).collect()
    assert {(r.source_id, r.identity_key): r.absences for r in got} == {k: v["absences"] for k, v in state.items()}


def test_missing_jobs(spark):
    jobs, _, _ = apply(
        spark, tables.empty(spark, "jobs"), [posting(1, 0, "1", "a"), posting(1, 1, "2", "a")], scan(1)
    )
    seen = jobs.where("external_id = '1'").select("source_id", "job_id").withColumn("scan_run_id", F.lit("s2"))
    for complete, want in ((True, ["2"]), (False, [])):
        scans = spark.createDataFrame([scan(2, complete)], SCAN)
        assert [r.external_id for r in lifecycle.missing_jobs(jobs, seen, scans).collect()] == want


def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(5)
    rows = [(rng.choice("kkkl"), i, rng.choice([None, 1, 2, 3])) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    want_prev, want_next, want_sum = {}, {}, {}
    for key in "kl":
        ordered = sorted(r for r in rows if r[0] == key)
        total = 0
        for i, (_, o, v) in enumerate(ordered):
            total += v or 0
            want_prev[o] = ordered[i - 1][2] if i else None
            want_next[o] = ordered[i + 1][2] if i + 1 < len(ordered) else None
            want_sum[o] = total
    for width in (7, 1000):
        chunk = F.floor(F.col("o") / width)
        prev = windows.with_previous(df, ["k"], ["o"], chunk, ["v"]).collect()
        assert {r.o: r.prev_v for r in prev} == want_prev
        assert sum(r.is_first for r in prev) == 2
        assert {r.o: r.next_v for r in windows.with_next(df, ["k"], ["o"], chunk, ["v"]).collect()} == want_next
        sums = windows.with_running_sums(df, ["k"], ["o"], chunk, {"s": F.coalesce("v", F.lit(0))}).collect()
        assert {r.o: r.s for r in sums} == want_sum


def test_pages_are_bounded(spark):
    df = spark.range(250)
    rows = windows.page(df, [F.col("id")], 3, 100).collect()
    assert [r.id for r in rows] == list(range(200, 250))
    for bad in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            windows.page(df, [F.col("id")], *bad)


def test_quality_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert [(r.k, r.copies) for r in quality.duplicates(df, ["k"]).collect()] == [("a", 2)]
    assert quality.bad_enum(df, "k", ("a",)).count() == 2
    broken = quality.out_of_range(df, {"v": F.col("v") <= 2, "k": F.length("k") < 1}).collect()
    assert [r.broken_rules for r in broken] == [["k"], ["k"], ["v"], ["v"]]


def test_empty_first_scan_has_metrics(spark):
    _, rows, m = apply(spark, tables.empty(spark, "jobs"), [], scan(1, prior=False))
    assert rows == [] and m.scan_run_id == "s1"
    assert (m.jobs_found, m.jobs_persisted, m.jobs_created, m.jobs_missing, m.duplicate_urls) == (0, 0, 0, 0, 0)


def test_two_scans_of_a_source_are_refused(spark):
    steps = spark.createDataFrame([scan(1), scan(2)], SCAN)
    out, _ = lifecycle.reconcile(tables.empty(spark, "jobs"), observations(spark, [posting(1, 0, "1", "a")]), steps)
    with pytest.raises(Exception, match="more than one scan of source s"):
        out.collect()
