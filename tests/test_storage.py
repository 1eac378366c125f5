"""Sinks and streams: every stream ends with the batch result, replays change nothing."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests.test_lifecycle import loop, observations, posting, random_history
from tests.test_matching import JOBS, PROFILE, make_jobs, make_profiles
from vacancyledger.operators import health, lifecycle, matching, profiles
from vacancyledger.plans import derived, scan_queries
from vacancyledger.sources import sinks, tables
from vacancyledger.streaming import snapshots, stateful

T0 = datetime.datetime(2026, 1, 1)


def drain(query):
    query.processAllAvailable()
    query.stop()


def run_batches(spark, path, schema, handler, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    drain(writer.trigger(availableNow=True).start())


def test_captures_roundtrip(spark, tmp_path):
    row = ("s", "r", 1, "listing", "https://e", 200, {"h": "v"}, "<p>")
    df = spark.createDataFrame([row], tables.SCHEMAS["captures"])
    for fmt in ("parquet", "json", "orc"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert tables.read_captures(spark, str(tmp_path / fmt), fmt).collect() == [row]
    folder = tmp_path / "files" / "source_id=s" / "scan_run_id=r"
    folder.mkdir(parents=True)
    (folder / "a.html").write_text("line1\nline2")
    (got,) = tables.read_capture_files(spark, str(tmp_path / "files"), "detail").collect()
    assert (got.source_id, got.scan_run_id, got.body) == ("s", "r", "line1\nline2")


def test_observations_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "obs")
    first = observations(spark, [posting(1, 0, "1", "a")])
    second = observations(spark, [posting(2, 0, "1", "b")])
    for df, batch in ((first, "1"), (second, "2"), (second, "2")):
        sinks.write_observations(df, path, batch)
    assert sorted(r.content_fingerprint for r in spark.read.parquet(path).collect()) == ["a", "b"]
    # The same batch with another date replaces its rows.
    moved = second.withColumn("observed_at", F.col("observed_at") + F.expr("interval 3 days"))
    sinks.write_observations(moved, path, "2")
    assert sorted(r.content_fingerprint for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_matches_are_written_once(spark, tmp_path):
    path = str(tmp_path / "matches")
    scores = matching.local_scores(make_jobs(spark), make_profiles(spark))
    sinks.write_matches(spark, scores.limit(2), path)
    for _ in range(2):
        sinks.write_matches(spark, scores, path)
    assert spark.read.parquet(path).count() == len(JOBS)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        sinks.read_or_none(spark, str(tmp_path / "broken"))
    assert sinks.read_or_none(spark, str(tmp_path / "absent")) is None


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path)
    assert sinks.read_snapshot(spark, root) is None
    sinks.write_snapshot(spark.range(1), root, 1)
    sinks.write_snapshot(spark.range(2), root, 2)
    assert sinks.read_snapshot(spark, root).count() == 2
    assert sinks.read_snapshot(spark, root, version=1).count() == 1


def test_scan_stream_equals_loop(spark, tmp_path):
    scan_rows, obs = random_history(4, sources=2, scans=6, jobs=4)
    listing = [
        {"source_id": s, "scan_run_id": run, "scan_seq": n, "seq": seq, "identity_key": key, "content_fingerprint": fp,
         "external_id": key.split(":")[1], "canonical_url": f"https://e/{key}", "title": "t"}
        for s, run, n, seq, key, fp in obs
    ]
    observed = observations(spark, listing).cache()
    records = [
        {"source_id": s, "scan_run_id": run, "scan_seq": n, "complete": complete,
         "status": "failed" if kind == "failed" else "success" if complete else "partial",
         "finished_at": T0 + datetime.timedelta(days=n)}
        for s, run, n, complete, kind in scan_rows
    ]
    scans = spark.createDataFrame(records, tables.SCHEMAS["scans"])
    for part in range(3):
        scans.where(F.floor(F.col("scan_seq") / 2) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    handler = snapshots.apply_scans(root, lambda _: observed)
    # Files are picked up in the order they were written.
    run_batches(spark, str(tmp_path / "in"), tables.SCHEMAS["scans"], handler, str(tmp_path / "ck"))
    got = sinks.read_snapshot(spark, root).collect()
    state, _, _ = loop(scan_rows, obs)
    assert {(r.source_id, r.identity_key): (r.content_fingerprint, r.consecutive_successful_absences) for r in got} == {
        k: (v["fp"], v["absences"]) for k, v in state.items()
    }
    before = sorted(map(str, got))
    handler(scans, 2)
    handler(scans, 0)
    assert sorted(map(str, sinks.read_snapshot(spark, root).collect())) == before


def history_tables(spark, seed, sources, scans, jobs):
    scan_rows, obs = random_history(seed, sources=sources, scans=scans, jobs=jobs)
    listing = [
        {"source_id": s, "scan_run_id": run, "scan_seq": n, "seq": seq, "identity_key": key, "content_fingerprint": fp,
         "external_id": key.split(":")[1], "canonical_url": f"https://e/{key}", "title": "t"}
        for s, run, n, seq, key, fp in obs
    ]
    records = [
        {"source_id": s, "scan_run_id": run, "scan_seq": n, "complete": complete,
         "status": "failed" if kind == "failed" else "success" if complete else "partial",
         "finished_at": T0 + datetime.timedelta(days=n)}
        for s, run, n, complete, kind in scan_rows
    ]
    state, _, _ = loop(scan_rows, obs)
    want = {k: (v["fp"], v["absences"]) for k, v in state.items()}
    return spark.createDataFrame(records, tables.SCHEMAS["scans"]), observations(spark, listing).cache(), want


def states(spark, root):
    return {(r.source_id, r.identity_key): (r.content_fingerprint, r.consecutive_successful_absences) for r in sinks.read_snapshot(spark, root).collect()}


def test_new_checkpoint_loses_and_repeats_nothing(spark, tmp_path):
    """The stream starts anew twice: batch numbers begin at 0 again, old and new files arrive."""
    scans, observed, want = history_tables(spark, 4, 2, 6, 4)
    root = str(tmp_path / "out")
    handler = snapshots.apply_scans(root, lambda _: observed)
    for part in range(3):
        scans.where(F.floor(F.col("scan_seq") / 2) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_batches(spark, str(tmp_path / "in"), tables.SCHEMAS["scans"], handler, str(tmp_path / f"ck{part}"))
    assert states(spark, root) == want


def test_late_scans_are_applied_in_their_place(spark, tmp_path):
    scans, observed, want = history_tables(spark, 8, 3, 6, 5)
    root = str(tmp_path / "out")
    handler = snapshots.apply_scans(root, lambda _: observed)
    late = (F.col("source_id") == scans.first().source_id) & F.col("scan_seq").isin(2, 3)
    handler(scans.where(~late), 0)
    handler(scans.where(late), 1)
    assert states(spark, root) == want


def test_a_batch_rewrites_the_buckets_of_its_sources_only(spark, tmp_path):
    root = str(tmp_path / "out")
    names = [f"s{i}" for i in range(12)]
    scan = lambda s, n: {
        "source_id": s, "scan_run_id": f"{s}-{n}", "scan_seq": n, "complete": True, "status": "success", "finished_at": T0 + datetime.timedelta(days=n),
    }
    listing = [
        {"source_id": s, "scan_run_id": f"{s}-{n}", "scan_seq": n, "seq": 0, "identity_key": "external:1", "content_fingerprint": f"f{n}",
         "external_id": "1", "canonical_url": f"https://e/{s}", "title": "t"}
        for s in names for n in (1, 2, 3)
    ]
    observed = observations(spark, listing).cache()
    handler = snapshots.apply_scans(root, lambda _: observed)
    table = lambda rows: spark.createDataFrame(rows, tables.SCHEMAS["scans"])
    handler(table([scan(s, 1) for s in names]), 0)
    first = sinks._manifest(spark, root, "jobs", 1)
    assert set(first.values()) == {1} and len(first) > 3
    handler(table([scan("s3", 2)]), 1)
    (own,) = spark.createDataFrame([("s3",)], "source_id string").select(sinks.bucket_of()).first()
    for name in ("jobs", "applied_scans"):
        assert sinks._manifest(spark, root, name, 2) == {**first, own: 2}
        assert [p.name for p in (tmp_path / "out" / name / "v=00000002").glob("bucket=*")] == [f"bucket={own}"]
    got = {r.source_id: r.content_fingerprint for r in sinks.read_snapshot(spark, root).collect()}
    assert got == {s: "f2" if s == "s3" else "f1" for s in names}
    # Just the files of the asked buckets are listed.
    some = sinks.read_snapshot(spark, root, buckets=[own])
    assert {f"bucket={own}"} == {path.split("/")[-2] for path in some.inputFiles()}
    # A batch that died after its log is replaced by another one of the same number.
    sinks.write_buckets(table([scan("s5", 2)]), root, 2, [0, 1], "applied_scans")
    handler(table([scan("s4", 2)]), 2)
    assert {r.scan_run_id for r in sinks.read_snapshot(spark, root, "applied_scans").collect()} == {f"{s}-1" for s in names} | {"s3-2", "s4-2"}
    gone = sinks.expire(spark, root, keep=1)
    assert gone and sinks.read_snapshot(spark, root).count() == len(names)


def test_a_whole_snapshot_is_brought_into_buckets(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(f"s{i}", i) for i in range(20)], "source_id string, n long")
    sinks.write_snapshot(rows, root, 1, "t")
    touched = [r[0] for r in rows.where("n < 3").select(sinks.bucket_of()).distinct().collect()]
    sinks.write_buckets(rows.where(sinks.bucket_of().isin(touched)).withColumn("n", F.col("n") + 100), root, 1, touched, "t")
    changed = {r[0] for r in rows.where(sinks.bucket_of().isin(touched)).select("n").collect()}
    assert {r.n for r in sinks.read_snapshot(spark, root, "t").collect()} == {n + 100 if n in changed else n for n in range(20)}


def test_matches_survive_a_new_checkpoint(spark, tmp_path):
    root, jobs = str(tmp_path / "out"), make_jobs(spark)
    for half in ("job_id < '3'", "job_id >= '3'"):
        snapshots.match_arrivals(root, lambda s: make_profiles(s))(jobs.where(half), 0)
    assert spark.read.parquet(f"{root}/matches").count() == len(JOBS)


def test_scans_of_a_failed_batch_are_applied_again(spark, tmp_path):
    root = str(tmp_path / "out")
    record = {"source_id": "s", "scan_run_id": "s1", "scan_seq": 1, "complete": True, "status": "success", "finished_at": T0}
    scans = spark.createDataFrame([record], tables.SCHEMAS["scans"])
    # The log of batch 0 was written, then the batch died before the jobs were.
    sinks.write_snapshot(scans, root, 0, "applied_scans")
    snapshots.apply_scans(root, lambda s: observations(s, [posting(1, 0, "1", "a")]))(scans, 0)
    assert sinks.read_snapshot(spark, root).count() == 1


def test_user_state_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (str(rng.randrange(5)), T0 + datetime.timedelta(minutes=rng.randrange(50)), i, rng.choice([None, True, False]), rng.choice([None, True, False]))
        for i in range(60)
    ]
    schema = "job_id string, ts timestamp, seq bigint, seen boolean, dismissed boolean"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    run_batches(spark, str(tmp_path / "in"), schema, snapshots.fold_user_states(root), str(tmp_path / "ck"))
    want = {r.job_id: (r.seen_at, r.dismissed_at) for r in profiles.user_state_latest(df).collect()}
    got = {r.job_id: (r.seen_at, r.dismissed_at) for r in snapshots.read_user_states(spark, root).collect()}
    assert all(got.get(k, (None, None)) == v for k, v in want.items())


def test_matching_stream(spark, tmp_path):
    jobs = make_jobs(spark)
    for _ in range(2):
        jobs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "out")
    handler = snapshots.match_arrivals(root, lambda s: make_profiles(s))
    run_batches(spark, str(tmp_path / "in"), tables.SCHEMAS["jobs"], handler, str(tmp_path / "ck"))
    assert spark.read.parquet(f"{root}/matches").count() == len(JOBS)
    newer = snapshots.match_arrivals(root, lambda s: make_profiles(s, [{**PROFILE, "version": 2}]))
    newer(jobs, 9)
    assert spark.read.parquet(f"{root}/matches").count() == 2 * len(JOBS)


def test_match_lookup_reads_its_folders(spark, tmp_path):
    path, jobs = str(tmp_path / "matches"), make_jobs(spark)
    old, new = (make_profiles(spark, [{**PROFILE, "version": v}]) for v in (1, 2))
    for current in (old, new):
        sinks.write_matches(spark, matching.local_scores(jobs, current), path)
    got = sinks.read_matches(spark, path).drop("bucket")
    assert got.schema.simpleString() == tables.empty(spark, "matches").schema.simpleString()
    assert got.exceptAll(matching.local_scores(jobs, old).unionByName(matching.local_scores(jobs, new))).isEmpty()
    one = jobs.where("job_id = '1'")
    bucket = one.select(sinks.bucket_of("job_id")).first()[0]
    others = [f for f in (tmp_path / "matches").rglob("*.parquet") if f"profile_version=2/bucket={bucket}/" not in str(f)]
    for file in others:
        file.write_text("not parquet")  # so a lookup that read it would fail
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    stored = sinks.stored_matches(spark, path, matching.match_keys(one, new))
    assert others and matching.match_cache_misses(one, new, stored).isEmpty()
    changed = one.withColumn("content_fingerprint", F.lit("new"))
    assert matching.match_cache_misses(changed, new, stored).count() == 1


MARKED = "source_id string, identity_key string, scan_seq bigint, marker boolean"


def lifecycle_stream(spark, folder, parts, **options):
    """Changes of a stream whose batches are ``parts``, as sorted tuples."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(MARKED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = stateful.stream_lifecycle(stream, **options).writeStream.format("parquet")
    out = out.option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).outputMode("append")
    drain(out.start(f"{folder}/out"))
    got = spark.read.parquet(f"{folder}/out").collect()
    return sorted((r.source_id, r.identity_key, r.scan_seq, r.change) for r in got)


@pytest.mark.parametrize("jobs, chunk", [(5, 10_000), (60, 4)])
def test_stateful_lifecycle_equals_loop(spark, tmp_path, jobs, chunk):
    # With four changes a chunk, a bucket's jobs are closed in several passes.
    scan_rows, obs = random_history(6, sources=2, scans=6, jobs=jobs)
    marks = [(s, None, n, True) for s, _, n, complete, _ in scan_rows if complete]
    rows = [(s, key, n, False) for s, _, n, _, key, _ in obs] + marks
    # The last scan of each source lists nothing, so that whole buckets are missing.
    rows += [(s, None, n, True) for s in ("s0", "s1") for n in (6, 7)]
    scan_rows += [(s, f"{s}:{n}", n, True, "complete") for s in ("s0", "s1") for n in (6, 7)]
    df = spark.createDataFrame(rows, MARKED)
    parts = [df.where(F.floor(F.col("scan_seq") / 3) == part) for part in range(3)]
    _, events, _ = loop(scan_rows, obs)
    assert lifecycle_stream(spark, str(tmp_path), parts, buckets=3, chunk=chunk) == sorted(events)


def test_repeated_markers_and_late_sightings(spark, tmp_path):
    """A marker that comes again adds no absence; a sighting after its scan's marker meets what follows it."""
    batches = [
        [("s", "a", 1, False), ("s", None, 1, True)],
        [("s", None, 2, True)],
        [("s", None, 2, True), ("s", "b", 1, False)],
        [("s", None, 3, True), ("s", "a", 3, False)],
        [("s", None, 4, True), ("s", None, 5, True)],
        [("s", "b", 6, False)],
    ]
    got = lifecycle_stream(spark, str(tmp_path), [spark.createDataFrame(b, MARKED) for b in batches], buckets=1)
    assert got == sorted([
        ("s", "a", 1, "discovered"), ("s", "a", 2, "possibly_closed"), ("s", "a", 3, "reopened"),
        ("s", "a", 4, "possibly_closed"), ("s", "a", 5, "closed"), ("s", "b", 1, "discovered"),
        ("s", "b", 2, "possibly_closed"), ("s", "b", 3, "closed"), ("s", "b", 6, "reopened"),
    ])


def test_lifecycle_stream_equals_batch_on_events(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    listing, scans = derived.scan_listing(spark, sf_dir), derived.scan_history(spark, sf_dir)
    seen = listing.select("source_id", "identity_key", "scan_seq", F.lit(False).alias("marker"))
    done = scans.where("complete").select("source_id", F.lit(None).cast("string"), "scan_seq", F.lit(True))
    df = seen.union(done).persist()
    cut = df.approxQuantile("scan_seq", [0.5], 0.0)[0]
    got = lifecycle_stream(spark, str(tmp_path), [df.where(F.col("scan_seq") <= cut), df.where(F.col("scan_seq") > cut)], buckets=2)
    want = scan_queries.lifecycle_events(spark, sf_dir).collect()
    assert got == sorted((r.source_id, r.identity_key, r.at_seq, r.change) for r in want)
    assert {change for *_, change in got} >= {"discovered", "possibly_closed", "closed"}


def test_late_scans_are_merged_into_their_interval(spark, tmp_path):
    """Scans in random order, some again: the fold equals the batch, and says what came late."""
    root, rng = str(tmp_path), random.Random(5)
    rows = [(f"r{i}", rng.choice("abc"), rng.choice(["success", "failed", "partial"]), T0 + datetime.timedelta(hours=rng.uniform(0, 60))) for i in range(80)]
    schema = "scan_run_id string, source_id string, status string, finished_at timestamp"
    handler = snapshots.fold_scan_intervals(root)
    for number, part in enumerate([rows[:40], rows[20:60], [], rows[60:], rows[:5]]):
        handler(spark.createDataFrame(part, schema), number % 2)
    handler(spark.createDataFrame([(None, "a", "success", T0), ("x", None, "success", T0), ("y", "a", "success", None)], schema), 7)
    got = sinks.read_snapshot(spark, root, "intervals")
    want = health.scan_intervals(spark.createDataFrame(rows, schema))
    assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
    newest, late = {}, 0
    for part in (rows[:40], rows[40:60], rows[60:]):
        for _, source, _, at in part:
            end = T0 + datetime.timedelta(hours=6 * (int((at - T0).total_seconds() // 21_600) + 1))
            late += source in newest and end + datetime.timedelta(hours=6) < newest[source]
        for _, source, _, at in part:
            newest[source] = max(at, newest.get(source, at))
    assert late and got.agg(F.sum("late_scans")).first()[0] == late


def test_interval_and_stale_streams(spark, tmp_path):
    def at(hours):
        return T0 + datetime.timedelta(hours=hours)

    scans = [("s", "success", at(1)), ("s", "partial", at(5)), ("s", "success", at(7)), ("t", "success", at(30))]
    schema = "source_id string, status string, finished_at timestamp"
    spark.createDataFrame(scans, schema).coalesce(1).write.parquet(str(tmp_path / "scans"))
    stream = stateful.stream_scan_intervals(spark.readStream.schema(schema).parquet(str(tmp_path / "scans")))
    query = stream.writeStream.format("memory").queryName("intervals").outputMode("append")
    drain(query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start())
    got = {(r.source_id, r.interval_start): (r.scans, r.successes) for r in spark.table("intervals").collect()}
    assert got == {("s", T0): (2, 1), ("s", at(6)): (1, 1)}

    events = [("a", at(0), "started"), ("b", at(0), "started"), ("c", at(9), "started")]
    schema = "scan_run_id string, ts timestamp, kind string"
    # The finish of b arrives after later events; d is far too late and is counted.
    for part in (events, [("b", at(4), "finished")], [("c", at(9.5), "finished"), ("d", at(1), "started")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    stale = stateful.stream_stale_runs(stream)
    query = stale.writeStream.format("memory").queryName("stale").outputMode("append")
    query = query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    drain(query)
    assert stateful.dropped_as_late(query) == 1
    assert [(r.scan_run_id, r.stale_at) for r in spark.table("stale").collect()] == [("a", at(1))]


def test_stale_recovery(spark):
    now = F.lit(T0).cast("timestamp")
    old, fresh = T0 - datetime.timedelta(seconds=3600), T0 - datetime.timedelta(seconds=3599)
    scans = spark.createDataFrame(
        [{"scan_run_id": n, "source_id": n, "status": st, "started_at": t} for n, st, t in
         (("a", "running", None), ("b", "running", old), ("c", "running", fresh), ("d", "queued", None))],
        tables.SCHEMAS["scans"],
    )
    sources = spark.createDataFrame([{"source_id": n} for n in "abcd"], tables.SCHEMAS["sources"])
    new_scans, new_sources = health.recover_stale(scans, sources, now)
    assert {r.scan_run_id: r.status for r in new_scans.collect()} == {"a": "interrupted", "b": "interrupted", "c": "running", "d": "queued"}
    assert {r.source_id for r in new_sources.where("next_scan_at is not null").collect()} == {"a", "b"}


def test_observed_span(spark):
    rows = observations(spark, [posting(1, 0, "1", "a"), posting(2, 0, "1", "a")])
    span = lifecycle.observed_span(rows, ("source_id", "identity_key")).first()
    assert (span.first_discovered_at, span.last_observed_at) == (T0, T0)
