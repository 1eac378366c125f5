"""Scores against a plain re-enactment, the memo, external answers and the feed."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from vacancyledger.functions.text import STOPWORDS
from vacancyledger.operators import feed, matching, profiles
from vacancyledger.sources import tables

T0 = datetime.datetime(2026, 1, 1)

PROFILE = {
    "profile_id": "p", "created_at": T0, "version": 1,
    "resume_text": "Built Spark data pipelines in Python\n\n  Led a C++ team  \nTeaching history",
    "target_roles": ["Data Engineer", "ML"], "adjacent_roles": ["Analytics Engineer"],
    "preferred_locations": ["Berlin"], "remote_preference": "remote_only", "employment_types": [],
    "required_terms": ["Spark", "Kafka", "C++", "Go", "SQL", "dbt"], "excluded_terms": ["Clearance "],
    "preference_notes": "",
}
YOUNGER = {**PROFILE, "profile_id": "q", "created_at": T0 + datetime.timedelta(days=1), "target_roles": ["Chef"]}
JOBS = [
    ("1", "Senior Data Engineer", ["Berlin, DE"], "Spark pipelines in Python with C++ and SQL. Remote."),
    ("2", "Office Manager", ["Paris"], "On-site work in our office."),
    ("3", "Engineer, Data Platform", [], "on site, remote possible; needs clearance for data"),
    ("4", "Platform Engineer", ["Berlin"], ""),
    ("5", "Data", ["X"], None),
    ("6", "Straße Engineer", ["Y"], "Onsite. " + "python spark data pipelines " * 3),
]


def make_jobs(spark, rows=JOBS, status="active"):
    cols = tables.empty(spark, "jobs")
    data = [
        {"source_id": "s", "job_id": j, "identity_key": j, "title": t, "locations": l, "description_text": d,
         "content_fingerprint": f"f{j}", "lifecycle_status": status, "canonical_url": j,
         "first_discovered_at": T0 + datetime.timedelta(hours=int(j)), "last_observed_at": T0}
        for j, t, l, d in rows
    ]
    return spark.createDataFrame(data, cols.schema)


def make_profiles(spark, rows=(YOUNGER, PROFILE)):
    return spark.createDataFrame([dict(r) for r in rows], tables.empty(spark, "profiles").schema)


def toks(value):
    return {t for t in re.findall(r"[a-z0-9+#.]{2,}", value.casefold()) if t not in STOPWORDS}


def plain_score(title, places, description, p):
    text = "\n".join([title, " ".join(places), description or ""]).casefold()
    ruled_out = [t for t in p["excluded_terms"] if t.casefold().strip() in text]
    on_site = any(w in text for w in ("on-site", "onsite", "on site"))
    if p["remote_preference"] == "remote_only" and on_site and "remote" not in text:
        ruled_out.append("site")
    roles = p["target_roles"] + p["adjacent_roles"]
    low = title.casefold()
    if any(r.casefold() in low or low in r.casefold() for r in roles):
        role = 95
    else:
        shares = [len(toks(title) & toks(r)) / len(toks(r)) for r in roles if toks(r)]
        role = round(max(shares, default=0.0) * 85)
    words = toks(description or title)
    resume = min(100, round(100 * len(words & toks(p["resume_text"])) / max(12, len(words))))
    found = [t for t in p["required_terms"] if t.casefold().strip() in text]
    near = any(l.casefold() in " ".join(places).casefold() for l in p["preferred_locations"]) and bool(places)
    preference = min(100, 50 + min(30, 10 * len(found)) + 20 * near)
    total = round(role * 0.55 + resume * 0.35 + preference * 0.10)
    label = "irrelevant" if ruled_out or total < 45 else "strong" if total >= 75 else "possible"
    return label, 0 if ruled_out else total, role, resume, len(ruled_out)


def test_scores_equal_plain_ones(spark):
    got = {r.job_id: r for r in matching.local_scores(make_jobs(spark), make_profiles(spark)).collect()}
    for j, title, places, description in JOBS:
        r = got[j]
        mine = (r.classification, r.score, r.role_score, r.resume_score, len(r.hard_constraint_reasons))
        assert mine == plain_score(title, places, description, PROFILE), j
    assert got["2"].provider_status == "hard_constraint" and got["2"].score == 0
    assert got["1"].evidence == [
        "Title is related to a target or adjacent role (95/100)", "Job includes preferred terms: Spark, C++, SQL",
    ]
    assert got["1"].gaps == [f"Preferred term not found: {t}" for t in ("Kafka", "Go", "dbt")]
    assert got["2"].gaps[-1] == "Title has weak overlap with the configured target roles"


def test_not_ready_profile_scores_nothing(spark):
    for change in ({"resume_text": " \n"}, {"target_roles": []}):
        assert matching.local_scores(make_jobs(spark), make_profiles(spark, [{**PROFILE, **change}])).count() == 0
    assert matching.local_scores(make_jobs(spark), make_profiles(spark).limit(0)).count() == 0


def test_memo(spark):
    jobs, profs = make_jobs(spark), make_profiles(spark)
    stored = matching.local_scores(jobs, profs)
    assert matching.match_cache_misses(jobs, profs, stored).count() == 0
    summary = matching.match_summary(jobs, matching.local_scores(matching.match_cache_misses(jobs, profs, stored), profs)).first()
    assert (summary.evaluated, summary.cached, summary.failed) == (0, len(JOBS), 0)
    changed = jobs.withColumn("content_fingerprint", F.when(F.col("job_id") == "1", "new").otherwise(F.col("content_fingerprint")))
    assert [r.job_id for r in matching.match_cache_misses(changed, profs, stored).collect()] == ["1"]
    newer = make_profiles(spark, [{**PROFILE, "version": 2}])
    assert matching.match_cache_misses(jobs, newer, stored).count() == len(JOBS)


def test_resume_evidence(spark):
    got = {r.job_id: r.evidence for r in matching.resume_evidence(make_jobs(spark), make_profiles(spark)).collect()}
    assert got["1"] == "Built Spark data pipelines in Python\nLed a C++ team"
    assert got["5"] == "Built Spark data pipelines in Python"
    many = "\n".join(f"python line{i}" + (" spark" if i % 2 else "") for i in range(100))
    wide = make_profiles(spark, [{**PROFILE, "resume_text": many}])
    everything = {r.job_id: r for r in matching.resume_evidence(make_jobs(spark), wide).collect()}["6"]
    assert everything.lines == 100 and everything.evidence == many
    cut = matching.resume_evidence(make_jobs(spark), wide, most_lines=40, most_chars=6_000)
    row = {r.job_id: r for r in cut.collect()}["6"]
    assert row.lines == 40
    assert row.evidence.splitlines() == [f"python line{i} spark" for i in range(1, 80, 2)]


def test_requests_skip_ruled_out_jobs(spark):
    rows = {r.job_id: json.loads(r.payload) for r in matching.evaluation_requests(make_jobs(spark), make_profiles(spark)).collect()}
    assert set(rows) == {"1", "4", "5"}
    assert rows["1"]["profile"]["target_roles"] == ["Data Engineer", "ML"]
    assert rows["1"]["job"]["title"] == "Senior Data Engineer" and rows["5"]["job"]["description"] == ""
    assert rows["1"]["job"]["employment_type"] is None


GOOD = {"overall_score": 91, "role_score": 90, "resume_score": 88, "evidence": [str(i) for i in range(9)], "gaps": []}


def answered(spark, local, rows):
    """Answers (job_id, profile versions back, hour, body) with the memo key of the local rows."""
    given = spark.createDataFrame(rows, "job_id string, back int, hour int, body string")
    keyed = given.join(local.select(*matching.MEMO_KEY), "job_id")
    return keyed.select(
        "job_id", "profile_id", (F.col("profile_version") - F.col("back")).alias("profile_version"), "content_fingerprint",
        "matcher_version", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), "hour", F.lit(0), F.lit(0)).alias("answered_at"), "body",
    )


def test_latest_answer_to_the_current_profile_counts(spark):
    local = matching.local_scores(make_jobs(spark), make_profiles(spark))
    bodies = {h: json.dumps({**GOOD, "overall_score": h}) for h in (10, 11, 12)}
    answers = answered(spark, local, [("1", 0, 10, bodies[10]), ("1", 0, 11, bodies[11]), ("1", 1, 12, bodies[12]), ("4", 1, 3, bodies[10])])
    rows = matching.merge_evaluations(local, answers).collect()
    got = {r.job_id: r for r in rows}
    assert len(rows) == local.count() and got["1"].score == 11
    assert got["4"].provider == "local" and "missing" in got["4"].error


def test_empty_description_counts_the_title(spark):
    jobs = make_jobs(spark).withColumn("description_text", F.lit(""))
    got = matching.token_overlap(jobs, make_profiles(spark)).collect()
    assert all(r.job_tokens > 0 for r in got)


@pytest.mark.parametrize(
    "body, accepted",
    [
        (json.dumps(GOOD), True), (json.dumps({**GOOD, "role_score": 90.0}), True), (json.dumps({**GOOD, "extra": 1}), False), (json.dumps({**GOOD, "role_score": 101}), False),
        (json.dumps({**GOOD, "role_score": 50.5}), False), (json.dumps({**GOOD, "gaps": "x"}), False),
        (json.dumps({k: v for k, v in GOOD.items() if k != "gaps"}), False), ("not json", False), (None, False),
    ],
)
def test_external_answers(spark, body, accepted):
    local = matching.local_scores(make_jobs(spark), make_profiles(spark))
    answers = answered(spark, local, [("1", 0, 1, body), ("2", 0, 1, json.dumps(GOOD))])
    got = {r.job_id: r for r in matching.merge_evaluations(local, answers).collect()}
    if accepted:
        assert (got["1"].classification, got["1"].score, got["1"].provider) == ("strong", 91, "anthropic")
        assert len(got["1"].evidence) == 9 and got["1"].error is None
    else:
        assert got["1"].provider == "local" and "invalid" in got["1"].error
    assert got["2"].classification == "irrelevant" and got["2"].error is None
    assert "missing" in got["4"].error


def test_feed(spark):
    jobs = make_jobs(spark)
    profs = make_profiles(spark)
    matches = matching.local_scores(jobs, profs).where("job_id <> '5'")
    stale = matches.where("job_id = '4'").withColumn("content_fingerprint", F.lit("old"))
    matches = matches.where("job_id <> '4'").unionByName(stale)
    patches = spark.createDataFrame(
        [("1", T0, 0, True, None), ("6", T0, 1, None, True), ("1", T0, 2, False, None)],
        "job_id string, ts timestamp, seq bigint, seen boolean, dismissed boolean",
    )
    states = profiles.user_state_latest(patches)
    items = feed.feed_items(jobs, matches, profs, states)
    sources = spark.createDataFrame([("s", "Acme")], "source_id string, company string")
    rows = feed.feed(items, sources).collect()
    assert [r.job_id for r in rows] == ["1", "3", "2", "5", "4"]
    assert [r.item_class for r in rows] == ["strong", "irrelevant", "irrelevant", "unmatched", "unmatched"]
    counters = feed.feed_counters(items).first()
    assert (counters.unseen_strong, counters.unseen_possible, counters.dismissed_total) == (1, 0, 1)
    assert [r.job_id for r in feed.feed(items, sources, classification="unmatched").collect()] == ["5", "4"]
    assert len(feed.feed(items, sources, include_dismissed=True).collect()) == 6
    assert "2" not in [r.job_id for r in feed.feed(items, sources, show_irrelevant=False).collect()]


def test_assembled_pages(spark):
    rows = [("a", 1, " x "), ("a", 0, "\x00y\n"), ("a", 2, " \n"), ("b", 0, " "), ("c", 0, "z" * 50)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    got = {r.doc_id: (r.text, r.error_code) for r in profiles.assemble_pages(pages, max_chars=40).collect()}
    assert got == {"a": ("y\n\nx", None), "b": (None, "no_selectable_text"), "c": (None, "document_too_large")}


def test_profile_versions(spark):
    rows = [("p", 1, "resume_text", "a"), ("p", 2, "resume_text", "a"), ("p", 2, "notes", "n"), ("p", 3, "notes", "n"), ("p", 4, "resume_text", ""), ("q", 1, "notes", "")]
    patches = spark.createDataFrame(rows, "profile_id string, patch_seq int, field string, value string")
    for width in (1, 100):
        got = profiles.profile_versions(patches, F.floor(F.col("patch_seq") / width)).collect()
        assert {(r.profile_id, r.patch_seq): r.version for r in got} == {("p", 1): 2, ("p", 2): 3, ("p", 3): 3, ("p", 4): 4, ("q", 1): 1}
