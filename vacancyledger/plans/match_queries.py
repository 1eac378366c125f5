"""Queries over matching, the feed and user input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feed, matching, profiles, terms
from . import derived
from .derived import fold_sql, sql, table, tokens_sql


def _flat(col: str):
    return F.array_join(col, "|").alias(col)


# --- matching ---------------------------------------------------------------------------

_JOB_TEXT = "title || chr(10) || array_to_string(locations, ' ') || chr(10) || coalesce(description_text, '')"
_RESPONSE_ERROR = "External evaluation unavailable ({}); local fallback used"

SIGNALS = {
    "m1": (
        ("jobs", "prof"),
        f"""SELECT j.*, p.*, {fold_sql(_JOB_TEXT)} AS job_text,
        {tokens_sql("coalesce(description_text, title)")} AS job_tokens, {tokens_sql("title")} AS title_tokens,
        {tokens_sql("resume_text")} AS resume_tokens, list_concat(target_roles, adjacent_roles) AS roles
        FROM jobs j, prof p WHERE lifecycle_status = 'active'""",
    ),
    "m2": (
        ("m1",),
        f"""SELECT *, len(list_intersect(job_tokens, resume_tokens)) AS shared,
        list_filter(required_terms, lambda t: contains(job_text, trim({fold_sql("t")}))) AS found,
        list_filter(excluded_terms, lambda t: contains(job_text, trim({fold_sql("t")}))) AS excluded,
        contains(job_text, 'on-site') OR contains(job_text, 'onsite') OR contains(job_text, 'on site') AS on_site,
        contains(job_text, 'remote') AS remote, contains(job_text, 'hybrid') AS hybrid,
        len(list_filter(roles, lambda r: contains({fold_sql("title")}, {fold_sql("r")}) OR contains({fold_sql("r")}, {fold_sql("title")}))) > 0 AS named,
        list_max(list_transform(list_filter(roles, lambda r: len({tokens_sql("r")}) > 0),
          lambda r: len(list_intersect(title_tokens, {tokens_sql("r")})) / len({tokens_sql("r")}))) AS share,
        len(list_filter(preferred_locations, lambda l: contains({fold_sql("array_to_string(locations, ' ')")}, {fold_sql("l")}))) > 0 AS near
        FROM m1""",
    ),
    "m3": (
        ("m2",),
        """SELECT *, CASE WHEN named THEN 95 ELSE CAST(round_even(coalesce(share, 0) * 85.0::DOUBLE, 0) AS INTEGER) END AS role_score,
        least(100, CAST(round_even(100.0::DOUBLE * shared / greatest(12, len(job_tokens)), 0) AS INTEGER)) AS resume_score,
        least(100, 50 + least(30, len(found) * 10) + CASE WHEN near THEN 20 ELSE 0 END) AS preference_score,
        list_concat(list_transform(excluded, lambda t: 'Job explicitly contains excluded term: ' || t),
          CASE WHEN remote_preference = 'remote_only' AND on_site AND NOT remote THEN ['Role is explicitly on-site but the profile requires remote work']
          WHEN remote_preference = 'remote_or_hybrid' AND on_site AND NOT remote AND NOT hybrid
          THEN ['Role is explicitly on-site but the profile requires remote or hybrid work'] ELSE [] END) AS reasons FROM m2""",
    ),
    "scored": (
        ("m3",),
        """SELECT *, len(reasons) = 0 AS pass, CAST(round_even(role_score * 0.55::DOUBLE + resume_score * 0.35::DOUBLE + preference_score * 0.10::DOUBLE, 0) AS INTEGER) AS total,
        CASE WHEN len(reasons) > 0 THEN 'irrelevant' WHEN total >= 75 THEN 'strong' WHEN total >= 45 THEN 'possible' ELSE 'irrelevant' END AS classification,
        CASE WHEN len(reasons) > 0 THEN 0 ELSE total END AS score FROM m3""",
    ),
    "body": (
        (),
        """SELECT *, CASE doc_id % 6 WHEN 1 THEN 'extra' WHEN 2 THEN 'range' WHEN 3 THEN 'broken' WHEN 4 THEN 'float' ELSE 'good' END AS shape,
        CAST(doc_id % 101 AS INTEGER) AS s FROM labels""",
    ),
}
derived.CTES.update(SIGNALS)


def active_jobs(spark, sf_dir):
    return matching.matchable_jobs(derived.jobs(spark, sf_dir))


def token_overlap(spark, sf_dir):
    return matching.token_overlap(active_jobs(spark, sf_dir), derived.profiles(spark, sf_dir))


TOKEN_SQL = sql(
    f"""SELECT job_id, CAST(len(job_tokens) AS INTEGER) AS job_tokens, CAST(len(resume_tokens) AS INTEGER) AS resume_tokens,
    CAST(len(list_intersect(job_tokens, resume_tokens)) AS INTEGER) AS shared_tokens,
    CAST(len(list_intersect(title_tokens, {tokens_sql("array_to_string(target_roles, ' ')")})) AS INTEGER) AS shared_title_tokens FROM m1""",
    "m1",
)


def term_hits(spark, sf_dir):
    base = matching.attach_profile(active_jobs(spark, sf_dir), derived.profiles(spark, sf_dir))
    text = matching.job_text(F.col("title"), F.col("locations"), F.col("description_text"))
    found = base.withColumn("_text", text).select(
        "job_id", F.col("p.required_terms").alias("_req"),
        matching.term_hits(F.col("p.required_terms"), F.col("_text")).alias("_hits"),
    )
    return found.select(
        "job_id", F.array_join("_hits", "|").alias("found"),
        F.array_join(matching.missing_terms(F.col("_req"), F.col("_hits")), "|").alias("missing"),
    )


TERMS_SQL = sql(
    """SELECT job_id, array_to_string(found, '|') AS found,
    array_to_string(list_filter(required_terms, lambda t: NOT list_contains(found, t)), '|') AS missing FROM m2""",
    "m2",
)


def hard_constraints(spark, sf_dir):
    out = matching.hard_constraints(active_jobs(spark, sf_dir), derived.profiles(spark, sf_dir))
    return out.select("job_id", _flat("reasons"), "hard_constraint_pass")


HARD_SQL = sql(
    "SELECT job_id, array_to_string(reasons, '|') AS reasons, len(reasons) = 0 AS hard_constraint_pass FROM m3", "m3"
)


def local_scores(spark, sf_dir):
    return matching.local_scores(active_jobs(spark, sf_dir), derived.profiles(spark, sf_dir))


def _shown(scores):
    return scores.select(
        "job_id", "classification", "score", "role_score", "resume_score", "preference_score",
        "hard_constraint_pass", _flat("evidence"), _flat("gaps"), "provider_status",
    )


def match_scores(spark, sf_dir):
    return _shown(local_scores(spark, sf_dir))


def observed_scores(spark, sf_dir):
    """Scores of the active jobs that a scan just observed (those with a label)."""
    observed = table(spark, sf_dir, "labels").select(derived.text_id("doc_id").alias("job_id"))
    jobs = matching.matchable_jobs(derived.jobs(spark, sf_dir), observed)
    return _shown(matching.local_scores(jobs, derived.profiles(spark, sf_dir)))


_SCORES = """SELECT job_id, classification, score, role_score, resume_score, CAST(preference_score AS INTEGER) AS preference_score, pass AS hard_constraint_pass,
    array_to_string(list_concat(CASE WHEN role_score >= 60 THEN ['Title is related to a target or adjacent role (' || role_score || '/100)'] ELSE [] END,
      CASE WHEN len(found) > 0 THEN ['Job includes preferred terms: ' || array_to_string(found, ', ')] ELSE [] END), '|') AS evidence,
    array_to_string(list_concat(list_transform(list_filter(required_terms, lambda t: NOT list_contains(found, t)), lambda t: 'Preferred term not found: ' || t),
      CASE WHEN role_score < 45 THEN ['Title has weak overlap with the configured target roles'] ELSE [] END), '|') AS gaps,
    CASE WHEN pass THEN 'fallback' ELSE 'hard_constraint' END AS provider_status FROM scored"""
SCORES_SQL = sql(_SCORES, "scored")
OBSERVED_SQL = sql(_SCORES + " WHERE doc_id IN (SELECT doc_id FROM labels)", "scored")


def match_cache_misses(spark, sf_dir):
    out = matching.match_cache_misses(
        active_jobs(spark, sf_dir), derived.profiles(spark, sf_dir), derived.matches(spark, sf_dir)
    )
    return out.select("job_id", "content_fingerprint")


MISSES_SQL = sql(
    """SELECT job_id, fp AS content_fingerprint FROM jobs j WHERE lifecycle_status = 'active' AND NOT EXISTS (
    SELECT 1 FROM matches m, prof p WHERE m.job_id = j.job_id AND m.fp = j.fp AND m.profile_id = p.profile_id AND m.profile_version = p.version)""",
    "jobs", "matches", "prof",
)


def responses(spark, sf_dir):
    """Labels as answers of an external scorer; some have extra keys, scores out of range or
    not whole, or are no JSON at all."""
    k, score = F.col("doc_id") % 6, (F.col("doc_id") % 101).cast("int")
    fields = [
        F.when(k == 2, score + 500).otherwise(score).alias("overall_score"),
        score.alias("role_score"), F.lit(7).alias("resume_score"),
        F.array(*[F.lit(f"e{i}") for i in range(10)]).alias("evidence"),
        F.array().cast("array<string>").alias("gaps"),
    ]
    good = F.to_json(F.struct(*fields))
    extra = F.to_json(F.struct(*fields, F.lit("x").alias("note")))
    body = (
        F.when(k == 1, extra)
        .when(k == 3, F.substring(good, 1, 30))
        .when(k == 4, F.regexp_replace(good, '"resume_score":7', '"resume_score":7.5'))
        .otherwise(good)
    )
    body = F.when(k == 5, F.regexp_replace(good, '"resume_score":7', '"resume_score":7.0')).otherwise(body)
    # Some requests were answered before (another score), some for an older profile version.
    early = F.regexp_replace(good, '"role_score":[0-9]+', '"role_score":1')
    day = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    answers = F.array(
        F.struct(day.alias("answered_at"), F.lit(0).alias("_back"), body.alias("body")),
        F.when(
            F.col("doc_id") % 5 == 0,
            F.struct((day - F.expr("interval 1 hour")).alias("answered_at"), F.lit(0).alias("_back"), early.alias("body")),
        ),
        F.when(
            F.col("doc_id") % 7 == 0,
            F.struct((day + F.expr("interval 1 hour")).alias("answered_at"), F.lit(1).alias("_back"), early.alias("body")),
        ),
    )
    jobs = matching.attach_profile(
        derived.jobs(spark, sf_dir).select(F.col("seq").alias("doc_id"), "job_id", "content_fingerprint"),
        derived.profiles(spark, sf_dir),
    )
    given = table(spark, sf_dir, "labels").select("doc_id", F.inline(F.array_compact(answers)))
    return given.join(jobs, "doc_id").select(
        "doc_id", "job_id", F.col("p.profile_id").alias("profile_id"),
        (F.col("p.profile_version") - F.col("_back")).alias("profile_version"),
        "content_fingerprint", F.lit(matching.MATCHER_VERSION).alias("matcher_version"),
        "answered_at", "body",
    )


def _merged(spark, sf_dir):
    return matching.merge_evaluations(local_scores(spark, sf_dir), responses(spark, sf_dir))


def external_eval_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select(
        "job_id", "classification", "score", "role_score", "resume_score", _flat("evidence"),
        "provider", "provider_status", "error",
    )


MERGED = (
    ("scored", "body"),
    f"""SELECT c.*, b.doc_id IS NOT NULL AS answered, coalesce(b.shape = 'good', false) AND c.pass AS used, b.s
    FROM scored c LEFT JOIN body b ON b.doc_id = c.doc_id""",
)
derived.CTES["merged"] = MERGED
MERGE_SQL = sql(
    f"""SELECT job_id, CASE WHEN NOT used THEN classification WHEN s >= 75 THEN 'strong' WHEN s >= 45 THEN 'possible' ELSE 'irrelevant' END AS classification,
    CASE WHEN used THEN s ELSE score END AS score, CASE WHEN used THEN s ELSE role_score END AS role_score,
    CASE WHEN used THEN 7 ELSE resume_score END AS resume_score,
    CASE WHEN used THEN 'e0|e1|e2|e3|e4|e5|e6|e7|e8|e9' ELSE array_to_string(list_concat(
      CASE WHEN role_score >= 60 THEN ['Title is related to a target or adjacent role (' || role_score || '/100)'] ELSE [] END,
      CASE WHEN len(found) > 0 THEN ['Job includes preferred terms: ' || array_to_string(found, ', ')] ELSE [] END), '|') END AS evidence,
    CASE WHEN used THEN 'anthropic' ELSE 'local' END AS provider,
    CASE WHEN used THEN 'success' WHEN pass THEN 'fallback' ELSE 'hard_constraint' END AS provider_status,
    CASE WHEN used OR NOT pass THEN NULL WHEN answered THEN '{_RESPONSE_ERROR.format("invalid")}' ELSE '{_RESPONSE_ERROR.format("missing")}' END AS error FROM merged""",
    "merged",
)


def match_summary(spark, sf_dir):
    """Counts of a run that scores what is not stored yet, with external answers."""
    _, summary = matching.run_matching(
        derived.jobs(spark, sf_dir), derived.profiles(spark, sf_dir),
        derived.matches(spark, sf_dir), responses=responses(spark, sf_dir),
    )
    return summary


SUMMARY_SQL = sql(
    """, miss AS (SELECT * FROM merged g WHERE NOT EXISTS (SELECT 1 FROM matches m, prof p
      WHERE m.job_id = g.job_id AND m.fp = g.fp AND m.profile_id = p.profile_id AND m.profile_version = p.version))
    SELECT (SELECT count(*) FROM miss) AS evaluated, (SELECT count(*) FROM jobs WHERE lifecycle_status = 'active') - (SELECT count(*) FROM miss) AS cached,
    (SELECT count(*) FROM miss WHERE used) AS ai_succeeded, (SELECT count(*) FROM miss WHERE NOT used) AS local_fallbacks, 0::BIGINT AS failed""",
    "merged", "matches", "prof", "jobs",
)


def resume_evidence(spark, sf_dir):
    out = matching.resume_evidence(active_jobs(spark, sf_dir), derived.profiles(spark, sf_dir))
    return out.select("job_id", "lines", "evidence")


EVIDENCE_SQL = sql(
    f""", l AS (SELECT i, line, {tokens_sql("line")} AS t FROM (
      SELECT row_number() OVER (ORDER BY n) - 1 AS i, trim(line) AS line FROM (
        SELECT unnest(string_split(resume_text, chr(10))) AS line, generate_subscripts(string_split(resume_text, chr(10)), 1) AS n FROM prof)
      WHERE trim(line) <> '')),
    t AS (SELECT job_id, resume_text, {tokens_sql("title || ' ' || coalesce(description_text, '') || ' ' || array_to_string(target_roles, ' ')")} AS terms FROM m1),
    h AS (SELECT job_id, i, line, len(list_intersect(t.terms, l.t)) AS n FROM t, l),
    r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC, i) AS rn FROM h WHERE n > 0),
    g AS (SELECT job_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS e FROM r GROUP BY 1)
    SELECT t.job_id, CAST(coalesce(lines, 0) AS INTEGER) AS lines, CASE WHEN lines > 0 THEN e ELSE resume_text END AS evidence
    FROM t LEFT JOIN g USING (job_id)""",
    "m1", "prof",
)


def evaluation_requests(spark, sf_dir):
    out = matching.evaluation_requests(active_jobs(spark, sf_dir), derived.profiles(spark, sf_dir))
    job = F.col("parsed")
    return out.withColumn("parsed", F.try_parse_json("payload")).select(
        "job_id", "profile_id", "profile_version",
        F.try_variant_get(job, "$.job.title", "string").alias("title"),
        F.md5(F.try_variant_get(job, "$.job.description", "string")).alias("description_md5"),
        F.try_variant_get(job, "$.profile.required_terms[3]", "string").alias("last_term"),
        F.try_variant_get(job, "$.profile.remote_preference", "string").alias("remote_preference"),
    )


REQUESTS_SQL = sql(
    """SELECT job_id, profile_id, version AS profile_version, title, md5(coalesce(description_text, '')) AS description_md5,
    ' Remote ' AS last_term, remote_preference FROM scored WHERE pass""",
    "scored",
)


# --- feed -------------------------------------------------------------------------------


def feed_items(spark, sf_dir):
    patches = derived.user_state_patches(spark, sf_dir)
    return feed.feed_items(
        derived.jobs(spark, sf_dir), derived.matches(spark, sf_dir),
        derived.profiles(spark, sf_dir), profiles.user_state_latest(patches),
    )


def ranked_feed(spark, sf_dir):
    """Feed without dismissed jobs, best class first."""
    out = feed.feed(feed_items(spark, sf_dir), derived.sources(spark, sf_dir))
    return out.select(
        "job_id", "company", "title", "item_class", "score", "first_discovered_at", "unseen"
    )


FEED_SQL = sql(
    """SELECT job_id, company, title, item_class, score, first_discovered_at, unseen FROM feed_items f
    JOIN srcs s ON s.source_id = f.source_id WHERE NOT dismissed""",
    "feed_items", "srcs",
)


def feed_relevant(spark, sf_dir):
    """Feed as the page first shows it: nothing irrelevant, dismissed jobs included."""
    out = feed.feed(
        feed_items(spark, sf_dir), derived.sources(spark, sf_dir), include_dismissed=True,
        show_irrelevant=False,
    )
    return out.select("job_id", "company", "item_class", "score", "dismissed")


RELEVANT_SQL = sql(
    """SELECT job_id, company, item_class, score, dismissed FROM feed_items f
    JOIN srcs s ON s.source_id = f.source_id WHERE item_class <> 'irrelevant'""",
    "feed_items", "srcs",
)


def feed_counters(spark, sf_dir):
    return feed.feed_counters(feed_items(spark, sf_dir))


COUNTERS_SQL = sql(
    """SELECT count(*) FILTER (WHERE unseen AND item_class = 'strong') AS unseen_strong,
    count(*) FILTER (WHERE unseen AND item_class = 'possible') AS unseen_possible, count(*) FILTER (WHERE dismissed) AS dismissed_total FROM feed_items""",
    "feed_items",
)


def class_histogram(spark, sf_dir):
    return feed.class_histogram(feed_items(spark, sf_dir))


HISTOGRAM_SQL = sql("SELECT item_class, count(*) AS items FROM feed_items GROUP BY 1", "feed_items")


def jobs_page(spark, sf_dir):
    out = feed.jobs_page(derived.jobs(spark, sf_dir), 2, 25, lifecycle_status="active")
    return out.select("job_id", "title", "first_discovered_at", "total")


JOBS_PAGE_SQL = sql(
    """SELECT job_id, title, first_discovered_at, (SELECT count(*) FROM jobs WHERE lifecycle_status = 'active') AS total
    FROM jobs WHERE lifecycle_status = 'active' ORDER BY first_discovered_at DESC, job_id LIMIT 25 OFFSET 25""",
    "jobs",
)


def jobs_page_after(spark, sf_dir):
    """The fourth page of the active jobs through the page index, and the rows that follow its last one."""
    jobs = derived.jobs(spark, sf_dir).where(F.col("lifecycle_status") == "active")
    found = feed.jobs_page_from(jobs, feed.jobs_page_index(jobs, 25), 4, 25).select("job_id", "first_discovered_at")
    last = found.orderBy("first_discovered_at", F.desc("job_id")).first()
    more = feed.jobs_page_after(jobs, (last["first_discovered_at"], last["job_id"]), 10).select("job_id", "first_discovered_at")
    return found.withColumn("part", F.lit("page")).unionByName(more.withColumn("part", F.lit("after")))


AFTER_SQL = sql(
    """SELECT job_id, first_discovered_at, CASE WHEN n <= 100 THEN 'page' ELSE 'after' END AS part
    FROM (SELECT *, row_number() OVER (ORDER BY first_discovered_at DESC, job_id) AS n FROM jobs WHERE lifecycle_status = 'active')
    WHERE n BETWEEN 76 AND 110""",
    "jobs",
)


def page_index(spark, sf_dir):
    """Where every page of all jobs starts."""
    return feed.jobs_page_index(derived.jobs(spark, sf_dir), 25)


INDEX_SQL = sql(
    """SELECT (n - 1) // 25 + 1 AS page, first_discovered_at, job_id
    FROM (SELECT *, row_number() OVER (ORDER BY first_discovered_at DESC, job_id) AS n FROM jobs) WHERE (n - 1) % 25 = 0""",
    "jobs",
)


def _terms(spark, sf_dir):
    """Terms of all benchmark items: pairs of words, single words and letters."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)
    made = F.array(
        F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))), F.concat(F.lit(" "), F.upper(F.get(words, F.lit(2)))),
        F.substring(F.get(words, F.lit(3)), 1, 2), F.lit(""),
    )
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(made).alias("at", "term"))
    return each.select((F.col("item_id") * 4 + F.col("at")).alias("term_id"), "term")


def contained_terms(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return terms.contained_terms(_terms(spark, sf_dir), texts)


CONTAINED_SQL = f"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark),
    t AS (SELECT item_id * 4 AS term_id, w[1] || ' ' || w[2] AS term FROM w UNION ALL SELECT item_id * 4 + 1, upper(w[3]) FROM w
      UNION ALL SELECT item_id * 4 + 2, substr(w[4], 1, 2) FROM w),
    d AS (SELECT doc_id, {derived.fold_sql("text")} AS folded FROM documents)
    SELECT term_id, doc_id AS text_id FROM t JOIN d ON contains(folded, {derived.fold_sql("term")})"""


def overlapping_tokens(spark, sf_dir):
    """Benchmark items against all documents that hold at least nine tenths of an item's tokens."""
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("left_id"), "text")
    right = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("right_id"), "text")
    return terms.overlapping_tokens(left, right, 0.9)


OVERLAPPING_SQL = f"""WITH l AS (SELECT item_id AS left_id, {derived.tokens_sql("text")} AS t FROM benchmark),
    r AS (SELECT doc_id AS right_id, {derived.tokens_sql("text")} AS t FROM documents),
    p AS (SELECT left_id, right_id, len(l.t) AS left_tokens, len(list_intersect(l.t, r.t)) AS shared FROM l, r WHERE len(l.t) > 0)
    SELECT * FROM p WHERE shared >= 0.9 * left_tokens - 1e-9"""


def scan_jobs_page(spark, sf_dir):
    obs = derived.jobs(spark, sf_dir).withColumn("observation_id", F.col("seq"))
    out = feed.scan_jobs_page(obs, "scan-src1", 1, 100)
    return out.select("observation_id", "title", "total")


SCAN_PAGE_SQL = sql(
    """SELECT doc_id AS observation_id, title, (SELECT count(*) FROM jobs WHERE source_id = 'src1') AS total
    FROM jobs WHERE source_id = 'src1' ORDER BY title, doc_id LIMIT 100""",
    "jobs",
)


def sources_with_contacts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    srcs = nation.select(
        derived.text_id("n_nationkey").alias("source_id"), F.col("n_name").alias("company"),
        derived.at_hours(F.col("n_nationkey") % 3).alias("created_at"),
    )
    # The first source has no contacts, and contacts of the last number no source.
    contacts = table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") + 1).cast("string").alias("source_id"), derived.text_id("c_custkey").alias("contact_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://people.example/"), derived.text_id("c_custkey")).alias("contact_url"),
    )
    counted = srcs.join(feed.contact_counts(contacts), "source_id", "left")
    return feed.sources_with_contacts(counted, contacts).select(
        "source_id", "company", "contact_id", "name", "contact_url", "contacts"
    )


CONTACTS_SQL = """WITH c AS (SELECT c_nationkey + 1 AS c_nationkey, c_custkey, c_name FROM customer)
    SELECT CAST(n_nationkey AS VARCHAR) AS source_id, n_name AS company, CAST(c_custkey AS VARCHAR) AS contact_id, c_name AS name,
    'https://people.example/' || c_custkey AS contact_url,
    CASE WHEN c_custkey IS NOT NULL THEN count(*) OVER (PARTITION BY n_nationkey) END AS contacts
    FROM nation LEFT JOIN c ON c_nationkey = n_nationkey"""


# --- user input -------------------------------------------------------------------------


def user_state_latest(spark, sf_dir):
    return profiles.user_state_latest(derived.user_state_patches(spark, sf_dir))


STATE_SQL = sql("SELECT job_id, seen_at, dismissed_at FROM states", "states")


def profile_patches(spark, sf_dir):
    """Purchases as patches of one to two profile fields."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    number = F.floor(F.col("value") / 20).cast("long").cast("string")
    fields = F.array(
        F.struct(F.lit("resume_text").alias("field"), number.alias("value")),
        F.struct(
            F.when(F.col("event_id") % 3 == 0, "notes").alias("field"),
            F.when(F.col("event_id") % 2 == 0, "").otherwise("n").alias("value"),
        ),
    )
    return e.select(
        (F.col("user_id") % 50).alias("profile_id"), F.col("event_id").alias("patch_seq"),
        F.explode(fields).alias("f"),
    ).select("profile_id", "patch_seq", "f.field", "f.value").where(F.col("field").isNotNull())


def profile_versions(spark, sf_dir):
    return profiles.profile_versions(
        profile_patches(spark, sf_dir), F.floor(F.col("patch_seq") / 1000)
    )


VERSIONS_SQL = """WITH e AS (SELECT user_id % 50 AS profile_id, event_id, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS v FROM events WHERE event_type = 'purchase'),
    p AS (SELECT profile_id, event_id, 'resume_text' AS field, v FROM e
      UNION ALL SELECT profile_id, event_id, 'notes', CASE WHEN event_id % 2 = 0 THEN '' ELSE 'n' END FROM e WHERE event_id % 3 = 0),
    c AS (SELECT profile_id, event_id, v <> coalesce(lag(v) OVER (PARTITION BY profile_id, field ORDER BY event_id), '') AS ch FROM p),
    b AS (SELECT profile_id, event_id, bool_or(ch) AS changed FROM c GROUP BY ALL)
    SELECT profile_id, event_id AS patch_seq, changed,
    1 + CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY event_id) AS BIGINT) AS version FROM b"""


def page_text_assembly(spark, sf_dir):
    """Conversations as documents, turns as their pages; some turns are blank."""
    c = table(spark, sf_dir, "conversations")
    pages = c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"),
        F.when((F.col("conv_id") % 10 == 3) | (F.col("turn") % 4 == 3), "  \n").otherwise(
            F.concat(F.lit(" \t"), "text", F.lit("\n"))
        ).alias("text"),
    )
    out = profiles.assemble_pages(pages)
    return out.select("doc_id", "pages", F.md5("text").alias("text_md5"), "error_code")


ASSEMBLY_SQL = """WITH p AS (SELECT conv_id AS doc_id, turn, CASE WHEN conv_id % 10 = 3 OR turn % 4 = 3 THEN '' ELSE trim(text, ' ' || chr(9) || chr(10)) END AS t FROM conversations),
    g AS (SELECT doc_id, count(*) FILTER (WHERE t <> '') AS pages, string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE t <> '') AS x FROM p GROUP BY 1)
    SELECT doc_id, pages, md5(x) AS text_md5, CASE WHEN x IS NULL THEN 'no_selectable_text' END AS error_code FROM g"""

QUERIES = {
    "feed": (ranked_feed, FEED_SQL),
    "feed_relevant": (feed_relevant, RELEVANT_SQL),
    "feed_counters": (feed_counters, COUNTERS_SQL),
    "class_histogram": (class_histogram, HISTOGRAM_SQL),
    "jobs_page": (jobs_page, JOBS_PAGE_SQL),
    "jobs_page_after": (jobs_page_after, AFTER_SQL),
    "page_index": (page_index, INDEX_SQL),
    "contained_terms": (contained_terms, CONTAINED_SQL),
    "overlapping_tokens": (overlapping_tokens, OVERLAPPING_SQL),
    "scan_jobs_page": (scan_jobs_page, SCAN_PAGE_SQL),
    "sources_with_contacts": (sources_with_contacts, CONTACTS_SQL),
    "token_overlap": (token_overlap, TOKEN_SQL),
    "term_hits": (term_hits, TERMS_SQL),
    "hard_constraints": (hard_constraints, HARD_SQL),
    "match_scores": (match_scores, SCORES_SQL),
    "observed_scores": (observed_scores, OBSERVED_SQL),
    "match_cache_misses": (match_cache_misses, MISSES_SQL),
    "external_eval_merge": (external_eval_merge, MERGE_SQL),
    "match_summary": (match_summary, SUMMARY_SQL),
    "resume_evidence": (resume_evidence, EVIDENCE_SQL),
    "evaluation_requests": (evaluation_requests, REQUESTS_SQL),
    "user_state_latest": (user_state_latest, STATE_SQL),
    "profile_versions": (profile_versions, VERSIONS_SQL),
    "page_text_assembly": (page_text_assembly, ASSEMBLY_SQL),
}
