"""Scoring of jobs against the current candidate profile.

The application works for one candidate: the oldest profile row. It enters the plan as a
one-row scalar subquery (Spark fails the query if it had more rows), so scoring is a narrow
projection over the jobs: no shuffle, no pair table, and everything derived from the profile is
computed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    cap, fold, let, missing_terms, settle, strip_ws, text_lines, tokens,
)

# Versions, thresholds and length rules of the matcher.
MATCHER_VERSION = "hybrid-v1"
STRONG_THRESHOLD = 75
POSSIBLE_THRESHOLD = 45
ON_SITE_WORDS = ("on-site", "onsite", "on site")
LOCAL_PROVIDER, EXTERNAL_PROVIDER = "local", "anthropic"
MEMO_KEY = (
    "job_id", "profile_id", "profile_version", "content_fingerprint", "matcher_version",
)

_LISTS = (
    "target_roles", "adjacent_roles", "preferred_locations", "employment_types",
    "required_terms", "excluded_terms",
)


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def profile_ready(resume_text: Column, target_roles: Column) -> Column:
    return (F.length(strip_ws(F.coalesce(resume_text, F.lit("")))) > 0) & (
        F.size(_strings(target_roles)) > 0
    )


def current_profile(profiles: DataFrame) -> DataFrame:
    """The oldest profile as one row with one struct ``p``: its fields and what scoring needs
    from them (folded lists, token sets, résumé lines)."""
    oldest = profiles.orderBy("created_at", "profile_id").limit(1)
    base = oldest.select(
        "profile_id",
        F.col("version").alias("profile_version"),
        F.coalesce("resume_text", F.lit("")).alias("resume_text"),
        F.coalesce("remote_preference", F.lit("no_preference")).alias("remote_preference"),
        F.coalesce("preference_notes", F.lit("")).alias("preference_notes"),
        *[_strings(F.col(c)).alias(c) for c in _LISTS],
    )
    derived = base.select(
        "*",
        profile_ready(F.col("resume_text"), F.col("target_roles")).alias("ready"),
        tokens(F.col("resume_text")).alias("resume_tokens"),
        F.transform(
            F.concat("target_roles", "adjacent_roles"),
            lambda r: F.struct(fold(r).alias("phrase"), tokens(r).alias("tokens")),
        ).alias("roles"),
        tokens(F.array_join("target_roles", " ")).alias("target_tokens"),
        F.transform("preferred_locations", fold).alias("locations_folded"),
        phrases(F.col("required_terms")).alias("required"),
        phrases(F.col("excluded_terms")).alias("excluded"),
        F.transform(
            text_lines(F.col("resume_text")),
            lambda line, i: F.struct(i.alias("index"), line.alias("line"), tokens(line).alias("tokens")),
        ).alias("lines"),
    )
    return derived.select(F.struct("*").alias("p"))


def attach_profile(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Add the current profile as column ``p``; no rows when there is none or it is not ready."""
    profile = current_profile(profiles).where("p.ready")
    return jobs.withColumn("p", profile.scalar()).where(F.col("p").isNotNull())


def matchable_jobs(jobs: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Active jobs, or only those a scan just observed."""
    active = jobs.where(F.col("lifecycle_status") == "active")
    if observed is None:
        return active
    return active.join(observed.select("job_id"), "job_id", "left_semi")


# --- signals ----------------------------------------------------------------------------


def job_text(title: Column, locations: Column, description: Column) -> Column:
    return F.concat_ws(
        "\n", title, F.array_join(_strings(locations), " "), F.coalesce(description, F.lit(""))
    )


def phrases(terms: Column) -> Column:
    """Terms with the folded, stripped form that is looked for."""
    return F.transform(
        terms, lambda t: F.struct(t.alias("term"), strip_ws(fold(t)).alias("phrase"))
    )


def _hits(terms: Column, folded_text: Column) -> Column:
    """Terms (see ``phrases``) whose phrase is part of the text."""
    # The text is bound outside the lambda: an expression inside it would run once per term.
    return let(
        folded_text,
        lambda text: F.transform(
            F.filter(terms, lambda t: F.contains(text, t["phrase"])), lambda t: t["term"]
        ),
    )


def term_hits(terms: Column, text: Column) -> Column:
    """Terms contained in the text, ignoring case; plain substrings, not words."""
    return _hits(phrases(terms), fold(text))


def hard_reasons(text: Column, excluded: Column, preference: Column) -> Column:
    """Reasons a job is ruled out; ``text`` is the folded job text, ``excluded`` the excluded
    terms in the form ``phrases`` gives."""
    hits = _hits(excluded, text)
    on_site = F.lit(False)
    for word in ON_SITE_WORDS:
        on_site = on_site | text.contains(word)
    remote, hybrid = text.contains("remote"), text.contains("hybrid")
    by_term = F.transform(
        hits, lambda t: F.concat(F.lit("Job explicitly contains excluded term: "), t)
    )
    remote_only = F.when(
        (preference == "remote_only") & on_site & ~remote,
        "Role is explicitly on-site but the profile requires remote work",
    )
    flexible = F.when(
        (preference == "remote_or_hybrid") & on_site & ~remote & ~hybrid,
        "Role is explicitly on-site but the profile requires remote or hybrid work",
    )
    return F.concat(by_term, F.array_compact(F.array(remote_only, flexible)))


def overlap(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def role_score(title: Column, roles: Column) -> Column:
    """95 when a role and the title contain one another, else 85 times the best share of a
    role's tokens found in the title."""
    contained = let(
        fold(title),
        lambda t: F.exists(
            roles, lambda r: F.contains(t, r["phrase"]) | F.contains(r["phrase"], t)
        ),
    )

    def shares(title_tokens: Column) -> Column:
        return F.transform(
            F.filter(roles, lambda r: F.size(r["tokens"]) > 0),
            lambda r: overlap(title_tokens, r["tokens"]).cast("double") / F.size(r["tokens"]),
        )

    best = F.coalesce(F.array_max(let(tokens(title), shares)), F.lit(0.0))
    return F.when(contained, F.lit(95)).otherwise(F.rint(best * F.lit(85.0)).cast("int"))


def resume_score(shared: Column, job_tokens: Column) -> Column:
    share = F.lit(100.0) * shared / F.greatest(F.lit(12), job_tokens)
    return F.least(F.lit(100), F.rint(share).cast("int"))


def preference_score(found: Column, locations: Column, preferred_folded: Column) -> Column:
    place = fold(F.array_join(_strings(locations), " "))
    near = (F.size(_strings(locations)) > 0) & let(
        place, lambda text: F.exists(preferred_folded, lambda l: F.contains(text, l))
    )
    terms = F.least(F.lit(30), F.size(found) * 10)
    return F.least(F.lit(100), F.lit(50) + terms + F.when(near, 20).otherwise(0))


def composite(role: Column, resume: Column, preference: Column) -> Column:
    total = role * F.lit(0.55) + resume * F.lit(0.35) + preference * F.lit(0.10)
    return F.rint(total).cast("int")


def classify(score: Column, passed: Column) -> Column:
    return (
        F.when(~passed, "irrelevant")
        .when(score >= STRONG_THRESHOLD, "strong")
        .when(score >= POSSIBLE_THRESHOLD, "possible")
        .otherwise("irrelevant")
    )


def _first(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def _capped(text: Column, most: int | None) -> Column:
    return text if most is None else cap(text, most)


# Fixed values below: the texts of the messages.


def evidence_messages(role: Column, found: Column, listed_terms: int | None = None) -> Column:
    listed = F.array_join(_first(found, listed_terms), ", ")
    return F.array_compact(
        F.array(
            F.when(
                role >= 60, F.format_string("Title is related to a target or adjacent role (%d/100)", role)
            ),
            F.when(F.size(found) > 0, F.concat(F.lit("Job includes preferred terms: "), listed)),
        )
    )


def gap_messages(role: Column, missing: Column, listed_terms: int | None = None) -> Column:
    terms = F.transform(
        _first(missing, listed_terms),
        lambda t: F.concat(F.lit("Preferred term not found: "), t),
    )
    weak = F.when(role < 45, "Title has weak overlap with the configured target roles")
    return F.concat(terms, F.array_compact(F.array(weak)))


# --- operators --------------------------------------------------------------------------


def token_overlap(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sizes of the token sets of job text and résumé and of what they share."""
    described = F.when(F.length("description_text") > 0, F.col("description_text"))
    base = attach_profile(jobs, profiles).withColumn(
        "_tokens", tokens(F.coalesce(described, "title"))
    )
    return base.select(
        "job_id",
        F.size("_tokens").alias("job_tokens"),
        F.size("p.resume_tokens").alias("resume_tokens"),
        overlap(F.col("_tokens"), F.col("p.resume_tokens")).alias("shared_tokens"),
        overlap(tokens(F.col("title")), F.col("p.target_tokens")).alias("shared_title_tokens"),
    )


def hard_constraints(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    base = attach_profile(jobs, profiles).withColumn(
        "_text", fold(job_text(F.col("title"), F.col("locations"), F.col("description_text")))
    )
    reasons = hard_reasons(F.col("_text"), F.col("p.excluded"), F.col("p.remote_preference"))
    return base.select("job_id", reasons.alias("reasons")).withColumn(
        "hard_constraint_pass", F.size("reasons") == 0
    )


def local_scores(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """One match row per job: class, scores, reasons, evidence and gaps."""
    staged = attach_profile(jobs, profiles).select(
        "job_id", "content_fingerprint", "title", "locations", "p",
        fold(job_text(F.col("title"), F.col("locations"), F.col("description_text"))).alias("_text"),
        tokens(
            F.when(F.length("description_text") > 0, F.col("description_text")).otherwise(
                F.col("title")
            )
        ).alias("_tokens"),
    )
    signals = staged.select(
        "job_id", "content_fingerprint",
        F.col("p.profile_id").alias("profile_id"),
        F.col("p.profile_version").alias("profile_version"),
        F.lit(MATCHER_VERSION).alias("matcher_version"),
        hard_reasons(F.col("_text"), F.col("p.excluded"), F.col("p.remote_preference")).alias(
            "hard_constraint_reasons"
        ),
        role_score(F.col("title"), F.col("p.roles")).alias("role_score"),
        resume_score(
            overlap(F.col("_tokens"), F.col("p.resume_tokens")), F.size("_tokens")
        ).alias("resume_score"),
        _hits(F.col("p.required"), F.col("_text")).alias("_found"),
        F.col("p.required_terms").alias("_required"),
        "locations",
        F.col("p.locations_folded").alias("_places"),
    )
    scored = signals.select(
        "*",
        preference_score(F.col("_found"), F.col("locations"), F.col("_places")).alias(
            "preference_score"
        ),
        (F.size("hard_constraint_reasons") == 0).alias("hard_constraint_pass"),
        missing_terms(F.col("_required"), F.col("_found")).alias("_missing"),
    ).withColumn(
        "_score", composite(F.col("role_score"), F.col("resume_score"), F.col("preference_score"))
    )
    passed = F.col("hard_constraint_pass")
    return scored.select(
        *MEMO_KEY,
        classify(F.col("_score"), passed).alias("classification"),
        F.when(passed, F.col("_score")).otherwise(0).alias("score"),
        "role_score", "resume_score", "preference_score",
        "hard_constraint_pass", "hard_constraint_reasons",
        evidence_messages(F.col("role_score"), F.col("_found")).alias("evidence"),
        gap_messages(F.col("role_score"), F.col("_missing")).alias("gaps"),
        F.lit(LOCAL_PROVIDER).alias("provider"),
        F.when(passed, "fallback").otherwise("hard_constraint").alias("provider_status"),
        F.lit(None).cast("string").alias("error"),
    )


def match_keys(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``jobs`` with the rest of the key of their results: the profile, its version and the matcher's."""
    return attach_profile(jobs, profiles).select(
        *jobs.columns,
        F.col("p.profile_id").alias("profile_id"),
        F.col("p.profile_version").alias("profile_version"),
        F.lit(MATCHER_VERSION).alias("matcher_version"),
    )


def match_cache_misses(jobs: DataFrame, profiles: DataFrame, matches: DataFrame) -> DataFrame:
    """Jobs not yet scored for this profile version, content and matcher."""
    keyed = match_keys(jobs, profiles)
    return keyed.join(matches.select(*MEMO_KEY), list(MEMO_KEY), "left_anti").select(*jobs.columns)


def match_summary(
    candidates: DataFrame, results: DataFrame, failed: DataFrame | None = None
) -> DataFrame:
    """Counts of one matching run. ``candidates`` are all jobs considered, ``results`` the rows
    that the run produced, ``failed`` the jobs it could not score."""
    def tally(flag: Column) -> Column:
        return F.coalesce(F.sum(flag.cast("long")), F.lit(0))

    def counted(df: DataFrame | None) -> Column:
        return F.lit(0).cast("long") if df is None else df.agg(F.count(F.lit(1))).scalar()

    done = results.agg(
        F.count(F.lit(1)).alias("evaluated"),
        tally(F.col("provider") == EXTERNAL_PROVIDER).alias("ai_succeeded"),
        tally(F.col("provider") == LOCAL_PROVIDER).alias("local_fallbacks"),
    ).withColumns({"candidates": counted(candidates), "failed": counted(failed)})
    cached = F.col("candidates") - F.col("evaluated") - F.col("failed")
    return done.select(
        "evaluated", cached.alias("cached"), "ai_succeeded", "local_fallbacks", "failed"
    )


def resume_evidence(
    jobs: DataFrame,
    profiles: DataFrame,
    keep: tuple[str, ...] = ("job_id",),
    most_lines: int | None = None,
    most_chars: int | None = None,
    head_chars: int | None = None,
) -> DataFrame:
    """Résumé lines that speak for a job, by shared tokens (earlier lines first), in their
    original order; the résumé when none shares a token. ``most_lines`` keeps the best lines,
    ``most_chars`` and ``head_chars`` the first characters; all are uncut by default."""
    staged = attach_profile(jobs, profiles).select(
        *keep, "p",
        F.array_union(
            tokens(F.concat_ws(" ", F.col("title"), F.coalesce("description_text", F.lit("")))),
            F.col("p.target_tokens"),
        ).alias("_terms"),
    )

    def rank(hits: Column) -> Column:
        scored = F.transform(
            F.col("p.lines"),
            lambda l: F.struct(
                (-overlap(l["tokens"], hits)).alias("rank"),
                l["index"].alias("index"),
                l["line"].alias("line"),
            ),
        )
        return F.array_sort(F.filter(scored, lambda l: l["rank"] < 0))

    # Only résumé tokens can hit, so each line is compared with that small set.
    ranked = staged.withColumn("_ranked", let(F.array_intersect("p.resume_tokens", "_terms"), rank))
    chosen = F.array_sort(
        F.transform(
            _first(F.col("_ranked"), most_lines),
            lambda l: F.struct(l["index"].alias("index"), l["line"].alias("line")),
        )
    )
    joined = F.array_join(F.transform(chosen, lambda l: l["line"]), "\n")
    return ranked.select(
        *keep,
        F.size(_first(F.col("_ranked"), most_lines)).alias("lines"),
        F.when(F.size("_ranked") > 0, _capped(joined, most_chars))
        .otherwise(_capped(F.col("p.resume_text"), head_chars))
        .alias("evidence"),
        "p",
    )


def evaluation_requests(
    jobs: DataFrame,
    profiles: DataFrame,
    most_lines: int | None = None,
    most_chars: int | None = None,
    head_chars: int | None = None,
    job_chars: int | None = None,
) -> DataFrame:
    """One JSON request per job for an external scorer; jobs that a hard constraint rules out
    are not sent. The limits of a scorer, if it has any, are the caller's."""
    kept = ("job_id", "content_fingerprint", "title", "locations", "employment_type", "description_text")
    text = fold(job_text(F.col("title"), F.col("locations"), F.col("description_text")))
    evidence = resume_evidence(jobs, profiles, kept, most_lines, most_chars, head_chars)
    reasons = let(
        text, lambda t: hard_reasons(t, F.col("p.excluded"), F.col("p.remote_preference"))
    )
    profile_slice = F.struct(
        *[
            F.col(f"p.{c}").alias(c)
            for c in (
                "target_roles", "adjacent_roles", "preferred_locations", "remote_preference",
                "employment_types", "required_terms", "preference_notes",
            )
        ],
        F.col("evidence").alias("selected_resume_evidence"),
    )
    job_slice = F.struct(
        "title", "locations", "employment_type",
        _capped(F.coalesce("description_text", F.lit("")), job_chars).alias("description"),
    )
    payload = F.to_json(
        F.struct(profile_slice.alias("profile"), job_slice.alias("job")),
        {"ignoreNullFields": "false"},
    )
    requests = evidence.select(
        "job_id", "content_fingerprint",
        F.col("p.profile_id").alias("profile_id"),
        F.col("p.profile_version").alias("profile_version"),
        payload.alias("payload"),
        (F.size(reasons) == 0).alias("_allowed"),
    )
    return settle(requests, F.col("_allowed")).drop("_allowed")


# The only keys a response may have.
_RESPONSE_KEYS = ("evidence", "gaps", "overall_score", "resume_score", "role_score")


def parse_evaluation(body: Column, listed: int | None = None) -> Column:
    """A response as a struct, or null unless it is an object with exactly the expected keys,
    whole scores from 0 to 100 (``80.0`` is whole) and text lists."""
    v = F.try_parse_json(body)
    keys = F.array_sort(F.json_object_keys(body))

    def score(name: str) -> Column:
        field = F.try_variant_get(v, f"$.{name}", "variant")
        number = F.schema_of_variant(field).rlike("^(BIGINT|DECIMAL|DOUBLE)")
        value = F.try_variant_get(field, "$", "double")
        return F.when(number & (value == F.floor(value)) & value.between(0, 100), value.cast("int"))

    def texts(name: str) -> Column:
        field = F.try_variant_get(v, f"$.{name}", "variant")
        kind = F.schema_of_variant(field)
        return F.when(
            kind.isin("ARRAY<STRING>", "ARRAY<VOID>"),
            F.try_variant_get(field, "$", "array<string>"),
        )

    overall, role, resume = score("overall_score"), score("role_score"), score("resume_score")
    evidence, gaps = texts("evidence"), texts("gaps")
    no_null = ~F.exists(evidence, lambda x: x.isNull()) & ~F.exists(gaps, lambda x: x.isNull())
    valid = (
        (keys == F.array(*[F.lit(k) for k in _RESPONSE_KEYS]))
        & overall.isNotNull() & role.isNotNull() & resume.isNotNull()
        & evidence.isNotNull() & gaps.isNotNull() & no_null
    )
    return F.when(
        valid,
        F.struct(
            overall.alias("score"), role.alias("role_score"), resume.alias("resume_score"),
            _first(evidence, listed).alias("evidence"),
            _first(gaps, listed).alias("gaps"),
        ),
    )


def merge_evaluations(local: DataFrame, responses: DataFrame) -> DataFrame:
    """Replace local scores by a valid external response (the memo key, ``answered_at``, ``body``);
    a bad or missing one leaves the local row with an error text. Of several answers to a request the
    latest counts (of equally late ones the greater body); answers to another profile version, content
    or matcher do not. Rows a hard constraint rules out keep the local result."""
    latest = responses.groupBy(*MEMO_KEY).agg(
        F.max(F.struct("answered_at", "body")).alias("_last")
    )
    parsed = latest.select(
        *MEMO_KEY, F.lit(True).alias("_answered"),
        parse_evaluation(F.col("_last.body")).alias("_r"),
    )
    joined = local.join(parsed, list(MEMO_KEY), "left")
    use = F.col("hard_constraint_pass") & F.col("_r").isNotNull()
    error = F.when(~F.col("hard_constraint_pass"), F.col("error")).when(
        F.col("_answered").isNull(), "External evaluation unavailable (missing); local fallback used"
    ).otherwise("External evaluation unavailable (invalid); local fallback used")

    def pick(name: str) -> Column:
        return F.when(use, F.col(f"_r.{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(
        *MEMO_KEY,
        F.when(use, classify(F.col("_r.score"), F.lit(True))).otherwise(F.col("classification")).alias(
            "classification"
        ),
        pick("score"), pick("role_score"), pick("resume_score"), "preference_score",
        "hard_constraint_pass", "hard_constraint_reasons", pick("evidence"), pick("gaps"),
        F.when(use, EXTERNAL_PROVIDER).otherwise(F.col("provider")).alias("provider"),
        F.when(use, "success").otherwise(F.col("provider_status")).alias("provider_status"),
        F.when(use, F.lit(None)).otherwise(error).alias("error"),
    )


Evaluator = Callable[[DataFrame, DataFrame], DataFrame]


def run_matching(
    jobs: DataFrame,
    profiles: DataFrame,
    stored: DataFrame,
    observed: DataFrame | None = None,
    evaluator: Evaluator = local_scores,
    responses: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One matching run: active (and, if given, observed) jobs without a stored result are
    scored, external answers are taken in. Returns the new results and the run's counts."""
    candidates = matchable_jobs(jobs, observed)
    results = evaluator(match_cache_misses(candidates, profiles, stored), profiles)
    if responses is not None:
        results = merge_evaluations(results, responses)
    ready = attach_profile(candidates.select("job_id"), profiles).select("job_id")
    return results, match_summary(ready, results)
