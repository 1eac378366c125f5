"""URL filter: rules against a plain form, models against a plain form, SQL, awkward rows."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.sql import differences
from vacancyledger.llm import url_filter
from vacancyledger.llm.queries import QUERIES

KINDS = "page_id long, url string, html string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def plain_rule(host, path):
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def plain_chance(counts, context, symbol):
    """Witten-Bell, from the shortest context up."""
    chance = 1 / 256
    for j in range(len(context) + 1):
        follow = counts[context[len(context) - j :]]
        n, t = sum(follow.values()), len(follow)
        if n:
            chance = (follow[symbol] + t * chance) / (n + t)
    return chance


URLS = [
    "http://a.org/x", "https://A.ORG/x?q=1", "http://example.org/es/1", "http://www.example.org/es/", "http://example.org/en/12",
    "http://notexample.org/es/", "http://b.com/fr/1", "http://b.com/de/1", "http://com/de/", "http://a.org", "http://a.org?/x",
    "http://b.net/en/1#x/y", "http://ÄB.org/é", "no scheme", "http://", "x://y://z.org/", "http://a.org:80/x", "http://u@a.org/fr/", "", None,
]


def test_rules_and_parts(spark):
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], KINDS)
    got = {r.page_id: r for r in url_filter.judged(rows).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
        assert (got[i].score is None) == (verdict is not None)


def test_scores_equal_plain_models(spark):
    """Every score that is left after the rules, from counts kept in dictionaries."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = url_filter.judged(pages).select("*", url_filter.model_text(F.col("url")).alias("text"))
    rows = rows.withColumn("held", F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long") % 5 == 0).collect()
    models = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    order = url_filter.ORDER
    for r in rows:
        if r.rule and not r.held:
            symbols = b"\xfe" * order + r.text.encode() + b"\xff"
            for at in range(order, len(symbols)):
                for j in range(order + 1):
                    models[r.verdict][symbols[at - j : at]][symbols[at]] += 1
    checked = 0
    for r in rows:
        if not r.rule:
            symbols = b"\xfe" * order + r.text.encode() + b"\xff"
            ratio = [
                math.log(plain_chance(models["allow"], symbols[at - order : at], symbols[at]))
                - math.log(plain_chance(models["block"], symbols[at - order : at], symbols[at]))
                for at in range(order, len(symbols))
            ]
            assert r.score == pytest.approx(1e6 * sum(ratio) / len(ratio), abs=2)
            checked += 1
    assert checked > 100


def test_models_tell_what_rules_told(spark):
    """URLs of the rules' own kinds that the models never saw are judged as the rules would."""
    rows = [(i, f"http://host{i % 7}.example.{'org' if i % 2 else 'com'}/{'en' if i % 2 else 'de'}/{2000 + i}", None) for i in range(400)]
    rows += [(1000 + i, f"http://host{i % 7}.example.net/{'en' if i % 2 else 'de'}/{7000 + i}", None) for i in range(60)]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, KINDS)).collect()}
    assert all(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(60))


def test_threshold(spark):
    def best(rows):
        return url_filter.threshold(spark.createDataFrame(rows, "score long, judged string, n long"))

    assert best([(-3000, "block", 1), (2500, "allow", 1), (-10, "block", 1)]) == 0
    assert best([(-3000, "allow", 1), (-7500, "block", 1)]) == -3
    assert best([(3000, "block", 1), (7500, "allow", 1)]) == 4
    assert best([(-3000, "block", 1)]) == 0
    assert best([(5000, "block", 9), (4000, "allow", 1), (9000, "allow", 3)]) == 6


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, folder):
    plan, sql = QUERIES["op11_markov_url_filter"]
    assert differences(plan(spark, f"/root/testdata/{folder}"), sql, f"/root/testdata/{folder}") is None


def test_awkward_rows(spark):
    rows = [(1, u, "h") for u in URLS] * 3 + [(None, None, None), (None, "http://" + "x" * 200_000 + ".net/", None)]
    pages = spark.createDataFrame(rows, KINDS).selectExpr("*", "7 AS score", "8 AS Host", "9 AS w", "1 AS k1", "2 AS text", "3 AS page")
    got = url_filter.judged(pages)
    assert {"score", "score_input", "host", "Host_input", "text", "page"} <= set(got.columns)
    counted = Counter((r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect())
    assert sum(counted.values()) == len(rows)
    assert len({key[0] for key in counted}) == len(counted), "equal URLs, equal verdicts"
    kept = url_filter.accepted(pages)
    assert kept.columns == pages.columns and kept.count() == got.filter("verdict = 'allow'").count()
    assert url_filter.judged(spark.createDataFrame([], KINDS)).count() == 0
    lone = url_filter.judged(spark.createDataFrame([(1, None, None), (2, "http://a.net/", None)], KINDS)).collect()
    assert [r.score for r in lone] == [0, 0] and {r.verdict for r in lone} == {"allow"}
