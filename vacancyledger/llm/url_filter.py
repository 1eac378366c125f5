"""URL filters: host and path rules, and for the rest a ratio of two character language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, written

#: (verdict, host, path); a rule holds for its host and all subdomains where the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Symbols of context that the models look back at most. A window is a context and the symbol after it.
ORDER = 5
#: One in so many of the URLs that a rule judges is kept from the models and sets the threshold.
CALIBRATION = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, and from there up to ``?``, ``#`` or the end."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        told = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, told).otherwise(found)
    return found


def model_text(url: F.Column) -> F.Column:
    """What the models read: what follows the scheme, the host in lower case; null as empty."""
    rest = F.regexp_extract(url, "(?s)://[^/?#]*(.*)", 1)
    whole = F.when(F.instr(url, "://") == 0, url).otherwise(F.concat(host_and_path(url)[0], rest))
    return F.coalesce(whole, F.lit(""))


def _windows(texts: DataFrame, *kept: str, order: int) -> DataFrame:
    """``kept`` and ``w``, one row per symbol of ``symbols``: it and the ``order`` symbols before it as a number."""
    symbol = lambda i: F.conv(F.hex(F.substring(F.col("symbols"), i, F.lit(order + 1))), 16, 10).cast("long")
    places = F.sequence(F.lit(1), F.octet_length("symbols") - order)
    return texts.select(*kept, F.explode(F.transform(places, symbol)).alias("w"))


def window_ratios(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, ratio): per window of ``texts``, a million times the logarithm of its last symbol's chance after
    accepted contexts over that after rejected ones, rounded.

    ``texts`` holds ``symbols``, ``accepted`` and ``rejected`` (how often its text counts for either
    model). A symbol's chance after a context of j symbols is blended with that after the last j - 1
    of them, and so on down to one in 256 (Witten and Bell): the weight of the longer context is n
    to t, with n its occurrences and t the number of different symbols that followed; a context that
    a model never met has no weight, so its order varies with what was seen. All windows are counted,
    whatever their number: tables of windows are joined by keys that at most 256 windows share.
    """
    levels = [written(_windows(texts, "accepted", "rejected", order=order).groupBy("w").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")), "windows")]
    for j in range(order - 1, -1, -1):  # the last j + 1 symbols of the windows before
        shorter = levels[0].withColumn("w", F.col("w").bitwiseAND((1 << 8 * (j + 1)) - 1))
        levels.insert(0, written(shorter.groupBy("w").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "windows"))
    chances = None
    for j, level in enumerate(levels):
        context = Window.partitionBy(F.shiftright("w", 8))
        rows = level
        for c in "ar":
            rows = rows.withColumn(f"n_{c}", F.sum(c).over(context)).withColumn(f"t_{c}", F.sum(F.signum(c)).over(context))
        if chances is None:
            rows = rows.withColumn("p_a", F.lit(1 / 256)).withColumn("p_r", F.lit(1 / 256))
        else:
            rows = rows.withColumn("_s", F.col("w").bitwiseAND((1 << 8 * j) - 1))
            rows = rows.join(chances.withColumnRenamed("w", "_w"), F.col("_s") == F.col("_w"))
        blended = [
            F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
            .otherwise(F.col(f"p_{c}")).alias(f"p_{c}")
            for c in "ar"
        ]
        chances = rows.select("w", *blended)
    return chances.select("w", F.floor((F.log("p_a") - F.log("p_r")) * 1e6 + 0.5).cast("long").alias("ratio"))


def threshold(scores: DataFrame) -> int:
    """The score, in thousandths, from which on URLs are best accepted.

    ``scores`` holds ``score`` (millionths), ``judged`` (what the rule says) and ``n``. The share of
    accepted URLs at or above plus that of rejected ones below is the greatest; on a tie the
    threshold nearest to 0, then the smaller. 0 if the rules judge none of a kind.
    """
    bucket = F.floor(F.col("score") / 1000).cast("long")
    # As many rows as thousandths lie between the smallest and the greatest score.
    rows = scores.groupBy(bucket.alias("at")).agg(
        F.sum(F.when(F.col("judged") == "allow", F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("judged") == "block", F.col("n")).otherwise(0)).alias("bad"),
    )
    walk, everything = Window.orderBy("at"), Window.partitionBy()
    below = walk.rowsBetween(Window.unboundedPreceding, -1)
    # Thresholds from just above the bucket before up to this one tell the same URLs apart.
    lowest, zero = F.lag("at").over(walk) + 1, F.lit(0).cast("long")
    rows = rows.select(
        F.greatest(lowest, F.least(zero, "at")).alias("at"),
        F.sum("good").over(everything).alias("all_good"), F.sum("bad").over(everything).alias("all_bad"),
        F.coalesce(F.sum("good").over(below), F.lit(0)).alias("lost"), F.coalesce(F.sum("bad").over(below), F.lit(0)).alias("stopped"),
    )
    rows = rows.filter("all_good > 0 and all_bad > 0")
    right = (F.col("all_good") - F.col("lost")) / F.col("all_good") + F.col("stopped") / F.col("all_bad")
    best = rows.orderBy(F.desc(right), F.abs("at"), "at").first()
    return int(best["at"]) if best else 0


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """All columns of ``pages``, and host, path, rule, verdict and score.

    The longest rule that fits a URL decides. Where none does, two models of the URLs that rules
    accept and reject decide, every such row counting once: the mean over a URL's symbols (its bytes
    and the end) of the logarithm of their ratio of chances, against a threshold that is set on one
    in five of the texts that rules judge, which the models do not see. ``score`` is that mean in
    millionths, null where a rule decides. Null URLs and those without ``://`` have empty host and
    path, so no rule; the models read the empty text and the whole URL. If the rules judge no URL of
    a kind, scores at 0 and above pass. Texts are read whole; every distinct one is scored once, so
    repeated rows and one frequent URL or host add no work to one task, and equal URLs get equal
    verdicts. An added column's name that is taken goes to the added one, the other gets ``_input``
    after it. An empty table gives no rows.
    """
    pages = apart(pages, "host", "path", "rule", "verdict", "score")
    host, path = host_and_path(F.col("_url"))
    told = pages.select(F.struct("*").alias("page"), F.col("url").cast("string").alias("_url"))
    told = told.select("page", "_url", host.alias("host"), path.alias("path"))
    told = told.select("page", model_text(F.col("_url")).alias("text"), "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("found"))
    return _with_scores(told, order)


def _with_scores(told: DataFrame, order: int) -> DataFrame:
    identity = [F.xxhash64(F.lit(seed), "text").alias(f"k{seed}") for seed in (1, 2)]
    texts = told.groupBy("text", F.col("found.verdict").alias("judged")).agg(F.count("*").alias("n"))
    held = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long") % CALIBRATION == 0
    # No byte of UTF-8 text is FE or FF.
    symbols = F.concat(F.lit(b"\xfe" * order), F.col("text").cast("binary"), F.lit(b"\xff"))
    counted = [F.when((F.col("judged") == v) & ~held, F.col("n")).otherwise(0).alias(k) for v, k in (("allow", "accepted"), ("block", "rejected"))]
    texts = written(texts.select(*identity, "judged", "n", held.alias("held"), symbols.alias("symbols"), *counted), "texts")
    ratios = written(window_ratios(texts, order), "ratios").withColumnRenamed("w", "_w")
    wanted = _windows(texts.filter("judged is null or held"), "k1", "k2", "judged", "n", order=order)
    scores = wanted.join(ratios, F.col("w") == F.col("_w")).groupBy("k1", "k2", "judged", "n").agg(
        F.floor(F.sum("ratio") / F.count("*")).cast("long").alias("score")
    )
    scores = written(scores, "scores")
    least = threshold(scores.filter("judged is not null"))
    ruled = told.filter("found is not null").select("page.*", "host", "path", "found.*", F.lit(None).cast("long").alias("score"))
    free = told.filter("found is null").select("page", "host", "path", *identity)
    scores = scores.filter("judged is null").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "score")
    free = free.join(scores, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    verdict = F.when(F.floor(F.col("score") / 1000) >= least, "allow").otherwise("block")
    return ruled.unionByName(free.select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "score"))


def accepted(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """The rows of ``pages`` whose URL passes (see :func:`judged`), with their columns as they are."""
    rows = judged(pages.select(F.struct("*").alias("page"), "url"), rules, order)
    return rows.filter("verdict = 'allow'").select("page.*")
