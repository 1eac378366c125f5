"""One query per operator over its whole table, and the SQL that must agree where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import (
    ann,
    centroids,
    common,
    embedding_dedup,
    mixing,
    packing,
    pii,
    quality,
    runs,
    sharding,
    simhash,
    substring,
    url_filter,
    warc,
)

SHARDS, MIX_WEIGHTS, MIX_EPOCHS, SEED = 8, (1, 2, 3), 3, 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multiprobe_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda id_: id_ % 50 == 0, k=5)


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.columns_of(_table(spark, sf_dir, "documents"), doc_id="long", text="string")
    text = F.coalesce("text", F.lit(""))
    digest = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    sharded = sharding.shard_rows(digest, SHARDS, seed=SEED)
    return sharded.withColumn("grown_shard", F.lit(None).cast("int"))


def op3_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_EPOCHS, SEED)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS ord
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([{", ".join(map(str, MIX_WEIGHTS))}])[((ord - 1) % {len(MIX_WEIGHTS)} + 1)::INT] AS weight,
         {MIX_EPOCHS} * source_size AS most
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN most > weight * level
              THEN weight * first(CASE WHEN most > weight * level THEN level END IGNORE NULLS) OVER walk
              ELSE most END::DOUBLE AS target
  FROM levels
  WINDOW walk AS (ORDER BY most / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         (floor(t.target + 0.5)::BIGINT // greatest(t.source_size, 1)) AS whole,
         (floor(t.target + 0.5)::BIGINT % greatest(t.source_size, 1)) AS rest,
         coalesce(sum(d.size) OVER (
           PARTITION BY d.source
           ORDER BY ('0x' || md5('{SEED}:' || d.doc_id::VARCHAR)[1:15])::BIGINT, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""


def op4_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.records(_table(spark, sf_dir, "pages"))
    path = f"{common.temporary_folder(spark)}/archives"
    warc.write_archives(records, path)
    rows = warc.read_archives(spark, path)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.LEAST_REVISIT_BYTES} AND page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.LEAST_REVISIT_BYTES} AND page_id > first_page THEN first_page END AS refers_to
FROM firsts
"""


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymised(_table(spark, sf_dir, "documents"))
    kinds = [_count_of(kind) for kind in pii.PATTERNS]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kinds)


def _count_of(kind: str):
    return F.size(F.filter("found", lambda k: k == kind)).cast("long").alias(f"n_{kind}")


def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.columns_of(_table(spark, sf_dir, "documents"), doc_id="long", text="string")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    rows = quality.scored(docs, model)
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, lanes=1, segments=5, most=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.95)


def op9_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.without_repeats(_table(spark, sf_dir, "documents"), window=50)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")), seed=SEED)


def op11_markov_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.columns_of(_table(spark, sf_dir, "pages"), page_id="long", url="string")
    return url_filter.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def _op11_sql() -> str:
    """The models level by level: windows of ORDER + 1 symbols as hexadecimal text."""
    order = url_filter.ORDER
    fits, verdicts = [], []
    for verdict, host, path in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])):
        when = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        fits.append(f"{when} THEN '{host}{path}'")
        verdicts.append(f"{when} THEN '{verdict}'")
    levels = []
    for j in range(order + 1):
        before = f"p{j - 1}" if j else "(SELECT '' AS w, 1 / 256.0::DOUBLE AS pa, 1 / 256.0::DOUBLE AS pr)"
        levels.append(f"""
l{j} AS (SELECT right(w, {2 * j + 2}) AS w, sum(a) AS a, sum(r) AS r FROM grams GROUP BY ALL),
c{j} AS (SELECT *, sum(a) OVER c AS na, sum((a > 0)::INT) OVER c AS ta, sum(r) OVER c AS nr, sum((r > 0)::INT) OVER c AS tr
  FROM l{j} WINDOW c AS (PARTITION BY left(w, {2 * j}))),
p{j} AS (SELECT c.w, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
    CASE WHEN nr > 0 THEN (r + tr * pr) / (nr + tr) ELSE pr END AS pr
  FROM c{j} c JOIN {before} s ON s.w = right(c.w, {2 * j}))""")
    return rf"""
WITH raw AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_filter._UPPER}', '{url_filter._LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), told AS (
  SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule, CASE {' '.join(verdicts)} END AS judged,
         CASE WHEN url IS NULL THEN '' WHEN strpos(url, '://') = 0 THEN url
              ELSE host || regexp_extract(url, '(?s)://[^/?#]*(.*)', 1) END AS text
  FROM raw
), texts AS (
  SELECT text, judged, count(*) AS n, ('0x' || md5(text)[1:15])::BIGINT % {url_filter.CALIBRATION} = 0 AS held,
         '{'FE' * order}' || hex(encode(text)) || 'FF' AS symbols
  FROM told GROUP BY text, judged
), windows AS (
  SELECT text, judged, n, held, substr(symbols, 2 * unnest(range(1, len(symbols) // 2 - {order} + 1)) - 1, {2 * order + 2}) AS w FROM texts
), grams AS (
  SELECT w, sum(CASE WHEN judged = 'allow' AND NOT held THEN n ELSE 0 END) AS a,
         sum(CASE WHEN judged = 'block' AND NOT held THEN n ELSE 0 END) AS r
  FROM windows GROUP BY w
), {','.join(levels)},
ratios AS (SELECT w, floor((ln(pa) - ln(pr)) * 1e6 + 0.5)::BIGINT AS ratio FROM p{order}),
scores AS (
  SELECT text, judged, n, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score
  FROM windows JOIN ratios USING (w) WHERE judged IS NULL OR held GROUP BY text, judged, n
), buckets AS (
  SELECT floor(score / 1000.0)::BIGINT AS bucket, sum(CASE WHEN judged = 'allow' THEN n ELSE 0 END) AS good,
         sum(CASE WHEN judged = 'block' THEN n ELSE 0 END) AS bad
  FROM scores WHERE judged IS NOT NULL GROUP BY 1
), walked AS (
  SELECT greatest(lag(bucket) OVER (ORDER BY bucket) + 1, least(0, bucket)) AS least, sum(good) OVER () AS goods, sum(bad) OVER () AS bads,
         coalesce(sum(good) OVER before, 0) AS lost, coalesce(sum(bad) OVER before, 0) AS stopped
  FROM buckets WINDOW before AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), least AS (
  SELECT coalesce((SELECT least FROM walked WHERE goods > 0 AND bads > 0
    ORDER BY (goods - lost)::DOUBLE / goods + stopped::DOUBLE / bads DESC, abs(least), least LIMIT 1), 0) AS least
)
SELECT t.page_id, t.host, t.path, t.rule,
       coalesce(t.judged, CASE WHEN floor(s.score / 1000.0) >= least THEN 'allow' ELSE 'block' END) AS verdict
FROM told t LEFT JOIN scores s ON s.text = t.text AND s.judged IS NULL AND t.judged IS NULL CROSS JOIN least
"""


def op12_threshold_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.clustered(_table(spark, sf_dir, "embeddings"))
    return rows.drop("centroid")


def _op12_sql() -> str:
    """Every vector against every centroid, round after round."""
    count, components = centroids.CENTROIDS, centroids.COMPONENTS
    rounds = []
    for r in range(centroids.ROUNDS + 1):
        rounds.append(f"""
a{r} AS (
  SELECT id, arg_min(c, distance * {count} + c) AS c, min(distance) AS distance
  FROM (SELECT k.id, m.c, list_sum(list_transform(range(1, {components + 1}), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))::BIGINT AS distance
        FROM kept k, m{r} m) GROUP BY id
)""")
        if r < centroids.ROUNDS:
            rounds.append(f"""
s{r} AS (
  SELECT c, list(mean ORDER BY i) AS v
  FROM (SELECT a.c, i, floor(sum(k.v[i])::DOUBLE / count(*))::BIGINT AS mean
        FROM a{r} a JOIN kept k USING (id), range(1, {components + 1}) t(i) GROUP BY a.c, i) GROUP BY c
), m{r + 1} AS (SELECT m.c, coalesce(s.v, m.v) AS v FROM m{r} m LEFT JOIN s{r} s USING (c))""")
    last = centroids.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), m0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
  ORDER BY c LIMIT {count}
), {','.join(rounds)},
hashes AS (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM m{last})
SELECT k.vec_id, a.c::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{last} a JOIN kept k USING (id) JOIN hashes h USING (c)
"""


def op13_baier_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.periodic_runs(runs.with_planted_periods(_table(spark, sf_dir, "documents")))
    collapsed = F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256")
    return rows.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", collapsed)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_multiprobe_hashing": (op1_multiprobe_hashing, None),
    "op2_hypergeometric_shards": (op2_hypergeometric_shards, None),
    "op3_water_filling": (op3_water_filling, OP3_SQL),
    "op4_warc_records": (op4_warc_records, OP4_SQL),
    "op5_feistel_pseudonyms": (op5_feistel_pseudonyms, None),
    "op6_nbsvm_quality": (op6_nbsvm_quality, None),
    "op7_simhash_pigeonring": (op7_simhash_pigeonring, None),
    "op8_nn_descent": (op8_nn_descent, None),
    "op9_suffix_automata": (op9_suffix_automata, None),
    "op10_exact_complement_packing": (op10_exact_complement_packing, None),
    "op11_markov_url_filter": (op11_markov_url_filter, _op11_sql()),
    "op12_threshold_centroids": (op12_threshold_centroids, _op12_sql()),
    "op13_baier_runs": (op13_baier_runs, None),
}
