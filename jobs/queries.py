"""The jobs as registered queries: run twice over the whole tables into a new folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.plans import catalog
from driftline.session import fresh_path
from jobs import ingest, round_scores


def job1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fresh_path(spark, "job1-ingest")
    for _ in range(2):
        # a pattern, as the table may be one file, and streams read folders
        ingest.ingest(spark, f"{sf_dir}/documents.parque[t]", f"{base}/corpus", f"{base}/state")
    return ingest.read_corpus(spark, f"{base}/corpus")


def job2_round_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fresh_path(spark, "job2-round-scores")
    for _ in range(2):
        round_scores.round_scores(spark, f"{sf_dir}/conversations.parquet", f"{sf_dir}/documents.parquet", f"{base}/scores")
    return round_scores.read_scores(spark, f"{base}/scores")


QUERIES = {"job1_ingest": job1_ingest, "job2_round_scores": job2_round_scores}

_GOOD = catalog._CASCADE.replace("k <= 3", "k <= 4")
ORACLE = {
    "job1_ingest": catalog._QUALIFIED + """
SELECT DISTINCT sha256(text) AS content_sha256, source, text, word_count, length(text)::BIGINT AS n_chars, substr(sha256(text), 1, 1) AS shard FROM qualified
""",
    "job2_round_scores": catalog.b.SQL + _GOOD + f""",
gs AS (SELECT 0 AS k, pair_id, text FROM drafts UNION ALL SELECT k, pair_id, text FROM ex WHERE NOT hard_tripped),
rr AS (SELECT gs.k, gs.pair_id, gs.text, reference_text FROM gs JOIN pairs USING (pair_id)),
st AS (SELECT k, 'a' AS side, pair_id, text FROM rr UNION ALL SELECT k, 'b', pair_id, reference_text FROM rr)
""" + catalog._l2("st", "k") + f""",
kn AS (SELECT k, count(*) AS n FROM rr GROUP BY k),
ev AS (SELECT k, side, side || pair_id AS id, {catalog._EMB} AS x FROM st),
kd AS (SELECT p.k, p.side AS sa, q.side AS sb, exp(-list_sum(list_transform(range(1, 9), lambda i: (p.x[i] - q.x[i]) * (p.x[i] - q.x[i]))) / 2) AS kv FROM ev p JOIN ev q ON p.k = q.k AND p.id < q.id),
ks AS (SELECT k, sum(kv) FILTER (WHERE sa = 'a' AND sb = 'a') AS aa, sum(kv) FILTER (WHERE sa = 'b' AND sb = 'b') AS bb, sum(kv) FILTER (WHERE sa <> sb) AS ab FROM kd GROUP BY k),
vt AS (SELECT k, pair_id, dimension, {catalog._ORDER} AS "order", {catalog._REPLY.format(f"'{catalog.SEED}:' || k || ':' || pair_id || ':' || dimension")} AS raw FROM rr, {catalog._DIMS}),
vc AS (SELECT *, {catalog.sub(catalog._CHOICE, "raw")} AS choice FROM vt), vw AS (SELECT *, {catalog._WON} AS won FROM vc)
SELECT k::INTEGER AS k, metric, round(value, 9) AS value, n::BIGINT AS n FROM (
  SELECT k, 'pairs' AS metric, n::DOUBLE AS value, n FROM kn
  UNION ALL SELECT k, 'token_l2', token_l2, n FROM l2 JOIN kn USING (k)
  UNION ALL SELECT k, 'mmd2', CASE WHEN n > 1 THEN 2 * coalesce(aa, 0) / (n * (n - 1)) + 2 * coalesce(bb, 0) / (n * (n - 1)) - 2 * coalesce(ab, 0) / (n * n)::DOUBLE END, n FROM kn LEFT JOIN ks USING (k)
  UNION ALL SELECT k, 'jmq_' || dimension, 2 * count_if(won) / nullif(count(won), 0)::DOUBLE, count(won) FROM vw GROUP BY k, dimension
  UNION ALL SELECT k, 'detector_mean', avg(('0x' || substr(md5(text), 1, 8))::BIGINT / 4294967296.0::DOUBLE), count(*) FROM rr GROUP BY k
  UNION ALL SELECT k, 'degenerate_share', count_if(hard_tripped) / count(*)::DOUBLE, count(*) FROM ex GROUP BY k
)
""",
}
