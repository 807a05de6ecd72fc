"""The registered queries of these operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import clustering, common, hard_negatives, langid, language_model, mixing, near_dup, packing, quality_classifier, quality_rules, secrets, sharding, topk_search, toxicity
from querent.sources.files import scan_parquet


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of a bounded-load hash ring; a null text has size 1 and crc32 0."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = common.documents(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    made = sharding.shard_by_ring(rows, "doc_id", shards=8)
    return made.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def op2_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(common.documents(spark, sf_dir))


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = scan_parquet(spark, f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, toxicity.learned_labels(labels))
    held_out = (common.fold(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = toxicity.score_toxicity(docs.select("doc_id", held_out, "text"), model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", "held_out", "score", predicted)


def op4_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = langid.fit_language_id(langid.learned_rows(docs))
    held_out = (common.fold(F.col("doc_id"), 5) == 0).alias("held_out")
    found = langid.identify(docs.select("doc_id", held_out, "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_outliers(common.documents(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "distance")


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicate_classes(common.documents(spark, sf_dir))


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    labels = scan_parquet(spark, f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit_quality(docs, quality_classifier.learned_quality(labels))
    held_out = (common.fold(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = quality_classifier.score_quality(docs, model)
    return scored.select("doc_id", held_out, "text_score", "metadata_score", "score", "keep")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.draw_mix(common.documents(spark, sf_dir)))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scan_parquet(spark, f"{sf_dir}/embeddings.parquet")
    items = topk_search.quantised(vectors, "vec_id", "embedding")
    return topk_search.exact_topk(items, items.filter(F.col("id") % 20 == 0), 20)


def op11_ptolemaic_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clustering.kept_vectors(scan_parquet(spark, f"{sf_dir}/embeddings.parquet"))
    made = clustering.cluster_report(vectors)
    return made.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(common.documents(spark, sf_dir))


def op13_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.mined_rows(scan_parquet(spark, f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mine_hard_negatives(rows)


QUERIES = {
    "op1_ring_shards": op1_ring_shards,
    "op2_maxent_scores": op2_maxent_scores,
    "op3_weak_toxicity": op3_weak_toxicity,
    "op4_centroid_language": op4_centroid_language,
    "op5_robust_quality": op5_robust_quality,
    "op6_probminhash": op6_probminhash,
    "op7_cotrained_quality": op7_cotrained_quality,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_source_mix": op9_source_mix,
    "op10_exact_topk": op10_exact_topk,
    "op11_ptolemaic_kmeans": op11_ptolemaic_kmeans,
    "op12_owned_secrets": op12_owned_secrets,
    "op13_segment_negatives": op13_segment_negatives,
}

ORACLES = {
    "op10_exact_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}


def _kmeans_sql(rounds: int = 3, k: int = 16) -> str:
    """k-means in DuckDB SQL: one assignment and one update a round, then a last assignment."""

    def assign(n: int) -> str:
        return f"""a{n} AS (
  SELECT vec_id, v, cluster, d FROM (
    SELECT v.vec_id, v.v, c.cluster,
           list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))::BIGINT AS d
    FROM v, c{n} c
  ) QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, cluster) = 1
)"""

    def update(n: int) -> str:
        return f"""s{n} AS (
  SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{n}, range(1, 65) t(i) GROUP BY cluster, i
), c{n + 1} AS (
  SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY cluster
  ) m USING (cluster)
)"""

    parts = [
        """v AS (
  SELECT DISTINCT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
)""",
        f"""c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1)::INT AS cluster, v AS c
  FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) <= {k}
)""",
    ]
    for n in range(rounds):
        parts += [assign(n), update(n)]
    parts.append(assign(rounds))
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
by_cluster AS (
  SELECT c.cluster, coalesce(sum(a.d), 0)::BIGINT AS cluster_inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
  FROM c{rounds} c LEFT JOIN a{rounds} a USING (cluster) GROUP BY c.cluster, c.c
)
SELECT a.vec_id, a.cluster, a.d AS distance, b.cluster_inertia, b.inertia, b.centroid_sha256
FROM a{rounds} a JOIN (SELECT *, (sum(cluster_inertia) OVER ())::BIGINT AS inertia FROM by_cluster) b USING (cluster)
"""
    )


ORACLES["op11_ptolemaic_kmeans"] = _kmeans_sql()

ORACLES["op13_segment_negatives"] = """
WITH r AS (
  SELECT DISTINCT vec_id::BIGINT AS vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
         list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
  WHERE a.vec_id % 50 = 0
), pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), neg AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT *, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank
  FROM neg
) WHERE rank <= 3
"""
