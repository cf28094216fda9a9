"""Catalogue: vectors, prototypes, k nearest references and the two-stage decision.

The embeddings table stands for projected vectors: label 0 is clean. Prototypes are made of all vectors and meet
all of them; searches take the stated query set, ids divisible by 100, against all other vectors.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.functions import vectors
from siltmark.operators import decide, localize, metrics, similarity, training
from siltmark.plans.evaluation import midrank, rounded, scored
from siltmark.plans.registry import query
from siltmark.session import spread, table


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def references(spark: SparkSession, sf: str) -> DataFrame:
    return embedded(spark, sf)


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of searches."""
    return embedded(spark, sf).where("id % 100 = 0")


EMB = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), u AS (SELECT id, label, list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))) AS z FROM e),
p AS (SELECT label, i, avg(z[i]) AS m FROM u, range(1, 65) r(i) GROUP BY 1, 2), c0 AS (SELECT label AS proto, list(m ORDER BY i) AS m FROM p GROUP BY 1), c AS (SELECT proto, list_transform(m, lambda q: q / sqrt(list_dot_product(m, m))) AS vec FROM c0),
j AS (SELECT u.id, u.label, proto, list_dot_product(z, vec) AS cosine FROM u, c)"""


@query("centroid", f"WITH {EMB} SELECT proto AS label, round(vec[1], 6) AS first, round(vec[64], 6) AS last FROM c")
def centroid(spark, sf):
    made = similarity.centroids(references(spark, sf), ["label"], "embedding")
    return made.select("label", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[63], 6).alias("last"))


def gate_scores(spark: SparkSession, sf: str) -> DataFrame:
    clean = similarity.centroids(references(spark, sf).where("label = 0"), [], "embedding").select(F.lit(0).alias("proto"), "vec")
    joined = similarity.cosine_join(embedded(spark, sf), clean, "embedding")
    return joined.select("id", (F.col("label") != 0).cast("int").alias("y"), (1 - F.col("cosine")).alias("s"))


@query("centroid_gate", f"WITH {EMB}, g AS (SELECT CAST(label <> 0 AS INTEGER) AS y, 1 - cosine AS s FROM j WHERE proto = 0) {midrank('g')}")
def centroid_gate(spark, sf):
    return rounded(metrics.auroc(gate_scores(spark, sf)).select("auroc"), "auroc")


@query("cosine_join", f"WITH {EMB} SELECT id, proto, round(cosine, 6) AS cosine FROM j")
def cosine_join(spark, sf):
    prototypes = similarity.centroids(references(spark, sf), ["label"], "embedding").select(F.col("label").alias("proto"), "vec")
    return similarity.cosine_join(embedded(spark, sf), prototypes, "embedding").select("id", "proto", F.round("cosine", 6).alias("cosine"))


@query("nearest_centroid", f"WITH {EMB} SELECT id, label, proto, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, proto) AS r FROM j) WHERE r = 1")
def nearest_centroid(spark, sf):
    prototypes = similarity.centroids(references(spark, sf), ["label"], "embedding").select(F.col("label").alias("proto"), "vec")
    joined = similarity.cosine_join(embedded(spark, sf), prototypes, "embedding")
    return similarity.nearest_prototype(joined, "id", "proto", ["label"]).withColumn("cosine", F.round("cosine", 6))


KNN = "k AS (SELECT a.id AS q_id, b.label AS class, b.id AS r_id, list_dot_product(a.z, b.z) AS cosine FROM u a, u b WHERE a.id % 100 = 0 AND a.id <> b.id)"


@query("knn_join", f"WITH {EMB}, {KNN} SELECT q_id, r_id, round(cosine, 6) AS cosine, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cosine, 12) DESC, r_id) AS r FROM k) WHERE r <= 5")
def knn_join(spark, sf):
    return similarity.nearest_references(asked(spark, sf), references(spark, sf), "embedding", 5).withColumn("cosine", F.round("cosine", 6))


@query("knn_gate", f"WITH {EMB}, {KNN} SELECT q_id, round(1 - avg(cosine), 6) AS s, CAST(count(*) AS BIGINT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(cosine, 12) DESC, r_id) AS r FROM k WHERE class = 0) WHERE r <= 5 GROUP BY 1")
def knn_gate(spark, sf):
    near = similarity.nearest_references(asked(spark, sf), references(spark, sf).where("label = 0"), "embedding", 5)
    return rounded(similarity.knn_score(near), "s")


@query("knn_category", f"WITH {EMB}, {KNN}, m AS (SELECT q_id, class, avg(cosine) AS c FROM (SELECT *, row_number() OVER (PARTITION BY q_id, class ORDER BY round(cosine, 12) DESC, r_id) AS r FROM k) WHERE r <= 3 GROUP BY 1, 2) SELECT q_id, CAST(class AS BIGINT) AS predicted, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(c, 12) DESC, class) AS r FROM m) WHERE r = 1")
def knn_category(spark, sf):
    near = similarity.nearest_references(asked(spark, sf), references(spark, sf), "embedding", 3, by_class="label")
    return rounded(similarity.knn_class(near), "cosine")


@query("two_stage", f"WITH {EMB}, g AS (SELECT id, 1 - cosine AS s FROM j WHERE proto = 0), b AS (SELECT id, proto FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, proto) AS r FROM j WHERE proto <> 0) WHERE r = 1) SELECT id, CASE WHEN s > 0.95 THEN proto ELSE 0 END AS decision FROM g JOIN b USING (id)")
def two_stage(spark, sf):
    prototypes = similarity.centroids(references(spark, sf), ["label"], "embedding").select(F.col("label").alias("proto"), "vec")
    errors = similarity.cosine_join(embedded(spark, sf), prototypes.where("proto <> 0"), "embedding")
    named = similarity.nearest_prototype(errors, "id", "proto", []).select("id", "proto")
    return gate_scores(spark, sf).join(named, "id").select("id", F.when(F.col("s") > 0.95, F.col("proto")).otherwise(0).alias("decision"))


@query("pair_losses", """WITH e AS (SELECT vec_id AS id, vec_id // 50 AS batch, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), u AS (SELECT id, batch, label, list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))) AS z FROM e),
p AS (SELECT a.batch, a.id, list_dot_product(a.z, b.z) AS sim, list_distance(a.z, b.z) AS d, a.label = b.label AS same FROM u a JOIN u b ON a.batch = b.batch AND a.id <> b.id),
n AS (SELECT batch, id, ln(sum(exp(sim / 0.1 - 10)) + 1e-12) AS lse, avg(sim / 0.1 - 10) FILTER (WHERE same) AS pos, max(d) FILTER (WHERE same) AS hp, min(d) FILTER (WHERE NOT same) AS hn FROM p GROUP BY 1, 2)
SELECT batch, round(coalesce(avg(lse - pos), 0), 5) AS supcon, round(coalesce(avg(greatest(hp - hn + 0.5, 0)) FILTER (WHERE hp IS NOT NULL AND hn IS NOT NULL), 0), 5) AS triplet FROM n GROUP BY 1""")
def pair_losses(spark, sf):
    batch = embedded(spark, sf).withColumn("batch", F.floor(F.col("id") / 50))
    return similarity.pair_losses(batch, "embedding", "label", "batch").select("batch", F.round("supcon", 5).alias("supcon"), F.round("triplet", 5).alias("triplet"))


@query("pair_features", "SELECT a.vec_id AS id, round(list_aggregate(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: abs(p[1] - p[2])), 'sum'), 5) AS l1, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_features(spark, sf):
    a = embedded(spark, sf).select("id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    pairs = a.join(a.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id").withColumn("f", vectors.pair_features(F.col("a"), F.col("b")))
    total = lambda low: F.round(F.aggregate(F.slice("f", low, 64), F.lit(0.0), lambda s, x: s + x), 5)
    return pairs.select("id", total(129).alias("l1"), total(193).alias("product"))


@query("l2_normalize", "SELECT vec_id, round(CAST(emb[1] AS DOUBLE) / sqrt(list_dot_product(CAST(emb AS DOUBLE[]), CAST(emb AS DOUBLE[]))), 6) AS first FROM emb_cache WHERE len(emb) = 384 AND list_aggregate(list_transform(CAST(emb AS DOUBLE[]), lambda q: CAST(isnan(q) AS INTEGER)), 'sum') = 0 AND list_dot_product(CAST(emb AS DOUBLE[]), CAST(emb AS DOUBLE[])) > 0")
def l2_normalize(spark, sf):
    rows = spread(table(spark, sf, "emb_cache").select("vec_id", "emb")).where("size(emb) = 384").where(~F.exists("emb", lambda x: x.isNull() | F.isnan(x))).where(vectors.norm(F.col("emb")) > 0)
    return rows.select("vec_id", F.round(F.element_at(vectors.unit(F.col("emb")), 1), 6).alias("first"))


@query("kmeans_prototypes")
def kmeans_prototypes(spark, sf):
    """Three prototypes of the clean references: the best of several seeded starts, scaled to length 1."""
    data = references(spark, sf).where("label = 0").select(array_to_vector(vectors.unit(F.col("embedding"))).alias("features"))
    models = [KMeans(k=3, seed=seed, maxIter=50).fit(data) for seed in range(3)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(best.clusterCenters())]  # three vectors
    return spark.createDataFrame(rows, "proto int, vec array<double>").withColumn("vec", vectors.unit(F.col("vec")))


@query("logreg_fusion")
def logreg_fusion(spark, sf):
    """Fused probabilities of the rows that the coefficients were fitted on."""
    rows = scored(spark, sf).withColumn("aux", F.col("k") / F.lit(100.0))
    (c0, c1), bias = decide.logistic_fit(rows, ["s", "aux"], "y")
    return rows.select("id", "y", F.round(decide.fused(F.col("s"), F.col("aux"), c0, c1, bias), 6).alias("p"))


@query("head_out_of_fold")
def head_out_of_fold(spark, sf):
    """Out-of-fold error scores of the projection head; groups of ten vectors stay together."""
    rows = embedded(spark, sf).withColumns({"class": F.least(F.col("label"), F.lit(4)).cast("int"), "grp": F.floor(F.col("id") / 10)})
    scored_rows = training.out_of_fold(rows, "embedding", "class", "grp", 3, training.HeadConfig(hidden=32, out=16, epochs=8))
    return scored_rows.select("id", "class", "fold", F.round("aux_err", 6).alias("aux_err"))


PATCH = """d AS (SELECT q_id, sqrt(greatest(2 - 2 * max(cosine), 0)) AS distance FROM (SELECT a.id AS q_id, list_dot_product(a.z, b.z) AS cosine FROM u a, u b WHERE a.id % 100 = 0 AND a.id <> b.id AND b.label = 0) GROUP BY 1),
o AS (SELECT sqrt(greatest(2 - 2 * max(list_dot_product(a.z, b.z)), 0)) AS distance FROM u a, u b WHERE a.label = 0 AND b.label = 0 AND a.id <> b.id GROUP BY a.id),
cal AS (SELECT quantile_cont(distance, 0.5) AS p50, quantile_cont(distance, 0.995) AS p995 FROM o), sc AS (SELECT q_id, least(greatest((distance - p50) / (p995 - p50), 0), 1) AS score FROM d, cal)"""


@query("patch_anomaly", f"WITH {EMB}, {PATCH} SELECT q_id, round(score, 5) AS score FROM sc")
def patch_anomaly(spark, sf):
    scores = localize.anomaly(asked(spark, sf), references(spark, sf).where("label = 0"), "embedding")
    return scores.withColumn("score", F.round("score", 5))


@query("image_score", f"WITH {EMB}, {PATCH}, r AS (SELECT q_id // 40 AS image, score, row_number() OVER (PARTITION BY q_id // 40 ORDER BY score DESC, q_id) AS r, count(*) OVER (PARTITION BY q_id // 40) AS n FROM sc) SELECT image, round(avg(score), 5) AS score FROM r WHERE r <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) GROUP BY 1")
def image_score(spark, sf):
    scores = localize.anomaly(asked(spark, sf), references(spark, sf).where("label = 0"), "embedding").withColumn("image", F.floor(F.col("q_id") / 40))
    return localize.image_score(scores, "image", 0.1).withColumn("score", F.round("score", 5))
