"""Cosine similarity joins, k-nearest references, prototypes and centroids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siltmark.functions import vectors

#: References that one task multiplies a block of queries with.
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
#: References, as doubles, that may be sent to every task.
BANK_BYTES = 128 << 20


def centroids(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Mean of the unit vectors of each group, scaled to length 1: (by..., vec, n)."""
    parts = df.select(*by, F.posexplode(vectors.unit(F.col(vector))).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vec"), F.max("n").alias("n"))
    return whole.withColumn("vec", vectors.unit(F.col("vec")))


def cosine_join(queries: DataFrame, prototypes: DataFrame, vector: str) -> DataFrame:
    """Every query with every prototype; prototypes (id `proto`, `vec`) are one row per class."""
    return queries.join(F.broadcast(prototypes)).withColumn("cosine", vectors.cosine(F.col(vector), F.col("vec"))).drop("vec")


def category_prototypes(df: DataFrame, category: str, vector: str, k: int = 1, seed: int = 0) -> DataFrame:
    """(category, proto, vec): prototypes of every category, by k-means of its unit vectors, scaled to length 1.

    One prototype is the mean. A category of fewer than k different vectors has as many as it can; categories are the taxonomy's few.
    """
    if k == 1:
        return centroids(df, [category], vector).select(category, F.lit(0).alias("proto"), "vec")
    data = df.where(F.col(category).isNotNull()).select(category, array_to_vector(vectors.unit(F.col(vector))).alias("features"))
    rows = []
    for name, n in data.groupBy(category).agg(F.countDistinct("features").alias("n")).orderBy(category).collect():
        own = data.where(F.col(category) == name)
        if min(k, n) < 2:
            mean = own.select(Summarizer.mean(F.col("features")).alias("m")).first().m
            rows.append((name, 0, mean.toArray().tolist()))
            continue
        models = [KMeans(k=min(k, n), seed=seed + i, maxIter=50).fit(own) for i in range(3)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        rows += [(name, i, c.tolist()) for i, c in enumerate(best.clusterCenters())]
    schema = f"`{category}` {dict(df.dtypes)[category]}, proto int, vec array<double>"
    return df.sparkSession.createDataFrame(rows, schema).withColumn("vec", vectors.unit(F.col("vec")))


def contrastive_loss(pairs: DataFrame, a: str, b: str, same: str, margin: float = 1.0) -> DataFrame:
    """Mean of d squared over pairs of one class and of max(0, margin - d) squared over the others, d the distance of unit vectors."""
    d = vectors.distance(vectors.unit(F.col(a)), vectors.unit(F.col(b)))
    loss = F.when(F.col(same), d * d).otherwise(F.pow(F.greatest(F.lit(margin) - d, F.lit(0.0)), 2))
    return pairs.agg(F.avg(loss).alias("contrastive"))


def nearest_prototype(joined: DataFrame, key: str, proto: str, keep: list[str]) -> DataFrame:
    """The prototype of the largest cosine; ties go to the smaller one."""
    best = joined.groupBy(key, *keep).agg(F.max_by(F.struct(proto, "cosine"), F.struct(F.col("cosine"), -F.col(proto))).alias("b"))
    return best.select(key, *keep, F.col(f"b.{proto}").alias(proto), F.col("b.cosine").alias("cosine"))


def _pieces(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


Bank = list[tuple[int, np.ndarray, np.ndarray]]


def _bank(classes: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Bank:
    """(class, ids in order, unit vectors) of every class."""
    order = np.lexsort((ids, classes))
    classes, ids, x = classes[order], ids[order], x[order]
    edges = np.r_[np.flatnonzero(np.diff(classes, prepend=classes[:1] - 1)), len(classes)]
    return [(int(classes[a]), ids[a:b], x[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def _nearest(asked: np.ndarray, x: np.ndarray, bank: Bank, k: int) -> pd.DataFrame:
    """The k most similar other references of every query and class."""
    out = []
    for c, ids, vecs in bank if len(asked) else ():
        for low in range(0, len(asked), QUERY_ROWS):
            own = asked[low : low + QUERY_ROWS]
            s = x[low : low + QUERY_ROWS] @ vecs.T
            s[own[:, None] == ids[None, :]] = -np.inf
            at = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(s, at, 1)
            rows, cols = np.nonzero(np.isfinite(top))
            out.append(pd.DataFrame({"q_id": own[rows], "class": c, "r_id": ids[at[rows, cols]], "cosine": top[rows, cols]}))
    return pd.concat(out) if out else pd.DataFrame({"q_id": [], "class": [], "r_id": [], "cosine": []}).astype({"q_id": "int64", "class": "int64", "r_id": "int64", "cosine": float})


NEAREST = "q_id long, class long, r_id long, cosine double"


def nearest_references(queries: DataFrame, references: DataFrame, vector: str, k: int, by_class: str | None = None) -> DataFrame:
    """(q_id, [class,] r_id, cosine, rank): the k most similar references of every query.

    References of at most BANK_BYTES go to every task and queries stay where they are. Beyond that blocks
    of queries meet blocks of references: each task multiplies one of each and keeps k per query, so
    neither side has to fit anywhere. A query is no reference of itself. Zero and null vectors neither
    ask nor answer; ties go to the smaller id. Both sides need `id` (long) and the vector; references the class.
    """
    usable = lambda df: df.where(F.col(vector).isNotNull() & (vectors.norm(F.col(vector)) > 0))
    klass = F.col(by_class).cast("long") if by_class else F.lit(0).cast("long")
    queries = usable(queries).select(F.col("id").alias("q_id"), vectors.unit(F.col(vector)).alias("q"))
    stored = usable(references).select(F.col("id").alias("r_id"), klass.alias("class"), vectors.unit(F.col(vector)).alias("r"))
    n, width = usable(references).agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
    if n * width * 8 <= BANK_BYTES:
        rows = stored.toArrow()
        x = np.asarray(rows.column("r").combine_chunks().flatten(), dtype=np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
        shared = stored.sparkSession.sparkContext.broadcast(_bank(np.asarray(rows.column("class"), np.int64), np.asarray(rows.column("r_id"), np.int64), x))  # at most BANK_BYTES

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield _nearest(batch.q_id.to_numpy(), np.stack(batch.q.to_numpy()), shared.value, k)

        found = queries.mapInPandas(ask, NEAREST)
    else:
        nq, nr = _pieces(queries.count(), QUERY_ROWS), _pieces(n, BLOCK_ROWS)
        asked = queries.select("*", F.pmod(F.xxhash64("q_id"), F.lit(nq)).alias("qp"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rp"))
        held = stored.select("*", F.pmod(F.xxhash64("r_id"), F.lit(nr)).cast("int").alias("rp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qp"))

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            bank = _bank(right["class"].to_numpy(), right.r_id.to_numpy(), np.stack(right.r.to_numpy())) if len(right) else []
            return _nearest(left.q_id.to_numpy(), np.stack(left.q.to_numpy()) if len(left) else np.zeros((0, 1)), bank, k)

        found = asked.groupBy("qp", "rp").cogroup(held.groupBy("qp", "rp")).applyInPandas(best, NEAREST)
    order = Window.partitionBy("q_id", "class").orderBy(F.desc(F.round("cosine", 12)), "r_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked if by_class else ranked.drop("class")


def knn_score(nearest: DataFrame) -> DataFrame:
    """1 minus the mean cosine to the nearest references found (fewer references, fewer terms)."""
    return nearest.groupBy("q_id").agg((1 - F.avg("cosine")).alias("s"), F.count(F.lit(1)).alias("k"))


def knn_class(nearest: DataFrame) -> DataFrame:
    """The class of the largest mean cosine among its own nearest references; ties to the smaller class."""
    means = nearest.groupBy("q_id", "class").agg(F.avg("cosine").alias("cosine"))
    return means.groupBy("q_id").agg(F.max_by(F.struct("class", "cosine"), F.struct(F.round("cosine", 12), -F.col("class"))).alias("b")).select("q_id", F.col("b.class").alias("predicted"), F.col("b.cosine").alias("cosine"))


def pair_losses(batch: DataFrame, vector: str, label: str, batch_key: str, temperature: float = 0.1, margin: float = 0.5) -> DataFrame:
    """Supervised contrastive and batch-hard triplet loss of every batch, from pairs within the batch.

    A batch is a training batch of bounded size. Anchors without a positive (or, for the triplet loss,
    without a negative) are left out; a batch without anchors gives 0.
    """
    rows = batch.select(F.col(batch_key).alias("batch"), "id", F.col(label).alias("label"), vectors.unit(F.col(vector)).alias("z"))
    other = rows.select("batch", F.col("id").alias("id2"), F.col("label").alias("label2"), F.col("z").alias("z2"))
    pairs = rows.join(other, "batch").where("id <> id2").withColumns({"sim": vectors.dot(F.col("z"), F.col("z2")), "d": vectors.distance(F.col("z"), F.col("z2")), "same": F.col("label") == F.col("label2")})
    scaled = F.col("sim") / temperature
    top = F.lit(1.0 / temperature)  # the self-similarity of unit vectors, the row maximum of the matrix
    anchors = pairs.groupBy("batch", "id").agg(
        F.log(F.sum(F.exp(scaled - top)) + 1e-12).alias("lse"), F.avg(F.when(F.col("same"), scaled - top)).alias("pos"),
        F.max(F.when(F.col("same"), F.col("d"))).alias("hard_pos"), F.min(F.when(~F.col("same"), F.col("d"))).alias("hard_neg"),
    )
    return anchors.groupBy("batch").agg(
        F.coalesce(F.avg(F.when(F.col("pos").isNotNull(), F.col("lse") - F.col("pos"))), F.lit(0.0)).alias("supcon"),
        F.coalesce(F.avg(F.when(F.col("hard_pos").isNotNull() & F.col("hard_neg").isNotNull(), F.greatest(F.col("hard_pos") - F.col("hard_neg") + margin, F.lit(0.0)))), F.lit(0.0)).alias("triplet"),
    )
