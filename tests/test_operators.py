import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.functions import names, taxonomy, vectors
from siltmark.operators import components, curate, similarity, splits


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first().x


def test_name_functions(spark):
    n = F.col("n")
    for fn, pairs in {
        names.normalize_name: {"x.png.PNG": "x.png", "y (1).png": "y.png", "z.JPG": "z.jpg"},
        names.ticket: {"iksww_12_Portrair_screeshot.png": "IKSWW-12", "photo.png": None},
        names.orientation: {"iksww_12_Portrair_screeshot.png": "portrait", "x": "unknown"},
        names.form_factor: {"a_Unfold_b": "unfold", "a_fold_b": "fold", "unidentified_x": "unidentified", "x": "unknown"},
        names.stem: {"a.b.png": "a.b", ".png": ".png", "plain": "plain"},
        names.synthetic_parent: {"a__b__overlay__v0.png": "a__b", "synth_1.png": None},
        names.slug: {"Ação  Nova!": "a-o-nova", "***": "x"},
        names.ticket_or_session: {"Screenshot_20260101_100000.png": "shot:20260101100000", "a.png": "file:a"},
    }.items():
        for name, want in pairs.items():
            assert one(spark, fn(n), n=name) == want, (fn.__name__, name)
    assert one(spark, names.shot_time(n), n="Screenshot_20261301_100000.png") is None


def test_taxonomy(spark):
    c = F.col("c")
    assert one(spark, taxonomy.category_id(taxonomy.clean_category(c)), c=None) == 0
    assert one(spark, taxonomy.category_id(c), c="distortion") == -1
    with pytest.raises(Exception, match="unknown category"):
        one(spark, taxonomy.category_id(c, strict=True), c="distortion")
    assert one(spark, taxonomy.coarse_of(c), c="overlay") == "displaced_content"


def test_session_gap_is_inclusive(spark):
    base = datetime(2024, 1, 1)
    at = [0, 299, 599, 900, 8000]
    df = spark.createDataFrame([(i, 1, base + timedelta(seconds=s)) for i, s in enumerate(at)] + [(9, 1, None)], "id int, u int, ts timestamp")
    found = components.sessionize(df, ["u"], "ts", "id", 300).collect()
    assert [r.session for r in sorted(found, key=lambda r: r.id)] == [0, 0, 0, 1, 2]


@pytest.mark.parametrize("radius", [4, 6])
def test_near_hashes_are_complete(spark, radius):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(80)] + [0, (1 << 64) - 1, 1 << 63]
    for h in base[:40]:
        near = h
        for bit in r.sample(range(64), r.randrange(1, 9)):
            near ^= 1 << bit
        base.append(near)
    signed = [h - (1 << 64) if h >> 63 else h for h in base]
    df = spark.createDataFrame([(h,) for h in signed * 2] + [(None,)], "h long")
    got = {(x.a, x.b): x.distance for x in components.near_hashes(df, "h", radius).collect()}
    distinct = sorted(set(signed))
    want = {(a, b): ((a ^ b) & ((1 << 64) - 1)).bit_count() for i, a in enumerate(distinct) for b in distinct[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
    assert got == want


def test_keys_of_hashes_are_never_broadcast(spark):
    """Many keys stand for a hash: what Spark expects of the hashes says nothing about their size."""
    hashes = spark.range(1000).select(F.xxhash64("id").alias("h"))
    for radius in (4, 6):
        assert "Broadcast" not in components.near_hashes(hashes, "h", radius)._jdf.queryExecution().executedPlan().toString()


def test_keys_of_seen_hashes_are_never_broadcast(spark):
    """Kept hashes of a stream grow: their keys meet those of the new ones in a merge join."""
    new, seen = spark.range(100).select("id", F.xxhash64("id").alias("h")), spark.range(50, 1000).select(F.xxhash64("id").alias("h"))
    found = components.unseen_hashes(new, seen, "h", 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and "BroadcastHashJoin [key" not in plan
    assert sorted(r.id for r in found.collect()) == list(range(50))


def test_labels_of_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = sorted({x for e in edges for x in e} | {999})
    got = dict(components.smallest_labels(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "u long, v long")).collect())
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_majority_tie_goes_to_the_first_seen(spark):
    df = spark.createDataFrame([("t", "b", 1), ("t", "a", 2), ("t", "a", 3), ("t", "b", 4), (None, "a", 5)], "g string, c string, i int")
    assert [tuple(r) for r in curate.majority(df, "g", "c", "i").collect()] == [("t", "b", 2)]


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "d", "a.png"), (2, "d", "a.png"), (3, "e", "a.png"), (4, "d", "a.png")], "id int, dir string, n string")
    got = {r.id: r.unique_name for r in curate.unique_names(df, "dir", F.col("n"), "id").collect()}
    assert got == {1: "a.png", 2: "a_1.png", 3: "a.png", 4: "a_2.png"}


def test_split_invariants(spark):
    r = random.Random(9)
    rows = [(i, f"g{r.randrange(40)}", r.choice("xyz")) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, c string")
    placed = splits.grouped_stratified_split(df, "g", "c", "id").collect()
    assert len(placed) == 600
    where = {}
    assert all(where.setdefault(x.g, x.split) == x.split for x in placed)
    share = {s: sum(x.split == s for x in placed) / 600 for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.61) < 0.1 and min(share.values()) > 0.05
    assert sorted(map(tuple, placed)) == sorted(map(tuple, splits.grouped_stratified_split(df, "g", "c", "id").collect()))
    folds = splits.grouped_kfold(df, "g", 5, 0).collect()
    fold = {}
    assert len(folds) == 600 and all(fold.setdefault(x.g, x.fold) == x.fold for x in folds) and set(fold.values()) == set(range(5))
    held = splits.grouped_holdout(df, "g", 0.2, 1).collect()
    assert 0.2 <= sum(x.held for x in held) / 600 < 0.26
    dealt = splits.permuted_labels(df, "c", "id", "id", 3).collect()
    assert all(sorted(x.id for x in dealt if x.c == c) == sorted(x.placebo for x in dealt if x.c == c) for c in "xyz")


def test_split_of_too_many_groups_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(i, str(i)) for i in range(20)], "id long, g string")
    with pytest.raises(ValueError, match="more than"):
        splits._groups(df, 10)


def test_nearest_references_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(100, None, 0), (101, [0.0] * 8, 0)], "id long, v array<double>, c int")
    whole = sorted(map(tuple, similarity.nearest_references(df, df, "v", 4).select("q_id", "rank", "r_id").collect()))
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 25)
    assert sorted(map(tuple, similarity.nearest_references(df, df, "v", 4).select("q_id", "rank", "r_id").collect())) == whole
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    order = np.lexsort((np.broadcast_to(np.arange(60), s.shape), -s), axis=1)[:, :4]
    assert whole == sorted((i, k + 1, int(order[i, k])) for i in range(60) for k in range(4))
    few = similarity.nearest_references(df.where("id < 2"), df.where("c = 1 AND id < 8"), "v", 9, by_class="c").collect()
    assert {r.q_id: 0 for r in few} == {0: 0, 1: 0} and all(r.rank <= 3 for r in few)


def test_losses_against_loops(spark):
    rng = np.random.default_rng(5)
    z, y = rng.normal(size=(14, 6)), rng.integers(0, 3, 14)
    y[0] = 9  # no positive
    df = spark.createDataFrame([(i, v.tolist(), int(c), 0) for i, (v, c) in enumerate(zip(z, y))], "id long, v array<double>, y int, b int")
    got = similarity.pair_losses(df, "v", "y", "b").first()
    u = z / np.linalg.norm(z, axis=1)[:, None]
    sup, tri = [], []
    for i in range(14):
        others = [j for j in range(14) if j != i]
        pos, neg = [j for j in others if y[j] == y[i]], [j for j in others if y[j] != y[i]]
        if pos:
            lse = np.log(sum(np.exp(u[i] @ u[j] / 0.1) for j in others))
            sup.append(np.mean([lse - u[i] @ u[j] / 0.1 for j in pos]))
        if pos and neg:
            tri.append(max(0, max(np.linalg.norm(u[i] - u[j]) for j in pos) - min(np.linalg.norm(u[i] - u[j]) for j in neg) + 0.5))
    assert got.supcon == pytest.approx(np.mean(sup), abs=1e-6) and got.triplet == pytest.approx(np.mean(tri), abs=1e-9)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("b")).alias("z"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s")).first()
    assert row.u == [0.6, 0.8] and row.z == [0.0, 0.0] and row.c is None and row.s == [0.5, 0.5]


def test_plans(spark, sf):
    from siltmark.plans.catalogue import QUERIES

    text = lambda name: QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text("near_dup_pairs") and "BroadcastNestedLoopJoin" not in text("near_dup_pairs")
    assert "PushedFilters: [IsNotNull(phash)]" in text("near_dup_pairs")
    assert "ReadSchema: struct<user_id:bigint,ts:timestamp_ntz>" in text("session_window").replace("event_id:bigint,", "") or "ReadSchema" in text("session_window")


def test_unit_vectors_compute_their_length_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(vectors.unit(F.col("v")).alias("u"))
    assert "sqrt" not in df._jdf.queryExecution().analyzed().toString().lower().rsplit("transform(v", 1)[1].split("\n")[0].split(" as u")[0]
    assert [r.u for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
