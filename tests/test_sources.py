import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.functions import imaging, layouts, regions
from siltmark.operators import components, training
from siltmark.plans import process
from siltmark.sources import readers, sinks
from siltmark.streaming import ingest


@pytest.mark.parametrize("path,held", [
    ("data/test.npz", True), ("data/test_synth.npz", True), ("data/test/real/a.png", True), ("data/split=test/x.parquet", True), ("C:\\data\\TEST\\a.csv", True),
    ("data/train.npz", False), ("data/contest/a.png", False), ("data/latest.npz", False), ("", False),
])
def test_guard(path, held):
    assert readers.is_held_out(path) is held


def test_held_out_reads_need_the_lock(spark, tmp_path):
    path = str(tmp_path / "test.parquet")
    spark.range(3).write.parquet(path)
    with pytest.raises(readers.HeldOutAccessError):
        readers.read_vectors(spark, path)
    with readers.LOCK:
        assert readers.read_vectors(spark, path).count() == 3
    with pytest.raises(PermissionError):
        readers.read_vectors(spark, path)


def screen(h=64, w=96, seed=0):
    rng = np.random.default_rng(seed)
    image = np.full((h, w, 3), 200, np.uint8)
    image[10:40, 20:60] = rng.integers(0, 255, (30, 40, 3))
    return image


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, data in {"a.png": imaging.encode_png(screen()), "sub/b.PNG": imaging.encode_png(screen(seed=1)), "c.png": b"broken", "d.txt": b"x", "a.png.Zone.Identifier": b"[ZoneTransfer]", "copy (1).png": imaging.encode_png(screen())}.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_file_scans(spark, folder):
    found = {r.name: r.route for r in readers.scan_files(spark, str(folder)).collect()}
    assert found["a.png"] == found["b.PNG"] == "image" and found["d.txt"] == "other" and found["a.png.Zone.Identifier"] == "junk"
    sizes = {r.path.rsplit("/", 1)[-1]: (r.w, r.h) for r in readers.png_sizes(spark, str(folder)).collect()}
    assert sizes["a.png"] == (96, 64) and sizes["c.png"] == (-1, -1)
    hashes = {r.name: r.sha256 for r in readers.file_hashes(spark, str(folder)).collect()}
    assert hashes["a.png"] == hashes["copy (1).png"] != hashes["b.PNG"]


def test_manifests_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a,b.png", "train", '"q"', "18446744073709551615"), ("c\nd.png", "val", None, "9223372036854775808")], "path string, split string, source string, phash string")
    counts = {r.split: r.n for r in readers.write_split_manifests(rows, str(tmp_path / "m"))  .collect()}
    assert counts == {"train": 1, "val": 1}
    one = str(tmp_path / "one")
    rows.select("path", "source").coalesce(1).write.option("header", "true").option("escape", '"').csv(one)
    back = readers.read_csv(spark, one, "path string, source string").collect()
    assert {r.path for r in back} == {"a,b.png", "c\nd.png"}
    assert [r.h for r in rows.select(readers.unsigned_hash(F.col("phash")).alias("h")).collect()] == [-1, -(1 << 63)]
    only = readers.reconcile(rows.select("path"), rows.limit(1).select("path").union(spark.createDataFrame([("z",)], "path string")), "path")
    assert {(r.path, r.only_in) for r in only.collect()} == {("c\nd.png", "manifest"), ("z", "files")}
    assert sinks.publish(rows, str(tmp_path / "v"), "1").endswith("version=1")
    with pytest.raises(Exception):
        sinks.publish(rows, str(tmp_path / "v"), "1")


def test_png_round_trip_and_filters():
    image = screen()
    assert (imaging.decode_png(imaging.encode_png(image)) == image).all()
    for bad in (None, b"", b"x", imaging.encode_png(image)[:40]):
        assert imaging.decode_png(bad) is None
    line, above = np.array([5, 250, 3, 10, 20, 30]), np.array([1, 2, 3, 4, 5, 6])
    assert imaging._unfilter(1, line, above, 3).tolist() == [5, 250, 3, 15, 14, 33]
    assert imaging._unfilter(2, line, above, 3).tolist() == [6, 252, 6, 14, 25, 36]
    assert imaging._unfilter(4, line, above, 3).tolist()[:3] == [6, 252, 6]


def test_operators_keep_shape_and_follow_the_seed():
    image = np.random.default_rng(4).integers(0, 255, (320, 400, 3)).astype(np.uint8)
    kept = image.copy()
    for name in layouts.OPERATORS:
        for seed in range(5):
            out = layouts.apply(name, image, np.random.default_rng(seed))
            assert out.dtype == np.uint8 and (out == layouts.apply(name, image, np.random.default_rng(seed))).all()
            assert name == "ar_relayout" or out.shape == image.shape
            assert out.std() > 1, name
    assert (image == kept).all()
    out, ops = layouts.reflow(image, np.random.default_rng(1), {"ar_relayout": 1.0, "scroll_shift": 1.0}, most=2)
    assert ops in (["scroll_shift", "ar_relayout"], ["ar_relayout"], ["scroll_shift"])
    aspect = layouts.apply("ar_relayout", image, np.random.default_rng(0), [0.96]).shape
    assert abs(aspect[1] / aspect[0] - 0.96) < 0.08
    assert layouts.reflow(image, np.random.default_rng(0), {"two_pane": 0.0})[1] == []
    assert layouts.apply("two_pane", image[:8], np.random.default_rng(0)).shape == image[:8].shape


def test_plans_stay_in_the_ranges():
    """The parts that plans cover are the fixed ranges of the operators."""
    h, w = 1000, 2000
    part = lambda stroke, k: stroke.box[k + 2] / (h, w)[k]
    for seed in range(40):
        plan = {name: layouts.PLANS[name](h, w, np.random.default_rng(seed)) for name in layouts.INJECTORS}
        (empty,), (over,) = plan["empty_space"], plan["overlay"]
        assert 0.2 <= part(empty, 0) + 1e-3 and part(empty, 0) <= 0.45 and 0.4 <= part(empty, 1) + 1e-3 and part(empty, 1) <= 0.95 and empty.fill == "border"
        assert 0.12 <= part(over, 0) + 1e-3 and part(over, 1) <= 0.55 and 0.75 <= over.strength <= 1
        assert 4 <= len(plan["disorder"]) <= 8 and all(s.fill == "black" for s in plan["black_region"]) and len(plan["black_region"]) <= 2
        crop = plan["cropped"][1]
        assert 0.15 <= max(crop.box[0] / h, crop.box[1] / w) + 1e-3 <= 0.352
        for stroke in (s for p in plan.values() for s in p):
            assert 0 <= stroke.box[0] < h and 0 <= stroke.box[1] < w


def test_canvases():
    image = np.zeros((100, 60, 3), np.uint8)
    image[:10], image[60:70] = 200, 90
    (pane,) = layouts.canvas_scroll_shift(image, np.random.default_rng(0))
    assert sorted(pane.rows.tolist()) == list(range(100))
    gap = layouts.gaps(image)
    assert set(np.unique(gap[gap >= 0]).tolist()) and gap[9] == gap[10] == gap[59] == gap[60] == -1 and (gap[12:58] == gap[12]).all() and gap[12] != gap[80] >= 0
    (pane,) = layouts.canvas_band_jitter(image, np.random.default_rng(3))
    assert (np.diff(pane.rows) > 0).all() and pane.rows[0] > -0.5 and pane.rows[-1] < 99.5
    assert (layouts.sample(image, np.arange(100), np.arange(60)) == image).all()
    left, right = layouts.canvas_two_pane(image, np.random.default_rng(0))
    assert left.rows.max() < 50 <= right.rows.min() + 0.5 and len(left.columns) + len(right.columns) == 60


def test_changed_patches():
    before = screen(518, 518)
    after = before.astype(int)
    after[:14, :14, 0] += 30  # a mean of 10 levels
    after[28:42, 28:42] += 20
    after[56:60, 56:60] += 60  # less than a quarter of a patch
    flags = imaging.changed_patches(before, np.clip(after, 0, 255).astype(np.uint8)).reshape(37, 37)
    assert np.argwhere(flags).tolist() == [[2, 2]]
    tall = np.full((518, 259, 3), 50, np.uint8)
    assert imaging.changed_patches(tall, tall).sum() == 0 and imaging.changed_patches(tall, np.full((518, 518, 3), 50, np.uint8)).sum() > 300
    x = imaging.preprocess(before)
    assert x.shape == (3, 518, 518) and abs(float(x[0].mean()) - (before[..., 0].mean() / 255 - 0.485) / 0.229) < 1e-3


def test_hash_is_robust_and_tells_layouts_apart():
    noisy = np.random.default_rng(2).integers(0, 255, (120, 90, 3)).astype(np.uint8)
    big = imaging.resize(noisy, 240, 180)
    far = lambda a, b: ((imaging.dhash64(a) ^ imaging.dhash64(b)) & ((1 << 64) - 1)).bit_count()
    assert far(noisy, big) <= 6 and far(noisy, noisy[:, ::-1]) > 10


def labelled(mask):
    run = regions.runs(mask)
    out = np.zeros(mask.shape, int)
    for (row, start, end), k in zip(run, np.unique(regions.joined_runs(run, mask.shape[1]), return_inverse=True)[1]):
        out[row, start:end] = k + 1
    return out.tolist()


def test_regions(spark):
    image = np.random.default_rng(0).integers(0, 255, (480, 500, 3)).astype(np.uint8)
    assert regions.flat_regions(image) == []
    bar, block, middle = image.copy(), image.copy(), image.copy()
    bar[:, :100], block[:200, :200], middle[100:400, 100:400] = 0, 0, 0
    bar[:, 420:] = 240
    images = spark.createDataFrame([(n, bytearray(imaging.encode_png(i))) for n, i in (("none", image), ("bar", bar), ("block", block), ("middle", middle))], "path string, content binary")
    found = {}
    for r in regions.find_regions(images).collect():
        found.setdefault(r.path, []).append(r)
    assert [r.kind for r in found["none"]] == [None] and found["none"][0].score == 0
    assert found["middle"][0].kind is None  # flat and black, but at no side
    assert [(r.kind, r.is_band, r.sides) for r in found["block"]] == [("black_region", False, "left+top")]
    black, empty = sorted(found["bar"], key=lambda r: r.kind)
    assert (black.kind, black.is_band, empty.kind, empty.is_band) == ("black_region", True, "empty_space", True) and 0.15 < black.part < 0.22
    assert black.score == pytest.approx(black.part + 0.6 * empty.part, abs=2e-4)
    mask = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool)
    assert labelled(mask) == [[1, 0, 1], [1, 0, 1], [1, 1, 1], [0, 0, 0], [2, 0, 3]]
    assert labelled(np.ones((2, 2), bool)) == [[1, 1], [1, 1]] and labelled(np.zeros((2, 2), bool)) == [[0, 0], [0, 0]]
    assert labelled(np.array([[1, 0], [0, 1]], bool)) == [[1, 0], [0, 2]]
    snake = np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 1, 0, 1], [1, 0, 1, 1, 1], [1, 0, 0, 0, 0], [1, 1, 1, 1, 1]], bool)
    assert np.max(labelled(snake)) == 1


def test_regions_hold_one_image_at_a_time(monkeypatch):
    import types

    import pandas as pd

    held, most = [], []
    monkeypatch.setattr(regions, "decode_png", lambda content: held.append(content) or screen())
    monkeypatch.setattr(regions, "flat_regions", lambda image: most.append(len(held)) or held.clear() or [])
    frame = types.SimpleNamespace(mapInPandas=lambda run, schema: list(run(iter([pd.DataFrame({"path": list("abc"), "content": [b""] * 3})]))))
    (out,) = regions.measured(types.SimpleNamespace(select=lambda *c: frame))
    assert most == [1, 1, 1] and out.flat.tolist() == [[], [], []]


def test_image_frames(spark, folder):
    images = spark.read.format("binaryFile").load(f"{folder}/*.png").select("path", "content")
    hashed = {r.path.rsplit("/", 1)[-1]: r for r in imaging.hash_images(images).collect()}
    assert hashed["c.png"].w == -1 and hashed["c.png"].phash is None and hashed["a.png"].phash == imaging.dhash64(screen())
    found = {r.path.rsplit("/", 1)[-1]: r for r in regions.find_regions(images).collect()}
    assert found["c.png"].score is None and found["c.png"].box is None and found["a.png"].score is not None
    made = layouts.make_variants(images, ("overlay", "disorder"), variants=2, seed=1)
    assert made.count() == 2 * 2 * 2 and made.exceptAll(layouts.make_variants(images.repartition(3), ("overlay", "disorder"), 2, 1)).count() == 0


def test_drawn_screens_use_all_cores(spark, sf):
    """One small file of sizes is a lot of drawing: it does not stay in one task."""
    assert process._drawn(spark, sf)._jdf.queryExecution().toRdd().getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_operators_change_drawn_screens(spark, tmp_path):
    """No screen is drawn too small for an operator, and new aspect ratios are seen in the result."""
    sizes = [(1080, 2520), (1080, 2520), (2520, 1080), (1440, 3120), (1768, 2208), (2076, 2152), (9000, 6000), (50, 3000), (1, 1), (0, 9), (-1, -1), (None, 9)]
    spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "pool_id long, w int, h int").coalesce(1).write.parquet(str(tmp_path / "pool_manifest.parquet"))
    drawn = {int(r.path[5:-4]): imaging.decode_png(bytes(r.content)) for r in process._drawn(spark, str(tmp_path)).collect()}
    assert sorted(drawn) == list(range(9))
    for i, image in drawn.items():
        h, w, _ = image.shape
        assert min(h, w) >= 91
        if min(sizes[i]) > 64:
            assert w / h == pytest.approx(sizes[i][0] / sizes[i][1], rel=0.03)
        for seed in range(5):
            for name in layouts.CANVASES:
                out = layouts.apply(name, image, np.random.default_rng(seed))
                assert out.shape != image.shape or (out != image).any(), (sizes[i], name)
            assert np.prod(layouts.apply("ar_relayout", image, np.random.default_rng(seed)).shape) == pytest.approx(image.size, rel=0.03)
    found = {r.applied: r for r in process.image_variants(spark, str(tmp_path)).collect()}
    assert set(found) == set(layouts.OPERATORS) and {r.n for r in found.values()} == {9}
    assert found["ar_relayout"].n_sizes == 9 and {r.n_sizes for a, r in found.items() if a != "ar_relayout"} == {8}


def test_variants_do_not_multiply_their_image(spark, folder):
    images = spark.read.format("binaryFile").load(f"{folder}/*.png").select("path", "content")
    made = layouts.make_variants(images, ("overlay", "disorder"), variants=2)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.applied, r.variant) for r in made.collect()} == {(a, v) for a in ("overlay", "disorder") for v in (0, 1)}


def test_head_gradient_and_training():
    cfg = training.HeadConfig(hidden=7, out=5, classes=3)
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(9, 6)), np.array([0, 0, 0, 1, 1, 1, 2, 2, 0])
    p = training.start(6, cfg)
    _, g = training.gradient(p, x, y, cfg)
    for name in p:
        index = tuple(0 for _ in p[name].shape)
        up, down = ({k: a.copy() for k, a in p.items()} for _ in range(2))
        up[name][index] += 1e-6
        down[name][index] -= 1e-6
        slope = (training.gradient(up, x, y, cfg)[0] - training.gradient(down, x, y, cfg)[0]) / 2e-6
        assert slope == pytest.approx(g[name][index], abs=1e-6), name
    z, _, _ = training.forward(p, x)
    assert np.allclose(np.linalg.norm(z, axis=1), 1)
    centres = rng.normal(size=(3, 6)) * 4
    y = rng.integers(0, 3, 240)
    x = centres[y] + rng.normal(size=(240, 6))
    best, history = training.fit(x[:200], y[:200], x[200:], y[200:], training.HeadConfig(hidden=16, out=8, classes=3, epochs=60, rate=5e-3))
    assert (training.forward(best, x[200:])[1].argmax(axis=1) == y[200:]).mean() > 0.9
    assert history[-1]["loss"] < history[0]["loss"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 0b111, "a"), (3, (1 << 40) - 1, "a"), (4, None, "a"), (5, 0, "b"), (6, 1, "b")], "id long, phash long, source string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.landed(spark, str(tmp_path / "in"), rows.schema)
    out = {r.id: r.kept for r in ingest.perceptual_dedup(stream, 2, str(tmp_path / "w")).collect()}
    assert out == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}  # whatever the source
    spark.createDataFrame([(7, 3, "a"), (8, 63 << 50, "a")], rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = ingest.perceptual_dedup(stream, 2, str(tmp_path / "w")).collect()
    assert {r.id: r.kept for r in again if r.id > 6} == {7: False, 8: True} and len(again) == 8
    seen = []
    ingest.each_batch(stream, str(tmp_path / "each"), lambda df, i: seen.append(df.count()))
    assert sum(seen) == 8


def test_greedy_dedup_is_order_dependent(spark):
    def kept(hashes):
        rows = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
        return [r.kept for r in components.greedy_hashes(rows, "id", "h", 2).orderBy("id").collect()]

    def one_by_one(hashes):
        have, out = [], []
        for h in hashes:
            out.append(h is None or all(((h ^ k) & ((1 << 64) - 1)).bit_count() > 2 for k in have))
            have += [h] if out[-1] and h is not None else []
        return out

    assert kept([0b0000, 0b0011, 0b1111]) == [True, False, True]
    assert kept([0b0011, 0b0000, 0b1111]) == [True, False, False]
    rng = np.random.default_rng(3)
    many = [int(h) - (1 << 63) if rng.random() < 0.9 else None for h in rng.integers(0, 512, 200)]
    assert kept(many) == one_by_one(many) and kept([]) == []


def test_versions(spark, tmp_path):
    rows = spark.range(5)
    folder = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, folder)
    sinks.publish_checked(rows, folder, "a", {"rows": lambda df: df.count() == 5})
    sinks.publish_checked(spark.range(7), folder, "b", {})
    assert sinks.current(spark, folder).count() == 7
    with pytest.raises(ValueError, match="rows"):
        sinks.publish_checked(spark.range(3), folder, "c", {"rows": lambda df: df.count() == 5})
    assert sinks.current(spark, folder).count() == 7
    assert sinks.roll_back(spark, folder) == "a" and sinks.current(spark, folder).count() == 5


def test_scans_and_packages(spark, tmp_path):
    png = bytearray(imaging.encode_png(screen()))
    rows = [("train", "real", "clean", "Screenshot_20240101_100000_Maps.png", png), ("train", "real", "clean", "Screenshot_20240101_100200_Maps.png", png), ("val", "real", "overlay", "IKSWW-7_maps.png", png), ("val", "synthetic", "overlay", "a__b__overlay__v0.png", png)]
    images = spark.createDataFrame(rows, "split string, source string, category string, name string, content binary")
    tree = str(tmp_path / "tree")
    manifest = sinks.export_class_tree(images, tree).cache()
    assert manifest.count() == 4
    found = {r.name: r for r in readers.scan_dataset(spark, tree).collect()}
    assert found["IKSWW-7_maps.png"].group == "IKSWW-7" and found["IKSWW-7_maps.png"].label == 1
    assert found["Screenshot_20240101_100200_Maps.png"].group == found["Screenshot_20240101_100000_Maps.png"].group == "session:Screenshot_20240101_100000_Maps.png"
    assert (found["a__b__overlay__v0.png"].parent, found["a__b__overlay__v0.png"].applied) == ("a__b", "overlay")
    tar = sinks.package(spark, tree, manifest, str(tmp_path / "set.tar"))
    assert sum(1 for _ in open(f"{tree}/SHA256SUMS")) == 4 and __import__("tarfile").open(tar).getnames()
    with pytest.raises(ValueError, match="gone.png"):
        sinks.package(spark, tree, manifest.select("path").union(spark.createDataFrame([("gone.png",)], "path string")), str(tmp_path / "bad.tar"))
    counts = sinks.embed_and_persist(images, sinks.GridEmbedder(4), str(tmp_path / "emb"), ["split", "source", "category", "name"])
    assert {(r.split, r.source): r.n for r in counts.collect()} == {("train", "real"): 2, ("val", "real"): 1, ("val", "synthetic"): 1}
    flat = tmp_path / "flat"
    (flat / "train" / "real").mkdir(parents=True)
    (flat / "train" / "real" / "a.png").write_bytes(png)
    (flat / "labels.csv").write_text("path,split,source,category,category_id,label,group,form_factor,orientation,kind,is_competitor,has_boundbox\ntrain/real/a.png,train,real,clean,0,0,IKSWW_7,,,,,\ntrain/real/gone.png,train,real,clean,0,0,x,,,,,\n")
    (row,) = readers.scan_dataset(spark, str(flat)).collect()
    assert (row.path, row.group) == ("train/real/a.png", "iksww-7")
    classes = tmp_path / "classes"
    for name in ("no_erros", "errors_dataset", "with_errors"):
        (classes / name).mkdir(parents=True)
        (classes / name / f"{name}.png").write_bytes(png)
    assert {(r["class"], r.label) for r in readers.scan_classes(spark, str(classes), "with_errors").collect()} == {("no_erros", 0), ("with_errors", 1)}
    labels = spark.createDataFrame([("a", "train", 1), ("b", "train", 0), ("c", "val", 1)], "path string, split string, label int")
    sizes = spark.createDataFrame([("a", 100, 200), ("b", 1, 1), ("c", 1, 1)], "path string, w int, h int")
    assert [tuple(r) for r in readers.error_aspects(labels, sizes).collect()] == [("a", 0.5)]
    grid = sinks.write_grid([{"k": 1, "score": 0.5}, {"k": 2, "score": float("nan")}, {"k": 3, "score": 0.9}], str(tmp_path / "grid"), spark)
    assert [r.k for r in grid.collect()] == [3, 1, 2]


def test_tables_of_held_out_splits_are_locked(spark, tmp_path):
    from siltmark.session import table

    spark.range(1).write.parquet(str(tmp_path / "test_labels.parquet"))
    with pytest.raises(readers.HeldOutAccessError):
        table(spark, str(tmp_path), "test_labels")
    with pytest.raises(readers.HeldOutAccessError):
        readers.scan_files(spark, str(tmp_path / "test"))
    with readers.LOCK:
        assert table(spark, str(tmp_path), "test_labels").count() == 1
