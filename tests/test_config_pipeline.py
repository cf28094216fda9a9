import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark import config, pipeline
from siltmark.functions import imaging, udfs
from siltmark.operators import localize, report
from siltmark.sources import registry


def test_config(tmp_path):
    base = config.Config()
    changed = config.with_setting(base, "gate.k", 9)
    assert base.gate.k == 5 and changed.gate.k == 9 and base.key() != changed.key() == config.with_setting(base, "gate.k", 9).key()
    config.dump(changed, tmp_path / "c.yaml")
    assert config.load(tmp_path / "c.yaml") == changed
    with pytest.raises(KeyError):
        config.with_setting(base, "gate.unknown", 1)
    with pytest.raises(KeyError):
        config.from_dict({"nothing": 1})
    assert [c.gate.k for c in config.grid(base, {"gate.k": [1, 5], "split.seed": [0, 1]})] == [1, 1, 5, 5]


def test_registry(spark, tmp_path):
    arrays = {"w": np.arange(6.0).reshape(2, 3), "b": np.array([0.5])}
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    registry.save(spark, str(tmp_path / "m"), "a", arrays, {"k": 1}, {"rows": registry.fingerprint(df)})
    got, settings = registry.load(spark, str(tmp_path / "m"), "a")
    assert settings == {"k": 1} and all((got[k] == arrays[k]).all() for k in arrays)
    with pytest.raises(KeyError):
        registry.load(spark, str(tmp_path / "m"), "b")
    assert registry.fingerprint(df) == registry.fingerprint(df.repartition(3).select("x", "id")) != registry.fingerprint(df.where("id > 0"))


def test_sql_functions(spark):
    udfs.register(spark)
    assert spark.sql("SELECT l2_normalize(array(3D, 4D)) AS u").first().u == [0.6, 0.8]
    image = np.random.default_rng(0).integers(0, 255, (20, 20, 3)).astype(np.uint8)
    df = spark.createDataFrame([(imaging.encode_png(image),), (b"x",), (None,)], "c binary")
    assert [r.h for r in df.select(udfs.dhash64("c").alias("h")).collect()] == [imaging.dhash64(image), None, None]
    rows = spark.sql("SELECT * FROM threshold_sweep(array(1, 0, 1), array(0.9D, 0.5D, 0.5D))").collect()
    assert [tuple(r) for r in rows] == [(0.9, 1, 1), (0.5, 2, 3)]


def test_rebuild(spark):
    clean = "train/real/Screenshot_20240101_{:06d}_Maps.png"
    rows = [(i, clean.format(100000 + i), "train", "real", "clean", f"no_erros:sess{i}") for i in range(30)]
    rows += [(100 + i, f"train/real/IKSWW-{i // 3}_maps_fold_portrait_screenshot{i % 3}.png", "train", "real", "overlay" if i % 3 else "strange", f"IKSWW-{i // 3}") for i in range(60)]
    rows += [(900, clean.format(100000).replace(".png", " (1).png.png"), "val", "real", "", None), (901, "train/synthetic/x__overlay__v0.png", "train", "synthetic", "overlay", None)]
    df = spark.createDataFrame(rows, "sample_id long, path string, split string, source string, category string, `group` string").withColumns({c: F.lit(None).cast("string") for c in ("form_factor", "orientation", "kind", "is_competitor", "has_boundbox")})
    out = pipeline.rebuild(df, config.Config()).collect()
    assert len(out) == 90 and {r.category for r in out} == {"clean", "overlay"}
    assert len({r.group for r in out if r.category == "clean"}) == 1
    assert {r.sample_id: r.copies for r in out}[0] == 2
    splits = {}
    assert all(splits.setdefault(r.group, r.split) == r.split for r in out)


def test_report(spark):
    df = spark.createDataFrame([(i, i % 2, i / 10, "a" if i % 2 else "clean", i % 3) for i in range(10)], "id long, y int, s double, cat string, g int")
    rows = report.evaluate(df, 0.5, "cat", "clean").unionByName(report.with_interval(df, "g", 5))
    found = {(r.block, r.metric, r.slice): r.value for r in rows.collect()}
    assert found["ranking", "auroc", "all"] == pytest.approx(0.6) and ("detection", "recall", "a") in found and ("bootstrap_auroc", "ci_hi", "all") in found
    text = report.markdown(rows, "Run")
    assert text.startswith("# Run") and "| a | recall |" in text
    one = report.evaluate(df.where("y = 1"), 0.5)
    assert "–" in report.markdown(one, "x") and json.dumps(text)


def test_patches(spark):
    rng = np.random.default_rng(1)
    bank = spark.createDataFrame([(i, (rng.normal(size=4) * 0.05 + [1, 0, 0, 0]).tolist()) for i in range(40)], "id long, v array<double>")
    asked = spark.createDataFrame([(100, [1.0, 0.0, 0.0, 0.0]), (101, [0.0, 1.0, 0.0, 0.0])], "id long, v array<double>")
    scores = {r.q_id: r.score for r in localize.anomaly(asked, bank, "v").collect()}
    assert scores[101] == 1.0 and scores[100] < 0.5
    assert localize.memory_bank(bank, 7).count() == 7
    drawn = localize.weighted_sample(spark.createDataFrame([(i, 1000.0 if i < 3 else 0.001) for i in range(50)] + [(99, 0.0)], "id long, w double"), "w", "id", 3, 1)
    assert {r.id for r in drawn.collect()} == {0, 1, 2}
