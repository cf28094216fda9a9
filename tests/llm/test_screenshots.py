"""Problems 2, 3, 5 and 6 against plain Python on the small data, and on planted and degenerate tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltmark.llm import names, p2_overlap, p3_history, p5_quota, p6_splits, records, small_world
from tests.llm import tables


def rows(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def real(row):
    return (row["source"] or "real").strip().lower() != "synthetic"


def group_of(text):
    text = re.sub(r"\s+", "", (text or "").lower())
    return re.sub(r"^iksww[-_]*(?=\d)", "iksww-", text) or None


def split_of(row):
    return (row["split"] or "").strip().lower() or (row["path"] or "").split("/")[0].strip().lower()


def lexicon(paths):
    counts = Counter()
    for path in paths:
        counts.update(re.findall("[a-z]+", re.sub("[0-9a-f]{8,}", " ", names.fold_name(names.base_name(path)))))
    return names.Lexicon({w: n for w, n in counts.items() if n >= 2 and 3 <= len(w) <= 32})


def images(spark, folder):
    """sample_id -> (gate, words) or None, following every hint at the parent."""
    labels = rows(spark, folder, "labels")
    by_id = {r["sample_id"]: r for r in labels}
    hints = defaultdict(list)
    for m in rows(spark, folder, "export_manifest"):
        if real(m):
            continue
        parent = (m["parent"] or "").strip()
        if parent.isdigit() and int(parent) in by_id:
            hints[m["sample_id"]].append(by_id[int(parent)]["path"])
        elif parent and not parent.isdigit():
            hints[m["sample_id"]].append(parent)
        if m["origem"]:
            hints[m["sample_id"]].append(m["origem"])
    shown, per_path = {}, {}
    for r in labels:
        if real(r):
            shown[r["sample_id"]] = r["path"]
            continue
        stem = names.parent_stem(names.base_name(r["path"]))
        named = re.match(r"(?is)^\s*synth\s*parent\s*:\s*(.*)$", r["group"] or "")
        found = stem or (named and named[1].strip()) or next(iter(hints[r["sample_id"]]), None)
        shown[r["sample_id"]] = found
        if found:
            per_path.setdefault(r["path"], found)
    for e in rows(spark, folder, "emb_cache"):
        if e["parent"]:
            per_path.setdefault(e["path"], e["parent"])
    for r in labels:
        shown[r["sample_id"]] = shown[r["sample_id"]] or per_path.get(r["path"])
    known = lexicon([p for p in shown.values() if p])
    return labels, {i: (names.parse(p, known)[:2] if p else (None, None)) for i, p in shown.items()}


def test_p2_pairs(spark, sf):
    labels, image = images(spark, sf)
    sides = {"train": defaultdict(list), "held": defaultdict(list)}
    for r in labels:
        if image[r["sample_id"]][0] and split_of(r) in ("train", "val", "test"):
            sides["train" if split_of(r) == "train" else "held"][image[r["sample_id"]]].append(r["sample_id"])
    truth = {(min(a, b), max(a, b)) for key, own in sides["train"].items() for a in own for b in sides["held"].get(key, ())}
    assert {tuple(r) for r in p2_overlap.p2_found(spark, sf).collect()} == truth and truth


def test_p6_sets(spark, sf):
    labels, image = images(spark, sf)
    derived = {image[r["sample_id"]] for r in labels if not real(r)} - {(None, None)}
    parent = {r["sample_id"]: r["sample_id"] for r in labels}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    hubs = defaultdict(list)
    for r in labels:
        if real(r) and group_of(r["group"]):
            hubs["g", group_of(r["group"])].append(r["sample_id"])
        if image[r["sample_id"]] in derived:
            hubs["i", image[r["sample_id"]]].append(r["sample_id"])
    for own in hubs.values():
        for other in own:
            a, b = sorted((find(own[0]), find(other)))
            parent[b] = a
    splits = defaultdict(set)
    for r in labels:
        splits[find(r["sample_id"])].add(split_of(r))
    truth = {k for k, v in splits.items() if len(v) > 1}
    assert {r.first_id for r in p6_splits.divided_sets(spark, sf).collect()} == truth and truth


def test_p6_splits_keep_sets_whole(spark, sf):
    placed = p6_splits.p6_splits(spark, sf).collect()
    assert len(placed) == spark.read.parquet(f"{sf}/labels.parquet").count() == len({r.sample_id for r in placed})
    assert all(len(s) == 1 for s in _by(placed, "first_id", "split").values())
    counts = Counter(r.split for r in placed)
    assert all(abs(counts[s] / len(placed) - share) < 0.05 for s, share in p6_splits.SHARES.items())


def _by(found, key, value):
    out = defaultdict(set)
    for r in found:
        out[r[key]].add(r[value])
    return out


def test_p6_one_set_with_a_third_of_all_rows(spark):
    sets = spark.createDataFrame([(i, 0 if i < 300 else i) for i in range(900)], "sample_id long, first_id long")
    counts = Counter(r.split for r in p6_splits.assign_splits(sets).collect())
    assert sum(counts.values()) == 900 and abs(counts["train"] / 900 - 0.61) < 0.06


def test_p3_rows(spark, sf):
    labels = [r for r in rows(spark, sf, "labels") if real(r)]
    pool = sorted(rows(spark, sf, "pool_manifest"), key=lambda r: (r["batch_no"], r["pool_id"]))
    known = lexicon([r["path"] for r in [*labels, *pool]])
    key = lambda r: (names.parse(r["path"], known)[:2], group_of(r["group"]))
    seen = {key(r) for r in labels}
    truth = set()
    for r in pool:
        k = key(r)
        if k[0][0] and k[1]:
            if k in seen:
                truth.add(r["pool_id"])
            seen.add(k)
    assert {r.pool_id for r in p3_history.p3_found(spark, sf).collect()} == truth and truth
    report = p3_history.p3_batches(spark, sf).collect()
    assert sum(r.n_known for r in report) == len(truth) and sum(r.n_rows for r in report) == len(pool)


def test_p3_planted(spark, tmp_path):
    ticket = "IKSWW-1000{}_radio_unfold_portrait_screenshot{}.png"
    labels = [{"sample_id": i, "path": "train/real/" + ticket.format(100 + i, 1), "source": "real", "group": f"IKSWW-1000{100 + i}"} for i in range(60)]
    pool = []

    def add(batch, path, group):
        pool.append({"pool_id": len(pool) + 1, "batch_no": batch, "path": path, "source": "foldable", "group": group})

    for batch in range(20):
        add(batch, f"capture/{ticket.format(500 + batch, 2)}", f"IKSWW-1000{500 + batch}")
    add(3, "capture/" + ticket.format(100, 1).upper().replace(".PNG", " (1).jpg.png"), "iksww_1000100 ")  # in labels
    add(18, "capture/" + ticket.format(502, 2).replace("radio", "raido"), "IKSWW-1000502")  # batch 2, mistyped
    add(1, "capture/" + ticket.format(519, 2), "IKSWW-1000519")  # lands before the one of batch 19
    add(7, "capture/" + ticket.format(101, 1), "IKSWW-1000999")  # other group
    add(7, "capture/" + ticket.format(102, 1), None)
    add(7, "capture/" + ticket.format(103, 9), "IKSWW-1000103")  # other shot
    add(9, "capture/" + ticket.format(700, 1), "IKSWW-1000700")
    add(9, "capture/" + ticket.format(700, 1), "IKSWW-1000700")
    folder = tables.write(spark, tmp_path, labels=labels, pool_manifest=pool)
    assert {r.pool_id for r in p3_history.p3_found(spark, folder).collect()} == {21, 22, 20, 28}


def test_p3_names_beyond_the_beam():
    """One name in 3,000 groups gives a few crowds of equal vectors; every key is found, with its smallest id."""
    n = 3000
    name = {"gate": ["ticket|77|fold|1||"] * n, "words": ["home||"] * n, "raw": ["home"] * n, "group_key": [f"g{i}" for i in range(n)]}
    graphs = p3_history.build_shard(pa.table({"segment": ["history"] * n, "shard": [0] * n, **name, "first": list(range(n))}))
    asked = pa.table({"batch_no": pa.array([1] * n, pa.int32()), **name, "entry": list(range(n)), "own": [True] * n})
    assert sorted((r["entry"], r["first"]) for r in p3_history.searcher({})(graphs, asked).to_pylist()) == [(i, i) for i in range(n)]


@pytest.mark.parametrize("own", [False, True])
def test_p3_graph_settles_names(monkeypatch, own):
    """What the graph reaches in an earlier segment ends the comparison; in the own one the smallest id counts."""
    n = 3000
    name = {"gate": ["ticket|77|fold|1||"] * n, "words": [f"w{i:04d}||" for i in range(n)], "raw": [f"w{i:04d}" for i in range(n)], "group_key": ["g"] * n}
    graphs = p3_history.build_shard(pa.table({"segment": ["history"] * n, "shard": [0] * n, **name, "first": list(range(n))}))
    asked = pa.table({"batch_no": pa.array([1] * n, pa.int32()), **name, "entry": list(range(n)), "own": [own] * n})
    compared = []
    monkeypatch.setattr(p3_history, "same_words", lambda a, b, unknown: compared.append(a) or a == b)
    assert sorted(r["entry"] for r in p3_history.searcher({})(graphs, asked).to_pylist()) == list(range(n))
    assert len(compared) == n * n if own else len(compared) < n * n / 2


def test_p3_covering():
    def places(segment):
        level, at = map(int, segment.split("-"))
        return list(range(at * p3_history.MERGE**level, (at + 1) * p3_history.MERGE**level))

    for n in (0, 1, 2, 8, 9, 70, 130):
        segments = p3_history.covering(n)
        assert [p for s in segments for p in places(s)] == list(range(n))
        assert set(segments) <= set(p3_history.completed(0, n))
    assert p3_history.completed(7, 9) == {"0-7": range(7, 8), "0-8": range(8, 9), "1-0": range(8)}


def test_p3_near_words():
    unknown = lambda w: w not in ("maps", "home")
    assert p3_history.same_words("zephyr.maps|fold|photo", "zehpyr.maps|fold|photo", unknown)
    assert not p3_history.same_words("maps||", "mapp.s||", unknown) and not p3_history.same_words("zephyr||photo", "zehpyr||", unknown)
    assert not p3_history.same_words("maps||", "home||", unknown) and p3_history.same_words("home||", "home||", lambda w: False)
    assert not p3_history.same_words("home||", "hone||", lambda w: False)


def test_p3_batch_by_batch(spark, sf, tmp_path):
    """Adding batches one by one finds what a replay finds; a later batch reads no history rows."""
    whole = {tuple(r) for r in p3_history.replay(spark, sf)[1].collect()}
    p3_history.create_index(spark, str(tmp_path / "index"), p3_history.history_names(spark, sf))
    batches = p3_history.batch_names(spark, sf)
    got = set()
    for b in sorted(r.batch_no for r in batches.select("batch_no").distinct().collect()):
        index = p3_history.Index(spark, str(tmp_path / "index"))  # nothing but the folder is left of the calls before
        found = p3_history.add_batches(index, batches.where(F.col("batch_no") == b))
        assert not any("labels.parquet" in f for f in found.inputFiles())
        got |= {tuple(r) for r in found.collect()}
    assert got == whole and whole
    with pytest.raises(ValueError):
        p3_history.add_batches(p3_history.Index(spark, str(tmp_path / "index")), batches.where("batch_no = 0"))


def test_p3_index(spark, sf):
    rows = p3_history.p3_index(spark, sf).collect()
    assert {r.segment for r in rows} >= {"history", "0-0"} and all(r.lowest_recall >= 0.98 or r.n_whole for r in rows)


def test_small_world():
    rng = np.random.default_rng(2)
    x = np.zeros((5000, 9), np.float32)
    x[:, 0], x[:, 1:] = 2 * rng.integers(0, 5000, 5000), rng.normal(size=(5000, 8)) * 0.4
    graph = small_world.build(x)
    truth, _ = small_world.exhaustive(x, x[:500], 5)
    found, _ = graph.search(x[:500])
    assert len(graph.layers) > 1 and not graph.whole and np.mean([len(set(a) & set(b)) / 5 for a, b in zip(truth.tolist(), found.tolist())]) > 0.97
    odd = small_world.build(rng.normal(size=(3000, 12)).astype(np.float32))  # no order to follow: searched whole
    assert odd.whole or odd.recall >= small_world.WANTED
    ids, _ = odd.search(odd.x[:50])
    assert (ids[:, 0] == odd.order[:50]).all()
    assert small_world.build(np.zeros((1, 9), np.float32)).search(np.zeros((2, 9), np.float32))[0].tolist() == [[0], [0]]


def test_p5_against_divisors(spark, sf):
    available = p5_quota.available_records(spark, sf).collect()
    report = {(r.category, r.form_factor): r for r in p5_quota.p5_report(spark, sf).collect()}
    have = Counter((r.category, r.form_factor) for r in available)
    size = round(p5_quota.FRACTION * len(available))
    order = []
    for (c, f), r in report.items():
        floor = next(t["min_rows"] for t in rows(spark, sf, "quota_targets") if (t["category"], t["form_factor"]) == (c, f))
        order += [(k > floor, (k - 0.5) / r.target_share, (c, f)) for k in range(1, have[c, f] + 1)]
    taken = Counter(cell for *_, cell in sorted(order)[:size])
    assert {k: r.seats for k, r in report.items() if r.seats} == dict(taken)
    sample = p5_quota.p5_sample(spark, sf).collect()
    assert Counter((r.category, r.form_factor) for r in sample) == taken
    assert len({r.sample_id for r in sample}) == len(sample)


def test_degenerate_tables(spark, tmp_path):
    empty = tables.write(spark, tmp_path / "empty")
    odd = tables.write(
        spark, tmp_path / "odd",
        labels=[{"sample_id": 1}, {"sample_id": 2, "path": ""}, {"sample_id": 3, "path": "train/real/" + "é" * 20_000, "source": "real", "split": " TRAIN "}, {"sample_id": 4, "path": "test/synthetic/synth_1.png", "source": "synthetic", "group": "  "}],
        pool_manifest=[{"pool_id": 1, "batch_no": 0}, {"pool_id": 2, "batch_no": 0, "path": "", "group": ""}],
    )
    for folder in (empty, odd):
        assert p2_overlap.p2_found(spark, folder).count() == 0
        assert p3_history.p3_found(spark, folder).count() == 0
        assert p6_splits.divided_sets(spark, folder).count() == 0
        assert p5_quota.p5_found(spark, folder).count() == 0
    assert p6_splits.p6_splits(spark, odd).count() == 4
    assert records.records(spark, odd).count() == 4
    assert p6_splits.p6_shares(spark, empty).count() == 3
    assert p2_overlap.p2_report(spark, odd).where("n_overlapping > 0").count() == 0


@pytest.mark.parametrize("copies", [400])
def test_p2_hot_name(spark, tmp_path, copies):
    """One name with most rows: collapsed before the buckets, expanded in the pairs."""
    path = "{}/real/arco21_settings_home_fold_portrait_0a0b0c0d.png"
    labels = [{"sample_id": i, "path": path.format("train" if i else "test"), "source": "real"} for i in range(copies)]
    folder = tables.write(spark, tmp_path, labels=labels)
    assert p2_overlap.p2_found(spark, folder).count() == copies - 1


def test_p2_short_words_with_a_typing_error(spark):
    """Names of equal gate and corrected words meet, however little their spellings have in common."""
    rows = [("g", "photo", "photo", "train"), ("g", "phtoo", "photo", "val"), ("g", "tent", "tent", "val"), ("h", "phtoo", "photo", "test")]
    found = spark.createDataFrame(rows, "gate string, raw string, words string, split string")
    assert [(r.gate, r.train_raw, r.eval_raw) for r in p2_overlap.name_overlaps(found).collect()] == [("g", "photo", "phtoo")]
