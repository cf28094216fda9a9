"""Training and application of the projection head, with out-of-fold scores.

The head is small (LayerNorm, linear, GELU, linear, unit length; a linear classifier on top), so it
is fitted with numpy on the driver, on at most `most_rows` labelled rows taken in hash order.
Applying it is distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siltmark.operators.splits import grouped_kfold

Params = dict[str, np.ndarray]


@dataclass
class HeadConfig:
    hidden: int = 128
    out: int = 64
    classes: int = 5
    temperature: float = 0.1
    aux_weight: float = 0.5
    rate: float = 1e-3
    decay: float = 1e-4
    epochs: int = 40
    per_class: int = 16
    patience: int = 10
    margin: float = 1e-4
    most_rows: int = 20_000
    seed: int = 0


def start(width: int, cfg: HeadConfig) -> Params:
    rng = np.random.default_rng(cfg.seed)
    layer = lambda a, b: rng.normal(0, (2.0 / (a + b)) ** 0.5, (a, b))
    return {"g": np.ones(width), "b": np.zeros(width), "w1": layer(width, cfg.hidden), "b1": np.zeros(cfg.hidden), "w2": layer(cfg.hidden, cfg.out), "b2": np.zeros(cfg.out), "wa": layer(cfg.out, cfg.classes), "ba": np.zeros(cfg.classes)}


def forward(p: Params, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """(z of unit length, class logits, what the gradient needs)."""
    centred = x - x.mean(axis=1, keepdims=True)
    scale = 1 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5)
    n = centred * scale
    h = (n * p["g"] + p["b"]) @ p["w1"] + p["b1"]
    t = np.tanh(0.7978845608 * (h + 0.044715 * h**3))
    a = 0.5 * h * (1 + t)
    o = a @ p["w2"] + p["b2"]
    length = np.sqrt((o**2).sum(axis=1, keepdims=True)) + 1e-12
    z = o / length
    return z, z @ p["wa"] + p["ba"], {"n": n, "h": h, "t": t, "a": a, "z": z, "length": length}


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def contrastive(z: np.ndarray, y: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Supervised contrastive loss of a batch and its gradient by z; anchors without a positive are left out."""
    s = z @ z.T / temperature
    np.fill_diagonal(s, -np.inf)
    q = softmax(s)
    same = (y[:, None] == y[None, :]) & ~np.eye(len(y), dtype=bool)
    count = same.sum(axis=1)
    used = count > 0
    if not used.any():
        return 0.0, np.zeros_like(z)
    target = same / np.maximum(count, 1)[:, None]
    top = s.max(axis=1, keepdims=True)
    lse = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
    mean = np.where(same, s, 0).sum(axis=1) / np.maximum(count, 1)
    g = (q - target) * used[:, None] / used.sum() / temperature
    return float((lse - mean)[used].mean()), (g + g.T) @ z


def gradient(p: Params, x: np.ndarray, y: np.ndarray, cfg: HeadConfig) -> tuple[float, Params]:
    z, logits, c = forward(p, x)
    loss, dz = contrastive(z, y, cfg.temperature)
    prob = softmax(logits)
    loss += cfg.aux_weight * float(-np.log(prob[np.arange(len(y)), y] + 1e-12).mean())
    dl = cfg.aux_weight * (prob - np.eye(cfg.classes)[y]) / len(y)
    dz = dz + dl @ p["wa"].T
    do = (dz - z * (dz * z).sum(axis=1, keepdims=True)) / c["length"]
    dh = (do @ p["w2"].T) * (0.5 * (1 + c["t"]) + 0.5 * c["h"] * (1 - c["t"] ** 2) * 0.7978845608 * (1 + 3 * 0.044715 * c["h"] ** 2))
    dn = dh @ p["w1"].T
    return loss, {"g": (dn * c["n"]).sum(axis=0), "b": dn.sum(axis=0), "w1": (c["n"] * p["g"] + p["b"]).T @ dh, "b1": dh.sum(axis=0), "w2": c["a"].T @ do, "b2": do.sum(axis=0), "wa": z.T @ dl, "ba": dl.sum(axis=0)}


def balanced_batches(y: np.ndarray, per_class: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Batches with `per_class` rows of every class; small classes repeat, until the largest is through."""
    rows = {c: np.flatnonzero(y == c) for c in np.unique(y)}
    for _ in range(max(1, max(len(r) for r in rows.values()) // per_class)):
        yield np.concatenate([rng.choice(r, per_class, replace=len(r) < per_class) for r in rows.values()])


def fit(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, cfg: HeadConfig) -> tuple[Params, list[dict]]:
    """Parameters of the best epoch by the loss on held rows, and the history."""
    rng = np.random.default_rng(cfg.seed + 1)
    p = start(x.shape[1], cfg)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    best, kept, wait, step, history = np.inf, p, 0, 0, []
    for epoch in range(cfg.epochs):
        losses = []
        for rows in balanced_batches(y, cfg.per_class, rng):
            loss, g = gradient(p, x[rows], y[rows], cfg)
            losses.append(loss)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] * (1 - cfg.rate * cfg.decay) - cfg.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        prob = softmax(forward(p, held_x)[1]) if len(held_x) else None
        held = float(-np.log(prob[np.arange(len(held_y)), held_y] + 1e-12).mean()) if prob is not None else float(np.mean(losses))
        history.append({"epoch": epoch, "loss": float(np.mean(losses)), "held": held})
        if held < best - cfg.margin:
            best, kept, wait = held, {k: a.copy() for k, a in p.items()}, 0
        else:
            wait += 1
            if wait >= cfg.patience:
                break
    return kept, history


def bounded_rows(df: DataFrame, vector: str, label: str, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most_rows` labelled vectors, in hash order of their id."""
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select("id", vector, label).orderBy(F.xxhash64("id"), "id").limit(most_rows).toPandas()
    x = np.stack(rows[vector].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))
    return x, rows[label].to_numpy().astype(int)


def fit_head(df: DataFrame, vector: str, label: str, cfg: HeadConfig) -> tuple[Params, list[dict]]:
    """Fit on the bounded sample; a fifth of it is held to choose the epoch."""
    x, y = bounded_rows(df, vector, label, cfg.most_rows)
    held = np.arange(len(y)) % 5 == 0
    return fit(x[~held], y[~held], x[held], y[held], cfg)


def apply_head(df: DataFrame, vector: str, params: Params, keep: list[str]) -> DataFrame:
    """`keep` with z, class probabilities and aux_err = 1 - P(class 0), by partition."""
    shared = df.sparkSession.sparkContext.broadcast(params)  # a few hundred thousand numbers, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z, logits, _ = forward(shared.value, np.stack(batch[vector].to_numpy()).astype(np.float64))
                prob = softmax(logits)
                yield batch[keep].assign(z=list(z), aux=list(prob), aux_err=1 - prob[:, 0])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "z array<double>", "aux array<double>", "aux_err double"])
    return df.where(F.col(vector).isNotNull()).select(*dict.fromkeys([*keep, vector])).mapInPandas(run, schema)


def out_of_fold(df: DataFrame, vector: str, label: str, group: str, folds: int, cfg: HeadConfig) -> DataFrame:
    """Every row scored by a head that saw none of its group; the folds run one after the other."""
    folded = grouped_kfold(df, group, folds, cfg.seed)
    out = None
    for fold in range(folds):
        params, _ = fit_head(folded.where(F.col("fold") != fold), vector, label, cfg)
        part = apply_head(folded.where(F.col("fold") == fold), vector, params, ["id", label, group, "fold"])
        out = part if out is None else out.unionByName(part)
    return out
