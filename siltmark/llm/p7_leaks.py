"""Problem 7: evaluation passages leaking into a corpus.

The words of every text are read once, as 64-bit hashes in a table in the shared folder. A text is a row of
blocks of RUN words; two neighbouring blocks are a passage, so each run of RUN words lies whole in some
passage. Hashed word counts of the passages are weighted by TF-IDF over the whole corpus, and a randomised
SVD of the passage matrix gives a latent space: each pass sums the projection of all passages by
feature in the cluster, only feature x rank matrices reach the driver. All sums are made per block
and added for the two passages it lies in.

Passages whose cosine to a piece of an item reaches COSINE are candidates; the longest common run, the
longest common subsequence of words and, for paraphrases, the item's rarest words decide. Runs of RUN
words that the retrieval does not reach are asked for in the table of all runs of all items, so the
threshold drops none.

Items come to the tasks in groups of at most ITEMS (eval_passages has 240 rows at every scale).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.llm.words import words_of
from siltmark.session import cut_lineage, spread, table

#: Successive words that make a leak, and words of a block; a passage has two.
RUN = 13
FEATURES, RANK, EXTRA, POWER_PASSES = 4096, 48, 16, 1
#: Words that a task holds at a time; longer texts come in pieces that share a block. Passages multiplied at a time.
WORDS, PASSAGES = RUN * 2520, 512
#: An item is asked for in pieces of RUN words, PIECE_STEP apart.
PIECE_STEP = 3
COSINE = 0.45
#: A paraphrase has this part of the item's words in order, within twice the item's length,
PARAPHRASE, PARAPHRASE_COSINE = 0.8, 0.8
#: and this part of the item's ANSWERS rarest words.
ANSWERS, ANSWERED = 5, 0.6
#: Items that are sent to the tasks together.
ITEMS = 4096

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(RUN)], dtype=np.uint64)


def word_ids(words: list[str], memo: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words."""
    if len(memo) > 1 << 19:
        memo.clear()
    return np.fromiter((memo[w] if w in memo else memo.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words), dtype=np.uint64, count=len(words))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for batch in batches:
        words = [word_ids(words_of(t), memo).tobytes() for t in batch.text]
        out = pd.DataFrame({"doc_id": batch.doc_id, "words": words})
        yield out[[len(w) > 0 for w in words]]


def worded(documents: DataFrame) -> DataFrame:
    """Checkpointed (doc_id, words) of the texts that have any; nothing reads the texts again."""
    return cut_lineage(spread(documents.select("doc_id", "text")).mapInPandas(_hashed, "doc_id long, words binary"))


@dataclass
class Slice:
    """Words of several texts, cut into blocks: text and first word of each block, and the blocks of each passage."""

    words: np.ndarray
    text: np.ndarray
    first: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def __post_init__(self) -> None:
        self.feature = (self.words % np.uint64(FEATURES)).astype(np.int64)

    def sums(self, onto: np.ndarray) -> np.ndarray:
        """Sum of the rows of `onto` over the words of each passage."""
        per = np.add.reduceat(onto[self.feature], self.first, axis=0)
        return np.where((self.left == self.right)[:, None], per[self.left], per[self.left] + per[self.right])

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, feature, count) of what occurs, and where a feature of a passage stands in both blocks: (cell of the left one, of the right one)."""
        block = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(self.words)]))
        cell, count = np.unique(block * FEATURES + self.feature, return_counts=True)
        follows = np.zeros(len(self.first), dtype=bool)
        follows[self.left[self.left != self.right]] = True
        own = np.flatnonzero(follows[cell // FEATURES])
        at = np.minimum(np.searchsorted(cell, cell[own] + FEATURES), len(cell) - 1)
        both = cell[at] == cell[own] + FEATURES
        return cell // FEATURES, cell % FEATURES, count, own[both], at[both]


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[np.ndarray], Slice]]:
    """(doc_id of each text, words of each text, its blocks), about WORDS words at a time; every passage lies whole in one piece."""
    ids, held, parts, size = [], [], [], 0

    def packed():
        owner, first, left, right, at, base = [], [], [], [], 0, 0
        for k, part in enumerate(parts):
            n = -(-len(part) // RUN)
            owner.append(np.full(n, k)), first.append(at + RUN * np.arange(n))
            pairs = np.arange(max(1, n - 1)) + base
            left.append(pairs), right.append(pairs + (n > 1))
            at, base = at + len(part), base + n
        join = np.concatenate
        return np.array(ids), held, Slice(join(parts), join(owner), join(first), join(left), join(right))

    for batch in batches:
        for doc, words in zip(batch.doc_id, batch.words):
            words = np.frombuffer(words, dtype=np.uint64)
            for at in range(0, max(1, len(words) - RUN), WORDS):
                part = words[at : at + WORDS + RUN]
                ids.append(doc), held.append(words), parts.append(part)
                size += len(part)
                if size >= WORDS:
                    yield packed()
                    ids, held, parts, size = [], [], [], 0
    if parts:
        yield packed()


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, passages = np.zeros(FEATURES), 0
    for _, _, s in slices(batches):
        block, feature, _, left, _ = s.cells()
        inside = np.bincount(s.left, minlength=len(s.first)) + np.bincount(s.right[s.left != s.right], minlength=len(s.first))
        total += np.bincount(feature, inside[block], FEATURES) - np.bincount(feature[left], minlength=FEATURES)
        passages += len(s.left)
    used = np.flatnonzero(total)
    yield pd.DataFrame({"feature": np.r_[used, -1].astype(np.int32), "n": np.r_[total[used], passages].astype(np.int64)})


def inverse_frequencies(words: DataFrame) -> np.ndarray:
    """Weight of each hashed feature over the passages of all documents."""
    counted = words.mapInPandas(_counts, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = {r.feature: r.n for r in counted.collect()}  # at most FEATURES + 1 rows
    passages = found.pop(-1, 0)
    frequency = np.zeros(FEATURES)
    for k, n in found.items():
        frequency[k] = n
    return (np.log((1 + passages) / (1 + frequency)) + 1).astype(np.float32)


def _gram_times(words: DataFrame, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis, where A has a unit TF-IDF row for every passage of every document."""
    width = basis.shape[1]
    shared = words.sparkSession.sparkContext.broadcast((weights, (weights[:, None] * basis).astype(np.float32)))  # FEATURES x (RANK + EXTRA + 1) numbers

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, onto = shared.value
        total = np.zeros((FEATURES, width))
        for _, _, s in slices(batches):
            block, feature, count, left, right = s.cells()
            own = np.bincount(block, (count * weight[feature]) ** 2, len(s.first))
            across = np.bincount(block[left], 2 * count[left] * count[right] * weight[feature[left]] ** 2, len(s.first))
            two = s.left != s.right
            square = own[s.left] + np.where(two, own[s.right] + across[s.left], 0)
            projected = s.sums(onto) / square[:, None].astype(np.float32)
            # what a block's words add to is the sum over the passages it lies in
            back = np.zeros((len(s.first), width), dtype=np.float32)
            back[s.left] += projected
            back[s.right[two]] += projected[two]
            order = np.argsort(feature, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(feature[order])) + 1]
            sums = np.add.reduceat(count[order, None].astype(np.float32) * back[block[order]], edges, axis=0)
            total[feature[order[edges]]] += sums
        total *= weight[:, None]
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"feature": used.astype(np.int32), "y": pd.Series(list(total[used]), dtype=object)})

    sums = [F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(width)]
    out = np.zeros((FEATURES, width))
    for r in words.mapInPandas(partial, "feature int, y array<double>").groupBy("feature").agg(F.array(*sums).alias("y")).toLocalIterator():
        out[r.feature] = r.y
    shared.unpersist()
    return out


def latent_space(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(weights, directions): TF-IDF weights and the RANK leading right singular vectors."""
    weights = inverse_frequencies(words)
    basis = np.random.default_rng(7).standard_normal((FEATURES, RANK + EXTRA))
    for _ in range(POWER_PASSES):
        basis, _ = np.linalg.qr(_gram_times(words, weights, basis))
    image = _gram_times(words, weights, basis)
    values, vectors = np.linalg.eigh((small := basis.T @ image) + small.T)
    return weights, (basis @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def common_run(a: list, b: list) -> int:
    """Length of the longest run of successive words that stands in both."""
    best, before = 0, {}
    where: dict[object, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    for w in a:
        now = {j: before.get(j - 1, 0) + 1 for j in where.get(w, ())}
        best = max(best, max(now.values(), default=0))
        before = now
    return best


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[object, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def runs_of(words: np.ndarray) -> np.ndarray:
    """One number per run of RUN words."""
    n = len(words) - RUN + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(RUN if n > 0 else 0):
        out += words[k : k + n] * _FACTORS[k]
    return out ^ (out >> np.uint64(29))


@dataclass
class Asked:
    """Items ready for the search: names, words, rarest words, latent pieces, and all runs of all items in order."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    onto: np.ndarray
    latent: np.ndarray
    owner: np.ndarray
    run: np.ndarray
    run_item: np.ndarray
    run_at: np.ndarray


def ask(items: list[tuple[int, list[str]]], weights: np.ndarray, directions: np.ndarray) -> Asked:
    memo: dict[str, int] = {}
    words = [word_ids(w, memo) for _, w in items]
    onto = weights[:, None] * directions
    pieces, owner, runs = [], [], []
    for k, own in enumerate(words):
        starts = sorted({*range(0, len(own) - RUN + 1, PIECE_STEP), len(own) - RUN})
        pieces += [onto[(own[s : s + RUN] % np.uint64(FEATURES)).astype(np.int64)].sum(axis=0) for s in starts]
        owner += [k] * len(starts)
        runs.append(runs_of(own))
    answers = []
    for own in words:
        different = np.unique(own)
        rarest = np.lexsort((different, -weights[(different % np.uint64(FEATURES)).astype(np.int64)]))[:ANSWERS]
        answers.append(different[rarest])
    run = np.concatenate(runs)
    order = np.argsort(run, kind="stable")
    item = np.repeat(np.arange(len(items)), [len(r) for r in runs])[order]
    at = np.concatenate([np.arange(len(r)) for r in runs])[order]
    return Asked([i for i, _ in items], words, answers, onto, _unit(np.stack(pieces)), np.array(owner), run[order], item, at)


def retrieved(s: Slice, asked: Asked) -> dict[tuple[int, int], float]:
    """(text, item) -> largest cosine of a passage and a piece, of those that reach COSINE."""
    x = _unit(s.sums(asked.onto))
    text, n = s.text[s.left], len(asked.ids)
    code, value = [], []
    for low in range(0, len(x), PASSAGES):
        cosine = (x[low : low + PASSAGES] @ asked.latent.T).ravel()
        hit = np.flatnonzero(cosine >= COSINE)
        code.append(text[low + hit // len(asked.owner)] * n + asked.owner[hit % len(asked.owner)])
        value.append(cosine[hit])
    code, value = np.concatenate(code), np.concatenate(value)
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order], prepend=-1))
    best = np.maximum.reduceat(value[order], edges) if len(edges) else np.empty(0)
    return {divmod(c, n): v for c, v in zip(code[order[edges]].tolist(), best.tolist())}


def repeated(words: np.ndarray, asked: Asked) -> set[int]:
    """Items of which the text repeats RUN successive words."""
    run = runs_of(words)
    low, high = np.searchsorted(asked.run, run), np.searchsorted(asked.run, run, side="right")
    out: set[int] = set()
    for i in np.flatnonzero(high > low).tolist():
        for j in range(int(low[i]), int(high[i])):
            k, at = int(asked.run_item[j]), int(asked.run_at[j])
            if k not in out and np.array_equal(words[i : i + RUN], asked.words[k][at : at + RUN]):
                out.add(k)
    return out


SCHEMA = "item_id long, doc_id long, cosine double, run int, part double, answered double"


def answering(words: np.ndarray, asked: Asked, items: list[int]) -> list[int]:
    """Of the items those of whose rarest words, and of whose words, the text holds enough for a paraphrase."""
    known = np.unique(words)

    def held(of: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(of)
        hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
        return np.add.reduceat(hit, np.r_[0, np.cumsum([len(o) for o in of])[:-1]]) / np.array([len(o) for o in of])

    left = [k for k, part in zip(items, held([asked.answers[k] for k in items])) if part >= ANSWERED]
    # the subsequence is no longer than the item's words that occur at all
    return [k for k, part in zip(left, held([asked.words[k] for k in left])) if part >= PARAPHRASE] if left else []


def paraphrased(item: np.ndarray, own: list[int], answers: set[int]) -> tuple[float, float]:
    """(part of the item's words in order, part of its rarest words) of the best stretch of a text."""
    best = (0.0, 0.0)
    wanted = item.tolist()
    for start in range(0, max(1, len(own) - len(wanted)), len(wanted)):
        stretch = own[start : start + 2 * len(wanted)]
        best = max(best, (common_subsequence(wanted, stretch) / len(wanted), len(answers & set(stretch)) / len(answers)))
    return best


def search_words(words: DataFrame, items: list[tuple[int, list[str]]], weights: np.ndarray, directions: np.ndarray) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast(ask(items, weights, directions))  # at most ITEMS items

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        for ids, held, s in slices(batches):
            found = retrieved(s, asked)
            ends = np.r_[s.first[np.searchsorted(s.text, np.arange(1, len(ids)))], len(s.words)]
            exact = {(t, k) for t, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)) for k in repeated(s.words[a:b], asked)}
            near: dict[int, list[int]] = {}
            for (t, k), c in found.items():
                if c >= PARAPHRASE_COSINE and (t, k) not in exact:
                    near.setdefault(t, []).append(k)
            rows = []
            for t, k in sorted(exact | {(t, k) for t, items in near.items() for k in answering(held[t], asked, items)}):
                item, own = asked.words[k], held[t].tolist()
                part, answered = paraphrased(item, own, set(asked.answers[k].tolist()))
                if (t, k) in exact or (part >= PARAPHRASE and answered >= ANSWERED):
                    rows.append((asked.ids[k], ids[t], found.get((t, k)), common_run(item.tolist(), own), part, answered))
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "cosine", "run", "part", "answered"]).astype({"item_id": "int64", "doc_id": "int64", "cosine": float, "run": "int32", "part": float, "answered": float})

    return words.mapInPandas(search, SCHEMA)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, cosine, run, part, answered) of documents that repeat RUN words of an item or paraphrase it.

    `run` is the longest common run of words, `part` the part of the item's words that stands in
    order within a stretch of the document, `answered` the part of its rarest words there; `cosine` is
    null where the retrieval did not reach the document. Null and blank documents and items shorter than
    RUN words leak nothing. A document that is longer than a piece may come out once per piece.
    """
    spark = documents.sparkSession
    groups = max(1, -(-items.count() // ITEMS))
    found, space = spark.createDataFrame([], SCHEMA), None
    words = worded(documents)
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).select("item_id", "text").collect()  # about ITEMS rows
        own = [(r.item_id, w) for r in rows if len(w := words_of(r.text)) >= RUN]
        if own:
            space = space or latent_space(words)
            found = found.unionByName(search_words(words, own, *space))
    return found


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where(F.col("run") >= RUN).select("item_id", "doc_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks, paraphrases included, with their measures."""
    per = _leaks(spark, sf_dir).groupBy("item_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("cosine", "run", "part", "answered")])
    return per.withColumns({c: F.round(c, 4) for c in ("cosine", "part", "answered")})


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split of the items: items, items that leaked, documents that hold passages of them."""
    items = table(spark, sf_dir, "eval_passages").select("item_id", "split")
    found = p7_found(spark, sf_dir)
    per = items.join(found, "item_id", "left").groupBy("split").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct(F.when(F.col("doc_id").isNotNull(), F.col("item_id"))).alias("n_leaked"), F.countDistinct("doc_id").alias("n_documents"))
    return per
