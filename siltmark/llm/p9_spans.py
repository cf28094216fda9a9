"""Problem 9: long exact spans shared between records.

Texts are cut into anchored passages of PASSAGE characters: a passage is anchored if its hash is the
smallest of some SPAN - PASSAGE + 1 successive starts. Where two texts share SPAN characters they share
at least one such passage, so nothing is lost. Passages get minwise signatures over the shingles of
their whole words; equal passages always collide in a band, nearly equal ones often do. Colliding
passages make their texts candidates, and the SPAN-character spans around them, compared by 128 bits,
are what texts really share.

No pair is formed to find out what is shared: exact copies are collapsed to one text, of spans that
lie in the same texts one stays, and texts that hold the same spans form a class. Pairs are pairs of
classes. Sets are components over the spans.

Null texts and texts shorter than SPAN share nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siltmark.llm.components import random_mate_components
from siltmark.session import cut_lineage, spread, table

SPAN = 300
PASSAGE = 240
WINDOW = SPAN - PASSAGE + 1
#: Two bands of 4: equal passages always collide; a near one of similarity 0.8 does with probability 0.65.
BANDS, ROWS = 2, 4
SHINGLE = 5
#: Characters that a task works on at a time; longer texts come in overlapping pieces.
PIECE = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Sums:
    """Prefix sums of a polynomial over characters: the hash of any stretch in two lookups."""

    def __init__(self, chars: np.ndarray, base: int = _BASES[0]):
        n = len(chars)
        self.back = self._powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self._powers(base, n), out=self.sums[1:])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, dtype=np.uint64)
        steps[:1] = 1
        return np.multiply.accumulate(steps)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of k characters."""
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.empty(0, dtype=np.uint64)


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width` values, by doubling."""
    done = 1
    while 2 * done <= width:
        a, done = pick(a[: len(a) - done], a[done:]), 2 * done
    return pick(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of about PIECE characters: (characters, and of each piece: text, offset in it, first character).

    Every run of SPAN characters of a text lies whole in one of its pieces.
    """
    held, owner, offset, size = [], [], [], 0

    def packed():
        ends = np.cumsum([len(c) for c in held])
        return np.concatenate(held), np.array(owner), np.array(offset), np.r_[0, ends[:-1]]

    for k, text in enumerate(texts):
        chars = characters(text)
        for at in range(0, max(1, len(chars) - SPAN + 1), PIECE):
            part = chars[at : at + PIECE + SPAN - 1]
            held.append(part), owner.append(k), offset.append(at)
            size += len(part)
            if size >= PIECE:
                yield packed()
                held, owner, offset, size = [], [], [], 0
    if held:
        yield packed()


def _starts(n: int, first: np.ndarray, k: int) -> np.ndarray:
    """Which of the n characters start a run of k that stays in one piece."""
    ends = np.r_[first[1:], n]
    open_ = np.zeros(n + 1, dtype=np.int64)
    lengths = np.maximum(ends - first - k + 1, 0)
    some = lengths > 0
    open_[first[some]] += 1
    np.add.at(open_, first[some] + lengths[some], -1)
    return np.cumsum(open_)[:n] > 0


def anchored(sums: Sums, first: np.ndarray) -> np.ndarray:
    """Positions whose passage has the smallest hash of some WINDOW successive passages of a piece."""
    n = len(sums.sums) - 1
    if n < SPAN:
        return np.empty(0, dtype=np.int64)
    h = sums.grams(PASSAGE)
    h[~_starts(n, first, PASSAGE)[: len(h)]] = _LAST
    least = sliding(h, WINDOW, np.minimum)
    least[~_starts(n, first, SPAN)[: len(least)]] = 0
    none = np.zeros(WINDOW - 1, dtype=np.uint64)
    most = sliding(np.concatenate([none, least, none]), WINDOW, np.maximum)
    return np.flatnonzero((most == h) & (most > 0))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(chars: np.ndarray, sums: Sums, at: np.ndarray) -> np.ndarray:
    """(passage, band) keys: minwise hashes of the shingles of whole words inside each passage.

    Passages of fewer than SHINGLE whole words have the hash of all their characters.
    """
    blank = (chars <= 32) | (chars == 0x85) | (chars == 0xA0) | ((chars >= 0x2000) & (chars <= 0x200A)) | (chars == 0x2028) | (chars == 0x2029) | (chars == 0x3000)
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    keys = np.repeat(sums.between(at, at + PASSAGE)[:, None], BANDS, axis=1) + np.arange(BANDS, dtype=np.uint64)
    # words with a blank on either side inside the passage
    low, high = np.searchsorted(starts, at + 1), np.searchsorted(ends, at + PASSAGE - 1, side="right")
    some = np.flatnonzero(high - low >= SHINGLE)
    if len(some):
        word = sums.between(starts, ends)
        shingle = np.zeros(len(word) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            shingle = shingle * np.uint64(_BASES[1]) + word[k : len(word) - SHINGLE + 1 + k]
        bounds = np.stack([low[some], high[some] - SHINGLE + 1], axis=1).ravel()
        signature = np.empty((len(some), BANDS * ROWS), dtype=np.uint64)
        for r, (a, b) in enumerate(zip(*_coefficients())):
            signature[:, r] = np.minimum.reduceat(np.r_[_mix(shingle * a + b), _LAST], bounds)[::2]
        for k in range(BANDS):
            key = np.full(len(some), k + 1, dtype=np.uint64)
            for r in range(k * ROWS, (k + 1) * ROWS):
                key = _mix(key * np.uint64(_BASES[1]) + signature[:, r])
            keys[some, k] = key
    return keys


def passages(texts: list[str]) -> Iterator[tuple]:
    """Per block: (characters, (text, offset, first character) of the pieces, sums, piece of each anchor, anchors, keys)."""
    for chars, owner, offset, first in pieces(texts):
        sums = Sums(chars)
        at = anchored(sums, first)
        piece = np.searchsorted(first, at, side="right") - 1
        yield chars, (owner, offset, first), sums, piece, at, band_keys(chars, sums, at)


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = batch.doc_id.to_numpy()
        for _, (owner, _, _), _, piece, _, keys in passages(batch.text.tolist()):
            if len(piece):
                flat = pd.DataFrame({"key": keys.astype(np.int64).ravel(), "doc_id": np.repeat(ids[owner[piece]], BANDS)})
                yield flat.drop_duplicates()


SPANS = "key long, again long, doc_id long, at int, n int"


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans around the passages whose keys are shared; n successive equal spans (of one repeated character) are one row."""
    for batch in batches:
        ids, wanted = batch.doc_id.to_numpy(), [np.sort(np.asarray(k, dtype=np.int64)) for k in batch["keys"]]
        for chars, (owner, offset, first), sums, piece, at, keys in passages(batch.text.tolist()):
            if not len(at):
                continue
            found = np.zeros(len(at), dtype=bool)
            for k in np.unique(piece).tolist():
                own = np.flatnonzero(piece == k)
                found[own] = np.isin(keys[own].astype(np.int64), wanted[owner[k]]).any(axis=1)
            around = np.zeros(len(chars) + 1, dtype=np.int64)
            np.add.at(around, np.maximum(at[found] - WINDOW + 1, 0), 1)
            np.add.at(around, at[found] + 1, -1)
            spans = np.flatnonzero((np.cumsum(around)[: len(chars)] > 0) & _starts(len(chars), first, SPAN))
            if not len(spans):
                continue
            key = sums.between(spans, spans + SPAN).astype(np.int64)
            again = Sums(chars, _BASES[1]).between(spans, spans + SPAN).astype(np.int64)
            of = np.searchsorted(first, spans, side="right") - 1
            new = np.r_[True, (np.diff(spans) != 1) | (np.diff(key) != 0) | (np.diff(of) != 0)]
            heads = np.flatnonzero(new)
            n = np.diff(np.r_[heads, len(spans)])
            yield pd.DataFrame({"key": key[heads], "again": again[heads], "doc_id": ids[owner[of[heads]]], "at": (spans[heads] - first[of[heads]] + offset[of[heads]]).astype(np.int32), "n": n.astype(np.int32)})


def text_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id) of texts of at least SPAN characters; class_id is the smallest doc_id of equal texts."""
    hashed = documents.where(F.length("text") >= SPAN).select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("class_id"))
    return hashed.join(first, "h").select("doc_id", "class_id")


def shared_spans(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """Checkpointed (key, again, doc_id, at, n) of the spans that different texts share; doc_id is the smallest of its class."""
    texts = documents.select("doc_id", "text").where(F.length("text") >= SPAN)
    texts = texts.join(classes.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    prints = cut_lineage(spread(texts).mapInPandas(_fingerprints, "key long, doc_id long"))
    common = prints.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    wanted = prints.join(common, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # bounded by the text's length
    spans = cut_lineage(texts.join(wanted, "doc_id").mapInPandas(_spans, SPANS))
    shared = spans.groupBy("key", "again").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key", "again")
    return cut_lineage(spans.join(shared, ["key", "again"], "left_semi"))


def _same(df: DataFrame, of: str, by: list[str]) -> DataFrame:
    """`of` with three numbers that tell the set of its `by` rows, without collecting the set."""
    h = F.xxhash64(*by)
    return df.groupBy(of).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.shiftright(h, 20)).alias("__s"), F.bit_xor(h).alias("__x"))


def span_classes(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, span_class), (key, span_class)), both checkpointed, of texts that share spans.

    Texts with the same shared spans are one class, named by its smallest doc_id. Of the spans that lie
    in the same texts one key stays.
    """
    held = spans.select(F.xxhash64("key", "again").alias("key"), "doc_id").distinct()
    tell = ["__n", "__s", "__x"]
    kept = _same(held, "key", ["doc_id"]).groupBy(*tell).agg(F.min("key").alias("key")).select("key")
    held = cut_lineage(held.join(kept, "key"))
    told = _same(held, "doc_id", ["key"])
    first = told.groupBy(*tell).agg(F.min("doc_id").alias("span_class"))
    members = cut_lineage(told.join(first, tell).select("doc_id", "span_class"))
    heads = members.where("doc_id = span_class").select("doc_id")
    return members, cut_lineage(held.join(heads, "doc_id", "left_semi").select("key", F.col("doc_id").alias("span_class")))


def class_pairs(held: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of classes that share a span: the links themselves, one row for any number of spans."""
    left, right = held.select("key", F.col("span_class").alias("a")), held.select("key", F.col("span_class").alias("b"))
    return left.join(right, "key").where("a < b").select("a", "b").distinct()


def _members(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, class_id, group) of all documents of at least SPAN characters; texts that share no span are groups of their copies."""
    return classes.join(found.select(F.col("doc_id").alias("class_id"), "span_class"), "class_id", "left").select("doc_id", "class_id", F.coalesce("span_class", "class_id").alias("group"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share at least SPAN successive characters exactly as stored."""
    documents = table(spark, sf_dir, "documents")
    classes = cut_lineage(text_classes(documents))
    found, held = span_classes(shared_spans(documents, classes))
    member = _members(classes, found).select("group", "doc_id")
    pairs = class_pairs(held)
    across = pairs.join(member.select(F.col("group").alias("a"), F.col("doc_id").alias("x")), "a").join(member.select(F.col("group").alias("b"), F.col("doc_id").alias("y")), "b")
    within = member.select("group", F.col("doc_id").alias("x")).join(member.select("group", F.col("doc_id").alias("y")), "group").where("x < y")
    every = across.select("x", "y").unionByName(within.select("x", "y"))
    return every.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the part of it that other documents share, and its set.

    n_chars and shared_chars are counted; shared_part is their ratio (0 for null and empty texts);
    partners counts documents that share a span; first_id is the smallest doc_id of the set linked by
    shared spans, the own one for documents that share nothing. No pair of documents is formed.
    """
    documents = table(spark, sf_dir, "documents")
    classes = cut_lineage(text_classes(documents))
    spans = shared_spans(documents, classes)
    found, held = span_classes(spans)
    member = cut_lineage(_members(classes, found))
    following = Window.partitionBy("doc_id").orderBy("at")  # one text's spans
    ends = spans.select("doc_id", "at", (F.col("at") + F.col("n") + SPAN - 1).alias("end"), F.lead("at").over(following).alias("next"))
    covered = ends.groupBy(F.col("doc_id").alias("class_id")).agg(F.sum(F.least("end", F.coalesce("next", "end")) - F.col("at")).alias("covered"))
    copies = member.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    sizes = member.groupBy("group").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("least"))
    pairs = class_pairs(held)
    both = pairs.select(F.col("a").alias("group"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("group"), F.col("a").alias("other")))
    others = both.join(sizes.select(F.col("group").alias("other"), F.col("held").alias("there")), "other").groupBy("group").agg(F.sum("there").alias("others"))
    star = held.groupBy("key").agg(F.min("span_class").alias("v"))
    roots = random_mate_components(held.join(star, "key").select(F.col("span_class").alias("u"), "v").where("u <> v"))
    firsts = roots.join(sizes.select(F.col("group").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("first_id"))
    sets = roots.join(firsts, "root").select(F.col("node").alias("group"), "first_id")
    per_group = sizes.join(others, "group", "left").join(sets, "group", "left").select("group", (F.col("held") + F.coalesce("others", F.lit(0)) - 1).alias("partners"), F.coalesce("first_id", "least").alias("first_id"))
    info = member.join(copies, "class_id").join(covered, "class_id", "left").join(per_group, "group")
    out = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(info, "doc_id", "left")
    shared = F.when(F.col("copies") > 1, F.col("n")).otherwise(F.coalesce(F.col("covered"), F.lit(0)))
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        shared.cast("long").alias("shared_chars"),
        F.round(F.coalesce(F.try_divide(shared.cast("double"), F.col("n").cast("double")), F.lit(0.0)), 6).alias("shared_part"),
        F.coalesce("partners", F.lit(0)).cast("long").alias("partners"),
        F.coalesce("first_id", "doc_id").alias("first_id"),
    )
