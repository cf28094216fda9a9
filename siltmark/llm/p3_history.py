"""Problem 3: deduplicating new batches against all history, with a stored index of graph shards.

An index is a folder. `create_index` writes the segment of the accepted history and the lexicon of its
names, which stays as it is from then on. `add_batches` takes new batches only: it searches the stored
segments that cover what came before, then each batch's own segment for rows earlier in it, and adds a
segment per batch. Every MERGE batches (MERGE squared, and so on) are compacted into a larger segment from the
names stored with them, so a batch meets at most MERGE - 1 segments of each size. History rows
are never read again. Replaying many batches in one call gives what one call per batch gives.

A segment has shards of about SHARD_ROWS names, each a layered small-world graph (see `small_world`). The
shard of a name follows from its gate, which is never mistyped, so a search goes to one shard of a
segment, and ends at once if the shard holds no name of that gate. A name and its group become a short
vector: the rank of the gate among those of the shard, letter triples of the words as typed, and the group.
Beams are tuned per shard against exhaustive search, which takes over where the graph falls short.
What is found is reranked exactly: same gate and group, and words that agree after correction or, where
the lexicon knows one of two words not at all, but for one typing error each. In an earlier segment one match
that the graph reaches settles a name; only where it reaches none, or in the own segment where the smallest
id counts, the other names of the gate and group are compared, so a narrow beam loses nothing.

Rows without a readable name or without a group bring something new by definition.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.llm import names, small_world
from siltmark.session import cut_lineage, ensure_checkpoint_dir, spread, table

SHARD_ROWS = 16384
MERGE = 8
#: Queries of one shard that a task answers together.
CHUNK_ROWS = 65536
TRIPLES, GROUP = 8, 8
#: Distance of two neighbouring gates, against at most 2 for the words and 2 for the group.
STEP = 2.0
HISTORY = "history"

NAME = ["gate", "words", "raw", "group_key"]
SEARCHED = "batch_no int, entry long, own boolean, first long"
_SEARCHED = pa.schema([("batch_no", pa.int32()), ("entry", pa.int64()), ("own", pa.bool_()), ("first", pa.int64())])
GRAPH = "segment string, shard int, rows long, beam int, recall double, whole boolean, blob binary"
LOG = "kind string, name string, place int, batch_no int, shards int, rows long"


def _signs(text: str, n: int) -> np.ndarray:
    bits = xxhash.xxh64_intdigest(text)
    return np.array([1.0 if bits >> i & 1 else -1.0 for i in range(n)], dtype=np.float32)


def vectors(rank: list[int], raws: list[str], groups: list[str]) -> np.ndarray:
    """Short vectors of names and groups whose gates have the given ranks in a shard."""
    x = np.zeros((len(rank), 1 + TRIPLES + GROUP), dtype=np.float32)
    x[:, 0] = STEP * np.asarray(rank, dtype=np.float32)
    typed: dict[str, np.ndarray] = {}
    grouped: dict[str, np.ndarray] = {}
    for i, (raw, group) in enumerate(zip(raws, groups)):
        if raw not in typed:
            text = f"^{raw}$"
            v = sum((_signs(text[j : j + 3], TRIPLES) for j in range(len(text) - 2)), np.zeros(TRIPLES, np.float32))
            typed[raw] = v / max(1.0, float(np.sqrt(v @ v)))
        if group not in grouped:
            grouped[group] = 0.35 * _signs(group, GROUP)
        x[i, 1 : 1 + TRIPLES], x[i, 1 + TRIPLES :] = typed[raw], grouped[group]
    return x


def gate_order(gate: str) -> tuple[str, int, str]:
    """Near numbers are near, which makes the graph navigable."""
    kind, number, _ = gate.split("|", 2)
    return kind, int(number, 16) if kind == "hash" else int(number or 0), gate


def build_shard(group: pa.Table) -> pa.Table:
    """One graph with its names, and its tuned beam and recall."""
    c = group.to_pydict()
    rank = {g: i for i, g in enumerate(sorted(set(c["gate"]), key=gate_order))}
    graph = small_world.build(vectors([rank[g] for g in c["gate"]], c["raw"], c["group_key"]))
    graph.layers = [layer.astype(np.int32) for layer in graph.layers]
    blob = pickle.dumps((graph, rank, c["gate"], c["words"], c["group_key"], c["first"]), protocol=5)
    row = {"segment": c["segment"][:1], "shard": pa.array(c["shard"][:1], pa.int32()), "rows": pa.array([len(c["gate"])], pa.int64()), "beam": pa.array([graph.beam], pa.int32()), "recall": [graph.recall], "whole": [graph.whole]}
    return pa.table(row | {"blob": pa.array([blob], pa.large_binary() if len(blob) >= 1 << 31 else pa.binary())})


def same_words(a: str, b: str, unknown) -> bool:
    """Equal, or one typing error apart in words of which the lexicon knows at least one not at all."""
    if a == b:
        return True
    (a, *rest_a), (b, *rest_b) = a.split("|"), b.split("|")
    left, right = a.split("."), b.split(".")
    return rest_a == rest_b and len(left) == len(right) and all(x == y or ((unknown(x) or unknown(y)) and names.one_typing_error(x, y)) for x, y in zip(left, right))


def searcher(known: dict[str, int]):
    """Cogrouped function: asked names that a shard holds, with the smallest `first` of the names that match."""

    def search(graphs: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(graphs) and len(asked):
            graph, rank, gates, words, groups, first = pickle.loads(graphs.column("blob")[0].as_buffer())
            held: dict[tuple[str, str], list[int]] = {}
            of_gate: dict[str, int] = {}
            for i, (gate, group) in enumerate(zip(gates, groups)):
                held.setdefault((gate, group), []).append(i)
                of_gate[gate] = of_gate.get(gate, 0) + 1

            def matching(asked_words: str, candidates: Iterable[int], every: bool) -> list[int]:
                """`first` of the candidates that match: of every one, or of one."""
                found = (first[k] for k in candidates if same_words(asked_words, words[k], lambda w: w not in known))
                return list(found if every else islice(found, 1))

            for batch in asked.to_batches(max_chunksize=4 * small_world.BLOCK):
                c = batch.to_pydict()
                # no other name of this gate in the shard: nothing can match but, in the own segment, the name itself
                out += [(b, e, True, e) for b, e, own, g in zip(c["batch_no"], c["entry"], c["own"], c["gate"]) if own and of_gate.get(g) == 1]
                rows = [i for i, (own, g) in enumerate(zip(c["own"], c["gate"])) if of_gate.get(g, 0) > (1 if own else 0)]
                if not rows:
                    continue
                ids, _ = graph.search(vectors([rank[c["gate"][i]] for i in rows], [c["raw"][i] for i in rows], [c["group_key"][i] for i in rows]))
                for i, near in zip(rows, ids.tolist()):
                    key, own = (c["gate"][i], c["group_key"][i]), c["own"][i]
                    reached = {k for k in near if k >= 0 and (gates[k], groups[k]) == key}
                    matches = matching(c["words"][i], reached, own)
                    # an earlier segment holds the name or not: what the graph found is enough; else the rest of the key is compared
                    if (own or not matches) and len(reached) < len(held.get(key, ())):
                        matches += matching(c["words"][i], (k for k in held[key] if k not in reached), own)
                    if matches:
                        out.append((c["batch_no"][i], c["entry"][i], c["own"][i], min(matches)))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(v, t) for v, t in zip(columns, _SEARCHED.types)], schema=_SEARCHED)

    return search


def covering(place: int) -> list[str]:
    """The segments that cover all batches before a place: level l holds MERGE ** l successive places."""
    at, out = 0, []
    for level in range(place.bit_length(), -1, -1):
        width = MERGE**level
        while at + width <= place:
            out.append(f"{level}-{at // width}")
            at += width
    return out


def completed(old: int, new: int) -> dict[str, range]:
    """Segments whose last batch lies in the places from old to new, and the places they hold."""
    out, level = {}, 0
    while (width := MERGE**level) <= new:
        for at in range(old // width, new // width):
            out[f"{level}-{at}"] = range(at * width, (at + 1) * width)
        level += 1
    return out


class Index:
    """A stored index: its log says which batches and segments it holds. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        log = spark.read.schema(LOG).parquet(f"{folder}/log").collect()  # one row per batch and segment
        self.shards = {r.name: r.shards for r in log if r.kind == "segment"}
        self.batches = {r.place: r.batch_no for r in log if r.kind == "batch"}
        self.lexicon = names.Lexicon({r.word: r.n for r in spark.read.parquet(f"{folder}/lexicon").toLocalIterator()})

    def parsed(self, rows: DataFrame) -> DataFrame:
        """`rows` (name, group_key and more) with gate, words and raw; rows that say nothing are left out."""
        read = rows.withColumn("image", names.parser(self.lexicon)("name")).select(*[c for c in rows.columns if c != "name"], "image.gate", "image.words", "image.raw")
        return read.where(F.col("gate").isNotNull() & F.col("group_key").isNotNull())


def _log(spark: SparkSession, folder: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def _shard(segment_shards) -> object:
    return F.pmod(F.xxhash64("gate"), segment_shards).cast("int")


def _write_graphs(index_folder: str, nodes: DataFrame, tasks: int) -> None:
    """Build the shards of `nodes` (segment, shard, NAME, first) and add them to the index."""
    graphs = nodes.repartition(max(1, tasks), "segment", "shard").groupBy("segment", "shard").applyInArrow(build_shard, GRAPH)
    graphs.write.partitionBy("segment").mode("append").parquet(f"{index_folder}/graphs")


def create_index(spark: SparkSession, folder: str, history: DataFrame) -> Index:
    """Index the accepted history (name, group_key) in a new folder. An empty history is an index without names."""
    lexicon = names.learn_lexicon(history.select("name"))
    spark.createDataFrame(sorted(lexicon.counts.items()), "word string, n long").coalesce(1).write.parquet(f"{folder}/lexicon")
    _log(spark, folder, [("index", HISTORY, -1, -1, 0, 0)])
    found = cut_lineage(Index(spark, folder).parsed(history).select(*NAME).distinct())
    rows = found.count()
    shards = max(1, math.ceil(rows / SHARD_ROWS))
    nodes = found.select(F.lit(HISTORY).alias("segment"), _shard(F.lit(shards)).alias("shard"), *NAME, F.lit(-1).cast("long").alias("first"))
    _write_graphs(folder, nodes, 2 * shards)
    _log(spark, folder, [("segment", HISTORY, -1, -1, shards, rows)])
    return Index(spark, folder)


def add_batches(index: Index, batches: DataFrame) -> DataFrame:
    """(pool_id, batch_no, before, first) of the rows whose name and group the index or the batch held.

    `batches` (pool_id, batch_no, name, group_key) join the index in the order of batch_no, which must be
    above those it holds. `before`: a segment from before the batch holds the name; `first`: the
    smallest pool_id of the batch that has it.
    """
    spark, folder = index.spark, index.folder
    rows = cut_lineage(index.parsed(spread(batches)))
    entries = cut_lineage(rows.groupBy("batch_no", *NAME).agg(F.min("pool_id").alias("first")))
    sizes = {r.batch_no: r.n for r in entries.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number per batch
    landing = sorted(r.batch_no for r in batches.select("batch_no").distinct().collect())
    old = len(index.batches)
    if landing and old and landing[0] <= max(index.batches.values()):
        raise ValueError(f"batch {landing[0]} does not come after batch {max(index.batches.values())}")
    place = {b: old + i for i, b in enumerate(landing)}
    placed = entries.join(F.broadcast(spark.createDataFrame(list(place.items()), "batch_no int, place int")), "batch_no")  # one row per batch
    placed.select("place", *NAME, "first").write.partitionBy("place").mode("append").parquet(f"{folder}/nodes")
    counted = {place[b]: n for b, n in sizes.items()}

    due = completed(old, old + len(landing))
    # names of earlier batches that a compaction needs are read from the index, by their place
    held = sorted({p for places in due.values() for p in places})
    stored = spark.read.schema("gate string, words string, raw string, group_key string, first long, place int").parquet(f"{folder}/nodes").where(F.col("place").isin(held)) if sizes or old else placed
    before = {r.place: r.n for r in stored.where(F.col("place") < old).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()} if any(p < old for p in held) else {}
    counted |= before
    total = {s: sum(counted.get(p, 0) for p in places) for s, places in due.items()}
    shards = {s: max(1, math.ceil(n / SHARD_ROWS)) for s, n in total.items()}
    holders = spark.createDataFrame([(p, s, shards[s]) for s, places in due.items() for p in places], "place int, segment string, shards int")
    nodes = stored.join(F.broadcast(holders), "place").select("segment", _shard(F.col("shards")).alias("shard"), *NAME, "first")  # a row per place and size
    nodes = nodes.groupBy("segment", "shard", *NAME).agg(F.min("first").alias("first"))
    _write_graphs(folder, nodes, 2 * sum(shards.values()))
    _log(spark, folder, [*(("batch", str(b), p, b, 0, sizes.get(b, 0)) for b, p in place.items()), *(("segment", s, -1, -1, shards[s], total[s]) for s in due)])
    index.batches |= {p: b for b, p in place.items()}
    index.shards |= shards

    asked_of = {b: [(HISTORY, False), *((s, False) for s in covering(p)), (f"0-{p}", True)] for b, p in place.items()}
    visits = spark.createDataFrame([(b, s, index.shards[s], own) for b, segments in asked_of.items() for s, own in segments], "batch_no int, segment string, shards int, own boolean")
    chunks = F.lit(max(1, sum(sizes.values()))) / (F.col("shards") * CHUNK_ROWS)
    asked = entries.join(F.broadcast(visits), "batch_no").select("batch_no", *NAME, F.col("first").alias("entry"), "segment", _shard(F.col("shards")).alias("shard"), "own", F.pmod(F.xxhash64("first"), F.ceil(chunks)).cast("int").alias("chunk"))
    asked = cut_lineage(asked)
    wanted = asked.select(F.col("segment").alias("of"), F.col("shard").alias("at"), F.col("chunk").alias("piece")).distinct()
    names_used = sorted({s for segments in asked_of.values() for s, _ in segments})
    graphs = spark.read.schema("shard int, blob binary, segment string").parquet(f"{folder}/graphs").where(F.col("segment").isin(names_used))
    carried = graphs.join(wanted, (F.col("segment") == F.col("of")) & (F.col("shard") == F.col("at"))).select("segment", "shard", F.col("piece").alias("chunk"), "blob")
    task = ["segment", "shard", "chunk"]
    found = carried.groupBy(*task).cogroup(asked.groupBy(*task)).applyInArrow(searcher(index.lexicon.counts), SEARCHED)
    per = found.groupBy("batch_no", "entry").agg(F.max(~F.col("own")).alias("before"), F.min(F.when(F.col("own"), F.col("first"))).alias("own_first"))
    matched = entries.join(per.withColumnRenamed("entry", "first"), ["batch_no", "first"]).select("batch_no", *NAME, "before", F.col("own_first").alias("first"))
    return rows.join(matched, ["batch_no", *NAME]).select("pool_id", "batch_no", "before", "first")


def bringing_nothing(found: DataFrame) -> DataFrame:
    return found.where(F.col("before") | (F.col("first") < F.col("pool_id")))


def history_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = F.lower(F.trim(F.coalesce("source", F.lit("real")))) != "synthetic"
    return spread(table(spark, sf_dir, "labels").where(real).select(F.element_at(F.split("path", "/"), -1).alias("name"), names.group_key(F.col("group")).alias("group_key")))


def batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pool_manifest").select("pool_id", "batch_no", F.element_at(F.split("path", "/"), -1).alias("name"), names.group_key(F.col("group")).alias("group_key"))


def replay(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    """A new index in the shared folder over `labels`, and what it finds in all batches of `pool_manifest`."""
    index = create_index(spark, f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4()}", history_names(spark, sf_dir))
    return index, add_batches(index, batch_names(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool rows that bring nothing new."""
    return bringing_nothing(replay(spark, sf_dir)[1]).select("pool_id")


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: rows, rows that bring nothing new, and how many of them history held already."""
    seen = bringing_nothing(replay(spark, sf_dir)[1]).select("pool_id", "before")
    rows = table(spark, sf_dir, "pool_manifest").select("pool_id", "batch_no").join(seen, "pool_id", "left")
    return rows.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_rows"), F.count("before").alias("n_known"), F.count_if(F.col("before")).alias("n_from_before"))


def p3_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per segment of the index: shards, names, the widest beam, the lowest recall of its sampled names, shards searched whole."""
    index, _ = replay(spark, sf_dir)
    graphs = spark.read.parquet(f"{index.folder}/graphs")
    return graphs.groupBy("segment").agg(F.count(F.lit(1)).alias("n_shards"), F.sum("rows").alias("n_names"), F.max("beam").alias("widest_beam"), F.round(F.min("recall"), 4).alias("lowest_recall"), F.count_if("whole").alias("n_whole"))
