"""Links between vectors with a cosine of at least SIMILAR, without a cap on how many a vector has.

Every vector asks the multi-index (see `multi_index`) for the TARGET directions nearest to it by cells. One
that is still in a crowd in the last cells it visits (a part CROWD of the directions there are similar to it)
asks again for WIDER times as many, and so on until it is out of the crowd or everything was visited. So
what ends the traversal is what it finds, and not a count. Where no more than SCANNED vectors are left, they
are sent to where all vectors lie instead, and meet every one. Where that does not visit everything, vectors
that it finds related (see `relatives`) meet in a second look, and links of both count. A pair may still be left
out; recall is measured against brute force (see the README).

A task writes a spanning forest of its links, so pairs inside a set are never written.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.llm import multi_index as mi
from siltmark.llm import relatives
from siltmark.session import cut_lineage

SIMILAR = 0.80
WIDER = 8
CROWD = 1 / 32
#: Vectors in crowds that may be sent to every task.
SCANNED = 8192
#: What single precision is off by, at most, in a cosine.
SLACK = 6e-5
ROWS, COLUMNS = 1024, 8192

#: Links have no `crowd`; this one marks links of relatives.
KIN = -1

FOUND = "u long, v long, crowd int"
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("crowd", pa.int32())])


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Labels after joining a[i] with b[i], and the pairs of labels that this took: a spanning forest."""
    n = len(labels)
    pairs = np.unique(labels[a] * n + labels[b])
    root: dict[int, int] = {}

    def top(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = root.get(up, up)
            v = up
        return v

    forest = []
    for x, y in zip((pairs // n).tolist(), (pairs % n).tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append((x, y))
    if forest:
        moved = np.arange(n)
        for v in list(root):
            moved[v] = top(v)
        labels = moved[labels]
    return labels, forest


def hits(part: mi.Part, a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a and b of cosine `least` and more, the vector itself left out, and which are similar; near SIMILAR decided in double precision."""
    s = part.x[a] @ part.x[b].T
    i, j = np.nonzero(s >= least - SLACK)
    other = a[i] != b[j]
    i, j = i[other], j[other]
    s = s[i, j]
    good = s >= SIMILAR + SLACK
    near = np.flatnonzero(~good & (s >= SIMILAR - SLACK))
    for k in np.array_split(near, -(-len(near) // 8192) or 1):
        good[k] = np.einsum("ij,ij->i", part.exact(a[i[k]]), part.exact(b[j[k]])) >= SIMILAR - 1e-9
    return i, j, good


def found_in_part(group: pa.Table, kin: bool) -> pa.Table:
    """Of one part a spanning forest of its links, and of its relatives if `kin`, copies included, and per vector what is similar to it at its frontier (crowd)."""
    part = mi.gather(group)
    least = relatives.LINKED if kin else SIMILAR
    n = len(part.ids)
    first = np.array([i[0] for i in part.ids], dtype=np.int64)
    entries = np.flatnonzero(part.entry)
    home = np.array([part.cells[i][0] for i in entries], dtype=np.int64)
    asking: dict[int, list[int]] = {}
    for q in np.flatnonzero(part.asks).tolist():
        cells = part.cells[q]
        for c in cells[1:] if ~cells[0] in cells else cells:  # a home cell at the frontier comes twice
            asking.setdefault(c, []).append(q)
    labels, crowd, edges = np.arange(n), np.zeros(n, dtype=np.int64), []
    related, kin_edges = labels, []
    for cell in np.unique(home).tolist():
        own = entries[home == cell]
        for c in (cell, ~cell):
            queries = np.array(asking.get(c, ()), dtype=np.int64)
            for low in range(0, len(queries), ROWS):
                q = queries[low : low + ROWS]
                for at in range(0, len(own), COLUMNS):
                    e = own[at : at + COLUMNS]
                    i, j, good = hits(part, q, e, least)
                    if kin and len(i):
                        related, forest = joined(related, q[i], e[j])
                        kin_edges += forest
                    i, j = i[good], j[good]
                    if len(i):
                        labels, forest = joined(labels, q[i], e[j])
                        edges += forest
                        if c < 0:
                            crowd += np.bincount(q[i], minlength=n)
    pairs = [(first[a], first[b], None) for a, b in edges]
    pairs += [(first[a], first[b], KIN) for a, b in kin_edges]
    pairs += [(own[0], i, None) for own, entry, asks in zip(part.ids, part.entry, part.asks) if entry and asks for i in own[1:]]
    pairs += [(i, i, c) for i, c in zip(first[crowd > 0].tolist(), crowd[crowd > 0].tolist())]
    columns = list(zip(*pairs)) or [[], [], []]
    return pa.table([pa.array(v, t) for v, t in zip(columns, _FOUND.types)], schema=_FOUND)


def links_in_part(group: pa.Table) -> pa.Table:
    return found_in_part(group, False)


def kin_in_part(group: pa.Table) -> pa.Table:
    return found_in_part(group, True)


def scanned_links(vectors: DataFrame, asking: DataFrame) -> DataFrame:
    """(schema FOUND) links and relatives of at most SCANNED asking vectors among all vectors, spanning forests per batch of rows."""
    rows = relatives.packed(asking).toArrow()
    asked = np.asarray(rows.column("vec_id"), dtype=np.int64), mi.decode(rows.column("payload").to_pylist())
    shared = vectors.sparkSession.sparkContext.broadcast(asked)  # at most SCANNED vectors

    def meet(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        other, y = shared.value
        stored, names = np.concatenate([x, y]), np.concatenate([ids, other])
        part = mi.Part(stored, mi.unit(stored), [], np.empty(0, bool), np.empty(0, bool), [])
        related = labels = np.arange(len(names))
        edges: list[tuple] = []
        for low in range(0, len(ids), ROWS):
            q = np.arange(low, min(low + ROWS, len(ids)))
            for at in range(len(ids), len(names), COLUMNS):
                e = np.arange(at, min(at + COLUMNS, len(names)))
                i, j, good = hits(part, q, e, relatives.LINKED)
                if len(i):
                    labels, forest = joined(labels, q[i[good]], e[j[good]])
                    related, kin = joined(related, q[i], e[j])
                    edges += [(names[a], names[b], None) for a, b in forest] + [(names[a], names[b], KIN) for a, b in kin]
        columns = list(zip(*edges)) or [[], [], []]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _FOUND.types)], schema=_FOUND)

    return vectors.mapInArrow(mi.reader(meet), FOUND).where("u <> v")


def crowds_asking(spark: SparkSession, vectors: DataFrame, index: mi.MultiIndex, target: int) -> list[DataFrame]:
    """What vectors find when they ask for `target` directions, and those in crowds for more (checkpointed, schema FOUND)."""
    directions, task = int(index.held.sum()), list(mi.TASK)
    sent, looks = mi.send(spark, vectors, index, target, mark=True), []
    while True:
        looks.append(cut_lineage(sent.groupBy(*task).applyInArrow(kin_in_part, FOUND)))
        crowds = looks[-1].where("crowd > 0").groupBy(F.col("u").alias("vec_id")).agg(F.sum("crowd").alias("n"))
        more = crowds.where(F.col("n") >= CROWD * (target // mi.FRONTIER)).select("vec_id")
        left = more.count()
        if not left or target >= directions:
            return looks
        target *= WIDER
        if left <= SCANNED:
            asking = vectors.join(F.broadcast(more), "vec_id", "left_semi")  # at most SCANNED ids
            return [*looks, cut_lineage(scanned_links(vectors, asking))]
        asking = cut_lineage(relatives.packed(vectors).join(more, "vec_id", "left_semi"))
        index.chunks = mi.chunks_of(spark, asking, left, index, target)
        asked = mi.send(spark, asking, index, target, ("asks",), target < directions)
        entries = mi.send(spark, vectors, index, target, ("entry",))
        sent = entries.join(asked.select(*task).distinct(), task, "left_semi").unionByName(asked)


def kin_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("crowd") == KIN).select("u", "v")


def similar_links(spark: SparkSession, vectors: DataFrame, target: int | None = None) -> DataFrame:
    """(u, v): links whose components are the sets of vectors linked by cosines of SIMILAR and more."""
    target = mi.TARGET if target is None else target
    index = mi.build_index(spark, vectors, target)
    if target >= index.held.sum():
        looks = [cut_lineage(mi.send(spark, vectors, index, target).groupBy(*mi.TASK).applyInArrow(links_in_part, FOUND))]
    else:
        looks = crowds_asking(spark, vectors, index, target)

        def look(sent: DataFrame) -> DataFrame:
            looks.append(cut_lineage(sent.groupBy(*mi.TASK).applyInArrow(kin_in_part, FOUND)))
            return kin_of(looks[-1])

        def scan(these: DataFrame, asking: DataFrame) -> DataFrame:
            looks.append(cut_lineage(scanned_links(these, asking)))
            return kin_of(looks[-1])

        kin = kin_of(reduce(DataFrame.unionByName, looks))
        sets = relatives.related_sets(spark, vectors, kin, look, scan)
        looks.append(cut_lineage(relatives.meeting(vectors, sets).groupBy(*mi.TASK).applyInArrow(links_in_part, FOUND)))
    return reduce(DataFrame.unionByName, looks).where("crowd IS NULL").select("u", "v")
