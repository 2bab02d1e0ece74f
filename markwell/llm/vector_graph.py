"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are dealt to the clusters of their nearest pivots, so clusters overlap. An audit compares a sample of vectors with all
rows; pivots that share a dense cluster are united, or the overlap is widened, until linked pairs share a shard. Every cluster shard builds a robust-pruned graph
of its own; the adjacency lists of a vector are united over its shards. Searches start at the shard's medoid, go greedily with a
beam towards the query, and then expand the range: neighbours of every vector within the range are looked at until none is new.
Cosines are taken in double precision from the stored components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwell.llm.common import stash
from markwell.llm.components import components

THRESHOLD = 0.95
SHARD_ROWS = 2_000
# Pivots are the vectors with the lowest hash; their number follows the table up to this bound, beyond which shards are split.
MOST_PIVOTS = 1_024
OVERLAP = 6
# The audit: so many vectors (those with the lowest hash under a seed of its own) meet all rows in blocks; of the linked pairs,
# so many stay. Vectors are dealt so that at least this share of them meet, over all pairs and as the mean over the vectors.
AUDIT_QUERIES = 2_048
AUDIT_PAIRS = 20_000
AUDIT_BLOCK = 1_024
AUDIT_RECALL = 0.97
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 16
# Neighbours that a search looks up at once.
LOOK_CELLS = 1 << 20
SEED = 11


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1))[:, None]


def robust_prune(unit: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Out-neighbours of every row: the nearest candidate stays, and those that it is clearly nearer to than the row are dropped,
    until ``degree`` have been kept. Candidates are the nearest rows and some at random; rows that the medoid can't reach get an
    edge from their nearest reached row."""
    n = len(unit)
    if n == 1:
        return [np.zeros(0, dtype=np.int64)]
    near = unit @ unit.T
    np.fill_diagonal(near, -2.0)
    k = min(candidates, n - 1)
    order = np.argpartition(-near, k - 1, axis=1)[:, :k]
    rng = np.random.default_rng(SEED)
    pool = np.concatenate((order, rng.integers(0, n, (n, min(16, n)))), axis=1)
    far = 1.0 - np.take_along_axis(near, pool, axis=1)
    sort = np.argsort(far, axis=1, kind="stable")
    pool, far = np.take_along_axis(pool, sort, axis=1), np.take_along_axis(far, sort, axis=1)
    alive = pool != np.arange(n)[:, None]
    chosen: list[list[int]] = [[] for _ in range(n)]
    rows = np.arange(n)
    for _ in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        at = np.argmax(alive, axis=1)
        pick = pool[rows, at]
        for i in np.flatnonzero(some):
            chosen[i].append(int(pick[i]))
        alive[rows, at] = False
        alive &= alpha * (1.0 - near[pick[:, None], pool]) > far
        alive &= pool != pick[:, None]
    _reach_all(chosen, near, medoid(unit))
    return [np.unique(np.array(c, dtype=np.int64)) for c in chosen]


def medoid(unit: np.ndarray) -> int:
    return int(np.argmax(unit @ unit.mean(axis=0)))


def _reach_all(chosen: list[list[int]], near: np.ndarray, start: int) -> None:
    reached = np.zeros(len(chosen), dtype=bool)
    reached[start] = True
    queue = [start]
    while True:
        while queue:
            for j in chosen[queue.pop()]:
                if not reached[j]:
                    reached[j] = True
                    queue.append(j)
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        known = np.flatnonzero(reached)
        block = near[np.ix_(lost, known)]
        i, j = divmod(int(np.argmax(block)), len(known))
        chosen[known[j]].append(int(lost[i]))
        reached[lost[i]] = True
        queue.append(int(lost[i]))


def range_search(
    queries: np.ndarray, base: np.ndarray, neighbours: list[np.ndarray], start: int, threshold: float, beam: int = BEAM
) -> np.ndarray:
    """Boolean matrix of the base rows found within the range of each query.

    All queries walk the graph side by side: each step opens what is new among the ``beam`` best rows that a query has seen."""
    q, n = len(queries), len(base)
    width = max(1, max((len(x) for x in neighbours), default=1))
    table = np.full((n, width), -1, dtype=np.int64)
    for i, x in enumerate(neighbours):
        table[i, : len(x)] = x
    score = np.full((q, n), -2.0)
    opened = np.zeros((q, n), dtype=bool)
    score[:, start] = queries @ base[start]

    def look(who: np.ndarray, at: np.ndarray) -> None:
        """Open nodes ``at`` for queries ``who``: score their neighbours."""
        opened[who, at] = True
        seen = np.zeros((q, n), dtype=bool)
        step = max(1, LOOK_CELLS // width)
        for lo in range(0, len(who), step):  # in a dense cluster most pairs are opened at once
            pairs = np.repeat(who[lo : lo + step], width), table[at[lo : lo + step]].ravel()
            real = pairs[1] >= 0
            seen[pairs[0][real], pairs[1][real]] = True
        key = np.flatnonzero(seen & (score == -2.0))
        for lo in range(0, len(key), 1 << 18):
            part = key[lo : lo + (1 << 18)]
            score[part // n, part % n] = np.einsum("ij,ij->i", queries[part // n], base[part % n])

    walking = np.arange(q)
    width_now = min(beam, n)
    while len(walking):
        own = score[walking]
        best = np.argpartition(-own, width_now - 1, axis=1)[:, :width_now]
        fresh = (np.take_along_axis(own, best, axis=1) > -2.0) & ~opened[walking[:, None], best]
        who, slot = np.nonzero(fresh)
        if len(who):
            look(walking[who], best[who, slot])
        walking = walking[fresh.any(axis=1)]
    while True:
        who, at = np.nonzero((score >= threshold - 1e-9) & ~opened)
        if not len(who):
            break
        look(who, at)
    found = score >= threshold - 1e-9
    return found


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least linked index of every node."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _nearest(unit: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest pivots of each row, nearest first."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, : min(k, len(pivots))]


def _linked_sample(nodes: DataFrame, asked: dict, by_dim: dict, threshold: float, widest: int) -> pd.DataFrame:
    """Linked pairs of the audit: ``(dim, q, node, top)``, a vector's number in ``asked`` and the nearest pivots of a row."""

    def meet(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim", sort=False):
                if dim not in asked:
                    continue
                names, queries = asked[dim]
                ids = part["node"].to_numpy()
                for lo in range(0, len(part), AUDIT_BLOCK):
                    unit, own = _unit(_matrix(part["v"].iloc[lo : lo + AUDIT_BLOCK])), ids[lo : lo + AUDIT_BLOCK]
                    row, q = np.nonzero(unit @ queries.T >= threshold)
                    other = own[row] != names[q]
                    row, q = row[other], q[other]
                    if not len(row):  # a frame without rows has no type for the lists
                        continue
                    if len(row) > AUDIT_BLOCK:
                        some = np.random.default_rng(SEED).choice(len(row), AUDIT_BLOCK, replace=False)
                        row, q = row[some], q[some]
                    top = _nearest(unit[row], by_dim[dim], widest).tolist()
                    yield pd.DataFrame({"dim": dim, "q": q, "node": own[row], "top": top})

    pairs = nodes.select("node", "v", "dim").mapInPandas(meet, "dim int, q long, node long, top array<long>")
    return pairs.orderBy(F.xxhash64("q", "node"), "q", "node").limit(AUDIT_PAIRS).toPandas()


def _dealing(nodes: DataFrame, by_dim: dict, threshold: float, overlap: int) -> tuple[dict, int]:
    """The shard of every pivot, by dimension, and the number of nearest pivots that a vector is dealt to.

    Pivots are united by single linkage from some cosine on. Of all cosines and overlaps that let enough linked pairs of the
    audit meet, those with the least comparisons are taken; with all pivots united every pair meets.
    """
    alone = {d: np.arange(len(p)) for d, p in by_dim.items()}
    if all(len(p) <= overlap for p in by_dim.values()):
        return alone, overlap
    chosen = nodes.orderBy(F.xxhash64(F.lit(SEED), "node"), "node").limit(AUDIT_QUERIES).select("node", "dim", "v").collect()
    asked = {}
    for d in {r["dim"] for r in chosen} & by_dim.keys():
        asked[d] = np.array([r["node"] for r in chosen if r["dim"] == d]), _unit(np.array([r["v"] for r in chosen if r["dim"] == d]))
    widest = 4 * overlap
    pairs = _linked_sample(nodes, asked, by_dim, threshold, widest)
    if not len(pairs):
        return alone, overlap
    tops = {d: _nearest(unit, by_dim[d], widest) for d, (_, unit) in asked.items()}
    parts = {d: (part["q"].to_numpy(), np.array(part["top"].tolist())) for d, part in pairs.groupby("dim")}
    cosines = {d: p @ p.T for d, p in by_dim.items()}
    best = None
    for level in (2.0, *np.arange(0.95, -1.0, -0.05), -2.0):
        shard_of = {d: _spanning(len(c), *np.nonzero(c >= level)) for d, c in cosines.items()}
        for k in (overlap, 2 * overlap, widest):
            met, of_query, work = [], [], 0.0
            for d, top in tops.items():
                dealt = shard_of[d][top[:, :k]]
                rows = np.zeros(len(by_dim[d]))
                for shards in dealt:
                    rows[np.unique(shards)] += 1
                work += float((rows * rows).sum())
                if d in parts:
                    q, near = parts[d]
                    near = shard_of[d][near[:, :k]]
                    meets = np.zeros(len(q), dtype=bool)
                    for at in range(dealt.shape[1]):
                        meets |= (near == dealt[q, at][:, None]).any(axis=1)
                    met.append(meets)
                    asks = np.bincount(q, minlength=len(dealt))
                    of_query.append((np.bincount(q, weights=meets, minlength=len(dealt)) / np.maximum(asks, 1))[asks > 0])
            recall = min(np.concatenate(met).mean(), np.concatenate(of_query).mean())
            if recall >= AUDIT_RECALL and (best is None or work < best[0]):
                best = work, shard_of, k
        if best and level == 2.0 and best[2] == overlap:
            break
    return best[1], best[2]


def link_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    shard_rows: int = SHARD_ROWS,
    most_pivots: int = MOST_PIVOTS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Rows with equal components are one node that counts for all of them. Null, empty or zero vectors, those with null or
    non-finite components, and rows with a null key are linked with nothing and kept. Vectors of different lengths are never
    linked. ``overlap`` is the least number of pivots that a vector is dealt to; the audit widens it where linked pairs would not
    meet. A pair that shares several shards counts in the first only, so repeated finds don't add up. A shard of more than
    ``shard_rows`` nodes is split into chunks that are searched pairwise, so no task holds more than two chunks. An empty table
    gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False)))
    nodes = stash(
        rows.filter("sound").groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("v"))
    )
    count = nodes.count()
    wanted = int(min(most_pivots, max(1, -(-count * overlap // shard_rows))))
    pivots = nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("dim", "v").collect()
    by_dim = {d: _unit(np.array([p["v"] for p in pivots if p["dim"] == d])) for d in {p["dim"] for p in pivots}}

    shard_of, width = _dealing(nodes, by_dim, threshold, overlap)

    def deal(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim", sort=False):
                if dim in by_dim:
                    best = np.sort(shard_of[dim][_nearest(_unit(_matrix(part["v"])), by_dim[dim], width)], axis=1)
                else:
                    best = np.zeros((len(part), 1), dtype=np.int64)
                shards = (best + (int(dim) << 20)).tolist()
                yield part.assign(shards=shards)[["node", "n", "v", "shards"]]

    placed = stash(nodes.mapInPandas(deal, "node long, n long, v array<double>, shards array<long>"))
    members = placed.withColumn("shard", F.explode(F.array_distinct("shards")))
    sizes = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("chunks"))
    members = members.join(F.broadcast(sizes), "shard").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["node"].to_numpy()
        lists = robust_prune(_unit(_matrix(frame["v"])))
        return pd.DataFrame({"node": ids, "near": [ids[x].tolist() for x in lists]})

    graph = members.select("shard", "chunk", "node", "v").groupBy("shard", "chunk").applyInPandas(build, "node long, near array<long>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = stash(united)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asking, base = frame[~frame["is_base"]], frame[frame["is_base"]]
        if not len(asking) or not len(base):
            return pd.DataFrame({"a": [], "links": [], "b": []})
        shard = int(frame["shard"].iloc[0])
        ids, asks = base["node"].to_numpy(), asking["node"].to_numpy()
        where = {x: i for i, x in enumerate(ids.tolist())}
        lists = [np.array([where[x] for x in near if x in where], dtype=np.int64) for near in base["near"]]
        unit, ask_unit = _unit(_matrix(base["v"])), _unit(_matrix(asking["v"]))
        start = medoid(unit)
        chosen = [x.tolist() for x in lists]
        _reach_all(chosen, unit @ unit.T, start)
        found = range_search(ask_unit, unit, [np.array(c, dtype=np.int64) for c in chosen], start, threshold)
        q, b = np.nonzero(found)
        raw, other = _matrix(asking["v"]), _matrix(base["v"])
        good = np.zeros(len(q), dtype=bool)
        for lo in range(0, len(q), 1 << 18):
            x, y = raw[q[lo : lo + (1 << 18)]], other[b[lo : lo + (1 << 18)]]
            dots, xx, yy = (np.einsum("ij,ij->i", s, t) for s, t in ((x, y), (x, x), (y, y)))
            good[lo : lo + (1 << 18)] = dots / (np.sqrt(xx) * np.sqrt(yy)) >= threshold
        good &= asks[q] != ids[b]
        q, b = q[good], b[good]
        shared = _first_shared(np.array(asking["shards"].tolist()), np.array(base["shards"].tolist()), q, b)
        mine = shared == shard
        links = np.bincount(q[mine], weights=base["n"].to_numpy()[b[mine]], minlength=len(asks)).astype(np.int64)
        every = np.concatenate((asks, ids))
        label = _spanning(len(every), q, b + len(asks))
        ends = np.concatenate((links, np.zeros(len(ids), np.int64)))
        out = pd.DataFrame({"a": every, "links": ends, "b": every[label]})
        return out[(out["links"] > 0) | (out["a"] != out["b"])]

    full = members.join(united, "node")
    as_base = full.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("asked"), F.col("chunk").alias("held"),
        F.lit(True).alias("is_base"), "node", "n", "v", "shards", "near",
    )
    as_query = full.select(
        "shard", F.col("chunk").alias("asked"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("held"),
        F.lit(False).alias("is_base"), "node", "n", "v", "shards", F.array().cast("array<bigint>").alias("near"),
    )
    found = stash(as_base.unionByName(as_query).groupBy("shard", "asked", "held").applyInPandas(search, "a long, links long, b long"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    labels = components(found.filter("a != b").select("a", "b"))
    by_node = (
        nodes.join(counts, nodes["node"] == counts["a"], "left")
        .join(labels.withColumnRenamed("node", "_node"), nodes["node"] == F.col("_node"), "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", nodes["node"]).alias("component_id"))
    )
    joined = rows.withColumn("k", F.when(F.col("sound"), F.col("v"))).join(by_node.withColumnRenamed("v", "k"), "k", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _first_shared(left: np.ndarray, right: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least shard that both rows of each pair are dealt to."""
    first = np.full(len(q), np.iinfo(np.int64).max)
    for k in range(left.shape[1]):
        mine = left[q, k]
        np.minimum(first, np.where((right[b] == mine[:, None]).any(axis=1), mine, first), out=first)
    return first
