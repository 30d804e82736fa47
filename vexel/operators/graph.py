"""Proximity graphs: edges (src, dst, dist) as a table, or a stored index of one graph a cell.

A cell is an inverted list, or a part of one that would be larger than CELL rows, so a cell always fits a task. Its graph
is built once (`build`), stored as a table, and walked by the queries that visit the cell (`walk`). Nodes have levels, as
in a layered graph: a walk begins at the nearest of a cell's upper nodes, so it needs no links between far groups.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..sources.scratch import staged
from .quantize import visits_of
from .search import BITS, block_nearest, query_blocks, rounded, top

#: Rows that a walk starts from, rows of a cell at most (about), and rows whose distances to a cell are held at once.
STARTS, CELL, LINES = 8, 8192, 256
#: Random links of an upper row.
FAR_LINKS = 4
GRAPH = "list int, part int, id long, vec array<{0}>, level int, near array<int>"


def knn_edges(cells: DataFrame, degree: int, metric: str = "l2") -> DataFrame:
    """src, rank, dst, dist: the nearest `degree` rows that share a cell. cells: (list, id, vec), a row in one or more.

    Cells are compared by pairs of their parts of about CELL rows, each pair in a task; `degree` rows a source and pair are
    shuffled.
    """
    sizes = cells.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))  # a row a cell
    parts = cells.select("list", "id", "vec").join(F.broadcast(sizes), "list").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    each = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ends = each.select("list", F.col("mine").alias("a"), F.col("other").alias("b"), "id", "vec", F.lit(True).alias("source"))
    ends = ends.unionByName(each.select("list", F.col("other").alias("a"), F.col("mine").alias("b"), "id", "vec", F.lit(False).alias("source")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        mine, rest = part[part["source"]], part[~part["source"]]
        ids, out = rest["id"].to_numpy(), []
        vec = np.array(rest["vec"].tolist(), _dtype(metric))
        for at in range(0, len(mine), LINES) if len(rest) else ():
            some = mine.iloc[at : at + LINES]
            line, column, far = block_nearest(np.array(some["vec"].tolist(), _dtype(metric)), vec, ids, degree + 1, metric)
            out.append(pd.DataFrame({"src": some["id"].to_numpy()[line], "dst": ids[column], "dist": far}))
        found = pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "dist": []})
        return found[found["src"] != found["dst"]]

    near = ends.groupBy("list", "a", "b").applyInPandas(run, "src long, dst long, dist double").distinct()
    return top(near, degree, by="dist", per="src", tie="dst").select("src", "rank", "dst", "dist")


def descend(edges: DataFrame, base: DataFrame, degree: int, metric: str = "l2") -> DataFrame:
    """One round of neighbour descent: a row's neighbours' neighbours are candidates too, by a self-join on the middle."""
    step = edges.select(F.col("src").alias("mid"), F.col("dst").alias("far"))
    further = edges.select("src", F.col("dst").alias("mid")).join(step, "mid").where("src <> far").select("src", F.col("far").alias("dst"))
    new = further.distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    ends = new.join(base.select(F.col("id").alias("src"), "vec"), "src").join(base.select(F.col("id").alias("dst"), F.col("vec").alias("q")), "dst")
    scored = ends.select("src", "dst", rounded(D.distance(metric, "vec", "q")).alias("dist"))
    return top(edges.select("src", "dst", "dist").unionByName(scored), degree, by="dist", per="src", tie="dst").select("src", "rank", "dst", "dist")


def level_of(node: Column, m: int = 16, seed: int = 42, most: int = 16) -> Column:
    """A node's highest layer, geometric with ratio 1/m, from a hash of its id."""
    u = (F.pmod(F.xxhash64(node, F.lit(seed)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    return F.least(F.floor(-F.log(u) / float(np.log(m))), F.lit(most)).cast("int")


def levels(nodes: DataFrame, m: int = 16, seed: int = 42, most: int = 16) -> DataFrame:
    return nodes.select("id", level_of(F.col("id"), m, seed, most).alias("level"))


def alpha_prune(edges: DataFrame, base: DataFrame, alpha: float = 1.2, metric: str = "l2") -> DataFrame:
    """Edges without those occluded by a nearer neighbour of the same source: alpha * d(near, far) <= d(source, far)."""
    vec = base.select("id", "vec")
    far = edges.join(vec.select(F.col("id").alias("dst"), F.col("vec").alias("vf")), "dst")
    near = edges.select("src", F.col("rank").alias("r2"), F.col("dst").alias("mid")).join(vec.select(F.col("id").alias("mid"), F.col("vec").alias("vn")), "mid")
    hidden = far.join(near, "src").where("r2 < rank").where(rounded(D.distance(metric, "vn", "vf")) * alpha <= F.col("dist")).select("src", "dst").distinct()
    return edges.join(hidden, ["src", "dst"], "left_anti")


def robust_prune(edges: DataFrame, base: DataFrame, alpha: float = 1.2, degree: int = 16, metric: str = "l2") -> DataFrame:
    """The greedy form: nearest first, an edge stays unless one already kept occludes it; at most `degree` a source."""
    rows = edges.join(base.select(F.col("id").alias("dst"), "vec"), "dst").select("src", "dst", "dist", "vec")
    dealt = rows.repartition("src").sortWithinPartitions("src", "dist", "dst")

    def prune(part: pd.DataFrame) -> pd.DataFrame:
        vec, far, kept = np.array(part["vec"].tolist(), float), part["dist"].to_numpy(), []
        cuts = np.flatnonzero(np.diff(part["src"].to_numpy(), prepend=part["src"].iloc[0] - 1))
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            between, mine = D.matrix_distance(metric, vec[a:b], vec[a:b]), []
            for i in range(b - a):
                if len(mine) < degree and (not mine or (alpha * between[i, mine] > far[a + i]).all()):
                    mine.append(i)
            kept += [a + i for i in mine]
        return part.iloc[kept][["src", "dst", "dist"]]

    def run(parts):
        held = None  # the last source of a batch may go on in the next
        for part in parts:
            part = part if held is None else pd.concat([held, part], ignore_index=True)
            if len(part):
                whole = part["src"] != part["src"].iloc[-1]
                held = part[~whole]
                if whole.any():
                    yield prune(part[whole].reset_index(drop=True))
        if held is not None:
            yield prune(held.reset_index(drop=True))

    return dealt.mapInPandas(run, "src long, dst long, dist double")


def with_reverse(edges: DataFrame, degree: int) -> DataFrame:
    """Edges in both directions, the nearest `degree` of each source."""
    both = edges.select("src", "dst", "dist").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).distinct()
    return top(both, degree, by="dist", per="src", tie="dst").select("src", "rank", "dst", "dist")


def consolidate(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges without deleted ends; what pointed to a deleted row now points to that row's neighbours."""
    gone = deleted.select("id").distinct()
    live = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select("src", "dst")
    lost = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select("src", F.col("dst").alias("mid"))
    ahead = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.col("src").alias("mid"), "dst")
    return live.union(lost.join(ahead, "mid").where("src <> dst").select("src", "dst")).distinct()


def reachable(edges: DataFrame, start: DataFrame, rounds: int = 1000) -> DataFrame:
    """The ids that edges lead to from `start`, itself included: breadth first, a join with the frontier each round."""
    spark = edges.sparkSession
    edges = staged(spark, edges.select("src", "dst").distinct(), "edges")
    seen = edge = staged(spark, start.select("id").distinct(), "start")
    for _ in range(rounds):
        new = edges.join(edge.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        edge = staged(spark, new, "frontier")
        if not edge.limit(1).count():
            break
        seen = staged(spark, seen.union(edge), "seen")
    return seen


def repaired(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, dist with, for each node to which no edge leads, an edge from the nearest of its own neighbours."""
    lost = unreachable(edges, nodes)
    back = edges.where("rank = 1").join(lost.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
    return edges.select("src", "dst", "dist").union(back).distinct()


def degree_stats(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    return out.agg(F.count("*").alias("nodes"), F.sum("n").alias("edges"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def unreachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes to which no edge leads."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def beam(vec: np.ndarray, near: list[np.ndarray], query: np.ndarray, width: int, k: int, metric: str = "l2", start: tuple[int, ...] = (0,), live: np.ndarray | None = None, patience: int | None = None) -> list[tuple[float, int]]:
    """Best-first walk of one small graph from some rows: (distance, row) of the k best of a beam of `width`. Rows that aren't
    live lead on, but have no place in the beam. With patience, a walk also ends when its k have been full for so many steps
    and their sum of distances has fallen by no more than a fiftieth in them."""
    first = D.matrix_distance(metric, query[None], vec[list(start)])[0].tolist()
    seen, open_, best = {*start}, sorted(zip(first, start)), [(-d, x) for d, x in zip(first, start) if live is None or live[x]]
    heapq.heapify(best)
    idle, was = 0, np.inf
    while open_:
        far, at = heapq.heappop(open_)
        if len(best) >= width and far > -best[0][0]:
            break
        if patience is not None and len(best) >= k:
            now = sum(heapq.nsmallest(k, (-d for d, _ in best)))
            idle, was = (idle + 1, was) if now >= was - abs(was) / 50 else (0, now)
            if idle >= patience:
                break
        new = [x for x in near[at] if x not in seen]
        seen.update(new)
        if new:
            for d, x in zip(D.matrix_distance(metric, query[None], vec[new])[0].tolist(), new):
                if len(best) < width or d < -best[0][0]:
                    heapq.heappush(open_, (d, x))
                    if live is None or live[x]:
                        heapq.heappush(best, (-d, x))
                        if len(best) > width:
                            heapq.heappop(best)
    return sorted((-d, x) for d, x in best)[:k]


def cells_for(rows: int) -> int:
    """How many cells a graph of so many rows should have."""
    return max(1, -(-2 * rows // CELL))


def _dtype(metric: str):
    return np.int64 if metric in BITS else np.float64


def _linked(vec: np.ndarray, degree: int, alpha: float, metric: str, upper: np.ndarray) -> list[np.ndarray]:
    """Each row's neighbours: its nearest ones, pruned by occlusion, and those it is a neighbour of, LINES rows at a time.
    Upper rows are also linked at random, and every row with the upper row nearest to it, so groups far apart hang together."""
    near: list[set] = [set() for _ in vec]
    far_ends = np.random.default_rng(len(vec)).permuted(np.tile(upper, (FAR_LINKS, 1)), axis=1)
    for x, y in zip(np.tile(upper, FAR_LINKS).tolist(), far_ends.ravel().tolist()):
        if x != y:
            near[x].add(y)
            near[y].add(x)
    width = min(3 * degree + 1, len(vec))
    for a in range(0, len(vec), LINES):
        far = D.matrix_distance(metric, vec[a : a + LINES], vec)
        far[np.arange(len(far)), a + np.arange(len(far))] = np.inf
        if len(upper):
            for i, y in enumerate(upper[far[:, upper].argmin(1)].tolist()):
                if y != a + i:
                    near[a + i].add(y)
                    near[y].add(a + i)
        some = np.argpartition(far, width - 1, 1)[:, :width]
        some = np.take_along_axis(some, np.lexsort((some, np.take_along_axis(far, some, 1)), axis=1), 1)
        for i, line in enumerate(some):
            line = line[np.isfinite(far[i, line])]
            between = D.matrix_distance(metric, vec[line], vec[line]) if metric != "ip" else None
            kept: list[int] = []
            for j in range(len(line)):
                if len(kept) == degree:
                    break
                if between is None or not kept or (alpha * between[j, kept] > far[i, line[j]]).all():
                    kept.append(j)
            near[a + i].update(line[kept].tolist())
            for j in line[kept].tolist():
                near[j].add(a + i)
    return [np.array(sorted(n), np.int32) for n in near]


def build(rows: DataFrame, degree: int = 16, metric: str = "l2", alpha: float = 1.2) -> DataFrame:
    """The graph table (list, part, id, vec, level, near) of rows (list, id, vec); near: places in the cell, in order of id."""
    kind = rows.schema["vec"].dataType.elementType.simpleString()
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))  # a row a list
    cells = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = cells.withColumn("level", level_of(F.col("id")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id").reset_index(drop=True)
        near = _linked(np.array(part["vec"].tolist(), _dtype(metric)), degree, alpha, metric, np.flatnonzero(part["level"] > 0))
        return part[["list", "part", "id", "vec", "level"]].assign(near=near)

    return cells.select("list", "part", "id", "vec", "level").groupBy("list", "part").applyInPandas(run, GRAPH.format(kind))


def walk(stored: DataFrame, queries: DataFrame, k: int, ef: int = 64, metric: str = "l2", centroids: np.ndarray | None = None, nprobe: int | None = None, live: DataFrame | None = None) -> DataFrame:
    """The k nearest by walking the stored graphs of the nprobe cells whose centroids are nearest, or of all.

    live: the ids that may be returned; others are walked through all the same.
    """
    if live is not None:
        stored = stored.join(live.select("id").withColumn("live", F.lit(True)), "id", "left")
    else:
        stored = stored.withColumn("live", F.lit(True))
    schema = "query_id long, id long, distance double"
    found = [stored.sparkSession.createDataFrame([], schema)]
    for ids, block in query_blocks(queries, _dtype(metric)):
        visits = visits_of(block, centroids, nprobe, metric) if nprobe and centroids is not None else None
        visited = stored if visits is None else stored.where(F.col("list").isin([int(x) for x in np.flatnonzero(visits.any(0))]))
        found.append(visited.groupBy("list", "part").applyInPandas(_walker(ids, block, visits, k, ef, metric), schema))
    return top(reduce(DataFrame.unionByName, found), k).select("query_id", "rank", "id", "distance")


def _walker(ids: np.ndarray, block: np.ndarray, visits: np.ndarray | None, k: int, ef: int, metric: str):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id").reset_index(drop=True)
        vec, number, live = np.array(part["vec"].tolist(), block.dtype), part["id"].to_numpy(), part["live"].eq(True).to_numpy()
        near = [np.asarray(n) for n in part["near"]]
        height, least_entries = part["level"].to_numpy(), max(STARTS, int(np.sqrt(len(vec))))
        # the highest level that has enough nodes to begin from, or, without levels that fit, evenly spaced ones
        above = [np.flatnonzero(height >= h) for h in range(height.max(), 0, -1)]
        entries = next((e for e in above if len(e) >= least_entries), np.arange(0, len(vec), max(1, int(np.sqrt(len(vec)) / 2))))
        mine = np.arange(len(ids)) if visits is None else np.flatnonzero(visits[:, part["list"][0]])
        width, mask = max(ef, k), None if live.all() else live
        hits = []
        for a in range(0, len(mine), LINES):
            some = mine[a : a + LINES]
            closest = np.argsort(D.matrix_distance(metric, block[some], vec[entries]), axis=1, kind="stable")[:, :STARTS]
            for q, c in zip(some, closest):
                best = beam(vec, near, block[q], width, k, metric, tuple(entries[c].tolist()), mask)
                hits += [(int(ids[q]), int(number[x]), round(d, 9) + 0.0) for d, x in best]
        return pd.DataFrame(hits, columns=["query_id", "id", "distance"])

    return run


def graph_search(cells: DataFrame, queries: DataFrame, k: int, degree: int = 16, ef: int = 64, metric: str = "l2", alpha: float = 1.2) -> DataFrame:
    """The k nearest by graphs that are built for this search alone, and all walked. cells: (list, id, vec)."""
    return walk(build(cells, degree, metric, alpha), queries, k, ef, metric)
