"""Hard negatives by a GNAT-style multiway hyperplane tree: exact, from a stated set of anchors against all rows.

The tree is grown on a sample of at most ``sample_rows`` rows: each node has up to FANOUT split points, chosen far from
one another, and a row belongs to the nearest (ties the first), so hyperplanes part the siblings. All rows descend, and
Spark adds up, for every split point, the least and greatest distance to the rows of every sibling subtree, and the
least and greatest norm of each subtree. An anchor's window of scores is, with a subtree's norms, an annulus of
distances around the anchor; a subtree goes if, seen from any split point, its range of distances and the annulus do
not meet. Leaves are searched exactly, all rows of them.

Rows are written once as packed blocks of leaves; a frequent vector makes many blocks of one leaf. A block's task reads
the anchors from the shared folder part by part, drops those for which the block's leaf is eliminated, and scores the
rest by one product of matrices. A first pass finds each anchor's positives, a second the negatives in each positive's
window. Bounds from the sample (rows like any others) start both passes, and each block returns at most as many rows
for an anchor as the result can hold. The work grows with anchors times rows where nothing can be eliminated, as with
random vectors; what a task holds is a block and a part of the anchors.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component take no part. Shorter
vectors count as if zeros followed. Components become floor(scale * x); LIMIT or more is an error. Rows repeated whole are
one row. Of different rows with an anchor's id the least by label, then vector, asks, and none of them is its partner.
Equal scores go by smaller id. An anchor without a partner of its label, or with no score in a window, gives no row; an
empty table gives none. Further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import drop_stash, filesystem, stash

SAMPLE, FANOUT, LEAF_ROWS, MOST_LEAVES = 8192, 8, 2048, 4096
BLOCK_ROWS, ANCHOR_ROWS = 8192, 1024
LIMIT = 1 << 23
NONE = -(1 << 62)


@dataclass
class Node:
    """points: the split points; kids: a node's number, or ~leaf. low, high: squared distances [point, subtree]; norms: squared."""

    points: np.ndarray
    kids: list[int]
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)
    norm_low: np.ndarray = field(default=None)
    norm_high: np.ndarray = field(default=None)


@dataclass
class Tree:
    nodes: list[Node]
    paths: list[list[tuple[int, int]]]  # of each leaf: (node, subtree) from the root down


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points: whole numbers, exact in doubles."""
    x, p = x.astype(np.float64), points.astype(np.float64)
    return (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * (x @ p.T)


def spread_points(sample: np.ndarray, fanout: int) -> np.ndarray:
    """Up to fanout different points of the first 3 * fanout, each as far as possible from those before it."""
    few = np.unique(sample[: 3 * fanout], axis=0)
    chosen = [0]
    near = distances(few, few[:1])[:, 0]
    while len(chosen) < min(fanout, len(few)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(few, few[chosen[-1:]])[:, 0])
    return few[chosen]


def grow(sample: np.ndarray, leaf_share: float, *, fanout: int = FANOUT, most_leaves: int = MOST_LEAVES) -> Tree:
    """A tree whose leaves hold about leaf_share of the sample each, the largest parted first; without ranges as yet."""
    tree = Tree([], [])
    ready: list[tuple[list, np.ndarray]] = [([], sample)]
    done: list[list] = []
    while ready:
        ready.sort(key=lambda x: len(x[1]))
        path, own = ready.pop()
        room = len(ready) + len(done) + fanout <= most_leaves
        points = spread_points(own, fanout) if room and len(own) > max(2 * fanout, leaf_share * len(sample)) else own[:0]
        if len(points) < 2:
            done.append(path)
            continue
        at = distances(own, points).argmin(1)
        tree.nodes.append(Node(points, [0] * len(points)))
        n = len(tree.nodes) - 1
        if path:
            tree.nodes[path[-1][0]].kids[path[-1][1]] = n
        ready += [([*path, (n, j)], own[at == j]) for j in range(len(points))]
    for leaf, path in enumerate(done):
        if path:
            tree.nodes[path[-1][0]].kids[path[-1][1]] = ~leaf
    tree.paths = done
    return tree


def descend(tree: Tree, x: np.ndarray, seen=None) -> np.ndarray:
    """The leaf of every row; seen(node, distances, subtree, norms) is told of each node on the way."""
    leaf = np.zeros(len(x), np.int32)
    norms = (x.astype(np.float64) ** 2).sum(1)
    todo = [(0, np.arange(len(x)))] if tree.nodes else []
    while todo:
        n, rows = todo.pop()
        d = distances(x[rows], tree.nodes[n].points)
        at = d.argmin(1)
        if seen:
            seen(n, d, at, norms[rows])
        for j, kid in enumerate(tree.nodes[n].kids):
            own = rows[at == j]
            if not len(own):
                continue
            if kid < 0:
                leaf[own] = ~kid
            else:
                todo.append((kid, own))
    return leaf


def alive(tree: Tree, leaf: int, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For which rows of q the leaf may hold a score in [low, high]: no range on its path misses the annulus."""
    own = (q.astype(np.float64) ** 2).sum(1)
    ok = low <= high
    for n, j in tree.paths[leaf]:
        node = tree.nodes[n]
        at = np.flatnonzero(ok)
        if not len(at):
            break
        d = np.sqrt(np.maximum(distances(q[at], node.points), 0))
        near, far = np.sqrt(node.low[:, j]), np.sqrt(node.high[:, j])
        least = np.maximum(np.maximum(near - d, d - far).max(1), 0) ** 2
        most = (d + far).min(1) ** 2
        inner, outer = own[at] + node.norm_low[j] - 2.0 * high[at], own[at] + node.norm_high[j] - 2.0 * low[at]
        slack = 1 + 1e-9 * (np.abs(inner) + np.abs(outer) + most)  # of the roots; the numbers are whole
        ok[at] = (least <= outer + slack) & (most >= inner - slack)
    return ok


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact: by doubles where all sums stay below 2^53."""
    most = q.shape[1] * (int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)))
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 1 << 53 else q.astype(np.int64) @ x.T.astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ident, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, int)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < n]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _quantised(rows: DataFrame, dim: int, scale: int, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    q = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale))
    safe = F.when(F.exists("v", lambda x: F.abs(x) >= LIMIT), F.raise_error(F.lit(f"a component is {LIMIT} or more after scaling by {scale}"))).otherwise(F.col("v"))
    padded = F.concat("v", F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), q.alias("v"))
    return named.withColumn("v", safe.cast("array<int>")).withColumn("v", padded)


def taking_part(id_col: str, label_col: str, vec_col: str) -> Column:
    finite = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))


def fit(rows: DataFrame, *, n_rows: int, sample_rows: int = SAMPLE, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> tuple[Tree, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tree with its ranges over all rows, the sample's ids, labels and vectors); rows are (id, label, v)."""
    picked = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(sample_rows).collect()  # bounded
    ids, labels = (np.array([r[i] for r in picked], np.int64) for i in (0, 1))
    sample = np.array([r["v"] for r in picked], np.int32).reshape(len(picked), len(picked[0]["v"]) if picked else 0)
    tree = grow(sample, leaf_rows / max(1, n_rows), fanout=fanout)

    def measure(batches):
        got: dict[tuple[int, int], list] = {}

        def seen(n, d, at, norms):
            for j in np.unique(at).tolist():
                own, norm = d[at == j], norms[at == j]
                low, high, few, much, count = got.get((n, j), (np.inf, -np.inf, np.inf, -np.inf, 0))
                got[n, j] = (np.minimum(low, own.min(0)), np.maximum(high, own.max(0)), min(few, norm.min()), max(much, norm.max()), count + len(own))

        for b in batches:
            if b.num_rows:
                descend(tree, _matrix(b.column(0)), seen)
        flat = [(n, j, i, low[i], high[i], few, much, count) for (n, j), (low, high, few, much, count) in got.items() for i in range(len(low))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate(kinds)], names=["n", "j", "i", "low", "high", "few", "much", "rows"])

    if tree.nodes:
        for node in tree.nodes:
            m = len(node.points)
            node.low, node.high = np.full((m, m), np.inf), np.zeros((m, m))
            node.norm_low, node.norm_high = np.full(m, np.inf), np.zeros(m)
        parts = rows.select("v").mapInArrow(measure, "n int, j int, i int, low double, high double, few double, much double, rows long")
        ranges = parts.groupBy("n", "j", "i").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("few").alias("few"), F.max("much").alias("much"))
        for r in ranges.collect():  # at most MOST_LEAVES * FANOUT rows or so
            node = tree.nodes[r["n"]]
            node.low[r["i"], r["j"]], node.high[r["i"], r["j"]] = max(0, r["low"]), r["high"]
            node.norm_low[r["j"]], node.norm_high[r["j"]] = r["few"], r["much"]
    return tree, (ids, labels, sample)


def blocks(rows: DataFrame, tree: Tree, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(leaf, ids, labels, v): the rows of a leaf in packed blocks of about block_rows, rows repeated whole kept once."""

    def route(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(descend(tree, _matrix(b.column(2)))), *b.columns], names=["leaf", "id", "label", "v"])

    def packed(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, labels, v = t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v").chunk(0))
        order = np.lexsort((*v.T[::-1], labels, ids))
        ids, labels, v = ids[order], labels[order], v[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (v[1:] != v[:-1]).any(1)
        ids, labels, v = ids[new], labels[new], v[new]
        return pa.table({"leaf": t.column("leaf")[:1], "ids": pa.array([ids]), "labels": pa.array([labels]), "v": pa.array([v.ravel()], pa.list_(pa.int32()))})

    routed = stash(rows.mapInArrow(route, "leaf int, id long, label long, v array<int>"), "hardneg-rows")
    counts = routed.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    salted = routed.join(F.broadcast(counts), "leaf").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # at most MOST_LEAVES rows
    out = stash(salted.drop("parts").groupBy("leaf", "salt").applyInArrow(packed, "leaf int, ids array<bigint>, labels array<bigint>, v array<int>"), "hardneg-blocks")
    drop_stash(routed)
    return out


def _parts(files: list[str], rows: int):
    """Stretches of a written table, read where they are needed."""
    for f in files:
        fs, path = filesystem(f.removeprefix("file://") if f.startswith("file:///") else f)
        with fs.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(rows)


def _windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bounds [anchor, window] of a part's score windows; a window past an anchor's last one is empty."""
    n = b.column("low")
    width = max([1, *(len(x) for x in n)])
    low, high = np.full((len(n), width), 1, np.int64), np.zeros((len(n), width), np.int64)
    for k, (lo, hi) in enumerate(zip(n.to_pylist(), b.column("high").to_pylist(), strict=True)):
        low[k, : len(lo)], high[k, : len(hi)] = lo, hi
    return low, high


def hits(q, label, ident, low, high, ids, labels, x, *, same: bool, n: int) -> tuple[np.ndarray, ...]:
    """(anchor, window, row, score): the first n rows of every anchor's windows, of its label or of others."""
    s = products(q, x)
    fits = (label[:, None] == labels[None]) == same
    fits &= ident[:, None] != ids[None]
    out = []
    for w in range(low.shape[1]):
        a, r = np.nonzero(fits & (s >= low[:, w, None]) & (s <= high[:, w, None]))
        keep = best(a, s[a, r], ids[r], n)
        out.append((a[keep], np.full(len(keep), w), r[keep], s[a[keep], r[keep]]))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(4))


def search(packed: DataFrame, tree: Tree, anchors: DataFrame, *, same: bool, n: int, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor, window, id, score): at least the first n rows of each window. anchors, a written table: (id, label, v, low, high)."""
    files = list(anchors.inputFiles())

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                leaf, ids, labels = b.column(0)[k].as_py(), *(b.column(c)[k].values.to_numpy() for c in (1, 2))
                x = b.column(3)[k].values.to_numpy()
                x = x.reshape(len(ids), len(x) // len(ids))
                for part in _parts(files, anchor_rows):
                    if not part.num_rows:
                        continue
                    low, high = _windows(part)
                    q = _matrix(part.column("v"))
                    real = low <= high
                    live = np.flatnonzero(alive(tree, leaf, q, np.where(real, low, 1 << 62).min(1), np.where(real, high, NONE).max(1)))
                    if not len(live):
                        continue
                    ident, label = (part.column(c).to_numpy() for c in ("id", "label"))
                    a, w, r, s = hits(q[live], label[live], ident[live], low[live], high[live], ids, labels, x, same=same, n=n)
                    yield pa.RecordBatch.from_arrays([pa.array(ident[live][a]), pa.array(w.astype(np.int32)), pa.array(ids[r]), pa.array(s)], names=["anchor", "window", "id", "score"])

    return packed.mapInArrow(run, "anchor long, window int, id long, score long")


def _raised(anchors: DataFrame, sample, *, same: bool, n: int) -> DataFrame:
    """anchors with each window's lower bound raised to the n-th best score in the sample."""
    ids, labels, x = sample

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                p = b.slice(at, 256)
                low, high = _windows(p)
                a, w, r, s = hits(_matrix(p.column("v")), p.column("label").to_numpy(), p.column("id").to_numpy(), low, high, ids, labels, x, same=same, n=n)
                last = np.full((*low.shape, n), NONE, np.int64)
                place = np.zeros(low.shape, int)
                for i, k, score in zip(a.tolist(), w.tolist(), s.tolist(), strict=True):
                    last[i, k, place[i, k]] = score
                    place[i, k] += 1
                low = np.where(place == n, np.maximum(low, last.min(2)), low)
                size = [len(v) for v in p.column("low")]
                raised = pa.array([low[i, :m].tolist() for i, m in enumerate(size)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(p.column(c) for c in ("id", "label", "v")), raised, p.column("high")], names=["id", "label", "v", "low", "high"])

    return anchors.select("id", "label", "v", "low", "high").mapInArrow(run, "id long, label long, v array<int>, low array<bigint>, high array<bigint>")


def _first(found: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, floor: tuple[int, int] = (50, 100), ceiling: tuple[int, int] = (95, 100), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", **tuning) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its best rows of the same label; for each, the best rows of other labels whose score is at
    least floor and at most ceiling (fractions) of the positive's. tuning: sample_rows, fanout, leaf_rows.
    """
    usable = vectors.where(taking_part(id_col, label_col, vec_col))
    n_rows, dim = usable.agg(F.count("*"), F.coalesce(F.max(F.size(vec_col)), F.lit(0))).first()
    named = usable.withColumn("__anchor", is_anchor)
    rows = _quantised(named, dim, scale, id_col, label_col, vec_col)
    asking = _quantised(named.where("__anchor"), dim, scale, id_col, label_col, vec_col)
    tree, sample = fit(rows, n_rows=n_rows, **tuning)
    packed = blocks(rows, tree)
    first = asking.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    wide = first.withColumns({"low": F.array(F.lit(NONE)), "high": F.array(F.lit(-NONE))})
    anchors = stash(_raised(wide, sample, same=True, n=positives), "hardneg-anchors")
    good = _first(search(packed, tree, anchors, same=True, n=positives), positives)
    good = stash(good.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("window")), "hardneg-positives")
    low = F.expr(f"-((-positive_score * {floor[0]} - pmod(-positive_score * {floor[0]}, {floor[1]})) div {floor[1]})")
    high = F.expr(f"(positive_score * {ceiling[0]} - pmod(positive_score * {ceiling[0]}, {ceiling[1]})) div {ceiling[1]}")
    ranges = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", low.alias("low"), high.alias("high")))).alias("w"))  # at most ``positives`` a group
    asked = anchors.drop("low", "high").join(ranges, F.col("id") == F.col("anchor")).select("id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    windows = stash(_raised(asked, sample, same=False, n=negatives), "hardneg-windows")
    bad = _first(search(packed, tree, windows, same=False, n=negatives), negatives)
    bad = bad.select(F.col("anchor").alias("anchor_id"), F.col("window").alias("__w"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    both = bad.join(good, (F.col("anchor_id") == F.col("anchor")) & (F.col("__w") == F.col("window")))
    return both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
