"""Embedding near-dedup over a robust-pruned flat graph.

Exact copies are folded first.  The distinct vectors have their home in the cell
of the nearest of some centroids, which are fitted on a bounded sample, and
visit every earlier cell in which a vector within the threshold could be at
home (see ``visits``), so every pair that is to be linked meets in the home cell
of one of the two, once.  Where that bound spares too little, all vectors are
one cell; both ways are exact.  A cell, or a pair of chunks of a cell that is
too large for one task, is a block, and a block's vectors are all compared: in
blocks of this size that costs less than the walk over the robust-pruned graph
(``build_graph``, ``range_search``), which loses links and whose audit would
have to be such a scan to be sure.  Pairs are verified in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, cut

DEGREE, CANDIDATES, BEAM, WIDTH, SHARD, ALPHA = 16, 48, 24, 48, 256, 1.2
#: Cells are used where a sample row is sent to this share, at most, of what it would be sent to without a bound.
SPARED = 0.5


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means with evenly spaced seeds; deterministic."""
    x = x.astype(np.float32)
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centroids of each row, ascending by number."""
    m = min(m, len(c))
    s = x.astype(np.float32) @ c.T
    return np.sort(np.argpartition(-s, m - 1, axis=1)[:, :m], axis=1)


def visits(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's home, its nearest centroid, and the cells it is sent to, its home the last.

    A row v with home h is sent to each earlier cell k with
    v.(h - k) <= sin(acos(threshold)) |h - k|.  That holds for the home k of
    every row u with u.v >= threshold: v = cos(a) u + sin(a) w for a unit w, and
    u.(h - k) <= 0.  So of two such rows the one of the later home is sent to
    the other's home.  The slack is far above the error of double precision.
    """
    c = c.astype(np.float64)
    sin = math.sqrt(max(0.0, 1 - threshold * threshold)) if threshold >= 0 else math.inf
    homes, cells = [np.empty(0, dtype=np.int64)], []
    number = np.arange(len(c))
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ c.T
        home = s.argmax(axis=1)
        own = c[home]
        apart = np.sqrt(np.maximum((own * own).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * own @ c.T, 0))
        sent = np.ones(s.shape, dtype=bool) if sin == math.inf else s[np.arange(len(s)), home][:, None] - s <= sin * apart + 1e-6
        sent &= number <= home[:, None]
        homes.append(home)
        cells += [np.flatnonzero(row) for row in sent]
    return np.concatenate(homes), cells


def robust_prune(sims: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of one shard, given its similarity matrix.

    Each vector scans its nearest candidates; a pick removes the candidates
    that lie alpha times nearer to the pick than to the vector.
    """
    n = len(sims)
    if n < 2:
        return []
    s = sims.copy()
    np.fill_diagonal(s, -4)
    c = min(candidates, n - 1)
    pool = np.argpartition(-s, c - 1, axis=1)[:, :c]
    rows = np.arange(n)
    order = np.argsort(-s[rows[:, None], pool], axis=1, kind="stable")
    pool = np.take_along_axis(pool, order, axis=1)
    far = np.sqrt(np.maximum(2 - 2 * s[rows[:, None], pool], 0))
    alive = np.ones(pool.shape, dtype=bool)
    edges = []
    for _ in range(min(degree, c)):
        has = alive.any(axis=1)
        if not has.any():
            break
        r = rows[has]
        first = alive[has].argmax(axis=1)
        pick = pool[r, first]
        edges.append((r, pick))
        between = np.sqrt(np.maximum(2 - 2 * sims[pick[:, None], pool[r]], 0))
        alive[r] &= alpha * between > far[r]
        alive[r, first] = False
    return edges


def build_graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """United adjacency lists (padded with -1) of overlapping shards, and the shards' medoids."""
    n = len(x)
    m = max(1, math.ceil(n / SHARD))
    c = fit_centroids(x, m, 4)
    owner = nearest(x, c, 2)
    us, vs, medoids = [], [], []
    for k in range(len(c)):
        idx = np.flatnonzero((owner == k).any(axis=1))
        if not len(idx):
            continue
        medoids.append(idx[int((x[idx] @ c[k]).argmax())])
        for part in np.array_split(idx, max(1, math.ceil(len(idx) / (6 * SHARD)))):  # bounds a crowded shard's matrix
            for u, v in robust_prune(x[part] @ x[part].T):
                us.append(part[u])
                vs.append(part[v])
    if not us:
        return np.full((n, 1), -1, dtype=np.int32), np.array(medoids, dtype=np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    key = np.unique(np.concatenate([u * n + v, v * n + u]))
    u, v = key // n, key % n
    start = np.searchsorted(u, np.arange(n))
    rank = np.arange(len(u)) - start[u]
    if rank.max() >= WIDTH:  # a hub keeps an even choice of its links
        degree = np.bincount(u, minlength=n)
        step = np.maximum(1, np.ceil(degree / WIDTH)).astype(int)[u]
        keep = (rank % step == 0) | (degree[u] <= WIDTH)
        u, v = u[keep], v[keep]
        rank = np.arange(len(u)) - np.searchsorted(u, np.arange(n))[u]
    adj = np.full((n, int(rank.max()) + 1), -1, dtype=np.int32)
    adj[u, rank] = v
    return adj, np.unique(np.array(medoids, dtype=np.int64))


def _visit(q, node, visited, owner):
    """Of the pairs (q, node), those not seen before, once each; marks them as seen."""
    ok = node >= 0
    q, node = q[ok], node[ok]
    new = ~visited[q, node]
    q, node = q[new], node[new]
    owner[q, node] = np.arange(len(q), dtype=np.int32)
    once = owner[q, node] == np.arange(len(q), dtype=np.int32)
    q, node = q[once], node[once]
    visited[q, node] = True
    return q, node


def range_search(x: np.ndarray, queries: np.ndarray, adj: np.ndarray, medoids: np.ndarray, floor: float, beam: int = BEAM, batch: int = 512):
    """Pairs (query row, vector) with similarity of at least ``floor`` that the graph walk finds."""
    n, width = len(x), adj.shape[1]
    found_q, found_v = [], []
    for at in range(0, len(queries), batch):
        rows = queries[at : at + batch]
        nq = len(rows)
        visited = np.zeros((nq, n), dtype=bool)
        owner = np.zeros((nq, n), dtype=np.int32)
        hit_q, hit_v = [], []

        def seen(q, node, rows=rows, hit_q=hit_q, hit_v=hit_v):
            s = np.einsum("ij,ij->i", x[rows[q]], x[node])
            near = s >= floor
            hit_q.append(q[near])
            hit_v.append(node[near])
            return s

        size = max(beam, len(medoids) + 8)
        ids = np.full((nq, size), -1, dtype=np.int64)
        sims = np.full((nq, size), -9, dtype=np.float32)
        done = np.ones((nq, size), dtype=bool)
        ids[:, : len(medoids)] = medoids
        q0, v0 = np.repeat(np.arange(nq), len(medoids)), np.tile(medoids, nq)
        visited[q0, v0] = True
        sims[:, : len(medoids)] = seen(q0, v0).reshape(nq, -1)
        done[:, : len(medoids)] = False
        while True:
            open_ = np.where(done, -9, sims)
            best = np.argpartition(-open_, 1, axis=1)[:, :2]
            bq, bc = np.repeat(np.arange(nq), 2), best.ravel()
            live = open_[bq, bc] > -9
            bq, bc = bq[live], bc[live]
            if not len(bq):
                break
            done[bq, bc] = True
            q, node = _visit(np.repeat(bq, width), adj[ids[bq, bc]].ravel(), visited, owner)
            if not len(q):
                continue
            s = seen(q, node)
            order = np.argsort(q, kind="stable")
            q, node, s = q[order], node[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, np.arange(nq))[q]
            more = int(rank.max()) + 1
            i2 = np.full((nq, size + more), -1, dtype=np.int64)
            s2 = np.full((nq, size + more), -9, dtype=np.float32)
            d2 = np.ones((nq, size + more), dtype=bool)
            i2[:, :size], s2[:, :size], d2[:, :size] = ids, sims, done
            i2[q, size + rank], s2[q, size + rank], d2[q, size + rank] = node, s, False
            top = np.argpartition(-s2, size - 1, axis=1)[:, :size]
            ids, sims, done = (np.take_along_axis(z, top, axis=1) for z in (i2, s2, d2))
        # range expansion: every hit's neighbours, until no new hit turns up
        k = 0
        while k < len(hit_q):
            fq, fv = hit_q[k], hit_v[k]
            k += 1
            for i in range(0, len(fq), 4096):
                q, node = _visit(np.repeat(fq[i : i + 4096], width), adj[fv[i : i + 4096]].ravel(), visited, owner)
                if len(q):
                    seen(q, node)
        found_q.append(rows[np.concatenate(hit_q)])
        found_v.append(np.concatenate(hit_v))
    return np.concatenate(found_q), np.concatenate(found_v)


def scan(x: np.ndarray, queries: np.ndarray, floor: float):
    """The same pairs by brute force, in blocks of queries."""
    qs, vs = [np.empty(0, int)], [np.empty(0, int)]
    for i in range(0, len(queries), 512):
        q, v = np.nonzero(x[queries[i : i + 512]] @ x.T >= floor)
        qs.append(queries[i + q])
        vs.append(v)
    return np.concatenate(qs), np.concatenate(vs)


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(vectors: np.ndarray, threshold: float, copies: np.ndarray, home: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many copies each row of a block links with, and the smallest row of its component.

    Every pair with a row that is at home is compared; where ``left`` is given,
    every such pair of a row of it and a row that isn't.  Pairs are not kept.
    """
    xd = unit(vectors)
    x = xd.astype(np.float32)
    n, floor = len(x), threshold - 1e-4
    a, b = (np.arange(n), np.arange(n)) if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    everyone, root, linked = np.arange(n), np.arange(n), np.zeros(n)
    for i in range(0, len(a), 512):
        other = b[i:] if left is None else b
        q, v = np.nonzero(x[a[i : i + 512]] @ x[other].T >= floor)
        u, v = a[i + q], other[v]
        ok = home[u] | home[v]  # two visitors meet elsewhere
        if left is None:
            ok &= u < v
        u, v = u[ok], v[ok]
        ok = np.concatenate([np.empty(0, bool), *((xd[u[k : k + 65536]] * xd[v[k : k + 65536]]).sum(axis=1) >= threshold for k in range(0, len(u), 65536))])
        u, v = u[ok], v[ok]
        if len(u):
            linked += np.bincount(u, weights=copies[v], minlength=n) + np.bincount(v, weights=copies[u], minlength=n)
            root = local_roots(n, np.concatenate([u, everyone]), np.concatenate([v, root]))
    return linked.astype(np.int64), root


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    overlap: int = 3,
    cell_rows: int = 600,
    block_rows: int = 4096,
    max_cells: int = 8192,
    fit_rows: int = 131_072,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``, ``copies``.

    Only vectors of equal, non-null labels and of one length are compared.  A
    null, empty, zero or non-finite vector, a null label and a null id link
    with nothing: n_links 0, component_id the id itself.  Exact copies link
    with each other and share everything.  A repeated id names one node.  The
    result of an empty table is empty; further columns are ignored.

    ``fit_rows`` bounds the sample the centroids are fitted on (16 rows a
    centroid at most); every row is routed and compared.  ``max_cells`` bounds
    the broadcast centroids, one for ``cell_rows`` vectors of the largest label.
    Labels of up to ``overlap * cell_rows`` vectors are one cell.  A cell of
    more than ``block_rows`` vectors is cut into chunks whose pairs are compared
    as separate tasks.  None of these changes which pairs are compared: where
    vectors have no clusters, that is all pairs of a label.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    usable = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("vec") > 0)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    reps = cut(rows.where(usable).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vec")))
    largest = reps.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    cells = 1 if largest <= overlap * cell_rows else min(max_cells, math.ceil(largest / cell_rows))
    centroids: dict[int, np.ndarray] = {}
    if cells > 1:
        fit = reps.select("dim", "vec").orderBy(F.xxhash64("rep"), "rep").limit(min(fit_rows, max(2048, 16 * cells))).toPandas()
        for dim, part in fit.groupby("dim"):
            x = unit(np.stack(part["vec"].to_numpy()))
            c = fit_centroids(x, cells)
            sent = sum(map(len, visits(x[:2048], c, threshold)[1])) / len(x[:2048])
            if sent <= SPARED * (len(c) + 1) / 2:  # else chunks of one cell are fewer copies of each row
                centroids[int(dim)] = c
    shared = spark.sparkContext.broadcast(centroids)

    def route(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                c = shared.value.get(int(dim))
                home, own = ([0] * len(part), [[0]] * len(part)) if c is None else visits(unit(np.stack(part["vec"].to_numpy())), c, threshold)
                yield part.assign(home=home, cells=[[int(k) for k in row] for row in own])

    kind = dict(reps.dtypes)
    schema = f"label {kind['label']}, vec {kind['vec']}, rep long, copies long, dim int, home int, cells array<int>"
    routed = reps.mapInPandas(route, schema).withColumn("cell", F.explode("cells"))
    sizes = routed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    blocks = (
        routed.join(sizes, ["label", "dim", "cell"])
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("label", "dim", "cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "copies", "home", "vec")
    )
    keys = ["label", "dim", "cell", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell, i, j = key[2:]
        pdf = pdf.sort_values("rep", ignore_index=True)
        ids, copies, chunks, home = (pdf[c].to_numpy() for c in ("rep", "copies", "chunk", "home"))
        n, root = block_links(np.stack(pdf["vec"].to_numpy()), threshold, copies, home == cell, None if i == j else chunks == i)
        some = n > 0
        return pd.DataFrame({"rep": ids[some], "n": n[some], "root": ids[root][some]})

    found = cut(blocks.repartition(parts, *keys).groupBy(*keys).applyInPandas(search, "rep long, n long, root long"))
    roots = components(found.where("rep <> root").select("rep", "root"), "rep", "root")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_rep = (
        reps.join(counts, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vec", "rep", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    out = rows.withColumn("usable", usable).join(per_rep, ["label", "vec"], "left")
    mine = F.col("usable") & F.col("rep").isNotNull()
    component = F.when(mine, F.col("root")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(mine, F.col("n") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("id")).alias("kept"),
        F.when(mine, F.col("copies")).otherwise(1).cast("long").alias("copies"),
    )
