"""Approximate nearest neighbours by cosine, with a robust-pruned directed graph in each shard.

Rows of equal vectors are one node, which keeps the ``k + 1`` smallest of their ids: no other can be among
the ``k`` nearest of anything. So a vector that a third of all rows have is one node. Nodes are dealt to
cells by the nearest of some centres, which are fitted on a bounded sample; a cell is one shard, or several by
a hash if it is large, and each shard gets a graph: nodes are inserted in blocks, a greedy search from the
entry points proposes neighbours, and relaxed pruning keeps an edge only if no kept neighbour is nearer to
its end by more than a factor (``alpha``); reverse edges are added and pruned in the same way. The graphs are
stored, one row a shard.

Every query visits the shards of the cells nearest to it, in blocks of queries. How many cells that takes is measured:
some queries are compared with all nodes, and ``REACH`` of their neighbours must lie in the cells visited. A beam search
walks the graph, and what it finds is measured again in double precision on the original vectors. The best of all shards are ranked.

Defined results: vectors that are null, zero, or have a null or non-finite component, and rows with a null
id, take no part, neither as queries nor as candidates; vectors of different lengths never meet; rows of equal id
and vector are one; ties go to the smaller id; components stay doubles if they are; other columns take no part; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Nodes of a shard, out-edges of a node, beams of building and searching, and the pruning factor (of squared distances).
SHARD, DEGREE, BEAM_BUILD, BEAM, ALPHA = 8192, 24, 48, 96, 1.44
ENTRIES, BLOCK, EXPAND = 32, 512, 4
#: Queries that a shard is sent for at once, and pairs measured at once.
QUERIES, PAIRS = 16384, 16384
#: Vectors that centres are fitted on, and their bytes; rounds of the fit, vectors to a centre at least; rows multiplied at once.
SAMPLE, SAMPLE_BYTES, ROUNDS, EACH, ROWS = 65536, 16_777_216, 6, 8, 256
#: Queries that the number of cells to visit is measured with, and the share of their neighbours that must lie in these.
MEASURED, REACH = 256, 0.98


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes found for each query, nearest first, -1 where there are fewer, and their squared distances."""
    n_q, n = len(queries), len(x)
    row = np.arange(n_q)[:, None]
    seen = np.zeros((n_q, n + 1), dtype=bool)
    seen[:, n] = True  # stands for "no edge"
    seen[:, entries] = True
    ids = np.broadcast_to(entries, (n_q, len(entries))).copy()
    far = 2 - 2 * queries @ x[entries].T
    done = np.zeros(ids.shape, dtype=bool)
    active = np.arange(n_q)
    out_ids, out_far = np.full((n_q, beam), -1, dtype=np.int64), np.full((n_q, beam), np.inf, dtype=np.float32)
    while True:
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, far, done = ids[row[: len(ids)], order], far[row[: len(ids)], order], done[row[: len(ids)], order]
        over = done.all(axis=1)
        if over.any():
            w = ids.shape[1]
            out_ids[active[over], :w], out_far[active[over], :w] = ids[over], far[over]
            ids, far, done, active = ids[~over], far[~over], done[~over], active[~over]
            if not len(active):
                return np.where(np.isinf(out_far), -1, out_ids), out_far
        at = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]  # the nearest that aren't expanded come first
        r = row[: len(ids)]
        fresh = ~done[r, at]
        done[r, at] = True
        next_ = np.where(fresh[:, :, None], graph[ids[r, at]], n).reshape(len(ids), -1)
        next_ = np.where(seen[active[:, None], next_], n, next_)
        next_.sort(axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = n
        seen[active[:, None], next_] = True
        width = max(1, int((next_ < n).sum(axis=1).max()))
        next_ = np.sort(next_, axis=1)[:, :width]
        gap = 2 - 2 * np.einsum("qrd,qd->qr", x[np.minimum(next_, n - 1)], queries[active])
        gap[next_ == n] = np.inf
        ids, far = np.concatenate([ids, next_], axis=1), np.concatenate([far, gap], axis=1)
        done = np.concatenate([done, next_ == n], axis=1)


def prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each node's candidates (-1: none): nearest first, none that a kept one covers."""
    n = len(nodes)
    own = np.maximum(candidates, 0)
    points = x[own]
    far = 2 - 2 * np.einsum("ncd,nd->nc", points, x[nodes])
    order = np.argsort(own, axis=1, kind="stable")
    twin = np.zeros(own.shape, dtype=bool)
    r = np.arange(n)[:, None]
    by_id = candidates[r, order]
    twin[r, order[:, 1:]] = by_id[:, 1:] == by_id[:, :-1]
    far = np.where((candidates < 0) | (candidates == nodes[:, None]) | twin, np.inf, far)
    between = 2 - 2 * np.matmul(points, points.transpose(0, 2, 1))
    out, left, one = np.full((n, degree), -1, dtype=np.int64), far.copy(), np.arange(n)
    for k in range(degree):
        best = np.argmin(left, axis=1)
        ok = np.isfinite(left[one, best])
        if not ok.any():
            break
        out[ok, k] = candidates[one[ok], best[ok]]
        covered = alpha * between[one, best] <= far
        left[covered & ok[:, None]] = np.inf
        left[one, best] = np.inf
    return out


def build(x: np.ndarray, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Graph (n, DEGREE; n stands for no edge) and entry points over unit vectors."""
    n, rng = len(x), np.random.Generator(np.random.PCG64(seed))
    middle = int(np.argmax(x @ x.mean(axis=0)))
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), middle))
    graph = np.full((n, DEGREE), n, dtype=np.int64)
    if n > 1:
        some = min(DEGREE // 3, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    order = rng.permutation(n)
    for at in range(0, n, BLOCK):
        nodes = order[at : at + BLOCK]
        found, _ = beam_search(x, graph, entries, x[nodes], BEAM_BUILD)
        have = np.where(graph[nodes] == n, -1, graph[nodes])
        kept = prune(x, nodes, np.concatenate([found, have], axis=1), DEGREE, ALPHA)
        graph[nodes] = np.where(kept < 0, n, kept)
        # Reverse edges, gathered by the node that they start from; the nearest 2 * DEGREE new ones are looked at.
        to, start = kept[kept >= 0], np.repeat(nodes, (kept >= 0).sum(axis=1))
        near = 2 - 2 * np.einsum("ed,ed->e", x[to], x[start])
        by = np.lexsort((near, to))
        to, start = to[by], start[by]
        firsts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(to)) - np.repeat(firsts, np.diff(firsts, append=len(to)))
        heads = to[firsts]
        which = np.repeat(np.arange(len(firsts)), np.diff(firsts, append=len(to)))
        ok = nth < 2 * DEGREE
        new = np.full((len(heads), 2 * DEGREE), -1, dtype=np.int64)
        new[which[ok], nth[ok]] = start[ok]
        for part in range(0, len(heads), BLOCK):
            h = heads[part : part + BLOCK]
            have = np.where(graph[h] == n, -1, graph[h])
            kept = prune(x, h, np.concatenate([have, new[part : part + BLOCK]], axis=1), DEGREE, ALPHA)
            graph[h] = np.where(kept < 0, n, kept)
    return graph.astype(np.int32), entries


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows as doubles, each times a power of two that brings its largest component near 1: cosines stay exactly the same."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = scaled(vectors)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vec) of the rows that take part; vec is the bytes of the components, of four bytes each if they are floats, otherwise of eight."""
    kind, to = ("<f4", "array<float>") if "float" in vectors.schema[vector_col].dataType.simpleString() else ("<f8", "array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, packed = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy().astype(kind) + np.zeros(1, dtype=kind)  # -0 is 0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    dims.append(len(x))
                    packed.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["id", "dim", "vec"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast(to)).mapInArrow(run, "id bigint, dim int, vec binary")


def distinct_nodes(rows: DataFrame, keep: int) -> DataFrame:
    """(dim, vec, ids): each vector once with its ``keep`` smallest ids; tasks thin out equal vectors before the shuffle."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[int, bytes], list[int]] = {}
            for i, dim, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((dim, v), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array([dim for dim, _ in held], pa.int32()), pa.array([v for _, v in held], pa.binary()), pa.array([sorted({*x})[:keep] for x in held.values()], pa.list_(pa.int64()))], names=["dim", "vec", "ids"])

    some = rows.mapInArrow(thin, "dim int, vec binary, ids array<bigint>")
    return some.groupBy("dim", "vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=f"<f{len(vectors[0]) // dim}").reshape(-1, dim)


def cosines(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of unit vectors to centres; rows come in blocks of one size, so that a row's figures don't depend on those beside it."""
    padded = np.zeros((-(-len(x) // ROWS) * ROWS, x.shape[1]), dtype=np.float32)
    padded[: len(x)] = x
    return np.concatenate([padded[at : at + ROWS] @ centres.T for at in range(0, len(padded), ROWS)])[: len(x)]


def hashed(seed: int, col: str, share: float):
    """Whether a row belongs to the ``share`` of all rows that a hash chooses."""
    return F.pmod(F.xxhash64(F.lit(seed), col), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def fit(nodes: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """For each dimension with more nodes than a shard holds, the centres of its cells."""
    out = {}
    for dim, n in sorted(counts.items()):
        some = min(SAMPLE, SAMPLE_BYTES // (4 * dim), n)
        n_cells = min(-(-n // min(2 * SHARD, max(SHARD, n // 64))), some // EACH)
        if n_cells < 2:
            continue
        vecs = sorted(r[0] for r in nodes.where((F.col("dim") == dim) & hashed(5, "vec", some / n)).select("vec").collect())
        if len(vecs) < 2:
            continue
        x = unit(matrix(vecs, dim))
        centres = x[np.random.Generator(np.random.PCG64(7)).permutation(len(x))[:n_cells]].copy()
        for _ in range(ROUNDS):
            cell = np.concatenate([cosines(x[at : at + 8192], centres).argmax(axis=1) for at in range(0, len(x), 8192)])
            order = np.argsort(cell, kind="stable")
            have, firsts = np.unique(cell[order], return_index=True)
            sums = np.add.reduceat(x[order].astype(np.float64), firsts, axis=0)
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            ok = length[:, 0] > 0
            centres[have[ok]] = (sums[ok] / length[ok]).astype(np.float32)
        out[dim] = centres
    return out


def in_cells(nodes: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``nodes`` with ``cell``, that of the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vecs = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            cell = np.zeros(len(vecs), dtype=np.int32)
            for dim in np.unique(dims).tolist():
                if dim in centres:
                    at = np.flatnonzero(dims == dim)
                    cell[at] = cosines(unit(matrix([vecs[i] for i in at], dim)), centres[dim]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["dim", "vec", "ids", "cell"])

    return nodes.mapInArrow(run, "dim int, vec binary, ids array<bigint>, cell int") if centres else nodes.withColumn("cell", F.lit(0))


def visits(nodes: DataFrame, queries: DataFrame, n_queries: int, centres: dict[int, np.ndarray], k: int) -> dict[int, int]:
    """For each dimension, the number of nearest cells that hold ``REACH`` of the ``k`` nearest nodes of some queries, by comparing these with all nodes."""
    asked = {}
    for dim, c in centres.items():
        vecs = [r["vec"] for r in queries.where((F.col("dim") == dim) & hashed(6, "id", 4 * MEASURED / max(1, n_queries))).orderBy("id").limit(MEASURED).collect()]
        if vecs:
            q = unit(matrix(vecs, dim))
            asked[dim] = (q, np.argsort(np.argsort(-cosines(q, c), axis=1, kind="stable"), axis=1).astype(np.int32))
    if not asked:
        return {dim: len(c) for dim, c in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vecs, cells = batch.column("dim").to_numpy(), batch.column("vec").to_pylist(), batch.column("cell").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in asked:
                    (q, place), at = asked[dim], np.flatnonzero(dims == dim)
                    far = cosines(unit(matrix([vecs[i] for i in at], dim)), q).T.copy()
                    far[far > 1 - 1e-6] = -2  # the query itself
                    top = np.argpartition(-far, min(k, len(at)) - 1, axis=1)[:, :k]
                    which = np.repeat(np.arange(len(q)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), dim, dtype=np.int32)), pa.array(which.astype(np.int32)), pa.array(far[which, top.ravel()].astype(np.float64)), pa.array(place[which, cells[at][top.ravel()]])], names=["dim", "q", "score", "place"])

    nth = F.row_number().over(W.partitionBy("dim", "q").orderBy(F.col("score").desc(), "place"))
    found = nodes.mapInArrow(run, "dim int, q int, score double, place int").where("score > -2").withColumn("nth", nth).where(F.col("nth") <= k).select("dim", "place").collect()
    out = {}
    for dim, c in centres.items():
        places = sorted(r["place"] for r in found if r["dim"] == dim)
        out[dim] = places[min(len(places) - 1, int(REACH * len(places)))] + 1 if places else len(c)
    return out


def to_shards(nodes: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """``nodes`` with ``shard`` instead of ``cell``, and the first shard and number of shards of each (dim, cell): large cells are split by a hash."""
    counts = sorted((r["dim"], r["cell"], r["count"]) for r in nodes.groupBy("dim", "cell").count().collect())
    held, first = {}, {}
    for dim, cell, n in counts:
        parts = -(-n // (2 * SHARD))
        held[dim, cell] = (first.get(dim, 0), parts)
        first[dim] = first.get(dim, 0) + parts
    rows = [(dim, cell, *x) for (dim, cell), x in held.items()]
    where = nodes.sparkSession.createDataFrame(rows, "dim int, cell int, first int, parts int")
    return nodes.join(F.broadcast(where), ["dim", "cell"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64(F.lit(3), "vec"), F.col("parts"))).cast("int")).drop("cell", "first", "parts"), held


def route(queries: DataFrame, centres: dict[int, np.ndarray], most: dict[int, int], held: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """``queries(id, dim, vec)`` with each ``shard`` that it visits."""
    shards = lambda dim, cells: [s for c in cells if (dim, c) in held for s in range(held[dim, c][0], sum(held[dim, c]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vecs = batch.column("dim").to_numpy(), batch.column("vec").to_pylist()
            asked = [[0]] * len(vecs)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim in centres:
                    near = np.argsort(-cosines(unit(matrix([vecs[i] for i in at], dim)), centres[dim]), axis=1, kind="stable")[:, : most[dim]].tolist()
                for j, i in enumerate(at.tolist()):
                    asked[i] = shards(dim, near[j] if dim in centres else [0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(asked, pa.list_(pa.int32()))], names=["id", "dim", "vec", "shards"])

    return queries.select("id", "dim", "vec").mapInArrow(run, "id bigint, dim int, vec binary, shards array<int>").select("id", "dim", "vec", F.explode("shards").alias("shard"))


def index(dealt: DataFrame) -> DataFrame:
    """(dim, shard, vecs, graph, entries, ids, counts): a graph for each shard of nodes (dim, vec, ids, shard)."""

    def run(block: pa.Table) -> pa.Table:
        dim, shard = block.column("dim")[0].as_py(), block.column("shard")[0].as_py()
        raw = block.column("vec").to_pylist()
        order = sorted(range(len(raw)), key=raw.__getitem__)  # the same graph however rows come
        x = np.frombuffer(b"".join(raw[i] for i in order), dtype=f"<f{len(raw[0]) // dim}").reshape(-1, dim)
        ids = block.column("ids").to_pylist()
        graph, entries = build(unit(x))
        flat = np.array([j for i in order for j in ids[i]], dtype="<i8")
        counts = np.array([len(ids[i]) for i in order], dtype="<i4")
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "vecs": [x.tobytes()], "graph": [graph.astype("<i4").tobytes()], "entries": [entries.astype("<i8").tobytes()], "ids": [flat.tobytes()], "counts": [counts.tobytes()]})

    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, vecs binary, graph binary, entries binary, ids binary, counts binary")


def search(shards: DataFrame, asked: DataFrame, n_queries: int, k: int, *, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest that the shards' graphs give for ``asked`` (id, dim, vec, shard)."""
    groups = max(1, -(-n_queries // QUERIES))

    def group(block: pa.Table) -> pa.Table:
        order = np.argsort(block.column("id").to_numpy(), kind="stable")
        vecs = block.column("vec").to_pylist()
        return pa.table({"dim": pa.array(block.column("dim")[:1].to_pylist(), pa.int32()), "shard": pa.array(block.column("shard")[:1].to_pylist(), pa.int32()), "query_ids": pa.array([block.column("id").to_numpy()[order].astype("<i8").tobytes()], pa.binary()), "query_vecs": pa.array([b"".join(vecs[i] for i in order)], pa.binary())})

    def near(x: np.ndarray, q: np.ndarray, own: np.ndarray, row: dict, graph: np.ndarray) -> tuple[np.ndarray, ...]:
        """For one block of queries: their ids, the ids found and the scores, ``k`` of each at most."""
        ids, counts = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["counts"], dtype="<i4").astype(np.int64)
        found, _ = beam_search(unit(x), graph, np.frombuffer(row["entries"], dtype="<i8"), unit(q), beam)
        which, place = np.nonzero(found >= 0)
        node = found[which, place]
        a, v = scaled(q), scaled(x)
        exact = np.concatenate([(v[node[at : at + PAIRS]] * a[which[at : at + PAIRS]]).sum(axis=1) for at in range(0, len(node), PAIRS)])
        exact /= np.sqrt((v * v).sum(axis=1))[node] * np.sqrt((a * a).sum(axis=1))[which]
        each = np.repeat(np.arange(len(node)), counts[node])
        begin = np.cumsum(counts) - counts
        all_ids = ids[begin[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(counts[node]) - counts[node], counts[node])]
        query, score = which[each], exact[each]
        other = all_ids != own[query]
        query, score, all_ids = query[other], score[other], all_ids[other]
        order = np.lexsort((all_ids, -score, query))
        query, score, all_ids = query[order], score[order], all_ids[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        top = nth < k
        return own[query[top]], all_ids[top], score[top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dim, own = row["dim"], np.frombuffer(row["query_ids"], dtype="<i8")
                x, q = (np.frombuffer(row[c], dtype=f"<f{len(row['query_vecs']) // (dim * len(own))}").reshape(-1, dim) for c in ("vecs", "query_vecs"))
                graph = np.frombuffer(row["graph"], dtype="<i4").reshape(-1, DEGREE)
                for at in range(0, len(own), BLOCK):
                    a, b, c = near(x, q[at : at + BLOCK], own[at : at + BLOCK], row, graph)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

    # A shard is sent once for each QUERIES queries, never once for each block of them.
    grouped = asked.withColumn("group", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(groups))).groupBy("dim", "shard", "group").applyInArrow(group, "dim int, shard int, query_ids binary, query_vecs binary")
    near_ = grouped.join(shards, ["dim", "shard"]).select("dim", "vecs", "graph", "entries", "ids", "counts", "query_ids", "query_vecs").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near_.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``, among all rows but itself."""
    rows = usable(vectors, id_col, vector_col)
    nodes = cut(distinct_nodes(rows, k + 1))
    counts = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    centres = fit(nodes, counts)
    queries = cut(rows.where(F.pmod("id", F.lit(every)) == 0).distinct())
    n_queries = queries.count()
    celled = in_cells(nodes, centres)
    most = visits(celled, queries, n_queries, centres, k) if centres else {}
    dealt, held = to_shards(celled)
    shards = cut(index(dealt))
    return search(shards, route(queries, centres, most, held), n_queries, k)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the 5 nearest of each 50th vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
