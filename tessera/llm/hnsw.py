"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors stand for one node. Nodes are dealt to shards of bounded bytes by hash; each shard
gets a graph of layers, in the upper of which are ever fewer of its nodes, written to the shared
folder with its vectors. Neighbours are chosen so that none is nearer to another one chosen than to the node, then the
nearest fill up, so dense groups stay tied to their surroundings. Every pair of shards is searched:
the vectors of one query the graph of the other (of two, the one that comes at most half way round
the circle of shards behind the other), down the layers, then with a beam over the lowest one, and what is found
counts for both ends. A beam that ends full of links, or of nodes that are nearly links, is widened until it isn't; from
one in WIDEST nodes of the shard on, the shard is scanned instead. A task loads one graph and streams the vectors of the other shards
through it.

Before use each shard's beam is audited against brute force: on nodes of the shard and of the whole
table, without the node itself, and on vectors planted around nodes at all cosines from ``least`` to
1. The beam is doubled until the queries' mean recall is AUDIT_RECALL; a shard whose audit fails with the
widest beam is scanned in whole. The least recall is a column of the result. Links are verified by cosine
in double precision. A task counts links itself and hands on only as many as connect what it has seen,
so a group of g near vectors costs a task g rows, not g * g.

Queries are answered many at a time: all beams of a block take their steps together.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are their own components; vectors of different lengths aren't linked; repeated rows
count as other vectors that are linked (equal vectors have cosine 1); rows with a null id take
part, their component is the smallest id they reach and they are never kept; rows with one id are rows
of their own; an empty table gives an empty one; other columns of the input, whatever their names, are not read. There are no texts
and no ties: a cosine of exactly ``least`` is a link.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, give_back, map_arrow, new_path, open_fs, remove_path, written
from .components import connected_components

NEIGHBOURS, BUILD_BEAM, BEAM, STEP = 16, 48, 32, 4
#: Bytes of a shard's vectors, and the fewest shards (they don't grow with small inputs).
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 6
#: Shards that a task streams through its graph, and bytes of their vectors at a time.
STREAM, BLOCK_BYTES = 16, 1 << 20
WIDEST = 32
AUDIT, AUDIT_RECALL = 128, 0.999
SLACK = 1e-4  # of cosines in single precision
#: A beam is widened while its last node is no further than this from a link: among many nodes that
#: are about as near, the few that are links are not on the way of a narrow beam.
MARGIN = 0.05


def _beams(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and cosines of the ``width`` best found from the entries, best first."""
    n, lanes = len(x), len(q)
    seen = np.zeros((lanes, n), dtype=bool)
    ids = np.full((lanes, width), -1, dtype=np.int64)
    sims = np.full((lanes, width), -2.0, dtype=np.float32)
    spent = np.zeros((lanes, width), dtype=bool)
    e = entry[:, :width]
    ids[:, : e.shape[1]] = e
    lane = np.arange(lanes)
    for k in range(e.shape[1]):  # an entry that repeats counts once
        again = seen[lane, e[:, k]] | (e[:, k] < 0)
        seen[lane, e[:, k]] |= e[:, k] >= 0
        sims[:, k] = np.where(again, -2.0, np.einsum("ij,ij->i", q, x[e[:, k]]))
        ids[again, k] = -1
    while True:
        open_ = ~spent & (ids >= 0)
        chosen = open_ & (np.cumsum(open_, axis=1) <= STEP)
        rows, columns = np.nonzero(chosen)
        if not len(rows):
            return ids, sims
        spent[rows, columns] = True
        found = near[ids[rows, columns]]
        rows = np.repeat(rows, found.shape[1])
        found = found.reshape(-1)
        new = (found >= 0) & ~seen[rows, found]
        key = np.unique(rows[new] * n + found[new])
        if not len(key):
            continue
        rows, found = key // n, key % n
        seen[rows, found] = True
        sim = np.einsum("ij,ij->i", q[rows], x[found])
        better = sim > sims[rows, -1]
        rows, found, sim = rows[better], found[better], sim[better]
        if not len(rows):
            continue
        which, first, count = np.unique(rows, return_index=True, return_counts=True)
        place = np.arange(len(rows)) - np.repeat(first, count)
        wide = int(count.max())
        row = np.repeat(np.arange(len(which)), count)
        more_sims = np.full((len(which), wide), -2.0, dtype=np.float32)
        more_ids = np.full((len(which), wide), -1, dtype=np.int64)
        more_sims[row, place], more_ids[row, place] = sim, found
        all_sims = np.concatenate([sims[which], more_sims], axis=1)
        all_ids = np.concatenate([ids[which], more_ids], axis=1)
        all_spent = np.concatenate([spent[which], np.zeros_like(more_ids, dtype=bool)], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        sims[which], ids[which], spent[which] = (np.take_along_axis(a, order, axis=1) for a in (all_sims, all_ids, all_spent))


def _choose(x: np.ndarray, base: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (-1: none) up to ``most`` neighbours for each base."""
    out = np.full((len(base), most), -1, dtype=np.int64)
    for at in range(0, len(base), 512):
        b, c = base[at : at + 512], candidates[at : at + 512]
        sim = np.where((c >= 0) & (c != b[:, None]), np.einsum("ij,ikj->ik", x[b], x[c]), -2.0)
        order = np.argsort(-sim, axis=1, kind="stable")
        c, sim = np.take_along_axis(c, order, axis=1), np.take_along_axis(sim, order, axis=1)
        valid = sim > -1.5
        valid[:, 1:] &= c[:, 1:] != c[:, :-1]
        between = np.matmul(x[c], x[c].transpose(0, 2, 1))
        crowd = np.full(sim.shape, -2.0, dtype=np.float32)
        kept = np.zeros(sim.shape, dtype=bool)
        for k in range(sim.shape[1]):
            take = valid[:, k] & (crowd[:, k] < sim[:, k]) & (kept.sum(axis=1) < most)
            kept[take, k] = True
            crowd[take] = np.maximum(crowd[take], between[take, k])
        rank = np.where(kept, 0, np.where(valid, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        chosen = np.where(np.take_along_axis(rank, order, axis=1) < 2, np.take_along_axis(c, order, axis=1), -1)
        out[at : at + 512, : chosen.shape[1]] = chosen
    return out


class Graph:
    """Layers of neighbours over unit vectors (single precision), the highest last."""

    def __init__(self, x: np.ndarray, seed: int = 4):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        level = np.minimum(np.random.default_rng(seed).geometric(1 - 1 / NEIGHBOURS, n) - 1, 6) if n else np.empty(0, dtype=np.int64)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # members; neighbours by place among all
        for k in range(int(level.max(initial=0)), -1, -1):
            self._layer(np.flatnonzero(level >= k), 2 * NEIGHBOURS if k == 0 else NEIGHBOURS)

    def _block(self) -> int:
        return max(16, min(1024, (24 << 20) // max(1, len(self.x))))

    def entries(self, q: np.ndarray) -> np.ndarray:
        """Entry points into the next layer below those there are."""
        entry = np.zeros((len(q), 1), dtype=np.int64)
        if self.layers:
            entry[:] = self.layers[0][0][0]
        for _, near in self.layers:
            entry = np.maximum(_beams(self.x, near, q, entry, 4)[0], -1)
            entry[:, 1:] = np.where(entry[:, 1:] < 0, entry[:, :1], entry[:, 1:])
        return entry

    def _layer(self, members: np.ndarray, most: int) -> None:
        x, near = self.x, np.full((len(self.x), most), -1, dtype=np.int64)
        done = 0
        while done < len(members):
            new = members[done : done + (128 if not done else min(done, self._block()))]
            own = x[new] @ x[new].T
            np.fill_diagonal(own, -2)
            beside = new[np.argsort(-own, axis=1)[:, : most if done else BUILD_BEAM]]
            beside = beside[:, : len(new) - 1] if len(new) > 1 else np.full((len(new), 1), -1)
            if done:
                start = self.entries(x[new]) if self.layers else np.full((len(new), 1), members[0])
                # the layer above also holds nodes that this one doesn't have yet
                there = np.zeros(len(x), dtype=bool)
                there[members[:done]] = True
                start = np.where(there[start], start, members[0])
                found, _ = _beams(x, near, x[new], start, BUILD_BEAM)
                beside = np.concatenate([found, beside], axis=1)
            near[new] = _choose(x, new, beside, most)
            # links back: to what each has, or the best of both where that is too much
            a, b = np.repeat(new, most), near[new].reshape(-1)
            ok = b >= 0
            a, b = a[ok], b[ok]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            to, first, count = np.unique(b, return_index=True, return_counts=True)
            for part in range(0, int(count.max(initial=0)), most):
                some = np.flatnonzero(count > part)
                wide = int(np.minimum(count[some] - part, most).max())
                place = first[some][:, None] + part + np.arange(wide)
                fits = np.arange(wide) + part < count[some][:, None]
                back = np.where(fits, a[np.minimum(place, len(a) - 1)], -1)
                near[to[some]] = _choose(x, to[some], np.concatenate([near[to[some]], back], axis=1), most)
            done += len(new)
        self.layers.append((members, near))

    def search(self, q: np.ndarray, least: float, beam: int):
        """Yields pairs (rows of q, nodes) with cosines that may be at least ``least``, some rows at a
        time. A beam full of such nodes, or of nodes within MARGIN of them, is widened; instead of a
        width of one in WIDEST of the nodes or more, they are scanned."""
        _, near = self.layers[-1]
        block = self._block()
        for at in range(0, len(q), block):
            part = q[at : at + block]
            left, width = np.arange(len(part)), beam
            entry = self._down(part) if width < len(self.x) else None
            while len(left) and (width == beam or WIDEST * width < len(self.x)) and width < len(self.x):
                ids, sims = _beams(self.x, near, part[left], entry[left], width)
                full = sims[:, -1] >= least - MARGIN
                r, c = np.nonzero((sims >= least - SLACK) & ~full[:, None])
                yield at + left[r], ids[r, c]
                left, width = left[full], 4 * width
            for r, c in scan(self.x, part[left], least):
                yield at + left[r], c

    def _down(self, q: np.ndarray) -> np.ndarray:
        lowest = self.layers.pop()
        try:
            return self.entries(q)
        finally:
            self.layers.append(lowest)


def scan(x: np.ndarray, q: np.ndarray, least: float):
    """The same pairs by brute force, in blocks."""
    step = max(1, (2 << 20) // max(1, len(x)))
    for at in range(0, len(q), step):
        r, c = np.nonzero(q[at : at + step] @ x.T >= least - SLACK)
        yield at + r, c


def units(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, k (key of equal vectors, null if it can't be linked), unit (doubles)."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def start():
        def make(batch):
            column = batch.column("v")
            size = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            every = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
            begins = np.cumsum(size) - size
            keys, out = [None] * len(size), [None] * len(size)
            for n in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == n)
                x = every[begins[at][:, None] + np.arange(n)] + 0.0
                peak = np.abs(x).max(axis=1)
                good = np.isfinite(x).all(axis=1) & (peak > 0)
                at, x = at[good], x[good] / peak[good, None]  # squares neither overflow nor vanish
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for i, own, u in zip(at.tolist(), x, unit):
                    keys[i] = int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))
                    out[i] = u.tobytes()
            return [batch.column("id"), pa.array(keys, pa.int64()), pa.array(out, pa.binary())]

        return make

    return map_arrow(rows, "vec_id bigint, k bigint, unit binary", start, by=None)


def _stack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def recall(graph: Graph, queries: np.ndarray, own: np.ndarray, least: float, beam: int) -> float:
    """Mean over the queries that have links of the share of them that is found; ``own``: the node
    that a query is itself, or -1."""
    shares = []
    for at in range(0, len(queries), 16):
        q, self_ = queries[at : at + 16], own[at : at + 16]
        want = np.zeros((len(q), len(graph.x)), dtype=bool)
        for r, c in scan(graph.x, q, least):
            want[r, c] = self_[r] != c
        links, found = want.sum(axis=1), np.zeros(len(q), dtype=np.int64)
        for r, c in graph.search(q, least, beam):
            np.add.at(found, r, want[r, c])
        shares.append(found[links > 0] / links[links > 0])
    shares = np.concatenate(shares)
    return float(shares.mean()) if len(shares) else 1.0


def audit(graph: Graph, queries: np.ndarray, own: np.ndarray, least: float) -> tuple[int, float]:
    """The beam (0: the shard has to be scanned) and its recall."""
    beam = BEAM
    while beam < len(graph.x):
        if (found := recall(graph, queries, own, least, beam)) >= AUDIT_RECALL:
            return beam, found
        beam *= 2
    return 0, 1.0


def planted(x: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Vectors around nodes, one each, at cosines from ``least`` to 1."""
    near = x[rng.choice(len(x), AUDIT)]
    aside = rng.normal(size=near.shape)
    aside -= (aside * near).sum(axis=1, keepdims=True) * near
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    cosine = rng.uniform(least, 1, (len(near), 1))
    return cosine * near + np.sqrt(1 - cosine**2) * aside


def build(nodes: DataFrame, shards: int, least: float, sample: list[bytes]) -> list[dict]:
    """Writes a graph for each shard and vector length; returns what was written: path, shard,
    size, beam and audited recall."""
    to = new_path(nodes.sparkSession, "graphs")
    rows = nodes.select("k", "n", "unit", F.length("unit").alias("size"), F.pmod(F.xxhash64("k", F.lit(4)), F.lit(shards)).cast("int").alias("shard"))

    def run(table: pa.Table) -> pa.Table:
        # nodes in the order of their keys, whatever order they came in
        table = table.sort_by("k")
        size, shard = table.column("size")[0].as_py(), table.column("shard")[0].as_py()
        exact = _stack(table.column("unit"), size // 8)
        k, n = table.column("k").to_numpy(), table.column("n").to_numpy()
        graph = Graph(exact)
        rng = np.random.default_rng(shard)
        at = rng.choice(len(exact), min(AUDIT, len(exact)), replace=False)
        there = {x.tobytes(): i for i, x in enumerate(exact)}
        samples = [a for a in sample if len(a) == size]
        queries = np.concatenate([exact[at], np.array([np.frombuffer(a) for a in samples]).reshape(-1, size // 8), planted(exact, least, rng)])
        own = np.concatenate([at, [there.get(a, -1) for a in samples], np.full(AUDIT, -1)]).astype(np.int64)
        beam, found = audit(graph, queries.astype(np.float32), own, least)
        fs, folder = open_fs(to)
        fs.create_dir(folder, recursive=True)
        name = f"{shard}-{size}-{uuid.uuid4().hex}.npz"
        raw = io.BytesIO()
        parts = {f"members{i}": m for i, (m, _) in enumerate(graph.layers)} | {f"near{i}": near.astype(np.int32) for i, (_, near) in enumerate(graph.layers)}
        np.savez(raw, exact=exact, k=k, n=n, **parts)
        del graph, there
        with fs.open_output_stream(f"{folder}/{name}") as f:
            f.write(raw.getbuffer())
        del raw
        give_back()
        return pa.table({"path": [f"{to}/{name}"], "shard": pa.array([shard], pa.int32()), "size": pa.array([size], pa.int32()), "beam": pa.array([beam], pa.int32()), "recall": [found]})

    made = written(rows.groupBy("shard", "size").applyInArrow(run, "path string, shard int, size int, beam int, recall double"), "graphs")
    out = [r.asDict() for r in made.orderBy("size", "shard").collect()]  # a row a shard
    drop_written(made)
    return out


def _vectors(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, keys and numbers of equal ones of a shard."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        data = np.load(f)
        return data["exact"], data["k"], data["n"]


def _graph(path: str, exact: np.ndarray) -> Graph:
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        data = np.load(f)
        graph = Graph.__new__(Graph)
        graph.x = exact.astype(np.float32)
        graph.layers = [(data[f"members{i}"], data[f"near{i}"]) for i in range(sum(k.startswith("near") for k in data.files))]
        return graph


class Forest:
    """Trees over numbered nodes; tells which links are needed to connect what is linked."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of links that join trees, one for each tree joined to another."""
        used = [np.empty(0, dtype=np.int64)]
        left = np.arange(len(a))
        while True:
            x, y = self.root[a[left]], self.root[b[left]]
            apart = x != y
            left, x, y = left[apart], x[apart], y[apart]
            if not len(left):
                return np.concatenate(used)
            top, first = np.unique(np.maximum(x, y), return_index=True)
            used.append(left[first])
            self.root[top] = np.minimum(x, y)[first]  # always to a smaller root, so there are no rings
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def pairs_of_shards(graphs: list[dict]) -> list[tuple[int, dict, list[str]]]:
    """Tasks: a number, a graph, and the files of the shards whose vectors query it."""
    out = []
    for size in sorted({g["size"] for g in graphs}):
        own = [g for g in graphs if g["size"] == size]
        n = len(own)
        for i, g in enumerate(own):
            # the shards behind it, half way round; of two that face each other, the first is asked
            others = [own[(i + d) % n]["path"] for d in range(n // 2 + 1) if 2 * d != n or i < (i + d) % n]
            out.extend((g, others[at : at + STREAM]) for at in range(0, len(others), STREAM))
    return [(i, g, others) for i, (g, others) in enumerate(out)]


def links_of(spark, graphs: list[dict], least: float) -> DataFrame:
    """Rows (a, null, n): a node has n linked vectors in other nodes (to be summed), and
    (a, b, 0): links that connect all that are linked."""
    tasks = pairs_of_shards(graphs)
    listing = spark.createDataFrame([(i, g["path"], g["beam"], others) for i, g, others in tasks], "i int, path string, beam int, others array<string>").repartitionById(max(1, len(tasks)), F.col("i"))

    def search(path: str, beam: int, others: list[str]):
        exact, k, n = _vectors(path)
        graph = _graph(path, exact)
        degree = np.zeros(len(k), dtype=np.int64)
        for other in others:
            q, qk, qn = (exact, k, n) if other == path else _vectors(other)
            forest = Forest(len(k) + len(qk))  # the shard's nodes, then the other's
            q_degree, links = np.zeros(len(qk), dtype=np.int64), []
            step = max(1, BLOCK_BYTES // (8 * q.shape[1]))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                q32 = part.astype(np.float32)
                for r, c in graph.search(q32, least, beam) if beam else scan(graph.x, q32, least):
                    if other == path:  # a pair within the shard counts from its first node
                        r, c = r[c > r + at], c[c > r + at]
                    for cut in range(0, len(r), 1 << 15):
                        ri, ci = r[cut : cut + (1 << 15)], c[cut : cut + (1 << 15)]
                        good = np.einsum("ij,ij->i", part[ri], exact[ci]) >= least
                        ri, ci = ri[good] + at, ci[good]
                        np.add.at(q_degree, ri, n[ci])
                        np.add.at(degree, ci, qn[ri])
                        used = forest.add(ri if other == path else ri + len(k), ci)
                        links.append(np.stack([qk[ri[used]], k[ci[used]]]))
            some = np.flatnonzero(q_degree)
            yield qk[some], None, q_degree[some]
            if links:
                a, b = np.concatenate(links, axis=1)
                yield a, b, np.zeros(len(a), dtype=np.int64)
        some = np.flatnonzero(degree)
        yield k[some], None, degree[some]

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for task in batch.to_pylist():
                for a, b, n in search(task["path"], task["beam"], task["others"]):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b), pa.array(n)], schema=schema)
                give_back()

    return listing.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors linked), component_id (smallest id reachable), kept, and
    audit_recall (the least that an audit of the vector's length found; null without one)."""
    spark = vectors.sparkSession
    rows = written(units(vectors, id_col, vector_col), "units")
    nodes = rows.where("k is not null").groupBy("k").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("unit").alias("unit"))
    nodes = written(nodes, "nodes")
    total = nodes.agg(F.sum(F.length("unit"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    sample = [bytes(r.unit) for r in nodes.select("unit").orderBy(F.xxhash64("k", F.lit(44))).limit(AUDIT).collect()]
    graphs = build(nodes, shards, least, sample)
    found = written(links_of(spark, graphs, least), "links")
    if graphs:
        remove_path(spark, graphs[0]["path"].rsplit("/", 1)[0])
    joined = connected_components(found.where("b is not null").select("a", "b"))
    named = joined.join(nodes.select(F.col("k").alias("node"), "first"), "node")
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    component = named.join(smallest, "component").select(F.col("node").alias("k"), "smallest")
    degree = found.where("b is null").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("others"))
    recall = {}
    for g in graphs:
        recall[g["size"]] = min(g["recall"], recall.get(g["size"], 1.0))
    audited = spark.createDataFrame(list(recall.items()), "size int, audit_recall double")
    by_node = nodes.select("k", "first", "n", F.length("unit").alias("size")).join(degree, "k", "left").join(component, "k", "left").join(audited, "size", "left").select("k", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component_id"), "audit_recall")
    # rows without a vector to link aren't joined: as null keys they would all go to one task
    linked = rows.where("k is not null").select("vec_id", "k").join(by_node, "k").select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", "audit_recall")
    alone = rows.where("k is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(None).cast("double").alias("audit_recall"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    out = written(linked.union(alone).select("vec_id", "n_links", "component_id", kept, "audit_recall"), "near-vectors")
    drop_written(rows, nodes, found, joined)
    return out
