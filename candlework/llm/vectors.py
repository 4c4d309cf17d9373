"""Near-duplicate vectors by inverted lists with product-quantised residuals.

Index. Coarse centroids (k-means) split the unit vectors into lists; in a list a vector is kept as the codes of its
residual in subspaces of a few dimensions, with the exact length of what the codes miss, and with the vector itself.
Centroids and codebooks are fitted on SAMPLE vectors at most; every vector is indexed. Lists grow with the root of the
vectors' number until the sample ends that. Vectors of different lengths are never linked; lengths up to the same power
of two share an index, with zeros after the shorter ones, so there are few indexes whatever lengths occur.

Search. All vectors are queries. If a vector within distance r of a query lies in another list than the query's own, it
is beyond the plane halfway between the two centroids, so the query is at most r away from that plane. How far away links
really put queries is measured: the links of GAUGE vectors to all rows are found by brute force, one pass over the table,
and every list whose plane is within MARGIN times the largest distance seen is probed. If they have too few links to
tell, r itself is used, which loses nothing. In a list, distances to the codes are one matrix product with what the
codes stand for; what is too far by more than its codes miss is dropped, which loses nothing, and the rest is ranked by
exact cosine in double precision.

Plan. Equal vectors are one class first. Lists are packed into shards of bounded size, a larger list into several; a
query goes once to each shard that holds a list it probes, and a shard's queries are split when they are many. A task
returns counts and a spanning forest of the links it found, never the pairs, so a group of near copies costs rows in
proportion to its size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.llm._components import components
from candlework.llm._store import Scratch

#: Vectors, and numbers in them, that centroids and codebooks are fitted on at most.
SAMPLE, SAMPLE_NUMBERS = 131_072, 1 << 23
#: Vectors of a list in the sample, on average, at least.
A_LIST = 16
#: Vectors whose links are found by brute force, links that tell enough, and what is added to what they tell.
GAUGE, ENOUGH, MARGIN = 1_024, 100, 1.3
#: Vectors of a shard, and queries to it, that meet in one task at most, on average.
SHARD, QUERIES = 2_048, 4_096
SUBSPACE, CODES = 4, 256


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = x[rng.choice(len(x), 64 * k, replace=False)] if len(x) > 64 * k else x
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 1024], centres).argmin(1) for i in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])


class Index:
    """Centroids and codebooks; the same on the driver and in every task."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.centres = _kmeans(sample, lists, 8)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(self.dim), max(1, math.ceil(self.dim / SUBSPACE)))
        self.books = [_kmeans(residual[:, p], min(CODES, max(1, len(sample) // 4)), 6, seed=i) for i, p in enumerate(self.parts)]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and missed length of each unit vector."""
        near = _nearest(x, self.centres)
        residual = x - self.centres[near]
        codes = np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        missed = residual - np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return near, codes, np.sqrt((missed * missed).sum(1))

    def planes(self, x: np.ndarray) -> np.ndarray:
        """How far each query (rows) is from the plane between its own list and each list (columns); 0 for its own."""
        d = _distances(x, self.centres)
        near = d.argmin(1)
        apart = np.sqrt(_distances(self.centres[near], self.centres))
        return np.where(apart > 0, (d - d[np.arange(len(x)), near][:, None]) / np.maximum(2 * apart, 1e-12), 0)

    def probes(self, x: np.ndarray, width: float) -> np.ndarray:
        """Which lists (columns) are probed for each query (rows)."""
        return self.planes(x) <= width + 1e-6

    def decoded(self, near: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes stand for."""
        return self.centres[near] + np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)


class Shards:
    """Lists packed into shards, neighbouring lists together; a list larger than a shard is dealt over several."""

    def __init__(self, index: Index, sizes: dict[int, int]):
        total = sum(sizes.values())
        groups = _nearest(index.centres, _kmeans(index.centres, max(1, math.ceil(total / SHARD)), 4))
        self.units: dict[int, list[int]] = {}
        self.n, room = 0, 0
        for k in sorted(sizes, key=lambda k: (groups[k], k)):
            pieces = math.ceil(sizes[k] / SHARD)
            for _ in range(pieces):
                need = sizes[k] / pieces
                if need > room:
                    self.n, room = self.n + 1, SHARD
                self.units.setdefault(k, []).append(self.n - 1)
                room -= need
        self.holds = np.zeros((len(index.centres), self.n), np.float32)
        for k, where in self.units.items():
            self.holds[k, where] = 1

    def shard_of(self, k: int, cls: int) -> int:
        where = self.units[k]
        return where[(cls >> 7) % len(where)]

    def probed(self, lists: np.ndarray) -> np.ndarray:
        """Which shards hold a list that a query probes."""
        return lists.astype(np.float32) @ self.holds > 0


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(blobs, width: int) -> np.ndarray:
    """Vectors as rows, with zeros after those that are shorter."""
    blobs = [bytes(x) for x in blobs]
    return np.frombuffer(b"".join(x.ljust(8 * width, b"\0") for x in blobs), np.float64).reshape(-1, width)


def _scaled(x: np.ndarray) -> np.ndarray:
    """x by a power of two that brings its largest component to between a half and one; cosines stay the same bits."""
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links, so many as connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out


def near_duplicate_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors of the same length are linked if their cosine, in double precision, is least or more, however large or small
    their components are. n_links counts the other rows linked directly, component_id is the smallest id that links lead
    to, kept is whether that is the row's own. A vector that is null, empty or zero, or has null or non-finite
    components, links with nothing. Rows that repeat a vector are linked to each other; a null id is never the smallest,
    and a row with one isn't kept.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")

    def read(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1).to_pylist()
            ok, k1, k2, dims, body = [], [], [], [], []
            for row in rows:
                x = np.array([], np.float64) if row is None or None in row else np.array(row, np.float64)
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                h = np.frombuffer(hashlib.blake2b((x + 0.0).tobytes() if good else b"", digest_size=16).digest(), np.int64)
                for to, value in zip((ok, k1, k2, dims, body), (good, h[0], h[1], len(x), _scaled(x + 0.0).tobytes() if good else b"")):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(ok, pa.bool_()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(dims, pa.int32()), pa.array(body, pa.binary())], ["id", "ok", "k1", "k2", "dim", "body"])

    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    every = plain.mapInArrow(read, "id long, ok boolean, k1 long, k2 long, dim int, body binary")
    width = F.lit(1).cast("long") * F.pow(F.lit(2.0), F.ceil(F.log2(F.col("dim").cast("double")))).cast("long")
    every = scratch.keep(every.withColumn("width", F.when(F.col("ok"), width)), "read")
    out = every.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for (w,) in sorted(every.where("ok").select("width").distinct().collect()):  # powers of two
        out = out.unionAll(_of_width(scratch, every.where(F.col("width") == w), int(w), least))
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _of_width(scratch: Scratch, every: DataFrame, dim: int, least: float) -> DataFrame:
    """(id, n_links, component_id) of rows with valid vectors of dim components at most, and more than half as many."""
    spark = every.sparkSession
    name = lambda x: f"{x}-{dim}"
    radius = math.sqrt(2 - 2 * least) + 1e-7

    # Classes of equal vectors, known by a digest of 128 bits and carried as cls.
    classes = scratch.keep(every.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.min("dim").alias("dim"), F.min("body").alias("body")), name("classes"))
    classes = scratch.keep(classes.withColumn("cls", F.xxhash64("k1", "k2")), name("named-classes"))
    n = classes.count()
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // dim, 4 * A_LIST * math.isqrt(n)))
    sample = _unit(_matrix([r[0] for r in classes.orderBy("cls").limit(most).select("body").collect()], dim))
    index = Index(sample, max(1, min(2 * math.isqrt(n), len(sample) // A_LIST)))
    asking = classes.orderBy(F.desc("cls")).limit(min(GAUGE, SAMPLE_NUMBERS // dim + 1)).select("cls", "dim", "body").collect()
    queries = np.array([r[0] for r in asking], np.int64), np.array([r[1] for r in asking], np.int64), _unit(_matrix([r[2] for r in asking], dim))
    shared = spark.sparkContext.broadcast((index, queries))  # bounded by the sample

    def put(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                near, codes, missed = shared.value[0].place(_unit(_matrix(part.column(4).to_pylist(), dim)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)], ["cls", "least", "size", "dim", "body", "list", "codes", "missed"])

    indexed = classes.select("cls", "least", "size", "dim", "body").mapInArrow(put, "cls long, least long, size long, dim int, body binary, list int, codes binary, missed double")
    indexed = scratch.keep(indexed, name("index"))

    def gauge(batches):
        index, (own, dims, q) = shared.value
        planes = index.planes(q)
        links, far = 0, 0.0
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                cls, dim_of, lists, raw = (batch.column(i).slice(low, 512) for i in range(4))
                x = _unit(_matrix(raw.to_pylist(), dim))
                a, b = np.nonzero((q @ x.T >= least) & (own[:, None] != cls.to_numpy()) & (dims[:, None] == dim_of.to_numpy()))
                links += len(a)
                far = max(far, planes[a, lists.to_numpy()[b]].max(initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([far])], ["links", "far"])

    seen = indexed.select("cls", "dim", "list", "body").mapInArrow(gauge, "links long, far double").agg(F.sum("links"), F.max("far")).first()
    width = min(radius, MARGIN * seen[1] + 0.02 * radius) if seen[0] is not None and seen[0] >= ENOUGH else radius

    in_list = {r[0]: r[1] for r in indexed.groupBy("list").count().collect()}  # a row for each list
    shards = Shards(index, in_list)
    parts = spark.sparkContext.broadcast(shards)

    def count_probes(batches):
        total = np.zeros(shards.n, np.int64)
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for i in range(0, len(raw), 1024):
                total += parts.value.probed(shared.value[0].probes(_unit(_matrix(raw[i : i + 1024], dim)), width)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["shard", "n"])

    asked_of = {r[0]: r[1] for r in indexed.select("body").mapInArrow(count_probes, "shard int, n long").groupBy("shard").agg(F.sum("n")).collect()}
    times = spark.sparkContext.broadcast([math.ceil(asked_of.get(k, 0) / QUERIES) for k in range(shards.n)])

    def ask(batches):
        for batch in batches:
            ids, dims, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int32), batch.column(2).to_pylist()
            for i in range(0, len(ids), 1024):
                x, own, out = _matrix(raw[i : i + 1024], dim), ids[i : i + 1024], []
                part = (own.view(np.uint64) >> np.uint64(17)).astype(np.int64)
                probed = parts.value.probed(shared.value[0].probes(_unit(x), width))
                for k in np.flatnonzero(probed.any(0)).tolist():
                    for q in range(times.value[k]):
                        mine = np.flatnonzero(probed[:, k] & (part % times.value[k] == q))
                        if len(mine):
                            out.append((k, q, own[mine].tobytes(), dims[i : i + 1024][mine].tobytes(), x[mine].tobytes()))
                columns = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "q", "ids", "dims", "bodies"])

    def offer(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = np.array([parts.value.shard_of(k, c) for k, c in zip(table.column("list").to_pylist(), table.column("cls").to_pylist())], np.int64)
            table = table.append_column("shard", pa.array(at, pa.int32()))
            copies = np.array(times.value)[at]
            for q in range(int(copies.max(initial=0))):
                some = table.take(pa.array(np.flatnonzero(copies > q)))
                some = some.append_column("q", pa.array(np.full(some.num_rows, q), pa.int32()))
                yield from some.select(["shard", "q", "list", "cls", "size", "dim", "body", "codes", "missed"]).combine_chunks().to_batches()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "links")})
        ids = np.frombuffer(b"".join(left.column("ids").to_pylist()), np.int64)
        dims = np.frombuffer(b"".join(left.column("dims").to_pylist()), np.int32)
        bodies = np.frombuffer(b"".join(left.column("bodies").to_pylist()), np.float64).reshape(-1, dim)
        right = right.sort_by("list")
        lists, cls, size, dim_of = (right.column(c).to_numpy() for c in ("list", "cls", "size", "dim"))
        x = _matrix(right.column("body").to_pylist(), dim)
        norms = np.sqrt((x * x).sum(1))
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(cls), -1)
        coded = shared.value[0].decoded(lists, codes)
        # The squared distance to a code is 1 + |code|^2 - 2 query.code, so a product under this is too far.
        under = (1 + (coded * coded).sum(1) - (radius + right.column("missed").to_numpy() + 1e-7) ** 2) / 2 - 1e-9
        here = [(k, np.searchsorted(lists, k), np.searchsorted(lists, k, "right")) for k in np.unique(lists).tolist()]
        links, pairs = np.zeros(len(ids), np.int64), []
        for i in range(0, len(ids), 1024):
            q = bodies[i : i + 1024]
            unit, length, own = _unit(q), np.sqrt((q * q).sum(1)), ids[i : i + 1024]
            probed = shared.value[0].probes(unit, width)
            for k, low, high in here:
                which = np.flatnonzero(probed[:, k])
                for w in np.array_split(which, max(1, math.ceil(len(which) * (high - low) / (1 << 20)))):
                    if not len(w):
                        continue
                    a, b = np.nonzero(unit[w] @ coded[low:high].T >= under[low:high])
                    other = (own[w[a]] != cls[low + b]) & (dims[i + w[a]] == dim_of[low + b])
                    a, b = a[other], b[other]
                    for j in range(0, len(a), 65536):
                        u, v = w[a[j : j + 65536]], low + b[j : j + 65536]
                        cosine = np.einsum("ij,ij->i", q[u], x[v]) / (length[u] * norms[v])
                        u, v = u[cosine >= least], v[cosine >= least]
                        links[i : i + 1024] += np.bincount(u, weights=size[v], minlength=len(q)).astype(np.int64)
                        pairs += _forest(own[u], cls[v])
        tree = _forest(*np.array(pairs, np.int64).reshape(-1, 2).T)
        some = np.flatnonzero(links)
        a = np.concatenate((ids[some], [p[0] for p in tree])).astype(np.int64)
        b = np.concatenate((ids[some], [p[1] for p in tree])).astype(np.int64)
        return pa.table({"a": a, "b": b, "links": np.concatenate((links[some], np.zeros(len(tree), np.int64)))})

    asked = indexed.select("cls", "dim", "body").mapInArrow(ask, "shard int, q int, ids binary, dims binary, bodies binary")
    offered = indexed.select("list", "cls", "size", "dim", "body", "codes", "missed").mapInArrow(offer, "shard int, q int, list int, cls long, size long, dim int, body binary, codes binary, missed double")
    keys = ["shard", "q"]
    found = scratch.keep(asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(meet, "a long, b long, links long"), name("links"))
    roots = components(scratch, found.where("links = 0").select("a", "b"), name("vectors"))
    links = found.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    whole = indexed.select("cls", "least", "size").join(links, "cls", "left").join(roots.withColumnRenamed("v", "cls"), "cls", "left")
    whole = scratch.keep(whole.select("cls", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), name("whole"))
    tops = scratch.keep(whole.groupBy("root").agg(F.min("least").alias("component_id")), name("tops"))
    whole = scratch.keep(whole.join(tops, "root").select("cls", "n_links", "component_id"), name("named"))
    scratch.drop(*map(name, ("classes", "named-classes", "index", "links", "whole", "tops")))
    return every.withColumn("cls", F.xxhash64("k1", "k2")).select("id", "cls").join(whole, "cls").select("id", "n_links", "component_id")
