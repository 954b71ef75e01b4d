"""The k most similar vectors of every vector, by cosine.

Method: a hierarchical navigable small-world graph per shard, stored as flat neighbour arrays, with shard
results merged. Shards are the cells of centroids fitted on a bounded sample (``sample_rows``), so a vector
searches its own shard and those whose centroid is nearly as close, not all of them; every row is indexed. A
cell with more than ``2 * shard_rows`` rows gets centroids of its own, from a sample of its rows, again and again;
one that its centroids don't divide is cut into several shards, all of them searched. A vector's neighbours in its
own shard come from the graph too, searched from the vector's own place in it.

A task searches one shard. Vectors of other shards that search it (guests) are dealt to several tasks with a copy of
the shard each, once they are more than ``4 * shard_rows``.

Exact copies are one indexed vector, whose copies are its nearest rows. With ``min_cosine`` only rows at least
that similar come out; the routing margin may then be narrower, since such rows lie close to one another.

Defined results: rows with a null, empty, short or long vector, with NaN, infinite or null numbers, or all zero
have no result and are nobody's neighbour. Ties go to the smaller key. Rows that repeat a key count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.flat import equal_runs, mix, whole_runs
from scriptorium.llm.hnsw import FlatHNSW
from scriptorium.session import stage_table

CODED = pa.schema([("key", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("vector", pa.binary())])


def usable(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of the usable entries of an array column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), -1)
    rows = np.flatnonzero(sizes == width)
    if not len(rows):
        return rows, np.zeros((0, width), np.float32)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null numbers come as NaN
    values = flat[column.offsets.to_numpy()[rows][:, None] + np.arange(width)]
    top = np.abs(values).max(1)
    good = np.isfinite(values).all(1) & (top > 0)
    rows, values = rows[good], values[good] / top[good][:, None]
    return rows, (values / np.linalg.norm(values, axis=1)[:, None]).astype(np.float32)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means on the sample; a cell left empty keeps its old centroid."""
    centroids = sample[np.random.default_rng(seed).choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([np.argmax(sample[a : a + 4096] @ centroids.T, 1) for a in range(0, len(sample), 4096)])
        sums = np.zeros(centroids.shape, np.float64)
        np.add.at(sums, cell, sample)
        norm = np.linalg.norm(sums, axis=1)
        good = norm > 0
        centroids[good] = (sums[good] / norm[good][:, None]).astype(np.float32)
    return centroids


def vectors_of(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets if hasattr(column, "offsets") else None
    data = np.frombuffer(column.buffers()[2], np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if offsets is None else offsets[0].as_py()
    return data[first : first + len(column) * width * 4].view(np.float32).reshape(-1, width).copy()


def fit_cells(reps: DataFrame, total: int, width: int, shard_rows: int, sample_rows: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the cells; at most ``sample_rows`` vectors are on the driver at a time.

    Of a large table about 250 rows of each cell tell whether it is dense: rows times cells would otherwise be computed in
    every round. The sizes that shards are made by are counted over all rows."""
    share = max(1, min(shard_rows // 250, total // 200_000))
    some = reps if share == 1 else reps.where(F.pmod("h2", F.lit(share)) == 0)
    sample = reps.orderBy("h1", "h2").limit(sample_rows).select("vector").toArrow()
    centroids = fit_centroids(vectors_of(sample.column(0), width), -(-total // shard_rows))
    for _ in range(rounds):
        sizes = visits(some, centroids, width, None)[0] * share
        dense = np.flatnonzero(sizes > 2 * shard_rows)
        per = sample_rows // max(len(dense), 1)
        if not len(dense) or per < 16:
            break
        rate = np.zeros(len(centroids))
        rate[dense] = np.minimum(4 * per / sizes[dense], 1)

        def pick(batches: Iterator[pa.RecordBatch], centroids: np.ndarray = centroids, rate: np.ndarray = rate) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell = nearest_cells(vectors_of(batch.column(0), width), centroids)
                    order = batch.column(1).to_numpy()
                    use = mix(order.view(np.uint64)) / 2.0**64 < rate[cell]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[use].astype(np.int32)), batch.column(1).filter(pa.array(use)), batch.column(0).filter(pa.array(use))], ["cell", "h1", "vector"])

        picked = reps.select("vector", "h1").mapInArrow(pick, "cell int, h1 long, vector binary")
        few = picked.withColumn("at", F.row_number().over(Window.partitionBy("cell").orderBy("h1"))).where(F.col("at") <= per).select("cell", "vector").toArrow()
        cell_of, vectors = few.column("cell").to_numpy(), vectors_of(few.column("vector"), width)
        parts = [fit_centroids(own, min(-(-int(sizes[cell]) // shard_rows), max(len(own) // 4, 1))) for cell in dense if len(own := vectors[cell_of == cell])]
        if all(len(p) < 2 for p in parts):
            break
        centroids = np.vstack([np.delete(centroids, dense, 0), *parts])
    return centroids


def nearest_cells(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = max(1, 16_000_000 // len(centroids))
    return np.concatenate([np.argmax(vectors[a : a + step] @ centroids.T, 1) for a in range(0, len(vectors), step)]) if len(vectors) else np.zeros(0, np.int64)


def near_cells(vectors: np.ndarray, centroids: np.ndarray, margin: float, band: float | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, best cell, row, cell) for blocks of rows: the cells whose centroid is nearly as close as the best one, or
    with a ``band`` those from whose border (the plane midway between the centroids) the row is at most that far."""
    step = max(1, 16_000_000 // len(centroids))
    for a in range(0, len(vectors), step):
        score = vectors[a : a + step] @ centroids.T
        best = score.argmax(1)
        below = np.float32(margin)
        if band is not None:
            own, at = np.unique(best, return_inverse=True)
            below = (np.float32(band) * np.sqrt(np.maximum(2 - 2 * (centroids[own] @ centroids.T), 0)))[at]
        row, cell = np.nonzero(score >= score[np.arange(len(score)), best][:, None] - below)
        yield a, best, row, cell


def visits(reps: DataFrame, centroids: np.ndarray, width: int, margin: float | None, band: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each cell, and rows of other cells that search it; two numbers a cell come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_ = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors = vectors_of(batch.column(0), width) if batch.num_rows else np.zeros((0, width), np.float32)
            if margin is None:
                own += np.bincount(nearest_cells(vectors, centroids), minlength=len(centroids))
                continue
            for _, best, _, cell in near_cells(vectors, centroids, margin, band):
                own += np.bincount(best, minlength=len(centroids))
                all_ += np.bincount(cell, minlength=len(centroids))
        used = np.flatnonzero(own + all_)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(own[used]), pa.array(all_[used])], ["cell", "own", "every"])

    found = reps.select("vector").mapInArrow(count, "cell int, own long, every long").groupBy("cell").agg(F.sum("own"), F.sum("every")).toArrow()
    own, every = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64)
    at = found.column(0).to_numpy()
    own[at], every[at] = found.column(1).to_numpy(), found.column(2).to_numpy()
    return own, np.maximum(every - own, 0)


HOME, COPY, GUEST = 0, 1, 2


def nearest(
    df: DataFrame,
    key: str = "id",
    vector: str = "embedding",
    k: int = 5,
    width: int = 64,
    min_cosine: float | None = None,
    margin: float = 0.2,
    band: float | None = None,
    ef: int = 48,
    shard_rows: int = 6_000,
    sample_rows: int = 20_000,
) -> DataFrame:
    """(key, neighbour, cosine, rank) rows, at most ``k`` of each key.

    ``margin``: a shard is searched if its centroid's cosine is at most this below the best one's; ``band``, in its place:
    if its border is at most this far, which finds as much with many small cells as with few; ``ef``: width of a search in
    a graph. They trade recall for work; the README has measured recall.
    """
    spark = df.sparkSession

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = usable(batch.column(1), width)
            words = (unit + np.float32(0)).view(np.uint32).astype(np.uint64)  # + 0: no negative zero
            place = np.arange(width, dtype=np.uint64)
            with np.errstate(over="ignore"):
                h1 = mix(words + place * np.uint64(0x9E3779B97F4A7C15)).sum(1, dtype=np.uint64)
                h2 = mix(words * np.uint64(0xD6E8FEB86659FD93) + place).sum(1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([x.tobytes() for x in unit], pa.binary())], schema=CODED
            )

    coded = df.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vector")).where(F.col("key").isNotNull() & (F.size("vector") == width)).mapInArrow(code, "key string, h1 long, h2 long, vector binary")
    coded = stage_table(coded)
    reps = stage_table(coded.groupBy("h1", "h2").agg(F.min("key").alias("key"), F.first("vector").alias("vector"), (F.max("key") > F.min("key")).alias("copied")))
    total = reps.count()
    centroids = fit_cells(reps, total, width, shard_rows, sample_rows) if total else np.zeros((1, width), np.float32)
    sizes, guests_of = visits(reps, centroids, width, margin, band)
    pieces = np.where(sizes > 2 * shard_rows, -(-sizes // shard_rows), 1)  # shards of a cell that centroids don't divide
    salts = np.maximum(-(-(guests_of + np.where(pieces > 1, sizes, 0)) // (4 * shard_rows)), 1)  # tasks of a shard
    base = np.cumsum(pieces * salts) - pieces * salts
    units = int((pieces * salts).sum())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column(2).to_numpy().view(np.uint64)
            for first, best, row, cell in near_cells(vectors_of(batch.column(1), width), centroids, margin, band):
                spot = mix(mark[first : first + len(best)])
                keep = sizes[cell] > 0
                row, cell = row[keep], cell[keep]
                at = np.repeat(np.arange(len(row)), pieces[cell])
                row, cell = row[at], cell[at]
                piece = np.arange(len(at)) - np.searchsorted(at, at)
                is_home = (cell == best[row]) & (piece == (spot[row] % pieces[best[row]].astype(np.uint64)).astype(np.int64))
                shard = base[cell] + piece * salts[cell]
                guest = ~is_home
                # a guest goes to one task of the shard, a member to all of them
                unit_guest = shard[guest] + ((spot[row[guest]] >> np.uint64(20)) % salts[cell[guest]].astype(np.uint64)).astype(np.int64)
                many = salts[cell[is_home]]
                copies = np.repeat(np.flatnonzero(is_home), many)
                salt = np.arange(len(copies)) - np.repeat(np.cumsum(many) - many, many)
                unit = np.r_[unit_guest, shard[copies] + salt]
                role = np.r_[np.full(guest.sum(), GUEST), np.where(salt == 0, HOME, COPY)]
                take = pa.array(first + np.r_[row[guest], row[copies]])
                yield pa.RecordBatch.from_arrays([pa.array(unit.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(role.astype(np.int8))], ["unit", "key", "vector", "role"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "unit"):
            table = table.combine_chunks()
            for a, b in zip(*equal_runs(table.column("unit").to_numpy())):
                yield from search_shard(table.slice(a, b - a)).to_batches()

    def search_shard(table: pa.Table) -> pa.Table:
        names = table.column("key").combine_chunks()
        vectors = vectors_of(table.column("vector"), width)
        role = table.column("role").to_numpy()
        members, guests = np.flatnonzero(role != GUEST), np.flatnonzero(role == GUEST)
        order = np.argsort(np.array(names.take(pa.array(members)).to_pylist(), object), kind="stable") if len(members) else np.zeros(0, np.int64)
        members = members[order]  # ids in a shard ascend with the key, so ties go to the smaller one
        if not len(members):
            return pa.table({"key": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
        graph = FlatHNSW(vectors[members])
        found_q, found_n, found_s = [], [], []
        own = np.flatnonzero(role[members] == HOME)
        for rows, start, count in ((members[own], own, k + 1), (guests, None, k)):
            if len(rows):
                ids, sims = graph.search(vectors[rows], min(count, len(members)), ef, start=start)
                found_q.append(np.repeat(rows, ids.shape[1]))
                found_n.append(ids.ravel())
                found_s.append(sims.ravel())
        query, other, sims = np.concatenate(found_q), np.concatenate(found_n), np.concatenate(found_s)
        good = (other >= 0) & (sims >= (-2 if min_cosine is None else min_cosine - 1e-4))
        query, other = query[good], members[other[good]]
        query, other = query[query != other], other[query != other]
        a, b = vectors[query].astype(np.float64), vectors[other].astype(np.float64)
        cosine = np.einsum("pd,pd->p", a, b) / np.sqrt(np.einsum("pd,pd->p", a, a) * np.einsum("pd,pd->p", b, b))
        good = np.ones(len(query), bool) if min_cosine is None else cosine >= min_cosine
        return pa.table({"key": names.take(pa.array(query[good])), "neighbour": names.take(pa.array(other[good])), "cosine": pa.array(np.clip(cosine[good], -1, 1))})

    tasks = max(min(units, 20_000), 1)
    routed = reps.select("key", "vector", "h1").mapInArrow(route, "unit int, key string, vector binary, role byte")
    found = routed.repartitionById(tasks, F.col("unit") % tasks).sortWithinPartitions("unit").mapInArrow(search, "key string, neighbour string, cosine double")
    found = found.withColumnRenamed("key", "rep")
    if min_cosine is not None:  # a pair that one of its rows found counts for both
        found = stage_table(found)
        found = found.unionByName(found.select(F.col("neighbour").alias("rep"), F.col("rep").alias("neighbour"), "cosine"))
    found = found.unionByName(reps.where("copied").select(F.col("key").alias("rep"), F.col("key").alias("neighbour"), F.lit(1.0).alias("cosine")))
    # a group of copies counts by its smallest key, so its best k + 1 groups hold the best k + 1 rows; only of these are copies put in
    best = nearest_of(found, "rep", k + 1)
    groups = coded.join(reps.where("copied").select("h1", "h2", F.col("key").alias("rep")), ["h1", "h2"]).select("rep", F.col("key").alias("member")).distinct()
    first = groups.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).where(F.col("at") <= k + 1).select(F.col("rep").alias("neighbour"), F.col("member").alias("other"))
    best = nearest_of(best.join(first, "neighbour", "left").select("rep", F.coalesce("other", "neighbour").alias("neighbour"), "cosine"), "rep", k + 1, listed=True)
    # every member of a group gets the group's list without itself; a key that is repeated with several vectors, the best of their lists
    each = best.join(groups, "rep", "left").select(F.coalesce("member", "rep").alias("key"), "all")
    each = each.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))).alias("all"))
    rows = each.select(F.col("key").alias(key), F.posexplode(F.slice(F.filter("all", lambda x: x["neighbour"] != F.col("key")), 1, k)))
    return rows.select(key, F.col("col.neighbour").alias("neighbour"), (-F.col("col.far")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def nearest_of(found: DataFrame, by: str, count: int, listed: bool = False) -> DataFrame:
    """The ``count`` nearest distinct neighbours of each ``by``, as rows or ``listed`` in an array ``all``; ties go to the smaller key."""
    lists = found.groupBy(by).agg(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "neighbour")).alias("all")).select(by, F.slice(F.array_sort("all"), 1, count).alias("all"))
    return lists if listed else lists.select(by, F.explode("all").alias("one")).select(by, F.col("one.neighbour").alias("neighbour"), (-F.col("one.far")).alias("cosine"))
