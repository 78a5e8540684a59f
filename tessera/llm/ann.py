"""Approximate nearest neighbours by cross-polytope hashing.

Vectors become unit vectors and are turned by fast Hadamard pseudo-rotations (three rounds of random
signs and a Hadamard transform). The nearest signed axis of the turned vector is its bucket; each of
``tables`` rotations gives one. A query probes, in each table, the axes nearest to it. Points of probed
buckets are compared with the query by inner products of the original vectors in double precision,
in blocks, and each block passes on a query's best only: the best k of the union of all blocks are
among these, so reranking is exact over everything that was probed.

*Norms.* The largest inner product is not the nearest angle where norms differ. Points are parted into
bands, each half as long as the one before; a bucket holds points of one band. A long vector may be among
the nearest at any angle and a short one only at a small one, so each band has a number of probes of its own.

*Probes are measured.* A sample of ``sample`` queries (a documented bound) is compared with all points,
in blocks. For each of their true neighbours the place of its bucket in the query's order of probes is
known, and a band's probes are the least that find a share of ``recall`` of them. So recall holds at
every size and for any norms, and queries whose neighbours are near in angle probe little.

*Few points.* A query that met fewer than k points meets all of them in blocks instead.

Equal vectors are one point, with the smallest ``k + 1`` of their ids, because ties go to smaller ids:
a vector that a third of all rows share is one row from the first shuffle on. Buckets of neighbouring
axes form a group, to which a query is sent once, with a mask of the axes that it probes; groups are split into
blocks of about ``block`` points by the id, and queries of a group meet each of its blocks.

Null vectors, zero ones, ones with a null or non-finite component and ones of another length than most
take no part; null ids neither. Of rows repeated whole one counts; a query sees every other id, a copy
of its vector included. An empty table, or one without queries, gives an empty result. Only the two named
columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, shuffle_partitions, table, written
from .jaccard_join import grouped


#: Bands of norms, and axes that share a block.
BANDS, GROUP = 16, 8


class Rotations:
    """Pseudo-rotations of vectors of a dimension, padded to a power of two; the same on every task."""

    def __init__(self, dimension: int, tables: int, seed: int) -> None:
        self.size, self.tables = 1 << max(1, (dimension - 1).bit_length()), tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.size))

    @property
    def axes(self) -> int:
        return 2 * self.size

    def scores(self, x: np.ndarray, t: int) -> np.ndarray:
        """The score of each signed axis in a table: the turned vector and its opposite."""
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in self.signs[t]:
            y *= signs
            h = 1
            while h < self.size:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), self.size)
                h *= 2
            y /= np.sqrt(self.size)
        return np.concatenate([y, -y], 1)

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.scores(x, t).argmax(1)

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        """For each row, the place of every axis in the order in which it is probed."""
        return np.argsort(np.argsort(-self.scores(x, t), 1, kind="stable"), 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, asks) of rows that take part; -0.0 becomes 0.0, so that equal vectors are one key."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), "asks").filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (usual[0] if usual else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def points(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): each different vector with its k + 1 smallest ids, in ascending order. Ids are
    thinned by runs, then lots, then all, so that no group holds more than a few thousand."""
    least = lambda x: F.slice(F.array_sort(x), 1, k + 1)
    run = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("lot"), F.floor(F.col("id") / 4096).alias("run")).agg(least(F.collect_set("id")).alias("ids"))
    return run.groupBy("v", "lot").agg(least(F.flatten(F.collect_list("ids"))).alias("ids")).groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))


def vectors_in(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def band_of(x: np.ndarray, largest: float) -> np.ndarray:
    """Which band of norms a vector lies in: each is half as long as the one before, the last holds the rest."""
    low = np.maximum(np.sqrt((x * x).sum(1)), np.finfo(float).tiny)
    return np.clip(np.floor(np.log2(max(largest, np.finfo(float).tiny) / low) + 1e-9), 0, BANDS - 1).astype(np.int64)


def block_best(s: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best n of each row of scores, and of what nearly ties with the last of
    them, up to 2 n; ties go to smaller names."""
    n = min(n, s.shape[1])
    edge = -np.partition(-s, n - 1, 1)[:, n - 1]
    near = 1e-9 * np.maximum(1.0, np.abs(edge))
    q, p = np.nonzero(s >= (edge - near)[:, None])
    order = np.lexsort((names[p], -np.round(s[q, p], 9), q))
    q, p = q[order], p[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < 2 * n], p[place < 2 * n]


def tuned_probes(all_points: DataFrame, asking: DataFrame, turn: Rotations, k: int, largest: float, recall: float, sample: int) -> list[int]:
    """How many axes a query probes in each band of norms: as many as let a sample of queries, compared
    with all points in blocks, find that share of their nearest points in the band."""
    some = asking.orderBy(F.xxhash64("id", F.lit(13)), "id").limit(sample).collect()  # a documented bound
    tables, axes = turn.tables, turn.axes
    if not some:
        return [axes] * BANDS
    who, q = np.array([r["id"] for r in some]), np.array([r["v"] for r in some], float)
    places = np.stack([turn.places(unit(q), t) for t in range(tables)])  # table, query, axis

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                x, ids = vectors_in(b), b.column("id").to_numpy()
                s = np.where(who[:, None] == ids[None, :], -np.inf, q @ x.T)
                i, j = block_best(s, ids, k)
                u, band = unit(x), band_of(x, largest)
                place = np.min([places[t][i, turn.buckets(u, t)[j]] for t in range(tables)], 0)
                held = np.concatenate([held, np.stack([i, -s[i, j], ids[j], band[j], place], 1)])
                held = held[np.lexsort((held[:, 2], held[:, 1], held[:, 0]))]
                held = held[np.arange(len(held)) - np.searchsorted(held[:, 0], held[:, 0]) < k]
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0].astype(np.int64)), pa.array(held[:, 1]), pa.array(held[:, 3].astype(np.int32)), pa.array(held[:, 4].astype(np.int32))], ["q", "m", "band", "place"])

    tops = all_points.select("v", F.col("ids")[0].alias("id")).mapInArrow(best, "q long, m double, band int, place int")
    found = tops.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("m", "band", "place"))), 1, k).alias("x")).select(F.explode("x").alias("x")).filter(F.col("x.m") < float("inf")).select("x.band", "x.place").collect()  # sample * k rows
    out = []
    for band in range(BANDS):
        place = np.sort([r[1] for r in found if r[0] == band])
        out.append(int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1 if len(place) else 1)
    return out


def neighbours(vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 4, recall: float = 0.98, sample: int = 128, block: int = 4096, seed: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `queries` holds."""
    with scratch(vectors.sparkSession):
        spark = vectors.sparkSession
        rows = usable(vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vec_col}`"), queries.alias("asks")), id_col, vec_col)
        all_points = written(points(rows, k), "ann-points")
        asked = written(rows.filter("asks").select(F.col("id").alias("query_id"), "v").distinct(), "ann-asked")
        asking = asked.groupBy("v").agg(F.min("query_id").alias("id"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        total, dimension, largest = all_points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max(norm), F.lit(1.0))).first()
        turn = Rotations(dimension, tables, seed)
        probes = tuned_probes(all_points, asking, turn, k, largest, recall, sample)
        narrow = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)  # then 32 bits hold each number exactly
        kind = "<f4" if narrow else "<f8"
        groups = turn.axes // min(GROUP, turn.axes)  # neighbouring axes share a block, so that a query meets it once
        wide = turn.axes // groups
        lots = max(1, -(-2 * total // (block * groups)))
        raw_of = lambda v: pa.array([r.tobytes() for r in v.astype(kind)], pa.binary())
        out = "t int, band int, grp int, lot int, asks boolean, id long, axes long, v binary"
        names = [x.split()[0] for x in out.split(", ")]

        def packed(t: int, band: np.ndarray, grp: np.ndarray, lot: np.ndarray, asks: bool, ids: np.ndarray, axes: np.ndarray, raw: pa.Array) -> pa.RecordBatch:
            narrowed = [pa.array(x.astype(np.int32)) for x in (np.full(len(ids), t), band, grp, lot)]
            return pa.RecordBatch.from_arrays([*narrowed, pa.array(np.full(len(ids), asks)), pa.array(ids), pa.array(axes.astype(np.int64)), raw], names)

        def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    b = batch.slice(at, 2048)
                    v, ids = vectors_in(b), b.column("id").to_numpy()
                    u, band, raw = unit(v), band_of(v, largest), raw_of(v)
                    for t in range(tables):
                        of = turn.buckets(u, t)
                        yield packed(t, band, of // wide, ids % lots, False, ids, 1 << (of % wide), raw)

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    b = batch.slice(at, 512)
                    v, ids = vectors_in(b), b.column("id").to_numpy()
                    u, raw = unit(v), raw_of(v)
                    for t in range(tables):
                        places = turn.places(u, t)
                        for band, n in enumerate(probes):
                            masks = ((places < n).reshape(len(u), groups, wide) << np.arange(wide)).sum(2)
                            who, grp = np.nonzero(masks)
                            every = np.tile(np.arange(lots), len(who))  # a question meets every block of its group
                            who, grp = np.repeat(who, lots), np.repeat(grp, lots)
                            yield packed(t, np.full(len(who), band), grp, every, True, ids[who], masks[who, grp], raw.take(pa.array(who)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in grouped(batches, ["t", "band", "grp", "lot"]):
                asks, ids, axes = np.array(rows["asks"]), np.array(rows["id"], np.int64), np.array(rows["axes"], np.int64)
                if asks.all() or not asks.any():
                    continue
                v = np.frombuffer(b"".join(rows["v"]), kind).reshape(len(ids), -1).astype(np.float64)
                order = np.flatnonzero(~asks)[np.argsort(axes[~asks], kind="stable")]
                names, points_v, of = ids[order], v[order], axes[order]
                cuts = np.searchsorted(of, 1 << np.arange(wide + 1))
                for at in range(0, int(asks.sum()), 256):
                    who, masks, asking_v = ids[asks][at : at + 256], axes[asks][at : at + 256], v[asks][at : at + 256]
                    parts = []
                    for axis, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        probing = np.flatnonzero(masks >> axis & 1)
                        if low < high and len(probing):
                            s = asking_v[probing] @ points_v[low:high].T
                            q, p = block_best(s, names[low:high], k + 1)
                            parts.append((probing[q], names[low + p], s[q, p]))
                    if parts:
                        q, p, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                        order = np.lexsort((p, -np.round(s, 9), q))
                        q, p, s = q[order], p[order], s[order]
                        best = np.arange(len(q)) - np.searchsorted(q, q) < 2 * (k + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(who[q[best]]), pa.array(p[best]), pa.array(s[best])], ["q", "point", "s"])

        pairs = all_points.select("v", F.col("ids")[0].alias("id")).mapInArrow(stored, out).unionByName(asking.mapInArrow(sent, out))
        by = ["t", "band", "grp", "lot"]
        spread = pairs.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
        found = spread.mapInArrow(compare, "q long, point long, s double").groupBy("q", "point").agg(F.max("s").alias("s"))
        # twice as many as are wanted, whose scores are then worked out in one way for all
        most = 2 * (k + 1)
        found = written(found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("m"), "point"))), 1, most).alias("x")).select("q", F.explode("x.point").alias("point")), "ann-found")
        # queries that met fewer points than there are to find meet all points, in blocks
        short = asking.join(found.groupBy("q").count().filter(F.col("count") >= min(k + 1, total)).select(F.col("q").alias("id")), "id", "left_anti")
        n_short = short.count()
        if n_short:
            found = found.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(full_compare(all_points, short, most, n_short))
        near = found.join(all_points.select(F.col("ids")[0].alias("point"), F.col("v").alias("pv"), "ids"), "point").join(asking.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
        dot = F.aggregate(F.zip_with("pv", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        scored = near.select("qv", dot.alias("score"), "ids")
        best = scored.groupBy("qv").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("m"), i.alias("id")))))), 1, k + 1).alias("best"))
        each = asked.join(best, asked["v"] == best["qv"]).select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
        ranked = each.select("query_id", F.posexplode("best").alias("at", "x"))
        return written(ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.m")).alias("score")), "ann-answers", keep=True)


def full_compare(all_points: DataFrame, asking: DataFrame, most: int, count: int) -> DataFrame:
    """(q, point) of the best points of every query, over all points: each block of points meets each block of queries."""
    spark, lots = all_points.sparkSession, -(-count // 1024)
    n = shuffle_partitions(spark)
    lot = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(lots)).cast("int")
    slot = F.pmod(F.xxhash64("id", F.lit(27)), F.lit(n)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    p = all_points.select("v", F.col("ids")[0].alias("id")).select(every(lots).alias("lot"), slot.alias("slot"), F.lit(False).alias("asks"), "id", "v")
    q = asking.select(lot.alias("lot"), every(n).alias("slot"), F.lit(True).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, ["lot", "slot"]):
            asks, ids = np.array(rows["asks"]), np.array(rows["id"], np.int64)
            if asks.all() or not asks.any():
                continue
            v = np.array(rows["v"], np.float64)
            s = v[asks] @ v[~asks].T
            i, j = block_best(s, ids[~asks], most)
            yield pa.RecordBatch.from_arrays([pa.array(ids[asks][i]), pa.array(ids[~asks][j]), pa.array(s[i, j])], ["q", "point", "s"])

    spread = p.unionByName(q).repartition(n, "lot", "slot").sortWithinPartitions("lot", "slot")
    tops = spread.mapInArrow(run, "q long, point long, s double")
    return tops.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("m"), "point"))), 1, most).alias("x")).select("q", F.explode("x.point").alias("point"))


def op5_ann(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
