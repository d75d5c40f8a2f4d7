"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids cut the vectors into cells.  A vector is stored in its cell
as the product-quantised residual from the centroid: one code byte for each
group of dimensions.  A query visits the cells that promise the largest inner
product; inside a cell its tables of partial products with every code word
(asymmetric distances) rank the codes, and the best are ranked again by the
exact inner product of the original vectors in double precision.

Centroids and code words are fitted on a bounded sample; every vector is
indexed.  The number of cells to visit is chosen on the sample so that its own
neighbours are found.  Neighbouring cells are packed into shards of about
BLOCK vectors, a larger cell is split into several blocks, and the queries of a
shard are split into blocks as well; so no task holds more than a block of
each, and a query returns ``top`` rows a shard, not a cell.
Of equal vectors only the ``top + 1`` of smallest id can be among a query's
results, since ties go to the smaller id; the others are left out of the index
without changing any result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paravane.llm.common import arrow_map, settle

#: Vectors the index is fitted on at most; cells at most; vectors a cell should hold.
SAMPLE_ROWS, MAX_CELLS, CELL_ROWS = 20_000, 2048, 128
#: Groups of dimensions at most, code words a group, sweeps of k-means.
GROUPS, WORDS, SWEEPS = 16, 256, 8
#: Standard deviations of the quantisation error within which a code is ranked again exactly; vectors and queries of a block.
MARGIN, BLOCK = 3.0, 8192
#: Share of the sample's own neighbours that the visited cells must hold.
AIM = 0.95


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster is moved to a random row."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(SWEEPS):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=k)
        centres = np.where(count[:, None] > 0, sums / np.maximum(1, count)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Fitted centroids, code words and the number of cells to visit."""

    def __init__(self, sample: np.ndarray, rows: int, top: int):
        rng = np.random.default_rng(20)
        cells = int(np.clip(rows // CELL_ROWS, 1, min(MAX_CELLS, max(1, len(sample) // 8))))
        self.centres = kmeans(sample, cells, rng)
        near = nearest(sample, self.centres)
        residual = sample - self.centres[near]
        d = sample.shape[1]
        self.groups = max(g for g in range(1, min(GROUPS, d) + 1) if d % g == 0)
        parts = residual.reshape(len(sample), self.groups, -1)
        self.words = [kmeans(parts[:, g], WORDS, rng) for g in range(self.groups)]
        norms = np.sqrt((residual**2).sum(axis=1))
        rest = parts - np.stack([w[nearest(parts[:, g], w)] for g, w in enumerate(self.words)], axis=1)
        #: What quantisation may add to or take from the inner product with a unit query, but for rare cases.
        self.error = float(MARGIN * np.sqrt((rest**2).sum(axis=(1, 2)).mean() / d))
        count = np.bincount(near, minlength=len(self.centres))
        self.spread = np.bincount(near, norms, len(self.centres)) / np.maximum(1, count)
        self.visit = self.probe_count(sample, near, top, rng)
        self.sizes = np.ones(len(self.centres), np.int64)

    def promise(self, q: np.ndarray) -> np.ndarray:
        """Upper-end estimate of the inner product with a cell's vectors."""
        return q @ self.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.spread / np.sqrt(q.shape[1])

    def probe_count(self, sample: np.ndarray, near: np.ndarray, top: int, rng: np.random.Generator) -> int:
        """Cells to visit so that AIM of the sample queries' true neighbours lie in them."""
        ask = sample[rng.choice(len(sample), min(300, len(sample)), replace=False)]
        k = min(top, len(sample))
        best = np.argpartition(-(ask @ sample.T), k - 1, axis=1)[:, :k]
        order = np.argsort(-self.promise(ask), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(ask), 0), axis=1)
        places = np.sort(np.take_along_axis(place, near[best], axis=1).reshape(-1))
        return int(places[min(len(places) - 1, int(AIM * len(places)))]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)
        parts = (x - self.centres[cell]).reshape(len(x), self.groups, -1)
        return cell, np.stack([nearest(parts[:, g], self.words[g]) for g in range(self.groups)], axis=1).astype(np.uint8)

    def cells_for(self, q: np.ndarray, least: int) -> list[np.ndarray]:
        """The cells that each query visits: ``visit`` of them, and more while they hold under ``least`` vectors."""
        order = np.argsort(-self.promise(q), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        need = np.maximum(self.visit, (held < least).sum(axis=1) + 1)
        return [o[: min(n, len(o))] for o, n in zip(order, need)]

    def shards(self) -> np.ndarray:
        """Shard of each cell: cells in order along the main direction, packed up to BLOCK vectors."""
        spread = self.centres - self.centres.mean(axis=0)
        main = np.linalg.svd(spread, full_matrices=False)[2][0]
        out, now, held = np.zeros(len(self.centres), np.int64), 0, 0
        for cell in np.argsort(spread @ main, kind="stable"):
            if held and held + self.sizes[cell] > BLOCK:
                now, held = now + 1, 0
            out[cell], held = now, held + self.sizes[cell]
        return out

    def search(self, q: np.ndarray, own: np.ndarray, visits: list[np.ndarray], ids: np.ndarray, x: np.ndarray, codes: np.ndarray, cell: np.ndarray, top: int):
        """(query row, id, score) of the best of one shard, for a block of queries and the cells each visits."""
        parts = q.reshape(len(q), self.groups, -1)
        tables = [parts[:, g] @ self.words[g].T for g in range(self.groups)]
        near = np.full((len(q), len(ids)), -np.inf)
        order = np.argsort(cell, kind="stable")
        bounds = np.flatnonzero(np.diff(cell[order], prepend=-1))
        asks: dict[int, list[int]] = {}
        for r, cells in enumerate(visits):
            for c in cells:
                asks.setdefault(int(c), []).append(r)
        for members in np.split(order, bounds[1:]):
            c = int(cell[members[0]])
            rows = np.array(asks.get(c, []), np.int64)
            if len(rows):
                score = np.repeat((q[rows] @ self.centres[c])[:, None], len(members), axis=1)
                for g in range(self.groups):
                    score += tables[g][rows[:, None], codes[members, g][None, :]]
                near[rows[:, None], members[None, :]] = score
        near[own[:, None] == ids[None, :]] = -np.inf
        # ranked again: the best codes, and all that quantisation may have put below them
        near_top = -np.partition(-near, top - 1, axis=1)[:, top - 1] if top < len(ids) else np.full(len(q), -np.inf)
        far = near_top - self.error * np.sqrt((q * q).sum(axis=1))
        rows, columns = np.nonzero((near >= far[:, None]) & (near > -np.inf))
        score = np.zeros(len(rows))
        for d in range(q.shape[1]):  # in the order of the components, so the sum is the same everywhere
            score += q[rows, d] * x[columns, d]
        order = np.lexsort((ids[columns], -score, rows))
        rows, columns, score = rows[order], columns[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        best = place < top
        return rows[best], ids[columns[best]], score[best]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>): distinct rows with an id and a vector that is finite, not zero and has no null."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = "vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    return rows.filter(F.expr(f"coalesce({sound}, false)")).distinct()


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def search(df: DataFrame, is_query: str, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top`` rows of largest inner product for each query: (query_id, rank, vec_id, score).

    ``is_query`` is a condition on vec_id.  Candidates are all other rows whose
    vector is as long as the query's, all of them if there are fewer than
    ``top``; ties go to the smaller id.  Each length has an index of its own.
    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do rows without an id.  Rows equal in id and vector count
    once; a query id with several vectors of one length asks with the least of
    them.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = usable(df, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()  # a row a length
    found = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for k, (d, total) in enumerate(lengths):
        part = search_length(rows.filter(F.size("v") == d), is_query, d, total, top)
        found = found.union(part) if k else part
    return found


def search_length(rows: DataFrame, is_query: str, d: int, total: int, top: int) -> DataFrame:
    """The search among ``total`` vectors of ``d`` components."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()
    index = Index(matrix(sample.column("v").combine_chunks(), d), total, top)

    first = Window.partitionBy("v").orderBy("vec_id")
    stored = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top + 1).drop("k")
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, codes = shared.value.encode(matrix(batch.column("v"), d))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "cell", "code"])

    indexed = settle(arrow_map(stored, assign, "vec_id long, v array<double>, cell int, code binary"))
    sizes = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell: MAX_CELLS at most
    index.sizes = np.array([sizes.get(c, 0) for c in range(len(index.centres))], np.int64)
    shared = spark.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                cells = shared.value.cells_for(matrix(part.column("v"), d), top + 1)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array([c.tolist() for c in cells], pa.list_(pa.int32()))], names=["query_id", "v", "cells"])

    asked = settle(arrow_map(rows.filter(is_query), probe, "query_id long, v array<double>, cells array<int>"))
    shard = index.shards()
    loads = np.bincount(shard, index.sizes).astype(int)
    place = spark.createDataFrame([(c, int(s)) for c, s in enumerate(shard)], "cell int, shard int")  # MAX_CELLS rows at most
    visits = asked.select("query_id", F.explode("cells").alias("cell")).join(F.broadcast(place.toDF("cell", "shard")), "cell").groupBy("query_id", "shard").agg(F.collect_set("cell").alias("cells"))
    visits = settle(visits.join(asked.groupBy("query_id").agg(F.min("v").alias("v")), "query_id"))
    asks = {r["shard"]: r["n"] for r in visits.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    deal = spark.createDataFrame([(s, -(-int(loads[s]) // BLOCK), -(-n // BLOCK)) for s, n in asks.items()] or [(-1, 1, 1)], "shard int, vb int, qb int")
    own = "int(pmod(xxhash64({0}), {1}))"
    left = indexed.join(F.broadcast(place), "cell").join(F.broadcast(deal), "shard").withColumn("i", F.expr(own.format("vec_id", "vb"))).withColumn("j", F.explode(F.expr("sequence(0, qb - 1)")))
    right = visits.toDF(*visits.columns).join(F.broadcast(deal.toDF("shard", "vb", "qb")), "shard").withColumn("j", F.expr(own.format("query_id", "qb"))).withColumn("i", F.explode(F.expr("sequence(0, vb - 1)")))
    key = ["shard", "i", "j"]

    def block(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})]
        if len(one) and len(two):
            x, codes = np.stack(one["v"].to_numpy()), np.frombuffer(b"".join(one["code"]), np.uint8).reshape(len(one), -1)
            ids, cell = one["vec_id"].to_numpy(), one["cell"].to_numpy()
            for a in range(0, len(two), 256):
                part = two.iloc[a : a + 256]
                asked_ids = part["query_id"].to_numpy()
                r, i, s = shared.value.search(np.stack(part["v"].to_numpy()), asked_ids, part["cells"].tolist(), ids, x, codes, cell, top)
                found.append(pd.DataFrame({"query_id": asked_ids[r], "vec_id": i, "score": s}))
        return pd.concat(found[1:] or found)

    parts = left.select(*key, "vec_id", "v", "code", "cell").groupBy(*key).cogroup(right.select(*key, "query_id", "v", "cells").groupBy(*key)).applyInPandas(block, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
