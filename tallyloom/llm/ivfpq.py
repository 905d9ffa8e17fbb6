"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Stages, below


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres, 1)[:, 0]
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each row of x the n nearest centres, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        d = (centres**2).sum(1) - 2 * x[i : i + 4096] @ centres.T
        top = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        out.append(np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), int)


class Model:
    """Coarse centroids, and for each part of the dimensions the codewords of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, words: int = 256):
        self.centres = kmeans(sample, lists).astype(np.float32)
        self.edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        residual = sample - self.centres[nearest(sample, self.centres, 1)[:, 0]]
        self.words = [kmeans(residual[:, a:b].astype(np.float64), words).astype(np.float32) for a, b in self.spans]

    @property
    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.edges[:-1], self.edges[1:]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, code bytes, and distance from what the code stands for, of each row."""
        own = nearest(x, self.centres, 1)[:, 0]
        residual = x - self.centres[own]
        codes = np.stack([nearest(residual[:, a:b], w, 1)[:, 0] for (a, b), w in zip(self.spans, self.words)], axis=1).astype(np.uint8)
        away = sum(((residual[:, a:b] - w[codes[:, p]]) ** 2).sum(1) for p, ((a, b), w) in enumerate(zip(self.spans, self.words)))
        return own, codes, np.sqrt(away)

    def distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances from queries (rows) to coded rows of one list (columns), by one table for each part."""
        residual = queries - self.centres[which]
        total = np.zeros((len(queries), len(codes)))
        for p, ((a, b), w) in enumerate(zip(self.spans, self.words)):
            w = w.astype(np.float64)
            table = (w**2).sum(1) - 2 * residual[:, a:b] @ w.T + (residual[:, a:b] ** 2).sum(1)[:, None]
            total += table[:, codes[:, p]]
        return total

    def near(self, queries: np.ndarray, which: int, codes: np.ndarray, away: np.ndarray, members: np.ndarray, n: int) -> np.ndarray:
        """Which coded rows of one list (columns) may be among the n nearest of each query (rows): none that is, is left out.

        A row lies within `away` of what its code stands for, so a code bounds its distance from both sides. Where codes
        tell too few rows apart, products of the rows themselves, with a bound of their rounding, tell more.
        """
        residual, own = queries - self.centres[which], members - self.centres[which]
        size, unit = (residual**2).sum(1)[:, None], 4 * (queries.shape[1] + 16) * np.finfo(float).eps
        rounding = unit * (size + sum((w.astype(np.float64) ** 2).sum(1).max() for w in self.words))
        square = self.distances(queries, which, codes)
        least = np.sqrt(np.maximum(square - rounding, 0)) - away * (1 + 1e-9)
        most = np.sqrt(np.maximum(square, 0) + rounding) + away * (1 + 1e-9)
        keep = least <= np.partition(most, n - 1, axis=1)[:, n - 1 : n]
        if keep.sum() > 4 * n * len(queries):
            squares = (own**2).sum(1)
            rounding = unit * (size + squares)
            square = size - 2 * residual @ own.T + squares
            keep &= square - rounding <= np.partition(square + rounding, n - 1, axis=1)[:, n - 1 : n]
        return keep


def usable(vector: str) -> Column:
    """Not null or zero, and without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


#: Numbers of a (queries x members x dimensions) block that a task holds at once.
_HELD = 4_000_000


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = 0.97, parts: int = 16, rerank: int = 200, most_sample: int = 20_000, most_trial: int = 128, block: int = 2048) -> DataFrame:
    """The k nearest rows of vectors (vec_id, embedding) for each row that is_query selects, but not the row itself.

    Returns query_id, rank (from 1), vec_id, score: Euclidean distance in double precision, ties by smaller vec_id.
    Every row is indexed; centroids and codewords are fitted on at most `most_sample` rows (smallest hash of vec_id).
    How many lists a query looks into is measured: `most_trial` queries (smallest hash) are compared with every row, and
    as many of the nearest lists are taken as hold the share `recall` of their true neighbours (8 at least). In a
    list nothing is lost: where a block has over `rerank` rows, codes with their
    errors bound each distance, and all rows that may be near are reranked on their vectors.

    Of rows with one and the same vector only the k + 1 of smallest vec_id are candidates: others can't be among the k
    nearest of any query, so nothing is lost and a hot vector costs no more than a rare one. Queries with one vector are
    searched once. Lists are cut into blocks of about `block` rows by a hash, and the queries that ask a list into packs
    of about 256, whatever their numbers; a task holds one block and one pack.

    Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths are
    at no distance: each length is searched by itself. A vec_id with several vectors is found once, at its nearest, and
    asks with each of them. Rows that share the query's vec_id are its own. Null vec_id: takes no part. Ties: by smaller
    vec_id. Empty table: no rows. Fewer candidates than k: all found. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    found = None
    # vectors of one model have one length; strays of others are few kinds
    for d in sorted(r.d for r in rows.groupBy(F.size("v").alias("d")).agg(F.max("asks").alias("asks")).where("asks").collect()):
        of_one = _search(rows.where(F.size("v") == d), d, k, recall, parts, rerank, most_sample, most_trial, block)
        found = of_one if found is None else found.unionByName(of_one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # a vec_id with several vectors may be found by each
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.select("query_id", F.row_number().over(own).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _best(asked: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int, repeated: bool) -> pd.DataFrame:
    """For each query (row) its k + 1 nearest ids, ties to the smaller; a repeated id doesn't take the place of another."""
    order = np.lexsort((ids, score), axis=1)
    order = order if repeated else order[:, : k + 1]
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    out = pd.DataFrame({"asked": np.repeat(asked, ids.shape[1]), "vec_id": ids.ravel(), "score": score.ravel()})
    return out.drop_duplicates(["asked", "vec_id"]).groupby("asked").head(k + 1) if repeated else out


def _best_of(asked: np.ndarray, ids: np.ndarray, keep: np.ndarray, members: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """As _best, of the members (columns) kept for each query (rows)."""
    q, m = np.nonzero(keep)
    step = max(1, _HELD // members.shape[1])
    score = np.concatenate([np.sqrt(((members[m[i : i + step]] - queries[q[i : i + step]]) ** 2).sum(-1)) for i in range(0, len(q), step)])
    order = np.lexsort((ids[m], score, q))
    q, m, score = q[order], m[order], score[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) <= k
    return pd.DataFrame({"asked": asked[q[first]], "vec_id": ids[m[first]], "score": score[first]})


def _matrix(cells, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(-1, dims)


def _exact(members: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances of queries (rows) and members (columns, or a row of columns for each query), from differences."""
    return np.sqrt(((members - queries[:, None, :]) ** 2).sum(-1))


def _search(rows: DataFrame, dims: int, k: int, recall: float, parts: int, rerank: int, most_sample: int, most_trial: int, block: int) -> DataFrame:
    """(query_id, vec_id, score) over rows (vec_id, v, asks) of one length: the k + 1 nearest of each query, without itself."""
    spark = rows.sparkSession
    stages = Stages(spark, "ivfpq")
    of_one = Window.partitionBy("v").orderBy("vec_id")
    distinct = stages.put(rows.select("vec_id", "v").distinct().withColumn("copy", F.row_number().over(of_one)).where(F.col("copy") <= k + 1).drop("copy"), "rows")
    n = distinct.count()
    by_hash = distinct.select("v", "vec_id", F.xxhash64("vec_id").alias("_h")).where(F.col("_h") <= below(min(1.0, 1.5 * most_sample / n)))
    sample = np.array([r.v for r in by_hash.orderBy("_h", "vec_id").limit(most_sample).select("v").toLocalIterator()])
    model = spark.sparkContext.broadcast(Model(sample, int(min(4096, max(1, round(n**0.5)))), parts))
    lists = len(model.value.centres)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf.v.tolist())
                own, codes, away = model.value.encode(x)
                yield pd.DataFrame({"list": own.astype(np.int32), "vec_id": pdf.vec_id, "code": [c.tobytes() for c in codes], "away": away, "vector": [v.tobytes() for v in x]})

    coded = stages.put(distinct.mapInPandas(index, "list int, vec_id long, code binary, away double, vector binary"), "coded")
    cuts = stages.put(coded.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")), "cuts")
    asked = stages.put(rows.where("asks").select("vec_id", "v").distinct(), "asked")
    # a query vector goes by its smallest vec_id and its hash, as one vec_id may ask with several vectors
    named = F.concat(F.min("vec_id").cast("string"), F.lit("/"), F.hex(F.xxhash64("v"))).alias("asked")
    queries = stages.put(asked.groupBy("v").agg(named, F.min("vec_id").alias("vec_id")), "queries")
    probes = _probes(queries, coded, model, dims, k, recall, most_trial)

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                x = np.array(part.v.tolist())
                near = nearest(x, model.value.centres, probes)
                yield pd.DataFrame({"asked": np.repeat(part.asked.to_numpy(), probes), "query": np.repeat(np.array([v.tobytes() for v in x], object), probes), "list": near.ravel().astype(np.int32)})

    salt = F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int").alias("cut")
    blocks = coded.join(F.broadcast(cuts), "list").groupBy("list", salt).agg(F.collect_list(F.struct("vec_id", "code", "away", "vector")).alias("members"))
    packs = max(1, -(-queries.count() // 256))
    probed = queries.mapInPandas(probing, "asked string, query binary, list int")
    probed = probed.groupBy("list", F.pmod(F.xxhash64("asked"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("asked", "query")).alias("asking"))
    probed = probed.join(F.broadcast(cuts), "list").select("list", "asking", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids = np.array([m["vec_id"] for m in row.members])
                full = _matrix((m["vector"] for m in row.members), dims)
                codes = np.frombuffer(b"".join(m["code"] for m in row.members), np.uint8).reshape(len(ids), -1)
                of, x = np.array([q["asked"] for q in row.asking]), _matrix((q["query"] for q in row.asking), dims)
                repeated = len(np.unique(ids)) < len(ids)
                away = np.array([m["away"] for m in row.members])
                coarse = len(ids) > max(rerank, k + 1) and not repeated
                step = max(1, _HELD // (len(ids) * (16 if coarse else dims)))
                for i in range(0, len(of), step):
                    q = x[i : i + step]
                    if coarse:
                        yield _best_of(of[i : i + step], ids, model.value.near(q, row.list, codes, away, full, k + 1), full, q, k)
                    else:
                        yield _best(of[i : i + step], np.broadcast_to(ids, (len(q), len(ids))), _exact(full[None], q), k, repeated)

    hits = blocks.join(probed, ["list", "cut"]).select("list", "members", "asking").mapInPandas(scan, "asked string, vec_id long, score double")
    best = Window.partitionBy("asked").orderBy("score", "vec_id")
    hits = hits.groupBy("asked", "vec_id").agg(F.min("score").alias("score"))
    hits = stages.put(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "hits")
    # each query takes what its vector's representative found, without itself
    each = asked.join(queries.select("v", "asked"), "v").select(F.col("vec_id").alias("query_id"), "asked").join(hits, "asked")
    return each.where("query_id <> vec_id").select("query_id", "vec_id", "score")


def _probes(queries: DataFrame, coded: DataFrame, model, dims: int, k: int, recall: float, most: int) -> int:
    """How many nearest lists hold the share `recall` of the true k nearest rows of a bounded set of queries."""
    trial = [(r.vec_id, r.v) for r in queries.orderBy(F.xxhash64("asked"), "asked").limit(most).select("vec_id", "v").collect()]
    of, x = np.array([a for a, _ in trial]), np.array([v for _, v in trial])
    held = coded.sparkSession.sparkContext.broadcast((of, x))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, x = held.value
        for pdf in batches:
            for i in range(0, len(pdf), step := max(1, _HELD // (len(x) * dims))):
                part = pdf.iloc[i : i + step]
                score, lists = _exact(_matrix(part.vector, dims)[None], x), part["list"].to_numpy()
                score[of[:, None] == part.vec_id.to_numpy()] = np.inf
                near = np.argsort(score, axis=1)[:, :k]
                yield pd.DataFrame({"q": np.repeat(np.arange(len(x)), near.shape[1]), "list": lists[near].ravel(), "score": np.take_along_axis(score, near, 1).ravel()})

    nearest_rows = Window.partitionBy("q").orderBy("score")
    true = coded.mapInPandas(scan, "q int, list int, score double").where(F.col("score") < float("inf"))
    true = true.withColumn("r", F.row_number().over(nearest_rows)).where(F.col("r") <= k).select("q", "list").collect()
    place = np.argsort(nearest(x, model.value.centres, len(model.value.centres)), axis=1)
    places = np.sort([place[r.q, r.list] for r in true])
    need = int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else 1
    return min(len(model.value.centres), max(8, need))
