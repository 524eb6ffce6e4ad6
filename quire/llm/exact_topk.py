"""Operator 9: exact top-k search by inner product.

Method. Vectors are sorted by descending length and rotated by the right singular vectors of the table (from the
d x d second-moment matrix, summed over all rows), so that the first rotated components carry most of a product.
First every query meets the ``head`` longest vectors; its k-th best product there is a floor that no result lies below.
Vectors are dealt into ranges of length and queries into ranges of floor / |q|, the length a vector must have; a
range of vectors that is too short for a range of queries is never sent to it. What does meet, meets in tiles, in blocks of
falling length: a block is left unread once |q| * |longest of block| is below the query's k-th best. Inside a block a product
grows by steps of rotated components; what is left is bounded by the residual lengths (Cauchy-Schwarz), and pairs whose bound
is below the k-th best go. Survivors get the exact integer product. Floating bounds carry an allowance above rounding.

Scale. A tile holds about ``tile_values`` components of vectors and ``tile_queries`` queries, so a task's memory doesn't grow
with the table. The head and the bounds of the ranges go to the tasks with the closure (sizes are parameters). A tile returns
at most k rows a query; those meet in an aggregate by query.

Defined cases. A vector that is null or holds null or non-finite components takes no part, on either side, nor does a row
without an id. Components become floor(1024 * x), held within +-1e300. Candidates of a query are all rows of another vec_id and
of its own dimension (vectors of unlike dimensions have no product). Rows that repeat a vec_id are candidates each; as
queries they share the one list of their id. Ties go to the smaller id; fewer than k candidates are all returned; zero and
empty vectors count as any other. Products of any size are ranked exactly; a score beyond a long is returned as its limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_arrow, written

BLOCK = 1024
STEPS = (8, 16, 32)
#: Products of lengths below this are exact in doubles, sums included.
EXACT = 2.0**52
LIMIT = (1 << 63) - 1


def _matrix(column, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)


def _moments(d: int, longest: float):
    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            m = _matrix(b.column(0), d) / longest
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    return run


def _lengths(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, initial=0)
    scaled = m / np.maximum(top, 1e-300)[:, None]
    return top * np.sqrt((scaled * scaled).sum(axis=1))


def _residuals(m: np.ndarray) -> np.ndarray:
    """Lengths of what lies beyond each step, one column a step."""
    return np.stack([_lengths(m[:, s:]) if s < m.shape[1] else np.zeros(len(m)) for s in STEPS], axis=1)


def _slack(a, b):
    """More than the rounding of a product of vectors of these lengths."""
    return 1e-9 * a * b + 1e-6


def _products(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> list:
    """The exact products of the rows of ``a`` and ``b``; in whole numbers where doubles would round."""
    small = lengths < EXACT
    out = np.where(small, np.einsum("ij,ij->i", a, b), 0).astype(object)
    for i in np.flatnonzero(~small):
        out[i] = sum(int(x) * int(y) for x, y in zip(a[i], b[i], strict=True))
    return [int(x) for x in out]


def _floors(head_ids: np.ndarray, head: np.ndarray, k: int):
    """Each query's k-th best product among the head; minus infinity where it has fewer partners there."""

    def run(batches):
        with np.errstate(over="ignore", invalid="ignore"):
            for b in batches:
                if not b.num_rows:
                    continue
                q = _matrix(b.column(b.schema.get_field_index("v")), head.shape[1])
                ids = b.column(b.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
                score = np.nan_to_num(q @ head.T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                score[ids[:, None] == head_ids[None, :]] = -np.inf
                kth = np.sort(score, axis=1)[:, -k] if len(head) >= k else np.full(len(q), -np.inf)
                length, longest = _lengths(q), _lengths(head).max(initial=0)
                kth = np.where(np.isfinite(kth), kth - _slack(length, longest), -np.inf)
                need = np.where(length > 0, kth / np.maximum(length, 1e-300), -np.inf)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kth), pa.array(np.maximum(need, 0))], names=[*b.schema.names, "floor", "need"])

    return run


def _search(k: int, rotation: np.ndarray | None):
    """One tile: Arrow rows (side, id, v, floor); vectors and queries of the tile, all of one dimension."""

    def run(tile: pa.Table) -> pa.Table:
        side = tile.column("side").to_numpy()
        ids = tile.column("id").to_numpy()
        d = tile.column("d")[0].as_py()
        exact = _matrix(tile.column("v"), d)
        q_at, v_at = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        length = _lengths(exact)
        v_at = v_at[np.lexsort((ids[v_at], -length[v_at]))]
        turned = exact if rotation is None or len(rotation) != d else exact @ rotation
        rest = _residuals(turned)
        floor = tile.column("floor").to_numpy()[q_at].copy()
        found: dict[int, list] = {int(i): [] for i in q_at}
        with np.errstate(over="ignore", invalid="ignore"):
            for begin in range(0, len(v_at), BLOCK):
                vs = v_at[begin : begin + BLOCK]
                # "Not below" rather than "at least": what overflows to no number stays.
                live = np.flatnonzero(~(length[q_at] * length[vs[0]] + _slack(length[q_at], length[vs[0]]) < floor))
                if not len(live):
                    break
                qs = q_at[live]
                slack = _slack(length[qs], length[vs[0]])
                part, rows, cols, last = np.zeros((len(qs), len(vs))), None, None, 0
                for j, step in enumerate(STEPS):
                    if step >= d:
                        break
                    if rows is None:
                        part += turned[qs, last:step] @ turned[vs, last:step].T
                        rows, cols = np.nonzero(~(part + np.outer(rest[qs, j], rest[vs, j]) + slack[:, None] < floor[live][:, None]))
                        part = part[rows, cols]
                    else:
                        part = part + np.einsum("ij,ij->i", turned[qs[rows], last:step], turned[vs[cols], last:step])
                        may = ~(part + rest[qs[rows], j] * rest[vs[cols], j] + slack[rows] < floor[live][rows])
                        rows, cols, part = rows[may], cols[may], part[may]
                    last = step
                if rows is None:
                    rows, cols = (x.ravel() for x in np.indices((len(qs), len(vs))))
                for a in range(0, len(rows), 1 << 16):
                    r, c = rows[a : a + (1 << 16)], cols[a : a + (1 << 16)]
                    about = np.einsum("ij,ij->i", exact[qs[r]], exact[vs[c]])
                    good = ~(about + slack[r] < floor[live][r]) & (ids[qs[r]] != ids[vs[c]])
                    r, c = r[good], c[good]
                    scores = _products(exact[qs[r]], exact[vs[c]], length[qs[r]] * length[vs[c]])
                    cuts = np.searchsorted(r, np.arange(len(qs) + 1))
                    for i in np.flatnonzero(np.diff(cuts)):
                        x, y = cuts[i], cuts[i + 1]
                        best = found[int(qs[i])]
                        best += zip([-s for s in scores[x:y]], ids[vs[c[x:y]]].tolist(), strict=True)
                        best.sort()
                        del best[k:]
                        if len(best) == k:
                            floor[live[i]] = max(floor[live[i]], float(-best[-1][0]) if abs(best[-1][0]) < 1 << 1000 else floor[live[i]])
        out = [(int(ids[q]), v, -s) for q, best in found.items() for s, v in best]
        # A score beyond a long keeps its place by its rank among the exact ones, told by its decimal digits.
        return pa.table(
            {
                "query_id": pa.array([x[0] for x in out], pa.int64()),
                "vec_id": pa.array([x[1] for x in out], pa.int64()),
                "score": pa.array([max(-LIMIT, min(LIMIT, x[2])) for x in out], pa.int64()),
                "digits": pa.array([("0" if x[2] < 0 else "1") + f"{x[2] + (10**650 if x[2] < 0 else 0):0650d}" if abs(x[2]) > LIMIT else None for x in out], pa.string()),
            }
        )

    return run


def _range(x, bounds: list[float]):
    """How many of the rising ``bounds`` lie at or below ``x``."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= x)) if bounds else F.lit(0)


def exact_topk(
    vectors: DataFrame,
    is_query,
    *,
    k: int = 10,
    tile_values: int = 1 << 21,
    tile_queries: int = 4096,
    head: int = 256,
    ranges: int = 32,
) -> DataFrame:
    """``vectors(vec_id, embedding)``; ``is_query`` a Column: query_id, rank, vec_id, score of each query's k best."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(F.greatest(F.least(e, F.lit(1e300)), F.lit(-1e300)))
    given = vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))).where("vec_id is not null and embedding is not null").where(fine)
    given = given.select(F.col("vec_id").cast("long").alias("vec_id"), "is_query", F.transform(x, lambda e: whole(e * 1024)).alias("v"), F.size("embedding").alias("d"))
    top = F.aggregate("v", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e)))
    given = given.withColumn("top", F.greatest(top, F.lit(1e-300))).withColumn("length", F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + (e / F.col("top")) * (e / F.col("top")))))
    given = written(given.drop("top"), "vectors")
    dims = {r["d"]: r for r in given.groupBy("d").agg(F.count("*").alias("n"), F.max("length").alias("longest"), F.sum(F.col("is_query").cast("long")).alias("queries")).collect()}
    if not dims or not any(r["queries"] for r in dims.values()):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    main = max(dims, key=lambda d: (dims[d]["n"] * d, d))
    rotation, tiles = None, []
    for d in sorted(d for d in dims if d == main):
        tiles.append(_tiles(given.where(F.col("d") == d), d, dims[d], k, max(tile_values // max(d, 1), 1), tile_queries, head, ranges))
        if dims[d]["longest"] > 0:
            parts = map_arrow(given.where(F.col("d") == d).select("v"), _moments(d, dims[d]["longest"]), "m array<double>")
            moment = np.zeros(d * d)
            for r in parts.select(F.posexplode("m").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect():
                moment[r["i"]] = r["m"]
            rotation = np.ascontiguousarray(np.linalg.eigh(moment.reshape(d, d))[1][:, ::-1])
    if len(dims) > 1:
        # Less frequent dimensions: dealt by dimension and hash alone, and searched without a rotation.
        others = given.where(F.col("d") != main)
        sizes = spark.createDataFrame([(d, -(-r["n"] * max(d, 1) // tile_values), -(-max(r["queries"], 1) // tile_queries)) for d, r in dims.items() if d != main], "d int, v_tiles long, q_tiles long")
        others = others.join(sizes, "d")
        deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        low = F.lit(float("-inf")).alias("floor")
        tiles.append(others.select("d", deal("v_tiles", 1).alias("vt"), upto("q_tiles").alias("qt"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), "v", low))
        tiles.append(others.where("is_query").select("d", upto("v_tiles").alias("vt"), deal("q_tiles", 2).alias("qt"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", low))
    joined = tiles[0]
    for t in tiles[1:]:
        joined = joined.unionByName(t)
    found = joined.groupBy("d", "vt", "qt").applyInArrow(_search(k, rotation), "query_id long, vec_id long, score long, digits string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("digits"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _tiles(given: DataFrame, d: int, stats, k: int, tile_vectors: int, tile_queries: int, head: int, ranges: int) -> DataFrame:
    """Vectors and queries of one dimension as rows (d, vt, qt, side, id, v, floor), less those tiles that cannot hold a result."""
    spark = given.sparkSession
    longest = given.orderBy(F.desc("length"), "vec_id").limit(head).select("vec_id", "v").collect()
    seeds = np.array([r["v"] for r in longest], np.float64).reshape(len(longest), d)
    queries = given.where("is_query").select("vec_id", "v", "length")
    queries = map_arrow(queries, _floors(np.array([r["vec_id"] for r in longest], np.int64), seeds, k), "vec_id long, v array<double>, length double, floor double, need double")
    queries = written(queries, "queries")
    # Small tables still get up to 64 tiles, so that all workers have some; a tile never exceeds tile_vectors by much.
    v_tiles = max(-(-stats["n"] // tile_vectors), min(64, -(-stats["n"] // 1024)))
    q_tiles = -(-max(stats["queries"], 1) // tile_queries)
    cut = lambda df, column, n: sorted(set(df.approxQuantile(column, [i / n for i in range(1, n)], 0.002))) if n > 1 else []
    v_bounds, q_bounds = cut(given, "length", min(ranges, v_tiles)), cut(queries, "need", min(ranges, q_tiles))
    v_each, q_each = -(-v_tiles // (len(v_bounds) + 1)), -(-q_tiles // (len(q_bounds) + 1))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("long")
    vectors = given.withColumn("vr", _range(F.col("length"), v_bounds)).withColumn("vt", F.col("vr") * v_each + deal(v_each, 1))
    queries = queries.withColumn("qr", _range(F.col("need"), q_bounds)).withColumn("qt", F.col("qr") * q_each + deal(q_each, 2))
    tallest = dict(vectors.groupBy("vr").agg(F.max("length")).collect())
    least = dict(queries.groupBy("qr").agg(F.min("need")).collect())
    meet = [(v, q) for v, most in tallest.items() for q, need in least.items() if not most * (1 + 1e-9) < need]
    numbers = lambda pairs, each: [(a, [x * each + i for x in sorted(b) for i in range(each)]) for a, b in pairs.items()]
    of_v, of_q = {}, {}
    for v, q in meet:
        of_v.setdefault(v, []).append(q)
        of_q.setdefault(q, []).append(v)
    to_q = spark.createDataFrame(numbers(of_v, q_each), "vr int, tiles array<long>")
    to_v = spark.createDataFrame(numbers(of_q, v_each), "qr int, tiles array<long>")
    left = vectors.join(F.broadcast(to_q), "vr").select("d", "vt", F.explode("tiles").alias("qt"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), "v", F.lit(float("-inf")).alias("floor"))
    right = queries.join(F.broadcast(to_v), "qr").select(F.lit(d).alias("d"), F.explode("tiles").alias("vt"), "qt", F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", "floor")
    return left.unionByName(right)


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_topk(vectors, F.col("vec_id") % 100 == 0)
