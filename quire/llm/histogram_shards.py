"""Operator 4: shards by histogram sort.

Method. Each row has a 64-bit sort key: 48 bits of its text's hash, so that equal texts lie together, then 16 bits
of a hash of its id and row, so that a large group of equal texts can still be cut. Splitters are searched for on
the key line: each round counts the exact bytes and rows below candidate boundaries (a radix grid inside the cells
that still hold a splitter, all partitions counting at once with map-side partials) and keeps the cell around
each wanted byte position, until all splitters are within ``tolerance`` of a mean range (a shard is ``ranges_each`` ranges), or keys are single.
Then the rows are exchanged once by key range and numbered inside their ranges.

Scale. A shard is a run of many key ranges, so no task holds a shard. A round brings at most
``splitters * 256`` counts to the driver. The ranges and their row offsets go to the tasks as one broadcast table
with a row for each splitter (``shards * ranges_each`` at most, a parameter). Rows carry no text in the exchange.

Law. ``bytes``: shard sizes differ by twice the tolerance, or by a row where one row is larger. Defined cases: a null text has no bytes (size
1) and a null CRC; a null doc_id is a row as any other; repeated rows are kept, each with its own slot; an empty
table gives no rows. Other columns are ignored unless listed in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

BITS = 8


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int, int]]:
    """``parts - 1`` boundaries on the unsigned key line of ``keys(key, size)``: (first key above, bytes below, rows below)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    allowed = tolerance * total / parts
    done: dict[int, tuple[int, int, int]] = {}
    # cell -> (bytes below it, rows below it, splitters wanted inside it)
    open_cells = {0: (0, 0, list(range(1, parts)))}
    for depth in range(1, 64 // BITS + 1):
        digit = F.shiftrightunsigned("key", 64 - depth * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
        # The parent is an unsigned number of at most 56 bits, so it stays positive.
        parent = F.shiftrightunsigned("key", 64 - (depth - 1) * BITS) if depth > 1 else F.lit(0).cast("long")
        grid = keys.select(parent.alias("parent"), digit.alias("digit"), "size").where(F.col("parent").isin(sorted(open_cells)))
        counts = grid.groupBy("parent", "digit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        children: dict[int, list] = {}
        for r in counts:
            children.setdefault(r["parent"], []).append((r["parent"] << BITS | r["digit"], r["bytes"], r["rows"]))
        following: dict[int, tuple[int, int, list[int]]] = {}
        for parent, (below, rows, wanted) in open_cells.items():
            for cell, size, n in sorted(children.get(parent, ())):
                for i in [w for w in wanted if below <= w * total / parts <= below + size and w not in done]:
                    goal = w_pos = i * total / parts
                    near_end = below + size - w_pos < goal - below
                    edge = (cell + near_end) << (64 - depth * BITS), below + size * near_end, rows + n * near_end
                    if abs(edge[1] - goal) <= allowed or depth == 64 // BITS:
                        done[i] = edge
                    else:
                        following.setdefault(cell, (below, rows, []))[2].append(i)
                below, rows = below + size, rows + n
        following = {c: (b, r, [i for i in w if i not in done]) for c, (b, r, w) in following.items()}
        open_cells = {c: x for c, x in following.items() if x[2]}
        if not open_cells:
            break
    return [done[i] for i in sorted(done)]


def histogram_shards(
    docs: DataFrame,
    *,
    shards: int = 8,
    ranges_each: int = 32,
    tolerance: float = 0.01,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with size, text_crc32, shard and its slot there; ``keep`` names columns to carry."""
    base = docs.select(
        "doc_id",
        *keep,
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 48)
    base = base.withColumn("key", F.col("text_hash").bitwiseAND(F.lit(-65536)).bitwiseOR(own))
    base = written(base.drop("text_hash"), "keys")
    found = splitters(base.select("key", "size"), shards * ranges_each, tolerance)
    spark = docs.sparkSession
    # Splitters that fall on one key (repeated rows alone can do that) give empty ranges.
    starts = [(0, 0, 0), *found]
    table = []
    for i, (edge, _, below) in enumerate(starts):
        shard = i // ranges_each
        first = starts[shard * ranges_each][2]
        table.append((i, shard, below - first, edge))
    wide = 64 - 12
    prefix = lambda edge: min(edge >> wide, 4095)
    signed = lambda edge: (edge - (1 << 63)) if edge < 1 << 64 else (1 << 63) - 1
    # For every 12-bit prefix: the ranges that can hold its keys, as (start, number), starts moved to signed order.
    rows, at = [], 0
    for p in range(4096):
        while at + 1 < len(table) and table[at + 1][3] <= p << wide:
            at += 1
        inside = [t for t in table[at + 1 :] if t[3] < (p + 1) << wide and t[3] > p << wide] if at + 1 < len(table) else []
        rows.append((p, [table[at][0], *(t[0] for t in inside)], [-(1 << 63), *(signed(t[3]) for t in inside)]))
    lookup = spark.createDataFrame(rows, "prefix long, numbers array<int>, starts array<long>")
    offsets = spark.createDataFrame([t[:3] for t in table], "range int, shard int, before long")
    in_order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    placed = (
        base.withColumn("in_order", in_order)
        .withColumn("prefix", F.shiftrightunsigned("key", wide))
        .join(F.broadcast(lookup), "prefix")
        .withColumn("range", F.element_at("numbers", F.size(F.filter("starts", lambda s: s <= F.col("in_order")))))
        .drop("prefix", "numbers", "starts")
        .join(F.broadcast(offsets), "range")
    )
    by_key = Window.partitionBy("range").orderBy("in_order", "row")
    slot = (F.col("before") + F.row_number().over(by_key) - 1).alias("slot")
    return placed.select("doc_id", *keep, "size", "text_crc32", "shard", slot)


def op4_histogram_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = histogram_shards(docs, shards=8)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
