"""Operator 1: near-duplicate groups by b-bit MinHash.

Method. Every text becomes its set of distinct word shingles and a MinHash signature of ``bands * rows``
functions. Band keys come from full minima; of each minimum only the ``bits`` low bits stay, packed into
64-bit words. Texts with equal shingle sets are one *node*. Nodes that share a band key are candidates; the
collision-corrected estimate ``(match - 2**-bits) / (1 - 2**-bits)``, from bit counts of packed words, and the
ratio of set sizes thin them out; so does a bound that never errs: a cell of a hashed bitmap that one set fills and the
other doesn't is a shingle they don't share. The full sets decide.

No group is expanded into its pairs. First every bucket is compared with one representative, the node with the
most bucket mates (it sits in the middle of its group), and the links found are closed into components. Only
buckets that still hold two components go on: their nodes outside the largest component are compared with the
nodes of other components. So a bucket whose members all belong together costs one comparison a member.

Scale. Every exchange is keyed by node, band key or doc_id; the joins on band keys carry a dozen bytes a row and are
plain inner joins, which AQE splits when a key is hot. Aggregates have map-side partials. Nothing is broadcast by
this code and no group meets in one task. Intermediate tables live in ``spark.checkpoint.dir``.

Defined cases. A null or word-less text has no shingles, is linked with nothing and is kept. Rows with a null
doc_id have their set's size and component_id null, and are kept; they link with nothing. Rows that repeat a doc_id stay rows; each is judged
by its own text, and its component's smallest id counts. Columns besides the two named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, map_arrow, slices, texts, word_memo, written
from quire.llm.minhash_kernel import Signer, bitmap, jaccard_at_least, shingle_sets


def _signatures(words_each: int, bands: int, rows: int, bits: int, cells: int):
    def run(batches):
        memo, signer = word_memo(), Signer(bands, rows, bits)
        for part in slices(batches):
            sets = shingle_sets(texts(part), words_each, memo)
            signs = [signer.sign(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([x and x[0] for x in signs], pa.list_(pa.int64())),
                    pa.array([x and x[1] for x in signs], pa.list_(pa.int64())),
                    pa.array([bitmap(s, cells) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "node", "bands", "packed", "cells"],
            )

    return run


def _texts_of_nodes(words_each: int):
    """Keep the rows whose text really has the node's set (rows may repeat an id)."""

    def run(batches):
        memo = word_memo()
        for part in slices(batches):
            nodes = part.column(part.schema.get_field_index("node")).to_pylist()
            sets = shingle_sets(texts(part), words_each, memo)
            keep = [len(s) > 0 and xxhash.xxh3_128_digest(s.tobytes()) == n for s, n in zip(sets, nodes, strict=True)]
            yield part.filter(pa.array(keep, pa.bool_())).select(["node", "text"])

    return run


def _exact(words_each: int, percent: int):
    def run(batches):
        memo = word_memo()
        for part in slices(batches, 1 << 20, ("text_a", "text_b")):
            a = shingle_sets(texts(part, "text_a"), words_each, memo)
            b = shingle_sets(texts(part, "text_b"), words_each, memo)
            keep = [jaccard_at_least(x, y, percent) for x, y in zip(a, b, strict=True)]
            yield part.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _plausible(bits: int, k: int, percent: int, sigmas: float):
    """The cheap tests of a pair: the size ratio, the estimate with its allowance, and the bitmaps' bound.

    The estimate's standard error at the threshold is known, so ``sigmas`` says how often a true link is lost.
    """
    words = k * bits // 64
    mask = sum(1 << (i * bits) for i in range(64 // bits))
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask

    def differing(i: int):
        x = F.col("packed_a")[i].bitwiseXOR(F.col("packed_b")[i])
        fold = reduce(lambda u, v: u.bitwiseOR(v), [F.shiftrightunsigned(x, j) for j in range(bits)])
        return F.bit_count(fold.bitwiseAND(F.lit(mask)))

    chance = 2.0**-bits
    match = chance + (1 - chance) * percent / 100
    floor = match - sigmas * (match * (1 - match) / k) ** 0.5
    most = int(k * (1 - floor)) + 1
    size = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    similar = reduce(lambda u, v: u + v, [differing(i) for i in range(words)]) <= most

    def without(s: str, o: str):
        alone = F.zip_with(f"cells_{s}", f"cells_{o}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
        return F.col(f"n_{s}") - F.aggregate(alone, F.lit(0), lambda a, n: a + n)

    both = F.least(without("a", "b"), without("b", "a"))
    return size & similar & (100 * both >= percent * (F.col("n_a") + F.col("n_b") - both))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, comp): the connected components of undirected ``links(a, b)``, comp being the smallest node.

    Alternates large-star and small-star; each round is a few equi-joins and partial aggregates over the links,
    written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        following = written(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        # A star forest stays as it is: equal counts and equal sums of hashes mean that nothing moved.
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = following
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: not at rest after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def near_duplicates(
    docs: DataFrame,
    *,
    words_each: int = 5,
    percent: int = 80,
    bands: int = 48,
    rows: int = 6,
    bits: int = 2,
    sigmas: float = 6.0,
    cells: int = 2048,
) -> DataFrame:
    """One row a row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    At a similarity of exactly 0.8 a link is missed by all 48 bands of 6 rows with probability 5e-7. A corpus of
    1e10 documents should take ``bands=64, rows=8``, which meet chance similarity of 0.02 ten times less often.
    """
    if bands * rows * bits % 64 or 64 % bits:
        raise ValueError("bands * rows * bits must fill whole 64-bit words")
    source = docs.select("doc_id", "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, node binary, bands array<long>, packed array<long>, cells array<long>"
    signed = written(map_arrow(source, _signatures(words_each, bands, rows, bits, cells), schema), "signed")
    nodes = written(
        signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), *(F.any_value(c).alias(c) for c in ("n_shingles", "bands", "packed", "cells"))),
        "nodes",
    )
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("mates")).where("mates > 1")
    mates = written(keys.join(shared, "key"), "mates")

    def links_among(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the full sets confirm."""
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("packed").alias(f"packed_{s}"), F.col("cells").alias(f"cells_{s}"))
        plausible = pairs.join(side("a"), "a").join(side("b"), "b").where(_plausible(bits, bands * rows, percent, sigmas))
        plausible = written(plausible.select("a", "b"), "plausible")
        wanted = plausible.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first_id"), "node")
        found = wanted.join(source, wanted["first_id"] == source["doc_id"]).select("node", "text")
        kept = written(map_arrow(found, _texts_of_nodes(words_each), "node binary, text string").dropDuplicates(["node"]), "texts")
        side = lambda s: kept.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
        joined = plausible.join(side("a"), "a").join(side("b"), "b")
        out = written(map_arrow(joined, _exact(words_each, percent), "a binary, b binary"), "links")
        discard(kept)
        discard(plausible)
        return out

    weight = mates.groupBy("node").agg(F.sum("mates").alias("weight"))
    middle = mates.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("middle"))
    star = mates.join(middle, "key").where("node <> middle").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).distinct()
    first = links_among(star)
    placed = written(components(first), "placed")

    labelled = mates.join(placed, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    held = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = held.groupBy("key").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    rest = labelled.join(main, "key")
    right = nodes.select("node", "n_shingles", "packed", "cells")
    rest = written(rest.join(right, "node"), "rest")
    side = lambda s, keep: rest.where(keep).select("key", F.col("node").alias(s), F.col("comp").alias(f"comp_{s}"), F.col("n_shingles").alias(f"n_{s}"), F.col("packed").alias(f"packed_{s}"), F.col("cells").alias(f"cells_{s}"), F.expr("comp = main").alias(f"main_{s}"))
    left, other = side("a", "comp <> main"), side("b", "true")
    meets = (left["key"] == other["key"]) & (F.col("comp_a") != F.col("comp_b")) & (F.col("main_b") | (F.col("a") < F.col("b")))
    across = left.join(other, meets & _plausible(bits, bands * rows, percent, sigmas)).select("a", "b").distinct()
    across = written(across, "across")
    second = None if across.isEmpty() else links_among(across)
    discard(across)

    closed = placed
    if second is not None:
        # The first components are closed; only they, by their names, take part in what the second links add.
        named = placed.select(F.col("node"), F.col("comp"))
        ends = lambda s: named.select(F.col("node").alias(s), F.col("comp").alias(f"comp_{s}"))
        merged = second.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
        merged = merged.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
        whole = components(merged).select(F.col("node").alias("comp"), F.col("comp").alias("of"))
        moved = named.join(whole, "comp", "left").select("node", F.coalesce("of", "comp").alias("comp"))
        alone = whole.select(F.col("comp").alias("node"), F.col("of").alias("comp")).join(named.select("node"), "node", "left_anti")
        closed = moved.unionByName(alone)
    of_node = nodes.select("node", "first_id").join(closed, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_node = written(of_node, "of_node")
    ids = of_node.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    ids = of_node.join(ids, "comp").select("node", "component_id")
    for table in (mates, placed, rest, nodes, first, *([second] if second is not None else [])):
        discard(table)
    judged = signed.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    judged = judged.select("doc_id", "n_shingles", component, "node")
    return judged.withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(True)))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, words_each=2).drop("node")
