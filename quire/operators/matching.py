"""Fuzzy joins of names, without a block that loses pairs.

Equal keys are one class and meet as one row; classes meet on the rare characters of both (a prefix filter over the multiset of
characters, which no pair at the threshold can miss) inside the lengths that the threshold allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_key(text: Column) -> Column:
    """Letters and digits in lower case, without a note in brackets at the end."""
    t = F.trim(text)
    cut = F.when(t.rlike(r"(?s)^.+[(（][^(（]*[)）]$"), F.regexp_extract(t, r"(?s)^(.+)[(（][^(（]*[)）]$", 1)).otherwise(t)
    return F.lower(F.regexp_replace(cut, r"[^\p{L}\p{N}]+", ""))


def similar_classes(rows: DataFrame, key: str, member: str, *, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes and the membership: (a, b, shared, similarity, prefix) with keys a < b, and (key, member).

    A pair has ``100 * shared >= percent * longer length`` characters in common, or one key is the other's beginning and two characters longer at most.
    """
    members = rows.select(F.col(key).alias("key"), F.col(member).alias("member")).where("key <> ''")
    classes = members.select("key").distinct().withColumn("len", F.length("key"))
    # The n-th copy of a character is a token of its own, so that overlaps of sets are overlaps of multisets.
    letters = classes.select("key", "len", F.explode(F.split("key", "")).alias("c")).where("c <> ''").groupBy("key", "len", "c").agg(F.count("*").alias("n"))
    tokens = letters.select("key", "len", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat("c", i.cast("string")))).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(common, "token").groupBy("key", "len").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ts"))
    # Two sets that share enough share one of the len - ceil(share * len) + 1 rarest tokens of both; the shorter one needs most.
    least = F.ceil(F.col("len") * percent / 100).cast("int")
    prefix = ranked.select("key", "len", F.explode(F.slice("ts", F.lit(1), F.col("len") - least + 1)).alias("t")).select("key", "len", "t.token")
    # Prefixes' keys of two further characters always meet on their own beginning.
    left, right = prefix.select(F.col("key").alias("a"), F.col("len").alias("la"), "token"), prefix.select(F.col("key").alias("b"), F.col("len").alias("lb"), "token")
    near = left.join(right, "token").where(f"a < b and 100 * least(la, lb) >= {percent} * greatest(la, lb)").select("a", "b").distinct()
    longer = classes.where("len > 1").select(F.col("key").alias("b"), F.explode(F.array(F.expr("substr(key, 1, len - 1)"), F.expr("substr(key, 1, greatest(len - 2, 0))"))).alias("a"))
    begins = longer.where("a <> ''").join(classes.select(F.col("key").alias("a")), "a", "left_semi").select("a", "b").distinct()
    pairs = near.unionByName(begins).distinct()
    bags = letters.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("bag"))
    joined = pairs.join(bags.select(F.col("key").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("key").alias("b"), F.col("bag").alias("y")), "b")
    shared = F.aggregate(F.map_entries("x"), F.lit(0).cast("long"), lambda n, e: n + F.least(e["value"], F.coalesce(F.col("y")[e["key"]], F.lit(0).cast("long"))))
    longest = F.greatest(F.length("a"), F.length("b"))
    out = joined.select("a", "b", shared.alias("shared"), F.round(shared / longest, 6).alias("similarity"), (F.startswith(F.col("b"), F.col("a")) & (F.length("b") - F.length("a") <= 2)).alias("prefix"))
    return out.where((100 * F.col("shared") >= percent * F.greatest(F.length("a"), F.length("b"))) | F.col("prefix")), members
