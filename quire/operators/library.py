"""The library's bookkeeping as joins: what changed in a listing, which device wants which book, where it goes, what it is called.

All inputs are tables keyed by path or id; a path's ancestors are the only rows that are made, as many as it has folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds until a failed file is tried again. Fixed value.
RETRY_S = 3600


def ancestors(path: Column) -> Column:
    """The path itself and all folders above it, the root as ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def listing_changes(known: DataFrame, present: DataFrame, unreadable: DataFrame, *, now: Column, build: str) -> DataFrame:
    """(path, id, change, moved_to) of a listing against what is known.

    ``known(path, id, size, mtime, status, tried_at, build)``, ``present(path, size, mtime, id)`` (id null where not hashed yet),
    ``unreadable(path)``: folders that could not be listed. Changes: new, unchanged, updated, retry, waiting; of known files that are not
    there: unknown (below an unreadable folder, so nothing is told), moved (its id lies elsewhere; the first path), missing.
    """
    k = known.select("path", F.col("id").alias("k_id"), F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), "status", "tried_at", F.col("build").alias("k_build"))
    p = present.select("path", "size", "mtime", F.col("id").alias("p_id"), F.lit(True).alias("there"))
    both = k.withColumn("was", F.lit(True)).join(p, "path", "full_outer")
    hidden = both.where("there is null").select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    hidden = hidden.join(unreadable.select(F.col("path").alias("folder")).distinct(), "folder", "left_semi").select("path").distinct().withColumn("hidden", F.lit(True))
    live = present.where("id is not null").groupBy(F.col("id").alias("k_id")).agg(F.min("path").alias("moved_to"))
    rows = both.join(hidden, "path", "left").join(live, "k_id", "left")
    same = (F.col("size") == F.col("k_size")) & (F.col("mtime") == F.col("k_mtime"))
    due = (now - F.col("tried_at") >= RETRY_S) | (F.col("k_build") != build)
    change = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("there") & (F.col("status") == "failed"), F.when(~same, "updated").when(due, "retry").otherwise("waiting"))
        .when(F.col("there"), F.when(same, "unchanged").otherwise("updated"))
        .when(F.col("hidden"), "unknown")
        .when(F.col("moved_to").isNotNull(), "moved")
        .otherwise("missing")
    )
    return rows.select("path", F.coalesce("k_id", "p_id").alias("id"), change.alias("change"), F.when(change == "moved", F.col("moved_to")).alias("moved_to"))


def covering(paths: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, root, is_file, device) of every tracked entry that covers a path: it is the path itself, or a folder above it."""
    ups = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root")).distinct()
    met = ups.join(tracked.select("root", "is_file", "device"), "root")
    return met.where("not is_file or root = path").select("path", "root", "is_file", "device")


def placement(paths: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, device, root, below): for each device the most specific entry that covers a path, and the rest of the path behind it.

    Specific: a file before a folder, a deeper folder before a higher one. An entry without a device is for all of them.
    """
    met = covering(paths, tracked)
    depth = F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/")))
    best = met.groupBy("path", "device").agg(F.max(F.struct("is_file", depth.alias("depth"), "root")).alias("b"))
    below = F.when(F.col("b.root") == "", F.col("path")).when(F.col("b.root") == F.col("path"), F.lit("")).otherwise(F.substr("path", F.length("b.root") + 2, F.length("path")))
    return best.select("path", "device", F.col("b.root").alias("root"), below.alias("below"))


def wants(paths: DataFrame, tracked: DataFrame, devices: DataFrame, files: DataFrame) -> DataFrame:
    """(path, device): covered by an entry for the device or for all; a path that no entry covers and that was never tracked (``files``) goes to all."""
    met = covering(paths, tracked)
    listed = met.where("device is not null").select("path", "device")
    everywhere = met.where("device is null").select("path").distinct()
    loose = paths.select("path").join(met.select("path").distinct(), "path", "left_anti").join(files.select("path"), "path", "left_anti")
    # Devices are a handful; each path takes them as an array.
    all_devices = devices.agg(F.collect_set("device").alias("all")).first()["all"]
    to_all = everywhere.unionByName(loose).select("path", F.explode(F.array(*map(F.lit, all_devices)) if all_devices else F.array().cast("array<string>")).alias("device"))
    return listed.unionByName(to_all).distinct()


def moved_paths(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """(path, moved): recorded paths under the longest moved prefix; ``moves(old, new)``. A prefix ends at a folder's end."""
    ups = paths.select("path", F.explode(ancestors(F.col("path"))).alias("old")).join(moves.select("old", "new"), "old")
    best = ups.groupBy("path").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("m"))
    moved = F.concat("m.new", F.substr("path", F.length("m.old") + 1, F.length("path")))
    return paths.join(best, "path", "left").select("path", F.when(F.col("m").isNull(), F.col("path")).otherwise(moved).alias("moved"))


def file_names(books: DataFrame, taken: DataFrame, ext: str = "epub") -> DataFrame:
    """(id, file_name) of ``books(id, title, own)``: the name a book has stays; else its title if free whatever the case, else with ``[id6]``.

    ``taken(name)`` are names of others. Of books that would take one free name at once the smallest id does.
    """
    plain = books.withColumn("plain", F.concat("title", F.lit(f".{ext}")))
    held = taken.select(F.lower("name").alias("low")).unionByName(books.where("own is not null").select(F.lower("own").alias("low"))).distinct().withColumn("held", F.lit(True))
    fresh = plain.where("own is null").withColumn("low", F.lower("plain"))
    # The first claimant of a name is a plain aggregate, so a name that all books share is no hot window.
    first = fresh.groupBy("low").agg(F.min("id").alias("first"))
    named = fresh.join(first, "low").join(held, "low", "left")
    free = F.col("held").isNull() & (F.col("id") == F.col("first"))
    named = named.select("id", F.when(free, F.col("plain")).otherwise(F.concat("title", F.lit(" ["), F.substring(F.col("id").cast("string"), 1, 6), F.lit(f"].{ext}"))).alias("file_name"))
    return plain.where("own is not null").select("id", F.col("own").alias("file_name")).unionByName(named)


def build_plan(wanted: DataFrame, outputs: DataFrame) -> DataFrame:
    """(id, device, action): build what is wanted and has no fresh product, keep fresh ones, retract products nobody wants.

    ``wanted(id, device, fingerprint, legacy)``, ``outputs(id, device, fingerprint, present)``. Fresh: present, with a fingerprint that is not empty and equals the new or the old form.
    """
    w = wanted.select("id", "device", F.col("fingerprint").alias("want"), F.col("legacy"))
    o = outputs.select("id", "device", F.col("fingerprint").alias("have"), "present")
    both = w.withColumn("w", F.lit(True)).join(o.withColumn("o", F.lit(True)), ["id", "device"], "full_outer")
    fresh = F.coalesce(F.col("present") & (F.col("have") != "") & ((F.col("have") == F.col("want")) | F.coalesce(F.col("have") == F.col("legacy"), F.lit(False))), F.lit(False))
    action = F.when(F.col("w").isNull(), "retract").when(fresh, "keep").otherwise("build")
    return both.select("id", "device", action.alias("action"))


def fingerprint(*parts: Column) -> Column:
    """A hash of fields; a null is another thing than an empty text, and no two lists of fields run together."""
    field = lambda p: F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws("|", *map(field, parts)), 256)


def series_share(books: DataFrame) -> DataFrame:
    """(id, donor): for books without information the book of their series to copy from.

    ``books(id, comic, series_key, has_info, region, current)``: comics only; a known region and the current version first, then no region
    and current, no region, any; the smallest id of equals.
    """
    rank = F.when((F.col("region") != "") & F.col("current"), 0).when((F.col("region") == "") & F.col("current"), 1).when(F.col("region") == "", 2).otherwise(3)
    donors = books.where("comic and has_info").groupBy("series_key").agg(F.min(F.struct(rank.alias("rank"), "id"))["id"].alias("donor"))
    return books.where("comic and not has_info").select("id", "series_key").join(donors, "series_key").select("id", "donor")


def running_numbers(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``n``, from 1 inside each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
