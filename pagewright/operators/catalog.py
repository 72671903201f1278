"""Catalog joins: upserts, inventories, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..runtime import importable


def upsert_vendors(existing: DataFrame, imported: DataFrame) -> DataFrame:
    """(id, ord, name, base_url, models): imported fields win, blanks keep the stored ones; new ones follow in order."""
    a, b = existing.alias("a"), imported.alias("b")
    keep = lambda c: F.coalesce(F.when(F.col(f"b.{c}") != "", F.col(f"b.{c}")), F.col(f"a.{c}")).alias(c)
    rows = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer").select(F.coalesce("a.id", "b.id").alias("id"), F.col("a.ord").alias("_a"), F.col("b.ord").alias("_b"), keep("name"), keep("base_url"), F.coalesce("b.models", "a.models").alias("models"))
    order = F.row_number().over(W.Window.orderBy(F.asc_nulls_last("_a"), F.asc_nulls_last("_b"), "id"))  # a handful of vendors
    return rows.select("id", order.alias("ord"), "name", "base_url", "models")


def resolve_provider(vendors: DataFrame) -> DataFrame:
    """(id, model): the first vendor that has an address and a default model, else the first that has any model."""
    usable = vendors.filter((F.col("base_url") != "") & (F.size("models") > 0))
    default = F.filter("models", lambda m: m["default"])
    order = W.Window.orderBy((F.size(default) == 0).cast("int"), "ord")
    chosen = usable.withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return chosen.select("id", F.coalesce(F.get(default, F.lit(0)), F.get("models", F.lit(0)))["id"].alias("model"))


def match_inventory(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files with ``status``: imported (name known, size and hash right), failed (known, not right), ignored (unknown).

    ``files``: name, size, sha256; names match in any case. The inventory is a fixed list and is broadcast.
    """
    known = inventory.select(F.lower("name").alias("_n"), F.col("size").alias("_size"), F.lower("sha256").alias("_sha"), "target", "group_id")
    rows = files.join(F.broadcast(known), F.lower("name") == F.col("_n"), "left")
    fine = (F.col("size") == F.col("_size")) & (F.lower("sha256") == F.col("_sha"))
    return rows.withColumn("status", F.when(F.col("_n").isNull(), "ignored").when(fine, "imported").otherwise("failed")).drop("_n", "_size", "_sha")


def group_state(inventory: DataFrame, present: DataFrame) -> DataFrame:
    """(group_id, size, installed): bytes of each group and whether all of its files are there."""
    rows = inventory.join(present.select("target").distinct().withColumn("_here", F.lit(True)), "target", "left")
    return rows.groupBy("group_id").agg(F.sum("size").alias("size"), F.bool_and(F.coalesce("_here", F.lit(False))).alias("installed"))


def new_paths(dropped: DataFrame, known: DataFrame) -> DataFrame:
    """Dropped paths that are not known yet; repeats within one drop stay."""
    return dropped.join(known.select("path").distinct(), "path", "left_anti")


def missing_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files whose relative path the target lacks."""
    return source.join(target.select("path").distinct(), "path", "left_anti")


def unique_names(names: Column, ext: str = ".md") -> Column:
    """An array of base names made unique in any case: ``a``, ``a (2)`` ..., each tested against all names used so far."""
    def step(acc: Column, base: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(acc) + 1), lambda n: F.when(n == 1, base).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"))))
        used = F.transform(acc, F.lower)
        return F.concat(acc, F.array(F.get(F.filter(tries, lambda t: ~F.array_contains(used, F.lower(t))), F.lit(0))))

    return F.transform(F.aggregate(names, F.array().cast("array<string>"), step), lambda x: F.concat(x, F.lit(ext)))


def _greedy(rows):
    """One family of names in order: each takes the first number whose name no earlier row took."""
    used, last, numbers = set(), {}, []
    for low in rows.sort_values("_at")["_low"]:
        n = last.get(low, 0) + 1
        while (own := low if n == 1 else f"{low} ({n})") in used:
            n += 1
        used.add(own)
        last[low] = n
        numbers.append(n)
    return rows.sort_values("_at").assign(_n=numbers)


def unique_rows(rows: DataFrame, name: str, order: list[str], keys=("id",), ext: str = ".md") -> DataFrame:
    """Rows with ``unique``: what ``unique_names`` makes of each key's names in the given order, of any number of rows.

    Names can only meet those of their family: the same name, in any case, but for numbers in brackets at its end. A family
    of one name is numbered by a window; one that has names with and without such numbers (``a`` and ``a (2)``) is settled
    in order, and fits a task. A null name counts as an empty one.
    """
    importable(rows.sparkSession)
    low = F.lower(F.coalesce(name, F.lit("")))
    own = rows.withColumns({"_low": low, "_family": F.regexp_replace(low, r"(?: \([0-9]+\))+$", "")})
    family = W.Window.partitionBy(*keys, "_family")
    own = own.withColumn("_at", F.row_number().over(family.orderBy(*order)))
    own = own.withColumn("_mixed", F.min("_low").over(family) != F.max("_low").over(family))
    plain = own.filter("NOT _mixed").withColumn("_n", F.col("_at"))
    mixed = own.filter("_mixed").withColumn("_n", F.lit(0))
    mixed = mixed.groupBy(*keys, "_family").applyInPandas(_greedy, mixed.schema)
    number = F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit(" ("), "_n", F.lit(")")))
    found = plain.unionByName(mixed).withColumn("unique", F.concat(F.coalesce(name, F.lit("")), number, F.lit(ext)))
    return found.drop("_low", "_family", "_at", "_mixed", "_n")


def exportable(jobs: DataFrame, tables_only: bool) -> DataFrame:
    done = F.col("status") == "done"
    return jobs.filter(done & (F.col("table_count") > 0) if tables_only else done)


def evict_sessions(sessions: DataFrame, now_ms: int, most: int = 32, max_age_ms: int = 30 * 60 * 1000) -> DataFrame:
    """Sessions younger than the age limit (from their start), of those the newest ``most``."""
    live = sessions.filter(F.lit(now_ms) - F.col("start_ms") < max_age_ms)
    return live.orderBy(F.desc("start_ms"), "session_id").limit(most)
