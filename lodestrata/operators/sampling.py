"""Seeded samples that only grow, quotas and balanced picks."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import in_bucket
from ..sources.tables import InputError


def hash_order(seed: int | str, *key: str) -> Column:
    """A seeded order that any engine with SHA-256 repeats; a prefix of it never changes when the
    sample grows."""
    return F.sha2(F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), 256)


def sample(items: DataFrame, n: int, seed: int | str, key: str = "file_name", exclude: DataFrame | None = None) -> DataFrame:
    """(position, key): the first n of the population in hash order. Top-n in every task first,
    so no task sorts the population."""
    rows = items.select(key).distinct()
    if exclude is not None:
        rows = rows.join(exclude.select(key).distinct(), key, "left_anti")
    top = rows.withColumn("__o", hash_order(seed, key)).orderBy("__o", key).limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy("__o", key)) - 1).select("position", key)


def population_hash(items: DataFrame, key: str = "file_name", chunks: int = 4096) -> str:
    """One digest of a set of names: digests of hash buckets (a sorted list each), and the digest
    of those, so that no task holds all names."""
    bucket = F.pmod(F.xxhash64(key), F.lit(chunks)).alias("b")
    parts = items.select(key).distinct().groupBy(bucket).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("h")).first()["h"]


def check_growth(saved: dict, n: int, population: str, seed: int | str, exclude: str | None = None) -> None:
    """A saved sample may only grow: same seed, population and exclusions, n not below the old."""
    if saved["seed"] != seed:
        raise InputError(f"the sample was drawn with seed {saved['seed']}")
    if saved.get("exclude") != exclude:
        raise InputError("the sample was drawn with other exclusions")
    if saved["population"] != population:
        raise InputError("the population changed since the sample was drawn")
    if n < saved["n"]:
        raise InputError(f"the sample has {saved['n']} items already; it can only grow")


def mt_shuffle(names: list[str], seed: int | str) -> list[str]:
    """The order that Python's generator gives the sorted names; for lists that fit a driver."""
    out = sorted(names)
    random.Random(seed).shuffle(out)
    return out


def blind_order(pairs: DataFrame, seed: int | str, run: str = "run", key: str = "file_name") -> DataFrame:
    """(position, run, key): all pairs in one hash order, so that neighbours tell nothing of the
    run. Positions come from ranks within ranges and a prefix sum, not from one sorting task."""
    rows = pairs.select(run, key).withColumn("__o", hash_order(seed, run, key))
    slot = F.conv(F.substring("__o", 1, 3), 16, 10).cast("int")  # 4096 ranges of the hash
    rows = rows.withColumn("__s", slot)
    before = rows.groupBy("__s").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = F.row_number().over(Window.partitionBy("__s").orderBy("__o", run, key)) - 1
    return rows.withColumn("__at", at).join(F.broadcast(before), "__s").select((F.col("__at") + F.col("__before")).alias("position"), run, key)


def common_to_all(items: DataFrame, run: str = "run", key: str = "file_name") -> DataFrame:
    """Items that every run has: the n-way intersection as one aggregation."""
    n = items.select(run).distinct().count()
    keep = items.groupBy(key).agg(F.countDistinct(run).alias("__n")).where(F.col("__n") == n).select(key)
    return items.join(keep, key, "left_semi")


def pick(items: DataFrame, n: int, seed: int | str, key: str = "file_name") -> DataFrame:
    """n items in hash order; refuses if there are fewer."""
    have = items.select(key).distinct().count()
    if have < n:
        raise InputError(f"{n} items asked for, {have} there")
    return sample(items, n, seed, key)


def per_stratum(items: DataFrame, n: int, seed: int | str, strata: list[str], key: str) -> DataFrame:
    """Up to n of each stratum, in hash order."""
    r = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, key), key))
    return items.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def balanced(items: DataFrame, groups: int, seed: int | str, cls: str, group: str, key: str) -> DataFrame:
    """One item of each of `groups` groups of every class that has so many: classes are weighed
    alike whatever their sizes."""
    one = items.withColumn("__r", F.row_number().over(Window.partitionBy(cls, group).orderBy(hash_order(seed, key), key))).where("__r = 1").drop("__r")
    n = F.count("*").over(Window.partitionBy(cls))
    r = F.row_number().over(Window.partitionBy(cls).orderBy(hash_order(seed, group), group))
    return one.withColumn("__n", n).withColumn("__r", r).where((F.col("__n") >= groups) & (F.col("__r") <= groups)).drop("__n", "__r")


def quotas(items: DataFrame, flag_quotas: list[tuple[str, int]], strata: list[tuple[str, str, int]], seed: int | str, per_genus: int) -> DataFrame:
    """(file_name, stratum): quotas by flag first, then by (view, bucket of instances), while no
    specimen is taken twice and no genus more than per_genus times over all strata.

    items: file_name, genus, catalog_number, view, instances, flags. The caps tie all strata
    together, so the walk itself is one task; what goes there is bounded by the quotas alone. With
    N picks in all, N specimens are taken at most and N / per_genus genera full. So of a stratum
    only the first of each genus and specimen can be picked; of a genus the first per_genus + N;
    of a specimen those of the first N / per_genus + 1 genera; and of what is left the first n,
    plus as many as taken specimens and full genera can block.
    """
    tests = [(f"flag:{f}", F.array_contains("flags", f), n) for f, n in flag_quotas]
    tests += [(f"{v}:{b}", (F.col("view") == v) & in_bucket(F.lit(b), F.col("instances")), n) for v, b, n in strata]
    hit = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("i"), F.lit(name).alias("stratum"), F.lit(n).alias("n"))) for i, (name, c, n) in enumerate(tests)]))
    rows = items.select("file_name", "genus", "catalog_number", F.explode(hit).alias("s")).select("file_name", "genus", "catalog_number", "s.*")
    rows = rows.withColumn("o", F.sha2(F.concat_ws("/", F.lit(str(seed)), "stratum", "file_name"), 256))
    picks = sum(n for _, _, n in tests)
    full = picks // max(per_genus, 1)
    blocked = picks * (full + 1) + full * (per_genus + picks)
    for by, most in ((["i", "genus", "catalog_number"], 1), (["i", "genus"], per_genus + picks), (["i", "catalog_number"], full + 1), (["i"], picks + blocked)):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("o", "file_name"))).where(F.col("r") <= most).drop("r")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, specimens, genera, got = [], set(), {}, {}
        for x in pdf.sort_values(["i", "o", "file_name"]).itertuples():
            if got.get(x.i, 0) == x.n or x.catalog_number in specimens or genera.get(x.genus, 0) >= per_genus:
                continue
            specimens.add(x.catalog_number)
            genera[x.genus] = genera.get(x.genus, 0) + 1
            got[x.i] = got.get(x.i, 0) + 1
            taken.append((x.file_name, x.stratum))
        return pd.DataFrame(taken, columns=["file_name", "stratum"])

    return rows.groupBy().applyInPandas(walk, "file_name string, stratum string")
