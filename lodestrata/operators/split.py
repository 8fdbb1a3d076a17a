"""Entity groups and leak-free, deterministic splits."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .components import connected_components
from .ranks import hash_ranks

SPLITS = ("train", "val", "test")


def key_text(key: Column) -> Column:
    """A key as a string whose order is the key's: namespace, then the number padded."""
    return F.concat(key["ns"], F.lit("\u0001"), F.lpad(F.coalesce(key["num"].cast("string"), F.lit("")), 20, "0"), F.lit("\u0001"), F.coalesce(key["id"], F.lit("")))


def entity_groups(items: DataFrame, name: str = "file_name", keys: str = "keys", same: str | None = "sha256") -> DataFrame:
    """(name, specimen): items that share a key, or bytes, are one group, transitively. Ids are
    S00001... in the order of each group's least key; items without a key get none.

    Each item is a star from its least key to its others, so the edges are linear in the keys;
    equal bytes link each copy's least key to the least of all copies, by aggregation.
    """
    own = items.where(F.size(keys) > 0).select(F.col(name).alias("name"), F.transform(keys, key_text).alias("k"), *([F.col(same).alias("same")] if same else []))
    own = own.withColumn("least", F.array_min("k"))
    edges = own.select(F.col("least").alias("a"), F.explode("k").alias("b")).where("a <> b")
    if same:
        first = own.where("same is not null").groupBy(F.col("same").alias("s")).agg(F.min("least").alias("a"))
        edges = edges.unionByName(own.join(first, F.col("same") == F.col("s")).select("a", F.col("least").alias("b")).where("a <> b"))
    found = connected_components(edges.distinct())
    rooted = own.join(found, own["least"] == found["vertex"], "left").select("name", F.coalesce("component", "least").alias("root"))
    return rooted.join(numbered_groups(rooted.select("root").distinct()), "root").select(F.col("name").alias(name), "specimen")


def numbered_groups(roots: DataFrame) -> DataFrame:
    """(root, specimen): S00001... in order. Ranks come from a count for each range of roots, so
    that no task sorts all of them."""
    ranged = roots.repartitionByRange("root").withColumn("p", F.spark_partition_id())
    ranged = stored(ranged, "roots")
    before = ranged.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("p").orderBy("root")) + F.col("before")
    return ranged.join(F.broadcast(before), "p").select("root", F.format_string("S%05d", at.cast("long")).alias("specimen"))


def majority(df: DataFrame, by: list[str], value: str, out: str = "majority") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the least."""
    return df.groupBy(*by).agg(F.mode(value, True).alias(out))


def split_one_domain(groups: DataFrame, seed: int | str, val_frac: float, test_frac: float, min_specimens: int, specimen: str = "specimen", cls: str = "class") -> DataFrame:
    """Add split, where every group lies in one evaluated domain: in hash order the first
    max(1, round(test_frac * n)) of a class are test, the next val, the rest train; a class with
    fewer than min_specimens groups is train_only. round() is half to even."""
    order = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col(cls).cast("string"), F.col(specimen).cast("string")), 256)
    placed = hash_ranks(groups.select("*"), [cls], order, specimen)
    share = lambda frac: F.greatest(F.lit(1), F.bround(F.col("total") * F.lit(frac), 0).cast("int"))
    split = F.when(F.col("total") < min_specimens, "train_only").when(F.col("rank") <= share(test_frac), "test").when(F.col("rank") <= share(test_frac) + share(val_frac), "val").otherwise("train")
    return placed.select(*groups.columns, split.alias("split"))


def fill_quotas(pool: list[tuple[str, frozenset[str]]], need: dict[str, dict[str, int]]) -> dict[str, str]:
    """group -> split: fill each split's quotas (split -> domain -> number) from a shuffled pool.

    Groups with the same domains are alike but for their place, so the pool is one queue for each
    set of domains, and every pick is the best queue's head: of the queues that give to an open
    quota, one that gives to no closed quota comes before others, then the earliest place.
    """
    queues: dict[frozenset[str], deque[tuple[int, str]]] = {}
    for place, (group, domains) in enumerate(pool):
        queues.setdefault(domains, deque()).append((place, group))
    out: dict[str, str] = {}
    for split, quota in need.items():
        open_ = Counter({d: k for d, k in quota.items() if k > 0})
        while heads := [(bool((domains & quota.keys()) - open_.keys()), q[0], domains) for domains, q in queues.items() if q and domains & open_.keys()]:
            domains = min(heads, key=lambda h: h[:2])[2]
            out[queues[domains].popleft()[1]] = split
            open_ -= Counter(d for d in domains if d in open_)
    return out


def split_classes(groups: DataFrame, domains: list[str], seed: int | str, val_frac: float, test_frac: float, min_specimens: int, shuffle: str = "hash") -> DataFrame:
    """(specimen, class, domains, split, evaluated) with quotas for each domain.

    groups: specimen, class, domains (array). A domain is evaluated for a class with at least
    min_specimens groups in it; each evaluated domain gets max(1, round(frac * n)) groups of test
    and of val. Which domains are evaluated is an aggregation; the picks hang on one another, so
    of a class's groups the ids and domains, and nothing else, are one task.
    shuffle="mt" is Python's own generator seeded with "<seed>/<class>".
    """
    rows = groups.select("specimen", F.col("class"), "domains")
    sizes = rows.select("class", F.explode("domains").alias("d"), "specimen").groupBy("class", "d").agg(F.countDistinct("specimen").alias("n")).where(F.col("d").isin(*domains) & (F.col("n") >= min_specimens))
    of_class = sizes.groupBy(F.col("class").alias("__class")).agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("sizes"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["sizes"].iloc[0]
        n = {d: sizes[d] for d in domains if sizes is not None and d in sizes}
        if not n:
            return rows.drop(columns="sizes").assign(split="train_only", evaluated=[[]] * len(rows))
        held = dict(zip(rows["specimen"], rows["domains"], strict=True))
        if shuffle == "mt":
            ids = sorted(held)
            random.Random(f"{seed}/{key[0]}").shuffle(ids)
        else:
            ids = sorted(held, key=lambda i: hashlib.sha256(f"{seed}/{key[0]}/{i}".encode()).hexdigest())
        need = {split: {d: max(1, round(frac * k)) for d, k in n.items()} for split, frac in (("test", test_frac), ("val", val_frac))}
        to = fill_quotas([(i, frozenset(held[i]).intersection(n)) for i in ids], need)
        return rows.drop(columns="sizes").assign(split=[to.get(i, "train") for i in rows["specimen"]], evaluated=[list(n)] * len(rows))

    known = rows.join(of_class, rows["class"].eqNullSafe(F.col("__class")), "left").drop("__class")
    return known.groupBy("class").applyInPandas(run, "specimen string, class string, domains array<string>, split string, evaluated array<string>")


def balance(images: DataFrame, by: list[str], split: str = "split", specimen: str = "specimen", splits: tuple[str, ...] = (*SPLITS, "train_only")) -> DataFrame:
    """images_<split> and specimens_<split> for each cell of `by`, zero where there is none."""
    cell = images.groupBy(*by).pivot(split, list(splits)).agg(F.count(F.lit(1)).alias("images"), F.countDistinct(specimen).alias("specimens"))
    out = [F.coalesce(f"{s}_{kind}", F.lit(0)).alias(f"{kind}_{s}") for kind in ("images", "specimens") for s in splits]
    return cell.select(*by, *out)


def lost_evaluation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(domain, class) that are evaluated in `before` but no longer in `after`."""
    return before.select("domain", "class").exceptAll(after.select("domain", "class").distinct()).distinct()


def evaluated_cells(groups: DataFrame, min_specimens: int) -> DataFrame:
    """(domain, class, n) with at least min_specimens groups; groups: specimen, class, domains."""
    return groups.select(F.explode("domains").alias("domain"), "class", "specimen").groupBy("domain", "class").agg(F.countDistinct("specimen").alias("n")).where(F.col("n") >= min_specimens)


def leaks(images: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split; empty in a sound split."""
    return images.where(F.col(split) != "train_only").groupBy(key).agg(F.collect_set(split).alias("splits")).where(F.size("splits") > 1)

