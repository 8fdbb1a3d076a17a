"""Nearest neighbours by a hash-prefix forest.

Each tree gives a vector a string of BITS sign bits of random projections, and holds the strings
of all vectors in order, cut into cells: prefixes that are as long as a cell of about ROOM strings
needs. A query

1. goes down to its own cell in every tree, where the sorted strings tell how many share each of
   its prefixes; the cells themselves tell it for the shorter ones;
2. ascends in all trees together, one bit at a time, until the strings that share its prefix,
   summed over the trees, are `effort` or more;
3. goes to every cell under that prefix, usually its own, and takes the strings that share it as
   candidates. Their inner products, on the original vectors in double precision, are computed
   there, and each cell answers with its k best.

The effort is measured, not guessed: for CALIBRATE of the queries the true neighbours come from
one scan, which also counts, for each prefix length, the strings at hand and the neighbours that
share it. The least effort at which `recall` of them is found holds for all queries. Clustered
vectors need a few candidates of all; vectors without any structure need most (README).

A query's work is its candidates, not the table: cells are dealt to tasks, and each cell meets
only the queries that go there. Vectors with equal components are one representative with the
least k + 1 of their ids: a vector that a third of all rows repeat is one string of each tree.

The projections make no difference between lengths, so vectors are first extended by one
component that brings each to the greatest norm (queries get a zero there): then the angle
orders as the inner product does.

Defined results: vectors that are null, zero or hold a null or a non-finite component take no
part, neither as queries nor as candidates; a vector of another dimension than a query's is no
candidate of it; a null id takes no part; equal rows count once; rows that share an id are
separate candidates with one id, none of them a candidate of a query of that id, and separate
queries; an inner product beyond the range of doubles is infinite as IEEE arithmetic has it; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import column, rows_of, sampled, stored

TREES, BITS = 8, 32
ROOM, CALIBRATE, DEEPER = 16384, 48, 4


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part, components as they are (-0.0 as 0.0)."""
    v = F.transform(F.col(embedding), lambda x: x + F.lit(0.0).cast("float"))
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    fine = F.expr("v is not null and vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return own.where(fine)


@dataclass(frozen=True)
class Trees:
    """What every task needs to hash a vector: the greatest component and, by dimension, the
    greatest norm after division by it, so that no square overflows."""

    scale: float
    top: dict[int, float]
    trees: int
    bits: int
    seed: int = 7

    def strings(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(n, trees) strings as whole numbers, first bit highest."""
        dim = x.shape[1]
        planes = np.random.default_rng((self.seed, dim)).standard_normal((dim + 1, self.trees * self.bits))
        x = x / self.scale
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top[dim] ** 2 - (x * x).sum(axis=1), 0.0))
        side = (x @ planes[:-1] + np.outer(extra, planes[-1])) > 0
        weight = np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return side.reshape(len(x), self.trees, self.bits) @ weight

    def hashed(self, rows: DataFrame, query: bool) -> DataFrame:
        """rows with a vector v, and dim and keys (one string for each tree)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = column(b, "v")
                dims = np.array([len(x) for x in v], np.int32)
                keys = np.zeros((len(dims), self.trees), np.int64)
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    if int(d) in self.top:
                        keys[at] = self.strings(matrix(v.take(pa.array(at)), int(d)), query)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(list(keys), pa.list_(pa.int64()))], names=[*b.schema.names, "dim", "keys"])

        shape = rows.withColumn("dim", F.lit(0)).withColumn("keys", F.lit(None).cast("array<bigint>")).schema
        return rows.mapInArrow(run, shape)


def matrix(v: pa.Array, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _prefix(key: str, length):
    return F.expr(f"shiftright({key}, {BITS} - ({length}))")


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in one fixed order of summation: equal vectors get equal scores."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (x * q).sum(axis=1)


def _best(rough: np.ndarray, k: int) -> np.ndarray:
    """Places of all that could still be among the k + 1 best after exact summation."""
    if len(rough) <= 2 * k:
        return np.arange(len(rough))
    bound = -np.partition(-rough, k)[k] - 1e-9 * (1 + np.abs(rough).max())
    return np.flatnonzero(rough >= bound)


def efforts(vectors: DataFrame, sample: list, trees: Trees, k: int) -> pd.DataFrame:
    """(effort, recall, share) over the sample of queries: at each effort, the part of their true
    neighbours found and the part of all vectors looked at. One scan of the hashed vectors."""
    levels = trees.bits + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, v = column(b, "dim").to_numpy(), column(b, "v")
            keys = matrix(column(b, "keys"), trees.trees).astype(np.int64)
            ids = column(b, "ids").to_pylist()
            rows = []
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = matrix(v.take(pa.array(at)), int(d)) / trees.scale
                for n, (vec_id, q) in enumerate(sample):
                    if len(q) != d:
                        continue
                    q = np.asarray(q, np.float64)
                    differ = keys[at] ^ trees.strings(q[None], True)
                    common = trees.bits - np.frexp(differ.astype(np.float64))[1]  # equal first bits
                    most = common.max(axis=1)
                    rough = x @ (q / trees.scale)
                    others = np.array([ids[i] != [vec_id] for i in at])
                    best = np.flatnonzero(others)[np.argsort(-rough[others], kind="stable")[:k]]
                    rows.append((n, np.bincount(common.reshape(-1), minlength=levels).tolist(), np.bincount(most, minlength=levels).tolist(), [{"s": float(s), "c": int(c)} for s, c in zip(rough[best], most[best], strict=True)]))
            if rows:
                a = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int32()), pa.array(a[1], pa.list_(pa.int64())), pa.array(a[2], pa.list_(pa.int64())), pa.array(a[3], pa.list_(pa.struct([("s", pa.float64()), ("c", pa.int32())])))], names=["q", "strings", "vectors", "best"])

    got = vectors.select("ids", "v", "dim", "keys").mapInArrow(scan, "q int, strings array<bigint>, vectors array<bigint>, best array<struct<s:double,c:int>>")
    # Summed by level and cut to k neighbours for each query of the sample before it is collected.
    got = stored(got, "levels")
    levels_of = got.select("q", F.posexplode(F.arrays_zip("strings", "vectors")).alias("level", "n")).groupBy("q", "level").agg(F.sum("n.strings").alias("strings"), F.sum("n.vectors").alias("vectors")).collect()
    top = Window.partitionBy("q").orderBy(F.col("b.s").desc())
    true = got.select("q", F.explode("best").alias("b")).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "b.c").collect()
    queries = sorted({r["q"] for r in true})
    strings, seen, hit = (np.zeros((len(sample), levels)) for _ in range(3))
    for r in levels_of:
        strings[r["q"], r["level"]], seen[r["q"], r["level"]] = r["strings"], r["vectors"]
    for r in true:
        hit[r["q"], r["c"]] += 1
    if not queries:
        return pd.DataFrame({"effort": [1.0], "recall": [1.0], "share": [1.0]})
    # from here on: at least so many first bits in common
    strings, seen, hit = (np.cumsum(x[queries, ::-1], axis=1)[:, ::-1] for x in (strings, seen, hit))
    out, effort = [], float(k)
    while True:
        level = np.array([np.flatnonzero(s >= min(effort, s[0])).max() for s in strings])
        each = np.arange(len(queries))
        out.append((effort, float((hit[each, level] / hit[:, 0]).mean()), float((seen[each, level] / seen[:, 0]).mean())))
        if effort >= strings[:, 0].max():
            return pd.DataFrame(out, columns=["effort", "recall", "share"])
        effort = float(np.ceil(effort * 1.25))


def cells(entries: DataFrame, room: int, depth: int) -> DataFrame:
    """(dim, tree, depth, prefix, n, chunks): prefixes that cut every tree, of `depth` bits and,
    where more than `room` strings share one, of as many more as it takes. Only strings that
    are equal to the last bit can be more; those are dealt in chunks."""
    rest, out = entries, None
    while True:
        n = stored(rest.groupBy("dim", "tree", _prefix("key", depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "prefixes")
        done = n if depth >= BITS else n.where(F.col("n") <= room)
        done = done.select("dim", "tree", F.lit(depth).alias("depth"), "prefix", "n", F.ceil(F.col("n") / (4 * room)).cast("int").alias("chunks"))
        out = done if out is None else out.unionByName(done)
        dense = n.where(F.col("n") > room).drop("n")
        if depth >= BITS or dense.isEmpty():
            return stored(out, "cells")
        rest = rest.withColumn("prefix", _prefix("key", depth)).join(dense, ["dim", "tree", "prefix"], "left_semi").drop("prefix")
        depth = min(depth + DEEPER, BITS)


CELL = ["dim", "tree", "depth", "prefix"]


def _in_cells(rows: DataFrame, cut: DataFrame, depths: list[int]) -> DataFrame:
    """Rows (dim, tree, key, ...) with the one cell that holds the key."""
    each = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))) if len(depths) > 1 else rows.withColumn("depth", F.lit(depths[0]))
    own = cut.select(*[F.col(c).alias(c) for c in (*CELL, "chunks")])  # columns of its own: both sides of a cogroup have them
    return each.withColumn("prefix", _prefix("key", "depth")).join(own, CELL)


def _ascents(asked: DataFrame, entries: DataFrame, cut: DataFrame, depths: list[int], effort: float) -> DataFrame:
    """(q, level): the longest prefix at which the strings of all trees reach the effort."""

    def count(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        keys, depth = np.sort(have["key"].to_numpy()), int(ask["depth"].iloc[0]) if len(ask) else 0
        of, level, n = [], [], []
        for at in range(depth, BITS + 1):
            rest = np.int64(BITS - at)
            first = ask["key"].to_numpy() >> rest << rest
            n.append(np.searchsorted(keys, first + (np.int64(1) << rest) - 1, "right") - np.searchsorted(keys, first, "left"))
            of.append(ask["q"].to_numpy())
            level.append(np.full(len(ask), at))
        out = pd.DataFrame({"q": np.concatenate(of), "level": np.concatenate(level), "n": np.concatenate(n)}).astype("int64")
        return out[out["n"] > 0]

    held = _in_cells(entries.select("rep", "dim", "tree", "key"), cut, depths).withColumn("chunk", F.pmod("rep", "chunks").cast("int")).select(*CELL, "chunk", "key")
    goes = _in_cells(asked.select("q", "dim", "tree", "key"), cut, depths).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*CELL, "chunk", "q", "key")
    deep = held.groupBy(*CELL, "chunk").cogroup(goes.groupBy(*CELL, "chunk")).applyInPandas(count, "q long, level int, n long")
    above = _above(cut).groupBy("dim", "tree", "level", "upper").agg(F.sum("n").alias("n"))
    each = asked.select("q", "dim", "tree", F.explode(F.sequence(F.lit(0), F.lit(max(depths)))).alias("level"), "key").withColumn("upper", _prefix("key", "level"))
    wide = each.join(above, ["dim", "tree", "level", "upper"]).select("q", "level", "n")
    sums = deep.unionByName(wide).groupBy("q", "level").agg(F.sum("n").alias("n"))
    return sums.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("n") >= effort, F.col("level"))), F.lit(0)).alias("level"))


def _above(cut: DataFrame) -> DataFrame:
    """The cells under each prefix that is shorter than theirs."""
    return cut.where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1))).withColumn("upper", F.expr("shiftright(prefix, depth - level)"))


def _routes(asked: DataFrame, cut: DataFrame, depths: list[int]) -> DataFrame:
    """Queries (q, query_id, v, level, dim, tree, key) with each cell under their prefix."""
    inside = _in_cells(asked, cut, depths).where("depth <= level")
    upper = asked.withColumn("upper", _prefix("key", "level"))
    below = upper.join(_above(cut).drop("n"), ["dim", "tree", "level", "upper"])
    names = ["q", "query_id", "v", "level", "key", *CELL]
    both = inside.select(*names, "chunks").unionByName(below.select(*names, "chunks"))
    return both.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def _answers(k: int, scale: float):
    """Of one cell and its queries: (q, query_id, rep, ids, score), the k best of each query."""

    def answer(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q": [], "query_id": [], "rep": [], "ids": [], "score": []}
        if len(have) and len(ask):
            have = have.sort_values(["key", "rep"])
            keys, x = have["key"].to_numpy(), np.array(have["v"].tolist(), np.float64)
            reps, ids, small = have["rep"].to_numpy(), have["ids"].tolist(), x / scale
            only = np.array([i[0] if len(i) == 1 else -(1 << 63) for i in ids])
            for (level, _), some in ask.groupby([ask["level"], ask["key"].to_numpy() >> (BITS - ask["level"].to_numpy())]):
                rest = np.int64(BITS - level)
                first = some["key"].iloc[0] >> rest << rest
                low, high = np.searchsorted(keys, [first, first + (np.int64(1) << rest)])
                for start in range(0, len(some) if high > low else 0, 256):
                    part = some.iloc[start : start + 256]
                    q = np.array(part["v"].tolist(), np.float64)
                    rough = small[low:high] @ (q / scale).T
                    for j, (row, own) in enumerate(zip(part["q"], part["query_id"], strict=True)):
                        other = np.flatnonzero(only[low:high] != own)
                        at = low + other[_best(rough[other, j], k)]
                        out["q"].extend([row] * len(at))
                        out["query_id"].extend([own] * len(at))
                        out["rep"].extend(reps[at].tolist())
                        out["ids"].extend([ids[i] for i in at])
                        out["score"].extend(_scores(x[at], q[j]).tolist())
        kinds = {"q": "int64", "query_id": "int64", "rep": "int64", "ids": "object", "score": "float64"}
        return pd.DataFrame({c: pd.Series(out[c], dtype=kind) for c, kind in kinds.items()})

    return answer


def index(rows: DataFrame, k: int, vec_id: str, embedding: str, trees: int) -> tuple[DataFrame, Trees]:
    """(rep, ids, v, dim, keys), stored, and how they were hashed."""
    least = Window.partitionBy("v").orderBy("vec_id")
    kept = usable(rows, vec_id, embedding).distinct().withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    reps = stored(kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    scale = float(reps.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0] or 1.0)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / F.lit(scale), F.lit(2.0))))
    top = {r["d"]: r["m"] for r in reps.groupBy(F.size("v").alias("d")).agg(F.max(norm).alias("m")).collect()}  # one row a dimension
    how = Trees(scale, top, trees, BITS)
    return stored(how.hashed(reps, False), "hashed"), how


def search(rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, effort: float | None = None, trees: int = TREES, room: int = ROOM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of `queries`,
    without itself. `effort` is the number of strings, over all trees, at which the ascent stops;
    by default the least that finds `recall` of the true neighbours of a sample of the queries."""
    held, how = index(rows, k, vec_id, embedding, trees)
    asked = usable(queries, vec_id, embedding).distinct().select(F.col("vec_id").alias("query_id"), "v", F.monotonically_increasing_id().alias("q"))
    asked = stored(how.hashed(stored(asked, "queries"), True), "asked")
    if effort is None:
        table = measured(held, asked, how, k)
        enough = table[table["recall"] >= recall]
        effort = float(enough["effort"].iloc[0] if len(enough) else table["effort"].iloc[-1])
    n = held.count()
    entries = held.select("rep", "ids", "v", "dim", F.posexplode("keys").alias("tree", "key"))
    cut = cells(entries.select("dim", "tree", "key"), room, max(0, int(np.ceil(np.log2(max(n / room, 1))))))
    depths = sorted(r["depth"] for r in cut.select("depth").distinct().collect()) or [0]
    each = asked.select("q", "query_id", "v", "dim", F.posexplode("keys").alias("tree", "key"))
    goes = each.join(stored(_ascents(each, entries, cut, depths, effort), "levels"), "q")
    there = _in_cells(entries, cut, depths).withColumn("chunk", F.pmod("rep", "chunks").cast("int")).select(*CELL, "chunk", "rep", "ids", "v", "key")
    keys = [*CELL, "chunk"]
    found = there.groupBy(*keys).cogroup(_routes(goes, cut, depths).groupBy(*keys)).applyInPandas(_answers(k, how.scale), "q long, query_id long, rep long, ids array<long>, score double")
    once = found.groupBy("q", "query_id", "rep").agg(F.first("ids").alias("ids"), F.max("score").alias("score"))
    near = once.select("q", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measured(held: DataFrame, asked: DataFrame, how: Trees, k: int, sample: int = CALIBRATE) -> pd.DataFrame:
    """The table of efforts for a sample of hashed queries against hashed vectors."""
    some = sampled(asked.select("query_id", "v"), sample).orderBy("key").collect()  # `sample` rows
    return efforts(held, [(r["query_id"], r["v"]) for r in some], how, k)


def op1_hash_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """`embeddings`: rows whose vec_id is divisible by 20 against all rows."""
    rows = rows_of(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"), k=20)
