"""MinHash near-dedup with an LSH forest.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and `TREES * DEPTH`
   MinHash values. Texts with equal sets form a class; only classes go on, each with its least
   doc_id, so that a text copied into a third of all rows is one row from here on.
2. The forest: tree t has its own DEPTH values, and holds the classes in the order of them. A
   region is a run of classes that share a prefix; classes that share no prefix of two values
   with another, in any tree, are done.
3. Each region is as deep as its size asks: one of at most ROOM classes at a depth of two stays,
   a denser one is cut at depth three, and so on. The classes of a region of at most ROOM are
   candidates of each other, neighbours by longest common prefix; a class of a denser region
   is a candidate of the region's least class at each depth where it is dense. So a class has a
   bounded number of candidates in each tree. Candidates whose signatures agree are confirmed on
   their whole sets, and the links' components are found.
4. A region that was dense at a depth of two may have been cut between two classes that are
   linked. Where such a region holds different components, and only there, its classes go
   through an exact prefix filter. Ordered by how many classes hold them, the rarest shingles
   come first, and two sets can only reach the similarity if they share one among the first few
   (8 % and 15 % of them at 0.85), with enough left behind it. Shingles inside one component
   count as unshared. What passes is confirmed.
5. Components of all confirmed links.

A pair at a similarity of 0.85 shares a prefix of two values in one of 10 trees or more with
probability 1 - (1 - 0.85^2)^10 = 0.999997; from there on nothing is left to chance but the
signatures' agreement (5.4 standard deviations).

Defined results: a text without words has an empty set, is linked with nothing and is kept;
a text with fewer than k words has one shingle, the whole sequence; rows that share a doc_id are
one vertex; a null doc_id is linked with nothing and kept; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ._common import column, raw, stored

TREES, DEPTH = 10, 6
LEVELS = range(2, DEPTH + 1)
#: Classes of one region that are all candidates of each other; a denser region is cut deeper.
ROOM = 32
#: Bitmaps of sets have this many 64-bit words.
WORDS = 32
#: Up to so many ids (8 MB) are broadcast to pick their texts; more are joined.
BROADCAST_IDS = 1_000_000
#: Signatures that agree in a share of their places this far below the similarity asked for are
#: no candidates: 5.4 standard deviations for a pair at 0.85.
BELOW = 0.25

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash; keeps the first words seen up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


def shingles(text: bytes, cache: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(k, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - width + 1, np.uint64)
        for i in range(width):
            h = h * _POWER + w[i : i + len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h += np.uint64(width != k) * np.uint64(len(w))
    return np.unique(h)


def minhash(h: np.ndarray) -> np.ndarray:
    """The high 32 bits of the least value under each of TREES * DEPTH permutations."""
    out = np.full(TREES * DEPTH, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 8192):
            part = h[at : at + 8192]
            np.minimum(out, ((part[:, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, signature); d1 and d2 are a 128-bit digest of the set, null
    with the signature where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            n, d1, d2, sig = [], [], [], []
            for t in raw(b, "text"):
                h = shingles(t, cache, k)
                n.append(len(h))
                if len(h):
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    d1.append(int.from_bytes(d[:8], "little", signed=True))
                    d2.append(int.from_bytes(d[8:], "little", signed=True))
                    sig.append(minhash(h).tobytes())
                else:
                    d1.append(None)
                    d2.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def regions(classes: DataFrame) -> DataFrame:
    """(id, n, p2 ... p6), one row for each class and tree; a prefix hash covers the tree's
    number, so that regions of different trees never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(raw(b, "signature")), np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2]).copy()
            out = {}
            with np.errstate(over="ignore"):
                for d in range(DEPTH):
                    h = (h ^ sig[:, :, d]) * _POWER
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(32)
                    out[d + 1] = h.copy()
            each = lambda x: np.repeat(x.to_numpy(zero_copy_only=False), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(each(column(b, "id"))), pa.array(each(column(b, "n")))] + [pa.array(out[d].reshape(-1).view(np.int64)) for d in LEVELS], names=["id", "n", *(f"p{d}" for d in LEVELS)])

    return classes.select("id", "n", "signature").mapInArrow(run, "id long, n long, " + ", ".join(f"p{d} long" for d in LEVELS))


def _sizes_allow(n: str, m: str, percent: int):
    """The smaller set over the larger is the most that the similarity can be."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _shared(forest: DataFrame) -> DataFrame:
    """Rows of the forest whose region of depth LEVELS[0] has two classes or more."""
    key = f"p{LEVELS[0]}"
    wide = forest.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(F.col(key).alias("k"))
    return forest.join(wide, F.col(key) == F.col("k"), "left_semi")


def forest_pairs(shared: DataFrame, percent: int, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """(a, b), candidates of the forest, if sizes allow; and the rows of `shared` in regions that
    are dense at the first depth. A region is gathered only where it holds at most `room`."""
    rest, pairs, dense_first = shared, [], None
    for depth in LEVELS:
        key = f"p{depth}"
        found = stored(rest.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("a"), F.min_by("n", "id").alias("m")).where("c > 1"), "regions")
        deeper = [f"p{d}" for d in LEVELS if d > depth]
        own = rest.join(found.where(F.col("c") <= room).select(key), key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*deeper, "id", "n"))).alias("own"))
        each = own.select("own", F.posexplode("own").alias("at", "x")).select("x", F.explode(F.expr("slice(own, at + 2, size(own))")).alias("y"))
        pairs.append(each.where(_sizes_allow("x.n", "y.n", percent)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
        dense = found.where(F.col("c") > room)
        rest = stored(rest.join(dense.select(key, "a", "m"), key), "dense")
        pairs.append(rest.where((F.col("id") > F.col("a")) & _sizes_allow("n", "m", percent)).select("a", F.col("id").alias("b")))
        rest = rest.drop("a", "m")
        dense_first = rest if dense_first is None else dense_first
        if rest.isEmpty():
            break
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.where("a <> b").distinct(), dense_first


def _unsettled(dense: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, part): classes in dense regions that hold two components or more."""
    key = f"p{LEVELS[0]}"
    rows = stored(dense.join(parts, dense["id"] == parts["vertex"], "left").select("id", F.coalesce("component", "id").alias("part"), F.col(key).alias("p")), "parts")
    mixed = stored(rows.groupBy("p").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("p"), "mixed")
    return rows.join(mixed, "p").select("id", "part").distinct()


def _tokens(texts: DataFrame, k: int) -> DataFrame:
    """(id, part, n, token): the shingles of texts (id, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            for i, part, t in zip(column(b, "id").to_pylist(), column(b, "part").to_pylist(), raw(b, "text"), strict=True):
                h = shingles(t, cache, k)
                same = lambda x, n=len(h): pa.array(np.full(n, x, np.int64))
                yield pa.RecordBatch.from_arrays([same(i), same(part), same(len(h)), pa.array(h.view(np.int64))], names=["id", "part", "n", "token"])

    return texts.select("id", "part", "text").mapInArrow(run, "id long, part long, n long, token long")


def _bitmaps(texts: DataFrame, k: int) -> DataFrame:
    """(id, w0 ...): a bitmap of each text's set, one bit for each shingle's hash. Bits in which two
    bitmaps differ each stand for a shingle that only one set has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            out = np.zeros((b.num_rows, WORDS), np.uint64)
            for r, t in enumerate(raw(b, "text")):
                at = shingles(t, cache, k) >> np.uint64(16)
                np.bitwise_or.at(out[r], (at >> np.uint64(6)) % np.uint64(WORDS), np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([column(b, "id"), *[pa.array(np.ascontiguousarray(out[:, w]).view(np.int64)) for w in range(WORDS)]], names=["id", *(f"w{w}" for w in range(WORDS))])

    return texts.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"w{w} long" for w in range(WORDS)))


def _second_pairs(texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b, common) of different components that can reach the similarity, by the prefix filter;
    `common` counts the shingles of their prefixes that both have. Tables that a join meets on a
    shingle are stored before it, so that the join is free to split a very frequent one."""
    tokens = stored(_tokens(texts, k), "tokens")
    across = stored(tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("token", "c"), "across")
    rows = tokens.join(across, "token")
    rare_first = Window.partitionBy("id").orderBy("c", "token")
    rows = rows.withColumn("r", F.row_number().over(rare_first)).withColumn("s", F.count("*").over(Window.partitionBy("id")))
    # Shingles that no other component holds come before all others, as if each were unique.
    rows = rows.withColumn("pos", F.col("n") - F.col("s") + F.col("r"))
    longer = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    shorter = F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
    rows = rows.where(F.col("pos") <= longer).select("token", "id", "part", "n", "pos", (F.col("pos") <= shorter).alias("first"))
    rows = stored(rows, "prefixes")
    # Of a shingle's rows, those of its most frequent component never need each other.
    most = stored(rows.groupBy("token", "part").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("part", "c").alias("major")), "majors")
    rows = rows.join(most, "token").withColumn("in_major", F.col("part") == F.col("major")).drop("major")
    rows = stored(rows.join(_bitmaps(texts, k), "id"), "marked")
    words = [f"w{w}" for w in range(WORDS)]
    y = rows.where("first").select("token", *[F.col(c).alias(f"{c}_y") for c in ("id", "part", "n", "pos", "in_major", *words)])
    x = rows.select("token", *[F.col(c).alias(f"{c}_x") for c in ("id", "part", "n", "pos", "in_major", *words)])
    smaller = (F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("id_y") < F.col("id_x")))
    most_common = 1 + F.least(F.col("n_y") - F.col("pos_y"), F.col("n_x") - F.col("pos_x"))
    fits = smaller & (F.col("part_y") != F.col("part_x")) & _sizes_allow("n_y", "n_x", percent) & (most_common * (100 + percent) >= (F.col("n_y") + F.col("n_x")) * percent)
    differ = F.expr(" + ".join(f"bit_count({w}_y ^ {w}_x)" for w in words))
    # common = (sizes - difference) / 2 and common * (100 + percent) >= sizes * percent
    fits = fits & ((F.col("n_y") + F.col("n_x") - differ) * (100 + percent) >= (F.col("n_y") + F.col("n_x")) * 2 * percent)
    both = y.where("not in_major_y").join(x, "token").where(fits).unionByName(y.where("in_major_y").join(x.where("not in_major_x"), "token").where(fits))
    return both.groupBy(F.least("id_y", "id_x").alias("a"), F.greatest("id_y", "id_x").alias("b")).agg(F.count("*").alias("common"))


def _best_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b): for each class the pairs, as the first and as the second, with the most in common."""
    by_a = pairs.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b"))
    by_b = pairs.groupBy("b").agg(F.max_by("a", F.struct("common", "a")).alias("a")).select("a", "b")
    return by_a.unionByName(by_b).distinct()


def _still_apart(pairs: DataFrame, parts: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs not tried whose ends are in different components."""
    part = lambda end: parts.select(F.col("vertex").alias(end), F.col("component").alias(f"p{end}"))
    out = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("pa", "a") != F.coalesce("pb", "b"))
    return out.select("a", "b").join(tried, ["a", "b"], "left_anti")


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree nearly as much as `percent` asks."""
    sig = classes.select("id", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    least = int((percent / 100 - BELOW) * TREES * DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(raw(b, c)), np.uint32).reshape(-1, TREES * DEPTH) for c in ("sa", "sb"))
            ok = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([column(b, c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for b in batches:
            ok = []
            for s, t in zip(raw(b, "ta"), raw(b, "tb"), strict=True):
                if s != last[0]:
                    last = (s, shingles(s, cache, k))
                x, y = last[1], shingles(t, cache, k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(b, c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of docs."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(own, k), "signatures")
    classes = stored(signed.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")
    shared = stored(_shared(regions(classes)), "shared")
    ids = shared.select("id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = stored(own.join(ids, own["doc_id"] == ids["id"], "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")

    pairs, dense = forest_pairs(shared, percent)
    first = stored(_confirmed(stored(_agreeing(pairs, classes, percent), "pairs"), texts, percent, k), "links")
    open_ = _unsettled(dense, connected_components(first))
    second = stored(_second_pairs(stored(texts.join(open_, "id"), "unsettled"), percent, k), "pairs")
    tried = stored(_best_pairs(second), "tried")
    found = first.unionByName(stored(_confirmed(tried, texts, percent, k), "links"))
    parts = connected_components(found)
    rest = stored(_still_apart(second, parts, tried), "rest")
    third = stored(_confirmed(rest, texts, percent, k), "links")
    if third.limit(1).count():
        parts = connected_components(found.unionByName(third))
    member = signed.select("doc_id", "n_shingles", "d1", "d2").join(classes.select("d1", "d2", F.col("id").alias("class_id")), ["d1", "d2"], "left")
    out = member.join(parts, member["class_id"] == parts["vertex"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`: five-word shingles, similarity of 0.85 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, 85, 5).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 85 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION
  SELECT edge.b, walk.r FROM walk JOIN edge ON edge.a = walk.v),
comp AS (SELECT v, min(r) AS component_id FROM walk GROUP BY v),
cls AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS class_id
  FROM (SELECT doc_id, string_agg(g, chr(10) ORDER BY g) AS sig FROM s GROUP BY doc_id))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept,
       coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN comp ON comp.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN cls ON cls.doc_id = d.doc_id
"""
