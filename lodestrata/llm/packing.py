"""Best-fit packing of token sequences after a Martello-Toth reduction.

Lengths are whole numbers up to the capacity, so an instance of any size is a histogram of at
most `capacity` counts. The driver solves that histogram: the dominance criterion of
Martello and Toth fixes bins that are part of some optimal packing, whole counts at a time;
best-fit decreasing places the rest. Its result is a list of patterns (lengths of one bin,
number of such bins), again bounded by the capacity and not by the data. Every piece then
finds its place from its rank among the pieces of its length; ranks come from a count for
each (length, bucket), so that a length that a third of all pieces share is no single task.

Defined results: a null or empty text has only the closing id; rows that share a doc_id are
separate documents; equal rows are dealt over buckets by their place in the table; an empty
table gives no rows; columns beside id and text are not read. `pack` replaces columns named
sequence_id and offset; its other columns pass through, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import column, fresh, raw, stored
from .tokens import word_cache

Pattern = tuple[tuple[int, int], ...]  # (length, times) of one bin, longest first


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[Counter, dict[int, int]]:
    """Martello-Toth reduction on a histogram: bins fixed for good, and what is left.

    For each length x, longest first, r is the room beside it and y the longest other piece
    that fits. Some optimal packing holds

    * {x} alone, if nothing else fits;
    * {x, y}, if y fills r, or if no two other pieces fit together, or if two fit but no three
      and no two that fit are longer than y together.

    In each case every bin that could hold x is dominated: its other pieces can be exchanged
    for y, piece by piece or two for one. Taking pieces away only makes fewer bins possible, so
    a rule that holds once holds for as many bins as the counts of x and y allow. Lengths that
    no rule covers stay in the instance and count as possible partners of shorter ones.
    """
    left = {k: v for k, v in counts.items() if v}
    keys = sorted(left)
    fixed: Counter = Counter()

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            keys.pop(bisect.bisect_left(keys, length))

    def smallest(x: int) -> list[int]:
        """The three shortest pieces besides one x."""
        out: list[int] = []
        for k in keys[:4]:
            out += [k] * min(3, left[k] - (k == x))
        return (out + [capacity + 1] * 3)[:3]

    for x in sorted(left, reverse=True):
        while x in left:
            room = capacity - x
            at = bisect.bisect_right(keys, room) - 1
            if at >= 0 and keys[at] == x and left[x] == 1:
                at -= 1
            if at < 0:
                fixed[((x, 1),)] += left[x]
                take(x, left[x])
                break
            y = keys[at]
            one, two, three = smallest(x)
            if not (y == room or one + two > room or (one + two + three > room and y >= _best_two(keys, left, x, room))):
                break
            if x == y:
                m = left[x] // 2
                fixed[((x, 2),)] += m
                take(x, 2 * m)
            else:
                m = min(left[x], left[y])
                fixed[((max(x, y), 1), (min(x, y), 1))] += m
                take(x, m)
                take(y, m)
    return fixed, left


def _best_two(keys: list[int], left: dict[int, int], x: int, room: int) -> int:
    """The largest sum of two pieces, besides one x, that fits into the room."""
    best, i, j = 0, 0, bisect.bisect_right(keys, room) - 1
    while i <= j:
        a, b = keys[i], keys[j]
        have = left[a] - (a == x)
        if a + b > room or left[b] == (b == x) or (i == j and have < 2):
            j -= 1
        elif not have:
            i += 1
        else:
            best = max(best, a + b)
            i += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on a histogram: each length, longest first, goes to the open bins
    with the least room that holds it."""
    rooms: list[int] = []
    at: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)

    def open_bins(room: int, pattern: Pattern, n: int) -> None:
        if not at[room]:
            bisect.insort(rooms, room)
        at[room].append((pattern, n))

    full: Counter = Counter()
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            i = bisect.bisect_left(rooms, x)
            if i < len(rooms):
                room = rooms[i]
                pattern, bins = at[room].pop()
                if not at[room]:
                    rooms.pop(i)
            else:
                room, pattern, bins = capacity, (), n
            k = room // x  # best fit keeps on filling the bin it has just made tighter
            m = min(bins, n // k)
            if m:
                used = [(m, k)]
                n -= m * k
            else:
                used = [(1, n)]
                n, m = 0, 1
            if bins > m and pattern:
                open_bins(room, pattern, bins - m)
            for b, times in used:
                new, left = (*pattern, (x, times)), room - times * x
                if left:
                    open_bins(left, new, b)
                else:
                    full[new] += b
    for groups in at.values():
        for pattern, n in groups:
            full[pattern] += n
    return full


def solve(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of a packing of the histogram, each with its number of bins."""
    fixed, rest = reduce_instance(counts, capacity)
    fixed.update(best_fit(rest, capacity))
    return sorted(fixed.items(), reverse=True)


class Places:
    """Where the r-th piece of a length goes: (sequence, offset), by binary search in tables
    bounded by the capacity."""

    def __init__(self, patterns: list[tuple[Pattern, int]]):
        entries: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        base, ranks = 0, Counter()
        for pattern, bins in patterns:
            offset = 0
            for length, times in pattern:
                entries[length].append((ranks[length], times, base, offset))
                ranks[length] += times * bins
                offset += times * length
            base += bins
        self.n_sequences = base
        self.tables = {k: np.array(v, np.int64) for k, v in entries.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        values, starts = np.unique(length[order], return_index=True)
        for v, rows in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
            t, r = self.tables[v], rank[rows]
            e = t[np.searchsorted(t[:, 0], r, side="right") - 1]
            q = r - e[:, 0]
            sequence[rows] = e[:, 2] + q // e[:, 1]
            offset[rows] = e[:, 3] + q % e[:, 1] * v
        return sequence, offset


def token_pieces(docs: DataFrame, capacity: int, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and the closing id, cut
    at the capacity."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(tokenizer)
        for b in batches:
            who, piece, length, crc = [], [], [], []
            for i, t in zip(column(b, "doc_id").to_pylist(), raw(b, "text"), strict=True):
                ids = words.ids(t) + end
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    who.append(i)
                    piece.append(p)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            n = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n.astype(np.int32)), pa.array(n * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096, per_bucket: int = 100_000) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of 1 to `capacity`; other columns
    pass through. Pieces of one length are ranked in buckets of about `per_bucket` rows."""
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    row, bucket, before, rank, of_length, of_bucket = fresh(pieces, "row", "bucket", "before", "rank", "of_length", "of_bucket")
    # Stored with a number for each row: nothing is computed twice, equal rows are ranked apart.
    dealt = stored(pieces.select(*own, F.monotonically_increasing_id().alias(row)), "pieces")
    counts = {r["length"]: r["n"] for r in dealt.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = Places(solve(counts, capacity))
    buckets = max(32, -(-max(counts.values(), default=0) // per_bucket))
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias(of_length), F.col(bucket).alias(of_bucket), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy("length", bucket).orderBy(row)
    ranked = (
        dealt.withColumn(rank, F.row_number().over(within))
        .join(starts, (dealt["length"] == F.col(of_length)) & (F.col(bucket) == F.col(of_bucket)))
        .select(*[dealt[c] for c in own], (F.col(rank) - 1 + F.col(before)).cast("long").alias(rank))
    )
    shape = ranked.drop(rank).withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    sent = pieces.sparkSession.sparkContext.broadcast(places)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, o = sent.value.of(column(b, "length").to_numpy(), column(b, rank).to_numpy())
            yield pa.RecordBatch.from_arrays([column(b, c) for c in own] + [pa.array(s), pa.array(o)], names=[*own, "sequence_id", "offset"])

    return ranked.mapInArrow(place, shape)


def pack_documents(docs: DataFrame, capacity: int = 4096, **how) -> DataFrame:
    """Tokenize, cut and pack documents; `pack` stores the pieces (a few numbers each, no text
    and no ids), so that no text is encoded twice."""
    return pack(token_pieces(docs, capacity, **how), capacity)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` into sequences of 4096 tokens of word_bpe_49k."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, 4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
