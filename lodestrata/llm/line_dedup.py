"""Incremental line dedup: sharded cuckoo filters over exact reference counts.

State, all of it tables in the shared folder:

* postings (k1, k2, doc_id): one row for each key and document that holds it; the exact
  reference counts are sums over them, so an insertion adds rows, a deletion takes a document's
  rows away, and either can be undone.
* refs (shard, k1, k2, n_docs, top_doc): keys at `min_docs` documents or more.
* filters (shard, n, table): one cuckoo filter per shard over the keys in refs. Sixteen-bit
  fingerprints in buckets of four slots; deletion removes a fingerprint. There are as many
  shards as keep each at about SHARD_KEYS keys, so no filter grows with the corpus.

`apply` probes the filters with every posting. A key whose fingerprint is absent is certainly no
repeated line; only the hits are joined to the exact table. While all filters together stay
within `sent_bytes` they are sent to the tasks that read the postings; beyond that the postings
are dealt to the filter of their shard, each shard in as many parts as its postings need.
A key in a third of all documents is one row of refs (partial aggregation meets it before the
shuffle), and its hits are joined by key, which AQE splits.

Defined results: null or empty text is one empty line; equal (doc_id, key) rows count once;
rows that share a doc_id are parts of one document for counting and each keeps its own text;
a null doc_id counts as one document, smaller than any other; an empty table gives no rows.
Extra columns pass through `apply` unchanged, whatever their names; the two counts, if asked
for, replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column, fresh, raw, stored

SLOTS = 4
MAX_KICKS = 500
#: Filters of more bytes than this are not sent to every task; postings are dealt to them instead.
SENT_BYTES = 64 << 20
#: Keys of one shard's filter, about; and the fewest shards.
SHARD_KEYS, LEAST_SHARDS = 50_000, 64


class CuckooFilter:
    """Partial-key cuckoo hashing over 64-bit keys; two candidate buckets of four slots."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1
            while buckets * SLOTS * 0.84 < max(capacity, 1):
                buckets *= 2
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.asarray(keys).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            h = self._mix(k)
            fp = (h >> np.uint64(48)).astype(np.uint16)
            fp[fp == 0] = 1
            a = h & self.mask
            b = self._other(a, fp)
        return fp, a.astype(np.int64), b.astype(np.int64)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (np.asarray(bucket).astype(np.uint64) ^ self._mix(np.asarray(fp).astype(np.uint64) + np.uint64(1))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when the table is full; the caller builds a larger one."""
        fp, a, b = self._places(keys)
        seed = np.random.default_rng(len(self.table))
        for f, i, j in zip(fp.tolist(), a.tolist(), b.tolist(), strict=True):
            if not (self._put(i, f) or self._put(j, f) or self._kick(i if seed.random() < 0.5 else j, f, seed)):
                return False
        return True

    def _put(self, bucket: int, fp: int) -> bool:
        row = self.table[bucket]
        for s in range(SLOTS):
            if row[s] == 0:
                row[s] = fp
                return True
        return False

    def _kick(self, bucket: int, fp: int, rng) -> bool:
        for _ in range(MAX_KICKS):
            s = int(rng.integers(SLOTS))
            fp, self.table[bucket, s] = int(self.table[bucket, s]), fp
            bucket = int(self._other(np.array([bucket]), np.array([fp]))[0])
            if self._put(bucket, fp):
                return True
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Remove one fingerprint of each key; the keys must have been inserted."""
        fp, a, b = self._places(keys)
        for f, i, j in zip(fp.tolist(), a.tolist(), b.tolist(), strict=True):
            for bucket in (i, j):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        room = len(keys)
        while not (f := cls(room)).insert(keys):
            room = room * 2 + 4
        return f

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128-bit key of a line, or None for one too short. bytes.strip() and bytes.lower() touch
    exactly the six white-space bytes and A-Z."""
    k = line.strip().lower()
    if len(k) < min_chars or len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    h = xxhash.xxh3_128_intdigest(k)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def _shard(k1: np.ndarray, shards: int) -> np.ndarray:
    return (k1.astype(np.int64).view(np.uint64) >> np.uint64(20)).astype(np.int64) % shards


def _shard_of(k1: str, shards: int):
    return (F.shiftrightunsigned(F.col(k1), 20) % F.lit(shards)).cast("int").alias("shard")


@dataclass(frozen=True)
class LineIndex:
    """An index of lines; every change returns a new one and leaves the old one usable."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    min_docs: int
    min_chars: int
    shards: int

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        rows = stored(postings(docs, min_chars, doc_id, text), "postings")
        several = docs.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
        # A row's keys are distinct; only ids that stand in several rows can repeat one.
        again = stored(several, "several")
        same = F.col("doc_id").eqNullSafe(F.col("id"))
        once = rows.join(again, same, "left_anti")
        return cls._of(once.unionByName(rows.join(again, same, "left_semi").distinct()), min_docs, min_chars)

    @classmethod
    def _of(cls, found: DataFrame, min_docs: int, min_chars: int) -> LineIndex:
        counted = stored(_refs(found, min_docs), "counted")
        shards = LEAST_SHARDS
        n = counted.count()
        while shards * SHARD_KEYS < n:
            shards *= 2
        refs = counted.select(_shard_of("k1", shards), "*")
        return cls(found, refs, stored(_filters(refs), "filters"), min_docs, min_chars, shards)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        new = postings(docs, self.min_chars, doc_id, text)
        return self._changed(stored(self.postings.unionByName(new).distinct(), "postings"))

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        gone = ids.select(F.col(doc_id).alias("gone_id")).distinct()
        left = self.postings.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
        return self._changed(stored(left, "postings"))

    def _changed(self, found: DataFrame) -> LineIndex:
        """Edit the filters by the keys that crossed the threshold, one task per shard; a shard
        without any keeps its filter as it is. An index four times too large for its shards is
        built anew with more of them."""
        refs = stored(_refs(found, self.min_docs).select(_shard_of("k1", self.shards), "*"), "refs")
        if refs.count() > 4 * self.shards * SHARD_KEYS:
            return self._of(found, self.min_docs, self.min_chars)
        on = ["shard", "k1", "k2"]
        moves = refs.join(self.refs, on, "left_anti").select("shard", "k1", F.lit(True).alias("added")).unionByName(self.refs.join(refs, on, "left_anti").select("shard", "k1", F.lit(False).alias("added")))
        counts = refs.groupBy("shard").agg(F.count("*").alias("n_now"))

        def edit(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter.from_bytes(old.table[0]) if len(old) else CuckooFilter(0)
            f.delete(new.k1[~new.added].to_numpy())
            added = new.k1[new.added].to_numpy()
            ok = f.insert(added)
            return pd.DataFrame({"shard": [key[0]], "n": [(int(old.n[0]) if len(old) else 0) + len(added) - int((~new.added).sum())], "table": [f.to_bytes() if ok else None]})

        edited = self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(edit, "shard int, n long, table binary")
        edited = stored(edited.join(counts, "shard", "left").select("shard", F.coalesce("n_now", F.lit(0)).cast("long").alias("n"), "table"), "filters")
        # A shard that outgrew its table is built anew from refs.
        again = _filters(refs.join(edited.where("table is null").select("shard"), "shard", "left_semi"))
        return replace(self, postings=found, refs=refs, filters=stored(edited.where("table is not null").unionByName(again), "filters"))

    def apply(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_dropped"), indexed: bool = False, sent_bytes: int = SENT_BYTES) -> DataFrame:
        """`docs` with repeated lines taken out: every line whose key is in refs goes, unless
        the document is the largest that holds it. `text` is the kept lines joined by a line
        feed; `counts` names two added columns, lines before and lines dropped, or is None.
        `indexed` says that the index holds exactly these rows, so that its postings serve."""
        found = self.postings if indexed else stored(postings(docs, self.min_chars, doc_id, text), "postings")
        hits = self._probed(found, sent_bytes)
        drops = (
            hits.join(self.refs.select("k1", "k2", "top_doc"), ["k1", "k2"])
            .where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
            .groupBy("doc_id")
            .agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))
        )
        id_, gone, cut = fresh(docs, "id", "gone", "cut")
        drops = stored(drops.select(F.col("doc_id").alias(id_), F.col("keys").alias(gone)), "drops")
        min_chars = self.min_chars

        @F.arrow_udf("struct<text:string,n:bigint>")
        def strip(texts: pa.Array, keys: pa.Array) -> pa.Array:
            kept, dropped = [], []
            for t, d in zip(texts.cast(pa.large_binary()).to_pylist(), keys.to_pylist(), strict=True):
                if d is None:
                    kept.append(None)
                    dropped.append(0)
                    continue
                away = {(x["k1"], x["k2"]) for x in d}
                lines = t.split(b"\n")
                stay = [x for x in lines if _key(x, min_chars) not in away]
                kept.append(b"\n".join(stay).decode())
                dropped.append(len(lines) - len(stay))
            return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(dropped, pa.int64())], names=["text", "n"])

        whole = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
        joined = whole.join(drops, whole[doc_id].cast("long").eqNullSafe(drops[id_]), "left")
        # Only texts that lose a line go through Python.
        joined = joined.withColumn(cut, strip(F.when(F.col(gone).isNotNull(), F.col(text)), F.col(gone)))
        n_lines = (F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long")
        names = dict(zip(counts or (), (n_lines, F.col(f"{cut}.n")), strict=True)) if counts else {}
        out = [F.when(F.col(gone).isNotNull(), F.col(f"{cut}.text")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns if c not in names]
        return joined.select(*out, *[v.alias(k) for k, v in names.items()])

    def _probed(self, found: DataFrame, sent_bytes: int) -> DataFrame:
        """The postings that the filters may hold."""
        total = self.filters.agg(F.coalesce(F.sum(F.octet_length("table")), F.lit(0)).alias("n")).first()["n"]
        return self._probed_at_source(found) if total <= sent_bytes else self._probed_by_shard(found)

    def _probed_at_source(self, found: DataFrame) -> DataFrame:
        sent = found.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["table"]) for r in self.filters.collect()})
        shards = self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter.from_bytes(t) for s, t in sent.value.items()}
            for b in batches:
                k = column(b, "k1").to_numpy()
                shard = _shard(k, shards)
                order = np.argsort(shard, kind="stable")
                may = np.zeros(len(k), bool)
                which, starts = np.unique(shard[order], return_index=True)
                for s, at in zip(which.tolist(), np.split(order, starts[1:]), strict=True):
                    if s in filters:
                        may[at] = filters[s].contains(k[at])
                yield b.filter(pa.array(may))

        return found.mapInArrow(probe, found.schema)

    def _probed_by_shard(self, found: DataFrame) -> DataFrame:
        """Each shard's postings meet its filter in parts of a bounded number of rows: a shard that
        holds a very frequent key has more of them."""
        dealt = found.select("*", _shard_of("k1", self.shards))
        sizes = stored(dealt.groupBy("shard").agg(F.count("*").alias("n")), "sizes")
        room = min(max(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // 256, 10_000), 500_000)
        parts = sizes.select("shard", F.ceil(F.col("n") / room).cast("int").alias("parts"))
        left = dealt.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "k2"), F.col("parts")).cast("int")).drop("parts")
        right = self.filters.join(parts, "shard").select("shard", "table", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def probe(rows: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
            if not len(tables) or not len(rows):
                return rows[:0][["k1", "k2", "doc_id"]]
            return rows[CuckooFilter.from_bytes(tables.table[0]).contains(rows.k1.to_numpy())][["k1", "k2", "doc_id"]]

        return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInPandas(probe, "k1 long, k2 long, doc_id long")


def postings(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id), once for each document row and key."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = column(b, "doc_id").to_pylist()
            k1, k2, who = [], [], []
            for i, t in zip(ids, raw(b, "text"), strict=True):
                own = {k for x in t.split(b"\n") if len(x) >= min_chars and (k := _key(x, min_chars))}
                for x, y in own:
                    k1.append(x)
                    k2.append(y)
                who.extend([i] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(who, pa.int64())], names=["k1", "k2", "doc_id"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(explode, "k1 long, k2 long, doc_id long")


def _refs(found: DataFrame, min_docs: int) -> DataFrame:
    """Keys of at least min_docs documents, with the largest. Two sums: one row for each task
    and key first, so a key that a third of the documents hold stays small."""
    return found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc")).where(F.col("n_docs") >= min_docs)


def _filters(refs: DataFrame) -> DataFrame:
    """One filter for each shard that has keys. A shard's keys are distinct: a shard is never
    hot, and more shards make each smaller."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "n": [len(rows)], "table": [CuckooFilter.of(rows.k1.to_numpy()).to_bytes()]})

    return refs.select("shard", "k1").groupBy("shard").applyInPandas(build, "shard int, n long, table binary")


def deduplicated(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, **how) -> DataFrame:
    """Index docs and take their repeated lines out in one go."""
    return LineIndex.build(docs, min_docs, min_chars).apply(docs, indexed=True, **how)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`: keys of 20 code points or more in 3 documents or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = deduplicated(docs, min_docs=3, min_chars=20)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
rep AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, (rep.k IS NOT NULL AND doc_id <> rep.top) AS gone
  FROM keyed LEFT JOIN rep ON keyed.k = rep.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
