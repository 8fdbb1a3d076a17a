"""Stupid-backoff language-model scores from partitioned n-gram count tables.

Tokens are ids of a public tokenizer, so an n-gram of order 1, 2 or 3 is one whole number
(order, then 16 bits a token) without collisions. The counts come from the documents that are
scored, and a document is scored by the counts of all others: what it holds itself is taken off.

    S(c | a b) = n(a b c) / n(a b)      if another document holds a b c,
                 0.4 * S(c | b)         else; likewise n(b c) / n(b), and then 0.4 * n(c) / N,

and a token that no other document holds is 0.4 of one occurrence. A document's score is the sum
of the logarithms; its first token starts at order 1, its second at order 2.

A row for each pair of document and n-gram would be ten times the input on the wire. So the join
of exploded n-grams to the count tables is by blocks and partitions:

* blocks (block, doc_id, n, ids): whole documents, about BLOCK tokens together, encoded once.
* asked (block, part, grams, counts): the distinct n-grams of a block, dealt by their hash into
  partitions of the count tables, packed (sorted differences, byte planes, zstd).
* told (block, part, totals): each partition sums its counts and answers every block.
* Each block, with its answers, scores its documents.

An n-gram that every document holds is one entry a block, so no partition is hot. A partition
holds about PART entries and a block about BLOCK tokens, whatever the corpus.

Defined results: a null or empty text has no tokens, a log-probability of 0 and a null mean;
each row is a document of its own, also where ids or whole rows repeat (a repeated row finds its
n-grams in its copies); a null doc_id is an id like any other; a block is never smaller than its
longest document; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ._common import column, raw, rows_of, stored
from .tokens import VOCABULARY, word_cache

BACKOFF = 0.4
BLOCK, BLOCK_ROWS, PART = 2_000_000, 100_000, 1_500_000
#: Tokens take 16 bits; the order of an n-gram stands above the 48 bits of three.
SHIFT, ORDER = 16, 48


def pack(a: np.ndarray) -> bytes:
    """Whole numbers, the same bytes of all of them together, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").reshape(-1)


def blocks(docs: DataFrame, tokenizer: str | None = None, size: int = BLOCK) -> DataFrame:
    """(block, doc_id, n, ids): docs (doc_id, text) in blocks, with the ids of all their tokens."""
    if VOCABULARY > 1 << SHIFT:
        raise ValueError("the vocabulary does not fit the ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(tokenizer)
        at = TaskContext.get().partitionId() << 32
        who, ids, held = [], [], 0

        def block() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(ids))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([who], pa.list_(pa.int64())), pa.array([[len(x) // 2 for x in ids]], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["block", "doc_id", "n", "ids"])

        for b in batches:
            for i, t in zip(column(b, "doc_id").to_pylist(), raw(b, "text"), strict=True):
                who.append(i)
                ids.append(np.frombuffer(words.ids(t), "<u4").astype("<u2").tobytes())
                held += len(ids[-1]) // 2
                if held >= size or len(who) >= BLOCK_ROWS:
                    yield block()
                    at, who, ids, held = at + 1, [], [], 0
        if who:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, doc_id array<long>, n array<long>, ids binary")


class Grams:
    """The n-grams of a block: for each order its places in the block and the distinct n-grams with
    their counts; to score, also which of them each place holds and how often its document does.

    One stable sort of an order's n-grams tells all of it: equal ones stand together, and among
    them the places of one document, since documents follow one another in a block.
    """

    def __init__(self, ids: bytes, n: np.ndarray, to_score: bool = False):
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), "<u2").astype(np.uint64)
        d = self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.places, self.distinct, self.counts, self.which, self.own = [], [], [], [], []
        for order in range(3):
            at = np.flatnonzero(d[order:] == d[: len(d) - order]).astype(np.int32) + np.int32(order)
            g = x[at]
            for back in range(1, order + 1):
                g |= x[at - back] << np.uint64(SHIFT * back)
            tag = np.uint64(order << ORDER)
            self.places.append(at)
            if not to_score:
                u, c = np.unique(g, return_counts=True)
                self.distinct.append(u | tag)
                self.counts.append(c)
                continue
            by = np.argsort(g, kind="stable").astype(np.int32)
            g, of = g[by], d[at][by]
            fresh = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
            begins = np.flatnonzero(fresh | np.concatenate([[True], of[1:] != of[:-1]])[: len(g)])
            which, own = np.empty(len(g), np.int32), np.empty(len(g), np.int32)
            which[by] = np.cumsum(fresh, dtype=np.int32) - 1
            own[by] = np.repeat(np.diff(begins, append=len(g)), np.diff(begins, append=len(g)))
            self.distinct.append(g[fresh] | tag)
            self.counts.append(np.diff(np.flatnonzero(fresh), append=len(g)))
            self.which.append(which)
            self.own.append(own)

    def dealt(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All distinct n-grams in the order of their partitions: (place before dealing, n-gram,
        count, partition)."""
        g, c = np.concatenate(self.distinct), np.concatenate(self.counts)
        with np.errstate(over="ignore"):
            h = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
        return order, g[order], c[order], part[order]


def asked(held: DataFrame, parts: int) -> DataFrame:
    """(block, part, grams, counts): the distinct n-grams of each block, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, n, ids in zip(column(b, "block").to_pylist(), column(b, "n").to_pylist(), column(b, "ids").to_pylist(), strict=True):
                _, g, c, part = Grams(ids, np.array(n, np.int64)).dealt(parts)
                if not len(g):
                    continue
                which, start = np.unique(part, return_index=True)
                packed = [(pack(np.diff(x, prepend=np.uint64(0))), pack(y)) for x, y in zip(np.split(g, start[1:]), np.split(c, start[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), block, np.int64)), pa.array(which), pa.array([x for x, _ in packed], pa.binary()), pa.array([y for _, y in packed], pa.binary())], names=["block", "part", "grams", "counts"])

    return held.select("block", "n", "ids").mapInArrow(run, "block long, part int, grams binary, counts binary")


def totals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of the count tables: the sums of its n-grams, told to every block that asked."""
    grams = [np.cumsum(unpack(x), dtype=np.uint64) for x in rows.grams]
    _, which = np.unique(np.concatenate(grams), return_inverse=True)
    n = np.bincount(which, np.concatenate([unpack(x) for x in rows["counts"]])).astype(np.uint64)
    told = np.split(n[which], np.cumsum([len(x) for x in grams])[:-1])
    return pd.DataFrame({"block": rows.block, "part": rows.part, "totals": [pack(x) for x in told]})


def log_probs(grams: Grams, total: np.ndarray, n_docs: np.ndarray, corpus: int) -> np.ndarray:
    """The log-probability of each document of a block. `total` holds the corpus's counts of the
    block's distinct n-grams, order after order; n_docs the documents' numbers of tokens."""
    elsewhere, n = [], len(grams.doc)
    for order, t in enumerate(np.split(total.astype(np.int64), np.cumsum([len(u) for u in grams.distinct])[:-1])):
        out = np.zeros(n, np.int64)
        out[grams.places[order]] = t[grams.which[order]] - grams.own[order]
        elsewhere.append(out)
    rest = corpus - n_docs[grams.doc]
    score, tries = np.full(n, -np.log(float(max(corpus, 1)))), np.zeros(n)
    todo = np.ones(n, bool)
    for order in (2, 1, 0):
        at = grams.places[order][todo[grams.places[order]]]
        context = elsewhere[order - 1][at - 1] if order else rest[at]
        hit = elsewhere[order][at] > 0
        score[at[hit]] = np.log(elsewhere[order][at[hit]]) - np.log(context[hit])
        todo[at[hit]] = False
        tries[at[~hit]] += 1
    return np.bincount(grams.doc, score + tries * np.log(BACKOFF), len(n_docs))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(doc_id, n_tokens, mean_log_prob, log_prob) for every row of docs, by the counts of its
    other rows."""
    held = stored(blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), tokenizer, block), "blocks")
    corpus = held.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0)).alias("n")).first()["n"]
    # About two thirds of a block's tokens are distinct n-grams of it.
    parts = max(16, -(-corpus // (part * 3 // 2)))
    told = asked(held, parts).groupBy("part").applyInPandas(totals, "block long, part int, totals binary")

    def run(of: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in of.iterrows():
            n = np.asarray(row["n"], np.int64)
            grams = Grams(row["ids"], n, to_score=True)
            order, _, _, _ = grams.dealt(parts)
            total = np.zeros(len(order), np.uint64)
            if len(order):
                total[order] = np.concatenate([unpack(x) for x in answers.sort_values("part")["totals"]])
            s = log_probs(grams, total, n, corpus)
            out.append(pd.DataFrame({"doc_id": pd.array([None if i is None or i != i else int(i) for i in row["doc_id"]], "Int64"), "n_tokens": n, "s": s}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "n_tokens": [], "s": []}).astype({"doc_id": "Int64", "n_tokens": "int64", "s": "float64"})

    scored = held.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(run, "doc_id long, n_tokens long, s double")
    return scored.select("doc_id", "n_tokens", F.round(F.when(F.col("n_tokens") > 0, F.col("s") / F.col("n_tokens")), 9).alias("mean_log_prob"), F.round("s", 6).alias("log_prob"))


def op4_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, each scored by the n-grams, up to three tokens, of all others."""
    return score(rows_of(spark, sf_dir, "documents").select("doc_id", "text"))
