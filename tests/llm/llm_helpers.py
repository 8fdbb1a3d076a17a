"""What the tests of this folder share."""

import duckdb

#: Every row the contracts name: nulls, empty and blank texts, ties, repeats, odd characters.
HOSTILE = [
    (1, None), (2, ""), (3, "   \t\n \x0b"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"), (None, None),
    (6, "ÄÖÜ ß İstanbul ſ  x y 😀 é"), (7, "a\x00b \x1c \x85 end"), (8, "<|endoftext|> text <|startoftext|>"), (9, "\n\n\n"),
    (10, "idiot! " * 3), (2**62, "big id " * 10), (-5, "negative id " * 10),
]


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def oracle(sf_dir, sql):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str)


def collected(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
