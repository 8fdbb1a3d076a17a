"""Names, catalogue numbers and small rules, as Column expressions.

All of them are native expressions: they stay inside whole-stage code or at least in the JVM.
Java's character classes are ASCII unless (?U) is set, which these patterns set where Unicode
letters count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the file-name format.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
OPEN_NOMENCLATURE = ("sp", "spp", "cf", "aff")
VIEWS = ("head", "dorsal", "ventral")
DEFAULT_VIEW = "lateral"


@dataclass(frozen=True)
class CatalogFormat:
    """How catalogue numbers stand in file names: an anchor `_<prefix>`, then digits."""

    prefixes: tuple[str, ...] = ("NMW", "MNW")
    canonical: str = "NMW"
    max_range: int = 200
    min_digits: int = 4
    foreign: str = r"MW|NRM(?:\([^)]*\))?"

    @property
    def any_prefix(self) -> str:
        return "|".join(self.prefixes)


CATALOG = CatalogFormat()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?s)^(.+)\.[^.]*$", "$1")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"[^/]\.(" + "|".join(IMAGE_SUFFIXES) + ")$")


def domain_of(path: Column) -> Column:
    """The first folder of a relative path; empty for a file that lies in none."""
    return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0]).otherwise(F.lit(""))


def parse_name(name: Column, fmt: CatalogFormat = CATALOG) -> Column:
    """struct(species, species_raw, catalog_number, extra, needs_review, review_reason) of a stem.

    The last anchor splits the stem. Without an anchor, or without digits behind it, the row is
    kept and marked for review with the reason.
    """
    anchor = rf"^(.+)_({fmt.any_prefix})(.*)$"
    part = lambda i: F.regexp_extract(name, anchor, i)
    found = name.rlike(anchor)
    rest = F.ltrim(part(3), F.lit("_"))
    digits = F.regexp_extract(rest, r"^(\d+)", 1)
    has_number = digits != ""
    none = F.lit(None).cast("string")
    species = F.trim(F.replace(part(1), F.lit("_"), F.lit(" ")))
    typo = part(2) != fmt.canonical
    return F.struct(
        F.when(found, species).alias("species"),
        F.when(found, part(1)).alias("species_raw"),
        F.when(found & has_number, F.concat(part(2), digits)).otherwise(none).alias("catalog_number"),
        F.when(~found, name).when(has_number, F.ltrim(F.regexp_extract(rest, r"^\d+(.*)$", 1), F.lit("_"))).otherwise(rest).alias("extra"),
        (~found | ~has_number | typo).alias("needs_review"),
        F.when(~found, "no_catalog_anchor").when(~has_number, "no_digits_after_prefix").when(typo, "catalog_prefix_typo").otherwise("").alias("review_reason"),
    )


def catalog_numbers(path: Column, fmt: CatalogFormat = CATALOG) -> Column:
    """struct(numbers array<bigint>, odd array<string>) of a file name.

    The first anchor counts. Behind its number come items: `,n` adds n, `-n` adds the range up to
    n. A shorter n replaces the last digits of the number before it. A range that goes backwards
    or is longer than max_range is odd and ends the reading.
    """
    item = rf"([-,])(?:{fmt.any_prefix})?(\d+)"
    head = rf"_(?:{fmt.any_prefix})_?(\d+)((?:[-,](?:{fmt.any_prefix})?\d+)*)"
    s = stem(path)
    first = F.regexp_extract(s, head, 1)
    tail = F.regexp_extract(s, head, 2)
    start = F.struct(
        first.cast("bigint").alias("prev"),
        F.array(first.cast("bigint")).alias("numbers"),
        F.array().cast("array<string>").alias("odd"),
    )

    def step(acc: Column, text: Column) -> Column:
        sep, digits = F.regexp_extract(text, item, 1), F.regexp_extract(text, item, 2)
        prev = acc["prev"].cast("string")
        short = F.length(digits) < F.length(prev)
        n = F.when(short, F.concat(prev.substr(F.lit(1), F.length(prev) - F.length(digits)), digits)).otherwise(digits).cast("bigint")
        forward = (n > acc["prev"]) & (n <= acc["prev"] + fmt.max_range)
        # sequence() is evaluated for every row that reaches it: keep it short and rising
        run = F.sequence(acc["prev"], F.when(forward, n).otherwise(acc["prev"]))
        go = F.size(acc["odd"]) == 0
        return F.struct(
            F.when(go & ((sep == ",") | forward), n).otherwise(acc["prev"]).alias("prev"),
            F.when(go & (sep == ","), F.array_append(acc["numbers"], n)).when(go & forward, F.concat(acc["numbers"], run)).otherwise(acc["numbers"]).alias("numbers"),
            F.when(go & (sep == "-") & ~forward, F.array(tail)).otherwise(acc["odd"]).alias("odd"),
        )

    done = F.aggregate(F.regexp_extract_all(tail, F.lit(item), 0), start, step, lambda a: F.struct(F.array_sort(F.array_distinct(a["numbers"])).alias("numbers"), a["odd"].alias("odd")))
    empty = F.struct(F.array().cast("array<bigint>").alias("numbers"), F.array().cast("array<string>").alias("odd"))
    return F.when(first != "", done).otherwise(empty)


def catalog_keys(path: Column, catalog_number: Column, fmt: CatalogFormat = CATALOG) -> Column:
    """array<struct(ns, num, id)>: the numbers of the file name, else of a catalogue number that
    a decision set. A misspelt prefix means the canonical museum."""
    numbers = catalog_numbers(path, fmt)["numbers"]
    ns, num = F.regexp_extract(catalog_number, r"^([A-Z]+)(\d+)$", 1), F.regexp_extract(catalog_number, r"^([A-Z]+)(\d+)$", 2)
    museum = F.when(ns.isin(*fmt.prefixes), fmt.canonical).otherwise(ns)
    none = F.lit(None).cast("string")
    return F.when(F.size(numbers) > 0, F.transform(numbers, lambda n: F.struct(F.lit(fmt.canonical).alias("ns"), n.alias("num"), none.alias("id")))).when(
        F.coalesce(ns, F.lit("")) != "", F.array(F.struct(museum.alias("ns"), num.cast("bigint").alias("num"), none.alias("id")))
    ).otherwise(F.array().cast("array<struct<ns:string,num:bigint,id:string>>"))


def specimen_keys(path: Column, catalog_number: Column, specimen_id: Column | None = None, fmt: CatalogFormat = CATALOG) -> Column:
    """Keys from a column of one's own labels, else from the catalogue."""
    if specimen_id is None:
        return catalog_keys(path, catalog_number, fmt)
    key = F.struct(F.lit("id").alias("ns"), F.lit(None).cast("bigint").alias("num"), specimen_id.alias("id"))
    return F.when(F.coalesce(specimen_id, F.lit("")) != "", F.array(key)).otherwise(F.array().cast("array<struct<ns:string,num:bigint,id:string>>"))


def fmt_key(key: Column) -> Column:
    return F.when(key["ns"] == "id", key["id"]).otherwise(F.concat(key["ns"], key["num"].cast("string")))


def decision_number(path: Column, fmt: CatalogFormat = CATALOG) -> Column:
    """The number that `<number>` in a decision stands for: the first run of four digits or more
    behind an underscore and perhaps a museum's prefix; empty if there is none."""
    return F.regexp_extract(stem(path), rf"_(?:{fmt.any_prefix}|{fmt.foreign})?_?(\d{{{fmt.min_digits},}})", 1)


def genus_of(species: Column) -> Column:
    return F.regexp_extract(F.coalesce(species, F.lit("")), r"^[^\s(]+", 0)


def binomial_of(species: Column) -> Column:
    """Genus and the first lower-case epithet; empty for open nomenclature, an abbreviated
    epithet or a genus alone. Capitalised words in between are subgenera or places."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(species, F.lit("")), r"\([^)]*\)", " "), r"(?U)\s+"), lambda w: w != "")
    upper = lambda w: (F.substring(w, 1, 1) == F.upper(F.substring(w, 1, 1))) & (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)))
    word = F.get(F.filter(F.slice(words, 2, 1_000_000), lambda w: ~upper(w)), 0)
    letters = F.regexp_extract(word, r"^[\p{L}\p{Nl}\p{No}]+", 0)
    bad = word.isNull() | (letters == "") | (F.substr(word, F.length(letters) + 1, F.lit(1)) == ".") | (letters != F.lower(letters)) | (letters == F.upper(letters)) | letters.isin(*OPEN_NOMENCLATURE)
    return F.when(bad, "").otherwise(F.concat_ws(" ", F.get(words, 0), letters))


DERIVED_CLASSES = {"genus": genus_of, "binomial": binomial_of}


def class_of(name: str, species: str = "species") -> Column:
    """A class derived from the species, or a label column as written."""
    return DERIVED_CLASSES[name](F.col(species)) if name in DERIVED_CLASSES else F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def respell(species: Column, to_genus: Column) -> Column:
    """The species with its genus replaced, where to_genus is not null."""
    return F.when(to_genus.isNotNull(), F.concat(to_genus, F.substr(species, F.length(genus_of(species)) + 1))).otherwise(species)


def conflict_names(cell: Column) -> Column:
    """Names of a cell like "A b (1) | C d (2)": only the count at the end goes."""
    return F.transform(F.split(cell, r" \| "), lambda x: F.regexp_replace(F.trim(x), r"\s*\(\d+\)$", ""))


def view_of(extra: Column) -> Column:
    """The first of the known views that a text names, else the default one."""
    out = None
    for v in VIEWS:
        hit = F.contains(F.lower(extra), F.lit(v))
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(DEFAULT_VIEW)


def in_bucket(bucket: Column, n: Column) -> Column:
    """Whether a count lies in a bucket: `any`, `3`, `2-3` or `4+`."""
    low = F.regexp_extract(bucket, r"^(\d+)", 1).cast("int")
    high = F.when(bucket.endswith("+"), F.lit(2**31 - 1)).when(bucket.contains("-"), F.regexp_extract(bucket, r"-(\d+)$", 1).cast("int")).otherwise(low)
    return (bucket == "any") | n.between(low, high)


def list_hash(names: Column) -> Column:
    """SHA-256 of the sorted names, joined by line feeds; `names` is an array."""
    return F.sha2(F.array_join(F.array_sort(names), "\n"), 256)
