"""Writers: CSV, records, COCO, review exports and provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from .tables import InputError


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, doubled quotes, empty strings for nulls and `True` / `False`."""
    cols = [F.initcap(F.col(f"`{c}`").cast("string")).alias(c) if t == "boolean" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).csv(path, header=True, escape='"', emptyValue="", nullValue="")


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; null fields are left out. A task's file appears when the task commits, so a
    crash leaves no half line."""
    df.write.mode(mode).json(path)


def resume(todo: DataFrame, done: DataFrame | None, key: str = "file_name") -> DataFrame:
    """What a run that stopped still has to do."""
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")


def coco(records: DataFrame, category: str = "object") -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations and categories. Ids count from 1: images in the order of their names,
    annotations in that order and then by instance. A prefix sum over ranges of names gives the
    ids; no task sorts all images."""
    rows = records.where("status = 'ok'").select("file_name", "width", "height", F.size("instances").alias("k"), "instances")
    ranged = stored(rows.repartitionByRange("file_name").withColumn("part", F.spark_partition_id()), "coco")
    sums = ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum("k").alias("m"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("m0"))
    w = Window.partitionBy("part").orderBy("file_name")
    numbered = ranged.join(F.broadcast(sums), "part").withColumns({
        "id": F.row_number().over(w) + F.col("n0"),
        "first": F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("m0"),
    })
    images = numbered.select("id", "file_name", "width", "height")
    inst = numbered.select(F.col("id").alias("image_id"), "first", F.posexplode("instances").alias("instance_index", "i"))
    annotations = inst.select((F.col("first") + F.col("instance_index") + 1).alias("id"), "image_id", "instance_index", F.lit(1).alias("category_id"), "i.segmentation", "i.bbox", "i.area", F.lit(0).alias("iscrowd"))
    categories = records.sparkSession.createDataFrame([(1, category)], "id int, name string")
    return images, annotations, categories


def review_lines(rows: DataFrame, columns: list[str], comments: list[str]) -> list[str]:
    """Lines of a review export: comments, a header, tab-separated rows. A review is small."""
    out = [f"# {c}" for c in comments] + ["\t".join(columns)]
    for r in rows.select(*columns).collect():
        out.append("\t".join("" if v is None else ";".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for v in r))
    return out


# --- provenance -------------------------------------------------------------------------------


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_sidecar(spark: SparkSession, path: str, config: dict) -> None:
    """A run's settings and input hashes as one JSON file, in any store that Spark reaches."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(json.dumps(config, indent=1, sort_keys=True, ensure_ascii=False).encode())
    out.close()


def read_sidecar(spark: SparkSession, path: str) -> dict | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def check_resume(saved: dict | None, settings: dict, defaults: dict | None = None) -> None:
    """Refuse to go on with other settings than a run began with. Settings that an older run did
    not know had the value of `defaults`."""
    if saved is None:
        return
    old = {**(defaults or {}), **saved.get("settings", {})}
    differ = sorted(k for k in {*old, *settings} if old.get(k) != settings.get(k))
    if differ:
        raise InputError("settings changed since the run began: " + ", ".join(f"{k} {old.get(k)!r} -> {settings.get(k)!r}" for k in differ))


def merged_settings(config: dict) -> dict:
    """Settings of a run; of a merged one, the base's overlaid with the patch's."""
    if "merged" in config:
        return {**config["base_config"]["settings"], **((config.get("patch_config") or {}).get("settings") or {})}
    return config.get("settings", {})


def input_hash(df: DataFrame) -> str:
    """One digest of a table's rows, whatever their order: counts and sums of row hashes."""
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("a"), F.sum(F.hash(*cols).cast("decimal(38,0)")).alias("b")).first()
    return f"{r['n']}:{r['a'] or 0}:{r['b'] or 0}"


def check_split(split: dict, labels: str, segmented: str) -> None:
    """Refuse a split that was made from other labels or for another run of segmentation than those
    at hand: it carries the hash of the one and the name of the other."""
    now = {"labels_hash": labels, "segmented": segmented}
    if differ := [k for k, v in now.items() if split.get(k) != v]:
        raise InputError("the split was made with another " + ", ".join(f"{k} ({split.get(k)!r}, now {now[k]!r})" for k in differ))


def check_merge(spark: SparkSession, out: str, patch: str | None, drops: list[str]) -> None:
    """Refuse a merge over an output that exists, and one that would change nothing."""
    p, fs = _path(spark, out)
    if fs.exists(p):
        raise InputError(f"{out} exists; a merge writes to a new folder")
    if patch is None and not drops:
        raise InputError("nothing to merge: give a patch run or a list of drops")


def check_categories(saved: dict | None, names: list[str]) -> dict:
    """The binding of a review to its categories, to be saved; refuses a review begun with others,
    since its decisions mean what they meant then."""
    if saved is not None and saved.get("categories") != names:
        raise InputError(f"the review was begun with the categories {saved.get('categories')}, not {names}")
    return {"categories": names}
