"""The curation pipeline: labels, segmentation, merge, split, manifest.

Each step is a function of DataFrames; the steps' order is fixed. `plan` reports what would run
and what is missing before anything does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import curate, decisions, split
from ..sources.tables import InputError, refuse

STEPS = ("labels", "segment", "merge", "split", "manifest")


@dataclass(frozen=True)
class Config:
    """What a run needs: names of the domains, of the class, and the split's settings."""

    name: str
    domains: tuple[str, ...]
    class_name: str = "genus"
    seed: int | str = 0
    val_frac: float = 0.15
    test_frac: float = 0.15
    min_specimens: int = 5
    options: dict = field(default_factory=dict)
    domain_options: dict = field(default_factory=dict)

    def segment_options(self, domain: str) -> dict:
        """Options of a domain: the common ones overlaid with its own."""
        return {**self.options, **self.domain_options.get(domain, {})}

    @classmethod
    def of(cls, cfg: dict) -> Config:
        s = cfg.get("split") or {}
        domains = cfg.get("domains") or {}
        return cls(cfg["name"], tuple(domains), s.get("class", "genus"), s.get("seed", 0), s.get("val_frac", 0.15), s.get("test_frac", 0.15), s.get("min_specimens", 5), dict(cfg.get("segment") or {}), {d: dict((v or {}).get("segment") or {}) for d, v in domains.items()})


def flags(options: dict) -> list[str]:
    """Options as command-line flags; true switches, false and None are left out."""
    out = []
    for k, v in options.items():
        if v is None or v is False:
            continue
        out.append("--" + k.replace("_", "-"))
        if v is not True:
            out += [str(x) for x in (v if isinstance(v, (list, tuple)) else [v])]
    return out


def plan(steps: list[str], present: set[str], needs: dict[str, list[str]], exists: set[str]) -> list[tuple[str, str]]:
    """(step, why it is skipped or "") in the fixed order; refuses unknown steps and lists every
    missing input before anything runs. A step's output counts for the steps behind it."""
    unknown = [s for s in steps if s not in STEPS]
    if unknown:
        raise InputError(f"unknown step(s): {', '.join(unknown)}")
    have, out, missing = set(present), [], []
    for s in STEPS:
        if s not in steps:
            continue
        if s == "merge" and "merge" in exists:
            out.append((s, "its output exists"))
        else:
            missing += [f"{s} needs {n}" for n in needs.get(s, []) if n not in have]
            out.append((s, ""))
        have.add(s)
    if missing:
        raise InputError("; ".join(missing))
    return out


def run(steps: list[str], actions: dict[str, Callable[[dict], object]], present: set[str] = frozenset(), needs: dict[str, list[str]] | None = None, exists: set[str] = frozenset()) -> dict[str, object]:
    """Carry out the steps in their fixed order: each action gets the results so far and gives its
    own. Nothing runs before `plan` has found every input; a step that is left out because its
    output exists has no result."""
    todo = plan(steps, set(present), needs or {}, set(exists))
    if lacking := [s for s, why in todo if not why and s not in actions]:
        raise InputError(f"no action for {', '.join(lacking)}")
    done: dict[str, object] = {}
    for step, why in todo:
        if not why:
            done[step] = actions[step](dict(done))
    return done


def labels_from_names(files: DataFrame) -> DataFrame:
    """Label rows of (file_name, sha256): the name's parts, marked where they need a review."""
    p = parse.parse_name(parse.stem(F.col("file_name")))
    rows = files.select("file_name", "sha256", parse.domain_of(F.col("file_name")).alias("photo_type"), p.alias("p"))
    return decisions.start(rows.select("file_name", "sha256", "photo_type", "p.*"))


def decided_labels(rows: DataFrame, spelling: DataFrame | None = None, conflicts: DataFrame | None = None, review: DataFrame | None = None) -> DataFrame:
    """The sheets in their fixed order, then one of each set of copies."""
    if spelling is not None:
        rows = decisions.genus_spelling(rows, spelling)
    if conflicts is not None:
        rows = decisions.catalog_conflicts(rows, conflicts)
    if review is not None:
        rows = decisions.needs_review(rows, review)
    return decisions.finish(decisions.keep_one_copy(rows, decisions.named_as_parsed()))


def own_label_rows(labels: DataFrame, files: DataFrame, specimen: str = "none") -> DataFrame:
    """Rows of one's own labels (file_name, columns) with hash, domain and specimen_id."""
    rows = curate.match_labels(labels, files).join(files.select("file_name", "sha256"), "file_name")
    rows = rows.withColumn("photo_type", parse.domain_of(F.col("file_name")))
    rows = rows.withColumnRenamed(specimen, "specimen_id") if specimen != "none" else rows.withColumn("specimen_id", F.lit(""))
    return decisions.start(rows)


@dataclass(frozen=True)
class Split:
    images: DataFrame
    groups: DataFrame
    balance: DataFrame
    no_key: DataFrame
    no_class: DataFrame


def split_images(labels: DataFrame, status: DataFrame, cfg: Config, keys: Column | None = None) -> Split:
    """Specimen groups over all usable images with a key, then the split over those with a class.

    labels: file_name, photo_type, sha256, label_drop, species or the class column; status:
    file_name, status, reason, n_instances. Group ids do not depend on the class.
    """
    refuse(labels.join(status, "file_name", "left_anti"), "file_name", "labelled image(s) without a segmentation status")
    usable = labels.join(status.where("status = 'ok'").select("file_name"), "file_name").where("coalesce(label_drop, '') = ''")
    keyed = usable.withColumn("keys", keys if keys is not None else parse.catalog_keys(F.col("file_name"), F.col("catalog_number"))).withColumn("class", parse.class_of(cfg.class_name))
    groups = split.entity_groups(keyed)
    rows = keyed.join(groups, "file_name")
    no_key = keyed.where(F.size("keys") == 0).select("file_name")
    no_class = rows.where("class = ''").select("file_name")
    rows = rows.where("class <> ''")
    majority = rows.groupBy("specimen", "class").agg(F.count("*").alias("n")).groupBy("specimen").agg(F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("class"))
    members = rows.groupBy("specimen").agg(F.array_sort(F.collect_set("photo_type")).alias("domains"))
    splits = split.split_classes(majority.join(members, "specimen"), list(cfg.domains), cfg.seed, cfg.val_frac, cfg.test_frac, cfg.min_specimens)
    cells = splits.select("class", F.explode("evaluated").alias("domain")).distinct()
    own = rows.withColumnRenamed("class", "own_class").join(splits.select("specimen", "class", "split"), "specimen")
    # the flag goes by the row's own class, the split by its group's
    own = own.join(cells.select(F.col("class").alias("c"), F.col("domain").alias("d"), F.lit(True).alias("e")), (F.col("own_class") == F.col("c")) & (F.col("photo_type") == F.col("d")), "left")
    images = own.select("file_name", "photo_type", "specimen", "class", "split", F.coalesce("e", F.lit(False)).alias("evaluated"))
    return Split(images, splits, split.balance(images, ["photo_type", "class"]), no_key, no_class)


def manifest(labels: DataFrame, status: DataFrame, images: DataFrame, cfg: Config, masks: str = "masks", keys: Column | None = None, no_key: str = "no catalog number") -> DataFrame:
    """One row for every labelled image, usable or not, with its status and the reason."""
    key = keys if keys is not None else parse.catalog_keys(F.col("file_name"), F.col("catalog_number"))
    s = images.select(F.col("file_name").alias("f"), "specimen", "split", "evaluated")
    j = labels.join(status.select(F.col("file_name").alias("g"), "status", "reason", "n_instances"), F.col("file_name") == F.col("g")).join(s, F.col("file_name") == F.col("f"), "left")
    state = curate.manifest_state(F.col("status"), F.col("reason"), F.col("label_drop"), F.col("f").isNotNull(), F.size(key) > 0, no_key, f"no {cfg.class_name}")
    j = j.withColumn("m", state)
    usable = F.col("m.status") == "usable"
    mask = F.concat_ws("/", F.col("photo_type"), F.lit(masks), F.concat(parse.stem(F.col("file_name")), F.lit(".png")))
    return j.select(
        "file_name", "sha256", F.col("photo_type").alias("domain"), parse.class_of(cfg.class_name).alias(cfg.class_name),
        F.coalesce("specimen", F.lit("")).alias("specimen"), F.when(usable, mask).otherwise("").alias("mask_path"), F.when(usable, F.col("n_instances")).alias("n_instances"),
        "m.status", "m.reason", F.coalesce("split", F.lit("none")).alias("split"), F.coalesce("evaluated", F.lit(False)).alias(f"{cfg.class_name}_evaluated"),
    )
