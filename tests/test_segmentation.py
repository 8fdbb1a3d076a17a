import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.stats import accepted
from lodestrata.operators import curate, review
from lodestrata.plans import curation, segmentation
from lodestrata.sources import sinks
from lodestrata.sources.tables import InputError


def test_from_logits_to_records(spark):
    """Two fish, a double of one of them, a bleeding candidate, an empty detection; and an image
    without any."""
    h, w = 24, 40
    a, b = np.zeros((h, w)), np.zeros((h, w))
    a[5:11, 4:16], b[12:20, 20:34] = 1, 1
    a[7, 8] = 0  # a hole
    a[20, 2] = 1  # a far piece
    spill = np.ones((h, w))
    cand = {0: [a, a * 0, a * 0], 1: [b, spill, b * 0], 2: [a * (np.indices((h, w))[1] < 14), a * 0, a * 0], 3: [a * 0, a * 0, a * 0]}
    boxes = {0: (4, 5, 16, 11), 1: (19, 11, 35, 21), 2: (4, 5, 14, 11), 3: (1, 1, 3, 3)}
    rated = {0: [0.9, 0.1, 0.1], 1: [0.2, 0.9, 0.1], 2: [0.9, 0.1, 0.1], 3: [0.9, 0.1, 0.1]}
    rows = [(7, i, c, y, x, 2.0 if m[y, x] else -9.0) for i, ms in cand.items() for c, m in enumerate(ms) for y in range(h) for x in range(w)]
    candidates = spark.createDataFrame(rows, "image long, instance int, candidate int, y int, x int, logit double")
    detections = spark.createDataFrame([(7, i, *map(float, box), s, False) for (i, box), s in zip(boxes.items(), (0.9, 0.8, 0.7, 0.6))], "image long, instance int, x0 double, y0 double, x1 double, y1 double, score double, giant boolean")
    ratings = spark.createDataFrame([(7, i, c, s) for i, ss in rated.items() for c, s in enumerate(ss)], "image long, instance int, candidate int, score double")
    sizes = spark.createDataFrame([(7, h, w), (8, h, w)], "image long, h int, w int")
    how = segmentation.Options(bleed=0.1, near=0.1, hole=0.05, margin=0.1)
    records, pixels = segmentation.segmented(detections, candidates, ratings, sizes, how)
    got = {r["image"]: r for r in records.collect()}
    assert (got[8]["status"], got[8]["reason"], got[8]["instances"]) == ("skipped", "no_detection", None)
    r = got[7]
    assert (r["status"], r["width"], r["height"], r["n_detections"], r["empty_dropped"], r["duplicates_removed"]) == ("ok", w, h, 4, 1, 1)
    one, two = r["instances"]
    assert (one["instance"], one["fallback"], one["far_px"], one["hole_px"], one["n_pieces"]) == (0, "none", 1, 1, 1)
    assert (two["instance"], two["fallback"], two["candidate"], two["bbox"]) == (1, "candidate", 0, [19, 11, 16, 10])
    assert not one["touches_border"] and one["margin_px"] == 1 and one["area"] == 12 * 6 + 2 * (12 + 6)
    assert pixels.groupBy("image", "y", "x").count().where("count > 1").isEmpty()


def test_selection_and_review_lists(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_name string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert sorted(r["file_name"] for r in curate.select_images(files, names("c", "a", "a")).collect()) == ["a", "c"]
    with pytest.raises(InputError, match="without a file: z"):
        curate.select_images(files, names("a", "z"))
    rows = [("a", "a.png", "ok", ["x"]), ("b", "b.png", "ok", []), ("c", "c.png", "skipped", []), ("d", "d.png", "ok", [])]
    records = spark.createDataFrame(rows, "file_name string, overlay string, status string, flags array<string>")
    shown = lambda *a, **k: sorted(r["file_name"] for r in review.reviewable(records, names("a.png", "b.png", "c.png"), *a, **k).collect())
    assert shown() == ["a", "b"] and shown(names("b.png", "a")) == ["a", "b"] and shown(names("b")) == ["b"] and shown(flagged_only=True) == ["a"]


def test_counts(spark):
    d = spark.createDataFrame([("s1", "p", None), ("s1", "x", "q"), ("s2", "p", "q")], "specimen string, domain string, reason string")
    assert sorted(map(tuple, curate.images_per_domain(d, ["p", "x"]).collect())) == [("s1", 1, 1, 2), ("s2", 1, 0, 1)]
    assert sorted(map(tuple, curate.value_counts(d, ["domain", "reason"]).collect()), key=str) == sorted([("domain", "p", 2), ("domain", "x", 1), ("reason", None, 1), ("reason", "q", 2)], key=str)
    judged = spark.createDataFrame([("A", "f", "fix", ["a", "b", "a"]), ("A", "g", "ok", []), ("B", "f", "drop", ["b"])], "run string, file_name string, verdict string, categories array<string>")
    items = spark.createDataFrame([("A",), ("A",), ("A",), ("C",)], "run string")
    got = {r["run"]: r for r in review.run_summary(judged, items, categories="categories").collect()}
    assert (got["A"]["items"], got["A"]["judged"], got["A"]["categories"]) == (3, 2, {"a": 1, "b": 1}) and got["C"]["categories"] == {}
    assert accepted(F.lit(1), F.lit(10), "0.10") is not None


def test_provenance_refusals(spark, tmp_path):
    sinks.check_split({"labels_hash": "h", "segmented": "run"}, "h", "run")
    with pytest.raises(InputError, match="labels_hash"):
        sinks.check_split({"labels_hash": "h", "segmented": "run"}, "g", "run")
    sinks.check_merge(spark, str(tmp_path / "new"), "patch", [])
    for args in ((str(tmp_path), "patch", []), (str(tmp_path / "new"), None, [])):
        with pytest.raises(InputError):
            sinks.check_merge(spark, *args)
    saved = sinks.check_categories(None, ["a", "b"])
    assert sinks.check_categories(saved, ["a", "b"]) == saved
    with pytest.raises(InputError, match="begun with"):
        sinks.check_categories(saved, ["b", "a"])


def test_running_the_steps():
    seen = []
    actions = {s: (lambda done, s=s: seen.append((s, sorted(done))) or s.upper()) for s in ("labels", "split", "manifest")}
    needs = {"split": ["labels"], "manifest": ["split"]}
    assert curation.run(["manifest", "labels", "split"], actions, needs=needs) == {"labels": "LABELS", "split": "SPLIT", "manifest": "MANIFEST"}
    assert seen == [("labels", []), ("split", ["labels"]), ("manifest", ["labels", "split"])]
    for steps, why in ((["manifest"], "needs split"), (["labels", "merge"], "no action")):
        with pytest.raises(InputError, match=why):
            curation.run(steps, actions, needs=needs)
    assert curation.run(["merge"], {}, exists={"merge"}) == {}
