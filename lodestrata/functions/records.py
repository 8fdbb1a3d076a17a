"""Rules over segmentation records: a record has a status, a size and an array of instances.

Older records lack later fields; every rule reads a missing field as "did not fire".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_D, _L, _I, _S, _B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()

INSTANCE = T.StructType(
    [
        T.StructField("segmentation", T.ArrayType(T.ArrayType(_D))),
        T.StructField("bbox", T.ArrayType(_D)),
        T.StructField("area", _D),
        T.StructField("det_box", T.ArrayType(_D)),
        T.StructField("det_score", _D),
        T.StructField("sam_iou_scores", T.ArrayType(_D)),
        T.StructField("sam_mask_index", _I),
        T.StructField("flags", T.ArrayType(_S)),
        T.StructField("sam_candidate_areas", T.ArrayType(_L)),
        T.StructField("area_ratio_largest_to_chosen", _D),
        T.StructField("edge_uncertain_frac", _D),
        T.StructField("touches_border", _B),
        T.StructField("n_components", _I),
        T.StructField("margin_px", _I),
        T.StructField("sam_outside_box_frac", _D),
        T.StructField("outside_box_frac", _D),
        T.StructField("bleed_fallback", _S),
        T.StructField("wrong_region", _S),
        T.StructField("box_center_cover", _D),
        T.StructField("box_edge_frac", _D),
        T.StructField("far_pieces_dropped", _I),
        T.StructField("holes_filled_px", _I),
        T.StructField("fin_extension", _S),
        T.StructField("fin_growth", _D),
        T.StructField("fin_border_px", _I),
    ]
)
DUPLICATE = T.StructType([T.StructField("det_box", T.ArrayType(_D)), T.StructField("det_score", _D), T.StructField("duplicate_of", _I)])
QA = T.StructType(
    [
        T.StructField("flags", T.ArrayType(_S)),
        T.StructField("n_detections", _I),
        T.StructField("empty_dropped", _I),
        T.StructField("wrong_region_dropped", _I),
        T.StructField("duplicates_removed", T.ArrayType(DUPLICATE)),
        T.StructField("contested_frac", _D),
    ]
)
RECORD = T.StructType(
    [
        T.StructField("file_name", _S),
        T.StructField("status", _S),
        T.StructField("reason", _S),
        T.StructField("width", _I),
        T.StructField("height", _I),
        T.StructField("qa", QA),
        T.StructField("instances", T.ArrayType(INSTANCE)),
    ]
)

#: Which values of a field count as a rule that fired, and the limits of rule B.
FALLBACKS = ("candidate", "inverse", "unresolved")
WRONG_REGIONS = ("reprompt", "unresolved")
RULE_B = {"outside_box_frac": 0.02, "edge_uncertain_frac": 0.5}
RULE_B_FALLBACKS = ("inverse", "unresolved")


def coverage(width: Column, height: Column, instances: Column) -> Column:
    """Share of the image that the instances cover together."""
    area = F.aggregate(instances, F.lit(0.0), lambda s, i: s + i["area"])
    return area / (width.cast("double") * height.cast("double"))


def is_suspect(width: Column, height: Column, instances: Column, max_cover: float = 0.7) -> Column:
    """Covers more than the limit and touches the border."""
    border = F.exists(instances, lambda i: F.coalesce(i["touches_border"], F.lit(False)))
    return (coverage(width, height, instances) > max_cover) & border


def _tags(*pairs: tuple[Column, Column | str]) -> Column:
    """Names whose condition holds, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n) if isinstance(n, str) else n) for c, n in pairs]))


def rules_fired(instances: Column, qa: Column) -> Column:
    """Sorted names of the rules that fired in a record."""

    def of(i: Column) -> Column:
        return _tags(
            (i["bleed_fallback"].isin(*FALLBACKS), F.concat(F.lit("bleed_"), i["bleed_fallback"])),
            (i["wrong_region"].isin(*WRONG_REGIONS), F.concat(F.lit("wrong_region_"), i["wrong_region"])),
            (i["far_pieces_dropped"] > 0, "far_pieces_dropped"),
            (i["holes_filled_px"] > 0, "holes_filled"),
            ((i["fin_extension"] == "extended") & (i["fin_growth"] > 0), "fin_extended"),
            (i["fin_extension"] == "guarded", "fin_guarded"),
        )

    found = F.flatten(F.transform(F.coalesce(instances, F.array()), of))
    return F.array_sort(F.array_distinct(F.concat(found, _tags((qa["wrong_region_dropped"] > 0, "wrong_region_dropped")))))


def rule_b(status: Column, instances: Column) -> Column:
    """Reason why rule B drops an ok record, or null."""

    def of(i: Column) -> Column:
        return _tags(
            (i["outside_box_frac"] > RULE_B["outside_box_frac"], "outside_box"),
            (i["bleed_fallback"].isin(*RULE_B_FALLBACKS), i["bleed_fallback"]),
            (i["edge_uncertain_frac"] > RULE_B["edge_uncertain_frac"], "edge_uncertain"),
        )

    why = F.array_sort(F.array_distinct(F.flatten(F.transform(instances, of))))
    return F.when((status == "ok") & (F.size(why) > 0), F.concat(F.lit("qa_rule_B: "), F.array_join(why, ",")))


def size_flags(area_frac: Column, tiny: float, giant: float) -> Column:
    return _tags((area_frac < tiny, "tiny"), (area_frac > giant, "giant"))


def image_flags(instances: Column, *image_level: tuple[Column, str]) -> Column:
    """Sorted union of the instances' flags, then the image's own in the order given."""
    own = F.array_sort(F.array_distinct(F.flatten(F.transform(instances, lambda i: F.coalesce(i["flags"], F.array().cast("array<string>"))))))
    return F.concat(own, _tags(*image_level)) if image_level else own


def scale_box(box: Column, sx: Column, sy: Column) -> Column:
    """Corners times the scale, to one decimal, half to even."""
    return F.transform(box, lambda v, i: F.bround(v * F.when(i % 2 == 0, sx).otherwise(sy), 1))


def box_containment(inner: Column, outer: Column) -> Column:
    """Share of a box's area that lies in another (x0, y0, x1, y1)."""
    w = F.least(inner[2], outer[2]) - F.greatest(inner[0], outer[0])
    h = F.least(inner[3], outer[3]) - F.greatest(inner[1], outer[1])
    area = (inner[2] - inner[0]) * (inner[3] - inner[1])
    return F.when(area > 0, F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / area).otherwise(0.0)
