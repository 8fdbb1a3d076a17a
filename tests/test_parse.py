import pytest
from pyspark.sql import functions as F

from lodestrata.functions import parse


def one(spark, column, **values):
    """The value of an expression over a single row."""
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "numbers", "odd"),
    [
        ("A_b_NMW12345_left.jpg", [12345], []),
        ("A_b_NMW_12345_left.jpg", [12345], []),
        ("A_b_MNW12345.jpg", [12345], []),
        ("A_b_NMW12345-47_types.jpg", [12345, 12346, 12347], []),
        ("A_b_NMW12345-12347.jpg", [12345, 12346, 12347], []),
        ("A_b_NMW12345-NMW12347.jpg", [12345, 12346, 12347], []),
        ("d/A_b_NMW12340-42,48-50.jpg", [12340, 12341, 12342, 12348, 12349, 12350], []),
        ("A_b_NMW12345,12399.jpg", [12345, 12399], []),
        ("A_b_NMW12345_1-3_RW99.jpg", [12345], []),
        ("A_b_NMW12345(678).jpg", [12345], []),
        ("A_b_NMW54321-2222-3_RW1.jpg", [54321], ["-2222-3"]),
        ("A_b_NMW4321-10.jpg", [4321], ["-10"]),
        ("A_b_NMW12345-99999.jpg", [12345], ["-99999"]),
        ("No_number.jpg", [], []),
    ],
)
def test_catalog_numbers(spark, name, numbers, odd):
    got = one(spark, parse.catalog_numbers(F.col("n")), n=name)
    assert (got["numbers"], got["odd"]) == (numbers, odd)


@pytest.mark.parametrize(
    ("name", "catalog", "keys"),
    [
        ("A_b_NMW12345-6.jpg", "NMW12345", ["NMW12345", "NMW12346"]),
        ("A_b_MW12345.jpg", "MNW12345", ["NMW12345"]),
        ("A_b_NRM(x)12345.jpg", "NRM12345", ["NRM12345"]),
        ("A_b.jpg", "", []),
        ("A_b.jpg", None, []),
    ],
)
def test_catalog_keys(spark, name, catalog, keys):
    c = F.transform(parse.catalog_keys(F.col("n"), F.col("c").cast("string")), parse.fmt_key)
    assert one(spark, c, n=name, c=catalog) == keys


@pytest.mark.parametrize(
    ("species", "want"),
    [
        ("Salmo trutta", "Salmo trutta"),
        ("Barbus (Barbodes) dobsoni", "Barbus dobsoni"),
        ("Barbus Barbodes dobsoni", "Barbus dobsoni"),
        ("Abramis elongatus asianus", "Abramis elongatus"),
        ("Agosia nubila carringtonii(Rh osculus)", "Agosia nubila"),
        ("Tilapia adolfi-Std.1915", "Tilapia adolfi"),
        ("Coregonus sp.", ""),
        ("Garra cf. quadrimaculata", ""),
        ("Scardinius eryth. scardafa", ""),
        ("Aphyosemion g.boehmi", ""),
        ("Corydoras sp", ""),
        ("Alburnus mento=Sq.cephalus", "Alburnus mento"),
        ("Coregonus", ""),
        ("Loricaria(Rineloricaria)", ""),
        ("Ärgus öttlis", "Ärgus öttlis"),
        ("", ""),
        (None, ""),
    ],
)
def test_binomial(spark, species, want):
    assert one(spark, parse.binomial_of(F.col("s").cast("string")), s=species) == want


def test_genus_respell_conflicts(spark):
    assert one(spark, parse.genus_of(F.col("s")), s="Loricaria(Rineloricaria) lima") == "Loricaria"
    assert one(spark, parse.respell(F.col("s"), F.lit("Tetraodon")), s="Tetrodon fluviatilis") == "Tetraodon fluviatilis"
    assert one(spark, parse.conflict_names(F.col("s")), s="Rutilus (from S plotizza) (1) | Scardinius plotizza (2)") == ["Rutilus (from S plotizza)", "Scardinius plotizza"]
    assert one(spark, parse.decision_number(F.col("s")), s="d/C_g_NRM(Stockholm)66666_RW2.jpg") == "66666"
    assert one(spark, parse.decision_number(F.col("s")), s="d/C_g_56565_1-5.jpg") == "56565"


@pytest.mark.parametrize(
    ("stem", "want"),
    [
        ("Salmo_trutta_NMW12345_left", ("Salmo trutta", "Salmo_trutta", "NMW12345", "left", False, "")),
        ("A_NMW1_b_NMW2x", ("A NMW1 b", "A_NMW1_b", "NMW2", "x", False, "")),
        ("A_b_MNW12345", ("A b", "A_b", "MNW12345", "", True, "catalog_prefix_typo")),
        ("A_b_NMW_NoNumber", ("A b", "A_b", None, "NoNumber", True, "no_digits_after_prefix")),
        ("plain", (None, None, None, "plain", True, "no_catalog_anchor")),
    ],
)
def test_parse_name(spark, stem, want):
    assert tuple(one(spark, parse.parse_name(F.col("s")), s=stem)) == want


def test_views_buckets_paths(spark):
    assert one(spark, parse.view_of(F.col("s")), s="Dorsal_Head") == "head"
    assert one(spark, parse.view_of(F.col("s")), s="left") == "lateral"
    hits = [(b, n) for b in ("1", "2-3", "4+", "2+", "any") for n in range(6) if one(spark, parse.in_bucket(F.lit(b), F.lit(n)), x=1)]
    assert hits == [("1", 1), ("2-3", 2), ("2-3", 3), ("4+", 4), ("4+", 5), *[("2+", n) for n in range(2, 6)], *[("any", n) for n in range(6)]]
    assert one(spark, parse.stem(F.col("s")), s="a.b/c.d.jpg") == "c.d"
    assert one(spark, parse.domain_of(F.col("s")), s="x/y/z.jpg") == "x"
    assert one(spark, parse.is_image(F.col("s")), s="x/Y.TIFF") is True
