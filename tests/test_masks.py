import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from lodestrata.functions import masks as M

masks = hnp.arrays(bool, st.tuples(st.integers(1, 9), st.integers(1, 9)))


def flood(mask, corners):
    """Pieces by flooding from each pixel in reading order."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i or not j]
    return out, n


@given(masks, st.booleans())
@settings(max_examples=300, deadline=None)
def test_labels_are_connected_pieces(m, corners):
    labels, n = M.label(m, corners)
    want, k = flood(m, corners)
    assert n == k and (labels == want).all()


@given(masks)
@settings(max_examples=50, deadline=None)
def test_packing_round_trip(m):
    assert (M.unpack(**M.pack(m)) == m).all()


def test_columns(spark):
    m = np.zeros((4, 5), bool)
    m[0, :2] = m[3, 4] = True
    df = spark.createDataFrame([(7, 1, M.pack(m)), (8, 2, None)], f"image long, instance int, mask {M.PACKED}")
    assert sorted(map(tuple, M.pixels_of(df).collect())) == [(7, 1, 0, 0), (7, 1, 0, 1), (7, 1, 3, 4)]
    r = df.where("mask is not null").select(M.shape_udf("mask").alias("s")).select("s.*").first()
    assert tuple(r) == (3, 2)
