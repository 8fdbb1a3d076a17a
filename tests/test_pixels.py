"""Relational mask operators against dense arrays."""

import numpy as np
import pytest
from test_masks import flood

from lodestrata.operators import pixels as px

H, W = 14, 17


@pytest.fixture(scope="module")
def images():
    """Images with three overlapping blobby instances each, their logits, boxes and scores."""
    rng = np.random.default_rng(11)
    out = {}
    for image in range(6):
        logits = rng.normal(-1.2, 1.0, (3, H, W))
        for k in range(3):
            y, x = rng.integers(0, H - 5), rng.integers(0, W - 6)
            logits[k, y : y + 5, x : x + 6] += 3
        boxes = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in zip(rng.uniform(-1, 9, 3), rng.uniform(-1, 7, 3), rng.uniform(1, 10, 3), rng.uniform(1, 9, 3))]
        out[image] = (logits, boxes, rng.uniform(0, 1, 3).round(2), rng.uniform(0, 1, 3) < 0.2)
    return out


@pytest.fixture(scope="module")
def t(spark, images):
    """The tables of the images: logits, pixels (above 0), boxes, sizes."""
    rows = [(i, k, y, x, float(v)) for i, (lo, _, _, _) in images.items() for (k, y, x), v in np.ndenumerate(lo)]
    logits = spark.createDataFrame(rows, "image long, instance int, y int, x int, logit double").cache()
    boxes = spark.createDataFrame([(i, k, *b, float(s[k]), bool(g[k])) for i, (_, bs, s, g) in images.items() for k, b in enumerate(bs)], "image long, instance int, x0 double, y0 double, x1 double, y1 double, score double, giant boolean").cache()
    sizes = spark.createDataFrame([(i, H, W) for i in images], "image long, h int, w int")
    return {"logits": logits, "pixels": logits.where("logit > 0").drop("logit"), "boxes": boxes, "sizes": sizes}


def dense(df):
    """{(image, instance): boolean array} of a pixel table."""
    out = {}
    for r in df.collect():
        out.setdefault((r["image"], r["instance"]), np.zeros((H, W), bool))[r["y"], r["x"]] = True
    return out


def each(images):
    return {(i, k): lo[k] > 0 for i, (lo, _, _, _) in images.items() for k in range(3)}


def same(got, want):
    want = {k: m for k, m in want.items() if m.any()}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


def gaps(mask):
    """Squared distance of every pixel to the nearest of a mask."""
    ys, xs = np.nonzero(mask)
    y, x = np.indices(mask.shape)
    return ((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(-1)


def test_iou(spark, t):
    a, b = t["pixels"], t["logits"].where("logit > 1").drop("logit")
    keys = t["boxes"].select("image", "instance").union(spark.createDataFrame([(99, 0)], "image long, instance int"))
    got = {(r["image"], r["instance"]): r["iou"] for r in px.iou(keys, a, b).collect()}
    x, y = dense(a), dense(b)
    assert got.pop((99, 0)) == 1.0
    assert got == {k: pytest.approx((x[k] & y.get(k, x[k] & ~x[k])).sum() / (x[k] | y.get(k, x[k])).sum()) for k in x}


def test_choice_and_its_ties(spark):
    rows = [(0, 0, c, 0, x, 1.0 if x < n else -1.0) for c, n in enumerate((3, 5, 5)) for x in range(6)]
    logits = spark.createDataFrame(rows, "image long, instance int, candidate int, y int, x int, logit double")
    scores = spark.createDataFrame([(0, 0, 0, 0.9), (0, 0, 1, 0.2), (0, 0, 2, 0.9)], "image long, instance int, candidate int, score double")
    one = lambda **how: tuple(px.chosen(logits, scores, **how).select("candidate", "area").first())
    assert one() == (0, 3) and one(by="largest") == (1, 5) and one(by="largest", threshold=1.0) == (0, 0)
    with pytest.raises(ValueError, match="choose"):
        px.chosen(logits, scores, by="x")


def test_box_shares(t, images):
    got = {(r["image"], r["instance"]): r for r in px.box_shares(t["pixels"], t["boxes"], t["sizes"]).collect()}
    for (i, k), m in each(images).items():
        x0, y0, x1, y1 = images[i][1][k]
        rows = [y for y in range(H) if np.floor(y0) <= y < np.ceil(y1)]
        cols = [x for x in range(W) if np.floor(x0) <= x < np.ceil(x1)]
        part = m[np.ix_(rows, cols)]
        r = got[i, k]
        assert r["area"] == m.sum() and r["outside"] == pytest.approx(1 - part.sum() / m.sum()) and r["fill"] == pytest.approx(part.mean())
        ring = [*part[0], *part[-1], *[v for row in part[1:-1] for v in (row[0], row[-1])]]
        assert r["edge"] == pytest.approx(np.mean(ring))
        h, w = part.shape
        mid = part[int(h * 0.35) : max(int(h * 0.35) + 1, int(h * 0.65)), int(w * 0.35) : max(int(w * 0.35) + 1, int(w * 0.65))]
        assert r["centre"] == pytest.approx(mid.mean()) and r["wrong_region"] == (mid.mean() < 0.25 and np.mean(ring) > 0.3)


def test_duplicates_are_seen_in_order(t, images):
    """A loop over instances by score, area and number."""
    want = set()
    for i, (lo, boxes, score, giant) in images.items():
        m, stay = lo > 0, []
        for k in sorted(range(3), key=lambda k: (-score[k], -m[k].sum(), k)):
            for j in stay if not giant[k] else []:
                if giant[j]:
                    continue
                a, b = sorted((k, j), key=lambda z: (m[z].sum(), z))
                (p, q, r, s), (c, d, e, f) = boxes[a], boxes[b]
                cover = max(0, min(r, e) - max(p, c)) * max(0, min(s, f) - max(q, d)) / ((r - p) * (s - q))
                if (m[a] & m[b]).sum() >= 0.1 * m[a].sum() and (m[a] & m[b]).any() and cover >= 0.1:
                    want.add((i, k, j))
                    break
            else:
                stay.append(k)
    got = {tuple(r) for r in px.duplicates(t["pixels"], t["boxes"], 0.1).collect()}
    assert {g[:2] for g in got} == {w[:2] for w in want} and want


def test_every_pixel_has_one_owner(t, images):
    got = {(r["image"], r["y"], r["x"]): (r["instance"], r["claims"]) for r in px.undisputed(t["pixels"], t["boxes"]).collect()}
    for i, (lo, boxes, score, _) in images.items():
        for y, x in np.ndindex(H, W):
            who = [k for k in range(3) if lo[k, y, x] > 0]
            rank = lambda k: (boxes[k][0] <= x + 0.5 <= boxes[k][2] and boxes[k][1] <= y + 0.5 <= boxes[k][3], score[k], -k)  # noqa: B023, E731
            assert got.get((i, y, x)) == ((max(who, key=rank), len(who)) if who else None)


def test_margins_and_rings(t, images):
    m = each(images)
    r = {k: max(1, round(0.3 * np.sqrt(v.sum()))) for k, v in m.items()}
    want = {k: np.zeros((H, W), bool) for k in m}
    for i in images:
        near = [(np.where(gaps(m[i, k]) <= r[i, k] ** 2, gaps(m[i, k]), 10**6), k) for k in range(3)]
        for y, x in np.argwhere(~np.any([m[i, k] for k in range(3)], axis=0)):
            d, k = min((a[y, x], k) for a, k in near)
            if d < 10**6:
                want[i, k][y, x] = True
    same(dense(px.margins(t["pixels"], t["sizes"], 0.3)), want)
    assert px.margins(t["pixels"], t["sizes"], 0.0).count() == 0
    got = {(a["image"], a["instance"]): a["uncertain"] for a in px.uncertain(t["pixels"], t["logits"], t["sizes"], -0.5).collect()}
    for (i, k), v in m.items():
        ring = (gaps(v) <= max(1, round(0.02 * np.sqrt(v.sum()))) ** 2) & ~v
        x = images[i][0][k][ring]
        assert got[i, k] == pytest.approx(((x >= -3.5) & (x <= -0.5)).mean())


def test_pieces(t, images):
    m = each(images)
    sized = {k: [labels == j for j in range(1, n + 1)] for k, v in m.items() for labels, n in [flood(v, True)]}
    join = lambda parts: np.any(parts, axis=0) if parts else np.zeros((H, W), bool)
    largest = {k: max(p.sum() for p in v) for k, v in sized.items()}
    rim = np.ones((H, W), bool)
    rim[1:-1, 1:-1] = False
    same(dense(px.drop_small(t["pixels"], 0.1)), {k: join([p for p in v if p.sum() >= 0.1 * m[k].sum() or p.sum() == largest[k]]) for k, v in sized.items()})
    same(dense(px.inner_pieces(t["pixels"], t["sizes"], 0.02)), {k: join([p for p in v if p.sum() == largest[k] or (p.sum() >= 0.02 * m[k].sum() and not (p & rim).any())]) for k, v in sized.items()})
    got = {(r["image"], r["instance"]): (r["area"], r["n_pieces"], r["border"]) for r in px.shape(t["pixels"], t["sizes"]).collect()}
    assert got == {k: (v.sum(), len(sized[k]), bool((v & rim).any())) for k, v in m.items()}
    want = {}
    for k, v in m.items():
        labels, n = flood(~v, False)
        want[k] = join([labels == j for j in range(1, n + 1) if not ((labels == j) & rim).any() and (labels == j).sum() <= 0.05 * v.sum()])
    same(dense(px.holes(t["pixels"], t["sizes"], 0.05)), want)


def drawn(spark, masks):
    """Pixels of masks drawn as lines of text, with the place of their upper left corner."""
    rows = [(image, k, y0 + y, x0 + x) for (image, k), (y0, x0, lines) in masks.items() for y, line in enumerate(lines) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "image long, instance int, y int, x int")


def test_holes_at_frames_and_borders(spark):
    ring = ["###", "#.#", "###"]
    masks = {
        (1, 0): (0, 0, ring), (1, 1): (3, 3, ring),  # in both corners of the image
        (2, 0): (1, 1, [".#.", "#.#", ".#."]),  # closed by corners alone
        (2, 1): (1, 1, [".##", "#.#", "#.."]),  # open below
        (3, 0): (-1, 2, ring), (3, 1): (1, 4, ring),  # the hole lies on the border; the rim leaves the image
        (4, 0): (0, 0, ["#####", "#...#", "####.", "#.#..", "###.."]),  # two holes, one too large
        (5, 0): (0, 0, ring),  # an image of no known size
        (6, 0): (7, 7, ring), (6, 1): (2, 2, ["#"]),
    }
    sizes = spark.createDataFrame([(i, 6, 6) for i in (1, 2, 3, 4, 6, 7)], "image long, h int, w int")
    got = {tuple(r) for r in px.holes(drawn(spark, masks), sizes, 0.25).collect()}
    assert got == {(1, 0, 1, 1), (1, 1, 4, 4), (2, 0, 2, 2), (4, 0, 1, 1), (4, 0, 1, 2), (4, 0, 1, 3), (4, 0, 3, 1)}
    got = {tuple(r) for r in px.holes(drawn(spark, masks), sizes, 0.12).collect()}
    assert got == {(4, 0, 3, 1)}


def test_holes_broadcast_nothing(spark, t):
    """A stored table of pixels is much larger than its files, so a planner that goes by these fills
    the driver with it."""
    found = px.holes(t["pixels"], t["sizes"], 0.05)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("frac", [0.12, 0.35])
def test_near_pieces(t, images, frac):
    """Dilating what stays, again and again, until it reaches no further piece."""
    want = {}
    for k, v in each(images).items():
        labels, n = flood(v, True)
        size = np.bincount(labels.ravel(), minlength=n + 1)
        top = size[1:].max()
        r = max(1, round(frac * np.sqrt(top)))
        stay = {j for j in range(1, n + 1) if size[j] >= 0.1 * top}
        while True:
            reach = np.zeros((H, W), bool)
            for y, x in np.argwhere(np.isin(labels, list(stay))):
                for dy in range(-r, r + 1):
                    dx = round(np.sqrt(r * r - dy * dy))
                    if 0 <= y + dy < H:
                        reach[y + dy, max(0, x - dx) : x + dx + 1] = True
            more = set(labels[reach].tolist()) - {0}
            if more <= stay:
                break
            stay |= more
        want[k] = np.isin(labels, list(stay))
    same(dense(px.near_pieces(t["pixels"], frac)), want)


def test_fins(t, images):
    rim = np.ones((H, W), bool)
    rim[1:-1, 1:-1] = False
    got = {(r["image"], r["instance"]): r for r in px.fins(t["pixels"], t["logits"], t["sizes"], -0.4, 0.25).collect()}
    states = set()
    for (i, k), v in each(images).items():
        labels, _ = flood(v | (images[i][0][k] > -0.4), True)
        more = np.isin(labels, np.unique(labels[v])) & (labels > 0) & ~v
        parts, n = flood(more, True)
        cut = np.isin(parts, [j for j in range(1, n + 1) if ((parts == j) & rim).any()])
        add = more & ~cut
        r = got[i, k]
        state = "guarded" if add.sum() / v.sum() > 0.25 else "extended"
        states.add(state)
        assert (r["state"], r["cut"]) == (state, cut.sum()) and r["growth"] == pytest.approx(add.sum() / v.sum())
        assert {(p["y"], p["x"]) for p in r["added"]} == (set(map(tuple, np.argwhere(add).tolist())) if state == "extended" else set())
    assert states == {"guarded", "extended"}


def test_fallback(spark):
    """A candidate that spills; one that fits; the background, whose inverse fits; and nothing."""
    fish = np.zeros((20, 20), bool)
    fish[8:12, 6:14] = True
    spill, dot = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    spill[:, :12], dot[10, 10] = True, True
    cases = {0: [spill, fish, dot], 1: [~fish, dot, dot], 2: [spill, dot, dot], 3: [fish, spill, dot]}
    rows = [(i, 0, c, int(y), int(x)) for i, cand in cases.items() for c, m in enumerate(cand) for y, x in np.argwhere(m)]
    cand = spark.createDataFrame(rows, "image long, instance int, candidate int, y int, x int")
    box = spark.createDataFrame([(i, 0, 5.0, 7.0, 15.0, 13.0, 1.0) for i in cases], "image long, instance int, x0 double, y0 double, x1 double, y1 double, score double")
    first = spark.createDataFrame([(i, 0, 0) for i in cases], "image long, instance int, candidate int")
    sizes = spark.createDataFrame([(i, 20, 20) for i in cases], "image long, h int, w int")
    got = px.fallback(cand, first, box, sizes, 0.05, (0.2, 0.95), 0.8, 0.5).collect()
    assert sorted((r["image"], r["source"], r["candidate"]) for r in got) == [(0, "candidate", 1), (1, "inverse", 0), (2, "unresolved", 0), (3, "none", 0)]


def test_deepest_and_regions(t, images):
    got = {(r["image"], r["instance"]): (r["y"], r["x"], r["d2"]) for r in px.deepest(t["pixels"], t["sizes"]).collect()}
    for k, v in each(images).items():
        d = gaps(~np.pad(v, 1))[1:-1, 1:-1]
        y, x = np.argwhere(d == d.max())[0]
        assert got[k] == (y, x, d.max())
    where = {(r["image"], r["y"], r["x"]): r["region"] for r in px.regions(t["pixels"], t["sizes"], 0.1).collect()}
    assert len(where) == len(images) * H * W and set(where.values()) == {"fish", "ring", "outer", "background"}
    m = each(images)
    for (i, y, x), name in where.items():
        assert (name == "fish") == any(m[i, k][y, x] for k in range(3))
