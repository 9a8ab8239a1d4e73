"""Rasters taller than one band against plain array code, and hand cases for palettes."""

import hashlib
import math
import random
import time
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import color as cl
from mosaiq.operators import pixels as px, regions as rg, stencil as st
from mosaiq.sources import images as im


def raster(spark, arrays, image_id=1):
    h, w = next(iter(arrays.values())).shape
    rows = [(image_id, x, y, *[int(a[y, x]) for a in arrays.values()]) for y in range(h) for x in range(w)]
    names = ", ".join(f"{n} int" for n in arrays)
    return spark.createDataFrame(rows, f"image_id long, x int, y int, {names}")


def to_array(df, col, shape, dtype=float):
    out = np.zeros(shape, dtype=dtype)
    for r in df.select("x", "y", col).collect():
        out[r["y"], r["x"]] = r[col]
    return out


def flood(a, conn):
    h, w = a.shape
    out = -np.ones((h, w), dtype=np.int64)
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (conn == 8 or not (dx and dy))]
    for y in range(h):
        for x in range(w):
            if out[y, x] >= 0:
                continue
            out[y, x] = (y << 32) + x
            todo = [(x, y)]
            while todo:
                cx, cy = todo.pop()
                for dx, dy in steps:
                    nx, ny = cx + dx, cy + dy
                    if 0 <= nx < w and 0 <= ny < h and out[ny, nx] < 0 and a[ny, nx] == a[y, x]:
                        out[ny, nx] = (y << 32) + x
                        todo.append((nx, ny))
    return out


@pytest.mark.parametrize("conn", [4, 8])
def test_components_across_bands(spark, monkeypatch, conn):
    monkeypatch.setattr(rg, "RUN_BAND", 8)
    monkeypatch.setattr(rg, "EDGE_CHUNK", 5)  # forces the distributed star rounds
    a = np.random.default_rng(conn).integers(0, 2, (70, 21))
    got = to_array(rg.components(raster(spark, {"label": a}), conn=conn), "region", a.shape, np.int64)
    assert (got == flood(a, conn)).all()


def test_stars_match_union_find(spark, monkeypatch):
    monkeypatch.setattr(rg, "EDGE_CHUNK", 7)
    rnd = random.Random(3)
    edges = [(1, rnd.randrange(200), rnd.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, u, v in edges:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in rg.graph_components(spark.createDataFrame(edges, "image_id long, u long, v long")).collect()}
    assert got == {n: find(n) for _, u, v in edges for n in (u, v)}


def test_square_filters_across_bands(spark):
    a = (np.random.default_rng(1).random((150, 17)) < 0.05).astype(int)
    out = st.dilate_erode(raster(spark, {"m": a}), ["m"], 2)
    pad = lambda v: np.pad(a, 2, constant_values=v)
    win = lambda v: np.lib.stride_tricks.sliding_window_view(pad(v), (5, 5))
    assert (to_array(out, "m_dil", a.shape) == win(0).max(axis=(2, 3))).all()
    assert (to_array(out, "m_ero", a.shape) == win(1).min(axis=(2, 3))).all()


def test_ssim_across_bands(spark):
    g = np.random.default_rng(5)
    a, b = g.integers(0, 256, (140, 20)), g.integers(0, 256, (140, 20))
    w = np.array(st.gaussian_weights(1.5))

    def blur(v):
        p = np.pad(v.astype(float), 6, mode="symmetric")
        p = np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 1, p)
        return np.apply_along_axis(lambda r: np.convolve(r, w, "valid"), 0, p)

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
    c1, c2 = 2.55**2, 7.65**2
    want = (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean()
    got = st.ssim(raster(spark, {"p": a, "q": b}), "p", "q").first()["ssim"]
    assert got == pytest.approx(min(1, max(0, want)), abs=1e-9)


@pytest.mark.parametrize("band", [7, 64])
def test_boundary_offsets_bruteforce(spark, band):
    rnd = random.Random(9)
    a = {(rnd.randrange(90), rnd.randrange(90)) for _ in range(400)}
    b = {(rnd.randrange(20), rnd.randrange(20)) for _ in range(25)}
    d = [min(math.dist(p, q) for q in b) for p in a] + [min(math.dist(p, q) for q in a) for p in b]
    make = lambda s: spark.createDataFrame([(1, *p) for p in s] + [(2, 0, 0)] * (s is a), "image_id long, x int, y int")
    (r,) = rg.boundary_offsets(make(a), make(b), band=band).collect()
    assert r["chamfer_mean"] == pytest.approx(np.mean(d)) and r["hausdorff_max"] == pytest.approx(max(d))
    assert r["hausdorff_p95"] == pytest.approx(np.percentile(d, 95))


def test_boundary_offsets_of_a_far_cluster(spark):
    """Many edges far from all others: no ring of cells grows until it holds them all."""
    at = lambda x0, y0, n: spark.range(n * n).selectExpr("1L as image_id", f"cast({x0} + id % {n} as int) as x", f"cast({y0} + floor(id / {n}) as int) as y")
    start = time.time()
    r = rg.boundary_offsets(at(0, 0, 250), at(9000, 7000, 250)).first()
    assert r["hausdorff_max"] == pytest.approx(math.hypot(9000, 7000)) and time.time() - start < 60


def test_mixtures_as_every_pair_and_triple_says(spark):
    rnd = np.random.default_rng(8)
    images = {1: rnd.integers(0, 256, (6, 3)), 2: np.array([[0, 0, 0], [255, 255, 255]]), 3: np.array([[9, 9, 9]]), 4: np.array([[1, 2, 3], [1, 2, 3], [200, 10, 10], [90, 90, 90]])}
    colors = rnd.integers(0, 256, (700, 3))
    rows = [(k, i % 40, i // 40, *map(int, c)) for k in (1, 2, 3, 4, 5) for i, c in enumerate(colors)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int")
    anchors = spark.createDataFrame([(k, [tuple(map(float, c)) for c in v]) for k, v in images.items()], "image_id long, anchors array<struct<r double, g double, b double>>")

    def plain(c, points, tol=26.0):
        for i, a in enumerate(points):
            for j in range(i + 1, len(points)):
                u, w = points[j] - a, c - a
                if u @ u >= 1e-9 and 0.04 <= w @ u / (u @ u) <= 0.96 and np.linalg.norm(w - w @ u / (u @ u) * u) <= tol:
                    return True
                for q in range(j + 1, len(points)):
                    v = points[q] - a
                    det = (u @ u) * (v @ v) - (u @ v) ** 2
                    if det >= 1e-9:
                        s, t = ((v @ v) * (w @ u) - (u @ v) * (w @ v)) / det, ((u @ u) * (w @ v) - (u @ v) * (w @ u)) / det
                        if s >= -0.02 and t >= -0.02 and s + t <= 1.02 and np.linalg.norm(w - s * u - t * v) <= tol:
                            return True
        return False

    got = px.mixture_of(df, anchors).collect()
    assert len(got) == len(rows) and {r.is_mixture for r in got} == {True, False}
    for r in got:
        assert r.is_mixture == (r.image_id in images and plain(np.array([r.r, r.g, r.b], float), images[r.image_id].astype(float)))


def plain_augment(raster, energy, centers, image, max_extra, min_component, de=18.0):
    """One image, one colour after the other: the same draws, k-means and rules as plain loops."""
    h, w, _ = raster.shape
    k0, centers = len(centers), [np.array(c, float) for c in centers]
    for turn in range(3):
        if len(centers) - k0 >= max_extra:
            break
        far = np.min([((raster - c) ** 2).sum(axis=2) for c in centers], axis=0) > de * de
        flat = (np.hypot(raster[:, :, 1] - 128.0, raster[:, :, 2] - 128.0) <= 12) & (energy <= 1)
        seen, keep = np.zeros((h, w), dtype=bool), np.zeros((h, w), dtype=bool)
        for start in zip(*np.nonzero(far)):
            if seen[start]:
                continue
            seen[start], todo, cells = True, [start], []
            while todo:
                i, j = todo.pop()
                cells.append((i, j))
                for p in ((i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if 0 <= p[0] < h and 0 <= p[1] < w and far[p] and not seen[p]:
                        seen[p] = True
                        todo.append(p)
            for c in cells:
                keep[c] = len(cells) >= min_component or not flat[c]
        colors, n = np.unique(raster[keep].reshape(-1, 3), axis=0, return_counts=True)
        k = min(4, max_extra - (len(centers) - k0), len(colors))
        if keep.mean() < 0.001 or k < 1:
            break
        new = []
        for draw in range(k):
            weight = n * (np.min([((colors - c) ** 2).sum(axis=1) for c in new], axis=0) if new else 1.0)
            u = [(int(hashlib.md5(f"augment{turn}:{draw}:{image}:{':'.join(map(str, c))}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) for c in colors.tolist()]
            best = min((-math.log(x) / y, tuple(c)) for x, y, c in zip(u, weight, colors.tolist()) if y > 0)
            new.append(np.array(best[1], float))
        for _ in range(20):
            near = np.argmin([((colors - c) ** 2).sum(axis=1) for c in new], axis=0)
            moved = [(colors[near == i] * n[near == i, None]).sum(axis=0) / n[near == i].sum() for i in range(len(new)) if (near == i).any()]
            still = len(moved) == len(new) and max(np.linalg.norm(a - b) for a, b in zip(moved, new)) < 1.0
            new = moved
            if still:
                break
        centers += new
    return centers


def test_augmented_centers_as_plain_loops(spark):
    rnd = np.random.default_rng(21)
    rows, want, start = [], {}, {1: [(40, 128, 128)], 2: [(40, 128, 128), (200, 128, 128)], 3: [(100, 120, 140)]}
    for image, first in start.items():
        raster = np.full((24, 30, 3), first[0])
        raster[2:12, 3:14] = (180, 160, 100)
        raster[14:20, 2:20] = (90, 128, 129) if image != 3 else (220, 90, 200)
        raster[5:9, 20:28] = rnd.integers(0, 256, (4, 8, 3))
        raster[rnd.random((24, 30)) < 0.03] = (120, 127, 128)  # scattered grey in flat parts stays out
        energy = np.where(rnd.random((24, 30)) < 0.2, 5.0, 0.5)
        want[image] = plain_augment(raster, energy, first, image, 6, 40)
        rows += [(image, x, y, *map(int, raster[y, x]), float(energy[y, x])) for y in range(24) for x in range(30)]
    df = spark.createDataFrame(rows, "image_id long, x int, y int, l8 int, a8 int, b8 int, energy double")
    first = spark.createDataFrame([(k, [tuple(map(float, c)) for c in v]) for k, v in start.items()], "image_id long, centers array<struct<r double, g double, b double>>")
    got = {r.image_id: [(c.r, c.g, c.b) for c in r.centers] for r in rg.augment_centers(df, first, max_extra=6, min_component=40).collect()}
    assert all(len(want[k]) > len(start[k]) for k in want) and set(got) == set(want)
    for image in want:
        assert np.allclose(got[image], want[image])


def plain_topology(raster, min_area):
    def parts(mask):
        seen, out = np.zeros(mask.shape, dtype=bool), []
        for start in zip(*np.nonzero(mask)):
            if seen[start]:
                continue
            seen[start], todo, cells = True, [start], []
            while todo:
                i, j = todo.pop()
                cells.append((i, j))
                for p in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not seen[p]:
                        seen[p] = True
                        todo.append(p)
            out.append(cells)
        return out

    h, w = raster.shape
    comps = holes = 0
    for c in np.unique(raster):
        comps += sum(len(p) >= min_area for p in parts(raster == c))
        holes += sum(len(p) >= min_area and all(0 < i < h - 1 and 0 < j < w - 1 for i, j in p) for p in parts(raster != c))
    return comps, holes


@pytest.mark.parametrize("min_area", [1, 3])
def test_topology_bruteforce(spark, min_area):
    rnd = np.random.default_rng(3)
    rasters = [np.zeros((3, 4), int), np.array([[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 2, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]])]
    for classes in (2, 3, 5, 9):
        coarse = rnd.integers(0, classes, (12, 9))
        fine = np.kron(coarse, np.ones((3, 3), int))
        fine[rnd.random(fine.shape) < 0.1] = rnd.integers(0, classes)
        rasters.append(fine * 7 - 3)
    rows = [(k, x, y, int(r[y, x])) for k, r in enumerate(rasters) for y in range(r.shape[0]) for x in range(r.shape[1])]
    got = rg.topology_signature(spark.createDataFrame(rows, "image_id long, x int, y int, label int"), "label", min_area).collect()
    assert {r.image_id: (r.components, r.holes) for r in got} == {k: plain_topology(r, min_area) for k, r in enumerate(rasters)}
    assert rg.topology_signature(spark.createDataFrame([], "image_id long, x int, y int, label int")).count() == 0


def test_merge_near_colors_is_greedy_in_share_order(spark):
    rows = [(1, 10, 10, 10, 0.5), (1, 30, 10, 10, 0.3), (1, 50, 10, 10, 0.15), (1, 200, 0, 0, 0.05)]
    got = px.merge_near_colors(spark.createDataFrame(rows, "image_id long, r int, g int, b int, ratio double"), 22).orderBy("ord").collect()
    # 30 joins 10 (weighted mean 17.5 -> 18); 50 is then 32 away and stays alone
    assert [(r["r"], r["ratio"]) for r in got] == [(18, 0.8), (50, 0.15), (200, 0.05)]


def test_consolidate_palette_snaps_and_keeps_heaviest(spark):
    rows = [(1, 250, 250, 250, 9.0), (1, 248, 250, 250, 1.0), (1, 240, 20, 20, 5.0), (1, 0, 0, 90, 1.0)]
    got = px.consolidate_palette(spark.createDataFrame(rows, "image_id long, r int, g int, b int, weight double"), 2, 12.0, [(255, 255, 255), (255, 0, 0)])
    final = {(r["r"], r["g"], r["b"]): (r["fr"], r["fg"], r["fb"]) for r in got.collect()}
    assert final == {(250, 250, 250): (255, 255, 255), (248, 250, 250): (255, 255, 255), (240, 20, 20): (255, 0, 0), (0, 0, 90): (255, 0, 0)}


def test_snap_shrinking_palette_reuses_heavier_colour(spark):
    rows = [(1, 1, 1, 1, 50, 100, 100, 100), (1, 2, 2, 2, 10, 100, 100, 101), (1, 3, 3, 3, 5, 200, 0, 0)]
    df = spark.createDataFrame(rows, "image_id long, fr int, fg int, fb int, n long, r int, g int, b int")
    got = {r["fr"]: (r["r"], r["g"], r["b"]) for r in px.snap_shrinking_palette(df).collect()}
    assert got == {1: (100, 100, 100), 2: (100, 100, 100), 3: (200, 0, 0)}


def test_thin_grey_between_black_and_white_is_a_film(spark):
    a = np.full((20, 20), 255)
    a[:, 8:] = 0
    a[:, 7] = 128
    df = raster(spark, {"r": a, "g": a, "b": a})
    colors = spark.createDataFrame([(1, 0, 0, 0, 0, 0.6), (1, 1, 255, 255, 255, 0.35), (1, 2, 128, 128, 128, 0.05)], "image_id long, ord int, r int, g int, b int, ratio double")
    assert [r["ord"] for r in rg.aa_films(df, colors).collect()] == [2]
    a[:, 3:10] = 128  # a wide band survives erosion and is a real colour
    assert rg.aa_films(raster(spark, {"r": a, "g": a, "b": a}), colors).count() == 0


def test_smooth_flat_zone_keeps_structure(spark):
    a = np.full((40, 40), 100)
    a[:, 30:] = 220
    a[::2, :20] = 101
    df = raster(spark, {"l": a}).withColumn("chroma", F.lit(0.0)).withColumn("l", F.col("l").cast("double"))
    out = to_array(st.smooth_flat_zone(df, "l", "chroma", ["l"]), "l", a.shape)
    assert abs(out[20, 2] - 100.5) < 0.2 and out[20, 30] == 220 and out[20, 29] == a[20, 29]


def test_holes_by_euler(spark):
    a = np.zeros((12, 12), dtype=int)
    a[2:9, 2:9] = 1
    a[4, 4] = a[6, 6] = 0
    got = {r["region"]: r["holes"] for r in rg.holes_by_euler(rg.components(raster(spark, {"label": a}))).collect()}
    assert got[(2 << 32) + 2] == 2 and got[0] == 1


def test_kmeans_recovers_separate_colours(spark):
    a = np.zeros((10, 10), dtype=int)
    a[:, 5:] = 200
    a[0, 0], a[0, 9] = 6, 210
    c = px.kmeans_palette(raster(spark, {"r": a, "g": a, "b": a}), 2).first()["centers"]
    assert sorted(round(p["r"], 2) for p in c) == [0.12, 200.2]


def test_ciede2000_published_pairs(spark):
    # widely published test pairs of the formula
    rows = [(50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644)]
    df = spark.createDataFrame(rows, "pL double, pA double, pB double, qL double, qA double, qB double, want double")
    for r in cl.with_ciede2000(df, "p", "q", "de").collect():
        assert r["de"] == pytest.approx(r["want"], abs=1e-4)


def test_sql_functions(spark):
    cl.register_sql_functions(spark)
    assert spark.sql("SELECT round(luma601(255,255,255), 6), delta_e76(0,0,0,3,4,0)").first()[:2] == (255.0, 5.0)


def png(path, w, h, pixel):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(w)) for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images_and_pixels(spark, tmp_path):
    pixel = lambda x, y: (x * 3 % 256, y * 5 % 256, 7, 255 - x)
    png(tmp_path / "ok.png", 9, 70, pixel)
    png(tmp_path / "wide.png", 40, 2, pixel)
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 3) + b"junk")
    (tmp_path / "note.txt").write_bytes(b"hello")
    ok, rejected = im.read_images(spark, str(tmp_path), max_side=80, max_pixels=700)
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in rejected.collect()} == {"bad.png": "corrupt_image", "note.txt": "unsupported_format"}
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in im.explode_pixels(ok.where("width = 9"), band=16).collect()}
    assert len(got) == 630 and all(got[x, y] == pixel(x, y) for x in range(9) for y in range(70))
    empty = spark.createDataFrame([(bytearray(),)], "content binary")  # the file sources skip zero-byte files
    assert im.screen_uploads(empty).first()["reason"] == "corrupt_image"
    _, rejected = im.read_images(spark, str(tmp_path), max_side=30)
    assert {r["path"].rsplit("/", 1)[1] for r in rejected.where("reason = 'image_too_large'").collect()} == {"ok.png", "wide.png"}


@pytest.mark.parametrize("reach", [1.25, 1.5, 2.0, 2.5, 4.0])
def test_deep_pixels(spark, reach):
    rng = np.random.default_rng(5)
    ids = np.kron(rng.integers(0, 3, (5, 5)), np.ones((11, 11), int))
    ids[20:23, 3:40] = 7
    n = len(ids)
    rows = [(1, x, y, int(ids[y, x])) for y in range(n) for x in range(n)]
    got = {(r.x, r.y): r.deep for r in rg.deep_pixels(spark.createDataFrame(rows, "image_id int, x int, y int, region int"), "region", reach).collect()}
    near = [(dx, dy) for dx in range(-5, 6) for dy in range(-5, 6) if 1.3693 * min(abs(dx), abs(dy)) + 0.955 * abs(abs(dx) - abs(dy)) <= reach]
    for y in range(n):
        for x in range(n):
            want = all(ids[y + dy, x + dx] == ids[y, x] for dx, dy in near if 0 <= x + dx < n and 0 <= y + dy < n)
            assert got[x, y] == want
