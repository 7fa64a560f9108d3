"""Points near other points, or in regions, on the sphere.

Sample-driven quadtree partitioning over longitude and latitude, boundary replication of the neighbour side, an R-tree
bulk-loaded (sort-tile-recursive) in each partition and probed with the other side, exact great-circle refinement. The
reference point of a pair is its left position: only the leaf that owns it reports the pair, so replication makes no
duplicates. Leaves too full for one task (many rows at one place, where splitting no longer helps) are cut into blocks of both sides, by their rows
and by the pairs that the sample finds in them.

Defined results:
* rows with a null, NaN or infinite coordinate, or a latitude beyond +-90, have no position and no pairs;
* longitudes count modulo 360; the date line and the poles need no care by the caller;
* pairs at exactly the radius count; repeated rows and ties give a pair for each row; an empty side gives no pairs;
* only the named key columns come out, under the names given; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import staged

SAMPLE = 20_000  # positions that the driver sees, at most about twice this
LEAF = 12_000  # rows of either side that one task holds, about
PAIRS = 4_000_000  # pairs that one task finds, about
PROBED = 2_000  # positions of each side from which the pairs of a leaf are estimated
FANOUT = 16


def great_circle(lat1, lon1, lat2, lon2, radius: float = 6371.0):
    """Kilometres between positions in degrees (NumPy)."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def reach(lat: np.ndarray, lon: np.ndarray, km: float, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (south, west, north, east) that hold all positions within ``km``, at most two for each, and whose they are."""
    d = km / radius * (1 + 1e-9) + 1e-12
    deg = math.degrees(d)
    south, north = np.maximum(lat - deg, -90.0), np.minimum(lat + deg, 90.0)
    with np.errstate(invalid="ignore"):
        s = math.sin(min(d, math.pi / 2)) / np.cos(np.radians(lat))
    whole = (lat + deg >= 90) | (lat - deg <= -90) | ~(s < 1) | (d >= math.pi / 2)
    half = np.where(whole, 180.0, np.degrees(np.arcsin(np.clip(np.where(whole, 0, s), 0, 1))) + 1e-9)
    west, east = np.where(whole, -180.0, lon - half), np.where(whole, 180.0, lon + half)
    own = np.arange(len(lat))
    left, right = west < -180, east > 180
    boxes = [np.c_[south, np.maximum(west, -180), north, np.minimum(east, 180)], np.c_[south, west + 360, north, np.full(len(lat), 180.0)][left], np.c_[south, np.full(len(lat), -180.0), north, east - 360][right]]
    return np.concatenate(boxes), np.concatenate([own, own[left], own[right]])


class Quadtree:
    """Leaves over [-90, 90] x [-180, 180], split until a leaf holds at most ``most`` of the sample."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, most: int, depth: int = 18):
        self.box, self.child, self.leaf = [(-90.0, -180.0, 90.0, 180.0)], [-1], [0]
        work, n_leaf = [(0, np.arange(len(lat)), 0)], 0
        while work:
            node, rows, level = work.pop()
            s, w, n, e = self.box[node]
            if len(rows) <= most or level >= depth:
                self.leaf[node], n_leaf = n_leaf, n_leaf + 1
                continue
            y, x = (s + n) / 2, (w + e) / 2
            self.child[node] = len(self.box)
            q = (lat[rows] >= y) * 2 + (lon[rows] >= x)
            for k, b in enumerate(((s, w, y, x), (s, x, y, e), (y, w, n, x), (y, x, n, e))):
                self.box.append(b)
                self.child.append(-1)
                self.leaf.append(-1)
                work.append((self.child[node] + k, rows[q == k], level + 1))
        self.box, self.child, self.leaf, self.n = np.array(self.box), np.array(self.child), np.array(self.leaf), n_leaf

    def of_points(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        node = np.zeros(len(lat), int)
        while (inner := self.child[node] >= 0).any():
            b = self.box[node[inner]]
            q = (lat[inner] >= (b[:, 0] + b[:, 2]) / 2) * 2 + (lon[inner] >= (b[:, 1] + b[:, 3]) / 2)
            node[inner] = self.child[node[inner]] + q
        return self.leaf[node]

    def of_boxes(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a box touches."""
        rows, nodes, out = np.arange(len(boxes)), np.zeros(len(boxes), int), []
        while len(rows):
            b, x = self.box[nodes], boxes[rows]
            hit = (x[:, 0] <= b[:, 2]) & (x[:, 2] >= b[:, 0]) & (x[:, 1] <= b[:, 3]) & (x[:, 3] >= b[:, 1])
            rows, nodes = rows[hit], nodes[hit]
            end = self.child[nodes] < 0
            out.append((rows[end], self.leaf[nodes[end]]))
            rows, nodes = np.repeat(rows[~end], 4), np.repeat(self.child[nodes[~end]], 4) + np.tile(np.arange(4), (~end).sum())
        return np.concatenate([a for a, _ in out] or [rows]), np.concatenate([b for _, b in out] or [nodes])


class RTree:
    """Bulk-loaded by sort-tile-recursive; levels from the root down, probed level by level for all points at once."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        strips = max(1, math.ceil(math.sqrt(n / FANOUT)))
        mid_lon, mid_lat = boxes[:, 1] + boxes[:, 3], boxes[:, 0] + boxes[:, 2]
        strip = np.empty(n, int)
        strip[np.argsort(mid_lon, kind="stable")] = np.arange(n) * strips // max(n, 1)
        self.order = np.lexsort((mid_lat, strip))
        level = boxes[self.order]
        self.levels = [level]
        while len(level) > FANOUT:
            at = np.arange(0, len(level), FANOUT)
            level = np.c_[np.minimum.reduceat(level[:, 0], at), np.minimum.reduceat(level[:, 1], at), np.maximum.reduceat(level[:, 2], at), np.maximum.reduceat(level[:, 3], at)]
            self.levels.append(level)

    def probe(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, box) of every box that holds a point."""
        point = np.repeat(np.arange(len(lat)), len(self.levels[-1]))
        node = np.tile(np.arange(len(self.levels[-1])), len(lat))
        for k in range(len(self.levels) - 1, -1, -1):
            b = self.levels[k][node]
            hit = (lat[point] >= b[:, 0]) & (lat[point] <= b[:, 2]) & (lon[point] >= b[:, 1]) & (lon[point] <= b[:, 3])
            point, node = point[hit], node[hit]
            if k:
                first = node * FANOUT
                count = np.minimum(FANOUT, len(self.levels[k - 1]) - first)
                point = np.repeat(point, count)
                start = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count)
                node = start + np.arange(len(start))
        return point, self.order[node]


def _positions(df: DataFrame, keys: list[str], lat: str, lon: str) -> DataFrame:
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    ok = ~(F.isnan(y) | F.isnan(x)) & (F.abs(y) <= 90) & (F.abs(x) < 1e9)
    return df.where(ok).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], y.alias("lat"), (F.pmod(x + 180, F.lit(360.0)) - 180).alias("lon"))


def _spread(batch: pa.RecordBatch, rows: np.ndarray, leaves: np.ndarray, own: np.ndarray, other: np.ndarray, mine_first: bool, extra: list[np.ndarray], carry: list[str] = ()) -> pa.RecordBatch:
    """Each row goes to one block of its own side, by its number, and to all blocks of the other side."""
    times = other[leaves]
    r = np.repeat(np.arange(len(rows)), times)
    k = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
    block = (np.arange(len(rows)) * 2_654_435_761 >> 7)[r] % own[leaves[r]]
    names = [f.name for f in batch.schema if f.name[0] == "k" or f.name in carry]
    keys = [batch.column(batch.schema.get_field_index(n)).take(pa.array(rows[r])) for n in names]
    pair = (block, k) if mine_first else (k, block)
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(x[r]) for x in extra], pa.array(leaves[r], pa.int32()), pa.array(pair[0], pa.int32()), pa.array(pair[1], pa.int32())], names=[*names, *[f"x{i}" for i in range(len(extra))], "leaf", "ca", "cb"])


def near_pairs(left: DataFrame, right: DataFrame, left_keys: dict[str, str], right_keys: dict[str, str], km: float, left_at: tuple[str, str] = ("lat", "lon"), right_at: tuple[str, str] = ("lat", "lon"), radius: float = 6371.0, leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """Every pair of a left and a right row at most ``km`` apart: left keys, right keys, ``km``.

    ``left_keys`` and ``right_keys`` map a column to its name in the result; ``*_at`` are (latitude, longitude) columns.
    """
    names = [*left_keys.values(), *right_keys.values(), "km"]
    if len(set(names)) < len(names):
        raise ValueError("names of the result clash")
    a, b = _positions(left, list(left_keys), *left_at), _positions(right, list(right_keys), *right_at)
    n_a, n_b = a.count(), b.count()
    draw = lambda df, n: df.select("lat", "lon").sample(min(1.0, SAMPLE / max(n, 1)), seed).toPandas().to_numpy(float).reshape(-1, 2)
    sa, sb = draw(a, n_a), draw(b, n_b)
    fa, fb = n_a / max(len(sa), 1), n_b / max(len(sb), 1)  # rows that one of the sample stands for
    both = np.concatenate([sa, sb]) if len(sa) + len(sb) else np.zeros((0, 2))
    tree = Quadtree(both[:, 0], both[:, 1], max(8, int(leaf / max(fa, fb, 1e-9)) if len(both) else 8))
    boxes, _own = reach(sb[:, 0], sb[:, 1], km, radius)
    held_a = np.bincount(tree.of_points(sa[:, 0], sa[:, 1]), minlength=tree.n) * fa
    held_b = np.bincount(tree.of_boxes(boxes)[1], minlength=tree.n) * fb
    cut_a, cut_b = np.maximum(1, np.ceil(held_a / (2 * leaf))), np.maximum(1, np.ceil(held_b / (2 * leaf)))
    some_a, some_b = sa[:: max(1, len(sa) // PROBED)], sb[:: max(1, len(sb) // PROBED)]
    if len(some_a) and len(some_b):
        some_boxes, own = reach(some_b[:, 0], some_b[:, 1], km, radius)
        p, q = RTree(some_boxes).probe(some_a[:, 0], some_a[:, 1])
        near = great_circle(some_a[p, 0], some_a[p, 1], some_b[own[q], 0], some_b[own[q], 1], radius) <= km
        found = np.bincount(tree.of_points(some_a[p[near], 0], some_a[p[near], 1]), minlength=tree.n) * (n_a / len(some_a)) * (n_b / len(some_b))
        more = np.sqrt(np.maximum(1.0, found / PAIRS / (cut_a * cut_b)))
        # a side is cut no finer than its rows
        cut_a, cut_b = np.minimum(np.ceil(cut_a * more), np.maximum(cut_a, held_a)), np.minimum(np.ceil(cut_b * more), np.maximum(cut_b, held_b))
    cut_a, cut_b = cut_a.astype(int), cut_b.astype(int)

    a_fields, b_fields = [f for f in a.schema if f.name[0] == "k"], [f for f in b.schema if f.name[0] == "k"]
    cell = [T.StructField("leaf", T.IntegerType()), T.StructField("ca", T.IntegerType()), T.StructField("cb", T.IntegerType())]

    def place_a(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
            yield _spread(batch, np.arange(len(lat)), tree.of_points(lat, lon), cut_a, cut_b, True, [lat, lon])

    def place_b(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
            boxes, own = reach(lat, lon, km, radius)
            part, leaves = tree.of_boxes(boxes)
            # two boxes of one row may touch one leaf: they stay one entry there only if they are one box
            yield _spread(batch, own[part], leaves, cut_b, cut_a, False, [lat[own[part]], lon[own[part]], *boxes[part].T])

    doubles = lambda n: [T.StructField(f"x{i}", T.DoubleType()) for i in range(n)]
    pa_rows = a.mapInArrow(place_a, T.StructType([*a_fields, *doubles(2), *cell]))
    pb_rows = b.mapInArrow(place_b, T.StructType([*b_fields, *doubles(6), *cell]))
    result = T.StructType([T.StructField(n, f.dataType) for n, f in zip([*left_keys.values(), *right_keys.values()], [*a_fields, *b_fields], strict=True)] + [T.StructField("km", T.DoubleType())])

    def probe(x: pa.Table, y: pa.Table) -> pa.Table:
        ax, by = [c for c in x.column_names if c[0] == "k"], [c for c in y.column_names if c[0] == "k"]
        lat, lon = (x.column(c).to_numpy() for c in ("x0", "x1"))
        if len(lat) and y.num_rows:
            b_lat, b_lon = (y.column(c).to_numpy() for c in ("x0", "x1"))
            rtree = RTree(np.stack([y.column(f"x{i}").to_numpy() for i in range(2, 6)], 1))
            found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
            for s in range(0, len(lat), 2048):
                p, q = rtree.probe(lat[s : s + 2048], lon[s : s + 2048])
                p = p + s
                d = great_circle(lat[p], lon[p], b_lat[q], b_lon[q], radius)
                near = d <= km
                found.append((p[near], q[near], d[near]))
            p, q, d = (np.concatenate(z) for z in zip(*found, strict=True))
        else:
            p = q = np.zeros(0, int)
            d = np.zeros(0)
        return pa.Table.from_arrays([*[x.column(c).take(pa.array(p)) for c in ax], *[y.column(c).take(pa.array(q)) for c in by], pa.array(d)], names=[f.name for f in result])

    return pa_rows.groupBy("leaf", "ca", "cb").cogroup(pb_rows.groupBy("leaf", "ca", "cb")).applyInArrow(probe, result)


def inside_ring(lat: np.ndarray, lon: np.ndarray, ring_lat: np.ndarray, ring_lon: np.ndarray) -> np.ndarray:
    """Whether positions lie in a closed ring whose edges are straight in longitude and latitude (even-odd rule; west and south edges belong to it)."""
    y0, x0 = ring_lat, ring_lon
    y1, x1 = np.roll(ring_lat, -1), np.roll(ring_lon, -1)
    hit = np.zeros(len(lat), bool)
    for s in range(0, len(y0), 256):  # long rings in stretches
        e = slice(s, s + 256)
        over = (y0[e] <= lat[:, None]) != (y1[e] <= lat[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = x0[e] + (lat[:, None] - y0[e]) / (y1[e] - y0[e]) * (x1[e] - x0[e])
        hit ^= (over & (lon[:, None] < cross)).sum(1) % 2 == 1
    return hit


def containing_regions(points: DataFrame, regions: DataFrame, point_keys: dict[str, str], region_keys: dict[str, str], at: tuple[str, str] = ("lat", "lon"), ring: str = "ring", leaf: int = LEAF, seed: int = 7) -> DataFrame:
    """Every pair of a point and a region that contains it: point keys, region keys.

    ``ring`` is an array of structs (lat, lon), closed by itself; a ring over the date line goes on past 180 degrees. Rings of fewer than three
    corners or with null corners contain nothing. The same tree, replication and R-tree as for nearby points, on the rings' boxes.
    """
    names = [*point_keys.values(), *region_keys.values()]
    if len(set(names)) < len(names):
        raise ValueError("names of the result clash")
    a = _positions(points, list(point_keys), *at)
    lats, lons = F.transform(ring, lambda c: c["lat"].cast("double")), F.transform(ring, lambda c: c["lon"].cast("double"))
    whole = (F.size(ring) >= 3) & ~F.exists(ring, lambda c: c.isNull() | c["lat"].isNull() | c["lon"].isNull())
    b = regions.where(whole).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(region_keys)], lats.alias("lats"), lons.alias("lons"))
    b = b.select("*", F.array_min("lats").alias("south"), F.array_min("lons").alias("west"), F.array_max("lats").alias("north"), F.array_max("lons").alias("east"))
    corners = ("south", "west", "north", "east")
    n_a, n_b = a.count(), b.count()
    sa = a.select("lat", "lon").sample(min(1.0, SAMPLE / max(n_a, 1)), seed).toPandas().to_numpy(float).reshape(-1, 2)
    sb = b.select(*corners).sample(min(1.0, SAMPLE / max(n_b, 1)), seed).toPandas().to_numpy(float).reshape(-1, 4)
    fa, fb = n_a / max(len(sa), 1), n_b / max(len(sb), 1)

    def parts(box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Boxes within +-180, whose they are, and how far they were moved."""
        out, own, moved = [], [], []
        for shift in (-360.0, 0.0, 360.0):
            x = box + np.array([0, shift, 0, shift])
            ok = np.flatnonzero((x[:, 1] <= 180) & (x[:, 3] >= -180))
            out.append(np.c_[x[ok, 0], np.maximum(x[ok, 1], -180), x[ok, 2], np.minimum(x[ok, 3], 180)])
            own.append(ok)
            moved.append(np.full(len(ok), shift))
        return np.concatenate(out), np.concatenate(own), np.concatenate(moved)

    tree = Quadtree(sa[:, 0], sa[:, 1], max(8, int(leaf / max(fa, 1e-9)) if len(sa) else 8))
    held_a = np.bincount(tree.of_points(sa[:, 0], sa[:, 1]), minlength=tree.n) * fa
    held_b = np.bincount(tree.of_boxes(parts(sb)[0])[1], minlength=tree.n) * fb
    cut_a, cut_b = np.maximum(1, np.ceil(held_a / (2 * leaf))).astype(int), np.maximum(1, np.ceil(held_b / (2 * leaf))).astype(int)
    a_fields, b_fields = [f for f in a.schema if f.name[0] == "k"], [f for f in b.schema if f.name[0] == "k"]
    doubles = lambda n: [T.StructField(f"x{i}", T.DoubleType()) for i in range(n)]
    cell = [T.StructField(c, T.IntegerType()) for c in ("leaf", "ca", "cb")]
    rings = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("lats", "lons")]

    def place_a(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lat", "lon"))
            yield _spread(batch, np.arange(len(lat)), tree.of_points(lat, lon), cut_a, cut_b, True, [lat, lon])

    def place_b(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes, own, moved = parts(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in corners], 1))
            part, leaves = tree.of_boxes(boxes)
            yield _spread(batch, own[part], leaves, cut_b, cut_a, False, [*boxes[part].T, moved[part]], ["lats", "lons"])

    result = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, [*a_fields, *b_fields], strict=True)])

    def probe(x: pa.Table, y: pa.Table) -> pa.Table:
        ax, by = [c for c in x.column_names if c[0] == "k"], [c for c in y.column_names if c[0] == "k"]
        found_p, found_q = [np.zeros(0, int)], [np.zeros(0, int)]
        if x.num_rows and y.num_rows:
            lat, lon = (x.column(c).to_numpy() for c in ("x0", "x1"))
            rtree = RTree(np.stack([y.column(f"x{i}").to_numpy() for i in range(4)], 1))
            moved = y.column("x4").to_numpy()
            for s in range(0, len(lat), 2048):
                p, q = rtree.probe(lat[s : s + 2048], lon[s : s + 2048])
                o = np.argsort(q, kind="stable")
                p, q = p[o] + s, q[o]
                for own in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                    if len(own):
                        r = int(q[own[0]])
                        ok = inside_ring(lat[p[own]], lon[p[own]] - moved[r], np.array(y.column("lats")[r].as_py()), np.array(y.column("lons")[r].as_py()))
                        found_p.append(p[own][ok])
                        found_q.append(q[own][ok])
        p, q = np.concatenate(found_p), np.concatenate(found_q)
        return pa.Table.from_arrays([*[x.column(c).take(pa.array(p)) for c in ax], *[y.column(c).take(pa.array(q)) for c in by]], names=names)

    left, right = a.mapInArrow(place_a, T.StructType([*a_fields, *doubles(2), *cell])), b.mapInArrow(place_b, T.StructType([*b_fields, *rings, *doubles(5), *cell]))
    return left.groupBy("leaf", "ca", "cb").cogroup(right.groupBy("leaf", "ca", "cb")).applyInArrow(probe, result)


def nearest(pairs: DataFrame, by: list[str], tie: list[str], k: int = 1) -> DataFrame:
    """Of :func:`near_pairs`, the ``k`` nearest of each left row; ties by ``tie``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("km", *tie)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_points(left: DataFrame, right: DataFrame, left_keys: dict[str, str], right_keys: dict[str, str], k: int = 1, start_km: float = 25.0, **at) -> DataFrame:
    """The ``k`` nearest right rows of each left row, however many there are of either: left keys, right keys, ``km``, ``rank``.

    A ring grows around what isn't settled yet: it is doubled until a left row has ``k`` rows in it, or the ring is the whole globe. Left rows must be
    distinct in their keys; ties go by the right keys; rows without position have no neighbours.
    """
    by, tie = list(left_keys.values()), list(right_keys.values())
    rest, km, found = left, start_km, []
    while True:
        pairs = staged(nearest(near_pairs(rest, right, left_keys, right_keys, km, **at), by, tie, k), "ring")
        full = pairs.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= k) if km < 20_100 else pairs.select(*by).distinct()
        full = staged(full.select(*by), "settled")
        found.append(pairs.join(full, by, "left_semi"))
        if km >= 20_100:
            break
        names = full.select(*[F.col(n).alias(c) for c, n in left_keys.items()])
        rest = staged(rest.join(names, list(left_keys), "left_anti"), "open")
        if rest.isEmpty():
            break
        km = min(2 * km, 20_100.0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
