"""Region-level spatial statistics. Coordinates are of region centroids only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from math import cos, log, pi, radians, sin, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import EARTH_KM, bearing, haversine_km, normal_cdf
from .graph import connected_components, cut
from .sizes import sent


def adjacency(regions: DataFrame, min_km: float = 0.01, max_km: float = 30.0) -> DataFrame:
    """(a, b, km, weight, bearing) for every ordered pair of regions within reach; the dimension is small."""
    a, b = regions.alias("a"), regions.alias("b")
    c = [F.col(x) for x in ("a.lat", "a.lon", "b.lat", "b.lon")]
    p = a.join(b, F.col("a.region") != F.col("b.region")).select(F.col("a.region").alias("a"), F.col("b.region").alias("b"), haversine_km(*c).alias("km"), bearing(*c).alias("bearing"))
    return p.where(F.col("km").between(min_km, max_km)).withColumn("weight", 1 / F.col("km"))


#: Points of a cube that meet its neighbours in one piece; pairs that are looked at in one task, about.
PIECE, PAIRS = 256, 1 << 26


def near_points(points: DataFrame, eps_km: float) -> DataFrame:
    """(a, b, lat, lon, lat2, lon2) of points (id, lat, lon) within eps, with their coordinates.

    Points are put on the unit sphere and dealt to cubes as wide as the chord of eps, so they meet those of their own and the 26 neighbouring
    cubes only, at every latitude and across the date line. Cubes of many points are cut into pieces, which are spread over as many tasks as there are pairs to look at, so no task gets a whole place.
    """
    step = 2 * sin(min(eps_km / EARTH_KM, pi) / 2) + 1e-12
    lat, lon = F.radians("lat"), F.radians("lon")
    xyz = {"cx": F.cos(lat) * F.cos(lon), "cy": F.cos(lat) * F.sin(lon), "cz": F.sin(lat)}
    at, around = list(xyz), list(product((-1, 0, 1), repeat=3))
    p = points.select("id", "lat", "lon", *[F.floor(v / step).alias(c) for c, v in xyz.items()])
    cubes = cut(p.groupBy(*at).agg(F.count(F.lit(1)).alias("held"), F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")))
    looked = stepped(cubes.select(*at, F.col("held").alias("by")), around).join(cubes, at).agg(F.sum(F.col("by") * F.col("held"))).first()[0] or 0
    tasks = max(p.sparkSession.sparkContext.defaultParallelism, min(10_000, looked // PAIRS))
    pieces = sent(cubes.select(*at, "pieces"))
    p = p.join(pieces, at).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    q = stepped(points.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *[F.floor(v / step).alias(c) for c, v in xyz.items()]), around)
    q = q.join(pieces, at).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    j = p.repartition(tasks, *at, "piece").join(q.repartition(tasks, *at, "piece"), [*at, "piece"]).where("id <> b")
    return j.where(haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= eps_km).select(F.col("id").alias("a"), "b", "lat", "lon", "lat2", "lon2")


def near_pairs(points: DataFrame, eps_km: float) -> DataFrame:
    """(a, b) of points (id, lat, lon) within eps; see near_points()."""
    return near_points(points, eps_km).select("a", "b")


def small_cubes(points: DataFrame, eps_km: float) -> DataFrame:
    """points (id, lat, lon) with the cube (cx, cy, cz) of each: cubes so small that all points of one are within eps."""
    side = 2 * sin(min(eps_km / EARTH_KM, pi) / 2) / sqrt(3) * (1 - 1e-9)
    lat, lon = F.radians("lat"), F.radians("lon")
    xyz = {"cx": F.cos(lat) * F.cos(lon), "cy": F.cos(lat) * F.sin(lon), "cz": F.sin(lat)}
    return points.select("id", "lat", "lon", *[F.floor(v / side).alias(c) for c, v in xyz.items()])


#: Steps to the cubes that can hold a point within eps of one in a small cube; and half of them, so that of two cubes one meets the other.
STEPS = list(product((-2, -1, 0, 1, 2), repeat=3))
AFTER = [d for d in STEPS if d > (0, 0, 0)]
#: Cores of each of two cubes that are tried first.
PROBES = 64


def stepped(df: DataFrame, steps: list[tuple[int, int, int]]) -> DataFrame:
    """df once for each step from its cube."""
    to = F.explode(F.array(*[F.struct(*[(F.col(c) + F.lit(k)).alias(c) for c, k in zip(("cx", "cy", "cz"), d, strict=True)]) for d in steps]))
    rest = [c for c in df.columns if c not in ("cx", "cy", "cz")]
    return df.select(*rest, to.alias("to")).select(*rest, "to.*")


def dbscan(points: DataFrame, eps_km: float, min_points: int) -> DataFrame:
    """(id, group): density groups; points with enough neighbours (themselves included) are cores, cores within eps are one group, others join their smallest core; noise is -1.

    No list of all near pairs is made: points of one small cube are all near each other, so those of cubes with enough points are cores and in one group, and only points of other cubes count their neighbours. Cubes are linked
    by the first of their cores within eps: a few of each are tried, and all of them only for cubes that are in different groups after that.
    """
    at = ["cx", "cy", "cz"]
    p = cut(small_cubes(points.where("id is not null and lat is not null and lon is not null").dropDuplicates(["id"]), eps_km))
    n = p.groupBy(*at).agg(F.count(F.lit(1)).alias("held"))
    near = lambda: haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= eps_km
    other = lambda df, *more: df.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), *at, *more)
    sparse = p.join(n.where(F.col("held") < min_points), at, "left_semi")
    counts = stepped(sparse, STEPS).join(other(p), at).where("id <> b").where(near()).groupBy("id").agg((F.count(F.lit(1)) + 1).alias("n"))
    core = p.join(n.where(F.col("held") >= min_points), at, "left_semi").unionByName(sparse.join(counts.where(F.col("n") >= min_points), "id", "left_semi") if min_points > 1 else sparse.where("1 = 0"))
    # A core's cube is named by its smallest core.
    named = cut(core.groupBy(*at).agg(F.min("id").alias("cube")))
    core = cut(core.join(named, at))
    beside = stepped(named, AFTER).withColumnRenamed("cube", "a").join(named.withColumnRenamed("cube", "c"), at).select("a", "c")
    rank = F.row_number().over(Window.partitionBy("cube").orderBy(F.xxhash64("id"), "id"))
    probes = cut(core.withColumn("k", rank).where(F.col("k") <= PROBES).select("cube", "id", "lat", "lon"))
    side = lambda df, name, more: df.select(F.col("cube").alias(name), F.col("id").alias(f"id{more}"), F.col("lat").alias(f"lat{more}"), F.col("lon").alias(f"lon{more}"))
    linked = lambda pairs, df: pairs.join(side(df, "a", ""), "a").join(side(df, "c", "2"), "c").where(near()).select("a", F.col("c").alias("b")).distinct()
    sure = cut(linked(beside, probes))
    cubes = named.select(F.col("cube").alias("id"))
    groups = connected_components(cubes, sure)
    of = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"in_{c}"))
    apart = cut(beside.join(of("a"), "a").join(of("c"), "c").where("in_a <> in_c").select("a", "c"))
    if not apart.isEmpty():
        groups = connected_components(cubes, sure.unionByName(linked(apart, core)))
    core = cut(core.join(groups.withColumnRenamed("id", "cube"), "cube").select("id", "lat", "lon", *at, "component"))
    rest = sparse.join(core.select("id"), "id", "left_anti")
    border = stepped(rest, STEPS).join(other(core, "component"), at).where(near()).groupBy("id").agg(F.min("component").alias("near"))
    out = points.select("id").join(core.select("id", "component"), "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("component", "near", F.lit(-1).cast(points.schema["id"].dataType)).alias("group"))


#: Kernel values below this share of the peak are left out: a point reaches no farther.
LEAST_KERNEL = 1e-13


@dataclass(frozen=True)
class Grid:
    """n x n grid points over a box of latitudes and longitudes, ends included."""

    n: int
    south: float
    north: float
    west: float
    east: float

    def place(self, i: Column, j: Column) -> tuple[Column, Column]:
        """Latitude and longitude of grid points."""
        return F.lit(self.south) + (self.north - self.south) * i / (self.n - 1), F.lit(self.west) + (self.east - self.west) * j / (self.n - 1)


def scattered(points: DataFrame, grid: Grid, cov: tuple[float, float, float]) -> DataFrame:
    """(i, j, density): Gaussian kernel sums of weighted points (lat, lon, weight) on a grid, as shares of the highest; zero where no point reaches.

    cov: the kernel's covariance (lat lat, lat lon, lon lon), positive definite. Points at one place are one; each is dealt to the grid points within its kernel's reach only, so the work is points times what
    one point covers.
    """
    yy, yx, xx = cov
    det = yy * xx - yx * yx
    reach = sqrt(-2 * log(LEAST_KERNEL))
    p = points.groupBy("lat", "lon").agg(F.sum("weight").alias("weight"))
    span = lambda v, low, high, r: (
        F.greatest(F.ceil((v - r - low) * (grid.n - 1) / (high - low)), F.lit(0)), F.least(F.floor((v + r - low) * (grid.n - 1) / (high - low)), F.lit(grid.n - 1)),
    )
    i1, i2 = span(F.col("lat"), grid.south, grid.north, reach * sqrt(yy))
    j1, j2 = span(F.col("lon"), grid.west, grid.east, reach * sqrt(xx))
    p = p.select("lat", "lon", "weight", i1.alias("i1"), i2.alias("i2"), j1.alias("j1"), j2.alias("j2")).where("i1 <= i2 and j1 <= j2")
    p = p.select("lat", "lon", "weight", "j1", "j2", F.explode(F.sequence("i1", "i2")).alias("i")).select("lat", "lon", "weight", "i", F.explode(F.sequence("j1", "j2")).alias("j"))
    y, x = grid.place(F.col("i"), F.col("j"))
    dy, dx = y - F.col("lat"), x - F.col("lon")
    k = p.groupBy("i", "j").agg(F.sum(F.col("weight") * F.exp(-(xx * dy * dy - 2 * yx * dy * dx + yy * dx * dx) / (2 * det))).alias("k"))
    cells = points.sparkSession.range(grid.n * grid.n).select((F.col("id") / grid.n).cast("long").alias("i"), (F.col("id") % grid.n).alias("j"))
    k = cells.join(k, ["i", "j"], "left").select("i", "j", F.coalesce("k", F.lit(0.0)).alias("k"))
    top = k.agg(F.max("k")).first()[0] or 1.0
    return k.select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.col("k") / F.lit(top)).alias("density"))


def kde_grid(points: DataFrame, n: int, bandwidth: float, box: tuple[float, float, float, float]) -> DataFrame:
    """(i, j, density): kernel sums of one width in both directions, on an n x n grid over the box (south, north, west, east), as shares of the highest."""
    return scattered(points, Grid(n, *box), (bandwidth**2, 0.0, bandwidth**2))


def kde_cells(points: DataFrame, n: int, least: float = 0.01, pad_m: float = 1000.0) -> DataFrame:
    """(i, j, density, ring): cells of at least this density, with their outlines (lon, lat) as closed rings, of a kernel density with the points' own weighted covariance.

    The kernel's covariance is that of the points (lat, lon, weight), times Scott's factor squared (effective number of points to the power -1/6); the grid spans the points and a margin on all sides.
    A cell begins at south + i * height, where n heights span the box. Points on one line, or fewer than two places, have no covariance to whiten by: no cells. One row of sums comes to the driver.
    """
    w = F.col("weight")
    places = points.where("weight > 0 and lat is not null and lon is not null").groupBy("lat", "lon").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    s = places.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.sum("weight").alias("w"), F.sum("w2").alias("w2"), F.sum(w * F.col("lat")).alias("y"), F.sum(w * F.col("lon")).alias("x")).first()
    none = points.sparkSession.createDataFrame([], "i int, j int, density double, ring array<array<double>>")
    if not s["w"]:
        return none
    my, mx, share2 = s["y"] / s["w"], s["x"] / s["w"], s["w2"] / s["w"] ** 2
    dy, dx = F.col("lat") - my, F.col("lon") - mx
    c = places.agg(*[F.sum(w * a * b).alias(k) for k, a, b in (("yy", dy, dy), ("yx", dy, dx), ("xx", dx, dx))]).first()
    if share2 >= 1 or c["yy"] * c["xx"] - c["yx"] ** 2 <= 1e-12 * c["yy"] * c["xx"]:
        return none
    scale = share2 ** (1 / 3) / (s["w"] * (1 - share2))
    up, side = pad_m / 110_574.0, pad_m / (111_320.0 * cos(radians(my)))
    grid = Grid(n, s["south"] - up, s["north"] + up, s["west"] - side, s["east"] + side)
    height, width = (grid.north - grid.south) / n, (grid.east - grid.west) / n
    got = scattered(places, grid, (c["yy"] * scale, c["yx"] * scale, c["xx"] * scale)).where((F.col("density") >= least) & (F.col("i") < n - 1) & (F.col("j") < n - 1))
    corner = lambda a, b: F.array(F.lit(grid.west) + (F.col("j") + b) * width, F.lit(grid.south) + (F.col("i") + a) * height)
    return got.select("i", "j", "density", F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0)).alias("ring"))


def getis_ord(points: DataFrame, band_km: float) -> DataFrame:
    """(id, z, p): Gi* of weights (id, lat, lon, w) with binary neighbours within the band, itself included; nothing where weights are constant."""
    pairs = near_pairs(points, band_km).join(points.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    local = pairs.groupBy(F.col("a").alias("id")).agg(F.sum("wb").alias("s"), F.count(F.lit(1)).alias("k"))
    stats = points.agg(F.avg("w").alias("m"), F.stddev_pop("w").alias("sd"), F.count(F.lit(1)).alias("n"))
    j = points.join(local, "id", "left").fillna({"s": 0.0, "k": 0}).join(F.broadcast(stats), F.lit(True)).where("sd > 0 and n > 1")
    k, s = F.col("k") + 1, F.col("s") + F.col("w")
    z = (s - F.col("m") * k) / (F.col("sd") * F.sqrt((F.col("n") * k - k * k) / (F.col("n") - 1)))
    return j.where(F.col("k") + 1 < F.col("n")).select("id", z.alias("z"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p"))


def circle(lat: Column, lon: Column, km: float, n: int) -> Column:
    """Points of a circle, closed, as (lon, lat)."""
    angle = lambda k: F.lit(2 * 3.141592653589793) * k / n
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.array(lon + km / (111.32 * F.cos(F.radians(lat))) * F.cos(angle(k % n)), lat + km / 110.574 * F.sin(angle(k % n))))
