"""Queries over whole tables, one for each operator, and the DuckDB SQL that gives the same rows.

Clouds: all vectors of `embeddings`; the nations by their customers (25 points of a 3-space, so that triangles and
tetrahedra can be listed); the mean vectors of the labels. Pairs of the image queries come from `part`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distances import Distance, euclidean, manhattan, rounded
from .functions.influence import Gaussian
from .operators import filtration as fl
from .operators import incidence as inc
from .operators.cns import CombinatorialNumberSystem
from .operators.homology import compute_persistent_homology, pairs_of_dim0, persistence_of, spanning_forest
from .operators.image import finite_points, gaussian_image, persistence_image, resolve_bounds
from .operators.nearest import nearest_forest
from .plans.model import BoundsConfig, is_finite, is_infinite, persistence
from .plans.session import passing_folder
from .sources import clouds

#: Distances are rounded, so that ties are the same in both engines.
DISTANCE = rounded(euclidean("float64"), 6)
THRESHOLD, NATION_THRESHOLD = 1.25, 1.5
N_NATIONS = 25
BOUNDS = BoundsConfig(0.0, 6.0, 0.0, 3.0)
PIXELS = 20


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.points_table(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding", "vec_id")


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's number of customers in tens, and their mean and largest balance in thousands."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg((F.count("*").cast("double") / 10).alias("x"), (F.sum(cents).cast("double") / F.count("*") / 100000).alias("y"), (F.max(cents).cast("double") / 100000).alias("z"))
    return fl.points_table(rows.select("c_nationkey", F.array("x", "y", "z").alias("coords")), "coords", "c_nationkey")


def label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"])
    return fl.points_table(rows.groupBy("label").agg(mean.alias("coords")), "coords", "label")


def axis_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three octahedra: of coordinates 1-3, 4-6 and 7-9 of every vector, in millionths, the mean of the vectors whose
    largest coordinate is the same and of one sign, brought to length one. Ids are by octahedron, axis and sign."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    whole = F.transform(F.slice("embedding", 1, 9), lambda x: F.round(x.cast("double") * 1000000).cast("long"))
    thirds = F.array(*(F.struct(F.lit(k).alias("third"), *(F.get("whole", F.lit(3 * k + j)).alias(c) for j, c in enumerate("xyz"))) for k in range(3)))
    rows = rows.select(whole.alias("whole")).select(F.inline(thirds))
    largest = F.greatest(*(F.abs(c) for c in "xyz"))
    axis = F.when(F.abs("x") == largest, 0).when(F.abs("y") == largest, 1).otherwise(2)
    sign = F.when(axis == 0, F.col("x")).when(axis == 1, F.col("y")).otherwise(F.col("z")) > 0
    sums = rows.groupBy("third", axis.alias("axis"), sign.alias("sign")).agg(*(F.sum(c).cast("double").alias(c) for c in "xyz"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    coords = F.array(F.col("x") / length + 4 * F.col("third"), F.col("y") / length, F.col("z") / length)
    place = F.col("third") * 6 + F.col("axis") * 2 + F.col("sign").cast("int")
    return fl.points_table(sums.select(place.alias("place"), coords.alias("coords")), "coords", "place")


def nation_edges(spark: SparkSession, sf_dir: str, threshold: float | None = None, distance: Distance = DISTANCE) -> DataFrame:
    return fl.edges(nation_points(spark, sf_dir), threshold, distance, "float64")


def pairwise_distance(spark, d):
    return fl.edges(vector_points(spark, d), None, DISTANCE, "float64")


def edges_threshold(spark, d):
    return fl.edges(vector_points(spark, d), THRESHOLD, DISTANCE, "float64")


def enclosing_radius(spark, d):
    return spark.createDataFrame([(fl.enclosing_radius(vector_points(spark, d), DISTANCE, "float64"),)], "radius double")


def custom_distance_manhattan(spark, d):
    return fl.pairwise(nation_points(spark, d), rounded(manhattan(), 6))


def triangles(spark, d):
    return fl.simplices(nation_edges(spark, d), 2)


def tetrahedra(spark, d):
    return fl.simplices(nation_edges(spark, d), 3)


def triangles_threshold(spark, d):
    return fl.simplices(nation_edges(spark, d, NATION_THRESHOLD), 2)


def simplex_decode(spark, d):
    """Indices back to vertices."""

    def decode(it):
        system = CombinatorialNumberSystem(N_NATIONS, 3)
        for pdf in it:
            own = system.decode_all(pdf["index"].to_numpy(), 3)
            yield pdf.assign(v0=own[:, 0], v1=own[:, 1], v2=own[:, 2])

    return triangles(spark, d).select("index").mapInPandas(decode, "index long, v0 long, v1 long, v2 long")


def facets(spark, d):
    edge_table = nation_edges(spark, d)
    return inc.facets(fl.simplices(edge_table, 2), 2, edge_table).select("tidx", "position", "removed", "eidx", "eradius")


def _incidence(spark, d, dim):
    edge_table = nation_edges(spark, d)
    return inc.incidences(fl.simplices(edge_table, dim), fl.simplices(edge_table, dim + 1), dim)


def cofacets(spark, d):
    return _incidence(spark, d, 1)


def coboundary_pivot(spark, d):
    return inc.pivots(_incidence(spark, d, 1))


def apparent_pairs_d1(spark, d):
    return inc.apparent_pairs(_incidence(spark, d, 1))


def apparent_pairs_d2(spark, d):
    return inc.apparent_pairs(_incidence(spark, d, 2))


def pivot_chunk_histogram(spark, d):
    return inc.pivot_histogram(coboundary_pivot(spark, d), 50)


def partition_boundaries(spark, d):
    """Pivots by the part of equal depth that they fall in, of four."""
    pivots = coboundary_pivot(spark, d)
    cuts = inc.equal_depth_boundaries([tuple(r) for r in inc.pivot_histogram(pivots, 50).collect()], 4)
    return pivots.groupBy(inc.partition_of(F.col("pivot"), cuts).cast("int").alias("part")).agg(F.count("*").alias("n"), F.min("pivot").alias("low"), F.max("pivot").alias("high"))


def clearing_d1(spark, d):
    """Edges that are no death in dimension 0."""
    edge_table = nation_edges(spark, d)
    tree = spanning_forest(edge_table).select((F.expr("a * (a - 1) div 2") + F.col("b")).cast("long").alias("pivot"))
    return inc.cleared(fl.simplices(edge_table, 1), tree).select("v0", "v1", "radius", "index")


def h0_pairs(spark, d):
    """Over all vectors."""
    return pairs_of_dim0(*nearest_forest(vector_points(spark, d), None, DISTANCE, "float64", spanning_forest))


def _pairs(spark, d, max_dim, threshold=None):
    return persistence_of(nation_points(spark, d), max_dim, DISTANCE, threshold, "float64")


def h0_pairs_nations(spark, d):
    return _pairs(spark, d, 0).dim(0)


def h1_pairs(spark, d):
    return _pairs(spark, d, 1).dim(1)


def h1_pairs_threshold(spark, d):
    """Below the enclosing radius some classes never die."""
    return _pairs(spark, d, 1, NATION_THRESHOLD).dim(1)


def h2_pairs(spark, d):
    return persistence_of(label_points(spark, d), 2, DISTANCE, None, "float64").dim(2)


def h2_pairs_axes(spark, d):
    """A class of dimension 2 in each octahedron."""
    return persistence_of(axis_points(spark, d), 2, DISTANCE, None, "float64").dim(2)


def persistent_homology_nations(spark, d):
    """The public entry point on a table of one's own columns, all dimensions."""
    points = nation_points(spark, d).select(F.col("coords").alias("place"), F.col("point_id").alias("nation"))
    return compute_persistent_homology(points, 1, DISTANCE, None, "place", "nation", "float64").pairs


def edges_float32(spark, d):
    """The default precision: squares summed in float32, one after the other."""
    return fl.edges(vector_points(spark, d), THRESHOLD).select("a", "b", F.col("w").cast("double").alias("w"))


def cofacets_threshold(spark, d):
    edge_table = nation_edges(spark, d, NATION_THRESHOLD)
    return inc.incidences(fl.simplices(edge_table, 1), fl.simplices(edge_table, 2), 1)


def _cloud_rows(cloud):
    return cloud.select(F.col("id"), F.posexplode("coords").alias("k", "x")).select("id", "k", F.round(F.col("x").cast("double"), 4).alias("x"))


def cloud_from_parquet(spark, d):
    return _cloud_rows(clouds.from_parquet(spark, f"{d}/embeddings.parquet", "vec_id", "embedding"))


def points_text_round_trip(spark, d):
    """The nations' points written as text and read as CSV."""
    path = passing_folder(spark, "points")
    clouds.write_points_text(nation_points(spark, d).orderBy("point_id"), path)
    return _cloud_rows(clouds.read_points_csv(spark, path))


def pairs_csv_round_trip(spark, d):
    """The nations' pairs under a threshold, written as CSV and read again."""
    path = passing_folder(spark, "pairs")
    clouds.write_pairs_csv(_pairs(spark, d, 0, NATION_THRESHOLD).pairs, 0, path)
    return clouds.read_pairs_csv(spark, f"{path}/dim_0", 0, header=True)


def generated_clouds(spark, d):
    """For each generated manifold the number of its points, and of those within the noise of it."""
    x = [F.get("coords", F.lit(k)).cast("double") for k in range(11)]
    root = lambda *c: F.sqrt(sum((v * v for v in c), F.lit(0.0)))
    ring = root(root(x[0], x[1]) - 2, x[2])
    each = [
        ("torus2", clouds.torus2(spark, 2000), F.abs(ring - 1) < 0.1),
        ("torus3", clouds.torus3(spark, 1000), (F.abs(root(x[0], x[1]) - 1) < 0.1) & (F.abs(root(x[2], x[3]) - 1) < 0.1) & (F.abs(root(x[4], x[5]) - 1) < 0.1) & (F.size("coords") == 100)),
        ("sphere", clouds.sphere(spark, 1000), (F.abs(root(*x) - 1) < 0.1) & (F.size("coords") == 100)),
        ("uniform", clouds.uniform(spark, 500, 8, seed=1), F.forall("coords", lambda c: (c >= 0) & (c < 1000)) & (F.size("coords") == 8)),
    ]
    found = [cloud.agg(F.lit(name).alias("name"), F.countDistinct("id").alias("points"), F.count_if(inside).alias("inside")) for name, cloud, inside in each]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def pairs_persistence(spark, d):
    """Derived columns of the pairs of nations under a threshold."""
    pairs = _pairs(spark, d, 0, NATION_THRESHOLD).dim(0)
    return pairs.select("dim", "birth", "death", is_infinite().alias("infinite"), is_finite().alias("finite"), persistence())


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    birth = F.col("p_size").cast("double") / 10
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit(1).alias("dim"), birth.alias("birth"), (birth + F.col("p_retailprice") / 1000).alias("death"))


def _pixels(image):
    return image.pixels.select("i", "j", F.round("value", 6).alias("value"))


def image_bounds(spark, d):
    birth, persist = resolve_bounds(finite_points(part_pairs(spark, d)), BoundsConfig(min_birth=0.0))
    row = [round(x, 9) for x in (birth.low, birth.high, persist.low, persist.high)]
    return spark.createDataFrame([row], "min_birth double, max_birth double, min_persistence double, max_persistence double")


def image_gaussian_iso(spark, d):
    return _pixels(gaussian_image(part_pairs(spark, d), PIXELS, PIXELS, 0.5, bounds=BOUNDS))


def image_gaussian_aniso(spark, d):
    return _pixels(gaussian_image(part_pairs(spark, d), PIXELS, PIXELS, 0.5, 0.1, bounds=BOUNDS))


def image_custom_weight(spark, d):
    """A weight and an influence of one's own, by the general path: quadratic weight, a cone of radius one half."""
    cone = lambda b, p, x, y: F.greatest(F.lit(0.0), F.lit(0.5) - F.sqrt((x - b) * (x - b) + (y - p) * (y - p)))
    return _pixels(persistence_image(part_pairs(spark, d), 10, 10, cone, lambda b, p: p * p, BOUNDS, samples=2))


def image_gaussian_exact(spark, d):
    return _pixels(persistence_image(part_pairs(spark, d), PIXELS, PIXELS, Gaussian(0.5, 0.5), bounds=BOUNDS, method="exact"))


QUERIES = {
    f.__name__: f
    for f in (
        pairwise_distance, edges_threshold, enclosing_radius, custom_distance_manhattan, triangles, triangles_threshold, tetrahedra, simplex_decode, facets, cofacets, coboundary_pivot,
        apparent_pairs_d1, apparent_pairs_d2, pivot_chunk_histogram, partition_boundaries, clearing_d1, h0_pairs, h0_pairs_nations, h1_pairs, h1_pairs_threshold, h2_pairs, h2_pairs_axes, persistent_homology_nations,
        edges_float32, cofacets_threshold, cloud_from_parquet, points_text_round_trip, pairs_csv_round_trip, generated_clouds,
        pairs_persistence, image_bounds, image_gaussian_iso, image_gaussian_aniso, image_custom_weight, image_gaussian_exact,
    )
}

# ---------------------------------------------------------------- DuckDB

VECTORS = """
pts AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.id AS a, b.id AS b, round(list_distance(a.v, b.v), 6) AS w FROM pts a JOIN pts b ON a.id > b.id)"""
NATIONS = """
pts AS (
  SELECT CAST(row_number() OVER (ORDER BY c_nationkey) - 1 AS INTEGER) AS id, CAST(count(*) AS DOUBLE) / 10 AS x,
    CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100000 AS y, CAST(max(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / 100000 AS z
  FROM customer GROUP BY c_nationkey
),
e AS (
  SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS w
  FROM pts a JOIN pts b ON a.id > b.id
)"""
AXES = """
x AS (SELECT list_transform(embedding[1:9], lambda c: CAST(round(CAST(c AS DOUBLE) * 1000000) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
t AS (SELECT k AS third, v[3 * k + 1] AS x, v[3 * k + 2] AS y, v[3 * k + 3] AS z, greatest(abs(v[3 * k + 1]), abs(v[3 * k + 2]), abs(v[3 * k + 3])) AS m FROM x, range(3) r(k)),
s AS (SELECT third, CASE WHEN abs(x) = m THEN 0 WHEN abs(y) = m THEN 1 ELSE 2 END AS axis, x, y, z FROM t),
g AS (
  SELECT third, axis, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END > 0 AS sign, CAST(sum(x) AS DOUBLE) AS x, CAST(sum(y) AS DOUBLE) AS y, CAST(sum(z) AS DOUBLE) AS z FROM s GROUP BY ALL
),
u AS (SELECT third, axis, sign, x, y, z, sqrt(x * x + y * y + z * z) AS l FROM g),
pts AS (SELECT CAST(row_number() OVER (ORDER BY third, axis, sign) - 1 AS INTEGER) AS id, x / l + 4 * third AS x, y / l AS y, z / l AS z FROM u),
e AS (
  SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS w FROM pts a JOIN pts b ON a.id > b.id
)"""
LABELS = """
m AS (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(k) GROUP BY label, k),
pts AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS id, list(x ORDER BY k) AS v FROM m GROUP BY label),
e AS (SELECT a.id AS a, b.id AS b, round(list_distance(a.v, b.v), 6) AS w FROM pts a JOIN pts b ON a.id > b.id)"""


def _radius_of(limit: str) -> str:
    """The edges within a threshold; `limit` is a number, or the enclosing radius."""
    far = "(SELECT min(far) FROM (SELECT max(w) AS far FROM (SELECT a AS p, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY p))"
    return f"f AS (SELECT * FROM e WHERE w <= {limit or far})"


def _triangles(edge: str = "e") -> str:
    return f"""tri AS (
  SELECT p.a AS v0, p.b AS v1, q.b AS v2, greatest(p.w, q.w, r.w) AS radius, p.w AS w01, q.w AS w12, r.w AS w02,
    CAST(p.a AS BIGINT) * (p.a - 1) * (p.a - 2) // 6 + CAST(p.b AS BIGINT) * (p.b - 1) // 2 + q.b AS index
  FROM {edge} p JOIN {edge} q ON q.a = p.b JOIN {edge} r ON r.a = p.a AND r.b = q.b
)"""


def _tetrahedra(edge: str = "e") -> str:
    return f"""tet AS (
  SELECT v0, v1, v2, s.b AS v3, greatest(radius, s.w, t.w, u.w) AS radius,
    CAST(v0 AS BIGINT) * (v0 - 1) * (v0 - 2) * (v0 - 3) // 24 + CAST(v1 AS BIGINT) * (v1 - 1) * (v1 - 2) // 6 + CAST(v2 AS BIGINT) * (v2 - 1) // 2 + s.b AS index
  FROM tri JOIN {edge} s ON s.a = v2 JOIN {edge} t ON t.a = v1 AND t.b = s.b JOIN {edge} u ON u.a = v0 AND u.b = s.b
)"""


EDGE_INDEX = "CAST({a} AS BIGINT) * ({a} - 1) // 2 + {b}"
FACETS = f"""fac AS (
  SELECT index AS tidx, radius AS tradius, 0 AS position, v0 AS removed, {EDGE_INDEX.format(a="v1", b="v2")} AS eidx, w12 AS eradius FROM tri
  UNION ALL SELECT index, radius, 1, v1, {EDGE_INDEX.format(a="v0", b="v2")}, w02 FROM tri
  UNION ALL SELECT index, radius, 2, v2, {EDGE_INDEX.format(a="v0", b="v1")}, w01 FROM tri
)"""
_T3 = "CAST({0} AS BIGINT) * ({0} - 1) * ({0} - 2) // 6 + CAST({1} AS BIGINT) * ({1} - 1) // 2 + {2}"
FACETS_OF_TET = "fac AS (SELECT tidx, tradius, eidx, t.radius AS eradius FROM (" + " UNION ALL ".join(
    f"SELECT index AS tidx, radius AS tradius, {_T3.format(*(f'v{j}' for j in range(4) if j != k))} AS eidx FROM tet" for k in range(4)
) + ") x JOIN tri t ON t.index = x.eidx)"
APPARENT = """
SELECT u.eidx, u.tidx, u.radius FROM (SELECT eidx, max(tidx) AS tidx, any_value(eradius) AS radius FROM fac WHERE eradius = tradius GROUP BY eidx) u
JOIN (SELECT tidx, min(eidx) AS eidx FROM fac WHERE eradius = tradius GROUP BY tidx) d ON u.eidx = d.eidx AND u.tidx = d.tidx"""
PIVOTS = "piv AS (SELECT eidx, eradius, arg_max(tidx, {'r': -tradius, 't': tidx}) AS \"pivot\", min(tradius) AS pivot_radius FROM fac GROUP BY eidx, eradius)"
#: Spanning forest by Boruvka-free means: an edge is in it if no earlier edges join its ends.
FOREST = """
k AS (SELECT *, row_number() OVER (ORDER BY w, a DESC, b DESC) AS n FROM f),
kr(n, comp, inside) AS (
  SELECT CAST(0 AS BIGINT), (SELECT map(list(id ORDER BY id), list(id ORDER BY id)) FROM pts), false
  UNION ALL
  SELECT k.n, CASE WHEN kr.comp[k.a] = kr.comp[k.b] THEN kr.comp
    ELSE map(map_keys(kr.comp), list_transform(map_values(kr.comp), lambda c: CASE WHEN c = kr.comp[k.a] THEN kr.comp[k.b] ELSE c END)) END, kr.comp[k.a] <> kr.comp[k.b]
  FROM kr JOIN k ON k.n = kr.n + 1
),
forest AS (SELECT k.* FROM k JOIN kr ON k.n = kr.n AND kr.inside)"""
H0 = """
SELECT CAST(0 AS INTEGER) AS dim, CAST(0 AS DOUBLE) AS birth, w AS death FROM forest WHERE w > 0
UNION ALL SELECT CAST(0 AS INTEGER), CAST(0 AS DOUBLE), 'inf'::DOUBLE FROM range((SELECT count(*) FROM pts) - (SELECT count(*) FROM forest))"""


def _reduction(low: str, high: str, k: int) -> str:
    """Boundary reduction of `high` simplices over bit strings of ranked `low` ones; red has births and deaths."""
    vs = [f"v{j}" for j in range(k + 1)]
    faces = " UNION ALL ".join(f"SELECT index, {', '.join(f'v{j} AS u{i}' for i, j in enumerate(x for x in range(k + 1) if x != out))} FROM {high}" for out in range(k + 1))
    on = " AND ".join(f"l.v{i} = x.u{i}" for i in range(k))
    return f"""
lo AS (SELECT *, row_number() OVER (ORDER BY radius, {', '.join(vs[:-1])}) AS k, count(*) OVER () AS m FROM {low}),
co AS (SELECT x.index, list(l.k) AS ks, any_value(l.m) AS m FROM ({faces}) x JOIN lo l ON {on} GROUP BY x.index),
hi AS (
  SELECT row_number() OVER (ORDER BY h.radius, {', '.join('h.' + v for v in vs)}) AS t, h.radius,
    CAST(list_reduce(list_transform(range(m), lambda p: CASE WHEN list_contains(ks, m - p) THEN '1' ELSE '0' END), lambda a, b: a || b) AS BIT) AS col
  FROM {high} h JOIN co ON co.index = h.index
),
red(t, col, low, birthk, r) AS (
  SELECT CAST(1 AS BIGINT), (SELECT col FROM hi WHERE t = 1), map(CAST([] AS BIGINT[]), CAST([] AS BIT[])), CAST(0 AS BIGINT), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT s.t + CASE WHEN s.more THEN 0 ELSE 1 END, CASE WHEN s.more THEN xor(s.col, s.low[s.p]) ELSE n.col END,
    CASE WHEN s.more OR s.p = 0 THEN s.low ELSE map_concat(s.low, map([s.p], [s.col])) END, CASE WHEN s.more THEN 0 ELSE s.p END, c.radius
  FROM (SELECT *, map_contains(low, p) AS more FROM (SELECT *, CAST(bit_position('1'::BIT, col) AS BIGINT) AS p FROM red WHERE col IS NOT NULL)) s
  JOIN hi c ON c.t = s.t LEFT JOIN hi n ON n.t = s.t + 1
),
born AS (SELECT lo.*, red.r AS death FROM red JOIN lo ON red.birthk > 0 AND lo.k = lo.m - (red.birthk - 1))"""


def _image(n: int, samples: int, weight: str, influence: str) -> str:
    return f"""
WITH p AS (SELECT CAST(p_size AS DOUBLE) / 10 AS b, (CAST(p_size AS DOUBLE) / 10 + p_retailprice / 1000) - CAST(p_size AS DOUBLE) / 10 AS p FROM part),
g AS (
  SELECT i, j, 6.0::DOUBLE / {n} * (i + (sx + 0.5::DOUBLE) / {samples}) AS x, 3.0::DOUBLE / {n} * (j + (sy + 0.5::DOUBLE) / {samples}) AS y
  FROM range({n}) a(i), range({n}) c(j), range({samples}) s(sx), range({samples}) t(sy)
)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum({weight} * {influence}) * 18.0::DOUBLE / {n * n * samples * samples}, 6) AS value FROM p, g GROUP BY i, j"""


def _gaussian(vb: float, vp: float) -> str:
    return f"exp(-(x - b) * (x - b) / {2 * vb}::DOUBLE - (y - p) * (y - p) / {2 * vp}::DOUBLE) / (2 * pi() * sqrt({vb}::DOUBLE) * sqrt({vp}::DOUBLE))"


_EDGE_TABLE = "ed AS (SELECT a AS v0, b AS v1, w AS radius, " + EDGE_INDEX.format(a="a", b="b") + " AS index FROM f)"
_H1 = "SELECT CAST(1 AS INTEGER) AS dim, radius AS birth, death FROM born WHERE radius <> death"

SQL = {
    "pairwise_distance": f"WITH {VECTORS} SELECT a, b, w FROM e",
    "edges_threshold": f"WITH {VECTORS} SELECT a, b, w FROM e WHERE w <= {THRESHOLD}",
    "enclosing_radius": f"WITH {VECTORS} SELECT min(far) AS radius FROM (SELECT max(w) AS far FROM (SELECT a AS p, w FROM e UNION ALL SELECT b, w FROM e) GROUP BY p)",
    "custom_distance_manhattan": f"WITH {NATIONS} SELECT a.id AS a, b.id AS b, round(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z), 6) AS w FROM pts a JOIN pts b ON a.id > b.id",
    "triangles": f"WITH {NATIONS}, {_triangles()} SELECT v0, v1, v2, radius, index FROM tri",
    "triangles_threshold": f"WITH {NATIONS}, {_radius_of(str(NATION_THRESHOLD))}, {_triangles('f')} SELECT v0, v1, v2, radius, index FROM tri",
    "tetrahedra": f"WITH {NATIONS}, {_triangles()}, {_tetrahedra()} SELECT v0, v1, v2, v3, radius, index FROM tet",
    "simplex_decode": f"WITH {NATIONS}, {_triangles()} SELECT index, CAST(v0 AS BIGINT) AS v0, CAST(v1 AS BIGINT) AS v1, CAST(v2 AS BIGINT) AS v2 FROM tri",
    "facets": f"WITH {NATIONS}, {_triangles()}, {FACETS} SELECT tidx, CAST(position AS INTEGER) AS position, removed, eidx, eradius FROM fac",
    "cofacets": f"WITH {NATIONS}, {_triangles()}, {FACETS} SELECT eidx, eradius, tidx, tradius FROM fac",
    "coboundary_pivot": f"WITH {NATIONS}, {_triangles()}, {FACETS}, {PIVOTS} SELECT eidx, eradius, \"pivot\", pivot_radius FROM piv",
    "apparent_pairs_d1": f"WITH {NATIONS}, {_triangles()}, {FACETS} {APPARENT}",
    "apparent_pairs_d2": f"WITH {NATIONS}, {_triangles()}, {_tetrahedra()}, {FACETS_OF_TET} {APPARENT}",
    "pivot_chunk_histogram": f"WITH {NATIONS}, {_triangles()}, {FACETS}, {PIVOTS} SELECT \"pivot\" // 50 * 50 AS pivots_start, \"pivot\" // 50 * 50 + 49 AS pivots_end, count(*) AS count FROM piv GROUP BY \"pivot\" // 50",
    "clearing_d1": f"WITH RECURSIVE {NATIONS}, f AS (SELECT * FROM e), {FOREST} SELECT a AS v0, b AS v1, w AS radius, {EDGE_INDEX.format(a='a', b='b')} AS index FROM k WHERE n NOT IN (SELECT n FROM forest)",
    "h0_pairs_nations": f"WITH RECURSIVE {NATIONS}, {_radius_of('')}, {FOREST} {H0}",
    "h1_pairs": f"WITH RECURSIVE {NATIONS}, {_radius_of('')}, {_triangles('f')}, {_EDGE_TABLE}, {_reduction('ed', 'tri', 2)} {_H1}",
    "h1_pairs_threshold": f"""WITH RECURSIVE {NATIONS}, {_radius_of(str(NATION_THRESHOLD))}, {_triangles('f')}, {_EDGE_TABLE}, {FOREST}, {_reduction('ed', 'tri', 2)} {_H1}
UNION ALL SELECT CAST(1 AS INTEGER), radius, 'inf'::DOUBLE FROM ed WHERE index NOT IN (SELECT index FROM born) AND index NOT IN (SELECT {EDGE_INDEX.format(a='a', b='b')} FROM forest)""",
    "h2_pairs": f"""WITH RECURSIVE {LABELS}, {_radius_of('')}, {_triangles('f')}, {_tetrahedra('f')}, {_reduction('tri', 'tet', 3)}
SELECT CAST(2 AS INTEGER) AS dim, radius AS birth, death FROM born WHERE radius <> death""",
    "h2_pairs_axes": f"""WITH RECURSIVE {AXES}, {_radius_of('')}, {_triangles('f')}, {_tetrahedra('f')}, {_reduction('tri', 'tet', 3)}
SELECT CAST(2 AS INTEGER) AS dim, radius AS birth, death FROM born WHERE radius <> death""",
    "persistent_homology_nations": f"WITH RECURSIVE {NATIONS}, {_radius_of('')}, {FOREST}, {_triangles('f')}, {_EDGE_TABLE}, {_reduction('ed', 'tri', 2)} {H0} UNION ALL {_H1}",
    "edges_float32": f"""WITH pts AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS id, embedding AS v FROM embeddings),
e AS (SELECT a.id AS a, b.id AS b, list_reduce(list_transform(list_zip(a.v, b.v), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS FLOAT)), lambda s, t: CAST(s + t AS FLOAT)) AS q FROM pts a JOIN pts b ON a.id > b.id)
SELECT a, b, CAST(CAST(sqrt(CAST(q AS DOUBLE)) AS FLOAT) AS DOUBLE) AS w FROM e WHERE CAST(sqrt(CAST(q AS DOUBLE)) AS FLOAT) <= CAST({THRESHOLD} AS FLOAT)""",
    "cofacets_threshold": f"WITH {NATIONS}, {_radius_of(str(NATION_THRESHOLD))}, {_triangles('f')}, {FACETS} SELECT eidx, eradius, tidx, tradius FROM fac",
    "cloud_from_parquet": "SELECT vec_id AS id, CAST(k - 1 AS INTEGER) AS k, round(CAST(embedding[k] AS DOUBLE), 4) AS x FROM embeddings, range(1, 65) r(k)",
    "points_text_round_trip": f"WITH {NATIONS} SELECT CAST(id AS BIGINT) AS id, CAST(k AS INTEGER) AS k, round(CAST(CAST([x, y, z][k + 1] AS FLOAT) AS DOUBLE), 4) AS x FROM pts, range(3) r(k)",
    "pairs_csv_round_trip": f"WITH RECURSIVE {NATIONS}, {_radius_of(str(NATION_THRESHOLD))}, {FOREST} {H0}",
    "generated_clouds": "SELECT * FROM (VALUES ('torus2', CAST(2000 AS BIGINT), CAST(2000 AS BIGINT)), ('torus3', 1000, 1000), ('sphere', 1000, 1000), ('uniform', 500, 500)) v(name, points, inside)",
    "pairs_persistence": f"WITH RECURSIVE {NATIONS}, {_radius_of(str(NATION_THRESHOLD))}, {FOREST} SELECT *, isinf(death) AS infinite, NOT isinf(death) AS finite, death - birth AS persistence FROM ({H0})",
    "image_bounds": "SELECT 0.0::DOUBLE AS min_birth, round(max(b), 9) AS max_birth, round(min(d - b), 9) AS min_persistence, round(max(d - b), 9) AS max_persistence FROM (SELECT CAST(p_size AS DOUBLE) / 10 AS b, CAST(p_size AS DOUBLE) / 10 + p_retailprice / 1000 AS d FROM part)",
    "image_gaussian_iso": _image(PIXELS, 3, "p", _gaussian(0.5, 0.5)),
    "image_gaussian_aniso": _image(PIXELS, 3, "p", _gaussian(0.5, 0.1)),
    "image_custom_weight": _image(10, 2, "p * p", "greatest(0.0::DOUBLE, 0.5::DOUBLE - sqrt((x - b) * (x - b) + (y - p) * (y - p)))"),
}
