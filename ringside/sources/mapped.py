"""Objects of the open map and official layers, as landed tables.

element: type, id, tags map<string,string>, geometry array<point>, members
array<struct<role, geometry>>, center point, lat, lon.
"""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ringside import vocab
from ringside.functions import geo, text

c = F.col
POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
ELEMENT = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.ArrayType(POINT)),
    T.StructField("members", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("geometry", T.ArrayType(POINT))]))),
    T.StructField("center", POINT), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType())])


def read_elements(spark: SparkSession, path: str, fmt="parquet") -> DataFrame:
    return spark.read.schema(ELEMENT).format(fmt).load(path)


def tag(name) -> Column:
    return F.try_element_at(c("tags"), F.lit(name))


def _is(name, *values) -> Column:
    return F.coalesce(tag(name).isin(*values), F.lit(False))


def _athletic() -> Column:
    return F.coalesce(tag("sport").rlike("athletics|running"), F.lit(False))


def lap_objects(elements: DataFrame) -> DataFrame:
    """Objects a lap can be measured on: athletic tracks and pitches, or any athletics tag."""
    return elements.where((_is("leisure", "track", "pitch") & _athletic()) | tag("athletics").isNotNull())


def audit_objects(elements: DataFrame) -> DataFrame:
    """Wider: any track whatever its sport, athletic pitches, any athletics tag."""
    return elements.where(_is("leisure", "track") | (_is("leisure", "pitch") & _athletic())
                          | tag("athletics").isNotNull())


def element_point() -> Column:
    """Centre given by the map, else the node's own position, else the mean of the geometry."""
    own = F.when(c("lat").isNotNull(), F.struct(c("lat"), c("lon")))
    given = F.when(c("center.lat").isNotNull(), c("center"))
    return F.coalesce(given, own, geo.ring_centre(c("geometry")))


def sporting_places(elements: DataFrame) -> DataFrame:
    """Roads and named venues whose name announces sport, as (source, nom, lat, lon, osm)."""
    road = tag("highway").isNotNull() & F.coalesce(tag("name").rlike("(?i)stade|sports?"), F.lit(False))
    venue = _is("leisure", "sports_centre", "stadium") & tag("name").isNotNull()
    named = F.when(text.present(tag("leisure")), vocab.SOURCE_NAMED).otherwise(vocab.SOURCE_ROAD)
    return elements.where(road | venue).select(
        named.alias("source"), tag("name").alias("nom"), element_point().alias("_p"),
        F.concat_ws("/", "type", "id").alias("osm")).where(c("_p").isNotNull()).select(
        "source", "nom", c("_p.lat").alias("lat"), c("_p.lon").alias("lon"), "osm")


def multisport_pitches(features: DataFrame) -> DataFrame:
    """Multi-sport pitches of the official layer; the point is the mean of all vertices.

    features: nature, nature_detaillee, kind, and coordinates as array<array<array<array<double>>>>
    (a MultiPolygon; shallower geometries wrapped by `as_multipolygon`).
    """
    flat = F.flatten(F.flatten(c("coordinates")))
    axis = lambda i: F.aggregate(F.transform(flat, lambda p: F.element_at(p, i)), F.lit(0.0),
                                 lambda a, x: a + x) / F.nullif(F.size(flat), F.lit(0))
    return features.where(c("nature") == vocab.MULTISPORT_PITCH).select(
        F.lit(vocab.SOURCE_PITCH).alias("source"),
        F.coalesce(F.nullif("nature_detaillee", F.lit("")), F.lit(vocab.DEFAULT_PITCH_NAME)).alias("nom"),
        axis(2).alias("lat"), axis(1).alias("lon"), F.lit(None).cast("string").alias("osm")).where(
        c("lat").isNotNull())


def as_multipolygon(geojson: Column) -> Column:
    """Coordinates of a GeoJSON geometry text of any depth, wrapped to MultiPolygon depth."""
    kind = F.get_json_object(geojson, "$.type")
    raw = F.get_json_object(geojson, "$.coordinates")
    deep = lambda depth: F.from_json(raw, "array<" * depth + "double" + ">" * depth)
    return (F.when(kind == "MultiPolygon", deep(4))
            .when(kind.isin("Polygon", "MultiLineString"), F.array(deep(3)))
            .when(kind.isin("LineString", "MultiPoint"), F.array(F.array(deep(2))))
            .when(kind == "Point", F.array(F.array(F.array(deep(1))))))


def commune_rings(communes: DataFrame) -> DataFrame:
    """Outer rings of communes: one of a Polygon, one per part of a MultiPolygon.

    communes: dep, kind, coordinates array<array<array<array<double>>>> (a Polygon is wrapped).
    """
    outer = F.transform(c("coordinates"), lambda part: F.element_at(part, 1))
    points = lambda ring: F.transform(ring, lambda p: F.struct(
        F.element_at(p, 2).alias("lat"), F.element_at(p, 1).alias("lon")))
    keep = [x for x in communes.columns if x not in ("kind", "coordinates")]
    return communes.select(*keep, F.posexplode(outer).alias("part", "_r")).withColumn(
        "ring", points(c("_r"))).drop("_r")


def department_extent(communes: DataFrame, pad_lon=0.12, pad_lat=0.10) -> DataFrame:
    """Bounding box per department from the centres of its communes, padded by a commune."""
    return communes.groupBy("dep").agg(
        (F.min("lon") - pad_lon).alias("west"), (F.min("lat") - pad_lat).alias("south"),
        (F.max("lon") + pad_lon).alias("east"), (F.max("lat") + pad_lat).alias("north"))
