"""Census scan: the one family of equipment, the thirty columns the directory needs."""
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ringside import vocab

EQUIPMENT = T.StructType([
    T.StructField(name, T.StructType([T.StructField("lat", T.DoubleType()),
                                      T.StructField("lon", T.DoubleType())])
                  if name == "equip_coordonnees" else T.StringType())
    for name in vocab.CENSUS_FIELDS])


def read_census(spark: SparkSession, path: str, fmt="parquet") -> DataFrame:
    """Declared schema, so nothing is inferred; `seq` must be in the data for parquet.

    JSON exports carry no row number: there the file and the record's own equipment number
    stand in for it.
    """
    schema = T.StructType(EQUIPMENT.fields + [T.StructField("equip_type_famille", T.StringType()),
                                              T.StructField("seq", T.LongType())])
    return select_family(spark.read.schema(schema).format(fmt).load(path))


def select_family(rows: DataFrame, family=vocab.CENSUS_FAMILY) -> DataFrame:
    """Keep one equipment family; the predicate and the projection reach the scan."""
    keep = [c for c in vocab.CENSUS_FIELDS + ["seq"] if c in rows.columns]
    return rows.where(F.col("equip_type_famille") == family).select(*keep)
