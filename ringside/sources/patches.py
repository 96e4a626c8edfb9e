"""Community patch files: one JSON object, or an array of objects, per file."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ringside import vocab
from ringside.operators.overlay import PATCH_TYPE, PHOTO


def read_patch_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of every *.json whose name does not start with an underscore."""
    return (spark.read.option("wholetext", True).option("pathGlobFilter", "[!_]*.json").text(path)
            .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def split_records(files: DataFrame) -> DataFrame:
    """(file, pos, record variant, parse_error, written): an object counts as an array of one.

    A text that does not parse keeps one row with a null record, so it can be reported.
    `written` holds the integer keys as the file writes them: a variant forgets that 400.0 has a point.
    """
    written = "struct<" + ",".join(f"{k}:string" for k in vocab.PATCH_INTS) + ">"
    parsed = files.select("file", "text", F.try_parse_json("text").alias("doc"))
    is_list = F.schema_of_variant("doc").startswith("ARRAY")
    many = F.try_variant_get("doc", "$", "array<variant>")
    records = F.when(is_list, many).otherwise(F.array("doc"))
    texts = F.when(is_list, F.from_json("text", f"array<{written}>")).otherwise(F.array(F.from_json("text", written)))
    return parsed.select("file", F.col("doc").isNull().alias("parse_error"), texts.alias("_texts"),
                         F.posexplode(records).alias("pos", "record")).select(
        "file", "parse_error", "pos", "record", F.get("_texts", F.col("pos")).alias("written"))


def typed_patches(records: DataFrame, keys=None) -> DataFrame:
    """id, present keys, one typed column per key (null when the type does not fit), and `mistyped`: the keys
    whose value is there, isn't null, and was lost in part or whole by its type."""
    record = F.col("record")
    keys = keys or vocab.PATCH_KEYS
    return records.where(~F.col("parse_error")).select(
        "file", "pos", F.try_variant_get(record, "$.id", "string").alias("id"),
        present_keys(record).alias("keys"),
        F.array_compact(F.array(*[F.when(_loses(record, k), F.lit(k)) for k in keys])).alias("mistyped"),
        *[_typed(record, k).alias(k) for k in keys])


def _typed(record, key):
    if key != "photos":
        return F.try_variant_get(record, f"$.{key}", PATCH_TYPE[key])
    return F.transform(F.try_variant_get(record, "$.photos", "array<variant>"), _photo)


def _photo(entry):
    """A photo, or a bare string that names its file."""
    kind = PHOTO.simpleString()
    name = F.to_json(F.struct(F.try_variant_get(entry, "$", "string").alias("fichier")))
    return F.when(F.schema_of_variant(entry) == "STRING", F.from_json(name, kind)).otherwise(F.try_variant_get(entry, "$", kind))


def _loses(record, key):
    value = F.try_variant_get(record, f"$.{key}", "variant")
    there = value.isNotNull() & ~F.is_variant_null(value)
    lost = _typed(record, key).isNull()
    if key in vocab.PATCH_INTS:      # a fraction would be cut off
        lost = lost | F.schema_of_variant(value).rlike(r"^(FLOAT|DOUBLE|DECIMAL\(\d+,[1-9]\d*\))$")
    if key == "photos":
        lost = lost | F.exists(_typed(record, key), lambda p: p.isNull())
    if key == "avis":
        notes = F.transform(F.try_variant_get(record, "$.avis", "array<variant>"), lambda a: F.struct(
            F.try_variant_get(a, "$.note", "variant").alias("said"), F.try_variant_get(a, "$.note", "int").alias("note")))
        lost = lost | F.exists(notes, lambda n: n["said"].isNotNull() & ~F.is_variant_null(n["said"]) & n["note"].isNull())
    return F.coalesce(there & lost, F.lit(False))


def present_keys(record):
    """Keys of a JSON object, those holding an explicit null included."""
    return F.map_keys(record.try_cast("map<string,variant>"))
