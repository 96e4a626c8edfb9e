"""Checks on community patches. One pass yields every (file, pos, id, rule, detail).

Only two rules look beyond the record: duplicate ids, and photos against the files on disk.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ringside import vocab
from ringside.functions import text
from ringside.session import cut_lineage

c = F.col
MAX_REVIEW, MAX_AUTHOR, MAX_PHOTO_BYTES = 1200, 40, 400 * 1024
WORLD = (-90.0, 90.0, -180.0, 180.0)
TERRITORY = (41.0, 52.0, -62.0, 56.0)      # south, north, west, east


class InvalidPatches(ValueError):
    """Raised when a run must stop on invalid contributions."""


def _get(record, key, kind) -> Column:
    return F.try_variant_get(record, f"$.{key}", kind)


def _type(value) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_int(kind) -> Column:
    return kind.rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$")


def _is_number(kind) -> Column:
    return kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE|BOOLEAN)")


def error(rule, detail, when) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _extra(value, allowed) -> Column:
    return F.array_join(F.array_except(F.map_keys(value.try_cast("map<string,variant>")), _lit_array(allowed)), ",")


def photo_record_errors(photo) -> Column:
    """Rules on one entry of `photos` that need no file system."""
    name = F.coalesce(_get(photo, "fichier", "string"), F.lit(""))
    usable = _type(photo).startswith("OBJECT") & (name != "")
    bare = ~(name.contains("/") | name.contains("\\") | name.startswith("."))
    extra = F.coalesce(_extra(photo, vocab.PHOTO_KEYS), F.lit(""))
    return F.array_compact(F.array(
        error("photo_without_file", "photos", ~usable),
        error("photo_unknown_key", extra, usable & (extra != "")),
        error("photo_not_bare_name", name, usable & ~bare),
        error("photo_not_jpeg", name, usable & bare & ~F.lower(name).rlike(r"\.jpe?g$"))))


def review_errors(review) -> Column:
    """Rules on one entry of `avis`."""
    is_object = _type(review).startswith("OBJECT")
    extra = F.coalesce(_extra(review, vocab.REVIEW_KEYS), F.lit(""))
    body, note = _get(review, "texte", "variant"), _get(review, "note", "variant")
    said = F.when(_type(body) == "STRING", _get(review, "texte", "string"))
    stars = F.when(_is_number(_type(note)), _get(review, "note", "double"))
    dated, author = _get(review, "date", "string"), _get(review, "auteur", "string")
    return F.array_compact(F.array(
        error("review_not_object", "avis", ~is_object),
        error("review_unknown_key", extra, is_object & (extra != "")),
        error("review_without_text", "texte", is_object & (F.coalesce(F.length(said), F.lit(0)) == 0)),
        error("review_too_long", F.length(said), is_object & (F.length(said) > MAX_REVIEW)),
        error("review_bad_note", "note", is_object & F.array_contains(F.map_keys(
            review.try_cast("map<string,variant>")), "note")
            & ~F.coalesce(stars.isin(1.0, 2.0, 3.0, 4.0, 5.0), F.lit(False))),
        error("review_bad_date", dated, is_object & (F.length(dated) > 0) & ~dated.rlike(r"^\d{4}-\d{2}-\d{2}$")),
        error("review_long_author", "auteur", is_object & (F.length(author) > MAX_AUTHOR))))


def _key_errors(entry) -> Column:
    """Rules on one key and its value."""
    key, value = entry["key"], entry["value"]
    kind = _type(value)
    items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    is_list = kind.startswith("ARRAY")
    allowed = vocab.PATCH_KEYS + vocab.VALIDATOR_ONLY_STRINGS + ["id"]
    strings = vocab.PATCH_STRINGS + vocab.VALIDATOR_ONLY_STRINGS
    simple = F.array_compact(F.array(
        error("unknown_key", key, ~key.isin(*allowed)),
        error("not_bool", key, key.isin(*vocab.PATCH_BOOLS) & (kind != "BOOLEAN")),
        error("not_int", key, key.isin(*vocab.PATCH_INTS) & ~_is_int(kind)),
        error("not_number", key, key.isin(*vocab.PATCH_NUMBERS) & ~_is_number(kind)),
        error("not_string", key, key.isin(*strings) & (kind != "STRING")),
        error("not_list", key, key.isin(*vocab.PATCH_LISTS, *vocab.PATCH_MEDIA) & ~is_list)))
    unknown_kit = F.filter(F.transform(items, lambda a: F.coalesce(
        F.try_variant_get(a, "$", "string"), F.lit(""))), lambda a: ~a.isin(*vocab.DISCIPLINES))
    kit = F.when((key == "agres") & is_list, F.transform(unknown_kit, lambda a: F.struct(
        F.lit("unknown_discipline").alias("rule"), a.alias("detail"))))
    shots = F.when((key == "photos") & is_list, F.flatten(F.transform(items, photo_record_errors)))
    said = F.when((key == "avis") & is_list, F.flatten(F.transform(items, review_errors)))
    empty = F.array().cast("array<struct<rule:string,detail:string>>")
    return F.concat(simple, F.coalesce(kit, empty), F.coalesce(shots, empty), F.coalesce(said, empty))


def record_errors(records: DataFrame) -> DataFrame:
    """Every error a record shows by itself. records: file, pos, record variant, parse_error."""
    r = c("record")
    kind = F.schema_of_variant(r)
    ident = F.when(_type(_get(r, "id", "variant")) == "STRING", _get(r, "id", "string"))
    broken, is_object = c("parse_error"), F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    has_id = F.coalesce(F.length("id") > 0, F.lit(False))
    base = records.select("file", "pos", "record", "parse_error", c("written").alias("_written"), is_object.alias("_object"), ident.alias("id"),
                          r.try_cast("map<string,variant>").alias("_map"),
                          _get(r, "lat", "double").alias("_lat"), _get(r, "lon", "double").alias("_lon"),
                          _get(r, "surface", "string").alias("_surface"), _get(r, "url", "string").alias("_url"))
    stop = F.array_compact(F.array(
        error("invalid_json", "file", broken), error("not_an_object", "record", ~broken & ~c("_object")),
        error("missing_id", "id", c("_object") & ~has_id)))
    lat, lon = c("_lat"), c("_lon")
    inside = lambda box: lat.between(box[0], box[1]) & lon.between(box[2], box[3])
    blank = lambda key: F.coalesce(_get(c("record"), key, "string"), F.lit("")) == ""
    new = c("id").startswith("c-")
    # 400.0 and 4e2 are whole, but not written as integers
    points = [error("not_int", key, _is_int(_type(_get(c("record"), key, "variant"))) & c(f"_written.{key}").rlike("[.eE]"))
              for key in vocab.PATCH_INTS]
    own = F.array_compact(F.array(
        *points,
        error("bad_id", c("id"), ~c("id").rlike(vocab.ID_PATTERN)),
        error("unknown_surface", c("_surface"), (F.length("_surface") > 0) & ~c("_surface").isin(*vocab.SURFACES)),
        error("half_a_position", "lat/lon", lat.isNull() != lon.isNull()),
        error("out_of_world", "lat/lon", ~inside(WORLD)), error("out_of_territory", "lat/lon", ~inside(TERRITORY)),
        *[error("new_venue_without", key, new & blank(key)) for key in ("nom", "ville", "lat", "lon")],
        error("bad_url", c("_url"), (F.length("_url") > 0) & ~c("_url").rlike("^https?://"))))
    per_key = F.flatten(F.transform(F.map_entries("_map"), _key_errors))
    errors = F.when(F.size(stop) > 0, stop).otherwise(F.concat(own, per_key))
    return base.select("file", "pos", "id", F.explode(errors).alias("e")).select("file", "pos", "id", "e.rule", "e.detail")


def duplicate_ids(records: DataFrame) -> DataFrame:
    """One row per definition after the first, naming the file of the definition before it.

    records: file, pos, id. Repeated definitions are dealt out by ranges of (id, file, pos), so an id
    defined in very many files spreads over many ranges. The definition before a row is the row
    before it in its range or, for a range's first row, the last row of the range before.
    """
    known = records.where(text.present(c("id"))).select("id", "file", "pos")
    repeated = known.groupBy("id").agg(F.count("*").alias("_n")).where(c("_n") > 1)
    several = known.join(repeated.select("id"), "id", "left_semi")
    ranged = cut_lineage(several.repartitionByRange("id", "file", "pos").withColumn("_range", F.spark_partition_id()))
    here = F.struct("id", "file", "pos")
    looked = ranged.withColumn("_before", F.lag(here).over(Window.partitionBy("_range").orderBy("id", "file", "pos")))
    ends = ranged.groupBy("_range").agg(F.max(here).alias("_last"))      # one row per range
    earlier = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_earlier"))
    met = looked.join(earlier, "_range").withColumn("_met", F.coalesce("_before", "_earlier"))
    return met.where(c("_met.id") == c("id")).select(
        "file", "pos", "id", F.lit("duplicate_id").alias("rule"), c("_met.file").alias("detail"))


def photo_file_errors(records: DataFrame, files: DataFrame) -> DataFrame:
    """Photos that are missing or too heavy. files: id, file, length."""
    ident = _get(c("record"), "id", "variant")
    named = (_type(ident) == "STRING") & (_get(c("record"), "id", "string") != "")  # others stop at the missing id
    listed = records.where(~c("parse_error")).where(named).select(
        c("file").alias("patch"), "pos", _get(c("record"), "id", "string").alias("id"),
        F.explode(_get(c("record"), "photos", "array<variant>")).alias("p")).select(
        "patch", "pos", "id", _get(c("p"), "fichier", "string").alias("file"))
    bare = listed.where((F.length("file") > 0) & ~c("file").rlike(r"[/\\]|^\."))
    met = bare.join(files.select("id", "file", "length"), ["id", "file"], "left")
    rule = F.when(c("length").isNull(), "photo_missing").when(c("length") > MAX_PHOTO_BYTES, "photo_too_large")
    return met.withColumn("rule", rule).where(c("rule").isNotNull()).select(
        c("patch").alias("file"), "pos", "id", "rule", c("file").alias("detail"))


def build_refusals(patches: DataFrame, allowed=None) -> DataFrame:
    """Patches the build refuses: no id, a key outside the build's own list, or a value its type would lose."""
    allowed = _lit_array((allowed or vocab.PATCH_KEYS) + ["id"])
    extra = F.array_sort(F.array_except("keys", allowed))
    return patches.select("*", extra.alias("unknown")).where(
        (F.size("unknown") > 0) | (F.size("mistyped") > 0) | ~text.present(c("id")))


def require_none(errors: DataFrame, what: str) -> None:
    """Stop the run when there is any error row; quotes the first one."""
    first = errors.limit(1).collect()
    if first:
        raise InvalidPatches(f"{what}: {first[0].asDict()}")
