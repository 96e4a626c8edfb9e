"""Dataset build: census and patches to the published dataset."""
from pyspark.sql import DataFrame, functions as F

from ringside.operators import contributors, overlay, publish, rollup, validation
from ringside.session import cut_lineage
from ringside.sources import patches as patch_files, published


def build_venues(equipment: DataFrame, records: DataFrame, photos: DataFrame, order=("seq",)) -> DataFrame:
    """Rollup, overlay and review summaries; refuses unknown keys, missing ids and missing photos."""
    typed = patch_files.typed_patches(records)
    validation.require_none(records.where("parse_error").select("file"), "a patch file does not parse")
    validation.require_none(validation.build_refusals(typed).select("file", "id", "unknown", "mistyped"), "a patch is refused")
    merged = overlay.apply_patches(rollup.rollup(equipment, order), typed, order=("file", "pos"))
    venues = cut_lineage(publish.located(merged))
    entries = publish.photo_entries(venues, photos)
    validation.require_none(entries.where("missing").select("id", "f"), "a listed photo is missing")
    shown = publish.attach_photos(venues, entries)
    return shown.withColumns({
        "note_moyenne": publish.mean_note(F.col("avis")), "nb_avis": F.coalesce(F.size("avis"), F.lit(0)),
        "avis": publish.newest_first(F.col("avis"))})


def build_dataset(equipment: DataFrame, records: DataFrame, photos: DataFrame, samples: DataFrame,
                  history: DataFrame, patch_stamps: DataFrame, out: str, generated: str, source: str,
                  order=("seq",)) -> DataFrame:
    """Writes the dataset under `out` and returns it re-read."""
    venues = build_venues(equipment, records, photos, order)
    spark = equipment.sparkSession
    venues.write.mode("overwrite").parquet(f"{out}/venues")
    venues = spark.read.parquet(f"{out}/venues")
    shot = venues.select("id", F.explode("photos").alias("p")).select("id", F.col("p.c").alias("credit"))
    wrote = venues.select("id", F.explode("avis").alias("a")).select("id", F.col("a.a").alias("author"))
    told = contributors.contributions(shot, wrote)
    board = contributors.board(told, contributors.canonical_names(told))
    with_photo = venues.where(F.size("photos") > 0)
    latest = contributors.latest(with_photo, contributors.contribution_dates(with_photo, history, patch_stamps))
    years = contributors.imagery_years(samples).withColumnRenamed("year", "ortho_annee")
    deps = publish.department_dimension(venues).join(years, "dep", "left")
    published.write_dataset(publish.compact(venues), deps, board, latest, out, generated, source)
    return published.read_dataset(spark, out)
