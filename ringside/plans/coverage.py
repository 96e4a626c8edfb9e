"""Lap estimation, coverage audit, places to look at, and contribution checks."""
from pyspark.sql import DataFrame, functions as F

from ringside import vocab
from ringside.operators import audit, cluster, validation
from ringside.session import cut_lineage, shuffled
from ringside.sources import mapped

c = F.col


def estimate_laps(venues: DataFrame, elements: DataFrame, current: DataFrame):
    """(matches, outcome counts, patches) for venues whose ring is mapped."""
    matches = audit.match_laps(venues, audit.lap_rings(mapped.lap_objects(elements)))
    return matches, audit.lap_outcomes(matches), audit.lap_patches(matches, current)


def audit_coverage(venues: DataFrame, elements: DataFrame, facilities: DataFrame, schools: DataFrame,
                   addresses: DataFrame) -> dict:
    """Missing tracks with their context, rejections by reason, and totals per department.

    elements carry a dep column: the department is a key, not a loop. venues: id, nom, ville, dep, lat, lon.
    """
    objects = mapped.audit_objects(elements)
    examined = cut_lineage(audit.examine_traces(objects))
    groups = cut_lineage(audit.group_traces(audit.candidates(examined)))
    claimed = cut_lineage(audit.claims(groups, venues))
    missing = cut_lineage(audit.missing_tracks(groups, claimed))     # read by four steps
    named = audit.name_from_context(missing, facilities).select("trace_id", "place")
    school = audit.schools_around(missing, schools)
    address = audit.nearest_address(missing, addresses).select("trace_id", "city", "street", "postcode")
    full = (with_nearest_venue(missing, venues).join(named, "trace_id", "left").join(school, "trace_id", "left")
            .join(address, "trace_id", "left").orderBy(F.desc("near_m"), "trace_id"))
    return {"missing": full, "rejections": audit.rejection_counts(audit.rejects(examined)),
            "totals": audit.audit_totals(objects, claimed)}


def with_nearest_venue(missing: DataFrame, venues: DataFrame) -> DataFrame:
    """Missing tracks with the name and city of the nearest known venue, and the mapped object's address."""
    known = venues.select(c("id").alias("near_id"), c("nom").alias("near_name"), c("ville").alias("near_city"))
    return missing.join(shuffled(known), "near_id", "left").withColumn("url", F.concat(F.lit(vocab.OBJECT_URL), "osm"))


def places_to_look_at(venues: DataFrame, elements: DataFrame, features: DataFrame, communes: DataFrame,
                      listed: DataFrame, addresses: DataFrame, limit=None) -> dict:
    """places: named places and pitches inside the communes, far from every known venue and candidate, with the
    nearest venue's name and the nearest address. names: (leader, nom), every name of the places' clusters, in long
    form because a cluster may hold very many."""
    places = mapped.sporting_places(elements).unionByName(mapped.multisport_pitches(features))
    layer = F.when(c("source") == "BD TOPO (city-stade)", 1).otherwise(0)
    ident = F.concat_ws("|", layer.cast("string"), F.coalesce("osm", F.lit("")), F.format_string("%.7f", "lat"), F.format_string("%.7f", "lon"), "nom")
    # toponyms lead before pitches; within a layer by a hash, so that chains of leaders stay short
    places = places.withColumn("place_id", ident).withColumn("seq", F.struct(layer.alias("layer"), F.md5("place_id").alias("hash")))
    places = cut_lineage(places)
    inside = audit.in_communes(places, mapped.commune_rings(communes))
    grouped = cut_lineage(cluster.leader_groups(
        cut_lineage(inside.withColumnRenamed("place_id", "id")), 200.0, ["seq"]).withColumnRenamed("id", "place_id"))
    heads = audit.unknown_places(audit.cluster_heads(grouped), venues)
    left = cut_lineage(audit.not_already_listed(heads, listed))
    address = audit.nearest_address(left, addresses, "place_id").select("place_id", "city", "street", "postcode")
    known = venues.select(c("id").alias("near_id"), c("nom").alias("near_name"))
    left = left.join(address, "place_id", "left").join(shuffled(known), "near_id", "left").orderBy(F.desc("near_m"), "place_id")
    left = left if limit is None else left.limit(limit)
    return {"places": left, "names": audit.cluster_names(grouped).join(left.select("leader"), "leader", "left_semi")}


def check_contributions(records: DataFrame, photo_files: DataFrame) -> DataFrame:
    """Every error of every patch; pass it to `validation.require_none` to fail a run."""
    is_text = F.schema_of_variant(F.try_variant_get("record", "$.id", "variant")) == "STRING"  # others have no id
    idents = records.select("file", "pos", F.when(is_text, F.try_variant_get("record", "$.id", "string")).alias("id"))
    return (validation.record_errors(records).unionByName(validation.duplicate_ids(idents))
            .unionByName(validation.photo_file_errors(records, photo_files)))
