"""Equipment rows of the census rolled up into venues.

Every rule is a fixed-size partial aggregate (min_by, max_by, bool_or, max, min, count_if), so
a venue holding a large share of all rows is reduced on the map side and no list of its
equipment is ever built. The order of the rows, which "first seen wins" depends on, is an
explicit ordering key.

Rules over numbers and flags run as one hash aggregate; rules that pick a text by row order
need Spark's sort aggregate and run beside it over their own few columns. Both are partitioned
by venue number, so bringing them together moves no rows, and a query that only wants one of
the two never runs the other.
"""
from pyspark.sql import Column, DataFrame, functions as F

from ringside import vocab
from ringside.functions import numbers, text


def disciplines_of(label, type_name) -> Column:
    """struct<sure, maybe> of discipline names, for one equipment row."""
    def read(words):
        sure = F.array_sort(F.array_compact(F.array(
            *[F.when(words.rlike(pattern), F.lit(name)) for name, pattern in vocab.DISCIPLINE_PATTERNS])))
        vague = F.array_compact(F.array(F.when(words.contains("saut"), F.lit(vocab.UNKNOWN_JUMP))
                                        .when(words.contains("lancer"), F.lit(vocab.UNKNOWN_THROW))))
        return text.once(sure, lambda found: F.struct(found.alias("sure"), F.when(
            F.size(found) == 0, vague).otherwise(F.array().cast("array<string>")).alias("maybe")))
    return text.once(F.concat(text.fold(label), F.lit(" "), text.fold(type_name)), read)


def surface_code(label) -> Column:
    return text.label_of(text.fold(label), vocab.SURFACE_OF_LABEL)


def _any(flags):
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def prepare(equipment: DataFrame, order) -> DataFrame:
    """Typed, one row per equipment: the input of the rollup."""
    seq = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])
    c = F.col
    track = F.coalesce(c("equip_type_name").isin(*vocab.TRACK_TYPES), F.lit(False))
    located = F.coalesce((c("equip_coordonnees.lat") != 0) & (c("equip_coordonnees.lon") != 0),
                         F.lit(False))
    base = equipment.where(text.present(c("inst_numero"))).select(
        "*", seq.alias("_seq"), track.alias("_track"), located.alias("_located"),
        F.concat(text.fold(c("equip_nom")), F.lit(" "), text.fold(c("equip_type_name"))).alias("_words"),
        text.fold(c("equip_type_name")).alias("_type"),
        F.when(track, surface_code(c("equip_sol"))).alias("_surface"))
    return base.select("*", *[c("_words").rlike(pattern).alias(f"_d_{name}")
                              for name, pattern in vocab.DISCIPLINE_PATTERNS])


def rollup(equipment: DataFrame, order=("seq",)) -> DataFrame:
    """One venue per inst_numero. `order` names the columns that give the row order."""
    c = F.col
    rows = prepare(equipment, list(order))
    sure = _any([c(f"_d_{n}") for n in vocab.DISCIPLINES])
    jump = c("_type").contains("saut") | _any([c(f"_d_{n}") for n in vocab.JUMPS])
    throw = c("_type").contains("lancer") | _any([c(f"_d_{n}") for n in vocab.THROWS])
    on_track = lambda value: F.when(c("_track"), numbers.nonzero(value))
    some = lambda name: F.coalesce(F.bool_or(numbers.lenient_bool(c(name))), F.lit(False))
    # a filtered min_by: rows outside the filter get a null ordering and are skipped
    first_where = lambda value, keep: F.min_by(value, F.when(keep, c("_seq")))
    last_where = lambda value, keep: F.max_by(value, F.when(keep, c("_seq")))
    whole = lambda name: numbers.nonzero(numbers.lenient_int(c(name)))

    first = F.struct("inst_nom", "inst_adresse", "inst_cp", "new_name", "new_code", "dep_code",
                     "dep_nom", "reg_nom", "equip_prop_type", "equip_gest_type",
                     text.present(c("inst_uai")).alias("school"), "equip_coordonnees")
    at = c("equip_coordonnees")
    picked = rows.groupBy("inst_numero").agg(
        F.min_by(first, c("_seq")).alias("_first"),
        last_where(at, c("_track") & c("_located")).alias("_on_track"),
        first_where(at, c("_located")).alias("_anywhere"),
        first_where(c("_surface"), c("_surface").isNotNull()).alias("_surface"),
        first_where(c("equip_url"), text.present(c("equip_url"))).alias("_url"))
    counted = rows.groupBy("inst_numero").agg(
        F.bool_or("_track").alias("piste"),
        F.max(on_track(numbers.lenient_int(c("equip_piste_nb")))).alias("couloirs"),
        F.max(on_track(numbers.lenient_int(c("equip_piste_long")))).alias("longueur_piste"),
        F.coalesce(F.bool_or(c("_surface") == "synthetique"), F.lit(False)).alias("_synthetic"),
        F.coalesce(F.bool_or(c("_track") & c("equip_nature").isin(*vocab.COVERED_NATURES)),
                   F.lit(False)).alias("couvert"),
        *[F.bool_or(c(f"_d_{n}")).alias(f"_d_{n}") for n in vocab.DISCIPLINES],
        F.bool_or(~sure & c("_words").contains("saut")).alias("_some_jump"),
        F.bool_or(~sure & ~c("_words").contains("saut") & c("_words").contains("lancer"))
        .alias("_some_throw"),
        F.count_if(jump).alias("nb_sautoirs"),
        F.count_if(throw).alias("nb_aires_lancer"),
        some("equip_eclair").alias("eclairage"), some("equip_acc_libre").alias("acces_libre"),
        some("equip_ouv_public_bool").alias("ouvert_public"), some("equip_douche").alias("douches"),
        some("equip_sanit").alias("sanitaires"),
        F.coalesce(F.bool_or(numbers.lenient_int(c("equip_vest_sport")) != 0), F.lit(False))
        .alias("vestiaires"),
        F.max(whole("equip_trib_nb")).alias("tribunes"),
        F.min(whole("equip_service_date")).alias("annee"),
        F.max(whole("equip_travaux_date")).alias("renovation"))
    rolled = counted.join(picked, "inst_numero", "left")

    head = lambda name: c(f"_first.{name}")
    place = F.coalesce(c("_on_track"), F.when(head("equip_coordonnees.lat").isNotNull(),
                                              head("equip_coordonnees")), c("_anywhere"))
    names = lambda pairs: F.array_sort(F.array_compact(F.array(
        *[F.when(c(flag), F.lit(name)) for name, flag in pairs])))
    return rolled.select(
        c("inst_numero").alias("id"),
        text.smart_title(head("inst_nom")).alias("nom"),
        text.smart_title(head("inst_adresse")).alias("adresse"),
        head("inst_cp").alias("cp"), text.smart_title(head("new_name")).alias("ville"),
        head("new_code").alias("insee"), head("dep_code").alias("dep"),
        head("dep_nom").alias("dep_nom"), head("reg_nom").alias("region"),
        head("school").alias("scolaire"), place["lat"].alias("lat"), place["lon"].alias("lon"),
        "piste", "couloirs", "longueur_piste", F.lit(None).cast("int").alias("longueur_probable"),
        F.when(c("_synthetic"), F.lit("synthetique")).otherwise(c("_surface")).alias("surface"),
        "couvert", "eclairage", "acces_libre", "ouvert_public", "vestiaires", "douches",
        "sanitaires", "tribunes",
        names([(n, f"_d_{n}") for n in vocab.DISCIPLINES]).alias("agres"),
        names([(vocab.UNKNOWN_JUMP, "_some_jump"), (vocab.UNKNOWN_THROW, "_some_throw")])
        .alias("agres_probables"),
        "nb_sautoirs", "nb_aires_lancer", "annee", "renovation",
        text.normal_url(c("_url")).alias("url"),
        head("equip_prop_type").alias("proprietaire"),
        head("equip_gest_type").alias("gestionnaire"), F.lit("res").alias("source"))


def equipment_list(equipment: DataFrame, order=("seq",)) -> DataFrame:
    """Equipment of every venue in long form (internal, never published): no group is built."""
    return equipment.where(text.present(F.col("inst_numero"))).select(
        F.col("inst_numero").alias("id"), *order,
        F.coalesce("equip_type_name", F.lit("")).alias("type"),
        F.coalesce("equip_nom", F.lit("")).alias("nom"))
