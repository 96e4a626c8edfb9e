"""Sparse community patches laid over the venues, key by key.

A patch key has three states: absent, null and valued. Patches are folded per venue with one
aggregation (latest present value of each key wins), then meet the venues in one full outer
join on the id the rollup is already partitioned by.
"""
from pyspark.sql import DataFrame, functions as F, types as T

from ringside import vocab

PHOTO = T.StructType([T.StructField(k, T.StringType()) for k in vocab.PHOTO_KEYS])
REVIEW = T.StructType([T.StructField("auteur", T.StringType()), T.StructField("date", T.StringType()),
                       T.StructField("note", T.IntegerType()), T.StructField("texte", T.StringType())])

PATCH_TYPE = {
    **{k: "string" for k in vocab.PATCH_STRINGS}, **{k: "boolean" for k in vocab.PATCH_BOOLS},
    **{k: "int" for k in vocab.PATCH_INTS}, **{k: "double" for k in vocab.PATCH_NUMBERS},
    **{k: "array<string>" for k in vocab.PATCH_LISTS},
    "photos": f"array<{PHOTO.simpleString()}>", "avis": f"array<{REVIEW.simpleString()}>",
}
# a declared value, given without its estimate, clears the estimate
CLEARS = {"agres": "agres_probables", "longueur_piste": "longueur_probable"}
# fixed values: a venue the census does not know
NEW_VENUE = {"nom": "", "adresse": "", "ville": "", "scolaire": False, "piste": True,
             "couvert": False, "eclairage": False, "acces_libre": False, "ouvert_public": False,
             "vestiaires": False, "douches": False, "sanitaires": False, "nb_sautoirs": 0,
             "nb_aires_lancer": 0}


def fold_patches(patches: DataFrame, order=("seq",), keys=None, clears=None) -> DataFrame:
    """One row per id: `has_<key>` and the latest present value of each key.

    patches: id, keys array<string> (the keys present, nulls included), the order columns and
    one typed column per key.
    """
    keys = [k for k in (keys or vocab.PATCH_KEYS) if k in patches.columns]
    clears = CLEARS if clears is None else clears
    seq = F.struct(*order) if len(order) > 1 else F.col(order[0])
    has = lambda key: F.array_contains("keys", key)
    clearing = {target: trigger for trigger, target in clears.items()}

    def told(key):
        return has(key) | has(clearing[key]) if key in clearing else has(key)

    aggs = []
    for key in keys:
        value = F.when(has(key), F.col(key)) if key in clearing else F.col(key)
        aggs += [F.bool_or(told(key)).alias(f"has_{key}"),
                 F.max_by(value, F.when(told(key), seq)).alias(key)]
    return patches.groupBy("id").agg(F.count("*").alias("n_patches"), *aggs)


def apply_patches(venues: DataFrame, patches: DataFrame, order=("seq",), keys=None,
                  clears=None) -> DataFrame:
    """Venues with the patches applied; unknown ids become new venues, deleted ones go."""
    keys = [k for k in (keys or vocab.PATCH_KEYS) if k in patches.columns]
    folded = fold_patches(patches, order, keys, clears)
    ov, base = folded.alias("ov"), venues.alias("base")
    is_new = F.col("base.id").isNull()
    touched = F.col("ov.id").isNotNull()
    types = dict(venues.dtypes)
    columns = [F.coalesce("base.id", "ov.id").alias("id")]
    for name in list(venues.columns) + [k for k in keys if k not in venues.columns]:
        if name == "id":
            continue
        kept = F.col(f"base.{name}") if name in types else F.lit(None)
        if name in NEW_VENUE:
            kept = F.when(is_new, F.lit(NEW_VENUE[name])).otherwise(kept)
        if name in vocab.PATCH_LISTS:
            kept = F.coalesce(kept, F.array().cast("array<string>"))
        if name == "source":
            kept = (F.when(is_new & (F.col("ov.n_patches") == 1), F.lit("communaute"))
                    .when(touched, F.lit("res+communaute")).otherwise(kept))
        if name in keys:
            value = F.col(f"ov.{name}")
            if name in vocab.PATCH_LISTS:
                value = F.array_sort(F.array_distinct(
                    F.coalesce(value, F.array().cast("array<string>"))))
            kept = F.when(F.coalesce(F.col(f"ov.has_{name}"), F.lit(False)), value).otherwise(kept)
        columns.append(kept.alias(name))
    merged = base.join(ov, F.col("base.id") == F.col("ov.id"), "full_outer").select(*columns)
    if "supprime" in merged.columns:
        merged = merged.where(~F.coalesce("supprime", F.lit(False))).drop("supprime")
    return merged
