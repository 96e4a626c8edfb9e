"""Who contributed what: names reconciled, a ranking, and the latest contributions."""
from pyspark.sql import DataFrame, Window, functions as F

from ringside.functions import text
from ringside.operators import spatial

c = F.col


def contributions(photos: DataFrame, reviews: DataFrame) -> DataFrame:
    """(author, kind, id): credits of photos and authors of reviews, blanks left out.

    photos: id, credit. reviews: id, author.
    """
    signed = photos.select(F.trim("credit").alias("author"), F.lit("photo").alias("kind"), "id")
    wrote = reviews.select(F.trim("author").alias("author"), F.lit("review").alias("kind"), "id")
    return signed.unionByName(wrote).where(text.present(c("author")))


def canonical_names(names: DataFrame, column="author") -> DataFrame:
    """(name, canonical): a short name goes to the longest name starting with it and a space.

    Each name offers its word prefixes; the best offer per prefix is one partial aggregate, so
    a first name shared by very many people costs no pairs. Ties go to the smaller name.
    """
    each = names.select(c(column).alias("name")).distinct().withColumn("_key", text.fold(c("name")))
    cuts = F.filter(F.sequence(F.lit(1), F.length("_key")),
                    lambda i: F.substring(c("_key"), i, F.lit(1)) == " ")
    offers = each.withColumn("_cut", F.explode(cuts)).select(
        F.substring(c("_key"), F.lit(1), c("_cut") - 1).alias("_key"),
        F.struct((-F.length("name")).alias("shortness"), c("name").alias("name")).alias("_offer"))
    best = offers.groupBy("_key").agg(F.min("_offer").alias("_best"))
    return each.join(best, "_key", "left").select(
        "name", F.coalesce("_best.name", "name").alias("canonical"))


def board(contributions_: DataFrame, names: DataFrame, top=200) -> DataFrame:
    """Venues, photos and reviews per canonical name, the most active first, with a rank."""
    # counted per author and venue before anything is joined, so a very active author is small
    each = contributions_.groupBy("author", "id").agg(
        F.count_if(c("kind") == "photo").alias("p"), F.count_if(c("kind") == "review").alias("a"))
    per_site = each.join(names, each["author"] == names["name"]).groupBy(c("canonical").alias("name"), "id").agg(
        F.sum("p").alias("p"), F.sum("a").alias("a"))
    totals = per_site.groupBy("name").agg(F.count("*").alias("sites"), F.sum("p").alias("photos"),
                                          F.sum("a").alias("reviews"))
    ranking = [F.desc("sites"), F.desc("photos"), F.desc("reviews"), F.asc("name")]
    first = totals.orderBy(*ranking).limit(top)            # top-k plan, bounded by `top`
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ranking)))


def contribution_dates(sites: DataFrame, history: DataFrame, files: DataFrame) -> DataFrame:
    """Date a venue's patch file was first added; its modification date without a history.

    history: id, status, date. files: id, mtime. No file, no date.
    """
    added = history.where(c("status") == "A").groupBy("id").agg(F.min("date").alias("added"))
    stamped = files.groupBy("id").agg(F.max("mtime").alias("mtime"))
    return sites.select("id").join(stamped, "id").join(added, "id", "left").select(
        "id", F.coalesce("added", "mtime").alias("date"))


def latest(with_photo: DataFrame, dates: DataFrame, first=200) -> DataFrame:
    """The newest dated contributions among venues that have a photo to show."""
    return with_photo.select("id").distinct().join(dates, "id").where(c("date").isNotNull()).orderBy(
        F.desc("date"), "id").limit(first).select("id", "date")


def latest_authors(latest_: DataFrame, contributions_: DataFrame, board_: DataFrame) -> DataFrame:
    """(id, date, author) of the latest contributions, authors under their canonical name.

    The board is at most `top` rows; a name or any of its word prefixes leads to the first
    full name of the board that starts with it.
    """
    words = F.split(c("name"), r"\s+")
    forms = board_.select("rank", "name", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(words)),
        lambda n: F.struct(F.lower(F.array_join(F.slice(words, F.lit(1), n), " ")).alias("form"),
                           (n < F.size(words)).alias("partial")))).alias("f"))
    canon = forms.groupBy(c("f.form").alias("_form")).agg(
        F.min_by("name", F.struct(c("f.partial"), c("rank"))).alias("_canon"))
    wrote = contributions_.select("id", "author").distinct()
    return latest_.join(wrote, "id").withColumn("_form", F.lower("author")).join(
        canon, "_form", "left").select("id", "date", F.coalesce("_canon", "author").alias("author")).distinct()


def imagery_years(samples: DataFrame, per_department=3) -> DataFrame:
    """(dep, year) where the first samples of a department agree; silent otherwise.

    samples: dep, seq, year.
    """
    few = spatial.keep_first(samples, ["dep"], ["seq"], per_department)
    agreed = few.where(c("year") != 0).groupBy("dep").agg(F.min("year").alias("year"), F.max("year").alias("_hi"))
    return agreed.where(c("year") == c("_hi")).select("dep", "year")
