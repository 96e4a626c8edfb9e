"""A global order as columns, over range partitions of any number."""
import random

from pyspark.sql import functions as F
import pytest

from ringside.operators import facets, ranking


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_places_and_previous_values(spark, parts):
    pick = random.Random(1)
    rows = [(i, pick.randrange(5), pick.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, v string").repartition(3)
    order = sorted(rows, key=lambda r: (r[1], -r[0]))
    placed = {r.id: r.position for r in ranking.placed(df, ["k", -F.col("id")], parts=parts).collect()}
    assert placed == {r[0]: i for i, r in enumerate(order)}
    before = {r.id: r.before for r in ranking.with_previous(df, ["k", -F.col("id")], F.struct("v"), parts=parts).collect()}
    assert {i: b and b.v for i, b in before.items()} == {r[0]: (order[i - 1][2] if i else None) for i, r in enumerate(order)}
    assert before[order[0][0]] is None
    assert ranking.placed(df.limit(0), ["k"]).count() == 0 and ranking.with_previous(df.limit(0), ["k"], F.col("v")).count() == 0


def test_a_city_of_very_many_spellings_spreads_over_the_parts(spark):
    pick = random.Random(2)
    spelled = ["".join(pick.choice((x, x.upper())) for x in "saint-jean-de-monts") for _ in range(10_000)]
    rows = [(f"i{i:05}", "44", v, f"n{pick.randrange(50)}") for i, v in enumerate(spelled)]
    df = spark.createDataFrame(rows, "id string, dep string, ville string, nom string")
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    want = {(r[2], r[0]) for i, r in enumerate(order) if not i or order[i - 1][2] != r[2]}
    assert {(r.heading, r.id) for r in facets.list_headings(df).collect()} == want
    parts = ranking._dealt(df, [F.lower("ville"), "nom", "id"], 8).groupBy("_part").count().collect()
    assert len(parts) == 8 and max(p["count"] for p in parts) < 2500
