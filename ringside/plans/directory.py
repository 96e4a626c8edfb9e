"""Facet and cell build, and the neighbourhood build, over the published venues."""
from pyspark.sql import DataFrame

from ringside.operators import facets, publish
from ringside.session import cut_lineage
from ringside.sources import published


def build_facets(venues: DataFrame, out: str, url_base: str) -> None:
    """Index, records, facet lists and geographic cells under `out`."""
    index = publish.index_rows(publish.publishable(venues))
    published.write_index(index, out)
    published.write_records(index, out, url_base)
    published.write_facets(index, out, url_base)
    published.write_cells(index, out)


def build_neighbourhood(venues: DataFrame, out: str) -> None:
    """Nearest venues, cities with what surrounds them, departments, criteria."""
    ready = cut_lineage(publish.publishable(venues))
    members = cut_lineage(facets.city_members(ready))
    towns = facets.cities(members)
    tables = {
        "neighbours": facets.neighbours(ready), "cities": towns,
        "around_cities": facets.around_cities(towns, ready, members=members), "departments": facets.department_index(ready),
        "criteria": facets.criterion_counts(ready),
        "criteria_by_department": facets.criterion_links(facets.criterion_by_department(ready))}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
