"""Places and routes from the JSON answers of lookup services, kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACES = "array<struct<lat:string,lon:string,display_name:string>>"
ROUTES = "struct<code:string,routes:array<struct<distance:double,duration:double,geometry:struct<coordinates:array<array<double>>>>>>"


def places(answers: DataFrame, body: str = "body") -> DataFrame:
    """The first place of each answer: its name and coordinates (null where the answer has none or can't be read)."""
    first = F.get(F.from_json(body, PLACES), F.lit(0))
    rows = answers.withColumn("_p", first)
    return rows.withColumns(
        {"lat": F.col("_p.lat").try_cast("double"), "lon": F.col("_p.lon").try_cast("double"), "place": F.col("_p.display_name")}
    ).drop("_p")


def geocoded(queries: DataFrame, known: DataFrame, on: str = "query") -> DataFrame:
    """Queries with the place of the answer kept for them, if any."""
    return queries.join(places(known), on, "left")


def _first_route(body: str):
    answer = F.from_json(body, ROUTES)
    return F.when(answer["code"] == "Ok", F.get(answer["routes"], F.lit(0)))


def routes(answers: DataFrame, key: str = "route_id", body: str = "body") -> DataFrame:
    """key, distance_m and duration_s of each answer's first route; nulls for failed answers."""
    rows = answers.withColumn("_r", _first_route(body))
    return rows.select(key, F.col("_r.distance").alias("distance_m"), F.col("_r.duration").alias("duration_s"))


def route_points(answers: DataFrame, key: str = "route_id", body: str = "body") -> DataFrame:
    """key, seq, lat and lon of the first route's points; answers give longitude first."""
    rows = answers.withColumn("_r", _first_route(body)).select(key, F.posexplode("_r.geometry.coordinates").alias("seq", "_c"))
    return rows.select(key, "seq", F.col("_c")[1].alias("lat"), F.col("_c")[0].alias("lon"))
