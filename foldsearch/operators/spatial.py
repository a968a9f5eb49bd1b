"""Points near other points, and the regions that contain a point.

*Near*: latitude strips as high as the distance, cut into cells about two distances wide at the strip's own latitude. A point probes
its own strip and the next one only, so each pair of strips is met once. Cells are joined by fragment-replicate: a crowded cell's
load is estimated as its number of pairs, and its probes are split over tasks.

*Inside*: crossing parity. Polygon edges are binned into latitude strips (and coarse longitude bins over the ring's extent), joined with the
points of the strip, and ray crossings are counted by point and region. An odd count is inside; a point on an edge or corner is
inside by definition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsearch.operators.skew import SHARD, TASK, place, plan_placement, replicate

EARTH_RADIUS_M = 6_371_008.8


def _lon_reach(lat: Column, angle: float) -> Column:
    """Largest difference in longitude (degrees) of points within ``angle`` (radians) of one at ``lat``; 180 where a pole is in reach."""
    polar = F.radians(F.abs(lat)) + angle >= math.pi / 2
    return F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(angle)) / F.cos(F.radians(lat))))) * (1 + 1e-9))


def _cells_in(strip: Column, height: float, angle: float) -> Column:
    """Number of longitude cells of a strip: about two reaches each at the strip's highest latitude."""
    south = strip * height - 90
    highest = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + height)))
    return F.greatest(F.lit(1), F.floor(F.lit(180.0) / _lon_reach(highest, angle))).cast("int")


def near_pairs(points: DataFrame, metres: float, tasks: int | None = None, radius: float = EARTH_RADIUS_M) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ``points`` (id unique, lat, lon in degrees) at most ``metres`` apart along a great circle.

    Points with a null coordinate have no pairs. Points at one place are pairs at distance 0. Poles and the date line need no special rows.
    """
    angle = metres / radius
    height = math.degrees(angle) * (1 + 1e-9)
    pts = points.where("lat is not null and lon is not null").select("id", "lat", "lon")
    strip = F.floor((F.col("lat") + 90) / height).cast("int")
    n_here = _cells_in(F.col("strip"), height, angle)
    homes = pts.withColumn("strip", strip).withColumn("n", n_here).select(
        "strip", F.pmod(F.floor((F.col("lon") + 180) / (F.lit(360.0) / F.col("n"))).cast("int"), F.col("n")).alias("cell"), F.col("id").alias("h_id"), F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon")
    )
    width = F.lit(360.0) / F.col("n")
    reach = _lon_reach(F.col("lat"), angle)
    covered = F.array_distinct(
        F.transform(
            F.sequence(F.floor((F.col("lon") - reach + 180) / width).cast("int"), F.floor((F.col("lon") + reach + 180) / width).cast("int")),
            lambda c: F.pmod(c, F.col("n")),
        )
    )
    probes = (
        pts.withColumn("own", strip)
        .withColumn("strip", F.explode(F.array(F.col("own"), F.col("own") + 1)))
        .withColumn("n", n_here)
        .select("id", "lat", "lon", "own", "strip", F.explode(covered).alias("cell"))
    )
    # A cell with n points costs about n pairs for each of them
    crowd = homes.groupBy("strip", "cell").agg(F.count(F.lit(1)).cast("double").alias("c"))
    plan = plan_placement(crowd, ["strip", "cell"], tasks, weight=F.col("c") + F.col("c") * F.col("c"))
    left = place(probes, ["strip", "cell"], plan, ["id"])
    right = replicate(homes, ["strip", "cell"], plan)
    hav = F.pow(F.sin(F.radians(F.col("h_lat") - F.col("lat")) / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("h_lat")) * F.pow(F.sin(F.radians(F.col("h_lon") - F.col("lon")) / 2), 2)
    met = left.join(right, [TASK, SHARD, "strip", "cell"]).where(
        ((F.col("own") < F.col("strip")) | (F.col("id") < F.col("h_id"))) & (hav <= math.sin(angle / 2) ** 2)
    )
    return met.select(F.least("id", "h_id").alias("id_a"), F.greatest("id", "h_id").alias("id_b"))


def ring_edges(areas: DataFrame) -> DataFrame:
    """(area, x1, y1, x2, y2, west, east): edges of the rings of ``areas`` (area, ys, xs). A repeated first corner adds a point-like edge.

    Rings that are null, of unequal lengths, with null corners or under three corners bound nothing and are left out.
    """
    whole = areas.where(
        "ys is not null and xs is not null and size(ys) = size(xs) and size(ys) >= 3 and not exists(ys, y -> y is null) and not exists(xs, x -> x is null)"
    )
    n = F.size("ys")
    corner = lambda a, i: F.element_at(a, i + 1)
    return whole.select(
        "area",
        F.array_min("xs").alias("west"),
        F.array_max("xs").alias("east"),
        F.inline(
            F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.struct(
                    corner(F.col("xs"), i).alias("x1"),
                    corner(F.col("ys"), i).alias("y1"),
                    corner(F.col("xs"), (i + 1) % n).alias("x2"),
                    corner(F.col("ys"), (i + 1) % n).alias("y2"),
                ),
            )
        ),
    )


def containing_areas(points: DataFrame, areas: DataFrame, strip_degrees: float = 0.25, bin_degrees: float = 4.0, tasks: int | None = None) -> DataFrame:
    """(id, area): the ``areas`` (area, ys, xs: one ring each, degrees, straight edges) that contain each of ``points`` (id, lat, lon).

    A ring that crosses the date line runs on beyond 180 and spans less than 360 degrees. Points on an edge or a corner are inside. Empty sides
    give no rows.
    """
    edges = ring_edges(areas)
    bins = int(round(360 / bin_degrees))
    lines = edges.withColumn("strip", F.explode(F.sequence(F.floor(F.least("y1", "y2") / strip_degrees).cast("int"), F.floor(F.greatest("y1", "y2") / strip_degrees).cast("int")))).withColumn(
        # the ray to an edge starts anywhere in the ring's extent, so the edge is in all its bins
        "bin",
        F.explode(
            F.array_distinct(
                F.transform(F.sequence(F.floor((F.col("west") + 180) / bin_degrees).cast("int"), F.floor((F.col("east") + 180) / bin_degrees).cast("int")), lambda b: F.pmod(b, F.lit(bins)))
            )
        ),
    )
    pts = points.where("lat is not null and lon is not null").select(
        "id", "lat", "lon", F.floor(F.col("lat") / strip_degrees).cast("int").alias("strip"), F.pmod(F.floor((F.col("lon") + 180) / bin_degrees).cast("int"), F.lit(bins)).alias("bin")
    )
    keys = ["strip", "bin"]
    # points without any edge in their bin are dropped before they are moved; both estimates are one row a bin
    n_edges = lines.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("e"))
    crowd = pts.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("c")).join(n_edges, keys)
    plan = plan_placement(crowd, keys, tasks, weight=F.col("c") * (F.col("e") + 1))
    left = place(pts.join(n_edges.select(*keys), keys, "left_semi"), keys, plan, ["id"])
    # the point's longitude as the ring counts it: the first turn at or east of the ring's west end
    x = F.col("lon") + 360 * F.ceil((F.col("west") - F.col("lon")) / 360)
    met = left.join(replicate(lines, keys, plan), [TASK, SHARD, *keys]).withColumn("x", x).where(
        (F.col("x") <= F.col("east")) & (F.col("lat") >= F.least("y1", "y2")) & (F.col("lat") <= F.greatest("y1", "y2"))
    )
    turn = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) - (F.col("x") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    on_edge = (turn == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    # half open in latitude, so that a ray through a corner crosses once or not at all
    spans = (F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))
    east_of = F.col("x") < F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.when(F.col("y1") == F.col("y2"), F.lit(1.0)).otherwise(F.col("y2") - F.col("y1"))
    crossings = met.groupBy(TASK, "id", "area").agg(
        F.sum(F.when(spans & east_of, 1).otherwise(0)).alias("crossed"), F.max(F.when(on_edge, 1).otherwise(0)).alias("touched")
    )
    return crossings.where((F.col("crossed") % 2 == 1) | (F.col("touched") == 1)).select("id", "area")
