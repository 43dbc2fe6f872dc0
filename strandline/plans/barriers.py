"""Queries on barriers along profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import barriers as B
from strandline.registry import register
from strandline.sources import tables as T

#: Mean high water of the profiles, and the levels at which sections are taken.
LEVEL, LEVELS = 2.0, [0.0, 2.5, 5.0]


@register()
def barrier_positions(spark, sf_dir):
    """Front and back of each transect's barrier, its crest, widths, slopes and volume."""
    found = B.barriers(T.profile(spark, sf_dir), "transect_id", "seq", "z", LEVEL)
    return found.select("transect_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "transect_id"])


@register(T.sql(""", s AS (SELECT transect_id, seq, z, unnest([0.0, 2.5, 5.0]::DOUBLE[]) AS level FROM v_profile),
n AS (SELECT *, lead(z) OVER (PARTITION BY transect_id, level ORDER BY seq) AS nz FROM s),
c AS (SELECT *, CASE WHEN (z < level AND nz >= level) OR (z >= level AND nz < level) THEN seq + (level - z) / (nz - z) END AS cut FROM n),
k AS (SELECT *, count(cut) OVER (PARTITION BY transect_id, level ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM c),
g AS (SELECT transect_id, level, count(cut) AS crossings, min(cut) FILTER (k = 1) - min(cut) FILTER (k = 0) AS w, sum(z - level) FILTER (k = 1) AS v FROM k GROUP BY ALL)
SELECT transect_id, level, crossings, round(CASE crossings WHEN 0 THEN 0 WHEN 1 THEN -9999 ELSE w END, 6) AS width, round(CASE crossings WHEN 0 THEN 0 WHEN 1 THEN -9999 ELSE v END, 6) AS volume FROM g""", "v_profile"))
def barrier_sections(spark, sf_dir):
    """Width and volume of each profile over levels, between its first two crossings of each."""
    s = B.sections(T.profile(spark, sf_dir), "transect_id", "seq", "z", LEVELS)
    return s.select("transect_id", "level", "crossings", F.round("width", 6).alias("width"), F.round("volume", 6).alias("volume"))
