"""Queries of the solar family."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogable.functions.columns import fixed
from heliogable.operators import solar
from heliogable.plans.base import bridge, query

LAT, LNG = 42.36, -71.06

POSITION = """
n AS (SELECT *, (epoch - 946728000) / 86400.0::DOUBLE AS n, (epoch % 86400) / 3600.0::DOUBLE AS utc FROM t),
a AS (SELECT *, (280.460::DOUBLE + 0.9856474::DOUBLE * n) - 360 * floor((280.460::DOUBLE + 0.9856474::DOUBLE * n) / 360) AS l,
             (357.528::DOUBLE + 0.9856003::DOUBLE * n) - 360 * floor((357.528::DOUBLE + 0.9856003::DOUBLE * n) / 360) AS g, 23.439::DOUBLE - 0.0000004::DOUBLE * n AS ep,
             (6.697375::DOUBLE + 0.0657098242::DOUBLE * n + utc) - 24 * floor((6.697375::DOUBLE + 0.0657098242::DOUBLE * n + utc) / 24) AS gmst FROM n),
b AS (SELECT *, l + 1.915::DOUBLE * sin(radians(g)) + 0.020::DOUBLE * sin(radians(2 * g)) AS lam FROM a),
c AS (SELECT *, degrees(atan2(cos(radians(ep)) * sin(radians(lam)), cos(radians(lam)))) AS ra, asin(sin(radians(ep)) * sin(radians(lam))) AS dec, radians(42.36::DOUBLE) AS phi FROM b),
d AS (SELECT *, (gmst + -71.06::DOUBLE / 15) * 15 - ra AS h0 FROM c),
e AS (SELECT *, radians(h0 - 360 * floor((h0 + 180) / 360)) AS ha FROM d),
f AS (SELECT *, greatest(-1, least(1, sin(dec) * sin(phi) + cos(dec) * cos(phi) * cos(ha))) AS up, degrees(atan2(-sin(ha), tan(dec) * cos(phi) - sin(phi) * cos(ha))) AS turn FROM e),
pos AS (SELECT *, degrees(asin(up)) AS elevation, CASE WHEN turn < 0 THEN turn + 360 ELSE turn END AS azimuth FROM f)"""
HOURLY = "t AS (SELECT range AS hour, 1735689600 + range * 3600 AS epoch, range // 24 + 1 AS doy FROM range(8760))"
SKY = """
g1 AS (SELECT *, CASE WHEN up > 0 THEN 1098 * up * exp(-0.059 / up) ELSE 0 END AS ghi, 1367 * (1 + 0.033 * cos(2 * pi() * doy / 365)) AS i0 FROM pos),
g2 AS (SELECT *, CASE WHEN up > 0.01 THEN greatest(0, least(1, ghi / (i0 * up))) ELSE 0 END AS kt FROM g1),
g3 AS (SELECT *, CASE WHEN up > 0.01 THEN ghi * CASE WHEN kt <= 0.22 THEN 1 - 0.09 * kt WHEN kt <= 0.80 THEN 0.9511 - 0.1604 * kt + 4.388 * kt ** 2 - 16.638 * kt ** 3 + 12.336 * kt ** 4 ELSE 0.165 END ELSE 0 END AS dhi FROM g2),
sky AS (SELECT *, CASE WHEN up > 0.01 THEN (ghi - dhi) / up ELSE 0 END AS dni FROM g3)"""
SAMPLES = """
k AS (SELECT range AS sample, range // 10 + 1 AS month, ((range % 10) + 0.5) * 2.4::DOUBLE AS hh FROM range(120)),
t AS (SELECT sample, month, make_date(2025, month::INT, CASE month WHEN 2 THEN 14 ELSE 16 END) AS day, dayofyear(make_date(2025, month::INT, CASE month WHEN 2 THEN 14 ELSE 16 END)) AS doy,
             CAST(epoch(make_date(2025, month::INT, CASE month WHEN 2 THEN 14 ELSE 16 END)) AS BIGINT) + CAST(floor(hh) AS BIGINT) * 3600 + CAST(least(59, round_even((hh - floor(hh)) * 60, 0)) AS BIGINT) * 60 AS epoch FROM k)"""


@query("solar_position_hourly", f"WITH {HOURLY}, {POSITION} SELECT hour, epoch, round(elevation, 6) + 0.0 AS elevation, round(azimuth, 6) + 0.0 AS azimuth FROM pos")
def solar_position_hourly(spark, sf_dir):
    df = solar.solar_position(solar.hourly_year(spark), LAT, LNG)
    return df.select("hour", "epoch", fixed("elevation", 6).alias("elevation"), fixed("azimuth", 6).alias("azimuth"))


@query("clear_sky_split", f"WITH {HOURLY}, {POSITION}, {SKY} SELECT hour, round(ghi, 4) + 0.0 AS ghi, round(dni, 4) + 0.0 AS dni, round(dhi, 4) + 0.0 AS dhi FROM sky")
def clear_sky_split(spark, sf_dir):
    df = solar.clear_sky(solar.solar_position(solar.hourly_year(spark), LAT, LNG))
    return df.select("hour", *[fixed(c, 4).alias(c) for c in ("ghi", "dni", "dhi")])


@query(
    "poa_transposition",
    f"""WITH {HOURLY}, {POSITION}, {SKY}, s AS (SELECT * FROM (VALUES (1, 25.0, 180.0), (2, 25.0, 0.0), (3, 25.0, 90.0), (4, 25.0, 270.0), (5, 0.0, 0.0)) AS v(surface, pitch, face))
    SELECT surface, hour, round(dni * greatest(0, up * cos(radians(pitch)) + sqrt(1 - up * up) * sin(radians(pitch)) * cos(radians(azimuth - face)))
           + dhi * (1 + cos(radians(pitch))) / 2 + ghi * 0.2 * (1 - cos(radians(pitch))) / 2, 4) + 0.0 AS poa FROM sky CROSS JOIN s WHERE up > 0""",
)
def poa_transposition(spark, sf_dir):
    surfaces = spark.createDataFrame([(1, 25.0, 180.0), (2, 25.0, 0.0), (3, 25.0, 90.0), (4, 25.0, 270.0), (5, 0.0, 0.0)], "surface int, pitch double, face double")
    df = solar.sunlit_year(spark, LAT, LNG).join(F.broadcast(surfaces))
    poa = solar.plane_of_array(F.col("sin_elevation"), F.col("azimuth"), F.col("dni"), F.col("dhi"), F.col("ghi"), F.col("pitch"), F.col("face"))
    return df.select("surface", "hour", fixed(poa, 4).alias("poa"))


@query(
    "shading_annual",
    f"""WITH {HOURLY}, {POSITION}, {SKY}, w AS (SELECT up, azimuth AS az, dni, dhi, ghi FROM sky WHERE up > 0),
    o AS (SELECT s.azimuth, s.pitch, sum(dni * greatest(0, up * cos(radians(pitch)) + sqrt(1 - up * up) * sin(radians(pitch)) * cos(radians(az - s.azimuth)))
          + dhi * (1 + cos(radians(pitch))) / 2 + ghi * 0.2 * (1 - cos(radians(pitch))) / 2) / 1000 * 0.75 AS e FROM (SELECT DISTINCT azimuth, pitch FROM sections) AS s CROSS JOIN w GROUP BY 1, 2)
    SELECT section_id, azimuth, pitch, area, round(e, 2) AS kwh_m2, round(e * area, 1) AS kwh FROM sections JOIN o USING (azimuth, pitch)""",
    "sections",
)
def shading_annual(spark, sf_dir):
    df = solar.annual_energy(spark, bridge(spark, sf_dir, "sections"), LAT, LNG)
    return df.select("section_id", "azimuth", "pitch", "area", fixed("kwh_m2", 2).alias("kwh_m2"), fixed("kwh", 1).alias("kwh"))


@query(
    "observed_range",
    f"""WITH {HOURLY}, {POSITION}, {SKY}, w AS (SELECT up, azimuth AS az, dni, dhi, ghi FROM sky WHERE up > 0),
    o AS (SELECT s.azimuth, s.pitch, sum(dni * greatest(0, up * cos(radians(pitch)) + sqrt(1 - up * up) * sin(radians(pitch)) * cos(radians(az - s.azimuth)))
          + dhi * (1 + cos(radians(pitch))) / 2 + ghi * 0.2 * (1 - cos(radians(pitch))) / 2) / 1000 * 0.75 AS e FROM (SELECT DISTINCT azimuth, pitch FROM sections) AS s CROSS JOIN w GROUP BY 1, 2)
    SELECT count(*) AS sections, round(min(e), 2) AS min_kwh_m2, round(max(e), 2) AS max_kwh_m2, round(sum(e * area), 0) AS total_kwh FROM sections JOIN o USING (azimuth, pitch)""",
    "sections",
)
def observed_range(spark, sf_dir):
    df = solar.annual_energy(spark, bridge(spark, sf_dir, "sections"), LAT, LNG)
    return df.agg(F.count("*").alias("sections"), fixed(F.min("kwh_m2"), 2).alias("min_kwh_m2"), fixed(F.max("kwh_m2"), 2).alias("max_kwh_m2"), fixed(F.sum("kwh"), 0).alias("total_kwh"))


@query("stratified_samples", f"WITH {SAMPLES} SELECT sample, month::INT AS month, epoch, doy, 73.0::DOUBLE AS weight FROM t")
def stratified_samples(spark, sf_dir):
    return solar.stratified_samples(spark)


@query(
    "sun_vectors",
    f"""WITH {SAMPLES}, {POSITION} SELECT sample, round(cos(radians(elevation)) * sin(radians(azimuth)), 6) + 0.0 AS sx, round(sin(radians(elevation)), 6) + 0.0 AS sy,
    round(-cos(radians(elevation)) * cos(radians(azimuth)), 6) + 0.0 AS sz FROM pos""",
)
def sun_vectors(spark, sf_dir):
    df = solar.sun_vectors(solar.solar_position(solar.stratified_samples(spark), LAT, LNG))
    return df.select("sample", *[fixed(c, 6).alias(c) for c in ("sx", "sy", "sz")])
