"""Sun position, clear sky and energy on tilted surfaces, in closed form.

Angles are in degrees, azimuths from north over east, times in epoch seconds
(UTC).  Everything stays in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogable.functions.columns import clip, first_true, num

YEAR_START = 1_735_689_600  # 2025-01-01T00:00Z
J2000 = 946_728_000
HOURS = 8760
SOLAR_CONSTANT, DERATE, ALBEDO = 1367.0, 0.75, 0.2


def hourly_year(spark: SparkSession) -> DataFrame:
    """hour, epoch, doy for each hour of the reference year."""
    h = F.col("id")
    return spark.range(HOURS).select(h.alias("hour"), (F.lit(YEAR_START) + h * 3600).alias("epoch"), (F.floor(h / 24) + 1).cast("long").alias("doy"))


def solar_position(times: DataFrame, lat: float | Column, lng: float | Column) -> DataFrame:
    """``times`` (with epoch) with elevation, azimuth and sin_elevation of the sun."""
    lat, lng = (x if isinstance(x, Column) else num(x) for x in (lat, lng))
    sin, cos = (lambda c: F.sin(F.radians(F.col(c)))), (lambda c: F.cos(F.radians(F.col(c))))
    df = times.withColumn("_n", (F.col("epoch") - J2000) / num(86400)).withColumn("_utc", F.pmod(F.col("epoch"), F.lit(86400)) / num(3600))
    df = df.withColumns({"_l": F.pmod(num(280.460) + num(0.9856474) * F.col("_n"), num(360)), "_g": F.pmod(num(357.528) + num(0.9856003) * F.col("_n"), num(360)), "_ep": num(23.439) - num(4e-7) * F.col("_n"), "_gmst": F.pmod(num(6.697375) + num(0.0657098242) * F.col("_n") + F.col("_utc"), num(24))})
    df = df.withColumn("_lam", F.col("_l") + num(1.915) * sin("_g") + num(0.020) * F.sin(F.radians(2 * F.col("_g"))))
    df = df.withColumns({"_ra": F.degrees(F.atan2(cos("_ep") * sin("_lam"), cos("_lam"))), "_dec": F.asin(sin("_ep") * sin("_lam")), "_phi": F.radians(lat)})
    df = df.withColumn("_ha", F.radians(F.pmod((F.col("_gmst") + lng / 15) * 15 - F.col("_ra") + 180, num(360)) - 180))
    up = clip(F.sin("_dec") * F.sin("_phi") + F.cos("_dec") * F.cos("_phi") * F.cos("_ha"), -1, 1)
    turn = F.degrees(F.atan2(-F.sin("_ha"), F.tan("_dec") * F.cos("_phi") - F.sin("_phi") * F.cos("_ha")))
    return df.withColumns({"sin_elevation": up, "elevation": F.degrees(F.asin(up)), "azimuth": F.pmod(turn, num(360))}).drop("_n", "_utc", "_l", "_g", "_ep", "_gmst", "_lam", "_ra", "_dec", "_phi", "_ha")


def clear_sky(df: DataFrame) -> DataFrame:
    """With ghi, dni, dhi in W/m2 of rows with sin_elevation and doy."""
    up = F.col("sin_elevation")
    df = df.withColumn("ghi", F.when(up > 0, num(1098) * up * F.exp(num(-0.059) / F.when(up > 0, up).otherwise(num(1)))).otherwise(num(0)))
    extra = num(SOLAR_CONSTANT) * (1 + num(0.033) * F.cos(num(2) * F.pi() * F.col("doy") / num(365)))
    high = up > 0.01
    df = df.withColumn("_kt", F.when(high, clip(F.col("ghi") / (extra * F.when(high, up).otherwise(num(1))), 0, 1)).otherwise(num(0)))
    k = F.col("_kt")
    kd = first_true((k <= 0.22, 1 - num(0.09) * k), (k <= 0.80, num(0.9511) - num(0.1604) * k + num(4.388) * k * k - num(16.638) * k * k * k + num(12.336) * k * k * k * k), default=num(0.165))
    df = df.withColumn("dhi", F.when(high, F.col("ghi") * kd).otherwise(num(0)))
    return df.withColumn("dni", F.when(high, (F.col("ghi") - F.col("dhi")) / F.when(high, up).otherwise(num(1))).otherwise(num(0))).drop("_kt")


def plane_of_array(sun_up: Column, sun_azimuth: Column, dni: Column, dhi: Column, ghi: Column, pitch: Column, azimuth: Column, albedo: float = ALBEDO) -> Column:
    """W/m2 on a tilted surface: beam, isotropic sky, ground."""
    flat = F.sqrt(F.greatest(num(0), 1 - sun_up * sun_up))
    b = F.radians(pitch)
    beam = dni * F.greatest(num(0), sun_up * F.cos(b) + flat * F.sin(b) * F.cos(F.radians(sun_azimuth - azimuth)))
    return beam + dhi * (1 + F.cos(b)) / 2 + ghi * num(albedo) * (1 - F.cos(b)) / 2


def sunlit_year(spark: SparkSession, lat: float, lng: float) -> DataFrame:
    """Hours with the sun up, with position and irradiance: 8760 rows at most, whatever the input."""
    return clear_sky(solar_position(hourly_year(spark), lat, lng)).filter("sin_elevation > 0")


def annual_energy(spark: SparkSession, sections: DataFrame, lat: float, lng: float, albedo: float = ALBEDO) -> DataFrame:
    """sections (azimuth, pitch, area) with kwh_m2 and kwh of a year.

    Each distinct orientation is integrated once; the year (a fixed number of
    rows) is broadcast to the orientations, and sections look up their own.
    """
    year = sunlit_year(spark, lat, lng).select("sin_elevation", F.col("azimuth").alias("sun_azimuth"), "dni", "dhi", "ghi")
    ways = sections.select("azimuth", "pitch").distinct()
    poa = plane_of_array(F.col("sin_elevation"), F.col("sun_azimuth"), F.col("dni"), F.col("dhi"), F.col("ghi"), F.col("pitch"), F.col("azimuth"), albedo)
    energy = ways.join(F.broadcast(year)).groupBy("azimuth", "pitch").agg((F.sum(poa) / 1000 * DERATE).alias("kwh_m2"))
    return sections.join(energy, ["azimuth", "pitch"]).withColumn("kwh", F.col("kwh_m2") * F.col("area"))


def stratified_samples(spark: SparkSession, samples: int = 120) -> DataFrame:
    """Mid-month instants, equally spaced over the day: sample, month, epoch, doy, weight (hours each stands for)."""
    per_month = max(1, max(12, int(samples)) // 12)
    k = F.col("id")
    month, slot = (F.floor(k / per_month) + 1).cast("int"), (k % per_month).cast("double")
    hour = (slot + 0.5) * num(24.0 / per_month)
    minute = F.least(F.bround((hour - F.floor(hour)) * 60, 0), num(59))
    day = F.make_date(F.lit(2025), month, F.when(month == 2, 14).otherwise(16))
    epoch = F.unix_date(day).cast("long") * 86400 + F.floor(hour) * 3600 + minute.cast("long") * 60
    return spark.range(per_month * 12).select(k.alias("sample"), month.alias("month"), epoch.cast("long").alias("epoch"), F.dayofyear(day).cast("long").alias("doy"), num(8760.0 / (per_month * 12)).alias("weight"))


def sun_vectors(df: DataFrame) -> DataFrame:
    """With sx, sy, sz (east, up, south) towards the sun."""
    flat = F.cos(F.radians("elevation"))
    return df.withColumns({"sx": flat * F.sin(F.radians("azimuth")), "sy": F.sin(F.radians("elevation")), "sz": -flat * F.cos(F.radians("azimuth"))})
