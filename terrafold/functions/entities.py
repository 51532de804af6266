"""Entity ids, records and request parameters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARCEL = "urn:ngsi-ld:AgriParcel:"
#: Metric names and the records' attributes.
RECORD_ATTRIBUTES = {
    "solar_radiation": "solarRadiation", "soil_moisture": "soilMoistureVwc", "soil_temperature": "soilTemperature", "relative_humidity": "relativeHumidity", "eto": "eto",
    "water_balance": "waterBalance", "frost_risk": "frostRisk", "temperature_avg": "airTemperatureAvg", "temperature_min": "airTemperatureMin",
}
ZONE_ATTRIBUTES = {"t_min": "tMin", "t_max": "tMax", "eto": "eto", "water_balance": "waterBalance"}
SECTORS = ("flat", "N", "NE", "E", "SE", "S", "SW", "W", "NW")


def parcel_urn(id_: Column) -> Column:
    """The id with the parcel prefix; a full one stays."""
    return F.when(F.startswith(id_, F.lit(PARCEL)), id_).otherwise(F.concat(F.lit(PARCEL), id_))


def any_urn(id_: Column) -> Column:
    return F.when(F.startswith(id_, F.lit("urn:")), id_).otherwise(F.concat(F.lit(PARCEL), id_))


def short_id(id_: Column) -> Column:
    """What follows the last colon, other signs than letters and digits as dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(id_, ":"), -1), "[^A-Za-z0-9]", "-"), "^-+|-+$", "")


def metric_list(text: Column) -> Column:
    """Names of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def unknown_metrics(names: Column, known: tuple[str, ...]) -> Column:
    return F.array_except(names, F.array(*map(F.lit, known)))


def crop_key(crop: Column, stage: Column) -> Column:
    return F.concat(F.lit("urn:ngsi-ld:AgriCrop:"), F.replace(crop, F.lit(" "), F.lit("_")), F.lit("_"), F.replace(stage, F.lit(" "), F.lit("_")))


def _property(value: Column) -> Column:
    return F.struct(F.lit("Property").alias("type"), value.alias("value"))


def record_id(tenant: Column, parcel: Column, observed_at: Column) -> Column:
    return F.concat(F.lit("urn:ngsi-ld:AgriParcelRecord:weather-"), tenant, F.lit("-"), short_id(parcel), F.lit("-"), F.regexp_replace(observed_at, "[^0-9]", ""))


def parcel_record(tenant: Column, parcel: Column, observed_at: Column, means: dict[str, Column]) -> Column:
    """The record as JSON: known metrics by their attribute, null ones left out."""
    fields = [_property(c).alias(RECORD_ATTRIBUTES[m]) if c is not None else None for m, c in means.items() if m in RECORD_ATTRIBUTES]
    present = [F.when(means[m].isNotNull(), f).alias(RECORD_ATTRIBUTES[m]) for m, f in zip([m for m in means if m in RECORD_ATTRIBUTES], fields)]
    head = [record_id(tenant, parcel, observed_at).alias("id"), F.lit("AgriParcelRecord").alias("type"), F.struct(F.lit("Relationship").alias("type"), parcel.alias("object")).alias("hasAgriParcel")]
    return F.to_json(F.struct(*head, _property(F.struct(F.lit("DateTime").alias("@type"), observed_at.alias("@value"))).alias("dateObserved"), *present))


def zone_entity_id(tenant: Column, parcel: Column, zone: Column) -> Column:
    return F.concat(F.lit("urn:ngsi-ld:AgriParcelZone:"), tenant, F.lit(":"), short_id(parcel), F.lit(":"), F.coalesce(zone, F.lit("unknown")))


def zone_entity(tenant: Column, parcel: Column, zone: Column, observed_at: Column, numbers: dict[str, Column], metrics: dict[str, Column], sensor: Column | None = None, distance: Column | None = None) -> Column:
    """The zone as JSON with a static id; area only if known, sensor fields only if both are."""
    named = [F.when(c.isNotNull(), _property(c)).alias(n) for n, c in numbers.items()]
    if sensor is not None and distance is not None:
        both = sensor.isNotNull() & distance.isNotNull()
        named += [F.when(both, _property(sensor)).alias("nkz:sensorNearby"), F.when(both, _property(distance)).alias("nkz:sensorDistanceM")]
    found = [F.when(c.isNotNull(), F.struct(F.lit("Property").alias("type"), c.cast("double").alias("value"), observed_at.alias("observedAt"))).alias(ZONE_ATTRIBUTES[m]) for m, c in metrics.items() if m in ZONE_ATTRIBUTES]
    head = [zone_entity_id(tenant, parcel, zone).alias("id"), F.lit("AgriParcelZone").alias("type"), F.struct(F.lit("Relationship").alias("type"), parcel.alias("object")).alias("hasAgriParcel")]
    return F.to_json(F.struct(*head, _property(zone).alias("nkz:zoneId"), *named, *found))


def sector_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SECTORS)), (code + 1).cast("int"))
