"""Types of entities, and the span that every detector yields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers of the types, and aliases that parsing accepts.
TYPES = ["name", "address", "dob", "date", "phone", "fax", "email", "ssn", "mrn", "beneficiary", "account", "license", "vehicle", "device", "url", "ip", "biometric", "face"]
ALIASES = {"dateofbirth": "dob", "ipaddress": "ip"}
SOURCES = ["regex", "dataDetector", "structuredField", "nameEntity", "commonName", "userRule", "foundationModel", "face", "barcode", "manual"]

SPAN = "struct<start:int,end:int,value:string,type:string,confidence:double,source:string,disposition:string,enabled:boolean,detector_ord:int,match_ord:int>"
SPANS = f"array<{SPAN}>"


def parse_type(name: Column) -> Column:
    """The identifier of a type given by any spelling of its case or an alias; an unknown one stays as it is given."""
    low = F.lower(name)
    aliased = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), low), low)
    return F.when(aliased.isin(TYPES), aliased).otherwise(name)


def token_prefix(kind: Column) -> Column:
    return F.upper(kind)


def default_enabled(disposition: Column, enabled: Column | None = None) -> Column:
    redacts = disposition == "redact"
    return redacts if enabled is None else F.coalesce(enabled, redacts)


def clamp(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def span(start: Column, value: Column, kind: Column | str, confidence: float | Column, source: str, disposition: str | Column = "redact", detector: int = 0, match: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    place = start.cast("int")
    how = lit(disposition)
    return F.struct(
        place.alias("start"),
        (place + F.length(value)).cast("int").alias("end"),
        value.alias("value"),
        lit(kind).alias("type"),
        lit(confidence).cast("double").alias("confidence"),
        F.lit(source).alias("source"),
        how.alias("disposition"),
        default_enabled(how).alias("enabled"),
        F.lit(detector).cast("int").alias("detector_ord"),
        (F.lit(0) if match is None else match).cast("int").alias("match_ord"),
    )


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body) -> Column:
    """body(value), value evaluated once: inside lambdas the optimiser would else repeat it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)
