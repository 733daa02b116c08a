"""Record standardisation (P1-P23, E3): names, mappings, aliases, typed
projection, provenance, enum parsing, nested-record cleaning.

Column-name-driven behaviour is resolved at plan time over ``df.columns``;
what runs per row is one ``select`` of Catalyst expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions.text import extract_rules
from ..functions.numeric import nz

# ---------------------------------------------------------------- fixed values
# First-present alias lists per standard field, per source kind (in order).
FILE_ALIASES = {
    "route_id": ["route_id", "id", "trip_id", "load_id", "Route ID", "Trip ID"],
    "route_date": ["date", "route_date", "trip_date", "load_date", "Date", "Route Date"],
    "driver_name": ["driver", "driver_name", "Driver", "Driver Name"],
    "vehicle_id": ["truck", "vehicle", "vehicle_id", "truck_id", "Vehicle", "Truck"],
    "customer_name": ["customer", "customer_name", "Customer", "Customer Name"],
    "origin_address": ["pickup", "origin", "pickup_address", "Origin", "Pickup"],
    "destination_address": ["delivery", "destination", "delivery_address", "Destination"],
    "total_miles": ["miles", "total_miles", "distance", "Miles", "Distance"],
    "revenue": ["revenue", "rate", "pay", "Revenue", "Rate"],
    "load_weight": ["weight", "load_weight", "Weight", "Load Weight"],
    "start_time": ["start_time", "pickup_time", "Start Time", "Pickup Time"],
    "end_time": ["end_time", "delivery_time", "End Time", "Delivery Time"],
    "status": ["status", "Status", "Trip Status"],
}
API_ALIASES = {
    "route_id": ["route_id", "id", "trip_id", "load_id"],
    "route_date": ["date", "route_date", "trip_date", "load_date", "dispatch_date"],
    "driver_name": ["driver", "driver_name", "driver_id"],
    "vehicle_id": ["truck", "vehicle", "vehicle_id", "truck_id"],
    "customer_name": ["customer", "customer_name", "shipper", "consignee"],
    "origin_address": ["pickup", "origin", "pickup_address", "origin_address"],
    "destination_address": ["delivery", "destination", "delivery_address", "destination_address"],
    "total_miles": ["miles", "total_miles", "distance", "total_distance"],
    "revenue": ["revenue", "rate", "pay", "total_pay"],
    "load_weight": ["weight", "load_weight", "cargo_weight"],
    "start_time": ["start_time", "pickup_time", "departure_time"],
    "end_time": ["end_time", "delivery_time", "arrival_time"],
    "status": ["status", "trip_status", "load_status"],
}
# The message header 'date' is *not* a route-date alias here (it is kept as
# email_date): a header date never parses as a route date.
EMAIL_ALIASES = {
    "route_id": ["route_id", "trip_id", "load_id", "job_id"],
    "route_date": ["trip_date", "pickup_date", "dispatch_date"],
    "driver_name": ["driver", "driver_name"],
    "vehicle_id": ["truck", "vehicle", "vehicle_id", "truck_number"],
    "customer_name": ["customer", "shipper", "consignee"],
    "origin_address": ["pickup", "origin", "from_address"],
    "destination_address": ["delivery", "destination", "to_address"],
    "total_miles": ["miles", "distance", "total_miles"],
    "revenue": ["revenue", "rate", "amount", "pay"],
    "load_weight": ["weight", "cargo_weight"],
    "status": ["status", "trip_status"],
}
EMAIL_METADATA = ["message_id", "subject", "sender", "date", "email_id"]
NUMERIC_FIELDS = ["total_miles", "revenue", "load_weight"]
DATE_FIELDS = ["route_date", "start_time", "end_time"]

# Required fields per source kind.
REQUIRED_FIELDS = {
    "generic_api": ["route_id", "date"],
    "eld": ["vehicle_id", "driver_id", "start_time", "total_miles"],
    "tms": ["load_id", "pickup_date", "delivery_date", "revenue"],
    "dispatch": ["trip_id", "driver_name", "vehicle_id", "route_date"],
    "file": ["route_id", "date"],
    "email": ["subject", "sender"],
    "manual": ["route_id", "route_date"],
}

LOAD_TYPES = ["general", "refrigerated", "hazardous", "oversized", "fragile"]
ROUTE_STATUSES = ["scheduled", "in_progress", "completed", "cancelled", "delayed"]

# Name keywords that make a column numeric in the flat-table cleaner.
P17_NUMERIC_KEYWORDS = ["miles", "weight", "value", "speed", "cost", "revenue", "pay", "fuel"]
# ... and in the record type normaliser.
P16_NUMERIC_KEYWORDS = ["miles", "weight", "value", "cost", "pay", "rate", "speed", "consumed", "revenue",
                        "latitude", "longitude"]
# Location sub-fields (P15): the first alias with a value wins.
LOCATION_SUBFIELD_ALIASES = {
    "address": ["street", "street_address", "addr"],
    "city": ["city", "municipality"],
    "state": ["state", "province", "region"],
    "zip_code": ["zip", "postal_code", "zipcode"],
    "latitude": ["lat", "latitude"],
    "longitude": ["lon", "longitude", "lng"],
}


# ---------------------------------------------------------------- P1-P4
def norm_name(name: str) -> str:
    return re.sub(r"[ \-]", "_", name.strip().lower())


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case, space/dash -> underscore names; string
    values trimmed.  Two columns normalising to one name is a plan error."""
    names = [norm_name(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide after normalisation: {names}")
    types = dict(df.dtypes)
    return df.select(*[(F.trim(F.col(f"`{c}`")) if types[c] == "string" else F.col(f"`{c}`")).alias(n)
                       for c, n in zip(df.columns, names)])


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename mapped columns; unmapped columns are kept."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Schema check after mapping; a missing column fails before any job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def required_errors(df: DataFrame, required: list[str], out: str = "errors") -> DataFrame:
    """One message per missing/blank required field; ``is_valid``."""
    msgs = []
    for f in required:
        v = F.col(f) if f in df.columns else F.lit(None).cast("string")
        msgs.append(F.when(v.isNull() | (F.trim(v.cast("string")) == ""),
                           F.lit(f"Missing required field: {f}")))
    return df.withColumn(out, F.array_compact(F.array(*msgs))).withColumn("is_valid", F.size(out) == 0)


# ---------------------------------------------------------------- P5-P8, P12
def first_present(df: DataFrame, aliases: list[str]) -> Column:
    present = [a for a in aliases if a in df.columns]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.col(f"`{a}`").cast("string") for a in present])


def iso_text(ts: Column) -> Column:
    """Python isoformat() of a parsed datetime (no fraction when zero)."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None)).when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))


def standardize(df: DataFrame, aliases: dict[str, list[str]], source: str, source_name: str,
                collected_at: str, metadata: list[str] | None = None) -> DataFrame:
    """P5/P6/P7 + P12: standard fields from the first present alias; numbers
    by plain float conversion, dates by the collectors' parser (ISO text),
    text whitespace-folded; provenance and a JSON copy of the raw record."""
    cols = {}
    for field, al in aliases.items():
        v = first_present(df, al)
        if field in NUMERIC_FIELDS:
            cols[field] = C.to_float(v)
        elif field in DATE_FIELDS:
            cols[field] = iso_text(C.parse_date(v))
        else:
            cols[field] = F.when(v.isNotNull(), C.fold_ws(v))
    meta = {f"email_{m}": F.col(m) for m in (metadata or []) if m in df.columns}
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(F.lit(source).alias("source"), F.lit(source_name).alias("source_name"),
                     F.lit(collected_at).cast("timestamp_ntz").alias("collected_at"),
                     raw.alias("raw_data"), *[e.alias(k) for k, e in meta.items()],
                     *[e.alias(k) for k, e in cols.items()])


# The manual-entry fields (P8), in order.
MANUAL_FIELDS = ["route_id", "route_date", "driver_name", "vehicle_id", "customer_name", "origin_address",
                 "destination_address", "total_miles", "revenue", "load_weight", "load_type", "status",
                 "start_time", "end_time", "fuel_cost", "toll_cost", "driver_pay", "notes"]
MANUAL_NUMBERS = ["total_miles", "revenue", "load_weight", "fuel_cost", "toll_cost", "driver_pay"]
MANUAL_DATES = ["route_date", "start_time", "end_time"]
# Manual entry, cleaning (P9): these dates besides.
MANUAL_SCHEDULE = ["scheduled_start_time", "scheduled_end_time"]
# Manual entry, type checks (P10): field, message.
MANUAL_TEXT_CHECKS = {"route_id": "Route ID must be a string"}
MANUAL_DATE_CHECKS = {"route_date": "Invalid date format for route_date"}
MANUAL_NUMBER_CHECKS = {"total_miles": "Total miles must be numeric", "revenue": "Revenue must be numeric",
                        "load_weight": "Load weight must be numeric"}


def manual_record(df: DataFrame, source_name: str, collected_at: str) -> DataFrame:
    """Provenance and the 18 manual fields; numbers converted, text
    whitespace-folded, dates parsed to ISO text but an unparsable date keeps its
    original text."""
    out = []
    for f in MANUAL_FIELDS:
        v = F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")
        if f in MANUAL_NUMBERS:
            out.append(C.to_float(v).alias(f))
        elif f in MANUAL_DATES:
            out.append(F.coalesce(iso_text(C.parse_date(v)), v).alias(f))
        else:
            out.append(F.when(v.isNotNull(), C.fold_ws(v)).alias(f))
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(F.lit("manual_entry").alias("source"), F.lit(source_name).alias("source_name"),
                     F.lit(collected_at).cast("timestamp_ntz").alias("collected_at"), raw.alias("raw_data"), *out)


def manual_clean(df: DataFrame, entered_at: str) -> DataFrame:
    """Names normalised (P1), numbers converted, dates to ISO text (NULL if
    unparsable), text whitespace-folded, other types unchanged; the source and the
    entry time in front.  A missing value is NULL."""
    df = normalize_columns(df)
    out = []
    for f, t in df.dtypes:
        v = F.col(f"`{f}`")
        if f in MANUAL_NUMBERS:
            v = C.to_float(v.cast("string"))
        elif f in MANUAL_DATES + MANUAL_SCHEDULE:
            v = iso_text(C.parse_date(v.cast("string")))
        elif t == "string":
            v = F.when(v.isNotNull(), C.fold_ws(v))
        out.append(v.alias(f))
    return df.select(F.lit("manual_entry").alias("source"),
                     F.lit(entered_at).cast("timestamp_ntz").alias("entry_timestamp"), *out)


def manual_type_errors(doc: Column, index: Column) -> Column:
    """P10: type checks of a manual-entry VARIANT record -> error messages; ``doc`` is
    read by every check, so it should be a column, not the parse itself.

    Absent and null fields pass.  Numbers may come as numbers or as text (the
    conversion is the cleaner's task), so only objects and lists fail."""
    errs = []

    def failed(bad: Column, message: str) -> None:
        errs.append(F.when(bad, F.concat(F.lit("Record "), index.cast("string"), F.lit(f": {message}"))))

    def kind(f: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(doc, f"$.{f}", "variant"))

    for f, message in MANUAL_TEXT_CHECKS.items():
        failed(~kind(f).isin("VOID", "STRING"), message)
    for f, message in MANUAL_DATE_CHECKS.items():
        failed((kind(f) != "VOID") & C.parse_date(F.try_variant_get(doc, f"$.{f}", "string")).isNull(), message)
    for f, message in MANUAL_NUMBER_CHECKS.items():
        failed(kind(f).rlike("^(OBJECT|ARRAY)"), message)
    return F.array_compact(F.array(*errs))


def batch_outcome(df: DataFrame, valid: Column, keys: list[str]) -> DataFrame:
    """Per batch: good / bad counts and SUCCESS / PARTIAL / FAILED /
    NO_DATA -- one aggregate."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"),
                              F.count_if(valid).cast("long").alias("valid_records"),
                              F.count_if(~valid).cast("long").alias("error_records"))
    return g.withColumn("outcome", F.when(F.col("records") == 0, "NO_DATA")
                        .when(F.col("error_records") == 0, "SUCCESS")
                        .when(F.col("valid_records") == 0, "FAILED").otherwise("PARTIAL"))


# ---------------------------------------------------------------- P14-P17
def legacy_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``{current: legacy}``; only mapped fields survive."""
    return df.select(*[F.col(f"`{legacy}`").alias(cur) for cur, legacy in mapping.items() if legacy in df.columns])


def alias_struct_fields(df: DataFrame, col: str, aliases: dict[str, list[str]] = LOCATION_SUBFIELD_ALIASES) -> DataFrame:
    """Rebuild a struct column with standard sub-field names."""
    names = [f.name for f in df.schema[col].dataType.fields]
    parts = []
    for std, al in aliases.items():
        present = [a for a in al if a in names]
        e = F.coalesce(*[F.col(f"{col}.{a}") for a in present]) if present else F.lit(None)
        parts.append(e.alias(std))
    return df.withColumn(col, F.struct(*parts))


def normalize_types(df: DataFrame) -> DataFrame:
    """By name keyword: date/time -> datetime parse, numeric keywords ->
    number; other text trimmed, other types unchanged."""
    out = []
    for c, t in df.dtypes:
        lc = c.lower()
        v = F.col(f"`{c}`")
        if "date" in lc or "time" in lc:
            out.append(C.clean_datetime(v.cast("string")).alias(c))
        elif any(k in lc for k in P16_NUMERIC_KEYWORDS):
            out.append(C.to_number(v).alias(c))
        else:
            out.append((F.trim(v) if t == "string" else v).alias(c))
    return df.select(*out)


def clean_flat_table(df: DataFrame) -> DataFrame:
    """The flat-table cleaner; every rule whose keyword the name holds
    is applied, in the reference's order (phone, email, zip, state, address,
    date/time, numeric)."""
    out = []
    for c in df.columns:
        lc = c.lower()
        e = F.col(f"`{c}`")
        if "phone" in lc:
            e = C.clean_phone(e)
        if "email" in lc:
            e = C.clean_email(e.cast("string"))
        if "zip" in lc:
            e = C.clean_zip(e.cast("string"))
        if "state" in lc:
            e = C.clean_state(e.cast("string"))
        if "address" in lc:
            e = C.clean_address(e.cast("string"))
        if "time" in lc or "date" in lc:
            e = C.clean_datetime(e.cast("string"))
        if any(k in lc for k in P17_NUMERIC_KEYWORDS):
            e = C.to_number(e)
        out.append(e.alias(c))
    return df.select(*out)


# ---------------------------------------------------------------- P18-P23
# The nested route record (P18), by the cleaning of its fields.
NESTED_LOCATIONS = ("start_location", "end_location")
NESTED_PARTIES = ("customer", "driver")
NESTED_NUMBERS = ("load_weight", "load_value", "total_miles", "empty_miles", "fuel_consumed", "average_speed", "revenue",
                  "fuel_cost", "toll_cost", "driver_pay", "other_costs")
NESTED_TIMES = ("route_date", "scheduled_start_time", "actual_start_time", "scheduled_end_time", "actual_end_time")
NESTED_TEXTS = ("load_type", "special_requirements", "status", "notes")


def clean_nested_record(df: DataFrame) -> DataFrame:
    """Every field of the nested route record cleaned, struct members by
    C1-C5, dates and times by C6, numbers by C8, texts trimmed (empty: NULL);
    other columns and struct members are kept, absent fields stay absent.

    The struct members become columns first, and the cleaning reads those: a member
    of a struct that was just built would be built again for every use."""
    found = [s for s in (*NESTED_LOCATIONS, *NESTED_PARTIES) if s in df.columns]
    names = {s: df.schema[s].dataType.names for s in found}
    flat = df.select("*", *[F.col(f"{s}.{m}").alias(f"_{s}_{m}") for s in found for m in names[s]])

    def members(s: str, how: dict, optional: bool) -> Column:
        done = [(fn(F.col(f"_{s}_{m}")) if m in names[s] or not optional else F.lit(None).cast("string")).alias(m)
                for m, fn in sorted(how.items())]
        return F.struct(*done, *[F.col(f"_{s}_{m}").alias(m) for m in names[s] if m not in how])

    new = {}
    for s in NESTED_LOCATIONS:
        new[s] = lambda s=s: members(s, {"address": C.clean_address, "city": C.clean_name, "state": C.clean_state,
                                         "zip_code": C.clean_zip}, False)
    for s in NESTED_PARTIES:
        new[s] = lambda s=s: members(s, {"name": C.clean_name, "phone": C.clean_phone, "email": C.clean_email}, True)
    new |= {c: lambda c=c: C.to_number(F.col(c)) for c in NESTED_NUMBERS}
    new |= {c: lambda c=c: C.clean_datetime(F.col(c)) for c in NESTED_TIMES}
    new |= {c: lambda c=c: F.regexp_replace(F.when(F.col(c) != "", F.col(c)), r"^\s+|\s+$", "") for c in NESTED_TEXTS}
    cleaned = {c: make() for c, make in new.items() if c in df.columns}
    return flat.select(*[cleaned[c].alias(c) if c in cleaned else F.col(f"`{c}`") for c in df.columns])


def enum_or_default(x, domain: list[str], default: str) -> Column:
    """Case-insensitive member of the domain, else the default (NULL too)."""
    v = F.lower(F.trim(F.col(x) if isinstance(x, str) else x))
    return F.when(v.isin(domain), v).otherwise(F.lit(default))


# The route record (P20) -- field, value of a missing one.
ROUTE_TEXT_DEFAULTS = {"special_requirements": "", "notes": ""}


def route_projection(df: DataFrame, fields: list[str]) -> DataFrame:
    """P20: the route fields in order: load type and status parsed to their
    domains, missing free text '', any other missing field NULL."""
    out = []
    for f in fields:
        v = F.col(f) if f in df.columns else F.lit(None).cast("string")
        if f == "load_type":
            v = enum_or_default(v, LOAD_TYPES, "general")
        elif f == "status":
            v = enum_or_default(v, ROUTE_STATUSES, "scheduled")
        elif f in ROUTE_TEXT_DEFAULTS:
            v = F.coalesce(v, F.lit(ROUTE_TEXT_DEFAULTS[f]))
        out.append(v.alias(f))
    return df.select(*out)


def fill_missing(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Stored value kept unless missing or zero; then the computed one."""
    return df.withColumns({stored: F.when(nz(stored) == 0, F.col(calc)).otherwise(F.col(stored))
                           for stored, calc in pairs.items()})


def report_table(df: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    """Ordered (field, display name) projection; a missing field
    or NULL value shows as ''."""
    out = []
    for f, display in spec:
        v = F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")
        out.append(F.coalesce(v, F.lit("")).alias(display))
    return df.select(*out)


def collect_by_config(df: DataFrame, cfg: dict, text_col: str = "body") -> DataFrame:
    """A collector's records by its configuration: ``column_mapping`` and
    ``required_columns`` (files); ``parsing_patterns`` (messages: for each group of
    patterns the fields found in ``text_col``, messages without any are left out)."""
    for group in cfg.get("parsing_patterns", {}).values():
        if group.get("type") != "key_value":
            raise ValueError(f"unknown pattern type {group.get('type')!r}")
        df = extract_rules(df, text_col, group["patterns"], fold=True)
    if "column_mapping" in cfg:
        df = apply_mapping(df, cfg["column_mapping"])
    return require_columns(df, cfg.get("required_columns", []))
