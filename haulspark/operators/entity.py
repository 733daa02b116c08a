"""Entity resolution and deduplication.

"First wins" is a rank of which only the first is kept, so every task passes on one
candidate per key (WindowGroupLimit) before the shuffle and no key's rows are gathered
in one task.  :func:`first_per_key` is for records, :func:`first_of_few` for entities
on a fact, whose keys repeat a lot: what is shuffled there is one row for each key and
task, and the fact is neither shuffled nor joined with its own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.window import global_index



def _place(s: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f"{s}.{c}"), F.lit("")) for c in ("address", "city", "state", "zip_code")])


def route_key() -> list:
    """The key that makes two route records the same, if none is given."""
    return ["route_date", "driver.license_number", _place("start_location"), _place("end_location")]


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _key_columns(keys: list) -> list[Column]:
    """Key parts as text, a missing one as '' (a struct as its JSON)."""
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _folded(df: DataFrame, keys: list) -> tuple[DataFrame, list[str]]:
    names = [f"_k{i}" for i in range(len(keys))]
    out = df.select("*", *[k.alias(n) for k, n in zip(_key_columns(keys), names)])
    kinds = dict(out.dtypes)
    for n in names:
        text = F.to_json(n) if kinds[n].startswith(("struct", "array", "map")) else F.col(n).cast("string")
        out = out.withColumn(n, F.coalesce(text, F.lit("")))
    return out, names


def first_per_key(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every key; key parts may be
    expressions (e.g. ``lower(coalesce(x, ''))``), a missing part equals ''."""
    keyed, names = _folded(df, keys)
    first = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return keyed.withColumn("_rn", first).filter("_rn = 1").select(*df.columns)


def first_of_few(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The same for keys that repeat a lot; in the leading whole-number columns of
    ``order`` (two at most) a missing value comes last.  Copies of a key's first row are
    merged by a hash aggregate, rows that differ but are equal in ``order`` settled by number."""
    kept, names = _folded(df, keys)
    kinds = dict(df.dtypes)
    whole = [kinds[o] in _INTEGRAL for o in order[:2]]
    leading = len(whole) if all(whole) else whole.index(False)
    window = Window.partitionBy(*names).orderBy(*[F.col(o).asc_nulls_last() if i < leading else F.col(o) for i, o in enumerate(order)])
    first = kept.withColumn("_rank", F.rank().over(window)).filter("_rank = 1").drop("_rank").distinct()
    return first.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").select(*df.columns)


def _key_text(x) -> Column:
    return F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))


def unique_locations(df: DataFrame, struct_cols: list[str], order: list[str]) -> DataFrame:
    """Locations from several struct columns; key lower(address, city,
    state) + zip; rows whose four parts are all empty are skipped; the first row's
    coordinates are kept, if the structs have them."""
    ex = df.select(*order, F.posexplode(F.array(*[F.col(c) for c in struct_cols])).alias("_slot", "loc"))
    ex = ex.select(*order, "_slot", "loc.*")
    empty = F.lit(True)
    for c in ("address", "city", "state", "zip_code"):
        empty = empty & (F.coalesce(F.col(c), F.lit("")) == "")
    ex = ex.filter(~empty)
    kept = [c for c in ("address", "city", "state", "zip_code", "latitude", "longitude") if c in ex.columns]
    return first_of_few(ex, [_key_text("address"), _key_text("city"), _key_text("state"), "zip_code"],
                        order + ["_slot"]).select(*kept)


def unique_customers(df: DataFrame, order: list[str]) -> DataFrame:
    """Key lower(name), phone, email; a name is required."""
    f = df.filter(F.coalesce(F.trim("name"), F.lit("")) != "")
    return first_of_few(f, [_key_text("name"), "phone", "email"], order)


def unique_drivers(df: DataFrame, order: list[str]) -> DataFrame:
    """U4: key lower(name), licence, phone; a name is required."""
    f = df.filter(F.coalesce(F.trim("name"), F.lit("")) != "")
    return first_of_few(f, [_key_text("name"), "license_number", "phone"], order)


def unique_vehicles(df: DataFrame, order: list[str]) -> DataFrame:
    """Key lower(plate), lower(vin); plate or vin required."""
    f = df.filter((F.coalesce("license_plate", F.lit("")) != "") | (F.coalesce("vin", F.lit("")) != ""))
    return first_of_few(f, [_key_text("license_plate"), _key_text("vin")], order)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union of sources whose columns differ (missing -> NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def find_or_create(dim: DataFrame, batch_keys: DataFrame, key: str, id_col: str) -> DataFrame:
    """J2 (batch form): keys of the batch that the dimension lacks get new ids
    ``max(id) + position`` (position from a distributed sort + zipWithIndex);
    returns every batch key with its (existing or new) id."""
    keys = batch_keys.select(key).filter(F.col(key).isNotNull()).distinct()
    new = keys.join(dim.select(key), key, "left_anti")
    base = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m")).select("m").scalar()
    new_ids = global_index(new, [key], "_pos").select(key, (base + F.col("_pos") + 1).alias(id_col),
                                                      F.lit(True).alias("created"))
    existing = keys.join(dim.select(key, id_col), key, "inner").withColumn("created", F.lit(False))
    return existing.unionByName(new_ids)


def link_ids(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, id_col: str,
             out: str) -> DataFrame:
    """Resolve an entity id by a normalised natural key (null-safe)."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    d = dim.select(norm(dim_key).alias("_nk"), F.col(id_col).alias(out))
    d = d.groupBy("_nk").agg(F.min(out).alias(out))  # one id per natural key
    f = facts.withColumn("_fk", norm(fact_key))
    return f.join(d, f["_fk"].eqNullSafe(d["_nk"]), "left").drop("_fk", "_nk")
