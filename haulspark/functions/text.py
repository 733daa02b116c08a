"""Text extraction over message bodies and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import fold_ws
from .numeric import c
from ..operators.rows import keep_rows


def strip_markup(x) -> Column:
    """Drop every <...> tag."""
    return F.regexp_replace(c(x), r"<[^>]+>", "")


def extract_rules(df: DataFrame, text: str, rules: dict[str, str], flags: str = "(?im)",
                  fold: bool = False) -> DataFrame:
    """One column per named pattern (first match, group 1 without
    blanks around it, '' -> NULL; ``^`` and ``$`` hold at every line); only rows
    where some field matched are kept."""
    cols = {}
    for name, pat in rules.items():
        v = F.btrim(F.regexp_extract(F.col(text), flags + pat, 1), F.lit(" \t\n\x0b\x0c\r"))
        v = F.nullif(v, F.lit(""))
        cols[name] = F.nullif(fold_ws(v), F.lit("")) if fold else v
    out = df.withColumns(cols)
    any_hit = None
    for name in rules:
        h = F.col(name).isNotNull()
        any_hit = h if any_hit is None else (any_hit | h)
    return keep_rows(out, any_hit)


def extract_table(df: DataFrame, key: str, text: str, pattern: str, names: list[str]) -> DataFrame:
    """Every match of ``pattern`` becomes a row; group i -> names[i-1], white
    space folded; a pattern without groups gives its whole match as names[0]."""
    first = 1 if re.compile(pattern).groups else 0
    arrays = [F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), i + first), fold_ws).alias(n)
              for i, n in enumerate(names)]
    z = df.select(key, F.arrays_zip(*arrays).alias("m"))
    return z.select(key, F.posexplode("m").alias("match_no", "r")).select(key, "match_no", *[f"r.{n}" for n in names])


def attachment_listing(df: DataFrame, name_col: str, allowed: list[str]) -> DataFrame:
    """Extension, allow-list flag and a file-system-safe name."""
    ext = F.lower(F.regexp_extract(F.col(name_col), r"\.([A-Za-z0-9]+)$", 1))
    return df.withColumns({"extension": ext, "allowed": ext.isin(allowed),
                           "safe_name": F.regexp_replace(F.col(name_col), r"[^A-Za-z0-9_.-]", "_")})


def pick_component(components, wanted_type: str) -> Column:
    """C17: short_name of the first component whose types contain the type."""
    return F.element_at(F.filter(c(components), lambda x: F.array_contains(x["types"], wanted_type)), 1)["short_name"]


def pick_by_prefix(ctx, prefix: str) -> Column:
    """Text of the first context entry whose id starts with the prefix."""
    return F.element_at(F.filter(c(ctx), lambda x: x["id"].startswith(prefix)), 1)["text"]
