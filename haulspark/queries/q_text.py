"""Text extraction over pages and routes: C12-C18."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.routes_view import routes
from ..sources.tables import table
from .registry import register
from .sqlbase import with_routes


@register("C12_strip_markup", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS body FROM pages")
def c12(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_markup("html").alias("body"))


# Extraction rules (field -> pattern, group 1 is the value).
PAGE_RULES = {"lang": r'lang="([a-z]+)"', "title": r"<title>([^<]*)</title>", "page_no": r"page=([0-9]+)"}
KV_RULES = {"charset": r'charset="([^"]+)"', "ad_text": r'class="ad">([^<]*)<'}
LINK_PATTERN = r'<a href="([^"]*)">([^<]*)</a>'


def _rx(x, p):
    p = p.replace("'", "''")
    return f"nullif(regexp_replace(regexp_extract({x}, '(?im){p}', 1), '^\\s+|\\s+$', '', 'g'), '')"


_DOC = "url || ' ' || html"


@register("C13_rule_extraction", "SELECT page_id, " + ", ".join(
    f"{_rx(_DOC, p)} AS {n}" for n, p in PAGE_RULES.items())
    + " FROM pages WHERE " + " OR ".join(f"{_rx(_DOC, p)} IS NOT NULL" for p in PAGE_RULES.values()))
def c13(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("doc"))
    return X.extract_rules(p, "doc", PAGE_RULES).select("page_id", *PAGE_RULES)


@register("C14_key_value_extraction", "SELECT page_id, " + ", ".join(
    f"nullif(coalesce(trim(regexp_replace({_rx('html', p)}, '\\s+', ' ', 'g')), ''), '') AS {n}"
    for n, p in KV_RULES.items())
    + " FROM pages WHERE " + " OR ".join(f"{_rx('html', p)} IS NOT NULL" for p in KV_RULES.values()))
def c14(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html")
    return X.extract_rules(p, "html", KV_RULES, fold=True).select("page_id", *KV_RULES)


_FOLD = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"


@register("C15_table_extraction", f"""
SELECT page_id, i AS match_no, h[i + 1] AS href, l[i + 1] AS label FROM (
  SELECT page_id, h, l, unnest(range(len(h))) AS i FROM (
    SELECT page_id, list_transform(regexp_extract_all(html, '{LINK_PATTERN}', 1), lambda x: {_FOLD}) AS h,
           list_transform(regexp_extract_all(html, '{LINK_PATTERN}', 2), lambda x: {_FOLD}) AS l FROM pages))""")
def c15(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "html")
    return X.extract_table(p, "page_id", "html", LINK_PATTERN, ["href", "label"])


ALLOWED_EXTENSIONS = ["com", "org"]


@register("C16_attachment_listing", """
SELECT page_id, name, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS extension,
       lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) IN ('com', 'org') AS allowed,
       regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g') AS safe_name
FROM (SELECT page_id, regexp_extract(url, '/([^/?#]+)([?#].*)?$', 1) || ' v1.'
                      || regexp_extract(url, '\\.([a-z]+)/', 1) AS name FROM pages)""")
def c16(spark, sf):
    """Attachment names taken from page URLs (last path segment + host TLD)."""
    p = table(spark, sf, "pages")
    name = F.concat(F.regexp_extract("url", r"/([^/?#]+)([?#].*)?$", 1), F.lit(" v1."),
                    F.regexp_extract("url", r"\.([a-z]+)/", 1))
    return X.attachment_listing(p.select("page_id", name.alias("name")), "name", ALLOWED_EXTENSIONS)


def _geo_ctx(spark, sf):
    r = routes(spark, sf, ("route_key", "end_nation"))
    n, rg = table(spark, sf, "nation"), table(spark, sf, "region")
    # nation and region are fixed-size (25 / 5 rows by the schema's definition)
    nr = F.broadcast(n.join(rg, n.n_regionkey == rg.r_regionkey))
    j = r.join(nr, r.end_nation == nr.n_nationkey, "left")
    comps = F.array(F.struct(F.array(F.lit("locality")).alias("types"), F.col("n_name").alias("short_name")),
                    F.struct(F.array(F.lit("country"), F.lit("political")).alias("types"),
                             F.col("r_name").alias("short_name")))
    ctx = F.array(F.struct(F.concat(F.lit("place."), F.col("n_nationkey").cast("string")).alias("id"),
                           F.col("n_name").alias("text")),
                  F.struct(F.concat(F.lit("region."), F.col("r_regionkey").cast("string")).alias("id"),
                           F.col("r_name").alias("text")))
    return j.select("route_key", comps.alias("components"), ctx.alias("context"))


_GEO_SQL = with_routes("""
SELECT route_key, r_name AS {col} FROM routes LEFT JOIN nation ON end_nation = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")


@register("C17_component_by_type", _GEO_SQL.replace("{col}", "country"))
def c17(spark, sf):
    return _geo_ctx(spark, sf).select("route_key", X.pick_component("components", "country").alias("country"))


@register("C18_context_by_prefix", _GEO_SQL.replace("{col}", "region"))
def c18(spark, sf):
    return _geo_ctx(spark, sf).select("route_key", X.pick_by_prefix("context", "region").alias("region"))
