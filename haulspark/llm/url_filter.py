"""URL filter: rules first, then a blocked Bloom filter before an exact join.

*Rules* are (verdict, host, path) prefixes: a rule fits its host and all
subdomains if the url's path starts with the rule's path; the longest fitting
rule wins.

*The list* is a table of canonical urls.  Each listed url sets PROBES bits in
one 256-bit block chosen by its hash (``bit_or`` per block: map-side combined).
Urls that no rule judges look their block up by an equi-join on the block
number; the filter has no false negatives, so a miss is final.  Possible hits
go to an exact join with the list on the canonical url itself, which removes
the false positives.  Misses skip that join.

Scale: the filter takes 2 bytes for each listed url and travels as rows, so
Spark broadcasts it while it is below the session's broadcast threshold and
shuffles it by block beyond.  The list is reduced to distinct canonical urls
before either join.  A url that holds a third of all rows makes one hot probe
key; both joins put the probes on the streamed side, which adaptive execution
splits, and no key is aggregated on the probe side.

Defined results: a null url or one without ``://`` has empty host and path, no
rule and a null canonical url, and is never listed; empty tables (pages, list
or both) give the rule verdicts or nothing; repeated rows are judged alike;
extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulspark.llm.frames import pick
from haulspark.operators.rows import keep_rows

WORDS = 4  # 64-bit words of a block
PROBES = 6  # bits set for a url in its block
URLS_PER_BLOCK = 16  # 16 bits for each listed url

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid|sessionid)(=.*)?$"

DEFAULT_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query): the text after the first ``://`` up to ``/?#``, then
    up to ``?#``, then up to ``#``.  Null or no ``://``: host and path empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^/?#]*[^?#]*\?([^#]*)", 1)
    return host, path, query


def canonical(host: Column, path: Column, query: Column) -> Column:
    """Scheme, user, default port, ``www.``, fragment, tracking parameters and
    trailing slashes do not count; the remaining parameters are sorted."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(\.?:(80|443)|\.|:)$", "")
    bare = F.regexp_replace(bare, r"^www\.", "")
    args = F.array_join(F.array_sort(F.filter(
        F.split(query, "&"), lambda a: (a != "") & ~a.rlike(TRACKING))), "&")
    tail = F.regexp_replace(path, r"/+$", "")
    return F.when(host != "", F.concat(bare, tail, F.when(args != "", F.concat(F.lit("?"), args)).otherwise(F.lit(""))))


def rule_struct(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.

    Rules are ordered longest first and compiled to one CASE expression."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))

    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)

    def step(rest: Column | None, rule) -> Column:
        verdict, h, p = rule
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        return F.when(fits(h, p), hit) if rest is None else F.when(fits(h, p), hit).otherwise(rest)

    return reduce(step, reversed(ordered), None)


def _block_and_mask(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The url's block number and the words of its bit mask."""
    h = F.xxhash64(url)
    block = F.pmod(h, F.lit(blocks)).cast("long")
    spread = [F.pmod(F.xxhash64(url, F.lit(k)), F.lit(WORDS * 64)) for k in range(PROBES)]
    masks = []
    for w in range(WORDS):
        bits = [F.when(F.floor(s / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int")))
                .otherwise(F.lit(0).cast("long")) for s in spread]
        masks.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return block, masks


def build_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row for each non-empty block: (block, w0..w3).  ``listed`` has ``url``."""
    block, masks = _block_and_mask(F.col("url"), blocks)
    rows = listed.select(block.alias("block"), *[m.alias(f"m{w}") for w, m in enumerate(masks)])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def parsed(pages: DataFrame, rules=DEFAULT_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, canonical_url, ruled) of every page."""
    df = pick(pages, page_id=id_col, url=url_col)
    host, path, query = split_url(F.col("url"))
    df = df.select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    return df.select("page_id", "host", "path", canonical(F.col("host"), F.col("path"), F.col("query")).alias("canonical_url"),
                     rule_struct(F.col("host"), F.col("path"), rules).alias("ruled"))


def canonical_urls(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct canonical urls (column ``url``) of a table of raw urls."""
    df = pick(urls, raw=url_col)
    host, path, query = split_url(F.col("raw"))
    df = df.select(host.alias("host"), path.alias("path"), query.alias("query"))
    return df.select(canonical(F.col("host"), F.col("path"), F.col("query")).alias("url")).filter("url IS NOT NULL").distinct()


def judge(pages: DataFrame, blocklist: DataFrame, rules=DEFAULT_RULES,
          id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, canonical_url, listed.

    ``listed`` is null where a rule decided (the list was not asked)."""
    listed = canonical_urls(blocklist, list_col)
    n = listed.count()  # one number, sizes the filter
    blocks = max(1, -(-n // URLS_PER_BLOCK))
    bloom = build_filter(listed, blocks)
    df = parsed(pages, rules, id_col, url_col)
    asks = F.col("ruled").isNull() & F.col("canonical_url").isNotNull()
    ask, rest = keep_rows(df, asks), keep_rows(df, ~asks)
    block, masks = _block_and_mask(F.col("canonical_url"), blocks)
    probe = ask.withColumns({"block": block} | {f"m{w}": m for w, m in enumerate(masks)})
    hit = reduce(lambda a, b: a & b, [
        F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}") for w in range(WORDS)])
    probed = probe.join(bloom, "block", "left").withColumn("possible", hit)
    plain = ("page_id", "host", "path", "canonical_url", "ruled")
    misses = keep_rows(probed, ~F.col("possible")).select(*plain, F.lit(False).alias("listed"))
    exact = keep_rows(probed, F.col("possible")).select(*plain).join(
        listed.select(F.col("url").alias("canonical_url"), F.lit(True).alias("found")), "canonical_url", "left")
    hits = exact.select(*plain, F.coalesce("found", F.lit(False)).alias("listed"))
    out = rest.select(*plain, F.when(F.col("ruled").isNull(), F.lit(False)).alias("listed")).unionByName(misses).unionByName(hits)
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"),
                      "canonical_url", "listed")
