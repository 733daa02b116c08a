"""File sources (S1-S9): CSV and JSON landing files, payload paths,
discovery, content-hash dedupe and the reject (quarantine) sink.

Everything is read as text with a fixed schema and standardised by column
expressions; JSON documents go through VARIANT (``parse_json``) so the
polymorphic roots of landed files are resolved per document, in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text that means "missing" in landed files -- the pandas
# reader's default set plus the collector's own spellings.
NULL_SPELLINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                  "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Keys that may hold the record list of a landed JSON document, in order.
JSON_RECORD_KEYS = ["data", "records", "rows", "results"]
MANUAL_RECORD_KEYS = ["routes", "data"]


def fold_nulls(df: DataFrame, spellings: list[str] = NULL_SPELLINGS) -> DataFrame:
    """Every listed spelling (after trimming) becomes NULL, in all columns."""
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")).isin(spellings), F.lit(None))
                       .otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_csv_text(spark: SparkSession, paths, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Header CSV, every column as text, null spellings folded."""
    df = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
          .option("inferSchema", False).option("mode", "PERMISSIVE").csv(paths))
    return fold_nulls(df)


def read_csv_any_encoding(spark: SparkSession, folder: str, glob: str = "*.csv",
                          fallback: str = "ISO-8859-1") -> DataFrame:
    """Files that are valid UTF-8 are read as UTF-8, the others with the
    fallback encoding, one that gives every byte a character (Latin-1 ends the chain
    the reference tries).  All files are read with the fallback, line by line; a
    file's lines say whether all its bytes are UTF-8, and the verdict is joined back
    by the file's path.  Files stay splittable, and no path reaches the driver."""
    raw = (spark.read.option("header", True).option("encoding", fallback).option("mode", "PERMISSIVE")
           .option("pathGlobFilter", glob).option("recursiveFileLookup", True).csv(folder))
    names = raw.columns
    rows = raw.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col("_metadata.file_path").alias("_path"))
    whole = F.concat_ws(",", *[F.col(f"_{i}") for i in range(len(names))])
    valid = rows.groupBy("_path").agg(F.bool_and(F.is_valid_utf8(F.encode(whole, fallback).cast("string"))).alias("_utf8"))

    def text(c: Column) -> Column:
        return F.when(F.col("_utf8"), F.decode(F.encode(c, fallback), "UTF-8")).otherwise(c)

    out = rows.join(valid, "_path").select(*[text(F.col(f"_{i}")).alias(_utf8_name(c, fallback)) for i, c in enumerate(names)])
    return fold_nulls(out)


def _utf8_name(name: str, encoding: str) -> str:
    try:
        return name.encode(encoding).decode("utf-8")
    except UnicodeError:
        return name


def record_array(doc: Column, keys: list[str] = JSON_RECORD_KEYS) -> Column:
    """The records of a parsed document: the first present list under
    ``keys``, else the root array, else the root object as one record."""
    cands = [F.try_variant_get(doc, f"$.{k}", "array<variant>") for k in keys]
    cands.append(F.try_variant_get(doc, "$", "array<variant>"))
    cands.append(F.array(doc))
    return F.coalesce(*cands)


# Reasons of rejected documents and lines.
NOT_JSON, NOT_RECORDS, NOT_COLUMNS = "Document is not valid JSON", "Unsupported JSON structure", "Line does not fit the columns"


def read_json_documents(spark: SparkSession, path: str, whole_file: bool = True,
                        keys: list[str] = JSON_RECORD_KEYS) -> DataFrame:
    """S3: landed JSON, one document per file (or per line), polymorphic root; one
    row per record as VARIANT plus the source path.  A document that does not parse,
    or whose root is neither list nor object, is a row with its ``reason`` and
    ``document`` and no record (:func:`split_rejects`); blank ones are nothing."""
    t = spark.read.option("wholetext", whole_file).text(path).select("value", F.col("_metadata.file_path").alias("_path"))
    doc = t.filter(F.trim("value") != "").withColumn("doc", F.try_parse_json("value"))
    kind = F.schema_of_variant("doc")
    reason = F.when(F.col("doc").isNull(), NOT_JSON).when(~(kind.startswith("OBJECT") | kind.startswith("ARRAY")), NOT_RECORDS)
    found = F.when(reason.isNull(), record_array(F.col("doc"), keys)).otherwise(F.array(F.lit(None).cast("variant")))
    return doc.select("_path", "doc", reason.alias("reason"), F.when(reason.isNotNull(), F.col("value")).alias("document"),
                      F.explode(found).alias("record"))


def read_csv_with_rejects(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = False) -> DataFrame:
    """S1 with a fixed set of text columns; a line with more or fewer values is a row
    with its ``reason`` and ``document`` (:func:`split_rejects`)."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", document string"
    raw = (spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("sep", sep).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "document").csv(path).withColumn("_path", F.col("_metadata.file_path")))
    values = [F.col(f"`{c}`") for c in columns]
    reason = F.when(F.col("document").isNotNull(), NOT_COLUMNS)
    folded = [F.when(F.trim(v).isin(NULL_SPELLINGS), F.lit(None)).otherwise(v).alias(c) for v, c in zip(values, columns)]
    return raw.select("_path", reason.alias("reason"), "document", *folded)


def split_rejects(rows: DataFrame, root: str, load_date: str, good: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects of one pass over the source, both written under
    ``root`` (partitioned by ``rejected`` and load date): the ``good`` columns, and
    path, document and reasons.  Rows without a ``reason`` are good."""
    names = [f"g{i}" for i in range(len(good))]
    out = rows.select(*[c.alias(n) for c, n in zip(good, names)], F.col("_path").alias("path"), "document",
                      F.when(F.col("reason").isNotNull(), F.array("reason")).alias("reasons"), F.col("reason").isNotNull().alias("rejected"),
                      F.lit(load_date).cast("date").alias("load_date"))
    out.write.mode("append").partitionBy("rejected", "load_date").parquet(root)
    written = rows.sparkSession.read.schema(out.schema).parquet(root)
    kept = written.filter("NOT rejected").select(*names)
    for n, field in zip(names, rows.select(*good).schema):
        kept = kept.withColumnRenamed(n, field.name)
    return kept, written.filter("rejected").select("path", "document", "reasons", "load_date")


def field(record: Column, name: str, typ: str = "string") -> Column:
    return F.try_variant_get(record, f"$.{name}", typ)


def records_at_path(doc: Column, dotted: str) -> Column:
    """The array under a dotted path; an object there is one record; a
    missing path yields no records."""
    p = "$." + dotted
    arr = F.try_variant_get(doc, p, "array<variant>")
    obj = F.when(F.schema_of_variant(F.try_variant_get(doc, p, "variant")).startswith("OBJECT"),
                 F.array(F.try_variant_get(doc, p, "variant")))
    return F.coalesce(arr, obj, F.array().cast("array<variant>"))


def since(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Incremental pull window ``ts >= as_of - days`` (as_of is a
    parameter, never the wall clock)."""
    return df.filter(F.col(ts) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))


def discover_files(spark: SparkSession, folder: str, glob: str, modified_after: str) -> DataFrame:
    """Files matching ``glob`` modified after a time, sorted by path;
    the file *contents* are not read (binaryFile prunes the column)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).option("modifiedAfter", modified_after).load(folder)
            .select("path", "length", "modificationTime").orderBy("path"))


def new_contents(spark: SparkSession, folder: str, glob: str, seen_hashes: DataFrame | None = None) -> DataFrame:
    """One file per distinct content (first path wins), minus contents
    whose md5 is already in the ledger of seen hashes."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(folder)
             .select("path", F.md5("content").alias("content_md5")))
    first = files.groupBy("content_md5").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))
    if seen_hashes is not None:
        first = first.join(seen_hashes.select("content_md5"), "content_md5", "left_anti")
    return first


def quarantine(rejects: DataFrame, reasons: Column, root: str, load_date: str) -> None:
    """Rejected rows with their reasons and time, partitioned by load
    date, appended to the quarantine area."""
    (rejects.withColumn("reasons", reasons)
     .withColumn("rejected_at", F.lit(load_date).cast("timestamp_ntz"))
     .withColumn("load_date", F.lit(load_date).cast("date"))
     .write.mode("append").partitionBy("load_date").parquet(root))


def scan_messages(msgs: DataFrame, since: str | None = None, senders: list[str] | None = None,
                  subjects: list[str] | None = None, unread_only: bool = True) -> DataFrame:
    """S10 (re-aimed on a landed message table): date, sender-in-list and
    subject-contains-any predicates, case-insensitive, unread only."""
    cond = F.lit(True)
    if since:
        cond = cond & (F.col("date") >= F.lit(since).cast("date"))
    if senders:
        s = F.lower(F.col("sender"))
        cond = cond & F.exists(F.array(*[F.lit(x.lower()) for x in senders]), lambda x: F.contains(s, x))
    if subjects:
        t = F.lower(F.col("subject"))
        cond = cond & F.exists(F.array(*[F.lit(x.lower()) for x in subjects]), lambda x: F.contains(t, x))
    if unread_only:
        cond = cond & ~F.col("seen")
    return msgs.filter(cond)
