"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from noticeloom import rules, schemas
from noticeloom.operators.latest import assert_unique
from noticeloom.sources.writers import of_known_version


def _file_columns() -> list[Column]:
    return [
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("_metadata.file_path").alias("file_path"),
    ]


def read_batches(
    spark: SparkSession, path: str, pattern: str = rules.BATCH_FILE_GLOB
) -> DataFrame:
    """Batch files, one row each with nested documents.

    An unknown schema version and a file that is not whole JSON are errors, whatever is selected.
    """
    raw = (
        spark.read.schema(schemas.BATCH)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", pattern)
        .json(path)
        .select("*", *_file_columns())
    )
    return checked_batches(raw)


def checked_batches(raw: DataFrame) -> DataFrame:
    """Batch rows with the version checked and the development flag defaulted."""
    return of_known_version(raw).withColumn(
        "development_mode", F.coalesce("development_mode", F.lit(False))
    )


def written_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Complete batch folders, one row each: header, batch_id, path and time; newest first.

    Sources and audit of a batch are the tables ``sources`` and ``audit`` beside its documents.
    """
    place = F.regexp_replace("file_path", "/header/[^/]*$", "")
    fields = [field for field in schemas.BATCH if field.name not in ("documents", "source_ids", "compliance_audit")]
    headers = (
        spark.read.schema(T.StructType(fields))
        .option("mode", "FAILFAST")
        .json(f"{folder.rstrip('/')}/{rules.BATCH_FOLDER_GLOB}/header")
        .select("*", *_file_columns())
        .withColumn("path", place)
        .withColumn("batch_id", F.regexp_extract(place, "([^/]+)$", 1))
    )
    return checked_batches(headers).orderBy(F.desc("modified_at"), F.desc("batch_id"))


def written_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all complete batch folders with their batch_id."""
    whole = written_batches(spark, folder).select("batch_id")
    read = spark.read.option("mergeSchema", True).parquet(f"{folder.rstrip('/')}/{rules.BATCH_FOLDER_GLOB}/documents")
    batch = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/documents/[^/]*$", 1)
    found = read.select("*", batch.alias("batch_id")).join(whole, "batch_id", "left_semi")
    return of_known_version(found).drop("schema_version")


def batch_documents(batches: DataFrame) -> DataFrame:
    """Documents of the batches with their batch name and place in it."""
    return batches.select(
        F.col("name").alias("batch_id"), F.posexplode("documents").alias("place", "document")
    ).select("batch_id", "place", "document.*")


def latest_batch(spark: SparkSession, path: str, pattern: str = rules.BATCH_FILE_GLOB) -> str:
    """Path of the newest batch: a batch file, or a batch folder with its header.

    Reads file metadata only.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", "modificationTime")
    )
    folder = F.regexp_extract("path", f"^(.*/{_glob(rules.BATCH_FOLDER_GLOB)})/header/[^/]+[.]json$", 1)
    alone = F.regexp_extract("path", f"^(.*/{_glob(pattern)})$", 1)
    batch = F.when(folder != "", folder).when(~F.col("path").contains("/header/"), alone)
    found = files.select(batch.alias("path"), "modificationTime").filter("path <> ''")
    newest = found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    if newest["path"] is None:
        raise ValueError(f"no policy batch found in {path}")
    return newest["path"]


def _glob(pattern: str) -> str:
    """A file pattern with stars as a regular expression."""
    return "[^/]*".join(re.escape(part) for part in pattern.split("*"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source configuration with defaults; wrong booleans, versions, origins or ids are errors."""
    fields = [field for field in schemas.SOURCE if field.name != "enabled"]
    raw_type = T.ArrayType(T.StructType([*fields, T.StructField("enabled", T.StringType())]))
    text = _whole_json(spark, path)
    # from_json turns a JSON true into the text "true" and also a string "true": check the variant.
    parsed = text.select(
        F.posexplode(
            F.arrays_zip(
                F.from_json("value", raw_type).alias("row"),
                F.try_variant_get(F.parse_json("value"), "$", "array<variant>").alias("raw"),
            )
        ).alias("seq", "item")
    )
    flag = F.try_variant_get(F.col("item.raw"), "$.enabled", "variant")
    rows = parsed.select(
        "seq", "item.row.*", F.schema_of_variant(flag).alias("flag_type")
    ).select("seq", *schemas.SOURCE.names, "flag_type")
    return checked_sources(rows)


def checked_sources(rows: DataFrame) -> DataFrame:
    """Defaults and checks of source rows; ``flag_type`` is the JSON type of ``enabled``."""

    def checked(value: Column, ok: Column, message: str) -> Column:
        failed = F.raise_error(F.concat(F.lit("source "), F.col("source_id"), F.lit(": " + message)))
        return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(failed)

    version = F.coalesce("adapter_version", F.lit("unregistered"))
    origin = F.coalesce("origin", F.lit("manual"))
    flag = F.col("flag_type")
    enabled = F.when(flag.isNull(), "true").otherwise(F.col("enabled"))
    ready = rows.select(
        *[name for name in rows.columns if name not in _CHECKED],
        checked(
            enabled.cast("boolean"),
            flag.isNull() | (flag == "BOOLEAN"),
            "enabled must be a JSON boolean",
        ).alias("enabled"),
        F.coalesce("request_interval_seconds", F.lit(1.0)).alias("request_interval_seconds"),
        checked(version, F.trim(version) != "", "adapter_version must be a nonempty string").alias(
            "adapter_version"
        ),
        checked(
            origin, origin.isin(list(rules.ORIGINS)), "origin must be manual or discovery"
        ).alias("origin"),
    )
    return assert_unique(ready, ["source_id"], "source_id")


_CHECKED = {"enabled", "request_interval_seconds", "adapter_version", "origin", "flag_type"}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry records in file order; ``registry_violations`` says what is wrong with them."""
    text = _whole_json(spark, path)
    rows = text.select(
        F.posexplode(F.from_json("value", T.ArrayType(schemas.REGISTRY))).alias("seq", "record")
    ).select("seq", "record.*")
    if "source_id" in rows.columns:
        assert_unique(rows, ["source_id"], "source_id")
    return rows.withColumns(
        {
            "registration": F.coalesce("registration", F.lit("unknown")),
            "authorization": F.coalesce("authorization", F.lit("unknown")),
            "owner": F.coalesce("owner", F.lit("unassigned")),
            "origin": F.coalesce("origin", F.lit("manual")),
            "available_fields": F.coalesce("available_fields", F.array().cast("array<string>")),
        }
    )


def registry_type_violations(records: DataFrame, json_column: str = "value") -> DataFrame:
    """Type errors a typed read would hide: flags that are not booleans, inexact rate limits.

    ``records`` holds one raw JSON object per row.
    """
    members = F.try_variant_get(F.try_parse_json(json_column), "$", "map<string,variant>")

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_element_at(members, F.lit(name))), F.lit("VOID"))

    optional = ("terms_confirmed", "registration_completed", "field_permission_confirmed")
    limits = F.try_variant_get(
        F.try_element_at(members, F.lit("rate_limit")), "$", "map<string,variant>"
    )
    limit_keys = F.map_keys(limits)

    def not_iso(name: str) -> Column:
        value = F.try_variant_get(F.try_element_at(members, F.lit(name)), "$", "string")
        iso = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value).isNotNull()
        return (kind(name) != "VOID") & ~F.coalesce(iso, F.lit(False))

    def limit_kind(name: str) -> Column:
        return F.schema_of_variant(F.try_element_at(limits, F.lit(name)))

    expected = F.array(*[F.lit(name) for name in sorted(schemas.RATE_LIMIT.names)])
    checks = [
        F.when(kind("enabled") != "BOOLEAN", "enabled must be a JSON boolean"),
        *[
            F.when(
                ~kind(name).isin("BOOLEAN", "VOID"), f"{name} must be a JSON boolean or null"
            )
            for name in optional
        ],
        F.when(
            (kind("rate_limit") != "VOID")
            & ~F.coalesce(F.array_sort(limit_keys) == expected, F.lit(False)),
            f"rate_limit must contain exactly {sorted(schemas.RATE_LIMIT.names)}",
        ),
        *[
            F.when(limit_kind(name) != "BIGINT", f"rate_limit.{name} must be a positive integer")
            for name in ("max_requests", "period_seconds")
        ],
        F.when(
            ~limit_kind("minimum_interval_seconds").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"),
            "rate_limit.minimum_interval_seconds must be a positive number",
        ),
        F.when(
            ~kind("available_fields").rlike("^(ARRAY.*|VOID)$"),
            "available_fields must be a JSON array",
        ),
        *[
            F.when(not_iso(name), f"{name} must be an ISO date")
            for name in ("verified_at", "review_due_at")
        ],
    ]
    found = F.filter(F.array(*checks), lambda item: item.isNotNull())
    return records.withColumn("type_violations", found)


def _whole_json(spark: SparkSession, path: str) -> DataFrame:
    """Files as text, one row each; one that is not a JSON array is an error, never an empty list."""
    text = spark.read.text(path, wholetext=True)
    array = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("_metadata.file_path"))).cast("boolean")
    return text.filter(F.when(array, F.lit(True)).otherwise(failed))


def _json_array(spark: SparkSession, path: str, item: T.DataType) -> DataFrame:
    text = _whole_json(spark, path)
    return text.select(F.posexplode(F.from_json("value", T.ArrayType(item))).alias("seq", "item"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Classification codes and names."""
    return _json_array(spark, path, schemas.CODE).select("item.*")


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Business tags in file order."""
    return _json_array(spark, path, T.StringType()).select("seq", F.col("item").alias("tag"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Search keywords: text, tag and optional signal strength."""
    return _json_array(spark, path, schemas.KEYWORD).select("seq", "item.*")


def read_portals(spark: SparkSession, path: str) -> DataFrame:
    """Portal seeds."""
    return _json_array(spark, path, schemas.PORTAL).select("seq", "item.*")


def read_industry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Code and name rows of a UTF-8 CSV with a header, with or without a byte order mark."""
    rows = (
        spark.read.schema(schemas.CODE)
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return rows.select("*", F.monotonically_increasing_id().alias("seq"))


def snapshot_parts(path: Column | str) -> Column:
    """Id, copy number, extension and UTC day out of ``<root>/<YYYYMMDD>/<id>[-n].<ext>``."""
    location = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(location, r"/(\d{8})/([^/]+)$", 2)
    day = F.try_to_date(F.regexp_extract(location, r"/(\d{8})/[^/]+$", 1), "yyyyMMdd")
    stem = r"^(.+?)(?:-(\d+))?\.([^.]+)$"
    return F.struct(
        day.alias("collected_on"),
        F.regexp_extract(name, stem, 1).alias("snapshot_id"),
        F.coalesce(F.regexp_extract(name, stem, 2).try_cast("int"), F.lit(0)).alias("copy"),
        F.regexp_extract(name, stem, 3).alias("extension"),
    )


def read_snapshots(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Stored raw pages with the parts of their path: ``content`` as bytes, ``body`` of pages as text.

    ``body`` is decoded by the declared charset, UTF-8 without one, and characters that do not fit
    are replaced; files of other kinds have no body. Files without a byte give no row.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
    )
    rows = files.select("path", snapshot_parts("path").alias("parts"), F.col("length").alias("size"), "content")
    page = F.lower("parts.extension").isin("html", "htm", "txt", "json", "xml")
    return rows.select("path", "parts.*", "size", "content", F.when(page, _decoded("content")).alias("body"))


@F.arrow_udf(T.StringType())
def _decoded(contents: pa.Array) -> pa.Array:
    def decode(content: bytes | None) -> str | None:
        if content is None:
            return None
        declared = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", content[:2048])
        name = declared[1].decode() if declared else "utf-8-sig"
        try:
            return content.decode("gb18030" if name.lower() in ("gb2312", "gbk") else name, "replace")
        except LookupError:
            return content.decode("utf-8", "replace")

    # One file at a time is a Python object; the batch stays Arrow data.
    return pa.array((decode(content.as_py()) for content in contents), pa.string())


def read_reports(spark: SparkSession, path: str, schema: T.StructType, pattern: str) -> DataFrame:
    """Report files with their data, newest first."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .json(path)
        .select("*", *_file_columns())
        .orderBy(F.col("modified_at").desc(), F.col("name").desc())
    )


def read_export(
    spark: SparkSession, run_dir: str, sheet: str = rules.PRIORITY_SHEET, query: str = ""
) -> DataFrame:
    """One sheet of an export, optionally searched over all cells; unknown sheets give the first."""
    from noticeloom.functions.text import search

    known = (rules.PRIORITY_SHEET, rules.OBSERVATION_SHEET)
    chosen = sheet if sheet in known else known[0]
    rows = spark.read.parquet(run_dir).filter(F.col("sheet_name") == chosen)
    return rows.filter(search(query, list(rules.EXPORT_HEADERS)))
