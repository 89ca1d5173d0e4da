"""Corpus manifests, reader records, file inventories, and run outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_DOC = "struct<id:string,path:string,source:string,category:string,provenance:string,sha256:string>"
MANIFEST_SCHEMA = f"struct<version:int,documents:array<{_DOC}>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a version 1 manifest."""
    schema = T._parse_datatype_string(MANIFEST_SCHEMA)
    return spark.read.schema(schema).option("multiLine", True).json(path).where("version = 1").select(F.inline("documents"))


def parse_manifests(df: DataFrame, manifest_id: str, json: str) -> DataFrame:
    return (
        df.select(F.col(manifest_id).alias("manifest_id"), F.from_json(json, MANIFEST_SCHEMA).alias("m"))
        .where("m.version = 1").select("manifest_id", F.inline("m.documents"))
    )


RECORD_SCHEMA = "struct<record:string,reader:string,readers:int,elapsedMs:double,_corrupt:string>"
PAGE_SHAPES = ["OBJECT<Ok: STRING>", "OBJECT<Err: STRING>"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Reader records, a file being a run: (run_id, seq, line, broken). Lines stay
    text until parsed, so a malformed one does not take earlier ones with it;
    ``broken`` marks bytes that are not UTF-8, and a last line without an end."""
    text = F.col("content").cast("string")
    lines = spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]*)$", 1).alias("run_id"), F.size(F.split(text, "\n")).alias("n"),
        F.is_valid_utf8(text).alias("valid"), F.posexplode(F.split(text, "\n")).alias("seq", "line"),
    )
    broken = F.when(F.col("seq") == F.col("n") - 1, "unterminated").when(
        # splitting has put the replacement character for bytes that are none
        ~F.col("valid") & F.contains("line", F.lit("\ufffd")), "not UTF-8"
    )
    return lines.withColumn("broken", broken).where((F.trim("line") != "") | (F.col("broken") == "not UTF-8")).select(
        "run_id", F.col("seq").cast("long").alias("seq"), "line", "broken"
    )


def _pages(v: Column, reader: Column) -> Column:
    """The pages of a reader's result (``ok`` text or null), null where the body is not that reader's.

    One reader numbers its pages from 1 and adds whether it saw graphics:
    ``[[[1, {Ok|Err}], ...], flag]``; the other lists them: ``[{Ok|Err}, ...]``.
    """
    items = lambda x: F.try_variant_get(x, "$", "array<variant>")
    page = lambda p: F.coalesce(F.schema_of_variant(p).isin(PAGE_SHAPES), F.lit(False))
    text = lambda p: F.try_variant_get(p, "$.Ok", "string")
    ok = F.try_variant_get(v, "$.result.Ok", "variant")
    both = items(ok)
    numbered = items(F.get(both, F.lit(0)))
    pairs = F.transform(numbered, items)
    placed = F.transform(pairs, lambda p, i: F.coalesce(
        (F.size(p) == 2) & (F.try_variant_get(F.get(p, F.lit(0)), "$", "bigint") == i + 1) & page(F.get(p, F.lit(1))), F.lit(False)))
    current = (F.size(both) == 2) & (F.schema_of_variant(F.get(both, F.lit(1))) == "BOOLEAN") & F.forall(placed, lambda x: x)
    listed = F.forall(both, page)
    return F.when((reader == "current") & current, F.transform(pairs, lambda p: text(F.get(p, F.lit(1))))).when(
        (reader == "pdfkit") & listed, F.transform(both, text)
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Add ``r`` (the record, all null when malformed) with its ``result`` and
    ``problem`` with the line itself. ``result`` has the pages, or null pages
    where the whole document failed; it is null unless it has the reader's form."""
    held = lines if "broken" in lines.columns else lines.withColumn("broken", F.lit(None).cast("string"))
    r = F.from_json("line", RECORD_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    v = F.try_parse_json(F.col("line"))
    # a line that does not open an object is no record; what it is instead matters only then
    other = F.when(v.isNull(), "malformed").otherwise("not an object")
    opens = F.ltrim("line").startswith("{")
    parsed = held.withColumn("v", v).withColumn("r", r)
    # the names in the result, without a look at what is below them
    names = F.map_keys(F.try_variant_get("v", "$.result", "map<string,variant>"))
    failed = F.schema_of_variant(F.try_variant_get("v", "$.result.Err", "variant")) == "STRING"
    only = lambda name: F.coalesce((F.size("names") == 1) & (F.get("names", F.lit(0)) == name), F.lit(False))
    parsed = parsed.withColumn("names", names).withColumn("pages", F.when(only("Ok"), _pages(F.col("v"), F.col("r.reader"))))
    body = F.when(only("Err") & failed, F.struct(F.lit(None).cast("array<string>").alias("pages"))).when(
        F.col("pages").isNotNull(), F.struct("pages")
    )
    return parsed.withColumn("r", F.struct("r.*", body.alias("result"))).withColumn(
        "problem", F.coalesce("broken", F.when(F.col("r._corrupt").isNotNull() & opens, "malformed").when(~opens, other))
    ).drop("v", "broken", "names", "pages")


MAX_LISTED = 400


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of the files under ``root``; only the listing is read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace("path", "^.*?" + "\\Q" + base + "\\E/", "")
    return files.select(relative.alias("path"), F.col("length").alias("size"))


def inventory(files: DataFrame, limit: int | None = MAX_LISTED) -> DataFrame:
    """(path, is_dir, size) of files and the folders they are in, hidden names
    left out, in path order. ``limit`` is how many a listing shows."""
    shown = files.where(~F.col("path").rlike(r"(^|/)\."))
    parts = F.split("path", "/")
    depth = F.size(parts)
    folders = shown.where(depth > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), depth - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")
    ).distinct().select("path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    listed = shown.select("path", F.lit(False).alias("is_dir"), F.col("size").cast("long").alias("size")).unionByName(folders)
    return listed.orderBy("path") if limit is None else listed.orderBy("path").limit(limit)


def write_run(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Write a run's results, summary and blank review sheet. An earlier run's
    evidence is never overwritten: the write fails if the folder is there."""
    results.write.mode("errorifexists").parquet(f"{path}/results")
    summary.write.mode("errorifexists").json(f"{path}/summary")
    saved = results.sparkSession.read.schema(results.schema).parquet(f"{path}/results")
    review_sheet(saved).write.mode("errorifexists").json(f"{path}/review")


def review_sheet(results: DataFrame) -> DataFrame:
    blank: Column = F.lit("")
    return results.select(
        "id", "sha256", "outcome", F.lit("unreviewed").alias("verdict"), blank.alias("missingContent"), blank.alias("notes")
    )
