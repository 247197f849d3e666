"""Readers and writers of record files: JSON lines by manifest, reports, TTL tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

EVIDENCE = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("source", "text", "url")]))
EXAMPLE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("exampleId", "task", "datasetVersion", "split")] + [T.StructField("evidence", EVIDENCE)]
)


def read_manifest(spark: SparkSession, manifest: str, split: str | None = None, holdout: bool = False, schema: T.StructType = EXAMPLE) -> DataFrame:
    """The files a manifest lists, of one split if asked; only these are
    read. Fails on bad JSON, missing files and on counts other than stated;
    holdout entries must be asked for."""
    base = Path(manifest).parent
    entries = [e for e in json.loads(Path(manifest).read_text())["datasets"] if (split is None or e["split"] == split) and (holdout or not e.get("holdout"))]
    if not entries:
        return spark.createDataFrame([], schema).withColumn("path", F.lit(""))
    # One read and one count of all files, however many.
    stated = {str((base / e["path"]).resolve()): e for e in entries}
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(list(stated))
    file = F.url_decode(F.regexp_replace(F.input_file_name(), "^file:/+", "/"))
    paths = F.element_at(F.create_map(*[F.lit(x) for f, e in stated.items() for x in (f, e["path"])]), file)
    rows = rows.withColumn("path", paths)
    # Counted over whole records: a scan of no column would not read them.
    found = {r["path"]: r["n"] for r in rows.groupBy("path").agg(F.count(F.struct(*[F.col(c) for c in schema.names])).alias("n")).collect()}  # one number a file
    for e in entries:
        if found.get(e["path"], 0) != e["examples"]:
            raise ValueError(f"{e['path']}: {found.get(e['path'], 0)} rows, the manifest says {e['examples']}")
    return rows


def read_reports(spark: SparkSession, paths: list[str], result: T.DataType) -> DataFrame:
    """The results of several reports as one table."""
    schema = T.StructType([T.StructField("results", T.ArrayType(result))])
    return spark.read.schema(schema).option("multiLine", True).json(paths).select(F.explode("results").alias("r")).select("r.*")


def hydrate(rows: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows with their JSON payload read out; unreadable ones are skipped."""
    parsed = rows.withColumn("_p", F.from_json(payload, schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.try_parse_json(payload).isNotNull()).select(*[c for c in rows.columns if c != payload], "_p.*")


def feature_records(features: DataFrame) -> DataFrame:
    """GeoJSON features (struct properties, geometry) as flat records."""
    p, g = F.col("properties"), F.col("geometry.coordinates")
    return features.select(
        p["name"].alias("name"), p["phone"].alias("phone"), p["website"].alias("website"), p["formatted"].alias("full_address"), p["city"].alias("city"),
        F.coalesce(p["lat"], F.get(g, F.lit(1))).alias("latitude"), F.coalesce(p["lon"], F.get(g, F.lit(0))).alias("longitude"),
    )


def user_records(rows: DataFrame) -> DataFrame:
    """Records users gave, under whichever names; a record needs a name."""
    has = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in has], F.lit(None).cast("string"))
    name = pick("name", "businessName")
    return rows.select(
        F.when(name.isNull(), F.raise_error(F.lit("a record without name"))).otherwise(name).alias("name"), pick("phone", "phoneNumber").alias("phone"), pick("website", "url").alias("website"),
        pick("address", "full_address").alias("full_address"), pick("postal_code", "zip").alias("postal_code"), pick("review_count", "reviewCount").try_cast("long").alias("review_count"),
    )


def lookup(table: DataFrame, **key) -> DataFrame:
    """The row of a key; a null key has none. The filter reaches the scan."""
    for column, value in key.items():
        table = table.filter(F.lit(False) if value is None else F.col(column) == F.lit(value))
    return table.limit(1)


def hints(rows: DataFrame) -> DataFrame:
    """What an input says for certain about a record, under short names."""
    return rows.withColumnsRenamed({"latitude": "lat", "longitude": "lng"})


def append_jsonl(df: DataFrame, path: str) -> None:
    """S9."""
    df.write.mode("append").json(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small report table."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
