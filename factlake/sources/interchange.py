"""JSON-lines exchange: exports, sync envelopes, write-ahead segments, snapshots.

Files are written and read by Spark, so any Hadoop path works.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.operators.graph import upsert_edges
from factlake.operators.lifecycle import lww_entities, lww_merge

SCHEMA_VERSION = 2
#: The kinds of line in an envelope.
KINDS = ("header", "entity", "fact", "relation", "cursor")


def export_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(line): a header, then one ``{"type", "data"}`` object per record."""
    spark = next(iter(tables.values())).sparkSession
    head = spark.createDataFrame([(SCHEMA_VERSION, "factlake")], "schema_version int, exported_by string")
    out = head.select(F.to_json(F.struct("schema_version", "exported_by")).alias("line"))
    for kind, df in tables.items():
        out = out.unionByName(df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("line")))
    return out


def parse_lines(lines: DataFrame, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, errors) from export lines; bad lines are counted, not fatal."""
    kind = F.get_json_object("line", "$.type")
    rows = lines.withColumn("kind", kind).where("trim(line) <> ''")
    header = F.get_json_object("line", "$.schema_version").isNotNull() & F.col("kind").isNull()
    tables = {}
    for name, schema in schemas.items():
        data = F.from_json("line", f"struct<type:string,data:struct<{schema}>>", {"mode": "PERMISSIVE"})
        tables[name] = rows.where(F.col("kind") == name).select(data.alias("x")).where("x.data IS NOT NULL").select("x.data.*")
    errors = rows.where(~header & ~F.coalesce(F.col("kind").isin(list(schemas)), F.lit(False)))
    return tables, errors.agg(F.count("*").alias("errors"))


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    lines.write.mode("overwrite").option("compression", compression).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of one schema; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# ---- sync envelopes -------------------------------------------------------------


def delta(tables: dict[str, DataFrame], cursors: dict[str, Column]) -> dict[str, DataFrame]:
    """The rows of each table that its cursor has not seen."""
    return {name: df.where(cursors[name]) if name in cursors else df for name, df in tables.items()}


def inserted_after(last_id: str | int) -> Column:
    return F.col("id") > last_id


def updated_after(at: int, last_id: str | int) -> Column:
    """Rows changed after a cursor (updated_at, id); equal times go by id."""
    return F.struct(F.col("updated_at"), F.col("id")) > F.struct(F.lit(at).alias("updated_at"), F.lit(last_id).alias("id"))


def edge_key() -> Column:
    """A text key of an edge that is equal for equal edges."""
    return F.sha2(F.to_json(F.struct("source_id", "relation_type", "target_id", "scope")), 256)


def edges_after(at: int | None, key: str | None = None) -> Column:
    """Edges (created_at, ...) after a cursor. Without a key the cursor's time is
    sent again, as equal times cannot be told apart; upserts make that harmless."""
    if at is None:
        return F.lit(True)
    if key is None:
        return F.col("created_at") >= at
    return F.struct(F.col("created_at"), edge_key()) > F.struct(F.lit(at).cast("long"), F.lit(key))


def passes(entities: DataFrame, facts: DataFrame, relations: DataFrame, cursor: dict) -> dict[str, DataFrame]:
    """The five passes of a delta: entities and facts that are new by id, those that
    changed by (updated_at, id), and edges by (created_at, key)."""
    new = lambda df, name: inserted_after(cursor[name]) if cursor.get(name) is not None else F.lit(True)

    def changed(df: DataFrame, name: str) -> Column:
        seen = cursor.get(f"{name}_updated")
        return (updated_after(*seen) if seen else F.lit(False)) & ~new(df, name)

    return {
        "new_entities": entities.where(new(entities, "entity")), "new_facts": facts.where(new(facts, "fact")),
        "changed_entities": entities.where(changed(entities, "entity")), "changed_facts": facts.where(changed(facts, "fact")),
        "edges": relations.where(edges_after(*cursor.get("edge", (None, None)))),
    }


def apply_envelope(lines: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Check a whole envelope, then upsert its records into ``tables`` (entity, fact,
    relation): the later ``updated_at`` wins, and a new edge replaces the old one."""
    preflight(lines)
    out = {}
    for kind, local in tables.items():
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in local.schema)
        data = F.from_json("line", f"struct<kind:string,data:struct<{schema.replace('` ', '`:')}>>")
        rows = lines.where(F.get_json_object("line", "$.kind") == kind).select(data.alias("x")).select("x.data.*")
        merge = {"entity": lww_entities, "fact": lww_merge, "relation": upsert_edges}[kind]
        out[kind] = merge(local, rows)
    return out


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a review log; blank and malformed lines are skipped, a missing file holds none."""
    schema = "idx long, content string, source_id string, fact_type string"
    try:
        return read_records(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected, k) of a golden query set; k is 10 where it is not given."""
    rows = read_records(spark, path, "query string, expected array<string>, k int")
    return rows.withColumn("k", F.coalesce("k", F.lit(10)))


def next_cursor(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max(F.struct("updated_at", "id")).alias("c")).select("c.updated_at", "c.id")


def envelope(tables: dict[str, DataFrame], clock: int) -> DataFrame:
    """(line_no, line): header, records by kind, trailing cursor with the counts."""
    spark = next(iter(tables.values())).sparkSession
    head = spark.createDataFrame([("header", SCHEMA_VERSION, clock)], "kind string, schema int, upstream_clock_ms long")
    out = head.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.to_json(F.struct("kind", "schema", "upstream_clock_ms")).alias("line"))
    cursor = None
    for i, (kind, df) in enumerate(tables.items(), 1):
        record = F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct(*df.columns).alias("data")))
        out = out.unionByName(df.select(F.lit(i).alias("part"), F.lpad(F.col("id").cast("string"), 24, "0").alias("key"), record.alias("line")))
        one = df.agg(F.count("*").alias(f"{kind}_count"), F.max("id").alias(f"{kind}_last")).withColumn("__one", F.lit(1))
        cursor = one if cursor is None else cursor.join(one, "__one")
    cursor = cursor.drop("__one").withColumn("kind", F.lit("cursor"))
    last = cursor.select(F.lit(99).alias("part"), F.lit("").alias("key"), F.to_json(F.struct("kind", *[c for c in cursor.columns if c != "kind"])).alias("line"))
    return out.unionByName(last)


def preflight(lines: DataFrame) -> dict:
    """Check a whole envelope before anything is applied; raise if it is not sound.

    ``lines`` has part, key, line in order. One aggregate returns one row.
    """
    kind = F.get_json_object("line", "$.kind")
    rows = lines.withColumn("kind", kind)
    got = rows.agg(
        F.count("*").alias("n"),
        F.min(F.struct("part", "key", "kind", "line")).alias("first"),
        F.max(F.struct("part", "key", "kind", "line")).alias("last"),
        F.count_if(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS)).alias("bad"),
        F.count_if(F.col("kind") == "header").alias("headers"),
        F.count_if(F.col("kind") == "cursor").alias("cursors"),
    ).first()
    if not got["n"] or got["first"]["kind"] != "header" or got["headers"] != 1:
        raise ValueError("an envelope begins with one header")
    import json

    if json.loads(got["first"]["line"]).get("schema", 0) > SCHEMA_VERSION:
        raise ValueError("the envelope's schema is newer than this reader")
    if got["last"]["kind"] != "cursor" or got["cursors"] != 1:
        raise ValueError("an envelope ends with one cursor")
    if got["bad"]:
        raise ValueError(f"{got['bad']} lines of unknown kind")
    return json.loads(got["last"]["line"])


# ---- snapshots and segments -------------------------------------------------------


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest): order-free fingerprints of tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))
        one = one.select(F.lit(name).alias("name"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write tables as zstd Parquet, then their manifest last."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    m = manifest(tables)
    m.write.mode("overwrite").parquet(f"{path}/manifest")
    return m


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a backup, after their fingerprints were compared."""
    want = {r["name"]: (r["rows"], r["digest"]) for r in spark.read.parquet(f"{path}/manifest").collect()}
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in want}
    got = {r["name"]: (r["rows"], r["digest"]) for r in manifest(tables).collect()}
    if got != want:
        raise ValueError(f"the backup differs from its manifest: {sorted(n for n in want if want[n] != got[n])}")
    return tables


def append_segment(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def compact(spark: SparkSession, path: str, schema: str, target: str) -> DataFrame:
    """Merge all segments into one new place; what was merged can then go."""
    rows = spark.read.schema(schema).json(path)
    # the session's file and partition settings decide how many files that makes
    rows.write.mode("overwrite").json(target)
    return spark.read.schema(schema).json(target)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, path, content) of every ``*.md`` below a folder, one row each."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    full = F.col("_metadata.file_path")
    below = F.regexp_replace(full, r"^.*?" + path.rstrip("/").rpartition("/")[2] + "/", "")
    return files.select(F.sha2(full, 256).alias("id"), below.alias("path"), F.col("value").alias("content"))
