"""Readers and writers: delimited, factor and feed files, a catalog that tolerates missing tables, keyed upserts."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealweave.session import written

log = logging.getLogger(__name__)
FACTORS = ("mkt", "smb", "hml", "rmw", "cma", "rf")


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8", skip_bad: bool = False) -> DataFrame:
    """A delimited file with a header by a declared schema; bad lines fail as NULLs, or are left out."""
    mode = "DROPMALFORMED" if skip_bad else "PERMISSIVE"
    df = spark.read.schema(schema).option("header", True).option("encoding", encoding).option("mode", mode).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_factors(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, mkt, smb, hml, rmw, cma, rf) of a monthly factor file: lines that open with six digits and have seven fields, in percent; other lines are left out."""
    t = spark.read.text(path).filter(F.col("value").rlike(r"^\s*\d{6}[,\s]"))
    parts = F.split(F.trim("value"), r"[,\s]+")
    t = t.select(parts.alias("p")).filter(F.size("p") == len(FACTORS) + 1)
    date = F.last_day(F.to_date(F.concat(F.col("p")[0], F.lit("01")), "yyyyMMdd"))
    out = t.select(date.alias("date"), *[(F.col("p")[i + 1].try_cast("double") / 100).alias(f) for i, f in enumerate(FACTORS)]).na.drop(subset=["date"])
    if start:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    return out.filter(F.col("date") <= F.lit(end).cast("date")) if end else out


def read_feed(spark: SparkSession, path: str, row_tag: str = "item", keywords: Sequence[str] = (), per_source: int | None = None) -> DataFrame:
    """(title, summary, link, published, source) of feed files (RSS items, Atom entries); source is the file's name.

    Those whose title and summary hold none of the keywords are left out; per_source keeps the first entries of each file.
    """
    raw = spark.read.option("rowTag", row_tag).schema("title string, description string, summary string, link string, pubDate string, updated string").format("xml").load(path)
    t = raw.select("title", F.coalesce("summary", "description").alias("summary"), "link", F.coalesce("pubDate", "updated").alias("published"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"))
    if keywords:
        text = F.lower(F.concat_ws(" ", "title", "summary"))
        t = t.filter(F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k)))
    if per_source:
        from pyspark.sql import Window

        w = Window.partitionBy("source").orderBy(F.monotonically_increasing_id())
        t = t.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_source).drop("_r")
    return t


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of an edge file: Parquet or CSV with source, target and weight; repeated pairs are summed."""
    e = spark.read.parquet(path) if "parquet" in path else read_csv(spark, path, "source string, target string, weight double")
    return e.groupBy(F.col("source").alias("src"), F.col("target").alias("dst")).agg(F.sum("weight").alias("weight"))


def random_graph(spark: SparkSession, n: int = 200, p: float = 0.05, seed: int = 42) -> DataFrame:
    """(src, dst, weight) of a random directed graph; the pairs are enumerated by number, not by joining nodes."""
    pairs = spark.range(n * n).select(F.floor(F.col("id") / n).alias("src"), (F.col("id") % n).alias("dst"), F.rand(seed).alias("u"))
    return pairs.filter((F.col("src") != F.col("dst")) & (F.col("u") < p)).select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(1.0).alias("weight"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Catalog:
    """Named tables: the first root that has one wins; a table that is nowhere, or lacks a declared column, is an empty frame. Roots are Hadoop paths."""

    def __init__(self, spark: SparkSession, schemas: dict[str, str], roots: Sequence[str]):
        self.spark, self.schemas, self.roots = spark, schemas, list(roots)

    def table(self, name: str, order: Sequence[str] = (), limit: int | None = None, **wanted: object) -> DataFrame:
        """The table's declared columns; wanted values are equal ones or lists of them. An undeclared name raises KeyError."""
        schema = T.StructType.fromDDL(self.schemas[name])
        out = self.spark.createDataFrame([], schema)
        for root in self.roots:
            if _exists(self.spark, f"{root}/{name}.parquet"):
                found = self.spark.read.parquet(f"{root}/{name}.parquet")
            elif _exists(self.spark, f"{root}/{name}.csv"):
                found = read_csv(self.spark, f"{root}/{name}.csv", self.schemas[name])
            else:
                continue
            if missing := {f.name for f in schema} - set(found.columns):
                log.warning("%s/%s lacks %s and is passed over", root, name, sorted(missing))
                continue
            out = found.select(*[F.col(f.name).cast(f.dataType) for f in schema])
            break
        for column, value in wanted.items():
            out = out.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
        out = out.orderBy(*order) if order else out
        return out if limit is None else out.limit(limit)

    def register(self) -> None:
        for name in self.schemas:
            self.table(name).createOrReplaceTempView(name)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).option("header", True).save(path)


def read_through(spark: SparkSession, path: str, compute) -> DataFrame:
    """The table at path, computed and written first where it isn't there."""
    if not _exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new in place of those of equal keys (NULL equals NULL); of several new rows of one key the last by order stays."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (order or [c for c in new.columns if c not in keys] or keys)])
    latest = new.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    on = None
    renamed = latest.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        on = c if on is None else on & c
    return old.join(renamed, on, "left_anti").unionByName(latest)


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, content) of the newest manifest of an upserted table; (0, {}) where there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(f"{path}/_manifests")):
        return 0, {}
    names = [x.getPath().getName() for x in fs.listStatus(fs_path(f"{path}/_manifests"))]
    last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)
    if not last:
        return 0, {}
    text = spark.read.option("wholetext", True).text(f"{path}/_manifests/{last:012d}.json").first()[0]
    return last, json.loads(text)


def upsert_path(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], order: Sequence[str] = (), buckets: int = 64) -> None:
    """Upserts into a table of Parquet files in buckets by key; read it by read_upserted.

    Only the buckets that new has keys of are read and written, into files of their own; a manifest, created last, then names the files of each bucket. So a write
    that fails, or is done again, leaves the table as it was. Files that no manifest names any more may be deleted.
    """
    number, now = _manifest(spark, path)
    fresh = written(new.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "upsert")
    touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]
    if not touched and number:
        return
    files = now.get("files", {})
    at = [files[str(k)] for k in touched if str(k) in files]
    schema = new.schema if not now else T.StructType.fromJson(now["schema"])
    base = spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)
    version = f"{path}/data-{uuid.uuid4().hex}"
    state = upsert(base, fresh.drop("_bucket"), keys, order).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    state.repartition("_bucket").write.partitionBy("_bucket").parquet(version)
    content = json.dumps({"schema": schema.jsonValue(), "files": files | {str(k): f"{version}/_bucket={k}" for k in touched}})
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside, to = fs_path(f"{path}/_manifests/aside-{uuid.uuid4().hex}"), fs_path(f"{path}/_manifests/{number + 1:012d}.json")
    out = fs.create(aside, False)
    out.write(bytearray(content.encode()))
    out.close()
    if not fs.rename(aside, to):
        raise RuntimeError(f"another writer made manifest {number + 1} of {path}")


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert_path keeps; raises where there is none."""
    number, now = _manifest(spark, path)
    if not number:
        raise FileNotFoundError(path)
    schema = T.StructType.fromJson(now["schema"])
    return spark.read.schema(schema).parquet(*now["files"].values()) if now["files"] else spark.createDataFrame([], schema)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A JSON object of lists, one key a table, streamed to the driver row by row; meant for small regional subsets."""
    with open(path, "w") as f:
        f.write("{")
        for i, (name, df) in enumerate(tables.items()):
            f.write(("," if i else "") + json.dumps(name) + ":[")
            for j, row in enumerate(df.toJSON().toLocalIterator()):
                f.write(("," if j else "") + row)
            f.write("]")
        f.write("}")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def to_pandas_batches(df: DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in bounded pieces, for small exports."""
    rows = []
    for r in df.toLocalIterator():
        rows.append(r.asDict())
        if len(rows) == 10_000:
            yield pd.DataFrame(rows)
            rows = []
    if rows:
        yield pd.DataFrame(rows)
