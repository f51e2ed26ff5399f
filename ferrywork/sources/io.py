"""Readers and writers of the pipeline's interchange files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, bad ones are null rows, missing keys null.

    ``required``: an empty input is an error.
    """
    df = spark.read.schema(schema).json(path)
    if required and df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON list of objects; anything but a list is an error."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).where("c <> '['")
    if not first.isEmpty():
        raise ValueError(f"{path} is no list")
    return spark.read.schema(schema).json(path, multiLine=True)


def read_first(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """The JSON list at the first of the paths that exists: full results, else those of a mock run."""
    for path in paths:
        try:
            return read_json_array(spark, path, schema)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {paths}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text and markdown files as one page each: ``path, page_num, text``."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.lit(1).alias("page_num"), F.col("value").alias("text"))


Extractor = Callable[[bytes], list[str]]


def extract_pages(spark: SparkSession, path: str, first: Extractor, second: Extractor | None = None, glob: str = "*.pdf") -> DataFrame:
    """``path, page_num, text`` of paged binary files by pluggable extractors; blank pages are dropped.

    The second extractor takes over where the first raises, gives fewer than 200 signs, or fewer than 70 % ASCII signs.
    Wrongly decoded sequences of a page are repaired.
    """
    from ferrywork.functions.text import normalize_mojibake


    def pages(frames: Iterator) -> Iterator:
        import pandas as pd

        def attempt(f: Extractor | None, data: bytes) -> list[str]:
            try:
                return f(data) if f else []
            except Exception:  # noqa: BLE001 - a broken file is an empty one
                return []

        for pdf in frames:
            out = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                got = attempt(first, data)
                whole = "".join(got)
                if len(whole.strip()) < 200 or sum(c < "\x80" for c in whole) < 0.7 * len(whole):
                    got = attempt(second, data) or got
                out += [(name, i, t) for i, t in enumerate(got, 1) if t.strip()]
            yield pd.DataFrame(out, columns=["path", "page_num", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(pages, "path string, page_num int, text string").withColumn("text", normalize_mojibake(F.col("text")))


def list_files(spark: SparkSession, path: str, glob: str = "*", without: tuple[str, ...] = ()) -> DataFrame:
    """``path, name, length`` of the files below ``path`` whose path holds none of the parts ``without``. The contents are
    not read: only the metadata columns are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    for part in without:
        files = files.where(~F.contains("path", F.lit(part)))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """The frames below ``path`` (``*_endo.png`` without masks) with their watershed and colour masks, where there are any."""
    every = list_files(spark, path, "*.png")
    frames = list_files(spark, path, "*_endo.png", ("_mask", "_watershed", "_color"))
    masks = companion(every, "_endo.png", ["_endo_watershed_mask.png", "_watershed_mask.png"]).withColumnRenamed("companion", "watershed_mask_path")
    colours = companion(every, "_endo.png", ["_endo_color_mask.png", "_color_mask.png"]).withColumnRenamed("companion", "color_mask_path")
    rows = frames.join(masks, "path", "left").join(colours, "path", "left")
    return rows.select(F.col("path").alias("source"), "watershed_mask_path", "color_mask_path", F.col("watershed_mask_path").isNotNull().alias("has_mask"))


def resolve_frames(rows: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """``rows`` with ``frame_path`` resolved and ``frame_exists``: the path as given, else ``root/split/image_filename``,
    else ``root/split/video_frame.jpg``, the first that ``files`` (``path``) holds; none leaves the given path."""
    options = (
        F.col("frame_path"), F.concat_ws("/", F.lit(root), "split", "image_filename"),
        F.concat(F.lit(f"{root}/"), "split", F.lit("/"), F.col("video_id").cast("string"), F.lit("_"), F.col("frame_id").cast("int").cast("string"), F.lit(".jpg")),
    )
    keyed = rows.withColumn("_key", F.xxhash64(F.to_json(F.struct("*"))))
    wanted = keyed.select("_key", F.posexplode(F.array(*options)).alias("_at", "path")).where("path is not null").distinct()
    found = wanted.join(files.select("path").distinct(), "path").groupBy("_key").agg(F.min_by("path", "_at").alias("_found"))
    out = keyed.join(found, "_key", "left")
    return out.withColumn("frame_exists", F.col("_found").isNotNull()).withColumn("frame_path", F.coalesce("_found", "frame_path")).drop("_key", "_found")


def resolve_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``manifest`` with the ``path`` of its file; .txt and .pdf stand in for each other, rows without a file are left out."""
    stem = lambda c: F.regexp_replace(F.lower(c), r"\.(?:txt|pdf|md)$", "")
    f = files.select(stem(F.col("name")).alias("_stem"), F.col("path"), F.lower("name").alias("_name"))
    joined = manifest.withColumn("_want", stem(F.col("filename"))).join(f, F.col("_want") == F.col("_stem"))
    best = joined.groupBy("doc_id").agg(F.max_by("path", F.when(F.col("_name") == F.lower("filename"), 1).otherwise(0)).alias("path"))
    return manifest.join(best, "doc_id")


def companion(files: DataFrame, suffix: str, others: list[str]) -> DataFrame:
    """``path, companion``: for files ending in ``suffix``, the first of the other endings that exists beside them."""
    base = files.where(F.col("path").endswith(suffix)).withColumn("_base", F.expr(f"left(path, length(path) - {len(suffix)})"))
    out = base.select("path", "_base")
    for i, o in enumerate(others):
        other = files.where(F.col("path").endswith(o)).select(F.expr(f"left(path, length(path) - {len(o)})").alias("_base"), F.col("path").alias(f"_c{i}"))
        out = out.join(other, "_base", "left")
    return out.select("path", F.coalesce(*[f"_c{i}" for i in range(len(others))]).alias("companion"))


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """``path, image`` by Spark's image source (decoded in the JVM, BGR); an unreadable file has height -1."""
    df = spark.read.format("image").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return df.select(F.col("image.origin").alias("path"), "image")


MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}


def base64_images(files: DataFrame) -> DataFrame:
    """``path, mime, data`` (base64) of binary files; an unknown ending is taken as JPEG."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    mime = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ext), F.lit("image/jpeg"))
    return files.select("path", mime.alias("mime"), F.base64("content").alias("data"))


# --- writers -------------------------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; signs beyond ASCII stay as they are."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """A small report as one JSON list at a local ``path``: the rows pass the driver one by one."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(df.toJSON().toLocalIterator()):
            f.write(("," if i else "") + "\n  " + r)
        f.write("\n]\n")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` makes one file and is meant for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def append_new(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys are not in the JSON lines at ``path`` yet; returns what was appended."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(df.schema).json(path).select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()
        fresh = df.join(done, keys, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = df
    from ferrywork.runtime import cut

    fresh = cut(fresh)
    fresh.write.mode("append").json(path)
    return fresh


def overwrite_keyed(cache: DataFrame, new: DataFrame, path: str, key: str = "cache_key") -> None:
    """The cache with the rows of ``new`` in place of equal keys, written as Parquet to another ``path``."""
    cache.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).write.mode("overwrite").parquet(path)


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small report as a markdown table; ``limit`` is the report's length."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    show = lambda v: f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join([head, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def markdown_report(title: str, parts: dict[str, DataFrame], facts: dict[str, object] | None = None) -> str:
    """A report of small tables: a title, facts as a list, and a section with a table for each part."""
    lines = [f"# {title}", "", *(f"- **{k}**: {v}" for k, v in (facts or {}).items()), ""]
    for name, df in parts.items():
        lines += [f"## {name}", "", markdown_table(df), ""]
    return "\n".join(lines)


def config(spark: SparkSession, prefix: str = "spark.ferrywork.", **defaults: object) -> dict[str, object]:
    """Settings by name: the session's ``prefix + name``, else the environment's upper-case name, else the default, in the
    default's type (1, true and yes stand for true)."""
    import os

    out: dict[str, object] = {}
    for name, default in defaults.items():
        given = spark.conf.get(prefix + name, None) or os.environ.get(name.upper())
        kind = type(default)
        out[name] = default if given is None else given.lower() in ("1", "true", "yes") if kind is bool else kind(given) if default is not None else given
    return out


def enabled_models(settings: dict, only: str | None = None) -> list[dict]:
    """The models that a configuration enables, or the one with the id ``only``, enabled or not; an unknown id is an error."""
    models = settings.get("vqa", {}).get("models", [])
    chosen = [m for m in models if m["id"] == only] if only else [m for m in models if m.get("enabled", False)]
    if only and not chosen:
        raise ValueError(f"unknown model {only}")
    return chosen


def read_yaml(path: str) -> dict:
    """A YAML configuration; needs the package ``yaml``."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the package yaml") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 30) -> DataFrame:
    """``bin, n``: what a plot of the column shows."""
    return df.where(F.col(column).isNotNull()).groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def examples(df: DataFrame, keys: list[str], path: Column, most: int = 10) -> DataFrame:
    """At most ``most`` distinct paths of each group, in their order."""
    from pyspark.sql import Window

    rows = df.select(*keys, path.alias("path")).distinct()
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where(F.col("_rn") <= most).drop("_rn")
