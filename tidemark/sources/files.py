"""Files as bytes: digests, lengths and declared colours, held against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.text import contrast


def stored_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, bytes, sha256, fills) of the files below ``path``; the bytes themselves go no further than the task that read them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), fills(F.decode("content", "UTF-8")).alias("fills"))


def fills(svg: Column) -> Column:
    """The colours that an SVG text declares as fill, as attribute or style, rrggbb, each once in order; three digits are doubled."""
    stated = F.regexp_extract_all(svg, F.lit(r"(?i)\bfill\s*[:=]\s*[\"']?\s*#([0-9a-f]{6}|[0-9a-f]{3})\b"), F.lit(1))
    return F.array_distinct(F.transform(stated, lambda c: F.lower(F.when(F.length(c) == 3, F.regexp_replace(c, "(.)", "$1$1")).otherwise(c))))


def against_manifest(files: DataFrame, manifest: DataFrame, least: float = 3.0) -> DataFrame:
    """(name, problem) of files (name, bytes, sha256, fills) and a manifest (name, bytes, sha256, fill, contrast).

    missing: named, not stored; unnamed: stored, not named; size and digest: other bytes than stated;
    repeated: the same bytes as another stored file; fill: the stated colour is not declared; contrast: stated otherwise than it
    comes out against white, to two places, or below ``least``. A file has a row for each of its problems.
    """
    same = files.groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1")
    f = files.join(same, "sha256", "left").select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s"), "fills", F.coalesce("copies", F.lit(1)).alias("copies"), F.lit(True).alias("stored"))
    m = manifest.select("name", "bytes", "sha256", "fill", F.col("contrast").alias("stated"), F.lit(True).alias("named"))
    both = m.join(f, "name", "full")
    real = F.round(contrast(F.col("fill"), F.lit("ffffff")), 2)
    here = F.col("stored") & F.col("named")
    problems = {
        "missing": F.col("stored").isNull(), "unnamed": F.col("named").isNull(), "size": here & (F.col("bytes") != F.col("b")), "digest": here & (F.col("sha256") != F.col("s")), "repeated": F.col("copies") > 1,
        "fill": here & ~F.array_contains("fills", F.col("fill")), "contrast": F.col("named") & (F.coalesce(real != F.round("stated", 2), F.lit(True)) | (real < least)),
    }
    return both.select("name", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in problems.items()]))).alias("problem"))
