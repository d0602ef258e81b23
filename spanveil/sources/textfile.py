"""Plain text and Markdown files: a scan and a sink in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import extension, text_mime, u16len

BOM = "unhex('EFBBBF')"


def read(spark: SparkSession, path: str, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, rejects) of a folder; size and extension are tested before any content is decoded."""
    return scan(spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1)).select(F.col("path").alias("doc_id"), "name", "length", "content"), limits)


def scan(files: DataFrame, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """files(doc_id, name, length, content) to (doc_id, name, mime, bom, segment_id, text) and rejects without any text."""
    limits = S.TEXT_LIMITS | (limits or {})
    known = text_mime("name").isNotNull()
    small = F.col("length") <= limits["input_bytes"]
    body = F.when(F.expr(f"substring(content, 1, 3) = {BOM}"), F.expr("substring(content, 4)")).otherwise(F.col("content"))
    rows = files.withColumn("bom", F.expr(f"substring(content, 1, 3) = {BOM}")).withColumn("body", F.when(known & small, body))
    rows = rows.withColumn("text", F.when(F.is_valid_utf8(F.col("body").cast("string")), F.col("body").cast("string")))
    code = (
        F.when(~known, "DOCUMENT_FORMAT")
        .when(~small, "DOCUMENT_LIMIT")
        .when(F.col("text").isNull() | (F.instr("text", "\0") > 0), "DOCUMENT_FORMAT")
        .when(u16len("text") > limits["characters"], "DOCUMENT_LIMIT")
    )
    rows = rows.withColumn("code", code)
    good = rows.filter(F.col("code").isNull()).select("doc_id", "name", text_mime("name").alias("mime"), "bom", F.lit("text").alias("segment_id"), "text")
    return good, rows.filter(F.col("code").isNotNull()).select("doc_id", F.lit("extracting").alias("stage"), "code")


def output(masked: DataFrame, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """masked(doc_id, name, bom, masked) to output files with their bytes, and rejects for what became too large."""
    limits = S.TEXT_LIMITS | (limits or {})
    content = F.concat(F.when(F.col("bom"), F.expr(BOM)).otherwise(F.expr("cast('' AS binary)")), F.encode("masked", "UTF-8"))
    rows = masked.select("doc_id", F.concat(F.lit("masked-document."), extension("name")).alias("name"), text_mime("name").alias("mime"), content.alias("content"))
    fits = F.octet_length("content") <= limits["output_bytes"]
    return rows.filter(fits), rows.filter(~fits).select("doc_id", F.lit("rebuilding").alias("stage"), F.lit("DOCUMENT_LIMIT").alias("code"))
