"""Text artifacts and their lines.

An artifact is one input text (file_id, name, ord, content); a line has file_id, file_ord, line_no (from 1) and line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes of an uploaded text and of a certificate.
TEXT_LIMIT, CERTIFICATE_LIMIT = 50 << 20, 5 << 20
#: What ends a line: as in Unicode line splitting, with the three ASCII separators.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def read_artifacts(spark: SparkSession, path: str, limit: int = TEXT_LIMIT) -> DataFrame:
    """The files under path, bytes that aren't UTF-8 replaced; a file over the limit gives a row with error and no content.

    Files are read one per row by the executors, so a folder of any size is spread over the cluster.
    """
    files = spark.read.format("binaryFile").load(path)
    ok = F.col("length") <= limit
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.col("path").alias("file_id"),
        name.alias("name"),
        F.when(ok, F.expr("make_valid_utf8(cast(content as string))")).alias("content"),
        F.when(~ok, F.concat(name, F.lit(f" is larger than {limit} bytes"))).alias("error"),
    )


def with_pasted(artifacts: DataFrame, pasted: str | None) -> DataFrame:
    """The artifacts and, if it isn't blank, the pasted text as one more."""
    if not (pasted or "").strip():
        return artifacts
    row = artifacts.sparkSession.createDataFrame([("pasted", "pasted", pasted)], "file_id string, name string, content string")
    return artifacts.unionByName(row, allowMissingColumns=True)


def one_source(artifacts: DataFrame | None, pasted: str | None) -> DataFrame | None:
    """Either files or a pasted text, never both: the artifacts, or the text as one; null without any."""
    has_text = bool((pasted or "").strip())
    if artifacts is not None and has_text:
        raise ValueError("give files or a pasted text, not both")
    if has_text:
        return SparkSession.active().createDataFrame([("pasted", "pasted", pasted)], "file_id string, name string, content string")
    return artifacts


def read_certificates(spark: SparkSession, path: str, limit: int = CERTIFICATE_LIMIT) -> DataFrame:
    """file_id, certificate (Base64 of its DER, null if there is none) and error for each certificate in the files under path,
    in PEM, Base64 or DER."""
    files = spark.read.format("binaryFile").load(path)
    text = F.expr("make_valid_utf8(cast(content as string))")
    pem = F.regexp_extract_all(text, F.lit(r"-----BEGIN CERTIFICATE-----([A-Za-z0-9+/=\s]+)-----END CERTIFICATE-----"), 1)
    bare = F.regexp_replace(text, r"\s", "")
    plain = F.when(F.hex(F.substring("content", 1, 1)) == "30", F.regexp_replace(F.base64("content"), r"\s", "")).when(bare.rlike("^[A-Za-z0-9+/]{40,}=*$"), bare)
    found = F.when(F.size(pem) > 0, F.transform(pem, lambda x: F.regexp_replace(x, r"\s", ""))).otherwise(F.array(plain))
    rows = files.select(F.col("path").alias("file_id"), "length", F.explode(F.when(F.col("length") <= limit, found).otherwise(F.array(F.lit(None).cast("string")))).alias("certificate"))
    error = F.when(F.col("length") > limit, F.lit(f"larger than {limit} bytes")).when(F.col("certificate").isNull(), "no certificate")
    return rows.select("file_id", "certificate", error.alias("error"))


def lines_of(artifacts: DataFrame, content: str = "content", order: Column | None = None) -> DataFrame:
    """file_id, file_ord, line_no, line of each artifact; a last line end opens no further line."""
    text = F.regexp_replace(F.col(content), f"({LINE_END})$", "")
    parts = F.when(F.length(F.col(content)) > 0, F.split(text, LINE_END))
    ord_ = order if order is not None else F.lit(0)
    return artifacts.select("file_id", ord_.cast("int").alias("file_ord"), F.posexplode(parts).alias("n", "line")).select("file_id", "file_ord", (F.col("n") + 1).cast("int").alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str, limit: int = TEXT_LIMIT) -> DataFrame:
    return lines_of(read_artifacts(spark, path, limit))
