"""What analyses leave behind as files: decoded SAML documents, anonymised texts with their mappings, tables as JSON."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import saml as saml_source

#: What a kind of document is called in a file name.
SLUGS = {"AuthnRequest": "authnrequest", "Response": "response", "Assertion": "assertion", "EntityDescriptor": "metadata", "EntitiesDescriptor": "metadata"}


def stem(name: Column) -> Column:
    """A file name without its folder and last extension, with what file systems may not like replaced; `input` if none is left."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\\\]", ""), r"(.)\.[^.]*$", "$1")
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "input").otherwise(clean)


def named(items: DataFrame, source: str = "bundle_id") -> DataFrame:
    """items (source, ord, doc_type, ...) with export_name: stem, kind and a running number per source's stem and kind."""
    slug = F.coalesce(*[F.when(F.col("doc_type") == k, v) for k, v in SLUGS.items()], F.lit("saml"))
    rows = items.withColumn("_stem", stem(F.col(source))).withColumn("_slug", slug)
    n = F.row_number().over(Window.partitionBy("_stem", "_slug").orderBy(source, "ord"))
    return rows.withColumn("export_name", F.format_string("%s.%s_%02d.xml", "_stem", "_slug", n)).drop("_stem", "_slug")


def decoded_saml(inputs: DataFrame) -> DataFrame:
    """export_name, bundle_id, source (its chain of wrappings), doc_type and xml of each message in inputs (bundle_id, content);
    a metadata text of several entities is one file."""
    docs = saml_source.documents(inputs, keep_xml=True).where("doc_type <> 'error'")
    one = docs.groupBy("bundle_id", "xml").agg(F.min_by(F.struct("ord", "source", "doc_type"), "ord").alias("x")).select("bundle_id", "x.*", "xml")
    return named(one).select("export_name", "bundle_id", "source", "doc_type", "xml")


def write_files(items: DataFrame, folder: str, name: str = "export_name", content: str = "xml") -> DataFrame:
    """Writes each row's content as a file of its name in a folder that all executors share; gives name and bytes. A file
    appears under its name once it is whole, so a task that is run again leaves the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            sizes = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, part = (text or "").encode(), f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write(data)
                fs.move(part, f"{root}/{os.path.basename(file)}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return items.select(F.col(name).cast("string").alias("name"), F.col(content).cast("string").alias("content")).mapInArrow(run, "name string, bytes long")


def write_anonymised(done: DataFrame, folder: str, key: str = "doc_id") -> None:
    """mask.anonymised() as two tables of JSON lines: the texts, and the mapping of each, which is to be kept apart."""
    done.select(key, "anonymised").write.json(f"{folder}/texts")
    done.select(key, F.explode("mapping").alias("m")).select(key, "m.*").write.json(f"{folder}/mapping")


def write_json(rows: DataFrame, folder: str) -> None:
    """A table of an analysis as JSON lines, whole."""
    rows.write.json(folder)
