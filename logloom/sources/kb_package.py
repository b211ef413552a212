"""Knowledge-base packages: a zip of one JSON file per article with a manifest."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.kb import KnowledgeBase, with_details

VERSION = "1.0"
#: Articles of one package of several: a package is a file that people exchange.
MOST = 10_000
_ARTICLE = "id string, title string, summary string, content string, status string, tags array<string>, finding_codes array<string>"


def _zipped(articles: list[dict]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({"schema_version": VERSION, "articles": len(articles)}))
        for a in articles:
            z.writestr(f"articles/{a['id']}.json", json.dumps(a, ensure_ascii=False))
    return out.getvalue()


def packages(kb: KnowledgeBase, most: int = MOST) -> DataFrame:
    """part and data: the active articles in as many packages as it takes for none to hold many more than `most`; each is
    zipped by a task, and none of them passes through the driver."""
    rows = with_details(kb).where("status = 'active'").select("id", "title", "summary", "content", "status", "tags", "finding_codes")
    parts = max(1, -(-rows.count() // most))

    def run(t: pa.Table) -> pa.Table:
        found = sorted(t.drop_columns(["part"]).to_pylist(), key=lambda r: r["id"])
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "data": pa.array([_zipped(found)], pa.binary())})

    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(run, "part int, data binary")


def package(kb: KnowledgeBase) -> bytes:
    """The active articles as one package, which somebody downloads; packages() writes a base of any size."""
    rows = with_details(kb).where("status = 'active'").select("id", "title", "summary", "content", "status", "tags", "finding_codes").orderBy("id")
    return _zipped([r.asDict() for r in rows.toLocalIterator()])


#: What one file of a package may inflate to, and all that is read of one package.
FILE_LIMIT, PACKAGE_LIMIT = 10 << 20, 512 << 20
_READ = f"path string, {_ARTICLE}, error string"


def _entries(data: bytes) -> Iterator[tuple[dict | None, str | None]]:
    """An article or what is wrong, for each file of a package; nothing inflates beyond its limit."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        names = z.namelist()
        if "manifest.json" not in names:
            raise ValueError("manifest.json is missing")
        version = json.loads(_inflated(z, "manifest.json")).get("schema_version")
        if version != VERSION:
            raise ValueError(f"schema version {version} isn't {VERSION}")
    except (ValueError, AttributeError, KeyError, OSError, zipfile.BadZipFile, zlib.error) as e:
        yield None, str(e)
        return
    left = PACKAGE_LIMIT
    for name in sorted(n for n in names if n.startswith("articles/") and n.endswith(".json")):
        try:
            raw = _inflated(z, name)
            left -= len(raw)
            if left < 0:
                yield None, f"{name}: the package inflates to more than {PACKAGE_LIMIT} bytes"
                return
            a = json.loads(raw)
            texts = {k: None if a.get(k) is None else str(a[k]) for k in ("id", "title", "summary", "content")}
            if None in (texts["id"], texts["title"], texts["content"]):
                raise ValueError("id, title or content is missing")
            lists = {k: [str(x) for x in a.get(k) or []] for k in ("tags", "finding_codes")}
            yield texts | lists | {"status": a.get("status", "active")}, None
        except (ValueError, AttributeError, KeyError, TypeError, OSError, zipfile.BadZipFile, zlib.error) as e:
            yield None, f"{name}: {e}"


def _inflated(z: zipfile.ZipFile, name: str) -> bytes:
    with z.open(name) as f:
        raw = f.read(FILE_LIMIT + 1)
    if len(raw) > FILE_LIMIT:
        raise ValueError(f"inflates to more than {FILE_LIMIT} bytes")
    return raw


def articles_of(files: DataFrame) -> DataFrame:
    """path, the columns of an article, and error: the packages in files (path, content) read by the tasks that have them. A
    damaged package, or a file in it that can't be read, is a row with an error and no article; the others are read."""
    schema = to_arrow_schema(StructType.fromDDL(_READ))
    names = [f.name for f in schema]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                held = []
                for article, error in _entries(content.as_py() or b""):
                    held.append({n: None for n in names} | (article or {}) | {"path": path, "error": error})
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(read, _READ)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The articles of all packages under a path, in any store that Spark reads: see articles_of."""
    return articles_of(spark.read.format("binaryFile").load(path))


def articles_in(spark: SparkSession, data: bytes) -> tuple[DataFrame, list[str]]:
    """The articles of one package that somebody uploads, and what is wrong with it; read_packages reads many."""
    found = list(_entries(data))
    names = [x.split()[0] for x in _ARTICLE.split(", ")]
    rows = [tuple(a[n] for n in names) for a, _ in found if a]
    return spark.createDataFrame(rows, _ARTICLE), [e for _, e in found if e]
