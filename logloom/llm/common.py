"""What several training-data operators share: the shared folder, written tables and word hashes.

Words are maximal runs of characters other than space and U+0009 to U+000D.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expressions for the characters between words and for words.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if the session is
    one process (tests); on a cluster that is an error, as each executor would write to its own disk."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = at.get() if at.isDefined() else None
    if not at:
        if not one_process(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/logloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again, so later steps neither repeat it nor need its executors."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.option("compression", compression).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._logloom_at = at
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by stored() that nothing reads any more."""
    at = getattr(df, "_logloom_at", None)
    if at:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(conf).delete(path, True)


#: Keys with over a HEAVY-th of all rows are joined by broadcast: there are at most HEAVY of them, whatever the input.
HEAVY = 2000


def joined_by(rows: DataFrame, per: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """rows joined with per, which has one row per key and `n`, the number of rows with it (dropped again); null is a key.

    Keys that hold over total / HEAVY rows are broadcast, at most HEAVY rows by construction; the rest is an equi-join
    without a key that is hot. Both tables should be stored: each is read twice.
    """
    keys = [key] if isinstance(key, str) else key
    cols = [c for c in per.columns if c != "n"]
    limit = max(1, total // HEAVY)
    heavy, light = (per.where(w).select(*[F.col(c).alias(f"_p_{c}") for c in cols]) for w in (f"n > {limit}", f"n <= {limit}"))
    out = [F.col(c) for c in rows.columns] + [F.col(f"_p_{c}").alias(c) for c in cols if c not in keys]

    def same(left: DataFrame, other: DataFrame) -> Column:
        return reduce(Column.__and__, [left[k].eqNullSafe(other[f"_p_{k}"]) for k in keys])

    first = rows.join(F.broadcast(heavy), same(rows, heavy)).select(*out)
    rest = rows.join(F.broadcast(heavy), same(rows, heavy), "left_anti")
    return first.unionByName(rest.join(light, same(rest, light)).select(*out))


#: Most rows of one Arrow batch: texts can be long, and a Python worker holds a batch or two.
BATCH_ROWS = 1000


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of at most BATCH_ROWS rows (a setting of the session from then on), and
    with the memory that a worker has freed given back when its task ends: workers outlive their tasks."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def words_col(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def n_words_col(text: Column) -> Column:
    return F.size(words_col(text)).cast("long")


def held_out_col(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


_BASE, _CHUNK = np.uint64(0x9E3779B97F4A7C15), 1 << 19
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            p = np.full(_CHUNK + 1, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(p))
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of h."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order; memory is bounded by the chunk, not by the text.

    Equal words have equal hashes anywhere; two different words share one with odds near 2**-64.
    """
    out = []
    power, inverse = _powers()
    at, n = 0, len(text)
    while at < n:
        while at < n and _SPACES[text[at]]:
            at += 1
        to = min(n, at + _CHUNK)
        if to < n:  # ends before a space, so that no word is cut
            cut = to
            while cut > at and not _SPACES[text[cut]]:
                cut -= 1
            if cut == at:  # one word of over a chunk
                end = to
                while end < n and not _SPACES[text[end]]:
                    end += 1
                out.append(_long_word(text[at:end]))
                at = end
                continue
            to = cut
        raw = np.frombuffer(text, np.uint8, to - at, at)
        space = _SPACES[raw]
        edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_TABLE[raw] * power[: len(raw)], out=total[1:])
            out.append((total[end] - total[start]) * inverse[start])
        at = to
    return mixed(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _long_word(word: bytes) -> np.ndarray:
    """The same polynomial as in word_hashes, over a word of any length."""
    power, total, scale = _powers()[0], np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(word), _CHUNK):
            raw = np.frombuffer(word, np.uint8, min(_CHUNK, len(word) - at), at)
            total += scale * np.sum(_TABLE[raw] * power[: len(raw)], dtype=np.uint64)
            scale *= power[_CHUNK]
    return np.array([total], np.uint64)


def texts_of(batch) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8; null gives an empty text."""
    for x in batch:
        v = x.as_py()
        yield v.encode() if v else b""


def in_slices(texts: Iterable, limit: int, size=len) -> Iterator[list]:
    """Consecutive texts in lists of about limit bytes."""
    held, total = [], 0
    for x in texts:
        held.append(x)
        total += size(x)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
