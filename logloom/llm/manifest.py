"""Merkle manifest of a dataset: leaves per source, a tree of arity 3 over each source's leaves, one over the sources' roots.

H is the lower-case hex SHA-256 of its inputs, concatenated. A leaf is H of the fields of a row, each `-` if null, else its
length in UTF-8 bytes, `:` and the value. In a group, leaves ascend by their order column; every ARITY consecutive nodes (the
last run: fewer, even one) become their H until one is left, the subroot; a lone leaf is one. Subroots ascend by group, null
first, then by UTF-8 bytes, and give the root by the same rule. Tables hold digests as 32 bytes, half of their text.

Numbers: rows are dealt by range of (group, order), sorted, and counted per partition; a partition's offset makes places of
them. Combining is driven by events: a node goes into the partial parent that its place names; a parent with all children
of its arity, which follows from its place and the number of leaves, becomes a node itself at once. Each task combines what
it has, sorted, so it holds only parents across its borders; what is left over, the frontier, is dealt by stretches
of ARITY**SPAN, ARITY**(2*SPAN), ... leaves and combined again, until only subroots are left. Parents made are kept as
reverse links (parent to children). Proofs follow them down, by the same stretches: a task has the path of the stretch's
top node, its links from top to bottom, and its leaves. So no task holds more than a stretch, however hot a group is.

Nulls: a null group is a group of its own, before all others; a null order value comes first in its group; any field may
be null. An empty text is `0:`. Ties in the order go by leaf digest; equal leaves are exchangeable, as their digests agree,
and rows that are repeated are leaves as often. An empty table gives no rows and has no root. Long texts are hashed in
the JVM where they are read, never shuffled. Columns that are not fields are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, joined_by, mapped, stored

ARITY, SPAN = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A node (no kids) or a reverse link (kids, no digest) of the tree of group `grp`, `start`: its first leaf; `size`: the tree's leaves.
_NODE = "grp string, level int, idx long, start long, size long, digest binary, kids binary"
#: What goes down: path rows (path, subroot), links (kids) or leaves (the rest).
_DOWN = "grp string, level int, idx long, start long, kids binary, path binary, subroot binary, key string, leaf binary, tampered binary"
#: A leaf's proof; key: its order value as text.
_PROVED = "key string, leaf string, subroot string, proof_sha256 string, folded_root string"


def digest_of(values: dict[str, Column]) -> Column:
    """H of the values, each `-` if null, else its length in UTF-8 bytes, `:` and itself; as 32 bytes."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[field(c) for c in values.values()]), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of (grp, ...) with `idx`, their place in their group by `order` from 0, and `size`, the rows of the group."""
    by = [F.asc_nulls_first(c) for c in ["grp", *order, "uid"]]
    held = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "manifest-leaves")
    dealt = held.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("part", F.shiftright("at", 33)).drop("uid"), "manifest-sorted")
    dropped(held)
    counts = dealt.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("grp").orderBy("part")
    per = counts.select(
        "part", "grp", "n", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("grp")).alias("size"))
    per = stored(per, "manifest-counts")
    total = per.agg(F.sum("n")).first()[0] or 0
    out = joined_by(dealt, per, ["part", "grp"], total)
    return out.select("grp", "size", (F.col("at") + F.col("shift")).alias("idx"), *[c for c in rows.columns if c != "grp"])


def parent(kids: list[bytes]) -> bytes:
    return hashlib.sha256("".join(k.hex() for k in kids).encode()).digest()


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    partial: dict[tuple, dict[int, bytes]] = {}  # of (level, idx): children by their place in the run
    grp, size, out = None, 0, []

    def left() -> None:
        for (level, idx), kids in partial.items():
            for slot, digest in kids.items():
                node(level - 1, ARITY * idx + slot, digest, None)
        partial.clear()

    def node(level: int, idx: int, digest: bytes | None, kids: bytes | None) -> None:
        out.append((grp, level, idx, idx * ARITY**level, size, digest, kids))

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("grp", "level", "idx", "size", "digest")]
        for g, level, idx, n, digest in zip(*cols):
            if (g, n) != (grp, size):
                left()
                grp, size = g, n
            while (width := -(-n // ARITY**level)) > 1:
                up, slot = divmod(idx, ARITY)
                kids = partial.setdefault((level + 1, up), {})
                kids[slot] = digest
                arity = min(ARITY, width - ARITY * up)
                if len(kids) < arity:
                    break
                del partial[level + 1, up]
                run = [kids[i] for i in range(arity)]
                level, idx, digest = level + 1, up, parent(run)
                node(level, idx, None, b"".join(run))
            else:
                node(level, idx, digest, None)
        yield _batch(out, _NODE)
        out.clear()
    left()
    yield _batch(out, _NODE)


_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")])
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, kinds)], list(names))


def _rounds(leaves: DataFrame) -> int:
    """After how many rounds a stretch holds the largest group."""
    most, rounds = leaves.agg(F.max("size")).first()[0] or 0, 1
    while ARITY ** (SPAN * rounds) < most:
        rounds += 1
    return rounds


def _stretch(r: int) -> Column:
    """The stretch of leaves that a node is in, in round r."""
    return F.expr(f"start div {ARITY ** (SPAN * r)}L")


def built(leaves: DataFrame, rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """The roots of the groups' trees, as nodes, and tables of the reverse links. leaves: grp, idx, size, digest."""
    nodes = leaves.select("grp", F.lit(0).alias("level"), "idx", "size", "digest")
    links = []
    for r in range(rounds + 1):
        if r:
            nodes = nodes.repartition("grp", _stretch(r))
        made = stored(mapped(nodes.sortWithinPartitions("grp", "idx" if not r else "start"), _combined, _NODE), "manifest-nodes")
        nodes = made.where("kids is null")
        links.append(made.where("kids is not null"))
    return nodes, links


def _descend(floor: int) -> object:
    """Paths go down the links to nodes of level `floor`. Rows are sorted by stretch, then level, highest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        place, out = None, []
        for batch in batches:
            names = [x.split()[0] for x in _DOWN.split(", ")]
            for grp, level, idx, start, kids, path, subroot, key, leaf, tampered in zip(*[batch.column(c).to_pylist() for c in names]):
                here = (grp, start // ARITY ** (floor + SPAN))
                if here != place:
                    place = here
                    paths.clear()
                if path is not None:
                    if level <= floor and floor:
                        out.append((grp, level, idx, start, None, path, subroot, None, None, None))
                    else:
                        paths[level, idx] = (path, subroot)
                elif kids is not None:
                    above, subroot = paths.pop((level, idx))
                    n = len(kids) // 32
                    for slot in range(n):
                        below = bytes((slot, n - 1 - slot)) + kids[: 32 * slot] + kids[32 * slot + 32 :] + above
                        child = ARITY * idx + slot
                        if level - 1 == floor and floor:
                            out.append((grp, floor, child, child * ARITY**floor, None, below, subroot, None, None, None))
                        else:
                            paths[level - 1, child] = (below, subroot)
                else:
                    above, subroot = paths.pop((0, idx))
                    out.append((grp, 0, idx, start, None, above, subroot, key, leaf, tampered))
            yield _batch(out, _DOWN)
            out.clear()

    return run


def _row(**cols: Column) -> list[Column]:
    """The columns of _DOWN, null where not given."""
    return [cols.get(n, F.lit(None)).cast(k).alias(n) for n, k in (x.split() for x in _DOWN.split(", "))]


def with_paths(leaves: DataFrame, links: list[DataFrame], tops: DataFrame, rounds: int, last=None, schema: str = _DOWN) -> DataFrame:
    """The leaves as rows of _DOWN, each with its path: per level, from its own up, how many siblings of its run stand left
    and right of it, one byte each, and their digests. leaves: grp, idx, key, digest, tampered; tops: path rows of the trees' roots; last: what
    each task makes of its leaves' rows, of that schema."""
    c = F.col
    paths = tops
    for r in range(rounds, 0, -1):
        floor = SPAN * (r - 1)
        rows = paths
        for link in links:
            part = link.where((c("level") > floor) & (c("level") <= floor + SPAN))
            rows = rows.unionByName(part.select(*_row(**{n: c(n) for n in ("grp", "level", "idx", "start", "kids")})))
        if r == 1:
            own = _row(grp=c("grp"), level=F.lit(0), idx=c("idx"), start=c("idx"), key=c("key"), leaf=c("digest"), tampered=c("tampered"))
            rows = rows.unionByName(leaves.select(*own))
        dealt = rows.repartition("grp", _stretch(r)).sortWithinPartitions(
            "grp", _stretch(r), F.desc("level"), F.asc_nulls_last("path"), "idx")
        down = _descend(floor)
        if r > 1:
            paths = stored(mapped(dealt, down, _DOWN), "manifest-paths")
    return mapped(dealt, (lambda batches: last(down(batches))) if last else down, schema)


def siblings(path: bytes) -> Iterator[tuple[str, str]]:
    """The digests left and right of a leaf's ancestor at each level, as text, from the leaf up."""
    at = 0
    while at < len(path):
        a = at + 2 + 32 * path[at]
        b = a + 32 * path[at + 1]
        yield path[at + 2 : a].hex(), path[a:b].hex()
        at = b


def folded(leaf: bytes, path: bytes) -> str:
    """The root that a leaf and its siblings give."""
    now = leaf.hex()
    for left, right in siblings(path):
        now = hashlib.sha256((left + now + right).encode()).hexdigest()
    return now


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("key", "path", "subroot", "leaf", "tampered")]
        for key, path, subroot, leaf, tampered in zip(*cols):
            proof = hashlib.sha256("".join(a + b for a, b in siblings(path)).encode()).hexdigest()
            out.append((key, leaf.hex(), subroot.hex(), proof, folded(leaf if tampered is None else tampered, path)))
        yield _batch(out, _PROVED)


def audited(docs: DataFrame, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """Per row its order value, leaf, subroot, root and proof_sha256 (H of its siblings, level by level to the root, left
    to right), all of the rows as they are; folded_root, recomputed from the row with the `changed` fields and the original
    siblings; and verified, whether that is the root."""
    spark = docs.sparkSession
    as_is = {f: F.col(f) for f in fields}
    whole = digest_of(as_is)
    rows = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("place"), F.col(order).cast("string").alias("key"),
                       whole.alias("digest"), digest_of(as_is | changed).alias("other"))
    rows = rows.select("grp", "place", "key", "digest", F.when(F.col("other") != F.col("digest"), F.col("other")).alias("tampered"))
    leaves = stored(numbered(rows, ["place", "digest"]), "manifest-numbered")
    rounds = _rounds(leaves)
    subroots, links = built(leaves, rounds)

    tree = subroots.select(F.lit("all").alias("grp"), F.col("grp").alias("key"), "digest", F.lit(None).cast("binary").alias("tampered"))
    tree = stored(numbered(tree, ["key", "digest"]), "manifest-subroots")
    top_rounds = _rounds(tree)
    roots, top_links = built(tree, top_rounds)
    found = roots.select("level", "digest").collect()  # the one root, if any
    level, root = (found[0].level, bytes(found[0].digest)) if found else (0, b"")
    start = [("all", level, 0, 0, None, b"", root, None, None, None)] if found else []
    above = with_paths(tree, top_links, spark.createDataFrame(start, _DOWN), top_rounds)
    above = above.select(F.col("key").alias("_grp"), F.col("path").alias("_path"))
    joined = subroots.join(above, subroots["grp"].eqNullSafe(above["_grp"]))
    tops = joined.select(*_row(grp=F.col("grp"), level=F.col("level"), idx=F.col("idx"), start=F.col("start"), path=F.col("_path"), subroot=F.col("digest")))
    out = with_paths(leaves, links, tops, rounds, _proved, _PROVED)
    kind = docs.schema[order].dataType
    return out.select(F.col("key").cast(kind).alias(order), "leaf", "subroot", F.lit(root.hex()).alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == root.hex()).alias("verified"))
