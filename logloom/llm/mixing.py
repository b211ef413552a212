"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

A source that should take r times its words gives each of its documents floor(r) copies and a fractional copy
probability r - floor(r). Fractions are paired: mass moves from one side to the other, in a random direction that
keeps both expectations and the sum of words, until one of the two is integral.

Large documents come first, those of over a LARGE-th of their source's words (so at most LARGE of a source): from the largest
down, each is paired with all that are smaller, which have one probability and move together. So a large document is settled
and the smaller ones make up for it. If they have words for one direction only, that one is taken and not drawn, so that the
sum stays near; if for none, they are settled and it stays open. The rest are
dealt by hash into blocks of about BLOCK rows of one source; each block is folded pair by pair and leaves at most one
fractional document. Those residuals meet in blocks of the next level, so a reduction tree of depth log_BLOCK(rows) ends with
one fractional document per source, which is rounded at random. A source's taken words so differ from its target by less than
a LARGE-th of its words, or than a document that the smaller ones can't make up for. All random draws are hashes of ids and
levels, so reruns agree.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is an id like any
other. Repeated rows are rows of their own, with draws and copies of their own: they are counted first and dealt out again
with a number each, so a group of them of any size is spread over blocks as other rows are. Ties of draws are broken by
that number. Long texts count as a whole. Columns that are named like added ones are kept, see mixture(). An empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words_col, stored, text_hash

BLOCK = 64
#: Documents of a source that are large, at most.
LARGE = 1000
_TINY = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, n_rows, target.

    sizes has source and size. Sources by code point, null last, take the weights in turn and share the total size;
    none gets over `most` times its own size, and what is over goes to the others by weight until none is above. That
    is a water level, with sources in the order in which they fill: (total - caps of those before) / (weights of the
    rest) rises as long as the next source would be full and falls afterwards, so the level is its maximum. The windows
    run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size", "n_rows", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def _chance(*cols: Column) -> Column:
    """A draw from [0, 1) that the columns fix."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


_ROW = "struct<doc_id:bigint,h:bigint,more:bigint,size:bigint,base:int>"
#: Repeated rows that one row of the table of counts is dealt out to at once.
_MANY = 4096


def _numbered(sized: DataFrame) -> DataFrame:
    """The rows of sized, each with a number that tells it from its repetitions."""
    per = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("n"))
    parts = per.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _MANY).cast("int"))))
    first = F.col("part").cast("long") * _MANY
    return parts.withColumn("no", F.explode(F.sequence(first, F.least(F.col("n"), first + _MANY) - 1))).drop("n", "part")


def _folded(items: Column, level: int) -> Column:
    """items: array of struct(draw, row, size, p), 0 < p < 1, size > 0. Gives struct(carry, done): done has the rows
    that became integral with up 0 or 1, carry the one still fractional, if any."""

    def step(state: Column, x: Column) -> Column:
        def settled(moved: Column) -> Column:
            a, b = state["carry"], x
            sides = [(a, moved["pa"]), (b, moved["pb"])]
            is_done = [(p <= _TINY) | (p >= 1 - _TINY) for _, p in sides]
            done = F.filter(
                F.array(*[F.struct(r["row"].alias("row"), F.when(d, F.round(p)).cast("int").alias("up")) for (r, p), d in zip(sides, is_done)]),
                lambda y: y["up"].isNotNull(),
            )
            carry = F.when(~is_done[0], F.struct(a["draw"].alias("draw"), a["row"].alias("row"), a["size"].alias("size"), moved["pa"].alias("p"))).when(
                ~is_done[1], F.struct(b["draw"].alias("draw"), b["row"].alias("row"), b["size"].alias("size"), moved["pb"].alias("p"))
            )
            return F.struct(carry.alias("carry"), F.concat(state["done"], done).alias("done"))

        def moved(room: Column) -> Column:
            a, b = state["carry"], x
            up = _chance(a["draw"], b["draw"], F.lit(level)) * (room["up"] + room["down"]) < room["down"]  # a up by room.up with odds down
            shift = F.when(up, room["up"]).otherwise(-room["down"])
            return _let(F.struct((a["p"] + shift / a["size"]).alias("pa"), (b["p"] - shift / b["size"]).alias("pb")), settled)

        a, b = state["carry"], x
        room = F.struct(
            F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]).alias("up"),
            F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"]).alias("down"),
        )
        return F.when(a.isNull(), F.struct(x.alias("carry"), state["done"].alias("done"))).otherwise(_let(room, moved))

    zero = F.struct(F.lit(None).cast(_ITEM).alias("carry"), F.array().cast(f"array<struct<row:{_ROW},up:int>>").alias("done"))
    return F.aggregate(items, zero, step)


_ITEM = f"struct<draw:bigint,row:{_ROW},size:double,p:double>"


def _settled(items: Column, total: Column, p: Column) -> Column:
    """items: array of struct(order, x: struct(draw, row, size, p)), largest first; total: the words of their source; p: the
    probability of all its documents. Gives struct(p, rest, done, left): done has the rows that became integral with up
    0 or 1, left the one that stays open, if any, and p is now that of the documents that are not among items."""

    def step(state: Column, item: Column) -> Column:
        x = item["x"]

        def moved(room: Column) -> Column:
            drawn = _chance(x["draw"], F.lit("large")) * (room["up"] + room["down"]) < room["down"]  # x up by room.up with odds down
            full, none = room["up"] >= (1 - state["p"]) * x["size"] - _TINY, room["down"] >= state["p"] * x["size"] - _TINY
            up = F.when(full == none, drawn).otherwise(full)
            shift = F.when(room["up"] + room["down"] <= _TINY, F.lit(0.0)).when(up, room["up"]).otherwise(-room["down"])
            return _let(F.struct((state["p"] + shift / x["size"]).alias("own"), F.when(room["rest"] > 0, state["p"] - shift / room["rest"]).otherwise(state["p"]).alias("p"), room["rest"].alias("rest")), settled)

        def settled(m: Column) -> Column:
            done = (m["own"] <= _TINY) | (m["own"] >= 1 - _TINY)
            row = F.struct(x["row"].alias("row"), F.round(m["own"]).cast("int").alias("up"))
            open_ = F.struct(x["draw"].alias("draw"), x["row"].alias("row"), x["size"].alias("size"), m["own"].alias("p"))
            return F.struct(m["p"].alias("p"), m["rest"].alias("rest"), F.concat(state["done"], F.array_compact(F.array(F.when(done, row)))).alias("done"), F.concat(state["left"], F.array_compact(F.array(F.when(~done, open_)))).alias("left"))

        rest = F.greatest(state["rest"] - x["size"], F.lit(0.0))
        up, down = F.least((1 - state["p"]) * x["size"], state["p"] * rest), F.least(state["p"] * x["size"], (1 - state["p"]) * rest)
        return _let(F.struct(F.greatest(up, F.lit(0.0)).alias("up"), F.greatest(down, F.lit(0.0)).alias("down"), rest.alias("rest")), moved)

    zero = F.struct(p.alias("p"), total.alias("rest"), F.array().cast(f"array<struct<row:{_ROW},up:int>>").alias("done"), F.array().cast(f"array<{_ITEM}>").alias("left"))
    return F.aggregate(items, zero, step)


def _whole_row(docs: DataFrame) -> Column:
    """A hash of all columns of docs; what can't be hashed as it is (maps) goes in as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes])


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, block: int = BLOCK) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, h (xxhash64 of the text, null as empty), size, source,
    source_size, target, copies, taken; and more, a hash of all columns of the row.

    Blocks hold about `block` rows, whatever a source's share of the rows; nothing but one row per source is joined.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_hash().alias("h"), n_words_col(F.col("text")).alias("size"), _whole_row(docs).alias("more"))
    sized = stored(_numbered(sized), "mix-sizes")
    per = stored(targets(sized, weights, most), "mix-targets")
    largest = per.agg(F.max("n_rows")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    s = per.select(F.col("source").alias("s"), "source_size", "target", "n_rows", F.least(rate, F.lit(float(most))).alias("rate"))
    rows = sized.join(s, sized["source"].eqNullSafe(s["s"])).drop("s")
    rows = rows.withColumn("base", F.floor(F.col("rate") + _TINY).cast("int")).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    open_ = (F.col("size") > 0) & (F.col("p") > _TINY)
    kept = ["source", "source_size", "target"]
    own = ["doc_id", "h", "more", "size"]
    out = [rows.where(~open_).select(*own, *kept, F.col("base").alias("copies"))]
    draw = F.xxhash64("doc_id", "h", "more", "no", F.lit("mix"))
    item = F.struct(draw.alias("draw"), F.struct(*own, "base").alias("row"), F.col("size").cast("double").alias("size"), "p")
    items = rows.where(open_).select(*kept, "n_rows", item.alias("x"))
    big = F.col("x.size") * LARGE > F.col("source_size")
    first = F.array_sort(F.collect_list(F.when(big, F.struct(F.struct(-F.col("x.size"), F.col("x.draw")).alias("order"), "x"))))
    large = items.where(big).groupBy(*kept, "n_rows").agg(first.alias("xs"), F.first("x.p").alias("p"))
    large = stored(large.withColumn("f", _settled(F.col("xs"), F.col("source_size").cast("double"), F.col("p"))).drop("xs"), "mix-large")
    out.append(large.select(*kept, F.explode("f.done").alias("d")).select(*[f"d.row.{c}" for c in own], *kept, (F.col("d.row.base") + F.col("d.up")).alias("copies")))
    now = large.select(F.col("source").alias("s"), F.col("f.p").alias("now"))
    small = items.where(~big).join(now, items["source"].eqNullSafe(now["s"]), "left").drop("s")
    small = small.withColumn("now", F.coalesce("now", "x.p"))
    still = (F.col("now") > _TINY) & (F.col("now") < 1 - _TINY)
    out.append(small.where(~still).select(*[f"x.row.{c}" for c in own], *kept, (F.col("x.row.base") + F.round("now").cast("int")).alias("copies")))
    state = small.where(still).select(*kept, "n_rows", F.struct("x.draw", "x.row", "x.size", F.col("now").alias("p")).alias("x"))
    state = state.unionByName(large.select(*kept, "n_rows", F.explode("f.left").alias("x")))
    level, spread = 0, block
    while largest:
        blocks = F.ceil(F.col("n_rows") / spread)
        dealt = state.groupBy(*kept, "n_rows", F.pmod(F.xxhash64("x.draw", F.lit(level)), blocks).alias("b"))
        items = F.array_sort(F.collect_list("x"))
        done = stored(dealt.agg(_folded(items, level).alias("f")), f"mix-level{level}")
        out.append(done.select(*kept, F.explode("f.done").alias("d")).select(*[f"d.row.{c}" for c in own], *kept, (F.col("d.row.base") + F.col("d.up")).alias("copies")))
        state = done.where(F.col("f.carry").isNotNull()).select(*kept, "n_rows", F.col("f.carry").alias("x"))
        if spread >= largest:
            break
        level, spread = level + 1, spread * block
    last = F.when(_chance(F.col("x.draw"), F.lit("last")) < F.col("x.p"), 1).otherwise(0)
    out.append(state.select(*[f"x.row.{c}" for c in own], *kept, (F.col("x.row.base") + last).alias("copies")))
    done = reduce(DataFrame.unionByName, out)
    return done.select(*own, *kept, "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The rows of docs that the mix takes, each once, with size, source_size, target, copies and taken. Rows equal in all
    columns are one row here, with their sizes, copies and taken words added up; rows that differ in any column are rows
    of their own. Columns of docs are left as they are: an added one whose name docs has gets a leading underscore."""
    mixed = mix(docs, weights, most).groupBy("more").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("source_size", "target")], *[F.sum(c).cast("long").alias(c) for c in ("size", "copies", "taken")])
    mixed = stored(mixed.where("copies > 0"), "mix-taken")
    if not mixed.where("n > 1").isEmpty():
        docs = docs.dropDuplicates()
    m = mixed.select(*[F.col(c).alias(f"_m_{c}") for c in mixed.columns])
    added = ["size", "source_size", "target", "copies", "taken"]
    return docs.join(m, _whole_row(docs) == m["_m_more"]).select(*[docs[c] for c in docs.columns], *[m[f"_m_{c}"].alias(fresh(docs, c)) for c in added])
