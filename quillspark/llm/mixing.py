"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A document's size is its number of words. Source i of weight w gets the target min(3 * its size, level * w);
the level makes the targets add up to all sizes. A source whose rate (target over size) is r takes each
document floor(r) times for certain; the rest of its target, in words, is drawn without replacement by order
sampling. There a document's inclusion probability is

    p = f * (1 + tilt * (1 - size / m)),  f = rest / source_size,  m = sum(size^2) / sum(size)

so longer documents have smaller odds while the expected words stay the rest, whatever the tilt; the tilt is half
of the largest that keeps all p between 0 and 1. Documents rank by u / (1 - u) over p / (1 - p), and the first ones
that fit into the rest are taken. The words that are left to the rest go to the next documents of that order which
still fit, the first of each size class (powers of two), long classes first; if the document that did not fit brings
the words nearer to the target, it is taken instead.

u comes from a hash of doc_id and a seed, so reruns agree. The cut is found without sorting a source: histograms of
4096 buckets narrow the order down to few rows. Rows alike in all columns are told apart by the place at which they
were written, and only there, so ties split.

Null or blank texts have size 0 and are taken 0 words. Null sources are one source, the last. Null doc_ids share
one u. Ties in rank go by doc_id, text hash and hash of all columns. A source without words has target 0. An empty
table gives an empty one. Extra columns of any name are passed on by mix(), but for those that it adds itself, which
it replaces; take_copies() returns all columns as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import field, hashable, quoted, stage, word_count

WEIGHTS, CAP, SEED = (1, 2, 3), 3, "mix-1"
BUCKETS = 4096
ADDED = ("size", "source_size", "target", "copies", "taken")
_KEY = ("odds", "doc_id", "text_hash", "row_hash")
_RANK = (*_KEY, "row")


def _uniform(seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _placed(docs: DataFrame, seed: str, carried: list[str]) -> DataFrame:
    """Written rows: source, doc_id, text_hash, row_hash, row (a number of its own), size, u, and doc: the columns carried."""
    # names of the table's own are gone before the rows get their numbers
    rows = docs.select(
        F.col("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64(*hashable(docs)).alias("row_hash"),
        F.monotonically_increasing_id().alias("row"),
        word_count("text").alias("size"),
        _uniform(seed).alias("u"),
        F.struct(*map(quoted, carried)).alias("doc"),
    )
    return stage(rows, "sized")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target, whole (certain copies), rest (words to draw), and what p needs: mean, tilt. One row for each source."""
    size = F.col("size").cast("double")
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(size * size).alias("squares"), F.max("size").alias("longest"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    told = ranked.withColumn("weight", weight).withColumn("most", (cap * F.col("source_size")).cast("double"))
    # in the order in which sources reach their cap: the level if all before are capped and no other is
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    told = told.withColumn("level", level).withColumn("open", F.col("most") / F.col("weight") >= F.col("level"))
    told = told.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("most") / F.col("weight"), "rank", F.col("level").alias("at")))).over(everything)["at"])
    target = F.least("most", F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    told = told.withColumn("target", target).withColumn("whole", F.floor(rate).cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    told = told.withColumn("share", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
    told = told.withColumn("mean", F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(1.0))
    room = F.when(F.col("longest") > F.col("mean"), F.col("mean") / (F.col("longest") - F.col("mean"))).otherwise(1.0)
    other = F.when(F.col("share") > 0, (1.0 - F.col("share")) / F.col("share")).otherwise(1.0)
    tilt = 0.5 * F.least(F.lit(1.0), room, other)
    return told.withColumn("tilt", tilt).select("source", "source_size", "target", "whole", "rest", "share", "mean", "tilt")


def _of(source: str) -> Column:
    return F.col("source").eqNullSafe(F.col(source))


def _first_past(rows: DataFrame, bucket: Column, goals: DataFrame) -> DataFrame:
    """of, goal, before, bucket: for each source of goals (of, goal, before) the first bucket with which its words exceed the goal."""
    sums = rows.join(goals, _of("of")).groupBy("of", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.first("goal").alias("goal"), F.first("before").alias("before"))
    upto = sums.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("of").orderBy("bucket")))
    past = upto.where("upto > goal").groupBy("of").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "goal")).alias("x"))
    return stage(past.select("of", "x.goal", "x.before", "x.bucket"), "bucket")


def _in_bucket(rows: DataFrame, bucket: Column, at: DataFrame) -> DataFrame:
    at = at.select(F.col("of").alias("_of"), F.col("bucket").alias("_bucket"))
    return rows.join(at, _of("_of") & (bucket == F.col("_bucket"))).drop("_of", "_bucket")


def _cut(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """of, last, room: the first document in rank order that does not fit into the source's goal, and the words left before it."""
    # odds over 1 + odds rises with the odds and lies between 0 and 1
    scaled = BUCKETS * (1.0 - 1.0 / (1.0 + F.col("odds")))
    at = goals.select(F.col("source").alias("of"), F.col("rest").alias("goal"), F.lit(0).cast("long").alias("before"))
    for bucket in (F.floor(scaled), F.floor((scaled - F.floor(scaled)) * BUCKETS), F.struct(*_KEY), F.shiftright("row", 33)):
        at = _first_past(rows, bucket, at)
        rows = _in_bucket(rows, bucket, at)
    few = rows.join(at.drop("bucket"), _of("of"))
    upto = few.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("of").orderBy(*_RANK)))
    over = upto.where("upto > goal").groupBy("of").agg(F.min(F.struct(F.struct(*_RANK).alias("rank"), "size", (F.col("goal") - F.col("upto") + F.col("size")).alias("room"))).alias("x"))
    return stage(over.select("of", F.col("x.rank").alias("last"), F.col("x.size").alias("last_size"), "x.room"), "cut")


def _fitting(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """of, more: numbers of the rows beyond the cut that fill the room."""
    rank = F.struct(*_RANK)
    beyond = rows.join(cut, _of("of")).where((rank > F.col("last")) & (F.col("size") <= F.col("room")))
    first = beyond.groupBy("of", F.length(F.bin("size")).alias("class")).agg(F.min(F.struct(rank.alias("rank"), "size")).alias("x"))
    by_class = first.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("class", F.col("x.size").alias("size"), F.col("x.rank.row").alias("row"))), asc=False).alias("next"))
    told = cut.join(by_class.withColumnRenamed("of", "_of"), F.col("of").eqNullSafe(F.col("_of")), "left")
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("more"))
    step = lambda s, x: F.when(x["size"] <= s["room"], F.struct((s["room"] - x["size"]).alias("room"), F.array_append(s["more"], x["row"]).alias("more"))).otherwise(s)
    filled = F.aggregate(F.coalesce("next", F.array().cast("array<struct<class:int,size:bigint,row:bigint>>")), start, step)
    nearer = F.col("last_size") - F.col("room") < filled["room"]
    return told.select("of", "last", F.when(nearer, F.array(F.col("last.row"))).otherwise(filled["more"]).alias("more"))


def _decided(rows: DataFrame) -> DataFrame:
    """The rows with source_size, target, copies."""
    goals = stage(targets(rows), "targets")
    of = goals.select(F.col("source").alias("_source"), "rest", "share", "mean", "tilt")
    p = F.col("share") * (1.0 + F.col("tilt") * (1.0 - F.col("size") / F.col("mean")))
    odds = (F.col("u") / (1.0 - F.col("u"))) / (p / (1.0 - p))
    # without a rest nothing is drawn
    told = rows.join(of, _of("_source"), "left").withColumn("odds", F.when((F.col("rest") > 0) & (F.col("size") > 0), odds)).drop(*of.columns)
    open_ = told.where("odds is not null").select("source", "size", *_RANK)
    cut = _cut(open_, goals.where("rest > 0"))
    last = stage(_fitting(open_, cut), "mix")
    plan = goals.join(last.withColumnRenamed("of", "_of"), _of("_of"), "left").select(F.col("source").alias("_source"), "source_size", "target", "whole", "last", "more")
    joined = told.join(plan, _of("_source"), "left")
    drawn = F.col("odds").isNotNull() & (F.col("last").isNull() | (F.struct(*_RANK) < F.col("last")) | F.array_contains("more", F.col("row")))
    copies = F.when(F.col("size") > 0, F.col("whole") + drawn.cast("long")).otherwise(F.lit(0))
    return joined.withColumn("copies", copies)


def mix(docs: DataFrame, seed: str = SEED, columns: list[str] | None = None) -> DataFrame:
    """docs (or these columns of it) with size, source_size, target, copies (times the mix takes the document) and taken (words)."""
    carried = [c for c in columns or docs.columns if c.lower() not in ADDED]
    values = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("copies") * F.col("size")}
    return _decided(_placed(docs, seed, carried)).select(*[field("doc", c) for c in carried], *[values[c].alias(c) for c in ADDED])


def take_copies(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: a row for each copy."""
    taken = _decided(_placed(docs, seed, docs.columns)).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[field("doc", c) for c in docs.columns])
