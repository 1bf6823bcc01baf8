"""Mixing sources to target weights by Poisson replication: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, written

#: Up to so many sources their rates are broadcast; beyond, the join is a shuffled one with salted sources.
MOST_SOURCES = 10_000
SALTS = 64
#: A rate is split into Poisson parts of at most this mean, whose distribution function is told by so many terms (the rest is below 1e-30).
PART_MEAN, TERMS = 16.0, 80


def digest(*parts: Column) -> Column:
    """Hexadecimal MD5 of the parts as text, null as an empty one."""
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits, the same for the same parts on any machine."""
    return F.conv(F.substring(digest(*parts), 1, 13), 16, 10).cast("long").cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): the mean number of copies that brings each source to its share of epochs times the whole size.

    A document's size is its characters and one. weights has (source, weight), not negative, in any scale; without it all
    sources weigh the same. A source that weights doesn't name, or with null, has rate 0. A null source is one of its own.
    """
    sized = written(docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("size")), "sizes")
    if weights is None:
        weighed = sized.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("_source")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sized.join(w, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    target = F.lit(float(epochs) * (whole["size"] or 0))
    rate = F.coalesce(F.try_divide(F.col("weight") * target, F.col("size") * F.lit(float(whole["weight"] or 0))), F.lit(0.0))
    return weighed.select("source", rate.alias("rate"))


def inverted(rate: Column) -> Column:
    """(parts, cdf): cdf[k] is the chance of at most k copies from one of the equal parts that the rate is split into."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART_MEAN).cast("int"))
    mean = rate / parts
    first = F.exp(-mean)
    state = F.struct(first.alias("term"), first.alias("total"), F.array(first).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * mean / k
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"), F.concat(s["cdf"], F.array(s["total"] + term)).alias("cdf"))

    return F.struct(parts.alias("parts"), F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, step)["cdf"].alias("cdf"))


def copies(doc_id: Column, inverse: Column, seed: int) -> Column:
    """The document's Poisson count: each part inverts its distribution at the document's own hashed uniform number."""
    return F.aggregate(F.sequence(F.lit(1), inverse["parts"]), F.lit(0), lambda n, part: n + F.size(F.filter(inverse["cdf"], lambda c: c <= uniform(doc_id, part, F.lit(seed)))))


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Every row of docs as often as its Poisson count says, with `copy` (from 1) and `shuffle_key`, in globally shuffled order.

    The count depends on doc_id, rate and seed alone; rows of one doc_id share it. Empty and null texts, null ids and null
    sources take part like others; no rows give no rows. Columns `copy` and `shuffle_key` of docs are replaced; other names are free.
    """
    # All columns as one, so that no name of theirs meets one of these.
    rows = docs.select(F.struct(*quoted(docs.drop("copy", "shuffle_key"))).alias("doc"))
    source = F.col("doc.source")
    table = rates(docs, weights, epochs)
    few = table.limit(MOST_SOURCES + 1).collect()
    if len(few) <= MOST_SOURCES:
        small = docs.sparkSession.createDataFrame([(r["source"], r["rate"]) for r in few], "named string, rate double").select("named", inverted(F.col("rate")).alias("inverse"))
        joined = rows.join(F.broadcast(small), source.eqNullSafe(F.col("named"))).select("doc", "inverse")
    else:
        large = table.select(F.col("source").alias("named"), inverted(F.col("rate")).alias("inverse"))
        large = large.select("named", "inverse", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = rows.join(large, source.eqNullSafe(F.col("named")) & (F.pmod(F.xxhash64("doc.doc_id"), F.lit(SALTS)).cast("int") == F.col("salt"))).select("doc", "inverse")
    counted = joined.select("doc", copies(F.col("doc.doc_id"), F.col("inverse"), seed).alias("n")).where("n > 0")
    out = counted.select("doc.*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = F.conv(F.substring(digest(F.col("doc_id"), F.col("copy"), F.lit("order"), F.lit(seed)), 1, 13), 16, 10).cast("long")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumn("shuffle_key", key).repartition(width, "shuffle_key").sortWithinPartitions("shuffle_key")
