"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mixture.  Its mean repetition rate is its
share of the wanted number of documents over the documents it has.  A document's
number of copies inverts a Poisson distribution of that mean at a uniform number
hashed from a seed and the document's id, so a rerun or a retried task gives the
same copies, and no document depends on another.  Copies are then dealt out by a
hash of seed, id and copy, and sorted by it: a global shuffle.

Only counts by source are gathered.  Documents meet their source's rate by a
broadcast where there are at most ``BROADCAST_SOURCES`` sources, and else by a join
in which Spark splits large sources.

Defined results: a null source is a source like any other; null texts are kept;
documents with equal ids (null: an id of its own) are drawn alike; a source with
target weight zero, or with no weight in a given table, goes; an empty table gives
an empty mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
#: Weights are the sources' sizes to this power, unless a table of weights is given.
TEMPERATURE = 0.5
BROADCAST_SOURCES = 100_000
#: A rate above this is drawn as a sum of Poisson numbers of at most this mean, which is Poisson again.
STEP = 16.0
_TERMS = 96


def hashed_unit(*parts: Column) -> Column:
    """A uniform double in (0, 1): 52 bits of an MD5 digest of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str, weights: DataFrame | None = None, total: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n_docs, rate) of every source.

    ``weights``: (source, weight), in any unit.  ``total``: wanted documents, by
    default as many as there are.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("__source")).agg(F.sum("weight").alias("weight"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").select("source", "n_docs", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))
    # One row: the sums over all sources.
    sums = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("n_docs").alias("all_docs"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_docs").cast("double")
    rate = F.when(F.col("all_weight") > 0, F.col("weight") * wanted / F.col("all_weight") / F.col("n_docs")).otherwise(F.lit(0.0))
    return weighted.crossJoin(F.broadcast(sums)).select("source", "n_docs", rate.alias("rate"))


def thresholds(rate: Column) -> Column:
    """Cumulative probabilities of a Poisson distribution, up to the last that a 52-bit number can exceed."""
    state = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))
    step = lambda acc, i: F.struct(
        (acc["p"] * rate / i).alias("p"),
        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * rate / i)).alias("cdf"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), state, step, lambda acc: acc["cdf"])


def replicated(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: DataFrame | None = None, total: float | None = None, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """Every document as often as drawn: (doc: all its columns, rate, n_copies, copy, shuffle_key), in random order."""
    by_source = rates(docs, source, weights, total, temperature)
    steps = F.greatest(F.ceil(F.col("rate") / F.lit(STEP)), F.lit(1)).cast("int")
    by_source = by_source.select(F.col("source").alias("__source"), "rate", steps.alias("__steps"), thresholds(F.col("rate") / steps).alias("__cdf"))
    if by_source.count() <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    key, own = F.col("doc").getField(doc_id), F.col("doc").getField(source)
    drawn = packed.join(by_source, own.eqNullSafe(F.col("__source")))

    def draw(i: Column) -> Column:
        u = hashed_unit(F.lit(seed), F.lit("n"), i, key)
        return F.size(F.filter("__cdf", lambda c: c <= u))

    # The first draw, which is the only one below STEP, stays out of the loop.
    more = F.aggregate(F.filter(F.sequence(F.lit(1), F.col("__steps")), lambda i: i > 1), F.lit(0), lambda acc, i: acc + draw(i))
    n = F.when(F.col("rate") > 0, draw(F.lit(1)) + more).otherwise(F.lit(0))
    copies = drawn.withColumn("n_copies", n).where("n_copies > 0").select("doc", "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    return copies.withColumn("shuffle_key", hashed_unit(F.lit(seed), F.lit("order"), F.col("copy"), key))


def shuffled(copies: DataFrame) -> DataFrame:
    """Range-sorted by the hashed key: the mixture's order."""
    return copies.repartitionByRange("shuffle_key", "copy").sortWithinPartitions("shuffle_key", "copy")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The shuffled mixture with the documents' own columns."""
    return shuffled(replicated(docs, **options)).select("doc.*")


def poisson_probability(rate: float, n: int) -> float:
    """The probability of ``n`` copies, for checks."""
    return math.exp(-rate + n * math.log(rate) - math.lgamma(n + 1)) if rate > 0 else float(n == 0)
