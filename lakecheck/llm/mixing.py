"""Mixing sources to target weights: Poisson replication, DataFrame functions only.

A source whose share is to be w has the mean rate w * total / size: how often each of its
documents is repeated on average. A document's count is drawn from the Poisson distribution
with that mean, by inverting it at a number in (0, 1) hashed from the seed and the document's
identifier, so that every run and every partitioning draws the same. Means above
``PART_MEAN`` are drawn as sums of several such numbers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.registry import ORACLES, query, table
from lakecheck.session import fits_broadcast, materialize

SEED = 20
#: A draw has this mean at most; no draw of that mean exceeds MOST_PER_DRAW (chance below 1e-40).
PART_MEAN, MOST_PER_DRAW = 16.0, 96


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``_source, rate``: mean repetitions for each source, null being one of them.

    A document's size is its text's bytes and one more. Without ``weights`` all sources get
    the same share; with them a source that they don't name gets none. ``total`` is the size
    of the mixture, that of ``docs`` if not given.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1
    sizes = materialize(docs.select(F.col(source_col).alias("_source"), size.alias("size")).groupBy("_source").agg(F.sum("size").alias("size")), "sizes")
    weight = F.lit(1.0)
    if weights is not None:
        given = sizes.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "_named string, weight double")
        sizes = sizes.join(F.broadcast(given), F.col("_source").eqNullSafe(F.col("_named")), "left").select("_source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
        weight = F.col("weight")
    all_sizes, all_weights = sizes.agg(F.sum("size"), F.sum(weight)).first()
    if not all_weights:
        return sizes.select("_source", F.lit(0.0).alias("rate"))
    share = F.lit(float(total if total is not None else all_sizes)) * weight / F.lit(float(all_weights))
    return sizes.select("_source", (share / F.col("size")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Chances of k or fewer for k = 0 to MOST_PER_DRAW - 1."""
    first = F.exp(-mean)
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_PER_DRAW - 1)),
        F.struct(first.alias("p"), F.array(first).alias("upto")),
        lambda at, k: F.struct(
            (at["p"] * mean / k).alias("p"),
            F.concat(at["upto"], F.array(F.element_at(at["upto"], -1) + at["p"] * mean / k)).alias("upto"),
        ),
    )
    return grown["upto"]


def mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, total: float | None = None, seed: int = SEED,
    source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = "copy",
) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, in a random order; ``copy_col`` counts from 1.

    Rows with the same identifier are drawn alike, rows without one too. A null text has size
    one, a null source is a source. No rows in: no rows out. Names of columns are free: while ``docs``
    has one of the name ``copy_col``, in any case, that name gets a ``_`` at its end.
    """
    while copy_col and copy_col.lower() in {c.lower() for c in docs.columns}:
        copy_col += "_"
    per_source = rates(docs, weights, total, source_col, text_col)
    draws = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    per_source = materialize(per_source.select("_source", draws.alias("_draws"), _distribution(F.col("rate") / draws).alias("_upto")), "rates")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{source_col}`").alias("_source"))
    side = F.broadcast(per_source) if fits_broadcast(per_source) else per_source
    known = named.join(side, named["_source"].eqNullSafe(per_source["_source"])).select("_doc", "_draws", "_upto")
    name = F.coalesce(F.col(f"_doc.`{id_col}`").cast("string"), F.lit("null"))

    def drawn(number: Column) -> Column:
        digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), name, number.cast("string")), 256), 1, 13)
        at = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.size(F.filter("_upto", lambda upto: upto < at))

    counted = known.withColumn("_n", F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), lambda n, i: n + drawn(i)))
    copies = counted.where("_n > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    keyed = copies.withColumn("_key", F.xxhash64(F.lit(seed), name, F.col(f"_doc.`{text_col}`"), "_copy"))
    out = keyed.repartition("_key").sortWithinPartitions("_key")
    return out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns], *([F.col("_copy").alias(copy_col)] if copy_col else []))


@query
def op3_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


ORACLES["op3_mixing"] = f"""
WITH RECURSIVE sizes AS (
    SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents GROUP BY source),
rates AS (
    SELECT source, (SELECT sum(size)::DOUBLE FROM sizes) * 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM sizes) / size AS rate FROM sizes),
parts AS (
    SELECT source, greatest(ceil(rate / {PART_MEAN}::DOUBLE), 1)::INT AS draws, rate / greatest(ceil(rate / {PART_MEAN}::DOUBLE), 1)::INT AS mean FROM rates),
chances AS (
    SELECT source, 0 AS k, mean, exp(-mean) AS p, exp(-mean) AS upto FROM parts
    UNION ALL
    SELECT source, k + 1, mean, p * mean / (k + 1), upto + p * mean / (k + 1) FROM chances WHERE k < {MOST_PER_DRAW - 1}),
draws AS (
    SELECT doc_id, source, (('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u
    FROM (SELECT DISTINCT doc_id, source FROM documents) JOIN parts USING (source), LATERAL (SELECT unnest(range(1, draws + 1)) AS i)),
counts AS (
    SELECT doc_id, source, count(*) AS n FROM draws JOIN chances USING (source) WHERE upto < u GROUP BY doc_id, source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy
FROM documents JOIN counts USING (doc_id, source)
"""
