"""Mix sources to target weights by capped water-filling, in DataFrame operations only.

A source's share of the mix is ``level * weight``, clamped at ``max_epochs`` times its size. Clamping
frees words, which the sources below their clamps take in proportion to their weights; repeating this
until no source is above its clamp ends at one water level. That level is found directly: with sources
ordered by the level at which each would be clamped, it is the first one that leaves the next source
below its clamp.

A source then repeats all its documents ``floor(target / size)`` times, and a seeded order of its
documents decides which are taken once more, until the target is met. The order is by a hash, so reruns
agree. It is cut in two steps, so that a source of any size never meets in one task: sums over 4,096
ranges of the hash say in which range the cut falls, and only that range is put in order.

Defined results: null or empty text has size 0 and is kept with ``taken`` 0; a null source is a source
of its own, after all others; equal rows are separate rows; very long texts are counted whole; other
columns, whatever their names, take no part and come through ``repeat`` unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, fresh


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, one row a source -> the same with ``weight`` and ``target`` in words.

    Sources by code point, null last, weigh ``weights``, repeated. The windows run over one row a
    source, never over documents.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.orderBy("clamp_level", "place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("clamp_level", "place").rowsBetween(W.unboundedPreceding, -1)
    placed = sizes.withColumn("place", F.row_number().over(by_name))
    weighed = placed.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    clamped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("clamp_level", F.col("cap") / F.col("weight"))
    # The level if exactly the sources before this one are clamped; right where it leaves this one below its clamp.
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = clamped.withColumn("own_level", left / free)
    level = F.min(F.when(F.col("own_level") <= F.col("clamp_level"), F.struct("clamp_level", "place", "own_level"))).over(everything)["own_level"]
    target = F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))
    return levelled.withColumn("target", target).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, partial: bool = True, tag: Column | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, ``copies`` (whole), ``taken`` (words), ``tag``.

    With ``partial`` the document on which a source's cut falls gives just the words that are missing;
    otherwise it is taken if more than half of it is.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    measured = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), (F.lit(0) if tag is None else tag).alias("tag")).withColumn("key", key).withColumn("range", F.substring("key", 1, 3)))
    ranges = measured.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights=weights, share=share, max_epochs=max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("extra", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(upto), F.lit(0)))
    t, r = targets.alias("t"), ranges.alias("r")
    planned = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "r.range", "start", "range_size", "source_size", "target", "whole", "extra")
    m, p = measured.alias("m"), planned.alias("p")
    rows = m.join(p, F.col("m.source").eqNullSafe(F.col("p.source")) & (F.col("m.range") == F.col("p.range"))).select("doc_id", "m.source", "size", "tag", "key", "m.range", "start", "range_size", "source_size", "target", "whole", "extra")
    crossed = (F.col("start") < F.col("extra")) & (F.col("start") + F.col("range_size") > F.col("extra"))
    inside = W.partitionBy("source", "range").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    cutting = rows.where(crossed).withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    plain = rows.where(~crossed).withColumn("more", F.when(F.col("start") + F.col("range_size") <= F.col("extra"), F.col("size")).otherwise(F.lit(0)))
    missing = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("start")))
    cutting = cutting.withColumn("more", missing if partial else F.when(missing * 2 > F.col("size"), F.col("size")).otherwise(F.lit(0)))
    out = plain.unionByName(cutting)
    copies = F.col("whole") + F.when((F.col("more") > 0) & (F.col("more") == F.col("size")), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"), "tag")


def repeat(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, with its own columns.

    Whole documents only. Documents without a word belong to no share and leave with those not taken. Rows of equal id,
    source and text share out what the mix takes of them, one row each, in an order by all their columns.
    """
    def same(id_: Column, source: Column, tag: Column) -> Column:
        return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("-")), F.hex(tag), F.coalesce(F.concat(F.lit("="), source), F.lit("")))

    key, nth, each = (fresh(x, docs.columns) for x in ("__key", "__nth", "__each"))
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, partial=False, tag=F.xxhash64(text_col), **options)
    taken = taken.where("copies > 0").groupBy(same(F.col("doc_id"), F.col("source"), F.col("tag")).alias(key)).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(each))
    own = docs.withColumn(key, same(F.col(id_col), F.col(source_col), F.xxhash64(text_col)))
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])
    own = own.withColumn(nth, F.row_number().over(W.partitionBy(key).orderBy(order)))
    copies = F.coalesce(F.try_element_at(F.col(each), F.col(nth)), F.lit(0)).cast("int")
    kept = own.join(taken, key).where(copies > 0).withColumn(each, F.explode(F.sequence(F.lit(1), copies)))
    return kept.select(*[f"`{c}`" for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('17:' || doc_id) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
c AS (SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM w),
l AS (SELECT *, cap / weight AS clamp_level FROM c),
o AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY clamp_level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY clamp_level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS own_level FROM l),
v AS (SELECT own_level AS level FROM o WHERE own_level <= clamp_level ORDER BY clamp_level, place LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM v) * weight), cap) AS target FROM o),
x AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
y AS (SELECT d.doc_id, d.source, d.size, x.source_size, x.target, x.whole,
             floor(x.target - x.whole * x.source_size + 0.5)::BIGINT
             - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS missing
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, missing)))::BIGINT AS taken FROM y
"""


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the mix of all documents."""
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
