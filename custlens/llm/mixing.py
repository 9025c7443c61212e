"""Mix sources to target weights by capped water-filling.

Every source has a weight and may be used ``cap`` times at most. The words to hand out rise like water over all
sources in proportion to their weights; a source that reaches its cap stops and the rest share what it leaves. The
final level has a closed form: with the sources sorted by cap / weight, it is the largest of
``(words - caps of the sources before) / (weights of this and the sources after)``.

A source's target is met with whole repetitions of all its documents and one fractional repetition: documents in the
order of a seeded hash, up to the word where the target is reached. Each document is taken as often as the others of
its source, give or take one; the words taken of a source are its target, rounded.

Defined cases: a null text has size 0; a null source is a source (the last one); rows that are equal in id and size
are interchangeable; sizes that are all 0 give targets of 0; an empty table gives an empty result. Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from custlens.llm.common import SPACED_WORD, column, documents, free_name
from custlens.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
# The hash order of a source is cut into so many buckets; only the bucket in which the target falls is sorted.
BUCKETS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, extra``.

    ``sizes`` has ``source, size``. ``whole`` repetitions of everything and ``extra`` words more meet the target.
    The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place - 1, F.lit(len(weights))))
    capped = totals.select("source", "source_size", weight.alias("weight")).withColumn(
        "cap", F.col("source_size") * F.lit(float(cap))
    )
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, W.unboundedFollowing)
    words = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = (words - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = capped.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        filled.withColumn("target", target)
        .withColumn("whole", whole)
        .withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "extra")
    )


def take(sized: DataFrame, key: str, seed: str = SEED, buckets: int = BUCKETS, **mix) -> DataFrame:
    """``key, source, size`` rows with ``source_size, target, taken``.

    ``sized`` should be a written table: it is read three times. Sums per bucket are combined before the shuffle;
    the plan has one row per source, so its join moves no document where that is small.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    bucket = F.pmod(F.conv(F.substring("order_", 1, 8), 16, 10).cast("long"), F.lit(buckets))
    placed = sized.withColumn("order_", order).withColumn("bucket_", bucket)
    plan = targets(placed, **mix)

    in_order = W.partitionBy("source").orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = placed.groupBy("source", "bucket_").agg(F.sum("size").alias("words_"))
    running = per_bucket.withColumn("before_", F.coalesce(F.sum("words_").over(in_order), F.lit(0)))
    # The last bucket that begins before the target is reached.
    reached = running.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    edge = (
        reached.where(F.col("before_") < F.col("extra"))
        .groupBy(F.col("b.source").alias("source"))
        .agg(F.max(F.struct("bucket_", "before_")).alias("edge_"))
    )
    plan = (
        plan.alias("p")
        .join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.source")), "left")
        .select("p.*", "edge_")
    )
    plan = materialize(plan, "mix-plan")  # of known size, so documents are not shuffled to meet it
    rows = (
        placed.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.*", "source_size", "target", "whole", "extra", "edge_")
    )
    edge_bucket = F.coalesce(F.col("edge_.bucket_"), F.lit(-1))
    base = F.col("whole") * F.col("size")
    clear = rows.where(F.col("bucket_") != edge_bucket).withColumn(
        "taken", base + F.when(F.col("bucket_") < edge_bucket, F.col("size")).otherwise(F.lit(0))
    )
    inside = W.partitionBy("source").orderBy("order_", key, "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("extra") - F.col("edge_.before_") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = rows.where(F.col("bucket_") == edge_bucket).withColumn(
        "taken", base + F.greatest(F.lit(0), F.least(F.col("size"), left))
    )
    return clear.unionByName(cut).drop("order_", "bucket_", "whole", "extra", "edge_")


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, size`` of every document, its size in words."""
    count = F.coalesce(F.regexp_count(column(docs, text), F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    return docs.select(column(docs, key).alias(key), column(docs, source).alias("source"), count.alias("size"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """One row per document: ``key, source, size, source_size, target, taken``."""
    return take(materialize(sizes(docs, key, text, source), "mix-sizes"), key, **options)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options):
    """The rows of the mix: each document as often as it is taken, with ``copy`` and the ``words`` of that copy.

    A copy that is taken in part keeps the first words of its text. The decisions are joined by a row number written
    with the rows, so rows that share an id stay apart.
    """
    row, copy, words = (free_name(docs, n) for n in ("row", "copy", "words"))
    written = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    sized = written.select(
        F.col(row).alias("row_"),
        column(written, key).alias("key_"),
        column(written, source).alias("source"),
        F.coalesce(F.regexp_count(column(written, text), F.lit(SPACED_WORD)), F.lit(0)).cast("long").alias("size"),
    )
    taken = take(materialize(sized, "mix-sizes"), "key_", **options).where("taken > 0").select("row_", "size", "taken")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    joined = written.join(taken, F.col(row) == F.col("row_")).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    kept = F.least(F.col("size"), F.col("taken") - (F.col(copy) - 1) * F.col("size"))
    joined = joined.withColumn(words, kept)
    pieces = F.regexp_extract_all(column(docs, text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.when(F.col(words) < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col(words).cast("int")), ""))
    others = [column(docs, c) if c != text else cut.otherwise(column(docs, text)).alias(text) for c in docs.columns]
    return joined.select(*others, copy, words)


def op8_mixing(spark, folder):
    rows = mix(documents(spark, folder))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '{SPACED_WORD}')), 0) AS BIGINT) AS size
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * CAST({CAP} AS DOUBLE) AS cap, CAST([5, 2, 1][1 + CAST(
    (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INTEGER)] AS DOUBLE) AS weight
  FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * CAST({SHARE} AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aims AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
  FROM aims)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(p.whole * s.size + greatest(0, least(s.size,
    CAST(round(p.target) AS BIGINT) - p.whole * p.source_size - coalesce(sum(s.size) OVER (
      PARTITION BY s.source ORDER BY (CAST('0x' || substr(h, 1, 8) AS BIGINT) % {BUCKETS}), h, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
"""
