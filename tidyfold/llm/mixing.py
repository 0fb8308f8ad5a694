"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected target / source size times. Its copies
are floor(u + p) - floor(u + p'), where p' and p are the prefix sums of expected
copies before and with the document and u is the source's one random offset: it
is emitted once per integer boundary that its step crosses. Documents stand by
size, then by a hash of the id, so every stretch of sizes gives its share and a
source's taken words come near its target.

The place of a document within its source is found without putting a source
into one task: rows are counted by (source, size, bucket of the id's hash),
where the number of buckets follows the number of rows; prefix sums run over
those counts, and only rows of one bucket meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyfold.llm.common import table, written

#: The contract's: weights by source in code-point order (repeating), the share of all words, and the most a source is repeated.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows that may share a bucket of ids on average.
BUCKET_ROWS = 50_000
SEED = 11


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none.

    A word begins where a character that isn't blank follows a blank or the
    beginning: count those by squeezing blanks to one.
    """
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D\\x20]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target): words a source should give.

    Sources by code point, null last, weigh `weights` in turn and share `share`
    of all words; no target exceeds `most` times its source's size and the
    excess is reshared by weight until none does. In one step: with sources by
    size / weight, the first k are held at their cap for the smallest k whose
    remaining level suits all others.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(most))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / F.sum("weight").over(after)
    held = level * F.col("weight") >= F.col("cap")  # once false, false for all later sources
    per = per.withColumn("level", level).withColumn("held", held)
    common = F.min(F.when(~F.col("held"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("held"), F.col("cap")).otherwise(F.least(F.col("cap"), common * F.col("weight")))
    return per.select("source", "source_size", "n", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of documents.

    Null text has size 0; null source is a source of its own; a null id hashes
    as empty text. Repeated rows are documents of their own. An empty table
    gives an empty result. Same rows and seed give the same result.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = written(docs.select(F.col("doc_id"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size")))
    targets = source_targets(sizes, weights, share, most)
    total = sizes.count()
    digits = 0
    while 16**digits * BUCKET_ROWS < total:
        digits += 1
    rows = sizes.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    counts = rows.groupBy("source", "size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    in_size = counts.withColumn("_in_size", F.sum("_n").over(W.partitionBy("source", "size").orderBy("_bucket")) - F.col("_n"))
    by_size = counts.groupBy("source", "size").agg(F.sum("_n").alias("_m"))
    by_size = by_size.withColumn("_below", F.sum("_m").over(W.partitionBy("source").orderBy("size")) - F.col("_m"))
    same = lambda *names: [F.expr(f"l.{n} <=> r.{n}") for n in names]
    starts = in_size.alias("l").join(by_size.alias("r"), same("source", "size")).select("l.source", "l.size", "l._bucket", (F.col("_in_size") + F.col("_below")).alias("_before"))
    starts = starts.alias("l").join(targets.alias("r"), same("source")).select("l.*", "r.source_size", "r.target")
    order = W.partitionBy("source", "size", "_bucket").orderBy("_key", "doc_id")
    placed = rows.withColumn("_i", F.row_number().over(order)).alias("l").join(starts.alias("r"), same("source", "size", "_bucket")).select("l.doc_id", "l.source", "l.size", "l._i", "r._before", "r.source_size", "r.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00null"))).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)

    def crossed(steps: Column) -> Column:
        """floor(u + rate * steps) without losing u beside a large product."""
        reach = F.col("_rate") * steps
        return F.floor(reach) + F.when(reach - F.floor(reach) + F.col("_u") >= 1, 1).otherwise(0)

    step = F.col("_before") + F.col("_i")
    copies = (crossed(step) - crossed(step - 1)).cast("long")
    return (
        placed.withColumn("_rate", rate)
        .withColumn("_u", offset)
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL_SIZES = "SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {docs}"


def sql_mix(docs: str) -> str:
    """DuckDB: every row of `docs` with size, source_size, target and copies, as `mixed`."""
    return f"""
sized AS ({SQL_SIZES.format(docs=docs)}),
per AS (SELECT source, sum(size)::DOUBLE AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w FROM sized GROUP BY source),
leveled AS (SELECT *, ({SHARE} * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
goal AS (SELECT source, s, CASE WHEN level * w >= 2 * s THEN 2 * s ELSE least(2 * s, w * (SELECT arg_min(level, 2 * s / w) FROM leveled WHERE level * w < 2 * s)) END AS target FROM leveled),
placed AS (SELECT z.doc_id, z.source, z.size, g.s::BIGINT AS source_size, g.target, CASE WHEN g.s > 0 THEN g.target / g.s ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY z.source ORDER BY z.size, md5(z.doc_id::VARCHAR), z.doc_id) AS i,
  ('0x' || substr(md5('{SEED}:' || z.source), 1, 12))::BIGINT::DOUBLE / {float(16**12)!r} AS u
  FROM sized z JOIN goal g ON z.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT doc_id, source, size, source_size, target, (floor(i * rate) + CASE WHEN i * rate - floor(i * rate) + u >= 1 THEN 1 ELSE 0 END - floor((i - 1) * rate) - CASE WHEN (i - 1) * rate - floor((i - 1) * rate) + u >= 1 THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed)"""


SQL = f"WITH {sql_mix('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
