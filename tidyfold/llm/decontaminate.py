"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item of q shingles is contained in a document if at least 75 of 100 of its
distinct five-word shingles are there. Items are partitioned by size into powers
of two. An item's sketch is its k smallest shingle hashes with k = q -
ceil(0.75 q) + 1: a document that holds the item lacks at most k - 1 of its
shingles, so it holds one of the sketch's; the search has no false negatives.
Each partition knows the least number of shingles a document needs to hold one
of its items and the largest hash in its sketches. A document looks up only
shingles up to the largest hash of the partitions it is long enough for.
Candidates are verified by counting shared shingles as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import sent, table, written

PERCENT, WIDTH = 75, 5
BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Lower-cased runs of [^\\x20\\x09-\\x0D]; null has none."""
    trimmed = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x09-\\x0D\\x20]+"))


def shingles_of(words: str, one) -> Column:
    """All shingles of an array of words, each made by `one(columns of words)`; a shorter array is one shingle, an empty one has none."""
    w, n = F.col(words), F.size(words)
    short = reduce(lambda rest, k: F.when(n == k, F.array(one([w[j] for j in range(k)]))).otherwise(rest), range(1, WIDTH - 1), F.array(one([w[j] for j in range(WIDTH - 1)])))
    full = F.transform(F.sequence(F.lit(0), n - WIDTH), lambda i: one([w[i + j] for j in range(WIDTH)]))
    return F.when(n >= WIDTH, full).when(n > 0, short)


def hashed(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def spelled(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of each document row and item it contains.

    `docs` are (doc_id, text), `items` (item_id, text); other columns are left
    out. Null texts and texts without words contain and are contained in
    nothing. An item of fewer than five words is one shingle, which only a
    document of the same words has. Repeated rows each give their rows; null ids
    are ids of their own. Empty tables give empty results.
    """
    pieces = items.select("item_id", words_of(F.col("text")).alias("_w")).withColumn("_s", F.array_distinct(shingles_of("_w", spelled)))
    pieces = pieces.withColumn("_h", F.array_sort(F.array_distinct(shingles_of("_w", hashed)))).filter("_s is not null").withColumn("_q", F.size("_s"))
    pieces = written(pieces.select("item_id", F.md5(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.concat_ws(" ", "_w")).cast("binary")).alias("_key"), "_s", "_h", "_q").dropDuplicates(["_key"]))
    need = F.ceil(F.col("_q") * PERCENT / 100.0)
    sketch = pieces.withColumn("_k", (F.col("_q") - need + 1).cast("int")).withColumn("_part", F.floor(F.log2("_q")).cast("int"))
    entries = written(sketch.select("_key", "_part", need.alias("_need"), F.explode(F.slice("_h", F.lit(1), F.col("_k"))).alias("_hash")))
    parts = entries.groupBy("_part").agg(F.min("_need").alias("need"), F.max("_hash").alias("most")).collect()  # one row per power of two
    limit = reduce(lambda reach, p: F.greatest(reach, F.when(F.size("_w") - WIDTH + 1 >= min(int(p.need), 1 << 30), F.lit(int(p.most)))), parts, F.lit(None).cast("long"))
    # Texts of fewer than five words have one shingle.
    limit = F.when(F.size("_w") >= WIDTH, F.greatest(limit, F.lit(-(1 << 63)))).otherwise(F.lit((1 << 63) - 1)) if parts else F.lit(-(1 << 63))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    split = docs.select("doc_id", words_of(F.col("text")).alias("_w"))
    found = split.select("doc_id", limit.alias("_limit"), F.explode(shingles_of("_w", hashed)).alias("_hash")).filter("_hash <= _limit")
    candidates = written(found.join(sent(entries.select("_key", "_hash")), "_hash").select("doc_id", "_key").distinct())
    ids = candidates.select(F.col("doc_id").alias("_id")).distinct()
    some = docs.join(sent(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    some = some.select("doc_id", words_of(F.col("text")).alias("_w")).select("doc_id", shingles_of("_w", spelled).alias("_own"))
    pairs = some.join(sent(candidates.select(F.col("doc_id").alias("_id"), "_key")), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    pairs = pairs.join(sent(pieces.select("_key", "item_id", "_s", "_q")), "_key")
    shared = pairs.withColumn("n_shared", F.size(F.array_intersect("_s", "_own")).cast("long"))
    return shared.filter(F.col("n_shared") * 100 >= F.col("_q") * PERCENT).select("doc_id", "item_id", F.col("_q").cast("long").alias("n_item_shingles"), "n_shared", (F.col("n_shared") / F.col("_q")).alias("containment"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def sql_contained(docs: str) -> str:
    """DuckDB: the rows of contained(docs, benchmark), as `leaks`."""
    split = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+')"
    pieces = f"unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i+{WIDTH - 1}], ' ')) END)"
    return f"""
item_words AS (SELECT item_id, {split} AS w FROM benchmark),
item_pieces AS (SELECT DISTINCT item_id, {pieces} AS s FROM item_words),
item_sizes AS (SELECT item_id, count(*) AS q FROM item_pieces GROUP BY item_id),
leak_words AS (SELECT doc_id, {split} AS w FROM {docs}),
leak_pieces AS (SELECT DISTINCT doc_id, {pieces} AS s FROM leak_words),
leaks AS (SELECT doc_id, item_id, any_value(q)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / any_value(q) AS containment FROM leak_pieces JOIN item_pieces USING (s) JOIN item_sizes USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= {PERCENT} * any_value(q))"""


SQL = f"WITH {sql_contained('documents')} SELECT doc_id, item_id, n_item_shingles, n_shared, containment FROM leaks"
