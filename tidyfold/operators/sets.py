"""Feature sets: binding members to features, weights within a set, scores.

A set table has (set, position, member), one row per membership; a concept
table has (concept, set). Both are edge tables, never dense matrices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Join keys that the sets of one symbol are dealt to.
SPREAD = 16
#: Stored values whose products a task adds up.
VALUES_PER_TASK = 100_000


def explode_members(sets: DataFrame, name: str = "name", members: str = "members") -> DataFrame:
    """(set, position, member) from one row per set with an array of members."""
    return sets.select(F.col(name).alias("set"), F.posexplode(members).alias("position", "member"))


def bind_members(edges: DataFrame, genes: DataFrame, name: str = "gene_name", feature: str = "gene_index") -> DataFrame:
    """(set, member, feature) for every gene carrying a member's symbol; a symbol may hit several.

    Both sides are made distinct before they meet, so what they make is never
    shuffled. A symbol's sets are spread over SPREAD join keys.
    """
    salt = F.sequence(F.lit(0), F.lit(SPREAD - 1))
    held = edges.select("set", "member").distinct().withColumn("_salt", F.pmod(F.xxhash64("set"), F.lit(SPREAD)).cast("int"))
    named = genes.select(F.col(name).alias("member"), F.col(feature).alias("feature")).distinct().withColumn("_salt", F.explode(salt))
    parts = 4 * edges.sparkSession.sparkContext.defaultParallelism
    keys = ["member", "_salt"]
    return held.repartition(parts, *keys).join(named.repartition(parts, *keys), keys).select("set", "member", "feature")


def unmapped_members(edges: DataFrame, genes: DataFrame, name: str = "gene_name") -> DataFrame:
    """Distinct member symbols that no gene carries, sorted."""
    known = genes.select(F.col(name).alias("member"))
    return edges.select("member").distinct().join(known, "member", "left_anti").orderBy("member")


def member_positions(edges: DataFrame, genes: DataFrame, name: str = "gene_name", feature: str = "gene_index") -> DataFrame:
    """Every membership with its symbol's first gene position; -1 and `present` false if absent."""
    first = genes.groupBy(F.col(name).alias("member")).agg(F.min(feature).alias("_at"))
    met = edges.join(first, "member", "left")
    return met.withColumn("present", F.col("_at").isNotNull()).withColumn(
        "feature", F.coalesce(F.col("_at"), F.lit(-1)).cast("bigint")
    ).drop("_at")


def members_in_order(edges: DataFrame, set_order: DataFrame) -> DataFrame:
    """Distinct members by first appearance: set order, then place in the set."""
    placed = edges.join(set_order.select("set", "set_index"), "set")
    first = placed.groupBy("member").agg(F.min(F.struct("set_index", "position")).alias("_at"))
    return first.orderBy("_at").select("member", F.col("_at.set_index").alias("set_index"), F.col("_at.position").alias("position"))


def missing_members(edges: DataFrame, genes: DataFrame, set_order: DataFrame, name: str = "gene_name") -> DataFrame:
    """Members the genes lack, by first appearance."""
    ordered = members_in_order(edges, set_order)
    lacking = ordered.join(genes.select(F.col(name).alias("member")).distinct(), "member", "left_anti")
    return lacking.orderBy("set_index", "position")


def member_set(edges: DataFrame, set_order: DataFrame) -> DataFrame:
    """Every membership with its set's index."""
    return edges.join(set_order.select("set", "set_index"), "set").select("member", "position", "set_index")


def softmax_within(df: DataFrame, group: str, logit: Column, allowed: Column, out: str = "weight") -> DataFrame:
    """Softmax of `logit` over the allowed rows of a group; others, and empty groups, get 0.

    Two aggregates joined back, so a hot group is never windowed.
    """
    marked = df.withColumn("_logit", F.when(allowed, logit.cast("double")))
    tops = marked.groupBy(group).agg(F.max("_logit").alias("_top"))
    lifted = marked.join(tops, group, "left").withColumn("_exp", F.exp(F.col("_logit") - F.col("_top")))
    sums = lifted.groupBy(group).agg(F.sum("_exp").alias("_sum"))
    share = F.try_divide(F.col("_exp"), F.col("_sum"))
    return lifted.join(sums, group, "left").withColumn(out, F.coalesce(share, F.lit(0.0))).drop("_logit", "_top", "_exp", "_sum")


def set_weights(members: DataFrame, logit: Column | None = None) -> DataFrame:
    """Members with their weight in the set; equal logits give the mean over present members."""
    return softmax_within(members, "set", F.lit(0.0) if logit is None else logit, F.col("present"))


def concept_weights(concepts: DataFrame, logit: Column | None = None) -> DataFrame:
    """(concept, set) with the set's weight in the concept."""
    return softmax_within(concepts, "concept", F.lit(0.0) if logit is None else logit, F.lit(True))


def every_pair(samples: DataFrame, sample: str, stored: DataFrame, names: DataFrame, name: str, beside: DataFrame | None = None) -> DataFrame:
    """(sample, columns of `beside`, columns of `names`, `_stored`): each sample with every row of `names`, 0 where `stored` has no row.

    The rows of `names` are one array. A sample's stored rows are a list of
    places in it, and the other places are made where that list is, so only
    stored rows are shuffled, never the pairs.
    """
    fields = [F.col(c) for c in names.columns]
    listed = names.filter(F.col(name).isNotNull()).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_names")).scalar()
    placed = samples.sparkSession.range(1).select(F.posexplode(listed).alias("_at", "_name")).select("_at", F.col(f"_name.{name}").alias(name))
    own = stored.join(placed, name).groupBy(sample).agg(F.collect_list(F.struct("_at", "_stored")).alias("_list"))
    met = samples.select(sample).distinct().join(own, sample, "left")
    if beside is not None:
        met = met.join(beside, sample, "left")
    kept = [c for c in met.columns if c != "_list"]
    none = F.array().cast("array<int>")
    every = F.when(F.size(listed) > 0, F.sequence(F.lit(0), F.size(listed) - 1)).otherwise(none)
    met = met.withColumn("_ats", F.coalesce(F.col("_list")["_at"], none)).withColumn("_all", F.concat("_ats", F.array_except(every, "_ats")))
    cells = met.select(*kept, "_list", F.posexplode("_all").alias("_i", "_at"))
    value = F.coalesce(F.get(F.col("_list")["_stored"], F.col("_i")), F.lit(0.0))
    return cells.select(*kept, *[F.get(listed, F.col("_at"))[c].alias(c) for c in names.columns], value.alias("_stored"))


def sum_by_sample(values: DataFrame, edges: DataFrame, sample: str, name: str, feature: str, value: str, weight: str | None = None) -> DataFrame:
    """(sample, name, `_stored`): the values of a name's features, times `weight`, added up.

    A feature's edges are one list, met once by each of its values; the lists
    are opened where a sample's rows are, and a task takes about VALUES_PER_TASK
    values.
    """
    fields = F.struct(name, *([weight] if weight else []))
    lists = edges.groupBy(feature).agg(F.collect_list(fields).alias("_e"))
    met = values.join(lists, feature).select(sample, F.col(value).alias("_v"), F.col("_e")[name].alias("_names"), *([F.col("_e")[weight].alias("_w")] if weight else []))
    parts = max(values.sparkSession.sparkContext.defaultParallelism, -(-values.count() // VALUES_PER_TASK))
    opened = met.repartition(parts, sample).select("*", F.posexplode("_names").alias("_i", name))
    product = F.col("_v") * F.get("_w", F.col("_i")) if weight else F.col("_v")
    return opened.select(sample, name, product.alias("_x")).groupBy(sample, name).agg(F.sum("_x").alias("_stored"))


def score_sets(values: DataFrame, weighted: DataFrame, sample: str, bias: DataFrame | None = None,
               feature: str = "feature", value: str = "value", samples: DataFrame | None = None) -> DataFrame:
    """(sample, set, score) for every sample and set: weighted sum of the members' values, plus the set's bias.

    Values that aren't stored are 0. `samples` names all samples, those without
    any stored value too; without it, those of `values` count.
    """
    edges = weighted.filter(F.col("present")).select("set", feature, "weight")
    stored = sum_by_sample(values, edges, sample, "set", feature, value, "weight")
    names, score = weighted.select("set").distinct(), F.col("_stored")
    if bias is not None:
        names = names.join(bias.select("set", "bias"), "set", "left")
        score = score + F.coalesce("bias", F.lit(0.0))
    grid = every_pair(values if samples is None else samples, sample, stored, names, "set")
    return grid.select(sample, "set", score.alias("score"))


def score_concepts(values: DataFrame, members: DataFrame, concepts: DataFrame, sample: str, bias: DataFrame | None = None,
                   feature: str = "feature", value: str = "value", samples: DataFrame | None = None) -> DataFrame:
    """(sample, concept, score): weighted sum of the sets' scores, for every sample and concept.

    A concept is linear in the values, so it is scored by one weight per
    (feature, concept) and one constant; sample x set never arises.
    """
    met = members.filter(F.col("present")).select("set", feature, "weight").join(concepts.select("concept", "set", F.col("weight").alias("_share")), "set")
    edges = met.groupBy(feature, "concept").agg(F.sum(F.col("weight") * F.col("_share")).alias("_w"))
    stored = sum_by_sample(values, edges, sample, "concept", feature, value, "_w")
    names, score = concepts.select("concept").distinct(), F.col("_stored")
    if bias is not None:
        constant = concepts.join(bias.select("set", "bias"), "set").groupBy("concept").agg(F.sum(F.col("weight") * F.col("bias")).alias("_constant"))
        names = names.join(constant, "concept", "left")
        score = score + F.coalesce("_constant", F.lit(0.0))
    grid = every_pair(values if samples is None else samples, sample, stored, names, "concept")
    return grid.select(sample, "concept", score.alias("score"))


def relative_set_means(values: DataFrame, edges: DataFrame, sample: str, n_features: int, feature: str = "feature",
                       value: str = "value", samples: DataFrame | None = None) -> DataFrame:
    """(sample, set, score): mean over the set's members less the mean over all `n_features`; values that aren't stored are 0."""
    own = values.groupBy(sample).agg((F.sum(value) / F.lit(float(n_features))).alias("_own"))
    members = edges.select("set", feature).distinct()
    sizes = members.groupBy("set").agg(F.count("*").alias("_n"))
    stored = sum_by_sample(values, members, sample, "set", feature, value)
    grid = every_pair(values if samples is None else samples, sample, stored, sizes, "set", own)
    score = F.col("_stored") / F.col("_n") - F.coalesce("_own", F.lit(0.0))
    return grid.select(sample, "set", score.alias("score"))


def hold_out(edges: DataFrame, fraction: float, min_genes: int, seed: int = 0, hash_fn: str = "xxhash64") -> DataFrame:
    """Memberships with `held`: floor(fraction x size) of each set, drawn by hash; small sets dropped.

    The exact count comes from a rank in hash order within the set.
    """
    from tidyfold.functions.hashing import md5_hex
    from tidyfold.operators.ordering import hash_rank

    placed = hash_rank(edges.withColumn("_hex", md5_hex(seed, F.col("set"), F.col("feature"))), ["set"], "_hex", "feature")
    held = F.col("rank") < F.floor(F.lit(fraction) * F.col("size"))
    return placed.filter(F.col("size") >= min_genes).withColumn("held", held).drop("_hex", "rank", "size")
