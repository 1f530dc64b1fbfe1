"""Batches, sampled candidates, nearest-neighbour labels and the ranking loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sparse import cosine

M32, M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF
#: Of the walk, the factor of an anchor's number, the state that stands for 0, and the shifts of a step.
ANCHOR_FACTOR, STATE_FOR_ZERO, SHIFTS = 40503, 0x6D2B79F5, (13, 17, 5)
#: Fixed value: the factor of a batch's number in a seed.
SEED_FACTOR = 0x9E3779B97F4A7C15
#: Of a number with so many distinct prime factors, so many steps at most lead to the next number prime to it.
STEPS = (0, 1, 3, 5, 9, 13, 21, 25, 33, 39, 45)


def planned_batches(rows: DataFrame, position: str, batch_rows: int) -> DataFrame:
    """Adds batch_id and row (0 on): fixed ranges of source positions, so a batch needs no count of what comes before it."""
    if batch_rows < 1:
        raise ValueError("batch_rows must be positive")
    batched = rows.withColumn("batch_id", F.floor(F.col(position) / batch_rows).cast("long"))
    own = Window.partitionBy("batch_id").orderBy(position)
    return batched.withColumn("row", (F.row_number().over(own) - 1).cast("int"))


def source_rows_per_batch(batch: int, permille: int) -> int:
    """Source rows of a plan whose split holds so many of a thousand."""
    if not 0 < permille <= 1000:
        raise ValueError("the split is empty")
    return max(1, -(-batch * 1000 // permille))


def split_batches(rows: DataFrame, shard: str, position: str, split: str, batch: int, validation_permille: int, limit: int | None = None) -> DataFrame:
    """The rows of a split with batch_id and row, planned as ranges of a shard's positions.

    rows: a shard's number, a row's position in it (0 on), and split.  A plan has as many source
    rows as hold a batch of the split on average; its batch has those that are of the split, and no
    batch spans shards.  ``limit`` counts plans, those that turn out empty included.
    """
    permille = validation_permille if split == "validation" else 1000 - validation_permille
    per_plan = source_rows_per_batch(batch, permille)
    plans = rows.groupBy(shard).agg((F.floor(F.max(position) / per_plan) + 1).alias("__plans"))
    # One row a shard.
    before = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    offsets = plans.select(shard, F.coalesce(F.sum("__plans").over(before), F.lit(0)).alias("__before"))
    planned = rows.where(F.col("split") == split).join(F.broadcast(offsets), shard).withColumn("batch_id", (F.col("__before") + F.floor(F.col(position) / per_plan)).cast("long")).drop("__before")
    if limit is not None:
        planned = planned.where(F.col("batch_id") < limit)
    own = Window.partitionBy("batch_id").orderBy(position)
    return planned.withColumn("row", (F.row_number().over(own) - 1).cast("int"))


def sequential_batches(rows: DataFrame, order: list[str], batch: int, part: Column, limit: int | None = None) -> DataFrame:
    """Adds batch_id over consecutive rows: numbers within parts (``part`` ascends with the order), plus the rows of the parts before.

    Those are summed in two levels, within at most a thousand ranges of parts and over the ranges, so
    that no task sees a row of each part.
    """
    own = Window.partitionBy("__part").orderBy(*order)
    numbered = rows.withColumn("__part", part).withColumn("__rn", F.row_number().over(own) - 1)
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    ends = counts.agg(F.min("__part").alias("__low"), F.max("__part").alias("__high"))
    ranged = counts.crossJoin(F.broadcast(ends)).select("__part", "__n", F.floor((F.col("__part") - F.col("__low")) * 1000 / (F.col("__high") - F.col("__low") + 1)).alias("__range"))
    so_far = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = ranged.select("__part", "__range", so_far(Window.partitionBy("__range").orderBy("__part")).alias("__in"))
    over = ranged.groupBy("__range").agg(F.sum("__n").alias("__n")).select("__range", so_far(Window.orderBy("__range")).alias("__over"))
    offsets = within.join(F.broadcast(over), "__range").select("__part", (F.col("__in") + F.col("__over")).alias("__before"))
    out = numbered.join(offsets, "__part").withColumn("batch_id", F.floor((F.col("__rn") + F.col("__before")) / batch).cast("long")).drop("__part", "__rn", "__before")
    return out if limit is None else out.where(F.col("batch_id") < limit)


def ranking_seed(epoch: int, batch: int) -> int:
    """A seed for the candidates of an epoch's batch."""
    return (epoch << 32 ^ batch * SEED_FACTOR) & M64


def candidate_count(k: int, batch: Column) -> Column:
    return F.least(F.lit(max(k, 2)), batch - 1)


def _xorshift(s: Column) -> Column:
    left, right, last = SHIFTS
    s = s.bitwiseXOR(F.shiftleft(s, left).bitwiseAND(F.lit(M32)))
    s = s.bitwiseXOR(F.shiftright(s, right))
    return s.bitwiseXOR(F.shiftleft(s, last).bitwiseAND(F.lit(M32)))


def prime_factors(rows: DataFrame, most: int) -> DataFrame:
    """p and its distinct prime factors, for p from 1 to ``most``, the rows of the largest batch."""
    factors: list[list[int]] = [[] for _ in range(most + 1)]
    for q in range(2, most + 1):
        if not factors[q]:
            for p in range(q, most + 1, q):
                factors[p].append(q)
    return rows.sparkSession.createDataFrame([(p, factors[p]) for p in range(1, most + 1)], "p int, primes array<int>")


def with_candidates(batched: DataFrame, seed: int, k: int, most_rows: int) -> DataFrame:
    """Adds candidates: for each row of a batch, k other rows of it without repeats, from a seeded walk with a stride prime to their number.

    Batches under three rows get none.
    """
    size = Window.partitionBy("batch_id")
    rows = batched.withColumn("n", F.count("*").over(size).cast("int")).withColumn("p", F.col("n") - 1)
    # In column steps: written as one expression, each step would repeat the one before it twice.
    state = F.lit(seed & M32).cast("long").bitwiseXOR((F.col("row") + 1).cast("long") * ANCHOR_FACTOR % (1 << 32))
    rows = rows.withColumn("s0", F.when(state == 0, F.lit(STATE_FOR_ZERO)).otherwise(state)).withColumn("s", F.array("s0"))
    for _ in range(2):
        x = F.col("s")
        rows = rows.withColumn("s", F.concat("s", F.transform(F.slice(x, -1, 1), _xorshift)))
    rows = rows.join(F.broadcast(prime_factors(batched, most_rows)), "p", "left")
    p = F.col("p")
    # The first number from the drawn one on, from 1 to p and round again, that shares no prime with p.
    strides = F.transform(F.sequence(F.lit(0), F.get(F.array(*map(F.lit, STEPS)), F.size("primes"))), lambda j: ((F.get("s", F.lit(2)) + j) % p + 1).cast("int"))
    stride = F.get(F.filter(strides, lambda x: F.forall("primes", lambda q: x % q != 0)), F.lit(0))
    steps = F.sequence(F.lit(0), candidate_count(k, F.col("n")) - 1)
    walk = F.transform(steps, lambda i: (F.col("offset") + i * F.col("stride")) % F.col("p"))
    rows = rows.withColumn("offset", F.when(p > 0, F.get("s", F.lit(1)) % p)).withColumn("stride", F.when(p > 0, stride))
    picked = F.transform(walk, lambda c: (c + (c >= F.col("row")).cast("int")).cast("int"))
    out = rows.withColumn("candidates", F.when(F.col("n") >= 3, picked).otherwise(F.array().cast("array<int>")))
    return out.drop("p", "s0", "s", "primes", "offset", "stride", "n")


def candidate_scores(batched: DataFrame) -> DataFrame:
    """batched: batch_id, row, id, indices, counts, candidates.  One row for each candidate: its position and counted similarity."""
    from ..functions.sparse import count_tanimoto

    asked = batched.select("batch_id", F.col("row").alias("anchor"), "id", "indices", "counts", F.posexplode("candidates").alias("pos", "row"))
    other = batched.select("batch_id", "row", F.col("id").alias("other"), F.col("indices").alias("oi"), F.col("counts").alias("oc"))
    met = asked.join(other, ["batch_id", "row"])
    return met.select("batch_id", "anchor", "id", "pos", F.col("row").alias("candidate"), "other", count_tanimoto(F.col("indices"), F.col("counts"), F.col("oi"), F.col("oc")).alias("score"))


def latent_candidates(batched: DataFrame, latent: str = "latent") -> DataFrame:
    """batched: batch_id, row, a latent vector and candidates.  One row for each candidate, with its vector's cosine to the anchor's."""
    asked = batched.select("batch_id", F.col("row").alias("anchor"), F.col(latent).alias("__a"), F.posexplode("candidates").alias("pos", "row"))
    other = batched.select("batch_id", "row", F.col(latent).alias("__b"))
    return asked.join(other, ["batch_id", "row"]).select("batch_id", "anchor", "pos", F.col("row").alias("candidate"), cosine(F.col("__a"), F.col("__b")).alias("cosine"))


def top2(scores: DataFrame) -> DataFrame:
    """Best position (the earliest of equals) and the gap to the second, from 0 to 1, of each anchor."""
    # An anchor has no more scores than candidates.
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "pos"))), 1, 2)
    best = scores.groupBy("batch_id", "anchor").agg(ordered.alias("best"))
    first, second = (-F.get("best", F.lit(k))["minus"] for k in (0, 1))
    gap = F.least(F.greatest(first - F.coalesce(second, first), F.lit(0.0)), F.lit(1.0))
    return best.select("batch_id", "anchor", F.get("best", F.lit(0))["pos"].alias("best_pos"), first.alias("best_score"), gap.alias("top2_gap"))


def log_softmax(rows: DataFrame, logit: str, by: list[str], to: str = "log_p") -> DataFrame:
    own = Window.partitionBy(*by)
    top = rows.withColumn("__top", F.max(logit).over(own))
    return top.withColumn(to, F.col(logit) - F.col("__top") - F.log(F.sum(F.exp(F.col(logit) - F.col("__top"))).over(own))).drop("__top")


def ranking_loss(logits: DataFrame, labels: DataFrame, min_gap: float = 0.0, pairs_per_batch: int = 0, batches: DataFrame | None = None) -> DataFrame:
    """logits: batch_id, anchor, pos, logit; labels: batch_id, anchor, best_pos, top2_gap.

    By batch: cross entropy weighted by the gap over anchors above min_gap, accuracy among them, and
    their number.  ``batches`` names all batches; those without candidates, under three rows, get zeros.
    """
    if pairs_per_batch:
        labels = labels.where(F.col("anchor") < pairs_per_batch)
    own = Window.partitionBy("batch_id", "anchor").orderBy(F.desc("logit"), "pos")
    ranked = log_softmax(logits, "logit", ["batch_id", "anchor"]).withColumn("rn", F.row_number().over(own))
    joined = ranked.join(labels, ["batch_id", "anchor"]).where(F.col("pos") == F.col("best_pos"))
    valid = F.col("top2_gap") > min_gap
    w = F.when(valid, F.col("top2_gap")).otherwise(0.0)
    out = joined.groupBy("batch_id").agg(
        (F.sum(-F.col("log_p") * w) / F.greatest(F.sum(w), F.lit(1e-6))).alias("loss"),
        (F.sum(F.when(valid & (F.col("rn") == 1), 1.0).otherwise(0.0)) / F.greatest(F.sum(F.when(valid, 1.0).otherwise(0.0)), F.lit(1.0))).alias("accuracy"),
        F.sum(F.when(valid, 1).otherwise(0)).alias("valid_pairs"),
    )
    return out if batches is None else batches.select("batch_id").distinct().join(out, "batch_id", "left").na.fill(0)


def weighted_ranking(batches: DataFrame, logits: DataFrame, labels: DataFrame, weight: float, min_gap: float = 0.0, pairs_per_batch: int = 0) -> DataFrame:
    """ranking_loss with its loss times the weight; without a weight zeros, and nothing is computed."""
    if weight <= 0:
        return batches.select("batch_id").distinct().select("batch_id", F.lit(0.0).alias("loss"), F.lit(0.0).alias("accuracy"), F.lit(0).cast("long").alias("valid_pairs"))
    return ranking_loss(logits, labels, min_gap, pairs_per_batch, batches).withColumn("loss", F.col("loss") * weight)
