"""Reproducible splits, batches, pairs and draws: every choice follows the md5 of the seed and the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.functions.hashing import hash_int, hash_key
from episodica.operators.ranks import global_rank


def split_by_ratio(df: DataFrame, train_ratio: float, seed: int, key: str = "episode", single: str = "both") -> DataFrame:
    """(key, split) by hash order: max(1, int(n ratio)) train, at most n - 1. One key alone is in both, or ('train_only') in train."""
    ranked = global_rank(df.select(key).distinct().withColumn("__h", hash_key(seed, key)), "__h", key)
    total = df.select(key).distinct().agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    n_train = F.when(n == 1, 1).otherwise(F.least(F.greatest(F.lit(1), F.floor(n * F.lit(train_ratio))), n - 1))
    tagged = ranked.join(F.broadcast(total)).withColumn("split", F.when(F.col("rank") < n_train, "train").otherwise("val"))  # one row
    split = tagged.select(key, "split")
    if single == "both":
        split = split.unionByName(tagged.filter("__n = 1").select(key, F.lit("val").alias("split")))
    return split


def split_first(df: DataFrame, val_ratio: float, seed: int, key: str = "episode") -> DataFrame:
    """(key, split) by hash order: the first max(1, round-half-even(n ratio)), at most n - 1, are val."""
    ranked = global_rank(df.select(key).distinct().withColumn("__h", hash_key(seed, key)), "__h", key)
    total = df.select(key).distinct().agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    n_val = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(val_ratio)).cast("long")), n - 1)
    return ranked.join(F.broadcast(total)).select(key, F.when(F.col("rank") < n_val, "val").otherwise("train").alias("split"))  # one row


def make_batches(df: DataFrame, size: int, seed: int, key: Sequence[str], drop_last: bool = True) -> DataFrame:
    """``df`` with batch_id and slot in hash order; the incomplete last batch goes if asked."""
    ranked = global_rank(df.withColumn("__h", hash_key(seed, *key)), "__h", *key).drop("__h")
    found = ranked.withColumns({"batch_id": F.floor(F.col("rank") / size), "slot": F.col("rank") % size}).drop("rank")
    if not drop_last:
        return found
    full = found.groupBy("batch_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == size)
    return found.join(full, "batch_id").drop("__n")


def camera_per_batch(df: DataFrame, n_views: int, mode: str, seed: int, batch: str = "batch_id") -> DataFrame:
    """``df`` with the batch's camera: drawn ('random'), or its number modulo the cameras ('fixed')."""
    if mode not in ("random", "fixed"):
        raise ValueError(f"unknown mode {mode!r}")
    return df.withColumn("camera", (hash_int(seed, batch) if mode == "random" else F.col(batch)) % n_views)


def far_partner(df: DataFrame, min_gap: int, seed: int, key: Sequence[str], t: str = "t", length: str = "len") -> DataFrame:
    """``df`` with partner: any step at least ``min_gap`` away; else any other; else the same. Closed form, no self join."""
    h, at, n = hash_int(seed, *key, t), F.col(t), F.col(length)
    if min_gap <= 0:
        return df.withColumn("partner", h % n)
    below, above = F.greatest(F.lit(0), at - min_gap + 1), F.greatest(F.lit(0), n - at - min_gap)
    i = h % F.nullif(below + above, F.lit(0))
    far = F.when(i < below, i).otherwise(i - below + at + min_gap)
    j = h % F.nullif(n - 1, F.lit(0))
    other = F.when(j < at, j).otherwise(j + 1)
    return df.withColumn("partner", F.when(below + above > 0, far).when(n > 1, other).otherwise(at).cast("long"))


def orient_pair(df: DataFrame, seed: int, key: Sequence[str], left: str, right: str) -> DataFrame:
    """``df`` with view_i and view_j: left and right by the flip of a coin."""
    heads = hash_int(seed, *key) % 2 == 0
    return df.withColumns({"view_i": F.when(heads, F.col(left)).otherwise(F.col(right)), "view_j": F.when(heads, F.col(right)).otherwise(F.col(left))})


def source_targets(states: DataFrame, n_views: int, seed: int, key: str = "state_id") -> DataFrame:
    """(key, source, target): a drawn source view, with each other view in order."""
    drawn = states.withColumn("source", hash_int(seed, key) % n_views)
    views = F.sequence(F.lit(0).cast("long"), F.lit(n_views - 1).cast("long"))
    return drawn.select(key, "source", F.explode(F.filter(views, lambda v: v != F.col("source"))).alias("target"))


def other_view(states: DataFrame, n_views: int, seed: int, source: str = "source", key: str = "state_id") -> DataFrame:
    """``states`` with other: a drawn view that isn't the source."""
    return states.withColumn("other", (F.col(source) + 1 + hash_int(seed, key, F.lit("other")) % (n_views - 1)) % n_views)


def non_identity_permutation(rows: DataFrame, seed: int, batch: str = "batch_id", key: str = "state_id") -> DataFrame:
    """(batch, key, mapped): a permutation of each batch's keys by hash order; one that would change nothing is rolled by one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(batch))
    ranked = rows.select(batch, key, (F.row_number().over(Window.partitionBy(batch).orderBy(key)) - 1).alias("__own"), (F.row_number().over(Window.partitionBy(batch).orderBy(hash_key(seed, batch, key), key)) - 1).alias("__drawn"), n.alias("__n"))
    same = F.min((F.col("__own") == F.col("__drawn")).cast("int")).over(Window.partitionBy(batch)) == 1
    moved = ranked.withColumn("__to", F.when(same, (F.col("__drawn") + 1) % F.col("__n")).otherwise(F.col("__drawn")))
    names = ranked.select(batch, F.col("__own").alias("__to"), F.col(key).alias("mapped"))
    return moved.join(names, [batch, "__to"]).select(batch, key, "mapped")


VARIANTS = ("self", "shuffle_inv", "shuffle_dep", "shuffle_both")


def recombine(states: DataFrame, n_views: int, seed: int, batch: str = "batch_id", key: str = "state_id") -> DataFrame:
    """(variant, batch, key, inv_state, dep_state, source, target): which state each half comes from in four variants.

    A shuffled dependent half carries its own source view with it; targets are the views but that source.
    """
    source = states.select(batch, key, (hash_int(seed, key) % n_views).alias("source"))
    moved = non_identity_permutation(states, seed, batch, key)
    joined = source.join(moved, [batch, key]).join(source.select(batch, F.col(key).alias("mapped"), F.col("source").alias("mapped_source")), [batch, "mapped"])
    variants = joined.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    inv, dep = F.col("variant").isin("shuffle_inv", "shuffle_both"), F.col("variant").isin("shuffle_dep", "shuffle_both")
    chosen = variants.select("variant", batch, key, F.when(inv, F.col("mapped")).otherwise(F.col(key)).alias("inv_state"), F.when(dep, F.col("mapped")).otherwise(F.col(key)).alias("dep_state"), F.when(dep, F.col("mapped_source")).otherwise(F.col("source")).alias("source"))
    views = F.sequence(F.lit(0).cast("long"), F.lit(n_views - 1).cast("long"))
    return chosen.select("*", F.explode(F.filter(views, lambda v: v != F.col("source"))).alias("target"))


def rolled_negative(rows: DataFrame, batch: str = "batch_id", key: str = "state_id") -> DataFrame:
    """``rows`` with negative: the key before it in the batch; the last one for the first."""
    w = Window.partitionBy(batch).orderBy(key)
    last = F.last(key).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("negative", F.when(F.row_number().over(w) == 1, last).otherwise(F.lag(key).over(w)))


def primary_reference_views(batches: DataFrame, n_views: int, seed: int, batch: str = "batch_id") -> DataFrame:
    """(batch, view, role): one primary and n // 3 reference views, drawn without replacement; the others remain."""
    views = batches.select(batch).distinct().withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))))
    place = F.row_number().over(Window.partitionBy(batch).orderBy(hash_key(seed, batch, "view"), "view"))
    return views.withColumn("place", place).select(batch, "view", F.when(F.col("place") == 1, "primary").when(F.col("place") <= 1 + n_views // 3, "reference").otherwise("rest").alias("role"))


def sample_rays(pixels: DataFrame, n: int, seed: int, side: int, precrop: bool = False, key: str = "state_id", pixel: str = "pixel") -> DataFrame:
    """(key, draw, pixel): n draws with replacement from a state's pixels, or from those of its image's centre."""
    row, col = F.floor(F.col(pixel) / side), F.col(pixel) % side
    inside = row.between(side // 4, side - side // 4 - 1) & col.between(side // 4, side - side // 4 - 1)
    pool = pixels.filter(inside) if precrop else pixels
    w = Window.partitionBy(key)
    ranked = pool.select(key, pixel, (F.row_number().over(w.orderBy(pixel)) - 1).cast("long").alias("__at"), F.count(F.lit(1)).over(w).alias("__n"))
    sizes = ranked.groupBy(key).agg(F.first("__n").alias("__n"))
    draws = sizes.select(key, "__n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")).withColumn("__at", hash_int(seed, key, "draw") % F.col("__n"))
    return draws.drop("__n").join(ranked.drop("__n"), [key, "__at"]).select(key, "draw", pixel)


def swap_pairs(frames: DataFrame, by: Sequence[str] = ("episode",), t: str = "t", camera: str = "camera") -> DataFrame:
    """(by, inv_camera, inv_t, dep_camera, dep_t): other camera, and step 1 for step 0, step 0 for the others."""
    a = frames.select(*by, F.col(camera).alias("inv_camera"), F.col(t).alias("inv_t"), F.when(F.col(t) == 0, 1).otherwise(0).cast("long").alias("dep_t"))
    b = frames.select(*by, F.col(camera).alias("dep_camera"), F.col(t).alias("dep_t"))
    return a.join(b, [*by, "dep_t"]).filter("inv_camera <> dep_camera").select(*by, "inv_camera", "inv_t", "dep_camera", "dep_t")


def allocate(views: DataFrame, n: int, by: Sequence[str] = ("episode",), view: str = "cam_idx") -> DataFrame:
    """(by, view, run): n runs dealt evenly, the first views get what is over; views without a run have no row."""
    w = Window.partitionBy(*by)
    count, place = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(view)) - 1
    share = views.select(*by, view, (F.floor(F.lit(n) / count) + F.when(place < F.lit(n) % count, 1).otherwise(0)).alias("__share")).filter("__share > 0")
    return share.select(*by, view, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__share") - 1)).alias("run"))


def sample_starts(valid: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """n valid starts, drawn by hash order without replacement: a sampling operator."""
    return valid.filter("valid").withColumn("__h", hash_key(seed, *key)).orderBy("__h", *key).limit(n).drop("__h")


def draw_starts(valid: DataFrame, n: int, seed: int, key: Sequence[str], first: int = 0) -> DataFrame:
    """(draw, the columns of ``valid``): draws ``first`` to ``first`` + n - 1 with replacement from the valid starts; each by itself, so a learner goes on for ever.

    A draw is a number that its md5 gives, modulo the number of valid starts: a place in the order of the starts' own md5. No task sorts that order. The starts
    are counted by the first six digits of their md5; 4,096 sums of those say which three digits a draw falls under, by binary search, and
    the counts under them which six, by walking both in step. Only starts under digits that a draw fell on are then put in order, a few
    at a time. A null key or seed draws as any other; without a valid start there are no draws.
    """
    from pyspark.ml.feature import Bucketizer

    spark = valid.sparkSession
    digits = lambda at: F.conv(F.substring("__h", at, 3), 16, 10).cast("int")
    ready = valid.filter("valid").withColumn("__h", hash_key(seed, *key)).withColumns({"__coarse": digits(1), "__fine": digits(4)})
    counts = ready.groupBy("__coarse", "__fine").agg(F.count(F.lit(1)).alias("__n"))
    sums = sorted((r[0], r[1]) for r in counts.groupBy("__coarse").agg(F.sum("__n")).collect())  # 4,096 at most
    begins, total = [], 0
    for coarse, size in sums:
        begins.append((coarse, total))
        total += size
    draws = spark.range(first, first + n if total else first).withColumnRenamed("id", "draw").withColumn("__at", hash_int(seed, "draw") % max(1, total))
    if not total:
        return draws.select("draw").join(valid.limit(0))
    splits = [-1.0, *(float(begin) for _, begin in begins), float("inf")]  # bucket 0 is empty
    found = Bucketizer(splits=splits, inputCol="__double", outputCol="__bucket").transform(draws.withColumn("__double", F.col("__at").cast("double")))
    named = spark.createDataFrame([(float(i), coarse, begin) for i, (coarse, begin) in enumerate(begins, 1)], "__bucket double, __coarse int, __begin long")
    coarse_draws = found.join(F.broadcast(named), "__bucket").select("__coarse", (F.col("__at") - F.col("__begin")).alias("__at"), "draw")  # 4,096 rows at most
    w = Window.partitionBy("__coarse")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__fine").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = counts.select("__coarse", before.alias("__at"), F.lit(None).cast("long").alias("draw"), F.struct(F.col("__fine").alias("fine"), before.alias("begin")).alias("__mark"))
    both = marks.unionByName(coarse_draws.withColumn("__mark", F.lit(None).cast(marks.schema["__mark"].dataType)))
    last = F.last("__mark", ignorenulls=True).over(w.orderBy("__at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = both.withColumn("__mark", last).filter("draw IS NOT NULL").select("draw", "__coarse", F.col("__mark.fine").alias("__fine"), (F.col("__at") - F.col("__mark.begin")).alias("__place"))
    under = ["__coarse", "__fine"]
    asked = ready.join(placed.select(*under).distinct(), under, "left_semi")
    ranked = asked.withColumn("__place", (F.row_number().over(Window.partitionBy(*under).orderBy("__h", *key)) - 1).cast("long"))
    return placed.join(ranked, [*under, "__place"]).select("draw", *valid.columns)


def limit_batches(df: DataFrame, k: int | None, batch: str = "batch_id", zero_is_all: bool = True) -> DataFrame:
    """The first k batches; all for None, and for k <= 0 if asked."""
    return df if k is None or (zero_is_all and k <= 0) else df.filter(F.col(batch) < k)
