"""Sequence windows over the steps of an episode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from episodica.functions.checks import not_empty


def _over(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


#: Seconds of a stretch of time within which an actor's rows are numbered together.
SPAN = 86_400
#: Transitions of a block that one window takes.
BLOCK = 65_536


def _stretch(log: DataFrame, column: str, span: float) -> Column:
    """The number of the stretch of ``span`` seconds (or units) that a row's first order column lies in; nulls come first, as they sort."""
    kind = log.schema[column].dataType.typeName()
    at = F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(column)
    return F.coalesce(F.floor(at / F.lit(span)).cast("long"), F.lit(-(2**63)))


def assign_ids(log: DataFrame, actor: str = "actor", order: Sequence[str] = ("ts", "event_id"), done: str = "done", span: float | None = None) -> DataFrame:
    """``log`` with transition_id, episode, step and state_id of each transition, all from 0 within its actor.

    An episode ends with the row that is done. Its terminal state has an id but no transition, hence a state's id
    is its transition's plus the number of episodes before.

    With a ``span`` (seconds of a time, or units of a number in the first order column; :data:`SPAN` suits logs of days) this is a segmented scan: rows
    are numbered within their actor's stretches of time, and each stretch gets what the earlier ones sum up to: rows, ends, and where the last end
    was. So an actor with most of the rows is spread over as many tasks as it has stretches. The rows are exchanged once; four columns of
    them once more, for a row a stretch. Without a span one window takes an actor whole. The ids are the same.
    """
    if span is None:
        w = _over([actor], order)
        ended = F.coalesce(F.sum(F.col(done).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = log.withColumn("transition_id", (F.row_number().over(w) - 1).cast("long")).withColumn("episode", ended)
        first = F.min("transition_id").over(Window.partitionBy(actor, "episode"))
        return found.withColumn("step", F.col("transition_id") - first).withColumn("state_id", F.col("transition_id") + F.col("episode"))
    dealt = log.withColumn("__at", F.struct(F.col(actor).alias("actor"), _stretch(log, order[0], span).alias("stretch")))  # never null, so that null actors meet
    w = _over(["__at"], order)
    ends = F.col(done).cast("long")
    place = (F.row_number().over(w) - 1).cast("long")
    sums = dealt.select("__at", *order, done).withColumn("__place", place).groupBy("__at")
    sums = sums.agg(F.count(F.lit(1)).alias("__n"), F.coalesce(F.sum(ends), F.lit(0)).alias("__ends"), F.max(F.when(F.col(done), F.col("__place"))).alias("__last"))
    earlier = Window.partitionBy("__at.actor").orderBy("__at.stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x: F.coalesce(x.over(earlier), F.lit(0))
    carried = sums.withColumns({"__rows": before(F.sum("__n")), "__ended": before(F.sum("__ends"))})
    carried = carried.select("__at", "__rows", "__ended", before(F.max(F.col("__rows") + F.col("__last") + 1)).alias("__opened"))
    earlier_here = w.rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("__place", place).withColumns({"__own_ended": F.coalesce(F.sum(ends).over(earlier_here), F.lit(0)), "__own_last": F.max(F.when(F.col(done), F.col("__place"))).over(earlier_here)})
    met = own.join(carried, "__at")
    met = met.withColumns({"transition_id": F.col("__rows") + F.col("__place"), "episode": F.col("__ended") + F.col("__own_ended")})
    step = F.when(F.col("__own_last").isNull(), F.col("transition_id") - F.col("__opened")).otherwise(F.col("__place") - F.col("__own_last") - 1)
    return met.withColumns({"step": step, "state_id": F.col("transition_id") + F.col("episode")}).select(*log.columns, "transition_id", "episode", "step", "state_id")


def deal(steps: DataFrame, before: int, after: int, block: int = BLOCK, actor: str = "actor", at: str = "transition_id") -> DataFrame:
    """``steps`` with block and halo, for :func:`frame_stack`, :func:`nstep_return` and :func:`valid_start` on parts of an actor's steps.

    Blocks have ``block`` transitions each, whatever the actor's number of them and its episodes' lengths. The last ``before`` rows of a
    block also go to the next one and the first ``after`` rows to the one before, with ``halo``, so that windows that reach no
    farther see what they need. :func:`undeal` takes them away again. ``at`` numbers an actor's steps without gaps.
    """
    if block <= max(before, after, 0):
        raise ValueError(f"a block of {block} rows is too short for {before} before and {after} after")
    own, place = F.floor(F.col(at) / block).cast("long"), F.col(at) % block
    copies = F.array_compact(F.array(own, F.when(place >= block - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    return steps.withColumn("block", F.explode(copies)).withColumn("halo", F.col("block") != own)


def undeal(dealt: DataFrame) -> DataFrame:
    """The steps themselves, without the copies that :func:`deal` made."""
    return dealt.filter(~F.col("halo")).drop("block", "halo")


def _episode_window(steps: DataFrame, by: Sequence[str], order: str, actor: str = "actor", at: str = "transition_id") -> WindowSpec:
    """The window over an episode's steps or, for dealt ones, over a block's."""
    return _over([actor, "block"], [at]) if {"block", "halo"} <= set(steps.columns) else _over(by, [order])


def _ahead(w: WindowSpec, by: Sequence[str], k: int) -> Column:
    """Whether the row ``k`` on is there and of the same episode."""
    here = F.struct(*by)
    return F.coalesce(F.lead(here, k).over(w).eqNullSafe(here), F.lit(False))


def nstep_return(steps: DataFrame, n: int, gamma: float, by: Sequence[str] = ("actor", "episode"), order: str = "step", reward: str = "reward", done: str = "done") -> DataFrame:
    """``steps`` with n_return, n_discount and next_step of each start that has n transitions ahead in its episode; others go. Dealt steps (:func:`deal`
    with ``after`` n - 1 or more) are taken by block."""
    w = _episode_window(steps, by, order)
    total, factor = F.lit(0.0), F.lit(1.0)
    for k in range(n):
        total = total + factor * F.lead(reward, k).over(w)
        factor = factor * F.when(F.lead(done, k).over(w), 0.0).otherwise(1.0) * F.lit(float(gamma))
    found = steps.select("*", _ahead(w, by, n - 1).alias("__ahead"), total.alias("n_return"), factor.alias("n_discount"))
    return found.filter("__ahead").withColumn("next_step", F.col(order) + n).drop("__ahead")


def valid_start(steps: DataFrame, n: int, max_size: int | None = None, by: Sequence[str] = ("actor", "episode"), order: str = "step", actor: str = "actor") -> DataFrame:
    """``steps`` with ``valid``: its n transitions lie in one episode and, of the actor's last ``max_size``, none is older. Dealt steps (:func:`deal` with
    ``after`` n - 1 or more) are taken by block, and the newest ids by an aggregation."""
    ahead = _ahead(_episode_window(steps, by, order), by, n - 1)
    if max_size is None:
        return steps.withColumn("valid", ahead)
    if "halo" in steps.columns:
        newest = steps.groupBy(F.col(actor).alias("__actor")).agg(F.max("transition_id").alias("__newest"))
        met = steps.withColumn("valid", ahead).join(newest, F.col(actor).eqNullSafe(F.col("__actor")))
        return met.withColumn("valid", F.col("valid") & (F.col("transition_id") >= F.col("__newest") + 1 - max_size)).drop("__actor", "__newest")
    newest = F.max("transition_id").over(Window.partitionBy(actor))
    return steps.withColumn("valid", ahead & (F.col("transition_id") >= newest + 1 - max_size))


def retain_latest(steps: DataFrame, max_size: int, actor: str = "actor", id_col: str = "transition_id") -> DataFrame:
    """The last ``max_size`` transitions of each actor."""
    newest = steps.groupBy(actor).agg((F.max(id_col) + 1 - max_size).alias("__from"))
    return steps.join(newest, actor).filter(F.col(id_col) >= F.col("__from")).drop("__from")


def frame_stack(steps: DataFrame, k: int, value: str, by: Sequence[str] = ("actor", "episode"), order: str = "step") -> DataFrame:
    """``steps`` with ``stack``: the values of the last k steps, oldest first; before an episode's begin, its first value. Dealt steps (:func:`deal` with
    ``before`` k - 1 or more) are taken by block."""
    w = _episode_window(steps, by, order)
    if "halo" in steps.columns:
        stack = [F.col(value)]
        for i in range(1, k):  # a step that is not there is the one nearest to it, the episode's first
            stack.append(F.when(F.col(order) >= i, F.lag(value, i).over(w)).otherwise(stack[-1]))
        return steps.withColumn("stack", F.array(*reversed(stack)))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.row_number().over(w)
    return steps.withColumn("stack", F.array(*[F.when(at > i, F.lag(value, i).over(w)).otherwise(first) for i in range(k - 1, -1, -1)]))


def padded_windows(steps: DataFrame, horizon: int, n_obs: int, value: str, by: Sequence[str] = ("episode",), order: str = "t") -> DataFrame:
    """(by, order, obs, actions): n_obs values up to each step and ``horizon`` from the same first one on, the ends repeated."""
    if horizon < n_obs:
        raise ValueError(f"horizon {horizon} is less than n_obs {n_obs}")
    w = _over(by, [order])
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pieces = []
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(full)
    for k in range(horizon):
        offset = k - (n_obs - 1)
        moved = F.lag(value, -offset).over(w) if offset < 0 else F.lead(value, offset).over(w)
        pieces.append(F.when(at + offset < 1, F.first(value).over(full)).when(at + offset > n, F.last(value).over(full)).otherwise(moved))
    found = steps.select(*by, order, F.array(*pieces).alias("actions"))
    return found.select(*by, order, F.slice("actions", 1, n_obs).alias("obs"), "actions")


def strided_windows(steps: DataFrame, length: int, stride: int, value: str, by: Sequence[str] = ("episode",), order: str = "t", strict: bool = False) -> DataFrame:
    """(by, start, values): windows of ``length`` rows, one every ``stride`` from an episode's first; short episodes have none. ``strict``:
    no window at all is an error."""
    w = _over(by, [order])
    at = F.row_number().over(w) - 1
    ahead = F.collect_list(F.coalesce(F.struct(F.col(value).alias("v")), F.struct(F.lit(None).alias("v")))).over(w.rowsBetween(0, length - 1))
    found = steps.select(*by, at.cast("long").alias("start"), ahead.alias("w")).filter((F.col("start") % stride == 0) & (F.size("w") == length))
    whole = found.select(*by, "start", F.transform("w", lambda x: x["v"]).alias("values"))
    return not_empty(whole, f"episode of {length} rows") if strict else whole


def action_slice(windows: DataFrame, n_obs: int, n_act: int, actions: str = "actions") -> DataFrame:
    """``windows`` with ``executed``: n_act predicted actions from the one at the last observation on."""
    return windows.withColumn("executed", F.slice(actions, n_obs, n_act))


def rolling_mean(rows: DataFrame, size: int, values: Sequence[str], by: Sequence[str], order: Sequence[str], span: float | None = None, block: int = BLOCK) -> DataFrame:
    """``rows`` with rolling_<value>: the mean of the last ``size`` rows.

    With a ``span`` (of the first order column) no group is one task: rows are numbered by :func:`assign_ids` and averaged in blocks of ``block`` rows, each of
    which sees the ``size`` - 1 before it. The rows are the same.
    """
    if span is None:
        w = _over(by, order).rowsBetween(-(size - 1), 0)
        return rows.select("*", *[F.avg(F.col(v).cast("double")).over(w).alias(f"rolling_{v}") for v in values])
    plain = rows.select(*[F.col(c).alias(f"own_{c}") for c in rows.columns], F.struct(*by).alias("actor"), F.lit(False).alias("done"))
    dealt = deal(assign_ids(plain, order=[f"own_{c}" for c in order], span=span), size - 1, 0, block)
    w = _over(["actor", "block"], ["transition_id"]).rowsBetween(-(size - 1), 0)
    found = dealt.select("*", *[F.avg(F.col(f"own_{v}").cast("double")).over(w).alias(f"rolling_{v}") for v in values])
    return undeal(found).select(*[F.col(f"own_{c}").alias(c) for c in rows.columns], *[f"rolling_{v}" for v in values])


def rolling_metric(rows: DataFrame, k: int, value: str = "value", by: Sequence[str] = ("name",), step: str = "step", span: float | None = None) -> DataFrame:
    """The mean of the last k values at each step that k divides; with a ``span`` of steps, in blocks, so that a metric isn't one task."""
    return rolling_mean(rows, k, [value], by, [step], span).filter(F.col(step) % k == 0)


def action_repeat(steps: DataFrame, k: int, by: Sequence[str] = ("actor", "episode"), order: str = "step", limit: int | None = None) -> DataFrame:
    """Groups of k raw steps as one: summed reward, any success and done, the last observation's step; up to the first end or ``limit``."""
    end = F.min(F.when(F.col("done"), F.col(order))).over(Window.partitionBy(*by))
    kept = steps.withColumn("__end", end).filter(F.col("__end").isNull() | (F.col(order) <= F.col("__end")))
    kept = kept if limit is None else kept.filter(F.col(order) < limit)
    return kept.groupBy(*by, F.floor(F.col(order) / k).alias("t")).agg(F.sum("reward").alias("reward"), F.max("success").alias("success"), F.max("done").alias("done"), F.max(order).alias("last_step"), F.max_by("reward", order).alias("last_reward"))


def align_transitions(logs: DataFrame, by: Sequence[str] = ("episode",), order: str = "t", obs: str = "obs", next_obs: str = "next_obs") -> DataFrame:
    """``logs`` with ``aligned``: whether next_obs is the observation of the row that follows (true for the last one)."""
    following = F.lead(F.struct(obs)).over(_over(by, [order]))
    return logs.withColumn("aligned", F.when(following.isNull(), True).otherwise(following[obs].eqNullSafe(F.col(next_obs))))


def truncate(steps: DataFrame, max_steps: int, by: Sequence[str] = ("actor",), order: str = "step", on_success: bool = True) -> DataFrame:
    """Rows up to an episode's first success (if asked) or end, and before ``max_steps``."""
    stop = F.col("done") | F.col("success") if on_success else F.col("done")
    end = F.min(F.when(stop, F.col(order))).over(Window.partitionBy(*by))
    return steps.withColumn("__end", end).filter((F.col(order) < max_steps) & F.coalesce(F.col(order) <= F.col("__end"), F.lit(True))).drop("__end")


def token_grid(tokens: DataFrame, n_tokens: int, token: str = "token") -> DataFrame:
    """``tokens`` with row and col on a square grid; another number of tokens is an error."""
    side = round(n_tokens**0.5)
    if side * side != n_tokens:
        raise ValueError(f"{n_tokens} tokens do not make a square grid")
    return tokens.withColumns({"row": F.floor(F.col(token) / side), "col": (F.col(token) % side).cast("long")})


def positions(value: str | Column, *names: str) -> Column:
    """posexplode of an array as named columns."""
    return F.posexplode(value).alias(*names)
