"""Event-time gates. A gate whose state is the last *accepted* event is a fold, not a plain window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stretches(x: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """``x`` with ``_from``: where its key's stretch of events begins. Between stretches lie more than ``gap`` microseconds
    without an event, so no state crosses them and each is folded on its own, however many events the key has.

    Time is cut into bins as long as the gap; only the distinct bins of a key are put in order.
    """
    x = x.withColumn("_bin", F.floor(F.col("us") / gap))
    bins = x.select(*keys, "_bin").distinct()
    w = Window.partitionBy(*keys).orderBy("_bin")
    first = F.when(F.coalesce(F.col("_bin") - F.lag("_bin").over(w) > 1, F.lit(True)), F.col("_bin"))
    starts = bins.withColumn("_first", first).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_b"), F.max("_first").over(w).alias("_from"))
    same = F.col("_bin") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return x.join(starts, same).drop("_bin", "_b", *[f"_k_{k}" for k in keys])


def _fold(events: DataFrame, keys: list[str], ts: str, step, start, gap: int, extra: list[str] = [], kind: str = "accepted boolean") -> DataFrame:  # noqa: B006
    """(event_id, outcome), decided by ``step(state, us, *extra) -> (outcome, state)`` over each key's events in order.

    A state older than ``gap`` microseconds must equal ``start``. Keys are cut into independent stretches, hash-partitioned
    and sorted; a partition is streamed in Arrow batches and only the gate's state is held, never a group.
    """
    # timestamps travel as microseconds, ties are broken by event_id
    # keys as text: a null key is one key
    x = events.select(*[F.col(k).cast("string").alias(k) for k in keys], "event_id", F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), *extra)
    x = _stretches(x, keys, gap)
    by = [*keys, "_from"]
    x = x.repartition(*by).sortWithinPartitions(*by, "us", "event_id")
    name = kind.split(" ")[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start
        for pdf in batches:
            out = []
            for row in zip(*(pdf[k] for k in [*by, "us", *extra])):
                if row[: len(by)] != current:
                    current, state = row[: len(by)], start
                done, state = step(state, *row[len(by) :])
                out.append(done)
            yield pdf[["event_id"]].assign(**{name: out})

    return x.mapInPandas(run, f"event_id {dict(x.dtypes)['event_id']}, {kind}")


def throttle(events: DataFrame, keys: list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """(event_id, accepted): an event counts unless an accepted one lies less than ``seconds`` before it."""
    gap = seconds * 1_000_000

    def step(state, us):
        ok = state is None or us - state >= gap
        return ok, us if ok else state

    return _fold(events, keys, ts, step, None, gap)


def rate_limit(events: DataFrame, keys: list[str], seconds: int, n: int, ts: str = "ts") -> DataFrame:
    """(event_id, accepted): at most ``n`` accepted events per key in any ``seconds``; the state holds at most n times."""
    gap = seconds * 1_000_000

    def step(state, us):
        kept = tuple(t for t in state if t > us - gap)
        ok = len(kept) < n
        return ok, (*kept, us) if ok else kept

    return _fold(events, keys, ts, step, (), gap)


def reveal(requests: DataFrame, viewer: str, item: str, seconds: int, n: int, ts: str = "ts") -> DataFrame:
    """(event_id, outcome) of requests to see a contact: ``rate`` where the viewer was counted ``n`` times in the last
    ``seconds``, else ``seen`` where it was for this item, else ``counted``. Only counted requests are logged; the limit is
    asked before the throttle. The state holds at most n times."""
    gap = seconds * 1_000_000

    def step(state, us, what):
        kept = tuple(x for x in state if x[0] > us - gap)
        if len(kept) >= n:
            return "rate", kept
        if any(w == what for _, w in kept):
            return "seen", kept
        return "counted", (*kept, (us, what))

    return _fold(requests.withColumn("_item", F.col(item).cast("string")), [viewer], ts, step, (), gap, ["_item"], "outcome string")


def alert_merge(events: DataFrame, key: str, minutes: int, ts: str = "ts") -> DataFrame:
    """(event_id, sends, so_far): an event sends unless the one before it is less than ``minutes`` old; running count."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    before = F.lag(ts).over(w)
    sends = before.isNull() | (before <= F.col(ts) - F.make_dt_interval(mins=F.lit(minutes)))
    return events.select("event_id", sends.alias("sends"), F.row_number().over(w).alias("so_far"))


def stop_after_known(events: DataFrame, key: str, known: str, m: int, order: list[str]) -> DataFrame:
    """Rows processed before the walk of each key stops: at its first run of ``m`` known rows in a row."""
    w = Window.partitionBy(key).orderBy(*order)
    x = events.withColumn("_island", F.sum(F.when(F.col(known), 0).otherwise(1)).over(w)).withColumn("_pos", F.row_number().over(w))
    run = F.sum(F.when(F.col(known), 1).otherwise(0)).over(Window.partitionBy(key, "_island").orderBy("_pos"))
    x = x.withColumn("_run", run)
    cutoff = F.min(F.when(F.col("_run") >= m, F.col("_pos"))).over(Window.partitionBy(key))
    return x.withColumn("_cut", cutoff).where(F.col("_cut").isNull() | (F.col("_pos") <= F.col("_cut"))).drop("_island", "_run", "_cut").withColumnRenamed("_pos", "pos")


def layout_alert(events: DataFrame, key: str, empty: str, min_new: int, ratio: float, order: list[str]) -> DataFrame:
    """(key, stop_pos): the first position at which at least ``min_new`` rows have more than ``ratio`` empty titles."""
    w = Window.partitionBy(key).orderBy(*order)
    x = events.select(key, F.row_number().over(w).alias("pos"), F.sum(F.col(empty).cast("int")).over(w).alias("n_empty"))
    return x.where((F.col("pos") >= min_new) & (F.col("n_empty") / F.col("pos") > ratio)).groupBy(key).agg(F.min("pos").alias("stop_pos"))


def admit_slots(requests: DataFrame, ts: str, hold: str, limit: int, longest: int) -> DataFrame:
    """(event_id, accepted): a request is admitted while fewer than ``limit`` admitted ones are held, each for its own
    ``hold`` seconds. No hold is longer than ``longest`` seconds; requests further apart are judged independently."""

    def step(state, us, seconds):
        held = tuple(t for t in state if t > us)
        ok = len(held) < limit
        return ok, (*held, us + int(seconds) * 1_000_000) if ok else held

    x = requests.withColumn("_all", F.lit(1)).withColumn("_hold", F.least(F.col(hold).cast("long"), F.lit(longest)))
    return _fold(x, ["_all"], ts, step, (), longest * 1_000_000, ["_hold"])


#: Seconds after which a run that never ended no longer counts as running, and between two runs at least.
ZOMBIE, FLOOR, DEBUG_FLOOR = 6 * 3600, 3600, 10


def trigger_gate(requests: DataFrame, key: str, interval: int, ts: str = "ts", force: str = "force", seconds: str = "run_seconds", debug: bool = False) -> DataFrame:
    """(event_id, accepted): a run may start when none is running and the last start is an interval old; forced ones always.

    The interval is the configured one, but at least an hour, or ten seconds when debugging. A run lasts ``run_seconds``;
    one without is a zombie that counts as running for six hours.
    """
    wait = max(DEBUG_FLOOR if debug else FLOOR, interval) * 1_000_000
    zombie = ZOMBIE * 1_000_000

    def step(state, us, forced, lasts):
        last, runs = state
        runs = tuple(r for r in runs if r[0] > us - zombie and r[1] > us)
        ok = bool(forced) or (not runs and (last is None or us - last >= wait))
        if not ok:
            return False, (last, runs)
        end = us + int(lasts) * 1_000_000 if lasts == lasts and lasts is not None else 1 << 62
        return True, (us, (*runs, (us, end)))

    x = requests.withColumn("_force", F.coalesce(F.col(force), F.lit(False))).withColumn("_lasts", F.col(seconds).cast("double"))
    return _fold(x, [key], ts, step, (None, ()), max(wait, zombie), ["_force", "_lasts"])
