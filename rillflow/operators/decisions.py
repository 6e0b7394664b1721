"""Analysis of placement decisions: choices by rule, rewards, confidence bounds, value updates, load regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import bucket, regime
from ..scratch import stored
from .cooldown import accepted_changes
from .ordered import previous, running


def pick_first(load: DataFrame) -> DataFrame:
    return load.groupBy("tick").agg(F.min_by("node", "ord").alias("node"))


def pick_least_loaded(load: DataFrame) -> DataFrame:
    return load.groupBy("tick").agg(F.min_by("node", F.struct("cpu_pct", "ord")).alias("node"))


def pick_by_priority(load: DataFrame, requests: DataFrame) -> DataFrame:
    """Priority 5 and over takes the least loaded node, else the first. requests: seq, tick, priority (text; bad is 1)."""
    priority = F.coalesce(F.col("priority").try_cast("int"), F.lit(1))
    both = load.groupBy("tick").agg(F.min_by("node", "ord").alias("_first"), F.min_by("node", F.struct("cpu_pct", "ord")).alias("_least"))
    return requests.join(both, "tick").select("seq", priority.alias("priority"), F.when(priority >= 5, F.col("_least")).otherwise(F.col("_first")).alias("node"))


def round_robin(requests: DataFrame, nodes: int) -> DataFrame:
    """The i-th request of a run (from 0) goes to node i % nodes."""
    return running(requests.select("run", "seq"), ["run"], "seq", {"_n": F.lit(1)}).select("run", "seq", (F.col("_n") % nodes).cast("long").alias("node"))


def by_turns(load: DataFrame, requests: DataFrame) -> DataFrame:
    """seq, node: the i-th request of a run (from 0), by seq, takes the node of place i % n among the n nodes of its tick, by ord."""
    place = F.row_number().over(Window.partitionBy("tick").orderBy("ord")) - 1
    places = load.select("tick", "node", place.alias("place"), F.count("*").over(Window.partitionBy("tick")).alias("n"))
    first = places.where("place = 0").select("tick", "n")
    nth = running(requests.select("run", "seq", "tick"), ["run"], "seq", {"_i": F.lit(1)}).join(first, "tick")
    return nth.withColumn("place", F.col("_i") % F.col("n")).join(places.drop("n"), ["tick", "place"]).select("seq", "node")


def _for_all(pick):
    return lambda load, requests: requests.join(pick(load), "tick").select("seq", "node")


#: Rules that look at loads only: node loads (tick, node, ord, cpu_pct) to a node a tick.
RULES = {"FCFS": pick_first, "LEAST_LOADED": pick_least_loaded}
#: The registry of all rules: loads and requests (run, seq, tick, priority) to seq and node. Others may be added.
STRATEGIES = {
    **{name: _for_all(pick) for name, pick in RULES.items()}, "BALANCED": by_turns, "PRIORITY": lambda load, requests: pick_by_priority(load, requests).select("seq", "node")
}


def choose(rule: str, load: DataFrame) -> DataFrame:
    """tick and node by the named rule; an unknown name raises ValueError. Rules that look at requests are place()'s."""
    if rule not in RULES:
        raise ValueError(f"{rule!r} is none of {', '.join(RULES)}")
    return RULES[rule](load)


def place(strategy: str, load: DataFrame, requests: DataFrame) -> DataFrame:
    """seq and node of each request by the named strategy; an unknown name raises ValueError. A request whose tick has no nodes gets none
    and no row."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is none of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](load, requests)


def arm_stats(selections: DataFrame) -> DataFrame:
    total = F.sum(F.col("reward").cast("decimal(20,8)")).cast("double")
    found = selections.groupBy("run", "node").agg(F.count("*").alias("selections"), total.alias("total_reward"))
    every = F.sum("selections").over(Window.partitionBy("run"))
    found = found.withColumn("share_pct", F.round(100.0 * F.col("selections") / every, 6))
    found = found.withColumn("mean_reward", F.round(F.col("total_reward") / F.col("selections"), 6))
    return found.withColumn("total_reward", F.round("total_reward", 6))


def ucb_scores(selections: DataFrame, least: int = 2) -> DataFrame:
    """Each arm's bound before each step, whether it was chosen there, and the run's phase.

    run, seq, node, chosen, tried, bound, phase: a row per step and arm of the run. bound is the mean reward so far and
    sqrt(2) * sqrt(ln(N + 1) / n), for an arm not tried yet the largest double. The phase is EXPLORATION as long as an
    arm has fewer than `least` selections before the step; rows that share run and seq are one step, and have one phase. Rewards are summed to 8 decimals; a null run is a run like any other, a step without a
    node chooses no arm. A run has few arms: all of them are summed up side by side in one pass over the steps, and a step is
    spread to its arms afterwards.
    """
    arms = selections.groupBy(F.col("run").alias("_run")).agg(F.array_sort(F.collect_set("node")).alias("_arms"))
    arms = stored(arms)
    most = arms.agg(F.max(F.size("_arms"))).first()[0] or 0
    rows = selections.join(arms, F.col("run").eqNullSafe(F.col("_run"))).select(
        "run", "seq", "_arms", (F.array_position("_arms", F.col("node")) - 1).cast("int").alias("_own"), F.coalesce(F.col("reward").cast("decimal(20,8)"), F.lit(0)).cast("decimal(20,8)").alias("_reward")
    )
    own = lambda k: F.coalesce(F.col("_own") == k, F.lit(False))
    sums = {f"_n{k}": own(k).cast("long") for k in range(most)} | {f"_r{k}": F.when(own(k), F.col("_reward")).otherwise(F.lit(0).cast("decimal(20,8)")) for k in range(most)}
    seen = running(rows, ["run"], "seq", sums | {"_steps": F.lit(1)}, tied=tuple(f"_n{k}" for k in range(most)))
    before = F.array(*(f"_n{k}_tied" for k in range(most)))
    tried, total = F.array(*(f"_n{k}" for k in range(most))), F.array(*(F.col(f"_r{k}").cast("double") for k in range(most)))
    few = F.array_min(F.slice(before, 1, F.size("_arms"))) < least
    each = seen.select("run", "seq", "_own", "_steps", tried.alias("_n"), total.alias("_r"), few.alias("_few"), F.posexplode("_arms").alias("_k", "node"))
    n, mean = F.get("_n", F.col("_k")), F.get("_r", F.col("_k")) / F.get("_n", F.col("_k"))
    bound = F.round(mean + F.sqrt(F.lit(2.0)) * F.sqrt(F.log((F.col("_steps") + 1).cast("double")) / n), 6)
    return each.select(
        "run", "seq", "node", F.coalesce(F.col("_own") == F.col("_k"), F.lit(False)).alias("chosen"), n.alias("tried"),
        F.when(n > 0, bound).otherwise(F.lit(1.7976931348623157e308)).alias("bound"), F.when(F.col("_few"), "EXPLORATION").otherwise("EXPLOITATION").alias("phase"),
    )


def states(load: DataFrame) -> DataFrame:
    cpu = F.coalesce(F.col("cpu_pct"), F.lit(50.0))
    found = load.groupBy("tick").agg((F.sum(cpu.cast("decimal(20,4)")).cast("double") / F.count("*")).alias("mean"), F.max(cpu).alias("most"))
    return found.select("tick", F.concat_ws("_", bucket(F.col("mean")), bucket(F.col("most"))).alias("state"))


def epsilon_schedule(steps: DataFrame) -> DataFrame:
    """Visits of a state so far, with this one, and the chance of exploring, max(0.05, 1 / sqrt(visits))."""
    seen = running(steps.select("run", "seq", "state"), ["run", "state"], "seq", {"_n": F.lit(1)}).withColumn("visits", (F.col("_n") + 1).cast("long"))
    return seen.select("run", "seq", "state", "visits", F.round(F.greatest(F.lit(0.05), 1 / F.sqrt(F.col("visits").cast("double"))), 6).alias("epsilon"))


def td_audit(steps: DataFrame, alpha: float = 0.2, gamma: float = 0.8) -> DataFrame:
    """The value that an update should have logged, and how far off it is."""
    due = F.col("q") + alpha * (F.col("reward") + gamma * F.col("q_next") - F.col("q"))
    return steps.withColumn("q_due", F.round(due, 6)).withColumn("off", F.round(F.abs(F.col("q_new") - due), 6))


def regime_changes(ticks: DataFrame) -> DataFrame:
    """run, seq, from, to where the regime differs from the run's row before."""
    rows = previous(ticks.select("run", "seq", regime(F.col("cpu")).alias("to_regime")), ["run"], "seq", "to_regime", "from_regime")
    return rows.where("from_regime <> to_regime").select("run", "seq", "from_regime", "to_regime")


def regime_cooldown(ticks: DataFrame, seconds: int) -> DataFrame:
    """Changes that come at least `seconds` after the last one that was let through; the run's first change needs no wait.

    ticks: run (of any type that sorts; null is a run too), seq, ts, cpu. Rows without a seq or a time take no part. A run may hold
    most of the rows: see cooldown.
    """
    rows = ticks.select("run", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), regime(F.col("cpu")).alias("kind"))
    found = accepted_changes(rows, seconds * 1_000_000)
    return found.select("run", "seq", F.col("from_kind").alias("from_regime"), F.col("to_kind").alias("to_regime"))
