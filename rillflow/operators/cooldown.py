"""Changes of a class with a cooldown, for runs that may hold most of a table.

An accepted change has one successor: the first later row of the run that is of another class and comes at least the cooldown
after it. Each change depends on the one before, but these links don't:

1. Rows are sorted by range, so that a run spans many parts. A task links the rows of its part among themselves, from the last
   row to the first, and notes where each row's chain ends in the part.
2. A chain's end looks for its successor in the parts that its run goes on in: the first whose latest time in another class is
   late enough, then the row in it.
3. Rows that are entered from another part make a small graph. Its pointers are doubled until all that a run's first row reaches
   is known.
4. Each part follows its links from the rows at which it is really entered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

#: The time of what stands before a run's first row: any row comes late enough after it.
BEFORE_ALL = -(1 << 61)


def _linked(rows: DataFrame, wait: int) -> DataFrame:
    """rows (run, seq, at, kind) with part, pos, stretch (the run's number in the part), to (pos of the successor) and last (pos where the chain ends).

    Each stretch also has a row before its first, of the same kind, with a negative pos: a run's chain begins there.
    """

    def run(batches: Iterator) -> Iterator:
        from bisect import bisect_right

        import pyarrow as pa
        from pyspark import TaskContext

        batches = list(batches)  # a task holds its part
        if not batches:
            return
        part, table = TaskContext.get().partitionId(), pa.Table.from_batches(batches)
        runs, times, kinds = (table.column(c).to_pylist() for c in ("run", "at", "kind"))
        starts = [i for i in range(len(runs)) if not i or runs[i] != runs[i - 1]]
        pos, stretch, to, last = list(range(len(runs))), [0] * len(runs), [None] * len(runs), list(range(len(runs)))
        firsts = []
        for k in range(len(starts) - 1, -1, -1):
            begin, end = starts[k], starts[k + 1] if k + 1 < len(starts) else len(runs)
            # rows of other kinds than the name, the nearest on top; each is later in time than those above it
            later: dict = {kind: ([], []) for kind in set(kinds[begin:end])}

            def find(kind, since, later=later):
                times_down, places = later[kind]
                found = bisect_right(times_down, -since) - 1
                return places[found] if found >= 0 else None

            for i in range(end - 1, begin - 1, -1):
                stretch[i], to[i] = k, find(kinds[i], times[i] + wait)
                if to[i] is not None:
                    last[i] = last[to[i]]
                for kind, (times_down, places) in later.items():
                    if kind != kinds[i]:
                        while times_down and -times_down[-1] <= times[i]:
                            times_down.pop()
                            places.pop()
                        times_down.append(-times[i])
                        places.append(i)
            first = find(kinds[begin], BEFORE_ALL)
            firsts.append((begin, -k - 1, k, first, -k - 1 if first is None else last[first]))
        more = pa.array([f[0] for f in firsts], pa.int64())
        whole = pa.concat_tables([table, table.take(more)])
        at = pa.array(times + [BEFORE_ALL] * len(firsts), pa.int64())
        made = [pa.array([*own, *(f[j] for f in firsts)], pa.int64()) for j, own in ((1, pos), (2, stretch), (3, to), (4, last))]
        columns = [whole.column("run"), whole.column("seq"), at, whole.column("kind"), pa.array([part] * len(at), pa.int64()), *made]
        yield from pa.table(columns, names=["run", "seq", "at", "kind", "part", "pos", "stretch", "to", "last"]).to_batches(max_chunksize=10_000)

    kinds = dict(rows.dtypes)
    schema = f"run {kinds['run']}, seq {kinds['seq']}, at long, kind string, part long, pos long, stretch long, to long, last long"
    return rows.select("run", "seq", "at", "kind").repartitionByRange("run", "seq").sortWithinPartitions("run", "seq").mapInArrow(run, schema)


def _next_parts(rows: DataFrame) -> tuple[list[int], list[int], dict[int, dict[str, int]]]:
    """The parts in order; for each, the place of the last part that its last run goes on in; and each part's latest time by
    kind in its first run. A few values a part come to the driver."""
    ends = rows.where("pos >= 0").groupBy("part").agg(F.min_by(F.struct("run"), "pos").alias("first"), F.max_by(F.struct("run"), "pos").alias("last"), F.max("stretch").alias("n")).orderBy("part").collect()
    tops: dict[int, dict[str, int]] = {}
    for r in rows.where("pos >= 0 and stretch = 0").groupBy("part", "kind").agg(F.max("at").alias("at")).collect():
        tops.setdefault(r.part, {})[r.kind] = r["at"]
    until = list(range(len(ends)))
    for i in range(len(ends) - 2, -1, -1):
        if ends[i]["last"] == ends[i + 1]["first"]:
            until[i] = until[i + 1] if ends[i + 1].n == 0 else i + 1
    return [r.part for r in ends], until, tops


def accepted_changes(rows: DataFrame, wait: int) -> DataFrame:
    """run, seq, from_kind, to_kind of each accepted change. rows: run (any type that sorts), seq, at (microseconds), kind (not null).

    A run begins with the kind of its first row; its first change needs no wait, the others come at least `wait` microseconds
    after the last accepted one. A null run is a run like any other; rows without seq, at or kind take no part.
    """
    types = dict(rows.dtypes)
    linked = stored(_linked(rows.where("seq is not null and at is not null and kind is not null"), wait))
    parts, until, tops = _next_parts(linked)
    going_on = [parts[i] for i in range(len(parts)) if until[i] > i]
    continued = [parts[i + 1] for i in range(len(parts)) if until[i] > i]

    @F.pandas_udf("long")
    def part_of(part: pd.Series, kind: pd.Series, since: pd.Series) -> pd.Series:
        from bisect import bisect_left

        import numpy as np

        out = pd.Series([None] * len(part), dtype="Int64")
        for (p, k), own in since.groupby([part, kind]):
            i = bisect_left(parts, p)
            ahead = parts[i + 1 : until[i] + 1]
            latest = np.maximum.accumulate([max((t for other, t in tops[q].items() if other != k), default=BEFORE_ALL - 1) for q in ahead])
            at = np.searchsorted(latest, own.to_numpy())
            out[own.index] = pd.array([ahead[i] if i < len(latest) else None for i in at], dtype="Int64")
        return out

    def entered(key, asked, there):
        """The first row of each kind but the asked one, and late enough, in the part's first run."""
        import numpy as np
        import pyarrow as pa

        at, kinds, pos = (there.column(c).to_numpy(zero_copy_only=False) for c in ("at", "kind", "pos"))
        order = np.argsort(pos)
        at, kinds, pos = at[order], kinds[order], pos[order]
        want, since = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "since"))
        found = np.empty(len(want), np.int64)
        for kind in set(want):
            latest = np.maximum.accumulate(np.where(kinds != kind, at, BEFORE_ALL - 1))
            own = want == kind
            found[own] = pos[np.searchsorted(latest, since[own])]
        return pa.table([asked.column("part"), asked.column("pos"), asked.column("kind"), pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array(found)], names=["part", "pos", "kind", "to_part", "to_pos"])

    starts = linked.where("pos < 0")
    starts = starts.where(~((F.col("stretch") == 0) & F.col("part").isin(continued))).select("part", "pos") if continued else starts.select("part", "pos")
    reached = starts.select("part", "pos", F.lit(None).cast("string").alias("was"))
    if going_on:
        last_stretch = linked.groupBy("part").agg(F.max("stretch").alias("stretch"))
        open_ends = linked.where("to is null").join(last_stretch, ["part", "stretch"]).where(F.col("part").isin(going_on))
        since = F.when(F.col("pos") < 0, F.lit(BEFORE_ALL)).otherwise(F.col("at") + wait)
        asked = stored(open_ends.select("part", "pos", "kind", since.alias("since")).withColumn("to_part", part_of("part", "kind", "since")).where("to_part is not null"))
        first_runs = linked.where("pos >= 0 and stretch = 0").select("part", "pos", "at", "kind")
        links = stored(asked.groupBy("to_part").cogroup(first_runs.groupBy("part")).applyInArrow(entered, "part long, pos long, kind string, to_part long, to_pos long"))
        # from each entry to the next one: along its chain to the end, and over that end's link
        entries = starts.union(links.select("to_part", "to_pos")).distinct()
        ends = entries.join(linked.select("part", "pos", "last"), ["part", "pos"])
        hops = stored(ends.join(links.select("part", F.col("pos").alias("last"), F.col("kind").alias("was"), "to_part", "to_pos"), ["part", "last"]).select("part", "pos", "to_part", "to_pos", "was"))
        seen, jump = stored(starts), hops.drop("was")
        while jump.limit(1).count():
            there = seen.join(jump, ["part", "pos"]).select(F.col("to_part").alias("part"), F.col("to_pos").alias("pos"))
            seen = stored(seen.union(there).distinct())
            twice = jump.select(F.col("part").alias("to_part"), F.col("pos").alias("to_pos"), F.col("to_part").alias("far_part"), F.col("to_pos").alias("far_pos"))
            jump = stored(jump.join(twice, ["to_part", "to_pos"]).select("part", "pos", F.col("far_part").alias("to_part"), F.col("far_pos").alias("to_pos")))
        reached = reached.union(hops.join(seen, ["part", "pos"]).select(F.col("to_part"), F.col("to_pos"), "was"))

    def followed(key, entries, there):
        import numpy as np
        import pyarrow as pa

        pos = there.column("pos").to_numpy()
        place = {p: i for i, p in enumerate(pos.tolist())}
        to, kinds = (there.column(c).to_pylist() for c in ("to", "kind"))
        found, before = [], []
        for p, was in zip(entries.column("pos").to_pylist(), entries.column("was").to_pylist(), strict=True):
            i = place[p]
            if was is not None:
                found.append(i)
                before.append(was)
            while to[i] is not None:
                was, i = kinds[i], place[to[i]]
                found.append(i)
                before.append(was)
        rows = there.take(pa.array(np.array(found, np.int64)))
        return pa.table([rows.column("run"), rows.column("seq"), pa.array(before, pa.string()), rows.column("kind")], names=["run", "seq", "from_kind", "to_kind"])

    every = linked.select("part", "pos", "to", "run", "seq", "kind")
    schema = f"run {types['run']}, seq {types['seq']}, from_kind string, to_kind string"
    return stored(reached).groupBy("part").cogroup(every.groupBy("part")).applyInArrow(followed, schema)
