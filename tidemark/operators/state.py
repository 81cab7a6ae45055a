"""Keyed state as folds over logs: versions and expiry, counter windows, rate limits, memo, jobs, instruments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact


def latest(log: DataFrame, key: str, version: str, now: int | None = None, expires: str | None = None) -> DataFrame:
    """The newest version of each key; what has expired is absent. Newest per key meets before the shuffle."""
    cols = [c for c in log.columns if c != key]
    best = log.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("r")).select(key, "r.*")
    return best if expires is None else best.where(F.col(expires).isNull() | (F.col(expires) > now))


def entries(log: DataFrame, key: str, at: str) -> DataFrame:
    """What each call on a key did: (key, seq, answer, value, version, expires).

    ``log``: (key, seq, at, op, value, version, ttl, idle). Calls are set, create, get, take, delete and expire, in the
    order of (at, seq); a ``version`` makes one conditional, and ``conflict`` its answer where the key has another, is
    gone or expired. A version is the ``seq`` that wrote the value. An idle key expires so long after its last read or
    write; a read renews it. ``expires`` null: never.
    """

    def step(s, row):
        now, op = row[at], row["op"]
        told = lambda x: x is not None and x == x
        if s is not None and s["expires"] is not None and s["expires"] <= now:
            s = None
        if told(row["version"]) and (s is None or s["version"] != row["version"]):
            answer = "conflict"
        elif op == "create" and s is not None:
            answer = "exists"
        elif op in ("set", "create"):
            idle = int(row["idle"]) if told(row["idle"]) else None
            left = idle if idle is not None else int(row["ttl"]) if told(row["ttl"]) else None
            s, answer = {"value": row["value"], "version": row["seq"], "idle": idle, "expires": None if left is None else now + left}, "written"
        elif s is None:
            answer = "missing"
        elif op == "get":
            s, answer = {**s, "expires": now + s["idle"] if s["idle"] is not None else s["expires"]}, "found"
        elif op == "expire":
            s, answer = {**s, "idle": None, "expires": now + int(row["ttl"])}, "written"
        else:
            return None, (row[key], row["seq"], "taken" if op == "take" else "deleted", s["value"] if op == "take" else None, None, None)
        shown = s or {"value": None, "version": None, "expires": None}
        return s, (row[key], row["seq"], answer, shown["value"], shown["version"], shown["expires"])

    kind = log.schema[key].dataType.simpleString()
    return fold(log, key, [at, "seq"], step, lambda: None, f"{key} {kind}, seq long, answer string, value string, version long, expires long")


def fold(log: DataFrame, key: str, order: list[str], step, state, columns: str):
    """Rows of each key in order through ``step(state, row) -> (state, output)``; keys are spread over tasks, and one
    key's state passes from batch to batch, so that a hot key is never held in memory as a whole."""
    kinds = dict(c.strip().split(" ") for c in columns.split(","))
    names = list(kinds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, s = object(), None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if row[key] != current:
                    current, s = row[key], state()
                s, o = step(s, row)
                out.append(o)
            yield pd.DataFrame(out, columns=names, dtype=object).astype({n: "Int64" for n, k in kinds.items() if k == "long"})

    return log.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, columns)


def counter_windows(log: DataFrame, key: str, at: str, amount: str, span: int) -> DataFrame:
    """Fixed windows that begin at the first addition after the last one ended: (key, seq, begin, total so far)."""

    def step(s, row):
        begin, total = s
        if begin is None or row[at] >= begin + span:
            begin, total = row[at], 0
        total += row[amount]
        return (begin, total), (row[key], row["seq"], begin, total)

    return fold(log, key, [at, "seq"], step, lambda: (None, 0), f"{key} long, seq long, window_begin long, total long")


def rate_limit(log: DataFrame, key: str, at: str, limit: int, span: int) -> DataFrame:
    """A generic cell rate: each allowed call moves the key's arrival time on by span / limit; bursts up to ``limit``."""
    each = span // limit

    def step(tat, row):
        now = row[at]
        base = max(now, tat if tat is not None else now)
        if base - now > span - each:
            return tat, (row[key], row["seq"], False, 0, base - (span - each))
        new = base + each
        return new, (row[key], row["seq"], True, (span - (new - now)) // each, now)

    return fold(log, key, [at, "seq"], step, lambda: None, f"{key} long, seq long, ok boolean, tokens_left long, retry_at long")


def quota(log: DataFrame, key: str, at: str, spans: dict[int, int]) -> DataFrame:
    """Several fixed windows at once, all or none: span -> limit."""

    def step(s, row):
        s = {span: (0, 0) if row[at] // span != s.get(span, (-1, 0))[0] else s[span] for span in spans} if s else {span: (row[at] // span, 0) for span in spans}
        s = {span: (row[at] // span, n) if w == row[at] // span else (row[at] // span, 0) for span, (w, n) in s.items()}
        ok = all(n < spans[span] for span, (_, n) in s.items())
        if ok:
            s = {span: (w, n + 1) for span, (w, n) in s.items()}
        return s, (row[key], row["seq"], ok)

    return fold(log, key, [at, "seq"], step, dict, f"{key} long, seq long, ok boolean")


def once(log: DataFrame, key: str, at: str, ok: str) -> DataFrame:
    """The first success of each key; errors leave nothing."""
    return log.where(ok).groupBy(key).agg(F.min_by(F.struct("*"), at).alias("r")).select("r.*")


def job_states(jobs: DataFrame, now: int) -> DataFrame:
    """scheduled before its time, waiting after, running, failed when attempts are used up, done."""
    state = F.when(F.col("done"), "done").when(F.col("attempts") >= F.col("most"), "failed").when(F.col("running"), "running").when(F.col("at") > now, "scheduled").otherwise("waiting")
    return jobs.withColumn("state", state)


def backoff(first: int, attempt: str, most: int):
    """Doubling delays."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), F.col(attempt) - 1), F.lit(most)).cast("long")


def claim(jobs: DataFrame, group: str, order: list, per_group: int = 1) -> DataFrame:
    """The next waiting job of each group, in order of time."""
    w = Window.partitionBy(group).orderBy(*order)
    return jobs.where("state = 'waiting'").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_group).drop("_rn")


def schedule(ids: DataFrame, begin: str, every: int, end: int) -> DataFrame:
    """Runs of each repeating job: its phase is its own beginning; runs are generated, not stored."""
    return ids.select("*", F.explode(F.sequence(F.col(begin), F.lit(end), F.lit(every))).alias("run_at"))


def instruments(increments: DataFrame, keys: list[str], at: str, amount: str, every: int, most_sets: int) -> DataFrame:
    """Increments folded into samples each ``every``; label sets beyond ``most_sets`` become ``__overflow``."""
    sets = increments.groupBy(*keys).agg(F.min(at).alias("_first")).orderBy("_first", *keys).limit(most_sets).drop("_first").withColumn("_in", F.lit(True))
    tagged = increments.join(F.broadcast(sets), keys, "left")  # at most ``most_sets`` rows
    named = [F.when(F.col("_in"), F.col(k).cast("string")).otherwise("__overflow").alias(k) for k in keys]
    rows = tagged.select(*named, (F.col(at) - F.pmod(F.col(at), F.lit(every))).alias("at_us"), F.col(amount).alias("added"))
    return exact.sums(rows, [*keys, "at_us"], {"added": [F.col("added")]})


def job_log(log: DataFrame, attempts: int = 3, first: int = 1_000_000, most: int = 3_600_000_000, dedupe: int = 0) -> DataFrame:
    """What each call on a job did, and the job after it: (id, seq, answer, state, value, due, attempt).

    ``log``: (id, seq, at, op, value, due). Calls are add, set, update, cancel, start, done, error, snooze, fail; times
    are microseconds. ``done`` keeps an id taken for ``dedupe``; an error waits from ``first``, doubling up to ``most``.
    """

    def step(s, row):
        op, at, value, due = row["op"], row["at"], row["value"], row["due"]
        due = at if due is None or due != due else int(due)
        state = s["state"]
        if state == "done" and at >= s["done_at"] + dedupe:
            state = None
        fresh = {"state": "scheduled", "value": value, "due": due, "attempt": 0, "again": None, "done_at": 0}
        answer, new = False, s | {"state": state}
        if op == "add" and state is None:
            answer, new = True, fresh
        elif op == "set":
            answer, new = True, s | {"again": (value, due)} if state == "running" else fresh
        elif op == "update" and state == "scheduled":
            answer, new = True, s | {"value": value, "due": s["due"] if row["due"] is None or row["due"] != row["due"] else due}
        elif op == "cancel" and state in ("scheduled", "failed"):
            answer, new = True, s | {"state": None}
        elif op == "cancel" and state == "running":
            answer, new = True, s | {"again": None}  # its handler is told to stop
        elif op == "start" and state == "scheduled" and s["due"] <= at:
            answer, new = True, s | {"state": "running", "attempt": s["attempt"] + 1}
        elif state == "running" and op in ("done", "error", "snooze", "fail"):
            answer = True
            if s["again"] and op in ("done", "error"):
                new = fresh | {"value": s["again"][0], "due": max(at, s["again"][1])}
            elif op == "done":
                new = s | {"state": "done", "done_at": at}
            elif op == "snooze":
                new = s | {"state": "scheduled", "due": due, "attempt": s["attempt"] - 1}
            elif op == "fail" or s["attempt"] >= attempts:
                new = s | {"state": "failed"}
            else:
                new = s | {"state": "scheduled", "due": at + min(first * 2 ** (s["attempt"] - 1), most)}
        return new, (row["id"], row["seq"], answer, new["state"], new["value"], new["due"], new["attempt"])

    begin = {"state": None, "value": None, "due": 0, "attempt": 0, "again": None, "done_at": 0}
    return fold(log, "id", ["at", "seq"], step, lambda: begin, "id long, seq long, answer boolean, state string, value string, due long, attempt long")


def debounce(calls: DataFrame, key: str, at: str, delay: int) -> DataFrame:
    """Runs of ``set`` with a delay: each call moves the run on, so the last of a burst runs, with its own value."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, "seq"))
    return calls.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") >= F.col(at) + delay)).withColumn("run_at", F.col(at) + delay).drop("_next")


def throttle(calls: DataFrame, key: str, at: str, delay: int) -> DataFrame:
    """Runs of ``add`` with a delay: the first call stands, calls until it runs add nothing."""

    def step(begin, row):
        if begin is None or row[at] >= begin + delay:
            return row[at], (row[key], row["seq"], True, row[at] + delay)
        return begin, (row[key], row["seq"], False, begin + delay)

    return fold(calls, key, [at, "seq"], step, lambda: None, f"{key} long, seq long, added boolean, run_at long")
