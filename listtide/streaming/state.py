"""State kept per key in a running query: the last change stamp of a feed entry, and failed attempts.

State lives in the query's checkpoint, so a restarted query goes on where it stopped. It expires with the watermark: a key that was
silent for the given time is forgotten. Keys are dealt out to `groups` groups, each one call and one state, as a call costs several
milliseconds whatever it does; a group's state is a column per field with one entry a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.actions import MAX_FAILED_ATTEMPTS
from ..sources.versions import VersionedTable, held

#: State of a key and its rows in no order -> its new state, and its result for the output.
Step = Callable[[tuple | None, list[tuple]], tuple]
GROUPS = 1024


def _stateful(rows: DataFrame, read: tuple[str, ...], step: Step, give: Callable[[list], pd.DataFrame], fields: dict[str, str], out: str,
              mode: str, delay: str, expire_days: int, groups: int) -> DataFrame:
    """`step` for every key (uuid) that has rows; `give` makes the group's output of them. A key none of whose rows is younger than the
    watermark less `expire_days` loses its state, unless it has rows in this very batch."""
    expire_ms = expire_days * 86_400_000
    ts = "ts"

    def run(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = {}
        if state.exists:
            uuids, until, *values = state.get
            known = {k: (u, tuple(v)) for k, u, *v in zip(uuids, until, *values)}
        mine: dict[str, list[tuple]] = {}
        newest: dict[str, int] = {}
        if not state.hasTimedOut:
            for part in parts:
                seen = part[ts].to_numpy("datetime64[ms]").astype("int64").tolist()
                for uuid, at, *row in zip(part["uuid"].tolist(), seen, *[part[c].tolist() for c in read]):
                    mine.setdefault(uuid, []).append(tuple(row))
                    newest[uuid] = max(at, newest.get(uuid, 0))
        done = []
        for uuid, own in mine.items():
            value, result = step(known[uuid][1] if uuid in known else None, own)
            known[uuid] = (max(newest[uuid], now) + expire_ms, value)
            done.append((uuid, result))
        known = {k: v for k, v in known.items() if k in mine or v[0] >= now}
        if known:
            state.update((list(known), [v[0] for v in known.values()], *[[v[1][i] for v in known.values()] for i in range(len(fields))]))
            state.setTimeoutTimestamp(max(min(v[0] for v in known.values()), now + 1))
        elif state.exists:
            state.remove()
        if done:
            yield give(done)

    keyed = rows.withWatermark(ts, delay).select("uuid", ts, *[c for c in read if c != ts], F.pmod(F.xxhash64("uuid"), F.lit(groups)).alias("_group"))
    kept = ", ".join(["uuid array<string>", "until array<long>", *[f"{c} array<{t}>" for c, t in fields.items()]])
    return keyed.groupBy("_group").applyInPandasWithState(run, out, kept, mode, GroupStateTimeout.EventTimeTimeout)


def changed_entries(entries: DataFrame, delay: str = "1 hour", expire_days: int = 30, groups: int = GROUPS) -> DataFrame:
    """A stream of feed entries (uuid, seq, idx, stamp, ts) without those whose stamp is the one last passed on for their key.

    Rows of a key count in feed order within a batch. A null stamp never equals another, so such entries always pass."""
    def step(state: tuple | None, rows: list[tuple]) -> tuple:
        last = state[0] if state else None
        before, fresh = last, []
        for seq, idx, stamp in sorted(rows, key=lambda r: tuple((pd.isna(v), v) for v in r[:2])):
            stamp = None if pd.isna(stamp) else stamp
            if stamp is None or stamp != before:
                fresh.append((seq, idx, stamp))
            before = stamp
            last = last if stamp is None else stamp
        return (last,), fresh

    def give(done: list) -> pd.DataFrame:
        out = [(uuid, *row) for uuid, fresh in done for row in fresh]
        return pd.DataFrame(out, columns=["uuid", "seq", "idx", "stamp"])

    kinds = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    out = ", ".join(f"{c} {kinds[c]}" for c in ("uuid", "seq", "idx", "stamp"))
    return _stateful(entries, ("seq", "idx", "stamp"), step, give, {"stamp": kinds["stamp"]}, out, "append", delay, expire_days, groups)


def attempt_counts(attempts: DataFrame, limit: int = MAX_FAILED_ATTEMPTS, delay: str = "1 hour", expire_days: int = 30, groups: int = GROUPS) -> DataFrame:
    """A stream of attempts (uuid, ts, outcome 'ok' or 'failed') as updates (uuid, failures, give_up): failures since the last success.

    The state of a key is the time of its last success and the times of the failures behind it, so attempts may come in any order."""
    def step(state: tuple | None, rows: list[tuple]) -> tuple:
        ok, failed = state if state else (None, [])
        ok = max([*[t for t, how in rows if how == "ok"], *([ok] if ok is not None else [])], default=None)
        failed = [t for t in [*failed, *[t for t, how in rows if how == "failed"]] if ok is None or t > ok]
        return (ok, failed), len(failed)

    def give(done: list) -> pd.DataFrame:
        counts = [n for _, n in done]
        return pd.DataFrame({"uuid": [k for k, _ in done], "failures": counts, "give_up": [n >= limit for n in counts]})

    timed = attempts.withColumn("micros", F.unix_micros("ts"))
    return _stateful(timed, ("micros", "outcome"), step, give, {"ok": "long", "failed": "array<long>"}, "uuid string, failures long, give_up boolean",
                     "update", delay, expire_days, groups)


def run_attempts(attempts: DataFrame, checkpoint: str, table: VersionedTable, **options) -> None:
    """Bring `table` (uuid, failures, give_up) up to date with all attempts not yet read, then stop."""
    def newer(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        if stored is None:
            return batch
        return batch.unionByName(stored.join(batch.select("uuid"), "uuid", "left_anti"))

    def each(batch: DataFrame, batch_id: int) -> None:
        with held(batch):
            if not batch.isEmpty():
                table.update(batch, newer)

    attempt_counts(attempts, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        each).trigger(availableNow=True).start().awaitTermination()


def run_changed(entries: DataFrame, checkpoint: str, path: str, **options) -> None:
    """Append the entries that changed to the files at `path` until all landed pages are read."""
    changed_entries(entries, **options).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option(
        "path", path).trigger(availableNow=True).start().awaitTermination()


def placed_in_time(entries: DataFrame, seconds: int = 3600) -> DataFrame:
    """Entries with an event time from their page number, for feeds that number pages by time."""
    return entries.withColumn("ts", F.timestamp_seconds(F.col("seq") * seconds))
