"""The change-request state machine, in batch and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.operators.relational import top1


def apply_commands(markup: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """markup(id, status, version), commands(id, seq, target, expected, reason) -> (markup after, events).

    Only pending may change, to applied or rejected; a rejection needs a reason; an expected version must match. At most one
    command can succeed for each markup, so the first valid one decides and no ordered fold is needed.
    """
    rows = commands.join(markup.select("id", "status", "version"), "id").where("status = 'pending'")
    valid = F.col("target").isin("applied", "rejected") & (F.coalesce("expected", "version") == F.col("version")) & ((F.col("target") != "rejected") | (F.trim(F.coalesce("reason", F.lit(""))) != ""))
    won = top1(rows.where(valid).select("id", "seq", "target", "reason"), ["id"], [F.col("seq")])
    after = markup.join(won.select("id", "target"), "id", "left")
    after = after.select("id", F.coalesce("target", "status").alias("status"), (F.col("version") + F.col("target").isNotNull().cast("int")).alias("version"))
    return after, won.select("id", F.lit("pending").alias("from_status"), F.col("target").alias("to_status"), "seq")


def outcomes(markup: DataFrame, commands: DataFrame) -> DataFrame:
    """(id, seq, outcome) of every command on a known markup: invalid, same, conflict, stale or done.

    The state that a command meets follows from the one that succeeded, if that was earlier; the reason is looked at first,
    an equal state before the version.
    """
    won = apply_commands(markup, commands)[1].select("id", F.col("to_status").alias("won"), F.col("seq").alias("won_seq"))
    rows = commands.join(markup.select("id", "status", "version"), "id").join(won, "id", "left")
    later = F.coalesce(F.col("won_seq") < F.col("seq"), F.lit(False))
    state, version = F.when(later, F.col("won")).otherwise(F.col("status")), F.col("version") + later.cast("int")
    known = F.col("target").isin("applied", "rejected")
    outcome = (
        F.when((F.col("target") == "rejected") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "invalid")
        .when(F.col("target") == state, "same")
        .when((state != "pending") | ~known, "conflict")
        .when(F.coalesce("expected", version) != version, "stale")
        .otherwise("done")
    )
    return rows.select("id", "seq", outcome.alias("outcome"))


def decide(status: str, version: int, target: str, expected: int | None, reason: str | None) -> str:
    """What a command meets, in the order of the checks."""
    if target == "rejected" and not (reason or "").strip():
        return "invalid"
    if target == status:
        return "same"
    if status != "pending" or target not in ("applied", "rejected"):
        return "conflict"
    return "done" if expected is None or expected == version else "stale"


def transitions(commands: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream of commands (id, seq, at timestamp, target, expected, reason, actor) -> (id, seq, outcome, from_status, status, version,
    actor, at, reject_reason): an event for each command, in order of seq within a batch.

    Each request's status and version are state, from pending, version 1, so a command is held against all that came before it, however
    long ago. State is a few bytes a request and stays, as the requests do; lateness only bounds out-of-order output. On a change the
    version grows, the actor and time are those of the command, and a reason stays only with a rejection.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        status, version = state.get if state.exists else ("pending", 1)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            expected = None if pd.isna(r.expected) else int(r.expected)
            reason = None if pd.isna(r.reason) else r.reason
            outcome, before = decide(status, version, r.target, expected, reason), status
            if outcome == "done":
                status, version = r.target, version + 1
            out.append((key[0], r.seq, outcome, before, status, version, r.actor, r.at, reason.strip() if outcome == "done" and r.target == "rejected" else None))
        state.update((status, version))
        yield pd.DataFrame(out, columns=["id", "seq", "outcome", "from_status", "status", "version", "actor", "at", "reject_reason"])

    kind = commands.schema["id"].dataType.simpleString()
    schema = f"id {kind}, seq long, outcome string, from_status string, status string, version int, actor string, at timestamp, reject_reason string"
    rows = commands.withWatermark("at", lateness).select("id", F.col("seq").cast("long").alias("seq"), "at", "target", F.col("expected").cast("int").alias("expected"), "reason", "actor")
    return rows.groupBy("id").applyInPandasWithState(step, schema, "status string, version int", "append", GroupStateTimeout.NoTimeout)


def deletable(markups: DataFrame, events: DataFrame, ids: DataFrame, superadmin: bool = False) -> tuple[DataFrame, DataFrame]:
    """(markups, events) that stay when the requests with these ids are deleted: applied ones can't be, but by a superadmin; a deleted
    request's events go with it."""
    gone = markups.join(ids.select("id").distinct(), "id", "left_semi")
    gone = gone if superadmin else gone.where("status <> 'applied'")
    return markups.join(gone.select("id"), "id", "left_anti"), events.join(gone.select("id"), "id", "left_anti")
