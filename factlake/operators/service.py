"""Service rows with query content: replays, reservations, receipts, returns, backups, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.staging import small


def replays(receipts: DataFrame, commands: DataFrame) -> DataFrame:
    """(command_id, outcome): ``new`` without a receipt, ``replay`` if actor,
    fingerprint and resource are those of the receipt, else ``conflict``."""
    fields = ("actor", "fingerprint", "resource")
    old = receipts.select("command_id", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__known"))
    rows = commands.join(old, "command_id", "left")
    same = F.lit(True)
    for c in fields:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.select("command_id", F.when(F.col("__known").isNull(), "new").when(same, "replay").otherwise("conflict").alias("outcome"))


def reaped(reservations: DataFrame, now: int, limit: int, grace: int) -> tuple[DataFrame, DataFrame]:
    """(left, garbage): the ``limit`` oldest expired reservations go, and their
    generations may be collected a grace period after they ran out."""
    gone = reservations.where(F.col("expires_at") <= now).orderBy("expires_at", "id").limit(limit)
    left = reservations.join(small(gone.select("id")), "id", "left_anti")
    return left, gone.select("generation", (F.col("expires_at") + grace).alias("collect_at"))


def pruned(first: DataFrame, second: DataFrame, now: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Receipts of two tables (id, retain_until) that stay: one limit for both, the
    first table's oldest before the second's."""
    old = [df.where(F.col("retain_until") <= now).orderBy("retain_until", "id") for df in (first, second)]
    gone = old[0].limit(limit)
    rest = max(0, limit - gone.count())
    return first.join(small(gone.select("id")), "id", "left_anti"), second.join(small(old[1].limit(rest).select("id")), "id", "left_anti")


def returned(handoffs: DataFrame, facts: DataFrame, returns: DataFrame) -> DataFrame:
    """(id, accepted, status): a return (id, fact_id, actor, claim_id, outcome) counts if
    its evidence is a fact of the handoff's session, namespace and receiver, the
    actor is the receiver and the claim is the active one of an accepted handoff.
    Success completes it, failure leaves it accepted; a repeat of the same return is accepted again."""
    evidence = facts.select(F.col("id").alias("fact_id"), F.col("session").alias("f_session"), F.col("source_id").alias("f_ns"), F.col("actor").alias("f_actor"))
    rows = handoffs.join(returns.select("id", "fact_id", "actor", F.col("claim_id").alias("r_claim"), F.col("outcome").alias("r_outcome")), "id")
    rows = rows.join(evidence, "fact_id", "left")
    backed = (F.col("f_session") == F.col("session")) & F.col("f_ns").eqNullSafe(F.col("source_id")) & (F.col("f_actor") == F.col("receiver"))
    mine = (F.col("actor") == F.col("receiver")) & F.col("claim_id").eqNullSafe(F.col("r_claim"))
    again = (F.col("status") == "completed") & (F.col("result_fact_id") == F.col("fact_id")) & (F.col("outcome") == F.col("r_outcome"))
    ok = F.coalesce(backed & mine & ((F.col("status") == "accepted") | again), F.lit(False))
    status = F.when(ok & (F.col("r_outcome") == "succeeded"), "completed").otherwise(F.col("status"))
    return rows.select("id", ok.alias("accepted"), status.alias("status"))


def lanes(handoffs: DataFrame, now: int, stale_after: int) -> DataFrame:
    """(id, lane, next_action, stale) by status, outcome and time since the last activity."""
    last = F.coalesce("returned_at", "heartbeat_at", "accepted_at", "created_at")
    stale = (F.col("status") != "completed") & (now - last >= stale_after)
    failed = F.coalesce(F.col("outcome") == "failed", F.lit(False))
    pair = lambda lane, action: F.struct(F.lit(lane).alias("lane"), F.lit(action).alias("next_action"))
    at = (
        F.when((F.col("status") == "pending") & stale, pair("attention", "inspect_or_run")).when(F.col("status") == "pending", pair("ready", "accept_or_run"))
        .when((F.col("status") == "accepted") & failed, pair("attention", "orchestrator_retry_or_close"))
        .when((F.col("status") == "accepted") & stale, pair("attention", "check_worker_liveness"))
        .when(F.col("status") == "accepted", pair("in_progress", "wait_for_result")).otherwise(pair("returned", "validate_result"))
    )
    return handoffs.select("id", at.alias("x"), stale.alias("stale")).select("id", "x.lane", "x.next_action", "stale")


def stale_leases(leases: DataFrame, now: int) -> DataFrame:
    """Leases that have run out by ``now``; one without an end never does."""
    return leases.where(F.col("expires_at") <= now)


def reconciled(hot: DataFrame, cold: DataFrame, entities: DataFrame, later: DataFrame) -> dict[str, DataFrame]:
    """A backup from snapshots taken one after the other: facts that are cold leave the
    hot table, entities that only cold facts name come from the later snapshot, and
    ``unresolved`` lists names that neither has, which makes a backup fail."""
    named = cold.select("entity").distinct().withColumnRenamed("entity", "id")
    missing = named.join(entities.select("id"), "id", "left_anti")
    return {
        "hot": hot.join(cold.select("id"), "id", "left_anti"), "entities": entities.unionByName(later.join(missing, "id", "left_semi")),
        "unresolved": missing.join(later.select("id"), "id", "left_anti"),
    }


def segment_faults(segments: DataFrame) -> DataFrame:
    """(id, fault) of segments (id, payload, bytes, sha256) whose size or digest is not that of the payload."""
    size, digest = F.octet_length("payload") != F.col("bytes"), F.sha2("payload", 256) != F.col("sha256")
    return segments.select("id", F.when(size, "size").when(digest, "digest").alias("fault")).where("fault IS NOT NULL")
