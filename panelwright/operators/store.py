"""Accounts as append-only tables: the latest row of a key is its state, and audits are hash chains.

Every reader is scoped to a workspace. Nothing is updated in place, so a writer is one append.
"""

from __future__ import annotations

import hashlib
import json
import secrets
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "users": "id string, idp_subject string, email_bidx string, email_enc binary, created_at timestamp, updated_at timestamp",
    "workspaces": "id string, name string, stripe_customer string, created_at timestamp, updated_at timestamp",
    "memberships": "workspace_id string, user_id string, role string, created_at timestamp, updated_at timestamp",
    "api_keys": "id string, workspace_id string, name string, secret_sha string, created_at timestamp, revoked_at timestamp, last_used_at timestamp, updated_at timestamp",
    "runs": "id string, workspace_id string, user_id string, request binary, summary binary, created_at timestamp",
    "audit_log": "id long, workspace_id string, actor string, action string, body string, hash string, created_at timestamp",
}
ROLES = ("VIEWER", "MEMBER", "ADMIN", "OWNER")
GENESIS = "0" * 64


def latest(table: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """The last written row of each key: what an upsert leaves."""
    row = F.struct(*[F.col(c) for c in table.columns])
    return table.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, F.struct(order, row)).alias("r")).select("r.*")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def list_runs(runs: DataFrame, workspace: str, limit: int = 50) -> DataFrame:
    """The newest runs of a workspace (a top-k)."""
    return runs.where(F.col("workspace_id") == workspace).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def list_audit(audit: DataFrame, workspace: str, limit: int = 100) -> DataFrame:
    return audit.where(F.col("workspace_id") == workspace).orderBy(F.desc("id")).limit(limit)


def user_memberships(memberships: DataFrame, user: str) -> DataFrame:
    return latest(memberships, ["workspace_id", "user_id"]).where(F.col("user_id") == user).orderBy("created_at")


def role_rank(role: Column | str) -> Column:
    c = F.col(role) if isinstance(role, str) else role
    return F.array_position(F.array(*map(F.lit, ROLES)), c)


def allowed(requests: DataFrame, memberships: DataFrame, least: str = "MEMBER") -> DataFrame:
    """Requests (workspace_id, user_id) whose user holds at least a role there; others are refused by absence."""
    enough = latest(memberships, ["workspace_id", "user_id"]).where(role_rank("role") >= ROLES.index(least) + 1)
    return requests.join(enough.select("workspace_id", "user_id"), ["workspace_id", "user_id"], "left_semi")


def new_key(prefix: str = "pk") -> tuple[str, str]:
    """(secret shown once, its SHA-256)."""
    secret = f"{prefix}_{secrets.token_urlsafe(32)}"
    return secret, hashlib.sha256(secret.encode()).hexdigest()


def active_keys(api_keys: DataFrame) -> DataFrame:
    return latest(api_keys, ["id"]).where("revoked_at is null")


def resolve_keys(presented: DataFrame, api_keys: DataFrame) -> DataFrame:
    """Presented secrets (secret) with the workspace of their active key; unknown ones are dropped."""
    hashed = presented.withColumn("secret_sha", F.sha2("secret", 256)).drop("secret")
    return hashed.join(active_keys(api_keys).select("secret_sha", "workspace_id", F.col("id").alias("key_id")), "secret_sha")


def principals(presented: DataFrame, api_keys: DataFrame, memberships: DataFrame) -> DataFrame:
    """(presented columns but the secret, user_id, workspace_id, role, denied): who stands behind each presented secret, a row each.

    ``denied`` says why nobody does: no such key, the key was revoked, or its creator is no member any more; it is null for a
    caller that may go on. Keys have key_hash, workspace_id, created_by, revoked_at; hashes are compared, secrets never stored.
    """
    keys = latest(api_keys, ["id"]).select("key_hash", "workspace_id", F.col("created_by").alias("user_id"), F.col("revoked_at").isNotNull().alias("revoked"))
    roles = latest(memberships, ["workspace_id", "user_id"]).select("workspace_id", "user_id", "role")
    asked = presented.withColumn("key_hash", F.sha2("secret", 256)).drop("secret")
    found = asked.join(keys, "key_hash", "left").join(roles, ["workspace_id", "user_id"], "left").drop("key_hash")
    denied = F.when(F.col("user_id").isNull(), "unknown key").when(F.col("revoked"), "revoked key").when(F.col("role").isNull(), "no member")
    known = lambda c: F.when(F.col("denied").isNull(), F.col(c)).alias(c)
    return found.withColumn("denied", denied).select(*[c for c in asked.columns if c != "key_hash"], known("user_id"), known("workspace_id"), known("role"), "denied")


def blind_index(value: Column | str, key: str) -> Column:
    """HMAC-SHA256 of the lower-cased value by built-in functions, for equality search over encrypted values."""
    c = F.lower(F.trim(F.col(value) if isinstance(value, str) else value))
    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    block = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def encrypt(value: Column | str, key: bytes) -> Column:
    """AES-GCM with a key of 16, 24 or 32 bytes."""
    return F.aes_encrypt(F.col(value) if isinstance(value, str) else value, F.lit(key), F.lit("GCM"))


def decrypt(value: Column | str, key: bytes) -> Column:
    return F.aes_decrypt(F.col(value) if isinstance(value, str) else value, F.lit(key), F.lit("GCM")).cast("string")


def chain(entries: DataFrame, keys: list[str], order: list[str], body: Column, after: DataFrame | None = None) -> DataFrame:
    """(keys, order, body, hash): each entry's hash covers the one before, per key.

    A chain is sequential by nature: a key's entries pass one task in order, which holds no more than the last hash.
    ``after`` (keys, hash), the last stored hash of a key, continues stored chains.
    """
    rows = entries.select(*keys, *order, body.alias("body"))
    start = F.lit(GENESIS) if after is None else F.coalesce("hash", F.lit(GENESIS))
    rows = rows if after is None else rows.join(after.select(*keys, "hash"), keys, "left")
    rows = rows.select(*keys, *order, "body", start.alias("hash")).repartition(*keys).sortWithinPartitions(*keys, *order)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ""
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for *key, text, first in zip(*columns[: len(keys)], columns[-2], columns[-1], strict=True):
                before = held if last == key else first
                last = key
                held = hashlib.sha256((before + (text or "")).encode()).hexdigest()
                out.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], batch.schema.names)

    return rows.mapInArrow(fold, rows.schema)


def verify_chain(chained: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, n, valid): every stored hash follows from the one stored before it; a hash or body that is gone follows from nothing."""
    before = F.coalesce(F.lag("hash", 1).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(GENESIS))
    follows = F.sha2(F.concat(before, F.col("body")), 256) == F.col("hash")
    checked = chained.withColumn("_ok", F.coalesce(follows, F.lit(False)))
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bool_and("_ok").alias("valid"))


def audited(actor: str, action: str, workspace: str, detail: dict | None = None) -> str:
    """The canonical body of an audit entry: JSON without blanks, sorted by key."""
    return json.dumps({"action": action, "actor": actor, "detail": detail or {}, "workspace_id": workspace}, sort_keys=True, separators=(",", ":"))


def create_workspace(workspace: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append to ``workspaces``, the owner's rows to append to ``memberships``)."""
    member = workspace.select(F.col("id").alias("workspace_id"), F.lit(owner).alias("user_id"), F.lit("OWNER").alias("role"), "created_at", "updated_at")
    return workspace, member


def revoke_keys(api_keys: DataFrame, ids: list[str], at: Column) -> DataFrame:
    """Rows to append that revoke active keys."""
    return active_keys(api_keys).where(F.col("id").isin(ids)).withColumn("revoked_at", at).withColumn("updated_at", at)


def touch_keys(resolved: DataFrame, api_keys: DataFrame, at: Column) -> DataFrame:
    """Rows to append that note when the keys in ``resolved`` (key_id) were last used."""
    used = resolved.select(F.col("key_id").alias("id")).distinct()
    return active_keys(api_keys).join(used, "id", "left_semi").withColumn("last_used_at", at).withColumn("updated_at", at)


def by_key(table: DataFrame, keys: list[str], order: str = "updated_at", **values) -> DataFrame:
    """The current row with these values of its columns, if there is one (a point lookup).

    Values of key columns filter before the latest rows are found, so they reach the scan; other columns change over
    time and are compared in the latest rows, for which only keys that ever had the value are looked at.
    """
    of_keys = {c: v for c, v in values.items() if c in keys}
    others = {c: v for c, v in values.items() if c not in keys}
    same = lambda found: reduce(DataFrame.where, [F.col(c).eqNullSafe(F.lit(v)) for c, v in found.items()], table)
    rows = same(of_keys)
    if others and not of_keys:
        rows = rows.join(same(others).select(*keys).distinct(), keys, "left_semi")
    return reduce(DataFrame.where, [F.col(c).eqNullSafe(F.lit(v)) for c, v in others.items()], latest(rows, keys, order))


def tombstone(workspace: str, counts: DataFrame) -> DataFrame:
    """The one audit entry that an erasure leaves: how many rows of which table went."""
    kept = counts.agg(F.to_json(F.array_sort(F.collect_list(F.struct("table", "n")))).alias("detail"))  # a row a table
    return kept.select(F.lit("system").alias("workspace_id"), F.lit("erase_workspace").alias("action"), F.concat_ws("|", F.sha2(F.lit(workspace), 256), "detail").alias("body"))


def export_workspace(workspace: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a workspace's members, keys (no secrets), runs and audit entries as JSON arrays."""
    of = lambda t: tables[t].where(F.col("workspace_id") == workspace)
    members = latest(of("memberships"), ["workspace_id", "user_id"]).join(latest(tables["users"], ["id"]).select(F.col("id").alias("user_id"), "email_enc"), "user_id", "left")
    keys = latest(of("api_keys"), ["id"]).drop("secret_sha")
    parts = {"members": members, "api_keys": keys, "runs": of("runs"), "audit_log": of("audit_log")}
    out = None
    for name, rows in parts.items():
        packed = rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias(name))
        out = packed if out is None else out.crossJoin(packed)
    return out.withColumn("workspace_id", F.lit(workspace))


def erase_workspace(workspace: str, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the workspace, counts of what went): the counts go into the audit of the system."""
    kept, counts = {}, None
    for name, rows in tables.items():
        column = "id" if name == "workspaces" else "workspace_id"
        if column not in rows.columns:
            kept[name] = rows
            continue
        kept[name] = rows.where(~F.col(column).eqNullSafe(F.lit(workspace)))
        gone = rows.where(F.col(column) == workspace).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        counts = gone if counts is None else counts.unionByName(gone)
    return kept, counts
