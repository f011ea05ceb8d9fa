"""Account operations that leave all of their rows and one audit entry, or nothing.

Tables are append-only folders with a sub-folder for each batch of rows. A batch counts once the commit log has its row,
one row an operation, whose version orders all operations; readers join the log, so rows of a half-written batch never
show, and the latest version of a key is its state. A writer reads the version it builds on, stages its rows (a repeated
attempt overwrites its own), and then adds the next version to the log, which fails if another writer was first: it then
looks at the new state and tries again. An operation repeated under its batch's name finds it committed and does nothing.

Erasing a workspace writes anew only batches that hold its rows: their other rows go into the erasing batch, and its
commit says which batches it takes the place of. All other files stay as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Columns and key of each table.
TABLES = {
    "users": ("id string, idp_subject string, email_bidx string, email_enc binary, created_at timestamp, last_seen_at timestamp", ["id"]),
    "workspaces": ("id string, name string, owner_user_id string, plan string, stripe_customer_id string, created_at timestamp", ["id"]),
    "memberships": ("workspace_id string, user_id string, role string, created_at timestamp", ["workspace_id", "user_id"]),
    "api_keys": ("id string, workspace_id string, created_by string, name string, prefix string, key_hash string, created_at timestamp, last_used_at timestamp, revoked_at timestamp", ["id"]),
    "runs": ("id string, workspace_id string, user_id string, kind string, request_enc binary, verdict string, summary_enc binary, created_at timestamp", ["id"]),
    "audit_log": ("id long, workspace_id string, actor_user_id string, action string, target string, detail string, body string, hash string", ["workspace_id", "id"]),
}
KEPT = "kept_version long"
COMMITS = "version long, batch string, removed array<struct<of:string,batch:string>>"
#: Columns by which rows are looked up, which get Bloom filters.
LOOKED_UP = ("id", "idp_subject", "email_bidx", "key_hash", "workspace_id", "user_id")
ATTEMPTS = 5


class Denied(PermissionError):
    """The caller lacks the role that the operation needs."""


class Conflict(RuntimeError):
    """Other writers were first ``ATTEMPTS`` times."""


@dataclass(frozen=True)
class Principal:
    user_id: str
    workspace_id: str
    role: str
    via: str = "session"


def committed(rows: DataFrame, commits: DataFrame, table: str) -> DataFrame:
    """``rows`` (with batch and kept_version) of committed batches that no later commit took the place of, with their version.

    Rows that an erasure wrote anew kept the version they had; others have their commit's.
    """
    removed = commits.select(F.explode("removed").alias("r")).where(F.col("r.of") == table).select("r.batch").distinct()
    live = commits.select("batch", F.col("version").alias("commit")).join(removed, "batch", "left_anti")
    return rows.join(live, "batch").withColumn("version", F.coalesce("kept_version", "commit")).drop("kept_version", "commit")


class Accounts:
    """The tables under ``root``; ``key`` (16, 24 or 32 bytes) encrypts and ``index_key`` blinds what is looked up by equality."""

    def __init__(self, spark: SparkSession, root: str, key: bytes, index_key: str):
        self.spark, self.root, self.key, self.index_key = spark, root, key, index_key

    # Reading.

    def commits(self) -> DataFrame:
        return self._folder("commits", COMMITS)  # a row an operation

    def _folder(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*[f.split(" ")[0] for f in schema.split(", ")])

    def rows(self, table: str) -> DataFrame:
        """All committed rows of a table, with batch and version."""
        return committed(self._folder(table, f"{TABLES[table][0]}, {KEPT}, batch string"), self.commits(), table)

    def state(self, table: str, **values: str) -> DataFrame:
        """The latest row of each key; values of key columns filter the scan, those of others the latest rows."""
        return store.by_key(self.rows(table), TABLES[table][1], order="version", **values)

    def one(self, table: str, **values: str) -> dict | None:
        found = self.state(table, **values).head(1)
        return found[0].asDict() if found else None

    # Writing.

    def commit(self, make: Callable[[], tuple[dict[str, DataFrame], dict] | None], batch: str | None = None, removed: Callable[[], list[tuple[str, str]]] = list) -> int | None:
        """Stage what ``make`` gives from the present state, (rows by table, audit entry), and add it to the log.

        None where ``make`` finds nothing to do. The version is that of the batch, also where it had been committed before.
        """
        batch = batch or uuid.uuid4().hex
        for _ in range(ATTEMPTS):
            log = self.commits()
            known = log.where(F.col("batch") == batch).head(1)
            if known:
                return known[0]["version"]
            version = (log.agg(F.max("version")).first()[0] or 0) + 1
            made = make()
            if made is None:
                return None
            changes, entry = made
            gone = removed()
            for table, rows in (changes | {"audit_log": self._audit_row(changes.get("audit_log"), **entry)}).items():
                self._stage(rows, table, batch)
            row = self.spark.createDataFrame([(version, batch, gone)], COMMITS)
            try:
                row.coalesce(1).write.mode("error").parquet(f"{self.root}/commits/at={version}")
            except AnalysisException:  # another writer has this version
                continue
            return version
        raise Conflict(f"batch {batch} met other writers {ATTEMPTS} times")

    def _stage(self, rows: DataFrame, table: str, batch: str) -> None:
        columns = [f.split(" ")[0] for f in TABLES[table][0].split(", ")]
        kept = F.col("kept_version") if "kept_version" in rows.columns else F.lit(None).cast("long")
        writer = rows.select(*columns, kept.alias("kept_version")).write.mode("overwrite")
        for c in set(columns) & set(LOOKED_UP):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{table}/batch={batch}")

    def _audit_row(self, others: DataFrame | None, workspace: str | None, actor: str | None, action: str, target: str | None = None, detail: dict | None = None) -> DataFrame:
        """The next entry of the workspace's chain (None: the system's); ``others`` are kept entries of other chains."""
        chain = self.rows("audit_log").where(F.col("workspace_id").eqNullSafe(F.lit(workspace)))
        last = chain.agg(F.max_by("hash", "id").alias("hash"), F.max("id").alias("id")).first()
        body = json.dumps(
            {"action": action, "actor": actor, "at": datetime.datetime.now(datetime.UTC).isoformat(), "detail": detail or {}, "target": target, "workspace_id": workspace},
            sort_keys=True, separators=(",", ":"),
        )
        hash_ = hashlib.sha256(((last["hash"] or store.GENESIS) + body).encode()).hexdigest()
        row = self._frame("audit_log", [((last["id"] or 0) + 1, workspace, actor, action, target, json.dumps(detail or {}, sort_keys=True), body, hash_)])
        return row if others is None else others.select(*row.columns, "kept_version").unionByName(row, allowMissingColumns=True)

    def _frame(self, table: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, TABLES[table][0])

    def _blind(self, value: str) -> str:
        return self.spark.range(1).select(store.blind_index(F.lit(value), self.index_key)).first()[0]

    def _sealed(self, value: str):
        return self.spark.range(1).select(store.encrypt(F.lit(value), self.key)).first()[0]

    # Operations.

    def require(self, who: Principal, least: str) -> None:
        """The caller's present role in the workspace, not that of the login, decides."""
        member = self.one("memberships", workspace_id=who.workspace_id, user_id=who.user_id)
        if not member or store.ROLES.index(member["role"]) < store.ROLES.index(least):
            raise Denied(f"{who.user_id} needs {least} in {who.workspace_id}")

    def login(self, idp_subject: str, email: str, workspace_name: str | None = None, batch: str | None = None) -> Principal:
        """From verified claims: the user, on a first login with a workspace that they own."""
        found: list[Principal] = []

        def make():
            now = datetime.datetime.now()
            known = self.one("users", idp_subject=idp_subject)
            user = known["id"] if known else uuid.uuid4().hex
            changes = {"users": self._frame("users", [(user, idp_subject, self._blind(email), self._sealed(email), known["created_at"] if known else now, now)])}
            members = self.state("memberships", user_id=user)
            owned = members.orderBy(F.desc(F.col("role") == "OWNER"), "created_at", "workspace_id").head(1) if known else []
            if owned:
                workspace, role = owned[0]["workspace_id"], owned[0]["role"]
            else:
                workspace, role = uuid.uuid4().hex, "OWNER"
                changes["workspaces"] = self._frame("workspaces", [(workspace, workspace_name or f"{email}'s workspace", user, "free", None, now)])
                changes["memberships"] = self._frame("memberships", [(workspace, user, role, now)])
            found[:] = [Principal(user, workspace, role)]
            return changes, {"workspace": workspace, "actor": user, "action": "login", "detail": {"method": "identity"}}

        self.commit(make, batch)
        return found[0] if found else self._principal_of(idp_subject)

    def _principal_of(self, idp_subject: str) -> Principal:
        user = self.one("users", idp_subject=idp_subject)["id"]
        row = self.state("memberships", user_id=user).orderBy(F.desc(F.col("role") == "OWNER"), "created_at", "workspace_id").head(1)[0]
        return Principal(user, row["workspace_id"], row["role"])

    def add_member(self, who: Principal, user_id: str, role: str, batch: str | None = None) -> None:
        if role not in store.ROLES:
            raise ValueError(f"role must be one of {store.ROLES}")
        self.require(who, "ADMIN")
        row = (who.workspace_id, user_id, role, datetime.datetime.now())
        self.commit(lambda: ({"memberships": self._frame("memberships", [row])}, self._entry(who, "member.add", user_id, {"role": role})), batch)

    def _entry(self, who: Principal, action: str, target: str | None = None, detail: dict | None = None) -> dict:
        return {"workspace": who.workspace_id, "actor": who.user_id, "action": action, "target": target, "detail": detail}

    def create_key(self, who: Principal, name: str, batch: str | None = None) -> tuple[str, str]:
        """(id, secret); the secret is shown this once and only its hash is stored."""
        self.require(who, "ADMIN")
        secret, hashed = store.new_key()
        key = uuid.uuid4().hex
        row = (key, who.workspace_id, who.user_id, name, secret[:8], hashed, datetime.datetime.now(), None, None)
        self.commit(lambda: ({"api_keys": self._frame("api_keys", [row])}, self._entry(who, "apikey.create", key, {"name": name})), batch)
        return key, secret

    def list_keys(self, who: Principal) -> DataFrame:
        """The workspace's keys without their hashes, newest first."""
        self.require(who, "MEMBER")
        return self.state("api_keys", workspace_id=who.workspace_id).drop("key_hash", "batch", "version").orderBy(F.desc("created_at"), "id")

    def revoke_key(self, who: Principal, key: str, batch: str | None = None) -> bool:
        """Whether an active key of this workspace was revoked; another's, or a revoked one, is left and leaves no entry."""
        self.require(who, "ADMIN")

        def make():
            active = self.state("api_keys", id=key, workspace_id=who.workspace_id).where("revoked_at is null")
            return None if active.isEmpty() else ({"api_keys": active.withColumn("revoked_at", F.current_timestamp())}, self._entry(who, "apikey.revoke", key))

        return self.commit(make, batch) is not None

    def resolve(self, secret: str) -> Principal | None:
        """The caller behind an active key, in the role that its creator has now; None for all else."""
        key = self.one("api_keys", key_hash=hashlib.sha256(secret.encode()).hexdigest())
        if not key or key["revoked_at"] is not None:
            return None
        member = self.one("memberships", workspace_id=key["workspace_id"], user_id=key["created_by"])
        return Principal(key["created_by"], key["workspace_id"], member["role"], "api_key") if member else None

    def record_run(self, who: Principal, kind: str, request: dict, verdict: str | None, summary: dict, batch: str | None = None) -> str:
        """A run whose request and summary are encrypted."""
        self.require(who, "MEMBER")
        run = uuid.uuid4().hex
        row = (run, who.workspace_id, who.user_id, kind, self._sealed(json.dumps(request)), verdict, self._sealed(json.dumps(summary)), datetime.datetime.now())
        self.commit(lambda: ({"runs": self._frame("runs", [row])}, self._entry(who, "run.create", run, {"kind": kind})), batch)
        return run

    def list_runs(self, who: Principal, limit: int = 50) -> DataFrame:
        """The newest runs, decrypted (a top-k)."""
        self.require(who, "VIEWER")
        return self._runs(who.workspace_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    def _runs(self, workspace: str) -> DataFrame:
        rows = self.state("runs", workspace_id=workspace)
        return rows.select("id", "user_id", "kind", store.decrypt("request_enc", self.key).alias("request"), "verdict", store.decrypt("summary_enc", self.key).alias("summary"), "created_at")

    def verify(self, workspace: str | None) -> bool:
        """Every entry of the workspace's chain (None: the system's) follows from the one before it."""
        chain = self.rows("audit_log").where(F.col("workspace_id").eqNullSafe(F.lit(workspace)))
        return store.verify_chain(chain.withColumn("chain", F.lit(0)), ["chain"], ["id"]).where("not valid").isEmpty()

    def export(self, who: Principal, path: str, batch: str | None = None) -> DataFrame:
        """All that a workspace holds as JSON lines under ``path``, a folder a section, decrypted, without secrets; (section, line)."""
        self.require(who, "OWNER")
        w = who.workspace_id
        users = self.state("users").select(F.col("id").alias("user_id"), store.decrypt("email_enc", self.key).alias("email"), "idp_subject")
        parts = {
            "workspace": self.state("workspaces", id=w).drop("batch", "version"),
            "members": self.state("memberships", workspace_id=w).select("user_id", "role", F.col("created_at").alias("joined_at")).join(users, "user_id"),
            "api_keys": self.state("api_keys", workspace_id=w).select("id", "name", "prefix", "created_at", "revoked_at"),
            "runs": self._runs(w),
            "audit_log": self.rows("audit_log").where(F.col("workspace_id") == w).select("id", "action", "target", "actor_user_id", "detail"),
        }
        lines = reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("line")) for name, df in parts.items()])
        lines.write.mode("overwrite").partitionBy("section").text(path)
        self.commit(lambda: ({}, self._entry(who, "data.export")), batch)
        return self.spark.read.text(path).select("section", F.col("value").alias("line"))

    def erase(self, who: Principal, batch: str | None = None) -> dict:
        """All rows of the workspace go; one entry of the system's chain says how many runs and entries did."""
        self.require(who, "OWNER")
        batch = batch or uuid.uuid4().hex
        touched: list[tuple[str, str]] = []
        counts: dict[str, int] = {}

        def make():
            touched.clear()
            changes = {}
            for table, (schema, _) in TABLES.items():
                column = "id" if table == "workspaces" else "workspace_id"
                if column not in [f.split(" ")[0] for f in schema.split(", ")]:
                    continue
                rows = self.rows(table)
                per_batch = rows.where(F.col(column) == who.workspace_id).groupBy("batch").count().collect()  # a row a touched batch
                counts[table] = sum(r["count"] for r in per_batch)
                if per_batch:
                    touched.extend((table, r["batch"]) for r in per_batch)
                    changes[table] = rows.where(F.col("batch").isin([r["batch"] for r in per_batch]) & ~F.col(column).eqNullSafe(F.lit(who.workspace_id))).withColumn("kept_version", F.col("version"))
            detail = {"runs_deleted": counts["runs"], "audit_events_deleted": counts["audit_log"]}
            return changes, {"workspace": None, "actor": None, "action": "workspace.erased", "target": who.workspace_id, "detail": detail}

        self.commit(make, batch, lambda: list(touched))
        self.purge()
        return {"workspace_id": who.workspace_id, "runs_deleted": counts.get("runs", 0), "audit_events_deleted": counts.get("audit_log", 0)}

    def purge(self) -> None:
        """Delete the folders of batches whose place others took, as erased rows must not stay on disk; repeating it is harmless."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for r in self.commits().select(F.explode("removed").alias("r")).select("r.*").distinct().toLocalIterator():
            at = path(f"{self.root}/{r['of']}/batch={r['batch']}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
