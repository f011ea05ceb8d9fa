"""Account operations: all or nothing, one audit entry each, erasure that leaves other files alone."""

import json
import os

import pytest

from panelwright.operators import accounts as A
from panelwright.operators import store

KEY, INDEX = b"0123456789abcdef", "index"


@pytest.fixture()
def book(spark, tmp_path):
    return A.Accounts(spark, str(tmp_path / "accounts"), KEY, INDEX)


def actions(book, workspace):
    return [r["action"] for r in book.rows("audit_log").where("workspace_id is not distinct from '%s'" % workspace if workspace else "workspace_id is null").orderBy("id").collect()]


def files(book, table):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{book.root}/{table}") for f in fs if f.endswith(".parquet")}


def test_a_workspace_from_login_to_erasure(spark, book, tmp_path):
    ada = book.login("sub-ada", "Ada@example.org")
    again = book.login("sub-ada", "ada@new.example.org")
    assert again == ada and ada.role == "OWNER" and book.state("users").count() == 1
    user = book.state("users", email_bidx=book._blind("ADA@new.example.org")).select(store.decrypt("email_enc", KEY).alias("e")).collect()
    assert [r["e"] for r in user] == ["ada@new.example.org"] and not book.one("users", email_bidx=book._blind("Ada@example.org"))
    bob = book.login("sub-bob", "bob@example.org", "Bob's")
    guest = A.Principal(bob.user_id, ada.workspace_id, "OWNER")  # claims a role that nobody gave
    with pytest.raises(A.Denied):
        book.create_key(guest, "k")
    book.add_member(ada, bob.user_id, "MEMBER")
    with pytest.raises(A.Denied):
        book.create_key(guest, "k")
    run = book.record_run(guest, "backtest", {"symbols": ["A"]}, "CREDIBLE", {"sharpe": 1.5})
    key, secret = book.create_key(ada, "ci")
    assert book.resolve(secret) == A.Principal(ada.user_id, ada.workspace_id, "OWNER", "api_key") and book.resolve("pk_other") is None
    assert [r["name"] for r in book.list_keys(ada).collect()] == ["ci"] and "key_hash" not in book.list_keys(ada).columns
    assert not book.revoke_key(bob, key)  # another workspace's
    assert book.revoke_key(ada, key) and not book.revoke_key(ada, key) and book.resolve(secret) is None
    row = book.list_runs(guest).collect()[0]
    assert row["id"] == run and json.loads(row["request"]) == {"symbols": ["A"]} and json.loads(row["summary"]) == {"sharpe": 1.5}
    assert b"symbols" not in bytes(book.one("runs", id=run)["request_enc"])
    assert actions(book, ada.workspace_id) == ["login", "login", "member.add", "run.create", "apikey.create", "apikey.revoke"]
    assert actions(book, bob.workspace_id) == ["login"] and book.verify(ada.workspace_id) and book.verify(bob.workspace_id)

    lines = book.export(ada, str(tmp_path / "export")).collect()
    by_section = {s: [json.loads(r["line"]) for r in lines if r["section"] == s] for s in {r["section"] for r in lines}}
    assert {k: len(v) for k, v in by_section.items()} == {"workspace": 1, "members": 2, "api_keys": 1, "runs": 1, "audit_log": 6}
    assert {m["email"] for m in by_section["members"]} == {"ada@new.example.org", "bob@example.org"} and secret not in str(lines) and "key_hash" not in str(lines)

    before = {t: files(book, t) for t in A.TABLES}
    bobs = {f"batch={r['batch']}" for t in A.TABLES if t != "users" for r in book.rows(t).where(f"{'id' if t == 'workspaces' else 'workspace_id'} = '{bob.workspace_id}'").collect()}
    assert book.erase(ada) == {"workspace_id": ada.workspace_id, "runs_deleted": 1, "audit_events_deleted": 7}
    after = {t: files(book, t) for t in A.TABLES}
    assert all(f in after[t] for t in A.TABLES for f in before[t] if t == "users" or any(b in f for b in bobs))
    assert not any(book.rows(t).where(f"{'id' if t == 'workspaces' else 'workspace_id'} = '{ada.workspace_id}'").count() for t in A.TABLES if t != "users")
    assert not after["runs"] & before["runs"] and actions(book, None) == ["workspace.erased"] and book.verify(None) and book.verify(bob.workspace_id)
    assert json.loads(book.rows("audit_log").where("workspace_id is null").first()["detail"]) == {"runs_deleted": 1, "audit_events_deleted": 7}
    with pytest.raises(A.Denied):
        book.list_runs(ada)


def test_half_written_batches_do_not_show(spark, book):
    ada = book.login("sub", "a@x")
    rows = book._frame("memberships", [(ada.workspace_id, "mallory", "OWNER", None)])
    book._stage(rows, "memberships", "crashed")  # rows are there, the log's entry is not
    assert book.state("memberships").count() == 1 and book.one("memberships", user_id="mallory") is None


def test_a_repeated_batch_is_one_operation(book):
    ada = book.login("sub", "a@x", batch="b1")
    assert book.login("sub", "a@x", batch="b1") == ada and actions(book, ada.workspace_id) == ["login"]
    key, _ = book.create_key(ada, "k", batch="b2")
    book.create_key(ada, "k", batch="b2")
    assert [r["id"] for r in book.list_keys(ada).collect()] == [key]


def test_a_writer_that_was_not_first_looks_again(book):
    ada = book.login("sub", "a@x")
    entry = {"workspace": ada.workspace_id, "actor": ada.user_id}
    calls = []

    def slow():
        calls.append(1)
        if len(calls) == 1:  # another writer commits between the look and the commit
            book.commit(lambda: ({}, entry | {"action": "other"}))
        return {}, entry | {"action": "slow"}

    book.commit(slow)
    assert len(calls) == 2 and actions(book, ada.workspace_id) == ["login", "other", "slow"] and book.verify(ada.workspace_id)

    def always():
        book.commit(lambda: ({}, entry | {"action": "other"}))
        return {}, entry | {"action": "never"}

    with pytest.raises(A.Conflict):
        book.commit(always)
    assert "never" not in actions(book, ada.workspace_id)


def test_kept_rows_of_an_erased_batch_keep_their_age(spark, book):
    """A batch with two workspaces: the other one's old row must not become newer than its later one."""
    entry = {"workspace": "w1", "actor": "u", "action": "import"}
    both = book._frame("memberships", [("w1", "u", "OWNER", None), ("w2", "u", "OWNER", None)])
    book.commit(lambda: ({"memberships": both}, entry))
    book.commit(lambda: ({"memberships": book._frame("memberships", [("w2", "u", "VIEWER", None)])}, entry | {"workspace": "w2"}))
    book.erase(A.Principal("u", "w1", "OWNER"))
    assert [(r["workspace_id"], r["role"]) for r in book.state("memberships").collect()] == [("w2", "VIEWER")]


def test_chains_with_missing_hashes_are_broken(spark):
    rows = spark.createDataFrame([(1, k, f"b{k}") for k in range(4)] + [(2, 0, None)], "w int, id int, body string")
    chained = store.chain(rows, ["w"], ["id"], rows["body"])
    ok = lambda df: {r["w"]: r["valid"] for r in store.verify_chain(df, ["w"], ["id"]).collect()}
    assert ok(chained) == {1: True, 2: False}
    for column in ("hash", "body"):
        assert ok(chained.withColumn(column, chained[column]).selectExpr("w", "id", *[f"if(id = 3, null, {c}) as {c}" if c == column else c for c in ("body", "hash")]))[1] is False


def test_lookup_filters_reach_the_scan(book):
    book.login("sub", "a@x")
    plan = book.state("memberships", user_id="u1", workspace_id="w1")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,u1)" in plan or "EqualNullSafe(user_id,u1)" in plan
