"""Conversations that share beginnings, as one trie: families first, then only their combined nodes.

A conversation ``c`` belongs to the family of its base ``c - c % 100`` (remainder with c's sign) and is rebuilt as the
base's first ``h`` turns followed by its own after its first ``h``, with ``h = crc32(decimal c) % 6``. Texts stay where
they are: a turn travels as a digest and a length. The base's turns and the other members' turns are cogrouped by base,
and one task builds a family's trie (at most 199 conversations), a row a node with the members' number, the smallest
member and the members that end there, joined in order. Families' nodes then meet by the digest of their whole prefix:
numbers are added before and during the shuffle, and what a node adds to the sums of its ancestors is counted once, in
the family of its smallest member, and summed along that family's own paths, so no level of the trie needs a job of its
own and no node's children meet in one task. Members that end at a node come as one string a family, and as families
are ranges of ids, joining the strings by base joins the ids in numeric order; they stream through SHA-256.

Defined cases: rows with a null conversation id go, as there is nothing to rebuild. Null role or text is empty. Turns are
ordered by turn, null first, equal ones by their digest, so repeated rows are turns of their own and the order of
different texts at one turn is fixed though arbitrary. A base that has no rows gives no turns. A rebuilt conversation
without turns ends at the root. An empty table gives no nodes. A family's turns pass one task (about 100 bytes each), as
does the string of ends of one node, in constant memory: SHA-256 has no parallel form.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BATCH_ROWS, Written

FAMILY = 100
#: A node's key is this much of the SHA-256 of its parent's key and its last turn's digest.
KEY_BYTES = 16
ROOT = bytes(KEY_BYTES)
NODES = "family long, key binary, node int, parent int, depth long, n_convs long, conv_id long, n_chars long, has_child boolean, ends string"
PARTS = "key binary, depth long, n_convs long, conv_id long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def borrowed(conv_id: int) -> int:
    """How many of its base's turns a conversation starts with."""
    return zlib.crc32(str(conv_id).encode()) % 6


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def digests(df: DataFrame) -> DataFrame:
    """(base, conv_id, turn, digest, n_chars) of each turn; the digest stands for role and text together."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return df.where(conv.isNotNull()).select(
        base_of(conv).alias("base"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.char_length(text).cast("long").alias("n_chars")
    )


class Trie:
    """One family's prefixes; node 0 is the root and a node comes after its parent."""

    def __init__(self):
        self.keys, self.parent, self.depth, self.chars = [ROOT], [-1], [0], [0]
        self.n, self.first, self.ends, self.children = [0], [None], [[]], [{}]

    def add(self, conv_id: int, turns: Iterator[tuple[bytes, int]]) -> None:
        """A conversation's (digest, length) turns; ids come in ascending order."""
        at = 0
        self._visit(0, conv_id)
        for digest, chars in turns:
            below = self.children[at].get(digest)
            if below is None:
                below = len(self.keys)
                self.children[at][digest] = below
                self.keys.append(hashlib.sha256(self.keys[at] + digest).digest()[:KEY_BYTES])
                self.parent.append(at)
                self.depth.append(self.depth[at] + 1)
                self.chars.append(chars)
                self.n.append(0)
                self.first.append(None)
                self.ends.append([])
                self.children.append({})
            at = below
            self._visit(at, conv_id)
        self.ends[at].append(conv_id)

    def _visit(self, at: int, conv_id: int) -> None:
        self.n[at] += 1
        if self.first[at] is None:
            self.first[at] = conv_id


def rebuilt(conversations: dict[int, list], base: int) -> Iterator[tuple[int, list]]:
    """Each conversation of a family with its rebuilt turns, by ascending id."""
    head = conversations.get(base, [])
    for conv_id in sorted(conversations):
        h = borrowed(conv_id)
        yield conv_id, head[:h] + conversations[conv_id][h:]


def _family(bases: pa.Table, others: pa.Table) -> pa.Table:
    turns = pa.concat_tables([bases, others])
    if not turns.num_rows:
        return pa.Table.from_batches([], NODE_SCHEMA)
    turns = turns.append_column("known", pa.compute.is_valid(turns["turn"]))
    turns = turns.sort_by([("conv_id", "ascending"), ("known", "ascending"), ("turn", "ascending"), ("digest", "ascending")])
    base, ids = turns["base"][0].as_py(), turns["conv_id"].to_numpy()
    pairs = list(zip(turns["digest"].to_pylist(), turns["n_chars"].to_pylist(), strict=True))
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    conversations = {int(ids[a]): pairs[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
    trie = Trie()
    for conv_id, path in rebuilt(conversations, base):
        trie.add(conv_id, path)
    n = len(trie.keys)
    columns = [
        [base] * n, trie.keys, range(n), trie.parent, trie.depth, trie.n, trie.first, trie.chars, [bool(c) for c in trie.children],
        [",".join(map(str, e)) if e else None for e in trie.ends],
    ]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, NODE_SCHEMA, strict=True)], schema=NODE_SCHEMA)


NODE_SCHEMA = pa.schema([
    ("family", pa.int64()), ("key", pa.binary()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()),
    ("n_chars", pa.int64()), ("has_child", pa.bool_()), ("ends", pa.string()),
])


def family_nodes(df: DataFrame) -> DataFrame:
    """The nodes of each family's own trie: the base's turns cogrouped with the other members'."""
    turns = digests(df)
    bases, others = turns.where("conv_id = base"), turns.where("conv_id <> base")
    return bases.groupBy("base").cogroup(others.groupBy("base")).applyInArrow(_family, NODES)


def _sums(nodes: pa.Table) -> pa.Table:
    """One family's part of each of its nodes' sums, from nodes that know their global numbers."""
    nodes = nodes.sort_by("node")
    family = nodes["family"][0].as_py()
    parent, chars, n, conv, has_child = (nodes[c].to_pylist() for c in ("parent", "n_chars", "n_convs", "conv_id", "has_child"))
    rows = len(parent)
    own = [c - (c % FAMILY if c >= 0 else -(-c % FAMILY)) == family for c in conv]
    leaves = [int(o and not h) for o, h in zip(own, has_child, strict=True)]
    saved = [o * (k - 1) * t for o, k, t in zip(own, n, chars, strict=True)]
    children = [0] * rows
    for i in range(rows - 1, 0, -1):
        up = parent[i]
        leaves[up] += leaves[i]
        saved[up] += saved[i]
        children[up] += own[i]
    above = [None if p < 0 else conv[p] for p in parent]
    columns = [nodes["key"], nodes["depth"], nodes["n_convs"], nodes["conv_id"], pa.array(above, pa.int64()), *(pa.array(c, pa.int64()) for c in (children, leaves, saved))]
    return pa.table(columns, names=["key", "depth", "n_convs", "conv_id", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows (key, ends) that are sorted by key and family; one hash is open at a time."""

    def rows(keys: list, hashes: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])

    at, state, keys, hashes = None, None, [], []
    for batch in batches:
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != at:
                if at is not None:
                    keys.append(at)
                    hashes.append(state.hexdigest())
                at, state = key, hashlib.sha256(ends.encode())
            else:
                state.update(f",{ends}".encode())
        if len(keys) >= BATCH_ROWS:
            yield rows(keys, hashes)
            keys, hashes = [], []
    if at is not None:
        keys.append(at)
        hashes.append(state.hexdigest())
    yield rows(keys, hashes)


def ends_hashes(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which members end; a node's strings are hashed by ascending family."""
    ends = nodes.where("ends is not null").select("key", "ends", "family")
    return ends.repartition("key").sortWithinPartitions("key", "family").select("key", "ends").mapInArrow(_hash_ends, "key binary, ends_sha256 string")


def prefix_trie(df: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``df`` has conv_id, turn, role and text; other columns are not read. Family nodes are written once to the shared
    folder, as they are merged and joined with what the merge found; that table stays, as the result reads it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    nodes = Written(family_nodes(df), "family-nodes").df
    merged = nodes.groupBy("key").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("has_child").alias("has_child"))
    merged = merged.select(F.concat("key", F.lit(b"")).alias("of"), "n_convs", "conv_id", "has_child")
    placed = nodes.select("family", "key", "node", "parent", "depth", "n_chars").join(merged.hint("merge"), F.col("key") == F.col("of"))
    parts = placed.drop("of").groupBy("family").applyInArrow(_sums, PARTS)
    whole = parts.groupBy("key").agg(
        *[F.min(c).alias(c) for c in ("depth", "n_convs", "conv_id", "parent_conv_id")], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    )
    found = whole.join(ends_hashes(nodes), "key", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
