"""Exact token counts at every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

The text is split once into pre-tokens. For a pre-token the count of each of its byte prefixes follows
from shorter prefixes: the last token of a prefix's encoding is the longest vocabulary entry that ends
there and may follow the last token of what precedes it (two tokens may follow each other if encoding
their joined bytes gives the same two back). Counts are kept as one signed step per UTF-8 byte, so a
prefix table has the size of its text, and the count of any prefix is a partial sum: truncation and
budget questions need no encoding (``count_at``, ``bytes_within``).

The library's default for special strings holds: each is one token wherever it stands. Steps are exact at
code point boundaries (a text cannot end elsewhere). Words of up to ``CACHED_CHARS`` characters met before are looked
up in a per-worker table of at most ``CACHE`` entries that is emptied when full, which changes time only.

Defined results: null is an empty text; an empty text has no steps and 0 tokens; very long texts are
encoded whole, memory a small multiple of the text; repeated rows give repeated results; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, texts, with_id

#: Most pre-tokens a worker remembers, and the most characters of one it does.
CACHE, CACHED_CHARS = 600_000, 64
#: Key of a token's number in the node where it ends; other keys are bytes.
TOKEN = 256
#: Code points with the Unicode property White_Space (fixed values).
SPACES = "\t-\r \x85\xa0  -     　"
#: White space of two or more characters before something else; tried at a run's start only and whole, so in linear time.
RUN = re.compile(rf"(?<![{SPACES}])[{SPACES}]{{2,}}+(?=[^{SPACES}])")


@functools.cache
def splitter() -> regex.Pattern[str]:
    """The byte-level pre-tokenizer's pattern."""
    return regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _signed(byte: int) -> int:
    return byte - 256 if byte > 127 else byte


class Steps(dict):
    """Steps of pre-tokens, found when first asked for; short ones are remembered."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> bytes:
        counts = self.counter.prefix_counts(word.encode("utf-8", "replace"))
        if word in ("'re", "'ve", "'ll"):  # two letters in, the text still ends in "'" and a letter
            counts[2] = 2
        steps = bytes([(b - a) & 255 for a, b in itertools.pairwise(counts)])
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = steps
        return steps


class PrefixCounter:
    """Step tables for the vocabulary in one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_letters()
        raw = lambda token: bytes(byte[c] for c in token)
        self.bytes_of = {k: raw(t) for t, k in spec["model"]["vocab"].items()}
        self.trie: dict[int, dict] = {}
        for k, token in self.bytes_of.items():
            node = self.trie
            for value in token:
                node = node.setdefault(value, {})
            node[TOKEN] = k
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = splitter().findall
        self.steps = Steps(self)
        self.follows: dict[int, bool] = {}  # by both tokens' numbers
        self.parts: dict[bytes, tuple[bytes, bytes, int] | None] = {}

    def merge(self, data: bytes) -> tuple[list[bytes], tuple[bytes, bytes, int] | None]:
        """Plain BPE of a short string, the lowest-ranked adjacent pair first, and its last merge with the merge's rank."""
        parts, done = [data[i : i + 1] for i in range(len(data))], None
        while len(parts) > 1:
            best, at = min((self.rank.get(p, sys.maxsize), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == sys.maxsize:
                break
            done = parts[at], parts[at + 1], best
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, done

    def made_of(self, token: bytes) -> tuple[bytes, bytes, int] | None:
        """The merge that ends the encoding of a token's own bytes; None for single bytes and for tokens that encoding doesn't give back."""
        if token not in self.parts:
            parts, done = self.merge(token)
            self.parts[token] = done if len(parts) == 1 else None
        return self.parts[token]

    def stands(self, token: bytes) -> bool:
        """Whether encoding the token's own bytes gives it back."""
        return len(token) == 1 or self.made_of(token) is not None

    def may_follow(self, left_token: int, right_token: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives the same two back.

        Until they are whole, the ends that meet are the right parts of ``left`` and the left parts of ``right``, each
        there until its own merge. The border falls if two that meet have a merge which comes before both of those.
        Of equal ranks the leftmost merge comes first.
        """
        left, right = self.bytes_of[left_token], self.bytes_of[right_token]
        known = self.stands(left) and self.stands(right)
        a_until = b_until = sys.maxsize
        while known:
            joint = self.rank.get((left, right), sys.maxsize)
            if joint < a_until and joint <= b_until and joint < sys.maxsize:
                known = False
                break
            a, b = self.made_of(left), self.made_of(right)
            if a is None and b is None:
                break
            # The later merge of the two is undone; of the same merge on both sides, the right one.
            if b is None or (a is not None and a[2] > b[2]):
                left, a_until = a[1], a[2]
            else:
                right, b_until = b[0], b[2]
        if len(self.follows) >= 2 * CACHE:
            self.follows.clear()
        self.follows[left_token << 32 | right_token] = known
        return known

    def prefix_counts(self, data: bytes) -> list[int]:
        """Tokens of data[:i] for each i, as one piece. ``last[i]`` is the encoding's last token: the longest one that fits."""
        n = len(data)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        follows = self.follows
        for start in range(n):
            node, before, count = self.trie, last[start] << 32, counts[start] + 1
            for end in range(start, n):
                if (node := node.get(data[end])) is None:
                    break
                if (token := node.get(TOKEN)) is not None and last[end + 1] < 0:
                    if not start:
                        fits = self.stands(self.bytes_of[token])
                    elif (fits := follows.get(before | token)) is None:
                        fits = self.may_follow(last[start], token)
                    if fits:
                        counts[end + 1], last[end + 1] = count, token
        return counts

    def plain_steps(self, text: str) -> bytearray:
        """Steps of a text without special strings."""
        steps = bytearray(b"".join(map(self.steps.__getitem__, self.find(text))))
        done = begin = 0
        # White space that ends a text is one piece, though before a word its last character is not.
        for m in RUN.finditer(text):
            run = m[0]
            begin += len(text[done : m.start()].encode("utf-8", "replace"))
            done = m.start()
            tail = len(run[-1].encode())
            at = begin + len(run.encode()) - tail
            step = sum(_signed(k) for k in self.steps[run][-tail:])
            # The count right after the run, then the next byte takes up what the split really has.
            after = at + tail
            first = sum(map(_signed, steps[at:after])) if run[-1] != " " else _signed(steps[at])
            steps[at:after] = bytes(tail - 1) + bytes([step & 255])
            steps[after] = (_signed(steps[after]) + first - step) & 255
        return steps

    def encode_steps(self, text: str) -> bytes:
        """One signed step per UTF-8 byte of the text; their sum is its token count."""
        if not self.special_at or not any(s in text for s in self.special):
            return bytes(self.plain_steps(text))
        out, done = bytearray(), 0
        for m in self.special_at.finditer(text):
            before = text[done : m.start()]
            part = self.plain_steps(before + m[0][:-1])  # until its last character the string is ordinary text
            now = int(np.frombuffer(part, np.int8).sum(dtype=np.int64))
            part.append((int(np.frombuffer(self.plain_steps(before), np.int8).sum(dtype=np.int64)) + 1 - now) & 255)
            out += part
            done = m.end()
        return bytes(out + self.plain_steps(text[done:]))


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One counter per worker process."""
    return PrefixCounter(path)


def prefix_token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_steps: bool = True) -> DataFrame:
    """(id_col, n_bytes long, n_tokens long[, steps binary]) per row of ``df``.

    ``steps`` is the prefix table; ``n_tokens`` is its value at the end of the text. Leave the table out
    (``keep_steps=False``) where only totals are asked for, so that it never leaves the Python worker.
    ``tokenizer_path`` is the file's path on the executors.
    """

    def make():
        encode = counter(tokenizer_path).encode_steps

        def step(batch):
            tables = [encode(t) for t in texts(batch)]
            columns = [
                batch.column(0),
                pa.array([len(s) for s in tables], pa.int64()),
                pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in tables], pa.int64()),
            ]
            names = ["id", "n_bytes", "n_tokens"]
            if keep_steps:
                columns.append(pa.array(tables, pa.binary()))
                names.append("steps")
            yield pa.RecordBatch.from_arrays(columns, names)

        return step

    source = id_and_text(df, id_col, text_col)
    schema = with_id(source, "n_bytes long, n_tokens long" + ", steps binary" * keep_steps)
    return map_batches(source, make, schema).withColumnRenamed("id", id_col)


def count_at(steps: bytes, n_bytes: int) -> int:
    """Tokens of the first ``n_bytes`` UTF-8 bytes (a code point boundary)."""
    return int(np.frombuffer(steps, np.int8, count=min(n_bytes, len(steps))).sum(dtype=np.int64))


def bytes_within(steps: bytes, budget: int) -> int:
    """The longest prefix, in bytes, of at most ``budget`` tokens; cut it back to a code point boundary."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def over_limit(n_tokens: str | Column, limit: int) -> Column:
    return (F.col(n_tokens) if isinstance(n_tokens, str) else n_tokens) > F.lit(limit)
