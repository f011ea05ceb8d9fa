"""Secret scans with a password guess-cost model.

Two sources of spans per document:

* base patterns ``assign``, ``access`` and ``hex`` (leftmost, non-overlapping per kind), and
* ``guess``: a value in a credential context (``pwd``, ``passphrase``, ``bearer``, URL user info, ...)
  that base spans don't cover whole and whose estimated number of guesses is at least ``10 ** min_log10``.

The number of guesses is the cheapest of all segmentations of the value, found by dynamic programming, into
dictionary words (with capitals and common substitutions), dates, repeats, keyboard walks and
brute-force spans. The dictionary is common password words, then the corpus's own words by frequency
(``corpus_words``; its size is a parameter, the counts cover all texts, values in credential contexts left
out). Every span carries the cost of its value, so weak base findings can be told apart; they are never removed.

Defined results: a null text is an empty text; an empty text has no spans; very long texts are scanned
whole (the segmentation is linear in the value's length); repeated rows give repeated results; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, texts, with_id

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:passphrase|passcode|password|passwd|pwd|pass|secret|token|credentials?|api[-_ ]?key|access[-_ ]?key|private[-_ ]?key)"""
    r"""["']?\x20*(?:[:=]>?|->|(\bis\b))\x20*["']?([^\s"'<>,;|]+)"""
    r"""|\bbearer\x20+([A-Za-z0-9+/_.=~-]+)"""
    r"""|://[^\s:/@"'<>]+:([^\s:/@"'<>]+)@""",
    re.IGNORECASE | re.ASCII,
)
#: Lower-case strings of which a text with an ``assign`` or ``guess`` match has one.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "bearer", "://")

# Common password words, most frequent first.
WORDS = """password welcome admin letmein monkey dragon master login princess qwerty sunshine shadow football baseball
superman batman iloveyou trustno starwars whatever freedom hello charlie michael jordan hunter ranger buster soccer
hockey killer george andrew thomas daniel jessica pepper ginger summer winter spring autumn secret love angel
test user guest root default changeme example sample temp system server token value none null true false required
your name here please enter forgot reset change must should cannot valid invalid correct wrong strong weak the and
for with that this from have not are was were will can all new old key pass code word text data file string""".split()
# Keyboard rows; a walk follows one of them in either direction.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv")
# Substitutions undone before a word is looked up.
SUBSTITUTES = str.maketrans("4@8361!|05$7+2", "aabegiilossttz")
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d"
    r"|(?:19|20)\d\d"
)
#: Longest unit of a repeat, and the cost of how often it is repeated, in powers of ten.
UNIT, TIMES = 8, math.log10(64)
#: Cost of opening one more segment, in powers of ten.
SEGMENT = math.log10(2.0)
#: Words of the corpus that a dictionary may hold.
CORPUS_WORD = re.compile(r"(?<![^\W_])[a-z]{3,24}(?![^\W_])")


def _alphabet(ch: str) -> float:
    """Log10 of how many characters a guesser tries for this one."""
    if ch.isdigit():
        return 1.0
    if "a" <= ch <= "z" or "A" <= ch <= "Z":
        return math.log10(26)
    return math.log10(33) if ch < "\x7f" else 2.0


class Ranks(dict):
    """Words by rank, and the lengths they have."""

    def __init__(self, words):
        super().__init__({w: k for k, w in reversed(list(enumerate(words, 1)))})
        self.sizes = sorted({len(w) for w in self if len(w) >= 3})

    def __reduce__(self):
        return Ranks, (sorted(self, key=self.get),)


def word_cost(piece: str, ranks: Ranks) -> float:
    """Log10 of the guesses for a dictionary word in some capitals and with common substitutions; infinite if it is none."""
    low = piece.lower()
    swapped = 0.0
    if not (rank := ranks.get(low)):
        if not (rank := ranks.get(low.translate(SUBSTITUTES))):
            return math.inf
        swapped = math.log10(4)
    case = 0.0 if piece.islower() else math.log10(2) if piece[1:].islower() or piece.isupper() else math.log10(2) * len(piece) / 2
    return math.log10(rank) + swapped + case


def date_cost(piece: str) -> float:
    if not DATE.fullmatch(piece):
        return math.inf
    return math.log10(365 * 60) if len(piece) > 4 else math.log10(60)


def walk_cost(length: int, line: str) -> float:
    return math.log10(len(KEY_ROWS) * 2 * len(line) * length)


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    """All stretches of four or more keys along a row (a row has few keys, so a place begins few of them)."""
    low = value.lower()
    for row in KEY_ROWS:
        for line in (row, row[::-1]):
            for i, key in enumerate(low):
                at = line.find(key)
                for j in range(i + 1, i + len(line) - at if at >= 0 else 0):
                    if j >= len(low) or line[at + j - i] != low[j]:
                        break
                    if j - i >= 3:
                        yield i, j + 1, walk_cost(j + 1 - i, line)


def log10_guesses(value: str, ranks: Ranks) -> float:
    """Log10 of the guesses that the cheapest segmentation of ``value`` needs.

    best[j] is the least cost of the first j characters; brute[j] the least among those whose last
    segment is a brute-force span; repeat[u][j] the least among those whose last segment repeats its first u
    characters (at least twice and three characters in all, the last time perhaps in part). Every start and
    length of words, dates and walks is tried, so the whole costs O(length x longest word).
    """
    n = len(value)
    if not n:
        return 0.0
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for size in ranks.sizes:
            if i + size > n:
                break
            if (cost := word_cost(value[i : i + size], ranks)) < math.inf:
                ends[i].append((i + size, cost))
        if value[i].isdigit():
            ends[i] += [(j, cost) for j in range(i + 3, min(n, i + 10) + 1) if (cost := date_cost(value[i:j])) < math.inf]
    for i, j, cost in _walks(value):
        ends[i].append((j, cost))
    letters = [0.0, *itertools.accumulate(map(_alphabet, value))]
    best, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)
    repeat, run = [math.inf] * (UNIT + 1), [0] * (UNIT + 1)  # at this place; characters equal to those u before
    best[0] = 0.0
    for i in range(n):
        brute[i + 1] = min(brute[i], best[i] + SEGMENT) + _alphabet(value[i])
        best[i + 1] = min(best[i + 1], brute[i + 1])
        for u in range(1, min(UNIT, i) + 1):
            if value[i] != value[i - u]:
                repeat[u], run[u] = math.inf, 0
                continue
            run[u] += 1
            shortest = max(2 * u, 3)
            if run[u] >= shortest - u:
                begin = i + 1 - shortest
                repeat[u] = min(repeat[u], best[begin] + SEGMENT + letters[begin + u] - letters[begin] + TIMES)
                best[i + 1] = min(best[i + 1], repeat[u])
        for j, cost in ends[i]:
            best[j] = min(best[j], best[i] + SEGMENT + cost)
    return best[n]


#: After "is", a value that is one plain word, capitalised or not, is prose rather than a credential.
PROSE = re.compile(r"[^\W\d_]?[^\W\d_A-Z]*|[A-Z]+")
_NOT_HEX = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))


def find_spans(text: str, ranks: Ranks, min_log10: float) -> list[tuple[str, int, int, float]]:
    """All spans of one text as (kind, start, end, cost), by start and then kind."""
    found: list[tuple[str, int, int, float]] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                found.append(("assign", m.start(), m.end(), log10_guesses(m[2], ranks)))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), log10_guesses(m[0], ranks)) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_NOT_HEX):
        found += [("hex", m.start(), m.end(), log10_guesses(m[0], ranks)) for m in HEX.finditer(text)]
    if any(h in low for h in CONTEXT_HINTS):
        taken: list[tuple[int, int]] = []
        for s, e in sorted((s, e) for _, s, e, _ in found):
            if taken and s <= taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        k = 0
        for m in CONTEXT.finditer(text):
            start = m.start(m.lastindex)
            value = m[m.lastindex].rstrip(".!?)#*")
            end = start + len(value)
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            covered = k < len(taken) and taken[k][0] <= start and end <= taken[k][1]
            if not covered and not (m[1] and PROSE.fullmatch(value)) and (cost := log10_guesses(value, ranks)) >= min_log10:
                found.append(("guess", start, end, cost))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def corpus_words(df: DataFrame, text_col: str = "text", n_words: int = 30_000) -> list[str]:
    """The guesser's dictionary: ``WORDS``, then the most frequent other words of all texts, most frequent first.

    Words of about equal frequency (an eighth of a doubling) are taken together, as long as ``n_words`` or fewer are taken.
    """

    def make():
        def step(batch):
            counts: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if text:
                    low = text.lower()
                    if any(h in low for h in CONTEXT_HINTS):
                        low = CONTEXT.sub(" ", low)
                    counts.update(CORPUS_WORD.findall(low))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        return step

    texts_only = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = map_batches(texts_only, make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).persist()
    level, words, least = F.floor(8 * F.log2("n")), 0, 1 << 20
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows at any size
        if (words := words + r["count"]) > n_words:
            break
        least = r["level"]
    top = counted.where(level >= least).collect()
    counted.unpersist()
    return list(dict.fromkeys([*WORDS, *(r["word"] for r in sorted(top, key=lambda r: (-r["n"], r["word"])))]))


def secret_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: tuple[str, ...] | list[str] | None = None,
    min_log10: float = 9.0,
) -> DataFrame:
    """(id_col, spans array<struct<kind, start, end, cost>>), one row per input row.

    Offsets are code points, ends exclusive. ``words`` is the guesser's dictionary, most likely first; by default
    the corpus's own (``corpus_words`` of ``df``).
    """
    ranks = Ranks(corpus_words(df, text_col) if words is None else words)
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))

    def make():
        def step(batch):
            rows = [[dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in find_spans(t, sent.value, min_log10)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans)], ["id", "spans"])

        return step

    source = id_and_text(df, id_col, text_col)
    out = map_batches(source, make, with_id(source, "spans array<struct<kind:string,start:int,end:int,cost:double>>"))
    return out.withColumnRenamed("id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]", words=None, min_log10: float = 9.0) -> DataFrame:
    """``df`` with every span of ``secret_scan`` replaced by ``mask``; columns and rows stay as they were.

    Works on the row itself (no join), so repeated ids are no trouble. A null text stays null.
    """
    ranks = Ranks(corpus_words(df, text_col) if words is None else words)
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    at = df.columns.index(text_col)

    def make():
        def step(batch):
            out = []
            for text in batch.column(at).to_pylist():
                pieces, done = [], 0
                for _, start, end, _ in find_spans(text or "", sent.value, min_log10):
                    if start >= done:
                        pieces += [text[done:start], mask]
                    done = max(done, end)
                out.append("".join([*pieces, text[done:]]) if pieces else text)
            column = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], [f"c{i}" for i in range(batch.num_columns)])

        return step

    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    return map_batches(plain, make, plain.schema).toDF(*df.columns)
