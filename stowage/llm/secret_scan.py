"""Secrets in texts: fixed forms, and values in credential contexts that a guesser would need long for.

The guess cost of a value is the least total of log10 guesses over all ways to cut it into common words, dates, repeats,
keyboard walks and brute-force spans (dynamic programming over its positions). Words are ranked by a count over all documents,
next to a short fixed list. A context value at or above the limit is
a finding of kind ``guess`` unless a base finding holds all of it. An auth scheme before a value (Bearer, Basic, Token) belongs to the
context; a passphrase is the quoted value or the rest of the line.

Positions are code points, ends exclusive. Defined cases: null is an empty text and has no finding; repeated rows are
scanned alike; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.storage import drop_stored, stored

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = r"(?:password|passwd|passcode|pass|pwd|secret|token|api[_-]?key|(?:access|private|signing|encryption)[_-]?key|credentials?|authorization|bearer|login)"
SAID = r"[\"']?\x20*(?:[:=]|\x20is\x20)\x20*"
SCHEME = r"(?:bearer|basic|token|digest|negotiate)"
WORD = r"([^\s\"'<>]{6,})"
# A context can name several keywords and a scheme before its value. A passphrase is the quoted value, or after : and = the rest of
# the line up to a tag; after "is", where prose goes on, an unquoted one is a single word. One group of a match is the value.
CONTEXT = re.compile(
    rf"(?<![a-z])(?:(?:{KEYWORD}{SAID}[\"']?){{0,4}}+passphrase"
    rf"(?:{SAID}(?:\"((?:[^\"\\\r\n]|\\.){{6,}})\"|'((?:[^'\\\r\n]|\\.){{6,}})')"
    rf"|[\"']?\x20*[:=]\x20*(?:\"(?![^\"\r\n]*\")|'(?![^'\r\n]*'))?([^\s\"'<>](?:(?!<[/a-z])[^\r\n]){{5,}})"
    rf"|{SAID}[\"']?{WORD})"
    rf"|(?:{KEYWORD}{SAID}[\"']?){{1,4}}+(?:{SCHEME}\x20+)?+(?!{SCHEME}(?![^\s\"'<>])){WORD})",
    re.I | re.A,
)
# log10 of the guesses from which a value counts as a secret.
LEAST_COST = 10.0
# Common words in passwords, the most common first.
COMMON = (
    "password", "admin", "welcome", "login", "qwerty", "letmein", "monkey", "dragon", "master", "secret", "test", "user", "guest", "root", "default",
    "example", "changeme", "hello", "love", "sunshine", "princess", "football", "baseball", "shadow", "summer", "winter", "spring", "autumn", "pass",
    "token", "key", "your", "the", "and", "this", "that", "here", "none", "null", "true", "false", "value", "string", "server", "database", "public", "private",
)
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
# Words of the documents join the fixed ones: runs of 3 to 64 letters in at least LEAST_DOCS documents and in so many that they make one
# in MOST_WORDS of all mentions of such words, so there are never more than MOST_WORDS. A document mentions a word once, however often.
LETTERS = re.compile(r"[^\W\d_]{3,}")
LONGEST_WORD = 64
LEAST_DOCS = 3
MOST_WORDS = 500_000
# Words that a task counts before it sends them on.
HELD_WORDS = 200_000
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
STEP = {a + b for w in WALKS for a, b in zip(w, w[1:])} | {b + a for w in WALKS for a, b in zip(w, w[1:])}
CLASSES = ((re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[^0-9A-Za-z]"), 33))
SEGMENT = math.log10(2)


class Ranks:
    """Ranks of common words, the fixed ones or those of documents, whichever is better."""

    def __init__(self, words: list[str] = ()):
        """words: the most common first."""
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        for w, r in RANK.items():
            self.rank[w] = min(r, self.rank.get(w, r))
        self.longest = max(map(len, self.rank))


FIXED = Ranks()


def guess_cost(value: str, ranks: Ranks = FIXED) -> float:
    """log10 of the guesses of the cheapest segmentation."""
    n, low = len(value), value.lower()
    brute = math.log10(sum(size for kind, size in CLASSES if kind.search(value)) or 1)
    best = [0.0] + [math.inf] * n
    # Runs of one character and of steps on a keyboard row, by their first position.
    same, walk = [1] * n, [1] * n
    for i in range(n - 2, -1, -1):
        if low[i] == low[i + 1]:
            same[i] = same[i + 1] + 1
        if low[i : i + 2] in STEP:
            walk[i] = walk[i + 1] + 1
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + brute)
        for length in range(3, min(ranks.longest, n - i) + 1):
            rank = ranks.rank.get(low[i : i + length])
            if rank:
                cased = SEGMENT * (value[i : i + length] != low[i : i + length])
                best[i + length] = min(best[i + length], here + SEGMENT + math.log10(rank + 1) + cased)
        date = DATE.match(value, i)
        if date:
            best[date.end()] = min(best[date.end()], here + SEGMENT + math.log10(366 * 120 if len(date[0]) > 4 else 120))
        # A run is as cheap at any length; longer ones end where the run ends.
        for run, start in ((same[i], 95), (walk[i], 2 * 72)):
            if run >= 3:
                best[i + run] = min(best[i + run], here + SEGMENT + math.log10(start * run))
    return best[n]


def findings(text: str | None, ranks: Ranks = FIXED) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all findings, by start, then kind."""
    text = text or ""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if ":" in text or "=" in text or " is " in text:
        # Base findings by start, with the furthest end so far: a context value is dropped if one of them holds all of it.
        base = sorted((s, e) for s, _, e in found)
        k, reach = 0, 0
        for m in CONTEXT.finditer(text):
            start, value = m.start(m.lastindex), m[m.lastindex].rstrip()
            while k < len(base) and base[k][0] <= start:
                reach = max(reach, base[k][1])
                k += 1
            scored = value.rstrip(".,;:!?")
            if reach < start + len(scored) and guess_cost(scored, ranks) >= LEAST_COST:
                found.append((m.start(), 3, start + len(value)))
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def mentioned(text: str | None) -> set[str]:
    """The words of a text outside values of credentials, so that a leaked secret that is copied around does not become a word."""
    text = text or ""
    if ":" in text or "=" in text or " is " in text:
        text = ASSIGN.sub(" ", CONTEXT.sub(" ", text))
    return {w for w in LETTERS.findall(text.lower()) if len(w) <= LONGEST_WORD}


def word_ranks(docs: DataFrame, most_words: int = MOST_WORDS) -> Ranks:
    """Ranks from a count of the documents that mention a word."""

    def count(batches):
        held = Counter()

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.update(mentioned(text.as_py()))
                if len(held) >= HELD_WORDS:
                    yield sent()
                    held.clear()
        yield sent()

    counts = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.where(F.col("n") >= LEAST_DOCS), "words")
    mentions = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * most_words >= mentions).collect()
    drop_stored(docs.sparkSession, counts)
    return Ranks([r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans; words are ranked over all documents first."""
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))

    def scan(batches):
        ranks = shared.value
        for batch in batches:
            every = [findings(t.as_py(), ranks) for t in batch.column("text")]
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f in every], pa.int64()) for kind in range(3)]
            digests = [hashlib.sha256(joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in every]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([joined(f) for f in every], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
