"""URL rules in a sorted digest array: memory-mapped 64-bit keys, vectorised binary search, stored strings as proof.

A rule is a host with a path (``example.org/es/``) and a verdict. It fits its host and all subdomains when the URL's path
starts with the rule's; the longest rule wins (code points; of equal ones that with the longer host). URLs that no rule
fits get the default verdict.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.
Defined cases: null or no ``://`` gives an empty host and path, which no rule fits; repeated rows are judged alike; an
empty table gives an empty result, an empty rule set the default for all; other input columns are not read.
"""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
DEFAULT = "allow"
# Rules up to this many bytes of text go to every task as one index; more are joined by digest.
INDEX_BYTES = 64 << 20
PARTS = re.compile(r"://([^/?#]*)([^?#]*)")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    found = PARTS.search(url) if url else None
    return (found[1].translate(UPPER), found[2]) if found else ("", "")


def keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every rule text that could fit, the longest first."""
    if not host:
        return []
    suffixes = [host]
    while "." in suffixes[-1]:
        suffixes.append(suffixes[-1].split(".", 1)[1])
    made = [(s, path[:n]) for s in suffixes if s for n in lengths if n <= len(path)]
    made.sort(key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))
    return [s + p for s, p in made]


def index_of(rules: list[tuple[str, str]]) -> bytes:
    """Sorted digests, then offsets and verdicts, then the texts: the file that is mapped."""
    ordered = sorted((xxhash.xxh64_intdigest(r), r.encode(), v.encode()) for r, v in rules)
    digests = np.array([d for d, _, _ in ordered], "<u8")
    texts, verdicts = [r for _, r, _ in ordered], [v for _, _, v in ordered]
    at = np.cumsum([0, *[len(t) + len(v) for t, v in zip(texts, verdicts)]]).astype("<u8")
    cut = np.array([len(t) for t in texts], "<u8")
    return np.array([len(ordered)], "<u8").tobytes() + digests.tobytes() + at.tobytes() + cut.tobytes() + b"".join(t + v for t, v in zip(texts, verdicts))


class Index:
    """A mapped index; the file is unlinked once it is open, so nothing is left behind."""

    def __init__(self, data: bytes):
        handle, name = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        raw = np.memmap(name, np.uint8, "r")
        os.unlink(name)
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.at = raw[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.cut = raw[16 + 16 * n : 16 + 24 * n].view("<u8")
        self.texts = raw[16 + 24 * n :]

    def probe(self, candidates: list[str]) -> list[str | None]:
        """The verdict of each candidate that is a rule."""
        wanted = np.array([xxhash.xxh64_intdigest(c) for c in candidates], "<u8")
        place = np.searchsorted(self.digests, wanted)
        out: list[str | None] = [None] * len(candidates)
        hit = place < len(self.digests)
        hit[hit] = self.digests[place[hit]] == wanted[hit]
        for i in np.flatnonzero(hit).tolist():
            text, k = candidates[i].encode(), int(place[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                start, cut, end = int(self.at[k]), int(self.cut[k]), int(self.at[k + 1])
                if self.texts[start : start + cut].tobytes() == text:
                    out[i] = self.texts[start + cut : end].tobytes().decode()
                    break
                k += 1
        return out


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def path_lengths(rules: DataFrame) -> list[int]:
    """The distinct path lengths of the rules: a path is tried at these lengths only."""
    return sorted(r[0] for r in rules.select(F.length(F.regexp_extract("rule", "^[^/]*(.*)$", 1))).distinct().collect())


def judged(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT, id_column: str = "page_id", url: str = "url", most_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    spark = pages.sparkSession
    rules = rules_frame(spark) if rules is None else rules
    lengths = path_lengths(rules)
    asked = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"))
    kind = pages.schema[id_column].dataType.simpleString()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("verdict") + 24), F.lit(0))).first()[0]
    if size > most_bytes:
        return by_join(asked, rules, lengths, default, id_column, kind)
    shared = spark.sparkContext.broadcast(index_of([(r["rule"], r["verdict"]) for r in rules.collect()]))

    def judge(batches):
        index = Index(shared.value)
        for batch in batches:
            split = [parts(u) for u in batch.column("url").to_pylist()]
            tried = [keys(h, p, lengths) for h, p in split]
            found = iter(index.probe([k for ks in tried for k in ks]))
            rule, verdict = [], []
            for ks in tried:
                # Candidates come longest first.
                hits = [(k, v) for k, v in zip(ks, [next(found) for _ in ks]) if v is not None]
                rule.append(hits[0][0] if hits else None)
                verdict.append(hits[0][1] if hits else default)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    return asked.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_column)


def by_join(asked: DataFrame, rules: DataFrame, lengths: list[int], default: str, id_column: str, kind: str) -> DataFrame:
    """The same for rule sets that no task should hold: candidates meet rules by digest and text in a shuffle join."""

    def tried(batches):
        for batch in batches:
            split = [parts(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([keys(h, p, lengths) for h, p in split], pa.list_(pa.string()))],
                ["row", "id", "host", "path", "keys"],
            )

    # Repeated rows stay apart by their number.
    rows = asked.select(F.monotonically_increasing_id().alias("row"), "id", "url").mapInArrow(tried, f"row bigint, id {kind}, host string, path string, keys array<string>")
    single = rows.select("row", "id", "host", "path", F.posexplode_outer("keys").alias("place", "rule")).withColumn("digest", F.xxhash64("rule"))
    held = rules.dropDuplicates(["rule"]).withColumn("digest", F.xxhash64("rule"))
    met = single.join(held, ["digest", "rule"], "left")
    best = met.groupBy("row", "id", "host", "path").agg(F.min(F.when(F.col("verdict").isNotNull(), F.struct("place", "rule", "verdict"))).alias("best"))
    return best.select(F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
