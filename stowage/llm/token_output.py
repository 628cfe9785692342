"""Token ids of documents in checksummed binary blocks, in ascending doc_id order.

A file holds frames, a row each: the documents of a frame (ids and token counts), its place in its shard, and its payload.
Shards follow each other in doc_id order, frames in their shard. A payload is little-endian:

    "TID2", ids, blocks, different ids, bytes of tables (each u32); the tables, deflated: steps between the different ids (u32), then ``range_coder.Tables``;
    per block: ids (u32), bytes (u32), CRC-32 of the ids as u32 (u32); then the coded blocks

Each block is coded from a fresh memory and can be read with the tables of its frame alone (see ``range_coder``). Files are Parquet without compression, so that
Spark writes them, commits them and writes them again when an executor is lost.

Texts are tokenized by runs without white space, each distinct run once per worker and cache: no token of this kind of vocabulary
(white space dropped, words end at it) reaches across one. Where the vocabulary splits letters from marks and lower-cases, marks after a last letter are tokenized apart.

Defined cases: null or empty text is the end id alone; documents of equal id are ordered by text; a null id comes first; a document longer than a frame is a
frame of its own; an empty table gives no frames; other input columns are not read. Ids are below 2**32.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm import range_coder
from stowage.llm.storage import shared_folder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
FRAME_IDS = 1 << 20
# Ids that are coded or decoded at once.
HELD_IDS = 1 << 23
# Runs and ids that a worker keeps; bytes of text that it tokenizes at once.
CACHED_RUNS = 500_000
CACHED_IDS = 1 << 23
CHUNK = 16_000_000
MAGIC = b"TID2"
HEAD = 20
# Ids below this are numbered by a table.
TABLED = 1 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, with a bounded cache of runs.

    New runs are encoded in long texts. Runs of letters are words and end where a token that ends a word stands; others have a mark between them, a
    character that is always a token of its own.
    """

    MARK = "\x00"
    # Vocabularies that split a word from marks after it, whatever its case.
    NORMALIZERS = ["NFC", "Replace", "Lowercase"]
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # Marks that neither begin 's and its like nor are part of a control token.
    TAIL = "".join(c for c in string.punctuation if c not in "'|<>")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark runs a task on each core already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        if len(self.mark) != 1:
            raise ValueError("the vocabulary has no token for the mark")
        told = json.loads(self.tokenizer.to_str())
        splits = [s.get("pattern", {}).get("Regex") for s in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.cuts = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])] == self.NORMALIZERS and splits[:1] == [self.WORDS]
        suffix, words = told["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in words.items() if w.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.starts, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), 0

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Runs, their ids one after another, and where those of each end."""
        words, plain = [], []
        for t in texts:
            (words if t.isalpha() else plain).append(t)
        parts = [words[i : i + 200] for i in range(0, len(words), 200)]
        for part, ids in zip(parts, self.encoded([" ".join(part) for part in parts])):
            ends = np.flatnonzero(self.ends[ids]) + 1
            # A word ends once at least, so as many ends as words are their ends.
            if len(ends) == len(part) and ends[-1] == len(ids):
                yield part, ids, ends
            else:
                plain += part
        marked = [t for t in plain if self.MARK in t]
        for t, ids in zip(marked, self.encoded(marked)):
            yield [t], ids, np.array([len(ids)])
        plain = [t for t in plain if self.MARK not in t]
        parts = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for part, ids in zip(parts, self.encoded([f" {self.MARK} ".join(part) for part in parts])):
            at = ids == self.mark[0]
            ends = np.append(np.flatnonzero(at), len(ids)) - np.arange(len(part))
            yield part, ids[~at], ends

    def cut(self, runs: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Runs as two pieces each that are tokenized apart."""
        if not self.cuts:
            return runs, pa.array([""] * len(runs), pa.string())
        parts = pc.extract_regex(runs, f"(?s)^(?P<stem>.*[A-Za-z])(?P<tail>[{re.escape(self.TAIL)}]+)$")
        stems, tails = pc.coalesce(pc.struct_field(parts, "stem"), runs), pc.coalesce(pc.struct_field(parts, "tail"), "")
        lowers = pc.and_not(pc.string_is_ascii(stems), pc.match_substring(stems, "|"))
        return pc.if_else(lowers, pc.ascii_lower(stems), stems), tails

    def placed(self, pieces: pa.Array) -> np.ndarray:
        """The places of pieces; the ids of new ones are noted."""
        coded = pieces.dictionary_encode()
        names, places = coded.dictionary.to_pylist(), self.places
        made = list(self.runs([p for p in names if p not in places]))
        if made:
            first, count = len(places), sum(len(part) for part, _, _ in made)
            ids = np.concatenate([ids for _, ids, _ in made])
            sizes = np.concatenate([np.diff(ends, prepend=0) for _, _, ends in made])
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while first + count + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts[first + 1 : first + 1 + count] = self.used + np.cumsum(sizes)
            self.used += len(ids)
            places.update(zip([p for part, _, _ in made for p in part], range(first, first + count)))
        return np.array([places[p] for p in names], np.int64)[coded.indices.to_numpy()]

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, each text with the end id, and how many of them each text has."""
        if len(self.places) > CACHED_RUNS or self.used > CACHED_IDS:
            self.clear()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        runs, lengths = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy()
        stems, tails = self.cut(runs.dictionary)
        at = runs.indices.to_numpy()
        pieces = np.column_stack([self.placed(stems)[at], self.placed(tails)[at]]).ravel()
        starts = self.starts[pieces]
        sizes = self.starts[pieces + 1] - starts
        after = np.cumsum(np.append(0, sizes))
        found = self.flat[np.repeat(starts - after[:-1], sizes) + np.arange(after[-1])]
        ends = after[2 * np.cumsum(np.append(0, lengths))]
        counts = np.diff(ends) + 1
        out, is_end = np.empty(len(found) + len(counts), "<u4"), np.zeros(len(found) + len(counts), bool)
        is_end[np.cumsum(counts) - 1] = True
        out[is_end], out[~is_end] = end_id, found
        return out, counts


@cache
def worker_encoder(path: str) -> Encoder:
    """One for each Python worker; its tasks share what is cached."""
    return Encoder(path)


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of bounded bytes; one longer text is alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        yield texts.slice(at, to - at)
        at = to


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and every id as its number among them."""
    if not len(ids) or ids.max() >= TABLED:
        return np.unique(ids, return_inverse=True)
    different = np.flatnonzero(np.bincount(ids))
    numbers = np.zeros(int(different[-1]) + 1, np.int32)
    numbers[different] = np.arange(len(different))
    return different, numbers[ids]


def packed(frames: list[np.ndarray]) -> list[bytes]:
    """Payloads of id arrays; their blocks are coded together."""
    step = range_coder.BLOCK
    different, numbers = zip(*[numbered(f) for f in frames]) if frames else ((), ())
    coded = range_coder.encode_frames([[f[i : i + step] for i in range(0, len(f), step)] for f in numbers], [len(d) for d in different])
    out = []
    for ids, known, (tables, cs) in zip(frames, different, coded):
        told = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes() + tables.packed())
        checks = [zlib.crc32(ids[i : i + step].astype("<u4").tobytes()) for i in range(0, len(ids), step)]
        heads = b"".join(struct.pack("<III", min(step, len(ids) - step * k), len(c), check) for k, (c, check) in enumerate(zip(cs, checks)))
        out.append(MAGIC + struct.pack("<IIII", len(ids), len(cs), len(known), len(told)) + told + heads + b"".join(cs))
    return out


def unpacked(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of payloads; a block whose checksum differs is an error."""
    plans, tables, frames, coded, sizes = [], [], [], [], []
    for k, p in enumerate(payloads):
        if p[:4] != MAGIC:
            raise ValueError("not a token frame")
        n, count, different, length = struct.unpack_from("<IIII", p, 4)
        try:
            told = zlib.decompress(p[HEAD : HEAD + length])
        except zlib.error as error:
            raise ValueError("the tables of a token frame are broken") from error
        tables.append(range_coder.Tables.unpacked(told[4 * different :]))
        heads, checks = HEAD + length, []
        at = heads + 12 * count
        for b in range(count):
            size, length, check = struct.unpack_from("<III", p, heads + 12 * b)
            coded.append(p[at : at + length])
            sizes.append(size)
            checks.append(check)
            at += length
        frames += [k] * count
        plans.append((n, np.cumsum(np.frombuffer(told, "<u4", different), dtype=np.int64).astype("<u4"), checks))
    bits = range_coder.bits_of(max((len(t.shares) for t in tables), default=1))
    decoded = iter(range_coder.decode(coded, sizes, bits, tables=tables, frames=np.array(frames, np.int64)))
    out = []
    for n, known, checks in plans:
        parts = []
        for check in checks:
            ids = known[next(decoded)]
            if zlib.crc32(ids.tobytes()) != check:
                raise ValueError("a token block does not match its checksum")
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        if len(ids) != n:
            raise ValueError("a token frame is incomplete")
        out.append(ids)
    return out


def frames(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Documents by id, cut into frames and coded."""
    kind = docs.schema["doc_id"].dataType
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        encoder, shard, start, number = worker_encoder(path), TaskContext.get().partitionId(), 0, 0
        done, held = [], 0
        ids, sizes, parts, n = [], [], [], 0

        def rows():
            nonlocal start, number, done, held
            if not done:
                return
            payloads = packed([d[2] for d in done])
            starts = start + np.cumsum([0, *[len(d[2]) for d in done]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(done), pa.int32()), pa.array(range(number, number + len(done)), pa.int64()), pa.array(starts[:-1], pa.int64()), pa.array([len(d[2]) for d in done], pa.int64()),
                 pa.array([d[0] for d in done], pa.list_(id_type)), pa.array([d[1] for d in done], pa.list_(pa.int64())), pa.array(payloads, pa.binary())],
                ["shard", "frame", "shard_start", "n_ids", "doc_ids", "sizes", "payload"],
            )
            start, number, done, held = int(starts[-1]), number + len(done), [], 0

        def close():
            nonlocal ids, sizes, parts, n, held
            if ids:
                done.append((ids, sizes, np.concatenate(parts)))
                held += n
                ids, sizes, parts, n = [], [], [], 0

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            names = iter(batch.column("doc_id").to_pylist())
            for texts in chunks(batch.column("text")):
                coded, counts = encoder.ids(texts, end_id)
                at = 0
                for size in counts.tolist():
                    if n and n + size > FRAME_IDS:
                        close()
                        if held >= HELD_IDS:
                            yield from rows()
                    ids.append(next(names))
                    sizes.append(size)
                    parts.append(coded[at : at + size])
                    at += size
                    n += size
        close()
        yield from rows()

    name = kind.simpleString()
    return ordered.mapInArrow(write, f"shard int, frame bigint, shard_start bigint, n_ids bigint, doc_ids array<{name}>, sizes array<bigint>, payload binary")


def written(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID) -> str:
    """Write the token files of ``docs`` and return their folder."""
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    frames(docs, path or vocabulary_path(), end_id).write.option("compression", "uncompressed").parquet(folder)
    return folder


def read(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the token files of a folder."""
    stored = spark.read.parquet(folder)
    # One row per shard, so at most one per task of the writing job.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = stored.join(F.broadcast(offsets), "shard").select((F.col("offset") + F.col("shard_start")).alias("start"), "n_ids", "doc_ids", "sizes", "payload")
    kind = stored.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches):
        for batch in batches:
            at, counts = 0, batch.column("n_ids").to_pylist()
            while at < len(counts):
                to, held = at + 1, counts[at]
                while to < len(counts) and held + counts[to] <= HELD_IDS:
                    held += counts[to]
                    to += 1
                part = batch.slice(at, to - at)
                starts, sizes, checks = [], [], []
                for ids, start, lengths in zip(unpacked(part.column("payload").to_pylist()), part.column("start").to_pylist(), part.column("sizes").to_pylist()):
                    ends = np.cumsum([0, *lengths])
                    starts += (start + ends[:-1]).tolist()
                    sizes += lengths
                    checks += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_ids").flatten(), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(checks, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                at = to

    return placed.mapInArrow(decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files, then read every document's place, length and checksum back from them."""
    return read(docs.sparkSession, written(docs, None, path, end_id))
