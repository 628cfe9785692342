"""Chat formatting, the source divergence audit and the dataset manifest."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute_audits as brute
from stowage.llm import chat_format, divergence, manifest, queries
from stowage.llm.transducer import Transducer

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def tuples(df):
    return Counter(tuple(r) for r in df.collect())


# Chat formatting.
def plain_escape(text):
    text = text.replace("\\", "\\\\")
    out, i = "", 0
    while i < len(text):
        hit = any(text.startswith(c, i) for c in chat_format.CONTROL)
        out += text[i] + "\\" * hit
        i += 1
    return out


def turn_length(role, text):
    return len("<|im_start|><|im_sep|><|im_end|>") + len(plain_escape(role)) + len(plain_escape(text))


def test_chats_against_plain_turns(spark):
    rng = random.Random(4)
    pieces = [*chat_format.CONTROL, "\\", "\\\\", "<", "[", "|>", "s>", " ", "\n", "é", "𝒳", "x", "ok", "\x00", "$1", "<|im_"]
    rows = [(rng.randrange(40), rng.randrange(6), rng.choice(["user", "assistant", "system", "a\\<s>b\n", ""]), "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for _ in range(400)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "last"), (None, 0, None, None), (50, None, None, None), (51, 1, "assistant", "same"), (51, 1, "assistant", "same")]
    rows += [(52, 0, "assistant", "long </s> " * 100_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", formatted string").repartition(5)
    made = chat_format.formatted(df)
    got = {r[0]: tuple(r)[1:] for r in chat_format.digests(made).collect()}
    assert got == brute.conversations(rows, turn_length)
    for r in made.collect():
        for c in chat_format.CONTROL:
            n = 1 if c in ("<s>", "</s>") else r.formatted.count("<|im_end|>") if c.startswith("<|im_") else 0
            assert r.formatted.count(c) == n


def test_chat_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r)[1:] for r in queries.op11_chat_formatting(spark, FOLDER).collect()}
    assert got == brute.conversations(rows, turn_length)


def test_chat_parts_become_placeholders(spark):
    parts = [
        {"type": "text", "text": "see <|image|> "},
        {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        None,
        {"type": "text", "text": None},
        {"type": "audio", "ref": "b.wav", "seconds": 2.5},
        {"type": "document", "ref": "c.pdf", "pages": 3},
        {"type": "video", "ref": "d.mp4"},
        {"type": "text", "text": "?"},
    ]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [parts[1], parts[0]]), (1, 2, "user", None), (1, 3, "user", []), (2, 0, "assistant", [parts[0], parts[1], parts[7]])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, content array<{chat_format.PART}>")
    one, two = chat_format.formatted(df, "content").orderBy("conv_id").collect()
    body = "see <\\|image|> <|image|><|audio|><|document|><|document|>?"
    empty = "<|im_start|>user<|im_sep|><|im_end|>"
    assert one.formatted == f"<s><|im_start|>user<|im_sep|>{body}<|im_end|><|im_start|>assistant<|im_sep|><|image|>see <\\|image|> <|im_end|>{empty}{empty}</s>"
    assert [(a.kind, a.ref, a.n_tokens) for a in one.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 768), ("document", "d.mp4", 256), ("image", "a.png", 3)]
    assert one.n_attachment_tokens == 1093 == sum(a.n_tokens for a in one.attachments)
    for r in (one, two):
        marks = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
        assert all(r.formatted[a.at :].startswith(marks[a.kind]) for a in r.attachments)
        assert [a.at for a in r.attachments] == sorted(a.at for a in r.attachments)
    assert [r.formatted[s.start : s.end] for r in (one, two) for s in r.loss] == ["see <\\|image|> ", "see <\\|image|> ", "?"]


def test_chats_of_an_empty_table(spark):
    assert chat_format.digests(chat_format.formatted(spark.createDataFrame([], TURNS))).collect() == []


# The transducer and the divergence audit.
def test_transducer_numbers_its_terms():
    rng = random.Random(5)
    terms = sorted({bytes(rng.choice(b"ab\xc3\xa9z\xff\x80") for _ in range(rng.randrange(1, 9))) for _ in range(3000)} | {b"a" * 5000})
    machine = Transducer(terms)
    assert machine.n_terms == len(terms)
    others = [b"", b"a" * 4999, b"a" * 5001, b"q", *[t + b"a" for t in terms[:200] if t + b"a" not in set(terms)]]
    asked = terms + others
    offsets = np.cumsum([0, *map(len, asked)])
    got = machine.ordinals(np.frombuffer(b"".join(asked), np.uint8), offsets)
    assert got.tolist() == [*range(len(terms)), *[-1] * len(others)]


def test_transducer_shares_ends():
    stems = [f"w{i:03d}".encode() for i in range(500)]
    machine = Transducer(sorted(s + e for s in stems for e in (b"ing", b"ed", b"s")))
    # One state for each ending's letters, one for the digits' last place: far fewer than the 8,000 letters.
    assert len(machine.final) < 40 and machine.n_terms == 1500
    with pytest.raises(ValueError, match="ascend"):
        Transducer([b"b", b"a"])
    assert Transducer([]).ordinals(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [-1]


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_plain_sums(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(divergence, "SHARD_TERMS", 3)
        monkeypatch.setattr(divergence, "HELD_BYTES", 1000)
        monkeypatch.setattr(divergence, "HELD_SHARES", 8)
    rng = random.Random(6)
    words = ["The", "the", "É", "é", "straße", "x", "x1y", "naïve-word", "日本語", "\x7f", "123", "K", "İ", "a b", "zz\x00zz", "𝒳"]
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(words[: 4 + i % 13]) for _ in range(rng.randrange(30)))
        rows.append((rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "é", None, "", "S1"]), rng.choice([text, text, None])))
    rows += [("xx", "only", "too few words"), ("xx", "b", None), ("en", "mute", "... 123"), ("en", "s1", "the " * 50_000)] + [("en", "s1", "same text")] * 12
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int").repartition(6)
    assert tuples(divergence.audited(df)) == Counter(brute.divergence(rows))


def test_divergence_query_on_the_given_table(spark):
    rows = [(r.lang, r.source, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert tuples(queries.op12_source_divergence(spark, FOLDER)) == Counter(brute.divergence(rows))


def test_divergence_of_empty_tables(spark):
    assert divergence.audited(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    one = divergence.audited(spark.createDataFrame([(None, None, None)], "lang string, source string, text string"))
    assert one.collect() == []


def test_shares_are_exact():
    rng = random.Random(7)
    counts = np.array([rng.randrange(10**15) for _ in range(2000)])
    whole = np.array([int(c) + rng.randrange(1, 10**15) for c in counts])
    assert divergence.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 2) // int(w) for c, w in zip(counts, whole)]


# The manifest.
def test_manifest_against_plain_levels(spark):
    rng = random.Random(8)
    rows = []
    for source, n in (("hot", 700), ("b", 82), ("c", 81), ("d", 9), (None, 4), ("", 3), ("é", 2), ("z", 1)):
        for i in range(n):
            text = rng.choice([None, "", "one line", "a\nb\n", "\n", "é\n𝒳"])
            rows.append((rng.randrange(10**6) * rng.choice([1, -1]), source, rng.choice(["en", None, ""]), rng.choice([None, len(text or "")]), text))
    rows += [rows[5]] * 3 + [(None, "hot", None, None, None), (None, "z", "en", 1, "\n"), (7, "hot", "en", 9, "w\n" * 200_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", hash string").repartition(7)
    got = manifest.audited(manifest.newlines_gone(df))
    assert tuples(got) == Counter(brute.manifest(rows))
    assert got.where("NOT verified").count() > 100


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_manifest_of_small_tables(spark, n):
    rows = [(i, f"s{i % 2}", "en", 1, "a\nb") for i in range(n)]
    assert tuples(manifest.audited(manifest.newlines_gone(spark.createDataFrame(rows, DOCS)))) == Counter(brute.manifest(rows))


def test_manifest_of_an_empty_table(spark):
    got = manifest.audited(manifest.newlines_gone(spark.createDataFrame([], DOCS)))
    assert got.collect() == [] and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_query_on_the_given_table(spark):
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*names).collect()]
    assert tuples(queries.op13_dataset_manifest(spark, FOLDER)) == Counter(brute.manifest(rows))


def test_manifest_sees_any_altered_field(spark):
    rows = [(i, "s", "en", 3, "abc") for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    got = manifest.audited(manifest.hashed(df, {"lang": F.lit("fr")}, F.col("doc_id") == 17))
    assert [r.doc_id for r in got.where("NOT verified").collect()] == [17]
