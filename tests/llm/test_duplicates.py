"""The n-gram join, components and suffix-array dedup against plain restatements."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from stowage.llm import ngram_join, suffix_dedup
from stowage.llm.components import components
from stowage.llm.suffix_array import common_prefixes, suffix_array
from stowage.llm.words import shingle_sets

SCHEMA = "doc_id bigint, text string"


def near_copies(seed: int, n_docs: int = 60) -> list[tuple]:
    """Documents around a few originals: exact copies, edits on both sides of the threshold, a shared passage, odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for start in range(4):
        original = [word() for _ in range(rng.choice([7, 30, 120, 200]))]
        for _ in range(n_docs // 4):
            copy = list(original)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy) + (" " + passage if start == 3 else ""))
    rows += [None, "", " \t\n", "one two", "One TWO", "one two three four", passage, passage.upper(), "é ü x y z w", "word " * 40]
    ids = list(range(100, 100 + len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_match_all_pairs(spark, seed):
    rows = near_copies(seed)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.components(dict(rows))


def test_rounds_of_hubs_lose_nothing(spark, monkeypatch):
    # Hubs go on as long as anything merges.
    monkeypatch.setattr(ngram_join, "MERGED_PART", 10**6)
    rows = near_copies(4)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.linked(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.components(dict(rows))


def test_shuffle_files_go_between_large_steps(spark, monkeypatch):
    steps, real, let_go = [], ngram_join.stored, ngram_join.release
    monkeypatch.setattr(ngram_join, "stored", lambda df, purpose: (real(df, purpose), steps.append(purpose))[0])
    monkeypatch.setattr(ngram_join, "release", lambda session: (steps.append("-"), let_go(session)))
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words[:50], f"x{k}"])) for k in range(4)] + [(9, "alone in here with five words")]
    assert {(r.doc_id, r.component_id) for r in ngram_join.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (9, 9)}
    assert all(steps[steps.index(step) + 1] == "-" for step in ("signatures", "keys", "wanted", "live"))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.linked(empty).collect() == []
    assert ngram_join.one_of_each(empty).collect() == []
    assert suffix_dedup.removed(empty).collect() == []
    # Repeated rows, null ids, clashing column names.
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, 1, 1), (1, text, 1, 1), (None, text, 2, 2), (5, None, 3, 3), (6, None, 3, 3), (7, "  ", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row bigint, class bigint")
    got = sorted(((r[0], r[1], r[2]) for r in ngram_join.linked(df).collect()), key=str)
    assert got == sorted([(1, 46, 1), (1, 46, 1), (None, 46, 1), (5, 0, 5), (6, 0, 6), (7, 0, 7)], key=str)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 5, 6, 7]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: root(v) for e in edges if e[0] != e[1] for v in e}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80))
def test_suffix_array_is_sorted(values):
    assert suffix_array(np.array(values), 4).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def test_long_runs_and_large_alphabets():
    rng = np.random.default_rng(2)
    for values, symbols in ((np.zeros(300, int), 1), (rng.integers(0, 5000, 400), 5000), (np.tile([2, 1, 0], 100), 3), (rng.integers(0, 256, 3000), 256)):
        assert suffix_array(values, symbols).tolist() == sorted(range(len(values)), key=lambda i: values[i:].tolist())


def test_common_prefixes_by_place():
    data = np.frombuffer(b"abracadabra abracadabra\xff\x00\x00\xffbra", np.uint8)
    order = suffix_array(data.astype(int), 256)
    got = common_prefixes(data, order, 16)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
        n = 0
        while n < 16 and b + n < len(data) and a + n < len(data) and data[a + n] == data[b + n]:
            n += 1
        assert got[b] >= n and (got[b] == n or max(a, b) + n >= len(data))


def passages(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("ab cdéü\n\x00") for _ in range(n))
    shared = [letters(rng.choice([150, 199, 200, 260, 700])) for _ in range(5)]
    rows = []
    for i in range(40):
        text = letters(rng.randint(0, 300))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice(shared) + letters(rng.randint(0, 150))
        rows.append((i, text))
    return rows + [(90, None), (91, ""), (92, "x" * 900), (93, "ab" * 300), (94, rows[3][1]), (95, letters(2000)), (96, "\x00" * 450)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [10**6, 1])
def test_repeats_match_counted_windows(spark, monkeypatch, seed, most):
    # With one context at most per shard, every anchor that has more goes by its windows.
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    rows = passages(seed)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute.without_repeats([t for _, t in rows]))}


def test_long_texts_come_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(6000))
    rows = [(1, text), (2, "q" + text[2900:3400] + "z"), (3, text[:100])]
    monkeypatch.setattr(suffix_dedup, "PART", 1000)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.removed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: w for (d, _), w in zip(rows, brute.without_repeats([t for _, t in rows]))}


def test_shingles_depend_on_content_alone():
    import pyarrow as pa

    texts = ["a b c d e f", None, "", "A  B\tc d\ne f", "a b c d e f g", "é b c d e", "x"]
    sets = list(shingle_sets(pa.array(texts), 5))
    assert [len(s) for s in sets] == [2, 0, 0, 2, 3, 1, 1]
    assert (sets[0] == sets[3]).all() and set(sets[0].tolist()) < set(sets[4].tolist())
    alone = [next(iter(shingle_sets(pa.array([t]), 5))) for t in texts]
    assert all((a == b).all() for a, b in zip(sets, alone))


def test_rows_whose_hashes_meet_both_stay(spark, monkeypatch):
    """As if all rows had one hash: they are told apart by their ids."""
    real = ngram_join.F.xxhash64
    monkeypatch.setattr(ngram_join.F, "xxhash64", lambda *c: ngram_join.F.lit(5).cast("long") if c == ("doc_id", "text") else real(*c))
    rows = [(i, f"some words of the text number {i} and nothing more") for i in range(6)] + [(6, ""), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df).collect()) == list(range(9))
