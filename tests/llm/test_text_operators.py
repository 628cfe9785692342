"""Token files, quality rules, URL filters, mixing, secrets, languages, pseudonyms, decontamination and the pipeline."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from stowage.llm import decontaminate, language_id, mixing, pii, quality_rules, range_coder, secret_scan, token_output, url_filter
from stowage.llm.storage import stored, tally

SCHEMA = "doc_id bigint, text string"
LONG = "lang " * 30_000


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


# Token files.
def test_coder_round_trips():
    rng = np.random.default_rng(1)
    for lengths, most in (([5, 0, 1, 300, 4096, 17], 50_000), ([1], 1), ([700] * 40, 3), ([2000, 3], 2**32)):
        blocks = [(rng.zipf(1.3, n) % most).astype("u4") for n in lengths]
        bits = range_coder.bits_of(most - 1)
        coded = range_coder.encode(blocks, bits, lanes=7)
        assert all((a == b).all() for a, b in zip(blocks, range_coder.decode(coded, lengths, bits, lanes=64)))


def test_coder_learns():
    repeated = np.tile(np.arange(40, dtype="u4"), 100)
    assert len(range_coder.encode([repeated], 16)[0]) < len(repeated) / 3


def test_broken_blocks_are_found():
    payload = bytearray(token_output.packed([np.arange(9000, dtype="<u4") % 700])[0])
    assert (token_output.unpacked([bytes(payload)])[0] == np.arange(9000) % 700).all()
    payload[-200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_output.unpacked([bytes(payload)])
    with pytest.raises(ValueError, match="frame"):
        token_output.unpacked([b"NONE" + bytes(payload[4:])])


def test_frames_share_their_tables():
    """Ids without order cost about their entropy, as blocks do not learn the shares of ids anew."""
    rng = np.random.default_rng(3)
    odds = 1 / np.arange(1, 20_001)
    odds /= odds.sum()
    frames = [rng.choice(20_000, n, p=odds).astype("<u4") * 3 for n in (200_000, 5, 50_000)]
    payloads = token_output.packed(frames)
    assert all((a == b).all() for a, b in zip(frames, token_output.unpacked(payloads)))
    entropy = -(odds * np.log2(odds)).sum()
    assert 8 * len(payloads[0]) / 200_000 < 1.15 * entropy
    broken = bytearray(payloads[0])
    broken[token_output.HEAD + 9] ^= 1
    with pytest.raises(ValueError, match="tables"):
        token_output.unpacked([bytes(broken)])


def test_words_are_tokenized_once(monkeypatch):
    """Case and marks at the end make no new words for the library, and the ids are those of the whole text."""
    encoder = token_output.Encoder(token_output.vocabulary_path())
    sent, encoded = [], encoder.encoded
    monkeypatch.setattr(encoder, "encoded", lambda texts: sent.extend(texts) or encoded(texts))
    texts = ["Word, word. WORD (word) word's, WORD'S; word!?", "word", None, ""]
    ids, counts = encoder.ids(pa.array(texts), 2)
    assert " ".join(sent).split().count("word") == 1
    odd = ["<|ENDOFTEXT|>x, <|endoftext|>, <|endoftext|", "J\u030c, \u0130. ΑΣ, Σ. ﬁ, x\u0301,", "a'S, a'.s 'll' ''s \u0958\u0915. \u1e9e!", "Ａ, ½x. x½, 7x, x7. \x00x, x\x00,", "ǅ. \u0345x, \u2160, x\u200b, Ⅷ", "\x1cx,\x85y. \u3000z,"]
    for more in ([], odd, [w + m for t in odd for w in t.split(" ") for m in ("", "X", ",.", "'s,", "|>,")]):
        texts += more
        ids, counts = encoder.ids(pa.array(texts), 2)
        whole = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert counts.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]


@pytest.mark.parametrize("frame_ids", [1 << 20, 64])
def test_token_files_hold_the_library_ids(spark, monkeypatch, frame_ids):
    monkeypatch.setattr(token_output, "FRAME_IDS", frame_ids)
    monkeypatch.setattr(token_output, "HELD_IDS", 500)
    rng = random.Random(2)
    texts = [None, "", " \n\t", "It's NOT  1234,ok\u2028x", "e\u0301 \u0301x <|endoftext|> ß\x00y \x1c z", "naïve—\u00a0w", LONG, "x" * 5000]
    texts += [" ".join("".join(rng.choice("abcdé,.'7") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    rows = [(7 * i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r[0]: tuple(r)[1:] for r in token_output.tokenized(frame(spark, rows).repartition(5)).collect()}
    tokenizer, start = token_output.Encoder(token_output.vocabulary_path()).tokenizer, 0
    for doc, text in sorted(rows):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got.pop(doc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_token_output_of_odd_tables(spark):
    assert token_output.tokenized(frame(spark, [])).collect() == []
    rows = [(1, "b", 9), (1, "b", 9), (None, "a", 9), (1, "a b c", 9)]
    got = token_output.tokenized(frame(spark, rows, "doc_id bigint, text string, start bigint")).collect()
    assert sorted((r.start, r.doc_id) for r in got) == [(0, None), (2, 1), (6, 1), (8, 1)]


# Quality rules.
def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    dups, capitals = len(lines) - len(set(lines)), len(re.findall("[A-Z]", text or ""))
    base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    bad = base or 10 * symbols > len(w) or 2 * capitals > chars or chars < 2 * len(w) or chars > 20 * len(w) or 2 * dups > len(lines)
    return len(w), chars, symbols, dups, len(covered), base, not bad


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    texts = [None, "", " \n \x0b\x0c\r\t\n", "a b c", "a b c a b c", "a\x1cb \x85 \u2003 c", LONG, "x" * 100_000, "$ " * 80, "\n\n a\n a\n"]
    for _ in range(60):
        lines = ["".join(word() + rng.choice(["", "", "$", ". "]) + rng.choice(" \t ") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        text = rng.choice(["\n", "\r\n", "\n \n"]).join(lines + lines[: rng.randint(0, 3)])
        texts.append(text.upper() if rng.random() < 0.1 else text)
    rows = list(enumerate(texts)) + [(1, "")]
    got = Counter(tuple(r)[:8] for r in quality_rules.judged(frame(spark, rows)).collect())
    assert got == Counter((d, *plain_quality(t)) for d, t in rows)
    kept = Counter(r.doc_id for r in quality_rules.kept(frame(spark, rows)).collect())
    assert kept == Counter(d for d, t in rows if plain_quality(t)[-1])
    assert quality_rules.judged(frame(spark, [])).collect() == []


def test_rules_are_ordered_by_worth(spark):
    rows = [(i, "$$$ " * 60) for i in range(300)] + [(500 + i, " ".join(f"w{j}x{i}" for j in range(60))) for i in range(300)]
    order = quality_rules.cascade_order(frame(spark, rows))
    assert sorted(order) == sorted(quality_rules.RULES) and order.index("symbols") < order.index("dup_lines")


# URL filters.
URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG/es/1", "https://a.b.example.org/en/12?x#y", "ftp://example.org/en/2", "x://ORG", "x://org/", "http://m.example.com/fr/", "http://example.com/de",
    "http://example.com/de/x", "http://notexample.org/es/", "http://example.org.evil.com/es/", "http://u@example.org/es/", "http://example.org#/es/", "a://b://org/x", "http://é.ORG/É", "http://example.org/es/" + "p" * 5000,
]


def test_url_verdicts(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h")]
    df = frame(spark, rows, "page_id bigint, url string, host string")
    got = sorted(tuple(r) for r in url_filter.judged(df).collect())

    def plain(url):
        m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    want = sorted(((i, *plain(u)) for i, u, _ in rows), key=str)
    assert sorted(got, key=str) == want
    by_join = url_filter.judged(df, most_bytes=0).collect()
    assert sorted((tuple(r) for r in by_join), key=str) == want
    assert url_filter.judged(df.where("false")).collect() == []
    assert {r.verdict for r in url_filter.judged(df, url_filter.rules_frame(spark, [("x/", "block")]).where("false")).collect()} == {"allow"}


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    index = url_filter.Index(url_filter.index_of([("a.b/", "one"), ("b.a/", "two"), ("c/", "three")]))
    assert index.probe(["a.b/", "b.a/", "c.c/", "d/", "c/"]) == ["one", "two", None, None, "three"]


# Mixing.
def test_targets_share_and_fill_up(spark):
    rng = random.Random(4)
    sources = ["b", "a", None, "d", "empty", "ü", "Z"]
    rows = [(i, " ".join(["w"] * (0 if s == "empty" else rng.randint(0, 60))), s) for i in range(2000) for s in [rng.choice(sources + ["a"] * 5)]]
    rows += [(5000, None, "a"), (None, "x y", "b"), (None, "x y", "b")]
    df = frame(spark, rows, "doc_id bigint, text string, source string")
    taken = mixing.copies(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    by_source = defaultdict(float)
    for r in taken:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.n_copies <= 2
        by_source[r.source] += r.size * r.n_copies
    for s in order:
        assert abs(by_source[s] - target[s]) <= 0.15 * sizes[s] + 40
    again = mixing.copies(df.repartition(7)).collect()
    key = lambda r: str((r.doc_id, r.text, r.source, r.n_copies))
    assert sorted(map(key, taken)) == sorted(map(key, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.n_copies for r in taken)
    assert mixing.mix(df.where("false")).collect() == []
    clash = df.withColumns({"size": F.lit("s"), "target": F.lit("t"), "n_copies": F.lit(1)})
    assert mixing.mix(clash).count() == mixed.count() and mixing.mix(clash).first()["size"] == "s"


# Secrets.
def test_guess_costs():
    cost = secret_scan.guess_cost
    assert cost("password") < 2 and cost("aaaaaaaaaaaaaaaa") < 5 and cost("qwertyuiop") < 5 and cost("1998-12-31") < 6
    assert cost("f8Kq2!zRw0Lm") > 15 > cost("summer2019") and cost("") == 0
    assert cost("passwordpassword") < cost("passwordX7q!") < cost("Y3k#passX7q!wr")
    assert cost("xq19991231") < cost("xq48205617")


def test_base_spans_follow_their_patterns(spark):
    rng = random.Random(5)
    parts = ["token", "API_key", "apikey", 'password"', "secret", "passwd", ":", "=", " ", "'", '"', "abcdef", "deadbeef" * 3, "AKIA" + "Q7" * 9, "AKIA12", "\n", "é", "ſecret", "passphrase", "x9$Kq!7Lw2@p", "0123456789abcdef01234567"]
    texts = [None, "", LONG] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    rows = list(enumerate(texts))
    assign = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in secret_scan.scanned(frame(spark, rows)).collect():
        text, spans = texts[r.doc_id] or "", []
        spans += [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == base
    assert secret_scan.scanned(frame(spark, [])).collect() == []


def test_context_values_need_a_high_cost():
    assert secret_scan.joined(secret_scan.findings("login: x9$Kq!7Lw2@p now")) == "guess:0:19"
    assert secret_scan.findings("login: welcome1 and pwd=aaaaaaaaaaaa") == []
    assert secret_scan.findings("the secret is out and the password is hidden") == []


def test_contexts_keep_their_whole_value():
    found = lambda text: secret_scan.joined(secret_scan.findings(text))
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIi"
    # An auth scheme belongs to the context.
    for text in (f"Authorization: Bearer {token} x", f"authorization=token {token} x", f"'Authorization': 'Basic {token}' x", f"login: password: {token}$9 x"):
        assert any(k == 3 and token in text[s:e] for s, k, e in secret_scan.findings(text)), text
    assert found(f"Authorization: Bearer {token} x") == f"guess:0:{22 + len(token)}"
    assert found("Authorization: Bearer") == found("Authorization: Bearer <here>") == found("Authorization: Bearer abc") == ""
    # A base finding takes the place of a guess only if it holds the whole value.
    assert found("password: hunter2!X9$kq#Lw now") == "assign:0:17,guess:0:26"
    assert found("password: f8Kq2zRw0Lm9, now") == "assign:0:22" and found("password: f8Kq2zRw0Lm9! now") == "assign:0:22"
    # A passphrase is the quoted value or the rest of the line.
    assert found("passphrase: correct horse battery staple \nnext") == "guess:0:40"
    assert found('{"passphrase": "correct horse battery staple", "n": 1}') == "guess:2:44"
    assert found("a passphrase is 'correct horse battery staple' there") == "guess:2:45"
    assert found("<p>passphrase = correct horse battery staple</p>") == "guess:3:44"
    assert found('passphrase: "correct horse battery staple') == "guess:0:41"
    assert found("passphrase: <yours> here") == "" and found('passphrase: "abc", "name": "value"') == ""


def test_words_of_the_documents_are_no_secrets(spark):
    words = ["required", "incorrect", "revealed", "username", "erforderlich", "ungültig", "contraseña", "necesario", "obligatoire", "confidentiel"]
    prose = [f"it says {w} here, {w.upper()} and again {w}" for w in words]
    asked = [f"the password is {w}, as told" for w in words] + [f"credentials: {w}" for w in words]
    leaked = "mwqtzcbxnrvp"
    rows = list(enumerate(prose * 3 + asked + [f"login: {leaked}", f"mypwd passphrase: {leaked} fgkqzvxw"] * 9 + [f"odd once {leaked[::-1]}", f"login: {leaked[::-1]}", "login: x9$Kq!7Lw2@p now", None, ""]))
    got = {r.doc_id: r.spans for r in secret_scan.scanned(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        guessed = bool(text) and (leaked in text or text.startswith("login"))
        assert bool(got[i]) == guessed, (text, got[i])
    # Without the documents these words cost as much as chance letters ("user" is a fixed word).
    assert all(secret_scan.guess_cost(w) >= secret_scan.LEAST_COST for w in words if w != "username")


def test_ranked_words_are_bounded(spark):
    rows = [(i, " ".join("w" + "abcdefghij"[j] * 3 for j in range(10) if i % (j + 1) == 0)) for i in range(60)]
    every = secret_scan.word_ranks(frame(spark, rows)).rank
    few = secret_scan.word_ranks(frame(spark, rows), most_words=4).rank
    assert every["waaa"] == 1 and every["wjjj"] == 10 and len(every) == 10 + len(secret_scan.COMMON)
    assert few["waaa"] == 1 and 0 < len(few) - len(secret_scan.COMMON) <= 4
    assert secret_scan.word_ranks(frame(spark, [])).rank == secret_scan.RANK


def test_long_runs_of_contexts_take_linear_time():
    for text in ("login:" * 30_000, "passphrase:" * 20_000, "passphrase: \"" * 20_000, "token bearer " * 20_000, "secret is " * 20_000):
        secret_scan.findings(text)


# Languages.
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_have_no_language(spark):
    rows = [(i, "the cat sat on the mat and looked at the dog " * 3, "en", 0) for i in range(20)] + [(100 + i, "der Hund und die Katze sind nicht im Haus heute " * 3, "de", 0) for i in range(20)]
    rows += [(200, None, "en", 0), (201, "123 !!", None, 0), (202, "", "de", 0), (203, "the dog and the cat sat on the mat", None, 0), (None, "die Katze und der Hund sind im Haus", None, 0), (204, LONG, None, 0), (203, "the dog and the cat sat on the mat", None, 0)]
    df = frame(spark, rows, "doc_id bigint, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred) for r in language_id.identified(df).collect() if r.doc_id is None or r.doc_id >= 200]
    assert sorted(got, key=str) == sorted([(200, "und"), (201, "und"), (202, "und"), (203, "en"), (203, "en"), (204, dict(got)[204]), (None, "de")], key=str)
    unlabelled = language_id.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}
    assert language_id.identified(df.where("false")).collect() == []


def test_only_windows_go_to_the_driver(spark, monkeypatch):
    collect, sizes = type(spark.range(0)).collect, []

    def counted(self):
        rows = collect(self)
        sizes.append(sum(len(v) for r in rows for v in r if isinstance(v, (str, bytes, bytearray))))
        return rows

    monkeypatch.setattr(type(spark.range(0)), "collect", counted)
    rows = [(i, "the cat and the dog " * 5000, "en") for i in range(8)] + [(10 + i, "der Hund und die Katze " * 5000, "de") for i in range(8)]
    langs, network = language_id.learned(frame(spark, rows, "doc_id bigint, text string, lang string"))
    assert langs == ["de", "en"] and sizes and sum(sizes) <= 16 * (language_id.WINDOWS_PER_ROW * language_id.LENGTH + 2)


# Pseudonyms.
def test_feistel_is_a_bijection_that_inverts(spark):
    n = 35 * 9
    there = pii.feistel("id", "35L", "9L", "t", "k")
    rows = spark.range(n).select("id", F.expr(there).alias("out")).withColumn("back", F.expr(pii.feistel("out", "35L", "9L", "t", "k", inverse=True))).collect()
    assert sorted(r.out for r in rows) == list(range(n)) and all(r.back == r.id for r in rows) and any(r.out != r.id for r in rows)


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_values_keep_their_format_and_stay_linked(spark):
    card, dashed, phone, ip, date, mail = "4111111111111111", "5500-0000-0000-0004", "+1 (212) 555-1234", "10.0.200.7", "2020-02-29", "ann.lee@mail.example.com"
    text = f"pay {card}, {dashed}! call {phone}. host {ip}; on {date} or 31/12/1999 mail <{mail}> éann@x.org."
    bad = "4111111111111112 300.1.1.1 2021-02-30 12345 1.2.3.4.5 v4111111111111111"
    rows = [(1, text), (2, f"{card} {ip} {mail}"), (3, bad), (4, None), (5, ""), (6, LONG), (7, "9" * 100_000), (8, "a@" * 30_000)]
    got = {r.doc_id: r for r in pii.masked(frame(spark, rows)).collect()}
    out = got[1].text
    assert (got[1].n_card, got[1].n_phone, got[1].n_ip, got[1].n_date, got[1].n_email) == (2, 1, 1, 2, 2)
    for value in (card, dashed, phone, ip, date, mail, "ann"):
        assert value not in out
    cards = re.findall(r"pay (\d{16}), (\d{4}-\d{4}-\d{4}-\d{4})!", out)[0]
    assert all(luhn(re.sub(r"\D", "", c)) for c in cards)
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\. host (\d{1,3}\.){3}\d{1,3}; on \d{4}-\d\d-\d\d or \d\d/\d\d/\d{4} mail <", out)
    # The same values elsewhere get the same pseudonyms.
    assert got[2].text.split()[0] == cards[0] and got[2].text.split()[1] in out and got[2].text.split()[2] in out
    assert got[3].text == bad and got[4].text is None and got[5].text == "" and got[6].text == LONG and got[7].text == "9" * 100_000
    other = {r.doc_id: r.text for r in pii.masked(frame(spark, rows[:2]), key="another").collect()}
    assert other[2] != got[2].text
    assert pii.masked(frame(spark, [])).collect() == []
    plan = pii.masked(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("ExistingRDD", "") and "Arrow" not in plan


# Values, and the patterns of their pseudonyms.
FORMS = {
    "n_date": [
        ("2024-01-15T10:30:00Z", r"\d{4}-\d\d-\d\dT10:30:00Z"), ("2024-01-15t10:30", r"\d{4}-\d\d-\d\dt10:30"), ("日期2024-01-15晴", r"日期\d{4}-\d\d-\d\d晴"),
        ("15.01.2024.", r"\d\d\.\d\d\.\d{4}\."), ("01/15/2024", r"\d\d/\d\d/\d{4}"), ("_15/01/2024_", r"_\d\d/\d\d/\d{4}_"),
    ],
    "n_phone": [
        ("212-555-0123x4", r"\d{3}-\d{3}-\d{4}x4"), ("(212) 555-0123ext. 77", r"\(\d{3}\) \d{3}-\d{4}ext\. 77"), ("电话212-555-0123请", r"电话\d{3}-\d{3}-\d{4}请"),
        ("1-800-555-1234", r"1-\d{3}-\d{3}-\d{4}"), ("+44 20 7946 0958", r"\+44 \d\d \d{4} \d{4}"), ("+49 30 12345678", r"\+49 \d\d \d{8}"), ("+33 1 23 45 67 89", r"\+33 \d( \d\d){4}"),
        ("+44 (0)20 7946 0958", r"\+44 \(0\)\d\d \d{4} \d{4}"), ("+55 (11) 91234-5678", r"\+55 \(\d\d\) \d{5}-\d{4}"), ("+34612345678", r"\+34\d{9}"), ("+352 27 12 3", r"\+352 \d\d \d\d \d"),
        ("2125550123", r"\d{10}"), ("+49 30 12345678 2024-99-15", r"\+49 \d\d \d{8} 2024-99-15"), ("+44 20 7946 0958 (2 lines)", r"\+44 \d\d \d{4} \d{4} \(2 lines\)"),
    ],
    "n_card": [("3782-822463-10005", r"\d{4}-\d{6}-\d{5}"), ("3782 822463 10005", r"\d{4} \d{6} \d{5}"), ("3056 930902 5904", r"\d{4} \d{6} \d{4}"), ("卡4111111111111111号", r"卡\d{16}号")],
}


def test_more_forms_are_masked_in_their_layout(spark):
    cases = [(name, value, shown) for name, forms in FORMS.items() for value, shown in forms]
    got = {r.doc_id: r for r in pii.masked(frame(spark, [(i, v) for i, (_, v, _) in enumerate(cases)])).collect()}
    for i, (name, value, shown) in enumerate(cases):
        assert {k for k in ("n_card", "n_phone", "n_ip", "n_date", "n_email") if got[i][k]} == {name} and got[i][name] == 1, value
        assert got[i].text != value and re.fullmatch(shown, got[i].text), (value, got[i].text)
        if name == "n_card":
            assert luhn(re.sub(r"\D", "", got[i].text))
    by_value = {v: re.sub(r"\D", "", got[i].text) for i, (_, v, _) in enumerate(cases)}
    assert by_value["+44 20 7946 0958"][2:] == by_value["+44 (0)20 7946 0958"][3:] and by_value["2125550123"] == by_value["电话212-555-0123请"]


def test_numbers_that_are_no_values_stay(spark):
    for text in ("3782-822463-10006", "+999 20 7946 0958", "+210 1234567", "+1 23456", "+1234567890123456", "1700000000", "2120550123", "13/15/2024", "31.02.2024", "15.01.1024", "2024-01-15Tx", "212-555-0123xy", "a2024-01-15", "212-555-0123é", "v1.15.01.2024"):
        row = pii.masked(frame(spark, [(1, text)])).first()
        assert (row.text, row.n_card + row.n_phone + row.n_ip + row.n_date + row.n_email) == (text, 0), text


def test_pseudonyms_of_dates_are_distinct(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(800)]
    texts = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")})
    got = pii.masked(frame(spark, list(enumerate(texts)))).collect()
    assert all(r.n_date == 1 for r in got) and len({r.text for r in got}) == len(texts)


# Decontamination.
def test_leaks_match_all_windows(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(make(rng.choice([1, 3, 5, 9, 20, 35, 59]))) for i in range(25)} | {90: "", 91: None, 92: "same words twice same words twice same words twice"}
    docs = {}
    for d in range(120):
        w = make(rng.randint(0, 120))
        if rng.random() < 0.7:
            planted = (items[rng.randrange(25)]).split()
            for _ in range(rng.randint(0, 3)):
                planted[rng.randrange(len(planted))] = rng.choice(vocabulary)
            at = rng.randint(0, len(w))
            w = w[:at] + [x.upper() if rng.random() < 0.2 else x for x in planted] + w[at:]
        docs[d] = rng.choice([" ", "\n", " \t "]).join(w)
    docs |= {500: None, 501: "", 502: items[3], 503: " ".join(items[4].split()[1:])}
    got = decontaminate.leaks(frame(spark, list(docs.items())), frame(spark, list(items.items()), "item_id bigint, text string")).collect()
    want = brute.leaks(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)
    in_blocks = decontaminate.leaks(frame(spark, list(docs.items())), frame(spark, list(items.items()), "item_id bigint, text string"), most_items=7).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, got))


def test_items_with_repeats_leak_as_well(spark):
    rng = random.Random(9)
    make = lambda n: ["".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(n)]
    items, docs = {}, {}
    for i in range(60):
        start = make(72)
        # One shingle is there eight times; the document lacks all of them and is still similar enough.
        items[i] = " ".join(start + ["again"] * 12)
        docs[i] = " ".join(make(i % 5) + start + ["again"] * 4 + make(8 + i % 7))
        table = make(12) + ["|", "-"] * 20
        items[100 + i] = " ".join(table + make(30))
        docs[100 + i] = " ".join(table[:12] + ["|", "-"] * (20 - i % 8) + items[100 + i].split()[-30:] + make(20))
    got = decontaminate.leaks(frame(spark, list(docs.items())), frame(spark, list(items.items()), "item_id bigint, text string")).collect()
    want = brute.leaks(docs, items)
    assert all((i, i) in want for i in range(60))
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(3)
    words = [rng.integers(1, 2**63, 30).astype(np.uint64) for _ in range(50)]
    items = decontaminate.Items(list(range(50)), words)
    for k in range(50):
        flips = rng.choice(64, decontaminate.RADIUS, replace=False)
        f = items.prints[k] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        near = items.near(f)
        brute_force = np.flatnonzero(np.bitwise_count(items.prints ^ f) <= decontaminate.RADIUS)
        assert k in near and near.tolist() == brute_force.tolist()


def test_clean_keeps_columns_and_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "x " + item, "a"), (1, "other text", "b"), (None, item, "c"), (None, "fine", "d"), (2, None, "e"), (2, None, "e")]
    df = frame(spark, rows, "doc_id bigint, text string, item_id string")
    kept = decontaminate.clean(df, frame(spark, [(1, item)], "item_id bigint, text string"))
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, "other text"), (None, "fine"), (2, None), (2, None)])
    nothing = frame(spark, [], "item_id bigint, text string")
    assert decontaminate.clean(df, nothing).count() == 6 and decontaminate.clean(df.where("false"), nothing).count() == 0


# Helpers and the pipeline.
def test_tally_counts_everything(spark):
    df = spark.range(5000).selectExpr("id % 37 AS v")
    counts = tally(df, 16, lambda batch: iter([batch.column("v").to_numpy()]))
    assert counts.sum() == 5000 and counts[:37].tolist() == [136] * 5 + [135] * 32


def test_pipeline_stages_against_plain_steps(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kinds = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    sources = {r.doc_id: r.source for r in docs.collect()}
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "step")
        steps.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == kinds
    ids = [sorted(r.doc_id for r in s.collect()) for s in steps]
    good = [d for d, t in sorted(texts.items()) if plain_quality(t)[-1]]
    assert ids[0] == good
    single = [d for d, (_, c) in brute.components({d: texts[d] for d in good}).items() if c == d]
    assert ids[1] == sorted(single)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    leaked = {d for d, _ in brute.leaks({d: texts[d] for d in single}, items)}
    clean = sorted(set(single) - leaked)
    assert ids[2] == clean
    wanted = {r.doc_id: r.n_copies for r in mixing.copies(steps[2]).collect()}
    assert Counter(ids[3]) == Counter({d: n for d, n in wanted.items() if n}) and {sources[d] for d in clean}
    tokenizer, start = token_output.Encoder(token_output.vocabulary_path()).tokenizer, 0
    rows = sorted(steps[4].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == ids[3]
    for r in rows:
        n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
        assert (r.start, r.n_tokens) == (start, n)
        start += n


def test_pipeline_of_odd_tables(spark):
    folder = "/root/testdata/sf0.001"
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    same, other = prose(80), prose(80)
    rows = [
        (1, same, "en", None), (1, same, "en", None), (2, same + " end", "en", "a"), (None, other, None, "a"), (None, None, "en", "a"), (3, "", None, None),
        (4, "few words", "en", "b"), (5, prose(60) + " " + item + " " + prose(60), "en", "b"), (6, prose(3000), "en", "b"), (7, prose(70), "de", None),
    ]
    # Names that the stages use themselves.
    extra = ["size", "target", "row_key", "place", "single", "n_words", "start", "key"]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in extra)
    df = frame(spark, [(*r, *extra) for r in rows], schema)
    docs, kept = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "odd")
        assert docs.columns == df.columns
        assert all([r[n] for n in extra] == extra for r in docs.collect())
        kept.append(Counter(r.doc_id for r in docs.collect()))
    assert kept[0] == Counter({1: 2, 2: 1, None: 1, 5: 1, 6: 1, 7: 1})
    assert kept[1] == Counter([1, None, 5, 6, 7]) and kept[2] == Counter([1, None, 6, 7])
    assert set(kept[3]) <= set(kept[2])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert Counter(r.doc_id for r in out.collect()) == kept[3]
    empty = df.where("false")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, empty, folder)
        assert made.collect() == [] and (made.columns == df.columns or "n_tokens" in made.columns)
