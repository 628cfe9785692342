"""Context-mixing range coder for token ids, many blocks at once in numpy, in two passes over the blocks of a frame.

A block starts from a fresh memory and can be decoded alone, with the tables of its frame. Three orders predict the next id: order 2 the id that last
followed the last two, order 1 the id that last followed the last one, order 0 each id by how often it comes. Is it order 2's id? If not,
is it order 1's? Each of these questions is put to all three orders: an order answers with the odds that fit what it knows of the
id asked for (its trust in it, whether it has another one in mind, how often the id came in the block), and the three answers are mixed in the
logistic domain by weights kept per trust. An id that neither order has in mind is coded by order 0 alone, where ids that come often get short codes.

The first pass notes what the orders have in mind and what came. From its counts the odds, the weights and order 0's shares of a frame are fitted; they
go with the frame as its ``Tables``, so that the second pass and the decoder only look mixed odds up. All odds drive a range coder of 62 bits with
carries, which writes 32-bit words. Whatever is decoded comes of whole numbers, so that any machine decodes what another coded.

Blocks are lanes: one numpy step codes the t-th id of every lane that has one.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np

# Ids in a block; lanes coded together.
BLOCK = 4096
LANES = 2048
SLOTS_BITS = 10
EMPTY = -4
HASHES = np.uint32(2654435761), np.uint32(2246822519)

# The coder: bits of its interval, of a word, and of the odds of a choice.
RANGE_BITS, WORD_BITS, CHOICE_BITS = 62, 32, 24
LOW_MASK = (1 << RANGE_BITS) - 1
LEAST_WIDTH = 1 << (RANGE_BITS - WORD_BITS)
# Ids without shares are spelled in pieces.
PIECE_BITS = 16

# Mixing: chances of 12 bits, their logarithms in 256ths, weights in 16384ths and within 8.
REACH = 2047
CHANCE = 4096
WEIGHT_BITS = 14
MOST_WEIGHT = 8 << WEIGHT_BITS
# What a question depends on: how often the id came, what one order knows of the other, the trust in the id; the last context asks nothing.
TIMES, OTHERS, TRUSTS = 16, 8, 4
CONTEXTS = TIMES * OTHERS * TRUSTS
TIMES_OF, OTHERS_OF, TRUST_OF = np.unravel_index(np.arange(CONTEXTS), (TIMES, OTHERS, TRUSTS))
VOTES = TIMES + OTHERS + TRUSTS
# Chances of every logarithm, exactly rounded, and the least logarithm that gives a chance.
SQUASH = np.array([min(CHANCE - 1, max(1, round(CHANCE / (1 + (Decimal(-x) / 256).exp())))) for x in range(-REACH - 1, REACH + 1)], np.int64)
STRETCH = (np.searchsorted(SQUASH, np.arange(CHANCE)) - REACH - 1).astype(np.int32)
FITS = 12


def bits_of(most: int) -> int:
    """Bits that ids up to ``most`` need."""
    return max(1, int(most).bit_length())


@dataclass
class Question:
    """The answers of three orders to a yes-or-no question, and the weights that mix them."""

    votes: np.ndarray
    weights: np.ndarray

    def chances(self) -> np.ndarray:
        """The chance of a yes in every context, of ``CHANCE``; none where nothing is asked."""
        said = self.votes[[TIMES_OF, TIMES + OTHERS_OF, TIMES + OTHERS + TRUST_OF]].astype(np.int64)
        sums = (said * self.weights[:, TRUST_OF].astype(np.int64)).sum(0) >> WEIGHT_BITS
        return np.append(SQUASH[np.clip(sums, -REACH, REACH) + (REACH + 1)], 0)

    @classmethod
    def untold(cls) -> Question:
        """Before anything is known: the more trust, the likelier a yes."""
        votes = np.zeros(VOTES, np.int16)
        votes[-TRUSTS:] = STRETCH[[CHANCE // 4, CHANCE // 2, CHANCE * 4 // 5, CHANCE * 15 // 16]]
        return cls(votes, np.full((3, TRUSTS), 1 << WEIGHT_BITS, np.int32))

    @classmethod
    def fitted(cls, yes: np.ndarray, asked: np.ndarray) -> Question:
        """Answers by how often they were right, and the weights of least cost, from counts by context."""
        votes = np.zeros(VOTES, np.int16)
        for first, size, of in ((0, TIMES, TIMES_OF), (TIMES, OTHERS, OTHERS_OF), (TIMES + OTHERS, TRUSTS, TRUST_OF)):
            right, all_ = np.bincount(of, yes, size), np.bincount(of, asked, size)
            votes[first : first + size] = STRETCH[np.clip((CHANCE * (right + 0.4) / (all_ + 0.8)).astype(np.int64), 1, CHANCE - 1)]
        said = votes[[TIMES_OF, TIMES + OTHERS_OF, TIMES + OTHERS + TRUST_OF]] / 256
        weights = np.full((3, TRUSTS), 0.4)
        for trust in range(TRUSTS):
            at = np.flatnonzero((TRUST_OF == trust) & (asked > 0))
            v, n, hits, w = said[:, at], asked[at], yes[at], weights[:, trust]
            for _ in range(FITS if len(at) else 0):
                p = 1 / (1 + np.exp(-np.clip(w @ v, -8, 8)))
                step = np.linalg.solve((v * (n * p * (1 - p))) @ v.T + np.eye(3), v @ (hits - n * p) - (w - 0.4))
                w = np.clip(w + np.clip(step, -0.5, 0.5), -8, 8)
            weights[:, trust] = w
        return cls(votes, np.clip(np.round(weights * (1 << WEIGHT_BITS)), -MOST_WEIGHT, MOST_WEIGHT).astype(np.int32))


@dataclass
class Tables:
    """What a frame's blocks are coded by: both questions, and the shares of ids 0, 1, ... in order 0 (none: ids are spelled)."""

    two: Question
    one: Question
    shares: np.ndarray

    @classmethod
    def untold(cls) -> Tables:
        return cls(Question.untold(), Question.untold(), np.zeros(0, np.int64))

    @property
    def share_bits(self) -> int:
        return share_bits(len(self.shares))

    def packed(self) -> bytes:
        parts = [x.astype(kind).tobytes() for q in (self.two, self.one) for x, kind in ((q.votes, "<i2"), (q.weights, "<i4"))]
        return b"".join([*parts, self.shares.astype("<u4").tobytes()])

    @classmethod
    def unpacked(cls, data: bytes) -> Tables:
        at, questions = 0, []
        for _ in range(2):
            votes = np.frombuffer(data, "<i2", VOTES, at)
            weights = np.frombuffer(data, "<i4", 3 * TRUSTS, at + 2 * VOTES).reshape(3, TRUSTS)
            questions.append(Question(votes, weights))
            at += 2 * VOTES + 12 * TRUSTS
        shares = np.frombuffer(data, "<u4", -1, at).astype(np.int64)
        if len(shares) and (shares.min() < 1 or shares.sum() != 1 << share_bits(len(shares))):
            raise ValueError("the shares of ids do not add up")
        return cls(*questions, shares)


def share_bits(ids: int) -> int:
    """All shares of so many ids add up to two to the power of this."""
    return max(10, ids.bit_length() + 2)


def shared_out(counts: np.ndarray) -> np.ndarray:
    """Shares in proportion to counts, one at least."""
    if not len(counts):
        return np.zeros(0, np.int64)
    total = 1 << share_bits(len(counts))
    out = 1 + counts * (total - len(counts)) // max(1, int(counts.sum()))
    out[np.argmax(counts)] += total - out.sum()
    return out


class Merged:
    """The tables of several frames side by side; a lane looks up its frame's."""

    def __init__(self, tables: list[Tables], frames: np.ndarray):
        self.spelled = not len(tables[0].shares)
        if any(self.spelled != (not len(t.shares)) for t in tables):
            raise ValueError("frames with and without shares are not coded together")
        self.two = np.concatenate([t.two.chances() for t in tables])
        self.one = np.concatenate([t.one.chances() for t in tables])
        self.context_base = (frames * (CONTEXTS + 1)).astype(np.int32)
        sizes = [len(t.shares) for t in tables]
        self.ids_base = (np.cumsum([0, *sizes])[:-1])[frames]
        self.shares = np.concatenate([t.shares for t in tables])
        self.before = np.concatenate([np.cumsum(t.shares) - t.shares for t in tables])
        self.bits = np.array([t.share_bits for t in tables], np.int64)[frames]
        self.tables, self.frames = tables, frames

    def choice(self, c2: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``1 << CHOICE_BITS``: where the ids of order 2 and of order 1 end."""
        base = self.context_base[: len(c2)]
        two = self.two.take(base + c2)
        first = two << (CHOICE_BITS // 2)
        return first, first + (CHANCE - two) * self.one.take(base + c1)

    def ids_by_place(self) -> tuple[np.ndarray, np.ndarray]:
        """Which id has each place among the shares, frame after frame, and each lane's first place."""
        sizes = [1 << t.share_bits for t in self.tables]
        places = [np.repeat(np.arange(len(t.shares), dtype=np.int32), t.shares) for t in self.tables]
        return np.concatenate(places), (np.cumsum([0, *sizes])[:-1])[self.frames]


class Memory:
    """What the orders have in mind in some lanes, in flat tables."""

    def __init__(self, lanes: int, bits: int):
        # An entry is an id and two bits of trust; EMPTY predicts nothing.
        self.kind = np.int32 if bits < 30 else np.int64
        self.one = np.full(lanes << SLOTS_BITS, EMPTY, self.kind)
        self.two = np.full(lanes << SLOTS_BITS, EMPTY, self.kind)
        self.came = np.zeros(lanes << SLOTS_BITS, np.uint8)
        self.base = np.arange(lanes, dtype=np.int64) << SLOTS_BITS

    def hashed(self, ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint32) * HASHES[0]) >> np.uint32(32 - SLOTS_BITS)

    def look(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts of both questions after the ids ``last`` and ``before`` it."""
        n = len(last)
        base = self.base[:n]
        mixed = last.astype(np.uint32) * HASHES[0]
        self.at1 = base + (mixed >> np.uint32(32 - SLOTS_BITS))
        self.at2 = base + ((mixed + before.astype(np.uint32) * HASHES[1]) >> np.uint32(32 - SLOTS_BITS))
        self.e1, self.e2 = e1, e2 = self.one.take(self.at1), self.two.take(self.at2)
        self.id1, self.id2 = id1, id2 = e1 >> 2, e2 >> 2
        self.t1, self.t2 = t1, t2 = e1 & 3, e2 & 3
        agree, has2 = id1 == id2, e2 >= 0
        times1, times2 = self.came.take(base + self.hashed(id1)), self.came.take(base + self.hashed(id2))
        both = (t1 << 2) | t2
        c2 = np.where(has2, (times2.astype(np.int32) << 5) + (agree.astype(np.int32) << 4) + both, CONTEXTS)
        c1 = np.where((e1 >= 0) & ~agree, (times1.astype(np.int32) << 5) + (has2.astype(np.int32) << 4) + ((t2 << 2) | t1), CONTEXTS)
        return c2, c1

    def note(self, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Note what came: right predictions gain trust, wrong ones lose it and then give way to a fresh entry. Returns whether orders 2 and 1 were right."""
        fresh, right = (now << 2) | 1, []
        for table, at, entry, trust, id_ in ((self.two, self.at2, self.e2, self.t2, self.id2), (self.one, self.at1, self.e1, self.t1, self.id1)):
            right.append(id_ == now)
            table[at] = np.where(right[-1], entry + (trust < 3), np.where(trust > 1, entry - 1, fresh))
        at = self.base[: len(now)] + self.hashed(now)
        self.came[at] = np.minimum(self.came.take(at) + np.uint8(1), np.uint8(TIMES - 1))
        return right[0], right[1]


def longest_first(lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Lanes by falling length, and how many are at work at each step."""
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max()) if len(lengths) else 0
    return order, (len(lengths) - np.cumsum(np.bincount(lengths, minlength=most + 1)))[:most].tolist()


class Seen:
    """The first pass over blocks: at every id the contexts of both questions, and who had it in mind (0 order 2, 1 order 1, 2 neither)."""

    def __init__(self, blocks: list[np.ndarray], bits: int):
        lengths = np.array([len(b) for b in blocks], np.int64)
        self.bits = bits
        self.order, self.active = longest_first(lengths)
        memory, steps = Memory(len(blocks), bits), len(self.active)
        # Two ids before the first are taken as 0.
        self.ids = np.zeros((steps + 2, len(blocks)), memory.kind)
        for lane, i in enumerate(self.order.tolist()):
            self.ids[2 : 2 + lengths[i], lane] = blocks[i]
        self.c2, self.c1 = (np.full((steps, len(blocks)), CONTEXTS, np.int16) for _ in range(2))
        self.who = np.full((steps, len(blocks)), 3, np.int8)
        for t, n in enumerate(self.active):
            now = self.ids[t + 2, :n]
            self.c2[t, :n], self.c1[t, :n] = memory.look(self.ids[t + 1, :n], self.ids[t, :n])
            is_two, is_one = memory.note(now)
            self.who[t, :n] = (np.int8(2) - is_one) * ~is_two

    def counts(self, frames: np.ndarray, n: int) -> np.ndarray:
        """By frame, question and context: how often it was asked, and how often the answer was yes."""
        base = frames[self.order] * (CONTEXTS + 1)
        out = np.zeros((n, 2, 2, CONTEXTS + 1), np.int64)
        for first in range(0, len(self.who), 256):
            part = slice(first, first + 256)
            who = self.who[part]
            for question, contexts, asked in ((0, self.c2, who < 3), (1, self.c1, (who == 1) | (who == 2))):
                at = contexts[part] + base
                for k, rows in enumerate((asked, who == question)):
                    out[:, question, k] += np.bincount(at[rows], minlength=n * (CONTEXTS + 1)).reshape(n, -1)
        return out[..., :CONTEXTS]

    def coded(self, tables: list[Tables], frames: np.ndarray) -> list[bytes]:
        """The second pass: the blocks, coded."""
        merged = Merged(tables, frames[self.order])
        pieces = -(-self.bits // PIECE_BITS) if merged.spelled else 1
        out = Writer(len(self.order), len(self.active) * (1 + pieces) + 4)
        lanes = np.arange(len(self.order))
        for t, n in enumerate(self.active):
            first, second = merged.choice(self.c2[t, :n], self.c1[t, :n])
            who = self.who[t, :n]
            is_two, is_one = who == 0, who == 1
            start = np.where(is_two, 0, np.where(is_one, first, second))
            size = np.where(is_two, first, np.where(is_one, second - first, (1 << CHOICE_BITS) - second))
            out.code(lanes[:n], slice(0, n), CHOICE_BITS, start, size)
            rest = np.flatnonzero(who == 2)
            if not len(rest):
                continue
            value = self.ids[t + 2].take(rest)
            if merged.spelled:
                for k in reversed(range(pieces)):
                    out.code(rest, rest, PIECE_BITS, (value >> (PIECE_BITS * k)) & ((1 << PIECE_BITS) - 1), 1)
            else:
                at = merged.ids_base.take(rest) + value
                out.code(rest, rest, merged.bits.take(rest), merged.before.take(at), merged.shares.take(at))
        made = out.finish()
        result: list[bytes] = [b""] * len(self.order)
        for lane, i in enumerate(self.order.tolist()):
            result[i] = made[lane]
        return result


class Writer:
    """Range coders of some lanes."""

    def __init__(self, lanes: int, words: int):
        self.low, self.width = np.zeros(lanes, np.int64), np.full(lanes, LOW_MASK, np.int64)
        self.words, self.at = np.zeros((lanes, words), np.uint32), np.zeros(lanes, np.int64)

    def code(self, rows: np.ndarray, place: np.ndarray | slice, bits: int | np.ndarray, start: np.ndarray, size: np.ndarray | int) -> None:
        """Narrow the intervals of ``rows`` and write the words that are settled."""
        unit = self.width[place] >> bits
        low, width = self.low[place] + unit * start, unit * size
        over = np.flatnonzero(low > LOW_MASK)
        if len(over):
            self.carry(rows[over])
            low[over] &= LOW_MASK
        small = np.flatnonzero(width < LEAST_WIDTH)
        if len(small):
            r, settled = rows[small], low[small]
            at = self.at[r]
            self.words[r, at] = settled >> (RANGE_BITS - WORD_BITS)
            self.at[r] = at + 1
            low[small] = (settled << WORD_BITS) & LOW_MASK
            width[small] <<= WORD_BITS
        self.low[place], self.width[place] = low, width

    def carry(self, rows: np.ndarray) -> None:
        at = self.at[rows] - 1
        while len(rows):
            self.words[rows, at] += np.uint32(1)
            again = self.words[rows, at] == 0
            rows, at = rows[again], at[again] - 1

    def finish(self) -> list[bytes]:
        rows = np.arange(len(self.low))
        for _ in range(2):
            self.words[rows, self.at] = self.low >> (RANGE_BITS - WORD_BITS)
            self.low = (self.low << WORD_BITS) & LOW_MASK
            self.at += 1
        return [self.words[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.at.tolist())]


class Reader:
    def __init__(self, coded: list[bytes]):
        most = max(len(c) for c in coded) // 4 + 2
        self.words = np.zeros((len(coded), most), np.uint32)
        for i, c in enumerate(coded):
            self.words[i, : len(c) // 4] = np.frombuffer(c, "<u4", len(c) // 4)
        self.most = most
        spare = 2 * WORD_BITS - RANGE_BITS
        self.value = (self.words[:, 0].astype(np.int64) << (WORD_BITS - spare)) | (self.words[:, 1] >> spare)
        # Bits of the last word that the value does not hold yet.
        self.at = np.full(len(coded), 2, np.int64)
        self.width = np.full(len(coded), LOW_MASK, np.int64)

    def accept(self, rows: np.ndarray, place: np.ndarray | slice, value: np.ndarray, width: np.ndarray) -> None:
        small = np.flatnonzero(width < LEAST_WIDTH)
        if len(small):
            r = rows[small]
            at = np.minimum(self.at[r], self.most - 1)
            spare = 2 * WORD_BITS - RANGE_BITS
            words = (self.words[r, at - 1].astype(np.int64) << (WORD_BITS - spare)) | (self.words[r, at] >> spare)
            value[small] = ((value[small] << WORD_BITS) & LOW_MASK) | (words & 0xFFFFFFFF)
            self.at[r] = at + 1
            width[small] <<= WORD_BITS
        self.value[place], self.width[place] = value, width


def decode_lanes(coded: list[bytes], lengths: list[int], bits: int, tables: list[Tables], frames: np.ndarray) -> list[np.ndarray]:
    sizes = np.array(lengths, np.int64)
    order, active = longest_first(sizes)
    memory, source = Memory(len(coded), bits), Reader([coded[i] for i in order.tolist()])
    merged = Merged(tables, frames[order])
    by_place, place_base = merged.ids_by_place()
    ids = np.zeros((len(active) + 2, len(coded)), memory.kind)
    lanes = np.arange(len(coded))
    pieces = -(-bits // PIECE_BITS)
    for t, n in enumerate(active):
        c2, c1 = memory.look(ids[t + 1, :n], ids[t, :n])
        first, second = merged.choice(c2, c1)
        value, unit = source.value[:n], source.width[:n] >> CHOICE_BITS
        first, second = unit * first, unit * second
        is_two, known = value < first, value < second
        start = np.where(is_two, 0, np.where(known, first, second))
        end = np.where(is_two, first, np.where(known, second, unit << CHOICE_BITS))
        now = np.where(is_two, memory.id2, memory.id1)
        source.accept(lanes[:n], slice(0, n), value - start, end - start)
        rest = np.flatnonzero(~known)
        if len(rest):
            if merged.spelled:
                found = np.zeros(len(rest), np.int64)
                for _ in range(pieces):
                    value, unit = source.value.take(rest), source.width.take(rest) >> PIECE_BITS
                    piece = np.minimum(value // unit, (1 << PIECE_BITS) - 1)
                    source.accept(rest, rest, value - unit * piece, unit)
                    found = (found << PIECE_BITS) | piece
            else:
                share = merged.bits.take(rest)
                value, unit = source.value.take(rest), source.width.take(rest) >> share
                found = by_place.take(place_base.take(rest) + np.minimum(value // unit, (1 << share) - 1))
                at = merged.ids_base.take(rest) + found
                source.accept(rest, rest, value - unit * merged.before.take(at), unit * merged.shares.take(at))
            now[rest] = found
        memory.note(now)
        ids[t + 2, :n] = now
    result: list[np.ndarray] = [np.zeros(0, np.int64)] * len(coded)
    for lane, i in enumerate(order.tolist()):
        result[i] = ids[2 : 2 + lengths[i], lane].astype(np.int64)
    return result


def batches(n: int, lanes: int) -> list[slice]:
    return [slice(i, i + lanes) for i in range(0, n, lanes)]


def encode(blocks: list[np.ndarray], bits: int, lanes: int = LANES) -> list[bytes]:
    """Blocks coded without tables of their own, ids spelled."""
    none = np.zeros(lanes, np.int64)
    return [c for part in batches(len(blocks), lanes) for c in Seen(blocks[part], bits).coded([Tables.untold()], none)]


def decode(coded: list[bytes], lengths: list[int], bits: int, lanes: int = LANES, tables: list[Tables] | None = None, frames: np.ndarray | None = None) -> list[np.ndarray]:
    """Blocks by the tables of their frames, or without tables."""
    tables, frames = tables or [Tables.untold()], np.zeros(len(coded), np.int64) if frames is None else frames
    out = []
    for part in batches(len(coded), lanes):
        used, own = np.unique(frames[part], return_inverse=True)
        out += decode_lanes(coded[part], lengths[part], bits, [tables[k] for k in used.tolist()], own)
    return out


def encode_frames(frames: list[list[np.ndarray]], sizes: list[int], lanes: int = LANES) -> list[tuple[Tables, list[bytes]]]:
    """Per frame its tables and coded blocks. The ids of a frame are below its size, and each of them occurs."""
    blocks = [b for bs in frames for b in bs]
    of = np.repeat(np.arange(len(frames)), [len(bs) for bs in frames])
    bits = bits_of(max(sizes, default=1))
    parts = batches(len(blocks), lanes)
    seen = [Seen(blocks[part], bits) for part in parts]
    counts = np.zeros((len(frames), 2, 2, CONTEXTS), np.int64)
    came = [np.zeros(n, np.int64) for n in sizes]
    for part, s in zip(parts, seen):
        counts += s.counts(of[part], len(frames))
        own = of[part][s.order]
        for k in np.unique(own).tolist():
            lanes_of = np.flatnonzero(own == k)
            new = s.ids[2:, lanes_of][s.who[:, lanes_of] == 2]
            came[k] += np.bincount(new, minlength=sizes[k])
    tables = [Tables(*[Question.fitted(c[q, 1].astype(float), c[q, 0].astype(float)) for q in range(2)], shared_out(n)) for c, n in zip(counts, came)]
    coded = []
    for part, s in zip(parts, seen):
        used, own = np.unique(of[part], return_inverse=True)
        coded += s.coded([tables[k] for k in used.tolist()], own)
    coded = iter(coded)
    return [(t, [next(coded) for _ in bs]) for t, bs in zip(tables, frames)]
