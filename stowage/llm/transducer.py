"""A minimal acyclic transducer: a sorted set of byte strings, each with its place in the order."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Built from distinct terms in ascending order; equal ends of terms share their states.

    An arc carries a byte and an output: how many terms come before those that go through it, counted from its state. The sum of outputs along a term is
    the term's ordinal. Arcs of a state are consecutive and in byte order, so a bit map of its bytes finds an arc by counting bits.
    """

    def __init__(self, terms: Iterable[bytes]):
        self.register: dict = {}
        self.first, self.counts, self.final = [], [], []
        self.bytes_, self.targets, self.outputs = bytearray(), [], []
        # The states of the last term that may still grow: final, bytes and targets of arcs.
        path, last = [[False, bytearray(), []]], None
        for term in terms:
            shared = 0
            if last is not None:
                if term <= last:
                    raise ValueError("terms must ascend")
                most = min(len(term), len(last))
                while shared < most and term[shared] == last[shared]:
                    shared += 1
            self.close(path, shared)
            for byte in term[shared:]:
                path[-1][1].append(byte)
                path.append([False, bytearray(), []])
            path[-1][0] = True
            last = term
        self.close(path, 0)
        self.root = self.settled(path[0])
        self.n_terms = self.counts[self.root]
        self.pack()

    def close(self, path: list, depth: int) -> None:
        """Settle the states below ``depth``; no later term passes them."""
        while len(path) > depth + 1:
            state = self.settled(path.pop())
            path[-1][2].append(state)

    def settled(self, node: list) -> int:
        """The number of the state that equals ``node``, new or known."""
        final, arcs, targets = node
        key = (final, bytes(arcs), *targets)
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.first)
            self.first.append(len(self.targets))
            self.final.append(final)
            n = int(final)
            for target in targets:
                self.outputs.append(n)
                n += self.counts[target]
            self.bytes_ += arcs
            self.targets += targets
            self.counts.append(n)
        return state

    def pack(self) -> None:
        """Arrays in place of the lists used to build."""
        n = len(self.first)
        self.first = np.array(self.first, np.int64)
        self.final = np.array(self.final, bool)
        self.targets = np.array(self.targets, np.int32)
        self.outputs = np.array(self.outputs, np.int64)
        arcs = np.frombuffer(bytes(self.bytes_), np.uint8)
        state = np.repeat(np.arange(n), np.diff(np.append(self.first, len(arcs))))
        self.bits = np.zeros(4 * n, np.uint64)
        np.bitwise_or.at(self.bits, 4 * state + (arcs >> 6), np.uint64(1) << (arcs & 63).astype(np.uint64))
        ranks = np.cumsum(np.bitwise_count(self.bits).reshape(n, 4), axis=1, dtype=np.int64)
        self.ranks = np.concatenate((np.zeros((n, 1), np.int64), ranks[:, :3]), axis=1).ravel()
        del self.register, self.counts, self.bytes_

    def ordinals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ordinal of each byte string ``data[offsets[i]:offsets[i + 1]]``; -1 where it is no term. All walk in step."""
        n = len(offsets) - 1
        out = np.full(n, -1, np.int64)
        who, at, end = np.arange(n), offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        state, sums = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        while len(who):
            over = at == end
            if over.any():
                hit = over & self.final[state]
                out[who[hit]] = sums[hit]
                on = ~over
                who, at, end, state, sums = who[on], at[on], end[on], state[on], sums[on]
                if not len(who):
                    break
            byte = data[at]
            slot = 4 * state + (byte >> 6)
            bit = np.uint64(1) << (byte & 63).astype(np.uint64)
            word = self.bits[slot]
            on = (word & bit) != 0
            if not on.all():
                who, at, end, state, sums, slot, word, bit = (x[on] for x in (who, at, end, state, sums, slot, word, bit))
            arc = self.first[state] + self.ranks[slot] + np.bitwise_count(word & (bit - np.uint64(1)))
            sums = sums + self.outputs[arc]
            state = self.targets[arc].astype(np.int64)
            at = at + 1
        return out
