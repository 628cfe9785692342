"""Plain restatements of the chat template, the divergence audit and the Merkle manifest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def divergence(rows, least_docs=10, top=10) -> list:
    """(lang, source, part, item, value, rank) from (lang, source, text)."""
    found, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(UPPER) for t in TERM.findall(text or "")]
        found[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted((t for t, n in found[lang].items() if n >= least_docs), key=str.encode)

        def share(counter, kept=kept):
            whole = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 1_000_000_000 * (counter[t] + 2) // whole for t in kept}

        p = {s: share(counts[lang, s]) for s in names}
        everything = Counter()
        for s in names:
            everything.update(counts[lang, s])
        q = share(everything)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return out


def manifest(rows) -> list:
    """(doc_id, leaf, subroot, root, proof, folded root, verified) from (doc_id, source, lang, n_chars, text), by levels of lists."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(start):
        """Levels of a tree, and per leaf its siblings by level: (before, after)."""
        levels, ways = [start], [[] for _ in start]
        while len(levels[-1]) > 1:
            row = levels[-1]
            for i in range(len(start)):
                at = i // 3 ** (len(levels) - 1)
                run = at // 3 * 3
                ways[i].append((row[run:at], row[at + 1 : run + 3]))
            levels.append([sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
        return levels[-1][0], ways

    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append(row)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for s in order:
        held = sorted(trees[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made.append((held, *climb([leaf(r) for r in held])))
    root, top = climb([m[1] for m in made])
    out = []
    for (held, subroot, ways), rest in zip(made, top):
        for row, way in zip(held, ways):
            d, s, lang, n, text = row
            even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
            h = leaf((d, s, lang, n, text.replace("\n", "") if even and text is not None else text))
            proof = ""
            for before, after in way + rest:
                h = sha("".join(before) + h + "".join(after))
                proof += "".join(before + after)
            out.append((d, leaf(row), subroot, root, sha(proof), h, h == root))
    return out


def conversations(rows, chars) -> dict:
    """{conv_id: (turns, digest, learned characters, digest, formatted characters)} from (conv_id, turn, role, text); ``chars(role, text)`` is the length of a turn."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        learned = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha(said), len(learned), sha(learned), 7 + sum(chars(r, t) for _, _, r, t in turns))
    return out
