"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import itertools
import re

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def simhash(text: str | None) -> int:
    words = WORDS.findall(ascii_lower(text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(docs: list[tuple]) -> set[tuple]:
    """(doc_id, fingerprint, component_id) by comparing all pairs of fingerprints."""
    prints = [(i, simhash(t)) for i, t in docs]
    distinct = sorted({f for _, f in prints})
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            up[root(a)] = root(b)
    least = {}
    for i, f in prints:
        least[root(f)] = min(least.get(root(f), i), i)
    return {(i, f"{f:016x}", least[root(f)]) for i, f in prints}


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered),
            len(words) < 10 or 100 * len(covered) > 20 * len(words))
