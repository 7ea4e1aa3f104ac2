"""Plain versions of the operators, for small inputs."""

import re

import numpy as np
import xxhash

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(text):
    return WORD.findall(ascii_lower(text or ""))


def spaced_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def fingerprint(text, size):
    words = spaced_words(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups(prints, distance=4):
    """Smallest position reachable from each."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(prints))]


def removed(sequences, length, earliest):
    """For each sequence which units lie in repeated windows."""
    starts = {}
    for number, units in enumerate(sequences):
        for k in range(len(units) - length + 1):
            starts.setdefault(tuple(units[k : k + length]), []).append((number, k))
    marks = [np.zeros(len(units), bool) for units in sequences]
    for places in starts.values():
        for number, k in sorted(places)[1:] if earliest else places if len(places) > 1 else []:
            marks[number][k : k + length] = True
    return marks
