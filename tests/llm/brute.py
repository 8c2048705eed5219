"""Plain Python versions of what the operators compute."""

import hashlib
from collections import Counter

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text, width):
    words = (text or "").encode().translate(LOWER).split()
    if len(words) >= width:
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    return {tuple(words)} if words else set()


def components(texts: dict, width: int, percent: int = 80) -> dict:
    sets = {k: shingle_set(t, width) for k, t in texts.items()}
    own = {k: k for k in sets}

    def find(k):
        while own[k] != k:
            k = own[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                own[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def cut(texts: list, length: int = 200) -> list:
    """For each text its kept bytes, number of removed bytes and of spans."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((rest, sum(gone), spans))
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
