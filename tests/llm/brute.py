"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass")).hexdigest()


def removed(texts, length=400):
    """Per text (bytes): n_bytes, n_removed, n_spans, sha of the rest."""
    seen = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(np.int8), 0]) == 1))
        out.append((len(t), int(gone.sum()), spans, sha(np.frombuffer(t, np.uint8)[~gone].tobytes())))
    return out


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(rows):
    """{doc_id: (hex, component)} for rows (doc_id, text) with distinct ids."""
    rows = sorted(rows)
    fp = np.array([fingerprint(t) for _, t in rows], np.uint64)
    pairs = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[:i]) <= 3).tolist()]
    comp = components(len(rows), pairs)
    return {d: (f"{int(f):016x}", rows[c][0]) for (d, _), f, c in zip(rows, fp, comp)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base(text):
    """Per kind, the spans."""
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }


def base_digest(text):
    return sha(",".join(f"{k}:{a}:{b}" for k, spans in base(text).items() for a, b in spans))
