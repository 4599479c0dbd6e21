"""Operator 4: personal data by patterns and a linear-chain conditional random field.

Base patterns find well-formed e-mail addresses, IP numbers, cards and phone numbers. A
conditional random field over word-shape features, trained on a small labelled table (made
by a rule below, TRAINING_ROWS rows), adds what the patterns miss: phone numbers without a
country code and secrets such as keys and tokens. It is decoded by Viterbi in numpy batches.

A token is a run without white space. Tokens without a digit, @, +, = or quote have one
and the same shape and are outside (label O) unless they stand next to such a token;
chains therefore run over the other tokens and two neighbours on each side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column, text_slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "local_phone", "secret")
LABELS = ("O", "KNOWN", "B-local_phone", "I-local_phone", "secret")
TRAINING_ROWS = 600
N_SHAPES = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACTIVE = re.compile(r"[0-9@+=\"']")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns; each scan is linear in the text.

    An e-mail's local part is the run to the left of its @, so the search starts at the
    @s; an IP match can only start where a run of digits does.
    """
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((0, a, end))
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def char_classes():
    """Bit masks by code point below 128; 1 << 3 (a letter) beyond."""
    import numpy as np

    table = np.full(129, 1 << 11, np.int32)
    for chars, bit in (("0123456789", 0), ("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("@", 4), (".", 5), ("-_", 6), ("+", 7), ("()", 8), ("\"'", 9), ("=", 10)):
        for c in chars:
            table[ord(c)] = 1 << bit
    table[128] = 1 << 3
    return table


def tokens(text: str, table):
    """starts, ends, class masks, digit counts and active flags of a text's tokens."""
    import numpy as np

    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0xA0) | (cp == 0x3000)
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool)
    cls = table[np.minimum(cp, 128)]
    cls[space] = 0
    mask = np.bitwise_or.reduceat(cls, starts)
    digits = np.add.reduceat((cls == 1).astype(np.int32), starts)
    active = (mask & (1 | 1 << 4 | 1 << 7 | 1 << 9 | 1 << 10)) > 0
    return starts, ends, mask, digits, active


HEX = re.compile(r"(?=[^\W\d_]*[0-9])(?=[0-9]*[A-Za-z])[0-9A-Za-z_-]{16,}")


def shapes(words: list[str], mask, digits):
    """Binary shape features, one row per token."""
    import numpy as np

    n = len(words)
    x = np.zeros((n, N_SHAPES), np.float64)
    size = np.array([len(w) for w in words])
    letters = (mask & 0b1110) > 0
    x[:, 0] = 1
    x[:, 1] = digits > 0
    x[:, 2] = (digits == size) & (size > 0)
    x[:, 3] = letters
    for j, bit in enumerate((4, 5, 6, 7, 8, 9, 10, 11)):
        x[:, 4 + j] = (mask >> bit) & 1
    for j, (a, b) in enumerate(((1, 2), (3, 3), (4, 4), (5, 6), (7, 8), (9, 12), (13, 19), (20, 1 << 30))):
        x[:, 12 + j] = (digits >= a) & (digits <= b)
    x[:, 20] = letters & (digits > 0)
    x[:, 21] = size >= 16
    x[:, 22] = [bool(HEX.search(w)) if d else False for w, d in zip(words, digits.tolist(), strict=True)]
    x[:, 23] = [w.strip("().,;:!?#$%&*").replace("-", "").isdigit() and "-" in w for w in words]
    return x


def windowed(x, first):
    """Features of the previous, the own and the next token; first: True where a chain starts."""
    import numpy as np

    prev = np.zeros_like(x)
    prev[1:] = x[:-1]
    prev[first] = 0
    nxt = np.zeros_like(x)
    nxt[:-1] = x[1:]
    last = np.r_[first[1:], True]
    nxt[last] = 0
    return np.hstack([prev, x, nxt])


def training_table(rows: int = TRAINING_ROWS, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """The labelled table: tokens and label indices, made by a rule."""
    import random

    r = random.Random(seed)

    def digits(n):
        return "".join(r.choice("0123456789") for _ in range(n))

    def word():
        return "".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", "", ",", ".", "!!", "###"])

    def end():
        return r.choice(["", "", "", ".", ",", "###", "%%%", "!!"])

    def hexes(n):
        s = "".join(r.choice("0123456789abcdef") for _ in range(n))
        return s if re.search("[a-f]", s) and re.search("[0-9]", s) else hexes(n)

    makers = [
        lambda: ([f"({digits(3)})", f"{digits(3)}-{digits(4)}" + end()], [2, 3]),
        lambda: ([f"{digits(3)}-{digits(3)}-{digits(4)}" + end()], [2]),
        lambda: ([digits(3), digits(3), digits(4) + end()], [2, 3, 3]),
        lambda: ([f"{digits(3)}.{digits(3)}.{digits(4)}" + end()], [2]),
        lambda: (["+" + digits(1), f"({digits(3)})", f"{digits(3)}-{digits(4)}" + end()], [1, 1, 1]),
        lambda: ([f"+{digits(2)}-{digits(3)}-{digits(6)}" + end()], [1]),
        lambda: ([f"{word().strip('.,!#')}.{digits(2)}@mail{digits(1)}.example.com" + end()], [1]),
        lambda: ([".".join(str(r.randint(0, 255)) for _ in range(4)) + end()], [1]),
        lambda: ([digits(16) + end()], [1]),
        lambda: ([digits(4) for _ in range(4)], [1] * 4),
        lambda: ([r.choice(["token", "key", "secret", "password"]), "=", '"' + hexes(r.choice([20, 24, 32, 40, 64])) + '"' + end()], [0, 0, 4]),
        lambda: ([r.choice(["token", "key"]) + "=" + hexes(r.choice([24, 32, 40])) + end()], [4]),
        lambda: ([r.choice(["key", "x"]), "=", '"' + word().strip(".,!#") + '"'], [0, 0, 0]),
        lambda: ([digits(r.randint(1, 4)) + end()], [0]),
        lambda: ([digits(r.randint(1, 3)) + "." + digits(2)], [0]),
        lambda: ([f"{digits(4)}-{digits(2)}-{digits(2)}"], [0]),
        lambda: ([digits(r.randint(1, 2)), digits(r.randint(1, 2)) + end()], [0, 0]),
        lambda: ([word() + digits(r.randint(1, 3))], [0]),
        lambda: ([f"{word().strip('.,!#')}@{word().strip('.,!#')}"], [0]),
        lambda: ([f"'{word().strip('.,!#')}'"], [0]),
        lambda: ([f"{digits(1)}+{digits(1)}={digits(1)}"], [0]),
        lambda: ([digits(r.randint(1, 4)) + r.choice(["-", "/", ":"]) + digits(r.randint(1, 4))], [0]),
    ]
    out = []
    for i in range(rows):
        words, labels = [], []
        for k in range(r.choice([1, 1, 2])):
            for _ in range(r.randint(0, 3)):
                words.append(word())
                labels.append(0)
            w, y = makers[(i + 7 * k) % len(makers)]()
            words += w
            labels += y
        for _ in range(r.randint(0, 3)):
            words.append(word())
            labels.append(0)
        out.append((words, labels))
    return out


def features(sentences: list[list[str]]):
    """Stacked windowed features of whole sentences and the sentences' lengths."""
    import numpy as np

    table = char_classes()
    xs, firsts, lens = [], [], []
    for words in sentences:
        _, _, mask, digits, _ = tokens(" ".join(words), table)
        xs.append(shapes(words, mask, digits))
        firsts.append(np.r_[True, np.zeros(len(words) - 1, bool)])
        lens.append(len(words))
    return windowed(np.vstack(xs), np.concatenate(firsts)), np.array(lens)


def train(rows=None, steps: int = 160, l2: float = 1e-3) -> dict:
    """Weights of the field by gradient ascent on the penalised likelihood (forward-backward, whole table at a time)."""
    import numpy as np

    rows = rows or training_table()
    x, lens = features([w for w, _ in rows])
    y = np.concatenate([np.array(lab) for _, lab in rows])
    k, n, longest = len(LABELS), len(rows), int(lens.max())
    base = np.cumsum(np.r_[0, lens[:-1]])
    pos = base[:, None] + np.minimum(np.arange(longest), lens[:, None] - 1)
    live = np.arange(longest) < lens[:, None]
    onehot = np.eye(k)[y]
    pairs = np.zeros((k, k))
    inner = np.concatenate([np.arange(b + 1, b + m) for b, m in zip(base, lens, strict=True)])
    np.add.at(pairs, (y[inner - 1], y[inner]), 1)
    w, t = np.zeros((x.shape[1], k)), np.zeros((k, k))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t)]

    def lse(a, axis):
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, steps + 1):
        e = (x @ w)[pos]
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, longest):
            nxt = e[:, i] + lse(alpha[:, i - 1, :, None] + t, 1)
            alpha[:, i] = np.where(live[:, i, None], nxt, alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            nxt = lse(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(live[:, i + 1, None], nxt, 0)
        z = lse(alpha[:, -1], 1)
        gamma = np.exp(alpha + beta - z[:, None, None])[live]
        two = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        two = (two * live[:, 1:, None, None]).sum((0, 1))
        order = pos[live]
        grads = (x[order].T @ (onehot[order] - gamma) / n - l2 * w, (pairs - two) / n - l2 * t)
        for p, g, s in zip((w, t), grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            p += 0.2 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
    return {"w": w, "t": t}


def viterbi(emit, trans, lens):
    """Best labels of chains stacked in emit; all chains advance together, longest first."""
    import numpy as np

    n, k = len(lens), trans.shape[0]
    base = np.cumsum(np.r_[0, lens[:-1]])
    order = np.argsort(-lens, kind="stable")
    b, m = base[order], lens[order]
    out = np.zeros(len(emit), np.int64)
    if not n:
        return out
    back = np.zeros((len(emit), k), np.int8)
    score = emit[b].copy()
    for i in range(1, int(m[0])):
        c = int(np.searchsorted(-m, -i, "left"))  # chains longer than i
        s = score[:c, :, None] + trans
        best = s.argmax(1)
        back[b[:c] + i] = best
        score[:c] = np.take_along_axis(s, best[:, None, :], 1)[:, 0] + emit[b[:c] + i]
    now = score.argmax(1)
    out[b + m - 1] = now
    for i in range(int(m[0]) - 1, 0, -1):
        c = int(np.searchsorted(-m, -i, "left"))
        now[:c] = back[b[:c] + i, now[:c]]
        out[b[:c] + i - 1] = now[:c]
    return out


def decode(texts: list[str | None], model: dict, table) -> list[list[tuple[int, int, int]]]:
    """Spans (kind index, start, end) the field finds in each text."""
    import numpy as np

    spans: list[list] = [[] for _ in texts]
    xs, lens, where = [], [], []
    for d, text in enumerate(texts):
        if not text or not ACTIVE.search(text):
            continue
        starts, ends, mask, digits, active = tokens(text, table)
        hot = np.flatnonzero(active)
        if not len(hot):
            continue
        near = np.unique(np.clip((hot[:, None] + np.arange(-2, 3)).ravel(), 0, len(starts) - 1))
        s, e = starts[near].tolist(), ends[near].tolist()
        first = np.r_[True, np.diff(near) > 1]
        xs.append(windowed(shapes([text[a:b] for a, b in zip(s, e, strict=True)], mask[near], digits[near]), first))
        cut = np.flatnonzero(first)
        lens.append(np.diff(np.r_[cut, len(near)]))
        where += [(d, a, b) for a, b in zip(s, e, strict=True)]
    if not xs:
        return spans
    y = viterbi(np.vstack(xs) @ model["w"], model["t"], np.concatenate(lens)).tolist()
    for i, label in enumerate(y):
        if label in (2, 3):
            d, a, b = where[i]
            text = texts[d]
            while a < b and text[a] not in "(0123456789":
                a += 1
            while b > a and text[b - 1] not in "0123456789)":
                b -= 1
            if label == 3 and i and y[i - 1] in (2, 3) and where[i - 1][0] == d and spans[d] and spans[d][-1][0] == 4:
                spans[d][-1] = (4, spans[d][-1][1], max(b, spans[d][-1][2]))
            elif a < b:
                spans[d].append((4, a, b))
        elif label == 4:
            d, a, b = where[i]
            m = HEX.search(texts[d], a, b)
            if m:
                spans[d].append((5, *m.span()))
    return spans


def all_spans(texts: list[str | None], model: dict, table) -> list[tuple[list, list]]:
    """(base spans, all spans), each sorted by kind and start; added spans never touch a base one or each other."""
    out = []
    for text, more in zip(texts, decode(texts, model, table), strict=True):
        base = sorted(base_spans(text or ""))
        taken = [(a, b) for _, a, b in base]
        full = [*base]
        if more:
            for k, a, b in more:
                if k == 4 and not 7 <= sum(c.isdigit() for c in text[a:b]) <= 11:
                    continue
                if all(b <= x or a >= y for x, y in taken):
                    taken.append((a, b))
                    full.append((k, a, b))
        out.append((base, sorted(full)))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added per row.

    One pass, no shuffle. Null texts are empty; empty texts have no spans; very long texts
    take memory in proportion to one text; repeated rows repeat; other columns are ignored.
    """
    model = model or train()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches):
        import hashlib

        import pyarrow as pa

        table = char_classes()
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                for base, full in all_spans(part.column(1).to_pylist(), shared.value, table):
                    counts = [0] * 4
                    for k, _, _ in base:
                        counts[k] += 1
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(full), len(full) - len(base)))
                cols = zip(*rows, strict=True)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string")).mapInArrow(run, kinds)


def mask(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with each span replaced by its kind in brackets (text only; overlapping spans join under the first kind).

    Null texts stay null; the other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    names = list(docs.columns)
    at = names.index("text")

    def run(batches):
        import pyarrow as pa

        table = char_classes()
        for batch in batches:
            for part in text_slices(batch, at):
                out = []
                texts = part.column(at).to_pylist()
                for text, (_, full) in zip(texts, all_spans(texts, shared.value, table), strict=True):
                    bits, end = [], 0
                    for k, a, b in sorted(full, key=lambda s: (s[1], s[0])):
                        if a >= end:
                            bits += [text[end:a], f"[{KINDS[k].upper()}]"]
                        end = max(end, b)
                    out.append(text if not bits else "".join([*bits, text[end:]]))
                cols = [*part.columns]
                cols[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))

