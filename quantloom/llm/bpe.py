"""Operator 2: BPE encoding and decoding with a public vocabulary file.

Merging keeps a word's symbols in a doubly linked list and the candidate pairs in a
priority queue of (merge rank, position); entries made stale by an earlier merge are
skipped when popped. Decoding joins vocabulary strings.

Edge cases: a null text encodes as the empty text; empty texts give no ids; a text of
one huge word costs O(n log n); special-token strings inside a text become their ids.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_slices, worker_state

WORD_CACHE = 500_000  # entries of a cache generation (a worker keeps two); only speed depends on it
#: Texts with one of these are encoded whole: white space for str.split only, letters whose
#: lower case depends on what surrounds them, marks that compose differently after lowering.
ODD = re.compile("[\x1c-\x1f\u0300-\u036fİΣ]")
#: A single mark between a letter or digit and white space is a pre-token of its own.
TRAILING = re.compile(r"(?<=[^\W_])([.,!?;:])(?!\S)")


def byte_alphabet() -> list[str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stay, the rest follow from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def chunks(text: str | None) -> list[str] | None:
    """Lower-case pieces that encode one by one as the text does, None if it must be encoded whole.

    No pre-token crosses white space, and lower case is what the vocabulary sees.
    """
    if not text:
        return []
    if "<|" in text or ODD.search(text):
        return None
    return TRAILING.sub(r" \1", text.lower()).split()


class ChunkCache:
    """Encodes texts by way of their distinct chunks; two generations of at most WORD_CACHE chunks are kept."""

    def __init__(self, encode_new, encode_whole):
        self.encode_new, self.encode_whole = encode_new, encode_whole
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        found, missing = [], {}
        get = self.now.get
        for i, text in enumerate(texts):
            words = chunks(text)
            if words is None:
                found.append(None)
                continue
            got = list(map(get, words))
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                missing.setdefault(words[at], []).append((i, at))
            found.append(got)
        if missing:
            if len(self.now) + len(missing) > WORD_CACHE:
                self.before, self.now = self.now, {}
            old, now = self.before, self.now
            kept = {w: old[w] for w in missing if w in old}
            new = [w for w in missing if w not in kept]
            kept.update(zip(new, self.encode_new(new), strict=True))
            for w, places in missing.items():
                x = kept[w]
                for i, at in places:
                    found[i][at] = x
                if len(w) <= 64:
                    now[w] = x
        return [self.encode_whole(t) if got is None else b"".join(got) for t, got in zip(texts, found, strict=True)]


def unsupported(j: dict) -> list[str]:
    """What of a tokenizers file this codec does not read as the library does; empty for the word-level BPE files it is made for."""
    wrong = []
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (j.get("normalizer") or {}).get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]:
        wrong.append("normalizer")
    parts = [(p.get("type"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (j.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if parts != [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]:
        wrong.append("pre_tokenizer")
    if j.get("decoder"):
        wrong.append("decoder")
    model = j.get("model") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        wrong.append("model")
    if any(t.get(k) for t in j.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        wrong.append("added_tokens")
    return wrong


class BpeCodec:
    """Encoder and decoder read from a `tokenizers` JSON file (BPE with an end-of-word suffix); another kind of file is an error."""

    def __init__(self, spec: str):
        import numpy as np
        import regex

        j = json.loads(spec)
        if unsupported(j):
            raise ValueError(f"this codec doesn't read such a file: {', '.join(unsupported(j))}")
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        v = self.vocab
        self.ranks = {(v[a], v[b]): (r, v[a + b]) for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
        size = max([*v.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in v.items():
            self.strings[i] = s
        for s, i in self.special.items():
            self.strings[i] = s
        self.alphabet = byte_alphabet()
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern, regex.V1).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.cache = ChunkCache(lambda new: [np.array(self.plain(w), "<u4").tobytes() for w in new], self.chunk)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode()
        a, v = self.alphabet, self.vocab
        ids = [v[a[b]] for b in raw[:-1]] + [v[a[raw[-1]] + self.suffix]]
        n = len(ids)
        if n == 1:
            return ids
        ranks = self.ranks
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            hit = ranks.get((ids[i], ids[i + 1]))
            if hit:
                heap.append((hit[0], i, ids[i], ids[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: a neighbour has merged since
            ids[i], ids[j] = new, -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                hit = ranks.get((new, ids[k]))
                if hit:
                    heapq.heappush(heap, (hit[0], i, new, ids[k], hit[1]))
            p = prv[i]
            if p >= 0:
                hit = ranks.get((ids[p], new))
                if hit:
                    heapq.heappush(heap, (hit[0], p, ids[p], new, hit[1]))
        return [x for x in ids if x >= 0]

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case goes letter by letter, without the final-sigma rule
            text = text.replace("Σ", "σ")
        out = []
        for w in self.split(text.lower()):
            out += self.merge(w)
        return out

    def chunk(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, special tokens included."""
        import numpy as np

        ids: list[int] = []
        for part in self.special_split(text) if self.special_split else [text]:
            special = self.special.get(part)
            if special is not None:
                ids.append(special)
            elif part:
                ids += self.plain(part)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.cache.encode(texts)

    def decode(self, ids) -> str:
        """The file names no decoder: vocabulary strings, separated by a space."""
        return " ".join(map(self.strings.__getitem__, ids))


def codec(key: str, spec: str) -> BpeCodec:
    state = worker_state()
    if ("bpe", key) not in state:
        state["bpe", key] = BpeCodec(spec)
    return state["bpe", key]


def encode_documents(docs: DataFrame, vocabulary: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, if asked for, the ids and the decoded text) per row.

    `vocabulary` is the path of a tokenizers JSON file on the driver; its text (a fixed
    file of under 2 MB) travels to the workers in a broadcast. One pass, no shuffle.
    Repeated rows give repeated results; other columns of `docs` are ignored.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        c = codec(vocabulary, spec.value)
        sha = hashlib.sha256
        gc.disable()  # no cycles arise here, and the caches are costly to walk
        for batch in batches:
            for part in text_slices(batch, 1, 1 << 18):  # small pieces: a chunk is new once
                n, a, b, lists, texts = [], [], [], [], []
                for raw in c.encode(part.column(1).to_pylist()):
                    got = np.frombuffer(raw, "<u4")
                    back = c.decode(got.tolist())
                    n.append(len(got))
                    a.append(sha(raw).hexdigest())
                    b.append(sha(back.encode()).hexdigest())
                    if ids:
                        lists.append(got.astype(np.int32))
                        texts.append(back)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string")).mapInArrow(run, kinds)
