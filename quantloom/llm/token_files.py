"""Operator 7: token ids in bit-plane files.

A file is a run of blocks of BLOCK ids each, a document index, a chunk index and a trailer:

    file      = magic "QLBP2\n", payload..., documents, index, trailer
    payload   = for each bit plane, from the lowest: length u32, zstandard frame
    documents = zstandard frame of a record per document: doc_id i64, has an id u8, ids u64
    index     = one record per block: offset u64, bytes u32, ids u32, planes u8 (bits per id)
    trailer   = number of blocks u32, index offset u64, documents offset u64 (all little-endian),
                ids of the partition's earlier files u64, ids of this file u64 (big-endian),
                magic "QLBPEND\n"

Block ids are transposed into bit planes (only as many as the largest id of the block
needs), which makes the high, nearly constant planes vanish under zstandard. A document's
ids stay in one file; a file ends with the document that fills it.

On a cluster the file images are rows of a Parquet table in the shared folder, written
by Spark, so a store that only Spark can reach works and a lost executor's files are
rewritten; `export_files` puts them on a plain file system.
"""

from __future__ import annotations

import gc
import json
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCache
from .common import column, partitions, text_slices, worker_state, written

MAGIC, END = b"QLBP2\n", b"QLBPEND\n"
TRAILER, COUNTS = "<IQQ", ">QQ"
RECORD = [("doc_id", "<i8"), ("has_id", "u1"), ("ids", "<u8")]
BLOCK = 1 << 16
FILE_IDS = 1 << 21  # ids after which a partition starts its next file: bounds a file image to a few MB


def pack(ids, doc_ids=(), lengths=(), before: int = 0) -> bytes:
    """The file image of a numpy array of unsigned 32-bit ids and of the documents they belong to."""
    import numpy as np
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    out, index, at = [MAGIC], [], len(MAGIC)
    for a in range(0, len(ids), BLOCK):
        block = np.ascontiguousarray(ids[a : a + BLOCK], dtype="<u4")
        planes = max(1, int(block.max()).bit_length())
        payload = b"".join(struct.pack("<I", len(f)) + f for f in (z.compress(np.packbits(((block >> k) & 1).astype(np.uint8), bitorder="little").tobytes()) for k in range(planes)))
        index.append(struct.pack("<QIIB", at, len(payload), len(block), planes))
        out.append(payload)
        at += len(payload)
    records = np.zeros(len(doc_ids), RECORD)
    records["doc_id"], records["has_id"] = [d or 0 for d in doc_ids], [d is not None for d in doc_ids]
    records["ids"] = lengths
    documents = z.compress(records.tobytes())
    return b"".join([*out, documents, *index, struct.pack(TRAILER, len(index), at + len(documents), at), struct.pack(COUNTS, before, len(ids)), END])


def trailer(image: bytes) -> tuple[int, int, int, int, int]:
    """Blocks, index offset, documents offset, ids of earlier files, ids of this file."""
    if image[: len(MAGIC)] != MAGIC or image[-len(END) :] != END:
        raise ValueError("not a bit-plane file")
    at = len(image) - len(END) - struct.calcsize(COUNTS)
    return *struct.unpack_from(TRAILER, image, at - struct.calcsize(TRAILER)), *struct.unpack_from(COUNTS, image, at)


def documents(image: bytes):
    """The records (doc_id, has_id, ids) of a file's documents."""
    import numpy as np
    import zstandard

    _, index, start, _, _ = trailer(image)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(image[start:index]), RECORD)


def unpack(image: bytes, blocks: range | None = None):
    """The ids of a file image, or those of some of its blocks by way of the index."""
    import numpy as np
    import zstandard

    n, start, _, _, _ = trailer(image)
    z = zstandard.ZstdDecompressor()
    out = [np.zeros(0, "<u4")]
    for b in blocks if blocks is not None else range(n):
        at, _, count, planes = struct.unpack_from("<QIIB", image, start + 17 * b)
        block = np.zeros(count, "<u4")
        for k in range(planes):
            (size,) = struct.unpack_from("<I", image, at)
            bits = np.unpackbits(np.frombuffer(z.decompress(image[at + 4 : at + 4 + size]), np.uint8), count=count, bitorder="little")
            block |= bits.astype("<u4") << np.uint32(k)
            at += 4 + size
        out.append(block)
    return np.concatenate(out)


def library_encoder(vocabulary: str, spec: str):
    """A function from texts to the tokenizers library's ids (as bytes), by way of distinct chunks."""
    import numpy as np

    state = worker_state()
    if ("tok", vocabulary) not in state:
        from unicodedata import is_normalized

        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_str(spec)
        t.no_truncation()
        t.no_padding()
        # For chunks of letters in normal form the file's normalizer and pattern change nothing:
        # such words go in together, and the end-of-word suffix tells where each ends.
        plain = Tokenizer.from_str(spec)
        plain.no_truncation()
        plain.no_padding()
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(spec)["model"].get("end_of_word_suffix") or None
        last = np.zeros(t.get_vocab_size(), bool)
        last[[i for s, i in t.get_vocab().items() if suffix and s.endswith(suffix)]] = True

        def whole(text: str) -> bytes:
            return np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        def new(words: list[str]) -> list[bytes]:
            known = {}
            letters = [w for w in words if suffix and w.isalpha() and is_normalized("NFC", w)]
            for i in range(0, len(letters), 1000):
                part = letters[i : i + 1000]
                ids = np.array(plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
                raw, cuts = ids.tobytes(), (4 * np.flatnonzero(last[ids]) + 4).tolist()
                known.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))
            return [known[w] if w in known else whole(w) for w in words]

        state["tok", vocabulary] = ChunkCache(new, whole)
    return state["tok", vocabulary].encode


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Encode, append `end_id` to each document and write ids in ascending doc_id order.

    Returns the table of files: part (ordinal of the range partition), seq (file within it)
    and image. Rows order by doc_id, nulls last, then by their place in the table, which also
    parts rows of one doc_id among tasks. A document stays in one file, whose image is
    bounded by FILE_IDS and that document. An empty table writes no file.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    n = partitions(docs.sparkSession)
    key = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    dealt = docs.select(column(docs, "doc_id", "long"), column(docs, "text", "string"), F.monotonically_increasing_id().alias("place")).repartitionByRange(n, *key).sortWithinPartitions(*key).select("doc_id", "text")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        gc.disable()  # no cycles arise here, and the caches are costly to walk
        encode = library_encoder(vocabulary, spec.value)
        end = np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        buf, ids, lens, held, before = [], [], [], 0, 0

        def flush():
            image = pack(np.frombuffer(b"".join(buf), "<u4"), ids, lens, before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([image], pa.binary())], names=["part", "seq", "image"])

        for batch in batches:
            for piece in text_slices(batch, 1, 1 << 18):  # small pieces: a chunk is new once
                for d, raw in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist()), strict=True):
                    raw += end
                    buf.append(raw)
                    ids.append(d)
                    lens.append(len(raw) // 4)
                    held += len(raw) // 4
                    if held >= FILE_IDS:
                        yield flush()
                        seq, before = seq + 1, before + held
                        buf, ids, lens, held = [], [], [], 0
        if ids:
            yield flush()

    return written(dealt.mapInArrow(run, "part int, seq int, image binary"), "token-files")


def located(image: bytes, base: int):
    """doc_id (with nulls), start, n_tokens and ids_crc32 of the documents of one file; base: ids of the partitions before."""
    import zlib

    import numpy as np

    records, ids = documents(image), unpack(image)
    raw, lens = ids.tobytes(), records["ids"].astype(np.int64)
    ends = np.cumsum(lens)
    if (int(ends[-1]) if len(ends) else 0) != len(ids):
        raise ValueError("a bit-plane file and its document index disagree")
    begins = ends - lens
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    return records["doc_id"], records["has_id"] == 0, begins + (base + trailer(image)[3]), lens, crc


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the file images alone.

    For the offsets one number per partition goes to the driver and back: as many as the
    writing job had partitions. It is read from the trailers.
    """
    number = lambda back: F.conv(F.hex(F.expr(f"substring(image, length(image) - {back - 1}, 8)")), 16, 10).cast("long")
    ids = number(len(END) + 8) + number(len(END) + 16)
    total, base = 0, {}
    for r in files.groupBy("part").agg(F.max(ids).alias("n")).orderBy("part").collect():
        base[r["part"]] = total
        total += r["n"]
    starts = files.sparkSession.sparkContext.broadcast(base)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                doc, none, start, n, crc = located(batch.column(1)[i].as_py(), starts.value[batch.column(0)[i].as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=none), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export_files(files: DataFrame, folder: str) -> int:
    """Write the images as part-seq.qlbp under a folder every executor mounts; each appears whole or not at all."""

    def run(batches):
        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for part, seq, image in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(folder, f"{part:06d}-{seq:06d}.qlbp")
                with open(path + f".{os.getpid()}", "wb") as f:
                    f.write(image)
                os.replace(path + f".{os.getpid()}", path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("part", "seq", "image").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
