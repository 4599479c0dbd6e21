"""Operator 3: exact removal of repeated long substrings by a run-length index.

Every string of LENGTH bytes is filed under an anchor, the smallest (by a mixed rolling
hash, leftmost of ties) of its GRAM-byte grams. Equal strings have equal anchors at equal
offsets, so a string can repeat only inside its anchor's group. Consecutive strings with
one anchor form a segment; equal segments of a group are one class with a count.

- A class that occurs twice or more repeats as a whole; one of it goes on as a partner.
- Groups of several classes are indexed: their texts are concatenated in buckets of a few
  MB, a Burrows-Wheeler transform of the bucket is kept as runs with the text positions
  sampled at run ends, and the matching statistics of every segment against all others
  stream from the samples: at a run end the match is measured, from there to the next
  sample it shrinks by one per byte. Starts with a match of LENGTH or more are marked.
- A group of more than MANY classes would put one hot passage into one task. It is split
  first: the starts of its segments fall into intervals, strings of one interval share a
  core around the anchor, and intervals with equal cores form a group of their own, with
  equal intervals counted as one class. Groups that are still too large are split again,
  by shorter intervals with longer cores; all others go to the index. Equal strings stay
  together at every step, so this is exact as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, partitions, text_slices, written

LENGTH = 400
GRAM = 128
MANY = 256  # classes that one index may get of one group
INDEX_BYTES = 1 << 20
PIECE = 1 << 20  # bytes that are hashed at a time; positions fit into the keys' low 20 bits


def _powers(n: int):
    """Powers of an odd base and of its inverse modulo 2**64."""
    import numpy as np

    base = 0x9E3779B97F4A7C15
    inv = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64) for b in (base, inv))


def anchors(data, bounds, length: int = LENGTH, gram: int = GRAM, powers=None):
    """Segments of a byte array that holds documents bounds[i]..bounds[i+1].

    Returns arrays lo, last (first and last start of a segment), at (its anchor), hash.
    len(data) is PIECE at most.
    """
    import numpy as np

    n, none = len(data), (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    up, down = powers if powers is not None else _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * up[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    key = (h & ~np.uint64(PIECE - 1)) | np.arange(len(h), dtype=np.uint64)
    # Minima of all windows of w grams: blocks of w, running minima from both ends.
    w = length - gram + 1
    m = -(-len(key) // w) * w
    pad = np.full(m, np.iinfo(np.uint64).max)
    pad[: len(key)] = key
    fwd = np.minimum.accumulate(pad.reshape(-1, w), axis=1).ravel()
    bwd = np.minimum.accumulate(pad.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    k = len(key) - w + 1
    low = np.minimum(bwd[:k], fwd[w - 1 : w - 1 + k])
    first, last = bounds[:-1], bounds[1:] - length
    ok = last >= first
    first, last = first[ok], last[ok]
    if not len(first):
        return none
    cuts = np.unique(np.concatenate([np.flatnonzero(low[1:] != low[:-1]) + 1, first, last + 1]))
    doc = np.searchsorted(first, cuts, "right") - 1
    inside = (doc >= 0) & (cuts <= last[np.maximum(doc, 0)])
    lo = cuts[inside]
    ends = np.r_[cuts[1:], k][inside] - 1
    at = (low[lo] & np.uint64(PIECE - 1)).astype(np.int64)
    return lo, ends, at, h[at]


def repeated_starts(texts: list[bytes], length: int = LENGTH):
    """For each text, a boolean array over its bytes: a string of `length` starts here and starts elsewhere too.

    The run-length index of one bucket: suffixes are ordered by doubling, the transform is
    cut into runs, positions are sampled at the run ends, and the matching statistics
    stream from the samples. Each text ends in a separator of its own, below all bytes and
    in the order of the texts, so no match crosses texts and the order is complete.
    """
    import numpy as np

    sizes = np.array([len(t) + 1 for t in texts])
    sym = np.zeros(int(sizes.sum()), np.int64)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sym[:] = raw
    sym += 1
    ends = np.cumsum(sizes) - 1
    sym[ends] = 0
    n = len(sym)
    rest = np.repeat(ends, sizes) - np.arange(n)  # symbols before the separator
    owner = np.repeat(np.arange(len(texts)), sizes)
    wide = 7  # nine bits a symbol
    padded = np.r_[sym, np.zeros(wide, np.int64)]
    word = np.zeros(n, np.int64)
    for j in range(wide):
        word = (word << 9) | np.where(rest >= j, padded[j : j + n], 0)  # nothing behind the separator counts
    order = np.argsort(word, kind="stable")
    ordered = word[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n + 1, np.int64)
    slot = np.flatnonzero(new)
    rank[order] = np.repeat(slot, np.diff(np.r_[slot, n]))
    rank[n] = -1
    depth = wide
    while depth <= sizes.max():
        size = np.diff(np.r_[slot, n])
        tied = np.repeat(size > 1, size)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        sub = order[places]
        # Ties that reach the separator are ordered by it; a group of ties reaches it together or not at all.
        second = np.where(rest[sub] < depth, owner[sub], rank[np.minimum(sub + depth, n)] + 1)
        both = rank[sub] * (n + 2) + second
        by = np.argsort(both, kind="stable")
        order[places], both = sub[by], both[by]
        new[places] = np.r_[True, both[1:] != both[:-1]]
        slot = np.flatnonzero(new)
        rank[order] = np.repeat(slot, np.diff(np.r_[slot, n]))
        depth *= 2
    # The transform as runs, with samples at both ends of each run.
    bwt = sym[order - 1]
    starts = np.flatnonzero(np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)])  # separators differ from each other
    heads, tails = order[starts], order[np.r_[starts[1:] - 1, n - 1]]
    del order, rank, new

    def reach(p, q):
        """Length of the common prefix of the suffixes at p and q."""
        at, to = p, q
        got = np.zeros(len(p), np.int64)
        live = np.arange(len(p))
        p, q = p.copy(), q.copy()
        while len(live):
            same = (word[p] == word[q]) & (p + wide < n) & (q + wide < n)
            part = live[~same]
            a, b, more = p[~same], q[~same], np.ones(len(part), bool)
            for _ in range(wide):
                more &= padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
                more &= (a < n) & (b < n)
                got[part] += more
                a, b = a + 1, b + 1
            live, p, q = live[same], p[same] + wide, q[same] + wide
            got[live] += wide
        return np.minimum(got, np.minimum(rest[at], rest[to]))

    best = np.zeros(n, bool)
    for sample, other in ((heads[1:], tails[:-1]), (tails[:-1], heads[1:])):
        # heads against the suffix just above, tails against the one just below
        at = np.full(n, -1, np.int64)
        at[sample] = sample
        long = np.zeros(n, np.int64)
        long[sample] = reach(sample, other)
        at = np.maximum.accumulate(at)
        known = at >= 0
        stream = np.where(known, long[np.maximum(at, 0)] - (np.arange(n) - at), 0)
        best |= stream >= length
    return [best[e - len(t) : e] for t, e in zip(texts, ends.tolist(), strict=True)]


def _segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """row, doc_id, text, segs: one row per document, with its segments."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), column(docs, "doc_id", "long"), F.encode(F.coalesce(column(docs, "text", "string"), F.lit("")), "UTF-8").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        powers = _powers(PIECE + 1)
        for batch in (part for b in batches for part in text_slices(b, 2, PIECE)):
            rows = batch.column(0).to_pylist()
            texts = batch.column(2).to_pylist()
            found: list[list] = [[] for _ in rows]
            # Pieces of whole short documents, or of a long one with overlap.
            jobs, held = [], 0
            for i, t in enumerate(texts):
                for a in range(0, max(1, len(t) - length + 1), PIECE - length + 1):
                    b = min(len(t), a + PIECE)
                    if b - a < length:
                        continue
                    if held + b - a > PIECE:
                        jobs.append(None)
                        held = 0
                    jobs.append((i, a, b))
                    held += b - a
            jobs.append(None)
            piece: list = []
            for job in jobs:
                if job is not None:
                    piece.append(job)
                    continue
                if not piece:
                    continue
                buf = b"".join(texts[i][a:b] for i, a, b in piece)
                bounds = np.cumsum([0, *(b - a for _, a, b in piece)])
                lo, last, at, h = anchors(np.frombuffer(buf, np.uint8), bounds, length, gram, powers)
                doc = np.searchsorted(bounds, lo, "right") - 1
                for d, x, y, p, hh in zip(doc.tolist(), lo.tolist(), last.tolist(), at.tolist(), h.view(np.int64).tolist(), strict=True):
                    i, a, _ = piece[d]
                    g = xxh3_64_intdigest(buf[x : y + length])
                    found[i].append((x - int(bounds[d]) + a, y - x + 1, p - x, hh, g - (1 << 64) if g >> 63 else g))
                piece = []
            flat = [s for f in found for s in f]
            cols = list(zip(*flat, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["lo", "n", "off", "h", "g"])
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, struct)], names=["row", "doc_id", "text", "segs"])

    return docs.mapInArrow(run, "row long, doc_id long, text binary, segs array<struct<lo:int,n:int,off:int,h:long,g:long>>")


def _indexed(texts: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(h, g, at, marks) from (k, h, g, at, count, n, seg): marks of classes with a count of one, against the texts of one k."""
    spark = texts.sparkSession
    # Texts of one group lie together; a task builds index after index of about index_bytes.
    dealt = texts.repartition(partitions(spark), "k").sortWithinPartitions("k")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def solve(rows):
            out: list[list] = [[], [], [], []]
            for (_, h, g, at, count, n, _), hit in zip(rows, repeated_starts([r[6] for r in rows], length), strict=True):
                if count > 1:
                    continue
                hit = np.r_[False, hit[:n], False]
                edge = np.flatnonzero(hit[1:] != hit[:-1])
                if len(edge):
                    for col, x in zip(out, (h, g, at, [{"a": int(a), "b": int(b) - 1} for a, b in edge.reshape(-1, 2)]), strict=True):
                        col.append(x)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), kind), strict=True)], names=["h", "g", "at", "marks"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= index_bytes and rows[-1][0] != row[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield solve(rows)

    return dealt.select("k", "h", "g", "at", "count", "n", "seg").mapInArrow(run, "h long, g long, at int, marks array<struct<a:int,b:int>>")


def _split(texts: DataFrame, length: int, gram: int, many: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Groups of more than `many` classes, split by cores: (what to index, marks of intervals that are equal as a whole, the tables written for both).

    A start is named by l, its distance to the left of the anchor. The starts of a node
    [l0, l0+size) share the core from -l0 to length-l0-size+1, a longer one the smaller the
    node. What to index has the columns of _indexed(); `at` is where the interval begins.
    """
    size = 1
    while size < length - gram + 1:
        size *= 2
    live = texts.select("h", "g", "off", "seg", (F.col("off") - F.col("n") + 1).alias("l1"), F.col("off").alias("l2"), F.lit(0).alias("l0"), (F.col("count") > 1).alias("marked"))
    small, marks, used = [], None, []
    while size >= 1:
        if size <= length - gram:  # else the core is shorter than the anchor itself
            live = live.withColumn("core", F.xxhash64("h", "l0", F.expr(f"substring(seg, off - l0 + 1, {length} - {size} + 1)")))
            live = live.withColumn("whole", F.sha2(F.concat(F.encode(F.concat_ws(",", "h", "l1", "l2"), "UTF-8"), F.expr(f"substring(seg, off - l2 + 1, l2 - l1 + {length})")), 256))
            # Of equal intervals one goes on as a partner; where it is marked already, so are the others.
            wholes = live.groupBy("core", "whole").agg(F.count("*").alias("same"), F.min(F.struct("g", "l2")).alias("first"), F.min("marked").alias("known"))
            wholes = written(wholes, "substring-wholes")
            cores = wholes.groupBy("core").agg(F.count("*").alias("classes"), F.sum("same").alias("rows"), F.min(F.expr("known or same > 1")).alias("over"))
            live = written(live.join(wholes.drop("known"), ["core", "whole"]).join(cores.where("rows > 1").drop("rows"), "core"), "substring-parts")
            discard(wholes)
            used.append(live)
            done = live.where("same > 1 and not marked").select("h", "g", (F.col("off") - F.col("l2")).alias("a"), (F.col("off") - F.col("l1")).alias("b"))
            marks = done if marks is None else marks.unionByName(done)
            live = live.where("classes > 1 and not over").where(F.col("first") == F.struct("g", "l2")).withColumn("marked", F.col("marked") | (F.col("same") > 1))
            part = F.expr(f"substring(seg, off - l2 + 1, l2 - l1 + {length})")
            small.append(live.where(F.col("classes") <= many).select(F.col("core").alias("k"), "h", "g", (F.col("off") - F.col("l2")).cast("int").alias("at"), F.when(F.col("marked"), 2).otherwise(1).cast("long").alias("count"), (F.col("l2") - F.col("l1") + 1).cast("int").alias("n"), part.alias("seg")))
            live = live.where(F.col("classes") > many).drop("core", "whole", "same", "first", "classes", "over")
            if size == 1 or live.isEmpty():
                break
        half = size // 2
        kids = F.explode(F.array(F.col("l0"), F.col("l0") + half))
        live = live.withColumn("l0", kids).withColumn("l1", F.greatest("l1", "l0")).withColumn("l2", F.least(F.col("l2"), F.col("l0") + half - 1)).where("l1 <= l2")
        size = half
    return small, marks.select("h", "g", F.array(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))).alias("marks")), used


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY, index_bytes: int = INDEX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(table, marks): row, doc_id, text (bytes) per document, and per row with repeats its list of (a, b), first and last repeated start."""
    table = written(_segments(docs, length, gram), "substring-segments")
    segs = table.select("row", F.explode("segs").alias("s")).select("row", "s.*")
    # Written, so that the join deals both sides anew and a hot anchor's rows can be split among tasks.
    twice = written(segs.groupBy("h").count().where("count > 1").select("h"), "substring-twice")
    segs = written(segs.join(twice, "h", "left_semi"), "substring-repeats")
    discard(twice)
    classes = written(segs.groupBy("h", "g").agg(F.count("*").alias("count"), F.min(F.struct("row", "lo", "n", "off")).alias("at")), "substring-classes")
    groups = classes.groupBy("h").agg(F.count("*").alias("classes"), F.min("count").alias("least")).where("classes > 1 and least = 1").select("h", "classes")
    groups = written(groups, "substring-groups")
    needed = classes.join(groups, "h").select("h", "g", "count", "classes", "at.*")
    lists = needed.groupBy("row").agg(F.collect_list(F.struct("h", "g", "count", "classes", "lo", "n", "off")).alias("want"))
    texts = table.select("row", "text").join(lists, "row").select("text", F.explode("want").alias("w"))
    used = [classes, groups]
    texts = written(texts.select("w.h", "w.g", "w.count", "w.classes", "w.n", "w.off", F.expr(f"substring(text, w.lo + 1, w.n + {length - 1})").alias("seg")), "substring-texts")
    full = classes.where("count > 1").select("h", "g", F.array(F.struct(F.lit(0).alias("a"), (F.col("at.n") - 1).alias("b"))).alias("marks"))
    index = texts.where(F.col("classes") <= many).select(F.col("h").alias("k"), "h", "g", F.lit(0).alias("at"), "count", F.col("n").cast("int").alias("n"), "seg")
    hot = texts.where(F.col("classes") > many)
    if not hot.isEmpty():
        small, equal, parts = _split(hot, length, gram, many)
        used += parts
        for part in small:
            index = index.unionByName(part)
        full = full.unionByName(equal)
    found = _indexed(index, length, index_bytes)
    marks = full.unionByName(found.select("h", "g", F.expr("transform(marks, m -> struct(m.a + at as a, m.b + at as b))").alias("marks")))
    marks = marks.groupBy("h", "g").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    marks = written(marks, "substring-marks")
    discard(texts, *used)
    spans = segs.select("row", "lo", "h", "g").join(marks, ["h", "g"]).select("row", F.expr("transform(marks, m -> struct(lo + m.a as a, lo + m.b as b))").alias("m"))
    return table.select("row", "doc_id", "text"), spans.groupBy("row").agg(F.flatten(F.collect_list("m")).alias("marks"))


def remove_repeats(docs: DataFrame, texts: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for) per row.

    Each byte covered by a string of LENGTH bytes that starts anywhere else too goes,
    overlaps and the same document included. Null texts are empty; texts shorter than
    LENGTH lose nothing; repeated rows lose each other's bytes on both sides; an empty
    table gives an empty result; other columns of `docs` are ignored.
    """
    length = options.get("length", LENGTH)
    table, marks = repeated_spans(docs, **options)
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in (part for b in batches for part in text_slices(b, 1)):
            out: list[list] = [[] for _ in range(6)]
            for d, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, at, gone, n = [], 0, 0, 0
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"] + length) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                for a, b in merged:
                    kept.append(text[at:a])
                    gone, n, at = gone + b - a, n + 1, b
                rest = b"".join([*kept, text[at:]])
                for col, x in zip(out, (d, len(text), gone, n, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    col.append(x)
            cols = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            k = 6 if texts else 5
            yield pa.RecordBatch.from_arrays(cols[:k], names=names[:k])

    return table.join(marks, "row", "left").select("doc_id", "text", "marks").mapInArrow(run, kinds)
