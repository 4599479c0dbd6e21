"""Operator 5: SimHash near-duplicates by tiled exact comparison.

Fingerprints of equal value are one node. Two fingerprints within RADIUS bits agree in
at least one of RADIUS+1 blocks of bits, so only fingerprints that share a block meet;
this is exact. Within a block value, tiles are compared by numpy exclusive-or and bit
counts, and tiles whose population counts differ by more than the radius never meet.
A hot block value is split into tiles by population count and hash, and tile pairs go
to different tasks. A tile pair reports a spanning forest, not its pairs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, partitions, text_slices, written
from .components import connected_components

SEED = 42
RADIUS = 3
TILE = 2048  # fingerprints of a tile side
MANY = 4_000_000  # distinct fingerprints from which longer blocks (and more of them) are used


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint (unsigned) of one text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    got = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not got:
        return 0
    if len(got) <= words:
        hashes = [xxh64_intdigest(b" ".join(got), SEED)]
    else:
        norm = b" ".join(got)
        ends = list(itertools.accumulate(map(len, got)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0, *(e + 1 for e in ends)]
        hashes = [xxh64_intdigest(norm[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]  # noqa: B905
    n, bits = len(hashes), np.zeros(64, np.int64)
    h = np.array(hashes, dtype="<u8")
    for i in range(0, n, 1 << 16):
        bits += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n, bitorder="little").tobytes(), "little")


#: A-Z to lower case; bytes.split() then cuts at space and \x09-\x0D exactly.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns `keep` of docs, plus fp (the fingerprint as a signed long)."""
    cols = list(dict.fromkeys([*keep, text_column]))
    docs = docs.select(*[F.col(f"`{c}`") for c in cols])
    text, n = cols.index(text_column), len(keep)
    schema = T.StructType([*docs.schema.fields[:n], T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in text_slices(batch, text):
                fp = [fingerprint(t) for t in part.column(text).to_pylist()]
                fp = [x - (1 << 64) if x >> 63 else x for x in fp]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(fp, pa.int64())], names=[*keep, "fp"])

    return docs.mapInArrow(run, schema)


def block_keys(fp, blocks: int):
    """An array of keys: for each choice of blocks - RADIUS blocks, the fingerprint's bits there."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for k, chosen in enumerate(itertools.combinations(range(blocks), blocks - RADIUS)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        mask = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*out)


def forest(fp, u, v):
    """Edges (a, b) of a spanning forest of the links u-v between positions of fp."""
    import numpy as np

    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = inv[: len(u)], inv[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return fp[nodes[child]], fp[nodes[label[child]]]


def close_pairs(fp, side):
    """Positions (u, v) of one tile pair's links; side 0 meets all, sides 1 and 2 meet each other only."""
    import numpy as np

    order = np.argsort(np.bitwise_count(fp.view(np.uint64)), kind="stable")
    x, s = fp.view(np.uint64)[order], side[order]
    pop = np.bitwise_count(x).astype(np.int64)
    us, vs = [], []
    for a in range(0, len(x), 256):
        b = min(a + 256, len(x))
        lo, hi = a, int(np.searchsorted(pop, pop[b - 1] + RADIUS, "right"))  # populations ascend: no partner beyond
        near = np.bitwise_count(x[a:b, None] ^ x[None, lo:hi]) <= RADIUS
        near &= s[a:b, None] + s[None, lo:hi] != 2
        near &= s[a:b, None] + s[None, lo:hi] != 4
        i, j = np.nonzero(near)
        keep = i + a < j + lo
        us.append(order[i[keep] + a])
        vs.append(order[j[keep] + lo])
    return np.concatenate(us), np.concatenate(vs)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly what links within RADIUS bits connect (a tile's forest may join two fingerprints by way of a third)."""
    spark = distinct.sparkSession
    n = distinct.count()
    blocks = RADIUS + 1 if n < MANY else RADIUS + 2 if n < MANY * 500 else RADIUS + 3
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks)).alias("k"))
    sizes = keyed.groupBy("k").count().where("count > 1")
    keyed = keyed.join(sizes, "k").withColumn("pop", F.bit_count("fp").cast("int"))
    plain = keyed.where(F.col("count") <= 2 * TILE).select("k", "fp", F.lit(0).alias("side"))
    hot = keyed.where(F.col("count") > 2 * TILE).withColumn("cuts", F.ceil(F.col("count") / TILE).cast("int")).withColumn("h", F.pmod(F.xxhash64("fp"), "cuts").cast("int"))
    # Tile (pop, h) meets tiles of populations within the radius; the smaller tile of a pair is side 1.
    others = F.explode(F.flatten(F.transform(F.sequence(F.lit(-RADIUS), F.lit(RADIUS)), lambda d: F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda h: F.struct((F.col("pop") + d).alias("p"), h.cast("int").alias("h"))))))
    hot = hot.withColumn("o", others).withColumn("me", F.struct(F.col("pop").alias("p"), F.col("h").alias("h")))
    hot = hot.select(F.xxhash64("k", F.least("me", "o"), F.greatest("me", "o")).alias("k"), "fp", F.when(F.col("me") == F.col("o"), 0).when(F.col("me") < F.col("o"), 1).otherwise(2).alias("side"))
    # A pair of a tile with itself has side 0; a pair of different tiles lists each row once per side.
    dealt = plain.unionByName(hot).repartition(partitions(spark), "k").sortWithinPartitions("k")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

        def solve(k, fp, side):
            """Runs of equal k: short runs together by offsets, long ones tile by tile."""
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            length = np.diff(np.r_[starts, len(k)])
            long = np.repeat(length > 48, length)
            us, vs, x = [], [], fp.view(np.uint64)
            short = np.flatnonzero(~long)
            d = 1
            while len(short):
                short = short[short + d < len(k)]
                short = short[k[short] == k[short + d]]
                near = np.bitwise_count(x[short] ^ x[short + d]) <= RADIUS
                near &= ~((side[short] == side[short + d]) & (side[short] > 0))
                us.append(short[near])
                vs.append(short[near] + d)
                d += 1
            for s, m in zip(starts[length > 48].tolist(), length[length > 48].tolist(), strict=True):
                i, j = close_pairs(fp[s : s + m], side[s : s + m])
                us.append(i + s)
                vs.append(j + s)
            if us and sum(map(len, us)):
                return out(*forest(fp, np.concatenate(us), np.concatenate(vs)))
            return None

        held = None
        for batch in batches:
            k, fp, side = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                k, fp, side = np.concatenate([held[0], k]), np.concatenate([held[1], fp]), np.concatenate([held[2], side])
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            held = k[cut:], fp[cut:], side[cut:]
            if cut and (got := solve(k[:cut], fp[:cut], side[:cut])) is not None:
                yield got
        if held is not None and len(held[0]) and (got := solve(*held)) is not None:
            yield got

    return dealt.select("k", "fp", "side").mapInArrow(run, "u long, v long")


def rooted(distinct: DataFrame) -> DataFrame:
    """distinct (fp, ...) plus root, the component of its fingerprint."""
    edges = written(links(distinct).distinct(), "simhash-links")
    roots = connected_components(edges)
    discard(edges)
    return distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns `keep`, all by default) plus fingerprint (hex) and component_id, the smallest doc_id linked directly or through others.

    docs must have doc_id and text. Null and empty texts have fingerprint zero and link
    like any other. Rows with a null doc_id take part; a component of such rows only has a
    null component_id. Repeated rows are members of the same component. Other columns pass
    through, except that fp, fingerprint and component_id are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("fp", "fingerprint", "component_id")]
    marked = written(fingerprints(docs, keep), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-fp")
    named = rooted(distinct)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0")).drop("fp")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id (nulls last, then as stored); docs' own columns, whatever their names."""
    names = docs.columns
    safe = [f"_c{i}" for i in range(len(names))]
    doc_id, text = safe[names.index("doc_id")], safe[names.index("text")]
    marked = written(fingerprints(docs.toDF(*safe).withColumn("_row", F.monotonically_increasing_id()), [*safe, "_row"], text), "simhash")
    first = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col("_row"))
    narrow = marked.select("fp", first.alias("first"))
    distinct = written(narrow.groupBy("fp").agg(F.min("first").alias("first")), "simhash-fp")
    named = rooted(distinct)
    least = named.groupBy("root").agg(F.min("first").alias("kept"))
    named = named.join(least, "root").select("fp", "kept")
    gone = narrow.join(named, "fp").where("first <> kept").select(F.col("first._row").alias("_row"))
    return marked.join(gone, "_row", "left_anti").select(*safe).toDF(*names)
