"""Operator 6: embedding near-duplicates by sorted projection passes.

Equal vectors are one node. A pass gives each node a key, the concatenated signs of its
projections on random planes, orders all nodes by it and compares each with the WINDOW
nodes after it; close pairs are united across passes.

How often a pair at the threshold shares its first bits is known, and so is how many nodes
share them by chance. The prefix is chosen so long that a run of nodes with one prefix fits
the window, the number of passes so large that a pair at the threshold shares a prefix at
least once with probability RECALL. Both follow the number of vectors. A run longer than
the window (a dense group) is united as a whole, so no density breaks that promise.

What is united is only a group of candidates: inside each group all pairs are compared
exactly, tile by tile, and only that comparison says what links. Small groups are cheap;
a dense group costs the square of its size, which is the exact way for what the bounded
windows can't hold. Ranks, not partitions, bound the windows, so the result does not
depend on how the table is dealt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, partitions, written
from .components import connected_components

THRESHOLD = 0.95
WINDOW = 128
RECALL = 0.995  # least probability that a pair at the threshold becomes a candidate
SPARE = 4  # how many times the usual run fits the window
MOST_BITS = 32  # longest prefix; denser runs than it can part are compared exactly
KEY_BITS = 62
PLAN_SAMPLE = 2048  # vectors that the plan is made from
RANKS = 4096  # ranks of a block of the order
SEED = 5
TILE = 512  # the smallest tile of an exact comparison
SIDES = 16
LARGE = 1 << 16
BLOCK = 1024  # rows of one side of a matrix product


def valid(vector: str = "embedding"):
    """A vector that takes part: not null, not zero, all components finite."""
    v = F.col(vector)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(v, lambda x: x != 0)


def unit(batch_column):
    """Rows of one length as unit vectors in double precision."""
    import numpy as np

    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(batch_column), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # against overflow and underflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def joined(label, a, b):
    """Labels (the least member of each set) after the sets of a[i] and b[i] are united; and the positions a, b that did it."""
    import numpy as np

    us, vs = [], []
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        high, low = np.maximum(x, y), np.minimum(x, y)
        root, at = np.unique(high, return_index=True)  # each set hooks to one lower set at a time
        us.append(a[at])
        vs.append(b[at])
        to = np.arange(len(label))
        to[root] = low[at]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]
    return label, us, vs


def plan(nodes: DataFrame, threshold: float, window: int, recall: float = RECALL) -> tuple[int, int]:
    """(bits, passes): prefix length and number of passes for these nodes.

    The plan looks at PLAN_SAMPLE vectors: how many nodes share a prefix with the median one.
    """
    import math

    import numpy as np

    n = nodes.count()
    rows = nodes.orderBy(F.xxhash64("embedding"), "embedding").limit(PLAN_SAMPLE).select("x").toArrow().column(0).to_pylist()
    size = np.array([len(x) for x in rows])
    agree = np.zeros((len(rows), len(rows)), np.float32)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        x = np.frombuffer(b"".join(rows[i] for i in at), "<f4").reshape(len(at), -1)
        agree[np.ix_(at, at)] = 1 - np.arccos(np.clip(x @ x.T, -1, 1)) / np.pi
    np.fill_diagonal(agree, 0)
    bits, shared = 0, (agree > 0).astype(np.float32)
    while bits < MOST_BITS and len(rows) > 1 and np.median(shared.sum(axis=1)) * n / len(rows) > window / SPARE:
        shared *= agree
        bits += 1
    found = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))


def scaled(nodes: DataFrame) -> DataFrame:
    """nodes (node, dim, embedding, ...) plus x, the unit vector in single precision."""
    names = nodes.columns
    dim, at = names.index("dim"), names.index("embedding")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            size = batch.column(dim).to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                x = unit(part.column(at)).astype("<f4")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v.tobytes() for v in x], pa.binary())], names=[*names, "x"])

    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("x", T.BinaryType())]))


def ordered(nodes: DataFrame, bits: int, passes: int) -> tuple[DataFrame, DataFrame]:
    """(the written table, what is read of it: rank, dim, pass, run (the first `bits` of the key), node): the orders of all passes as one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        planes: dict = {}
        weights = np.int64(1) << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            size = batch.column(1).to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                x = np.frombuffer(b"".join(part.column(2).to_pylist()), "<f4").reshape(-1, d)
                if d not in planes:
                    planes = {d: np.random.default_rng((SEED, d)).standard_normal((passes, KEY_BITS, d), np.float32)}
                keys = np.stack([((x @ p.T) > 0).astype(np.int64) @ weights for p in planes[d]], axis=1).ravel()
                each = pa.array(np.repeat(np.arange(len(x)), passes))
                numbers = pa.array(np.tile(np.arange(passes, dtype=np.int32), len(x)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), part.column(1).take(each), numbers, pa.array(keys), part.column(3).take(each)], names=["node", "dim", "pass", "key", "h"])

    keyed = nodes.select("node", "dim", "x", F.xxhash64("embedding").alias("h")).mapInArrow(run, "node long, dim int, pass int, key long, h long")
    order = ["dim", "pass", "key", "h"]
    rows = keyed.repartitionByRange(partitions(nodes.sparkSession), *order).sortWithinPartitions(*order)
    table = written(rows.withColumn("id", F.monotonically_increasing_id()), "vector-order")
    rows = table.withColumn("p", F.shiftright("id", 33))
    # One number per partition goes to the driver and back.
    at, starts = 0, []
    for r in rows.groupBy("p").count().orderBy("p").collect():
        starts.append((r["p"], at))
        at += r["count"]
    first = F.broadcast(nodes.sparkSession.createDataFrame(starts, "p long, first long"))
    rank = F.col("first") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return table, rows.join(first, "p").select(rank.alias("rank"), "dim", "pass", F.shiftright("key", KEY_BITS - bits).alias("run"), "node")


def candidates(nodes: DataFrame, threshold: float, window: int = WINDOW) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (u, v) whose components hold every pair found: close pairs inside the windows, and whole runs that no window holds; and the tables they read.

    nodes: node, dim, embedding, x. The edges are linear in the nodes of each pass.
    """
    order, rows = ordered(nodes, *plan(nodes, threshold, window))
    runs = ["dim", "pass", "run"]
    long = written(rows.groupBy(*runs).agg(F.count("*").alias("n"), F.min("node").alias("least")).where(F.col("n") > window).drop("n"), "vector-runs")
    whole = rows.join(long, runs).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    # A block also gets the last ranks of the block before it, so a window may cross its edge.
    block = F.floor(F.col("rank") / RANKS)
    into = F.when(F.col("rank") % RANKS >= RANKS - window, F.array(block, block + 1)).otherwise(F.array(block))
    placed = rows.select(F.explode(into).alias("block"), "rank", "pass", "node").join(nodes.select("node", "dim", "x"), "node")
    placed = placed.select("block", "dim", "pass", "rank", "node", "x").repartition(partitions(nodes.sparkSession), "block").sortWithinPartitions("block", "rank")
    least = threshold - 1e-5  # single precision here; the exact comparison comes later

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def solve(parts):
            """A stretch of one block, dim and pass."""
            node = np.concatenate([p[0] for p in parts])
            x = np.concatenate([p[1] for p in parts])
            n, label, us, vs = len(node), np.arange(len(node)), [], []
            for a in range(0, n, window):
                b = min(a + window, n)
                near = x[a:b] @ x[a : b + window].T >= least
                i, j = np.nonzero(near)
                ok = (j > i) & (j - i <= window)
                label, u, v = joined(label, i[ok] + a, j[ok] + a)
                us += u
                vs += v
            if not us:
                return None
            return pa.RecordBatch.from_arrays([pa.array(node[np.concatenate(us)]), pa.array(node[np.concatenate(vs)])], names=["u", "v"])

        held, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
            edge = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                k, part = tuple(keys[:, a].tolist()), batch.slice(a, b - a)
                if held is not None and k != held:
                    if (got := solve(parts)) is not None:
                        yield got
                    parts = []
                held = k
                parts.append((part.column(4).to_numpy(), np.frombuffer(b"".join(part.column(5).to_pylist()), "<f4").reshape(b - a, -1)))
        if parts and (got := solve(parts)) is not None:
            yield got

    return whole.unionByName(placed.mapInArrow(compare, "u long, v long")), [order, long]


def links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, links): v null and the copies of other nodes within the threshold of u; or links null and an edge u-v.

    nodes: node long, root long, copies long, embedding; only nodes of one root meet (they
    are of one length). The edges connect exactly what the links connect, their number is
    linear in the nodes of each meeting of two tiles.
    """
    sizes = nodes.groupBy("root").agg(F.count("*").alias("m"))
    cuts = F.greatest(F.least(F.ceil(F.col("m") / TILE), F.lit(SIDES)), F.ceil(F.col("m") / LARGE)).cast("int")
    dealt = nodes.join(sizes, "root").withColumn("cuts", cuts).withColumn("t", F.pmod(F.xxhash64("node"), "cuts").cast("int"))
    # A tile meets every tile, each meeting in a task of its own; the row is side 1 or 2 or, for its own tile, side 0.
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("side", F.when(F.col("t") == F.col("o"), 0).when(F.col("t") < F.col("o"), 1).otherwise(2))
    dealt = dealt.select("root", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "side", "node", "copies", "embedding")
    key = ["root", "lo", "hi"]
    dealt = dealt.repartition(partitions(nodes.sparkSession), *key).sortWithinPartitions(*key, "side")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def solve(side, node, copies, x):
            n, cut = len(node), int(np.searchsorted(side, 2))
            own = side[0] == 0
            count, label, us, vs = np.zeros(n, np.int64), np.arange(n), [], []
            if not own and (side[0] == 2 or cut == n):
                return None
            for a in range(0, n if own else cut, BLOCK):
                b = min(a + BLOCK, n if own else cut)
                for c in range(a if own else cut, n, BLOCK):
                    d = min(c + BLOCK, n)
                    near = x[a:b] @ x[c:d].T >= threshold
                    if own and a == c:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    i, j = i + a, j + c
                    np.add.at(count, i, copies[j])
                    np.add.at(count, j, copies[i])
                    label, u, v = joined(label, i, j)
                    us += u
                    vs += v
            hit = np.flatnonzero(count)
            if not len(hit):
                return None
            u, v = node[np.concatenate(us)], node[np.concatenate(vs)]
            none = np.zeros(len(hit), np.int64)
            mask = np.r_[np.ones(len(hit), bool), np.zeros(len(u), bool)]
            cols = [pa.array(np.r_[node[hit], u]), pa.array(np.r_[none, v], mask=mask), pa.array(np.r_[count[hit], np.zeros(len(u), np.int64)], mask=~mask)]
            return pa.RecordBatch.from_arrays(cols, names=["u", "v", "links"])

        held, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            edge = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                k, part = tuple(keys[:, a].tolist()), batch.slice(a, b - a)
                if held is not None and k != held:
                    if (got := solve(*(np.concatenate(p) for p in zip(*parts, strict=True)))) is not None:
                        yield got
                    parts = []
                held = k
                parts.append((*(part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5)), unit(part.column(6))))
        if parts and (got := solve(*(np.concatenate(p) for p in zip(*parts, strict=True)))) is not None:
            yield got

    return dealt.mapInArrow(compare, "u long, v long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors` (vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite components link with nothing and
    are their own component. Vectors of different lengths never link. Rows with a null
    vec_id take part; a component of such rows only has a null component_id, and kept is
    false for them. Repeated rows link with each other. Other columns are ignored. A pair
    at the threshold is found with probability RECALL at least, closer ones more surely;
    what is counted is exact for all pairs of the groups that the passes have united.
    """
    base = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = F.coalesce(valid(), F.lit(False))
    good = base.where(ok)
    # One node per distinct vector; -0.0 and 0.0 are one value for grouping.
    nodes = good.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = written(scaled(nodes.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dim"), "embedding", "least_id", "copies")), "vectors")
    edges, used = candidates(nodes, threshold, window)
    edges = written(edges.distinct(), "vector-candidates")
    discard(*used)
    groups = connected_components(edges)
    nodes = nodes.drop("x")
    found = written(links(nodes.join(groups, "node"), threshold), "vector-links")
    discard(edges, groups)
    roots = connected_components(found.where("v is not null").select("u", "v").distinct())
    counted = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    members = written(nodes.join(roots, "node").select("node", "root", "least_id"), "vector-members")
    least = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    facts = members.select("node", "root").join(counted, "node").join(least, "root").select("node", "links", "component_id")
    facts = nodes.join(facts, "node", "left").select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    linked = good.join(facts, "embedding").select("vec_id", "n_links", "component_id")
    alone = base.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
