"""Operator 1: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A
flow network routes each pattern's token capacity to source quotas: source node ->
pattern, one edge per repetition with a convex cost (the k-th copy costs k - 1), then
pattern -> its sources -> quota. The flow says how many tokens a pattern gives, hence how
many full copies each of its documents has and which share of them gets one more. That
share is filled per document size, from the largest size to the smallest with the rounding
error carried on and what is still missing made up by single documents or swaps; inside a
size, documents are taken in the order of a seeded hash.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

SEED = 7
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
MAX_PATTERNS = 100_000  # patterns the driver's flow network may hold; more is an error, never a cut
BUCKETS = 1024


def word_count(text="text"):
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights=WEIGHTS, cap: int = MAX_REPEATS) -> dict:
    """Targets by source: sources by code point (None last) weigh `weights` in turn and share all sizes; none exceeds cap times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            out |= share
            break
        for s in above:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = MAX_REPEATS) -> tuple[dict, dict]:
    """({(pattern index, source): tokens}, {source: shortage}) of the cheapest flow that fills the most quota.

    Successive shortest paths; token amounts are whole numbers. patterns: (sources, tokens).
    """
    edges: list[list] = []  # to, capacity, cost
    out: dict = defaultdict(list)

    def add(a, b, capacity, cost):
        out[a].append(len(edges))
        edges.append([b, capacity, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, (members, tokens) in enumerate(patterns):
        for k in range(repeats):
            add("from", ("p", i), tokens, k)
        for s in members:
            if s in quotas:
                add(("p", i), ("s", s), repeats * tokens, 0)
    for s, q in quotas.items():
        add(("s", s), "to", round(q), 0)
    while True:
        cost, via, queue, queued = {"from": 0}, {}, deque(["from"]), {"from"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                b, capacity, c = edges[e]
                if capacity > 0 and cost[a] + c < cost.get(b, float("inf")):
                    cost[b], via[b] = cost[a] + c, e
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "to" not in via:
            break
        path, b = [], "to"
        while b != "from":
            path.append(via[b])
            b = edges[via[b] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    flow = {(i, edges[e][0][1]): edges[e ^ 1][1] for i in range(len(patterns)) for e in out["p", i] if edges[e][0][0] == "s" and edges[e ^ 1][1]}
    given = defaultdict(int)
    for (_, s), x in flow.items():
        given[s] += x
    return flow, {s: round(q) - given[s] for s, q in quotas.items()}


def nearer(sizes: list[int], counts: list[int], take: list[int], carry: float) -> list[int]:
    """take, changed so that less is missing (carry, negative if too much): one document more, less, or one swapped for another, the best first. sizes descend.

    Greedy moves end when less than a word is missing, none helps, or after 40 of them; what
    is left is then a few words. Where documents are few (their number times the goal within
    2**31 bits) the nearest reachable sum is found exactly; beyond that greedy moves are near
    enough, as many sizes offer many swaps.
    """
    from bisect import bisect_left

    take = list(take)
    for _ in range(40):
        if abs(carry) < 1:
            break
        add = [i for i in range(len(sizes)) if sizes[i] and take[i] < counts[i]][::-1]
        cut = [i for i in range(len(sizes)) if sizes[i] and take[i]][::-1]
        best, move = abs(carry), None
        for plus, minus, goal in ((add, None, carry), (None, cut, -carry)):
            side = plus or minus or []
            at = bisect_left(side, goal, key=lambda i: sizes[i])
            for i in side[max(0, at - 1) : at + 1]:
                left = abs(goal - sizes[i])
                if left < best:
                    best, move = left, ((i, None) if plus else (None, i))
        for i in add:
            at = bisect_left(cut, sizes[i] - carry, key=lambda j: sizes[j])
            for j in cut[max(0, at - 1) : at + 1]:
                left = abs(carry - sizes[i] + sizes[j])
                if left < best:
                    best, move = left, (i, j)
        if move is None:
            break
        i, j = move
        if i is not None:
            take[i] += 1
            carry -= sizes[i]
        if j is not None:
            take[j] -= 1
            carry += sizes[j]
    goal = round(carry + sum(s * t for s, t in zip(sizes, take, strict=True)))
    items = [i for i in range(len(sizes)) if sizes[i] for _ in range(counts[i])]
    if abs(carry) < 1 or len(items) * goal > 1 << 31:
        return take
    # Few documents: every reachable sum, a bit each, and the way back from the nearest.
    reach = [1]
    for i in items:
        reach.append((reach[-1] | reach[-1] << sizes[i]) & ((1 << 2 * goal + 1) - 1))
    top = reach[-1]
    low = (top & ((1 << goal + 1) - 1)).bit_length() - 1
    above = top >> goal
    high = goal + (above & -above).bit_length() - 1 if above else None
    at = high if high is not None and high - goal < goal - low else low
    take = [0] * len(sizes)
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> at & 1:
            take[items[k - 1]] += 1
            at -= sizes[items[k - 1]]
    return take


def mix(docs: DataFrame, members, quotas=capped_targets, seed: int = SEED, repeats: int = MAX_REPEATS, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (with a long `size`) plus source_size, target, copies and taken (words the mix takes, repeats counted).

    members: a Column, the array of a row's sources (it may hold null, a source of its
    own; an empty or null array belongs to none and is never taken). quotas: {source:
    tokens}, or a function that makes it from {source: size}. source_size and target are
    those of the row's first source (code point order, null last), or null.
    key: the columns whose seeded hash orders documents. Equal rows are interchangeable. An empty table mixes to nothing. Rows of size 0 count
    as taken 0 times. Only one row per membership pattern goes to the driver, and
    more than MAX_PATTERNS patterns are an error. Columns source_size, target, copies and
    taken are replaced; others pass through.
    """
    spark = docs.sparkSession
    cols = [c for c in docs.columns if c not in ("source_size", "target", "copies", "taken")]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols], F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))).alias("_members"))
    found = docs.groupBy("_members").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = sorted(((tuple(r["_members"]), int(r["n"] or 0)) for r in found), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict = defaultdict(int)
    for m, n in patterns:
        for s in m:
            sizes[s] += n
    goal = quotas(dict(sizes)) if callable(quotas) else dict(quotas)
    flow, _ = min_cost_flow(patterns, goal, repeats)
    rows = []
    for i, (m, n) in enumerate(patterns):
        total = sum(flow.get((i, s), 0) for s in m)
        full, rest = divmod(total, n) if n else (0, 0)
        rows.append((list(m), i, full, rest, n, sizes[m[0]] if m else None, float(goal[m[0]]) if m and m[0] in goal else None))
    plan = spark.createDataFrame(rows, "_members array<string>, _p int, _full long, _rest long, _all long, source_size long, target double")
    # One row per pattern, at most MAX_PATTERNS of them: a proven bound for the broadcast.
    docs = docs.join(F.broadcast(plan.select("_members", "_p", "_full", "source_size", "target")), "_members").drop("_members")
    docs = docs.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key])).withColumn("_b", F.shiftrightunsigned("_h", 54).cast("int"))
    cell = ["_p", "size", "_b"]
    hist = written(docs.groupBy(*cell).count(), "mixing-cells")
    share = {r[1]: (r[3], r[4]) for r in rows}

    def fill(key, pdf):
        """How many documents of each size the extra copy goes to; pdf: a pattern's distinct sizes."""
        rest, whole = share[int(key[0])]
        pdf = pdf.sort_values("size", ascending=False)
        out, carry = [], 0.0
        for s, c in zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True):
            want = carry + (s * c * rest / whole if whole else 0.0)
            n = min(c, max(0, int(want / s + 0.5))) if s else 0
            out.append(n)
            carry = want - n * s
        pdf["take"] = nearer(pdf["size"].tolist(), pdf["n"].tolist(), out, carry)
        return pdf[["_p", "size", "take"]]

    take = hist.groupBy("_p", "size").agg(F.sum("count").alias("n")).groupBy("_p").applyInPandas(fill, "_p int, size long, take long")
    from pyspark.sql import Window as W

    upto = W.partitionBy("_p", "size").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("count").over(upto), F.lit(0))).join(take, ["_p", "size"])
    hist = hist.select(*cell, F.greatest(F.lit(0), F.col("take") - F.col("_before")).alias("_take"))
    docs = docs.repartition(partitions(spark), *cell).withColumn("_rank", F.row_number().over(W.partitionBy(*cell).orderBy("_h")))
    docs = docs.join(hist, cell)
    copies = F.when(F.col("size") > 0, F.col("_full") + F.when(F.col("_rank") <= F.col("_take"), 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    return docs.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*[F.col(f"`{c}`") for c in cols], "source_size", "target", "copies", "taken")
