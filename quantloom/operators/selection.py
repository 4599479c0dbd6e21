"""Diversified baskets. The matrices come from the cluster; these small iterations run on the driver over N^2 numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIE = 1e-12


def anchor_first(ranked, available, n: int, anchors=()) -> list[str]:
    """Anchors, then the ranked names, then the rest of the universe; unique, at most n."""
    pool = set(available)
    return list(dict.fromkeys(t for t in [*anchors, *ranked, *available] if t in pool))[:n]


def _most_liquid(tied, names, volume):
    """The tied index with the most volume; the first of equals."""
    return max(tied, key=lambda i: (volume.get(names[i], 0.0), -i))


def furthest_first(d: np.ndarray, seeds: list[int], n: int) -> list[int]:
    """Seeds, then the point furthest from all chosen ones (first of equals)."""
    chosen = list(seeds)
    while len(chosen) < min(n, len(d)):
        near = d[:, chosen].min(axis=1) if chosen else d.sum(axis=1)
        near[chosen] = -np.inf
        chosen.append(int(near.argmax()))
    return chosen[:n]


def greedy_maximin(names, d, volume: dict, n: int, anchors) -> list[tuple[str, float | None]]:
    """(ticker, distance to those before it), the furthest first; ties go to volume."""
    at = {t: i for i, t in enumerate(names)}
    out, chosen = [], []
    for a in [a for a in anchors if a in at][:n]:
        out.append((a, float(d[at[a], chosen].min()) if chosen else None))
        chosen.append(at[a])
    while len(chosen) < min(n, len(names)):
        near = d[:, chosen].min(axis=1) if chosen else d.sum(axis=1)
        near[chosen] = -np.inf
        best = near.max()
        pick = _most_liquid(np.flatnonzero(np.abs(near - best) < TIE).tolist(), names, volume)
        out.append((names[pick], float(best)))
        chosen.append(pick)
    return out


def k_medoids(names, d, volume: dict, n: int, anchors, rounds: int = 25) -> list[dict]:
    """Medoid rows with cluster diagnostics; anchors stay medoids. Order: anchors, then size, distance, ticker."""
    at = {t: i for i, t in enumerate(names)}
    fixed = [at[a] for a in anchors if a in at][:n]
    medoids = furthest_first(d, fixed, min(n, len(names)))
    for _ in range(rounds):
        owner, moved = d[:, medoids].argmin(axis=1), list(medoids)
        for p, m in enumerate(medoids):
            members = np.flatnonzero(owner == p)
            if m in fixed or not len(members):
                continue
            total = d[np.ix_(members, members)].sum(axis=1)
            moved[p] = _most_liquid(members[np.abs(total - total.min()) < TIE].tolist(), names, volume)
        if moved == medoids:
            break
        medoids = moved
    owner = d[:, medoids].argmin(axis=1)
    rows = []
    for p, m in enumerate(medoids):
        members = np.flatnonzero(owner == p)
        rows.append({"ticker": names[m], "cluster_size": len(members), "avg_cluster_distance": float(d[members, m].mean()) if len(members) else None, "is_anchor_medoid": int(m in fixed)})
    place = {names[i]: k for k, i in enumerate(fixed)}
    rows.sort(key=lambda r: (r["ticker"] not in place, place.get(r["ticker"], 0), -r["cluster_size"], r["avg_cluster_distance"] or 0.0, r["ticker"]))
    return [r | {"selection_rank": i} for i, r in enumerate(rows, 1)]


def equal_weight_dr(cov: np.ndarray) -> float:
    """Mean volatility over the equal-weight portfolio's; 1 for a degenerate one."""
    sd = np.sqrt(max(cov.sum(), 0.0)) / len(cov)
    return float(np.sqrt(np.diag(cov)).mean() / sd) if sd >= 1e-14 else 1.0


def greedy_max_dr(names, cov, volume: dict, n: int, anchors) -> list[tuple[str, float | None]]:
    """(ticker, diversification ratio of the basket so far); each step tries every candidate by running sums."""
    at = {t: i for i, t in enumerate(names)}
    sd, out, chosen = np.sqrt(np.diag(cov)), [], []
    for a in [a for a in anchors if a in at][:n]:
        chosen.append(at[a])
        out.append((a, equal_weight_dr(cov[np.ix_(chosen, chosen)]) if len(chosen) > 1 else None))
    while len(chosen) < min(n, len(names)):
        k = len(chosen) + 1
        total = cov[np.ix_(chosen, chosen)].sum() + 2 * cov[chosen].sum(axis=0) + np.diag(cov)
        risk = np.sqrt(np.maximum(total, 0)) / k
        dr = np.where(risk >= 1e-14, (sd[chosen].sum() + sd) / k / np.maximum(risk, 1e-300), 1.0)
        dr[chosen] = -np.inf
        best = dr.max()
        pick = _most_liquid(np.flatnonzero(np.abs(dr - best) < TIE).tolist(), names, volume)
        chosen.append(pick)
        out.append((names[pick], float(best)))
    return out


def first_weak_step(values: list[float | None], least: float = 0.01) -> int | None:
    """The first step (from 1) whose gain over the step before is under `least`."""
    for i in range(1, len(values)):
        if values[i - 1] and values[i] is not None and values[i] / values[i - 1] - 1 < least:
            return i + 1
    return None


def ward_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Ward merges (left, right, height, size) by the Lance-Williams rule; the smaller id is left."""
    n = len(d)
    dist = d.astype(float).copy()
    np.fill_diagonal(dist, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    live = np.ones(n, bool)
    for step in range(n - 1):
        sub = np.where(live[:, None] & live[None], dist, np.inf)
        i, j = divmod(int(sub.argmin()), n)
        i, j = sorted((i, j), key=lambda k: ids[k])
        h = dist[i, j]
        out.append((ids[i], ids[j], float(h), int(size[i] + size[j])))
        t = size[i] + size[j] + size
        new = np.sqrt(np.maximum(((size[i] + size) * dist[i] ** 2 + (size[j] + size) * dist[j] ** 2 - size * h**2) / t, 0))
        dist[i], dist[:, i] = new, new
        dist[i, i], live[j] = np.inf, False
        ids[i], size[i] = n + step, size[i] + size[j]
    return out


def leaf_order(merges, n: int) -> list[int]:
    kids = {n + k: (a, b) for k, (a, b, _, _) in enumerate(merges)}
    out, stack = [], [n + len(merges) - 1 if merges else 0]
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            stack += [kids[x][1], kids[x][0]]
    return out


def ward_selection(names, d, volume: dict, clusters: int, anchors=()) -> list[dict]:
    """One ticker per Ward cluster: its anchor, else the member nearest to the others (ties: volume)."""
    n = len(names)
    members = {i: [i] for i in range(n)}
    for k, (a, b, _, _) in enumerate(ward_linkage(d)[: max(0, n - clusters)]):
        members[n + k] = members.pop(a) + members.pop(b)
    rows = []
    for m in members.values():
        fixed = [names[i] for i in m if names[i] in anchors]
        total = d[np.ix_(m, m)].sum(axis=1)
        tied = [m[i] for i in np.flatnonzero(np.abs(total - total.min()) < TIE)]
        rows.append({"ticker": fixed[0] if fixed else names[_most_liquid(tied, names, volume)], "cluster_size": len(m)})
    return sorted(rows, key=lambda r: (r["ticker"] not in anchors, -r["cluster_size"], r["ticker"]))


def pca_loadings(names, corr: np.ndarray, k: int) -> list[dict]:
    """pc_rank, variance_explained, ticker, loading: each component's ticker of the largest loading not taken before."""
    values, vectors = np.linalg.eigh(corr)
    rows, taken = [], set()
    for rank in range(min(k, len(names))):
        v = vectors[:, -1 - rank]
        pick = next(i for i in np.argsort(-np.abs(v), kind="stable").tolist() if i not in taken)
        taken.add(pick)
        rows.append({"pc_rank": rank + 1, "variance_explained": float(values[-1 - rank] / values.sum()), "ticker": names[pick], "loading": float(abs(v[pick]))})
    return rows


def basket(spark: SparkSession, picks: list[tuple[str, float | None]]) -> DataFrame:
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(picks, 1)], "rank int, ticker string, marginal double")


def membership(baskets: DataFrame) -> DataFrame:
    """Per ticker: rank by method (pivot), counts and consensus ranks; baskets: method, rank, ticker. Missing ranks count as the method's length plus one."""
    sizes = baskets.groupBy("method").agg((F.max("rank") + 1).alias("penalty"))
    names = baskets.select("ticker").distinct()
    every = names.crossJoin(F.broadcast(sizes))  # one row per selection method
    full = every.join(baskets, ["method", "ticker"], "left")
    return full.groupBy("ticker").agg(F.count("rank").alias("selection_count"), F.sum(F.col("rank").isNull().cast("int")).alias("missing_rank_count"), F.avg("rank").alias("average_rank_selected_only"), F.avg(F.coalesce("rank", "penalty").cast("double")).alias("average_rank"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "rank")))).alias("ranks")).orderBy("average_rank", "average_rank_selected_only", "missing_rank_count", "ticker")


def consensus(baskets: DataFrame, n: int) -> DataFrame:
    """The first n tickers of membership(): ticker, selection_count and one <method>_rank column per method."""
    methods = [r[0] for r in baskets.select("method").distinct().orderBy("method").collect()]  # a handful
    return membership(baskets).limit(n).select("ticker", "selection_count", *[F.col("ranks")[m].alias(f"{m}_rank") for m in methods])


def merged(baskets: DataFrame, stats: DataFrame, anchors=()) -> DataFrame:
    """Per selected ticker: a 0/1 column per method, method_count, is_anchor, its figures of `stats` (ticker, sharpe, ...) and avg_method_sharpe, the mean Sharpe ratio over the methods that hold it."""
    methods = [r[0] for r in baskets.select("method").distinct().orderBy("method").collect()]
    flags = baskets.groupBy("ticker").agg(*[F.max((F.col("method") == m).cast("int")).alias(m) for m in methods], F.countDistinct("method").alias("method_count"))
    own = baskets.join(stats.select("ticker", "sharpe"), "ticker", "left").groupBy("ticker").agg(F.avg("sharpe").alias("avg_method_sharpe"))
    out = flags.withColumn("is_anchor", F.col("ticker").isin(*anchors).cast("int") if anchors else F.lit(0))
    return out.join(stats, "ticker", "left").join(own, "ticker").orderBy(F.desc("method_count"), "ticker")


def overlap(baskets: DataFrame) -> DataFrame:
    """method_a, method_b, n_common, zero pairs included."""
    m = baskets.select("method").distinct()
    grid = m.select(F.col("method").alias("method_a")).crossJoin(F.broadcast(m.select(F.col("method").alias("method_b"))))  # a handful of methods
    a, b = baskets.select(F.col("method").alias("method_a"), "ticker"), baskets.select(F.col("method").alias("method_b"), "ticker")
    common = a.join(b, "ticker").groupBy("method_a", "method_b").agg(F.count("*").alias("n_common"))
    return grid.join(common, ["method_a", "method_b"], "left").na.fill(0, ["n_common"])
