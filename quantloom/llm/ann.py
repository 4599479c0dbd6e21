"""Operator 8: approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional codewords are fitted stage by stage on a bounded sample
(SAMPLE vectors, by a seeded hash): k-means on the residual, then one least-squares update of
all codebooks together. Every vector is encoded by beam search over the codebooks; its code
is stored, with its norm and that of its reconstruction. A query's inner products with all
codewords form a lookup table; a candidate's estimate is a sum of table entries, stretched
by the two norms, since a reconstruction is shorter than its vector. The best of each block
are reranked exactly on the original vectors. Vectors meet queries of their own length; a
length the sample doesn't hold has no codebooks, and its few vectors are compared exactly.

All codes are scanned for each query. A coarse partition was measured and left out: by inner
product these vectors have no cells worth probing (the README has the figures).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, written
from .embeddings import valid

STAGES, WORDS, BEAM = 16, 256, 4
SAMPLE = 8192
BLOCK = 1 << 15  # vectors of a block
LEAST_BLOCKS = 8
QUERIES = 1 << 13  # queries of a block
RERANK = 100  # candidates that each block reranks for a query, at least
SHARE = 64  # and one of so many of the block's vectors
SEED = 17


def kmeans(x, k: int, rng, rounds: int = 6):
    import numpy as np

    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = (2 * x @ centres.T - (centres * centres).sum(1)).argmax(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.r_[0, np.cumsum(count)[:-1]], len(x) - 1), axis=0)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def encode(x, books, beam: int = BEAM):
    """Codes by beam search: at each stage the best partial sums go on."""
    import numpy as np

    n, stages = len(x), len(books)
    codes = np.zeros((n, 1, stages), np.uint8)
    rest = x[:, None, :].astype(np.float32)
    err = (rest * rest).sum(2)
    for s, book in enumerate(books):
        k = len(book)
        gain = err[:, :, None] - 2 * (rest.reshape(-1, x.shape[1]) @ book.T).reshape(n, -1, k) + (book * book).sum(1)
        flat = gain.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        err = np.take_along_axis(flat, best, 1)
        path, word = best // k, best % k
        codes = np.take_along_axis(codes, path[:, :, None], 1)
        codes[:, :, s] = word
        rest = np.take_along_axis(rest, path[:, :, None], 1) - book[word]
    best = err.argmin(1)
    return codes[np.arange(n), best]


def decode(codes, books):
    return sum(book[codes[:, s]] for s, book in enumerate(books))


def fit(x, stages: int = STAGES, words: int = WORDS, seed: int = SEED):
    """Codebooks (float32) from a sample."""
    import numpy as np

    rng, rest, books = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(stages):
        book = kmeans(rest, words, rng)
        books.append(book)
        rest = rest - book[(2 * rest @ book.T - (book * book).sum(1)).argmax(1)]
    if len(x) > 4 * words:
        k = sum(map(len, books))
        base = np.cumsum([0, *map(len, books[:-1])])
        gram, right = np.zeros((k, k)), np.zeros((k, x.shape[1]))
        for i in range(0, len(x), 512):  # bounded memory on the driver
            part = x[i : i + 512]
            onehot = np.zeros((len(part), k), np.float32)
            np.put_along_axis(onehot, encode(part, books).astype(np.int64) + base, 1, axis=1)
            gram += onehot.T @ onehot
            right += onehot.T @ part
        new = np.linalg.solve(gram + np.eye(k), right + np.vstack(books)).astype(np.float32)
        books = np.split(new, base[1:])
    return [b.astype(np.float32) for b in books]


def build(vectors: DataFrame, sample: int = SAMPLE, stages: int = STAGES, words: int = WORDS) -> DataFrame:
    """The index: dim, block, vec_id, embedding (double), code, norm of the vector and of the reconstruction.

    Takes vec_id and embedding; rows whose id is null or whose vector is null, zero or not
    finite take no part.
    """
    import numpy as np

    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(F.coalesce(valid(), F.lit(False)))
    n = good.count()
    picked = good.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "embedding").limit(sample).select("embedding").toArrow().column(0).to_pylist()
    books = {d: fit(np.array([v for v in picked if len(v) == d]), stages, words) for d in sorted({len(v) for v in picked})}
    shared = spark.sparkContext.broadcast(books)  # stages * words codewords, of the sample's lengths
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            size = batch.column(0).to_numpy()
            for d in np.unique(size).tolist():
                rows = batch.filter(pa.array(size == d))
                own = shared.value.get(d)
                for i in range(0, rows.num_rows, 1024):
                    part = rows.slice(i, 1024)
                    x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    norm = np.linalg.norm(x, axis=1)
                    codes = encode(x, own) if own else np.zeros((len(x), 0), np.uint8)
                    short = np.linalg.norm(decode(codes, own), axis=1).astype(np.float64) if own else norm
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(short)], names=["dim", "block", "vec_id", "embedding", "code", "norm", "short"])

    dealt = good.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")
    index = written(dealt.mapInArrow(run, "dim int, block int, vec_id long, embedding array<double>, code binary, norm double, short double"), "ann-index")
    index.books, index.blocks = books, blocks
    return index


def search(index: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by inner product, nearest first, ties to the smaller vec_id.

    index: from build(). queries: vec_id, embedding (rows as build() takes them). A
    query's own id is no candidate; repeated candidate rows each count. Query blocks meet
    vector blocks of their length, each meeting in a task of bounded size; each hands on k
    rows a query.
    """
    books, blocks = index.books, index.blocks
    n = queries.count()
    chunks = max(1, -(-n // QUERIES))
    shared = index.sparkSession.sparkContext.broadcast(books)
    none = F.lit(None)
    left = queries.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "block", "chunk", "vec_id", "embedding", none.cast("binary").alias("code"), none.cast("double").alias("stretch"))
    right = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).select("dim", "block", "chunk", "vec_id", "embedding", "code", F.expr("if(short > 0, norm / short, 1.0D)").alias("stretch"))
    both = left.unionByName(right)

    def run(table):
        import numpy as np
        import pyarrow as pa

        ids = table["vec_id"].to_numpy()
        flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(len(ids), -1)
        is_query = table["code"].is_null().to_numpy()
        q, qid = x[is_query], ids[is_query]
        at = np.flatnonzero(~is_query)
        at = at[np.argsort(ids[at], kind="stable")]
        out: list[list] = [[], [], []]
        if len(q) and len(at):
            v, vid = np.ascontiguousarray(x[at]), ids[at]
            codes = np.frombuffer(b"".join(table["code"].take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
            stretch = table["stretch"].to_numpy()[at].astype(np.float32)
            own = shared.value.get(x.shape[1])
            take = min(max(rerank, len(at) // SHARE) + 1, len(at))
            for a in range(0, len(q), 64):
                part = q[a : a + 64]
                if own:
                    estimate = np.zeros((len(part), len(at)), np.float32)
                    for s, book in enumerate(own):
                        estimate += (part.astype(np.float32) @ book.T)[:, codes[:, s]]
                    estimate *= stretch
                else:
                    estimate = part @ v.T
                floor = np.partition(estimate, len(at) - take, axis=1)[:, len(at) - take]
                for i in range(len(part)):
                    row = estimate[i]
                    pick = np.flatnonzero(row >= floor[i])
                    if len(pick) > take:  # ties at the floor: the smaller ids
                        above = pick[row[pick] > floor[i]]
                        pick = np.sort(np.r_[above, pick[row[pick] == floor[i]][: take - len(above)]])
                    pick = pick[vid[pick] != qid[a + i]]
                    exact = np.cumsum(v[pick] * part[i], axis=1)[:, -1]  # summed in the order of the components
                    best = np.lexsort((vid[pick], -exact))[:k]
                    out[0].append(np.full(len(best), qid[a + i]))
                    out[1].append(vid[pick][best])
                    out[2].append(exact[best])
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64 if j < 2 else np.float64) for j, c in enumerate(out)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    local = both.groupBy("dim", "block", "chunk").applyInArrow(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
