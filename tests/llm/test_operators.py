import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import ann, bpe, chat, embeddings, mixing, pii, queries, simhash, substrings, token_files, toxicity
from quantloom.llm.components import connected_components

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "\n\t", "x" * 70000, "é" * 3000, "İstanbul ΣΑΣ ﬁ é", "a b c\u0085d", "<|startoftext|>hi<|endoftext|>", "it's we'll 12 34%", "w " * 5000, "\x1c\x1d a\x1fb", "日本語 テキスト", "😀😀 ok", "+1 (555) 555-0100", "a@b.c", "1.2.3.4"]


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table plus odd rows, repeated rows and an extra column with a clashing name."""
    rows = [(10_000 + i, t, None if i % 3 else "en", [None, "srcA", "src0"][i % 3], None) for i, t in enumerate(ODD)]
    extra = spark.createDataFrame(rows, DOCS)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return d.unionByName(extra).withColumn("size", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("row", F.lit("r")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "source").collect()


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- operator 1 ---


def test_targets():
    assert mixing.capped_targets({"a": 10, "b": 10, "c": 10}) == {"a": pytest.approx(18.75), "b": pytest.approx(7.5), "c": pytest.approx(3.75)}
    got = mixing.capped_targets({"a": 1, None: 10, "b": 10})
    assert got["a"] == 3 and sum(got.values()) == pytest.approx(21) and got["b"] == pytest.approx(12)
    assert mixing.capped_targets({}) == {} and mixing.capped_targets({"a": 0}) == {"a": 0}


def test_flow_prefers_fewer_repeats():
    flow, short = mixing.min_cost_flow([(("a",), 10), (("a", "b"), 10)], {"a": 15, "b": 10})
    assert sum(x for (_, s), x in flow.items() if s == "a") == 15 and not any(short.values())
    assert sum(x for (p, _), x in flow.items() if p == 0) <= 20
    _, short = mixing.min_cost_flow([(("a",), 10)], {"a": 50})
    assert short == {"a": 20}


def test_flow_is_optimal():
    """Filled quota and convex repetition cost against every possible routing of small networks."""
    import itertools

    r = random.Random(12)
    for _ in range(40):
        patterns = [(m, r.randint(1, 2)) for m in r.sample([("a",), ("b",), ("a", "b")], r.randint(1, 3))]
        quotas = {"a": r.randint(0, 5), "b": r.randint(0, 5)}
        arcs = [(i, s) for i, (m, _) in enumerate(patterns) for s in m]
        cost = lambda used: sum(k * min(n, max(0, u - k * n)) for u, (_, n) in zip(used, patterns) for k in range(3))
        best = None
        for x in itertools.product(*[range(3 * patterns[i][1] + 1) for i, _ in arcs]):
            used = [sum(v for v, (j, _) in zip(x, arcs) if j == i) for i in range(len(patterns))]
            given = {s: sum(v for v, (_, t) in zip(x, arcs) if t == s) for s in quotas}
            if all(u <= 3 * n for u, (_, n) in zip(used, patterns)) and all(given[s] <= quotas[s] for s in quotas):
                key = (-sum(given.values()), cost(used))
                best = key if best is None or key < best else best
        flow, short = mixing.min_cost_flow(patterns, quotas)
        used = [sum(v for (j, _), v in flow.items() if j == i) for i in range(len(patterns))]
        assert (-sum(flow.values()), cost(used)) == best and sum(short.values()) == sum(quotas.values()) + best[0]


def test_mixing_repeated_ids(spark):
    """Rows that share one doc_id and size are told apart by their rank."""
    d = spark.createDataFrame([(1, "a", 10)] * 50 + [(i, "b", 10) for i in range(50)], "doc_id long, source string, size long")
    got = mixing.mix(d, F.array("source"), {"a": 250, "b": 750}).toPandas()
    assert got.groupby("source").taken.sum().to_dict() == {"a": 250, "b": 750} and len(got) == 100


def test_mixing(spark, docs, rows):
    sized = docs.withColumn("size", mixing.word_count())
    got = mixing.mix(sized, F.array("source")).toPandas()
    size = {r.doc_id: len(brute.WORDS.findall(r.text or "")) for r in rows}
    assert len(got) == len(rows) and dict(zip(got.doc_id, got["size"])) == size
    by = got.groupby("source", dropna=False)
    for _, g in by:
        assert (g.source_size == g["size"].sum()).all() and abs(g.taken.sum() - g.target.iloc[0]) <= max(2, 0.01 * g.target.iloc[0])
    assert by.target.first().sum() == pytest.approx(sum(size.values()))
    assert ((got.taken == 0) | (got.taken % got["size"].clip(lower=1) == 0)).all() and (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(sized.repartition(5), F.array("source")).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))
    assert mixing.mix(empty(spark).withColumn("size", F.lit(1).cast("long")), F.array("source")).count() == 0


def test_mixing_overlap(spark):
    d = spark.createDataFrame([(i, ["a"] if i < 50 else ["a", "b"] if i < 100 else [] if i < 110 else None, 10) for i in range(120)], "doc_id long, m array<string>, size long")
    got = mixing.mix(d, F.col("m"), {"a": 700, "b": 300}).toPandas()
    assert got.taken.sum() == 1000 and got[got.doc_id >= 100].taken.sum() == 0


# --- operators 2 and 7 ---


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, docs, rows):
    t = library()
    got = {r.doc_id: r for r in bpe.encode_documents(docs, queries.vocabulary(), ids=True).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert list(g.ids) == ids and g.n_tokens == len(ids), r.doc_id
        assert g.decoded == t.decode(ids, skip_special_tokens=False)
        assert g.decoded_sha256 == brute.sha(g.decoded) and g.ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes())
    assert bpe.encode_documents(empty(spark), queries.vocabulary()).count() == 0


def test_bpe_random_strings():
    t = library()
    with open(queries.vocabulary(), encoding="utf-8") as f:
        c = bpe.BpeCodec(f.read())
    r = random.Random(1)
    pool = "aabcdefgABCéÉñßŸΣσςİı'’’stȩ́́ \n\t  \x1c\x85.,!?123٣Ⅷ½日語😀‍<|>_-$%"
    for _ in range(1500):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(c.encode([s])[0], "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_token_files(spark, docs, rows, tmp_path):
    t = library()
    files = token_files.write_token_files(docs.repartition(3), queries.vocabulary())
    got = token_files.read_token_files(files).orderBy("doc_id").collect()
    at = 0
    for r, g in zip(sorted(rows, key=lambda r: r.doc_id), got, strict=True):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    n = token_files.export_files(files, str(tmp_path))
    # The exported files alone tell all of it.
    base, from_files = 0, []
    for p in sorted(tmp_path.iterdir()):
        image = p.read_bytes()
        before, count = token_files.trailer(image)[3:]
        from_files += list(zip(*(list(c) for c in token_files.located(image, base - before)), strict=True))
        base += count
    assert n == len(list(tmp_path.iterdir())) and base == at
    assert [(int(d), int(a), int(k), c) for d, none, a, k, c in from_files if not none] == [tuple(g) for g in got]
    assert token_files.read_token_files(token_files.write_token_files(empty(spark), queries.vocabulary())).count() == 0


def test_token_files_cut_and_repeats(spark, monkeypatch):
    """Files that end after a few ids, a document larger than a file, null and repeated ids."""
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    t = library()
    texts = ["a b c"] * 30 + ["word " * 400, None, ""] + ["x y z w"] * 20
    d = spark.createDataFrame([(None if i % 7 == 0 else i // 3, x) for i, x in enumerate(texts)], "doc_id long, text string")
    files = token_files.write_token_files(d, queries.vocabulary())
    got = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    assert files.count() > 5 and [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    keys = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    crc = lambda x: zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i % 7 == 0, 0 if i % 7 == 0 else i // 3, crc(x)) for i, x in enumerate(texts))


def test_codec_refuses_other_files():
    import json

    with open(queries.vocabulary(), encoding="utf-8") as f:
        j = json.load(f)
    for key, other in (("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFC"}]}), ("decoder", {"type": "BPEDecoder"}), ("pre_tokenizer", None)):
        with pytest.raises(ValueError, match=key):
            bpe.BpeCodec(json.dumps({**j, key: other}))


def test_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from quantloom.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)


def test_bit_planes():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0, "<u4"), np.zeros(70_000, "<u4"), r.integers(0, 1 << 32, 200_001, dtype=np.uint64).astype("<u4")):
        image = token_files.pack(ids)
        assert (token_files.unpack(image) == ids).all()
        assert (token_files.unpack(image, range(1, 2)) == ids[65536:131072]).all() if len(ids) > 65536 else True


# --- operator 3 ---


@pytest.mark.parametrize("many", [1, 3, 64])
def test_repeats_small_alphabet(spark, many):
    """Short strings over few letters: overlaps, self-repeats, hot groups split before the index and not."""
    r = random.Random(many)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "aaaa" * 30, "abcabcabcabcabcabcabcabcabcabc" * 2, "é" * 20, "xé" * 9]
    texts += [texts[3], texts[5] + "q" + texts[7], "z" + texts[9][:25]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in substrings.remove_repeats(d, length=20, gram=6, many=many, index_bytes=500).collect()}
    want = brute.removed([(t or "").encode() for t in texts], 20)
    assert got == dict(enumerate(want))


def test_repeats_hot_near_copies(spark):
    """Copies of one passage with an edit each, or cut at random: their hot groups are split."""
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh") for _ in range(120))
    texts = [base] * 2
    for _ in range(40):
        i, a = r.randrange(len(base)), r.randrange(60)
        texts.append(base[:i] + r.choice("xyz") + base[i + 1 :])
        texts.append(f"{r.random()} {base[a : a + r.randint(20, 60)]} {r.random()}")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: tuple(x)[1:] for x in substrings.remove_repeats(d, length=20, gram=6, many=4).collect()}
    assert got == dict(enumerate(brute.removed([t.encode() for t in texts], 20)))


def test_repeats_documents(spark, docs, rows):
    rows = sorted(rows, key=lambda r: r.doc_id)
    got = {x.doc_id: tuple(x)[1:] for x in substrings.remove_repeats(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute.removed([(r.text or "").encode() for r in rows])))
    assert substrings.remove_repeats(empty(spark)).count() == 0


def test_long_text_pieces():
    r = np.random.default_rng(2)
    data = r.integers(97, 100, substrings.PIECE, dtype=np.uint8)
    whole = substrings.anchors(data, np.array([0, len(data)]))
    part = substrings.anchors(data[1000:5000], np.array([0, 4000]))
    keep = (whole[0] > 1000) & (whole[1] < 1000 + 4000 - 400)
    a = set(zip(whole[0][keep].tolist(), whole[2][keep].tolist()))
    assert a <= set(zip((part[0] + 1000).tolist(), (part[2] + 1000).tolist()))


# --- operator 4 ---


def test_base_spans_random():
    r = random.Random(4)
    for _ in range(4000):
        s = "".join(r.choice("0123456789..@@+-- ()ab_,é") for _ in range(r.randint(0, 60)))
        got = {k: [] for k in pii.BASE_KINDS}
        for k, a, b in pii.base_spans(s):
            got[pii.BASE_KINDS[k]].append((a, b))
        assert got == brute.base(s), repr(s)


def test_pii(spark, docs, rows):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, want = got[r.doc_id], brute.base(r.text)
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [len(v) for v in want.values()]
        assert g.base_sha256 == brute.base_digest(r.text)
        for k, spans in want.items():
            assert all(f"{k}:{a}:{b}" in g.spans.split(",") for a, b in spans)
    assert pii.find(empty(spark)).count() == 0


def test_field_finds_what_patterns_miss():
    model, table = pii.train(), pii.char_classes()
    texts = ["reach me (743) 555-3824 or so", 'the token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" est', "in 1999 there were 12 of 300, or 4.50", "nothing here at all", "555-201-4477.", None]
    found = [[(pii.KINDS[k], t[a:b]) for k, a, b in full if k > 3] for t, (_, full) in zip(texts, pii.all_spans(texts, model, table))]
    assert found == [[("local_phone", "(743) 555-3824")], [("secret", "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e")], [], [], [("local_phone", "555-201-4477")], []]


def test_field_held_out():
    """Precision and recall on hand-labelled sentences, some of formats the training table doesn't make."""
    from .held_out_pii import ROWS

    hit, found, labelled = ({k: 0 for k in pii.KINDS[4:]} for _ in range(3))
    for (text, want), (_, full) in zip(ROWS, pii.all_spans([t for t, _ in ROWS], pii.train(), pii.char_classes())):
        got = [(pii.KINDS[k], text[a:b]) for k, a, b in full if k > 3]
        for k in hit:
            hit[k] += sum(x in want for x in got if x[0] == k)
            found[k] += sum(x[0] == k for x in got)
            labelled[k] += sum(x[0] == k for x in want)
    assert all(hit[k] >= 0.9 * found[k] and hit[k] >= 0.9 * labelled[k] for k in hit), (hit, found, labelled)


def test_viterbi_brute_force():
    import itertools

    r = np.random.default_rng(0)
    t, lens = r.normal(size=(3, 3)), np.array([4, 1, 5, 2])
    e = r.normal(size=(12, 3))
    got, at = pii.viterbi(e, t, lens), 0
    for n in lens:
        best = max(itertools.product(range(3), repeat=n), key=lambda y: sum(e[at + i, y[i]] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1)))
        assert got[at : at + n].tolist() == list(best)
        at += n


def test_mask(spark):
    d = spark.createDataFrame([(1, "mail a.b@c.de now", "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, spans string")
    assert [r.text for r in pii.mask(d).orderBy("doc_id").collect()] == ["mail [EMAIL] now", None, ""]


# --- operator 5 ---


def test_fingerprint():
    for t in [*ODD, "A b", "A B c", "one two three four ONE TWO THREE"]:
        assert simhash.fingerprint(t) == brute.fingerprint(t)


def test_simhash(spark, docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, ["doc_id"]).collect()}
    assert got == brute.simhash([(r.doc_id, r.text) for r in rows])
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.representatives(empty(spark)).count() == 0


def test_simhash_links_and_hot_tiles(spark, monkeypatch):
    """Fingerprints in clusters that share blocks; small tiles force the hot path."""
    r = random.Random(6)
    fps = set()
    for _ in range(12):
        c = r.getrandbits(64)
        for _ in range(25):
            x = c
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    u = np.array(fps).view(np.uint64)
    want = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 3])
    for tile, many in ((2048, 4_000_000), (4, 4_000_000), (2048, 10)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "MANY", many)
        edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
        at = {x: i for i, x in enumerate(fps)}
        assert brute.components(len(fps), [(at[a], at[b]) for a, b in edges]) == want


def test_representatives(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta " * 3
    d = spark.createDataFrame([(3, t, 1), (2, t, 2), (None, t, 3), (2, t, 4), (9, "quite another text it is", 5), (None, None, 6), (None, "", 7)], "doc_id long, text string, root int")
    got = simhash.representatives(d).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 2, 9] and d.columns == got[0].__fields__


def test_components(spark):
    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(500, x) for x in range(501, 600)] + [(7, 7)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute.components(600, pairs)
    assert all(want[n] == root for n, root in got.items()) and len(got) == len({n for p in pairs for n in p})


# --- operators 6 and 8 ---


def vectors(seed=0, n=700, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[100:160] = x[100] + 0.15 * r.normal(size=(60, dim)) * np.linalg.norm(x[100]) / np.sqrt(dim)
    for i in range(200, 300, 2):
        x[i + 1] = x[i] + 0.25 * np.linalg.norm(x[i]) / np.sqrt(dim) * r.normal(size=dim)
    x[310:330] = x[310]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[5], rows[6], rows[7], rows[8], rows[9] = (5, None), (6, [0.0] * dim), (7, [float("nan")] * dim), (8, [1.0, None] * (dim // 2)), (9, [float("inf")] * dim)
    return [*rows, (20, rows[20][1]), (None, rows[310][1]), (2000, [1.0, 2.0]), (2001, [1.0, 2.0]), (2002, []), (2020, [3.0, 6.1])]


KIND = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("links", T.StringType())])


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize(("tile", "window"), [(1024, 128), (16, 16)])
def test_embedding_duplicates(spark, monkeypatch, tile, window):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "RECALL", 1 - 1e-6)
    rows = vectors()
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, "c") for r in rows], KIND), window=window).collect()
    n = len(rows)
    x = [np.array(v) / np.linalg.norm(v) if usable(v) else None for _, v in rows]
    pairs = [(i, j) for i in range(n) for j in range(i) if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95]
    links = np.zeros(n, int)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    comp = brute.components(n, pairs)
    ids = [min([rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None], default=None) for i in range(n)]
    want = sorted([(-1 if r[0] is None else r[0], int(k), -1 if c is None else c) for r, k, c in zip(rows, links, ids)])
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embeddings.near_duplicates(spark.createDataFrame([], KIND)).count() == 0


def test_embedding_dense_group(spark):
    """A dense group of which most pairs are just below the threshold: no link is lost among such neighbours."""
    r = np.random.default_rng(8)
    centre = r.standard_normal(64)
    x = centre / np.linalg.norm(centre) + r.standard_normal((3000, 64)) / 8 / 3  # mean cosine about 0.9
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:300] + 0.2 / 8 * r.standard_normal((300, 64))
    x = np.vstack([x, y / np.linalg.norm(y, axis=1, keepdims=True)])
    near = x @ x.T >= 0.95
    got = embeddings.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")).collect()
    comp = brute.components(len(x), np.argwhere(np.triu(near, 1)).tolist())
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (int(k) - 1, comp[i]) for i, k in enumerate(near.sum(axis=1))}


def test_embedding_recall(spark):
    """Pairs just above the threshold among 50,000 vectors: recall by the promise, and one result for any dealing of the table."""
    r = np.random.default_rng(21)
    n, pairs, dim = 50_000, 1500, 64
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = r.standard_normal((pairs, dim))
    away -= (away * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cos = r.uniform(0.9501, 0.97, (pairs, 1))
    x[pairs : 2 * pairs] = cos * x[:pairs] + np.sqrt(1 - cos**2) * away
    d = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}))
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            results.append({v.vec_id: (v.n_links, v.component_id) for v in embeddings.near_duplicates(d.repartition(int(parts))).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    assert sum(results[0][i + pairs] == (1, i) for i in range(pairs)) >= 0.99 * pairs
    assert all(k in ((0, i), (1, i), (1, i - pairs)) for i, k in results[0].items())


def test_nearest(spark):
    rows = vectors(3, 900)
    index = ann.build(spark.createDataFrame([(*r, "c") for r in rows], KIND))
    got = pd.DataFrame(ann.search(index, index.where("vec_id % 20 = 0").select("vec_id", "embedding")).collect(), columns=["query_id", "rank", "vec_id", "score"])
    good = [(i, np.array(v)) for i, v in rows if i is not None and usable(v) and len(v) == 16]
    hit = total = 0
    for qid in sorted({i for i, _ in good if i % 20 == 0}):
        q = next(v for i, v in good if i == qid)
        best = sorted((-float((v * q).sum()), i) for i, v in good if i != qid)[:20]
        mine = got[got.query_id == qid].drop_duplicates("rank").sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine.score) <= 0).all() and qid not in set(mine.vec_id)
        for v, s in zip(mine.vec_id, mine.score):
            assert abs(next(w for i, w in good if i == v) @ q - s) < 1e-9
        hit += len({i for _, i in best} & set(mine.vec_id))
        total += len({i for _, i in best})
    assert hit / total >= 0.9


def test_nearest_ties_and_lengths(spark):
    """Equal scores rank by vec_id, vectors of every length take part, also of one the sample lacks."""
    rows = [(i, [1.0, float(i % 2)]) for i in range(1, 60)] + [(60, [1.0, 1.0]), (80, [2.0, 0.0, 1.0]), (81, [1.0, 1.0, 1.0]), (82, [0.0, 0.0, 3.0]), (100, [5.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sample in (8192, 40):
        index = ann.build(d, sample=sample)
        got = {}
        for r in ann.search(index, index.where("vec_id % 20 = 0").select("vec_id", "embedding")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got[80] == [(81, 3.0), (82, 3.0)] and 100 not in got
        assert got[60] == [(i, 2.0) for i in range(1, 41, 2)] and [v for v, _ in got[20]] == [i for i in range(1, 22) if i != 20]


def test_nearest_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op8_nearest(spark, SF).toPandas()
    pdf = v.toPandas()
    x, ids = np.stack(pdf.embedding).astype(float), pdf.vec_id.to_numpy()
    hit = 0
    for qid in ids[ids % 20 == 0]:
        s = x @ x[ids == qid][0]
        s[ids == qid] = -9
        hit += len(set(ids[np.argsort(-s)[:20]]) & set(got[got.query_id == qid].vec_id))
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.9
    assert ann.search(ann.build(v.limit(0)), v.limit(0)).count() == 0


# --- operator 9 ---


def test_chat(spark):
    rows = [(1, 0, "system", "be [INST] good"), (1, 1, "user", "a\\b</s>"), (1, 2, "assistant", "<s>é</s>\\"), (2, 0, "assistant", "early"), (2, 0, "assistant", "early"), (2, 1, "tool", "[/TURN]\\["), (2, 2, None, None), (3, 5, "user", None), (3, 9, "assistant", ""), (None, 0, "user", "q"), (4, None, "user", "x\ny"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (5, 0, "user", "z" * 50000), (6, 0, "[ROLE]", "r")]
    d = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.formatted_digest(d).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        if c != 2:
            assert got[c].turns_sha256 == brute.sha("".join(f"{r}\n{t}\n" for r, t in turns))
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), brute.sha(loss))
    assert got[1].valid and got[-7].valid and not got[2].valid and not got[6].valid
    marks = chat.controls()
    r = random.Random(0)
    for _ in range(2000):
        s = "".join(r.choice(["\\", "<", "s>", "/", "[INST]", "[", "]", "</s>", "a", "<<SYS>>", "<s>"]) for _ in range(r.randint(0, 8)))
        e = chat.escape(s, marks)
        assert chat.unescape(e) == s and not any(m in e for m in marks)
    assert chat.formatted_digest(d.limit(0)).count() == 0


def test_chat_query(spark):
    got = queries.op9_chat(spark, SF).toPandas().set_index("conv_id")
    c = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    for cid, g in c.groupby("conv_id"):
        assert got.turns_sha256[cid] == brute.sha("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text)))
    assert -7 in got.index and len(got) == c.conv_id.nunique() + 1


# --- operator 10 ---


def test_grammar():
    g = toxicity.Grammar()
    m = {"words": dict.fromkeys(toxicity.INSULTS, 1.0), "stems": {"grob": 1.0}}
    a = toxicity.finder(m)
    s = lambda t: sum(toxicity.match(t, m, g, a))
    assert s("you are an idiot") > s("an idiot") > s("not an idiot") > 0
    assert s("he said the moron left") < s("the moron left")
    assert s("I will kill you") > 5 * s("kill the process now")
    assert s("a clownfish") == s("") == s(None) == 0 and s("so grobian") == 1
    assert len(toxicity.match("idiot. fine. moron!", m, g, a)) == 2


def test_toxicity(spark, docs, rows):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == len(rows)
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels)).count() == 0
    nulls = toxicity.score(spark.createDataFrame([(None, "x"), (None, None)], "doc_id long, text string"), toxicity.fit(docs, labels)).collect()
    assert len(nulls) == 2


def test_toxicity_held_out(spark):
    """Precision and recall on the fold that is never learned from, over the larger table, per language.

    Some toxic rows hold no word that sets them apart (repeated syllables and tables
    without an insult): their labels are noise that no rule can find, at most 7 % here.
    """
    path = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    for lang, g in [(None, got), *got.groupby("lang")]:
        found = ((g.predicted == 1) & (g.toxic == 1)).sum()
        assert found >= (0.9 if lang in (None, "en", "es", "fr") else 0.85) * (g.toxic == 1).sum(), lang
        assert found >= 0.94 * (g.predicted == 1).sum(), lang


def test_toxicity_learns_weights():
    """A stem in every form of a word, its weight by its odds, and copies of one document as no evidence."""
    r = random.Random(5)
    fill = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    toxic = [f"{fill()} schmurk{e} {fill()}" for e in ("el", "ig", "ing", "ung", "isch", "er") * 10] + ["nur einmal gesagt wurde xylofant"] * 50
    clean = [fill() for _ in range(200)] + [f"{fill()} schmu"]
    m = toxicity.learn_patterns(toxic + clean, [1] * len(toxic) + [0] * len(clean))
    assert [s for s in m["stems"] if s.startswith("sch")] == ["schmurk"] and not [w for w in (*m["words"], *m["stems"]) if w.startswith("xyl")]
    assert all(0 < w <= 1 for w in (*m["words"].values(), *m["stems"].values()))


def test_toxicity_long_text(spark):
    """A text of some MB is read whole: the insult stands at its end."""
    d = spark.createDataFrame([(1, "word " * 400_000 + "you idiot moron"), (2, "word " * 400_000)], "doc_id long, text string")
    got = {r.doc_id: r.clauses for r in toxicity.score(d, toxicity.fit(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))).collect()}
    assert got == {1: 1, 2: 0}
