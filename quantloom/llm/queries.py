"""The registered queries of the ten operators and of the pipeline: thin callers, (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, embeddings, mixing, pii, simhash, substrings, token_files, toxicity
from .common import written

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    """Mix all documents to capped 5:2:1 source weights."""
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size")), "sizes")
    return mixing.mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_bpe(spark, sf_dir):
    """Encode and decode every text."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op3_repeated_substrings(spark, sf_dir):
    """Remove every byte of a 400-byte string that starts elsewhere too."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    """Personal data in every text."""
    return pii.find(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    """SimHash components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op6_embedding_duplicates(spark, sf_dir):
    """Links and components of all vectors."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_token_files(spark, sf_dir):
    """Write all token ids to bit-plane files and read them back."""
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary()))


def op8_nearest(spark, sf_dir):
    """The 20 nearest of every vector whose id is divisible by 20."""
    index = ann.build(table(spark, sf_dir, "embeddings"))
    return ann.search(index, index.where("vec_id % 20 = 0").select("vec_id", "embedding"))


def op9_chat(spark, sf_dir):
    """Format all conversations and one that quotes control strings, and read them back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.formatted_digest(turns.unionByName(extra))


def op10_toxicity(spark, sf_dir):
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def pipeline(spark, sf_dir):
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_bpe, op3_repeated_substrings, op4_pii, op5_simhash, op6_embedding_duplicates, op7_token_files, op8_nearest, op9_chat, op10_toxicity, pipeline)}


def chat_sql() -> str:
    """op9 in SQL: the digests over the turns, lengths from the template's marks and escapes, the role order as a pattern."""

    def escaped(x: str) -> str:
        for mark in ("\\", *chat.controls()):
            x = f"replace({x}, '{mark}', '{mark[0]}\\{mark[1:]}')"
        return x

    sizes = " ".join(f"when '{role}' then {len(a) + len(b)}" for role, (a, b, _) in chat.TEMPLATE.items())
    other = f"{sum(map(len, chat.ROLE))} + length({escaped('role')})"
    loss = "role in (" + ", ".join(f"'{role}'" for role, mark in chat.TEMPLATE.items() if mark[2]) + ")"
    order = "order by turn nulls first, r nulls first, t nulls first"
    return f"""
with turns as (
    select conv_id, turn, role r, text t, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, i, r, x, r, x from (values (0, 'user'), (1, 'assistant')) a(i, r), (select '</s>[INST] ok [/INST]' x) b)
select conv_id, count(*) n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) turns_sha256,
    cast(coalesce(sum(length(text)) filter ({loss}), 0) as bigint) loss_chars,
    sha256(coalesce(string_agg(text, '' {order}) filter ({loss}), '')) loss_sha256,
    cast(sum(length({escaped('text')}) + case role {sizes} else {other} end) as bigint) formatted_chars,
    regexp_full_match(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, '' {order}), 's?(ua)*u?') valid
from turns group by conv_id"""


#: All pairs, of the order of n * n, for small tables.
EMBEDDING_SQL = f"""
with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings),
ok as (select * from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id u, b.vec_id v from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {embeddings.THRESHOLD}),
reach as (select vec_id u, vec_id m from ok union select l.v, r.m from reach r join links l on l.u = r.u where r.m < l.v),
least as (select u, min(m) m from reach group by u), degree as (select u, count(*) n from links group by u)
select vec_id, coalesce(n, 0) n_links, coalesce(m, vec_id) component_id, coalesce(m, vec_id) = vec_id kept
from v left join least on least.u = vec_id left join degree on degree.u = vec_id"""

#: Every window of whole texts as hexadecimal digits, known by its MD5; texts are cut into chunks first, so that a long one isn't scanned anew for each window.
SUBSTRINGS_SQL = f"""
with bytes as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
sized as (select r, doc_id, x, length(x) // 2 n from bytes),
chunks as (select r, n, p, substring(x, 2 * p + 1, 2 * (4096 + {substrings.LENGTH - 1})) c from (select r, n, x, unnest(range(0, greatest(n - {substrings.LENGTH - 1}, 0), 4096)) p from sized)),
starts as (select r, p + i s, md5_number(substring(c, 2 * i + 1, {2 * substrings.LENGTH})) k from (select r, p, c, unnest(range(0, least(4096, n - {substrings.LENGTH - 1} - p))) i from chunks)),
again as (select k from starts group by k having count(*) > 1),
hits as (select r, s from starts semi join again using (k)),
steps as (select r, s, s - coalesce(lag(s) over (partition by r order by s), -{1 << 40}) > {substrings.LENGTH} fresh from hits),
runs as (select r, s, sum(cast(fresh as int)) over (partition by r order by s) run from steps),
spans as (select r, min(s) a, max(s) + {substrings.LENGTH} b from runs group by r, run),
gaps as (select r, coalesce(lag(b) over w, 0) a, a b from spans window w as (partition by r order by a)
    union all select r, max(b), null from spans group by r),
kept as (select g.r, string_agg(substring(x, 2 * g.a + 1, 2 * (coalesce(g.b, n) - g.a)), '' order by g.a) x from gaps g join sized s on s.r = g.r group by g.r),
lost as (select r, sum(b - a) n, count(*) k from spans group by r)
select doc_id, cast(s.n as bigint) n_bytes, cast(coalesce(l.n, 0) as bigint) n_removed, cast(coalesce(l.k, 0) as bigint) n_spans, sha256(unhex(coalesce(k.x, s.x))) kept_sha256
from sized s left join kept k using (r) left join lost l using (r)"""

#: Every query against every candidate. The search is approximate: the rows are equal where its recall is 1, as on the given tables.
NEAREST_SQL = """
with v as (select vec_id, cast(embedding as double[]) e from embeddings),
ok as (select * from v where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0)
select q.vec_id query_id, cast(row_number() over (partition by q.vec_id order by list_inner_product(q.e, c.e) desc, c.vec_id) as int) rank, c.vec_id, list_inner_product(q.e, c.e) score
from ok q join ok c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e) qualify rank <= 20"""

#: The other results hold tokens, XXH64 values, a rounded flow or model output; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op3_repeated_substrings": SUBSTRINGS_SQL, "op6_embedding_duplicates": EMBEDDING_SQL, "op8_nearest": NEAREST_SQL, "op9_chat": chat_sql()}
