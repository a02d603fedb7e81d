"""The registered queries of the ten operators; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import best_fit, centroids, divergence, embedding_dedup, exact_dedup, minhash_dedup, packing, passages, quality, sharding, suffix_dedup, toxicity, unigram
from docketry.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens, neighbours on the curve together."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of texts that are equal after lower-casing A-Z."""
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


ORACLES["op2_exact_dedup"] = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of embeddings with one label and cosine of 0.98 or more."""
    return embedding_dedup.classes(table(spark, sf_dir, "embeddings"))


@query
def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share near-duplicate passages of 50 words or more."""
    found = passages.classes(table(spark, sf_dir, "documents"))
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "component_id", "n_links", "n_copies", F.size("spans").cast("long").alias("n_spans"), words.alias("span_words"),
        F.transform("spans", lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))).alias("spans"),
    )


SHARDS = 16


@query
def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 by doc_id, and the shard with one more."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign(docs, ["doc_id"], [1.0] * SHARDS)
    slots = sharding.slots(placed, "shard", ["doc_id", "size", "text_crc32"])
    grown = sharding.assign(slots, ["doc_id"], [1.0] * (SHARDS + 1), into="grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and the rows drawn."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_unigram_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the unigram ids of all documents, and whether decoding gives back the text."""
    return unigram.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the rows that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), usable=~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


@query
def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents covered by 400-byte strings that start elsewhere too."""
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), min_bytes=400)


@query
def op10_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 2-word shingles reach a similarity of 0.8."""
    return minhash_dedup.classes(table(spark, sf_dir, "documents"), width=2, percent=80).drop("node")


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens by best fit over their lengths."""
    return best_fit.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, length=1024)


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that mark them."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as n from w group by all having count(distinct r) >= 3),
counts as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(n)::bigint as total from kept group by all),
groups as (select g.lang, g.source, coalesce(t.total, 0)::bigint as total from (select distinct lang, source from d) g
  left join (select lang, source, sum(n)::bigint as total from counts group by all) t using (lang, source)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + l.v) as p,
    1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.v) as q
  from groups g join kept k using (lang) join langs l using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, rank from
  (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found)
where part = 'pair' or rank <= 200
"""


@query
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of the integer vectors of 64 components, after five rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def _cluster_sql(k: int, rounds: int, dims: int) -> str:
    """Each round: every vector with its nearest centroid, then the floored means of the centroids that have vectors."""
    near = """, a{i} as materialized (
  select r, vec_id, x, arg_min(c, struct_pack(d := d, c := c)) as c, min(d) as d from
    (select v.r, v.vec_id, v.x, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from v cross join c{i} k)
  group by r, vec_id, x)"""
    mean = """, c{j} as materialized (
  select k.c, coalesce(m.x, k.x) as x from c{i} k left join
    (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from
      (select c, i, sum(x[i])::bigint as s, count(*) as n from a{i}, range(1, {dims} + 1) t(i) group by c, i) group by c) m using (c))"""
    steps = "".join(near.format(i=i) + mean.format(i=i, j=i + 1, dims=dims) for i in range(rounds)) + near.format(i=rounds)
    return f"""
with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dims}),
c0 as materialized (
  select row_number() over (order by h, x) - 1 as c, x from
    (select sha256('2:' || coalesce(vec_id::varchar, '')) as h, x from v order by h, x limit {k})){steps}
select vec_id, a.c::int as cluster, d as distance, sum(d) over (partition by a.c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(list_aggregate(list_transform(k.x, lambda e: e::varchar), 'string_agg', ',')) as centroid_sha256
from a{rounds} a join c{rounds} k using (c)
"""


ORACLES["op13_centroid_clusters"] = _cluster_sql(40, 5, 64)
