"""Document search over chunks.

The rules: a chunk matches when it holds at least one query word and the article text; its score is
the number of distinct query words it holds. Words are compared whole, on folded text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docketry.functions.needles import matcher
from docketry.functions.text import filled, fold_catalog
from docketry.operators.blocks import RANK_BLOCK, needle_tables, salted_join

FILTERS = ("q", "category", "article", "keyword", "infraction_type", "jurisdiction", "document_id")
ADVANCED = ("article", "keyword", "infraction_type", "jurisdiction", "category", "document_id")
SNIPPET = 240
#: Query words of a batch (a search and a word each) that are sent to every task at most.
SENT_WORDS = 200_000
FOUND = ["search", "doc_id", "chunk_id", "pos", "page_start", "score"]


def clean_requests(requests: DataFrame) -> DataFrame:
    """Strip every filter, blank becomes NULL, count the active advanced filters."""
    have = [c for c in FILTERS if c in requests.columns]
    out = requests.withColumns(
        {c: (filled(c) if c in have else F.lit(None).cast("string")) for c in FILTERS}
    )
    active = [
        F.when(F.col(c).isNotNull() & (F.col(c) != "all"), 1).otherwise(0)
        if c in ("category", "document_id")
        else F.col(c).isNotNull().cast("int")
        for c in ADVANCED
    ]
    return out.withColumn("active_filters", sum(active[1:], active[0]))


def words(*cols) -> Column:
    """Distinct folded words of several columns."""
    joined = F.concat_ws(" ", *[fold_catalog(c) for c in cols])
    return F.filter(F.array_distinct(F.split(joined, " ")), lambda w: w != "")


def index_chunks(chunks: DataFrame) -> DataFrame:
    """Word index of the chunks: one row per chunk and distinct word, without the text.

    Built once per corpus and written as a table, it serves every batch of requests.
    """
    return chunks.select("chunk_id", "doc_id", "pos", "page_start", F.explode(words("text")).alias("word"))


def distinct_searches(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct searches, and the map from requests to them. Repeated searches run once.

    A search is named by the smallest request that asks for it.
    """
    signature = ["terms", "article", "category", "document_id"]
    r = clean_requests(requests).select(
        "request_id",
        F.array_sort(words("q", "keyword", "infraction_type", "jurisdiction")).alias("terms"),
        fold_catalog("article").alias("article"),
        # "all" is no filter
        F.coalesce(F.nullif("category", F.lit("all")), F.lit("")).alias("category"),
        F.coalesce(F.nullif("document_id", F.lit("all")), F.lit("")).alias("document_id"),
    )
    distinct = r.groupBy(*signature).agg(F.min("request_id").alias("search"))
    return distinct, r.join(distinct, signature).select("request_id", "search")


def matching_chunks(searches: DataFrame, chunks: DataFrame, index: DataFrame | None = None, kinds=None) -> DataFrame:
    """F8: (search, doc_id, chunk_id, pos, page_start, score) of every matching chunk.

    An equality join of chunk words and query words. A batch of up to ``SENT_WORDS`` query words goes to the chunks
    (``_matched_in_place``) or to the given index; beyond that both are shuffled, and frequent words are spread over tasks. Only the
    searches with an article text look at chunk texts again, and only at chunks that matched; those with an article text
    alone look at all texts where they are (``_article_only``).
    """
    return _matched(searches, chunks, index, search_kinds(searches) if kinds is None else kinds).drop("_blk")


def _matched(searches: DataFrame, chunks: DataFrame, index: DataFrame | None, kinds) -> DataFrame:
    """``matching_chunks`` with the stretch ``_blk`` of the chunk's position."""
    if not kinds.article_only:
        return _worded(searches, chunks, index, kinds)
    found = _article_only(searches, chunks)
    return _worded(searches, chunks, index, kinds).unionByName(found) if kinds.words else found


def _worded(searches: DataFrame, chunks: DataFrame, index: DataFrame | None, kinds) -> DataFrame:
    """The matches of the searches with words."""
    if index is None and kinds.words <= SENT_WORDS:
        return _matched_in_place(searches, chunks)
    index = index_chunks(chunks) if index is None else index
    terms = searches.select("search", F.explode("terms").alias("word"))
    if kinds.words <= SENT_WORDS:
        hits = index.join(F.broadcast(terms), "word")
    else:
        hits = salted_join(index, terms, "word", "chunk_id")
    keys = ["search", "doc_id", "chunk_id", "pos", "page_start"]
    scored = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("score"))
    found = scored
    if kinds.limited:
        bodies = chunks.select("chunk_id", fold_catalog("text").alias("_body"))
        limited = searches.where((F.size("terms") > 0) & (F.col("article") != "")).select("search", "article")
        plain = scored.join(limited, "search", "left_anti")
        checked = scored.join(limited, "search").join(bodies, "chunk_id").where(F.contains("_body", F.col("article")))
        found = plain.unionByName(checked.select(*plain.columns))
    return found.withColumn("_blk", _span())


def _span() -> Column:
    """Number of a stretch of chunk positions; NULL positions share one."""
    return F.floor(F.col("pos") / RANK_BLOCK).cast("bigint").alias("_blk")


def _matched_in_place(searches: DataFrame, chunks: DataFrame) -> DataFrame:
    """``matching_chunks`` of searches with words that go to every task, with the stretch ``_blk`` of the chunk's position.

    The chunks are shuffled once, by document and stretch. Words are looked up, article texts are checked and
    scores are added up where the chunk is, so that no hit is shuffled.
    """
    rows = chunks.select("chunk_id", "doc_id", "pos", "page_start", "text", _span()).repartition("doc_id", "_blk")
    terms = searches.select("search", "article", "terms", F.posexplode("terms").alias("_nth", "word"))
    cut = rows.select("*", words("text").alias("_words"), fold_catalog("text").alias("_body"))
    hits = cut.withColumn("word", F.explode("_words")).join(F.broadcast(terms), "word")
    # a chunk that holds the article counts once, at the first of the search's words that it holds
    first = ~F.arrays_overlap(F.slice("terms", F.lit(1), F.col("_nth")), "_words")
    held = F.when(F.col("article") != "", F.contains("_body", F.col("article")) & F.col("chunk_id").isNotNull() & first)
    keys = ["search", "doc_id", "_blk", "chunk_id", "pos", "page_start"]
    scored = hits.select(*keys, held.alias("_held")).groupBy(*keys).agg(F.count(F.lit(1)).alias("score"), F.count("_held").alias("_asked"), F.count_if("_held").alias("_times"))
    # chunks that repeat an id count once for each copy that holds the article
    times = F.when(F.col("_asked") == 0, 1).otherwise(F.col("_times")).cast("int")
    found = scored.where((F.col("_asked") == 0) | (F.col("_times") > 0))
    return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).select(*FOUND, "_blk")


def search_kinds(searches: DataFrame):
    """Which kinds of searches a batch holds, and how many words: one row over the distinct searches.

    Decides which branches the plan gets, so that a usual batch reads the corpus once.
    """
    worded, article = F.size("terms") > 0, F.col("article") != ""

    def some(condition):
        return F.coalesce(F.bool_or(condition), F.lit(False))

    return searches.agg(
        some(worded & article).alias("limited"),
        some(~worded & article).alias("article_only"),
        some(~worded & ~article).alias("listing"),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("words"),
    ).first()


def _article_only(searches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Searches with an article text and no words: chunks that hold the text, score 0.

    The article texts go to the chunks, a million at a time, and each chunk is read once where it is
    (``functions.needles``): neither chunks nor their words are shuffled, only what holds a text goes on.
    """
    only = searches.where((F.size("terms") == 0) & (F.col("article") != "")).select("search", "article", F.xxhash64("article").alias("name"))
    rows = chunks.where(F.col("chunk_id").isNotNull()).select("doc_id", "chunk_id", "pos", "page_start", _span(), fold_catalog("text").alias("_body"))
    found = StructType([*rows.schema.fields, StructField("name", LongType())])
    tables = needle_tables(only.select(F.col("article").alias("needle"), "name").distinct())
    hits = reduce(DataFrame.unionByName, [rows.mapInArrow(matcher(table, keep=True), found) for table in tables])
    few = only.count() <= SENT_WORDS
    checked = hits.join(F.broadcast(only) if few else only, "name").where(F.contains("_body", F.col("article")))
    return checked.withColumn("score", F.lit(0).cast("bigint")).select(*FOUND, "_blk")


def search_documents(
    requests: DataFrame, chunks: DataFrame, documents: DataFrame, index: DataFrame | None = None
) -> DataFrame:
    """F8 + A8: documents of every request with score, matched chunks, pages and a snippet.

    A request without words and article lists the documents its other filters allow, score NULL.
    """
    searches, mapped = distinct_searches(requests)
    kinds = search_kinds(searches)
    matched = _matched(searches, chunks, index, kinds)
    # the stretches of a document first, then one row for each of them
    parts = matched.groupBy("search", "doc_id", "_blk").agg(
        F.max("score").alias("_score"),
        F.count(F.lit(1)).alias("_n"),
        F.collect_set("page_start").alias("_pages"),
        F.max(F.struct("score", (-F.col("pos")).alias("p"))).alias("_at"),
        F.max_by("chunk_id", F.struct("score", -F.col("pos"))).alias("_id"),
    )
    per_doc = parts.repartition("doc_id").groupBy("search", "doc_id").agg(
        F.max("_score").cast("double").alias("search_score"),
        F.sum("_n").alias("matched_chunk_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_pages")))).alias("matched_pages"),
        F.max_by("_id", "_at").alias("_chunk"),
    )
    few = mapped.count() <= SENT_WORDS
    facts = documents.select("doc_id", F.col("pos").alias("doc_pos"), "category")
    limits = searches.select("search", F.col("category").alias("_cat"), F.col("document_id").alias("_doc"))
    allowed = per_doc.join(F.broadcast(limits) if few else limits, "search").join(facts, "doc_id").where(_allowed())
    snippets = chunks.select(F.col("chunk_id").alias("_chunk"), F.substring("text", 1, SNIPPET).alias("matched_snippet"))
    ranked = allowed.join(snippets, "_chunk", "left")
    columns = ["search", "doc_id", "doc_pos", "category", "search_score", "matched_chunk_count", "matched_pages", "matched_snippet"]
    results = ranked.select(*columns)
    if kinds.listing:
        results = results.unionByName(_listing(searches, facts), allowMissingColumns=True)
    return results.join(F.broadcast(mapped) if few else mapped, "search").select("request_id", *columns[1:])


def _allowed() -> Column:
    return ((F.col("_cat") == "") | (F.col("_cat") == F.col("category"))) & (
        (F.col("_doc") == "") | (F.col("_doc") == F.col("doc_id").cast("string"))
    )


def _listing(searches: DataFrame, facts: DataFrame) -> DataFrame:
    """Searches without words and article. Equality on the document, else the category, else the
    one unrestricted search that is left after removing repeats."""
    plain = searches.where((F.size("terms") == 0) & (F.col("article") == "")).select(
        "search", F.col("category").alias("_cat"), F.col("document_id").alias("_doc")
    )
    by_doc = facts.join(plain.where(F.col("_doc") != ""), F.col("doc_id").cast("string") == F.col("_doc")).where(_allowed())
    by_cat = facts.join(plain.where((F.col("_doc") == "") & (F.col("_cat") != "")), F.col("category") == F.col("_cat"))
    unrestricted = plain.where((F.col("_doc") == "") & (F.col("_cat") == "")).agg(F.max("search")).scalar()
    everything = facts.withColumn("search", unrestricted).where(F.col("search").isNotNull())
    columns = ["search", "doc_id", "doc_pos", "category"]
    return by_doc.select(*columns).unionByName(by_cat.select(*columns)).unionByName(everything.select(*columns))


