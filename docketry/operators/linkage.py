"""Citation to document linkage, and the link that comes out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.paths import canonical_path, page_in_text, view_url
from docketry.operators.blocks import lookup, substring_pairs

# Score of a match, by how the cited text relates to the stored name.
PATH_EQUAL, PATH_TAIL, PATH_INSIDE = 120, 110, 95
FILE_EQUAL, FILE_TAIL, FILE_INSIDE = 80, 72, 60


def _names(documents: DataFrame) -> DataFrame:
    """Distinct stored names with the first document that carries each.

    A later document of the same name can never win, so it is dropped before any join.
    """
    d = documents.select(
        "doc_id", "pos", canonical_path("relative_path").alias("path"), canonical_path("file_name").alias("file")
    )
    doc = F.struct("pos", "doc_id")
    long = d.select(
        F.explode(
            F.array(
                F.struct(F.col("path").alias("name"), F.lit(True).alias("is_path"), doc.alias("doc")),
                F.struct(F.col("file").alias("name"), F.lit(False).alias("is_path"), doc.alias("doc")),
            )
        ).alias("n")
    ).select("n.*")
    return (
        long.where(F.col("name") != "")
        .groupBy("name")
        .agg(
            F.min(F.when(F.col("is_path"), F.col("doc"))).alias("by_path"),
            F.min(F.when(~F.col("is_path"), F.col("doc"))).alias("by_file"),
        )
    )


def _best(hits: DataFrame) -> DataFrame:
    """Best hit per text: highest score, then earliest document."""
    best = hits.groupBy("text").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("doc.pos").alias("p"), F.col("doc.doc_id").alias("d"))).alias("b")
    )
    return best.select(
        "text", (-F.col("b.s")).alias("score"), F.col("b.p").alias("doc_pos"), F.col("b.d").alias("doc_id")
    )


def _score(pairs: DataFrame, path_score, file_score) -> DataFrame:
    options = F.array(
        F.struct(path_score.alias("score"), F.col("by_path").alias("doc")),
        F.struct(file_score.alias("score"), F.col("by_file").alias("doc")),
    )
    return pairs.select("text", F.inline(options)).where(F.col("doc").isNotNull())


def resolve_texts(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """Best document for every distinct canonical text (column ``text``).

    1. Equality joins on the text and its tails behind a ``/`` find the four strong relations.
    2. Only texts whose best is below "path inside" go through the substring join; that is where
       the two "inside" relations come from. Nothing is compared pairwise.
    """
    names = _names(documents)
    parts = F.split("text", "/")
    tails = texts.select(
        "text",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
            )
        ).alias("name"),
    )
    whole = F.col("name") == F.col("text")
    strong = _best(
        _score(
            tails.join(names, "name"),
            F.when(whole, F.lit(PATH_EQUAL)).otherwise(F.lit(PATH_TAIL)),
            F.when(whole, F.lit(FILE_EQUAL)).otherwise(F.lit(FILE_TAIL)),
        )
    )
    open_texts = texts.join(strong.where(F.col("score") >= PATH_INSIDE).select("text"), "text", "left_anti")
    inside = substring_pairs(open_texts, names.select(F.col("name").alias("needle")))
    weak = _score(
        inside.withColumnRenamed("needle", "name").join(names, "name"),
        F.lit(PATH_INSIDE),
        F.lit(FILE_INSIDE),
    )
    known = strong.select("text", "score", F.struct(F.col("doc_pos").alias("pos"), "doc_id").alias("doc"))
    return _best(known.unionByName(weak.select("text", "score", F.col("doc").cast(known.schema["doc"].dataType).alias("doc"))))


def link_citations(cards: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``score``, ``doc_pos`` and ``doc_id`` of the best document to every card.

    A card (identified by ``keys``) offers two texts, its path and its meta line; the earlier one
    wins a tie. Every distinct text is resolved once, however many cards carry it, and handed back
    by a hot-key safe lookup.
    """
    offered = F.array(
        *[
            F.struct(F.lit(i).alias("cand"), F.nullif(canonical_path(c), F.lit("")).alias("text"))
            for i, c in enumerate(("source_path", "meta"))
        ]
    )
    long = cards.select(*cards.columns, F.inline(offered))
    texts = long.where(F.col("text").isNotNull()).groupBy("text").agg(F.count(F.lit(1)).alias("freq"))
    answered = lookup(long, resolve_texts(texts.select("text"), documents), "text", texts)
    rest = [c for c in cards.columns if c not in keys]
    best = answered.groupBy(*keys).agg(
        F.first(F.struct(*rest)).alias("_card"),
        F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "cand", "doc_pos", "doc_id"))).alias("_b"),
    )
    return best.select(
        *[F.col(c) if c in keys else F.col("_card")[c].alias(c) for c in cards.columns],
        (-F.col("_b.s")).alias("score"),
        F.col("_b.doc_pos").alias("doc_pos"),
        F.col("_b.doc_id").alias("doc_id"),
    )


def deep_links(linked: DataFrame, base: str) -> DataFrame:
    """URL of a linked card, at the page of the card or of its texts."""
    page_start = F.col("page_start") if "page_start" in linked.columns else F.lit(None).cast("double")
    excerpt = F.col("excerpt") if "excerpt" in linked.columns else F.lit("")
    page = F.coalesce(F.when(page_start > 0, F.floor(page_start).cast("int")), page_in_text("meta"), page_in_text(excerpt))
    return linked.withColumn("page", page).withColumn(
        "url", F.when(F.col("doc_id").isNotNull(), view_url(base, "doc_id", F.coalesce("page", F.lit(0))))
    )
