"""Which sources an answer used, and what they look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import WS, contains_any, filled, half_up, squeeze, strip, text
from docketry.operators.blocks import lookup

# Fixed values.
RETRIEVED_KEEP = 5
CARDS_KEEP = 8
RESOLVE_KEEP = 64
DEFAULT_EXCERPT = "Reference juridique"
DEFAULT_META = "Base documentaire"
PRIVATE_PREFIX = "workspace-"
FAMILIES = (
    ("Jurisprudence", ("jurisprudence", "cour supreme", "bulletin")),
    ("Doctrine", ("doctrine", "revue", "commentaire")),
    ("Code penal / Lois", ("code", "loi", "decret", "constitution", "ordonnance", "arrete")),
)
OTHER_FAMILY = "Autres sources"
ARTICLE = (
    r"(?i)(\bArticle[{ws}]+(?:[A-Za-z]\.?[{ws}]*)?\d+[A-Za-z0-9.\-]*"
    r"(?:[{ws}]*(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies))?\b|\bArticle\b)"
).replace("{ws}", WS)

TURN = ["session_id", "turn_pos"]
SOURCE_COLUMNS = {
    "rank": "double",
    "chunk_id": "string",
    "citation": "string",
    "relative_path": "string",
    "source_path": "string",
    "page_start": "double",
    "page_end": "double",
    "article_hint": "string",
}


def complete_sources(sources: DataFrame) -> DataFrame:
    """Add the optional source members that the input does not have."""
    return sources.withColumns(
        {n: F.lit(None).cast(t) for n, t in SOURCE_COLUMNS.items() if n not in sources.columns}
    )


def cited_ranks(answer) -> Column:
    """Distinct positive numbers of the ``[source N]`` markers of an answer."""
    found = F.regexp_extract_all(F.coalesce(F.col(answer), F.lit("")), F.lit(rf"(?i)\[source[{WS}]+(\d+)\]"), 1)
    numbers = F.transform(found, lambda x: x.try_cast("bigint"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


def is_private(chunk_id) -> Column:
    """F6."""
    return F.startswith(text(chunk_id), F.lit(PRIVATE_PREFIX))


def public_chunks(sources: DataFrame) -> DataFrame:
    """sources with a chunk id that may be resolved."""
    return sources.where((text("chunk_id") != "") & ~is_private("chunk_id"))


def usage_key(pos: str) -> Column:
    """Identity of a source inside one answer: its chunk, else everything known about the place."""
    number = lambda c: F.coalesce(_js_number(F.col(c)), F.lit("na"))
    rank = F.coalesce(_js_number(F.col("rank")), (F.col(pos) + 1).cast("string"))
    place = F.concat(
        F.lit("doc:"), strip(F.coalesce("relative_path", "source_path", F.lit(""))),
        F.lit("|citation:"), text("citation"),
        F.lit("|pages:"), number("page_start"), F.lit("-"), number("page_end"),
        F.lit("|rank:"), rank,
    )
    return F.coalesce(F.concat(F.lit("chunk:"), filled("chunk_id")), place)


def _js_number(c: Column) -> Column:
    """A number as text without a needless ``.0``."""
    whole = c.cast("bigint")
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


def used_sources(turns: DataFrame, sources: DataFrame) -> DataFrame:
    """The sources an answer used, one row per distinct source.

    With markers in the answer: the sources whose rank is cited. Without any: the sources up to the
    fifth distinct one. Per key the last source counts, at the place of the first. ``use_pos`` is
    the order for display: rank, unknown ranks last (T4).

    One shuffle by turn serves the join and both aggregates.
    """
    answers = turns.select("session_id", F.col("pos").alias("turn_pos"), cited_ranks("answer").alias("_cited"))
    s = complete_sources(sources).join(answers, TURN)
    rank = F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.col("pos") + 1)
    marked = s.withColumns(
        {
            "_by_rank": F.size("_cited") > 0,
            "_hit": F.array_contains("_cited", rank.cast("bigint")) & (rank == F.floor(rank)),
            "_key": usage_key("pos"),
        }
    ).where(~F.col("_by_rank") | F.col("_hit"))
    # where each key of an answer without markers first shows up; at most five per turn go on
    firsts = (
        marked.where(~F.col("_by_rank"))
        .groupBy(*TURN, "_key")
        .agg(F.min("pos").alias("_first"))
        .withColumn("_n", F.row_number().over(Window.partitionBy(*TURN).orderBy("_first")))
        .where(F.col("_n") <= RETRIEVED_KEEP)
    )
    cut = firsts.groupBy(*TURN).agg(F.max("_first").alias("_at"), F.count(F.lit(1)).alias("_keys"))
    kept = marked.join(cut, TURN, "left").where(
        F.col("_by_rank") | (F.col("_keys") < RETRIEVED_KEEP) | (F.col("pos") <= F.col("_at"))
    )
    value = F.struct(*SOURCE_COLUMNS, F.col("_by_rank"))
    used = kept.groupBy(*TURN, "_key").agg(F.max_by(value, F.col("pos")).alias("_v"), F.min("pos").alias("pos"))
    flat = used.select(
        *TURN,
        "pos",
        F.col("_key").alias("usage_key"),
        *[F.col("_v")[c].alias(c) for c in SOURCE_COLUMNS],
        F.when(F.col("_v")["_by_rank"], "cited").otherwise("retrieved").alias("source_mode"),
    )
    order = Window.partitionBy(*TURN).orderBy(*display_order())
    return flat.withColumn("use_pos", (F.row_number().over(order) - 1).cast("bigint"))


def display_order() -> list[Column]:
    """T4: ascending rank, missing or non-positive ranks last, then position."""
    return [F.when(F.col("rank") > 0, F.col("rank")).asc_nulls_last(), F.col("pos")]


def article_badge(index: str = "use_pos") -> Column:
    """Badge of a source: its article, else its number."""
    article = F.regexp_extract(text("article_hint"), rf"(?i)Article[{WS}]+[A-Za-z0-9.\-]+", 0)
    number = F.coalesce(_js_number(F.col("rank")), (F.col(index) + 1).cast("string"))
    return F.when(article != "", F.concat(article, F.lit(" - COCC"))).otherwise(F.concat(F.lit("Source "), number))


def citation_cards(used: DataFrame) -> DataFrame:
    """Cards of the first eight used sources of every turn."""
    return used.where(F.col("use_pos") < CARDS_KEEP).select(
        *TURN,
        F.col("use_pos").alias("card_pos"),
        article_badge().alias("badge"),
        strip(F.coalesce("article_hint", "citation", F.lit(DEFAULT_EXCERPT))).alias("excerpt"),
        strip(F.coalesce("citation", "relative_path", "source_path", F.lit(DEFAULT_META))).alias("meta"),
        F.when(F.col("source_mode") == "retrieved", "retrieved").otherwise("cited").alias("source_mode"),
        "chunk_id",
        "article_hint",
        F.coalesce("relative_path", "source_path").alias("source_path"),
        "page_start",
        "page_end",
    )


def card_files(cards: DataFrame) -> DataFrame:
    """File rows derived from cards; blank names are dropped."""
    base = F.coalesce("source_path", "meta")
    return cards.where(strip(base) != "").select(
        *TURN,
        F.concat(F.lit("source-"), F.col("card_pos").cast("string"), F.lit("-"), base).alias("id"),
        base.alias("name"),
        F.lit(0.0).alias("size"),
    )


def source_family() -> Column:
    """First matching family of the paths and the citation."""
    blank = F.lit("")
    raw = F.lower(F.concat_ws(" ", *[F.coalesce(c, blank) for c in ("relative_path", "source_path", "citation")]))
    out = F.lit(OTHER_FAMILY)
    for label, words in reversed(FAMILIES):
        out = F.when(contains_any(raw, words), label).otherwise(out)
    return out


def source_breakdown(used: DataFrame) -> DataFrame:
    """A2: share of every family among the used sources of a turn, in display order."""
    counts = (
        used.withColumn("label", source_family())
        .groupBy(*TURN, "label")
        .agg(F.count(F.lit(1)).alias("count"), F.min("use_pos").alias("_first"))
    )
    turn = Window.partitionBy(*TURN)
    percent = half_up(F.col("count") / F.sum("count").over(turn) * 100)
    shares = counts.withColumn("percent", percent)
    order = turn.orderBy(F.desc("percent"), F.desc("count"), "_first")
    return shares.withColumn("rank", F.row_number().over(order)).drop("_first")


def article_mentions(texts: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Every article mention of a text with its position."""
    found = F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(ARTICLE), 1)
    return texts.select(*keys, F.posexplode(found).alias("mention_pos", "article"))


# --------------------------------------------------------------------------------------------
# Chunks


def resolve_chunks(requests: DataFrame, chunks: DataFrame, key: str = "request_id") -> DataFrame:
    """The first 64 distinct chunk ids of every request, looked up. Unknown ids keep NULLs."""
    asked = requests.select(key, "pos", text("chunk_id").alias("chunk_id")).where(F.col("chunk_id") != "")
    firsts = asked.groupBy(key, "chunk_id").agg(F.min("pos").alias("pos"))
    kept = (
        firsts.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
        .where(F.col("_rn") <= RESOLVE_KEEP)
        .drop("_rn")
    )
    return lookup(kept, chunks, "chunk_id")


def resolve_report(resolved: DataFrame, key: str = "request_id", found: str = "text") -> DataFrame:
    """How many chunks were requested and found."""
    return resolved.groupBy(key).agg(F.count(F.lit(1)).alias("requested"), F.count(found).alias("resolved"))


def missing_chunks(sources: DataFrame, cached: DataFrame) -> DataFrame:
    """Resolvable chunk ids that are not cached yet."""
    ids = public_chunks(sources).select(text("chunk_id").alias("chunk_id")).distinct()
    return ids.join(cached.select("chunk_id"), "chunk_id", "left_anti")


def card_chunks(cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cards with the chunk they point to; private chunks are flagged, not looked up."""
    private = is_private("chunk_id")
    wanted = cards.withColumns({"is_private": private, "_raw": F.col("chunk_id")}).withColumn(
        "chunk_id", F.when(~private, F.col("chunk_id"))
    )
    return lookup(wanted, chunks, "chunk_id").withColumn("chunk_id", F.col("_raw")).drop("_raw")


def highlight_needle(c) -> Column:
    """Usable hint: 6 characters or more, not the default phrase, at most 180."""
    line = squeeze(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    usable = (F.length(line) >= 6) & (F.lower(line) != DEFAULT_EXCERPT.lower())
    return F.when(usable, F.left(line, F.lit(180)))


def highlight(df: DataFrame, hint, column: str = "text") -> DataFrame:
    """Where the hint first occurs in the text (1-based; 0 when it does not) and its length."""
    marked = df.withColumn("_needle", highlight_needle(hint))
    at = F.coalesce(F.instr(F.lower(column), F.lower("_needle")), F.lit(0))
    out = marked.withColumns({"hit_start": at, "hit_length": F.when(at > 0, F.length("_needle")).otherwise(0)})
    start, size = F.col("hit_start"), F.col("hit_length")
    hit = start > 0
    return out.withColumns(
        {
            "before": F.when(hit, F.substr(column, F.lit(1), start - 1)).otherwise(F.col(column)),
            "hit": F.when(hit, F.substr(column, start, size)).otherwise(""),
            "after": F.when(hit, F.substr(column, start + size)).otherwise(""),
        }
    ).drop("_needle")
