"""Document catalog: facets, filters, pages, themes, topic and label resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import contains_any, encode_component, filled, fold_catalog, fold_label, strip, text
from docketry.operators.blocks import RANK_BLOCK, lookup, substring_pairs

# Fixed values.
ANY = "Tous"
ALL = "all"
PAGE_LIST, PAGE_GRID = 8, 9
THEMES = (
    ("travail", "travail"),
    ("penal", "penal"),
    ("electoral", "electoral"),
    ("ohada", "ohada"),
    ("notariat", "notariat"),
    ("fiscal", "fiscal"),
    ("constitution", "constitution"),
)
OTHER_THEME = "document"
TRUTHY = ("1", "true", "yes")

# The four topics of expertise with their category, keywords and preferred titles.
TOPICS = (
    (
        "Famille",
        "02 — DROIT CIVIL, DE LA FAMILLE ET PROCEDURE CIVILE",
        ("code de la famille", "famille"),
        ("Code de la famille",),
        "code de la famille",
    ),
    (
        "Travail",
        "11 — DROIT DU TRAVAIL ET SECURITE SOCIALE",
        ("code du travail", "travail"),
        ("Droit du travaail", "Code du travail"),
        "code du travail",
    ),
    (
        "Immobilier",
        "08 — DROIT FONCIER, URBANISME ET CONSTRUCTION",
        ("urbanisme", "construction", "foncier", "bail"),
        ("Code de l’Urbanisme", "Code de lUrbanisme"),
        "urbanisme construction foncier bail",
    ),
    (
        "Affaires",
        "04 — DROIT COMMERCIAL ET DES AFFAIRES - OHADA",
        ("ohada", "societes", "commercial", "auscgie"),
        ("Acte uniforme Societes commerciales", "Traite OHADA (revise 2008)"),
        "ohada societes commerciales droit des affaires",
    ),
)
TOPIC_SCHEMA = "topic string, category string, keywords array<string>, titles array<string>, query string"


def theme(category) -> Column:
    """P10: first theme keyword found in the category."""
    lowered = F.lower(F.col(category) if isinstance(category, str) else category)
    out = F.lit(OTHER_THEME)
    for word, label in reversed(THEMES):
        out = F.when(contains_any(lowered, (word,)), label).otherwise(out)
    return out


# --------------------------------------------------------------------------------------------
# Facets and filters


def facet_values(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """A4: distinct non-blank values with their count and first position.

    Per result list (``keys``) the values also get their rank in French order.
    """
    v = df.where(text(column) != "").groupBy(*(keys or []), F.col(column).alias("value"))
    counted = v.agg(F.count(F.lit(1)).alias("documents"), F.min("pos").alias("first_pos"))
    if not keys:
        return counted
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*french("value"))))


def with_any(facets: DataFrame, keys: list[str]) -> DataFrame:
    """A4: the facet lists with the "any" entry in front, at rank 0."""
    head = facets.groupBy(*keys).agg(F.sum("documents").alias("documents"), F.min("first_pos").alias("first_pos"))
    return facets.unionByName(head.select(*keys, F.lit(ANY).alias("value"), "documents", "first_pos", F.lit(0).alias("rank")))


def french(c: str) -> list[Column]:
    """French order; the plain text decides between equal collation keys."""
    return [F.collate(F.col(c), "fr"), F.col(c)]


def facet_filter(documents: DataFrame, selection: DataFrame, doc_type: str = ANY, keys: list[str] | None = None) -> DataFrame:
    """documents whose category is selected (no selection, no rows) and whose type matches."""
    on = [*(keys or []), "category"]
    kept = documents if doc_type == ANY else documents.where(F.col("doc_type") == doc_type)
    return kept.join(selection.select(*on).distinct(), on, "left_semi")


def keep_selection(selection: DataFrame, available: DataFrame, key: str = "scope") -> DataFrame:
    """U4: still valid categories of every selection; all when nothing is left or was selected.

    Both inputs hold one array ``categories`` per key.
    """
    both = available.select(key, F.col("categories").alias("_all")).join(
        selection.select(key, F.col("categories").alias("_sel")), key, "left"
    )
    chosen = F.coalesce("_sel", F.array().cast("array<string>"))
    valid = F.filter(chosen, lambda c: F.array_contains("_all", c))
    return both.select(key, F.when(F.size(valid) == 0, F.col("_all")).otherwise(valid).alias("categories"))


def page_rows(
    rows: DataFrame, requests: DataFrame, size: int = PAGE_LIST, block: int = RANK_BLOCK, first: tuple[str, ...] = ()
) -> DataFrame:
    """The rows of the requested page; the page number is clamped to the last page.

    ``rows``: request_id, pos, ...; ``requests``: request_id, page. ``first`` names number columns that
    rank before the position, largest first, NULL as 0. Rows are counted per request, values of
    ``first`` and block of positions; only the blocks that touch the page are numbered.
    """
    before_pos = [(-F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_{c}") for c in first]
    blocked = rows.withColumn("_blk", F.struct(*before_pos, F.floor(F.col("pos") / block).cast("bigint").alias("_span")))
    counts = blocked.groupBy("request_id", "_blk").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("request_id").agg(F.sum("_n").alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(1))
    bounds = (
        totals.join(requests.select("request_id", F.col("page").alias("_asked")), "request_id")
        .withColumn("pages", pages)
        .withColumn("page", F.least(F.col("_asked"), F.col("pages")))
        .drop("_asked")
    )
    before = Window.partitionBy("request_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    low, high = (F.col("page") - 1) * size, F.col("page") * size
    touched = offsets.join(bounds, "request_id").where((F.col("_off") < high) & (F.col("_off") + F.col("_n") > low)).drop("_n")
    local = Window.partitionBy("request_id", "_blk").orderBy("pos")
    near = blocked.join(touched, ["request_id", "_blk"])
    rank = F.col("_off") + F.row_number().over(local)
    return near.withColumn("rank", rank.cast("bigint")).where((F.col("rank") > low) & (F.col("rank") <= high)).drop("_blk", "_off")


# --------------------------------------------------------------------------------------------
# Resolution of topics and labels


def topics(spark) -> DataFrame:
    return spark.createDataFrame([(t, c, list(k), list(p), q) for t, c, k, p, q in TOPICS], TOPIC_SCHEMA)


def resolve_topics(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """The best document of every topic.

    Inside the topic's category: the first preferred title that equals, or else is contained in, a
    document title; otherwise the highest keyword score; otherwise the first document. Each
    document is scored on its own, the winner is one combinable minimum per topic.
    """
    t = wanted.select(
        "topic",
        fold_label("category").alias("_cat"),
        F.filter(F.transform("keywords", fold_label), lambda x: x != "").alias("_kw"),
        F.filter(F.transform("titles", fold_label), lambda x: x != "").alias("_ti"),
    )
    d = documents.select(
        "doc_id",
        "pos",
        fold_label("category").alias("_cat"),
        fold_label("title").alias("_title"),
        fold_label("file_name").alias("_file"),
    )
    pairs = d.join(t, "_cat")
    score = F.aggregate(
        "_kw",
        F.lit(0),
        lambda acc, k: acc
        + F.when(F.contains(F.col("_title"), k), 4).when(F.contains(F.col("_file"), k), 3).otherwise(0),
    )
    # the earliest preferred title the document satisfies: 2i for equality, 2i+1 for containment
    preferred = F.array_min(
        F.transform(
            "_ti",
            lambda x, i: F.when(F.col("_title") == x, i * 2).when(F.contains(F.col("_title"), x), i * 2 + 1),
        )
    )
    stage = F.coalesce(preferred, F.lit(1 << 20))
    by_score = F.when(preferred.isNull(), -score).otherwise(F.lit(0))
    best = pairs.groupBy("topic").agg(
        F.min(F.struct(stage.alias("s"), by_score.alias("k"), F.col("pos").alias("p"), F.col("doc_id").alias("d"))).alias("b")
    )
    return best.select("topic", F.col("b.d").alias("doc_id"), F.col("b.p").alias("doc_pos"), (-F.col("b.k")).alias("score"))


def _containment(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """First name (smallest ``order``) that contains, or is contained in, each wanted text.

    ``wanted``: want; ``names``: name, order; both distinct. A blank on one side is contained in
    everything, so it meets the first name, or every wanted text, without any pairing.
    """
    w, n = wanted.where(F.col("want") != ""), names.where(F.col("name") != "")
    hits = _mutual(w, n.select("name")).join(n, "name").groupBy("want").agg(F.min("order").alias("order"))
    blank = F.min(F.when(F.col("name") == "", F.col("order")))
    ends = names.agg(F.struct(F.min("order").alias("first"), blank.alias("blank"))).scalar()
    found = wanted.join(hits, "want", "left")
    return found.select(
        "want", F.when(F.col("want") == "", ends["first"]).otherwise(F.least(F.col("order"), ends["blank"])).alias("order")
    )


def _mutual(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """(want, name) pairs of distinct non-blank texts where one contains the other."""
    inside = substring_pairs(wanted.select(F.col("want").alias("text")), names.select(F.col("name").alias("needle")))
    around = substring_pairs(names.select(F.col("name").alias("text")), wanted.select(F.col("want").alias("needle")))
    return inside.select(F.col("text").alias("want"), F.col("needle").alias("name")).unionByName(
        around.select(F.col("needle").alias("want"), F.col("text").alias("name"))
    )


def list_order(value: str = "value") -> Column:
    """Orderable place of an option in a French-sorted list; ``v`` is the option itself."""
    return F.struct(F.collate(F.col(value), "fr").alias("c"), F.col(value).alias("v"))


def resolve_labels(wanted: DataFrame, options: DataFrame) -> DataFrame:
    """The category every wanted label means, ``all`` when none fits.

    Tried in turn: the same text, the same folded text, containment of the folded texts either way
    (the first option in list order). ``wanted``: label; ``options``: value. Works on distinct
    labels; blank labels are left out.
    """
    labels = wanted.select("label").where(text("label") != "").distinct().withColumn("want", fold_catalog("label"))
    listed = options.select("value").distinct()
    by_fold = listed.groupBy(fold_catalog("value").alias("name")).agg(F.min(list_order()).alias("order"))
    raw = labels.join(listed.select(F.col("value").alias("label"), F.col("value").alias("_raw")), "label", "left")
    near = raw.join(by_fold.select(F.col("name").alias("want"), F.col("order.v").alias("_fold")), "want", "left")
    open_texts = near.where(F.col("_raw").isNull() & F.col("_fold").isNull()).select("want").distinct()
    loose = _containment(open_texts, by_fold).select("want", F.col("order.v").alias("_loose"))
    settled = near.join(loose, "want", "left")
    return settled.select("label", F.coalesce("_raw", "_fold", "_loose", F.lit(ALL)).alias("category"))


def resolve_presets(wanted: DataFrame, documents: DataFrame) -> DataFrame:
    """Category and document that a link (category, title) selects.

    ``wanted``: request_id, doc_id, category, title. A known document id decides alone. Otherwise
    the title is looked for inside the resolved category,
    or everywhere when no category was resolved: equal folded title first, then containment.
    """
    options = facet_values(documents, "category").select("value")
    labels = resolve_labels(wanted.select(F.col("category").alias("label")), options)
    req = wanted.withColumn("want", fold_catalog("title")).withColumn("label", F.col("category")).drop("category")
    req = req.join(labels, "label", "left").withColumn("category", F.coalesce("category", F.lit(ALL))).drop("label")
    # every document counts once for its own category and once for "all"
    d = documents.select("doc_id", F.col("pos").alias("order"), fold_catalog("title").alias("name"), F.col("category").alias("_own"))
    scoped = d.select("doc_id", "order", "name", "_own", F.explode(F.array(F.col("_own"), F.lit(ALL))).alias("_cat"))
    first = scoped.groupBy("_cat", "name").agg(F.min(F.struct("order", "doc_id", "_own")).alias("_d"))
    asked = req.where(F.col("want") != "").select(F.col("category").alias("_cat"), "want").distinct()
    # equal texts contain each other, so one set of pairs serves both rules
    pairs = _mutual(asked.select("want").distinct(), first.select("name").where(F.col("name") != "").distinct())
    named_hits = asked.join(pairs, "want").join(first, ["_cat", "name"])
    blank_hits = asked.join(first.where(F.col("name") == ""), "_cat")
    hits = named_hits.select("_cat", "want", "name", "_d").unionByName(blank_hits.select("_cat", "want", "name", "_d"))
    best = F.struct((F.col("name") != F.col("want")).alias("loose"), F.col("_d").alias("d"))
    found = hits.groupBy("_cat", "want").agg(F.min(best).alias("_h")).select(
        F.col("_cat").alias("category"), "want", F.col("_h.d").alias("_hit")
    )
    out = req.join(found, ["category", "want"], "left")
    known = documents.select("doc_id", F.col("category").alias("_known"))
    by_id = lookup(wanted.where(F.col("doc_id").isNotNull()).select("request_id", "doc_id"), known, "doc_id")
    fixed = by_id.where(F.col("_known").isNotNull()).select("request_id", F.col("doc_id").alias("_doc"), "_known")
    return out.join(fixed, "request_id", "left").select(
        "request_id",
        F.coalesce("_known", "_hit._own", "category").alias("category"),
        F.coalesce("_doc", F.when(F.col("_known").isNull(), F.col("_hit.doc_id"))).alias("doc_id"),
    )


def valid_selection(selections: DataFrame, documents: DataFrame) -> DataFrame:
    """A selected document must exist, and lie in the selected category; else ``all``.

    ``selections``: request_id, doc_id, category.
    """
    known = documents.select("doc_id", F.col("category").alias("_own"))
    checked = lookup(selections, known, "doc_id")
    ok = F.col("_own").isNotNull() & ((F.col("category") == ALL) | (F.col("category") == F.col("_own")))
    return checked.select(
        "request_id", "category", F.when(ok, F.col("doc_id").cast("string")).otherwise(ALL).alias("doc_id")
    )


# --------------------------------------------------------------------------------------------
# Search links


def query_value(url, name: str) -> Column:
    """First value of a query parameter, decoded (``+`` is a space) and stripped; blank if absent."""
    raw = F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("QUERY"), F.lit(name))
    return text(F.coalesce(F.try_url_decode(raw), raw))


def parse_search_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Filter state of a library link."""
    names = {
        "q": "q", "article": "article", "keyword": "keyword", "infraction_type": "infractionType",
        "jurisdiction": "jurisdiction", "document_title": "documentTitle",
    }
    out = df.withColumns({c: query_value(url, p) for c, p in names.items()})
    categories = F.filter(F.transform(F.split(query_value(url, "category"), ","), strip), lambda x: x != "")
    return out.withColumns(
        {
            "document_id": F.coalesce(F.nullif(query_value(url, "documentId"), F.lit("")), F.lit(ALL)),
            "categories": categories,
            "category": F.coalesce(F.get(categories, F.lit(0)), F.lit(ALL)),
        }
    )


def truthy(c: Column) -> Column:
    return F.lower(c).isin(*TRUTHY)


def parse_chat_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Start parameters of a chat link."""

    def raw(name):
        v = F.try_parse_url(F.col(url), F.lit("QUERY"), F.lit(name))
        return F.coalesce(F.try_url_decode(v), v, F.lit(""))

    return df.withColumns(
        {
            "question": raw("q"),
            "open_drafts": truthy(raw("act")),
            "template_id": raw("template"),
            "new_session": truthy(raw("new")),
        }
    )


def build_query(parts: dict[str, Column]) -> Column:
    """Query string of the non-blank parts, ``+`` for spaces, ``?`` in front if any."""
    pairs = [
        F.when(filled(v).isNotNull(), F.concat(F.lit(f"{k}="), F.url_encode(text(v)))) for k, v in parts.items()
    ]
    joined = F.concat_ws("&", *pairs)
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def ask_url(title) -> Column:
    """Link that asks about a document."""
    return F.concat(F.lit("/chat?q="), encode_component(F.concat(F.lit("Analyse ce document: "), title, F.lit("."))))


