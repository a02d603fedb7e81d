"""Registered queries over the document catalog and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions.text import safe_file_name, slug
from docketry.operators import catalog, dashboard, search
from docketry.plans.registry import query
from docketry.sources import fixtures as fx


def fold_sql(expr: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({expr})), '[^a-z0-9]+', ' ', 'g'))"


# French order of the handful of categories and types: accents and case do not decide.
FR = "lower(strip_accents({0}))"


@query(
    "category_themes",
    "P10",
    """SELECT category, CASE WHEN contains(lower(category), 'travail') THEN 'travail' WHEN contains(lower(category), 'penal') THEN 'penal'
  WHEN contains(lower(category), 'electoral') THEN 'electoral' WHEN contains(lower(category), 'ohada') THEN 'ohada'
  WHEN contains(lower(category), 'notariat') THEN 'notariat' WHEN contains(lower(category), 'fiscal') THEN 'fiscal'
  WHEN contains(lower(category), 'constitution') THEN 'constitution' ELSE 'document' END AS theme, count(*) AS documents FROM v_catalog GROUP BY ALL""",
    ("v_catalog",),
)
def category_themes(spark, sf_dir):
    c = fx.catalog(spark, sf_dir)
    return c.groupBy("category", catalog.theme("category").alias("theme")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "facet_values",
    "A4 T2",
    f"""WITH f AS (SELECT doc_type, category AS value, count(*) AS documents, min(pos) AS first_pos FROM v_catalog GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_type ORDER BY {FR.format('value')}) AS INTEGER) AS rank FROM f)
SELECT * FROM r UNION ALL SELECT doc_type, 'Tous', CAST(sum(documents) AS BIGINT), min(first_pos), 0 FROM r GROUP BY doc_type""",
    ("v_catalog",),
)
def facet_values(spark, sf_dir):
    f = catalog.facet_values(fx.catalog(spark, sf_dir), "category", ["doc_type"])
    return catalog.with_any(f, ["doc_type"])


@query(
    "document_types",
    "A4",
    "SELECT doc_type AS value, count(*) AS documents, min(pos) AS first_pos FROM v_catalog GROUP BY ALL",
    ("v_catalog",),
)
def document_types(spark, sf_dir):
    return catalog.facet_values(fx.catalog(spark, sf_dir), "doc_type")


@query(
    "facet_filtered_documents",
    "F4 S4",
    "SELECT doc_id, category, doc_type FROM v_catalog WHERE category IN ('02 — Droit civil', '04 — OHADA') AND doc_type = 'Loi'",
    ("v_catalog",),
)
def facet_filtered_documents(spark, sf_dir):
    picks = spark.createDataFrame([("02 — Droit civil",), ("04 — OHADA",)], "category string")
    kept = catalog.facet_filter(fx.catalog(spark, sf_dir), picks, "Loi")
    return kept.select("doc_id", "category", "doc_type")


@query(
    "kept_selection",
    "U4",
    """WITH av AS (SELECT doc_id % 40 AS scope, array_to_string(list_sort(list(DISTINCT category)), '|') AS allc FROM v_catalog GROUP BY ALL),
sel AS (SELECT doc_id % 40 AS scope, category FROM v_catalog WHERE doc_type = 'Loi' GROUP BY ALL),
asked AS (SELECT scope, category FROM sel UNION ALL SELECT DISTINCT scope, 'gone' FROM sel WHERE scope % 3 = 0),
v AS (SELECT a.scope, array_to_string(list_sort(list(DISTINCT a.category)), '|') AS kept FROM asked a
  WHERE EXISTS (SELECT 1 FROM v_catalog c WHERE c.doc_id % 40 = a.scope AND c.category = a.category) AND a.scope % 5 <> 0 GROUP BY ALL)
SELECT av.scope, coalesce(v.kept, av.allc) AS categories FROM av LEFT JOIN v ON v.scope = av.scope""",
    ("v_catalog",),
)
def kept_selection(spark, sf_dir):
    c = fx.catalog(spark, sf_dir).withColumn("scope", F.col("doc_id") % 40)
    available = c.groupBy("scope").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    asked = c.where(F.col("doc_type") == "Loi").groupBy("scope").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    gone = F.when(F.col("scope") % 3 == 0, F.concat("categories", F.array(F.lit("gone")))).otherwise(F.col("categories"))
    asked = asked.select("scope", F.when(F.col("scope") % 5 == 0, F.array(F.lit("gone"))).otherwise(gone).alias("categories"))
    return catalog.keep_selection(asked, available).select("scope", F.array_join("categories", "|").alias("categories"))


@query(
    "catalog_pages",
    "W8 T2",
    """WITH rq AS (SELECT DISTINCT doc_type AS request_id, CASE doc_type WHEN 'Code' THEN 1 WHEN 'Loi' THEN 3 ELSE 100000 END AS asked FROM v_catalog),
r AS (SELECT doc_type AS request_id, doc_id, row_number() OVER (PARTITION BY doc_type ORDER BY pos) AS rank, count(*) OVER (PARTITION BY doc_type) AS total FROM v_catalog),
b AS (SELECT r.*, CAST(greatest(1, ceil(total / 8.0)) AS BIGINT) AS pages, asked FROM r JOIN rq ON rq.request_id = r.request_id),
c AS (SELECT request_id, doc_id, rank, total, pages, least(CAST(asked AS BIGINT), pages) AS page FROM b)
SELECT * FROM c WHERE rank > (page - 1) * 8 AND rank <= page * 8""",
    ("v_catalog",),
)
def catalog_pages(spark, sf_dir):
    c = fx.catalog(spark, sf_dir).withColumnRenamed("doc_type", "request_id")
    asked = F.when(F.col("request_id") == "Code", 1).when(F.col("request_id") == "Loi", 3).otherwise(100000)
    requests = c.select("request_id").distinct().withColumn("page", asked.cast("bigint"))
    pages = catalog.page_rows(c.select("request_id", "pos", "doc_id"), requests, block=256)
    return pages.select("request_id", "doc_id", "rank", "total", "pages", "page")


@query(
    "topic_documents",
    "J2",
    """WITH t(topic, cat, kws, tis) AS (VALUES
 ('civil', '02 — droit civil', ['aile', 'eau'], []),
 ('travail', '11 — DROIT DU TRAVAIL', ['that', 'tion'], ['is and', 'anat with by of']),
 ('penal', '06 — Droit penal', ['zzzz', 'doc_7'], ['nowhere to be found']),
 ('ohada', '04 — ohada', [], []),
 ('none', 'no such category', ['a'], [])),
d AS (SELECT doc_id, pos, lower(strip_accents(category)) AS cat, trim(lower(strip_accents(title)), ' ' || chr(10)) AS title, lower(strip_accents(file_name)) AS f FROM v_catalog),
p AS (SELECT t.topic, d.* , kws, tis FROM t JOIN d ON d.cat = lower(strip_accents(t.cat))),
k AS (SELECT topic, doc_id, sum(CASE WHEN contains(title, kw) THEN 4 WHEN contains(f, kw) THEN 3 ELSE 0 END) AS score
  FROM (SELECT topic, doc_id, title, f, unnest(kws) AS kw FROM p) GROUP BY ALL),
s AS (SELECT topic, doc_id, min(CASE WHEN title = ti THEN 2 * (i - 1) WHEN contains(title, ti) THEN 2 * (i - 1) + 1 END) AS stage
  FROM (SELECT topic, doc_id, title, unnest(tis) AS ti, generate_subscripts(tis, 1) AS i FROM p) GROUP BY ALL),
r AS (SELECT p.topic, p.doc_id, p.pos, row_number() OVER (PARTITION BY p.topic ORDER BY s.stage NULLS LAST, CASE WHEN s.stage IS NULL THEN -coalesce(k.score, 0) ELSE 0 END, p.pos) AS rn
  FROM p LEFT JOIN k ON k.topic = p.topic AND k.doc_id = p.doc_id LEFT JOIN s ON s.topic = p.topic AND s.doc_id = p.doc_id)
SELECT topic, doc_id, pos AS doc_pos FROM r WHERE rn = 1""",
    ("v_catalog",),
)
def topic_documents(spark, sf_dir):
    rows = [
        ("civil", "02 — droit civil", ["aile", "eau"], []),
        ("travail", "11 — DROIT DU TRAVAIL", ["that", "tion"], ["is and", "anat with by of"]),
        ("penal", "06 — Droit penal", ["zzzz", "doc_7"], ["nowhere to be found"]),
        ("ohada", "04 — ohada", [], []),
        ("none", "no such category", ["a"], []),
    ]
    t = spark.createDataFrame(rows, "topic string, category string, keywords array<string>, titles array<string>")
    return catalog.resolve_topics(t, fx.catalog(spark, sf_dir)).select("topic", "doc_id", "doc_pos")


WANTED = """w AS (SELECT doc_id AS request_id, CASE doc_id % 6 WHEN 0 THEN category WHEN 1 THEN upper(strip_accents(category)) WHEN 2 THEN 'Droit'
  WHEN 3 THEN concat('x ', category, ' y') WHEN 4 THEN 'Marchés publics' ELSE ' ' END AS label,
  CASE doc_id % 4 WHEN 0 THEN concat(title, ' !') WHEN 1 THEN substring(title, 9, 20) WHEN 2 THEN concat('>> ', title, ' <<') ELSE 'no such title anywhere' END AS title,
  CASE WHEN doc_id % 11 = 0 THEN doc_id WHEN doc_id % 11 = 1 THEN -doc_id END AS asked_doc FROM v_catalog)"""


def wanted_labels(spark, sf_dir):
    c = fx.catalog(spark, sf_dir)
    from docketry.functions.text import strip_accents

    k, m, n = F.col("doc_id") % 6, F.col("doc_id") % 4, F.col("doc_id") % 11
    return c.select(
        F.col("doc_id").alias("request_id"),
        F.when(k == 0, F.col("category"))
        .when(k == 1, F.upper(strip_accents("category")))
        .when(k == 2, "Droit")
        .when(k == 3, F.concat(F.lit("x "), "category", F.lit(" y")))
        .when(k == 4, "Marchés publics")
        .otherwise(" ")
        .alias("label"),
        F.when(m == 0, F.concat("title", F.lit(" !")))
        .when(m == 1, F.substring("title", 9, 20))
        .when(m == 2, F.concat(F.lit(">> "), "title", F.lit(" <<")))
        .otherwise("no such title anywhere")
        .alias("title"),
        F.when(n == 0, F.col("doc_id")).when(n == 1, -F.col("doc_id")).alias("doc_id"),
    )


LABELS = f"""o AS (SELECT DISTINCT category AS v, {fold_sql('category')} AS f FROM v_catalog),
l AS (SELECT DISTINCT label, {fold_sql('label')} AS w FROM w WHERE trim(label) <> ''),
lr AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN v = label THEN 0 WHEN f = w THEN 1 ELSE 2 END, {FR.format('v')}) AS rn
  FROM l JOIN o ON v = label OR f = w OR contains(f, w) OR contains(w, f)),
lab AS (SELECT l.label, coalesce(lr.v, 'all') AS category FROM l LEFT JOIN lr ON lr.label = l.label AND rn = 1)"""


@query(
    "resolved_labels",
    "J3",
    f"WITH {WANTED}, {LABELS} SELECT label, category FROM lab",
    ("v_catalog",),
)
def resolved_labels(spark, sf_dir):
    c = fx.catalog(spark, sf_dir)
    return catalog.resolve_labels(wanted_labels(spark, sf_dir), c.select(F.col("category").alias("value")))


@query(
    "resolved_presets",
    "J3 J12",
    f"""WITH {WANTED}, {LABELS},
q AS (SELECT w.request_id, w.asked_doc, coalesce(lab.category, 'all') AS category, {fold_sql('w.title')} AS t FROM w LEFT JOIN lab ON lab.label = w.label),
d AS (SELECT doc_id, pos, category, {fold_sql('title')} AS n FROM v_catalog),
h AS (SELECT q.request_id, d.doc_id, d.category, row_number() OVER (PARTITION BY q.request_id ORDER BY CASE WHEN d.n = q.t THEN 0 ELSE 1 END, d.pos) AS rn
  FROM q JOIN d ON (q.category = 'all' OR d.category = q.category) AND q.t <> '' AND (d.n = q.t OR contains(d.n, q.t) OR contains(q.t, d.n)))
SELECT q.request_id, coalesce(k.category, h.category, q.category) AS category, coalesce(k.doc_id, h.doc_id) AS doc_id
FROM q LEFT JOIN h ON h.request_id = q.request_id AND rn = 1 LEFT JOIN v_catalog k ON k.doc_id = q.asked_doc""",
    ("v_catalog",),
)
def resolved_presets(spark, sf_dir):
    w = wanted_labels(spark, sf_dir).withColumnRenamed("label", "category")
    return catalog.resolve_presets(w, fx.catalog(spark, sf_dir))


@query(
    "valid_selection",
    "J12",
    """SELECT s.request_id, s.category, CASE WHEN c.doc_id IS NOT NULL AND (s.category = 'all' OR s.category = c.category) THEN CAST(s.doc_id AS VARCHAR) ELSE 'all' END AS doc_id
FROM (SELECT doc_id AS request_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id * 3 END AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'all' ELSE category END AS category FROM v_catalog) s
LEFT JOIN v_catalog c ON c.doc_id = s.doc_id""",
    ("v_catalog",),
)
def valid_selection(spark, sf_dir):
    c = fx.catalog(spark, sf_dir)
    picks = c.select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("doc_id") * 3).alias("doc_id"),
        F.when(F.col("doc_id") % 3 == 0, "all").otherwise(F.col("category")).alias("category"),
    )
    return catalog.valid_selection(picks, c)


@query(
    "clean_search_requests",
    "P15",
    """SELECT request_id, nullif(trim(q), '') AS q, nullif(trim(keyword), '') AS keyword, CASE WHEN request_id % 3 = 0 THEN NULL ELSE 'Art. ' || request_id END AS article,
  CASE WHEN request_id % 2 = 0 THEN 'all' ELSE 'x' END AS category,
  CASE WHEN trim(coalesce(keyword, '')) <> '' THEN 1 ELSE 0 END + CASE WHEN request_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN request_id % 2 = 0 THEN 0 ELSE 1 END AS active_filters
FROM v_search_requests""",
    ("v_search_requests",),
)
def clean_search_requests(spark, sf_dir):
    r = fx.search_requests(spark, sf_dir).withColumns(
        {
            "q": F.concat(F.lit(" "), "q", F.lit(" ")),
            "article": F.when(F.col("request_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("Art. "), F.col("request_id").cast("string"))),
            "category": F.when(F.col("request_id") % 2 == 0, "all").otherwise("x"),
        }
    )
    return search.clean_requests(r).select("request_id", "q", "keyword", "article", "category", "active_filters")


SEARCH = f"""ix AS (SELECT DISTINCT chunk_id, doc_id, pos, page_start, unnest(string_split({fold_sql('text')}, ' ')) AS word FROM v_chunks),
rq AS (SELECT request_id, {fold_sql("concat(q, ' ', keyword)")} AS t, CASE WHEN request_id % 4 = 1 THEN 'an' ELSE '' END AS article,
  CASE WHEN request_id % 5 = 2 THEN '11 — Droit du travail' ELSE '' END AS category FROM v_search_requests),
tm AS (SELECT DISTINCT request_id, article, unnest(string_split(t, ' ')) AS word FROM rq),
m AS (SELECT tm.request_id, ix.doc_id, ix.chunk_id, ix.pos, ix.page_start, count(*) AS score, any_value(article) AS article FROM ix JOIN tm ON tm.word = ix.word WHERE tm.word <> '' GROUP BY ALL),
mm AS (SELECT m.* FROM m JOIN v_chunks c ON c.chunk_id = m.chunk_id WHERE article = '' OR contains({fold_sql('c.text')}, article))"""


def search_requests(spark, sf_dir):
    """Two words per request; some ask for an article text, some for one category."""
    return fx.search_requests(spark, sf_dir).withColumns(
        {
            "article": F.when(F.col("request_id") % 4 == 1, "An").otherwise(""),
            "category": F.when(F.col("request_id") % 5 == 2, "11 — Droit du travail").otherwise(""),
        }
    )


@query(
    "matching_chunks",
    "F8",
    f"WITH {SEARCH} SELECT request_id, count(*) AS chunks, CAST(sum(score) AS BIGINT) AS score FROM mm GROUP BY ALL",
    ("v_chunks", "v_search_requests"),
)
def matching_chunks(spark, sf_dir):
    searches, mapped = search.distinct_searches(search_requests(spark, sf_dir))
    m = search.matching_chunks(searches, fx.chunks(spark, sf_dir))
    per_search = m.groupBy("search").agg(F.count(F.lit(1)).alias("chunks"), F.sum("score").alias("score"))
    return mapped.join(per_search, "search").select("request_id", "chunks", "score")


@query(
    "document_search",
    "F8 A8 S4 S5",
    f"""WITH {SEARCH},
d AS (SELECT request_id, doc_id, CAST(max(score) AS DOUBLE) AS search_score, count(*) AS matched_chunk_count,
  array_to_string(list_sort(list(DISTINCT page_start)), ',') AS matched_pages, arg_max(chunk_id, score * 1000000 - pos) AS chunk_id FROM mm GROUP BY ALL)
SELECT d.request_id, d.doc_id, search_score, matched_chunk_count, matched_pages, substring(c.text, 1, 240) AS matched_snippet
FROM d JOIN v_chunks c ON c.chunk_id = d.chunk_id JOIN v_catalog k ON k.doc_id = d.doc_id JOIN rq ON rq.request_id = d.request_id
WHERE rq.category = '' OR rq.category = k.category""",
    ("v_chunks", "v_search_requests", "v_catalog"),
)
def document_search(spark, sf_dir):
    found = search.search_documents(search_requests(spark, sf_dir), fx.chunks(spark, sf_dir), fx.catalog(spark, sf_dir))
    return found.select(
        "request_id", "doc_id", "search_score", "matched_chunk_count",
        F.array_join(F.transform("matched_pages", lambda p: p.cast("string")), ",").alias("matched_pages"), "matched_snippet",
    )


@query(
    "best_documents",
    "A8 T3 W8",
    f"""WITH {SEARCH}, d AS (SELECT request_id, doc_id, CAST(max(score) AS DOUBLE) AS search_score, count(*) AS n FROM mm GROUP BY ALL),
r AS (SELECT d.request_id, d.doc_id, search_score, n, CAST(row_number() OVER (PARTITION BY d.request_id ORDER BY search_score DESC, n DESC, k.pos) AS INTEGER) AS rank
FROM d JOIN v_catalog k ON k.doc_id = d.doc_id JOIN rq ON rq.request_id = d.request_id WHERE rq.category = '' OR rq.category = k.category)
SELECT request_id, doc_id, search_score, n AS matched_chunk_count, rank FROM r WHERE rank <= 8""",
    ("v_chunks", "v_search_requests", "v_catalog"),
)
def best_documents(spark, sf_dir):
    found = search.search_documents(search_requests(spark, sf_dir), fx.chunks(spark, sf_dir), fx.catalog(spark, sf_dir))
    w = Window.partitionBy("request_id").orderBy(F.desc("search_score"), F.desc("matched_chunk_count"), "doc_pos")
    return (
        found.select("request_id", "doc_id", "search_score", "matched_chunk_count", "doc_pos")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= catalog.PAGE_LIST)
        .drop("doc_pos")
    )


@query(
    "article_only_search",
    "F8",
    f"""WITH rq AS (SELECT request_id, {fold_sql("concat(q, ' ', keyword)")} AS article FROM v_search_requests WHERE q <> '')
SELECT rq.request_id, c.doc_id, count(*) AS chunks FROM rq JOIN v_chunks c ON contains({fold_sql('c.text')}, article) GROUP BY ALL""",
    ("v_chunks", "v_search_requests"),
)
def article_only_search(spark, sf_dir):
    r = fx.search_requests(spark, sf_dir).where(F.col("q") != "")
    r = r.select("request_id", F.concat_ws(" ", "q", "keyword").alias("article"))
    found = search.search_documents(r, fx.chunks(spark, sf_dir), fx.catalog(spark, sf_dir))
    return found.select("request_id", "doc_id", F.col("matched_chunk_count").alias("chunks"))


@query(
    "filtered_listing",
    "F8 S4",
    """SELECT r.request_id, k.doc_id FROM (SELECT item_id AS request_id, item_id % 4 AS m FROM benchmark) r JOIN v_catalog k
ON CASE r.m WHEN 0 THEN k.category = '04 — OHADA' WHEN 1 THEN k.doc_id = r.request_id WHEN 2 THEN k.doc_id = r.request_id AND k.category = '04 — OHADA' ELSE true END""",
    ("v_catalog",),
)
def filtered_listing(spark, sf_dir):
    m = F.col("item_id") % 4
    r = fx.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"),
        F.when(m.isin(0, 2), "04 — OHADA").alias("category"),
        F.when(m.isin(1, 2), F.col("item_id").cast("string")).alias("document_id"),
    )
    found = search.search_documents(r, fx.chunks(spark, sf_dir), fx.catalog(spark, sf_dir))
    return found.select("request_id", "doc_id")


@query(
    "export_names",
    "X21 X2 X20",
    """SELECT doc_id, coalesce(nullif(left(lower(regexp_replace(trim(regexp_replace(strip_accents(title), '[^a-zA-Z0-9_\\s-]', '', 'g'), ' ' || chr(10)), '\\s+', '_', 'g')), 80), ''), 'document_juridique') AS export_name,
  coalesce(nullif(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'modele-personnalise') AS slug,
  CASE WHEN size <= 0 THEN '0 B' WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN CAST(CAST(round(size / 1024.0, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' KB'
    ELSE CAST(CAST(round(size / 1048576.0, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' MB' END AS file_size,
  CASE WHEN size * 977 < 1024 THEN (size * 977) || ' B'
    WHEN size * 977 < 1048576 THEN CASE WHEN size * 977 / 1024.0 >= 10 THEN CAST(CAST(floor(size * 977 / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(size * 977 / 1024.0, 1) AS DECIMAL(20,1)) AS VARCHAR) END || ' KB'
    ELSE CASE WHEN size * 977 / 1048576.0 >= 10 THEN CAST(CAST(floor(size * 977 / 1048576.0 + 0.5) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(round(size * 977 / 1048576.0, 1) AS DECIMAL(20,1)) AS VARCHAR) END || ' MB' END AS volume
FROM v_catalog""".replace("\\\\", "\\"),
    ("v_catalog",),
)
def export_names(spark, sf_dir):
    return fx.catalog(spark, sf_dir).select(
        "doc_id",
        safe_file_name("title").alias("export_name"),
        slug("title").alias("slug"),
        dashboard.file_size("size").alias("file_size"),
        dashboard.volume(F.col("size") * 977).alias("volume"),
    )


@query(
    "slug_collisions",
    "X2",
    """SELECT coalesce(nullif(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'champ') AS slug, count(*) AS titles, min(doc_id) AS first_doc
FROM v_catalog GROUP BY ALL HAVING count(*) > 1""",
    ("v_catalog",),
)
def slug_collisions(spark, sf_dir):
    s = fx.catalog(spark, sf_dir).select("doc_id", slug("title", "_", "champ").alias("slug"))
    return s.groupBy("slug").agg(F.count(F.lit(1)).alias("titles"), F.min("doc_id").alias("first_doc")).where(F.col("titles") > 1)


@query(
    "search_links",
    "S9 X22",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), '') AS page, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref,
  regexp_extract(lower(url), '^https?://([^/]+)', 1) AS host,
  'Recht & ' || page_id AS q, 'all' AS document_id, 'Droit civil|OHADA' AS categories, page_id % 2 = 0 AS open_drafts
FROM pages""",
)
def search_links(spark, sf_dir):
    """Filter state of the crawled links, and of library links built from them."""
    p = fx.table(spark, sf_dir, "pages")
    q = F.concat(F.lit("Recht & "), F.col("page_id").cast("string"))
    built = F.concat(
        F.lit("https://library.example/bibliotheque"),
        catalog.build_query(
            {
                "q": q,
                "article": F.lit("  "),
                "category": F.lit(" Droit civil, ,OHADA "),
                "act": F.when(F.col("page_id") % 2 == 0, "TRUE").otherwise("no"),
            }
        ),
    )
    parsed = catalog.parse_chat_urls(catalog.parse_search_urls(p.withColumn("link", built), "link"), "link")
    return parsed.select(
        "page_id",
        catalog.query_value("url", "page").alias("page"),
        catalog.query_value("url", "ref").alias("ref"),
        F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"),
        "q",
        "document_id",
        F.array_join("categories", "|").alias("categories"),
        "open_drafts",
    )


@query(
    "topic_links",
    "J2 X22",
    None,
)
def topic_links(spark, sf_dir):
    """Library links of the fixed topics, for the documents found in the catalog."""
    t = catalog.topics(spark)
    c = fx.catalog(spark, sf_dir)
    hits = catalog.resolve_topics(t, c)
    named = t.join(hits, "topic", "left").join(c.select("doc_id", "title", F.col("category").alias("_cat")), "doc_id", "left")
    link = catalog.build_query(
        {
            "category": F.coalesce("_cat", "category"),
            "documentId": F.col("doc_id").cast("string"),
            "documentTitle": F.coalesce("title", F.get("titles", F.lit(0))),
            "keyword": F.col("query"),
        }
    )
    return named.select("topic", F.concat(F.lit("/bibliotheque"), link).alias("link"))
