"""Registered queries over answer sources, citations and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.paths import canonical_path
from docketry.operators import attribution as at
from docketry.operators import linkage
from docketry.plans.registry import query
from docketry.sources import fixtures as fx

BASE_URL = "https://library.example"

CITED = r"""cited AS (SELECT t.session_id, t.pos AS turn_pos, coalesce(m.c, CAST([] AS BIGINT[])) AS c FROM v_turns t LEFT JOIN (
  SELECT session_id, pos, list(DISTINCT n) AS c FROM (
    SELECT session_id, pos, CAST(unnest(regexp_extract_all(answer, '(?i)\[source\s+(\d+)\]', 1)) AS BIGINT) AS n FROM v_turns)
  WHERE n > 0 GROUP BY session_id, pos) m ON m.session_id = t.session_id AND m.pos = t.pos)"""

USED = f"""{CITED},
s AS (SELECT ts.*, c.c, coalesce('chunk:' || chunk_id, 'doc:' || relative_path || '|citation:|pages:na-na|rank:' || coalesce(rank, ts.pos + 1)) AS usage_key
  FROM v_turn_sources ts JOIN cited c ON c.session_id = ts.session_id AND c.turn_pos = ts.turn_pos),
firsts AS (SELECT session_id, turn_pos, usage_key, min(pos) AS f, row_number() OVER (PARTITION BY session_id, turn_pos ORDER BY min(pos)) AS n
  FROM s WHERE len(c) = 0 GROUP BY session_id, turn_pos, usage_key),
cut AS (SELECT session_id, turn_pos, max(f) FILTER (n = 5) AS at FROM firsts GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN cut ON cut.session_id = s.session_id AND cut.turn_pos = s.turn_pos
  WHERE CASE WHEN len(c) > 0 THEN list_contains(c, coalesce(rank, s.pos + 1)) ELSE cut.at IS NULL OR s.pos <= cut.at END),
used AS (SELECT session_id, turn_pos, usage_key, min(pos) AS pos, max_by(CASE WHEN rank IS NULL THEN -1 ELSE rank END, pos) AS rank0,
  max_by(coalesce(chunk_id, ''), pos) AS chunk0, max_by(relative_path, pos) AS relative_path, CASE WHEN max(len(c)) > 0 THEN 'cited' ELSE 'retrieved' END AS source_mode
  FROM kept GROUP BY session_id, turn_pos, usage_key),
u AS (SELECT session_id, turn_pos, usage_key, pos, CASE WHEN rank0 > 0 THEN CAST(rank0 AS DOUBLE) END AS rank, nullif(chunk0, '') AS chunk_id, relative_path, source_mode,
  row_number() OVER (PARTITION BY session_id, turn_pos ORDER BY CASE WHEN rank0 > 0 THEN rank0 END ASC NULLS LAST, pos) - 1 AS use_pos FROM used)"""

FAMILY = """CASE WHEN contains(lower(relative_path), 'jurisprudence') OR contains(lower(relative_path), 'cour supreme') OR contains(lower(relative_path), 'bulletin') THEN 'Jurisprudence'
  WHEN contains(lower(relative_path), 'doctrine') OR contains(lower(relative_path), 'revue') OR contains(lower(relative_path), 'commentaire') THEN 'Doctrine'
  WHEN regexp_matches(lower(relative_path), 'code|loi|decret|constitution|ordonnance|arrete') THEN 'Code penal / Lois' ELSE 'Autres sources' END"""

CARDS = f"""{USED},
cards AS (SELECT session_id, turn_pos, use_pos AS card_pos, 'Source ' || coalesce(CAST(CAST(rank AS BIGINT) AS VARCHAR), CAST(use_pos + 1 AS VARCHAR)) AS badge,
  'Reference juridique' AS excerpt, relative_path AS meta, source_mode, chunk_id, relative_path AS source_path FROM u WHERE use_pos < 8)"""


def norm_sql(expr: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(replace(replace(replace(strip_accents("
        f"trim(coalesce({expr}, ''))), '\\', '/'), '\"', ''), '''', ''), '`', '')), '^[a-z]:', ''), '/+', '/', 'g'), '^/+', ''))"
    )


LINK = f"""d AS (SELECT doc_id, pos AS doc_pos, {norm_sql('relative_path')} AS p, {norm_sql('file_name')} AS f FROM v_catalog),
k AS (SELECT session_id, pos, source_path, meta, {norm_sql('source_path')} AS t0, {norm_sql('meta')} AS t1 FROM v_cards),
t AS (SELECT session_id, pos, 0 AS cand, t0 AS t FROM k WHERE t0 <> '' UNION ALL SELECT session_id, pos, 1, t1 FROM k WHERE t1 <> ''),
sc AS (SELECT session_id, pos, cand, doc_pos, doc_id, CASE WHEN t = p THEN 120 WHEN ends_with(t, '/' || p) THEN 110 WHEN contains(t, p) THEN 95
  WHEN t = f THEN 80 WHEN ends_with(t, '/' || f) THEN 72 WHEN contains(t, f) THEN 60 ELSE 0 END AS score FROM t, d),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, pos ORDER BY score DESC, cand, doc_pos) AS rn FROM sc WHERE score > 0) WHERE rn = 1),
linked AS (SELECT k.session_id, k.pos, k.source_path, k.meta, best.score, best.doc_pos, best.doc_id FROM k LEFT JOIN best ON best.session_id = k.session_id AND best.pos = k.pos)"""


def used(spark, sf_dir):
    return at.used_sources(fx.turns(spark, sf_dir), fx.turn_sources(spark, sf_dir))


@query(
    "cited_ranks",
    "X5",
    r"""SELECT DISTINCT session_id, pos, CAST(m AS BIGINT) AS cited FROM (SELECT session_id, pos, unnest(regexp_extract_all(answer, '(?i)\[source\s+(\d+)\]', 1)) AS m FROM v_turns)
WHERE CAST(m AS BIGINT) > 0""",
    ("v_turns",),
)
def cited_ranks(spark, sf_dir):
    return fx.turns(spark, sf_dir).select("session_id", "pos", F.explode(at.cited_ranks("answer")).alias("cited"))


@query(
    "used_sources",
    "X5 J5 W2 T4",
    f"WITH {USED} SELECT session_id, turn_pos, usage_key, pos, rank, chunk_id, relative_path, source_mode, use_pos FROM u",
    ("v_turns", "v_turn_sources"),
)
def used_sources(spark, sf_dir):
    return used(spark, sf_dir).select(
        "session_id", "turn_pos", "usage_key", F.col("pos").cast("int").alias("pos"), F.col("rank").cast("double").alias("rank"), "chunk_id", "relative_path", "source_mode", "use_pos"
    )


@query(
    "source_breakdown",
    "P11 A2 J5",
    f"""WITH {USED}, c AS (SELECT session_id, turn_pos, {FAMILY} AS label, count(*) AS n, min(use_pos) AS f FROM u GROUP BY ALL),
p AS (SELECT *, CAST(floor(n * 100.0 / sum(n) OVER (PARTITION BY session_id, turn_pos) + 0.5) AS BIGINT) AS percent FROM c)
SELECT session_id, turn_pos, label, n AS "count", percent, CAST(row_number() OVER (PARTITION BY session_id, turn_pos ORDER BY percent DESC, n DESC, f) AS INTEGER) AS rank FROM p""",
    ("v_turns", "v_turn_sources"),
)
def source_breakdown(spark, sf_dir):
    return at.source_breakdown(used(spark, sf_dir))


@query(
    "source_families",
    "P11",
    f"SELECT {FAMILY} AS family, count(*) AS sources FROM v_turn_sources GROUP BY ALL",
    ("v_turn_sources",),
)
def source_families(spark, sf_dir):
    s = at.complete_sources(fx.turn_sources(spark, sf_dir))
    return s.groupBy(at.source_family().alias("family")).agg(F.count(F.lit(1)).alias("sources"))


@query(
    "citation_cards",
    "P8 X6 T3",
    f"WITH {CARDS} SELECT * FROM cards",
    ("v_turns", "v_turn_sources"),
)
def citation_cards(spark, sf_dir):
    return at.citation_cards(used(spark, sf_dir)).select(
        "session_id", "turn_pos", "card_pos", "badge", "excerpt", "meta", "source_mode", "chunk_id", "source_path"
    )


@query(
    "card_files",
    "P9",
    f"WITH {CARDS} SELECT session_id, turn_pos, 'source-' || card_pos || '-' || source_path AS id, source_path AS name, CAST(0 AS DOUBLE) AS size FROM cards",
    ("v_turns", "v_turn_sources"),
)
def card_files(spark, sf_dir):
    return at.card_files(at.citation_cards(used(spark, sf_dir)))


@query(
    "files_with_sources",
    "U2 P9",
    f"""WITH {CARDS}, f AS (SELECT scope, id, trim(name) AS name, size FROM (SELECT *, row_number() OVER (PARTITION BY scope, id ORDER BY pos DESC) AS rn FROM v_file_changes) WHERE rn = 1),
x AS (SELECT DISTINCT t.scope, 'source-' || card_pos || '-' || source_path AS id, source_path AS name, CAST(0 AS DOUBLE) AS size
  FROM cards c JOIN v_turns t ON t.session_id = c.session_id AND t.pos = c.turn_pos)
SELECT * FROM f UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.scope = x.scope AND f.id = x.id)""",
    ("v_turns", "v_turn_sources", "v_file_changes"),
)
def files_with_sources(spark, sf_dir):
    from docketry.operators import records

    files = records.normalize_files(records.last_wins(fx.file_changes(spark, sf_dir), ["scope", "id"], "pos"))
    scopes = fx.turns(spark, sf_dir).select("scope", "session_id", F.col("pos").alias("turn_pos"))
    derived = at.card_files(at.citation_cards(used(spark, sf_dir))).join(scopes, at.TURN)
    return records.add_missing(
        files.select("scope", "id", "name", "size"), derived.select("scope", "id", "name", "size").distinct()
    )


@query(
    "source_modes",
    "J5 A2",
    f"""WITH {USED} SELECT source_mode, count(*) AS sources, count(DISTINCT concat(session_id, '-', turn_pos)) AS turns FROM u GROUP BY ALL""",
    ("v_turns", "v_turn_sources"),
)
def source_modes(spark, sf_dir):
    per_turn = used(spark, sf_dir).groupBy("source_mode", *at.TURN).agg(F.count(F.lit(1)).alias("n"))
    return per_turn.groupBy("source_mode").agg(F.sum("n").alias("sources"), F.count(F.lit(1)).alias("turns"))


@query(
    "public_source_chunks",
    "F6",
    """SELECT session_id, turn_pos, pos, chunk_id FROM (SELECT session_id, turn_pos, pos, CASE WHEN pos = 1 THEN ' workspace-' || coalesce(chunk_id, '') ELSE chunk_id END AS chunk_id FROM v_turn_sources)
WHERE trim(coalesce(chunk_id, '')) <> '' AND NOT starts_with(trim(chunk_id), 'workspace-')""",
    ("v_turn_sources",),
)
def public_source_chunks(spark, sf_dir):
    private = F.concat(F.lit(" workspace-"), F.coalesce("chunk_id", F.lit("")))
    s = fx.turn_sources(spark, sf_dir).withColumn("chunk_id", F.when(F.col("pos") == 1, private).otherwise(F.col("chunk_id")))
    return at.public_chunks(s).select("session_id", "turn_pos", "pos", "chunk_id")


@query(
    "article_mentions",
    "X6",
    r"""SELECT article, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(answer,
 '(?i)(\bArticle\s+(?:[A-Za-z]\.?\s*)?\d+[A-Za-z0-9.\-]*(?:\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|nonies|decies))?\b|\bArticle\b)', 1)) AS article FROM v_turns) GROUP BY ALL""",
    ("v_turns",),
)
def article_mentions(spark, sf_dir):
    m = at.article_mentions(fx.turns(spark, sf_dir), ["session_id", "pos"], "answer")
    return m.groupBy("article").agg(F.count(F.lit(1)).alias("mentions"))


@query(
    "canonical_paths",
    "X4",
    f"""SELECT session_id, pos, {norm_sql('source_path')} AS path_key, {norm_sql('meta')} AS meta_key FROM v_cards""",
    ("v_cards",),
)
def canonical_paths(spark, sf_dir):
    return fx.cards(spark, sf_dir).select(
        "session_id", "pos", canonical_path("source_path").alias("path_key"), canonical_path("meta").alias("meta_key")
    )


@query(
    "citation_links",
    "J1 X4",
    f"WITH {LINK} SELECT session_id, pos, score, doc_pos, doc_id FROM linked",
    ("v_cards", "v_catalog"),
)
def citation_links(spark, sf_dir):
    linked = linkage.link_citations(fx.cards(spark, sf_dir), fx.catalog(spark, sf_dir), ["session_id", "pos"])
    return linked.select("session_id", "pos", "score", "doc_pos", "doc_id")


@query(
    "citation_deep_links",
    "P13 J1",
    f"""WITH {LINK}, p AS (SELECT *, CAST(nullif(regexp_extract(meta, '(?i)\\b(?:p\\.|pp\\.)\\s*(\\d{{1,4}})', 1), '') AS INTEGER) AS page FROM linked)
SELECT session_id, pos, page, CASE WHEN doc_id IS NOT NULL THEN '{BASE_URL}/library/documents/' || doc_id || '/view' ||
  CASE WHEN page > 0 THEN '?page=' || page || '#page=' || page ELSE '' END END AS url FROM p""",
    ("v_cards", "v_catalog"),
)
def citation_deep_links(spark, sf_dir):
    linked = linkage.link_citations(fx.cards(spark, sf_dir), fx.catalog(spark, sf_dir), ["session_id", "pos"])
    return linkage.deep_links(linked, BASE_URL).select("session_id", "pos", "page", "url")


def chunk_requests(spark, sf_dir):
    """Requested chunk ids per session: one chunk of a document for every source."""
    s = fx.turn_sources(spark, sf_dir).where(F.col("chunk_id").isNotNull())
    return s.select(
        F.col("session_id").alias("request_id"),
        (F.col("turn_pos") * 10 + F.col("pos")).alias("pos"),
        F.concat("chunk_id", F.lit("-"), F.col("pos").cast("string")).alias("chunk_id"),
    )


REQUESTS = """rq AS (SELECT session_id AS request_id, turn_pos * 10 + pos AS pos, chunk_id || '-' || pos AS chunk_id FROM v_turn_sources WHERE chunk_id IS NOT NULL),
rf AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) AS rn FROM (SELECT request_id, chunk_id, min(pos) AS pos FROM rq GROUP BY ALL))"""


@query(
    "resolved_chunks",
    "J4 S5",
    f"""WITH {REQUESTS} SELECT rf.request_id, rf.pos, rf.chunk_id, c.page_start, length(c.text) AS chars
FROM rf LEFT JOIN v_chunks c ON c.chunk_id = rf.chunk_id WHERE rn <= 64""",
    ("v_turn_sources", "v_chunks"),
)
def resolved_chunks(spark, sf_dir):
    r = at.resolve_chunks(chunk_requests(spark, sf_dir), fx.chunks(spark, sf_dir).select("chunk_id", "page_start", "text"))
    return r.select("request_id", "pos", "chunk_id", "page_start", F.length("text").cast("bigint").alias("chars"))


@query(
    "chunk_resolution_report",
    "J4",
    f"""WITH {REQUESTS} SELECT rf.request_id, count(*) AS requested, count(c.chunk_id) AS resolved
FROM rf LEFT JOIN v_chunks c ON c.chunk_id = rf.chunk_id WHERE rn <= 64 GROUP BY ALL""",
    ("v_turn_sources", "v_chunks"),
)
def chunk_resolution_report(spark, sf_dir):
    r = at.resolve_chunks(chunk_requests(spark, sf_dir), fx.chunks(spark, sf_dir).select("chunk_id", "text"))
    return at.resolve_report(r)


@query(
    "missing_chunks",
    "J13 F6",
    """SELECT DISTINCT chunk_id FROM v_turn_sources WHERE chunk_id IS NOT NULL
AND chunk_id NOT IN (SELECT DISTINCT 'd' || (doc_id % 20) FROM documents)""",
    ("v_turn_sources",),
)
def missing_chunks(spark, sf_dir):
    cached = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), (F.col("doc_id") % 20).cast("string")).alias("chunk_id")
    ).distinct()
    return at.missing_chunks(fx.turn_sources(spark, sf_dir), cached)


@query(
    "card_chunks",
    "J11",
    f"""WITH {CARDS}, k AS (SELECT session_id, turn_pos, card_pos, CASE WHEN card_pos = 1 THEN 'workspace-' || chunk_id ELSE chunk_id || '-0' END AS chunk_id FROM cards)
SELECT session_id, turn_pos, card_pos, k.chunk_id, coalesce(starts_with(k.chunk_id, 'workspace-'), false) AS is_private, c.page_start
FROM k LEFT JOIN v_chunks c ON c.chunk_id = k.chunk_id""",
    ("v_turns", "v_turn_sources", "v_chunks"),
)
def card_chunks(spark, sf_dir):
    cards = at.citation_cards(used(spark, sf_dir)).select("session_id", "turn_pos", "card_pos", "chunk_id")
    cards = cards.withColumn(
        "chunk_id",
        F.when(F.col("card_pos") == 1, F.concat(F.lit("workspace-"), "chunk_id")).otherwise(F.concat("chunk_id", F.lit("-0"))),
    )
    return at.card_chunks(cards, fx.chunks(spark, sf_dir).select("chunk_id", "page_start"))


@query(
    "highlight_spans",
    "X14",
    """SELECT chunk_id, CAST(instr(lower(text), lower(needle)) AS INTEGER) AS hit_start,
  CAST(CASE WHEN instr(lower(text), lower(needle)) > 0 THEN length(needle) ELSE 0 END AS INTEGER) AS hit_length,
  CASE WHEN instr(lower(text), lower(needle)) > 0 THEN substring(text, instr(lower(text), lower(needle)), length(needle)) ELSE '' END AS hit
FROM (SELECT *, CASE WHEN length(hint) >= 6 THEN left(hint, 180) END AS needle FROM (
  SELECT chunk_id, text, trim(regexp_replace(substring(text, CAST(pos % 9 + 2 AS INTEGER), CAST(5 + doc_id % 8 AS INTEGER)), '\\s+', ' ', 'g')) AS hint FROM v_chunks))
WHERE needle IS NOT NULL""".replace("\\\\", "\\"),
    ("v_chunks",),
)
def highlight_spans(spark, sf_dir):
    c = fx.chunks(spark, sf_dir)
    hint = F.substring("text", (F.col("pos") % 9 + 2).cast("int"), (F.col("doc_id") % 8 + 5).cast("int"))
    hinted = c.withColumn("_hint", hint)
    h = at.highlight(hinted.where(at.highlight_needle("_hint").isNotNull()), "_hint")
    return h.select("chunk_id", "hit_start", "hit_length", "hit")


@query(
    "answer_source_report",
    "X5 J5 P8 X6 J1 P13",
    f"""WITH {CARDS},
d AS (SELECT doc_id, pos AS doc_pos, {norm_sql('relative_path')} AS p, {norm_sql('file_name')} AS f FROM v_catalog)
SELECT c.source_mode, {FAMILY} AS family, count(*) AS cards,
  count(*) FILTER (EXISTS (SELECT 1 FROM d WHERE contains({norm_sql('c.source_path')}, d.p) OR contains({norm_sql('c.source_path')}, d.f))) AS linked
FROM (SELECT *, source_path AS relative_path FROM cards) c GROUP BY ALL""",
    ("v_turns", "v_turn_sources", "v_catalog"),
)
def answer_source_report(spark, sf_dir):
    """The whole chain: used sources, cards, family, linked document."""
    cards = at.citation_cards(used(spark, sf_dir))
    linked = linkage.link_citations(cards, fx.catalog(spark, sf_dir), [*at.TURN, "card_pos"])
    fam = at.source_family()
    named = linked.withColumns({"relative_path": F.col("source_path"), "citation": F.lit(None).cast("string")})
    return named.withColumn("source_path", F.lit(None).cast("string")).groupBy("source_mode", fam.alias("family")).agg(
        F.count(F.lit(1)).alias("cards"), F.count("doc_id").alias("linked")
    )
