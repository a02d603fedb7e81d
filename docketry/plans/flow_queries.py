"""Registered queries over whole chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.operators import catalog, ingest, records, search, sessions
from docketry.operators.blocks import by_key
from docketry.plans import flows
from docketry.plans.catalog_queries import SEARCH, search_requests
from docketry.plans.registry import query
from docketry.plans.session_queries import FINAL, ROLLUP, W, consultations, turns_with_counts
from docketry.plans.source_queries import BASE_URL, USED
from docketry.plans.stream_queries import FOLD, _run_stream, as_stream, raw_packets
from docketry.plans.template_queries import CATALOG, RECON, builtin_templates, stored_templates, upload_parts
from docketry.session import shared_dir
from docketry.sources import fixtures as fx
from docketry.sources import logs
from docketry.streaming import fold, packets, sink


LOGGED = f"""r AS ({ROLLUP}), m AS (SELECT scope, session_id AS id, title, turn_count, CASE WHEN session_id % 2 = 0 THEN created_s - 500 ELSE created_s END AS created_s,
  CASE WHEN session_id % 4 = 0 THEN updated_s - 500 ELSE updated_s END AS updated_s FROM r),
kept AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY updated_s DESC, id) AS rn FROM m) WHERE rn <= 50)"""


def logged(spark, sf_dir):
    """Half of the sessions are stored already: a quarter unchanged, a quarter with an old title."""
    turns = turns_with_counts(spark, sf_dir)
    old = flows.session_records(turns).where(F.col("id") % 2 == 0)
    stale = F.when(F.col("id") % 4 == 2, "ancien titre").otherwise(F.col("title"))
    stored = old.withColumns({"title": stale, "created_s": F.col("created_s") - 500, "updated_s": F.col("updated_s") - 500})
    stored = stored.withColumn("fingerprint", sessions.fingerprint(*sink.COMPARED))
    return flows.session_log(turns, stored)


@query("session_log", "F2 A5 W6 W9 W1 W3 ST5", f"WITH {LOGGED} SELECT * FROM kept", ("v_turns", "v_turn_sources"))
def session_log(spark, sf_dir):
    return logged(spark, sf_dir).select("scope", "id", "title", "turn_count", "created_s", "updated_s")


@query(
    "session_log_turns",
    "A5 S10 W1 W3 X13",
    f"""WITH {LOGGED} SELECT v.scope, v.session_id, CAST(row_number() OVER (PARTITION BY v.session_id ORDER BY v.pos) - 1 AS BIGINT) AS pos,
  trim(v.question, {W}) AS question, v.answer, v.status FROM v_turns v JOIN kept ON kept.id = v.session_id WHERE {FINAL}""",
    ("v_turns", "v_turn_sources"),
)
def session_log_turns(spark, sf_dir):
    """The turns that the sessions kept in the log give back."""
    stored = logged(spark, sf_dir).withColumnRenamed("id", "session_id")
    return sessions.restore_turns(stored).select("scope", "session_id", "pos", "question", "answer", "status")


@query(
    "search_page",
    "P15 J3 F8 A8 P10 W8",
    f"""WITH {SEARCH.replace("CASE WHEN request_id % 5 = 2 THEN '11 — Droit du travail' ELSE '' END AS category", "CASE WHEN request_id % 5 = 2 THEN '11 — Droit du travail' ELSE '' END AS category, request_id % 3 + 1 AS asked")},
f AS (SELECT mm.request_id, mm.doc_id, k.pos, k.category, rq.asked, max(mm.score) AS best, count(*) AS chunks FROM mm JOIN v_catalog k ON k.doc_id = mm.doc_id JOIN rq ON rq.request_id = mm.request_id WHERE rq.category = '' OR rq.category = k.category GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY best DESC, chunks DESC, pos) AS rank, count(*) OVER (PARTITION BY request_id) AS total FROM f)
SELECT request_id, doc_id, rank, total, CASE WHEN contains(category, 'travail') THEN 'travail' WHEN contains(category, 'OHADA') THEN 'ohada' ELSE 'document' END AS theme
FROM n WHERE rank > (least(asked, greatest(1, CAST(ceil(total / 8.0) AS BIGINT))) - 1) * 8 AND rank <= least(asked, greatest(1, CAST(ceil(total / 8.0) AS BIGINT))) * 8""",
    ("v_chunks", "v_search_requests", "v_catalog"),
)
def search_page(spark, sf_dir):
    r = fx.search_requests(spark, sf_dir).withColumns(
        {
            "article": F.when(F.col("request_id") % 4 == 1, "An").otherwise(""),
            "category": F.when(F.col("request_id") % 5 == 2, "droit du TRAVAIL").otherwise(""),
            "page": (F.col("request_id") % 3 + 1).cast("bigint"),
        }
    )
    return flows.library_search(r, fx.chunks(spark, sf_dir), fx.catalog(spark, sf_dir)).select("request_id", "doc_id", "rank", "total", "theme")


@query(
    "linked_search",
    "X22 P15 F8 A8",
    f"""WITH {SEARCH} SELECT mm.request_id, mm.doc_id, CAST(max(mm.score) AS DOUBLE) AS search_score, count(*) AS matched_chunk_count
FROM mm JOIN v_catalog k ON k.doc_id = mm.doc_id JOIN rq ON rq.request_id = mm.request_id WHERE rq.category = '' OR rq.category = k.category GROUP BY ALL""",
    ("v_chunks", "v_search_requests", "v_catalog"),
)
def linked_search(spark, sf_dir):
    """From library links to results: what a link leaves out is no filter."""
    names = ("q", "keyword", "article", "category")
    link = F.concat(F.lit("https://library.example/bibliotheque"), catalog.build_query({n: F.col(n) for n in names}))
    links = search_requests(spark, sf_dir).select("request_id", link.alias("url"))
    found = search.search_documents(catalog.parse_search_urls(links), fx.chunks(spark, sf_dir), fx.catalog(spark, sf_dir))
    return found.select("request_id", "doc_id", "search_score", "matched_chunk_count")


@query(
    "draft_review",
    "X11 X12 J8 J9 X8",
    """WITH v AS (SELECT form_id, count(*) FILTER (required AND trim(coalesce(value, '')) = '') AS open FROM v_form_values GROUP BY form_id)
SELECT c_custkey AS form_id, 'p' AS kind, 'ACTE ' || c_name AS text FROM customer JOIN v ON form_id = c_custkey WHERE open = 0 AND c_custkey % 5 <> 0""",
    ("v_form_values",),
)
def draft_review(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    draft = F.concat(F.lit('{"answer":"{\\"document\\":\\"ACTE '), "c_name", F.lit('\\"}"}'))
    missing = F.lit('{"answer":"{\\"missing_items\\":[\\"Adresse\\"]}"}')
    bodies = c.select(F.col("c_custkey").alias("form_id"), F.when(F.col("c_custkey") % 5 == 0, missing).otherwise(draft).alias("body"))
    return flows.draft_review(fx.form_values(spark, sf_dir), bodies).documents.select("form_id", "kind", "text")


@query(
    "answer_links",
    "X5 J5 P8 J1 P13",
    f"""WITH linked AS (SELECT ts.* EXCLUDE (relative_path), k.relative_path, k.doc_id FROM v_turn_sources ts JOIN v_catalog k ON k.doc_id = (ts.session_id * 7 + ts.pos) % (SELECT count(*) FROM documents)),
{USED.replace("FROM v_turn_sources ts", "FROM linked ts")}
SELECT u.session_id, u.turn_pos, u.use_pos AS card_pos, u.source_mode, 120 AS score, k.doc_id FROM u JOIN v_catalog k ON k.relative_path = u.relative_path WHERE u.use_pos < 8""",
    ("v_turns", "v_turn_sources", "v_catalog"),
)
def answer_links(spark, sf_dir):
    """From answers to the documents behind their cards: used sources, cards, links."""
    c = fx.catalog(spark, sf_dir)
    n = c.agg(F.count(F.lit(1))).scalar()
    paths = c.select("doc_id", F.col("relative_path").alias("path"))
    s = fx.turn_sources(spark, sf_dir).withColumn("doc_id", (F.col("session_id") * 7 + F.col("pos")) % n).join(paths, "doc_id")
    s = s.withColumn("relative_path", F.col("path")).drop("path", "doc_id")
    found = flows.answer_sources(fx.turns(spark, sf_dir), s, c, BASE_URL)
    return found.links.select("session_id", "turn_pos", "card_pos", "source_mode", F.col("score").cast("int").alias("score"), "doc_id")


@query(
    "user_dashboard",
    "A1 T3 X20",
    f"""WITH c AS ({ROLLUP}), n AS (SELECT scope, count(*) AS total FROM c GROUP BY scope), f AS (SELECT scope, count(*) AS files FROM v_file_changes GROUP BY scope)
SELECT coalesce(n.scope, f.scope) AS scope, coalesce(total, 0) AS total, coalesce(files, 0) AS files, least(coalesce(total, 0), 8) AS recent FROM n FULL JOIN f ON f.scope = n.scope""",
    ("v_turns", "v_turn_sources", "v_file_changes"),
)
def user_dashboard(spark, sf_dir):
    files = records.normalize_files(fx.file_changes(spark, sf_dir))
    numbers, newest = flows.user_dashboard(consultations(spark, sf_dir), files, fx.table(spark, sf_dir, "documents"), 1704200000)
    shown = newest.groupBy("scope").agg(F.count(F.lit(1)).alias("recent"))
    return numbers.join(shown, "scope", "left").select("scope", "total", "files", F.coalesce("recent", F.lit(0)).cast("bigint").alias("recent"))


@query(
    "searched_templates",
    "P6 U1 F5 A3",
    f"""WITH {CATALOG} SELECT scope, id, CAST(row_number() OVER (PARTITION BY scope ORDER BY lower(category), category, lower(name), name, pos) AS INTEGER) AS rank
FROM tc WHERE domain = 'Commun' AND contains(lower(concat_ws(' ', name, description, domain, category, refs)), 'modele')""",
)
def searched_templates(spark, sf_dir):
    found = flows.template_catalog(builtin_templates(spark, sf_dir), stored_templates(spark, sf_dir), " Modele ", "Commun")
    return found.select("scope", "id", "rank")


@query("ingest_report", "S7 J7 A6", f"WITH {RECON} SELECT batch_id, pos, name, file_id, outcome FROM rs", ("v_upload_rows",))
def ingest_report(spark, sf_dir):
    """Nested responses as they are logged, with the files that were chosen."""
    files, uploaded, errors = upload_parts(spark, sf_dir)
    up = F.struct("pos", F.struct("id", F.col("chunk_count").cast("string").alias("chunk_count")).alias("x"))
    bad = F.struct("pos", F.struct("filename", "detail").alias("x"))
    listed = lambda items: F.transform(F.array_sort(F.collect_list(items)), lambda r: r["x"])
    n = files.count()
    a = by_key(uploaded, n, "batch_id").groupBy("batch_id").agg(listed(up).alias("uploaded"))
    b = by_key(errors, n, "batch_id").groupBy("batch_id").agg(listed(bad).alias("errors"))
    path = shared_dir(spark, "reports")
    a.join(b, "batch_id", "full_outer").write.json(path)
    return flows.ingest_report(logs.read_upload_responses(spark, path), files)[0]


@query(
    "streamed_answers",
    "S6 ST1 ST2 ST3",
    f"""WITH v AS (SELECT * EXCLUDE (m) FROM (SELECT *, max(seq) OVER (PARTITION BY stream_id) AS m FROM v_sse) WHERE seq < m AND seq % 10 NOT IN (7, 8, 9)),
{FOLD.replace("FROM v_sse", "FROM v").replace("v.* FROM v v", "v.* FROM v")} SELECT * FROM fo""",
    ("v_sse",),
)
def streamed_answers(spark, sf_dir):
    """From bodies that arrive in pieces to finished turns: one stream cuts packets, the next one folds them."""
    from docketry.operators.blocks import ordered_concat

    joined = ordered_concat(raw_packets(spark, sf_dir), ["stream_id"], "seq", "packet", "body", "\n\n")
    # bytes once for each body, not for each piece; a file for each core, so that no batch is read by one task
    raw, step, files = joined.select("stream_id", F.col("body").cast("binary").alias("raw")), F.lit(97), spark.sparkContext.defaultParallelism
    pieces = raw.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("raw") / step).cast("int") - 1)))
    pieces = pieces.select("stream_id", F.col("piece").cast("bigint").alias("piece"), F.substring("raw", F.col("piece") * step + 1, step).alias("body"))
    cut = packets.cut_pieces(as_stream(spark, pieces, 3, "stream_id", "piece", files=files))
    found = _run_stream(spark, cut, "append", "stream_id bigint, seq bigint, packet string").select("stream_id", "seq", "packet")
    updates = _run_stream(spark, flows.stream_turns(as_stream(spark, found, 3, "stream_id", "seq", files=files)), "update", fold.OUTPUT)
    turns = fold.close_open_turns(fold.latest_turns(updates)).where(F.col("last_seq") >= 0)
    return turns.select("stream_id", "answer", "reasoning", "status", "finish_reason", "last_seq")
