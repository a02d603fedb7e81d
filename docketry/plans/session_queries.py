"""Registered queries over turns, sessions and record logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.text import fold_catalog, text
from docketry.operators import dashboard, records, sessions
from docketry.plans.registry import query
from docketry.sources import fixtures as fx

# Blanks that occur in the test data, for TRIM in the check SQL.
W = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def squeeze_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[\\s\\x{{00A0}}]+', ' ', 'g'), {W})"


def title_sql(expr: str) -> str:
    line = squeeze_sql(expr)
    return (
        f"CASE WHEN {line} = '' THEN 'Discussion' WHEN length({line}) <= 96 THEN {line} "
        f"ELSE concat(rtrim(left({line}, 93), {W}), '...') END"
    )


FINAL = f"""status IN ('done','error') AND trim(question, {W}) <> '' AND trim(answer, {W}) <> ''"""

ROLLUP = f"""SELECT t.scope, t.session_id, {title_sql('f.question')} AS title, l.status, l.finish_reason, l.rag_note,
  CAST(coalesce(s.n, 0) AS BIGINT) AS source_count, t.turn_count, t.created_s, t.updated_s
FROM (SELECT scope, session_id, count(*) AS turn_count, min(ts_s) AS created_s, max(ts_s) AS updated_s,
        min(pos) AS first_pos, max(pos) AS last_pos FROM v_turns WHERE {FINAL} GROUP BY ALL) t
JOIN v_turns f ON f.session_id = t.session_id AND f.pos = t.first_pos
JOIN v_turns l ON l.session_id = t.session_id AND l.pos = t.last_pos
LEFT JOIN (SELECT v.session_id, count(*) AS n FROM v_turn_sources ts JOIN v_turns v
        ON v.session_id = ts.session_id AND v.pos = ts.turn_pos WHERE {FINAL} GROUP BY ALL) s ON s.session_id = t.session_id"""


def turns_with_counts(spark, sf_dir):
    """Turns with the number of their sources."""
    n = fx.turn_sources(spark, sf_dir).groupBy("session_id", F.col("turn_pos").alias("pos")).agg(
        F.count(F.lit(1)).alias("source_count")
    )
    return fx.turns(spark, sf_dir).join(n, ["session_id", "pos"], "left")


def consultations(spark, sf_dir):
    """Session records in the consultation shape."""
    return sessions.roll_up(turns_with_counts(spark, sf_dir))


@query("session_rollup", "F2 A5 W6 X3", ROLLUP, ("v_turns", "v_turn_sources"))
def session_rollup(spark, sf_dir):
    return consultations(spark, sf_dir).drop("digest")


@query(
    "dashboard_by_scope",
    "A1 F7 P1 P2",
    f"""WITH c AS ({ROLLUP}),
ca AS (SELECT scope, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS errors,
  sum(source_count) AS sources, count(*) FILTER (created_s >= 1704200000 - 604800) AS weekly FROM c GROUP BY scope),
fa AS (SELECT scope, count(*) AS files, round(sum(greatest(size, 0)), 2) AS bytes FROM v_file_changes GROUP BY scope)
SELECT coalesce(ca.scope, fa.scope) AS scope, coalesce(total, 0) AS total, coalesce(done, 0) AS done, coalesce(errors, 0) AS errors,
  CAST(coalesce(sources, 0) AS BIGINT) AS sources, coalesce(weekly, 0) AS weekly, coalesce(files, 0) AS files, coalesce(bytes, 0.0) AS bytes,
  CASE WHEN total > 0 THEN round(CAST(sources AS DOUBLE) / total, 1) ELSE 0.0 END AS avg_sources,
  CAST(CASE WHEN total > 0 THEN floor(100.0 * done / total + 0.5) ELSE 0 END AS BIGINT) AS success_percent,
  (SELECT count(*) FROM documents) AS library_documents
FROM ca FULL JOIN fa ON ca.scope = fa.scope""",
    ("v_turns", "v_turn_sources", "v_file_changes"),
)
def dashboard_by_scope(spark, sf_dir):
    files = records.normalize_files(fx.file_changes(spark, sf_dir))
    return dashboard.statistics(consultations(spark, sf_dir), files, fx.table(spark, sf_dir, "documents"), 1704200000)


@query(
    "recent_sessions",
    "T3 T1 X3",
    f"""WITH c AS ({ROLLUP}) SELECT scope, session_id, title, updated_s, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY scope ORDER BY updated_s DESC, session_id) AS INTEGER) AS rank FROM c) WHERE rank <= 8""",
    ("v_turns", "v_turn_sources"),
)
def recent_sessions(spark, sf_dir):
    return dashboard.recent(consultations(spark, sf_dir)).select("scope", "session_id", "title", "updated_s", "rank")


@query(
    "finalized_turns",
    "F2",
    f"SELECT scope, session_id, pos, status FROM v_turns WHERE {FINAL}",
    ("v_turns",),
)
def finalized_turns(spark, sf_dir):
    return sessions.finalized(fx.turns(spark, sf_dir)).select("scope", "session_id", "pos", "status")


@query(
    "answered_sessions",
    "F3",
    f"""SELECT scope, session_id, bool_or(trim(answer, {W}) <> '' OR status IN ('done','error')) AS has_response
FROM v_turns GROUP BY ALL""",
    ("v_turns",),
)
def answered_sessions(spark, sf_dir):
    return sessions.answered_sessions(fx.turns(spark, sf_dir))


@query(
    "draft_requests",
    "F9",
    """SELECT session_id, pos FROM (SELECT session_id, pos, CASE WHEN (session_id + pos) % 5 = 0
  THEN concat('Generer un modele d''Acte juridique: ', question) ELSE question END AS question FROM v_turns)
WHERE contains(lower(question), 'generer un modele d''acte juridique')""",
    ("v_turns",),
)
def draft_requests(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    marked = F.when(
        (F.col("session_id") + F.col("pos")) % 5 == 0, F.concat(F.lit("Generer un modele d'Acte juridique: "), "question")
    ).otherwise(F.col("question"))
    return sessions.draft_requests(t.withColumn("question", marked)).select("session_id", "pos")


@query(
    "answer_confidence",
    "P12",
    """SELECT level, percent, count(*) AS turns FROM (SELECT
  CASE WHEN contains(lower(rag_note), 'confidence=high') THEN 'high' WHEN contains(lower(rag_note), 'confidence=medium') THEN 'medium'
       WHEN contains(lower(rag_note), 'confidence=low') THEN 'low' ELSE 'none' END AS level,
  CASE WHEN contains(lower(rag_note), 'confidence=high') THEN 98 WHEN contains(lower(rag_note), 'confidence=medium') THEN 86
       WHEN contains(lower(rag_note), 'confidence=low') THEN 72 ELSE 60 END AS percent FROM v_turns) GROUP BY ALL""",
    ("v_turns",),
)
def answer_confidence(spark, sf_dir):
    level, percent = sessions.confidence("rag_note")
    return (
        fx.turns(spark, sf_dir)
        .select(level.alias("level"), percent.alias("percent"))
        .groupBy("level", "percent")
        .agg(F.count(F.lit(1)).alias("turns"))
    )


@query(
    "history_window",
    "W4",
    f"""SELECT scope, session_id, pos, coalesce(array_to_string(list(trim(question, {W})) OVER (PARTITION BY session_id ORDER BY pos
  ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '|'), '') AS history
FROM v_turns WHERE trim(question, {W}) <> ''""",
    ("v_turns",),
)
def history_window(spark, sf_dir):
    h = sessions.history(fx.turns(spark, sf_dir))
    return h.select("scope", "session_id", "pos", F.array_join("history", "|").alias("history"))


@query(
    "active_turn",
    "W7",
    f"""SELECT scope, session_id, pos, status FROM (SELECT t.*, row_number() OVER (PARTITION BY session_id
  ORDER BY CASE WHEN pos = (session_id % 4) * 2 THEN 0 ELSE 1 END, pos DESC) AS rn
  FROM v_turns t WHERE trim(question, {W}) <> '') WHERE rn = 1""",
    ("v_turns",),
)
def active_turn(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    picks = t.groupBy("scope", "session_id").agg(F.lit(None).alias("x")).select(
        "scope", "session_id", ((F.col("session_id") % 4) * 2).alias("selected_pos")
    )
    return sessions.active_turn(t, picks).select("scope", "session_id", "pos", "status")


@query(
    "consultation_titles",
    "X3",
    f"""SELECT session_id, pos, mode, CASE WHEN NOT starts_with(lower(question), 'session du') THEN {title_sql('question')}
  WHEN mode <> 'dashboard' AND stored THEN {title_sql("'Titre ' || q0")}
  ELSE {title_sql("regexp_replace(question, '^session du', 'Discussion', 'i')")} END AS title
FROM (SELECT session_id, pos, question AS q0, CASE WHEN pos % 4 = 0 THEN 'Session du ' || trim(question, {W}) ELSE trim(question, {W}) END AS question,
   (session_id % 2 = 0) AS stored FROM v_turns), (VALUES ('chat'), ('catalog'), ('dashboard')) AS m(mode)""",
    ("v_turns",),
)
def consultation_titles(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    question = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("Session du "), text("question"))).otherwise(text("question"))
    turn = F.struct(F.col("question"), F.lit("x").alias("answer"))
    stored = F.to_json(
        F.struct(F.lit(1).alias("version"), F.concat(F.lit("Titre "), "question").alias("title"), F.array(turn).alias("turns"))
    )
    answer = F.when(F.col("session_id") % 2 == 0, stored).otherwise(F.concat(F.lit("{"), stored))
    base = t.select("session_id", "pos", question.alias("question"), answer.alias("answer"))
    modes = ("chat", "catalog", "dashboard")
    titled = base.select(
        "session_id",
        "pos",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("mode"), sessions.consultation_title("question", "answer", m).alias("title"))
                    for m in modes
                ]
            )
        ).alias("x"),
    )
    return titled.select("session_id", "pos", "x.mode", "x.title")


@query(
    "changed_notes",
    "W9 ST5",
    """SELECT scope, seq, notes FROM (SELECT *, lag(notes) OVER (PARTITION BY scope ORDER BY seq) AS p FROM v_notes)
WHERE p IS NULL OR p <> notes""",
    ("v_notes",),
)
def changed_notes(spark, sf_dir):
    return sessions.changed_only(fx.note_changes(spark, sf_dir), ["scope"], "seq", ["notes"]).select("scope", "seq", "notes")


IDENTITIES = """si AS (SELECT user_id % 50 AS client, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'u' || (user_id % 4) END AS user_id, event_type || '@x' AS email, CASE WHEN event_id % 3 = 0 THEN 'a|b' ELSE 'a' END AS display_name,
  CASE WHEN event_id % 3 = 0 THEN 'c' ELSE 'b|c' END AS username FROM events)"""


@query(
    "changed_identities",
    "W9",
    f"""WITH {IDENTITIES}, s AS (SELECT * FROM si WHERE trim(user_id) <> ''),
l AS (SELECT *, lag({{'u': user_id, 'e': email, 'd': display_name, 'n': username}}) OVER (PARTITION BY client ORDER BY seq) AS p FROM s)
SELECT client, seq, user_id FROM l WHERE p IS NULL OR p.u <> user_id OR p.e <> email OR p.d <> display_name OR p.n <> username""",
)
def changed_identities(spark, sf_dir):
    k = F.col("event_id")
    log = fx.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("client"), k.alias("seq"), F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("user_id"),
        F.concat("event_type", F.lit("@x ")).alias("email"), F.when(k % 3 == 0, "a|b").otherwise("a").alias("display_name"), F.when(k % 3 == 0, "c").otherwise("b|c").alias("username"),
    )
    return sessions.changed_identities(log, ["client"], "seq").select("client", "seq", "user_id")


@query(
    "session_payload_restore",
    "S10 X13 P4",
    f"""SELECT scope, session_id, pos, question, answer, status, rag_note, finish_reason FROM (
 SELECT scope, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS BIGINT) AS pos, trim(question, {W}) AS question,
  answer, status, rag_note, finish_reason FROM v_turns WHERE {FINAL})""",
    ("v_turns",),
)
def session_payload_restore(spark, sf_dir):
    done = sessions.finalized(fx.turns(spark, sf_dir))
    titles = sessions.roll_up(fx.turns(spark, sf_dir))
    stored = sessions.session_payloads(done, titles)
    rows = stored.select(
        "scope",
        "session_id",
        F.col("title").alias("question"),
        F.col("payload").alias("answer"),
        F.lit("done").alias("status"),
        F.lit("").alias("rag_note"),
        F.lit("").alias("finish_reason"),
    )
    return sessions.restore_turns(rows).select(
        "scope", "session_id", F.col("pos").cast("bigint").alias("pos"), "question", "answer", "status", "rag_note", "finish_reason"
    )


@query(
    "session_segments_restore",
    "S10 X13",
    f"""SELECT scope, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos) - 1 AS BIGINT) AS pos, trim(question, {W}) AS question,
  answer, status, rag_note, finish_reason FROM v_turns WHERE {FINAL}""",
    ("v_turns",),
)
def session_segments_restore(spark, sf_dir):
    """Sessions stored in segments of four positions and restored from them."""
    pages = sessions.session_segments(sessions.finalized(fx.turns(spark, sf_dir)), 4)
    return sessions.restore_segments(pages).select("scope", "session_id", "pos", "question", "answer", "status", "rag_note", "finish_reason")


@query(
    "restored_plain_answers",
    "X13",
    f"""SELECT session_id, CASE WHEN trim(question, {W}) = '' THEN 'Question' ELSE trim(question, {W}) END AS question, trim(answer, {W}) AS answer,
  CASE WHEN status = 'error' THEN 'error' ELSE 'done' END AS status
FROM v_turns WHERE trim(question, {W}) <> '' OR trim(answer, {W}) <> ''""",
    ("v_turns",),
)
def restored_plain_answers(spark, sf_dir):
    return sessions.restore_turns(fx.turns(spark, sf_dir)).select("session_id", "question", "answer", "status")


@query(
    "typed_sources",
    "P4",
    """SELECT session_id, turn_pos, pos, CASE WHEN pos % 2 = 0 THEN CAST(rank AS DOUBLE) END AS rank,
  CASE WHEN pos % 3 = 0 THEN NULL ELSE chunk_id END AS chunk_id, relative_path FROM v_turn_sources WHERE pos <> 3""",
    ("v_turn_sources",),
)
def typed_sources(spark, sf_dir):
    """Sources written as loose JSON: a text rank, a numeric chunk id, a bare string among them."""
    s = fx.turn_sources(spark, sf_dir)
    rank = F.when(F.col("pos") % 2 == 0, F.col("rank").cast("string")).otherwise(F.concat(F.lit('"'), F.col("rank").cast("string"), F.lit('"')))
    chunk = F.when(F.col("pos") % 3 == 0, F.lit("12")).otherwise(F.concat(F.lit('"'), "chunk_id", F.lit('"')))
    body = F.concat(
        F.lit('{"rank":'), F.coalesce(rank, F.lit("null")), F.lit(',"chunk_id":'), F.coalesce(chunk, F.lit("null")),
        F.lit(',"relative_path":"'), "relative_path", F.lit('"}'),
    )
    item = F.when(F.col("pos") == 3, F.lit('"stray"')).otherwise(body)
    v = F.try_parse_json(F.concat(F.lit('{"s":['), item, F.lit("]}")))
    from docketry.functions.jsontext import members

    rows = s.select("session_id", "turn_pos", "pos", F.explode(sessions.typed_sources(members(v, "$.s"))).alias("x"))
    return rows.select("session_id", "turn_pos", "pos", "x.rank", "x.chunk_id", "x.relative_path")


@query(
    "folded_labels",
    "X1",
    """SELECT doc_id, trim(regexp_replace(lower(strip_accents(category || ' ' || title)), '[^a-z0-9]+', ' ', 'g')) AS catalog_key,
  trim(lower(strip_accents(doc_type || ' ' || title)), ' ' || chr(10)) AS label_key FROM v_catalog""",
    ("v_catalog",),
)
def folded_labels(spark, sf_dir):
    from docketry.functions.text import fold_label

    c = fx.catalog(spark, sf_dir)
    return c.select(
        "doc_id",
        fold_catalog(F.concat_ws(" ", "category", "title")).alias("catalog_key"),
        fold_label(F.concat_ws(" ", "doc_type", "title")).alias("label_key"),
    )


@query(
    "folded_labels_exact",
    "X1",
    """SELECT doc_id, trim(lower(strip_accents(category || ' ' || title)), ' ' || chr(10)) AS label_key FROM v_catalog""",
    ("v_catalog",),
)
def folded_labels_exact(spark, sf_dir):
    from docketry.functions.text import fold_exact

    c = fx.catalog(spark, sf_dir)
    return c.select("doc_id", fold_exact(F.concat_ws(" ", "category", "title")).alias("label_key"))
