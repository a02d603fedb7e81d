"""Record tables derived from the shared test tables.

Each function turns the raw tables below one folder into one of the record shapes the operators
work on. They are only the input of the registered queries; the operators know nothing of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# positions of one line number of an upload batch
UPLOAD_BLOCK = 10_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores when the input is fewer files than cores.

    A file of one row group is read by one task. A large table has many files and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def n_documents(spark: SparkSession, sf_dir: str):
    """Number of documents, as a column: ids spread over all of them."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user question with the assistant answer that follows it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    key = F.col("conv_id") + F.col("turn")
    cited = F.when(key % 3 == 0, " [Source 1] et [source 3], Article 12 bis").otherwise("")
    rows = (
        table(spark, sf_dir, "conversations")
        .withColumn("_role", F.lead("role").over(w))
        .withColumn("_next", F.lead("text").over(w))
        .where(F.col("role") == "user")
    )
    answer = F.when(F.col("_role") == "assistant", F.concat("_next", cited)).otherwise("")
    return rows.select(
        (F.col("conv_id") % 10).alias("scope"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("pos"),
        F.col("text").alias("question"),
        answer.alias("answer"),
        F.when(answer == "", "streaming").when(F.col("conv_id") % 13 == 0, "error").otherwise("done").alias("status"),
        F.when(answer == "", "").otherwise("stop").alias("finish_reason"),
        F.when(key % 4 == 0, "confidence=high")
        .when(key % 4 == 1, "x Confidence=Medium y")
        .when(key % 4 == 2, "confidence=low")
        .otherwise("")
        .alias("rag_note"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("ts_s"),
    )


def turn_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to seven retrieved sources per turn."""
    t = turns(spark, sf_dir).select("session_id", F.col("pos").alias("turn_pos"))
    n = ((F.col("session_id") + F.col("turn_pos")) % 8).cast("int")
    s = t.where(n > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), n - 1)))
    return s.select(
        "session_id",
        "turn_pos",
        "pos",
        F.when(F.col("pos") % 5 != 4, F.col("pos") + 1).alias("rank"),
        F.when(F.col("pos") % 3 != 2, F.concat(F.lit("d"), ((F.col("session_id") * 7 + F.col("pos")) % n_documents(spark, sf_dir)).cast("string"))).alias("chunk_id"),
        F.when(F.col("pos") % 4 == 0, "Jurisprudence/Bulletin.pdf")
        .when(F.col("pos") % 4 == 1, "codes/Code du travail.pdf")
        .when(F.col("pos") % 4 == 2, "Revue de doctrine.pdf")
        .otherwise("divers/note.pdf")
        .alias("relative_path"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document library."""
    d = table(spark, sf_dir, "documents")
    file_name = F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return d.select(
        "doc_id",
        F.col("doc_id").cast("bigint").alias("pos"),
        F.when(F.col("lang") == "fr", "02 — Droit civil")
        .when(F.col("lang") == "en", "11 — Droit du travail")
        .when(F.col("lang") == "de", "06 — Droit pénal")
        .otherwise("04 — OHADA")
        .alias("category"),
        F.when(F.col("doc_id") % 3 == 0, "Code").when(F.col("doc_id") % 3 == 1, "Loi").otherwise("Arrêté").alias("doc_type"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        file_name.alias("file_name"),
        F.concat("lang", F.lit("/"), "source", F.lit("/"), file_name).alias("relative_path"),
        F.col("n_chars").alias("size"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One citation per turn that points to a document in one of several spellings."""
    t = turns(spark, sf_dir).select("session_id", "pos")
    c = catalog(spark, sf_dir).select("doc_id", "relative_path", "file_name")
    j = t.withColumn("doc_id", (F.col("session_id") * 31 + F.col("pos") * 7) % n_documents(spark, sf_dir)).join(c, "doc_id")
    k = (F.col("session_id") + F.col("pos")) % 7
    return j.select(
        "session_id",
        "pos",
        F.when(k == 0, F.col("relative_path"))
        .when(k == 1, F.concat(F.lit("C:\\data\\"), "relative_path"))
        .when(k == 2, F.concat(F.lit("voir "), "relative_path", F.lit(" p. 12")))
        .when(k == 3, F.col("file_name"))
        .when(k == 4, F.concat(F.lit("x/y/"), "file_name"))
        .alias("source_path"),
        F.when(k == 5, F.concat(F.lit("ref "), "file_name", F.lit(", pp. 3-4"))).otherwise("Base documentaire").alias("meta"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-empty lines of every document, three to a page."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.where(F.col("text") != "").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("pos").cast("string")).alias("chunk_id"),
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        (F.floor(F.col("pos") / 3) + 1).cast("int").alias("page_start"),
        "text",
    )


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("request_id"),
        F.split_part("text", F.lit(" "), F.lit(2)).alias("q"),
        F.split_part("text", F.lit(" "), F.lit(5)).alias("keyword"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token events, numbered within their stream."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("stream_id"),
        F.row_number().over(w).cast("bigint").alias("seq"),
        F.when(kind.isin("click", "view"), "token")
        .when(kind == "signup", "meta")
        .when(kind == "purchase", "reasoning")
        .when(F.col("event_id") % 40 == 0, "error")
        .when(F.col("event_id") % 40 == 20, "done")
        .otherwise("replace")
        .alias("event"),
        F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"), F.lit(" ")).alias("text"),
    )


def note_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scope"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("notes")
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("scope"),
        F.concat(F.lit("f"), (F.col("o_orderkey") % 4000).cast("string")).alias("id"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit(" File "), "o_orderpriority", F.lit(" ")).alias("name"),
        F.col("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("added_at"),
    )


def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a unique place per line: line numbers repeat inside an order
    place = (F.col("l_linenumber").cast("bigint") * UPLOAD_BLOCK) + F.col("l_partkey") * 100000 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        place.alias("pos"),
        F.concat(F.lit(" File_"), F.col("l_partkey").cast("string"), F.lit(".PDF")).alias("file_name"),
        (F.col("l_returnflag") == "R").alias("failed"),
        F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise(F.concat(F.lit("u"), F.col("l_suppkey").cast("string"))).alias("uploaded_id"),
        F.col("l_quantity").cast("int").alias("chunk_count"),
    )


def form_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(
        *[
            F.struct(F.lit(p).alias("pos"), F.lit(label).alias("label"), F.lit(req).alias("required"))
            for p, label, req in (
                (0, "Nom du bailleur", True),
                (1, "Adresse du bien", True),
                (2, "Durée du bail", True),
                (3, "Clauses particulières", False),
            )
        ]
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.inline(fields))
    k = F.col("c_custkey") + F.col("pos")
    return c.select(
        F.col("c_custkey").alias("form_id"),
        "pos",
        "label",
        "required",
        F.when(k % 4 == 0, "  ").when(k % 11 != 0, F.concat(F.lit(" "), "c_name")).alias("value"),
    )


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 6
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")).select(
        F.col("p_partkey").alias("request_id"),
        F.when(k == 0, F.concat(F.lit('{"name":"'), name, F.lit('","category":"'), "p_type", F.lit('"}')))
        .when(k == 1, F.concat(F.lit('Voici : ```json\n{"name":"'), name, F.lit('"}\n```')))
        .when(k == 2, F.concat(F.lit("{“name”:“"), name, F.lit("”}")))
        .when(k == 3, F.concat(F.lit('{"name":"'), name, F.lit('","legalRefs":["a",],}')))
        .when(k == 4, F.concat(F.lit("{'name': '"), name, F.lit("'}")))
        .otherwise(F.concat(F.lit("Contrat de "), name))
        .alias("answer"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_key"),
        F.when(F.col("c_custkey") % 9 == 0, "  ")
        .otherwise(F.concat(F.lit(" --"), "c_name", F.lit(" é#"), F.col("c_custkey").cast("string"), F.lit(".. ")))
        .alias("raw_id"),
        F.col("c_mktsegment").alias("display_name"),
    )


# --------------------------------------------------------------------------------------------
# The same tables for the independent SQL check.

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_turns": (
        (),
        """SELECT conv_id % 10 AS scope, conv_id AS session_id, turn AS pos, question, answer,
  CASE WHEN answer = '' THEN 'streaming' WHEN conv_id % 13 = 0 THEN 'error' ELSE 'done' END AS status,
  CASE WHEN answer = '' THEN '' ELSE 'stop' END AS finish_reason,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'confidence=high' WHEN 1 THEN 'x Confidence=Medium y'
       WHEN 2 THEN 'confidence=low' ELSE '' END AS rag_note,
  1704067200 + conv_id * 3600 + turn * 60 AS ts_s
FROM (SELECT conv_id, turn, role, text AS question,
        CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant'
             THEN concat(lead(text) OVER (PARTITION BY conv_id ORDER BY turn),
                  CASE WHEN (conv_id + turn) % 3 = 0 THEN ' [Source 1] et [source 3], Article 12 bis' ELSE '' END)
             ELSE '' END AS answer
      FROM conversations) t WHERE role = 'user'""",
    ),
    "v_turn_sources": (
        ("v_turns",),
        """SELECT t.session_id, t.pos AS turn_pos, s.n AS pos,
  CASE WHEN s.n % 5 = 4 THEN NULL ELSE s.n + 1 END AS rank,
  CASE WHEN s.n % 3 = 2 THEN NULL ELSE concat('d', cast((t.session_id * 7 + s.n) % (SELECT count(*) FROM documents) AS varchar)) END AS chunk_id,
  CASE s.n % 4 WHEN 0 THEN 'Jurisprudence/Bulletin.pdf' WHEN 1 THEN 'codes/Code du travail.pdf'
       WHEN 2 THEN 'Revue de doctrine.pdf' ELSE 'divers/note.pdf' END AS relative_path
FROM v_turns t JOIN (VALUES (0),(1),(2),(3),(4),(5),(6)) AS s(n) ON s.n < (t.session_id + t.pos) % 8""",
    ),
    "v_catalog": (
        (),
        """SELECT doc_id, CAST(doc_id AS bigint) AS pos,
  CASE lang WHEN 'fr' THEN '02 — Droit civil' WHEN 'en' THEN '11 — Droit du travail'
            WHEN 'de' THEN '06 — Droit pénal' ELSE '04 — OHADA' END AS category,
  CASE doc_id % 3 WHEN 0 THEN 'Code' WHEN 1 THEN 'Loi' ELSE 'Arrêté' END AS doc_type,
  string_split(text, chr(10))[1] AS title, concat('Doc_', cast(doc_id AS varchar), '.pdf') AS file_name,
  concat(lang, '/', source, '/Doc_', cast(doc_id AS varchar), '.pdf') AS relative_path, n_chars AS size
FROM documents""",
    ),
    "v_cards": (
        ("v_turns", "v_catalog"),
        r"""SELECT t.session_id, t.pos, CASE (t.session_id + t.pos) % 7 WHEN 0 THEN c.relative_path
   WHEN 1 THEN concat('C:\data\', c.relative_path) WHEN 2 THEN concat('voir ', c.relative_path, ' p. 12')
   WHEN 3 THEN c.file_name WHEN 4 THEN concat('x/y/', c.file_name) ELSE NULL END AS source_path,
  CASE (t.session_id + t.pos) % 7 WHEN 5 THEN concat('ref ', c.file_name, ', pp. 3-4') ELSE 'Base documentaire' END AS meta
FROM v_turns t JOIN v_catalog c ON c.doc_id = (t.session_id * 31 + t.pos * 7) % (SELECT count(*) FROM documents)""",
    ),
    "v_chunks": (
        (),
        """SELECT concat('d', cast(doc_id AS varchar), '-', cast(pos AS varchar)) AS chunk_id, doc_id, pos,
  CAST(pos // 3 + 1 AS integer) AS page_start, text
FROM (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS text
      FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE text <> ''""",
    ),
    "v_search_requests": (
        (),
        "SELECT item_id AS request_id, split_part(text, ' ', 2) AS q, split_part(text, ' ', 5) AS keyword FROM benchmark",
    ),
    "v_sse": (
        (),
        """SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  CASE WHEN event_type IN ('click','view') THEN 'token' WHEN event_type = 'signup' THEN 'meta'
       WHEN event_type = 'purchase' THEN 'reasoning' WHEN event_id % 40 = 0 THEN 'error'
       WHEN event_id % 40 = 20 THEN 'done' ELSE 'replace' END AS event,
  concat(event_type, ':', cast(event_id AS varchar), ' ') AS text FROM events""",
    ),
    "v_notes": ((), "SELECT user_id AS scope, ts, event_id AS seq, props AS notes FROM events"),
    "v_file_changes": (
        (),
        """SELECT o_custkey % 50 AS scope, concat('f', cast(o_orderkey % 4000 AS varchar)) AS id, o_orderkey AS pos,
  concat(' File ', o_orderpriority, ' ') AS name, o_totalprice AS size, o_orderdate AS added_at FROM orders""",
    ),
    "v_upload_rows": (
        (),
        """SELECT l_orderkey AS batch_id, CAST(l_linenumber AS bigint) * 10000000000000 + l_partkey * 100000 + l_suppkey AS pos, concat(' File_', cast(l_partkey AS varchar), '.PDF') AS file_name,
  l_returnflag = 'R' AS failed, CASE WHEN l_linenumber % 5 = 0 THEN ' ' ELSE concat('u', cast(l_suppkey AS varchar)) END AS uploaded_id,
  CAST(l_quantity AS int) AS chunk_count FROM lineitem""",
    ),
    "v_form_values": (
        (),
        """SELECT c_custkey AS form_id, f.pos AS pos, f.label AS label, f.required AS required,
  CASE WHEN (c_custkey + f.pos) % 4 = 0 THEN '  ' WHEN (c_custkey + f.pos) % 11 = 0 THEN NULL ELSE concat(' ', c_name) END AS value
FROM customer CROSS JOIN (VALUES (0,'Nom du bailleur',true),(1,'Adresse du bien',true),
  (2,'Durée du bail',true),(3,'Clauses particulières',false)) AS f(pos,label,required)""",
    ),
    "v_model_outputs": (
        (),
        """SELECT p_partkey AS request_id, CASE p_partkey % 6
   WHEN 0 THEN concat('{"name":"', p_name, '","category":"', p_type, '"}')
   WHEN 1 THEN concat('Voici : ```json', chr(10), '{"name":"', p_name, '"}', chr(10), '```')
   WHEN 2 THEN concat('{“name”:“', p_name, '”}') WHEN 3 THEN concat('{"name":"', p_name, '","legalRefs":["a",],}')
   WHEN 4 THEN concat('{''name'': ''', p_name, '''}') ELSE concat('Contrat de ', p_name) END AS answer FROM part""",
    ),
    "v_users": (
        (),
        """SELECT c_custkey AS user_key, CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE concat(' --', c_name, ' é#', cast(c_custkey AS varchar), '.. ') END AS raw_id,
  c_mktsegment AS display_name FROM customer""",
    ),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a check query with the definitions of the views it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in ordered)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
