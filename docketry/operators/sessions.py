"""Turns and sessions: roll-ups, titles, history windows, change detection, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.jsontext import kind, member, members, scalar_text, strict_json
from docketry.functions.text import filled, let, or_default, rstrip, squeeze, strip, text, truncate_title
from docketry.operators.blocks import lookback, ordered_concat

# Fixed values.
AUTO_PROMPT = (
    "Analyse le document joint et fournis une synthese juridique exploitable "
    "(resume, risques, points sensibles, recommandations)."
)
DRAFT_PHRASE = "generer un modele d'acte juridique"
HISTORY_TURNS = 6
PAPERCLIP = "\U0001f4ce"
CONFIDENCE = (("high", 98), ("medium", 86), ("low", 72))
CONFIDENCE_NONE = 60


def finalized(turns: DataFrame) -> DataFrame:
    """finished turns with a question and an answer."""
    done = F.col("status").isin("done", "error")
    return turns.where(done & (text("question") != "") & (text("answer") != ""))


def with_question(turns: DataFrame) -> DataFrame:
    """F3."""
    return turns.where(text("question") != "")


def answered_sessions(turns: DataFrame) -> DataFrame:
    """does the session have any response yet?"""
    responded = (text("answer") != "") | F.col("status").isin("done", "error")
    return turns.groupBy("scope", "session_id").agg(F.bool_or(responded).alias("has_response"))


def draft_requests(turns: DataFrame) -> DataFrame:
    """turns that ask for a document draft."""
    return turns.where(F.contains(F.lower("question"), F.lit(DRAFT_PHRASE)))


def confidence(note) -> tuple[Column, Column]:
    """(level, percent) from the retrieval note."""
    lowered = F.lower(F.coalesce(F.col(note) if isinstance(note, str) else note, F.lit("")))
    level, percent = F.lit("none"), F.lit(CONFIDENCE_NONE)
    for name, value in reversed(CONFIDENCE):
        hit = F.contains(lowered, F.lit(f"confidence={name}"))
        level, percent = F.when(hit, name).otherwise(level), F.when(hit, value).otherwise(percent)
    return level, percent


def first_attachment(display) -> Column:
    """The first attached file named in a display question; blank when there is none."""
    lines = F.transform(F.split(F.coalesce(display, F.lit("")), "\n"), strip)
    line = F.get(F.filter(lines, lambda x: x.startswith(PAPERCLIP)), F.lit(0))
    names = strip(F.substr(line, F.lit(2)))
    return F.coalesce(strip(F.split_part(F.split_part(names, F.lit(","), F.lit(1)), F.lit("+"), F.lit(1))), F.lit(""))


def session_title(question: Column, display: Column) -> Column:
    """Title from the first turn."""
    q = squeeze(F.coalesce(question, F.lit("")))
    shown = text(display)
    attached = first_attachment(shown)
    first_line = strip(F.split_part(shown, F.lit("\n"), F.lit(1)))
    return (
        F.when((q != "") & (F.lower(q) != AUTO_PROMPT.lower()), truncate_title(q))
        .when((q != "") & (attached != ""), truncate_title(attached))
        .when(q != "", "Document joint")
        .when(first_line != "", truncate_title(first_line))
        .otherwise("Discussion")
    )


def _optional(df: DataFrame, name: str, kind_: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind_)


def roll_up(turns: DataFrame) -> DataFrame:
    """A5: one row per session from its finished turns.

    Everything is a combinable aggregate. ``digest`` is 128 bits over all turn contents with their
    positions; together with the other columns it says whether a session changed.
    """
    t = finalized(turns)
    content = [
        F.coalesce(_optional(t, c).cast("string"), F.lit(""))
        for c in ("id", "question", "display_question", "answer", "reasoning", "status", "rag_note", "finish_reason")
    ]
    sources = F.coalesce(_optional(t, "source_count", "bigint"), F.lit(0))
    agg = t.groupBy("scope", "session_id").agg(
        F.min_by(F.struct(F.col("question"), _optional(t, "display_question").alias("display")), "pos").alias("_first"),
        F.max_by(F.struct("status", "finish_reason", "rag_note"), "pos").alias("_last"),
        F.sum(sources).cast("bigint").alias("source_count"),
        F.count(F.lit(1)).alias("turn_count"),
        F.min("ts_s").alias("created_s"),
        F.max("ts_s").alias("updated_s"),
        F.concat_ws(
            ".",
            F.bit_xor(F.xxhash64("pos", *content)).cast("string"),
            F.bit_xor(F.xxhash64(F.lit("turn"), *content, "pos")).cast("string"),
        ).alias("digest"),
    )
    last = F.col("_last")
    return agg.select(
        "scope",
        "session_id",
        session_title(F.col("_first")["question"], F.col("_first")["display"]).alias("title"),
        F.when(last["status"] == "error", "error").otherwise("done").alias("status"),
        last["finish_reason"].alias("finish_reason"),
        last["rag_note"].alias("rag_note"),
        "source_count",
        "turn_count",
        "created_s",
        "updated_s",
        "digest",
    )


def fingerprint(*cols) -> Column:
    """One key over several columns; NULL counts as blank. A JSON list keeps the borders between the values."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])), 256)


#: Positions of a stored segment.
SEGMENT = 4096
IDENTITY = ["user_id", "email", "display_name", "username"]


def changed_only(log: DataFrame, keys: list[str], pos: str, columns: list[str]) -> DataFrame:
    """Rows of a log whose content differs from the row before of the same key."""
    marked = log.withColumn("_fp", fingerprint(*columns))
    seen = lookback(marked, keys, pos, "_fp", 1, "_prev")
    return seen.where(~F.coalesce(F.get("_prev", F.lit(0)) == F.col("_fp"), F.lit(False))).drop("_fp", "_prev")


def changed_identities(log: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """W9, identity form: rows of a sign-in log to register again, for one of four fields differs from the row before.

    A row without a user is not registered and does not count as the row before.
    """
    signed_in = log.where(filled("user_id").isNotNull())
    return changed_only(signed_in.withColumns({c: text(c) for c in IDENTITY}), keys, pos, IDENTITY)


def history(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The up to ``n`` earlier questions of the session, oldest first, for every question."""
    asked = with_question(turns).withColumn("_q", text("question"))
    return lookback(asked, ["scope", "session_id"], "pos", "_q", n, "history").drop("_q")


def active_turn(turns: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The selected turn of every session if it still exists, else the last one with a question."""
    asked = with_question(turns)
    if selected is not None:
        picks = selected.select("scope", "session_id", F.col("selected_pos"))
        asked = asked.join(picks, ["scope", "session_id"], "left")
        is_pick = F.coalesce(F.col("pos") == F.col("selected_pos"), F.lit(False))
    else:
        is_pick = F.lit(False)
    rest = [c for c in turns.columns if c not in ("scope", "session_id")]
    best = asked.groupBy("scope", "session_id").agg(
        F.max_by(F.struct(*rest), F.struct(is_pick.alias("a"), F.col("pos").alias("b"))).alias("_t")
    )
    return best.select("scope", "session_id", *[F.col("_t")[c].alias(c) for c in rest])


# --------------------------------------------------------------------------------------------
# Titles (X3)


def is_session_label(c: Column) -> Column:
    return F.startswith(F.lower(c), F.lit("session du"))


def relabel(c: Column) -> Column:
    return F.when(is_session_label(c), F.concat(F.lit("Discussion"), F.substr(c, F.lit(len("session du") + 1)))).otherwise(c)


def consultation_title(question, answer=None, mode: str = "catalog") -> Column:
    """``chat`` wants a valid stored session, ``catalog`` any JSON title, ``dashboard`` none."""
    direct = text(question)
    own = (direct != "") & ~is_session_label(direct)
    if mode == "dashboard":
        line = squeeze(direct)
        label = F.when(is_session_label(line), strip(relabel(line))).otherwise(line)
        cut = F.concat(rstrip(F.left(label, F.lit(93))), F.lit("..."))
        return F.when(line == "", "Discussion").when(F.length(label) > 96, cut).otherwise(label)

    def stored_title(v):
        title = strip(scalar_text(v, "$.title"))
        if mode == "chat":
            return F.when(F.size(restorable(v)) > 0, truncate_title(title))
        return let(title, lambda t: F.when(t != "", truncate_title(t)))

    from_payload = let(
        text(answer), lambda a: F.when(a.startswith("{"), let(strict_json(a), stored_title))
    )
    return (
        F.when(own, truncate_title(direct))
        .otherwise(F.coalesce(from_payload, F.when(direct != "", truncate_title(relabel(direct))), F.lit("Discussion")))
    )


# --------------------------------------------------------------------------------------------
# Stored payloads


def typed_sources(items: Column) -> Column:
    """Sources with typed members; a member of the wrong type is NULL, non-objects are dropped."""

    def number(x, name):
        return F.when(kind(member(x, f"$.{name}")) == "number", F.try_variant_get(x, f"$.{name}", "double")).alias(name)

    def string(x, name):
        return F.when(kind(member(x, f"$.{name}")) == "string", F.try_variant_get(x, f"$.{name}", "string")).alias(name)

    objects = F.filter(items, lambda x: kind(x).isin("object", "array"))
    return F.transform(
        objects,
        lambda x: F.struct(
            number(x, "rank"),
            number(x, "score"),
            string(x, "chunk_id"),
            string(x, "citation"),
            string(x, "relative_path"),
            string(x, "source_path"),
            number(x, "page_start"),
            number(x, "page_end"),
            string(x, "article_hint"),
        ),
    )


def stored_status(c: Column) -> Column:
    return F.when(c.isin("error", "streaming"), c).otherwise("done")


def _stored_turn(turns: DataFrame) -> Column:
    """A turn as it is stored."""
    blank = F.lit("")
    empty = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(_optional(turns, "id").cast("string"), F.concat(F.lit("turn-"), F.col("pos").cast("string"))).alias("id"),
        F.coalesce("question", blank).alias("question"),
        F.nullif(_optional(turns, "display_question"), blank).alias("displayQuestion"),
        F.coalesce("answer", blank).alias("answer"),
        F.coalesce(_optional(turns, "reasoning"), blank).alias("reasoning"),
        stored_status(F.col("status")).alias("status"),
        (F.col("rag_sources") if "rag_sources" in turns.columns else empty).alias("ragSources"),
        F.coalesce("rag_note", blank).alias("ragNote"),
        F.coalesce("finish_reason", blank).alias("finishReason"),
    )


def session_payloads(turns: DataFrame, titles: DataFrame) -> DataFrame:
    """The stored JSON of a session, exactly one document each.

    Turns become JSON where they are and are joined block by block; only the finished document,
    which is one value of the result, is ever whole in a task. A document must stay below 2 GB, Spark's limit
    for a value; ``session_segments`` has no such limit.
    """
    keys = ["scope", "session_id"]
    listed = ordered_concat(turns.select(*keys, "pos", F.to_json(_stored_turn(turns)).alias("_turn")), keys, "pos", "_turn", "_turns", ",")
    return listed.join(_heads(titles), keys).select(
        *keys, "title", F.concat("_head", F.lit(',"turns":['), "_turns", F.lit("]}")).alias("payload")
    )


def _heads(titles: DataFrame) -> DataFrame:
    """Title of each session, and what stands before the turns of its document."""
    head = F.to_json(F.struct(F.lit(1).alias("version"), truncate_title("title").alias("title")))
    return titles.select("scope", "session_id", "title", F.left(head, F.length(head) - 1).alias("_head"))


def session_segments(turns: DataFrame, block: int = SEGMENT) -> DataFrame:
    """S10 in pages: the turns of a session as JSON lists of at most ``block`` positions each.

    scope, session_id, segment, first_turn (turns before it), start (bytes of the turns before it, commas between), body.
    A session of any length is as many rows as it needs; no task holds more than one of them.
    """
    keys = ["scope", "session_id"]
    rows = turns.select(*keys, "pos", F.to_json(_stored_turn(turns)).alias("_turn"), F.floor(F.col("pos") / block).cast("bigint").alias("segment"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_turn"))), lambda t: t["_turn"])
    pages = rows.groupBy(*keys, "segment").agg(F.array_join(listed, ",").alias("_turns"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return pages.select(
        *keys,
        "segment",
        F.coalesce(F.sum("_n").over(before), zero).alias("first_turn"),
        F.coalesce(F.sum(F.octet_length("_turns") + 1).over(before), zero).alias("start"),
        F.concat(F.lit("["), "_turns", F.lit("]")).alias("body"),
    )


def export_segments(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """The one document of a session, joined from its segments only here."""
    keys = ["scope", "session_id"]
    inner = segments.select(*keys, "segment", F.substr("body", F.lit(2), F.length("body") - 2).alias("_turns"))
    listed = ordered_concat(inner, keys, "segment", "_turns", "_all", ",")
    return listed.join(_heads(titles), keys).select(*keys, "title", F.concat("_head", F.lit(',"turns":['), "_all", F.lit("]}")).alias("payload"))


def restore_segments(segments: DataFrame) -> DataFrame:
    """X13 from segments: the same turns as from the one document, without ever building it."""
    items = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    rows = segments.select("scope", "session_id", "first_turn", F.posexplode(items).alias("_i", "t"))
    usable = (strip(scalar_text(F.col("t"), "$.question")) != "") | (strip(scalar_text(F.col("t"), "$.answer")) != "")
    return _restored(rows.where(usable).withColumn("index", F.col("first_turn") + F.col("_i")), ["scope", "session_id"])


def restorable(v: Column) -> Column:
    """Stored turns with a question or an answer, with their list position; empty when unusable."""
    good = (F.try_variant_get(v, "$.version", "double") == 1) & (kind(member(v, "$.version")) == "number")
    rows = F.transform(
        F.when(good, members(v, "$.turns")),
        lambda t, i: F.struct(
            i.alias("index"),
            F.when(kind(t).isin("object", "array"), t).alias("t"),
        ),
    )
    return F.filter(
        F.coalesce(rows, F.array().cast("array<struct<index:int,t:variant>>")),
        lambda r: r["t"].isNotNull()
        & ((strip(scalar_text(r["t"], "$.question")) != "") | (strip(scalar_text(r["t"], "$.answer")) != "")),
    )


def _restored(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Turn rows from stored turns ``t`` at ``index``."""
    t = F.col("t")
    return rows.select(
        *keys,
        F.col("index").cast("bigint").alias("pos"),
        or_default(scalar_text(t, "$.id"), F.concat(F.lit("turn-restored-"), (F.col("index") + 1).cast("string"))).alias("id"),
        strip(scalar_text(t, "$.question")).alias("question"),
        filled(scalar_text(t, "$.displayQuestion")).alias("display_question"),
        scalar_text(t, "$.answer").alias("answer"),
        scalar_text(t, "$.reasoning").alias("reasoning"),
        stored_status(scalar_text(t, "$.status")).alias("status"),
        typed_sources(members(t, "$.ragSources")).alias("rag_sources"),
        scalar_text(t, "$.ragNote").alias("rag_note"),
        scalar_text(t, "$.finishReason").alias("finish_reason"),
    )


def restore_turns(records: DataFrame) -> DataFrame:
    """Turn rows from stored records; text that is no session becomes one turn.

    Input: scope, session_id, question, answer, status, rag_note, finish_reason.
    """
    stored = text("answer")
    parsed = records.withColumn("_v", F.when(stored.startswith("{"), strict_json(stored))).withColumn("_rows", restorable(F.col("_v")))
    keys = ["scope", "session_id"]
    exploded = parsed.where(F.size("_rows") > 0).select(*keys, F.inline("_rows"))
    restored = _restored(exploded, keys)
    plain = parsed.where((F.size("_rows") == 0) & ((text("question") != "") | (stored != ""))).select(
        *keys,
        F.lit(0).cast("bigint").alias("pos"),
        F.concat(F.lit("turn-restored-"), F.col("session_id").cast("string")).alias("id"),
        or_default("question", "Question").alias("question"),
        or_default("question", "Question").alias("display_question"),
        stored.alias("answer"),
        F.lit("").alias("reasoning"),
        F.when(F.col("status") == "error", "error").otherwise("done").alias("status"),
        F.array().cast(restored.schema["rag_sources"].dataType).alias("rag_sources"),
        F.coalesce("rag_note", F.lit("")).alias("rag_note"),
        F.coalesce("finish_reason", F.lit("")).alias("finish_reason"),
    )
    return restored.unionByName(plain)
