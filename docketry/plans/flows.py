"""The chains users call: several operators in one lazy plan, tables in, tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import filled
from docketry.operators import attribution, catalog, dashboard, drafts, ingest, linkage, records, search, sessions, templates
from docketry.session import staged
from docketry.streaming import fold, packets, sink


@dataclass(frozen=True)
class AnswerSources:
    used: DataFrame
    cards: DataFrame
    breakdown: DataFrame
    links: DataFrame


def answer_sources(turns: DataFrame, sources: DataFrame, documents: DataFrame, base_url: str) -> AnswerSources:
    """Which sources each answer used, their cards, the family mix and links into the library."""
    used = attribution.used_sources(turns, sources)
    cards = attribution.citation_cards(used)
    linked = linkage.link_citations(cards, documents, [*attribution.TURN, "card_pos"])
    return AnswerSources(used, cards, attribution.source_breakdown(used), linkage.deep_links(linked, base_url))


def session_records(turns: DataFrame) -> DataFrame:
    """Session roll-ups in the shape of the stored log: ``question`` is the title, ``answer`` the whole session as JSON."""
    rows = sessions.roll_up(turns)
    payloads = sessions.session_payloads(sessions.finalized(turns), rows)
    stored = payloads.select("scope", "session_id", F.col("title").alias("question"), F.col("payload").alias("answer"))
    rows = rows.join(stored, ["scope", "session_id"]).withColumnRenamed("session_id", "id")
    return rows.withColumn("fingerprint", sessions.fingerprint(*sink.COMPARED))


def session_log(turns: DataFrame, stored: DataFrame, keep: int = records.KEEP_CONSULTATIONS) -> DataFrame:
    """The consultation log after these turns: changed sessions merged, newest kept per scope."""
    changes = sink.changed_records(session_records(turns), stored)
    return sink.merge(stored, changes.select(*stored.columns), keep)


def user_dashboard(consultations: DataFrame, files: DataFrame, documents: DataFrame, as_of_s: int) -> tuple[DataFrame, DataFrame]:
    """(numbers per scope, recent sessions per scope)."""
    numbers = dashboard.statistics(consultations, files, documents, as_of_s)
    return numbers.withColumn("volume", dashboard.volume("bytes")), dashboard.recent(consultations)


def library_search(requests: DataFrame, chunks: DataFrame, documents: DataFrame, size: int = catalog.PAGE_LIST, index: DataFrame | None = None) -> DataFrame:
    """Search results of one page per request, best first; loose category names are resolved first.

    Order: score, number of matched chunks, document position.

    ``requests``: request_id, page and any of the search filters. The cleaned requests and the
    matches are used several times each, so both are staged once.
    """
    if "category" in requests.columns:
        options = catalog.facet_values(documents, "category").select("value")
        names = catalog.resolve_labels(requests.select(F.col("category").alias("label")), options)
        known = names.select(F.col("label").alias("category"), F.nullif("category", F.lit(catalog.ALL)).alias("_known"))
        requests = requests.join(known, "category", "left").withColumn("category", F.col("_known")).drop("_known")
        requests = staged(requests, "requests")
    found = search.search_documents(requests, chunks, documents, index)
    placed = found.withColumn("theme", catalog.theme("category")).withColumnRenamed("doc_pos", "pos")
    placed = staged(placed, "matches")
    return catalog.page_rows(placed, requests.select("request_id", "page"), size, first=("search_score", "matched_chunk_count"))


def template_ingest(outputs: DataFrame) -> DataFrame:
    """Raw model bodies (request_id, prompt, body) to ready templates."""
    return templates.ingest(outputs)


def template_catalog(builtin: DataFrame, custom: DataFrame, query: str = "", domain: str = catalog.ANY, level: str = catalog.ANY) -> DataFrame:
    """Built-in and custom templates, filtered and ranked per scope."""
    rows = templates.union_templates(builtin, templates.as_catalog_row(custom))
    return templates.grouped(templates.filter_templates(rows, query, domain, level), ["scope"])


@dataclass(frozen=True)
class DraftReview:
    progress: DataFrame
    blocking: DataFrame
    documents: DataFrame


def draft_review(values: DataFrame, bodies: DataFrame) -> DraftReview:
    """Form progress, what blocks each draft, and the blocks of the drafts that are complete.

    ``values``: form_id, pos, label, required, value; ``bodies``: form_id, body.
    """
    parsed = drafts.parse_validation(drafts.chat_answers(bodies))
    items = parsed.select("form_id", F.posexplode("missing_items").alias("item_pos", "item"))
    blocking = drafts.blocking_items(items, values)
    open_forms = blocking.select("form_id").distinct()
    ready = parsed.where(filled("document").isNotNull()).join(open_forms, "form_id", "left_anti")
    return DraftReview(drafts.completeness(values), blocking, drafts.document_blocks(ready, ["form_id"], "document"))


def ingest_report(responses: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file outcomes, batch summary) of nested upload responses."""
    _, uploaded, errors = ingest.split_responses(responses)
    return ingest.upload_report(files, uploaded, errors)


def stream_turns(packets_in: DataFrame, ttl_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """A stream of packets (stream_id, seq, packet) to a stream of turn updates.

    Bodies that arrive in pieces pass ``packets.cut_pieces`` first, as a stream of its own: two stateful steps of which
    one gives updates cannot share a query.
    """
    return fold.fold_stream(packets.typed_events(packets.parse_packets(packets_in, keep_numbers=True)), ttl_ms, idle_ms)
