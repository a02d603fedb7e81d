"""Source paths and deep links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import WS, decode_component, encode_component, strip, strip_accents, text

# Folder names of the document store; a path counts from behind them.
STORE_MARKERS = ("droit donnees/", "legal-documents/")
QUOTES = "\"'`"


def canonical_path(c) -> Column:
    """One spelling per stored path: decoded, folded, forward slashes, no drive, no store root."""
    raw = text(c)
    folded = strip_accents(decode_component(raw))
    slashes = F.lower(F.translate(folded, "\\" + QUOTES, "/"))
    no_drive = F.regexp_replace(slashes, "^[a-z]:", "")
    tidy = F.regexp_replace(F.regexp_replace(no_drive, "/+", "/"), "^/+", "")
    for marker in STORE_MARKERS:
        tidy = F.regexp_replace(tidy, f"(?s)^.*?{marker}", "")
    return strip(tidy)


def page_in_text(c) -> Column:
    """Page number behind ``p.`` or ``pp.``; NULL when there is none or it is 0."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    n = F.regexp_extract(c, rf"(?i)\b(?:p\.|pp\.)[{WS}]*(\d{{1,4}})", 1)
    page = F.nullif(n, F.lit("")).cast("int")
    return F.when(page > 0, page)


def view_url(base: str, document_id, page=None) -> Column:
    """Link to a document, opened at a page when one is known."""
    doc = F.col(document_id) if isinstance(document_id, str) else document_id
    url = F.concat(F.lit(base.rstrip("/") + "/library/documents/"), encode_component(doc.cast("string")), F.lit("/view"))
    if page is None:
        return url
    p = F.floor(page).cast("string")
    return F.when(page > 0, F.concat(url, F.lit("?page="), p, F.lit("#page="), p)).otherwise(url)


def download_url(base: str, document_id) -> Column:
    doc = F.col(document_id) if isinstance(document_id, str) else document_id
    return F.concat(F.lit(base.rstrip("/") + "/library/documents/"), encode_component(doc.cast("string")), F.lit("/download"))
