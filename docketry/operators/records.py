"""Record tables: normalise, upsert, de-duplicate, retain, delete.

A record table has a ``scope`` (the user it belongs to) and an ``id``; order inside a scope is an
explicit ``pos``. Winners are picked by hash or sort aggregates with map-side combine, caps by
limited windows that Spark cuts before the shuffle, so a scope with very many rows stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import filled, header_text, or_default, scope_of, strip, text, user_key

# Rows kept per scope, and the texts a template gets where it has none.
KEEP_CONSULTATIONS = 50
KEEP_FILES = 50
KEEP_TEMPLATES = 200
TEMPLATE_CATEGORY = "Modeles personnalises"
TEMPLATE_DOMAIN = "Personnalise"
TEMPLATE_BRANCH = "Document juridique"
TEMPLATE_WARNING = "Verifier la conformite du modele avec le droit senegalais avant utilisation."
FIELD_TYPES = ("textarea", "date", "number", "select")


def count_or_zero(c: str) -> Column:
    """A finite, non-negative number; anything else is 0."""
    n = F.col(c).cast("double")
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(n, F.lit(0.0)))


def valid_ids(df: DataFrame, need_text: bool = False) -> DataFrame:
    """rows with an id; with ``need_text`` (the write path) the id must not be blank."""
    ok = F.col("id").isNotNull()
    if need_text:
        ok = ok & (strip("id") != "")
    return df.where(ok)


def normalize_consultations(df: DataFrame, now) -> DataFrame:
    """P1. ``now`` is the time of the job, a literal."""
    return df.withColumns(
        {
            "question": text("question"),
            "answer": text("answer"),
            "status": F.when(F.col("status") == "error", "error").otherwise("done"),
            "finish_reason": F.coalesce("finish_reason", F.lit("")),
            "rag_note": F.coalesce("rag_note", F.lit("")),
            "source_count": count_or_zero("source_count").cast("bigint"),
            "created_at": F.coalesce(F.col("created_at"), F.lit(now)),
            "updated_at": F.coalesce(F.col("updated_at"), F.lit(now)),
        }
    )


def normalize_files(df: DataFrame, now=None) -> DataFrame:
    """P2."""
    out = df.withColumns({"name": text("name"), "size": count_or_zero("size")})
    return out if now is None else out.withColumn("added_at", F.coalesce(F.col("added_at"), F.lit(now)))


def string_list(c) -> Column:
    """Stripped, non-blank entries; NULL is the empty list."""
    stripped = F.transform(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), text)
    return F.filter(stripped, lambda x: x != "")


def field_type(c: Column) -> Column:
    lowered = F.lower(text(c))
    return F.when(lowered.isin(*FIELD_TYPES), lowered).otherwise("text")


def complexity(c) -> Column:
    lowered = F.lower(text(c))
    return F.when(lowered == "avance", "Avance").when(lowered == "intermediaire", "Intermediaire").otherwise("Simple")


def options_of(field: Column) -> Column:
    """Options of a select field: blank values dropped, labels default to the value; NULL when none."""
    cleaned = F.filter(
        F.transform(
            F.coalesce(field["options"], F.array().cast("array<struct<value:string,label:string>>")),
            lambda o: F.struct(text(o["value"]).alias("value"), or_default(o["label"], text(o["value"])).alias("label")),
        ),
        lambda o: o["value"] != "",
    )
    return F.when((field_type(field["type"]) == "select") & (F.size(cleaned) > 0), cleaned)


def clean_field(field: Column, key: Column | None = None) -> Column:
    return F.struct(
        (text(field["key"]) if key is None else key).alias("key"),
        text(field["label"]).alias("label"),
        F.coalesce(field["required"], F.lit(False)).alias("required"),
        filled(field["placeholder"]).alias("placeholder"),
        field_type(field["type"]).alias("type"),
        options_of(field).alias("options"),
        filled(field["hint"]).alias("hint"),
    )


def normalize_templates(df: DataFrame, now=None) -> DataFrame:
    """P3, nested fields included; rows without id or name are dropped."""
    fields = F.filter(
        F.transform(F.filter("fields", lambda f: f.isNotNull()), lambda f: clean_field(f)),
        lambda f: (f["key"] != "") & (f["label"] != ""),
    )
    out = df.withColumns(
        {
            "id": text("id"),
            "name": text("name"),
            "category": or_default("category", TEMPLATE_CATEGORY),
            "domain": or_default("domain", TEMPLATE_DOMAIN),
            "branch": or_default("branch", TEMPLATE_BRANCH),
            "complexity": complexity("complexity"),
            "description": text("description"),
            "legal_refs": string_list("legal_refs"),
            "required_fields": string_list("required_fields"),
            "optional_fields": string_list("optional_fields"),
            "sections": string_list("sections"),
            "warning": or_default("warning", TEMPLATE_WARNING),
            "fields": F.coalesce(fields, F.array().cast(df.schema["fields"].dataType)),
        }
    ).where((F.col("id") != "") & (F.col("name") != ""))
    if now is None:
        return out
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(now)) for c in ("created_at", "updated_at")})


def normalize_users(df: DataFrame, user_id: str = "user_id", base_key: str = "records") -> DataFrame:
    """P5: identity key, bounded header texts, storage scope and scoped storage key."""
    out = df.withColumns({"scope": scope_of(user_id), user_id: user_key(user_id)})
    headers = [c for c in ("email", "display_name", "username") if c in df.columns]
    out = out.withColumns({c: header_text(c) for c in headers})
    suffix = F.concat(F.lit(base_key + "__"), "scope")
    return out.withColumn("storage_key", F.when(F.col("scope") == "anon", base_key).otherwise(suffix))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last value of every key at the position where the key first appeared.

    One aggregate, combined on the map side; no sort of whole groups.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    winner = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("_w") if rest else F.lit(None).alias("_w"),
        F.min(order).alias(order),
    )
    return winner.select(*keys, order, *[F.col("_w")[c].alias(c) for c in rest])


def upsert(current: DataFrame, changes: DataFrame, version: str, created: str = "created_at") -> DataFrame:
    """Apply keyed changes to the current rows of every scope.

    An existing key keeps its place and its creation time; a new key goes to the front, the newest
    first. ``current`` carries ``pos`` (its list order), ``changes`` carries ``version``. The result
    carries ``place``, an ordering value inside the scope (smaller is nearer to the front).
    """
    rest = [c for c in current.columns if c not in ("scope", "id", "pos", created)]
    old = current.select(
        "scope", "id", created, *rest, F.lit(0).alias("_new"), F.col("pos").cast("bigint").alias("_at")
    )
    new = changes.select(
        "scope", "id", created, *rest, F.lit(1).alias("_new"), F.col(version).cast("bigint").alias("_at")
    )
    order = F.struct("_new", "_at")
    merged = old.unionByName(new).groupBy("scope", "id").agg(
        F.max_by(F.struct(*rest), order).alias("_w"),
        F.min_by(F.col(created), F.when(F.col(created).isNotNull(), order)).alias(created),
        F.min(order).alias("_first"),
    )
    place = F.when(
        F.col("_first")["_new"] == 0, F.struct(F.lit(1).alias("g"), F.col("_first")["_at"].alias("o"))
    ).otherwise(F.struct(F.lit(0).alias("g"), (-F.col("_first")["_at"]).alias("o")))
    return merged.select("scope", "id", created, *[F.col("_w")[c].alias(c) for c in rest], place.alias("place"))


def retain(df: DataFrame, keep: int, *order: Column) -> DataFrame:
    """The first ``keep`` rows of every scope.

    Spark applies the limit inside every map task before the shuffle, so a scope sends at most
    ``keep`` rows per task however many it has.
    """
    w = Window.partitionBy("scope").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def latest(df: DataFrame, keep: int, updated: str = "updated_at", tie: str = "pos") -> DataFrame:
    """The sorted cap: newest ``keep`` rows per scope."""
    return retain(df, keep, F.col(updated).desc_nulls_last(), F.col(tie))


def newest_first(df: DataFrame, updated: str, tie: str = "pos") -> DataFrame:
    """For display, newest first and stable."""
    return df.orderBy(F.col(updated).desc_nulls_last(), F.col(tie))


def remove_keys(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Delete by (scope, id); a blank id deletes nothing."""
    keys = gone.select("scope", strip("id").alias("id")).where(F.col("id") != "").distinct()
    return df.join(keys, ["scope", "id"], "left_anti")


def clear_scopes(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """Delete everything of the given scopes."""
    return df.join(scopes.select("scope").distinct(), "scope", "left_anti")


def add_missing(files: DataFrame, derived: DataFrame) -> DataFrame:
    """All files, then the derived ones whose id is not there yet."""
    fresh = derived.join(files.select("scope", "id").distinct(), ["scope", "id"], "left_anti")
    return files.unionByName(fresh.select(*files.columns))
