"""Registered queries over templates, drafts and uploads."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.text import field_key
from docketry.operators import drafts, ingest, records, sessions, templates
from docketry.plans import flows
from docketry.plans.registry import query
from docketry.plans.session_queries import W
from docketry.sources import fixtures as fx


def bodies(spark, sf_dir):
    """Response bodies: the answer text inside a JSON object."""
    o = fx.model_outputs(spark, sf_dir)
    return o.select("request_id", F.to_json(F.struct("answer")).alias("body"), "answer")


def prompts(spark, sf_dir):
    """Model outputs with the prompt that asked for them."""
    p = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), "p_name", "p_type", "p_size")
    k = F.col("request_id") % 5
    prompt = (
        F.when(k == 0, F.concat(F.lit("Crée moi un modèle de bail "), "p_name", F.lit(" !.")))
        .when(k == 1, F.concat(F.lit("je veux un «acte notarié "), "p_name", F.lit("»")))
        .when(k == 2, F.concat(F.lit("  génère une lettre  "), "p_name", F.lit(" ; ")))
        .when(k == 3, F.concat(F.lit("Contrat "), "p_name"))
        .otherwise("les ")
    )
    return bodies(spark, sf_dir).join(p.select("request_id", "p_name", "p_type", "p_size", prompt.alias("prompt")), "request_id")


PROMPT = """pr AS (SELECT p_partkey AS request_id, p_name, p_type, p_size, CASE p_partkey % 5 WHEN 0 THEN concat('Crée moi un modèle de bail ', p_name, ' !.')
  WHEN 1 THEN concat('je veux un «acte notarié ', p_name, '»') WHEN 2 THEN concat('  génère une lettre  ', p_name, ' ; ')
  WHEN 3 THEN concat('Contrat ', p_name) ELSE 'les ' END AS prompt,
  CASE p_partkey % 5 WHEN 0 THEN concat('Bail ', p_name, ' !') WHEN 1 THEN concat('Acte notarié ', p_name) WHEN 2 THEN concat('Génère une lettre ', p_name)
  WHEN 3 THEN concat('Contrat ', p_name) ELSE 'Les' END AS wanted FROM part)"""
STAGE = "CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END"


@query(
    "requested_names",
    "X15",
    f"WITH {PROMPT} SELECT request_id, wanted AS name FROM pr",
)
def requested_names(spark, sf_dir):
    return prompts(spark, sf_dir).select("request_id", templates.requested_name("prompt").alias("name"))


@query(
    "json_candidates",
    "X9",
    r"""SELECT request_id, CASE WHEN regexp_matches(answer, '(?i)```(?:json)?\s*([\s\S]*?)\s*```') THEN trim(regexp_extract(answer, '(?i)```(?:json)?\s*([\s\S]*?)\s*```', 1), ' ' || chr(10))
  WHEN instr(answer, '{') > 0 AND instr(answer, '}') > instr(answer, '{') THEN substring(answer, instr(answer, '{'), length(answer) - instr(reverse(answer), '}') + 2 - instr(answer, '{')) END AS candidate
FROM v_model_outputs""",
    ("v_model_outputs",),
)
def json_candidates(spark, sf_dir):
    from docketry.functions.jsontext import json_candidate

    return fx.model_outputs(spark, sf_dir).select("request_id", json_candidate("answer").alias("candidate"))


@query(
    "repaired_outputs",
    "S8 X11 X9 X10",
    f"""SELECT p_partkey AS request_id, CAST({STAGE} AS INTEGER) AS repair_stage, CASE WHEN p_partkey % 6 < 5 THEN p_name END AS name FROM part""",
)
def repaired_outputs(spark, sf_dir):
    parsed = templates.parse_outputs(bodies(spark, sf_dir))
    return parsed.select("request_id", "repair_stage", F.try_variant_get("payload", "$.name", "string").alias("name"))


@query(
    "quarantined_outputs",
    "X10",
    """SELECT p_partkey AS request_id FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 6 < 5""",
)
def quarantined_outputs(spark, sf_dir):
    o = fx.model_outputs(spark, sf_dir)
    broken = F.regexp_replace("answer", "[}”\"']", "}")
    body = F.to_json(F.struct(F.when(F.col("request_id") % 4 == 0, broken).otherwise(F.col("answer")).alias("answer")))
    return templates.quarantine(templates.parse_outputs(o.select("request_id", body.alias("body")))).select("request_id")


@query(
    "generated_templates",
    "X18 A7",
    """SELECT p_partkey AS request_id, 'custom-' || replace(p_name, ' ', '-') || '-' || p_partkey AS id, p_name AS name,
  CASE WHEN p_partkey % 6 = 0 THEN p_type ELSE 'Modeles personnalises' END AS category, 'Personnalise' AS domain, 'Document juridique' AS branch, 'Simple' AS complexity,
  CASE WHEN p_partkey % 6 = 3 THEN 'a' ELSE '' END AS legal_refs, 0 AS n_fields FROM part WHERE p_partkey % 6 < 5""",
)
def generated_templates(spark, sf_dir):
    parsed = templates.parse_outputs(prompts(spark, sf_dir))
    t = templates.templates_from_payloads(parsed)
    return t.select(
        "request_id", "id", "name", "category", "domain", "branch", "complexity",
        F.array_join("legal_refs", "|").alias("legal_refs"), F.size("fields").alias("n_fields"),
    )


@query(
    "fallback_kinds",
    "X16",
    """SELECT CASE p_partkey % 5 WHEN 0 THEN 'contract' WHEN 1 THEN 'notary' WHEN 3 THEN 'contract' ELSE 'generic' END AS kind, count(*) AS requests FROM part GROUP BY ALL""",
)
def fallback_kinds(spark, sf_dir):
    p = prompts(spark, sf_dir)
    return p.groupBy(templates.fallback_kind("prompt").alias("kind")).agg(F.count(F.lit(1)).alias("requests"))


@query(
    "ready_templates",
    "S8 X9 X10 X11 X15 X16 X17 X18 U5 W2",
    f"""WITH {PROMPT} SELECT request_id, wanted AS name, CAST(CASE request_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS INTEGER) AS repair_stage,
  CASE WHEN request_id % 6 < 5 THEN 'parties|objet|date_document|ville' WHEN request_id % 5 IN (0, 3) THEN 'partie1_nom|partie2_nom|objet_contrat|duree|montant|date_effet|modalites_paiement|parties|objet|date_document|ville'
    WHEN request_id % 5 = 1 THEN 'partie1_nom|partie2_nom|objet_acte|montant_valeur|date_signature|ville|office_notaire|clauses_particulieres|parties|objet|date_document'
    ELSE 'parties|objet|date_document|ville|clauses' END AS field_keys,
  CASE WHEN request_id % 6 < 5 THEN '' WHEN request_id % 5 IN (0, 3) THEN 'Modalites de paiement|Penalites|Clause de resiliation' WHEN request_id % 5 = 1 THEN 'Temoins|Garanties|Clauses particulieres'
    ELSE 'Contexte|Pieces justificatives|Clauses particulieres' END AS optional_fields
FROM pr""",
)
def ready_templates(spark, sf_dir):
    t = flows.template_ingest(prompts(spark, sf_dir).select("request_id", "prompt", "body"))
    keys = F.array_join(F.transform("fields", lambda f: f["key"]), "|")
    return t.select("request_id", "name", "repair_stage", keys.alias("field_keys"), F.array_join("optional_fields", "|").alias("optional_fields"))


def raw_templates(spark, sf_dir):
    """Loose template rows with two fields each."""
    p = fx.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    options = F.array(
        F.struct(F.concat(F.lit(" "), "p_brand").alias("value"), F.lit(" ").alias("label")),
        F.struct(F.lit("  ").alias("value"), F.lit("x").alias("label")),
    )
    fields = F.array(
        F.struct(
            F.lit(" k1 ").alias("key"), F.concat(F.lit(" "), "p_type").alias("label"), (k % 2 == 0).alias("required"), none.alias("placeholder"),
            F.when(k % 3 == 0, " SELECT ").otherwise("Date?").alias("type"), options.alias("options"), F.lit(" ").alias("hint"),
        ),
        F.struct(
            F.when(k % 5 == 0, " ").otherwise("k2").alias("key"), F.lit("Deux").alias("label"), F.lit(None).cast("boolean").alias("required"), F.lit(" p ").alias("placeholder"),
            F.lit("number").alias("type"), options.alias("options"), none.alias("hint"),
        ),
    )
    lists = F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), none)
    return p.select(
        (k % 20).alias("scope"), k.alias("pos"), F.concat(F.lit(" t"), (k % 700).cast("string")).alias("id"),
        F.when(k % 13 == 0, "  ").otherwise(F.col("p_name")).alias("name"), F.when(k % 4 == 0, " ").otherwise(F.col("p_type")).alias("category"),
        none.alias("domain"), F.col("p_brand").alias("branch"), F.when(k % 3 == 0, "AVANCE ").when(k % 3 == 1, "Intermediaire").otherwise("?").alias("complexity"),
        F.concat(F.lit(" "), "p_name").alias("description"), lists.alias("legal_refs"), lists.alias("required_fields"), lists.alias("optional_fields"),
        lists.alias("sections"), none.alias("warning"), fields.alias("fields"), F.col("p_size").alias("updated_s"),
    )


TEMPLATES = """tp AS (SELECT p_partkey % 20 AS scope, p_partkey AS pos, 't' || (p_partkey % 700) AS id, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'Modeles personnalises' ELSE p_type END AS category,
  'Personnalise' AS domain, CASE p_partkey % 3 WHEN 0 THEN 'Avance' WHEN 1 THEN 'Intermediaire' ELSE 'Simple' END AS complexity, p_name AS description, p_brand, p_type, p_size AS updated_s
  FROM part WHERE p_partkey % 13 <> 0),
lw AS (SELECT scope, id, min(pos) OVER (PARTITION BY scope, id) AS first_pos, name, category, domain, complexity, description, p_brand, updated_s, row_number() OVER (PARTITION BY scope, id ORDER BY pos DESC) AS rn FROM tp),
lt AS (SELECT * FROM lw WHERE rn = 1)"""


@query(
    "normalized_templates",
    "P3",
    f"""WITH {TEMPLATES} SELECT scope, pos, id, name, category, complexity, p_brand AS legal_refs,
  'k1:' || p_type || ':' || CASE WHEN pos % 2 = 0 THEN 'true' ELSE 'false' END || ':' || CASE WHEN pos % 3 = 0 THEN 'select:' || p_brand || '=' || p_brand ELSE 'text:' END || CASE WHEN pos % 5 = 0 THEN '' ELSE '|k2:Deux:false:number:' END AS fields,
  'Verifier la conformite du modele avec le droit senegalais avant utilisation.' AS warning FROM tp""",
)
def normalized_templates(spark, sf_dir):
    t = records.normalize_templates(raw_templates(spark, sf_dir))
    shown = F.transform(
        "fields",
        lambda f: F.concat_ws(
            ":", f["key"], f["label"], f["required"].cast("string"), f["type"],
            F.coalesce(F.array_join(F.transform(f["options"], lambda o: F.concat_ws("=", o["value"], o["label"])), ","), F.lit("")),
        ),
    )
    return t.select("scope", "pos", "id", "name", "category", "complexity", F.array_join("legal_refs", ",").alias("legal_refs"), F.array_join(shown, "|").alias("fields"), "warning")


def stored_templates(spark, sf_dir):
    t = records.normalize_templates(raw_templates(spark, sf_dir))
    return records.latest(records.last_wins(t, ["scope", "id"], "pos"), records.KEEP_TEMPLATES, "updated_s")


@query(
    "stored_templates",
    "W2 W3 P3 S2",
    f"""WITH {TEMPLATES} SELECT scope, id, pos, name FROM (SELECT scope, id, first_pos AS pos, name, row_number() OVER (PARTITION BY scope ORDER BY updated_s DESC, first_pos) AS r FROM lt) WHERE r <= 200""",
)
def stored_templates_query(spark, sf_dir):
    return stored_templates(spark, sf_dir).select("scope", "id", "pos", "name")


def builtin_templates(spark, sf_dir):
    """Shared catalog rows, one per part type."""
    p = fx.table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_partkey").alias("k"))
    c = F.concat(F.lit("Modele "), "p_type")
    return p.select(
        F.concat(F.lit("t"), F.col("k").cast("string")).alias("id"), F.col("k").alias("pos"), c.alias("name"), F.col("p_type").alias("category"),
        F.lit("Commun").alias("domain"), F.lit("Avance").alias("complexity"), c.alias("description"), F.array(F.lit("COCC")).alias("legal_refs"),
        F.lit(False).alias("is_custom"),
    )


CATALOG = f"""{TEMPLATES},
st AS (SELECT scope, id, first_pos AS pos, name, category, domain, complexity, description, p_brand AS refs FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY updated_s DESC, first_pos) AS r FROM lt) WHERE r <= 200),
bi AS (SELECT 't' || k AS id, k AS pos, 'Modele ' || p_type AS name, p_type AS category, 'Commun' AS domain, 'Avance' AS complexity, 'Modele ' || p_type AS description, 'COCC' AS refs FROM (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY p_type)),
al AS (SELECT scope, id, pos + (SELECT max(k) + 1 FROM (SELECT min(p_partkey) AS k FROM part GROUP BY p_type)) AS pos, name, category, domain, complexity, description, refs, true AS is_custom FROM st
  UNION ALL SELECT s.scope, bi.*, false FROM bi, (SELECT DISTINCT scope FROM st) s),
tc AS (SELECT scope, id, min(pos) AS pos, arg_max(name, pos) AS name, arg_max(category, pos) AS category, arg_max(domain, pos) AS domain, arg_max(complexity, pos) AS complexity, arg_max(description, pos) AS description, arg_max(refs, pos) AS refs, arg_max(is_custom, pos) AS is_custom FROM al GROUP BY scope, id)"""


def template_catalog(spark, sf_dir):
    return templates.union_templates(builtin_templates(spark, sf_dir), templates.as_catalog_row(stored_templates(spark, sf_dir)))


@query(
    "template_catalog",
    "P6 U1 W2",
    f"WITH {CATALOG} SELECT scope, id, pos, name, domain, is_custom FROM tc",
)
def template_catalog_query(spark, sf_dir):
    return template_catalog(spark, sf_dir).select("scope", "id", "pos", "name", "domain", "is_custom")


@query(
    "filtered_templates",
    "F5 A3",
    f"""WITH {CATALOG} SELECT scope, id, category AS group_name, CAST(row_number() OVER (PARTITION BY scope ORDER BY lower(category), category, lower(name), name, pos) AS INTEGER) AS rank
FROM tc WHERE complexity = 'Avance' AND contains(lower(concat_ws(' ', name, description, domain, category, refs)), 'o')""",
)
def filtered_templates(spark, sf_dir):
    rows = templates.filter_templates(template_catalog(spark, sf_dir), " O ", level="Avance")
    return templates.grouped(rows, ["scope"]).select("scope", "id", "group_name", "rank")


RECENT = """us AS (SELECT user_id % 20 AS scope, 't' || (event_id % 150) AS template_id, event_id AS seq FROM events),
rc AS (SELECT * FROM (SELECT scope, template_id, max(seq) AS seq, row_number() OVER (PARTITION BY scope ORDER BY max(seq) DESC) AS mru_pos FROM us GROUP BY scope, template_id) WHERE mru_pos <= 10)"""


def template_uses(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("scope"),
        F.concat(F.lit("t"), (F.col("event_id") % 150).cast("string")).alias("template_id"),
        F.col("event_id").alias("seq"),
    )


@query(
    "recent_templates",
    "W5",
    f"WITH {RECENT} SELECT scope, template_id, seq, CAST(mru_pos AS INTEGER) AS mru_pos FROM rc",
)
def recent_templates(spark, sf_dir):
    return templates.recent_templates(template_uses(spark, sf_dir)).select("scope", "template_id", "seq", "mru_pos")


@query(
    "recent_template_rows",
    "J10 W5",
    f"WITH {CATALOG}, {RECENT} SELECT rc.scope, rc.template_id, CAST(mru_pos AS INTEGER) AS mru_pos, tc.name FROM rc JOIN tc ON tc.scope = rc.scope AND tc.id = rc.template_id",
)
def recent_template_rows(spark, sf_dir):
    r = templates.recent_templates(template_uses(spark, sf_dir))
    return templates.recent_rows(r, template_catalog(spark, sf_dir)).select("scope", "template_id", "mru_pos", "name")


@query(
    "template_forms",
    "P7 X2",
    f"""WITH {TEMPLATES} SELECT scope, pos, 'k1:' || p_type || '|' || CASE WHEN pos % 5 = 0 THEN 'deux_2:Deux' ELSE 'k2:Deux' END AS fields FROM tp WHERE pos % 3 <> 0
UNION ALL SELECT scope, pos, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') || '_1:' || p_brand FROM tp WHERE pos % 3 = 0""",
)
def template_forms(spark, sf_dir):
    raw = raw_templates(spark, sf_dir)
    none = F.array().cast(raw.schema["fields"].dataType)
    raw = raw.withColumn("fields", F.when(F.col("pos") % 3 == 0, none).otherwise(F.col("fields"))).withColumn("scope", F.struct("scope", "pos"))
    forms = templates.as_form(raw)
    shown = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["key"], f["label"])), "|")
    return forms.select("scope.scope", "scope.pos", shown.alias("fields"))


# --------------------------------------------------------------------------------------------
# Drafts

DONE = f"trim(coalesce(value, ''), {W}) <> ''"


@query(
    "form_completeness",
    "J8",
    f"""SELECT form_id, required, completed, CAST(floor(100.0 * completed / greatest(required, 1) + 0.5) AS BIGINT) AS percent FROM (
 SELECT form_id, count(*) FILTER (required) AS required, count(*) FILTER (required AND {DONE}) AS completed FROM v_form_values GROUP BY form_id)""",
    ("v_form_values",),
)
def form_completeness(spark, sf_dir):
    return drafts.completeness(fx.form_values(spark, sf_dir))


@query(
    "missing_form_labels",
    "J8",
    f"SELECT form_id, pos, label FROM v_form_values WHERE required AND NOT ({DONE})",
    ("v_form_values",),
)
def missing_form_labels(spark, sf_dir):
    return drafts.missing_labels(fx.form_values(spark, sf_dir))


ITEMS = """it AS (SELECT c_custkey AS form_id, 0 AS item_pos, CASE c_custkey % 4 WHEN 0 THEN 'NOM DU BAILLEUR' WHEN 1 THEN 'la duree du bail svp' WHEN 2 THEN 'Adresse' ELSE 'Clauses' END AS item FROM customer
  UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 8 = 0 THEN 'Durée du bail' ELSE ' ' END FROM customer)"""


def reported_items(spark, sf_dir):
    k = F.col("c_custkey")
    first = F.when(k % 4 == 0, "NOM DU BAILLEUR").when(k % 4 == 1, "la duree du bail svp").when(k % 4 == 2, "Adresse").otherwise("Clauses")
    second = F.when(k % 8 == 0, "Durée du bail").otherwise(" ")
    return fx.table(spark, sf_dir, "customer").select(
        k.alias("form_id"), F.posexplode(F.array(first, second)).alias("item_pos", "item")
    )


@query(
    "blocking_items",
    "J9 J8",
    f"""WITH {ITEMS}, f AS (SELECT form_id, lower(strip_accents(label)) AS l FROM v_form_values WHERE required),
a AS (SELECT DISTINCT it.form_id, item_pos AS pos, item AS label FROM it JOIN f ON f.form_id = it.form_id AND trim(item) <> '' AND (contains(lower(strip_accents(item)), l) OR contains(l, lower(strip_accents(item)))))
SELECT form_id, CAST(pos AS BIGINT) AS pos, label FROM a UNION ALL
SELECT form_id, CAST(pos AS BIGINT), label FROM v_form_values v WHERE required AND NOT ({DONE}) AND NOT EXISTS (SELECT 1 FROM a WHERE a.form_id = v.form_id)""",
    ("v_form_values",),
)
def blocking_items(spark, sf_dir):
    return drafts.blocking_items(reported_items(spark, sf_dir), fx.form_values(spark, sf_dir))


@query(
    "generation_prompts",
    "P14",
    f"""WITH l AS (SELECT form_id, string_agg('- ' || label || ': ' || trim(value, {W}), chr(10) ORDER BY pos) AS lines FROM v_form_values WHERE {DONE} GROUP BY form_id)
SELECT c_custkey AS form_id, 'Generer un modele d''acte juridique: Contrat de bail.' || chr(10) || 'Branche juridique prioritaire: Droit civil.' || chr(10) ||
  CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Contexte complementaire utilisateur:' || chr(10) || c_mktsegment ELSE '' END || chr(10) || 'Informations disponibles:' || chr(10) ||
  coalesce(lines, '- Aucune information fournie.') AS head FROM customer LEFT JOIN l ON l.form_id = c_custkey""",
    ("v_form_values",),
)
def generation_prompts(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    forms = c.select(
        F.col("c_custkey").alias("form_id"),
        F.lit("Contrat de bail").alias("label"),
        F.lit("Droit civil").alias("branch"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise(" ").alias("intent"),
    )
    p = drafts.generation_prompts(fx.form_values(spark, sf_dir), forms)
    head = F.split_part("prompt", F.lit("\n" + "\n".join(drafts.GENERATION_RULES)), F.lit(1))
    return p.select("form_id", head.alias("head"))


@query(
    "validation_prompts",
    "P14 W4",
    f"""WITH l AS (SELECT form_id, string_agg('- ' || label || CASE WHEN required THEN ' [OBLIGATOIRE]: ' ELSE ' [OPTIONNEL]: ' END || CASE WHEN {DONE} THEN trim(value, {W}) ELSE '[MANQUANT]' END, chr(10) ORDER BY pos) AS lines FROM v_form_values GROUP BY form_id),
m AS (SELECT conv_id AS form_id, string_agg(CASE WHEN role = 'user' THEN 'Utilisateur: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS dialogue FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 12 GROUP BY conv_id)
SELECT l.form_id, lines || chr(10) || chr(10) || 'Historique mini chat:' || chr(10) || coalesce(dialogue, 'Aucun echange precedent dans le mini chat.') || chr(10) || chr(10) || 'Dernier message utilisateur: ok ' || l.form_id AS body
FROM l LEFT JOIN m ON m.form_id = l.form_id""",
    ("v_form_values",),
)
def validation_prompts(spark, sf_dir):
    values = fx.form_values(spark, sf_dir)
    forms = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("form_id"), F.lit("Bail").alias("label"), F.lit("Droit civil").alias("branch"), F.lit(" ").alias("intent"),
        F.lit(None).cast("string").alias("document"), F.concat(F.lit("ok "), F.col("c_custkey").cast("string")).alias("message"),
    )
    messages = fx.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("form_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content")
    )
    p = drafts.validation_prompts(values, forms, messages)
    tail = F.split_part("prompt", F.lit("Informations collectees:\n"), F.lit(2))
    return p.select("form_id", F.split_part(tail, F.lit("\n" + "\n".join(drafts.VALIDATION_RULES)), F.lit(1)).alias("body"))


def draft_bodies(spark, sf_dir):
    """Response bodies of the drafting model in their different shapes."""
    t = sessions.finalized(fx.turns(spark, sf_dir))
    quoted = F.to_json(F.struct(F.col("answer").alias("a")))
    q = F.regexp_replace(F.regexp_replace(quoted, r'^\{"a":', ""), r"\}\z", "")
    k = (F.col("session_id") + F.col("pos")) % 7
    lit = F.lit
    body = (
        F.when(k == 0, F.concat(lit('{"answer": '), q, lit("}")))
        .when(k == 1, F.concat(lit('{"choices":[{"message":{"content":'), q, lit("}}]}")))
        .when(k == 2, F.concat(lit('{"choices":[{"delta":{"content":['), q, lit(',{"model":"m","text":"fin"}]}}]}')))
        .when(k == 3, F.concat(lit('{"output":[{"content":[{"text":'), q, lit('}],"status":"ok"}]}')))
        .when(k == 4, F.col("answer"))
        .when(k == 5, F.concat(lit('{"answer":" ","choices":[{"text":'), q, lit("}]}")))
        .otherwise('{"other": 1}')
    )
    return t.select("session_id", "pos", "answer", body.alias("body"))


@query(
    "assistant_texts",
    "X11",
    f"""SELECT session_id, pos, CASE (session_id + pos) % 7 WHEN 2 THEN trim(answer, {W}) || chr(10) || 'fin' WHEN 6 THEN '' ELSE trim(answer, {W}) END AS answer
FROM v_turns WHERE status IN ('done','error') AND trim(question, {W}) <> '' AND trim(answer, {W}) <> ''""",
    ("v_turns",),
)
def assistant_texts(spark, sf_dir):
    return drafts.chat_answers(draft_bodies(spark, sf_dir).drop("answer")).select("session_id", "pos", "answer")


@query(
    "validation_results",
    "X12 X9",
    """SELECT c_custkey AS form_id, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'missing' ELSE 'complete' END AS status, CASE WHEN c_custkey % 5 = 1 THEN c_name || '|b' ELSE '' END AS missing_items,
  CASE c_custkey % 5 WHEN 0 THEN 'Quel nom ?' WHEN 1 THEN 'Il manque des informations pour rediger l''acte final.' WHEN 2 THEN 'Le projet d''acte est pret.' WHEN 3 THEN 'ok' ELSE 'Voici ' || c_name END AS assistant_reply,
  CASE c_custkey % 5 WHEN 2 THEN 'ACTE ' || c_name WHEN 3 THEN '{"assistant_reply":"ok"}' WHEN 4 THEN 'Voici ' || c_name ELSE '' END AS document FROM customer""",
)
def validation_results(spark, sf_dir):
    k, n = F.col("c_custkey") % 5, F.col("c_name")
    answer = (
        F.when(k == 0, '```json\n{"status":"MISSING","assistant_reply":" Quel nom ? "}\n```')
        .when(k == 1, F.concat(F.lit('Voila {"status":"complete","missing_items":[" '), n, F.lit(' ","", null, "b"]} merci')))
        .when(k == 2, F.concat(F.lit('{"status":"complete","document":"ACTE '), n, F.lit('"}')))
        .when(k == 3, F.lit('{"assistant_reply":"ok"}'))
        .otherwise(F.concat(F.lit(" Voici "), n))
    )
    a = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("form_id"), answer.alias("answer"))
    return drafts.parse_validation(a).select(
        "form_id", "status", F.array_join("missing_items", "|").alias("missing_items"), "assistant_reply", "document"
    )


@query(
    "answer_rows",
    "X7",
    f"""WITH a AS (SELECT session_id, pos, unnest(string_split('Titre' || chr(10) || '- point ' || pos || chr(10) || answer, chr(10))) AS line FROM v_turns)
SELECT CASE WHEN starts_with(trim(line, {W}), '- ') THEN 'bullet' ELSE 'paragraph' END AS kind, count(*) AS n, CAST(sum(length(CASE WHEN starts_with(trim(line, {W}), '- ') THEN trim(substring(trim(line, {W}), 3), {W}) ELSE trim(line, {W}) END)) AS BIGINT) AS chars
FROM a WHERE trim(line, {W}) <> '' GROUP BY ALL""",
    ("v_turns",),
)
def answer_rows(spark, sf_dir):
    t = fx.turns(spark, sf_dir)
    marked = F.concat(F.lit("## **Titre**\n> - point "), F.col("pos").cast("string"), F.lit("  \n"), "answer")
    rows = drafts.answer_rows(
        t.select("session_id", F.col("pos").alias("turn_pos"), marked.alias("answer")), ["session_id", "turn_pos"], "answer"
    )
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "document_blocks",
    "X8",
    r"""WITH l AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13) || chr(160)) AS line FROM (SELECT doc_id, unnest(string_split(
  CASE doc_id % 4 WHEN 0 THEN '- ' || substring(text, 1, 40) || chr(10) || 'Article 12: objet' || chr(10) || text WHEN 1 THEN 'CONTRAT DE BAIL N. 12' || chr(10) || 'Parties:' || chr(10) || text ELSE text END, chr(10))) AS line FROM documents))
SELECT doc_id, kind, count(*) AS blocks FROM (SELECT doc_id, CASE WHEN regexp_matches(line, '^[-*•]\s+(.+)$') THEN 'li' WHEN regexp_matches(line, '(?i)^article\s+[a-z0-9.\-]+') THEN 'h3'
  WHEN ends_with(line, ':') AND length(line) <= 90 THEN 'h2' WHEN regexp_full_match(line, '[A-Z0-9\s''’.,:-]{12,}') AND length(line) <= 120 THEN 'h1' ELSE 'p' END AS kind FROM l WHERE line <> '') GROUP BY ALL""",
)
def document_blocks(spark, sf_dir):
    k = F.col("doc_id") % 4
    d = fx.table(spark, sf_dir, "documents")
    body = (
        F.when(k == 0, F.concat(F.lit("- "), F.substring("text", 1, 40), F.lit("\r\nArticle 12: objet\n"), "text"))
        .when(k == 1, F.concat(F.lit("CONTRAT DE BAIL N. 12\nParties:\n"), "text"))
        .otherwise(F.col("text"))
    )
    blocks = drafts.document_blocks(d.select("doc_id", body.alias("text")), ["doc_id"], "text")
    return blocks.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("blocks"))


# --------------------------------------------------------------------------------------------
# Uploads


def upload_parts(spark, sf_dir):
    """Chosen files, uploaded rows and errors of every batch."""
    u = fx.upload_rows(spark, sf_dir)
    errors = u.where("failed").select("batch_id", "pos", F.upper("file_name").alias("filename"), F.lit("trop grand").alias("detail"))
    uploaded = u.where(~F.col("failed")).select("batch_id", "pos", F.col("uploaded_id").alias("id"), "chunk_count")
    return u.select("batch_id", "pos", F.col("file_name").alias("name")), uploaded, errors


RECON = """fl AS (SELECT batch_id, pos, file_name AS name, lower(trim(file_name)) AS n FROM v_upload_rows),
fe AS (SELECT DISTINCT batch_id, lower(trim(file_name)) AS n FROM v_upload_rows WHERE failed),
fk AS (SELECT fl.*, fe.n IS NOT NULL AS bad FROM fl LEFT JOIN fe ON fe.batch_id = fl.batch_id AND fe.n = fl.n),
kp AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS rk FROM fk WHERE NOT bad),
up AS (SELECT batch_id, pos, trim(uploaded_id) AS id, min(CASE WHEN trim(uploaded_id) = '' THEN pos END) OVER (PARTITION BY batch_id) AS stop FROM v_upload_rows WHERE NOT failed),
sl AS (SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS rk FROM up WHERE stop IS NULL OR pos < stop),
rs AS (SELECT kp.batch_id, kp.pos, kp.name, sl.id AS file_id, CASE WHEN sl.id IS NOT NULL THEN 'uploaded' ELSE 'waiting' END AS outcome FROM kp LEFT JOIN sl ON sl.batch_id = kp.batch_id AND sl.rk = kp.rk
  UNION ALL SELECT batch_id, pos, name, NULL, 'failed' FROM fk WHERE bad)"""


@query("reconciled_uploads", "J7 S7", f"WITH {RECON} SELECT * FROM rs", ("v_upload_rows",))
def reconciled_uploads(spark, sf_dir):
    return ingest.reconcile(*upload_parts(spark, sf_dir))


@query(
    "upload_summary",
    "A6 J7",
    f"""WITH {RECON},
u AS (SELECT batch_id, count(*) AS uploaded, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM v_upload_rows WHERE NOT failed GROUP BY ALL),
i AS (SELECT batch_id, count(file_id) AS ids FROM rs GROUP BY ALL),
e AS (SELECT batch_id, count(*) AS errors, list(upper(file_name) || ': trop grand' ORDER BY pos) AS l FROM v_upload_rows WHERE failed GROUP BY ALL)
SELECT coalesce(u.batch_id, e.batch_id) AS batch_id, coalesce(uploaded, 0) AS uploaded, coalesce(chunks, 0) AS chunks, coalesce(errors, 0) AS errors,
  coalesce(array_to_string(l[1:CASE WHEN uploaded IS NULL THEN 3 ELSE 2 END], ' | '), '') AS digest,
  CASE WHEN uploaded IS NULL THEN 'failed' WHEN coalesce(ids, 0) = 0 THEN 'no-chunks' WHEN errors > 0 THEN 'partial' ELSE 'ok' END AS outcome
FROM u FULL JOIN e ON e.batch_id = u.batch_id LEFT JOIN i ON i.batch_id = u.batch_id""",
    ("v_upload_rows",),
)
def upload_summary(spark, sf_dir):
    return ingest.upload_report(*upload_parts(spark, sf_dir))[1]


@query(
    "submitted_file_ids",
    "U3",
    """WITH u AS (SELECT batch_id, 0 AS turn, pos, CASE WHEN pos % 2 = 0 THEN trim(uploaded_id) END AS x FROM v_upload_rows UNION ALL SELECT batch_id, 1, pos, CASE WHEN NOT failed AND pos % 3 <> 0 THEN trim(uploaded_id) END FROM v_upload_rows),
i AS (SELECT batch_id, x, turn, pos FROM u WHERE x <> '' QUALIFY row_number() OVER (PARTITION BY batch_id, x ORDER BY turn, pos) = 1)
SELECT a.batch_id AS request_id, a.n AS attachments, coalesce(c.n, 0) AS ids, coalesce(c.n, 0) = 0 AS rejected, i.x AS file_id, i.turn, i.pos AS at FROM (SELECT batch_id, count(*) AS n FROM v_upload_rows GROUP BY ALL) a
LEFT JOIN (SELECT batch_id, count(*) AS n FROM i GROUP BY ALL) c ON c.batch_id = a.batch_id LEFT JOIN i ON i.batch_id = a.batch_id""",
    ("v_upload_rows",),
)
def submitted_file_ids(spark, sf_dir):
    u = fx.upload_rows(spark, sf_dir)
    return ingest.submitted_ids(
        u.select(
            F.col("batch_id").alias("request_id"),
            "pos",
            F.when(F.col("pos") % 2 == 0, F.col("uploaded_id")).alias("pre_id"),
            F.when(~F.col("failed") & (F.col("pos") % 3 != 0), F.col("uploaded_id")).alias("new_id"),
        )
    )


@query(
    "new_upload_files",
    "U6 W2",
    """SELECT scope, name, size, last_modified FROM (SELECT batch_id % 50 AS scope, file_name AS name, chunk_count AS size, pos AS last_modified FROM v_upload_rows WHERE NOT failed) c
WHERE NOT EXISTS (SELECT 1 FROM v_upload_rows p WHERE p.failed AND p.batch_id % 50 = c.scope AND p.file_name = c.name AND p.chunk_count = c.size AND p.pos = c.last_modified)""",
    ("v_upload_rows",),
)
def new_upload_files(spark, sf_dir):
    u = fx.upload_rows(spark, sf_dir).select(
        (F.col("batch_id") % 50).alias("scope"), F.col("file_name").alias("name"), F.col("chunk_count").alias("size"), F.col("pos").alias("last_modified"), "failed"
    )
    return ingest.new_files(u.where(~F.col("failed")).drop("failed"), u.where("failed").drop("failed"))


@query(
    "attachment_labels",
    "X19",
    f"""SELECT batch_id, count(*) AS files, 'Question' || chr(10) || '📎 ' || array_to_string((list(trim(file_name) ORDER BY pos))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' +' || (count(*) - 3) ELSE '' END AS label,
  first(trim(file_name) ORDER BY pos) AS first_name FROM v_upload_rows GROUP BY ALL""",
    ("v_upload_rows",),
)
def attachment_labels(spark, sf_dir):
    u = fx.upload_rows(spark, sf_dir).select("batch_id", "pos", F.col("file_name").alias("name"))
    p = ingest.attachment_preview(u, "batch_id", fx.UPLOAD_BLOCK)
    label = ingest.display_question(F.lit("  "), F.col("preview"))
    return p.select("batch_id", "files", label.alias("label"), sessions.first_attachment(label).alias("first_name"))


@query(
    "field_keys",
    "X2",
    """SELECT DISTINCT p_type AS label, replace(coalesce(nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'modele-personnalise'), '-', '_') AS field_key FROM part""",
)
def field_keys(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), field_key("p_type").alias("field_key")).distinct()
