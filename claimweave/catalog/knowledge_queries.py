"""Typed entities and knowledge facts.

The star schema is the knowledge: suppliers and customers are entities, their nation,
region and segment are attributes, and the same links are the triples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimweave.catalog.base import query, rounded, sql_capitals, sql_words, strings, table, with_capitals, with_ctes
from claimweave.catalog.text_queries import sql_similar
from claimweave.functions import fixed_values as fixed
from claimweave.operators import knowledge as K
from claimweave.operators.entities import entity_map, entity_rows, flat_entities, typed_entities

L, R = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
ENTITY_STOP = strings(fixed.ENTITY_STOPWORDS)

# documents with planted capitals, numbers and titles, so that every type occurs
TYPED_TEXT = (
    sql_capitals("text")
    + " || ' In March ' || (1000 + doc_id) || ', Dr. ' || upper(source) || ' of Acme Corporation and Leeds University paid $' || (doc_id % 90)"
    " || ' million or ' || (doc_id % 90) || ' percent to Kansas City and NASA. President Lincoln met City of Paris'"
)


def typed_text():
    n = F.pmod("doc_id", F.lit(90)).cast("string")
    return F.concat(
        with_capitals("text"), F.lit(" In March "), (F.col("doc_id") + 1000).cast("string"), F.lit(", Dr. "), F.upper("source"),
        F.lit(" of Acme Corporation and Leeds University paid $"), n, F.lit(" million or "), n,
        F.lit(" percent to Kansas City and NASA. President Lincoln met City of Paris"),
    )


def _find(pattern: str, group_in: str | None = None) -> str:
    """Bounded matches of a pattern on the doubled text."""
    doubled = pattern.replace(" ", "  ")
    found = f"regexp_extract_all(dd, '{L}({doubled}){R}', {2 if group_in else 1})"
    return f"list_transform({found}, lambda e: replace(e, '  ', ' '))"


MONTHS = "(January|February|March|April|May|June|July|August|September|October|November|December)"
TYPED_CTE = f"""
texts AS (SELECT doc_id, {TYPED_TEXT} AS x FROM documents),
doubled AS MATERIALIZED (SELECT doc_id, x, regexp_replace(x, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g') AS dd FROM texts),
raw AS (
  SELECT doc_id, x,
    {_find('[A-Z][a-z]+ [A-Z][a-z]+')} || {_find('President [A-Z][a-z]+')} || list_transform(regexp_extract_all(dd, '{L}(Dr[.][.]  [A-Z][a-z]+){R}', 1), lambda e: replace(replace(e, '  ', ' '), '..', '.')) AS person,
    {_find('[A-Z][A-Za-z]* (Company|Corporation|Inc|Ltd|LLC)', 'g')} || {_find('[A-Z][A-Za-z]+ (University|College)', 'g')}
      || {_find('University of [A-Z][A-Za-z]+')} || {_find('[A-Z][A-Z]+')} AS org,
    {_find('[A-Z][a-z]+ (City|County|State)', 'g')} || {_find('City of [A-Z][a-z]+')} || {_find('(United States|US|USA|UK|China|Russia|Germany|France|Japan)')} AS gpe,
    {_find(MONTHS + ' [0-9]{1,2},? [0-9]{4}', 'g')} || {_find('[0-9]{4}')} AS dates,
    {_find('[0-9]+ (percent|million|billion|trillion)', 'g')} AS quantity,
    list_filter(list_transform(regexp_extract_all(dd, '{L}([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+){R}', 1), lambda e: replace(e, '  ', ' ')), lambda e: NOT list_contains({ENTITY_STOP}, e)) AS phrases
  FROM doubled),
usable AS (
  SELECT doc_id, x, phrases, """ + ", ".join(
    f"list_filter({c}, lambda e: e <> '' AND NOT list_contains({ENTITY_STOP}, e)) AS {c}" for c in ("person", "org", "gpe", "dates", "quantity")
) + f""" FROM raw),
inner_words AS (
  SELECT doc_id, flatten(list_transform(string_split(x, '.'), lambda s: {sql_words('s')}[2:])) AS ws FROM usable),
capitals AS (
  SELECT doc_id, list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains({ENTITY_STOP}, w)) AS caps FROM inner_words),
typed AS (
  SELECT doc_id, person, org, gpe, dates, quantity,
    phrases || list_filter(caps, lambda w: NOT list_contains(person || org || gpe || dates || quantity || phrases, w)) AS misc
  FROM usable JOIN capitals USING (doc_id)),
long0 AS (
  SELECT doc_id, 1 AS ord, 'PERSON' AS etype, unnest(person) AS entity, generate_subscripts(person, 1) AS p FROM typed
  UNION ALL SELECT doc_id, 2, 'ORG', unnest(org), generate_subscripts(org, 1) FROM typed
  UNION ALL SELECT doc_id, 3, 'GPE', unnest(gpe), generate_subscripts(gpe, 1) FROM typed
  UNION ALL SELECT doc_id, 4, 'DATE', unnest(dates), generate_subscripts(dates, 1) FROM typed
  UNION ALL SELECT doc_id, 5, 'QUANTITY', unnest(quantity), generate_subscripts(quantity, 1) FROM typed
  UNION ALL SELECT doc_id, 6, 'MISC', unnest(misc), generate_subscripts(misc, 1) FROM typed),
firsts AS (SELECT doc_id, ord, etype, entity, min(p) AS p FROM long0 GROUP BY doc_id, ord, etype, entity),
entity_rows AS (SELECT doc_id, ord, etype, row_number() OVER (PARTITION BY doc_id, ord ORDER BY p) - 1 AS pos, entity FROM firsts)
"""


def _typed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", typed_text().alias("text"))
    return typed_entities(docs)


@query("typed_entities", with_ctes(TYPED_CTE) + " SELECT doc_id, etype, pos, entity FROM entity_rows")
def typed_entity_rows(spark, sf_dir):
    return entity_rows(_typed(spark, sf_dir))


@query(
    "entity_map",
    with_ctes(TYPED_CTE) + " SELECT doc_id, count(DISTINCT etype) AS n_types, count(*) AS n_entities FROM entity_rows GROUP BY doc_id",
)
def entity_maps(spark, sf_dir):
    found = entity_map(_typed(spark, sf_dir))
    sizes = F.transform(F.map_values("entities"), lambda v: F.size(v))
    total = F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n).cast("long")
    return found.select("doc_id", F.size("entities").cast("long").alias("n_types"), total.alias("n_entities"))


@query(
    "flat_entities",
    with_ctes(TYPED_CTE)
    + """ SELECT doc_id, md5(string_agg(entity, '|' ORDER BY o, q)) AS entities FROM (
      SELECT doc_id, entity, min(ord * 1000000 + pos) AS o, 0 AS q FROM entity_rows GROUP BY doc_id, entity) GROUP BY doc_id""",
)
def flat(spark, sf_dir):
    return _typed(spark, sf_dir).select("doc_id", F.md5(F.array_join(flat_entities(), "|")).alias("entities"))


# --- knowledge tables ----------------------------------------------------------------------
KG_CTE = """
nations AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
members AS (
  SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nk, 'supplier' AS kind, 'NONE' AS segment FROM supplier
  UNION ALL SELECT c_custkey, c_name, c_nationkey, 'customer', c_mktsegment FROM customer),
known AS (SELECT m.*, n_name, r_name FROM members m JOIN nations ON nk = n_nationkey),
kg_entities AS (
  SELECT name AS entity, 'google_kg' AS src, CASE WHEN k % 2 = 0 THEN kind || ' of ' || n_name ELSE '' END AS description, name AS alias FROM known WHERE k % 5 IN (0, 1)
  UNION ALL SELECT name, 'wikidata', CASE WHEN k % 7 <> 3 THEN kind || ' in ' || r_name ELSE '' END, lower(name) FROM known WHERE k % 5 IN (1, 2, 3)
  UNION ALL SELECT name, 'dbpedia', 'about ' || name, upper(name) FROM known WHERE k % 3 <> 1),
kg_attrs AS (
  SELECT name AS entity, 'google_kg' AS src, 'types' AS attr, [kind, segment] AS vals, true AS is_list, 0 AS ord FROM known WHERE k % 5 IN (0, 1) AND k % 4 <> 2
  UNION ALL SELECT name, 'google_kg', 'located_in', [n_name], false, 1 FROM known WHERE k % 5 IN (0, 1) AND k % 4 <> 2
  UNION ALL SELECT name, 'wikidata', 'located_in', [r_name], false, 0 FROM known WHERE k % 5 IN (1, 2, 3)
  UNION ALL SELECT name, 'wikidata', 'note', ['trades with ' || n_name || ' and others'], false, 1 FROM known WHERE k % 5 IN (1, 2, 3)
  UNION ALL SELECT name, 'dbpedia', 'segment', [segment], false, 0 FROM known WHERE k % 3 <> 1),
triples AS (
  SELECT name AS s, 'P131' AS p, n_name AS o FROM known UNION ALL SELECT name, 'part of', r_name || ' REGION' FROM known WHERE k % 2 = 1
  UNION ALL SELECT name, 'segment', segment FROM known WHERE kind = 'customer'),
requests AS (
  SELECT name AS subject, ['located in', 'segment', 'related to', 'mentions', 'types'][k % 5 + 1] AS predicate,
    CASE k % 4 WHEN 0 THEN n_name WHEN 1 THEN r_name WHEN 2 THEN segment ELSE 'NATION_' || (nk + 1) % 25 END AS object FROM known
  UNION ALL SELECT name, 'located in', n_name FROM known
  UNION ALL SELECT 'The ' || r_name || ' election', 'involves', 'vote in ' || n_name FROM nations
  UNION ALL SELECT r_name || ' ' || n_name, 'related to', n_name FROM nations)
"""


def _known(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    suppliers = t("supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nk"),
        F.lit("supplier").alias("kind"), F.lit("NONE").alias("segment"),
    )
    customers = t("customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nk"),
        F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"),
    )
    members = suppliers.unionByName(customers)
    # 25 nations: the size of the nation table is fixed
    return members.join(F.broadcast(nations), F.col("nk") == F.col("n_nationkey")), nations


def knowledge_tables(spark, sf_dir):
    known, nations = _known(spark, sf_dir)
    k = F.col("k")
    by5 = F.pmod(k, F.lit(5))
    google, wiki, dbp = known.filter(by5.isin(0, 1)), known.filter(by5.isin(1, 2, 3)), known.filter(F.pmod(k, F.lit(3)) != 1)

    def entity(df, src, description, alias):
        return df.select(
            F.col("name").alias("entity"), F.lit(src).alias("src"), description.alias("description"), F.array(alias).alias("aliases")
        )

    described = F.when(F.pmod(k, F.lit(2)) == 0, F.concat("kind", F.lit(" of "), "n_name")).otherwise("")
    placed = F.when(F.pmod(k, F.lit(7)) != 3, F.concat("kind", F.lit(" in "), "r_name")).otherwise("")
    entities = (
        entity(google, "google_kg", described, F.col("name"))
        .unionByName(entity(wiki, "wikidata", placed, F.lower("name")))
        .unionByName(entity(dbp, "dbpedia", F.concat(F.lit("about "), "name"), F.upper("name")))
    )

    def attr(df, src, name, vals, is_list, ord_):
        return df.select(
            F.col("name").alias("entity"), F.lit(src).alias("src"), F.lit(name).alias("attr"), vals.alias("vals"),
            F.lit(is_list).alias("is_list"), F.lit(ord_).alias("ord"),
        )

    rich = google.filter(F.pmod(k, F.lit(4)) != 2)
    note = F.array(F.concat(F.lit("trades with "), "n_name", F.lit(" and others")))
    attributes = (
        attr(rich, "google_kg", "types", F.array("kind", "segment"), True, 0)
        .unionByName(attr(rich, "google_kg", "located_in", F.array("n_name"), False, 1))
        .unionByName(attr(wiki, "wikidata", "located_in", F.array("r_name"), False, 0))
        .unionByName(attr(wiki, "wikidata", "note", note, False, 1))
        .unionByName(attr(dbp, "dbpedia", "segment", F.array("segment"), False, 0))
    )
    name = F.col("name").alias("s")
    triples = (
        known.select(name, F.lit("P131").alias("p"), F.col("n_name").alias("o"))
        .unionByName(
            known.filter(F.pmod(k, F.lit(2)) == 1).select(name, F.lit("part of").alias("p"), F.concat("r_name", F.lit(" REGION")).alias("o"))
        )
        .unionByName(known.filter("kind = 'customer'").select(name, F.lit("segment").alias("p"), F.col("segment").alias("o")))
    )
    predicates = F.array(*[F.lit(p) for p in ("located in", "segment", "related to", "mentions", "types")])
    by4 = F.pmod(k, F.lit(4))
    other = F.concat(F.lit("NATION_"), F.pmod(F.col("nk") + 1, F.lit(25)).cast("string"))
    obj = F.when(by4 == 0, F.col("n_name")).when(by4 == 1, F.col("r_name")).when(by4 == 2, F.col("segment")).otherwise(other)
    requests = (
        known.select(F.col("name").alias("subject"), F.get(predicates, by5.cast("int")).alias("predicate"), obj.alias("object"))
        .unionByName(known.select(F.col("name").alias("subject"), F.lit("located in").alias("predicate"), F.col("n_name").alias("object")))
        .unionByName(
            nations.select(
                F.concat(F.lit("The "), "r_name", F.lit(" election")).alias("subject"), F.lit("involves").alias("predicate"),
                F.concat(F.lit("vote in "), "n_name").alias("object"),
            )
        )
        .unionByName(
            nations.select(
                F.concat("r_name", F.lit(" "), "n_name").alias("subject"), F.lit("related to").alias("predicate"), F.col("n_name").alias("object")
            )
        )
    )
    return requests, entities, attributes, triples


RESOLVED_CTE = """
pivoted AS (
  SELECT name AS entity, g.entity IS NOT NULL AS has0, w.entity IS NOT NULL AS has1, d.entity IS NOT NULL AS has2,
    nullif(g.description, '') AS d0, nullif(w.description, '') AS d1, nullif(d.description, '') AS d2, g.alias AS a0, w.alias AS a1, d.alias AS a2,
    (SELECT count(*) FROM kg_attrs a WHERE a.entity = name AND a.src = 'google_kg') AS n0
  FROM known LEFT JOIN kg_entities g ON g.entity = name AND g.src = 'google_kg'
  LEFT JOIN kg_entities w ON w.entity = name AND w.src = 'wikidata' LEFT JOIN kg_entities d ON d.entity = name AND d.src = 'dbpedia'),
used AS (
  SELECT *, has0 AS u0, has1 AND NOT (has0 AND d0 IS NOT NULL AND n0 > 0) AS u1,
    has2 AND NOT (has0 AND d0 IS NOT NULL AND n0 > 0)
      AND coalesce(CASE WHEN has0 THEN d0 END, CASE WHEN has1 THEN d1 END) IS NULL AS u2 FROM pivoted),
resolved AS (
  SELECT entity, u0 OR u1 OR u2 AS found, u0, u1, u2,
    concat_ws(' ', CASE WHEN u0 THEN 'google_kg' END, CASE WHEN u1 THEN 'wikidata' END, CASE WHEN u2 THEN 'dbpedia' END) AS sources,
    coalesce(CASE WHEN u0 THEN d0 END, CASE WHEN u1 THEN d1 END, CASE WHEN u2 THEN d2 END, '') AS description,
    concat_ws('|', CASE WHEN u0 THEN a0 END, CASE WHEN u1 THEN a1 END, CASE WHEN u2 THEN a2 END) AS aliases FROM used),
used_attrs AS (
  SELECT a.entity, attr, min(prio * 10 + ord) AS place, max_by({'v': vals, 'l': is_list}, prio * 10 + ord) AS x FROM (
    SELECT a.*, CASE src WHEN 'google_kg' THEN 0 WHEN 'wikidata' THEN 1 ELSE 2 END AS prio FROM kg_attrs a) a
  JOIN resolved r ON r.entity = a.entity AND CASE src WHEN 'google_kg' THEN u0 WHEN 'wikidata' THEN u1 ELSE u2 END GROUP BY a.entity, attr)
"""
SIMILAR_VALUE = sql_similar("x.v[1]", "object")
MATCH_CTE = f"""
facts AS (SELECT DISTINCT subject, predicate, object FROM requests),
matched AS (
  SELECT f.*, place, attr, CASE
    WHEN lower(attr) = replace(lower(predicate), ' ', '_') OR replace(lower(attr), '_', ' ') = lower(predicate)
      THEN CASE WHEN NOT x.l AND {SIMILAR_VALUE} THEN 0.9 END
    WHEN x.l THEN CASE WHEN len(list_filter(x.v, lambda v: {sql_similar('v', 'object')})) > 0 THEN 0.8 END
    WHEN contains(lower(x.v[1]), lower(object)) THEN 0.6 END AS confidence
  FROM facts f JOIN used_attrs a ON a.entity = f.subject),
by_attr AS (
  SELECT subject, predicate, object, min_by(confidence, place) AS confidence FROM matched WHERE confidence IS NOT NULL GROUP BY ALL)
"""
SHARED = "len(list_intersect(list_distinct({0}), list_distinct({1})))".format(sql_words("lower(subject)"), sql_words("lower(object)"))
LEAST = "least(len(list_distinct({0})), len(list_distinct({1})))".format(sql_words("lower(subject)"), sql_words("lower(object)"))


def _has(expr: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{t}')" for t in terms) + ")"


PLAUSIBLE = f"""(lower(predicate) IN ('related to', 'involves', 'mentions', 'about') AND (({SHARED} > 0 AND {SHARED} >= {LEAST} * 0.3)
  OR ({_has('lower(subject)', fixed.CIVIC_SUBJECTS)} AND {_has('lower(object)', fixed.CIVIC_OBJECTS)})
  OR ({_has('lower(subject)', fixed.HEALTH_SUBJECTS)} AND {_has('lower(object)', fixed.HEALTH_OBJECTS)})))"""
VERIFIED_CTE = f"""
verified AS (
  SELECT f.subject, f.predicate, f.object, CASE WHEN {PLAUSIBLE.replace('subject', 'f.subject').replace('object)', 'f.object)').replace('(predicate', '(f.predicate')} THEN 0.5
    WHEN r.found THEN coalesce(b.confidence, CASE WHEN l.s IS NOT NULL THEN 0.7 END, 0.0) ELSE 0.0 END AS confidence
  FROM facts f LEFT JOIN resolved r ON r.entity = f.subject LEFT JOIN by_attr b USING (subject, predicate, object)
  LEFT JOIN (SELECT DISTINCT s, o FROM triples) l ON l.s = f.subject AND l.o = f.object)
"""


@query(
    "resolve_entities",
    with_ctes(KG_CTE, RESOLVED_CTE) + " SELECT entity, found, sources, description, aliases FROM resolved",
)
def resolve_entities(spark, sf_dir):
    known, _ = _known(spark, sf_dir)
    _, entities, attributes, _ = knowledge_tables(spark, sf_dir)
    out = K.resolve_entities(known, entities, attributes, "name")
    joined = {"sources": F.array_join("sources", " "), "aliases": F.array_join("aliases", "|")}
    return out.withColumns(joined).select("entity", "found", "sources", "description", "aliases")


@query(
    "resolved_attributes",
    with_ctes(KG_CTE, RESOLVED_CTE) + " SELECT entity, attr, array_to_string(x.v, '|') AS vals FROM used_attrs",
)
def resolved_attributes(spark, sf_dir):
    known, _ = _known(spark, sf_dir)
    _, entities, attributes, _ = knowledge_tables(spark, sf_dir)
    attrs = K.resolved_attributes(K.resolve_entities(known, entities, attributes, "name"), attributes)
    return attrs.select("entity", "attr", F.array_join("vals", "|").alias("vals"))


@query(
    "match_attributes",
    with_ctes(KG_CTE, RESOLVED_CTE, MATCH_CTE) + " SELECT subject, predicate, object, confidence::DOUBLE AS confidence FROM by_attr",
)
def match_attributes(spark, sf_dir):
    requests, entities, attributes, _ = knowledge_tables(spark, sf_dir)
    resolved = K.resolve_entities(requests, entities, attributes, "subject")
    found = K.match_attributes(requests, K.resolved_attributes(resolved, attributes))
    return found.select("subject", "predicate", "object", "confidence")


@query(
    "triple_exists",
    with_ctes(KG_CTE)
    + """ SELECT DISTINCT subject, object, 0.7::DOUBLE AS confidence FROM requests WHERE EXISTS (SELECT 1 FROM triples WHERE s = subject AND o = object)""",
)
def triple_exists(spark, sf_dir):
    requests, _, _, triples = knowledge_tables(spark, sf_dir)
    return K.triple_exists(requests, triples)


MAPPED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.PREDICATE_PROPERTIES.items())


@query(
    "verify_mapped_predicate",
    with_ctes(KG_CTE)
    + f""" SELECT subject, predicate, object, confidence FROM (
      SELECT DISTINCT subject, predicate, object, CASE
        WHEN EXISTS (SELECT 1 FROM triples WHERE lower(s) = lower(subject) AND lower(o) = lower(object)
          AND p = CASE lower(predicate) {MAPPED} END) THEN 0.85
        WHEN EXISTS (SELECT 1 FROM triples WHERE lower(s) = lower(subject) AND contains(lower(o), lower(object))) THEN 0.6 END::DOUBLE AS confidence
      FROM requests) WHERE confidence IS NOT NULL""",
)
def verify_mapped_predicate(spark, sf_dir):
    requests, _, _, triples = knowledge_tables(spark, sf_dir)
    return K.verify_mapped_predicate(requests, triples)


@query(
    "entity_relations",
    with_ctes(KG_CTE)
    + """ SELECT s AS subject, p AS predicate, o AS object, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o) AS rank FROM (SELECT DISTINCT s, p, o FROM triples)) WHERE rank <= 2""",
)
def entity_relations(spark, sf_dir):
    known, _ = _known(spark, sf_dir)
    _, _, _, triples = knowledge_tables(spark, sf_dir)
    return K.entity_relations(known, triples, 2, "name")


@query(
    "plausible_relation",
    with_ctes(KG_CTE) + f" SELECT DISTINCT subject, predicate, object, {PLAUSIBLE} AS plausible FROM requests",
)
def plausible_relation(spark, sf_dir):
    requests, _, _, _ = knowledge_tables(spark, sf_dir)
    facts = requests.select("subject", "predicate", "object").distinct()
    return facts.withColumn("plausible", K.plausible_relation("subject", "predicate", "object"))


@query(
    "verify_triples",
    with_ctes(KG_CTE, RESOLVED_CTE, MATCH_CTE, VERIFIED_CTE)
    + " SELECT subject, predicate, object, confidence::DOUBLE AS confidence, confidence > 0 AS verified FROM verified",
)
def verify_triples(spark, sf_dir):
    out = K.verify_triples(*knowledge_tables(spark, sf_dir))
    return out.select("subject", "predicate", "object", "confidence", "verified")


PAIRS_CTE = """
order_entities AS (
  SELECT o_orderkey AS claim_id, list_filter([c_name, n_name, CASE WHEN o_orderkey % 3 <> 0 THEN c_mktsegment END, CASE WHEN o_orderkey % 3 = 2 THEN r_name END], lambda e: e IS NOT NULL) AS e
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = n_nationkey),
pairs AS (
  SELECT claim_id, (pair * 2 + rel) AS attempt, e[i] AS subject, e[j] AS object, ['related to', 'involves'][rel + 1] AS predicate FROM (
    SELECT claim_id, e, unnest([0, 1, 2]) AS pair, unnest([1, 1, 2]) AS i, unnest([2, 3, 3]) AS j FROM order_entities WHERE len(e) >= 3
    UNION ALL SELECT claim_id, e, 0, 1, 2 FROM order_entities WHERE len(e) = 2), (SELECT unnest([0, 1]) AS rel))
"""


def _pairs(spark, sf_dir):
    """Every order as a claim that names its customer, nation and more."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    turn = F.pmod("o_orderkey", F.lit(3))
    named = F.array(
        F.col("c_name"), F.col("n_name"), F.when(turn != 0, F.col("c_mktsegment")), F.when(turn == 2, F.col("r_name"))
    )
    return K.entity_pairs(rows.select(F.col("o_orderkey").alias("claim_id"), F.array_compact(named).alias("entities")))


@query(
    "entity_pairs",
    with_ctes(KG_CTE, PAIRS_CTE) + " SELECT claim_id, attempt, subject, predicate, object FROM pairs",
)
def entity_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("claim_id", "attempt", "subject", "predicate", "object")


@query(
    "first_verified",
    with_ctes(
        KG_CTE.replace("requests AS (", "other_requests AS ("), PAIRS_CTE,
        "requests AS (SELECT DISTINCT subject, predicate, object FROM pairs)", RESOLVED_CTE, MATCH_CTE, VERIFIED_CTE,
    )
    + """ SELECT claim_id, min_by(confidence, attempt)::DOUBLE AS kg_score, min_by(subject || ' ' || predicate || ' ' || object, attempt) AS kg_fact
      FROM pairs JOIN verified USING (subject, predicate, object) WHERE confidence > 0 GROUP BY claim_id""",
)
def first_verified(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    _, entities, attributes, triples = knowledge_tables(spark, sf_dir)
    return rounded(K.first_verified(pairs, K.verify_triples(pairs, entities, attributes, triples)))
