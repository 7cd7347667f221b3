"""Queries on identifiers, texts and the projections that cards, prompts and works are made of, over `documents` and others."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import identifiers as I
from paperloom.functions import text as T
from paperloom.functions import works as W
from paperloom.functions.vectors import cosine, doubles, mean_vector
from paperloom.operators import predicates, topics
from paperloom.plans.interest import cos
from paperloom.plans.library import P, papers
from paperloom.plans.registry import query, table

NORM = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\r]+'), lambda x: x <> '')"

NAMES = "CASE paper_id % 4 WHEN 0 THEN lang || '-X, ' || source WHEN 1 THEN source || '  ' || upper(lang) || ' ' WHEN 2 THEN '' END"


def name(i="paper_id"):
    i = F.col(i)
    return F.when(i % 4 == 0, F.concat("lang", F.lit("-X, "), "source")).when(i % 4 == 1, F.concat("source", F.lit("  "), F.upper("lang"), F.lit(" "))).when(i % 4 == 2, "")


@query("f03_surnames", P + f"SELECT paper_id, CASE WHEN coalesce(n, '') = '' THEN '' WHEN contains(n, ',') THEN {NORM.format('split_part(n, chr(44), 1)')} ELSE {NORM.format('list_last(regexp_split_to_array(trim(n), chr(32) || chr(43)))')} END AS surname FROM (SELECT paper_id, {NAMES} AS n FROM p)")
def f03(spark, d):
    return papers(spark, d).select("paper_id", T.surname(name()).alias("surname"))


DOIS = """, x AS (SELECT paper_id, CASE paper_id % 6 WHEN 0 THEN 'https://doi.org/10.1000/A' || paper_id WHEN 1 THEN 'doi:10.1000/' || paper_id || '.;' WHEN 2 THEN ' HTTP://DX.DOI.ORG/10.1000/x' || paper_id || ',' WHEN 3 THEN 'http://doi.org/doi:10.2/' || paper_id WHEN 4 THEN 'n/a' END AS doi FROM p)
"""


def dois(spark, d):
    i = F.col("paper_id")
    doi = F.when(i % 6 == 0, F.concat(F.lit("https://doi.org/10.1000/A"), i)).when(i % 6 == 1, F.concat(F.lit("doi:10.1000/"), i, F.lit(".;"))).when(i % 6 == 2, F.concat(F.lit(" HTTP://DX.DOI.ORG/10.1000/x"), i, F.lit(","))).when(i % 6 == 3, F.concat(F.lit("http://doi.org/doi:10.2/"), i)).when(i % 6 == 4, "n/a")
    return papers(spark, d).select("paper_id", doi.alias("doi"))


@query("f05_doi_forms", P + DOIS + """, y AS (SELECT paper_id, lower(trim(doi)) AS l FROM x)
SELECT paper_id, coalesce(regexp_replace(l, '^(https://doi\\.org/)?(http://doi\\.org/)?(doi:)?', ''), '') AS key_form,
  trim(coalesce(regexp_replace(l, '^(https://doi\\.org/)?(http://doi\\.org/)?(https://dx\\.doi\\.org/)?(http://dx\\.doi\\.org/)?(doi:)?', ''), '')) AS seed_form,
  CASE WHEN regexp_replace(l, '^(https?://(dx\\.)?doi\\.org/|doi:)', '') LIKE '10.%' THEN rtrim(trim(regexp_replace(l, '^(https?://(dx\\.)?doi\\.org/|doi:)', '')), '.,;') END AS strict_form FROM y""")
def f05(spark, d):
    return dois(spark, d).select("paper_id", F.coalesce(T.plain_doi(F.col("doi")), F.lit("")).alias("key_form"), I.seed_doi(F.col("doi")).alias("seed_form"), T.doi_key(F.col("doi")).alias("strict_form"))


@query("f06_bare_ids", P + """, x AS (SELECT paper_id, CASE paper_id % 4 WHEN 0 THEN 'https://openalex.org/T' || paper_id WHEN 1 THEN 'https://openalex.org/subfields/' || paper_id WHEN 2 THEN 't' || paper_id ELSE ' https://else.org/a/t' || paper_id || ' ' END AS i FROM p)
SELECT paper_id, replace(i, 'https://openalex.org/', '') AS pool_form, list_last(string_split(i, '/')) AS tier_form, CASE WHEN i LIKE 'https://openalex.org/%' THEN list_last(string_split(i, '/')) ELSE i END AS filter_form, upper(list_last(string_split(trim(i), '/'))) AS code FROM x""")
def f06(spark, d):
    k, n = F.col("paper_id") % 4, F.col("paper_id").cast("string")
    i = F.when(k == 0, F.concat(F.lit("https://openalex.org/T"), n)).when(k == 1, F.concat(F.lit("https://openalex.org/subfields/"), n)).when(k == 2, F.concat(F.lit("t"), n)).otherwise(F.concat(F.lit(" https://else.org/a/t"), n, F.lit(" ")))
    x = papers(spark, d).select("paper_id", i.alias("i"))
    return x.select("paper_id", I.pool_id(F.col("i")).alias("pool_form"), T.bare_id(F.col("i")).alias("tier_form"), I.filter_id(F.col("i")).alias("filter_form"), I.code(F.col("i")).alias("code"))


@query("f08_identifiers", P + """, x AS (SELECT paper_id, CASE paper_id % 3 WHEN 0 THEN 'https://x.org/pmc/PMC' || paper_id || '/' WHEN 1 THEN ' pmc' || paper_id ELSE 'none' END AS pm, CASE paper_id % 3 WHEN 0 THEN 'https://ROR.org/0' || paper_id || 'X/' WHEN 1 THEN '' ELSE '0' || paper_id END AS ro,
  CASE WHEN paper_id % 2 = 0 THEN 'https://ORCID.org/' ELSE '' END || '0000-0002-' || lpad(CAST(paper_id % 10000 AS VARCHAR), 4, '0') || '-009' || (CASE paper_id % 11 WHEN 10 THEN 'x' ELSE CAST(paper_id % 11 AS VARCHAR) END) AS oc FROM p),
y AS (SELECT *, regexp_extract(lower(oc), '[0-9x-]+$') AS b, [CAST(c AS INT) FOR c IN string_split(regexp_replace(left(regexp_extract(lower(oc), '[0-9x-]+$'), 18), '-', '', 'g'), '')] AS g FROM x),
z AS (SELECT *, (12 - list_reduce(list_concat([0], g), lambda t, n: (t + n) * 2) % 11) % 11 AS ck FROM y)
SELECT paper_id, CASE WHEN regexp_replace(pm, '[^0-9]', '', 'g') <> '' THEN 'PMC' || regexp_replace(pm, '[^0-9]', '', 'g') END AS pmcid, nullif(rtrim(lower(regexp_replace(ro, '^(https?://)?ror\\.org/', '', 'i')), '/'), '') AS ror,
  CASE WHEN right(b, 1) = (CASE ck WHEN 10 THEN 'x' ELSE CAST(ck AS VARCHAR) END) THEN upper(b) END AS orcid FROM z""")
def f08(spark, d):
    i = F.col("paper_id")
    pm = F.when(i % 3 == 0, F.concat(F.lit("https://x.org/pmc/PMC"), i, F.lit("/"))).when(i % 3 == 1, F.concat(F.lit(" pmc"), i)).otherwise("none")
    ro = F.when(i % 3 == 0, F.concat(F.lit("https://ROR.org/0"), i, F.lit("X/"))).when(i % 3 == 1, "").otherwise(F.concat(F.lit("0"), i))
    last = F.when(i % 11 == 10, "x").otherwise((i % 11).cast("string"))
    oc = F.concat(F.when(i % 2 == 0, "https://ORCID.org/").otherwise(""), F.lit("0000-0002-"), F.lpad((i % 10000).cast("string"), 4, "0"), F.lit("-009"), last)
    return papers(spark, d).select("paper_id", I.pmcid(pm).alias("pmcid"), I.ror(ro).alias("ror"), I.orcid(oc).alias("orcid"))


@query("f09_institution_keys", P + """, x AS (SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN 'The Université d''Été, ' ELSE 'Universität  Straße ' END || title AS t FROM p)
SELECT paper_id, regexp_replace(trim(regexp_replace(replace(lower(strip_accents(t)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), '^the ', '') AS key FROM x""")
def f09(spark, d):
    head = F.when(F.col("paper_id") % 2 == 0, "The Université d'Été, ").otherwise("Universität  Straße ")
    return papers(spark, d).select("paper_id", I.institution_key(F.concat(head, "title")).alias("key"))


@query("f10_inverted_index", P + f"SELECT paper_id, array_to_string({WORDS.format('title')}, ' ') AS text FROM p WHERE len({WORDS.format('title')}) > 0")
def f10(spark, d):
    """Words with their places, as indexes come, and the text back from them."""
    words = papers(spark, d).select("paper_id", F.posexplode(T.word_array(F.col("title"))).alias("at", "word"))
    index = words.groupBy("paper_id", "word").agg(F.collect_list("at").alias("places")).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("m"))
    return index.select("paper_id", T.inverted_text(F.col("m")).alias("text"))


EMBED = f""", x AS (SELECT paper_id, title AS ti, CASE WHEN paper_id % 3 <> 0 THEN array_to_string(ws[1:(paper_id * 13) % 700], ' ') ELSE '' END AS ab, CASE WHEN paper_id % 2 = 0 THEN lang || '; ' || source ELSE '' END AS me, source AS ke, CASE WHEN paper_id % 5 = 0 THEN 'a b; c' ELSE '' END AS su, array_to_string(ws, ' ') AS bo, ws,
  len({WORDS.format('title')}) AS nt FROM w),
n AS (SELECT *, CASE WHEN ti <> '' THEN nt + 1 ELSE 0 END AS t1, CASE WHEN ab <> '' THEN len({WORDS.format('ab')}) + 1 ELSE 0 END AS t2, CASE WHEN me <> '' THEN len({WORDS.format('me')}) + 1 ELSE 0 END AS t3, CASE WHEN ke <> '' THEN len({WORDS.format('ke')}) + 1 ELSE 0 END AS t4, CASE WHEN su <> '' THEN len({WORDS.format('su')}) + 1 ELSE 0 END AS t5, CASE WHEN bo <> '' THEN len(ws) + 1 ELSE 0 END AS t6 FROM x),
k AS (SELECT *, t1 + t2 + t3 + t4 + t5 + t6 <= 64 AS b, t1 + t2 + t3 + t4 + t5 <= 64 OR t1 + t2 + t3 + t4 + t5 + t6 <= 64 AS s, t1 + t2 + t3 + t4 <= 64 AS kk, t1 + t2 + t3 <= 64 AS m, greatest(64 - t1 - 1, 0) AS room FROM n)
"""


@query("f11_embedding_text", P.replace("k AS (SELECT", "k0 AS (SELECT").replace("FROM k)", "FROM k0)") + EMBED + f""", r AS (SELECT *, CASE WHEN t1 + t2 <= 64 THEN ab ELSE array_to_string(({WORDS.format('ab')})[1:room], ' ') END AS ab2,
  64 - t1 - (CASE WHEN m THEN t3 ELSE 0 END) - (CASE WHEN kk THEN t4 ELSE 0 END) - (CASE WHEN s THEN t5 ELSE 0 END) - 1 AS left_over FROM k)
SELECT paper_id, array_to_string(list_filter([CASE WHEN ti <> '' THEN 'TITLE: ' || ti END, CASE WHEN ab2 <> '' THEN 'ABSTRACT: ' || ab2 END, CASE WHEN me <> '' AND m THEN 'MESH: ' || me END, CASE WHEN ke <> '' AND kk THEN 'KEYWORDS: ' || ke END, CASE WHEN su <> '' AND s THEN 'SUBSTANCES: ' || su END,
  CASE WHEN b AND bo <> '' THEN 'BODY: ' || bo WHEN ab = '' AND bo <> '' AND left_over > 0 THEN 'BODY: ' || array_to_string(ws[1:left_over], ' ') END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text FROM r""")
def f11(spark, d):
    """Labelled sections within 64 tokens; the rule's own budget is 512."""
    i = F.col("paper_id")
    p = papers(spark, d).withColumn("ws", T.word_array(F.col("text")))
    body = F.array_join("ws", " ")
    abstract = F.when(i % 3 != 0, F.array_join(F.slice("ws", 1, ((i * 13) % 700).cast("int")), " ")).otherwise("")
    x = p.select("paper_id", "title", abstract.alias("abstract"), F.when(i % 2 == 0, F.concat("lang", F.lit("; "), "source")).otherwise("").alias("mesh"), F.col("source").alias("keywords"), F.when(i % 5 == 0, "a b; c").otherwise("").alias("substances"), body.alias("body"))
    return x.select("paper_id", W.embedding_text(64).alias("text"))


@query("f15_paper_doi", P + """, x AS (SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN 'see 210.1234/no 1.10.1234/no, doi 10.1234/Ab.' || paper_id || ').' ELSE 'front' END AS page, CASE WHEN paper_id % 3 = 1 THEN 'doi:10.55555/m_' || paper_id END AS meta, 'cites 10.99999/r;' || paper_id || ': and 10.1/x' AS body FROM p),
y AS (SELECT paper_id, rtrim(regexp_extract(page, '(^|[^0-9.])(10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]{1,80})', 2), '.,;:)') AS a, rtrim(regexp_extract(coalesce(meta, ''), '(^|[^0-9.])(10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]{1,80})', 2), '.,;:)') AS b, rtrim(regexp_extract(body, '(^|[^0-9.])(10\\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]{1,80})', 2), '.,;:)') AS c FROM x)
SELECT paper_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) AS doi FROM y""")
def f15(spark, d):
    i = F.col("paper_id").cast("string")
    page = F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit("see 210.1234/no 1.10.1234/no, doi 10.1234/Ab."), i, F.lit(")."))).otherwise("front")
    meta = F.when(F.col("paper_id") % 3 == 1, F.concat(F.lit("doi:10.55555/m_"), i))
    body = F.concat(F.lit("cites 10.99999/r;"), i, F.lit(": and 10.1/x"))
    return papers(spark, d).select("paper_id", I.own_doi(page, meta, body).alias("doi"))


@query("f17_reading_text", P + """, x AS (SELECT paper_id, title, CASE paper_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE left(text, 80) END AS ab, CASE WHEN paper_id % 8 < 4 THEN 'journal' || chr(10) || chr(11) || chr(10) || chr(10) || text ELSE text END AS bo FROM p),
y AS (SELECT *, CASE WHEN trim(coalesce(ab, ''), ' ' || chr(10) || chr(9) || chr(13)) <> '' THEN ab ELSE left(CASE WHEN position(chr(10) || chr(11) || chr(10) IN bo) > 0 THEN ltrim(substr(bo, position(chr(10) || chr(11) || chr(10) IN bo) + 3), chr(10)) ELSE coalesce(bo, '') END, 1000) END AS body FROM x)
SELECT paper_id, CASE WHEN trim(title) <> '' AND body <> '' THEN trim(title) || chr(10) || chr(10) || body WHEN trim(title) <> '' THEN trim(title) ELSE body END AS reading FROM y""")
def f17(spark, d):
    i = F.col("paper_id")
    abstract = F.when(i % 4 == 0, "  ").when(i % 4 != 1, F.substring("text", 1, 80))
    body = F.when(i % 8 < 4, F.concat(F.lit("journal\n\x0b\n\n"), "text")).otherwise(F.col("text"))
    return papers(spark, d).select("paper_id", W.concept_text(F.col("title"), abstract, body, 1000).alias("reading"))


CARD = """, c AS (SELECT paper_id, title, year, [paper_id % 6, paper_id % 4, paper_id % 6, paper_id % 9] AS ids, [1, 3, 5, 7] AS active, CASE WHEN paper_id % 7 <> 0 THEN (cited * 7919 % 1000) / 1000.0 END AS pct, CASE WHEN paper_id % 5 <> 0 THEN (cited * 104729 % 10000) / 10000.0 END AS sim, cited / 101.0 AS score,
  CASE WHEN paper_id % 10 = 0 THEN NULL ELSE array_to_string(ws, ' ') END AS ab, ws, CASE WHEN paper_id % 3 = 0 THEN '2024-02-0' || (1 + paper_id % 9) END AS pd, source FROM w)
"""


@query("p17_cards", P + CARD + """SELECT paper_id, coalesce(pd, CASE WHEN year IS NOT NULL THEN year || '-01-01' END, '') AS date, floor(coalesce(pct, score) * 10000 + 1e-9) / 10000 AS score, floor(sim * 10000 + 1e-9) / 10000 AS similarity, floor(coalesce(sim, pct, score) * 10000 + 1e-9) / 10000 AS centroid_cos,
  CASE WHEN sim IS NOT NULL THEN CASE WHEN sim < 0.4 THEN 'low' WHEN sim >= 0.8 THEN 'high' ELSE 'medium' END WHEN coalesce(pct, score) >= 0.9 THEN 'high' WHEN coalesce(pct, score) >= 0.67 THEN 'medium' ELSE 'low' END AS bucket,
  array_to_string([x for x, i in ['T' || v FOR v IN ids] IF list_position(ids, ids[i]) = i], ';') AS terms, array_to_string(['T' || v FOR v, i IN ids IF list_contains(active, v) AND list_position(ids, v) = i], ';') AS matched,
  round(len(list_filter(list_distinct(ids), lambda v: list_contains(active, v))) / len(list_distinct(ids))::DOUBLE, 3) AS topic_match, CASE WHEN ab IS NULL THEN 2 ELSE greatest(2, round_even(len(ws) / 200.0, 0))::INT END AS mins FROM c""".replace("[x for x, i in ['T' || v FOR v IN ids] IF list_position(ids, ids[i]) = i]", "['T' || v FOR v, i IN ids IF list_position(ids, v) = i]"))
def p17(spark, d):
    """F-24, F-25 as well: a card out of a candidate's row and its paper."""
    i, cited = F.col("paper_id"), F.col("cited")
    topic = lambda x: F.struct(x.cast("string").alias("id"), F.concat(F.lit("T"), x.cast("string")).alias("display_name"))
    c = papers(spark, d).select("paper_id", "year", topic(i % 6).alias("primary_topic"), F.array(topic(i % 4), topic(i % 6), topic(i % 9)).alias("topics"), F.array(*[F.lit(str(x)) for x in (1, 3, 5, 7)]).alias("active"), F.when(i % 7 != 0, cited * 7919 % 1000 / 1000.0).alias("score_pct"), F.when(i % 5 != 0, cited * 104729 % 10000 / 10000.0).alias("score_raw"), (cited / 101.0).alias("score"), F.when(i % 10 != 0, F.col("text")).alias("abstract"), F.when(i % 3 == 0, F.concat(F.lit("2024-02-0"), 1 + i % 9)).alias("publication_date"), F.lit(0.4).alias("threshold"), F.lit(0.8).alias("seed_sim_min"))
    out = W.cards(c)
    return out.select("paper_id", "date", "score", "similarity", "centroid_cos", "bucket", F.array_join("terms", ";").alias("terms"), F.array_join("matched", ";").alias("matched"), "topic_match", F.col("mins").cast("int").alias("mins"))


@query("p15_slim_works", P + f"""SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN '10.1/' || paper_id ELSE 'doi:10.1/' || paper_id END AS doi, CASE WHEN paper_id % 3 = 0 THEN 'best' || paper_id WHEN paper_id % 3 = 1 THEN 'first' || paper_id END AS pdf_url, CAST(least(5, paper_id % 8) AS INT) AS n_topics, CAST(least(8, paper_id % 12) AS INT) AS n_concepts, array_to_string(list_transform(range(0, least(5, paper_id % 8)), lambda i: 'T' || (paper_id + i)), ';') AS topics,
  CASE WHEN paper_id % 5 = 0 THEN source ELSE source || ';' || lang END AS authors, array_to_string({WORDS.format('title')}, ' ') AS abstract, source AS venue FROM p WHERE len({WORDS.format('title')}) > 0""")
def p15(spark, d):
    """P-15 and P-16: of a raw work the parts that a paper keeps."""
    i = F.col("paper_id")
    words = papers(spark, d).select("paper_id", F.posexplode(T.word_array(F.col("title"))).alias("at", "word"))
    index = words.groupBy("paper_id", "word").agg(F.collect_list("at").alias("places")).groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("abstract_inverted_index"))
    many = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), f)).otherwise(F.array())
    author = lambda c: F.struct(F.struct(c.alias("display_name")).alias("author"))
    raw = papers(spark, d).join(index, "paper_id").select(
        "paper_id",
        F.when(i % 2 == 0, F.concat(F.lit("https://doi.org/10.1/"), i)).otherwise(F.concat(F.lit("doi:10.1/"), i)).alias("doi"),
        F.struct(F.when(i % 3 == 0, F.concat(F.lit("best"), i)).alias("pdf_url")).alias("best_oa_location"),
        F.struct(F.when(i % 3 != 2, F.concat(F.lit("first"), i)).alias("pdf_url"), F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"),
        many(i % 8, lambda k: F.struct(F.concat(F.lit("T"), i + k).alias("id"))).alias("topics"),
        many(i % 12, lambda k: F.struct(k.alias("level"))).alias("concepts"),
        F.array(author(F.col("source")), author(F.when(i % 5 != 0, F.col("lang"))), author(F.lit(""))).alias("authorships"),
        "abstract_inverted_index",
    )
    w = W.paper_of(W.slim(raw))
    return w.select("paper_id", "doi", "pdf_url", F.size("topics").alias("n_topics"), F.size("top_concepts").alias("n_concepts"), F.array_join(F.transform("topics", lambda t: t["id"]), ";").alias("topics"), F.array_join("authors", ";").alias("authors"), "abstract", "venue")


@query("f28_event_lines", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || '  ' || upper(event_type) || '  ' || CASE event_id % 3 WHEN 0 THEN 'A title ' || event_id WHEN 1 THEN '10.1/' || event_id ELSE 'W' || event_id END || '  ' || CASE WHEN event_id % 4 = 0 THEN 'score=NA' ELSE 'score=' || printf('%.3f', (event_id % 1000) / 1000.0) END AS line FROM events""")
def f28(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("action"), F.when(i % 3 == 0, F.concat(F.lit(" A \n title  "), i)).alias("title"), F.when(i % 3 == 1, F.concat(F.lit("10.1/"), i)).alias("doi"), F.concat(F.lit("W"), i).alias("paper_id"), F.when(i % 4 != 0, i % 1000 / 1000.0).alias("score"))
    return e.select("event_id", W.event_line().alias("line"))


@query("f29_json_checks", """WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN '{"k": [1, 2, ' WHEN 2 THEN '{"k": [1, 2]}' WHEN 3 THEN '{"k": null}' ELSE '{"k": "a"}' END AS j FROM events)
SELECT event_id, json_valid(j) AS valid, CASE WHEN json_valid(j) THEN CASE json_type(j, '$.k') WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'text' ELSE 'number' END END AS type, CASE WHEN json_valid(j) AND json_type(j, '$.k') = 'ARRAY' THEN CAST(json_array_length(j, '$.k') AS INT) END AS n FROM x""")
def f29(spark, d):
    k = F.col("event_id") % 5
    j = F.when(k == 0, F.col("props")).when(k == 1, '{"k": [1, 2, ').when(k == 2, '{"k": [1, 2]}').when(k == 3, '{"k": null}').otherwise('{"k": "a"}')
    v = F.try_parse_json("j")
    of = F.schema_of_variant(F.variant_get(v, "$.k", "variant"))
    kind = F.when(of.startswith("ARRAY"), "array").when(of == "VOID", "null").when(of == "STRING", "text").otherwise("number")
    return table(spark, d, "events").select("event_id", j.alias("j")).select("event_id", v.isNotNull().alias("valid"), F.when(v.isNotNull(), kind).alias("type"), F.json_array_length(F.get_json_object("j", "$.k")).alias("n"))


ON = "CASE c_custkey % 11 WHEN 0 THEN '' WHEN 1 THEN ', \"on\": null' WHEN 2 THEN ', \"on\": true' WHEN 3 THEN ', \"on\": false' WHEN 4 THEN ', \"on\": 0' WHEN 5 THEN ', \"on\": 2' WHEN 6 THEN ', \"on\": \"\"' WHEN 7 THEN ', \"on\": \"x\"' WHEN 8 THEN ', \"on\": []' WHEN 9 THEN ', \"on\": [0]' ELSE ', \"on\": {}' END"


@query("p09_enabled_topics", f"""WITH x AS (SELECT c_custkey AS profile, '[{{"id": "T1"' || {ON} || '}}, {{"id": "T2"}}, {{"on": true}}, {{"id": "T3", "on": false}}, {{"id": "T' || c_custkey || '", "on": true}}]' AS j FROM customer)
SELECT profile, CASE WHEN profile % 11 IN (0, 2, 5, 7, 9) THEN 'T1,T2,T' || profile ELSE 'T2,T' || profile END AS enabled FROM x""")
def p09(spark, d):
    """P-09 and F-30: the ids of the topics that are on, in their order, whatever the flag looks like."""
    k = F.col("c_custkey")
    flags = ["", ', "on": null', ', "on": true', ', "on": false', ', "on": 0', ', "on": 2', ', "on": ""', ', "on": "x"', ', "on": []', ', "on": [0]', ', "on": {}']
    on = F.element_at(F.array(*map(F.lit, flags)), (k % 11 + 1).cast("int"))
    j = F.concat(F.lit('[{"id": "T1"'), on, F.lit('}, {"id": "T2"}, {"on": true}, {"id": "T3", "on": false}, {"id": "T'), k, F.lit('", "on": true}]'))
    return table(spark, d, "customer").select(k.alias("profile"), F.array_join(predicates.enabled_ids(j), ",").alias("enabled"))


@query("p10_filter_strings", """WITH x AS (SELECT c_custkey AS profile, list_transform(range(0, c_custkey % 14), lambda i: 'T' || i) AS t, list_transform(range(0, c_custkey % 3), lambda i: 'S' || i) AS s, CASE WHEN c_custkey % 2 = 0 THEN '2024-06-30' END AS until FROM customer),
y AS (SELECT profile, t, 'from_publication_date:2024-01-01' || CASE WHEN until IS NOT NULL THEN ',to_publication_date:' || until ELSE '' END || ',type:article' || CASE WHEN len(t) > 0 THEN ',topics.id:' || array_to_string(t, '|') ELSE '' END || CASE WHEN len(s) > 0 THEN ',' || array_to_string(list_transform(s, lambda v: 'topics.subfield.id:' || v), ',') ELSE '' END AS filter FROM x)
SELECT profile, filter, len(t) > 10 AS wide FROM y""")
def p10(spark, d):
    """P-10 and P-22: filters of a tier, and whether one ORs many topics."""
    k = F.col("c_custkey")
    many = lambda n, head: F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.concat(F.lit(head), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    parts = [("topics.id", many(k % 14, "T"), "or"), ("topics.subfield.id", many(k % 3, "S"), "and")]
    f = predicates.filter_string(parts, F.lit("2024-01-01"), F.when(k % 2 == 0, "2024-06-30"), "type:article")
    return table(spark, d, "customer").select(k.alias("profile"), f.alias("filter")).select("profile", "filter", predicates.is_wide(F.col("filter")).alias("wide"))


@query("p12_usable_mentions", P + f""", x AS (SELECT paper_id, title, CASE WHEN paper_id % 3 = 0 THEN 'x = 2 + 3.5 [a] ' || lang ELSE title END AS sentence, CASE WHEN paper_id % 4 = 0 THEN 'D-1' ELSE source || '?' END AS word FROM p),
y AS (SELECT *, {WORDS.format('sentence')} AS t FROM x)
SELECT paper_id, (length(regexp_replace(word, '[^A-Za-z0-9]', '', 'g')) > 3 OR paper_id % 8 = 0) AND len(t) > 0 AND NOT (len(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z][a-z]{{2,}}[.,;:)]?$'))) / greatest(len(t), 1)::DOUBLE < 0.5) AS usable FROM y""")
def p12(spark, d):
    i = F.col("paper_id")
    sentence = F.when(i % 3 == 0, F.concat(F.lit("x = 2 + 3.5 [a] "), "lang")).otherwise(F.col("title"))
    word = F.when(i % 4 == 0, "D-1").otherwise(F.concat("source", F.lit("?")))
    return papers(spark, d).select("paper_id", predicates.usable_mention(word, sentence, i % 8 == 0).alias("usable"))


@query("p14_year_spans", """WITH x AS (SELECT c_custkey AS profile, 1890 + c_custkey % 140 AS f, CASE WHEN c_custkey % 3 <> 0 THEN 1950 + c_custkey % 80 END AS t FROM customer),
y AS (SELECT *, f BETWEEN 1900 AND 2024 AND (t IS NULL OR t BETWEEN 1900 AND 2024) AND (t IS NULL OR f <= t) AS ok, coalesce(t, 2024) AS e FROM x)
SELECT profile, ok, CASE WHEN ok THEN greatest(f, e - 14) END AS first_year, CASE WHEN ok THEN e END AS last_year, CASE WHEN ok THEN greatest(1, least(40, 600 // (e - greatest(f, e - 14) + 1))) END AS quota FROM y""")
def p14(spark, d):
    """P-14 and T-10: years that a fetch covers, and the trial's quota a year."""
    k = F.col("c_custkey")
    x = table(spark, d, "customer").select(k.alias("profile"), (1890 + k % 140).alias("f"), F.when(k % 3 != 0, 1950 + k % 80).alias("t"))
    x = x.withColumn("ok", predicates.fair_range(F.col("f"), F.col("t"), 2024))
    span = x.withColumn("s", F.when(F.col("ok"), predicates.fetch_span(F.col("f"), F.col("t"), 2024)))
    return span.select("profile", "ok", F.col("s.first").alias("first_year"), F.col("s.last").alias("last_year"), predicates.trial_quota(F.col("s.last") - F.col("s.first") + 1).alias("quota"))


@query("p23_stored_topics", P + """SELECT paper_id, CASE paper_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '{"source": "other", "id": ' || paper_id || '}' ELSE 'broken {' END AS topics FROM p""")
def p23(spark, d):
    """Topics that were guessed from a text count as none; a broken value stays as it is."""
    i = F.col("paper_id")
    raw = F.when(i % 3 == 0, F.lit('{"source": "pdf_content", "id": 1}')).when(i % 3 == 1, F.concat(F.lit('{"source": "other", "id": '), i, F.lit("}"))).otherwise("broken {")
    return papers(spark, d).select("paper_id", predicates.stored_topics(raw).alias("topics"))


@query("f32_recent_events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, date_diff('day', CAST(ts AS DATE), DATE '2024-01-20') AS days_ago, upper(strftime(ts, '%a %d %b %Y')) AS label, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY")
def f32(spark, d):
    """F-26 and F-32, for a given moment in place of the clock."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events").where(F.col("ts") >= now - F.expr("interval 10 days"))
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.datediff(now, "ts").cast("long").alias("days_ago"), F.upper(F.date_format("ts", "EEE dd MMM yyyy")).alias("label"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("f34_prompts", P + """, x AS (SELECT lang, paper_id, row_number() OVER (PARTITION BY lang ORDER BY cited DESC, paper_id) AS n, CASE WHEN paper_id % 5 = 0 THEN '' ELSE trim(title) END AS title, text, ws FROM w WHERE lang IS NOT NULL QUALIFY n <= 5),
y AS (SELECT *, '[' || n || '] ' || CASE WHEN title = '' THEN 'untitled' ELSE title END || ' — ' || CASE WHEN len(ws) <= 500 THEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) ELSE array_to_string(ws[1:500], ' ') || ' …' END AS line FROM x)
SELECT lang, 'Passages:' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question: what is new?' AS prompt FROM y GROUP BY lang""")
def f34(spark, d):
    """The five most cited papers of each language as numbered passages of a prompt."""
    p = papers(spark, d).where("lang is not null").withColumn("title", F.when(F.col("paper_id") % 5 == 0, "").otherwise(F.col("title")))
    best = topics.most_cited(p, "lang", 5)
    return W.prompts(best, "lang", "rank", "what is new?").select("lang", "prompt")


@query("f35_slug_lists", """SELECT event_id % 300 AS paper_id, '|' || string_agg(DISTINCT 'p' || user_id % 10, '|' ORDER BY 'p' || user_id % 10) || '|' AS slugs FROM events GROUP BY 1""")
def f35(spark, d):
    e = table(spark, d, "events").groupBy((F.col("event_id") % 300).alias("paper_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("user_id") % 10))).alias("s"))
    return e.select("paper_id", F.concat(F.lit("|"), F.array_join("s", "|"), F.lit("|")).alias("slugs"))


@query("f37_topic_texts", """SELECT p_partkey AS topic_id, trim(p_name || '. ' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END) || CASE WHEN p_size % 5 >= p_size % 3 THEN ' Keywords: ' || p_brand || '; ' || p_type ELSE ' Keywords: ' || p_type || '; ' || p_brand END AS text FROM part""")
def f37(spark, d):
    word = lambda n, s: F.struct(n.alias("display_name"), s.cast("double").alias("score"))
    p = table(spark, d, "part")
    words = F.array(word(F.col("p_brand"), F.col("p_size") % 5), word(F.col("p_type"), F.col("p_size") % 3), word(F.lit(""), F.lit(9)))
    return p.select(F.col("p_partkey").alias("topic_id"), W.topic_text(F.col("p_name"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")), words).alias("text"))


@query("f38_mention_windows", P + """, x AS (SELECT paper_id, text, greatest(position('de' IN text) - 1, 0) + 1 AS a FROM p WHERE text IS NOT NULL)
SELECT paper_id, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, CAST(greatest(0, least(a - 500, length(text) - 1000)) AS INT) + 1, 1000) END AS part FROM x""")
def f38(spark, d):
    at = F.greatest(F.instr("text", "de") - 1, F.lit(0)) + 1
    return papers(spark, d).where("text is not null").select("paper_id", W.around(F.col("text"), at, 1000).alias("part"))


@query("f39_centroid_drift", f"""WITH g AS (SELECT label, t.i AS i, avg(CAST(embedding[t.i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM g GROUP BY label)
SELECT a.label AS profile, round(greatest(0, least(1, ({cos('a.v', 'b.v')} + 1) / 2)), 6) AS drift FROM c a JOIN c b ON b.label = a.label + 1""")
def f39(spark, d):
    c = mean_vector(table(spark, d, "embeddings").select("label", doubles(F.col("embedding")).alias("v")), "label", "v", "v")
    b = c.select((F.col("label") - 1).alias("label"), F.col("v").alias("w"))
    drift = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(F.col("v"), F.col("w")) + 1) / 2))
    return c.join(b, "label").select(F.col("label").alias("profile"), F.round(drift, 6).alias("drift"))


@query("f41_short_title_keys", P + f"""SELECT paper_id, CASE WHEN paper_id % 3 = 2 OR {NORM.format("left(title, 12)")} = '' THEN '' ELSE 'short:' || CASE paper_id % 3 WHEN 0 THEN 'dataset' ELSE 'preprint' END || '|' || {NORM.format("left(title, 12)")} || '|' || year || '|' || array_to_string(list_sort([{NORM.format('source')}, {NORM.format('lang')}]), ',') || '|' || CASE WHEN paper_id % 2 = 0 THEN 7 ELSE 2 END END AS key FROM p""")
def f41(spark, d):
    i = F.col("paper_id")
    kind = F.when(i % 3 == 0, "dataset").when(i % 3 == 1, "preprint").otherwise("article")
    return papers(spark, d).select("paper_id", I.short_title_key(kind, F.substring("title", 1, 12), F.col("year"), F.array("source", "lang"), F.when(i % 2 == 0, 7)).alias("key"))


@query("f42_claimed", P + """, r AS (SELECT DISTINCT paper_id % 20 AS person, dk FROM k WHERE dk IS NOT NULL AND paper_id % 3 = 0), t AS (SELECT DISTINCT paper_id % 20 AS person, norm FROM k WHERE length(norm) >= 30 AND paper_id % 5 = 0), s AS (SELECT paper_id, paper_id % 20 AS person, dk, CASE WHEN length(norm) >= 30 THEN norm END AS tk FROM k)
SELECT paper_id, CAST(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.person = s.person AND r.dk = s.dk) OR EXISTS (SELECT 1 FROM t WHERE t.person = s.person AND t.norm = s.tk) THEN true WHEN (dk IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.person = s.person)) OR (tk IS NOT NULL AND EXISTS (SELECT 1 FROM t WHERE t.person = s.person)) THEN false END AS INT) AS claimed FROM s""")
def f42(spark, d):
    """Whether a person's registry record lists a work: true, false, or null where nothing can be compared."""
    i = F.col("paper_id")
    w = papers(spark, d).select("paper_id", (i % 20).alias("person"), T.doi_key(F.col("doi")).alias("doi"), F.nullif(T.title_key(F.col("title")), F.lit("")).alias("title_key"))
    return I.claimed(w, w.where("doi is not null and paper_id % 3 = 0").select("person", "doi"), w.where("title_key is not null and paper_id % 5 = 0").select("person", "title_key")).select("paper_id", F.col("claimed").cast("int").alias("claimed"))


@query("f43_renamed_ids", """WITH x AS (SELECT c_custkey AS profile, [c_custkey % 7, c_custkey % 5, c_custkey % 7 + 1, 30] AS ids FROM customer), u AS (SELECT profile, unnest(ids) AS id, generate_subscripts(ids, 1) AS a FROM x),
r AS (SELECT profile, coalesce(n_regionkey + 100, id) AS id, a FROM u LEFT JOIN nation ON n_nationkey = id), f AS (SELECT profile, id, min(a) AS a FROM r GROUP BY 1, 2)
SELECT profile, string_agg(CAST(id AS VARCHAR), ',' ORDER BY a) AS ids FROM f GROUP BY profile""")
def f43(spark, d):
    """Ids of a list renamed by a table, each kept once at its first place."""
    k = F.col("c_custkey")
    lists = table(spark, d, "customer").select(k.alias("profile"), F.array(k % 7, k % 5, k % 7 + 1, F.lit(30)).alias("ids"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 100).cast("long").alias("new_id"))
    return I.renamed(lists, "profile", "ids", names).select("profile", F.array_join("ids", ",").alias("ids"))


@query("f44_placeholder_vectors")
def f44(spark, d):
    """No SQL: vectors come from a seeded generator; compared with plain Python in the tests."""
    return papers(spark, d).select("paper_id", W.placeholder_vector(F.col("title")).alias("v"))


@query("a33_fingerprints", P + """SELECT paper_id, left(sha256('{"alpha": 0.4, "lang": "' || lang || '", "source": "' || source || '", "year": ' || year || '}'), 16) AS config, left(sha1(array_to_string(list_sort([source, lang, CAST(paper_id AS VARCHAR)]), chr(10))), 16) AS seeds, left(sha256('["m1", "title", "max", ["' || source || '", "' || lang || '"]]'), 16) AS queries FROM p WHERE lang IS NOT NULL AND source IS NOT NULL""")
def a33(spark, d):
    """Fingerprints of a selector's settings (keys sorted), of a seed set, and of a reranker's queries."""
    p = papers(spark, d).where("lang is not null and source is not null")
    settings = {"year": F.col("year"), "lang": F.col("lang"), "source": F.col("source"), "alpha": F.lit(0.4)}
    return p.select("paper_id", I.settings_hash(settings).alias("config"), I.seeds_hash(F.array("source", "lang", F.col("paper_id").cast("string"))).alias("seeds"), I.queries_hash("m1", "title", "max", F.array("source", "lang")).alias("queries"))


@query("t11_samples", "SELECT label AS profile, vec_id AS paper_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) <= 5")
def t11(spark, d):
    """Five papers a profile, drawn by a seeded hash, so that reruns draw alike."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("profile"), F.col("vec_id").alias("paper_id"))
    n = F.row_number().over(Window.partitionBy("profile").orderBy(F.md5(F.concat(F.lit("7:"), F.col("paper_id").cast("string"))), "paper_id"))
    return e.withColumn("n", n).where("n <= 5").drop("n")

