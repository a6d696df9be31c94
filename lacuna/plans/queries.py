"""The engine's queries over the test tables, each with the same question in DuckDB SQL.

The corpus: works are orders, concepts are brand and type of the parts on them, the year is the order's. A second count,
by customer in place of order, is the independent signal. Names are codes, so only the level filters (brand number modulo 5,
plus 1). Every concept is a topic. Sort keys are rounded to 9 decimals and ties go to the smaller id in both engines.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import novelty as N
from lacuna.functions import text as T
from lacuna.operators import agent, backtest, evidence, mining, typing
from lacuna.operators.discovery import DiscoveryConfig, bridges, candidates, discover, diversity, explain, stages, stats
from lacuna.operators.filters import LevelFilter, RelevanceFilter, generic_source, make_filter, nonsense_target
from lacuna.operators.filters import usable_pairs as usable_of
from lacuna.operators.lookups import Memo
from lacuna.operators.similarity import cosines, diversity_of, mean_cosine, similar_sets
from lacuna.session import owned, scratch, stored, table, tasks
from lacuna.sources import corpus as C
from lacuna.sources import works as W
from lacuna.sources.papers import parse_papers, result_count
from lacuna.streaming.edges import merge_works, merged

POOL, MAX_LIFT = 25, 1.0
CONFIG = DiscoveryConfig(bridge_pool=POOL, max_lift=MAX_LIFT, min_level=2, filters=LevelFilter())
SPLIT = 1998


#: Parts up to which they are left to be sent to every task.
FEW_PARTS = 100_000


def work_concepts(spark: SparkSession, d: str) -> DataFrame:
    """work, cid, year, customer: distinct rows, written once, as every part of a corpus is made of them. Joins and groups are dealt out by the number of
    lines, so that no task's share grows with it."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("|", "p_brand", "p_type").alias("cid"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("customer"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    n = tasks(lines)
    if part.count() > FEW_PARTS:
        lines, part = lines.repartition(n, "l_partkey"), part.repartition(n, "l_partkey")
    named = lines.join(part, "l_partkey").repartition(n, "l_orderkey")
    rows = named.join(orders.repartition(n, "l_orderkey"), "l_orderkey").select(F.col("l_orderkey").alias("work"), "cid", "year", "customer").distinct()
    return stored(rows, "rows")[0]


def names(wc: DataFrame) -> DataFrame:
    brand = F.coalesce(F.nullif(F.regexp_extract("cid", "([0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))
    return wc.select("cid").distinct().select("cid", F.col("cid").alias("name"), (F.pmod(brand, F.lit(5)) + 1).alias("level"))


def the_corpus(spark: SparkSession, d: str, year_from: int | None = None, year_to: int | None = None) -> C.Corpus:
    wc = work_concepts(spark, d)
    n = tasks(wc)
    by_customer = C.cooccurrence_edges(wc.select(F.col("customer").alias("work"), "cid"), tasks=n).withColumnRenamed("cooc", "hits")
    return C.Corpus.from_work_concepts(wc, names(wc), comentions=by_customer, year_from=year_from, year_to=year_to, tasks=n).kept(POOL)


def the_topics(c: C.Corpus) -> DataFrame:
    return c.concepts.select(F.col("cid").alias("a"))


SQL_CORPUS = """
wc AS MATERIALIZED (SELECT DISTINCT l_orderkey AS work, p_brand || '|' || p_type AS cid, year(o_orderdate)::INT AS year, o_custkey AS customer
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
names AS (SELECT DISTINCT cid, cid AS name, coalesce(nullif(regexp_extract(cid, '([0-9]+)', 1), '')::INT, 0) % 5 + 1 AS level FROM wc),
concepts AS MATERIALIZED (SELECT names.*, w.works_count FROM names JOIN (SELECT cid, count(DISTINCT work) AS works_count FROM wc GROUP BY cid) w USING (cid)),
size AS (SELECT count(DISTINCT work) AS size FROM wc),
edges AS MATERIALIZED (SELECT x.cid AS src, y.cid AS dst, count(*) AS cooc FROM (SELECT DISTINCT work, cid FROM wc WHERE {years}) x JOIN (SELECT DISTINCT work, cid FROM wc WHERE {years}) y USING (work) WHERE x.cid <> y.cid GROUP BY ALL),
topics AS (SELECT cid AS a FROM concepts),
spec AS (SELECT cid, level, works_count, 1 / (1 + log10(greatest(works_count::DOUBLE, 10))) AS spec FROM concepts),
near AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cooc DESC, dst) AS r FROM edges) WHERE r <= 25),
normed AS MATERIALIZED (SELECT src, dst, cooc, cooc::DOUBLE / max(cooc) OVER (PARTITION BY src) AS n FROM near)"""
SQL_BRIDGES = """,
pool AS (SELECT src AS a, dst AS b, cooc, n AS an FROM normed JOIN topics ON src = a),
chosen AS MATERIALIZED (SELECT * FROM (SELECT pool.*, an * spec AS b_key, row_number() OVER (PARTITION BY a ORDER BY round(an * spec, 9) DESC, b) AS b_rank FROM pool JOIN spec ON cid = b
           WHERE level >= 2 AND b <> a) WHERE b_rank <= 10)"""
SQL_CANDIDATES = """,
paths AS (SELECT a, b, dst AS c, an, sqrt(greatest(an, 1e-6) * greatest(n, 1e-6)) AS leg FROM chosen JOIN normed ON src = b WHERE dst <> a),
cand AS MATERIALIZED (SELECT a, c, count(*) AS support, sum(leg) AS path, string_agg(b, ';' ORDER BY round(an, 9) DESC, b) AS bridges FROM paths p
         WHERE NOT EXISTS (SELECT 1 FROM pool WHERE pool.a = p.a AND pool.b = p.c) GROUP BY a, c)"""
SQL_LINKS = """,
ranked AS (SELECT cand.*, level, works_count, spec, row_number() OVER (PARTITION BY a ORDER BY support DESC, round(path, 9) DESC, c) AS p_rank FROM cand JOIN spec ON cid = c WHERE level >= 2 {types}),
short AS (SELECT r.*, path / max(path) OVER (PARTITION BY r.a) AS path_norm, nb, coalesce(cooc, 0) AS direct, wa, size,
                 coalesce(cooc, 0) / greatest(wa::DOUBLE * works_count / size, 0.5) AS lift
          FROM ranked r JOIN (SELECT a, count(*) AS nb FROM chosen GROUP BY a) USING (a) JOIN (SELECT cid AS a, works_count AS wa FROM concepts) USING (a) CROSS JOIN size
          LEFT JOIN edges ON src = r.a AND dst = r.c WHERE p_rank <= {checked}),
scored AS (SELECT *, (0.6 * path_norm + 0.4 * support / nb) * spec * novelty AS score FROM (SELECT *, {novelty} AS novelty FROM short {com}) WHERE {gate}),
links AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, c) AS rank FROM scored) WHERE rank <= {results})"""


def sql(body: str, upto: str = "links", years: str = "true", types: str = "", novelty: str = "1 / (1 + lift)", gate: str = "lift <= 1.0", com: str = "", checked: int = 25, results: int = 8) -> str:
    parts = [SQL_CORPUS.format(years=years)]
    if upto in ("bridges", "candidates", "links"):
        parts.append(SQL_BRIDGES)
    if upto in ("candidates", "links"):
        parts.append(SQL_CANDIDATES)
    if upto == "links":
        parts.append(SQL_LINKS.format(types=types, novelty=novelty, gate=gate, com=com, checked=checked, results=results))
    return "WITH " + "".join(parts) + body


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(F.col(c), 6).alias(c) for c in columns]


# --- the graph ----------------------------------------------------------------------------------------------------


@query(sql(" SELECT src, dst, cooc FROM edges", "corpus"))
def cooccurrence_edges(spark, d):
    return the_corpus(spark, d).edges


@query(sql(" SELECT src, dst, cooc FROM edges JOIN topics ON src = a", "corpus"))
def anchored_edges(spark, d):
    c = the_corpus(spark, d)
    return C.anchored_edges(c.work_concepts, the_topics(c).select(F.col("a").alias("cid")), tasks(c.work_concepts))


@query(sql(" SELECT src, dst, cooc, r AS n_rank FROM near", "corpus"))
def neighbors_topk(spark, d):
    return C.neighbours(the_corpus(spark, d).edges, POOL).select("src", "dst", "cooc", F.col("n_rank").cast("long").alias("n_rank"))


@query(sql(" SELECT x.cid AS src, y.cid AS dst, coalesce(cooc, 0)::BIGINT AS cooc FROM concepts x JOIN concepts y ON x.level = y.level AND x.cid <> y.cid LEFT JOIN edges ON src = x.cid AND dst = y.cid", "corpus"))
def cooccurrence_count(spark, d):
    """The pairs asked for: all concepts of one level with each other, whether they occur together or not."""
    c = the_corpus(spark, d)
    pairs = c.concepts.select(F.col("cid").alias("src"), "level").join(c.concepts.select(F.col("cid").alias("dst"), "level"), "level").where("src <> dst")
    return C.cooccurrence(c.edges, pairs).select("src", "dst", "cooc")


@query(sql(" SELECT cid, level, works_count, round(spec, 6) AS specificity FROM spec", "corpus"))
def specificity(spark, d):
    c = the_corpus(spark, d)
    return c.concepts.select("cid", "level", "works_count", F.round(N.specificity(F.col("works_count")), 6).alias("specificity"))


@query(sql(" SELECT src, dst, round(n, 6) AS norm FROM normed", "corpus"))
def normalize(spark, d):
    near = C.neighbours(the_corpus(spark, d).edges, POOL)
    return near.select("src", "dst", F.round(N.normalized(F.col("cooc").cast("double"), "src"), 6).alias("norm"))


@query("SELECT o_orderkey AS work, year(o_orderdate)::INT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def time_window(spark, d):
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.year("o_orderdate").alias("year"))
    return C.in_years(works, 1996, 1998)


_WORKS_WITH_ALL = sql(
    """, asked AS (SELECT src || ';' || dst AS set_id, src, dst FROM near JOIN topics ON src = a WHERE r <= 3),
    have AS (SELECT DISTINCT set_id, x.work FROM asked JOIN wc x ON x.cid = src JOIN wc y ON y.cid = dst AND y.work = x.work)
    SELECT set_id, work, w_rank FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY o_totalprice DESC, work) AS w_rank FROM have JOIN orders ON work = o_orderkey) WHERE w_rank <= 2""", "corpus"
)


@query(_WORKS_WITH_ALL)
def works_with_all(spark, d):
    """The sets asked for: every concept with each of its three strongest neighbours."""
    c = the_corpus(spark, d)
    near = C.neighbours(c.edges.join(the_topics(c).select(F.col("a").alias("src")), "src"), 3)
    sets = near.select(F.concat_ws(";", "src", "dst").alias("set_id"), F.array("src", "dst").alias("cids"))
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_totalprice").alias("cited"), F.lit(None).cast("string").alias("title"))
    return C.works_with_all(c.work_concepts, sets, works, tasks=c.tasks).select("set_id", "work", F.col("w_rank").cast("long").alias("w_rank"))


_ASKED = "SELECT DISTINCT lower(p_brand) AS topic FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT p_brand || '|' || left(p_type, 4) FROM part UNION SELECT DISTINCT ' the ' || p_brand || '|' || p_type || ' line' FROM part UNION SELECT ''"


def asked_topics(spark, d) -> DataFrame:
    """Brands, types, names of parts, beginnings of concepts and texts that hold one, and an empty topic."""
    part = table(spark, d, "part")
    cid = F.concat_ws("|", "p_brand", "p_type")
    forms = (F.lower("p_brand"), F.col("p_type"), F.col("p_name"), F.concat_ws("|", "p_brand", F.left("p_type", F.lit(4))), F.concat(F.lit(" the "), cid, F.lit(" line")), F.lit(""))
    return part.select(F.explode(F.array(*forms)).alias("topic")).distinct()


@query(
    f"""WITH t AS ({_ASKED}), wc AS (SELECT DISTINCT l_orderkey AS work, p_brand || '|' || p_type AS cid FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT cid, lower(cid) AS n, count(*) AS works FROM wc GROUP BY cid), q AS (SELECT topic, lower(trim(topic)) AS q FROM t WHERE trim(topic) <> '')
    SELECT topic, cid FROM (SELECT topic, cid, row_number() OVER (PARTITION BY topic ORDER BY (n = q) DESC, works DESC, cid) AS r FROM q JOIN c ON contains(n, q) OR contains(q, n)) WHERE r = 1"""
)
def resolve_topic(spark, d):
    return C.resolve(asked_topics(spark, d), the_corpus(spark, d).concepts)


_RESOLVE_STOP = ", ".join(f"'{w}'" for w in K.TOPIC_STOP)


@query(
    f"""WITH t AS (SELECT DISTINCT p_type || ' ' || p_name || ' of the ' || lower(p_brand) AS topic FROM part), c AS (SELECT p_name AS cid, max(p_size) % 4 + 1 AS level, count(*) AS works FROM part GROUP BY p_name),
    tw AS (SELECT DISTINCT topic, unnest(string_split_regex(lower(topic), '[^a-z0-9]+')) AS word FROM t), cw AS (SELECT DISTINCT cid, level, works, unnest(string_split_regex(lower(cid), '[^a-z0-9]+')) AS word FROM c WHERE level >= 2 AND cid NOT IN ({", ".join(f"'{w}'" for w in K.ROOT_FIELDS)}))
    SELECT topic, cid, overlap FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY overlap DESC, level DESC, works DESC, cid) AS r FROM
      (SELECT topic, cid, level, works, count(*) AS overlap FROM tw JOIN cw USING (word) WHERE word <> '' AND word NOT IN ({_RESOLVE_STOP}) GROUP BY ALL)) WHERE r = 1"""
)
def resolve_by_tokens(spark, d):
    """Every type, name and brand that a part has together, as a text about it."""
    part = table(spark, d, "part")
    t = part.select(F.concat(F.concat_ws(" ", "p_type", "p_name"), F.lit(" of the "), F.lower("p_brand")).alias("topic")).distinct()
    c = part.groupBy(F.col("p_name").alias("cid")).agg((F.max("p_size") % 4 + 1).alias("level"), F.count(F.lit(1)).alias("works_count")).withColumn("name", F.col("cid"))
    return C.resolve_by_tokens(t, c)


# --- discovery ----------------------------------------------------------------------------------------------------


@query(sql(" SELECT a, b, round(an, 6) AS an, round(b_key, 6) AS b_key, b_rank FROM chosen", "bridges"))
def bridge_select(spark, d):
    c = the_corpus(spark, d)
    _, chosen = bridges(c, the_topics(c), CONFIG)
    return chosen.select("a", "b", *r6("an", "b_key"), F.col("b_rank").cast("long").alias("b_rank"))


@query(sql(" SELECT a, c, support, round(path, 6) AS path, bridges FROM cand", "candidates"))
def candidate_expand(spark, d):
    c = the_corpus(spark, d)
    found = candidates(c, *bridges(c, the_topics(c), CONFIG), CONFIG)
    return found.select("a", "c", "support", *r6("path"), F.array_join(F.transform("found", lambda x: x["id"]), ";").alias("bridges"))


_LINK = " SELECT a, c, rank, bridges, support AS bridge_support, round(path, 6) AS path_strength, direct, round(lift, 6) AS expected_lift, round(novelty, 6) AS novelty, round(score, 6) AS score FROM links"


def link_columns(links: DataFrame) -> DataFrame:
    return links.select("a", "c", F.col("rank").cast("long").alias("rank"), F.array_join("bridge_ids", ";").alias("bridges"), "bridge_support", *r6("path_strength"), "direct", *r6("expected_lift", "novelty", "score"))


@query(sql(_LINK))
def open_discovery(spark, d):
    c = the_corpus(spark, d)
    return link_columns(discover(c, the_topics(c), CONFIG))


# Spark rounds halves of the decimal text up; the 1e-12 has DuckDB do so with the doubles just below
_LIFT_SIGNAL = "round(1 / (1 + least(direct / greatest(greatest(wa, 10)::DOUBLE * greatest(works_count, 10) / size, 0.5), 1.0)), 4)"
_COM_SIGNAL = "CASE WHEN hits = 0 THEN 0.95 WHEN hits <= 30 THEN round(0.85::DOUBLE - 0.35::DOUBLE * hits / 30, 3) ELSE round(least(0.4::DOUBLE, 30::DOUBLE / hits), 3) END"
_COM_JOIN = "LEFT JOIN (SELECT x.cid AS src, y.cid AS dst, count(*) AS h FROM (SELECT DISTINCT customer, cid FROM wc) x JOIN (SELECT DISTINCT customer, cid FROM wc) y USING (customer) WHERE x.cid <> y.cid GROUP BY ALL) m ON m.src = a AND m.dst = c CROSS JOIN LATERAL (SELECT coalesce(h, 0) AS hits)"
_RICH = " SELECT a, c, rank, bridges, support AS bridge_support, direct, hits AS comention_count, round(novelty, 4) AS novelty, round(score, 6) AS score FROM links"


def rich_columns(links: DataFrame) -> DataFrame:
    return links.select("a", "c", F.col("rank").cast("long").alias("rank"), F.array_join("bridge_ids", ";").alias("bridges"), "bridge_support", "direct", "comention_count", F.round("novelty", 4).alias("novelty"), *r6("score"))


@query(sql(_RICH, novelty=f"round(round((0.55::DOUBLE * {_LIFT_SIGNAL} + 0.45::DOUBLE * ({_COM_SIGNAL})) / (0.55::DOUBLE + 0.45::DOUBLE), 9) + 1e-12::DOUBLE, 4)", gate="true", com=_COM_JOIN))
def blend_hybrid(spark, d):
    c = the_corpus(spark, d)
    return rich_columns(discover(c, the_topics(c), CONFIG.with_(novelty_mode="hybrid")))


@query(sql(_RICH, novelty=f"round(round(({_LIFT_SIGNAL} + ({_COM_SIGNAL})) / 2.0::DOUBLE, 9) + 1e-12::DOUBLE, 4)", gate="true", com=_COM_JOIN))
def comention_mode(spark, d):
    c = the_corpus(spark, d)
    return rich_columns(discover(c, the_topics(c), CONFIG.with_(novelty_mode="comention")))


@query(
    sql(
        """, pairs AS (SELECT a, c FROM cand),
    both_ AS (SELECT p.a, p.c, x.dst AS b, sqrt(greatest(x.n, 1e-6) * greatest(y.n, 1e-6)) AS strength FROM pairs p JOIN normed x ON x.src = p.a JOIN normed y ON y.src = p.c AND y.dst = x.dst JOIN spec ON cid = x.dst WHERE level >= 2 AND x.dst <> p.a AND x.dst <> p.c),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, c ORDER BY round(strength, 9) DESC, b) AS b_rank FROM both_) WHERE b_rank <= 10)
    SELECT t.a, t.c, t.b, b_rank, round(strength, 6) AS strength, round(sum(strength) OVER (PARTITION BY t.a, t.c), 6) AS total, coalesce(cooc, 0)::BIGINT AS direct, round(1::DOUBLE / (1 + coalesce(cooc, 0)), 6) AS novelty,
           count(*) OVER (PARTITION BY t.a, t.c) AS n_bridges FROM top t LEFT JOIN edges ON src = t.a AND dst = t.c""",
        "candidates",
    )
)
def closed_discovery(spark, d):
    """Every pair of a concept and a candidate of it is explained."""
    c = the_corpus(spark, d)
    pairs = candidates(c, *bridges(c, the_topics(c), CONFIG), CONFIG).select("a", "c")
    return explain(c, pairs, CONFIG).select("a", "c", "b", F.col("b_rank").cast("long").alias("b_rank"), *r6("strength", "total"), "direct", *r6("novelty"), "n_bridges")


_STATS = """ SELECT t.a, (SELECT count(*) FROM chosen x WHERE x.a = t.a) AS bridges, (SELECT count(*) FROM cand x WHERE x.a = t.a) AS candidates,
    (SELECT count(*) FROM short x WHERE x.a = t.a) AS checked, (SELECT count(*) FROM links x WHERE x.a = t.a) AS results FROM topics t"""


@query(sql(_STATS, gate="lift <= 0.9"))
def run_stats(spark, d):
    """Every topic has a row, also one whose links are all gated away."""
    c = the_corpus(spark, d)
    return stats(the_topics(c), stages(c, the_topics(c), CONFIG.with_(max_lift=0.9)))


_TYPE_OF = "CASE WHEN contains(c, 'PROMO') THEN 'D' WHEN contains(c, 'ECONOMY') THEN 'C' ELSE 'E' END"


def category_types(c: C.Corpus) -> DataFrame:
    letter = F.when(F.contains("name", F.lit("PROMO")), "D").when(F.contains("name", F.lit("ECONOMY")), "C").otherwise("E")
    return c.concepts.select("name", F.array(letter).alias("letters"))


_TYPED = sql(_LINK, types="") .replace("ranked AS (", "ranked0 AS (").replace(
    ",\nshort AS", f""",
ranked AS (SELECT * EXCLUDE (p_rank, fits, any_fit), row_number() OVER (PARTITION BY a ORDER BY support DESC, round(path, 9) DESC, c) AS p_rank FROM
  (SELECT *, max(fits) OVER (PARTITION BY a) AS any_fit FROM (SELECT *, (p_rank <= 80 AND {_TYPE_OF} = 'D')::INT AS fits FROM ranked0)) WHERE fits = 1 OR any_fit = 0),
short AS"""
)


@query(_TYPED)
def type_filter(spark, d):
    c = the_corpus(spark, d)
    return link_columns(discover(c, the_topics(c), CONFIG.with_(target_categories=typing.resolve_target("drug")), category_types(c)))


@query(sql(_LINK))
def typed_pool_failopen(spark, d):
    """No candidate has the category, so all stay."""
    c = the_corpus(spark, d)
    return link_columns(discover(c, the_topics(c), CONFIG.with_(target_categories=("Z",)), category_types(c)))


# --- hypotheses ---------------------------------------------------------------------------------------------------

_HITS = "LEFT JOIN (SELECT x.cid AS src, y.cid AS dst, count(*) AS h FROM (SELECT DISTINCT customer, cid FROM wc) x JOIN (SELECT DISTINCT customer, cid FROM wc) y USING (customer) WHERE x.cid <> y.cid GROUP BY ALL) m ON m.src = a AND m.dst = c"
_VERIFIED = f""", ver AS (SELECT a, c, rank, novelty, coalesce(h, 0)::BIGINT AS hits, CASE WHEN support <= 1 THEN round(least(1, 0.55::DOUBLE * 0.8::DOUBLE), 3) ELSE round(least(1, 0.4::DOUBLE + 0.15::DOUBLE * support), 3) END AS plausibility FROM links {_HITS}),
bands AS (SELECT *, CASE WHEN hits = 0 THEN 'open' WHEN hits <= 30 THEN 'emerging' ELSE 'established' END AS verdict,
  CASE WHEN hits = 0 THEN 0.95 WHEN hits <= 30 THEN round(0.85::DOUBLE - 0.35::DOUBLE * hits / 30, 3) ELSE round(least(0.4::DOUBLE, 30::DOUBLE / hits), 3) END AS verified_novelty FROM ver)"""


def verified(spark, d) -> DataFrame:
    c = the_corpus(spark, d)
    counts = c.comentions.select(F.col("src").alias("a"), F.col("dst").alias("c"), "hits")
    return evidence.verify(evidence.hypotheses(discover(c, the_topics(c), CONFIG)), counts)


@query(sql(_VERIFIED + " SELECT a, c, hits, verdict, verified_novelty, plausibility, row_number() OVER (PARTITION BY a ORDER BY round(verified_novelty * greatest(plausibility, 0.05), 9) DESC, rank, c) AS final_rank FROM bands"))
def verify_rerank(spark, d):
    return evidence.reranked(verified(spark, d)).select("a", "c", "hits", "verdict", "verified_novelty", "plausibility", F.col("final_rank").cast("long").alias("final_rank"))


@query(sql(_VERIFIED + " SELECT verdict, count(*) AS n FROM bands GROUP BY verdict"))
def verdict_histogram(spark, d):
    return evidence.verdict_histogram(verified(spark, d))


@query(
    """WITH h AS (SELECT event_id, (event_id % 120 - 1)::BIGINT AS hits FROM events) SELECT event_id, hits, CASE WHEN hits < 0 THEN 'unverified' WHEN hits <= 0 THEN 'open' WHEN hits <= 30 THEN 'emerging' ELSE 'established' END AS verdict,
    CASE WHEN hits < 0 THEN NULL WHEN hits <= 0 THEN 0.95 WHEN hits <= 30 THEN round(0.85::DOUBLE - 0.35::DOUBLE * hits / 30, 3) ELSE round(least(0.4::DOUBLE, 30::DOUBLE / hits), 3) END AS verified_novelty FROM h"""
)
def verdict_bands(spark, d):
    h = table(spark, d, "events").select("event_id", (F.col("event_id") % 120 - 1).cast("long").alias("hits"))
    return h.select("event_id", "hits", N.verdict(F.col("hits")).alias("verdict"), N.verified_novelty(F.col("hits")).alias("verified_novelty"))


@query(
    """WITH h AS (SELECT event_id, (event_id % 7)::BIGINT AS direct, (event_id % 40 * 3)::BIGINT AS wa, (event_id % 55 * 2)::BIGINT AS wb FROM events) SELECT event_id,
    round(1 / (1 + least(direct / greatest(greatest(wa, 10)::DOUBLE * greatest(wb, 10) / 500, 0.5), 2.0)), 4) AS lift_novelty,
    round(direct / greatest((CASE WHEN wa = 0 THEN 10 ELSE wa END)::DOUBLE * (CASE WHEN wb = 0 THEN 10 ELSE wb END) / 500, 0.5), 6) AS lift FROM h"""
)
def lift_novelty(spark, d):
    h = table(spark, d, "events").select("event_id", (F.col("event_id") % 7).alias("direct"), (F.col("event_id") % 40 * 3).alias("wa"), (F.col("event_id") % 55 * 2).alias("wb"))
    size = F.lit(500)
    return h.select("event_id", N.lift_novelty(F.col("direct"), F.col("wa"), F.col("wb"), size).alias("lift_novelty"), F.round(N.lift(F.col("direct"), F.col("wa"), F.col("wb"), size), 6).alias("lift"))


@query(
    """WITH h AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 100 END AS hits FROM events) SELECT event_id,
    CASE WHEN hits IS NULL THEN 0.5 WHEN hits = 0 THEN 0.95 WHEN hits <= 30 THEN round(0.85::DOUBLE - 0.35::DOUBLE * hits / 30, 3) ELSE round(least(0.4::DOUBLE, 30::DOUBLE / hits), 3) END AS comention_novelty FROM h"""
)
def comention_novelty(spark, d):
    h = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 100).alias("hits"))
    return h.select("event_id", N.comention_novelty(F.col("hits")).alias("comention_novelty"))


@query(sql(" SELECT a, c, CASE WHEN support <= 1 THEN round(0.55::DOUBLE * 0.8::DOUBLE, 3) ELSE round(least(1, 0.4::DOUBLE + 0.15::DOUBLE * support), 3) END AS plausibility, support <= 1 AS single, direct = 0 AND support >= 3 AS strong FROM links"))
def critique(spark, d):
    c = the_corpus(spark, d)
    h = evidence.hypotheses(discover(c, the_topics(c), CONFIG))
    return h.select("a", "c", "plausibility", F.contains("rationale", F.lit("One bridge only")).alias("single"), F.contains("rationale", F.lit("Several bridges")).alias("strong"))


@query(
    sql(
        """, b AS (SELECT *, string_split(bridges, ';') AS bs, CASE WHEN support = 1 THEN bridges ELSE array_to_string(string_split(bridges, ';')[1:support - 1], ', ') || ' and ' || string_split(bridges, ';')[support] END AS via FROM links)
    SELECT a, c, c || ' may act on ' || a || ' by way of ' || via || '.' AS statement,
      'Works on ' || a || ' mention ' || via || ', and so do works on ' || c || '; ' || support || ' path(s) of two steps join them, while ' || direct || ' work(s) mention both.' AS mechanism,
      'Vary ' || c || ' under control, measure ' || bs[1] || ' as mediator, and record a marker of ' || a || ' against a prediction made beforehand.' AS experiment,
      a || ' -> [' || array_to_string(bs[1:5], ', ') || '] -> ' || c || ' (bridges=' || support || ', direct=' || direct || printf(', score=%.3f)', score) AS explanation FROM b"""
    )
)
def hypothesis_text(spark, d):
    c = the_corpus(spark, d)
    return evidence.explained(evidence.hypotheses(discover(c, the_topics(c), CONFIG))).select("a", "c", "statement", "mechanism", "experiment", "explanation")


@query(
    sql(
        """, legs AS (SELECT a, c, k, string_split(bridges, ';')[k] AS b FROM links, (VALUES (1), (2)) v(k) WHERE k <= support),
    ends AS (SELECT a, c, k, 0 AS leg, a AS x, b AS y FROM legs UNION ALL SELECT a, c, k, 1, b, c FROM legs), w AS (SELECT DISTINCT work, cid FROM wc),
    found AS (SELECT a, c, k, leg, p.work, row_number() OVER (PARTITION BY a, c, k, leg ORDER BY o_totalprice DESC, p.work) AS r FROM ends JOIN w p ON p.cid = x JOIN w q ON q.cid = y AND q.work = p.work JOIN orders ON p.work = o_orderkey)
    SELECT DISTINCT a, c, work FROM found WHERE r = 1"""
    )
)
def citations(spark, d):
    c = the_corpus(spark, d)
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_totalprice").alias("cited"), F.lit(None).cast("string").alias("title"))
    return evidence.citations(c.hold(discover(c, the_topics(c), CONFIG), "links"), c.work_concepts, works, c.tasks).select("a", "c", "work")


# --- back-test ----------------------------------------------------------------------------------------------------

def back_test_sql(split: int) -> str:
    return sql(
        f""", fut AS (SELECT x.cid AS src, y.cid AS dst, count(*) AS f FROM (SELECT DISTINCT work, cid FROM wc WHERE year > {split}) x JOIN (SELECT DISTINCT work, cid FROM wc WHERE year > {split}) y USING (work) WHERE x.cid <> y.cid GROUP BY ALL),
flags AS (SELECT a, c, score, direct AS past_comentions, coalesce(f, 0)::BIGINT AS future_comentions, direct <= 2 AS novel_as_of_split, coalesce(f, 0) >= 3 AS emerged FROM links LEFT JOIN fut ON src = a AND dst = c),
picked AS (SELECT *, novel_as_of_split AND row_number() OVER (PARTITION BY a ORDER BY novel_as_of_split DESC, round(score, 9) DESC, c) <= 10 AS chosen FROM flags)""",
        years=f"year <= {split}", gate="true", checked=80, results=80,
    )


_BT = back_test_sql(SPLIT)
_SUMMED = "SELECT a, count(*) AS pool_size, count(*) FILTER (novel_as_of_split) AS n_novel_in_pool, count(*) FILTER (chosen) AS n_links, count(*) FILTER (chosen AND emerged) AS n_hits, CASE WHEN count(*) FILTER (chosen) = 0 THEN 0 ELSE (count(*) FILTER (chosen AND emerged))::DOUBLE / count(*) FILTER (chosen) END AS precision_at_k FROM picked GROUP BY a"


def backtested(spark, d) -> DataFrame:
    wc = work_concepts(spark, d)
    n, dealt = names(wc), tasks(wc)
    past, future = backtest.by_year(lambda lo, hi: C.Corpus.from_work_concepts(wc, n, year_from=lo, year_to=hi, tasks=dealt).kept(POOL), SPLIT)
    return backtest.run_backtest(past, future, the_topics(past), CONFIG)


@query(_BT + " SELECT a, c, round(score, 6) AS score, past_comentions::BIGINT AS past_comentions, future_comentions, novel_as_of_split, emerged, novel_as_of_split AND emerged AS hit, chosen FROM picked")
def backtest_links(spark, d):
    return backtested(spark, d).select("a", "c", *r6("score"), "past_comentions", "future_comentions", "novel_as_of_split", "emerged", "hit", "chosen")


@query(f"{_BT} {_SUMMED}")
def backtest_summary(spark, d):
    return backtest.backtest_summary(backtested(spark, d))


# --- names and texts ----------------------------------------------------------------------------------------------


def part_names(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()


_GRAMS = "list_distinct(CASE WHEN length({s}) = 0 THEN []::VARCHAR[] WHEN length({s}) < 3 THEN [{s}] ELSE list_transform(range(1, length({s}) - 1), lambda i: substr({s}, i, 3)) END)"
_PART_GRAMS = f"g AS MATERIALIZED (SELECT name, {_GRAMS.format(s='s')} AS g FROM (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS s FROM part))"
_JACCARD = "(len(list_intersect({a}, {b}))::DOUBLE / greatest(len(list_distinct(list_concat({a}, {b}))), 1))"


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(f"WITH {_PART_GRAMS} SELECT name, len(g)::INT AS n, list_aggregate(list_sort(g), 'string_agg', '|') AS grams FROM g")
def char_ngrams(spark, d):
    g = part_names(spark, d).withColumn("g", T.char_ngrams(F.col("name")))
    return g.select("name", F.size("g").alias("n"), F.array_join(F.array_sort("g"), "|").alias("grams"))


@query(f"WITH {_PART_GRAMS} SELECT x.name AS a, y.name AS b, round({_JACCARD.format(a='x.g', b='y.g')}, 6) AS jaccard FROM g x JOIN g y ON x.name < y.name WHERE {_JACCARD.format(a='x.g', b='y.g')} >= 0.3")
def ngram_jaccard(spark, d):
    """Pairs of names by shared n-grams: an equi-join on exploded n-grams, counted, so that unlike names never meet."""
    g = part_names(spark, d).withColumn("g", T.char_ngrams(F.col("name")))
    rows = g.select("name", F.size("g").alias("n"), F.explode("g").alias("gram"))
    both = rows.select(F.col("name").alias("a"), F.col("n").alias("na"), "gram").join(rows.select(F.col("name").alias("b"), F.col("n").alias("nb"), "gram"), "gram").where("a < b")
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return both.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")).where(j >= 0.3).select("a", "b", F.round(j, 6).alias("jaccard"))


_SEEDS = [s for s in K.NAME_STOP_BIOMED if len(s) > 2]
_SEED_GRAMS = f"seeds AS (SELECT {_GRAMS.format(s='s')} AS sg FROM (SELECT regexp_replace(unnest({_sql_list(_SEEDS)}), '[^a-z0-9]', '', 'g') AS s))"


@query(f"WITH {_PART_GRAMS}, {_SEED_GRAMS} SELECT name, round(max({_JACCARD.format(a='g', b='sg')}), 6) AS generic_score FROM g CROSS JOIN seeds GROUP BY name")
def generic_score(spark, d):
    flt = RelevanceFilter()
    return part_names(spark, d).select("name", F.round(T.generic_score(T.char_ngrams(F.col("name")), flt.seeds), 6).alias("generic_score"))


_TOKENS = "list_sort(list_distinct(list_filter(string_split_regex(lower({n}), '[^a-z0-9]+'), lambda t: t <> '')))"


@query(f"SELECT DISTINCT p_name AS name, array_to_string({_TOKENS.format(n='p_name')}, '|') AS tokens, array_to_string(list_filter({_TOKENS.format(n='p_name')}, lambda t: NOT list_contains({_sql_list(K.GENERIC_TOKENS_BIOMED)}, t)), '|') AS distinctive FROM part")
def distinctive_tokens(spark, d):
    n = F.col("name")
    return part_names(spark, d).select("name", F.array_join(F.array_sort(T.tokens(n)), "|").alias("tokens"), F.array_join(F.array_sort(T.distinctive_tokens(n)), "|").alias("distinctive"))


_MADE = "(SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' (Film)' WHEN 1 THEN ' (' || p_type || ')' WHEN 2 THEN ' ( genus ) (x)' ELSE '' END AS name, p_size % 5 AS level FROM part)"


def made_names(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " (Film)").when(k == 1, F.concat(F.lit(" ("), "p_type", F.lit(")"))).when(k == 2, " ( genus ) (x)").otherwise("")
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", tail).alias("name"), (F.col("p_size") % 5).alias("level"))


@query(f"SELECT p_partkey, name, lower(trim(regexp_extract(name, '\\(([^)]+)\\)', 1))) AS parenthetical, list_contains({_sql_list(K.HOMONYM_BIOMED)}, lower(trim(regexp_extract(name, '\\(([^)]+)\\)', 1)))) AS bad FROM {_MADE}")
def bad_parenthetical(spark, d):
    return made_names(spark, d).select("p_partkey", "name", T.parenthetical(F.col("name")).alias("parenthetical"), RelevanceFilter().bad_parenthetical(F.col("name")).alias("bad"))


@query(f"SELECT p_partkey, level, lower(trim(name)) IN ({', '.join(repr(w) for w in K.ROOT_FIELDS)}) OR level < 2 AS generic_source FROM {_MADE}")
def source_filter(spark, d):
    return made_names(spark, d).select("p_partkey", "level", generic_source(F.col("name"), F.col("level")).alias("generic_source"))


_NAME_FLAGS = f"""m AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS s, lower(trim(name)) AS low, lower(trim(regexp_extract(name, '\\(([^)]+)\\)', 1))) AS par FROM {_MADE}),
scored AS (SELECT s, max({_JACCARD.format(a='gs', b='sg')}) AS score FROM (SELECT DISTINCT s, {_GRAMS.format(s='s')} AS gs FROM m) CROSS JOIN seeds GROUP BY s),
flags AS (SELECT m.*, list_contains({_sql_list(K.NAME_STOP_BIOMED)}, low) OR score >= 0.55 OR len(list_filter({_TOKENS.format(n='name')}, lambda t: NOT list_contains({_sql_list(K.GENERIC_TOKENS_BIOMED)}, t))) = 0 AS generic, list_contains({_sql_list(K.HOMONYM_BIOMED)}, par) AS bad FROM m JOIN scored USING (s))"""


@query(f"WITH {_SEED_GRAMS}, {_NAME_FLAGS} SELECT p_partkey, generic, bad, generic OR bad OR level < 2 OR list_contains({_sql_list(K.ROOT_FIELDS)}, low) OR list_contains({_sql_list(K.NOISE_WORDS)}, low) OR contains(low, '(linguistics)') OR contains(low, '(graphical)') AS nonsense FROM flags")
def nonsense_names(spark, d):
    flt = RelevanceFilter()
    n = F.col("name")
    return made_names(spark, d).select("p_partkey", flt.is_generic(n).alias("generic"), flt.bad_parenthetical(n).alias("bad"), nonsense_target(n, F.col("level")).alias("nonsense"))


@query(
    f"""WITH {_SEED_GRAMS}, {_NAME_FLAGS}, a AS (SELECT *, {_GRAMS.format(s='s')} AS ag, list_filter({_TOKENS.format(n='name')}, lambda t: NOT list_contains({_sql_list(K.GENERIC_TOKENS_BIOMED)}, t)) AS own FROM flags)
    SELECT x.p_partkey AS topic, y.p_partkey AS concept FROM (SELECT * FROM a WHERE p_partkey % 100 = 0) x JOIN a y ON x.p_partkey <> y.p_partkey
    WHERE y.level >= 2 AND NOT y.generic AND NOT y.bad AND {_JACCARD.format(a='x.ag', b='y.ag')} < 0.6 AND len(list_intersect(x.own, y.own)) = 0"""
)
def usable_pairs(spark, d):
    """The topics asked for: every part whose key is divisible by 100, against all parts."""
    named = made_names(spark, d).withColumnRenamed("p_partkey", "cid")
    return usable_of(make_filter("biomed"), named.where("cid % 100 = 0"), named, 2)


@query("SELECT doc_id, nullif(regexp_extract(text, '((?:19|20)[0-9]{2})', 1), '')::INT AS year, substr(text, 1, 240) AS snippet, trim(regexp_replace(source || ', ' || lang || ':', '[,:]', ' ', 'g')) AS clean FROM documents")
def year_from(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.year_from(F.col("text")).alias("year"), T.snippet(F.col("text")).alias("snippet"), T.clean_term(F.concat("source", F.lit(", "), "lang", F.lit(":"))).alias("clean"))


@query("SELECT event_id, coalesce((props->>'k')::BIGINT, 0)::BIGINT AS k FROM events")
def json_fields(spark, d):
    text = F.concat(F.lit("note {"), F.substring("props", F.lit(2), F.length("props")), F.lit(" end"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(T.extracted_json(text), "$.k").cast("long"), F.lit(0)).cast("long").alias("k"))


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents),
    t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM w GROUP BY doc_id) SELECT doc_id, CASE WHEN length(t) > 240 THEN substr(t, 1, 240) || '…' ELSE t END AS abstract FROM t"""
)
def rebuilt_abstract(spark, d):
    docs = table(spark, d, "documents")
    index = docs.where("text is not null").select("doc_id", T.inverted_index(F.col("text")).alias("index"))
    return index.select("doc_id", T.rebuilt_abstract(F.col("index")).alias("abstract"))


# --- vectors and bridges ------------------------------------------------------------------------------------------


@query(
    """WITH v AS (SELECT vec_id, label, embedding FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0)
    SELECT q.vec_id AS a, v.vec_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * v.embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine
    FROM q JOIN v ON q.vec_id <> v.vec_id"""
)
def cosine_pairs(spark, d):
    """The vectors asked for: every one whose id is divisible by 100, against all others."""
    v = table(spark, d, "embeddings")
    return cosines(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding")


@query(
    f"""WITH o AS (SELECT l_orderkey AS o, p_name AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), t AS (SELECT o, n, list_filter({_TOKENS.format(n='n')}, lambda t: NOT list_contains({_sql_list(K.GENERIC_TOKENS_BIOMED)}, t)) AS own, {_TOKENS.format(n='n')} AS every FROM o),
    w AS (SELECT o, n, CASE WHEN len(own) > 0 THEN own ELSE every END AS w FROM t), p AS (SELECT x.o, avg(1 - {_JACCARD.format(a='x.w', b='y.w')}) AS m FROM w x JOIN w y ON x.o = y.o AND x.n < y.n GROUP BY x.o)
    SELECT o.o AS work, count(*) AS n, round(coalesce(max(m), 1), 3) AS diversity FROM o LEFT JOIN p ON o.o = p.o GROUP BY o.o"""
)
def bridge_diversity(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("p_partkey"))
    named = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), "p_partkey").select("work", "name").distinct()
    sets = named.groupBy("work").agg(F.array_sort(F.collect_list(F.struct("name"))).alias("found"))
    return sets.select("work", F.size("found").cast("long").alias("n"), diversity(F.col("found")).alias("diversity"))


@query("SELECT p_brand AS heading, array_to_string(list_sort(list_distinct(list(upper(substr(p_type, 1, 1))))), '') AS letters FROM part GROUP BY p_brand")
def category_letters(spark, d):
    tree = table(spark, d, "part").select(F.col("p_brand").alias("heading"), F.col("p_type").alias("tree_number"))
    return typing.letters(tree).select("heading", F.array_join("letters", "").alias("letters"))


@query("SELECT DISTINCT p.p_name AS name, coalesce((SELECT array_to_string(list_sort(list_distinct(list(upper(substr(q.p_type, 1, 1))))), '') FROM part q WHERE q.p_brand = h.heading), '') AS letters FROM part p LEFT JOIN (SELECT p_name, min(p_brand) AS heading FROM part WHERE p_size > 25 GROUP BY p_name) h ON h.p_name = p.p_name")
def type_names(spark, d):
    part = table(spark, d, "part")
    headings = part.where("p_size > 25").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("heading"))
    tree = part.select(F.col("p_brand").alias("heading"), F.col("p_type").alias("tree_number"))
    return typing.type_names(part.select(F.col("p_name").alias("name")), headings, tree).select("name", F.array_join("letters", "").alias("letters"))


# --- full text, listings, comparison ------------------------------------------------------------------------------


_ITEM_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"


@query(
    f"""WITH w AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, n_chars FROM documents),
    p AS (SELECT item_id AS pair_id, array_to_string({_ITEM_WORDS}[1:2], ' ') AS a, array_to_string({_ITEM_WORDS}[5:6], ' ') AS c FROM benchmark),
    h AS (SELECT pair_id, doc_id, row_number() OVER (PARTITION BY pair_id ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY pair_id) AS hits FROM p JOIN w ON contains(t, ' ' || a || ' ') AND contains(t, ' ' || c || ' '))
    SELECT p.pair_id, coalesce(max(hits), 0)::BIGINT AS hits, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 4), '') AS works FROM p LEFT JOIN h USING (pair_id) GROUP BY p.pair_id"""
)
def text_comentions(spark, d):
    """The documents that mention the first two words and the fifth and sixth of a benchmark item, for every item."""
    docs = table(spark, d, "documents")
    works = docs.select(F.col("doc_id").alias("work"), F.lit("").alias("title"), "text", F.lit(None).cast("int").alias("year"), F.col("n_chars").alias("cited"))
    words = T.words_of(F.col("text"))
    pairs = table(spark, d, "benchmark").select(F.col("item_id").alias("pair_id"), F.array_join(F.slice(words, 1, 2), " ").alias("a_name"), F.array_join(F.slice(words, 5, 2), " ").alias("c_name"))
    found = C.text_comentions(works, pairs)
    return found.select("pair_id", "hits", F.coalesce(F.array_join(F.transform("items", lambda i: i["work"].cast("string")), ","), F.lit("")).alias("works"))


_TITLES = """(SELECT p_name AS topic, p_partkey AS paper, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' and (' || p_type || ' Mix' || (p_size % 5) || ') as a drug'
    ELSE p_type || ' Compound' || (p_size % 7) || ' therapy of ' || p_name END AS title FROM part)"""


def titles(spark, d) -> DataFrame:
    """topic, paper, title: made from the parts; every second one has its phrase in parentheses, the others before a marker."""
    size = lambda m: (F.col("p_size") % m).cast("string")
    one = F.concat("p_name", F.lit(" and ("), "p_type", F.lit(" Mix"), size(5), F.lit(") as a drug"))
    two = F.concat("p_type", F.lit(" Compound"), size(7), F.lit(" therapy of "), "p_name")
    return table(spark, d, "part").select(F.col("p_name").alias("topic"), F.col("p_partkey").alias("paper"), F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two).alias("title"))


_MINED = f"""{_SEED_GRAMS}, papers AS (SELECT *, list_filter({_TOKENS.format(n='topic')}, lambda t: length(t) >= 3 AND NOT list_contains({_sql_list(K.TITLE_STOP)}, t)) AS terms FROM {_TITLES}),
    hits AS (SELECT topic, paper, title, terms, unnest(list_concat(regexp_extract_all(title, '{K.PHRASE_IN_PARENTHESES}', 1), regexp_extract_all(title, '{K.PHRASE_BEFORE_MARKER}', 1))) AS raw FROM papers
             WHERE regexp_matches(lower(title), '{K.INTERVENTION}') AND (len(terms) = 0 OR len(list_filter(terms, lambda t: contains(lower(title), t))) > 0)),
    m AS (SELECT topic, paper, title, terms, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS target FROM hits WHERE NOT list_contains(terms, lower(trim(raw)))),
    w AS (SELECT *, regexp_replace(lower(target), '[^a-z0-9]', '', 'g') AS s, {_TOKENS.format(n='target')} AS words FROM m),
    near_seed AS (SELECT s, max({_JACCARD.format(a='gs', b='sg')}) AS score FROM (SELECT DISTINCT s, {_GRAMS.format(s='s')} AS gs FROM w) CROSS JOIN seeds GROUP BY s),
    fine AS (SELECT w.* FROM w JOIN near_seed USING (s) WHERE length(target) >= 4 AND score < 0.55 AND NOT list_contains({_sql_list(K.NAME_STOP_BIOMED)}, lower(target))
             AND len(list_filter(words, lambda t: NOT list_contains({_sql_list(K.GENERIC_TOKENS_BIOMED)}, t))) > 0
             AND len(list_filter(words, lambda t: NOT list_contains({_sql_list(K.TITLE_STOP)}, t))) > 0 AND len(list_intersect(words, terms)) = 0),
    proposed AS (SELECT * FROM (SELECT topic, target, count(*) AS paper_count, count(DISTINCT paper) AS distinct_papers, array_to_string(list(substr(title, 1, 80) ORDER BY paper)[1:2], '|') AS supporting,
                 least(count(*), 2) AS n_supporting, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, target) AS rank FROM fine GROUP BY topic, target) WHERE rank <= %LIMIT%)"""


@query("WITH " + _MINED.replace("%LIMIT%", "8") + " SELECT topic, target, paper_count, distinct_papers, supporting, rank FROM proposed")
def phrase_mining(spark, d):
    """Targets mined from whole titles for every topic, with the first two titles that support each."""
    found = mining.mined(titles(spark, d))
    return found.select("topic", "target", "paper_count", "distinct_papers", F.array_join("supporting", "|").alias("supporting"), F.col("rank").cast("long").alias("rank"))


@query("WITH " + _MINED.replace("%LIMIT%", "8") + """ SELECT topic AS a_name, target AS c_name, 3 AS c_level, rank, greatest(1, n_supporting)::BIGINT AS bridge_support, paper_count % 3 AS direct, 0.7::DOUBLE AS novelty,
    paper_count::DOUBLE AS score FROM proposed""")
def proposals(spark, d):
    """Mined proposals as links; a count of works that mention both is taken as it is."""
    found = mining.mined(titles(spark, d)).withColumn("direct_hits", F.col("paper_count") % 3)
    return mining.proposals_as_links(found).select("a_name", "c_name", "c_level", F.col("rank").cast("long").alias("rank"), "bridge_support", "direct", "novelty", "score")


@query("SELECT doc_id, 1 + (doc_id % 3) AS place, 'Title ' || doc_id || '-' || doc_id % 3 AS title, 'https://doi.org/10.1/' || doc_id AS url, lang || ' says' AS abstract, 'id' || doc_id AS id, source AS source, '20' || (10 + doc_id % 10) AS date, 'A. Author' AS authors FROM documents")
def parse_listings(spark, d):
    """Listings written from the documents, each with one full entry after up to two bare ones."""
    docs = table(spark, d, "documents")
    i = F.col("doc_id").cast("string")
    bare = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(k <= F.col("doc_id") % 3, F.concat(F.lit("\n  "), k.cast("string"), F.lit(". Bare"))).otherwise("")), "")
    full = F.concat(F.lit("\n  9. Title "), i, F.lit("-"), (F.col("doc_id") % 3).cast("string"), F.lit("\n     \u001b[1mA. Author\u001b[0m\n     id"), i, F.lit(" · "), "source", F.lit(" · 20"), (F.col("doc_id") % 10 + 10).cast("string"), F.lit("\n     doi:10.1/"), i, F.lit('\n     "'), "lang", F.lit(' says"\n'))
    rows = parse_papers(docs.select("doc_id", F.concat(F.lit("Found 3 papers"), bare, full).alias("output")))
    return rows.where("title <> 'Bare'").select("doc_id", F.col("place").cast("long").alias("place"), "title", "url", "abstract", "id", "source", "date", "authors")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey % 5 END AS hits FROM orders")
def listing_count(spark, d):
    k = F.col("o_orderkey")
    output = F.when(k % 3 == 0, F.concat(F.lit("Found "), F.format_number(k, 0), F.lit(" results"))).otherwise(F.lit("none stated"))
    return table(spark, d, "orders").select("o_orderkey", result_count(output, k % 5).alias("hits"))


_CITED = """, legs AS (SELECT a, c, k, string_split(bridges, ';')[k] AS b FROM links, (VALUES (1), (2)) v(k) WHERE k <= support),
    ends AS (SELECT a, c, k, 0 AS leg, a AS x, b AS y FROM legs UNION ALL SELECT a, c, k, 1, b, c FROM legs), w2 AS (SELECT DISTINCT work, cid FROM wc),
    found AS (SELECT a, c, k, leg, p.work, row_number() OVER (PARTITION BY a, c, k, leg ORDER BY o_totalprice DESC, p.work) AS r FROM ends JOIN w2 p ON p.cid = x JOIN w2 q ON q.cid = y AND q.work = p.work JOIN orders ON p.work = o_orderkey),
    cites AS (SELECT a, c, count(DISTINCT work) AS n_citations FROM found WHERE r = 1 GROUP BY a, c)"""
_TEXT_LENGTH = "length('Works on ' || a || ' mention ' || bridges || ', and so do works on ' || c) > 20 AND length('Vary ' || c || ' under control, measure ' || a) > 15"


def cited_works(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("work"), F.col("o_totalprice").alias("cited"), F.lit(None).cast("string").alias("title"))


def compared(spark, d) -> DataFrame:
    """Every concept as a topic of the graph, and every name of a part, which no concept has, as a topic of titles."""
    c = replace(the_corpus(spark, d), works=cited_works(spark, d))
    topics = c.concepts.select(F.col("cid").alias("topic"), F.col("cid").alias("a")).union(part_names(spark, d).select("name", F.lit(None).cast("string")))
    return mining.run_compare(c, topics, titles(spark, d), CONFIG)


_COMPARED = sql(
    _CITED + ", " + _MINED.replace("%LIMIT%", "6") + f""", every AS (SELECT cid AS topic, true AS known FROM concepts UNION ALL SELECT DISTINCT p_name, false FROM part),
    x AS (SELECT a AS topic, 'graph' AS pipeline, c AS target, score, n_citations AS citations, level < 2 AS nonsense, {_TEXT_LENGTH} AS actionable FROM links JOIN cites USING (a, c)
      UNION ALL SELECT topic, 'graph', '(none)', 0, 0, true, false FROM every WHERE NOT known
      UNION ALL SELECT topic, 'titles', target, paper_count, n_supporting, false, true FROM proposed
      UNION ALL SELECT topic, 'titles', '(none)', 0, 0, false, false FROM every WHERE topic NOT IN (SELECT topic FROM proposed))""", results=6
)


@query(_COMPARED + " SELECT topic, pipeline, target, round(score::DOUBLE, 6) AS score, citations::BIGINT AS citations, nonsense, actionable FROM x")
def compare(spark, d):
    return compared(spark, d).select("topic", "pipeline", "target", *r6("score"), "citations", "nonsense", "actionable")


@query(_COMPARED + """ SELECT pipeline, count(*) AS count, round(avg(nonsense::INT)::DOUBLE, 9) AS nonsense_rate, round(avg(actionable::INT)::DOUBLE, 9) AS actionable_rate,
    round(avg(citations)::DOUBLE, 9) AS avg_citations FROM x GROUP BY pipeline""")
def compare_summary(spark, d):
    out = mining.compare_summary(compared(spark, d))
    return out.select("pipeline", "count", *[F.round(c, 9).alias(c) for c in ("nonsense_rate", "actionable_rate", "avg_citations")])


# --- whole runs, extension points and the rest of the survey ------------------------------------------------------


@query(sql(_VERIFIED + _CITED.replace("found AS", "found_ AS").replace("FROM found WHERE", "FROM found_ WHERE") + """ SELECT a, c, hits, verdict, plausibility, n_citations::BIGINT AS n_citations,
    row_number() OVER (PARTITION BY a ORDER BY round(verified_novelty * greatest(plausibility, 0.05), 9) DESC, rank, c) AS final_rank FROM bands JOIN cites USING (a, c)"""))
def discover_run(spark, d):
    """A whole run: links, hypotheses, cited works, verification, new order."""
    c = replace(the_corpus(spark, d), works=cited_works(spark, d))
    out = agent.run_discover(c, the_topics(c), CONFIG, verify=True)
    return out.select("a", "c", "hits", "verdict", "plausibility", "n_citations", F.col("final_rank").cast("long").alias("final_rank"))


@query(sql(""", pairs AS (SELECT a, c FROM links),
    both_ AS (SELECT p.a, p.c, x.dst AS b, sqrt(greatest(x.n, 1e-6) * greatest(y.n, 1e-6)) AS strength FROM pairs p JOIN normed x ON x.src = p.a JOIN normed y ON y.src = p.c AND y.dst = x.dst JOIN spec ON cid = x.dst WHERE level >= 2 AND x.dst <> p.a AND x.dst <> p.c),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, c ORDER BY round(strength, 9) DESC, b) AS b_rank FROM both_) WHERE b_rank <= 10),
    told AS (SELECT a, c, sum(strength) AS total, count(*) AS n, string_agg(b, ';' ORDER BY b_rank) AS via FROM top GROUP BY a, c)
    SELECT a, c, via, n AS bridge_support, round(total, 6) AS score, coalesce(h, 0)::BIGINT AS hits, CASE WHEN coalesce(h, 0) = 0 THEN 'open' WHEN h <= 30 THEN 'emerging' ELSE 'established' END AS verdict
    FROM told """ + _HITS))
def explain_run(spark, d):
    """Every link explained, with its hypothesis, cited works and verdict."""
    c = replace(the_corpus(spark, d), works=cited_works(spark, d))
    out = agent.run_explain(c, discover(c, the_topics(c), CONFIG).select("a", "c"), CONFIG, verify=True)
    return out.select("a", "c", F.array_join("bridge_ids", ";").alias("via"), "bridge_support", *r6("score"), "hits", "verdict")


@query(sql(_LINK, gate="support >= 2 AND lift <= 1.0"))
def support_gate(spark, d):
    c = the_corpus(spark, d)
    return link_columns(discover(c, the_topics(c), CONFIG.with_(min_bridge_support=2)))


@query(sql(_LINK, novelty="1.0::DOUBLE / (1 + direct)", gate="true"))
def own_novelty(spark, d):
    """A scorer of one's own in place of a mode."""
    c = the_corpus(spark, d)
    return link_columns(discover(c, the_topics(c), CONFIG.with_(novelty_scorer=lambda short: 1 / (1 + F.col("direct")))))


@query(sql(""" SELECT src, dst, cooc, r AS n_rank, name FROM near JOIN names ON dst = cid""", "corpus"))
def grouped_neighbours(spark, d):
    c = the_corpus(spark, d)
    return C.group_neighbours(c.edges, c.concepts, POOL).select("src", "dst", "cooc", F.col("n_rank").cast("long").alias("n_rank"), "name")


@query(sql(""" SELECT cid, CASE WHEN hash_level = 0 THEN level ELSE hash_level END AS level, CASE WHEN hash_level = 0 THEN works_count ELSE 7 END AS works_count
    FROM (SELECT *, CASE WHEN cid LIKE '%PROMO' THEN 0 ELSE 3 END AS hash_level FROM concepts)""", "corpus"))
def hydrated(spark, d):
    """Concepts of unknown level get level and count of the graph's; the others keep theirs."""
    c = the_corpus(spark, d)
    known = F.when(F.endswith("cid", F.lit("PROMO")), 0).otherwise(3)
    frame = c.concepts.select("cid", known.alias("level"), F.lit(7).cast("long").alias("works_count"))
    return C.with_meta(frame, c.concepts).select("cid", "level", "works_count")


_WORK_TEXTS = "(SELECT o_orderkey AS work, 'order of ' || string_agg(DISTINCT p_name, ' and ' ORDER BY p_name) AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey)"


@query(
    f"""WITH t AS MATERIALIZED (SELECT DISTINCT p_name AS topic FROM part), texts AS MATERIALIZED (SELECT work, ' ' || trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM {_WORK_TEXTS}),
    found AS (SELECT topic, work FROM t JOIN texts ON contains(texts.t, ' ' || lower(topic) || ' ')),
    wc AS (SELECT DISTINCT l_orderkey AS work, p_brand || ' ' || p_name AS cid FROM lineitem JOIN part ON l_partkey = p_partkey),
    g AS (SELECT topic, cid, count(*) AS n FROM found JOIN wc USING (work) GROUP BY ALL),
    o AS (SELECT *, len(list_intersect({_TOKENS.format(n='topic')}, list_filter({_TOKENS.format(n='cid')}, lambda t: NOT list_contains({_sql_list(K.TOPIC_STOP)}, t)))) AS overlap FROM g)
    SELECT topic, cid, overlap::INT AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY overlap DESC, n DESC, cid) AS r FROM o WHERE overlap > 0) WHERE r = 1"""
)
def resolve_from_works(spark, d):
    """The concept of works that mention a name, for every name of a part."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("work"), "p_name", F.concat_ws(" ", "p_brand", "p_name").alias("cid")).distinct()
    works = lines.groupBy("work").agg(F.concat(F.lit("order of "), F.array_join(F.array_sort(F.collect_set("p_name")), " and ")).alias("title")).withColumn("text", F.lit(""))
    concepts = lines.select("cid").distinct().select("cid", F.col("cid").alias("name"), F.lit(3).alias("level"))
    topics = part_names(spark, d).withColumnRenamed("name", "topic")
    return C.resolve_from_works(topics, works, lines.select("work", "cid"), concepts).select("topic", "cid", "overlap")


@query(sql(""" SELECT a, c, 'Source: ' || a || chr(10) || 'Target: ' || c || chr(10) || 'Bridges: ' || replace(bridges, ';', ', ') || chr(10) || 'Works:' || chr(10) || '- ' || a || chr(10) || '- ' || c AS prompt FROM links"""))
def prompts(spark, d):
    c = the_corpus(spark, d)
    links = discover(c, the_topics(c), CONFIG).withColumn("titles", F.array("a_name", "c_name"))
    return evidence.prompts(links, "titles").select("a", "c", "prompt")


@query("""SELECT event_id, coalesce(length(trim(m)), 0) > 20 AND coalesce(length(trim(e)), 0) > 15 AS actionable FROM
    (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE repeat('m ', (event_id % 19)::INT) END AS m, repeat('e', (event_id % 23)::INT) || '  ' AS e FROM events)""")
def actionable_texts(spark, d):
    k = F.col("event_id")
    m = F.when(k % 5 != 0, F.expr("repeat('m ', cast(event_id % 19 as int))"))
    e = F.concat(F.expr("repeat('e', cast(event_id % 23 as int))"), F.lit("  "))
    return table(spark, d, "events").select("event_id", evidence.actionable(m, e).alias("actionable"))


_SEED_VECS = "s AS (SELECT embedding FROM embeddings WHERE vec_id < 4)"
_COS = "list_sum(list_transform(range(1, 65), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE)) / sqrt(list_sum(list_transform({x}, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform({y}, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"WITH {_SEED_VECS}, v AS (SELECT vec_id, max({_COS.format(x='e.embedding', y='s.embedding')}) AS top FROM embeddings e CROSS JOIN s GROUP BY vec_id) SELECT vec_id, top >= 0.3 AS generic FROM v")
def semantic_filter(spark, d):
    """The four first vectors stand for stop names; what is near to one of them is generic."""
    v = table(spark, d, "embeddings")
    named = v.select("vec_id", F.when(F.col("vec_id") < 4, F.format_string("stop name %d", "vec_id")).otherwise(F.format_string("qqqq%d", F.col("vec_id") * 7919)).alias("name"), F.col("embedding").alias("vec"))
    flt = RelevanceFilter(name_stop=tuple(f"stop name {i}" for i in range(4)), ngram_generic_threshold=2.0, generic_semantic_threshold=0.3, embeddings=named)
    concepts = named.select(F.col("vec_id").alias("cid"), "name", F.lit(3).alias("level"), F.lit(10).alias("works_count"))
    return flt.features(concepts).select(F.col("cid").alias("vec_id"), "generic")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice / (o_custkey % 3) ELSE -1 END AS ratio FROM orders""")
def safe_ratio(spark, d):
    k = F.col("o_custkey") % 3
    return table(spark, d, "orders").select("o_orderkey", N.safe_div(F.col("o_totalprice"), k, -1.0).alias("ratio"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'name ' || label ELSE NULL END AS heading FROM embeddings""")
def canonical_headings(spark, d):
    """The heading of a query translation; every third text has one."""
    name = F.concat(F.lit("name "), F.col("label").cast("string"))
    text = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit('("'), name, F.lit('"[MeSH Terms] OR "x"[All Fields])'))).otherwise(F.concat(name, F.lit("[All Fields]")))
    return table(spark, d, "embeddings").select("vec_id", typing.canonical_heading(text).alias("heading"))


@query(
    """WITH r AS (SELECT DISTINCT l_suppkey AS a, p_name AS c_name, l_orderkey AS place, p_name || ' ' || p_type AS title, p_brand AS excerpt, o_orderdate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
    u AS (SELECT *, row_number() OVER (PARTITION BY a, c_name ORDER BY place, title, excerpt) AS r FROM r)
    SELECT a, c_name, count(*) FILTER (r <= 8 AND contains(lower(title || ' ' || excerpt), 'promo') AND contains(lower(title || ' ' || excerpt), lower(c_name))) AS hits,
      string_agg(place || '/' || title || '/' || excerpt || '/' || year(o_orderdate), ';' ORDER BY r) FILTER (r <= 4) AS items FROM u GROUP BY ALL"""
)
def search_evidence(spark, d):
    """Results of searches as evidence, for every supplier and name: hits are those of the first eight that mention both names, items the first four with snippet and year."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("string").alias("date"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(part, "l_partkey").join(orders, "l_orderkey")
    results = lines.select(
        F.col("l_suppkey").alias("a"), F.col("p_name").alias("c"), F.col("l_orderkey").alias("place"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.array("p_brand").alias("excerpts"),
        F.lit(None).cast("string").alias("url"), F.lit("orders").alias("source"), "date",
    ).distinct()
    pairs = results.select("a", "c").distinct().select("a", "c", F.lit("promo").alias("a_name"), F.col("c").alias("c_name"))
    told = F.transform("items", lambda i: F.concat_ws("/", i["place"].cast("string"), i["title"], i["snippet"], i["year"].cast("string")))
    return evidence.from_search(results)(pairs).select("a", F.col("c").alias("c_name"), "hits", F.array_join(told, ";").alias("items"))


# --- sources, slices of time, late works, look-ups ------------------------------------------------------------------


def written_lines(lines: DataFrame, name: str, by: str | None = None) -> str:
    """The column ``value`` as text files in the shared folder, in a folder by ``by``; their path."""
    path = scratch(lines.sparkSession, name)
    writer = lines.write.partitionBy(by) if by else lines.write
    writer.text(path)
    return owned(lines.sparkSession, path)


@query(sql(" SELECT src, dst, cooc FROM edges", "corpus", years="year BETWEEN 1996 AND 1998"))
def plugged_source(spark, d):
    """The graph of three years, from a source that is plugged in: works as JSON records in folders by year, of which the window's alone are read."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("|", "p_brand", "p_type").alias("id"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")
    sets = lines.groupBy("l_orderkey").agg(F.collect_set(F.struct("id", F.col("id").alias("display_name"))).alias("concepts"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("long").alias("cited_by_count"))
    record = F.to_json(F.struct(F.concat(F.lit("https://works.example/"), "l_orderkey").alias("id"), F.col("year").alias("publication_year"), "cited_by_count", "concepts"))
    path = written_lines(sets.join(orders, "l_orderkey").select(record.alias("value"), "year"), "plugged", "year")
    W.register(spark)
    return W.corpus_from(spark, year_from=1996, year_to=1998, path=path).edges


_TORN, _NAMELESS = "doc_id % 7 = 3", "doc_id % 11 = 5"


def records(spark, d) -> DataFrame:
    """Documents as nested records, one a row: text as an inverted index, language and source as concepts. Every seventh is torn in the middle, every
    eleventh has no id."""
    docs = table(spark, d, "documents")
    concept = lambda c, level: F.struct(F.concat(F.lit(f"https://works.example/{c}-"), c).alias("id"), F.col(c).alias("display_name"), F.lit(level).alias("level"))
    rows = docs.select(
        "doc_id", F.when(~F.expr(_NAMELESS), F.concat(F.lit("https://works.example/W"), "doc_id")).alias("id"), F.left("text", F.lit(60)).alias("display_name"),
        T.year_from(F.col("text")).alias("publication_year"), F.col("n_chars").alias("cited_by_count"), F.array(concept("lang", 1), concept("source", 2)).alias("concepts"),
        T.inverted_index(F.col("text")).alias("abstract_inverted_index"),
    )
    value = F.to_json(F.struct("id", "display_name", "publication_year", "cited_by_count", "abstract_inverted_index", "concepts"))
    return rows.select(F.when(F.expr(_TORN), F.left(value, (F.length(value) / 2).cast("int"))).otherwise(value).alias("value"))


@query(f"""SELECT 'W' || doc_id AS work, coalesce(nullif(trim(left(text, 60)), ''), '(untitled)') AS title, nullif(regexp_extract(text, '((?:19|20)[0-9]{{2}})', 1), '')::INT AS year, n_chars AS cited, md5(text) AS text_md5,
    'lang-' || lang || ';source-' || source AS concepts FROM documents WHERE NOT ({_TORN}) AND NOT ({_NAMELESS})""")
def ingested_works(spark, d):
    """Works read from nested records: their abstracts are put together again from the index, their concepts stand in order."""
    got = W.ingest(records(spark, d))
    concepts = got.work_concepts.groupBy("work").agg(F.array_join(F.array_sort(F.collect_set("cid")), ";").alias("concepts"))
    return got.works.join(concepts, "work").select("work", "title", "year", "cited", F.md5(F.col("text").cast("binary")).alias("text_md5"), "concepts")


@query(f"""SELECT CASE WHEN {_TORN} THEN 'malformed' ELSE 'no id' END AS reason, count(*) AS n FROM documents WHERE {_TORN} OR {_NAMELESS} GROUP BY 1""")
def rejected_works(spark, d):
    """What an ingest sets aside, by reason."""
    return W.ingest(records(spark, d)).rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_SPLITS = tuple(range(1995, 2001))


@query(" UNION ALL ".join(f"SELECT {y} AS split, * FROM ({back_test_sql(y)} {_SUMMED})" for y in _SPLITS))
def backtest_splits(spark, d):
    """Back-tests at every year but the last, in one plan over counts by year."""
    wc = work_concepts(spark, d)
    cube = backtest.TimeCube.from_work_concepts(wc, names(wc))
    topics = cube.concepts.select(F.col("cid").alias("a"))
    return backtest.splits_summary(backtest.run_splits(cube, topics, _SPLITS, CONFIG))


#: Rows of a file of the stream, so that batches are as many files as their size asks for.
FILE_ROWS = 2_000_000


@query(sql(" SELECT src, dst, cooc FROM edges", "corpus"))
def late_works(spark, d):
    """The whole graph from a stream in which a work's concepts come in several batches, some of them twice."""
    rows = work_concepts(spark, d).select("work", "cid")
    path = owned(spark, scratch(spark, "late"))
    files = -(-rows.count() // FILE_ROWS) or 1  # of a batch
    rows.where("pmod(xxhash64(work, cid), 3) < 2").repartition(2 * files, "work", "cid").write.parquet(f"{path}/in")
    rows.where("pmod(xxhash64(work, cid), 3) > 0").repartition(files, "work", "cid").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    stream.writeStream.foreachBatch(merge_works(path)).option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start().awaitTermination()
    return merged(spark, path)


@query("SELECT DISTINCT p_name AS key, CASE WHEN length(p_name) % 5 = 0 THEN NULL ELSE p_type || ' of ' || p_name END AS answer FROM (SELECT p_name, min(p_type) AS p_type FROM part GROUP BY p_name)")
def remembered_lookups(spark, d):
    """Names looked up at a caller's service, first half of them, then all: the second time only what isn't known is asked. Names of a length that five divides fail."""
    kinds = {r.p_name: r.t for r in table(spark, d, "part").groupBy("p_name").agg(F.min("p_type").alias("t")).orderBy("p_name").collect()}
    memo = Memo(spark)
    owned(spark, memo.path)
    service = lambda keys: ((k, f"{kinds[k]} of {k}" if len(k) % 5 else None) for k in keys)
    asked = part_names(spark, d).withColumnRenamed("name", "key")
    memo.ask(asked.where(F.length("key") % 2 == 0), service).count()
    return memo.ask(asked, service).select("key", "answer")


@query(
    sql(""", p AS (SELECT src, dst, cooc, 'the ' || dst || ' line' AS c_name FROM near JOIN topics ON src = a WHERE r <= 3 UNION ALL SELECT cid, NULL, 0, 'nobody knows ' || level FROM concepts)
    SELECT upper(src) AS a_name, c_name, src AS a, dst AS c, cooc::BIGINT AS hits FROM p""", "corpus")
)
def comention_by_names(spark, d):
    """Every concept by its name in capitals, with its three strongest neighbours by a text that holds theirs, and with a name that nothing has."""
    c = the_corpus(spark, d)
    near = C.neighbours(c.graph(), 3).select(F.upper("src").alias("a_name"), F.concat(F.lit("the "), "dst", F.lit(" line")).alias("c_name"))
    unknown = c.concepts.select(F.upper("cid").alias("a_name"), F.concat(F.lit("nobody knows "), F.col("level").cast("string")).alias("c_name"))
    return C.comentions_by_name(c, near.union(unknown))


@query(sql(""" SELECT src || ';' || dst AS set_id, 'stand-in:' || src || ';' || dst AS work, src || ' and ' || dst AS title, 2011 AS year FROM near""", "corpus"))
def stand_in_works(spark, d):
    """Works for every pair of a concept and a neighbour, as a graph without works has none."""
    c = the_corpus(spark, d)
    sets = C.neighbours(c.graph(), POOL).select(F.concat_ws(";", "src", "dst").alias("set_id"), F.array("src", "dst").alias("cids"))
    return C.stand_in_works(sets, c.concepts).select("set_id", "work", "title", "year")


# --- similarity without all pairs -----------------------------------------------------------------------------------

_LONG_NAMES = f"g AS MATERIALIZED (SELECT name, {_GRAMS.format(s='s')} AS g FROM (SELECT DISTINCT p_brand || ' ' || p_type || ' ' || p_name AS name, regexp_replace(lower(p_brand || ' ' || p_type || ' ' || p_name), '[^a-z0-9]', '', 'g') AS s FROM part))"


@query(
    f"""WITH {_LONG_NAMES}, e AS (SELECT name, len(g) AS n, unnest(g) AS item FROM g), p AS (SELECT x.name AS a, y.name AS b, count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)) AS j FROM e x JOIN e y ON x.item = y.item AND x.name < y.name GROUP BY ALL)
    SELECT a, b, round(j, 6) AS jaccard FROM p WHERE round(j, 9) >= 0.8"""
)
def similar_names(spark, d):
    """Full names alike at 0.8 or more of their n-grams, by prefixes of rare n-grams."""
    full = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("name")).distinct()
    return similar_sets(full.withColumn("g", T.char_ngrams(F.col("name"))), 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(
    """WITH l AS (SELECT DISTINCT l_orderkey AS work, l_partkey AS part FROM lineitem), v AS (SELECT work, part, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM l LEFT JOIN embeddings ON vec_id = part),
    u AS (SELECT work, part, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
    p AS (SELECT x.work, avg(coalesce(list_sum(list_transform(range(1, 65), lambda i: x.e[i] * y.e[i])), 0)) AS m FROM u x JOIN u y ON x.work = y.work AND x.part < y.part GROUP BY x.work)
    SELECT l.work, count(*) AS n, round(coalesce(max(m), 0)::DOUBLE, 6) AS mean_cosine, coalesce(round(greatest(0, least(1, 1 - max(m)))::DOUBLE, 3), 1)::DOUBLE AS diversity FROM l LEFT JOIN p ON p.work = l.work GROUP BY l.work"""
)
def bridge_diversity_vectors(spark, d):
    """The diversity of an order's parts by vectors, a part without one being like none."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("work"), F.col("l_partkey").alias("vec_id"))
    n = tasks(lines)
    lines, _ = stored(lines.repartition(n, "work").distinct(), "lines")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    means = mean_cosine(lines.repartition(n, "vec_id").join(vectors, "vec_id", "left"), "work", members=lines)  # a vec_id is one vector's
    return means.select("work", "n", F.round(F.coalesce("mean_cosine", F.lit(0.0)), 6).alias("mean_cosine"), diversity_of(F.col("mean_cosine")).alias("diversity"))
