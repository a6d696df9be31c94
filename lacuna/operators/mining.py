"""Proposals of targets mined from titles, and the comparison of pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import text as T
from lacuna.operators.discovery import DiscoveryConfig
from lacuna.operators.filters import RelevanceFilter, nonsense_target
from lacuna.session import stored
from lacuna.sources.corpus import Corpus, union_all


def bad_target(phrase: F.Column, terms: F.Column) -> F.Column:
    flt = RelevanceFilter()
    words = T.tokens(phrase)
    own = F.coalesce(F.arrays_overlap(words, terms), F.lit(False))
    empty = F.size(F.array_except(words, T.strings(K.TITLE_STOP))) == 0
    return (F.length(phrase) < 4) | flt.is_generic(phrase) | flt.bad_parenthetical(phrase) | own | empty


def mined(papers: DataFrame, limit: int = 8) -> DataFrame:
    """papers (topic, paper, title[, date]) in the order of ``paper``; the same paper may come up in several searches and then counts each time. Returns topic, target,
    paper_count (occurrences), distinct_papers, supporting (the first two titles, at most 80 characters), rank <= limit."""
    papers = papers.select("topic", "paper", "title").where(F.coalesce(F.col("title"), F.lit("")) != "")
    # a title is read once a topic, whichever papers have it; written, as Spark would push what tests its phrases down to every paper
    titles, _ = stored(papers.select("topic", "title").distinct().repartition(papers.sparkSession.sparkContext.defaultParallelism), "titles")
    titles = titles.withColumn("terms", T.topic_terms(F.col("topic"))).where(T.mentions_topic(F.col("title"), F.col("terms")))
    said, _ = stored(titles.select("topic", "title", "terms", F.posexplode(T.phrases(F.col("title"), F.col("terms"))).alias("k", "target")), "phrases")
    # a phrase is judged once a topic, however often it occurs
    good = said.select("topic", "terms", "target").distinct().where(~bad_target(F.col("target"), F.col("terms"))).select("topic", "target")
    said, _ = stored(said.drop("terms").join(good, ["topic", "target"]), "targets")
    rows = papers.join(said, [papers["topic"].eqNullSafe(said["topic"]), papers["title"] == said["title"]]).select(said["topic"], "paper", said["title"], "k", "target")
    place = Window.partitionBy("topic", "target").orderBy("paper", "k")
    # no more than two rows of a target leave a task for this, and a row a paper for the counts
    first = rows.withColumn("place", F.row_number().over(place)).where("place <= 2").groupBy("topic", "target")
    first = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("title", 1, 80).alias("t")))), lambda x: x["t"]).alias("supporting"))
    each = rows.groupBy("topic", "target", "paper").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy("topic", "target").agg(F.sum("n").alias("paper_count"), F.count("paper").alias("distinct_papers")).join(first, ["topic", "target"])
    w = Window.partitionBy("topic").orderBy(F.desc("paper_count"), "target")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("score", F.col("paper_count").cast("double"))


def searches(*found: DataFrame) -> DataFrame:
    """The papers of several searches, one after another; a paper that several find counts in each."""
    return union_all(list(found))


def proposals_as_links(proposals: DataFrame) -> DataFrame:
    """Mined proposals in the columns of links: level 3, novelty 0.7, support of one bridge at least. Works that mention both are
    ``direct_hits`` where the proposals have them, 0 where those are unknown."""
    n = F.greatest(F.lit(1), F.size("supporting"))
    direct = F.greatest(F.lit(0), F.coalesce("direct_hits", F.lit(0))) if "direct_hits" in proposals.columns else F.lit(0)
    return proposals.select(
        F.concat(F.lit("mined:"), "topic").alias("a"), F.col("topic").alias("a_name"), F.concat(F.lit("mined:"), "target").alias("c"), F.col("target").alias("c_name"),
        F.lit(3).alias("c_level"), "rank", F.col("supporting").alias("bridges"), n.cast("long").alias("bridge_support"), direct.cast("long").alias("direct"),
        F.lit(0.7).alias("novelty"), "score", F.lit(0).cast("long").alias("comention_count"), F.size("supporting").cast("long").alias("n_citations"),
    )


COMPARED = ("pipeline", "target", "bridges", "score", "verdict", "citations", "nonsense", "actionable", "note")


def compare_rows(pipeline: str, hyps: DataFrame, verified: bool = True, *keep: str) -> DataFrame:
    """The columns in ``keep``, then pipeline, target, bridges, score, verdict, citations, nonsense, actionable, note."""
    from lacuna.operators.evidence import actionable

    verdict = F.col("verdict") if verified else F.lit("—")
    cited = F.col("n_citations") if "n_citations" in hyps.columns else F.lit(0)
    return hyps.select(
        *keep, F.lit(pipeline).alias("pipeline"), F.col("c_name").alias("target"), F.array_join(F.slice("bridges", 1, 3), ", ").alias("bridges"),
        "score", verdict.alias("verdict"), cited.cast("long").alias("citations"),
        nonsense_target(F.col("c_name"), F.col("c_level")).alias("nonsense"),
        actionable(F.col("mechanism"), F.col("experiment")).alias("actionable"), F.concat(F.lit("A="), "a_name").alias("note"),
    )


def compare_summary(rows: DataFrame) -> DataFrame:
    """Per pipeline: count, nonsense_rate, actionable_rate, avg_citations."""
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    return rows.groupBy("pipeline").agg(F.count(F.lit(1)).alias("count"), rate("nonsense"), rate("actionable"), F.avg("citations").alias("avg_citations"))


def placeholders(topics: DataFrame, pipeline: str, target: str, note: str) -> DataFrame:
    """The row of each topic (topic) for which a pipeline has none: "(none)" without a result, "(skipped)" without a source."""
    values = {"pipeline": pipeline, "target": target, "bridges": "", "score": 0.0, "verdict": "—", "citations": 0, "nonsense": False, "actionable": False, "note": note}
    columns = [F.lit(v).cast("long").alias(k) if k == "citations" else F.lit(v).alias(k) for k, v in values.items()]
    return topics.select("topic", *columns)


def run_compare(
    corpus: Corpus, topics: DataFrame, papers: DataFrame | None = None, config: DiscoveryConfig = DiscoveryConfig(),
    max_rows: int = 6, verify: bool = False, provider=None,
) -> DataFrame:
    """The rows of both pipelines for each topic: the graph's links, and targets mined from titles.

    topics: (topic, a), a null where the topic has no concept. papers: (topic, paper, title) of searches, None where there is no source
    of them. Returns topic and the columns of ``compare_rows``; a topic without a concept, or without a mined target, has a row "(none)"
    (the first one counts as nonsense), and without papers each topic has a row "(skipped)"."""
    from lacuna.operators import agent, evidence

    topics = corpus.hold(topics.select("topic", "a").distinct(), "topics")
    known = topics.where("a is not null")
    hyps = agent.run_discover(corpus, known.select("a"), config.with_(max_results=max_rows), verify=verify, provider=provider)
    of_graph = compare_rows("graph", hyps, verify, "a").join(known, "a").drop("a")
    parts = [of_graph, placeholders(topics.where("a is null"), "graph", "(none)", "No concept for the topic.").withColumn("nonsense", F.lit(True))]
    if papers is None:
        parts.append(placeholders(topics, "titles", "(skipped)", "No papers to mine."))
    else:
        links = corpus.hold(proposals_as_links(mined(papers.join(topics.select("topic").distinct(), "topic", "left_semi"), max_rows)), "mined")
        own = evidence.hypotheses(links)
        if verify and provider is not None:
            own = evidence.verify(own, provider(links.select("a", "c", "a_name", "c_name")))
        parts.append(compare_rows("titles", own, verify and provider is not None, "a_name").withColumnRenamed("a_name", "topic"))
        none = topics.join(links.select(F.col("a_name").alias("topic")).distinct(), "topic", "left_anti")
        parts.append(placeholders(none, "titles", "(none)", "No phrases found in the titles."))
    return union_all([p.select("topic", *COMPARED) for p in parts])
