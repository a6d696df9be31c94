"""Hypotheses: verification against an independent count, self-critique, texts, citations, re-ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import novelty as N
from lacuna.functions import text as T
from lacuna.operators.discovery import rounded
from lacuna.sources.corpus import text_comentions, works_with_all


@dataclass(frozen=True)
class VerifierConfig:
    emerging_max: int = 30
    open_max: int = 0


def hypotheses(links: DataFrame) -> DataFrame:
    """links with statement, mechanism, experiment, rationale, plausibility, after self-critique."""
    via = T.joined(F.col("bridges"))
    plausible = F.least(F.lit(1.0), 0.4 + 0.15 * F.col("bridge_support"))
    out = links.withColumn("statement", F.concat("c_name", F.lit(" may act on "), "a_name", F.lit(" by way of "), via, F.lit(".")))
    paths, works = F.col("bridge_support").cast("string"), F.col("direct").cast("string")
    both = (paths, F.lit(" path(s) of two steps join them, while "), works, F.lit(" work(s) mention both."))
    mechanism = F.concat(F.lit("Works on "), "a_name", F.lit(" mention "), via, F.lit(", and so do works on "), "c_name", F.lit("; "), *both)
    first = F.coalesce(F.get("bridges", F.lit(0)), F.lit("the intermediate"))
    measured = (F.lit(" under control, measure "), first, F.lit(" as mediator, and record a marker of "), "a_name")
    experiment = F.concat(F.lit("Vary "), "c_name", *measured, F.lit(" against a prediction made beforehand."))
    out = out.withColumn("mechanism", mechanism).withColumn("experiment", experiment)
    return critiqued(out.withColumn("rationale", F.col("mechanism")).withColumn("plausibility", plausible)).withColumn("generated_by", F.lit("fallback"))


def critiqued(hyps: DataFrame) -> DataFrame:
    """Plausibility down by a fifth for a single bridge; notes on single bridges and on well supported links that nobody has stated."""
    single, strong = F.col("bridge_support") <= 1, (F.col("direct") == 0) & (F.col("bridge_support") >= 3)
    alone = F.when(single, " [critique] One bridge only: speculative until another is found.").otherwise("")
    note = F.concat(alone, F.when(strong, " [critique] Several bridges and no work that mentions both: worth a look.").otherwise(""))
    p = F.when(single, F.col("plausibility") * 0.8).otherwise(F.col("plausibility"))
    return hyps.withColumn("rationale", F.concat("rationale", note)).withColumn("plausibility", F.round(F.least(F.lit(1.0), p), 3))


def verify(hyps: DataFrame, counts: DataFrame, config: VerifierConfig = VerifierConfig(), missing: int = 0) -> DataFrame:
    """counts (a, c, hits[, items]): works that mention both; -1 for unknown. Adds hits, verdict, verified_novelty, verification_note."""
    cols = [c for c in ("hits", "items") if c in counts.columns]
    out = hyps.join(counts.select("a", "c", *cols), ["a", "c"], "left").withColumn("hits", F.coalesce("hits", F.lit(missing)).cast("long"))
    args = (F.col("hits"), config.open_max, config.emerging_max)
    return out.withColumn("verdict", N.verdict(*args)).withColumn("verified_novelty", N.verified_novelty(*args)).withColumn("verification_note", N.verdict_note(*args))


def reranked(hyps: DataFrame, per: str = "a") -> DataFrame:
    """final_rank by verified novelty, or novelty where there is none, times plausibility of at least 0.05."""
    key = F.coalesce("verified_novelty", "novelty") * F.greatest("plausibility", F.lit(0.05))
    w = Window.partitionBy(per).orderBy(rounded("rank_key").desc(), "rank", "c")
    return hyps.withColumn("rank_key", key).withColumn("final_rank", F.row_number().over(w))


def verdict_histogram(hyps: DataFrame) -> DataFrame:
    return hyps.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def citations(links: DataFrame, work_concepts: DataFrame, works: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """For the first two bridges of each link the most cited work of either leg; each work once a link: a, c, work and, with works, its columns."""
    legs = links.select("a", "c", F.posexplode(F.slice("bridge_ids", 1, 2)).alias("k", "b"))
    legs = legs.select("a", "c", "k", F.posexplode(F.array(F.array("a", "b"), F.array("b", "c"))).alias("leg", "cids"))
    sets = legs.withColumn("set_id", F.array_join(F.array_sort("cids"), "\u0001"))
    best = works_with_all(work_concepts, sets.select("set_id", "cids").dropDuplicates(["set_id"]), works, 1, tasks)
    w = Window.partitionBy("a", "c", "work").orderBy("k", "leg")
    found = sets.join(best, "set_id").withColumn("r", F.row_number().over(w)).where("r = 1")
    return found.drop("set_id", "cids", "r", "w_rank")


def with_citations(links: DataFrame, work_concepts: DataFrame, works: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """links with works_cited (structs of work and, with ``works``, title, year, url; in the order of bridges and legs) and n_citations."""
    found = citations(links.select("a", "c", "bridge_ids"), work_concepts, works, tasks)
    kept = [c for c in ("work", "title", "year", "url") if c in found.columns]
    each = found.groupBy("a", "c").agg(F.array_sort(F.collect_list(F.struct("k", "leg", *kept))).alias("_w"))
    out = links.join(each, ["a", "c"], "left").withColumn("works_cited", F.transform("_w", lambda x: F.struct(*[x[c].alias(c) for c in kept])))
    return out.withColumn("n_citations", F.coalesce(F.size("_w"), F.lit(0)).cast("long")).drop("_w")


#: What an item of evidence has, whatever found it.
ITEM = ("place", "title", "url", "snippet", "source", "year", "kind")


def from_texts(works: DataFrame, limit: int = 4):
    """A provider: works whose title or text mentions both names; the most cited ones as items, with the beginning of their text and the work."""

    def provide(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.struct("a", "c").alias("pair_id"), "a_name", "c_name").distinct()
        found = text_comentions(works, asked, limit).select("pair_id", "hits", F.explode_outer("items").alias("i"))
        told = works.select(F.col("work").alias("_w"), F.col("url") if "url" in works.columns else F.lit(None).cast("string").alias("url"), T.snippet(F.col("text")).alias("snippet"))
        rows = found.join(told, F.col("i.work") == F.col("_w"), "left")
        columns = (F.col("i.r"), F.col("i.title"), F.col("url"), F.coalesce("snippet", F.lit("")), F.lit("corpus"), F.col("i.year"), F.lit("paper"))
        item = F.when(F.col("i").isNotNull(), F.struct(*[c.alias(n) for c, n in zip(columns, ITEM)], F.col("i.work").alias("work")))
        return rows.groupBy("pair_id").agg(F.max("hits").alias("hits"), F.array_sort(F.collect_list(item)).alias("items")).select("pair_id.a", "pair_id.c", "hits", "items")

    return provide


def from_search(results: DataFrame, limit: int = 4, read: int | None = None):
    """A provider over results of searches that were made for pairs: results (a, c, place, title, excerpts array, url[, source, date]). Hits are those of the first
    ``read`` results (twice the limit, unless given) whose title or excerpts hold both names, without case; items are the first results, whether they do or
    not, with the beginning of their excerpts and the year of their date."""
    read = 2 * limit if read is None else read
    optional = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("string")

    def provide(pairs: DataFrame) -> DataFrame:
        said = F.array_join(F.coalesce("excerpts", T.strings(())), " ")
        text = F.lower(F.concat_ws(" ", "title", said))
        both = F.contains(text, F.lower("a_name")) & F.contains(text, F.lower("c_name"))
        rows = results.join(pairs.select("a", "c", "a_name", "c_name").distinct(), ["a", "c"]).withColumn("_both", both)
        # every column a result is told by decides, so that no tie is left to the order of rows
        w = Window.partitionBy("a", "c").orderBy("place", "title", said, "url", optional("source"), optional("date"))
        rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max(read, limit))
        columns = (F.col("place"), F.col("title"), F.col("url"), T.snippet(said), F.coalesce(optional("source"), F.lit("")), T.year_from(optional("date")), F.lit("web"))
        item = F.when(F.col("_r") <= limit, F.struct("_r", F.struct(*[c.alias(n) for c, n in zip(columns, ITEM)]).alias("i")))
        items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"])
        return rows.groupBy("a", "c").agg(F.count_if(F.col("_both") & (F.col("_r") <= read)).alias("hits"), items.alias("items"))

    return provide


#: Kinds of providers, the best first.
PROVIDERS = ("listing", "search", "texts", "counts")


def choose_provider(available: dict, prefer: str | None = None):
    """The provider (name, function) that is preferred, or else the best there is; None if there is none."""
    order = ([prefer] if prefer else []) + list(PROVIDERS)
    return next(((n, available[n]) for n in order if available.get(n) is not None), None)


def explained(links: DataFrame) -> DataFrame:
    """One line a link."""
    direct = F.when(F.col("comention_count") > 0, F.concat(F.lit(", comention="), F.col("comention_count").cast("string"))).otherwise("")
    via = (F.lit(" -> ["), F.array_join(F.slice("bridges", 1, 5), ", "), F.lit("] -> "))
    counts = (F.format_string(" (bridges=%d, direct=%d", "bridge_support", "direct"), direct, F.format_string(", score=%.3f)", "score"))
    line = F.concat("a_name", *via, "c_name", *counts)
    return links.withColumn("explanation", line)


def prompts(links: DataFrame, titles: str | None = None) -> DataFrame:
    """A prompt a link, with the titles (array column) of supporting works as bullets."""
    bullets = F.array_join(F.transform(F.col(titles), lambda t: F.concat(F.lit("- "), t)), "\n") if titles else F.lit("- none")
    ends = (F.lit("Source: "), "a_name", F.lit("\nTarget: "), "c_name")
    return links.withColumn("prompt", F.concat(*ends, F.lit("\nBridges: "), F.array_join("bridges", ", "), F.lit("\nWorks:\n"), bullets))


def actionable(mechanism: F.Column, experiment: F.Column) -> F.Column:
    return (F.length(F.trim(F.coalesce(mechanism, F.lit("")))) > 20) & (F.length(F.trim(F.coalesce(experiment, F.lit("")))) > 15)
