"""Back-test: links found in the past, held against the mentions of the years after."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.discovery import DiscoveryConfig, discover, rounded
from lacuna.session import stored
from lacuna.sources.corpus import BLOCK, Corpus, concept_pairs, mirrored


def backtest_links(
    past: Corpus, topics: DataFrame, past_hits: DataFrame, future_hits: DataFrame, config: DiscoveryConfig = DiscoveryConfig(),
    k: int = 10, emergence_threshold: int = 3, novelty_ceiling: int = 2,
) -> DataFrame:
    """All links of the pool with flags: a, c, score, past_comentions, future_comentions, novel_as_of_split, emerged, hit, chosen (the k best novel ones).

    past_hits, future_hits: (src, dst, hits). The pool has max(8 k, 80) candidates and results, the lift gate is off, and there is no
    type constraint."""
    pool = max(8 * k, 80)
    cfg = config.with_(n_candidates_checked=pool, max_results=pool, max_lift=1e9, target_categories=None)
    links = discover(past, topics, cfg)
    hits = lambda h, name: h.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("hits").alias(name))
    out = links.join(hits(past_hits, "past"), ["a", "c"], "left").join(hits(future_hits, "future"), ["a", "c"], "left")
    out = out.withColumns({"past_comentions": F.coalesce("past", F.lit(0)).cast("long"), "future_comentions": F.coalesce("future", F.lit(0)).cast("long")}).drop("past", "future")
    out = out.withColumn("novel_as_of_split", F.col("past_comentions") <= novelty_ceiling).withColumn("emerged", F.col("future_comentions") >= emergence_threshold)
    out = out.withColumn("hit", F.col("novel_as_of_split") & F.col("emerged"))
    w = Window.partitionBy("a").orderBy(F.col("novel_as_of_split").desc(), rounded("score").desc(), "c")
    return out.withColumn("chosen", F.col("novel_as_of_split") & (F.row_number().over(w) <= k))


def backtest_summary(links: DataFrame) -> DataFrame:
    """a, pool_size, n_novel_in_pool, n_links, n_hits, precision_at_k: hits over the links chosen, 0 without any."""
    n = lambda c: F.count_if(c)
    counts = (n(F.col("novel_as_of_split")).alias("n_novel_in_pool"), n(F.col("chosen")).alias("n_links"), n(F.col("chosen") & F.col("hit")).alias("n_hits"))
    out = links.groupBy("a").agg(F.count(F.lit(1)).alias("pool_size"), *counts)
    return out.withColumn("precision_at_k", F.when(F.col("n_links") > 0, F.col("n_hits") / F.col("n_links")).otherwise(F.lit(0.0)))


def by_year(corpus_of, split_year: int) -> tuple[Corpus, Corpus]:
    """corpus_of(year_from, year_to) -> the corpora up to the split year and after it."""
    return corpus_of(None, split_year), corpus_of(split_year + 1, None)


def counted_hits(corpus: Corpus) -> DataFrame:
    """src, dst, hits: the corpus's independent count of mentions, or its edges where it has none."""
    return corpus.comentions if corpus.comentions is not None else corpus.graph().select("src", "dst", F.col("cooc").alias("hits"))


def run_backtest(past: Corpus, future: Corpus, topics: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), **options) -> DataFrame:
    """``backtest_links`` on the counts of the two corpora."""
    return backtest_links(past, topics, counted_hits(past), counted_hits(future), config, **options)


@dataclass(frozen=True)
class TimeCube:
    """Pairs of concepts by year, from which the graph before and after any number of years is summed: counts (src, dst, year, n) with src < dst,
    written once; concepts (cid, name, level, works_count) and size of all years."""

    counts: DataFrame
    concepts: DataFrame
    size: DataFrame | int

    @classmethod
    def from_work_concepts(cls, work_concepts: DataFrame, names: DataFrame, block: int = BLOCK) -> "TimeCube":
        """work_concepts: (work, cid, year). A pair is of the later of its two years; rows without a year are in no slice of time."""
        dated = work_concepts.where("work is not null and cid is not null and year is not null").groupBy("work", "cid").agg(F.min("year").alias("year"))
        counts, _ = stored(concept_pairs(dated, block).groupBy("src", "dst", "year").agg(F.count(F.lit(1)).alias("n")), "cube")
        meta = Corpus.from_work_concepts(work_concepts, names)
        return cls(counts, meta.concepts, meta.size)

    def edges(self, splits: Sequence[int], after: bool = False) -> DataFrame:
        """split, src, dst, cooc: for each split year the works up to it, or after it. A year's count goes to the splits that it counts for and is summed there: work
        grows with the pairs and years that occur, not with the works."""
        years = F.array(*[F.lit(int(s)) for s in splits]).cast("array<int>")
        of = F.filter(years, lambda s: (F.col("year") > s) if after else (F.col("year") <= s))
        return mirrored(self.counts.select("src", "dst", "n", F.explode(of).alias("split")).groupBy("split", "src", "dst").agg(F.sum("n").alias("cooc")))


def run_splits(cube: TimeCube, topics: DataFrame, splits: Sequence[int], config: DiscoveryConfig = DiscoveryConfig(), **options) -> DataFrame:
    """``run_backtest`` at every split year, in one plan: the links' columns after ``split``.

    A concept at a split is a concept of its own, named split|cid, and edges join those of one split, so one discovery over all of them is
    the discoveries of each. Levels, counts of works and the size are those of all years, as in a single back-test."""
    name = lambda c: F.concat_ws("|", F.col("split").cast("string"), c)
    tagged = lambda e: e.select(name("src").alias("src"), name("dst").alias("dst"), "cooc")
    every = F.explode(F.array(*[F.lit(int(s)) for s in splits])).alias("split")
    concepts = cube.concepts.select(every, "*").withColumn("cid", name("cid")).drop("split")
    past = Corpus(concepts, tagged(cube.edges(splits)), cube.size).kept(config.bridge_pool)
    future = tagged(cube.edges(splits, after=True)).withColumnRenamed("cooc", "hits")
    links = backtest_links(past, topics.select("a", every).select(name("a").alias("a")), counted_hits(past), future, config, **options)
    plain = lambda c: F.expr(f"substring({c}, instr({c}, '|') + 1)")
    out = links.withColumn("split", F.split_part("a", F.lit("|"), F.lit(1)).cast("int"))
    out = out.withColumns({"a": plain("a"), "c": plain("c"), "bridge_ids": F.transform("bridge_ids", lambda b: F.substring(b, F.instr(b, F.lit("|")) + 1, F.length(b)))})
    return out.select("split", *links.columns)


def splits_summary(links: DataFrame) -> DataFrame:
    """``backtest_summary`` by split: split, a, pool_size, n_novel_in_pool, n_links, n_hits, precision_at_k."""
    out = backtest_summary(links.withColumn("a", F.struct("split", "a")))
    return out.select("a.split", "a.a", *out.columns[1:])
