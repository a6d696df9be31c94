"""Open and closed discovery over many topics at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import novelty as N
from lacuna.functions import text as T
from lacuna.operators.filters import RelevanceFilter, make_filter
from lacuna.operators.similarity import diversity_of, mean_cosine
from lacuna.sources.corpus import Corpus, cooccurrence

MODES = ("concept_lift", "comention", "hybrid")


@dataclass(frozen=True)
class DiscoveryConfig:
    n_bridges: int = 10
    n_candidates_checked: int = 25
    max_results: int = 8
    min_level: int = 2
    target_categories: tuple[str, ...] | None = None
    n_typed_pool: int = 80
    max_lift: float = 2.0
    bridge_pool: int = 200
    filter_profile: str = "biomed"
    filters: RelevanceFilter | None = None
    novelty_mode: str = "concept_lift"
    novelty_weights: tuple[tuple[str, float], ...] = tuple(N.WEIGHTS.items())
    bridge_diversity_weight: float = 0.0
    apply_diversity: bool = False
    comention_novelty_scale: float = 30.0
    min_bridge_support: int = 1
    strict_types: bool = False
    #: A novelty of one's own: short list (the columns of ``discover`` so far, path_norm, expected_lift) -> Column in place of the mode's.
    novelty_scorer: Callable[[DataFrame], F.Column] | None = None

    @property
    def filter(self) -> RelevanceFilter:
        return self.filters or make_filter(self.filter_profile)

    def with_(self, **changes) -> "DiscoveryConfig":
        return replace(self, **changes)


def rounded(c) -> F.Column:
    """Sort keys at 9 decimals, so that the order of a sum's terms can't turn ties."""
    return F.round(c, 9)


def _packed(features: DataFrame, name: str, key: str) -> DataFrame:
    return features.select(F.col("cid").alias(key), F.struct(*features.columns).alias(name))


def bridges(corpus: Corpus, topics: DataFrame, config: DiscoveryConfig) -> tuple[DataFrame, DataFrame]:
    """topics (a). Returns the pool (a, b, cooc, an): all neighbours of a, normalised before any filter; and the chosen bridges
    (a, b, an, b_key, b_rank, bc, ac), bc and ac being the packed features."""
    flt = config.filter
    near = corpus.neighbours_of(topics.select(F.col("a").alias("src")), config.bridge_pool)
    pool = near.select(F.col("src").alias("a"), F.col("dst").alias("b"), "cooc", F.col("norm").alias("an"))
    if corpus.near is None:  # else it is a scan of what is written
        pool = corpus.hold(pool)
    features = pool_features(corpus, flt, pool.select("a").union(pool.select("b")))
    pairs = pool.join(_packed(features, "bc", "b"), "b").join(_packed(features, "ac", "a"), "a")
    good = pairs.where(flt.usable("bc", "ac", config.min_level)).withColumn("b_key", F.col("an") * N.specificity(F.col("bc.works_count")))
    w = Window.partitionBy("a").orderBy(rounded("b_key").desc(), "b")
    return pool, corpus.hold(good.withColumn("b_rank", F.row_number().over(w)).where(F.col("b_rank") <= config.n_bridges))


def pool_features(corpus: Corpus, flt: RelevanceFilter, wanted: DataFrame) -> DataFrame:
    """The filter's features of the wanted concepts (one column of ids) alone."""
    if not flt.costly:
        return flt.features(corpus.concepts)
    ids = wanted.toDF("cid").distinct()
    return corpus.hold(flt.features(corpus.concepts.join(ids, "cid", "left_semi")))


def candidates(corpus: Corpus, pool: DataFrame, chosen: DataFrame, config: DiscoveryConfig) -> DataFrame:
    """a, c, support, path, found (structs of a bridge's place, id, name): concepts two hops away that are no neighbours of a."""
    ends = corpus.neighbours_of(chosen.select(F.col("b").alias("src")), config.bridge_pool)
    ends = ends.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("norm").alias("bn"))
    paths = chosen.select("a", "b", "an", F.col("bc.name").alias("b_name")).join(ends, "b").where("c <> a")
    known = pool.select("a", F.col("b").alias("c"))  # the bridges are among them
    fresh = paths.join(known, ["a", "c"], "left_anti")
    found = F.array_sort(F.collect_list(F.struct((-rounded("an")).alias("k"), F.col("b").alias("id"), F.col("b_name").alias("name"))))
    return fresh.groupBy("a", "c").agg(F.count(F.lit(1)).alias("support"), F.sum(N.leg(F.col("an"), F.col("bn"))).alias("path"), found.alias("found"))


def typed(cands: DataFrame, types: DataFrame, config: DiscoveryConfig, name: str = "cc.name") -> DataFrame:
    """Candidates whose category is asked for, out of the first n_typed_pool of each topic. Where no type is known, or none fits, a topic keeps
    all its candidates, unless strict_types is set. types: (name, letters array<string>). Types are looked up for the pool alone."""
    wanted = T.strings(config.target_categories)
    known = types.select(F.col("name").alias("_tn"), "letters").where(F.arrays_overlap("letters", wanted)).select("_tn").distinct()
    fit = cands.where(F.col("p_rank") <= config.n_typed_pool).join(known, F.col(name) == F.col("_tn"), "left_semi")
    if config.strict_types:
        return fit
    return fit.union(cands.join(fit.select("a").distinct(), "a", "left_anti").select(*fit.columns))


def with_diversity(rows: DataFrame, embeddings: DataFrame | None) -> DataFrame:
    """rows (a, c, found, ...) with the diversity of their bridges: by vectors (name, vec), where there are some, else by words. A bridge without a
    vector is like none."""
    if embeddings is None:
        return rows.withColumn("diversity", diversity(F.col("found")))
    each = rows.select(F.struct("a", "c").alias("g"), F.explode("found.name").alias("name")).join(embeddings.select("name", "vec").dropDuplicates(["name"]), "name", "left")
    means = mean_cosine(each, "g").select("g.a", "g.c", diversity_of(F.col("mean_cosine")).alias("diversity"))
    return rows.join(means, ["a", "c"], "left").withColumn("diversity", F.coalesce("diversity", F.lit(1.0)))


def diversity(found) -> F.Column:
    """Mean of 1 - Jaccard over pairs of bridges, on the words that tell them apart, or all words where none does; 1 up to
    one bridge; 3 decimals."""
    words = lambda n: F.when(F.size(T.distinctive_tokens(n)) > 0, T.distinctive_tokens(n)).otherwise(T.tokens(n))
    sets = F.transform(found, lambda x: F.struct(words(x["name"]).alias("w")))
    n = F.size(found)
    each = F.transform(sets, lambda x, i: F.aggregate(F.slice(sets, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda s, y: s + 1 - T.jaccard(x["w"], y["w"])))
    total = F.aggregate(each, F.lit(0.0), lambda s, t: s + t)
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / (n * (n - 1) / 2))), 3))


@dataclass(frozen=True)
class Stages:
    """What a discovery makes on its way: the chosen bridges, all candidates, the short list that is checked, the links."""

    chosen: DataFrame
    found: DataFrame
    checked: DataFrame
    links: DataFrame


def discover(corpus: Corpus, topics: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), types: DataFrame | None = None) -> DataFrame:
    """Links from each topic to concepts that its literature reaches only through bridges.

    topics: (a), ids of concepts. Returns a, a_name, c, c_name, c_level, rank, bridges (names, the strongest first), bridge_ids, bridge_support,
    path_strength, direct, expected_lift, novelty, comention_count, diversity, signals, score, n_bridges, n_candidates.
    """
    return stages(corpus, topics, config, types).links


def stages(corpus: Corpus, topics: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), types: DataFrame | None = None) -> Stages:
    """``discover`` with the frames on its way."""
    if config.novelty_mode not in MODES:
        raise ValueError(f"novelty_mode is one of {MODES}")
    flt = config.filter
    pool, chosen = bridges(corpus, topics, config)
    found = corpus.hold(candidates(corpus, pool, chosen, config))
    features = pool_features(corpus, flt, found.select("a").union(found.select("c")))
    size_row, size = corpus.size_column()
    rows = found.join(_packed(features, "cc", "c"), "c").join(_packed(features, "ac", "a"), "a")
    rows = rows.where(flt.usable("cc", "ac", config.min_level))
    order = Window.partitionBy("a").orderBy(F.desc("support"), rounded("path").desc(), "c")
    most = config.n_candidates_checked
    if config.target_categories and types is not None:
        rows = typed(rows.withColumn("p_rank", F.row_number().over(order)), types, config).drop("p_rank")
    rows = rows.withColumn("p_rank", F.row_number().over(order)).where(F.col("p_rank") <= most)
    # small from here on: at most n_candidates_checked rows a topic
    n_candidates = found.groupBy("a").agg(F.count(F.lit(1)).alias("n_candidates"))  # before the filter
    rows = rows.join(n_candidates, "a")
    short = rows.withColumn("path_norm", N.normalized(F.col("path"), "a"))
    counts = chosen.groupBy("a").agg(F.count(F.lit(1)).alias("n_bridges"))
    short = short.join(counts, "a")
    if size_row is not None:
        short = short.crossJoin(F.broadcast(size_row))  # one row
    short = cooccurrence(corpus.graph(), short.withColumnRenamed("a", "src").withColumnRenamed("c", "dst")).withColumnsRenamed({"src": "a", "dst": "c", "cooc": "direct"})
    short = short.withColumn("expected_lift", N.lift(F.col("direct"), F.col("ac.works_count"), F.col("cc.works_count"), size))
    struct = (0.6 * F.col("path_norm") + 0.4 * F.col("support") / F.greatest("n_bridges", F.lit(1))) * N.specificity(F.col("cc.works_count"))
    short = checked = corpus.hold(with_diversity(short, flt.embeddings))
    if config.novelty_scorer is not None:
        short = short.withColumn("novelty", config.novelty_scorer(short)).withColumn("comention_count", F.lit(0).cast("long"))
        signals = F.create_map(F.lit("own"), F.col("novelty"), F.lit("diversity"), F.col("diversity"))
    elif config.novelty_mode == "concept_lift":
        short = short.where(F.col("expected_lift") <= config.max_lift).withColumn("novelty", 1 / (1 + F.col("expected_lift"))).withColumn("comention_count", F.lit(0).cast("long"))
        signals = F.create_map(F.lit("lift"), F.col("novelty"), F.lit("diversity"), F.col("diversity"))
    else:
        lift = N.lift_novelty(F.col("direct"), F.col("ac.works_count"), F.col("cc.works_count"), size, config.max_lift)
        short = short.withColumn("_lift", lift)
        if corpus.comentions is not None:
            hits = corpus.comentions.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("hits").cast("long").alias("_hits"))
            short = short.join(hits, ["a", "c"], "left").withColumn("comention_count", F.coalesce("_hits", F.lit(0)))
            weights = dict(config.novelty_weights) if config.novelty_mode == "hybrid" else {}
            parts = [(F.col("_lift"), F.lit(float(weights.get("lift", 1.0)))), (F.col("_com"), F.lit(float(weights.get("comention", 1.0))))]
            short = short.withColumn("_com", N.comention_novelty(F.col("comention_count"), config.comention_novelty_scale)).withColumn("novelty", N.blended(parts))
            signals = F.create_map(F.lit("lift"), F.col("_lift"), F.lit("comention"), F.col("_com"), F.lit("diversity"), F.col("diversity"))
        else:
            short = short.withColumn("comention_count", F.lit(0).cast("long")).withColumn("novelty", F.col("_lift"))
            signals = F.create_map(F.lit("lift"), F.col("_lift"), F.lit("diversity"), F.col("diversity"))
    score = struct * F.col("novelty")
    if config.apply_diversity:
        score = score * (1 + config.bridge_diversity_weight * F.greatest(F.lit(0.0), F.col("diversity") - 0.4))
    short = short.withColumn("signals", signals).withColumn("score", score)
    if config.min_bridge_support > 1:
        short = short.where(F.col("support") >= config.min_bridge_support)
    w = Window.partitionBy("a").orderBy(rounded("score").desc(), "c")
    out = short.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= config.max_results)
    links = out.select(
        "a", F.col("ac.name").alias("a_name"), "c", F.col("cc.name").alias("c_name"), F.col("cc.level").alias("c_level"), "rank", F.transform("found", lambda x: x["name"]).alias("bridges"),
        F.transform("found", lambda x: x["id"]).alias("bridge_ids"), F.col("support").alias("bridge_support"), F.col("path").alias("path_strength"), "direct", "expected_lift", "novelty", "comention_count",
        "diversity", "signals", "score", "n_bridges", "n_candidates",
    )
    return Stages(chosen, found, checked, links)


def explain(corpus: Corpus, pairs: DataFrame, config: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """The bridges that a and c share. pairs: (a, c). Returns a row for each: a, c, b, b_name, b_rank, strength, total (sum over the chosen bridges),
    direct, novelty, n_bridges. Only the name tests and the level hold here, and words shared with a."""
    flt = config.filter
    pairs = corpus.hold(pairs.select("a", "c").distinct())
    ends = pairs.select(F.col("a").alias("src")).union(pairs.select(F.col("c").alias("src")))
    near = corpus.hold(corpus.neighbours_of(ends, config.bridge_pool).select("src", "dst", "norm"))
    one = near.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("norm").alias("an"))
    two = near.select(F.col("src").alias("c"), F.col("dst").alias("b"), F.col("norm").alias("cn"))
    both = corpus.hold(pairs.join(one, "a").join(two, ["c", "b"]).where("b <> a and b <> c"))
    features = pool_features(corpus, flt, both.select("a").union(both.select("b")))
    rows = both.join(_packed(features, "bc", "b"), "b").join(_packed(features, "ac", "a"), "a")
    ok = (F.coalesce(F.col("bc.level"), F.lit(0)) >= config.min_level) & ~F.col("bc.generic") & ~F.col("bc.bad") & ~flt.shares_words("bc", "ac")
    rows = rows.where(ok).withColumn("strength", N.leg(F.col("an"), F.col("cn")))
    w = Window.partitionBy("a", "c").orderBy(rounded("strength").desc(), "b")
    top = rows.withColumn("b_rank", F.row_number().over(w)).where(F.col("b_rank") <= config.n_bridges)
    pair = Window.partitionBy("a", "c")
    top = top.withColumn("total", F.sum("strength").over(pair)).withColumn("n_bridges", F.count(F.lit(1)).over(pair))
    top = cooccurrence(corpus.graph(), top.withColumnsRenamed({"a": "src", "c": "dst"})).withColumnsRenamed({"src": "a", "dst": "c", "cooc": "direct"})
    return top.select("a", "c", "b", F.col("bc.name").alias("b_name"), "b_rank", "strength", "total", "direct", (1 / (1 + F.col("direct"))).alias("novelty"), "n_bridges")


def stats(topics: DataFrame, run: Stages) -> DataFrame:
    """One row a topic, whether or not it has links: a, bridges, candidates, checked (before the novelty gate), results."""
    out = topics.select("a").distinct()
    for name, frame in (("bridges", run.chosen), ("candidates", run.found), ("checked", run.checked), ("results", run.links)):
        out = out.join(frame.groupBy("a").agg(F.count(F.lit(1)).alias(name)), "a", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
