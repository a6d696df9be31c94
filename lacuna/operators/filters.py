"""Relevance filters: which concepts may stand as bridges or targets. Features depend on the name alone and are
computed once a concept; pairs only compare them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import text as T
from lacuna.session import stored

_BIOMED = ("biomed", "bio", "medical", "default")
_GENERAL = ("general", "gen", "broad", "relaxed")


@dataclass(frozen=True)
class RelevanceFilter:
    """Word lists and thresholds. ``embeddings`` (name, vec) adds the semantic layer: its rows for the stop names are
    the seeds."""

    name_stop: tuple[str, ...] = K.NAME_STOP_BIOMED
    homonyms: tuple[str, ...] = K.HOMONYM_BIOMED
    generic_tokens: tuple[str, ...] = K.GENERIC_TOKENS_BIOMED
    min_level_floor: int = 0
    ngram_n: int = 3
    ngram_generic_threshold: float = 0.55
    ngram_similarity_threshold: float = 0.6
    generic_semantic_threshold: float = 0.78
    a_similarity_threshold: float = 0.82
    embeddings: DataFrame | None = None
    #: Whether features are worth writing down: they read names and vectors.
    costly = True

    @property
    def seeds(self) -> tuple[str, ...]:
        return tuple(sorted(s for s in self.name_stop if len(s) > 2))

    def is_generic(self, name: Column) -> Column:
        exact = F.lower(F.trim(name)).isin(*self.name_stop) if self.name_stop else F.lit(False)
        near = T.generic_score(T.char_ngrams(name, self.ngram_n), self.seeds, self.ngram_n) >= self.ngram_generic_threshold
        return exact | near | (F.size(T.distinctive_tokens(name, self.generic_tokens)) == 0)

    def bad_parenthetical(self, name: Column) -> Column:
        return T.parenthetical(name).isin(*self.homonyms) if self.homonyms else F.lit(False)

    def features(self, concepts: DataFrame) -> DataFrame:
        """concepts with grams, own, generic, bad and, with embeddings, vec."""
        out = concepts
        n = F.col("name")
        generic = self.is_generic(n)
        if self.embeddings is not None:
            vec = self.embeddings.select("name", "vec").dropDuplicates(["name"])
            seeds = vec.where(F.lower(F.trim("name")).isin(*self.seeds))  # no more rows than stop names
            top = vec.crossJoin(F.broadcast(seeds.select(F.col("vec").alias("seed")))).groupBy("name").agg(F.max(T.cosine(F.col("vec"), F.col("seed"))).alias("semantic"))
            out = out.join(vec, "name", "left").join(top, "name", "left")
            generic = generic | (F.coalesce("semantic", F.lit(0.0)) >= self.generic_semantic_threshold)
        out = out.withColumn("grams", T.char_ngrams(n, self.ngram_n)).withColumn("own", T.distinctive_tokens(n, self.generic_tokens))
        return out.withColumn("generic", generic).withColumn("bad", self.bad_parenthetical(n)).drop("semantic")

    def shares_words(self, c: str, a: str) -> Column:
        """Whether two concepts (struct columns) share a word that tells names apart; false if the filter has no word lists."""
        if not (self.name_stop or self.generic_tokens):
            return F.lit(False)
        words = lambda x: T.distinctive_tokens(F.col(x)["name"])
        return F.coalesce(F.arrays_overlap(words(c), words(a)), F.lit(False))

    def usable(self, c: str, a: str, min_level: int) -> Column:
        """For a frame with the features of a concept (struct column ``c``) and of the topic (``a``)."""
        return (F.col(c)["cid"] != F.col(a)["cid"]) & self.fits(c, a, min_level)

    def fits(self, c: str, a: str, min_level: int) -> Column:
        """``usable`` by names and level alone, whichever concepts have them."""
        x, y = F.col(c), F.col(a)
        ok = (F.coalesce(x["level"], F.lit(0)) >= max(min_level, self.min_level_floor)) & ~x["generic"] & ~x["bad"]
        ok = ok & (T.jaccard(x["grams"], y["grams"]) < self.ngram_similarity_threshold) & ~F.coalesce(F.arrays_overlap(x["own"], y["own"]), F.lit(False))
        if self.embeddings is not None:
            ok = ok & (F.coalesce(T.cosine(x["vec"], y["vec"]), F.lit(0.0)) < self.a_similarity_threshold)
        return ok


@dataclass(frozen=True)
class LevelFilter(RelevanceFilter):
    """Only the level counts; for corpora whose names are codes."""

    costly = False

    def features(self, concepts: DataFrame) -> DataFrame:
        empty = T.strings(())
        return concepts.withColumns({"grams": empty, "own": empty, "generic": F.lit(False), "bad": F.lit(False)})

    def shares_words(self, c: str, a: str) -> Column:
        return F.lit(False)

    def fits(self, c: str, a: str, min_level: int) -> Column:
        return F.coalesce(F.col(c)["level"], F.lit(0)) >= max(min_level, self.min_level_floor)


#: Ids of concepts alike that are collected as one row, and that are sent on as one.
MOST_IDS, SENT_IDS = 200_000, 400


def usable_pairs(flt: RelevanceFilter, topics: DataFrame, concepts: DataFrame, min_level: int, most: int = MOST_IDS, sent: int = SENT_IDS) -> DataFrame:
    """topics, concepts (cid long, name, level) -> topic, concept: each topic with every concept that is usable for it.

    What the filter looks at is name and level, so those that share both are one row with the array of their ids: features are computed and
    compared a row, and only the ids of rows that fit are unfolded. A row has ``sent`` ids at most, so no task holds a group."""
    cores = concepts.sparkSession.sparkContext.defaultParallelism

    def alike(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
        sizes = rows.groupBy("name", "level").count().agg(F.sum("count").alias("every"), F.max("count").alias("largest")).first()
        part = F.pmod(F.xxhash64("cid"), F.lit(-(-(sizes.largest or 0) // most) or 1))
        sets = rows.groupBy("name", "level", part.alias("part")).agg(F.collect_list("cid").alias("cid")).drop("part").repartition(cores)
        # written, as Spark would push a test of features down to every single row
        of, _ = stored(flt.features(sets), "alike")
        cut = F.transform(F.sequence(F.lit(1), F.size("cid"), F.lit(sent)), lambda i: F.slice("cid", i, F.lit(sent)))
        of = of.select("*", F.explode(cut).alias("ids")).drop("cid")
        return of.select(F.struct(*of.columns).alias(name)), sizes.every or 0

    (a, m), (c, n) = alike(topics, "a"), alike(concepts, "c")
    # by number, as rows of arrays look small and unfold to many: about 100 million pairs a task
    each = c.repartition(max(cores, min(4000, n * m // 100_000_000)))
    met = apart(against_all(a, each, flt.fits("c", "a", min_level)).select(F.col("a.ids").alias("a"), F.col("c.ids").alias("c")))
    first = apart(met.select(F.explode("a").alias("topic"), "c"))
    return first.select("topic", F.explode("c").alias("concept")).where("topic <> concept")


def apart(frame: DataFrame) -> DataFrame:
    """The same rows in the same partitions, as a step of its own. Joins and explodes that run as one step hold all that comes of one row at once; here
    that would be a row of ids with every topic, in place of one topic's."""
    return frame.coalesce(1 << 30)


def against_all(queries: DataFrame, rows: DataFrame, on: Column, block: int = 5000) -> DataFrame:
    """Every query row with every row that fits it: the queries go out in blocks of bounded size, one after another."""
    n = max(1, -(-queries.count() // block))
    if n == 1:
        return rows.join(F.broadcast(queries), on)
    part = F.pmod(F.xxhash64(*queries.columns), F.lit(n))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(queries.where(part == i)), on) for i in range(n)])


def make_filter(profile: str = "biomed", *, extra_name_stop=(), extra_homonyms=(), extra_generic_tokens=(), override_name_stop=None, override_homonyms=None, override_generic_tokens=None, **thresholds) -> RelevanceFilter:
    """A filter by profile. Extra terms are added, overrides replace a list (here they take effect); an unknown profile has
    empty lists, "none" tests the level alone."""
    key = profile.strip().lower()
    if key == "none":
        return LevelFilter(**thresholds)
    lists = (K.NAME_STOP_BIOMED, K.HOMONYM_BIOMED, K.GENERIC_TOKENS_BIOMED) if key in _BIOMED else (K.NAME_STOP_GENERAL, K.HOMONYM_GENERAL, K.GENERIC_TOKENS_GENERAL) if key in _GENERAL else ((), (), ())
    merged = []
    for base, extra, override in zip(lists, (extra_name_stop, extra_homonyms, extra_generic_tokens), (override_name_stop, override_homonyms, override_generic_tokens)):
        words = override if override is not None else (*base, *extra)
        merged.append(tuple(dict.fromkeys(w.strip().lower() for w in words)))
    return RelevanceFilter(*merged, **thresholds)


def generic_source(name: Column, level: Column, min_level: int = 2) -> Column:
    """Broad fields and concepts of a low level can't be topics."""
    return F.lower(F.trim(name)).isin(*K.ROOT_FIELDS) | (F.coalesce(level, F.lit(0)) < min_level)


def nonsense_target(name: Column, level: Column) -> Column:
    flt = RelevanceFilter()
    low = F.lower(F.trim(name))
    noise = low.isin(*K.NOISE_WORDS)
    for suffix in K.NOISE_SUFFIXES:
        noise = noise | F.contains(low, F.lit(suffix))
    return low.isin(*K.ROOT_FIELDS) | flt.is_generic(name) | flt.bad_parenthetical(name) | (F.coalesce(level, F.lit(3)) < 2) | noise
