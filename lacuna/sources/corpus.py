"""The corpus: works, the concepts they mention, and the weighted graph of concepts that occur together."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import constants as K
from lacuna.functions import text as T
from lacuna.session import forget, stored


@dataclass(frozen=True)
class Corpus:
    """concepts (cid, name, level, works_count); edges (src, dst, cooc), each direction a row; and where they are
    known: work_concepts (work, cid, year), works (work, title, text, year, cited, url), comentions (src, dst, hits),
    a count independent of the edges. size: number of works."""

    concepts: DataFrame
    edges: DataFrame
    size: DataFrame | int
    work_concepts: DataFrame | None = None
    works: DataFrame | None = None
    comentions: DataFrame | None = None
    #: The tables that plans over this corpus have written; and, of a kept one, the ranked neighbours of every concept.
    held: list = field(default_factory=list, compare=False)
    near: dict | None = field(default=None, compare=False)
    near_limit: int | None = None
    #: To how many tasks works are dealt out; None: the session's number.
    tasks: int | None = None

    @classmethod
    def from_work_concepts(
        cls, work_concepts: DataFrame, names: DataFrame | None = None, works: DataFrame | None = None, comentions: DataFrame | None = None,
        *, year_from: int | None = None, year_to: int | None = None, as_of_metadata: bool = False, tasks: int | None = None,
    ) -> "Corpus":
        """Edges from (work, cid[, year]), of works in [year_from, year_to]. names: (cid, name, level). The counts of
        works and the corpus size are those of all years, unless as_of_metadata is set. tasks: to how many the works are dealt out; the session's number, if
        not given (``session.tasks`` has one that grows with the rows)."""
        within = in_years(work_concepts, year_from, year_to)
        meta = within if as_of_metadata else work_concepts
        counts = by_work(meta, tasks).groupBy("cid").agg(F.count("work").alias("works_count"))
        names = names if names is not None else counts.select("cid", F.col("cid").cast("string").alias("name"), F.lit(0).alias("level"))
        concepts = names.join(counts, "cid", "left").withColumn("works_count", F.coalesce("works_count", F.lit(0)))
        size = dealt(meta.select("work").where("work is not null"), tasks).distinct().agg(F.count(F.lit(1)).alias("size"))
        return cls(concepts, cooccurrence_edges(within, tasks=tasks), size, within, works, comentions, tasks=tasks)

    def kept(self, pool: int | None = None) -> "Corpus":
        """The same, where what plans read several times is written once to the shared folder, when it is first read: the concepts, the size, a count of
        its own and, by ``graph``, the edges. With ``pool`` that many of the strongest neighbours of every concept are ranked once, too.
        Nothing depends on an executor's memory; ``release`` deletes the tables."""
        return _Kept(**{f.name: object.__getattribute__(self, f.name) for f in fields(self)} | {"near": {}, "near_limit": pool})

    def graph(self) -> DataFrame:
        """The edges for more than one use: of a kept corpus written once. ``edges`` themselves are planned at each use."""
        if self.near is None:
            return self.edges
        if "edges" not in self.near:
            self.near["edges"] = self.hold(self.edges, "edges")
        return self.near["edges"]

    def hold(self, frame: DataFrame, name: str = "part") -> DataFrame:
        """The frame, written to the shared folder and read back: for what one plan reads several times. Without this, each use would
        be planned and run anew, and uses of uses multiply."""
        out, path = stored(frame, name)
        self.held.append((frame.sparkSession, path))
        return out

    def release(self) -> None:
        """Deletes what has been written for this corpus."""
        while self.held:
            forget(*self.held.pop())

    def __enter__(self) -> "Corpus":
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def neighbours_of(self, wanted: DataFrame, limit: int) -> DataFrame:
        """src, dst, cooc, n_rank, norm: the strongest ``limit`` neighbours of the concepts in ``wanted`` (src)."""
        wanted = wanted.select("src").distinct()
        if self.near is not None and self.near_limit == limit:
            if limit not in self.near:
                self.near[limit] = self.hold(ranked(self.graph(), limit), "near")
            return self.near[limit].join(wanted, "src", "left_semi")
        return ranked(self.graph().join(wanted, "src", "left_semi"), limit)

    def size_column(self) -> tuple[DataFrame | None, F.Column]:
        """A one-row frame to cross join, or none, and the column of the size."""
        if isinstance(self.size, int):
            return None, F.lit(self.size)
        return self.size, F.col("size")


class _Kept(Corpus):
    """A corpus whose tables are written when they are first asked for."""

    def __getattribute__(self, name: str):
        value = super().__getattribute__(name)
        if name not in ("concepts", "comentions", "size") or not isinstance(value, DataFrame):
            return value
        known = super().__getattribute__("near")
        if name not in known:
            known[name] = value.first()[0] if name == "size" else self.hold(value, name)
        return known[name]


def in_years(frame: DataFrame, year_from: int | None, year_to: int | None) -> DataFrame:
    """Whole years, both ends included; an open end has no bound."""
    if year_from is not None:
        frame = frame.where(F.col("year") >= year_from)
    if year_to is not None:
        frame = frame.where(F.col("year") <= year_to)
    return frame


def dealt(frame: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows dealt out by work, once for all that is then grouped or joined by it: to so many tasks, or the session's number."""
    return frame.repartition(tasks, "work") if tasks else frame.repartition("work")


def by_work(work_concepts: DataFrame, tasks: int | None = None) -> DataFrame:
    """(work, cid), distinct, a work's in one task."""
    return dealt(work_concepts.select("work", "cid"), tasks).distinct()


#: Concepts of a work that one task pairs with each other.
BLOCK = 512


def concept_pairs(wc: DataFrame, block: int = BLOCK, keep: bool = False) -> DataFrame:
    """(src, dst), src < dst: every pair of a work's concepts, a row a work; with ``keep`` its work, too. wc: distinct (work, cid); where it has a year, one a
    row, so have the pairs: the later one of the two.

    Works are paired where ``by_work`` has dealt them out, else they are dealt out here. A work with more than ``block`` concepts has them dealt out to blocks of about so many, and each
    pair of blocks, half of the square, is a key of its own: a work of d concepts goes to (d / block)^2 / 2 keys of block^2 pairs at most, whichever
    tasks they fall to, and each of its rows is sent d / block + 1 times."""
    sized = wc.withColumn("k", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("work")) / block))
    dated = "year" in wc.columns
    year = lambda name: [F.col("year").alias(name)] if dated else []
    least, most = F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")
    ends = [*([F.col("work")] if keep else []), least, most, *([F.greatest("u", "v").alias("year")] if dated else [])]
    side = lambda cid, at: sized.where("k <= 1").select("work", F.col("cid").alias(cid), *year(at))
    most_works = side("x", "u").join(side("y", "v"), "work").where("x < y").select(*ends)
    rows = sized.where("k > 1").withColumn("at", F.pmod(F.xxhash64("cid"), F.col("k")))
    left = rows.select("work", F.col("cid").alias("x"), *year("u"), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("k") - 1)).alias("j"))
    right = rows.select("work", F.col("cid").alias("y"), *year("v"), F.explode(F.sequence(F.lit(0).cast("long"), "at")).alias("i"), F.col("at").alias("j"))
    return most_works.unionByName(left.join(right, ["work", "i", "j"]).where("i < j or x < y").select(*ends))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Each row of (src, dst, ...) and the same with the ends exchanged."""
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    turned = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return pairs.select(turned, *rest).select("e.src", "e.dst", *rest)


def cooccurrence_edges(work_concepts: DataFrame, include_self: bool = False, block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """(src, dst, cooc): number of works that have both. A work's concepts count once; both directions are rows.

    Pairs are made once per work as src < dst, counted with partial aggregation, and only then mirrored, a row into two, so that
    nothing is planned twice."""
    wc = by_work(work_concepts.where("work is not null and cid is not null"), tasks)
    both = mirrored(concept_pairs(wc, block).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cooc")))
    if include_self:
        both = both.unionByName(wc.groupBy(F.col("cid").alias("src"), F.col("cid").alias("dst")).agg(F.count(F.lit(1)).alias("cooc")))
    return both


def anchored_edges(work_concepts: DataFrame, anchors: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges of a few concepts only (anchors: cid), without building the graph: the works that have an anchor, then
    what else those have."""
    wc = by_work(work_concepts, tasks)
    of = dealt(work_concepts.select("work", "cid").join(anchors.select("cid").distinct(), "cid"), tasks).distinct().withColumnRenamed("cid", "src")
    return of.join(wc.withColumnRenamed("cid", "dst"), "work").where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cooc"))


def neighbours(edges: DataFrame, limit: int) -> DataFrame:
    """The strongest ``limit`` edges of each src; ties by dst. Adds n_rank."""
    w = Window.partitionBy("src").orderBy(F.desc("cooc"), "dst")
    return edges.withColumn("n_rank", F.row_number().over(w)).where(F.col("n_rank") <= limit)


def ranked(edges: DataFrame, limit: int) -> DataFrame:
    """``neighbours`` with norm, the count over the largest of its src."""
    near = neighbours(edges, limit)
    top = F.max(F.col("cooc").cast("double")).over(Window.partitionBy("src"))
    return near.withColumn("norm", F.when(top > 0, F.col("cooc").cast("double") / top).otherwise(F.lit(0.0)))


def group_neighbours(edges: DataFrame, concepts: DataFrame, limit: int) -> DataFrame:
    """Like neighbours, then without unnamed concepts and broad fields: these take up places but don't appear."""
    named = neighbours(edges, limit).join(concepts.select(F.col("cid").alias("dst"), F.col("name")), "dst")
    return named.where((F.trim(F.coalesce("name", F.lit(""))) != "") & ~F.lower(F.trim("name")).isin(*K.ROOT_FIELDS))


def cooccurrence(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) with cooc, 0 where there is no edge."""
    return pairs.join(edges, ["src", "dst"], "left").withColumn("cooc", F.coalesce("cooc", F.lit(0)).cast("long"))


def with_meta(frame: DataFrame, meta: DataFrame, key: str = "cid") -> DataFrame:
    """level and works_count of ``meta`` where it has the concept and either is unknown (0) in the frame."""
    m = meta.select(F.col("cid").alias(key), F.col("level").alias("m_level"), F.col("works_count").alias("m_works"))
    unknown = (F.coalesce("level", F.lit(0)) == 0) | (F.coalesce("works_count", F.lit(0)) == 0)
    out = frame.join(m, key, "left")
    better = lambda m, c: F.when(unknown, F.coalesce(m, c)).otherwise(F.col(c))
    out = out.withColumns({"level": better("m_level", "level"), "works_count": better("m_works", "works_count")})
    return out.drop("m_level", "m_works")


#: Sets, or their concepts, up to which they go to every task.
MOST_SETS = 100_000


def works_with_all(work_concepts: DataFrame, sets: DataFrame, works: DataFrame | None = None, limit: int = 2, tasks: int | None = None, most: int = MOST_SETS) -> DataFrame:
    """Relational division: for each set (set_id, cids array) the works that have all its concepts, the most cited
    first, ties by work. Returns set_id, work, w_rank and, with ``works``, title, year, cited, url. Running jobs, it counts and writes the sets.

    A set is met by its two rarest concepts: each work is read once, for the pairs of those of its concepts that are asked for, whatever the number of sets;
    works found are looked up by (work, concept) for the rest of a set. Up to ``most`` sets are sent to every task, more are joined by equality."""
    asked = sets.select("set_id", F.array_distinct("cids").alias("cids")).where(F.size("cids") > 0)
    counts = work_concepts.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))  # only the order of a set's concepts depends on it
    placed = asked.select("set_id", F.explode("cids").alias("cid")).join(counts, "cid", "left")
    led = placed.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "cid"))).alias("m")).select("set_id", F.transform("m", lambda x: x["cid"]).alias("m"))
    low, high = F.array_min(F.slice("m", 1, 2)), F.array_max(F.slice("m", 1, 2))
    led, _ = stored(led.select("set_id", F.size("m").alias("of"), low.alias("src"), high.alias("dst"), F.slice("m", F.lit(3), F.greatest(F.size("m") - 2, F.lit(0))).alias("rest"), "m"), "sets")
    n_sets, n_one, n_more, longest = led.agg(F.count(F.lit(1)), F.count_if(F.col("of") == 1), F.count_if(F.col("of") > 2), F.sum("of")).first()
    sent = F.broadcast if n_sets <= most and (longest or 0) <= most else lambda f: f
    wanted = led.select(F.explode("m").alias("cid")).distinct()
    wc = by_work(work_concepts.where("work is not null").join(sent(wanted), "cid", "left_semi"), tasks)
    have = concept_pairs(wc, keep=True).join(sent(led.where("of > 1").select("set_id", "src", "dst", "rest")), ["src", "dst"]).select("set_id", "work", "rest")
    if n_more:
        each = have.where(F.size("rest") > 0).select("set_id", "work", F.size("rest").alias("k"), F.explode("rest").alias("cid"))
        rest = each.join(wc, ["work", "cid"]).groupBy("set_id", "work", "k").agg(F.count(F.lit(1)).alias("n")).where("n = k").select("set_id", "work")
        have = have.where(F.size("rest") == 0).select("set_id", "work").unionByName(rest)
    else:
        have = have.select("set_id", "work")
    if n_one:
        have = have.unionByName(wc.join(sent(led.where("of = 1").select("set_id", F.col("src").alias("cid"))), "cid").select("set_id", "work"))
    cited = F.lit(0)
    if works is not None:
        have = dealt(have, tasks).join(dealt(works, tasks), "work", "left").withColumn("title", F.coalesce("title", F.lit("(untitled)")))
        cited = F.coalesce("cited", F.lit(0))
    w = Window.partitionBy("set_id").orderBy(cited.desc(), "work")
    return have.withColumn("w_rank", F.row_number().over(w)).where(F.col("w_rank") <= limit)


#: Terms, and their characters, up to which an automaton of all of them goes to every task.
MOST_TERMS, MOST_CHARS = 100_000, 4_000_000


def mentioned(works: DataFrame, terms: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """works (work, _t), terms (term) -> work, term: the works whose text holds a term as whole words, without case.

    Each text is read once, by an automaton of the terms, whose size is counted before it is sent; where there are more than ``most``, texts are cut into
    runs of as many words as a term has, and runs and terms are joined by equality. No term is held against every text either way. Terms
    without a letter or digit are in no text."""
    asked = terms.select("term", T.words_of(F.col("term")).alias("k")).distinct()
    asked = asked.select("term", F.size("k").alias("n"), F.array_join("k", " ").alias("run")).where("n > 0")
    count, chars, longest = asked.agg(F.count(F.lit(1)), F.sum(F.length("run")), F.max("n")).first()
    if count <= most and (chars or 0) <= MOST_CHARS:
        runs = [r.run for r in asked.select("run").distinct().collect()]
        padded = works.select("work", F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce("_t", F.lit(""))), "[^a-z0-9]+", " "), F.lit(" ")).alias("t"))
        kind = works.schema["work"].dataType.simpleString()
        found = padded.mapInArrow(finder(runs), f"work {kind}, run string")
        return found.join(F.broadcast(asked), "run").select("work", "term")
    words = works.select("work", T.words_of(F.col("_t")).alias("w"))
    at = F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))
    runs = F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice("w", i, n), " "))))
    found = words.select("work", F.explode(F.array_distinct(F.flatten(runs))).alias("run")).where("run <> ''")
    return found.join(asked, "run").select("work", "term").distinct()


def finder(runs: list[str]):
    """For mapInArrow over (key, text of words between single spaces): key, run of every run that the text holds."""

    def find(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for i, run in enumerate(runs):
            automaton.add_word(f" {run} ", i)
        if not runs:
            return
        automaton.make_automaton()
        for b in batches:
            rows, found = [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                hits = {i for _, i in automaton.iter(text)}
                rows += [row] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([runs[i] for i in found], pa.string())], ["work", "run"])

    return find


def text_comentions(works: DataFrame, pairs: DataFrame, limit: int = 4) -> DataFrame:
    """Works whose title or text mentions both terms. pairs: (pair_id, a_name, c_name). Returns pair_id, hits and the ``limit`` most
    cited works as items. The texts are read once, whatever the number of pairs: the mentions found are written and read back."""
    asked = pairs.select("pair_id", T.clean_term(F.col("a_name")).alias("a_term"), T.clean_term(F.col("c_name")).alias("c_term"))
    terms = asked.select(F.col("a_term").alias("term")).union(asked.select("c_term"))
    found, _ = stored(mentioned(works.select("work", F.concat_ws(" ", "title", "text").alias("_t")), terms), "mentions")
    one = asked.join(found.withColumnRenamed("term", "a_term"), "a_term").select("pair_id", "c_term", "work")
    both = one.join(found.withColumnRenamed("term", "c_term"), ["c_term", "work"]).select("pair_id", "work")
    cited = both.join(works.select("work", "title", "year", "cited"), "work")
    w = Window.partitionBy("pair_id").orderBy(F.coalesce("cited", F.lit(0)).desc(), "work")
    item = F.when(F.col("r") <= limit, F.struct("r", "work", "title", "year"))
    told = cited.withColumn("r", F.row_number().over(w)).groupBy("pair_id").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(item)).alias("items"))
    return pairs.join(told, "pair_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))


def within(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """needles (q), haystacks (n) -> q, n: each needle with every haystack that holds it.

    Haystacks are posted under their strings of one to three characters. A needle is looked up under the one of its strings of three
    (itself, where it is shorter) that fewest haystacks have; one of which a string is in none is held by none. So needles that begin alike don't
    meet on one frequent string."""
    at = F.sequence(F.lit(1), F.greatest(F.length("n"), F.lit(1)))
    parts = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda m: F.substring("n", i, m))))
    posted = haystacks.select("n").distinct().select("n", F.explode(F.array_distinct(parts)).alias("k"))
    size = F.length("q")
    threes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substring("q", i, F.lit(3))))
    keyed = needles.select("q").where("q <> ''").distinct().withColumn("ks", threes).select("q", F.size("ks").alias("of"), F.explode("ks").alias("k"))
    counts = posted.join(keyed.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    rarest = keyed.join(counts, "k").groupBy("q", "of").agg(F.min(F.struct("c", "k")).alias("low"), F.count(F.lit(1)).alias("met")).where("met = of")
    return rarest.select("q", F.col("low.k").alias("k")).join(posted, "k").where(F.contains("n", "q")).select("q", "n")


def resolve(topics: DataFrame, concepts: DataFrame) -> DataFrame:
    """topics (topic) -> topic, cid: an exact name first, then one that holds the topic or is held by it; ties by works_count desc, then
    cid. An empty topic has no concept. Names are compared in lower case, trimmed."""
    t = topics.select("topic", F.lower(F.trim("topic")).alias("q")).where("q <> ''").distinct()
    c = concepts.select("cid", F.lower("name").alias("n"), F.coalesce("works_count", F.lit(0)).alias("works"))
    names, asked = c.select("n").where("n <> ''"), t.select("q")
    over = within(names.withColumnRenamed("n", "q"), asked.withColumnRenamed("q", "n")).select(F.col("n").alias("q"), F.col("q").alias("n"))
    pairs = within(asked, names).union(over).distinct()
    hit = c.join(pairs, "n").join(t, "q")
    w = Window.partitionBy("topic").orderBy((F.col("n") == F.col("q")).desc(), F.desc("works"), "cid")
    return hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("topic", "cid")


def comentions_by_name(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """pairs (a_name, c_name, ...) with a, c (null where a name has no concept) and hits, the works that have both: 0 where one is unknown or there
    are none. Names are resolved as topics are; a name that is asked for often is resolved once."""
    names = pairs.select(F.col("a_name").alias("topic")).union(pairs.select("c_name")).where("topic is not null").distinct()
    known = resolve(names, corpus.concepts)
    named = lambda name, cid: known.select(F.col("topic").alias(name), F.col("cid").alias(cid))
    both = pairs.join(named("a_name", "a"), "a_name", "left").join(named("c_name", "c"), "c_name", "left")
    edges = corpus.graph().select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("cooc").cast("long").alias("hits"))
    return both.join(edges, ["a", "c"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))).select(*pairs.columns, "a", "c", "hits")


def stand_in_works(sets: DataFrame, concepts: DataFrame, year: int = 2011) -> DataFrame:
    """For a graph that has no works: one for each set (set_id, cids array), in the columns of ``works_with_all``: its title names the
    concepts in the order of the set, the id stands for a name that isn't known; cited 0, no url."""
    each = sets.select("set_id", F.posexplode("cids").alias("p", "cid")).join(concepts.select("cid", "name"), "cid", "left")
    told = each.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("name", "cid").alias("n")))).alias("ns"))
    title = T.joined(F.transform("ns", lambda x: x["n"]))
    return told.select("set_id", F.concat(F.lit("stand-in:"), F.col("set_id").cast("string")).alias("work"), title.alias("title"), F.lit(year).alias("year"), F.lit(0).cast("long").alias("cited"), F.lit(None).cast("string").alias("url"), F.lit(1).alias("w_rank"))


def resolve_by_tokens(topics: DataFrame, concepts: DataFrame, min_level: int = 2) -> DataFrame:
    """topics (topic) -> topic, cid by shared words, then level, then works_count, then cid; broad fields and low levels are no topics.
    Words are joined on, so no topic meets every concept."""
    from lacuna.operators.filters import generic_source

    words = lambda c: F.array_except(T.tokens(c), T.strings(K.TOPIC_STOP))
    t = topics.select("topic", F.explode(words(F.col("topic"))).alias("word")).distinct()
    ok = concepts.where(~generic_source(F.col("name"), F.col("level"), min_level))
    c = ok.select("cid", "level", F.coalesce("works_count", F.lit(0)).alias("works"), F.explode(words(F.col("name"))).alias("word")).distinct()
    hit = c.join(t, "word").groupBy("topic", "cid", "level", "works").agg(F.count(F.lit(1)).alias("overlap"))
    w = Window.partitionBy("topic").orderBy(F.desc("overlap"), F.desc("level"), F.desc("works"), "cid")
    return hit.withColumn("r", F.row_number().over(w)).where("r = 1").select("topic", "cid", "overlap")


def resolve_from_works(topics: DataFrame, works: DataFrame, work_concepts: DataFrame, concepts: DataFrame, min_level: int = 2) -> DataFrame:
    """Fallback: among the concepts of works that mention the topic, the one that shares most words with it, then the most frequent."""
    from lacuna.operators.filters import generic_source

    words = lambda c: F.array_except(T.tokens(c), T.strings(K.TOPIC_STOP))
    t = topics.select(F.col("topic").alias("term")).distinct()
    found = mentioned(works.select("work", F.concat_ws(" ", "title", "text").alias("_t")), t).withColumnRenamed("term", "topic")
    groups = found.join(work_concepts.select("work", "cid").distinct(), "work").groupBy("topic", "cid").agg(F.count(F.lit(1)).alias("n"))
    named = groups.join(concepts, "cid").where(~F.lower(F.trim("name")).isin(*K.ROOT_FIELDS) & (F.trim("name") != ""))
    scored = named.withColumn("overlap", F.size(F.array_intersect(words(F.col("topic")), words(F.col("name"))))).where((F.col("overlap") > 0) | (F.size(words(F.col("topic"))) == 0))
    w = Window.partitionBy("topic").orderBy(F.desc("overlap"), F.desc("n"), "cid")
    best = scored.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.where(~generic_source(F.col("name"), F.col("level"), min_level)).select("topic", "cid", "overlap")


def fixture(spark: SparkSession, path: str) -> Corpus:
    """A graph from one JSON object: concepts {id: {id, name, level, works_count}} and edges {"a|b": count}, undirected."""
    raw = spark.read.text(path, wholetext=True)
    node = "map<string,struct<id:string,name:string,level:int,works_count:bigint>>"
    g = raw.select(F.from_json("value", f"concepts {node}, edges map<string,bigint>").alias("g"))
    concepts = g.select(F.explode("g.concepts").alias("cid", "c")).select("cid", "c.name", "c.level", "c.works_count")
    half = g.select(F.explode("g.edges").alias("k", "cooc")).select(F.split_part("k", F.lit("|"), F.lit(1)).alias("src"), F.split_part("k", F.lit("|"), F.lit(2)).alias("dst"), "cooc")
    edges = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cooc"))
    return Corpus(concepts, edges, 250_000_000, comentions=edges.withColumnRenamed("cooc", "hits"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
