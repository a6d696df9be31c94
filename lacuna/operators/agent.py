"""Whole runs: discover or explain, with hypotheses, citations and verification; and the extension points."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import evidence
from lacuna.operators.discovery import DiscoveryConfig, discover, explain
from lacuna.sources.corpus import Corpus

#: pairs (a, c, a_name, c_name) -> (a, c, hits[, items])
EvidenceProvider = Callable[[DataFrame], DataFrame]
#: hypotheses -> hypotheses, with texts of its own
Reasoner = Callable[[DataFrame], DataFrame]


def counted(corpus: Corpus) -> EvidenceProvider:
    """The local provider: the corpus's independent count, or its edges where it has none."""
    source = corpus.comentions if corpus.comentions is not None else corpus.graph().withColumnRenamed("cooc", "hits")
    return lambda pairs: pairs.join(source.select(F.col("src").alias("a"), F.col("dst").alias("c"), "hits"), ["a", "c"]).select("a", "c", "hits")


def _finished(corpus: Corpus, links: DataFrame, cite: bool, verify: bool, provider: EvidenceProvider | None, reasoner: Reasoner | None) -> DataFrame:
    if cite and corpus.work_concepts is not None:
        links = evidence.with_citations(links, corpus.work_concepts, corpus.works, corpus.tasks)
    hyps = (reasoner or evidence.hypotheses)(links)
    if not verify:
        return hyps
    counts = (provider or counted(corpus))(links.select("a", "c", "a_name", "c_name"))
    return evidence.reranked(evidence.verify(hyps, counts))


def run_discover(
    corpus: Corpus, topics: DataFrame, config: DiscoveryConfig = DiscoveryConfig(), types: DataFrame | None = None,
    verify: bool = False, provider: EvidenceProvider | None = None, reasoner: Reasoner | None = None, cite: bool = True,
) -> DataFrame:
    """Links with hypotheses; with the works that are cited for them, where the corpus knows its works; verified and ranked anew if asked."""
    links = corpus.hold(discover(corpus, topics, config, types), "links")
    return _finished(corpus, links, cite, verify, provider, reasoner)


def run_explain(
    corpus: Corpus, pairs: DataFrame, config: DiscoveryConfig = DiscoveryConfig(),
    verify: bool = False, provider: EvidenceProvider | None = None, reasoner: Reasoner | None = None, cite: bool = True,
) -> DataFrame:
    """A link for each pair of concepts, in the columns of ``discover``, with its hypothesis, cited works and verdict as in ``run_discover``."""
    rows = corpus.hold(explain(corpus, pairs, config), "explained")
    each = lambda x, name: F.transform(F.array_sort(F.collect_list(F.struct("b_rank", F.col(x).alias("x")))), lambda y: y["x"]).alias(name)
    keys = ["a", "c", "total", "direct", "novelty", "n_bridges"]
    links = rows.groupBy(*keys).agg(each("b_name", "bridges"), each("b", "bridge_ids"))  # n_bridges rows a pair at most
    name = lambda key, to: corpus.concepts.select(F.col("cid").alias(key), F.col("name").alias(to))
    links = links.join(name("a", "a_name"), "a").join(name("c", "c_name"), "c").withColumn("rank", F.lit(1)).withColumn("comention_count", F.lit(0).cast("long"))
    return _finished(corpus, links.withColumn("bridge_support", F.col("n_bridges")).withColumn("score", F.col("total")), cite, verify, provider, reasoner)


#: Providers of language models and the variables that hold their keys, the first that is set wins.
MODEL_KEYS = ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "FIREWORKS_API_KEY", "OPENROUTER_API_KEY", "GROQ_API_KEY", "GEMINI_API_KEY")


def detect_model(env=os.environ) -> str | None:
    """The name of the first provider with a key. Nothing is sent anywhere: a reasoner is the caller's function."""
    return next((k.removesuffix("_API_KEY").lower() for k in MODEL_KEYS if env.get(k)), None)


def load_env(text: str, env: dict, override: bool = False) -> dict:
    """NAME=value lines into env: blank lines, comments and lines without "=" are skipped, "export " and quotes dropped; what is set stays, unless
    override is set."""
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if override or key not in env:
            env[key] = value
    return env
