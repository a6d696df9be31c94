"""Column functions over names, titles and abstracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import constants as K


def strings(values) -> Column:
    """An array literal of strings, also of none."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def char_ngrams(name: Column, n: int = 3) -> Column:
    """The set of n-grams of a name's letters and digits, lower case; the name itself where it is shorter; null counts as empty."""
    s = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")
    size = F.length(s)
    many = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(size == 0, strings(())).when(size < n, F.array(s)).otherwise(F.array_distinct(many))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def plain_ngrams(name: str, n: int = 3) -> list[str]:
    """``char_ngrams`` of a fixed name, sorted."""
    s = "".join(c for c in name.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    return sorted({s[i : i + n] for i in range(max(1, len(s) - n + 1))}) if s else []


def generic_score(grams: Column, seeds, n: int = 3) -> Column:
    """The largest Jaccard of a name's n-grams to those of the seed names, which are literals; 0 without seeds."""
    each = [g for g in (plain_ngrams(s, n) for s in seeds) if g]
    if not each:
        return F.lit(0.0)

    def score(own: Column, g: list[str]) -> Column:
        shared = F.size(F.array_intersect(own, strings(g)))
        return shared / (F.size(own) + len(g) - shared)

    # the lambda binds the name's n-grams, so that they are made once and not for every seed
    return F.get(F.transform(F.array(grams), lambda own: F.greatest(*(score(own, g) for g in each), F.lit(0.0))), F.lit(0))


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def distinctive_tokens(name: Column, generic=K.GENERIC_TOKENS_BIOMED) -> Column:
    return F.array_except(tokens(name), strings(generic))


def parenthetical(name: Column) -> Column:
    """The first text in parentheses, lower case; empty if there is none."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(name, F.lit("")), r"\(([^)]+)\)", 1)))


def year_from(value: Column) -> Column:
    """The first four digits that begin with 19 or 20."""
    return F.nullif(F.regexp_extract(value, "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def clean_term(term: Column) -> Column:
    """Commas and colons as spaces, trimmed."""
    return F.trim(F.regexp_replace(term, "[,:]", " "))


def words_of(text: Column) -> Column:
    """A text's runs of ASCII letters and digits in order, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def short_id(link: Column) -> Column:
    """The last part of a link, trimmed; an id that is none stays as it is."""
    return F.trim(F.element_at(F.split(F.regexp_replace(F.trim(link), "/+$", ""), "/"), -1))


def joined(items: Column, none: str = "an intermediate") -> Column:
    """'a', 'a and b', 'a, b and c'."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n <= 0, F.lit(none)).when(n == 1, F.get(items, F.lit(0))).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def rebuilt_abstract(index: Column, limit: int = 240) -> Column:
    """The text of an inverted index, map<word, array<position>>; cut at ``limit`` characters with an ellipsis."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")
    cut = bound(text, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t))
    return F.when(index.isNull() | (F.size(index) == 0), F.lit("")).otherwise(cut)


def bound(value: Column, body) -> Column:
    """body(value), where the lambda binds the value, so that it is made once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inverted_index(text: Column) -> Column:
    """map<word, array<position>> of the words between single spaces, positions from 0. Words are sorted with their places and cut where a new one begins,
    so a text costs its words, and none leaves its row."""
    placed = F.array_sort(F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def entries(own: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(own) + 1))
        places = lambda s, e: F.transform(F.slice(own, s, e - s), lambda x: x["p"])
        return F.map_from_entries(F.zip_with(starts, ends, lambda s, e: F.struct(F.get(own, s - 1)["w"].alias("key"), places(s, e).alias("value"))))

    def cut(own: Column) -> Column:
        new = lambda i: (i == 1) | (F.get(own, i - 1)["w"] != F.get(own, F.greatest(i - 2, F.lit(0)))["w"])
        return bound(F.filter(F.sequence(F.lit(1), F.size(own)), new), lambda starts: entries(own, starts))

    return bound(placed, cut)


def topic_terms(topic: Column) -> Column:
    return F.array_except(F.filter(tokens(topic), lambda t: F.length(t) >= 3), strings(K.TITLE_STOP))


def mentions_topic(title: Column, terms: Column) -> Column:
    low = F.lower(title)
    return (F.size(terms) == 0) | F.exists(terms, lambda t: F.contains(low, t))


def phrases(title: Column, terms: Column) -> Column:
    """Names of possible interventions in a title, with repeats, if it has a word that introduces one."""
    found = F.concat(F.regexp_extract_all(title, F.lit(K.PHRASE_IN_PARENTHESES), F.lit(1)), F.regexp_extract_all(title, F.lit(K.PHRASE_BEFORE_MARKER), F.lit(1)))
    clean = F.transform(F.filter(found, lambda p: ~F.array_contains(terms, F.lower(F.trim(p)))), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.when(F.rlike(F.lower(title), F.lit(K.INTERVENTION)), clean).otherwise(strings(()))


def snippet(text: Column, limit: int = 240) -> Column:
    return F.substring(text, 1, limit)


def extracted_json(text: Column) -> Column:
    """The outermost braces of a text."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """0 for an empty or zero vector; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, t: s + t)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda p: p.cast("double") * p.cast("double"))))
    size = norm(x) * norm(y)
    return F.when(size > 0, dot / size).otherwise(F.lit(0.0))
