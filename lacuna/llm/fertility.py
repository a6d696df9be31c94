"""Quality rules from tokeniser fertility.

A public byte-level vocabulary for many languages reads every text. Three measures per document:

* chars_per_token: code points per token. Prose of a language the vocabulary knows has several; symbol noise has few.
* byte_share: tokens that hold no whole character, that is pieces of a character's UTF-8 bytes, among all tokens.
* entropy: Shannon entropy, in bits, of the document's token distribution over log2 of the number of its tokens (at most
  1); text that repeats few tokens has little.

Each language (column ``lang``, if there is one and it has a band) or else each script has its band of accepted values (BANDS); a
document outside it is rejected. The script is that of most of the letters, told from the text alone. The bands of the four
languages are ``fitted_bands`` of the labelled clean documents of sf0.1 with an even crc32 of doc_id: the least characters per token and
entropy less two standard deviations, the largest byte share plus two, a tenth at least. On the other half they reject 84 of 159 junk
texts that pass the base rules, all by characters per token, and 0 of 1,551 clean ones. What is left is junk of ordinary words. Texts under MIN_TOKENS tokens have no reliable ratios: they
are judged by the base rules only.

Base rules. ``words`` are runs of non-space; a document fails with fewer than 20 words, or if more than 30 % of its words
stand in 8-word windows that are found twice or more in it.

Cases. Null or empty text: no words, all counts 0, measures null, base_failed, not kept. Texts of any length are read
whole. Ties at a band's edge are inside. Repeated rows are judged alike. Empty tables give empty results; extra columns
are ignored by ``measure`` and kept by ``keep``.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections import Counter
from dataclasses import dataclass
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
WINDOW = 8
MIN_TOKENS = 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Band:
    """Accepted values; each edge is inside."""

    chars_per_token: tuple[float, float]
    byte_share: tuple[float, float]
    entropy: tuple[float, float]


#: By language, then by script; "other" holds for every script that has no band of its own.
BANDS = {
    "de": Band((2.36, 8.0), (0.0, 0.1), (0.41, 1.0)),
    "en": Band((2.26, 8.0), (0.0, 0.1), (0.4, 1.0)),
    "es": Band((2.2, 8.0), (0.0, 0.1), (0.41, 1.0)),
    "fr": Band((2.03, 8.0), (0.0, 0.1), (0.38, 1.0)),
    "latin": Band((1.9, 8.0), (0.0, 0.2), (0.35, 1.0)),
    "cyrillic": Band((1.2, 8.0), (0.0, 0.3), (0.35, 1.0)),
    "greek": Band((1.0, 8.0), (0.0, 0.4), (0.35, 1.0)),
    "arabic": Band((0.8, 8.0), (0.0, 0.4), (0.35, 1.0)),
    "hebrew": Band((0.8, 8.0), (0.0, 0.5), (0.35, 1.0)),
    "han": Band((0.4, 4.0), (0.0, 0.8), (0.35, 1.0)),
    "kana": Band((0.5, 4.0), (0.0, 0.7), (0.35, 1.0)),
    "hangul": Band((0.3, 4.0), (0.0, 0.9), (0.35, 1.0)),
    "none": Band((1.75, 8.0), (0.0, 0.5), (0.35, 1.0)),
    "other": Band((0.25, 8.0), (0.0, 1.0), (0.35, 1.0)),
}

_SCRIPTS = [
    ("latin", re.compile("[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]+")),
    ("cyrillic", re.compile("[Ѐ-ԯ]+")),
    ("greek", re.compile("[Ͱ-Ͽἀ-῿]+")),
    ("arabic", re.compile("[؀-ۿݐ-ݿ]+")),
    ("hebrew", re.compile("[֐-׿]+")),
    ("kana", re.compile("[぀-ヿ]+")),
    ("han", re.compile("[㐀-䶿一-鿿]+")),
    ("hangul", re.compile("[ᄀ-ᇿ가-힯]+")),
]


_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])


def script_of(text: str) -> str:
    """The script with most letters; "other" for letters of none of these, "none" without letters."""
    if 2 * int(_ASCII_LETTER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].sum()) > len(text):
        return "latin"
    latin = sum(map(len, _SCRIPTS[0][1].findall(text)))
    if 2 * latin > len(text):
        return "latin"
    counts = [(latin, "latin"), *((sum(map(len, p.findall(text))), name) for name, p in _SCRIPTS[1:])]
    most, name = max(counts, key=lambda x: x[0])
    rest = sum(c.isalpha() for c in text) - sum(n for n, _ in counts)
    if max(most, rest) <= 0:
        return "none"
    return name if most >= rest else "other"


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """The default vocabulary file; any other of the same form may be given by path."""
    spec = find_spec("public_tokenizers")
    if spec is None or not spec.origin:
        raise FileNotFoundError("the package public_tokenizers is not installed; give the vocabulary's path")
    return os.path.join(os.path.dirname(spec.origin), name)


class Fertility:
    """Measures of texts under one vocabulary; built once in each Python worker."""

    _built: dict[str, "Fertility"] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.partial = np.zeros(max(ranks.values()) + 1, bool)  # tokens without a whole character
        for token, rank in ranks.items():
            self.partial[rank] = not token.decode("utf-8", "ignore")

    @classmethod
    def at(cls, path: str) -> "Fertility":
        if path not in cls._built:
            cls._built[path] = cls(path)
        return cls._built[path]

    def measures(self, text: str) -> tuple[int, float | None, float | None, float | None]:
        """Tokens, characters per token, byte share, entropy; long texts are encoded in pieces cut between a word and white space."""
        ids: list[np.ndarray] = []
        at = 0
        while at < len(text):
            end = at + 200_000
            if end < len(text):
                end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
                end = end if end > at else min(len(text), at + 200_000)
            ids.append(np.array(self.encoding.encode_ordinary(text[at:end]), np.int32))
            at = end
        if not ids:
            return 0, None, None, None
        tokens = np.sort(np.concatenate(ids))
        n = np.diff(np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]])))
        total = len(tokens)
        entropy = float(-(n / total * np.log2(n / total)).sum()) / math.log2(total) if total > 1 else 1.0
        return total, len(text) / total, float(self.partial[tokens].mean()), abs(entropy)


def repeat_words(words: list[str], k: int = WINDOW) -> int:
    """Words that stand in a k-word window found twice or more in the text."""
    if len(words) <= k:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(words) - k + 1 + i]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0  # windows with different hashes differ
    # names of windows by doubling: each name is exact, no hashes
    known: dict[str, int] = {}
    width, names = 1, np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    while width < k:
        step = min(width, k - width)
        pair = names[: len(names) - step] * (int(names.max()) + 1) + names[step:]
        names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += step
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = _WORD.findall(text)
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen: Counter[str] = Counter()
    if "\n" in text:
        seen.update(line for line in text.split("\n") if _WORD.search(line))
    return len(words), sum(map(len, words)), symbols, seen.total() - len(seen), repeat_words(words)


def fitted_bands(rows, least: int = 30) -> dict[str, Band]:
    """Bands by language from (lang, chars_per_token, byte_share, entropy) of documents that are to be kept: the least ratio and entropy
    less two standard deviations, the largest share plus two, a tenth at least. Languages with fewer than ``least`` rows get none."""
    by: dict[str, list] = {}
    for lang, *values in rows:
        by.setdefault(lang, []).append(values)
    out = {}
    for lang, values in sorted(by.items()):
        x = np.array(values, float)
        if len(x) >= least:
            low, high, sd = x.min(0), x.max(0), x.std(0)
            floor = lambda i: math.floor(max(0.0, low[i] - 2 * sd[i]) * 100) / 100  # noqa: B023, E731
            out[lang] = Band((floor(0), 8.0), (0.0, max(0.1, math.ceil((high[1] + 2 * sd[1]) * 100) / 100)), (floor(2), 1.0))
    return out


def in_band(text: str, tokens: int, ratio, share, entropy, bands=BANDS, lang: str | None = None) -> bool:
    if tokens < MIN_TOKENS:
        return True
    band = bands[lang] if lang in bands else bands.get(script_of(text), bands["other"])
    return all(lo <= x <= hi for (lo, hi), x in ((band.chars_per_token, ratio), (band.byte_share, share), (band.entropy, entropy)))


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, entropy double"


def _judge(text: str, path: str, bands, lang: str | None = None) -> tuple:
    n, chars, symbols, dup, rep = base_counts(text)
    failed = n < MIN_WORDS or 100 * rep > MAX_REPEATED * n
    measured = Fertility.at(path).measures(text)
    return n, chars, symbols, dup, rep, failed, not failed and in_band(text, *measured, bands, lang), *measured


def _run(path: str, bands, schema: pa.Schema, whole: bool):
    def run(batches):
        for b in batches:
            at = b.schema.names.index("text")
            langs = b.column(b.schema.names.index("lang")).to_pylist() if "lang" in b.schema.names else [None] * b.num_rows
            rows = [_judge(t or "", path, bands, lang) for t, lang in zip(b.column(at).to_pylist(), langs)]
            if whole:
                yield b.filter(pa.array([r[6] for r in rows], pa.bool_()))
            else:
                columns = list(zip(*rows)) or [[]] * (len(schema) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return run


def measure(docs: DataFrame, path: str | None = None, bands=BANDS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the three measures with the number of tokens."""
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([("doc_id", pa.int64()), *((n, types[t]) for n, t in map(str.split, _COLUMNS.split(", ")))])
    lang = [F.col("lang").cast("string").alias("lang")] if "lang" in docs.columns else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *lang).mapInArrow(_run(path or vocabulary_path(), bands, schema, False), f"doc_id long, {_COLUMNS}")


def keep(docs: DataFrame, path: str | None = None, bands=BANDS) -> DataFrame:
    """The documents that pass the base rules and the bands, with all their columns."""
    return docs.mapInArrow(_run(path or vocabulary_path(), bands, pa.schema([]), True), docs.schema)


def op4_token_fertility(spark, sf_dir):
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
