"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share; letters may have up to GAP letters between them and
each subsequence counts LAMBDA to the power of what it spans, so an insult with letters put in, or with another ending, stays
near to the insult. A mark before the first letter takes part, so that a stem at a word's start is told from one inside it.
Letters of every script count, without case: a-z as themselves, others by one of OTHERS codes; what is no letter is left out,
so dots and dashes between letters change nothing. k(x, y) = <phi(x), phi(y)> / (|x| |y|), |x| being the root of the sum of the
squared weights of x's subsequences.

Fitting. Spark counts for each word of the labelled sentences (a sentence that several texts share counts once, as clean if
any of them is) in how many toxic and clean texts it is; only these counts reach the fit. Words are telling if toxic texts have
them so often that chance hardly explains it (a binomial tail below RARE over the number of words that
three texts have), or if that is so for their first few letters, texts with any word of that stem being counted. Landmarks are telling words,
each the one least like those before it, so that every language and every family of insults has its own, and common words of
clean texts. With K the kernel among landmarks and k(x) the kernel of a word with each, the features are K^(-1/2) k(x). A linear
SVM with squared hinge loss is trained on them: telling words against words of clean texts, of which those that score highest
are learnt from again. As its decision function is a sum of kernels it is kept as one table of weights over subsequences, so
scoring a word needs no landmark.

A text is described by the margin of its most toxic word, by how many words lie beyond the margin and by their share; a
logistic curve over these three, fitted on two thirds of the labelled texts, makes a probability. The other third sets the
cut by F1, and the curve is shifted so that THRESHOLD falls on it. Four or more single letters with a space between each are
read as one word more.

Cases. Null or empty texts and those without letters have no words and get the score of the least toxic. Texts of any length
are read whole. Repeated rows get one score. If no label is positive or none negative, or no word is telling, every score is
the share of positives (0.5 without labels, but below the cut if no word is telling). Ties: words in alphabetical order. Empty
tables give empty results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import labelled
from lacuna.llm.common import few

GAP = 2
LAMBDA = 0.7
OTHERS = 20  # codes of letters beyond a-z
START = 27
ALPHABET = START + 1 + OTHERS
TABLE = ALPHABET**3
WIDTH = 32  # longer words are read in windows of this width that overlap by half
LANDMARKS = 192
LEAST = -2.0
REMEMBERED = 300_000
PENALTY = 1e-4
RARE = 0.05
THRESHOLD = 0.3
#: Lengths of the stems whose counts are pooled.
STEMS = (4, 5, 6)
#: Bounds of the fit: labelled rows that are sampled, and clean words that it takes as negative examples.
MAX_ROWS = 12_000
CLEAN_WORDS = 20_000

_SPACED = re.compile(r" \w(?: \w){3,}(?!\S)")
_SENTENCE = r"(?<=[.!?])\s+|\n+"


def _letter_codes() -> np.ndarray:
    out = np.zeros(0x10000, np.int32)
    for c in range(0x10000):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else START + 1 + (c * 2654435761 >> 16) % OTHERS
    for c in range(26):
        out[65 + c] = c + 1
    return out


_CODE = _letter_codes()


def words_of(text: str) -> list[str]:
    """Runs of non-space in lower case; runs of single letters as one word each besides."""
    low = text.lower()
    words = low.split()
    spaced = [m.group()[1:] for m in _SPACED.finditer(" " + low)] if re.search(r"(?<!\S)\S \S(?!\S)", low) else []
    return words + spaced


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, WIDTH) letter codes and the word each row is of; a word has one row for each of its windows."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _CODE[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        code[high] = [START + 1 + (c * 2654435761 >> 16) % OTHERS if chr(c).isalpha() else 0 for c in points[high].tolist()]
    owner = np.repeat(np.arange(len(words)), sizes)
    letters = np.flatnonzero(code)
    owner, code = owner[letters], code[letters]
    n = np.bincount(owner, minlength=len(words)) + 1  # with the mark
    begin = np.cumsum(n) - n
    flat = np.full(int(n.sum()) + WIDTH, START, np.int32)
    flat[np.arange(len(code)) + owner + 1] = code
    half = WIDTH // 2
    windows = np.maximum(1, -(-(n - half) // half))
    row_of = np.repeat(np.arange(len(words)), windows)
    at = (np.arange(len(row_of)) - np.repeat(np.cumsum(windows) - windows, windows)) * half
    left = n[row_of] - at
    out = flat[(begin[row_of] + at)[:, None] + np.arange(WIDTH)]
    out[np.arange(WIDTH) >= left[:, None]] = 0
    return out, row_of


def _subsequences(codes: np.ndarray):
    """For each pair of gaps: the index of each three-letter subsequence in the table, whether it is one, its weight."""
    there = codes > 0
    first, second = codes * ALPHABET**2, codes * ALPHABET
    for g in range(1, GAP + 2):
        for h in range(1, GAP + 2):
            n = codes.shape[1] - g - h
            if n > 0:
                yield first[:, :n] + second[:, g : g + n] + codes[:, g + h :], there[:, g + h :], LAMBDA ** (g + h - 2)


def _norms(codes: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(sum(w * w * ok.sum(1) for _, ok, w in _subsequences(codes))), 1e-9)


def phi(words: list[str]) -> np.ndarray:
    """(words, TABLE) normalised; of words longer than WIDTH the first window."""
    codes, owner = _codes(words)
    codes = codes[np.concatenate([[True], owner[1:] != owner[:-1]])]
    out = np.zeros((len(words), TABLE), np.float32)
    for index, ok, w in _subsequences(codes):
        row, at = np.nonzero(ok)
        np.add.at(out, (row, index[row, at]), np.float32(w))
    out /= _norms(codes)[:, None].astype(np.float32)
    return out


def applied(table: np.ndarray, words: list[str]) -> np.ndarray:
    """<phi(word), table> for each word, the largest of its windows; table: (TABLE,) or (TABLE, m)."""
    out = np.full((len(words), *table.shape[1:]), -np.inf, np.float32)
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    size = 20_000 if table.ndim == 1 else 500
    for at in range(0, len(order), size):
        part = order[at : at + size]
        codes, owner = _codes([words[i] for i in part])
        codes = codes[:, : max(3, int((codes > 0).sum(1).max(initial=3)))]
        total = np.zeros((len(codes), *table.shape[1:]), np.float32)
        for index, ok, w in _subsequences(codes):
            got = table[index]
            got[~ok] = 0
            total += np.float32(w) * got.sum(1)
        norms = _norms(codes).astype(np.float32)
        np.maximum.at(out, part[owner], total / (norms if table.ndim == 1 else norms[:, None]))
    return out


@dataclass
class Model:
    table: np.ndarray  # weights of subsequences
    bias: float
    curve: np.ndarray  # weights of a text's three features, and the offset
    landmarks: list[str] = field(default_factory=list)

    def margins(self, words: list[str]) -> np.ndarray:
        return np.maximum(applied(self.table, words) + self.bias, LEAST) if words else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """x: (texts, 3)."""
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps over the examples inside the margin."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    weight = weight / weight.sum()
    ridge = np.diag([penalty] * x.shape[1] + [1e-8])
    w = np.zeros(x1.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(60):
        xa, wa = x1[active], weight[active]
        new = np.linalg.solve(ridge + (xa * wa[:, None]).T @ xa, (xa * wa[:, None]).T @ y[active])
        w = new if np.array_equal(w, 0 * w) else 0.5 * w + 0.5 * new
        now = y * (x1 @ w) < 1
        if (now == active).all() and np.allclose(w, new, atol=1e-6):
            break
        active = now
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weights and, last, the offset of a logistic curve, by Newton's method."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(x1.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def log_tail(hits: int, n: int, share: float) -> float:
    """log of the chance of ``hits`` or more out of n where each has chance ``share``."""
    k = np.arange(hits, n + 1)
    choose = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in k.tolist()])
    terms = choose + k * np.log(share) + (n - k) * np.log1p(-share)
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum()))


def telling(counts: list[tuple[str, int, int]], stems: list[tuple[str, int, int]], n_toxic: int, n_clean: int, n_words: int) -> list[str]:
    """Words that toxic texts have so often that chance hardly explains it, the surest first; words of a stem for which that is so
    need no more than two toxic texts of their own."""
    share = n_toxic / (n_toxic + n_clean)
    limit = np.log(RARE / max(n_words, 1))
    more = lambda t, c: t * n_clean > 4 * c * n_toxic
    sure_stems = {w for w, t, c in stems if t >= 3 and more(t, c) and log_tail(t, t + c, share) < limit}
    out = []
    for w, t, c in counts:
        if t >= 2 and more(t, c) and 3 <= len(w) < WIDTH:
            p = log_tail(t, t + c, share)
            if p < limit or any(w[:k] in sure_stems for k in STEMS if len(w) > k):
                out.append((p, w))
    return [w for _, w in sorted(out)]


def spread(words: list[str], k: int) -> list[str]:
    """At most k of the words: the first, then always the one that is least like those chosen."""
    if not words:
        return []
    like = lambda w: applied(phi([w])[0], words)  # noqa: E731  one row of the kernel; all of phi would be TABLE numbers a word
    chosen, near = [0], like(words[0])
    while len(chosen) < min(k, len(words)):
        at = int(near.argmin())
        if near[at] > 0.999:
            break
        chosen.append(at)
        near = np.maximum(near, like(words[at]))
    return [words[i] for i in chosen]


def fit_words(
    counts: list[tuple[str, int, int]], stems: list[tuple[str, int, int]], n_toxic: int, n_clean: int, n_words: int, landmarks: int = LANDMARKS
) -> tuple[np.ndarray, float, list[str]] | None:
    """The table and the bias from (word, toxic texts, clean texts) of words and of stems; None if no word is telling."""
    counts = sorted(counts)
    sure = telling(counts, stems, n_toxic, n_clean, n_words) if n_toxic and n_clean else []
    clean = [(w, c) for w, t, c in counts if c and 2 <= len(w) < WIDTH and w not in set(sure)]
    if not sure or not clean:
        return None
    marks = spread(sure, landmarks // 2)
    marks += [w for w, _ in sorted(clean, key=lambda x: (-x[1], x[0]))[: landmarks - len(marks)]]
    columns = np.ascontiguousarray(phi(marks).T)
    values, vectors = np.linalg.eigh((columns.T @ columns).astype(float))
    good = values > 1e-4
    whiten = vectors[:, good] / np.sqrt(values[good])  # K^(-1/2) up to a rotation
    features = lambda ws: applied(columns, ws) @ whiten
    known_clean = np.array([w for w, _ in clean])
    x_sure, x_clean = features(sure), features(known_clean.tolist())
    # each telling word weighs by how alone it stands, so that a large family of forms doesn't outweigh a single insult
    alone = 1 / np.concatenate([(x_sure[at : at + 500] @ x_sure.T > 0.5).sum(1) for at in range(0, len(sure), 500)]).clip(1)
    weight_clean = np.log1p(np.array([c for _, c in clean], float))
    picked = np.zeros(len(clean), bool)
    picked[:: max(1, len(clean) // 4000)] = True
    for _ in range(4):
        at = np.flatnonzero(picked)
        y = np.concatenate([np.ones(len(sure)), -np.ones(len(at))])
        weight = np.concatenate([alone, weight_clean[at]])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        w, b = svm(np.concatenate([x_sure, x_clean[at]]), y, weight)
        picked[np.argsort(-(x_clean @ w), kind="stable")[:1000]] = True
    return (columns @ (whiten @ w).astype(np.float32)).astype(np.float32), float(b), marks


def counted(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """(word, toxic texts, clean texts) of the examples (doc_id, text, y): the words that may be telling, and of the rest of the
    clean texts' words at most CLEAN_WORDS, those with the smallest hash; the same of the stems that may be telling; and the
    number of words and stems of three texts or more."""
    each = rows.select("doc_id", "y", F.explode(F.split(F.lower("text"), _SENTENCE)).alias("s"))
    once = each.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.min("y").alias("y"))
    words = once.select("doc_id", "y", F.explode(F.split("s", r"\s+")).alias("w"))
    words = words.select("doc_id", "y", F.regexp_replace("w", r"[^\p{L}]+", "").alias("w")).where((F.col("w") != "") & (F.length("w") < WIDTH))
    forms = F.array(F.struct(F.lit(0).alias("k"), F.col("w")), *(F.struct(F.lit(k).alias("k"), F.col("w").substr(1, k).alias("w")) for k in STEMS))
    forms = F.filter(forms, lambda x: (x["k"] == 0) | (x["k"] < F.length("w")))
    each = words.select("doc_id", "y", F.explode(forms).alias("x")).groupBy("x", "doc_id").agg(F.min("y").alias("y"))
    found = each.groupBy("x").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).select("x.k", "x.w", "t", "c").persist()
    n = found.where(F.col("t") + F.col("c") >= 3).count()
    more = (F.col("t") * n_clean > 4 * F.col("c") * n_toxic) & (F.col("t") >= F.when(F.col("k") == 0, 2).otherwise(3))
    top = found.where(more & (F.col("k") == 0)).select("w", "t", "c").collect()
    stems = found.where(more & (F.col("k") > 0)).select("w", "t", "c").collect()
    clean = few(found.where(~more & (F.col("k") == 0) & (F.col("c") > 0)), "w", CLEAN_WORDS).select("w", "t", "c").collect()
    found.unpersist()
    return [tuple(r) for r in (*top, *clean)], [tuple(r) for r in stems], n


_scores: dict[str, float] = {}
_scores_of: list = [None]


def _known(model_id) -> dict[str, float]:
    if _scores_of[0] != model_id:
        _scores.clear()
        _scores_of[0] = model_id
    return _scores


def text_features(model: Model, texts: list[str], known: dict[str, float]) -> np.ndarray:
    """(texts, 3): the largest margin, log of one more than the words beyond the margin, and of their share; ``known`` remembers words."""
    if len(known) > REMEMBERED:
        known.clear()
    each = [words_of(t) for t in texts]
    new = [w for w in set().union(*each) if w not in known] if each else []
    known.update(zip(new, model.margins(new).tolist()))
    out = np.empty((len(texts), 3))
    for i, words in enumerate(each):
        m = np.fromiter(map(known.__getitem__, words), np.float32, len(words))
        beyond = float(np.clip(m, 0, 1).sum())
        out[i] = m.max(initial=LEAST), np.log1p(beyond), np.log(beyond / max(len(words), 1) + 1e-3) - np.log(1e-3)
    return out


def described(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in ``keep`` (long), then score and the three features of each text."""
    name = uuid.uuid4().hex
    names = ["doc_id", *keep, "score", "margin", "beyond", "share"]

    def run(batches):
        known = _known(name)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = text_features(model, [t or "" for t in part.column(part.num_columns - 1).to_pylist()], known)
                rest = [pa.array(model.probability(x)), *(pa.array(x[:, i]) for i in range(3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *rest], names=names)

    longs = [F.col(c).cast("long").alias(c) for c in ("doc_id", *keep)]
    types = ", ".join(f"{n} {'long' if i <= len(keep) else 'double'}" for i, n in enumerate(names))
    return docs.select(*longs, "text").mapInArrow(run, types)


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of p with the highest F1, midway to the next lower value; ties: the higher cut."""
    values = np.unique(p)
    f1 = [2 * (hit := float(((p >= v) & (y == 1)).sum())) / max(float((p >= v).sum() + (y == 1).sum()), 1) for v in values]
    at = len(f1) - 1 - int(np.argmax(f1[::-1]))
    return float((values[at] + values[at - 1]) / 2) if at else float(values[0])


def calibrated(table: np.ndarray, bias: float, marks: list[str], x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> Model:
    """The curve from the features and labels of texts: fitted on two of three, cut on the third."""
    third = np.arange(len(y)) % 3 == 2
    if len(set(y[~third])) < 2 or len(set(y[third])) < 2:
        third = np.zeros(len(y), bool)
    curve = logistic(x[~third], y[~third].astype(float))
    model = Model(table, bias, curve, marks)
    held = third if third.any() else ~third
    cut = min(max(best_cut(model.probability(x[held]), y[held]), 1e-6), 1 - 1e-6)
    model.curve[-1] += np.log(threshold / (1 - threshold)) - np.log(cut / (1 - cut))
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int, fold: int, max_rows: int = MAX_ROWS) -> Model:
    """The model of ``labels.toxic`` from the rows outside the held-out fold."""
    rows = labelled.examples(docs, labels, "toxic", modulus, fold, max_rows).persist()
    n = rows.groupBy("y").count().collect()
    by = {r["y"]: r["count"] for r in n}
    words, stems, n_words = counted(rows, by.get(1, 0), by.get(0, 0))
    got = fit_words(words, stems, by.get(1, 0), by.get(0, 0), n_words)
    if got is None:
        share = min(max(by.get(1, 0) / max(sum(by.values()), 1), 1e-3), 0.999) if by else 0.5
        share = min(share, THRESHOLD / 2) if by.get(0) and by.get(1) else share
        model = Model(np.zeros(TABLE, np.float32), LEAST, np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))]))
    else:
        found = described(rows.select("doc_id", "y", "text"), Model(*got[:2], np.zeros(4)), ("y",)).drop("score").toPandas().sort_values("doc_id")
        model = calibrated(*got, found[["margin", "beyond", "share"]].to_numpy(), found["y"].to_numpy())
    rows.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, margin, beyond, share."""
    return described(docs, model)


MODULUS, FOLD = 4, 2


def op7_subsequence_svm(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MODULUS, FOLD)
    scored = score(docs, model)
    return scored.select("doc_id", labelled.held_out(MODULUS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
