"""Personal data: a character-level bidirectional LSTM with CRF transitions, over a base of exact patterns.

The network is trained in numpy, once in the driver, on labelled spans: invented sentences in which personal data of every kind, in
plain and in disguised forms, and look-alikes that are none (versions, dates, prices, links) have been put in known places. It
labels each character as outside or as part of an email, ip, card, phone or secret.

Texts are read in windows of WIDTH characters that overlap by half. Each window is decoded by Viterbi over the CRF. Windows see an entity
twice or cut it, so all windows of a document are reconciled together: pieces that an edge cuts are followed into the neighbouring window and
joined to one span, of any length, and among overlapping spans those with the largest sum of scores are chosen by weighted interval scheduling. A span counts only if
it has the form of its kind (``well_formed``). Each kind needs a digit, an at sign or a bracketed "at", so windows without any
can't be where a span begins to be found and aren't decoded, unless a span reaches into them.

Base spans are exact patterns, leftmost and non-overlapping per kind, and always stay; the network adds spans that overlap
none of them.

Cases. Null or empty text: no spans. Texts of any length are read whole. Repeated rows get the same spans. Equal scores:
the span that ends first. Empty tables give empty results. ``mask`` keeps all columns; ``spans`` ignores extra ones.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
WIDTH = 192
STEP = WIDTH // 2
HIDDEN = 16
EMBED = 12
BATCH = 1024

# --- base patterns -------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits can't begin a match in its middle if it can't at its start, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind indexes KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x[-40:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


# --- network -------------------------------------------------------------------------------------------------------

TAGS = 1 + len(KINDS)
_CODES = 132


def codes(text: str) -> np.ndarray:
    """A number for each character: ASCII itself, then one for spaces, letters, digits or other characters beyond it; 131 is padding."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, np.where(c < 0xC0, 130, 128)).astype(np.int64)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Bidirectional LSTM with a CRF layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.3, (_CODES, EMBED)), "A": np.zeros((TAGS, TAGS)), "W": r.normal(0, 0.3, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"X{d}": r.normal(0, 0.4, (EMBED, 4 * HIDDEN)), f"H{d}": r.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """x: (batch, time) codes -> states (time, batch, HIDDEN), gates if they are kept."""
        p, n = self.p, HIDDEN
        table = p["E"] @ p[f"X{d}"] + p[f"b{d}"]
        order = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = c = np.zeros((len(x), n), np.float32)
        out = np.empty((x.shape[1], len(x), n), np.float32)
        kept = []
        for t in order:
            z = table[x[:, t]] + h @ p[f"H{d}"]
            s = _sigmoid(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, c = c, f * c + i * g
            u = np.tanh(c)
            if keep:
                kept.append((t, i, f, o, g, before, u, h))
            h = o * u
            out[t] = h
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, batch, TAGS)."""
        both = np.concatenate([self._lstm(x, d)[0] for d in "fb"], axis=2)
        return both @ self.p["W"] + self.p["c"]

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags (time, batch)."""
        a, score = self.p["A"], e[0]
        back = np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            s = score[:, :, None] + a
            back[t] = s.argmax(1)
            score = s.max(1) + e[t]
        tags = np.empty(e.shape[:2], np.int8)
        tags[-1] = score.argmax(1)
        rows = np.arange(e.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        return tags

    def _gradients(self, x: np.ndarray, y: np.ndarray):
        p, (n, T) = self.p, x.shape
        hf, kf = self._lstm(x, "f", True)
        hb, kb = self._lstm(x, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        e = both @ p["W"] + p["c"]
        a = p["A"]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, T):
            alpha[t] = lse(alpha[t - 1][:, :, None] + a, 1) + e[t]
        for t in range(T - 2, -1, -1):
            beta[t] = lse(a + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        pair = np.exp(alpha[:-1, :, :, None] + a + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        one = np.eye(TAGS, dtype=np.float32)[y.T]
        gold = np.einsum("tni,tnj->ij", one[:-1], one[1:])
        de = (de - one) / n
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["A"] = (pair - gold) / n
        g["W"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        g["c"] = de.sum((0, 1))
        dboth = de @ p["W"].T
        for d, kept, dh_all in (("f", kf, dboth[:, :, :HIDDEN]), ("b", kb, dboth[:, :, HIDDEN:])):
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            dtable = np.zeros((_CODES, 4 * HIDDEN), np.float32)
            for t, i, f, o, gg, before, u, hp in reversed(kept):
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - u * u)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * u * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                np.add.at(dtable, x[:, t], dz)
                g[f"H{d}"] += hp.T @ dz
                dh, dc = dz @ p[f"H{d}"].T, dc * f
            g[f"X{d}"] = p["E"].T @ dtable
            g[f"b{d}"] = dtable.sum(0)
            g["E"] += dtable @ p[f"X{d}"].T
        return g

    def train(self, texts, steps: int = 260, batch: int = 48, length: int = 96, rate: float = 0.012, seed: int = 11) -> "Tagger":
        """texts: (text, [(start, kind, end)]) with labelled spans; Adam over random windows."""
        r = np.random.default_rng(seed)
        data = []
        for text, spans in texts:
            x, y = np.full(length, 131), np.zeros(length, np.int64)
            c = codes(text)[:length]
            x[: len(c)] = c
            for s, k, e in spans:
                y[s:e] = k + 1
            data.append((x, y))
        X, Y = (np.stack(v) for v in zip(*data))
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            rows = r.integers(0, len(X), batch)
            g = self._gradients(X[rows], Y[rows])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k in self.p:
                x = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


# --- labelled spans ------------------------------------------------------------------------------------------------


def labelled_sentences(n: int = 3000, seed: int = 3, length: int = 96) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented sentences with labelled spans, from a seed: words of random syllables around personal data and look-alikes."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    digits = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    syllables = "th he an in er on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción ment que eux sch lich keit ung über é è ñ ó ü ß".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(r.integers(1, 4))))
    name = lambda: re.sub("[^a-z]", "x", word() + word())
    host = lambda: pick([f"mail{digits(1)}.example.com", f"{name()}.org", f"{name()}.co.uk", f"{name()}-{name()}.net", f"{name()}.example"])
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def card() -> str:
        d = digits(int(r.integers(14, 19)))
        d += next(str(x) for x in range(10) if luhn(d + str(x)))
        sep = pick(["", "", " ", "-", "."])
        return sep.join(re.findall(".{1,4}", d))

    def phone() -> str:
        a, b, c, cc = digits(3), digits(3), digits(4), digits(int(r.integers(1, 3)))
        return pick([f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{cc}{a}{b}{c}", f"00{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}"])

    def email() -> str:
        user = pick([f"{name()}.{digits(2)}", name(), f"{name()}_{name()}", f"{name()}+{name()}"])
        at, h = pick(["@", "@", "@", " (at) ", " [at] ", "(at)", " @ ", "[at]"]), host()
        return user + at + (h if at == "@" or r.random() < 0.4 else h.replace(".", pick([" (dot) ", " [dot] ", "(dot)", "[dot]"])))

    def ip() -> str:
        return pick([".", ".", ".", "[.]", " . "]).join(str(int(x)) for x in r.integers(0, 256, 4))

    def secret() -> str:
        return pick([lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), lambda: f"password={hexes(18)}", lambda: f'token = "{hexes(40)}"', lambda: f"api_key: {hexes(32)}", lambda: f"ghp_{hexes(36)}"])()

    def none() -> str:
        return pick([
            lambda: f"Version {digits(1)}.{digits(1)}.", lambda: f"version {digits(1)}.{digits(1)}.{digits(2)}", lambda: f"BY-NC {digits(1)}.0.", lambda: f"{pick(['19', '20'])}{digits(2)}", lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
            lambda: f"${digits(1)},{digits(3)}.{digits(2)}", lambda: digits(int(r.integers(1, 9))), lambda: f"{digits(1)}/{digits(2)}", lambda: f"https://{host()}/{word()}/{digits(3)}", lambda: f"@{name()}", lambda: f"({word()}) [{word()}]", lambda: f"{digits(2)}:{digits(2)}",
            lambda: f"{digits(1)}.{digits(1)} {digits(2)}%", lambda: f"{word()}### {word()}$$$ {word()}&&&", lambda: f"#{digits(4)}", lambda: f"{word()} | {word()} | {digits(3)}",
        ])()

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < length:
            x = r.random()
            if x < 0.10:
                kind = int(r.integers(len(KINDS)))
                s = (email, ip, card, phone, secret)[kind]()
                if len(text) + len(s) > length:
                    break
                spans.append((len(text), kind, len(text) + len(s)))
                text += s + pick([" ", " ", ". ", ", ", "\n"])
            else:
                text += (none() if x < 0.18 else word()) + pick([" ", " ", " ", " ", ". ", ", ", "\n"])
        out.append((text[:length], spans))
    return out


_trained: dict[int, Tagger] = {}


def trained(seed: int = 7) -> Tagger:
    """The tagger, trained once in a process."""
    if seed not in _trained:
        _trained[seed] = Tagger(seed).train(labelled_sentences())
    return _trained[seed]


# --- texts ---------------------------------------------------------------------------------------------------------

_AT = r"[\[({<]\s?at\s?[\])}>]"
_TRIGGER = re.compile(rf"[0-9@]|{_AT}", re.I)
_FORMS = {
    "email": re.compile(rf"[\w.%+-]+(\s?@\s?|\s?{_AT}\s?)[A-Za-z0-9-]+((\.|\s?[\[({{<]\s?dot\s?[\])}}>]\s?|\s\.\s)[A-Za-z0-9-]+)+", re.I),
    "ip": re.compile(r"(25[0-5]|2[0-4]\d|1?\d?\d)((\.|\[\.\]|\s\.\s)(25[0-5]|2[0-4]\d|1?\d?\d)){3}"),
    "card": re.compile(r"\d([\s.-]?\d){13,18}"),
    "phone": re.compile(r"(\+\d{1,3}[\s.-]?|00\d{1,3}[\s.-]?)?(\(\d{2,4}\)|\d{2,4})([\s.-]?\d{2,4}){2,4}"),
    "secret": re.compile(r"""(?:[A-Za-z_-]+\s?[:=]\s?)?["']?(?=[A-Za-z_]*\d)(?=\d*[A-Za-z])[A-Za-z0-9_]{16,}["']?"""),
}


def well_formed(kind: int, s: str) -> bool:
    """Whether a decoded span has the form of its kind; cards must pass Luhn, phones have 10 to 15 digits, secrets 3 digits at least."""
    name = KINDS[kind]
    if not _FORMS[name].fullmatch(s) or not _TRIGGER.search(s):
        return False
    d = re.sub(r"\D", "", s)
    return {"card": lambda: luhn(d), "phone": lambda: 10 <= len(d) <= 15 and bool(re.search(r"[+() .-]|^00", s)), "secret": lambda: len(d) >= 3}.get(name, lambda: True)()


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a trigger, wholly or in part."""
    if not _TRIGGER.search(text):
        return []
    last = max(0, -(-(len(text) - WIDTH) // STEP)) * STEP
    starts = set()
    for m in _TRIGGER.finditer(text):
        k = m.start() // STEP * STEP
        starts.update(s for s in (k - STEP, k) if 0 <= s <= last)
    return sorted(starts)


def _runs(tags: np.ndarray):
    """(row, kind, start, end) of runs of one tag other than 0; tags: (batch, time)."""
    padded = np.pad(tags, ((0, 0), (1, 1)))
    row, at = np.nonzero(padded[:, 1:] != padded[:, :-1])
    ends = np.flatnonzero(padded[row, at] > 0)
    for j in ends:
        yield int(row[j]), int(padded[row[j], at[j]]) - 1, int(at[j - 1]), int(at[j])


def _edges(text: str, s: int, e: int, kind: int) -> tuple[int, int]:
    """The span without white space and punctuation at its ends."""
    left = " \t\n\r\f\v.,;:" if kind != 3 else " \t\n\r\f\v.,;:)"
    while s < e and text[s] in left:
        s += 1
    while e > s and text[e - 1] in " \t\n\r\f\v.,;:(":
        e -= 1
    return s, e


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Among spans (start, kind, end, score) of all windows of a text, those without overlap whose scores sum highest."""
    spans = sorted({(e, s, k): w for s, k, e, w in sorted(found, key=lambda x: x[3])}.items())
    best: list[tuple[float, int]] = [(0.0, -1)]
    ends = [e for (e, _, _), _ in spans]
    for i, ((e, s, k), w) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], s, side="right"))
        best.append(max(best[i], (best[j][0] + w, i), key=lambda x: x[0]))
    out, i = [], len(spans)
    while i > 0:
        if best[i] == best[i - 1] or best[i][1] != i - 1:
            i -= 1
            continue
        (e, s, k), _ = spans[i - 1]
        out.append((s, k, e))
        i = int(np.searchsorted(ends[: i - 1], s, side="right"))
    return out[::-1]


def joined_halves(halves: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """Spans longer than windows overlap: pieces (start, kind, end, score, cut at the left, cut at the right) of one kind that overlap or touch
    are one span, if its own ends aren't cut; its score is the pieces' mean a character times its length."""
    out = []
    for kind in range(len(KINDS)):
        run: list = []
        for piece in [*sorted(h for h in halves if h[1] == kind), None]:
            if run and (piece is None or piece[0] > max(h[2] for h in run)):
                s, e = run[0][0], max(h[2] for h in run)
                if not all(h[4] for h in run if h[0] == s) and not all(h[5] for h in run if h[2] == e):
                    out.append((s, kind, e, (e - s) * sum(h[3] for h in run) / sum(h[2] - h[0] for h in run)))
                run = []
            if piece is not None:
                run.append(piece)
    return out


def model_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans of the network in each text, reconciled over its windows. A span that a window cuts is followed into the next window, however
    long it is."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    halves: list[list[tuple[int, int, int, float, bool, bool]]] = [[] for _ in texts]
    seen: list[set[int]] = [set(windows(t)) for t in texts]
    todo = [(i, at) for i, starts in enumerate(seen) for at in sorted(starts)]
    more: list[tuple[int, int]] = []

    def decode(part: list[tuple[int, int]]) -> None:
        x = np.full((len(part), WIDTH), 131)
        for r, (i, at) in enumerate(part):
            c = codes(texts[i][at : at + WIDTH])
            x[r, : len(c)] = c
        e = tagger.emissions(x)
        tags = tagger.decode(e).T
        for r, kind, s, end in _runs(tags):
            i, at = part[r]
            text, end = texts[i], min(end, len(texts[i]) - at)
            if end <= s:
                continue
            score = float((e[s:end, r, kind + 1] - e[s:end, r, 0]).sum()) + 1e-3
            left, right = s == 0 and at > 0, end == WIDTH and at + end < len(text)
            if left or right:
                halves[i].append((at + s, kind, at + end, score, left, right))
                for beyond in (at - STEP,) * left + (at + STEP,) * right:
                    if beyond not in seen[i]:
                        seen[i].add(beyond)
                        more.append((i, beyond))
            else:
                found[i].append((at + s, kind, at + end, score))

    while todo:
        for at in range(0, len(todo), BATCH):
            decode(todo[at : at + BATCH])
        todo, more = more, []
    out = []
    for text, whole, cut in zip(texts, found, halves):
        good = []
        # a piece may go on in a span that another window sees whole
        for s, kind, e, score in whole + joined_halves(cut + [(*x, False, False) for x in whole if any(h[1] == x[1] and h[0] <= x[2] and x[0] <= h[2] for h in cut)]):
            a, b = _edges(text, s, e, kind)
            if a < b and well_formed(kind, text[a:b]):
                good.append((a, kind, b, score))
        out.append(reconcile(good) if good else [])
    return out


def all_spans(texts: list[str], tagger: Tagger):
    """For each text its base spans and, with them, those that the network adds."""
    for text, extra in zip(texts, model_spans(texts, tagger)):
        base = base_spans(text)
        added = [x for x in extra if not any(x[0] < e and s < x[2] for s, _, e in base)]
        yield base, sorted(base + added)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    tagger = tagger or trained()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            rows = []
            for base, every in all_spans([t or "" for t in b.column(1).to_pylist()], tagger):
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; a column n_chars follows the text."""
    tagger = tagger or trained()

    def run(batches):
        for b in batches:
            at = b.schema.names.index("text")
            texts = b.column(at).to_pylist()
            out = []
            for t, (_, every) in zip(texts, all_spans([t or "" for t in texts], tagger)):
                end, parts = 0, []
                for s, k, e in every:
                    if e > end:  # overlapping base spans of two kinds become one mark after the other
                        parts += [t[end:s] if s > end else "", f"<{KINDS[k].upper()}>"]
                        end = e
                out.append(t if t is None or not every else "".join(parts) + t[end:])
            columns = list(b.columns)
            columns[at] = pa.array(out, b.schema.field(at).type)
            if "n_chars" in b.schema.names:
                n = b.schema.names.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in out], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op3_bilstm_crf(spark, sf_dir):
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
