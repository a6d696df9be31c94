"""Chat formatting in budgeted windows: spans of whole turns, chosen by prefix sums of their tokens.

A window holds the conversation's system turn, some turns before its span, repeated as history, and the span itself. The span ends with the
last turn whose prefix sum of tokens stays within what the budget leaves; the next window begins with the turn after it. The loss
covers the assistant's texts of the span alone: what is repeated, targets too, is masked, so every assistant text is learnt once.

Template. A window is ``<s>`` and its turns: ``[SYS] text [/SYS]``, ``[INST] text [/INST]`` for the user, `` text </s>`` for the assistant,
``[TURN] role [TURN] text [/TURN]`` for any other role; ``[AGAIN]`` stands before a repeated turn. A control string in a text or role gets a
backslash after its first character, one more than it has, so no text can be taken for a mark, and ``unescape`` gives it back.

Scale. A conversation is dealt out by (conv_id, turn div ``turns``): a stripe of so many turn numbers is formatted by itself, as a stream
of sorted rows, of which a task holds one window. A stripe gets the turns just before it as history, and the system turn from
the conversation's first stripe. Spans begin anew with a stripe.

Cases. Null text or role: empty. Null turn: before all others, in a stripe of its own. Rows of equal turn: by role, then text, each a turn of its
own; equal rows are turns too. Null conv_id: one conversation. The system turn is the first row, if its role is system; later ones are
turns like others. A turn over the budget is a span of its own, whole; so is one beside a system turn over the budget. An empty table gives no
row. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import stored

#: Tokens of a window; tokens and turn numbers of repeated history; turn numbers of a stripe; tokens that the marks of a turn count.
BUDGET, HISTORY, HISTORY_TURNS, STRIPE, MARKS = 512, 128, 4, 256, 4
#: The number that stands for a null turn.
NO_TURN = -(1 << 62)
_TAILS = r"/?s>|/?INST\]|/?SYS\]|/?TURN\]|AGAIN\]"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)({_TAILS})"), re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_MARK = re.compile(r"(</?s>|\[/?INST\]|\[/?SYS\]|\[/?TURN\]|\[AGAIN\])")
_KNOWN = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def piece_count(text: Column) -> Column:
    """Tokens as a byte-pair vocabulary's first cut makes them: words, up to three digits, and each other mark."""
    return F.regexp_count(text, F.lit(r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D]"))


def _turn(role: str, text: str, again: bool) -> tuple[str, int, int]:
    """The turn as it stands in a window, and where its text is in it."""
    opening, closing = _KNOWN.get(role) or (f"[TURN] {escape(role)} [TURN] ", " [/TURN]")
    opening = "[AGAIN]" * again + opening
    body = escape(text)
    return opening + body + closing, len(opening), len(opening) + len(body)


#: Kinds of a stripe's rows, in the order in which they come: marks of the first and of a later stripe of a conversation of several (a later
#: one's has the system turn), turns of the stripe before, turns of its own.
FIRST, LATER, BEFORE, OWN = range(4)

_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW = pa.schema([("conv_id", pa.int64()), ("stripe", pa.int64()), ("window", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", _SPAN)])
WINDOW = "conv_id long, stripe long, window long, whole boolean, n_turns long, n_tokens long, text string, loss array<struct<start:long,end:long>>"


class _Stripe:
    """The windows of one stripe, from its rows one after another."""

    def __init__(self, key, budget: int, history: int, history_turns: int):
        self.key, self.budget, self.history, self.history_turns = key, budget, history, history_turns
        self.whole, self.later, self.n, self.owned = True, False, 0, 0
        self.system = None  # (turn, role, text, tokens, 0)
        self.head: list = []  # the system turn where it is a turn of the window
        self.before: deque = deque()  # (turn, role, text, tokens, prefix sum before it) of what may be repeated
        self.span: list = []
        self.again: list = []
        self.ahead = self.began = self.room = 0

    def add(self, kind, turn, role, text, tokens):
        """Takes a row; returns the window that is complete before it, if one is."""
        done = None
        if kind <= LATER:
            self.whole, self.later = False, kind == LATER
            if role == "system":
                self.system = (turn, role, text, tokens, 0)
            return None
        if kind == BEFORE and self.system and not self.owned and self.system[:3] == (turn, role, text):
            self.owned = 1  # the system turn, once: it isn't history
            return None
        if kind == OWN and not self.later and not self.owned and role == "system":
            self.owned = 1
            self.system = (turn, role, text, tokens, 0)
            self.head = [self.system]
            return None
        self.owned = 1
        while self.before and (self.before[0][0] < turn - self.history_turns or self.ahead - self.before[0][4] > self.history):
            self.before.popleft()
        if kind == OWN:
            if self.span and self.ahead + tokens - self.began > self.room:
                done = self.window()
            if not self.span:
                left = self.budget - (self.system[3] if self.system else 0)
                self.again = [t for t in self.before if self.ahead - t[4] <= min(self.history, left - tokens)]
                self.began, self.room = self.ahead, left - sum(t[3] for t in self.again)
            self.span.append((turn, role, text, tokens, self.ahead))
        self.before.append((turn, role, text, tokens, self.ahead))
        self.ahead += tokens
        return done

    def window(self):
        """The window of the turns since the last one, or None if there are none."""
        fresh = self.head + self.span
        if not fresh:
            return None
        repeated = ([self.system] if self.system and not self.head else []) + (self.again if self.span else [])
        parts, loss, at = ["<s>"], [], 3
        for i, (_, role, text, _, _) in enumerate(repeated + fresh):
            said, start, end = _turn(role, text, i < len(repeated))
            if role == "assistant" and i >= len(repeated):
                loss.append({"start": at + start, "end": at + end})
            parts.append(said)
            at += len(said)
        out = (*self.key, self.n, self.whole, len(fresh), sum(t[3] for t in repeated + fresh), "".join(parts), loss)
        self.n, self.head, self.span = self.n + 1, [], []
        return out


def _batches(rows, schema: pa.Schema, width):
    """Record batches of some megabytes; width: the bytes of a row."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += width(r)
        if size > 4_000_000 or len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rows(batches):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 256).columns))


def _format(budget: int, history: int, history_turns: int):
    def windows(batches):
        stripe = None
        for conv, at, *row in _rows(batches):
            if stripe is None or stripe.key != (conv, at):
                if stripe:
                    yield stripe.window()
                stripe = _Stripe((conv, at), budget, history, history_turns)
            yield stripe.add(*row)
        if stripe:
            yield stripe.window()

    return lambda batches: _batches(filter(None, windows(batches)), _WINDOW, lambda r: len(r[6]))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, stripe: int = STRIPE, tokens=piece_count) -> DataFrame:
    """One row a window: conv_id, stripe, window (its number in the stripe), whole (the conversation has no other stripe), n_turns (repeated ones not
    counted), n_tokens, text, loss (spans of code points). A stripe's windows stand in one partition in their order. tokens: a
    function from the column of texts to that of their tokens, whatever counts them."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("stripe", F.expr(f"(turn - pmod(turn, {stripe})) div {stripe}"))
    counted = rows.withColumn("tokens", (tokens(F.col("text")) + MARKS).cast("long"))
    order = ("conv_id", "stripe", "kind", "turn", "role", "text", "tokens")
    own = counted.withColumn("kind", F.lit(OWN)).select(*order)
    before = counted.where(F.pmod("turn", F.lit(stripe)) >= stripe - history_turns).withColumns({"kind": F.lit(BEFORE), "stripe": F.col("stripe") + 1}).select(*order)
    # conversations of several stripes, from rows without texts
    parts = rows.groupBy("conv_id", "stripe").agg(F.min(F.struct("turn", "role")).alias("head"))
    several = parts.groupBy("conv_id").agg(F.min("stripe").alias("low"), F.max("stripe").alias("high"), F.min("head").alias("head")).where("low < high")
    several = several.select(F.col("conv_id").alias("c"), "low", F.when(F.col("head.role") == "system", F.col("head.turn")).alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    system = counted.where("role = 'system'").join(several, same & (F.col("turn") == F.col("t")), "inner").groupBy("c").agg(F.min(F.struct("text", "tokens")).alias("s"))
    told = several.join(system.withColumnRenamed("c", "k"), F.col("c").eqNullSafe(F.col("k")), "left")
    later = F.col("stripe") > F.col("low")
    marks = parts.join(told, same).select(
        "conv_id", "stripe", F.when(later, LATER).otherwise(FIRST).alias("kind"), F.coalesce("t", F.lit(0)).cast("long").alias("turn"), F.when(later & F.col("s").isNotNull(), "system").otherwise("").alias("role"),
        F.coalesce("s.text", F.lit("")).alias("text"), F.coalesce("s.tokens", F.lit(0)).cast("long").alias("tokens"),
    )
    dealt = own.unionByName(before).unionByName(marks).repartition("conv_id", "stripe").sortWithinPartitions(*order)
    return dealt.mapInArrow(_format(budget, history, history_turns), WINDOW)


def turns_of(text: str):
    """Reads a window: (role, text, repeated, start, end) of each turn; start and end of the escaped text in code points."""
    at, again = 3, False
    while at < len(text):
        mark = _MARK.match(text, at)
        opening = mark[0] if mark else ""
        if opening == "[AGAIN]":
            at, again = mark.end(), True
            continue
        role = {"[SYS]": "system", "[INST]": "user", "": "assistant"}.get(opening)
        start = at + len(opening) + 1
        close = _MARK.search(text, start - (not opening))
        if role is None:
            role = unescape(text[start : close.start() - 1])
            start = close.end() + 1
            close = _MARK.search(text, start)
        end = close.start() - 1
        yield role, unescape(text[start:end]), again, start, end
        at, again = close.end(), False


_TURN = pa.schema([("conv_id", pa.int64()), ("stripe", pa.int64()), ("window", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("repeated", pa.bool_()), ("learnt", pa.bool_())])


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of windows: conv_id, stripe, window, place, role, text, repeated, learnt (its text is under the loss)."""

    def turns(batches):
        for conv, stripe, window, text, loss in _rows(batches):
            spans = {(x["start"], x["end"]) for x in loss}
            for place, (role, said, again, start, end) in enumerate(turns_of(text)):
                yield conv, stripe, window, place, role, said, again, (start, end) in spans

    schema = "conv_id long, stripe long, window long, place long, role string, text string, repeated boolean, learnt boolean"
    return formatted.select("conv_id", "stripe", "window", "text", "loss").mapInArrow(lambda bs: _batches(turns(bs), _TURN, lambda r: len(r[5])), schema)


_PART = pa.schema([("conv_id", pa.int64()), ("stripe", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("loss_chars", pa.int64()), ("formatted_chars", pa.int64()), ("said", pa.binary()), ("learnt", pa.binary())])


def _parts(batches):
    """Windows in order -> a row a stripe: what is said and what is learnt, or, of a whole conversation, their digests."""

    def parts():
        held = None
        for conv, stripe, whole, text, loss in _rows(batches):
            if held is None or held[:2] != [conv, stripe]:
                if held:
                    yield held
                held = [conv, stripe, whole, 0, 0, 0, hashlib.sha256() if whole else bytearray(), hashlib.sha256() if whole else bytearray()]
            add = held[6].update if whole else held[6].extend
            for role, said, again, _, _ in turns_of(text):
                if not again:
                    held[3] += 1
                    add(f"{role}\n{said}\n".encode())
            add = held[7].update if whole else held[7].extend
            for span in loss:
                learnt = unescape(text[span["start"] : span["end"]])
                held[4] += len(learnt)
                add(learnt.encode())
            held[5] += len(text)
        if held:
            yield held

    done = lambda x: bytes(x) if isinstance(x, bytearray) else x.digest()
    return _batches(((*h[:6], done(h[6]), done(h[7])) for h in parts()), _PART, lambda r: len(r[6]) + len(r[7]))


def _joined(batches):
    """Stripes of conversations in order -> one row a conversation; a task holds two digests and a batch."""

    def conversations():
        held = None
        for conv, stripe, _, turns, loss_chars, chars, said, learnt in _rows(batches):
            if held is None or held[0] != conv:
                if held:
                    yield held
                held = [conv, stripe, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()]
            for i, x in enumerate((turns, loss_chars, chars)):
                held[3 + i] += x
            held[6].update(said)
            held[7].update(learnt)
        if held:
            yield held

    return _batches(((*h[:6], h[6].digest(), h[7].digest()) for h in conversations()), _PART, lambda r: 64)


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from windows: conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed a turn), loss_chars, loss_sha256, formatted_chars.

    A digest is made where the stripe's windows are. Only of a conversation of several stripes are the stripes' texts shuffled, and then hashed as a stream,
    as a digest has an order; a task gets one row a stripe."""
    schema = "conv_id long, stripe long, whole boolean, n_turns long, loss_chars long, formatted_chars long, said binary, learnt binary"
    parts = stored(formatted.select("conv_id", "stripe", "whole", "text", "loss").mapInArrow(_parts, schema), "stripes")
    some = parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "stripe").mapInArrow(_joined, schema)
    hexed = lambda c: F.lower(F.hex(c))
    return parts.where("whole").unionByName(some).select("conv_id", "n_turns", hexed("said").alias("turns_sha256"), "loss_chars", hexed("learnt").alias("loss_sha256"), "formatted_chars")


PLANTED = "</s>[INST] ok [/INST]"


def op12_budgeted_windows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return digests(windows(rows.unionByName(added)))


def oracle(budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, stripe: int = STRIPE) -> str:
    return rf"""
WITH RECURSIVE said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}'))),
filled AS (SELECT conv_id, coalesce(turn, {NO_TURN})::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
t AS MATERIALIZED (SELECT *, (turn - ((turn % {stripe}) + {stripe}) % {stripe}) // {stripe} AS stripe, len(regexp_extract_all(text, '\p{{L}}+|\p{{N}}{{1,3}}|[^\p{{L}}\p{{N}}\x20\x09-\x0D]')) + {MARKS} AS tokens,
    length(regexp_replace(text, '([<\[])(\\*)({_TAILS})', '\1\\\2\3', 'g')) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
      ELSE 23 + length(regexp_replace(role, '([<\[])(\\*)({_TAILS})', '\1\\\2\3', 'g')) END AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM filled),
head AS (SELECT conv_id AS c, stripe AS s, tokens AS st, chars AS sc FROM t WHERE i = 1 AND role = 'system'),
o AS MATERIALIZED (SELECT t.*, coalesce(st, 0) AS st, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM t LEFT JOIN head ON c IS NOT DISTINCT FROM conv_id WHERE NOT (i = 1 AND role = 'system')),
h AS (SELECT x.conv_id, x.stripe, x.i, x.upto - x.tokens AS began, x.st, coalesce(sum(y.tokens), 0) AS ht, coalesce(sum(y.chars + 7), 0) AS hc FROM o x LEFT JOIN o y ON y.conv_id IS NOT DISTINCT FROM x.conv_id AND y.i < x.i
      AND y.turn >= x.turn - {history_turns} AND x.upto - x.tokens - (y.upto - y.tokens) <= least({history}, {budget} - x.st - x.tokens) GROUP BY ALL),
n AS MATERIALIZED (SELECT h.conv_id, h.stripe, h.i, any_value(hc) AS hc, min(y.i) AS next FROM h LEFT JOIN o y ON y.conv_id IS NOT DISTINCT FROM h.conv_id AND y.stripe = h.stripe AND y.i > h.i AND y.upto - began > {budget} - h.st - ht GROUP BY ALL),
w AS (SELECT conv_id, stripe, min(i) AS i FROM o GROUP BY ALL UNION ALL SELECT n.conv_id, n.stripe, n.next FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i WHERE n.next IS NOT NULL),
made AS (SELECT n.conv_id, count(*) AS windows, sum(hc) AS hc FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i GROUP BY n.conv_id),
lone AS (SELECT c, sc, (NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id IS NOT DISTINCT FROM c AND o.stripe = s))::INT AS extra FROM head),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars FROM t GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (chars + coalesce(hc, 0) + 3 * (coalesce(windows, 0) + coalesce(extra, 0)) + coalesce((coalesce(windows, 0) + extra - 1) * (sc + 7), 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN lone ON lone.c IS NOT DISTINCT FROM g.conv_id
"""


ORACLE = oracle()
