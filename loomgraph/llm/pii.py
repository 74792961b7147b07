"""Personal data in whole texts: patterns, then a skip-chain conditional random field.

The patterns give the base spans. The field reads a text's candidate tokens (those with a
digit or an at sign) as a chain, and joins tokens of equal core (the token without outer
punctuation, digits only if it has no letters) by skip edges, so that what is plain in one
place labels the same thing where the pattern fails. Tokens that overlap a base span are
clamped to it; a free token whose label is certain enough becomes a span of its own.

All factors are trained piecewise: each is the smoothed log odds of counts over the whole
corpus, with the base spans as labels and their telling context hidden, so that training
is one aggregation into a table whose size the number of token shapes bounds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = (*KINDS, "other")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
_OUTER = ".,;:!?()[]{}<>\"'*#&%$|`=~/\\"

Span = tuple[int, int, int]  # kind, start, end


@dataclass(frozen=True)
class PiiSettings:
    certainty: float = 0.9
    rounds: int = 10  # of loopy message passing
    damping: float = 0.5
    smoothing: float = 0.5
    agreement: float = 100.0  # least odds that equal tokens have equal labels


PRODUCTION = PiiSettings()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # The part before the sign has no sign, so each sign has one leftmost start.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield 0, start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches without overlap of each kind; those that fail their test are dropped."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


@dataclass(slots=True)
class Token:
    start: int
    end: int
    core: str
    shape: str
    adjacent: bool  # to the candidate before it
    label: int | None  # of the base span it lies in


def shape(core: str) -> str:
    """A class of tokens, from a bounded set: letters or not, sign, digits, dots.

    The plus that gives a phone number away is left out: the shape must say how likely
    a token is personal where the pattern doesn't see it.
    """
    digits = sum(c.isdigit() for c in core)
    letters = any(c.isalpha() for c in core)
    return f"{'a' if letters else ''}{'@' if '@' in core else ''}{min(digits, 20)}.{min(core.count('.'), 4)}"


def tokens(text: str, spans: list[Span]) -> list[Token]:
    """The candidate tokens of a text with their clamped labels.

    A token that lies in a span wholly, but for outer punctuation, has its label; one
    that merely touches a span is left to the patterns and is no candidate.
    """
    out, last = [], -2
    spans = sorted(spans, key=lambda s: s[1])
    at = 0
    for m in _CANDIDATE.finditer(text):
        raw = m.group()
        core = raw.strip(_OUTER)
        if not core:
            continue
        start = m.start() + raw.index(core)
        end = start + len(core)
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        over = [s for s in spans[max(0, at - 4) : at + 4] if s[1] < end and s[2] > start]
        label = next((k for k, a, b in over if a <= start and end <= b), None)
        if over and label is None:
            last = m.end()
            continue
        key = core if any(c.isalpha() for c in core) else "".join(c for c in core if c.isdigit())
        out.append(Token(start, end, key, shape(core), m.start() - last == 1, label))
        last = m.end()
    return out


def _skip_edges(row: list[Token]) -> list[tuple[int, int]]:
    """Tokens of equal core, each joined to the one before and to the first: linear in their number."""
    seen: dict[str, tuple[int, int]] = {}
    edges = []
    for i, t in enumerate(row):
        if len(t.core) < 6:
            continue
        first, last = seen.get(t.core, (i, i))
        if last != i:
            edges.append((last, i))
            if first != last:
                edges.append((first, i))
        seen[t.core] = first, i
    return edges


def _observed(text: str) -> Iterator[tuple[str, str, int, int, int]]:
    """(factor, key, label, label, count) of one text."""
    spans = base_spans(text)
    row = tokens(text, spans)
    counts: dict[tuple[str, str, int, int], int] = defaultdict(int)
    for i, t in enumerate(row):
        mine = OTHER if t.label is None else t.label
        counts["node", t.shape, mine, 0] += 1
        if t.adjacent and i:
            before = OTHER if row[i - 1].label is None else row[i - 1].label
            counts["chain", "", before, mine] += 1
    for i, j in _skip_edges(row):
        a, b = (OTHER if row[k].label is None else row[k].label for k in (i, j))
        counts["skip", "", a, b] += 1
    for (factor, key, a, b), n in counts.items():
        yield factor, key, a, b, n


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str, int, int], int] = defaultdict(int)
        for text in batch.column("text"):
            for factor, key, a, b, n in _observed(text.as_py() or ""):
                total[factor, key, a, b] += n
        rows = [(*k, n) for k, n in total.items()]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["factor", "key", "a", "b", "n"])


@dataclass(frozen=True)
class Field:
    """Log potentials: per shape and label, and two label-by-label tables."""

    node: dict[str, tuple[float, ...]]
    chain: np.ndarray
    skip: np.ndarray


def train(docs: DataFrame, settings: PiiSettings = PRODUCTION) -> Field:
    """Piecewise training over all texts; the collected table has one row per shape and label seen."""
    counted = docs.select("text").mapInArrow(_observe, "factor string, key string, a int, b int, n long")
    counted = counted.groupBy("factor", "key", "a", "b").agg(F.sum("n").alias("n"))
    size, smooth = len(LABELS), settings.smoothing
    node: dict[str, np.ndarray] = {}
    pair = {"chain": np.full((size, size), smooth), "skip": np.full((size, size), smooth)}
    for r in counted.collect():
        if r.factor == "node":
            node.setdefault(r.key, np.full(size, smooth))[r.a] += r.n
        else:
            pair[r.factor][r.a, r.b] += r.n
    # Two occurrences of one core have no order.
    pair["skip"] = pair["skip"] + pair["skip"].T

    def association(table: np.ndarray) -> np.ndarray:
        whole = table.sum()
        return np.log(table * whole / (table.sum(1, keepdims=True) * table.sum(0, keepdims=True)))

    agree = association(pair["skip"])
    np.fill_diagonal(agree, np.maximum(np.diag(agree), math.log(settings.agreement)))
    return Field({k: tuple(np.log(v / v.sum())) for k, v in node.items()}, association(pair["chain"]), agree)


def _beliefs(row: list[Token], edges: list[tuple[int, int, bool]], field: Field, settings: PiiSettings) -> np.ndarray:
    """Label probabilities of each token by damped loopy sum-product over chain and skip edges."""
    size = len(LABELS)
    unseen = tuple([-math.log(size)] * size)
    local = np.array([field.node.get(t.shape, unseen) for t in row])
    for i, t in enumerate(row):
        if t.label is not None:
            local[i] = -50.0
            local[i, t.label] = 0.0
    left = np.array([e[0] for e in edges])
    right = np.array([e[1] for e in edges])
    table = np.array([field.skip if e[2] else field.chain for e in edges])
    forth, back = np.zeros((len(edges), size)), np.zeros((len(edges), size))

    def normal(m: np.ndarray) -> np.ndarray:
        return m - np.logaddexp.reduce(m, axis=1, keepdims=True)

    for _ in range(settings.rounds):
        total = local.copy()
        np.add.at(total, right, forth)
        np.add.at(total, left, back)
        to_right = np.logaddexp.reduce((total[left] - back)[:, :, None] + table, axis=1)
        to_left = np.logaddexp.reduce((total[right] - forth)[:, None, :] + table, axis=2)
        forth = settings.damping * forth + (1 - settings.damping) * normal(to_right)
        back = settings.damping * back + (1 - settings.damping) * normal(to_left)
    np.add.at(local, right, forth)
    np.add.at(local, left, back)
    return np.exp(normal(local))


def added_spans(text: str, spans: list[Span], field: Field, settings: PiiSettings = PRODUCTION) -> list[Span]:
    """Spans of free tokens that the field labels with enough certainty.

    Only parts of the field that hold both a clamped and a free token joined by skip
    edges can say more than the patterns do; the rest is not visited. A phone number's
    or card's words that the base found as one span lend their label word by word, so
    a token shorter than six characters is never added.
    """
    row = tokens(text, spans)
    skips = _skip_edges(row)
    if not any((row[i].label is None) != (row[j].label is None) for i, j in skips):
        return []
    edges = [(i, j, True) for i, j in skips] + [(i - 1, i, False) for i in range(1, len(row)) if row[i].adjacent]
    beliefs = _beliefs(row, edges, field, settings)
    linked = {k for e in skips for k in e}
    out = []
    for i in sorted(linked):
        best = int(beliefs[i].argmax())
        if row[i].label is None and best != OTHER and beliefs[i, best] >= settings.certainty:
            out.append((best, row[i].start, row[i].end))
    return out


def personal_data(docs: DataFrame, field: Field, settings: PiiSettings = PRODUCTION) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and digest are of the base spans; ``spans`` adds the field's. ``docs`` needs
    doc_id and text; other columns are ignored. Offsets are code points, ends exclusive.
    A null or empty text has no spans. Work on a text is linear in its length and its
    candidate tokens. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((5, batch.num_rows), np.int64)
            digests, spans = [], []
            for row, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, shared.value, settings) if base else []
                for kind, _, _ in base:
                    counts[kind, row] += 1
                counts[4, row] = len(more)
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts[:4]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[4])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def find_personal_data(docs: DataFrame, settings: PiiSettings = PRODUCTION) -> DataFrame:
    """Trains the field on ``docs`` and applies it to them."""
    return personal_data(docs, train(docs, settings), settings)
