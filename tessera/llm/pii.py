"""Personal data by a skip-chain conditional random field over candidate tokens.

Base spans follow fixed patterns (email, ip, card, phone). The field then labels the mentions of each document as other
or one of the kinds, so that those the patterns miss are found. A mention is a base span; or, between them, a word that
holds a digit or an @; numbers with a single space between them are one mention while they have at most 19 digits and
none begins with a +, so that no part of a number is judged alone.

  node pieces    a softmax over features of the mention's shape, its checksum and the range of its parts
  chain edges    between mentions that follow each other directly
  skip edges     between distant mentions with equal or similar contents: the same digits whatever the separators, or
                 the same letters and digits; each is linked to the next and to the first such mention, so m mentions
                 have fewer than 2 m edges

Pieces are trained apart (piecewise training) on a bounded sample of documents (``train_docs`` different texts of at most
``train_chars`` characters), whose labels are the base spans: the softmax by gradient descent, edges by smoothed log
ratios of label pairs. At inference base spans are evidence, and loopy sum-product message passing runs per document
until it settles. Another mention becomes a span of a kind whose probability reaches ``threshold``.

Edge cases: a null or empty text has no spans; a null doc_id is passed through; repeated rows are treated each;
an empty table gives an empty result, and an empty sample a field that adds nothing; matching takes time in
proportion to a text's length whatever it holds; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, released, table, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
TRAIN_DOCS, TRAIN_CHARS, THRESHOLD, ROUNDS, FEATURES = 4000, 20_000, 0.9, 20, 512

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]").search
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?[0-9@][^\x20\x09-\x0D]*").finditer
_NOT_DIGIT = re.compile("[^0-9]+")
_EDGES = " \t.,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind.

    A local part's leftmost start is where its run of characters begins (or the last match ends), so emails are
    found from their @; a number's is where its run of digits begins.
    """
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT(text):
        for m in _IP(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
        found.sort()
    return found


@dataclass
class Mentions:
    """Mentions of a text in order: their places, labels (of base spans: their kind, from 1; else 0), features, and the
    edges between them."""

    start: list[int]
    end: list[int]
    label: list[int]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _bucket(*x) -> int:
    return int.from_bytes(hashlib.blake2b(repr(x).encode("utf-8", "replace"), digest_size=4).digest(), "little") % FEATURES


_NUMBER = re.compile(r"[0-9()+./-]+").fullmatch
_DOTTED = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").fullmatch


def places(text: str, base: list[Span]) -> list[Span]:
    """start, label and end of every mention."""
    covered: list[list[int]] = []
    for a, _, b in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out: list[Span] = [(a, kind + 1, b) for a, kind, b in base]
    k, digits, before = 0, 0, None
    for m in _CANDIDATE(text):
        word = m.group()
        core = word.strip(_EDGES.replace("(", "").replace(")", "")) or word
        a = m.start() + word.find(core)
        b = a + len(core)
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        if k < len(covered) and covered[k][0] < b:
            before = None
            continue
        n = len(_NOT_DIGIT.sub("", core)) if _NUMBER(core) else 99
        if before is not None and n + digits <= 19 and core[0] != "+" and text[before[2] : a] == " ":
            before, digits = (before[0], 0, b), digits + n
            out[-1] = before
        else:
            before, digits = (a, 0, b), n
            out.append(before)
    return sorted(out)


def mentions(text: str, base: list[Span]) -> Mentions:
    out = Mentions([], [], [], [], [], [])
    last: dict[tuple, tuple[int, int]] = {}
    for a, label, b in places(text, base):
        core, i = text[a:b], len(out.start)
        digits = _NOT_DIGIT.sub("", core)
        letters = sum(c.isalpha() for c in core)
        shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in core[:64]))
        parts = _DOTTED(core)
        fits = "-" if not parts else all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts.groups())
        sums = luhn(digits) if 14 <= len(digits) <= 19 else "-"
        out.features.append([
            0, _bucket("digits", min(len(digits), 20)), _bucket("letters", min(letters, 4)), _bucket("shape", shape), _bucket("at", "@" in core, core.count(".") > 0),
            _bucket("lead", core[0] if not core[0].isalnum() else ""), _bucket("dots", min(core.count("."), 4)), _bucket("n", min(len(core), 24)), _bucket("sum", sums), _bucket("fits", fits), _bucket("end", shape[-5:]),
        ])
        out.start.append(a)
        out.end.append(b)
        out.label.append(label)
        if i and out.end[i - 1] <= a and not text[out.end[i - 1] : a].strip(" "):
            out.chain.append((i - 1, i))
        keys = [("same", core.lower())] if len(core) >= 5 else []
        if len(digits) >= 6:
            keys.append(("digits", digits))
        if len(digits) >= 7:
            keys.append(("tail", digits[-7:]))
        for key in keys:
            if key in last:
                first, before = last[key]
                out.skip += [(j, i) for j in {first, before} if (j, i) not in out.skip[-6:]]
                last[key] = (first, i)
            else:
                last[key] = (i, i)
    return out


@dataclass
class Field:
    node: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels, log potentials
    skip: np.ndarray

    @staticmethod
    def train(texts: list[str], steps: int = 300, rate: float = 2.0, decay: float = 1e-4) -> Field:
        x, y, chain, skip = [], [], [np.zeros((0, 2), int)], [np.zeros((0, 2), int)]
        for text in texts:
            t = mentions(text, base_spans(text))
            labels = np.array(t.label, int)
            x += t.features
            y += labels.tolist()
            chain.append(labels[np.array(t.chain, int).reshape(-1, 2)])
            skip.append(labels[np.array(t.skip, int).reshape(-1, 2)])
        k = len(LABELS)
        node = np.zeros((FEATURES, k))
        if x:
            fx = np.array(x)
            cells, weight = np.unique(np.hstack([fx, np.array(y)[:, None]]), axis=0, return_counts=True)
            fx, fy, weight = cells[:, :-1], np.eye(k)[cells[:, -1]], weight / weight.sum()
            for _ in range(steps):
                p = np.exp(node[fx].sum(1))
                p /= p.sum(1, keepdims=True)
                g = np.zeros_like(node)
                np.add.at(g, fx.ravel(), np.repeat((fy - p) * weight[:, None], fx.shape[1], 0))
                node += rate * (g - decay * node)
        return Field(node, Field._ratio(np.vstack(chain)), Field._ratio(np.vstack(skip)))

    @staticmethod
    def _ratio(pairs: np.ndarray) -> np.ndarray:
        """log p(a, b) / p(a) p(b), from counts in both directions and one pair of each kind more."""
        k = len(LABELS)
        n = np.full((k, k), 0.5) + np.eye(k)
        np.add.at(n, (pairs[:, 0], pairs[:, 1]), 0.5)
        np.add.at(n, (pairs[:, 1], pairs[:, 0]), 0.5)
        n /= n.sum()
        return np.clip(np.log(n / n.sum(1, keepdims=True) / n.sum(0)), -4, 4)

    def marginals(self, t: Mentions, evidence: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities by loopy belief propagation, damped, until messages settle."""
        k = len(LABELS)
        unary = self.node[np.array(t.features)].sum(1)
        unary -= unary.max(1, keepdims=True)
        phi = np.exp(np.maximum(unary, -30))
        phi[evidence > 0] = 1e-12
        phi[evidence > 0, evidence[evidence > 0]] = 1
        pairs = np.array(t.chain + t.skip, int).reshape(-1, 2)
        if not len(pairs):
            return phi / phi.sum(1, keepdims=True)
        a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        chain, skip, chained = np.exp(self.chain), np.exp(self.skip), np.arange(len(a)) % len(pairs) < len(t.chain)  # both are symmetric
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.full((len(a), k), 1 / k)
        for _ in range(rounds):
            log = np.log(phi)
            np.add.at(log, b, np.log(message))
            into = log[a] - np.log(message[back])
            into = np.exp(into - into.max(1, keepdims=True))
            new = np.where(chained[:, None], into @ chain, into @ skip)
            new = 0.5 * message + 0.5 * new / new.sum(1, keepdims=True)
            moved, message = np.abs(new - message).max(), np.maximum(new, 1e-12)
            if moved < 1e-4:
                break
        log = np.log(phi)
        np.add.at(log, b, np.log(message))
        belief = np.exp(log - log.max(1, keepdims=True))
        return belief / belief.sum(1, keepdims=True)

    def spans(self, text: str, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
        """Base spans, and all."""
        base = base_spans(text)
        if "@" not in text and not _DIGIT(text):
            return base, base
        t = mentions(text, base)
        if not any(x == 0 for x in t.label):
            return base, base
        p = self.marginals(t, np.array(t.label))
        best = p.argmax(1)
        more = [(t.start[i], int(k) - 1, t.end[i]) for i, k in enumerate(best) if k and not t.label[i] and p[i, k] >= threshold]
        return base, sorted(base + more)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train_field(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Field:
    """A field from about ``train_docs`` different texts that hold a digit or an @ and have at most ``train_chars``
    characters: those with the smallest hash, as many as the number of such texts (estimated by a sketch) makes of
    the range of hashes. Only these reach the driver."""
    rows = docs.filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= train_chars)).select(F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    different = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    chosen = rows.filter(F.col("h") < min(1 << 63, -(1 << 63) + (train_docs << 64) // max(1, different)) - 1).distinct()
    return Field.train([t for _, t in sorted((r.h, r.text) for r in chosen.collect())][:train_docs])


def find_pii(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` with base (list of start, kind, end) and spans (all), and redacted: the text with each span replaced
    by its kind in brackets (null where the text is null)."""
    given = docs.select(*(F.col(f"`{c}`") for c in keep)) if "text" in keep else docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string"))
    at = given.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
    ddl = "array<struct<start:long,kind:string,end:long>>"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in given.dtypes if c in keep), f"base {ddl}", f"spans {ddl}", "redacted string"])
    rows = lambda found: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in found]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, spans, texts = [], [], []
            for text in batch.column(at).to_pylist():
                b, s = field.spans(text or "", threshold)
                base.append(rows(b))
                spans.append(rows(s))
                texts.append(text if text is None or not s else redact(text, s))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(base, span), pa.array(spans, span), pa.array(texts, pa.string())], names=[*keep, "base", "spans", "redacted"])

    return bounded_batches(given).mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """Overlapping spans are replaced together, by the kind of the first."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def _joined(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)))"


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train_field(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("spans")).alias("spans"))
