"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of ``dim`` entries, drawn from its code point. A trigram's vector
binds them: rotate(first, 2) * rotate(second, 1) * third. A document bundles (sums) the vectors of its trigrams, a
language's prototype those of its training documents, each document weighted by 1 over its number of trigrams.
The prediction is the prototype with the largest cosine.

Counting comes before binding: a chunk's trigram counts (documents by distinct trigrams) times the vectors of
those trigrams give its document vectors in one product. Where that table would be large, as with thousands of letters
or of short texts, occurrences are bound and summed in blocks instead, so a chunk's memory is bounded whatever it
holds. Prototypes are summed on the executors, so the driver gets
``dim`` numbers per language and partition at most; languages are a closed set (about 8,000 codes in ISO 639-3).

Letters are Unicode letters after lower-casing; every run of other characters is one boundary symbol.

Edge cases: a null text or one without letters is ``und`` with score 0; so is every text when nothing was learned;
a null doc_id or lang is no training row (its prediction is made all the same); repeated rows count each; an empty
table gives an empty result; texts of any length are taken in pieces cut at white space; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, released, table, utf8

DIM = 1024
UNDETERMINED = "und"
_CHUNK, _PIECES = 400_000, 2048  # characters and texts taken at once; bound memory, not results
_CELLS, _BLOCK = 4_000_000, 4096  # of a table of counts; trigrams or occurrences bound at once


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(65_536)
def letter_vector(code: int, dim: int) -> np.ndarray:
    """+1/-1 entries from a generator seeded with the code point."""
    return np.random.Generator(np.random.PCG64([code, dim])).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet (code points, 0 first) and, for each trigram of each text, the text's number and the trigram's
    distinct number; ``grams`` are the distinct trigrams as three alphabet places each."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of each run of other characters stays, as 0
    where = np.flatnonzero(kept)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in lower]), where, side="right")
    symbols = np.where(letter[where], codes[where], 0)
    if symbols.size == 0:
        return np.zeros(1, np.uint32), doc, np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    if symbols.max() < 1 << 16:
        seen = np.bincount(symbols, minlength=1)
        seen[0] = 1
        alphabet = np.flatnonzero(seen)
        rank = np.zeros(len(seen), np.int64)
        rank[alphabet] = np.arange(len(alphabet))
        s = rank[symbols]
    else:
        alphabet, s = np.unique(np.append(symbols, 0), return_inverse=True)
        s = s[:-1]
    a, middle = len(alphabet), np.flatnonzero(s)
    before = np.where(middle > 0, s[middle - 1], 0)  # a text that begins with a letter follows another's last 0
    key = (before * a + s[middle]) * a + s[middle + 1]
    if a**3 <= 4_000_000:
        seen = np.bincount(key, minlength=1)
        distinct = np.flatnonzero(seen)
        rank = np.zeros(len(seen), np.int64)
        rank[distinct] = np.arange(len(distinct))
        gram = rank[key]
    else:
        distinct, gram = np.unique(key, return_inverse=True)
    return alphabet, doc[middle], gram, np.stack([distinct // (a * a), distinct // a % a, distinct % a], 1)


def bundle(group: np.ndarray, gram: np.ndarray, weight: np.ndarray | None, groups: int, alphabet: np.ndarray, grams: np.ndarray, dim: int) -> np.ndarray:
    """The sum of the (weighted) vectors of each group's trigrams, from their occurrences (group, gram)."""
    if not len(gram):
        return np.zeros((groups, dim), np.float32)
    letters = np.stack([letter_vector(int(c), dim) for c in alphabet])
    first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)

    def bound(g: np.ndarray) -> np.ndarray:
        v = first[g[:, 0]]
        v *= second[g[:, 1]]
        v *= letters[g[:, 2]]
        return v.astype(np.float32)

    out = np.zeros((groups, dim), np.float32)
    if groups * len(grams) <= _CELLS:
        counts = np.bincount(group * len(grams) + gram, weight, groups * len(grams)).reshape(groups, -1).astype(np.float32)
        for i in range(0, len(grams), _BLOCK):
            out += counts[:, i : i + _BLOCK] @ bound(grams[i : i + _BLOCK])
        return out
    order = np.argsort(group, kind="stable")
    for i in range(0, len(order), _BLOCK):
        part = order[i : i + _BLOCK]
        v, own = bound(grams[gram[part]]), group[part]
        w = np.ones(len(part), np.float32) if weight is None else weight[part].astype(np.float32)
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
            out[own[a]] += w[a:b] @ v[a:b]
    return out


def _chunks(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and pieces of texts, about ``_CHUNK`` characters together; long texts are cut at white space."""
    numbers, pieces, n = [], [], 0
    for i, text in enumerate(texts):
        while text:
            cut = len(text)
            if cut > _CHUNK:
                cut = max(text.rfind(" ", 0, _CHUNK), text.rfind("\n", 0, _CHUNK)) + 1 or _CHUNK
            numbers.append(i)
            pieces.append(text[:cut])
            n += cut
            text = text[cut:]
            if n >= _CHUNK or len(pieces) >= _PIECES:
                yield numbers, pieces
                numbers, pieces, n = [], [], 0
    if pieces:
        yield numbers, pieces


def document_vectors(texts: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector and the number of trigrams of each text."""
    vectors, total = np.zeros((len(texts), dim), np.float32), np.zeros(len(texts), np.int64)
    for numbers, pieces in _chunks(texts):
        alphabet, doc, gram, grams = trigrams(pieces)
        np.add.at(vectors, numbers, bundle(doc, gram, None, len(pieces), alphabet, grams, dim))
        np.add.at(total, numbers, np.bincount(doc, minlength=len(pieces)))
    return vectors, total


def train(docs: DataFrame, training: Column, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype by language, from the rows where ``training`` holds and lang and text are not null."""
    rows = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            for numbers, pieces in _chunks(texts):
                alphabet, doc, gram, grams = trigrams(pieces)
                if not len(grams):
                    continue
                lang = np.array([place[langs[i]] for i in numbers])[doc]
                weight = 1 / np.bincount(doc, minlength=len(pieces))[doc]
                found = bundle(lang, gram, weight, len(names), alphabet, grams, dim)
                for x in set(lang.tolist()):
                    sums[names[x]] = sums.get(names[x], 0) + found[x].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = bounded_batches(rows).mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    bundled = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r.lang: np.array([x.x for x in r.v]) for r in bundled.collect()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred and score."""
    names = sorted(prototypes)
    unit = np.stack([prototypes[x] / (np.linalg.norm(prototypes[x]) or 1) for x in names]).T.astype(np.float32) if names else None
    given = docs.select(*(F.col(f"`{c}`") for c in keep)) if "text" in keep else docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string"))
    at = given.columns.index("text")
    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes if c in keep) + ", lang_pred string, score double"

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, total = document_vectors(utf8(batch.column(at)), dim)
            lang, score = [UNDETERMINED] * len(total), np.zeros(len(total))
            if names and len(total):
                cosine = vectors @ unit / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                best = np.round(cosine, 6).argmax(1)
                lang = [names[b] if n else UNDETERMINED for b, n in zip(best, total, strict=True)]
                score = np.where(total > 0, np.clip(np.round(cosine[np.arange(len(best)), best].astype(float), 6), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return bounded_batches(given).mapInArrow(run, schema)


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = train(docs, ~held_out() & F.col("doc_id").isNotNull())
    found = predict(docs, prototypes)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
