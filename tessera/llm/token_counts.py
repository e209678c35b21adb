"""Token counts by trie-shared dynamic programming.

A unigram model scores a segmentation by the sum of its pieces' log probabilities. The distinct pre-tokens of a
batch form a trie; the best forward score of a prefix is computed once, at its node, from the scores of the nodes
above, and a node that ends a pre-token stores its token count. The trie is walked in the order of the sorted
pre-tokens, so only the path to the current node is held. Counts already known to the task are kept between batches
(the store is emptied at ``keep`` entries; that changes no result).

The vocabulary is a public one (a parameter). It holds merge ranks, not probabilities, so a piece of rank r gets
log p = -log(r + 2), normalised: Zipf's law. A character that no piece covers costs one token per UTF-8 byte.

Edge cases: a null or empty text has no tokens; a null doc_id is passed through; repeated rows count each; an empty
table gives an empty result; other columns are ignored; a doc_id must be a whole number or a string of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, released, table, utf8

KEEP = 400_000


class Unigram:
    """Log probabilities of pieces; a pre-token is written with a leading U+2581."""

    def __init__(self, model_path: str | None = None):
        import public_tokenizers as P
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path or P.path("piece_bpe_32k.model"))
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        total = math.log(sum(1 / (r + 2) for r in range(len(plain))))
        self.score = {model.id_to_piece(i): -math.log(r + 2) - total for r, i in enumerate(plain)}
        self.byte = min(self.score.values()) - 10.0
        lengths: dict[str, set[int]] = {}
        for piece in self.score:
            lengths.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(x) for c, x in lengths.items()}

    def count(self, pretokens: list[str]) -> Iterator[tuple[str, int]]:
        """Each pre-token with its token count. ``pretokens`` are sorted and distinct."""
        score, lengths, byte = self.score, self.lengths, self.byte
        path, best, tokens = "▁", [0.0], [0]  # by depth: the best score of the prefix and its number of tokens
        before = ""
        for word in pretokens:
            same = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                same += 1
            full = "▁" + word
            depth = same + 1 if before else 0
            del best[depth + 1 :], tokens[depth + 1 :]
            for d in range(depth + 1, len(full) + 1):
                last = full[d - 1]
                n = len(last.encode("utf-8", "surrogatepass"))
                s, t = best[d - 1] + n * byte, tokens[d - 1] + n
                for k in lengths.get(last, ()):
                    if k > d:
                        break
                    p = score.get(full[d - k : d])
                    if p is not None:
                        x, y = best[d - k] + p, tokens[d - k] + 1
                        if x > s or (x == s and y < t):
                            s, t = x, y
                best.append(s)
                tokens.append(t)
            before, path = word, full
            yield word, tokens[len(path)]


def token_counts(docs: DataFrame, model_path: str | None = None, keep: int = KEEP) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_chars of every document."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Unigram(model_path), {}
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            new = set(chain.from_iterable(split))
            if len(known) + len(new) > keep:
                known = {}
            new = sorted(w.decode("utf-8", "surrogatepass") for w in new - known.keys())
            for word, n in model.count(new):
                known[word.encode("utf-8", "surrogatepass")] = n
            get = known.__getitem__
            columns = [ids, [len(w) for w in split], [sum(map(get, w)) for w in split], [len(t) for t in texts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, list) else c for c in columns], names=["doc_id", "n_pretokens", "n_tokens", "n_chars"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, n_chars long")


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
