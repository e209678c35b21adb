"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some positions of a window of tokens and ignores the rest, so a hash of the tokens it looks at
survives substitutions at the others. Test items and documents are hashed by the same masks at every position and
joined on the hash. Around each hit, document and item are laid side by side on the hit's diagonal, and the hit
counts if some window of ``window`` item tokens (the whole item, if shorter) agrees in at least ``least`` of its tokens.

Everything is built from DataFrame and SQL functions. Hits are found without carrying texts along and written to the
scratch folder; a second pass verifies those of the few documents that have any. Items, their hashes and the hits are
broadcast while their measured size is at most ``broadcast_bytes``, so that documents are not shuffled; beyond that
Spark joins by shuffling.

No diagonal that verification would accept is missed: a window may disagree in ``e`` of its tokens, so of ``e`` + 2
blocks of it two agree throughout, and there is a mask for every pair of blocks (less those that another one implies).
Items shorter than a window have masks for their own length.

Tokens are runs of letters and digits, lower-cased.

Edge cases: null or empty texts have no tokens and match nothing; a null doc_id is reported as null; rows with one
doc_id are reported together; an item without tokens or with a null id matches nothing or is reported as null;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from decimal import ROUND_CEILING, Decimal
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_up_to, let, table, without_ids

WINDOW, LEAST = 13, 0.8
BROADCAST_BYTES = 32 << 20
TOKENS = "filter(split(lower(coalesce(text, '')), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')"


def seeds(width: int, least: float = LEAST) -> list[tuple[int, ...]]:
    """Masks, each from position 0, one of which agrees wherever ``least`` of a window of ``width`` tokens does."""
    need = max(1, int((Decimal(str(least)) * width).to_integral_value(ROUND_CEILING)))
    if need < 2:
        return [(0,)]
    n = width - need + 2
    ends = [width * k // n for k in range(n + 1)]
    pairs = [(*range(ends[a], ends[a + 1]), *range(ends[b], ends[b + 1])) for a, b in combinations(range(n), 2)]
    found: list[tuple[int, ...]] = []
    for m in sorted({tuple(x - p[0] for x in p) for p in pairs}, key=lambda m: (len(m), m)):
        if not any({x + s for x in f} <= set(m) for f in found for s in m):
            found.append(m)
    return found


def _hashed(rows: DataFrame, masks: dict[tuple[int, ...], list[int]], keep: list[str], width: str | None = None) -> DataFrame:
    """A row for each position and mask: ``keep``, at (from 0), h. Only ``keep`` is carried along with the tokens
    that the masks look at (hashed, so that they are short), never a text's array of tokens. Places without a token
    have no hash. With ``width``, a column, a row has only the masks of its own width."""
    looked = sorted({k for m in masks for k in m})
    shifted = ", ".join(["sequence(0, size(tokens) - 1)", *(f"slice(tokens, {k + 1}, greatest(size(tokens) - {k}, 0))" for k in looked)])
    names = ["at", *(f"w{k}" for k in looked)]
    given = [*keep, width] if width else keep
    hashed = rows.select(*given, F.expr("transform(tokens, w -> xxhash64(w))").alias("tokens"))
    one = hashed.select(*given, F.expr(f"inline(arrays_zip({shifted}))").alias(*names))
    own = lambda widths: f" OR {width} NOT IN ({', '.join(map(str, widths))})" if width else ""
    hashes = ", ".join(f"if(w{m[-1]} IS NULL{own(widths)}, NULL, xxhash64({i}, {', '.join(f'w{k}' for k in m)}))" for i, (m, widths) in enumerate(masks.items()))
    return one.select(*keep, F.col("at").cast("long").alias("at"), F.explode(F.expr(f"array({hashes})")).alias("h")).filter("h IS NOT NULL")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, best (agreeing tokens in the best window), matched (on the whole diagonal), n_item (the
    item's tokens), doc_start (the token of the document beside the item's first; negative if cut off), for the best
    diagonal of each document and item that overlap."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select("item_id", F.expr(TOKENS).alias("tokens")).filter("size(tokens) > 0").withColumn("item_key", F.xxhash64("tokens")).distinct()
    sizes = items.select(F.size("tokens").alias("n"), F.octet_length(F.concat_ws(" ", "tokens")).alias("b"))
    masks: dict[tuple[int, ...], list[int]] = {}  # and the widths of windows that each is for
    for (width,) in sorted(sizes.select(F.least("n", F.lit(window))).distinct().collect()):
        for m in seeds(width, least):
            masks.setdefault(m, []).append(width)
    masks = masks or {(0,): [1]}
    n_tokens, n_bytes = (x or 0 for x in sizes.agg(F.sum("n"), F.sum("b")).first())
    wanted = _hashed(items.withColumn("width", F.least(F.size("tokens"), F.lit(window))), masks, ["item_id", "item_key"], "width").withColumnRenamed("at", "item_at").distinct()
    rows = docs.select("doc_id", F.expr(TOKENS).alias("tokens"))
    hits = _hashed(rows, masks, ["doc_id"]).join(broadcast_up_to(wanted, 48 * n_tokens * len(masks), broadcast_bytes), "h")
    hits = hits.select("doc_id", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("start")).distinct()
    hits = scratch.table(hits, "hits")
    sided = hits.join(broadcast_up_to(items.withColumnRenamed("tokens", "item"), n_bytes + 32 * n_tokens, broadcast_bytes), [hits[c].eqNullSafe(items[c]) for c in ("item_id", "item_key")]).select("doc_id", hits["item_id"], "start", "item")
    each = (n_bytes + 32 * n_tokens) // max(1, sizes.count()) + 64
    sided = broadcast_up_to(sided.withColumnRenamed("doc_id", "hit_doc"), hits.count() * each, broadcast_bytes)
    beside = rows.join(sided, rows["doc_id"].eqNullSafe(sided["hit_doc"]))
    same = "transform(item, (w, k) -> if(start + k >= 0 AND start + k < size(tokens) AND get(tokens, cast(start + k AS int)) <=> w, 1, 0))"
    wide = f"least({window}, size(f))"
    sums = f"transform(sequence(0, size(f) - {wide}), i -> aggregate(slice(f, i + 1, {wide}), 0, (a, x) -> a + x))"
    found = beside.select(
        "doc_id", "item_id", "start", F.expr(let(same, "f", f"struct(array_max({sums}) AS best, aggregate(f, 0, (a, x) -> a + x) AS matched, size(f) AS n_item)")).alias("m")
    ).filter(f"m.best >= ceil({least} * least({window}, m.n_item))")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("m.best", "m.matched", (-F.col("start")).alias("minus"), "m.n_item")).alias("m"))
    return best.select("doc_id", "item_id", *(F.col(f"m.{c}").cast("long").alias(c) for c in ("best", "matched", "n_item")), (-F.col("m.minus")).alias("doc_start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item; rows without doc_id stay."""
    found = Scratch(docs.sparkSession).table(find_overlaps(docs, benchmark).select("doc_id"), "overlaps")
    return without_ids(docs, found)


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
