"""Combining texts into sequences of a fixed number of tokens with little unused space (problem 6).

Token counts come from a public tokenizer's ranks, read from a path that is a
parameter and sent to the workers (its size is checked). Texts longer than the
capacity are cut into full sequences and a rest; no other text is cut.

Packing is by multiway differencing (Karmarkar and Karp): every item begins as a
partition of k windows with itself in one; the two partitions of greatest spread
are merged, the fullest windows of one with the emptiest of the other, until one
is left, whose windows are nearly equal. k is the least number that could hold
all tokens; swaps between windows mend small excesses, and k rises when they can't.

Items are dealt to bins of a bounded number of tokens by hash and packed there in
parallel into windows that are as good as full; what each bin leaves over, less
than two windows, is dealt and packed again until one bin is left. So the unused
space is about that of a single packing.

Null and empty texts have no tokens and go to no sequence. Equal texts are items
of their own; a doc_id that comes twice counts once, with the text of fewest
tokens. Ties are broken by id.
"""

from __future__ import annotations

import base64
import functools
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.arrow import map_batches, map_group
from voxframe.operators.storage import fill_cores, materialise, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_RANKS_BYTES = 64_000_000
CAPACITY = 2048
#: Windows of a bin: a bin's packing holds items times windows numbers at most.
BIN_WINDOWS = 128
# Fixed value: the pattern that splits text before the merges of byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of texts with tokens."""
    ranks = Path(tokenizer).read_bytes()
    if len(ranks) > MAX_RANKS_BYTES:
        raise ValueError("the rank file is too large to be sent to the workers")
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(b: pa.RecordBatch) -> dict:
        encode = _encoding(shared.value).encode_ordinary
        return {"doc_id": b.column("doc_id"), "n_tokens": [len(encode(t)) for t in b.column("text").to_pylist()]}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    counts = map_batches(fill_cores(rows), run, "doc_id long, n_tokens long").where("n_tokens > 0")
    return counts.groupBy("doc_id").agg(F.min("n_tokens").alias("n_tokens"))


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of nearly equal sums."""
    if not sizes:
        return []
    # A partition is its windows (sum, items), fullest first; of its k windows only those with items are kept.
    heap: list[tuple[int, int, list[tuple[int, list]]]] = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Window i of a takes window k - 1 - i of b: the fullest meets the emptiest.
        free = k - len(b)
        met = [(a[i][0] + b[k - 1 - i][0], [a[i][1], b[k - 1 - i][1]]) for i in range(max(0, free), len(a))]
        merged = a[: max(0, free)] + met + b[: k - len(a)]
        merged.sort(key=lambda w: -w[0])
        n += 1
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == k else 0) - merged[0][0], n, merged))
    out = []
    for _, items in heap[0][2]:
        flat, todo = [], [items]
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(x)
            else:
                flat.append(x)
        out.append(flat)
    return out


def repair(sizes: list[int], windows: list[list[int]], capacity: int) -> bool:
    """Swap items (or move one) from windows beyond ``capacity`` to others with room, in place; True if all fit then."""
    fill = np.array([sum(sizes[i] for i in w) for w in windows])
    while True:  # each swap lessens what is beyond the capacity
        f = int(fill.argmax())
        over = int(fill[f]) - capacity
        if over <= 0:
            return True
        give = np.array([sizes[i] for i in windows[f]])
        best: tuple | None = None
        for t in np.argsort(fill, kind="stable"):
            room = capacity - int(fill[t])
            if room <= 0:
                break
            take = np.array([sizes[i] for i in windows[t]] + [0])
            gain = give[:, None] - take[None, :]
            gain = np.where((gain > 0) & (gain <= room), gain, 0)
            # What ends the excess with least change is best, else what lessens it most.
            score = np.where(gain >= over, over + (over / np.maximum(gain, 1)), gain)
            x = int(score.argmax())
            if score.flat[x] > 0 and (best is None or score.flat[x] > best[0]):
                best = (float(score.flat[x]), int(t), x // len(take), x % len(take), int(gain.flat[x]))
                if best[0] >= over + 0.99:
                    break
        if best is None:
            return False
        _, t, x, y, gain_ = best
        item = windows[f].pop(x)
        if y < len(windows[t]):
            windows[f].append(windows[t].pop(y))
        windows[t].append(item)
        fill[f] -= gain_
        fill[t] += gain_


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``; their number starts at the least that could do and rises when one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity), sum(1 for s in sizes if 2 * s > capacity))
    while True:
        windows = differencing(sizes, k)
        if repair(sizes, windows, capacity):
            return windows
        k += 1


def pack_full(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[list[int]], list[int]]:
    """Windows that are as good as full, and the items that are left for another bin."""
    total, k = sum(sizes), sum(sizes) // capacity
    for slack in (1, 2, 4, 8):
        left, out = [], 0
        for i in range(len(sizes)):
            if out >= total - k * capacity + slack * k:
                break
            left.append(i)
            out += sizes[i]
        kept = list(range(len(left), len(sizes)))
        windows = differencing([sizes[i] for i in kept], k) if k else []
        if repair([sizes[i] for i in kept], windows, capacity):
            return [[kept[j] for j in w] for w in windows], left if k else list(range(len(sizes)))
    return pack(sizes, capacity), []


# ---- the plan

_ITEMS = "bin long, seq long, item long, part int, n_tokens long"


def _pack_bin(capacity: int, last: bool):
    def run(group: dict) -> dict:
        # Items are taken by hash of their ids, so that what a bin leaves over is of all sizes.
        order = sorted(range(len(group["item"])), key=lambda i: (group["h"][i], group["item"][i], group["part"][i]))
        sizes = [group["n_tokens"][i] for i in order]
        windows, left = (pack(sizes, capacity), []) if last else pack_full(sizes, capacity)
        out: dict[str, list] = {c.split()[0]: [] for c in _ITEMS.split(", ")}
        for number, window in [*enumerate(windows), (-1, left)]:
            for j in window:
                i = order[j]
                for name, x in zip(out, (group["bin"][i], number, group["item"][i], group["part"][i], group["n_tokens"][i]), strict=True):
                    out[name].append(x)
        return out

    return run


def sequences(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, bin_windows: int = BIN_WINDOWS) -> DataFrame:
    """``seq_id, doc_id, part, first_token, n_tokens``: each text, or each piece of one longer than ``capacity``, in its sequence."""
    counts = materialise(token_counts(documents, tokenizer), "token_counts")
    cut = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))))
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("part").cast("long") * capacity)
    pieces = cut.select(F.col("doc_id").alias("item"), "part", size.alias("n_tokens"), F.xxhash64("doc_id", "part").alias("h"))
    rest = pieces.where(F.col("n_tokens") < capacity)
    done = [pieces.where(F.col("n_tokens") == capacity).select(F.concat_ws("-", F.lit("f"), "item", "part").alias("seq"), "item", "part", "n_tokens")]
    level, total = 0, rest.agg(F.sum("n_tokens")).first()[0] or 0
    while total:
        bins = -(-total // (bin_windows * capacity))
        dealt = rest.withColumn("bin", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(bins)))
        packed = materialise(map_group(spread(dealt, "bin"), ["bin"], _pack_bin(capacity, bins == 1), _ITEMS), "packed")
        done.append(packed.where("seq >= 0").select(F.concat_ws("-", F.lit(level), "bin", "seq").alias("seq"), "item", "part", "n_tokens"))
        if bins == 1:
            break
        rest = packed.where("seq < 0").select("item", "part", "n_tokens", F.xxhash64("item", "part").alias("h"))
        level, total = level + 1, rest.agg(F.sum("n_tokens")).first()[0] or 0
    rows = functools.reduce(DataFrame.unionAll, done)
    return rows.select(F.col("seq").alias("seq_id"), F.col("item").alias("doc_id"), "part", (F.col("part").cast("long") * capacity).alias("first_token"), "n_tokens")


def unused_space(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequences, least_possible, tokens, unused_share, fullest`` of a packing."""
    per = packed.groupBy("seq_id").agg(F.sum("n_tokens").alias("n"))
    n, total = F.count("*"), F.sum("n")
    return per.agg(n.alias("sequences"), F.ceil(total / capacity).alias("least_possible"), total.alias("tokens"), (1 - total / (n * capacity)).alias("unused_share"), F.max("n").alias("fullest"))
