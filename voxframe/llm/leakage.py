"""Held-out evaluation passages inside a training corpus (problem 7).

Latent semantic retrieval, then exact checks:

1. Words are runs of letters and digits in one form, without case; each is a
   32-bit hash. They are computed once and written to the shared folder.
2. A randomised SVD of the TF-IDF matrix of all passages (blocks of words of all
   documents; hashed vocabulary) is computed in distributed passes: each task adds
   its part of A'AX, the small sketch is orthonormalised on the driver, and a
   second pass rotates it to the leading singular vectors.
3. Windows of all documents, on a grid, are held against windows of the items, on
   a grid of their own, by cosine in that space. An index of the item windows in
   clusters passes by what the triangle inequality of angles rules out, and
   nothing else. ``leaks`` takes windows of 9 words; where the items' grid is too
   coarse for a window of theirs to lie within the cosine of a neighbour on it,
   that window is put in as well, so every run that counts has a candidate.
   ``paraphrases`` takes windows about as long as the item.
4. For verbatim leaks, the run of equal words around a candidate is measured. For
   paraphrases, the longest common subsequence of the item and a stretch that
   holds the candidate, of twice the item's length, and the share of the item's
   answers (numbers, and the rarest words that the corpus has) in it make a score.

Items are taken in blocks of a bounded number of words, one pass over the
documents' words for each; an item of more words is searched in pieces that
overlap by a run. Null and empty texts have no words and leak nothing; items
without words match nothing. Equal rows give a pair once.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.arrow import map_batches, map_group
from voxframe.llm import textform
from voxframe.operators.storage import fill_cores, materialise

#: Hashed vocabulary, words of a passage, kept dimensions, extra ones of the sketch.
BUCKETS, PASSAGE, DIMENSIONS, EXTRA = 1 << 14, 16, 64, 16
#: Words of a window, and the step of the windows of documents and of items.
WINDOW, DOC_STEP, ITEM_STEP = 9, 4, 2
#: Least cosine of a candidate of a verbatim leak, and of a paraphrase.
COSINE, NEAR = 0.9, 0.75
#: Words of items that are searched in one pass, and of an item's piece.
BLOCK_WORDS, PIECE_WORDS = 1_000_000, 100_000
#: Windows that are held against the index at once, and words of a document that are summed at once.
CHUNK = 1 << 15
#: Words whose passages are projected at once, few enough for the cache.
FIT_WORDS = 16_000
#: Rarest words that are answers of an item; weight of the answers in the score; least score of a paraphrase.
RAREST, ANSWERS, SCORE = 3, 0.15, 0.55
_CHUNKS, FAN, TASKS = 64, 64, 4
_PAIR = "doc_id long, item_id long"
# Words in text without characters that need folding; these hide none of a word's letters.
_WORD = re.compile(r"[^\W_]+")
_UNUSUAL = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿА-Яа-яЁё«»“”„–—…]")
_RUSSIAN = re.compile(r"[бвгджзийклмнптфцчшщъыьэюя]", re.IGNORECASE)
_TWINS = set("ABCEHKMOPTXYАВСЕНКМОРТХУІЅЈ")


def _key(word: str) -> str:
    """A word in one form and lower case; one that consists of look-alike letters alone is read in Latin."""
    if not word.isascii():
        word = unicodedata.normalize("NFC", textform.one_word(unicodedata.normalize("NFD", word), _RUSSIAN.search(word) is not None))
    up = word.upper()
    return up.translate(textform.TO_LATIN).lower() if set(up) <= _TWINS else word.lower()


def _hash(word: str) -> int:
    h = 2166136261
    for b in word.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


_HASHES: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    """Runs of letters and digits as written, once what can't be seen is gone and accents are composed."""
    if _UNUSUAL.search(text):
        text = unicodedata.normalize("NFC", textform.fold(text))
    return _WORD.findall(text)


def word_hashes(text: str | None) -> list[int]:
    """32-bit hashes of a text's words in order."""
    if not text:
        return []
    if len(_HASHES) > 1 << 20:
        _HASHES.clear()
    words = words_of(text)
    try:
        return [_HASHES[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _HASHES:
                _HASHES[w] = _hash(_key(w))
        return [_HASHES[w] for w in words]


def hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, words`` of rows with words."""

    def run(b: pa.RecordBatch) -> dict:
        return {key: b.column(key), "words": [word_hashes(t) for t in b.column(text).to_pylist()]}

    rows = df.select(F.col(key).cast("long").alias(key), text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return map_batches(fill_cores(rows), run, f"{key} long, words array<int>").where("size(words) > 0")


# ---- the latent space


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words of a batch end to end, and the row of each."""
    words = batch.column("words")
    sizes = np.diff(words.offsets.to_numpy())
    values = words.flatten().to_numpy(zero_copy_only=False)
    return values, np.repeat(np.arange(len(sizes)), sizes)


def _buckets(words: np.ndarray) -> np.ndarray:
    return (words.astype(np.int64) & (BUCKETS - 1)).astype(np.int64)


def _passages(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of the passage of each word: blocks of ``PASSAGE`` words within a row."""
    if not len(words):
        return row
    first = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
    at = np.arange(len(words)) - np.repeat(first, np.diff(np.r_[first, len(words)]))
    new = (at % PASSAGE == 0).astype(np.int64)
    return np.cumsum(new) - 1


def _partials(docs: DataFrame, each, width: int) -> np.ndarray:
    """Sum over all documents of ``each(words, row) -> (BUCKETS, width)``; one partial a partition."""
    rows = BUCKETS // _CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, width), dtype=np.float64)
        for b in batches:
            if b.num_rows:
                total += each(*_flat(b))
        if total.any():
            parts = total.astype(np.float32).reshape(_CHUNKS, rows * width)
            own = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(_CHUNKS), pa.int32()), "branch": pa.array([own] * _CHUNKS, pa.int64()), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

    def add(group: dict) -> dict:
        total = np.zeros(rows * width, dtype=np.float64)
        for p in group["part"]:
            total += np.frombuffer(p, dtype=np.float32)
        return {"chunk": group["chunk"][:1], "branch": group["branch"][:1], "part": [total.astype(np.float32).tobytes()]}

    kind = "chunk int, branch long, part binary"
    # Tasks of several partitions each, a few for each core, so that sketches don't grow with the corpus.
    branches = min(docs.rdd.getNumPartitions(), TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    sums = docs.coalesce(branches).mapInArrow(run, kind)
    while branches > 1:  # a tree, so that no task adds more than FAN parts
        sums = map_group(sums.withColumn("branch", F.floor(F.col("branch") / FAN)), ["chunk", "branch"], add, kind)
        branches = -(-branches // FAN)
    out = np.zeros((_CHUNKS, rows * width))
    for r in sums.collect():  # BUCKETS x width numbers, whatever the corpus
        out[r["chunk"]] = np.frombuffer(bytes(r["part"]), dtype=np.float32)
    return out.reshape(BUCKETS, width)


def fit(docs: DataFrame, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """IDF of each bucket and its IDF-weighted latent vector ``(BUCKETS, DIMENSIONS)``, from all passages of ``docs``."""
    spark = docs.sparkSession

    def count(words: np.ndarray, row: np.ndarray) -> np.ndarray:
        pairs = np.unique(_passages(words, row) * BUCKETS + _buckets(words))
        seen = np.bincount(pairs % BUCKETS, minlength=BUCKETS).astype(np.float64)
        total = np.zeros((BUCKETS, 2))
        total[:, 0] = seen
        total[0, 1] = len(np.unique(pairs // BUCKETS))
        return total

    counts = _partials(docs, count, 2)
    n = max(1.0, counts[:, 1].sum())
    idf = np.log((n + 1) / (counts[:, 0] + 1)) + 1
    x = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS + EXTRA))
    x, _ = np.linalg.qr(x)

    def gram(x: np.ndarray) -> np.ndarray:
        """A'AX over all passages, these of unit length."""
        shared = spark.sparkContext.broadcast(((x * idf[:, None]).astype(np.float32), (idf**2).astype(np.float32)))

        def each(words: np.ndarray, row: np.ndarray) -> np.ndarray:
            scaled, square = shared.value
            total = np.zeros(scaled.shape)
            edge = np.r_[0, np.flatnonzero(np.diff(row)) + 1, len(words)]
            cuts = np.unique(np.r_[edge[np.searchsorted(edge, np.arange(0, len(words), FIT_WORDS))], len(words)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                p, k = _passages(words[a:b], row[a:b]), _buckets(words[a:b])
                start = np.r_[0, np.flatnonzero(np.diff(p)) + 1]
                projected = np.add.reduceat(scaled[k], start, axis=0)
                projected /= np.add.reduceat(square[k], start)[:, None]
                order = np.argsort(k, kind="stable")
                own = k[order]
                at = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
                total[own[at]] += np.add.reduceat(projected[p[order]], at, axis=0)
            return total

        return _partials(docs, each, DIMENSIONS + EXTRA) * idf[:, None]

    q, _ = np.linalg.qr(gram(x))
    z = gram(q)
    small = q.T @ z
    _, u = np.linalg.eigh((small + small.T) / 2)
    v = q @ u[:, ::-1][:, :DIMENSIONS]
    return idf, (v * idf[:, None]).astype(np.float32)


# ---- the index


def shape(n: int, run: int) -> tuple[int, int]:
    """Width and step of document windows, one of which lies whole in each run of ``min(run, n)`` words."""
    least = min(run, n)
    return (min(WINDOW, least - DOC_STEP + 1), DOC_STEP) if least >= DOC_STEP else (least, 1)


def _units(words: np.ndarray, starts: np.ndarray, width: int, vectors: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows at ``starts``."""
    bucket = _buckets(words)
    total = vectors[bucket[starts]]
    for i in range(1, width):
        total += vectors[bucket[starts + i]]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)


def _grid(text: np.ndarray, width: int, vectors: np.ndarray, cosine: float, fill: bool = True) -> np.ndarray:
    """Starts of an item's windows: each ``ITEM_STEP``, the last, and those that no neighbour among these comes near to."""
    n = len(text) - width + 1
    on = np.zeros(n, dtype=bool)
    on[::ITEM_STEP] = on[-1] = True
    if fill and n > 1:
        x = _units(text, np.arange(n), width, vectors)
        beside = np.einsum("ij,ij->i", x[1:], x[:-1])
        near = np.where(on, 1.0, 0.0)
        near[1:] = np.maximum(near[1:], np.where(on[:-1], beside, 0.0))
        near[:-1] = np.maximum(near[:-1], np.where(on[1:], beside, 0.0))
        on |= near < cosine + 1e-4
    return np.flatnonzero(on)


class Index:
    """Unit vectors in clusters; finds all of a least cosine to others by the triangle inequality of angles."""

    def __init__(self, x: np.ndarray, cosine: float, rounds: int = 4):
        self.cosine = cosine
        k = max(1, min(len(x), int(2 * np.sqrt(len(x)))))
        centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
        for _ in range(rounds):
            own = np.concatenate([(x[a : a + CHUNK] @ centres.T).argmax(axis=1) for a in range(0, len(x), CHUNK)])
            order = np.argsort(own, kind="stable")
            ids, first = np.unique(own[order], return_index=True)
            centres = np.add.reduceat(x[order], first, axis=0)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        self.centres, edges = centres.astype(np.float32), np.r_[first, len(x)]
        self.members = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.held = [x[m].astype(np.float32) for m in self.members]
        reach = np.arccos(np.clip(cosine, -1, 1))
        widest = [np.arccos(np.clip((h @ c).min(), -1, 1)) for h, c in zip(self.held, self.centres, strict=True)]
        self.bound = np.array([np.cos(min(np.pi, w + reach)) for w in widest]) - 1e-4

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``x``, indexed vector) of at least the cosine."""
        close = x @ self.centres.T >= self.bound
        rows, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for c, (members, held) in enumerate(zip(self.members, self.held, strict=True)):
            at = np.flatnonzero(close[:, c])
            if len(at):
                i, j = np.nonzero(x[at] @ held.T >= self.cosine)
                rows.append(at[i])
                found.append(members[j])
        return np.concatenate(rows), np.concatenate(found)


class _Windows:
    """The indexed windows of one shape over a block's items, laid end to end."""

    def __init__(self, texts: list[np.ndarray], own: list[int], width: int, step: int, vectors: np.ndarray, cosine: float, fill: bool):
        self.width, self.step = width, step
        self.words = np.concatenate([texts[k] for k in own])
        size = np.array([len(texts[k]) for k in own])
        self.low = np.cumsum(size) - size  # where each item begins
        starts = [_grid(texts[k], width, vectors, cosine, fill) for k in own]
        self.item = np.repeat(np.arange(len(own)), [len(s) for s in starts])
        self.at = np.concatenate([s + low for s, low in zip(starts, self.low, strict=True)])
        self.high, self.own = self.low + size, np.array(own)
        self.index = Index(_units(self.words, self.at, width, vectors), cosine)

    def equal(self, values: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """``(start, item, place)`` where a candidate's window equals the item's at its place or beside it."""
        item, at = self.item[j], self.at[j]
        for shift in range(1 - ITEM_STEP, ITEM_STEP):
            q, p, k = at + shift, starts[i], item
            ok = (q >= self.low[k]) & (q + self.width <= self.high[k])
            q, p, k = q[ok], p[ok], k[ok]
            for m in range(self.width):
                ok = values[p + m] == self.words[q + m]
                q, p, k = q[ok], p[ok], k[ok]
            yield from zip(p.tolist(), k.tolist(), q.tolist(), strict=True)


def _starts(row: np.ndarray, first: np.ndarray, width: int, step: int) -> np.ndarray:
    """Starts of windows of ``width`` each ``step`` words of a row, for rows end to end."""
    at = np.arange(max(0, len(row) - width + 1))
    return at[((at - first[row[at]]) % step == 0) & (row[at] == row[at + width - 1])]


def _run_around(doc: np.ndarray, item: np.ndarray, p: int, q: int) -> int:
    """Length of the run of equal words through ``doc[p]`` and ``item[q]``."""
    a = 0
    while p - a > 0 and q - a > 0 and doc[p - a - 1] == item[q - a - 1]:
        a += 1
    b = 0
    while p + b < len(doc) and q + b < len(item) and doc[p + b] == item[q + b]:
        b += 1
    return a + b


def windows_of(texts: list[np.ndarray], run: int, vectors: np.ndarray, cosine: float = COSINE, fill: bool = True) -> list[_Windows]:
    """The index of a block of items, by shape of window."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(texts):
        shapes.setdefault(shape(len(t), run), []).append(k)
    return [_Windows(texts, own, width, step, vectors, cosine, fill) for (width, step), own in sorted(shapes.items())]


def found_in(values: np.ndarray, row: np.ndarray, index: list[_Windows], texts: list[np.ndarray], run: int, vectors: np.ndarray) -> set[tuple[int, int]]:
    """``(row, item)`` of verbatim leaks in documents end to end."""
    out: set[tuple[int, int]] = set()
    first = np.searchsorted(row, np.arange(int(row[-1]) + 2)) if len(row) else np.zeros(1, dtype=np.int64)
    for w in index:
        starts = _starts(row, first, w.width, w.step)
        for a in range(0, len(starts), CHUNK):
            part = starts[a : a + CHUNK]
            i, j = w.index.near(_units(values, part, w.width, vectors))
            for p, k, q in w.equal(values, part, i, j):
                d, item = int(row[p]), int(w.own[k])
                text = texts[item]
                if (d, item) not in out and _run_around(values[first[d] : first[d + 1]], text, p - int(first[d]), q - int(w.low[k])) >= min(run, len(text)):
                    out.add((d, item))
    return out


# ---- longest common subsequences


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    return _in_common(_places(a), len(a), b)


def _places(a: list[int]) -> dict[int, int]:
    """The places of each word, as bits."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    return at


def _in_common(at: dict[int, int], n: int, b: list[int]) -> int:
    full = (1 << n) - 1
    v = full
    for y in b:
        if y in at:
            u = v & at[y]
            v = ((v + u) | (v - u)) & full
    return (full & ~v).bit_count()


def _best_stretch(doc: list[int], own: np.ndarray, begins: np.ndarray, at: dict[int, int], n: int, least: int) -> tuple[int, int]:
    """Greatest common subsequence with a stretch of twice ``n`` words at one of ``begins``, of at least ``least``, and its begin; ``own``: how many of the item's words come before each place."""
    length, best, where, b, need = min(2 * n, len(doc)), 0, -1, 0, least
    while b < len(begins) and need <= n:
        begin = int(begins[b])
        common = _in_common(at, n, doc[begin : begin + length])
        if common >= need:
            best, where, need = common, begin, common + 1
            b += 1
        else:
            # A word that enters adds one at most, so the next to reach it has as many of the item's words more.
            b = max(b + 1, int(np.searchsorted(begins, np.searchsorted(own, own[begin + length] + need - common) - length)))
    return best, where


# ---- the items


def _pieces(items: DataFrame, run: int | None) -> DataFrame:
    """``item_id, part, words`` of items with words, each once; long ones in pieces that overlap by a run less one."""
    rows = hashed(items, "item_id", "text").distinct()
    if run is None:
        return rows.select("item_id", F.lit(0).alias("part"), "words")
    step = PIECE_WORDS - run + 1
    begins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - run), F.lit(step))
    return rows.select("item_id", F.explode(begins).alias("part"), "words").withColumn("words", F.slice("words", F.col("part") + 1, PIECE_WORDS))


def blocks(pieces: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[int, np.ndarray]]]:
    """``(item_id, words)`` of items in blocks of about ``most`` words; only one block is with the driver at a time."""
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // most)
    h = F.pmod(F.xxhash64("item_id", "part"), F.lit(max(1, n)))
    for b in range(n):
        own = pieces if n == 1 else pieces.where(h == b)
        if got := sorted((r["item_id"], tuple(r["words"])) for r in own.collect()):
            yield [(i, np.array(w, dtype=np.int32)) for i, w in dict.fromkeys(got)]


def _documents(documents: DataFrame) -> DataFrame:
    return materialise(hashed(documents, "doc_id", "text"), "leak_words")


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, cosine: float = COSINE, block: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id``: the document holds ``run`` consecutive words of the item, or all of a shorter one."""
    spark = documents.sparkSession
    pieces = _pieces(items, run)
    if pieces.isEmpty():
        return spark.createDataFrame([], _PAIR)
    docs = _documents(documents)
    _, vectors = fit(docs)
    found = []
    for held in blocks(materialise(pieces, "leak_items"), block):
        ids, texts = [i for i, _ in held], [t for _, t in held]
        found.append(_leaks_of(docs, spark.sparkContext.broadcast((vectors, windows_of(texts, run, vectors, cosine), ids, texts)), run))
    return functools.reduce(DataFrame.unionAll, found).distinct()


def _leaks_of(docs: DataFrame, shared, run: int) -> DataFrame:
    def look(b: pa.RecordBatch) -> dict:
        vectors, index, ids, texts = shared.value
        values, row = _flat(b)
        doc_ids = b.column("doc_id").to_pylist()
        found = {(doc_ids[d], ids[k]) for d, k in found_in(values, row, index, texts, run, vectors)}
        return {"doc_id": [d for d, _ in found], "item_id": [i for _, i in found]}

    return map_batches(docs, look, _PAIR)


# ---- paraphrases


def ladder(n: int) -> int:
    """Width of the document windows that an item of ``n`` words is held against: the nearest of 2, 3, 4, 6, 8, 12 and so on."""
    low = 1 << max(1, n.bit_length() - 1)
    return min((low, low * 3 // 2, low * 2), key=lambda w: abs(w - n)) if n > 1 else 1


class _Wholes:
    """Items of one width of window, by the vectors of their whole texts."""

    def __init__(self, texts: list[np.ndarray], own: list[int], width: int, vectors: np.ndarray, cosine: float):
        self.width, self.step, self.own = width, max(1, width // 4), np.array(own)
        total = np.stack([vectors[_buckets(texts[k])].sum(axis=0) for k in own])
        self.index = Index(total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12), cosine)

    def near(self, sums: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, places of their windows and items near these, by the running sums of the vectors of pieces that begin at ``low``."""
        width = np.minimum(self.width, size)
        n = (size - width + self.step - 1) // self.step + 1
        piece = np.repeat(np.arange(len(low)), n)
        at = np.minimum((np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)) * self.step, (size - width)[piece]) + low[piece]
        out = []
        for a in range(0, len(at), CHUNK):
            part = at[a : a + CHUNK]
            x = sums[part + width[piece[a : a + CHUNK]]] - sums[part]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            i, j = self.index.near(x.astype(np.float32))
            out.append((piece[a + i], part[i], self.own[j]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def wholes_of(texts: list[np.ndarray], vectors: np.ndarray, cosine: float = NEAR) -> list[_Wholes]:
    widths: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        widths.setdefault(ladder(len(t)), []).append(k)
    return [_Wholes(texts, own, width, vectors, cosine) for width, own in sorted(widths.items())]


def _near_items(values: np.ndarray, first: np.ndarray, index: list[_Wholes], vectors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Documents (which begin at ``first``), items and the sorted places of windows near to these, by document."""
    widest = max(w.width for w in index)
    pieces = [(d, a, min(a + CHUNK + widest, int(first[d + 1]))) for d in range(len(first) - 1) for a in range(int(first[d]), max(int(first[d]) + 1, int(first[d + 1]) - widest), CHUNK)]
    i = 0
    while i < len(pieces):
        e = i + 1
        # The pieces of a document stay together.
        while e < len(pieces) and (pieces[e][2] - pieces[i][1] <= 2 * CHUNK or pieces[e][0] == pieces[e - 1][0]):
            e += 1
        doc, low, high = (np.array(c) for c in zip(*pieces[i:e], strict=True))
        found = []
        for g in range(0, len(doc), max(1, len(doc) if high[-1] - low[0] <= 2 * CHUNK else 1)):
            h = len(doc) if high[-1] - low[0] <= 2 * CHUNK else g + 1
            base = int(low[g])
            sums = np.zeros((int(high[h - 1]) - base + 1, vectors.shape[1]))
            np.cumsum(vectors[_buckets(values[base : int(high[h - 1])])], axis=0, out=sums[1:])
            for w in index:
                piece, at, item = w.near(sums, low[g:h] - base, high[g:h] - low[g:h])
                found.append((doc[g + piece], item, at + base))
        d, k, at = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((at, k, d))
        d, k, at = d[order], k[order], at[order]
        edges = np.r_[0, np.flatnonzero((np.diff(d) != 0) | (np.diff(k) != 0)) + 1, len(d)] if len(d) else np.zeros(1, dtype=np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(d[a]), int(k[a]), at[a:b] - first[d[a]]
        i = e


def _scored(doc: np.ndarray, own: np.ndarray, text: np.ndarray, at: dict[int, int], answers: np.ndarray, near: np.ndarray, width: int) -> tuple[float, float] | None:
    """Share of the item in common with the best stretch that holds a window at one of the sorted places ``near``, and share of its answers there; ``own``: how many of the item's words come before each place."""
    n = len(text)
    least = int(np.ceil(n * (SCORE - ANSWERS) / (1 - ANSWERS) - 1e-9))
    length = min(2 * n, len(doc))
    # Begins of stretches that hold a whole window, as bounds of their runs.
    low, high = np.maximum(near + min(width, len(doc)) - length, 0), np.minimum(near, len(doc) - length)
    lo, hi = int(low[0]), int(high[-1]) + length
    if own[hi] - own[lo] < least:
        return None
    part, own = doc[lo:hi], own[lo : hi + 1]
    if hi - lo == length:
        begins = np.zeros(1, dtype=np.int64)
    else:
        mark = np.zeros(hi - lo - length + 2, dtype=np.int64)
        np.add.at(mark, low - lo, 1)
        np.add.at(mark, high - lo + 1, -1)
        begins = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    begins = begins[own[begins + length] - own[begins] >= max(1, least)]
    if not len(begins):
        return None
    words = part.tolist()
    common, begin = _best_stretch(words, own, begins, at, n, max(1, least))
    if begin < 0:
        return None
    held = len(set(answers.tolist()).intersection(words[begin : begin + length])) / len(answers) if len(answers) else common / n
    return common / n, held


def paraphrases(documents: DataFrame, items: DataFrame, cosine: float = NEAR, score: float = SCORE, block: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, common, answers``: stretches that say an item otherwise.

    ``common``: the greatest share of the item's words that a stretch holds in their order; ``answers``: the share of the
    item's answers there. A pair counts where 0.85 of the one and 0.15 of the other reach ``score``.
    """
    spark = documents.sparkSession
    kind = f"{_PAIR}, common double, answers double"
    pieces = _pieces(items, None)
    if pieces.isEmpty():
        return spark.createDataFrame([], kind)
    docs = _documents(documents)
    _, vectors = fit(docs)
    numbers, found = _numbers(items), []
    for held in blocks(materialise(pieces, "paraphrase_items"), block):
        ids, texts = [i for i, _ in held], [t for _, t in held]
        answers = _answers(docs, numbers, texts)
        shared = spark.sparkContext.broadcast((vectors, wholes_of(texts, vectors, cosine), ids, texts, answers))
        found.append(_paraphrases_of(docs, shared, score, kind))
    best = F.max(F.struct("common", "answers")).alias("b")
    return functools.reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.common", "b.answers")


def _paraphrases_of(docs: DataFrame, shared, score: float, kind: str) -> DataFrame:
    def look(b: pa.RecordBatch) -> dict:
        vectors, index, ids, texts, answers = shared.value
        width = {int(k): w.width for w in index for k in w.own}
        places: dict[int, dict[int, int]] = {}
        words: dict[int, np.ndarray] = {}
        vocabulary = np.unique(np.concatenate(texts))
        mine = np.zeros(len(vocabulary) + 1, dtype=bool)
        out: dict[str, list] = {"doc_id": [], "item_id": [], "common": [], "answers": []}
        values, row = _flat(b)
        doc_ids = b.column("doc_id").to_pylist()
        first = np.searchsorted(row, np.arange(len(doc_ids) + 1))
        word = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        word[vocabulary[word] != values] = len(vocabulary)
        for d, k, near in _near_items(values, first, index, vectors):
            if k not in places:
                places[k] = _places(texts[k].tolist())
                words[k] = np.searchsorted(vocabulary, np.unique(texts[k]))
            here = slice(first[d], first[d + 1])
            mine[words[k]] = True
            own = np.zeros(first[d + 1] - first[d] + 1, dtype=np.int64)
            mine[word[here]].cumsum(out=own[1:])
            mine[words[k]] = False
            got = _scored(values[here], own, texts[k], places[k], answers[k], near, width[k])
            if got and (1 - ANSWERS) * got[0] + ANSWERS * got[1] >= score - 1e-9:
                for column, x in zip(out.values(), (doc_ids[d], ids[k], *got), strict=True):
                    column.append(x)
        return out

    return map_batches(docs, look, kind)


def _document_counts(docs: DataFrame, words: np.ndarray) -> np.ndarray:
    """Documents that each of the sorted ``words`` of a block stands in."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(b: pa.RecordBatch) -> dict:
        values, row = _flat(b)
        at = np.minimum(np.searchsorted(shared.value, values), len(shared.value) - 1)
        own = shared.value[at] == values
        n = np.bincount(np.unique(row[own] * len(shared.value) + at[own]) % len(shared.value), minlength=len(shared.value))
        seen = np.flatnonzero(n)
        return {"word": pa.array(seen), "n": pa.array(n[seen])}

    out = np.zeros(len(words), dtype=np.int64)
    for r in map_batches(docs, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out


def _numbers(items: DataFrame) -> DataFrame:
    """``word``: the hashes of the items' words with digits."""

    def digits(b: pa.RecordBatch) -> dict:
        found = {h for t in b.column("text").to_pylist() for w, h in zip(words_of(t), word_hashes(t), strict=True) if any(c.isdigit() for c in w)}
        return {"word": sorted(found)}

    return map_batches(items.select("text").where("text is not null"), digits, "word int").distinct()


def _answers(docs: DataFrame, numbers: DataFrame, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each item of a block, the numbers and the ``RAREST`` rarest words among those that stand in some document."""
    words = np.unique(np.concatenate(texts))
    spark = docs.sparkSession
    own = spark.createDataFrame([(int(w),) for w in words], "word int")
    digits = {r["word"] for r in numbers.join(own, "word", "left_semi").collect()}
    counts = dict(zip(words.tolist(), _document_counts(docs, words).tolist(), strict=True))
    out = []
    for text in texts:
        there = [w for w in dict.fromkeys(text.tolist()) if counts[w]]
        chosen = {w for w in there if w in digits} | set(sorted(there, key=counts.__getitem__)[:RAREST])
        out.append(np.array(sorted(chosen), dtype=np.int32))
    return out
