"""Sentence units of documents in many languages and scripts (problem 8).

Each character of a line is tagged as the last of a unit or as inside one, by a
linear-chain model decoded with Viterbi. A character that ends no terminator,
closer or divider has no way to the boundary tag; a line break always has one.
The others ("candidates") are described by what stands there: the mark, the token
before it and its shape, the token before that, the kind of character that
follows, the state of quotes and brackets, the script.

The labels come from the documents themselves. The lines of a sample are put
together as one text for each script, without line breaks and, where a script needs no
punctuation, with nothing but a blank between them; a candidate at which a line
or text ended is known to be a boundary, any other may be one or not. The model's weights
maximise the likelihood of the breaks seen, given that a writer breaks the line
after a share of the sentence ends only. That share is estimated for each script
(the mean of the fitted break probabilities at the breaks). So abbreviations,
initials, ordinals, decimals, list marks and quotations are learnt from where no
line ever breaks. For scripts written without blanks, stripped lines are added in
which a blank stands for each mark, a boundary where that mark was a full stop.

Null and empty texts have no units; white space belongs to none. Very long texts
are decoded line by line. Equal texts give equal units under each id; an id that
comes twice with one text gives its units once.
"""

from __future__ import annotations

import bisect
import functools
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.arrow import map_batches
from voxframe.llm.textform import _FOLD, canonical
from voxframe.operators.storage import fill_cores

#: Most documents of the training sample, and most weights that are broadcast.
SAMPLE, MAX_WEIGHTS = 4000, 200_000
#: Lines that are put together for training, and candidates of a chain; least count of a feature; pull of weights to 0; steps of a fit.
LINES, CHAIN, SEEN, PULL, STEPS, QUANTILE = 12, 12, 8, (0.3, 2.0), 60, 0.1

_OPENERS, _CLOSERS = "«„“‘\"「『（([{《〈【", "»”’\"」』）)]}》〉】"
_PAIRS = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}", "《": "》", '"': '"'}
_FULL = "。！？｡"  # need no blank after them
_BRAHMIC = "।॥"
_END = ".!?…؟۔" + _FULL + _BRAHMIC
_LINE = regex.compile(r"[^\n\r\u2028\u2029\x0b\x0c\x85]+")
_MARK = regex.compile(r"\s*(?:[-*•–—#>]+\s*)?\d{1,9}[.)](?=\s)")
_UNSPACED = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_UNSPACED_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_BLANK_RUN = regex.compile(r"(?<=\S)\s+(?=\S)")


@functools.lru_cache(1 << 15)
def _known(token: str) -> str:
    ru = regex.search(r"[а-яё]", token, regex.IGNORECASE) is not None
    return canonical(token, "ru" if ru else "en")


_UNSEEN = "\0"
_FLAT = {c: _UNSEEN if to is None else to for c, to in _FOLD.items() if to is None or len(to) == 1} | {ord(c): c for c in "！？｡"}
_QUOTE = regex.compile(f"[{regex.escape(_OPENERS + _CLOSERS)}]")
_STOPS = regex.compile(f"[{regex.escape(_END)}][{regex.escape(_END)}{_UNSEEN}]*")


def _flat(line: str) -> str:
    """Each character in a plain form of one character; NUL for one that can't be seen."""
    return line if line.isascii() else line.translate(_FLAT)


def _quotes(flat: str) -> tuple[list[int], list[int], dict[int, int]]:
    """Positions at which the depth of closed pairs changes, the depth from each on, and the opener of each closer."""
    opener_of: dict[int, int] = {}
    stack: list[int] = []
    for m in _QUOTE.finditer(flat):
        i, ch = m.start(), m[0]
        if stack and ch in _PAIRS[flat[stack[-1]]]:
            opener_of[i] = stack.pop()
        elif ch in _PAIRS:
            stack.append(i)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if ch in _PAIRS[flat[stack[k]]]:
                    opener_of[i] = stack[k]
                    del stack[k:]
                    break
    at, depth, level = [-1], [0], 0
    for i, change in sorted([(o, 1) for o in opener_of.values()] + [(c, -1) for c in opener_of]):
        level += change
        at.append(i)
        depth.append(level)
    return at, depth, opener_of


def _gap(ch: str) -> bool:
    return ch == _UNSEEN or ch.isspace()


def _before(flat: str, i: int) -> tuple[str, str]:
    """The token that ends before ``i`` and the token before that."""
    j = i
    while j > 0 and not flat[j - 1].isspace() and flat[j - 1] not in _OPENERS:
        j -= 1
    token = flat[j:i]
    while j > 0 and _gap(flat[j - 1]):
        j -= 1
    k = j
    while k > 0 and not flat[k - 1].isspace() and flat[k - 1] not in _OPENERS:
        k -= 1
    return token.replace(_UNSEEN, ""), flat[k:j].replace(_UNSEEN, "")


_SCRIPTS = (("cyrillic", regex.compile(r"\p{Cyrillic}")), ("han", _UNSPACED_HAN), ("unspaced", _UNSPACED), ("devanagari", regex.compile(r"\p{Devanagari}")), ("arabic", regex.compile(r"\p{Arabic}")))


@functools.lru_cache(1 << 12)
def _script(ch: str) -> str:
    return next((name for name, of in _SCRIPTS if of.match(ch)), "latin")


def _script_before(line: str, i: int) -> str:
    """Script of the nearest letter before ``i``."""
    while i > 0:
        i -= 1
        if line[i].isalpha():
            return _script(line[i])
    return "latin"


def _shape(token: str) -> str:
    if not token:
        return "none"
    if token.isdigit():
        return f"digits{min(3, len(token))}"
    last = token.rsplit(".", 1)[-1]
    if len(last) == 1 and last.isalpha():
        return "upper1" if last.isupper() else "lower1" if last.islower() else "letter1"
    if "." in token:
        return "dotted"
    return f"{'Word' if token[0].isupper() else 'word'}{min(5, len(token))}"


@functools.lru_cache(1 << 16)
def _words_before(token: str, earlier: str) -> tuple[str, str, str]:
    """Token before a stop in lower case, its shape, and of the one before it what tells: itself, or that it is a number."""
    token = _known(token).strip("(")
    before = _known(earlier).lower()
    return token.lower(), _shape(token), "9" if before[-1:].isdigit() else before


def _next_kind(flat: str, i: int) -> tuple[str, bool]:
    """Kind of what follows ``i`` and whether a blank comes first."""
    blank, n, opened = False, len(flat), False
    while i < n:
        ch = flat[i]
        if ch == _UNSEEN:
            pass
        elif ch.isspace():
            blank = True
        elif ch in "-–—":
            return "dash", blank
        elif ch in _OPENERS and (ch != '"' or blank or opened):
            opened = True
        elif ch.isdigit():
            return "digit", blank
        elif ch.isalpha():
            return ("lower" if ch.islower() else "upper" if ch.isupper() or ch.istitle() else "opened" if opened else "letter"), blank
        elif not (ch in "*_#" and blank):
            return "mark", blank
        i += 1
    return "end", blank


def candidates(line: str) -> list[tuple[int, tuple[str, ...]]]:
    """Positions that may end a unit, with their description ``(mark, next, quotes, script, token, shape, token before)``."""
    flat = _flat(line)
    at, depth, opener_of = _quotes(flat)
    m = _MARK.match(line)
    mark_end = m.end() if m else 0
    out, i, n = [], 0, len(flat)
    for stop in _STOPS.finditer(flat):
        start, j = stop.span()
        if start < i:
            continue  # among the closers of the stop before
        run = stop[0]
        mark = "full" if any(c in _FULL for c in run) else "danda" if any(c in _BRAHMIC for c in run) else "ask" if any(c in "!?؟" for c in run) else "more" if "…" in run or ".." in run else "stop"
        if mark in ("stop", "ask") and j < n and flat[j].isalnum():
            continue  # within a word or number
        quotes, k = "out", j
        while k < n and opener_of:  # closers that follow, a blank before a guillemet allowed
            c = k
            while c < n and _gap(flat[c]):
                c += 1
            if c < n and c in opener_of and (c == k or flat[c] == "»" or flat[k:c].strip(_UNSEEN) == ""):
                o = opener_of[c] - 1
                while o >= 0 and (_gap(flat[o]) or flat[o] in "-–—*#>" or o < mark_end):
                    o -= 1
                quotes = "led" if o >= 0 and flat[o] == ":" else "own" if o < 0 or flat[o] in _END or flat[o] in _CLOSERS else "within"
                k = c + 1
            else:
                break
        i = k
        follows, blank = _next_kind(flat, k)
        if opener_of and depth[bisect.bisect_right(at, k - 1) - 1] > 0:
            quotes = "inside"
        if blank or mark == "full" or follows == "end" or (quotes not in ("out", "inside") and k < n and _UNSPACED_HAN.match(line[k])):
            told = ("", "-", "") if mark != "stop" else ("", "opens", "") if start < mark_end else _words_before(*_before(flat, start))
            out.append((k - 1, (mark, follows + ("" if blank else "+"), quotes, _script_before(line, start), *told)))
    if _UNSPACED.search(line):
        for b in _BLANK_RUN.finditer(line):
            left, right = b.start() - 1, b.end()
            while left > 0 and flat[left] == _UNSEEN:
                left -= 1
            while right < n - 1 and flat[right] == _UNSEEN:
                right += 1
            if _UNSPACED.match(line[left]) and _UNSPACED.match(line[right]):
                inside = depth[bisect.bisect_right(at, b.start() - 1) - 1] > 0
                out.append((b.start() - 1, ("blank", "letter", "inside" if inside else "out", _script(line[left]), "", "-", "")))
        out = sorted(dict(out).items())
    return out


# ---- the model


def features(d: tuple[str, ...]) -> list[str]:
    mark, follows, quotes, script, token, shape, before = d
    out = ["b", f"m={mark}", f"f={follows}", f"q={quotes}", f"m={mark} f={follows}", f"m={mark} q={quotes}", f"q={quotes} f={follows}", f"m={mark} q={quotes} f={follows}", f"c={script} m={mark} q={quotes}", f"c={script} m={mark} f={follows}"]
    if mark == "stop":
        out += [f"s={shape}", f"s={shape} f={follows}", f"c={script} s={shape}", f"w={token}", f"w={token} f={follows}", f"w={token} {'9' if before == '9' else '-'} f={follows}"]
        if not shape.lower().startswith("word"):
            out += [f"s={shape} p={before}", f"w={token} p={before}", f"s={shape} p={before} f={follows}"]
    return out


def viterbi(scores: list[float], move: dict[str, float]) -> list[bool]:
    """Best tags of a chain: ``scores`` of the boundary tag, ``move`` between tags (``01`` inside to boundary)."""
    if not scores:
        return []
    m = [[move.get("t00", 0.0), move.get("t01", 0.0)], [move.get("t10", 0.0), move.get("t11", 0.0)]]
    best, back = [m[1][0], m[1][1] + scores[0]], []
    for s in scores[1:]:
        came = [int(best[1] + m[1][t] > best[0] + m[0][t]) for t in (0, 1)]
        best = [best[came[0]] + m[came[0]][0], best[came[1]] + m[came[1]][1] + s]
        back.append(came)
    tags = [int(best[1] > best[0])]
    for came in reversed(back):
        tags.append(came[tags[-1]])
    return [bool(t) for t in reversed(tags)]


def decoder(w: dict[str, float]):
    """Decoding with fixed weights; the scores of descriptions are kept."""
    scores: dict[tuple[str, ...], float] = {}

    def decode(described: list[tuple[str, ...]]) -> list[bool]:
        if len(scores) > 1 << 17:
            scores.clear()
        for d in described:
            if d not in scores:
                scores[d] = sum(w.get(f, 0.0) for f in features(d))
        return viterbi([scores[d] for d in described], w)

    return decode


# ---- training


_OPENING = regex.compile(r"^(?:\s|[-*•–—#>_]+(?=\s|\*)|\d{1,9}[.)](?=\s)|[\[(]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])]?)+")


def joined(lines: list[str]) -> tuple[str, set[int]]:
    """Lines as one text, without the marks that open them, and the places of the characters that each but the last ended with."""
    text, ends = lines[0].rstrip(), set()
    for line in lines[1:]:
        line = _OPENING.sub("", line).strip()
        if line and text:
            ends.add(len(text) - 1)
            text += ("" if _UNSPACED_HAN.match(line[0]) or (text[-1] in _FULL + _CLOSERS and _UNSPACED_HAN.search(text[-3:])) else " ") + line
        else:
            text += line
    return text, ends


def stripped(line: str) -> tuple[str, set[int]]:
    """A line of Han or Kana with a blank for each mark, and the places before the blanks that stand for full stops."""
    out, stops = "", set()
    for m in regex.finditer(r"(\s*\p{P}[\p{P}\s]*)|([^\p{P}]+)", line):
        if m[2]:
            out += m[2].strip()
        elif out:
            if set(m[1]) & set(_FULL):
                stops.add(len(out) - 1)
            out += " "
    return out.rstrip(), stops


def _closed(lines: list[str]) -> Iterable[list[str]]:
    """Up to ``LINES`` lines in a row that end as sentences of their script do; headings and labels stand between them."""
    part: list[str] = []
    for line in lines:
        last = _flat(line).replace(_UNSEEN, "").rstrip()[-1:]
        if last and (last in _END or last in _CLOSERS or _UNSPACED.match(last)):
            part.append(line)
        if part and (len(part) == LINES or part[-1] is not line):
            yield part
            part = []
    if part:
        yield part


Chain = tuple[list[tuple[str, ...]], list[bool], bool]


def training_lines(texts: Iterable[str]) -> list[Chain]:
    """Candidates of the texts, whether a line or text ended at each, and whether all others are known to be inside."""
    out: list[Chain] = []
    by: dict[str, list[str]] = {}
    for text in texts:
        lines = [x for x in _LINE.findall(text) if x.strip()]
        if lines:
            by.setdefault(_script_before(lines[0], len(lines[0])), []).extend(lines)
    for lines in by.values():
        for part in _closed(lines):
            whole, ends = joined(part)
            found = [(i, d) for i, d in candidates(whole) if not d[1].startswith("end")]
            out += [([d for _, d in found[b : b + CHAIN]], [i in ends for i, _ in found[b : b + CHAIN]], False) for b in range(0, len(found), CHAIN)]
        for line in lines:
            if sum(1 for _ in _UNSPACED_HAN.finditer(line)) > len(line) / 2:
                bare, stops = stripped(line)
                at = [i - 1 for i, c in enumerate(bare) if c == " "]
                out += [([("blank", "letter", "out", "stripped", "", "-", "")] * len(at[b : b + CHAIN]), [i in stops for i in at[b : b + CHAIN]], True) for b in range(0, len(at), CHAIN)]
    return [x for x in out if x[0]]


class _Chains:
    """Training chains as arrays: features of each kind of candidate, chains padded to one length, places first."""

    def __init__(self, lines: list[Chain]):
        described = [d for ds, _, _ in lines for d in ds]
        kinds = {d: k for k, d in enumerate(dict.fromkeys(described))}
        count: Counter = Counter()
        for d, n in Counter(described).items():
            for f in features(d):
                count[f] += n
        self.names = [f for f, n in count.items() if n >= SEEN]
        number = {f: k for k, f in enumerate(self.names)}
        self.pull = np.array([PULL[f[0] == "w"] for f in self.names])  # of a word's own features more than of the others
        most = max((len(features(d)) for d in kinds), default=1)
        self.features = np.full((len(kinds), most), len(self.names), dtype=np.int64)  # the last is no feature
        for d, k in kinds.items():
            own = [number[f] for f in features(d) if f in number]
            self.features[k, : len(own)] = own
        n, t = len(lines), max((len(x[0]) for x in lines), default=1)
        self.kind = np.zeros((t, n), dtype=np.int64)
        self.there, self.broke, self.sure = np.zeros((t, n), dtype=bool), np.zeros((t, n), dtype=bool), np.zeros(n, dtype=bool)
        for i, (ds, breaks, sure) in enumerate(lines):
            self.kind[: len(ds), i] = [kinds[d] for d in ds]
            self.there[: len(ds), i] = True
            self.broke[: len(ds), i] = breaks
            self.sure[i] = sure
        scripts = [d[3] for d in kinds]
        self.scripts = sorted(set(scripts))
        self.script = np.array([self.scripts.index(x) for x in scripts] or [0])[self.kind]

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.r_[w, 0.0][self.features].sum(axis=1)[self.kind]

    def gradient(self, each: np.ndarray) -> np.ndarray:
        """Sum over candidates of ``each`` for each feature."""
        kinds = np.bincount(self.kind[self.there], weights=each[self.there], minlength=len(self.features))
        return np.bincount(self.features.ravel(), weights=np.repeat(kinds, self.features.shape[1]), minlength=len(self.names) + 1)[:-1]


def _marginals(inside: np.ndarray, boundary: np.ndarray, move: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the boundary tag at each place, and summed probabilities of each move, by forward and backward passes over all chains; places come first."""
    t, n = boundary.shape
    top = np.maximum(inside, boundary)
    e = np.stack([np.exp(inside - top), np.exp(boundary - top)], axis=2)
    m = np.exp(move - move.max())
    forward = np.empty((t + 1, n, 2))
    forward[0] = (0.0, 1.0)  # a chain begins after a boundary
    for i in range(t):
        new = (forward[i] @ m) * e[i]
        new /= new.sum(axis=1, keepdims=True)
        forward[i + 1] = np.where(there[i, :, None], new, forward[i])
    p, moves, back = np.empty((t, n)), np.zeros((2, 2)), np.ones((n, 2))
    for i in range(t - 1, -1, -1):
        both = forward[i + 1] * back
        p[i] = both[:, 1] / both.sum(axis=1)
        after = e[i] * back
        new = after @ m.T
        z = (forward[i] * new).sum(axis=1)
        moves += m * ((forward[i] * (there[i] / z)[:, None]).T @ after)
        new /= new.sum(axis=1, keepdims=True)
        back = np.where(there[i, :, None], new, back)
    return p, moves


def _fit(chains: _Chains, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, moves and boundary probabilities that maximise the likelihood of the breaks; ``share``: of boundaries that are breaks, by script."""
    w, move = np.zeros(len(chains.names)), np.zeros((2, 2))
    first, second, p = np.zeros(len(w) + 4), np.zeros(len(w) + 4), np.zeros(chains.kind.shape)
    # What a place's break, or its lack, says of its tag: a break is a boundary, none leaves the boundary its remaining share.
    unbroken = np.log(np.maximum(1 - np.where(chains.sure, 1.0, share[chains.script]), 1e-9))
    inside, boundary = np.where(chains.broke, -40.0, 0.0), np.where(chains.broke, 0.0, unbroken)
    none = np.zeros_like(boundary)
    for step in range(1, STEPS + 1):
        score = chains.scores(w)
        p, moves = _marginals(none, score, move, chains.there)
        seen, seen_moves = _marginals(inside, score + boundary, move, chains.there)
        g = np.r_[chains.gradient(seen - p) - chains.pull * w, (seen_moves - moves).ravel() - PULL[0] * move.ravel()]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        change = 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w += change[:-4]
        move += change[-4:].reshape(2, 2)
    return w, move, p


def train(lines: list[Chain]) -> dict[str, float]:
    """Weights of features and moves; the same lines give the same weights, none give none."""
    if not lines:
        return {}
    chains = _Chains(lines)
    # First as if every boundary were a break: the middle probability at breaks is the share of boundaries that are.
    _, _, p = _fit(chains, np.full(len(chains.scripts), 1 - 1e-9))
    own = chains.broke & ~chains.sure
    every = np.quantile(p[own], QUANTILE) if own.any() else 1.0
    by = [p[own & (chains.script == k)] for k in range(len(chains.scripts))]
    share = np.clip([np.quantile(x, QUANTILE) if len(x) >= 20 else every for x in by], 0.02, 0.98)
    w, move, _ = _fit(chains, share)
    moves = {f"t{a}{b}": float(move[a, b]) for a in (0, 1) for b in (0, 1)}
    return {f: float(x) for f, x in zip(chains.names, w, strict=True) if abs(x) > 1e-6} | moves


# ---- the plan


def units(text: str | None, decode) -> list[tuple[int, int]]:
    """1-based first and last code point of each unit; ``decode``: a ``decoder``."""
    out: list[tuple[int, int]] = []
    for m in _LINE.finditer(text or ""):
        line, at = m[0], m.start()
        found = candidates(line)
        # What ends with the line needs no tag.
        found = [(i, d) for i, d in found if not d[1].startswith("end") or d[2] != "inside"]
        inner = [(i, d) for i, d in found if not d[1].startswith("end")]
        cut = dict(zip((i for i, _ in inner), decode([d for _, d in inner]), strict=True))
        tags = [cut.get(i, True) for i, _ in found]
        start = 0
        for end in [*(i + 1 for (i, _), t in zip(found, tags, strict=True) if t), len(line)]:
            part = line[start:end]
            if part.strip():
                out.append((at + start + len(part) - len(part.lstrip()) + 1, at + start + len(part.rstrip())))
            start = end
    return out


def train_on(documents: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from at most ``sample`` documents, those of the smallest hash of (doc_id, text)."""
    rows = documents.where("text is not null").select("text", F.xxhash64("doc_id", "text").alias("h")).orderBy("h", "text").limit(sample).collect()
    w = train(training_lines([r["text"] for r in rows]))
    if len(w) > MAX_WEIGHTS:
        raise ValueError(f"{len(w)} weights are beyond what is broadcast")
    return w


def sentence_units(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``doc_id, start_pos, end_pos`` - one row per sentence unit of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(train_on(documents) if weights is None else weights)

    def run(batch: pa.RecordBatch) -> dict:
        decode = decoder(shared.value)
        ids, starts, ends = [], [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for s, e in units(text, decode):
                ids.append(i)
                starts.append(s)
                ends.append(e)
        return {"doc_id": ids, "start_pos": starts, "end_pos": ends}

    rows = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(fill_cores(rows), run, "doc_id long, start_pos int, end_pos int")
