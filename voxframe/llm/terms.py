"""Freely typed or pasted mentions onto the canonical terms of a lexicon (problem 5).

Every spelling of a term (its canonical form, variants, exact forms and stems)
is an alias path in a trie of phonetic codes, in which letters that recognisers
confuse share a symbol. A Levenshtein automaton walks the trie and returns all
aliases within a distance that depends on the length of what was heard. An exact
check follows: the weighted edit distance of the spellings themselves, in which
confusable letters, doubled letters and swaps cost less than others. The term of
least cost is taken if that cost is small for the alias's length; else the
mention stands for no term.

Words around a term, quotes, case, blanks, hyphens inside and compound tails
("term-report") are seen through. Neighbouring words are also tried joined, up to
as many as the longest alias has. Russian words are tried without each possible
case ending, as stems take endings. Words and aliases under 3 letters have no room
for mistakes and match only their equals; an alias of one letter matches a mention that is nothing but that letter.

A null or empty mention stands for no term. Of equal costs the alias of greater
length, then the canonical first in order, is taken. Repeated lexicon entries
change nothing; an empty lexicon leaves every mention unmatched. Only the
lexicon is broadcast, in blocks of a bounded size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.arrow import map_batches
from voxframe.llm.textform import canonical
from voxframe.operators.storage import spread

#: Characters of the lexicon entries that are broadcast at once; more are searched block by block.
BLOCK_CHARS = 4_000_000
#: Greatest weighted cost for each letter of the alias.
MAX_COST = 0.27

# Russian case endings of nouns.
ENDINGS = ["ами", "ями", "ах", "ях", "ам", "ям", "ов", "ев", "ом", "ем", "ой", "ей", "а", "я", "у", "ю", "ы", "и", "е", "о", "й", "ь"]
_VOWELS = "aeiouyаеёиоуыэюя"
# Letters that share a symbol of the phonetic code.
_CLASSES = {"p": "bpбп", "t": "dtдт", "k": "gkcqгкх", "s": "zsзсцшщжчx", "f": "vfwвф", "h": "h", "m": "mм", "n": "nн", "l": "lл", "r": "rр", "i": "jй"}
_CODE = {ord(c): k for k, letters in _CLASSES.items() for c in letters} | {ord(c): "a" for c in _VOWELS} | {ord("h"): None, ord("ъ"): None, ord("ь"): None}
_CODE[ord("й")] = "a"
_CODE[ord("j")] = "a"
_SIMILAR = ["bp", "dt", "gkcq", "zs", "vfw", "iyj", "sc", "бп", "дт", "гкх", "зс", "вф", "жшщ", "цс", "ий", "чш", "tс"]
_CLOSE = {frozenset((a, b)) for g in _SIMILAR for a in g for b in g if a != b}
_CYRILLIC = regex.compile(r"[а-яё]")
_LATIN = regex.compile(r"[a-z]")
_STRONG_RUSSIAN, _RUN, _DOUBLES = regex.compile(r"[бвгджзийклмнптфцчшщъыьэюя]", regex.IGNORECASE), regex.compile(r"[\p{L}\p{N}]+"), regex.compile(r"(.)\1+")
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*")


def code(word: str) -> str:
    """Phonetic code: confusable letters alike, no doubles."""
    return _DOUBLES.sub(r"\1", word.translate(_CODE))


def reach(length: int) -> int:
    """Edits of the phonetic code that the automaton allows for what was heard."""
    return 0 if length < 2 else 1 if length < 4 else 2 if length < 7 else 3 if length < 11 else 4


@functools.lru_cache(1 << 17)
def cost(a: str, b: str) -> float:
    """Weighted edit distance of two spellings."""

    def alone(x: str, beside: str) -> float:
        return 0.25 if x == beside else 0.6 if x in _VOWELS or x in "hьъй" else 1.0

    before: list[float] = []
    row = [0.0]
    for j, y in enumerate(b):
        row.append(row[-1] + alone(y, b[j - 1] if j else ""))
    for i, x in enumerate(a):
        new = [row[0] + alone(x, a[i - 1] if i else "")]
        for j, y in enumerate(b):
            if x == y:
                swap = 0.0
            elif x in _VOWELS and y in _VOWELS:
                swap = 0.4
            else:
                swap = 0.35 if frozenset((x, y)) in _CLOSE else 1.6
            d = min(row[j] + swap, row[j + 1] + alone(x, a[i - 1] if i else ""), new[j] + alone(y, b[j - 1] if j else ""))
            if i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                d = min(d, before[j - 1] + 0.6)
            new.append(d)
        before, row = row, new
    return row[-1]


class Lexicon:
    """Trie of the phonetic codes of all aliases; a node's entries are ``(alias, is_stem, canonical)``."""

    def __init__(self, terms: Iterable[dict], words: int = 1, least: int = 3):
        self.root: dict = {}
        self.letters: dict[str, str] = {}  # aliases of one letter
        self.words, self.least = words, least  # of aliases: most words of one, fewest letters of one (3 at most)
        self.known: dict[str, tuple[float, int, str]] = {}  # words looked up already
        for term in terms:
            name = term["canonical"]
            if not name:
                continue
            whole = [name, *(term.get("latin_variants") or []), *(term.get("latin_suggest") or []), *(term.get("ru_exact") or [])]
            for alias in whole:
                self._add(alias, False, name)
            for stem in term.get("ru_stems") or []:
                self._add(stem, True, name)
            for form in term.get("ru_exact") or []:
                for stem in _without_endings(_plain(form)):
                    self._add(stem, True, name)

    def _add(self, alias: str | None, stem: bool, name: str) -> None:
        runs = _runs(alias)
        alias = _spell("".join(runs))
        if len(alias) < 2:
            if alias:
                self.letters[alias] = min(name, self.letters.get(alias, name))
            return
        self.words, self.least = max(self.words, len(runs)), min(self.least, sum(map(len, runs)))
        node = self.root
        for c in code(alias):
            node = node.setdefault(c, {})
        node.setdefault("entries", set()).add((alias, stem, name))

    def within(self, heard: str, most: int) -> Iterable[tuple[str, bool, str]]:
        """All entries whose code is within ``most`` edits of ``heard``: the automaton's states are rows of distances."""
        todo = [(self.root, list(range(len(heard) + 1)))]
        while todo:
            node, row = todo.pop()
            for c, child in node.items():
                if c == "entries":
                    if row[-1] <= most:
                        yield from child
                    continue
                new = [row[0] + 1]
                for j, h in enumerate(heard):
                    new.append(min(row[j] + (h != c), row[j + 1] + 1, new[j] + 1))
                if min(new) <= most:
                    todo.append((child, new))


def _runs(text: str | None) -> list[str]:
    """Runs of letters and digits in one form and lower case."""
    if not text:
        return []
    ru = _STRONG_RUSSIAN.search(text)
    return _RUN.findall(canonical(text, "ru" if ru else "en").lower())


def _plain(text: str | None) -> str:
    """One form, lower case, no hyphens and edges."""
    return _spell("".join(_runs(text)))


def _spell(word: str) -> str:
    """One spelling of what has several in Latin script, and е for ё."""
    return word.replace("ё", "е").replace("ph", "f").replace("kh", "k").replace("ch", "c").replace("ck", "k").replace("xx", "x").replace("x", "ks")


def _without_endings(word: str) -> list[str]:
    """``word`` and what is left of it without each ending it may have."""
    return [word, *(word[: -len(e)] for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= 3)] if _CYRILLIC.search(word) else [word]


def readings(heard: str, most: int = 1, least: int = 3) -> list[str]:
    """What of a mention may be the term, of ``least`` letters: each word, joined at its hyphens, its parts before and after
    one, and up to ``most`` parts of neighbouring words, joined."""
    ru = _STRONG_RUSSIAN.search(heard)
    out: dict[str, None] = {}
    flat: list[tuple[str, int]] = []  # all parts and the word of each
    for i, m in enumerate(_WORD.finditer(canonical(heard, "ru" if ru else "en").lower())):
        parts = regex.split(r"[-'’]", m[0])
        flat += [(p, i) for p in parts]
        for k in range(len(parts), 0, -1):
            out.setdefault("".join(parts[:k]))
        for k in range(1, len(parts)):
            out.setdefault("".join(parts[k:]))
    for a in range(len(flat)):
        for b in range(a + 2, min(a + most, len(flat)) + 1):
            if flat[a][1] != flat[b - 1][1]:
                out.setdefault("".join(p for p, _ in flat[a:b]))
    return [_spell(w) for w in out if len(w) >= least]


def nearest_alias(lexicon: Lexicon, word: str) -> tuple[float, int, str]:
    """Least cost a letter, minus the alias's length, and the canonical of the alias nearest to one word."""
    cyrillic, found, seen = bool(_CYRILLIC.search(word)), (9.0, 0, ""), set()
    for stem in _without_endings(word):
        whole = stem is word
        c = code(stem)
        for alias, is_stem, name in lexicon.within(c, reach(len(c))):
            if (not whole and not is_stem) or (alias, stem, name) in seen or bool(_CYRILLIC.search(alias)) != cyrillic or (min(len(stem), len(alias)) < 3 and stem != alias):
                continue
            seen.add((alias, stem, name))
            found = min(found, (round(cost(stem, alias) / len(alias), 9), -len(alias), name))
    return found


def nearest(lexicon: Lexicon, heard: str) -> tuple[float, int, str]:
    """What ``nearest_alias`` finds for the best reading of a mention."""
    runs = _runs(heard)
    if len(runs) == 1 and len(runs[0]) == 1:
        name = lexicon.letters.get(_spell(runs[0]))
        return (0.0, -1, name) if name else (9.0, 0, "")
    found = (9.0, 0, "")
    for word in readings(heard, lexicon.words, lexicon.least):
        if word not in lexicon.known:
            if len(lexicon.known) >= 1 << 17:
                lexicon.known.clear()
            lexicon.known[word] = nearest_alias(lexicon, word)
        found = min(found, lexicon.known[word])
    return found


def best(lexicon: Lexicon, heard: str, most: float = MAX_COST) -> tuple[str, float]:
    """The canonical a mention stands for, or '', and the least cost a letter."""
    found = nearest(lexicon, heard)
    return (found[2] if found[0] <= most else "", found[0])


def _extent(terms: DataFrame) -> tuple[int, int]:
    """Most words and fewest letters (3 at most) of the aliases of a whole lexicon."""

    def run(b: pa.RecordBatch) -> dict:
        lexicon = Lexicon(b.to_pylist())
        return {"words": [lexicon.words], "least": [lexicon.least]}

    r = map_batches(terms, run, "words int, least int").agg(F.max("words"), F.min("least")).first()
    return r[0] or 1, r[1] or 3


def match_mentions(mentions: DataFrame, terms: DataFrame, most: float = MAX_COST, block: int = BLOCK_CHARS) -> DataFrame:
    """``mention_id, canonical`` - one row per mention; '' where it stands for no term."""
    entries = terms.select("canonical", "ru_stems", "ru_exact", "latin_variants", "latin_suggest").where("canonical <> ''")
    n = -(-(entries.agg(F.sum(F.length(F.to_json(F.struct(*entries.columns))))).first()[0] or 1) // block)
    words, least = _extent(entries) if n > 1 else (1, 3)  # a block's readings are those of the whole lexicon
    heard = spread(mentions.where("heard is not null").select("heard").distinct(), "heard")
    found = None
    for b in range(n):
        own = entries if n == 1 else entries.where(F.pmod(F.xxhash64("canonical"), F.lit(n)) == b)
        shared = mentions.sparkSession.sparkContext.broadcast((tuple(r.asDict() for r in own.collect()), words, least))
        near = _near(heard, shared, most)
        found = near if found is None else found.unionAll(near)
    if n > 1:
        found = found.groupBy("heard").agg(F.min(F.struct("cost", "size", "canonical")).alias("f")).select("heard", "f.canonical")
    joined = mentions.select("mention_id", "heard").join(found.select("heard", "canonical"), "heard", "left")
    return joined.groupBy("mention_id").agg(F.coalesce(F.max("canonical"), F.lit("")).alias("canonical"))


def _near(heard: DataFrame, shared, most: float) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        lexicon = _lexicon(shared)
        rows = [(x, *nearest(lexicon, x)) for x in batch.column("heard").to_pylist()]
        rows = [r for r in rows if r[1] <= most]
        return {c: [r[i] for r in rows] for i, c in enumerate(("heard", "cost", "size", "canonical"))}

    return map_batches(heard, run, "heard string, cost double, size int, canonical string")


_LEXICONS: dict = {}


def _lexicon(shared) -> Lexicon:
    """One trie for each Python worker."""
    if shared.value is not _LEXICONS.get("of"):
        _LEXICONS.update(of=shared.value, lexicon=Lexicon(*shared.value))
    return _LEXICONS["lexicon"]
