"""Raw transcript segments into clean, ordered speaker turns (problem 1).

1. An Arrow-batched parser brings each row's text and label to one form, strips
   time marks, sound annotations and hesitation sounds, and cuts the text at
   whatever may be a label written before speech.
2. The distinct labels of a recording are matched with its roster: numbers
   directly; names by phonetic blocking, edit distance and optimal assignment.
   What matches no roster entry is no label but ordinary text.
3. Turns are runs of one speaker over the parts with speech in time order. They
   are formed within time shards of a recording and stitched at shard edges, so
   no task holds all rows of an always-on recording.

Rows without text or speech count for nothing. Null labels and labels that name
nobody leave speech to the turn before; speech before any turn is in none. Rows
of one start are taken by seg_idx; a null start comes last. Rows repeated under
one (rec_id, seg_idx) count once. Empty inputs give an empty result.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.arrow import map_batches
from voxframe.llm.textform import canonical
from voxframe.operators.storage import materialise, spread

# Hesitation sounds of Russian, English and German.
FILLERS = "э ээ эээ э-э э-э-э э-эм эм эмм м мм ммм м-м хм хмм гм uh uhh uh-uh uh-uh-uh uhm um umm er erm eh hm hmm mm mmm mhm äh ähh ähm öh öhm".split()
# Words before a speaker's number.
NUMBER_WORDS = "speaker speakers spk s sp спикер говорящий участник голос sprecher teilnehmer".split()
# Beginnings of words for sounds and for speech that can't be made out, in Russian, English and German.
SOUNDS = [
    "смех", "сме[её]тся", "смеются", "каш", "пауз", "музык", "аплодис", "шум", "неразб", "вздох", "вздых", "звон", "стук", "щелч", "плач", "тишин", "молч", "гудок", "гудки", "помех", "хлоп", "скрип", "хихик",
    "laugh", "chuckl", "cough", "sigh", "pause", "music", "applau", "noise", "inaudib", "unintellig", "crosstalk", "silence", "clap", "ring", "beep", "breath", "sniff", "click", "knock", "cry", "whisper",
    "lach", "hust", "seufz", "musik", "applaus", "rausch", "beifall", "unverst", "stille", "klopf", "klingel", "räusper", "atm", "flüster",
]
SHARD_S = 600
#: Costs that differ by no more are open to assignment; what each further label adds to an entry's cost.
MARGIN, SHARED = 1e-3, 0.02

_TIME = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIME_MARK = regex.compile(
    rf"\[\s*{_TIME}\s*\]|\(\s*{_TIME}\s*\)|<\s*{_TIME}\s*>|\{{\s*{_TIME}\s*\}}"
    rf"|\d{{1,3}}:\d{{2}}:\d{{2}}[.,]\d{{1,3}}\s*-->\s*\d{{1,3}}:\d{{2}}:\d{{2}}[.,]\d{{1,3}}"
    r"|(?<![\w:.,])\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?![\w:])"
)
# Sounds stand in brackets of their own, of any length, or in parentheses; what is spoken may stand there too.
_SOUND = regex.compile(r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\*[^*\n]+\*|[♪♫♬]+")
_PARENTHESIS = regex.compile(r"\(([^()]*)\)")
_SOUND_WORD = regex.compile(rf"\b(?:{'|'.join(SOUNDS)})", regex.IGNORECASE)
_BRACKETED_LABEL = regex.compile(r"\[([^\[\]]*\p{L}[^\[\]]*)\]\s*:")
_LOOSE_MARK = regex.compile(r"\s+([.,;!?…])|^[\s.,;!?…]+")
_FILLER = regex.compile(rf"(?<![\w-])(?:{'|'.join(sorted(map(regex.escape, FILLERS), key=len, reverse=True))})(?![\w-])(?:\.\.\.|…|,)?", regex.IGNORECASE)
_TOKEN = r"[^\W\d_](?:\.|[\w'-]*)"
# A label stands at the start, after the end of a sentence, or after a dialogue dash; at most three words, then a colon.
_LABEL = regex.compile(
    rf"(?:^|(?<=[.!?…]\s)|(?<=:\s))(?:[->–—•\s]*)((?:speaker|spk|s|спикер|говорящий|sprecher)[ _№#-]{{0,2}}\d{{1,4}}|{_TOKEN}(?:(?:\s|(?<=\.)){_TOKEN}){{0,2}})\s?:(?=\s|$)",
    regex.IGNORECASE,
)
_NUMBERED = regex.compile(rf"(?:{'|'.join(NUMBER_WORDS)})[\s_№#.-]*0*(\d{{1,9}})", regex.IGNORECASE)
_RUSSIAN, _STRONG_RUSSIAN = regex.compile(r"[а-яё]", regex.IGNORECASE), regex.compile(r"[бвгджзийклмнптфцчшщъыьэюя]", regex.IGNORECASE)
_ASIDE, _LETTERS = regex.compile(r"\([^()]*\)"), regex.compile(r"[^\W\d_]+")
_SPOKEN = regex.compile(r"[^\W_]")
_BLANKS = regex.compile(r"\s+")

# Cyrillic to Latin, as names are transliterated.
_CYR = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
_LAT = "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya".split(" ")
_TRANSLIT = {ord(c): x for c, x in zip(_CYR, _LAT, strict=True)}


def strip_noise(text: str) -> str:
    """Text without time marks, sound annotations and hesitation sounds, single blanks between words."""
    text = _BRACKETED_LABEL.sub(r"\1:", text)
    text = _SOUND.sub(" ", _TIME_MARK.sub(" ", text))
    text = _PARENTHESIS.sub(lambda m: " " if len(m[1].split()) < 2 or _SOUND_WORD.search(m[1]) else m[0], text)
    text = _BLANKS.sub(" ", _FILLER.sub(" ", text)).strip()
    return _LOOSE_MARK.sub(lambda m: m[1] or "", text)


@functools.lru_cache(1 << 16)
def tidy_label(label: str | None) -> str | None:
    """A label in one form: ``#3`` for a number, else lower-cased words; None where it holds no letter or digit."""
    if not isinstance(label, str):
        return None
    x = canonical(label, "ru" if _STRONG_RUSSIAN.search(label) else "en")
    x = _ASIDE.sub(" ", x)
    if m := _NUMBERED.fullmatch(x.strip(" []<>{}:*-–—\t")):
        return f"#{int(m[1])}"
    return " ".join(_LETTERS.findall(x.lower())) or None


def parse(text: str | None, label: str | None) -> list[tuple[int, str | None, bool, str]]:
    """Parts ``(number, label, speech?, said)``: part 0 has the row's own label, each other one what may be a label in the text."""
    if not isinstance(text, str):
        return []
    text = strip_noise(canonical(text, "ru" if _RUSSIAN.search(text) else "en"))
    parts, at, own, written = [], 0, tidy_label(label), ""
    for m in _LABEL.finditer(text):
        said = text[at : m.start()].strip()
        parts.append((len(parts), own, bool(_SPOKEN.search(said)), said, written))
        own, at, written = tidy_label(m[1]), m.end(), m[0].strip()
    said = text[at:].strip()
    parts.append((len(parts), own, bool(_SPOKEN.search(said)), said, written))
    return parts


# ---- labels against the roster

_CONFUSED, _VOWELS, _DOUBLES = str.maketrans("bvgdzcqw", "pfktskkf"), regex.compile(r"[aeiouyhäöü]"), regex.compile(r"(.)\1+")


@functools.lru_cache(1 << 16)
def phonetic(token: str) -> str:
    """Blocking key of a name: consonant classes of the Latin spelling, without doubles and vowels."""
    t = token.lower().translate(_TRANSLIT)
    for a, b in (("sch", "s"), ("sh", "s"), ("zh", "s"), ("ch", "s"), ("ts", "s"), ("ph", "f"), ("ck", "k"), ("x", "ks")):
        t = t.replace(a, b)
    return _DOUBLES.sub(r"\1", _VOWELS.sub("", t.translate(_CONFUSED)))


@functools.lru_cache(1 << 16)
def spelling_distance(a: str, b: str) -> int:
    """Edit distance with neighbouring letters swapped counting as one."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


@functools.lru_cache(1 << 17)
def _token_cost(token: str, name: str) -> float | None:
    """None: another name. Initials and full names cost nothing."""
    a, b = token.translate(_TRANSLIT), name.translate(_TRANSLIT)
    if len(token) <= 2 and (name.startswith(token) or b.startswith(a)):
        return 0.01
    if a == b:
        return 0.0
    d = spelling_distance(a, b)
    if phonetic(token) == phonetic(name):
        d = min(d, 2)
    return d / len(b) if d <= (0 if len(b) < 4 else 1 if len(b) < 6 else 2) and min(len(a), len(b)) > 2 else None


def label_cost(label: str, name: str) -> float | None:
    """Cost of reading ``label`` as the roster name; None where some word of it is no part of the name."""
    left, cost, full = name.split(), 0.0, False
    for token in sorted(label.split(), key=len, reverse=True):
        costs = [(c, n) for n in left if (c := _token_cost(token, n)) is not None]
        if not costs:
            return None
        c, n = min(costs)
        left.remove(n)
        cost, full = cost + c, full or len(token) > 2
    return cost if full else None


def assign(cost: list[list[float]]) -> list[int]:
    """Optimal assignment (Hungarian method): the column of each row; needs at least as many columns as rows."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = row_of[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[row_of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def match_labels(labels: list[str], roster: list[tuple[int, str]]) -> dict[str, int]:
    """Roster number of each label that names an entry.

    Candidates come from phonetic blocks; a label that shares no block is held
    against the whole roster. A label that is nearest to one entry by a margin
    takes it. All others of the recording are assigned together at least total
    cost, in which an entry grows dearer with each label that has it.
    """
    names = [(no, tidy_label(name)) for no, name in roster]
    names = [(no, name) for no, name in names if name and not name.startswith("#")]
    numbers = {no for no, _ in roster}
    blocks: dict[str, set[int]] = {}
    for k, (_, name) in enumerate(names):
        for token in name.split():
            blocks.setdefault(phonetic(token), set()).add(k)
    found, open_ = {}, {}
    for label in labels:
        if label.startswith("#"):
            if int(label[1:]) in numbers:
                found[label] = int(label[1:])
            continue
        costs: dict[int, float] = {}
        near = set().union(*(blocks.get(phonetic(t), set()) for t in label.split() if len(t) > 2), set())
        for among in (near, set(range(len(names)))):
            costs = {k: c for k in among if (c := label_cost(label, names[k][1])) is not None}
            if costs:
                break
        if costs:
            least = min(costs.values())
            costs = {k: c for k, c in costs.items() if c <= least + MARGIN}
            if len(costs) == 1:
                found[label] = names[next(iter(costs))][0]
            else:
                open_[label] = costs
    taken = {no: n for no in set(found.values()) if (n := sum(1 for x in found.values() if x == no))}
    todo = sorted(open_)
    # An entry has a column for each label that may have it, the later ones dearer, so that any number may share it.
    wanted = {k: sum(k in costs for costs in open_.values()) for k in sorted({k for costs in open_.values() for k in costs})}
    columns = [(k, nth) for k, n in wanted.items() for nth in range(n)]
    cost = [[open_[x][k] + SHARED * (taken.get(names[k][0], 0) + nth) + 1e-6 * k if k in open_[x] else 1e6 for k, nth in columns] for x in todo]
    for x, j in zip(todo, assign(cost), strict=True):
        found[x] = names[columns[j][0]][0]
    return found


# ---- the plan

_PARTS = "rec_id long, seg_idx int, start_sec double, end_sec double, part int, label string, speech boolean, said string, written string"


def _parse_rows(batch: pa.RecordBatch) -> dict:
    b = batch.to_pydict()
    out: dict[str, list] = {c.split()[0]: [] for c in _PARTS.split(", ")}
    columns = list(out.values())
    for r, s, t, e, text, label in zip(b["rec_id"], b["seg_idx"], b["start_sec"], b["end_sec"], b["text"], b["speaker"], strict=True):
        for p in parse(text, label):
            for column, x in zip(columns, (r, s, t, e, *p), strict=True):
                column.append(x)
    return out


def _match(batch: pa.RecordBatch) -> dict:
    """Labels of whole recordings against their rosters."""
    out: dict[str, list] = {"rec_id": [], "label": [], "speaker_no": []}
    for r, labels, roster in zip(*(batch.column(c).to_pylist() for c in ("rec_id", "labels", "roster")), strict=True):
        entries = dict(sorted((e["speaker_no"], e["display_name"] or "") for e in roster))
        for label, no in match_labels(sorted(labels), list(entries.items())).items():
            for column, x in zip(out.values(), (r, label, no), strict=True):
                column.append(x)
    return out


def spoken_parts(raw: DataFrame, speakers: DataFrame) -> DataFrame:
    """Parts with speech: ``rec_id, seg_idx, start_sec, end_sec, part, said, speaker_no`` (null: no usable label)."""
    cols = ["rec_id", "seg_idx", "start_sec", "end_sec", "text", "speaker"]
    rows = raw.select(*(F.col(c).cast(t) for c, t in zip(cols, ["long", "int", "double", "double", "string", "string"], strict=True)))
    rows = rows.where("rec_id is not null and seg_idx is not null and text is not null").dropDuplicates(["rec_id", "seg_idx"])
    parts = materialise(map_batches(rows, _parse_rows, _PARTS), "turn_parts")
    labels = parts.where("label is not null").groupBy("rec_id").agg(F.collect_set("label").alias("labels"))
    roster = speakers.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("speaker_no").cast("int").alias("speaker_no"), "display_name").where("speaker_no is not null")
    roster = roster.groupBy("rec_id").agg(F.collect_set(F.struct("speaker_no", "display_name")).alias("roster"))
    names = map_batches(spread(labels.join(roster, "rec_id"), "rec_id"), _match, "rec_id long, label string, speaker_no int")
    parts = parts.join(names, ["rec_id", "label"], "left")
    # What looked like a label but names nobody is text, spoken by whoever speaks before it in the row.
    own = Window.partitionBy("rec_id", "seg_idx").orderBy("part")
    kept = F.col("part").cast("int") == 0
    parts = parts.withColumn("no_label", ~kept & F.col("speaker_no").isNull())
    parts = parts.withColumn("speaker_no", F.last("speaker_no", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.when(F.col("no_label"), F.trim(F.concat_ws(" ", "written", "said"))).otherwise(F.col("said"))
    return parts.where("speech or no_label").select("rec_id", "seg_idx", "start_sec", "end_sec", "part", said.alias("said"), "speaker_no")


def _runs(parts: DataFrame, shard_s: int) -> DataFrame:
    """Parts with the speaker in force and their turn: ``turn_shard, turn_run`` of the turn's first run."""
    at = F.coalesce("start_sec", F.lit(float("inf")))
    late = F.lit(1 << 61) + F.floor(F.col("seg_idx") / 1000)  # rows without a start come last, in shards by their index
    shard = F.coalesce(F.floor(F.col("start_sec") / shard_s), late).cast("long")
    parts = parts.withColumns({"at": at, "shard": shard})
    order = ["at", "seg_idx", "part"]
    here = Window.partitionBy("rec_id", "shard").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("known", F.last("speaker_no", ignorenulls=True).over(upto))
    # The speaker at the end of each earlier shard, from one row a shard.
    ends = parts.where("known is not null").groupBy("rec_id", "shard").agg(F.max_by("known", F.struct(*order)).alias("end_speaker"))
    all_shards = parts.select("rec_id", "shard").distinct().join(ends, ["rec_id", "shard"], "left")
    earlier = Window.partitionBy("rec_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_shards.select("rec_id", "shard", F.last("end_speaker", ignorenulls=True).over(earlier).alias("carried"))
    parts = parts.join(carried, ["rec_id", "shard"]).withColumn("speaker_no", F.coalesce("known", "carried")).where("speaker_no is not null")
    parts = parts.withColumn("new", F.when(F.lag("speaker_no").over(here) == F.col("speaker_no"), 0).otherwise(1))
    return parts.withColumn("run", F.sum("new").over(upto)).drop("known", "carried", "new", "at")


def _turn_of_runs(runs: DataFrame) -> DataFrame:
    """``rec_id, shard, run, turn_shard, turn_run``: runs at shard edges joined to those of the next shard."""
    bounds = runs.groupBy("rec_id", "shard").agg(F.max("run").alias("last_run"))
    edges = runs.select("rec_id", "shard", "run", "speaker_no").join(bounds, ["rec_id", "shard"]).where("run = 1 or run = last_run")
    chain = Window.partitionBy("rec_id").orderBy("shard", "run")
    joins = (F.col("run") == 1) & (F.lag("speaker_no").over(chain) == F.col("speaker_no")) & (F.lag("shard").over(chain) != F.col("shard"))
    edges = edges.withColumn("joins", F.coalesce(joins, F.lit(False)))
    head = F.last(F.when(~F.col("joins"), F.struct(F.col("shard").alias("turn_shard"), F.col("run").alias("turn_run"))), ignorenulls=True)
    return edges.withColumn("head", head.over(chain.rowsBetween(Window.unboundedPreceding, 0))).select("rec_id", "shard", "run", "head.*")


def turns(raw: DataFrame, speakers: DataFrame, shard_s: int = SHARD_S, text: bool = True) -> DataFrame:
    """``rec_id, speaker_no, first_seg, last_seg``, and ``start_sec, end_sec, text`` if asked for - one row per turn."""
    spoken = spoken_parts(raw, speakers)
    parts = _runs(materialise(spoken if text else spoken.drop("said", "end_sec"), "spoken_parts"), shard_s)
    order = F.struct(F.coalesce("start_sec", F.lit(float("inf"))).alias("t"), F.col("seg_idx").alias("s"), F.col("part").alias("p"))
    aggregates = [F.min(order).alias("f"), F.max(order).alias("l")]
    if text:
        aggregates += [F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.collect_list(F.struct(order.alias("o"), "said")).alias("said")]
    runs = materialise(parts.groupBy("rec_id", "shard", "run", "speaker_no").agg(*aggregates), "runs")
    runs = runs.join(_turn_of_runs(runs), ["rec_id", "shard", "run"], "left")
    keys = ["rec_id", F.coalesce("turn_shard", "shard").alias("turn_shard"), F.coalesce("turn_run", "run").alias("turn_run"), "speaker_no"]
    aggregates = [F.min("f").alias("f"), F.max("l").alias("l")]
    if text:
        said = F.transform(F.sort_array(F.flatten(F.collect_list("said"))), lambda x: x["said"])
        aggregates += [F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.array_join(said, " ").alias("text")]
    whole = runs.groupBy(*keys).agg(*aggregates)
    return whole.select("rec_id", "speaker_no", F.col("f.s").alias("first_seg"), F.col("l.s").alias("last_seg"), *(["start_sec", "end_sec", "text"] if text else []))
