"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts and terms are folded alike: lower case, accents off, look-alike letters of other alphabets and digit or sign
substitutions to their Latin letters, and i, l, 1 (and, inside words, ! and |) to one letter. A term counts between
word edges, a stem where a word begins. Matches inside an exception phrase do not count, and of several matches that
begin at one place only the heaviest does. Stems occur in clean texts too, so only their hits beyond ``RATE`` of a
text's words count. The weight, divided by the root of the number of words, is mapped to 0..1 so that the best cut on
the training rows lands on the threshold; below every such score, texts are graded by their rate of stems.

Training: ``fit`` reads at most ``SAMPLE`` labelled rows (a documented bound; the rows whose ids have the least
hashes) and adds to the base terms each word that toxic rows hold, and each stem of 4 to 8 letters that they repeat,
significantly more often (G² of at least ``EVIDENCE``), with its log odds. Each learned term takes at least
``LEAST`` toxic training rows, so their number is bounded by the sample. Labels that contradict the text are left as
they are, so no text-based score finds all of them.

Defined cases: null or empty text: score 0. A text of any length is matched whole, one at a time. Labels that are
null, or whose document is missing, teach nothing; a document labelled twice counts twice. A null doc_id is not held
out. No labels: base terms and default scale. Repeated rows get equal scores. Only doc_id and text are read, so other
columns may have any name; ``accepted`` carries them unchanged.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm import common as c

#: Base terms, weight 1 each.
TERMS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "pathetic", "trash", "scum", "clown", "clowns", "worthless", "disgusting", "imbecile", "dumbass", "jackass", "bastard", "scumbag", "dimwit", "lowlife", "shut up", "kill yourself", "go to hell")
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "pond scum", "sore loser", "worthless coin", "idiot proof", "not stupid", "not worthless", "not an idiot")
#: Look-alike letters of other alphabets, and substitutions by digits and signs.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i"}
SAMPLE = 20_000
EVIDENCE = 15.0
SCALE = 0.05
THRESHOLD = 0.3
LEAST = 3
STEM_SIZES = range(4, 9)
RATE = 0.01


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in (*range(0x21, 0x250), *range(0x300, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code).lower()) if not unicodedata.combining(x))
        plain = "".join(SIGNS.get(y, y) for x in plain for y in LOOKALIKES.get(x, x))
        if plain != chr(code):
            table[code] = plain
    for code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF):
        table[code] = ""
    return table


FOLD = _table()


#: Signs that stand for a letter only where a word goes on.
INSIDE = re.compile(r"[!|](?=[^\W_])")


def fold(text: str) -> str:
    return INSIDE.sub("i", text).translate(FOLD)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # by folded term
    stems: dict[str, float]
    scale: float

    def matcher(self) -> Matcher:
        return Matcher(self.weights, self.stems)

    def score(self, density: float, grade: float) -> float:
        low = 0.1 * grade
        return low + (1 - low) * density / (density + self.scale) if density > 0 else low


class Matcher:
    def __init__(self, weights: dict[str, float], stems: dict[str, float] | None = None):
        import ahocorasick

        entries: dict[str, list] = {}  # [weight as a term, weight as a stem, harmless]
        for place, own in ((0, weights), (1, stems or {}), (2, dict.fromkeys(map(fold, EXCEPTIONS), True))):
            for term, value in own.items():
                entries.setdefault(term, [0.0, 0.0, False])[place] = value
        self.automaton = ahocorasick.Automaton()
        for term, entry in entries.items():
            self.automaton.add_word(term, (len(term), *entry))
        self.automaton.make_automaton()

    def measure(self, text: str) -> tuple[float, float]:
        """(weight of the hits over the root of the number of words, rate of stems between 0 and 1)."""
        folded = fold(text)
        hits: dict[int, tuple[int, float, bool]] = {}
        harmless = []
        for last, (length, term, stem, exception) in self.automaton.iter(folded):
            first, end = last - length + 1, last + 1
            if first and folded[first - 1].isalnum():
                continue
            whole = not (end < len(folded) and folded[end].isalnum())
            if exception and whole:
                harmless.append((first, end))
            for weight, is_term in ((term if whole else 0.0, True), (stem, False)):
                if weight and weight > hits.get(first, (0, 0.0, False))[1]:
                    hits[first] = (end, weight, is_term)
        words = max(1, len(text.split()))
        harmless.sort()
        begins, reach = [x for x, _ in harmless], [*accumulate((y for _, y in harmless), max)]
        total, stems, heavy = 0.0, 0, 0.0
        for first, (end, weight, is_term) in hits.items():
            at = bisect_right(begins, first)
            if at and end <= reach[at - 1]:
                continue
            if is_term:
                total += weight
            else:
                stems, heavy = stems + 1, heavy + weight
        allowed = RATE * words
        if stems > allowed:
            total += heavy / stems * (stems - allowed)
        return total / words**0.5, stems / (stems + allowed)

    def density(self, text: str) -> float:
        return self.measure(text)[0]


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: Entries of a task's counts before they are handed on.
COUNTED = 100_000


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts hold each word, and repeat each stem."""
    counts = {True: Counter(), False: Counter()}

    def handed_on() -> pa.RecordBatch:
        terms = [*(counts[True] | counts[False])]
        columns = [pa.array([x for x, _ in terms], pa.string()), pa.array([x for _, x in terms], pa.bool_())]
        columns += [pa.array([counts[side][x] for x in terms], pa.int64()) for side in (True, False)]
        counts[True].clear(), counts[False].clear()
        return pa.RecordBatch.from_arrays(columns, names=["term", "stem", "t", "c"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            words = ["".join(ch for ch in w if ch.isalnum()) for w in fold(text.as_py() or "").split()]
            heads, stems = Counter(words), Counter()
            counts[label].update((w, False) for w in heads if len(w) >= 3)
            for w, n in heads.items():
                for k in STEM_SIZES:
                    if len(w) >= k:
                        stems[w[:k]] += n
            floor = max(2, RATE * len(words))
            counts[label].update((x, True) for x, n in stems.items() if n >= floor)
            if len(counts[True]) + len(counts[False]) > COUNTED:
                yield handed_on()
    yield handed_on()


def _densities(weights: dict[str, float], stems: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(weights, stems)
        for batch in batches:
            d = [match.density(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(d, pa.float64())], names=["toxic", "density"])

    return run


def _shortest(found: list[tuple[str, float, float]]) -> dict[str, float]:
    """Weights of the stems of which no shorter form tells as much."""
    best, kept = {x: g for x, g, _ in found}, {}
    for x, g, w in found:
        if all(best.get(x[:k], 0.0) < g for k in STEM_SIZES if k < len(x)):
            kept[x] = w
    return kept


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows, none of them held out."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    marks = c.write_table(marks.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample), "toxicity-labels")
    known = c.write_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks.hint("shuffle_hash"), "doc_id").select("text", "toxic"), "toxicity-training")
    size = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, nc = size.get(True, 0), size.get(False, 0)
    weights, stems = {fold(t): 1.0 for t in TERMS}, {}
    if nt and nc:
        counts = known.mapInArrow(c.tidy(_words), "term string, stem boolean, t long, c long").groupBy("term", "stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where((F.col("t") >= LEAST) & (F.col("t") * nc > F.col("c") * nt * 4))
        share = (F.col("t") + F.col("c")) / (nt + nc)
        g2 = 2 * (F.col("t") * F.log((F.col("t") + 1e-9) / (share * nt)) + F.col("c") * F.log((F.col("c") + 1e-9) / (share * nc)))
        odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
        learned = counts.select("term", "stem", g2.alias("g2"), odds.alias("w")).where(F.col("g2") >= EVIDENCE).orderBy("term", "stem").collect()
        stems = _shortest([(r.term, r.g2, float(r.w)) for r in learned if r.stem])
        tells = {r.term: r.g2 for r in learned if r.stem and r.term in stems}
        for r in learned:
            covered = any(tells.get(r.term[:k], 0.0) >= r.g2 for k in STEM_SIZES if k <= len(r.term))  # the stem says as much
            if not r.stem and not covered:
                weights[r.term] = max(weights.get(r.term, 0.0), float(r.w))
        top = max(weights.values())
        weights.update({fold(t): max(weights[fold(t)], top / 2) for t in TERMS})
    bins = known.mapInArrow(c.tidy(_densities(weights, stems)), "toxic boolean, density double").where("density > 0").groupBy("toxic", F.floor(F.log("density") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    best, scale = 0.0, SCALE
    for cut in sorted({r.bin for r in bins}):
        tp, fp = (sum(r.n for r in bins if r.toxic == side and r.bin >= cut) for side in (True, False))
        f1 = 2 * tp / (nt + tp + fp)
        if f1 > best + 1e-9:
            lower = any(not r.toxic and r.bin < cut for r in bins)  # with no clean hits below, the cut goes well below the toxic ones
            best, scale = f1, float(np.exp(cut / 16)) * (1 - THRESHOLD) / THRESHOLD * (0.9 if lower else 0.25)
    return Model(weights, stems, scale)


def _scores(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for batch in batches:
            s = [model.score(*match.measure(t or "")) for t in batch.column("text").to_pylist()]
            rest = [k for k in batch.schema.names if k != "text"]
            arrays = [batch.column(k) for k in rest] + [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(c.tidy(_scores(model, threshold)), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged."""
    rest = c.whole_row(docs).alias("rest_")
    rows = docs.select(rest, "text")
    kind = rows.schema["rest_"].dataType.simpleString()
    return rows.mapInArrow(c.tidy(_scores(model, threshold)), f"rest_ {kind}, score double, predicted int").where("predicted = 0").select("rest_.*")
