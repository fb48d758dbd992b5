"""Text expressions as Spark columns: normalising, error rates, markers, confidence, clean-up, parsing."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions.pieces import in_pieces

#: Uncertainty and engine markers, removed in this order before texts are compared.
MARKERS = (r"\[\?\]", r"\[\?alt:\s*[^\]]*\]", r"\?\?\?", r"\[illegible[^\]]*\]", r"\[unclear\]", r"unable to read", r"\[diagram:\s*[^\]]*\]", r"\[graph:\s*[^\]]*\]", r"\[margin:\s*[^\]]*\]", r"\[inserted:\s*[^\]]*\]", r"\[empty\]", r"\[crossed out[^\]]*\]")
UNCERTAIN = r"(?i)\[\?\]|\?\?\?|\[illegible[^\]]*\]|\[unclear\]|unable to read"
#: Openings of lines that a model puts before or after a transcription.
PREAMBLES = "Here is|The transcribed|The handwritten|I can see|The text reads|Transcription:|Below is|The following|The image shows|I'll transcribe"
TRAILERS = "Note:|Please note|Some words|I was unable|Disclaimer|The handwriting|I hope|Let me know|If you need|Overall"


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def tokens(text: Column) -> Column:
    """Whitespace-separated words; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def normalise(text: Column) -> Column:
    """Lower case, markers off, white space collapsed. Compose accents first with ``nfc`` where texts are not."""
    low = F.lower(text)
    out = low
    for marker in MARKERS:
        out = F.regexp_replace(out, marker, "")
    marked = F.contains(low, F.lit("[")) | F.contains(low, F.lit("???")) | F.contains(low, F.lit("unable to read"))  # every marker holds one of these
    out = F.when(marked, out).otherwise(low)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it."""
    return in_pieces(lambda: lambda s: s.str.normalize("NFC"), "string")(text)


def _rate(edits: Column, size: Column, hyp_size: Column) -> Column:
    return F.when(size == 0, F.when(hyp_size == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(edits / F.nullif(size, F.lit(0)))


def char_error(hyp: Column, ref: Column) -> Column:
    """struct(rate, edits, ref_size) over normalised characters; an empty reference gives 0 or infinity."""
    return normal_char_error(normalise(hyp), normalise(ref))


def normal_char_error(h: Column, r: Column) -> Column:
    """``char_error`` of texts that are normalised already: columns of a table have that worked out once."""
    edits, size = edits_between(h, r), F.char_length(r)
    return F.struct(_rate(edits, size, F.char_length(h)).alias("rate"), edits.alias("edits"), size.alias("ref_size"))


#: Bits of one pair's diagonals, and of all pairs, that go through a table together; a pair's elements times its places.
NARROW, TOGETHER, PLACES = 1 << 12, 1 << 15, 1 << 22


def distance(a, b) -> int:
    """Edit distance of two sequences of any length: a column of the table at a time, as bits of whole numbers.

    Only diagonals that an alignment of at most ``most`` edits can reach are worked out; ``most`` doubles until the distance is within.
    """
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    bound, extra = len(a) - len(b) + sum(x != y for x, y in zip(a, b)), (Counter(a) - Counter(b)).total()
    most = _first(len(a), len(b), bound)
    while True:
        edits = _within(a, b, most, extra)
        if edits <= most or most >= bound:
            return edits
        most = min(bound, 2 * most)


def _first(m: int, n: int, bound: int) -> int:
    """Edits to try first for ``m`` and ``n`` places, ``bound`` of which suffice."""
    return min(bound, max(64, m // 3, m - n))


def _reach(m: int, n: int, most: int, extra: int) -> tuple[int, int]:
    """Diagonals (above, below) the first one that an alignment of at most ``most`` edits can reach, ``m`` places to ``n`` or fewer.

    One that goes x diagonals too far takes as many edits back, so 2 x and the difference in length are within ``most``. Of the
    ``extra`` elements that the longer one has more of than the other, each is deleted or replaced, and x insertions come on top.
    """
    apart = max(0, min((most - (m - n)) // 2, most - extra))
    return m - n + apart, apart


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers, those of ``b`` from 1 on without gaps, 0 for what only ``a`` has."""
    if isinstance(a, str):
        x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
        own, y = np.unique(y, return_inverse=True)
        at = np.minimum(np.searchsorted(own, x), len(own) - 1)
        return np.where(own[at] == x, at + 1, 0), y + 1
    known: dict = {}
    y = np.array([known.setdefault(w, len(known) + 1) for w in b], np.int64)
    return np.array([known.get(w, 0) for w in a], np.int64), y


def distances(pairs: list[tuple]) -> list[int]:
    """``distance`` of each pair; pairs of like length go through their tables together, as the bits of one number, since most are short."""
    out, todo = [0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        a, b = (b, a) if len(a) < len(b) else (a, b)
        out[k] = len(a)
        if len(b):
            x, y = _codes(a, b)
            bound = len(a) - len(b) + int(np.count_nonzero(x[: len(y)] != y))
            more = np.bincount(x, minlength=int(y.max()) + 1) - np.bincount(y)
            todo.append((k, x, y, _first(len(x), len(y), bound), bound, int(more[more > 0].sum())))
    while todo:
        again, group, held = [], [], 0

        def settle():
            for (k, a, b, most, bound, extra), edits in zip(group, _together([(a, b, most, extra) for _, a, b, most, _, extra in group])):
                if edits <= most or most >= bound:
                    out[k] = edits
                else:
                    again.append((k, a, b, min(bound, 2 * most), bound, extra))
            group.clear()

        for k, a, b, most, bound, extra in sorted(todo, key=lambda x: len(x[1])):
            wide = sum(_reach(len(a), len(b), most, extra))
            if wide > NARROW or int(b.max()) * len(b) > PLACES:
                out[k] = distance(*pairs[k])
                continue
            bits = min(len(b), max(256, wide // 4) + wide)
            if group and held + bits > TOGETHER:
                settle()
                held = 0
            group.append((k, a, b, most, bound, extra))
            held += bits
        settle()
        todo = again
    return out


class _Band:
    """One pair's part of a common table, as in ``_within``, in whole bytes: rows below the last one are not counted."""

    def __init__(self, a: np.ndarray, b: np.ndarray, most: int, extra: int):
        self.a, self.n, self.m = a, len(b), len(a)
        self.above, self.below = _reach(len(a), len(b), most, extra)
        places = np.zeros((int(b.max()) + 1, -(-self.n // 8) * 8 + 8), np.uint8)
        places[b, np.arange(self.n)] = 1
        self.places = np.packbits(places, 1, "little")
        self.plus = self.minus = self.edits = self.low = self.high = 0

    def move(self, start: int, end: int) -> np.ndarray:
        """Goes on to the rows that the stretch of columns meets; the places of each column's element among them, with a byte to spare."""
        first, last = min(self.n, max(0, start - self.above)) // 8, -(-min(self.n, end + self.below) // 8)
        drop = 8 * first - self.low
        gone = (1 << drop) - 1
        self.edits += (self.plus & gone).bit_count() - (self.minus & gone).bit_count() + end - start
        self.plus, self.minus = self.plus >> drop, self.minus >> drop
        self.plus |= ((1 << (8 * last - self.high)) - 1) << (self.high - 8 * first)
        self.low, self.high = 8 * first, 8 * last
        self.full, self.size = (1 << 8 * (last - first)) - 1, last - first + 1
        table = self.places[:, first : last + 1]
        if self.high < 8 * (self.places.shape[1] - 1):
            table = table.copy()
            table[:, -1] = 0
        return table.take(self.a[start:end], 0)

    def done(self) -> int:
        rows = (1 << (self.n - self.low)) - 1
        return self.edits + (self.plus & rows).bit_count() - (self.minus & rows).bit_count()


def _together(group: list[tuple]) -> list[int]:
    """``_within`` of each (a, b, most, extra): bands lie side by side in whole numbers, each with bits to spare that take its carry."""
    bands, start = [_Band(*x) for x in group], 0
    going = bands
    while going:
        end = min(min(x.m for x in going), start + max(256, min(x.above + x.below for x in going) // 4))
        same_of = np.concatenate([x.move(start, end) for x in going], 1)
        size, table = same_of.shape[1], same_of.tobytes()
        plus, minus, full, ones, at = 0, 0, 0, 0, 0
        for x in going:
            plus, minus, full, ones = plus | x.plus << at, minus | x.minus << at, full | x.full << at, ones | 1 << at
            at += 8 * x.size
        for k in range(0, len(table), size):
            same = int.from_bytes(table[k : k + size], "little") | minus
            flat = ((((same & plus) + plus) ^ plus) | same) & full
            up = (minus | (plus | flat) ^ full) << 1 | ones
            minus, plus = up & flat, ((plus & flat) << 1 | (up | flat) ^ full) & full
        at = 0
        for x in going:
            x.plus, x.minus = plus >> at & x.full, minus >> at & x.full
            at += 8 * x.size
        start, going = end, [x for x in going if x.m > end]
    return [x.done() for x in bands]


def _within(a, b, most: int, extra: int) -> int:
    """The edit distance if it is at most ``most``, else some number of edits that suffices; ``a`` is not the shorter one.

    Rows are the places of ``b``. A stretch of columns sees the rows that its diagonals meet: rows above it are left at the
    cost of moving along their last one, rows below it come in at one edit each, so no value is too low, and those of
    alignments within the diagonals are exact.
    """
    m, n = len(a), len(b)
    above, below = _reach(m, n, most, extra)
    at: dict = {}
    for k, x in enumerate(b):
        at.setdefault(x, []).append(k)
    row = bytearray(n // 8 + 1)
    for x, places in at.items():
        bits = row[:]
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        at[x] = int.from_bytes(bits, "little")
    step = max(256, (above + below) // 4)
    plus, minus, edits, low, high = 0, 0, 0, 0, 0
    for start in range(0, m, step):
        end = min(m, start + step)
        first, last = min(n, max(0, start - above)), min(n, end + below)
        drop = first - low
        if drop:
            gone = (1 << drop) - 1
            edits += (plus & gone).bit_count() - (minus & gone).bit_count()
            plus, minus = plus >> drop, minus >> drop
        plus |= ((1 << (last - high)) - 1) << (high - first)
        low, high = first, last
        full, own = (1 << (high - low)) - 1, {}
        for x in a[start:end]:
            same = own.get(x)
            if same is None:
                same = own[x] = at.get(x, 0) >> low & full
            same |= minus
            flat = ((((same & plus) + plus) ^ plus) | same) & full
            up = (minus | (plus | flat) ^ full) << 1 | 1
            minus, plus = up & flat, ((plus & flat) << 1 | (up | flat) ^ full) & full
        edits += end - start
    return edits + plus.bit_count() - minus.bit_count()


def _differing(a, b) -> tuple:
    """Both sequences without what they share at their ends."""
    least, at = min(len(a), len(b)), 0
    while at < least and a[at] == b[at]:
        at += 1
    end = 0
    while end < least - at and a[-1 - end] == b[-1 - end]:
        end += 1
    return a[at : len(a) - end], b[at : len(b) - end]


def edits_between(a: Column, b: Column, once: bool = False) -> Column:
    """Edit distance of strings or of word lists, whole; Spark's own takes minutes for texts of some ten thousand characters.

    ``once``: a filter on the result must not be pushed below it, where it would be worked out a second time.
    """

    def edits(x: pd.Series, y: pd.Series) -> pd.Series:
        known = [k for k, (p, q) in enumerate(zip(x, y)) if p is not None and q is not None]
        found = dict(zip(known, distances([_differing(x[k], y[k]) for k in known])))
        return pd.Series([found.get(k) for k in range(len(x))], dtype="Int32")

    run = in_pieces(lambda: edits, "int", 2)
    return (run.asNondeterministic() if once else run)(a, b)


def word_error(hyp: Column, ref: Column) -> Column:
    return token_error(tokens(normalise(hyp)), tokens(normalise(ref)))


def token_error(h: Column, r: Column) -> Column:
    """``word_error`` of the tokens of normalised texts."""
    edits, size = edits_between(h, r), F.size(r)
    return F.struct(_rate(edits, size, F.size(h)).alias("rate"), edits.alias("edits"), size.alias("ref_size"))


def plain_error(hyp: Column, ref: Column) -> Column:
    """Character error without normalising; 0 for an empty reference."""
    return F.when(F.char_length(ref) == 0, 0.0).otherwise(edits_between(hyp, ref) / F.nullif(F.char_length(ref), F.lit(0)))


def change_ratio(a: Column, b: Column, once: bool = False) -> Column:
    """Edits over the longer length: 0 for two empty texts, 1 for one; ``once`` as in ``edits_between``."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 0.0).otherwise(edits_between(a, b, once) / F.nullif(longest, F.lit(0)))


def marker_rate(text: Column) -> Column:
    """Share of words that are exactly ``[?]``."""
    t = tokens(text)
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.filter(t, lambda w: w == "[?]")) / F.nullif(F.size(t), F.lit(0)))


def uncertainty(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNCERTAIN))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_letter_or_two(text: Column) -> Column:
    """Whether the whole text is one or two letters."""
    return F.rlike(strip(text), F.lit(r"^\p{L}{1,2}$"))


def _of(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def single_confidence(text: Column) -> Column:
    """Confidence in a lone reading, at most 0.7, from its markers, length and repetition."""

    def of(x: Column) -> Column:
        t, marks = x["t"], x["marks"]
        n = F.size(t)
        conf = F.lit(0.70) - F.lit(1.5) * marks / F.greatest(n, F.lit(1))
        conf = conf - F.when(n < 3, 0.15).otherwise(0.0) - F.when((n <= 5) & (marks == 0), 0.10).otherwise(0.0)
        unique = F.size(F.array_distinct(F.transform(t, F.lower)))
        conf = conf - F.when((n > 5) & (unique / F.greatest(n, F.lit(1)) < 0.15), 0.2).otherwise(0.0)
        conf = _of(conf, lambda c: F.when((n <= 2) & is_letter_or_two(text), F.least(c, F.lit(0.45))).otherwise(c))  # white space is all that may part letters from words
        return F.when(n == 0, 0.0).otherwise(F.round(F.least(F.lit(0.70), F.greatest(F.lit(0.0), conf)), 3))

    return _of(F.struct(tokens(text).alias("t"), uncertainty(text).alias("marks")), of)


def confidence_level(text: Column, confidence: Column) -> Column:
    def of(x: Column) -> Column:
        n, marks = x["n"], x["marks"]
        low = (x["confidence"] < 0.5) | (marks >= 3) | ((n < 5) & (~F.startswith(strip(text), F.lit("[")) | is_letter_or_two(text)))
        low = low | (marks / F.greatest(n, F.lit(1)) > 0.1) | F.contains(x["lower"], F.lit("[illegible")) | F.contains(x["lower"], F.lit("page faint"))
        return F.when(low, "LOW").otherwise("HIGH")

    return _of(F.struct(F.size(tokens(text)).alias("n"), uncertainty(text).alias("marks"), confidence.alias("confidence"), F.lower(text).alias("lower")), of)


def read_confidence(text: Column) -> Column:
    """One less 0.05 for each ``[?]`` and 0.1 for each ``[illegible``, between 0 and 0.95."""
    raw = F.lit(1.0) - 0.05 * F.regexp_count(text, F.lit(r"\[\?\]")) - 0.1 * F.regexp_count(text, F.lit(r"\[illegible"))
    return F.greatest(F.lit(0.0), F.least(F.lit(0.95), raw))


def line_tokens(text: Column) -> Column:
    """Words with a line feed token between lines."""
    return F.filter(F.split(F.regexp_replace(text, "\n", " \u0001 "), "[ \t\r\f\u000b]+"), lambda w: w != "")


def ngrams(words: Column, n: int = 3) -> Column:
    """Distinct word n-grams, joined by spaces; one short gram for fewer words, none for none."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice(words, k + 1, count).alias(f"w{k}") for k in range(n)])
    grams = F.transform(parts, lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(n)]))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(both, F.lit(0)))


def strip_chatter(text: Column) -> Column:
    """Up to three opening and three closing lines of commentary go."""
    head = F.regexp_replace(text, rf"^(?:(?i:{PREAMBLES})[^\n]*\n){{1,3}}", "")
    return F.regexp_replace(head, rf"(?:\n(?i:{TRAILERS})[^\n]*){{1,3}}$", "")


def strip_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,3}\s+", "")
    return F.regexp_replace(out, r"(?<!\w)_([^_]+)_(?!\w)", "$1")


def drop_repeated_lines(text: Column, most: int = 2) -> Column:
    """Keep the first ``most`` occurrences of each non-blank line, by trimmed lower case, in one pass over the lines."""

    def kept(t: str) -> str:
        seen: dict[str, int] = {}
        lines = []
        for line in t.split("\n"):
            key = line.strip().lower()
            seen[key] = seen.get(key, 0) + 1
            if not key or seen[key] <= most:
                lines.append(line)
        return "\n".join(lines)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(kept, na_action="ignore")

    return run(text)


def alternatives(text: Column) -> Column:
    """array<struct(raw, options)> of every ``[?alt: a/b]``."""
    found = F.regexp_extract_all(text, F.lit(r"(\[\?alt:[^\]]*\])"), 1)
    return F.transform(found, lambda m: F.struct(m.alias("raw"), F.transform(F.split(F.regexp_extract(m, r"\[\?alt:\s*([^\]]*)\]", 1), "/"), lambda x: F.trim(x)).alias("options")))


def page_number(name: Column) -> Column:
    page = F.regexp_extract(name, r"(?i)page[_-]?(\d+)", 1)
    numbers = F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)
    return F.coalesce(F.nullif(page, F.lit("")), F.try_element_at(numbers, F.lit(-1)), F.lit("0")).cast("long")


def safe_name(text: Column, put: str = "_") -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", put)


def hints(text: Column, most: int = 50) -> Column:
    """Comma-separated hints longer than two characters, first of each spelling, at most ``most``."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.char_length(x) > 2)
    keys = F.transform(parts, F.lower)
    first = F.filter(F.transform(parts, lambda x, i: F.when(F.array_position(keys, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    return F.slice(first, 1, most)


def term_accuracy(hyp: Column, ref: Column, single: list[str], several: list[str]) -> Column:
    """struct(accuracy, correct, total, missed): reference terms found in the hypothesis; accuracy -1 without terms."""
    h, r = normalise(hyp), normalise(ref)
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    want = F.array_union(F.array_intersect(F.array_distinct(tokens(r)), lit(single)), F.filter(lit(several), lambda t: F.contains(r, t)))
    have = F.array_union(F.array_intersect(F.array_distinct(tokens(h)), lit(single)), F.filter(lit(several), lambda t: F.contains(h, t)))
    total, missed = F.size(want), F.array_sort(F.array_except(want, have))
    correct = total - F.size(missed)
    return F.struct(F.when(total == 0, -1.0).otherwise(correct / F.nullif(total, F.lit(0))).alias("accuracy"), correct.alias("correct"), total.alias("total"), missed.alias("missed"))


def deletions(word: Column) -> Column:
    """A word and every form with one character less: two words one edit apart share one of these."""
    n = F.char_length(word)
    less = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.array_append(less, word))


def one_edit(a: Column, b: Column) -> Column:
    """Insertion, deletion, replacement or swap of neighbours, or equal."""
    n = F.char_length(a)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i = F.try_element_at(differ, F.lit(1))
    swap = (n == F.char_length(b)) & (F.size(differ) == 2) & (F.try_element_at(differ, F.lit(2)) == i + 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return (F.levenshtein(a, b) <= 1) | F.coalesce(swap, F.lit(False))


def capital_like(word: Column, model: Column) -> Column:
    """``word`` in the case of ``model``: upper, capitalised or as it is."""
    first = F.substring(model, 1, 1)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))
    return F.when((F.upper(model) == model) & (F.lower(model) != model) & (F.char_length(model) > 1), F.upper(word)).when(F.upper(first) != F.lower(first), F.when(F.upper(first) == first, capital).otherwise(word)).otherwise(word)


def bare(word: Column) -> Column:
    """struct(before, core, after): signs around the letters peeled off."""
    at = r"^([^\p{L}]*)(.*?)([^\p{L}]*)$"
    return F.struct(*[F.regexp_extract(word, at, k + 1).alias(name) for k, name in enumerate(("before", "core", "after"))])


def strip_accents(text: Column) -> Column:
    return F.translate(text, "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")


def inference_pieces(text: Column, most: int = 240) -> Column:
    """Sentences packed greedily to pieces of at most ``most`` characters; longer sentences are cut."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    cut = F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.char_length(s) - 1) / most), F.lit(0)).cast("int")), lambda k: F.substr(s, k * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        fits = F.char_length(joined) <= most
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, joined).otherwise(s).alias("open"))

    return F.aggregate(cut, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
