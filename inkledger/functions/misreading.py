"""Seeded misreadings of clean texts: pairs for training a corrector.

Every change is drawn for a place of the clean text, from a hash of seed, key, rule and place; all places of a text
are drawn at once. A place takes the first of its applicable changes whose draw falls under the rule's rate, a
change of two letters keeps the next place as it is, and the pieces are put together at the end. So a change never
builds on another one, a text's form depends on nothing but seed, key and text, and no generator is shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.pieces import in_pieces

# What a pattern of one or two letters is misread as, with weights.
CONFUSIONS = (
    ("rn", "m", 8), ("m", "rn", 4), ("cl", "d", 7), ("d", "cl", 3), ("ii", "u", 6), ("u", "ii", 2), ("oo", "co", 4), ("co", "oo", 2), ("ri", "n", 5), ("n", "ri", 2),
    ("vv", "w", 5), ("w", "vv", 2), ("ni", "m", 4), ("nn", "m", 4), ("ll", "h", 3), ("h", "ll", 1), ("ee", "ce", 3), ("le", "te", 3), ("te", "le", 3), ("a", "o", 5),
    ("o", "a", 5), ("e", "c", 5), ("c", "e", 4), ("i", "l", 5), ("l", "i", 4), ("u", "v", 4), ("v", "u", 3), ("s", "z", 2), ("z", "s", 2), ("g", "q", 3),
    ("q", "g", 2), ("h", "n", 3), ("n", "h", 2), ("f", "t", 3), ("t", "f", 2),
)
# Digits and letters that are misread as each other, with weights.
DIGITS = (
    ("0", "o", 4), ("o", "0", 2), ("1", "l", 4), ("l", "1", 2), ("1", "I", 3), ("I", "1", 2), ("5", "S", 3), ("S", "5", 2), ("8", "B", 3), ("B", "8", 2),
    ("2", "Z", 2), ("Z", "2", 2), ("6", "G", 2), ("G", "6", 2), ("g", "9", 2), ("9", "g", 2),
)
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc"
# Rates of the changes, and of the severities among texts, light, middling and heavy.
RATES = {
    "pair": (0.015, 0.04, 0.08), "digit": (0.01, 0.03, 0.06), "double": (0.004, 0.012, 0.025), "drop": (0.004, 0.012, 0.025), "swap": (0.003, 0.008, 0.018),
    "join": (0.005, 0.015, 0.030), "cut": (0.003, 0.008, 0.015), "case": (0.005, 0.01, 0.020), "stop": (0.05, 0.10, 0.20), "accents": (0.6, 0.6, 0.6),
}
SEVERITIES = (0.25, 0.60, 0.15)
LONG_WORD = 6


class Lottery:
    """Uniform numbers in [0, 1) that depend on seed, key, rule and place only."""

    def __init__(self, seed: int, key: str):
        self.base = np.uint64(int.from_bytes(hashlib.blake2b(f"{seed}/{key}".encode(), digest_size=8).digest(), "little"))

    def draw(self, rule: str, places: np.ndarray) -> np.ndarray:
        own = np.uint64(int.from_bytes(hashlib.blake2b(rule.encode(), digest_size=8).digest(), "little"))
        with np.errstate(over="ignore"):
            x = self.base ^ (own + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)

    def once(self, rule: str) -> float:
        return float(self.draw(rule, np.zeros(1, np.int64))[0])


def _choices(rows) -> dict[str, tuple[list[str], np.ndarray]]:
    """Per pattern: what it becomes, and the upper ends of the shares."""
    found: dict[str, list[tuple[str, int]]] = {}
    for pattern, becomes, weight in rows:
        found.setdefault(pattern, []).append((becomes, weight))
    return {p: ([b for b, _ in rows], np.cumsum([w for _, w in rows]) / sum(w for _, w in rows)) for p, rows in found.items()}


_PAIRS, _DIGITS = _choices(CONFUSIONS), _choices(DIGITS)


def _severity(lot: Lottery) -> int:
    return int(np.searchsorted(np.cumsum(SEVERITIES)[:-1], lot.once("severity"), "right"))


def _proposals(text: str, lot: Lottery, level: int) -> Iterator[tuple[int, int, str]]:
    """(place, letters taken, what stands there instead), by place; the first rule that applies at a place speaks for it."""
    places = np.arange(len(text))
    hits = {rule: lot.draw(rule, places) < RATES[rule][level] for rule in ("pair", "digit", "swap", "double", "drop", "case", "join", "cut")}
    choice = lot.draw("choice", places)
    for at in np.flatnonzero(np.logical_or.reduce(list(hits.values()))).tolist():
        one, two = text[at], text[at : at + 2]
        drawn = {rule for rule, hit in hits.items() if hit[at]}
        pick = lambda table, pattern: table[pattern][0][int(np.searchsorted(table[pattern][1], choice[at], "right"))]  # noqa: E731, B023
        if "pair" in drawn and two in _PAIRS:
            yield at, 2, pick(_PAIRS, two)
        elif "pair" in drawn and one in _PAIRS:
            yield at, 1, pick(_PAIRS, one)
        elif "digit" in drawn and one in _DIGITS:
            yield at, 1, pick(_DIGITS, one)
        elif "swap" in drawn and len(two) == 2 and two.isalpha():
            yield at, 2, two[1] + two[0]
        elif "double" in drawn and one.isalpha():
            yield at, 1, one + one
        elif "drop" in drawn and one.isalpha() and 0 < at < len(text) - 1:
            yield at, 1, ""
        elif "case" in drawn and one.isalpha():
            yield at, 1, one.swapcase()
        elif "join" in drawn and one == " ":
            yield at, 1, ""
        elif "cut" in drawn and one != " " and (at == 0 or text[at - 1] == " "):
            word = text[at:].split(" ", 1)[0] if len(text) - at < 64 else text[at : at + 64].split(" ", 1)[0]
            if len(word) > LONG_WORD:
                inside = 2 + int(choice[at] * (len(word) - 3))
                yield at, inside, text[at : at + inside] + " "


def misread(text: str, key: str, seed: int = 42) -> str:
    """A form of the text that differs from it wherever two unequal neighbours can be swapped."""
    lot = Lottery(seed, key)
    level = _severity(lot)
    source = text.translate(str.maketrans(ACCENTED, PLAIN)) if lot.once("accents") < RATES["accents"][level] else text
    out, upto = [], 0
    for at, taken, instead in _proposals(source, lot, level):
        if at >= upto:
            out += [source[upto:at], instead]
            upto = at + taken
    made = "".join(out) + source[upto:]
    if made[-1:] in set(".,;:!?") and made and lot.once("stop") < RATES["stop"][level]:
        made = made[:-1]
    if made != text or len(text) < 2:
        return made
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    apart = np.flatnonzero(codes[1:] != codes[:-1])
    if not len(apart):
        return made
    at = int(apart[np.argmin(lot.draw("last resort", apart))])
    return text[:at] + text[at + 1] + text[at] + text[at + 2 :]


def corrupt(text: Column, key: Column, seed: int = 42) -> Column:
    """A misread form of each text; equal keys and texts give equal forms. Null stays null."""

    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else misread(t, str(k), seed) for t, k in zip(texts, keys)], dtype=object)

    return in_pieces(lambda: run, "string", 2)(text, key.cast("string"))


def build_pairs(clean: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """(key, corrupted, clean)."""
    return clean.select(key, corrupt(F.col(text), F.col(key), seed).alias("corrupted"), F.col(text).alias("clean"))
