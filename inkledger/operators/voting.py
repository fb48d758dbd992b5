"""Merging several readings of one sample: agreement, word votes, character resolution, and the strategies on top.

Sequence matching (gestalt, with the standard library's junk rule) has no Catalyst form, so alignments run in
Arrow-batched UDFs; everything around them is relational. Readings are ordered by provider name, so results do not
depend on arrival.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text
from inkledger.functions.matching import SequenceMatcher
from inkledger.functions.pieces import in_pieces

#: Look-alike strings and their canonical form (the first two columns are interchangeable readings).
LOOKALIKES = (("rn", "m"), ("cl", "d"), ("ri", "n"), ("uu", "w"), ("u", "v"), ("a", "o"), ("n", "h"), ("e", "c"), ("f", "t"), ("q", "g"), ("0", "O"), ("1", "l"), ("1", "I"), ("I", "l"), ("5", "S"), ("2", "Z"), ("6", "G"), ("8", "B"))
#: Character pairs counted as confusions in the error taxonomy, either way round.
CONFUSED = {frozenset(p) for p in (("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("2", "z"), ("6", "g"), ("8", "b"), ("9", "q"), ("7", "1"), ("4", "9"), ("3", "8"), ("r", "n"), ("c", "l"), ("u", "v"), ("a", "o"), ("n", "h"), ("e", "c"), ("b", "d"), ("p", "r"), ("h", "k"), ("m", "n"), ("g", "c"), ("e", "f"), ("p", "f"), ("t", "+"), ("x", "*"))}
CONFUSED_PAIRS = {p for pair in CONFUSED for p in (tuple(pair), tuple(pair)[::-1])}
VOTE_CAP = 0.95
#: Below the first a reading is silent among three or more, below the second it is left out among four or more.
SILENT, APART = 0.60, 0.20


def line_words(s: str) -> list[str]:
    out: list[str] = []
    for k, line in enumerate((s or "").split("\n")):
        out += ["\n"] * (k > 0) + line.split()
    return out


def agreement(a: Column, b: Column) -> Column:
    """Matching ratio of the word sequences: 1 for two empty texts, 0 for one."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = [(line_words(p), line_words(q)) for p, q in zip(x, y)]
        return pd.Series([SequenceMatcher(p, q).ratio() if p and q else float(not p and not q) for p, q in pairs])

    return in_pieces(lambda: ratio, "double", 2)(a, b)


def word_diff(a: Column, b: Column, most: int = 30) -> Column:
    """array<struct(pos, word_a, word_b)> of differing stretches, without line feeds."""

    def differ(p: str, q: str) -> list[dict]:
        x, y = line_words(p), line_words(q)
        join = lambda ws: " ".join(w for w in ws if w != "\n") or "(empty)"
        found = [{"pos": i, "word_a": join(x[i:j]), "word_b": join(y[m:n])} for tag, i, j, m, n in SequenceMatcher(x, y).get_opcodes() if tag != "equal"]
        return [d for d in found if d["word_a"] != d["word_b"]][:most]

    @F.pandas_udf("array<struct<pos:int,word_a:string,word_b:string>>")
    def diff(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([differ(p, q) for p, q in zip(x, y)])

    return diff(a, b)


def error_taxonomy(hyp: Column, ref: Column) -> Column:
    """struct(confusion_pair, substitution, insertion, deletion) of characters, over normalised texts."""

    def count(h: str, r: str) -> dict:
        out = dict.fromkeys(("confusion_pair", "substitution", "insertion", "deletion"), 0)
        for tag, i, j, m, n in SequenceMatcher(r or "", h or "").get_opcodes():
            if tag == "replace":
                pairs = list(zip((r or "")[i:j], (h or "")[m:n]))
                near = sum(p in CONFUSED_PAIRS for p in pairs)
                out["confusion_pair"] += near
                out["substitution"] += len(pairs) - near
                out["deletion"] += max(0, (j - i) - (n - m))
                out["insertion"] += max(0, (n - m) - (j - i))
            elif tag == "delete":
                out["deletion"] += j - i
            elif tag == "insert":
                out["insertion"] += n - m
        return out

    def classify(h: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([count(x, y) for x, y in zip(h, r)], columns=["confusion_pair", "substitution", "insertion", "deletion"])

    counts = in_pieces(lambda: classify, "confusion_pair int, substitution int, insertion int, deletion int", 2)
    return counts(text.normalise(hyp), text.normalise(ref))


def pair_name(other: str, canonical: str) -> str:
    """The key of a look-alike pair in writers' profiles and audit trails."""
    return f"{other}\u2194{canonical}"


PAIRS = {order: (other, canonical) for other, canonical in reversed(LOOKALIKES) for order in ((canonical, other), (other, canonical))}


def resolve_characters(candidates: list[str], weights: list[float] | None = None, habits: dict[str, str] | None = None) -> str | None:
    """The reading of two words that differ only by look-alikes: the writer's habit for a pair, else its canonical form.

    Only the differing stretches decide. None for three or more words, or if anything else differs.
    """
    words = list(dict.fromkeys(candidates))
    if len(words) != 2:
        return words[0] if len(words) == 1 else None
    left, right = words
    out = ""
    for tag, i, j, m, n in SequenceMatcher(left, right).get_opcodes():
        x, y = left[i:j], right[m:n]
        stretch = [(x, y)] if (x, y) in PAIRS or tag == "equal" else list(zip(x, y)) if len(x) == len(y) else [(x, y)]
        for p, q in stretch:
            if p == q:
                out += p
                continue
            pair = PAIRS.get((p, q))
            if pair is None:
                return None
            habit = (habits or {}).get(pair_name(*pair))
            out += habit if habit in pair else pair[1]
    return out


def vote_words(texts: list[str], weights: list[float], habits: dict[str, str] | None = None, match=None) -> dict:
    """text, confidence and disagreements of a weighted vote, word by word, along the heaviest reading.

    Of a replaced stretch, the shorter side's last word stands for what it lacks: every place of the anchor gets a vote.
    ``match`` gives the matcher of two readings' words by their places.
    """
    anchor_at = max(range(len(texts)), key=lambda k: (weights[k], -k))
    split = [line_words(t) for t in texts] if match is None else match.words
    match = match or (lambda x, y: SequenceMatcher(split[x], split[y]))
    anchor = split[anchor_at]
    votes: list[dict[str, float]] = [{} for _ in anchor]
    for k, words in enumerate(split):
        weight = weights[k]
        for tag, i, j, m, n in match(anchor_at, k).get_opcodes() if k != anchor_at else [("equal", 0, len(anchor), 0, len(anchor))]:
            if tag == "equal":
                for word, own in zip(anchor[i:j], votes[i:j]):
                    own[word] = own.get(word, 0.0) + weight
            elif tag == "replace":
                for step in range(max(j - i, n - m)):
                    own, word = votes[min(i + step, j - 1)], words[min(m + step, n - 1)]
                    own[word] = own.get(word, 0.0) + weight
    out, agreed, counted, apart = [], 0, 0, []
    for own in votes:
        if len(own) == 1 and "\n" not in own:
            counted += 1
            agreed += 1
            out.extend(own)
            continue
        if set(own) <= {"\n"}:
            out.append("\n")
            continue
        counted += 1
        best, *others = sorted(own, key=lambda w: -own[w])
        real = [w for w in (best, *others) if w != "\n"]
        if own[best] > 0.5 * sum(own.values()):
            out.append(best)
            if "\n" not in (best, others[0]):
                apart.append(f"'{others[0]}' vs '{best}' (majority)")
        elif (fixed := resolve_characters(real, None, habits)) is not None:
            out.append(fixed)
        else:
            out.append(best)
            runners = "/".join([w for w in others if w != "\n"][:2])
            if runners and best != "\n":
                out.append(f"[?alt: {runners}]")
                apart.append(f"'{best}' vs '{runners}' (no majority)")
    lines: list[list[str]] = [[]]
    for word in out:
        if word == "\n":
            lines.append([])
        else:
            lines[-1].append(word)
    return {"text": "\n".join(map(" ".join, lines)).strip(), "confidence": min(VOTE_CAP, agreed / counted) if counted else 0.0, "disagreements": apart[:20]}


class Matches:
    """Matchers of one sample's readings, each made once; a pair's agreement is that of its words."""

    def __init__(self, texts: list[str]):
        self.words, self.made = [line_words(t) for t in texts], {}

    def __call__(self, x: int, y: int) -> SequenceMatcher:
        if (x, y) not in self.made:
            self.made[x, y] = SequenceMatcher(self.words[x], self.words[y])
        return self.made[x, y]

    def agreement(self, x: int, y: int) -> float:
        p, q = self.words[x], self.words[y]
        return self(x, y).ratio() if p and q else float(not p and not q)


def vote_readings(providers: list[str], texts: list[str], weights: list[float], habits: dict[str, str] | None = None) -> dict:
    """``vote_words`` of one sample's readings, ordered by provider, without those that agree with no other provider's.

    A lone reading is its own text without confidence.
    """
    n, match, best = len(texts), Matches(texts), {}
    if n >= 3:  # fewer readings all vote
        for x in range(n):
            for y in range(x + 1, n):
                if providers[x] is not None and providers[x] != providers[y]:
                    agree = match.agreement(x, y)
                    for p in (providers[x], providers[y]):
                        best[p] = max(best.get(p, agree), agree)
    apart = [n >= 4 and best.get(p, 1.0) < APART for p in providers]
    silent = [n >= 3 and best.get(p, 1.0) < SILENT for p in providers]
    out = [x and n - sum(apart) >= 2 for x in apart]
    notes = []
    for p, x, y, z in zip(providers, apart, silent, out):
        notes += [f"'{p}' excluded as outlier (agreement < 20% with all others)"] * x
        notes += [f"'{p}' zero-weighted: potential hallucination (agreement < 60%)"] * (y and not z)
    weights = [0.0 if x else w for w, x in zip(weights, silent)]
    stay = [k for k in range(n) if not out[k]]
    if len(stay) == 1:
        return {"text": texts[stay[0]], "confidence": None, "disagreements": notes}
    if len(stay) < n:
        chosen = [[own[k] for k in stay] for own in (texts, weights)]
        done = vote_words(*chosen, habits)
    else:
        done = vote_words(texts, weights, habits, match)
    return {**done, "disagreements": done["disagreements"] + notes}


def consensus(readings: DataFrame, habits: DataFrame | None = None) -> DataFrame:
    """sample_id, text, confidence, level, disagreements, strategy from (sample_id, provider, text, confidence, weight).

    Empty readings do not vote; a sample with none gives an empty text. With three or more readings, one that agrees
    with none (best agreement under 0.6) loses its vote; with four or more, one under 0.2 with all is left out, never
    below two. Weights scale with confidence. ``habits`` has sample_id and habits (map of look-alike pair to form).

    A sample's readings meet once, and each pair of them is matched once.
    """
    counts = (F.coalesce("text", F.lit("")) != "") & F.col("sample_id").isNotNull()
    conf = F.when(F.coalesce("confidence", F.lit(0.0)) > 0, F.col("confidence")).otherwise(text.single_confidence(F.col("text")) / 0.70)
    reading = F.struct("provider", "text", (F.col("weight") * (0.4 + 0.6 * conf)).alias("weight"))
    own = readings.select("sample_id", F.when(counts, reading).alias("reading"))
    grouped = own.groupBy("sample_id").agg(F.array_sort(F.collect_list("reading")).alias("bag"))
    if habits is None:
        grouped = grouped.withColumn("habits", F.lit(None).cast("map<string,string>"))
    else:
        grouped = grouped.join(habits.select("sample_id", "habits"), "sample_id", "left")
    nothing = {"text": None, "confidence": None, "disagreements": []}

    def vote(names: pd.Series, texts: pd.Series, weights: pd.Series, known: pd.Series) -> pd.DataFrame:
        done = [vote_readings(list(p), list(t), list(w), dict(h) if h is not None else None) if len(t) else nothing for p, t, w, h in zip(names, texts, weights, known)]
        return pd.DataFrame(done, columns=["text", "confidence", "disagreements"])

    part = lambda name: F.transform("bag", lambda r: r[name])
    votes = in_pieces(lambda: vote, "text string, confidence double, disagreements array<string>", 4)
    voted = grouped.select("sample_id", votes(part("provider"), part("text"), part("weight"), F.col("habits")).alias("v")).select("sample_id", "v.*")
    alone = F.col("confidence").isNull()
    conf = F.coalesce("confidence", text.single_confidence(F.col("text")))
    voted = voted.select("sample_id", "text", "disagreements", conf.alias("confidence"), F.when(F.col("text").isNotNull() & alone, "vote_partial").otherwise("vote").alias("strategy"))
    level = F.when(F.col("text").isNull(), "LOW").otherwise(text.confidence_level(F.col("text"), F.col("confidence")))
    return voted.select("sample_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.round("confidence", 3), F.lit(0.0)).alias("confidence"), level.alias("level"), "disagreements", "strategy")


def lessons_from(model: Column, corrected: Column) -> Column:
    """array<string>: one sentence for each replaced, missing or added stretch of words."""

    def lessons(a: str, b: str) -> list[str]:
        x, y, out = (a or "").split(), (b or "").split(), []
        for tag, i, j, m, n in SequenceMatcher(x, y).get_opcodes():
            p, q = " ".join(x[i:j]), " ".join(y[m:n])
            if tag == "replace":
                out.append(f"Model read '{p}' but correct reading is '{q}'")
            elif tag == "delete":
                out.append(f"Model added '{p}' which is not in the original")
            elif tag == "insert":
                out.append(f"Model missed '{q}'")
        return out

    def extract(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lessons(p, q) for p, q in zip(a, b)], dtype=object)

    return in_pieces(lambda: extract, "array<string>", 2)(model, corrected)
