"""Conservative dictionary correction by domain. Vocabularies are small and travel with the function, so nothing shuffles."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions.pieces import in_pieces
from inkledger.operators.voting import LOOKALIKES, pair_name

# The correction vocabularies, single words and two-word phrases.
BIOLOGY = tuple("""
mitosis meiosis mitochondria chloroplast photosynthesis respiration glycolysis ribosome chromosome chromatid
centromere telomere prophase metaphase anaphase telophase interphase cytokinesis deoxyribose nucleotide adenine
thymine guanine cytosine uracil transcription translation replication polymerase helicase ligase primase topoisomerase
nucleosome histone chromatin plasmid prokaryote eukaryote organelle cytoplasm nucleus vacuole lysosome peroxisome
endoplasmic reticulum golgi apparatus membrane phospholipid bilayer osmosis diffusion concentration gradient enzyme
substrate catalysis inhibitor allosteric denaturation protein peptide amino acid carbohydrate glucose fructose
sucrose lactose starch cellulose lipid fatty glycerol absorption digestion circulation excretion
homeostasis population ecosystem biodiversity evolution natural selection mutation allele genotype phenotype
dominant recessive heterozygous homozygous gamete zygote embryo placenta differentiation stem cell apoptosis
receptor hormone neurotransmitter synapse axon dendrite antibody antigen lymphocyte phagocyte pathogen bacteria
virus fungus protist kingdom species taxonomy phylogeny
""".split())
CHEMISTRY = tuple("""
hydrogen oxygen nitrogen carbon sulfur phosphorus sodium potassium calcium magnesium chlorine fluorine
molecule compound element isotope electron proton neutron orbital valence covalent ionic metallic
electronegativity oxidation reduction titration molarity molality solution solvent solute precipitation equilibrium
catalyst activation enthalpy entropy gibbs exothermic endothermic reaction reactant product stoichiometry
mole avogadro bohr quantum spectrum wavelength absorbance transmittance spectrophotometer chromatography
electrophoresis centrifuge distillation filtration crystallization sublimation evaporation condensation
""".split())
GENERAL = tuple("""
approximately therefore however although because similar different compare contrast describe explain
analyze evaluate calculate determine identify define significant negligible proportional inversely directly
increase decrease constant variable hypothesis experiment observation conclusion evidence data result average
standard deviation percentage measurement temperature pressure volume mass weight density velocity
acceleration frequency amplitude wavelength intensity
""".split())
BIOLOGY_PHRASES = tuple("""
natural selection, stem cell, amino acid, amino acids, fatty acid, fatty acids, nucleic acid, nucleic acids,
cell membrane, cell wall, cell cycle, cell division, active transport, passive transport, facilitated diffusion,
endoplasmic reticulum, golgi apparatus, krebs cycle, citric acid, electron transport, light reactions, dark reactions,
calvin cycle, genetic code, messenger rna, transfer rna, ribosomal rna, double helix, base pair, base pairs,
punnett square, phenotypic ratio, genotypic ratio, food chain, food web, trophic level, biotic factor, biotic factors,
abiotic factor, abiotic factors, carrying capacity, limiting factor, limiting factors, white blood, red blood,
blood cell, blood cells, immune system, nervous system, digestive system, respiratory system, circulatory system
""".replace("\n", " ").strip().split(", "))
CHEMISTRY_PHRASES = tuple("""
periodic table, atomic number, atomic mass, atomic weight, mass number, ionic bond, ionic bonds, covalent bond,
covalent bonds, hydrogen bond, hydrogen bonds, chemical equation, balanced equation, limiting reagent,
limiting reactant, activation energy, reaction rate, equilibrium constant, specific heat, heat capacity,
boiling point, melting point, freezing point, phase change, phase transition, ideal gas, partial pressure,
vapor pressure, electron configuration, oxidation state, oxidation number, redox reaction, acid base, strong acid,
weak acid, strong base, weak base
""".replace("\n", " ").strip().split(", "))
#: Words and phrases by domain; an unknown domain has the general words.
DOMAINS = {
    "biology": (BIOLOGY + GENERAL, BIOLOGY_PHRASES),
    "chemistry": (CHEMISTRY + GENERAL, CHEMISTRY_PHRASES),
    "general": (GENERAL, ()),
    "science": (BIOLOGY + CHEMISTRY + GENERAL, BIOLOGY_PHRASES + CHEMISTRY_PHRASES),
}
#: A digit or bracket in front, or an abbreviation.
SKIP = re.compile(r"\d|\[|[A-Z]{1,4}$")
#: Longer tokens are not remembered, so that what is remembered is bounded.
REMEMBERED = 64


def near(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, replacement or swap of neighbours apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    p, q = a[k:], b[k:]
    return p[1:] == q[1:] or p[1:] == q or p == q[1:] or (p[:2] == q[:2][::-1] and p[2:] == q[2:])


class Vocabulary:
    """Finds neighbours at distance one by deletion keys: two near words share a form with one letter less."""

    def __init__(self, words):
        self.words = set(words)
        self.keys: dict[str, set[str]] = {}
        for w in self.words:
            for key in self._keys(w):
                self.keys.setdefault(key, set()).add(w)

    @staticmethod
    def _keys(w: str) -> set[str]:
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    def near(self, w: str) -> list[str]:
        """Words at most one edit away."""
        found = set().union(*(self.keys.get(k, ()) for k in self._keys(w)))
        return sorted(x for x in found if near(w, x))

    def around(self, w: str) -> list[str]:
        """Words one edit away; none if ``w`` is a word."""
        return [] if w in self.words else self.near(w)


def _parts(word: str, inside=str.isalpha) -> tuple[str, str, str]:
    """(before, core, after): the core begins and ends with a character that counts as inside."""
    short = word.rstrip(".,;:!?")
    if short and inside(short):  # of a whole string: of each of its characters
        return "", short, word[len(short) :]
    places = [k for k, ch in enumerate(short) if inside(ch)]
    if not places:
        return word, "", ""
    return word[: places[0]], word[places[0] : places[-1] + 1], word[places[-1] + 1 :]


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() else word.capitalize() if like[:1].isupper() else word


class Corrector:
    """Term and look-alike correction with one domain's vocabulary."""

    def __init__(self, domain: str = "biology"):
        words, phrases = DOMAINS.get(domain, DOMAINS["general"])
        self.vocabulary = Vocabulary(words)
        self.pairs = [tuple(p.split()) for p in phrases]
        self.found = lru_cache(1 << 16)(self._found)
        self.firsts = Vocabulary({a for a, _ in self.pairs})
        self.misread = set().union(*(swaps(w, str.lower) for w in self.vocabulary.words))
        self.reread = lru_cache(1 << 16)(self._reread)

    def phrase(self, left: str, right: str) -> tuple[str, str] | None:
        """The only phrase that both cores are near to, if they are not it already."""
        if min(len(left), len(right)) < 3 or SKIP.match(left) or SKIP.match(right):
            return None
        low = left.lower(), right.lower()
        if low[0] in self.vocabulary.words and low[1] in self.vocabulary.words:
            return None
        heads = {low[0], *self.firsts.near(low[0])}
        fits = [p for p in self.pairs if p[0] in heads and near(low[1], p[1])]
        return fits[0] if len(fits) == 1 and fits[0] != low else None

    def swapped(self, core: str) -> tuple[tuple[str, str], ...]:
        """(known word, pair) of each swap of a look-alike pair that gives one.

        Swaps work both ways: what none of the known words turns into by one swap, in lower case, turns into none of them.
        """
        if core.lower() not in self.misread:
            return ()
        return tuple((w, pair) for w, pair in swaps(core).items() if w != core and w.lower() in self.vocabulary.words)

    def _found(self, core: str) -> str | None:
        """The only word one edit away; for short cores only one that adds a letter."""
        if len(core) < 4 or SKIP.match(core):
            return None
        found = self.vocabulary.around(core.lower())
        return found[0] if len(found) == 1 and (len(core) >= 6 or len(found[0]) > len(core)) else None

    def terms(self, text: str) -> str:
        """Phrases from left to right, then the words that no phrase rewrote."""
        tokens, k = text.split(), 0
        while k < len(tokens):
            before, core, after = _parts(tokens[k])
            then = _parts(tokens[k + 1]) if k + 1 < len(tokens) else ("", "", "")
            pair = self.phrase(core, then[1])
            if pair:
                tokens[k] = before + _cased(pair[0], core) + after
                tokens[k + 1] = then[0] + _cased(pair[1], then[1]) + then[2]
                k += 2
                continue
            found = self.found(core)
            if found:
                tokens[k] = before + _cased(found, core) + after
            k += 1
        return " ".join(tokens)

    def _reread(self, token: str) -> tuple[str, str] | None:
        """The token with its core swapped and the pair, if exactly one swap gives a known word and it is none yet."""
        before, core, after = _parts(token, str.isalnum)
        if len(core) < 3 or SKIP.match(core) or core.lower() in self.vocabulary.words:
            return None
        found = self.swapped(core)
        if len(found) != 1:
            return None
        (word, pair), = found
        word = word[:1].upper() + word[1:] if core[:1].isupper() else word
        return before + word + after, pair

    def lookalikes(self, text: str) -> tuple[str, list[dict]]:
        """Words that exactly one swap of a look-alike pair turns into a known word, with their audit trail."""
        tokens, audit = text.split(), []
        for k, token in enumerate(tokens):
            found = self.reread(token) if len(token) <= REMEMBERED else self._reread(token)
            if found is not None:
                audit.append({"original": token, "corrected": found[0], "pair": found[1]})
                tokens[k] = found[0]
        return " ".join(tokens), audit


def swaps(word: str, form=str) -> dict[str, str]:
    """Every word that one swap of a look-alike pair makes, with the pair's name; of pairs in that form."""
    out: dict[str, str] = {}
    for other, canonical in LOOKALIKES:
        for x, y in ((form(other), form(canonical)), (form(canonical), form(other))):
            for m in re.finditer(f"(?={re.escape(x)})", word):
                out.setdefault(word[: m.start()] + y + word[m.start() + len(x) :], pair_name(other, canonical))
    return out


def correct_terms(column: Column, domain: str = "biology") -> Column:
    def make():
        own = Corrector(domain)
        return lambda s: s.map(lambda t: own.terms(t) if t else t)

    return in_pieces(make, "string")(column)


def correct_lookalikes(column: Column, domain: str = "biology") -> Column:
    """struct(text, corrections)."""

    def make():
        own = Corrector(domain)
        return lambda s: pd.DataFrame([own.lookalikes(t or "") for t in s], columns=["text", "corrections"])

    return in_pieces(make, "text string, corrections array<struct<original:string,corrected:string,pair:string>>")(column)


def correct(column: Column, domain: str = "biology", lookalikes: bool = True, model=None, fidelity: float = 0.35) -> Column:
    """Terms, then look-alikes, then an optional model's text: only where those changed something, and within ``fidelity`` of their text."""
    from inkledger.functions.text import change_ratio

    out = correct_terms(column, domain)
    if lookalikes:
        out = correct_lookalikes(out, domain)["text"]
    if model is not None:
        better = model(out)
        out = F.when((out != column) & (change_ratio(out, better) <= fidelity), better).otherwise(out)
    return out


def evaluate(pairs: DataFrame, domain: str = "biology", model=None, fidelity: float = 0.35) -> DataFrame:
    """One row: mean character error of the input, after terms, after the model, after both, and gated; how often the gate and fidelity held the model back.

    ``pairs`` has corrupted and clean.
    """
    from inkledger.functions.text import change_ratio, plain_error

    rows = pairs.select("corrupted", "clean", correct_terms(F.col("corrupted"), domain).alias("heuristic"))
    heuristic, corrupted, clean = F.col("heuristic"), F.col("corrupted"), F.col("clean")
    rows = rows.withColumn("trained", model(corrupted) if model else corrupted).withColumn("both", model(heuristic) if model else heuristic)
    changed = heuristic != corrupted
    far = change_ratio(heuristic, F.col("both")) > fidelity
    rows = rows.withColumn("skipped", ~changed & F.lit(model is not None)).withColumn("refused", changed & far & F.lit(model is not None))
    rows = rows.withColumn("gated", F.when(F.col("skipped") | F.col("refused"), heuristic).otherwise(F.col("both")))
    means = [F.coalesce(F.avg(plain_error(F.col(k), clean)), F.lit(0.0)).alias(f"cer_{k}") for k in ("corrupted", "heuristic", "trained", "both", "gated")]
    return rows.agg(F.count(F.lit(1)).alias("n"), *means, F.count_if("refused").alias("refused"), F.count_if("skipped").alias("skipped"))
