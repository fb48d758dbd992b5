"""Look-alike correction works a token out once, and tries swaps only on words that one may turn into a known word."""

from inkledger.operators import correction


def test_swaps_are_tried_only_where_one_may_help(monkeypatch):
    own = correction.Corrector()
    plain = {w for word in own.vocabulary.words for w in correction.swaps(word)}
    tried = []
    swaps = correction.swaps
    monkeypatch.setattr(correction, "swaps", lambda word, *form: tried.append(word) or swaps(word, *form))
    text = " ".join(["wholly", "unconcerned", "neighbours", "Erhinlon", "rnembrane,", "rnembrane"] * 50)
    fixed, audit = own.lookalikes(text)
    assert fixed.split()[4:6] == ["membrane,", "membrane"] and len(audit) == 100
    assert set(tried) == {"rnembrane"} and len(tried) == 2  # with and without its comma; before, every other word too
    for word in sorted(plain)[::7]:  # whatever a swap makes of a known word
        for token in (word, word.capitalize(), word.upper(), f"({word}.", word + "x" * correction.REMEMBERED):
            before, core, after = correction._parts(token, str.isalnum)
            known = [w for w in swaps(core) if w != core and w.lower() in own.vocabulary.words]
            skipped = len(core) < 3 or correction.SKIP.match(core) or core.lower() in own.vocabulary.words
            assert len(own.lookalikes(token)[1]) == (not skipped and len(known) == 1)
