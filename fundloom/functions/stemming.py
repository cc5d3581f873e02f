"""English stems by the published Porter2 rules, and the words that carry no meaning of their own.

A word is in lower case. ``r1`` and ``r2`` are offsets: the region after the
first consonant that follows a vowel, and the same again inside that region.
"""

from __future__ import annotations

import re

#: The stop words of the published English list.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now".split()
)
#: Fixed values of the rules: whole words, words that stay after the plural, suffixes with what stands for them.
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
KEPT = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
PREFIXES = ("gener", "commun", "arsen")
STEP2 = {"ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": ""}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = frozenset("cdeghkmnrt")

_REGION = re.compile(r"[^aeiouy]*[aeiouy]+[^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
#: A short syllable at the end: vowel and other letter at the start of a word, or a vowel between two others of which the last isn't w, x or Y.
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _ending(word: str, endings) -> str:
    """The longest of ``endings``, given longest first, that the word ends with."""
    return next((e for e in endings if word.endswith(e)), "")


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    head = next((p for p in PREFIXES if w.startswith(p)), None)
    found = _REGION.match(w)
    r1 = len(head) if head else found.end() if found else len(w)
    found = _REGION.match(w, r1)
    r2 = found.end() if found else len(w)
    # Possessives, then plurals.
    w = w.removesuffix(_ending(w, ("'s'", "'s", "'")))
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    # Past and progressive forms.
    e = _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if e in ("eedly", "eed"):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif e and _VOWEL.search(w[: len(w) - len(e)]):
        w = w[: len(w) - len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # Suffixes of derived words.
    e = _ending(w, STEP2)
    if e and len(w) - len(e) >= r1:
        before = w[: len(w) - len(e)]
        if not (e == "ogi" and not before.endswith("l")) and not (e == "li" and before[-1:] not in BEFORE_LI):
            w = before + STEP2[e]
    e = _ending(w, STEP3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: len(w) - len(e)] + STEP3[e]
    e = _ending(w, STEP4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: len(w) - len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """Stems of words, with None for stop words; at most ``most`` are remembered."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = None if word in STOP_WORDS else stem(word)
        return out
