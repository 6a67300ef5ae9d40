"""Words of a query as a German dictionary would look them up: stop words left out, the others by the published Snowball rules."""

from __future__ import annotations

import re

VOWELS = "aeiouyäöü"
# Words that take the endings of articles and adjectives, and their endings
_DECLINED = ["all", "ander", "dein", "dies", "ein", "einig", "euer", "eur", "ihr", "jed", "jen", "kein", "manch", "mein", "sein", "solch", "unser", "unsr", "welch"]
_ENDINGS = ["", "e", "em", "en", "er", "es"]
# The other stop words
_OTHERS = """aber als also am an anderm andern anderr anders auch auf aus bei bin bis bist da damit dann das dasselbe dazu daß dass dein dem demselben den denn
denselben der derer derselbe derselben des desselben dessen dich die dieselbe dieselben dir doch dort du durch einmal er es etwas euch für gegen gewesen hab habe
haben hat hatte hatten hier hin hinter ich ihm ihn ihnen im in indem ins ist jetzt kann können könnte machen man mich mir mit muss musste nach nicht nichts
noch nun nur ob oder ohne sehr selbst sich sie sind so solche sollte sondern sonst über um und uns unter viel vom von vor während war waren warst was weg
weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen""".split()
STOP_WORDS = {w + e for w in _DECLINED for e in _ENDINGS} - {"all", "ander", "dies", "einig", "eur", "jed", "jen", "manch", "solch", "unsr", "welch"} | set(_OTHERS)


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin: after the first consonant that follows a vowel, and again; R1 after three letters at least."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWELS and w[i - 1] in VOWELS:
                return i + 1
        return len(w)

    r1 = after(0)
    return max(r1, 3), after(r1)


def stem(word: str) -> str:
    """The Snowball German stem of a word in lower case."""
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in VOWELS and w[i + 1] in VOWELS else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    ends = lambda *suffixes: next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s)), None)
    within = lambda s, region: len(w) - len(s) >= region
    # inflections of nouns and adjectives
    if s := ends("em", "ern", "er", "e", "en", "es", "s"):
        if s == "s":
            w = w[:-1] if within(s, r1) and w[-2:-1] and w[-2] in "bdfghklmnrt" else w
        elif within(s, r1):
            w = w[: -len(s)]
            w = w[:-1] if s in ("e", "en", "es") and w.endswith("niss") else w
    # of verbs and comparisons
    if s := ends("en", "er", "est", "st"):
        if s == "st":
            w = w[:-2] if within(s, r1) and len(w) >= 6 and w[-3] in "bdfghklmnt" else w
        elif within(s, r1):
            w = w[: -len(s)]
    # derivations
    if s := ends("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"):
        before = w[: -len(s)]
        if within(s, r2) and not (s in ("ig", "ik", "isch") and before.endswith("e")):
            w = before
            if s in ("end", "ung") and w.endswith("ig") and within("ig", r2) and not w.endswith("eig"):
                w = w[:-2]
            elif s in ("lich", "heit") and w.endswith(("er", "en")) and within("er", r1):
                w = w[:-2]
            elif s == "keit" and (t := next((t for t in ("lich", "ig") if w.endswith(t)), None)) and within(t, r2):
                w = w[: -len(t)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def stemmed(query: str, longest: int = 200) -> list[str]:
    """The different stems of a query's words and numbers, in order of the alphabet, without stop words."""
    words = re.findall(r"[^\W_]+", query[:longest].lower())
    return sorted({stem(w) for w in words if w not in STOP_WORDS})
