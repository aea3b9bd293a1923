"""English stems by the Porter2 algorithm (published by the Snowball project)."""

from __future__ import annotations

import functools
import re

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"), ("lessli", "less"), ("biliti", "ble"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first consonant that follows a vowel, and once more."""

    def after(at: int) -> int:
        for i in range(at + 1, len(word)):
            if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
                return i + 1
        return len(word)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def _vowel_in(part: str) -> bool:
    return any(c in _VOWELS for c in part)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters are their own."""
    if len(word) < 3:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.removeprefix("'")
    if word.startswith("y"):
        word = "Y" + word[1:]
    word = re.sub(r"(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(word)

    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _vowel_in(word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word

    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not word.endswith(suffix):
            continue
        head = word[: -len(suffix)]
        if suffix in ("eed", "eedly"):
            if len(head) >= r1:
                word = head + "ee"
        elif _vowel_in(head):
            word = head
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif _short_syllable(word) and r1 >= len(word):
                word += "e"
        break

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"

    for suffix, new in _STEP2:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if len(head) >= r1 and (suffix != "ogi" or head.endswith("l")) and (suffix != "li" or head[-1:] in tuple(_LI)):
                word = head + new
            break

    for suffix, new in _STEP3:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if len(head) >= (r2 if suffix == "ative" else r1):
                word = head + new
            break

    for suffix in _STEP4:
        if word.endswith(suffix):
            head = word[: -len(suffix)]
            if len(head) >= r2 and (suffix != "ion" or head.endswith(("s", "t"))):
                word = head
            break

    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
