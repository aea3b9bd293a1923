"""Personal data by a semi-Markov conditional random field (operator 8).

A segment is a span of tokens with a type, or a single token outside of all entities. Features look
at a whole span at once (its shape, groups of digits, check digits, the characters and the words
beside it), and weights by type make its score; a transition weight from the type of the entity
before (or none) is added. A text's segmentation has the sum of its segments' scores; tokens outside
score 0, the level that all others are measured from. The best one is found by dynamic programming
over token positions and the last entity's type, with entities of at most ``MAX_TOKENS`` tokens and
48 characters (254 with an @), so that boundaries and types are chosen together. The weights
maximise the conditional likelihood of generated sentences, whose normaliser and expectations come
from the forward and backward sums of the same recursion.

An entity must hold an @ or four digits, its first word must hold a digit or an @, and so must each
further word unless it is a group of up to four capitals (a bank code in an IBAN). White space
between words is of any length and may hold line breaks. So all other words are outside, and the
recursion over a text falls apart into windows: the runs of such words; a window's first entity has
none before it. A window's spans are scored ``CHUNK`` at a time, so a text of numbers alone takes
memory for its scores, not its features.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import IS_SPACE, slices

KINDS = ("EMAIL", "PHONE", "CARD", "IP", "SSN", "IBAN")
#: Tokens are runs of letters and digits, runs of white space, and single other characters.
MAX_TOKENS = 28
#: Spans whose features are held at once.
CHUNK = 4096
#: Bytes before a window in which words may hint at a type.
_CUE_BYTES = 40
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
_IS_TRIGGER = np.zeros(256, bool)
_IS_TRIGGER[48:58] = True
_IS_TRIGGER[64] = True
#: What may stand between two words of a window, and after its last one: white space and groups of capitals.
_BETWEEN = re.compile(rb"(?:\s++[A-Z]{1,4}+)*+\s++")
_BEHIND = re.compile(rb"(?:\s++[A-Z]{1,4}+(?![^\s.,;:!?)\]>\"'<]))*+")

_EMAIL = re.compile(r"[^\W_][\w.+-]{0,63}@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,24}")
_DOTTED = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_GROUPS = re.compile(r"\d+")
_CUES = {
    "EMAIL": re.compile(r"mail|contact|write", re.I),
    "PHONE": re.compile(r"phone|tel|call|fax|mobile|cell|contact|whatsapp", re.I),
    "CARD": re.compile(r"card|visa|master|amex|credit|debit|cc", re.I),
    "IP": re.compile(r"\bip|host|server|address|addr|from|ping", re.I),
    "SSN": re.compile(r"ssn|social", re.I),
    "IBAN": re.compile(r"iban|account|bank", re.I),
    "NUMBER": re.compile(r"order|version|\bv|isbn|serial|item|id|no\.?$|ref|invoice|price|build|release|section|part|total", re.I),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(text: str) -> bool:
    try:
        return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1
    except ValueError:
        return False


FEATURES = (
    "bias", "email", "at", "ats", "dotted", "octets", "luhn", "card_prefix", "iban", "mod97", "letters", "plus", "bracket", "unbalanced", "only_digits", "spaces", "hyphens", "dots", "slashes", "mixed",
    "grouped_4444", "grouped_ssn", "ssn_valid", "grouped_nanp", "grouped_phone", "leading_zero", "other_symbol", "wide",
    *[f"digits_{k}" for k in range(21)], *[f"groups_{k}" for k in range(9)],
    "left_space", "left_equals", "left_digit_point", "left_other", "left_number", "right_space", "right_stop", "right_digit_point", "right_other", "right_number",
    *[f"cue_{k}" for k in _CUES], "no_cue",
)
_INDEX = {name: i for i, name in enumerate(FEATURES)}
_SHAPE = re.compile(r"[\d\s()+.-]+")
_WIDE = re.compile(r"\s\s|[\n\r\v\f]")


def span_features(text: str, left: str, right: str, before: str) -> list[int]:
    """Indices of the features of a whole span; ``left`` and ``right`` are two characters beside it, ``before`` the words ahead."""
    groups = [m.group() for m in _GROUPS.finditer(text)]
    digits = "".join(groups)
    sizes = tuple(map(len, groups))
    ats = text.count("@")
    compact = "".join(text.split())
    has_letter = any(c.isalpha() for c in text)
    names = ["bias", f"digits_{min(len(digits), 20)}", f"groups_{min(len(groups), 8)}"]
    add = names.append
    if ats:
        add("at" if ats == 1 else "ats")
        if _EMAIL.fullmatch(text):
            add("email")
    if _DOTTED.fullmatch(text):
        add("dotted")
        if all(int(g) < 256 and (g == "0" or g[0] != "0") for g in groups):
            add("octets")
    if not has_letter and not ats and 13 <= len(digits) <= 19 and re.fullmatch(r"\d+(?:(?:-|\s+)\d+)*", text):
        if _luhn(digits):
            add("luhn")
        if digits[0] in "3456":
            add("card_prefix")
    if 15 <= len(compact) <= 34 and re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", compact):
        add("iban")
        if _mod97(compact):
            add("mod97")
    if has_letter:
        add("letters")
        if digits:
            add("mixed")
    if "+" in text:
        add("plus" if text[0] == "+" and text.count("+") == 1 else "other_symbol")
    if "(" in text:
        add("bracket")
    if text.count("(") != text.count(")"):
        add("unbalanced")
    if text.isdigit():
        add("only_digits")
    if len(compact) < len(text):
        add("spaces")
        if _WIDE.search(text):
            add("wide")
    for name, c in (("hyphens", "-"), ("dots", "."), ("slashes", "/")):
        if c in text:
            add(name)
    if not has_letter and not ats:
        if not _SHAPE.fullmatch(text):
            add("other_symbol")
        if sizes in ((4, 4, 4, 4), (4, 6, 5)):
            add("grouped_4444")
        if re.fullmatch(r"\d{3}(?:-|\s+)\d{2}(?:-|\s+)\d{4}", text):
            add("grouped_ssn")
            if groups[0] not in ("000", "666") and groups[0] < "900" and groups[1] != "00" and groups[2] != "0000":
                add("ssn_valid")
        if sizes in ((3, 3, 4), (1, 3, 3, 4), (2, 3, 3, 4)):
            add("grouped_nanp")
        if text[0] == "+" and 8 <= len(digits) <= 15 or text[0] == "0" and 9 <= len(digits) <= 12 and len(groups) > 1:
            add("grouped_phone")
    if digits and text[0] == "0":
        add("leading_zero")
    for side, two, near in (("left", left, left[-1:]), ("right", right, right[:1])):
        if not near or near.isspace():
            add(f"{side}_space")
            far = two[:1] if side == "left" else two[1:]
            if len(two) == 2 and far.isdigit() and near not in "\r\n":
                add(f"{side}_number")
        elif side == "right" and near in ".,;:!?)\"'" and not two[1:].isalnum():
            add("right_stop")
        elif near in ".,-/:" and (two[:1] if side == "left" else two[1:]).isdigit():
            add(f"{side}_digit_point")
        elif side == "left" and near in "=:\"'(<[":
            add("left_equals")
        else:
            add(f"{side}_other")
    hits = [f"cue_{k}" for k, cue in _CUES.items() if cue.search(before)]
    return sorted({_INDEX[n] for n in names + (hits or ["no_cue"])})


def spans(window: str) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(number of tokens, spans that may be entities as (first token, end token, start, end))."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(window)]
    digit = [sum(c in "0123456789" for c in window[s:e]) for s, e in tokens]
    out = []
    for i, (start, _) in enumerate(tokens):
        c = window[start]
        if not (c.isalnum() or c in "+("):
            continue
        held, at, size = 0, False, 0
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            s, e = tokens[j]
            held += digit[j]
            at |= window[s] == "@"
            size += 1 if window[s].isspace() else e - s
            if size > (254 if at else 48):
                break
            if (at or held >= 4) and window[s].isalnum():
                out.append((i, j + 1, start, e))
    return len(tokens), out


def _matrix(window: str, before: str, after: str, found: list[tuple[int, int, int, int]]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)), np.float32)
    whole, shift = before + window + after, len(before)
    for r, (_, _, s, e) in enumerate(found):
        x[r, span_features(window[s:e], whole[max(0, s + shift - 2) : s + shift], whole[e + shift : e + shift + 2], whole[max(0, s + shift - _CUE_BYTES) : s + shift])] = 1
    return x


def _windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the runs of words with a digit or an @, and groups of capitals after the first."""
    at = np.flatnonzero(_IS_TRIGGER[raw])
    doc = np.searchsorted(offsets, at, "right") - 1
    blank = np.concatenate([[-1], np.flatnonzero(IS_SPACE[raw]), [len(raw)]])
    k = np.searchsorted(blank, at)
    start = np.maximum(blank[k - 1] + 1, offsets[doc])
    end = np.minimum(blank[k], offsets[doc + 1])
    new = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]])) if len(at) else np.zeros(0, np.int64)
    doc, start, end = doc[new], start[new], end[new]
    if not len(new):
        return doc, start, end
    data = raw.tobytes()
    same = (doc[1:] == doc[:-1]).tolist()
    joined = [own and _BETWEEN.fullmatch(data, a, b) is not None for own, a, b in zip(same, end[:-1].tolist(), start[1:].tolist(), strict=True)]
    first = np.flatnonzero(np.concatenate([[True], ~np.array(joined, bool)]))
    last = np.append(first[1:], len(new)) - 1
    reach = [_BEHIND.match(data, a, b).end() for a, b in zip(end[last].tolist(), offsets[doc[last] + 1].tolist(), strict=True)]
    return doc[first], start[first], np.array(reach, np.int64)


def best(n: int, found: list[tuple[int, int, int, int]], scores: np.ndarray, turns: np.ndarray) -> list[tuple[int, int]]:
    """(span, kind) of the segmentation with the largest score; of equal ones that with fewer entities.

    ``turns``: the weight of each kind (column) after no entity (row 0) or one of each kind.
    """
    if not found:
        return []
    by_end: dict[int, list[int]] = {}
    for r, (_, j, _, _) in enumerate(found):
        by_end.setdefault(j, []).append(r)
    kinds = len(KINDS)
    value = np.full((n + 1, kinds + 1), -np.inf)
    came: list[dict[int, tuple[int, int]]] = [{} for _ in range(n + 1)]  # by last kind: (span, the kind before)
    value[0, 0] = 0
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for r in by_end.get(j, ()):
            ways = value[found[r][0], :, None] + turns
            before = ways.argmax(axis=0)
            total = ways[before, np.arange(kinds)] + scores[r]
            for k in np.flatnonzero(total > value[j, 1:]).tolist():
                value[j, k + 1] = total[k]
                came[j][k + 1] = (r, int(before[k]))
    # of equal totals the state without an entity is the first
    out, j, state = [], n, int(value[n].argmax())
    while j and state:
        if state in came[j]:
            r, before = came[j][state]
            out.append((r, state - 1))
            j, state = found[r][0], before
        else:
            j -= 1
    return out[::-1]


#: Kinds and numbers of the characters of an account number in an IBAN: digits (n), capitals (a) or either (c).
_ACCOUNTS = {
    "DE": (("n", 18),), "FR": (("n", 10), ("c", 11), ("n", 2)), "ES": (("n", 20),), "CH": (("n", 5), ("c", 12)), "GB": (("a", 4), ("n", 14)), "NL": (("a", 4), ("n", 10)),
    "IE": (("a", 4), ("n", 14)), "LV": (("a", 4), ("c", 13)), "MT": (("a", 4), ("n", 5), ("c", 18)), "SC": (("a", 4), ("n", 20), ("a", 3)),
}


def _generated(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence and its entities (start, end, kind)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    code = lambda: "".join(rng.choice(capitals) for _ in range(rng.randint(1, 4)))
    wide = lambda made: re.sub(" ", lambda _: rng.choice(("  ", "   ", "\n", "\r\n", "\t", " \n ")), made) if rng.random() < 0.15 else made

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((14, 14, 14, 13, 12)))
        body += next(c for c in "0123456789" if _luhn(body + c))
        if len(body) == 16 and rng.random() < 0.5:
            return rng.choice(" -").join(body[i : i + 4] for i in range(0, 16, 4))
        return body

    def email() -> str:
        local = letters(1, 9) + rng.choice(("", ".", "_", "+", "-")) + rng.choice((letters(1, 7), digits(2), letters(1, 4) + digits(1)))
        return f"{local}@{letters(2, 8)}{rng.choice(('', digits(1), '.' + letters(2, 5), '-' + letters(2, 4)))}.{rng.choice(('com', 'org', 'net', 'example.com', 'co.uk', 'de', 'io', 'fr'))}"

    def phone() -> str:
        a, b, c = rng.choice("23456789") + digits(2), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+{rng.randint(20, 99)} {digits(2)} {digits(4)} {digits(4)}", f"+{rng.randint(20, 99)}{digits(9)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"+{rng.randint(30, 49)} {digits(3)} {digits(7)}"))

    def iban() -> str:
        country = rng.choice(("DE", "FR", "ES", "CH", "GB", "NL", "IE", "LV", "MT", "SC"))
        body = "".join(rng.choice({"n": "0123456789", "a": capitals, "c": "0123456789" * 3 + capitals}[k]) for k, n in _ACCOUNTS[country] for _ in range(n))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        body = f"{country}{check:02d}{body}"
        return body if rng.random() < 0.5 else " ".join(body[i : i + 4] for i in range(0, len(body), 4))

    def number() -> str:
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 18, 32, 40))))
        return rng.choice((
            f"{rng.randint(0, 9)}.{rng.randint(0, 20)}", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 30)}", f"v{rng.randint(1, 9)}.{digits(1)}.{digits(2)}.", digits(rng.randint(1, 8)), digits(rng.randint(5, 12)), hexa,
            f"{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1990, 2030)}", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{digits(2)}",
            f"${digits(3)},{digits(3)}.00", f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{rng.randint(256, 999)}.{digits(3)}.{digits(2)}.{rng.randint(256, 999)}", f"@{letters(3, 8)}{digits(2)}", f"AB-{digits(5)}", f"{digits(4)}-{digits(4)}", "19" + digits(14), f"x{digits(4)}y",
            f"AKIA{''.join(rng.choice('ABCDEFGHIJ234567') for _ in range(16))}", f"password={hexa}", f'"{hexa}"', f"{digits(5)}.{digits(5)}", f"{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)}", f"{letters(2, 6)}@{letters(3, 5)}", f"{digits(2)}%", f"{digits(20)}", f"{digits(4)} {digits(4)}",
            f"{rng.randint(1, 28)} {code()} {rng.randint(1900, 2030)}", f"{digits(rng.randint(1, 4))} {code()} {digits(rng.randint(1, 5))}", f"{code()} {digits(rng.randint(3, 8))} {code()}", f"{capitals[rng.randint(0, 25)]}{digits(2)} {code()} {digits(4)} {digits(4)} {digits(2)}",
            "\n".join(digits(rng.randint(1, 6)) for _ in range(rng.randint(2, 6))), "\n".join(f"{rng.randint(1, 99)}  {digits(3)}  {digits(rng.choice((2, 4)))}" for _ in range(rng.randint(1, 3))),
            f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}",
        ))

    makers = {
        "EMAIL": email, "PHONE": phone, "CARD": card, "IBAN": iban,
        "IP": lambda: ".".join(str(rng.choice((rng.randint(0, 255), rng.randint(10, 255)))) for _ in range(4)),
        "SSN": lambda: f"{rng.randint(101, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
    }
    cues = {"EMAIL": "mail", "PHONE": "call", "CARD": "card", "IP": "server", "SSN": "ssn", "IBAN": "iban"}
    text, gold = "", []
    for _ in range(rng.randint(1, 4)):
        text += " ".join(letters(1, 9) for _ in range(rng.choice((0, 1, 2, 3, 4)))) + " "
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            if rng.random() < 0.25:
                text += cues[kind] + rng.choice((" ", ": "))
            text += rng.choice(("", "", "", "", "(", '"', "=", "<")) if rng.random() < 0.2 else ""
            made = wide(makers[kind]())
            gold.append((len(text), len(text) + len(made), kind))
            text += made
        else:
            text += rng.choice(("order ", "version ", "id ", "", "", "")) + number()
        text += rng.choice(("", "", "", ".", ",", ";", "\n"))
        if rng.random() < 0.1:
            text += " " + code()
        text += " " + letters(1, 7) + " " if rng.random() < 0.8 else " "
    return text, gold


class Model:
    """Weights by feature and kind, and by the kind before and kind."""

    def __init__(self, weights: np.ndarray, turns: np.ndarray):
        self.weights, self.turns = weights, turns

    def find(self, window: str, before: str = "", after: str = "") -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of the entities in the best segmentation."""
        n, found = spans(window)
        if not found:
            return []
        scores = np.concatenate([_matrix(window, before, after, found[i : i + CHUNK]) @ self.weights for i in range(0, len(found), CHUNK)])
        return [(found[r][2], found[r][3], KINDS[k], float(scores[r, k])) for r, k in best(n, found, scores, self.turns)]

    def find_all(self, column: pa.Array) -> Iterator[tuple[int, int, int, str, float]]:
        """(row, start, end, kind, score), in characters of each text."""
        for a, _, raw, offsets in slices(column):
            for doc, s, e in zip(*(x.tolist() for x in _windows(raw, offsets)), strict=True):
                lo, hi = max(int(offsets[doc]), s - _CUE_BYTES), min(int(offsets[doc + 1]), e + 2)
                window = raw[s:e].tobytes().decode("utf-8", "replace")
                hits = self.find(window, raw[lo:s].tobytes().decode("utf-8", "ignore"), raw[e:hi].tobytes().decode("utf-8", "ignore"))
                if hits:
                    shift = int(((raw[offsets[doc] : s] & 0xC0) != 0x80).sum())
                    for start, end, kind, score in hits:
                        yield a + doc, shift + start, shift + end, kind, score


@functools.cache
def train(sentences: int = 600, steps: int = 80, seed: int = 11, ridge: float = 0.002) -> Model:
    """Maximises the conditional log-likelihood of generated sentences; the same numbers give the same model."""
    rng = random.Random(seed)
    blocks, gold, items = [], [], []  # by window: features, kinds, (number of tokens, spans)
    turned = np.zeros((len(KINDS) + 1, len(KINDS)))
    for _ in range(sentences):
        text, entities = _generated(rng)
        raw = text.encode()
        for _, s, e in zip(*(x.tolist() for x in _windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))), strict=True):
            n, found = spans(text[s:e])
            if not found:
                continue
            blocks.append(_matrix(text[s:e], text[max(0, s - _CUE_BYTES) : s], text[e : e + 2], found))
            want = np.zeros((len(found), len(KINDS)), np.float32)
            last = 0
            for start, end, kind in entities:
                for r, (_, _, a, b) in enumerate(found):
                    if (a + s, b + s) == (start, end):
                        want[r, KINDS.index(kind)] = 1
                        turned[last, KINDS.index(kind)] += 1
                        last = KINDS.index(kind) + 1
            gold.append(want)
            items.append((n, [(i, j) for i, j, _, _ in found]))
    x, y = np.concatenate(blocks), np.concatenate(gold)
    lattice = Lattice(items)
    # both kinds of weights in one array: features, then the kind before
    w = np.zeros((len(FEATURES) + len(KINDS) + 1, len(KINDS)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    target = np.concatenate([x.T @ y, turned])
    for step in range(1, steps + 1):
        share, turns = lattice.marginals(x @ w[: len(FEATURES)], w[len(FEATURES) :])
        slope = (target - np.concatenate([x.T @ share, turns])) / len(items) - ridge * w
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        w += 0.25 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return Model(w[: len(FEATURES)].astype(np.float32), w[len(FEATURES) :].astype(np.float32))


class Lattice:
    """The segmentations of many windows, whose forward and backward sums go on together, position by position."""

    def __init__(self, items: list[tuple[int, list[tuple[int, int]]]]):
        """items: (number of tokens, spans (first token, end token)) of each window."""
        self.n = np.array([n for n, _ in items])
        self.window = np.repeat(np.arange(len(items)), [len(found) for _, found in items])
        ends = np.array([x for _, found in items for x in found], np.int64).reshape(-1, 2)
        self.i, self.j = ends[:, 0], ends[:, 1]
        most = int(self.n.max(initial=0))
        self.starting = [np.flatnonzero(self.i == t) for t in range(most + 1)]
        self.ending = [np.flatnonzero(self.j == t) for t in range(most + 1)]

    def marginals(self, scores: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the probability of each span to be an entity of each kind, the expected number of each turn)."""
        kinds, most = scores.shape[1], len(self.starting) - 1
        alpha = np.full((len(self.n), most + 1, kinds + 1), -np.inf)
        alpha[:, 0, 0] = 0
        for t in range(1, most + 1):
            alpha[:, t] = alpha[:, t - 1]
            r = self.ending[t]
            if len(r):
                ways = _log_sum(alpha[self.window[r], self.i[r], :, None] + turns, 1) + scores[r]
                np.logaddexp.at(alpha, (self.window[r, None], t, np.arange(1, kinds + 1)), ways)
        beta = np.zeros((len(self.n), most + 1, kinds + 1))
        for t in range(most - 1, -1, -1):
            inside = self.n > t
            beta[inside, t] = beta[inside, t + 1]
            r = self.starting[t]
            if len(r):
                ways = _log_sum(turns + (scores[r] + beta[self.window[r], self.j[r], 1:])[:, None, :], 2)
                np.logaddexp.at(beta, (self.window[r, None], t, np.arange(kinds + 1)), ways)
        whole = _log_sum(alpha[np.arange(len(self.n)), self.n], 1)
        each = alpha[self.window, self.i, :, None] + turns + (scores + beta[self.window, self.j, 1:])[:, None, :] - whole[self.window, None, None]
        each = np.exp(np.minimum(each, 0))
        return each.sum(axis=1), each.sum(axis=0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, kind, start, end, score): every entity of the best segmentation, in characters of the text.

    One pass without a shuffle. Each row is searched by itself, so rows that repeat give their
    entities again, and null ids are kept. Null and empty texts have none; long ones are searched
    whole, in time that grows with their numbers. ``score`` is the span's own, without its turn. Of
    equal totals those without a further entity are taken. Other columns, whatever their names, are
    not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shared.value.find_all(batch.column(1)))
            if found:
                row, start, end, kind, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(kind), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([round(s, 3) for s in score])],
                    ["doc_id", "kind", "start", "end", "score"],
                )

    return rows.mapInArrow(run, "doc_id long, kind string, start int, end int, score double")
