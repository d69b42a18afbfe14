"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980): as SQL for whole vocabularies, and for
single words.

The SQL form is a chain of projections, each computing a step from the one before, of functions that Spark compiles. A
word's shape is a string of c (consonant) and v (vowel); the measure is the number of ``vc`` in it. The shape of a prefix is
the prefix of the shape.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

# The suffix lists of the paper.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _shape(word: str) -> str:
    """c for consonants and digits, v for vowels; y is a vowel after a consonant."""
    shape = word.translate(_KINDS)
    if "y" not in shape:
        return shape
    out = ""
    for c in shape:
        out += c if c != "y" else "v" if out.endswith("c") else "c"
    return out


_KINDS = {ord(c): "v" if c in "aeiou" else "y" if c == "y" else "c" for c in _LETTERS}

# -- Columns --


def shape_sql(word: str) -> str:
    """Runs of y alternate: pairs first, those after a consonant, then those after a vowel or at the start, then what is
    left."""
    plain = f"translate({word}, '{_LETTERS}', '{''.join(_KINDS[ord(c)] for c in _LETTERS)}')"
    after_c = f"regexp_replace({plain}, '(?:(?<=c)|(?!^)\\\\G)yy', 'vc')"
    after_v = f"regexp_replace({after_c}, '(?:(?<=v)|^|(?!^)\\\\G)yy', 'cv')"
    return f"CASE WHEN contains({word}, 'y') THEN translate(regexp_replace({after_v}, '(?<=c)y', 'v'), 'y', 'c') ELSE {plain} END"


def _measure(shape: str) -> str:
    return f"((length({shape}) - length(replace({shape}, 'vc', ''))) / 2)"


def _but(name: str, n: int | str) -> str:
    return f"left({name}, length({name}) - {n})"


def _short(word: str, shape: str) -> str:
    return f"(endswith({shape}, 'cvc') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def _ending(suffixes) -> str:
    return f"regexp_extract(w, '({'|'.join(suffixes)})$', 1)"


def _both(condition: str, word: str, shape: str) -> dict[str, str]:
    """The word and its shape, changed alike under the condition."""
    return {"w": f"CASE WHEN {condition} THEN {word} ELSE w END", "cv": f"CASE WHEN {condition} THEN {shape} ELSE cv END"}


def _replacing(rules: dict[str, str]) -> dict[str, str]:
    new, shape = (f"CASE s {' '.join(f'WHEN {a!r} THEN {f(b)!r}' for a, b in rules.items())} END" for f in (str, _shape))
    return _both(f"s <> '' AND {_measure(_but('cv', 'length(s)'))} > 0", f"concat({_but('w', 'length(s)')}, {new})", f"concat({_but('cv', 'length(s)')}, {shape})")


def steps() -> list[dict[str, str]]:
    """Projections from ``token``: each gives all columns that the next reads (token is carried along). The shape is found
    once; a suffix goes from both, and what is put in its place has a known shape."""
    stem_of = {n: f"contains({_but('cv', n)}, 'v')" for n in (1, 2, 3)}
    keep = {"w": "w", "cv": "cv"}
    s4 = f"s <> '' AND {_measure(_but('cv', 'length(s)'))} > 1 AND (s <> 'ion' OR right({_but('w', 3)}, 1) IN ('s', 't'))"
    m5 = _measure(_but("cv", 1))
    e = f"endswith(w, 'e') AND ({m5} > 1 OR ({m5} = 1 AND NOT {_short(_but('w', 1), _but('cv', 1))}))"
    twice = "(length(w) >= 2 AND right(w, 1) = left(right(w, 2), 1) AND right(cv, 1) = 'c' AND right(w, 1) NOT IN ('l', 's', 'z'))"
    return [
        {"cv": shape_sql("token"), "b": "CASE WHEN endswith(token, 'sses') OR endswith(token, 'ies') THEN 2 WHEN endswith(token, 's') AND NOT endswith(token, 'ss') THEN 1 ELSE 0 END"},
        {"w": _but("token", "b"), "cv": _but("cv", "b")},
        {**keep, "b": f"CASE WHEN endswith(w, 'eed') THEN CASE WHEN {_measure(_but('cv', 3))} > 0 THEN 1 ELSE 0 END WHEN endswith(w, 'ed') AND {stem_of[2]} THEN 2 WHEN endswith(w, 'ing') AND {stem_of[3]} THEN 3 ELSE 0 END"},
        {"w": _but("w", "b"), "cv": _but("cv", "b"), "b": "b"},
        {**keep, "b": f"CASE WHEN b < 2 THEN 0 WHEN endswith(w, 'at') OR endswith(w, 'bl') OR endswith(w, 'iz') THEN 1 WHEN {twice} THEN -1 WHEN {_measure('cv')} = 1 AND {_short('w', 'cv')} THEN 1 ELSE 0 END"},
        {"w": f"CASE b WHEN 1 THEN concat(w, 'e') WHEN -1 THEN {_but('w', 1)} ELSE w END", "cv": f"CASE b WHEN 1 THEN concat(cv, 'v') WHEN -1 THEN {_but('cv', 1)} ELSE cv END"},
        _both(f"endswith(w, 'y') AND {stem_of[1]}", f"concat({_but('w', 1)}, 'i')", f"concat({_but('cv', 1)}, 'v')"),
        {**keep, "s": _ending(STEP2)},
        _replacing(STEP2),
        {**keep, "s": _ending(STEP3)},
        _replacing(STEP3),
        {**keep, "s": _ending(STEP4)},
        _both(s4, _but("w", "length(s)"), _but("cv", "length(s)")),
        _both(e, _but("w", 1), _but("cv", 1)),
        {"stem": f"CASE WHEN length(token) <= 2 THEN token WHEN endswith(w, 'll') AND {_measure('cv')} > 1 THEN {_but('w', 1)} ELSE w END"},
    ]


def with_stem(words: DataFrame, column: str = "token") -> DataFrame:
    """Distinct lower-case words in ``column`` -> (token, stem), as Columns alone."""
    out = words.selectExpr(f"`{column}` AS token")
    for step in steps():
        out = out.selectExpr("token", *(f"{e} AS {k}" for k, e in step.items()))
    return out


_ENDINGS = {name: re.compile(f"(?:{'|'.join(rules)})$") for name, rules in ((2, STEP2), (3, STEP3), (4, STEP4))}


def _longest(word: str, step: int) -> str:
    found = _ENDINGS[step].search(word)  # the leftmost match of an end is the longest
    return found[0] if found else ""


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    m = lambda shape: shape.count("vc")
    cvc = lambda w, s: s.endswith("cvc") and w[-1] not in "wxy"
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    s = _shape(w)
    if w.endswith("eed"):
        w = w[:-1] if m(s[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in s[: -len(end)]:
                w, s = w[: -len(end)], s[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and s[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(s) == 1 and cvc(w, s):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w)[:-1]:
        w = w[:-1] + "i"
    for step, rules in ((2, STEP2), (3, STEP3)):
        if (end := _longest(w, step)) and m(_shape(w)[: -len(end)]):
            w = w[: -len(end)] + rules[end]
    if (end := _longest(w, 4)) and m(_shape(w)[: -len(end)]) > 1 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        s = _shape(w)[:-1]
        if m(s) > 1 or (m(s) == 1 and not cvc(w[:-1], s)):
            w = w[:-1]
    if w.endswith("ll") and m(_shape(w)) > 1:
        w = w[:-1]
    return w
