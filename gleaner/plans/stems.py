"""DuckDB SQL of the stemmer, formulated apart from the library's: shapes are folded letter by letter and anew after each
step, where the library finds a word's shape once and carries it along."""

from __future__ import annotations

from gleaner.functions.porter import STEP2, STEP3, STEP4

_KIND = "CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(acc, 1) = 'c') THEN 'v' ELSE 'c' END"


def shape_sql(word: str) -> str:
    """The word's c/v shape. y is a vowel after a consonant, else a consonant; so are digits."""
    return f"list_reduce(string_split({word}, ''), lambda acc, c: concat(acc, {_KIND}), '')"


def _measure(shape: str) -> str:
    return f"((length({shape}) - length(replace({shape}, 'vc', ''))) / 2)"


def _cvc(word: str, shape: str) -> str:
    return f"({shape} LIKE '%cvc' AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def _double(word: str, shape: str) -> str:
    return f"(length({word}) >= 2 AND right({word}, 1) = left(right({word}, 2), 1) AND right({shape}, 1) = 'c')"


def _cut(name: str, n: int) -> str:
    return f"left({name}, length({name}) - {n})"


def _replacing(rules: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items())
    return f"CASE WHEN s <> '' AND {_measure('left(cv, length(w) - length(s))')} > 0 THEN concat(left(w, length(w) - length(s)), CASE s {cases} END) ELSE w END"


def steps() -> list[dict[str, str]]:
    """Projections from ``token``: each gives all columns that the next reads (token is carried along)."""
    shape = shape_sql("w")
    suffix = "regexp_extract(w, '({})$', 1)"
    at_y = f"CASE WHEN w LIKE '%y' AND {_cut('cv', 1)} LIKE '%v%' THEN concat({_cut('w', 1)}, 'i') ELSE w END"
    s4 = f"CASE WHEN s <> '' AND {_measure('left(cv, length(w) - length(s))')} > 1 AND (s <> 'ion' OR right(left(w, length(w) - 3), 1) IN ('s', 't')) THEN left(w, length(w) - length(s)) ELSE w END"
    e = f"CASE WHEN w LIKE '%e' AND ({_measure(_cut('cv', 1))} > 1 OR ({_measure(_cut('cv', 1))} = 1 AND NOT {_cvc(_cut('w', 1), _cut('cv', 1))})) THEN {_cut('w', 1)} ELSE w END"
    return [
        {"w": f"CASE WHEN token LIKE '%sses' OR token LIKE '%ies' THEN {_cut('token', 2)} WHEN token LIKE '%ss' THEN token WHEN token LIKE '%s' THEN {_cut('token', 1)} ELSE token END"},
        {"w": "w", "cv": shape},
        {
            "b": f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_measure(_cut('cv', 3))} > 0 THEN 1 ELSE 0 END WHEN w LIKE '%ed' AND {_cut('cv', 2)} LIKE '%v%' THEN 2 WHEN w LIKE '%ing' AND {_cut('cv', 3)} LIKE '%v%' THEN 3 ELSE 0 END",
            "w": "w", "cv": "cv",
        },
        {"b": "b", "w": "left(w, length(w) - b)", "cv": "left(cv, length(cv) - b)"},
        {
            "w": f"CASE WHEN b < 2 THEN w WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN concat(w, 'e') WHEN {_double('w', 'cv')} AND right(w, 1) NOT IN ('l', 's', 'z') THEN {_cut('w', 1)} WHEN {_measure('cv')} = 1 AND {_cvc('w', 'cv')} THEN concat(w, 'e') ELSE w END",
        },
        {"w": "w", "cv": shape},
        {"w": at_y},
        {"w": "w", "cv": shape, "s": suffix.format("|".join(STEP2))},
        {"w": _replacing(STEP2)},
        {"w": "w", "cv": shape, "s": suffix.format("|".join(STEP3))},
        {"w": _replacing(STEP3)},
        {"w": "w", "cv": shape, "s": suffix.format("|".join(STEP4))},
        {"w": s4},
        {"w": "w", "cv": shape},
        {"w": e},
        {"w": "w", "cv": shape},
        {"stem": f"CASE WHEN length(token) <= 2 THEN token WHEN w LIKE '%ll' AND {_measure('cv')} > 1 THEN {_cut('w', 1)} ELSE w END"},
    ]


def ctes(source: str, name: str = "voc") -> str:
    """DuckDB CTEs that end in ``name`` (token, stem) for the tokens of ``source``."""
    parts, last = [], source
    chain = steps()
    for i, step in enumerate(chain):
        own = name if i == len(chain) - 1 else f"{name}_{i}"
        parts.append(f"{own} AS (SELECT token, {', '.join(f'{e} AS {k}' for k, e in step.items())} FROM {last})")
        last = own
    return ",\n".join(parts)
