"""States and places named in texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Postal codes of states and their names.
STATES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas", "CA": "california", "CO": "colorado", "CT": "connecticut",
    "DE": "delaware", "DC": "district of columbia", "FL": "florida", "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois",
    "IN": "indiana", "IA": "iowa", "KS": "kansas", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland",
    "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi", "MO": "missouri", "MT": "montana",
    "NE": "nebraska", "NV": "nevada", "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NY": "new york",
    "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma", "OR": "oregon", "PA": "pennsylvania",
    "RI": "rhode island", "SC": "south carolina", "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah",
    "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia", "WI": "wisconsin", "WY": "wyoming",
}
# Codes that are English words, which count within a list of codes only.
WORD_CODES = ["OR", "IN", "ME", "OK", "HI"]
# Words after a state's name that make it a place's.
PLACE_AFTER = "(?:count(?:y|ies)|city|beach|valley|parish(?:es)?|regions?|campus|metro(?:politan)?|panhandle)(?![a-z])"
# What makes a state named beside it only a part of it, or the state of a place.
PART_BEFORE = (
    r"(?<![a-z])(?:(?:north|south)(?:east|west)?(?:ern)?|east(?:ern)?|west(?:ern)?|central|middle|upstate|downstate|upper|lower|coastal|mid"
    r"|greater|rural|metro(?:politan)?)[- ]{1,2}"
)
OF_PLACE = (
    r"(?<![a-z])(?:(?:count(?:y|ies)|city|beach|regions?|panhandle|parish(?:es)?|borough|township)(?: ?,| (?:located )?(?:in|of))"
    r"|areas? (?:located )?(?:in|of)) (?:the state of )?"
)
PART_AFTER = r"[- ]{1,2}(?:count(?:y|ies)|city|beach|parish(?:es)?|region|metro(?:politan)?|panhandle|campus|clinics?|hospitals?|facilit(?:y|ies))(?![a-z])"


def _shared(words: list[str]) -> str:
    """A pattern of words of which none begins another: equal beginnings are tried once, not once a word."""
    if len(words) == 1:
        return words[0]
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(w[1:])
    return f"(?:{'|'.join(first + _shared(rest) for first, rest in by_first.items())})"


NAMES = _shared(list(STATES.values()))
# a character that begins a name, looked at before the end of a word is
BEGIN = f"(?=[{''.join(sorted({name[0] for name in STATES.values()}))}])"
CODES = "|".join(STATES)
CODE_LIST = rf"\b(?:{CODES})(?:\s*,\s*(?:{CODES}))*\s*,?\s+(?:(?i:and|or)|&)\s+(?:{CODES})\b"


def _map(pairs: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(repr(x) for pair in pairs.items() for x in pair)})")


def code_of(name: Column) -> Column:
    """A state's code by its lower-case name."""
    return _map({name_: code for code, name_ in STATES.items()})[name]


def name_of(code: Column) -> Column:
    """A state's lower-case name by its code."""
    return _map(STATES)[code]


def _codes(names: Column) -> Column:
    return F.array_distinct(F.transform(names, code_of))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def states_named(text: Column) -> Column:
    """Codes of the states whose names a text has as whole words, each once, in the order met; none for null."""
    return _codes(_all(F.lower(text), rf"{BEGIN}\b({NAMES})\b", 1))


def states_as_states(text: Column) -> Column:
    """``states_named`` but for names that are a place's, like a county's or a valley's."""
    return _codes(_all(F.lower(text), rf"{BEGIN}\b({NAMES})\b(?![- ]+{PLACE_AFTER})", 1))


def codes_written(text: Column) -> Column:
    """Codes in capitals; those that are English words only where a list of codes has them."""
    listed = _all(F.array_join(_all(text, CODE_LIST), " "), rf"\b({CODES})\b", 1)
    return F.array_distinct(F.filter(_all(text, rf"\b({CODES})\b", 1), lambda c: ~c.isin(WORD_CODES) | F.array_contains(listed, c)))


def whole_states(said: Column, written: Column) -> Column:
    """Codes of the states that a quote names whole, by name in ``said`` (comparable form) or by code in ``written``.

    Regions of a state, states of places and counties with a code of their own don't count; codes don't in a text
    that is in capitals throughout.
    """
    guard = f"(?<!{PART_BEFORE})(?<!{OF_PLACE})"
    named = rf"(?<![a-z]){guard}({NAMES})(?![a-z])(?!{PART_AFTER})(?!(?<=washington) ?,? ?d\.? ?c(?![a-z]))(?: ?\(([a-z]{{2}})\))?"
    pairs = F.arrays_zip(_all(said, named, 1).alias("name"), _all(said, named, 2).alias("code"))
    fits = F.filter(pairs, lambda p: (p["code"] == "") | (F.upper(p["code"]) == code_of(p["name"])))
    by_name = _codes(F.transform(fits, lambda p: p["name"]))
    sides = _all(said, r"(?<![a-z])north (?:and|or|&) south (carolina|dakota)(?![a-z])", 1)
    both = F.flatten(F.transform(sides, lambda s: F.array(code_of(F.concat(F.lit("north "), s)), code_of(F.concat(F.lit("south "), s)))))
    district = F.when(said.rlike(r"(?<![a-z])d\. ?c\."), F.array(F.lit("DC"))).otherwise(F.array().cast("array<string>"))
    line = F.regexp_replace(written, r"\s+", " ")
    line = F.when(said.rlike(r"(?<![a-z])count(?:y|ies)(?![a-z])"), F.regexp_replace(line, rf"\((?:{CODES})\)", " ")).otherwise(line)
    whole = F.regexp_replace(line, rf"(?<=(?i:{PART_BEFORE}))(?:{CODES})\b|(?<=(?i:{OF_PLACE}))(?:{CODES})\b|\b(?:{CODES})(?=(?i:{PART_AFTER}))", " ")
    listed = codes_written(line)
    by_code = F.when(line != F.upper(line), F.array_intersect(listed, _all(whole, rf"\b({CODES})\b", 1))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(by_name, both, district, by_code))
