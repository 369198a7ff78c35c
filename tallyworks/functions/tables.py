"""Discount tables and free bands in texts: ranges, added discounts, columns, fees, and for whom a table is.

All are built-in expressions over texts in the form of ``text.normal_of``; ``tiers`` are arrays of (low, high, percent).
What stands after a match is caught in a look-ahead with the match itself, so a text is gone through once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyworks.functions.poverty import SENTENCE_END, plain_number, poverty_text
from tallyworks.operators.corpus import number_stated

# Wordings of a discount that is a range or a bound.
_PERCENT = r"(\d+(?:\.\d+)?)\s*%"
RANGE_BEFORE = (
    r"\b(?:discounts?|reductions?|reduc\w+|write[- ]?offs?)\s+(?:of\s+)?(?:(?:that\s+)?(?:ranging|ranges?)\s+)?(?:from\s+)?"
    rf"(?:(at least|up to|between)\s+)?{_PERCENT}(?:\s*(?:to|-|and)\s*{_PERCENT})?"
)
RANGE_AFTER = rf"(?:(at least|up to)\s+)?{_PERCENT}(?:\s*(?:to|-)\s*{_PERCENT})?\s*(?:discount|reduction|off\b|write)"
_NUMBER, _SIGN = r"(?<![\d.,$])(\d+(?:\.\d+)?)", r"(?:\s*%|\s*percent\b|\s*per cent\b)"
_NOUN = r"(?:discounts?|reductions?|reduc\w+|write[- ]?offs?|adjustments?)"
_LABELS = "level tier category step class group section band fpl fpg poverty %".split()
_NOT_AFTER = "".join(rf"(?<!{word} )" for word in _LABELS)
_SPAN = rf"(?:between\s+{_NUMBER}{_SIGN}?\s*(?:-|to|and)\s*{_NUMBER}{_SIGN}|{_NOT_AFTER}{_NUMBER}{_SIGN}?\s*(?:-|to|through)\s*{_NUMBER}{_SIGN})"
SPAN_FIRST = rf"{_SPAN}\)?\s*(?:discount|reduction|adjustment|off\b|write)"
NOUN_FIRST = (
    rf"\b{_NOUN}\s+(?:(?:will|can|may|shall)\s+(?:be\s+)?|is\s+|are\s+|var(?:y|ies)\s+|off\s+(?:of\s+)?(?:the\s+)?(?:gross\s+|total\s+)?(?:charges|balance)\s+)?"
    rf"((?:that\s+)?(?:ranging|ranges?)\s+)?(?:of\s+|from\s+|(?=between)){_SPAN}"
)
ON_SCALE = (
    rf"\b{_NOUN}\s+(?:(?:from|on|based on|according to)\s+)?(?:a|the)\s+(?:sliding[- ]?(?:fee\s+)?)?scale\s+(?:(?:ranging\s+)?from\s+|of\s+)?"
    rf"{_NUMBER}{_SIGN}?\s*(?:-|to|through)\s*{_NUMBER}{_SIGN}"
)
# A discount on top of another, unless it has a base of its own.
ADDED = r"\badditional (\d+(?:\.\d+)?) ?(?:%|percent) (?:discount|reduction|off\b|adjustment|write)"
OWN_BASE = r"\S* (?:(?:from|off|of|on) )?(?:the )?(?:amounts? generally billed|agb\b|patient'?s? out ?-?of ?-?pocket)"
# Rows and columns of a table.
ROW_PERCENT = r"(?<![\d.$])(\d{1,3}(?:\.\d+)?) ?%"
NEXT_ROW = r"(?<![\d.])\d{1,3} ?%? ?(?:-|to|through|thru) ?\d{2,3} ?%"
ROW_CHARS = 60
REGULATED, UNREGULATED = "hscrc-regulated", "non-hscrc"
# For whom a table is.
POPULATION = r"\b(?:un-?|under-?)?insured\b"
INSURED_LEAD = r"(?:^|[.:;] |\bfor (?:qualifying |eligible |all )?)insured (?:patients?|individuals?|persons?)\b"
BOTH_POPULATIONS = r"\b(?:un-?|under-?)insured (?:and|or|&|/) ?$"
OTHER_POPULATION = r"\b(?:un-?|under-?)insured\b|\bself[- ]pay\b"
UNINSURED_LEAD = r"\b(?:un-?insured|unsured|self[- ]pay) (?:patients?|individuals?|persons?)\b"
BARE_INSURED = r"(?<![\w-])insured (?:patients?|individuals?|persons?)\b"
SEGMENT = r"•|(?<=[.;]) "
LEAD_CHARS, UNINSURED_CHARS, FOUND_BY = 250, 900, 80
# What a free band still charges, and a fee that is not charged.
CHARGES = (
    r"(?:\b(?:patient|service|visit|flat) fees?\b|\b(?:nominal|minimal) (?:payments?|fees?|amounts?|charges?)\b(?! (?:will be |is |are )?(?:waived|collected|due))"
    r"|\$ ?[1-9][\d,]*(?:\.\d\d)? ?(?:/|per\b)(?! ?(?:additional |each |extra )?(?:person|member|family|individual|dependent|household)"
    r"| ?(?:calendar )?(?:yr|year|annum|mo|month|wk|week|hr|hour)s?\b(?! (?:fees?|charges?|co-?pays?)\b))|\b(?:visit|department|room|clinic)s?\b:? ?\$ ?[1-9])"
)
# up to three words, of 60 characters at most each: a look-behind must have a greatest length
NOT_CHARGED_BEFORE = r"\b(?:no|without|waives?|waived|not)\b" + r"(?: \S{1,60})?" * 3 + " ?"
NOT_CHARGED_AFTER = r"\W{0,3}(?:(?!not )\S+ ){0,3}?(?:is |are |will be |shall be )?(?:waived|not (?:be )?(?:charged|collected|required|apply))"
# Bands of the poverty level and full help after one.
_END = r"(\d{2,3}(?:\.\d+)?) ?(?:%|percent)?"
BAND = (
    rf"(?<![\d.$]){_END} ?(?:-|to|through|thru|and|but (?:less than or equal to|not (?:more|greater) than|no more than|up to)|and (?:up to|less than or equal to)) ?"
    rf"{_END} ?(?:%|percent)"
)
FULL_HELP_AFTER = (
    r"[^%\d]{0,120}?(?:\b100 ?(?:%|percent) (?:financial assistance|charity|discount|adjustment|write[- ]?off|reduction|of (?:the )?(?:charges|balance)|free)|\bfree care\b"
    r"|\bfree of charge\b|\bno cost\b|\bat no charge\b)"
)
COST_SHARING = r"\bco-?pays?\b|\bco-?payments?\b|\bco-?insurance\b|\bdeductibles?\b|\bout[- ]of[- ]pocket\b"
INSURED_ONLY = r"\b(?:have|has|with) (?:health )?insurance\b|(?<![\w-])insured patients?\b|\bafter insurance\b"
HEDGED_FULL = r"\bmay\b[^.;]*\bup to (?:a |an )?(?:100 ?(?:%|percent)|one hundred percent)"

DECIMALS = "array<decimal(18,6)>"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """Every match of a pattern as an array of its ``n`` groups, those that take no part empty."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)).alias(f"g{g + 1}") for g in range(n)])


def _number(x: Column) -> Column:
    return F.nullif(x, F.lit("")).cast("decimal(18,6)")


def range_discounts(said: Column) -> Column:
    """The ends of every discount that a quote gives as a range ("55% to 75%") or a bound ("at least 25%")."""
    none = F.array().cast(DECIMALS)
    bounded = [
        F.flatten(F.transform(_groups(said, p, 3), lambda m: F.when(m["g3"] != "", F.array(_number(m["g2"]), _number(m["g3"]))).when(m["g1"] != "", F.array(_number(m["g2"]))).otherwise(none)))
        for p in (RANGE_BEFORE, RANGE_AFTER)
    ]

    def spans(pattern: str, ranging: bool, numbers: int) -> Column:
        first = 2 if ranging else 1

        def ends(m: Column) -> Column:
            of = [F.nullif(m[f"g{first + k}"], F.lit("")) for k in range(numbers)]
            a, b = (_number(F.coalesce(*of[k::2])) for k in (0, 1))
            # past 100 it is an income band, and downward only where the quote says that it ranges
            falls = (a > b) & (m["g1"] != "") if ranging else F.lit(False)
            return F.when((F.greatest(a, b) <= 100) & ((a < b) | falls), F.array(a, b)).otherwise(none)

        return F.flatten(F.transform(_groups(said, pattern, numbers + first - 1), ends))

    return F.array_distinct(F.concat(*bounded, spans(SPAN_FIRST, False, 4), spans(NOUN_FIRST, True, 4), spans(ON_SCALE, False, 2)))


def added_discounts(said: Column) -> Column:
    """Discounts that a quote adds to another one."""
    return F.transform(F.regexp_extract_all(said, F.lit(f"{ADDED}(?!{OWN_BASE})"), F.lit(1)), _number)


def of_tiers(tiers: Column, numbers: Column) -> Column:
    """Whether a band's discount is among some numbers."""
    return F.exists(tiers, lambda b: F.array_contains(numbers, b["percent"].cast("decimal(18,6)")))


def row_percents(text: Column, band: Column) -> Column:
    """The percentages in a band's own row of a table, or null where no row is labelled with the band."""
    low, high = F.floor(band["low"]), F.floor(band["high"]).cast("string")

    def row(start: Column) -> Column:
        label = F.concat(F.lit(r"(?s)(?<![\d.])"), start.cast("string"), F.lit(" ?%? ?(?:-|to|through|thru) ?"), high, F.lit(" ?%"))
        rest = F.call_function("regexp_extract", text, F.concat(label, F.lit("(.*)")), F.lit(1))
        own = F.when(rest.rlike(NEXT_ROW), F.get(F.split(rest, NEXT_ROW), F.lit(0))).otherwise(F.left(rest, F.lit(ROW_CHARS)))
        return F.when(F.rlike(text, label), F.transform(F.regexp_extract_all(own, F.lit(ROW_PERCENT), F.lit(1)), _number))

    return F.coalesce(row(low + 1), row(low))


def wrong_column(said: Column, state: Column, tiers: Column) -> Column:
    """Whether a band's discount is not the one of this hospital's column, in a table with one for regulated services
    (Maryland's hospitals, the first column) and one for all others (the last)."""

    def off(band: Column) -> Column:
        row = row_percents(said, band)
        own = F.when(F.upper(state) == "MD", F.get(row, F.lit(0))).otherwise(F.get(row, F.size(row) - 1))
        return F.coalesce((F.size(F.array_distinct(row)) >= 2) & (band["percent"].cast("decimal(18,6)") != own), F.lit(False))

    return F.contains(said, F.lit(REGULATED)) & F.contains(said, F.lit(UNREGULATED)) & F.exists(tiers, off)


def charges_patient(said: Column) -> Column:
    """Whether a quote charges the patient a fee, a nominal payment or an amount per visit that it doesn't waive.

    A fee is waived within three words after it, or negated up to three words, of 60 characters at most, before it.
    """
    fees = _groups(said, rf"(?=({CHARGES}))(?:(?<={NOT_CHARGED_BEFORE})(?=(.)))?{CHARGES}(?=({NOT_CHARGED_AFTER})?)", 3)
    return F.exists(fees, lambda m: (m["g2"] == "") & (m["g3"] == ""))


def full_help_bands(plain: Column) -> Column:
    """(low, high) of the bands of the poverty level to which a document gives full help: not "up to 100%" that it may
    give, not for cost sharing or insured patients alone, and not with a fee."""
    free = lambda s: ~s.rlike(f"{HEDGED_FULL}|{COST_SHARING}|{INSURED_ONLY}") & ~charges_patient(s)
    sentences = F.filter(F.split(poverty_text(plain), SENTENCE_END), lambda s: s.rlike(BAND))
    bands = F.transform(F.filter(sentences, free), lambda s: F.filter(_groups(s, f"{BAND}(?=({FULL_HELP_AFTER})?)", 3), lambda m: m["g3"] != ""))
    return F.transform(F.flatten(bands), lambda m: F.struct(_number(m["g1"]).alias("low"), _number(m["g2"]).alias("high")))


def helped_above(bands: Column, limit: Column) -> Column:
    """Whether full help goes on in a band that starts just above a limit."""
    return F.coalesce(F.exists(bands, lambda b: (b["low"] > limit) & (b["low"] <= limit + 1) & (b["high"] > limit)), F.lit(False))


def for_insured(plain: Column, said: Column) -> Column:
    """Whether a document introduces a quoted table for insured patients only.

    Of the LEAD_CHARS characters before the quote the last population named is insured patients, in a heading or a
    lead-in, without others beside them, and the quote itself names no others. Both are in comparable form.
    """
    at = F.position(F.left(said, F.lit(FOUND_BY)), plain)
    begin = F.greatest(F.lit(1), at - LEAD_CHARS - 1)  # one character more, so that a word cut in two isn't taken for another
    lead = F.substring(plain, begin, at - begin)
    last = F.get(F.reverse(F.regexp_extract_all(lead, F.lit(POPULATION), F.lit(0))), F.lit(0))
    before, after = (F.regexp_extract(lead, r"(?s)^(.*)\binsured\b(.*)$", g) for g in (1, 2))
    near = F.concat(F.right(before, F.lit(31)), F.lit("insured"), F.left(after, F.lit(12)))
    named = F.coalesce(last == "insured", F.lit(False)) & near.rlike(INSURED_LEAD) & ~before.rlike(BOTH_POPULATIONS)
    return (at > 0) & ~said.rlike(OTHER_POPULATION) & named


def uninsured_passages(plain: Column) -> Column:
    """Passages of a document that begin at uninsured patients and go on for UNINSURED_CHARS or to insured ones."""
    found = _groups(plain, rf"(?s)({UNINSURED_LEAD})(?=(.{{0,{UNINSURED_CHARS}}}))", 2)
    return F.transform(found, lambda m: F.concat(m["g1"], F.get(F.split(m["g2"], BARE_INSURED), F.lit(0))))


def gives_tiers(passages: Column, tiers: Column) -> Column:
    """Whether one passage gives every band its discount: in the band's row, else in one bullet or sentence."""

    def stated(passage: Column, band: Column) -> Column:
        low = band["low"].cast("decimal(18,2)")
        names = lambda s, x: number_stated(s, plain_number(x))
        segment = lambda s: (names(s, low) | names(s, low + 1)) & names(s, band["high"]) & names(s, band["percent"])
        row = row_percents(passage, band)
        return F.when(row.isNotNull(), F.array_contains(row, band["percent"].cast("decimal(18,6)"))).otherwise(F.exists(F.split(passage, SEGMENT), segment))

    return F.coalesce(F.exists(passages, lambda p: F.forall(tiers, lambda b: stated(p, b))), F.lit(False)) & (F.size(tiers) > 0)

