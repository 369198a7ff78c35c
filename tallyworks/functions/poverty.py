"""Percentages of the poverty level in quotes: how they are written, and whether one limits an income.

All take a quote in the form of ``text.normal_of`` and are built-in expressions. A number's surroundings are cut from
the few characters beside it, so the work grows with a quote's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings about the poverty level, free care, and help that a percentage may size.
POVERTY = r"federal poverty|\bfpl\b|\bfpg\b|poverty (?:level|guideline|income)"
POVERTY_OR_LINE = rf"{POVERTY}|\bfpig\b|\bpoverty line\b"
POVERTY_AFTER = rf"{POVERTY_OR_LINE}|\bof poverty\b"
FREE_SENTENCE = (
    r"\bfree (?:hospital |medical )?care\b|\bfree of charge\b|\bno[- ]cost\b|\bat no charge\b"
    r"|\b100 ?(?:%|percent) (?:discount|reduction|write[- ]?offs?|financial assistance|charity"
    r"|adjustment|off\b)|\b(?:discount|reduction|write[- ]?off|adjustment) of 100 ?(?:%|percent)"
    r"|\bone hundred percent\b|\bfull(?:y)? (?:write[- ]?off|covered|discounted|charity)"
)
FREE_IN_PLAIN_WORDS = (
    r"\bnot (?:be )?(?:billed|charged)\b(?! (?:for )?(?:more|any more|in excess|interest|a fee)\b)|\bcharity care at 100 ?(?:%|percent)"
    r"|\b100 ?(?:%|percent) of (?:all |the |total |their )?(?:charges|bills?|balances?)\b(?: \S+){0,3}? (?:forgiven|waived|written off)\b"
    r"|\b(?:completely|entirely|totally) free\b"
)
POVERTY_LINE = (
    r"(?:at or below|at or under|not exceed|no more than|up to|within|less than or equal to|equal to or less than)\s+(?:100 ?(?:%|percent) of )?"
    r"(?:the\s+)?(?:current\s+|applicable\s+)?(?:federal\s+)?poverty\s+(?:income\s+)?(?:level|guidelines?|line|limits?)"
)
TIED = (
    r" ?(?:%|percent)(?= ?(?:or (?:less|below|under) )?(?:of |above |below |at |under |x |times )?"
    r"(?:the |current |latest |applicable |annual |published )*(?:federal )?(?:poverty|fpl|fpg|fpig))"
)
SIZES_HELP = r"^ ?(?:discount|off\b|write[- ]?off|reduction|adjustment|assistance\b|award|of (?:the |total |all )?(?:charges|bills?|balances?)\b)"
SIZES_QUALIFIED_HELP = (
    r"^ ?\(?(?:(?:charity|financial|full|free|hospital|sliding[- ]?scale)\)? ){0,2}\(?(?:discount|off\b|write[- ]?off|reduction|adjustment"
    r"|assistance\b|award|charity\b|free\b|coverage\b|covered\b|forgiv|waiv"
    r"|of (?:the |total |all |their |your |eligible )*(?:patient'?s? )?(?:charges|bills?|balances?|accounts?)\b)"
)
NOT_A_HEADER = r"\b(?:receives?|qualif\w*|eligible|gets?|will|are|is|discount\w*|charity|assist\w*|free|write|adjust\w*|cover\w*)\b|="
OTHER_BASIS = (
    r"\bincome eligibility (?:limits?|levels?|standards?|thresholds?)\b"
    r"|\b(?:medicaid|medical assistance|mdh|state)(?:'s)?(?: income)?(?: eligibility)? (?:income )?(?:limits?|levels?|standards?|thresholds?)\b"
    r"|\bmedian (?:family |household )?income\b|\b(?:ami|smi)\b"
    r"|\bdepartment of health\b(?! ?(?:and|&) ?human\b)(?! care\b)|\bmdh\b|\bself[- ]sufficiency standard\b|\bliving wage\b"
)
PERCENT = r"^ ?(?:%|percent\b)"
RANGE = r"(?:-|to|through|thru)"
#: Where sentences end.
SENTENCE_END = r"(?<=[.;])\s+|\n{2,}|•|▪"
#: Characters read before and after a number.
REACH_BEFORE, REACH_AFTER = 200, 300


def poverty_text(said: Column) -> Column:
    """A quote with bracketed percentages bare, guidelines without year or publisher, and "not above" as "up to"."""
    t = F.regexp_replace(said, r"\((\d{2,3}(?:\.\d+)? ?(?:%|percent))\)", "$1")
    for _ in range(3):  # "of the 2026 U.S. HHS Poverty Guidelines"
        t = F.regexp_replace(t, r"\b(?:(?:19|20)\d\d|hhs|u\.s\.|us|united states) (?=(?:federal )?(?:poverty|fpl|fpg))", "")
    negated = (
        r"\b(?:does not|do not|cannot|can't|doesn't|don't|not|no|never)(?: to)? "
        r"(?:above|over|more than|greater than|higher than|in excess of|exceeds?|exceeding|beyond)\b"
    )
    return F.regexp_replace(t, negated, "up to")


def plain_number(number: Column) -> Column:
    """A decimal as text without zeros at the end."""
    return F.regexp_replace(number.cast("decimal(18,6)").cast("string"), r"\.?0+$", "")


def number_pattern(number: Column) -> Column:
    """A number as quotes write it: zeros at the end allowed, never within a longer number."""
    n = plain_number(number)
    zeros = F.when(n.contains("."), F.lit("0*")).otherwise(F.lit(r"(?:\.0+)?"))
    return F.concat(F.replace(n, F.lit("."), F.lit(r"\.")), zeros, F.lit(r"(?!\.?\d)"))


def tied_percents(text: Column) -> Column:
    """Percentages of the poverty level in a ``poverty_text``, in order."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<![\d.])(\d{{2,3}}(?:\.\d+)?){TIED}"), F.lit(1))
    return F.transform(found, lambda x: x.cast("decimal(18,6)"))


def around(text: Column, pattern: Column) -> Column:
    """(before, after) of every place where a pattern without groups occurs, so many characters either way."""
    # what stands before is all from the begin, or so many characters; either look-behind is tried at one length
    before = f"(?:(?<=(.{{{REACH_BEFORE}}}))|(?<=(^.{{0,{REACH_BEFORE - 1}}})))"
    place = F.concat(F.lit("(?s)(?="), pattern, F.lit(f"){before}"), pattern, F.lit(f"(?=(.{{0,{REACH_AFTER}}}))"))
    long, whole, after = (F.regexp_extract_all(text, place, F.lit(g)) for g in (1, 2, 3))
    found = F.arrays_zip(long.alias("a"), whole.alias("b"), after.alias("after"))
    return F.transform(found, lambda x: F.struct(F.concat(x["a"], x["b"]).alias("before"), x["after"].alias("after")))


def _at_number(text: Column, number: Column, test: Callable[[Column, Column], Column]) -> Column:
    places = around(F.replace(text, F.lit(","), F.lit("")), F.concat(F.lit(r"(?<![\d.$])"), number_pattern(number)))
    return F.exists(places, lambda p: test(p["before"], p["after"]))


def states_income_limit(text: Column, number: Column) -> Column:
    """Whether a ``poverty_text`` gives a number as the most that a household may earn.

    It ends a range; or it sizes no help and has the poverty level's words or "or less" within six words and before the
    next number, the poverty level as its column's head, "up to" or the like within three words before it, or a band
    that starts just above it within three words after. The start of a range never counts.
    """

    def limits(before: Column, after: Column) -> Column:
        rest = F.regexp_replace(after, PERCENT, "")
        until_next = F.regexp_extract(rest, r"^\D*", 0)
        floor = rest.rlike(rf"^ ?{RANGE} ?\d") | (before.rlike(r"\bbetween ?$") & rest.rlike(r"^ ?and ?\d"))
        ends = before.rlike(rf"(?:\d+(?:\.\d+)? ?(?:%|percent)? ?{RANGE}|\bbetween \d+(?:\.\d+)? ?(?:%|percent)? and) ?$")
        soon = lambda p: until_next.rlike(rf"^ ?(?:\S+ ){{0,5}}\S*?(?:{p})")
        head = before.rlike(rf"(?<!\d ?(?:%|percent)? ?(?:of (?:the )?)?)(?:{POVERTY_OR_LINE})(?=\S*(?: ?\S+){{0,3}} ?$)(?:(?!{NOT_A_HEADER}).)*$")
        most = before.rlike(r"(?:\bup to\b|\bless than\b|\bunder\b|\bbelow\b)(?: ?\S+){0,3} ?$|(?:≤|<=?) ?$")
        starts = F.array(*[F.regexp_extract(rest, rf"^ ?(?:\S+ ){{{k}}}\D??(\d+(?:\.\d+)?) ?(?:%|percent)? ?(?:-|to\b|through\b|thru\b)", 1) for k in range(3)])
        nexts = F.exists(starts, lambda s: (s.try_cast("decimal(18,6)") > number) & (s.try_cast("decimal(18,6)") <= number + 1))
        named = soon(POVERTY_AFTER) | soon(r"\b(?:or|and) (?:less|below|lower|under)\b") | head | most | F.coalesce(nexts, F.lit(False))
        return ~rest.rlike(SIZES_HELP) & ~floor & (ends | (~rest.rlike(SIZES_QUALIFIED_HELP) & named))

    return _at_number(text, number, limits)


def states_poverty_line(said: Column) -> Column:
    """Whether a quote gives free care up to the poverty line without its number."""
    return said.rlike(POVERTY_LINE) & said.rlike(FREE_SENTENCE)


def percent_of_other_basis(text: Column, number: Column) -> Column:
    """Whether a ``poverty_text`` gives a number as a percentage of another measure than the poverty level.

    The measure follows the sign at once or within ten words after "of", in the same sentence, before the next number,
    and no word of the poverty level stands within twenty words before that number.
    """

    def other(before: Column, after: Column) -> Column:
        rest = F.regexp_extract(F.regexp_replace(after, PERCENT, ""), r"^\D*", 0)
        words = F.regexp_extract(rest, r"^ ?(?:\S+ ?){0,20}", 0)
        sentence = F.get(F.split(words, r"(?<=[.;])\s"), F.lit(0))
        return after.rlike(PERCENT) & ~words.rlike(POVERTY_AFTER) & sentence.rlike(rf"^ ?(?:the )?(?:{OTHER_BASIS})|^ ?of (?:\S+ ){{0,9}}(?:{OTHER_BASIS})")

    return _at_number(text, number, other)


def free_care_limits(said: Column) -> Column:
    """The percentages that a document's sentences about free care name, each once, in order of size."""
    return _limits(said, lambda s: s.rlike(POVERTY) & (s.rlike(FREE_SENTENCE) | s.rlike(FREE_IN_PLAIN_WORDS)))


def _limits(said: Column, test: Callable[[Column], Column]) -> Column:
    sentences = F.filter(F.split(said, SENTENCE_END), test)
    found = F.flatten(F.transform(sentences, lambda s: tied_percents(poverty_text(s))))
    return F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<decimal(18,6)>"))


def help_limits(said: Column) -> Column:
    """The percentages that a document's sentences about the hospital's own help name."""
    from tallyworks.operators.wording import own_help

    return _limits(said, lambda s: poverty_text(s).rlike(POVERTY) & own_help(poverty_text(s)))
