"""What a quote must say for a list, a ceiling, an income limit, a flag or a residency to stand on it.

Each rule gives its reason against a value, or null. Quotes come in the form of ``text.normal_of`` (``said``), of
``poverty.poverty_text`` (``text``), and as written (``quote``) where capitals count. All are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyworks.functions import places
from tallyworks.functions import poverty as p
from tallyworks.operators.corpus import number_stated
from tallyworks.operators.facts import first_reason

DOCUMENTS, CHANNELS, PROGRAMS, PROVIDERS = "apply.documents_required", "apply.submit_methods", "programs.presumptive", "coverage.covered_providers"
# What a quote must say for each kind of a list to stay on it, in comparable form.
DOCUMENT_MARKERS = {
    "photo_id": r"photo[- _]?id|\bid\b|identification|identity|driver|passport|government[- ]issued|military id|state[- ]issued",
    "proof_of_income": r"income|\bw-?2\b|\b1099\b|\bwages?\b|earnings|salary|pay ?check",
    "social_security_letter": r"social security|\bssa\b|benefit (?:letter|statement|award)|award letter",
    "tax_return": r"tax (?:return|form|transcript|filing)|\b1040\b|income tax|tax_return|\btaxes\b",
    "pay_stubs": r"pay ?stubs?|paystubs?|check stubs?|payroll|pay_stubs|wage statement",
    "bank_statements": r"\bbank\b|checking|savings account|investment (?:account|statement)",
    "proof_of_residency": r"residen\w*|proof of address|\blease\b|utility",
    "insurance_card": r"insurance",
    "medicaid_denial": r"denial|denied|turned down",
}
CHANNEL_MARKERS = {
    "mail": r"(?<![e-])\bmail\w*|\baddress\b|p\.? ?o\.? box|\bbox \d|\bwrite to\b|\bpostal\b|\bsend\b|\breturn\b|\bstreet\b|\bst\.|\bsuite\b|\bste\b|\bave\b|avenue|\broad\b|\brd\b|\bblvd\b|\bdrive\b|\b[a-z]{2} \d{5}(?:-\d{4})?\b",
    "fax": r"\bfax",
    "email": r"e-?mail|@|electronic mail",
    "portal": r"online|portal|website|\bweb\b|\bapp\b|www\.|https?://|download|\.org\b|\.com\b|electronically|mychart",
    "in_person": r"in[- ]person|\bvisit|registration|\boffice|stop (?:at|by|in)|lobby|counsel|\bbring\b|department|\blocation|campus|\bdesk\b|\bwindow\b|admitting|admissions|\bat any\b",
    "phone": r"\bphone|\bcall|\btel\b|telephone|\(\d{3}\) ?\d{3}|\b\d{3}[-. ]\d{3}[-. ]\d{4}\b",
}
PRESUMPTIVE = r"presumptiv|automatic|\bdeem|qualify for (?:free|100)|enrolled in|enrollment in|eligibility in|means[- ]tested|without further|participat\w+ in|active (?:medicaid|medi-cal|masshealth)|\bhsn (?:full|partial)\b"
PROGRAM_SYNONYMS = {
    "medicaid": r"\bmedicaid\b|\bmedi-cal\b|masshealth|mass health|\bmedical assistance\b|apple health",
    "snap": r"\bsnap\b|calfresh|food stamps?|supplemental nutrition",
    "wic": r"\bwic\b|women,? infants",
    "liheap": r"liheap|low[- ]income home energy",
    "tanf": r"\btanf\b|temporary assistance",
    "ssi": r"\bssi\b|supplemental security",
    "health safety net": r"health safety net|\bhsn\b",
    "medicare": r"medicare",
    "chip": r"\bchip\b|children's health insurance",
    "section 8": r"section 8|housing choice voucher",
    "head start": r"head start",
    "connector": r"connector",
}
PROGRAM_GENERIC = "program programs plan the and for of with assistance health care medical state patients patient eligible eligibility coverage services county local other".split()
SENTENCE_SHAPED = r"\b(?:is|are|was|were|has|have|will|may|must)\b|\.$"
LONGEST_PROGRAM, LONGEST_PROVIDER = 60, 120
# Wordings about ceilings.
FLOOR_BEFORE = r"\b(?:above|over|more than|greater than|higher than|in excess of|exceeds?|exceeding|at least|beyond|a minimum of)(?: \S+){0,3} ?$"
HELP = r"\bassist\w*|\bdiscount\w*|\bcharit\w*|\bqualif\w*|\beligib\w*|\bsliding\b|\breduc\w*|\bwrite[- ]?offs?\b|\bfinancial aid\b"
OTHER_PROGRAMS = r"health safety net|\bhsn\b|\bmedicaid\b|\bmedi-cal\b|masshealth|mass health|marketplace|health connector|insurance exchange|\bchip\b|\b(?:state|county)(?:'s)? (?:program|plan)"
PARTIAL_HELP = (
    r"\bsliding\b|\bpartial\w*|\breduced\b|\breduction in charges\b|\bdiscounted\b|\bdiscounts?\b(?! of 100)(?! ?\(100)|\bagb\b|\bamounts? generally billed\b"
    r"|(?<![\d.])[1-9]\d?(?:\.\d+)? ?(?:%|percent) (?:discount|reduction|adjustment|write|financial assistance|charity|of (?:agb|charges))"
)
# Headings and subjects that make what follows a state's own.
STATE_HEADING = rf"\b(?:for|in|at) (?:all |our |its )?(?:the )?({places.NAMES})(?:[- ]based)? (?:facilities|hospitals|entities|locations|providers|patients|residents)\b"
STATE_FACILITY = rf"\b(?:[Aa]n?|[Tt]he|[Ee]ach|[Aa]ny|[Aa]ll|[Ee]very|[Ss]uch) ({places.CODES}) [A-Z]{{2,6}} (?:[Hh]ospitals?|[Ff]acilit(?:y|ies)|[Ee]ntit(?:y|ies)|[Ll]ocations?)\b"
# Wordings about insured patients.
INSURED = r"(?<!un-)\binsured\b|\bunder-?insured\b|\binsurance\b|\bdeductibles?\b|\bco-?pay\w*|\bco-?insurance\b|\bout-of-pocket\b"
INSURED_LEFT_OUT = (
    r"(?<!not )\bonly (?:to |for )?(?:the )?uninsured\b|\buninsured (?:patients |individuals |persons )?only\b|\bmust (?:be|remain) uninsured\b"
    r"|\b(?:limited|restricted) to (?:the )?uninsured\b"
    r"|(?<!not )\bonly (?:to |for )?(?:patients|individuals|persons|people|those) (?:who (?:do not|don't|does not) have|with no|without) (?:any )?(?:health )?(?:insurance|coverage)\b"
    r"|(?<![\w-])insured (?:patients?|individuals?|persons?|people) (?:are|is|will|shall|do|does)(?: be)? (?:not|never) (?:be )?(?:eligible|covered|qualify|considered for)\b"
    r"|\b(?:patients|individuals|persons|people|those) (?:with|who have) (?:health |private |commercial |third[- ]party )?(?:insurance|coverage)(?: coverage)? (?:are|is|will|shall|do|does)(?: be)? not (?:be )?(?:eligible|covered|qualify)\b"
    r"|\b(?:patients|individuals|persons|people) who are insured (?:are|is|will|shall|do|does)(?: be)? not (?:be )?(?:eligible|covered|qualify)\b"
    r"|\bnot (?:available|offered|open|extended) to (?:insured|patients (?:with|who have) (?:health )?insurance)\b"
    r"|\b(?:does|do|shall|will) not apply to (?:insured|patients (?:with|who have) (?:health )?insurance)\b"
    r"|\bnot (?:be )?eligible for financial assis ?tance\b[^.;]{0,80}?\bif (?:the patient|they|you) (?:is|are) eligible to receive (?:reimbursement|payment) for any portion\b[^.;]{0,120}\binsurance\b"
    r"|\bexclud\w* (?:all )?(?:insured|patients (?:with|who have) (?:health )?insurance)\b"
    r"|\b(?:cannot|can not|may not|must not) be covered by (?:any |private |health |commercial |third[- ]party )*insurance\b|\bmust be self[- ]?pay\b"
)
INSURED_HELPED = (
    r"\bunder[- ]?insured\b|\b(?:limited|inadequate|insufficient|partial)(?: or no)? (?:health )?(?:insurance|coverage)\b|\bwith or without (?:an? )?(?:health )?insurance\b"
    r"|\b(?:sufficient|adequate|enough) (?:health )?insurance\b|\binsurance (?:coverage )?or assets\b"
)
OTHER_RATE = r"\b(?:true )?(?:self[- ]?pay|uninsured|cash|prompt[- ]?pay(?:ment)?) (?:discounts?|rates?|prices?|pricing)\b|\bdiscounted cash price\b"
CAP_TAIL = r"(?:(?!,\s*(?:and|but|while|however|although)\b)[^.;])*"
PRICE_CAP = rf"\b(?:charged|billed|pay|paid|owe|responsible to pay)\b[^.;]{{0,15}}?\b(?:more|greater|higher)\b[^.;]{{0,80}}?\bthan\b{CAP_TAIL}|amounts? generally billed{CAP_TAIL}"
AGB_CLAUSE = r"amounts? generally billed[^.;]*"
PAYMENT_TERMS = r"\bpayment (?:plans?|arrangements?)\b|\bprompt[- ]?pay(?:ment)? discounts?\b|\b(?:payment|paid) in full\b|\b(?:billing )?statements?\b"
POLICY_WORDS = r"\bfinancial (?:assistance|aid)\b|\bcharity\b|\bfree\b|\bdiscount\w*|\bwrite[- ]?offs?\b|\bwritten off\b|\bforgiv\w+|\breduc\w+|\bsliding\b|\bfap\b"
NOT_INSURED = (
    r"\b(?:(?:do|does|did) not|don't|doesn't) have (?:any )?(?:form of )?(?:health |medical )?(?:insurance|coverage)(?: coverage)?\b"
    r"|\b(?:has|have|with) no (?:health |medical )?(?:insurance|coverage)(?: coverage)?\b|\bwithout (?:any )?(?:health |medical )?(?:insurance|coverage)(?: coverage)?\b"
    r"|\bno (?:health |medical )?insurance(?: coverage)?\b|\bnot insured\b|\b(?:purchase|obtain|buy|enroll in|apply for) (?:health )?(?:insurance|coverage)\b"
)
OTHER_PAYER = r"\bcoverage\b|\bmedicare\b|\bthird[- ]party\b|\bpay[eo]rs?\b|\bcovered\b|\bportion of (?:the|your|their) bill\b"


def _without(said: Column, pattern: str) -> Column:
    return F.regexp_replace(said, pattern, " ")


def marked(said: Column, item: Column, markers: dict[str, str]) -> Column:
    """Whether a quote says what an item of a fixed list needs; false for items that are not on it."""
    return F.coalesce(*[F.when(item == kind, said.rlike(marker)) for kind, marker in markers.items()], F.lit(False))


def _program_named(said: Column, item: Column) -> Column:
    """Whether a quote names a programme: a synonym of it, its name, or all of its telling words."""
    synonym = F.coalesce(*[F.when(item.rlike(x), said.rlike(x)) for x in PROGRAM_SYNONYMS.values()], F.lit(False))
    words = F.filter(F.regexp_extract_all(item, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(PROGRAM_GENERIC))
    return synonym | F.contains(said, item) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(said, w)))


def program_stands(said: Column, as_is: Column, plain: Column) -> Column:
    """Whether a listed programme is short enough, no sentence, and named by the quote."""
    return (F.length(as_is) <= LONGEST_PROGRAM) & ~F.lower(as_is).rlike(SENTENCE_SHAPED) & _program_named(said, plain)


def provider_stands(said: Column, as_is: Column, plain: Column) -> Column:
    return (F.length(as_is) <= LONGEST_PROVIDER) & F.contains(said, plain)


def named_items(path: Column, said: Column, items: Column, said_items: Column) -> Column:
    """The items of a list that its quote names, each once but for ways to apply; null for paths that are no such lists.

    "other" among documents stays once something else is named, unless the list is all there is.
    """
    pairs = F.array_distinct(F.arrays_zip(items.alias("as_is"), said_items.alias("plain")))
    documents = F.filter(F.array_distinct(items), lambda i: marked(said, i, DOCUMENT_MARKERS))
    all_kinds = F.forall(F.array(*map(F.lit, DOCUMENT_MARKERS)), lambda k: F.array_contains(items, k))
    other = F.when((F.size(documents) > 0) & F.array_contains(items, "other") & ~all_kinds, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    by = lambda stands: F.transform(F.filter(pairs, lambda x: stands(said, x["as_is"], x["plain"])), lambda x: x["as_is"])
    programs = F.when(said.rlike(PRESUMPTIVE), by(program_stands)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(path == DOCUMENTS, F.concat(documents, other)).when(path == CHANNELS, F.filter(items, lambda i: marked(said, i, CHANNEL_MARKERS)))
        .when(path == PROGRAMS, programs).when(path == PROVIDERS, by(provider_stands))
    )


def list_problem(path: Column, said: Column, items: Column, said_items: Column) -> Column:
    """Why a list doesn't stand on its quote: nothing of it is named, or only a part.

    ``said_items`` are the items in comparable form. Items given twice are a part too many, but for ways to apply.
    "other" among documents stands once something else is named, unless the list is all there is.
    """
    all_kinds = F.forall(F.array(*map(F.lit, DOCUMENT_MARKERS)), lambda k: F.array_contains(items, k))
    named = F.filter(F.array_distinct(items), lambda i: marked(said, i, DOCUMENT_MARKERS))
    n_documents = F.size(named) + F.when(F.array_contains(items, "other") & ~all_kinds, 1).otherwise(0)
    n_channels = F.size(F.filter(items, lambda i: marked(said, i, CHANNEL_MARKERS)))
    pairs = F.array_distinct(F.arrays_zip(items.alias("as_is"), said_items.alias("plain")))
    n_programs = F.size(F.filter(pairs, lambda x: program_stands(said, x["as_is"], x["plain"])))
    n_providers = F.size(F.filter(pairs, lambda x: provider_stands(said, x["as_is"], x["plain"])))
    part = "quote does not name every listed item"

    def rule(at: str, what: str, some: Column, n: Column) -> list[tuple[str, Column]]:
        return [(f"none of the listed {what} is named in the quote", (path == at) & (some == 0)), (part, (path == at) & (n < F.size(items)))]

    return first_reason(
        *rule(DOCUMENTS, "documents", F.size(named), n_documents), *rule(CHANNELS, "channels", n_channels, n_channels),
        ("quote does not describe presumptive (automatic) eligibility", (path == PROGRAMS) & ~said.rlike(PRESUMPTIVE)),
        *rule(PROGRAMS, "programs", n_programs, n_programs), *rule(PROVIDERS, "providers", n_providers, n_providers),
    )


def _own_words(text: Column) -> Column:
    return _without(text, rf"\b(?:not|ineligible|denied|no|without)\b(?: \S+){{0,4}}? (?:{OTHER_PROGRAMS})")


def own_help(text: Column) -> Column:
    """Whether a sentence is about the hospital's own help with the bill; programmes that it rules out don't count."""
    own = _own_words(text)
    return own.rlike(HELP) & ~own.rlike(rf"{OTHER_PROGRAMS}|payment plans?|installment|extended payment")


def only_free_band(said: Column) -> Column:
    """Whether a quote promises free care and nothing less."""
    from tallyworks.operators.verify import CEILING_WORDING, UP_TO_FULL

    return ~said.rlike(UP_TO_FULL) & ~said.rlike(CEILING_WORDING) & said.rlike(p.FREE_SENTENCE) & ~_without(said, p.FREE_SENTENCE).rlike(PARTIAL_HELP)


def ceiling_problem(said: Column, text: Column, ceiling: Column) -> Column:
    """Why a quote can't carry an assistance ceiling: it must give it as a percentage of the poverty level, as the
    highest that it names and no floor, with more than the free band, and about the hospital's own help."""
    tied = p.tied_percents(text)
    pattern = F.concat(F.lit(r"(?<![\d.])"), p.number_pattern(ceiling), F.lit(p.TIED))
    return first_reason(
        ("quote does not state the ceiling as a percentage of the poverty level", ~F.exists(tied, lambda x: x == ceiling)),
        ("quote states the percentage as a floor (above, over, at least), not a ceiling", F.exists(p.around(text, pattern), lambda x: x["before"].rlike(FLOOR_BEFORE))),
        ("quote names a higher income limit than the ceiling", F.exists(tied, lambda x: x > ceiling)),
        ("quote states the free-care band, not the ceiling", F.forall(tied, lambda x: x == ceiling) & only_free_band(said)),
        *_own_help_rules(text),
    )


def _own_help_rules(text: Column) -> list[tuple[str, Column]]:
    return [
        ("quote does not say the hospital's financial assistance reaches it", ~_own_words(text).rlike(HELP)),
        ("quote is about another program or a payment plan", ~own_help(text)),
    ]


def own_help_problem(text: Column) -> Column:
    """Why a ``poverty_text`` is not about the hospital's own help."""
    return first_reason(*_own_help_rules(text))


def _bounds(tiers: Column, number: Column) -> Column:
    """The income limits of a value: its number, or both bounds of each tier."""
    of_tiers = F.flatten(F.transform(tiers, lambda b: F.array(b["low"].cast("decimal(18,2)"), b["high"].cast("decimal(18,2)"))))
    return F.coalesce(of_tiers, F.when(number.isNotNull(), F.array(number.cast("decimal(18,2)"))), F.array().cast("array<decimal(18,2)>"))


def other_state_heading(said: Column, state: Column, tiers: Column, number: Column) -> Column:
    """Whether a number of the value is only stated under a heading for another state's hospitals."""
    begin, end = "\ue000", "\ue001"
    cut = F.split(F.regexp_replace(said, STATE_HEADING, f"{begin}$1{end}"), begin)
    whose = lambda s: F.when(F.contains(s, F.lit(end)), places.code_of(F.substring_index(s, end, 1)))
    ours = F.filter(cut, lambda s: F.coalesce(whose(s) == state, F.lit(True)))
    own = F.array_join(F.transform(ours, lambda s: F.substring_index(s, end, -1)), " ; ")
    wanted = F.concat(_bounds(tiers, number), F.coalesce(F.transform(tiers, lambda b: b["percent"].cast("decimal(18,2)")), F.array().cast("array<decimal(18,2)>")))
    return (F.size(ours) < F.size(cut)) & ~F.forall(wanted, lambda x: number_stated(own, p.plain_number(x)))


def income_limit_problem(said: Column, text: Column, quote: Column, state: Column, tiers: Column, number: Column) -> Column:
    """Why an income limit is another state's or another measure's."""
    facilities = F.regexp_extract_all(F.regexp_replace(quote, r"\s+", " "), F.lit(STATE_FACILITY), F.lit(1))
    return first_reason(
        ("quote states the band for another state's facilities", other_state_heading(said, state, tiers, number)),
        ("quote states the band for another state's facilities, named by its postal code", F.exists(facilities, lambda c: c != state)),
        ("quote measures income against another benchmark than the poverty level", F.exists(_bounds(tiers, number), lambda x: p.percent_of_other_basis(text, x))),
    )


def free_limit_stated(said: Column, text: Column, number: Column) -> Column:
    return p.states_income_limit(text, number) | ((number == 100) & p.states_poverty_line(said))


def free_limit_split(said: Column, text: Column) -> Column:
    """Whether inpatient and outpatient care have limits of their own."""
    return said.rlike(r"\bin-?patient\b") & said.rlike(r"\bout-?patient\b") & (F.size(F.array_distinct(p.tied_percents(text))) >= 2)


def insured_problem(said: Column, covered: Column) -> Column:
    """Why a quote doesn't say whether insured patients may apply, as the flag does."""
    only_agb = said.rlike(AGB_CLAUSE) & ~F.contains(F.regexp_replace(said, AGB_CLAUSE, ""), F.lit("insur"))
    only_cap = said.rlike(PRICE_CAP) & ~_without(said, PRICE_CAP).rlike(INSURED)
    only_terms = said.rlike(PAYMENT_TERMS) & ~_without(said, PAYMENT_TERMS).rlike(POLICY_WORDS)
    rest = _without(said, NOT_INSURED)
    absent = said.rlike(NOT_INSURED) & ~said.rlike(INSURED_HELPED) & ~rest.rlike(INSURED) & ~rest.rlike(OTHER_PAYER)
    left_out = said.rlike(INSURED_LEFT_OUT) & ~said.rlike(INSURED_HELPED) & ~said.rlike(OTHER_RATE)
    return first_reason(
        ("quote states the amounts-generally-billed cap, not who may apply", only_agb),
        ("quote states a price cap benchmarked on insured patients, not who may apply", only_cap),
        ("quote is only a heading", said.rlike(r"^[^.;:]{1,40}:$")),
        ("quote does not say whether insured patients are covered", covered & ~said.rlike(INSURED)),
        ("quote is about payment terms, not financial assistance", covered & only_terms),
        ("quote names insurance only to say the patient has none", covered & absent),
        ("quote does not say insured patients are left out of financial assistance", ~covered & ~left_out),
    )


def residency_problem(said: Column, quote: Column, states: Column) -> Column:
    """Why a list of states doesn't stand on its quote."""
    codes = F.transform(states, F.upper)
    others_too = F.regexp_extract_all(said, F.lit(rf"(?<![a-z])({places.NAMES})(?: residents?)? (?:and|or) non-? ?\1(?![a-z])"), F.lit(1))
    return first_reason(
        ("the residency list names no state", F.size(codes) == 0),
        ("quote says residents of other states qualify too", F.exists(others_too, lambda s: F.array_contains(codes, places.code_of(s)))),
        ("quote does not name every listed state as a whole state", F.size(F.array_except(codes, places.whole_states(said, quote))) > 0),
    )
