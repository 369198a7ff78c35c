"""Scalar normalisers: registry keys, names, numbers, dates, addresses and labels as Column expressions.

Several of them look alike and differ on purpose (two EIN, two ZIP and four name forms); sources are matched by the
form their rule was made for. Null in gives null out unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and abbreviations that names are compared without.
CROSSWALK_WORDS = "THE INC INCORPORATED HOSPITAL MEDICAL CENTER CORP CORPORATION OF AND & LLC HEALTH SYSTEM DBA".split()
LEGAL_WORDS = "inc llc corp corporation co the of and dba ltd".split()
# Hosts of directories and file stores, which are nobody's own website.
DIRECTORY_HOSTS = [
    "wikipedia.org", "healthgrades.com", "usnews.com", "yelp.com", "facebook.com", "linkedin.com", "instagram.com", "twitter.com", "x.com",
    "youtube.com", "medicare.gov", "cms.gov", "indeed.com", "glassdoor.com", "mapquest.com", "yellowpages.com", "zocdoc.com", "vitals.com",
    "webmd.com", "hospitalsafetygrade.org", "leapfroggroup.org", "ahd.com", "definitivehc.com", "npino.com", "npidb.org", "caredash.com", "bbb.org",
    "google.com", "bing.com", "dollarfor.org", "mass.gov", "wikidata.org", "bizapedia.com", "opencorporates.com", "propublica.org", "guidestar.org",
    "candid.org", "addictions.com", "findhelp.org", "networkofcare.org", "hospitalstats.org", "healthcare4ppl.com", "medicare-hospital-ratings.com",
    "211.org", "billfairly.com", "careroute.ai", "fairvisithealth.com", "carelistings.com", "seniorhealthdatabase.com", "payerprice.com",
    "causeiq.com", "merriam-webster.com", "lownhospitalsindex.org", "hospitalbills411.com", "healthbillcentral.com", "brightbillapp.com",
    "calhospital.org", "njspotlightnews.org", "communityplatform.us", "vituity.com", "turquoise.health", "castleconnolly.com", "medibillsaver.com",
    "medicarelist.com", "hospitalcompare.io", "safehospitalsusa.com", "doxo.com", "pdffiller.com", "prnewswire.com", "cbsnews.com",
    "nbclosangeles.com", "news10.com", "syracuse.com", "folsomtimes.com", "ohiodailydigital.com", "reddit.com", "wiktionary.org", "nursa.com",
    "ama-assn.org", "fatf-gafi.org", "njha.com", "1degree.org", "sunshinesupportnetwork.com", "recovered.org",
]
# Ends of hosts that publish records about others; the second is a state's own host.
DIRECTORY_ENDS = r"\.gov$|(?:^|\.)(?:al|ak|az|ar|ca|co|ct|de|dc|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy)\.us$"
# Corporate suffixes that a payee is compared without, dotted or not.
PAYEE_SUFFIXES = r"\b(?:p\.?a\.?|p\.?c\.?|l\.?l\.?c\.?|l\.?l\.?p\.?|inc\.?|ltd\.?|corp\.?|co\.?)\b"
# Patterns that mark a text as personal, by name, in the order they are reported.
PERSONAL_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "account_number": r"(?i)\b(?:acct|account|mrn|guarantor)\b[^\n]{0,20}?\d{5,}",
    "long_number": r"\b\d{9,}\b",
    "date_of_birth": r"(?i)\b(?:dob|date of birth|birth ?date)\b",
    "patient_name": r"(?i)\b(?:patient(?: name)?|name|guarantor)\s*:\s*[A-Z][a-z]+|\bdear\s+(?:mr|mrs|ms|dr)\b",
}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"[^0-9]", "")


def ein(c: str | Column) -> Column:
    """Nine digits with lost leading zeros put back; null if there are more, or fewer than eight."""
    d = digits(c)
    padded = F.when(F.length(d) <= 9, F.lpad(d, 9, "0"))  # lpad would cut longer ones
    return F.when(~padded.startswith("00"), padded)


def ein_of_return(c: str | Column) -> Column:
    """Nine digits of a tax-return index, where any number of leading zeros may be lost."""
    d = digits(c)
    return F.when(F.length(d).between(1, 9), F.lpad(d, 9, "0"))


def ccn(c: str | Column) -> Column:
    """A provider number as the registry spells it: a number under six digits gets its zeros back."""
    t = F.trim(_col(c))
    return F.when(t.rlike(r"^[0-9]{1,5}$"), F.lpad(t, 6, "0")).otherwise(t)


def zip5(c: str | Column) -> Column:
    """Five digits; nine-digit codes are cut, lost zeros come back; "" without digits."""
    d = digits(F.coalesce(_col(c), F.lit("")))
    long = F.when(F.length(d) < 9, F.lpad(d, 9, "0")).otherwise(d)
    return F.when(d == "", "").when(F.length(d) > 5, F.substring(long, 1, 5)).otherwise(F.lpad(d, 5, "0"))


def zip_of_counts(c: str | Column) -> Column:
    """A residence ZIP: only a number under five digits is padded, all else stays."""
    t = F.trim(_col(c))
    return F.when(t.rlike(r"^[0-9]{1,4}$"), F.lpad(t, 5, "0")).otherwise(t)


def phone(c: str | Column) -> Column:
    """Ten digits as 123-456-7890, a leading 1 of eleven dropped; null for other lengths."""
    d = digits(c)
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)))


def _without(words: Column, dropped: list[str]) -> Column:
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*dropped))
    return F.array_join(kept, " ")


def crosswalk_name(c: str | Column) -> Column:
    """Upper case, punctuation to spaces, common words out; "" for null."""
    t = F.regexp_replace(F.upper(F.coalesce(_col(c), F.lit(""))), r"[^A-Z0-9]+", " ")
    return _without(F.split(t, " "), CROSSWALK_WORDS)


def return_name(c: str | Column) -> Column:
    """Lower case, saints and ampersands spelled out, legal words out."""
    t = F.replace(F.replace(F.lower(_col(c)), F.lit("st."), F.lit("saint")), F.lit("&"), F.lit(" and "))
    return _without(F.split(F.regexp_replace(t, r"[^a-z0-9 ]", " "), " +"), LEGAL_WORDS)


def bill_name(c: str | Column) -> Column:
    """A printed name with its abbreviations spelled out and punctuation as spaces."""
    t = F.lower(_col(c))
    for short, long in (("st.", "saint"), ("ctr", "center"), ("med ", "medical ")):
        t = F.replace(t, F.lit(short), F.lit(long))
    return F.regexp_replace(t, r"[^a-z0-9 ]", " ")


def payee_name(c: str | Column) -> Column:
    """A payee's name without its corporate suffix and punctuation."""
    t = F.regexp_replace(F.lower(_col(c)), PAYEE_SUFFIXES, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9 ]+", " "), r"\s+", " "))


def count_cell(c: str | Column) -> Column:
    """A published count: whole part of a number, null for blanks, "*", text, NaN and infinities."""
    v = _col(c).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 9e18), v.cast("bigint"))


def whole_dollars(c: str | Column) -> Column:
    """A money cell in whole dollars, cut toward zero."""
    return F.replace(F.trim(_col(c)), F.lit(","), F.lit("")).try_cast("decimal(38,4)").cast("bigint")


def either_date(c: str | Column) -> Column:
    """A date written 12/31/2024 or 2024-12-31; null otherwise."""
    t = F.trim(_col(c))
    return F.coalesce(F.try_to_date(t, "MM/dd/yyyy"), F.try_to_date(t, "yyyy-MM-dd"))


def host(url: str | Column) -> Column:
    """Lower-cased host of an address, with or without a scheme, without www."""
    t = F.lower(F.trim(_col(url)))
    return F.nullif(F.regexp_replace(F.regexp_extract(t, r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]*)", 1), r"^www\.", ""), F.lit(""))


def registered_domain(url: str | Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host(url), ".", -2)


def is_directory(url: str | Column) -> Column:
    """Whether the host is one of DIRECTORY_HOSTS or below one, or ends like DIRECTORY_ENDS."""
    h = host(url)
    return F.coalesce(F.exists(F.array(*map(F.lit, DIRECTORY_HOSTS)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d))) | h.rlike(DIRECTORY_ENDS), F.lit(False))


def same_url(url: str | Column) -> Column:
    """One form for equal addresses: decoded, lower case, https, no www and no slash at the end."""
    t = F.lower(F.coalesce(F.try_url_decode(_col(url)), _col(url)))
    return F.regexp_replace(F.regexp_replace(t, r"^http://", "https://"), r"^(https://)www\.|/+$", "$1")


def personal_hits(text: str | Column) -> Column:
    """Names of the PERSONAL_PATTERNS that a text has."""
    return F.array_compact(F.array(*[F.when(_col(text).rlike(p), F.lit(n)) for n, p in PERSONAL_PATTERNS.items()]))


def case_hash(c: str | Column) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, 16)


def fpl_band(percent: str | Column) -> Column:
    """The band of a percentage of the poverty line."""
    p = _col(percent)
    return (
        F.when(p <= 100, "<=100").when(p <= 200, "101-200").when(p <= 300, "201-300").when(p <= 400, "301-400").when(p > 400, ">400")
    )


def request_key(name: str | Column, domain: str | Column, state: str | Column) -> Column:
    """What requests are the same by: the name, else the domain, with the state."""
    what = F.coalesce(F.nullif(F.trim(_col(name)), F.lit("")), _col(domain), F.lit(""))
    return F.struct(F.regexp_replace(F.lower(what), r"\s+", " ").alias("what"), F.upper(_col(state)).alias("state"))


def vintage(start: str | Column, end: str | Column, modified: str | Column) -> Column:
    """ "start to end, file of modified", without the parts that are missing."""
    blank = lambda c: F.nullif(_col(c).cast("string"), F.lit(""))
    period = F.nullif(F.concat_ws(" to ", blank(start), blank(end)), F.lit(""))
    return F.concat_ws(", ", period, F.concat(F.lit("file of "), blank(modified)))


def year_of_vintage(c: str | Column) -> Column:
    """The year at the end of a vintage's period, else the first year in it."""
    late = F.nullif(F.regexp_extract(_col(c), r" to (\d{4})", 1), F.lit(""))
    return F.coalesce(late, F.nullif(F.regexp_extract(_col(c), r"(\d{4})", 1), F.lit(""))).cast("int")


#: The scalar functions by name; extend it to plug in more.
REGISTRY: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (
        ein, ein_of_return, ccn, zip5, zip_of_counts, phone, crosswalk_name, return_name, bill_name, payee_name, count_cell,
        whole_dollars, either_date, host, registered_domain, is_directory, same_url, personal_hits, case_hash, fpl_band,
        request_key, vintage, year_of_vintage,
    )
}
