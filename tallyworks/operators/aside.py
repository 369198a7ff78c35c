"""Documents of other places: which of a hospital's documents no fact may be quoted from, and whose they are.

Tables, by name: ``hospitals`` (ccn, name, city, state, website_domain), ``documents`` (source_id, url, title, text),
``held`` (ccn, source_id, both distinct together) and ``loans`` (ccn, source_id, lender). Null texts are empty. Texts are
compared lower case, without apostrophes and with single spaces (``plain``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import normalise as n
from tallyworks.functions import places
from tallyworks.functions.text import normal_of
from tallyworks.operators import corpus, linkage
from tallyworks.store import materialise

# Words of hospitals' names that tell none from another.
GENERIC_WORDS = "hospital hospitals medical center centre health healthcare system regional community memorial general campus the and of inc saint".split()
# Hosts that only keep others' files.
ASSET_HOSTS = ["canto.com", "widen.net", "cloudfront.net", "amazonaws.com", "box.com", "sharepoint.com", "blob.core.windows.net", "sitecorecloud.io", "website-files.com"]
# Wordings that tell whose a document is and what it is about.
DENTAL = (
    r"(?<!\band[- ])(?<!\bor[- ])(?<![&/,][- ])(?<![&/,])\bdental[- ]"
    r"(?:financial[- ](?:assistance|aid)|charity|(?:assistance|discount)[- ]program|sliding[- ](?:fee|scale))"
)
SCHEDULE_SCOPE = r"(?i)included\s+in\s+(?:the\s+)?attached\s+schedule\s+[a-z]\b"
# every match of COVERED_LIST and of INCOME_RULES has one of these
LIST_WORDS, RULE_WORDS = ["include", "listed", "applies", "covered"], ["poverty", "fpl", "fpg"]
COVERED_LIST = (
    r"(?is)hospitals\s+include\s*:|facilities\s+include\s*:|\(listed\s+below\)|applies\s+to\s+the\s+following\s+(?:hospitals|facilities|entities)"
    r"|the\s+following\b.{0,120}?\b(?:hospitals|facilities)\b.{0,60}?\bare\s+covered\b"
)
APPLIES_TO_ALL = r"(?i)\bappl(?:y|ies)\s+to\s*:?\s*all\b"
INCOME_RULES = r"(?i)poverty|\bfpl\b|\bfpg\b"
POLICY_LABEL = r"(?i)financial assistance|charity|financial aid|\bpolicy\b|\bfap\b"
LINK = r"(?i)https?://[^\s)\]\"'<>|]+"
LABELLED_LINK = r"\[([^\]]{3,200})\]\(\s*([^)\s]+)"
TITLE_END = r"\s+[|–—-]\s+"
OPENING_CHARS = 1000
FUNDRAISING = r"\bgolf\b|\bgala\b|fundrais|\bdonat|/giving\b|ways-to-give|support-the-foundation|events-campaigns|charity care fund|charity-care-fund"
NOT_A_DOCUMENT = r"\.(?:svg|png|jpg|jpeg|gif|webp|ico|mp3|mp4|wav|m4a|mov|avi|wmv|ogg|webm)$"
# A system that files its regions on two hosts of its own, and what marks a region there.
REGION_HOSTS = r"(?:^|\.)(?:kaiserpermanente\.org|kp\.org)$"
REGIONS = {
    "nw": ["OR", "WA"], "northwest": ["OR", "WA"], "mas": ["MD", "VA", "DC"], "mid-atlantic": ["MD", "VA", "DC"], "ga": ["GA"], "co": ["CO"], "hi": ["HI"],
    "wa": ["WA"], "ncal": ["CA"], "scal": ["CA"], "northern-california": ["CA"], "southern-california": ["CA"],
}
COMPOUND_TAILS = ["pay", "pays", "payment", "payments", "insurance"]
# Fields that describe one hospital's own desk.
BORROWED_SPECIFIC = ["apply.submit_methods", "contacts.phone", "contacts.hours", "contacts.languages", "coverage.facilities", "coverage.provider_list_url"]
SURE, CONFIRMED = 0.8, 1.0
#: Most words of towns that are sent to all tasks.
TOWNS = 20_000
# Reasons, in the order in which they are tried.
REASONS = {
    "dental": "quote is from a dental assistance program's document, not the hospital's policy",
    "region": "quote is from another region's policy, not the hospital's state's",
    "other_state": "quote is from another state's version of the system policy",
    "lent": "quote is from a document lent by another state's hospital",
    "A2": "quote is from another organisation's document; its policy leaves the hospital out and the hospital's site does not link it",
    "S": "quote is from a policy whose own list of covered hospitals leaves this hospital out",
    "B": "quote is from another hospital's policy; the hospital's site links its own",
    "translation": "quote is from a translation while an English document states the income rules",
}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def plain(c: Column) -> Column:
    bare = F.replace(F.replace(F.lower(c), F.lit("'"), F.lit("")), F.lit("’"), F.lit(""))
    # single spaces, which are most, stay where they are
    return F.trim(F.regexp_replace(bare, r"[\t\n\x0B\f\r]\s*| \s+", " "))


def _decoded(url: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def path_of(url: Column) -> Column:
    """The decoded path of an address, "" without one."""
    return F.regexp_extract(_decoded(F.coalesce(url, F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def is_asset_host(url: Column) -> Column:
    h = n.host(url)
    return F.coalesce(F.exists(F.array(*map(F.lit, ASSET_HOSTS)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))), F.lit(False))


#: The kind of documents that are looked at.
WEB = "hospital_web"


def name_tokens(name: Column) -> Column:
    """The telling words of a hospital's name."""
    return F.array_distinct(F.filter(F.regexp_extract_all(plain(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC_WORDS)))


def name_words(name: Column) -> Column:
    """The words of a hospital's name of four characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(plain(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 4))


def has_words(own: Column, words: Column, said: Column) -> Column:
    """``names_hospital`` by a name's ``name_tokens`` and ``name_words``."""
    tokens = F.when(F.size(own) >= 2, own).otherwise(words)
    hits = F.size(F.filter(tokens, lambda w: F.contains(said, w)))
    return F.coalesce((F.size(tokens) > 0) & ((F.size(own) >= 2) | F.forall(own, lambda w: F.contains(said, w))) & (hits >= F.least(F.lit(2), F.size(tokens))), F.lit(False))


def names_hospital(name: Column, said: Column) -> Column:
    """Whether a plain text has two telling words of a name; of a name with fewer, those and one more of any kind."""
    return has_words(name_tokens(name), name_words(name), said)


def names_city(city: Column, said: Column) -> Column:
    """Whether a plain text has a town's name as whole words."""
    town = F.regexp_replace(plain(city), r"([^a-z0-9 ])", r"\\$1")
    whole = F.when(F.contains(said, plain(city)), F.rlike(said, F.concat(F.lit(r"\b"), town, F.lit(r"\b"))))
    return F.coalesce((town != "") & whole, F.lit(False))


def is_dental(url: Column, title: Column, text: Column) -> Column:
    """Whether an address, a title or the opening of a text, links and images aside, names a dental programme."""
    named = F.replace(F.lower(F.concat(F.replace(_decoded(url), F.lit("/"), F.lit(" ")), F.lit(" "), title)), F.lit("_"), F.lit("-"))
    prose = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]*)\]\(\s*<?([^\s<>()\"]+)>?(?:\s+\"[^\"]*\")?\s*\)", " ")
    opening = F.lower(F.substring(F.trim(F.regexp_replace(prose, r"\s+", " ")), 1, OPENING_CHARS))
    return F.regexp_replace(named, r"\s+", " ").rlike(DENTAL) | F.when(F.contains(F.lower(text), F.lit("dental")), opening.rlike(DENTAL)).otherwise(False)


def document_class(url: Column, title: Column) -> Column:
    """application, summary, fap or billing by a document's address and title; null for others, appeals and media."""
    text = F.replace(F.lower(F.concat(url, F.lit(" "), title)), F.lit("_"), F.lit("-"))
    bare = F.regexp_replace(text, "application(?:%2f|/)pdf", " ")
    money = bare.rlike("financial|charity|fap|assistance")
    out = (
        F.when(money & bare.rlike(r"\bforms?\b|applic"), "application")
        .when(money & bare.rlike("plain|summary"), "summary")
        .when(bare.rlike("charity[- ]care[- ]polic|financial[- ]assistance[- ]polic"), "fap")
        .when(bare.rlike("billing|collection|pay-your-bill"), "billing")
        .when(bare.rlike("financial-assistance|financial assistance|charity|/fap|financialassistance"), "fap")
    )
    left_out = F.lower(path_of(url)).rlike(NOT_A_DOCUMENT) | text.rlike(FUNDRAISING) | is_dental(url, title, F.lit(""))
    return F.when(~left_out, out)


def region_states(url: Column) -> Column:
    """States of the regions that an address on REGION_HOSTS marks: by its host's first label, by a folder or a page as
    a whole, or by a word or two of a file's name; none elsewhere."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    segments = F.filter(F.split(F.replace(F.lower(path_of(url)), F.lit("_"), F.lit("-")), "/"), lambda s: s != "")
    file = F.regexp_extract(F.coalesce(F.element_at(segments, -1), F.lit("")), r"^(.*)\.[^.]*$", 1)
    words = F.split(file, "-")
    follows = F.concat(F.slice(words, 2, F.size(words)), F.array(F.lit("")))
    pairs = F.arrays_zip(words.alias("a"), follows.alias("b"))
    alone = F.transform(F.filter(pairs, lambda p: ~p["b"].isin(COMPOUND_TAILS)), lambda p: p["a"])
    marks = F.concat(segments, alone, F.transform(pairs, lambda p: F.concat_ws("-", p["a"], p["b"])))
    found = F.flatten(F.array(*[F.when(F.array_contains(marks, m), F.array(*map(F.lit, s))).otherwise(F.array().cast("array<string>")) for m, s in REGIONS.items()]))
    by_host = F.when(F.substring_index(host, ".", 1) == "wa", F.array(F.lit("WA"))).otherwise(F.array().cast("array<string>"))
    return F.when(host.rlike(REGION_HOSTS), F.array_distinct(F.concat(found, by_host))).otherwise(F.array().cast("array<string>"))


def _says(text: Column, pattern: str, words: list[str]) -> Column:
    """Whether a text matches a pattern, which is asked of texts that have one of the words alone."""
    low = F.lower(text)
    some = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        some = some | F.contains(low, F.lit(w))
    return F.when(some, text.rlike(pattern)).otherwise(False)


def _title_and_path(title: Column, url: Column) -> Column:
    return F.regexp_replace(F.concat(title, F.lit(" "), path_of(url)), r"[-_./%+]", " ")


def domain_unconfirmed(domain: Column, confidence: Column) -> Column:
    """Whether a website that was matched, with less than SURE or no confidence recorded, waits for a look."""
    return (F.coalesce(domain, F.lit("")) != "") & F.coalesce((confidence != CONFIRMED) & (confidence < SURE), F.lit(True))


def hospitals_named(documents: DataFrame, hospitals: DataFrame) -> DataFrame:
    """(source_id, named, state): the hospitals of the registry that a document names by name and by town.

    Documents and hospitals meet on the longest word of a town, so the work grows with the words of the documents and
    not with documents times hospitals; what meets is checked on the text. Up to TOWNS different words of towns go to
    all tasks, which drop the other words where they read them, whatever the number of hospitals.
    """
    town = F.regexp_extract_all(plain(F.col("city")), F.lit("[a-z0-9]+"), F.lit(0))
    longest = F.array_max(F.transform(town, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = hospitals.where(F.size(name_tokens(F.col("name"))) > 0).select(F.col("ccn").alias("named"), "name", "city", "state", longest.alias("word")).where("word is not null")
    said = plain(_text("text"))
    words = documents.repartition("source_id").select("source_id", F.explode(F.array_distinct(F.regexp_extract_all(said, F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))
    towns = rows.select("word").distinct()
    words = words.join(F.broadcast(towns) if towns.limit(TOWNS + 1).count() <= TOWNS else towns, "word", "left_semi")
    # written, so that the texts of the others stay where they are
    met = materialise(words.join(rows, "word").select("source_id", "named", "name", "city", "state"))
    texts = documents.join(met.select("source_id"), "source_id", "left_semi").select("source_id", said.alias("said"))
    return met.join(texts, "source_id").where(names_city(F.col("city"), F.col("said")) & names_hospital(F.col("name"), F.col("said"))).select("source_id", "named", "state")


def policy_links(text: Column, url: Column) -> Column:
    """(to, label) of the links of a document at an address whose labels name a policy."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(LABELLED_LINK), F.lit(1)).alias("label"), F.regexp_extract_all(text, F.lit(LABELLED_LINK), F.lit(2)).alias("href"))
    root, folder = F.regexp_extract(url, r"^[^:]*://[^/?#]*", 0), F.regexp_extract(url, r"^[^:]*://[^/?#]*(?:/[^?#]*/|/)?", 0)
    slash = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))

    def whole(href: Column) -> Column:
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(slash, href))
        )

    links = F.transform(found, lambda x: F.struct(n.same_url(whole(x["href"])).alias("to"), plain(x["label"]).alias("label")))
    return F.filter(links, lambda x: x["label"].rlike(POLICY_LABEL))


def documents_set_aside(hospitals: DataFrame, documents: DataFrame, held: DataFrame, loans: DataFrame) -> DataFrame:
    """(ccn, source_id, clause, reason) of the documents that a hospital's facts may not be quoted from.

    The clauses in their order, each over what the earlier ones left:
    dental and region, a dental programme's or another region's document; other_state, one whose address or subject
    names states but not the hospital's; lent, one held through loans that all come from other states, that is another
    state's and says nothing that reaches the hospital's; A2, one of a foreign site that no page of the hospital's site
    links, with its own list of other hospitals, and what else such a site has; S, one whose schedule names others only;
    B, another hospital's policy where the hospital's site links its own; translation, one in another language while an
    English one states the income rules. ``documents``: source_id, url, title, text; with a column ``kind`` only those
    of kind hospital_web are looked at, so a state's own or an uploaded document is never set aside.

    What is read of a text is read once a document, links included; texts are dealt by document before they are read and
    meet the hospitals that hold them there.
    """
    c = F.col
    if "kind" in documents.columns:
        documents = documents.where(c("kind") == WEB)
    h = hospitals.select("ccn", "name", "city", "state", "website_domain")
    docs = documents.select("source_id", _text("url").alias("url"), _text("title").alias("title"), _text("text").alias("text"))
    title_and_path, subject = _title_and_path(c("title"), c("url")), F.get(F.split("title", TITLE_END), F.lit(0))
    # a file of few parts would be read in few tasks
    voted = corpus.language_votes(docs.repartition("source_id"), "source_id", "text", "url", "title", "text")
    traits = voted.select(
        c("doc_id").alias("source_id"), "url", corpus.reads_as_english().alias("english"), plain(c("text")).alias("said"), n.registered_domain("url").alias("site"), is_asset_host(c("url")).alias("asset"),
        is_dental(c("url"), c("title"), c("text")).alias("dental"), region_states(c("url")).alias("regions"), places.states_as_states(_title_and_path(subject, c("url"))).alias("claimed"),
        F.array_union(places.states_named(title_and_path), F.regexp_extract_all("title", F.lit(rf"\(({places.CODES})\)"), F.lit(1))).alias("titled"),
        places.states_as_states(F.concat_ws(" ", "title", "text")).alias("told"), F.regexp_extract_all(subject, F.lit(r"\b[A-Z]{2}\b"), F.lit(0)).alias("coded"),
        c("text").rlike(SCHEDULE_SCOPE).alias("schedule"), _says(c("text"), COVERED_LIST, LIST_WORDS).alias("listing"), c("text").rlike(APPLIES_TO_ALL).alias("to_all"), _says(c("text"), INCOME_RULES, RULE_WORDS).alias("income"),
        F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(LINK), F.lit(0)), n.registered_domain)).alias("linked_sites"), policy_links(c("text"), c("url")).alias("policy_links"),
    )
    named = hospitals_named(docs, h).groupBy("source_id", "state").agg(F.count_distinct("named").alias("n"), F.min("named").alias("one"))
    named = materialise(named)
    own = F.concat_ws(" ", "name", "city")
    homes = h.select(
        "*", name_tokens(c("name")).alias("own"), name_words(c("name")).alias("words"), places.states_named(own).alias("own_named"), places.states_as_states(own).alias("own_states"), n.registered_domain("website_domain").alias("domain"),
    )
    pairs = held.select("ccn", "source_id").distinct().join(homes, "ccn").join(named, ["source_id", "state"], "left").join(traits, "source_id")
    filed, claimed = F.array_union(F.array_except("titled", "own_named"), "regions"), F.array_except("claimed", "own_states")
    names_others = F.coalesce((c("n") > 1) | (c("one") != c("ccn")), F.lit(False))
    facts = materialise(
        pairs.select(
            "ccn", "source_id", "url", "linked_sites", "policy_links", "site", "asset", "english", "income", "schedule", "name", "city", "state", F.coalesce("domain", F.lit("")).alias("home"),
            c("dental"), (F.coalesce(n.host("url").rlike(REGION_HOSTS), F.lit(False)) & (F.size(filed) > 0) & ~F.array_contains(filed, c("state"))).alias("region"),
            ((F.size(claimed) > 0) & ~F.array_contains(claimed, c("state"))).alias("other_state"),
            (names_city(c("city"), c("said")) | has_words(c("own"), c("words"), c("said"))).alias("ours"),
            (F.array_contains("told", c("state")) | F.array_contains("coded", c("state"))).alias("tells_state"),
            names_others.alias("names_others"), (names_others & ~c("to_all")).alias("lists_others"),
            (c("listing") | c("schedule")).alias("scoped"), F.contains(F.regexp_replace("said", "[^a-z0-9]+", ""), F.substring_index("domain", ".", 1)).alias("names_site"),
        )
    )
    key = ["ccn", "source_id"]
    first = facts.select(*key, F.when(c("dental"), "dental").when(c("region"), "region").when(c("other_state"), "other_state").alias("clause")).where("clause is not null")
    rest = facts.join(first.select(*key), key, "left_anti")
    lent = _lent(rest, named, h, loans).withColumn("clause", F.lit("lent"))
    rest = rest.join(lent.select(*key), key, "left_anti")
    owners = materialise(_owners(rest, h))
    rest = rest.join(owners.select(*key), key, "left_anti")
    rules = rest.groupBy("ccn").agg(F.bool_or(c("english") & c("income")).alias("rules")).where("rules")
    translated = rest.where(~c("english")).join(rules.select("ccn"), "ccn", "left_semi").select(*key, F.lit("translation").alias("clause"))
    out = first.unionByName(lent).unionByName(owners).unionByName(translated)
    return out.withColumn("reason", F.coalesce(*[F.when(c("clause") == k, F.lit(v)) for k, v in REASONS.items()]))


def _lent(rest: DataFrame, named: DataFrame, hospitals: DataFrame, loans: DataFrame) -> DataFrame:
    """(ccn, source_id) of documents that are held through loans and are another state's alone. ``named`` has the number n
    of hospitals of each state that a document names."""
    c = F.col
    edge = lambda who: F.concat_ws("\x1f", who, "source_id")
    found = linkage.origins(loans.select(edge("ccn").alias("borrower"), edge("lender").alias("lender")))
    at = lambda x, k: F.split(x, "\x1f")[k]
    origins = found.select(at(c("borrower"), 0).alias("ccn"), at(c("borrower"), 1).alias("source_id"), at(c("origin"), 0).alias("lender"))
    states = origins.join(hospitals.select(c("ccn").alias("lender"), c("state").alias("from_state")), "lender").groupBy("ccn", "source_id").agg(F.collect_set("from_state").alias("from_states"))
    counts = named.groupBy("source_id").agg(F.collect_list(F.struct("state", "n")).alias("counts"))
    rows = rest.where(~(c("ours") | c("tells_state") | c("names_others"))).join(states, ["ccn", "source_id"]).where(~F.array_contains("from_states", c("state"))).join(counts, "source_id")
    elsewhere = F.filter("counts", lambda x: x["state"] != c("state"))
    pairs = F.size(F.filter(elsewhere, lambda x: x["n"] >= 2))
    return rows.where((pairs < 3) & ((pairs > 0) | F.exists(elsewhere, lambda x: F.array_contains("from_states", x["state"])))).select("ccn", "source_id")


def _owners(rest: DataFrame, hospitals: DataFrame) -> DataFrame:
    """(ccn, source_id, clause) of another owner's documents: A2 before S before B."""
    c, key = F.col, ["ccn", "source_id"]
    web = rest.where("url <> ''")
    linked = web.where("site = home and home <> ''").select("ccn", F.explode("linked_sites").alias("site")).distinct().withColumn("linked", F.lit(True))
    seen = web.where("home <> ''").join(linked, ["ccn", "site"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    unclaimed = (c("site") != c("home")) & ~c("asset") & ~c("linked") & ~c("ours") & ~c("names_site")
    seen = seen.select(*key, "site", unclaimed.alias("unclaimed"), (unclaimed & c("scoped") & c("lists_others")).alias("foreign"), (c("schedule") & ((c("site") == c("home")) | ~c("linked")) & ~c("ours") & c("lists_others")).alias("scheduled"))
    sites = seen.where("foreign or scheduled").select("ccn", "site").distinct().withColumn("hit", F.lit(True))
    a2 = seen.join(sites, ["ccn", "site"], "left").select(*key, F.when(c("foreign") | (c("unclaimed") & F.coalesce("hit", F.lit(False))), "A2").when(c("scheduled"), "S").alias("clause")).where("clause is not null")
    links = web.select("ccn", F.explode("policy_links").alias("l")).select("ccn", "l.*")
    labels = materialise(links.join(hospitals.select("ccn", "name", "city", "state"), "ccn").select("ccn", "to", "label", "state", (names_hospital(c("name"), c("label")) | names_city(c("city"), c("label"))).alias("mine")).distinct())
    targets = labels.groupBy("ccn", "to").agg(F.bool_or("mine").alias("mine"))
    has_own = targets.where("mine").select("ccn").distinct()
    # a label meets the hospitals of its state that share a telling word with it, or any word where a name has fewer than two telling ones
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 4))
    telling = F.when(F.size(name_tokens(c("name"))) >= 2, name_tokens(c("name"))).otherwise(words(plain(c("name"))))
    registry = hospitals.select(c("ccn").alias("other"), "name", "state", F.explode(telling).alias("word"))
    met = labels.where(~c("mine")).select("ccn", "to", "label", "state", F.explode(words(c("label"))).alias("word")).join(registry, ["state", "word"]).where("other <> ccn")
    strangers = met.where(names_hospital(c("name"), c("label"))).select("ccn", "to").distinct()
    b = web.where(~c("ours")).join(has_own, "ccn", "left_semi").withColumn("to", n.same_url("url")).join(targets.where("mine").select("ccn", "to"), ["ccn", "to"], "left_anti")
    b = b.join(strangers, ["ccn", "to"], "left_semi").select(*key).join(a2.select(*key), key, "left_anti")
    return a2.unionByName(b.withColumn("clause", F.lit("B")))


def place_unconfirmed(hospitals: DataFrame, documents: DataFrame, held: DataFrame) -> DataFrame:
    """(ccn, problem): "state" if a hospital's documents never name its state, "name" if they name neither its town nor
    a telling word of its name. A state counts by name, or by code after a comma or before a ZIP. Hospitals without any
    text, or of no known state, have no problem; names that run over the end of a document count as in none."""
    c = F.col
    pairs = held.select("ccn", "source_id").distinct().join(documents.select("source_id", _text("text").alias("text")), "source_id").where("trim(text) <> ''")
    rows = pairs.join(hospitals.select("ccn", "name", "city", F.upper("state").alias("state")).where(c("state").isin(list(places.STATES))), "ccn")
    code = F.rlike("text", F.concat(F.lit(r",\s*"), "state", F.lit(r"\b|\b"), "state", F.lit(r"\s+\d{5}\b")))
    words = F.regexp_extract_all(plain(c("text")), F.lit("[a-z0-9]+"), F.lit(0))
    by_name = F.contains(plain(c("text")), plain(c("city"))) | F.arrays_overlap(name_tokens(c("name")), words)
    told = rows.groupBy("ccn").agg(F.bool_or(F.array_contains(places.states_named(c("text")), c("state")) | code).alias("state"), F.bool_or(F.coalesce(by_name, F.lit(False))).alias("name"))
    return told.select("ccn", F.when(~c("state"), "state").when(~c("name"), "name").alias("problem")).where("problem is not null")


def without_borrowed(facts: DataFrame, borrowed: DataFrame) -> DataFrame:
    """``facts`` (ccn, path, source_id, ...) without those of BORROWED_SPECIFIC that rest on (ccn, source_id) borrowed."""
    gone = facts.where(F.col("path").isin(BORROWED_SPECIFIC)).join(borrowed.select("ccn", "source_id").distinct(), ["ccn", "source_id"], "left_semi").select("ccn", "path")
    return facts.join(gone, ["ccn", "path"], "left_anti")


def document_conflicts(rules: DataFrame, documents: DataFrame, held: DataFrame) -> DataFrame:
    """(ccn, source_id, limits): documents that state other free-care limits than the sheet, or more than its ceiling.

    ``rules`` has ccn, free, ceiling and source_id, the document that the free limit or, without one and without a
    table, the ceiling rests on. With a free limit, another document conflicts if it states limits and none is that;
    with a ceiling alone, any document does that states a free limit, or help above the ceiling.
    """
    from tallyworks.functions import poverty

    c = F.col
    said = documents.select("source_id", normal_of(_text("text")).alias("said"))
    stated = said.select("source_id", poverty.free_care_limits(c("said")).alias("limits"), poverty.help_limits(c("said")).alias("help"))
    rows = held.select("ccn", "source_id").distinct().join(stated, "source_id").join(rules.select("ccn", "free", "ceiling", c("source_id").alias("rests_on")), "ccn")
    above = F.filter("help", lambda x: x > c("ceiling"))
    limits = F.when(c("free").isNotNull(), c("limits")).otherwise(F.array_sort(F.array_union("limits", above)))
    against = F.when(c("free").isNotNull(), (c("source_id") != c("rests_on")) & ~F.exists("limits", lambda x: x == c("free"))).otherwise(c("ceiling").isNotNull())
    return rows.where(against & (F.size(limits) > 0)).select("ccn", "source_id", limits.alias("limits"))


def held_without(sheets: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts left, ccns to hold): facts (ccn, path, source_id, ...) without those quoted from (ccn, source_id) that are
    gone; only hospitals that lose a fact are held, the others' facts stay as they are."""
    lost = sheets.join(gone.select("ccn", "source_id").distinct(), ["ccn", "source_id"], "left_semi").select("ccn", "path")
    return sheets.join(lost, ["ccn", "path"], "left_anti"), lost.select("ccn").distinct()


def website_candidates(hospitals: DataFrame, open_items: DataFrame, sheets: DataFrame, skip: DataFrame) -> DataFrame:
    """(ccn, state) of hospitals worth a search: a website matched with less than SURE, an open item about it, and a
    newest sheet that is held and has an income rule; by state and ccn. ``sheets``: ccn, version, status, has_rule."""
    unsure = hospitals.where("website_domain <> ''").where(F.col("domain_confidence") < SURE)
    newest = sheets.groupBy("ccn").agg(F.max_by(F.struct("status", "has_rule"), "version").alias("s")).where("s.status = 'held' and s.has_rule")
    asked = unsure.join(open_items.where("kind = 'domain_unconfirmed'"), "ccn", "left_semi").join(skip, "ccn", "left_anti")
    return asked.join(newest, "ccn", "left_semi").select("ccn", "state").orderBy("state", "ccn")
