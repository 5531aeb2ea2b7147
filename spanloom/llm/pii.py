"""Personal data by weak supervision.

Patterns with checks give the base spans: email, ip, card and phone.  Further candidates are numbers of card
length that fail the check digit (account), phone numbers without a plus sign (local_phone) and a first name of a
gazetteer before a capitalised word (name).  Five labelers, of shape, gazetteer, context, boundary and variety, vote
yes, no or nothing on every candidate; expectation maximisation over the counts of vote patterns estimates how far each
labeler is to be trusted, and a logistic classifier of the votes, the kind and the span's size, trained on the resulting
soft labels, decides which further candidates join the base spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.spans import matches
from spanloom.shared import written

BASE, FURTHER = ("email", "ip", "card", "phone"), ("account", "local_phone", "name")
LABELERS = ("shape", "gazetteer", "context", "boundary", "variety")
CONTEXT = 40
ACCEPT_FROM = 0.5
EM_ROUNDS = 60
SIZES = 4  #: size classes of spans, eight characters each, the last one open

# The base patterns, with possessive repeats and starts that can't begin inside a run: the same matches in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9 -]{15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+.-])(?<![0-9][ ()])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-]|[ .][0-9])"
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# Calling codes, card issuers' first digits, reserved networks, words beside personal data and beside other numbers.
CALLING_CODES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)"
RESERVED = r"^(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\."
TOP_LEVELS = r"\.(com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ch|at|nl|be|pl|pt)$"
CUES = r"mail|contact|write|call|tel|phone|fax|mobile|card|visa|iban|account|konto|cuenta|compte|address|host|login|user"
OTHER_CUES = r"version|release|isbn|issn|order|build|serial|section|chapter|figure|item|part no|commit"


# Common first names and surnames of four letters and more, words beside persons, words that make a name a place or a thing.
FIRST_NAMES = "Alexander|Alice|Amanda|Andrea|Andrew|Angela|Anthony|Antonio|Barbara|Benjamin|Brian|Carlos|Carmen|Catherine|Charles|Charlotte|Christian|Christine|Christopher|Claudia|Daniel|David|Deborah|Dennis|Donald|Dorothy|Edward|Elena|Elizabeth|Emily|Emma|Eric|Fernando|Francisco|Frank|Gabriel|George|Gerald|Hannah|Harold|Heather|Helen|Henry|Isabel|Jacob|James|Jason|Javier|Jean|Jeffrey|Jennifer|Jessica|Johanna|John|Jonathan|Jorge|Jose|Joseph|Joshua|Juan|Julia|Karen|Katharina|Kenneth|Kevin|Kimberly|Larry|Laura|Linda|Lisa|Louis|Lucas|Manuel|Margaret|Maria|Marie|Mark|Martin|Mary|Matthew|Melissa|Michael|Michelle|Miguel|Monica|Nancy|Nathalie|Nicholas|Nicole|Olivia|Pablo|Patricia|Patrick|Paul|Peter|Philip|Pierre|Rachel|Raymond|Rebecca|Richard|Robert|Ronald|Rosa|Samuel|Sandra|Sarah|Scott|Sharon|Sophie|Stefan|Stephanie|Stephen|Steven|Susan|Teresa|Thomas|Timothy|Ursula|Victoria|Virginia|Walter|William|Wolfgang"
SURNAMES = "Adams|Allen|Anderson|Baker|Bauer|Becker|Bernard|Brown|Campbell|Carter|Clark|Collins|Davis|Diaz|Dubois|Edwards|Evans|Fernandez|Fischer|Garcia|Gomez|Gonzalez|Green|Hall|Harris|Hernandez|Hill|Hoffmann|Jackson|Johnson|Jones|King|Klein|Koch|Laurent|Leroy|Lewis|Lopez|Martinez|Meyer|Miller|Mitchell|Moore|Morales|Moreau|Morgan|Morris|Müller|Nelson|Parker|Perez|Petit|Phillips|Ramirez|Reyes|Richter|Rivera|Roberts|Robinson|Rodriguez|Rogers|Roux|Sanchez|Schäfer|Schmidt|Schneider|Schulz|Smith|Stewart|Taylor|Thompson|Torres|Turner|Wagner|Walker|Weber|White|Williams|Wilson|Wright|Young"
NAME_CUES = r"\b(mr|mrs|ms|miss|dr|prof|herr|frau|monsieur|madame|name|named|signed|sincerely|regards|contact|author|patient|customer|employee|born|dear|from|with)\b"
NOT_PERSONS = r"^(Street|Road|Avenue|Square|Bridge|University|College|School|Hospital|Park|Station|Island|Lake|River|County|Prize|Award|Day|Hall|House|Airport|Church|Falls|Beach|Company|Group|Version|Section|Chapter)$"
_NAME = rf"(?<![A-Za-zÀ-ÿ])(?=[A-Z])(?:{FIRST_NAMES}) [A-ZÀ-Þ][a-zß-ÿ]{{2,}}+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check digit: from the right, every second digit doubled, less 9 beyond 9."""
    backward = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    one = lambda i: F.coalesce(F.substring(backward, i, F.lit(1)).try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + one(i) - F.when(one(i) > 9, 9).otherwise(0)) % 10 == 0


def _found(text: Column, kind: str, pattern: str, gate: Column, check) -> Column:
    own = F.transform(F.filter(matches(text, pattern, CONTEXT), lambda m: check(m["value"])), lambda m: m.withField("kind", F.lit(kind)))
    return F.when(gate, own).otherwise(F.array().cast(_SPANS))


_SPANS = "array<struct<value:string,start:int,stop:int,before:string,after:string,kind:string>>"


def _numbers(text: Column) -> Column:
    """Numbers of 16 to 19 digits, with at most one blank or hyphen between digits; kind card if the check digit is right, else account.

    A run of digits, blanks and hyphens holds numbers apart where two separators meet; those are marked first, so
    that no pattern has to repeat a group.
    """
    marked = lambda run: F.regexp_replace(run, "[ -](?=[ -])|(?<=[ -])[ -]", "x")
    within = lambda m: F.transform(matches(marked(m["value"]), "[^x]+"), lambda p: F.struct(F.regexp_replace(p["value"], "[ -]$", "").alias("value"), (m["start"] + p["start"]).alias("start"), F.when(p["start"] == 0, m["before"]).otherwise("").alias("before"), F.when(p["stop"] == F.length(m["value"]), m["after"]).otherwise("").alias("after")))
    parts = F.filter(F.flatten(F.transform(matches(text, DIGIT_RUN, CONTEXT), within)), lambda p: F.length(_digits(p["value"])).between(16, 19))
    own = lambda p: F.struct(p["value"].alias("value"), p["start"].alias("start"), (p["start"] + F.length(p["value"])).alias("stop"), p["before"].alias("before"), p["after"].alias("after"), F.when(luhn(_digits(p["value"])), "card").otherwise("account").alias("kind"))
    return F.when(text.rlike(DIGIT_RUN), F.transform(parts, own)).otherwise(F.array().cast(_SPANS))


def candidates(documents: DataFrame) -> DataFrame:
    """The documents' ids with ``found``: all candidates of the whole text, base kinds in the listed order, then the further kinds, by start.

    documents: ``doc_id`` and ``text``; further columns are ignored; null and empty texts have none.
    """
    text = F.coalesce("text", F.lit(""))
    yes = lambda v: F.lit(True)
    count = lambda v: F.length(_digits(v))
    numbers = _numbers(text)
    names = _found(text, "name", _NAME, text.rlike(_NAME), yes)
    phones = _found(text, "phone", PHONE, F.contains(text, F.lit("+")), lambda v: count(v).between(8, 15))
    locals_ = _found(text, "local_phone", LOCAL_PHONE, text.rlike(LOCAL_PHONE), yes)
    rows = documents.select(
        "doc_id",
        _found(text, "email", EMAIL, F.contains(text, F.lit("@")), yes).alias("email"),
        _found(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")).alias("ip"),
        numbers.alias("numbers"),
        phones.alias("phone"),
        locals_.alias("local_phone"),
        names.alias("name"),
    )
    of_kind = lambda kind: F.filter("numbers", lambda m: m["kind"] == kind)
    rows = rows.select("doc_id", F.concat("email", "ip", of_kind("card"), "phone").alias("base"), F.concat(of_kind("account"), "local_phone", "name").alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    return rows.select("doc_id", F.transform(F.concat("base", apart), _voted).alias("found"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _voted(m: Column) -> Column:
    """A candidate with the labelers' votes: 1 yes, -1 no, 0 nothing."""
    value, kind, digits = m["value"], m["kind"], _digits(m["value"])
    near, number, named = F.lower(F.concat(m["before"], m["after"])), kind.isin("card", "account"), kind == "name"
    surname = F.substring_index(value, " ", -1)
    host = F.lower(F.substring_index(value, "@", -1))
    shape = F.when(kind == "email", _vote(host.rlike(r"\.[a-z]{2,}$"), ~host.rlike("[a-z]"))).when(kind == "ip", _vote(value.rlike("[0-9]{2}"), value.rlike(r"^([0-9]\.){3}[0-9]$"))).when(number, _vote(F.length(digits) == 16, F.length(digits) > 16)).when(named, _vote(F.length(surname) >= 4, surname.rlike(NOT_PERSONS))).otherwise(_vote(F.length(digits).between(10, 13), F.length(digits) < 10))
    gazetteer = F.when(kind == "email", _vote(host.rlike(TOP_LEVELS), F.lit(False))).when(kind == "ip", _vote(F.lit(True), value.rlike(RESERVED))).when(number, _vote(digits.rlike(ISSUERS), digits.rlike("^0000"))).when(named, _vote(surname.rlike(f"^({SURNAMES})$"), surname.rlike(NOT_PERSONS))).otherwise(_vote(value.rlike(CALLING_CODES), F.lit(False)))
    context = _vote(near.rlike(CUES) | (named & near.rlike(NAME_CUES)), near.rlike(OTHER_CUES) | (named & m["after"].rlike(r"^ (?:Street|Road|Avenue|Square|Bridge|University|Prize|Award)")))
    boundary = _vote(m["before"].rlike(r"(^|[\s(\"',;:<\[])$") & m["after"].rlike(r"^($|[\s)\"'.,;:!?>\]])"), m["before"].rlike("[A-Za-z0-9_]$") | m["after"].rlike("^[A-Za-z0-9_]"))
    kinds = F.size(F.array_distinct(F.split(F.when(kind.isin("email", "name"), value).otherwise(digits), "")))
    variety = _vote(kinds >= 5, kinds <= 3)
    votes = [v.cast("int").alias(n) for v, n in zip((shape, gazetteer, context, boundary, variety), LABELERS, strict=True)]
    size = F.least(F.lit(SIZES - 1), F.floor(F.length(value) / 8)).cast("int")
    return F.struct(kind.alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), size.alias("size"), *votes)


def vote_patterns(found: DataFrame) -> DataFrame:
    """(kind, size, votes, n): how often each pattern of votes occurs in each size class, over all candidates; at most 7 * 4 * 3^5 rows."""
    rows = found.select(F.explode("found").alias("m")).select("m.kind", "m.size", *(f"m.{n}" for n in LABELERS))
    return rows.groupBy("kind", "size", *LABELERS).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Reliability:
    """What expectation maximisation found: each labeler's accuracy, and the share of true candidates of each kind."""

    accuracy: dict[str, float]
    share: dict[str, float]


def estimate(patterns: list[tuple[str, tuple[int, ...], int]]) -> Reliability:
    """Accuracies and shares from pattern counts: (kind, votes, how often).

    A labeler that votes is right with one accuracy whatever the truth; smoothed by two pseudo-votes of 0.75, and
    shares by four pseudo-candidates of 0.5, so that no pattern decides alone.
    """
    accuracy = dict.fromkeys(LABELERS, 0.75)
    share = {k: 0.5 for k, _, _ in patterns}
    for _ in range(EM_ROUNDS):
        right, voted = dict.fromkeys(LABELERS, 1.5), dict.fromkeys(LABELERS, 2.0)
        true, total = dict.fromkeys(share, 2.0), dict.fromkeys(share, 4.0)
        for kind, votes, n in patterns:
            logit = math.log(share[kind] / (1 - share[kind])) + sum(v * math.log(accuracy[j] / (1 - accuracy[j])) for j, v in zip(LABELERS, votes, strict=True))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
            true[kind] += n * p
            total[kind] += n
            for j, v in zip(LABELERS, votes, strict=True):
                if v:
                    right[j] += n * (p if v > 0 else 1 - p)
                    voted[j] += n
        accuracy = {j: min(0.99, max(0.5, right[j] / voted[j])) for j in LABELERS}
        share = {k: min(0.99, max(0.01, true[k] / total[k])) for k in share}
    return Reliability(accuracy, share)


def posterior(field, reliability: Reliability) -> Column:
    """Probability of a candidate under the estimated reliabilities; ``field`` gives its columns by name."""
    prior = F.lit(0.0)
    for kind, share in sorted(reliability.share.items()):
        prior = F.when(field("kind") == kind, math.log(share / (1 - share))).otherwise(prior)
    total = prior
    for name in LABELERS:
        total = total + field(name) * F.lit(math.log(reliability.accuracy[name] / (1 - reliability.accuracy[name])))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _inputs(field) -> dict[str, Column]:
    """The classifier's features: each labeler's yes and no, the kind and the size class."""
    votes = {f"{n}_{s}": (field(n) == v).cast("double") for n in LABELERS for s, v in (("yes", 1), ("no", -1))}
    return votes | {f"is_{k}": (field("kind") == k).cast("double") for k in (*BASE, *FURTHER)} | {f"size_{k}": (field("size") == k).cast("double") for k in range(SIZES)}


def train(patterns: DataFrame, reliability: Reliability) -> dict[str, float]:
    """Weights of the final classifier, trained on every pattern as often as it occurs, split by its soft label."""
    p = posterior(F.col, reliability)
    rows = patterns.select(F.col("n").cast("double").alias("n"), p.alias("p"), *(c.alias(k) for k, c in _inputs(F.col).items()))
    both = rows.withColumn("label", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("weight", F.col("n") * F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p")))
    names = list(_inputs(F.col))
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(both.select("label", "weight", *names))
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.001, maxIter=100).fit(assembled)
    return dict(zip(names, model.coefficients.toArray().tolist(), strict=True)) | {"": float(model.intercept)}


def _accepted(m: Column, weights: dict[str, float]) -> Column:
    total = F.lit(weights[""])
    for name, column in _inputs(lambda n: m[n]).items():
        total = total + column * F.lit(weights[name])
    return m["kind"].isin(*BASE) | (total >= math.log(ACCEPT_FROM / (1 - ACCEPT_FROM)))


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, found): the base spans and the accepted further ones of every document: kind, start, stop (code points, stop exclusive).

    Null and empty texts, and an empty table, give no spans; repeated rows are kept.
    """
    found = written(candidates(documents), "pii-candidates")
    patterns = written(vote_patterns(found), "pii-patterns")
    counts = [(r["kind"], tuple(r[n] for n in LABELERS), r["n"]) for r in patterns.collect()]
    if not counts:
        return found.select("doc_id", F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"))).alias("found"))
    weights = train(patterns, estimate(counts))
    kept = F.filter("found", lambda m: _accepted(m, weights))
    return found.select("doc_id", F.transform(kept, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"))).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of spans, comma-joined in their order."""
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["stop"].cast("string"))), ",")
