"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) are patterns with a rule, and their rule alone decides.
For the other kinds patterns propose spans, many of them wrong, and labelers vote on each one
(yes, no, or nothing): its form (digits, checksums, alternation of letters and digits), gazetteers
(countries, titles, prefixes of keys, words), cue words around it in four languages, the
characters beside it, and how varied it is. Expectation-maximisation over the counts of vote
patterns estimates, for each kind, how common true spans are and how reliable each labeler is;
the resulting probabilities train a naive Bayes span classifier on the votes and the spans' own
features, and the proposals that it accepts are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labourmill.llm.shared import bind, materialize

#: Kinds with a base rule, in their order, and the patterns of their proposals. Lookbehinds and
#: possessive loops change no match: they spare the engine starts and returns that can't succeed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Names of secrets and titles of persons, in English, German, French and Spanish.
SECRET_NAMES = "password|passwd|pwd|token|secret|api_?key|access_?key|passwort|kennwort|zugangscode|mot de passe|mdp|jeton|contraseña|clave"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora"
#: Kinds that only the method adds, by the patterns of their proposals.
ADDED = {
    "secret": rf"(?<![A-Za-z0-9/+_-])(?:(?i:{SECRET_NAMES})[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?[A-Za-z0-9/+_-]{{8,}}+|[A-Za-z0-9/+_-]{{16,}}+)[\x22\x27]?",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9(+][\x20.-])(?<![0-9+(.-])(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}|0[1-9](?:[\x20.-][0-9]{2}){4}|0[0-9]{2,4}/[0-9]{5,8}|[679][0-9]{2}(?:\x20[0-9]{3}){2}|[679][0-9]{2}(?:\x20[0-9]{2}){3})(?![0-9-])",
    "name": rf"(?<![\p{{L}}])(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
}
KINDS = [*BASE, *ADDED]
#: A text without a match of this has none of the kind.
_NEEDS = {"email": "@", "phone": "\\+", "secret": "[A-Za-z0-9/+_-]{16}|[=:]", "ssn": "-", "local_phone": "[0-9][.\\x20/-][0-9]", "name": f"{TITLES}", "ip": "\\.", "card": "[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}

#: Word lists of the gazetteer and context labelers, in the four languages.
KEY_PREFIXES = "sk- pk- rk_ ghp_ gho_ glpat- akia asia xoxb- xoxp- eyj aiza".split()
IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
_PHONE_WORDS = "phone tel telephone call mobile cell fax telefon anrufen handy mobil téléphone appeler portable teléfono llamar móvil"
CUES = {
    "secret": "password passwd pwd token secret key login credential credentials passwort kennwort schlüssel zugang passe jeton clé contraseña clave",
    "ssn": "ssn social security sozialversicherung sécurité sociale seguro social",
    "local_phone": _PHONE_WORDS,
    "name": "by from dear contact with von an liebe lieber sehr geehrter geehrte par cher chère bonjour de estimado estimada hola",
    "iban": "iban account bank konto kontonummer compte banque cuenta banco bic",
}
AGAINST = {
    "secret": "commit sha sha1 sha256 md5 digest checksum revision hash uuid etag prüfsumme empreinte suma",
    "name": "street avenue straße rue calle hotel",
} | dict.fromkeys(("ssn", "local_phone", "iban"), "version isbn order serial chapter section figure page release no id sku bestellung seite kapitel commande chapitre pedido página capítulo")
#: Characters of context on either side.
CONTEXT = 24

_PROPOSALS = "array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:array<tinyint>,features:array<string>>>"

EM_STEPS = 50
#: Before any evidence a labeler's vote is taken to be right this often (form, gazetteer, context, left,
#: right, variety), with the weight of so many votes and of as many again as the labeler gave; and a
#: span to be true as likely as not, with the same weight.
RELIABILITY, PRIOR_VOTES = (0.8, 0.8, 0.95, 0.8, 0.8, 0.8), 10.0
_GROUP = 512


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before, after) of all matches, in code points."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(parts: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: (F.char_length(F.get(parts, i)) + F.char_length(h)).cast("long"))

        def total(x: Column) -> Column:
            return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)

        def spans(lengths: Column) -> Column:
            # Running sums in two levels: over groups of matches, and within each.
            groups = F.aggregate(
                F.sequence(F.lit(0), F.floor(F.size(lengths) / _GROUP).cast("int")),
                F.array(F.lit(0).cast("long")),
                lambda a, g: F.array_append(a, F.element_at(a, -1) + total(F.slice(lengths, g * _GROUP + 1, _GROUP))),
            )
            return bind(
                groups,
                lambda sums: F.transform(
                    hits,
                    lambda h, i: bind(
                        F.get(sums, F.floor(i / _GROUP).cast("int")) + total(F.slice(lengths, F.floor(i / _GROUP).cast("int") * _GROUP + 1, i % _GROUP)) + F.char_length(F.get(parts, i)),
                        lambda start: F.struct(
                            start.alias("start"), (start + F.char_length(h)).alias("end"), h.alias("value"),
                            F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("after"),
                        ),
                    ),
                ),
            )

        return bind(lengths, spans)

    return bind(hits, lambda h: bind(F.when(F.size(h) > 0, parts).otherwise(F.array(F.lit(""))), lambda p: placed(p, h)))


def _luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the Luhn sum."""
    padded = F.lpad(digits, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    terms = [F.substring(doubled if i % 2 else padded, i, 1).cast("int") for i in range(1, 21)]
    return sum(terms[1:], terms[0]) % 10 == 0


def _iban_sum(value: Column) -> Column:
    """Whether the account's number leaves 1 by 97; letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    number = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda a, c: bind(number(c), lambda n: F.when(n > 9, (a * 100 + n) % 97).otherwise((a * 10 + n) % 97))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c).cast("int"))) == 1


def _base_rule(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
        return F.forall(F.split(value, "[.]"), lambda p: p.rlike(small))
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0)).cast("byte")


def _core(value: Column) -> Column:
    """A secret without its name and quotes."""
    return F.regexp_replace(F.regexp_replace(value, r"^[^=:]*+[=:]\x20?[\x22\x27]?", ""), r"[\x22\x27]$", "")


def _alternation(value: Column) -> Column:
    """How many runs of letters, runs of digits and other characters follow each other."""
    return F.char_length(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "0"), r"\p{L}+", "a"))


def _votes(kind: str, s: Column) -> Column:
    """One vote of each labeler: 1, -1 or 0."""
    value, low, never = s["value"], F.lower(s["value"]), F.lit(False)
    words = F.split(F.lower(F.regexp_replace(s["before"], r"[^\p{L}0-9]+", " ")), " ")
    said = lambda some: F.arrays_overlap(words, F.array(*[F.lit(w) for w in some.split()]))
    core = _core(value) if kind == "secret" else value
    plain = core.rlike(r"^(?:\p{Lu}?\p{Ll}++|\p{Lu}++|[0-9]++)$")  # a word or a number
    forms = {
        "secret": (_alternation(core) >= 4, plain | core.rlike(r"^/?[A-Za-z]++(?:[/_-][A-Za-z]++)*+/?$")),
        "ssn": (~value.rlike(r"^(000|666|9)|-00-|-0000$"), value.rlike(r"^(000|666|9)|-00-|-0000$")),
        "local_phone": (value.rlike(r"^\(?[2-9]|^0[1-9]"), value.rlike(r"^\(?1|^\(?0[^1-9]")),
        "name": (value.rlike(r"\x20.*\x20"), never),
        "iban": (_iban_sum(value), ~_iban_sum(value)),
    }
    lists = {
        "secret": (F.lower(core).rlike(f"^({'|'.join(KEY_PREFIXES)})"), plain),
        "ssn": (never, value.rlike("^(123-45-6789|078-05-1120|219-09-9999)$")),  # printed as examples
        "local_phone": (never, value.rlike("^[(]?555")),
        "name": (value.rlike("^(Mrs|Ms|Mr|Prof|Herr|Frau|Mme|Mlle|Señora?)"), value.rlike(r"(?i)\x20(street|road|hotel|pepper|who|no)$")),
        "iban": (F.substring(value, 1, 2).isin(IBAN_COUNTRIES), ~F.substring(value, 1, 2).isin(IBAN_COUNTRIES)),
    }
    named = value.rlike("[=:]") if kind == "secret" else never
    distinct = F.size(F.array_distinct(F.split(F.lower(core), "")))
    return F.array(
        _vote(*forms[kind]),
        _vote(*lists[kind]),
        _vote(named | said(CUES[kind]), said(AGAINST[kind])),
        # What most spans have says nothing for them; only its lack says something against.
        _vote(never, s["before"].rlike(r"[\p{L}0-9_/-]$")),
        _vote(never, s["after"].rlike(r"^[\p{L}0-9_/-]")),
        _vote(never, distinct <= F.lit(6 if kind == "secret" else 2)),
    )


def _features(s: Column, votes: Column) -> Column:
    """Names of what the classifier looks at: each has few values."""
    n = F.char_length(s["value"])
    # The boundaries' and the variety's votes stand among the other features already.
    heard = [F.concat(F.lit(f"vote{k}_"), F.get(votes, F.lit(k)).cast("string")) for k in range(3)]
    share = F.floor(10 * F.char_length(F.regexp_replace(s["value"], "[^0-9]", "")) / n)
    kind_of = lambda c: F.when(c == "", "edge").when(c.rlike("[a-z]"), "lower").when(c.rlike("[A-Z]"), "upper").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")
    return F.array(
        F.concat(F.lit("length"), F.least(F.floor(n / 4), F.lit(15))),
        F.concat(F.lit("digits"), share),
        F.concat(F.lit("before_"), kind_of(F.right(s["before"], F.lit(1)))),
        F.concat(F.lit("after_"), kind_of(F.left(s["after"], F.lit(1)))),
        F.concat(F.lit("distinct"), F.least(F.size(F.array_distinct(F.split(s["value"], ""))), F.lit(15))),
        *heard,
    )


def proposals(text: Column) -> Column:
    """Array of (kind, start, end, base, votes, features) of a text; null: none. Matches of base
    kinds that fail their rule are left out; the others have neither votes nor features."""
    text = F.coalesce(text, F.lit(""))

    def span(kind: str, s: Column, votes: Column, features: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind in BASE).alias("base"), votes.alias("votes"), features.alias("features"))

    def of(kind: str) -> Column:
        spans = _spans(text, (BASE | ADDED)[kind])
        if kind in BASE:
            found = F.transform(F.filter(spans, lambda s: _base_rule(kind, s["value"])), lambda s: span(kind, s, F.array().cast("array<tinyint>"), F.array().cast("array<string>")))
        else:
            found = F.transform(spans, lambda s: bind(_votes(kind, s), lambda v: span(kind, s, v, _features(s, v))))
        return F.when(text.rlike(_NEEDS[kind]), found).otherwise(F.array().cast(_PROPOSALS))

    return F.concat(*[of(kind) for kind in KINDS])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def label_model(spans: DataFrame) -> DataFrame:
    """kind, votes, p: probability that spans with these votes are true, by EM for each kind.

    Two numbers a labeler: how often its vote is a yes on true spans and on false ones, so one
    that says yes to everything tells nothing. Spans are summed by kind and votes first; there are
    at most 3 ** 6 vote patterns, so a kind's fit is one row.
    """
    patterns = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    rows = patterns.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("seen"))

    def posterior(votes: Column, state: Column) -> Column:
        told = F.zip_with(votes, state["rates"], lambda v, r: F.when(v > 0, F.log(r["hit"] / r["alarm"])).when(v < 0, F.log((1 - r["hit"]) / (1 - r["alarm"]))).otherwise(0.0))
        return 1 / (1 + F.exp(-(F.log(state["prior"] / (1 - state["prior"])) + _sum(told))))

    def step(state: Column, _: Column) -> Column:
        scored = F.transform("seen", lambda s: bind(s["n"] * posterior(s["votes"], state), lambda t: F.struct(s["votes"].alias("votes"), t.alias("true"), (s["n"] - t).alias("false"))))

        def rate(scored: Column, k: int, which: str, before: float) -> Column:
            yes = _sum(F.transform(scored, lambda s: F.when(F.get(s["votes"], k) > 0, s[which]).otherwise(0.0)))
            all_ = _sum(F.transform(scored, lambda s: F.when(F.get(s["votes"], k) != 0, s[which]).otherwise(0.0)))
            return (yes + before * (all_ + PRIOR_VOTES)) / (2 * all_ + PRIOR_VOTES)

        def fitted(scored: Column) -> Column:
            true, false = _sum(F.transform(scored, lambda s: s["true"])), _sum(F.transform(scored, lambda s: s["false"]))
            rates = F.array(*[F.struct(rate(scored, k, "true", r).alias("hit"), rate(scored, k, "false", 1 - r).alias("alarm")) for k, r in enumerate(RELIABILITY)])
            return F.struct(((true + 0.5 * (true + false + PRIOR_VOTES)) / (2 * (true + false) + PRIOR_VOTES)).alias("prior"), rates.alias("rates"))

        return bind(scored, fitted)

    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.struct(F.lit(r).alias("hit"), F.lit(1 - r).alias("alarm")) for r in RELIABILITY]).alias("rates"))
    fit = rows.select("kind", "seen", F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), start, step).alias("state"))
    told = bind(F.col("state"), lambda state: F.transform("seen", lambda s: F.struct(s["votes"].alias("votes"), posterior(s["votes"], state).alias("p"))))
    return fit.select("kind", told.alias("told")).select("kind", F.inline("told"))


def span_classifier(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the map ``weights``: log odds of (kind, feature), and of the kind alone.

    Every span counts for both classes by its probability. A kind has a few dozen features, so
    the map's size is bounded whatever the corpus.
    """
    # At most 3 ** 6 rows for each of the kinds.
    judged = spans.join(F.broadcast(labels), ["kind", "votes"])
    of_kind = judged.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    counts = judged.select("kind", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum("p").alias("y"), F.sum(1 - F.col("p")).alias("n"))
    odds = counts.join(of_kind, "kind").select(
        F.concat_ws("|", "kind", "feature").alias("name"), F.log((F.col("y") + 1) / (F.col("yes") + 2) / ((F.col("n") + 1) / (F.col("no") + 2))).alias("weight")
    )
    priors = of_kind.select(F.concat_ws("|", "kind", F.lit("")).alias("name"), F.log((F.col("yes") + 1) / (F.col("no") + 1)).alias("weight"))
    return odds.unionByName(priors).agg(F.map_from_entries(F.collect_list(F.struct("name", "weight"))).alias("weights"))


def fit(spans: DataFrame) -> DataFrame:
    """The classifier's row from rows of (kind, votes, features); base kinds have no part in it."""
    added = spans.filter(F.col("kind") >= len(BASE))
    return materialize(span_classifier(added, label_model(added)))


def accepted(found: Column, weights: Column) -> Column:
    """The base kinds' spans and those proposals that the classifier accepts; by start, then kind."""

    def score(s: Column, w: Column) -> Column:
        name = lambda f: F.concat_ws("|", s["kind"].cast("string"), f)
        return F.coalesce(F.try_element_at(w, name(F.lit(""))), F.lit(0.0)) + _sum(F.transform(s["features"], lambda f: F.coalesce(F.try_element_at(w, name(f)), F.lit(0.0))))

    kept = bind(weights, lambda w: F.filter(found, lambda s: s["base"] | (score(s, w) > 0)))
    return F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of ``docs`` and ``spans``: array of (start, kind, end, base).

    start and end count code points, the end exclusive; kind indexes KINDS. A null or empty text
    has none. Proposals, without texts, are written once and read for each fit. Nothing but
    counts is shuffled.
    """
    keep = ["doc_id"] if keep is None else keep
    found = materialize(docs.select(*[F.col(f"`{c}`") for c in keep], proposals(F.col(f"`{text}`")).alias("__found")))
    weights = fit(found.select(F.inline("__found")).select("kind", "votes", "features"))
    return found.withColumn("__weights", weights.select("weights").scalar()).select(
        *[F.col(f"`{c}`") for c in keep], accepted(F.col("__found"), F.coalesce("__weights", F.create_map().cast("map<string,double>"))).alias("spans")
    )


#: Code points of a piece of a text.
_PIECE = 512


def _replaced(text: Column, spans: Column) -> Column:
    """A text with each of its spans (sorted, one at least) as the name of its kind; of spans that overlap the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    none = F.lit(0).cast("long")

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """The code points a to b: parts of the two pieces they lie in, and those between."""
        first, last = F.floor(a / _PIECE).cast("int"), F.floor((b - 1) / _PIECE).cast("int")
        head, tail = (a % _PIECE + 1).cast("int"), ((b - 1) % _PIECE + 1).cast("int")
        whole = F.concat(F.substring(F.get(pieces, first), head, F.lit(_PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(F.get(pieces, last), F.lit(1), tail))
        return F.when(a >= b, "").when(first == last, F.substring(F.get(pieces, first), head, (b - a).cast("int"))).otherwise(whole)

    def furthest(some: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(some, lambda s: s["end"])), none)

    def marked(ends: Column) -> Column:
        """Each span with the furthest end before it: of the groups before its own, and within its own."""

        def one(s: Column, i: Column) -> Column:
            group = F.floor(i / _GROUP).cast("int")
            before = F.greatest(F.get(ends, group), furthest(F.slice(spans, group * _GROUP + 1, i % _GROUP)))
            return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), before.alias("before"))

        return F.transform(spans, one)

    groups = F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(spans) / _GROUP).cast("int")),
        F.array(none),
        lambda a, g: F.array_append(a, F.greatest(F.element_at(a, -1), furthest(F.slice(spans, g * _GROUP + 1, _GROUP)))),
    )
    kept = F.filter(bind(groups, marked), lambda s: s["start"] >= s["before"])
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))
    parts = bind(pieces, lambda p: F.concat(F.transform(kept, lambda s: F.concat(cut(p, s["before"], s["start"]), F.get(names, s["kind"]))), F.array(cut(p, furthest(spans), F.char_length(text).cast("long")))))
    return F.array_join(parts, "")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind, as [EMAIL]; of spans that overlap
    the first replaces the others too. Null texts stay null; n_chars, if there, is counted anew.
    Time is linear in a text's length, however many spans it has."""
    # Written with their proposals, so that no text is searched twice.
    marked = materialize(docs.select(F.struct("*").alias("row"), proposals(F.col(f"`{text}`")).alias("found")))
    fitted = fit(marked.select(F.inline("found")).select("kind", "votes", "features"))
    source = F.col(f"row.`{text}`")
    weights = F.coalesce("weights", F.create_map().cast("map<string,double>"))
    spans = accepted(F.col("found"), weights)
    clean = F.when(source.isNotNull(), bind(spans, lambda s: F.when(F.size(s) == 0, source).otherwise(_replaced(source, s))))
    judged = marked.withColumn("weights", fitted.select("weights").scalar()).select("row", clean.alias("clean"))
    new = {text: F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = find_spans(docs)
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return spans.select("doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
