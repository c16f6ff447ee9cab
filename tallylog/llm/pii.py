"""Personal data by weak supervision.  DataFrame functions only.

Candidates are spans of the fixed patterns (email, ip, card, phone) and of loose ones for account numbers, national numbers,
street addresses, names and other long numbers.  Five labelers vote on each: the pattern, the checks of its form,
a gazetteer, the words before it, and what touches it.  For each kind, expectation-maximisation over the table of vote
patterns estimates how reliable each labeler is, and the posteriors train the final classifier: a naive Bayes model over features
of the span and of its context, fitted by grouped sums.  Spans of the fixed patterns always stay; other
candidates are added where the classifier is sure of them and a labeler that looks at them alone speaks for them.

All patterns start at the begin of a run of characters or where the last match ended, and places are summed in
blocks, so a text takes time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.llm.shared import materialize, utf8_or_empty

#: The base patterns of the contract.  Possessive repeats, and starts at the begin of a run or where the last match
#: ended, find the same matches without trying a run again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square|Sq"
#: Loose patterns, tight ones first: where candidates overlap, one of an earlier kind stays.
LOOSE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "address": (
        rf"(?<![0-9])[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{L}}{{1,30}}\x20){{1,3}}(?:{_STREET})(?![\p{{L}}])"
        r"|(?<![\p{L}-])\p{Lu}[\p{L}-]{0,40}(?:stra(?:ß|ss)e|weg|platz|allee|gasse)\x20[0-9]{1,4}(?![0-9])"
        r"|(?<![0-9])[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place)\x20(?:de\x20|du\x20|des\x20|la\x20){0,2}\p{L}{1,30}"
        r"|(?<![\p{L}])(?i:calle|avenida|plaza)\x20\p{Lu}\p{L}{1,30},?\x20[0-9]{1,4}(?![0-9])"
    ),
    "name": r"(?<![\p{L}])\p{Lu}\p{Ll}{1,30}(?:[\x20-]\p{Lu}\p{Ll}{1,30}){1,2}(?![\p{L}])",
    "number": r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
KINDS = (*PATTERNS, *LOOSE)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Cue words of the context labeler, for and against.
CUES_FOR = "phone|tel|telefon|call|fax|mobile|whatsapp|sms|mail|contact|reach|write|ip|host|login|card|visa|account|konto|iban|ssn|social security|passport|born|patient"
NAME_CUES = "mr|mrs|ms|dr|prof|herr|frau|mme|monsieur|señor|señora|name|named|contact|dear|signed|patient|employee|customer|sincerely|regards"
ADDRESS_CUES = "address|adresse|dirección|lives at|resides at|home|ship to|wohnhaft"
CUES_AGAINST = "version|page|isbn|issue|vol|chapter|total|price|order|figure|table|line|build|release|year|license|the|of|in"
#: Gazetteers: common top-level domains, given names, and networks that no person has.
TOP_DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|it|nl|eu|ch|at|be|us|ca|au"
GIVEN_NAMES = (
    "Alice|Anna|Anne|Antonio|Carlos|Carmen|Charles|Christine|Claire|Daniel|David|Elena|Elizabeth|Emma|Eva|Francisco|Frank|Hans|Helen|Isabel|James|Jan|Jane|Jean|"
    "Jennifer|John|Jose|José|Juan|Julia|Karen|Karl|Klaus|Laura|Linda|Louis|Lucia|Luis|Manuel|Maria|María|Marie|Mark|Mary|Michael|Nicole|Paul|Pedro|Peter|Pierre|"
    "Richard|Robert|Sabine|Sarah|Sophie|Stefan|Susan|Thomas|Ursula|William"
)
_RESERVED_NET = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
CONTEXT = 24
LABELERS = ("pattern", "form", "gazetteer", "context", "edges")
#: Buckets of hashed context words, the least posterior of an added span, and rounds of expectation-maximisation.
BUCKETS, SURE, EM_ROUNDS = 1024, 0.9, 50
#: Matches whose places are summed one after the other.
_BLOCK = 256

#: Put around matches; in texts another character that Unicode leaves unassigned for good stands for it.
MARK, _INSTEAD = "\uffff", "\ufffe"

_SPANS = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, s, before, after), in code points, where ``gate`` holds; no text has MARK in it.

    One pass puts marks around the matches, so that the texts between matches and the matches alternate, and their lengths give the places: lengths are summed by block, the
    blocks before each block, and the matches within it.  ``before`` and ``after`` are the CONTEXT characters
    next to the match, up to the neighbouring matches of its kind.
    """
    none = F.expr(f"cast(array() as {_SPANS})")
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def cells(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p) - 3, F.lit(2)), lambda i: F.struct(
            F.length(F.get(p, i)).alias("skip"), F.length(F.get(p, i + 1)).alias("size"), F.get(p, i + 1).alias("s"),
            F.substring(F.get(p, i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(p, i + 2), 1, CONTEXT).alias("after"),
        ))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + x["skip"]
        stop = begin + x["size"]
        span = F.struct(begin.alias("start"), stop.alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(stop.alias("pos"), F.array_append(acc["out"], span).alias("out"))

    def block(z: Column, i: Column) -> Column:
        return F.slice(z, i * _BLOCK + 1, F.lit(_BLOCK))

    def places(z: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _BLOCK).cast("int"))
        sums = F.transform(blocks, lambda i: F.aggregate(block(z, i), F.lit(0), lambda s, x: s + x["skip"] + x["size"]))
        return _let(sums, lambda total: F.flatten(F.transform(blocks, lambda i: F.aggregate(
            block(z, i),
            F.struct(F.aggregate(F.slice(total, F.lit(1), i), F.lit(0), lambda s, x: s + x).alias("pos"), none.alias("out")),
            step, lambda acc: acc["out"],
        ))))

    found = _let(parts, lambda p: F.when(F.size(p) > 1, _let(cells(p), places)).otherwise(none))
    return F.when(gate, found).otherwise(none)


def _digits(s: Column) -> Column:
    return F.length(F.regexp_replace(s, "[^0-9]", ""))


def _iban_holds(s: Column) -> Column:
    """Whether the remainder by 97 of the moved and spelled-out number is 1."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        number = F.regexp_replace(s, "[^0-9]", "")
        return F.length(number).between(13, 19) & F.call_function("luhn_check", number)
    if kind == "phone":
        return _digits(s).between(9, 15)
    return F.lit(True)


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, base, more`` per row: arrays of (kind, start, end, s, before, after).

    ``base`` has the valid matches of the fixed patterns by kind, then start; ``more`` those of the loose patterns, which may overlap.
    """
    text = F.col("text")
    gates = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "name": F.lit(True), "address": F.col("digit")}
    rows = docs.select(F.col(id_col).alias("id"), F.translate(utf8_or_empty(F.col(text_col)), MARK, _INSTEAD).alias("text"))
    rows = rows.withColumn("digit", text.rlike("[0-9]"))
    found = {k: located(text, p, gates.get(k, F.col("digit"))) for k, p in (PATTERNS | LOOSE).items()}

    def of_kind(kind: str) -> Column:
        number = F.lit(KINDS.index(kind)).alias("kind")
        kept = F.filter(found[kind], lambda x: _valid(kind, x["s"]))
        return F.transform(kept, lambda x: F.struct(number, *[x[c].alias(c) for c in ("start", "end", "s", "before", "after")]))

    return rows.select("id", F.concat(*[of_kind(k) for k in PATTERNS]).alias("base"), F.concat(*[of_kind(k) for k in LOOSE]).alias("more"))


def _without_overlaps(spans: DataFrame) -> DataFrame:
    """``row, c`` less the loose candidates that overlap a span of a kind before theirs.

    One window holds the candidates of one text.
    """
    spans = spans.select("row", "c", F.col("c.start").alias("start"), F.col("c.kind").alias("kind"))
    earlier = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    clear = F.col("kind") < len(PATTERNS)
    for kind in range(len(PATTERNS), len(KINDS)):
        reached = F.max(F.when(F.col("kind") < kind, F.col("c.end"))).over(earlier)
        next_ = F.min(F.when(F.col("kind") < kind, F.col("start"))).over(later)
        apart = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(next_, F.lit(2**31 - 1)) >= F.col("c.end"))
        clear = clear | ((F.col("kind") == kind) & apart)
    return spans.withColumn("clear", clear).where("clear").select("row", "c")


def _votes(c: Column) -> dict[str, Column]:
    """The labelers: 1 for personal data, -1 against, 0 for no opinion."""
    kind, s, before, after = c["kind"], c["s"], F.lower(c["before"]), c["after"]
    is_ = {k: kind == i for i, k in enumerate(KINDS)}
    tail = F.regexp_extract(s, r"\.([A-Za-z]+)$", 1)
    words = F.split(s, r"[\x20-]")
    form = (
        F.when(is_["email"], F.when(tail != "", 1).otherwise(-1))
        .when(is_["ip"], F.when(s.rlike(r"(?:^|\.)0[0-9]"), -1).otherwise(1))
        .when(is_["card"], F.when(s.rlike("^[3-6]"), 1).otherwise(-1))
        .when(is_["phone"], F.when(s.rlike(r"\([^)]*$|^[^(]*\)"), -1).otherwise(1))
        .when(is_["iban"], F.when(_iban_holds(s), 1).otherwise(-1))
        .when(is_["national"], F.when(s.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 1).otherwise(-1))
        .when(is_["address"], 1)
        .when(is_["name"], F.when(F.size(F.array_distinct(words)) < F.size(words), -1).otherwise(0))
        .otherwise(F.when(_digits(s).between(9, 12) & s.rlike(r"[\x20().-]"), 1).when(_digits(s) > 15, -1).otherwise(0))
    )
    gazetteer = (
        F.when(is_["email"], F.when(F.lower(tail).rlike(f"^(?:{TOP_DOMAINS})$"), 1).otherwise(0))
        .when(is_["ip"], F.when(s.rlike(_RESERVED_NET), -1).otherwise(1))
        .when(is_["card"], F.when(s.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5))"), 1).otherwise(0))
        .when(is_["phone"], F.when(s.rlike(r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), 1).otherwise(-1))
        .when(is_["name"], F.when(s.rlike(rf"^(?:{GIVEN_NAMES})[\x20-]"), 1).otherwise(0))
        .otherwise(0)
    )
    cues = F.when(is_["name"], before.rlike(rf"(?U)\b(?:{NAME_CUES})\b[^\p{{L}}]*$")).when(is_["address"], before.rlike(rf"(?U)\b(?:{ADDRESS_CUES})\b[^\p{{L}}]*$"))
    cues = cues.otherwise(before.rlike(rf"\b(?:{CUES_FOR})\b[^a-z]*$"))
    context = F.when(cues, 1).when(before.rlike(rf"\b(?:{CUES_AGAINST})\b[^a-z]*$"), -1).otherwise(0)
    touched = before.rlike(r"[\p{L}0-9_/=]$") | after.rlike(r"^[\p{L}0-9_/=]")
    opens = before.rlike(r"(?:^|[.!?\n]\s*)$")  # a capital there may be that of a sentence
    edges = F.when(touched, -1).when(is_["name"] & opens, -1).otherwise(1)
    pattern = F.when(kind < len(PATTERNS), 1).when(is_["number"] | is_["name"], 0).otherwise(1)
    return dict(zip(LABELERS, (pattern, form, gazetteer, context, edges)))


def estimate(table: list[tuple[tuple[int, ...], float]], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation-maximisation.

    ``table`` counts vote patterns, of which there are at most 3 ** labelers.  Each labeler votes independently
    given the class; its vote probabilities start from the belief that it is right more often than not.
    """
    if not table:
        return {}
    labelers = range(len(table[0][0]))
    rate = {(j, v, y): {1: 0.7, 0: 0.5, -1: 0.3}[v if y else -v] for j in labelers for v in (-1, 0, 1) for y in (0, 1)}
    prior = 0.5
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes, _ in table:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, v, 1] / rate[j, v, 0]) for j, v in enumerate(votes))
            posterior[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = sum(n for _, n in table)
        positive = sum(n * posterior[v] for v, n in table)
        prior = (positive + 1) / (total + 2)
        for y, mass in ((1, positive), (0, total - positive)):
            for j in labelers:
                for v in (-1, 0, 1):
                    got = sum(n * (posterior[p] if y else 1 - posterior[p]) for p, n in table if p[j] == v)
                    # a pseudo-count of the starting belief keeps the classes from changing places
                    start = {1: 0.7, 0: 0.5, -1: 0.3}[v if y else -v] / 1.5
                    rate[j, v, y] = (got + 10 * start) / (mass + 10)
    return posterior


def _features(c: Column) -> Column:
    """Names of the features of a candidate: form, votes' grounds, edges, and hashed words before it (BUCKETS of them)."""
    words = F.filter(F.split(F.lower(c["before"]), r"[^\p{L}]+"), lambda w: w != "")
    last = F.element_at(F.concat(F.array(F.lit("")), words), -1)
    kind = c["kind"].cast("string")

    def feature(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}="), kind, F.lit("/"), value)

    votes = _votes(c)
    return F.array(
        feature("digits", F.least(_digits(c["s"]), F.lit(20)).cast("string")),
        feature("shape", F.substring(F.regexp_replace(F.regexp_replace(c["s"], "[0-9]+", "9"), r"\p{L}+", "a"), 1, 12)),
        feature("word", F.pmod(F.xxhash64(last), F.lit(BUCKETS)).cast("string")),
        feature("next", F.regexp_replace(F.substring(c["after"], 1, 1), r"[\p{L}]", "a")),
        *[feature(name, votes[name].cast("string")) for name in ("form", "gazetteer", "context", "edges")],
    )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """One row per document: ``<id_col>``, ``n_<kind>`` of each kind, ``base`` and ``spans``.

    ``base`` has the spans of the fixed patterns and ``spans`` also those that the classifier adds; both are
    arrays of (kind, start, end) by kind as listed in KINDS, then start, in code points, end exclusive.

    Null and empty texts have no spans.  Repeated rows are scanned each.  Without candidates, or on an empty table,
    nothing is learned and nothing added.  Other columns are ignored.
    """
    spark = docs.sparkSession
    found = materialize(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = found.where((F.size("base") > 0) | (F.size("more") > 0)).select("row", F.explode(F.concat("base", "more")).alias("c"))
    some = _without_overlaps(some)
    voted = some.select("row", "c.kind", "c.start", "c.end", _features(F.col("c")).alias("features"), *[v.alias(k) for k, v in _votes(F.col("c")).items()])
    voted = materialize(voted, "votes")
    counted: dict[int, list] = {}
    for r in voted.groupBy("kind", *LABELERS).count().collect():  # at most 3 ** 5 rows of each kind
        counted.setdefault(r["kind"], []).append((tuple(r[k] for k in LABELERS), float(r["count"])))
    beliefs = [(kind, *votes, p) for kind, table in counted.items() for votes, p in estimate(sorted(table)).items()]
    one = f"struct<kind:int,{','.join(f'{k}:int' for k in LABELERS)},p:double>"
    listed = json.dumps([dict(zip(("kind", *LABELERS, "p"), x)) for x in beliefs])
    belief = spark.range(1).select(F.inline(F.from_json(F.lit(listed), f"array<{one}>")))
    weighed = voted.join(F.broadcast(belief), ["kind", *LABELERS])
    totals = weighed.groupBy("kind").agg((F.sum("p") + 1).alias("all_yes"), (F.sum(1 - F.col("p")) + 1).alias("all_no"))
    by_feature = weighed.select("kind", "p", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    # a naive Bayes weight for each feature; features stand alone, so each counts half
    share = ((F.col("yes") + 1) / (F.col("all_yes") + 1)) / ((F.col("no") + 1) / (F.col("all_no") + 1))
    weights = by_feature.join(F.broadcast(totals), "kind").select("feature", (0.5 * F.log(share)).alias("weight"))
    alone = (F.col("form") == 1) | (F.col("gazetteer") == 1) | (F.col("context") == 1)
    open_ = weighed.where((F.col("kind") >= len(PATTERNS)) & alone).select("row", "kind", "start", "end", F.explode("features").alias("feature"))
    scored = open_.join(weights, "feature").groupBy("row", "kind", "start", "end").agg(F.sum("weight").alias("odds"))
    scored = scored.join(F.broadcast(totals), "kind").withColumn("odds", F.col("odds") + F.log(F.col("all_yes") / F.col("all_no")))
    accepted = scored.where(F.col("odds") >= math.log(sure / (1 - sure)))
    added = accepted.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))

    rows = found.select("row", "id", F.transform("base", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("base"))
    rows = rows.join(added, "row", "left").withColumn("added", F.coalesce("added", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    names = F.array(*[F.lit(k) for k in KINDS])

    def named(spans: Column) -> Column:
        return F.transform(
            F.array_sort(spans), lambda c: F.struct(F.element_at(names, c["kind"] + 1).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        )

    def number(kind: str) -> Column:
        return F.size(F.filter("base" if kind in PATTERNS else "added", lambda c: c["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("id").alias(id_col), *[number(k) for k in KINDS], named(F.col("base")).alias("base"), named(F.concat("base", "added")).alias("spans"))
