"""Personal data (operator 9), in DataFrame and SQL functions only.

Four base patterns with their checks give spans that always stay.  Beside them
generators with high recall propose further spans, which may overlap: addresses
that are spelt out, numbers without the marks of their kind.  Boosted trees
score each by its form and by the words before it, and for each kind a
threshold, calibrated on held-out rows, selects which are added; of those that
overlap the best is taken first, and none that touches a base span is taken.
Numbers are proposed as every stretch of whole runs of digits that has a right
count of digits, so one beside other numbers is found too.

Labels are not at hand, so the trees learn by agreement of form and context.
Right is what both speak for: base spans with their marks taken away or spelt
out, behind a word that announces their kind (a check digit that fits speaks for
a card as well).  Wrong is what one of them speaks against: the same spans where
they stand, with nothing that announces them; proposals of the text itself of
which that is true; and look-alikes (dates, lists of years, order numbers),
half of them announced, planted into a bounded number of documents.
Trees are fitted on the driver on a bounded sample of one half of the examples,
by hash.  The threshold of a kind is calibrated on the text's own proposals of
the other half, in all documents, that nothing speaks for: ``ALLOWED`` of them
may lie above it, and it is never below even odds (see ``threshold``).  Planted
look-alikes have no part in that.

Places are counted in code points.  A pattern cuts a text into gaps and matches
(``split`` and ``regexp_extract_all`` find the same matches), whose lengths are
summed up, so the work is a projection: no shuffle, and rows may repeat.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .boosting import Trees, fit

KINDS = ["email", "ip", "card", "phone"]
#: A match of the first two can only begin where a run of its first characters
#: begins (or, for an address, where the last match ended); saying so keeps long
#: runs from being tried at every place.  Numbers ask for their first digit first,
#: so all other places are passed over quickly.
BASE = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: What may be meant by an address that is spelt out, and a run of digits.
WIDE = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    r"[0-9]++",
]
#: For the other kinds: what may stand between two runs of digits of one number, and how many runs and digits it may have.
#: Cards and phones look alike.
BETWEEN = {1: r"\A\x20?[.:,]\x20?\z", 2: r"\A[\x20./_-]{1,2}\z", 3: r"\A[\x20()./-]{1,3}\z"}
RUNS = {1: (4, 4), 2: (1, 19), 3: (1, 15)}
DIGITS = {1: (4, 1 << 30), 2: (12, 19), 3: (9, 15)}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
CUES = ["(?:(?:e-?)?mail|contact|write|courriel|correo)", "(?:ip|host|server|address|adresse)", "(?:card|visa|credit|carte|tarjeta|karte)", "(?:tel|phone|call|mobile|fax|t[eé]l[eé]phone|tel[eé]fono)"]
#: Examples that the trees are fitted on at most, half of them right and half wrong, those with the least hashes.
ROWS = 20_000
#: Documents into which look-alikes are planted, about; those with the least hashes.
LOOK_ALIKES = 5_000
#: Share of a kind's wrong held-out proposals that its threshold lets pass.
ALLOWED = 0.005
#: Words that announce a kind.
ANNOUNCED = ["email", "ip", "card", "phone"]
#: Bins of a score for each unit of log odds, in which held-out candidates are counted.
BINS = 128
CONTEXT = 24
#: Matches whose lengths are summed up together.
STRIDE = 1024

FEATURES = ["kind", "chars", "digits", "marks", "groups", "longest_group", "letters", "glued_before", "glued_after", "cue", "at_sign", "luhn", "dots", "greatest_group", "tail"]


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    n = F.length(d)
    one = lambda i: F.substring(d, F.cast("int", n) - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, one(i)).otherwise((one(i) * 2) % 10 + (one(i) * 2 / 10).cast("int")))


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return luhn_sum(d) % 10 == 0


def valid(kind: int, x: Column) -> Column:
    """The check of a base match."""
    d = digits(x)
    if kind == 1:
        return x.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == 2:
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    return F.length(d).between(9, 15) if kind == 3 else F.lit(True)


def plausible(kind: int, x: Column) -> Column:
    """What a proposal of the kind must be, whatever its score: the parts of an ip are at most 255."""
    return x.rlike(rf"\A{_PART}(?:\x20?[.:,]\x20?{_PART}){{3}}\z") if kind == 1 else F.lit(True)


def matches(df: DataFrame, text: str, patterns: list[str], name: str, has: list[Column]) -> DataFrame:
    """Add columns name0, name1, ...: arrays of (start, end, match, before, after) of all matches of each pattern."""
    empty = F.array().cast("array<string>")
    for k, p in enumerate(patterns):
        df = df.withColumns({f"_gap{k}": F.when(has[k], F.split(F.col(text), p, -1)).otherwise(empty), f"_hit{k}": F.when(has[k], F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).otherwise(empty)})
    for k in range(len(patterns)):
        df = df.withColumn(f"_len{k}", F.zip_with(F.slice(f"_gap{k}", F.lit(1), F.size(f"_hit{k}")), f"_hit{k}", lambda g, h: F.length(g) + F.length(h)))
    for k in range(len(patterns)):
        blocks = F.sequence(F.lit(0), F.floor(F.size(f"_len{k}") / STRIDE).cast("int"))
        df = df.withColumn(f"_lead{k}", F.transform(blocks, lambda b: F.aggregate(F.slice(F.col(f"_len{k}"), F.lit(1), b * STRIDE), F.lit(0), lambda a, x: a + x)))
    for k in range(len(patterns)):

        def span(h: Column, i: Column) -> Column:
            lead = F.col(f"_lead{k}")[F.floor(i / STRIDE).cast("int")]
            end = lead + F.aggregate(F.slice(F.col(f"_len{k}"), (i - i % STRIDE + 1).cast("int"), (i % STRIDE + 1).cast("int")), F.lit(0), lambda a, x: a + x)
            gap, following = F.col(f"_gap{k}")[i], F.col(f"_gap{k}")[i + 1]
            return F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("match"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(following, F.lit(1)).alias("after"))

        df = df.withColumn(f"{name}{k}", F.transform(f"_hit{k}", span))
    return df.drop(*(f"_{x}{k}" for x in ("gap", "hit", "len", "lead") for k in range(len(patterns))))


def features(kind: int, match: Column, before: Column, after: Column) -> dict[str, Column]:
    d = digits(match)
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    number = lambda c: c.cast("double")
    return {
        "kind": F.lit(float(kind)), "chars": number(F.length(match)), "digits": number(F.length(d)), "marks": number(F.length(F.regexp_replace(match, r"[A-Za-z0-9\x20]", ""))),
        "groups": number(F.size(groups)), "longest_group": number(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))), "letters": number(F.length(F.regexp_replace(match, "[^A-Za-z]", ""))),
        "glued_before": number(before.rlike(r"[\p{L}\p{N}\x22'#$_=/.+-]\z")), "glued_after": number(after.rlike(r"\A[\p{L}\p{N}\x22'_/%-]")), "cue": number(F.lower(before).rlike(rf"\b{CUES[kind]}\b[^\n]{{0,12}}\z")),
        "at_sign": number(match.contains("@")), "luhn": number(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)) if kind == 2 else F.lit(0.0),
        "dots": number(F.regexp_count(F.lower(match), F.lit(r"\.|\bdot\b"))),
        "greatest_group": number(F.coalesce(F.array_max(F.transform(groups, lambda g: F.left(g, F.lit(6)).cast("int"))), F.lit(0))), "tail": number(F.length(F.regexp_extract(match, r"[A-Za-z]*\z", 0))),
    }


def blurred(kind: int, x: Column, way: Column) -> Column:
    """A base span as it might be written to be overlooked."""
    if kind == 0:
        at, dot = F.when(way % 2 == 0, F.lit(" at ")).otherwise(F.lit(" [at] ")), F.when(way % 2 == 0, F.lit(" dot ")).otherwise(F.lit(" [dot] "))
        # Half of them without their digits, as an address needs none, half by the first part of their name, half by the last two of a long host.
        few = lambda c: F.when(F.shiftright(way, 1) % 2 == 0, c).otherwise(F.coalesce(F.nullif(F.regexp_replace(c, "[0-9]", ""), F.lit("")), c))
        local, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
        local = F.when(F.shiftright(way, 3) % 2 == 0, F.substring_index(local, ".", 1)).otherwise(local)
        host = F.when(F.shiftright(way, 2) % 2 == 0, F.substring_index(host, ".", -2)).otherwise(host)
        return F.concat(few(local), at, F.replace(few(host), F.lit("."), dot))
    if kind == 1:
        return F.when(way % 2 == 0, F.replace(x, F.lit("."), F.lit(" . "))).otherwise(F.replace(x, F.lit("."), F.lit(":")))
    if kind == 2:
        return F.when(way % 2 == 0, F.regexp_replace(digits(x), "([0-9]{4})(?=[0-9])", "$1.")).otherwise(F.regexp_replace(digits(x), "([0-9]{4})(?=[0-9])", "$1/"))
    # Without the plus, without the country, with the call prefix, and in groups as they are usual.
    d = digits(x)
    local = lambda mark: F.regexp_replace(F.right(d, F.lit(10)), "^([0-9]{3})([0-9]{3})([0-9]+)$", f"$1{mark}$2{mark}$3")
    forms = [
        F.replace(x, F.lit("+"), F.lit("")), F.regexp_replace(x, r"^\+[0-9]+\x20?", ""), F.concat(F.lit("00"), F.regexp_replace(d, "([0-9]{2})(?=[0-9])", "$1 ")), F.regexp_replace(d, "([0-9]{3})(?=[0-9]{3})", "$1 "),
        local(" "), local("."), local("-"), F.concat(F.lit("0"), F.regexp_replace(F.right(d, F.lit(10)), "^([0-9]{2})([0-9]{4})([0-9]+)$", "$1 $2 $3")),
    ]
    return F.element_at(F.array(*forms), (F.pmod(way, F.lit(len(forms))) + 1).cast("int"))


class Model:
    """Trees and the least log odds that each kind needs; None: nothing is added."""

    def __init__(self, trees: Trees, least: list[float | None]):
        self.trees, self.least = trees, least


def _touch(a: Column, b: Column) -> Column:
    return (b["start"] < a["end"]) & (a["start"] < b["end"])


def _apart(c: Column) -> Column:
    """Whether a span touches no base span: runs of STRIDE base spans are passed over by their ends, and looked into where these touch."""
    inside = lambda r: F.exists(F.slice("base", r["at"], F.lit(STRIDE)), lambda b: _touch(c, b))
    return ~F.exists("_runs", lambda r: _touch(c, r) & inside(r))


def _numbers(kind: int, runs: Column) -> Column:
    """Every stretch of whole runs of digits that may be a number of the kind: (start, end, match, before, after).

    Each run is tried as the first with those after it, so the work is linear in the runs.
    """
    (fewest, most), (low, high) = RUNS[kind], DIGITS[kind]
    span = "struct<start: int, end: int, match: string, before: string, after: string>"

    def first(r: Column, i: Column) -> Column:
        # Of a run's neighbours only the gap is at hand; a dozen runs before it have all of its context.
        lead = F.array_join(F.transform(F.slice(runs, F.greatest(i - 11, F.lit(1)), F.least(i, F.lit(12))), lambda m: F.concat(m["before"], m["match"])), "")
        before = F.right(F.concat(lead, r["before"]), F.lit(CONTEXT))

        def step(acc: Column, m: Column) -> Column:
            fresh = acc["runs"] == 0
            gap = F.right(m["before"], m["start"] - acc["end"])
            open_ = acc["open"] & (fresh | ((m["start"] - acc["end"] <= 3) & gap.rlike(BETWEEN[kind])))
            n = acc["digits"] + m["end"] - m["start"]
            match = F.when(fresh, m["match"]).otherwise(F.concat(acc["match"], gap, m["match"]))
            open_ = open_ & (n <= high)
            fits = open_ & (n >= low) & (acc["runs"] + 1 >= fewest)
            one = F.struct(r["start"].alias("start"), m["end"].alias("end"), match.alias("match"), F.lit("").alias("before"), m["after"].alias("after"))
            return F.struct(
                open_.alias("open"), (acc["runs"] + 1).alias("runs"), n.alias("digits"), m["end"].alias("end"), F.when(open_, match).otherwise(F.lit("")).alias("match"),
                F.when(fits, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"),
            )

        zero = F.struct(F.lit(True).alias("open"), F.lit(0).alias("runs"), F.lit(0).alias("digits"), F.lit(0).alias("end"), F.lit("").alias("match"), F.array().cast(f"array<{span}>").alias("out"))
        found = F.aggregate(F.slice(runs, i + 1, F.lit(most)), zero, step, lambda acc: acc["out"])
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), before.alias("before"), m["after"].alias("after")))

    return F.flatten(F.transform(runs, first))


def _spans(docs: DataFrame, id_col: str, text_col: str, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, text, base: valid base spans (start, ord, end), and wide0..3: what generators propose apart from them."""
    df = docs.select(*(keep if keep is not None else [F.col(id_col).alias("doc_id")]), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    t = F.col("_text")
    some = t.rlike("[0-9]")
    df = matches(df, "_text", BASE, "base", [t.contains("@"), some, some, t.contains("+")])
    for k in range(len(KINDS)):
        df = df.withColumn(f"base{k}", F.filter(f"base{k}", lambda m: valid(k, m["match"])))
    df = df.withColumn("base", F.array_sort(F.concat(*(F.transform(f"base{k}", lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("ord"), m["end"].alias("end"))) for k in range(len(KINDS))))))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / STRIDE).cast("int")), lambda b: F.slice("base", b * STRIDE + 1, F.lit(STRIDE)))
    runs = F.transform(runs, lambda r, i: F.struct(F.array_min(F.transform(r, lambda x: x["start"])).alias("start"), F.array_max(F.transform(r, lambda x: x["end"])).alias("end"), (i * STRIDE + 1).alias("at")))
    df = df.withColumn("_runs", F.when(F.size("base") > 0, runs).otherwise(F.array().cast("array<struct<start: int, end: int, at: int>>")))
    many = t.rlike("[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9][^0-9]{0,3}[0-9]")
    df = matches(df, "_text", WIDE, "_any", [t.contains("@") | t.rlike(r"[\x20\[(]dot[\x20\])]"), many])
    df = df.withColumn("wide0", F.filter("_any0", _apart))
    for k in BETWEEN:
        df = df.withColumn(f"wide{k}", F.filter(_numbers(k, F.col("_any1")), _apart))
    return df.drop("_any0", "_any1", "_runs")


def planted(kind: int) -> Column:
    """A look-alike of the kind that is no personal data, between the document's own words: (h, y, k, match, before, after)."""
    seed = lambda n: F.xxhash64("doc_id", F.length("_text"), F.lit(kind), F.lit(n))
    part = lambda n, low, high: (low + F.pmod(seed(n), F.lit(high - low + 1))).cast("string")
    two = lambda n, low, high: F.lpad(part(n, low, high), 2, "0")
    long = lambda n, size: F.lpad(F.pmod(seed(n), F.lit(10**size)).cast("string"), size, "0")
    year = F.pmod(seed(1), F.lit(120)) + 1900
    way = F.pmod(seed(0), F.lit(4))
    if kind == 0:
        word = lambda n: F.element_at(F.array(*map(F.lit, ["a", "look", "home", "gate7", "everything", "headquarters", "room12", "yesterdayevening"])), (F.pmod(seed(n), F.lit(8)) + 1).cast("int"))
        match = F.concat(word(1), F.lit(" at "), word(2), F.lit(" dot "), word(3))
    elif kind == 1:
        match = F.when(way == 0, F.concat_ws(":", two(1, 0, 23), two(2, 0, 59), two(3, 0, 59), part(4, 0, 999))).when(way == 1, F.concat_ws(", ", part(1, 1, 999), part(2, 1, 999), part(3, 1, 999), part(4, 1, 999)))
        match = match.otherwise(F.concat_ws(".", part(1, 256, 999), part(2, 0, 99), part(3, 0, 9999), part(4, 0, 9)))
    elif kind == 2:
        # The last digit is any but the one that would pass the check.
        number = F.concat(long(1, 15), F.pmod(1 + F.pmod(seed(2), F.lit(9)) - luhn_sum(F.concat(long(1, 15), F.lit("0"))), F.lit(10)).cast("string"))
        match = F.when(way < 2, number).when(way == 2, F.regexp_replace(number, "([0-9]{4})(?=[0-9])", "$1.")).otherwise(F.concat(year.cast("string"), two(3, 1, 12), two(4, 1, 28), F.lit("."), two(5, 0, 23), two(6, 0, 59)))
    else:
        match = F.when(way == 0, F.concat_ws(" ", year, year + 1, year + 2)).when(way == 1, F.concat(year.cast("string"), F.lit("-"), two(2, 1, 12), F.lit("-"), two(3, 1, 28), F.lit(" "), two(4, 0, 23)))
        match = match.when(way == 2, long(2, 10)).otherwise(F.concat(long(3, 4), F.lit("/"), long(4, 6)))
    at = F.pmod(seed(7), F.greatest(F.length("_text"), F.lit(1))).cast("int")
    lead = F.element_at(F.array(*map(F.lit, [" ", " ", "#", "no. ", "=", "x"])), (F.pmod(seed(8), F.lit(6)) + 1).cast("int"))
    # The words before are those of the document up to the end of one; what cues personal data may stand among them by chance alone.
    before = F.concat(F.regexp_replace(F.substring(F.col("_text"), F.greatest(at - CONTEXT, F.lit(0)) + 1, F.lit(CONTEXT)), r"[^\x20]*\z", ""), lead)
    after = F.element_at(F.array(*map(F.lit, [" ", " ", ",", ".", "x", "/"])), (F.pmod(seed(9), F.lit(6)) + 1).cast("int"))
    return F.struct(F.xxhash64(seed(10)).alias("h"), F.lit(0.0).alias("y"), F.lit(kind).alias("k"), match.alias("match"), F.right(before, F.lit(CONTEXT)).alias("before"), after.alias("after"))


def _examples(docs: DataFrame, id_col: str, text_col: str, look_alikes: int) -> DataFrame:
    """h, y, real and the features of all examples of all documents, a row each, from one pass; real: the text itself holds it."""
    df = _spans(docs, id_col, text_col)
    share = min(1.0, look_alikes / max(1, docs.count()))
    low = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 12) <= int(share * 2**52)
    every = []
    for k in range(len(KINDS)):
        row = lambda h, y, real, match, before, after: F.struct(h.alias("h"), F.lit(y).cast("double").alias("y"), F.lit(real).alias("real"), F.lit(k).alias("k"), match.alias("match"), before.alias("before"), after.alias("after"))  # noqa: B023, E731

        announce = lambda before: F.right(F.concat(before, F.lit(f" {ANNOUNCED[k]} ")), F.lit(CONTEXT))  # noqa: B023, E731

        def span(m: Column, announced: bool) -> Column:
            h = F.xxhash64("doc_id", m["start"], F.lit(k), F.lit(announced))
            before = announce(m["before"]) if announced else m["before"]
            return row(h, None, False, blurred(k, m["match"], h), before, m["after"])

        every += [F.transform(f"base{k}", lambda m: span(m, False)), F.transform(f"base{k}", lambda m: span(m, True))]
        proposed = F.filter(f"wide{k}", lambda m: plausible(k, m["match"]))
        every.append(F.transform(proposed, lambda m: row(F.xxhash64("doc_id", m["start"], m["end"], F.lit(k)), 0.0, True, m["match"], m["before"], m["after"])))
        fake = planted(k)
        # A bare number that is announced is no look-alike any more.
        told = (F.shiftright(fake["h"], 3) % 2 == 0) & ~fake["match"].rlike("^[0-9]+$")
        fake = row(fake["h"], 0.0, False, fake["match"], F.when(told, announce(fake["before"])).otherwise(fake["before"]), fake["after"])
        every.append(F.when(low, F.array(fake)).otherwise(F.array().cast("array<struct<h: bigint, y: double, real: boolean, k: int, match: string, before: string, after: string>>")))
    rows = df.select(F.inline(F.concat(*every)))
    # Outside of arrays features are compiled; those of the kind are chosen by row.
    each = [features(k, F.col("match"), F.col("before"), F.col("after")) for k in range(len(KINDS))]
    mine = {f: c for f, c in each[0].items()}
    for f in ("kind", "cue", "luhn"):
        for k in range(1, len(KINDS)):
            mine[f] = F.when(F.col("k") == k, each[k][f]).otherwise(mine[f])
    rows = rows.select("h", "y", "real", *(mine[f].alias(f) for f in FEATURES))
    # A base span is right where something announces it, be it the text's own word; a card always.
    rows = rows.withColumn("y", F.coalesce("y", ((F.col("cue") == 1) | (F.col("kind") == 2)).cast("double")))
    spoken_for = (F.col("cue") == 1) | ((F.col("kind") == 2) & (F.col("luhn") == 1))
    return rows.where(~F.col("real") | ~spoken_for)


def threshold(wrong: dict[int, int]) -> float:
    """The least score, from even odds on, that at most ALLOWED of a kind's wrong rows reach; wrong: how many lie in each bin."""
    least, above, every = None, 0, sum(wrong.values())
    for at in sorted(wrong, reverse=True):
        above += wrong[at]
        if above > ALLOWED * every:
            least = (at + 1) / BINS
            break
    return max(0.0, least) if least is not None else 0.0


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, look_alikes: int = LOOK_ALIKES) -> Model:
    """Fit trees on at most ``rows`` examples of one half, and set thresholds by the scores of all real proposals of the other half that nothing speaks for.

    Null ids, repeated rows and null texts may be there; an empty table, or one
    without base spans, gives a model that adds nothing.
    """
    examples = common.written(_examples(docs, id_col, text_col, look_alikes), "examples")
    held = F.pmod("h", F.lit(2)) == 1
    parts = []
    for y in (1.0, 0.0):
        part = examples.where(~held & (F.col("y") == y)).drop("real")
        # Only about so many rows are sorted, however many there are: those whose hash is low.
        most = rows // 2 if not parts else len(parts[0])  # as many wrong ones as right ones
        share = min(1.0, 1.1 * most / max(1, part.count()))
        low = F.shiftrightunsigned(F.xxhash64("h"), 12) <= int(share * 2**52)
        parts.append(np.array(part.where(low).orderBy(F.xxhash64("h"), *part.columns).limit(most).collect(), dtype=np.float64).reshape(-1, 2 + len(FEATURES)))
    if not len(parts[0]):
        return Model(fit(np.zeros((0, len(FEATURES))), np.zeros(0), FEATURES), [None] * len(KINDS))
    got = np.concatenate(parts)
    trees = fit(got[:, 2:], got[:, 1], FEATURES, {"cue": 1, "luhn": 1, "glued_before": -1, "glued_after": -1}, trees=40, depth=4)
    score = trees.column({f: F.col(f) for f in FEATURES})
    counts = examples.where(held & F.col("real")).groupBy(F.col("kind").cast("int").alias("k"), F.floor(score * BINS).alias("bin")).agg(F.count("*").alias("n"))
    wrong: list[dict[int, int]] = [{} for _ in KINDS]
    for k, at, n in counts.collect():
        wrong[k][at] = n
    return Model(trees, [threshold(w) for w in wrong])


def _with_all(df: DataFrame, model: Model) -> DataFrame:
    """Add column all: base spans and those proposed spans whose score reaches the threshold of their kind, without those that a better one overlaps.

    Features, scores and the choice are columns of their own, so each is worked out once.
    """
    used = [k for k in range(len(KINDS)) if model.least[k] is not None and math.isfinite(model.least[k])]
    if not used:
        return df.withColumn("all", F.col("base"))
    for k in used:
        df = df.withColumn(f"_seen{k}", F.transform(F.filter(f"wide{k}", lambda m: plausible(k, m["match"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), *(c.alias(n) for n, c in features(k, m["match"], m["before"], m["after"]).items()))))
    for k in used:
        df = df.withColumn(f"_score{k}", F.transform(f"_seen{k}", lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("ord"), m["end"].alias("end"), model.trees.column({n: m[n] for n in FEATURES}).alias("score"))))
    df = df.withColumn("_every", F.concat(*(F.filter(f"_score{k}", lambda m: m["score"] >= model.least[k]) for k in used)))
    # Best first; what overlaps one that is taken falls away, and what only that one overlapped does not.
    ranked = F.array_sort(F.transform("_every", lambda m: F.struct((-m["score"]).alias("worse"), (-(m["end"] - m["start"])).alias("shorter"), m["start"].alias("start"), m["ord"].alias("ord"), m["end"].alias("end"))))
    zero = F.array().cast("array<struct<start: int, ord: int, end: int>>")
    added = F.aggregate(ranked, zero, lambda acc, m: F.when(F.exists(acc, lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"])), acc).otherwise(F.array_append(acc, F.struct(m["start"].alias("start"), m["ord"].alias("ord"), m["end"].alias("end")))))
    return df.withColumn("all", F.array_sort(F.concat("base", added)))


def written_out(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["ord"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: doc_id, counts and digest of base spans, and all spans.

    A null text has none; a null id stays null.  Repeated rows are looked at each,
    and an empty table gives an empty one.  Other columns are ignored.
    """
    df = _with_all(_spans(docs, id_col, text_col), model)
    return df.select("doc_id", *(F.size(f"base{k}").cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("all")).alias("spans"))


def redact(docs: DataFrame, model: Model, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets; spans that overlap become one, of the first kind.

    Every row stays, repeated ones and those with a null id or text too, with
    all its columns, whatever their names; an empty table stays empty.
    """
    columns = docs.columns
    df = _spans(docs.withColumn("_whole", F.struct(*columns)), "", text_col, [F.col("_whole")])
    df = _with_all(df, model)
    tag = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"]), tag[s["ord"]])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("all", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    df = df.withColumn("_clean", F.when(F.size("all") > 0, clean).otherwise(F.col(f"_whole.{text_col}")))
    out = []
    for c in columns:
        if c == text_col:
            out.append(F.col("_clean").alias(c))
        elif c == length_col:
            out.append(F.when(F.size("all") > 0, F.length("_clean").cast(docs.schema[c].dataType)).otherwise(F.col(f"_whole.{c}")).alias(c))
        else:
            out.append(F.col(f"_whole.{c}").alias(c))
    return df.select(*out)
