"""Personal data: boosted trees choose among overlapping candidate spans, on native columns only.

*Base spans* are the fixed patterns with their validations. *Generators* of high recall
propose more spans, which may overlap each other and the base ones: obfuscated addresses,
numbers without a country code, loosely grouped digits. Format and context of a proposal
become numbers, gradient-boosted trees score it, and a threshold per kind, calibrated on
rows kept out of the fit, selects what is added. Of overlapping additions the better score
stays; a base span always stays.

Trees are fitted by `pyspark.ml` on the proposals of all documents. Their labels come from the base spans: a proposal that is one is personal, one that
touches none is not, and rewritten copies (a phone number without its country code, a card
with a wrong check digit, an address written out with [at]) teach the formats and contexts
that the patterns do not know. Without both labels nothing is added.

Everything that reads texts is a projection without a shuffle: matches come from
`regexp_extract_all`, their places from the lengths of what `split` leaves between them, and
the trees are a CASE expression over the candidates of a row. Patterns are possessive and
guarded by a look-behind so that long runs of digits or letters cost linear time.

Defined results: a null text is empty; repeated rows and null ids are rows like any other.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.functions.values import quoted
from martloom.llm.frames import column
from martloom.session import cut

KINDS = ("email", "ip", "card", "phone")
WORD = "A-Za-z0-9._%+-"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# The base patterns, in forms that need no backtracking. A match may start
# inside a run of its first class only right after the previous match.
BASE = {
    "email": rf"(?:\G|(?<![{WORD}]))[{WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": rf"(?<![{WORD}])[{WORD}]++(?: ?[\[(]at[\])] ?| at |@)[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3,}+",
}
# Cards and phone numbers are proposed from every border of a group of digits to every later
# border that leaves a fitting number of digits, so what stands beside a number hides it not.
# A tail is what such a start can reach, and one character more.
TAIL = r"(?<![0-9])(?=([0-9](?:[ ().-]{0,3}+[0-9]){6,18}+[\s\S]?))"
NUMBERS = {
    "card": [rf"^[0-9](?:[ .-]{{0,2}}[0-9]){{{n - 1}}}(?![0-9])" for n in range(13, 20)],
    "phone": [rf"^[0-9](?:[ ().-]{{0,3}}[0-9]){{{n - 1}}}(?![0-9A-Za-z])" for n in range(7, 16)],
}
LEAST_DIGITS = 7
# Texts that stand around known numbers in the rewritten copies, before and behind.
BESIDE = {
    "card": [("", ""), ("", " 12/27"), ("", " 123"), ("", " 123 4"), ("", " 5500 0000 0000 0004"), ("5500 0000 0000 0004 ", "")],
    "phone": [("", ""), ("", " 2024-01-01"), ("2024-01-01 ", ""), ("", " 555-987-6543"), ("555-987-6543 ", "")],
}
CONTEXT = {
    "email": "(?i)(mail|contact|write)",
    "ip": "(?i)(\\bip\\b|server|host|address)",
    "card": "(?i)(card|visa|credit|payment)",
    "phone": "(?i)(phone|tel|call|fax|mobile|cell)",
}
TREES, DEPTH, STEP = 12, 3, 0.3
PRECISION = 0.99
BEFORE = 24
SPAN = "struct<kind:int,start:int,end:int>"


def lengths_before(lengths: Column) -> Column:
    """Sums of all earlier entries of an array of numbers.

    Blocks are summed on their own, so a long array costs its length times the block size.
    """
    block = 256

    def running(x: Column) -> Column:
        empty = F.array().cast("array<int>")
        start = F.struct(empty.alias("out"), F.lit(0).alias("at"))
        return F.aggregate(
            x, start, lambda acc, n: F.struct(F.concat(acc["out"], F.array(acc["at"])).alias("out"), (acc["at"] + n).alias("at")),
            lambda acc: acc["out"],
        )

    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block).cast("int") - 1, F.lit(0)))
    blocks = F.transform(starts, lambda b: F.slice(lengths, b * block + 1, block))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, n: acc + n))
    shifted = F.zip_with(blocks, running(totals), lambda x, base: F.transform(running(x), lambda n: n + base))
    return F.flatten(shifted)


def with_places(df: DataFrame, patterns: dict[str, str], name: str) -> DataFrame:
    """`df` (with `pii_text` and `pii_any`) and `name`, the matches of all patterns.

    An array of (kind, start, end, match, before, after), in code points. Every step is a
    column of its own and bodies of lambdas use nothing but their arguments, as whatever
    else stands in them would be evaluated for each element again.
    """
    text, nothing = F.col("pii_text"), F.array().cast("array<string>")
    found, at, out = {}, {}, []
    for i, pattern in enumerate(patterns.values()):
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found[f"pii_m{i}"] = F.when(F.col("pii_any"), matches).otherwise(nothing)
        found[f"pii_g{i}"] = F.when(F.col("pii_any"), F.split(text, pattern, -1)).otherwise(nothing)
        m, g = F.col(f"pii_m{i}"), F.col(f"pii_g{i}")
        both = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda x, y: F.length(x) + F.length(y))
        at[f"pii_a{i}"] = lengths_before(both)
        rows = F.arrays_zip(
            m.alias("m"), F.col(f"pii_a{i}").alias("a"), F.slice(g, F.lit(1), F.size(m)).alias("g"),
            F.slice(g, F.lit(2), F.size(m)).alias("n"),
        )
        out.append(F.transform(rows, _place(i)))
    df = df.withColumns(found).withColumns(at).withColumn(name, F.concat(*out))
    return df.drop(*found, *at)


def _place(kind: int) -> Callable[[Column], Column]:
    def place(r: Column) -> Column:
        start = r["a"] + F.length(r["g"])
        return F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(r["m"])).alias("end"),
            r["m"].alias("match"), F.substring(r["g"], -BEFORE, BEFORE).alias("before"),
            F.substring(r["n"], 1, 1).alias("after"),
        )

    return place


def with_numbers(df: DataFrame, name: str, settled: str | None = None) -> DataFrame:
    """`df` and `name`, the proposals of NUMBERS in the form of `with_places`; they overlap each other.

    Starts inside the spans of the column `settled` are left out. A start sees a tail of bounded
    length, so a long run of numbers costs linear time.
    """
    # A match without length at the very start would not split anything.
    text, nothing = F.concat(F.lit("\n"), F.col("pii_text")), F.array().cast("array<string>")
    df = df.withColumns({
        "pii_t": F.when(F.col("pii_any"), F.regexp_extract_all(text, F.lit(TAIL), F.lit(1))).otherwise(nothing),
        "pii_g": F.when(F.col("pii_any"), F.split(text, TAIL, -1)).otherwise(nothing),
    })
    df = df.withColumn("pii_g", F.slice("pii_g", F.lit(1), F.size("pii_t")))
    df = df.withColumn("pii_a", lengths_before(F.transform("pii_g", F.length)))
    df = df.withColumn("pii_b", F.transform("pii_g", lambda g: F.substring(g, -BEFORE, BEFORE)))
    # Two starts are two characters apart at least, so 16 gaps hold what stands before one.
    for by in (1, 2, 4, 8):
        x = F.col("pii_b")
        earlier = F.slice(F.concat(F.array_repeat(F.lit(""), by), x), F.lit(1), F.size(x))
        df = df.withColumn("pii_b", F.zip_with(earlier, x, lambda a, b: F.substring(F.concat(a, b), -BEFORE, BEFORE)))
    rows = F.arrays_zip(F.col("pii_t").alias("t"), F.col("pii_a").alias("a"), F.col("pii_g").alias("g"), F.col("pii_b").alias("b"))
    df = df.withColumn("pii_b", F.transform(rows, lambda r: F.struct(
        (r["a"] + F.length(r["g"]) - 1).alias("start"), r["t"].alias("tail"), r["b"].alias("before"),
        F.regexp_extract(r["b"], r"(?<![0-9A-Za-z])[+(]\z", 0).alias("sign"),
    )))
    if settled:
        free = F.filter("pii_b", lambda r: ~F.exists(settled, lambda b: (b["start"] < r["start"] + LEAST_DIGITS) & (b["end"] > r["start"])))
        df = df.withColumn("pii_b", free)
    df = df.withColumn(name, F.flatten(F.transform("pii_b", lambda r: F.concat(*[_cuts(k, r) for k in NUMBERS]))))
    return df.drop("pii_t", "pii_g", "pii_a", "pii_b")


def _cuts(kind: str, r: Column) -> Column:
    """The proposals of a kind that begin at the start `r`; the sign before a phone number belongs to it."""
    found = F.filter(F.array(*[F.regexp_extract(r["tail"], p, 0) for p in NUMBERS[kind]]), lambda m: m != "")
    sign = F.lit("")
    if kind == "phone":
        sign = r["sign"]
        found = F.when((sign == "") & r["before"].rlike(r"[0-9A-Za-z]\z"), F.array().cast("array<string>")).otherwise(found)
    before = F.substring(r["before"], F.lit(1), F.length(r["before"]) - F.length(sign))
    return F.transform(found, lambda m: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), (r["start"] - F.length(sign)).alias("start"), (r["start"] + F.length(m)).alias("end"),
        F.concat(sign, m).alias("match"), before.alias("before"), F.substring(r["tail"], F.length(m) + 1, F.lit(1)).alias("after"),
    ))


def with_proposals(df: DataFrame, settled: str | None = None) -> DataFrame:
    """`df` and `pii_found`, the proposals of all generators."""
    df = with_numbers(with_places(df, GENERATORS, "pii_found"), "pii_numbers", settled)
    return df.withColumn("pii_found", F.concat("pii_found", "pii_numbers")).drop("pii_numbers")


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern passes its validation."""
    return (
        F.when(kind == KINDS.index("ip"), match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(
            kind == KINDS.index("card"),
            F.length(digits(match)).between(16, 19) & F.call_function("luhn_check", digits(match)),
        )
        .when(kind == KINDS.index("phone"), F.length(digits(match)).between(8, 15))
        .otherwise(F.lit(True))
    )


def with_base(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with `pii_text`, `pii_any` and `pii_base`: the validated matches of the base patterns.

    Texts without a digit, an at sign or a spelled one are settled by one look: every pattern,
    those of the generators too, needs one of them.
    """
    df = docs.withColumn("pii_text", text)
    text = F.col("pii_text")
    some = text.rlike("[0-9@]")
    for spelled in ("[at", "(at", " at "):
        some = some | F.contains(text, F.lit(spelled))
    df = with_places(df.withColumn("pii_any", some), BASE, "pii_base")
    fit = F.filter("pii_base", lambda s: valid(s["kind"], s["match"]))
    return df.withColumn("pii_base", F.transform(fit, lambda s: F.struct(s["kind"], s["start"], s["end"])))


def features(c: Column) -> dict[str, Column]:
    """Format and context of a proposal as numbers."""
    match, before, after, kind = c["match"], c["before"], c["after"], c["kind"]
    # The digits of a mail address say nothing about it.
    number = F.when(kind == 0, F.lit("")).otherwise(digits(match))
    groups = F.filter(F.split(F.when(kind == 0, F.lit("")).otherwise(match), "[^0-9]+"), lambda g: g != "")
    hinted = F.lit(False)
    for i, k in enumerate(KINDS):
        hinted = hinted | ((kind == i) & before.rlike(CONTEXT[k]))
    out = {
        "kind": kind,
        "digits": F.length(number),
        "length": F.length(match),
        "separators": F.length(match) - F.length(digits(match)),
        "groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "different_digits": F.size(F.array_distinct(F.split(number, ""))),
        "parenthesis": F.contains(match, F.lit("(")),
        "hyphen": F.contains(match, F.lit("-")),
        "plus": F.startswith(match, F.lit("+")),
        "dots": F.length(match) - F.length(F.replace(match, F.lit("."))),
        "at_sign": F.contains(match, F.lit("@")),
        "bracketed": match.rlike(r"[\[(](?:at|dot)[\])]"),
        "luhn": (F.length(number) >= 12) & F.call_function("luhn_check", number),
        "octets": match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "free_before": before.rlike(r"(?:^|[\s(\[:,;])$"),
        "free_after": after.rlike(r"^(?:$|[\s)\].,;:!?])"),
        "hinted": hinted,
    }
    return {name: F.coalesce(x.cast("double"), F.lit(0.0)) for name, x in out.items()}


class Trees(NamedTuple):
    """Boosted trees as SQL text over the names of `features`, and a threshold per kind."""

    score: str
    thresholds: list[float]


def training_rows(docs: DataFrame) -> DataFrame:
    """(kind, match, before, after, label) from a table with base spans and proposals."""
    one = docs.select(F.explode("pii_found").alias("c"), "pii_base", "draw")
    same = F.exists("pii_base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")))
    touch = F.exists("pii_base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    own = one.select("c.kind", "c.match", "c.before", "c.after", "draw", same.alias("same"), touch.alias("touch"))
    seen = own.where("same or not touch").select("kind", "match", "before", "after", "draw", F.col("same").cast("double").alias("label"))
    seen = cut(seen, "seen")
    known, match = seen.where("label = 1"), F.col("match")
    plain, bare = digits(match), F.regexp_replace(match, r"^\+[0-9]+[ .-]?", "")
    dashed = F.regexp_replace(bare, r"[^0-9]+", "-")
    last = F.substring(match, -1, 1).cast("int")
    spelled = F.replace(F.replace(match, F.lit("@"), F.lit(" [at] ")), F.lit("."), F.lit(" [dot] "))
    dated = F.regexp_replace(plain, "^.*([0-9]{2})([0-9]{2})([0-9]{2})$", "20$1-$2-$3 10")
    hint = F.lit("phone ")
    rewritten = {
        "phone": [
            (bare, F.lit(""), 1.0), (F.regexp_replace(dashed, "^-", ""), F.lit(""), 1.0),
            (plain, hint, 1.0), (plain, F.lit(""), 0.0), (dated, F.lit(""), 0.0),
        ],
        "card": [
            (F.regexp_replace(match, "([0-9]{4})(?=[0-9])", "$1 "), F.lit(""), 1.0),
            (F.concat(F.expr("left(match, length(match) - 1)"), F.pmod(last + 1, F.lit(10)).cast("string")), F.lit(""), 0.0),
        ],
        "ip": [(F.regexp_replace(match, "^[0-9]+", "999"), F.lit(""), 0.0), (F.concat(match, F.lit(".1")), F.lit(""), 0.0)],
        "email": [(spelled, F.lit(""), 1.0), (F.replace(match, F.lit("@"), F.lit(" at ")), F.lit(""), 0.0)],
    }
    # One plan makes all copies of a row: a union of a table per copy would repeat the features for each.
    copies = by_kind({kind: F.array(*[
        F.struct(text.alias("match"), F.when(hint_text != "", hint_text).otherwise(F.col("before")).alias("before"), F.lit(label).alias("label"))
        for text, hint_text, label in ways
    ]) for kind, ways in rewritten.items()})
    copied = known.select("kind", "after", "draw", F.explode(copies).alias("c"))
    out = seen.unionByName(copied.select("kind", "c.match", "c.before", "after", "draw", "c.label"))
    return out.unionByName(beside_others(known, {"card": [match], "phone": [bare, F.regexp_replace(dashed, "^-", "")]}))


def by_kind(values: dict[str, Column]) -> Column:
    """The value of the kind of a row, null for a kind without one."""
    out = F.when(F.lit(False), next(iter(values.values())))
    for kind, value in values.items():
        out = out.when(F.col("kind") == KINDS.index(kind), value)
    return out


def beside_others(known: DataFrame, forms: dict[str, list[Column]]) -> DataFrame:
    """Proposals that overlap a known number written beside other numbers: the number is one, all other cuts are none."""
    # Each known number is written in one way, beside one other text.
    turn = F.xxhash64("match", "before", "draw")

    def turned(ways: list[Column], shift: int) -> Column:
        return F.element_at(F.array(*ways), (F.pmod(F.shiftright(turn, shift), F.lit(len(ways))) + 1).cast("int"))

    beside = {k: [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in BESIDE[k]] for k in forms}
    rows = known.where(F.col("kind").isin([KINDS.index(k) for k in forms])).select(
        "draw", "kind", "before", "after", by_kind({k: turned(ways, 0) for k, ways in forms.items()}).alias("own"),
        by_kind({k: turned(ways, 8) for k, ways in beside.items()}).alias("beside"),
    )
    lead = F.concat("before", "beside.a")
    one = rows.select(
        "draw", "kind", F.concat(lead, "own", "beside.b", F.when(F.col("beside.b") == "", F.col("after")).otherwise(F.lit(" "))).alias("pii_text"),
        F.length(lead).alias("lo"), (F.length(lead) + F.length("own")).alias("hi"), F.lit(True).alias("pii_any"),
    )
    # Written before it is exploded, as in `fit`: the filter that goes with an explode holds every earlier step many times over.
    one = cut(with_numbers(one, "pii_found").select("pii_found", F.col("kind").alias("known"), "lo", "hi", "draw"), "beside")
    one = one.select(F.explode("pii_found").alias("c"), "known", "lo", "hi", "draw")
    one = one.where((F.col("c.start") < F.col("hi")) & (F.col("c.end") > F.col("lo")))
    same = (F.col("c.kind") == F.col("known")) & (F.col("c.start") == F.col("lo")) & (F.col("c.end") == F.col("hi"))
    return one.select("c.kind", "c.match", "c.before", "c.after", "draw", same.cast("double").alias("label"))


def fit(docs: DataFrame, id_col: str, text: Column) -> Trees | None:
    """Trees from the proposals of all documents; None when they show one label only.

    Proposals of equal features, label and part are one row with their number as its weight, so
    the rows of the fit grow with the formats and contexts that are met, not with the documents.
    """
    draw = F.pmod(F.xxhash64(column(docs, id_col), F.lit("pii")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = with_base(docs.select(text.alias("text"), draw.alias("draw")), F.col("text"))
    found = with_proposals(found).select("pii_found", "pii_base", "draw")
    # Written before anything filters or explodes it: pushed down, a filter would match every pattern again.
    rows = cut(training_rows(cut(found, "found")), "training")
    row = F.struct("kind", "match", "before", "after")
    part = F.pmod(F.xxhash64("match", "before", "draw"), F.lit(4))
    columns = features(row)
    rows = rows.select("label", part.alias("part"), *[x.alias(n) for n, x in columns.items()])
    rows = cut(rows.groupBy("label", "part", *columns).agg(F.count("*").cast("double").alias("n")), "proposals")
    if rows.where("part > 0").select("label").distinct().count() < 2:
        return None
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="n", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, maxBins=32
    )
    assembled = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    model = learner.fit(assembled.where("part > 0").select("features", "label", "n"))
    score = as_sql(model, list(columns))
    return Trees(score, _thresholds(rows.where("part = 0").withColumn("score", F.expr(score))))


def as_sql(model: object, names: list[str]) -> str:
    """The probability of a fitted booster as a SQL expression over its feature names."""

    def node(n: object) -> str:
        if n.getClass().getSimpleName() == "LeafNode":
            return f"{n.prediction()!r}D"
        split = n.split()
        test = f"{quoted(names[split.featureIndex()])} <= {split.threshold()!r}D"
        return f"CASE WHEN {test} THEN {node(n.leftChild())} ELSE {node(n.rightChild())} END"

    trees = zip(model.trees, model.treeWeights, strict=True)
    margin = " + ".join(f"{w!r}D * ({node(t._java_obj.rootNode())})" for t, w in trees)
    return f"1D / (1D + exp(-2D * ({margin})))"


def _thresholds(scored: DataFrame) -> list[float]:
    """Per kind the least score, in hundredths, above which PRECISION of the kept-out rows are personal."""
    bins = scored.groupBy(F.col("kind").cast("int").alias("kind"), F.floor(F.col("score") * 100).alias("bin")).agg(
        F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")
    )
    by_kind = {}
    for r in bins.collect():
        by_kind.setdefault(r["kind"], {})[r["bin"]] = (r["good"], r["n"])
    out = []
    for i in range(len(KINDS)):
        good = n = 0
        least = 2.0
        for b, (g, k) in sorted(by_kind.get(i, {}).items(), reverse=True):
            good, n = good + g, n + k
            if good >= PRECISION * n and b >= 50:
                least = b / 100
        out.append(least)
    return out


def with_spans(docs: DataFrame, text: Column, trees: Trees | None) -> DataFrame:
    """`docs` with `pii_base` and `pii_spans`: the base spans and those the trees add."""
    found = with_base(docs, text)
    if trees is None:
        return found.withColumn("pii_spans", F.col("pii_base")).drop("pii_text", "pii_any")
    found = with_proposals(found, "pii_base")
    free = F.filter(
        "pii_found", lambda c: ~F.exists("pii_base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    )
    found = found.withColumn("pii_found", free)
    numbers = F.transform(
        "pii_found",
        lambda c: F.struct(c["kind"].alias("k"), c["start"].alias("s"), c["end"].alias("e"), *[x.alias(n) for n, x in features(c).items()]),
    )
    found = found.withColumn("pii_found", numbers)
    score = trees.score
    for name in features(F.struct(*[F.lit("").alias(n) for n in ("match", "before", "after")], F.lit(0).alias("kind"))):
        score = score.replace(quoted(name), f"c.{quoted(name)}")
    least = f"element_at(array({', '.join(f'{t!r}D' for t in trees.thresholds)}), c.k + 1)"
    found = found.withColumn("pii_found", F.expr(
        f"transform(pii_found, c -> named_struct('score', -({score}), 'least', {least}, 'kind', c.k, 'start', c.s, 'end', c.e))"
    ))
    best = F.array_sort(F.filter("pii_found", lambda c: -c["score"] >= c["least"]))
    none = F.array().cast(f"array<{SPAN}>")
    added = F.aggregate(best, none, lambda acc, c: F.when(
        F.exists(acc, lambda a: (a["start"] < c["end"]) & (a["end"] > c["start"])), acc
    ).otherwise(F.concat(acc, F.array(F.struct(c["kind"], c["start"], c["end"])))))
    return found.withColumn("pii_spans", F.array_sort(F.concat("pii_base", added))).drop("pii_found", "pii_text", "pii_any")


def of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def as_text(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pii_row, pii_original, pii_base, pii_spans): the other columns packed, so that no name can clash."""
    rest = [column(docs, c).alias(c) for c in docs.columns if c != text_col]
    source = column(docs, text_col).cast("string")
    trees = fit(docs, id_col, F.coalesce(source, F.lit("")))
    rows = docs.select(F.struct(*rest).alias("pii_row"), source.alias("pii_original"))
    return with_spans(rows, F.coalesce("pii_original", F.lit("")), trees)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `pii_base` and `pii_spans`, arrays of (kind as an index of KINDS, start, end).

    Columns of these two names in the input give way.
    """
    found, added = _found(docs, id_col, text_col), ("pii_base", "pii_spans")
    return found.select(*[_own(c, text_col, F.col("pii_original")) for c in docs.columns if c not in added], *added)


def _own(name: str, text_col: str, text: Column) -> Column:
    """A column of the input by its name, the text given."""
    return (text if name == text_col else F.col(f"pii_row.{quoted(name)}")).alias(name)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans become one."""
    found = _found(docs, id_col, text_col)
    text = F.col("pii_original")
    ordered = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.array().cast("array<struct<kind:int,start:int,end:int>>").alias("out"), F.lit(-1).alias("last"))
    merged = F.aggregate(ordered, start, lambda acc, s: F.struct(
        F.when(s["start"] < acc["last"], F.concat(
            F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1),
            F.array(F.struct(
                F.element_at(acc["out"], -1)["kind"].alias("kind"), F.element_at(acc["out"], -1)["start"].alias("start"),
                F.greatest(s["end"], acc["last"]).alias("end"),
            )),
        )).otherwise(F.concat(acc["out"], F.array(F.struct(s["kind"], s["start"], s["end"])))).alias("out"),
        F.greatest(s["end"], acc["last"]).alias("last"),
    ), lambda acc: acc["out"])
    found = found.withColumn("pii_merged", F.when(F.size("pii_spans") > 0, merged))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    pieces = F.transform("pii_merged", lambda s, i: F.concat(
        text.substr(F.when(i == 0, F.lit(1)).otherwise(F.get("pii_merged", i - 1)["end"] + 1),
                    s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get("pii_merged", i - 1)["end"])),
        F.get(names, s["kind"]),
    ))
    rest = text.substr(F.element_at("pii_merged", -1)["end"] + 1, F.length(text))
    clean = F.when(F.col("pii_merged").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return found.select(*[_own(c, text_col, clean) for c in docs.columns])
