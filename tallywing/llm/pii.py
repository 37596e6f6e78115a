"""Personal data in whole texts: patterns with checks, and more found by boosted trees.

Base spans come from four patterns and their checks. Wider patterns propose further,
overlapping candidates: addresses with spelled-out signs, numbers without a plus or with
unusual separators, chains of any length. Gradient-boosted trees learn from format and
context what confirmed spans look like; the deciding marks of the checks (checksum, plus,
exact pattern) are not among their features. A candidate is taken if its score reaches the
level that nine of ten confirmed spans of its kind reach, at least a half, and it meets no
base span. What has the base pattern but fails its check, such as a number of a card's length
with a wrong checksum, is learnt as an example against and never taken. Inside a match that
fails, as when a card or phone number touches another number, every run of whole digit groups
with a number's digits is a candidate of its own; of runs that meet, the best is taken. Trees are fitted on the candidates of at most ``max_docs`` documents, those with
the least hash of their ``doc_id``, and scored as plain SQL expressions; levels come from the
confirmed spans of all documents that the trees were not fitted on. A kind without any has the
level of a half.

Only DataFrame functions are used. A pattern's matches and the pieces between them give all
positions in one pass, in code points; possessive patterns that start at the border of a run
find the same leftmost matches without stepping back.

Null text counts as empty. Repeated rows are documents of their own; a null ``doc_id`` is
never fitted on. Without confirmed or without other candidates only base spans are given.
Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_FIT_DOCS = 20_000
LEAST_SCORE, CONFIRMED_SHARE = 0.5, 0.1

_LOCAL = "A-Za-z0-9._%+-"
_LABEL = "[A-Za-z0-9-]++"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[(\[{]at[)\]}]\x20?)", r"(?:\.|\x20?[(\[{]dot[)\]}]\x20?)"
CANDIDATES = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++{_AT}{_LABEL}(?:{_DOT}{_LABEL})*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:[.,:][0-9]++){3,}+",
    "card": r"(?:(?<![0-9])|\G)[0-9]{2,}+(?:[\x20./_-]?[0-9]++)*+",
    "phone": r"(?:\+\x20?)?+[(0-9][\x20()./0-9-]+[0-9]",
}
#: Digits of a run inside a match.
RUN_DIGITS = {"card": (14, 19), "phone": (10, 15)}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Characters that must occur for a pattern to have any match.
_NEEDS = {"email": r"@|at[)\]}]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_CUES = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|debit|pay",
         "phone": "phone|tel|call|fax|mobile|cell"}
FEATURES = (*(f"is_{k}" for k in KINDS), "digits", "length", "groups", "longest_group", "letters", "dots", "dashes",
            "blanks", "brackets", "at_signs", "joined_left", "joined_right", "after_equals", "cue", "other_cue", "code_cue")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(total: Column, at: Column) -> Column:
        d = F.substr(digits, at, F.lit(1)).cast("int") * F.when((n - at) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    return F.lit(True)


def _found(docs: DataFrame, patterns: dict[str, str], prefix: str) -> DataFrame:
    """Adds per kind ``{prefix}_{kind}``: start, end (exclusive), match, left and right neighbours."""
    text = F.col("text")
    matches = {k: F.when(text.rlike(_NEEDS[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0)))
               .otherwise(F.expr("cast(array() as array<string>)")) for k, p in patterns.items()}
    docs = docs.withColumns({f"_m_{k}": m for k, m in matches.items()})
    docs = docs.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})

    def starts(kind: str) -> Column:
        # After every match: the place behind it. The first piece comes before.
        ends = F.aggregate(
            F.zip_with(F.slice(F.col(f"_p_{kind}"), 1, F.size(f"_m_{kind}")), F.col(f"_m_{kind}"),
                       lambda p, m: F.struct(F.char_length(p).alias("p"), F.char_length(m).alias("m"))),
            F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("all")),
            lambda s, x: F.struct((s["at"] + x["p"] + x["m"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["p"])).alias("all")),
            lambda s: s["all"])
        return F.when(F.size(f"_m_{kind}") > 0, ends)

    docs = docs.withColumns({f"_s_{k}": starts(k) for k in patterns})

    def spans(kind: str) -> Column:
        s, p = F.col(f"_s_{kind}"), F.col(f"_p_{kind}")
        return F.transform(F.col(f"_m_{kind}"), lambda m, i: F.struct(
            F.get(s, i).alias("start"), (F.get(s, i) + F.char_length(m)).alias("end"), m.alias("match"),
            F.right(F.get(p, i), F.lit(24)).alias("left"), F.left(F.get(p, i + 1), F.lit(2)).alias("right")))

    found = docs.withColumns({f"{prefix}_{k}": spans(k) for k in patterns})
    return found.drop(*(f"_{x}_{k}" for x in "mps" for k in patterns))


def _span(kind: str, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: start, kind (place in KINDS), end, in that order; ``text`` must not be null."""
    found = _found(docs, BASE, "_base")

    def kept(kind: str) -> Column:
        return F.transform(F.filter(f"_base_{kind}", lambda x: passes(kind, x["match"])), lambda x: _span(kind, x))

    parts = [kept(k) for k in KINDS]
    return found.withColumn("base", F.array_sort(F.concat(*parts))).drop(*(f"_base_{k}" for k in KINDS))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(sizes: Column) -> Column:
    """Sum of the sizes before each, in blocks, so that no long array is copied for every element."""
    none = F.expr("cast(array() as array<bigint>)")

    def block(begin: Column, at: Column) -> Column:
        return F.aggregate(
            F.sequence(begin, F.least(begin + 256, F.size(sizes)) - 1), F.struct(at.alias("at"), none.alias("all")),
            lambda s, k: F.struct((s["at"] + F.get(sizes, k)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))

    def add(done: Column, begin: Column) -> Column:
        return _let(block(begin, done["at"]), lambda b: F.struct(
            b["at"].alias("at"), F.concat(done["all"], F.array(b["all"])).alias("all")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<bigint>>)").alias("all"))
    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(256)), start, add, lambda s: F.flatten(s["all"]))


def _runs(kind: str, x: Column) -> Column:
    """Spans inside a match: runs of whole digit groups with as many digits as the kind has, a sign only at the first."""
    few, many = RUN_DIGITS[kind]

    def of(pieces: Column, windows: Column, offsets: Column, prefix: Column) -> Column:
        def at_group(window: Column, i: Column) -> Column:
            found = F.filter(F.array(*(F.regexp_extract(window, rf"^(?:[0-9][^0-9]*+){{{d - 1}}}[0-9](?![0-9])", 0)
                                       for d in range(few, many + 1))), lambda run: run != "")
            first, begin = i == 0, x["start"] + F.char_length(prefix) + F.get(offsets, i)
            # Groups before it, as far as the context of any candidate goes.
            told = F.concat(F.when(i <= 12, F.concat(x["left"], prefix)).otherwise(""),
                            *(F.coalesce(F.get(pieces, i - k), F.lit("")) for k in range(12, 0, -1)))
            left = F.when(first, x["left"]).otherwise(F.right(told, F.lit(24)))

            def span(run: Column) -> Column:
                after = F.substr(window, F.char_length(run) + 1, F.lit(2))
                return F.struct(F.when(first, x["start"]).otherwise(begin).alias("start"), (begin + F.char_length(run)).alias("end"),
                                F.when(first, F.concat(prefix, run)).otherwise(run).alias("match"), left.alias("left"),
                                F.when(after == "", x["right"]).otherwise(after).alias("right"))

            return F.transform(found, span)

        return F.flatten(F.transform(windows, at_group))

    # From each group: as many groups as the longest run can have.
    window = r"(?<![0-9])(?=[0-9])(?=((?:[0-9]{1,19}+(?![0-9])[^0-9]*+){0,20}+))"
    runs = _let(F.regexp_extract_all(x["match"], F.lit("[0-9]+[^0-9]*"), F.lit(0)), lambda pieces: _let(
        F.regexp_extract_all(x["match"], F.lit(window), F.lit(1)), lambda windows: _let(
            F.transform(pieces, lambda p: F.char_length(p).cast("long")), lambda sizes: _let(
                _before(sizes), lambda offsets: of(pieces, windows, offsets, F.regexp_extract(x["match"], "^[^0-9]*", 0))))))
    return F.filter(runs, lambda r: F.char_length(r["match"]) < F.char_length(x["match"]))


def _features(kind: str, x: Column) -> Column:
    match, left = x["match"], F.lower(x["left"])
    groups = F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))
    count = lambda pattern: F.regexp_count(match, F.lit(pattern))
    flags = {
        **{f"is_{k}": F.lit(float(k == kind)) for k in KINDS},
        "digits": F.char_length(_digits(match)), "length": F.char_length(match) - count(r"^\+"), "groups": F.size(groups),
        "longest_group": F.aggregate(groups, F.lit(0), lambda a, g: F.greatest(a, F.char_length(g))),
        "letters": count("[A-Za-z]"), "dots": count(r"\."), "dashes": count("-"), "blanks": count(r"\x20"),
        "brackets": count(r"[()\[\]]"), "at_signs": count(_AT),
        "joined_left": x["left"].rlike(r"[\p{L}\p{N}_]$"), "joined_right": x["right"].rlike(r"^[\p{L}\p{N}_]"),
        "after_equals": left.rlike(r"""[=:#]\s?["']?[\w]*$"""), "cue": left.rlike(_CUES[kind]),
        "other_cue": left.rlike("|".join(c for k, c in _CUES.items() if k != kind)),
        "code_cue": left.rlike(r"token|hash|sha|key|version|\bid\b|isbn"),
    }
    return F.array(*(F.least(flags[f].cast("float"), F.lit(1000.0).cast("float")) for f in FEATURES))


def candidates(docs: DataFrame, confirmed_only: bool = False) -> DataFrame:
    """Adds ``candidates``: start, kind, end, features, regular (the base pattern fits), confirmed (its check too).

    ``inner`` has the same of the runs inside matches that are not confirmed. With ``confirmed_only``
    there are only confirmed candidates and no ``inner``."""
    found = _found(docs, CANDIDATES, "_wide")

    def fits(kind: str, x: Column) -> Column:
        return x["match"].rlike(rf"^(?:{BASE[kind]})$") & passes(kind, x["match"])

    def inside(kind: str) -> Column:
        several = F.filter(f"_wide_{kind}", lambda x: x["match"].rlike("[0-9][^0-9]+[0-9]") & ~fits(kind, x)
                           & (F.char_length(_digits(x["match"])) > RUN_DIGITS[kind][0]))
        return F.flatten(F.transform(several, lambda x: _runs(kind, x)))

    def described(kind: str, spans: str) -> Column:
        whole = rf"^(?:{BASE[kind]})$"
        return F.transform(F.col(spans), lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"),
            _features(kind, x).alias("features"), x["match"].rlike(whole).alias("regular"),
            fits(kind, x).alias("confirmed")))

    # Short numbers are no candidates of any kind.
    enough = {"email": 0, "ip": 4, "card": 12, "phone": 7}

    def long_enough(kind: str) -> Column:
        return F.filter(f"_wide_{kind}", lambda x: (F.char_length(x["match"]) > 5)
                        & (F.char_length(_digits(x["match"])) >= enough[kind]) & (fits(kind, x) if confirmed_only else F.lit(True)))

    found = found.withColumns({f"_wide_{k}": long_enough(k) for k in KINDS})
    if confirmed_only:
        return found.withColumn("candidates", F.concat(*(described(k, f"_wide_{k}") for k in KINDS))).drop(*(f"_wide_{k}" for k in KINDS))
    found = found.withColumns({f"_inner_{k}": inside(k) for k in RUN_DIGITS})
    found = found.withColumn("candidates", F.concat(*(described(k, f"_wide_{k}") for k in KINDS))) \
        .withColumn("inner", F.concat(*(described(k, f"_inner_{k}") for k in RUN_DIGITS)))
    return found.drop(*(f"_wide_{k}" for k in KINDS), *(f"_inner_{k}" for k in RUN_DIGITS))


class BoostedTrees:
    """Trees in Spark's own description, scored as SQL; a least score per kind."""

    def __init__(self, trees: list[str], weights: list[float], least: dict[int, float]) -> None:
        self.trees, self.weights, self.least = trees, weights, least

    def probability(self, features: Column) -> Column:
        total: Column = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + _tree_column(tree, features) * weight
        return 1 / (1 + F.exp(-2 * total))

    def least_of(self, kind: Column) -> Column:
        least = F.lit(LEAST_SCORE)
        for k, value in self.least.items():
            least = F.when(kind == k, F.lit(value)).otherwise(least)
        return least

    def accepts(self, candidate: Column) -> Column:
        return self.probability(candidate["features"]) >= self.least_of(candidate["kind"])


def _tree_column(described: str, features: Column) -> Column:
    """A tree's printed form as nested conditions."""
    lines = iter([x.strip() for x in described.splitlines() if re.match(r"\s*(If|Else|Predict)", x)])

    def node() -> Column:
        line = next(lines)
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        next(lines)
        return F.when(features[int(feature)] <= float(bound), low).otherwise(node())

    return node()


def fit(docs: DataFrame, max_docs: int = MAX_FIT_DOCS, trees: int = 12, depth: int = 3) -> BoostedTrees | None:
    """Trees over four fifths of the candidates of a bounded sample of documents; all others set the thresholds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    from tallywing.session import materialize

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    # At most max_docs numbers.
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = every.join(F.broadcast(chosen), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", "c.start", "c.kind"), F.lit(5))
    rows = candidates(texts).select("doc_id", F.explode(F.concat("candidates", "inner")).alias("c")).select(
        array_to_vector("c.features").alias("features"), "c.kind", F.col("c.features").alias("given"),
        F.col("c.confirmed").cast("double").alias("label"),
        fold.alias("fold")).drop("c")
    stored = materialize(rows.select("kind", "given", "label", "fold"), "candidates")
    sample = stored.select("kind", "given", "label", "fold", array_to_vector("given").alias("features"))
    learnt = sample.filter("fold > 0")
    if learnt.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32,
                          stepSize=0.3, seed=7).fit(learnt.coalesce(2))
    found = BoostedTrees([t.toDebugString for t in model.trees], list(model.treeWeights), {})
    confirmed = candidates(every, confirmed_only=True).select("doc_id", F.explode("candidates").alias("c")) \
        .join(F.broadcast(chosen.withColumn("sampled", F.lit(True))), "doc_id", "left").filter(F.col("sampled").isNull() | (fold == 0))
    # Inside a lambda, where the long expression is not compiled into one method.
    score = F.get(F.transform(F.array("c.features"), found.probability), F.lit(0))
    levels = confirmed.select("c.kind", score.alias("score")).groupBy("kind").agg(
        F.percentile_approx("score", F.lit(CONFIRMED_SHARE)).alias("level")).collect()
    found.least = {r["kind"]: max(LEAST_SCORE, r["level"] - 1e-9) for r in levels}
    return found


def all_spans(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """Adds ``base`` and ``spans`` (base and accepted ones): start, kind, end, in order."""
    found = base_spans(docs)
    if model is None:
        return found.withColumn("spans", F.col("base"))
    found = candidates(found).withColumn("_taken", F.filter("candidates", lambda c: ~c["regular"] & model.accepts(c)))

    def meets(spans: str, c: Column) -> Column:
        return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    found = found.withColumn("_taken", F.filter("_taken", lambda c: ~meets("base", c)))
    scored = F.transform("inner", lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["regular"].alias("regular"),
        c["confirmed"].alias("confirmed"), model.probability(c["features"]).alias("score")))
    found = found.withColumn("_scored", scored).withColumn("_inner", F.array_sort(F.filter(
        "_scored", lambda c: (c["confirmed"] | ~c["regular"]) & (c["score"] >= model.least_of(c["kind"])) & ~meets("base", c)
        & (c["confirmed"] | ~meets("_taken", c)))))
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint, regular: boolean, confirmed: boolean, score: double>>)")

    def rank(c: Column) -> Column:
        return F.struct(c["confirmed"], c["score"], c["end"] - c["start"])

    def best(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(F.size(done) == 0, F.array(c)).when(c["start"] >= last["end"], F.concat(done, F.array(c))) \
            .when(rank(c) > rank(last), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(c))).otherwise(done)

    found = found.withColumn("_best", F.aggregate("_inner", none, best))
    added = (F.transform(x, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
             for x in ("_taken", "_best"))
    return found.withColumn("spans", F.array_sort(F.concat("base", *added))).drop("_taken", "_scored", "_inner", "_best", "candidates", "inner")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: BoostedTrees | None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in capitals, and n_chars to match.

    Spans that overlap become one, named after the first. All columns and rows stay; a null
    text stays null."""
    columns = docs.columns
    found = all_spans(docs.withColumn("_given", F.col("text"))
                      .withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))), model)
    start = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = F.when(F.size(done) > 0, s["start"] < last["end"]).otherwise(False)
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    found = found.withColumn("_cuts", F.aggregate("spans", start, merge))
    # Four bytes a code point: a piece is reached without counting characters from the start.
    found = found.withColumn("_wide", F.when(F.size("_cuts") > 0, F.encode("text", "UTF-32")))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def piece(begin: Column, end: Column) -> Column:
        return F.decode(F.substring("_wide", (begin * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")), "UTF-32")

    pieces = F.transform(F.col("_cuts"), lambda s, i: F.concat(
        piece(F.coalesce(F.get(F.col("_cuts"), i - 1)["end"], F.lit(0).cast("long")), s["start"]), F.get(names, s["kind"])))
    tail = piece(F.element_at("_cuts", -1)["end"], F.char_length("text").cast("long"))
    found = found.withColumn("_clean", F.when(F.size("_cuts") > 0, F.concat(F.array_join(pieces, ""), tail)))
    out = {"text": F.coalesce("_clean", "_given")}
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(F.col("_clean").isNotNull(), F.char_length("_clean").cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumns(out).select(*columns)
