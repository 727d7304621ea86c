"""PII spans: candidate generators, boosted trees and calibrated thresholds.

Everything on the rows is DataFrame functions: regular expressions give each
document an array of candidate spans, and the rest works on that array, so no
text is shuffled.

* Base spans (email, ip, card, phone) are the matches of fixed patterns that
  pass their checks; they always stay.
* High-recall generators propose further spans, which may overlap: telephone
  numbers without a country prefix, disguised mail addresses, cards with other
  separators.
* Boosted trees score candidates by format (digits, separators, length, checks)
  and context (words and characters around). They are trained on candidates
  whose truth is known: matches of the base patterns, right if they pass the
  checks, and generated spans by ``_truth``: their place in a base span, else the
  checks of their kind (address form, Luhn, digit count) and the words before.
  A telephone number with no word before it that speaks for or against it is not
  trained on, only scored. Training rows are counted by
  feature vector in Spark; the number of different vectors is bounded by the
  features' steps (``MOST_VECTORS``), whatever the input, and only this table of
  counts reaches the driver.
* Per kind, the threshold is the least score from which held-out candidates (a
  fifth of the documents) outside every base span are right in ``PRECISION`` of
  cases; a kind without enough evidence adds nothing. A generated span at or above it, and outside
  every base span, is added.

The patterns use possessive quantifiers and start no match inside a run that
has failed, so that time is linear on very long runs of letters or digits.

Defined results: null text counts as empty. Rows that repeat are handled each.
Extra columns are ignored. Empty input gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind, generated or base, pattern, and a cheap pattern without which it cannot match.
GENERATORS = (
    (0, 0, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    (1, 0, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    (2, 0, r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9][0-9\x20-]{10}"),
    (3, 0, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    (0, 1, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:\(at\)|\[at\])\x20?{_LABEL}++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?){_LABEL}++)++", r"\(at\)|\[at\]"),
    (2, 1, r"(?<![0-9])[0-9]{4}(?:[.\x20/-][0-9]{4}){3}(?![0-9])", r"[0-9]{4}[.\x20/-][0-9]{4}"),
    (3, 1, r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}\)?[\x20.-][0-9]{3}"),
)
#: Words shortly before a span, by what they speak for.
CONTEXT = (
    r"(?i)(?:e-?mail|contact|write to)\W*$",
    r"(?i)(?:\bip|host|server|address)\W*$",
    r"(?i)(?:card|visa|pay|account)(?:\W+(?:no|number))?\W*$",
    r"(?i)(?:tel|phone|call|fax|mobile|cell)(?:\W+(?:no|number))?\W*$",
    r"(?i)(?:order|invoice|\bid|ref|version|isbn|no)(?:\W+(?:no|number))?\W*$",
)
#: Contexts (from 1) that speak against a generated span of a kind, and the one for a telephone number.
SPEAK_AGAINST, FOR_PHONE = {2: (4, 5), 3: (3, 5)}, 4
#: A disguised address whose parts could be a mail address.
FORM = r"^[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+\x20?[(\[]at[)\]]\x20?(?:[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+(?:\.|\x20?[(\[]dot[)\]]\x20?))++[A-Za-z]{2,}+$"
#: Four numbers of at most 255, leading zeros allowed.
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
FEATURES = ("kind", "gen", "digits", "marks", "size", "checked", "context", "before", "after")
#: A count is described by how many of its cuts it reaches: digits, marks, characters.
CUTS = {"digits": (9, 12, 16, 20), "marks": (2, 4), "size": (12, 20)}
#: Different values of checked, context, before, after and held-out.
OTHERS = (2, len(CONTEXT) + 1, 5, 5, 2)
MOST_VECTORS = len(GENERATORS) * math.prod(len(c) + 1 for c in CUTS.values()) * math.prod(OTHERS)
TREES, RATE, DEPTH, PRECISION, EVIDENCE = 40, 0.3, 3, 0.995, 20

_SPAN = "struct<kind:int,gen:int,s:int,e:int,m:string,ctx:string,nxt:string>"


def _found(kind: int, gen: int, p: str, m: str) -> str:
    """SQL: spans of one generator from the pieces between matches and the matches."""
    return f"""aggregate(arrays_zip({p}, {m}, q),
      named_struct('at', 0, 'out', cast(array() AS array<{_SPAN}>)),
      (a, x) -> named_struct('at', a.at + length(x.{p}) + coalesce(length(x.{m}), 0), 'out',
        CASE WHEN x.{m} IS NULL THEN a.out ELSE concat(a.out, array(named_struct('kind', {kind}, 'gen', {gen}, 's', a.at + length(x.{p}),
          'e', a.at + length(x.{p}) + length(x.{m}), 'm', x.{m}, 'ctx', right(x.{p}, 24), 'nxt', left(x.q, 1)))) END),
      a -> a.out)"""


def with_candidates(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and ``spans``: all candidates with their features and checks."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    names = []
    for i, (kind, gen, pattern, sign) in enumerate(GENERATORS):
        here = F.col("text").rlike(sign) if len(sign) > 1 else F.contains("text", F.lit(sign))
        df = df.withColumn("m", F.when(here, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        df = df.withColumn("p", F.when(F.size("m") > 0, F.split("text", pattern, -1)).otherwise(none))
        df = df.withColumn("q", F.when(F.size("m") > 0, F.slice("p", 2, F.size("m"))).otherwise(none))
        df = df.withColumn(f"c{i}", F.expr(_found(kind, gen, "p", "m"))).drop("m", "p", "q")
        names.append(f"c{i}")
    df = df.select(*keep, F.concat(*names).alias("raw"))

    def described(c: Column) -> Column:
        digits = F.regexp_replace(c["m"], "[^0-9]", "")
        n = F.length(digits)
        # Luhn on twelve to nineteen digits only, so that long runs cost nothing.
        some = F.when(n.between(12, 19), digits).otherwise(F.lit(""))
        twice = F.transform(F.split(F.reverse(some), ""), lambda x, i: F.when(x == "", 0).otherwise(x.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1)))
        luhn = n.between(12, 19) & (F.aggregate(twice, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(F.coalesce(x, F.lit(0)))) % 10 == 0)
        checked = (
            F.when(c["kind"] == 0, (c["gen"] == 0) | c["m"].rlike(FORM)).when(c["kind"] == 1, c["m"].rlike(OCTETS))
            .when(c["kind"] == 2, luhn).otherwise(n.between(9, 15))
        )
        context = F.lit(0)
        # From the last to the first: "card no" speaks for a card.
        for k, words in reversed(list(enumerate(CONTEXT))):
            context = F.when(c["ctx"].rlike(words), k + 1).otherwise(context)

        def step(name: str, x: Column) -> Column:
            return sum(((x >= cut).cast("int") for cut in CUTS[name]), F.lit(0)).alias(name)

        def side(x: Column) -> Column:
            return F.when(F.coalesce(x, F.lit("")) == "", 0).when(x.rlike(r"[\x20\x09-\x0D]"), 1).when(x.rlike("[0-9]"), 2).when(x.rlike(r"\p{L}"), 3).otherwise(4)

        return F.struct(
            c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"), c["gen"].alias("gen"),
            step("digits", n), step("marks", F.length(F.regexp_replace(c["m"], "[A-Za-z0-9]", ""))), step("size", F.length(c["m"])),
            checked.cast("int").alias("checked"), context.alias("context"),
            side(F.right(c["ctx"], F.lit(1))).alias("before"), side(c["nxt"]).alias("after"),
        )

    # A lone digit run that is no card candidate at all is left out here.
    worth = F.filter("raw", lambda c: (c["kind"] != 2) | (F.length(c["m"]) >= 12))
    return df.select(*keep, F.transform(worth, described).alias("spans"))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda c: (c["gen"] == 0) & (c["checked"] == 1))


def _truth(c: Column, base: Column) -> Column:
    """1, 0 or null (not known). base: spans that pass their checks.

    A base candidate is right if it passes its checks. A generated span is right
    inside a base span of its kind and wrong where it meets another. Elsewhere it
    is wrong if it fails its kind's checks or the words before it speak against
    it; else right, a telephone number only if they speak for it, as its digit
    count alone says little.
    """
    within = F.exists(base, lambda b: (b["s"] <= c["s"]) & (b["e"] >= c["e"]) & (b["kind"] == c["kind"]))
    against = F.lit(False)
    for kind, codes in SPEAK_AGAINST.items():
        against = against | ((c["kind"] == kind) & c["context"].isin(*codes))
    alone = F.when((c["checked"] == 0) | against, 0).when((c["kind"] != 3) | (c["context"] == FOR_PHONE), 1)
    return F.when(c["gen"] == 0, c["checked"]).when(within, 1).when(~_apart(c, base), 0).otherwise(alone)


def _apart(c: Column, base: Column) -> Column:
    """Whether a span meets none of ``base``."""
    return ~F.exists(base, lambda b: (b["s"] < c["e"]) & (b["e"] > c["s"]))


def training_counts(cands: DataFrame) -> DataFrame:
    """Right and all candidates of known truth, by feature vector and held-out or not.

    Of held-out generated spans only those that could be added are counted.
    """
    base = F.col("passing")
    known = F.transform("spans", lambda c: F.struct(*[c[f].alias(f) for f in FEATURES], _truth(c, base).alias("truth"), ((c["gen"] == 0) | _apart(c, base)).alias("open")))
    held = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held")
    some = cands.filter(F.size("spans") > 0).withColumn("passing", base_spans(F.col("spans")))
    rows = some.select(held, F.explode(known).alias("c")).select("held", "c.*").filter("truth IS NOT NULL AND (open OR NOT held)")
    return rows.groupBy("held", *FEATURES).agg(F.sum("truth").alias("good"), F.count("*").alias("n"))


def _leaf(rows: list) -> float:
    g = sum(r[1] for r in rows)
    h = sum(r[2] for r in rows)
    return RATE * g / (h + 1.0)


def _grow(rows: list, depth: int):
    """A tree on (vector, gradient, curvature) rows: a leaf value, or (feature, cut, low, high)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-6, None)
    for f in range(len(FEATURES)) if depth else ():
        sums: dict[int, list[float]] = {}
        for v, a, b in rows:
            s = sums.setdefault(v[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        lg = lh = 0.0
        for cut in sorted(sums)[:-1]:
            lg, lh = lg + sums[cut][0], lh + sums[cut][1]
            gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, (f, cut))
    if best[1] is None:
        return _leaf(rows)
    f, cut = best[1]
    return f, cut, _grow([r for r in rows if r[0][f] <= cut], depth - 1), _grow([r for r in rows if r[0][f] > cut], depth - 1)


def _value(tree, v) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


class Trees:
    """Boosted trees (sum of leaf values is the log-odds) and a threshold for each kind."""

    def __init__(self, trees: list, start: float, thresholds: dict[int, float]):
        self.trees, self.start, self.thresholds = trees, start, thresholds

    def margin(self, v) -> float:
        return self.start + sum(_value(t, v) for t in self.trees)

    def column(self, c: Column) -> Column:
        """The margin of a candidate as a column."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(c[FEATURES[tree[0]]] <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(float(self.start))
        for t in self.trees:
            out = out + of(t)
        return out


def fitted(counts: DataFrame) -> Trees:
    """Trees and thresholds from the table of counts."""
    table = counts.collect()
    rows = sorted((tuple(r[f] for f in FEATURES), bool(r.held), r.good, r.n) for r in table)
    train = [r for r in rows if not r[1]]
    good, n = sum(r[2] for r in train), sum(r[3] for r in train)
    if not 0 < good < n:
        return Trees([], 0.0, {})
    start = math.log(good / (n - good))
    margins, trees = [start] * len(train), []
    for _ in range(TREES):
        data = []
        for (v, _, a, k), m in zip(train, margins):
            p = 1 / (1 + math.exp(-m))
            data.append((v, a - k * p, k * p * (1 - p)))
        tree = _grow(data, DEPTH)
        trees.append(tree)
        margins = [m + _value(tree, r[0]) for r, m in zip(train, margins)]
    made = Trees(trees, start, {})
    for kind in range(len(KINDS)):
        # Held-out generated candidates of this kind, from the highest score down.
        held = sorted(((made.margin(v), a, k) for v, h, a, k in rows if h and v[0] == kind and v[1] == 1), reverse=True)
        a = k = 0
        for i, (m, x, y) in enumerate(held):
            a, k = a + x, k + y
            if (i + 1 == len(held) or held[i + 1][0] < m) and k >= EVIDENCE and a >= PRECISION * k:
                made.thresholds[kind] = m
    return made


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and spans, both arrays of (s, kind, e) in order."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cands = with_candidates(docs, ("doc_id",))
    trees = fitted(training_counts(cands))
    thresholds = F.create_map(*[F.lit(x) for k in range(len(KINDS)) for x in (k, float(trees.thresholds.get(k, math.inf)))])
    plain = lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))
    base = base_spans(F.col("spans"))
    more = F.filter("spans", lambda c: (c["gen"] == 1) & _apart(c, F.col("base")) & (trees.column(c) >= F.element_at(thresholds, c["kind"])))
    out = cands.withColumn("base", F.array_sort(F.transform(base, plain)))
    return out.select("doc_id", "base", F.array_sort(F.array_distinct(F.concat("base", F.transform(more, plain)))).alias("spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[REDACTED]") -> DataFrame:
    """Documents with every span replaced by a mask; overlapping spans give one mask."""
    found = pii_spans(docs, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = docs.join(found.select("doc_id", "spans").withColumnRenamed("doc_id", "span_doc").dropDuplicates(["span_doc"]), F.col("doc_id").eqNullSafe(F.col("span_doc")), "left")
    step = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<s:int,kind:int,e:int>>")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, c: F.when(c["s"] < a["at"], F.struct(F.greatest(a["at"], c["e"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(c["e"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, c["s"] - a["at"]), F.lit(mask)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return both.withColumn(text_col, F.when(F.col(text_col).isNotNull(), step)).drop("spans", "span_doc")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    found = pii_spans(docs)

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("bigint")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written_out(F.col("base")).cast("binary"), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))
