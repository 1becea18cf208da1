"""PII by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

DataFrame functions only. Base spans are exact matches of fixed patterns and always stay; the classifier adds spans.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: The base patterns. The forms for the JVM match the same spans: a search may only begin where a run of the
#: first characters begins or the last match ended, and runs are possessive, so a text is read in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
#: Candidates beyond the base: long tokens with a digit, telephone numbers without a country code, spelled-out addresses.
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SPELLED = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++"
#: Kinds in the order of the output; what a search finds, the kind that it has, and a cheap test that a text has any.
KINDS = ("email", "ip", "card", "phone", "secret")
SEARCHES = (("email", EMAIL, 0, "@"), ("ip", IP, 1, None), ("card", CARD, 2, None), ("phone", PHONE, 3, "+"), ("secret", SECRET, 4, None), ("local", LOCAL_PHONE, 3, None), ("spelled", SPELLED, 0, "at"))
#: Gazetteers. Common top-level domains; country calling codes; first digits of card issuers; prefixes of keys.
DOMAINS = r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|biz|io|eu|uk|de|fr|es|it|nl|ch|at|be|us|ca|au|jp|br|mx)$"
COUNTRIES = r"^\+\x20?(?:1|7|20|27|3[0-4]|36|39|4[0-1]|4[3-9]|5[1-8]|6[0-6]|8[1-2]|84|86|9[0-5]|98|21[1-8]|35[0-9]|37[0-9]|38[0-9]|42[0-3])"
ISSUERS = r"^(?:3[4-7]|4|5[0-5]|6|2[2-7])"
KEY_FORMS = r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]+|sk-.+|eyJ.+)$"
#: Words before a span that speak for it, and text before it that speaks against it.
SPEAKS = r"(?i)(?:mail|e-mail|contact|write|tel|phone|call|fax|mobile|card|visa|credit|pay|ip|host|server|address|token|key|secret|password|passwd|pwd|auth|bearer)[^A-Za-z0-9]{0,4}$"
AGAINST = r"(?i)(?:version|v\.|section|isbn|page|figure|no\.|https?://[^ ]*|/)[^A-Za-z0-9]{0,2}$"
CONTEXT_CHARS = 24
#: Buckets of the classifier's hashed features; rounds of expectation-maximisation; accepted from this log odds on.
BUCKETS = 1024
ROUNDS = 50
ACCEPT = 0.0
LABELERS, FACTS = 5, 5


def fixed(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are worked out once a row.

    The optimizer merges projections and may move a column's expression to where it is used, for instance into the body
    of a function that runs for every element of an array. It doesn't move expressions over a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def spans(docs: DataFrame) -> DataFrame:
    """docs(doc_id, t) with an array of matches for each search: struct(s, e, x, left): code points, end exclusive.

    A match's place is the sum of the lengths of all pieces before it, which split() gives; sums go over blocks of 64.
    """
    none = F.array().cast("array<string>")
    text, n = F.col("t"), range(len(SEARCHES))
    there = [F.contains(text, F.lit(has)) if has else F.rlike(text, F.lit(pattern)) for _, pattern, _, has in SEARCHES]
    out = fixed(docs, **{f"m{i}": F.when(there[i], F.regexp_extract_all(text, F.lit(SEARCHES[i][1]), F.lit(0))).otherwise(none) for i in n})
    out = fixed(out, **{f"g{i}": F.when(F.size(f"m{i}") > 0, F.split(text, SEARCHES[i][1], -1)).otherwise(none) for i in n})
    out = fixed(out, **{f"l{i}": F.expr(f"zip_with(g{i}, concat(array(''), m{i}), (g, m) -> coalesce(length(g), 0) + coalesce(length(m), 0))") for i in n})
    out = fixed(out, **{f"b{i}": F.expr(f"transform(sequence(0, size(l{i}) div 64), b -> aggregate(slice(l{i}, b * 64 + 1, 64), 0, (a, x) -> a + x))") for i in n})
    out = fixed(out, **{f"a{i}": F.expr(f"transform(b{i}, (x, k) -> aggregate(slice(b{i}, 1, k), 0, (a, y) -> a + y))") for i in n})
    out = fixed(out, **{f"s{i}": F.expr(f"transform(l{i}, (x, k) -> a{i}[k div 64] + aggregate(slice(l{i}, (k div 64) * 64 + 1, k % 64 + 1), 0, (a, y) -> a + y))") for i in n})
    place = f"named_struct('s', z.s, 'e', z.s + length(z.m), 'x', z.m, 'left', right(z.g, {CONTEXT_CHARS}))"
    zipped = [F.arrays_zip(F.col(f"m{i}").alias("m"), F.slice(f"s{i}", 1, F.size(f"m{i}")).alias("s"), F.slice(f"g{i}", 1, F.size(f"m{i}")).alias("g")) for i in n]
    out = fixed(out, **{f"z{i}": zipped[i].cast("array<struct<m:string,s:int,g:string>>") for i in n})
    out = fixed(out, **{SEARCHES[i][0]: F.expr(f"transform(z{i}, z -> {place})") for i in n})
    return out.select("doc_id", *[name for name, *_ in SEARCHES])


def digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d):
    """Whether a string of digits passes Luhn's test."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)), F.lit(0),
        lambda a, i: a + F.get(F.array(*[F.array(*map(F.lit, r)) for r in ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))]), (F.length(d) - i) % 2)[F.substr(d, i, F.lit(1)).cast("int")],
    )
    return total % 10 == 0


def passes(name: str, x):
    """Whether a match of a search passes its test; of base kinds this makes it a base span."""
    if name == "ip":
        return F.rlike(x, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if name == "card":
        d = digits(x)
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))
    if name == "phone":
        return F.length(digits(x)).between(9, 15)
    return F.lit(True)


def votes(name: str, x, left, ok) -> list:
    """A vote of each labeler, 0 against, 1 none, 2 for: pattern, checksum or form, gazetteer, context, shape."""
    yes, no, none = F.lit(2), F.lit(0), F.lit(1)
    base = name in KINDS[:4]
    pattern = F.when(ok, yes).otherwise(no) if base else none
    form = {
        "email": F.when(F.rlike(x, F.lit(r"\.[A-Za-z]{2,}$")), yes).otherwise(no),
        "ip": F.when(~ok | F.rlike(x, F.lit(r"^(?:0|255)\.|(?:^|\.)0[0-9]")), no).otherwise(yes),
        "card": F.when(ok, yes).otherwise(no),
        "phone": F.when(ok, yes).otherwise(no),
        "secret": F.when(F.rlike(x, F.lit(KEY_FORMS)), yes).otherwise(none),
        "local": F.when(F.startswith(x, F.lit("(")), yes).otherwise(none),
        "spelled": yes,
    }[name]
    gazetteer = {
        "email": F.when(F.rlike(x, F.lit(DOMAINS)), yes).otherwise(no),
        "ip": none,
        "card": F.when(F.rlike(x, F.lit(ISSUERS)), yes).otherwise(no),
        "phone": F.when(F.rlike(x, F.lit(COUNTRIES)), yes).otherwise(no),
        "secret": none,
        "local": F.when(F.rlike(x, F.lit("^[(]?[2-9]")), yes).otherwise(no),
        "spelled": F.when(F.rlike(x, F.lit(DOMAINS)), yes).otherwise(no),
    }[name]
    context = F.when(F.rlike(left, F.lit(SPEAKS)), yes).when(F.rlike(left, F.lit(AGAINST)), no).otherwise(none)
    shape = F.when(F.rlike(x, F.lit(r"(.)\1{5}")), no).otherwise(yes if name in ("email", "phone") else none)
    return [pattern, form, gazetteer, context, shape]


def told(name: str, kind: int):
    """The struct that a match of a search becomes; see candidates()."""

    def of(m):
        x, left = m["x"], m["left"]
        ok = passes(name, x)
        v = sum((vote * 3**i for i, vote in enumerate(votes(name, x, left, ok))), F.lit(0))
        shape = F.left(F.regexp_replace(F.regexp_replace(F.left(x, F.lit(64)), "[0-9]+", "9"), "[A-Za-z]+", "a"), F.lit(16))
        word = F.lower(F.regexp_extract(left, r"([A-Za-z]+)[^A-Za-z]*$", 1))
        edge = F.regexp_replace(F.regexp_replace(F.right(left, F.lit(2)), "[0-9]", "9"), r"\p{L}", "a")
        size = F.least(F.length(x), F.lit(64)).cast("string")
        facts = [F.lit(name), F.concat(F.lit(f"{name}:w:"), word), F.concat(F.lit(f"{name}:n:"), size), F.concat(F.lit(f"{name}:s:"), shape), F.concat(F.lit(f"{name}:e:"), edge)]
        f = F.array(*[F.pmod(F.xxhash64(fact), F.lit(BUCKETS)).cast("int") for fact in facts])
        base = ok if name in KINDS[:4] else F.lit(False)
        return F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(kind).alias("k"), base.alias("base"), v.alias("v"), f.alias("f"))

    return of


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, c): every match of every search of docs(doc_id, t): struct(s, e, k, base, v, f).

    k: kind; base: whether it is a base span; v: the votes as one number to base 3; f: buckets of hashed features (kind
    and search, left word, length, shape of the match, shape of the text just before it). Matches of the further
    searches that overlap a base span are left out.
    """
    out = spans(docs)
    out = fixed(out, **{f"c{i}": F.transform(F.col(name), told(name, kind)) for i, (name, _, kind, _) in enumerate(SEARCHES)})
    first, more = [f"c{i}" for i, x in enumerate(SEARCHES) if x[0] in KINDS[:4]], [f"c{i}" for i, x in enumerate(SEARCHES) if x[0] not in KINDS[:4]]
    out = fixed(out, b=F.concat(*first), o=F.concat(*more))
    return out.select("doc_id", F.expr("concat(b, filter(o, y -> not exists(b, z -> z.base and z.s < y.e and y.s < z.e)))").alias("c"))


def posteriors(counts: dict[int, int], rounds: int = ROUNDS) -> list[float]:
    """The probability that a span is true for each of the 3^LABELERS patterns of votes, from how often each occurs.

    Expectation-maximisation where labelers err independently given the class (0 false, 1 true): rate[labeler][vote][class]
    and the prior are estimated from the expected classes, and those from them in turn.
    """
    prior = 0.7
    rate = [[[0.5, 0.1], [0.3, 0.3], [0.2, 0.6]] for _ in range(LABELERS)]
    vote = lambda v, i: v // 3**i % 3
    total = sum(counts.values())

    def true(v: int) -> float:
        odds = prior / (1 - prior)
        for i in range(LABELERS):
            no, yes = rate[i][vote(v, i)]
            odds *= yes / no
        return odds / (1 + odds)

    for _ in range(rounds if total else 0):
        p = {v: true(v) for v in counts}
        of = (sum((1 - p[v]) * n for v, n in counts.items()), sum(p[v] * n for v, n in counts.items()))
        prior = min(0.99, max(0.01, (of[1] + 1) / (total + 2)))
        said = [[[1.0, 1.0] for _ in range(3)] for _ in range(LABELERS)]
        for v, n in counts.items():
            for i in range(LABELERS):
                said[i][vote(v, i)][0] += (1 - p[v]) * n
                said[i][vote(v, i)][1] += p[v] * n
        rate = [[[x / (t + 3) for x, t in zip(pair, of, strict=True)] for pair in labeler] for labeler in said]
    return [true(v) for v in range(3**LABELERS)]


def numbers(values: list[float]):
    """Column: a constant array."""
    return F.split(F.lit(",".join(f"{x:.9g}" for x in values)), ",").cast("array<double>")


def classifier(each: DataFrame, p: list[float]) -> tuple[list[float], float]:
    """(weights of BUCKETS hashed features, bias), from spans each(v, f), taught by the posteriors p of their votes.

    Naive Bayes on soft labels: one aggregate by bucket, at most BUCKETS rows.
    """
    taught = each.select(F.get(numbers(p), F.col("v")).alias("p"), F.explode("f").alias("b"))
    rows = taught.groupBy("b").agg(F.sum("p").alias("t"), F.count("*").alias("n")).collect()
    total, true = sum(r["n"] for r in rows) / FACTS, sum(r["t"] for r in rows) / FACTS
    bias = math.log((true + 1) / (total - true + 1))
    weights = [0.0] * BUCKETS
    for r in rows:  # a shrunken log ratio: the facts of a span aren't independent
        weights[r["b"]] = 0.5 * (math.log((r["t"] + 1) / (r["n"] - r["t"] + 1)) - bias)
    return weights, bias


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, found, added): arrays of struct(s, e, k), base spans and those that the classifier adds, for docs(doc_id, text).

    Whole texts, null is empty. One pass over the texts; its matches (no texts) are a table in the shared folder, from
    which the vote counts, the feature counts and the result are read. Rows stay where they are. Repeated rows are rows.
    """
    made = materialize(candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))), "candidates")
    each = made.select(F.explode("c").alias("c")).select("c.v", "c.f")
    counts = {r["v"]: r["n"] for r in each.groupBy("v").agg(F.count("*").alias("n")).collect()}  # 3^LABELERS rows at most
    weights, bias = classifier(each, posteriors(counts))
    w = numbers(weights)
    made = made.withColumn("found", F.filter("c", lambda x: x["base"]))
    score = lambda x: F.aggregate(x["f"], F.lit(bias), lambda a, b: a + F.get(w, b))
    made = made.withColumn("added", F.filter("c", lambda x: ~x["base"] & (x["k"].isin(3, 4, 0)) & told_apart(x) & (score(x) >= ACCEPT)))
    slim = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    return made.select("doc_id", slim(F.col("found")).alias("found"), slim(F.col("added")).alias("added"))


def told_apart(x):
    """A match that failed a base test (a vote of the pattern labeler against it) isn't taken up again."""
    return F.pmod(x["v"], F.lit(3)) != 0


def joined(spans_):
    """Column: kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans_, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    count = [F.expr(f"cast(size(filter(found, x -> x.k = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return found.select("doc_id", *count, F.sha2(joined(F.col("found")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("found", "added")).alias("spans"))
