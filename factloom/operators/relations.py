"""Value relations as bit masks, and their closure over equivalence classes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixpoint import fixpoint
from ..functions.grouped import LARGE, per_group, split_by_size
from ..functions.store import materialize

#: The relations in the order of their bits, then for each its inverse, its negation (none for the last two),
#: those that exclude it, and those that it implies.
NAMES = ("EQ", "NE", "SLE", "SLT", "ULE", "ULT", "SGE", "SGT", "UGE", "UGT", "PT", "PF")
INVERSE = ("EQ", "NE", "SGE", "SGT", "UGE", "UGT", "SLE", "SLT", "ULE", "ULT", "PF", "PT")
NEGATION = ("NE", "EQ", "SGT", "SGE", "UGT", "UGE", "SLT", "SLE", "ULT", "ULE", None, None)
CONFLICTS = ("NE SLT ULT SGT UGT", "EQ", "SGT", "EQ SGE SGT", "UGT", "EQ UGE UGT", "SLT", "EQ SLE SLT", "ULT", "EQ ULE ULT", "", "")
IMPLIED = ("SLE ULE SGE UGE", "", "", "NE SLE", "", "NE ULE", "", "NE SGE", "", "NE UGE", "", "")
BIT = {n: 1 << i for i, n in enumerate(NAMES)}
#: r then s gives t: equality is neutral; orders of one kind chain, strict if either is.
CHAINS = [(a, b, ("LT" if "LT" in (a[1:], b[1:]) else "LE") and p + ("LT" if "LT" in (a[1:], b[1:]) else "LE")) for p in "SU" for a in (p + "LE", p + "LT") for b in (p + "LE", p + "LT")] + [(a, b, p + ("GT" if "GT" in (a[1:], b[1:]) else "GE")) for p in "SU" for a in (p + "GE", p + "GT") for b in (p + "GE", p + "GT")]


def mask(names: str) -> int:
    return sum(BIT[n] for n in set(names.split()))


def table_of(rels: Column, rows: tuple) -> Column:
    """For each bit of rels the mask in rows, or-ed."""
    out = F.lit(0)
    for i, names in enumerate(rows):
        if names:
            out = out.bitwiseOR(F.when(rels.bitwiseAND(1 << i) != 0, F.lit(mask(names))).otherwise(F.lit(0)))
    return out


def inverted(rels: Column) -> Column:
    return table_of(rels, INVERSE)


def negated(rels: Column) -> Column:
    return table_of(rels, NEGATION)


def conflicting(rels: Column) -> Column:
    return table_of(rels, CONFLICTS)


def implied(rels: Column) -> Column:
    """rels and all that they imply; less-or-equal with unequal is less."""
    base = out = rels.bitwiseOR(table_of(rels, IMPLIED))
    for p in "SU":
        for le, lt in (("LE", "LT"), ("GE", "GT")):
            both = BIT["NE"] | BIT[p + le]
            out = out.bitwiseOR(F.when(base.bitwiseAND(both) == both, F.lit(BIT[p + lt])).otherwise(F.lit(0)))
    return out


def strict(rels: Column) -> Column:
    return rels.bitwiseAND(mask("SLT ULT SGT UGT"))


def non_strict(rels: Column) -> Column:
    return rels.bitwiseAND(mask("SLE ULE SGE UGE"))


def conflict(rels: Column) -> Column:
    """Whether a set of relations of one pair can't hold together."""
    return conflicting(rels).bitwiseAND(rels) != 0


def composed(a: Column, b: Column) -> Column:
    """What holds between x and z if a holds between x and y, and b between y and z."""
    out = F.when(a.bitwiseAND(1) != 0, b).otherwise(F.lit(0)).bitwiseOR(F.when(b.bitwiseAND(1) != 0, a).otherwise(F.lit(0)))
    for r, s, t in CHAINS:
        out = out.bitwiseOR(F.when((a.bitwiseAND(BIT[r]) != 0) & (b.bitwiseAND(BIT[s]) != 0), F.lit(BIT[t])).otherwise(F.lit(0)))
    return out


def both_ways(vr: DataFrame) -> DataFrame:
    """vr(loc, lt, rels, rt) with the inverse of every row, one row a pair, implications added."""
    rows = vr.select("loc", "lt", "rels", "rt").unionByName(vr.select("loc", F.col("rt").alias("lt"), inverted(F.col("rels")).alias("rels"), F.col("lt").alias("rt")))
    return rows.groupBy("loc", "lt", "rt").agg(F.bit_or("rels").alias("r")).select("loc", "lt", implied(F.col("r")).alias("rels"), "rt")


def reached_bits(onto: list[int], i: int) -> int:
    """What paths of an edge or more lead to, as bits."""
    seen = new = onto[i]
    while new:
        step, left = 0, new
        while left:
            low = left & -left
            step |= onto[low.bit_length() - 1]
            left ^= low
        new = step & ~seen
        seen |= new
    return seen


def solve_classes(rows: list[tuple]) -> Iterator[tuple]:
    """(val, cls) of one location, rows (lt, rels, rt) both ways."""
    names = sorted({v for lt, _, rt in rows for v in (lt, rt)})
    number = {v: i for i, v in enumerate(names)}
    same = [0] * len(names)
    for r in ("EQ", "SLE", "ULE"):
        onto = [0] * len(names)
        for lt, rels, rt in rows:
            if rels & mask(f"EQ {r}") and lt != rt:
                onto[number[lt]] |= 1 << number[rt]
        far = [reached_bits(onto, i) for i in range(len(names))]
        for i in range(len(names)):
            for j in range(len(names)):
                if far[i] >> j & 1 and far[j] >> i & 1:
                    same[i] |= 1 << j
    for i, v in enumerate(names):
        met = reached_bits(same, i) | 1 << i
        yield v, names[(met & -met).bit_length() - 1]


def classes(vr: DataFrame, large: int = LARGE) -> DataFrame:
    """(loc, val, cls): values that must be equal, named by the smallest: by EQ, and by cycles of signed or of unsigned <=.
    Locations of up to large pairs are solved one by one where their rows meet, larger ones by rounds."""
    pairs = materialize(both_ways(vr), "pairs")
    few, many = split_by_size(pairs, ["loc"], large)
    one = lambda df: per_group(df, ["loc"], lambda _, rows: solve_classes(rows), "loc long, val long, cls long")
    if many is None:
        return one(pairs)
    out = classes_large(pairs.join(many, "loc", "left_semi"))
    return out if few is None else out.unionByName(one(pairs.join(few, "loc", "left_semi")))


def classes_large(pairs: DataFrame) -> DataFrame:
    """classes() of pairs, both ways, by rounds over all locations at once."""
    reach_rows = None
    for r in ("EQ", "SLE", "ULE"):
        e = pairs.where((F.col("rels").bitwiseAND(mask(f"EQ {r}")) != 0) & (F.col("lt") != F.col("rt"))).select("loc", F.lit(r).alias("k"), "lt", "rt")
        reach_rows = e if reach_rows is None else reach_rows.unionByName(e)
    reach_rows = reach_rows.distinct()

    def step(front: DataFrame) -> DataFrame:
        return front.withColumnRenamed("rt", "mid").join(reach_rows.select("loc", "k", F.col("lt").alias("mid"), "rt"), ["loc", "k", "mid"]).select("loc", "k", "lt", "rt")

    paths = fixpoint(reach_rows, step, "classes")
    same = paths.alias("p").join(paths.alias("q"), F.expr("p.loc = q.loc AND p.k = q.k AND p.lt = q.rt AND p.rt = q.lt")).select("p.loc", "p.lt", "p.rt").distinct()

    def merge(front: DataFrame) -> DataFrame:
        return front.withColumnRenamed("rt", "mid").join(same.select("loc", F.col("lt").alias("mid"), "rt"), ["loc", "mid"]).select("loc", "lt", "rt")

    merged = fixpoint(same, merge, "merged")
    values = pairs.select("loc", F.col("lt").alias("val")).distinct()
    least = merged.groupBy("loc", F.col("lt").alias("val")).agg(F.min("rt").alias("m"))
    return values.join(least, ["loc", "val"], "left").select("loc", "val", F.least("val", F.coalesce("m", "val")).alias("cls"))


def chain_rules() -> list[tuple[str, str, str]]:
    """(rel, rel2, out): what a chain of two relations gives, EQ before and after the others among them."""
    return [*CHAINS, *[(n, "EQ", n) for n in NAMES if n not in ("NE", "PT", "PF")], *[("EQ", n, n) for n in NAMES[2:10]]]


CHAINED = [n for n in NAMES[:10] if n != "NE"]


def solve_location(rows: list[tuple]) -> Iterator[tuple]:
    """(lt, rel, rt) of one location, rows (lt, rels, rt) both ways: a search from each value, sets of values as bits."""
    names = sorted({v for lt, _, rt in rows for v in (lt, rt)})
    number = {v: i for i, v in enumerate(names)}
    onto = {r: [0] * len(names) for r in CHAINED}
    for lt, rels, rt in rows:
        for r in CHAINED:
            if rels & BIT[r]:
                onto[r][number[lt]] |= 1 << number[rt]
    rules = [(a, b, out) for a, b, out in chain_rules() if a in onto and b in onto and out in onto and any(onto[b])]
    for i in range(len(names)):
        known = {r: onto[r][i] for r in CHAINED}
        new = dict(known)
        while any(new.values()):
            found = dict.fromkeys(CHAINED, 0)
            for a, b, out in rules:
                left = new[a]
                while left:
                    low = left & -left
                    found[out] |= onto[b][low.bit_length() - 1]
                    left ^= low
            new = {r: found[r] & ~known[r] for r in CHAINED}
            for r in CHAINED:
                known[r] |= new[r]
        for r in CHAINED:
            yield from ((names[i], r, names[j]) for j in range(len(names)) if known[r] >> j & 1)


def closed(vr: DataFrame, large: int = LARGE) -> DataFrame:
    """(loc, lt, rel, rt): everything that follows by chaining one kind of relation: EQ with itself, and <= and < of one
    signedness with EQ; strict if a step is. rel is a relation's name. Locations of up to large pairs are solved one by one
    where their rows meet, larger ones by rounds."""
    pairs = materialize(both_ways(vr), "pairs")
    few, many = split_by_size(pairs, ["loc"], large)
    if many is None:
        return per_group(pairs, ["loc"], lambda _, rows: solve_location(rows), "loc long, lt long, rel string, rt long")
    out = closed_large(pairs.join(many, "loc", "left_semi"))
    return out if few is None else out.unionByName(per_group(pairs.join(few, "loc", "left_semi"), ["loc"], lambda _, rows: solve_location(rows), "loc long, lt long, rel string, rt long"))


def closed_large(pairs: DataFrame) -> DataFrame:
    """closed() of pairs, both ways, by rounds over all locations at once."""
    kinds = []
    for i, n in enumerate(NAMES[:10]):
        if n != "NE":
            kinds.append(pairs.where(F.col("rels").bitwiseAND(1 << i) != 0).select("loc", "lt", F.lit(n).alias("rel"), "rt"))
    base = kinds[0]
    for k in kinds[1:]:
        base = base.unionByName(k)
    base = base.distinct()
    rules = base.sparkSession.createDataFrame(chain_rules(), "rel string, rel2 string, out string")
    edge = base.select("loc", F.col("lt").alias("mid"), F.col("rel").alias("rel2"), "rt")

    def step(front: DataFrame) -> DataFrame:
        one = front.withColumnRenamed("rt", "mid").join(edge, ["loc", "mid"]).join(F.broadcast(rules), ["rel", "rel2"])
        return one.select("loc", "lt", F.col("out").alias("rel"), "rt")

    return fixpoint(base, step, "closed", hops=1)


def contradictions(vr: DataFrame) -> DataFrame:
    """(loc, lt, rt) of pairs whose relations can't hold together."""
    return both_ways(vr).where(conflict(F.col("rels"))).select("loc", "lt", "rt")


def common(states: DataFrame, n_states: DataFrame) -> DataFrame:
    """(loc, lt, rels, rt): what holds in every predecessor: states(loc, pred, lt, rels, rt), n_states(loc, n)."""
    g = states.groupBy("loc", "lt", "rt").agg(F.bit_and("rels").alias("rels"), F.count("*").alias("c"))
    return g.join(n_states, "loc").where("c = n AND rels <> 0").select("loc", "lt", "rels", "rt")


def bounds(closure_: DataFrame, consts: DataFrame) -> DataFrame:
    """(loc, val, lo, hi): best signed constant bounds of each value; a strict one is tightened by one. consts(val, value)."""
    c = closure_.join(consts.select(F.col("val").alias("rt"), "value"), "rt")
    low = F.max(F.when(F.col("rel") == "SGT", F.col("value") + 1).when(F.col("rel").isin("SGE", "EQ"), F.col("value")))
    high = F.min(F.when(F.col("rel") == "SLT", F.col("value") - 1).when(F.col("rel").isin("SLE", "EQ"), F.col("value")))
    return c.groupBy("loc", F.col("lt").alias("val")).agg(low.alias("lo"), high.alias("hi")).where("lo is not null or hi is not null")


def first_strict(closure_: DataFrame) -> DataFrame:
    """(loc, lt, rt): strictly smaller values with none strictly between (signed)."""
    s = closure_.where("rel = 'SLT' AND lt <> rt").select("loc", "lt", "rt").distinct()
    two = s.alias("a").join(s.alias("b"), F.expr("a.loc = b.loc AND a.rt = b.lt")).select("a.loc", "a.lt", "b.rt")
    return s.join(two.distinct(), ["loc", "lt", "rt"], "left_anti")


def valid_areas(edges: DataFrame, locs: DataFrame, made: DataFrame, ended: DataFrame) -> DataFrame:
    """(fn, loc, area): areas that are valid at a location on every path to it: made(fn, loc, area) begin there, ended(fn, loc,
    area) end. Its complement, "may be invalid", is a least fixpoint: from locations without predecessor and from ends."""
    areas = made.select("fn", "area").distinct()
    every = locs.select("fn", "loc").join(areas, "fn")
    e = edges.select("fn", F.col("src").alias("loc"), F.col("dst").alias("to"))
    entry = every.join(edges.select("fn", F.col("dst").alias("loc")).distinct(), ["fn", "loc"], "left_anti")
    bad = entry.unionByName(ended.join(e, ["fn", "loc"]).select("fn", F.col("to").alias("loc"), "area")).distinct()
    begins = made.join(ended, ["fn", "loc", "area"], "left_anti")

    def step(front: DataFrame) -> DataFrame:
        return front.join(begins, ["fn", "loc", "area"], "left_anti").join(e, ["fn", "loc"]).select("fn", F.col("to").alias("loc"), "area")

    return every.join(fixpoint(bad, step, "invalid"), ["fn", "loc", "area"], "left_anti")
