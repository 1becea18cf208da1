"""Andersen-style pointer analysis, field-sensitive, over constraints of many modules at once.

cons(module, kind, dst, src, off, len): kinds alloc (dst points to object src), null, copy (casts, phis, returns), gep
(off added), store (*dst takes src), load (dst takes *src), memcpy (len bytes of *src to *dst). objects(module, obj, size,
zero): size 0 is unknown. Offsets: -1 is unknown. Targets: NULL_ and UNKNOWN are sentinels. Relations: pt(module, n, tgt,
off), mem(module, obj, off, tgt, toff).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixpoint import NotConverged
from ..functions.grouped import LARGE, many_groups, per_group, split_by_size
from ..functions.store import materialize

UNKNOWN, NULL_, INVALIDATED = -1, -2, -3
PT, MEM = ["module", "n", "tgt", "off"], ["module", "obj", "off", "tgt", "toff"]


def shifted(off: str, by: str, size: str, limit: int) -> str:
    """SQL for an offset after a gep: unknown if either is, or if it leaves the object or the field bound."""
    return f"CASE WHEN {off} < 0 OR {by} IS NULL OR {by} < 0 THEN -1L WHEN ({off} + {by} = 0 OR {off} + {by} < coalesce({size}, 0)) AND {off} + {by} < {limit}L THEN {off} + {by} ELSE -1L END"


def without_loop_offsets(cons: DataFrame, loops: DataFrame) -> DataFrame:
    """Geps on loops, loops(module, dst), get an unknown offset: it would grow in every round."""
    hit = loops.select("module", "dst").distinct().withColumn("on_loop", F.lit(True))
    return cons.join(hit, ["module", "dst"], "left").withColumn("off", F.when(F.col("on_loop") & (F.col("kind") == "gep"), F.lit(None)).otherwise(F.col("off"))).drop("on_loop")


STATE = "module long, r int, a long, b long, tgt long, off long"


def moved_offset(at: int | None, by: int | None, size: int, limit: int) -> int:
    """An offset after a gep, as shifted() says."""
    if at is None or by is None or at < 0 or by < 0:
        return UNKNOWN
    return at + by if (at + by == 0 or at + by < size) and at + by < limit else UNKNOWN


def solve_columns(rows: list[tuple], field_limit: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Columns of STATE for one module, rows (kind, dst, src, off, len), objects among them as (object, obj, zero, size, null)
    and functions as (function, obj, parameter, result, null). Every rule is applied until none adds anything, again only
    where what it reads has grown. A set is an int with a bit for each place, a target and an offset in it."""
    size, pt, functions = {}, {}, {}
    places: list[tuple[int, int]] = []
    number: dict[tuple[int, int], int] = {}
    cells: list[int] = []  # by place: what it holds, and what a load of it may give
    seen_from: list[int] = []
    inside: dict[int, list[int]] = {}  # an object's places
    named: dict[int, tuple[int, ...]] = {}

    def place(t: int, o: int) -> int:
        n = number.get((t, o))
        if n is None:
            n = number[t, o] = len(places)
            places.append((t, o))
            cells.append(0)
            beside, anywhere = inside.setdefault(t, []), 0
            for x in beside if t >= 0 else ():
                if o < 0 or places[x][1] < 0:
                    anywhere |= cells[x]
            seen_from.append(anywhere)
            beside.append(n)
        return n

    def parts(held: int) -> tuple[int, ...]:
        """Numbers of a set's places."""
        out = named.get(held)
        if out is None:
            rest, found = held, []
            while rest:
                low = rest & -rest
                found.append(low.bit_length() - 1)
                rest ^= low
            out = named[held] = tuple(found)
        return out

    def write(n: int, more: int) -> bool:
        if not more & ~cells[n]:
            return False
        cells[n] |= more
        t, o = places[n]
        for x in inside[t]:
            if x == n or o < 0 or places[x][1] < 0:
                seen_from[x] |= more
        return True

    once: dict[tuple, None] = {}
    zeros = []
    for kind, dst, src, off, length in rows:
        if kind == "object":
            size[dst] = off or 0
            if src:
                zeros.append(dst)
        elif kind == "function":
            functions[dst] = (src, off)
        elif kind == "alloc":
            pt[dst] = pt.get(dst, 0) | 1 << place(src, 0)
        elif kind == "null":
            pt[dst] = pt.get(dst, 0) | 1 << place(NULL_, 0)
        else:
            once[kind, dst, src, off, length] = None
    for obj in zeros:
        write(place(obj, UNKNOWN), 1 << place(NULL_, 0))
    rules = list(once)
    done: list = [None] * len(rules)  # by rule: what it read last
    grown = 0  # how often memory has
    going = True
    while going:
        going = False
        for i, (kind, dst, src, off, length) in enumerate(rules):
            from_ = pt.get(src, 0)
            if not from_:
                continue
            if kind == "copy":
                have = pt.get(dst, 0)
                if from_ & ~have:
                    pt[dst] = have | from_
                    going = True
            elif kind == "gep":
                fresh = from_ & ~(done[i] or 0)
                if fresh:
                    done[i] = from_
                    have = got = pt.get(dst, 0)
                    for x in parts(fresh):
                        t, o = places[x]
                        got |= 1 << (x if t < 0 else place(t, moved_offset(o, off, size.get(t, 0), field_limit)))
                    if got != have:
                        pt[dst] = got
                        going = True
            elif kind == "load":
                if done[i] == (from_, grown):
                    continue
                done[i] = (from_, grown)
                have = got = pt.get(dst, 0)
                for x in parts(from_):
                    if places[x][0] >= 0:
                        got |= seen_from[x]
                if got != have:
                    pt[dst] = got
                    going = True
            elif kind == "store":
                to = pt.get(dst, 0)
                if done[i] == (from_, to):
                    continue
                done[i] = (from_, to)
                for x in parts(to):
                    if places[x][0] >= 0 and write(x, from_):
                        going, grown = True, grown + 1
            elif kind == "memcpy":
                to = pt.get(dst, 0)
                if done[i] == (from_, to, grown):
                    continue
                done[i] = (from_, to, grown)
                moved: dict[int | None, int] = {}  # by how far they move, what cells hold
                for y in parts(from_):
                    st, so = places[y]
                    for z in inside[st] if st >= 0 else ():
                        held, at = cells[z], places[z][1]
                        if held and (so < 0 or at < 0 or length is None or so <= at < so + length):
                            by = None if so < 0 or at < 0 else at - so
                            moved[by] = moved.get(by, 0) | held
                for x in parts(to) if moved else ():
                    t, o = places[x]
                    for by, held in moved.items() if t >= 0 else ():
                        if write(place(t, UNKNOWN if by is None or o < 0 else moved_offset(o + by, 0, size.get(t, 0), field_limit)), held):
                            going, grown = True, grown + 1
            elif kind in CALLS:
                for param, result in [functions[places[x][0]] for x in parts(from_) if places[x][0] in functions]:
                    for into, held in ((param, pt.get(off, 0) if kind != "join" else 0), (dst, pt.get(result, 0) if kind != "fork" else 0)):
                        have = pt.get(into, 0)
                        if held & ~have:
                            pt[into] = have | held
                            going = True
    at: list[int] = []
    held_: list[int] = []
    for n, held in pt.items():
        some = parts(held)
        at += [n] * len(some)
        held_ += some
    r, off_ = [0] * len(at), [0] * len(at)
    for (t, o), held in zip(places, cells, strict=True):
        some = parts(held)
        at += [t] * len(some)
        off_ += [o] * len(some)
        held_ += some
    r += [1] * (len(at) - len(r))
    return r, at, off_, [places[x][0] for x in held_], [places[x][1] for x in held_]


def solve_module(rows: list[tuple], field_limit: int) -> tuple[dict, dict]:
    """(pt, mem) of solve_columns(): pt[n] and mem[obj][off] are sets of (target, offset)."""
    pt, mem = {}, {}
    for r, a, b, t, o in zip(*solve_columns(rows, field_limit), strict=True):
        (mem.setdefault(a, {}).setdefault(b, set()) if r else pt.setdefault(a, set())).add((t, o))
    return pt, mem


class Sets:
    """Points-to sets of many modules side by side, for rules without calls. A set is 64 bits: the objects of a module, a bit
    for the unknown offset and width ones for the known of each, and null as the last. Cells are held by object, slot and module."""

    NULL = np.uint64(1 << 63)

    def __init__(self, nodes: int, sizes: np.ndarray, limit: int):
        """sizes: by module and number of an object, at least 1."""
        self.width = int(min(sizes.max(initial=1), limit))
        self.step = self.width + 1
        self.count = sizes.shape[1]
        self.cells = np.zeros((self.count, self.step, len(sizes)), np.uint64)
        self.pt = np.zeros(nodes, np.uint64)
        slots = np.arange(self.width)
        #: By object, offset and module: the known offsets that there are.
        self.valid = slots[None, :, None] < np.minimum(sizes, limit).T[:, None, :]
        bit = np.uint64(1) << (np.arange(self.count)[:, None] * self.step + 1 + slots[None, :]).astype(np.uint64)
        self.valid_bits = np.bitwise_or.reduce(np.where(self.valid, bit[:, :, None], np.uint64(0)), axis=(0, 1))
        self.known = np.bitwise_or.reduce(bit, axis=None)
        self.reach = [np.bitwise_or.reduce(bit[:, : self.width - d], axis=None) if d < self.width else np.uint64(0) for d in range(self.step)]
        self.fields = np.bitwise_or.reduce(bit, axis=1)
        self.unknown = np.uint64(1) << (np.arange(self.count) * self.step).astype(np.uint64)

    def join(self, dst: np.ndarray, more: np.ndarray) -> None:
        np.bitwise_or.at(self.pt, dst, more)

    def moved(self, held: np.ndarray, by: int, module: np.ndarray) -> np.ndarray:
        """Sets after a gep; by is the width for all that is as much or more, -1 if unknown."""
        stay = held & ~self.known
        kept = (held & self.reach[by]) << np.uint64(by) & self.valid_bits[module] if 0 <= by < self.width else np.zeros_like(held)
        lost = held & self.known & ~(kept >> np.uint64(max(by, 0)))
        for field, bit in zip(self.fields, self.unknown, strict=True):
            stay |= np.where(lost & field, bit, np.uint64(0))
        return stay | kept

    def has(self, held: np.ndarray, k: int, slot: int) -> np.ndarray:
        """All bits where sets have this place, none elsewhere."""
        return np.uint64(0) - (held >> np.uint64(k * self.step + slot) & np.uint64(1))

    def loaded(self, held: np.ndarray, module: np.ndarray) -> np.ndarray:
        """What loads through sets may give."""
        out = np.zeros_like(held)
        for k in range(self.count):
            mine = self.cells[k][:, module]
            out |= self.has(held, k, 0) & np.bitwise_or.reduce(mine, axis=0) | np.where(held & self.fields[k], mine[0], np.uint64(0))
            for s in range(1, self.step):
                out |= self.has(held, k, s) & mine[s]
        return out

    def write(self, got: np.ndarray, first: np.ndarray, module: np.ndarray) -> None:
        """got by object, slot and rule into the cells of modules, whose rules start at first."""
        self.cells[:, :, module] |= np.bitwise_or.reduceat(got, first, axis=2)

    def stored(self, to: np.ndarray, held: np.ndarray) -> np.ndarray:
        out = np.empty((self.count, self.step, len(to)), np.uint64)
        for k in range(self.count):
            for s in range(self.step):
                out[k, s] = self.has(to, k, s) & held
        return out

    def copied(self, to: np.ndarray, held: np.ndarray, length: np.ndarray, module: np.ndarray) -> np.ndarray:
        """What memcpy of so many bytes writes, of known offsets by how far they move."""
        near = np.zeros((self.width, len(to)), np.uint64)
        some = np.zeros(len(to), np.uint64)
        for k in range(self.count):
            mine = self.cells[k][:, module]
            some |= self.has(held, k, 0) & np.bitwise_or.reduce(mine, axis=0) | np.where(held & self.fields[k], mine[0], np.uint64(0))
            for s in range(self.width):
                near[: self.width - s] |= self.has(held, k, 1 + s) & mine[1 + s :]
        for by in range(self.width):
            near[by, by >= length] = 0
        behind = np.bitwise_or.accumulate(near[::-1], axis=0)[::-1]  # all that moves so far or farther
        out = np.zeros((self.count, self.step, len(to)), np.uint64)
        for k in range(self.count):
            fits = np.uint64(0) - self.valid[k][:, module].astype(np.uint64)
            loose = np.where(to & (self.fields[k] | self.unknown[k]), some, np.uint64(0)) | self.has(to, k, 0) & behind[0]
            for s in range(self.width):
                hit = self.has(to, k, 1 + s)
                out[k, 1 + s :] |= hit & near[: self.width - s]
                if s:
                    loose |= hit & behind[self.width - s]
            loose |= np.bitwise_or.reduce(out[k, 1:] & ~fits, axis=0)
            out[k, 1:] &= fits
            out[k, 0] = loose
        return out


KINDS = {"copy": 0, "gep": 1, "load": 2, "store": 3, "memcpy": 4, "alloc": 5, "null": 6, "object": 7}


def solve_tables(table: pa.Table, field_limit: int) -> Iterator[pa.Table]:
    """STATE of whole modules, rows (module, kind, dst, src, off, len) in order of module: side by side where sets fit 64 bits,
    by solve_columns() where they don't or where there are calls."""
    def alone(part: pa.Table, m: int | None) -> pa.Table:
        found = solve_columns(list(zip(*(part.column(c).to_pylist() for c in ("kind", "dst", "src", "off", "len")), strict=True)), field_limit)
        return pa.table([pa.array([m], pa.int64()).take(pa.array([0] * len(found[0]), pa.int64())), *(pa.array(c, pa.int64()) for c in found)], names=["module", "r", "a", "b", "tgt", "off"])

    nameless = table.column("module").null_count
    if nameless:
        yield alone(table.slice(0, nameless), None)
        table = table.slice(nameless)
    if not len(table):
        return
    module = table.column("module").to_numpy()
    cols, none = {}, {}
    for c in ("dst", "src", "off", "len"):
        none[c] = pc.is_null(table.column(c)).to_numpy()
        cols[c] = pc.fill_null(table.column(c), 0).to_numpy()
    names = table.column("kind").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    code = np.array([KINDS.get(k, -1) for k in names.dictionary.to_pylist()] or [-1])
    kind = np.where(names.indices.is_null().to_numpy(zero_copy_only=False), -1, code[names.indices.fill_null(0).to_numpy()])
    ids, at = np.unique(module, return_inverse=True)
    dst, src, off = cols["dst"], cols["src"], cols["off"]
    odd = (kind < 0) | none["dst"] | none["src"] & (kind < 6) | (kind == 4) & none["len"] | (kind == 5) & (src < 0) | (kind == 7) & (dst < 0)
    # objects: what is allocated, and what is zero from the start
    zero = (kind == 7) & ~none["src"] & (src != 0)
    made = np.flatnonzero((kind == 5) | zero)
    pair = np.unique(np.stack([at[made], np.where(kind[made] == 5, src[made], dst[made])], axis=1), axis=0).reshape(-1, 2)
    count = np.bincount(pair[:, 0], minlength=len(ids))
    number = np.arange(len(pair)) - np.concatenate([[0], np.cumsum(count)[:-1]])[pair[:, 0]]
    told = np.flatnonzero(kind == 7)
    size_of = np.ones(len(pair), np.int64)

    def of(m: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The place in pair of each module and object, -1 for none."""
        if not len(pair):
            return np.full(len(m), -1)
        values = np.unique(pair[:, 1])
        wide = len(values) + 1
        have = pair[:, 0] * wide + np.searchsorted(values, pair[:, 1])
        x = np.minimum(np.searchsorted(values, o), len(values) - 1)
        want = m * wide + x
        y = np.minimum(np.searchsorted(have, want), len(have) - 1)
        return np.where((values[x] == o) & (have[y] == want), y, -1)

    where = of(at[told], dst[told])
    twice = np.unique(np.stack([at[told], dst[told]], axis=1), axis=0, return_counts=True) if len(told) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    size_of[where[where >= 0]] = np.maximum(1, np.where(none["off"], 0, off)[told][where >= 0])
    width = np.ones(len(ids), np.int64)
    np.maximum.at(width, pair[:, 0], np.minimum(size_of, field_limit))
    slow = np.zeros(len(ids), bool)
    slow[at[odd]] = True
    slow[twice[0][twice[1] > 1, 0].astype(np.int64)] = True
    slow |= field_limit < 1
    slow |= count > 63 // np.minimum(width + 1, 64)
    slow |= width > 62
    for m in np.flatnonzero(slow):
        lo = int(np.searchsorted(at, m))
        yield alone(table.slice(lo, int(np.searchsorted(at, m, side="right")) - lo), int(ids[m]))
    quick = ~slow
    while quick.any():  # of one layout, as wide as any that is left
        some = int(width[quick].max())
        mine = np.flatnonzero(quick & (count <= 63 // (some + 1)))
        quick[mine] = False
        yield from solve_bits(mine, ids, at, kind, dst, src, np.where(none["off"], -1, off), cols["len"], zero, pair, number, size_of, of, some, field_limit)


def solve_bits(mine, ids, at, kind, dst, src, off, length, zero, pair, number, size_of, of, width, field_limit) -> Iterator[pa.Table]:
    """solve_tables() of the modules mine, numbers in ids, whose sets fit."""
    m_of = np.full(len(ids), -1)
    m_of[mine] = np.arange(len(mine))
    held = np.flatnonzero(m_of[pair[:, 0]] >= 0)
    sizes = np.ones((len(mine), int(number[held].max(initial=0)) + 1), np.int64)
    sizes[m_of[pair[held, 0]], number[held]] = size_of[held]
    sizes = np.minimum(sizes, width)
    object_id = np.zeros(sizes.shape, np.int64)
    object_id[m_of[pair[held, 0]], number[held]] = pair[held, 1]
    rules = np.flatnonzero((m_of[at] >= 0) & (kind < 7))
    of_rule = m_of[at[rules]]
    # nodes by module and name
    names = np.unique(np.concatenate([dst[rules], np.where(kind[rules] < 5, src[rules], dst[rules])]))
    wide = len(names) + 1
    a = of_rule * wide + np.searchsorted(names, dst[rules])
    b = np.where(kind[rules] < 5, of_rule * wide + np.searchsorted(names, np.where(kind[rules] < 5, src[rules], dst[rules])), a)
    nodes = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    sets = Sets(len(nodes), sizes, width)
    starts = np.flatnonzero((m_of[at] >= 0) & zero)
    at_zero = of(at[starts], dst[starts])
    sets.cells[number[at_zero], 0, m_of[at[starts]]] |= Sets.NULL
    k = kind[rules]
    alloc = np.flatnonzero(k == 5)
    sets.join(a[alloc], np.uint64(1) << (number[of(at[rules[alloc]], src[rules[alloc]])] * sets.step + 1).astype(np.uint64))
    sets.join(a[k == 6], np.full(int((k == 6).sum()), Sets.NULL))
    # each rule once, sorted by module
    by = {}
    for code in range(5):
        one = np.flatnonzero(k == code)
        more = np.clip(off[rules[one]], -1, sets.width) if code == 1 else np.clip(length[rules[one]], 0, sets.width) if code == 4 else np.zeros(len(one), np.int64)
        if len(one):
            keep = np.unique(np.stack([of_rule[one], a[one], b[one], more]), axis=1)
            by[code] = [keep[0], keep[1], keep[2], keep[3]]
    owner = nodes // wide
    active = np.ones(len(mine), bool)
    while active.any():
        now = {code: [c[active[r[0]]] for c in r] for code, r in by.items()}
        before, cells = sets.pt.copy(), sets.cells.copy()
        for code, (m, to, from_, more) in now.items():
            if not len(m):
                continue
            if code > 2:  # the rules that have something to write
                some = np.flatnonzero((sets.pt[to] != 0) & (sets.pt[from_] != 0))
                if not len(some):
                    continue
                m, to, from_, more = m[some], to[some], from_[some], more[some]
            if code == 0:
                sets.join(to, sets.pt[from_])
            elif code == 1:
                for d in np.unique(more):
                    at_d = np.flatnonzero(more == d)
                    sets.join(to[at_d], sets.moved(sets.pt[from_[at_d]], int(d), m[at_d]))
            elif code == 2:
                sets.join(to, sets.loaded(sets.pt[from_], m))
            else:
                first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                got = sets.stored(sets.pt[to], sets.pt[from_]) if code == 3 else sets.copied(sets.pt[to], sets.pt[from_], more, m)
                sets.write(got, first, m[first])
        active = (cells != sets.cells).any(axis=(0, 1))
        active[owner[before != sets.pt]] = True

    def told(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))

    def places(m: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        null = bit == 63
        return np.where(null, NULL_, object_id[m, np.where(null, 0, bit // sets.step)]), np.where(null, 0, bit % sets.step - 1)

    for x in range(0, len(nodes), 100_000):
        i, bit = told(sets.pt[x : x + 100_000])
        m = owner[x + i]
        yield pa.table([ids[mine[m]], np.zeros(len(i), np.int32), names[nodes[x + i] % wide], np.zeros(len(i), np.int64), *places(m, bit)], names=["module", "r", "a", "b", "tgt", "off"])
    full = np.flatnonzero(sets.cells.ravel())
    for x in range(0, len(full), 100_000):
        i, bit = told(sets.cells.ravel()[full[x : x + 100_000]])
        rest, m = np.divmod(full[x + i], len(mine))
        yield pa.table([ids[mine[m]], np.ones(len(i), np.int32), object_id[m, rest // sets.step], rest % sets.step - 1, *places(m, bit)], names=["module", "r", "a", "b", "tgt", "off"])


#: A call by pointer passes node off to the parameter and takes the result; a fork does the first, a join the second.
CALLS = ("call", "fork", "join")


def analyse(cons: DataFrame, objects: DataFrame, field_limit: int = 1 << 60, large: int = LARGE, functions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pt, mem), flow-insensitive, before absorption. functions(module, obj, param, result): what calls, forks and joins by
    a pointer to obj are wired to, as soon as it is found to point there.

    Modules are independent: those of up to large constraints are solved in one pass where their rows meet, side by side
    if they have no calls and few places; larger ones are solved together by rounds over relations, analyse_large(). A load of an object that is zero-initialised always may give
    null.
    """
    few, many = split_by_size(cons, ["module"], large)
    parts = []
    if few is not None:
        rows = cons.select("module", "kind", "dst", "src", "off", "len").unionByName(objects.select("module", F.lit("object").alias("kind"), F.col("obj").alias("dst"), F.col("zero").cast("long").alias("src"), F.col("size").alias("off"), F.lit(None).cast("long").alias("len")))
        if functions is not None:
            rows = rows.unionByName(functions.select("module", F.lit("function").alias("kind"), F.col("obj").alias("dst"), F.col("param").alias("src"), F.col("result").alias("off"), F.lit(None).cast("long").alias("len")))
        rows = rows if many is None else rows.join(few, "module", "left_semi")

        told = materialize(many_groups(rows, "module", lambda table: solve_tables(table, field_limit), STATE), "points-to")
        parts.append((told.where("r = 0").select("module", F.col("a").alias("n"), "tgt", "off"), told.where("r = 1").select("module", F.col("a").alias("obj"), F.col("b").alias("off"), "tgt", F.col("off").alias("toff"))))
    if many is not None or not parts:
        mine = (lambda df: df.join(many, "module", "left_semi")) if many is not None else (lambda df: df)
        parts.append(analyse_large(mine(cons), mine(objects), field_limit, None if functions is None else mine(functions)))
    pt, mem = parts[0]
    return (pt.unionByName(parts[1][0]), mem.unionByName(parts[1][1])) if parts[1:] else (pt, mem)


def analyse_large(cons: DataFrame, objects: DataFrame, field_limit: int = 1 << 60, functions: DataFrame | None = None, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """analyse() for modules of any size, all at once. Semi-naive: a rule joins what a round has added with everything known."""
    c = lambda *kinds: cons.where(F.col("kind").isin(*kinds))
    size = objects.select("module", F.col("obj").alias("tgt"), "size")
    copy, gep, store, load, move = (c(k).select("module", "dst", "src", "off", "len") for k in ("copy", "gep", "store", "load", "memcpy"))
    pt = c("alloc").select("module", F.col("dst").alias("n"), F.col("src").alias("tgt"), F.lit(0).cast("long").alias("off"))
    pt = pt.unionByName(c("null").select("module", F.col("dst").alias("n"), F.lit(NULL_).cast("long").alias("tgt"), F.lit(0).cast("long").alias("off")))
    pt = dpt = materialize(pt.distinct(), "pt")
    zero = objects.where("zero").select("module", "obj", F.lit(-1).cast("long").alias("off"), F.lit(NULL_).cast("long").alias("tgt"), F.lit(0).cast("long").alias("toff"))
    mem = dmem = materialize(zero.distinct(), "mem")

    def of(points: DataFrame, end: str) -> DataFrame:
        """points by the operand they belong to: dst or src, with target x and offset xo prefixed by it."""
        return points.select("module", F.col("n").alias(end), F.col("tgt").alias(f"{end}_tgt"), F.col("off").alias(f"{end}_off"))

    def loads(points: DataFrame, cells: DataFrame) -> DataFrame:
        p = load.join(of(points, "src"), ["module", "src"]).where("src_tgt >= 0")
        m = cells.select("module", F.col("obj").alias("src_tgt"), F.col("off").alias("o"), "tgt", "toff")
        exact = p.where("src_off >= 0").join(m.where("o >= 0"), (["module", "src_tgt"])).where("src_off = o")
        any_cell = p.where("src_off >= 0").join(m.where("o < 0"), ["module", "src_tgt"])
        any_off = p.where("src_off < 0").join(m, ["module", "src_tgt"])
        got = exact.unionByName(any_cell).unionByName(any_off)
        return got.select("module", F.col("dst").alias("n"), "tgt", F.col("toff").alias("off"))

    def stores(where: DataFrame, what: DataFrame) -> DataFrame:
        s = store.join(of(where, "dst"), ["module", "dst"]).where("dst_tgt >= 0").join(of(what, "src"), ["module", "src"])
        return s.select("module", F.col("dst_tgt").alias("obj"), F.col("dst_off").alias("off"), F.col("src_tgt").alias("tgt"), F.col("src_off").alias("toff"))

    def moves(points: DataFrame, cells: DataFrame) -> DataFrame:
        s = move.join(of(points, "dst"), ["module", "dst"]).where("dst_tgt >= 0").join(of(points, "src"), ["module", "src"]).where("src_tgt >= 0")
        m = cells.select("module", F.col("obj").alias("src_tgt"), F.col("off").alias("o"), "tgt", "toff")
        s = s.join(m, ["module", "src_tgt"]).where("src_off < 0 OR o < 0 OR len IS NULL OR (o >= src_off AND o < src_off + len)")
        s = s.join(size.select("module", F.col("tgt").alias("dst_tgt"), "size"), ["module", "dst_tgt"], "left")
        off = f"CASE WHEN src_off < 0 OR o < 0 OR dst_off < 0 THEN -1L WHEN (dst_off + o - src_off = 0 OR dst_off + o - src_off < coalesce(size, 0)) AND dst_off + o - src_off < {field_limit}L THEN dst_off + o - src_off ELSE -1L END"
        return s.select("module", F.col("dst_tgt").alias("obj"), F.expr(off).alias("off"), "tgt", "toff")

    has_moves = not move.isEmpty()
    called = c(*CALLS).select("module", "kind", "dst", "src", F.col("off").alias("arg"))
    wired = None if functions is None else materialize(copy.select("module", "dst", "src").limit(0), "wired")
    for round_ in range(max_rounds):
        copied = copy.join(of(dpt, "src"), ["module", "src"]).select("module", F.col("dst").alias("n"), F.col("src_tgt").alias("tgt"), F.col("src_off").alias("off"))
        moved = gep.join(of(dpt, "src"), ["module", "src"]).join(size.withColumnRenamed("tgt", "src_tgt"), ["module", "src_tgt"], "left")
        moved = moved.select("module", F.col("dst").alias("n"), F.col("src_tgt").alias("tgt"), F.expr(f"CASE WHEN src_tgt < 0 THEN src_off ELSE {shifted('src_off', 'off', 'size', field_limit)} END").alias("off"))
        found = copied.unionByName(moved).unionByName(loads(dpt, mem)).unionByName(loads(pt, dmem))
        if wired is not None:  # what points to a function now copies arguments and results, old ones too
            hit = called.join(of(dpt, "src"), ["module", "src"]).join(functions.select("module", F.col("obj").alias("src_tgt"), "param", "result"), ["module", "src_tgt"])
            one = hit.where("kind <> 'join'").select("module", F.col("param").alias("dst"), F.col("arg").alias("src")).unionByName(hit.where("kind <> 'fork'").select("module", "dst", F.col("result").alias("src")))
            fresh = materialize(one.distinct(), "wired")
            copies = lambda by, points: by.join(of(points, "src"), ["module", "src"]).select("module", F.col("dst").alias("n"), F.col("src_tgt").alias("tgt"), F.col("src_off").alias("off"))
            found = found.unionByName(copies(fresh, pt)).unionByName(copies(wired, dpt))
            wired = wired.unionByName(fresh)
        cells = stores(dpt, pt).unionByName(stores(pt, dpt))
        if has_moves:
            cells = cells.unionByName(moves(pt, mem))
        dpt = materialize(found.distinct().join(pt, PT, "left_anti"), "pt")
        dmem = materialize(cells.distinct().join(mem, MEM, "left_anti"), "mem")
        if dpt.isEmpty() and dmem.isEmpty():
            return pt, mem
        pt, mem = pt.unionByName(dpt), mem.unionByName(dmem)
        if round_ % 8 == 7:
            pt, mem = materialize(pt, "pt"), materialize(mem, "mem")
    raise NotConverged(f"pointer analysis: {max_rounds} rounds")


def solve_flow(rows: list[tuple], field_limit: int, invalidate: bool) -> dict:
    """pt of one module, flow-sensitive: rows (kind, dst, src, off, len, pos) in program order by pos, edges between positions
    as (edge, from, to, null, null, null) and objects as in solve_columns().

    Memory is told apart by position: a store through a pointer with one known place in an object that is allocated once
    replaces what the place held, any other store adds; where paths join, sets join. free drops an object; with invalidate
    what pointed to it is INVALIDATED, and so is, at a join, a place that only some paths have written.
    """
    size, zero, pt = {}, set(), {}
    steps: dict[int, tuple] = {}
    before: dict[int, list[int]] = {}
    after: dict[int, list[int]] = {}
    made: dict[int, int] = {}
    for kind, dst, src, off, length, pos in rows:
        if kind == "object":
            size[dst] = off or 0
            if src:
                zero.add(dst)
        elif kind == "edge":
            before.setdefault(src, []).append(dst)
            after.setdefault(dst, []).append(src)
        else:
            steps[pos] = (kind, dst, src, off, length)
            if kind == "alloc":
                made[src] = made.get(src, 0) + 1
    # a set is an int with a bit for each place; a cell's place is the number of its object and offset
    places: list[tuple[int, int]] = []
    number: dict[tuple[int, int], int] = {}
    here: dict[int, list[int]] = {}

    def bit(place: tuple[int, int]) -> int:
        n = number.get(place)
        if n is None:
            n = number[place] = len(places)
            places.append(place)
        return 1 << n

    def parts(held: int) -> Iterator[tuple[int, int]]:
        while held:
            low = held & -held
            yield places[low.bit_length() - 1]
            held ^= low

    def all_of(obj: int) -> int:
        """The places in an object that are known so far."""
        n, held = here.get(obj, (0, 0))
        for i in range(n, len(places)):
            if places[i][0] == obj:
                held |= 1 << i
        here[obj] = (len(places), held)
        return held

    def cells(mem: dict, t: int, o: int):
        return [(at, held) for (obj, at), held in mem.items() if obj == t and (o < 0 or at in (o, UNKNOWN))]

    out: dict[int, dict] = {pos: {} for pos in steps}
    readers: dict[int, set[int]] = {}  # the steps that a node's set is an operand of
    for pos, (kind, dst, src, *_) in steps.items():
        if kind not in ("alloc", "null"):
            readers.setdefault(src, set()).add(pos)
        if kind in ("store", "memcpy"):
            readers.setdefault(dst, set()).add(pos)
    entries = {pos: [p for p in before.get(pos, ()) if p in out] for pos in steps}
    lost = bit((INVALIDATED, 0))
    writes = {pos for pos, (kind, _, src, *_) in steps.items() if kind in ("store", "memcpy") or kind == "free" and invalidate or kind == "alloc" and src in zero}
    inside: dict[int, dict] = {}  # memory before a step, as long as that stands
    moved = set(steps)  # the steps before which memory has changed
    # a round walks all steps, or those behind a change of memory; a step is done again only if something that it reads has
    # changed since, as it tells the same otherwise
    stale = set(steps)
    everywhere = waiting = sorted(steps)
    while waiting:
        again: set[int] = set()
        all_again = False
        for pos in waiting:
            if pos not in stale:
                continue
            stale.discard(pos)
            kind, dst, src, off, length = steps[pos]
            fresh = pos in moved
            if fresh:
                moved.discard(pos)
                joined = [out[p] for p in entries[pos]]
                mem = joined[0] if len(joined) == 1 else {}
                for m in joined if len(joined) > 1 else ():
                    for at, held in m.items():
                        mem[at] = mem.get(at, 0) | held
                if invalidate and len(joined) > 1:
                    for at in mem:
                        if any(at not in m for m in joined):
                            mem[at] |= lost
                inside[pos] = mem
            mem = dict(inside[pos]) if pos in writes else inside[pos]
            from_, got = pt.get(src, 0), 0
            if kind == "alloc":
                got = bit((src, 0))
                if src in zero:
                    mem[src, UNKNOWN] = mem.get((src, UNKNOWN), 0) | bit((NULL_, 0))
            elif kind == "null":
                got = bit((NULL_, 0))
            elif kind == "copy":
                got = from_
            elif kind == "gep":
                for t, o in parts(from_):
                    got |= bit((t, o) if t < 0 else (t, moved_offset(o, off, size.get(t, 0), field_limit)))
            elif kind == "load":
                for t, o in parts(from_):
                    if t >= 0:
                        for _, held in cells(mem, t, o):
                            got |= held
            elif kind == "store":
                to = pt.get(dst, 0)
                only = places[to.bit_length() - 1] if to and not to & to - 1 else None
                if only and only[0] >= 0 and only[1] >= 0 and made.get(only[0], 0) <= 1:
                    mem[only] = from_
                else:
                    for place in parts(to):
                        if place[0] >= 0:
                            mem[place] = mem.get(place, 0) | from_
            elif kind == "memcpy":
                for t, o in parts(pt.get(dst, 0)):
                    for st, so in parts(from_) if t >= 0 else ():
                        for at, held in cells(mem, st, UNKNOWN) if st >= 0 else ():
                            if so < 0 or at < 0 or length is None or so <= at < so + length:
                                where = (t, UNKNOWN if so < 0 or at < 0 or o < 0 else moved_offset(o + at - so, 0, size.get(t, 0), field_limit))
                                mem[where] = mem.get(where, 0) | held
            elif kind == "free" and invalidate:
                dead = {t for t, _ in parts(from_) if t >= 0}
                gone = 0
                for t in dead:
                    gone |= all_of(t)
                for at, held in mem.items():
                    if held & gone:
                        mem[at] = (held if len(dead) > 1 else held & ~gone) | lost
            have = pt.get(dst, 0)
            if got & ~have:
                pt[dst] = have | got
                all_again = True
                stale |= readers.get(dst, set())
            mine, grown = out[pos], False
            for at, held in mem.items() if fresh or pos in writes else ():
                had = mine.get(at)
                if had is None or held & ~had:
                    mine[at] = held | (had or 0)
                    grown = True
            if grown:
                behind = [x for x in after.get(pos, ()) if x in steps]
                again.update(behind)
                stale.update(behind)
                moved.update(behind)
        waiting = everywhere if all_again else sorted(again)
        if not stale:
            break
    return {n: set(parts(held)) for n, held in pt.items()}


def analyse_flow(cons: DataFrame, edges: DataFrame, objects: DataFrame, field_limit: int = 1 << 60, invalidate: bool = False) -> DataFrame:
    """pt, flow-sensitive, of cons(module, pos, kind, dst, src, off, len) along edges(module, src, dst) of positions; each
    module is solved where its rows meet, as solve_flow() says. Only the least pos is entered from outside."""
    none = lambda name: F.lit(None).cast("long").alias(name)
    cols = ["module", "kind", "dst", "src", "off", "len", "pos"]
    rows = cons.select(cols).unionByName(edges.select("module", F.lit("edge").alias("kind"), F.col("src").alias("dst"), F.col("dst").alias("src"), none("off"), none("len"), none("pos")))
    rows = rows.unionByName(objects.select("module", F.lit("object").alias("kind"), F.col("obj").alias("dst"), F.col("zero").cast("long").alias("src"), F.col("size").alias("off"), none("len"), none("pos")))

    def solve(_, group):
        yield from ((n, t, o) for n, held in solve_flow(group, field_limit, invalidate).items() for t, o in held)

    return materialize(per_group(rows, ["module"], solve, "module long, n long, tgt long, off long"), "flow-points-to")  # read several times


def covers(pt: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, n, obj, lo, hi): regions of nodes(module, n, len) with those inside others of the node left out; an unknown
    offset is the whole object, lo 0 and hi null."""
    all_ = accessed(pt, nodes).where("obj IS NOT NULL").select("module", "n", "obj", F.coalesce("off", F.lit(0)).alias("lo"), (F.col("off") + F.col("len") - 1).alias("hi")).distinct()
    end = F.coalesce("hi", F.lit((1 << 62) - 1))
    w = Window.partitionBy("module", "n", "obj").orderBy("lo", end.desc()).rowsBetween(Window.unboundedPreceding, -1)
    top = all_.withColumn("top", F.max(end).over(w))
    return top.where(F.col("top").isNull() | (end > F.col("top"))).select("module", "n", "obj", "lo", "hi")


def without_unknown(cons: DataFrame, pt: DataFrame) -> DataFrame:
    """cons without loads and stores whose pointer points to nothing known in pt: they can't add anything."""
    known = pt.where("tgt >= 0").select("module", F.col("n").alias("through")).distinct()
    through = F.when(F.col("kind") == "load", F.col("src")).when(F.col("kind") == "store", F.col("dst"))
    marked = cons.withColumn("through", through)
    return marked.where("through IS NULL").unionByName(marked.where("through IS NOT NULL").join(known, ["module", "through"], "left_semi").select(marked.columns)).select(cons.columns)


def absorbed(pt: DataFrame) -> DataFrame:
    """Concrete offsets go where a set has the same target with an unknown one."""
    known = pt.where("off < 0").select("module", "n", "tgt").distinct()
    return pt.where("off < 0").unionByName(pt.where("off >= 0").join(known, ["module", "n", "tgt"], "left_anti"))


def add(pt: DataFrame, rows: DataFrame) -> DataFrame:
    return absorbed(pt.unionByName(rows).distinct())


def remove(pt: DataFrame, rows: DataFrame) -> DataFrame:
    return pt.join(rows, PT, "left_anti")


def remove_any(pt: DataFrame, targets: DataFrame) -> DataFrame:
    """pt without any pointer to targets(module, tgt), whatever its offset."""
    return pt.join(targets, ["module", "tgt"], "left_anti").select(PT)


def properties(pt: DataFrame) -> DataFrame:
    """(module, n, size, singleton, has_unknown, has_null, has_invalidated)."""
    has = lambda t: F.coalesce(F.bool_or(F.col("tgt") == t), F.lit(False))
    return pt.groupBy("module", "n").agg(F.count("*").alias("size"), (F.count("*") == 1).alias("singleton"), has(UNKNOWN).alias("has_unknown"), has(NULL_).alias("has_null"), has(INVALIDATED).alias("has_invalidated"))


def may_point(pt: DataFrame, q: DataFrame) -> DataFrame:
    """(module, n, tgt, off, may, must) for pointers q(module, n, tgt, off): an unknown offset or target may be it."""
    per = pt.groupBy("module", "n").agg(F.count("*").alias("size"), F.bool_or(F.col("tgt") == UNKNOWN).alias("any"))
    hit = pt.select("module", "n", "tgt", F.col("off").alias("o")).join(q, ["module", "n", "tgt"]).where("o = off OR o < 0").groupBy(PT).agg(F.bool_or(F.col("o") == F.col("off")).alias("same"))
    out = q.join(hit, PT, "left").join(per, ["module", "n"], "left")
    no = F.lit(False)
    return out.select(*PT, (F.col("same").isNotNull() | F.coalesce("any", no)).alias("may"), (F.coalesce("same", no) & (F.col("size") == 1) & (F.col("off") >= 0)).alias("must"))


def alias(pt: DataFrame, pairs: DataFrame) -> DataFrame:
    """(module, a, b, verdict) of pairs(module, a, b): MustAlias (both point to one same place), MayAlias (some place in
    common, or one of them unknown), NoAlias."""
    p = absorbed(pt)
    one = p.groupBy("module", "n").agg(F.count("*").alias("size"), F.max(F.struct("tgt", "off")).alias("only"), F.bool_or(F.col("tgt") == UNKNOWN).alias("any"))
    x = p.select("module", F.col("n").alias("a"), "tgt", F.col("off").alias("ao"))
    y = p.select("module", F.col("n").alias("b"), "tgt", F.col("off").alias("bo"))
    meet = pairs.join(x, ["module", "a"]).join(y, ["module", "b", "tgt"]).where("tgt >= 0 AND (ao = bo OR ao < 0 OR bo < 0)").select("module", "a", "b", F.lit(True).alias("meet")).distinct()
    out = pairs.join(meet, ["module", "a", "b"], "left")
    for side in "ab":
        out = out.join(one.select("module", F.col("n").alias(side), F.col("size").alias(f"s{side}"), F.col("only").alias(f"o{side}"), F.col("any").alias(f"u{side}")), ["module", side], "left")
    must = F.expr("sa = 1 AND sb = 1 AND oa = ob AND oa.off >= 0 AND oa.tgt >= 0")
    verdict = F.when(must, "MustAlias").when(F.expr("meet OR ua OR ub"), "MayAlias").otherwise("NoAlias")
    return out.select("module", "a", "b", verdict.alias("verdict"))


def accessed(pt: DataFrame, access: DataFrame) -> DataFrame:
    """(module, n, obj, off, len): memory regions of accesses(module, n, len); unknown parts are null."""
    got = access.join(pt, ["module", "n"])
    return got.select("module", "n", F.when(F.col("tgt") >= 0, F.col("tgt")).alias("obj"), F.when(F.col("off") >= 0, F.col("off")).alias("off"), F.when(F.col("off") >= 0, F.col("len")).alias("len"))


def difference(a: DataFrame, b: DataFrame, unknown_offset_covers: bool = True, unknown_covers: bool = True) -> DataFrame:
    """Pointers of a that b lacks; an unknown offset, or the unknown target, in b may cover them."""
    out = a.join(b, PT, "left_anti")
    if unknown_offset_covers:
        out = out.join(b.where("off < 0").select("module", "n", "tgt"), ["module", "n", "tgt"], "left_anti")
    if unknown_covers:
        out = out.join(b.where(F.col("tgt") == UNKNOWN).select("module", "n"), ["module", "n"], "left_anti")
    return out.select(PT)


def statistics(pt: DataFrame) -> DataFrame:
    """(module, n_sets, n_pointers, max_size, n_singletons, n_unknown_offsets, n_null)."""
    per = pt.groupBy("module", "n").agg(F.count("*").alias("c"), F.sum((F.col("off") < 0).cast("long")).alias("u"), F.sum((F.col("tgt") == NULL_).cast("long")).alias("z"))
    return per.groupBy("module").agg(F.count("*").alias("n_sets"), F.sum("c").alias("n_pointers"), F.max("c").alias("max_size"), F.sum((F.col("c") == 1).cast("long")).alias("n_singletons"), F.sum("u").alias("n_unknown_offsets"), F.sum("z").alias("n_null"))


def representatives(cons: DataFrame) -> DataFrame:
    """(module, old, new): nodes whose only constraint copies another (casts, one-operand phis, geps by 0) stand for the end
    of their chain of copies; found by doubling the pointers. Cycles of such copies keep their own names."""
    single = Window.partitionBy("module", "dst")
    only = cons.where("kind IN ('copy', 'gep', 'load', 'alloc', 'null')").withColumn("c", F.count("*").over(single))
    up = only.where("c = 1 AND (kind = 'copy' OR (kind = 'gep' AND off = 0)) AND dst <> src").select("module", F.col("dst").alias("old"), F.col("src").alias("new"))
    for _ in range(40):
        nxt = up.alias("x").join(up.alias("y"), F.expr("x.module = y.module AND x.new = y.old"), "left").select("x.module", "x.old", F.coalesce("y.new", "x.new").alias("new"), (F.col("y.new").isNotNull() & (F.col("y.new") != F.col("x.new"))).alias("moved"))
        nxt = materialize(nxt, "representatives")
        going = nxt.where("moved AND old <> new")
        up = nxt.select("module", "old", "new")
        if going.isEmpty():
            break
    ends = up.select("module", F.col("old").alias("new"))  # what still points on is on a cycle
    return up.where("old <> new").join(ends, ["module", "new"], "left_anti").select("module", "old", "new")


def optimised(cons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(constraints, mapping): equivalent nodes merged, no-ops removed; results are the same for mapped nodes."""
    rep = materialize(representatives(cons), "representatives")
    out = cons
    for end in ("dst", "src"):
        r = rep.select("module", F.col("old").alias(end), "new")
        keep = F.col("new") if end == "dst" else F.when(F.col("kind") != "alloc", F.col("new"))
        out = out.join(r, ["module", end], "left").withColumn(end, F.coalesce(keep, F.col(end))).drop("new")
    out = out.where("NOT (kind IN ('copy', 'gep') AND dst = src AND coalesce(off, 0) = 0)").select(cons.columns).distinct()
    return out, rep
