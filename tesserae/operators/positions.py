"""Position arithmetic within one document: phrases and span proximity.

Everything is an expression over arrays of positions.  Several sorted lists are
merged into one array, each element with the number of its list, and one fold
over it keeps what the next element needs to know: for each list, or each
prefix of the lists, one element.  So a document costs as many steps as it has
positions of the query's terms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int>>"
#: Spans that a fold appends to one array; longer output is an array of these.
OUT_BLOCK = 64


def exact_freq(slots: Sequence[Column], positions: Sequence[int]) -> Column:
    """Places at which every slot stands at its own offset."""
    shifted = [_shifted(s, k) for s, k in zip(slots, positions)]
    common = shifted[0]
    for s in shifted[1:]:
        common = F.array_intersect(common, s)
    return F.size(F.array_distinct(common)).cast("double")


def _shifted(s: Column, k: int) -> Column:
    return F.transform(s, lambda p: p - k)


def _numbered(lists: Sequence[Column], element: Callable[[Column, int], Column]) -> Column:
    """All elements of the lists, each made with its list's number, in one array."""

    def of(i: int) -> Callable[[Column], Column]:
        return lambda x: element(x, i)  # one parameter, since Spark counts them

    return F.concat(*[F.transform(own, of(i)) for i, own in enumerate(lists)])


def _all_some(arrays: Sequence[Column]) -> Column:
    some = F.lit(True)
    for a in arrays:
        some = some & (F.size(a) > 0)
    return some


def _where_all(arrays: Sequence[Column], made: Column, kind: str) -> Column:
    """``made`` where no array is empty: other rows cost no fold."""
    return F.when(_all_some(arrays), made).otherwise(F.array().cast(kind))


# --- sloppy phrases ----------------------------------------------------------------------------


def sloppy_freq(slots: Sequence[Column], positions: Sequence[int], slop: int, terms: Sequence[frozenset]) -> Column:
    """The sum of 1 / (1 + width) over the windows of at most ``slop``.

    A position less its slot's offset is a value; a phrase in order has equal
    values.  Values are read in ascending order, those of one slot in a row as a
    run; equal values of several slots begin with the slot of the run before,
    which they prolong.  The last value of each run starts a window, up to the
    greatest of the values that come next in the other slots, if all have one.

    Slots that may hold the same term must stand at different places: the start's
    is taken, and slot after slot the next value at a place still free counts.
    """
    n = len(slots)
    kind = "array<struct<v:int,k:int,p:int>>"
    merged = _numbered(slots, lambda p, i: F.struct((p - positions[i]).alias("v"), F.lit(i).alias("k"), p.alias("p")))
    merged = _where_all(slots, F.array_sort(merged), kind)
    # runs: equal values stand together; where the run before has one of them, it goes first
    follow = F.aggregate(
        merged,
        F.struct(F.array().cast(kind).alias("done"), F.array().cast(kind).alias("same"), F.lit(-1).alias("run")),
        lambda acc, x: _take(acc, x, kind),
        lambda acc: _flushed(acc)["done"],
    )
    twins = [[k for k in range(n) if k != i and terms[k] & terms[i]] for i in range(n)]
    # from the end: for each slot the values that come next, and whose run the element after belongs to
    none = F.array().cast("array<struct<v:int,p:int>>")
    empty = F.struct(F.array(*[none] * n).alias("next"), F.lit(-1).alias("after"), F.lit(0.0).alias("sum"))
    most = 1 + max(map(len, twins))
    return F.aggregate(F.reverse(follow), empty, lambda acc, x: _window(acc, x, n, slop, twins, most), lambda acc: acc["sum"])


def _take(acc: Column, x: Column, kind: str) -> Column:
    new = (F.size(acc["same"]) > 0) & (F.element_at(acc["same"], -1)["v"] < x["v"])
    flushed = _flushed(acc)
    alone = F.array(x).cast(kind)
    return F.struct(
        F.when(new, flushed["done"]).otherwise(acc["done"]).alias("done"),
        F.when(new, alone).otherwise(F.concat(acc["same"], alone)).alias("same"),
        F.when(new, flushed["run"]).otherwise(acc["run"]).alias("run"),
    )


def _flushed(acc: Column) -> Column:
    mine = F.filter(acc["same"], lambda y: y["k"] == acc["run"])
    rest = F.filter(acc["same"], lambda y: y["k"] != acc["run"])
    done = F.concat(acc["done"], mine, rest)
    return F.struct(done.alias("done"), F.coalesce(F.try_element_at(done, F.lit(-1))["k"], F.lit(-1)).alias("run"))


def _window(acc: Column, x: Column, n: int, slop: int, twins: list[list[int]], most: int) -> Column:
    own = F.struct(x["v"].alias("v"), x["p"].alias("p"))
    ends: list[Column] = []
    for j in range(n):
        values = acc["next"][j]
        if twins[j]:
            # what this slot may not stand on: the start, if its slot is one of them, and the places chosen before
            start = F.when(x["k"].isin(twins[j]), x["p"])
            values = _free(values, [start, *[ends[i]["p"] for i in twins[j] if i < j]])
        ends.append(F.when(x["k"] == j, own).otherwise(F.get(values, 0)))
    whole = ends[0].isNotNull()
    for e in ends[1:]:
        whole = whole & e.isNotNull()
    width = F.array_max(F.array(*[e["v"] for e in ends])) - x["v"]
    counts = whole & (acc["after"] != x["k"]) & (width <= slop)
    moved = F.transform(acc["next"], lambda values, k: F.when(k == x["k"], F.slice(F.concat(F.array(own), values), 1, most)).otherwise(values))
    return F.struct(moved.alias("next"), x["k"].alias("after"), (acc["sum"] + F.when(counts, 1.0 / (1 + width)).otherwise(0.0)).alias("sum"))


def _free(values: Column, taken: list[Column]) -> Column:
    free = values
    for place in taken:
        free = _without(free, place)
    return free


def _without(values: Column, place: Column) -> Column:
    return F.filter(values, lambda y: ~y["p"].eqNullSafe(place))


# --- spans -------------------------------------------------------------------------------------


def unordered_windows(lists: Sequence[Column], slop: int) -> Column:
    """From each span up to the furthest end among the spans that come next in the other lists, if they leave at most ``slop`` uncovered."""
    n = len(lists)
    merged = _numbered(lists, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(i).alias("k")))
    merged = _where_all(lists, F.array_sort(merged), "array<struct<s:int,e:int,k:int>>")
    never = F.lit(None).cast("struct<s:int,e:int>")

    def step(acc: Column, x: Column) -> Column:
        following = F.transform(acc["next"], lambda y, k: F.when(k == x["k"], F.struct(x["s"].alias("s"), x["e"].alias("e"))).otherwise(y))
        end = F.aggregate(following, x["e"], lambda m, y: F.greatest(m, y["e"]))
        covered = F.aggregate(following, F.lit(0), lambda t, y: t + y["e"] - y["s"])
        found = ~F.exists(following, lambda y: y.isNull()) & (end - x["s"] - covered <= slop)
        return F.struct(following.alias("next"), F.when(found, F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), end.alias("e"))))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.array(*[never] * n).alias("next"), F.array().cast(SPANS).alias("out"))
    return F.reverse(F.aggregate(F.reverse(merged), start, step, lambda acc: acc["out"]))


def ordered_windows(lists: Sequence[Column], slop: int) -> Column:
    """The windows in which one span of each list follows that of the list before, and that hold no other such window.

    For each prefix of the lists the latest chain of spans is kept: its start,
    the start and end of its last span, and the sum of its gaps.  A span of the
    last list ends a window with the latest chain before it; a later span with
    the same chain would only widen it.  Windows with gaps of ``slop`` at most count.
    """
    n = len(lists)
    # of equal spans the later list's comes first, so that none follows its equal
    merged = _numbered(lists, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(-i).alias("k")))
    merged = _where_all(lists, F.array_sort(merged), "array<struct<s:int,e:int,k:int>>")
    chain = "struct<begin:int,s:int,e:int,gaps:int>"
    never = F.lit(None).cast(chain)

    def step(acc: Column, x: Column) -> Column:
        before = F.get(acc["chains"], -x["k"] - 1)
        first = F.struct(x["s"].alias("begin"), x["s"].alias("s"), x["e"].alias("e"), F.lit(0).alias("gaps"))
        longer = F.when(before.isNotNull(), F.struct(before["begin"].alias("begin"), x["s"].alias("s"), x["e"].alias("e"), (before["gaps"] + F.greatest(F.lit(0), x["s"] - before["e"])).alias("gaps")))
        own = F.when(x["k"] == 0, first).otherwise(longer)
        ends = (x["k"] == 1 - n) & own.isNotNull() & (own["begin"] > acc["last"])
        return F.struct(
            F.transform(acc["chains"], lambda c, k: F.when(k == -x["k"], F.coalesce(own, c)).otherwise(c)).alias("chains"),
            F.when(ends, own["begin"]).otherwise(acc["last"]).alias("last"),
            F.when(ends & (own["gaps"] <= slop), F.concat(acc["out"], F.array(F.struct(own["begin"].alias("s"), x["e"].alias("e"))))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.array(*[never] * n).alias("chains"), F.lit(-1).alias("last"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(merged, start, step, lambda acc: acc["out"])


def near(slop: int, in_order: bool) -> Callable[..., Column]:
    """Spans of a proximity query over sorted span columns."""
    return lambda *spans: (ordered_windows if in_order else unordered_windows)(spans, slop)


def outside(include: Column, exclude: Column) -> Column:
    """Spans that overlap none of the others, in order.

    One fold over the excluded spans by start and the included ones by end knows
    the furthest end of all excluded spans that start before an included one ends.
    Both are read once: within a lambda, a span list would be made anew for each span.
    """
    event = lambda at, kind: lambda x: F.struct(x[at].alias("at"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    # at one place the end of an included span comes first, since spans that meet do not overlap
    merged = F.sort_array(F.concat(F.transform(include, event("e", 0)), F.transform(exclude, event("s", 1))))

    def step(acc: Column, x: Column) -> Column:
        kept = (x["kind"] == 0) & (acc["reach"] <= x["s"])
        full = F.size(acc["out"]) >= OUT_BLOCK
        own = F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.struct(
            F.when(x["kind"] == 1, F.greatest(acc["reach"], x["e"])).otherwise(acc["reach"]).alias("reach"),
            F.when(kept & full, F.concat(acc["done"], F.array(acc["out"]))).otherwise(acc["done"]).alias("done"),
            F.when(kept & full, own).when(kept, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(-(1 << 31)).cast("int").alias("reach"), F.array().cast(f"array<{SPANS}>").alias("done"), F.array().cast(SPANS).alias("out"))
    return F.sort_array(F.aggregate(merged, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["out"])))))


# --- the same definitions over Python lists, for one text at a time -----------------------------

Spans = list[tuple[int, int]]


def near_unordered(lists: list[Spans], slop: int) -> Spans:
    """As ``unordered_windows``."""
    following: dict[int, tuple[int, int]] = {}
    out = []
    for s, e, k in sorted(((*x, k) for k, own in enumerate(lists) for x in own), reverse=True):
        following[k] = (s, e)
        end = max(y for _, y in following.values())
        if len(following) == len(lists) and end - s - sum(y - x for x, y in following.values()) <= slop:
            out.append((s, end))
    return out[::-1]


def near_ordered(lists: list[Spans], slop: int) -> Spans:
    """As ``ordered_windows``."""
    chains: dict[int, tuple[int, int, int]] = {}  # by the number of the last list: start, end, gaps
    last, out = -1, []
    for s, e, k in sorted(((*x, -k) for k, own in enumerate(lists) for x in own)):
        k = -k
        if k and k - 1 not in chains:
            continue
        begin, end, gaps = chains[k - 1] if k else (s, s, 0)
        chains[k] = begin, e, gaps + max(0, s - end)
        if k == len(lists) - 1 and begin > last:
            last = begin
            if chains[k][2] <= slop:
                out.append((begin, e))
    return out


def sloppy_frequency(lists: list[list[int]], positions: Sequence[int], slop: int, groups: Sequence[int]) -> float:
    """As ``sloppy_freq``; slots of one group hold the same term."""
    by_value: dict[int, list[tuple[int, int]]] = {}
    for k, own in enumerate(lists):
        for p in own:
            by_value.setdefault(p - positions[k], []).append((k, p))
    order: list[tuple[int, int, int]] = []
    for v in sorted(by_value):
        run = order[-1][1] if order else -1
        order += [(v, k, p) for k, p in sorted(by_value[v], key=lambda x: (x[0] != run, x[0]))]
    following: list[list[tuple[int, int]]] = [[] for _ in lists]
    total, after = 0.0, -1
    for v, k, p in reversed(order):
        ends, taken = [v], {g: {p} if g == groups[k] else set() for g in groups}
        for j, own in enumerate(following):
            free = next(((y, q) for y, q in reversed(own) if q not in taken[groups[j]]), None) if j != k else None
            if free:
                ends.append(free[0])
                taken[groups[j]] |= {free[1]} if groups.count(groups[j]) > 1 else set()
        if len(ends) == len(lists) and after != k and max(ends) - v <= slop:
            total += 1 / (1 + max(ends) - v)
        following[k].append((v, p))
        after = k
    return total
