"""Crash traces in a text: which of their frames are resolved, and what in them no sanitizer, debugger or kernel prints.

Native expressions over one text column, in one projection. A text is read once
for its frames; every other test stands behind the literal that it cannot do
without, so most texts are spared it. A null text has no frames and no markers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import crash_rules as R
from ..functions.text import every, found, java, let


def _no(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _first(text: Column, rule: tuple, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.get(every(text, *rule, group), F.lit(0))


def _bare(hexes: Column) -> Column:
    """Hex or decimal numbers of an array in lower case without leading zeros; zero is '0'."""
    return F.transform(hexes, lambda h: F.regexp_replace(F.lower(h), "^0+(?=.)", ""))


def _behind(guard: Column, test: Column) -> Column:
    return F.coalesce(F.when(guard, test), F.lit(False))


def frames(text: Column) -> Column:
    """Array of a text's frame lines."""
    return let(F.lower(text), lambda low: _frames(text, low))


def _frames(text: Column, low: Column) -> Column:
    return F.when(text.contains("#") | low.contains("frame"), every(text, *R.FRAME, low=low)).otherwise(_no())


def _resolved(line: Column) -> Column:
    return found(line, *R.SOURCE) | found(line, *R.SYMBOL)


def _placeholder(line: Column) -> Column:
    return found(line, *R.PLACEHOLDER) | found(line, *R.NOT_HEX)


def _gap(lines: Column) -> Column:
    """Whether a frame's number is larger than the last one's by more than one."""
    numbers = F.transform(lines, lambda s: F.concat(F.regexp_extract(s, java(*R.NUMBER), 1), F.regexp_extract(s, java(*R.NUMBER), 2)).try_cast("double"))
    jumps = lambda n: F.zip_with(F.slice(n, F.lit(1), F.size(n) - 1), F.slice(n, F.lit(2), F.size(n) - 1), lambda a, b: F.coalesce(b > a + 1, F.lit(False)))
    return let(numbers, lambda n: F.exists(jumps(n), lambda x: x))


def _offsets(joined: Column, rule: tuple, odd: tuple) -> Column:
    return F.size(F.filter(F.transform(every(joined, *rule, 1), F.lower), lambda h: found(h, *odd))) >= R.FEWEST_OFFSETS


def _odd_offsets(joined: Column) -> Column:
    return F.size(F.filter(_bare(every(joined, *R.IN_OFFSET, 1)), lambda h: found(h, *R.ODD_OFFSET))) >= R.FEWEST_OFFSETS


def _threads(text: Column, low: Column) -> Column:
    far = lambda rule, test: F.exists(every(text, *rule, 1), lambda d: test(d.cast("double")))
    return _behind(text.contains("=="), far(R.PID, lambda n: (n == 0) | (n > R.MOST_PID))) | _behind(low.contains("thread"), far(R.THREAD, lambda n: n > R.MOST_THREAD))


def _plain_region(text: Column) -> Column:
    """The first region size that has no range, as digits."""
    return F.regexp_extract(F.get(F.filter(every(text, *R.REGION), lambda m: ~m.endswith("[")), F.lit(0)), r"(\d+)$", 1)


def _round_region(text: Column) -> Column:
    return found(text, *R.HEX_REGION) | _plain_region(text).cast("double").isin(*R.TEXTBOOK_REGIONS)


def _region_and_access(text: Column) -> Column:
    region = F.coalesce(_first(text, R.BRACKETED_REGION), _plain_region(text)).cast("double")
    access = _first(text, R.ACCESS).cast("double")
    return let(region, lambda r: (r == 0) | (found(text, *R.WITHIN_CHUNK) & (access > 0) & (access > r)))


def _registers(text: Column) -> Column:
    def judged(v: Column) -> Column:
        times = lambda x: F.size(F.filter(v, lambda y: y == x))
        odd = F.size(F.filter(v, lambda x: found(x, *R.ROUND_REGISTER) | ((F.length(x) > 1) & (times(x) >= R.REPEATED))))
        return (F.size(v) >= R.FEWEST_REGISTERS) & (odd >= R.FEWEST_REGISTERS) & (2 * odd >= F.size(v))

    return let(_bare(every(text, *R.REGISTER, 1)), judged)


def _mappings(text: Column) -> Column:
    def bound(m: Column, k: int) -> Column:
        return F.lpad(F.lower(F.regexp_replace(F.split(m, "-")[k], "^0x", "")), 16, "0")

    def judged(m: Column) -> Column:
        aligned = lambda x: x.endswith("000")
        wrong = F.exists(m, lambda x: (x["end"] <= x["start"]) | (x["start"] < R.LOWEST_MAPPING) | ~aligned(x["start"]) | ~aligned(x["end"]))
        overlap = let(F.array_sort(m), lambda s: F.exists(F.zip_with(F.slice(s, F.lit(2), F.size(s) - 1), F.slice(s, F.lit(1), F.size(s) - 1), lambda b, a: b["start"] < a["end"]), lambda x: x))
        return F.when(F.size(m) >= 2, wrong | overlap)

    return let(F.transform(every(text, *R.MAPPING, 1), lambda m: F.struct(bound(m, 0).alias("start"), bound(m, 1).alias("end"))), judged)


def _status(text: Column) -> Column:
    power = lambda v: (v >= R.LEAST_POWER) & (v.bitwiseAND(v - 1) == 0)
    return let(F.transform(every(text, *R.STATUS, 1), lambda d: d.try_cast("bigint")), lambda v: (F.size(v) >= R.FEWEST_STATUS) & (F.size(F.filter(v, power)) >= R.FEWEST_POWERS))


def _shadow_rows(text: Column) -> Column:
    """Rows of the grid after the first heading of shadow bytes: lines up to the first that is neither blank nor a row; null without heading."""
    lines = F.filter(F.split(_first(text, R.SHADOW), r"\r?\n"), lambda s: F.regexp_replace(s, r"\s", "") != "")
    stop = lambda a: F.array_position(F.transform(a, lambda s: found(s, *R.SHADOW_ROW)), F.lit(False)).cast("int")
    return let(lines, lambda a: F.when(stop(a) > 0, F.slice(a, F.lit(1), F.greatest(stop(a) - 1, F.lit(0)))).otherwise(a))


def _marked(row: Column) -> Column:
    return F.regexp_extract(row, java(*R.SHADOW_ROW), 1) == "=>"


def _malformed(rows: Column, text: Column) -> Column:
    def bad(row: Column) -> Column:
        pairs = F.filter(F.split(F.translate(F.regexp_extract(row, java(*R.SHADOW_ROW), 2), "[]", "  "), r"\s+"), lambda t: t != "")
        return (F.size(pairs) != R.ROW_WIDTH) | F.exists(pairs, lambda t: ~found(t, *R.PAIR))

    return (F.size(rows) == 0) | F.exists(rows, bad) | ~F.exists(rows, _marked) | ~found(text, *R.LEGEND)


def _expected(phrase: Column) -> Column:
    """Bytes that the first bug class named in a phrase leaves."""
    out = None
    for pattern, held in R.BUG_BYTES:
        test, value = found(phrase, pattern, "i"), F.array(*[F.lit(b) for b in held])
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _mismatch(rows: Column, text: Column) -> Column:
    byte = F.lower(F.regexp_extract(F.get(F.filter(rows, lambda r: _marked(r) & found(r, *R.MARKED_BYTE)), F.lit(0)), java(*R.MARKED_BYTE), 1))
    phrase, line = _first(text, R.BUG_CLASS), F.split(_first(text, R.BUG_LINE, 0), "\n")[0]
    return ~F.array_contains(F.coalesce(_expected(phrase), _expected(line)), byte)


def _roles(text: Column) -> Column:
    return F.array(*[F.array_distinct(_bare(every(text, *rule, 1))) for rule in R.ROLES])


def _apart(roles: Column) -> Column:
    """Whether the roles, one of them freeing or allocating, name one thread each and no thread twice."""
    named = F.filter(roles, lambda r: F.size(r) > 0)
    one = F.forall(named, lambda r: F.size(r) == 1)
    return (F.size(named) >= 2) & ((F.size(roles[1]) > 0) | (F.size(roles[2]) > 0)) & one & (F.size(F.array_distinct(F.flatten(named))) == F.size(named))


def _markers(text: Column, low: Column, lines: Column) -> Column:
    joined, has = F.array_join(lines, "\n"), F.size(lines) > 0
    low_has = low.contains
    shadowed = lambda test: _behind(low_has("buggy"), let(_shadow_rows(text), lambda rows: F.when(rows.isNotNull(), test(rows, text))))
    on_roles = lambda test: _behind(low_has("thread"), let(_roles(text), test))
    tests = (
        _behind(has & text.contains("+0x"), _offsets(joined, R.OFFSET, R.ROUND_OFFSET)), _behind(has, _gap(lines)), _behind(low_has("thread"), found(text, *R.THREAD) & ~found(text, *R.PID)),
        _behind(low_has("region"), _round_region(text)), _behind(has & text.contains("+0x"), _odd_offsets(joined)), _threads(text, low), _behind(low_has("region"), _region_and_access(text)),
        _behind(low_has("0x"), _registers(text)), _behind(text.contains("-"), _mappings(text)), shadowed(_malformed), shadowed(_mismatch),
        on_roles(lambda r: F.size(F.array_distinct(F.flatten(r))) >= R.FEWEST_THREADS), on_roles(_apart), _behind(low_has("kb"), _status(text)),
    )
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, R.MARKERS)]))


def evaluate(text: Column) -> Column:
    """frames, good, placeholders (numbers of frames), stripped, markers and fabricated of a text's crash traces."""

    def judged(x: Column) -> Column:
        n, good, held = F.size(x["lines"]).cast("bigint"), x["good"], x["placeholders"]
        stripped = (n >= R.FEWEST_FRAMES) & ((100 * good < R.RESOLVED * n) | (2 * held >= n))
        return F.struct(n.alias("frames"), good.alias("good"), held.alias("placeholders"), stripped.alias("stripped"), x["markers"].alias("markers"), (F.size(x["markers"]) >= R.FABRICATED).alias("fabricated"))

    def read(x: Column) -> Column:
        count = lambda test: F.size(F.filter(x["lines"], test)).cast("bigint")
        good = count(lambda s: ~_placeholder(s) & _resolved(s))
        return F.struct(x["lines"].alias("lines"), good.alias("good"), count(_placeholder).alias("placeholders"), _markers(x["text"], x["low"], x["lines"]).alias("markers"))

    known = let(F.coalesce(text, F.lit("")), lambda t: F.struct(t.alias("text"), F.lower(t).alias("low")))
    both = let(known, lambda x: F.struct(x["text"].alias("text"), x["low"].alias("low"), _frames(x["text"], x["low"]).alias("lines")))
    return let(let(both, read), judged)
