"""Text helpers as Spark columns, with the SQL text that says the same in DuckDB.

A pattern is written once, in the common subset of Java and RE2. :func:`java`
makes word boundaries ASCII and ``.`` stop at line feeds only, as RE2 has them.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache
from re import _constants as _C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _opens_word(rest: str) -> bool:
    """Whether what ``rest`` of a pattern matches can only begin with a word character; of groups every alternative must."""
    group = re.match(r"\((?:\?:)?", rest)
    if not group:
        return re.match(r"[A-Za-z0-9_](?![?*{])", rest) is not None
    depth, in_class, at = 1, False, group.end()
    if not _opens_word(rest[at:]):
        return False
    while at < len(rest) and depth:
        c = rest[at]
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 1 and not _opens_word(rest[at + 1 :]):
            return False
        at += 1
    return rest[at : at + 1] not in ("?", "*", "{")


@lru_cache(maxsize=None)
def _parsed(pattern: str):
    """The pattern as Python's parser has it, None where it has no such syntax."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return _parser.parse(pattern)
        except (re.error, OverflowError):
            return None


_CLASSES = {_C.CATEGORY_DIGIT: "0123456789", _C.CATEGORY_SPACE: " \t\n\x0b\f\r", _C.CATEGORY_WORD: "0123456789_" + "".join(chr(c) + chr(c + 32) for c in range(65, 91))}


def _openings(items, fold: bool) -> tuple[frozenset[str] | None, bool]:
    """(characters with which a match can begin, whether it can be empty); None for any character."""
    out: set[str] = set()

    def add(c: int) -> None:
        out.update({chr(c), chr(c).lower(), chr(c).upper()} if fold and c < 128 else {chr(c)})

    for op, arg in items:
        if op in (_C.AT, _C.ASSERT, _C.ASSERT_NOT):
            continue
        if op is _C.LITERAL:
            add(arg)
            return frozenset(out), False
        if op is _C.IN:
            for kind, v in arg:
                if kind is _C.LITERAL:
                    add(v)
                elif kind is _C.RANGE and v[1] < 1024:
                    for c in range(v[0], v[1] + 1):
                        add(c)
                elif kind is _C.CATEGORY and v in _CLASSES:
                    out.update(_CLASSES[v])
                else:
                    return None, False
            return frozenset(out), False
        if op is _C.SUBPATTERN:
            parts, least = [arg[3]], 1
            fold = fold or bool(arg[1] & re.IGNORECASE)
        elif op is _C.BRANCH:
            parts, least = arg[1], 1
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT):
            parts, least = [arg[2]], arg[0]
        else:
            return None, False
        empty = least == 0
        for part in parts:
            some, nothing = _openings(part, fold)
            if some is None:
                return None, False
            out |= some
            empty = empty or nothing
        if not empty:
            return frozenset(out), False
    return frozenset(out), True


def _ahead(pattern: str, flags: str) -> str:
    """A look at the next character, where few can open a match: it spares most places of a text the alternatives that follow."""
    parsed = _parsed(pattern)
    if parsed is None or not len(parsed) or parsed[0][0] is _C.LITERAL or parsed[0] == (_C.AT, _C.AT_BEGINNING):
        return ""
    some, empty = _openings(parsed, "i" in flags)
    if some is None or empty or not some or sum(c.isalpha() for c in some) > 36:
        return ""
    return "(?=[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(some)) + "])"


@lru_cache(maxsize=None)
def java(pattern: str, flags: str = "") -> str:
    """The Java form of a pattern; ``flags`` of ``i`` and ``m``."""

    def edge(m: re.Match) -> str:
        if m[0] != r"\b":
            return m[0]
        if _opens_word(pattern[m.end() :]):  # what follows is a word character: only the other side is open
            return "(?<![A-Za-z0-9_])"
        if re.search(r"(?<!\\)[A-Za-z0-9_]$", pattern[: m.start()]):
            return "(?![A-Za-z0-9_])"
        return _EDGE

    return f"(?{flags}d){_ahead(pattern, flags)}{re.sub(r'[\\][\\b]', edge, pattern)}"


def _runs(items) -> list[frozenset[str]]:
    """Sets of lower-case words of ASCII letters and signs; whatever a sequence matches holds at least one of each set."""
    out, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is _C.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is _C.SUBPATTERN:
            out += _runs(arg[3])
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT) and arg[0] > 0:
            out += _runs(arg[2])
        elif op is _C.BRANCH:
            best = [max(_runs(part), key=_worth, default=None) for part in arg[1]]
            if None not in best:
                out.append(frozenset().union(*best))
    return out


def _worth(words: frozenset[str]) -> tuple[int, int]:
    return min(map(len, words)), -len(words)


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[str, ...]:
    """Words in lower case of which a text must hold at least one for the pattern to match; none where no such few are known."""
    parsed = _parsed(pattern)
    rare = lambda w: len(w) > 1 or w in "`(<>[]{}=|$@#~^*\\\""
    sets = [s for s in (_runs(parsed) if parsed is not None else []) if all(map(rare, s)) and len(s) <= 24]
    if not sets:
        return ()
    words = max(sets, key=_worth)
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


def _spared(low: str | Column | None, pattern: str) -> Column | None:
    """Whether a text, whose lower case is ``low``, lacks all that the pattern needs; None where that is not known."""
    words = needed(pattern) if low is not None else ()
    if not words:
        return None

    def lacks(held: Column) -> Column:
        out = held.contains(words[0])
        for w in words[1:]:
            out = out | held.contains(w)
        return ~out

    # A column by name is bound: a filter above takes over the expressions of its columns, and would that of ``low`` with each word. A variable is as it is.
    return let(F.col(low), lacks) if isinstance(low, str) and len(words) > 1 else lacks(_col(low))


def duck(pattern: str, flags: str = "") -> str:
    """The RE2 form as a SQL literal."""
    return "'" + (f"(?{flags})" if flags else "") + pattern.replace("'", "''") + "'"


def count(text: str | Column, pattern: str, flags: str = "", low: str | Column | None = None) -> Column:
    """Number of matches. ``low``, here and below: the text in lower case (a column's name, or a variable), where the caller has it; a plain search in it spares most texts the pattern."""
    n = F.regexp_count(_col(text), F.lit(java(pattern, flags)))
    spared = _spared(low, pattern)
    return (n if spared is None else F.when(spared, 0).otherwise(n)).cast("bigint")


def found(text: str | Column, pattern: str, flags: str = "", low: str | Column | None = None) -> Column:
    hit, spared = _col(text).rlike(java(pattern, flags)), _spared(low, pattern)
    return hit if spared is None else F.when(spared, False).otherwise(hit)


def every(text: str | Column, pattern: str, flags: str = "", group: int = 0, low: str | Column | None = None) -> Column:
    hits, spared = F.regexp_extract_all(_col(text), F.lit(java(pattern, flags)), F.lit(group)), _spared(low, pattern)
    return hits if spared is None else F.when(spared, F.array().cast("array<string>")).otherwise(hits)


def swap(text: str | Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(_col(text), java(pattern, flags), to)


def d_count(text: str, pattern: str, flags: str = "") -> str:
    return f"CAST(len(regexp_extract_all({text}, {duck(pattern, flags)})) AS BIGINT)"


def d_found(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {duck(pattern, flags)})"


def d_swap(text: str, pattern: str, to: str, flags: str = "") -> str:
    return f"regexp_replace({text}, {duck(pattern, flags)}, '{to}', 'g')"


def either(phrases: list[str] | tuple[str, ...]) -> str:
    """Alternation of literal phrases, so that one scan of the text counts all of them."""
    return "(?:" + "|".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p) for p in phrases) + ")"


def phrase_count(text: str | Column, phrases, words: bool = False, low: str | Column | None = None) -> Column:
    """Occurrences of each phrase, summed; phrases may overlap one another. The text is lower-cased once."""

    def one(low: Column, p: str) -> Column:
        if words:
            n = count(low, rf"\b{re.escape(p)}\b")
        else:
            n = ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("bigint")
        return F.when(low.contains(p), n).otherwise(F.lit(0).cast("bigint"))  # the plain search spares most texts the rest

    def total(low: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for p in phrases:
            out = out + one(low, p)
        return out

    return let(F.lower(_col(text)) if low is None else _col(low), total)


def d_phrase_count(text: str, phrases, words: bool = False) -> str:
    parts = []
    for p in phrases:
        p = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", p)
        parts.append(d_count(f"lower({text})", rf"\b{p}\b" if words else p))
    return "(" + " + ".join(parts) + ")"


def normalise(text: str | Column) -> Column:
    """Lower case, white space (Unicode's too) as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"(?U)\s+", " "))


#: RE2 has no Unicode white space class: ASCII's and the common others.
D_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def d_normalise(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{D_SPACE}', ' ', 'g'))"


def js_round(x: Column) -> Column:
    """Halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def d_round(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def micros(x: str | Column) -> Column:
    """Microseconds of a time, with or without zone."""
    return F.unix_micros(_col(x).cast("timestamp"))


def seconds(x: str | Column) -> Column:
    return _col(x).cast("timestamp").cast("double")


def rnd(x: Column, places: int) -> Column:
    """Rounded to ``places``, halves up, by arithmetic that any engine repeats."""
    k = 10**places
    return F.floor(x.cast("double") * k + 0.5) / k


def d_rnd(x: str, places: int) -> str:
    k = 10**places
    return f"(floor(CAST({x} AS DOUBLE) * {k} + 0.5) / {k})"


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def d_clamp(x: str, low: float = 0.0, high: float = 100.0) -> str:
    return f"least(greatest({x}, {float(low)}), {float(high)})"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def flag(x: Column) -> Column:
    """0.0 or 1.0."""
    return F.when(x, 1.0).otherwise(0.0)


def array_sum(x: Column, kind: str = "double") -> Column:
    zero = F.lit(0).cast(kind)
    return F.aggregate(x, zero, lambda a, v: a + v.cast(kind))


def pair_runs(pairs: Column) -> Column:
    """Sum of c log2 c over the numbers c of equal pairs in an array of strings.

    Sorted, equal pairs are runs; pairs that are there once add nothing, so only those that equal the one before are added up.
    """
    xlog = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))
    state = lambda last, c, s: F.struct(last.alias("last"), c.alias("c"), s.alias("s"))
    step = lambda a, x: F.when(a["last"] == x, state(a["last"], a["c"] + 1, a["s"])).otherwise(state(x, F.lit(2.0), a["s"] + xlog(a["c"])))
    again = lambda p: F.filter(p, lambda x, i: F.when(i > 0, F.get(p, i - 1) == x).otherwise(F.lit(False)))
    return F.aggregate(let(F.sort_array(pairs), again), state(F.lit(""), F.lit(0.0), F.lit(0.0)), step, lambda a: a["s"] + xlog(a["c"]))


def mean_cv(lengths: Column, none: float = 0.5) -> Column:
    """(mean, cv) of an array of lengths: population coefficient of variation, ``none`` where the mean is 0.

    The spread is a running one, so that it is to the last bit what SQL engines give in the order of the array.
    """
    state = lambda n, mean, d: F.struct(n.alias("n"), mean.alias("mean"), d.alias("d"))

    def step(s: Column, v: Column) -> Column:
        off = v.cast("double") - s["mean"]
        mean = s["mean"] + off / (s["n"] + 1)
        return state(s["n"] + 1, mean, s["d"] + (v.cast("double") - mean) * off)

    def moments(a: Column) -> Column:
        n = F.size(a).cast("double")
        squares = F.aggregate(a, state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda s: s["d"])
        return F.struct(F.when(n > 0, array_sum(a) / n).otherwise(F.lit(0.0)).alias("mean"), F.when(n > 1, F.sqrt(squares / n)).otherwise(F.lit(0.0)).alias("sd"))

    return let(let(lengths, moments), lambda m: F.struct(m["mean"].alias("mean"), F.when(m["mean"] > 0, m["sd"] / m["mean"]).otherwise(F.lit(float(none))).alias("cv")))


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x
