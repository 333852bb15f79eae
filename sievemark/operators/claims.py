"""Evidence that can't be real, facts that can't be, and payloads that are evidence.

Native expressions over one text column; a null text is an empty one. Weights
are whole numbers, scores 0 to 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import claim_rules as R
from ..functions.feature_rules import ASSESSED, CORROBORATING, FABRICATION
from ..functions.text import count, every, found, java, js_round, let
from . import crash, excerpts, raw_http
from . import detectors as de
from .features import derive, extract, signals
from .sections import strip


def _both(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any_of(x: Column, values) -> Column:
    return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: x.contains(v)))


def hallucination(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``signals`` (type, weight), ``signal_weight`` and ``hallucination`` (100 less two for each point of weight)."""
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__low", F.lower("__t"))
    t, low = F.col("__t"), "__low"
    numbered = lambda frames: F.transform(frames, lambda f: F.regexp_replace(f, r"^#\d+", "#N"))
    bare = F.transform(every(t, *R.ADDRESS, low=low), lambda a: F.substring(F.lower(a), 3, 20))
    round_ = lambda a: F.filter(a, lambda x: x.rlike("000$") | x.rlike(R.SEQUENTIAL))
    part = lambda v, k: F.split(v, r"\.")[k].cast("double")
    name = lambda c: F.regexp_replace(c, r"\s*\($", "")
    said = F.filter(F.transform(F.split(t, "[.!?]+"), lambda s: F.lower(strip(s))), lambda s: F.length(s) > 20)
    parts = {
        "__frames": let(every(t, *R.FRAME, low=low), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(numbered(x))).alias("d"))),
        "__round": let(bare, lambda x: F.struct(F.size(x).alias("n"), F.size(round_(x)).alias("d"))),
        "magic_pids": F.size(F.array_distinct(F.filter(every(t, *R.PID, 1, low), lambda p: p.isin(*R.MAGIC_PIDS)))),
        "odd_versions": F.size(F.filter(every(t, *R.VERSION, 1, low), lambda v: (part(v, 2) > 200) & (part(v, 0) < 10))),
        "calls": F.size(F.filter(F.transform(every(t, *R.CALL), name), lambda n: F.substring(n, F.lit(2), F.greatest(F.length(n) - 2, F.lit(0))).contains("_"))),
        "repeats": let(F.transform(said, lambda s: F.regexp_replace(s, r"(?U)\s+", " ")), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    }
    d = df.withColumns({**{n: found(t, p, f, low) for n, (p, f) in R.FLAGS.items()}, **parts})
    d = d.withColumns({"frames": F.col("__frames.n"), "distinct_frames": F.col("__frames.d"), "addresses": F.col("__round.n"), "round_addresses": F.col("__round.d")})
    weights = {n: F.expr(w).cast("bigint") for n, w in R.SIGNALS}
    fired = F.array_compact(F.array(*[F.when(w > 0, F.struct(F.lit(n).alias("type"), w.alias("weight"))) for n, w in weights.items()]))
    d = d.withColumn("signals", fired).drop("__t", "__low", *R.FLAGS, *parts, "frames", "distinct_frames", "addresses", "round_addresses")
    d = d.withColumn("signal_weight", F.aggregate("signals", F.lit(0).cast("bigint"), lambda a, s: a + s["weight"]))
    return d.withColumn("hallucination", F.greatest(F.lit(0), 100 - 2 * F.col("signal_weight")).cast("bigint"))


def placeholder_weight(text: Column) -> Column:
    """Weight of placeholder domains (less within code), and of generic paths beside them."""
    low, spared = F.lower(text), found(text, *R.REDACTED)

    def total(x: Column) -> Column:
        names = [F.when(x["low"].contains(h), F.when(found(x["t"], rf"```[\s\S]*?{h.replace('.', chr(92) + '.')}[\s\S]*?```"), 3).otherwise(6)).otherwise(0) for h in R.PLACEHOLDER_DOMAINS if h not in R.RESERVED_DOMAINS]
        own = F.aggregate(F.array(*names), F.lit(0), lambda a, w: a + w)
        return let(own, lambda w: F.when(x["spared"] | (w == 0), 0).otherwise(w + 2 * _any_of(x["low"], R.PLACEHOLDER_PATHS)))

    return let(F.struct(text.alias("t"), low.alias("low"), spared.alias("spared")), total).cast("bigint")


def _hex(digits: Column) -> Column:
    return F.aggregate(F.split(F.lower(digits), ""), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a * 16 + (F.instr(F.lit("0123456789abcdef"), c) - 1)))


def fabricated_output(text: Column) -> Column:
    """Weight of round sanitizer addresses, frames of one function, registers in sequence, and answers that are all 200."""
    frames, status = every(text, *R.FRAME_NAME, 1), every(text, *R.STATUS, 1)
    registers = every(text, *R.REGISTER, 1)

    def alike(v: Column) -> Column:
        values = F.transform(v, _hex)
        near = F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.abs(b - a) < 256)
        return F.when((F.size(v) >= 4) & (F.size(F.array_distinct(F.transform(v, F.length))) == 1) & F.forall(near, lambda x: x), 12).otherwise(0)

    return (
        F.when(found(text, *R.ASAN_HEADER) & (count(text, *R.ROUND_ADDRESS) >= 2), 15).otherwise(0)
        + let(frames, lambda x: F.when((F.size(x) >= 3) & (F.size(F.array_distinct(x)) == 1), 12).otherwise(0)) + let(registers, alike)
        + let(status, lambda x: F.when((F.size(x) >= 3) & (F.size(F.array_distinct(x)) == 1) & (x[0] == "200"), 5).otherwise(0))
    ).cast("bigint")


def absent_functions(text: Column) -> Column:
    """Weight of functions that a named project doesn't have, of names put together of generic words, and of mixed spellings."""
    low = F.lower(text)
    known = F.lit(0)
    for project, names in R.ABSENT_FUNCTIONS.items():
        known = known + F.when(low.contains(project) & (_any_of(text, names) > 0), 25).otherwise(0)
    names = F.array_distinct(F.concat(every(text, *R.CALLED, 1), every(text, *R.NAMED, 1)))
    words = lambda f: F.filter(F.split(F.regexp_replace(f, "([A-Z])", "_$1"), "_"), lambda p: p != "")
    of = lambda listed: lambda p: F.lower(p).isin(*listed)
    empty = lambda f: let(words(f), lambda p: (F.size(p) >= 5) & F.exists(p, of(R.VERBS)) & (F.size(F.filter(p, of(R.GENERIC))) >= 2))
    like = lambda x, p: F.size(F.filter(x, lambda f: f.rlike(p)))
    made_up = let(names, lambda x: 10 * F.size(F.filter(x, empty)) + F.when((F.size(x) >= 5) & (like(x, R.CAMEL) >= 3) & (like(x, R.SNAKE) >= 3), 8).otherwise(0))
    return (known + made_up).cast("bigint")


def hallucination_whole(df: DataFrame, text_col: str = "text") -> DataFrame:
    """As :func:`hallucination`, with what traces and excerpts show that no tool or server gives: structural_fabrication, impossible_http_response and impossible_graphql_response."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = hallucination(df, text_col).withColumns({"__trace": F.size(crash.evaluate(t)["markers"]), "__http": F.size(excerpts.impossible_http(t)), "__graphql": F.size(excerpts.impossible_graphql(t))})
    more = (
        ("structural_fabrication", F.when(F.col("__trace") == 1, R.ONE_MARKER).otherwise(R.MARKER * F.col("__trace"))), ("impossible_http_response", R.EXCERPT_MARKER * F.col("__http")),
        ("impossible_graphql_response", R.EXCERPT_MARKER * F.col("__graphql")),
    )
    shown = F.array_compact(F.array(*[F.when(w > 0, F.struct(F.lit(n).alias("type"), w.cast("bigint").alias("weight"))) for n, w in more]))
    d = d.withColumn("signals", F.concat(shown, "signals")).drop("__trace", "__http", "__graphql")
    d = d.withColumn("signal_weight", F.aggregate("signals", F.lit(0).cast("bigint"), lambda a, s: a + s["weight"]))
    return d.withColumn("hallucination", F.greatest(F.lit(0), 100 - 2 * F.col("signal_weight")).cast("bigint"))


def _pairs(text: Column, table) -> Column:
    out = F.lit(0)
    for weight, patterns in table:
        out = out + F.when(_both(*[found(text, p, "i") for p in patterns]), weight).otherwise(0)
    return out.cast("bigint")


def factual(df: DataFrame, year: int, text_col: str = "text") -> DataFrame:
    """Add the scores of the parts (``fact_`` and the part's name) and their blend ``factual``."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = {
        "severity": de.severity_inflation(t), "placeholder": placeholder_weight(t), "fabricated": fabricated_output(t), "cve_year": de.cve_years(t, year), "fabricated_cve": de.fabricated_cves(t, year),
        "functions": absent_functions(t), "paths": _pairs(t, R.FAKE_PATHS), "certificates": _pairs(t, R.TEST_CERTS),
    }
    d = df.withColumns({f"fact_{n}": de.log_score(w) for n, w in parts.items()})
    blend = sum((F.lit(share) * F.col(f"fact_{n}") for n, share in R.BLEND.items()), F.lit(0.0))
    return d.withColumn("factual", F.least(F.lit(100), js_round(blend)).cast("bigint"))


def fabricated_patch(text: Column) -> Column:
    """-10 where a patch is claimed and neither a hunk nor code of two lines is there, else 0."""
    blocks = every(text, *R.CODE_BLOCK)
    inner = lambda b: F.regexp_replace(F.regexp_replace(b, r"^```[^\n]*\n?", ""), r"```$", "")
    lines = lambda b: F.size(F.filter(F.split(inner(b), "\n"), lambda x: F.length(strip(x)) > 0))
    shown = F.exists(blocks, lambda b: b.rlike(java(r"\n\s*[+\-]\s*\S")) | (lines(b) >= 2))
    return F.when(found(text, *R.PATCH_CLAIM) & ~found(text, *R.DIFF) & ~shown, -10).otherwise(0).cast("bigint")


def gold_signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``gold`` (names of the payload signals) and ``gold_bonus`` (their points, at most 12)."""
    df = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__low", F.lower("__t"))
    t, low = F.col("__t"), "__low"
    first = lambda rule: F.coalesce(F.get(every(t, *rule, 1, low), F.lit(0)), F.lit(""))
    concrete = lambda x, n: (F.length(x) >= n) & ~x.rlike(java(R.TOKEN_PLACEHOLDER, "i"))
    window = let(F.split(t, java(*R.CRYPTO), 2), lambda p: F.concat(F.right(p[0], F.lit(40)), F.regexp_extract(t, java(*R.CRYPTO), 0), F.left(p[1], F.lit(40))))
    around = F.when(found(t, *R.CRYPTO, low), window).otherwise("")  # cut at the first place, not searched for from every place before it
    uri = first(R.XXE)
    tests = {
        "auth_token": found(t, *R.JWT, low) | let(first(R.BEARER), lambda x: concrete(x, 16)) | let(first(R.COOKIE), lambda x: concrete(x, 12)),
        **{n: found(t, *rule, low) for n, rule in R.PAYLOADS.items()},
        "xxe_external_entity": let(uri, lambda u: (u != "") & ~u.rlike(java(R.XXE_PLACEHOLDER, "i")) & ~u.rlike(java(R.XXE_BARE))),
        "crypto_misuse": let(around, lambda w: (w != "") & ~(w.rlike(java(R.CRYPTO_PLACEHOLDER, "i")) & ~w.rlike(java(R.LONG_HEX, "i")))),
        "filesystem_toctou": found(t, *R.TOCTOU, low) & ~found(t, *R.TOCTOU_PLACEHOLDER),
    }
    d = df.withColumn("gold", F.array_compact(F.array(*[F.when(tests[n], F.lit(n)) for n in R.GOLD]))).drop("__t", "__low")
    return d.withColumn("gold_bonus", _gold_points())


def _gold_points() -> Column:
    worth = F.create_map(*[x for k, v in R.GOLD.items() for x in (F.lit(k), F.lit(v))])
    return F.least(F.lit(R.GOLD_MOST), F.aggregate("gold", F.lit(0), lambda a, n: a + F.element_at(worth, n))).cast("bigint")


def gold_signals_left(df: DataFrame, text_col: str = "text") -> DataFrame:
    """As :func:`gold_signals`; payloads must also be in what is left of a text without placeholder bodies and payloads that prose only speaks of."""
    d = gold_signals(df, text_col).withColumnsRenamed({"gold": "__all", text_col: "__own"}).drop("gold_bonus")
    d = d.withColumn("__left", raw_http.strip_placeholders(F.col("__own"))).withColumn(text_col, F.when(F.col("__left") != F.col("__own"), F.col("__left"))).drop("__left")  # null: all is left, and so are its signals
    d = gold_signals(d, text_col)
    kept = F.when(F.col(text_col).isNull(), F.col("__all")).otherwise(F.filter("__all", lambda n: ~n.isin(*R.GOLD_LEFT) | F.array_contains("gold", n)))
    d = d.withColumn("gold", kept).drop("__all", text_col).withColumnRenamed("__own", text_col)
    return d.withColumn("gold_bonus", _gold_points())


def assess(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A text from features to tier and action: evidence, engines, bonus of payloads, points off for fabricated evidence, composite, label, action."""
    d = gold_signals(hallucination(signals(extract(df, text_col)), text_col), text_col)
    primary = F.exists("signals", lambda s: ~s["type"].isin(*CORROBORATING))
    points = F.lit(0)
    for least, take in reversed(FABRICATION):
        points = F.when(F.col("signal_weight") >= least, take).otherwise(points)
    return derive(d.withColumn("fabrication", F.when(primary, points).otherwise(0)), ASSESSED)
