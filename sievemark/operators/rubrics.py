"""Engines that judge a text by the rubric of its family: what it shows, lacks and contradicts, less what a fabricated trace or message stands behind.

Native expressions in one projection. Of each text only its own family's rubric
is looked at, and traces and messages only where the rubric builds on them. A
null text is an empty one; a family without rubric (FLAT, null) has no substance
here (see :func:`..operators.families.flat_substance`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rubric_rules as R
from ..functions.feature_rules import ENGINES, VULN_TYPES
from ..functions.text import clamp, found, java, js_round, let
from . import crash, raw_http
from .families import family_composite, flat_substance
from .features import derive, extract, first_of, signals
from .triage import coherence_issues, disclosure_penalty, disclosures

_WEIGHED = "struct<hits: array<string>, taken: array<string>, absent: array<string>, contradictions: array<string>, contradicts: boolean>"
_OUT = "struct<gold: array<string>, revoked: array<string>, absent: array<string>, contradictions: array<string>, points: bigint, off: bigint, fabricated: boolean, contradicts: boolean, fake_raw_http: boolean, stripped_crash_trace: boolean>"


def _names(tests: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])).cast("array<string>")


def prose(text: Column) -> Column:
    """A text in lower case without its code and patches."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, java(*R.CODE), " "), java(*R.HUNK), " "))


def _said(low: Column, family: str) -> Column:
    return _names({p: low.contains(p) for p in R.CONTRADICTIONS[family]})


def _evidence(df: DataFrame, text: Column) -> DataFrame:
    """Add ``__e``: trace, request and response evaluations as far as the family's rubric builds on them, and the texts that patterns are tried on."""
    fam = F.col("family")
    of = lambda table: fam.isin(*table)
    d = df.withColumns({
        "__t": text, "__f": F.when(of(R.BY_REQUEST), raw_http.fragments(text)).otherwise(""), "__trace": F.when(of(R.BY_TRACE), crash.evaluate(text)),
        "__asked": F.when(fam == R.STRICT, raw_http.evaluate_requests(text, strict=True)).when(of(R.BY_REQUEST), raw_http.evaluate_requests(text)), "__answered": F.when(of(R.BY_RESPONSE), raw_http.evaluate_responses(text)),
    })
    true = lambda c: F.coalesce(c, F.lit(False))
    slots = true(of(R.BY_BODY) & ((F.col("__asked.placeholder_bodies") > 0) | (F.col("__asked.prose_payloads") > 0)))
    d = d.withColumns({"__slots": slots, "__fake": true(F.col("__answered.fake"))})
    d = d.withColumns({"__left": F.when(F.col("__slots"), raw_http.strip_placeholders(F.col("__t"))), "__rest": F.when(of(R.BY_RESPONSE_BODY) & F.col("__fake"), raw_http.strip_fake_responses(F.col("__t")))})
    behind = lambda c: F.when(F.col("__f") == "", F.col(c)).otherwise(F.concat(c, F.lit("\n\n"), "__f"))
    e = {
        "text": F.col("__t"), "shown": behind("__t"), "stripped": true(F.col("__trace.stripped")), "structural": true(F.col("__trace.fabricated")), "request": true(F.col("__asked.fake")), "slots": F.col("__slots"),
        "response": F.col("__fake"), "without_bodies": F.coalesce(behind("__left"), F.lit("")), "without_answers": F.coalesce("__rest", F.lit("")), "prose": prose(F.col("__t")),
    }
    d = d.withColumn("__e", F.struct(*[v.alias(k) for k, v in e.items()])).withColumn("__e", F.col("__e").withField("low", F.lower("__e.shown")))
    return d.drop("__t", "__f", "__trace", "__asked", "__answered", "__slots", "__fake", "__left", "__rest")


def _weigh(e: Column, family: str) -> Column:
    """Signals that a text has, those that are taken back, absences and contradictions, by a family's rubric."""
    pattern = {name: (p, f) for name, p, f, _ in R.SIGNALS[family]}
    taken = {}
    for name in pattern:
        why = []
        if name in R.BY_TRACE.get(family, ()):
            why.append(e["stripped"] | e["structural"])
        if name in R.BY_REQUEST.get(family, ()):
            why.append(e["request"])
        if name in R.BY_BODY.get(family, ()):
            why.append(e["slots"] & ~found(e["without_bodies"], *pattern[name]))
        if name in R.BY_RESPONSE.get(family, ()):
            why.append(e["response"])
        if name in R.BY_RESPONSE_BODY.get(family, ()):
            why.append(e["response"] & ~found(e["without_answers"], *pattern[name]))
        if why:
            taken[name] = F.array_max(F.array(*why))
    return F.struct(
        _names({n: found(e["shown"], *rule, e["low"]) for n, rule in pattern.items()}).alias("hits"), _names(taken).alias("taken"), _names({n: ~found(e["shown"], p, "i", e["low"]) for n, p, _ in R.ABSENCES[family]}).alias("absent"),
        _said(e["prose"], family).alias("contradictions"), (F.size(_said(F.lower(e["text"]), family)) > 0).alias("contradicts")).cast(_WEIGHED)


def _total(names: Column, worth: Mapping[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for item in worth.items() for x in item])
    return F.aggregate(names, F.lit(0), lambda a, n: a + F.element_at(table, n)).cast("bigint")


def _summed(w: Column, e: Column, family: str) -> Column:
    gold, revoked = F.array_except(w["hits"], w["taken"]), F.array_intersect(w["hits"], w["taken"])
    fake = e["request"] | e["response"]
    if family in R.BY_BODY:
        fake = fake | F.arrays_overlap(revoked, F.array(*[F.lit(n) for n in R.BY_BODY[family]]))
    made_up = e["stripped"] | e["structural"]
    absent = F.least(F.lit(R.ABSENCE_MOST), _total(w["absent"], {n: p for n, _, p in R.ABSENCES[family]}))
    said = F.least(F.lit(R.CONTRADICTIONS_MOST), R.CONTRADICTION * F.size(w["contradictions"]))
    off = absent + said + F.when(made_up, R.FABRICATED).otherwise(0) + F.when(fake, R.FABRICATED).otherwise(0)
    points = _total(gold, {n: p for n, _, _, p in R.SIGNALS[family]})
    return F.struct(gold.alias("gold"), revoked.alias("revoked"), w["absent"].alias("absent"), w["contradictions"].alias("contradictions"), points.alias("points"), off.cast("bigint").alias("off"), (made_up | fake).alias("fabricated"), w["contradicts"].alias("contradicts"),
                    fake.alias("fake_raw_http"), e["stripped"].alias("stripped_crash_trace")).cast(_OUT)


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``rubric``: gold and revoked signals, absent ones, contradictions, points, points off, fabricated, contradicts, and the flags fake_raw_http and stripped_crash_trace of a text by the rubric of its ``family``; null without one."""
    d = _evidence(df, F.coalesce(F.col(text_col), F.lit("")))
    by_family = lambda kind, value: _choose(kind, {name: value(name) for name in R.SIGNALS})
    d = d.withColumn("__w", by_family(_WEIGHED, lambda name: _weigh(F.col("__e"), name)))
    return d.withColumn("rubric", by_family(_OUT, lambda name: _summed(F.col("__w"), F.col("__e"), name))).drop("__e", "__w")


def _choose(kind: str, values: Mapping[str, Column]) -> Column:
    out = F.lit(None).cast(kind)
    for name, value in reversed(list(values.items())):
        out = F.when(F.col("family") == name, value).otherwise(out)
    return out


def substance(df: DataFrame, text_col: str = "text", plain: str = "substance") -> DataFrame:
    """Add ``rubric`` (see :func:`judge`), ``rubric_score`` and ``family_substance``: that score and the plain one's (column ``plain``) in equal parts, or less of it where the rubric alone finds little and nothing speaks against the text; null without rubric."""
    full = F.lit(None).cast("double")
    for name, signals in R.SIGNALS.items():
        full = F.when(F.col("family") == name, float(max(1, int(sum(p for *_, p in signals) * R.FULL + 0.5)))).otherwise(full)
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = judge(df, text_col).withColumn("__told", disclosure_penalty(disclosures(t)))
    r = F.col("rubric")
    raw = clamp(F.least(F.lit(R.BASE_MOST), r["points"] / full * 100) - r["off"] - F.col("__told"))
    d = d.withColumn("__raw", F.when(r.isNotNull(), raw))
    spared = (F.col("__raw") < R.LOW) & (F.col(plain) >= R.PLAIN_HIGH) & ~r["contradicts"] & (F.size(r["gold"]) >= 1) & ~r["fabricated"]
    weight = F.when(spared, R.LESS_WEIGHT).otherwise(R.WEIGHT)
    return d.withColumns({"rubric_score": js_round(F.col("__raw")), "family_substance": js_round(F.col("__raw") * weight + F.col(plain) * (1 - weight))}).drop("__raw", "__told")


def classify(df: DataFrame, text_col: str = "text", cwes: str = "cwes", ancestors: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Add ``family`` and ``confidence``, and apart from each other ``cited`` (the first of ``cwes``, strings of digits), ``cited_family``, ``evidence_family`` and ``evidence_confidence``.

    A cited CWE decides, then the type that a text names, then keywords. ``ancestors`` has CWEs above one, nearest first.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    direct = {str(c): name for name, members in R.MEMBERS.items() for c in members}
    above = {c: next(direct[a] for a in up if a in direct) for c, up in (ancestors or {}).items() if c not in direct and any(a in direct for a in up)}
    known = F.create_map(*[F.lit(x) for item in (direct | above).items() for x in item])
    first = lambda c: F.try_element_at(F.filter(F.coalesce(F.col(cwes), F.array().cast("array<string>")), c), F.lit(1))
    mapped = first(lambda c: F.map_contains_key(known, c))
    d = df.withColumns({"__mapped": mapped, "cited": F.coalesce(mapped, first(lambda c: c.isNotNull())), "vuln_type": let(F.lower(t), lambda low: first_of(t, VULN_TYPES, low=low))})
    types = F.create_map(*[F.lit(x) for item in R.BY_TYPE.items() for x in item])

    def best(low: Column) -> Column:
        hits = [(name, least, sum((F.when(found(low, p, "i", low), 1).otherwise(0) for p in words), F.lit(0))) for name, (least, words) in R.KEYWORDS.items()]
        scores = F.array(*[F.struct(F.when(n >= least, n).otherwise(0).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("family")) for i, (name, least, n) in enumerate(hits)])
        return F.array_max(scores)

    d = d.withColumn("__words", let(F.lower(t), best))
    by_type, enough = F.element_at(types, F.col("vuln_type")), F.col("__words.n") > 0
    by_words = F.when(enough, F.col("__words.family"))
    sure = F.when(F.col("__words.n") >= R.MANY_KEYWORDS, "MEDIUM").otherwise("LOW")
    d = d.withColumns({
        "cited_family": F.element_at(known, F.col("__mapped")), "evidence_family": F.coalesce(by_type, by_words), "evidence_confidence": F.when(by_type.isNotNull(), "MEDIUM").when(enough, sure)})
    cited = F.col("cited_family")
    straight = F.col("__mapped").isin(*direct)
    return d.withColumns({
        "family": F.coalesce(cited, "evidence_family", F.lit("FLAT")), "confidence": F.when(cited.isNotNull(), F.when(straight, "HIGH").otherwise("MEDIUM")).otherwise(F.coalesce("evidence_confidence", F.lit("LOW")))}).drop("__mapped", "__words")


def coherence(df: DataFrame, text_col: str = "text", plain: str = "coherence") -> DataFrame:
    """Add ``base_rule`` and ``family_coherence`` to classified texts (:func:`classify`): a base by what is cited and what is shown, more for signals, less for contradictions and what the family calls for; ``plain`` without a family."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    fam = F.col("family")

    def counted(x: Column, low: Column) -> Column:
        out = F.lit(None).cast("struct<gold: int, concrete: int, said: int>")
        for name in reversed(list(R.SIGNALS)):
            hit = lambda s: F.when(found(x, s[1], s[2], low), 1).otherwise(0)
            concrete = sum((hit(s) for s in R.SIGNALS[name] if s[0] != R.MEMBERSHIP), F.lit(0))
            member = sum((hit(s) for s in R.SIGNALS[name] if s[0] == R.MEMBERSHIP), F.lit(0))
            own = let(F.struct(concrete.alias("concrete"), member.alias("member")), lambda c: F.struct((c["concrete"] + c["member"]).alias("gold"), c["concrete"].alias("concrete"), F.size(_said(low, name)).alias("said")))
            out = F.when(fam == name, own).otherwise(out)
        return out

    d = df.withColumns({"__n": let(F.struct(t.alias("t"), F.lower(t).alias("low")), lambda x: counted(x["t"], x["low"])), "__issues": F.aggregate(coherence_issues(t, fam), F.lit(0).cast("bigint"), lambda a, i: a + i["penalty"])})
    no_cite, shown = F.col("cited").isNull(), F.col("evidence_family")
    soft = no_cite & F.col("vuln_type").isNotNull()
    off_family = ~no_cite & (F.col("cited_family") != shown) & F.col("evidence_confidence").isin("HIGH", "MEDIUM")
    same = F.coalesce(shown == fam, F.lit(False))
    rule = (
        F.when(F.coalesce(off_family, F.lit(False)), "OFF_FAMILY_CEILING").when(same & (F.col("__n.concrete") > 0), "SAME_FAMILY_FLOOR").when(same & soft, "SOFT_CITATION").when(same, "SAME_FAMILY_NO_CONCRETE_EVIDENCE")
        .when(~no_cite & F.col("cited_family").isNotNull() & shown.isNull(), "CITED_NO_EVIDENCE").when(soft, "SOFT_CITATION").when(no_cite, "FAMILY_DETECTED_NO_CWE").otherwise("FALLBACK"))
    bases = F.create_map(*[F.lit(x) for item in R.BASES.items() for x in item])
    d = d.withColumn("base_rule", F.when(fam != "FLAT", rule))
    bonus = F.least(F.lit(R.GOLD_MOST), js_round(F.col("__n.gold") * R.GOLD_POINTS))
    score = F.element_at(bases, F.col("base_rule")) + bonus - F.least(F.lit(R.OFF_MOST), R.OFF * F.col("__n.said")) - F.col("__issues")
    score = F.least(F.lit(100), F.greatest(F.lit(0), score))
    return d.withColumn("family_coherence", F.when(fam == "FLAT", F.col(plain)).otherwise(score).cast("bigint")).drop("__n", "__issues")


#: Engines up to the plain coherence, what combines them, and what follows from the composite.
_PLAIN, _COMBINED = next(i + 1 for i, s in enumerate(ENGINES) if "coherence" in s), next(i + 1 for i, s in enumerate(ENGINES) if "composite" in s)


def report(df: DataFrame, text_col: str = "text", cwes: str = "claimed", ancestors: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A text by its family: features, the plain engines, classification, substance and coherence by rubric, composite, what behaviour takes off it, label and action.

    ``velocity_penalty`` and ``template_penalty`` are taken from columns of those names, if there. The plain scores stay as ``plain_substance`` and ``plain_coherence``.
    """
    own = {c: F.lit(0) for c in ("velocity_penalty", "template_penalty") if c not in df.columns}
    d = derive(signals(extract(df.withColumns(own) if own else df, text_col)), ENGINES[:_PLAIN])
    d = coherence(flat_substance(substance(classify(d, text_col, cwes, ancestors), text_col), text_col), text_col)
    d = d.withColumnsRenamed({"substance": "plain_substance", "coherence": "plain_coherence"})
    d = d.withColumns({"substance": F.coalesce("family_substance", "flat_substance"), "coherence": F.col("family_coherence")})
    d = family_composite(derive(d, ENGINES[_PLAIN:_COMBINED]), text_col)
    return derive(d.withColumn("composite", F.col("family_composite")), ENGINES[_COMBINED:])
