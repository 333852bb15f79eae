"""Raw HTTP pasted into a text: messages that no client or server sent, payloads that are only spoken of, and the text without either.

Native expressions over one text column. Messages may stand shell-escaped in
quotes; those are written out behind the text first. Where something is crossed
out the text keeps its length (spaces), so places in it stay what they were.
Guards on literals spare most texts all of it. A null text has no messages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import http_rules as R
from ..functions.text import every, found, java, let
from .sections import strip

_CUT, _PAIR = "\x01", "\x02"
#: Marks of crossed-out prose: one for the first character of each category, and one for what follows.
_FIRST = {c: chr(3 + k) for k, c in enumerate(R.CATEGORIES)}
_REST = chr(3 + len(R.CATEGORIES) + 5)
MARKS = "".join(_FIRST.values()) + _REST


def _no(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _spaces(x: Column) -> Column:
    return F.repeat(F.lit(" "), F.length(x))


def _clean(text: Column) -> Column:
    """The text with our marks, should it hold any, as spaces."""
    own = _CUT + _PAIR + MARKS
    return F.translate(text, own, " " * len(own))


def unescape(body: Column) -> Column:
    r"""A quoted string with \r, \n and the like as the characters they stand for."""
    out = F.replace(F.replace(body, F.lit(_PAIR), F.lit(" ")), F.lit("\\\\"), F.lit(_PAIR))
    for c, to in R.ESCAPES.items():
        out = F.replace(out, F.lit("\\" + c), F.lit(to))
    return F.replace(out, F.lit(_PAIR), F.lit("\\"))


def fragments(text: Column) -> Column:
    """Shell-escaped messages of a text, written out, with an empty line between them; '' without any."""
    single = F.regexp_extract_all(text, F.lit(f"(?d){R.SINGLE_QUOTED}"), F.lit(1))
    quoted = F.concat(single, every(text, *R.DOUBLE_QUOTED, 1), every(text, *R.ANSI_QUOTED, 1))
    return F.when(text.contains("\\r\\n"), F.array_join(F.transform(quoted, unescape), "\n\n")).otherwise("")


def augmented(text: Column) -> Column:
    """The text with its shell-escaped messages written out behind it."""
    return let(fragments(text), lambda f: F.when(f == "", text).otherwise(F.concat(text, F.lit("\n\n"), f)))


def _parts(text: Column, start: tuple) -> Column:
    """The text before the first message, and each message from its first line up to the next one's."""
    return F.split(F.regexp_replace(text, java(*start), f"$1{_CUT}$2"), _CUT)


def _message(part: Column) -> Column:
    """line, head, gap, body (up to a fence) and rest of a message: joined they are the part."""

    def cut(x: Column) -> Column:
        group = lambda k: F.regexp_extract(x["tail"], java(*R.HEAD_AND_BODY), k)
        both = found(x["tail"], *R.HEAD_AND_BODY)
        return F.struct(x["line"].alias("line"), F.when(both, group(1)).otherwise(x["tail"]).alias("head"), group(2).alias("gap"), group(3).alias("after"))

    def fence(x: Column) -> Column:
        body = F.regexp_extract(x["after"], java(*R.BEFORE_FENCE), 1)
        return let(body, lambda b: F.struct(x["line"].alias("line"), x["head"].alias("head"), x["gap"].alias("gap"), b.alias("body"), F.substring(x["after"], F.length(b) + 1, F.length(x["after"])).alias("rest")))

    line = F.regexp_extract(part, r"^[^\n]*\n", 0)
    return let(let(let(line, lambda s: F.struct(s.alias("line"), F.substring(part, F.length(s) + 1, F.length(part)).alias("tail"))), cut), fence)


def _headers(head: Column) -> Column:
    lines = F.filter(F.transform(F.split(head, r"\r?\n"), strip), lambda s: found(s, *R.HEADER))
    return F.transform(lines, lambda s: F.struct(F.lower(F.regexp_extract(s, java(*R.HEADER), 1)).alias("name"), F.regexp_extract(s, java(*R.HEADER), 2).alias("value")))


def _hollow(value: Column) -> Column:
    """Whether a header's value is empty or a placeholder."""
    return let(strip(value), lambda v: found(v, *R.PLACEHOLDER_VALUE) | found(v, *R.PLACEHOLDER_RUN))


def _letters(x: Column) -> Column:
    return F.size(F.array_distinct(F.split(x, "")))


def _flat(value: Column) -> Column:
    """Whether a token of some length is made of one or two characters."""
    return let(F.struct(strip(value).alias("v"), F.regexp_replace(value, "[^A-Za-z0-9]", "").alias("c")), lambda x: (F.length(x["v"]) >= R.OPAQUE) & (F.length(x["c"]) >= R.OPAQUE) & (_letters(x["c"]) <= R.FEW_LETTERS))


def _base64(x: Column) -> Column:
    plain = F.regexp_replace(F.translate(x, "-_", "+/"), "=+$", "")
    padded = let(plain, lambda p: F.rpad(p, (F.ceil(F.length(p) / 4) * 4).cast("int"), F.lit("=")))
    return F.try_to_binary(padded, F.lit("base64"))


def _forged(token: Column) -> Column:
    """Whether a token of three parts is no JSON web token: claims that are none, placeholders for claims, a signature too short or too plain."""

    def claims(v: Column) -> Column:
        value = lambda c: F.when(F.schema_of_variant(c) == "STRING", strip(F.try_variant_get(c, "$", "string")))
        held = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        bad = lambda s: (s != "") & (F.lower(s).isin(*R.CLAIMS) | found(s, *R.CLAIM_PLACEHOLDER))
        return F.coalesce((F.size(held) == 0) | F.exists(F.transform(held, value), lambda s: F.coalesce(bad(s), F.lit(False))), F.lit(True))

    def judged(p: Column) -> Column:
        text = F.try_validate_utf8(_base64(p[1]).cast("string"))
        parsed = let(F.try_parse_json(text), lambda v: F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit(True)).otherwise(claims(v)))
        signature = let(F.regexp_replace(p[2], "=+$", ""), lambda s: (F.length(s) < R.SIGNATURE) | (_letters(s) <= R.FEW_LETTERS))
        return (p[0] == "") | (p[1] == "") | (p[2] == "") | parsed | signature

    return let(F.split(token, r"\."), judged)


def _fake_cookie(value: Column) -> Column:
    pairs = F.filter(F.transform(F.split(value, r";\s*"), strip), lambda p: p.rlike(r"^[^=]+=\s*\S"))
    content = F.transform(pairs, lambda p: F.regexp_replace(strip(F.regexp_extract(p, r"^[^=]+=([\s\S]*)$", 1)), r'^"(.*)"$', "$1"))
    return let(content, lambda c: (F.size(c) > 0) & F.forall(c, _flat))


def _fake_credential(h: Column) -> Column:
    v = strip(h["value"])
    token = strip(F.regexp_extract(v, java(*R.BEARER), 1))
    basic = found(F.try_validate_utf8(_base64(F.regexp_extract(v, java(*R.BASIC), 1)).cast("string")), *R.BASIC_PLACEHOLDER)
    bearer = let(token, lambda t: F.when(F.size(F.split(t, r"\.")) == 3, _forged(t)).otherwise(_flat(t)))
    authorization = F.when(found(v, *R.BEARER), bearer).when(found(v, *R.BASIC), F.coalesce(basic, F.lit(False))).otherwise(F.lit(False))
    return F.when(h["name"].isin(*R.AUTHORIZATION), authorization).when(h["name"].isin(*R.COOKIES), _fake_cookie(v)).otherwise(_flat(v))


def _slot(inner: Column, telling: bool) -> Column:
    """Whether what stands between angle brackets is a slot to be filled."""
    return let(strip(inner), lambda i: (i != "") & (found(i, *R.SLOT_WORDS) if telling else found(i, *R.SLOT_WORDS) | found(i, *R.SLOT_NAME)))


def placeholder_body(body: Column) -> Column:
    """Whether a body stands for one that is not given."""
    slots = F.exists(every(body, *R.ANGLE, 1), lambda i: _slot(i, False))
    return let(strip(body), lambda b: (b != "") & (found(b, *R.BODY_WORD) | found(b, *R.BODY_BRACKET) | slots))


def requests(text: Column) -> Column:
    """Array of the requests of a text: its parts (see :func:`_message`), ``headers``, ``hollow`` (the body is a placeholder)."""

    def read(p: Column) -> Column:
        return let(_message(p), lambda m: F.struct(*[m[c].alias(c) for c in ("line", "head", "gap", "body", "rest")], _headers(m["head"]).alias("headers"), placeholder_body(m["body"]).alias("hollow")))

    parts = _parts(text, R.REQUEST)
    return let(parts, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), read))


def crossed_prose(text: Column) -> Column:
    """The text with prose that speaks of a payload without giving it crossed out by marks; its own marks are spaces."""

    def crossed(t: Column, low: Column, category: str, pattern: str, telling: bool | None) -> Column:
        def take(m: Column) -> Column:
            ok = ~m.rlike(f"[{MARKS}]")
            if telling is not None:
                inner = F.regexp_extract(m, java(pattern, "i"), 1)
                ok = ok & _slot(F.substring(inner, F.lit(2), F.length(inner) - 2), telling)
            return F.when(ok, F.concat(F.lit(_FIRST[category]), F.repeat(F.lit(_REST), F.length(m) - 1))).otherwise(m)

        def walk(found_: Column) -> Column:
            pieces = F.split(t, java(pattern, "i"), -1)
            joined = let(pieces, lambda p: F.concat(p[0], F.array_join(F.zip_with(found_, F.slice(p, F.lit(2), F.size(found_)), lambda m, s: F.concat(take(m), s)), "")))
            return F.when(F.size(found_) == 0, t).otherwise(joined)

        return let(every(t, pattern, "i", low=low), walk)

    def all_rules(clean: Column) -> Column:
        def run(low: Column) -> Column:
            out = clean
            for rule in R.PROSE:
                out = let(out, _after(crossed, rule, low))
            return out

        return let(F.lower(clean), run)

    return let(_clean(text), all_rules)


def _after(step, rule: tuple, low: Column):
    return lambda t: step(t, low, *rule)  # crossing out leaves no word that the text did not have: one lower case serves all rules


def prose_categories(crossed: Column) -> Column:
    """Categories of what :func:`crossed_prose` crossed out, in order."""
    names = F.create_map(*[F.lit(x) for c, mark in _FIRST.items() for x in (mark, c)])
    return F.transform(F.regexp_extract_all(crossed, F.lit(f"[{''.join(_FIRST.values())}]"), F.lit(0)), lambda m: F.element_at(names, m))


def _count(a: Column, test) -> Column:
    return F.size(F.filter(a, test))


def evaluate_requests(text: Column, strict: bool = False) -> Column:
    """What a text's requests show: numbers of requests, headers, placeholder headers, conflicts of lengths and broken ones, credentials and fake ones, placeholder bodies and prose payloads; ``fake`` and ``signal``, the first tell.

    ``strict``: requests whose lines do not end as the wire has them are fake, for attacks that depend on it.
    """

    def judged(x: Column) -> Column:
        rs = x["requests"]
        headers = F.flatten(F.transform(rs, lambda r: r["headers"]))

        def totals(h: Column) -> Column:
            credentials = F.filter(h, lambda v: v["name"].isin(*R.CREDENTIALS) & ~_hollow(v["value"]))
            last = lambda r, n: F.try_element_at(F.filter(r["headers"], lambda v: v["name"] == n), F.lit(-1))["value"]
            both = F.filter(F.transform(rs, lambda r: F.struct(last(r, "transfer-encoding").alias("te"), last(r, "content-length").alias("cl"))), lambda v: v["te"].isNotNull() & v["cl"].isNotNull())
            lines = F.filter(F.transform(rs, lambda r: F.concat(r["line"], r["head"])), lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) >= 2)
            return F.struct(
                F.size(rs).alias("requests"), F.size(h).alias("headers"), _count(h, lambda v: _hollow(v["value"])).alias("placeholder_headers"), (F.size(lines) > 0).alias("framed"), F.exists(lines, lambda c: c.contains("\r\n")).alias("crlf"),
                F.size(both).alias("conflicts"), _count(both, lambda v: ~found(v["te"], *R.CHUNKED) | ~found(v["cl"], *R.LENGTH)).alias("broken"), F.size(credentials).alias("credentials"),
                _count(credentials, _fake_credential).alias("fake_credentials"), _count(rs, lambda r: r["hollow"]).alias("placeholder_bodies"), F.size(x["prose"]).alias("prose_payloads"))

        return let(headers, totals)

    def tell(x: Column) -> Column:
        n, held = x["headers"], x["placeholder_headers"]
        signal = F.when((n >= R.FEWEST_HEADERS) & (100 * held >= R.PLACEHOLDER_SHARE * n), "placeholder_headers").when((x["conflicts"] > 0) & (x["broken"] == x["conflicts"]), "broken_te_cl_conflict")
        if strict:
            signal = signal.when(x["framed"] & ~x["crlf"] & (n >= R.FEWEST_HEADERS), "missing_crlf")
        signal = signal.when((n >= R.NONE_REAL) & (held == n), "no_real_header_values").when(x["fake_credentials"] > 0, "fake_credential_token").when((x["placeholder_bodies"] > 0) & (x["placeholder_bodies"] == x["requests"]), "placeholder_body")
        kept = [x[c].cast("bigint").alias(c) for c in ("requests", "headers", "placeholder_headers", "conflicts", "broken", "credentials", "fake_credentials", "placeholder_bodies", "prose_payloads")]
        return let(F.coalesce(signal, F.lit("")), lambda s: F.struct(*kept, x["crlf"].alias("crlf"), (s != "").alias("fake"), s.alias("signal")))

    known = let(_clean(F.coalesce(text, F.lit(""))), lambda t: F.struct(F.when(t.contains("HTTP/1."), requests(augmented(t))).otherwise(_none_of(requests(t))).alias("requests"), prose_categories(crossed_prose(t)).alias("prose")))
    return let(let(known, judged), tell)


def _none_of(like: Column) -> Column:
    return F.filter(F.slice(like, 1, 0), lambda x: F.lit(True))


def strip_placeholders(text: Column) -> Column:
    """The text with placeholder bodies and payloads of prose as spaces; where prose has such, all but code goes."""

    def bodies(t: Column) -> Column:
        whole = augmented(t)

        def rebuilt(a: Column) -> Column:
            lead = _parts(a, R.REQUEST)[0]
            joined = F.array_join(F.transform(requests(a), lambda r: F.concat(r["line"], r["head"], r["gap"], F.when(r["hollow"], _spaces(r["body"])).otherwise(r["body"]), r["rest"])), "")
            return F.substring(F.concat(lead, joined), F.lit(1), F.length(t))

        return F.when(t.contains("HTTP/1."), let(whole, rebuilt)).otherwise(t)

    def code(t: Column) -> Column:
        pieces, blocks = F.split(t, java(*R.CODE), -1), every(t, *R.CODE)
        return let(pieces, lambda p: F.concat(_spaces(p[0]), F.array_join(F.zip_with(blocks, F.slice(p, F.lit(2), F.size(p)), lambda b, s: F.concat(F.coalesce(b, F.lit("")), _spaces(F.coalesce(s, F.lit(""))))), "")))

    def crossed(x: Column) -> Column:
        both = F.zip_with(F.split(x["marked"], ""), F.zip_with(F.split(x["bodies"], ""), F.split(code(x["text"]), ""), lambda b, c: F.when(c == " ", " ").otherwise(b)), lambda m, c: F.when(m.rlike(f"[{MARKS}]"), " ").otherwise(c))
        return F.when(x["marked"].rlike(f"[{MARKS}]"), F.array_join(both, "")).otherwise(x["bodies"])

    return let(let(_clean(F.coalesce(text, F.lit(""))), lambda t: F.struct(t.alias("text"), bodies(t).alias("bodies"), crossed_prose(t).alias("marked"))), crossed)


def _real_values(json: Column) -> Column:
    """Whether a JSON text has values that come with real answers: ids, times or addresses that somebody's system has made."""

    def real_uuid(u: Column) -> Column:
        low, hexes = F.lower(u), F.lower(F.replace(u, F.lit("-"), F.lit("")))
        plain = F.forall(F.split(low, "-"), lambda p: F.replace(p, F.substring(p, 1, 1), F.lit("")) == "")
        rising = F.substring(F.translate(hexes, "0123456789abcdef", "123456789abcdef0"), 1, 31) == F.substring(hexes, 2, 31)
        return (_letters(hexes) > 4) & ~plain & ~rising

    return (
        F.exists(every(json, *R.UUID), real_uuid) | F.exists(every(json, *R.TIME), lambda t: ~found(t, *R.UNREAL_TIME)) | F.exists(every(json, *R.IPV4), lambda a: ~found(a, *R.UNREAL_IPV4))
        | F.exists(F.transform(every(json, *R.IPV6), F.lower), lambda a: ~found(a, *R.UNREAL_IPV6)))


def suspicious_json(body: Column) -> Column:
    """Whether a body is JSON that tells of an attack and has nothing that real answers carry besides."""

    def judged(v: Column) -> Column:
        def read(x: Column) -> Column:
            leaves = F.filter(every(x["json"], *R.JSON_STRING), lambda s: ~s.endswith(":"))
            tells = F.exists(leaves, lambda s: let(strip(F.substring(s, F.lit(2), F.length(s) - 2)), lambda w: w.rlike(r"\s|\\[nrtf]") & found(w, *R.NARRATIVE)))
            named = F.exists(x["keys"], lambda k: F.lower(k).isin(*R.INCIDENTAL_KEYS))
            an_object = (F.size(x["keys"]) > 0) & ~named & ((F.size(x["keys"]) <= 2) | (~_real_values(x["json"]) & tells))
            return found(x["json"], *R.NARRATIVE) & F.when(x["items"].isNotNull(), F.size(x["items"]) <= 1).otherwise(an_object)

        parts = F.struct(F.to_json(v).alias("json"), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")).alias("keys"), F.try_variant_get(v, "$", "array<variant>").alias("items"))
        return F.when(v.isNotNull(), let(parts, read))

    return F.coalesce(let(strip(body), lambda b: F.when(b.rlike(r"^[{\[]"), let(F.try_parse_json(b), judged))), F.lit(False))


def responses(text: Column) -> Column:
    """Array of the responses of a text: whole, names (of headers, once each), headers (their number), markers and fake."""

    def read(p: Column) -> Column:
        def judged(m: Column) -> Column:
            def marked(h: Column) -> Column:
                names = F.transform(h, lambda v: v["name"])
                lacks = lambda *ns: ~F.arrays_overlap(names, F.array(*[F.lit(n) for n in ns]))
                rules = (("missing_date_header", lacks("date")), ("missing_server_header", lacks("server")), ("suspicious_json_body", suspicious_json(m["body"])), ("missing_incidental_headers", lacks(*R.INCIDENTAL_HEADERS)))
                markers = F.array_compact(F.array(*[F.when(test & (F.size(h) > 0), F.lit(n)) for n, test in rules]))
                ends = F.when(m["gap"] == "", F.regexp_extract(m["head"], java(*R.BEFORE_FENCE), 1)).otherwise(F.concat(m["head"], m["gap"], m["body"]))
                return F.struct(F.concat(m["line"], ends).alias("shown"), F.size(h).alias("headers"), markers.alias("markers"), (F.size(markers) >= R.FLAGGED).alias("fake"))

            return let(_headers(m["head"]), marked)

        return let(_message(p), lambda m: let(judged(m), lambda j: F.struct(p.alias("whole"), j["shown"].alias("shown"), j["headers"].alias("headers"), j["markers"].alias("markers"), j["fake"].alias("fake"))))

    return let(_parts(text, R.RESPONSE), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), read))


def evaluate_responses(text: Column) -> Column:
    """What a text's responses show: numbers of responses with headers and of fake ones, headers, how often each marker, fake, and the markers of the fake ones."""

    def judged(rs: Column) -> Column:
        answered = F.filter(rs, lambda r: r["headers"] > 0)
        times = lambda name: _count(rs, lambda r: F.array_contains(r["markers"], name)).cast("bigint")
        fakes = F.filter(rs, lambda r: r["fake"])
        return F.struct(
            F.size(answered).cast("bigint").alias("responses"), F.size(fakes).cast("bigint").alias("flagged"), F.aggregate(rs, F.lit(0).cast("bigint"), lambda a, r: a + r["headers"]).alias("headers"),
            times("missing_date_header").alias("missing_date"), times("missing_server_header").alias("missing_server"), times("suspicious_json_body").alias("suspicious_json"), times("missing_incidental_headers").alias("missing_incidentals"),
            (F.size(fakes) > 0).alias("fake"), F.array_sort(F.array_distinct(F.flatten(F.transform(fakes, lambda r: r["markers"])))).alias("signals"))

    t = _clean(F.coalesce(text, F.lit("")))
    return let(let(t, lambda x: F.when(x.contains("HTTP/1."), responses(x)).otherwise(_none_of(responses(x)))), judged)


def strip_fake_responses(text: Column) -> Column:
    """The text with its fake responses as spaces."""

    def crossed(t: Column) -> Column:
        joined = F.array_join(F.transform(responses(t), lambda r: F.when(r["fake"], F.concat(_spaces(r["shown"]), F.substring(r["whole"], F.length(r["shown"]) + 1, F.length(r["whole"])))).otherwise(r["whole"])), "")
        return F.when(t.contains("HTTP/1."), F.concat(_parts(t, R.RESPONSE)[0], joined)).otherwise(t)

    return let(_clean(F.coalesce(text, F.lit(""))), crossed)
