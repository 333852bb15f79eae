"""Answers pasted into fenced blocks that no server gives: HTTP messages and GraphQL responses.

Native expressions over one text column; JSON is read as variants. Each gives the
distinct names of what is wrong, in order of name; a text without fences, or a
null one, has none. Lengths are in characters. JSON in which a key is repeated
is not read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import excerpt_rules as R
from ..functions.text import every, found, java, let
from .sections import strip

_MARK = "\x01"


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _named(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the names whose test holds."""
    return F.array_compact(F.array(*[F.when(test, name if isinstance(name, Column) else F.lit(name)) for test, name in rules]))


def _sorted(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(names)))


def messages(block: Column) -> Column:
    """Array of the HTTP/1 messages of a block: ``code`` and ``phrase`` ('' for a request), ``method``, ``names`` of headers, ``declared`` length, ``body`` and ``size``, its length trimmed."""
    parts = F.split(F.regexp_replace(F.translate(block, _MARK, " "), java(*R.START), f"$1{_MARK}$2"), _MARK)

    def message(p: Column) -> Column:
        def cut(x: Column) -> Column:
            tail, blank = x["tail"], found(x["tail"], *R.BLANK_FIRST)
            both = found(tail, *R.HEAD_AND_BODY)
            group = lambda k: F.regexp_extract(tail, java(*R.HEAD_AND_BODY), k)
            return F.struct(
                x["line"].alias("line"), F.when(blank, "").when(both, group(1)).otherwise(tail).alias("head"),
                F.when(blank, F.regexp_replace(tail, java(*R.BLANK_FIRST), "")).when(both, group(2)).otherwise("").alias("body"),
            )

        def read(x: Column) -> Column:
            lines = F.filter(F.transform(F.split(x["head"], r"\r?\n"), strip), lambda s: found(s, *R.HEADER))
            headers = F.transform(lines, lambda s: F.struct(F.lower(F.regexp_extract(s, java(*R.HEADER), 1)).alias("name"), F.regexp_extract(s, java(*R.HEADER), 2).alias("value")))
            status = lambda k: F.regexp_extract(x["line"], java(*R.STATUS_LINE), k)

            def whole(h: Column) -> Column:
                length = F.try_element_at(F.filter(h, lambda v: v["name"] == "content-length"), F.lit(-1))["value"]  # the last one counts
                return F.struct(
                    status(1).alias("code"), status(2).alias("phrase"), F.when(status(1) == "", F.regexp_extract(x["line"], java(*R.METHOD), 1)).otherwise("").alias("method"), F.transform(h, lambda v: v["name"]).alias("names"),
                    F.when(length.rlike(r"^\d+\z"), length.cast("double")).alias("declared"), F.length(x["body"]).alias("actual"), F.length(strip(x["body"])).alias("size"),
                )

            return let(headers, whole)

        line = F.regexp_extract(p, r"^[^\n]*\n", 0)
        return let(let(let(line, lambda s: F.struct(s.alias("line"), F.substring(p, F.length(s) + 1, F.length(p)).alias("tail"))), cut), read)

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), message)


def _wrong(m: Column, before: Column) -> Column:
    code, size, declared = m["code"], m["size"], m["declared"]
    phrase = F.regexp_replace(F.lower(strip(m["phrase"])), r"\s+", " ")
    known = F.array(*[F.lit(str(c)) for c in R.REASONS])
    right = F.array(*[F.lit(f"{c} {p}") for c, ps in R.REASONS.items() for p in ps])
    body = size >= R.BODY
    length = F.when((declared == 0) & body, "content_length_zero_but_body_present").when((declared >= R.DECLARED) & (size == 0), "content_length_declared_but_body_empty").when(
        (declared > R.DECLARED_FROM) & (size > 0) & (F.abs(declared - m["actual"]) > F.greatest(F.lit(float(R.OFF)), declared * R.OFF_SHARE)), "content_length_disagrees_with_body")
    has = lambda n: F.array_contains(m["names"], n)
    answer = _named(
        (F.array_contains(known, code) & (phrase != "") & ~F.array_contains(right, F.concat_ws(" ", code, phrase)), F.concat(F.lit("status_"), code, F.lit("_with_wrong_reason_phrase"))),
        (code.rlike("^(?:204|304|1..)$") & body, F.concat(F.lit("status_"), code, F.lit("_must_have_no_body"))), (length.isNotNull(), length),
        *[(has(n), f"response_carries_request_only_{n}") for n in R.REQUEST_ONLY], *[((before == n) & body, f"response_to_{n}_must_have_no_body") for n in R.NO_BODY_TO],
    )
    return F.when(code != "", answer).otherwise(_named(*[(has(n), f"request_carries_response_only_{n}") for n in R.RESPONSE_ONLY]))


def impossible_http(text: Column) -> Column:
    """What is wrong with the HTTP messages in fenced blocks: reason phrases, bodies and lengths, headers of the other side."""

    def block(b: Column) -> Column:
        methods = lambda ms: F.concat(F.array(F.lit("")), F.transform(ms, lambda m: m["method"]))
        return let(messages(b), lambda ms: F.flatten(F.zip_with(ms, F.slice(methods(ms), F.lit(1), F.size(ms)), _wrong)))

    fenced = F.filter(every(text, *R.FENCE, 2), lambda b: b.contains("HTTP/1."))
    return F.when(text.contains("```"), _sorted(F.transform(fenced, block))).otherwise(_no_names())


def _fences(text: Column) -> Column:
    """Array of fenced blocks: ``label``, ``inner``, and whether the prose just before speaks of GraphQL."""
    pieces, blocks = F.split(text, java(*R.FENCE), -1), every(text, *R.FENCE)

    def walk(x: Column) -> Column:
        start = F.struct(F.lit("").alias("tail"), F.array().cast("array<boolean>").alias("out"))
        near = lambda a, z: F.right(F.concat(a["tail"], z["piece"]), F.lit(R.PROSE))
        step = lambda a, z: F.struct(F.right(F.concat(a["tail"], z["piece"], z["block"]), F.lit(R.PROSE)).alias("tail"), F.concat(a["out"], F.array(F.lower(near(a, z)).contains("graphql"))).alias("out"))
        pairs = F.zip_with(F.slice(x["pieces"], F.lit(1), F.size(x["blocks"])), x["blocks"], lambda p, b: F.struct(p.alias("piece"), b.alias("block")))
        said = F.aggregate(pairs, start, step, lambda a: a["out"])
        return F.zip_with(x["blocks"], said, lambda b, s: F.struct(F.regexp_extract(b, java(*R.FENCE), 1).alias("label"), F.regexp_extract(b, java(*R.FENCE), 2).alias("inner"), s.alias("said")))

    return let(F.struct(pieces.alias("pieces"), blocks.alias("blocks")), walk)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def impossible_graphql(text: Column) -> Column:
    """What is wrong with the GraphQL responses in fenced blocks: no data without errors, paths that lead nowhere or to data, codes that tell of an attack's success."""

    def shaped(e: Column) -> Column:
        return _get(e, "$.locations", "array<variant>").isNotNull() | _get(e, "$.path", "array<variant>").isNotNull() | _get(e, "$.extensions", "map<string,variant>").isNotNull()

    def one(f: Column) -> Column:
        return let(F.struct(F.try_parse_json(f["inner"]).alias("j"), f["label"].alias("label"), f["said"].alias("said")), opened)

    def opened(x: Column) -> Column:
        j = x["j"]
        top = _get(j, "$", "map<string,variant>")
        has = lambda k: F.coalesce(F.array_contains(F.map_keys(top), k), F.lit(False))
        known = F.struct(
            has("data").alias("has_data"), has("errors").alias("has_errors"), F.coalesce(F.is_variant_null(F.try_element_at(top, F.lit("data"))), F.lit(False)).alias("null_data"),
            _get(j, "$.data", "map<string,variant>").alias("data"), _get(j, "$.errors", "array<variant>").alias("errors"), x["label"].alias("label"), x["said"].alias("said"),
        )
        return let(known, judged)

    def judged(g: Column) -> Column:
        is_graphql = F.lower(g["label"]).isin(*R.GRAPHQL_LABELS) | F.coalesce(F.exists(g["errors"], shaped), F.lit(False)) | (g["has_data"] & (g["has_errors"] | g["said"]))
        whole = _named((g["has_data"] & g["null_data"] & ~g["has_errors"], "data_null_with_no_errors"), (F.coalesce(F.size(g["errors"]) == 0, F.lit(False)) & g["errors"].isNotNull(), "empty_errors_array"))

        def error(e: Column) -> Column:
            head = F.get(_get(e, "$.path", "array<variant>"), F.lit(0))
            name = F.when(F.schema_of_variant(head) == "STRING", _get(head, "$", "string"))
            value = F.try_element_at(g["data"], name)
            code = F.when(F.schema_of_variant(F.try_element_at(_get(e, "$.extensions", "map<string,variant>"), F.lit("code"))) == "STRING", F.upper(_get(e, "$.extensions.code", "string")))
            attack = F.exists(F.array(*[F.lit(c) for c in R.FABRICATED_CODES]), lambda c: code.contains(c))
            there = F.array_contains(F.map_keys(g["data"]), name)
            return _named((~there, "error_path_references_unknown_field"), (there & ~F.is_variant_null(value), "errored_field_not_null"), (attack, "fabricated_extensions_code"))

        errors = F.coalesce(F.flatten(F.transform(g["errors"], error)), _no_names())
        return F.when((g["has_data"] | g["has_errors"]) & is_graphql, F.concat(whole, errors)).otherwise(_no_names())

    return F.when(text.contains("```"), _sorted(F.transform(_fences(text), one))).otherwise(_no_names())
