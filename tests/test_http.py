"""Raw HTTP: hand-made expectations, and the queries against their SQL."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from sievemark.operators import raw_http as H
from sievemark.plans.all import QUERIES, SQL


def b64(x):
    return base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")


def jwt(claims, signature="Zk3h8Q0vLw7pTn2YbXcE"):
    return f"{b64('{}')}.{b64(claims if isinstance(claims, str) else json.dumps(claims))}.{signature}"


def request(*headers, body=None, line="POST /a?b=1 HTTP/1.1", nl="\r\n"):
    return line + nl + nl.join(headers) + (nl + nl + body if body is not None else nl)


REAL = ("Host: shop.example.org", "Accept: */*")
REQUESTS = [
    # text, fake signal ('' none), expected counts
    (None, "", {"requests": 0}),
    ("no http here", "", {"requests": 0, "prose_payloads": 0}),
    ("see GET /x HTTP/1.1 in a line", "", {"requests": 0}),
    (request(*REAL), "", {"requests": 1, "headers": 2, "placeholder_headers": 0, "crlf": True}),
    (request("Host: <your-host>", "X-Id: 7"), "placeholder_headers", {"headers": 2, "placeholder_headers": 1}),
    (request("Host: <t>", "Accept: */*", "X: y"), "", {"placeholder_headers": 1}),
    (request("Host: NN", "Cookie:", "A: b"), "placeholder_headers", {"placeholder_headers": 2}),
    (request("Host:"), "", {"headers": 1, "placeholder_headers": 1}),
    (request(*REAL, "Content-Length: abc", "Transfer-Encoding: chunked"), "broken_te_cl_conflict", {"conflicts": 1, "broken": 1}),
    (request(*REAL, "Content-Length: 6", "Transfer-Encoding: xchunked"), "broken_te_cl_conflict", {"conflicts": 1, "broken": 1}),
    (request(*REAL, "Content-Length: 6", "Transfer-Encoding: chunked"), "", {"conflicts": 1, "broken": 0}),
    (request(*REAL, "Content-Length: x", "Content-Length: 6", "Transfer-Encoding: gzip, chunked"), "", {"conflicts": 1, "broken": 0}),  # the last counts
    # credentials
    (request(*REAL, f"Authorization: Bearer {jwt({'sub': 'u-81723', 'iat': 1700000000})}"), "", {"credentials": 1, "fake_credentials": 0}),
    (request(*REAL, f"Authorization: Bearer {jwt({'sub': 'Admin'})}"), "fake_credential_token", {"fake_credentials": 1}),
    (request(*REAL, f"Authorization: JWT {jwt({'sub': '<user>'})}"), "fake_credential_token", {"fake_credentials": 1}),
    (request(*REAL, f"Authorization: Bearer {jwt({'n': 5, 'x': '00000'})}"), "fake_credential_token", {}),
    (request(*REAL, f"Authorization: Bearer {jwt({})}"), "fake_credential_token", {}),
    (request(*REAL, f"Authorization: Bearer {jwt('[1]')}"), "fake_credential_token", {}),
    (request(*REAL, f"Authorization: Bearer {jwt('no json')}"), "fake_credential_token", {}),
    (request(*REAL, f"Authorization: Bearer {jwt({'sub': 'u-1'}, 'short')}"), "fake_credential_token", {}),
    (request(*REAL, f"Authorization: Bearer {jwt({'sub': 'u-1'}, 'ab' * 12)}"), "fake_credential_token", {}),
    (request(*REAL, "Authorization: Bearer a..c"), "fake_credential_token", {}),
    (request(*REAL, "Authorization: Bearer aaaaaaaaaaaa"), "fake_credential_token", {}),
    (request(*REAL, "Authorization: Bearer 8f2c91d07ab34e55"), "", {"credentials": 1}),
    (request(*REAL, "Authorization: Basic " + base64.b64encode(b"admin:secret").decode()), "fake_credential_token", {}),
    (request(*REAL, "Authorization: Basic " + base64.b64encode(b"mkoenig:Tr0ub4dor").decode()), "", {"credentials": 1}),
    (request(*REAL, "Cookie: sid=00000000000; theme=xxxxxxxxxx"), "fake_credential_token", {}),
    (request(*REAL, "Cookie: sid=00000000000; theme=dark9x2kq"), "", {"credentials": 1, "fake_credentials": 0}),
    (request(*REAL, 'Set-Cookie: sid="aaaaaaaaaa"'), "fake_credential_token", {}),
    (request(*REAL, "X-Api-Key: 0000-0000-0000"), "fake_credential_token", {}),
    # bodies
    (request(*REAL, body="<payload>"), "placeholder_body", {"placeholder_bodies": 1}),
    (request(*REAL, body="TBD"), "placeholder_body", {}),
    (request(*REAL, body="x=[your token here]"), "placeholder_body", {}),
    (request(*REAL, body="user=ann&pin=1821"), "", {"placeholder_bodies": 0}),
    (request(*REAL, body="a=1<b>9$</b>"), "placeholder_body", {}),  # a bare name between angle brackets is a slot
    (request(*REAL, body="x=<1-2-3>"), "", {"placeholder_bodies": 0}),
    ("```\n" + request(*REAL, body="id=1") + "\n```\nthen <payload>", "", {"placeholder_bodies": 0}),  # the fence ends the body
    (request(*REAL, body="<payload>") + "\n" + request(*REAL, body="id=1"), "", {"requests": 2, "placeholder_bodies": 1}),
    # shell-escaped
    (r"printf 'GET /a HTTP/1.1\r\nHost: <target>\r\nX: [your id]\r\n\r\n' | nc", "placeholder_headers", {"requests": 1, "headers": 2}),
    (r'echo -e "GET /a HTTP/1.1\r\nHost: h.org\r\n\r\n" | nc', "", {"requests": 1, "headers": 1}),
    (r"printf $'GET /\'a HTTP/1.1\r\nHost: h.org\r\nB: c\r\n'", "", {"requests": 1, "headers": 2}),
    # prose
    ("payload: <insert here>", "", {"prose_payloads": 1, "requests": 0}),
    ("Payload: `<script>`", "", {"prose_payloads": 1}),
    ("payload: <1-2>", "", {"prose_payloads": 0}),
    ("we send `<cmd>` and then send <b> twice, sending <payload>", "", {"prose_payloads": 2}),
    ("`<x>` is the malicious payload", "", {"prose_payloads": 1}),
    ("exploit: TBD and command = [will be added later]", "", {"prose_payloads": 2}),
    ("the payload (to be provided shortly) and our exploit will be disclosed", "", {"prose_payloads": 2}),
    ("I'll share the exact payload, we will post the exploit in a follow-up; we plan to attach the command", "", {"prose_payloads": 2}),
    ("[insert your sql payload here]", "", {"prose_payloads": 1}),
]


def held(spark, cases, column):
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    return {r.i: r.x for r in d.select("i", column(F.col("text")).alias("x")).collect()}


def test_hand_made_requests(spark):
    got = held(spark, REQUESTS, H.evaluate_requests)
    wrong = [(c[0], c[1:], got[i]) for i, c in enumerate(REQUESTS) if got[i].signal != c[1] or got[i].fake != (c[1] != "") or any(got[i][k] != v for k, v in c[2].items())]
    assert not wrong, wrong


def test_line_ends_count_where_they_must(spark):
    cases = [(request(*REAL, nl="\n"), "missing_crlf"), (request(*REAL), ""), (request(*REAL, nl="\n") + "\n" + request(*REAL), ""), (request("Host: h.org", nl="\n"), "")]
    got = held(spark, cases, lambda t: H.evaluate_requests(t, strict=True))
    assert [got[i].signal for i in range(len(cases))] == [c[1] for c in cases]


def answer(*headers, body=None, line="HTTP/1.1 200 OK"):
    return "\r\n".join([line, *headers]) + ("\r\n\r\n" + body if body is not None else "\r\n")


FULL = ("Date: Mon, 03 Jun 2024 10:11:12 GMT", "Server: nginx", "Content-Length: 20")
TELLING = '{"status":"ok","message":"The exploit worked","user":"ann"}'
RESPONSES = [
    (None, 0, 0, []),
    ("HTTP/1.1 200 OK in a line", 0, 0, []),
    (answer(*FULL), 1, 0, []),
    (answer(*FULL[1:]), 1, 0, []),
    (answer("Content-Length: 9"), 1, 1, ["missing_date_header", "missing_server_header"]),
    (answer("Content-Type: text/html"), 1, 1, ["missing_date_header", "missing_incidental_headers", "missing_server_header"]),
    (answer(), 0, 0, []),  # without headers it is not judged
    (answer(*FULL, body=TELLING), 1, 0, []),
    (answer(*FULL[1:], body=TELLING), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='{"admin":"leaked"}'), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='{"id":7,"message":"The exploit worked"}'), 1, 0, []),  # an id comes with real answers
    (answer(*FULL[1:], body='[{"m":"injection ok"}]'), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='[{"m":"injection ok"},{"m":"x"}]'), 1, 0, []),
    (answer(*FULL[1:], body='{"a":"b","c":"d","e":"attack"}'), 1, 0, []),  # a word is no sentence
    (answer(*FULL[1:], body='{"a":"b","c":"d","e":{"f":["an attack, done"]}}'), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='{"a":"9b2e4c1d-7f3a-4b8e-a1c2-5d6e7f809a1b","c":"d","e":"an attack, done"}'), 1, 0, []),
    (answer(*FULL[1:], body='{"a":"00000000-0000-0000-0000-000000000000","c":"d","e":"an attack, done"}'), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='{"a":"01234567-89ab-cdef-0123-456789abcdef","c":"d","e":"an attack, done"}'), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='{"a":"2024-06-03T10:11","c":"d","e":"an attack, done"}'), 1, 0, []),
    (answer(*FULL[1:], body='{"a":"2024-01-01","b":"1970-01-01T05:06","c":"d","e":"an attack, done"}'), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='{"a":"81.2.69.142","c":"d","e":"an attack, done"}'), 1, 0, []),
    (answer(*FULL[1:], body='{"a":"192.168.1.4 10.0.0.1 203.0.113.9 300.1.1.1","c":"d","e":"an attack, done"}'), 1, 1, ["missing_date_header", "suspicious_json_body"]),
    (answer(*FULL[1:], body='{"a":"2a02:8108:96bf:1","c":"d","e":"an attack, done"}'), 1, 0, []),
    (answer(*FULL[1:], body="{not json: attack}"), 1, 0, []),
    (answer("A: b") + "\n" + answer(*FULL), 2, 1, ["missing_date_header", "missing_incidental_headers", "missing_server_header"]),
]


def test_hand_made_responses(spark):
    got = held(spark, RESPONSES, H.evaluate_responses)
    wrong = [(c, got[i]) for i, c in enumerate(RESPONSES) if (got[i].responses, got[i].flagged, list(got[i].signals), got[i].fake) != (c[1], c[2], c[3], c[2] > 0)]
    assert not wrong, wrong


def test_what_is_crossed_out_keeps_its_place(spark):
    body = request(*REAL, body="<payload>")
    fake = answer("A: b", body="secret")
    cases = [
        (body, body[: -len("<payload>")] + " " * len("<payload>"), body),
        ("a\n" + fake + "\n```\nkept", "a\n" + fake, " "),
        ("run `id; ls` with payload: <insert> now", None, None),
    ]
    stripped = held(spark, cases, H.strip_placeholders)
    assert stripped[0] == cases[0][1]
    assert stripped[2] == " " * 4 + "`id; ls`" + " " * len(" with payload: <insert> now")
    left = held(spark, cases, H.strip_fake_responses)
    assert left[0] == body and left[1] == "a\n" + " " * len(fake) + "\n```\nkept"
    assert held(spark, [(r"say 'PUT /q HTTP/1.0\r\nA: b\\r\x' $'GET / HTTP/1.1\r\nQ: \'\e'",)], H.fragments)[0] == "PUT /q HTTP/1.0\r\nA: b\\r\\x\n\nGET / HTTP/1.1\r\nQ: '\x1b"
    texts = [c[0] for c in REQUESTS + RESPONSES if c[0]]
    for column in (H.strip_placeholders, H.strip_fake_responses):
        assert all(len(held_text) == len(t) for held_text, t in zip(held(spark, [(t,) for t in texts], column).values(), texts))


def test_categories_of_prose_come_in_order(spark):
    text = "[insert payload] then payload: <x>; the exploit will be posted. cmd: tbd"
    got = held(spark, [(text,)], lambda t: H.prose_categories(H.crossed_prose(t)))
    assert list(got[0]) == ["bracket", "slot", "deferred", "label"]


@pytest.mark.parametrize("name", ["raw_http_requests", "raw_http_responses", "placeholders_stripped", "fake_responses_stripped", "gold_signals_left"])
def test_queries_equal_their_sql(name, same):
    same(QUERIES[name], SQL[name])


def test_payloads_must_be_left_without_placeholders(spark):
    from sievemark.operators import claims

    cases = ["' union select a from b--", "payload: <insert here>. ' union select a from b--", "payload: <insert here>. `' union select a from b--`", "payload: <x>; stat(a) then open(a)", None]
    d = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    both = {r.i: (r.a, r.b, r.text) for r in claims.gold_signals(claims.gold_signals_left(d).withColumnsRenamed({"gold": "b", "gold_bonus": "p"})).withColumnRenamed("gold", "a").collect()}
    assert ["sql_injection_payload" in both[i][0] for i in range(4)] == [True, True, True, False]
    assert ["sql_injection_payload" in both[i][1] for i in range(4)] == [True, False, True, False]
    assert both[3][0] == both[3][1] and both[4] == ([], [], None)
