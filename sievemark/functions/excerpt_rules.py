"""Rules of answers, pasted into a text, that no server gives. Patterns, names and bounds are fixed values."""

from __future__ import annotations

#: A fenced block: its label and what it holds.
FENCE = (r"```([a-zA-Z0-9_+-]*)\r?\n([\s\S]*?)\r?\n```", "")

# HTTP messages.
START = (r"(^|\n)(HTTP/1\.[01][ \t]+\d{3}[ \t]+[^\r\n]{1,80}\r?\n|[A-Z]{3,10}[ \t]+\S+[ \t]+HTTP/1\.[01]\r?\n)", "")
STATUS_LINE = (r"^HTTP/1\.[01][ \t]+(\d{3})[ \t]+([^\r\n]{1,80})", "")
METHOD = (r"^([A-Z]{3,10})[ \t]", "")
BLANK_FIRST = (r"^\r?\n", "")
HEAD_AND_BODY = (r"^([\s\S]*?)\r?\n\r?\n([\s\S]*)$", "")
HEADER = (r"^([A-Za-z][A-Za-z0-9\-_]*)\s*:\s*(.*?)\s*$", "")
REASONS = {
    100: ("continue",), 101: ("switching protocols",),
    200: ("ok",), 201: ("created",), 202: ("accepted",), 203: ("non-authoritative information",), 204: ("no content",), 205: ("reset content",), 206: ("partial content",),
    301: ("moved permanently",), 302: ("found", "moved temporarily"), 303: ("see other",), 304: ("not modified",), 307: ("temporary redirect",), 308: ("permanent redirect",),
    400: ("bad request",), 401: ("unauthorized",), 403: ("forbidden",), 404: ("not found",), 405: ("method not allowed",), 406: ("not acceptable",), 408: ("request timeout",), 409: ("conflict",), 410: ("gone",),
    411: ("length required",), 413: ("payload too large", "request entity too large", "content too large"), 414: ("uri too long", "request-uri too long"), 415: ("unsupported media type",), 418: ("i'm a teapot", "im a teapot"),
    422: ("unprocessable entity", "unprocessable content"), 429: ("too many requests",),
    500: ("internal server error",), 501: ("not implemented",), 502: ("bad gateway",), 503: ("service unavailable",), 504: ("gateway timeout",), 505: ("http version not supported",),
}
REQUEST_ONLY = ("cookie", "referer", "origin", "range", "if-none-match", "if-modified-since")
RESPONSE_ONLY = ("set-cookie", "www-authenticate", "proxy-authenticate", "location")
NO_BODY_TO = ("HEAD", "CONNECT")
#: A body from so many characters on is one; lengths declared: empty, for certain not empty, and from where and how far they may be off.
BODY, DECLARED, DECLARED_FROM, OFF, OFF_SHARE = 8, 100, 20, 50, 0.5

# GraphQL responses.
GRAPHQL_LABELS = ("graphql", "graphql-response", "gql")
PROSE = 400
FABRICATED_CODES = (
    "INJECTION", "EXPLOIT", "RCE_", "_RCE", "SQLI", "XSS_", "_XSS", "IDOR", "PWNED", "STOLEN", "VULNERAB", "_LEAKED", "LEAK_", "_LEAK_", "BYPASS_SUCCESS", "BYPASS_TRIGGERED", "BYPASS_ACHIEVED", "BYPASS_DETECTED",
    "BYPASS_CONFIRMED", "ATTACK_SUCCESS", "ATTACK_TRIGGERED",
)

#: Weight of each marker.
MARKER_WEIGHT = 8
