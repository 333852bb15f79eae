"""Rules of raw HTTP requests and responses pasted into a text: what shows that no client or server sent them. Patterns, names and bounds are fixed values."""

from __future__ import annotations

# Shell-escaped messages: quoted strings with \r\n written out.
SINGLE_QUOTED = r"(?<!\$)'([^'\n]*HTTP/1\.[01]\\r\\n[^'\n]*)'"
#: The same without looking behind, in group 2.
SINGLE_QUOTED_RE2 = r"(^|[^$])'([^'\n]*HTTP/1\.[01]\\r\\n[^'\n]*)'"
DOUBLE_QUOTED = (r'"([^"\n]*HTTP/1\.[01]\\r\\n[^"\n]*)"', "")
ANSI_QUOTED = (r"\$'((?:\\.|[^'\n])*HTTP/1\.[01]\\r\\n(?:\\.|[^'\n])*)'", "")
ESCAPES = {"r": "\r", "n": "\n", "t": "\t", "v": "\x0b", "a": "\x07", "b": "\x08", "e": "\x1b", "E": "\x1b", "f": "\x0c", "0": "\x00", "'": "'", '"': '"'}

# Requests.
REQUEST = (r"(^|\n)([A-Z]{3,10}[ \t]+\S+[ \t]+HTTP/1\.[01]\r?\n)", "")
RESPONSE = (r"(^|\n)(HTTP/1\.[01][ \t]+\d{3}[ \t]+[A-Za-z][A-Za-z0-9 .\-]{0,40}\r?\n)", "")
HEAD_AND_BODY = (r"^([\s\S]*?)(\r?\n\r?\n)([\s\S]*)$", "")
#: What comes before a fence.
BEFORE_FENCE = (r"^([\s\S]*?)(?:(?:^|\n)```[\s\S]*)?$", "")
HEADER = (r"^([A-Za-z][A-Za-z0-9\-_]*)\s*:\s*(.*?)\s*$", "")
PLACEHOLDER_VALUE = (
    r"^$|<[^>\n]{0,40}(?:target|host|value|here|your|insert|placeholder|fill|chunked|length|hex|crlf|payload|body)[^>\n]{0,40}>|\[(?:your|insert|placeholder|fill|todo|tbd)[^\]]*\]|\?\?\?+|\b(?:tbd|todo|fixme|placeholder)\b", "i")
PLACEHOLDER_RUN = (r"^<[^>\s]{1,12}>$|^(?:XX+|NN+|ZZ+|YY+)$", "")
CHUNKED, LENGTH = (r"\bchunked\b", "i"), (r"^\s*\d+\s*$", "")
#: Placeholder headers of all, in hundredths, and the fewest headers to judge; fewest without a real value.
PLACEHOLDER_SHARE, FEWEST_HEADERS, NONE_REAL = 50, 2, 3

AUTHORIZATION = ("authorization", "proxy-authorization")
COOKIES = ("cookie", "set-cookie")
CREDENTIALS = (*AUTHORIZATION, *COOKIES, "x-auth-token", "x-api-key", "x-session-token")
BEARER = (r"^(?:Bearer|Token|JWT)\s+(\S.*)$", "i")
BASIC = (r"^Basic\s+(\S+?)=*$", "i")
BASIC_PLACEHOLDER = (r"^(?:admin|user|test|root|guest):.{0,40}$", "i")
CLAIMS = ("admin", "administrator", "root", "user", "username", "userid", "guest", "test", "testuser", "example", "placeholder", "todo", "tbd", "fixme", "null", "none", "string")
CLAIM_PLACEHOLDER = (r"^<[^>\n]{0,40}>$|^(?:X{3,}|N{3,}|Z{3,}|Y{3,}|0{3,})$", "i")
SIGNATURE, OPAQUE, FEW_LETTERS = 16, 8, 2

BODY_WORD = (r"^(?:tbd|todo|fixme|placeholder|n/?a)$", "i")
BODY_BRACKET = (r"\[(?:your|insert|placeholder|fill|todo|tbd|payload|inject|here)\b[^\]]*\]", "i")
ANGLE = (r"<([^>\n]{1,80})>", "")
SLOT_WORDS = (
    r"payload|inject|sqli?|cmd|command|shell|body|here|placeholder|insert|fill|target|host|value|your|jwt|token|hex|crlf|length|chunked|smuggled|attack(?:er)?|victim|exploit|malicious|user[\s_-]?input|param(?:eter)?|fixme|todo|tbd|"
    r"secret|admin|password|hash|nosql|ldap|template|xpath|xxe|filename|filepath|file[\s_-]?path", "i")
SLOT_NAME = (r"^[a-z][a-z0-9_\-\s]{0,30}$", "i")

# Payloads that prose speaks of and does not give.
_NOUN = r"payloads?|inject(?:ion|ed|s)?|exec(?:ute|s)?|runs?|commands?|cmd|shells?|sqli?|nosql|ldap|xpath|template"
_THING = r"payloads?|inject(?:ion|s)?|commands?|cmd|exploits?|sqli?|nosql|ldap|xpath|template"
_DASH = "–—"
_DONE = r"(?:added|determined|filled(?:\s+in)?|provided|inserted|named|specified|disclosed|posted|published|shared|attached)"
#: Category, pattern (group 1 is the slot), whether the slot needs a tell-tale word; without slot None.
PROSE = (
    ("slot", rf"\b(?:{_NOUN})\s*[:=]\s*[`'\"]?(<[^>\n]{{1,80}}>)[`'\"]?", False),
    ("slot", rf"\b(?:{_NOUN}|send(?:s|ing|t)?)[\s,({_DASH}]+`(<[^>\n`]{{1,80}}>)`", False),
    ("slot", rf"\b(?:{_NOUN}|send(?:s|ing|t)?)[\s,({_DASH}]+(<[^>\n`]{{1,80}}>)", True),
    ("slot", rf"\b(?:{_NOUN}|send(?:s|ing|t)?)[\s,({_DASH}]+\"(<[^>\n\"]{{1,80}}>)\"", True),
    ("slot", rf"\b(?:{_NOUN}|send(?:s|ing|t)?)[\s,({_DASH}]+\[(<[^>\n\]]{{1,80}}>)\]", True),
    ("slot", rf"`(<[^>\n`]{{1,80}}>)`[\s,{_DASH}]+(?:is|was|were|are|seems|appears)[a-zA-Z \-]{{1,25}}?\b(?:{_NOUN})\b", False),
    ("label", rf"\b(?:{_NOUN}|exploits?)\s*[:=]\s*[`'\"]?(?:(?:tbd|todo|fixme|placeholder|n/?a)\b|\[(?:your|insert(?:ed)?|placeholder|fill|todo|tbd|fixme|payload|inject|here|add(?:ed)?|to[\s-]?be|will[\s-]?be|n/?a|actual|real)\b[^\]\n]{{0,60}}\])[`'\"]?", None),
    ("parenthetical", rf"\b(?:{_NOUN}|exploits?)\s+\(\s*(?:tbd|todo|fixme|placeholder|n/?a|forthcoming|coming\s+soon|added\s+(?:later|soon)|to\s+be\s+{_DONE}|will\s+be\s+{_DONE})\b[^)\n]{{0,40}}\)", None),
    ("deferred", rf"\b(?:the|a|an|our|my|this|that)\s+(?:actual\s+|real\s+|exact\s+|specific\s+|full\s+|complete\s+)?(?:{_THING})\s+(?:will\s+be|is\s+to\s+be|to\s+be|has\s+been|was|were)\s+(?:added|provided|filled(?:\s+in)?|inserted|specified|determined|posted|shared|published|disclosed|named|listed|attached)\b", None),
    ("promise", rf"\b(?:i|we)(?:'ll|\s+will|\s+can|\s+plan\s+to|\s+intend\s+to)\s+(?:add|provide|insert|share|post|publish|disclose|attach|specify|fill\s+in|include)\s+(?:the\s+)?(?:(?:actual|real|exact|specific|full|complete)\s+(?:{_THING})|(?:{_THING})\b[^.\n]{{0,60}}?\b(?:later|soon|shortly|tomorrow|asap|in\s+(?:a\s+)?(?:follow[\s-]?up|comment|comments|update))\b)", None),
    ("bracket", r"\[(?:your|insert(?:ed)?|placeholder|fill|todo|tbd|fixme|add(?:ed)?|to[\s-]?be|will[\s-]?be|n/?a|actual|real)\b[^\]\n]{0,60}(?:payload|inject|exploit|sqli?|cmd|command|shell|exec|nosql|ldap|xpath|template)[^\]\n]{0,40}\]", None),
)
CATEGORIES = ("slot", "label", "parenthetical", "deferred", "promise", "bracket")
#: Code, fenced or within a line.
CODE = (r"```[\s\S]*?```|`[^`\n]+`", "")

# Responses.
INCIDENTAL_HEADERS = ("x-request-id", "content-length", "cache-control", "set-cookie")
FLAGGED = 2
NARRATIVE = (r"\b(?:vulnerab|injection|injected|exploit|exploited|attack|attacker|payload|leaked|leak|unauthor|bypass|smuggl|csrf|xss|sqli|rce|breach|compromis|malicious|fabricat|forged|hacked|shell|hijack)", "i")
INCIDENTAL_KEYS = (
    "id", "uuid", "guid", "_id", "request_id", "requestid", "trace_id", "traceid", "created_at", "updated_at", "createdat", "updatedat", "created", "updated", "timestamp", "ts", "version", "_links", "links", "meta", "metadata",
    "pagination", "next", "prev", "page", "count", "total", "etag", "self",
)
UUID = (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "i")
TIME = (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?", "")
IPV4, IPV6 = (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", ""), (r"\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b", "i")
UNREAL_TIME = (r"^(?:000[01]|1970-01-01)|^\d{4}-01-01[T ]00:00(?::00(?:\.0+)?)?(?:Z|[+-]\d{2}:?\d{2})?$", "")
#: Addresses that are not routed: private, local, for documents, out of range.
UNREAL_IPV4 = (r"(?:^|\.)(?:25[6-9]|2[6-9]\d|[3-9]\d\d)(?:\.|$)|^0*(?:0|10|127)\.|^0*172\.0*(?:1[6-9]|2\d|3[01])\.|^0*192\.0*168\.|^0*169\.0*254\.|^(?:22[4-9]|2[3-5]\d)\.|^0*192\.0+\.0*2\.|^0*198\.0*51\.0*100\.|^0*203\.0+\.0*113\.", "")
UNREAL_IPV6 = (r"^fe[89ab][0-9a-f]?:|^f[cd][0-9a-f]{2}:|^2001:0?db8:|^(?:0+:)+0+$", "")
JSON_STRING = (r'"(?:[^"\\]|\\.)*":?', "")
