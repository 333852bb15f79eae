"""Patterns, names and weights of fabricated evidence, of facts that can't be, and of payloads that are evidence. Results depend on each of them."""

from __future__ import annotations

# Signs of fabricated evidence.
FRAME = (r"#\d+\s+0x[0-9a-f]+\s+in\s+\S+", "i")
ADDRESS = (r"0x[0-9a-f]{8,16}", "i")
SEQUENTIAL = r"1234|5678|9abc|abcd|dead|beef|cafe|face"
PID = (r"==(\d+)==", "")
MAGIC_PIDS = ("12345", "11111", "99999", "10000", "54321")
VERSION = (r"(?:version\s+|v)(\d+\.\d+\.\d+)", "i")
CALL = (r"\b[A-Za-z0-9_]+\s*\(", "")
CODE_BLOCK = (r"```[\s\S]*?```", "")

#: name: (pattern, flags). Whether it occurs.
FLAGS = {
    "real_crash": (r"SUMMARY:\s*AddressSanitizer|==\d+==ERROR:\s*AddressSanitizer|Thread\s+\d+\s+received\s+signal\s+SIG|Program\s+received\s+signal\s+SIG|\(gdb\)\s+(?:bt|backtrace|info\s+registers)|==\d+==\s*(?:READ|WRITE)\s+of\s+size\s+\d+", "i"),
    "exploit_script": (r"(?:exploit|payload|poc|attack)\.py", "i"),
    "source_shown": (r"import |def ", ""),
    "sanitizer": (r"AddressSanitizer", "i"),
    "sanitizer_class": (r"(?:heap[-\s]buffer[-\s]overflow|stack[-\s]buffer[-\s]overflow|global[-\s]buffer[-\s]overflow|heap[-\s]use[-\s]after[-\s]free|use[-\s]after[-\s]free|double[-\s]free|heap\s+overflow|stack\s+overflow)", "i"),
    "sanitizer_context": (
        r"SUMMARY:\s*AddressSanitizer|Shadow\s+bytes\s+around|==\d+==\s*ERROR:\s*AddressSanitizer\s*:|#\d+\s+0x[0-9a-f]+\s+in\s+\S[^\n]*\.[A-Za-z0-9_+-]+:\d+"
        r"|(?:READ|WRITE)\s+of\s+size\s+\d+\s+at\s+0x[0-9a-f]+|freed\s+by\s+thread\s+T\d+\s+here|previously\s+allocated\s+by\s+thread", "i",
    ),
    "code_shown": CODE_BLOCK,
    "says_xss": (r"(?:cross.?site\s+scripting|XSS)", "i"),
    "says_rce": (r"(?:remote\s+code\s+execution|RCE|arbitrary\s+code\s+execution)", "i"),
    "server_side": (r"(?:electron|node|server.?side|SSR)", "i"),
    "python": (r"(?:python|\.py|pip|django|flask)", "i"),
    "javascript": (r"(?:node\.?js|npm|express|\.js\b|require\s*\()", "i"),
    "c_language": (r"(?:\.c\b|\.h\b|gcc|malloc|free\s*\(|#include)", "i"),
    "disclosure": (r"responsible\s+disclosure", "i"),
    "timeline": (r"(?:reported|disclosed|notified|contacted)\s+(?:on|at)?\s*\d{4}[-/]\d{2}[-/]\d{2}", "i"),
    "vendor_contact": (r"(?:vendor|maintainer|developer)\s+(?:response|confirmed|acknowledged)", "i"),
}

_ROUND = "addresses >= 2 AND round_addresses > 0.5 * addresses AND NOT real_crash"
_FRAMES = "frames >= 3 AND frames - distinct_frames > 0.5 * frames"
_SCRIPT = "exploit_script AND NOT source_shown"
_PHANTOM = "calls >= 3 AND NOT code_shown"

#: (signal, weight): both are formulas over the flags and counts; in this order.
SIGNALS = (
    ("fabricated_stack_trace", f"CASE WHEN {_FRAMES} THEN 15 ELSE 0 END"),
    ("fabricated_addresses", f"CASE WHEN {_ROUND} THEN 10 ELSE 0 END"),
    ("phantom_exploit_script", f"CASE WHEN {_SCRIPT} THEN 8 ELSE 0 END"),
    ("incomplete_asan", "CASE WHEN sanitizer AND sanitizer_class AND NOT sanitizer_context THEN 12 ELSE 0 END"),
    ("phantom_functions", f"CASE WHEN {_PHANTOM} THEN 10 ELSE 0 END"),
    ("fabricated_pid", f"CASE WHEN magic_pids >= 2 OR magic_pids = 1 AND (({_FRAMES}) OR ({_ROUND}) OR ({_SCRIPT}) OR ({_PHANTOM})) THEN 6 ELSE 0 END"),
    ("implausible_version", "5 * odd_versions"),
    ("impact_escalation", "CASE WHEN says_xss AND says_rce AND NOT server_side THEN 8 ELSE 0 END"),
    ("language_confusion", "CASE WHEN python AND javascript AND c_language THEN 8 ELSE 0 END"),
    ("repeated_sentences", "CASE WHEN repeats >= 2 THEN 6 ELSE 0 END"),
    ("empty_disclosure_claim", "CASE WHEN disclosure AND NOT timeline AND NOT vendor_contact THEN 5 ELSE 0 END"),
)

#: Weights of what a trace or an excerpt shows that none has: of one marker of a trace, of each of several, of each of an excerpt.
ONE_MARKER, MARKER, EXCERPT_MARKER = 4, 8, 8

# Facts that can't be.
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "target.com", "vulnerable-server.com", "vulnerable-app.com", "victim.com", "attacker.com", "evil.com", "malicious.com", "test.com", "testsite.com", "yoursite.com",
    "yourapp.com", "yourdomain.com", "company.com", "acme.com", "foo.com", "bar.com", "webapp.com", "myapp.com", "site.com", "localhost", "192.168.1.1", "10.0.0.1", "127.0.0.1",
)
RESERVED_DOMAINS = ("example.com", "example.org", "example.net")
PLACEHOLDER_PATHS = ("/api/v1/users", "/api/v1/admin", "/api/endpoint", "/admin/dashboard", "/login", "/api/users/1", "/upload", "/api/data", "/search?q=")
REDACTED = (r"\[REDACTED\]|\[REMOVED\]|\[CENSORED\]|\[MASKED\]|\[HIDDEN\]|__PLACEHOLDER__", "i")
ASAN_HEADER = (r"==\d+==\s*ERROR:\s*AddressSanitizer", "")
ROUND_ADDRESS = (r"0x[0-9a-f]*0{4,}", "i")
FRAME_NAME = (r"#\d+\s+0x[0-9a-f]+\s+in\s+([A-Za-z0-9_]+)", "i")
REGISTER = (r"(?:rax|rbx|rcx|rdx|rsi|rdi|rsp|rbp|rip|eax|ebx|ecx|edx|esi|edi|esp|ebp|eip)\s*(?:=|:)\s*0x([0-9a-f]+)", "i")
STATUS = (r"HTTP/[\d.]+\s+(\d{3})", "")

#: Functions that the projects don't have.
ABSENT_FUNCTIONS = {
    "curl": ("curl_parse_header_secure", "curl_http_validate_request", "curl_safe_header", "curl_validate_host", "curl_validate_input", "curl_validate_response", "curl_validate_cert", "curl_secure_connect"),
    "nginx": ("ngx_secure_filter", "ngx_safe_concat", "ngx_validate_input"),
    "apache": ("ap_safe_copy", "ap_validate_header", "ap_secure_handler"),
    "openssl": ("SSL_validate_chain_secure", "EVP_encrypt_safe"),
    "websocket": ("ws_frame_handshake", "ws_process_frame", "ws_validate_frame", "ws_secure_handshake"),
    "http3": ("h3_process_priority", "h3_resolve_deps", "h3_validate_frame"),
}
CALLED = (r"(?:in|at|from)\s+([a-zA-Z_][a-zA-Z0-9_]{2,}(?:::[a-zA-Z_][a-zA-Z0-9_]*)*)\s*\(", "")
NAMED = (r"(?:function|method|routine|handler)\s+`?([a-zA-Z_][a-zA-Z0-9_:]*)`?", "i")
#: Words of made-up names. Fixed values.
VERBS = (
    "process", "handle", "execute", "validate", "check", "verify", "parse", "manage", "init", "create", "update", "delete", "get", "set", "do", "run", "perform", "ensure", "apply",
)
GENERIC = (
    "data", "input", "output", "request", "response", "buffer", "stream", "object", "item", "value", "result", "context", "state", "config", "info", "util", "helper", "service", "manager", "handler",
    "controller", "processor", "validator", "factory", "builder", "wrapper", "adapter", "decorator", "observer", "listener", "callback", "resolver", "provider", "consumer", "producer", "dispatcher", "scheduler", "executor", "coordinator", "orchestrator",
)
CAMEL, SNAKE = r"^[a-z]+(?:[A-Z][a-z]+){3,}$", r"^[a-z]+(?:_[a-z]+){3,}$"

#: (weight, patterns that must all occur).
FAKE_PATHS = (
    (15, (r"lib/header_parser\.c", r"curl")), (10, (r"lib/http3\.c", r"curl")), (8, (r"src/core/(?:security|auth|crypto)\.c", r"(?:nginx|apache|curl|openssl)")),
)
TEST_CERTS = (
    (15, (r"tests/certs/.*\.pem", r"(?:credential|private\s+key|security\s+risk|sensitive|exposed)")),
    (10, (r"(?:test|example|sample|demo)[\s_-]?(?:key|cert|certificate)", r"(?:leaked|exposed|hardcoded|credential)")),
)
#: Shares of the parts in the blend.
BLEND = {"severity": 0.2, "placeholder": 0.15, "fabricated": 0.15, "cve_year": 0.15, "fabricated_cve": 0.1, "functions": 0.15, "paths": 0.05, "certificates": 0.05}

# Claims of a patch without one.
PATCH_CLAIM = (
    r"\b(?:suggested|proposed|illustrative|recommended|tentative|rough|sketch(?:ed)?|pseudo)\s+patch\b|\bpatch\s*\([^)]{0,40}(?:illustrative|from\s+memory|approximate|sketch|pseudo|untested)"
    r"|\b(?:suggested|proposed|recommended|tentative|illustrative)\s+(?:fix|diff)\b|\bsuggested\s+remediation(?:\s+patch)?\b|\bhere(?:'s|\s+is)\s+(?:the|a|my|an?\s+illustrative)\s+(?:fix|patch|diff)\b"
    r"|\b(?:wrote|drafted|composed|reconstructed|written)\s+(?:the\s+)?(?:fix|patch|diff)\s+from\s+memory\b"
    r"|\b(?:fix|patch|diff)\s*[:\-]?\s*\(?\s*(?:illustrative|written\s+from\s+memory|from\s+memory|approximate|pseudo(?:code)?|untested)", "i",
)
DIFF = (r"(?:^|\n)(?:diff --git\s|---\s+\S+|\+\+\+\s+\S+|@@\s+-?\d+(?:,\d+)?\s+\+?\d+)", "")

# Payloads that are evidence.
TOKEN_PLACEHOLDER = r"^(?:<[^>]*>|x{4,}|\.{3,}|y(?:our)?[_\-]?(?:token|jwt|bearer)|jwt[_\-]?token|bearer[_\-]?token|placeholder|todo|tbd|fixme|n/?a|null|none|example|sample|fake|test)$"
JWT = (r"\beyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "")
BEARER = (r"\bAuthorization\s*:\s*Bearer\s+([A-Za-z0-9._\-+/=]{8,})", "i")
COOKIE = (r"(?:Set-)?Cookie\s*:[^\n]*?(?:session(?:id)?|sid|auth|token|jwt)\s*=\s*([A-Za-z0-9._\-+/=%]{8,})", "i")
XXE = (r"<!doctype\b[^\[]*\[[\s\S]*?<!entity\s+\w+\s+system\s+[\"']((?:file|http|gopher|ftp|expect):[^\"'\n>]+)[\"']", "i")
XXE_PLACEHOLDER = r"<[^>]*>|placeholder|your[_\-]?(?:file|host|target)|insert|tbd|todo|fixme|example\.com/?$"
XXE_BARE = r"^(?:file|http|gopher|ftp|expect):/?/?$"
CRYPTO = (
    r"\b(?:static|hardcoded|reused|fixed|null|zero|all[\s_-]?zeros?)\s+(?:iv|nonce|key|salt)\b|\bECB\s+mode\b|\bAES[-_]?\d*[-_]?ECB\b|\bMD5\s*\(|\bSHA-?1\s*\(|new\s+Cipher\s*\(\s*[\"'](?:DES|3DES|RC4|AES/ECB)"
    r"|Cipher\.getInstance\s*\(\s*[\"'](?:DES|RC4|AES/ECB)|hashlib\.(?:md5|sha1)\s*\(", "i",
)
CRYPTO_PLACEHOLDER, LONG_HEX = r"<(?:key|iv|nonce|salt|hash)[^>]*>|YOUR_[A-Z_]+_(?:KEY|IV|HASH)", r"[a-f0-9]{16,}"
TOCTOU = (
    r"\b(?:access|stat|lstat|fstatat)\s*(?:\([^)\n]+\)|\s+(?:[/\$\w][^\n;()]{0,80}))[\s\S]{0,200}\b(?:open|fopen|openat|symlink|creat)\s*(?:\(|\s+(?:[/\$\w]|AT_FDCWD\b))", "i",
)
TOCTOU_PLACEHOLDER = (r"\b(?:access|stat|lstat|fstatat|open|fopen|openat|symlink)\s*(?:\(\s*<[^>)]*>\s*\)|\s+<[^>\n]*>)", "i")

#: signal: (pattern, flags). Those that one pattern decides.
PAYLOADS = {
    "sql_injection_payload": (r"\b(?:union\s+(?:all\s+)?select|or\s+(?:1|true)\s*=\s*(?:1|true)|;\s*drop\s+table|sleep\s*\(\s*\d+\s*\)|benchmark\s*\(\s*\d+\s*,|xp_cmdshell|extractvalue\s*\(|updatexml\s*\(|pg_sleep\s*\(\s*\d+\s*\))", "i"),
    "command_injection_payload": (r"(?:;\s*(?:cat|ls|id|whoami|uname|nc|wget|curl|bash|sh|chmod|chown)\s|\|\s*(?:cat|ls|id|whoami|nc|sh|bash)\b|\$\([^)\n]{2,}\)|`[^`\n]*\$\([^)\n]{2,}\)[^`\n]*`|\$\{jndi:(?:ldap|rmi|dns)s?://)", "i"),
    "xss_payload": (
        r"<script\b[^>]*>[\s\S]{0,200}?(?:alert|prompt|confirm|document\.cookie|document\.location|window\.location|fetch\s*\(|eval\s*\()|<img\b[^>]+onerror\s*=\s*[\"']?[^\"'<>\n]{1,80}\("
        r"|<svg\b[^>]+onload\s*=\s*[\"']?[^\"'<>\n]{1,80}\(|<iframe\b[^>]+srcdoc\s*=\s*[\"']?[^\"'\n]{1,80}<script|javascript:\s*(?:alert|prompt|document\.cookie|fetch)\s*\(", "i",
    ),
    "ssrf_metadata_target": (r"https?://169\.254\.169\.254/[\w\-./]+|metadata\.google\.internal/computeMetadata/v\d[\w\-./]*|169\.254\.169\.254/latest/meta-data/[\w\-./]+|metadata\.azure\.com/metadata/[\w\-./]+", "i"),
    "path_traversal_payload": (r"(?:\.\./|\.\.\\|\.\.%2f|\.\.%5c|%2e%2e[/]|%252e%252e[/%]).{0,80}(?:passwd|shadow|hosts|boot\.ini|win\.ini|/etc/|/proc/|secret|\.aws/|id_rsa|web\.config|\.ssh/)", "i"),
    "deserialization_gadget": (
        r"\bysoserial\b[^\n]*\bCommonsCollections\d+|\bmarshalsec\b[^\n]*\b(?:JSON|YAML|XML)\b|\bpickle\.loads?\s*\(\s*b['\"]\\x|\byaml\.unsafe_load\s*\(|\bnew\s+ObjectInputStream\s*\([\s\S]{0,80}?\.readObject\s*\("
        r"|\bnode-serialize\b[\s\S]{0,80}?unserialize\s*\(|\bfastjson\b[\s\S]{0,80}?@type", "i",
    ),
}
#: Points of the signals, in the order they are named, and the most that they add up to.
GOLD = {
    "auth_token": 3, "sql_injection_payload": 5, "command_injection_payload": 5, "xss_payload": 5, "ssrf_metadata_target": 4, "path_traversal_payload": 4, "xxe_external_entity": 4, "deserialization_gadget": 4, "crypto_misuse": 2,
    "filesystem_toctou": 2,
}
GOLD_MOST = 12
#: Those that must also be in what is left of a text without placeholders.
GOLD_LEFT = ("sql_injection_payload", "command_injection_payload", "xss_payload", "path_traversal_payload")
