"""Patterns, phrases and formulas of text features and scores. Results depend on each of them.

Patterns are in the common subset of Java and RE2; formulas are SQL that Spark
and DuckDB read alike (every decimal a double, see :func:`sql`).
"""

from __future__ import annotations

import re

#: name: (pattern, flags). Number of matches.
COUNTS = {
    "word_count": (r"[A-Za-z0-9_]+", ""),
    "header_count": (r"^\s{0,3}(?:#{1,6}\s+\S.*|[A-Z][A-Za-z0-9 \-/]{2,40}:\s*$|\*\*[^*]{2,40}\*\*\s*:?$)", "m"),
    "numbered_steps": (r"^\s*(?:\d+[.)]|step\s+\d+)\s+\S", "im"),
    "inline_code": (r"`[^`\n]{2,80}`", ""),
    "code_blocks": (r"```[A-Za-z0-9_+\-]*\n[\s\S]*?```", ""),
    "function_calls": (r"\b[A-Za-z_][A-Za-z0-9_]{2,}(?:::[A-Za-z_][A-Za-z0-9_]*)*\s*\(", ""),
    "line_refs": (r"(?::|line\s+|L)\d{1,5}\b", "i"),
    "method_endpoints": (r"(?:GET|POST|PUT|DELETE|PATCH|HEAD)\s+/[A-Za-z0-9_/\-{}.:?=&]+", ""),
    "route_endpoints": (r"/(?:api|v\d+|rest|graphql|admin|users?|auth|login|logout|callback|oauth|webhook|search)/[A-Za-z0-9_/\-{}.:?=&]+", ""),
    "memory_addresses": (r"0x[0-9a-fA-F]{6,16}", ""),
    "versions": (r"\b\d+\.\d+(?:\.\d+){0,2}(?:-[A-Za-z0-9]+)?\b", ""),
    "cves": (r"\bCVE-\d{4}-\d{4,7}\b", "i"),
    "cwes": (r"\bCWE-\d{1,4}\b", "i"),
    "claims": (r"\b(?:this\s+(?:allows|enables|causes|leads\s+to|results\s+in)|allows?\s+an?\s+attacker\s+to|enables?\s+an?\s+attacker\s+to|can\s+(?:lead|result|cause|allow|enable)|will\s+(?:lead|result|cause|allow|enable)|results\s+in\s+(?:a\s+)?(?:critical|complete|full|total))\b", "i"),
    "generic_variables": (r"\b(?:user_input|target_url|attacker_payload|malicious_payload|payload\d*|target_host|victim_url|exploit_payload)\b", ""),
    "stack_frames": (r"(?:#\d+\s+0x[0-9a-fA-F]+\s+in\s+\S+|\bat\s+\S+\s*\([^)]+:\d+\))", ""),
}

#: name: (pattern, flags). Whether the pattern occurs.
FLAGS = {
    "executive_summary": (r"^\s*(?:#{1,6}\s+)?(?:executive\s+summary|tl;dr|abstract|overview)\s*:?\s*$", "im"),
    "salutation": (r"^\s*(?:dear\s+(?:security|sir|team|maintainers?|developers?)|hello\s+team|hi\s+(?:team|all))[\s,]", "im"),
    "poc_claimed": (r"(?:proof\s+of\s+concept|\bpoc\b|exploit\s+code|reproducer|test\s+case|##\s*reproduction|^\s*reproduction\s*$|how\s+to\s+reproduce|repro(?:duction)?\s+steps?)", "im"),
    "shell_prompt": (r"(?:^|\n)\s*(?:\$\s|#\s|>\s|>>>\s|PS\s*[A-Z]:[^>]*>\s)", ""),
    "command_output": (r"(?:Connection refused|Permission denied|Segmentation fault|Killed|Aborted|undefined reference|HTTP/[12]\.[01]\s+\d{3}|TypeError|SyntaxError|exit code|exit status)", "i"),
    "real_error": (r"(?:Error|Exception|Fatal|Panic):\s+\S{4,}", ""),
    "screenshot": (r"(?:!\[[^\]]*\]\([^)]+\)|screenshot|attached image|see image|see attached|figure\s*\d+)", "i"),
    "steps_named": (r"(?:steps?\s+to\s+reproduce|reproduction\s+steps|to\s+reproduce|how\s+to\s+reproduce|repro\s+steps?)", "i"),
    "environment": (r"(?:environment|os:|operating system|kernel|version:|browser:|node\.?js|python\s+3|ruby|java\s+\d|gcc|clang|ubuntu|debian|alpine|macos|windows|linux)", "i"),
    "depth": (r"(?:offset\s+0x|sizeof\(|strlen\(|memcpy\(|free\(|malloc\(|kmalloc\(|jmp\s+0x|mov\s+%|push\s+%|sysctl|ASAN|MSAN|UBSAN|valgrind|gdb|lldb|stack\s+trace|backtrace|register\s+r[a-z]+|rip\s*=|rsp\s*=)", "i"),
    "titled": (r"^\s*#\s+\S", ""),
    "has_summary": (r"(?:^|\n)\s*(?:#{1,6}\s+)?(?:summary|description|overview|introduction)\b", "i"),
    "has_impact": (r"(?:^|\n)\s*(?:#{1,6}\s+)?(?:impact|severity|consequence)\b", "i"),
    "has_poc_section": (r"(?:^|\n)\s*(?:#{1,6}\s+)?(?:poc|proof\s+of\s+concept|exploit|reproduction)\b", "i"),
    "has_remediation": (r"(?:^|\n)\s*(?:#{1,6}\s+)?(?:remediation|mitigation|fix|recommendation)\b", "i"),
    "has_references": (r"(?:^|\n)\s*(?:#{1,6}\s+)?(?:references?|see\s+also|links?)\b", "i"),
    "specific_address": (r"0x[0-9a-fA-F]*[a-fA-F1-9][0-9a-fA-F]*", ""),
    "diff_file": (r"^[-+]{3}\s+[ab]/", "m"),
    "diff_hunk": (r"^@@\s*-\d+,?\d*\s*\+\d+,?\d*\s*@@", "m"),
    "shell_command": (r"^[$>]\s+\w+\s+--?\w", "m"),
    "shell_block": (r"```(?:bash|sh|shell|console)\b[\s\S]+?```", ""),
    "http_request_line": (r"(?:GET|POST|PUT|DELETE|PATCH|HEAD)\s+/\S*\s+HTTP/[12]\.[01]", ""),
    "http_header": (r"^(?:Host|User-Agent|Authorization|Cookie|Content-Type|Accept|Content-Length):", "m"),
    "cvss_vector": (r"CVSS:3\.[01]/AV:[NALP]/AC:[LH]/PR:[NLH]/UI:[NR]/S:[UC]/C:[NLH]/I:[NLH]/A:[NLH]", ""),
    "crash": (r"==\d+==ERROR:\s*AddressSanitizer|SUMMARY:\s*(?:Address|Memory|Thread)Sanitizer|at 0x[0-9A-Fa-f]+:\s*\w+\s*\([^)]+:\d+\)", ""),
    "crash_words": (r"READ of size \d+ at 0x[0-9a-f]+|freed by thread|Segmentation fault.*core dumped|==\d+==\s*(?:Invalid|Conditional).*depends on uninitialised", "i"),
}

PHRASES = {
    "hedges": ("may", "might", "could potentially", "it is possible that", "this could lead to", "potentially allowing", "may allow an attacker", "appears to", "seems to"),
    "fillers": ("it is important to note that", "please note that", "importantly", "it should be noted", "it is worth mentioning", "as we can see", "this is a critical", "this vulnerability could potentially allow"),
    "remediation": ("use strong passwords", "update regularly", "install patches", "enable authentication", "use encryption", "apply security updates", "validate input", "sanitize data",
                    "implement firewalls", "follow best practices", "implement proper", "ensure proper", "regularly update", "keep software up to date"),
    "overclaims": ("will lead to", "can potentially cause", "would allow attackers to", "this enables full", "complete compromise", "catastrophic", "massive data breach", "total system takeover"),
}
#: Of these only hedges are whole words.
WHOLE_WORDS = ("hedges",)

PLACEHOLDER_HOSTS = (
    "example.com", "example.org", "example.net", "target.com", "vulnerable-server.com", "vulnerable-app.com", "victim.com", "attacker.com", "evil.com", "malicious.com", "test.com", "testsite.com",
    "yoursite.com", "yourapp.com", "yourdomain.com", "company.com", "acme.com", "foo.com", "bar.com", "webapp.com", "myapp.com", "site.com", "placeholder.com",
)
PRIVATE_HOST = r"^(?:127\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|localhost$)"
URL = (r"https?://[^\s<>)\]\"']+", "i")
#: Technical terms whose distances give burstiness; (?i:...) where case does not matter.
TERMS = r"(?i:\bCVE-\d)|(?i:\bCWE-\d)|\bRCE\b|(?i:\bSQL)|(?i:\bXSS\b)|(?i:\boverflow\b)"
#: Words that connect sentences. Fixed values.
CONNECTORS = (
    "furthermore", "additionally", "moreover", "however", "thus", "therefore", "consequently", "subsequently", "accordingly", "nevertheless", "nonetheless", "specifically",
    "particularly", "essentially", "fundamentally", "ultimately", "importantly", "notably", "indeed", "hence", "whereas",
)
CODE_SHAPE = r"[;{}=]|\bdef\b|\bfunction\b|\bclass\b|\breturn\b|\bif\b|\bfor\b|\bimport\b|\$\s"

#: Claim specificity: points by what a text names.
SPECIFIC = {
    "project": (10, r"(?:curl|nginx|apache|django|flask|react|express|wordpress|linux|kernel|openssl|libxml2|sqlite|redis|postgresql|mysql|mongodb|docker|kubernetes|jenkins|grafana|kibana|elasticsearch|tomcat|spring|struts|log4j|jackson|netty)", "i"),
    "cve": (15, r"CVE-\d{4}-\d+", ""),
    "version": (8, r"v?\d+\.\d+\.\d+", ""),
    "path": (12, r"(?:/[\w.-]+){2,}\.(?:c|h|py|js|go|rs|java|php|rb|ts|cpp|hpp)", "i"),
    "function": (10, r"\b\w+(?:_\w+){1,}\s*\(", ""),
    "endpoint": (10, r"(?:GET|POST|PUT|DELETE|PATCH)\s+/\S+", "i"),
    "http": (12, r"(?:Host:|Content-Type:|Cookie:|Authorization:)", "i"),
    "sha": (15, r"[0-9a-f]{40}", "i"),
    "ghsa": (12, r"GHSA-[\w-]+", ""),
    "placeholder_target": (-10, r"your-?(?:app|server|domain)", "i"),
}
UNNAMED_TARGET = (r"the\s+application|your\s+(?:code|system|infrastructure)", "i")

#: Evidence quality, in the order of its rules.
EVIDENCE = {
    "q_request": (r"^(?:GET|POST|PUT|DELETE|PATCH)\s+/\S+\s+HTTP/[\d.]+", "m"),
    "q_headers": (r"(?:Host|Cookie|Authorization|Content-Type):\s+\S", "i"),
    "q_curl": (r"curl\s+(?:-[A-Za-z]+\s+)*['\"]?https?://\S+", ""),
    "q_imports": (r"^(?:import\s+|from\s+\S+\s+import|require\s*\(|#include\s*[<\"]|using\s+)", "m"),
    "q_diff": (r"^[+-]{3}\s+[ab]/|^@@\s+-\d+,?\d*\s+\+\d+", "m"),
    "q_urls": (r"https?://(?:github\.com|gitlab\.com|hackerone\.com|bugcrowd\.com|nvd\.nist\.gov|cve\.org|curl\.se/docs)\S+", "i"),
    "q_named": (r"(?:(?:Credit|Report(?:ed)?|Found|Discover(?:ed)?)\s+by|Author)[:\s]+[A-Z][a-z]+\s+[A-Z][a-z]+", "i"),
    "q_generic_name": (r"(?:Credit|Report(?:ed)?)\s+(?:by)?[:\s]+Security\s+Researcher", "i"),
    "q_steps": (r"steps?\s+to\s+reproduce|how\s+to\s+reproduce", "i"),
    "q_command_steps": (r"^\s*(?:\$|>|curl|wget|python|node|npm|docker|git)\s+", "m"),
    "q_generic_fix": (r"(?:update\s+to\s+the\s+latest\s+version|apply\s+(?:the\s+)?(?:latest\s+)?(?:security\s+)?patch|implement\s+(?:proper\s+)?input\s+(?:validation|sanitization))", "i"),
    "q_specific_fix": (r"(?:fixed\s+in\s+(?:v|version\s+)[\d.]+|commit\s+[0-9a-f]{7,}|PR\s+#\d+|patch\s+applied)", "i"),
}
EVIDENCE_COUNTS = {
    "q_frames": (r"#\d+\s+0x[0-9a-f]+\s+in\s+\S+", "i"),
    "q_tracebacks": (r"File\s+\"[^\"]+\",\s+line\s+\d+", ""),
    "q_outputs": (r"^\$\s+.+\n[^$\n]", "m"),
    "q_textbook": (r"(?:is\s+a\s+(?:type|class|form)\s+of\s+(?:vulnerability|attack)|(?:OWASP|CWE)\s+defines?\s+(?:this|it)\s+as|according\s+to\s+(?:OWASP|NIST|MITRE))", "i"),
}
EVIDENCE_SCORE = """least(100, greatest(0, CASE WHEN q_request THEN 20 WHEN q_headers THEN 10 ELSE 0 END + CASE WHEN q_curl THEN 15 ELSE 0 END + CASE WHEN q_imports THEN 15 ELSE 0 END
    + CASE WHEN q_diff THEN 20 ELSE 0 END + CASE WHEN q_frames >= 3 OR q_tracebacks >= 2 THEN 12 ELSE 0 END + CASE WHEN q_outputs > 0 THEN 10 ELSE 0 END + CASE WHEN q_urls THEN 12 ELSE 0 END
    + CASE WHEN q_named AND NOT q_generic_name THEN 8 WHEN q_generic_name THEN -5 ELSE 0 END - CASE WHEN q_steps AND NOT q_command_steps AND NOT q_curl THEN 10 ELSE 0 END
    - CASE WHEN q_generic_fix AND NOT q_specific_fix THEN 8 ELSE 0 END - CASE WHEN q_textbook >= 2 THEN 10 ELSE 0 END))"""

#: Vulnerability class and language for consistency, first hit wins.
CLASSES = (
    ("buffer_overflow", r"buffer\s*overflow|heap\s*overflow|stack\s*overflow|out.of.bounds"),
    ("sqli", r"sql\s*injection|sqli"),
    ("xss", r"cross.?site\s*scripting|xss"),
    ("use_after_free", r"use.after.free"),
    ("rce", r"remote\s*code\s*execution|rce"),
    ("dos", r"denial.of.service|dos"),
    ("info_leak", r"information\s*(?:disclosure|leak)"),
    ("ssrf", r"ssrf|server.side\s*request"),
    ("csrf", r"csrf|cross.site\s*request\s*forgery"),
    ("xxe", r"xxe|xml\s*external\s*entity"),
    ("deserialization", r"deserialization"),
    ("prototype_pollution", r"prototype\s*pollution"),
    ("path_traversal", r"path\s*traversal|directory\s*traversal"),
    ("privesc", r"privilege\s*escalation|privesc"),
)
LANGUAGES = (
    ("python", r"(?:python|\.py\b|pip|django|flask)"),
    ("c", r"(?:\.c\b|\.h\b|gcc|clang|malloc|free\s*\(|#include)"),
    ("javascript", r"(?:node\.?js|npm|express|require\s*\(|\.js\b)"),
    ("java", r"(?:\.java\b|maven|gradle|spring|javax)"),
    ("go", r"(?:\.go\b|golang|go\s+mod)"),
    ("rust", r"(?:\.rs\b|cargo|rust)"),
    ("php", r"(?:\.php\b|composer|laravel)"),
    ("ruby", r"(?:\.rb\b|ruby|rails|gem)"),
)
CONSISTENCY = {
    "c_extension": (r"c\s+extension|ctypes|cffi", "i"), "c_cli": (r"(?:cli|command.?line|terminal)", "i"), "c_web_api": (r"web|http|api", "i"), "c_rce": (r"remote\s+code\s+execution|RCE", "i"),
    "c_dos": (r"denial\s+of\s+service|DoS", "i"), "c_leak": (r"information\s+(?:disclosure|leak)", "i"), "c_cgi": (r"cgi|web|http", "i"),
}
CONSISTENCY_SCORE = """greatest(0, 100 - 3 * (CASE WHEN vuln_class = 'buffer_overflow' AND language = 'python' AND NOT c_extension THEN 15 ELSE 0 END
    + CASE WHEN vuln_class = 'sqli' AND c_cli AND NOT c_web_api THEN 12 ELSE 0 END + CASE WHEN c_leak AND NOT c_rce AND coalesce(cvss, 0) >= 9 THEN 10 ELSE 0 END
    + CASE WHEN c_dos AND NOT c_rce AND coalesce(cvss, 0) >= 9 THEN 8 ELSE 0 END + CASE WHEN cwe_mentions >= 3 THEN 6 ELSE 0 END
    + CASE WHEN vuln_class = 'xss' AND language = 'c' AND NOT c_cgi THEN 12 ELSE 0 END + CASE WHEN vuln_class = 'prototype_pollution' AND language IS NOT NULL AND language <> 'javascript' THEN 15 ELSE 0 END))"""

#: Signs of a human author.
HUMAN_COUNTS = {
    "h_contractions": (r"\b(?:don't|won't|can't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|doesn't|didn't|couldn't|wouldn't|shouldn't|it's|i'm|i've|i'll|we're|we've|they're|they've|that's|there's|here's|what's|who's|let's|ain't|y'all|he's|she's|you're|you've|you'll|we'll|they'll|might've|should've|would've|could've|must've|who've|who'll|that'll)\b", "i"),
    "h_redacted": (r"\[REDACTED\]|\[REMOVED\]|\[CENSORED\]|\[MASKED\]|\[HIDDEN\]", "i"),
}
HUMAN_FLAGS = {
    "h_slang": (r"\b(?:btw|fwiw|iirc|afaik|imo|imho|tbh|fyi|tldr|tl;dr|ymmv|afaict|idk|ngl|iiuc|wrt|gonna|wanna|gotta|kinda|sorta)\b|\bw/(?:\b|o\b)", "i"),
    "h_researcher": (r"\b(?:reported\s+by|discovered\s+by|found\s+by|credited?\s+to|researcher[:\s]+|author[:\s]+)\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", ""),
    "h_commit": (r"(?:commit\s+[0-9a-f]{7,40}|(?:pull\s+request|pr|merge\s+request|mr)\s*#?\d+|[0-9a-f]{7,40}(?:\s*\.{2,3}\s*[0-9a-f]{7,40})?|github\.com/[\w\-]+/[\w\-.]+/(?:commit|pull|issues)/[\w\d]+)", "i"),
    "h_patched": (r"(?:(?:fixed|patched|resolved|backported)\s+(?:in|by|as\s+of|starting\s+from)\s+(?:v(?:ersion)?\s*)?\d+\.\d+|(?:v(?:ersion)?\s*)?\d+\.\d+(?:\.\d+)?\s+(?:fixes|patches|resolves|addresses)\s+this)", "i"),
    "h_polite": (r"dear\s+(?:security\s+team|sir/madam|team|vulnerability\s+team|security\s+researcher)|(?:best\s+regards|kind\s+regards|sincerely|respectfully\s+submitted|warm\s+regards)|(?:i\s+hope\s+this\s+(?:finds\s+you\s+well|message\s+finds|email\s+finds|report\s+finds))|(?:thank\s+you\s+for\s+(?:your\s+time|taking\s+the\s+time|reading|considering|your\s+attention))|(?:i\s+would\s+(?:like\s+to|be\s+happy\s+to)\s+(?:report|inform|notify|discuss))", "i"),
}
HUMAN_SIGNS = """(CASE WHEN h_contractions >= 2 THEN 1 ELSE 0 END + CASE WHEN h_terse THEN 1 ELSE 0 END + CASE WHEN h_slang THEN 1 ELSE 0 END + CASE WHEN h_researcher THEN 1 ELSE 0 END
    + CASE WHEN h_commit THEN 1 ELSE 0 END + CASE WHEN h_patched THEN 1 ELSE 0 END + CASE WHEN h_redacted > 0 THEN 1 ELSE 0 END + CASE WHEN NOT h_polite AND h_words >= 100 THEN 1 ELSE 0 END)"""
HUMAN_BASE = """-(CASE WHEN h_contractions >= 2 THEN 5 ELSE 0 END + CASE WHEN h_terse THEN 4 ELSE 0 END + CASE WHEN h_slang THEN 4 ELSE 0 END + CASE WHEN h_researcher THEN 3 ELSE 0 END
    + CASE WHEN h_commit THEN 6 ELSE 0 END + CASE WHEN h_patched THEN 3 ELSE 0 END + 5 * least(h_redacted, 3) + CASE WHEN NOT h_polite AND h_words >= 100 THEN 3 ELSE 0 END)"""
HUMAN_MULTIPLIER = "CASE WHEN human_signs <= 1 THEN 1.0 WHEN human_signs = 2 THEN 1.3 WHEN human_signs = 3 THEN 1.7 WHEN human_signs = 4 THEN 2.2 WHEN human_signs = 5 THEN 2.5 WHEN human_signs = 6 THEN 2.8 ELSE 3.0 END"


def sql(formula: str) -> str:
    """A formula with every decimal as a double and white space folded, as both engines read it."""
    return re.sub(r"\s+", " ", re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", formula))


def clamp(x: str) -> str:
    return f"least(100.0, greatest(0.0, {x}))"


def whole(x: str) -> str:
    """Rounded, halves up."""
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def given(test: str, yes: str = "1.0", no: str = "0.0") -> str:
    return f"CASE WHEN {test} THEN {yes} ELSE {no} END"


def norm(x: str) -> str:
    return clamp(f"100.0 * ({x})")


#: Derived features: stages of name: formula, each over the columns of those before.
DERIVED = (
    {
        "endpoints": "method_endpoints + route_endpoints",
        "generic_names": "generic_variables >= 2",
        "has_steps": "steps_named OR numbered_steps >= 2",
        "technical_density": "CASE WHEN word_count > 0 THEN (cves + cwes + function_calls) * 100.0 / word_count ELSE 0.0 END",
        "evidence": "code_blocks + least(line_refs, 20) + real_urls + method_endpoints + route_endpoints + file_paths + CASE WHEN screenshot THEN 1 ELSE 0 END",
        "completeness": " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in ("titled OR (first_sentence > 0 AND first_sentence < 200)", "has_summary", "has_impact", "has_poc_section", "has_remediation", "has_references")),
        "vulnerable_context": "file_paths >= 1 AND line_refs >= 1",
    },
    {
        "claim_evidence": "claims * 1.0 / (evidence + 1)",
        "reproducibility": f"({given('has_steps')} + {given('environment')} + {given('code_blocks > 0')} + {given('vulnerable_context')} + {given('real_urls > 0')}) / 5.0",
    },
)

#: Strength-weighted evidence: type, test, base weight, multiplier.
SIGNALS = (
    ("CRASH_OUTPUT", "crash OR crash_words", "6.0", 2.5),
    ("CODE_DIFF", "diff_file AND diff_hunk", "6.0", 2.2),
    ("STACK_TRACE", "stack_frames >= 3", "5.0", 2.0),
    ("SHELL_COMMAND", "shell_command OR shell_block", "4.0", 1.8),
    ("HTTP_REQUEST", "http_request_line AND http_header", "4.0", 1.6),
    ("MEMORY_ADDRESS", "memory_addresses > suspicious_addresses", "3.0", 1.5),
    ("MEMORY_ADDRESS_ROUND", "memory_addresses > 0 AND memory_addresses = suspicious_addresses", "-5.0", 0.5),
    ("CVSS_VECTOR", "cvss_vector", "3.0", 1.2),
    ("CVE_REFERENCE", "distinct_cves > 0", "2.0", 1.1),
    ("VERSION_PIN", "versions > 0", "2.0", 1.1),
    ("FILE_PATH", "file_paths > 0", "least(8.0, file_paths * 1.5)", 1.2),
    ("LINE_NUMBER", "line_refs > 0", "least(6.0, line_refs * 0.8)", 1.4),
    ("FUNCTION_NAME", "function_calls > 0", "least(6.0, function_calls * 0.5)", 1.3),
    ("ENDPOINT_URL", "endpoints > 0", "least(6.0, endpoints * 1.5)", 1.0),
    ("ENVIRONMENT_DETAIL", "environment", "3.0", 1.0),
)

_CV = "CASE WHEN sentence_cv < 0.711 THEN 100.0 * (1.0 - sentence_cv / 0.711) WHEN sentence_cv > 0.895 THEN 0.0 ELSE 100.0 * (0.895 - sentence_cv) / 0.184 END"
_K = "(CASE WHEN word_count > 0 THEN 1000.0 / word_count ELSE 1.0 END)"
#: Vulnerability type by name, first hit wins, with the CWE that a name alone stands for.
VULN_TYPES = (
    ("XSS", r"cross.?site.?script|\bXSS\b|<script>|document\.cookie", "79"),
    ("SQLi", r"sql.?inject|\bSQLi\b|UNION\s+SELECT|OR\s+1\s*=\s*1|iny[eé]cci[oó]n\s+(?:de\s+)?SQL|injection\s+(?:de\s+)?SQL|SQL[-\s]?injektion", "89"),
    ("SSRF", r"server.?side.?request|\bSSRF\b|169\.254\.169\.254", "918"),
    ("XXE", r"xml.?external.?entit|\bXXE\b", "611"),
    ("Buffer Overflow", r"buffer.?overflow|heap.?overflow|stack.?overflow|out.?of.?bounds|desbordamiento\s+(?:de\s+)?b[uú]fer|(?:d[eé]bordement|d[eé]passement)\s+(?:de\s+)?tampon|puffer[üu]berlauf", "119"),
    ("Use After Free", r"use.?after.?free|\bUAF\b|CWE-416", "416"),
    ("Path Traversal", r"path.?traversal|directory.?traversal|\.\./", "22"),
    ("LFI", r"local.?file.?inclusion|\bLFI\b", "98"),
    ("Auth Bypass", r"auth(?:entication|orization).?bypass|\bIDOR\b|broken.?access", "287"),
    ("CSRF", r"cross.?site.?request.?forgery|\bCSRF\b", "352"),
    ("Open Redirect", r"open.?redirect|unvalidated.?redirect", "601"),
    ("Insecure Deserialization", r"insecure.?deseriali[sz]|unsafe.?deseriali[sz]|\bdeseriali[sz]ation\b", "502"),
    ("Prototype Pollution", r"prototype.?pollution|__proto__\s*\[", "1321"),
    ("Command Injection", r"command.?inject|\bCMDi\b|shell.?inject", "77"),
    ("RCE", r"remote.?code.?execution|\bRCE\b", "78"),
    ("Info Disclosure", r"information.?disclosure|sensitive.?data.?expos|info.?leak", "200"),
)

#: The three engines and what combines them, stage by stage.
ENGINES = (
    {
        "structural": clamp(f"0.4 * {given('executive_summary', '100.0')} + 0.25 * CASE WHEN completeness >= 5 AND NOT depth THEN 80.0 WHEN completeness >= 5 THEN 30.0 ELSE 15.0 END + 0.15 * {norm('header_count / 6.0')} + 0.12 * {norm('sentence_mean / 26.8')} + 0.05 * {norm('placeholder_urls / 4.0')} + 0.03 * {given('salutation', '60.0')}"),
        "lexical": clamp(f"0.15 * {norm(f'{_K} * hedges / 8.0')} + 0.15 * {norm(f'{_K} * fillers / 5.0')} + 0.35 * {norm('remediation / 3.0')} + 0.25 * {norm('overclaims / 3.0')} + 0.10 * (100.0 - {norm('type_token / 0.756')})"),
        "uniformity": clamp(f"0.6 * ({_CV}) + 0.25 * CASE WHEN paragraph_cv < 0.3 THEN 60.0 WHEN paragraph_cv < 0.5 THEN 30.0 ELSE 0.0 END + 0.15 * burstiness"),
        "behavioural": clamp(f"0.35 * greatest({given('poc_claimed AND code_blocks = 0 AND real_urls = 0', '80.0')}, {given('function_calls > 20 AND file_paths < 2', '60.0')}) + 0.30 * (100.0 - {norm('real_urls / 8.54')}) + 0.20 * (100.0 - {norm('code_blocks / 2.81')}) + 0.15 * (100.0 - {norm('file_paths / 13.91')})"),
        "code_points": f"least(15.0, 5.4 * code_blocks) + 10.0 * language_ratio + least(12.0, 1.7 * inline_code) + {given('command_output', '8.0')} + {given('shell_prompt', '4.0')} + {given('real_error', '3.0')} + {given('memory_addresses > 0 AND specific_address', '8.0')} + {given('file_paths >= 2', '8.0')} - {given('generic_names', '8.0')}",
        "call_ratio": "CASE WHEN file_paths > 0 THEN function_calls * 1.0 / file_paths ELSE function_calls * 1.0 END",
        "repro_points": f"{given('has_steps', '8.0')} + {given('environment', '10.0')} + {given('screenshot', '8.0')} + least(15.0, 1.76 * real_urls) - least(10.0, 3.3 * placeholder_urls) + {given('vulnerable_context', '6.0')} + 7.0 * reproducibility",
        "poc_points": "CASE WHEN poc_claimed AND code_blocks = 0 AND placeholder_urls > 0 THEN -20.0 WHEN poc_claimed AND code_blocks = 0 AND real_urls < 1 THEN -15.0 WHEN poc_claimed AND code_blocks > 0 AND placeholder_urls = 0 AND language_ratio > 0.5 AND vulnerable_context THEN 20.0 WHEN poc_claimed AND code_blocks > 0 AND placeholder_urls = 0 AND language_ratio > 0.5 THEN 12.0 WHEN poc_claimed AND code_blocks > 0 AND placeholder_urls = 0 THEN 8.0 WHEN NOT poc_claimed THEN 0.0 ELSE 5.0 END",
        "ratio_score": "CASE WHEN claims = 0 AND evidence >= 3 THEN 100.0 WHEN claim_evidence <= 0.27 THEN least(100.0, greatest(0.0, 100.0 - 60.0 * (0.27 - claim_evidence))) ELSE least(100.0, greatest(0.0, 100.0 - 200.0 * (claim_evidence - 0.27))) END",
    },
    {
        "authorship_raw": whole("0.25 * structural + 0.30 * lexical + 0.25 * uniformity + 0.20 * behavioural"),
        "code_part": "least(75.0, greatest(0.0, code_points))",
        "refs_part": "least(60.0, greatest(0.0, least(15.0, 3.7 * endpoints) + least(15.0, 1.76 * line_refs) + least(12.0, 0.86 * file_paths) + least(8.0, 2.7 * least(3, versions)) + least(10.0, 1.43 * distinct_cves) - CASE WHEN call_ratio > 10.0 THEN least(15.0, 1.5 * (call_ratio - 10.0)) ELSE 0.0 END))",
        "repro_part": "least(60.0, greatest(0.0, repro_points))",
        "poc_part": clamp("50.0 + 2.5 * poc_points"),
    },
    {
        "authorship": whole("0.6 * authorship_raw + 0.4 * perplexity"),
        "substance_base": clamp("0.35 * 100.0 * code_part / 50.0 + 0.30 * 100.0 * refs_part / 40.0 + 0.20 * 100.0 * repro_part / 35.0 + 0.10 * poc_part + 0.05 * ratio_score"),
    },
    {"substance_capped": "CASE WHEN claim_evidence > 1.0 THEN least(substance_base, 25.0) WHEN claim_evidence < 0.01 AND claims > 5 THEN least(substance_base, 20.0) ELSE substance_base END"},
    {"substance": whole(clamp("CASE WHEN claim_evidence > 1.0 OR (claim_evidence < 0.01 AND claims > 5) THEN substance_capped ELSE least(95.0, substance_capped + least(15.0, greatest(-8.0, evidence_strength / 4.0))) END"))},
    {
        "coherence": "CASE WHEN cwes > 0 THEN 50 WHEN vuln_type IS NOT NULL THEN 60 ELSE 42 END",
    },
    {"coherence_gated": "CASE WHEN substance < 30 THEN least(coherence, 42) WHEN substance < 45 THEN least(coherence, 55) ELSE coherence END"},
    {"composite_base": whole("0.05 * (100 - authorship) + 0.60 * substance + 0.35 * coherence_gated")},
    {"override": "CASE WHEN authorship > 74 AND substance < 41 THEN -20 ELSE 0 END + CASE WHEN claim_evidence > 1.0 AND claims > 5 THEN -25 ELSE 0 END + CASE WHEN substance < 20 AND authorship < 40 THEN -5 ELSE 0 END"},
    {"composite": "CAST(least(100, greatest(0, composite_base + override)) AS BIGINT)"},
    {
        "label": "CASE WHEN composite <= 20 THEN 'LIKELY INVALID' WHEN composite <= 35 THEN 'HIGH RISK' WHEN composite <= 50 THEN 'NEEDS REVIEW' WHEN composite <= 65 THEN 'REASONABLE' WHEN composite <= 80 THEN 'PROMISING' ELSE 'STRONG' END",
        "slop": "CAST(least(100, greatest(0, 100 - composite)) AS BIGINT)",
        "authorship_verdict": "CASE WHEN authorship <= 25 THEN 'GREEN' WHEN authorship <= 74 THEN 'YELLOW' ELSE 'RED' END",
        "substance_verdict": "CASE WHEN substance >= 61 THEN 'GREEN' WHEN substance >= 41 THEN 'YELLOW' ELSE 'RED' END",
        "action": "CASE WHEN composite >= 65 THEN 'PRIORITIZE' WHEN composite >= 55 THEN 'MANUAL_REVIEW' WHEN composite >= 40 THEN 'STANDARD_TRIAGE' WHEN composite >= 25 AND strong_evidence >= 3 THEN 'MANUAL_REVIEW' WHEN composite >= 25 THEN 'CHALLENGE_REPORTER' ELSE 'AUTO_CLOSE' END",
    },
)

#: What fabricated evidence takes off a composite: its total weight from which, and points; signals that only add to others.
FABRICATION = ((30, -25), (20, -15), (12, -10))
CORROBORATING = ("incomplete_asan", "fabricated_pid")


def _assessed(stage: dict[str, str]) -> list[dict[str, str]]:
    if "substance" in stage:
        return [{"substance_plain": stage["substance"]}, {"substance": f"CASE WHEN gold_bonus > 0 THEN least(95, {whole(clamp('substance_plain + gold_bonus'))}) ELSE substance_plain END"}]
    return [{"override": stage["override"] + " + fabrication"}] if "override" in stage else [stage]


#: The engines with the bonus of payload signals (``gold_bonus``) and the points of fabricated evidence (``fabrication``).
ASSESSED = tuple(s for stage in ENGINES for s in _assessed(stage))
