"""Rules of vulnerability classes, of a language model's second opinion and of live checks. Patterns, bounds and names are fixed values."""

from __future__ import annotations

from . import detector_rules as D
from .feature_rules import whole

#: class -> (label, patterns with flags). Of classes with equal shares of patterns the first listed wins.
CLASSES = {
    "xss": ("Cross-Site Scripting (XSS)", (
        (r"\bcross[- ]?site\s*scripting\b", "i"), (r"\bXSS\b", ""), (r"\b(?:reflected|stored|dom[- ]?based)\s*xss\b", "i"), (r"<script[^>]*>.*?</script>", "i"),
        (r"\bdocument\.cookie\b", "i"), (r"\balert\s*\(", "i"), (r"\bonmouseover\b", "i"), (r"\bonerror\b", "i"),
    )),
    "sqli": ("SQL Injection", (
        (r"\bsql\s*injection\b", "i"), (r"\bSQLi\b", ""), (r"\bunion\s+select\b", "i"), (r"\bor\s+1\s*=\s*1\b", "i"),
        (r"\b(?:blind|error[- ]?based|time[- ]?based)\s*(?:sql|injection)\b", "i"), (r"\b(?:sleep|waitfor|benchmark)\s*\(", "i"),
    )),
    "ssrf": ("Server-Side Request Forgery (SSRF)", (
        (r"\bserver[- ]?side\s*request\s*forgery\b", "i"), (r"\bSSRF\b", ""), (r"\b169\.254\.169\.254\b", ""), (r"\bmetadata\s*(?:service|endpoint)\b", "i"),
        (r"\binternal\s*(?:service|network|host)\b", "i"), (r"\bcloud\s*metadata\b", "i"),
    )),
    "deserialization": ("Insecure Deserialization", (
        (r"\bdeserialization\b", "i"), (r"\binsecure\s*deserialization\b", "i"), (r"\b(?:pickle|yaml\.load|unserialize|readObject|ObjectInputStream)\b", "i"),
        (r"\b(?:ysoserial|gadget\s*chain)\b", "i"), (r"\bremote\s*code\s*execution\s*via\s*(?:de)?serial", "i"),
    )),
    "buffer_overflow": ("Buffer Overflow", (
        (r"\bbuffer\s*overflow\b", "i"), (r"\bheap\s*overflow\b", "i"), (r"\bstack\s*(?:overflow|smash)\b", "i"), (r"\bout[- ]?of[- ]?bounds\b", "i"),
        (r"\buse[- ]?after[- ]?free\b", "i"), (r"\bASan\b", ""), (r"\bAddressSanitizer\b", "i"), (r"\bSegmentation\s*fault\b", "i"),
    )),
    "path_traversal": ("Path Traversal", (
        (r"\bpath\s*traversal\b", "i"), (r"\bdirectory\s*traversal\b", "i"), (r"\bLFI\b", ""), (r"\blocal\s*file\s*inclusion\b", "i"), (r"\.\./", ""), (r"\.\.\\+", ""),
        (r"/etc/(?:passwd|shadow)\b", ""),
    )),
    "auth_bypass": ("Authentication / Authorization Bypass", (
        (r"\bauth(?:entication|orization)?\s*bypass\b", "i"), (r"\bprivilege\s*escalation\b", "i"), (r"\bIDOR\b", ""), (r"\binsecure\s*direct\s*object\b", "i"),
        (r"\bbroken\s*(?:access|auth)\b", "i"), (r"\bJWT\s*(?:bypass|forgery|manipulation)\b", "i"), (r"\bforce[- ]?browse\b", "i"),
    )),
    "race_condition": ("Race Condition", (
        (r"\brace\s*condition\b", "i"), (r"\bTOCTOU\b", "i"), (r"\btime[- ]?of[- ]?check\b", "i"), (r"\bdouble[- ]?spend\b", "i"), (r"\bconcurren(?:cy|t)\s*(?:bug|vuln|issue)\b", "i"),
    )),
}
UNKNOWN = ("unknown", "Unknown Vulnerability Class")

#: Whether a model is asked, and why (columns: available, confidence, composite or null, heuristic).
_BORDER, _UNSURE = "heuristic BETWEEN 25 AND 60", "confidence < 0.5"
GATE = (
    {
        "reason": f"""CASE WHEN NOT available THEN 'skipped_unavailable'
            WHEN composite IS NOT NULL AND {_UNSURE} THEN 'fired_low_confidence'
            WHEN composite > 60 THEN 'skipped_above_borderline_composite' WHEN composite < 25 THEN 'skipped_below_borderline_composite'
            WHEN composite IS NOT NULL AND heuristic >= 60 THEN 'skipped_composite_borderline_heuristic_confirms_slop' WHEN composite IS NOT NULL THEN 'fired_borderline_composite'
            WHEN {_BORDER} AND {_UNSURE} THEN 'fired_borderline_and_low_confidence' WHEN {_BORDER} THEN 'fired_borderline' WHEN {_UNSURE} THEN 'fired_low_confidence'
            WHEN heuristic > 60 THEN 'skipped_above_borderline' WHEN heuristic < 25 THEN 'skipped_below_borderline' ELSE 'skipped_high_confidence_outside_borderline' END"""
    },
    {"asked": "reason LIKE 'fired%'"},
)

#: A heuristic validity and a model's (columns: heuristic, model or null, substance, coherence, poc_validity or null, has_poc, claimed: how many files, functions, CVEs and lines).
BLEND = (
    {"__raw": f"CASE WHEN substance IS NULL THEN model ELSE least(100, greatest(0, {whole('model + (substance - 50) * 0.15 + (coherence - 50) * 0.1')})) END"},
    {"capped": "coalesce(substance IS NOT NULL AND NOT has_poc AND poc_validity <= 20 AND claimed = 0 AND __raw > heuristic, false)"},
    {"model_validity": "CASE WHEN capped THEN heuristic ELSE __raw END"},
    {
        "floored": "coalesce(abs(heuristic - model_validity) > 30, false)",
        "higher": "CASE WHEN heuristic > model_validity THEN 'heuristic' WHEN heuristic < model_validity THEN 'llm' WHEN heuristic = model_validity THEN 'tied' END",
        "blended": f"least(100, greatest(0, {whole('0.5 * heuristic + 0.5 * model_validity')}))",
    },
    {"validity": "CASE WHEN model_validity IS NULL THEN heuristic WHEN floored THEN least(heuristic, model_validity) ELSE blended END"},
)

#: The fusion anew from what is stored (columns as of detector_rules.FUSION, but linguistic in place of its parts, and nothing verified), without a model.
_TIERED, _AXES = D.FUSION[4], D.FUSION[1]
WITHOUT_MODEL = (
    {"authenticity": _AXES["authenticity"], "validity": D.validity("100 - verification"), "substance_axis": _AXES["substance_axis"]},
    {"style_driven": D.FUSION[2]["style_driven"], "substance_driven": D.FUSION[2]["substance_driven"], "quadrant": D.FUSION[2]["quadrant"], "confidence": D.confidence("0.0")},
    {"slop_score": "CAST(least(100, greatest(0, greatest(style_driven, substance_driven))) AS BIGINT)"},
    _TIERED,
)

#: What says that a model wrote a text: name, pattern (over text with white space folded), flags. Any of them costs the same.
DISCLOSURE = (
    ("prepared_using_ai", r"\bprepared\s+(?:using|with)\s+(?:an?\s+)?(?:ai|artificial intelligence|llm)\b", "i"),
    ("generated_with_ai", r"\b(?:generated|produced|written|drafted|authored|composed|created|compiled)\s+(?:by|with|using|via)\s+(?:the\s+(?:help|assistance)\s+of\s+)?(?:an?\s+)?(?:ai|artificial intelligence|llm|chatgpt|claude|copilot|gemini|bard|gpt-?\d?)\b", "i"),
    ("with_ai_help", r"\bwith\s+(?:the\s+)?(?:help|assistance)\s+(?:of|from)\s+(?:an?\s+)?(?:ai|artificial intelligence|llm|chatgpt|claude|copilot|gemini|bard)\b", "i"),
    ("this_report_ai", r"\bthis\s+(?:report|analysis|writeup|write[-\s]?up|submission)\s+(?:was|is|has\s+been)\s+(?:assisted|generated|written|drafted|authored|prepared|created|produced)\s+(?:by|with|using)\b[^.]{0,80}\b(?:ai|artificial intelligence|llm|chatgpt|claude|copilot|gemini|bard|gpt-?\d?)\b", "i"),
    ("ai_generated_adjective", r"\bai[-\s](?:generated|written|drafted|authored|assisted|produced|composed)\b", "i"),
    ("named_llm_assisted", r"\b(?:chatgpt|claude|copilot|gemini|bard|gpt-?\d?)[-\s](?:assisted|generated|written|drafted|authored|produced)\b", "i"),
    ("used_llm_to_draft", r"\b(?:i|we)\s+(?:used|asked|leveraged|relied\s+on)\s+(?:chatgpt|claude|copilot|gemini|bard|gpt-?\d?|an?\s+(?:ai|llm))\b[^.]{0,80}\b(?:draft|write|generate|prepare|produce|author|compose|create|summarize|analy[sz]e)\b", "i"),
)
DISCLOSURE_PENALTY = 15

#: What a text of a family says of its impact and of its reproduction (both case-insensitive); points off without.
NO_IMPACT, NO_REPRO = 6, 8
FAMILIES = {
    "MEMORY_CORRUPTION": (
        r"\b(?:memory\s+corruption|crash|denial\s+of\s+service|remote\s+code\s+execution|info\s*leak|read\s+out[-\s]of[-\s]bounds|arbitrary\s+(?:read|write))\b",
        r"\b(?:asan|sanitizer|valgrind|coredump|gdb|lldb|sigsegv|backtrace|stack\s+trace|crash)\b",
    ),
    "INJECTION": (
        r"\b(?:data\s+(?:exfil|exposure)|database\s+access|command\s+execution|rce\b|file\s+(?:read|write)|account\s+takeover)\b",
        r"\b(?:payload|curl\s|wget\s|http\s+request|sleep\(|union\s+select|;\s*(?:cat|ls|id)|burp\s+suite|sqlmap)\b",
    ),
    "WEB_CLIENT": (
        r"\b(?:cookie\s+theft|session\s+hijack|account\s+takeover|csrf\b|phishing|ui\s+redress|user\s+interaction|stored\s+xss|reflected\s+xss)\b",
        r"\b(?:browser|chrome|firefox|safari|<script|javascript:|alert\(|burp\s+suite|fetch\(|xhr\b)\b",
    ),
    "AUTHN_AUTHZ": (
        r"\b(?:account\s+takeover|privilege\s+escalation|access\s+(?:another|other)\s+user|authorization\s+bypass|authentication\s+bypass|read\s+other\s+user)\b",
        r"\b(?:account\s+a|account\s+b|user\s+a|user\s+b|alice|bob|two\s+(?:accounts?|sessions?|users?)|swap\s+token)\b",
    ),
    "CRYPTO": (
        r"\b(?:plaintext\s+recovery|key\s+recovery|forge|forgery|signature\s+bypass|downgrade|collision|weak\s+random)\b",
        r"\b(?:test\s+vector|kat|known\s+answer|nonce|iv|encryption\s+key|hash\s+output|sage|python.*hashlib|openssl\s+(?:enc|dgst))\b",
    ),
    "DESERIALIZATION": (
        r"\b(?:remote\s+code\s+execution|rce\b|gadget|arbitrary\s+command|reverse\s+shell)\b",
        r"\b(?:ysoserial|marshalsec|pickle\.loads?|yaml\.load|payload\.bin|gadget\s+chain)\b",
    ),
    "RACE_CONCURRENCY": (
        r"\b(?:double[-\s]*spend|double[-\s]*write|inconsistent\s+state|atomicity|race\s+window)\b",
        r"\b(?:two\s+threads|interleav|race\s+window|repeat\s+\d+\s+times|loop\s+\d+|tsan|helgrind)\b",
    ),
    "REQUEST_SMUGGLING": (
        r"\b(?:cache\s+poisoning|request\s+hijack|auth\s+bypass|session\s+hijack|backend\s+confusion)\b",
        r"\b(?:raw\s+http|content-length|transfer-encoding|\bcrlf\b|burp\s+suite|smuggler)\b",
    ),
}
CVSS_VECTOR = (r"CVSS:?\s*3\.\d/?([A-Z:/]+)", "i")
#: The base score is looked for farther away where there is a vector.
CVSS_SCORE, CVSS_SCORE_FAR = (r"cvss[^0-9]{0,8}(10(?:\.0)?|[0-9](?:\.\d)?)", "i"), (r"cvss[^0-9]{0,12}(10(?:\.0)?|[0-9](?:\.\d)?)", "i")
XSS_WORDS, POWER_WORDS, HEDGED = (r"xss|reflected|stored|dom\b", "i"), (r"privilege|admin|elevated", "i"), (r"\b(?:theoretical|could\s+(?:potentially|possibly)|might\s+(?:be|allow))\b", "i")
CVSS_PENALTY, PR_PENALTY, HEDGED_PENALTY, CRITICAL = 5, 4, 6, 9.0

#: Commands and answers that are shown as proof; by definition the first ten and the first five count.
POC_COMMAND, POC_COMMANDS = (r"(?:curl|wget|python|ruby|perl)\s+[^\n]{10,}", "i"), 10
POC_RESPONSE, POC_RESPONSES = (r"HTTP/[\d.]+\s+\d{3}[\s\S]*?(?:\n\n|\r\n\r\n|\z)", ""), 5
TEXTBOOK = (
    r"alert\s*\(\s*['\"]?(?:1|xss|document\.cookie)['\"]?\s*\)", r"(?:'\s*(?:or|and)\s+['\"]?1['\"]?\s*=\s*['\"]?1|or\s+1\s*=\s*1|union\s+select)", r"(?:/etc/passwd|/etc/shadow|/proc/self)",
    r"(?:169\.254\.169\.254|metadata\.google|100\.100\.100\.200)", r"(?:<script>alert\(|<img\s+src=x\s+onerror=)", r"(?:\$\{jndi:|%24%7Bjndi)", r"(?:nc\s+-(?:e|lvp)|/bin/(?:sh|bash)\s+-i)",
)
HEADER, REAL_HEADER = (r"^[a-zA-Z][\w-]*:\s", "m"), (r"^(?:date|server|content-length):\s", "im")
POC_WEIGHTS = {"poc_placeholder_textbook": 12, "poc_fabricated_response": 10}
