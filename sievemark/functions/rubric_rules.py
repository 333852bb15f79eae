"""Rubrics of the families of vulnerabilities: what a report of a family shows, lacks or contradicts. All are fixed values.

A signal is (id, pattern, flags, points), an absence (id, pattern, points) where the pattern is missing; patterns of
absences and of keywords are in any case.
"""

from __future__ import annotations

SIGNALS = {
    "MEMORY_CORRUPTION": (
        ("asan_or_sanitizer", r"==\d+==error: \w*sanitizer|addresssanitizer:|memorysanitizer:|undefinedbehaviorsanitizer:|threadsanitizer:", "i", 22),
        ("valgrind", r"==\d+== (?:invalid|conditional jump|use of uninitialised|definitely lost)", "i", 18),
        ("stack_trace_with_offset", r"#\d+\s+0x[0-9a-f]{6,}", "i", 12),
        ("specific_alloc_function", r"\b(?:malloc|calloc|strdup|realloc|g_malloc|g_strdup|g_free|free|operator new|delete\[\])\s*\(", "i", 8),
        ("memory_op_with_size", r"\b(?:memcpy|memmove|strncpy|snprintf|memset|memcmp)\s*\([^)]*,\s*[^,]+,\s*[^)]+\)", "i", 8),
        ("specific_struct_field", r"\b\w+->\w+\b", "", 6),
        ("code_diff_in_c", r"^---\s+\S+\.(?:c|h|cc|cpp|cxx)|^\+\+\+\s+\S+\.(?:c|h|cc|cpp|cxx)", "im", 12),
        ("cwe_correct_class", r"cwe-(?:119|120|121|122|125|787|416|590|672|762)", "i", 4),
    ),
    "INJECTION": (
        ("concrete_payload", r"union\s+select|or\s+1\s*=\s*1|;\s*drop\s+table|sleep\(\s*\d+\s*\)|benchmark\(|xp_cmdshell|;\s*(?:cat|ls|id|whoami|uname)\b|\$\{jndi:|`?\$\(.*\)`?", "i", 22),
        ("vulnerable_query_construction", r"[\"']\s*\+\s*\w+|f[\"']\s*select|format\s*\(\s*[\"']\s*select|exec\s*\(\s*\w+|popen\s*\(|system\s*\(|child_process\.exec|os\.system", "i", 14),
        ("request_response_diff", r"(?:normal request|baseline)[\s\S]{0,300}(?:injection|payload|attack)", "i", 10),
        ("specific_endpoint_param", r"(?:get|post|put|delete|patch)\s+/[\w\-/.{}]+.*\?\w+=|param(?:eter)?\s+`?\w+`?|field\s+`?\w+`?", "i", 8),
        ("cwe_correct_class", r"cwe-(?:89|77|78|91|943|917|624)", "i", 4),
        ("code_diff_for_fix", r"prepare\s*\(|parameterized|placeholder|\?\s*,|escape_string|shell_escape|shlex\.quote", "i", 6),
    ),
    "WEB_CLIENT": (
        ("concrete_payload", r"<script[^>]*>|<img[^>]+onerror=|<svg[^>]+onload=|javascript:|on(?:click|error|load|mouseover)\s*=|alert\s*\(\s*[`'\"]?\d|document\.cookie|document\.location|window\.location", "i", 22),
        ("reflection_or_dom_proof", r"(?:reflected|rendered|injected|stored)\s+(?:in|at|inside|into)\s+(?:the\s+)?(?:response|dom|page|html|template)|<input[^>]+value=\s*[\"']<|innerhtml\s*=", "i", 12),
        ("specific_dom_sink", r"\b(?:innerhtml|outerhtml|document\.write|eval\(|setattribute\(|location\.hash|location\.search|window\.name|postmessage)", "i", 10),
        ("endpoint_with_param", r"(?:get|post)\s+/[\w\-/.{}]+.*\?\w+=|\?(?:q|search|name|return|redirect|url|next|callback|cb|jsonp)=", "i", 8),
        ("csrf_specific_request", r"<form[^>]+action=|<img[^>]+src=|fetch\s*\(\s*[\"']https?:|xmlhttprequest|samesite\s*=\s*(?:none|lax|strict)", "i", 8),
        ("ssrf_internal_metadata", r"https?://169\.254\.169\.254|metadata\.google\.internal/computemetadata|metadata\.azure\.com|169\.254\.169\.254/latest|/computemetadata/v\d|/latest/meta-data/[\w\-/]+|fd00:ec2::254", "i", 20),
        ("path_traversal_payload", r"(?:\.\./|\.\.\\|\.\.%2f|%2e%2e/|\.\.%5c|%2e%2e%2f|%252e%252e[/%]).{0,80}(?:passwd|shadow|hosts|boot\.ini|win\.ini|/etc/|/proc/|secret|\.aws/|id_rsa|web\.config)", "i", 18),
        ("ssrf_or_traversal_sink", r"\b(?:http\.get|http\.client|requests\.(?:get|post)|urllib\.request|urlopen|fetch\s*\(\s*url|axios\.(?:get|post)|net/http|httpclient|file_get_contents|send_file|sendfile|safe_join|os\.path\.join\s*\(\s*[A-Z_]+_DIR|readfile|fopen)\s*\(", "i", 8),
        ("code_diff_for_fix", r"^---\s+\S+|^\+\+\+\s+\S+|^@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@", "m", 10),
        ("file_with_line", r"[\w\-/]+\.(?:js|ts|tsx|py|rb|go|rs|java|kt|swift|php|cs|m|mm|sh|yml|yaml|json|xml|cpp|c|h)\s*[:#L@]\s*\d+", "i", 6),
        ("cwe_correct_class", r"cwe-(?:22|79|80|83|352|451|601|918|1021)", "i", 4),
    ),
    "AUTHN_AUTHZ": (
        ("two_account_proof", r"(?:user_?a|account_?a|alice|bob)[\s\S]{0,200}(?:user_?b|account_?b|bob|alice|other user)", "i", 16),
        ("authorization_header_swap", r"authorization:\s*bearer\s+[a-z0-9._-]+|jwt|x-auth-token|set-cookie:\s*\w+session|sessionid=", "i", 12),
        ("idor_object_id", r"/(?:users?|orders?|invoices?|files?|posts?|messages?|tickets?|api)/\d+|\?id=\d+|user_?id\s*[:=]", "i", 10),
        ("specific_endpoint", r"(?:get|post|put|delete|patch)\s+/(?:api|admin|account|profile|settings|users?|orders?|invoices?)\b", "i", 8),
        ("policy_or_check_function", r"\b(?:check_permission|authorize|has_role|require_admin)\b|\bpolicy\.\b|\b@requires?_(?:auth|admin|login)\b|\b@login_required\b", "i", 6),
        ("cwe_correct_class", r"cwe-(?:285|287|306|639|862|863|284|522|640)", "i", 4),
    ),
    "CRYPTO": (
        ("specific_algo_or_lib", r"\b(?:aes-?(?:128|192|256)?-?(?:cbc|ecb|gcm|ctr|cfb|ofb)|des|3des|rc4|md5|sha-?1|hmac-?\w+|rsa-?\d+|ecdsa|p-?256|p-?384|chacha20|poly1305|argon2|bcrypt|scrypt|pbkdf2|openssl|libsodium|bouncycastle|cryptography\.hazmat)\b", "i", 14),
        ("kat_or_test_vector", r"test\s+vector|kat|known\s+(?:answer|plaintext|ciphertext)|nonce[:=]|iv[:=]|key[:=][a-f0-9]{8,}", "i", 12),
        ("specific_misuse", r"\b(?:static|hardcoded|reused|fixed|null|zero|all-?zeros?)\s+(?:iv|nonce|key|salt)\b|ecb mode|ssl ?v?[23]|tls ?1\.[01]|md5\(|sha1\(", "i", 10),
        ("code_reference", r"(?:cipher|hash|hmac|sign|verify|encrypt|decrypt)\s*\(|new\s+cipher|crypto\.(?:create(?:cipher|hash|hmac|sign)|randombytes)", "i", 8),
        ("cwe_correct_class", r"cwe-(?:327|328|330|331|335|338|339|759|760|798|916|1240)", "i", 4),
    ),
    "DESERIALIZATION": (
        ("concrete_gadget_or_payload", r"\bysoserial\b|\bmarshalsec\b|\bpickle\.loads?\b|yaml\.(?:unsafe_)?load\b|javax?\.\w+\.objectinputstream|json\s*-\s*serializer|fastjson\b|jackson(?:databind|polymorphic)", "i", 18),
        ("exec_or_rce_evidence", r"rce|remote code execution|arbitrary command|getshell|reverse shell|bind shell|/bin/(?:sh|bash)|cmd\.exe|powershell", "i", 12),
        ("specific_class_or_lib", r"\b(?:commons-collections|commons-beanutils|c3p0|aspectjweaver|spring-aop|hibernate|fastjson|jackson|kryo|gson|protobuf|msgpack|bson|cpickle|pyyaml|node-serialize|funcster)\b", "i", 8),
        ("code_reference", r"objectinputstream|readobject\(|unmarshal\(|deserialize\(|fromjson\(|fromxml\(|yaml\.load|pickle\.loads|node-serialize", "i", 8),
        ("xxe_doctype_entity", r"<!doctype[^\[]*\[[\s\S]*?<!entity[\s\S]*?(?:system\s+[\"'](?:file|http|gopher|ftp):|%\s+\w+\s+system)", "i", 18),
        ("xml_parser_lib", r"\b(?:libxml2?|xmlreader|xmlparser|xmlreadmemory|saxparser|documentbuilder|xerces|lxml|defusedxml|expat|nokogiri|jdom|simplexml)\b", "i", 10),
        ("xxe_entity_load_flag", r"\b(?:XML_PARSE_NOENT|XML_PARSE_DTDLOAD|setExpandEntityReferences|isExpandEntityReferences|loadDTD|FEATURE_SECURE_PROCESSING|setFeature\s*\([^)]*external)\b", "", 12),
        ("cwe_correct_class", r"cwe-(?:502|611|776|827|915)", "i", 4),
    ),
    "RACE_CONCURRENCY": (
        ("two_thread_or_request_proof", r"(?:thread|request|transaction|process)\s+(?:1|a)\b[\s\S]{0,300}(?:thread|request|transaction|process)\s+(?:2|b)\b|race\s*-?condition|t-?o-?c-?t-?o-?u|toctou|interleav|concurrent(?:ly)?", "i", 14),
        ("tsan_or_helgrind", r"threadsanitizer|tsan:|helgrind|==\d+== possible data race|drd:", "i", 16),
        ("lock_or_atomic_reference", r"\b(?:pthread_mutex|std::mutex|std::atomic|lock_guard|unique_lock|spinlock|rwlock|sync\.mutex|sync\.rwmutex|asyncio\.lock|asyncio\.semaphore|nginx_atomic|atomic_(?:add|sub|cmpxchg|fetch))|\b@synchronized", "i", 8),
        ("filesystem_toctou", r"\b(?:access|stat|lstat|fstatat)\s*\([^)]*\)[\s\S]{0,200}\b(?:open|fopen|openat|symlink)\s*\(", "i", 10),
        ("specific_function", r"\b(?:handle_request|process_\w+|update_\w+|transfer\w*|withdraw|deposit|claim_\w+)\s*\(", "i", 6),
        ("cwe_correct_class", r"cwe-(?:362|363|364|367|820|821|833|843)", "i", 4),
    ),
    "REQUEST_SMUGGLING": (
        ("raw_http_request", r"post\s+/[^\s]*\s+http/1\.[01]\r?\n[\s\S]*?(?:host:|content-length:|transfer-encoding:)", "i", 18),
        ("te_or_cl_conflict", r"transfer-encoding\s*:[^\n]*\bchunked\b[\s\S]*?content-length\s*:|content-length\s*:[^\n]*\d[\s\S]*?transfer-encoding\s*:[^\n]*\bchunked\b", "i", 14),
        ("smuggled_second_request", r"\b(?:gpost|smuggled|pipelined|second request|hidden request|prefix)\s+(?:request|attack)|0\r?\n\r?\n[A-Z]+\s+/[^\s]*\s+http", "i", 12),
        ("specific_proxy_or_server", r"\b(?:haproxy|nginx|envoy|apache|aws elb|cloudfront|fastly|cloudflare|varnish|squid|traefik|caddy|pound|openresty|kong|f5|netscaler|node\.?js|gunicorn|uvicorn|tomcat|jetty|undertow|lighttpd|h2o)\b|\b[a-z][a-z0-9]*(?:[-_][a-z0-9]+)*[-_]proxy\s+v?\d+\.\d+\b|\b[a-z][a-z0-9_-]+/\d+\.\d+(?:\.\d+)?\b", "i", 8),
        ("cwe_correct_class", r"cwe-(?:444|436|116|113|115)", "i", 4),
    ),
}
ABSENCES = {
    "MEMORY_CORRUPTION": (
        ("no_crash_or_sanitizer", r"sanitizer|valgrind|segmentation fault|sigsegv|sigabrt|core dumped|stack-buffer-overflow|heap-buffer-overflow|use-after-free|double-free", 8),
        ("no_size_or_offset", r"\b(?:size|len|length|offset|bytes?)\s*[:=]?\s*\d+|\b\d+\s*bytes?\b", 5),
        ("no_c_source_reference", r"\.(?:c|h|cc|cpp|cxx|hpp)(?:\b|:)", 5),
    ),
    "INJECTION": (("no_payload", r"union|drop\s+table|sleep\(|benchmark\(|;\s*(?:cat|ls|id|whoami)|`\$\(|jndi:", 12), ("no_endpoint", r"https?://|/api/|/v\d+/|GET\s+/|POST\s+/", 6)),
    "WEB_CLIENT": (
        ("no_payload", r"<script|<img|<svg|javascript:|on\w+\s*=|document\.cookie|<form|<iframe|169\.254\.169\.254|metadata\.google\.internal|\.\./|%2e%2e|\.\.%2f|/etc/passwd|/etc/shadow", 10),
        ("no_url", r"https?://[\w\-.]+/[\w\-/?=&%.{}]*[a-z0-9]", 4),
    ),
    "AUTHN_AUTHZ": (("no_two_account_proof", r"user_?a|account_?a|second user|other user|alice|bob|two (?:accounts?|users?|sessions?)", 8), ("no_endpoint", r"https?://|/api/|/admin/|/account/|GET\s+/|POST\s+/", 5)),
    "CRYPTO": (("no_algo_named", r"\b(?:aes|des|rc4|md5|sha|hmac|rsa|ecdsa|chacha|argon|bcrypt|scrypt|pbkdf2)\b", 8), ("no_kat", r"test\s+vector|kat|known\s+answer|nonce|iv|hardcoded|reused|static", 6)),
    "DESERIALIZATION": (
        ("no_payload_or_gadget", r"ysoserial|marshalsec|pickle|yaml\.load|objectinputstream|readobject|deserialize|payload|<!doctype|<!entity|xml_parse_noent", 10),
        ("no_lib_named", r"jackson|fastjson|gson|pyyaml|pickle|java serialization|node-serialize|msgpack|kryo|libxml2?|xmlreader|saxparser|documentbuilder|xerces|lxml|defusedxml|expat|nokogiri", 6),
    ),
    "RACE_CONCURRENCY": (
        ("no_concurrent_proof", r"(?:thread|request|transaction|process)\s+(?:1|2|a|b)|race\s*condition|toctou|concurrent|interleav", 10),
        ("no_function_or_path", r"\.(?:c|h|cc|cpp|go|rs|py|js|ts|java|rb|php)(?:\b|:)|\b\w+\s*\(", 5),
    ),
    "REQUEST_SMUGGLING": (
        ("no_raw_request", r"\bhttp/1\.[01]\b|content-length\s*:|transfer-encoding\s*:", 10),
        ("no_proxy_named", r"haproxy|nginx|envoy|apache|cloudflare|varnish|squid|traefik|caddy|pound|openresty|kong|tomcat|jetty|node|gunicorn|uvicorn|undertow|h2o|\b[a-z][a-z0-9]*(?:[-_][a-z0-9]+)*[-_]proxy\s+v?\d+\.\d+|\b[a-z][a-z0-9_-]+/\d+\.\d+", 6),
    ),
}
CONTRADICTIONS = {
    "MEMORY_CORRUPTION": ("alert(1)", "alert('xss')", "<script>", "document.cookie", "innerhtml", "select * from", "union select", "or 1=1", "drop table", "csrf token", "samesite=lax"),
    "INJECTION": ("stack-buffer-overflow", "heap-buffer-overflow", "use-after-free", "addresssanitizer", "valgrind", "memcpy(", "strcpy(", "alert(1)", "<script>", "innerhtml"),
    "WEB_CLIENT": ("stack-buffer-overflow", "heap-buffer-overflow", "use-after-free", "addresssanitizer", "valgrind", "memcpy(", "strcpy(", "union select", "or 1=1", "; drop table"),
    "AUTHN_AUTHZ": ("stack-buffer-overflow", "addresssanitizer", "valgrind", "memcpy(", "<script>", "alert(1)", "document.cookie", "union select", "or 1=1"),
    "CRYPTO": ("<script>", "alert(1)", "document.cookie", "union select", "or 1=1", "stack-buffer-overflow", "valgrind"),
    "DESERIALIZATION": ("<script>", "alert(1)", "innerhtml", "stack-buffer-overflow", "valgrind", "union select", "or 1=1"),
    "RACE_CONCURRENCY": ("<script>", "alert(1)", "document.cookie", "union select", "or 1=1", "stack-buffer-overflow"),
    "REQUEST_SMUGGLING": ("<script>", "alert(1)", "innerhtml", "union select", "or 1=1", "addresssanitizer", "valgrind"),
}
MEMBERS = {
    "MEMORY_CORRUPTION": (119, 120, 121, 122, 125, 787, 416, 590, 672, 762, 806),
    "INJECTION": (77, 78, 89, 90, 91, 94, 943, 917, 624, 501),
    "WEB_CLIENT": (22, 79, 80, 83, 352, 451, 601, 918, 1021),
    "AUTHN_AUTHZ": (284, 285, 287, 306, 522, 639, 640, 862, 863),
    "CRYPTO": (310, 326, 327, 328, 329, 330, 331, 335, 338, 339, 759, 760, 780, 798, 916, 1240),
    "DESERIALIZATION": (502, 611, 776, 827, 915),
    "RACE_CONCURRENCY": (362, 363, 364, 367, 820, 821, 833, 843),
    "REQUEST_SMUGGLING": (113, 115, 116, 436, 444),
}
#: Family of a named type of vulnerability.
BY_TYPE = {
    "XSS": "WEB_CLIENT", "SQLi": "INJECTION", "SSRF": "WEB_CLIENT", "XXE": "DESERIALIZATION", "Buffer Overflow": "MEMORY_CORRUPTION", "Use After Free": "MEMORY_CORRUPTION", "Path Traversal": "WEB_CLIENT", "LFI": "WEB_CLIENT",
    "Auth Bypass": "AUTHN_AUTHZ", "CSRF": "WEB_CLIENT", "Open Redirect": "WEB_CLIENT", "Insecure Deserialization": "DESERIALIZATION", "Prototype Pollution": "INJECTION", "Command Injection": "INJECTION", "RCE": "INJECTION",
    "Info Disclosure": "AUTHN_AUTHZ",
}
#: Keywords of a family, each counts once, and how many it takes.
KEYWORDS = {
    "MEMORY_CORRUPTION": (2, (
        r"\b(?:buffer|heap|stack)[-\s]*(?:overflow|underflow|over[-\s]*read|under[-\s]*read)\b", r"\buse[-\s]*after[-\s]*free\b", r"\bdouble[-\s]*free\b", r"\bnull[-\s]*pointer\s+(?:dereference|deref)\b",
        r"\bsegmentation\s+fault|sigsegv|sigabrt|core\s+dumped\b", r"addresssanitizer|memorysanitizer|valgrind", r"\bmemcpy\(|strcpy\(|sprintf\(|gets\(",
    )),
    "INJECTION": (2, (r"\bsql\s+injection|sqli\b", r"\bcommand\s+injection|os\s+command|os\.system|child_process\.exec", r"\bldap\s+injection|nosql\s+injection|xpath\s+injection", r"\bunion\s+select|or\s+1\s*=\s*1|;\s*drop\s+table", r"\$\{jndi:|log4shell|log4j")),
    "WEB_CLIENT": (2, (
        r"\bcross[-\s]*site\s+scripting|\bxss\b|stored\s+xss|reflected\s+xss|dom[-\s]*based\s+xss", r"\bcross[-\s]*site\s+request\s+forgery|\bcsrf\b", r"\bclickjacking|x-frame-options", r"\bopen\s+redirect|unvalidated\s+redirect",
        r"<script|javascript:|onerror=|onload=|document\.cookie",
    )),
    "AUTHN_AUTHZ": (2, (
        r"\bidor\b|insecure\s+direct\s+object\s+reference", r"\bbroken\s+access\s+control|missing\s+authorization|authorization\s+bypass", r"\bauthentication\s+bypass|authn\s+bypass", r"\bprivilege\s+escalation|privesc",
        r"\bjwt\b|bearer\s+token|sessionid|set-cookie",
    )),
    "CRYPTO": (2, (r"\bweak\s+(?:hash|cipher|encryption|crypto|prng|random)", r"\bhardcoded\s+(?:key|secret|credential)", r"\bstatic\s+(?:iv|nonce|salt)|reused\s+(?:iv|nonce)", r"\bmd5\b|\bsha-?1\b|\brc4\b|\bdes\b|\becb\s+mode\b", r"\btls\s*1\.[01]|\bssl\s*v?[23]\b")),
    "DESERIALIZATION": (2, (
        r"\bdeserialization|unsafe\s+deserialize|object\s+injection", r"\bysoserial|marshalsec|pickle\.loads?\(|yaml\.(?:unsafe_)?load\(", r"\bobjectinputstream|readobject\(|fastjson|jackson(?:databind)?", r"\bnode-serialize|funcster\b",
        r"\bxml\s+external\s+entity|\bxxe\b|<!doctype[^\[]*\[|<!entity\s+\w+\s+system", r"\bxml_parse_noent|xml_parse_dtdload|xmlreadmemory|libxml2",
    )),
    "RACE_CONCURRENCY": (2, (r"\brace\s*condition\b|toctou\b|time[-\s]*of[-\s]*check[-\s]*time[-\s]*of[-\s]*use\b", r"\bdouble[-\s]*spend|atomicity\s+violation", r"\bdata\s+race|threadsanitizer|tsan\b|helgrind", r"\bmutex|lock\s+contention|spinlock")),
    "REQUEST_SMUGGLING": (1, (r"\brequest\s+smuggling|http\s+smuggling|http\s+desync", r"\bte\.cl\b|\bcl\.te\b|\btransfer-encoding.*content-length\b", r"\bpipelined\s+request|smuggled\s+request|prefix\s+attack", r"\bconnection\s+pool\s+poisoning|cache\s+poisoning")),
}
MANY_KEYWORDS = 3

#: Signals that a fabricated trace, request or response takes back, and those that it takes back where the text without it has none.
BY_TRACE = {"MEMORY_CORRUPTION": ("asan_or_sanitizer", "valgrind", "stack_trace_with_offset"), "RACE_CONCURRENCY": ("tsan_or_helgrind",)}
BY_REQUEST = {"REQUEST_SMUGGLING": ("raw_http_request", "te_or_cl_conflict", "smuggled_second_request"), "AUTHN_AUTHZ": ("authorization_header_swap",), "INJECTION": ("specific_endpoint_param",)}
BY_BODY = {"INJECTION": ("concrete_payload", "vulnerable_query_construction")}
BY_RESPONSE = {"INJECTION": ("request_response_diff",), "WEB_CLIENT": ("reflection_or_dom_proof",)}
BY_RESPONSE_BODY = {"WEB_CLIENT": ("concrete_payload",)}
#: The family whose requests must end their lines as the wire has them.
STRICT = "REQUEST_SMUGGLING"

#: Substance: share of all points that counts as full, the most a base gives, the most off for absences, off for a contradiction and the most, off for what is fabricated.
FULL, BASE_MOST, ABSENCE_MOST, CONTRADICTION, CONTRADICTIONS_MOST, FABRICATED = 0.55, 84.0, 12, 8, 24, 18
#: The rubric's weight beside the plain engine's, and the lower one: below which of its own and from which of the plain score on.
WEIGHT, LESS_WEIGHT, LOW, PLAIN_HIGH = 0.5, 0.25, 25, 55
#: Parts of a text that are code or a patch.
CODE, HUNK = (r"```[\s\S]*?```", ""), (r"(?:^|\n)(?:diff --git[^\n]*\n)?(?:---[^\n]+\n)?(?:\+\+\+[^\n]+\n)?(?:@@[^\n]*@@\n)?(?:[ +\-][^\n]*\n)+", "")

#: Coherence: bases by what is cited and shown, points for signals, off for a contradiction and the most.
BASES = {"OFF_FAMILY_CEILING": 25, "SOFT_CITATION": 60, "SAME_FAMILY_NO_CONCRETE_EVIDENCE": 32, "SAME_FAMILY_FLOOR": 75, "CITED_NO_EVIDENCE": 60, "FAMILY_DETECTED_NO_CWE": 38, "FALLBACK": 42}
GOLD_POINTS, GOLD_MOST, OFF, OFF_MOST = 1.5, 6, 10, 30
MEMBERSHIP = "cwe_correct_class"
