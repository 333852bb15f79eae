"""Rules of what a report lacks, of what must not be missed in it, of feedback to its author, and of the projects and code it names. Patterns, bounds and names are fixed values."""

from __future__ import annotations

#: name: (pattern, flags). Whether it occurs.
FLAGS = {
    "version_range": (r"\b(?:–|->|\.\.|through|to|thru)\s*\d+\.\d+|\b(?:<=?|before|prior\s+to|up\s+to)\s*(?:v(?:ersion)?\s*)?\d+\.\d+", "i"),
    "code_block": (r"```[\s\S]*?```|^\s{4,}\S", "m"),
    "poc": (r"\b(?:proof[- ]?of[- ]?concept|poc|exploit|payload|reproduce)\b", "i"),
    "executable": (r"```(?:bash|sh|python|curl|http|javascript|js|ruby|perl|php|powershell)\b|\bcurl\s+-|\b(?:import\s|require\(|fetch\(|requests\.)", "i"),
    "impact": (r"\b(?:impact|consequence|severity|risk|damage|data\s*(?:loss|leak|exposure))\b", "i"),
    "environment": (r"\b(?:environment|setup|configuration|test(?:ing)?\s*(?:env|setup)|browser|os|platform)\b", "i"),
    "steps": (r"\b(?:step\s*\d|steps?\s*to\s*reproduce|reproduction\s*steps|how\s*to\s*reproduce)\b", "i"),
    "fix": (r"\b(?:fix|patch|remediat|mitigat|recommendation|workaround)\b", "i"),
    "http": (r"\b(?:HTTP/|GET |POST |PUT |DELETE |PATCH |request|response|header|cookie|status\s*code)\b", "i"),
    "web": (r"\b(?:XSS|SSRF|SQL|CSRF|injection|redirect|traversal)\b", "i"),
    "cvss": (r"\bCVSS\b", "i"),
    "severe": (r"critical|high severity", "i"),
    "auth_context": (r"\b(?:auth(?:enticated|orization)?|login|session|token|cookie|credential|role|permission|admin|user\s*level|privilege)\b", "i"),
    "auth": (r"\b(?:auth|session|JWT|token|IDOR|privilege|admin|access\s*control)\b", "i"),
    "network_position": (r"\b(?:internal\s*network|internet[- ]facing|local\s*network|adjacent|remote|external|DMZ|VPN|firewall|NAT)\b", "i"),
    "network": (r"\b(?:SSRF|internal|service|port|listen|bind|network|server)\b", "i"),
    "dependency": (r"\b(?:dependenc(?:y|ies)|package|library|module|npm|pip|maven|gem|nuget|cargo|go\s*mod)\b", "i"),
    "sources": (r"\b(?:\.(?:js|ts|py|rb|java|go|rs|c|cpp|php|cs)\b|src/|lib/|app/|controllers?/|models?/|views?/)\b", "i"),
    "line_ref": (r"\b(?::\d+|line\s*\d+|L\d+)\b", ""),
    "config": (r"\b(?:\.env|\.ini|\.ya?ml|\.conf|\.properties|config(?:uration)?|settings?|default\s*(?:config|settings)|custom\s*(?:config|settings))\b", "i"),
    "chain": (r"\b(?:chain(?:ed|ing)?|combin(?:ed|ing)|together\s*with|escalat|pivot|lateral)\b", "i"),
    "rce": (r"\b(?:remote\s*code\s*execution|RCE|arbitrary\s*code|command\s*(?:injection|execution))\b", "i"),
    "source_named": (r"\b(?:\.(?:js|ts|py|rb|java|go|rs|c|cpp|php|cs)\b|src/|lib/|app/|function\s+\w+|class\s+\w+|def\s+\w+)\b", "i"),
    "endpoint": (r"\b(?:/api/|endpoint|route|URL|path|GET\s+/|POST\s+/|PUT\s+/|DELETE\s+/)\b", "i"),
    "class_named": (r"\b(?:XSS|SQL|injection|SSRF|traversal|deserialization|overflow|bypass|race)\b", "i"),
    "fenced": (r"```[\s\S]*?```", ""),
    "numbered": (r"\b(?:step\s*\d|steps?\s*to\s*reproduce)\b", "i"),
    "full_version": (r"\b\d+\.\d+\.\d+\b", ""),
    "tools": (r"\b(?:curl|burp|zap|nmap|nikto|sqlmap|nuclei)\b", "i"),
    "opening": (r"\b(?:dear\s*(?:team|sir|madam)|to\s*whom\s*it\s*may\s*concern|i\s*hope\s*this\s*(?:email|message)\s*finds\s*you)\b", "i"),
    "impact_said": (r"\b(?:impact|consequence|severity|risk)\b", "i"),
    "poc_said": (r"\b(?:poc|proof|exploit|payload)\b", "i"),
    "headings": (r"^#{1,3}\s", "m"),
}
#: name: (pattern, flags). How often it occurs.
COUNTS = {"versions": (r"\b\d+\.\d+(?:\.\d+)?\b", ""), "cves": (r"CVE-\d{4}-\d{4,}", "i")}

SEVERITIES = ("critical", "important", "minor")
#: (category, severity, test). Also over ``placeholders`` and ``not_found`` (how many).
GAPS = (
    ("missing_version", "critical", "versions = 0"),
    ("single_version_only", "minor", "versions = 1 AND NOT version_range"),
    ("missing_poc", "critical", "NOT code_block AND NOT poc"),
    ("narrative_poc_only", "important", "poc AND NOT executable AND NOT code_block"),
    ("missing_impact", "important", "NOT impact"),
    ("missing_environment", "important", "NOT environment"),
    ("missing_repro_steps", "critical", "NOT steps AND NOT code_block"),
    ("missing_remediation", "minor", "NOT fix"),
    ("missing_http_detail", "important", "web AND NOT http"),
    ("placeholder_artifacts", "critical", "placeholders > 0"),
    ("unverifiable_references", "critical", "not_found >= 2"),
    ("missing_cvss", "minor", "severe AND NOT cvss"),
    ("missing_auth_context", "important", "auth AND NOT auth_context"),
    ("missing_network_position", "minor", "network AND NOT network_position"),
    ("missing_dependency_version", "important", "dependency AND versions = 0"),
    ("missing_source_location", "minor", "sources AND NOT line_ref"),
    ("missing_config", "minor", "environment AND NOT config"),
)
#: (area, test). Also over ``verified``, ``known_class``, ``slop`` (0 to 100) and ``fabricated``.
AREAS = (
    ("Attack Chain", "chain"),
    ("RCE Claim", "rce"),
    ("Multiple CVEs", "cves >= 3"),
    ("Mixed Verification", "verified > 0 AND not_found > 0"),
    ("Vulnerability Class Is Real", "known_class AND slop >= 50"),
    ("Real CVE Referenced", "cves BETWEEN 1 AND 2 AND slop >= 40"),
    ("Ambiguous Score", "slop BETWEEN 40 AND 60"),
    ("Fabricated Debug Output", "fabricated"),
    ("Dependency Tree", "true"),
    ("Source File Verification", "source_named"),
    ("Endpoint Validation", "endpoint AND class_named"),
)
#: (strength, test).
STRENGTHS = (("code", "fenced"), ("steps", "numbered"), ("versions", "full_version"), ("tools", "tools"))
_STRONG = "fenced OR numbered OR full_version OR tools"
#: (kind, tone, priority, test); the smallest priority comes first. Also over ``critical`` and ``important`` (how many gaps) and ``confidence``.
FEEDBACK = (
    ("strengths", "positive", 1, _STRONG),
    ("genuine", "positive", 2, "slop <= 20 AND confidence >= 0.7"),
    ("generated", "concern", 1, "slop >= 70"),
    ("mixed", "concern", 2, "slop >= 50 AND slop < 70"),
    ("critical_gaps", "concern", 1, "critical > 0"),
    ("important_gaps", "neutral", 3, "important_gaps > 0 AND critical = 0"),
    ("verified", "positive", 2, "verified >= 2 AND not_found = 0"),
    ("not_found", "concern", 1, "not_found >= 2 AND verified = 0"),
    ("template_opening", "neutral", 4, "opening"),
)
NOTHING = ("nothing", "neutral", 5)
CLARITY = """least(100, greatest(0, 50 + CASE WHEN numbered THEN 12 ELSE 0 END + CASE WHEN fenced THEN 10 ELSE 0 END + CASE WHEN full_version THEN 8 ELSE 0 END + CASE WHEN impact_said THEN 8 ELSE 0 END
    + CASE WHEN headings THEN 7 ELSE 0 END + CASE WHEN words BETWEEN 100 AND 2000 THEN 5 WHEN words < 30 THEN -15 ELSE 0 END - 8 * critical - CASE WHEN slop >= 70 THEN 10 ELSE 0 END))"""
ACTIONABILITY = "CASE WHEN numbered AND (fenced OR poc_said) AND full_version THEN 'high' WHEN critical <= 1 AND (numbered OR fenced) THEN 'medium' ELSE 'low' END"

#: Projects: name, and where its code is. The first listed of several names counts.
PROJECTS = {
    "curl": "curl/curl", "openssl": "openssl/openssl", "nginx": "nginx/nginx", "linux": "torvalds/linux", "node": "nodejs/node", "nodejs": "nodejs/node", "django": "django/django", "flask": "pallets/flask",
    "express": "expressjs/express", "react": "facebook/react", "wordpress": "WordPress/WordPress", "apache": "apache/httpd", "redis": "redis/redis", "postgresql": "postgres/postgres", "mysql": "mysql/mysql-server",
    "mongodb": "mongodb/mongo", "git": "git/git", "python": "python/cpython", "ruby": "ruby/ruby", "php": "php/php-src", "tensorflow": "tensorflow/tensorflow", "pytorch": "pytorch/pytorch",
    "kubernetes": "kubernetes/kubernetes", "docker": "moby/moby", "elasticsearch": "elastic/elasticsearch", "grafana": "grafana/grafana", "jenkins": "jenkinsci/jenkins", "tomcat": "apache/tomcat",
    "spring": "spring-projects/spring-framework", "rails": "rails/rails", "laravel": "laravel/laravel", "vue": "vuejs/core", "angular": "angular/angular", "nextjs": "vercel/next.js", "webpack": "webpack/webpack",
    "babel": "babel/babel", "lodash": "lodash/lodash", "axios": "axios/axios", "jquery": "jquery/jquery", "bootstrap": "twbs/bootstrap",
}
GITHUB = (r"(?:https?://)?github\.com/([a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+)", "")
GITLAB = (r"(?:https?://)?gitlab\.com/([a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+)", "")
NPM = (r"(?:npm\s+(?:install|i)\s+|require\s*\(\s*['\"]|from\s+['\"])(@?[a-zA-Z0-9][\w./-]*)", "")
PYPI = (r"(?:pip\s+install\s+|import\s+|from\s+)([a-zA-Z0-9][\w.-]*)", "")
#: A version within so many characters of a name makes it a reference.
NEAR, VERSION_NEAR = 80, (r"\d+\.\d+|version\s+\d+", "i")
MOST_PROJECTS = 10
PYTHON_STDLIB = (
    "os", "sys", "re", "json", "time", "datetime", "math", "random", "io", "typing", "collections", "itertools", "functools", "pathlib", "subprocess", "socket", "http", "urllib", "hashlib", "base64", "struct", "copy", "enum",
    "abc", "logging", "unittest", "argparse", "csv", "xml", "html", "string", "textwrap", "shutil", "glob", "tempfile", "threading", "multiprocessing", "asyncio", "contextlib", "dataclasses", "inspect", "traceback",
    "warnings", "signal", "ctypes",
)
#: Where a function is named: in the order they are looked for.
FUNCTIONS = (
    (r"(?:function|method|routine|handler|callback)\s+[`']?([a-zA-Z_]\w{2,}(?:::\w+)*)[`']?\s*\(", ""), (r"(?:in|at|from)\s+([a-zA-Z_]\w{2,}(?:::\w+)*)\s*\(", ""), (r"([a-zA-Z_]\w{2,}(?:::\w+)*)\s*\([^)]*\)\s*(?:\{|=>|:)", ""),
)
PATHS = (r"(?:^|\s|`|'|\"|/)((?:[a-zA-Z0-9_.-]+/){1,8}[a-zA-Z0-9_.-]+\.[a-zA-Z]{1,6})(?:\s|`|'|\"|:|$|,|\))", "m")
COMMON_NAMES = (
    "main", "init", "setup", "test", "run", "start", "stop", "open", "close", "read", "write", "print", "println", "printf", "sprintf", "log", "error", "exit", "return", "break", "continue", "if", "else", "for", "while",
    "switch", "case", "try", "catch", "throw", "new", "delete", "sizeof", "typeof", "instanceof", "import", "export", "require", "include", "malloc", "free", "realloc", "calloc", "memcpy", "memset", "strlen", "strcmp",
    "strcpy", "strcat", "atoi", "atof",
)
#: Most functions and paths of a text, and the longest of each.
MOST_NAMES, LONGEST_FUNCTION, LONGEST_PATH = 20, 80, 200
