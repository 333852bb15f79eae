"""Patterns of redaction and of injected instructions. Results depend on each of them and on their order."""

#: Text that was redacted before.
PLACEHOLDERS = (
    (r"\[REDACTED\]", "i"),
    (r"\[REMOVED\]", "i"),
    (r"\[CENSORED\]", "i"),
    (r"\[MASKED\]", "i"),
    (r"\[HIDDEN\]", "i"),
    (r"XXXX{4,}", ""),
    (r"\*{4,}", ""),
    (r"█+", ""),
)
PLACEHOLDER = "__PLACEHOLDER__"

#: name, pattern, flags, replacement; applied in this order.
PRIVATE = (
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "", "[REDACTED_EMAIL]"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "", "[REDACTED_IP]"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "", "[REDACTED_IP]"),
    ("api_key", r"\b(?:api[_-]?key|apikey|access[_-]?token|secret[_-]?key|auth[_-]?token|bearer)\s*[:=]\s*['\"]?[A-Za-z0-9_\-./+=]{16,}['\"]?", "i", "[REDACTED_API_KEY]"),
    ("bearer_token", r"Bearer\s+[A-Za-z0-9_\-./+=]{20,}", "", "Bearer [REDACTED_TOKEN]"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_\-+=]+", "", "[REDACTED_JWT]"),
    ("aws_key", r"\b(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}\b", "", "[REDACTED_AWS_KEY]"),
    ("private_key", r"-----BEGIN\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+)?(?:PRIVATE|EC)\s+KEY-----", "", "[REDACTED_PRIVATE_KEY]"),
    ("password", r"(?:password|passwd|pwd|pass)\s*[:=]\s*['\"]?[^\s'\"]{3,}['\"]?", "i", "[REDACTED_PASSWORD]"),
    ("connection_string", r"(?:mongodb|postgres|mysql|redis|amqp|jdbc)://[^\s\"']+", "i", "[REDACTED_CONNECTION_STRING]"),
    ("url_with_creds", r"https?://[^:@\s]+:[^@\s]+@[^\s\"']+", "", "[REDACTED_URL_WITH_CREDS]"),
    ("hex_secret", r"\b(?:secret|token|key|hash)\s*[:=]\s*['\"]?[0-9a-fA-F]{32,}['\"]?", "i", "[REDACTED_SECRET]"),
    ("uuid", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "i", "[REDACTED_UUID]"),
    ("phone", r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "", "[REDACTED_PHONE]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "", "[REDACTED_SSN]"),
    ("credit_card", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "", "[REDACTED_CARD]"),
    ("internal_hostname", r"\b(?:(?:dev|staging|prod|internal|corp|vpn|admin|db|api|app|web|mail|git|ci|cd)\d*\.)[a-z0-9\-]+\.(?:internal|local|corp|intra|private|lan)\b", "i", "[REDACTED_HOSTNAME]"),
    ("internal_url", r"https?://(?:(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d+\.\d+|localhost)(?::\d+)?[^\s\"']*", "", "[REDACTED_INTERNAL_URL]"),
)

#: What a text must hold for a pattern to have a chance: a plain scan that spares most texts the costly ones.
GUARDS = {
    "email": "@",
    "ipv4": r"\d\.\d",
    "ipv6": "[0-9a-fA-F]:[0-9a-fA-F]",
    "api_key": r"(?i)(?:key|token|bearer)\s*[:=]",
    "bearer_token": "Bearer",
    "jwt": "eyJ",
    "aws_key": "A(?:KI|BI|CC|SI)A",
    "private_key": "-----BEGIN",
    "password": r"(?i)p(?:ass|wd|asswd|assword)\s*[:=]",
    "connection_string": "://",
    "url_with_creds": "://",
    "hex_secret": "[0-9a-fA-F]{32}",
    "uuid": "(?i)-[0-9a-f]{4}-",
    "phone": r"\d{3}[-.\s]?\d{4}",
    "ssn": r"\d-\d{2}-\d",
    "credit_card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}",
    "internal_hostname": r"(?i)\.(?:internal|local|corp|intra|private|lan)",
    "internal_url": "://",
    "company_name": r"\s(?:Inc|Corp|LLC|Ltd|Co|Company|Group|Technologies|Solutions|Systems|Labs|Security|Software|Platform)",
    "username": r"(?i)(?:user|login|account|reported|author|researcher|discoverer|finder)",
}

#: category, pattern with groups (what stays before, what stays after), flags, what goes between.
NAMED = (
    ("company_name", r"\b((?:at|for|of|with)\s+)[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\s+(Inc|Corp|LLC|Ltd|Co|Company|Group|Technologies|Solutions|Systems|Labs|Security|Software|Platform)\b", "", "[REDACTED_COMPANY] "),
    ("company_name", r"\b()[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\s+((?:Inc|Corp|LLC|Ltd|Co)\b\.?)", "", "[REDACTED_COMPANY] "),
    ("username", r"\b((?:user(?:name)?|login|account)\s*[:=]\s*)['\"]?[^\s'\"]{3,}['\"]?()", "i", "[REDACTED_USERNAME]"),
    ("username", r"\b((?:reported\s+by|author|researcher|discoverer|finder)\s*[:=]?\s*)['\"]?[A-Za-z][A-Za-z0-9._ -]{2,}['\"]?()", "i", "[REDACTED_USERNAME]"),
)

#: label, pattern, flags.
INJECTION = (
    ("ignore_previous_instructions", r"ignore\s+(?:all\s+|the\s+|any\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instruction|prompt|rule|message|directive|context|system\s+message)s?", "i"),
    ("disregard_previous", r"disregard\s+(?:all\s+|the\s+|any\s+)?(?:previous|prior|above|earlier)\s+(?:instruction|prompt|rule)s?", "i"),
    ("forget_everything", r"forget\s+(?:everything|all\s+(?:previous|prior)|what\s+(?:i|you)\s+(?:said|wrote)|your\s+(?:instructions|guidelines|training))", "i"),
    ("instruction_override", r"(?:new|updated|revised|override|override:|the\s+real|actual)\s+(?:instructions?|prompt|rules?|directives?)\s*[:\-]", "i"),
    ("role_flip_you_are_now", r"you\s+are\s+(?:now|actually|in\s+fact)\s+(?:a|an)\s+\w+", "i"),
    ("role_flip_act_as", r"(?:act|behave|respond|pretend\s+to\s+act)\s+as\s+(?:if\s+you\s+(?:are|were)|a|an)\s+", "i"),
    ("role_flip_pretend", r"pretend\s+(?:to\s+be|you\s+(?:are|were))\s+", "i"),
    ("role_flip_from_now_on", r"from\s+now\s+on(?:,|\s+you)\s+", "i"),
    ("system_token_spoof", r"<\|?\s*(?:system|im_start|start_of_turn)\s*\|?>", "i"),
    ("bracket_role_spoof", r"\[\s*(?:SYSTEM|INST|ASSISTANT|USER)\s*\]", "i"),
    ("markdown_system_spoof", r"^\s*(?:###?|---)\s*system\b", "im"),
    ("xml_system_spoof", r"<system>[\s\S]*?</system>", "i"),
    ("verdict_coercion", r"(?:return|output|emit|respond\s+with|set|assign)\s+(?:the\s+)?(?:slop[_\s-]?score|score|verdict|tier|grade|rating)\s*(?:=|:|to|as|of)\s*[\d\"'a-z]", "i"),
    ("json_verdict_spoof", r"\{\s*[\"']?(?:score|verdict|tier|slop)[\"']?\s*:\s*[\"']?(?:0|100|GREEN|VALID|STRONG|LIKELY[_\s]VALID)[\"']?", "i"),
    ("constant_output_coercion", r"(?:always|just|simply|only)\s+(?:return|output|reply\s+with|respond\s+with)\s+[\"'`]?(?:0|100|GREEN|VALID|safe|legitimate)", "i"),
    ("jailbreak_mode", r"\b(?:DAN|developer|dev|jailbreak|god|admin|root)\s+mode\b", "i"),
    ("dan_phrase", r"\bdo\s+anything\s+now\b", "i"),
    ("comment_injection", r"(?://|/\*|#|<!--)\s*(?:SYSTEM|INSTRUCTION|PROMPT|ASSISTANT)\s*[:\-]", "i"),
    ("html_comment_injection", r"<!--[\s\S]*?(?:ignore|disregard|forget|return\s+slop|score\s*=\s*0)[\s\S]*?-->", "i"),
    ("multilingual_fr_ignore", r"ignor(?:ez|e)\s+(?:les|toutes\s+les)\s+instructions?\s+pr[ée]c[ée]dentes", "i"),
    ("multilingual_es_ignore", r"ignor[ae]\s+(?:las|todas\s+las)\s+instrucciones\s+anteriores", "i"),
    ("multilingual_de_ignore", r"ignorier(?:e|en\s+sie)\s+(?:alle\s+)?(?:vorherigen|vorigen)\s+anweisungen", "i"),
    ("multilingual_zh_ignore", r"忽略(?:之前|以前|上面|所有)(?:的)?(?:指令|指示|提示)", ""),
    ("multilingual_ja_ignore", r"(?:以前の|前の|これまでの)(?:指示|命令|プロンプト)を無視", ""),
    ("multilingual_ru_ignore", r"игнорируй(?:те)?\s+(?:все\s+)?(?:предыдущие|прежние)\s+инструкции", "i"),
)
INJECTION_MARK = "[REDACTED-INJECTION]"
INJECTION_CHARS = 120
