"""Rules of pre-filters and fabrication checks. Fixed values."""

#: family, flag, severity, pattern, flags.
PREFILTER = (
    ("extortion", "crypto_wallet_address", 3, r"\b(?:bc1[0-9a-z]{8,}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[a-fA-F0-9]{40}|4[0-9A-B][1-9A-HJ-NP-Za-km-z]{93,})\b", ""),
    ("extortion", "extortion_deadline", 1, r"\b(?:within\s+)?(?:24|36|48|72)\s*(?:hours?|hrs?|h)\b|\bdeadline:\s*\d{1,2}\s*days?\b", "i"),
    ("extortion", "no_law_enforcement", 2, r"\bdo\s+not\s+(?:contact|inform|notify|involve|loop\s+in)\s+(?:law\s+enforcement|the\s+police|the\s+fbi|authorities|your\s+communications\s+team)\b", "i"),
    ("extortion", "we_have_your_data", 2, r"\bwe\s+(?:have|already\s+(?:have|exfiltrated|downloaded)|possess|(?:have\s+)?(?:downloaded|exfiltrated|encrypted|stolen|copied))\s+(?:\w+\s+){0,3}?(?:your|access\s+to\s+your)\b", "i"),
    ("extortion", "pay_or_leak", 3, r"\b(?:pay|payment|transfer|wire|send)\s+(?:\$|usd|eur|btc|xmr|bitcoin|monero|\d)[^.\n]{0,40}\b(?:before|or\s+(?:we|i)\s+(?:will\s+)?(?:publish|leak|disclose|release|sell|notify))", "i"),
    ("extortion", "leak_site_threat", 2, r"\b(?:publish|leak|post|dump\s+goes)\s+(?:on|to)?\s*(?:our\s+|a\s+|the\s+)?(?:leak\s+sites?|breach\s+forums?|dark\s+web|data[-\s]leak\s+sites?)\b", "i"),
    ("extortion", "partnership_fee_demand", 3, r"\bone[-\s]time\s+(?:partnership|consulting|advisory|engagement)\s+fee\b", "i"),
    ("bec", "bec_urgency", 1, r"\b(?:urgent|asap|immediately)[^.\n]{0,40}\b(?:wire\s+transfer|payment|funds|whitelist|approve|verify)\b", "i"),
    ("bec", "coffee_shop_pretext", 2, r"\bworking\s+from\s+(?:a\s+)?(?:coffee\s+shop|cafe|airport|hotel\s+wifi)\b", "i"),
    ("bec", "iphone_executive_signature", 2, r"\b(?:sent|from)\s+(?:from\s+)?my\s+iphone\b", "i"),
    ("bec", "whitelist_request", 2, r"\bplease\s+(?:immediately\s+)?whitelist\b", "i"),
    ("bec", "credential_reverify_link", 3, r"\bre[-\s]?verify\s+your\s+(?:program\s+)?credentials?\b|\bcompliance\s+review[^.\n]{0,60}\bsign\s+in\b", "i"),
    ("payment_first", "bounty_demand_no_details", 2, r"\b(?:please\s+)?(?:send|pay|transfer|wire|release)\s+(?:my\s+|the\s+)?(?:bounty|reward|payment)\s+(?:first|now|upfront|in\s+advance|before)", "i"),
    ("payment_first", "details_after_payment", 3, r"\b(?:i\s+will|i'?ll)\s+(?:share|provide|disclose|reveal|send)\s+(?:the\s+)?(?:details|poc|proof|exploit|writeup)\s+(?:after|once)\s+(?:payment|bounty|reward|you\s+pay)", "i"),
    ("payment_first", "minimum_bounty_request", 2, r"\bminimum\s+bounty\s+of\s+(?:\$|usd\s*)?\d", "i"),
    ("payment_first", "paypal_or_btc_for_details", 3, r"\b(?:paypal|venmo|cash\s*app|zelle|btc|bitcoin)[^.\n]{0,40}\b(?:for|to\s+receive|to\s+get)\s+(?:the\s+)?(?:details|poc|report)", "i"),
    ("sales_pitch", "consulting_pitch", 2, r"\b(?:we\s+offer|our\s+(?:firm|company|team)\s+(?:provides|offers))\s+[^.\n]{0,80}\b(?:penetration\s+testing|red\s+team|security\s+consulting|managed\s+detection|soc[-\s]?as[-\s]?a[-\s]?service|vCISO)\b", "i"),
    ("sales_pitch", "product_pitch", 1, r"\b(?:our|my)\s+(?:scanner|tool|platform|product|saas|service)\s+(?:can|will|would)\s+(?:detect|find|prevent|stop|catch)\b", "i"),
    ("sales_pitch", "schedule_a_call", 1, r"\b(?:schedule|book|set\s+up|available\s+for)\s+a\s+(?:call|meeting|demo|consultation|video\s+call)\b", "i"),
    ("sales_pitch", "vague_claims_no_details", 2, r"\b(?:discuss|share|provide)\s+[^.\n]{0,80}\bbefore\s+(?:providing|sharing|disclosing)\s+(?:full\s+)?(?:technical\s+)?details\b", "i"),
    ("sales_pitch", "engagement_proposal", 2, r"\b(?:engagement\s+proposal|statement\s+of\s+work|sow\s+attached|rate\s+card)\b", "i"),
)
#: family: (route, cap of realness, priority).
ROUTES = {
    "prompt_injection_canary": ("ai_security", 0.0, 3), "extortion": ("legal_ir_soc", 0.0, 3), "bec": ("legal_ir_soc", 0.0, 3), "government_impersonation": ("legal_ir_soc", 0.0, 3),
    "cve_validation": ("psirt_triage", 0.2, 1), "payment_first": ("psirt_triage", 0.2, 1), "sales_pitch": ("psirt_triage", 0.2, 1),
}
QUARANTINE = 3
STRICT_CVE, LOOSE_CVE = r"\bCVE-\d{4}-\d{4,}\b", r"\bCVE-(?:\d{2,4}|[A-Za-z]{2,})-[A-Za-z0-9]{2,}\b"

SEVERITY_CLAIM = r"(?:cvss\s*(?:score\s*)?(?::|of|=)\s*(?:9\.[0-9]|10\.0)|critical\s+(?:severity|vulnerability)|(?:remote\s+code\s+execution|rce)\s+vulnerability)"
SEVERITY_SUPPORT = (
    r"(?:exec\(|system\(|eval\(|spawn\(|popen|subprocess|os\.system|Runtime\.exec|ProcessBuilder|shell_exec|passthru|`[^`]*\$)",
    r"(?:(?:bypass|skip|circumvent)\s+(?:auth|authentication|authorization)|(?:jwt|token|session)\s+(?:forge|tamper|manipulat))",
    r"(?:(?:union\s+select|or\s+1\s*=\s*1|'\s*(?:or|and)\s*'|sqlmap|injection\s+point)\s)",
    r"```[\s\S]*?(?:curl|wget|python|ruby|perl|bash|sh|nc|ncat)[\s\S]*?```",
)
CVSS = r"cvss\s*(?:v?3(?:\.1)?)?[\s:]*(?:score\s*)?(?::|of|=|is)?\s*(\d+\.?\d*)"
OWASP = r"owasp\s+top\s+(?:10|ten)"
NAMED_CLASS = r"(?:cross-site\s+scripting|xss|sql\s+injection|sqli|buffer\s+overflow|heap\s+overflow|use[\s-]after[\s-]free|double[\s-]free|race\s+condition|toctou|ssrf|csrf|xxe|deserialization|prototype\s+pollution)"
RESEARCHER = r"(?:reported|discovered|found|credited)\s+(?:by|to)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
TEMPLATED = r"(?:dear\s+(?:security|sir|team)|i\s+(?:hope|would like)|best\s+regards|sincerely)"

_LOW = "claim_specificity < 10 AND evidence_quality < 10"


def validity(verified: str) -> str:
    """Validity, given what a verification counts."""
    return f"CAST(floor(0.25 * evidence_quality + 0.2 * CASE WHEN {_LOW} THEN least(hallucination, 40) ELSE hallucination END + 0.2 * claim_specificity + 0.15 * CASE WHEN {_LOW} THEN least(consistency, 40) ELSE consistency END + 0.1 * (100 - factual) + 0.1 * CASE WHEN verification IS NULL THEN 50.0 ELSE {verified} END + 0.5) AS BIGINT)"


def confidence(verified: str) -> str:
    """Confidence, given what a verification adds."""
    return f"floor(least(1.0, 0.3 + 0.07 * strong_markers + 0.03 * human_signs + {verified}) * 0.85 * CASE WHEN markers + human_signs < 3 THEN 0.7 ELSE 1.0 END * 100.0 + 0.5) / 100.0"


#: Fusion of the axes into one score, stage by stage (columns: lexical, statistical, template, spectral, human_reduction, evidence_quality, hallucination,
#: claim_specificity, consistency, factual, verified, verification, hallucinated_function, fabricated_cve, future_cve, fake_trace, strong_markers, markers, human_signs).
FUSION = (
    {"linguistic": "CAST(floor(0.6 * lexical + 0.4 * statistical + 0.5) AS BIGINT)"},
    {
        "authenticity": "CAST(least(100.0, greatest(0.0, floor(greatest(0.0, 0.4 * linguistic + 0.35 * template + 0.25 * spectral + CASE WHEN linguistic > 40 AND template > 50 THEN least(15.0, 0.3 * (linguistic - 40) + 0.1 * (template - 50)) ELSE 0.0 END + human_reduction) + 0.5))) AS BIGINT)",
        "validity": validity("least(100.0, 20.0 * verified + 0.5 * (100 - verification))"),
        "substance_axis": "CAST(least(100, CASE WHEN hallucinated_function THEN 35 ELSE 0 END + CASE WHEN fabricated_cve THEN 28 ELSE 0 END + CASE WHEN future_cve THEN 25 ELSE 0 END + CASE WHEN fake_trace THEN 20 ELSE 0 END) AS BIGINT)",
    },
    {
        "style_driven": "CAST(floor(0.65 * authenticity + 0.35 * (100 - validity) + 0.5) AS BIGINT)",
        "substance_driven": "CAST(floor(0.85 * substance_axis + 0.15 * (100 - validity) + 0.5) AS BIGINT)",
        "quadrant": "CASE WHEN authenticity >= 50 AND validity < 50 THEN 'AI_SLOP' WHEN authenticity >= 50 THEN 'AI_ASSISTED' WHEN validity < 50 THEN 'WEAK_HUMAN' ELSE 'STRONG_HUMAN' END",
        "confidence": confidence("CASE WHEN verification IS NULL THEN 0.0 ELSE 0.1 END"),
    },
    {"slop_score": "CAST(least(100, greatest(CASE WHEN verified > 0 THEN 5 ELSE 0 END, greatest(style_driven, substance_driven) - 3 * verified)) AS BIGINT)"},
    {
        "tier": "CASE WHEN slop_score >= 80 THEN 'Slop' WHEN slop_score >= 60 THEN 'Likely Slop' WHEN slop_score >= 40 THEN 'Questionable' WHEN slop_score >= 20 THEN 'Likely Human' ELSE 'Clean' END",
        "archetype": "CASE quadrant WHEN 'AI_SLOP' THEN 'AUTO_CLOSE' WHEN 'AI_ASSISTED' THEN 'PRIORITIZE_REVIEW' WHEN 'WEAK_HUMAN' THEN 'REQUEST_DETAILS' ELSE 'ACCEPT' END",
    },
)
