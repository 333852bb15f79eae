"""Patterns, phrases and weights of writing style. Results depend on each of them."""

from __future__ import annotations

PASSIVE = ((r"\b(?:is|are|was|were|been|being)\s+(?:\w+ed|known|found|seen|given|made|done|shown|taken|used)\b", "i"), (r"\b(?:has|have|had)\s+been\s+\w+ed\b", "i"))
CONTRACTIONS = (
    r"\b(?:don't|won't|can't|isn't|aren't|wasn't|weren't|hasn't|haven't|hadn't|doesn't|didn't|couldn't|wouldn't|shouldn't|it's|i'm|i've|i'll|we're|we've|they're|they've|that's|there's|here's|what's|who's|let's|ain't)\b", "i",
)
FORMAL = (
    r"\b(?:cannot|will not|do not|is not|are not|was not|were not|has not|have not|does not|did not|could not|would not|should not|it is|I am|I have|I will|we are|we have|they are|they have|that is|there is|here is|what is"
    r"|who is|let us)\b", "i",
)

_LETTER = r"dear\s+(?:security\s+team|sir/madam|team|vulnerability\s+team)"
_TYPE, _SEVERITY, _IMPACT, _REMEDY = r"vulnerability\s+type\s*:", r"severity\s*:", r"impact\s*:", r"remediation\s*:"
#: name: (weight, patterns that must occur, patterns).
TEMPLATES = {
    "dear_security_team": (12, 1, (_LETTER, r"i\s+(?:am\s+writing|would\s+like)\s+to\s+(?:report|inform|notify|bring\s+to\s+your\s+attention)")),
    "dependency_dump": (10, 2, (r"(?:outdated|vulnerable)\s+dependenc(?:y|ies)", r"npm\s+audit|snyk|dependabot")),
    "owasp_padding": (8, 1, (r"owasp\s+top\s+(?:10|ten)", r"(?:according\s+to|as\s+per|based\s+on)\s+owasp")),
    "audit_checklist": (8, 2, (r"security\s+(?:audit|assessment|review)\s+(?:report|findings)", r"(?:finding|issue)\s+#?\d+\s*[:\.]")),
    "bounty_template": (
        8, 5, (_TYPE, _SEVERITY, _IMPACT, r"steps\s+to\s+reproduce\s*:", _REMEDY, r"recommendation\s*:", r"proof\s+of\s+concept\s*:", r"affected\s+(?:url|component|endpoint)\s*:", r"attack\s+vector\s*:", r"privileges\s+required\s*:"),
    ),
    "formal_letter": (
        14, 2, (_LETTER, r"(?:best|kind)\s+regards", r"i\s+hope\s+this\s+(?:message|report|finding)\s+finds\s+you", r"thank\s+you\s+for\s+your\s+time\s+and\s+attention", r"i\s+look\s+forward\s+to\s+hearing"),
    ),
    "full_template_headers": (15, 5, (_TYPE, _SEVERITY, r"cvss\s+score\s*:", r"description\s*:", _IMPACT, _REMEDY)),
    "generic_sqli_template": (14, 3, (r"(?:sql\s+injection|sqli)", r"['\"]?\s*OR\s+['\"]?1['\"]?\s*=\s*['\"]?1", r"(?:expected\s+behavior|actual\s+behavior)\s*:")),
    "generic_remediation": (
        7, 1, (
            r"(?:it\s+is\s+(?:recommended|advised)|we\s+recommend|the\s+(?:fix|solution|remediation)\s+is)\s+to",
            r"(?:implement|ensure|enforce)\s+(?:proper|adequate|robust)\s+(?:input\s+validation|authentication|authorization|sanitization)",
        ),
    ),
    "executive_summary_template": (10, 2, (r"executive\s+summary\s*:", r"detailed\s+description\s*:")),
}

#: Phrases of the simple heuristic.
STOCK_PHRASES = (
    "it is important to note", "it's worth noting", "it should be noted", "in conclusion", "as an ai", "as a language model", "i'd be happy to", "certainly!", "absolutely!", "here's a comprehensive", "it's crucial to",
    "this vulnerability allows an attacker to", "this is a critical vulnerability", "delve into", "tapestry", "multifaceted", "paramount", "in the realm of", "landscape of", "leveraging this vulnerability",
    "in today's digital landscape", "represents a significant", "comprehensive analysis", "thoroughly examined", "meticulous", "it bears mentioning", "the implications of this", "holistic approach", "robust security",
    "proactive measures",
)
#: name: (pattern, flags).
STRUCTURE = {
    "names_version": (r"(?:version|v)\s*[0-9]+\.[0-9]+", "i"),
    "names_component": (r"(?:component|package|library|module|function|endpoint|file|class)\s*[:=\-]\s*\S+", "i"),
    "names_path": (r"(?:/[\w\-\./]+\.\w{1,5}|/api/|/src/|/lib/|/bin/)", ""),
    "has_steps": (r"(?:step[s]?\s*(?:to\s*)?reproduce|reproduction|poc|proof\s*of\s*concept|how\s*to\s*reproduce)", "i"),
    "has_code": (r"```[\s\S]*?```|`[^`]+`", ""),
    "has_vector": (r"(?:attack\s*vector|cvss|cwe-?\d+|cve-?\d{4}-?\d+|remote|local|network|adjacent)", "i"),
    "has_impact": (r"(?:impact|severity|consequence|risk|damage|confidentiality|integrity|availability)", "i"),
    "has_expected": (r"(?:expected\s*(?:behavior|behaviour|result)|should\s*(?:return|respond|show|display))", "i"),
    "has_observed": (r"(?:observed|actual|instead|but\s*(?:it|the)|however|unexpectedly)", "i"),
}

#: Formulas over the measures: style in numbers, stage by stage. A part that is null does not count.
STATISTICAL = (
    {
        "uniform_part": "CASE WHEN long_sentences >= 5 THEN CASE WHEN sentence_cv < 0.25 THEN floor(least(100.0, (0.25 - sentence_cv) * 400.0) + 0.5) ELSE 0.0 END END",
        "variation_part": "CASE WHEN long_sentences >= 5 THEN CASE WHEN sentence_cv < 0.3 THEN 70.0 WHEN sentence_cv < 0.5 THEN 45.0 WHEN sentence_cv < 0.7 THEN 15.0 ELSE 5.0 END END",
        "passive_ratio": "passives * 20.0 / words",
        "formal_part": "CASE WHEN words > 100 AND contractions = 0 AND formal >= 3 THEN least(100.0, 15.0 * formal) ELSE 0.0 END",
        "entropy_part": "CASE WHEN long_words >= 50 THEN CASE WHEN pair_entropy < 0.85 THEN floor(least(100.0, (0.85 - pair_entropy) * 300.0) + 0.5) ELSE 0.0 END END",
        "range_part": "CASE WHEN long_words >= 50 THEN CASE WHEN pair_entropy < 0.88 THEN 60.0 WHEN pair_entropy < 0.92 THEN 35.0 WHEN pair_entropy < 0.95 THEN 15.0 ELSE 5.0 END END",
    },
    {"passive_part": "CASE WHEN passive_ratio > 0.3 THEN floor(least(100.0, (passive_ratio - 0.3) * 143.0) + 0.5) ELSE 0.0 END"},
    {
        "statistical": "CAST(floor((0.15 * coalesce(uniform_part, 0.0) + 0.2 * coalesce(variation_part, 0.0) + 0.15 * passive_part + 0.15 * formal_part + 0.1 * coalesce(entropy_part, 0.0) + 0.2 * coalesce(range_part, 0.0))"
        " / (0.3 + CASE WHEN long_sentences >= 5 THEN 0.35 ELSE 0.0 END + CASE WHEN long_words >= 50 THEN 0.3 ELSE 0.0 END) + 0.5) AS BIGINT)",
    },
)

#: The simple heuristic: points of slop and what quality loses.
HEURISTIC = (
    {
        "slop_points": "CAST(CASE WHEN words > 5000 THEN 10 ELSE 0 END + CASE WHEN stock >= 5 THEN 30 WHEN stock >= 3 THEN 15 WHEN stock >= 1 THEN 5 ELSE 0 END + CASE WHEN long_sentences > 5 AND sentence_words > 30.0 THEN 8 ELSE 0 END"
        " + CASE WHEN words > 100 AND distinct_words < 0.3 * words THEN 10 ELSE 0 END AS BIGINT)",
        "quality_points": "CAST(100 - CASE WHEN words < 30 THEN 25 WHEN words < 100 THEN 10 ELSE 0 END - CASE WHEN names_version THEN 0 ELSE 8 END - CASE WHEN names_component OR names_path THEN 0 ELSE 8 END - CASE WHEN has_steps THEN 0 ELSE 10 END"
        " - CASE WHEN has_code THEN 0 ELSE 5 END - CASE WHEN has_vector THEN 0 ELSE 5 END - CASE WHEN has_impact THEN 0 ELSE 5 END - CASE WHEN has_expected OR has_observed THEN 0 ELSE 5 END"
        " - CASE WHEN paragraphs = 1 AND words > 200 THEN 5 ELSE 0 END AS BIGINT)",
    },
    {"slop_tier": "CASE WHEN slop_points >= 80 THEN 'Slop' WHEN slop_points >= 60 THEN 'Likely Slop' WHEN slop_points >= 40 THEN 'Questionable' WHEN slop_points >= 20 THEN 'Likely Human' ELSE 'Clean' END"},
)
