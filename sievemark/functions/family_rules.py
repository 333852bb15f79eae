"""Rules of texts that belong to no family of vulnerabilities. Phrases and points are fixed values."""

from __future__ import annotations

from .feature_rules import ENGINES

#: (phrase, category), in lower case.
VAGUE = (
    ("do not have a runnable reproducer", "absence"), ("do not have a reproducer", "absence"), ("private fuzzing harness", "absence"), ("private poc", "absence"), ("structural rather than", "absence"),
    ("structural vulnerability follows from the design", "absence"), ("i have not enumerated", "absence"), ("have not been able to confirm", "absence"), ("no working proof-of-concept", "absence"),
    ("no runnable proof", "absence"), ("follows from the design as observed", "absence"), ("deployment is no different in this respect", "absence"), ("may not be encrypted", "hedging"),
    ("may be present in environment variables", "hedging"), ("do not appear to be", "hedging"), ("does not appear to be", "hedging"), ("appears to be susceptible", "hedging"), ("consider a holistic remediation", "hedging"),
    ("leadership-level discussion", "hedging"), ("comprehensive zero-trust assessment", "buzzword"), ("modern threat landscape", "buzzword"), ("advanced persistent threats", "buzzword"),
    ("defense-in-depth posture", "buzzword"), ("weak security culture", "buzzword"),
)
CATEGORIES = ("absence", "hedging", "buzzword")
#: Points off for each phrase, the most of all, from how many on a composite loses more, and how much.
VAGUE_POINTS, VAGUE_MOST, VAGUE_FROM, VAGUE_COMPOSITE = 6, 24, 18, -8
LABEL = next(stage["label"] for stage in ENGINES if "label" in stage).replace("composite", "family_composite")
