"""Rules of references that are looked up. Names, weights and bounds are fixed values."""

from __future__ import annotations

CVE = (r"CVE-(\d{4})-\d{4,}", "")
MOST_CODE, MOST_CVES, FIRST_YEAR = 5, 3, 1999
#: Phrases of so many words, each longer than; descriptions shorter than this have none; copied from more than so many hundredths on.
PHRASE, SHORT_WORD, SHORT_DESCRIPTION, COPIED = 4, 3, 20, 30
WEIGHTS = {
    "file_verified": -8, "file_missing": 20, "function_verified": -8, "function_missing": 20, "invalid_cve_year": 25, "fabricated_cve": 20, "stale_missing_cve": 12, "recent_cve_not_yet_published": 3, "plagiarism": 15, "verified_cve": -5,
}
