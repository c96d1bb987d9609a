"""Patterns of the text rules, and how to hand them to the engine.

The patterns are written with ``\\b`` for an ASCII word boundary.  Java's ``\\b`` also counts
accented letters as word characters, so ``java()`` spells the boundary out.
"""

from __future__ import annotations

import re

_BEFORE, _BEHIND = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_EDGE = rf"(?:(?<=[A-Za-z0-9_]){_BEHIND}|{_BEFORE}(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """The pattern with its word edges spelled out; an edge between anything and a letter or digit, or behind one, takes one look only."""
    pattern = re.sub(r"\\b(?=[A-Za-z]|\\d)", lambda _: _BEFORE, pattern)
    pattern = re.sub(r"(?<=[a-z])(?<!\\[a-z])\\b", lambda _: _BEHIND, pattern)
    return pattern.replace(r"\b", _EDGE)


#: White space, no-break and typographic spaces included.
SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Patterns that decide what a posting is and who may apply.
INTERN = r"(?i)\b(intern|interns|internship|internships|traineeship|traineeships)\b"
STAFF = r"(?i)\bintern(?:ship)?s?\s+(?:programme?\s+)?(?:and\s+\w+\s+)?(coordinator|co-?ordinator|coordination|manager|management|supervisor|officer|lead|leader|specialist|consultant|advis(?:or|er)|director|mentor|focal\s+point|liaison)\b"
ROUNDUP = r"(?i)\b\d+\s+(?:jobs?|positions?|roles?|opportunit\w*|vacanc\w*)\b|\b(?:job|internship)s?\s+(?:vacanc\w*|opportunit\w*)\s+(?:at|with|in)\b|\b(?:vacancies|opportunities)\s+(?:at|with)\b"
HOME_COUNTRY = r"(?i)\b(ethiopia|ethiopian|addis\s*ababa|addis|hawassa|awassa|bahir\s*dar|mekelle|mek'?ele|dire\s*dawa|adama|jimma|gondar|jijiga)\b"
REMOTE_WORD = r"(?i)\bremote\b"
REMOTE_MODALITY = r"(?i)\b(fully\s+remote|100%\s+remote|remote(?:\s+(?:position|role|internship|work|working|based|first|only|eligible|opportunity))|home[-\s]?based|work\s+from\s+home|work\s+from\s+anywhere|telecommut\w+|virtual\s+internship|distance\s+internship)\b"
REMOTE_GEOGRAPHY = r"(?i)\bremote\s+(areas?|regions?|villages?|communit\w+|locations?|location|field|districts?|woredas?|zones?|parts?|settings?|sites?|rural)\b"
REMOTE_NEGATED = r"(?i)\b(no(?:t)?\s+(?:\w+\s+){0,2}remote|non[-\s]?remote|on[-\s]?site|in[-\s]?person|in\s+the\s+office|must\s+relocate|relocation\s+(?:is\s+)?required|based\s+(?:in|at)\s+(?:our|the)\s+\S+\s+office|hybrid|\d{1,2}\s*%\s+(?:of\s+)?remote|\d+\s+days?\s+(?:of\s+)?remote)\b"
SPONSORED = r"(?i)\b(visa\s+sponsorship|visa\s+(?:will\s+be\s+)?(?:sponsored|provided|arranged)|relocation\s+(?:support|assistance|package|allowance|provided|covered|reimbursed)|(?:travel|airfare|flights?)\s+(?:costs?\s+|expenses?\s+)?(?:are\s+|will\s+be\s+|is\s+)?(?:provided|covered|reimbursed|arranged)|(?:cover|covers|provide|provides|reimburse|reimburses)\s+(?:the\s+(?:cost\s+of\s+)?|your\s+|all\s+)?(?:travel|airfare|flights?|relocation))\b"
SPONSOR_NEGATED = r"(?i)\b(?:not|cannot|can'?t|unable\s+to|will\s+not|won'?t|does\s+not|do\s+not|don'?t|no(?:t)?)\b[^.]{0,30}\b(?:cover|covers|provide|provides|sponsor|fund|funded|reimburse|reimburses|arrange)\b|\bvisa\s+support\s+letter\b"
RESTRICTED = r"(?i)\b(must\s+(?:be\s+)?(?:eligible|authoriz\w+|authoris\w+|legally\s+(?:able|entitled)|have\s+the\s+(?:legal\s+)?right)\s+to\s+work\s+in\s+(?:the\s+)?(?:us|u\.s\.?|usa|united\s+states|uk|united\s+kingdom|eu|european\s+union|canada|australia|switzerland|schengen)|work\s+(?:authoriz\w+|authoris\w+|permit|visa)\s+(?:in|for)\s+(?:the\s+)?(?:us|usa|united\s+states|uk|eu|canada|australia)|(?:us|u\.s\.?|eu|uk|canadian|australian|swiss)\s+(?:citizens?|nationals?|residents?)\s+only|right\s+to\s+work\s+in\s+(?:the\s+)?(?:us|uk|eu|united|canada|australia))\b"

# Patterns of labelled fields, dates and pay.
LABEL_STOP = r"(?i)\s+(?:Location|Work\s+Location|Duty\s+Station|Organization|Organisation|Department(?:\s*/\s*Office)?|Deadline(?:\s+Date)?|Closing\s+Date|Application\s+Deadline|Apply\s+By|Posting\s+Title|Job\s+(?:Description|Opening|Schedule|ID|Code|Network|Family)|Expected\s+duration|Duration|Hours|Engagement|About|Categories|Category|Grade|Level|Posted|Eligibility|Type\s+of\s+Contract)\s*:|\s+Related\s+Articles\b|\s+©|\n"
LABELS = {
    "location": r"\bLocation\s*:", "work_location": r"\bWork Location\s*:", "duty_station": r"\bDuty Station\s*:", "organization": r"\bOrgani[sz]ation\s*:",
    "department": r"\bDepartment\s*:", "deadline": r"\bDeadline(?:\s+Date)?\s*:", "closing_date": r"\bClosing Date\s*:",
}
DEADLINE_LABEL = r"(?:Deadline(?:\s+Date)?|Closing\s+Date|Apply\s+by|Application\s+Deadline|Applications?\s+(?:close|due|deadline))\b"
DATE_TOKEN = r"([A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}|\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?,?\s*\d{4}|\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4})"
STRONG_DEADLINE = r"(?i)(?:no(?:t)?\s+later\s+than|on\s+or\s+before)\s+(?:" + DATE_TOKEN + ")"
WEAK_DEADLINE = r"(?i)\b(?:by|before)\s+(?:" + DATE_TOKEN + ")"
ABOUT_APPLYING = r"(?i)\b(appl(?:y|ication|ications|icants)|submit|submission|send\s+your|received\s+by)\b"
UNPAID, PAID = r"\bunpaid\b|not remunerated", r"\bpaid\b|\bstipend\b|\bmonthly\s+allowance\b"
_CURRENCY, _AMOUNT = r"(?:US\$|USD|\$|€|EUR|£|GBP|ETB|Birr|KES|Ksh|NGN)", r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_PERIOD = r"(?:\s*(?:per|/|a)\s*(?:month|mo|annum|year|yr|week|day)|\s*(?:monthly|weekly|daily|annually|p\.?a\.?|pcm))"
STIPEND = f"(?i)(?:{_CURRENCY}\\s?{_AMOUNT}|{_AMOUNT}\\s?(?:USD|EUR|GBP|ETB|Birr|KES|Ksh|NGN))(?:\\s*(?:[-–—]|to)\\s*(?:{_CURRENCY}\\s?)?{_AMOUNT})?(?:{_PERIOD})?"
STIPEND_CONTEXT = r"(?i)stipend|allowance|salar|remunerat|honorar|compensat|wage|paid|payment|per\s+month|monthly|gross|net\s+pay"
AT_ORG = r"(?i)\bat\s+(.{2,80})$"

# Patterns over pages and requests.
CHALLENGE_TITLE = r"(?i)<title>\s*(One moment, please\.\.\.|Just a moment\.\.\.|Attention Required!|Access denied)\s*[^<]*</title>"
CHALLENGE_MARK = r"(?i)cf-browser-verification|cf_chl_|challenge-platform|_Incapsula_Resource|sucuri_cloudproxy"
BOT_AGENT = (
    r"(?i)bot|crawl|spider|slurp|preview|scan|fetch|monitor|curl|wget|python-requests|axios|headless|lighthouse|facebookexternalhit|telegrambot|whatsapp"
    r"|slackbot|discordbot|linkedinbot|twitterbot"
)
MOBILE_AGENT = r"(?i)mobile|android|iphone|ipad"
LOG_ERROR = r"(?i)error|failed|exception|fatal"
