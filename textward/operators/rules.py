"""Rules as data. The patterns, words, confidences (in hundredths) and severities are fixed values."""

from __future__ import annotations

#: (type, pattern, confidence with context, without, words of context), in the order in which entities are listed.
AADHAAR = ("IN_AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", 95, 70, ("aadhaar", "aadhar", "uid", "uidai"))
PAN = ("IN_PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", 95, 85, ("pan", "permanent account"))
EMAIL = ("EMAIL", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 95, 95, ())
PHONE_WORDS = ("call", "phone", "contact", "mobile", "reach")
PHONES = tuple(
    ("PHONE", p, 90, 75, PHONE_WORDS)
    for p in (
        r"\+91[\s-]?\d{5}[\s-]?\d{5}",
        r"\+91[\s-]?\d{10}",
        r"\+1[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{4}",
        r"\b[6-9]\d{9}\b",
        r"\b\d{3,4}[\s-]?\d{7,8}\b",
    )
)
SSN = ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", 95, 80, ("ssn", "social security"))
CARD = ("CREDIT_CARD", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", 90, 60, ("card", "credit", "debit", "visa", "mastercard"))
PERSON = ("PERSON", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", 70, 70, ("contact", "employee", "customer", "mr", "ms", "dr", "works at", "from"))
NOT_PERSONS = ("Harry Potter", "Sherlock Holmes", "Bill Gates", "Elon Musk", "Conference Room", "Google Drive", "New York", "San Francisco")

#: Looser patterns without word borders, for a first look.
QUICK = (
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}",
    r"\d{4}[\s-]?\d{4}[\s-]?\d{4}",
    r"[A-Z]{5}\d{4}[A-Z]",
    r"\d{3}-\d{2}-\d{4}",
    r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}",
)

SEVERITY = {
    "IN_AADHAAR": 10, "IN_PAN": 9, "US_SSN": 10, "CREDIT_CARD": 9, "US_BANK_NUMBER": 8, "US_PASSPORT": 8, "US_DRIVER_LICENSE": 7, "IBAN_CODE": 7,
    "IP_ADDRESS": 4, "EMAIL_ADDRESS": 3, "PHONE_NUMBER": 3, "PERSON": 2, "LOCATION": 2, "DATE_TIME": 1, "URL": 2, "DOMAIN_NAME": 2,
}
DEFAULT_SEVERITY = 5
BLOCK_ABOVE = 8
LOW_CONFIDENCE = 60
