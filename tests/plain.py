"""The expected behaviour in plain Python, for small inputs."""

import re

from veilwork import fixed_values as fv

STRICT = [(fv.STRICT_ID, fv.MASK_ID), (fv.STRICT_PHONE, fv.MASK_PHONE), (fv.STRICT_EMAIL, fv.MASK_EMAIL)]
LOOSE = [(fv.LOOSE_ID, fv.MASK_ID), (fv.LOOSE_PHONE, fv.MASK_PHONE), (fv.LOOSE_EMAIL, fv.MASK_EMAIL)]


def hits(pattern, text):
    return [m.group(0) for m in re.finditer(pattern, text)]


def by_patterns(rules, text):
    masked = text
    for pattern, mask in rules:
        masked = re.sub(pattern, mask, masked)
    return masked, [len(hits(pattern, text)) for pattern, _ in rules]


def by_words(text):
    masked, counts = text, []
    for terms, mask in ((fv.NAMES, fv.MASK_NAME), (fv.LOCATIONS, fv.MASK_LOCATION)):
        total = 0
        for term in terms:
            masked, n = re.subn(rf"\b{re.escape(term)}\b", lambda _: mask, masked, flags=re.IGNORECASE)
            total += n
        counts.append(total)
    return masked, [*counts, 0]


def jury(text):
    """(sanitized, winner, nine counts)"""
    if not text:
        return text, None, [0] * 9
    results = {"A": by_patterns(STRICT, text), "B": by_words(text), "C": by_patterns(LOOSE, text)}
    winner = max("ABC", key=lambda tool: sum(results[tool][1]))
    return results[winner][0], winner, [n for tool in "ABC" for n in results[tool][1]]


def intents(role, prompt):
    if not role or not prompt:
        return []
    return [
        intent
        for intent in fv.ROLE_INTENTS.get(role.lower(), [])
        if any(word in prompt.lower() for word in fv.INTENT_KEYWORDS[intent])
    ]


def authorized(role, prompt):
    return bool(role and prompt and role.lower() in fv.ROLE_INTENTS and not intents(role, prompt))
