"""Regular expressions with Python's Unicode meaning, for Spark's Java engine.

Python's ``\\b``, ``\\d``, ``\\s`` and ``\\w`` follow Unicode categories.  Java's
depend on flags and on the JDK version, so patterns are spelled out with
explicit classes instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# A word character is a letter, a number of any kind, or the underscore.
WORD = r"[\p{L}\p{N}_]"
# White space: the Unicode spaces plus the four ASCII separators 1C-1F.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# The same characters without brackets, for use inside a class.
SPACE_CHARS = SPACE[1:-1]
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
BOUNDARY = f"(?:{NOT_AFTER_WORD}(?={WORD})|(?<={WORD}){NOT_BEFORE_WORD})"

_ESCAPES = {"b": BOUNDARY, "d": r"\p{Nd}", "s": SPACE, "w": WORD}
_UNSUPPORTED = set("BDSWAZ")


def spark_regex(pattern: str) -> str:
    """Translate a Python pattern to a Java one that matches the same text."""

    def swap(match: re.Match) -> str:
        letter = match[1]
        if letter in _UNSUPPORTED:
            raise ValueError(f"escape \\{letter} is not supported in {pattern!r}")
        return _ESCAPES.get(letter, match[0])

    return re.sub(r"\\(.)", swap, pattern)


def words_of(terms: Iterable[str]) -> set[str]:
    """Distinct lower-case words of all terms."""
    return {word for term in terms for word in re.findall(r"\w+", term.lower())}


def _prefix_tree(terms: Iterable[str]) -> dict:
    root: dict = {}
    for term in terms:
        node = root
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}
    return root


def _tree_regex(node: dict) -> str:
    branches = [re.escape(char) + _tree_regex(child) for char, child in node.items() if char]
    if not branches:
        return ""
    if "" in node:
        return "(?:" + "|".join(branches) + ")?"
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def term_regex(terms: Iterable[str]) -> str:
    """One expression for a word list, shared prefixes tried once.

    The longest term wins where one is a prefix of another.
    """
    terms = [term.lower() for term in terms]
    for term in terms:
        if not re.fullmatch(r"\w(?:.*\w)?", term):
            raise ValueError(f"dictionary term {term!r} must begin and end with a word character")
    return _tree_regex(_prefix_tree(terms))


def whole_words(*term_lists: Iterable[str]) -> str:
    """Case-insensitive whole-word match of any term, one group per list.

    The first letters are tested before the boundary, which costs more.
    """
    lists = [list(terms) for terms in term_lists]
    first = "".join(re.escape(c) for c in dict.fromkeys(t[0].lower() for terms in lists for t in terms))
    body = "|".join(f"({term_regex(terms)})" for terms in lists)
    return f"(?iu)(?=[{first}]){NOT_AFTER_WORD}(?:{body}){NOT_BEFORE_WORD}"


def without_terms(*term_lists: Iterable[str]) -> str:
    """Matches texts in which ``whole_words`` of the lists has no hit.

    A hit begins where a word begins, so terms are tried once per word instead of once per
    character; the possessive loop over the words neither goes back nor nests.
    """
    body = "|".join(term_regex(terms) for terms in term_lists)
    return rf"\A[^{WORD[1:]}*+(?:(?!(?iu:{body}){NOT_BEFORE_WORD}){WORD}+[^{WORD[1:]}*)*+\z"


def literal_replacement(text: str) -> str:
    """Escape a text for use as a Java replacement string."""
    return re.sub(r"([\\$])", r"\\\1", text)
