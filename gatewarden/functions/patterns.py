"""Regular expressions of the rules, and their translation to the JVM's dialect."""

from __future__ import annotations

# The patterns that redaction and audits must apply, in this order.
SECRETS = (
    r"sk-(?:proj-)?(?=[A-Za-z0-9_-]*\d)[A-Za-z0-9_-]{8,}",
    r"Bearer\s+\S+",
    r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    r"ghp_[A-Za-z0-9]{20,}",
    r"github_pat_[A-Za-z0-9_]{20,}",
    r"AKIA[0-9A-Z]{16}",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}\b"
# Identifiers, patterns (case-insensitive where marked) and messages of dangerous strings.
DANGEROUS = (
    ("D001", r"curl\s+[^\n|]*\|\s*sh\b", True, "Shell pipe to sh detected in tool text"),
    ("D002", r"rm\s+-rf\b", True, "Destructive rm -rf pattern in tool text"),
    ("D003", r"`[^`]+`", False, "Backtick command execution pattern in tool text"),
    ("D004", r"\$\([^)]+\)", False, "Subshell $() pattern in tool text"),
    ("D005", r"base64\s+-d|atob\s*\(", True, "Base64 decode pattern in tool text"),
    ("D006", r"\b(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.|169\.254\.)", False, "Private or link-local IP hint in tool text"),
)
PLACEHOLDER = "[REDACTED]"
SAFE_ERROR = "An error occurred."
BYTE_MESSAGE = r'"message"\s*:\s*"([^"\\]|\\.)*"'

#: White space as the policies' dialect knows it; word boundaries there are ASCII.
_SPACE = r"\t\n\x0B\f\r    -     　﻿"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def jvm(pattern: str, ignore_case: bool = False) -> str:
    """A pattern of the policies' dialect for the JVM."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            i += 2
            if d == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif d == "S" and not in_class:
                out.append(f"[^{_SPACE}]")
            elif d == "b" and not in_class:
                out.append(_EDGE)
            elif d == "B" and not in_class:
                out.append(f"(?!{_EDGE})")
            elif d == "d":
                out.append("0-9" if in_class else "[0-9]")
            elif d == "w":
                out.append("A-Za-z0-9_" if in_class else "[A-Za-z0-9_]")
            elif d == "/":
                out.append("/")
            else:
                out.append("\\" + d)
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append("\\[" if c == "[" else "\\&" if c == "&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == ".":
            out.append(r"[^\n\r  ]")
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def python(pattern: str) -> str:
    """The same pattern for Python's regular expressions."""
    return jvm(pattern).replace(r"\z", r"\Z")


#: Texts without this literal (or, for numbers, this shape) cannot hold a match: a cheap test before the pattern.
NEEDS = {**dict(zip(SECRETS, ("sk-", "Bearer", "eyJ", "ghp_", "github_pat_", "AKIA"))), EMAIL: "@", PHONE: None}
DIGITS = "[0-9]{4}"


def literal(replacement: str) -> str:
    """A replacement text without special signs."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


_ESCAPES = set("bBdDsSwWnrtfvxuck0123456789")


def compiles(pattern: str) -> bool:
    """Whether the policies' dialect takes a pattern: named groups in angle brackets, any letter escaped, ``[^]`` and
    ``[]``, and look-behind of any width are fine there."""
    import re

    p = re.sub(r"\\([A-Za-z])", lambda m: m[0] if m[1] in _ESCAPES - set("ckx") else m[1] if m[1] not in "ckx" else m[0], pattern)
    p = re.sub(r"\(\?<([A-Za-z_$][\w$]*)>", lambda m: f"(?P<{m[1].replace('$', '_')}>", p)
    p = re.sub(r"\\k<([A-Za-z_$][\w$]*)>", lambda m: f"(?P={m[1].replace('$', '_')})", p)
    p = re.sub(r"\\c[A-Za-z]|\\x(?![0-9A-Fa-f]{2})|\\u(?![0-9A-Fa-f]{4})", "x", p).replace("[^]", "[\\s\\S]").replace("[]", "(?!)")
    try:
        re.compile(p)
        return True
    except re.error as e:
        return "look-behind" in str(e)
