"""From the rule language's regular expressions to Java's.

The rule language has linear-time expressions: no look-around and no back-references, Unicode classes,
``.`` without the line feed only, and ``$`` at the very end only.
"""

from __future__ import annotations

import re
from functools import lru_cache

from logsieve.plans.ambiguity import safe
from logsieve.plans.model import RuleError

_FORBIDDEN = re.compile(r"\(\?(?:[=!>]|<[=!])")
_GROUP_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])")


def to_java(pattern: str, line: int | None = None) -> str:
    """An equivalent Java pattern for an unanchored search; raises RuleError for what isn't allowed.

    A pattern that backtracking could try in exponentially many ways is rewritten, or refused.
    """
    out = _translated(pattern, line)
    kept = _safe(pattern)
    if kept is None:
        raise RuleError("a loop of the regular expression can read the same text in several ways, which could take without end", line)
    return out if kept == pattern else _translated(kept, line)


@lru_cache(4096)
def _safe(pattern: str) -> str | None:
    try:
        return safe(pattern)
    except (IndexError, AttributeError, RecursionError):  # a form that the analysis doesn't know
        return pattern


def _translated(pattern: str, line: int | None) -> str:
    out, at, depth, many_lines = ["(?dU)"], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if at + 1 == len(pattern):
                raise RuleError("a regular expression ends with a backslash", line)
            e = pattern[at + 1]
            if depth == 0 and e.isdigit():
                raise RuleError("back-references are not supported", line)
            if e in "zA" or e not in "GZRXkEQhHVN":
                out.append(pattern[at : at + 2])
            else:
                raise RuleError(f"\\{e} is not supported", line)
            at += 2
            continue
        if depth:
            if c == "[" and not pattern.startswith("[:", at):
                depth += 1
            elif c == "]":
                depth -= 1
            out.append(c)
            if pattern.startswith("[:", at) and (end := pattern.find(":]", at)) > 0:
                out[-1] = r"\p{" + {"alnum": "Alnum", "alpha": "Alpha", "digit": "Digit", "lower": "Lower", "upper": "Upper", "space": "Space", "punct": "Punct", "xdigit": "XDigit", "word": "IsWord"}.get(pattern[at + 2 : end], "Alnum") + "}"
                at = end + 1
            at += 1
            continue
        if c == "[":
            depth = 1
            out.append(c)
            at += 1
            for lead in ("^", "]"):
                if pattern.startswith(lead, at):
                    out.append("\\]" if lead == "]" else lead)
                    at += 1
            continue
        if _FORBIDDEN.match(pattern, at):
            raise RuleError("look-around is not supported", line)
        if pattern.startswith("(?P<", at):
            out.append("(?<")
            at += 4
            continue
        if m := _GROUP_FLAGS.match(pattern, at):
            if set(m[1] + (m[2] or "")) - set("imsxu"):
                raise RuleError(f"the flags in {m[0]} are not supported", line)
            many_lines |= "m" in m[1]
            on = m[1].replace("i", "iu") if "u" not in m[1] else m[1]
            out.append(f"(?{on}{'-' + m[2] if m[2] else ''}{m[3]}")
            at = m.end()
            continue
        out.append("\\z" if c == "$" and not many_lines else c)
        at += 1
    if depth:
        raise RuleError("a class in a regular expression isn't closed", line)
    check = "".join(out[1:]).replace("\\z", "\\Z").replace("(?<", "(?P<")
    try:
        re.compile(re.sub(r"\(\?([a-z]*)u", r"(?\1", re.sub(r"\\[pP](?:\{[^}]*\}|.)", "x", check)))
    except re.error as error:
        raise RuleError(f"bad regular expression: {error}", line) from None
    return "".join(out)
