"""Date formats: strptime directives as Java patterns, and the form of a written date."""

from __future__ import annotations

import re

from loomwright.errors import EngineError

DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a",
    "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "z", "%": "%",
}


def java_pattern(text: str) -> str:
    out, at = "", 0
    while at < len(text):
        c = text[at]
        if c == "%":
            at += 1
            if at == len(text) or text[at] not in DIRECTIVES:
                raise EngineError(f"unknown date directive in {text!r}")
            out += DIRECTIVES[text[at]]
        elif c.isalpha():
            out += f"'{c}'"
        elif c == "'":
            out += "''"
        else:
            out += c
        at += 1
    return out


FORMS = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}", "yyyy-MM-dd HH:mm"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
    (r"\d{4}\d{2}\d{2}", "yyyyMMdd"),
    (r"\d{2}-[A-Za-z]{3}-\d{4}", "dd-MMM-yyyy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
)


class parse:  # noqa: N801
    @staticmethod
    def pattern_of(value: str) -> str | None:
        """The Java pattern of a written date; month before day unless the first part passes 12."""
        for form, pattern in FORMS:
            if re.fullmatch(form, value):
                return pattern
        if m := re.fullmatch(r"(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})", value):
            year = "yyyy" if len(m[4]) == 4 else "yy"
            day_first = int(m[1]) > 12 or m[2] == "."
            return f"d{m[2]}M{m[2]}{year}" if day_first else f"M{m[2]}d{m[2]}{year}"
        return None
