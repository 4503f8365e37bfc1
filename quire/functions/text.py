"""Text rules as columns: patterns, tokens, scripts, normal forms, edit distances."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Patterns that decide results.
LIST_MARKER = r"^\s*(?:[-•●▪◦*]|\(?[0-9٠-٩]+[.)-]|[أ-ي][.)-])\s+"
TERMINAL = r"[.!?؟؛:]\s*$"
NUMBERED = r"^\s*[0-9٠-٩]+(?:\s*[-.):]|\s+)"
ENGLISH = r"[A-Za-z]+(?:[A-Za-z0-9./%+-]*[A-Za-z0-9])?"
DIGITS = r"[0-9٠-٩]+(?:[.,٫٬][0-9٠-٩]+)?"
UNITS = r"(?i)(?:m/s|km|kg|mg|cm|mm|°C|Hz|Pa)(?![\p{L}\p{N}_])"
BULLETS = ["- ", "• ", "● ", "▪ ", "◦ ", "* "]
#: Any character from A to z, which takes in the signs between the cases.
ENGLISH_PAGE = r"[A-z]"


def nfc(text: Column) -> Column:
    """Canonical composition; ASCII text is its own."""

    @pandas_udf("string")
    def composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(composed(text))


def tokens(text: Column) -> Column:
    """The words between white space of any script."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def refined_type(kind: Column, text: Column, confidence: Column, lines: Column) -> Column:
    """A block's type after its text has been looked at: questions, bullets, and lone short lines become headings."""
    t = F.trim(text)
    plain = kind.isin("UNKNOWN", "BODY_PARAGRAPH")
    question = t.startswith("س:") | t.startswith("سؤال") | t.startswith("؟") | t.endswith("؟")
    bullet = F.lit(False)
    for b in BULLETS:
        bullet = bullet | t.startswith(b)
    return (
        F.when(plain & question, "QUESTION")
        .when(plain & bullet, "BULLET_LIST")
        .when(plain & (F.length(t) <= 260) & t.rlike(NUMBERED), "QUESTION")
        .when(kind != "UNKNOWN", kind)
        .when((F.length(t) <= 80) & (confidence >= 0.7) & (lines == 1), "HEADING_3")
        .otherwise("UNKNOWN")
    )


def protected_reasons(text: Column, kind: Column) -> Column:
    """Sorted reasons why a text must not be corrected without a human."""
    reason = lambda c, name: F.when(c, F.lit(name))
    return F.array_sort(
        F.array_compact(
            F.array(
                reason(text.rlike("[A-Za-z]"), "English terms"),
                reason(text.rlike("[0-9٠-٩]"), "numbers or dates"),
                reason(text.rlike("%|٪"), "percentages"),
                reason(text.rlike(UNITS), "units or scientific terminology"),
                reason(kind.isin("QUESTION", "ANSWER_OPTION"), "question numbers or answer choices"),
                reason(kind == "EQUATION_IMAGE", "equations"),
            )
        )
    )


def script_of(character: str) -> tuple[str, str]:
    """Script and direction of a character; Arabic comes first, so that its digits are Arabic."""
    code = ord(character)
    if any(a <= code <= b for a, b in ((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))):
        return "ARABIC", "RTL"
    if "LATIN" in unicodedata.name(character, ""):
        return "LATIN", "LTR"
    return ("DIGIT", "LTR") if character.isdigit() else ("NEUTRAL", "NEUTRAL")


class _Scripts(dict):
    """A letter for the script of each code point that was met."""

    def __missing__(self, code: int) -> str:
        self[code] = found = _LETTERS[script_of(chr(code))[0]]
        return found


_LETTERS = {"ARABIC": "A", "LATIN": "L", "DIGIT": "D", "NEUTRAL": "N"}
_DIRECTIONS = {"A": ("ARABIC", "RTL"), "L": ("LATIN", "LTR"), "D": ("DIGIT", "LTR"), "N": ("NEUTRAL", "NEUTRAL")}
_scripts = _Scripts()
_run = re.compile("N*(?:(A)[AN]*|(L)[LN]*|(D)[DN]*)|N+")


def segment(text: str | None) -> list[dict]:
    """Runs of one script; neutral characters belong to the run before them, leading ones to the first run."""
    text = text or ""
    runs = ((m, _DIRECTIONS[m[m.lastindex] if m.lastindex else "N"]) for m in _run.finditer(text.translate(_scripts)))
    return [{"text": text[m.start() : m.end()], "script": script, "direction": direction} for m, (script, direction) in runs]


def script_runs(text: Column) -> Column:
    """array<struct<text, script, direction>>, exact by Unicode names."""

    @pandas_udf("array<struct<text:string,script:string,direction:string>>")
    def runs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(segment)

    return runs(text)
