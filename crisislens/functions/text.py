"""Text Column functions (all JVM-side, codegen'd).

The reference cleans text with Python's Unicode-aware ``re`` and
``unicodedata``.  Java regexes and Spark string functions differ in a few
places (ASCII ``\\w``/``\\s``, no NFKD), so this module spells the Python
semantics out as explicit character classes that behave the same in Java
and in RE2 (the DuckDB oracle).
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\w`` for str patterns: letters, all numerics and underscore.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def _isspace_ranges() -> str:
    """Python's ``\\s`` (``str.isspace``) as explicit code-point ranges.

    Built by rule from the running Python, so it is exact by construction,
    and explicit ranges test faster in Java than a Unicode category."""
    cps = [cp for cp in range(0x110000) if chr(cp).isspace()]
    parts, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
        i = j + 1
    return "".join(parts)


_WS_BODY = _isspace_ranges()
SPACE = f"[{_WS_BODY}]"
NON_SPACE = f"[^{_WS_BODY}]"
NON_BLANK = f"[{_WS_BODY}&&[^ ]]"       # white space but U+0020 (Java class intersection)

_LEFT_BOUND = f"(?:^|{NON_WORD})"
_RIGHT_BOUND = f"(?:{NON_WORD}|$)"


def portable_regex(pattern: str) -> str:
    """Rewrite a Python-style pattern so Java and RE2 search it identically.

    ``\\w``/``\\W``/``\\s``/``\\S`` become explicit Unicode classes.  A ``\\b``
    at the very start or end becomes a consuming boundary group, which is
    equivalent for *search* (contains) use, the only use the engine makes of
    these patterns.  Other ``\\b`` positions are rejected rather than guessed.
    """
    p = pattern
    if p.startswith(r"\b"):
        p = _LEFT_BOUND + p[2:]
    if p.endswith(r"\b") and not p.endswith(r"\\b"):
        p = p[:-2] + _RIGHT_BOUND
    if r"\b" in p.replace(r"\\", ""):
        raise ValueError(f"word boundary inside pattern not supported: {pattern!r}")
    out = []
    i = 0
    while i < len(p):
        if p[i] == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            out.append({"w": WORD, "W": NON_WORD, "s": SPACE, "S": NON_SPACE}.get(nxt, p[i:i + 2]))
            i += 2
        else:
            out.append(p[i])
            i += 1
    return "".join(out)


def alternation(patterns: list[str] | tuple[str, ...], ignore_case: bool = True) -> str:
    """One regex that searches for any of ``patterns`` (each made portable)."""
    body = "|".join(f"(?:{portable_regex(p)})" for p in patterns)
    return ("(?i)" if ignore_case else "") + body


_REGEX_META = set(".^$*+?{}[]\\|()")


def is_literal(pattern: str) -> bool:
    return not any(ch in _REGEX_META for ch in pattern)


def matches_any(text: Column, patterns: list[str] | tuple[str, ...], text_is_lower: bool = False) -> Column:
    """Case-insensitive search for any of ``patterns`` in ``text``.

    Same truth value as ``text.rlike(alternation(patterns))`` but faster:
    on lower-cased text, plain-literal patterns become ``contains`` scans
    (Java's case-insensitive alternation crawls on long texts) and only real
    regexes go to one ``rlike``.  The scans run on the text's bytes: UTF-8 holds
    a text where its bytes hold the other's, and ``contains`` is faster on
    binary values than on strings."""
    lowered = text if text_is_lower else F.lower(text)
    literals = list(dict.fromkeys(p.lower() for p in patterns if is_literal(p) and p.isascii()))
    regexes = [p for p in patterns if not (is_literal(p) and p.isascii())]
    # Under OR, a literal that contains another literal adds nothing.
    literals = [a for a in literals if not any(b != a and b in a for b in literals)]
    out = None
    def bounded_literal(p: str) -> str | None:
        core = p.removeprefix(r"\b").removesuffix(r"\b").lower()
        return core if core and core != p.lower() and is_literal(core) and core.isascii() else None

    raw = lowered.cast("binary")

    def holds(literal: str) -> Column:
        return F.contains(raw, F.lit(literal.encode()))

    terms = [holds(lit) for lit in literals]
    # a literal between word bounds: the regex runs only where the literal occurs
    terms += [holds(bounded_literal(p)) & lowered.rlike(alternation([p])) for p in regexes if bounded_literal(p)]
    rest = [p for p in regexes if not bounded_literal(p)]
    if rest:
        terms.append(lowered.rlike(alternation(rest)))
    for term in terms:
        out = term if out is None else (out | term)
    return out if out is not None else F.lit(False)


# --------------------------------------------------------------------------
# Accent folding (NFKD, then drop combining characters)
# --------------------------------------------------------------------------

@functools.lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(FROM, TO) strings for ``translate`` built from ``unicodedata``.

    Rule: over the Basic Multilingual Plane, every code point whose NFKD form
    minus combining characters is one different character maps to it, and
    every combining character (canonical class != 0) is deleted (it sits at
    the end of FROM with no counterpart in TO).  Expansions to several
    characters (ligatures such as U+FB01) are left to ``exact=True``.
    """
    src, dst, drop = [], [], []
    for cp in range(0x80, 0x10000):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        if unicodedata.combining(ch):
            drop.append(ch)
            continue
        folded = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(folded) == 1 and folded != ch:
            src.append(ch)
            dst.append(folded)
    return "".join(src) + "".join(drop), "".join(dst)


def _folded(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))


HANGUL = (0xAC00, 0xD7A3)                # syllables: their letters follow by rule


@functools.lru_cache(maxsize=1)
def expansions() -> dict[str, str]:
    """What ``translate`` leaves: characters that fold to several, and those beyond the Basic Multilingual Plane.

    Built by rule from ``unicodedata``; Hangul syllables are left out, see :func:`_jamo`.
    """
    plain = set(accent_table()[0])
    points = (cp for cp in range(0x80, 0x110000) if not 0xD800 <= cp <= 0xDFFF and not HANGUL[0] <= cp <= HANGUL[1])
    return {chr(cp): _folded(chr(cp)) for cp in points if chr(cp) not in plain and _folded(chr(cp)) != chr(cp)}


@functools.lru_cache(maxsize=1)
def _expansion_class() -> str:
    """A character class of everything that :func:`expansions` and :func:`_jamo` change."""
    points = sorted([*map(ord, expansions()), *range(HANGUL[0], HANGUL[1] + 1)])
    parts, lo = [], None
    for i, cp in enumerate(points):
        lo = cp if lo is None else lo
        if i + 1 == len(points) or points[i + 1] != cp + 1:
            parts.append(f"\\x{{{lo:X}}}-\\x{{{cp:X}}}")
            lo = None
    return "[" + "".join(parts) + "]"


def _jamo(ch: Column) -> Column:
    """The two or three letters of a Hangul syllable (19 leading, 21 vowels, 27 trailing)."""
    at = F.ascii(ch) - HANGUL[0]
    letter = lambda first, n, i: F.substr(F.lit("".join(chr(first + k) for k in range(n))), (i + 1).cast("int"), F.lit(1))
    tail = at % 28
    return F.concat(letter(0x1100, 19, F.floor(at / 588)), letter(0x1161, 21, F.floor(at % 588 / 28)),
                    F.when(tail > 0, letter(0x11A8, 27, tail - 1)).otherwise(F.lit("")))


def expand(c: Column) -> Column:
    """Replace what folds to several characters; texts without any such character pass by."""
    table = F.from_json(F.lit(json.dumps(expansions())), "map<string,string>")
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(_expansion_class()), F.lit(0)))
    # what comes in holds no character of the class, so the order of replacements does not matter
    whole = F.aggregate(found, c, lambda text, ch: F.replace(text, ch, F.coalesce(F.element_at(table, ch), _jamo(ch))))
    return F.when(F.octet_length(c) == F.length(c), c).when(c.rlike(_expansion_class()), whole).otherwise(c)


def strip_accents(c: Column, exact: bool = False) -> Column:
    """Accent-fold a string Column: NFKD without combining characters.

    Default: one ``translate``.  ``exact=True`` first expands what folds to several
    characters (ligatures, fractions, Hangul) and folds all planes; native as well.
    """
    src, dst = accent_table()
    return F.translate(expand(c) if exact else c, src, dst)


def fold_lower(c: Column, exact: bool = False) -> Column:
    """strip accents, then lower-case (reference order)."""
    return F.lower(strip_accents(c, exact=exact))


def trim_ws(c: Column) -> Column:
    """Strip Unicode whitespace on both ends (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def extract_tokens(c: Column, sigil: str) -> Column:
    """All ``<sigil>\\w+`` tokens of a lower-cased Column, in text order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(re.escape(sigil) + WORD + "+"), 0)
    # most texts hold no sigil: a byte scan spares them the regex
    return F.when(c.isNull(), F.lit(None)).when(F.contains(c, F.lit(sigil)), found).otherwise(F.array().cast("array<string>"))


FINGERPRINT_LOOK = 2             # times the length of a fingerprint that is tried before the whole text


def copy_fingerprint(text: Column, max_chars: int = 220) -> Column:
    """Template fingerprint of a post for copy-paste detection.

    lower -> links become `` URL `` -> mentions `` @user `` -> hashtags
    `` #tag `` -> whitespace runs collapse -> trim -> first ``max_chars``.

    No mask and no run spans a plain space that stands before it, so the template of
    the words up to a space begins the template of the whole text.  When it holds
    ``max_chars`` already it is the answer; else the whole text is worked through.
    """
    at = FINGERPRINT_LOOK * max_chars
    head = F.substring(text, 1, at)
    words = F.left(head, F.length(head) - F.length(F.substring_index(head, " ", -1)))
    # the guard of short texts leaves them one way through
    return F.transform(F.array(F.when(F.length(text) > at, _template(words, max_chars))),
                       lambda x: F.when(F.length(x) >= max_chars, x).otherwise(_template(text, max_chars)))[0]


def _template(text: Column, max_chars: int) -> Column:
    """The first ``max_chars`` of the masked text; see :func:`copy_fingerprint`."""
    def where_found(t: Column, needle: str, pattern: str, mask: str) -> Column:
        # bound to a lambda variable, so the text in front is computed once
        return F.transform(F.array(t), lambda x: F.when(F.contains(x, F.lit(needle)), F.regexp_replace(x, pattern, mask)).otherwise(x))[0]

    t = where_found(F.lower(text), "http", f"https?://{NON_SPACE}+", " URL ")
    t = where_found(t, "@", f"@{WORD}+", " @user ")
    t = where_found(t, "#", f"#{WORD}+", " #tag ")
    # runs that are not one plain space already
    t = F.regexp_replace(t, f"(?: {SPACE}+|{NON_BLANK}{SPACE}*)", " ")
    # every whitespace run is now one U+0020, so Spark's space-only ``trim``
    # is exact here (and references the expression once: no re-evaluation)
    return F.substring(F.trim(t), 1, max_chars)


# FIXED VALUE — what stands behind a shortened text.
SHORTENED = "\n\n...[contenu tronqué pour rester compact]"


def shorten(text: Column, limit: int, suffix: str = SHORTENED) -> Column:
    """Trim, and cut to ``limit`` characters plus a marker when longer."""
    t = trim_ws(F.coalesce(text.cast("string"), F.lit("")))
    cut = F.concat(F.regexp_replace(F.substring(t, 1, limit), f"{SPACE}+$", ""), F.lit(suffix))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def contains_any(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """True when any of ``words`` occurs as a plain substring."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out
