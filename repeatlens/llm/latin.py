"""A fast splitter for Latin text: the properties in a pattern spelled out as ranges."""

from __future__ import annotations

import re
import unicodedata

LAST = 0x17F
# Capital I with a dot is the one letter of these whose lower case is two characters.
OTHER = re.compile("[^\\x00-įı-ſ]")


def _ranges(test) -> str:
    found, out = [c for c in range(LAST + 1) if test(chr(c))], ""
    while found:
        run = 1
        while run < len(found) and found[run] == found[0] + run:
            run += 1
        out += f"\\u{found[0]:04x}-\\u{found[run - 1]:04x}"
        found = found[run:]
    return out


LETTERS = _ranges(lambda c: unicodedata.category(c)[0] == "L")
NUMBERS = _ranges(lambda c: unicodedata.category(c)[0] == "N")
SPACES = r"\t-\r \x85\xa0"  # fixed value: white space among these characters


def is_latin(text: str) -> bool:
    return text.isascii() or OTHER.search(text) is None


def spelled(pattern: str) -> re.Pattern:
    """``pattern`` for Latin text: \\p{L}, \\p{N} and \\s as ranges, in or out of brackets."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        for name, ranges in (("\\p{L}", LETTERS), ("\\p{N}", NUMBERS), ("\\s", SPACES), ("\\S", "^" + SPACES)):
            if pattern.startswith(name, at):
                out += ranges if inside else f"[{ranges}]"
                at += len(name)
                break
        else:
            c = pattern[at]
            inside = c == "[" or (inside and c != "]")
            out += c
            at += 1
    return re.compile(out)
