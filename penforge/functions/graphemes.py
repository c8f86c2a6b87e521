"""What a reader takes for one character, in columns.

Two notions: clusters of the Unicode standard, which a regular expression cuts (counting, context, diffs), and the
narrower rule by which a patch is kept from beginning inside a character (continued()).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What goes on with the character before it: marks, joiners and what follows them, skin tones, the
#: second of two flag letters.
_MARK, _JOINER, _FLAG = r"\A[\p{M}\x{200D}\x{1F3FB}-\x{1F3FF}]\z", "‍", r"\A[\x{1F1E6}-\x{1F1FF}]\z"


def _goes_on(before: Column, c: Column) -> Column:
    return c.rlike(_MARK) | (before == _JOINER) | (c.rlike(_FLAG) & before.rlike(_FLAG))


def _going_on(text: Column) -> Column:
    """For each character of a text whether it goes on with the one before it."""
    chars = F.split(text, "")
    return F.zip_with(chars, F.concat(F.array(F.lit("")), F.slice(chars, F.lit(1), F.size(chars) - 1)), lambda c, before: (before != "") & _goes_on(before, c))


def clusters(text: Column) -> Column:
    """Array of the extended grapheme clusters of a text."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def continued(text: Column, at: Column) -> Column:
    """Whether the character after `at` code points goes on with the one before it."""
    inside = (at > 0) & (at < F.char_length(text))
    return inside & _goes_on(F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1)))


def last_whole(text: Column) -> Column:
    """How many code points the last character of a text has, with all that goes on with it."""
    return F.array_position(F.reverse(_going_on(text)), F.lit(False)).cast("int")


def first_whole(text: Column) -> Column:
    """As last_whole, of the first character."""
    on = _going_on(text)
    after = F.array_position(F.slice(on, F.lit(2), F.greatest(F.size(on) - 1, F.lit(0))), F.lit(False)).cast("int")
    return F.when(after > 0, after).otherwise(F.size(on))
