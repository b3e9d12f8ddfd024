"""Emoji -> ``:short_name:`` text.

The ``emoji`` package is not available; names come from ``unicodedata`` (lower
case, spaces -> underscores), with the short names that differ from them in a
fixed table, and a rule for skin tones. Only characters with the Unicode Emoji
property count (so a check mark such as U+2713 stays), and variation selectors and
joiners are dropped inside an emoji sequence only. Deviations: a joined sequence
(a family) gives one name per member, and a flag gives its two regional letters.
Texts never leave the JVM, only the emoji found in them.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Code points and ranges with the Unicode Emoji property (digits, # and * aside).
EMOJI_RANGES = (
    "00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 "
    "25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 "
    "2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB "
    "26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 "
    "2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 "
    "27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F "
    "1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 "
    "1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 "
    "1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 "
    "1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 "
    "1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 "
    "1FA90-1FABD 1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8 1FAF0-1FAF8").split()

# Short names that are not the character's Unicode name.
SHORT_NAMES = {
    "\u2764": "red_heart", "\U0001F44D": "thumbs_up", "\U0001F44E": "thumbs_down", "\U0001F64F": "folded_hands",
    "\U0001F60D": "smiling_face_with_heart-eyes", "\U0001F618": "face_blowing_a_kiss", "\U0001F62D": "loudly_crying_face",
    "\U0001F602": "face_with_tears_of_joy", "\U0001F914": "thinking_face", "\U0001F60A": "smiling_face_with_smiling_eyes",
    "\U0001F609": "winking_face", "\U0001F44C": "OK_hand", "\U0001F44F": "clapping_hands", "\U0001F64C": "raising_hands",
    "\U0001F4AF": "hundred_points", "\U0001F622": "crying_face", "\U0001F60E": "smiling_face_with_sunglasses",
    "\U0001F601": "beaming_face_with_smiling_eyes", "\U0001F605": "grinning_face_with_sweat",
    "\U0001F606": "grinning_squinting_face", "\U0001F603": "grinning_face_with_big_eyes",
    "\U0001F604": "grinning_face_with_smiling_eyes", "\U0001F621": "enraged_face", "\U0001F620": "angry_face",
    "\U0001F631": "face_screaming_in_fear", "\U0001F494": "broken_heart", "\u263A": "smiling_face", "\u2639": "frowning_face",
    "\U0001F499": "blue_heart", "\U0001F49C": "purple_heart", "\U0001F49A": "green_heart", "\U0001F49B": "yellow_heart",
    "\u2728": "sparkles", "\u2B50": "star", "\u2705": "check_mark_button", "\u2714": "check_mark", "\u274C": "cross_mark",
}
# The five skin tones.
TONES = ["light", "medium-light", "medium", "medium-dark", "dark"]

_CLASS = "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in EMOJI_RANGES) + "]"
_TONE = "[\U0001F3FB-\U0001F3FF]"
_RE = re.compile(f"({_CLASS})\uFE0F?({_TONE})?\uFE0F?(?:\u200D(?={_CLASS}))?")
# the leading look-ahead passes plain characters without trying every range
_JVM_CLASS = r"(?=[^\x{0}-\x{A8}])[" + "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in EMOJI_RANGES) + "]"
_JVM_SEQUENCE = _JVM_CLASS + r"\x{FE0F}?[\x{1F3FB}-\x{1F3FF}]?\x{FE0F}?(?:\x{200D}(?=" + _JVM_CLASS + "))?"


def _name(m: re.Match) -> str:
    ch = m.group(1)
    name = SHORT_NAMES.get(ch)
    if name is None:
        try:
            name = unicodedata.name(ch).lower().replace(" ", "_")
        except ValueError:
            return m.group(0)
    tone = f"_{TONES[ord(m.group(2)) - 0x1F3FB]}_skin_tone" if m.group(2) else ""
    return f":{name}{tone}:"


def demojize_text(s):
    if not isinstance(s, str):
        return s
    return _RE.sub(_name, s)


def _sequence_name(s: str) -> str:
    """The name of one found sequence; a trailing joiner belongs to it, and stays with a character that has no name."""
    m = _RE.match(s)
    name = _name(m)
    return s if name == m.group(0) else name


@F.pandas_udf(ArrayType(StringType()))
def _names(found: pd.Series) -> pd.Series:
    return found.map(lambda x: None if x is None else [_sequence_name(s) for s in x])


def demojize(text) -> Column:
    """P4 on a column. Only the emoji found go to Python, never the texts around them; texts without one are passed on as
    they are."""
    c = F.col(text) if isinstance(text, str) else text
    have = c.rlike(_JVM_CLASS)
    names = _names(F.when(have, F.regexp_extract_all(c, F.lit(_JVM_SEQUENCE), F.lit(0))))
    parts = F.zip_with(F.split(c, _JVM_SEQUENCE, -1), names, lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    return F.when(have, F.array_join(parts, "")).otherwise(c)
