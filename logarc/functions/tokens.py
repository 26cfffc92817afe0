"""Tokenizing and classifying: which parts of a message are variables.

One regular-expression pass marks every variable in the text, by its kind, so a
message is scanned a fixed number of times however many variables it holds.
Lambdas only ever see one array element: a computed array is handed over as an
argument and never named inside a lambda, because an inlined array would be
computed again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    DECIMAL_KIND,
    DICT_KIND,
    DIGITS,
    ENCODE_MODES,
    ESCAPED,
    HEX_LETTERS,
    INT_KIND,
    LETTERS,
    RAW_MARK,
    TOKEN_PUNCTUATION,
)
from .numbers import (
    DECIMAL32,
    DECIMAL64,
    encode_decimal32,
    encode_decimal64,
    encode_int32,
    encode_int64,
    pack_decimal32,
    pack_decimal64,
)

_TOKEN = TOKEN_PUNCTUATION + LETTERS + DIGITS
_NOT_DIGIT = TOKEN_PUNCTUATION + LETTERS

TOKEN_REGEX = f"[{_TOKEN}]++"
DELIMITED_TOKEN_REGEX = f"([^{_TOKEN}])([{_TOKEN}]++)"
_HAS_DIGIT = f"[{_NOT_DIGIT}]*+[{DIGITS}][{_TOKEN}]*+"
_HEX_WORD = f"[{HEX_LETTERS}]{{2,}}+(?![{_TOKEN}])"
_AFTER_EQUALS = f"(?<==)[{TOKEN_PUNCTUATION}]*+[{LETTERS}][{_TOKEN}]*+"

# A variable together with the one delimiter in front of it. Starting on the
# delimiter makes the matcher drop every character inside a word with a single
# table lookup; the text gets one delimiter put in front so this always holds.
_VARIABLE = f"{_HAS_DIGIT}|{_HEX_WORD}|{_AFTER_EQUALS}"
VARIABLE_REGEX = f"([^{_TOKEN}])({_VARIABLE})"

_INT, _DICT, _DECIMAL = chr(INT_KIND), chr(DICT_KIND), chr(DECIMAL_KIND)
_MARKS = _INT + _DICT + _DECIMAL


def tokenize(text: Column) -> Column:
    """All tokens of a message, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_REGEX), F.lit(0))


def is_hex_token(token: Column) -> Column:
    """At least two characters, all of them hexadecimal digits."""
    return token.rlike(r"\A[0-9a-fA-F]{2,}\z")


def is_variable_token(token: Column, previous_char: Column) -> Column:
    """Whether a token is a variable, given the character in front of it."""
    return (
        token.rlike("[0-9]")
        | (F.coalesce(previous_char == "=", F.lit(False)) & token.rlike("[A-Za-z]"))
        | is_hex_token(token)
    )


def escape(text: Column) -> Column:
    """Write the raw bytes 0x10..0x13 so they cannot be taken for placeholders."""
    escaped = text
    for raw, code in ESCAPED.items():
        escaped = F.replace(escaped, F.lit(raw), F.lit(code))
    return F.when(text.rlike("[\x10-\x13]"), escaped).otherwise(text)


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`; the escape byte itself is put back last."""
    plain = text
    for raw, code in reversed(list(ESCAPED.items())):
        plain = F.replace(plain, F.lit(code), F.lit(raw))
    return F.when(text.contains("\x10"), plain).otherwise(text)


def as_text(message: Column) -> Column:
    """Message text with the raw bytes of variables' places escaped.

    A message that isn't UTF-8 is taken as its bytes, one character each, behind
    ``RAW_MARK``; tokens are ASCII, so they are the same either way.
    """
    text = message.cast("string")
    view = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.when(F.is_valid_utf8(text), escape(text)).otherwise(F.concat(F.lit(RAW_MARK), escape(view)))


def as_message(text: Column, raw: Column) -> Column:
    """Inverse of :func:`as_text` once the mark is taken off; ``raw`` says whether there was one."""
    return F.when(raw, F.encode(text, "ISO-8859-1").cast("string")).otherwise(text)


def variables(text: Column) -> Column:
    """The variable tokens of a message, in order."""
    return F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(VARIABLE_REGEX), F.lit(2))


def classify_variable(token: Column, mode: str = "standard") -> Column:
    """Kind of a variable: 17 integer, 19 decimal, 18 dictionary."""
    number, decimal = _encoders(mode)
    kind = F.when(number(token).isNotNull(), F.lit(INT_KIND))
    if decimal is not None:
        kind = kind.when(decimal(token).isNotNull(), F.lit(DECIMAL_KIND))
    return F.when(token.isNotNull(), kind.otherwise(F.lit(DICT_KIND))).cast("tinyint")


def _encoders(mode: str):
    if mode not in ENCODE_MODES:
        raise ValueError(f"mode must be one of {ENCODE_MODES}, not {mode!r}")
    return {
        "int_only": (encode_int64, None),
        "standard": (encode_int64, encode_decimal64),
        "compact": (encode_int32, encode_decimal32),
    }[mode]


def _at_most(limit: int, first: int = 0, gap: str = "") -> str:
    """Pattern of the numbers of as many digits as ``limit`` that are not above it; ``gap`` may stand before each digit."""
    digits = [f"{gap}{d}" for d in str(limit)]
    rest = [f"(?:{gap}[0-9]){{{len(digits) - 1 - i}}}" for i in range(len(digits))]
    below = [
        "".join(digits[:i]) + f"{gap}[{low}-{int(d) - 1}]" + rest[i]
        for i, d in enumerate(str(limit))
        if (low := 0 if i else first) < int(d)
    ]
    return "|".join([*below, "".join(digits)])


def _int_regex(bits: int) -> str:
    """Integer tokens without plus sign and zero padding that fit in so many bits; no ``-0``."""
    most = (1 << (bits - 1)) - 1
    return f"(?:0|-?[1-9][0-9]{{0,{len(str(most)) - 2}}}|-?(?:{_at_most(most, first=1)})|-{most + 1})(?![{_TOKEN}])"


def _decimal_regex(layout: dict) -> str:
    """Decimal tokens with digits behind the one point, as many in all as the layout holds."""
    most, limit = layout["max_digits"], layout["digit_limit"]
    point = rf"[0-9]*+\.[0-9]++(?![{_TOKEN}])"
    if limit is None:
        return rf"-?(?=[0-9.]{{2,{most + 1}}}(?![{_TOKEN}])){point}"
    within = _at_most(limit - 1, gap=r"\.?")
    return rf"-?(?={point})(?:[0-9.]{{2,{most}}}|{within})(?![{_TOKEN}])"


_NEVER = "(?!)"
_INTEGERS = {"int_only": _int_regex(64), "standard": _int_regex(64), "compact": _int_regex(32)}
_DECIMALS = {"int_only": _NEVER, "standard": _decimal_regex(DECIMAL64), "compact": _decimal_regex(DECIMAL32)}
# Fields of a variable in a marked message: number, decimal, entry. Marks of empty fields stand together, so
# what is in front of a variable tells its kind. In a message 0x10 is only followed by 0x14 to 0x18, so _END is not in it.
_AS_INT, _AS_DECIMAL, _AS_ENTRY, _END = _INT, _INT + _DECIMAL, _INT + _DECIMAL + _DICT, "\x10e"


def marked_message(text: Column, mode: str = "standard") -> Column:
    """The message after one line break, each variable in that one of three marked fields that is its kind's."""
    if mode not in ENCODE_MODES:
        raise ValueError(f"mode must be one of {ENCODE_MODES}, not {mode!r}")
    regex = f"([^{_TOKEN}])(?:({_INTEGERS[mode]})|({_DECIMALS[mode]})|({_VARIABLE}))"
    return F.regexp_replace(F.concat(F.lit("\n"), as_text(text)), regex, f"$1{_INT}$2{_DECIMAL}$3{_DICT}$4{_END}")


def marked_logtype(marked: Column) -> Column:
    """Template text of :func:`marked_message`."""
    constant = rf"(?:\A\n|[{_MARKS}]*+{_END})([^{_MARKS}]*+[{_MARKS}]*+)"
    template = F.array_join(F.regexp_extract_all(marked, F.lit(constant), F.lit(1)), "")
    return F.replace(F.replace(template, F.lit(_AS_ENTRY), F.lit(_DICT)), F.lit(_AS_DECIMAL), F.lit(_DECIMAL))


def marked_variables(marked: Column, mode: str = "standard") -> Column:
    """``ARRAY<STRUCT<kind, text, enc>>`` of :func:`marked_message`."""
    pack = pack_decimal32 if mode == "compact" else pack_decimal64

    def variable(piece: Column) -> Column:
        def of(kind: int, marks: str, enc: Callable[[Column], Column]) -> Column:
            text = F.substr(piece, F.lit(len(marks) + 1))
            return F.struct(F.lit(kind).cast("tinyint").alias("kind"), text.alias("text"), enc(text).alias("enc"))

        entry = of(DICT_KIND, _AS_ENTRY, lambda text: F.lit(None).cast("bigint"))
        return (
            F.when(piece.startswith(_AS_ENTRY), entry)
            .when(piece.startswith(_AS_DECIMAL), of(DECIMAL_KIND, _AS_DECIMAL, pack))
            .otherwise(of(INT_KIND, _AS_INT, lambda text: text.cast("bigint")))
        )

    return F.transform(F.regexp_extract_all(marked, F.lit(f"[{_MARKS}]++[{_TOKEN}]++"), F.lit(0)), variable)


def logtype(text: Column, mode: str = "standard") -> Column:
    """Template of a message: constant text with one placeholder per variable."""
    return marked_logtype(marked_message(text, mode))
