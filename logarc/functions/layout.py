"""Log layouts: the pattern a message line is printed with."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion words and the event column each one prints (fixed values).
CONVERSIONS = {
    "d": "ts", "date": "ts",
    "p": "level", "level": "level",
    "m": "msg", "msg": "msg", "message": "msg",
    "t": "thread", "thread": "thread", "tn": "thread", "threadName": "thread",
    "c": "logger", "logger": "logger",
}
DEFAULT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"

_CONVERSION = re.compile(r"%(?P<left>-)?(?P<least>\d+)?(?:\.(?P<most>\d+))?(?P<word>[A-Za-z]+|%)(?:\{(?P<option>[^}]*)\})?")
_TIME = re.compile(r"%d\{([^}]+)\}")


def strip_layout_timestamp(pattern: str) -> tuple[str, str]:
    """``(time format, pattern without the time)`` of a layout pattern."""
    found = list(_TIME.finditer(pattern))
    if not found:
        raise ValueError("the layout pattern must have a %d{...} timestamp")
    time = found[-1]
    return time.group(1), pattern[: time.start()] + pattern[time.end():]


def render_layout(pattern: str, line_end: str = "\n") -> Column:
    """The text of an event in a layout such as ``%-5level - %msg%n``."""
    pieces: list[Column] = []
    at = 0
    for found in _CONVERSION.finditer(pattern):
        if found.start() > at:
            pieces.append(F.lit(pattern[at:found.start()]))
        pieces.append(_converted(found, line_end))
        at = found.end()
    if at < len(pattern):
        pieces.append(F.lit(pattern[at:]))
    return F.concat(*pieces) if pieces else F.lit("")


def _converted(found: re.Match, line_end: str) -> Column:
    word = found["word"]
    if word == "%":
        return F.lit("%")
    if word == "n":
        return F.lit(line_end)
    if word not in CONVERSIONS:
        raise ValueError(f"layout conversion %{word} is not supported")
    text = F.col(CONVERSIONS[word]).cast("string")
    if CONVERSIONS[word] == "ts":
        text = F.date_format("ts", found["option"] or DEFAULT_TIME_FORMAT)
    if found["most"]:
        text = F.right(text, F.lit(int(found["most"])))
    if found["least"]:
        least = int(found["least"])
        pad = F.rpad if found["left"] else F.lpad
        text = F.when(F.length(text) < least, pad(text, least, " ")).otherwise(text)
    return text
