"""A character-by-character reading of the format, for checks on small inputs."""

from __future__ import annotations

import re

TOKEN = set("+-./0123456789\\_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
ESCAPES = {0x10: "\x10\x14", 0x11: "\x10\x15", 0x12: "\x10\x16", 0x13: "\x10\x17"}


def kind_of(token: str, mode: str = "standard") -> int:
    low, high = (-(2**31), 2**31 - 1) if mode == "compact" else (-(2**63), 2**63 - 1)
    if re.fullmatch(r"0|-?[1-9][0-9]*", token) and low <= int(token) <= high:
        return 17
    digits = token.replace("-", "").replace(".", "")
    if mode != "int_only" and re.fullmatch(r"-?[0-9]*\.[0-9]+", token):
        if mode == "standard" and len(digits) <= 16:
            return 19
        if mode == "compact" and len(digits) <= 8 and int(digits) < 2**25:
            return 19
    return 18


def encode(text: str, mode: str = "standard") -> tuple[str, list[tuple[int, str]]]:
    template, found, i = [], [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in TOKEN:
            j += 1
        if j == i:
            template.append(ESCAPES.get(ord(text[i]), text[i]))
            i += 1
            continue
        token = text[i:j]
        after_equals = i > 0 and text[i - 1] == "="
        if (
            re.search("[0-9]", token)
            or (after_equals and re.search("[A-Za-z]", token))
            or re.fullmatch("[0-9a-fA-F]{2,}", token)
        ):
            kind = kind_of(token, mode)
            template.append(chr(kind))
            found.append((kind, token))
        else:
            template.append(token)
        i = j
    return "".join(template), found
