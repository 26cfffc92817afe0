"""Fixed values of the log-template format.

These are interchange constants: changing one changes what an archive means.
"""

# Placeholder bytes that stand for one variable inside a logtype (fixed values).
INT_KIND = 17
DICT_KIND = 18
DECIMAL_KIND = 19

# Record operations: high nibble of the marker byte (fixed values).
OP_TIMESTAMP = 0x10
OP_LOGTYPE = 0x20
OP_VARIABLE = 0x30
OP_ENCODED64 = 0x40
OP_ENCODED32 = 0x50

# Characters that make up a token; every other character is a delimiter (fixed
# values). They are listed one by one because java.util.regex tests an explicit
# list with one table lookup, but a range with a chain of comparisons.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
HEX_LETTERS = "ABCDEFabcdef"
TOKEN_PUNCTUATION = r"+\-./\\_"

# Raw bytes 0x10..0x13 of a message are written as 0x10 followed by 0x14..0x17,
# so a logtype holds 0x11..0x13 only where a variable was taken out.
ESCAPE = "\x10"
ESCAPED = {"\x10": "\x10\x14", "\x11": "\x10\x15", "\x12": "\x10\x16", "\x13": "\x10\x17"}

# In front of a logtype whose message isn't UTF-8: its text is the bytes, one character each.
RAW_MARK = "\x10\x18"

# Limits of the compact form and of one dictionary entry (fixed values).
COMPACT_MAX_ID = 65535
ENTRY_MAX_BYTES = 65535

ENCODE_MODES = ("int_only", "standard", "compact")
DEDUP_MODES = ("none", "shared", "separate", "marked")

# Log levels from least to most severe (fixed values).
LEVELS = ("ALL", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF")

# Timestamp head of a log line, and the format it is written in (fixed values).
LINE_HEAD = r"[0-9]{2}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
LINE_TIME_FORMAT = "yy/MM/dd HH:mm:ss"
LINE_HEAD_CHARS = 17

ARCHIVE_VERSION = 1
