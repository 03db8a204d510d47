"""A token estimate for rendered text: word shapes with fitted weights, as an Arrow UDF."""

import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# The fitted weights.
WORD, WORD_LEN, CAPS_LEN, LEAD, SPACE_OR_DIGITS, PUNCT, PUNCT_LEN, NON_ASCII = 0.89, 0.21, 0.51, 0.44, 1.11, 0.9, 0.83, 0.6

_SHAPE = re.compile(
    rb"(?P<word>(?P<lead>[^A-Za-z0-9\n\r\x80-\xff])?(?P<body>(?:[A-Z]+[a-z]*|[a-z]+)(?:'(?i:s|t|m|d|re|ve|ll))?))"
    rb"|(?P<digits>[0-9]{1,3})"
    rb"|(?P<punct>[ ]?(?:[^A-Za-z0-9 \t\n\r\x0b\x0c])+[\n\r/]*)"
    rb"|(?P<space>[ \t\n\r\x0b\x0c]*[\n\r]|[ \t\x0b\x0c]+(?=[^ \t\n\r\x0b\x0c])|[ \t\x0b\x0c]+)",
)


def estimate(text: str) -> int:
    """Estimated tokens of a text, rounded up."""
    data, total, at = text.encode("utf-8"), 0.0, 0
    while at < len(data):
        m = _SHAPE.match(data, at)
        at = m.end()
        if m["word"] is not None:
            body = m["body"]
            total += WORD
            if len(body) > 1 and re.fullmatch(rb"[A-Z']+", body):
                total += CAPS_LEN * (len(body) - 2)
            else:
                total += WORD_LEN * max(0, len(body) - 6)
            if m["lead"] and m["lead"] != b" ":
                total += LEAD
        elif m["punct"] is not None:
            marks = m["punct"].lstrip(b" ").rstrip(b"\n\r")
            plain = sum(c < 0x80 for c in marks)
            total += (PUNCT + PUNCT_LEN * max(0, plain - 3) if plain else 0) + NON_ASCII * sum(c >= 0xC0 for c in marks)
        elif m["space"] is not None:
            if len(m["space"]) >= 2 and not re.search(rb"[\n\r]", m["space"]) and at < len(data):
                at -= 1  # its last space joins what follows
            total += SPACE_OR_DIGITS
        else:
            total += SPACE_OR_DIGITS
    return math.ceil(total - 1e-9)


@F.pandas_udf(IntegerType())
def estimate_tokens(texts: pd.Series) -> pd.Series:
    """Null is no token."""
    return texts.map(lambda t: estimate(t) if t else 0).astype("int32")
