"""Tokens for keyword search: lower case, runs of letters and digits, longer than a byte, no English or Italian stop word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = sorted(
    set("""
    that della but sono by il this io the una their dello and gli was lo into la is li to un be con for per no dei on anche
    such degli not delle as che if di or da it del these si they su there ha at come with ma will se an ci then le are uno
    of non in a
    """.split())
)
_SPLIT = r"[^\p{L}\p{N}]+"


def runs(text: Column) -> Column:
    """All runs of letters and digits in order, and an empty one at an end without any."""
    return F.split(F.lower(text), _SPLIT)


def tokens(text: Column) -> Column:
    """The kept tokens of a text in order, repeats included."""
    # a list of literals this long becomes a hash set
    return F.filter(runs(text), lambda t: (F.octet_length(t) > 1) & ~t.isin(*STOP_WORDS))
