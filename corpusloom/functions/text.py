"""Text functions as Column expressions, with Python's idea of white space and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\t-\r\x1c-\x20"  # white space of ASCII texts, for use in a class
SPACE = rf"[{W}]"
UNISPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]"


BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def n_tokens(x: Column) -> Column:
    """Number of white-space separated tokens; null for null. Visible ASCII is tested first, as the whole class is slow."""
    return F.regexp_count(x, F.lit(rf"[!-~[^{UNISPACE}]]+"))


def one_token(x: Column) -> Column:
    """Whether there is just one token; reads no further than the second."""
    return x.rlike(rf"\A[{UNISPACE}]*+[!-~[^{UNISPACE}]]++[{UNISPACE}]*+\z")


def n_wordpunct(x: Column) -> Column:
    """Number of runs of word characters and runs of other non-space characters."""
    return F.regexp_count(x, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_{UNISPACE}]+"))


def is_ascii(x: Column) -> Column:
    return x.rlike(r"\A\p{ASCII}*\z")


def one_sentence(x: Column) -> Column:
    """Whether a text holds no line end."""
    return ~x.contains("\n")


def one_sentence_punct(x: Column) -> Column:
    """A native approximation of sentence counting: no sentence end with a capital after it. Null for empty texts."""
    return F.when(strip(x) != "", ~x.rlike(rf"[.!?]['\")\]]*{SPACE}+['\"(\[]*[A-Z]"))


def no_longer_than(x: Column, n: int) -> Column:
    return n_wordpunct(x) <= n


def no_shorter_than(x: Column, n: int) -> Column:
    return n_wordpunct(x) >= n
