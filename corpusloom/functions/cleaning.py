"""Removal or replacement of e-mails, links, names, hashes, issue references and signatures in lines of messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANKS, SPACE, W, strip

# fixed values: what stands for removed things
TOKENS = {"email": "[EMAIL]", "url": "[URL]", "at_pattern": "[NICKNAME]", "sha": "[COMMIT_ID]", "issue_ref": "[ISSUE_ID]"}
# fixed values: patterns
OPEN, CLOSE = r"[\[\({<]?", r"[\]\)}>]?"
EMAIL = OPEN + r"\w[\w.\-+]*?@[\w.\-]+?\.[\w.\-]+?" + CLOSE
URL = r"https?://[-a-zA-Z0-9@:%._+~#?=/&]+?"
NICK = rf"@[^{W}]+?"
SHA = r"[\dA-Fa-f-]{7,}"
SHA_PREFIXES = ("", "ref:", "I")
DATES = r"\d\d\d\d-\d\d-\d\d|\d\d-\d\d-\d\d\d\d"
ISSUES = tuple(OPEN + p + CLOSE for p in (r"#\d+", r"GH-\d+", r"gh-\d+", r"[A-Z]\w+-\d+"))
SIGNATURES = (
    r"(signed(-| |)off(-| |)by|co(-| |)?authored(-| |)by|also(-| |)by|reviewed?(-| |)(by|on)|former(-| |)commit(-| |)id|git-svn-id|auto-submit|commit-queue)",
    r"(Created by MOE|MOE_MIGRATED_REVID)",
    r"(fbshipit-source-id|Differential Revision|Pulled(-| )by)",
    r"(Change-Id|PiperOrigin-RevId|BAZEL_VERSION_REV_ID)",
    r"(Kubernetes-commit)",
    r"(Revision: r[\d]*|Sandbox task ID|Glycine run ID)",
    r"(\(Merged from|\(cherry(-| |)picked from|tracked(-| |)on)",
)
LINE_SIGNATURES = r"(Bug:|BUG=|FIXES=|R=)"
# fixed values: what may stand after and before a removed thing
AFTER = r"[:,.!?;~]*"
LEAD = rf"[:\-{W}]*"


def _apply(x: Column, pattern: str, token: str) -> Column:
    if token:
        return F.regexp_replace(x, rf"((?:{SPACE}|\A){LEAD}){pattern}({AFTER}(?:{SPACE}|\z))", rf"$1{token}$2")
    x = F.regexp_replace(x, rf"\A{LEAD}{pattern}{AFTER}(?:{SPACE}|\z)", "")
    return F.regexp_replace(x, rf"{SPACE}{LEAD}{pattern}{AFTER}(?={SPACE}|\z)", "")


def emails(x: Column, replace: bool = False) -> Column:
    return _apply(x, EMAIL, TOKENS["email"] if replace else "")


def urls(x: Column, replace: bool = False) -> Column:
    return _apply(x, URL, TOKENS["url"] if replace else "")


def nicks(x: Column, replace: bool = False) -> Column:
    return _apply(x, NICK, TOKENS["at_pattern"] if replace else "")


def _unled(x: Column) -> Column:
    """Without the dashes and colons that removal leaves at the start."""
    return F.when(x.startswith("-") | x.startswith("–") | x.startswith(":"), F.regexp_replace(x, r"\A[\-–:]+", "")).otherwise(x)


#: For each pattern of ISSUES, a test that is true wherever the pattern can match.
ISSUE_SIGNS = (lambda x: x.contains("#"), lambda x: x.contains("GH-"), lambda x: x.contains("gh-"), lambda x: x.contains("-") & x.rlike(r"[A-Z]\w+-\d"))


def issues(x: Column, replace: bool = False) -> Column:
    for pattern in ISSUES:
        x = _apply(x, pattern, TOKENS["issue_ref"] if replace else "")
        if not replace:
            x = F.regexp_replace(x, r"\A[\-–:]+", "")
    return x


def signatures(x: Column) -> Column:
    for pattern in SIGNATURES:
        x = F.regexp_replace(x, rf"(?id)(\A|{SPACE}){pattern}.*?\z", "")
    return F.regexp_replace(x, rf"(?d)\A{LINE_SIGNATURES}.*?\z", "")


#: How each of SIGNATURES begins, far enough to be rare; their first letters are tested before.
SIGNATURE_STARTS = (
    "signed[- ]?off", "co[- ]?authored", "also[- ]?by", "reviewed?[- ]?[bo]", "former[- ]?commit", "git-svn-id", "auto-submit", "commit-queue", "created by moe", "moe_migrated",
    "fbshipit", "differential rev", "pulled[- ]?by", "change-id", "piperorigin", "bazel_version", "kubernetes-c", "revision: r", "sandbox task", "glycine run",
    r"\(merged from", r"\(cherry", "tracked[- ]?on",
)


def _signed(x: Column) -> Column:
    """Whether a line may hold any of the signatures: one pass instead of one for each."""
    starts = F.concat(F.lit(" "), x).rlike(rf"[{BLANKS}](?=[sScCaArRfFgGmMdDpPbBkKtT(])(?i:{'|'.join(SIGNATURE_STARTS)})")
    return starts | reduce(Column.__or__, [x.startswith(s) for s in ("Bug:", "BUG=", "FIXES=", "R=")])


def _hashed(x: Column) -> Column:
    """Whether a line may hold a hash of a commit: what stands before one is a blank, a lead or nothing."""
    return F.concat(F.lit(" "), x).rlike(rf"[{BLANKS}:\-](?:{'|'.join(SHA_PREFIXES[1:])})?[0123456789ABCDEFabcdef-]{{7}}")


def shas(x: Column, replace: bool = False) -> Column:
    out = x
    for prefix in SHA_PREFIXES:
        out = _apply(out, prefix + SHA, TOKENS["sha"] if replace else "")
    return F.when(x.rlike(DATES), x).otherwise(out)


def clean_lines(lines: Column, replace: bool = False) -> Column:
    """An array of lines, each without (or with tokens for) all of the above, stripped.

    One transform a step that uses its input twice; a step's patterns run only on lines where a cheap test says that they can match.
    """

    def step(test, change):
        return F.transform(lines, lambda x: F.when(test(x), change(x)).otherwise(x))

    lines = step(lambda x: x.contains("@"), lambda x: emails(x, replace))
    lines = step(lambda x: x.contains("://"), lambda x: urls(x, replace))
    for pattern, sign in zip(ISSUES, ISSUE_SIGNS):
        lines = step(sign, lambda x, p=pattern: _apply(x, p, TOKENS["issue_ref"] if replace else ""))
        if not replace:
            lines = F.transform(lines, _unled)
    lines = step(_signed, signatures)
    lines = step(lambda x: x.contains("@"), lambda x: nicks(x, replace))
    lines = step(_hashed, lambda x: shas(x, replace))
    return F.transform(lines, strip)
