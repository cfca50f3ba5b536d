"""Text patterns of the message classifiers, as columns of JVM regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of injected content (case-sensitive substrings).
SYSTEM_TAGS = ("<system-reminder>", "<command-name>", "<run_context>", "<environment_details>", "<tool_response>", "<feedback>", "<automated_reminder>")

# Phrases of corrections.
CORRECTIONS = (
    "no,", "no.", "no!", "no ", "that's wrong", "that is wrong", "that's not", "that is not", "not what i", "wrong", "fix ", "fix.", "don't", "do not", "stop", "undo",
    "revert", "instead,", "instead ", "actually,", "actually ", "wait,", "wait ", "hold on", "try again", "not quite", "not right", "should be", "should have",
    "shouldn't", "change that", "go back", "roll back", "i said", "i meant", "i wanted",
)

# Phrases of approvals.
APPROVALS = (
    "yes", "yep", "yeah", "yea", "perfect", "looks good", "lgtm", "approved", "approve", "great", "thanks", "thank you", "good", "nice", "correct", "exactly", "right",
    "ok", "okay", "sure", "go ahead", "proceed", "ship it", "merge", "👍",
)

# Starts of questions.
QUESTION_STARTS = (
    "how", "what", "why", "when", "where", "which", "who", "can you", "could you", "would you", "is there", "are there", "do you", "does it", "will it", "should i", "should we",
)

# Words of risk.
RISK_TOKENS = (
    "risk", "concern", "worry", "problem", "issue", "error", "fail", "wrong", "careful", "uncertain", "maybe", "might", "however", "but", "although", "caveat", "warning",
    "danger", "tricky", "edge case", "caution", "potential", "possibly", "unclear", "unsafe", "malicious", "exploit", "untrusted", "vulnerability", "flaw", "security",
    "leak", "sensitive", "confidential", "hazard", "threat", "harm", "insecure", "peril", "jeopardy", "suspicious", "unauthorized", "leakage", "password", "secret",
    "token", "credential", "apikey", "key", "access", "auth",
)

# Keywords of epistemic codes.
CODE_KEYWORDS = {
    "PROBLEM_FRAMING": ("problem", "issue", "error", "bug", "fail", "failed", "broken", "unexpected"),
    "HYPOTHESIS": ("maybe", "perhaps", "might", "could be", "suspect", "likely", "i think", "i believe"),
    "EVIDENCE_SEEK": ("read", "check", "look", "inspect", "verify", "confirm", "examine"),
    "SELF_CORRECT": ("wait", "actually", "sorry", "mistake", "revert", "undo", "let me"),
    "PLAN": ("plan", "step", "first", "next", "then", "finally", "approach", "strategy"),
    "RESULT_INTERP": ("found", "shows", "indicates", "means", "suggests", "confirms", "because"),
}
CODES = ("PROBLEM_FRAMING", "HYPOTHESIS", "EVIDENCE_SEEK", "TOOL_USE", "SELF_CORRECT", "PLAN", "RESULT_INTERP")

# Patterns of user signals, on lower-cased text.
SIGNALS = {
    "correction": (
        r"\bno[,]?\s", r"^no$", r"\bwrong\b", r"\bnot that\b", r"\binstead\b", r"\bactually[,]?\s", r"\bi said\b", r"\bi meant\b", r"\bnope\b", r"\bundo\b",
        r"\brevert\b", r"\btry again\b", r"\bincorrect\b",
    ),
    "redirect": (r"^stop\b", r"^wait\b", r"\bhold on\b", r"^let's\b", r"\bforget\b", r"\bskip\b", r"\bignore\b", r"\bnever\s?mind\b", r"\bnvm\b"),
    "directive": (r"^(make|create|add|remove|delete|write|implement|build|run|fix|update|change|refactor|rename|move|test|check|verify|show|explain|list)\b",),
    "approval": (r"^(good|great|perfect|excellent|nice|yes|yep|yeah|ok|okay|sure|thanks|thank you)\b", r"\blooks good\b", r"\blgtm\b", r"\bwell done\b"),
    "question": (r"\?\s*$", r"^(what|how|why|when|where|which|who|can you|could you|would you|should)\b"),
}
FRUSTRATION = (
    (1, (r"\bhmm\b", r"\bsigh\b", r"\bugh\b", r"\bmeh\b")),
    (2, (r"\bno\b", r"\bnope\b", r"\bwrong\b", r"\bstop\b")),
    (3, (r"\bi said\b", r"\bstill wrong\b", r"\blisten\b")),
    (4, (r"\bwhy did you\b", r"\bwhy are you\b", r"\bfor the (last|nth) time\b")),
)

# Patterns of references between projects, most specific first.
REFERENCE_TYPES = (
    ("implementation", r"look at how|same pattern|like .* does|based on"),
    ("context_import", r"claude\.md|readme|config|\.claude/"),
    ("knowledge_sharing", r"learned from|solution in|already solved"),
    ("cross_project_action", r"\bpush\b|\bcommit\b|\bdeploy\b|\bpr\b|\bmerge\b"),
)

LEXICAL_BYTES = 1000
EDGE = "[^a-z0-9]"


def _alnum_end(phrase: str) -> bool:
    return re.fullmatch("[A-Za-z0-9]", phrase[-1]) is not None


def bounded(phrases, look: bool = True) -> str:
    """One expression for phrases that no ASCII letter or digit may adjoin.

    Phrases that end in something else are exempt from the trailing test.  With
    ``look`` the tests are look-arounds; without, they consume a character, for
    engines that have none.
    """
    before, after = ("(?<![a-z0-9])", "(?![a-z0-9])") if look else (f"(^|{EDGE})", f"({EDGE}|$)")
    quoted = lambda some: "|".join(re.escape(p).replace("\\ ", " ").replace("\\'", "'") for p in some)
    open_, closed = [p for p in phrases if not _alnum_end(p)], [p for p in phrases if _alnum_end(p)]
    parts = ([f"{before}({quoted(closed)}){after}"] if closed else []) + ([f"{before}({quoted(open_)})"] if open_ else [])
    return "|".join(parts)


def starts(phrases) -> str:
    return "^(" + "|".join(map(re.escape, phrases)).replace("\\ ", " ") + ")"


def any_of(column: Column, patterns) -> Column:
    """Whether some pattern matches; those that start at a word's edge or the text's start share that test."""
    edge, first = r"\b", "^"
    groups = {edge: [p[2:] for p in patterns if p.startswith(edge)], first: [p[1:] for p in patterns if p.startswith(first)]}
    rest = [p for p in patterns if not p.startswith((edge, first))]
    return column.rlike("|".join([*(f"{k}(?:{'|'.join(f'(?:{p})' for p in v)})" for k, v in groups.items() if v), *(f"(?:{p})" for p in rest)]))


def has_word(column: Column, phrase: str) -> Column:
    return column.rlike(r"(?i)\b" + re.escape(phrase).replace("\\ ", " ") + r"\b")


WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(column: Column) -> Column:
    return F.trim(column, F.lit(WHITE))


def without_boilerplate(column: Column, strip: bool = True) -> Column:
    out = F.regexp_replace(column, r"(?s)<system-reminder>.*?</system-reminder>", "")
    out = F.regexp_replace(out, r"(?s)<command-name>.*?</command-name>", "")
    out = F.replace(out, F.lit("[Request interrupted]"), F.lit(""))
    return trimmed(out) if strip else out


def mostly_ascii(column: Column, share: float = 0.85) -> Column:
    """Share of ASCII letters among what is not white space; empty counts as English."""
    dense = F.length(F.regexp_replace(column, r"\s+", ""))
    return (dense == 0) | (F.length(F.regexp_replace(column, "[^A-Za-z]+", "")) >= share * dense)


def frustration(column: Column) -> Column:
    """Score from 0 to 5."""
    low = F.lower(column)
    score = sum((F.when(any_of(low, p), n).otherwise(0) for n, p in FRUSTRATION), F.lit(0))
    letters = F.length(F.regexp_replace(column, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(column, r"\P{Lu}+", ""))
    loud = (F.length(column) > 20) & (letters > 0) & (2 * upper >= letters)
    return F.least(F.lit(5), score + F.when(loud, 1).otherwise(0))


def redacted(column: Column) -> Column:
    return F.concat(F.lit("project_"), F.substring(F.sha2(column, 256), 1, 8))


TOOL_CATEGORIES = (("read", "read|glob|grep"), ("edit", "edit|write"), ("bash", "bash"), ("search", "websearch|webfetch"), ("skill", "skill"))


def tool_category(name: Column) -> Column:
    """First category whose substring the lower-cased name has, else ``other``."""
    low = F.lower(name)
    out = F
    for category, pattern in TOOL_CATEGORIES:
        out = out.when(low.rlike(pattern), category)
    return out.otherwise("other")
