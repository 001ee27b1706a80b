"""Column functions about definitions: what a question wants defined, whether a text defines it, and the clean definition
within a damaged sentence."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from granary.functions import matching as M, rules, text as X

#: What may stand between a subject and its definition.
CONSTRUCTIONS = r"\s+(?:is\s+(?:a|an|the)|refers\s+to|means|denotes|is\s+defined\s+as|is\s+known\s+as|is\s+called)\b"
# Numbered parts that a question may name, and sentences that are their headings.
NUMBERED = r"\b(?:article|section|chapter|part|clause|rule|act|amendment)\s+\d+[a-z]?\b|\b\d+[a-z]?\s+(?:article|section|chapter|part|clause|rule)\b"
NUMBERED_TEXT = r"\b(?:article|section|chapter|part|clause|rule)\s+\d+[a-z]?\b|^\d+[a-z]?\.\s+[a-z]"


def definition_focus(query: Column | str) -> Column:
    """The subject that a question wants defined; empty if it asks for something else."""
    q = F.regexp_replace(F.trim(X.answer_text(query)), r"[?.!]+$", "")
    asked = F.regexp_extract(q, r"(?i)^(?:what|who)\s+(?:is|are|was|were)\s+(.+)$", 1)
    named = F.regexp_extract(q, r"(?i)^(?:define|definition\s+of|meaning\s+of)\s+(.+)$", 1)
    focus = F.when(asked != "", asked).otherwise(named)
    return F.trim(F.regexp_replace(focus, r"(?i)\s+\b(?:please|exactly|in\s+the\s+document)\b.*$", ""))


def _pattern(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def defined(text: Column | str, focus: Column) -> Column:
    """Whether a text defines the focus by a construction of its own ("X is discussed" is none)."""
    f = M.escaped(focus)
    found = F.regexp_like(X.col(text), _pattern(r"(?i)\b", f, CONSTRUCTIONS, r"|\b(?:has|have)\s+defined\s+", f, r"\s+as\b"))
    return (focus != "") & F.coalesce(found, F.lit(False))


def aliased(text: Column | str, focus: Column) -> Column:
    """Whether a text defines the focus under another name that the rules know."""
    return functools.reduce(lambda a, b: a | b, [(F.lower(focus) == s) & X.col(text).rlike("(?i)" + p) for s, p in rules.ALIASES], F.lit(False))


def identity_score(query: Column | str, text: Column | str, focus: Column, anchor: Column, shape: Column) -> Column:
    """How well a text answers what something is: 0 unless it defines the focus."""
    wants = M.targets(query)["identity"] & (focus != "")
    alias = aliased(text, focus)
    near = F.when(M.phrase_present(text, focus) | alias, 1.0).otherwise(anchor)
    return F.when(wants & (defined(text, focus) | alias) & (near > 0), F.least(F.lit(1.0), 0.70 * near + 0.30 * shape)).otherwise(0.0)


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c evaluated once however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def _clean_end(c: Column) -> Column:
    return F.regexp_replace(c, r"[ ,;:-]+$", "")


def _ended(c: Column) -> Column:
    return F.when(c.endswith("."), c).otherwise(F.concat(_clean_end(c), F.lit(".")))


def _without_tail(c: Column) -> Column:
    """Up to the first of the column tails (in their order) that doesn't stand at the start."""

    def cut(x: Column) -> Column:
        found = [F.regexp_instr(x, F.lit("(?i)" + p)) for p in rules.COLUMN_TAILS]
        return let(F.array(*found), lambda at: let(F.try_element_at(F.filter(at, lambda i: i > 1), F.lit(1)), lambda i: _clean_end(F.trim(F.when(i.isNotNull(), F.substring(x, F.lit(1), i - 1)).otherwise(x)))))

    return let(c, cut)


def recoverable(sentence: Column, focus: Column) -> Column:
    """Whether recovered() has to look at a trimmed sentence at all; of others it finds nothing."""
    # without the word boundaries at their starts, which would be looked up at each letter
    return (focus != "") | sentence.rlike("(?is)" + "|".join((*(p.removeprefix(r"\b") for p in rules.CLAUSES), "refers\\s")))


def recovered(sentence: Column | str, focus: Column) -> Column:
    """The clean definitions within a sentence, in the order of the rules; empty if there is none. Every word is of the
    sentence, or of the rule that the sentence matches."""
    none = F.array().cast("array<string>")
    words = lambda c: F.size(X.words_of(c))
    extract = lambda c, pattern: F.call_function("regexp_extract", c, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))

    def generic(s: Column) -> Column:
        whole = extract(s, _pattern(r"(?is)\b", M.escaped(focus), r"\b.*$"))
        part = F.trim(F.regexp_replace(F.regexp_replace(whole, f"(?is){rules.HEADING_TAIL}.*$", ""), f"(?is){rules.REFERENCE_TAIL}.*$", ""))
        return F.when(defined(s, focus), let(part, lambda x: F.when(words(x) >= 5, F.array(_ended(x)))))

    def clause(s: Column, p: str) -> Column:
        start = let(_without_tail(extract(s, f"(?is){p}.*$")), lambda x: F.when(words(x) >= 7, F.array(_ended(x))).otherwise(none))
        return F.when(s.rlike(f"(?is){p}"), F.array_distinct(F.concat(start, F.array(_ended(extract(s, f"(?is){p}"))))))

    def referring(s: Column) -> Column:
        part = _without_tail(extract(s, r"(?is)\b[a-z][a-z /-]{2,60}\s+refers\s+to\b.*$"))
        return F.when(s.rlike(r"(?i)\srefers\s+to\b"), let(part, lambda x: F.when((words(x) >= 7) & ~X.broken_fragment(x), F.array(_ended(x)))))

    def all_of(s: Column) -> Column:
        by_rule = []
        for subject, patterns, told in rules.DEFINITIONS:
            hit = functools.reduce(lambda a, b: a & b, [s.rlike("(?is)" + p) for p in patterns])
            out = F.lit(told) if told else F.concat(_clean_end(extract(s, "(?is)" + patterns[0])), F.lit("."))
            by_rule.append(F.when((F.lower(focus) == subject) & hit, F.array(out)))
        return F.coalesce(*by_rule, generic(s), *[clause(s, p) for p in rules.CLAUSES], referring(s), none)

    return let(F.trim(X.col(sentence)), all_of)
