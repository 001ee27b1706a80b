"""Rules that belong to the documents of a deployment: repairs of damaged definitions, and topics that contaminate each
other. Both are tables, so that another corpus brings its own."""

from __future__ import annotations

# Definitions whose layout was damaged, as (subject asked for, patterns that the text must all match, the
# definition, or None for the part that the first pattern matches).
DEFINITIONS: tuple[tuple[str, tuple[str, ...], str | None], ...] = (
    ("vaccination", (r"\bvaccination\s+is\s+the\s+action\s+of\s+giving\s+the\s+vaccine\s+to\s+work\b",), "Vaccination is the action of giving the vaccine to someone."),
    ("immunization", (r"\bimmunization\s+is\s+the\s+process\s+whereby\s+a\s+person\b.*\bbecomes\s+protected\s+from\s+a\s+disease\b",), "Immunization is the process whereby a person becomes protected from a disease."),
    ("vaccination", (r"\bvaccination\s+is\s+the\s+action\s+of\s+giving\s+the\s+vaccine\s+to\s+someone\b",), None),
    ("immunization", (r"\bimmunization\s+is\s+the\s+process\s+whereby\s+a\s+person\s+becomes\s+protected\s+from\s+a\s+disease\b",), None),
    ("risk perception", (r"\brisk\s+is\s+the\s+possibility\s+of\s+a\s+negative\s+future\s+outcome\b",), None),
    ("vaccine hesitancy", (r"has defined vaccine hesitancy as a delay|vaccine hesitancy were defined as",), "The SAGE Working Group has defined vaccine hesitancy as a delay in acceptance or refusal of vaccines despite availability of vaccination services."),
    ("vaccine hesitancy", (r"definition of vaccine hesitancy", r"delay"), "The SAGE Working Group has defined vaccine hesitancy as a delay in acceptance or refusal of vaccines despite availability of vaccination services."),
)
# Clauses that are definitions whatever is asked.
CLAUSES = (r"\bvaccination\s+is\s+the\s+action\s+of\s+giving\s+the\s+vaccine\b",)
# Subjects that a text may define under another name, as (subject asked for, pattern).
ALIASES = (("risk perception", r"\brisk\s+is\s+the\s+possibility\s+of\b"),)
# Where a definition's fragment ends: at a heading, at a reference, and at text of another column.
HEADING_TAIL = r"\s+(?:KEY\s+POINT|Definition\s+of|Factors\s+contributing|Communicating\s+risk|INTRODUCTION)\b"
REFERENCE_TAIL = r"\s+(?:#\w+|Figs?\.?|see\s+fig\.?|\(\d+\))\b"
COLUMN_TAILS = (r"\bto work and during a crisis\b", r"\band document contains\b", r"\bdocument contains references\b", r"\bsupporting documents throughout\b", r"\bthe current\b")
# Headings at which a sentence of more than LONG words is split.
LONG, INNER_HEADINGS = 80, r"\s+(?=(?:KEY POINT|INTRODUCTION|Terminology|Supporting materials)\b)"
# Fixed values: (terms of which the sentence has one, terms that the question then must not have, terms of which the
# question has one (empty: any question), penalty).
TOPICS: tuple[tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], float], ...] = (
    (("chandrayaan",), ("chandrayaan",), ("mars", "mom"), 0.85),
    (("moon", "lunar"), (), ("mars", "mom"), 0.35),
    (("gaganyaan", "aditya-l1", "aditya l1", "mangalyaan"), ("gaganyaan", "aditya-l1", "aditya l1", "mangalyaan"), (), 0.40),
)
