"""Column functions that match queries and evidence: tokens, references, phrases, intents, scores."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from granary.functions.text import col, words_of

# A word of a question, and the kinds of numbered references.
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
KINDS = r"(?i)\b(articles?|sections?|chapters?|clauses?|rules?|paragraphs?)\s*([0-9]+[A-Za-z]?)\b"

# Words that ask and don't name a topic.
QUESTION_WORDS = (
    "what", "who", "whom", "whose", "where", "when", "why", "how", "which", "does", "do", "did", "is", "are", "was", "were", "can", "could", "would", "should", "will", "may", "might", "tell", "give",
    "explain", "describe", "discuss", "compare", "contrast", "difference", "differences", "between", "versus", "vs", "and", "the", "a", "an", "of", "to", "for", "in", "on", "with", "from", "about", "me", "please",
)
# Generic words that no evidence needs to hold.
GENERIC = (
    "information", "info", "details", "detail", "thing", "things", "person", "people", "organization", "organisation", "company", "country", "city", "state", "date", "reason", "purpose", "process",
    "method", "steps", "difference", "differences", "comparison", "compare", "contrast", "different", "explain", "explanation", "describe", "discuss", "developed", "developer", "built", "designed", "launched", "launch",
    "started", "ended", "important", "work", "works", "working", "used", "use", "does", "did", "make", "made",
)
# Words that no topic phrase holds.
TOPIC_BLOCK = ("different", "difference", "differences", "compare", "contrast", "developed", "developer", "built", "designed", "launched", "launch", "started", "ended", "important", "work", "works", "working")
# Cues of a question's intent, in order.
INTENT_CUES = {
    "who": ("who", "whom", "whose"),
    "what": ("what", "which", "define", "definition", "meaning", "means"),
    "where": ("where", "location", "located", "landed", "landing"),
    "when": ("when", "date", "year", "period", "launched", "launch date", "started", "ended"),
    "why": ("why", "reason", "cause", "caused", "purpose", "because", "due to"),
    "how": ("how", "process", "method", "steps", "procedure", "works", "working", "implemented"),
    "compare": ("compare", "comparison", "contrast", "difference", "differences", "between", "versus", "vs"),
    "explain": ("explain", "explanation", "describe", "discuss", "elaborate", "detail", "details", "tell me about"),
}
# Cues that evidence answers an intent.
DEFINITION_CUES = (" is ", " are ", " was ", " were ", " refers to ", " means ", "definition", "defined", " defined as ", " known as ", " consists of ", " is called ", " is the process of ", " is the action of ", " is a ", " is an ")
CAUSAL_CUES = ("because", "due to", "therefore", "resulted in", "resulting in", "caused", "cause", "reason", "purpose", "so that", "led to", "leads to")
PROCESS_CUES = (
    "by ", "using ", "through ", "process", "method", "steps", "procedure", "works", "working", "implemented", "performed", "carried out", "consists of",
    "first", "then", "finally", "learns", "learn ", "predict", "generate", "calculat", "transform", "classif", "receive", "take ", "uses ",
)
LOCATION_CUES = (" in ", " at ", " on ", " near ", "from ", "located", "based", "landed", "landing", "region", "country", "city", "state", "site", "pole")
DATE_CUES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "launched", "launch", "started", "ended", "during", "between", "year", "date")
COMPARE_CUES = ("whereas", "while", "however", "difference", "similar", "unlike", "compared")
# Words left out of lexical scores.
STOPWORDS = (
    "where", "what", "when", "which", "who", "whom", "why", "how", "did", "does", "do", "is", "was", "were", "are", "can", "could", "would", "should", "the", "a", "an", "and", "or", "of", "to", "on",
    "in", "for", "with", "from", "by", "that", "this", "it", "its", "be", "tell", "me", "about", "please", "explain", "describe", "discuss", "give", "provide", "details", "information", "difference", "differences",
    "between", "compare", "comparison", "regarding", "related", "according", "mean", "means", "define", "defined", "definition",
)
# Patterns of what a question asks for.
TARGETS = {
    "identity": r"\b(?:what|who)\s+(?:is|was|are|were)\b|\b(?:define|definition of|meaning of|describe|explain|tell me about)\b",
    "location": r"\bwhere\b|\blocation\b|\b(?:land|landed|landing)\b",
    "organization": r"\b(?:which organization|which organisation|organization|organisation|developed by|built by|designed by|operated by|who developed|who built|who designed|who operates)\b",
    "date": r"\b(?:when|date|year|launched|launch date)\b",
    "reason": r"\bwhy\b|\bwhat caused\b|\breason for\b",
    "method": r"\bhow\b|\bmethod\b|\bprocess\b|\bsteps?\b|\bprocedure\b",
    "comparison": r"\b(?:compare|comparison|difference|differences|differentiate|contrast)\b|\bbetween\b.*\band\b",
    "quantity": r"\b(?:how many|how much|number of|amount of|count of|percentage of|percent of)\b",
}
# Patterns of answers of a shape and what they are worth.
SHAPES = (
    ("identity", r"\b(?:is|are|was|were)\b.{0,80}\b(?:a|an|the)\b", 0.90),
    ("identity", r"\b(?:refers to|means|defined as|definition|consists of|is called)\b", 0.90),
    ("location", r"\b(?:in|at|near|on|from|located|landed|landing|site|location)\b", 0.75),
    ("date", r"\b(?:19|20)\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", 0.85),
    ("organization", r"\b(?:by|developed|built|designed|operated|organization|organisation|agency|company|institution)\b", 0.75),
    ("reason", r"\b(?:because|due to|reason|caused|resulted|therefore|so that|in order to)\b", 0.80),
    ("method", r"\b(?:first|then|next|finally|process|method|steps?|procedure|using|through|by)\b", 0.70),
    ("quantity", r"\b\d+(?:\.\d+)?\b|\b(?:percent|percentage|million|billion|thousand)\b", 0.85),
    ("comparison", r"\b(?:whereas|while|however|both|unlike|different|similar|compared|respectively|difference)\b", 0.80),
)
# A question's leading word.
LEADING = r"^(?:please\s+)?(what|who|whom|whose|where|when|why|how)\b"
# Phrases that ask for a comparison.
COMPARISONS = ("difference between", "differences between", "different from", "compare", "contrast", " versus ", " vs ")
# Verbs that define a single word right before them.
DEFINING = r"(?:is|are|was|were|refers\s+to|means|denotes|defined|known\s+as)"


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def match_text(c: Column | str) -> Column:
    """One kind of dash, one blank between words, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(F.coalesce(col(c), F.lit("")), "–—−", "---"), r"\s+", " ")))


def match_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[a-z0-9]+(?:[-'][a-z0-9]+)*"), F.lit(0))


def escaped(c: Column) -> Column:
    """A text as a pattern (texts to match have one blank between words)."""
    return F.regexp_replace(c, r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")


def phrase_present(text: Column | str, phrase: Column | str) -> Column:
    """Whether a phrase stands in a text with no letter or digit right before or after it."""
    p = match_text(phrase)
    return (p != "") & F.regexp_like(match_text(text), F.concat(F.lit("(?<![a-z0-9])"), escaped(p), F.lit("(?![a-z0-9])")))


def references(c: Column | str) -> Column:
    """Numbered references like "article 12": singular, lower case, in order, each once."""
    kinds, numbers = (F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(KINDS), F.lit(i)) for i in (1, 2))
    return F.array_distinct(F.zip_with(kinds, numbers, lambda k, n: F.concat(F.regexp_replace(F.lower(k), "s$", ""), F.lit(" "), F.lower(n))))


def reference_present(text: Column | str, reference: Column | str) -> Column:
    """A reference by its name, or an article as a bare number with a full stop or bracket."""
    r = match_text(reference)
    bare = F.regexp_like(match_text(text), F.concat(F.lit(r"(?<!\d)"), F.regexp_extract(r, r"([0-9]+[a-z]?)$", 1), F.lit(r"\s*[.)]\s*")))
    return phrase_present(text, reference) | (r.rlike(r"^article [0-9]+[a-z]?$") & bare)


def intents(c: Column | str) -> Column:
    """What a question wants: its leading word, comparison first; cues only where neither tells; else ``what``."""
    q = match_text(c)
    lead = F.nullif(F.regexp_extract(q, LEADING, 1), F.lit(""))
    padded = F.concat(F.lit(" "), q, F.lit(" "))
    compare = functools.reduce(lambda a, b: a | b, [q.contains(x) for x in COMPARISONS])
    explicit = F.array_compact(F.array(F.when(compare, F.lit("compare")), lead, F.when(q.rlike(r"^what\s+does\b"), F.lit("how"))))

    def cue(x: str) -> Column:
        return padded.contains(f" {x} ") if " " in x else q.rlike(rf"(?<![a-z0-9]){x}(?![a-z0-9])")

    told = F.array_compact(F.array(*[F.when(functools.reduce(lambda a, b: a | b, map(cue, cues)), F.lit(k)) for k, cues in INTENT_CUES.items()]))
    found = F.when(F.size(explicit) > 0, explicit).otherwise(told)
    return F.array_distinct(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("what"))))


def content_words(c: Column | str) -> Column:
    """Tokens that carry a question's topic, in order, each once; numbers of references are left to them."""
    numbers = F.transform(references(c), lambda r: F.element_at(F.split(r, " "), -1))
    keep = lambda t: ~t.isin(*QUESTION_WORDS, *GENERIC) & (F.length(t) >= 2) & ~(t.rlike(r"^\d+$") & F.array_contains(numbers, t))
    return F.array_distinct(F.filter(match_tokens(c), keep))


def topic_phrase(c: Column | str) -> Column:
    """The whole topic of a short question, where it is 2 to 6 words that all name it; else null."""
    q = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"(?i)^\s*(?:what|who|where|when|why|how)\s+(?:(?:is|are|was|were|does|do|did)\s+)?", ""), r"[?!.]+$", "")
    t = match_tokens(q)
    return F.when(F.size(t).between(2, 6) & ~F.exists(t, lambda x: x.isin(*QUESTION_WORDS, *TOPIC_BLOCK)), F.array_join(t, " "))


def capital_runs(c: Column | str) -> Column:
    """Runs of two or more capitalised words that aren't question words."""
    marked = F.transform(F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0)), lambda t: F.when(t.rlike("^[A-Z]") & ~F.lower(t).isin(*QUESTION_WORDS), F.lower(t)).otherwise(F.lit("\x01")))
    runs = F.split(F.regexp_replace(F.array_join(marked, " "), " ?\x01 ?", "\x01"), "\x01")
    return F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r.contains(" "))


def comparison_sides(c: Column | str) -> Column:
    """The two things that a comparison names."""
    q = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"(?i)^\s*(?:what is|what are|explain|describe|tell me about)?\s*", ""), r"(?i)^\s*(?:the\s+)?(?:differences?|comparison|compare|contrast)\s+(?:between\s+)?", "")
    sides = F.split(q, r"(?i)\s+(?:and|versus|vs\.?|v\.|with|different from)\s+", 2)
    named = F.transform(sides, lambda s: F.array_join(F.filter(match_tokens(s), lambda t: ~t.isin(*QUESTION_WORDS, "difference", "differences", "comparison", "compare", "contrast")), " "))
    return F.when(F.size(sides) == 2, F.filter(named, lambda s: s != "")).otherwise(F.array().cast("array<string>"))


def focus_phrases(c: Column | str, most: int = 12) -> Column:
    """What evidence must hold: references, quotes, sides of a comparison, topic, names, then words that none of the
    longer phrases holds."""
    q = F.trim(F.coalesce(col(c), F.lit("")))
    quoted = F.transform(F.regexp_extract_all(q, F.lit("[\"']([^\"']{2,100})[\"']"), F.lit(1)), match_text)
    phrases = F.concat(references(q), quoted, comparison_sides(q), F.array_compact(F.array(topic_phrase(q))), F.transform(capital_runs(q), match_text), content_words(q))
    distinct = F.array_distinct(F.filter(phrases, lambda p: p != ""))
    inner = F.flatten(F.transform(F.filter(distinct, lambda p: p.contains(" ")), lambda p: F.split(p, " ")))
    return F.slice(F.filter(distinct, lambda p: p.contains(" ") | ~F.array_contains(inner, p) | p.rlike(r"^\d+$")), 1, most)


def lexical_match(query: Column | str, text: Column | str, focus: Column | None = None, refs: Column | None = None) -> Column:
    """score, matched, missing, exact_phrase, reference_match of a query's focus phrases in a text. What is known of
    the query already can be given, so that it isn't found again for each text."""
    focus, refs = focus_phrases(query) if focus is None else focus, references(query) if refs is None else refs
    hit = lambda p: F.when(F.array_contains(refs, p), reference_present(text, p)).otherwise(phrase_present(text, p))
    matched = F.filter(focus, hit)
    exact = F.exists(matched, lambda p: p.contains(" ") & ~F.array_contains(refs, p)) | F.exists(matched, lambda p: p.contains(" "))
    ref = F.exists(matched, lambda p: F.array_contains(refs, p))
    score = F.least(F.lit(1.0), F.size(matched) / F.greatest(F.size(focus), F.lit(1)) + F.when(exact, 0.15).otherwise(0.0) + F.when(ref, 0.25).otherwise(0.0))
    return F.struct(F.when(F.size(focus) > 0, score).otherwise(0.0).alias("score"), matched.alias("matched"), F.array_except(focus, matched).alias("missing"), exact.alias("exact_phrase"), ref.alias("reference_match"))


def _any(s: Column, cues) -> Column:
    return functools.reduce(lambda a, b: a | b, [s.contains(x) for x in cues])


def intent_cue(query: Column | str, text: Column | str, want: Column | None = None) -> Column:
    """Share of the question's intents whose cues the text has."""
    s = F.concat(F.lit(" "), match_text(text), F.lit(" "))
    want = intents(query) if want is None else want
    has = lambda *names: functools.reduce(lambda a, b: a | b, [F.array_contains(want, n) for n in names])
    year = s.rlike(r"\b(?:19|20)\d{2}\b") | s.rlike(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
    tests = (
        (has("what", "explain"), _any(s, DEFINITION_CUES)), (has("why"), _any(s, CAUSAL_CUES)), (has("how"), _any(s, PROCESS_CUES)), (has("where"), _any(s, LOCATION_CUES)), (has("when"), year | _any(s, DATE_CUES)),
        (has("who"), s.rlike(r"\b(?:is|was|are|were|by|from|named|called|born|served|founded|developed)\b")), (has("compare"), _any(s, COMPARE_CUES)),
    )
    scores = F.array_compact(F.array(*[F.when(on, cue.cast("double")) for on, cue in tests]))
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.0)


def evidence_support(query: Column | str, text: Column | str) -> Column:
    return F.least(F.lit(1.0), 0.72 * lexical_match(query, text)["score"] + 0.28 * intent_cue(query, text))


def definition_matches(query: Column | str, text: Column | str, focus: Column | None = None, refs: Column | None = None) -> Column:
    """Whether a text defines the most specific focus phrase: a single word must stand right before a defining verb."""
    focus, refs = focus_phrases(query) if focus is None else focus, references(query) if refs is None else refs
    sized = F.array_sort(F.transform(focus, lambda p: F.struct((-F.size(F.split(p, " "))).alias("a"), (-F.length(p)).alias("b"), F.array_position(focus, p).alias("c"), p.alias("p"))))
    primary = F.try_element_at(sized, F.lit(1))["p"]
    verb = rf"(?![a-z0-9])\s+{DEFINING}\b"
    single = F.regexp_like(match_text(text), F.concat(F.lit("(?<![a-z0-9])"), escaped(F.coalesce(primary, F.lit("\x01"))), F.lit(verb)))
    named = F.when(F.array_contains(refs, primary), reference_present(text, primary)).when(primary.contains(" "), phrase_present(text, primary)).otherwise(single)
    return F.when(F.size(focus) == 0, F.lit(False)).otherwise(named)


def query_terms(c: Column | str) -> Column:
    """Words of three letters or more, and numbers, that aren't stop words; in order, each once."""
    t = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(t, lambda x: ~x.isin(*STOPWORDS) & ((F.length(x) >= 3) | x.rlike(r"^\d+$"))))


def targets(c: Column | str) -> Column:
    """Eight booleans: what a question asks for."""
    q = F.lower(F.trim(col(c)))
    return F.struct(*[q.rlike(p).alias(k) for k, p in TARGETS.items()])


def has_term(text: Column, term: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit("(?<![a-z0-9])"), term, F.lit("(?![a-z0-9])")))


def lexical_question(query: Column | str, text: Column | str, terms: Column | None = None) -> Column:
    """Share of the query's terms that a text holds."""
    terms, s = query_terms(query) if terms is None else terms, F.lower(F.coalesce(col(text), F.lit("")))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: has_term(s, t))) / F.size(terms))


def anchor_score(query: Column | str, text: Column | str, terms: Column | None = None) -> Column:
    """1 if two neighbouring terms stand together in the text; else the share of terms by length, or of numbers."""
    terms, s = query_terms(query) if terms is None else terms, F.lower(F.coalesce(col(text), F.lit("")))
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(terms, i), F.try_element_at(terms, i + 1))), lambda p: p.contains(" "))
    weight = lambda t: F.least(F.lit(2.0), F.greatest(F.lit(1.0), F.length(t) / 5.0))
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + weight(t))
    hits = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(has_term(s, t), weight(t)).otherwise(0.0))
    numeric = F.filter(terms, lambda t: t.rlike(r"^\d+$"))
    number = F.when(F.size(numeric) > 0, F.size(F.filter(numeric, lambda t: F.regexp_like(s, F.concat(F.lit(r"(?<!\d)"), t, F.lit(r"(?!\d)"))))) / F.size(numeric)).otherwise(0.0)
    return F.when(F.size(terms) == 0, 0.0).when(F.exists(pairs, lambda p: F.contains(s, p)), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(hits / total, number)))


def answer_shape(query: Column | str, text: Column | str) -> Column:
    """The most that a text's shape is worth for what the question asks."""
    t, s = targets(query), F.lower(col(text))
    return F.greatest(F.lit(0.0), F.when(t["identity"] & col(text).rlike(r"\b\d+[a-z]?\.\s+[A-Z]"), 0.75).otherwise(0.0), *[F.when(t[k] & s.rlike(p), v).otherwise(0.0) for k, p, v in SHAPES])


def target_scores(query: Column | str, anchor: Column, shape: Column, identity: Column) -> Column:
    """Scores of the four targets that have evidence of their own; null where the question doesn't ask for one."""
    t = targets(query)
    blend = F.when(anchor > 0, 0.55 * anchor + 0.45 * shape).otherwise(0.0)
    return F.struct(F.when(t["identity"], identity).alias("identity"), *[F.when(t[k], blend).alias(k) for k in ("organization", "location", "date")])


def target_score(scores: Column, shape: Column) -> Column:
    """Mean over the targets that the question asks for, 1 at most; its shape if it asks for none of them."""
    each = F.array_compact(F.array(*[scores[k] for k in ("identity", "organization", "location", "date")]))
    return F.when(F.size(each) > 0, F.least(F.lit(1.0), F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / F.size(each))).otherwise(shape)


def covers_target(scores: Column, least: float = 0.45) -> Column:
    """Whether a text gives one of the targets that the question asks for."""
    return F.coalesce(functools.reduce(lambda a, b: a | b, [F.coalesce(scores[k] >= least, F.lit(False)) for k in ("identity", "organization", "location", "date")]), F.lit(False))


def short_entity_query(c: Column | str) -> Column:
    """At most eight words that ask for a definition of something in capitals."""
    q = F.trim(F.coalesce(col(c), F.lit("")))
    return (F.size(words_of(q)).between(1, 8)) & F.lower(q).rlike(r"^(?:what is|what are|who is|who was|define|meaning of|explain|tell me about)\b") & q.rlike(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{1,7}(?![A-Za-z0-9])")
