"""Column functions over text: cleaning, signatures, quality, tokens. All run inside the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

# Abbreviations that end in a full stop but end no sentence.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "vs.", "etc.", "e.g.", "i.e.", "fig.", "no.", "nos.", "approx.", "jan.", "feb.", "mar.", "apr.", "jun.", "jul.", "aug.", "sep.", "sept.", "oct.", "nov.", "dec.")
# Phrases that tell of text damaged by mixed-up columns.
BROKEN_TEXT = (
    "document contains references", "supporting documents throughout", "the current •", "• and document", "• vaccination services refers", "planner and facilitator guide provides",
    "this icon indicates", "users seeking practical advice", "euro.who.int", "building confidence in vaccines", "vaccination services refers to where, when, how", "and vaccination, both in ongoing",
)
GLUED_WORDS = ("historyto", "missionthe", "orbitwas", "launchthe", "someone.in", "thecurrent", "documentcontains")
#: Words of a line of text, of a heading, of a sentence.
HEADING = r"^(?:\d+(?:\.\d+)*\.?\s+)?[A-Z][A-Za-z0-9][A-Za-z0-9 ,:&()/'\-]{2,100}$"
SENTINEL = "\x01"
#: The end of a text that stops amid a sentence, read backwards, so that no other place of the text is tried.
OPEN_END = r"^(?:\n\r?|[\r\x{85}\x{2028}\x{2029}])?[.!?]?\s*(?:" + "|".join(w[::-1] for w in ("and", "or", "to", "of", "for", "with", "from", "by", "in", "on", "the")) + r")(?:\z|[^\p{L}\p{N}_])"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC, by the ICU library that comes with Spark. Texts of ASCII alone, which it leaves as they are, aren't
    given to it."""
    whole = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col(c), F.lit(True))
    return F.when(col(c).rlike(r"[^\x00-\x7F]"), whole).otherwise(col(c))


def unicode_clean(c: Column | str) -> Column:
    """NFKC without zero-width characters, byte-order marks and soft hyphens."""
    return F.regexp_replace(nfkc(c), "[​‌‍﻿­]", "")


def without_controls(c: Column | str) -> Column:
    """Drops control, format, unassigned and private characters but line feed and tab."""
    return F.regexp_replace(col(c), r"[\p{C}&&[^\n\t]]", "")


def squeezed(c: Column | str) -> Column:
    """Runs of blanks and tabs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"[ \t]+", " "))


def normalized_line(c: Column | str) -> Column:
    return squeezed(F.regexp_replace(without_controls(unicode_clean(c)), r"\r", ""))


def trimmed(texts: Column) -> Column:
    """Each text of an array without blanks at its ends. (``F.trim`` itself would take a text's place in the array, which
    ``F.transform`` hands to functions of two arguments, as the characters to trim.)"""
    return F.transform(texts, lambda x: F.trim(x))


def block_text(c: Column | str) -> Column:
    """Extraction-level white space: NUL to blank, one kind of line end, no control characters, no blank lines."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\x00", " "), r"\r\n?", "\n")
    lines = F.split(F.regexp_replace(t, r"[\x01-\x08\x0B-\x1F]", ""), "\n")
    return F.array_join(F.filter(F.transform(lines, squeezed), lambda x: x != ""), "\n")


def line_signature(c: Column | str) -> Column:
    """Lower case, digits as #, white space squeezed: equal for lines that differ in numbers only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\d+", "#"), r"\s+", " "))


def page_number_line(c: Column | str) -> Column:
    return F.lower(col(c)).rlike(r"^(?:page\s*)?\d{1,5}$") | F.lower(col(c)).rlike(r"^page\s+\d+\s*(?:of|/)\s*\d+$") | F.lower(col(c)).rlike(r"^(?:page|pg\.?)\s*\d+$")


def letters(c: Column) -> Column:
    """Distinct characters of a word, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))


def junk_line(c: Column | str, page_numbers: bool = True) -> Column:
    """Lines that extraction leaves behind: numbers of pages, long Roman numerals, marks, one character again and
    again, words of one or two letters mixed."""
    v = F.trim(col(c))
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    joined = F.array_join(words, "")
    mixed = (F.size(words) > 0) & F.forall(words, lambda w: (F.length(w) <= 8) & w.rlike(r"^\p{L}+$") & (F.size(letters(w)) <= 2)) & (F.length(joined) >= 4) & (F.size(letters(joined)) <= 2)
    roman = F.lower(v).rlike("^[ivxlcdm]+$") & (F.length(v) > 4)
    same = v.rlike(r"^(.)\1{2,12}$")
    numbers = page_number_line(v) if page_numbers else F.lit(False)
    return (F.length(v) <= 1) | numbers | roman | v.rlike("^[^A-Za-z0-9]{1,8}$") | same | mixed


def repaired_hyphens(lines: Column) -> Column:
    """Lines whose last word is broken at a hyphen take the next line, if that begins in lower case; a line made so
    isn't looked at again."""
    return F.when(F.size(lines) == 0, lines).otherwise(F.split(repaired_text(F.array_join(lines, "\n")), "\n"))


def repaired_text(c: Column) -> Column:
    """The same for lines of one text. A match takes the second line whole, so that nothing in it begins another."""
    return F.regexp_replace(c, r"([A-Za-z]{2})-\n([a-z][^\n]*)", "$1$2")


def deduped_words(c: Column | str) -> Column:
    """Of equal neighbours (whatever their case) in pairs, the second goes. Words end up one blank apart."""
    return F.regexp_replace(F.trim(F.regexp_replace(col(c), r"\s+", " ")), r"(?iu)(?<!\S)(\S+) \1(?!\S)", "$1")


def cleaned(c: Column | str) -> Column:
    """Text without layout: lines normalised, junk dropped, hyphens repaired, neighbours that repeat dropped."""
    lines = F.filter(F.transform(F.split(normalized_text(c), "\n"), squeezed), lambda x: ~junk_line(x))
    return F.coalesce(deduped_words(repaired_text(F.array_join(lines, "\n"))), F.lit(""))


def normalized_text(c: Column | str) -> Column:
    return F.regexp_replace(without_controls(unicode_clean(c)), r"\r", "")


def words_of(c: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda w: w != "")


def punctuation_share(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length(col(c)), F.lit(1))


def text_quality(c: Column | str) -> Column:
    """1, less for few words, single characters, punctuation and words of few letters."""
    w = words_of(c)
    n = F.size(w)
    share = lambda f: F.size(F.filter(w, f)) / n
    score = F.lit(1.0) * F.when(n < 20, 0.75).otherwise(1.0) * F.when(share(lambda x: F.length(x) == 1) > 0.20, 0.65).otherwise(1.0)
    score = score * F.when(punctuation_share(c) > 0.35, 0.75).otherwise(1.0) * F.when(share(lambda x: (F.length(x) >= 3) & (F.size(letters(x)) <= 2)) > 0.20, 0.55).otherwise(1.0)
    return F.when(n == 0, 0.0).otherwise(score)


def chunk_quality(c: Column | str, least: int = 45) -> Column:
    w = words_of(c)
    n = F.size(w)
    score = F.when(F.size(F.filter(w, lambda x: F.length(x) == 1)) / n > 0.15, 0.70).otherwise(1.0) * F.when(punctuation_share(c) > 0.30, 0.75).otherwise(1.0)
    return F.when(F.coalesce(F.length(col(c)), F.lit(0)) == 0, 0.0).when(n < least, 0.4).otherwise(score)


def chunk_text(c: Column | str) -> Column:
    """One kind of line end, blanks squeezed, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(col(c), r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def safe_name(c: Column | str) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9._-]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("general"))


def domain_of(path: Column | str) -> Column:
    """The first folder of a relative path, or general."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) > 1, safe_name(parts[0])).otherwise(F.lit("general"))


def document_type(domain: Column | str) -> Column:
    d = F.lower(col(domain))
    return (
        F.when(d.contains("health"), "medical_guideline").when(d.contains("legal"), "legal_document").when(d.contains("education"), "educational_document")
        .when(d.contains("space") | d.contains("science"), "scientific_document").otherwise("document")
    )


def heading(c: Column | str) -> Column:
    v = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    return (v != "") & (F.length(v) <= 110) & (F.size(F.split(v, " ")) <= 16) & ~v.rlike(r"[.?!]$") & v.rlike(HEADING)


def tokens(c: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def protected_abbreviations(c: Column | str) -> Column:
    """Full stops of abbreviations as a sentinel; longest first, wherever the letters stand, in lower case after."""
    c = out = col(c)
    for a in sorted(ABBREVIATIONS, key=lambda x: (-len(x), x)):
        out = F.regexp_replace(out, "(?i)" + a.replace(".", r"\."), a.replace(".", SENTINEL))
    # one search from full stops backwards tells the texts that have any
    some = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    return F.when(c.rlike(rf"(?i)\.(?<=(?:{some}))"), out).otherwise(c)


def sentences(c: Column | str, least: int = 3) -> Column:
    """Sentences of paragraphs; parts of fewer than ``least`` words belong to the sentence before."""
    split = F.regexp_replace(F.regexp_replace(protected_abbreviations(chunk_text(c)), r"\n\s*\n", "\x02"), r"(?<=[.!?])[\"'”’)\]]*\s+(?=[A-Z0-9À-ÖØ-Ý])", "\x02")
    # all on the whole text: blanks around marks go, then marks before short parts
    parts = F.regexp_replace(F.replace(split, F.lit(SENTINEL), F.lit(".")), r"\s+", " ")
    parts = F.regexp_replace(F.regexp_replace(parts, " ?\x02[ \x02]*", "\x02"), "^[ \x02]+|[ \x02]+\\z", "")
    if least > 1:
        parts = F.regexp_replace(parts, f"\x02(?=[^ \x02]+(?: [^ \x02]+){{0,{least - 2}}}(?:\x02|\\z))", " ")
    return F.filter(F.split(parts, "\x02"), lambda p: p != "")


def squeezed_answer(c: Column | str) -> Column:
    """No URLs, white space as single blanks (of which only other runs are replaced), none before a mark."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?:[hH](?i:ttps?://)|[wW](?i:ww\.))\S+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[\t-\r]\s*| \s+", " "), r" ([,.;:!?])", "$1")


def answer_text(c: Column | str) -> Column:
    """Line ends to blanks, no URLs, no blank before a mark, a blank after a sentence's end."""
    return F.trim(F.regexp_replace(squeezed_answer(c), r"([.!?])([A-Z])", "$1 $2"))


def answer_parts(c: Column | str) -> Column:
    """The answer text cut at bullets and sentences' ends; parts may be empty or have blanks at their ends."""
    return F.split(F.regexp_replace(squeezed_answer(c), r"([.!?])(?: (?=[A-Z0-9\"'(])|(?=[A-Z]))|[•▪‣]", "$1\x02"), "\x02")


def has_words(c: Column, n: int) -> Column:
    """Whether a text has n words at least, told without a list of them."""
    return c.rlike(rf"^\s*+(?:\S++\s++){{{n - 1}}}\S")


def damaged(low: Column) -> Column:
    """Whether a trimmed text in lower case has phrases of mixed-up columns or begins or ends amid a sentence."""
    known = functools.reduce(lambda a, b: a | b, [low.contains(p) for p in BROKEN_TEXT])
    return known | F.reverse(low).rlike(OPEN_END) | low.rlike(r"^(?:and|or|but|because|while|where|when|how|which|that)(?:[^\p{L}\p{N}_]|$)")


def broken_fragment(c: Column | str) -> Column:
    s = F.lower(F.trim(col(c)))
    return ~F.coalesce(has_words(s, 5), F.lit(False)) | damaged(s)


def sentence_quality(c: Column | str) -> Column:
    """1, less for each sign of damage, 0 to 1; 0 below five words."""
    s = F.trim(col(c))
    low, n = F.lower(s), F.size(words_of(s))
    minus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    loss = functools.reduce(lambda a, b: a + b, [minus(low.contains(p), 0.45) for p in BROKEN_TEXT] + [minus(low.contains(p), 0.25) for p in GLUED_WORDS])
    loss = loss + minus(low.contains("chun-drə") | s.contains("/ˌ"), 0.25) + minus(low.rlike(r"^(?:and|or|but|because|while|which|that)(?:[^\p{L}\p{N}_]|$)"), 0.20)
    loss = loss + minus(low.rlike(r"(?:^|[^\p{L}\p{N}_])(?:and|or|to|of|for|with|from|by|in|on)\s*[.!?]?$"), 0.25) + minus(n > 70, 0.20)
    loss = loss + minus(F.length(s) - F.length(F.replace(s, F.lit("•"), F.lit(""))) >= 2, 0.30)
    upper, alpha = F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    loss = loss + minus((alpha > 20) & (upper / alpha > 0.75), 0.15)
    return F.when(n < 5, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - loss)))
