"""Question analysis, retrieval depth, sentence scores, selection, validation and confidence of answers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from granary.functions import definitions as D, matching as M, rules, text as X
from granary.functions.numeric import clamp, sigmoid
from granary.session import small_batches

# Words that make a question technical, and that make it need more than one fact.
TECHNICAL = (
    "algorithm", "database", "embedding", "retrieval", "vector", "faiss", "bm25", "transformer", "neural", "rag", "llm", "token", "ranking", "crossencoder", "pipeline", "api",
    "optimization", "graph", "reasoning", "memory", "semantic", "index", "encoder", "decoder", "precision", "recall", "latency", "similarity",
)
MULTIHOP = ("compare", "difference", "between", "relation", "why", "how", "explain", "connect", "versus", "vs", "impact")
# Phrases that tell of a damaged context.
CONTEXT_BROKEN = ("document contains references", "supporting documents throughout", "the current •", "• and document", "this icon indicates", "users seeking practical advice", "euro.who.int")


def analyzed(queries: DataFrame, query: str) -> DataFrame:
    """Adds intents, primary_intent, focus_phrases, refs, multi_entity, requires_multiple_evidence."""
    out = queries.withColumns({"intents": M.intents(query), "focus_phrases": M.focus_phrases(query), "refs": M.references(query)})
    several = (F.size(F.filter("focus_phrases", lambda p: p.contains(" "))) >= 2) | (F.array_contains("intents", "compare") & (F.size("focus_phrases") >= 2))
    return out.withColumns({"primary_intent": F.col("intents")[0], "multi_entity": several, "requires_multiple_evidence": F.arrays_overlap("intents", M.lits(("compare", "why", "how", "explain")))})


def complexity(queries: DataFrame, query: str) -> DataFrame:
    """Adds query_complexity (0 to 1), query_type and recommended_topk."""
    t = M.match_tokens(query)
    n = F.size(t)
    scaled = lambda c, lo, hi: clamp((c - lo) / F.lit(float(hi - lo)))
    acronyms = F.size(F.regexp_extract_all(F.col(query), F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)))
    technical = F.when(n > 0, F.size(F.filter(t, lambda x: x.isin(*TECHNICAL))) / n).otherwise(0.0)
    hop = F.exists(t, lambda x: x.isin(*MULTIHOP)).cast("double")
    score = 0.30 * scaled(n, 2, 30) + 0.20 * scaled(F.least(F.lit(6), acronyms), 0, 6) + 0.25 * F.least(technical * 3.0, F.lit(1.0)) + 0.25 * hop
    out = queries.withColumns({"__c": score, "__i": M.intents(query), "__f": F.size(M.focus_phrases(query))})
    kind = F.when(F.col("__c") < 0.30, "simple").when(F.col("__c") < 0.55, "medium").when(F.col("__c") < 0.75, "complex").otherwise("very_complex")
    depth = F.when(F.col("__c") < 0.30, 3).when(F.col("__c") < 0.55, 5).when(F.col("__c") < 0.75, 8).otherwise(10)
    floor = F.when(F.array_contains("__i", "compare"), 10).when(F.arrays_overlap("__i", M.lits(("why", "how", "explain"))), 8).when(F.col("__f") >= 2, 6).otherwise(1)
    return out.withColumns({"query_complexity": F.round("__c", 3), "query_type": kind, "recommended_topk": F.greatest(depth, floor)}).drop("__c", "__i", "__f")


def with_plan(rows: DataFrame, complexity_: str, requested: str, first: int = 5, step: int = 5, most: int = 20) -> DataFrame:
    """Adds initial_k and max_k, which is on the steps from the first depth."""
    target = F.greatest(F.lit(first + step), F.col(requested), first + F.bround(clamp(F.col(complexity_)) * (most - first)))
    top = F.least(F.lit(most), first + F.ceil((target - first) / step) * step)
    return rows.withColumns({"max_k": top.cast("int"), "initial_k": F.lit(first)})


def candidate_depth(kind: Column, complexity_: Column, short: Column, agreement: Column, stability: Column, k: Column) -> Column:
    banded = F.when(complexity_ < 0.30, 10).when(complexity_ < 0.55, 20).when(complexity_ < 0.75, 30).otherwise(40)
    base = F.when(kind == "simple", 10).when(kind == "medium", 20).when(kind == "complex", 30).when(kind == "very_complex", 40).otherwise(banded)
    base = F.when(short, F.greatest(base, F.lit(15))).otherwise(base)
    far, loose = 1.0 - agreement, 1.0 - stability
    more = F.when(far >= 0.75, 10).when(far >= 0.50, 5).otherwise(0) + F.when(loose >= 0.60, 10).when(loose >= 0.40, 5).otherwise(0)
    return F.least(F.lit(40), F.greatest(F.lit(10), base + more, 2 * k)).cast("int")


def answerability(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, score, reason, answerable of each question from all its evidence (query_id, doc_id, text)."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    joined = evidence.filter(F.trim("text") != "").groupBy("query_id").agg(F.array_join(texts, " ").alias("text"))
    told = queries.withColumns({"focus": M.focus_phrases("query"), "refs": M.references("query"), "want": M.intents("query")})
    known = {"focus": F.col("focus"), "refs": F.col("refs")}
    rows = told.join(joined, "query_id", "left").withColumns({"m": M.lexical_match("query", "text", **known), "cue": M.intent_cue("query", "text", F.col("want")), "defines": M.definition_matches("query", "text", **known)})
    quoted = F.transform(F.regexp_extract_all("query", F.lit("[\"']([^\"']{2,100})[\"']"), F.lit(1)), M.match_text)
    compare = F.array_contains("want", "compare") & (F.size("focus") >= 2)
    base = F.concat("refs", quoted, F.when(compare, F.col("focus")).otherwise(F.array().cast("array<string>")))
    sized = F.array_sort(F.transform(F.filter("focus", lambda p: p.contains(" ")), lambda p: F.struct((-F.size(F.split(p, " "))).alias("a"), (-F.length(p)).alias("b"), F.array_position(F.col("focus"), p).alias("c"), p.alias("p"))))
    explicit = F.aggregate(sized, F.array_distinct(base), lambda acc, x: F.when(F.exists(acc, lambda e: F.contains(e, x["p"]) | F.contains(x["p"], e)), acc).otherwise(F.concat(acc, F.array(x["p"]))))
    rows = rows.withColumn("explicit", explicit)
    hit = F.filter("explicit", lambda p: F.when(F.array_contains(F.col("refs"), p), M.reference_present("text", p)).otherwise(M.phrase_present("text", p)))
    rows = rows.withColumn("coverage", F.when(F.size("explicit") > 0, F.size(hit) / F.size("explicit")).otherwise(1.0))
    w = lambda *x: F.arrays_overlap("want", M.lits(x))
    named, full = F.size("explicit") > 0, F.col("coverage") >= 1.0
    two = w("compare") & (F.size("explicit") >= 2)
    undefined = w("what") & ~w("compare", "explain") & ~F.col("defines")
    cue = F.when(undefined, 0.0).otherwise(F.col("cue"))
    factor = F.when(named & ~full, 0.45).otherwise(1.0) * F.when(two & ~full, 0.35).otherwise(1.0) * F.when(undefined, 0.45).otherwise(1.0)
    for kind, loss in (("who", 0.55), ("where", 0.55), ("when", 0.55), ("why", 0.50), ("how", 0.55)):
        factor = factor * F.when(w(kind) & (cue < 0.5), loss).otherwise(1.0)
    score = clamp((0.55 * F.col("m.score") + 0.35 * F.col("coverage")) * factor)
    asks = w("what", "who", "where", "when", "why", "how")
    rows = rows.withColumns({"s": F.when(F.col("text").isNull(), 0.0).otherwise(score), "c": cue})
    reason = (
        F.when(F.col("text").isNull(), "no_evidence").when(F.size("m.matched") == 0, "query_focus_not_found").when(named & ~full, "explicit_query_focus_not_fully_grounded").when(two & ~full, "comparison_missing_one_side")
        .when((F.col("c") < 0.5) & asks, "topic_present_but_answer_structure_missing").when(F.col("s") >= 0.72, "strong_grounding").when(F.col("s") >= 0.48, "partial_grounding").otherwise("weak_grounding")
    )
    ok = (F.col("s") >= 0.52) & (~named | full) & (~asks | (F.col("c") >= 0.5) | w("explain", "compare"))
    return rows.select("query_id", F.round("s", 6).alias("score"), reason.alias("reason"), ok.alias("answerable"))


# --- sentences -----------------------------------------------------------------------------------------------------


def answer_sentences(docs: DataFrame, key: str, text: str, query: str | None = None, repeats: bool = True) -> DataFrame:
    """key, pos, sentence: sentences fit for answers, equal ones of a key once. With ``query`` (a column with the
    question of each row; key then names question and document) clean definitions take the place of the sentences they
    are in, and headings of numbered parts stay where the question names such a part. Each row settles its own equal
    sentences; without ``repeats`` no two rows share a key, so that nothing is shuffled."""
    asked = F.col(query) if query else F.lit("")
    rows = docs.select(key, D.definition_focus(asked).alias("__focus"), F.lower(F.coalesce(asked, F.lit(""))).rlike(D.NUMBERED).alias("__numbered"), X.answer_parts(text).alias("__parts"))
    none, numbered, focus = F.array().cast("array<string>"), F.col("__numbered"), F.col("__focus")

    def plain(s: Column) -> Column:
        def bad(low: Column) -> Column:
            heading = numbered & low.rlike(D.NUMBERED_TEXT)
            return F.when(X.has_words(s, 5), X.damaged(low) & ~heading).otherwise(~(heading & low.rlike(r"^\d+[a-z]?\.\s+")))

        inner = "(?i)" + rules.INNER_HEADINGS
        long = (F.length(s) > 2 * rules.LONG) & X.has_words(s, rules.LONG + 1) & s.rlike(inner)
        cut = F.filter(X.trimmed(F.split(s, inner)), lambda x: ~X.broken_fragment(x))
        return F.when(D.let(F.lower(s), bad), none).when(long, cut).otherwise(F.array(s))

    def told(s: Column) -> Column:
        clean = D.let(D.recovered(s, focus), lambda c: F.when(F.size(c) > 0, c).otherwise(plain(s)))
        return F.when(s == "", none).when(D.recoverable(s, focus), clean).otherwise(plain(s))

    place = lambda n, m: (n * 100 + F.least(m, F.lit(99))).cast("int")
    each = lambda x, n: F.transform(D.let(F.trim(x), told), lambda y, m: F.struct(same_but_marks(y).alias("same"), place(n, m).alias("pos"), y.alias("sentence")))
    first = lambda all_: F.filter(all_, lambda x, i: (i == 0) | (x["same"] != F.get(all_, i - 1)["same"]))
    kept = F.transform(D.let(F.sort_array(F.flatten(F.transform("__parts", each))), first), lambda x: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence")))
    # outer, for of others Spark makes the array twice: to leave out rows where it is empty
    found = rows.select(key, kept.alias("__kept")).select(key, F.explode_outer("__kept").alias("x")).filter("x IS NOT NULL").select(key, "x.pos", "x.sentence")
    return deduped(found, key, "pos", "sentence") if repeats else found


def same_but_marks(c: Column | str) -> Column:
    """Equal for texts that are equal but for case, blanks and marks. Single blanks stay as they are; a-z is in \\p{L}, and
    quicker to tell."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z \p{L}\p{N}][^\p{L}\p{N}]*| [^a-z\p{L}\p{N}]+", " "))


def deduped(rows: DataFrame, key: str, order: str, sentence: str) -> DataFrame:
    """The first of each key's sentences that are equal but for case, blanks and marks."""
    w = Window.partitionBy(key, "__same").orderBy(order)
    return rows.withColumn("__same", same_but_marks(sentence)).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__same", "__k")


def hashed_vector(c: Column, size: int = 64) -> Column:
    """A text as a vector of length one: the default in place of a trained encoder. Each word adds to the place that
    its hash names, so texts are near if they share words."""
    words = X.tokens(c)
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    # bound to a variable, so that counts and norm are made once a text
    held = F.transform(F.array(raw), lambda r: F.struct(r.alias("r"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, x: a + x * x)).alias("n")))
    return F.transform(held, lambda h: F.transform(h["r"], lambda x: F.when(h["n"] > 0, x / h["n"]).otherwise(0.0)))[0]


def overlap_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts as sets of words: the default scorer, which SQL can tell too."""
    x, y = F.array_distinct(X.tokens(a)), F.array_distinct(X.tokens(b))
    n = F.sqrt(F.size(x).cast("double") * F.size(y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def contamination(query: Column | str, sentence: Column | str, topics=rules.TOPICS) -> Column:
    """How far a sentence is of another topic than the question, by the rules of topics; 1 at most."""
    q, s, terms = F.lower(X.col(query)), F.lower(X.col(sentence)), M.query_terms(query)
    total = F.lit(0.0)
    for has, lacks, asks, penalty in topics:
        on = M._any(s, has)
        on = on & ~M._any(q, lacks) if lacks else on
        on = on & F.arrays_overlap(terms, M.lits(asks)) if asks else on
        total = total + F.when(on, penalty).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def scored_sentences(rows: DataFrame, query: str, sentence: str) -> DataFrame:
    """Adds semantic, lexical, anchor, shape, quality, identity, target, covers, contamination, evidence_score. ``rows``
    may bring a column ``semantic`` of its own."""
    out = rows if "semantic" in rows.columns else rows.withColumn("semantic", overlap_cosine(F.col(query), F.col(sentence)))
    t = F.col("__terms")
    out = out.withColumns({"__terms": M.query_terms(query), "__focus": D.definition_focus(query)})
    out = out.withColumns({"semantic": clamp(F.col("semantic")), "lexical": M.lexical_question(query, sentence, t), "anchor": M.anchor_score(query, sentence, t), "shape": M.answer_shape(query, sentence), "quality": X.sentence_quality(sentence)})
    out = out.withColumn("identity", D.identity_score(query, sentence, F.col("__focus"), F.col("anchor"), F.col("shape")))
    out = out.withColumn("__targets", M.target_scores(query, F.col("anchor"), F.col("shape"), F.col("identity")))
    out = out.withColumns({"target": M.target_score(F.col("__targets"), F.col("shape")), "covers": M.covers_target(F.col("__targets")), "wants_identity": M.targets(query)["identity"]})
    return with_evidence_score(out.withColumn("contamination", contamination(query, sentence)).drop("__terms", "__focus", "__targets"))


def with_evidence_score(rows: DataFrame) -> DataFrame:
    s = 0.40 * F.col("semantic") + 0.18 * F.col("lexical") + 0.20 * F.col("anchor") + 0.10 * F.col("target") + 0.07 * F.col("shape") + 0.05 * F.col("quality")
    s = F.when(F.col("anchor") >= 0.95, F.greatest(s, 0.72 + 0.18 * F.col("semantic"))).when((F.col("lexical") >= 0.80) & (F.col("semantic") >= 0.55), F.greatest(s, 0.60 + 0.20 * F.col("semantic"))).otherwise(s)
    s = s * (1.0 - 0.80 * F.col("contamination")) * F.when(F.col("quality") < 0.35, 0.20).otherwise(1.0)
    return rows.withColumn("evidence_score", clamp(s))


def grounded() -> Column:
    """Whether a scored sentence may be selected."""
    sure = (F.col("evidence_score") >= 0.48) & (F.col("semantic") >= 0.38)
    anchored = (F.col("anchor") >= 0.80) & (F.col("lexical") >= 0.35) & (F.col("evidence_score") >= 0.52)
    return (F.col("quality") >= 0.35) & (F.col("contamination") < 0.55) & (sure | anchored)


def eligible() -> Column:
    """Whether a scored sentence may be selected: grounded, or a clean definition where nothing else is."""
    clean = (F.col("quality") >= 0.35) & (F.col("contamination") < 0.55)
    return grounded() | (F.col("wants_identity") & (F.col("identity") >= 0.55) & clean)


def selected(rows: DataFrame, key: str = "query_id", sentence: str = "sentence", most: int = 3) -> DataFrame:
    """Per key, greedily the sentences that add most: relevance, anchor, meaning, target, novelty, and 1 more for giving
    what the question asks for. A direct definition is the whole answer to a question for one. ``rows`` are scored
    sentences, bounded by the retrieval depth (signals that they lack count as 0); adds rank (from 1) and novelty."""
    known = {"lexical": 0.0, "contamination": 0.0, "identity": 0.0, "covers": False, "wants_identity": False}
    rows = rows.withColumns({c: F.lit(v) for c, v in known.items() if c not in rows.columns})
    rows = rows.withColumn("__grounded", grounded()).filter(eligible())
    columns = [c for c in rows.columns if c != "__grounded"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "__grounded") + ", rank int, novelty double"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        order = [c for c in ("evidence_score", "anchor", "semantic", "lexical", "quality") if c in columns]
        ties = [c for c in ("doc_id", "pos") if c in columns]
        pdf = pdf.sort_values(order + ties, ascending=[False] * len(order) + [True] * len(ties)).reset_index(drop=True)
        if pdf["__grounded"].any():
            pdf = pdf[pdf["__grounded"]].reset_index(drop=True)
        pdf = pdf.drop(columns="__grounded")
        identity = bool(pdf["wants_identity"].iloc[0])
        out: list[tuple[int, float]] = []
        direct = pdf[(pdf["identity"] >= 0.55) & ((pdf["anchor"] >= 0.70) | (pdf["identity"] >= 0.85))] if identity else pdf.iloc[:0]
        if len(direct):
            best = direct.sort_values(["identity", "evidence_score", "semantic"], ascending=False, kind="stable").iloc[0]
            if best["semantic"] >= 0.50 and (best["anchor"] >= 0.90 or best["identity"] >= 0.85):
                out = [(int(best.name), 1.0)]
        if not out:
            words = [set(re.findall(r"[a-z0-9]+", x.lower())) for x in pdf[sentence]]
            fixed = (2.5 * pdf["evidence_score"] + 1.6 * pdf["anchor"] + 1.2 * pdf["semantic"] + 0.8 * pdf["target"] + 0.5 * pdf["quality"] + pdf["covers"].astype(float)).to_numpy()
            near, left = np.zeros(len(pdf)), list(range(len(pdf)))
            while left and len(out) < most:
                best = max(left, key=lambda i: (fixed[i] + 0.8 * (1 - near[i]), -i))
                out.append((best, 1 - near[best]))
                left.remove(best)
                if identity and len(out) == 1 and pdf["identity"][best] >= 0.75 and pdf["anchor"][best] >= 0.80:
                    break
                for i in left:
                    near[i] = max(near[i], len(words[i] & words[best]) / max(1, len(words[i] | words[best])))
        found = pdf.loc[[i for i, _ in out]].copy()
        found["rank"], found["novelty"] = range(1, len(out) + 1), [x for _, x in out]
        return found

    return rows.groupBy(key).applyInPandas(pick, schema)


def selected_answerability(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, score, reason, answerable of each question from the evidence selected for it (query_id, text, anchor,
    target, semantic, quality, evidence_score): the best of each signal, and for a definition that one is there."""
    best = [F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))).alias(c) for c in ("anchor", "target", "semantic", "quality", "evidence_score")]
    texts = F.array_join(F.array_sort(F.collect_list("text")), " ")
    told = queries.withColumn("focus", D.definition_focus("query")).join(evidence.groupBy("query_id").agg(*best, texts.alias("text")), "query_id", "left")
    raw = 0.35 * F.col("anchor") + 0.30 * F.col("target") + 0.15 * F.col("semantic") + 0.10 * F.col("quality") + 0.10 * F.col("evidence_score")
    asks = F.col("focus") != ""
    missing = asks & ~(D.defined("text", F.col("focus")) | D.aliased("text", F.col("focus")))
    none = F.col("text").isNull()
    score = F.when(none, 0.0).when(missing, raw * 0.35).otherwise(raw)
    reason = F.when(none, "no_selected_evidence").when(missing, "identity_definition_required").otherwise("evidence_supported")
    ok = ~none & ~missing & (score >= F.when(asks, 0.55).otherwise(0.45))
    return told.select("query_id", score.alias("score"), reason.alias("reason"), F.coalesce(ok, F.lit(False)).alias("answerable"))


def provenance(chosen: DataFrame, docs: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds source_doc: the first document of the key's candidates (key, doc_id, text) that holds the sentence."""
    hits = chosen.select(key, "rank", "sentence").join(docs.select(key, F.col("doc_id").alias("source_doc"), "text"), key).filter(F.contains(X.answer_text("text"), F.col("sentence")))
    first = hits.groupBy(key, "rank").agg(F.min("source_doc").alias("source_doc"))
    return chosen.join(first, [key, "rank"], "left")


# --- context, validation, confidence ---------------------------------------------------------------------------------


def context_quality(c: Column | str) -> Column:
    """1, less for each sign of damage, many bullets and great length, 0 to 1; 0 below five words."""
    t = F.trim(F.coalesce(X.col(c), F.lit("")))
    low, n = F.lower(t), F.size(X.words_of(t))
    loss = sum((F.when(low.contains(p), 0.20).otherwise(0.0) for p in CONTEXT_BROKEN), F.lit(0.0))
    loss = loss + F.when(F.length(t) - F.length(F.replace(t, F.lit("•"), F.lit(""))) >= 3, 0.20).otherwise(0.0) + F.when(n > 450, 0.10).otherwise(0.0)
    return F.when(n < 5, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - loss))


def context_sentences(c: Column | str, most: int = 120) -> Column:
    """Sentences of five words or more; of many, every so many-th, so that beginning, middle and end are there."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(X.col(c), F.lit("")), r"https?://\S+|www\.\S+", " "), r"\s+", " "))
    parts = F.filter(X.trimmed(F.split(t, r"(?<=[.!?])\s+(?=[A-Z0-9•])|\s*•\s*")), lambda p: F.size(X.words_of(p)) >= 5)
    step = F.greatest(F.lit(1), F.floor(F.size(parts) / most).cast("int"))
    return F.when(F.size(parts) <= most, parts).otherwise(F.slice(F.filter(parts, lambda p, i: i % step == 0), 1, most))


def context_score(whole: Column, best: Column, quality: Column) -> Column:
    s = 0.55 * whole + 0.35 * best + 0.10 * quality
    return clamp(F.when(quality < 0.4, s * 0.6).otherwise(s))


def context_selection(rows: DataFrame, k: int = 3) -> DataFrame:
    """The k documents of each query by the blend of rerank, context, sentence and quality scores; adds rank."""
    blend = 0.45 * sigmoid(F.col("rerank_score")) + 0.35 * F.col("context_score") + 0.15 * F.col("sentence_score") + 0.05 * F.col("quality")
    w = Window.partitionBy("query_id").orderBy(F.desc("selection_score"), F.desc("context_score"), F.desc("rerank_score"), "doc_id")
    return rows.withColumn("selection_score", F.round(blend, 9)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def valid_answer(agreement: Column, semantic: Column, lexical: Column, identity: Column, defined: Column, threshold: float = 0.40) -> Column:
    grounding = F.greatest(0.60 * semantic + 0.40 * lexical, lexical)
    return (agreement >= threshold) & (~identity | defined) & ((grounding >= 0.43) | (lexical >= 0.60) | (semantic >= 0.60))


def ranking_confidence(scores: Column) -> Column:
    """How far the best of an array of scores stands out."""
    s = F.reverse(F.array_sort(scores))
    top, second, low = F.try_element_at(s, F.lit(1)), F.try_element_at(s, F.lit(2)), F.try_element_at(s, F.lit(-1))
    spread = F.greatest(F.lit(1e-6), top - low)
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s)
    return F.when(F.size(s) == 0, 0.0).when(F.size(s) == 1, 1.0).otherwise(clamp((0.65 * (top - second) + 0.35 * (top - mean)) / spread))


def weighted_best(values: Column, best: float) -> Column:
    """Blend of an array's largest value and its mean; 0 if empty."""
    v = F.transform(values, lambda x: clamp(x))
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.when(F.size(v) == 0, 0.0).otherwise(clamp(best * F.array_max(v) + (1 - best) * mean))


def confidence_status(confidence: Column, threshold: float = 0.40) -> Column:
    return F.when(confidence < threshold, "low_confidence").otherwise("ok")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each combination of keys: distinct sources or evidence in order of appearance."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def ordered_distinct(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, values: the distinct values of each key in order of first appearance, without nulls."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct("__at", F.col(value).alias("v"))))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias("values"))


WEIGHTS = {"retrieval": 0.10, "ranking": 0.06, "context": 0.06, "answer_agreement": 0.16, "query_grounding": 0.22, "relevance": 0.18, "semantic": 0.08, "quality": 0.06, "target": 0.04, "source_consistency": 0.04}


def calibrated(c: dict[str, Column], contamination: Column, count: Column, valid: Column, invalid_cap: float = 0.22) -> Column:
    """The confidence of an answer from its ten signals, with the gates that keep unsupported answers low."""
    raw = sum((w * clamp(c[k]) for k, w in WEIGHTS.items()), F.lit(0.0)) - 0.16 * contamination
    g, some = c["query_grounding"], count > 0
    raw = raw * F.when(~some, 0.55).otherwise(1.0) * F.when(~valid, 0.45).otherwise(1.0) * F.when(some & (g < 0.35), 0.45).when(some & (g < 0.45), 0.70).otherwise(1.0)
    raw = raw + F.when(some & (c["target"] >= 0.5) & (c["relevance"] >= 0.75) & (g >= 0.55), 0.03).otherwise(0.0)
    out = clamp(0.08 + 0.88 * clamp(raw))
    caps = (F.when(~some, 0.45), F.when(~valid, invalid_cap), F.when(some & (g < 0.35), 0.25).when(some & (g < 0.45), 0.40))
    for cap in caps:
        out = F.least(out, F.coalesce(cap, F.lit(1.0)))
    return clamp(out)


def sentence_edges(rows: DataFrame, key: str, order: str, sentence: str, least: float = 0.45) -> DataFrame:
    """key, src, dst, weight: pairs of a key's sentences whose cosine, as sets of words, is above ``least``. Pairs meet by
    the words that they share, and of each sentence only its rarest words: two sets of sizes a and b with a cosine above
    t share more than t squared of either, so one of any a - floor(t * t * a) words of the first is in the second. A
    key's sentences meet in one row, and only their words are shuffled, once."""
    small_batches(rows.sparkSession)
    words = rows.select(key, F.struct(F.col(order).alias("n"), F.array_distinct(X.tokens(sentence)).alias("t")).alias("x")).filter(F.size("x.t") > 0)
    met = words.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    lists = met.select(key, F.transform("x", lambda x: x["n"]).alias("n"), F.transform("x", lambda x: x["t"]).alias("t"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def each(batches):
        for batch in batches:
            of, src, dst, weight = [], [], [], []
            for at in range(batch.num_rows):
                n = batch.column(1)[at].as_py()
                for i, j, x in near_sets(n, batch.column(2)[at].as_py(), least):
                    of.append(at)
                    src.append(n[i])
                    dst.append(n[j])
                    weight.append(x)
            places = batch.column(1).type.value_type
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(src, places), pa.array(dst, places), pa.array(weight, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "src", "dst", "weight"])

    return lists.mapInArrow(each, f"`{key}` {kind[key]}, src {kind[order]}, dst {kind[order]}, weight double")


def near_sets(places: list, words: list[list], least: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, cosine) of sets of words, in order of their places, whose cosine is above ``least`` and whose places differ."""
    count = Counter(w for t in words for w in t)
    sets, held = [set(t) for t in words], {}
    for j, t in enumerate(words):
        # words that no other sentence has can be left out: the others still hold all that is shared
        known = sorted((w for w in t if count[w] > 1), key=lambda w: (count[w], w))
        first = known[: max(0, len(known) - math.floor(least * least * len(t)))]
        met: set[int] = set()
        for w in first:
            at = held.setdefault(w, [])
            met.update(at)
            at.append(j)
        for i in met:
            x = len(sets[i] & sets[j]) / math.sqrt(len(sets[i]) * len(sets[j]))
            if places[i] != places[j] and round(x, 9) > least:
                yield i, j, x


def fused_sentences(rows: DataFrame, key: str = "query_id", sentence: str = "sentence", vector: str = "vector", least: float = 0.45) -> DataFrame:
    """Groups of a key's sentences with their direct neighbours (edge: .6 of the likeness of their names, .4 of the
    cosine, above ``least``), in order; adds group_no. Sentences already in a group start none."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", group_no int"

    def fuse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank"]).reset_index(drop=True)
        v = np.stack(pdf[vector].to_numpy())
        names = [set(x) for x in pdf[sentence].str.findall(r"\b[A-Z][A-Za-z0-9-]+\b")]
        jac = np.array([[len(a & b) / len(a | b) if a | b else 0.0 for b in names] for a in names])
        edge = 0.6 * jac + 0.4 * (v @ v.T) > least
        group, n = [-1] * len(pdf), 0
        for i in range(len(pdf)):
            if group[i] < 0:
                for j in range(len(pdf)):
                    if group[j] < 0 and (j == i or edge[i, j]):
                        group[j] = n
                n += 1
        pdf["group_no"] = group
        return pdf

    return rows.groupBy(key).applyInPandas(fuse, schema)
