"""Grounding: candidates against the exact text of their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ids, spans, text as tx


def status_of(text: Column, candidate: Column, hint: Column, starts: Column) -> Column:
    """What grounding finds, the first applicable code."""
    size = F.length(candidate)
    return (
        F.when(text.isNull(), "source_not_text")
        .when(size == 0, "empty_candidate")
        .when(hint.isNotNull() & ((hint < 0) | (hint + size > F.length(text))), "hint_out_of_bounds")
        .when(hint.isNotNull() & (F.substring(text, hint + 1, size) != candidate), "hint_mismatch")
        .when(hint.isNotNull(), "ok")
        .when(F.size(starts) == 0, "not_found")
        .when(F.size(starts) > 1, "ambiguous")
        .otherwise("ok")
    )


def ground(pairs: DataFrame) -> DataFrame:
    """Rows of (source_id, text, candidate, hint_start) with status, start, end, match_starts and inclusion_id.

    A hint is tried before ambiguity; only without one are all occurrences sought.
    """
    text, candidate, hint = F.col("text"), F.col("candidate"), F.col("hint_start").cast("int")
    found = pairs.withColumn("_starts", F.when(hint.isNull() & text.isNotNull(), tx.occurrences(text, candidate)))
    found = found.withColumn("status", status_of(text, candidate, hint, F.col("_starts")))
    start = F.when(F.col("status") == "ok", F.coalesce(hint, F.element_at("_starts", 1))).cast("long")
    found = found.withColumn("start", start).withColumn("end", F.col("start") + F.length(candidate))
    starts = F.when(F.col("status") == "ambiguous", F.col("_starts").cast("array<bigint>")).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    return found.withColumn("match_starts", starts).withColumn("inclusion_id", F.when(F.col("status") == "ok", ids.inclusion_id(F.col("source_id"), F.col("start"), F.col("end")))).drop("_starts", "text")


def containing_pairs(sources: DataFrame, candidates: DataFrame, gram: int = 12) -> DataFrame:
    """Pairs of a source (source_id, text) and a candidate that it contains, of any sources and any candidates.

    A source that holds a candidate holds each of its inner words as a word; candidates join the sources' distinct
    words on the longest of them, and only such pairs are tested. A candidate of fewer than three words joins on its
    first code points instead. No pair is made that shares nothing.
    """
    inner = F.split("candidate", " ")
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    longest = F.get(F.array_sort(F.filter(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))), lambda x: x["n"] < 0)), 0)["w"]
    keyed = candidates.where(F.length("candidate") > 0).withColumn("_key", longest)
    texts = sources.where(F.col("text").isNotNull())
    words = texts.select("source_id", F.explode(F.array_distinct(F.split("text", " "))).alias("_key"))
    pairs = words.join(keyed.where("_key IS NOT NULL"), "_key").drop("_key")
    short = keyed.where("_key IS NULL").withColumn("_key", F.substring("candidate", 1, gram))
    lengths = [r["n"] for r in short.select(F.length("_key").alias("n")).distinct().collect()]
    if lengths:
        grams = texts.select("source_id", F.explode(F.array_distinct(F.concat(*map(_grams, lengths)))).alias("_key"))
        pairs = pairs.unionByName(grams.join(short, "_key").drop("_key"))
    return sources.join(pairs, "source_id").where(F.contains("text", F.col("candidate")))


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(n)))


def mentions(grounded: DataFrame, sections: DataFrame) -> DataFrame:
    """Typed spans of grounded rows (mention_type, fragments): invalid fragments are a status; the section is the innermost."""
    error = spans.fragments_error(F.col("start"), F.col("end"), F.col("fragments"))
    out = grounded.withColumn("status", F.when((F.col("status") == "ok") & error.isNotNull(), "invalid_fragments").otherwise(F.col("status")))
    out = out.withColumn("mention_id", F.when(F.col("status") == "ok", ids.mention_id(F.col("source_id"), F.col("start"), F.col("end"), F.col("mention_type"), F.col("fragments"))))
    return out.join(innermost_section(out.where("status = 'ok'"), sections, "mention_id"), "mention_id", "left")


def innermost_section(items: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Category of the smallest section that contains each span (source_id, start, end), later start and category first.

    The join is on source_id; a source has few sections.
    """
    s = sections.select(F.col("source_id").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"), "category")
    held = items.select(key, "source_id", "start", "end").join(s, (F.col("source_id") == F.col("_s")) & (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b")))
    return held.groupBy(key).agg(F.min_by("category", F.struct(F.col("_b") - F.col("_a"), -F.col("_a"), F.col("category"))).alias("section_category"))


def cite(found: DataFrame, sources: DataFrame) -> DataFrame:
    """One inclusion for each piece of each mention, grounded again at its offset."""
    each = found.select("mention_id", "source_id", F.explode(spans.pieces(F.col("start"), F.col("end"), F.col("fragments"))).alias("p"))
    each = each.join(sources.select("source_id", "text"), "source_id").select("mention_id", "source_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"), tx.piece(F.col("text"), F.col("p.start").cast("int"), F.col("p.end").cast("int")).alias("quote"))
    return each.withColumn("inclusion_id", ids.inclusion_id(F.col("source_id"), F.col("start"), F.col("end")))


def outside_sections(cited: DataFrame, sections: DataFrame, allowed: DataFrame) -> DataFrame:
    """Cited spans (claim_id, variable, source_id, start, end) in no section that their variable allows.

    allowed: (variable, category); variables without a row allow any place.
    """
    rule = cited.join(allowed.select("variable").distinct(), "variable", "left_semi")
    s = sections.select(F.col("source_id").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"), "category").join(allowed.withColumnRenamed("variable", "_v"), "category")
    return rule.join(s, (F.col("source_id") == F.col("_s")) & (F.col("variable") == F.col("_v")) & (F.col("_a") <= F.col("start")) & (F.col("end") <= F.col("_b")), "left_anti")


def inclusion_errors(inclusions: DataFrame, sources: DataFrame) -> DataFrame:
    """evidence_id and code of each inclusion that its source does not bear out, the first code that applies."""
    joined = inclusions.join(sources.select("source_id", F.col("text").alias("_text"), F.col("excluded").alias("_excluded")), "source_id", "left")
    start, end = F.col("start"), F.col("end")
    code = (
        F.when(F.col("_text").isNull(), "invalid_context")
        .when(start.isNull() | end.isNull() | F.col("quote").isNull(), "invalid_schema")
        .when((start < 0) | (end <= start) | (end > F.length("_text")), "invalid_offsets")
        .when(tx.piece(F.col("_text"), start.cast("int"), end.cast("int")) != F.col("quote"), "quote_mismatch")
        .when(F.coalesce(F.col("alignment") != "exact", F.lit(True)) | F.coalesce(F.col("alignment_score") != 1.0, F.lit(True)), "invalid_alignment")
        .when(F.col("evidence_id") != ids.inclusion_id(F.col("source_id"), start, end), "content_mismatch")
        .when(F.col("_excluded").isNotNull() & spans.excluded(start, end, F.col("_excluded")), "excluded_span")
    )
    return joined.select("evidence_id", code.alias("code")).where("code IS NOT NULL")


def ranked(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
