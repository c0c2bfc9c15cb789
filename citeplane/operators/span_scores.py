"""Span scoring: strict and maximum-overlap matching, precision, recall and F1, attribute accuracy.

Spans are rows (side 'pred' or 'gold', case_id, source_id, mention_type, pieces, attributes), pieces an array of
struct(start, end), attributes an array of struct(category, value) with value as type and text.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import spans as sp
from ..sources.scratch import Scratch

GROUP = ["case_id", "source_id", "mention_type"]


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One row for each side and position; the values of each attribute category are united.

    Every metric reads these rows, so they are written once.
    """
    base = spans.select("side", *GROUP, "pieces").distinct()
    values = spans.select("side", *GROUP, "pieces", F.explode("attributes").alias("a")).groupBy("side", *GROUP, "pieces", F.col("a.category").alias("category")).agg(F.array_sort(F.collect_set("a.value")).alias("values"))
    merged = values.groupBy("side", *GROUP, "pieces").agg(F.array_sort(F.collect_list(F.struct("category", "values"))).alias("attributes"))
    return Scratch(spans.sparkSession, "spans").keep(base.join(merged, ["side", *GROUP, "pieces"], "left"), "distinct")


def overlap_edges(spans: DataFrame, width: int = 4096) -> DataFrame:
    """Pairs (pred_pieces, gold_pieces) of a group that overlap in a piece.

    Pieces are cut into buckets of `width` code points, so the join is on equality and a long source is spread.
    """
    each = spans.select("side", *GROUP, "pieces", F.explode("pieces").alias("p"))
    cut = each.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("p.start") / width), F.floor((F.col("p.end") - 1) / width))))
    p, g = (cut.where(F.col("side") == s).select(*GROUP, "bucket", F.col("p").alias(f"{s}_p"), F.col("pieces").alias(f"{s}_pieces")) for s in ("pred", "gold"))
    near = p.join(g, [*GROUP, "bucket"]).where((F.col("pred_p.start") < F.col("gold_p.end")) & (F.col("gold_p.start") < F.col("pred_p.end")))
    return near.select(*GROUP, "pred_pieces", "gold_pieces").distinct()


def maximum_matching(edges: list[tuple[int, int]]) -> int:
    """Size of a largest one-to-one matching: layered shortest augmenting paths, without recursion."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    mate: dict[int, int] = {}
    owner: dict[int, int] = {}
    size = 0
    while True:
        depth = {a: 0 for a in out if a not in mate}
        queue, found = deque(depth), False
        while queue:
            a = queue.popleft()
            for b in out[a]:
                nxt = owner.get(b)
                if nxt is None:
                    found = True
                elif nxt not in depth:
                    depth[nxt] = depth[a] + 1
                    queue.append(nxt)
        if not found:
            return size
        place = {a: 0 for a in out}
        for root in [a for a in out if a not in mate]:
            path, taken = [root], []
            while path:
                a = path[-1]
                if place[a] == len(out[a]):
                    depth.pop(a, None)
                    path.pop()
                    if taken:
                        taken.pop()
                    continue
                b = out[a][place[a]]
                place[a] += 1
                nxt = owner.get(b)
                if nxt is None:
                    for x, y in zip(path, [*taken, b]):
                        mate[x], owner[y] = y, x
                    size += 1
                    break
                if depth.get(nxt) == depth.get(a, -2) + 1:
                    path.append(nxt)
                    taken.append(b)


def lenient_hits(spans: DataFrame) -> DataFrame:
    """Matched spans of each group (hits).

    A pair neither of whose spans overlaps another is matched as it is, natively; only what is left of a group, a
    single type in a single source, is matched in Python.
    """
    edges = overlap_edges(spans).select(*GROUP, F.xxhash64("pred_pieces").alias("a"), F.xxhash64("gold_pieces").alias("b"))
    for end in "ab":
        edges = edges.withColumn(f"{end}_degree", F.count(F.lit(1)).over(Window.partitionBy(*GROUP, end)))
    alone = (F.col("a_degree") == 1) & (F.col("b_degree") == 1)

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[GROUP].head(1).assign(hits=maximum_matching(list(zip(rows["a"].tolist(), rows["b"].tolist()))))

    sure = edges.where(alone).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("hits"))
    rest = edges.where(~alone).groupBy(*GROUP).applyInPandas(match, "case_id string, source_id string, mention_type string, hits long")
    return sure.unionByName(rest).groupBy(*GROUP).agg(F.sum("hits").alias("hits"))


def strict_hits(spans: DataFrame) -> DataFrame:
    """Spans of both sides at identical pieces, by group."""
    both = spans.groupBy(*GROUP, "pieces").agg(F.count_distinct("side").alias("sides")).where("sides = 2")
    return both.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("hits"))


def group_counts(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """tp, predicted and gold of each group."""
    sizes = spans.groupBy(*GROUP).agg(F.count_if(F.col("side") == "pred").alias("predicted"), F.count_if(F.col("side") == "gold").alias("gold"))
    return sizes.join(hits, GROUP, "left").select(*GROUP, F.coalesce("hits", F.lit(0)).cast("long").alias("tp"), "predicted", "gold")


def ratio_metrics(counts: DataFrame, prefix: str) -> DataFrame:
    """Micro, per-type and macro precision, recall and F1 as (name, numerator, denominator).

    Macro is the sum of the defined per-type ratios over their number.
    """
    per = counts.groupBy("mention_type").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("p"), F.sum("gold").alias("g"))
    listed = per.agg(F.collect_list(F.struct("mention_type", "tp", "p", "g")).alias("x"))  # one row for each mention type
    sums = [F.aggregate("x", F.lit(0).cast("long"), _adder(k)).alias(k) for k in ("tp", "p", "g")]
    total = F.struct(F.lit(None).cast("string").alias("mention_type"), *sums)
    parts = {"precision": lambda i: (i["tp"], i["p"]), "recall": lambda i: (i["tp"], i["g"]), "f1": lambda i: (2 * i["tp"], i["p"] + i["g"])}

    def metric(name, numerator, denominator):
        return F.struct(name.alias("name"), numerator.cast("double").alias("numerator"), denominator.cast("long").alias("denominator"))

    def rows(ratio: str):
        part = parts[ratio]
        each = F.transform(F.concat(F.array(total), F.col("x")), lambda i: metric(F.concat(F.lit(f"{prefix}_{ratio}"), F.coalesce(F.concat(F.lit(":"), i["mention_type"]), F.lit(""))), *part(i)))
        defined = F.filter("x", lambda i: part(i)[1] > 0)
        value = F.aggregate(defined, F.lit(0.0), lambda acc, i: acc + part(i)[0] / part(i)[1])
        return F.concat(each, F.array(metric(F.lit(f"{prefix}_macro_{ratio}"), value, F.size(defined))))

    return listed.select(F.explode(F.concat(*map(rows, parts))).alias("m")).select("m.*")


def _adder(key: str):
    return lambda acc, i: acc + i[key]


def attribute_accuracy(spans: DataFrame) -> DataFrame:
    """On strict matches, for each category that the reference assessed with one value: right and all."""
    each = spans.select("side", *GROUP, "pieces", F.explode_outer("attributes").alias("a")).select("side", *GROUP, "pieces", "a.category", sp.single(F.col("a.values")).alias("value"))
    gold = each.where("side = 'gold' AND value IS NOT NULL").select(*GROUP, "pieces", "category", F.col("value").alias("expected"))
    strict = spans.where("side = 'pred'").select(*GROUP, "pieces")
    mine = each.where("side = 'pred'").select(*GROUP, "pieces", "category", "value")
    scored = gold.join(strict, [*GROUP, "pieces"]).join(mine, [*GROUP, "pieces", "category"], "left")
    right = F.coalesce(F.col("value") == F.col("expected"), F.lit(False)).cast("long")
    per = scored.groupBy("category").agg(F.sum(right).alias("n"), F.count(F.lit(1)).alias("d"))
    listed = per.agg(F.collect_list(F.struct(F.concat(F.lit(":"), "category").alias("category"), "n", "d")).alias("x"))
    whole = F.struct(F.lit("").alias("category"), *(F.aggregate("x", F.lit(0).cast("long"), _adder(k)).alias(k) for k in "nd"))
    each = listed.select(F.explode(F.concat(F.array(whole), "x")).alias("m")).select("m.*")
    return each.select(F.concat(F.lit("attribute_accuracy"), "category").alias("name"), F.col("n").cast("double").alias("numerator"), F.col("d").alias("denominator"))


def span_metrics(spans: DataFrame) -> DataFrame:
    """All span metrics of two sides."""
    spans = distinct_spans(spans)
    strict = ratio_metrics(group_counts(spans, strict_hits(spans)), "strict")
    lenient = ratio_metrics(group_counts(spans, lenient_hits(spans)), "lenient")
    return strict.unionByName(lenient).unionByName(attribute_accuracy(spans))


def admitted(readings: DataFrame, covered: DataFrame) -> DataFrame:
    """Readings that scoring admits: none rejected; of mention types that a human-tier reference covers, gold and verified."""
    flagged = readings.join(covered.select("mention_type", F.lit(True).alias("_covered")).distinct(), "mention_type", "left")
    return flagged.where((F.col("status") != "rejected") & (F.col("_covered").isNull() | F.col("status").isin("gold", "verified"))).drop("_covered")


def in_cases(spans: DataFrame, cases: DataFrame) -> DataFrame:
    """Spans of scored cases only."""
    return spans.join(cases.select("case_id"), "case_id", "left_semi")
