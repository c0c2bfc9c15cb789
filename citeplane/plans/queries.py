"""One query for each operator family over the driver tables, with its DuckDB oracle.

The driver tables stand in for notes, annotations and references. What both sides derive from them (a stand-in) is one
SQL text in the common dialect, run by Spark under the operator and by DuckDB under the oracle; the operator itself is
DataFrame code on one side and independent SQL on the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, spans as sp, stats, text as tx
from ..operators import binary, cases, graph, grounding, policy, replay, results, rules, scores, span_scores
from ..sources import bundles, stores
from ..sources.tables import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations", "embeddings")


#: A quotient cast to a whole number: DuckDB rounds it, halves to the even one, where Spark's cast cuts off.
_QUOTIENT = re.compile(r"CAST\((\w+ / \w+) AS BIGINT\)")


def _spark(text: str) -> str:
    """A text in the common dialect as Spark is to read it, casts with DuckDB's results."""
    return _QUOTIENT.sub(r"CAST(rint(\1) AS BIGINT)", text)


class Tables:
    """The driver tables, and stand-ins by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        rows = self.sql(STAND_INS[name])
        return rows.withColumnRenamed("end_", "end")  # a reserved word of one of the dialects

    def sql(self, text: str) -> DataFrame:
        used = {n: self[n] for n in (*NAMES, *STAND_INS) if f"{{{n}}}" in text}
        return self.spark.sql(_spark(text), **used) if used else self.spark.sql(_spark(text))


def _plain(text: str) -> str:
    for n in (*NAMES, *STAND_INS):
        text = text.replace(f"{{{n}}}", n)
    return text


def _with(text: str) -> str:
    """DuckDB text: the stand-ins that it names, in the order of their definition, then itself."""
    need: set[str] = set()
    todo = [text]
    while todo:
        now = todo.pop()
        for n in STAND_INS:
            if f"{{{n}}}" in now and n not in need:
                need.add(n)
                todo.append(STAND_INS[n])
    head = ", ".join(f"{n} AS ({_plain(STAND_INS[n])})" for n in STAND_INS if n in need)
    body = _plain(text)
    if not head:
        return body
    return f"WITH RECURSIVE {head}, {body.removeprefix('WITH RECURSIVE ')}" if body.startswith("WITH RECURSIVE ") else f"WITH {head}, {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f"WITH {head} {body}"


def query(oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = _with(oracle)
        return f

    return add


#: Stand-ins in the common dialect.
STAND_INS = {
    "notes": "SELECT CAST(doc_id AS VARCHAR(20)) AS source_id, text, n_chars FROM {documents}",
    "items": "SELECT item_id, text AS candidate FROM {benchmark}",
    "sections": "SELECT CAST(doc_id AS VARCHAR(20)) AS source_id, CAST(0 AS BIGINT) AS start, n_chars AS end_, 'note' AS category FROM {documents} UNION ALL SELECT CAST(doc_id AS VARCHAR(20)), CAST(0 AS BIGINT), CAST(n_chars / 2 AS BIGINT), 'history' FROM {documents} UNION ALL SELECT CAST(doc_id AS VARCHAR(20)), CAST(n_chars / 4 AS BIGINT), CAST(n_chars / 2 AS BIGINT), 'findings' FROM {documents}",
    "marks": "SELECT doc_id AS mark_id, CAST(doc_id AS VARCHAR(20)) AS source_id, CAST((doc_id * 37) % 100 AS BIGINT) AS start, CAST((doc_id * 37) % 100 + 5 + doc_id % 11 AS BIGINT) AS end_, lang AS variable FROM {documents}",
    "gold_spans": "SELECT 'gold' AS side, CAST(doc_id AS VARCHAR(20)) AS case_id, source AS source_id, lang AS mention_type, CAST(k * 20 AS BIGINT) AS start, CAST(k * 20 + 8 AS BIGINT) AS end_, CASE WHEN (doc_id + k) % 3 = 0 THEN 'yes' ELSE 'no' END AS value FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) n",
    "pred_spans": "SELECT 'pred' AS side, CAST(doc_id AS VARCHAR(20)) AS case_id, source AS source_id, lang AS mention_type, CAST(k * 20 + (doc_id + k) % 4 * 3 AS BIGINT) AS start, CAST(k * 20 + 8 + (doc_id + k) % 4 * 3 AS BIGINT) AS end_, CASE WHEN (doc_id + k) % 2 = 0 THEN 'yes' ELSE 'no' END AS value FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 3) n WHERE doc_id % 7 <> 0",
    "eligible": "SELECT CAST(doc_id AS VARCHAR(20)) AS case_id FROM {documents}",
    "gold": "SELECT CAST(doc_id AS VARCHAR(20)) AS case_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE quality = 1 END AS value FROM {labels}",
    "predicted": "SELECT CAST(doc_id AS VARCHAR(20)) AS case_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'not_mentioned' ELSE 'answered' END AS status, CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN NULL ELSE n_chars % 4 <> 0 END AS value, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'parse' ELSE 'provider' END END AS failure_kind FROM {documents} WHERE doc_id % 13 <> 0",
    "references_": "SELECT CAST(doc_id AS VARCHAR(20)) AS record_id, CAST(l.doc_id AS VARCHAR(20)) AS case_id, CASE WHEN doc_id % 3 = 0 THEN 'silver' WHEN doc_id % 3 = 1 THEN 'single_review' ELSE 'adjudicated' END AS tier, CASE WHEN toxic = 1 THEN 'not_mentioned' ELSE 'answered' END AS status, CAST(quality AS VARCHAR(2)) AS value FROM {labels} l",
    "ann": "SELECT CAST(user_id AS VARCHAR(20)) AS case_id, lpad(CAST(event_id AS VARCHAR(20)), 12, '0') AS event_id, event_id AS seq, CAST(NULL AS VARCHAR(10)) AS variable, CASE WHEN event_id % 4 = 0 THEN 'adjudicator' ELSE 'reviewer' END AS role, concat('human:', CAST(event_id % 6 AS VARCHAR(4))) AS actor, CAST(event_id % 3 AS BIGINT) AS round, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS stream, CASE WHEN event_type = 'purchase' THEN 'adjudication.resolve' WHEN event_type = 'view' THEN 'review.submit' WHEN event_type = 'click' THEN 'edge.add' WHEN event_type = 'error' THEN 'edge.remove' ELSE 'outcome.set' END AS action, CASE WHEN event_type = 'purchase' AND event_id % 50 <> 1 THEN concat('t', CAST(event_id % 7 AS VARCHAR(4))) END AS target_id, value FROM {events}",
    "nodes": "SELECT '' AS case_id, concat('r', CAST(r_regionkey AS VARCHAR(12))) AS node_id, 'inclusion' AS kind, CAST(NULL AS VARCHAR(10)) AS status FROM {region} UNION ALL SELECT '', concat('n', CAST(n_nationkey AS VARCHAR(12))), 'inference', NULL FROM {nation} UNION ALL SELECT '', concat('c', CAST(c_custkey AS VARCHAR(12))), 'claim', CASE WHEN c_custkey % 10 = 0 THEN 'rejected' ELSE 'proposed' END FROM {customer} UNION ALL SELECT '', concat('o', CAST(o_orderkey AS VARCHAR(12))), 'claim', 'proposed' FROM {orders}",
    "deps": "SELECT '' AS case_id, concat('n', CAST(n_nationkey AS VARCHAR(12))) AS parent_id, concat('r', CAST(n_regionkey AS VARCHAR(12))) AS child_id FROM {nation} UNION ALL SELECT '', concat('c', CAST(c_custkey AS VARCHAR(12))), concat('n', CAST(c_nationkey AS VARCHAR(12))) FROM {customer} WHERE c_custkey % 17 <> 0 UNION ALL SELECT '', concat('o', CAST(o_orderkey AS VARCHAR(12))), concat('c', CAST(o_custkey AS VARCHAR(12))) FROM {orders}",
    "claims": "SELECT CAST(p_size AS VARCHAR(8)) AS case_id, CAST(p_partkey AS VARCHAR(20)) AS claim_id, CASE WHEN p_partkey % 3 = 0 THEN 'size' WHEN p_partkey % 3 = 1 THEN 'node' ELSE 'spread' END AS variable, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'S1' ELSE 'S2' END WHEN p_partkey % 3 = 1 THEN CASE WHEN (p_size + p_partkey / 1500) % 4 < 1 THEN 'N1' ELSE 'N0' END ELSE 'M0' END AS value, CASE WHEN p_partkey % 4 = 0 THEN 'rejected' ELSE 'proposed' END AS status FROM {part}",
    "policies": "SELECT r_regionkey AS dataset, CASE WHEN r_regionkey = 0 THEN 'synthetic' WHEN r_regionkey = 1 THEN 'deidentified' WHEN r_regionkey = 2 THEN 'limited' WHEN r_regionkey = 3 THEN 'phi' ELSE 'other' END AS sensitivity, r_regionkey % 2 = 0 AS no_training FROM {region}",
    "places": "SELECT n_nationkey AS place, CASE WHEN n_nationkey % 4 = 0 THEN 'local' WHEN n_nationkey % 4 = 1 THEN 'institution' WHEN n_nationkey % 4 = 2 THEN 'external_baa' ELSE 'external' END AS zone, n_nationkey % 3 = 0 AS trains, CASE WHEN n_nationkey % 5 = 0 THEN 'labels_only' ELSE 'derived_text' END AS payload FROM {nation}",
    "history": "SELECT CAST(user_id AS VARCHAR(20)) AS record_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'adjudicator' ELSE 'reviewer' END AS role, CASE WHEN event_type = 'view' THEN 'verified' WHEN event_type = 'click' THEN 'gold' WHEN event_type = 'purchase' THEN 'rejected' ELSE 'verified' END AS move, CASE WHEN event_id % 2 = 0 THEN 'because' END AS reason, CASE WHEN event_type = 'view' THEN 'silver' WHEN event_type = 'click' THEN 'single_review' ELSE 'adjudicated' END AS tier, CASE WHEN event_type = 'view' THEN 'importer' WHEN event_type = 'click' THEN 'reviewer' ELSE 'adjudicator' END AS tier_role FROM {events}",
}


def _spans(t: Tables) -> DataFrame:
    both = t["gold_spans"].unionByName(t["pred_spans"])
    return both.select("side", "case_id", "source_id", "mention_type", F.array(F.struct("start", "end")).alias("pieces"), F.array(F.struct(F.lit("negation").alias("category"), "value")).alias("attributes"))


_INC = """sha256(concat('{{"end":', CAST({e} AS VARCHAR), ',"source_id":"', {s}, '","start":', CAST({b} AS VARCHAR), '}}'))"""


@query(f"""WITH hits AS (SELECT n.source_id, i.item_id, length(i.candidate) AS m, list_filter(generate_series(1, length(n.text) - length(i.candidate) + 1), lambda k: substring(n.text, k, length(i.candidate)) = i.candidate) AS places FROM {{notes}} n JOIN {{items}} i ON contains(n.text, i.candidate) WHERE length(i.candidate) > 0)
SELECT source_id, item_id, CASE WHEN len(places) > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN len(places) = 1 THEN CAST(places[1] - 1 AS BIGINT) END AS start, CASE WHEN len(places) = 1 THEN {_INC.format(s='source_id', b='places[1] - 1', e='places[1] - 1 + m')} END AS inclusion_id FROM hits""")
def ground_exact(t: Tables) -> DataFrame:
    pairs = grounding.containing_pairs(t["notes"].select("source_id", "text"), t["items"])
    return grounding.ground(pairs.withColumn("hint_start", F.lit(None).cast("int"))).select("source_id", "item_id", "status", "start", "inclusion_id")


_HINT = "SELECT source_id, text, substring(text, 11, 15) AS candidate, CAST(CASE WHEN CAST(source_id AS BIGINT) % 5 = 0 THEN n_chars WHEN CAST(source_id AS BIGINT) % 3 = 0 THEN 11 ELSE 10 END AS INT) AS hint_start FROM {notes}"


@query(f"""WITH c AS ({_HINT}) SELECT source_id, CASE WHEN length(candidate) = 0 THEN 'empty_candidate' WHEN hint_start + length(candidate) > length(text) THEN 'hint_out_of_bounds' WHEN substring(text, hint_start + 1, length(candidate)) <> candidate THEN 'hint_mismatch' ELSE 'ok' END AS status FROM c""")
def ground_hint(t: Tables) -> DataFrame:
    return grounding.ground(t.sql(_HINT)).select("source_id", "status")


@query("""WITH c AS (SELECT text, substring(text, 1, 7) AS candidate FROM {notes}), s AS (SELECT CASE WHEN length(candidate) = 0 THEN 'empty_candidate' WHEN contains(substring(text, 2), candidate) THEN 'ambiguous' ELSE 'ok' END AS status FROM c) SELECT status, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY status""")
def ground_failures(t: Tables) -> DataFrame:
    rows = t.sql("SELECT source_id, text, substring(text, 1, 7) AS candidate, CAST(NULL AS INT) AS hint_start FROM {notes}")
    return grounding.ground(rows).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT mark_id, {_INC.format(s='source_id', b='start', e='end_')} AS inclusion_id, sha256(concat('{{{{"end":', CAST(end_ AS VARCHAR), ',"mention_type":"', variable, '","source_id":"', source_id, '","start":', CAST(start AS VARCHAR), '}}}}')) AS mention_id FROM {{marks}}""".replace("{{", "{").replace("}}", "}"))
def content_ids(t: Tables) -> DataFrame:
    return t["marks"].select("mark_id", ids.inclusion_id(F.col("source_id"), F.col("start"), F.col("end")).alias("inclusion_id"), ids.mention_id(F.col("source_id"), F.col("start"), F.col("end"), F.col("variable")).alias("mention_id"))


@query("SELECT doc_id, sha256(text) AS text_hash, CAST(length(text) AS BIGINT) AS code_points FROM {documents}")
def text_hash(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", bundles.text_hash(F.col("text")).alias("text_hash"), F.length("text").cast("long").alias("code_points"))


@query("""WITH j AS (SELECT m.mark_id, s.category, row_number() OVER (PARTITION BY m.mark_id ORDER BY s.end_ - s.start, s.start DESC, s.category) AS r FROM {marks} m JOIN {sections} s ON m.source_id = s.source_id AND s.start <= m.start AND m.end_ <= s.end_) SELECT mark_id, category AS section_category FROM j WHERE r = 1""")
def section_innermost(t: Tables) -> DataFrame:
    return grounding.innermost_section(t["marks"], t["sections"], "mark_id")


@query("""SELECT CAST(mark_id AS VARCHAR) AS claim_id FROM {marks} m WHERE variable IN ('fr', 'de') AND NOT EXISTS (SELECT 1 FROM {sections} s WHERE s.source_id = m.source_id AND s.category = CASE WHEN m.variable = 'fr' THEN 'findings' ELSE 'history' END AND s.start <= m.start AND m.end_ <= s.end_)""")
def section_required(t: Tables) -> DataFrame:
    cited = t["marks"].withColumn("claim_id", F.col("mark_id").cast("string"))
    allowed = t.spark.createDataFrame([("fr", "findings"), ("de", "history")], "variable string, category string")
    return grounding.outside_sections(cited, t["sections"], allowed).select("claim_id")


@query("""SELECT mark_id, (start < 30 AND 20 < end_) OR (start < 90 AND 70 < end_) AS excluded FROM {marks}""")
def excluded_spans(t: Tables) -> DataFrame:
    intervals = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((20, 30), (70, 90))))
    return t["marks"].select("mark_id", sp.excluded(F.col("start"), F.col("end"), intervals).alias("excluded"))


_PRF = """WITH a AS (SELECT DISTINCT side, case_id, source_id, mention_type, start, end_ FROM {gold_spans} UNION ALL SELECT DISTINCT side, case_id, source_id, mention_type, start, end_ FROM {pred_spans}),
p AS (SELECT g.mention_type, count(*) AS tp FROM a g JOIN a q ON g.side = 'gold' AND q.side = 'pred' AND g.case_id = q.case_id AND g.source_id = q.source_id AND g.mention_type = q.mention_type AND MATCH GROUP BY g.mention_type),
c AS (SELECT a.mention_type, coalesce(max(p.tp), 0) AS tp, count(*) FILTER (WHERE side = 'pred') AS pr, count(*) FILTER (WHERE side = 'gold') AS go FROM a LEFT JOIN p ON a.mention_type = p.mention_type GROUP BY a.mention_type),
s AS (SELECT mention_type, tp, pr, go FROM c UNION ALL SELECT NULL, sum(tp), sum(pr), sum(go) FROM c),
l AS (SELECT mention_type, 'precision' AS ratio, tp AS num, pr AS den FROM s UNION ALL SELECT mention_type, 'recall', tp, go FROM s UNION ALL SELECT mention_type, 'f1', 2 * tp, pr + go FROM s)
SELECT concat('NAME_', ratio, CASE WHEN mention_type IS NULL THEN '' ELSE concat(':', mention_type) END) AS name, round(CAST(num AS DOUBLE), 6) AS numerator, CAST(den AS BIGINT) AS denominator FROM l
UNION ALL SELECT concat('NAME_macro_', ratio), round(coalesce(sum(CAST(num AS DOUBLE) / nullif(den, 0)), 0), 6), CAST(count(nullif(den, 0)) AS BIGINT) FROM l WHERE mention_type IS NOT NULL GROUP BY ratio"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("name", F.round("numerator", 6).alias("numerator"), "denominator")


@query(_PRF.replace("MATCH", 'g.start = q.start AND g.end_ = q.end_').replace("NAME", "strict"))
def span_prf_strict(t: Tables) -> DataFrame:
    spans = span_scores.distinct_spans(_spans(t))
    return _rounded(span_scores.ratio_metrics(span_scores.group_counts(spans, span_scores.strict_hits(spans)), "strict"))


@query(_PRF.replace("MATCH", 'g.start < q.end_ AND q.start < g.end_').replace("NAME", "lenient"))
def span_prf_lenient(t: Tables) -> DataFrame:
    """The stand-in's spans each overlap at most one of the other side, so pairs are the maximum matching."""
    spans = span_scores.distinct_spans(_spans(t))
    return _rounded(span_scores.ratio_metrics(span_scores.group_counts(spans, span_scores.lenient_hits(spans)), "lenient"))


@query("""SELECT DISTINCT g.case_id, p.start AS pred_start, g.start AS gold_start FROM {gold_spans} g JOIN {pred_spans} p ON g.case_id = p.case_id AND g.source_id = p.source_id AND g.mention_type = p.mention_type AND g.start < p.end_ AND p.start < g.end_ """)
def span_overlap_edges(t: Tables) -> DataFrame:
    edges = span_scores.overlap_edges(_spans(t), width=16)
    return edges.select("case_id", F.col("pred_pieces")[0]["start"].alias("pred_start"), F.col("gold_pieces")[0]["start"].alias("gold_start"))


@query("""WITH s AS (SELECT CASE WHEN p.value = g.value THEN 1 ELSE 0 END AS hit FROM {gold_spans} g JOIN {pred_spans} p ON g.case_id = p.case_id AND g.source_id = p.source_id AND g.mention_type = p.mention_type AND g.start = p.start AND g.end_ = p.end_) SELECT 'attribute_accuracy' AS name, CAST(sum(hit) AS DOUBLE) AS numerator, CAST(count(*) AS BIGINT) AS denominator FROM s UNION ALL SELECT 'attribute_accuracy:negation', CAST(sum(hit) AS DOUBLE), CAST(count(*) AS BIGINT) FROM s""")
def attribute_accuracy(t: Tables) -> DataFrame:
    return span_scores.attribute_accuracy(span_scores.distinct_spans(_spans(t)))


def _rows(t: Tables) -> DataFrame:
    return binary.joined(t["eligible"], t["gold"], t["predicted"])


_COUNTS = """c AS (SELECT count(*) AS "N", count(g.value) AS "B", count(*) FILTER (WHERE g.value) AS "P", count(*) FILTER (WHERE NOT g.value) AS "Q", count(*) FILTER (WHERE p.status = 'answered' AND p.value IS NOT NULL) AS "A", count(*) FILTER (WHERE p.status = 'answered' AND p.value = g.value) AS "C", count(*) FILTER (WHERE p.status = 'answered' AND p.value) AS "A_pos", count(*) FILTER (WHERE p.status = 'answered' AND p.value AND g.value) AS "TP", count(*) FILTER (WHERE p.status = 'answered' AND p.value) - count(*) FILTER (WHERE p.status = 'answered' AND p.value AND g.value) AS "FP", count(*) FILTER (WHERE g.value IS NOT NULL AND (p.status IS NULL OR p.status <> 'answered' OR p.value IS NULL)) AS "O", count(p.failure_kind) AS failures, count(*) FILTER (WHERE p.case_id IS NULL) AS unattempted, count(*) FILTER (WHERE g.case_id IS NULL) AS missing_gold FROM {eligible} e LEFT JOIN {gold} g ON e.case_id = g.case_id LEFT JOIN {predicted} p ON e.case_id = p.case_id)"""


@query(f"WITH {_COUNTS} SELECT * FROM c")
def binary_counts(t: Tables) -> DataFrame:
    return binary.counts(_rows(t))


_MEASURES = """m AS (SELECT 'precision' AS name, "C" AS a, "A" AS b FROM c UNION ALL SELECT 'ppv', "TP", "A_pos" FROM c UNION ALL SELECT 'recall', "TP", "P" FROM c UNION ALL SELECT 'omission_rate', "O", "B" FROM c UNION ALL SELECT 'coverage', "A", "N" FROM c UNION ALL SELECT 'correct_yield', "C", "N" FROM c)"""


@query(f"""WITH {_COUNTS}, {_MEASURES}, w AS (SELECT name, CAST(a AS DOUBLE) AS x, CAST(b AS DOUBLE) AS n, 1.959963984540054 AS z FROM m)
SELECT name, round(x / nullif(n, 0), 9) AS value, round(greatest(0.0, (x / n + z * z / (2 * n) - z * sqrt((x / n * (1 - x / n)) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS low, round(least(1.0, (x / n + z * z / (2 * n) + z * sqrt((x / n * (1 - x / n)) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) AS high FROM w
UNION ALL SELECT 'false_positives', CASE WHEN "Q" > 0 THEN CAST("FP" AS DOUBLE) END, NULL, NULL FROM c UNION ALL SELECT 'execution_failures', CAST(failures AS DOUBLE), NULL, NULL FROM c""")
def binary_measures(t: Tables) -> DataFrame:
    m = binary.with_wilson(binary.measures(binary.counts(_rows(t))))
    return m.select("name", *(F.round(c, 9).alias(c) for c in ("value", "low", "high")))


_GATES = [("precision floor", "precision", "ge", 0.6), ("recall floor", "recall", "ge", 0.99), ("omission ceiling", "omission_rate", "le", 0.5), ("unknown", "nothing", "ge", 0.1)]


@query(f"""WITH {_COUNTS}, {_MEASURES}, g AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in _GATES)}) v(name, measure, op, threshold)), r AS (SELECT g.name, CASE WHEN g.op = 'ge' THEN CAST(a AS DOUBLE) / nullif(b, 0) >= g.threshold ELSE CAST(a AS DOUBLE) / nullif(b, 0) <= g.threshold END AS observed_pass FROM g LEFT JOIN m ON g.measure = m.name)
SELECT name, CASE WHEN observed_pass IS NULL THEN 'inconclusive' WHEN observed_pass THEN 'met' ELSE 'unmet' END AS status, observed_pass FROM r""")
def gates(t: Tables) -> DataFrame:
    specs = t.spark.createDataFrame(_GATES, "name string, measure string, op string, threshold double")
    return binary.gates(specs, binary.measures(binary.counts(_rows(t))), provisional=False, label_only=False).select("name", "status", "observed_pass")


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    return binary.bootstrap(_rows(t))


@query("""WITH v AS (SELECT source AS name, CAST(n_chars AS DOUBLE) AS value FROM {documents}) SELECT name, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM v GROUP BY name""")
def percentiles(t: Tables) -> DataFrame:
    v = t["documents"].select(F.col("source").alias("name"), F.col("n_chars").cast("double").alias("value"))
    return v.groupBy("name").agg(F.round(stats.percentile("value", 0.025), 6).alias("low"), F.round(stats.percentile("value", 0.975), 6).alias("high"))


def _labelled(t: Tables) -> tuple[DataFrame, DataFrame]:
    ref = t.sql("SELECT r.case_id, d.lang AS variable, r.status, CASE WHEN r.status = 'answered' THEN array(r.value) ELSE CAST(array() AS array<string>) END AS values, CAST(NULL AS boolean) AS overlaps FROM {references_} r JOIN {documents} d ON CAST(d.doc_id AS VARCHAR(20)) = r.case_id")
    pred = t.sql("SELECT p.case_id, d.lang AS variable, p.status, CASE WHEN p.value THEN array('1') WHEN NOT p.value THEN array('0') ELSE CAST(array() AS array<string>) END AS values FROM {predicted} p JOIN {documents} d ON CAST(d.doc_id AS VARCHAR(20)) = p.case_id")
    return ref, pred


@query("""WITH j AS (SELECT d.lang AS variable, r.status, r.value, p.case_id AS found, p.status AS ps, CASE WHEN p.value THEN '1' WHEN NOT p.value THEN '0' END AS pv FROM {references_} r JOIN {documents} d ON CAST(d.doc_id AS VARCHAR) = r.case_id LEFT JOIN {predicted} p ON p.case_id = r.case_id),
e AS (SELECT 'label_accuracy' AS name, variable, CASE WHEN found IS NOT NULL AND ps = status AND (status <> 'answered' OR coalesce(pv = value, false)) THEN 1 ELSE 0 END AS hit FROM j UNION ALL SELECT 'coverage', variable, CASE WHEN found IS NOT NULL AND ps <> 'failed' THEN 1 ELSE 0 END FROM j UNION ALL SELECT 'omissions', variable, CASE WHEN found IS NULL OR ps <> 'answered' THEN 1 ELSE 0 END FROM j WHERE status = 'answered')
SELECT name, CASE WHEN name = 'coverage' THEN 'coverage' ELSE 'label' END AS kind, variable, CAST(sum(hit) AS DOUBLE) AS numerator, CAST(count(*) AS BIGINT) AS denominator FROM e GROUP BY GROUPING SETS ((name), (name, variable))""")
def label_tallies(t: Tables) -> DataFrame:
    return scores.label_tallies(*_labelled(t))


@query("""WITH o AS (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'answered' ELSE 'not_mentioned' END AS status, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'parse' ELSE 'budget' END END AS failure_kind FROM {events}), d AS (SELECT count(*) AS d FROM o)
SELECT status AS name, CAST(count(*) AS DOUBLE) AS numerator, CAST(max(d) AS BIGINT) AS denominator FROM o, d WHERE status IN ('answered', 'failed') GROUP BY status UNION ALL SELECT concat('failed:', failure_kind), CAST(count(*) AS DOUBLE), CAST(max(d) AS BIGINT) FROM o, d WHERE failure_kind IS NOT NULL GROUP BY failure_kind UNION ALL SELECT 'grounding_failures_per_case', CAST(sum(user_id % 3) AS DOUBLE), CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT user_id FROM {events})""")
def structural_validity(t: Tables) -> DataFrame:
    outcomes = t.sql("SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'answered' ELSE 'not_mentioned' END AS status, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'parse' ELSE 'budget' END END AS failure_kind FROM {events}")
    return scores.structural_validity(outcomes, t.sql("SELECT DISTINCT user_id, user_id % 3 AS grounding_failures FROM {events}"))


@query("""SELECT CAST(user_id AS VARCHAR) AS case_id, CASE min(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END) WHEN 1 THEN 'failed' WHEN 2 THEN 'conflicting_evidence' WHEN 3 THEN 'insufficient_evidence' WHEN 4 THEN 'not_mentioned' ELSE 'answered' END AS status FROM {events} GROUP BY user_id""")
def case_status(t: Tables) -> DataFrame:
    rows = t.sql("SELECT CAST(user_id AS VARCHAR(20)) AS case_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'conflicting_evidence' WHEN 'signup' THEN 'insufficient_evidence' WHEN 'view' THEN 'not_mentioned' ELSE 'answered' END AS status FROM {events}")
    return scores.case_status(rows)


@query("SELECT tier, CAST(count(*) AS BIGINT) AS n FROM {references_} GROUP BY tier")
def tier_mix(t: Tables) -> DataFrame:
    return scores.tier_mix(t["references_"])


_PRODUCERS = "SELECT CAST(doc_id AS VARCHAR(20)) AS record_id, CASE WHEN doc_id % 4 = 0 THEN concat('rule:', source, '@1+h', CAST(doc_id AS VARCHAR(20))) WHEN doc_id % 4 = 1 THEN concat('model:', source, '@2') WHEN doc_id % 4 = 2 THEN concat('human:', source) ELSE concat('tool:', source) END AS producer, CASE WHEN doc_id % 3 = 0 THEN 'adjudicated' ELSE 'silver' END AS tier FROM {documents}"


@query(f"""WITH p AS ({_PRODUCERS}), k AS (SELECT record_id, tier, CASE WHEN producer LIKE 'rule:%' THEN regexp_replace(producer, '\\+.*$', '') WHEN producer LIKE 'model:%' THEN producer END AS key FROM p) SELECT DISTINCT record_id FROM k WHERE tier = 'silver' AND key IN (SELECT key FROM k WHERE key IS NOT NULL AND CAST(record_id AS BIGINT) % 10 = 0)""")
def self_reference(t: Tables) -> DataFrame:
    rows = t.sql(_PRODUCERS)
    return scores.self_references(rows.where("CAST(record_id AS BIGINT) % 10 = 0"), rows)


@query(f"""WITH p AS ({_PRODUCERS}) SELECT record_id, split_part(producer, ':', 1) AS kind, regexp_extract(producer, ':([^@+]+)', 1) AS name, nullif(regexp_extract(producer, '@([^+]+)', 1), '') AS version, nullif(regexp_extract(producer, '\\+(.+)$', 1), '') AS hash FROM p""")
def producers(t: Tables) -> DataFrame:
    return t.sql(_PRODUCERS).select("record_id", ids.parse_producer(F.col("producer")).alias("p")).select("record_id", "p.*")


_METRIC = "SELECT source AS name, CAST(sum(CASE WHEN n_chars % 4 <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS numerator, CAST(count(*) AS BIGINT) AS denominator FROM {documents} WHERE doc_id % 2 = K GROUP BY source"


@query(f"""WITH b AS ({_METRIC.replace('K', '0')}), n AS ({_METRIC.replace('K', '1')}) SELECT b.name, CASE WHEN n.name IS NULL THEN 'missing' WHEN n.numerator / n.denominator < b.numerator / b.denominator - 0.005 - 1e-14 THEN 'regressed' ELSE 'passed' END AS status, round(b.numerator / b.denominator, 9) AS baseline, round(n.numerator / n.denominator, 9) AS "current" FROM b LEFT JOIN n ON b.name = n.name AND n.name <> 'src3' WHERE b.name <> 'src4'""")
def regression_compare(t: Tables) -> DataFrame:
    base = scores.baseline_from(t.sql(_METRIC.replace("K", "0")).where("name <> 'src4'"))
    return scores.compare(t.sql(_METRIC.replace("K", "1")).where("name <> 'src3'"), base).select("name", "status", F.round("baseline", 9).alias("baseline"), F.round("current", 9).alias("current"))


_REACH = "WITH RECURSIVE reach(root_id, node_id) AS (SELECT parent_id, child_id FROM {deps} UNION SELECT r.root_id, d.child_id FROM reach r JOIN {deps} d ON r.node_id = d.parent_id)"


@query(f"{_REACH} SELECT root_id, node_id FROM reach")
def support_closure(t: Tables) -> DataFrame:
    return graph.closure(t["deps"]).select("root_id", "node_id")


@query(f"{_REACH} SELECT r.root_id, r.node_id FROM reach r JOIN {{nodes}} n ON n.node_id = r.node_id AND n.kind = 'inclusion'")
def source_leaves(t: Tables) -> DataFrame:
    return graph.source_leaves(graph.closure(t["deps"]), t["nodes"]).select("root_id", "node_id")


@query(f"{_REACH} SELECT DISTINCT r.root_id AS node_id FROM reach r JOIN {{nodes}} x ON x.node_id = r.node_id AND x.kind = 'claim' AND x.status = 'rejected' JOIN {{nodes}} l ON l.node_id = r.root_id AND l.kind = 'claim' AND l.status <> 'rejected'")
def live_support(t: Tables) -> DataFrame:
    return graph.unsupported(graph.closure(t["deps"]), t["nodes"]).select("node_id")


@query("""WITH c AS (SELECT node_id FROM {nodes} WHERE node_id LIKE 'c%' AND CAST(substring(node_id, 2) AS BIGINT) % 17 = 0), o AS (SELECT d.parent_id AS node_id FROM {deps} d WHERE d.child_id IN (SELECT node_id FROM c)) SELECT node_id, 'orphaned_claim' AS code FROM c UNION ALL SELECT node_id, 'orphaned_claim' FROM o UNION ALL SELECT 'x1', 'cycle' UNION ALL SELECT 'x2', 'cycle' UNION ALL SELECT 'x3', 'cycle'""")
def acyclic_backed(t: Tables) -> DataFrame:
    more = t.spark.createDataFrame([("", f"x{i}", "claim", None) for i in (1, 2, 3)], "case_id string, node_id string, kind string, status string")
    edges = t.spark.createDataFrame([("", "x1", "x2"), ("", "x2", "x1"), ("", "x3", "x1"), ("", "x3", "r0")], "case_id string, parent_id string, child_id string")
    return graph.peel(t["nodes"].unionByName(more), t["deps"].unionByName(edges)).select("node_id", "code")


@query(f"{_REACH} SELECT DISTINCT r.root_id AS node_id, r.node_id AS case_id FROM reach r WHERE r.node_id LIKE 'r%' UNION SELECT node_id, node_id FROM {{nodes}} WHERE kind = 'inclusion'")
def case_propagation(t: Tables) -> DataFrame:
    seeds = t["nodes"].where("kind = 'inclusion'").select("node_id", F.col("node_id").alias("case_id"))
    return graph.propagate_case(seeds, t["deps"])


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 'unknown_reference' AS code FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 100 <> 0)")
def integrity_violations(t: Tables) -> DataFrame:
    lines = t["lineitem"].select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return graph.dangling(lines, ["l_orderkey"], t["orders"].where("o_orderkey % 100 <> 0"), ["o_orderkey"])


@query("SELECT '' AS case_id, node_id, CAST(2 AS BIGINT) AS uses FROM {nodes} WHERE kind = 'inference'")
def repeated_ids(t: Tables) -> DataFrame:
    return graph.repeated_ids(t["nodes"], t["nodes"].where("kind = 'inference'"))


@query("""WITH e AS (SELECT case_id, event_id, action, seq % 9 AS edge FROM {ann} WHERE action IN ('edge.add', 'edge.remove')) SELECT case_id, CAST(edge AS VARCHAR) AS claim_id FROM e GROUP BY case_id, edge HAVING arg_max(action, event_id) = 'edge.add'""")
def live_edges(t: Tables) -> DataFrame:
    events = t["ann"].withColumn("after", F.concat(F.lit('{"edge":{"claim_id":"'), (F.col("seq") % 9).cast("string"), F.lit('","evidence_id":"e"}}'))).withColumn("before", F.lit(None).cast("string"))
    return replay.live_edges(events).select("case_id", "claim_id")


@query("""WITH r AS (SELECT case_id, round, bool_or(action = 'adjudication.resolve' AND target_id IS NULL) AS resolved FROM {ann} GROUP BY case_id, round) SELECT a.event_id FROM {ann} a JOIN r ON a.case_id = r.case_id AND a.round = r.round WHERE r.resolved OR a.stream = 'a' OR (a.stream IS NULL AND a.role <> 'adjudicator')""")
def visible_events(t: Tables) -> DataFrame:
    return replay.visible(t["ann"], "reviewer", ("a",)).select("event_id")


@query("""WITH q AS (SELECT case_id, min(event_id) AS a, max(event_id) AS b FROM {ann} GROUP BY case_id) SELECT q.case_id, q.a AS as_of, CAST(1 AS BIGINT) AS events FROM q UNION SELECT q.case_id, q.b, CAST(count(*) AS BIGINT) FROM q JOIN {ann} x ON x.case_id = q.case_id AND x.event_id <= q.b GROUP BY q.case_id, q.b""")
def as_of_prefix(t: Tables) -> DataFrame:
    ends = t["ann"].groupBy("case_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    asked = ends.select("case_id", F.explode(F.array("a", "b")).alias("as_of")).distinct()
    return replay.as_of(asked, t["ann"]).groupBy("case_id", "as_of").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT case_id, max(event_id) AS as_of FROM {ann} GROUP BY case_id")
def current_snapshot(t: Tables) -> DataFrame:
    return replay.latest(t["ann"])


@query("""WITH p AS (SELECT case_id, event_id, lag(event_id) OVER (PARTITION BY case_id ORDER BY seq % 100, seq) AS b FROM {ann}) SELECT case_id, event_id FROM p WHERE b >= event_id""")
def event_order_check(t: Tables) -> DataFrame:
    rows = t["ann"].withColumn("position", F.struct(F.col("seq") % 100, "seq"))
    return replay.order_errors(rows, "position").select("case_id", "event_id")


@query("SELECT case_id, arg_max(actor, event_id) AS adjudicator FROM {ann} WHERE action = 'adjudication.resolve' AND target_id IS NULL GROUP BY case_id")
def last_resolver(t: Tables) -> DataFrame:
    return replay.last_resolver(t["ann"])


@query("""WITH f AS (SELECT case_id, actor, min(event_id) AS f FROM {ann} GROUP BY case_id, actor) SELECT case_id, string_agg(actor, ',' ORDER BY f) AS annotators FROM f GROUP BY case_id""")
def first_seen_actors(t: Tables) -> DataFrame:
    return replay.annotators(t["ann"]).select("case_id", F.array_join("annotators", ",").alias("annotators"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY event_id) AS BIGINT) AS ordinal FROM {ann}")
def event_ordinals(t: Tables) -> DataFrame:
    return replay.numbered(t["ann"], "event_id").select("event_id", "ordinal")


_MOVES = """(s.status = 'proposed' AND m.role = 'reviewer' AND m.move IN ('verified', 'rejected')) OR (m.role = 'adjudicator' AND ((s.status IN ('proposed', 'verified') AND m.move IN ('gold', 'rejected')) OR (s.status = 'gold' AND m.move = 'rejected' AND m.reason IS NOT NULL)))"""


@query(f"""WITH RECURSIVE m AS (SELECT record_id, seq, role, move, reason, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS i FROM {{history}}), s(record_id, i, status, error_seq) AS (SELECT DISTINCT record_id, CAST(0 AS BIGINT), 'proposed', CAST(NULL AS BIGINT) FROM m UNION ALL SELECT s.record_id, m.i, CASE WHEN s.error_seq IS NULL AND ({_MOVES}) THEN m.move ELSE s.status END, CASE WHEN s.error_seq IS NULL AND NOT ({_MOVES}) THEN m.seq ELSE s.error_seq END FROM s JOIN m ON m.record_id = s.record_id AND m.i = s.i + 1) SELECT record_id, arg_max(status, i) AS status, max(error_seq) AS error_seq FROM s GROUP BY record_id""")
def status_machine(t: Tables) -> DataFrame:
    return replay.status_machine(t["history"].withColumnRenamed("move", "to"))


@query("""WITH r AS (SELECT record_id, seq, CASE tier WHEN 'silver' THEN 1 WHEN 'single_review' THEN 2 ELSE 3 END AS rank FROM {history}), p AS (SELECT record_id, seq, rank, max(rank) OVER (PARTITION BY record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r) SELECT record_id, seq, CASE WHEN rank <= top THEN 'invalid_transition' END AS code FROM p""")
def tier_machine(t: Tables) -> DataFrame:
    return replay.tier_machine(t["history"].select("record_id", "seq", "tier", F.col("tier_role").alias("role"))).select("record_id", "seq", "code")


def _folded(t: Tables) -> DataFrame:
    """A claim of each event's case that is created, reviewed and adjudicated as event types have it."""
    e = t["events"].select(F.col("user_id").cast("string").alias("case_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), "event_type")
    claim = F.concat(F.lit("k"), F.col("case_id"))
    first = e.groupBy("case_id").agg(F.min("event_id").alias("first"))
    e = e.join(first, "case_id").withColumn("new", F.col("event_id") == F.col("first"))
    made = F.concat(F.lit('{"claim":{"claim_id":"'), claim, F.lit('","status":"proposed","provenance":{"producer":"model:m"}}}'))
    action = F.when(F.col("new"), "claim.create").when(F.col("event_type") == "view", "claim.set_status").when(F.col("event_type") == "purchase", "adjudication.resolve").otherwise("review.submit")
    after = F.when(F.col("new"), made).when(action == "claim.set_status", '{"status":"verified"}').when(action == "adjudication.resolve", '{"status":"gold"}')
    role = F.when(F.col("new"), "importer").when(action == "adjudication.resolve", "adjudicator").otherwise("reviewer")
    return e.select("case_id", "event_id", F.lit(None).cast("string").alias("variable"), F.lit("human:a").alias("actor"), role.alias("role"), action.alias("action"), F.when(action.isin("claim.set_status", "adjudication.resolve"), claim).alias("target_id"), F.lit(None).cast("string").alias("before"), after.alias("after"), F.lit(None).cast("string").alias("reason"))


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS case_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {events}), s(case_id, i, status, error_event) AS (SELECT case_id, CAST(1 AS BIGINT), 'proposed', CAST(NULL AS VARCHAR) FROM e WHERE i = 1 UNION ALL SELECT s.case_id, e.i, CASE WHEN s.error_event IS NULL AND e.event_type = 'view' AND s.status = 'proposed' THEN 'verified' WHEN s.error_event IS NULL AND e.event_type = 'purchase' AND s.status IN ('proposed', 'verified') THEN 'gold' ELSE s.status END, CASE WHEN s.error_event IS NULL AND ((e.event_type = 'view' AND s.status <> 'proposed') OR (e.event_type = 'purchase' AND s.status NOT IN ('proposed', 'verified'))) THEN e.event_id ELSE s.error_event END FROM s JOIN e ON e.case_id = s.case_id AND e.i = s.i + 1) SELECT case_id, arg_max(status, i) AS status, max(error_event) AS error_event, CASE WHEN max(error_event) IS NOT NULL THEN 'invalid_transition' END AS error_code FROM s GROUP BY case_id""")
def replay_full(t: Tables) -> DataFrame:
    out = replay.replay(_folded(t))
    status = F.get_json_object("state", "$.claims")
    return out.select("case_id", F.regexp_extract(status, r':\s*"([a-z]+)"', 1).alias("status"), "error_event", "error_code")


@query("""SELECT CAST(count(*) AS BIGINT) AS reviews, CAST(count(*) FILTER (WHERE event_id % 4 <> 0) AS BIGINT) AS timed, round(sum(CASE WHEN event_id % 4 <> 0 THEN value ELSE 0 END), 4) AS active_seconds, round(CAST(0 AS DOUBLE), 4) AS idle_seconds, false AS complete FROM {events} WHERE event_type = 'view'""")
def review_effort(t: Tables) -> DataFrame:
    after = F.when(F.col("event_id") % 4 != 0, F.to_json(F.struct(F.col("value").alias("active_seconds"))))
    events = t["events"].select(F.when(F.col("event_type") == "view", "review.submit").otherwise("x").alias("action"), after.alias("after"))
    return binary.review_effort(events).select("reviews", "timed", F.round("active_seconds", 4).alias("active_seconds"), F.round("idle_seconds", 4).alias("idle_seconds"), "complete")


@query("""SELECT dataset, CAST(place AS BIGINT) AS place, CASE WHEN sensitivity = 'other' THEN 'unknown_sensitivity' WHEN NOT (sensitivity = 'synthetic' OR zone IN ('local', 'institution') OR (sensitivity = 'deidentified' AND zone = 'external_baa')) THEN 'zone_not_allowed' WHEN payload <> 'labels_only' AND place % 7 = 0 THEN 'payload_not_accepted' WHEN no_training AND trains THEN 'restriction_training' ELSE 'ok' END AS reason FROM {policies} CROSS JOIN {places}""")
def policy_decisions(t: Tables) -> DataFrame:
    rows = t["policies"].crossJoin(F.broadcast(t["places"]))
    none, texts = F.expr("CAST(array() AS array<string>)"), F.array(F.lit("labels_only"), F.lit("derived_text"))
    restriction = F.struct(F.lit("r").alias("id"), none.alias("forbids_zones"), none.alias("forbids_kinds"), F.col("no_training").alias("forbids_training"), none.alias("requires_tags"), none.alias("forbids_payloads"), F.lit(None).cast("timestamp").alias("valid_until"))
    rows = rows.select("dataset", F.col("place").cast("long").alias("place"), "sensitivity", F.array(restriction).alias("restrictions"), "zone", F.lit("provider").alias("kind"), F.when(F.col("place") % 7 == 0, F.array(F.lit("labels_only"))).otherwise(texts).alias("accepts"), F.col("trains").alias("trains_on_inputs"), none.alias("tags"), "payload", F.current_timestamp().alias("now"), F.lit(None).cast("string").alias("policy_version"))
    return policy.decide(rows, policy.matrix(t.spark)).select("dataset", "place", "reason")


@query("""SELECT 'phi' AS sensitivity, '0,1' AS restrictions""")
def policy_combine(t: Tables) -> DataFrame:
    none = F.expr("CAST(array() AS array<string>)")
    r = F.struct((F.col("dataset") % 2).cast("string").alias("id"), none.alias("forbids_zones"), none.alias("forbids_kinds"), F.lit(True).alias("forbids_training"), none.alias("requires_tags"), none.alias("forbids_payloads"), F.lit(None).cast("timestamp").alias("valid_until"))
    rows = t["policies"].where("sensitivity <> 'other'").select(F.col("dataset").alias("position"), "sensitivity", F.array(r).alias("restrictions"))
    return policy.combine(rows)[0].select("sensitivity", F.array_join(F.transform("restrictions", lambda x: x["id"]), ",").alias("restrictions"))


_STAGES = [("S1", "N0", "M0", "I"), ("S2", "N0", "M0", "II"), ("S1", "N1", "M0", "II"), ("S2", "N1", "M0", "III")]


def _stage_rule(t: Tables) -> rules.TableRule:
    spec = rules.RuleSpec("stage", "1", {"size": rules.Role("size"), "node": rules.Role("node"), "spread": rules.Role("spread", on_missing="default")}, "stage_group", {"spread": "M0"})
    return rules.TableRule(spec, t.spark.createDataFrame(_STAGES, "size string, node string, spread string, value string"))


@query(f"""WITH l AS (SELECT * FROM {{claims}} WHERE status <> 'rejected'), g AS (SELECT c.case_id, min(l.value) FILTER (WHERE l.variable = 'size') AS s, count(DISTINCT l.value) FILTER (WHERE l.variable = 'size') AS sn, min(l.value) FILTER (WHERE l.variable = 'node') AS n, count(DISTINCT l.value) FILTER (WHERE l.variable = 'node') AS nn, coalesce(min(l.value) FILTER (WHERE l.variable = 'spread'), 'M0') AS m FROM (SELECT DISTINCT case_id FROM {{claims}}) c LEFT JOIN l ON l.case_id = c.case_id GROUP BY c.case_id), r AS (SELECT * FROM (VALUES {', '.join(map(str, _STAGES))}) v(s, n, m, value))
SELECT g.case_id, CASE WHEN sn > 1 OR nn > 1 THEN 'conflicting_evidence' WHEN r.value IS NULL THEN 'insufficient_evidence' ELSE 'answered' END AS status, CASE WHEN sn <= 1 AND nn <= 1 THEN r.value END AS value FROM g LEFT JOIN r ON g.s = r.s AND g.n = r.n AND g.m = r.m""")
def rule_derive(t: Tables) -> DataFrame:
    return rules.derive(_stage_rule(t), t["claims"]).select("case_id", "status", "value")


@query("SELECT CAST(0 AS BIGINT) AS mismatches")
def rule_replay(t: Tables) -> DataFrame:
    done = rules.derive(_stage_rule(t), t["claims"]).where("status = 'answered'")
    return rules.replay(done.select("case_id", "value", "inputs"), _stage_rule(t), t["claims"]).agg(F.count(F.lit(1)).alias("mismatches"))


@query("SELECT case_id, 'quality' AS variable, status AS outcome_status, CASE WHEN status = 'answered' THEN value END AS value, 'model:m' AS producer FROM {references_}")
def labels_only(t: Tables) -> DataFrame:
    rows = t["references_"].select("case_id", F.lit("quality").alias("variable"), "status", F.when(F.col("status") == "answered", F.array("record_id")).otherwise(F.expr("CAST(array() AS array<string>)")).alias("final_claim_ids"), F.lit("model:m").alias("producer"))
    claims = t["references_"].select("case_id", F.col("record_id").alias("claim_id"), "value", F.lit("model:m").alias("producer"))
    closed = t.spark.createDataFrame([("quality",)], "variable string")
    return cases.labels_only(rows, claims, closed)[0]


@query()
def pii_scan(t: Tables) -> DataFrame:
    return tx.findings(t["documents"], "text", "doc_id")


@query("""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@((?:[A-Za-z0-9_-]+\\.)+[A-Za-z]{2,})', 1)) AS domain FROM {documents}) SELECT doc_id FROM e WHERE NOT regexp_matches(lower(domain), '(^|\\.)(example\\.(com|org|net)|invalid|test|example|localhost)$') GROUP BY doc_id""")
def pii_emails(t: Tables) -> DataFrame:
    return tx.findings(t["documents"], "text", "doc_id").where("kind = 'email'").select("doc_id").distinct()


_DECISIONS = "SELECT CAST(o_orderkey AS VARCHAR(20)) AS decision_id, o_orderdate AS checked_at, o_orderkey % 2 = 0 AS permitted, o_orderstatus AS reason, CAST(NULL AS VARCHAR(5)) AS restriction_id, '1' AS policy_version, 'd' AS destination, 'k' AS destination_kind, 'local' AS zone, 'synthetic' AS sensitivity, 'labels_only' AS payload, CAST(NULL AS VARCHAR(5)) AS dataset, CAST(NULL AS VARCHAR(5)) AS run_id, CAST(o_custkey AS VARCHAR(20)) AS case_id FROM {orders}"


@query(f"""WITH d AS ({_DECISIONS}), r AS (SELECT decision_id, concat('{{{{"case_id":"', case_id, '","checked_at":"', strftime(checked_at, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","dataset":null,"decision_id":"', decision_id, '","destination":"d","destination_kind":"k","payload":"labels_only","permitted":', CAST(permitted AS VARCHAR), ',"policy_version":"1","reason":"', reason, '","restriction_id":null,"run_id":null,"sensitivity":"synthetic","zone":"local"}}}}') AS h FROM d) SELECT CAST(count(*) AS BIGINT) AS "rows", sha256(string_agg(h, chr(10) ORDER BY decision_id)) AS content FROM r""".replace("{{", "{").replace("}}", "}"))
def content_hash(t: Tables) -> DataFrame:
    rows = t.sql(_DECISIONS).withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    return bundles.content_hash(TABLES["decisions"], rows)


@query("SELECT sha256(text) AS text_hash, CAST(count(*) AS BIGINT) AS copies FROM {documents} GROUP BY text HAVING count(*) > 1")
def exact_copies(t: Tables) -> DataFrame:
    return t["documents"].groupBy(bundles.text_hash(F.col("text")).alias("text_hash")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query("""SELECT source AS dataset, lang AS source_id, CAST(count(DISTINCT doc_id % 2) AS BIGINT) AS splits FROM {documents} GROUP BY source, lang HAVING count(DISTINCT doc_id % 2) > 1""")
def split_conflicts(t: Tables) -> DataFrame:
    return cases.split_conflicts(t.sql("SELECT source AS dataset, lang AS source_id, CAST(doc_id % 2 AS VARCHAR(2)) AS split FROM {documents}"))


@query("""WITH u AS (SELECT user_id, event_id, sum(event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM {events}) SELECT event_id, CAST(spent AS BIGINT) AS spent, spent > 400 AS exceeded FROM u""")
def usage_budget(t: Tables) -> DataFrame:
    calls = t.sql("SELECT user_id AS case_id, event_id AS call, event_id % 50 AS tokens, 400 AS max_tokens FROM {events}")
    return cases.usage_exceeded(calls).select(F.col("call").alias("event_id"), F.col("spent").cast("long").alias("spent"), "exceeded")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS written, regexp_matches(lpad(CAST(o_orderkey AS VARCHAR), 26, '0'), '^[0-7][0-9A-HJKMNP-TV-Z]{25}$') AS ulid, regexp_replace(concat_ws('.', o_orderpriority, o_orderstatus), '[^A-Za-z0-9_\\-./ ]', '_', 'g') AS metric_key FROM {orders}""")
def scalar_text(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderkey", ids.timestamp_column(F.col("o_orderdate")).alias("written"), ids.is_ulid(F.lpad(F.col("o_orderkey").cast("string"), 26, "0")).alias("ulid"), tx.metric_key(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("metric_key"))


@query("""SELECT o_orderkey, concat('{"a":', CAST(o_custkey AS VARCHAR), ',"b":"', o_orderstatus, '","c":', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END, '}') AS canonical FROM {orders}""")
def canonical_json(t: Tables) -> DataFrame:
    raw = t["orders"].select("o_orderkey", F.to_json(F.struct((F.col("o_orderkey") % 2 == 0).alias("c"), F.col("o_orderstatus").alias("b"), F.col("o_custkey").alias("a"))).alias("j"))
    return raw.select("o_orderkey", ids.canon(F.col("j")).alias("canonical"))


@query("""SELECT 'stored' AS side, CAST(count(*) AS BIGINT) AS n FROM {orders} WHERE o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 UNION ALL SELECT 'rebuilt', CAST(count(*) AS BIGINT) FROM {orders} WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0""")
def unconsumed_rows(t: Tables) -> DataFrame:
    rows = t["orders"].withColumnRenamed("o_orderkey", "decision_id")
    stored, rebuilt = rows.where("decision_id % 3 = 0"), rows.where("decision_id % 2 = 0")
    return bundles.unconsumed(TABLES["decisions"], stored, rebuilt).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, sha256(text) AS text_sha256 FROM {documents}""")
def source_manifest(t: Tables) -> DataFrame:
    rows = stores.source_manifest(t["notes"])
    return rows.select(F.col("source_id").cast("long").alias("doc_id"), "text_sha256")


@query("""WITH b AS (SELECT source AS scorer, lang AS name, CAST(sum(n_chars) AS DOUBLE) AS numerator, CAST(count(*) AS BIGINT) AS denominator FROM {documents} GROUP BY source, lang) SELECT concat(scorer, '.', name) AS key, round(numerator / denominator, 6) AS value FROM b""")
def metric_maps(t: Tables) -> DataFrame:
    rows = t.sql("SELECT source AS scorer, lang AS name, CAST(sum(n_chars) AS DOUBLE) AS numerator, CAST(count(*) AS BIGINT) AS denominator FROM {documents} GROUP BY source, lang")
    return stores.metric_maps(rows).select("key", F.round("value", 6).alias("value"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: benchmark passages grounded in the documents that hold them."""
    return QUERIES["ground_exact"](spark, sf_dir)


STAND_INS |= {
    "result_cases": "SELECT CAST(doc_id AS VARCHAR(20)) AS case_id, doc_id, coalesce(source, 'none') AS source, n_chars AS tokens, CAST(5000 AS BIGINT) AS max_tokens FROM {documents}",
    "result_outcomes": "SELECT CAST(doc_id AS VARCHAR(20)) AS case_id, doc_id, 'quality' AS variable, CASE WHEN doc_id % 7 = 0 THEN 'not_mentioned' WHEN quality = 1 THEN 'answered' WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'insufficient_evidence' END AS status FROM {labels} UNION ALL SELECT CAST(doc_id AS VARCHAR(20)), doc_id, 'toxic', CASE WHEN doc_id % 9 = 0 THEN 'not_mentioned' WHEN toxic = 1 THEN 'answered' WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'insufficient_evidence' END FROM {labels}",
    "set_variables": "SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS set_id, p_partkey % 10 AS k, concat('v', CAST(p_partkey % 10 AS VARCHAR(2))) AS variable, CASE WHEN p_partkey % 10 < 3 THEN 'mention' ELSE 'case' END AS level, p_partkey % 10 = 9 AND floor(p_partkey / 10) % 6 <> 0 AS final FROM {part}",
    "set_inputs": "SELECT set_id, variable, concat('v', CAST(k - 1 AS VARCHAR(2))) AS input FROM {set_variables} WHERE k > 0 UNION ALL SELECT set_id, variable, 'v9' FROM {set_variables} WHERE (k = 5 AND set_id % 4 = 1) OR (k = 0 AND set_id % 4 = 3) UNION ALL SELECT set_id, variable, 'other' FROM {set_variables} WHERE k = 1 AND set_id % 4 = 2",
}


@query("""WITH RECURSIVE reach AS (SELECT set_id, variable AS root, input AS node FROM {set_inputs} UNION SELECT r.set_id, r.root, i.input FROM reach r JOIN {set_inputs} i ON i.set_id = r.set_id AND i.variable = r.node), f AS (SELECT set_id, bool_or(final) AS anyone FROM {set_variables} GROUP BY set_id), m AS (SELECT i.set_id, bool_or(b.variable IS NULL) AS unknown, bool_or(a.level = 'mention' AND b.level <> 'mention') AS lifted FROM {set_inputs} i JOIN {set_variables} a ON a.set_id = i.set_id AND a.variable = i.variable LEFT JOIN {set_variables} b ON b.set_id = i.set_id AND b.variable = i.input GROUP BY i.set_id), c AS (SELECT DISTINCT set_id FROM reach WHERE root = node), r AS (SELECT f.set_id, CASE WHEN NOT anyone THEN 'no_final_variable' WHEN unknown THEN 'unknown_input' WHEN lifted THEN 'mention_from_other_level' WHEN c.set_id IS NOT NULL THEN 'cycle' END AS code FROM f LEFT JOIN m ON m.set_id = f.set_id LEFT JOIN c ON c.set_id = f.set_id) SELECT set_id, code FROM r WHERE code IS NOT NULL""")
def variable_set_errors(t: Tables) -> DataFrame:
    return results.set_errors(t["set_variables"], t["set_inputs"])


def _result_parts(t: Tables) -> tuple[DataFrame, ...]:
    none = F.expr("CAST(array() AS array<string>)")
    doc, named = F.col("doc_id"), F.concat("case_id", F.lit(":"), "variable")
    own = t["result_cases"].select("case_id", F.lit("run1").alias("run_id"), F.array("source").alias("source_ids"), F.lit("synthetic").alias("sensitivity"), "max_tokens", "tokens", "source")
    rows = t["result_outcomes"].join(own.select("case_id", "source"), "case_id")
    outcomes = rows.select(
        "case_id",
        "variable",
        "status",
        F.when(F.col("status") == "failed", "budget").alias("failure_kind"),
        F.when(doc % 13 == 0, F.array(F.lit("elsewhere"))).when(doc % 5 == 0, none).otherwise(F.array("source")).alias("reviewed"),
        F.when((doc % 19 == 0) & (F.col("variable") == "toxic"), F.array(F.concat(F.lit("lost"), "case_id"))).otherwise(F.array(F.concat(F.lit("e"), "case_id"))).alias("evidence_ids"),
        F.when(F.col("status") == "answered", F.array(named)).otherwise(none).alias("final_claim_ids"),
        F.lit("synthetic").alias("sensitivity"),
        F.when((doc % 23 == 0) & (F.col("variable") == "toxic"), "run2").otherwise("run1").alias("run_id"),
    )
    claims = t["result_outcomes"].select("case_id", named.alias("claim_id"), "variable", F.when(doc % 17 == 0, "rejected").otherwise("proposed").alias("status"))
    grounded = own.select("case_id", F.concat(F.lit("e"), "case_id").alias("node_id"))
    variables = t.spark.createDataFrame([("quality", "case", True), ("toxic", "case", True), ("part", "mention", False)], "variable string, level string, final boolean")
    return own.drop("source"), variables, outcomes, claims, grounded


@query("""WITH o AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'invalid_context' WHEN status = 'not_mentioned' AND doc_id % 5 = 0 THEN 'incomplete_review' WHEN variable = 'toxic' AND doc_id % 19 = 0 THEN 'unknown_reference' WHEN status = 'answered' AND doc_id % 17 = 0 THEN 'invalid_final_claims' END AS code FROM {result_outcomes}), g AS (SELECT doc_id, coalesce(max(code) FILTER (WHERE variable = 'quality'), max(code) FILTER (WHERE variable = 'toxic')) AS code, bool_and(status = 'failed') AS said, CAST(count(*) FILTER (WHERE status = 'answered') AS BIGINT) AS n FROM o GROUP BY doc_id), r AS (SELECT c.case_id, CASE WHEN g.doc_id IS NULL THEN 'invalid_context' WHEN g.code IS NOT NULL THEN g.code WHEN c.doc_id % 23 = 0 THEN 'run_mismatch' WHEN c.tokens > c.max_tokens AND NOT g.said THEN 'budget_exceeded' ELSE 'ok' END AS code, g.n FROM {result_cases} c LEFT JOIN g ON g.doc_id = c.doc_id) SELECT case_id, code, CASE WHEN code = 'ok' THEN n END AS answered FROM r""")
def case_results(t: Tables) -> DataFrame:
    made, errors = results.create(*_result_parts(t))
    good = made.select("case_id", F.lit("ok").alias("code"), F.size(F.filter("outcomes", lambda o: o["status"] == "answered")).cast("long").alias("answered"))
    return good.unionByName(errors, allowMissingColumns=True)


@query("""WITH good AS (SELECT case_id, doc_id FROM {result_outcomes} GROUP BY case_id, doc_id HAVING NOT bool_or(status = 'failed')), k AS (SELECT 1 AS k UNION ALL SELECT 2), log AS (SELECT case_id, 0 AS stage, 0 AS a, '' AS b, '' AS c, 'import.result' AS action, 'run1' AS target_id, CAST(NULL AS VARCHAR) AS variable FROM good UNION ALL SELECT case_id, 1, 0, concat('m', k), '', 'mention.create', concat('m', k), NULL FROM good, k WHERE (doc_id + k) % 3 <> 0 UNION ALL SELECT case_id, 1, 0, concat('m', k), concat('r', k), 'reading.create', concat('r', k), NULL FROM good, k WHERE (doc_id + k) % 3 <> 0 UNION ALL SELECT case_id, 2, 3 - k, concat('c', k), '', 'claim.create', concat('c', k), NULL FROM good, k WHERE doc_id % 17 <> 0 UNION ALL SELECT g.case_id, 3, 0, o.variable, '', 'outcome.set', NULL, o.variable FROM good g JOIN {result_outcomes} o ON o.case_id = g.case_id UNION ALL SELECT g.case_id, 4, 0, o.variable, '', 'tier.set', NULL, o.variable FROM good g JOIN {result_outcomes} o ON o.case_id = g.case_id) SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY stage, a, b, c) AS BIGINT) AS seq, action, target_id, variable FROM log""")
def import_log(t: Tables) -> DataFrame:
    made = t["result_outcomes"].groupBy("case_id", "doc_id").agg(F.collect_list(F.struct("variable", "status")).alias("outcomes")).withColumn("run_id", F.lit("run1"))
    each = made.select("case_id", "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    named = lambda letter: F.concat(F.lit(letter), F.col("k").cast("string"))
    mentions = each.select("case_id", named("m").alias("mention_id"))
    readings = each.select("case_id", named("m").alias("mention_id"), named("r").alias("reading_id"), F.when((F.col("doc_id") + F.col("k")) % 3 == 0, "rejected").otherwise("proposed").alias("status"))
    claims = each.select("case_id", named("c").alias("claim_id"), (3 - F.col("k")).alias("rank"), F.when(F.col("doc_id") % 17 == 0, "rejected").otherwise("proposed").alias("status"))
    return results.import_events(made.drop("doc_id"), mentions, readings, claims, "tool:importer")[0].select("case_id", "seq", "action", "target_id", "variable")


@query("SELECT CAST(l_orderkey AS VARCHAR(20)) AS mention_id, concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(4))) AS reading_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(4)))) AS BIGINT) AS place FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_orderstatus <> 'F')")
def mention_readings(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string").alias("mention_id")
    mentions = t["orders"].select(F.lit("").alias("case_id"), key, "o_orderstatus")
    readings = t["lineitem"].select(F.lit("").alias("case_id"), F.col("l_orderkey").cast("string").alias("mention_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("reading_id"))
    found = results.readings_of(mentions.where("o_orderstatus <> 'F'"), mentions, readings)[0]
    return found.select("mention_id", "reading_id", F.col("place").cast("long").alias("place"))


@query("SELECT concat('tier.', tier) AS tag, CAST(count(*) AS VARCHAR) AS value FROM {references_} GROUP BY tier UNION ALL SELECT 'examples', CAST(count(*) AS VARCHAR) FROM {eligible} UNION ALL SELECT 'variable_set', 'notes' UNION ALL SELECT 'variable_set_version', '1' UNION ALL SELECT 'variable_set_ref', 'none'")
def dataset_tags(t: Tables) -> DataFrame:
    return results.dataset_tags(t["eligible"], t["references_"], "notes", "1", "none")
