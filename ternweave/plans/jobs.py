"""Duplicates, rule grids, chaining, sessions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions import text as X
from ternweave.functions.session import checkpoint_dir
from ternweave.operators import duplicates as Dup
from ternweave.operators import encode as E
from ternweave.operators import rules as R
from ternweave.operators import scoring as Sc
from ternweave.operators import search as S
from ternweave.operators import sessions as Se
from ternweave.plans import search as PS
from ternweave.plans.common import codebook_sql, flat_map_sql, map_sql, query, spread_table, table, words_sql
from ternweave.plans.corpus import _vec_sql

D = 128
THRESHOLD = 0.75


# ---- duplicates ------------------------------------------------------------------------------

def doc_vectors(spark, sf):
    """All documents, encoded once and cut from the text by a checkpoint; one without words is the zero vector."""
    checkpoint_dir(spark)
    d = spread_table(spark, sf, "documents").select("doc_id", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", E.encode_ngrams("w", D).alias("vec")).checkpoint()


_DOCS = f"""
di AS (SELECT doc_id AS id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {words_sql('text')} AS ws FROM documents)),
{codebook_sql("SELECT a FROM di", D)}, {_vec_sql('di', 'cb', 'uv')},
dl AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM uv GROUP BY id
  UNION ALL SELECT doc_id, list_transform(range({D}), lambda i: 0)::FLOAT[] FROM documents WHERE doc_id NOT IN (SELECT id FROM uv)),
ld AS (SELECT id, min(id) OVER (PARTITION BY v) AS leader, v FROM dl),
pk AS (SELECT * FROM (SELECT a.id AS doc_id, b.id AS other_id, CAST(list_dot_product(a.v, b.v) AS DOUBLE) / {D}.0 AS s FROM ld a, ld b
  WHERE a.id <> b.id AND ((a.id = a.leader AND b.id = b.leader) OR a.leader = b.id OR b.leader = a.id)) WHERE s >= {THRESHOLD})"""


@query(f"WITH {_DOCS} SELECT doc_id, other_id, round(s, 6) AS score FROM pk")
def duplicate_pairs(spark, sf):
    """All pairs of near-duplicate documents with distinct vectors, and of copies with their leader."""
    return Dup.similar_pairs(doc_vectors(spark, sf), D, None, THRESHOLD, digits=6)


@query(f"""WITH RECURSIVE {_DOCS.strip()},
ed AS MATERIALIZED (SELECT doc_id AS a, other_id AS b FROM pk UNION SELECT other_id, doc_id FROM pk
  UNION SELECT id, leader FROM ld WHERE id <> leader UNION SELECT leader, id FROM ld WHERE id <> leader),
re(id, g) AS (SELECT DISTINCT a, a FROM ed UNION SELECT ed.b, re.g FROM re JOIN ed ON ed.a = re.id WHERE re.g < ed.b)
SELECT e.a AS doc_id, least(e.a, coalesce(min(re.g), e.a)) AS "group" FROM (SELECT DISTINCT a FROM ed) e LEFT JOIN re ON re.id = e.a GROUP BY e.a""")
def duplicate_groups(spark, sf):
    """Connected groups of near duplicates and copies."""
    return Dup.duplicate_groups(doc_vectors(spark, sf), D, THRESHOLD)


@query(f"""WITH RECURSIVE {_DOCS.strip()},
hi AS MATERIALIZED (SELECT b.id AS doc_id, a.id AS by_id FROM dl a JOIN dl b ON a.id < b.id AND list_dot_product(a.v, b.v) / {D}.0 >= {THRESHOLD}),
vx AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM dl),
gr AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS heads, NULL::BIGINT AS doc_id, NULL::BIGINT AS leader UNION ALL
  SELECT vx.n, CASE WHEN h.head IS NULL THEN list_append(gr.heads, vx.id) ELSE gr.heads END, vx.id, coalesce(h.head, vx.id)
  FROM gr JOIN vx ON vx.n = gr.n + 1 LEFT JOIN LATERAL (SELECT min(by_id) AS head FROM hi WHERE hi.doc_id = vx.id AND list_contains(gr.heads, by_id)) h ON TRUE)
SELECT doc_id, leader FROM gr WHERE doc_id IS NOT NULL AND leader IN (SELECT leader FROM gr WHERE doc_id IS NOT NULL GROUP BY leader HAVING count(*) > 1)""")
def duplicate_greedy_clusters(spark, sf):
    """Greedy clusters in id order, copies included."""
    return Dup.greedy_duplicates(doc_vectors(spark, sf), D, THRESHOLD)


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS labels, p_brand FROM part)
SELECT p_partkey FROM w WHERE list_contains(labels, 'red') AND list_has_any(labels, ['bolt', 'gear', 'ring']) AND p_brand <> 'Brand#1'""")
def triage_labels(spark, sf):
    """Label containment, alternatives and exclusion."""
    p = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("labels"), "p_brand")
    return Dup.triage(p, "labels", all_of=["red"], any_of=["bolt", "gear", "ring"]).where(
        "p_brand <> 'Brand#1'").select("p_partkey")


@query(PS.search_sql({0: {"p_brand": "Brand#13", "p_type": "ECONOMY"}},
                     "NOT list_contains(string_split(p_name, ' '), 'bolt')", k=10, subtract={0: {"p_size": 15}})
       .replace("q AS query_id, ", ""))
def substitutes(spark, sf):
    """Similar parts minus a property's vector, without an item in their list."""
    corpus = PS.parts(spark, sf).withColumn("items", F.split("p_name", " "))
    out = Dup.substitutes(corpus, {"p_brand": "Brand#13", "p_type": "ECONOMY"}, PS.D, "items", "bolt", {"p_size": 15}, 10)
    return out.withColumn("score", F.round("score", 6))


# ---- rule grids ------------------------------------------------------------------------------

GD = 64
SIDE = 3
_NAMES = ", ".join(f"'{s}'" for s in R.SHAPES)
_TONES = ", ".join(f"'{c}'" for c in R.COLORS)
_GRID = f"""
ce AS (SELECT o_custkey AS matrix_id, month(o_orderdate) % {SIDE} + 1 AS "row", year(o_orderdate) % {SIDE} + 1 AS "col",
  list_sort(list_distinct(list([{_NAMES}][CAST(substr(o_orderpriority, 1, 1) AS INT)]))) AS shapes,
  [{_TONES}][CAST(max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS INT)] AS color FROM orders GROUP BY 1, 2, 3),
pn AS (SELECT *, len(shapes) AS "count" FROM ce),
fu AS (SELECT * FROM pn WHERE matrix_id IN (SELECT matrix_id FROM pn GROUP BY matrix_id HAVING count(*) = {SIDE * SIDE})),
mx AS (SELECT matrix_id, ['progression', 'xor', 'union', 'intersection'][matrix_id % 4 + 1] AS rule,
  (matrix_id // 4) % {SIDE} + 1 AS missing_row, (matrix_id // 12) % {SIDE} + 1 AS missing_col FROM (SELECT DISTINCT matrix_id FROM pn)),
vi AS (SELECT pn.*, rule, missing_row, missing_col FROM pn JOIN mx USING (matrix_id) WHERE NOT ("row" = missing_row AND "col" = missing_col)),
tr AS (SELECT matrix_id, shapes, "count", color FROM pn JOIN mx USING (matrix_id) WHERE "row" = missing_row AND "col" = missing_col)"""


def grid_cells(spark, sf):
    """The panels of 3 x 3 grids, one grid per customer with orders, by month and year; a cell without orders has no panel, and
    one cell of each grid, not visible, is asked for."""
    o, m = table(spark, sf, "orders"), F.col("matrix_id")
    shape = F.element_at(F.array(*[F.lit(s) for s in R.SHAPES]), F.substring("o_orderpriority", 1, 1).cast("int"))
    tone = F.max(F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3))
    rule = F.element_at(F.array(*[F.lit(r) for r in ("progression", "xor", "union", "intersection")]), (m % 4 + 1).cast("int"))
    hidden = (F.col("row") == F.col("missing_row")) & (F.col("col") == F.col("missing_col"))
    return (o.groupBy(F.col("o_custkey").alias("matrix_id"), (F.month("o_orderdate") % SIDE + 1).alias("row"),
                      (F.year("o_orderdate") % SIDE + 1).alias("col"))
            .agg(F.array_sort(F.collect_set(shape)).alias("shapes"), tone.alias("tone"))
            .select("matrix_id", rule.alias("rule"), (F.floor(m / 4) % SIDE + 1).cast("int").alias("missing_row"),
                    (F.floor(m / 12) % SIDE + 1).cast("int").alias("missing_col"), "row", "col", "shapes", F.size("shapes").alias("count"),
                    F.element_at(F.array(*[F.lit(c) for c in R.COLORS]), F.col("tone")).alias("color"))
            .withColumn("visible", ~hidden))


def grids(spark, sf):
    """(visible, matrices, full, truth): the visible panels of all grids, the grids, the panels of those without an empty cell, and
    the panels asked for.  The panels are stored, for all four come from them."""
    checkpoint_dir(spark)
    cells, keep = grid_cells(spark, sf).checkpoint(), ("matrix_id", "row", "col", "shapes", "count", "color")
    matrices = cells.select("matrix_id", "rule", "missing_row", "missing_col").distinct()
    whole = cells.groupBy("matrix_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == SIDE * SIDE).select("matrix_id")
    return cells.where("visible").select(*keep), matrices, cells.join(whole, "matrix_id").select(*keep), cells.where("not visible").select(*keep)


def _line_sql(name, where):
    return (f"{name} AS (SELECT matrix_id, shape FROM (SELECT matrix_id, shape, count(*) AS c FROM (SELECT matrix_id, unnest(shapes) AS shape FROM vi WHERE {where}) "
            f"GROUP BY matrix_id, shape) JOIN (SELECT matrix_id, count(*) AS n FROM vi WHERE {where} GROUP BY matrix_id) USING (matrix_id) WHERE c = n)")


_RULES = f"""{_GRID},
{_line_sql('ur', '"row" = missing_row')}, {_line_sql('uc', '"col" = missing_col')},
{_line_sql('ir', '"row" = missing_row AND "col" <> missing_col')}, {_line_sql('ic', '"col" = missing_col AND "row" <> missing_row')},
us AS (SELECT matrix_id, list_sort(list(shape)) AS shapes FROM (SELECT * FROM ur UNION SELECT * FROM uc) GROUP BY matrix_id),
ns AS (SELECT matrix_id, list_sort(list(shape)) AS shapes FROM (SELECT * FROM ir INTERSECT SELECT * FROM ic) GROUP BY matrix_id),
ex AS (SELECT matrix_id, rule, CASE rule
    WHEN 'progression' THEN list_sort([{_NAMES}][1:least(missing_row + missing_col - 1, 5)])
    WHEN 'xor' THEN list_sort(list_filter([{_NAMES}][1:3], lambda s, i: (xor(missing_row, missing_col) >> (i - 1)) & 1 = 1))
    WHEN 'union' THEN coalesce(us.shapes, []) ELSE coalesce(ns.shapes, []) END AS shapes,
  CASE rule WHEN 'progression' THEN [{_TONES}][(missing_col - 1) % 5 + 1] WHEN 'xor' THEN 'black'
    ELSE [{_TONES}][(missing_row + missing_col - 2) % 5 + 1] END AS color
  FROM mx LEFT JOIN us USING (matrix_id) LEFT JOIN ns USING (matrix_id))"""


def _completion(rule):
    @query(f"WITH {_RULES} SELECT matrix_id, array_to_string(shapes, ',') AS shapes, CAST(len(shapes) AS INT) AS \"count\", color FROM ex WHERE rule = '{rule}'",
           name=f"rule_{rule}")
    def run(spark, sf):
        return R.complete_cells(grid_cells(spark, sf).where(F.col("rule") == rule)).select(
            "matrix_id", F.array_join("shapes", ",").alias("shapes"), "count", "color")


for _rule in ("progression", "xor", "union", "intersection"):
    _completion(_rule)


@query(f"""WITH {_RULES}, j AS (SELECT rule, CAST(ex.shapes = tr.shapes AND ex.color = tr.color AS INT) AS ok FROM ex JOIN tr USING (matrix_id))
SELECT rule, count(*) AS n, CAST(sum(ok) AS BIGINT) AS hits, round(avg(ok), 6) AS accuracy, round((avg(ok) - 0.05) / 0.05 * 100, 6) AS gain_percent FROM j GROUP BY rule""")
def rule_accuracy(spark, sf):
    """Accuracy of rule completion per rule against the hidden cells."""
    a = Sc.rule_accuracy(R.judge_cells(grid_cells(spark, sf)))
    return a.select("rule", "n", "hits", F.round("accuracy", 6).alias("accuracy"), F.round("gain_percent", 6).alias("gain_percent"))


PANEL = ("shapes", "count", "color")


def _grid_vec(cells, name, fields=PANEL):
    part = {"shapes": "k1.x * st.x * s.x", "count": "k2.x * cn.x", "color": "k3.x * cl.x"}
    return f"""
{name}c AS (SELECT matrix_id, 'row' || "row" || '-col' || "col" AS pos, shapes, CAST("count" AS VARCHAR) AS n, color FROM {cells}),
{name}s AS (SELECT matrix_id, pos, d, sign(sum(x)) AS x FROM (SELECT matrix_id, pos, unnest(shapes) AS a FROM {name}c) JOIN cb USING (a) GROUP BY matrix_id, pos, d),
{name}p AS (SELECT c.matrix_id, c.pos, s.d, sign({" + ".join(part[f] for f in fields)}) AS x FROM {name}c c JOIN {name}s s USING (matrix_id, pos)
  JOIN cb st ON st.a = chr(1) || 'set' AND st.d = s.d JOIN cb cn ON cn.a = c.n AND cn.d = s.d JOIN cb cl ON cl.a = c.color AND cl.d = s.d
  JOIN cb k1 ON k1.a = 'shapes' AND k1.d = s.d JOIN cb k2 ON k2.a = 'count' AND k2.d = s.d JOIN cb k3 ON k3.a = 'color' AND k3.d = s.d),
{name}m AS (SELECT matrix_id, p.d, sign(sum(p.x * cb.x)) AS x FROM {name}p p JOIN cb ON cb.a = p.pos AND cb.d = p.d GROUP BY matrix_id, p.d),
{name} AS (SELECT matrix_id, list(CAST(sign(k1.x * m.x + k2.x * r.x) AS INT) ORDER BY m.d)::FLOAT[] AS v FROM {name}m m JOIN mx USING (matrix_id)
  JOIN cb r ON r.a = rule AND r.d = m.d JOIN cb k1 ON k1.a = 'panels' AND k1.d = m.d JOIN cb k2 ON k2.a = 'rule' AND k2.d = m.d GROUP BY matrix_id)"""


def _nearest_sql(name, fields=PANEL):
    return f"""{_grid_vec('vi', name + 'v', fields)}, {_grid_vec('fu', name + 'f', fields)},
{name}b AS (SELECT q, f FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, f) AS r FROM (
  SELECT q.matrix_id AS q, f.matrix_id AS f, list_dot_product(q.v, f.v) AS s FROM {name}v q, {name}f f WHERE q.matrix_id <> f.matrix_id)) WHERE r = 1),
{name}o AS (SELECT q AS matrix_id, rule, shapes, "count", color FROM {name}b JOIN mx ON mx.matrix_id = q
  JOIN fu ON fu.matrix_id = f AND fu."row" = missing_row AND fu."col" = missing_col)"""


_GATOMS = f"""SELECT unnest(['shapes', 'count', 'color', 'panels', 'rule', chr(1) || 'set', {_TONES}, '1', '2', '3', '4', '5',
 'progression', 'xor', 'union', 'intersection', {_NAMES}, {", ".join(f"'row{i + 1}-col{j + 1}'" for i in range(SIDE) for j in range(SIDE))}]) AS a"""


@query(f"""WITH {_GRID}, {codebook_sql(_GATOMS, GD)}, {_nearest_sql('g')}
SELECT matrix_id, rule, array_to_string(shapes, ',') AS shapes, CAST("count" AS INT) AS "count", color FROM go""")
def rule_nearest_completion(spark, sf):
    """Missing cell copied from the most similar other complete grid."""
    visible, matrices, full, _ = grids(spark, sf)
    out = R.nearest_completion(visible, matrices, full, GD)
    return out.select("matrix_id", "rule", F.array_join("shapes", ",").alias("shapes"), "count", "color")


ABLATIONS = (PANEL, ("count", "color"), ("shapes", "color"), ("shapes",))


def _ablation_sql():
    scored = " UNION ALL ".join(
        f"""SELECT '{"+".join(fields)}' AS fields, o.rule, CAST(o.shapes = tr.shapes AND o."count" = tr."count" AND o.color = tr.color AS INT) AS ok
  FROM g{i}o o JOIN tr USING (matrix_id)""" for i, fields in enumerate(ABLATIONS))
    return (f"WITH {_GRID}, {codebook_sql(_GATOMS, GD)}, " + ", ".join(_nearest_sql(f"g{i}", fields) for i, fields in enumerate(ABLATIONS))
            + f", j AS ({scored}) SELECT fields, rule, count(*) AS n, CAST(sum(ok) AS BIGINT) AS hits, round(avg(ok), 6) AS accuracy FROM j GROUP BY fields, rule")


@query(_ablation_sql())
def rule_ablation(spark, sf):
    """Accuracy of nearest completion with parts of the panels removed."""
    visible, matrices, full, truth = grids(spark, sf)
    out = None
    for fields in ABLATIONS:
        got = R.judge(R.nearest_completion(visible, matrices, full, GD, fields), truth)
        part = Sc.rule_accuracy(got).withColumn("fields", F.lit("+".join(fields)))
        out = part if out is None else out.unionByName(part)
    return out.select("fields", "rule", "n", "hits", F.round("accuracy", 6).alias("accuracy"))


# ---- forward chaining ------------------------------------------------------------------------

def place_facts(spark, sf):
    """Orders in customers, customers and suppliers in nations, nations in regions."""
    def fact(t, s, o):
        return t.select(s.alias("subject"), F.lit("in").alias("relation"), o.alias("object"))

    def tag(prefix, c):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return (fact(o, tag("order:", "o_orderkey"), tag("customer:", "o_custkey"))
            .union(fact(c, tag("customer:", "c_custkey"), tag("nation:", "c_nationkey")))
            .union(fact(s, tag("supplier:", "s_suppkey"), tag("nation:", "s_nationkey")))
            .union(fact(n, tag("nation:", "n_nationkey"), tag("region:", "n_regionkey"))))


_RULE_SET = [R.transitive("in"), R.implies("in", "is_placed")]
_CHAIN = """
i AS (SELECT 'order:' || o_orderkey AS subject, 'customer:' || o_custkey AS object FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
t2 AS (SELECT a.subject, b.object FROM i a JOIN i b ON b.subject = a.object), t3 AS (SELECT a.subject, b.object FROM t2 a JOIN i b ON b.subject = a.object),
al AS (SELECT subject, 'in' AS relation, object, TRUE AS is_input FROM i UNION ALL SELECT subject, 'in', object, FALSE FROM (SELECT * FROM t2 UNION SELECT * FROM t3)
  UNION ALL SELECT DISTINCT subject, 'is_placed', 'true', FALSE FROM i)"""


@query(f"WITH {_CHAIN} SELECT * FROM al")
def forward_chaining(spark, sf):
    """All facts that follow from the place rules."""
    return R.forward_chain(place_facts(spark, sf), _RULE_SET)


@query(f"WITH {_CHAIN} SELECT relation, object, count(*) AS facts FROM al WHERE NOT is_input GROUP BY relation, object")
def derived_facts(spark, sf):
    """Derived facts only, after a replay from the inputs."""
    first = R.forward_chain(place_facts(spark, sf), _RULE_SET)
    again = R.replay(first, _RULE_SET)
    return again.where("NOT is_input").groupBy("relation", "object").agg(F.count(F.lit(1)).alias("facts"))


# ---- scores ----------------------------------------------------------------------------------

def _judged(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select("lang", "source", F.when(F.col("n_chars") > 600, 1).otherwise(0).alias("guess"), "quality")


_JUDGED = "j AS (SELECT lang, source, CASE WHEN n_chars > 600 THEN 1 ELSE 0 END AS guess, quality FROM documents JOIN labels USING (doc_id))"


@query(f"""WITH {_JUDGED}, c AS (SELECT lang, CAST(sum(CAST(guess = quality AS INT)) AS BIGINT) AS tp, count(*) AS n FROM j GROUP BY lang)
SELECT lang, tp, n - tp AS fp, n - tp AS fn, round(tp / CAST(n AS DOUBLE), 6) AS precision, round(tp / CAST(n AS DOUBLE), 6) AS recall,
  round(tp / CAST(n AS DOUBLE), 6) AS f1, round(tp / CAST(n AS DOUBLE), 6) AS accuracy FROM c""")
def label_scores(spark, sf):
    """Precision, recall, F1 and accuracy of a length rule for document quality."""
    s = Sc.label_scores(_judged(spark, sf), "guess", "quality", ["lang"])
    return s.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query(f"""WITH {_JUDGED}, t AS (SELECT lang, source, avg(CAST(guess = quality AS INT)) AS accuracy FROM j GROUP BY lang, source)
SELECT lang, count(*) AS trials, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std_dev,
  round(1.96 * stddev_pop(accuracy) / sqrt(count(*)), 6) AS half_width FROM t GROUP BY lang""")
def trial_confidence(spark, sf):
    """Mean and 95 % interval over sources as repeated trials."""
    trials = _judged(spark, sf).groupBy("lang", "source").agg(
        F.avg((F.col("guess") == F.col("quality")).cast("int")).alias("accuracy"))
    c = Sc.confidence_interval(trials, "accuracy", ["lang"])
    return c.select("lang", "trials", *[F.round(x, 6).alias(x) for x in ("mean", "std_dev", "half_width")])


@query("""WITH m(query_type, minimum) AS (VALUES ('click', 500), ('view', 500), ('refund', 1)), c AS (SELECT event_type AS query_type, count(*) AS n FROM events GROUP BY 1)
SELECT query_type, CAST(minimum AS INT) AS minimum, coalesce(n, 0) AS n, coalesce(n, 0) >= minimum AS passed FROM m LEFT JOIN c USING (query_type)""")
def count_expectations(spark, sf):
    """Minimum result counts per event type."""
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("query_type")).agg(F.count(F.lit(1)).alias("n"))
    minimums = spark.createDataFrame([("click", 500), ("view", 500), ("refund", 1)], "query_type STRING, minimum INT")
    return Sc.expectations(counts, minimums)


@query("""SELECT event_type, count(*) AS queries, round(avg(value), 6) AS mean, max(value) AS max, round(sum(value), 4) AS total,
  round(count(*) / sum(value), 6) AS per_second FROM events GROUP BY event_type""")
def latency_statistics(spark, sf):
    """Mean, maximum, total and rate of a query log."""
    s = Sc.latency_stats(table(spark, sf, "events"), "value", ["event_type"])
    return s.select("event_type", "queries", F.round("mean", 6).alias("mean"), "max", F.round("total", 4).alias("total"),
                    F.round("per_second", 6).alias("per_second"))


# ---- sessions --------------------------------------------------------------------------------

@query("SELECT conv_id, turn, role, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1")
def session_latest(spark, sf):
    """Latest turn of every conversation."""
    t = Se.latest(table(spark, sf, "conversations"), "conv_id", "turn")
    return t.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


_TURNS = f"""
tu AS (SELECT conv_id || '-' || turn AS id, role, {words_sql('text')} AS ws FROM conversations WHERE role <> 'system' AND turn >= 1),
ti AS (SELECT id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM tu),
qi AS (SELECT item_id AS id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, {words_sql('text')} AS ws FROM benchmark)),
{codebook_sql("SELECT a FROM ti UNION SELECT a FROM qi", 64)}, {_vec_sql('ti', 'cb', 'tv')}, {_vec_sql('qi', 'cb', 'qv')},
tl AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM tv GROUP BY id), ql AS (SELECT id, list(x ORDER BY d)::FLOAT[] AS v FROM qv GROUP BY id),
sc AS (SELECT q.id AS query_id, t.id AS doc_id, list_dot_product(q.v, t.v) AS s FROM ql q, tl t),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM sc WHERE s >= 0) WHERE r <= 10),
b AS (SELECT h.*, role, row_number() OVER (PARTITION BY query_id, role ORDER BY s DESC, doc_id) AS n FROM h JOIN tu ON tu.id = doc_id)"""


@query(f"WITH {_TURNS} SELECT query_id, role, string_agg(doc_id, ',' ORDER BY n) AS briefing FROM b WHERE n <= 3 GROUP BY query_id, role")
def session_briefing(spark, sf):
    """Best recent turns per passage and role, after tag and time guards."""
    c = table(spark, sf, "conversations").where("role <> 'system' AND turn >= 1")
    turns = c.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "role", X.words(F.col("text")).alias("w"))
    corpus = turns.where(F.size("w") > 0).select("doc_id", "role", E.encode_ngrams("w", 64).alias("vec"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), X.words(F.col("text")).alias("w"))
    hits = S.search_table(corpus, b.select("query_id", E.encode_ngrams("w", 64).alias("vec")), 64, 10)
    docs = turns.select("doc_id", "role", F.col("doc_id").alias("turn_id"))
    out = Se.briefing(hits, docs, "role", "turn_id", 3)
    return out.select("query_id", "role", F.array_join("briefing", ",").alias("briefing"))


_PART = flat_map_sql("part", "p_partkey", PS.PART, PS.D)


@query(f"""WITH {_PART}, {codebook_sql("SELECT unnest(['p_brand', 'Brand#13', 'p_type', 'ECONOMY']) AS a", PS.D, 'qb')},
qkv(id, k, v) AS (VALUES (0, 'p_brand', 'Brand#13'), (0, 'p_type', 'ECONOMY')), {map_sql('qm', 'qkv', 'qb')},
ok AS (SELECT p_partkey FROM part WHERE p_size >= 10 AND p_retailprice < 1500),
s1 AS (SELECT dv.id, sum(dv.x * qm.x) AS s FROM dv JOIN qm USING (d) WHERE dv.id IN (SELECT p_partkey FROM ok) GROUP BY dv.id),
top AS (SELECT id FROM s1 WHERE s >= 0 ORDER BY s DESC, id LIMIT 5),
bu AS (SELECT d, sign(sum(x)) AS x FROM dv WHERE id IN (SELECT id FROM top) GROUP BY d),
s2 AS (SELECT dv.id, sum(dv.x * bu.x) AS s FROM dv JOIN bu USING (d) WHERE dv.id IN (SELECT p_partkey FROM ok) GROUP BY dv.id)
SELECT id AS doc_id, round(s / {PS.D}.0, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rank FROM s2 WHERE s >= 0 QUALIFY rank <= 10""")
def hypothesis_refinement(spark, sf):
    """Filter, bundle the five best hits, search again with the bundle."""
    keep = (F.col("p_size") >= 10) & (F.col("p_retailprice") < 1500)
    out = Se.refine(PS.parts(spark, sf), {"p_brand": "Brand#13", "p_type": "ECONOMY"}, PS.D, keep, 5, 10)
    return out.withColumn("score", F.round("score", 6))


