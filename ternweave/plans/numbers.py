"""Numeric bands and property signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions import bands as B
from ternweave.operators import encode as E
from ternweave.operators import signatures as G
from ternweave.plans.common import HEX, codebook_sql, hex_text, query, table

D = 256


def _case(value, limits, op="<"):
    pairs, last = limits
    return "CASE " + " ".join(f"WHEN {value} {op} {x} THEN '{label}'" for x, label in pairs) + f" ELSE '{last}' END"


VALUES = {
    "convergence_rate": ("lineitem", "l_discount * 10", _case("l_discount * 10", B.PRIMITIVES["convergence_rate"])),
    "iteration_complexity": ("lineitem", "l_quantity * 6", _case("l_quantity * 6", B.PRIMITIVES["iteration_complexity"])),
    "frequency_domain": ("events", "value * value", _case("value * value", B.PRIMITIVES["frequency_domain"])),
    "amplitude_scale": ("events", "value", _case("value", B.PRIMITIVES["amplitude_scale"])),
    "power_law_exponent": ("lineitem", "l_tax * 40 + 1", _case("l_tax * 40 + 1", B.PRIMITIVES["power_law_exponent"])),
    "clustering_coefficient": ("lineitem", "l_discount * 9", _case("l_discount * 9", B.PRIMITIVES["clustering_coefficient"])),
    "topological_distance": ("lineitem", "l_linenumber * 2",
                             _case("l_linenumber * 2", ([(x, y + "_distance") for x, y in B.DISTANCE], "minimal_distance"), ">")),
    "self_similarity": ("lineitem", "l_discount * 10",
                        "'self_similarity_level_' || CAST(CAST(trunc(l_discount * 10 * 3) AS BIGINT) + 1 AS VARCHAR)"),
}


def _band(primitive):
    source, value, case = VALUES[primitive]

    @query(f"SELECT {case} AS label, count(*) AS n FROM {source} GROUP BY 1", name=f"band_{primitive}")
    def run(spark, sf):
        t = table(spark, sf, source)
        return (t.select(B.primitive_label(primitive, F.expr(value)).alias("label"))
                .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


for _primitive in VALUES:
    _band(_primitive)

_ATOMS = " UNION ".join(f"SELECT '{p}' AS primitive, {VALUES[p][2]} AS a FROM {VALUES[p][0]}" for p in VALUES)


@query(f"""WITH lab AS ({_ATOMS}), {codebook_sql("SELECT a FROM lab", D)},
v AS (SELECT a, {HEX} AS vec FROM cb GROUP BY a) SELECT primitive, a AS label, vec FROM lab JOIN v USING (a)""")
def primitive_vectors(spark, sf):
    """Vectors of all labels in use, dispatched by primitive name."""
    out = None
    for p, (source, value, _) in VALUES.items():
        part = table(spark, sf, source).select(F.lit(p).alias("primitive"),
                                               B.primitive_label(p, F.expr(value)).alias("label")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.withColumn("vec", hex_text(E.encode_atom("label", D)))


def _signature_sql(source, key, labels, group=""):
    atoms = " UNION ".join(f"SELECT l{i} AS a FROM s" for i in range(len(labels)))
    joins = "".join(f" JOIN cb c{i} ON c{i}.a = s.l{i}" + (f" AND c{i}.d = c0.d" if i else "") for i in range(len(labels)))
    prod = " * ".join(f"c{i}.x" for i in range(len(labels)))
    cols = ", ".join(f"{e} AS l{i}" for i, e in enumerate(labels))
    return f"""WITH s AS (SELECT {key} AS id, {cols} FROM {source} {group}), {codebook_sql(atoms, D)},
v AS (SELECT id, c0.d, {prod} AS x FROM s{joins})
SELECT id AS {key}, {HEX} AS vec FROM v GROUP BY id"""


_PANEL = """(SELECT l_suppkey, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS q,
 CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS d,
 CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS t, max(l_discount) AS md FROM lineitem GROUP BY l_suppkey)"""


def _supplier_means(spark, sf):
    """Exact means per supplier: sums of hundredths are integers, so no summation order shows."""
    def mean(c):
        return F.sum(F.round(F.col(c) * 100).cast("bigint")).cast("double") / 100 / F.count(F.lit(1))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        mean("l_quantity").alias("q"), mean("l_discount").alias("d"), mean("l_tax").alias("t"),
        F.max("l_discount").alias("md"))


def _supplier_signature(name, sql_labels, labels):
    @query(_signature_sql(_PANEL, "l_suppkey", sql_labels), name=name)
    def run(spark, sf):
        return _supplier_means(spark, sf).select("l_suppkey", hex_text(G.signature(labels(), D)).alias("vec"))


def _lev(e):
    return f"CAST(CAST(trunc(({e}) * 3) AS BIGINT) + 1 AS VARCHAR)"


_supplier_signature("signature_fractal", [
    "'fractal_pattern'", f"'convergence_' || {_case('d * 10', B.CONVERGENCE)}", f"'iteration_' || {_case('q', B.ITERATION)}",
    f"'boundary_' || {_case('t * 10', B.BOUNDARY)}", f"'self_similarity_' || {_lev('d * 10')}"],
    lambda: G.fractal_labels(F.col("d") * 10, F.col("q"), F.col("t") * 10, F.col("d") * 10))
_supplier_signature("signature_wave", [
    "'wave_phenomenon'", f"'frequency_' || {_case('q / 20', B.FREQUENCY)}", f"'amplitude_' || {_case('md * 30', B.AMPLITUDE)}",
    f"'phase_' || {_case('((t * 100) % 6.283185307179586::DOUBLE)', B.PHASE)}", f"'interference_' || {_case('d * 10', B.INTERFERENCE)}"],
    lambda: G.wave_labels(F.col("q") / 20, F.col("md") * 30, F.col("t") * -100, F.col("d") * 10))
_supplier_signature("signature_polynomial", [
    "'polynomial_curve'", "'degree_' || CASE l_suppkey % 5 WHEN 1 THEN 'linear' WHEN 2 THEN 'quadratic' WHEN 3 THEN 'cubic' ELSE 'higher_order' END",
    f"'coefficient_' || {_case('greatest(q / 20, d, t)', B.COEFFICIENT)}", "'root_complex'", "'domain_periodic'"]
    , lambda: G.polynomial_labels(F.col("l_suppkey") % 5, F.array(-F.col("q") / 20, F.col("d"), F.col("t")), "complex", "periodic"))
_supplier_signature("signature_scale_free", [
    "'scale_free_topology'", f"'power_law_' || {_case('q / 10', B.POWER_LAW)}", f"'hub_' || {_case('d * 12', B.HUB)}", "'growth_preferential'"],
    lambda: G.scale_free_labels(F.col("q") / 10, F.col("d") * 12))
_supplier_signature("signature_small_world", [
    "'small_world_topology'", f"'clustering_' || {_case('d * 10', B.CLUSTERING)}",
    f"'path_' || {_case('q / 4', (B.DISTANCE, 'minimal'), '>')}", f"'rewiring_' || {_case('t * 4', B.REWIRING)}"],
    lambda: G.small_world_labels(F.col("d") * 10, F.col("q") / 4, F.col("t") * 4))
_supplier_signature("signature_random", [
    "'random_topology'", f"'connection_' || {_case('t * 4', B.CONNECTION)}", f"'variance_' || {_case('d * 11', B.VARIANCE)}",
    f"'clustering_' || {_case('t * 9', B.CLUSTERING_LEVEL)}"],
    lambda: G.random_labels(F.col("t") * 4, F.col("d") * 11, F.col("t") * 9))
_supplier_signature("signature_composed_fractal", [
    _case("q", B.PRIMITIVES["iteration_complexity"]), _case("d * 10", B.PRIMITIVES["convergence_rate"]), "'self_similarity_level_3'"],
    lambda: G.composed_fractal(F.col("q"), F.col("d") * 10))
_supplier_signature("signature_composed_wave", [
    _case("q", B.PRIMITIVES["frequency_domain"]), _case("md * 30", B.PRIMITIVES["amplitude_scale"])],
    lambda: G.composed_wave(F.col("q"), F.col("md") * 30))


# ---- rule matrices and their semantic enhancement --------------------------------------------

MATRIX_RULES = ("fractal", "wave", "polynomial", "progression")

_PROPS = """pp AS (SELECT l_suppkey AS matrix_id, CAST(round(l_quantity * 3) AS BIGINT) AS iterations,
  CAST(round(l_discount * 100) AS BIGINT) AS inter FROM lineitem),
pr AS (SELECT matrix_id, sum(iterations) / CAST(count(*) AS DOUBLE) AS avg_iterations,
  sum(CAST(iterations < 50 AS INT)) / CAST(count(*) AS DOUBLE) AS convergence_rate,
  CASE WHEN max(iterations) > 100 THEN 'high' ELSE 'moderate' END AS complexity_level,
  sum(inter) / CAST(count(*) AS DOUBLE) AS interference_strength, max(inter) AS amplitude FROM pp GROUP BY matrix_id)"""


def matrix_panels(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("matrix_id"), F.round(F.col("l_quantity") * 3).cast("bigint").alias("iterations"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("interference"))


@query(f"""WITH {_PROPS} SELECT matrix_id, round(avg_iterations, 6) AS avg_iterations, round(convergence_rate, 6) AS convergence_rate,
  complexity_level, round(interference_strength, 6) AS interference_strength, amplitude FROM pr""")
def panel_properties(spark, sf):
    """Aggregate properties of each matrix's panels."""
    p = G.panel_properties(matrix_panels(spark, sf))
    return p.select("matrix_id", F.round("avg_iterations", 6).alias("avg_iterations"),
                    F.round("convergence_rate", 6).alias("convergence_rate"), "complexity_level",
                    F.round("interference_strength", 6).alias("interference_strength"), "amplitude")


_RULE = "CASE s_nationkey % 4 WHEN 0 THEN 'fractal' WHEN 1 THEN 'wave' WHEN 2 THEN 'polynomial' ELSE 'progression' END"
_SEM_LABELS = {
    "fractal": ["'fractal_pattern'", f"'convergence_' || {_case('convergence_rate', B.CONVERGENCE)}",
                f"'iteration_' || {_case('avg_iterations', B.ITERATION)}", "'boundary_chaotic'", "'self_similarity_2'"],
    "wave": ["'wave_phenomenon'", "'frequency_high'", f"'amplitude_' || {_case('amplitude', B.AMPLITUDE)}", "'phase_in_phase'",
             f"'interference_' || {_case('interference_strength', B.INTERFERENCE)}"],
    "polynomial": ["'polynomial_curve'", "'degree_quadratic'", "'coefficient_large'", "'root_real'", "'domain_monotonic'"],
}
_SEM = " UNION ALL ".join(f"SELECT matrix_id, {e} AS a FROM sm WHERE rule = '{r}'" for r, es in _SEM_LABELS.items() for e in es)


@query(f"""WITH {_PROPS}, sm AS (SELECT pr.*, {_RULE} AS rule, s_name FROM pr JOIN supplier ON s_suppkey = matrix_id),
sl AS ({_SEM}),
{codebook_sql("SELECT a FROM sl UNION SELECT rule FROM sm UNION SELECT s_name FROM sm UNION SELECT unnest(['rule', 'name'])", D)},
st AS (SELECT matrix_id, r.d, sign(kr.x * r.x + kn.x * n.x) AS x FROM sm JOIN cb r ON r.a = rule JOIN cb n ON n.a = s_name AND n.d = r.d
  JOIN cb kr ON kr.a = 'rule' AND kr.d = r.d JOIN cb kn ON kn.a = 'name' AND kn.d = r.d),
sg AS (SELECT matrix_id, d, CASE WHEN min(abs(x)) = 0 THEN 0 WHEN sum(CAST(x < 0 AS INT)) % 2 = 1 THEN -1 ELSE 1 END AS x
  FROM sl JOIN cb USING (a) GROUP BY matrix_id, d),
v AS (SELECT matrix_id, d, CASE WHEN sg.x IS NULL THEN st.x ELSE st.x * sg.x END AS x FROM st LEFT JOIN sg USING (matrix_id, d))
SELECT matrix_id, {HEX} AS vec FROM v GROUP BY matrix_id""")
def semantic_enhancement(spark, sf):
    """Structural vector bound with the signature of the matrix's rule, where it has one."""
    props = G.panel_properties(matrix_panels(spark, sf))
    s = table(spark, sf, "supplier")
    rule = F.element_at(F.array(*[F.lit(r) for r in MATRIX_RULES]), (F.col("s_nationkey") % 4 + 1).cast("int"))
    m = props.join(s.select(F.col("s_suppkey").alias("matrix_id"), rule.alias("rule"), F.col("s_name").alias("name")), "matrix_id")
    structural = E.encode_row("rule", "name", dims=D)
    return m.select("matrix_id", hex_text(G.semantic_vector(structural, G.matrix_labels(F.col("rule")), D)).alias("vec"))
