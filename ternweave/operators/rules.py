"""Rule grids and forward chaining.

``panels(matrix_id, row, col, shapes, count, color)`` holds the visible cells and
``matrices(matrix_id, rule, missing_row, missing_col)`` the cell to complete.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ternweave.functions.session import checkpoint_dir
from ternweave.operators import search as S
from ternweave.operators.encode import encode

# Shapes and colours of the rules, in rule order.
SHAPES = ["circle", "square", "triangle", "diamond", "star"]
XOR_SHAPES = ["circle", "square", "triangle"]
COLORS = ["black", "white", "red", "blue", "green"]


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def shape_bits(shapes: Column | str, known=SHAPES) -> Column:
    """An array of shapes as a bit mask, in the order of ``known``; a shape that isn't known is an error."""
    c = F.col(shapes) if isinstance(shapes, str) else shapes
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(c, s), F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(known)])
    other = F.array_except(c, F.array(*[F.lit(s) for s in known]))
    return F.when(F.size(other) > 0, F.raise_error(F.concat(F.lit("unknown shapes: "), F.array_join(other, ", "))).cast("int")).otherwise(bits)


def shapes_of(bits: Column, known=SHAPES) -> Column:
    """The sorted array of a bit mask's shapes."""
    named = F.array(*[F.when(bits.bitwiseAND(1 << i) != 0, F.lit(s)) for i, s in sorted(enumerate(known), key=lambda x: x[1])])
    return F.filter(named, lambda s: s.isNotNull())


def lines(cells: DataFrame, keep=()) -> DataFrame:
    """One row per grid of ``cells(matrix_id, rule, missing_row, missing_col, row, col, shapes, visible, ...)`` of any size: the shapes,
    as bits, of every visible panel of the missing cell's row (``row_all``) and column (``col_all``), and the same without the cell itself
    (``row_rest``, ``col_rest``); and the aggregates ``keep``.

    Rows and columns are folded by bit masks in one aggregate per grid, combined before the shuffle.  A
    line without a visible panel has no shapes."""
    bits, seen = shape_bits("shapes"), F.col("visible")
    on_row, on_col = F.col("row") == F.col("missing_row"), F.col("col") == F.col("missing_col")

    def fold(where: Column, name: str) -> Column:
        return F.coalesce(F.bit_and(F.when(seen & where, bits)), F.lit(0)).alias(name)

    return cells.groupBy("matrix_id", "rule", "missing_row", "missing_col").agg(
        fold(on_row, "row_all"), fold(on_col, "col_all"), fold(on_row & ~on_col, "row_rest"), fold(on_col & ~on_row, "col_rest"), *keep)


def expected() -> tuple[Column, Column]:
    """(bits, color) of the missing panel of a row of :func:`lines`, by its rule; null for an unknown rule."""
    row, col, rule = F.col("missing_row").cast("int"), F.col("missing_col").cast("int"), F.col("rule")
    first = F.least(row + col - 1, F.lit(len(SHAPES)))
    bits = (F.when(rule == "progression", reduce(lambda a, i: F.when(first == i, F.lit((1 << i) - 1)).otherwise(a), range(1, len(SHAPES) + 1), F.lit(0)))
            .when(rule == "xor", row.bitwiseXOR(col).bitwiseAND((1 << len(XOR_SHAPES)) - 1))
            .when(rule == "union", F.col("row_all").bitwiseOR(F.col("col_all")))
            .when(rule == "intersection", F.col("row_rest").bitwiseAND(F.col("col_rest"))))
    color = (F.when(rule == "progression", _pick(COLORS, (col - 1) % 5)).when(rule == "xor", F.lit("black"))
             .otherwise(_pick(COLORS, (row + col - 2) % 5)))
    return bits, color


def complete_cells(cells: DataFrame) -> DataFrame:
    """Expected missing panel of each grid (see :func:`lines`): (matrix_id, rule, shapes, count, color)."""
    bits, color = expected()
    return (lines(cells).withColumn("bits", bits).where("bits is not null")
            .select("matrix_id", "rule", shapes_of(F.col("bits")).alias("shapes"), F.bit_count("bits").alias("count"), color.alias("color")))


def judge_cells(cells: DataFrame) -> DataFrame:
    """(matrix_id, rule, correct) of the grids whose missing panel is among the cells, as one that isn't visible: whether the
    expected shapes, count and colour all equal it.  No join: the panel is kept by the same aggregate."""
    hidden = ~F.col("visible") & (F.col("row") == F.col("missing_row")) & (F.col("col") == F.col("missing_col"))
    truth = F.max(F.when(hidden, F.struct(shape_bits("shapes").alias("bits"), F.col("count").alias("n"), F.col("color").alias("color")))).alias("truth")
    bits, color = expected()
    own = lines(cells, (truth,)).withColumn("bits", bits).where("bits is not null and truth is not null")
    ok = (F.col("bits") == F.col("truth.bits")) & (F.bit_count("bits") == F.col("truth.n")) & (color == F.col("truth.color"))
    return own.select("matrix_id", "rule", F.coalesce(ok, F.lit(False)).alias("correct"))


def complete(panels: DataFrame, matrices: DataFrame) -> DataFrame:
    """Expected missing panel by rule: (matrix_id, rule, shapes, count, color)."""
    cells = matrices.select("matrix_id", "rule", "missing_row", "missing_col").join(panels.withColumn("visible", F.lit(True)), "matrix_id", "left")
    return complete_cells(cells.withColumn("visible", F.coalesce("visible", F.lit(False))))


def position(row: Column, col: Column) -> Column:
    return F.concat(F.lit("row"), row.cast("string"), F.lit("-col"), col.cast("string"))


def grid_vectors(panels: DataFrame, matrices: DataFrame, dims: int, fields=("shapes", "count", "color")) -> DataFrame:
    """(matrix_id, vec) of ``{panels: {position: {shapes, count, color}}, rule}``.  A grid has few
    cells, so gathering them per matrix is bounded."""
    cell = F.struct(position(F.col("row"), F.col("col")), F.struct(*fields))
    g = panels.groupBy("matrix_id").agg(F.map_from_entries(F.collect_list(cell)).alias("panels"))
    return (g.join(matrices.select("matrix_id", "rule"), "matrix_id")
            .select("matrix_id", encode(F.struct("panels", "rule"), dims, sets=("panels.*.shapes",)).alias("vec")))


def nearest_completion(visible: DataFrame, matrices: DataFrame, full: DataFrame, dims: int,
                       fields=("shapes", "count", "color")) -> DataFrame:
    """Missing panel copied from the most similar other complete grid:
    (matrix_id, rule, shapes, count, color).

    ``full(matrix_id, row, col, ...)`` holds the panels of complete grids only; incomplete grids
    never serve as a source.  Grids of one and the same vector are compared once.
    """
    probes = grid_vectors(visible, matrices, dims, fields).select(F.col("matrix_id").alias("query_id"), "vec")
    rules = matrices.select("matrix_id", "rule")
    known = grid_vectors(full, rules, dims, fields).select(F.col("matrix_id").alias("doc_id"), "vec")
    hits = S.search_classes(known, probes, dims, 1, None, exclude_self=True)
    asked = (hits.select(F.col("query_id").alias("matrix_id"), F.col("doc_id").alias("source"))
             .join(matrices, "matrix_id"))
    cells = full.select(F.col("matrix_id").alias("source"), F.col("row").alias("missing_row"),
                        F.col("col").alias("missing_col"), "shapes", "count", "color")
    return (asked.join(cells, ["source", "missing_row", "missing_col"], "left")
            .select("matrix_id", "rule", F.array_sort(F.coalesce("shapes", F.array().cast("array<string>"))).alias("shapes"),
                    F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("color", F.lit("unknown")).alias("color")))


def judge(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(matrix_id, rule, correct): shapes as sets, count and colour all equal."""
    t = truth.select("matrix_id", F.array_sort("shapes").alias("ts"), F.col("count").alias("tc"), F.col("color").alias("tk"))
    ok = (F.array_sort("shapes") == F.col("ts")) & (F.col("count") == F.col("tc")) & (F.col("color") == F.col("tk"))
    return predicted.join(t, "matrix_id").select("matrix_id", "rule", F.coalesce(ok, F.lit(False)).alias("correct"))


# ---- forward chaining ------------------------------------------------------------------------

FACT = ("subject", "relation", "object")


def forward_chain(facts: DataFrame, rules: list, max_rounds: int | None = None) -> DataFrame:
    """Facts derived from ``facts(subject, relation, object)`` by ``rules``, with an ``is_input`` flag.

    A rule is ``rule(known, fresh) -> DataFrame`` of facts; ``fresh`` are the facts of the last
    round, so a rule can join only what is new.  Facts already known are removed, hence nothing
    is derived twice, and the loop goes on until a round adds nothing: the closure is complete.  A given
    ``max_rounds`` that is not enough is an error.  Each round's facts are stored once and never rewritten.
    """
    checkpoint_dir(facts.sparkSession)
    known = fresh = facts.select(*FACT).distinct().withColumn("is_input", F.lit(True)).checkpoint()
    for done in itertools.count():
        made = reduce(lambda a, b: a.unionByName(b), [r(known, fresh).select(*FACT) for r in rules])
        fresh = (made.distinct().join(known.select(*FACT), list(FACT), "left_anti")
                 .withColumn("is_input", F.lit(False))).checkpoint()
        if not fresh.limit(1).count():
            return known
        if done == max_rounds:
            raise RuntimeError(f"facts still follow after {max_rounds} rounds")
        known = known.unionByName(fresh)


def replay(derived: DataFrame, rules: list, max_rounds: int | None = None) -> DataFrame:
    """Chain again from the input facts alone."""
    return forward_chain(derived.where("is_input"), rules, max_rounds)


def transitive(relation: str):
    """Rule: (a, relation, b) and (b, relation, c) give (a, relation, c)."""
    def rule(known: DataFrame, fresh: DataFrame) -> DataFrame:
        def step(left, right):
            a = left.where(F.col("relation") == relation).select("subject", F.col("object").alias("via"))
            b = right.where(F.col("relation") == relation).select(F.col("subject").alias("via"), "object")
            return a.join(b, "via").select("subject", F.lit(relation).alias("relation"), "object")
        return step(fresh, known).unionByName(step(known, fresh))
    return rule


def implies(relation: str, derived: str, value: Column | None = None):
    """Rule: (a, relation, _) gives (a, derived, value)."""
    def rule(_known: DataFrame, fresh: DataFrame) -> DataFrame:
        made = fresh.where(F.col("relation") == relation)
        return made.select("subject", F.lit(derived).alias("relation"), (value if value is not None else F.lit("true")).alias("object"))
    return rule
