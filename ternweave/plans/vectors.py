"""Atoms, codebooks, vector algebra and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternweave.functions import text as X
from ternweave.functions.rows import explode_into
from ternweave.functions.codebook import POSITION_PREFIX, atom_trits, canon_atom
from ternweave.operators import algebra as A
from ternweave.operators import encode as E
from ternweave.plans.common import (HEX, POSITION_SQL, SET_SQL, codebook_sql, flat_map_sql, hex_text, map_sql,
                                    pairs_sql, query, spread_table, table, words_sql)

D = 256
TD = 64
PART = ("p_brand", "p_type", "p_size")


# ---- atoms -----------------------------------------------------------------------------------

@query("""
WITH v AS (
  SELECT CAST(p_size AS VARCHAR) AS atom FROM part
  UNION ALL SELECT coalesce(p_brand, 'nil') FROM part
  UNION ALL SELECT CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END FROM part
  UNION ALL SELECT coalesce(CASE WHEN p_size > 40 THEN p_type END, 'nil') FROM part)
SELECT atom, count(*) AS n FROM v GROUP BY atom""")
def atom_text(spark, sf):
    """Canonical atom texts of integers, strings, booleans and nulls."""
    p = table(spark, sf, "part")
    values = F.array(canon_atom("p_size"), canon_atom("p_brand"), canon_atom(F.col("p_size") > 25, "boolean"),
                     canon_atom(F.when(F.col("p_size") > 40, F.col("p_type"))))
    return p.select(F.explode(values).alias("atom")).groupBy("atom").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(
  ['p_brand', 'p_type', 'p_size', p_brand, p_type, CAST(p_size AS VARCHAR)])), '|') AS atoms FROM part""")
def atomize_rows(spark, sf):
    """All keys and scalars of a flat document."""
    return spread_table(spark, sf, "part").select("p_partkey", F.array_join(E.atoms_of_row(*PART), "|").alias("atoms"))


@query("""
SELECT event_id, array_to_string(list_sort(list_distinct(
  ['kind', 'props', 'k', event_type, json_extract_string(props, '$.k')])), '|') AS atoms FROM events""")
def atomize_json(spark, sf):
    """All keys and scalars of a nested JSON document."""
    doc = F.to_json(F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k INT").alias("props")))
    return spread_table(spark, sf, "events").select("event_id", F.array_join(E.atoms_of_json(doc), "|").alias("atoms"))


@query(f"WITH {codebook_sql('SELECT p_brand AS a FROM part UNION SELECT p_type FROM part UNION SELECT n_name FROM nation', D)} "
       f"SELECT a AS atom, {HEX} AS vec FROM cb GROUP BY a")
def codebook_vectors(spark, sf):
    """Atom vectors of every brand, type and nation name."""
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    atoms = (p.select(F.explode(F.array("p_brand", "p_type")).alias("atom")).union(n.select("n_name"))).distinct()
    return atoms.select("atom", hex_text(E.encode_atom("atom", D)).alias("vec"))


@query(f"WITH {codebook_sql('SELECT p_brand AS a FROM part', D)} "
       "SELECT a AS atom, array_to_string(list(x ORDER BY d), ',') AS trits FROM cb GROUP BY a", name="codebook_builtin")
def codebook_builtin(spark, sf):
    """The same lookup as a built-in expression, without Python."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("atom")).distinct()
    return brands.select("atom", F.array_join(atom_trits(F.col("atom"), D).cast("array<string>"), ",").alias("trits"))


@query(f"WITH {codebook_sql(f'SELECT {POSITION_SQL} || CAST(l_linenumber AS VARCHAR) AS a FROM lineitem', D)} "
       f"SELECT CAST(split_part(a, ':', 2) AS BIGINT) AS position, {HEX} AS vec FROM cb GROUP BY a")
def position_vectors(spark, sf):
    """Position vectors of the line numbers in use."""
    pos = table(spark, sf, "lineitem").select("l_linenumber").distinct()
    atom = F.concat(F.lit(POSITION_PREFIX), F.col("l_linenumber").cast("string"))
    return pos.select(F.col("l_linenumber").cast("bigint").alias("position"),
                      hex_text(E.encode_atom(atom, D)).alias("vec"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({words_sql('text')}) AS atom FROM documents)
SELECT atom, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM w GROUP BY atom""")
def vocabulary_frequency(spark, sf):
    """Occurrences and document counts per word."""
    w = explode_into(spread_table(spark, sf, "documents"), X.words(F.col("text")), "atom", "doc_id")
    per_doc = w.groupBy("atom", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("atom").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


@query(f"""
WITH w AS (SELECT unnest({words_sql('text')}) AS atom FROM documents)
SELECT count(*) AS occurrences, count(DISTINCT atom) AS atoms FROM w""")
def vocabulary_size(spark, sf):
    """Number of words and of distinct words."""
    w = explode_into(spread_table(spark, sf, "documents"), X.words(F.col("text")), "atom")
    return w.groupBy("atom").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("atoms"))


def turns(spark, sf):
    """Turns with at least one word: (turn_id, words)."""
    c = spread_table(spark, sf, "conversations")
    return (c.select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), X.words(F.col("text")).alias("words"))
            .where(F.size("words") > 0))


TURNS = (f"u AS (SELECT * FROM (SELECT conv_id || '-' || turn AS id, {words_sql('text')} AS ws FROM conversations) "
         "WHERE len(ws) > 0), it AS (SELECT id, len(ws) AS n, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS i FROM u)")


@query(f"""
WITH {TURNS}, g AS (SELECT DISTINCT id, a || ' ' || lead(a) OVER (PARTITION BY id ORDER BY i) AS gram FROM it),
t AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM u)
SELECT gram, count(*) AS df, round(ln(any_value(total) / count(*)), 6) AS idf FROM g, t
WHERE gram IS NOT NULL GROUP BY gram""")
def idf_bigrams(spark, sf):
    """Inverse document frequency per bigram over all turns."""
    return E.idf_table(turns(spark, sf), "turn_id", "words", 2).select(
        F.array_join("gram", " ").alias("gram"), "df", F.round("idf", 6).alias("idf"))


# ---- encoders --------------------------------------------------------------------------------

PART_MAP = flat_map_sql("part", "p_partkey", PART, D)


@query(f"WITH {PART_MAP} SELECT id AS p_partkey, {HEX} AS vec FROM dv GROUP BY id")
def encode_map(spark, sf):
    """Flat rows as maps."""
    return spread_table(spark, sf, "part").select("p_partkey", hex_text(E.encode_row(*PART, dims=D)).alias("vec"))


@query(f"""
WITH w AS (SELECT p_partkey AS id, unnest(list_distinct(string_split(p_name, ' '))) AS a FROM part),
{codebook_sql(f"SELECT a FROM w UNION SELECT {SET_SQL}", D)},
s AS (SELECT id, d, CAST(sign(sum(x)) AS INT) AS x FROM w JOIN cb USING (a) GROUP BY id, d),
b AS (SELECT id, d, s.x * cb.x AS x FROM s JOIN cb USING (d) WHERE cb.a = {SET_SQL})
SELECT id AS p_partkey, {HEX} AS vec FROM b GROUP BY id""")
def encode_set(spark, sf):
    """The distinct words of a part name as a set."""
    words = F.array_distinct(F.split("p_name", " "))
    return spread_table(spark, sf, "part").select("p_partkey", hex_text(E.encode(words, D, sets=("",))).alias("vec"))


def _list_query(mode, **config):
    def run(spark, sf):
        return turns(spark, sf).select("turn_id", hex_text(E.encode("words", TD, modes={"": (mode, config)})).alias("vec"))
    return run


_BOOK = codebook_sql("SELECT a FROM it", TD)
_DONE = f"SELECT id AS turn_id, {HEX} AS vec FROM s GROUP BY id"

query(f"""WITH {TURNS}, {_BOOK}, {codebook_sql(f"SELECT {POSITION_SQL} || CAST(i AS VARCHAR) AS a FROM it", TD, 'pb')},
s AS (SELECT id, cb.d, CAST(sign(sum(cb.x * pb.x)) AS INT) AS x FROM it JOIN cb ON cb.a = it.a
      JOIN pb ON pb.a = {POSITION_SQL} || CAST(i AS VARCHAR) AND pb.d = cb.d GROUP BY id, cb.d)
{_DONE}""", name="encode_list_positional")(_list_query("positional"))

query(f"""WITH {TURNS}, {_BOOK},
s AS (SELECT id, d, CASE WHEN min(abs(x)) = 0 THEN 0 WHEN sum(CAST(x < 0 AS INT)) % 2 = 1 THEN -1 ELSE 1 END AS x
      FROM it JOIN cb USING (a) GROUP BY id, d) {_DONE}""", name="encode_list_chained")(_list_query("chained"))

query(f"""WITH {TURNS}, {_BOOK},
s AS (SELECT id, d, CAST(sign(sum(x)) AS INT) AS x FROM it JOIN cb USING (a) GROUP BY id, d) {_DONE}""",
      name="encode_list_bundle")(_list_query("bundle"))


def ngram_sql(sizes, weight="1.0", short=2, where="", variance=False) -> str:
    """Weighted n-grams of the turns; ``weight`` may use n (size), w (base), i, len, ord, nnz, tot."""
    items, offset = [], "0"
    joins = {1: "a1.a", 2: "a2.a", 3: "a3.a"}
    for n, w in sizes:
        cols = ", ".join(f"lead(a, {k}) OVER (PARTITION BY id ORDER BY i) AS a{k}" for k in range(1, n))
        gram = " || chr(2) || ".join(["a"] + [f"a{k}" for k in range(1, n)])
        items.append(
            f"SELECT id, n AS len, i, {n} AS n, CAST({w} AS DOUBLE) AS w, {offset} + i AS ord, {gram} AS gram, a"
            + "".join(f", a{k}" for k in range(1, n)) + "".join(f", NULL AS a{k}" for k in range(n, 4))
            + f" FROM (SELECT *{', ' + cols if cols else ''} FROM it) WHERE n >= {short} AND i + {n} <= n {where}")
        offset += f" + greatest(n - {n} + 1, 0)"
    del joins
    if short > 1:
        items.append("SELECT id, n AS len, i, 0 AS n, CAST(1 AS DOUBLE) AS w, i AS ord, a AS gram, a, NULL AS a1, "
                     f"NULL AS a2, NULL AS a3 FROM it WHERE n < {short}")
    pats = " UNION ALL ".join(items)
    deep = max(n for n, _ in sizes)
    prod = "c0.x" + "".join(f" * coalesce(c{k}.x, 1)" for k in range(1, deep))
    book_joins = "".join(f" LEFT JOIN cb c{k} ON c{k}.a = g.a{k} AND c{k}.d = c0.d" for k in range(1, deep))
    expr = f"CASE WHEN n = 0 THEN 1.0 ELSE {weight} END"
    return f"""
pat AS ({pats}),
gp AS (SELECT g.gram, c0.d, {prod} AS x FROM (SELECT DISTINCT gram, a, a1, a2, a3 FROM pat) g
       JOIN cb c0 ON c0.a = g.a{book_joins}),
gs AS (SELECT gram, count(*) FILTER (x <> 0) AS nnz, sum(x) AS tot FROM gp GROUP BY gram),
pw AS (SELECT id, gram, CAST(sum(CAST(floor({expr} * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS k
       FROM pat JOIN gs USING (gram) GROUP BY id, gram),
s AS (SELECT id, d, CAST(sign(sum(k * x)) AS INT) AS x FROM pw JOIN gp USING (gram) GROUP BY id, d)"""


def _ngram(name, sizes, weight="w", short=2, where="", mode="ngram", **config):
    query(f"WITH {TURNS}, {_BOOK}, {ngram_sql(sizes, weight, short, where)} {_DONE}", name=name)(
        _list_query(mode, **config))


_ngram("encode_ngram_default", [(1, 1), (2, 1)])
_ngram("encode_ngram_sizes_weights", [(1, 0.25), (2, 1), (3, 2.5)], n_sizes=[1, 2, 3], weights=[0.25, 1.0, 2.5])
_ngram("encode_ngram_length_penalty", [(1, 1), (2, 1)], "w * CASE WHEN ord < len THEN 1.2 ELSE 0.8 END",
       length_penalty=True)
_ngram("encode_ngram_term_weighting", [(1, 1), (2, 1)],
       f"w * CASE WHEN n = 1 THEN least(greatest(sqrt(CAST(nnz AS DOUBLE)) * (nnz / {TD}.0::DOUBLE) / 1000.0, 0.5), 2.0) ELSE 1.0 END",
       term_weighting=True)
_ngram("encode_ngram_positional_weighting", [(1, 1), (2, 1)],
       "w * CASE WHEN n > 1 THEN CAST(1 AS DOUBLE) / (i + 1) ELSE 1.0 END", positional_weighting=True)
_VAR = f"(nnz / {TD}.0::DOUBLE - (CAST(tot AS BIGINT) / {TD}.0::DOUBLE) * (CAST(tot AS BIGINT) / {TD}.0::DOUBLE))"
_ngram("encode_ngram_discrimination", [(1, 0.1), (2, 1)], f"w * least(w * w * {_VAR} / 0.1::DOUBLE, 1.5)",
       n_sizes=[1, 2], weights=[0.1, 1.0], discrimination_boost=True)
_ngram("encode_ngram_short_boosted", [(2, 1), (3, 1)], "w * CASE WHEN ord < len THEN 1.2 ELSE 0.8 END",
       n_sizes=[2, 3], length_penalty=True)
_ngram("encode_ngram_idf_by_position", [(1, 1), (2, 1)],
       "w * CASE WHEN n = 1 THEN 0.8 WHEN i = 0 THEN 2.0 WHEN i = 1 THEN 1.5 ELSE 1.0 END",
       idf_weighting=True, corpus_stats={"ngram_2_0": 3.0, "ngram_2_1": 1.5})
_ngram("encode_ngram_configurable", [(2, 1)], short=0, mode="ngram_configurable")
_ngram("encode_ngram_configurable_trigram", [(1, 1), (3, 2)], short=0, mode="ngram_configurable",
       n_sizes=[1, 3], weights=[1.0, 2.0])
_ngram("encode_ngram_weighted", [(2, 1), (1, 0.5)], mode="ngram_weighted")
_ngram("encode_subsequence_sliding", [(3, 1)], "w / (i + 1)", short=3, mode="subsequence_aligned")
_ngram("encode_subsequence_best_match", [(3, 1)], short=3, where="AND i = 0", mode="subsequence_aligned",
       alignment_mode="best_match")
_ngram("encode_context_window", [(3, 1)], short=3, where="AND i % 2 = 0", mode="context_window", window_size=3, stride=2)
_ngram("encode_preset_phrases", [(2, 1), (3, 1)], mode="ngram", n_sizes=[2, 3])


@query(f"""
WITH {TURNS}, {_BOOK}, f(field, term, fw) AS (VALUES ('short', 'the', 2), ('short', 'and', 2), ('long', 'que', 1), ('long', 'der', 1)),
{codebook_sql("SELECT term AS a FROM f", TD, 'fb')},
fv AS (SELECT field, any_value(fw) AS fw, d, sign(sum(x)) AS x FROM f JOIN fb ON fb.a = term GROUP BY field, d),
sem AS (SELECT d, sign(sum(fw * x)) AS x FROM fv GROUP BY d),
b AS (SELECT id, d, sign(sum(x)) AS x FROM it JOIN cb USING (a) GROUP BY id, d),
s AS (SELECT id, d, b.x * sem.x AS x FROM b JOIN sem USING (d)) {_DONE}""")
def encode_semantic_field(spark, sf):
    """Items bound to a bundle of weighted term groups."""
    config = {"semantic_groups": {"short": ["the", "and"], "long": ["que", "der"]},
              "field_weights": {"short": 2.0, "long": 1.0}}
    return _list_query("semantic_field", **config)(spark, sf)


@query(f"""
WITH {TURNS}, {_BOOK}, bg AS (SELECT id, a, lead(a) OVER (PARTITION BY id ORDER BY i) AS a1 FROM it),
df AS (SELECT a, a1, count(DISTINCT id) AS df FROM bg WHERE a1 IS NOT NULL GROUP BY a, a1),
t AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM u),
bw AS (SELECT id, a, a1, count(*) * CAST(floor(least(ln(any_value(total) / any_value(df)), 2.0) * 1000000 + 0.5) AS BIGINT) AS k
       FROM bg JOIN df USING (a, a1), t GROUP BY id, a, a1),
bp AS (SELECT c.a, e.a AS a1, c.d, c.x * e.x AS x FROM df JOIN cb c ON c.a = df.a JOIN cb e ON e.a = df.a1 AND e.d = c.d),
al AS (SELECT id, d, k * x AS y FROM bw JOIN bp USING (a, a1)
       UNION ALL SELECT id, d, 800000 * x FROM it JOIN cb USING (a)),
s AS (SELECT id, d, CAST(sign(sum(y)) AS INT) AS x FROM al GROUP BY id, d) {_DONE}""")
def encode_ngram_idf(spark, sf):
    """Bigrams weighted by their own document frequency."""
    return E.encode_idf_ngrams(turns(spark, sf), "turn_id", "words", TD, n=2, cap=2.0).select(
        "turn_id", hex_text("vec").alias("vec"))


_NESTED = f"""
src AS (SELECT event_id AS id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
{codebook_sql('''SELECT unnest(['user', 'meta', 'kind', 'props', 'k', 'tags']) AS a UNION SELECT event_type FROM events
  UNION SELECT CAST(user_id AS VARCHAR) FROM events UNION SELECT json_extract_string(props, '$.k') FROM events''', TD)},
p1 AS (SELECT id, d, c.x * e.x AS x FROM src JOIN cb e ON e.a = src.k JOIN cb c USING (d) WHERE c.a = 'k'),
m2 AS (SELECT id, e.d, sign(c1.x * e.x + c2.x * p1.x) AS x FROM src JOIN cb e ON e.a = src.event_type
       JOIN p1 USING (id, d) JOIN cb c1 ON c1.a = 'kind' AND c1.d = e.d JOIN cb c2 ON c2.a = 'props' AND c2.d = e.d),
s AS (SELECT id, u.d, sign(c1.x * u.x + c2.x * m2.x + c3.x * sign(t1.x + t2.x)) AS x
      FROM src JOIN cb u ON u.a = CAST(src.user_id AS VARCHAR) JOIN m2 USING (id, d)
      JOIN cb t1 ON t1.a = src.event_type AND t1.d = u.d JOIN cb t2 ON t2.a = src.k AND t2.d = u.d
      JOIN cb c1 ON c1.a = 'user' AND c1.d = u.d JOIN cb c2 ON c2.a = 'meta' AND c2.d = u.d
      JOIN cb c3 ON c3.a = 'tags' AND c3.d = u.d)"""


def _nested_columns():
    k = F.from_json("props", "k INT")["k"]
    meta = F.struct(F.col("event_type").alias("kind"), F.struct(k.alias("k")).alias("props"))
    return k, meta


@query(f"WITH {_NESTED} SELECT id AS event_id, {HEX} AS vec FROM s GROUP BY id")
def encode_nested_columns(spark, sf):
    """A struct three levels deep with a bundled array."""
    k, meta = _nested_columns()
    row = F.struct(F.col("user_id").alias("user"), meta.alias("meta"),
                   F.array("event_type", k.cast("string")).alias("tags"))
    return spread_table(spark, sf, "events").select(
        "event_id", hex_text(E.encode(row, TD, modes={"tags": "bundle"})).alias("vec"))


@query(f"""WITH {_NESTED.replace("c3.x * sign(t1.x + t2.x)", "c3.x * sign(t0.x * sign(t1.x + t2.x))")
                 .replace("JOIN cb c3 ON", "JOIN cb t0 ON t0.a = 'k' AND t0.d = u.d JOIN cb c3 ON")}
SELECT id AS event_id, {HEX} AS vec FROM s GROUP BY id""")
def encode_json_hints(spark, sf):
    """JSON text of unknown shape whose list mode comes from a hint inside the document."""
    k, meta = _nested_columns()
    doc = F.to_json(F.struct(
        F.col("user_id").alias("user"), meta.alias("meta"),
        F.struct(F.lit("bundle").alias("_encode_mode"), F.array("event_type", k.cast("string")).alias("k")).alias("tags")))
    return spread_table(spark, sf, "events").select("event_id", hex_text(E.encode_json(doc, TD)).alias("vec"))


# ---- algebra ---------------------------------------------------------------------------------

_BT = codebook_sql("SELECT p_brand AS a FROM part UNION SELECT p_type FROM part", D)


def _pair(expr, name):
    return (f"WITH {_BT}, s AS (SELECT p_brand, p_type, b.d, {expr} AS x FROM (SELECT DISTINCT p_brand, p_type FROM part) p "
            f"JOIN cb b ON b.a = p_brand JOIN cb t ON t.a = p_type AND t.d = b.d) "
            f"SELECT p_brand, p_type, {name} AS vec FROM s GROUP BY p_brand, p_type")


_HEX2 = ("string_agg(CASE x WHEN 2 THEN '02' WHEN 1 THEN '01' WHEN -1 THEN 'ff' WHEN -2 THEN 'fe' ELSE '00' END, '' "
         "ORDER BY d)")


def _brand_type(spark, sf):
    return (table(spark, sf, "part").select("p_brand", "p_type").distinct()
            .withColumn("b", E.encode_atom("p_brand", D)).withColumn("t", E.encode_atom("p_type", D)))


@query(_pair("b.x * t.x", HEX))
def bind_pairs(spark, sf):
    """Product of a brand and a type vector."""
    return _brand_type(spark, sf).select("p_brand", "p_type", hex_text(A.bind("b", "t", D)).alias("vec"))


@query(_pair("b.x - t.x", _HEX2))
def subtract_pairs(spark, sf):
    """Un-thresholded difference."""
    return _brand_type(spark, sf).select("p_brand", "p_type", hex_text(A.subtract("b", "t", D)).alias("vec"))


@query(_pair("sign(2 * b.x + t.x)", HEX))
def add_scale_threshold(spark, sf):
    """sign(2 * brand + type)."""
    doubled = A.add(A.scale("b", 2, D), "t", D)
    return _brand_type(spark, sf).select("p_brand", "p_type", hex_text(A.threshold(doubled, D)).alias("vec"))


@query(_pair("sign(floor(0.7 * 1000000 + 0.5) * b.x + floor(0.3 * 1000000 + 0.5) * t.x)", HEX))
def bundle_weighted_columns(spark, sf):
    """Weighted bundle of two columns."""
    return _brand_type(spark, sf).select(
        "p_brand", "p_type", hex_text(A.bundle_columns(["b", "t"], D, [0.7, 0.3])).alias("vec"))


@query(_pair("b.x", HEX).replace("b.d, b.x AS x", f"(b.d + 5) % {D} AS d, b.x AS x"))
def permute_vectors(spark, sf):
    """Rotation by five places."""
    return _brand_type(spark, sf).select("p_brand", "p_type", hex_text(A.permute("b", 5, D)).alias("vec"))


@query(f"WITH {_BT}, n AS (SELECT a, sqrt(sum(x * x)) AS n FROM cb GROUP BY a) "
       "SELECT a AS atom, round(max(x / n), 6) AS top, round(sum((x / n) * (x / n)), 6) AS length "
       "FROM cb JOIN n USING (a) GROUP BY a")
def normalize_vectors(spark, sf):
    """Unit-length vectors."""
    p = table(spark, sf, "part").select(F.explode(F.array("p_brand", "p_type")).alias("atom")).distinct()
    v = p.select("atom", A.normalize(E.encode_atom("atom", D), D).alias("u"))
    return v.select("atom", F.round(F.array_max("u"), 6).alias("top"),
                    F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query(f"""WITH {PART_MAP},
s AS (SELECT p_brand, d, CAST(sign(sum(x)) AS INT) AS x FROM dv JOIN part ON p_partkey = id GROUP BY p_brand, d)
SELECT p_brand, {HEX} AS vec FROM s GROUP BY p_brand""")
def bundle_by_key(spark, sf):
    """Bundle of all part vectors of a brand."""
    p = spread_table(spark, sf, "part").select("p_brand", E.encode_row(*PART, dims=D).alias("vec"))
    return A.bundle_by(p, "p_brand", "vec", D).select("p_brand", hex_text("vec").alias("vec"))


@query(f"""WITH {codebook_sql("SELECT p_type AS a FROM part", D)},
q AS (SELECT l_suppkey, p_type, CAST(sum(CAST(floor(l_quantity * 1000000 + 0.5) AS BIGINT)) AS BIGINT) AS w
      FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type),
s AS (SELECT l_suppkey, d, CAST(sign(sum(w * x)) AS INT) AS x FROM q JOIN cb ON a = p_type GROUP BY l_suppkey, d)
SELECT l_suppkey, {HEX} AS vec FROM s GROUP BY l_suppkey""")
def bundle_weighted_by_key(spark, sf):
    """Supplier profiles: part types weighted by quantity.

    Quantities are summed per (supplier, type) before any vector exists, so the shuffle
    carries numbers, and one vector is made per distinct pair.
    """
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    q = (li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", "p_type")
         .agg(F.sum(A.scaled_weight(F.col("l_quantity"))).alias("w")))
    return A.bundle_by(q.select("l_suppkey", "w", E.encode_atom("p_type", D).alias("vec")), "l_suppkey", "vec", D,
                       weight="w").select("l_suppkey", hex_text("vec").alias("vec"))


_PRODUCT = "CASE WHEN min(abs(x)) = 0 THEN 0 WHEN sum(CAST(x < 0 AS INT)) % 2 = 1 THEN -1 ELSE 1 END"


@query(f"""WITH {codebook_sql("SELECT p_type AS a FROM part", D)},
s AS (SELECT p_brand, d, {_PRODUCT} AS x FROM (SELECT DISTINCT p_brand, p_type FROM part) p JOIN cb ON a = p_type
      GROUP BY p_brand, d)
SELECT p_brand, {HEX} AS vec FROM s GROUP BY p_brand""")
def bind_by_key(spark, sf):
    """Product of the distinct type vectors of a brand."""
    p = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    v = p.select("p_brand", E.encode_atom("p_type", D).alias("vec"))
    return A.bind_by(v, "p_brand", "vec", D).select("p_brand", hex_text("vec").alias("vec"))


@query(f"""WITH {codebook_sql("SELECT p_brand AS a FROM part UNION SELECT p_type FROM part", D)},
m AS (SELECT DISTINCT p_type AS g, p_brand AS a FROM part),
s1 AS (SELECT g, d, CAST(sign(sum(x)) AS INT) AS x FROM m JOIN cb USING (a) GROUP BY g, d),
s2 AS (SELECT g, d, {_PRODUCT} AS x FROM m JOIN cb USING (a) GROUP BY g, d)
SELECT 'bundle' AS op, g, {HEX} AS vec FROM s1 GROUP BY g UNION ALL SELECT 'bind', g, {HEX} FROM s2 GROUP BY g""")
def compose_groups(spark, sf):
    """Both compositions per group."""
    m = table(spark, sf, "part").select(F.col("p_type").alias("g"), "p_brand").distinct()
    v = m.select("g", E.encode_atom("p_brand", D).alias("vec"))
    outs = [A.compose(v, op, "g", "vec", D).select(F.lit(op).alias("op"), "g", hex_text("vec").alias("vec"))
            for op in ("bundle", "bind")]
    return outs[0].unionByName(outs[1])


_CLEAN = f"""WITH {pairs_sql("part", "p_partkey", PART)},
{codebook_sql("SELECT k AS a FROM kv UNION SELECT v FROM kv", D)}, {map_sql("dv")},
un AS (SELECT id, dv.d, dv.x * cb.x AS x FROM dv JOIN cb ON cb.d = dv.d AND cb.a = 'p_brand'),
sc AS (SELECT id, a, CAST(sum(un.x * cb.x) AS BIGINT) AS s FROM un JOIN cb USING (d)
       WHERE a IN (SELECT DISTINCT p_brand FROM part) GROUP BY id, a),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, a) AS rn FROM sc)
SELECT id AS p_partkey, a AS name, round(s / {D}.0, 6) AS score FROM r WHERE rn = 1"""


@query(_CLEAN)
def unbind_cleanup(spark, sf):
    """Unbind the brand role from each part and name the nearest brand."""
    from ternweave.operators.search import cleanup
    p = table(spark, sf, "part")
    role = E.encode_atom(F.lit("p_brand"), D)
    noisy = (p.select("p_partkey", E.encode_row(*PART, dims=D).alias("v"), role.alias("r"))
             .select("p_partkey", A.unbind("v", "r", D).alias("vec")))
    book = p.select(F.col("p_brand").alias("name")).distinct().withColumn("vec", E.encode_atom("name", D))
    return cleanup(noisy, book, D, "p_partkey").select("p_partkey", "name", F.round("score", 6).alias("score"))


@query(f"""WITH m AS (SELECT DISTINCT p_type AS g, p_brand AS a FROM part),
{codebook_sql("SELECT a FROM m UNION SELECT 'p_brand'", D)},
s0 AS (SELECT g, d, CAST(sign(sum(x)) AS INT) AS x FROM m JOIN cb USING (a) GROUP BY g, d),
s AS (SELECT g, d, s0.x * cb.x AS x FROM s0 JOIN cb USING (d) WHERE cb.a = 'p_brand')
SELECT g AS p_type, {HEX} AS vec FROM s GROUP BY g""")
def superposition(spark, sf):
    """An unknown brand as role times the bundle of its candidates, per part type."""
    m = table(spark, sf, "part").select("p_type", "p_brand").distinct()
    b = A.bundle_by(m.select("p_type", E.encode_atom("p_brand", D).alias("vec")), "p_type", "vec", D)
    return b.select("p_type", hex_text(A.bind("vec", E.encode_atom(F.lit("p_brand"), D), D)).alias("vec"))
