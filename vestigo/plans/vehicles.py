"""Vehicle reference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigo.operators import vehicles as V
from vestigo.plans.derived import add, load, read, with_tables
from vestigo.plans.registry import matching_sql, query, r

add(
    "vehicle_rows",
    "part",
    [
        "p_partkey AS row_id",
        "p_brand AS make",
        "p_name AS model",
        "1990+p_size AS year",
        "p_type AS variant",
        "CASE WHEN p_size%3=0 THEN 'flex' WHEN p_size%3=1 THEN 'gasolina' ELSE '' END AS fuel",
        "p_partkey%7 AS model_identifier",
        "CASE WHEN p_size%4=0 THEN 'red' WHEN p_size%4=1 THEN 'dark red' WHEN p_size%4=2 THEN 'blue' ELSE '' END AS colour",
        "CASE WHEN p_partkey%10<7 THEN 'train' WHEN p_partkey%10<9 THEN 'test' ELSE '' END AS split",
    ],
)
add(
    "vehicle_queries",
    "supplier",
    [
        "s_suppkey AS query_id",
        "CASE WHEN s_suppkey%8=0 THEN '' ELSE 'BRAND#' || CAST(s_nationkey AS STRING) END AS make",
        "CASE WHEN s_suppkey%4=0 THEN 'Ring' WHEN s_suppkey%4=1 THEN 'small  ring' WHEN s_suppkey%4=2 THEN "
        "'the red widget mk2' ELSE 'wid' END AS model",
        "CASE WHEN s_suppkey%3=0 THEN 'red' ELSE '' END AS colour",
        "CASE WHEN s_suppkey%5=0 THEN NULL ELSE 1990+s_suppkey%50 END AS year",
    ],
)

# Lower case and single blanks; the derived names carry no accents.
NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
REFERENCE_SQL = """, reference AS (SELECT upper(trim(make)) AS make, upper(trim(model)) AS model_key, arg_min(trim(model), row_id) AS model,
  list_sort(list(DISTINCT year)) AS years, list_sort(list(DISTINCT nullif(trim(variant), ''))) AS variants,
  list_sort(coalesce(list(DISTINCT nullif(trim(fuel), '')) FILTER (trim(fuel) <> ''), [])) AS fuels,
  list_sort(list(DISTINCT model_identifier)) AS ids, min(row_id) AS position FROM vehicle_rows GROUP BY 1, 2)"""


def reference(spark, sf):
    return V.build_reference(load(spark, sf, "vehicle_rows"))


@query(
    "build_reference",
    with_tables("vehicle_rows")
    + REFERENCE_SQL
    + """ SELECT make, model, array_to_string(years, ',') AS years, array_to_string(variants, ',') AS variants,
    array_to_string(fuels, ',') AS fuels, array_to_string(ids, ',') AS ids FROM reference""",
)
def build_reference(spark, sf):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return reference(spark, sf).select(
        "make", "model", *[text(c).alias(c) for c in ("years", "variants", "fuels")], text("model_identifiers").alias("ids")
    )


@query(
    "reference_totals",
    with_tables("vehicle_rows") + REFERENCE_SQL + " SELECT count(DISTINCT make) AS total_makes, count(*) AS total_models FROM reference",
)
def reference_totals(spark, sf):
    return V.reference_totals(reference(spark, sf))


@query(
    "match_model",
    with_tables("vehicle_rows", "vehicle_queries")
    + REFERENCE_SQL
    + f""", q AS (SELECT DISTINCT make, model, {NORM.format('make')} AS mk, {NORM.format('model')} AS mo FROM vehicle_queries),
    f AS (SELECT {NORM.format('make')} AS mk, {NORM.format('model')} AS nm, model AS model_name, array_to_string(years, ',') AS years, position FROM reference),
    c AS (SELECT q.make, q.model, f.model_name, f.years, row_number() OVER (PARTITION BY q.make, q.model ORDER BY q.mo <> f.nm, position) AS n,
      q.mo = f.nm AS exact FROM q JOIN f ON f.mk = q.mk AND (contains(f.nm, q.mo) OR contains(q.mo, f.nm)) WHERE q.mk <> '' AND q.mo <> '')
    SELECT q.make, q.model, CASE WHEN q.mk = '' OR q.mo = '' THEN 'none' WHEN c.n IS NOT NULL THEN CASE WHEN c.exact THEN 'exact' ELSE 'partial' END
      WHEN q.mk NOT IN (SELECT mk FROM f) THEN 'make_not_found' ELSE 'model_not_found' END AS match_type, c.n IS NOT NULL AS matched,
      coalesce(c.model_name, '') AS model_name, coalesce(c.years, '') AS years FROM q LEFT JOIN c ON c.make = q.make AND c.model = q.model AND c.n = 1""",
)
def match_model(spark, sf):
    found = V.match_model(load(spark, sf, "vehicle_queries"), reference(spark, sf))
    return found.withColumn("years", F.coalesce(F.array_join(F.col("years").cast("array<string>"), ","), F.lit("")))


_BOTH = "(contains({0}, {1}) OR contains({1}, {0}))"
_SEARCH_SQL = (
    with_tables("vehicle_rows", "vehicle_queries")
    + REFERENCE_SQL
    + f""", q AS (SELECT query_id, year AS qy, {NORM.format('make')} AS qm, {NORM.format('model')} AS qo, {NORM.format('colour')} AS qc FROM vehicle_queries),
    i AS (SELECT make, model, year, colour, {NORM.format('make')} AS mk, {NORM.format('model')} AS mo, {NORM.format('colour')} AS co, row_id,
      row_number() OVER (PARTITION BY {NORM.format('make')}, {NORM.format('model')}, year, {NORM.format('colour')} ORDER BY row_id) AS n FROM vehicle_rows),
    s1 AS (SELECT query_id, make, model, year, colour, {r('''1.0 + (CASE WHEN qc <> '' AND co = qc THEN 0.5 WHEN qc <> '' AND contains(co, qc) THEN 0.2 ELSE 0 END)
      + (CASE WHEN abs(year-qy) = 0 THEN 0.4 WHEN abs(year-qy) <= 2 THEN 0.2 ELSE 0 END) + (CASE WHEN qo <> '' AND mo = qo THEN 0.3 ELSE 0 END)''', 6)} AS score,
      'index' AS source, row_id FROM q JOIN i ON {_BOTH.format('mk', 'qm')} AND {_BOTH.format('mo', 'qo')} WHERE n = 1),
    f AS (SELECT {NORM.format('make')} AS mk, {NORM.format('model')} AS mo, model, years, position FROM reference),
    s2a AS (SELECT query_id, mk AS make, model, years, qy, {r('''0.8 + (CASE WHEN qm <> '' AND mk = qm THEN 0.2 ELSE 0 END) + (CASE WHEN qo <> '' AND mo = qo THEN 0.3 ELSE 0 END)
      + (CASE WHEN qy IS NOT NULL AND list_contains(years, qy) THEN 0.3 WHEN qy IS NOT NULL AND len(list_filter(years, lambda y: abs(y-qy) <= 2)) > 0 THEN 0.1 ELSE 0 END)''', 6)} AS score,
      position FROM q JOIN f ON {_BOTH.format('mk', 'qm')} AND {_BOTH.format('mo', 'qo')}),
    s2 AS (SELECT query_id, make, model, unnest(CASE WHEN qy IS NOT NULL THEN [qy] ELSE years[1:3] END) AS year, '' AS colour, score, 'reference' AS source,
      position AS row_id FROM s2a)"""
)
_SEARCH_COLUMNS = ["query_id", "make", "model", "year", "colour", "score", "source"]


@query("search_metadata", _SEARCH_SQL + f" SELECT {', '.join(_SEARCH_COLUMNS)} FROM s1")
def search_metadata(spark, sf):
    return V.search_metadata(load(spark, sf, "vehicle_queries"), load(spark, sf, "vehicle_rows")).select(*_SEARCH_COLUMNS)


@query("search_reference", _SEARCH_SQL + f" SELECT {', '.join(_SEARCH_COLUMNS)} FROM s2")
def search_reference(spark, sf):
    found = V.search_reference(load(spark, sf, "vehicle_queries"), reference(spark, sf))
    return found.select(*_SEARCH_COLUMNS)


@query(
    "vehicle_search",
    _SEARCH_SQL
    + f""", few AS (SELECT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM s1 GROUP BY query_id HAVING count(*) >= 20)),
    a AS (SELECT *, 0 AS turn FROM s1 UNION ALL SELECT *, 1 FROM s2 WHERE query_id IN (SELECT query_id FROM few)),
    d AS (SELECT *, row_number() OVER (PARTITION BY query_id, {NORM.format('make')}, {NORM.format('model')}, year, {NORM.format('colour')}
      ORDER BY turn, score DESC, row_id) AS n FROM a),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, turn, row_id, year) AS rank FROM d WHERE n = 1)
    SELECT {', '.join(_SEARCH_COLUMNS)}, rank FROM k WHERE rank <= 20""",
)
def vehicle_search(spark, sf):
    return V.vehicle_search(load(spark, sf, "vehicle_queries"), load(spark, sf, "vehicle_rows"), reference(spark, sf))


_NEEDLE_SQL = """, needles AS (SELECT DISTINCT CASE WHEN s_suppkey%6=0 THEN 'rad widgot' WHEN s_suppkey%6=1 THEN 'Ring ' || s_nationkey WHEN s_suppkey%6=2
  THEN 'smal-ring' WHEN s_suppkey%6=3 THEN 'blue gear box' WHEN s_suppkey%6=4 THEN 'XQ' ELSE 'LARGE bolt' END AS needle FROM supplier)"""


def _needles(spark, sf):
    k = F.col("s_suppkey") % 6
    return read(spark, sf, "supplier").select(
        F.when(k == 0, "rad widgot")
        .when(k == 1, F.concat(F.lit("Ring "), F.col("s_nationkey").cast("string")))
        .when(k == 2, "smal-ring")
        .when(k == 3, "blue gear box")
        .when(k == 4, "XQ")
        .otherwise("LARGE bolt")
        .alias("needle")
    )


@query(
    "fuzzy_name_join",
    with_tables("vehicle_rows")
    + _NEEDLE_SQL
    + f""", a AS (SELECT needle, trim(regexp_replace(upper(needle), '[^A-Z0-9]+', ' ', 'g')) AS a FROM needles),
    b AS (SELECT trim(regexp_replace(upper(model), '[^A-Z0-9]+', ' ', 'g')) AS b, arg_min(model, row_id) AS name, min(row_id) AS position FROM vehicle_rows GROUP BY 1),
    w AS (SELECT *, list_intersect(string_split(a, ' '), string_split(b, ' ')) AS common, len(string_split(a, ' ')) AS nw FROM a, b),
    s AS (SELECT needle, name, position, CASE WHEN a = b THEN 200.0::DOUBLE ELSE (CASE WHEN contains(b, a) THEN 80 ELSE 0 END) +
      (CASE WHEN contains(a, b) THEN 40 ELSE 0 END) + len(common)*28.0::DOUBLE + len(common)/nw*30.0::DOUBLE +
      (1.0::DOUBLE - levenshtein(a, b)/greatest(length(a), length(b)))*100.0::DOUBLE*0.45::DOUBLE END AS score FROM w),
    k AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score DESC, position) AS n FROM s WHERE score >= 36)
    SELECT needle, name, position, {r('score', 6)} AS score FROM k WHERE n = 1""",
)
def fuzzy_name_join(spark, sf):
    names = load(spark, sf, "vehicle_rows").select(F.col("model").alias("name"), F.col("row_id").alias("position"))
    return V.fuzzy_name_join(_needles(spark, sf), names)


@query(
    "fuzzy_name_join_blocks",
    with_tables("vehicle_rows", recursive=True)
    + _NEEDLE_SQL
    + f""", a AS (SELECT needle, trim(regexp_replace(upper(needle), '[^A-Z0-9]+', ' ', 'g')) AS a FROM needles),
    b AS (SELECT trim(regexp_replace(upper(model), '[^A-Z0-9]+', ' ', 'g')) AS b, arg_min(model, row_id) AS name, min(row_id) AS position FROM vehicle_rows GROUP BY 1),
    {matching_sql("SELECT DISTINCT a, b FROM a, b")},
    w AS (SELECT *, list_intersect(string_split(a, ' '), string_split(b, ' ')) AS common, len(string_split(a, ' ')) AS nw FROM a, b),
    s AS (SELECT needle, name, position, CASE WHEN a = b THEN 200.0::DOUBLE ELSE (CASE WHEN contains(b, a) THEN 80 ELSE 0 END) +
      (CASE WHEN contains(a, b) THEN 40 ELSE 0 END) + len(common)*28.0::DOUBLE + len(common)/nw*30.0::DOUBLE +
      2.0::DOUBLE*matched/(length(a)+length(b))*100.0::DOUBLE*0.45::DOUBLE END AS score FROM w JOIN matching USING (a, b)),
    k AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score DESC, position) AS n FROM s WHERE score >= 36)
    SELECT needle, name, position, {r('score', 6)} AS score FROM k WHERE n = 1""",
)
def fuzzy_name_join_blocks(spark, sf):
    names = load(spark, sf, "vehicle_rows").select(F.col("model").alias("name"), F.col("row_id").alias("position"))
    return V.fuzzy_name_join(_needles(spark, sf), names, similarity="blocks")


@query(
    "pick_year",
    with_tables("vehicle_rows", "vehicle_queries")
    + """, y AS (SELECT model, position, code, CASE WHEN position%3=0 THEN 0 ELSE CAST(regexp_extract(code, '(19|20)\\d{2}') AS INT) END AS y FROM (
      SELECT model, row_id AS position, CASE WHEN row_id%3=0 THEN 'zero-' || row_id ELSE year || '-' || row_id END AS code FROM vehicle_rows)),
    t AS (SELECT query_id AS target_id, CASE query_id%4 WHEN 0 THEN 'red gear' WHEN 1 THEN 'small ring' WHEN 2 THEN 'red widget' ELSE 'large bolt' END AS model,
      coalesce(year, 0) AS asked FROM vehicle_queries),
    k AS (SELECT target_id, code, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN asked > 0 AND y = asked THEN 0 WHEN y BETWEEN 1900 AND 2100 THEN 1 ELSE 2 END, position) AS n
      FROM t JOIN y ON y.model = t.model)
    SELECT target_id, code AS year_code FROM k WHERE n = 1""",
)
def pick_year(spark, sf):
    rows = load(spark, sf, "vehicle_rows")
    code = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("zero-"), F.col("row_id").cast("string"))).otherwise(
        F.concat_ws("-", F.col("year").cast("string"), F.col("row_id").cast("string"))
    )
    years = rows.select("model", F.col("row_id").alias("position"), code.alias("code"), F.lit("").alias("name"))
    k = F.col("query_id") % 4
    targets = load(spark, sf, "vehicle_queries").select(
        F.col("query_id").alias("target_id"),
        F.when(k == 0, "red gear").when(k == 1, "small ring").when(k == 2, "red widget").otherwise("large bolt").alias("model"),
        F.concat(F.lit("ano "), F.coalesce(F.col("year").cast("string"), F.lit("?")), F.lit("/1970")).alias("asked"),
    )
    return V.pick_year(targets, years)


# -- vectors -----------------------------------------------------------------------------------

_DOT = "list_sum([a*b for a, b in zip({0}, {1})])"
_UNIT_SQL = """unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM (SELECT vec_id, embedding,
  sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8 AS n FROM embeddings))"""


@query(
    "semantic_rerank",
    f"""WITH {_UNIT_SQL}, c AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey AS key FROM lineitem),
    s AS (SELECT case_id, key, coalesce(list_dot_product(q.v, u.v), 0.0) AS sim FROM c LEFT JOIN unit u ON u.vec_id = c.key
      LEFT JOIN unit q ON q.vec_id = c.case_id),
    k AS (SELECT case_id, key, {r('sim', 6)} AS semantic_score, {r('0.8::DOUBLE + sim*0.5', 6)} AS score FROM s),
    n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, key) AS rank FROM k)
    SELECT * FROM n WHERE rank <= 5""",
)
def semantic_rerank(spark, sf):
    vectors = read(spark, sf, "embeddings")
    candidates = (
        read(spark, sf, "lineitem")
        .select(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("key"))
        .distinct()
        .withColumn("score", F.lit(V.REFERENCE_BASE))
    )
    return V.semantic_rerank(
        candidates,
        vectors.select(F.col("vec_id").alias("case_id"), "embedding"),
        vectors.select(F.col("vec_id").alias("key"), "embedding"),
    )


@query(
    "knn_search",
    f"""WITH {_UNIT_SQL}, p AS (SELECT q.vec_id AS query_id, u.vec_id, list_dot_product(q.v, u.v) AS s FROM unit q, unit u),
    k AS (SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
    SELECT query_id, vec_id, rank, {r('s', 6)} AS similarity FROM k WHERE rank <= 5""",
)
def knn_search(spark, sf):
    vectors = read(spark, sf, "embeddings")
    found = V.knn_search(vectors.select(F.col("vec_id").alias("query_id"), "embedding"), vectors)
    return found.withColumn("similarity", V.rnd(F.col("similarity"), 6))


@query("knn_search_lists", "SELECT count(*) * 5 AS neighbours, true AS recall_holds FROM embeddings")
def knn_search_lists(spark, sf):
    """The approximate search over all vectors, held against the exact one: it finds at least nine in ten neighbours."""
    vectors = read(spark, sf, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    recall = V.knn_recall(V.knn_search_lists(queries, vectors), V.knn_search(queries, vectors))
    return recall.select("neighbours", (F.col("recall") >= 0.9).alias("recall_holds"))


# -- ranking and reports -----------------------------------------------------------------------


def _readings(spark, sf):
    parts = read(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    lines = read(spark, sf, "lineitem")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("case_id"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"))
        .agg(F.max(F.col("l_discount") * 10).alias("clip_score"))
    )


def _vehicle_cases(spark, sf):
    k = F.col("o_custkey")
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        (k % 2 == 0).alias("has_class"),
        (k % 3 == 0).alias("has_lights"),
        (k % 5 == 0).alias("has_partial"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Brand#"), (k % 30).cast("string"))).alias("seed_make"),
        F.when(k % 4 == 1, "").otherwise("ring").alias("seed_model"),
    )


@query(
    "rank_vehicle_candidates",
    with_tables("vehicle_rows")
    + REFERENCE_SQL
    + f""", rd AS (SELECT l_orderkey AS case_id, p_brand AS make, p_name AS model, max(l_discount*10) AS clip FROM lineitem JOIN part ON p_partkey = l_partkey
      GROUP BY ALL),
    cs AS (SELECT o_orderkey AS case_id, o_custkey AS k, CASE WHEN o_custkey%4=0 THEN '' ELSE 'Brand#' || o_custkey%30 END AS sm,
      CASE WHEN o_custkey%4=1 THEN '' ELSE 'ring' END AS so FROM orders),
    fb AS (SELECT case_id, sm AS make, CASE WHEN so = '' THEN sm ELSE so END AS model FROM cs WHERE case_id NOT IN (SELECT case_id FROM rd) AND (sm <> '' OR so <> '')),
    pr AS (SELECT DISTINCT make, model FROM rd UNION SELECT DISTINCT make, model FROM fb),
    f AS (SELECT {NORM.format('make')} AS mk, {NORM.format('model')} AS mo FROM reference),
    mt AS (SELECT make, model, CASE WHEN make = '' OR model = '' THEN 'none'
      WHEN EXISTS (SELECT 1 FROM f WHERE f.mk = {NORM.format('make')} AND f.mo = {NORM.format('model')}) THEN 'exact'
      WHEN EXISTS (SELECT 1 FROM f WHERE f.mk = {NORM.format('make')} AND {_BOTH.format('f.mo', NORM.format('model'))}) THEN 'partial'
      WHEN EXISTS (SELECT 1 FROM f WHERE f.mk = {NORM.format('make')}) THEN 'model_not_found' ELSE 'make_not_found' END AS match_type FROM pr),
    bs AS (SELECT p.make, p.model, max(1.0 + CASE WHEN {NORM.format('v.model')} = {NORM.format('p.model')} THEN 0.3 ELSE 0.0 END)::DOUBLE AS bs
      FROM (SELECT DISTINCT make, model FROM rd) p JOIN (SELECT DISTINCT make, model FROM vehicle_rows) v ON {_BOTH.format(NORM.format('v.make'), NORM.format('p.make'))} AND
      {_BOTH.format(NORM.format('v.model'), NORM.format('p.model'))} GROUP BY ALL),
    kind AS (SELECT *, CASE match_type WHEN 'exact' THEN 0.12 WHEN 'partial' THEN 0.07 ELSE 0 END::DOUBLE AS kv FROM mt),
    sc AS (SELECT rd.case_id, rd.make, rd.model, match_type, clip*0.80::DOUBLE + (CASE WHEN k%2=0 THEN 0.08 ELSE 0 END)::DOUBLE + (CASE WHEN k%3=0 THEN 0.05 ELSE 0 END)::DOUBLE
      + (CASE WHEN k%5=0 THEN 0.03 ELSE 0 END)::DOUBLE + kv + coalesce(least(0.15::DOUBLE, bs*0.1::DOUBLE), 0.0) AS s
      FROM rd JOIN cs USING (case_id) LEFT JOIN kind ON kind.make = rd.make AND kind.model = rd.model LEFT JOIN bs ON bs.make = rd.make AND bs.model = rd.model
      UNION ALL SELECT fb.case_id, fb.make, fb.model, match_type, 0.35::DOUBLE + kv FROM fb JOIN kind ON kind.make = fb.make AND kind.model = fb.model),
    pb AS (SELECT case_id, make, model, match_type, {r('least(1.0, greatest(0.0, s))', 4)} AS probability FROM sc)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY probability DESC, make, model) AS rank FROM pb) WHERE rank <= 3""",
)
def rank_vehicle_candidates(spark, sf):
    readings, cases = _readings(spark, sf), _vehicle_cases(spark, sf)
    pairs = readings.select("make", "model").distinct()
    seed_model = F.when(F.col("seed_model") == "", F.col("seed_make")).otherwise(F.col("seed_model"))
    seeds = cases.select(F.col("seed_make").alias("make"), seed_model.alias("model")).distinct()
    matches = V.match_model(pairs.unionByName(seeds).distinct(), reference(spark, sf))
    # Every distinct (make, model) is one search without colour or year; only its best score is kept.
    queries = pairs.select(
        F.concat_ws("|", "make", "model").alias("query_id"), "make", "model", F.lit("").alias("colour"), F.lit(None).cast("int").alias("year")
    )
    models = load(spark, sf, "vehicle_rows").select("make", "model", F.lit("").alias("colour"), F.lit(0).alias("year"), "row_id")
    hits = V.search_metadata(queries, models).groupBy("query_id").agg(F.max("score").alias("best_score"))
    searches = hits.select(
        F.substring_index("query_id", "|", 1).alias("make"), F.substring_index("query_id", "|", -1).alias("model"), "best_score"
    )
    return V.rank_vehicle_candidates(readings, cases, matches, searches)


@query(
    "unique_models",
    """WITH a AS (SELECT p_brand AS make, p_name AS model, 'index' AS source, 0 AS turn, p_partkey AS pos FROM part
      UNION ALL SELECT upper(p_brand), upper(CASE WHEN p_size < 10 THEN p_name ELSE p_type END), 'reference', 1, p_partkey FROM part)
    SELECT make, model, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(make), lower(model) ORDER BY turn, pos) AS n FROM a) WHERE n = 1""",
)
def unique_models(spark, sf):
    rows = load(spark, sf, "vehicle_rows").withColumn("position", F.col("row_id"))
    # The reference names older vehicles as the index does, later ones by their variant.
    named = F.when(F.col("year") < 2000, F.col("model")).otherwise(F.col("variant"))
    upper = rows.withColumn("make", F.upper("make")).withColumn("model", F.upper(named))
    return V.unique_models(("index", rows), ("reference", upper))


@query(
    "profile_dataset",
    with_tables("vehicle_rows")
    + """ SELECT count(*) AS rows, count(DISTINCT model_identifier) AS models, count(DISTINCT make) AS makes, count(DISTINCT year) AS years,
    min(year) AS min_year, max(year) AS max_year FROM vehicle_rows""",
)
def profile_dataset(spark, sf):
    return V.profile_dataset(load(spark, sf, "vehicle_rows").withColumnRenamed("model_identifier", "model_id"))


@query(
    "profile_splits",
    with_tables("vehicle_rows") + " SELECT split, count(*) AS rows FROM vehicle_rows WHERE split <> '' GROUP BY split",
)
def profile_splits(spark, sf):
    return V.profile_splits(load(spark, sf, "vehicle_rows"))


@query(
    "source_status",
    with_tables("vehicle_rows")
    + REFERENCE_SQL
    + """, s AS (SELECT 'reference' AS source, 'makes' AS measure, count(DISTINCT make) AS total FROM reference UNION ALL
      SELECT 'reference', 'models', count(*) FROM reference UNION ALL SELECT 'index', 'records', count(*) FROM vehicle_rows UNION ALL
      SELECT 'index', 'keys', count(*) FROM (SELECT DISTINCT make, model, colour FROM vehicle_rows) UNION ALL
      SELECT 'vectors', 'vectors', count(*) FROM embeddings) SELECT *, total > 0 AS available FROM s""",
)
def source_status(spark, sf):
    return V.source_status(reference(spark, sf), load(spark, sf, "vehicle_rows"), read(spark, sf, "embeddings"))
