"""Plain SQL for the registered queries, written independently of the operators."""

RAW = """raw AS (
  SELECT CAST(p_partkey AS BIGINT) AS row_id,
         CASE WHEN p_partkey % 29 = 7 THEN NULL WHEN p_partkey % 31 = 5 THEN 'EMPTY'
              ELSE concat(upper(substr(p_type, 1, 3)), '-', lpad(CAST(p_partkey - (CASE WHEN p_partkey % 37 = 1 THEN 1 ELSE 0 END) AS VARCHAR(20)), 6, '0')) END AS catalog_no,
         CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE p_name END AS description,
         CASE WHEN p_partkey % 19 = 4 THEN NULL ELSE p_type END AS main_category,
         CASE WHEN p_partkey % 23 = 6 THEN NULL ELSE p_brand END AS sub_category,
         CASE WHEN p_partkey % 13 = 2 THEN NULL ELSE p_brand END AS mfr_code
  FROM part)"""

MAPPED = """coalesce(CASE mfr_code WHEN 'Brand#1' THEN 'Maker 1' WHEN 'Brand#2' THEN 'Maker 2' WHEN 'Brand#3' THEN 'Maker 3'
    WHEN 'Brand#4' THEN 'Maker 4' WHEN 'Brand#5' THEN 'Maker 5' ELSE mfr_code END, 'Unknown')"""

FILLED = """coalesce(description, 'Unknown') AS description, coalesce(main_category, 'Uncategorized') AS main_category,
         coalesce(sub_category, 'Uncategorized') AS sub_category"""

ITEMS = f"""{RAW}, items AS (
  SELECT row_id, catalog_no, {FILLED}, {MAPPED} AS mfr_code
  FROM raw WHERE catalog_no IS NOT NULL AND catalog_no <> 'EMPTY')"""

DOCS = """items AS (
  SELECT CAST(doc_id AS BIGINT) AS row_id, concat(source, '-', lpad(CAST(doc_id AS VARCHAR(20)), 6, '0')) AS catalog_no,
         text AS description, lang AS main_category, source AS sub_category
  FROM documents)"""

PREDICTED = f"""{ITEMS}, predicted AS (
  SELECT *, CASE WHEN row_id % 11 = 0 THEN 'Unknown' WHEN row_id % 5 = 1 THEN 'SMALL' ELSE main_category END AS pm,
         (row_id * 7 % 100) / 100.0::DOUBLE AS cm,
         CASE WHEN row_id % 13 = 0 THEN 'Unknown' ELSE sub_category END AS ps,
         (row_id * 3 % 100) / 100.0::DOUBLE AS cs
  FROM items), routed AS (
  SELECT *, cm < 0.8 OR pm = 'Unknown' OR cs < 0.8 OR ps = 'Unknown' AS sent FROM predicted)"""

VECTORS = """vectors AS (
  SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(embedding AS DOUBLE[]) AS f, CAST(label AS VARCHAR) AS main_category,
         CAST(vec_id % 7 AS VARCHAR) AS sub_category, CAST(CASE WHEN label = 9 THEN -1 ELSE label END AS INTEGER) AS cluster
  FROM embeddings)"""

TOKENS = r"regexp_extract_all(lower(description), '[\p{L}\p{N}_]{2,}')"

# Unit TF-IDF vectors per distinct text: unit(text_id, n_rows, term, w).
UNIT = f"""texts AS (
  SELECT description, min(row_id) AS text_id, count(*) AS n_rows FROM items GROUP BY description),
tf AS (
  SELECT text_id, n_rows, term, count(*) AS tf
  FROM (SELECT text_id, n_rows, unnest({TOKENS}) AS term FROM texts) GROUP BY ALL),
vocab AS (
  SELECT term, CAST(sum(n_rows) AS BIGINT) AS df, CAST(sum(tf * n_rows) AS BIGINT) AS occurrences FROM tf GROUP BY term),
weighted AS (
  SELECT text_id, n_rows, tf.term, tf * (ln((1.0 + (SELECT count(*) FROM items)) / (1.0 + df)) + 1.0) AS w
  FROM tf JOIN vocab USING (term)),
unit AS (
  SELECT text_id, n_rows, term, w / sqrt(sum(w * w) OVER (PARTITION BY text_id)) AS w FROM weighted)"""

TEXT_PAIRS = """text_pairs AS (
  SELECT a.text_id AS ti, b.text_id AS tj, round(sum(a.w * b.w), 9) AS d
  FROM unit a JOIN unit b ON a.term = b.term AND a.text_id < b.text_id GROUP BY ALL)"""

SKUS = """skus AS (
  SELECT catalog_no AS sku, min(row_id) AS id, max(row_id) AS last, count(*) AS n FROM items GROUP BY catalog_no)"""

PROFILES = """profiles AS (
  SELECT catalog_no AS sku, text_id, min(row_id) AS id, max(row_id) AS last, count(*) AS n
  FROM items JOIN texts USING (description) GROUP BY ALL)"""

SKU_LENGTH = 10  # every catalogue number of the parts view has ten characters


def sku_pairs(name: str, source: str, columns: str) -> str:
    """CTEs that end in `name`: all pairs of `source` with id_i < id_j and their ratio s.

    One bit per character of the first string, one step per character of the second.
    """
    n = SKU_LENGTH
    chars = ", ".join(f"unicode(substr(sku, {k}, 1)) AS c{k}" for k in range(1, n + 1))
    side = [", ".join(f"{t}.c{k} AS {t}{k}" for k in range(1, n + 1)) for t in "ab"]
    ctes = [
        f"{name}_c AS MATERIALIZED (SELECT *, {chars} FROM {source})",
        f"{name}_0 AS (SELECT {columns}, {side[0]}, {side[1]}, CAST({(1 << n) - 1} AS BIGINT) AS v "
        f"FROM {name}_c a JOIN {name}_c b ON a.id < b.id)",
    ]
    for step in range(1, n + 1):
        mask = " + ".join(f"(CASE WHEN a{k} = b{step} THEN {1 << (k - 1)} ELSE 0 END)" for k in range(1, n + 1))
        ctes.append(f"{name}_m{step} AS (SELECT *, v & ({mask}) AS u FROM {name}_{step - 1})")
        ctes.append(
            f"{name}_{step} AS (SELECT * EXCLUDE (u) REPLACE (((v + u) | (v - u)) & {(1 << n) - 1} AS v) FROM {name}_m{step})"
        )
    drop = ", ".join(f"{t}{k}" for t in "ab" for k in range(1, n + 1))
    ctes.append(
        f"{name} AS MATERIALIZED (SELECT * EXCLUDE ({drop}, v), 2.0 * ({n} - bit_count(v)) / {2 * n} AS s FROM {name}_{n})"
    )
    return ", ".join(ctes)


def _scored(threshold: float, strict: bool = False) -> str:
    """CTE scored: profile pairs (and several rows of one profile) that reach the threshold."""
    op = ">" if strict else ">="
    pairs = sku_pairs(
        "pp",
        "profiles",
        "a.id AS row_i, b.id AS row_j, a.sku AS sku_i, b.sku AS sku_j, a.text_id AS ta, b.text_id AS tb, "
        "a.n AS n_i, b.n AS n_j, a.last AS last_i, b.last AS last_j",
    )
    return f"""{UNIT}, {TEXT_PAIRS}, {PROFILES}, {pairs},
has_terms AS (SELECT DISTINCT text_id FROM unit),
described AS (
  SELECT pp.*, CASE WHEN ta = tb THEN (CASE WHEN h.text_id IS NULL THEN 0.0 ELSE 1.0 END) ELSE coalesce(d, 0.0) END AS d
  FROM pp LEFT JOIN text_pairs t ON t.ti = least(ta, tb) AND t.tj = greatest(ta, tb) LEFT JOIN has_terms h ON h.text_id = ta),
every AS (
  SELECT row_i, row_j, sku_i, sku_j, n_i, n_j, last_i, last_j, s, d, n_i * n_j AS row_pairs FROM described
  UNION ALL
  SELECT id, id, sku, sku, n, n, last, last, 1.0, CASE WHEN h.text_id IS NULL THEN 0.0 ELSE 1.0 END,
         CAST(n * (n - 1) // 2 AS BIGINT)
  FROM profiles p LEFT JOIN has_terms h ON h.text_id = p.text_id WHERE n > 1),
scored AS (
  SELECT *, round(0.4 * s + 0.6 * d, 9) AS combined FROM every WHERE round(0.4 * s + 0.6 * d, 9) {op} {threshold})"""


# Per distinct catalogue number, against all others: both directions of the pairs.
SKU_PROFILE = (
    SKUS
    + ", "
    + sku_pairs("sp", "skus", "a.id AS id_i, b.id AS id_j, a.sku AS sku_i, b.sku AS sku_j, a.n AS n_i, b.n AS n_j")
    + """, both_sides AS (
  SELECT id_i AS id, sku_i AS sku, id_j AS other, sku_j AS other_sku, n_j AS other_n, s FROM sp
  UNION ALL SELECT id_j, sku_j, id_i, sku_i, n_i, s FROM sp),
sku_profile AS (
  SELECT id, sku, max(s) AS top, arg_max(other_sku, struct_pack(s := s, o := -other)) AS best,
         avg(s) AS mean, avg(s) FILTER (s >= 0.8) AS high, sum(s * other_n) AS row_total
  FROM both_sides GROUP BY ALL)"""
)

# One item per catalogue number (its last row) against all others, by description.
DESC_PROFILE = """last_rows AS (
  SELECT s.id, s.sku, t.text_id FROM skus s JOIN items i ON i.row_id = s.last JOIN texts t ON t.description = i.description),
has_terms AS (SELECT DISTINCT text_id FROM unit),
text_sides AS (
  SELECT ti AS a, tj AS b, d FROM text_pairs UNION ALL SELECT tj, ti, d FROM text_pairs
  UNION ALL SELECT text_id, text_id, 1.0 FROM has_terms),
near AS (
  SELECT x.id, x.sku, y.id AS other, y.sku AS other_sku, d
  FROM last_rows x JOIN text_sides ON a = x.text_id JOIN last_rows y ON b = y.text_id WHERE x.id <> y.id),
first_two AS (SELECT id, sku, row_number() OVER (ORDER BY id) AS k FROM skus),
none AS (
  SELECT l.id, l.sku, f.id AS other, f.sku AS other_sku, 0.0 AS d
  FROM last_rows l JOIN first_two f ON f.k <= 2 AND f.id <> l.id),
desc_profile AS (
  SELECT id, sku, max(d) AS top, arg_max(other_sku, struct_pack(d := d, o := -other)) AS best,
         sum(d) / (SELECT count(*) - 1 FROM skus) AS mean
  FROM (SELECT * FROM near UNION ALL SELECT * FROM none) GROUP BY ALL)"""


def _components(edges: str) -> str:
    """CTE labels(node, component) from (level, src, dst): lowest reachable node."""
    return f"""links AS (SELECT level, src, dst FROM ({edges}) UNION SELECT level, dst, src FROM ({edges})),
reach AS (
  SELECT level, src AS node, src AS seen FROM links
  UNION SELECT r.level, r.node, l.dst FROM reach r JOIN links l ON l.src = r.seen AND l.level = r.level),
labels AS (SELECT level, node, min(seen) AS component FROM reach GROUP BY ALL)"""


def _sweep(thresholds: list[float]) -> str:
    levels = ", ".join(f"({k}, {t}::DOUBLE)" for k, t in enumerate(thresholds))
    edges = (
        "SELECT DISTINCT level, si.id AS src, sj.id AS dst FROM scored JOIN levels ON combined >= t "
        "JOIN skus si ON si.sku = sku_i JOIN skus sj ON sj.sku = sku_j WHERE sku_i <> sku_j"
    )
    return f"""levels(level, t) AS (VALUES {levels}),
{_components(edges)},
sizes AS (SELECT level, component, count(*) AS size FROM labels GROUP BY ALL),
per_level AS (
  SELECT levels.level, t, (SELECT count(*) FROM skus) - coalesce(sum(size), 0) + count(component) AS components,
         coalesce(max(size), 1) AS largest
  FROM levels LEFT JOIN sizes ON sizes.level = levels.level GROUP BY ALL),
pair_counts AS (SELECT level, coalesce(sum(row_pairs), 0) AS pairs FROM levels LEFT JOIN scored ON combined >= t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM items),
sku_mean AS (
  SELECT (2 * (SELECT sum(n_i * n_j * s) FROM sp) + (SELECT sum(n * n) FROM skus)) / (SELECT n * n FROM n) AS m),
desc_mean AS (
  SELECT sum(v * v) / (SELECT n * n FROM n) AS m FROM (SELECT sum(n_rows * w) AS v FROM unit GROUP BY term)),
sweep AS (
  SELECT t AS threshold, (SELECT n FROM n) AS total_items, CAST(pairs AS BIGINT) AS similar_pairs,
         round((SELECT m FROM sku_mean), 9) AS average_sku_similarity, round((SELECT m FROM desc_mean), 9) AS average_desc_similarity,
         1.0::DOUBLE AS max_sku_similarity, 1.0::DOUBLE AS max_desc_similarity,
         round(pairs / (SELECT n FROM n), 9) AS similar_items_ratio,
         CAST(components AS BIGINT) AS connected_components, CAST(largest AS BIGINT) AS largest_component_size
  FROM per_level JOIN pair_counts USING (level))"""


# What the offline completion answers to a prompt, and whether it fails.
def _tail(prompt: str) -> str:
    return f"regexp_extract_all(lower(regexp_extract({prompt}, '[^:]*$')), '[a-z0-9]{{2,}}')"


def _answer(prompt: str) -> str:
    return f"CASE WHEN len({_tail(prompt)}) = 0 THEN 'Unknown' ELSE array_to_string(list_slice({_tail(prompt)}, 1, 3), ' ') END"


ENRICH = (
    "concat('Create an enriched part description in plain English (10 words or less). CatalogNo: ', catalog_no, "
    "', Manufacturer: ', mfr_code, ', Abbreviated Description: ', description, '.')"
)
PART = "concat('CatalogNo: ', catalog_no, ', Manufacturer: ', mfr_code, ', Description: ', description)"
MAIN_LONG = f"concat('Determine the main category for this electrical part. ', {PART})"
MAIN_SHORT = "concat('Determine the main category for: ', description)"


def _sub_long(main: str) -> str:
    return f"concat('Determine the sub-category for this electrical part. ', {PART}, ', Main Category: ', {main})"


def _sub_short(main: str) -> str:
    return f"concat('Determine the sub-category for: ', description, ' (main category: ', {main}, ')')"


def _counts(column: str, source: str = "items", prefix: str = ITEMS) -> str:
    return f"WITH {prefix} SELECT {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}"


COSINES = f"""{VECTORS},
points AS (SELECT f, min(row_id) AS id, count(*) AS n FROM vectors GROUP BY f),
normed AS (SELECT id, n, list_transform(f, lambda x: x / (sqrt(list_dot_product(f, f)) + 1e-8)) AS u FROM points),
near AS (
  SELECT a.id AS i, b.id AS j, round(list_dot_product(a.u, b.u), 9) AS c, a.n AS n_i, b.n AS n_j
  FROM normed a JOIN normed b ON round(list_dot_product(a.u, b.u), 9) >= 0.4)"""

DBSCAN = f"""WITH RECURSIVE {COSINES},
cores AS (SELECT i AS id FROM near GROUP BY i HAVING sum(n_j) >= 3),
core_near AS (SELECT i, j FROM near WHERE i IN (FROM cores) AND j IN (FROM cores)),
reach AS (SELECT id AS node, id AS seen FROM cores UNION SELECT r.node, c.j FROM reach r JOIN core_near c ON c.i = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
numbered AS (SELECT node, dense_rank() OVER (ORDER BY component) - 1 AS cluster FROM comp),
border AS (
  SELECT i AS node, min(cluster) AS cluster FROM near JOIN numbered ON numbered.node = j
  WHERE i NOT IN (FROM cores) GROUP BY i),
labelled AS (FROM numbered UNION ALL FROM border)
SELECT v.row_id, CAST(coalesce(l.cluster, -1) AS INTEGER) AS cluster
FROM vectors v JOIN points p ON p.f = v.f LEFT JOIN labelled l ON l.node = p.id"""

CLUSTERED = f"""{VECTORS},
kept AS (SELECT row_id, f, cluster FROM vectors WHERE cluster <> -1),
dims AS (SELECT row_id, cluster, unnest(f) AS x, generate_subscripts(f, 1) AS d FROM kept),
means AS (SELECT cluster, d, avg(x) AS m, count(*) AS size FROM dims GROUP BY ALL),
centres AS (SELECT cluster, list(m ORDER BY d) AS c, any_value(size) AS size FROM means GROUP BY cluster)"""

SILHOUETTE = f"""{CLUSTERED},
gaps AS (
  SELECT a.row_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.f, b.f)) AS total, count(*) AS m
  FROM kept a JOIN kept b ON true GROUP BY ALL),
scores AS (
  SELECT row_id, max(CASE WHEN own = other THEN total / nullif(m - 1, 0) END) AS inside,
         max(CASE WHEN own = other THEN m END) AS own_size, min(CASE WHEN own <> other THEN total / m END) AS outside
  FROM gaps GROUP BY row_id),
sil AS (
  SELECT round(avg(CASE WHEN own_size <= 1 THEN 0.0 ELSE (outside - inside) / greatest(inside, outside) END), 6) AS silhouette FROM scores)"""

CALINSKI = """overall AS (SELECT d, avg(x) AS m FROM dims GROUP BY d),
within_sum AS (SELECT sum((x - m) * (x - m)) AS w FROM dims JOIN means USING (cluster, d)),
between_sum AS (SELECT sum(size * (means.m - overall.m) * (means.m - overall.m)) AS b FROM means JOIN overall USING (d)),
ch AS (
  SELECT round(b * ((SELECT count(*) FROM kept) - (SELECT count(*) FROM centres)) / (w * ((SELECT count(*) FROM centres) - 1)), 6) AS calinski_harabasz
  FROM within_sum JOIN between_sum ON true)"""

DAVIES = """spread AS (
  SELECT cluster, any_value(c) AS c, avg(list_distance(f, c)) AS s FROM kept JOIN centres USING (cluster) GROUP BY cluster),
db AS (
  SELECT round(avg(worst), 6) AS davies_bouldin FROM (
    SELECT a.cluster, max((a.s + b.s) / list_distance(a.c, b.c)) AS worst
    FROM spread a JOIN spread b ON a.cluster <> b.cluster GROUP BY a.cluster))"""

CLIQUES = """cliques AS (
  SELECT CAST(coalesce(sum(size * (size - 1)) / sum(size), 0.0) AS DOUBLE) AS avg_degree, count(*) AS num_components,
         coalesce(max(size), 0) AS largest_component
  FROM (SELECT cluster, count(*) AS size FROM vectors WHERE cluster <> -1 GROUP BY cluster HAVING count(*) >= 2))"""

CHANGED = """SELECT row_id, main_category AS original_main_category, sub_category AS original_sub_category,
  pm IS DISTINCT FROM main_category AS main_category_changed, ps IS DISTINCT FROM sub_category AS sub_category_changed FROM predicted"""

FALLBACK = f"""{PREDICTED}, first_pass AS (SELECT *, {_answer(MAIN_SHORT)} AS ma, len({_tail(MAIN_SHORT)}) = 0 AS mf FROM routed),
fallback AS (
  SELECT *, {_answer(_sub_short('ma'))} AS sa, mf OR len({_tail(_sub_short('ma'))}) = 0 AS failed FROM first_pass)"""



def _limited(n: int) -> str:
    """CTEs kept(term) and lim(text_id, n_rows, term, w): unit vectors over the n most frequent terms."""
    return f"""kept AS (SELECT term FROM vocab ORDER BY occurrences DESC, term LIMIT {n}),
lim AS (
  SELECT text_id, n_rows, term, w / sqrt(sum(w * w) OVER (PARTITION BY text_id)) AS w
  FROM weighted WHERE term IN (FROM kept))"""


# Parts whose descriptions are the answers to their enrichment prompts.
ENRICHED = f"""{RAW}, plain AS (
  SELECT row_id, catalog_no, {FILLED}, {MAPPED} AS mfr_code
  FROM raw WHERE catalog_no IS NOT NULL AND catalog_no <> 'EMPTY'),
items AS (SELECT * REPLACE ({_answer(ENRICH)} AS description) FROM plain)"""


def _analysis() -> str:
    network = (
        "SELECT DISTINCT least(sku_i, sku_j), greatest(sku_i, sku_j) FROM every "
        "WHERE sku_i <> sku_j AND round(0.4 * s + 0.6 * d, 9) > 0.5"
    )
    return f"""WITH RECURSIVE {ENRICHED}, {_scored(0.7)}, {SKU_PROFILE}, {_sweep([0.7, 0.8, 0.9])},
    counted(name, value) AS (
      SELECT 'processed_data', count(*) FROM items UNION ALL SELECT 'cluster_results/assignments', count(*) FROM items
      UNION ALL SELECT 'similarity/combined', count(*) FROM scored WHERE combined >= 0.8
      UNION ALL SELECT 'similarity/sku', count(*) FROM sp WHERE s >= 0.8
      UNION ALL SELECT 'similarity/desc', count(*) FROM text_pairs WHERE d >= 0.8
      UNION ALL SELECT 'charts/network_vertices', count(*) FROM skus
      UNION ALL SELECT 'charts/network_edges', count(*) FROM ({network})
      UNION ALL SELECT 'enriched', count(*) FILTER (description <> 'Unknown') FROM items
      UNION ALL SELECT printf('similar_pairs at %.1f', threshold), similar_pairs FROM sweep
      UNION ALL SELECT printf('connected_components at %.1f', threshold), connected_components FROM sweep
      UNION ALL SELECT printf('largest_component_size at %.1f', threshold), largest_component_size FROM sweep)
    SELECT name, value::BIGINT AS value FROM counted"""


TABLE = "row_id, catalog_no, description, main_category, sub_category, mfr_code"

ORACLE = {
    "clean_filter": f"WITH {RAW} SELECT {TABLE} FROM raw WHERE catalog_no IS NOT NULL AND catalog_no <> 'EMPTY'",
    "fill_defaults": f"WITH {RAW} SELECT row_id, catalog_no, {FILLED}, mfr_code FROM raw",
    "map_manufacturer": f"WITH {RAW} SELECT row_id, {MAPPED} AS mfr_code FROM raw",
    "extract_manufacturer": f"""WITH {RAW} SELECT row_id, catalog_no, CASE WHEN upper(catalog_no) LIKE 'ECO%' THEN 'ECONOMIC'
        WHEN upper(catalog_no) LIKE 'PRO%' THEN 'PROMOTED' WHEN upper(catalog_no) LIKE 'STA%' THEN 'REGULAR' ELSE 'Unknown' END AS manufacturer FROM raw""",
    "clean_items": f"WITH {ITEMS} SELECT {TABLE} FROM items",
    "item_columns": f"""WITH {ITEMS} SELECT row_id, catalog_no AS catalog_numbers, description AS descriptions,
        mfr_code AS manufacturer_codes, main_category AS main_categories, sub_category AS sub_categories FROM items""",
    "validation_report": f"""WITH {RAW} SELECT count(*) AS n_rows, count(description) AS n_descriptions,
        CASE WHEN count(*) = 0 THEN 'Empty DataFrame provided' WHEN count(description) = 0 THEN 'All descriptions are missing' ELSE 'ok' END AS verdict FROM raw""",
    "choose_text": f"WITH {RAW} SELECT row_id, coalesce(description, '') AS text FROM raw",
    "trainable_rows": f"""WITH {RAW} SELECT {TABLE} FROM raw WHERE main_category IS NOT NULL AND main_category <> 'Unknown'
        AND sub_category IS NOT NULL AND sub_category <> 'Unknown'""",
    "init_predictions": f"""WITH {ITEMS} SELECT {TABLE}, 'Unknown' AS predicted_main_category, 'Unknown' AS predicted_sub_category,
        0.0::DOUBLE AS main_category_confidence, 0.0::DOUBLE AS sub_category_confidence, '' AS categorization_reason FROM items""",
    "adopt_predictions": f"WITH {PREDICTED} SELECT row_id, pm AS main_category, ps AS sub_category FROM predicted",
    "enrichment_coverage": f"""WITH {RAW} SELECT count(*) AS n_rows, count(CASE WHEN row_id % 10 <> 3 THEN description END) AS n_enriched,
        NOT count(CASE WHEN row_id % 10 <> 3 THEN description END) > 0.8 * count(*) AS needs_enrichment FROM raw""",
    "head_subset": f"WITH {RAW} SELECT {TABLE} FROM raw ORDER BY row_id LIMIT 1000",
    "failures": f"""WITH {PREDICTED} SELECT {TABLE}, pm AS predicted_main_category, cm AS main_category_confidence, ps AS predicted_sub_category,
        cs AS sub_category_confidence, 'ML prediction' AS categorization_reason FROM predicted WHERE pm = 'Unknown'""",
    "dataset_statistics": f"""WITH {RAW} SELECT count(*) AS total_items, count(DISTINCT CASE WHEN upper(catalog_no) LIKE 'ECO%' THEN 'ECONOMIC'
        WHEN upper(catalog_no) LIKE 'PRO%' THEN 'PROMOTED' WHEN upper(catalog_no) LIKE 'STA%' THEN 'REGULAR' ELSE 'Unknown' END) AS unique_manufacturers,
        count(DISTINCT main_category) AS unique_categories, count(DISTINCT sub_category) AS unique_subcategories,
        count(*) - count(description) AS missing_descriptions, count(*) - count(main_category) AS missing_categories FROM raw""",
    "cleaning_report": f"""WITH {ITEMS} SELECT (SELECT count(*) FROM raw) - count(*) AS rows_removed, count(*) AS rows_kept,
        count(DISTINCT catalog_no) AS unique_skus, count(DISTINCT mfr_code) AS unique_manufacturers,
        count(DISTINCT main_category) AS unique_main_categories, count(DISTINCT sub_category) AS unique_sub_categories,
        count(*) - count(description) AS missing_descriptions, count(*) - count(main_category) AS missing_main_categories,
        count(*) - count(sub_category) AS missing_sub_categories FROM items""",
    "manufacturer_distribution": _counts("mfr_code"),
    "category_distribution": _counts("main_category"),
    "subcategory_distribution": _counts("sub_category"),
    "distributions": f"""WITH {ITEMS} SELECT 'mfr_code' AS metric, mfr_code AS key, count(*) AS value FROM items GROUP BY ALL
        UNION ALL SELECT 'main_category', main_category, count(*) FROM items GROUP BY ALL
        UNION ALL SELECT 'sub_category', sub_category, count(*) FROM items GROUP BY ALL""",
    "cluster_distribution": _counts("cluster", "vectors", VECTORS),
    "top_subcategories": f"WITH {ITEMS} SELECT sub_category, count(*) AS n FROM items GROUP BY ALL ORDER BY n DESC, sub_category LIMIT 20",
    "category_cluster_crosstab": f"WITH {VECTORS} SELECT main_category, "
    + ", ".join(f'count(*) FILTER (cluster = {k}) AS "{k}"' for k in range(-1, 9))
    + " FROM vectors GROUP BY main_category",
    "category_cluster_counts": f"WITH {VECTORS} SELECT main_category, cluster, count(*) AS n FROM vectors GROUP BY ALL",
    "chart_statistics": f"""WITH {VECTORS} SELECT count(*) AS total_items, count(DISTINCT main_category) AS main_categories,
        count(DISTINCT sub_category) AS sub_categories, count(DISTINCT cluster) AS clusters FROM vectors""",
    "category_changes": f"WITH {PREDICTED} {CHANGED}",
    "category_change_stats": f"""WITH {PREDICTED}, c AS ({CHANGED}) SELECT count(*) FILTER (main_category_changed) AS main_category_changed,
        count(*) FILTER (main_category_changed) / count(*) AS main_category_changed_pct,
        count(*) FILTER (sub_category_changed) AS sub_category_changed,
        count(*) FILTER (sub_category_changed) / count(*) AS sub_category_changed_pct FROM c""",
    "routing_stats": f"""WITH {FALLBACK} SELECT count(*) AS total, count(*) FILTER (NOT sent) AS model_used, count(*) FILTER (sent) AS completion_used,
        count(*) FILTER (sent AND failed) AS completion_failed, count(*) FILTER (NOT sent) / count(*) * 100 AS model_used_pct,
        count(*) FILTER (sent) / count(*) * 100 AS completion_used_pct,
        count(*) FILTER (sent AND failed) / nullif(count(*) FILTER (sent), 0) * 100 AS completion_failed_pct FROM fallback""",
    "enrichment_stats": f"WITH {ITEMS} SELECT count(*) AS total, count(*) FILTER ({_answer(ENRICH)} <> 'Unknown') AS enriched FROM items",
    "request_stats": f"""WITH {DOCS} SELECT count(*) AS total_requests, count(*) FILTER (len({_tail(MAIN_SHORT)}) > 0) AS successful_requests,
        count(*) FILTER (len({_tail(MAIN_SHORT)}) = 0) AS failed_requests FROM items""",
    "run_summary": f"""WITH {VECTORS} SELECT count(*) AS total_items, count(DISTINCT main_category) AS unique_categories,
        count(DISTINCT sub_category) AS unique_subcategories, count(DISTINCT cluster) AS clusters FROM vectors""",
    "tokenize": f"WITH {DOCS} SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({TOKENS}) AS term FROM items) GROUP BY ALL",
    "tfidf_weights": f"WITH {DOCS}, {UNIT} SELECT text_id, n_rows, term, round(w, 9) AS weight FROM unit",
    "vocabulary_topk": f"WITH {DOCS}, {UNIT} SELECT term, df, occurrences FROM vocab ORDER BY occurrences DESC, term LIMIT 1000",
    "description_similarity_pairs": f"""WITH {DOCS}, {UNIT}, {TEXT_PAIRS}
        SELECT ti AS text_i, tj AS text_j, d AS desc_sim, a.n_rows AS n_i, b.n_rows AS n_j, a.n_rows * b.n_rows AS row_pairs
        FROM text_pairs JOIN texts a ON a.text_id = ti JOIN texts b ON b.text_id = tj WHERE d >= 0.8""",
    "sku_similarity_pairs": f"""WITH {ITEMS}, {SKU_PROFILE} SELECT id_i AS row_i, id_j AS row_j, sku_i AS catalog_no_i, sku_j AS catalog_no_j,
        s AS sku_sim, n_i * n_j AS row_pairs FROM sp WHERE s >= 0.8""",
    "combined_similarity": f"""WITH {ITEMS}, {_scored(0.7)} SELECT row_i, row_j, s AS sku_sim, d AS desc_sim, combined FROM scored""",
    "similar_pairs": f"""WITH {ITEMS}, {_scored(0.8)} SELECT row_i, row_j, sku_i AS catalog_no_i, sku_j AS catalog_no_j, combined, n_i, n_j, row_pairs FROM scored""",
    "similar_pairs_detail": f"""WITH {ITEMS}, {_scored(0.8)} SELECT row_i, row_j, sku_i AS catalog_no_i, sku_j AS catalog_no_j, combined, row_pairs,
        a.description AS description_i, a.main_category AS main_category_i, a.sub_category AS sub_category_i,
        b.description AS description_j, b.main_category AS main_category_j, b.sub_category AS sub_category_j
        FROM scored JOIN items a ON a.row_id = row_i JOIN items b ON b.row_id = row_j""",
    "similar_row_pairs": f"""WITH {ITEMS}, {UNIT}, {TEXT_PAIRS},
        numbered AS (SELECT row_id AS id, catalog_no AS sku, text_id FROM items JOIN texts USING (description)),
        {sku_pairs("rp", "numbered", "a.id AS row_i, b.id AS row_j, a.sku AS catalog_no_i, b.sku AS catalog_no_j, a.text_id AS ta, b.text_id AS tb")},
        scores AS (SELECT rp.*, round(0.4 * s + 0.6 * (CASE WHEN ta = tb THEN 1.0 ELSE coalesce(d, 0.0) END), 9) AS combined
          FROM rp LEFT JOIN text_pairs ON ti = least(ta, tb) AND tj = greatest(ta, tb))
        SELECT row_i, row_j, catalog_no_i, catalog_no_j, combined FROM scores WHERE combined >= 0.8""",
    "item_similarity_profile": f"""WITH {ITEMS}, {SKU_PROFILE} SELECT sku AS catalog_no, round(mean, 9) AS average_similarity,
        round(high, 9) AS high_similarity_average FROM sku_profile""",
    "best_sku_match": f"WITH {ITEMS}, {SKU_PROFILE} SELECT sku AS catalog_no, top AS highest_sku_similarity, best AS most_similar_sku FROM sku_profile",
    "best_description_match": f"""WITH {DOCS}, {UNIT}, {TEXT_PAIRS}, {SKUS}, {DESC_PROFILE}
        SELECT sku AS catalog_no, top AS highest_desc_similarity, best AS most_similar_desc_sku FROM desc_profile""",
    "per_item_stats": f"""WITH {ITEMS}, {UNIT}, {TEXT_PAIRS}, {SKU_PROFILE}, {DESC_PROFILE}
        SELECT s.sku AS catalog_no, round(s.mean, 9) AS avg_sku_similarity, s.top AS max_sku_similarity,
        round(d.mean, 9) AS avg_desc_similarity, d.top AS max_desc_similarity FROM sku_profile s JOIN desc_profile d USING (id)""",
    "similarity_columns": f"""WITH {ITEMS}, {UNIT}, {TEXT_PAIRS}, {SKU_PROFILE}, {DESC_PROFILE}
        SELECT row_id, catalog_no, s.top AS highest_sku_similarity, s.best AS most_similar_sku, d.top AS highest_desc_similarity,
        d.best AS most_similar_desc_sku, round(s.mean, 9) AS average_similarity, round(s.high, 9) AS high_similarity_average
        FROM items JOIN sku_profile s ON s.sku = catalog_no JOIN desc_profile d ON d.id = s.id""",
    "similarity_lookup": f"""WITH {ITEMS}, {SKU_PROFILE},
        asked AS (SELECT DISTINCT a.catalog_no AS i, coalesce(b.catalog_no, 'none') AS j FROM raw a JOIN raw b ON b.row_id = a.row_id + 1 WHERE a.catalog_no IS NOT NULL)
        SELECT i AS catalog_no_i, j AS catalog_no_j, i IN (SELECT sku FROM skus) AND j IN (SELECT sku FROM skus) AS found,
        CASE WHEN i IN (SELECT sku FROM skus) AND j IN (SELECT sku FROM skus) THEN (CASE WHEN i = j THEN 1.0 ELSE s END) END AS sku_sim
        FROM asked LEFT JOIN both_sides ON sku = i AND other_sku = j""",
    "similarity_statistics": f"""WITH RECURSIVE {ITEMS}, {_scored(0.8)}, {SKU_PROFILE}, {_sweep([0.8])}
        SELECT sweep.* EXCLUDE (threshold), (SELECT round(sum(mean * n) / sum(n), 9) FROM sku_profile JOIN skus USING (id)) AS avg_similarity_mean,
        (SELECT round(sum(high * n) / sum(n) FILTER (high IS NOT NULL), 9) FROM sku_profile JOIN skus USING (id)) AS high_similarity_mean,
        (SELECT CAST(coalesce(sum(n) FILTER (high > 0), 0) AS BIGINT) FROM sku_profile JOIN skus USING (id)) AS items_with_high_similarity FROM sweep""",
    "threshold_sweep": f"WITH RECURSIVE {ITEMS}, {_scored(0.7)}, {SKU_PROFILE}, {_sweep([0.7, 0.8, 0.9])} SELECT * FROM sweep",
    "graph_vertices": f"""WITH {ITEMS} SELECT catalog_no, arg_max(description, row_id) AS description, arg_max(main_category, row_id) AS main_category,
        arg_max(sub_category, row_id) AS sub_category FROM items GROUP BY catalog_no""",
    "graph_edges": f"""WITH {ITEMS}, {_scored(0.8)} SELECT least(sku_i, sku_j) AS src, greatest(sku_i, sku_j) AS dst,
        arg_max(combined, struct_pack(a := least(last_i, last_j), b := greatest(last_i, last_j))) AS weight
        FROM scored WHERE sku_i <> sku_j GROUP BY ALL""",
    "network_edges": f"""WITH {ITEMS}, {_scored(0.5, strict=True)},
        v AS (SELECT catalog_no, arg_max(main_category, row_id) AS m FROM items GROUP BY catalog_no),
        e AS (SELECT least(sku_i, sku_j) AS src, greatest(sku_i, sku_j) AS dst,
          arg_max(combined, struct_pack(a := least(last_i, last_j), b := greatest(last_i, last_j))) AS weight FROM scored WHERE sku_i <> sku_j GROUP BY ALL)
        SELECT src, dst, weight, a.m AS src_main_category, b.m AS dst_main_category FROM e JOIN v a ON a.catalog_no = src JOIN v b ON b.catalog_no = dst""",
    "connected_components": f"""WITH RECURSIVE {ITEMS}, {_scored(0.8)}, {SKUS},
        {_components("SELECT DISTINCT 0 AS level, si.id AS src, sj.id AS dst FROM scored JOIN skus si ON si.sku = sku_i JOIN skus sj ON sj.sku = sku_j WHERE sku_i <> sku_j")}
        SELECT node, component FROM labels""",
    "cluster_graph_metrics": f"WITH {VECTORS}, {CLIQUES} SELECT * FROM cliques",
    "sku_features": rf"""WITH {DOCS} SELECT row_id, CAST(length(catalog_no) AS INTEGER) AS sku_length,
        CAST(length(regexp_replace(catalog_no, '[^\p{{Nd}}]', '', 'g')) AS INTEGER) AS sku_digits,
        CAST(length(regexp_replace(catalog_no, '[^\p{{L}}]', '', 'g')) AS INTEGER) AS sku_letters FROM items""",
    "standard_scale": f"""WITH {VECTORS}, dims AS (SELECT row_id, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS d FROM vectors),
        s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS sd FROM dims GROUP BY d)
        SELECT row_id, CAST(d AS INTEGER) AS position, round((x - m) / (CASE WHEN sd > 0 THEN sd ELSE 1.0 END), 6) AS value FROM dims JOIN s USING (d)""",
    "label_encode": f"WITH {ITEMS} SELECT DISTINCT main_category AS value, CAST(dense_rank() OVER (ORDER BY main_category) - 1 AS INTEGER) AS label FROM items",
    "sub_model_eligibility": f"""WITH {ITEMS} SELECT main_category, count(DISTINCT sub_category) AS n_sub, count(*) AS n,
        count(DISTINCT sub_category) >= 2 AS eligible FROM items GROUP BY main_category""",
    "route_low_confidence": f"WITH {PREDICTED} SELECT row_id, sent AS needs_completion FROM routed",
    "enrichment_prompt": f"WITH {ITEMS} SELECT row_id, {ENRICH} AS prompt FROM items",
    "category_prompts": f"WITH {ITEMS} SELECT row_id, {MAIN_LONG} AS main_prompt, {_sub_long('main_category')} AS sub_prompt FROM items",
    "category_prompts_short": f"WITH {ITEMS} SELECT row_id, {MAIN_SHORT} AS main_prompt, {_sub_short('main_category')} AS sub_prompt FROM items",
    "complete_text": f"""WITH {DOCS} SELECT row_id, {_answer(MAIN_SHORT)} AS result,
        CASE WHEN len({_tail(MAIN_SHORT)}) = 0 THEN 'failed' ELSE 'ok' END AS status FROM items""",
    "enrich_descriptions": f"WITH {ITEMS} SELECT row_id, {_answer(ENRICH)} AS enriched_description FROM items",
    "llm_fallback": f"""WITH {FALLBACK} SELECT row_id, CASE WHEN NOT sent THEN pm WHEN failed THEN 'Unknown' ELSE ma END AS predicted_main_category,
        CASE WHEN NOT sent THEN ps WHEN failed THEN 'Unknown' ELSE sa END AS predicted_sub_category,
        CASE WHEN sent THEN 0.0 ELSE cm END AS main_category_confidence, CASE WHEN sent THEN 0.0 ELSE cs END AS sub_category_confidence,
        CASE WHEN NOT sent THEN 'ML prediction' WHEN failed THEN 'GPT failed: nothing to say' ELSE 'Used GPT (ML not trained or low confidence)' END AS categorization_reason
        FROM fallback""",
    "fallback_uncertain_parts": f"""WITH {PREDICTED},
        a AS (SELECT *, CASE WHEN cm < 0.8 THEN {_answer(MAIN_LONG)} ELSE pm END AS m2 FROM predicted)
        SELECT row_id, m2 AS predicted_main_category, CASE WHEN cs < 0.8 THEN {_answer(_sub_long('m2'))} ELSE ps END AS predicted_sub_category,
        CASE WHEN cm < 0.8 THEN 0.0 ELSE cm END AS main_category_confidence, CASE WHEN cs < 0.8 THEN 0.0 ELSE cs END AS sub_category_confidence FROM a""",
    "reevaluate_categories": f"""WITH {ITEMS}, a AS (SELECT *, {_answer(MAIN_LONG)} AS ma FROM items), b AS (SELECT *, {_answer(_sub_long('ma'))} AS sa FROM a)
        SELECT row_id, ma AS llm_main_category, sa AS llm_sub_category, ma <> main_category AS main_category_changed, sa <> sub_category AS sub_category_changed FROM b""",
    "neighbour_pairs": f"WITH {COSINES} SELECT i AS row_i, j AS row_j, c AS cosine, n_i * n_j AS row_pairs FROM near WHERE i < j",
    "dbscan": DBSCAN,
    "cluster_summary": f"""WITH {VECTORS} SELECT count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters,
        count(*) FILTER (cluster = -1) AS n_noise, count(*) AS n_items FROM vectors""",
    "cluster_sizes": f"WITH {VECTORS} SELECT cluster, count(*) AS size FROM vectors GROUP BY cluster",
    "cluster_category_profile": f"""WITH {VECTORS} SELECT cluster, 'main' AS level, main_category AS category, count(*) AS n FROM vectors WHERE cluster <> -1 GROUP BY ALL
        UNION ALL SELECT cluster, 'sub', sub_category, count(*) FROM vectors WHERE cluster <> -1 GROUP BY ALL""",
    "silhouette": f"WITH {SILHOUETTE} SELECT silhouette FROM sil",
    "calinski_harabasz": f"WITH {CLUSTERED}, {CALINSKI} SELECT calinski_harabasz FROM ch",
    "davies_bouldin": f"WITH {CLUSTERED}, {DAVIES} SELECT davies_bouldin FROM db",
    "cluster_metrics": f"""WITH {SILHOUETTE}, {CALINSKI}, {DAVIES}, {CLIQUES} SELECT silhouette, calinski_harabasz, davies_bouldin,
        round(avg_degree, 6) AS avg_degree, num_components, largest_component FROM sil JOIN ch ON true JOIN db ON true JOIN cliques ON true""",
    "ensure_columns": f"WITH {RAW} SELECT row_id, catalog_no, 'Unknown' AS description, main_category, 'Unknown' AS sub_category, mfr_code FROM raw",
    "tfidf_features": f"WITH {DOCS}, {UNIT}, {_limited(1000)} SELECT text_id, term, round(w, 9) AS weight FROM lim",
    "gram_matrix": f"""WITH {DOCS}, {UNIT}, {_limited(100)} SELECT a.term AS term_i, b.term AS term_j, round(sum(a.n_rows * a.w * b.w), 6) AS product
        FROM lim a JOIN lim b ON a.text_id = b.text_id AND a.term <= b.term GROUP BY ALL""",
    "analyze_clusters": f"""WITH {SILHOUETTE}, {CALINSKI}, {DAVIES}, {CLIQUES},
        measured AS (SELECT * FROM sil JOIN ch ON true JOIN db ON true JOIN cliques ON true),
        long(part, key, value) AS (
          SELECT 'summary', 'n_clusters', count(DISTINCT cluster)::DOUBLE FROM kept UNION ALL
          SELECT 'summary', 'n_noise', count(*) FILTER (cluster = -1) FROM vectors UNION ALL SELECT 'summary', 'n_items', count(*) FROM vectors UNION ALL
          SELECT 'metrics', 'silhouette', silhouette FROM measured UNION ALL SELECT 'metrics', 'calinski_harabasz', calinski_harabasz FROM measured UNION ALL
          SELECT 'metrics', 'davies_bouldin', davies_bouldin FROM measured UNION ALL SELECT 'metrics', 'avg_degree', avg_degree FROM measured UNION ALL
          SELECT 'metrics', 'num_components', num_components FROM measured UNION ALL SELECT 'metrics', 'largest_component', largest_component FROM measured UNION ALL
          SELECT 'sizes', cluster::VARCHAR, count(*) FROM vectors GROUP BY cluster UNION ALL
          SELECT 'categories', concat_ws('/', cluster, 'main', main_category), count(*) FROM vectors WHERE cluster <> -1 GROUP BY ALL UNION ALL
          SELECT 'categories', concat_ws('/', cluster, 'sub', sub_category), count(*) FROM vectors WHERE cluster <> -1 GROUP BY ALL)
        SELECT part, key, round(value, 6) AS value FROM long""",
    "chart_tables": f"""WITH {ITEMS}, {_scored(0.5, strict=True)}, c(chart, n_rows) AS (
        SELECT 'category_distribution', count(DISTINCT main_category) FROM items UNION ALL
        SELECT 'top_subcategories', least(20, count(DISTINCT sub_category)) FROM items UNION ALL
        SELECT 'network_vertices', count(DISTINCT catalog_no) FROM items UNION ALL
        SELECT 'network_edges', count(*) FROM (SELECT DISTINCT least(sku_i, sku_j), greatest(sku_i, sku_j) FROM scored WHERE sku_i <> sku_j) UNION ALL
        SELECT 'layout', count(*) FROM items UNION ALL SELECT 'chart_statistics', 1 UNION ALL
        SELECT 'cluster_distribution', count(DISTINCT length(sub_category)) FROM items UNION ALL
        SELECT 'category_cluster_crosstab', count(*) FROM (SELECT DISTINCT main_category, length(sub_category) FROM items))
        SELECT chart, n_rows::BIGINT AS n_rows FROM c""",
    "run_pipeline": _analysis(),
    "network_stars": f"""WITH {ITEMS}, {UNIT}, {PROFILES} SELECT id, sku AS catalog_no, count(*) OVER (PARTITION BY text_id) AS size
        FROM profiles WHERE text_id IN (SELECT text_id FROM unit) QUALIFY count(*) OVER (PARTITION BY text_id) > 1""",
    "attach_clusters": f"WITH {VECTORS} SELECT row_id, main_category, sub_category, cluster FROM vectors",
}
