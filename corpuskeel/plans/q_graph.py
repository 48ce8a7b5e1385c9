"""Queries: dependence graphs (GR), group ids (AG4-AG6), whole-group splits (WN10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import bounds as B
from ..operators import allocate as A
from ..operators import graph, stats
from ..operators.skew import FAN_IN, digest_tree, member_digest, shuffled
from ..session import cut
from .q_joins import SQL_FINGERPRINTS
from .registry import query, table
from .views import SQL_NODES, frame_tables, nodes, sql_text_digest

_KINDS = ("raw", "canonical", "prompt_group", "prompt_seed_group", "producer_group", "unknown_producer_quarantine")
_COLUMNS = ("raw_sha256", "canonical_pixel_sha256", "prompt_group", "prompt_seed_group", "producer_group",
            f"CASE WHEN producer_status = '{K.STATUS_UNKNOWN_PRODUCER}' THEN '{K.UNKNOWN_COHORT_KEY}' END")


def _keys_sql(n: int) -> str:
    return "keys AS (" + " UNION ALL ".join(
        f"SELECT id, '{k}' AS kind, {c} AS key FROM nodes WHERE {c} IS NOT NULL" for k, c in list(zip(_KINDS, _COLUMNS))[:n]
    ) + ")"


SQL_KEYS = _keys_sql(6)
SQL_CONTENT_KEYS = _keys_sql(4)
_STARS = "stars AS (SELECT k.id AS src, f.dst, k.kind FROM keys k JOIN (SELECT kind, key, min(id) AS dst FROM keys GROUP BY 1, 2) f USING (kind, key) WHERE k.id <> f.dst)"


def _components_sql(edges: str) -> str:
    """Transitive closure over `edges` (src, dst); the component is the smallest reachable id."""
    return f"""both_ways AS (SELECT src, dst FROM ({edges}) UNION SELECT dst, src FROM ({edges})),
reach AS (SELECT id AS src, id AS dst FROM nodes UNION SELECT r.src, b.dst FROM reach r JOIN both_ways b ON r.dst = b.src),
comp AS (SELECT src AS id, min(dst) AS component FROM reach GROUP BY 1)"""


def tree_sql(name: str, depth: int = 5) -> str:
    """CTEs that fold `<name>_hashed` (g, d) to `<name>_root` (g, d, n) by the rule of the digest tree."""
    t = name + "_"
    prefix = f"""{t}unique AS (SELECT g, d, count(*) AS n FROM {t}hashed GROUP BY 1, 2),
{t}counts AS (SELECT g, l, substr(d, 1, l) AS p, count(*) AS c FROM {t}unique, (SELECT CAST(range AS INTEGER) AS l FROM range({depth + 1})) GROUP BY 1, 2, 3),
{t}leaf AS (SELECT a.g, a.l, a.p FROM {t}counts a LEFT JOIN {t}counts b ON b.g = a.g AND b.l = a.l - 1 AND b.p = substr(a.p, 1, a.l - 1)
  WHERE a.c <= {FAN_IN} AND (a.l = 0 OR b.c > {FAN_IN})),
{t}leaves AS (SELECT f.g, f.p, sha256('leaf' || chr(10) || string_agg(u.d || ':' || u.n, chr(10) ORDER BY u.d || ':' || u.n)) AS d
  FROM {t}leaf f JOIN {t}unique u ON u.g = f.g AND substr(u.d, 1, f.l) = f.p GROUP BY 1, 2),
{t}level{depth} AS (SELECT * FROM {t}leaves)"""
    steps = [
        f"""{t}level{k} AS (SELECT g, p, d FROM {t}level{k + 1} WHERE length(p) <= {k} UNION ALL
  SELECT g, substr(p, 1, {k}), sha256('node' || chr(10) || string_agg(substr(p, {k + 1}, 1) || ':' || d, chr(10) ORDER BY substr(p, {k + 1}, 1)))
  FROM {t}level{k + 1} WHERE length(p) > {k} GROUP BY 1, 2)"""
        for k in reversed(range(depth))
    ]
    root = f"{t}root AS (SELECT g, d, n FROM {t}level0 JOIN (SELECT g, CAST(sum(n) AS BIGINT) AS n FROM {t}unique GROUP BY 1) USING (g))"
    return ", ".join([prefix, *steps, root])


def _named_sql(tag: str) -> str:
    """Ids of the components in `comp`: the tagged digest of the digest tree over their members."""
    return f"""id_hashed AS (SELECT component AS g, sha256(id) AS d FROM comp), {tree_sql('id')},
named AS (SELECT g AS component, {sql_text_digest(tag, 'd')} AS group_id, n AS n_members FROM id_root)"""


def frame_nodes(spark, folder):
    return cut(nodes(spark, folder), "nodes")


@query("gr1_star_edges", f"WITH {SQL_NODES}, {SQL_KEYS}, {_STARS} SELECT src, dst, kind FROM stars")
def gr1(spark, folder):
    return graph.star_edges(graph.leakage_keys(frame_nodes(spark, folder)))


@query(
    "gr1_edge_counts",
    f"""WITH {SQL_NODES}, {SQL_KEYS}, {SQL_FINGERPRINTS}, c AS (SELECT kind, key, count(*) - 1 AS n FROM keys GROUP BY 1, 2),
       pairs AS (SELECT (SELECT coalesce(sum(n_left * n_right), 0) FROM near) + (SELECT coalesce(sum(n_rows * (n_rows - 1) // 2), 0) FROM classes) AS n)
       SELECT kind, CAST(sum(n) AS BIGINT) AS n_edges FROM c GROUP BY 1 HAVING sum(n) > 0
       UNION ALL SELECT 'coarse_near_pixels', CAST(n AS BIGINT) FROM pairs WHERE n > 0""",
)
def gr1_counts(spark, folder):
    rows, colours = frame_tables(spark, folder)
    classes = cut(graph.near_classes(rows), "classes")
    return graph.edge_counts(graph.leakage_keys(rows), graph.near_pair_count(classes, graph.near_links(classes, colours)))


@query(
    "gr2_unknown_cohort",
    f"""WITH RECURSIVE {SQL_NODES}, {SQL_KEYS}, {_STARS}, {_components_sql('SELECT src, dst FROM stars')}
       SELECT n.id, c.component FROM nodes n JOIN comp c USING (id) WHERE producer_status = '{K.STATUS_UNKNOWN_PRODUCER}'""",
)
def gr2(spark, folder):
    rows = frame_nodes(spark, folder)
    members = graph.connected_components(rows, graph.star_edges(graph.leakage_keys(rows)))
    unknown = rows.filter(F.col("producer_status") == K.STATUS_UNKNOWN_PRODUCER).select("id")
    return members.join(unknown, "id", "left_semi")


@query(
    "gr3_components",
    f"WITH RECURSIVE {SQL_NODES}, {SQL_CONTENT_KEYS}, {_STARS}, {_components_sql('SELECT src, dst FROM stars')} SELECT id, component FROM comp",
)
def gr3(spark, folder):
    rows = frame_nodes(spark, folder)
    return graph.connected_components(rows, graph.star_edges(graph.leakage_keys(rows, producers=False)))


@query(
    "gr3_supplier_components",
    """WITH RECURSIVE pairs AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
       firsts AS (SELECT p, min(s) AS m FROM pairs GROUP BY 1), edges AS (SELECT DISTINCT s AS src, m AS dst FROM pairs JOIN firsts USING (p) WHERE s <> m),
       two AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
       reach AS (SELECT s_suppkey AS src, s_suppkey AS dst FROM supplier UNION SELECT r.src, t.dst FROM reach r JOIN two t ON r.dst = t.src)
       SELECT src AS id, min(dst) AS component FROM reach GROUP BY 1""",
)
def gr3_suppliers(spark, folder):
    """Suppliers linked by a part they both deliver: few nodes under many key rows."""
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").cast("string").alias("key")).distinct()
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"))
    return graph.connected_components(suppliers, graph.star_edges(lines.withColumn("kind", F.lit("part"))))


_NEAR_EDGES = """SELECT src, dst FROM stars UNION SELECT right_id, left_id FROM near
  UNION SELECT p.id, c.id FROM prints p JOIN classes c USING (fhi, flo, width, colour) WHERE p.id <> c.id"""


def leakage_groups(spark, folder):
    """(rows, groups): the whole leakage frame, with all key edges, the quarantine cohort and near pairs."""
    rows, colours = frame_tables(spark, folder)
    return rows, graph.leakage_frame(rows, colours)


SQL_GROUPS = f"{SQL_NODES}, {SQL_KEYS}, {_STARS}, {SQL_FINGERPRINTS}, {_components_sql(_NEAR_EDGES)}, {_named_sql(K.TAG_LEAKAGE_GROUP)}"


@query("gr4_leakage_frame", f"WITH RECURSIVE {SQL_GROUPS} SELECT id, group_id, n_members FROM comp JOIN named USING (component)")
def gr4(spark, folder):
    return leakage_groups(spark, folder)[1]


def _content_groups(spark, folder, tag=K.TAG_COMPONENT):
    rows = frame_nodes(spark, folder)
    return rows, cut(graph.group_frame(rows, graph.leakage_keys(rows, producers=False), tag=tag), "content-groups")


def _named_content(tag: str) -> str:
    return f"{SQL_NODES}, {SQL_CONTENT_KEYS}, {_STARS}, {_components_sql('SELECT src, dst FROM stars')}, {_named_sql(tag)}"


_CONTENT = _named_content(K.TAG_COMPONENT)
_SELECTED = """chosen AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality = 0 AS is_reserved FROM labels)"""


@query(
    "gr5_restricted_groups",
    f"""WITH RECURSIVE {_CONTENT}, {_SELECTED} SELECT id, group_id, n_members, is_reserved FROM comp JOIN named USING (component) JOIN chosen USING (id)""",
)
def gr5(spark, folder):
    _, groups = _content_groups(spark, folder)
    selected = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    return graph.restrict_groups(groups, selected, selected.filter("quality = 0"))


@query(
    "gr5_holdout_closure",
    f"""WITH RECURSIVE {_CONTENT}, g AS (SELECT id, group_id FROM comp JOIN named USING (component))
       SELECT id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g JOIN labels ON id = CAST(doc_id AS VARCHAR) WHERE toxic = 1)""",
)
def gr5_holdout(spark, folder):
    _, groups = _content_groups(spark, folder)
    holdout = table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return graph.holdout_closure(groups, holdout)


_TASKS = "task AS (SELECT s_suppkey AS id, CAST(s_acctbal AS BIGINT) AS pref, s_suppkey // 4 AS coarse FROM supplier)"
_EDGES = "edge AS (SELECT id, id // 2 AS parent FROM task WHERE id > 0 UNION SELECT id, id // 3 FROM task WHERE id > 0)"


def _tasks(spark, folder):
    # The SQL's cast rounds a balance to the nearest whole number, ties to even; Spark's cuts it off.
    tasks = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.rint("s_acctbal").cast("long").alias("pref"))
    edges = tasks.filter("id > 0").select("id", F.explode(F.array(F.floor(F.col("id") / 2), F.floor(F.col("id") / 3))).alias("parent"))
    return tasks, edges.distinct()


_LEVELS = "lv AS (SELECT id, 0 AS level FROM task WHERE id NOT IN (SELECT id FROM edge) UNION SELECT e.id, l.level + 1 FROM lv l JOIN edge e ON e.parent = l.id)"


@query(
    "gr6_task_levels",
    f"""WITH RECURSIVE {_TASKS}, {_EDGES}, {_LEVELS}, l AS (SELECT id, CAST(max(level) AS BIGINT) AS level FROM lv GROUP BY 1)
       SELECT id, level, row_number() OVER (PARTITION BY level ORDER BY pref, id) AS position FROM l JOIN task USING (id)""",
)
def gr6(spark, folder):
    return graph.task_levels(*_tasks(spark, folder), "pref").select("id", "level", "position")


@query(
    "gr7_contracted_graph",
    f"WITH {_TASKS}, {_EDGES} SELECT DISTINCT a.coarse AS id, b.coarse AS parent FROM edge e JOIN task a ON a.id = e.id JOIN task b ON b.id = e.parent WHERE a.coarse <> b.coarse",
)
def gr7(spark, folder):
    tasks, edges = _tasks(spark, folder)
    return graph.contract_graph(edges, tasks.select("id", F.floor(F.col("id") / 4).alias("coarse")))


@query(
    "ag4_group_ids",
    f"""WITH {SQL_NODES}, t_hashed AS (SELECT prompt_group AS g, sha256(id) AS d FROM nodes WHERE prompt_group IS NOT NULL), {tree_sql('t')}
       SELECT g AS prompt_group, {sql_text_digest(K.TAG_BYTE_TEXT_COMPONENT, 'd')} AS group_id, n AS n_members FROM t_root""",
)
def ag4(spark, folder):
    return member_digest(nodes(spark, folder).filter("prompt_group IS NOT NULL"), "prompt_group", "id", K.TAG_BYTE_TEXT_COMPONENT)


@query(
    "ag4_digest_tree",
    f"WITH t_hashed AS (SELECT l_returnflag AS g, sha256(l_orderkey || ':' || l_linenumber) AS d FROM lineitem), {tree_sql('t')} SELECT g, d AS tree_sha256, n AS n_members FROM t_root",
)
def ag4_tree(spark, folder):
    """Ids of groups far too large for one member list: a third of lineitem each."""
    hashed = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber"), 256).alias("d")
    )
    return digest_tree(hashed, ["g"], "d")


def _histogram_sql(content: str) -> str:
    return f"""WITH RECURSIVE {content}, {_SELECTED}, s AS (SELECT group_id, count(*) AS size, bool_or(is_reserved) AS reserved FROM comp JOIN named USING (component) JOIN chosen USING (id) GROUP BY 1)
       SELECT size, reserved, count(*) AS n_groups FROM s GROUP BY 1, 2"""


def _histogram(spark, folder, groups):
    """Sizes of the groups restricted to labelled documents, apart for groups that hold a reserved one."""
    selected = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    chosen = graph.restrict_groups(groups, selected, selected.filter("quality = 0"))
    return stats.size_histogram(chosen.withColumnRenamed("is_reserved", "reserved"), "group_id", "reserved")


@query("ag5_size_histogram", _histogram_sql(_CONTENT))
def ag5(spark, folder):
    return _histogram(spark, folder, _content_groups(spark, folder)[1])


@query("ag5_size_histogram_producers", _histogram_sql(f"{SQL_NODES}, {SQL_KEYS}, {_STARS}, {_components_sql('SELECT src, dst FROM stars')}, {_named_sql(K.TAG_COMPONENT)}"))
def ag5_producers(spark, folder):
    """The other variant of the components: producers and the quarantine cohort link as well."""
    rows = frame_nodes(spark, folder)
    return _histogram(spark, folder, cut(graph.group_frame(rows, graph.leakage_keys(rows), tag=K.TAG_COMPONENT), "producer-groups"))


# --- splits -----------------------------------------------------------------------------------


def split_rows(spark, folder):
    """The leakage frame, ready to be split by language: toxic documents are the fixed holdout, documents of
    low quality are reserved for development unless their group holds a toxic one."""
    rows, groups = leakage_groups(spark, folder)
    return cut(reserved_rows(cut(marked_rows(rows, groups), "marked-rows")), "split-rows")


def marked_rows(rows, groups):
    wanted = rows.select("id", "domain", "status", "quality", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_holdout"))
    return groups.join(shuffled(wanted), "id")


def reserved_rows(marked):
    held = marked.filter("is_holdout").select("group_id").distinct().withColumn("_held", F.lit(True))
    reserved = F.coalesce(F.col("quality") == 0, F.lit(False)) & F.col("_held").isNull()
    return marked.join(shuffled(held), "group_id", "left").select("id", "group_id", "domain", "status", reserved.alias("is_reserved"), "is_holdout")


def document_splits(spark, folder):
    rows = split_rows(spark, folder)
    budgets = A.proportional_budgets(rows)
    return A.allocate(rows, budgets), budgets


_S = K.SPLITS
_OF_GROUP = "list_filter(range(1, len(c) + 1), lambda d: c[d] > 0)"
_FRACTION = f"list_min(list_transform({_OF_GROUP}, lambda d: l[(d - 1) * 3 + s]::DOUBLE / b[(d - 1) * 3 + s]))"
_FITS = "len(list_filter(range(1, len(c) + 1), lambda d: c[d] > l[(d - 1) * 3 + s])) = 0"
_TIE = sql_text_digest(K.TAG_SPLIT_TIE, f"q.group_id || ':' || {list(_S)}[s]")
# The serial rule over `sized` (id, group_id, domain, status, is_reserved, is_holdout): forced groups first, then
# one group per step, over the remaining quotas l of (domain, split). Fractions are compared as doubles, which
# keeps equal fractions equal and is exact for counts of this size.
_SERIAL = f"""quota AS (SELECT domain, count(*) AS n, count(*) * 2 // 10 AS fifth FROM sized GROUP BY 1),
total AS (SELECT CAST(flatten(list([n - 2 * fifth, fifth, fifth] ORDER BY domain)) AS BIGINT[]) AS b FROM quota),
cell AS (SELECT group_id, domain, count(*) AS n FROM sized GROUP BY 1, 2),
kinds AS (SELECT group_id, count(*) AS n_members, count(DISTINCT domain) AS n_domains, bool_or(is_reserved) AS dev, bool_or(is_holdout) AS test FROM sized GROUP BY 1),
grp AS (SELECT k.group_id, n_members, n_domains, dev, test, list(coalesce(c.n, 0) ORDER BY q.domain) AS c
  FROM kinds k CROSS JOIN quota q LEFT JOIN cell c ON c.group_id = k.group_id AND c.domain = q.domain GROUP BY ALL),
forced AS (SELECT q.domain, s.k, coalesce(sum(CASE WHEN (g.dev AND s.k = 1) OR (NOT g.dev AND g.test AND s.k = 3) THEN c.n END), 0) AS n
  FROM quota q CROSS JOIN (VALUES (1), (2), (3)) s(k) LEFT JOIN cell c ON c.domain = q.domain LEFT JOIN kinds g ON g.group_id = c.group_id GROUP BY 1, 2),
opened AS (SELECT b, list_transform(list_zip(b, f), lambda z: z[1] - z[2]) AS l FROM total, (SELECT CAST(list(n ORDER BY domain, k) AS BIGINT[]) AS f FROM forced)),
seq AS (SELECT *, row_number() OVER (ORDER BY n_domains DESC, n_members DESC, {sql_text_digest(K.TAG_SPLIT_RANK, 'group_id')}) AS step FROM grp WHERE NOT dev AND NOT test),
walk AS (
  SELECT 0::BIGINT AS step, NULL::VARCHAR AS group_id, NULL::INTEGER AS pick, l, b FROM opened
  UNION ALL
  SELECT step, group_id, pick, list_transform(l, lambda x, i: x - CASE WHEN (i - 1) % 3 + 1 = pick THEN c[((i - 1) // 3) + 1] ELSE 0 END), b FROM (
    SELECT q.step, q.group_id, q.c, w.l, w.b,
      list_max(list_transform(list_filter([1, 2, 3], lambda s: {_FITS}), lambda s: {{'f': {_FRACTION}, 't': {_TIE}, 's': CAST(s AS INTEGER)}})).s AS pick
    FROM walk w JOIN seq q ON q.step = w.step + 1)),
placed AS (SELECT group_id, {list(_S)}[pick] AS split FROM walk WHERE step > 0 UNION ALL SELECT group_id, CASE WHEN dev THEN '{_S[0]}' ELSE '{_S[2]}' END FROM kinds WHERE dev OR test),
splits AS (SELECT s.id, s.group_id, s.domain, s.status, p.split FROM sized s JOIN placed p USING (group_id)),
reps AS (SELECT group_id, domain, arg_min(id, {sql_text_digest(K.TAG_REPRESENTATIVE, "group_id || ':' || id")}) AS rep FROM splits GROUP BY 1, 2)"""
_RESERVED = "coalesce(quality = 0, false) AND NOT bool_or(is_holdout) OVER (PARTITION BY group_id) AS is_reserved"
SQL_SPLITS = f"""{SQL_GROUPS}, marked AS (SELECT c.id, group_id, domain, status, quality, coalesce(toxic = 1, false) AS is_holdout
  FROM comp c JOIN named USING (component) JOIN nodes n ON n.id = c.id LEFT JOIN labels ON CAST(doc_id AS VARCHAR) = c.id),
sized AS (SELECT id, group_id, domain, status, {_RESERVED}, is_holdout FROM marked), {_SERIAL}"""


@query(
    "wn10_allocate",
    f"""WITH RECURSIVE {SQL_SPLITS} SELECT s.id, s.group_id, s.domain, s.split, s.id = r.rep AS is_representative FROM splits s JOIN reps r USING (group_id, domain)""",
)
def wn10(spark, folder):
    splits, _ = document_splits(spark, folder)
    return splits.select("id", "group_id", "domain", "split", "is_representative")


_CELLS = f"""g AS (SELECT domain, split, group_id, count(*) AS n, count(*) FILTER (status <> '{K.STATUS_PASS}') AS r FROM splits GROUP BY 1, 2, 3),
cells AS (SELECT domain, split, CAST(sum(n) AS BIGINT) AS n_images, CAST(sum(r) AS BIGINT) AS n_rejected, count(*) AS n_groups, count(*) FILTER (r > 0) AS n_unresolved,
  count(*) FILTER (r = 0) AS n_candidates, CAST(sum(n) AS BIGINT) AS target FROM g GROUP BY 1, 2)"""


@query(
    "ag6_cell_report",
    f"""WITH RECURSIVE {SQL_SPLITS}, {_CELLS} SELECT *, target - n_candidates AS shortfall, n_candidates >= 299 AS resolves_percent,
         round(CASE WHEN n_candidates > 0 THEN 1 - {K.ONE_SIDED_ALPHA} ** (1.0 / n_candidates) END, 6) AS zero_fp_upper,
         round({B.Z_95} / (2 * sqrt(n_candidates + {B.Z_95 * B.Z_95})), 6) AS wilson FROM cells""",
)
def ag6(spark, folder):
    splits, budgets = document_splits(spark, folder)
    report = A.cell_report(splits, budgets, F.col("status") != K.STATUS_PASS)
    return report.withColumns({"wilson": F.round(B.wilson_half_width("n_candidates"), 6), "zero_fp_upper": F.round("zero_fp_upper", 6)})


_CLASSES = (K.POSITIVE_CONDITION, *K.NEGATIVE_CONDITIONS)


@query(
    "ag6_class_cells",
    f"""WITH RECURSIVE {SQL_SPLITS}, {_CELLS} SELECT domain, split, class, target AS n_planned, n_candidates AS n_actual, n_images AS n_rows,
         CASE WHEN target <> n_candidates THEN '{K.STATUS_SHORT_CELL}' ELSE '{K.STATUS_FULL_CELL}' END AS status
       FROM cells, (VALUES {', '.join(f"('{c}')" for c in _CLASSES)}) t(class)""",
)
def ag6_classes(spark, folder):
    splits, budgets = document_splits(spark, folder)
    return A.class_cells(A.cell_report(splits, budgets, F.col("status") != K.STATUS_PASS), _CLASSES)


@query(
    "wn10_source_splits",
    f"""WITH RECURSIVE {_named_content(K.TAG_LEAKAGE_GROUP)}, marked AS (SELECT c.id, group_id, source AS domain, '' AS status, quality, false AS is_holdout
         FROM comp c JOIN named USING (component) JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.id LEFT JOIN labels l ON l.doc_id = d.doc_id),
       sized AS (SELECT id, group_id, domain, status, {_RESERVED}, is_holdout FROM marked), {_SERIAL} SELECT id, group_id, domain, split FROM splits""",
)
def wn10_sources(spark, folder):
    """Splits by source, where groups do span domains; documents of low quality are reserved."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("domain"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality")
    _, groups = _content_groups(spark, folder, K.TAG_LEAKAGE_GROUP)
    marked = groups.join(documents, "id").join(labels, "id", "left").withColumns({"status": F.lit(""), "is_holdout": F.lit(False)})
    rows = cut(reserved_rows(cut(marked, "marked-rows")), "split-rows")
    return A.allocate(rows, A.proportional_budgets(rows)).select("id", "group_id", "domain", "split")
