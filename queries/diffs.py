"""Change-audit queries: two versions of schedules, manifests, catalogs and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlog.operators import diff as df_, fingerprints as fp_
from airlog.operators.intervals import coverage_spans
from airlog.operators.joins import diff_records
from airlog.operators.scan import HOUR_US
from airlog.sources.manifests import classify_manifest
from queries.intervals import spans_sql
from queries.registry import query
from queries.scratch import scratch

FIELDS = ["title", "content_id"]

_DIFF = """
    WITH sides AS (
      SELECT b.station, b.id, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us, title, content_id, 0 AS side
      FROM baseline b JOIN windows w ON w.station = b.station WHERE start_time < w.horizon AND end_time > w.seam AND end_time > start_time
      UNION ALL
      SELECT b.station, b.id, epoch_us(start_time), epoch_us(end_time), title, content_id, 1
      FROM proposed b JOIN windows w ON w.station = b.station WHERE start_time < w.horizon AND end_time > w.seam AND end_time > start_time),
    reach AS (SELECT *, max(end_us) OVER (PARTITION BY station ORDER BY start_us, end_us, side, title, content_id, id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM sides),
    comp AS (SELECT *, max(CASE WHEN r IS NULL OR start_us >= r THEN start_us END)
                OVER (PARTITION BY station ORDER BY start_us, end_us, side, title, content_id, id) AS c FROM reach),
    meaning AS (SELECT station, c, start_us, end_us, title, content_id, count(*) FILTER (WHERE side = 0) AS b,
                       count(*) FILTER (WHERE side = 1) AS p FROM comp GROUP BY ALL),
    inter AS (SELECT station, c, start_us, end_us, sum(b) AS b, sum(p) AS p, sum(least(b, p)) AS same FROM meaning GROUP BY ALL),
    whole AS (SELECT station, c, sum(b) AS b, sum(p) AS p, sum(same) AS same, bool_or(b <> p) AS moved FROM inter GROUP BY ALL),
    kinds AS (SELECT *, CASE WHEN p = 0 THEN 'removed' WHEN b = 0 THEN 'generated' WHEN moved THEN 'reshaped' ELSE 'matched' END AS kind FROM whole),
    leftover AS (
      SELECT m.*, CASE WHEN m.p > m.b THEN 1 ELSE 0 END AS side, unnest(generate_series(1, abs(m.b - m.p))) AS copy
      FROM meaning m JOIN kinds k ON k.station = m.station AND k.c = m.c AND k.kind = 'matched' WHERE m.b <> m.p),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY station, start_us, end_us, side ORDER BY title, content_id, copy) AS k FROM leftover),
    pairs AS (SELECT a.station, a.start_us, a.end_us, a.k, a.title AS was_title, z.title AS now_title,
                     a.content_id AS was_content_id, z.content_id AS now_content_id
              FROM ranked a JOIN ranked z ON a.side = 0 AND z.side = 1 AND z.station = a.station AND z.start_us = a.start_us
                AND z.end_us = a.end_us AND z.k = a.k),
    summary AS (
      SELECT k.station,
        CAST(sum(b) AS BIGINT) AS baseline_blocks, CAST(sum(p) AS BIGINT) AS proposed_blocks, CAST(count(*) AS BIGINT) AS components,
        CAST(coalesce(sum(same) FILTER (WHERE kind = 'matched'), 0) AS BIGINT) AS unchanged_blocks,
        CAST(coalesce(sum(b - same) FILTER (WHERE kind = 'matched'), 0) AS BIGINT) AS replaced_pairs,
        CAST(coalesce(sum(b) FILTER (WHERE kind = 'removed'), 0) AS BIGINT) AS removed_blocks,
        CAST(coalesce(sum(p) FILTER (WHERE kind = 'generated'), 0) AS BIGINT) AS generated_blocks,
        CAST(count(*) FILTER (WHERE kind = 'reshaped') AS BIGINT) AS reshaped_components,
        CAST(coalesce(sum(b) FILTER (WHERE kind = 'reshaped'), 0) AS BIGINT) AS reshaped_baseline_blocks,
        CAST(coalesce(sum(p) FILTER (WHERE kind = 'reshaped'), 0) AS BIGINT) AS reshaped_proposed_blocks,
        CAST((SELECT count(*) FROM pairs x WHERE x.station = k.station AND was_title IS DISTINCT FROM now_title) AS BIGINT) AS title_changes,
        CAST((SELECT count(*) FROM pairs x WHERE x.station = k.station AND was_content_id IS DISTINCT FROM now_content_id) AS BIGINT) AS content_id_changes
      FROM kinds k GROUP BY k.station)
"""


def _by_user(sql: str) -> str:
    """The same SQL with one station per user: sparse schedules with many small components."""
    swap = """WITH windows_u AS (SELECT * FROM windows_by_user),
    base_u AS (SELECT id, CAST(content_id AS VARCHAR) AS station, title, content_id, start_time, end_time FROM baseline),
    prop_u AS (SELECT id, CAST(content_id AS VARCHAR) AS station, title, content_id, start_time, end_time FROM proposed),
"""
    body = sql.replace("FROM baseline b JOIN windows w", "FROM base_u b JOIN windows_u w").replace(
        "FROM proposed b JOIN windows w", "FROM prop_u b JOIN windows_u w")
    return swap + body.strip()[len("WITH "):]


def _user(t, blocks):
    return blocks.withColumn("station", F.col("content_id").cast("string"))


@query("diff_schedules", _DIFF + "SELECT * FROM summary")
def _(t):
    return df_.diff_schedules(t.baseline, t.proposed, t.windows, FIELDS)


@query("diff_schedules_by_user", _by_user(_DIFF + "SELECT * FROM summary"))
def _(t):
    return df_.diff_schedules(_user(t, t.baseline), _user(t, t.proposed), t.windows_by_user, FIELDS)


@query("diff_schedules_chunked", _by_user(_DIFF + "SELECT * FROM summary"))
def _(t):
    return df_.diff_schedules(_user(t, t.baseline), _user(t, t.proposed), t.windows_by_user, FIELDS, width=HOUR_US)


@query("replaced_pairs", _by_user(_DIFF + """SELECT station, start_us, end_us, k, was_title, now_title, was_content_id, now_content_id,
    CASE WHEN was_title IS DISTINCT FROM now_title THEN 'title' ELSE '' END
    || CASE WHEN was_content_id IS DISTINCT FROM now_content_id THEN 'content_id' ELSE '' END AS changed FROM pairs"""))
def _(t):
    found = df_.ScheduleDiff(_user(t, t.baseline), _user(t, t.proposed), t.windows_by_user, FIELDS).replaced()
    return found.withColumn("changed", F.array_join("changed_fields", "")).drop("changed_fields")


@query("comparison_totals", _DIFF + """
    SELECT CAST(count(*) FILTER (WHERE replaced_pairs + removed_blocks + generated_blocks + reshaped_components > 0) AS BIGINT) AS changed_stations,
      """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (
    "baseline_blocks", "proposed_blocks", "components", "unchanged_blocks", "replaced_pairs", "removed_blocks", "generated_blocks",
    "reshaped_components", "reshaped_baseline_blocks", "reshaped_proposed_blocks", "title_changes", "content_id_changes")) + " FROM summary")
def _(t):
    return df_.comparison_totals(df_.diff_schedules(t.baseline, t.proposed, t.windows, FIELDS))


@query("accounting_errors", """
    SELECT CAST(NULL AS VARCHAR) AS station, 0 AS baseline_blocks, 0 AS proposed_blocks, 0 AS components, 0 AS unchanged_blocks,
      0 AS replaced_pairs, 0 AS removed_blocks, 0 AS generated_blocks, 0 AS reshaped_components, 0 AS reshaped_baseline_blocks,
      0 AS reshaped_proposed_blocks FROM blocks WHERE FALSE""")
def _(t):
    """Every block is accounted for, so no station may appear."""
    return df_.ScheduleDiff(t.baseline, t.proposed, t.windows, FIELDS).accounting_errors()


_COUNTERS = ("baseline_blocks", "proposed_blocks", "components", "unchanged_blocks", "replaced_pairs", "removed_blocks", "generated_blocks",
             "reshaped_components", "reshaped_baseline_blocks", "reshaped_proposed_blocks")


@query("accounting_errors_found", _by_user(_DIFF + "SELECT station, " + ", ".join(
    f"{c} + CASE WHEN CAST(station AS INTEGER) % {3 if c == 'removed_blocks' else 5} = 0 THEN 1 ELSE 0 END AS {c}"
    if c in ("removed_blocks", "generated_blocks") else c for c in _COUNTERS)
    + " FROM summary WHERE CAST(station AS INTEGER) % 3 = 0 OR CAST(station AS INTEGER) % 5 = 0"))
def _(t):
    """Counters that were tampered with: of every third station a removed block too many, of every fifth a generated one."""
    counts = df_.ScheduleDiff(_user(t, t.baseline), _user(t, t.proposed), t.windows_by_user, FIELDS).counts()
    number = F.col("station").cast("int")
    return df_.accounting_errors(counts.withColumns({
        "removed_blocks": F.col("removed_blocks") + F.when(number % 3 == 0, 1).otherwise(0),
        "generated_blocks": F.col("generated_blocks") + F.when(number % 5 == 0, 1).otherwise(0)}))


def _two_spans() -> str:
    cuts = []
    for name in ("baseline", "proposed"):
        cuts.append(f"""cut_{name} AS (
      SELECT b.station, b.id, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us, epoch_us(w.seam) AS seam_us,
             epoch_us(w.horizon) AS horizon_us, greatest(epoch_us(start_time), epoch_us(w.seam)) AS from_us,
             least(epoch_us(end_time), epoch_us(w.horizon)) AS to_us
      FROM {name} b JOIN windows w ON w.station = b.station WHERE start_time < w.horizon AND end_time > w.seam AND end_time > start_time),
      """ + spans_sql(f"cut_{name}").replace("scanned AS", f"scanned_{name} AS").replace("FROM scanned", f"FROM scanned_{name}").replace(
            "spans AS", f"spans_{name} AS"))
    return "WITH " + ",\n".join(cuts)


@query("new_findings", _two_spans() + """
    SELECT p.station, p.kind, p.start_us, p.end_us FROM spans_proposed p
    WHERE NOT EXISTS (SELECT 1 FROM spans_baseline b WHERE b.station = p.station AND b.kind = p.kind AND b.start_us = p.start_us AND b.end_us = p.end_us)""")
def _(t):
    return df_.new_findings(coverage_spans(t.baseline, t.windows), coverage_spans(t.proposed, t.windows))


@query("history_differences", """
    WITH a AS (SELECT * FROM baseline WHERE start_time < TIMESTAMP '2024-01-08 06:00:00'),
         b AS (SELECT * FROM proposed WHERE start_time < TIMESTAMP '2024-01-08 06:00:00')
    SELECT *, 'lost' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
    UNION ALL SELECT *, 'overlaps_seam' FROM a WHERE end_time > TIMESTAMP '2024-01-08 06:00:00'""")
def _(t):
    edge = "2024-01-08 06:00:00"
    return df_.history_differences(t.baseline, t.proposed, edge, edge)


@query("protected_differences", """
    WITH a AS (SELECT * FROM baseline WHERE station NOT IN ('view', 'click')), b AS (SELECT * FROM proposed WHERE station NOT IN ('view', 'click'))
    SELECT *, 'lost' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
    UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(t):
    affected = t.blocks.filter("station IN ('view', 'click')")
    return df_.protected_differences(t.baseline, t.proposed, affected)


@query("diff_snapshots", """
    WITH sk_b AS (SELECT path, 'hidden' AS reason FROM manifest_before WHERE mtime_ns % 7000 = 0),
    sk_a AS (SELECT path, CASE WHEN mtime_ns % 21000 = 0 THEN 'unsupported_extension' ELSE 'hidden' END AS reason FROM manifest_after WHERE mtime_ns % 7000 = 0)
    SELECT 'file' AS kind, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'missing' ELSE 'modified' END AS change,
           coalesce(a.path, b.path) AS item, NULL AS reason
    FROM manifest_before b FULL JOIN manifest_after a ON a.path = b.path
    WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size OR a.mtime_ns <> b.mtime_ns
    UNION ALL SELECT 'show', 'new', s, NULL FROM (SELECT split_part(path, '/', 1) AS s FROM manifest_after EXCEPT SELECT split_part(path, '/', 1) FROM manifest_before)
    UNION ALL SELECT 'show', 'missing', s, NULL FROM (SELECT split_part(path, '/', 1) AS s FROM manifest_before EXCEPT SELECT split_part(path, '/', 1) FROM manifest_after)
    UNION ALL SELECT 'skipped', 'newly_skipped', path, reason FROM (SELECT * FROM sk_a EXCEPT SELECT * FROM sk_b)
    UNION ALL SELECT 'skipped', 'no_longer_skipped', path, reason FROM (SELECT * FROM sk_b EXCEPT SELECT * FROM sk_a)""")
def _(t):
    before = t.manifest_before.filter("mtime_ns % 7000 = 0").select("path", F.lit("hidden").alias("reason"))
    reason = F.when(F.col("mtime_ns") % 21000 == 0, F.lit("unsupported_extension")).otherwise("hidden")
    after = t.manifest_after.filter("mtime_ns % 7000 = 0").select("path", reason.alias("reason"))
    return df_.diff_snapshots(t.manifest_before, t.manifest_after, before, after)


@query("cache_delta", """
    SELECT a.path, a.size, a.mtime_ns,
           CASE WHEN b.path IS NULL THEN 'insert' WHEN a.size <> b.size OR a.mtime_ns <> b.mtime_ns THEN 'update'
                WHEN b.mtime_ns % 5000 = 0 THEN 'refresh' ELSE 'unchanged' END AS action
    FROM manifest_after a LEFT JOIN manifest_before b ON b.path = a.path""")
def _(t):
    meta = t.manifest_before.withColumns({
        "meta": F.when(F.col("mtime_ns") % 5000 == 0, F.lit("")).otherwise("{}"),
        "media_type": F.when(F.col("mtime_ns") % 5000 == 0, F.lit("audio")).otherwise("video")})
    return df_.cache_delta(t.manifest_after, meta)


@query("stale_children", "SELECT path, size FROM manifest_before WHERE path NOT IN (SELECT path FROM manifest_after)")
def _(t):
    return df_.stale_children(t.manifest_before, t.manifest_after, ["path"]).select("path", "size")


@query("diff_records", """
    SELECT coalesce(a.path, b.path) AS path,
           CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed'
                WHEN a.size <> b.size OR a.mtime_ns <> b.mtime_ns THEN 'changed' ELSE 'same' END AS change
    FROM manifest_before b FULL JOIN manifest_after a ON a.path = b.path""")
def _(t):
    return diff_records(t.manifest_before, t.manifest_after, ["path"], ["size", "mtime_ns"])


#: Tag, name of the Spark type and SQL of the text of each kind of column.
_KINDS = {
    "i": ("bigint", "CAST({0} AS VARCHAR)"), "n": ("int", "CAST({0} AS VARCHAR)"), "t": ("string", "{0}"),
    "decimal": ("decimal(18,2)", "CAST(CAST({0} AS DECIMAL(18,2)) AS VARCHAR)"), "timestamp_ntz": ("timestamp_ntz", "CAST(epoch_us({0}) AS VARCHAR)")}


def _frame(name: str, kind: str) -> str:
    text = _KINDS[kind][1].format(name)
    return f"coalesce('{'i' if kind == 'n' else kind}' || length({text}) || ':' || {text}, 'n')"


def _print(table: str, columns: dict[str, str], label: str) -> str:
    text = " || ".join(_frame(c, columns[c]) for c in sorted(columns))
    layout = ",".join(f"{c}:{_KINDS[columns[c]][0]}" for c in sorted(columns))
    parts = " || ':' || ".join(
        f"coalesce(sum(CAST(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)), 0)" for i in range(4))
    return f"""SELECT '{label}' AS "table", '{layout}' AS columns, CAST(count(*) AS BIGINT) AS row_count,
        sha256(count(*) || ':' || {parts}) AS digest FROM (SELECT sha256({text}) AS d FROM {table})"""


_MANIFEST = {"path": "t", "size": "i", "mtime_ns": "i"}
_LINES = {"l_orderkey": "i", "l_partkey": "i", "l_suppkey": "i", "l_linenumber": "n", "l_quantity": "decimal", "l_extendedprice": "decimal",
          "l_discount": "decimal", "l_tax": "decimal", "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "timestamp_ntz"}


@query("fingerprint", _print("manifest_before", _MANIFEST, "manifest") + " UNION ALL " + _print("lineitem", _LINES, "lineitem"))
def _(t):
    """All columns of both tables. Amounts have two decimals and are read as such: the texts of doubles differ between engines."""
    lines = t.read("lineitem")
    exact = lines.withColumns({f.name: F.col(f.name).cast("decimal(18,2)") for f in lines.schema.fields if f.dataType.typeName() == "double"})
    return fp_.fingerprint(t.manifest_before, "manifest").unionByName(fp_.fingerprint(exact, "lineitem"))


@query("diff_fingerprints", """
    SELECT * FROM (VALUES ('manifest', 'changed', (SELECT count(*) FROM manifest_before), (SELECT count(*) FROM manifest_after), FALSE),
      ('orders', 'same', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders), TRUE),
      ('part', 'schema_changed', (SELECT count(*) FROM part), (SELECT count(*) FROM part), FALSE),
      ('region', 'removed', (SELECT count(*) FROM region), NULL, NULL), ('nation', 'added', NULL, (SELECT count(*) FROM nation), NULL))
      v("table", change, rows_before, rows_after, equal_digests)""")
def _(t):
    p = fp_.fingerprint
    before = [p(t.manifest_before, "manifest"), p(t.read("orders"), "orders"), p(t.read("part"), "part"), p(t.read("region"), "region")]
    after = [p(t.manifest_after, "manifest"), p(t.read("orders").orderBy("o_totalprice"), "orders"),
             p(t.read("part").drop("p_size"), "part"), p(t.read("nation"), "nation")]
    for more in (before, after):
        while len(more) > 1:
            more.append(more.pop(0).unionByName(more.pop(0)))
    found = fp_.diff_fingerprints(before[0], after[0])
    return found.select("table", "change", "rows_before", "rows_after", (F.col("digest_before") == F.col("digest_after")).alias("equal_digests"))


#: Line items of which some orders lose one line, some get it twice and some have another quantity.
_AFTER_LINES = """
    after AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 4001 = 7 THEN l_quantity + 1 ELSE l_quantity END::DECIMAL(18, 2) AS l_quantity
              FROM lineitem WHERE NOT (l_orderkey % 5003 = 9 AND l_linenumber = 1)
              UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DECIMAL(18, 2) FROM lineitem WHERE l_orderkey % 6007 = 11),
    before AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::DECIMAL(18, 2) AS l_quantity FROM lineitem),
    changed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, sum(n) AS n_all FROM (SELECT *, -1 AS n FROM before UNION ALL SELECT *, 1 FROM after) GROUP BY ALL)"""


def _two_versions(t):
    n, line = F.col("l_orderkey"), F.col("l_linenumber")
    before = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity"))
    more = F.when(n % 4001 == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).cast("decimal(18,2)")
    after = before.filter(~((n % 5003 == 9) & (line == 1))).withColumn("l_quantity", more).unionByName(before.filter(n % 6007 == 11))
    return before, after


def _stored_trees(t):
    before, after = _two_versions(t)
    folder = scratch(t)
    for name, df in (("before", before), ("after", after)):
        fp_.store_tree(df, f"{folder}/{name}", "l_orderkey", width=16, fanout=8)
    return before, after, fp_.changed_ranges(t.spark, f"{folder}/before", f"{folder}/after", width=16, fanout=8)


@query("changed_ranges", f"""WITH {_AFTER_LINES},
    b AS (SELECT l_orderkey // 16 AS node, count(*) AS n FROM before GROUP BY 1), a AS (SELECT l_orderkey // 16 AS node, count(*) AS n FROM after GROUP BY 1)
    SELECT c.node * 16 AS low_key, c.node * 16 + 15 AS high_key, coalesce(b.n, 0) AS rows_before, coalesce(a.n, 0) AS rows_after
    FROM (SELECT DISTINCT l_orderkey // 16 AS node FROM changed WHERE n_all <> 0) c LEFT JOIN a USING (node) LEFT JOIN b USING (node)""")
def _(t):
    """The ranges of order keys in which two versions of the line items differ, found by comparing two stored trees."""
    return _stored_trees(t)[2]


@query("changed_rows", f"""WITH {_AFTER_LINES}
    SELECT CASE WHEN n_all < 0 THEN 'lost' ELSE 'added' END AS change, abs(n_all)::BIGINT AS copies, l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_quantity::DOUBLE AS l_quantity FROM changed WHERE n_all <> 0""")
def _(t):
    """The rows of these ranges that one version has more often."""
    before, after, ranges = _stored_trees(t)
    found = fp_.changed_rows(before, after, ranges, "l_orderkey", width=16)
    return found.withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query("runs_match", "SELECT TRUE AS same_passed, FALSE AS other_passed, CAST((SELECT count(*) FROM manifest_before) AS BIGINT) AS rows_1")
def _(t):
    same = fp_.runs_match(t.manifest_before, t.manifest_before.orderBy("size")).select(
        F.col("passed").alias("same_passed"), "rows_1", F.lit(1).alias("k"))
    other = fp_.runs_match(t.manifest_before, t.manifest_after).select(F.col("passed").alias("other_passed"), F.lit(1).alias("k"))
    return same.join(other, "k").drop("k")


@query("changed_fields", """
    SELECT b.id, CASE WHEN b.id % 13 = 0 THEN 'title' ELSE '' END || CASE WHEN b.id % 13 = 0 AND b.id % 17 = 0 THEN ',' ELSE '' END
             || CASE WHEN b.id % 17 = 0 THEN 'end_time' ELSE '' END AS changed,
           CASE WHEN b.id % 13 = 0 THEN 'title' ELSE 'end_time' END AS first_path
    FROM baseline b JOIN proposed p ON p.id = b.id WHERE b.id % 13 = 0 OR b.id % 17 = 0""")
def _(t):
    found = df_.changed_fields(t.baseline, t.proposed, ["id"], ["title", "start_time", "end_time"])
    return found.withColumn("changed", F.array_join("changed", ","))


@query("changed_array_path", """
    SELECT id, 'plan/' || (id % 3) AS first_path FROM blocks WHERE id % 2 = 0""")
def _(t):
    def plan(mark):
        return F.array(*[F.struct(F.lit(i).alias("n"), F.when((F.col("id") % 3 == i) & (F.col("id") % 2 == 0), mark).otherwise("x").alias("path"))
                         for i in range(3)])

    before, after = (t.blocks.select("id", plan(F.lit(m)).alias("plan")) for m in ("a", "b"))
    return df_.changed_fields(before, after, ["id"], ["plan"]).select("id", "first_path")


_OLD = ("old AS (SELECT id, station, tag, path, title, duration FROM items WHERE id % 6 <> 0 "
        "UNION ALL SELECT id + 1000000, station, tag, path, title, duration FROM items WHERE id % 6 <> 0 AND id % 7 = 0)")


@query("reconcile_ids", f"""
    WITH {_OLD},
    new AS (SELECT station, tag, path, title, CASE WHEN id % 9 = 0 THEN duration + 1 ELSE duration END AS duration FROM items WHERE id % 10 <> 0),
    fresh AS (SELECT station, tag, path, count(*) AS n, min((title, duration)) AS x FROM new GROUP BY ALL),
    olds AS (SELECT *, (title, duration) AS x, id % 4 = 0 AS prot, count(*) OVER (PARTITION BY station, tag, path) AS held FROM old),
    j AS (SELECT coalesce(o.station, f.station) AS station, coalesce(o.tag, f.tag) AS tag, coalesce(o.path, f.path) AS path, o.id AS old_id,
            CASE WHEN f.n IS NULL THEN CASE WHEN o.prot THEN 'kept' END WHEN f.n > 1 THEN 'duplicate' WHEN o.held > 1 THEN 'ambiguous' WHEN o.x = f.x THEN 'reused'
                 WHEN o.prot THEN 'conflict' ELSE 'new' END AS disposition
          FROM olds o FULL JOIN fresh f ON f.station = o.station AND f.tag = o.tag AND f.path = o.path)
    SELECT station, tag, path, CASE WHEN disposition IN ('reused', 'kept') THEN old_id
             WHEN disposition = 'new' THEN 5000000 + row_number() OVER (PARTITION BY disposition ORDER BY station, tag, path) END AS id, disposition
    FROM (SELECT * FROM j WHERE disposition NOT IN ('ambiguous', 'duplicate', 'conflict')
          UNION SELECT station, tag, path, NULL, disposition FROM j WHERE disposition IN ('ambiguous', 'duplicate', 'conflict'))""")
def _(t):
    # of every seventh item an older copy, so some identities have two old rows
    again = t.parts_as_items.filter("id % 6 <> 0 AND id % 7 = 0").withColumn("id", F.col("id") + 1000000)
    old = t.parts_as_items.filter("id % 6 <> 0").unionByName(again)
    new = t.parts_as_items.filter("id % 10 <> 0").withColumn(
        "duration", F.when(F.col("id") % 9 == 0, F.col("duration") + 1).otherwise(F.col("duration")))
    protected = old.filter("id % 4 = 0").select("id")
    return df_.reconcile_ids(old, new, ["station", "tag", "path"], ["title", "duration"], protected, floor=5000000)


@query("classify_manifest", """
    SELECT source || '/' || CASE doc_id % 4 WHEN 0 THEN doc_id || '.mp4' WHEN 2 THEN doc_id || '.txt' WHEN 3 THEN '._' || doc_id || '.mp4' END AS path,
           CASE doc_id % 4 WHEN 0 THEN 'kept' WHEN 2 THEN 'unsupported_extension' WHEN 3 THEN 'hidden' END AS reason
    FROM documents WHERE doc_id % 4 <> 1
    UNION ALL SELECT DISTINCT source || '/.trash', 'hidden_directory' FROM documents WHERE doc_id % 4 = 1""")
def _(t):
    n, name = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    file = (F.when(n == 0, F.concat(name, F.lit(".mp4"))).when(n == 1, F.concat(F.lit(".trash/"), name, F.lit(".mp4")))
            .when(n == 2, F.concat(name, F.lit(".txt"))).otherwise(F.concat(F.lit("._"), name, F.lit(".mp4"))))
    listing = t.read("documents").select(F.concat("source", F.lit("/"), file).alias("path"))
    files, skipped = classify_manifest(listing)
    return files.select("path", F.lit("kept").alias("reason")).unionByName(skipped)
