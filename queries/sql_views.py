"""The same views as views.py, as SQL common table expressions for the checking engine."""

from __future__ import annotations

import re

VIEWS = {
    "blocks": """
        SELECT event_id AS id, event_type AS station, event_type AS title, user_id AS content_id,
               ts AS start_time,
               ts + to_microseconds(CAST(round(value * 100) AS BIGINT) * 200000) AS end_time
        FROM events""",
    "blocks_by_user": """
        SELECT id, CAST(content_id AS VARCHAR) AS station, title, content_id, start_time, end_time FROM blocks""",
    "baseline": "SELECT * FROM blocks WHERE id % 7 <> 0",
    "proposed": """
        SELECT id, station, CASE WHEN id % 13 = 0 THEN title || ' (new)' ELSE title END AS title, content_id,
               start_time, CASE WHEN id % 17 = 0 THEN end_time + INTERVAL 1 MINUTE ELSE end_time END AS end_time
        FROM blocks WHERE id % 11 <> 0""",
    "windows": """
        SELECT DISTINCT station, TIMESTAMP '2024-01-05 00:00:00' AS seam,
               TIMESTAMP '2024-01-25 00:00:00' AS horizon FROM blocks""",
    "windows_by_user": """
        SELECT DISTINCT station, TIMESTAMP '2024-01-05 00:00:00' AS seam,
               TIMESTAMP '2024-01-25 00:00:00' AS horizon FROM blocks_by_user""",
    "items": """
        SELECT p_partkey AS id, p_brand AS station, p_type AS tag, p_name AS title,
               p_brand || '/' || p_type || '/' || p_name || ' s' || p_size || 'e' || (p_partkey % 20) || '.mp4' AS path,
               CAST(p_size * 60 AS DOUBLE) AS duration
        FROM part""",
    "catalog": """
        SELECT i.*, coalesce(c.n, 0) AS count
        FROM items i LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_partkey = i.id""",
    "plays": """
        SELECT i.station, i.path, l.l_shipdate AS ts, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
        FROM lineitem l JOIN items i ON i.id = l.l_partkey""",
    "plan_entries": """
        SELECT l_orderkey AS block_id, l_linenumber, l_partkey, l_suppkey, l_quantity * 10 AS duration FROM lineitem""",
    "plan_blocks": """
        SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS station, o_orderpriority AS title,
               o_orderdate AS start_time,
               o_orderdate + to_microseconds(CAST(s.seconds * 1000000 AS BIGINT)) AS end_time, s.seconds
        FROM orders JOIN (SELECT block_id, sum(duration) AS seconds FROM plan_entries GROUP BY 1) s
          ON s.block_id = o_orderkey""",
    "manifest": """
        SELECT doc_id, source || '/' || lang || '/' || doc_id || '.mp4' AS path, n_chars AS size,
               doc_id * 1000 AS mtime_ns FROM documents""",
    "manifest_before": "SELECT path, size, mtime_ns FROM manifest WHERE doc_id % 9 <> 0",
    "manifest_after": """
        SELECT path, CASE WHEN doc_id % 6 = 0 THEN size + 1 ELSE size END AS size, mtime_ns
        FROM manifest WHERE doc_id % 10 <> 0""",
    "cut": """
        SELECT b.station, b.id, epoch_us(start_time) AS start_us, epoch_us(end_time) AS end_us,
               epoch_us(w.seam) AS seam_us, epoch_us(w.horizon) AS horizon_us,
               greatest(epoch_us(start_time), epoch_us(w.seam)) AS from_us,
               least(epoch_us(end_time), epoch_us(w.horizon)) AS to_us
        FROM blocks b JOIN windows w ON w.station = b.station
        WHERE start_time < w.horizon AND end_time > w.seam AND end_time > start_time""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name, body in VIEWS.items():
        if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def with_views(sql: str) -> str:
    """Prefix a statement with the views it names, in dependency order."""
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
