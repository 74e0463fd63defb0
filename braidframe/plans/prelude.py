"""The graph tables as SQL over the relational tables, the common part of every oracle."""

SUPPLY = r"""
nodes AS (SELECT p_partkey + 1 AS node_id, p_name AS seq, length(p_name)::BIGINT AS len, p_partkey + 1 AS node_rank FROM part),
lines AS (SELECT * FROM lineitem),
steps AS (SELECT l_orderkey AS path_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1)::BIGINT AS step_rank,
  l_partkey + 1 AS node_id, l_returnflag = 'R' AS is_rev FROM lines),
paths AS (SELECT o_orderkey AS path_id, n_name || '#' || c_custkey || '#' || o_orderkey AS path_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
trans AS (SELECT * FROM (SELECT path_id, step_rank, node_id AS src, is_rev AS src_rev, lead(node_id) OVER w AS dst, lead(is_rev) OVER w AS dst_rev FROM steps WINDOW w AS (PARTITION BY path_id ORDER BY step_rank)) WHERE dst IS NOT NULL),
ctrans AS (SELECT *, (src, src_rev, dst, dst_rev) <= (dst, NOT dst_rev, src, NOT src_rev) AS fwd FROM trans),
edges AS (SELECT DISTINCT CASE WHEN fwd THEN src ELSE dst END AS from_id, CASE WHEN fwd THEN src_rev ELSE NOT dst_rev END AS from_rev, CASE WHEN fwd THEN dst ELSE src END AS to_id, CASE WHEN fwd THEN dst_rev ELSE NOT src_rev END AS to_rev FROM ctrans),
adj AS (SELECT from_id AS src, from_rev AS src_rev, to_id AS dst, to_rev AS dst_rev FROM edges UNION ALL SELECT to_id, NOT to_rev, from_id, NOT from_rev FROM edges WHERE NOT (from_id = to_id AND from_rev = to_rev IS FALSE AND from_rev <> to_rev)),
pos AS (SELECT path_id, step_rank, node_id, is_rev, len, step_start::BIGINT AS step_start, (step_start + len)::BIGINT AS step_end FROM (SELECT s.*, n.len, coalesce(sum(n.len) OVER (PARTITION BY path_id ORDER BY step_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step_start FROM steps s JOIN nodes n USING (node_id))),
plen AS (SELECT path_id, count(*) AS n_steps, sum(len)::BIGINT AS path_len FROM steps JOIN nodes USING (node_id) GROUP BY path_id),
pan AS (SELECT *, coalesce(sum(len) OVER (ORDER BY node_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pan_start FROM nodes),
depth AS (SELECT n.node_id, count(s.path_id)::BIGINT AS depth, count(DISTINCT s.path_id)::BIGINT AS depth_uniq FROM nodes n LEFT JOIN steps s USING (node_id) GROUP BY n.node_id),
degree AS (SELECT n.node_id, count(a.src)::BIGINT AS degree, count(a.src) FILTER (WHERE a.src_rev)::BIGINT AS degree_in, count(a.src) FILTER (WHERE NOT a.src_rev)::BIGINT AS degree_out FROM nodes n LEFT JOIN adj a ON a.src = n.node_id GROUP BY n.node_id),
visits AS (SELECT node_id, split_part(path_name, '#', 1) AS sample, count(*) AS cnt FROM steps JOIN paths USING (path_id) GROUP BY ALL),
ranges0 AS (SELECT o_orderkey AS path_id, o_orderkey % 10 AS start, o_orderkey % 10 + 15 AS "end", 'r' || o_orderkey AS name FROM orders),
ranges AS (SELECT r.path_id, start, least("end", path_len) AS "end", name FROM ranges0 r JOIN plen USING (path_id) WHERE start < least("end", path_len))
"""
SUPPLY = SUPPLY.replace("NOT (from_id = to_id AND from_rev = to_rev IS FALSE AND from_rev <> to_rev)", "NOT (from_id = to_id AND from_rev <> to_rev)")


_BODY = SUPPLY[SUPPLY.index("paths AS") :]
#: The same tables over what customers have from suppliers.
ACCOUNT = r"""
lines AS (SELECT *, o_custkey * 1000000 + l_suppkey + 1 AS node_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nodes AS (SELECT node_id, seq, length(seq)::BIGINT AS len, node_id AS node_rank FROM (SELECT DISTINCT node_id, translate('1' || l_suppkey, '0123456789', 'ACGTACGTAC') AS seq FROM lines)),
steps AS (SELECT l_orderkey AS path_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1)::BIGINT AS step_rank,
  node_id, l_returnflag = 'R' AS is_rev FROM lines),
""" + _BODY


def supply(query: str) -> str:
    """``query`` after the supply graph's common tables; ``query`` may begin with ``, more AS (...)``."""
    return f"WITH RECURSIVE {SUPPLY} {query.strip()}"


def account(query: str) -> str:
    """The same over the account graph."""
    return f"WITH RECURSIVE {ACCOUNT} {query.strip()}"
