"""Registered queries over the ring graph, in which flows run in circles: components, cycles, and flows without paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, flows
from .adapter import ring_graph, ring_sql
from .catalogue import query
from .fixpoint import cut

RING = "WITH RECURSIVE " + ring_sql()
_REACH = """, reach AS (
    SELECT DISTINCT src AS a, dst AS b FROM ring_hops UNION SELECT r.a, h.dst FROM reach r JOIN ring_hops h ON h.src = r.b
), ends AS (SELECT src AS node FROM ring_hops UNION SELECT dst FROM ring_hops)"""
#: Where a flow can come without an entry: of all entries that it reaches, each avoided in turn, however far they are.
_TAKEN = """, found AS (
    SELECT flow_id, id AS entry_id, repo, id AS origin FROM ring_origins UNION SELECT f.flow_id, h.dst, h.dst_repo, f.origin FROM found f JOIN ring_hops h ON h.src = f.entry_id
), levels AS (
    SELECT flow_id, id AS entry_id, 0 AS depth FROM ring_origins UNION SELECT l.flow_id, h.dst, l.depth + 1 FROM levels l JOIN ring_hops h ON h.src = l.entry_id WHERE l.depth < 40
), entries AS (
    SELECT f.flow_id, f.entry_id, f.repo, min(l.depth) AS depth FROM found f JOIN levels l USING (flow_id, entry_id) GROUP BY ALL
), free AS (
    SELECT DISTINCT f.flow_id, f.entry_id AS avoid, f.origin AS entry_id FROM found f WHERE f.entry_id <> f.origin
    UNION SELECT f.flow_id, f.avoid, h.dst FROM free f JOIN ring_hops h ON h.src = f.entry_id WHERE h.dst <> f.avoid
), taken AS (
    SELECT f.flow_id, h.* FROM free f JOIN ring_hops h ON h.src = f.entry_id AND h.dst = f.avoid
)"""


@query(RING + _REACH + " SELECT node, least(node, coalesce(min(CASE WHEN y.a IS NOT NULL THEN x.b END), node)) AS component FROM ends LEFT JOIN reach x ON x.a = node LEFT JOIN reach y ON y.a = x.b AND y.b = node GROUP BY node")
def ring_components(spark, d):
    return components.strong_components(ring_graph(spark, d)[1])


@query(
    RING
    + """, walk AS (
    SELECT src AS start, dst AS cur, [src, dst] AS path FROM (SELECT DISTINCT src, dst FROM ring_hops) WHERE dst > src
    UNION ALL SELECT w.start, p.dst, list_append(w.path, p.dst) FROM walk w JOIN (SELECT DISTINCT src, dst FROM ring_hops) p ON p.src = w.cur
    WHERE w.cur <> w.start AND (p.dst = w.start OR p.dst > w.start AND NOT list_contains(w.path, p.dst))
) SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS length FROM walk WHERE cur = start"""
)
def ring_cycles(spark, d):
    return components.elementary_cycles(ring_graph(spark, d)[1]).withColumn("path", F.array_join("path", ">"))


def _flows(spark, d):
    origins, hops = ring_graph(spark, d)
    entries = cut(flows.flow_entries(origins, hops))
    return entries, flows.hops_taken(entries, hops)


@query(RING + _TAKEN + " SELECT flow_id, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, count(DISTINCT repo) AS repo_count, count(*) AS n_entries, count(DISTINCT repo) > 1 AS has_cross_repo, flow_id IN (SELECT flow_id FROM taken WHERE kind = 'http') AS has_sync FROM entries GROUP BY flow_id")
def ring_flow_metrics(spark, d):
    return flows.reach_metrics(*_flows(spark, d))


@query(RING + _TAKEN + " SELECT flow_id, repo, CAST(min(depth) AS INTEGER) AS depth, count(*) AS n_entries FROM entries GROUP BY flow_id, repo")
def ring_flow_nodes(spark, d):
    return flows.repo_nodes(flows.flow_entries(*ring_graph(spark, d)))


@query(RING + _TAKEN + " SELECT DISTINCT flow_id, src_repo AS src, dst_repo AS dst, channel, kind FROM taken UNION SELECT flow_id, dst_repo, src_repo, channel, 'http-response' FROM taken WHERE kind = 'http' AND response_type <> ''")
def ring_flow_edges(spark, d):
    return flows.repo_edges(_flows(spark, d)[1])


@query(RING + _TAKEN + " SELECT DISTINCT flow_id, channel, kind, dst_repo AS target_repo FROM taken WHERE src_repo = 'R1'")
def ring_flow_downstream(spark, d):
    return flows.downstream(_flows(spark, d)[1], "R1")
