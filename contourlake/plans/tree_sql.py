"""SQL of the trees: what the tree operators compute, written for an engine that shares nothing with them.

Ranks are places in the order of (f, id). ``levels`` labels, for every rank, the components of what lies above and below it. ``peel`` takes one leaf of the two merge trees at a time, the least. Values on the
test tables are distinct, so there are no plateaus to chain.
"""

from __future__ import annotations


def levels(tag: str, ra: str) -> str:
    """CTEs ``above{tag}`` and ``below{tag}`` (t, l, oldest): the component of last place l hangs on t. ``ra``: a query of (a, b) ranks, both directions. Labels sink until none does."""
    return f"""ra{tag} AS ({ra}),
up{tag}(t, u, l) USING KEY (t, u) AS (SELECT a.r, b.r, b.r FROM rk a JOIN rk b ON b.r > a.r UNION
  SELECT x.t, e.b, min(x.l) FROM up{tag} x JOIN ra{tag} e ON e.a = x.u AND e.b > x.t JOIN recurring.up{tag} y ON y.t = x.t AND y.u = e.b WHERE y.l > x.l GROUP BY x.t, e.b),
down{tag}(t, u, l) USING KEY (t, u) AS (SELECT a.r, b.r, b.r FROM rk a JOIN rk b ON b.r < a.r UNION
  SELECT x.t, e.b, max(x.l) FROM down{tag} x JOIN ra{tag} e ON e.a = x.u AND e.b < x.t JOIN recurring.down{tag} y ON y.t = x.t AND y.u = e.b WHERE y.l < x.l GROUP BY x.t, e.b),
above{tag} AS (SELECT t, l, max(u) AS oldest FROM up{tag} WHERE (t, l) IN (SELECT o.t, o.l FROM up{tag} o JOIN ra{tag} e ON e.a = o.t AND e.b = o.u) GROUP BY t, l),
below{tag} AS (SELECT t, l, min(u) AS oldest FROM down{tag} WHERE (t, l) IN (SELECT o.t, o.l FROM down{tag} o JOIN ra{tag} e ON e.a = o.t AND e.b = o.u) GROUP BY t, l)"""


def falls(tag: str) -> str:
    """CTE ``falls{tag}`` (t, young, old, sweep): by the elder rule, old null for the oldest."""
    return f"""falls{tag} AS (SELECT t, oldest AS young, lead(oldest) OVER (PARTITION BY t ORDER BY oldest) AS old, 'down' AS sweep FROM above{tag}
  UNION ALL SELECT t, oldest, lead(oldest) OVER (PARTITION BY t ORDER BY oldest DESC), 'up' FROM below{tag})"""


def peel(tag: str) -> str:
    """CTE ``arcs{tag}`` (lo, hi) in ranks."""
    return f"""peel{tag}(step, r, pj, ps, lo, hi) AS (
  SELECT 0, rk.r, a.t, b.t, NULL::BIGINT, NULL::BIGINT FROM rk LEFT JOIN above{tag} a ON a.l = rk.r LEFT JOIN below{tag} b ON b.l = rk.r
  UNION ALL
  SELECT p.step + 1, p.r, CASE WHEN p.pj = x.r THEN x.pj ELSE p.pj END, CASE WHEN p.ps = x.r THEN x.ps ELSE p.ps END, CASE WHEN x.upper THEN x.pj ELSE x.r END, CASE WHEN x.upper THEN x.r ELSE x.ps END
  FROM peel{tag} p, (SELECT q.r, q.pj, q.ps, j.c IS NULL AS upper FROM peel{tag} q LEFT JOIN (SELECT pj, count(*) AS c FROM peel{tag} GROUP BY pj) j ON j.pj = q.r LEFT JOIN (SELECT ps, count(*) AS c FROM peel{tag} GROUP BY ps) s ON s.ps = q.r
    WHERE coalesce(j.c, 0) + coalesce(s.c, 0) = 1 ORDER BY q.r LIMIT 1) x WHERE p.r <> x.r),
arcs{tag} AS (SELECT DISTINCT lo, hi FROM peel{tag} WHERE step > 0)"""


def contract(tag: str) -> str:
    """CTEs ``kinds{tag}`` (r, up, down, node_class) and ``crit{tag}`` (edge_id, n1, n2, members) in ranks."""
    return f"""kinds{tag} AS (SELECT r, sum(u)::BIGINT AS up, sum(d)::BIGINT AS down, CASE WHEN sum(u) = 1 AND sum(d) = 1 THEN 'ordinary' WHEN sum(u) = 0 AND sum(d) = 1 THEN 'max' WHEN sum(d) = 0 AND sum(u) = 1 THEN 'min'
  WHEN sum(u) = 0 OR sum(d) = 0 THEN 'other' WHEN sum(d) = 1 THEN 'branch_up' WHEN sum(u) = 1 THEN 'branch_down' ELSE 'multibranch' END AS node_class
  FROM (SELECT lo AS r, 1 AS u, 0 AS d FROM arcs{tag} UNION ALL SELECT hi, 0, 1 FROM arcs{tag}) GROUP BY r),
walk{tag}(n1, v, members) AS (SELECT lo, hi, [lo, hi] FROM arcs{tag} JOIN kinds{tag} k ON k.r = lo WHERE k.node_class <> 'ordinary'
  UNION ALL SELECT w.n1, a.hi, list_append(w.members, a.hi) FROM walk{tag} w JOIN kinds{tag} k ON k.r = w.v JOIN arcs{tag} a ON a.lo = w.v WHERE k.node_class = 'ordinary'),
crit{tag} AS (SELECT (row_number() OVER (ORDER BY n1, v) - 1)::INT AS edge_id, n1, v AS n2, members FROM walk{tag} w JOIN kinds{tag} k ON k.r = w.v WHERE k.node_class <> 'ordinary')"""


def trees(knn: str, tau: float | None = None) -> str:
    """Everything up to ``arcs``, ``kinds`` and ``crit`` of the tree, simplified below tau if that is given; ``knn`` ends in f(v, f) and adj(v, w)."""
    start = f"WITH RECURSIVE {knn}, rk AS (SELECT v, f, (row_number() OVER (ORDER BY f, v))::BIGINT AS r FROM f), "
    start += levels("_1", "SELECT a.r AS a, b.r AS b FROM adj JOIN rk a ON a.v = adj.v JOIN rk b ON b.v = adj.w")
    if tau is None:
        return start + ", " + peel("_1") + ", arcs AS (SELECT * FROM arcs_1), " + contract("")
    # A contour tree has the merge trees of its domain, so its pairs are the domain's, and the shortcuts may join the domain instead of the tree.
    start += ", " + falls("_1")
    start += f""", short AS (SELECT young, old FROM falls_1 JOIN rk y ON y.r = young JOIN rk s ON s.r = t WHERE old IS NOT NULL AND abs(y.f - s.f)::DOUBLE < {tau}), """
    start += levels("_3", "SELECT * FROM ra_1 UNION SELECT young, old FROM short UNION SELECT old, young FROM short") + ", " + peel("_3")
    return start + ", arcs AS (SELECT * FROM arcs_3), " + contract("")


def contour_tree(knn: str) -> str:
    return trees(knn) + " SELECT 'all' AS key, a.v AS lo, b.v AS hi FROM arcs JOIN rk a ON a.r = lo JOIN rk b ON b.r = hi"


def node_classes(knn: str) -> str:
    return trees(knn) + " SELECT 'all' AS key, v, up, down, node_class FROM kinds JOIN rk USING (r)"



def critical_tree(knn: str, tau: float | None = None) -> str:
    """Members as text, in rising order of the function."""
    return trees(knn, tau) + """, inside AS (SELECT edge_id, unnest(members) AS r FROM crit), texts AS (SELECT edge_id, string_agg(v, ',' ORDER BY inside.r) AS members FROM inside JOIN rk USING (r) GROUP BY 1)
SELECT 'all' AS key, edge_id, a.v AS n1, b.v AS n2, texts.members FROM crit JOIN rk a ON a.r = n1 JOIN rk b ON b.r = n2 JOIN texts USING (edge_id)"""


def members(knn: str, tau: float) -> str:
    """CTE ``inside`` (edge_id, v) behind :func:`trees`."""
    return trees(knn, tau) + ", inside AS (SELECT edge_id, rk.v FROM (SELECT edge_id, unnest(members) AS r FROM crit) JOIN rk USING (r))"


def merge_tree(knn: str) -> str:
    """CTE ``tree`` (v, parent): the join tree."""
    start = f"WITH RECURSIVE {knn}, rk AS (SELECT v, f, (row_number() OVER (ORDER BY f, v))::BIGINT AS r FROM f), "
    return start + levels("_1", "SELECT a.r AS a, b.r AS b FROM adj JOIN rk a ON a.v = adj.v JOIN rk b ON b.v = adj.w") + ", tree AS (SELECT rk.v, p.v AS parent FROM rk LEFT JOIN above_1 ON above_1.l = rk.r LEFT JOIN rk p ON p.r = above_1.t)"


def pair_values(knn: str) -> str:
    """CTE ``pairs`` (f): the persistence of all pairs."""
    start = f"WITH RECURSIVE {knn}, rk AS (SELECT v, f, (row_number() OVER (ORDER BY f, v))::BIGINT AS r FROM f), "
    start += levels("_1", "SELECT a.r AS a, b.r AS b FROM adj JOIN rk a ON a.v = adj.v JOIN rk b ON b.v = adj.w") + ", " + falls("_1")
    return start + ", pairs AS (SELECT abs(y.f - s.f)::DOUBLE AS f FROM falls_1 JOIN rk y ON y.r = young JOIN rk s ON s.r = t WHERE old IS NOT NULL)"
