"""Queries of synthetic groups and hold-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import groups as G
from marquee.operators.matrix import cosine_pairs
from marquee.plans.registry import Book
from marquee.plans.relational_queries import _COS
from marquee.session import table
from marquee.sources import views as V
from marquee.sources.views import GROUPS, RATINGS

book = Book()
add = book.add
TS, TO = 0.26, -0.12
SIM = f"(SELECT a, b FROM {_COS} WHERE round(sim, 6) >= {TS})"
OPP = f"(SELECT a, b FROM {_COS} WHERE round(sim, 6) <= {TO})"


def pairs(s, d):
    return cosine_pairs(table(s, d, "embeddings"), "vec_id", "embedding").withColumn("sim", F.round("sim", 6))


def _members(df):
    return df.select("group_id", *[F.col("members")[i].alias(f"m{i + 1}") for i in range(3)])


def _triangle_sql(e):
    return f"SELECT group_id, group_id AS m1, b AS m2, c AS m3 FROM (SELECT ab.a AS group_id, ab.b, bc.b AS c, row_number() OVER (PARTITION BY ab.a ORDER BY ab.b, bc.b) AS i FROM {e} ab JOIN {e} bc ON bc.a = ab.b JOIN {e} ac ON ac.a = ab.a AND ac.b = bc.b) WHERE i = 1"


@add("grp1_thresholds", f"SELECT round(quantile_cont(sim, 0.75), 4) AS ts, round(quantile_cont(sim, 0.25), 4) AS to_ FROM {_COS} WHERE (a * 40503 + b) % 10 < 5")
def _(s, d):
    q = pairs(s, d).where("(a * 40503 + b) % 10 < 5").agg(F.expr("percentile(sim, array(0.75, 0.25))").alias("q"))
    return q.select(F.round(F.col("q")[0], 4).alias("ts"), F.round(F.col("q")[1], 4).alias("to_"))


@add("grp2_random_groups")
def _(s, d):
    return _members(G.random_groups(V.ratings(s, d), 200))


@add("grp2_restricted_groups", f"SELECT group_id, members[1] AS m1, members[2] AS m2, members[3] AS m3 FROM {GROUPS} WHERE group_id IN (SELECT group_id FROM (SELECT g.group_id, r.item_id FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2 HAVING count(*) = 3) GROUP BY 1 HAVING count(*) >= 3)")
def _(s, d):
    rated = V.ratings(s, d)
    return _members(G.restricted(V.groups(rated), rated, 3))


@add("grp3_similar_groups", _triangle_sql(SIM))
def _(s, d):
    return _members(G.similar_groups(pairs(s, d), TS))


@add("grp4_outlier_groups", f"WITH far AS (SELECT a AS x, b AS o FROM {OPP} UNION ALL SELECT b, a FROM {OPP}) SELECT group_id, group_id AS m1, b AS m2, o AS m3 FROM (SELECT s.a AS group_id, s.b, f.o, row_number() OVER (PARTITION BY s.a ORDER BY s.b, (f.o * 40503) % 1000003, f.o) AS i FROM {SIM} s JOIN far f ON f.x = s.a JOIN far g ON g.x = s.b AND g.o = f.o) WHERE i = 1")
def _(s, d):
    return _members(G.outlier_groups(pairs(s, d), TS, TO))


@add("grp5_divergent_groups", _triangle_sql(OPP))
def _(s, d):
    return _members(G.divergent_groups(pairs(s, d), TO))


@add("grp6_variance_groups", f"SELECT group_id, round(avg(v), 4) AS variance FROM (SELECT g.group_id, r.item_id, var_pop(r.rating) AS v FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2 HAVING count(*) = 3) GROUP BY 1 HAVING avg(v) >= 0.3")
def _(s, d):
    rated = V.ratings(s, d)
    return G.variance_groups(V.groups(rated), rated, 0.3).select("group_id", F.round("variance", 4).alias("variance"))


@add("grp7_split_groups", f"SELECT group_id, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part FROM (SELECT group_id, row_number() OVER (ORDER BY (group_id * 2654435761 + 42) % 1000003, group_id) AS i, count(*) OVER () AS n FROM {GROUPS})")
def _(s, d):
    return G.split_groups(V.groups(V.ratings(s, d)))


# Groups that mostly break the rules: three vectors with ids in a row.
_TRIPLES = "(SELECT vec_id // 3 AS group_id, list(vec_id ORDER BY vec_id) AS members FROM embeddings GROUP BY 1 HAVING count(*) = 3)"
_TRIPLE_SIMS = f"(SELECT x.group_id, x.m AS a, y.m AS b, round(c.sim, 6) AS sim FROM (SELECT group_id, unnest(members) AS m FROM {_TRIPLES}) x JOIN (SELECT group_id, unnest(members) AS m FROM {_TRIPLES}) y ON x.group_id = y.group_id AND x.m < y.m LEFT JOIN {_COS} c ON c.a = x.m AND c.b = y.m)"


def triples(s, d):
    listed = table(s, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).alias("group_id")).agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    return listed.where(F.size("members") == 3)


@add("grp8_invalid_groups", f"""WITH s AS MATERIALIZED {_TRIPLE_SIMS} SELECT DISTINCT 'similar' AS rule, group_id FROM s WHERE sim IS NULL OR sim < 0.05 UNION ALL SELECT DISTINCT 'divergent', group_id FROM s WHERE sim IS NULL OR sim > 0.05
    UNION ALL SELECT DISTINCT 'outlier', group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY sim DESC NULLS LAST, a, b) AS i FROM s) WHERE sim IS NULL OR (i = 1 AND sim < 0.05) OR (i > 1 AND sim > 0.05)""")
def _(s, d):
    p, g = pairs(s, d), triples(s, d)
    found = {"similar": G.validate_pairs(g, p, low=0.05), "divergent": G.validate_pairs(g, p, high=0.05), "outlier": G.validate_outliers(g, p, 0.05, 0.05)}
    rows = [f.select(F.lit(k).alias("rule"), "group_id") for k, f in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@add("grp8_invalid_members", f"""WITH n AS (SELECT user_id, count(*) AS n FROM {RATINGS} GROUP BY 1), g AS (SELECT group_id, members FROM {GROUPS} UNION ALL SELECT group_id + 1000000, CASE WHEN group_id % 2 = 0 THEN [members[1], members[1], members[2]] ELSE list_reverse(members) END FROM {GROUPS} WHERE group_id % 5 = 0)
    SELECT DISTINCT group_id FROM (SELECT group_id FROM (SELECT group_id, unnest(members) AS user_id FROM g) LEFT JOIN n USING (user_id) WHERE coalesce(n.n, 0) < 5 UNION ALL SELECT group_id FROM g WHERE len(list_distinct(members)) < len(members)
    UNION ALL SELECT a.group_id FROM g a JOIN g b ON list_sort(a.members) = list_sort(b.members) AND b.group_id < a.group_id)""")
def _(s, d):
    rated = V.ratings(s, d)
    groups = V.groups(rated)
    m = F.col("members")
    planted = groups.where("group_id % 5 = 0").select((F.col("group_id") + 1000000).alias("group_id"), F.when(F.col("group_id") % 2 == 0, F.array(m[0], m[0], m[1])).otherwise(F.reverse(m)).alias("members"))
    return G.validate_members(groups.unionByName(planted), rated, 5)


@add("set4_common_items", f"WITH r AS MATERIALIZED (SELECT user_id, item_id FROM {RATINGS}), g AS {GROUPS} SELECT g.group_id, a.item_id FROM g JOIN r a ON a.user_id = members[1] JOIN r b ON b.user_id = members[2] AND b.item_id = a.item_id JOIN r c ON c.user_id = members[3] AND c.item_id = a.item_id")
def _(s, d):
    from marquee.operators.matrix import common_items

    rated = V.ratings(s, d)
    return common_items(V.groups(rated), rated)


@add("set5_disjoint_groups")
def _(s, d):
    return _members(G.disjoint_groups(G.similar_groups(pairs(s, d), TS)))


@add("gth1_common_counts", f"SELECT group_id, count(*) AS n FROM (SELECT g.group_id, r.item_id FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2 HAVING count(*) = 3) GROUP BY 1")
def _(s, d):
    from marquee.operators.matrix import common_items

    rated = V.ratings(s, d)
    return common_items(V.groups(rated), rated).groupBy("group_id").agg(F.count("*").alias("n"))


_CAP = f"""r AS MATERIALIZED (SELECT user_id, item_id FROM {RATINGS}), g AS MATERIALIZED (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}), cap AS (SELECT user_id, CAST(ceil(count(*) * 0.5) AS BIGINT) AS cap, count(*) AS n FROM r GROUP BY 1),
    gc AS (SELECT group_id, min(cap) AS cap FROM g JOIN cap USING (user_id) GROUP BY 1), c AS (SELECT group_id, item_id FROM g JOIN r USING (user_id) GROUP BY 1, 2 HAVING count(*) = 3),
    k0 AS (SELECT group_id, item_id FROM (SELECT c.*, gc.cap, row_number() OVER (PARTITION BY group_id ORDER BY (group_id * 2654435761 + item_id * 40503 + 42) % 1000003, item_id) AS i FROM c JOIN gc USING (group_id)) WHERE i <= cap),
    bad AS (SELECT DISTINCT group_id FROM g WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id, item_id FROM g JOIN k0 USING (group_id)) JOIN cap USING (user_id) GROUP BY user_id, cap HAVING count(*) > cap)), k AS (SELECT * FROM k0 WHERE group_id NOT IN (SELECT group_id FROM bad))"""


@add("gth2_capacity_filter", f"WITH {_CAP} SELECT group_id, item_id FROM k")
def _(s, d):
    rated = V.ratings(s, d)
    return G.capacity_filter(V.groups(rated), rated)[1]


_TRUTH = f"""{_CAP}, gm AS (SELECT * FROM g WHERE group_id NOT IN (SELECT group_id FROM bad)), req AS (SELECT DISTINCT user_id, item_id FROM gm JOIN k USING (group_id)),
    t AS (SELECT user_id, item_id FROM (SELECT r.user_id, r.item_id, cap.cap, row_number() OVER (PARTITION BY r.user_id ORDER BY CASE WHEN req.item_id IS NULL THEN 1 ELSE 0 END, (r.user_id * 2654435761 + r.item_id * 40503 + 42) % 1000003, r.item_id) AS i FROM r JOIN cap USING (user_id) LEFT JOIN req ON req.user_id = r.user_id AND req.item_id = r.item_id WHERE r.user_id IN (SELECT user_id FROM gm)) WHERE i <= cap)"""


@add("gth3_user_truth", f"WITH {_TRUTH} SELECT user_id, item_id FROM t")
def _(s, d):
    rated = V.ratings(s, d)
    return G.hold_out(V.groups(rated), rated)[2]


@add("gth4_hold_out", f"WITH {_TRUTH} SELECT user_id, item_id FROM r WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM t)")
def _(s, d):
    rated = V.ratings(s, d)
    return G.hold_out(V.groups(rated), rated)[0].select("user_id", "item_id")


@add("gth5_without_common", f"WITH {_CAP} SELECT user_id, item_id FROM r WHERE (user_id, item_id) NOT IN (SELECT g.user_id, c.item_id FROM g JOIN c USING (group_id))")
def _(s, d):
    rated = V.ratings(s, d)
    return G.without_common(V.groups(rated), rated).select("user_id", "item_id")


@add("gth6_context")
def _(s, d):
    rated = V.ratings(s, d)
    return G.evaluation_context(rated, V.groups(rated), "train", 3, 5)[2]


QUERIES, ORACLE = book.queries, book.sql
