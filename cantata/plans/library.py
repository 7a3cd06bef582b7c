"""Catalog operators: lookups, imports, packages, selections, edits and policies."""

Q = {}

Q["list_page"] = ([], ["orders"], "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 101")
Q["point_lookup"] = ([], ["customer"], "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
Q["package_catalog"] = ([], ["part"], """
    SELECT p_partkey, CASE WHEN p_name IS NULL THEN 'invalid' WHEN p_size > 40 THEN 'no_adapter' WHEN n > 1 THEN 'duplicate' ELSE 'valid' END AS state FROM (SELECT p_partkey, p_name, p_size, count(*) OVER (PARTITION BY p_name) AS n FROM part) x""")
Q["selection_fallback"] = ([], ["customer"], """
    SELECT c.c_custkey, coalesce(c.wanted, c.saved, 'default') AS chosen, CASE WHEN c.wanted IS NOT NULL THEN 'request' WHEN c.saved IS NOT NULL THEN 'selection' WHEN c.c_acctbal < 0 THEN 'default_fallback' ELSE 'default' END AS origin
    FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS wanted, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS saved FROM customer) c""")
Q["migrate_document"] = ([], ["part"], """
    SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'unsupported' ELSE 'ok' END AS status, CASE WHEN p_size % 3 = 0 THEN coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, 'unknown') WHEN p_size % 3 = 1 THEN p_type END AS kind FROM part""")
Q["build_policy"] = ([], ["part"], "SELECT p_partkey, lower(p_type) NOT LIKE '%brass%' AND lower(p_name) NOT LIKE '%x%' AS allowed FROM part")
Q["stage_digests"] = ([], ["customer", "supplier"], """
    SELECT coalesce(a.k, b.k) AS stage, a.d IS NOT DISTINCT FROM b.d AS same FROM (SELECT c_nationkey AS k, count(*) % 3 AS d FROM customer GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) % 3 AS d FROM supplier GROUP BY s_nationkey) b ON a.k = b.k""")
Q["admission"] = ([], ["orders"], "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS active, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) < 16 AS admits FROM orders GROUP BY o_custkey")
