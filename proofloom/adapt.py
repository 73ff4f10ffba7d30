"""The star schema, documents and events as graph tables: one SQL text per view, for Spark and for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()

#: Source files of the call graph (a supplier each) and names in it grow with the tables.
_S, _N = "(SELECT count(*) FROM supplier)", "(SELECT CAST(floor(count(*) / 4) AS BIGINT) + 1 FROM part)"


def _share(of: float) -> str:
    """Keys that grow with the table of suppliers: so many for each."""
    return f"(SELECT CAST(floor(count(*) * {of} + 0.5) AS BIGINT) FROM supplier)"


def _fn(number: str) -> str:
    return f"concat('fn_', ({number}) % {_N})"


def _nth(key: str) -> str:
    """The place of a part among those of its file."""
    return f"CAST(floor({key} / {_S}) AS BIGINT)"


def _scope(key: str) -> str:
    return f"CASE {_nth(key)} % 8 WHEN 1 THEN 'a' WHEN 2 THEN 'a.b' WHEN 3 THEN 'a.b.c' WHEN 5 THEN 'z' WHEN 6 THEN 'z.b' WHEN 7 THEN 'z.b.c' ELSE '' END"


def _owner(key: str) -> str:
    return f"CASE WHEN {_nth(key)} % 5 = 4 THEN concat('T', {key} % 7) END"


_MODULE = f"CASE WHEN {_nth('p_partkey')} % 4 = 3 THEN -1 - p_partkey % {_S} ELSE (p_partkey % {_S} * 7 + {_nth('p_partkey')}) % {_S} END"

#: In order; a view may use those before it. {sha} is the engine's SHA-256 call, {on} its way to quote a word.
VIEWS = {
    "artifact": """SELECT p_partkey AS k, concat('function:', p_partkey) AS id, p_name AS label, CASE p_partkey % 31 WHEN 1 THEN concat('vendor/', p_brand, '/src/lib.rs') WHEN 2 THEN concat('crates/', p_brand, '/src/api.generated.rs')
        WHEN 3 THEN concat('crates/', p_brand, '/tests/flow.rs') WHEN 4 THEN concat('crates/', p_brand, '/src/unit_test.rs') WHEN 5 THEN concat('crates/', p_brand, '/examples/', p_type, '.rs') WHEN 6 THEN concat('docs/', p_type, '.md')
        WHEN 7 THEN concat('crates/', p_brand, '/README.md') WHEN 8 THEN concat('crates/', p_brand, '/src/test.rs') WHEN 9 THEN concat('rust/', p_brand, '/target/out.rs') ELSE concat('crates/', p_brand, '/src/', p_type, '.rs') END AS path,
        p_partkey % 37 = 0 AS own_change, p_size % 4 = 0 AS is_async, p_size % 5 = 0 AS awaits, p_size % 7 = 0 AS spawns, p_size % 3 AS primitives,
        p_size AS start_line, p_size + p_partkey % 40 AS end_line, p_partkey % 2 = 0 AS public, {sha}(concat(p_name, '|', p_brand, '|', p_type, '|', p_size){arg}) AS body_hash,
        {sha}(concat(p_type, '|', p_size){arg}) AS shape_hash FROM part""",
    "change": "SELECT o_orderkey AS k, concat('change:', o_orderkey) AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
    "contains": "SELECT DISTINCT l_orderkey AS container, l_partkey AS member FROM lineitem",
    "calls": """SELECT caller, callee, CASE WHEN callee % 7 = 0 THEN 'ambiguous' WHEN callee % 11 = 0 THEN 'unresolved' ELSE 'syntactic_unique' END AS resolution
        FROM (SELECT DISTINCT l_partkey AS caller, (l_partkey * 7 + l_suppkey) % (SELECT count(*) FROM part) AS callee FROM lineitem) c""",
    "capability": """SELECT CASE r_regionkey WHEN 0 THEN 'ast' WHEN 1 THEN 'direct_calls' WHEN 2 THEN 'concurrency_model' WHEN 3 THEN 'containment' ELSE 'changed_structure' END AS capability,
        CASE r_regionkey WHEN 1 THEN 'partial' WHEN 2 THEN 'unknown' ELSE 'complete' END AS state FROM region""",
    "reentry": """SELECT DISTINCT o_custkey AS event, l_partkey AS target, CASE WHEN l_partkey % 4 = 0 THEN 'bounded' ELSE 'unbounded_reentry' END AS concurrency
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_linenumber = 1""",
    "external_call": "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN 'key' END AS idempotency FROM lineitem",
    "module_edge": "SELECT concat('module:', p_brand) AS container, p_partkey AS member FROM part WHERE p_partkey % 9 <> 0 UNION ALL SELECT concat('module:', p_type), p_partkey FROM part WHERE p_partkey % 10 = 0",
    "ring": """SELECT p_partkey AS id, p_partkey - p_partkey % 10 + (p_partkey + 3) % 10 AS {on} FROM part WHERE NOT (p_partkey % 10 = 4 AND p_partkey % 20 < 10)""",
    "tree": "SELECT p_partkey AS src, CAST(floor(p_partkey / 3) AS BIGINT) AS dst FROM part WHERE p_partkey > 0 AND p_partkey % 25 <> 7",
    "claim": """SELECT o_orderkey AS claim, CAST(floor(o_orderkey / 2) AS BIGINT) AS obligation, CASE o_orderpriority WHEN '1-URGENT' THEN 'accepted' WHEN '2-HIGH' THEN 'supported' ELSE 'open' END AS disposition,
        concat('p', o_custkey % 4) AS property FROM orders""",
    "bound": """SELECT l_orderkey AS claim, l_partkey AS evidence, CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'N' THEN 'reproduces' ELSE 'contradicts' END AS relation, concat('p', l_suppkey % 4) AS property FROM lineitem""",
    "evid": """SELECT p_partkey AS evidence, CASE p_size % 3 WHEN 0 THEN 'source_inspection' WHEN 1 THEN 'static_fact' ELSE 'test' END AS mode, p_size % 2 = 0 AS current, p_partkey % 20 AS target FROM part WHERE p_partkey % 50 <> 1
        UNION ALL SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'source_inspection' WHEN 1 THEN 'static_fact' ELSE 'test' END, p_size % 2 = 0, (p_partkey + 7) % 20 FROM part WHERE p_partkey % 50 <> 1""",
    "obl_target": "SELECT DISTINCT CAST(floor(l_orderkey / 2) AS BIGINT) AS obligation, l_suppkey % 20 AS target FROM lineitem",
    "verif": "SELECT l_orderkey AS claim, CASE WHEN l_partkey % 40 = 3 THEN l_partkey + 1 ELSE l_partkey END AS evidence, l_linestatus = 'F' OR l_returnflag = 'N' AS passed FROM lineitem WHERE l_returnflag <> 'R' OR l_linestatus = 'F'",
    "verdict": """SELECT o_orderkey AS claim, o_orderkey * 10 AS decision_id, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'reject' ELSE 'defer' END AS decision, CASE WHEN o_custkey % 3 = 0 THEN 'agent' ELSE 'human' END AS reviewer FROM orders
        UNION ALL SELECT o_orderkey, o_orderkey * 10 + 1, 'accept', 'human' FROM orders WHERE o_custkey % 5 = 0""",
    "fnd": "SELECT o_orderkey AS finding_id, o_orderkey AS claim, CASE WHEN o_custkey % 5 = 0 THEN o_orderkey * 10 + 1 ELSE o_orderkey * 10 END AS decision_id FROM orders WHERE o_custkey % 2 = 0",
    "callable_before": """SELECT p_partkey AS k, concat('f', p_partkey % 40) AS path, concat(p_name, CASE WHEN p_size > 25 THEN concat('#', p_partkey) ELSE '' END) AS qualified, p_name AS name, p_size % 3 AS params, p_size * 10 AS s, p_size * 10 + 8 AS e,
        p_partkey % 2 = 0 AS public, concat('sig', p_size % 7) AS signature FROM part""",
    "callable_after": """SELECT p_partkey + 5000000 AS k, concat('f', p_partkey % 40) AS path, concat(p_name, CASE WHEN p_size > 25 THEN concat('#', p_partkey) ELSE '' END) AS qualified, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN 5 ELSE p_size % 3 END AS params, p_size * 10 AS s,
        p_size * 10 + 8 AS e, CASE WHEN p_partkey % 14 = 0 THEN false ELSE p_partkey % 2 = 0 END AS public, concat('sig', CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE p_size % 7 END) AS signature FROM part WHERE p_partkey % 10 <> 3
        UNION ALL SELECT p_partkey + 6000000, concat('f', p_partkey % 40), concat('new::', p_name), p_name, 1, 5, 9, true, 'sig9' FROM part WHERE p_partkey % 25 = 0""",
    "hunk": "SELECT DISTINCT concat('f', s_suppkey % 40) AS path, (s_suppkey * 37) % 480 AS s, (s_suppkey * 37) % 480 + s_suppkey % 15 AS e FROM supplier WHERE s_suppkey % 3 <> 0",
    "deletion": "SELECT DISTINCT concat('f', s_suppkey % 40) AS path, (s_suppkey * 53) % 490 AS n FROM supplier WHERE s_suppkey % 4 = 0",
    "planned": "SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1",
    "side_effect": "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal < 0",
    "touches_supplier": "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem",
    "handled_by": "SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderpriority = '1-URGENT'",
    "obligation": """SELECT o_orderkey AS k, concat('obligation:', o_orderkey) AS id, o_custkey AS stream, o_orderdate AS made_at,
        CASE o_orderpriority WHEN '1-URGENT' THEN 4.0 WHEN '2-HIGH' THEN 2.0 WHEN '3-MEDIUM' THEN 1.0 WHEN '4-NOT SPECIFIED' THEN 0.5 ELSE 0.25 END AS weight,
        o_orderstatus AS status FROM orders""",
    "binding": "SELECT l_orderkey AS k, l_partkey AS evidence, l_returnflag AS relation, year(l_shipdate) AS snapshot, l_linestatus AS outcome FROM lineitem",
    "event": """SELECT event_id AS seq, user_id AS stream, CASE event_type WHEN 'signup' THEN 'generated' WHEN 'view' THEN 'planned' WHEN 'click' THEN 'in_progress'
        WHEN 'purchase' THEN 'completed' ELSE 'stale' END AS state FROM events""",
    "before_fn": "SELECT p_partkey AS k, p_name AS anchor, p_size AS body FROM part",
    "after_fn": """SELECT CASE WHEN p_partkey % 13 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS k, p_name AS anchor,
        CASE WHEN p_partkey % 11 = 0 THEN p_size + 1 ELSE p_size END AS body FROM part WHERE p_partkey % 17 <> 0""",
    "root_span": f"SELECT o_orderkey AS root, o_custkey % {_share(0.5)} AS path, day(o_orderdate) AS s, day(o_orderdate) + 2 AS e, CASE o_orderstatus WHEN 'O' THEN 'N' WHEN 'F' THEN 'R' ELSE 'A' END AS tag FROM orders WHERE o_orderpriority = '1-URGENT'",
    "finding": f"SELECT l_orderkey * 8 + l_linenumber AS finding, l_partkey % {_share(0.5)} AS path, day(l_shipdate) AS s, day(l_shipdate) + l_linenumber % 3 AS e, l_returnflag AS tag FROM lineitem",
    "call_site": f"SELECT DISTINCT l_orderkey * 8 + l_linenumber AS call_id, l_partkey % {_share(0.97)} AS scope, concat('fn_', l_suppkey % {_share(0.6)}) AS name FROM lineitem",
    "declaration": f"SELECT s_suppkey AS k, concat('fn_', s_suppkey % {_share(0.8)}) AS name, s_suppkey % {_share(0.97)} AS scope FROM supplier",
    "cfile": "SELECT concat('f', s_suppkey) AS file, CAST(1000 + s_suppkey * 37 % 9000 AS BIGINT) AS bytes, CAST(200 + s_suppkey * 53 % 1500 AS BIGINT) AS excerpt, s_suppkey % 4 = 1 AS is_test, s_suppkey % 9 = 2 AS giant FROM supplier",
    "cfile_holds": f"SELECT concat('f', p_partkey % {_S}) AS file, concat('p', p_partkey) AS node FROM part",
    "rename_of": "SELECT concat('src/f', s_suppkey, '.rs') AS old, concat('lib/f', s_suppkey, '.rs') AS new FROM supplier",
    "vertex": f"""SELECT 'before' AS side, concat('file:', s_suppkey) AS k, 'file' AS kind, concat('src/f', s_suppkey, '.rs') AS path, CAST(NULL AS STRING) AS label, CAST(NULL AS STRING) AS anchor, concat('h', s_nationkey) AS body FROM supplier
        UNION ALL SELECT 'after', concat('f2:', s_suppkey), 'file', concat(CASE s_suppkey % 10 WHEN 3 THEN 'lib' WHEN 4 THEN 'new' WHEN 5 THEN 'lib' ELSE 'src' END, '/f', s_suppkey, '.rs'), NULL, NULL, concat('h', CASE WHEN s_suppkey % 10 IN (5, 7) THEN 99 ELSE s_nationkey END) FROM supplier
        UNION ALL SELECT 'before', concat('symbol:', p_partkey), 'symbol', concat('src/f', p_partkey % {_S}, '.rs'), concat(p_name, '#', p_partkey % 9), concat(p_type, p_size, p_brand, p_partkey % 50), concat('b', p_size) FROM part
        UNION ALL SELECT 'after', concat('s2:', p_partkey), 'symbol', concat('src/f', (p_partkey + CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END) % {_S}, '.rs'), CASE WHEN p_partkey % 13 = 0 THEN concat('new_', p_partkey) ELSE concat(p_name, '#', p_partkey % 9) END,
          concat(p_type, CASE WHEN p_partkey % 19 = 0 THEN 77 ELSE p_size END, p_brand, p_partkey % 50), concat('b', CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END) FROM part
        UNION ALL SELECT 'before', concat('doc:', c_custkey), 'document', concat('docs/', c_custkey), c_mktsegment, NULL, concat('t', c_nationkey) FROM customer
        UNION ALL SELECT 'after', concat('d2:', c_custkey), 'document', concat('docs/', c_custkey), c_mktsegment, NULL, concat('t', c_nationkey % 20) FROM customer
        UNION ALL SELECT DISTINCT 'before', concat('relation:', l_partkey, '-', l_suppkey), 'relation', NULL, 'touches', NULL, concat('w', l_partkey % 3) FROM lineitem
        UNION ALL SELECT DISTINCT 'after', concat('r2:', l_partkey, '-', l_suppkey), 'relation', NULL, 'touches', NULL, concat('w', CASE WHEN l_suppkey % 8 = 0 THEN 0 ELSE l_partkey % 3 END) FROM lineitem
        UNION ALL SELECT DISTINCT 'before', concat('context:', CAST(floor(s_suppkey / 2) AS BIGINT)), 'context', NULL, 'module', NULL, 'c' FROM supplier UNION ALL SELECT DISTINCT 'after', concat('c2:', CAST(floor(s_suppkey / 2) AS BIGINT)), 'context', NULL, 'module', NULL, 'c' FROM supplier
        UNION ALL SELECT DISTINCT 'before', concat('invariant:', CAST(floor(s_suppkey / 4) AS BIGINT)), 'invariant', NULL, 'at_most_once', NULL, 'i' FROM supplier UNION ALL SELECT DISTINCT 'after', concat('i2:', CAST(floor(s_suppkey / 4) AS BIGINT)), 'invariant', NULL, 'at_most_once', NULL, 'i' FROM supplier
        UNION ALL SELECT 'before', concat('limitation:', p_partkey), 'limitation', NULL, p_type, NULL, 'l' FROM part UNION ALL SELECT 'after', concat('l2:', p_partkey), 'limitation', NULL, p_type, NULL, CASE WHEN p_partkey % 5 = 0 THEN 'm' ELSE 'l' END FROM part""",
    "link_of": f"""SELECT DISTINCT 'before' AS side, concat('relation:', l_partkey, '-', l_suppkey) AS k, 0 AS place, concat('symbol:', l_partkey) AS member FROM lineitem UNION ALL SELECT DISTINCT 'before', concat('relation:', l_partkey, '-', l_suppkey), 1, concat('file:', l_suppkey) FROM lineitem
        UNION ALL SELECT DISTINCT 'after', concat('r2:', l_partkey, '-', l_suppkey), CASE WHEN (l_partkey + l_suppkey) % 23 = 0 THEN 1 ELSE 0 END, concat('s2:', l_partkey) FROM lineitem
        UNION ALL SELECT DISTINCT 'after', concat('r2:', l_partkey, '-', l_suppkey), CASE WHEN (l_partkey + l_suppkey) % 23 = 0 THEN 0 ELSE 1 END, concat('f2:', l_suppkey) FROM lineitem
        UNION ALL SELECT 'before', concat('context:', CAST(floor(s_suppkey / 2) AS BIGINT)), 0, concat('file:', s_suppkey) FROM supplier UNION ALL SELECT 'after', concat('c2:', CAST(floor(s_suppkey / 2) AS BIGINT)), 0, concat('f2:', s_suppkey) FROM supplier
        UNION ALL SELECT DISTINCT 'before', concat('invariant:', CAST(floor(s_suppkey / 4) AS BIGINT)), 0, concat('context:', CAST(floor(s_suppkey / 2) AS BIGINT)) FROM supplier UNION ALL SELECT DISTINCT 'after', concat('i2:', CAST(floor(s_suppkey / 4) AS BIGINT)), 0, concat('c2:', CAST(floor(s_suppkey / 2) AS BIGINT)) FROM supplier
        UNION ALL SELECT 'before', concat('limitation:', p_partkey), 0, concat('symbol:', p_partkey) FROM part UNION ALL SELECT 'before', concat('limitation:', p_partkey), 0, concat('file:', p_partkey % {_S}) FROM part
        UNION ALL SELECT 'after', concat('l2:', p_partkey), 0, concat('s2:', p_partkey) FROM part UNION ALL SELECT 'after', concat('l2:', p_partkey), 0, concat('f2:', p_partkey % {_S}) FROM part""",
    "decl": f"SELECT p_partkey AS k, p_partkey % {_S} AS file, {_scope('p_partkey')} AS scope, {_owner('p_partkey')} AS owner, {_fn('p_partkey')} AS name, p_partkey % 3 <> 0 AS public FROM part",
    "shadow": f"SELECT p_partkey AS caller, CASE WHEN p_partkey % 6 = 0 THEN {_fn('p_partkey')} ELSE concat('local_', p_partkey) END AS name FROM part",
    "csite": f"""SELECT DISTINCT concat(l_orderkey, '/', l_partkey, '/', l_suppkey, '/', l_linenumber) AS call_id, l_partkey AS caller, l_partkey % {_S} AS file, {_scope('l_partkey')} AS scope, {_owner('l_partkey')} AS owner,
        CASE WHEN l_linenumber = 7 THEN 'self' ELSE 'plain' END AS form, {_fn(f"""CASE l_linenumber WHEN 1 THEN l_partkey % {_S} + {_S} * (l_suppkey % 20) WHEN 2 THEN l_partkey % {_S} + {_S} * ({_nth('l_partkey')} % 8 + 8) WHEN 3 THEN l_partkey
        WHEN 4 THEN l_partkey * 7 + l_suppkey WHEN 5 THEN l_partkey % {_S} * 13 + l_suppkey % 20 * 17 WHEN 6 THEN (l_partkey % {_S} * 3 + l_suppkey % 2 + 1) % {_S} + {_S} * 4 * (l_suppkey % 5) ELSE l_partkey % {_S} + {_S} * 4 END""")} AS name FROM lineitem""",
    "import_of": f"""SELECT p_partkey % {_S} AS file, {_nth('p_partkey')} AS place, {_fn(f"p_partkey % {_S} * 13 + {_nth('p_partkey')} * 17")} AS local, {_MODULE} AS module,
        {_fn(f"CASE {_nth('p_partkey')} % 4 WHEN 0 THEN {_MODULE} WHEN 1 THEN ({_MODULE}) * 9 + 5 WHEN 2 THEN ({_MODULE}) + {_S} * 4 ELSE p_partkey * 11 END")} AS imported FROM part""",
    "glob_of": f"SELECT s_suppkey % {_S} AS file, 0 AS place, (s_suppkey * 3 + 1) % {_S} AS module FROM supplier UNION ALL SELECT s_suppkey % {_S}, 1, (s_suppkey * 3 + 2) % {_S} FROM supplier",
    "alias_of": f"SELECT s_suppkey % {_S} AS file, {_fn('s_suppkey * 9 + 5')} AS exported, {_fn('s_suppkey')} AS name FROM supplier",
    "reexport": f"""SELECT s_suppkey % {_S} AS file, '*' AS exported, (s_suppkey * 5 + 1) % {_S} AS module, '*' AS imported FROM supplier
        UNION ALL SELECT s_suppkey % {_S}, {_fn(f's_suppkey % {_S} + {_S} * 4')}, (s_suppkey + 1) % {_S}, {_fn(f'(s_suppkey + 1) % {_S}')} FROM supplier""",
}


def _chain(names: list[str], sha: str, arg: str, quote: str) -> list[str]:
    return [f"{n} AS ({VIEWS[n].format(sha=sha, arg=arg, on=f'{quote}on{quote}')})" for n in names]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the Parquet tables of sf_dir; filters and columns reach the scan."""
    used = [t for t in TABLES if f" {t}" in VIEWS[name]]
    head = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used]
    return spark.sql(f"WITH {', '.join(head + _chain([name], 'sha2', ', 256', '`'))} SELECT * FROM {name}")


def oracle(body: str, *names: str) -> str:
    """body (a SELECT, or more CTEs and a SELECT) over the views as ANSI SQL."""
    tail = body.strip()
    chain = ",\n".join(_chain(list(names), "sha256", "", '"'))
    return f"WITH {chain}{', ' if tail.startswith('+') else ' '}{tail.lstrip('+')}" if names else tail
