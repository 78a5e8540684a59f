"""The engine's own queries: dialect text and the same in standard SQL, for tests and for the driver."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import TesseraError
from .formatting import format_table
from .plans.grammar import parse
from .session import Database

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None, "events": "event_id"}

NK = "(SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_regionkey=2 THEN NULL ELSE n_regionkey::BIGINT END AS k FROM nation)"
SAME = ""

#: name: (text in the dialect, text in standard SQL; empty where they are the same, None where there is none)
READS: dict[str, tuple[str, str | None]] = {
    "scan_full": ("SELECT * FROM region", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"),
    "scan_pruned": ("SELECT c_custkey, c_name FROM customer", SAME),
    "range_point": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7", SAME),
    "range_closed": ("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 20", SAME),
    "range_open_lo": ("SELECT o_orderkey FROM orders WHERE o_orderkey > 14900", SAME),
    "range_open_hi": ("SELECT o_orderkey FROM orders WHERE o_orderkey <= 25", SAME),
    "range_intersect": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 5 AND o_orderkey < 9 AND o_totalprice > 1000.0", SAME),
    "range_flipped": ("SELECT o_orderkey FROM orders WHERE 14990 < o_orderkey", SAME),
    "mixed_type_bound": ("SELECT o_orderkey FROM orders WHERE o_orderkey > 14990.5", SAME),
    "index_eq": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", SAME),
    "index_range": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'FURNITURE' ORDER BY c_mktsegment", SAME),
    "filter_ne": ("SELECT p_partkey FROM part WHERE p_size <> 11", SAME),
    "filter_and_or_not": ("SELECT p_partkey FROM part WHERE NOT (p_size > 10 OR p_brand = 'Brand#2') AND p_retailprice > 905.0", SAME),
    "in_list": ("SELECT p_partkey FROM part WHERE p_size IN (1, 3, 99)", SAME),
    "not_in_list": ("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 3)", SAME),
    "not_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45", SAME),
    "like_prefix": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'", SAME),
    "like_contains": ("SELECT p_partkey FROM part WHERE p_name LIKE '%in%'", SAME),
    "like_underscore": ("SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_'", SAME),
    "not_like": ("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%o%'", SAME),
    "proj_int_arith": ("SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 2 AS m FROM orders", SAME),
    "proj_int_div": ("SELECT o_orderkey, o_custkey / 7 AS q, (o_orderkey - 7500) / 7 AS nq FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, (o_orderkey - 7500) // 7 AS nq FROM orders"),
    "proj_mod": ("SELECT o_orderkey, (o_orderkey - 7500) % 7 AS r FROM orders", SAME),
    "proj_float_arith": ("SELECT p_partkey, p_retailprice * 2.0 AS d, p_size + 0.5 AS h, -p_retailprice AS n FROM part", "SELECT p_partkey, p_retailprice * 2.0::DOUBLE AS d, p_size + 0.5::DOUBLE AS h, -p_retailprice AS n FROM part"),
    "proj_predicate": ("SELECT o_orderkey, o_totalprice > 100000.0 AS big FROM orders", SAME),
    "proj_expr_names": ("SELECT o_orderkey, o_custkey * 2 FROM orders", 'SELECT o_orderkey, o_custkey * 2 AS "o_custkey * 2" FROM orders'),
    "proj_star_plus": ("SELECT *, s_acctbal > 5000.0 AS rich FROM supplier", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal, s_acctbal > 5000.0 AS rich FROM supplier"),
    "sort_asc": ("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal", SAME),
    "sort_multi": ("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey", SAME),
    "topn": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", SAME),
    "topn_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 3", SAME),
    "topn_tiebreak_pk": ("SELECT p_partkey FROM part ORDER BY p_size LIMIT 15", "SELECT p_partkey FROM part ORDER BY p_size, p_partkey LIMIT 15"),
    "limit_pk_order": ("SELECT o_orderkey FROM orders LIMIT 7", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    "offset_only": ("SELECT o_orderkey FROM orders OFFSET 14990", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 14990"),
    "distinct": ("SELECT DISTINCT c_mktsegment FROM customer", SAME),
    "distinct_order_limit": ("SELECT DISTINCT p_size FROM part ORDER BY p_size LIMIT 5", "SELECT DISTINCT p_size::BIGINT AS p_size FROM part ORDER BY 1 LIMIT 5"),
    "distinct_hidden_order": ("SELECT DISTINCT p_brand FROM part ORDER BY p_retailprice LIMIT 3", "SELECT p_brand FROM (SELECT p_brand, min(rn) AS rn FROM (SELECT p_brand, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rn FROM part) GROUP BY p_brand) ORDER BY rn LIMIT 3"),
    "count_star": ("SELECT COUNT(*) AS n FROM lineitem", SAME),
    "sum_int": ("SELECT SUM(o_custkey) AS s FROM orders", "SELECT SUM(o_custkey)::BIGINT AS s FROM orders"),
    "sum_avg_float": ("SELECT SUM(l_quantity) AS s, AVG(l_quantity) AS a FROM lineitem", SAME),
    "min_max": ("SELECT MIN(p_name) AS a, MAX(p_name) AS b, MIN(p_retailprice) AS c, MAX(p_size) AS d FROM part", "SELECT MIN(p_name) AS a, MAX(p_name) AS b, MIN(p_retailprice) AS c, MAX(p_size)::BIGINT AS d FROM part"),
    "min_max_bool": ("SELECT MIN(p_size > 10) AS a, MAX(p_size > 10) AS b FROM part", SAME),
    "agg_empty_input": ("SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a, MIN(o_custkey) AS lo FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, SUM(o_custkey)::BIGINT AS s, AVG(o_custkey) AS a, MIN(o_custkey) AS lo FROM orders WHERE o_orderkey < 0"),
    "group_one": ("SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag", SAME),
    "group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_discount < 0.05 GROUP BY l_returnflag, l_linestatus", SAME),
    "group_expr": ("SELECT o_custkey % 10 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10", SAME),
    "group_agg_expr": ("SELECT o_orderstatus, SUM(o_custkey) / COUNT(*) AS m, MAX(o_custkey) - MIN(o_custkey) AS w FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, (SUM(o_custkey) // COUNT(*))::BIGINT AS m, MAX(o_custkey) - MIN(o_custkey) AS w FROM orders GROUP BY o_orderstatus"),
    "group_order_by_agg": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10", SAME),
    "group_limit_key_order": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey LIMIT 5", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 5"),
    "group_no_agg": ("SELECT event_type FROM events GROUP BY event_type", SAME),
    "group_distinct": ("SELECT DISTINCT COUNT(*) AS n FROM orders GROUP BY o_orderstatus", SAME),
    "qualified_names": ("SELECT orders.o_orderkey, orders.o_custkey AS c FROM orders WHERE orders.o_custkey < 100 ORDER BY orders.o_orderkey", 'SELECT o_orderkey AS "orders.o_orderkey", o_custkey AS c FROM orders WHERE o_custkey < 100'),
    "double_equals": ("SELECT p_partkey FROM part WHERE p_size == 7", SAME),
    "unary_plus": ("SELECT o_orderkey, +o_custkey AS c, - -o_custkey AS d FROM orders WHERE +o_orderkey < 50", SAME),
    "not_in_with_null": ("SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)", SAME),
    "in_with_null_as_value": ("SELECT p_partkey, p_size IN (1, NULL) AS found, p_size NOT IN (1, NULL) AS missing FROM part", SAME),
    "many_conditions": ("SELECT p_partkey FROM part WHERE " + " OR ".join(f"p_partkey = {i}" for i in range(0, 900, 2)), SAME),
    "nested_deeply": ("SELECT p_partkey FROM part WHERE " + "(" * 500 + "p_size > 40" + ")" * 500 + " AND " + "NOT " * 501 + "p_size > 45", "SELECT p_partkey FROM part WHERE p_size > 40 AND NOT p_size > 45"),
    "explain_topn": ("EXPLAIN SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 3", None),
}

#: Scripts over stored tables: nk, from nation with nulls, indexed on k; sw, from customer. NK stands for nk's rows.
STORED: dict[str, tuple[str, str]] = {
    "null_is": ("SELECT id FROM nk WHERE k IS NULL", "SELECT id FROM NK WHERE k IS NULL"),
    "null_is_not": ("SELECT id FROM nk WHERE k IS NOT NULL", "SELECT id FROM NK WHERE k IS NOT NULL"),
    "null_ne": ("SELECT id FROM nk WHERE k <> 1", "SELECT id FROM NK WHERE k <> 1"),
    "null_not_eq": ("SELECT id FROM nk WHERE NOT (k = 1)", "SELECT id FROM NK WHERE NOT (k = 1)"),
    "null_in": ("SELECT id FROM nk WHERE k IN (1, NULL)", "SELECT id FROM NK WHERE k IN (1, NULL)"),
    "null_or": ("SELECT id FROM nk WHERE k > 1 OR id = 2", "SELECT id FROM NK WHERE k > 1 OR id = 2"),
    "null_lt_indexed": ("SELECT id FROM nk WHERE k < 3", "SELECT id FROM NK WHERE k < 3"),
    "null_arith": ("SELECT id, k + 1 AS k1 FROM nk", "SELECT id, k + 1 AS k1 FROM NK"),
    "topn_nulls": ("SELECT id FROM nk ORDER BY k, id LIMIT 8", "SELECT id FROM NK ORDER BY k ASC NULLS FIRST, id LIMIT 8"),
    "topn_nulls_desc": ("SELECT id FROM nk ORDER BY k DESC, id LIMIT 22", "SELECT id FROM NK ORDER BY k DESC NULLS LAST, id LIMIT 22"),
    "distinct_nulls": ("SELECT DISTINCT k FROM nk", "SELECT DISTINCT k FROM NK"),
    "count_col_nulls": ("SELECT COUNT(k) AS n, COUNT(*) AS m FROM nk", "SELECT COUNT(k) AS n, COUNT(*) AS m FROM NK"),
    "avg_nulls": ("SELECT AVG(k) AS a, SUM(k) AS s FROM nk", "SELECT AVG(k) AS a, SUM(k)::BIGINT AS s FROM NK"),
    "group_nulls": ("SELECT k, COUNT(*) AS n FROM nk GROUP BY k", "SELECT k, COUNT(*) AS n FROM NK GROUP BY k"),
    "insert_values": ("INSERT INTO nk (id, name) VALUES (100, 'x'), (101, 'y'); SELECT id, name, k FROM nk", "SELECT id, name, k FROM NK UNION ALL VALUES (100,'x',NULL),(101,'y',NULL)"),
    "update_set": ("UPDATE nk SET k = k + 10, name = 'z' WHERE id < 5; SELECT id, name, k FROM nk", "SELECT id, CASE WHEN id<5 THEN 'z' ELSE name END AS name, CASE WHEN id<5 THEN k+10 ELSE k END AS k FROM NK"),
    "update_swap": ("UPDATE sw SET a = b, b = a; SELECT id, a, b FROM sw", "SELECT c_custkey AS id, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer"),
    "update_move_pk": ("UPDATE nk SET id = id + 1000 WHERE k = 1; SELECT id, k FROM nk", "SELECT CASE WHEN k=1 THEN id+1000 ELSE id END AS id, k FROM NK"),
    "delete_where": ("DELETE FROM nk WHERE k >= 3; SELECT id, k FROM nk", "SELECT id, k FROM NK WHERE NOT coalesce(k>=3,false)"),
    "tx_rollback": ("BEGIN; DELETE FROM nk; ROLLBACK; SELECT id, k FROM nk", "SELECT id, k FROM NK"),
    "tx_commit": ("BEGIN; DELETE FROM nk WHERE id < 20; COMMIT; SELECT id, k FROM nk", "SELECT id, k FROM NK WHERE id >= 20"),
    "like_backslash": (r"INSERT INTO nk VALUES (200, 'a\\b%c', 1), (201, 'axb%c', 2); SELECT id FROM nk WHERE name LIKE 'a\\b%'", r"SELECT 200::BIGINT AS id"),
    "key_moves_onto_freed_keys": ("UPDATE nk SET id = id + 1 WHERE id = 24; UPDATE nk SET id = 24 WHERE id = 3; SELECT id, name FROM nk WHERE id > 20", "SELECT CASE id WHEN 24 THEN 25 WHEN 3 THEN 24 ELSE id END AS id, name FROM NK WHERE id > 20 OR id = 3"),
    "delete_range": ("DELETE FROM nk WHERE id BETWEEN 5 AND 19; SELECT id, name, k FROM nk", "SELECT id, name, k FROM NK WHERE NOT id BETWEEN 5 AND 19"),
    "create_table": ("CREATE TABLE IF NOT EXISTS made (id INT PRIMARY KEY, word TEXT NOT NULL, x FLOAT, yes BOOL); CREATE TABLE IF NOT EXISTS made (id INT PRIMARY KEY); INSERT INTO made VALUES (2, 'b', 0.5, TRUE), (1, 'a', NULL, NULL); SELECT * FROM made", "SELECT * FROM (VALUES (1::BIGINT, 'a', NULL::DOUBLE, NULL::BOOLEAN), (2, 'b', 0.5, true)) AS v(id, word, x, yes)"),
    "drop_table": ("CREATE TABLE made (id INT PRIMARY KEY, old TEXT); INSERT INTO made VALUES (1, 'old'); DROP TABLE made; DROP TABLE IF EXISTS made; CREATE TABLE made (id INT PRIMARY KEY, fresh INT); SELECT * FROM made", "SELECT 1::BIGINT AS id, 1::BIGINT AS fresh WHERE false"),
    "drop_index": ("DROP INDEX nk_k; DROP INDEX IF EXISTS nk_k; CREATE INDEX IF NOT EXISTS nk_name ON nk (name); SELECT id FROM nk WHERE k = 1 AND name > 'B'", "SELECT id FROM NK WHERE k = 1 AND name > 'B'"),
    "tx_own_writes": ("BEGIN; DELETE FROM nk WHERE id < 20; INSERT INTO nk VALUES (50, 'n', 1); SELECT id, k FROM nk", "SELECT id, k FROM NK WHERE id >= 20 UNION ALL VALUES (50, 1)"),
}


def workspace(spark: SparkSession) -> str:
    """A new folder for a database: on a cluster, one that all machines share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ("" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))
    return f"{found.rstrip('/')}/tessera-{uuid.uuid4().hex}" if found else f"file://{tempfile.mkdtemp(prefix='tessera-db-')}"


def over_files(spark: SparkSession, sf_dir: str) -> Database:
    """A database whose tables are the Parquet files of a folder, read-only."""
    db = Database(spark, workspace(spark))
    for name, key in KEYS.items():
        db.register(name, f"{sf_dir}/{name}.parquet", key)
    return db


def with_tables(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = Database(spark, workspace(spark))
    if "nk" in names:
        df = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("bigint(n_nationkey) AS id", "n_name AS name", "IF(n_regionkey = 2, NULL, bigint(n_regionkey)) AS k")
        db.load("nk", df, "id")
        db.exec("CREATE INDEX nk_k ON nk (k)")
    if "sw" in names:
        db.load("sw", spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "double(c_nationkey) AS a", "c_acctbal AS b"), "id")
    return db


def read(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = READS[name][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = over_files(spark, sf_dir)
        if text.startswith("EXPLAIN"):
            result = db.exec(text)
            return spark.createDataFrame(result.rows, "plan string")
        return db.sql(text)

    return run


def stored(name: str) -> Callable[[SparkSession, str], DataFrame]:
    *before, last = STORED[name][0].split("; ")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        conn = with_tables(spark, sf_dir, "sw" if " sw" in last else "nk").conn()
        for text in before:
            conn.exec(text)
        return conn.sql(last)

    return run


def failure(run: Callable[[], object]) -> str:
    """What an error says, by its kind."""
    try:
        run()
    except TesseraError as e:
        return type(e).__name__
    return "none"


def snapshot(db: Database) -> list[tuple]:
    """A transaction sees the rows it began with, whatever others commit, and then those too."""
    conn = db.conn()
    conn.exec("BEGIN")
    count = lambda c: c.exec("SELECT COUNT(*) FROM nk").rows[0][0]
    first = count(conn)
    db.exec("DELETE FROM nk WHERE id < 10")
    during, others = count(conn), count(db)
    conn.exec("COMMIT")
    return [("first", first), ("during", during), ("others", others), ("after", count(conn))]


def sessions(db: Database) -> list[tuple]:
    """Open transactions of two sessions don't see each other; both commits hold."""
    a, b = db.conn(), db.conn()
    for c, key in ((a, 300), (b, 301)):
        c.exec("BEGIN")
        c.exec(f"INSERT INTO nk VALUES ({key}, 'new', 1)")
    new = lambda c: c.exec("SELECT COUNT(*) FROM nk WHERE id >= 300").rows[0][0]
    seen = [("a", new(a)), ("b", new(b)), ("neither", new(db))]
    a.exec("COMMIT")
    b.exec("COMMIT")
    return [*seen, ("both", new(db))]


def constraints(db: Database) -> list[tuple]:
    tries = {
        "repeated key": "INSERT INTO nk VALUES (500, 'x', 1), (500, 'y', 1)", "present key": "INSERT INTO nk VALUES (0, 'x', 1)", "null key": "INSERT INTO nk VALUES (NULL, 'x', 1)",
        "moved onto a key": "UPDATE nk SET id = 1 WHERE id = 2", "wrong kind": "INSERT INTO nk VALUES (501, 7, 1)", "no column": "UPDATE nk SET nosuch = 1", "divided by zero": "UPDATE nk SET k = 1 / (id - 7)",
    }
    return [(k, failure(lambda text=text: db.exec(text))) for k, text in tries.items()] + [("rows after", str(db.exec("SELECT COUNT(*) FROM nk WHERE id < 25").rows[0][0]))]


def legality(db: Database) -> list[tuple]:
    tries = {"ungrouped": "SELECT name, COUNT(*) FROM nk", "not the group": "SELECT id FROM nk GROUP BY k", "order": "SELECT k FROM nk GROUP BY k ORDER BY name", "group expression": "SELECT k + 1 FROM nk GROUP BY k + 1", "star": "SELECT * FROM nk GROUP BY k", "other table": "SELECT t.id FROM nk", "kinds": "SELECT id FROM nk WHERE name > 1"}
    return [(k, failure(lambda text=text: db.sql(text))) for k, text in tries.items()]


def in_transaction(db: Database) -> list[tuple]:
    conn = db.conn()
    conn.exec("BEGIN")
    out = [(text.split(" (")[0], failure(lambda text=text: conn.exec(text))) for text in ("CREATE TABLE z (id INT PRIMARY KEY)", "DROP TABLE nk", "CREATE INDEX i ON nk (name)", "DROP INDEX nk_k", "BEGIN")]
    conn.exec("INSERT INTO nk VALUES (600, 'kept', 2)")
    failed = failure(lambda: conn.exec("INSERT INTO nk VALUES (601, 'lost', 2), (600, 'again', 2)"))
    conn.exec("COMMIT")
    return [*out, ("half a statement", failed), ("rows", str(db.exec("SELECT COUNT(*) FROM nk WHERE id >= 600").rows[0][0])), ("COMMIT", failure(lambda: conn.exec("COMMIT")))]


def script(db: Database) -> list[tuple]:
    """Tags and counts of a script up to its error."""
    try:
        db.exec_script("INSERT INTO nk VALUES (400, 'a', 1); UPDATE nk SET k = 2 WHERE id = 400;; DELETE FROM nk WHERE id >= 399; SELECT nosuch FROM nk; DELETE FROM nk")
    except TesseraError as e:
        return [(i, r.tag, r.affected) for i, r in enumerate(e.results)] + [(len(e.results), type(e).__name__, db.exec("SELECT COUNT(*) FROM nk").rows[0][0])]


def parsed_before(db: Database) -> list[tuple]:
    """Statements that were parsed once and run twice."""
    conn, s = db.conn(), parse("UPDATE nk SET k = k + 1 WHERE id = 1")
    return [(i, conn.run_statement(s).affected, conn.run_statement(parse("SELECT k FROM nk WHERE id = 1")).rows[0][0]) for i in range(2)]


def cursor(db: Database) -> list[tuple]:
    """Rows read one by one, in order, on the snapshot that the query began with."""
    rows = db.query("SELECT id, name FROM nk WHERE k = 1")
    out = [rows.row()] if rows.next() else []
    db.exec("DELETE FROM nk WHERE id > 0")
    while rows.next():
        out.append(rows.row())
    rows.close()
    return [(i, *r) for i, r in enumerate(out)]


def schema_text(db: Database) -> list[tuple]:
    """The statements that make a table make the same table elsewhere."""
    text = db.catalog.get("nk").sql()
    db.exec("DROP TABLE nk")
    db.exec_script(text)
    return [(i, line) for i, line in enumerate(text.splitlines())] + [(9, str(db.catalog.get("nk").sql() == text))]


def table_text(db: Database) -> list[tuple]:
    r = db.exec("SELECT id, name, k FROM nk WHERE id < 3 ORDER BY id DESC")
    return list(enumerate(format_table(r.columns, r.rows).splitlines()))


def frames(db: Database) -> list[tuple]:
    """A DataFrame as a table: read like others, changed by none."""
    db.register("few", db.spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "num long, word string"), "num")
    return [(str(k), w) for k, w in db.exec("SELECT num, word FROM few WHERE word IS NULL OR num < 2").rows] + [("write", failure(lambda: db.exec("DELETE FROM few")))]


def explained(db: Database) -> list[tuple]:
    plan = db.exec("EXPLAIN SELECT id FROM nk WHERE id = 7").plan
    return [("insert", db.exec("EXPLAIN INSERT INTO nk VALUES (900, 'x', 1), (901, 'y', 1)").plan), ("delete", db.exec("EXPLAIN DELETE FROM nk WHERE id = 1").plan.splitlines()[0]), ("pushed", str("EqualTo(id,7)" in plan or "PushedFilters" in plan)), ("rows", str(db.exec("SELECT COUNT(*) FROM nk").rows[0][0]))]


#: What statements do besides returning rows: (run over a database with nk, the schema of its rows, the same in SQL).
EFFECTS: dict[str, tuple[Callable[[Database], list[tuple]], str, str]] = {
    "tx_snapshot": (snapshot, "step string, n long", "SELECT * FROM (VALUES ('first', (SELECT count(*) FROM NK)), ('during', (SELECT count(*) FROM NK)), ('others', (SELECT count(*) FROM NK WHERE id >= 10)), ('after', (SELECT count(*) FROM NK WHERE id >= 10))) AS v(step, n)"),
    "tx_sessions": (sessions, "step string, n long", "SELECT * FROM (VALUES ('a', 1::BIGINT), ('b', 1), ('neither', 0), ('both', 2)) AS v(step, n)"),
    "constraints": (constraints, "step string, error string", "SELECT * FROM (VALUES ('repeated key', 'DuplicateKey'), ('present key', 'DuplicateKey'), ('null key', 'NullKey'), ('moved onto a key', 'DuplicateKey'), ('wrong kind', 'TypeMismatch'), ('no column', 'ColumnNotFound'), ('divided by zero', 'DivideByZero'), ('rows after', (SELECT count(*)::VARCHAR FROM NK))) AS v(step, error)"),
    "group_legality": (legality, "step string, error string", "SELECT * FROM (VALUES ('ungrouped', 'PlanError'), ('not the group', 'PlanError'), ('order', 'PlanError'), ('group expression', 'none'), ('star', 'PlanError'), ('other table', 'TableNotFound'), ('kinds', 'TypeMismatch')) AS v(step, error)"),
    "tx_refuses_ddl": (in_transaction, "step string, error string", "SELECT * FROM (VALUES ('CREATE TABLE z', 'DDLInTransaction'), ('DROP TABLE nk', 'DDLInTransaction'), ('CREATE INDEX i ON nk', 'DDLInTransaction'), ('DROP INDEX nk_k', 'DDLInTransaction'), ('BEGIN', 'TransactionOpen'), ('half a statement', 'DuplicateKey'), ('rows', '1'), ('COMMIT', 'NoTransaction')) AS v(step, error)"),
    "script_results": (script, "i int, tag string, n long", "SELECT * FROM (VALUES (0, 'INSERT', 1::BIGINT), (1, 'UPDATE', 1), (2, 'DELETE', 1), (3, 'ColumnNotFound', (SELECT count(*) FROM NK))) AS v(i, tag, n)"),
    "parsed_statements": (parsed_before, "i int, affected long, k long", "SELECT i::INTEGER AS i, 1::BIGINT AS affected, k + i + 1 AS k FROM NK, range(2) AS r(i) WHERE id = 1"),
    "cursor_rows": (cursor, "i int, id long, name string", "SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS i, id, name FROM NK WHERE k = 1"),
    "schema_text": (schema_text, "i int, line string", "SELECT * FROM (VALUES (0, 'CREATE TABLE nk (id INT PRIMARY KEY, name TEXT, k INT);'), (1, 'CREATE INDEX nk_k ON nk (k);'), (9, 'True')) AS v(i, line)"),
    "text_table": (table_text, "i int, line string", "WITH r AS (SELECT id, name, coalesce(k::VARCHAR, 'NULL') AS k FROM NK WHERE id < 3), w AS (SELECT greatest(max(length(name)), 4)::INTEGER AS a, greatest(max(length(k)), 1)::INTEGER AS b FROM r), rule AS (SELECT '+----+' || repeat('-', a + 2) || '+' || repeat('-', b + 2) || '+' AS line FROM w) SELECT 0 AS i, line FROM rule UNION ALL SELECT 1, '| id | ' || rpad('name', a, ' ') || ' | ' || rpad('k', b, ' ') || ' |' FROM w UNION ALL SELECT 2, line FROM rule UNION ALL SELECT (5 - id)::INTEGER, '| ' || rpad(id::VARCHAR, 2, ' ') || ' | ' || rpad(name, a, ' ') || ' | ' || rpad(k, b, ' ') || ' |' FROM r, w UNION ALL SELECT 6, line FROM rule"),
    "register_frame": (frames, "num string, word string", "SELECT * FROM (VALUES ('1', 'a'), ('3', NULL), ('write', 'ReadOnly')) AS v(num, word)"),
    "explain_changes": (explained, "step string, line string", "SELECT * FROM (VALUES ('insert', 'INSERT nk (2 rows)'), ('delete', 'DELETE nk'), ('pushed', 'True'), ('rows', (SELECT count(*)::VARCHAR FROM NK))) AS v(step, line)"),
}


def effect(name: str) -> Callable[[SparkSession, str], DataFrame]:
    run, schema, _ = EFFECTS[name]
    return lambda spark, sf_dir: spark.createDataFrame(run(with_tables(spark, sf_dir, "nk")), schema)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: read(k) for k in READS} | {k: stored(k) for k in STORED} | {k: effect(k) for k in EFFECTS}


def oracle_sql() -> dict[str, str]:
    plain = {k: sql or text for k, (text, sql) in READS.items() if sql is not None}
    over_nk = {k: sql for k, (_, sql) in STORED.items()} | {k: sql for k, (*_, sql) in EFFECTS.items()}
    return plain | {k: sql.replace("FROM NK", f"FROM {NK} AS nk") for k, sql in over_nk.items()}
