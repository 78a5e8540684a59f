"""Statements against stored tables."""

import io
import random
import threading

import pytest

from tessera import errors as E
from tessera.functions.constants import evaluated
from tessera.plans.grammar import parse_expr
from tessera.plans.kinds import shown
from tessera.repl import Shell
from tessera.session import Database


def rows(source, text):
    return "|".join(",".join(map(shown, r)) for r in source.exec(text).rows)


@pytest.fixture
def t(db):
    db.exec("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, score FLOAT)")
    db.exec("INSERT INTO t VALUES (3,'clara',30.0), (1,'amber',10.0), (4,'dalek',NULL), (2,'bruno',20.0), (5,'enzo',10.0)")
    return db


# Queries over t and their answers.
ANSWERS = [
    ("SELECT id FROM t", "1|2|3|4|5"),
    ("SELECT * FROM t WHERE id = 4", "4,dalek,NULL"),
    ("SELECT id FROM t WHERE score > 10.0", "2|3"),
    ("SELECT id FROM t WHERE NOT (score > 10.0)", "1|5"),
    ("SELECT id FROM t WHERE score IS NULL OR id = 1", "1|4"),
    ("SELECT id FROM t WHERE id IN (1, 9, 3)", "1|3"),
    ("SELECT id FROM t WHERE score NOT IN (10.0, NULL)", ""),
    ("SELECT id FROM t WHERE score = 10", "1|5"),
    ("SELECT id FROM t WHERE name LIKE '%a%e%'", "1|4"),
    ("SELECT id FROM t WHERE name == 'enzo' OR +id = 2", "2|5"),
    ("SELECT id, score > 10 FROM t WHERE id > 3", "4,NULL|5,false"),
    ("SELECT name FROM t ORDER BY score DESC, name", "clara|bruno|amber|enzo|dalek"),
    ("SELECT id FROM t ORDER BY score LIMIT 3", "4|1|5"),
    ("SELECT id FROM t ORDER BY score DESC LIMIT 2 OFFSET 1", "2|1"),
    ("SELECT id FROM t LIMIT 2 OFFSET 1", "2|3"),
    ("SELECT DISTINCT score FROM t ORDER BY score", "NULL|10.0|20.0|30.0"),
    ("SELECT DISTINCT score FROM t", "10.0|20.0|30.0|NULL"),
    ("SELECT DISTINCT score FROM t ORDER BY name DESC LIMIT 2", "10.0|NULL"),
    ("SELECT COUNT(*), COUNT(score), SUM(score), AVG(score), MIN(name), MAX(score) FROM t", "5,4,70.0,17.5,amber,30.0"),
    ("SELECT COUNT(*), SUM(id), MIN(id) FROM t WHERE id > 99", "0,NULL,NULL"),
    ("SELECT score, COUNT(*) FROM t GROUP BY score", "NULL,1|10.0,2|20.0,1|30.0,1"),
    ("SELECT score, COUNT(*) FROM t GROUP BY score ORDER BY COUNT(*) DESC, score", "10.0,2|NULL,1|20.0,1|30.0,1"),
    ("SELECT id % 2, SUM(id) * 10 + COUNT(*) FROM t GROUP BY id % 2", "0,62|1,93"),
    ("SELECT name FROM t GROUP BY name LIMIT 2", "amber|bruno"),
    ("SELECT id / 2, -id, id * 1.5 FROM t WHERE id = 5", "2,-5,7.5"),
    ("SELECT t.id FROM t WHERE t.name = 'bruno'", "2"),
    ("SELECT 9223372036854775807 + id FROM t WHERE id = 1", "-9223372036854775808"),
    ("SELECT id FROM t WHERE id <> 1 AND 10 / (id - 1) > 4", "2|3"),
]


def test_answers(t):
    for text, want in ANSWERS:
        assert rows(t, text) == want, text


def test_answers_do_not_depend_on_indexes(t):
    t.exec("CREATE INDEX by_name ON t (name)")
    t.exec("CREATE INDEX by_score ON t (score)")
    t.exec("UPDATE t SET score = score WHERE id > 0")
    for text, want in ANSWERS[:12]:
        assert rows(t, text) == want, text
    assert rows(t, "SELECT id FROM t WHERE score < 25.0") == "1|2|5"


def test_column_names(t):
    assert t.exec("SELECT score * 2.0, COUNT(*), t.id AS x FROM t GROUP BY score * 2.0, t.id LIMIT 0").columns == ["score * 2.0", "COUNT(*)", "x"]
    assert t.exec("SELECT 1 AS a, 2 AS a FROM t LIMIT 1").columns == ["a", "a"]
    assert t.exec("SELECT *, id y FROM t LIMIT 0").columns == ["id", "name", "score", "y"]


@pytest.mark.parametrize(
    ("text", "error", "message"),
    [
        ("SELECT * FROM missing", E.TableNotFound, "no such table: missing"), ("SELECT nosuch FROM t", E.ColumnNotFound, "no such column: t.nosuch"), ("SELECT u.id FROM t", E.TableNotFound, "no such table: u"), ("SELECT id FROM t ORDER BY nosuch", E.ColumnNotFound, "t.nosuch"),
        ("INSERT INTO t (nosuch) VALUES (1)", E.ColumnNotFound, "t.nosuch"), ("INSERT INTO t VALUES (1)", E.PlanError, "row 1 has 1 values, table t wants 3"), ("INSERT INTO t (id, id) VALUES (1, 2)", E.PlanError, 'column "id" listed twice'),
        ("SELECT name, COUNT(*) FROM t GROUP BY score", E.PlanError, 'column "name" must appear in the GROUP BY clause'), ("SELECT * FROM t GROUP BY name", E.PlanError, "SELECT * cannot be combined with aggregation"), ("SELECT name FROM t GROUP BY COUNT(*)", E.PlanError, "GROUP BY cannot contain an aggregate"), ("SELECT id FROM t ORDER BY COUNT(*)", E.PlanError, "must appear in the GROUP BY clause"),
        ("CREATE INDEX i ON t (nosuch)", E.ColumnNotFound, "t.nosuch"), ("CREATE INDEX i ON missing (a)", E.TableNotFound, "missing"), ("CREATE TABLE u (a INT)", E.NoPrimaryKey, "PRIMARY KEY"), ("CREATE TABLE t (a INT PRIMARY KEY)", E.TableExists, "table already exists: t"), ("DROP INDEX i", E.IndexNotFound, "no such index: i"),
        ("INSERT INTO t VALUES (1, 'clash', 1.0)", E.DuplicateKey, "duplicate primary key: t.id = 1"), ("INSERT INTO t VALUES (9, 'a', 1.0), (9, 'b', 1.0)", E.DuplicateKey, "t.id = 9"), ("INSERT INTO t VALUES (9, NULL, 1.0)", E.NotNullViolated, "NOT NULL constraint violated: t.name"), ("INSERT INTO t VALUES (NULL, 'x', 1.0)", E.NullKey, "primary key must not be NULL: t.id"),
        ("INSERT INTO t VALUES ('x', 'y', 1.0)", E.TypeMismatch, "cannot store TEXT in a INT column"), ("INSERT INTO t VALUES (1.5, 'y', 1.0)", E.TypeMismatch, "cannot store FLOAT in a INT column"), ("UPDATE t SET score = 'x' WHERE id = 1", E.TypeMismatch, "cannot store TEXT in a FLOAT column"), ("UPDATE t SET name = NULL WHERE id = 1", E.NotNullViolated, "t.name"), ("UPDATE t SET nosuch = 1", E.ColumnNotFound, "t.nosuch"),
        ("SELECT name + 1 FROM t", E.TypeMismatch, "type mismatch"), ("SELECT id / 0 FROM t", E.DivideByZero, "division by zero"), ("SELECT id % 0 FROM t", E.DivideByZero, "division by zero"), ("SELECT score / 0.0 FROM t", E.DivideByZero, "division by zero"), ("SELECT id FROM t WHERE name > 1", E.TypeMismatch, "cannot compare TEXT with INT"), ("SELECT id FROM t WHERE id", E.TypeMismatch, "not a condition"), ("SELECT SUM(name) FROM t", E.TypeMismatch, "SUM wants numbers"), ("SELCT 1", E.SyntaxFault, "syntax error"),
        ("UPDATE t SET id = id + 1", E.DuplicateKey, "t.id = 2"), ("COMMIT", E.NoTransaction, "no transaction is open"), ("ROLLBACK", E.NoTransaction, "no transaction is open"),
    ],
)
def test_errors(shared_t, text, error, message):
    with pytest.raises(error) as e:
        shared_t.exec(text)
    assert message in str(e.value)


@pytest.fixture(scope="module")
def shared_t(spark, tmp_path_factory):
    db = Database.open(spark, f"file://{tmp_path_factory.mktemp('shared')}/db")
    db.exec("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, score FLOAT)")
    db.exec("INSERT INTO t VALUES (3,'clara',30.0), (1,'amber',10.0), (4,'dalek',NULL), (2,'bruno',20.0), (5,'enzo',10.0)")
    yield db
    assert rows(db, "SELECT id, name FROM t") == "1,amber|2,bruno|3,clara|4,dalek|5,enzo"


def test_changes(t):
    assert t.exec("INSERT INTO t (name, id) VALUES ('zoe', 6 + 1)").affected == 1
    assert rows(t, "SELECT * FROM t WHERE id = 7") == "7,zoe,NULL"
    assert t.exec("UPDATE t SET score = id, name = 'x' WHERE score IS NULL").affected == 2
    assert rows(t, "SELECT id, name, score FROM t WHERE name = 'x'") == "4,x,4.0|7,x,7.0"
    assert t.exec("UPDATE t SET id = id + 10").affected == 6
    assert rows(t, "SELECT id FROM t") == "11|12|13|14|15|17"
    assert t.exec("DELETE FROM t WHERE score > 10.0").affected == 2
    assert t.exec("DELETE FROM t WHERE id = 99").affected == 0
    assert t.exec("DELETE FROM t").affected == 4
    assert rows(t, "SELECT COUNT(*) FROM t") == "0"
    assert t.vacuum() > 0 and rows(t, "SELECT id FROM t") == ""


def test_compaction(t):
    for i in range(20, 23):
        t.exec(f"INSERT INTO t VALUES ({i}, 'x', NULL)")
    before = len(t.catalog.get("t").files)
    t.compact("t")
    assert len(t.catalog.get("t").files) < before and rows(t, "SELECT id FROM t") == "1|2|3|4|5|20|21|22"


def test_settings_come_back(spark, t):
    before = spark.conf.get("spark.sql.ansi.enabled")
    workers = [threading.Thread(target=lambda: [t.sql("SELECT id + 1 FROM t") for _ in range(5)]) for _ in range(4)]
    [w.start() for w in workers]
    [w.join() for w in workers]
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_keys_that_move_in_order(t):
    t.exec("UPDATE t SET id = id - 1")
    assert rows(t, "SELECT id FROM t") == "0|1|2|3|4"
    with pytest.raises(E.DuplicateKey, match="t.id = 7"):
        t.exec("UPDATE t SET id = 7 WHERE id > 2")
    t.exec("UPDATE t SET id = 7 WHERE id = 2")
    assert rows(t, "SELECT id, name FROM t WHERE id > 2") == "3,dalek|4,enzo|7,clara"


def test_random_key_moves(db):
    """The set form of the key check against a walk over rows in order."""
    rng = random.Random(5)
    db.exec("CREATE TABLE m (id INT PRIMARY KEY, go BOOL NOT NULL, d INT NOT NULL)")
    for _ in range(6):
        data = {i: (rng.random() < 0.7, rng.choice([-2, -1, 0, 1, 2])) for i in rng.sample(range(9), 5)}
        db.exec("DELETE FROM m")
        db.exec("INSERT INTO m VALUES " + ", ".join(f"({i}, {str(g).upper()}, {d})" for i, (g, d) in data.items()))
        keys, clash = set(data), None
        for i in sorted(data):
            g, d = data[i]
            if g and d:
                if i + d in keys:
                    clash = i + d
                    break
                keys = keys - {i} | {i + d}
        if clash is None:
            db.exec("UPDATE m SET id = id + d WHERE go")
            assert rows(db, "SELECT id FROM m") == "|".join(map(str, sorted(keys)))
        else:
            with pytest.raises(E.DuplicateKey, match=f"m.id = {clash}$"):
                db.exec("UPDATE m SET id = id + d WHERE go")


def test_transactions(t):
    a, b = t.conn(), t.conn()
    a.exec("BEGIN")
    with pytest.raises(E.TransactionOpen):
        a.exec("BEGIN")
    with pytest.raises(E.DDLInTransaction):
        a.exec("CREATE TABLE u (a INT PRIMARY KEY)")
    a.exec("DELETE FROM t WHERE id < 3")
    a.exec("INSERT INTO t VALUES (9, 'new', NULL)")
    a.exec("UPDATE t SET name = 'mine' WHERE id = 9")
    with pytest.raises(E.DuplicateKey):
        a.exec("INSERT INTO t VALUES (20, 'y', NULL), (3, 'x', NULL)")
    assert rows(a, "SELECT id, name FROM t") == "3,clara|4,dalek|5,enzo|9,mine"
    b.exec("UPDATE t SET name = 'theirs' WHERE id = 3")
    assert rows(a, "SELECT name FROM t WHERE id = 3") == "clara"
    assert rows(b, "SELECT id FROM t") == "1|2|3|4|5"
    assert a.in_tx and a.tx.writes == 4
    a.exec("COMMIT")
    assert rows(b, "SELECT id, name FROM t") == "3,theirs|4,dalek|5,enzo|9,mine"
    a.exec("BEGIN")
    a.exec("DELETE FROM t")
    a.exec("ROLLBACK")
    assert rows(a, "SELECT COUNT(*) FROM t") == "4"


def test_last_writer_wins(t):
    a, b = t.conn(), t.conn()
    for c, name in ((a, "first"), (b, "second")):
        c.exec("BEGIN")
        c.exec(f"UPDATE t SET name = '{name}' WHERE id = 1")
    a.exec("COMMIT")
    b.exec("COMMIT")
    assert rows(t, "SELECT name FROM t WHERE id = 1") == "second"


def test_cursor_keeps_its_snapshot(t):
    cursor = t.query("SELECT id FROM t ORDER BY id DESC")
    t.exec("DELETE FROM t WHERE id > 2")
    assert cursor.columns == ["id"] and [r[0] for r in cursor] == [5, 4, 3, 2, 1]
    assert not cursor.next()
    bad = t.query("SELECT 1 / (id - 1) FROM t")
    assert not bad.next() and isinstance(bad.err, E.DivideByZero)
    with pytest.raises(E.Unsupported):
        t.query("DELETE FROM t")


def test_reopening(spark, t):
    t.exec("CREATE INDEX by_name ON t (name)")
    again = Database.open(spark, t.path)
    assert rows(again, "SELECT id FROM t") == "1|2|3|4|5"
    assert again.catalog.names() == ["t"] and again.catalog.has_index("by_name")
    assert again.catalog.get("t").sql() == "CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, score FLOAT);\nCREATE INDEX by_name ON t (name);"


def test_definitions(db):
    db.exec("CREATE TABLE IF NOT EXISTS u (a INT PRIMARY KEY)")
    db.exec("CREATE TABLE IF NOT EXISTS u (b TEXT PRIMARY KEY)")
    db.exec("CREATE INDEX i ON u (a)")
    with pytest.raises(E.IndexExists):
        db.exec("CREATE INDEX i ON u (a)")
    db.exec("CREATE INDEX IF NOT EXISTS i ON u (a)")
    db.exec("CREATE INDEX IF NOT EXISTS j ON missing (c)")
    db.exec("DROP INDEX i")
    db.exec("DROP INDEX IF EXISTS i")
    db.exec("DROP TABLE u")
    db.exec("DROP TABLE IF EXISTS u")
    with pytest.raises(E.TableNotFound):
        db.exec("DROP TABLE u")
    with pytest.raises(E.PlanError, match="defined twice"):
        db.exec("CREATE TABLE v (a INT PRIMARY KEY, a TEXT)")


def test_scripts_stop_at_the_first_error(t):
    with pytest.raises(E.TableNotFound) as e:
        t.exec_script("DELETE FROM t WHERE id = 1; SELECT * FROM missing; DELETE FROM t")
    assert [r.tag for r in e.value.results] == ["DELETE"]
    assert rows(t, "SELECT COUNT(*) FROM t") == "4"
    assert [r.tag for r in t.exec_script("BEGIN; COMMIT;; SELECT id FROM t")] == ["BEGIN", "COMMIT", "SELECT"]


def test_plans(spark, t, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id % 7 AS v", "string(id) AS s").write.parquet(f"{tmp_path}/x.parquet")
    t.register("x", f"{tmp_path}/x.parquet", "k")
    plan = t.exec("EXPLAIN SELECT s FROM x WHERE k BETWEEN 5 AND 9").plan
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k,5), LessThanOrEqual(k,9)]" in plan and "ReadSchema: struct<k:bigint,s:string>" in plan
    assert "TakeOrderedAndProject" in t.exec("EXPLAIN SELECT k FROM x ORDER BY v LIMIT 3 OFFSET 1").plan
    assert "ReadSchema: struct<>" in t.exec("EXPLAIN SELECT COUNT(*) FROM x").plan
    assert "partial_count" in t.exec("EXPLAIN SELECT v, COUNT(*) FROM x GROUP BY v").plan
    assert "Exchange" not in t.sql("SELECT k FROM x WHERE v = 1")._jdf.queryExecution().executedPlan().toString()
    assert t.exec("EXPLAIN SELECT id FROM t").columns == ["plan"]
    assert t.exec("EXPLAIN DELETE FROM t WHERE id = 1").plan.startswith("DELETE t") and rows(t, "SELECT COUNT(*) FROM t") == "5"
    assert t.exec("EXPLAIN CREATE TABLE z (a INT PRIMARY KEY)").plan == "CREATE TABLE z"
    with pytest.raises(E.ReadOnly):
        t.exec("DELETE FROM x")


def test_hidden_columns(spark, db):
    db.register("e", spark.sql("SELECT 1 AS id, timestamp'2020-01-01' AS ts, array(1) AS a, tinyint(3) AS n"), "id")
    assert db.exec("SELECT * FROM e").rows == [(1, 3)]
    with pytest.raises(E.Unsupported):
        db.exec("SELECT ts FROM e")


def test_values_of_all_kinds(db):
    db.exec("CREATE TABLE v (id INT PRIMARY KEY, b BOOL, f FLOAT, s TEXT)")
    db.exec(r"INSERT INTO v VALUES (1, TRUE, -0.0, '100%'), (2, FALSE, 0.0, 'a\\b'), (3, NULL, 1e300 * 1e300 - 1e300 * 1e300, 'x_y'), (4, TRUE, 1e300 * 1e300, 'héllo'), (5, NULL, NULL, NULL)")
    assert rows(db, "SELECT MIN(b), MAX(b), COUNT(b) FROM v") == "false,true,3"
    assert rows(db, "SELECT f, COUNT(*) FROM v GROUP BY f") in ("NULL,1|0.0,2|+Inf,1|NaN,1", "NULL,1|-0.0,2|+Inf,1|NaN,1")
    assert rows(db, "SELECT id FROM v ORDER BY f DESC") == "3|4|1|2|5"
    assert rows(db, r"SELECT id FROM v WHERE s LIKE '%\\%'") == "2"
    assert rows(db, "SELECT id FROM v WHERE s LIKE 'h_llo' OR s LIKE s AND id = 3") == "3|4"
    assert rows(db, "SELECT id FROM v WHERE b") == "1|4"


PREDICATES = ["id = {x}", "id > {x}", "id <= {x}", "id BETWEEN {x} AND {y}", "k = {x}", "k > {x}", "k < {x}", "k <= {x}", "k BETWEEN {x} AND {y}", "k IS NULL", "k IS NOT NULL", "s LIKE 'c%'", "s LIKE '%{c}_'", "k IN ({x}, {y})", "k NOT IN ({x}, NULL)", "id > {x} AND k = {y}", "id < {x} OR k IS NULL", "NOT (k = {x})", "f > {x} OR f / 2.0 < {y}", "k % 3 = 1 AND NOT f IS NULL"]


def test_against_a_model(db):
    """Random rows and predicates: many predicates are columns of one query."""
    rng = random.Random(20)
    db.exec("CREATE TABLE r (id INT PRIMARY KEY, k INT, s TEXT NOT NULL, f FLOAT)")
    db.exec("CREATE INDEX r_k ON r (k)")
    some = lambda make: None if rng.random() < 0.25 else make()
    data = [{"id": i, "k": some(lambda: rng.randrange(60)), "s": "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))), "f": some(lambda: rng.randrange(-100, 100) / 4)} for i in rng.sample(range(60), 40)]
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    db.exec("INSERT INTO r VALUES " + ", ".join("(" + ", ".join(lit(x[c]) for c in ("id", "k", "s", "f")) + ")" for x in data))
    for _ in range(4):
        tests = [p.format(x=rng.randrange(60), y=rng.randrange(60), c=rng.choice("abcd")) for p in PREDICATES]
        exprs = [parse_expr(p) for p in tests]
        got = db.exec("SELECT id, " + ", ".join(f"{p} AS p{i}" for i, p in enumerate(tests)) + " FROM r").rows
        want = [(x["id"], *(evaluated(e, x) for e in exprs)) for x in sorted(data, key=lambda x: x["id"])]
        assert got == want
        where = rng.choice(tests)
        e = parse_expr(where)
        assert db.exec(f"DELETE FROM r WHERE {where}").affected == sum(evaluated(e, x) is True for x in data)
        data = [x for x in data if evaluated(e, x) is not True]
        assert [r[0] for r in db.exec("SELECT id FROM r").rows] == sorted(x["id"] for x in data)


def test_writers_in_threads(db):
    db.exec("CREATE TABLE c (id INT PRIMARY KEY, k INT)")
    db.exec("INSERT INTO c VALUES " + ", ".join(f"({i}, {i % 5})" for i in range(20)))
    failed = []

    def write(w):
        try:
            for i in range(3):
                db.exec(f"INSERT INTO c VALUES ({1000 + 100 * w + i}, {w})")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    def look():
        cursor = db.conn()
        cursor.exec("BEGIN")
        first = rows(cursor, "SELECT COUNT(*) FROM c")
        if rows(cursor, "SELECT COUNT(*) FROM c") != first:
            failed.append("a snapshot moved")

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)] + [threading.Thread(target=look) for _ in range(2)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and rows(db, "SELECT COUNT(*) FROM c") == "29"


def test_shell(t):
    out = io.StringIO()
    shell = Shell(t.conn(), out)
    shell.loop(["SELECT id\n", "FROM t LIMIT 1;\n", ".tables\n", ".schema t\n", "INSERT INTO t VALUES (8, 'h', 1.0);\n", "SELECT nosuch FROM t;\n", ".explain on\n", ".nosuch\n", "DELETE FROM t WHERE id = 8;\n", ".quit\n", "SELECT 2\n"])
    text = out.getvalue()
    assert text.startswith("+----+\n| id |\n+----+\n| 1  |\n+----+\n-- 1 row\nt\nCREATE TABLE t (")
    assert "-- INSERT 1\n" in text and "error: tessera: no such column: t.nosuch\n" in text and "unknown command .nosuch" in text and "-- DELETE 1\n" in text and "Physical Plan" in text


def test_deep_expressions_run(t):
    assert rows(t, f"SELECT id FROM t WHERE {' OR '.join(['id = 2'] * 3000)}") == "2"
    assert rows(t, f"SELECT id FROM t WHERE {'(' * 3000}id = 2{')' * 3000} AND {' AND '.join(['id < 9'] * 500)}") == "2"
    assert rows(t, f"SELECT id FROM t WHERE {'NOT ' * 601}(id = 2)") == "1|3|4|5"
    assert rows(t, f"SELECT {'- ' * 1000}id, {' + '.join(['id'] * 1000)}, id {'- 1 ' * 1000} FROM t WHERE id = 2") == "2,2000,-998"
    assert rows(t, f"SELECT {' + '.join(['score'] * 100)} FROM t WHERE id = 1") == "1000.0"
    with pytest.raises(E.Unsupported, match="nested operations"):
        t.exec(f"SELECT {' + '.join(['score'] * 5000)} FROM t")
    with pytest.raises(E.TypeMismatch):
        t.exec(f"SELECT id FROM t WHERE {'NOT ' * 10}id")


def test_two_databases_on_a_folder(spark, tmp_path):
    a, b = (Database.open(spark, f"file://{tmp_path}/shared") for _ in range(2))
    a.exec("CREATE TABLE n (id INT PRIMARY KEY)")
    b.exec("INSERT INTO n VALUES (1)")
    conn = a.conn()
    conn.exec("BEGIN")
    conn.exec("INSERT INTO n VALUES (2)")
    b.exec("INSERT INTO n VALUES (3)")
    assert rows(conn, "SELECT id FROM n") == "1|2"
    conn.exec("COMMIT")
    for db in (a, b, Database.open(spark, f"file://{tmp_path}/shared")):
        assert rows(db, "SELECT id FROM n") == "1|2|3"
    workers = [threading.Thread(target=lambda db=db, k=k: [db.exec(f"INSERT INTO n VALUES ({k + i})") for i in range(3)]) for k, db in ((100, a), (200, b))]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert rows(a, "SELECT COUNT(*) FROM n") == "9"


def test_a_broken_claim_does_not_lose_commits(spark, tmp_path):
    a, b = (Database.open(spark, f"file://{tmp_path}/shared") for _ in range(2))
    a.exec("CREATE TABLE n (id INT PRIMARY KEY)")
    with a.writing():
        a.store.files.drop("manifest.lock")  # as if it had been left behind
        b.exec("INSERT INTO n VALUES (1)")
        with pytest.raises(E.Busy):
            a.store.publish(a.store.catalog)
    assert rows(a, "SELECT id FROM n") == "1"


def test_an_index_reaches_present_rows(t):
    before = t.catalog.get("t").files
    t.exec("CREATE INDEX late ON t (name)")
    after = t.catalog.get("t").files
    assert after and not set(before) & set(after)
    assert rows(t, "SELECT id FROM t WHERE name = 'bruno'") == "2"
