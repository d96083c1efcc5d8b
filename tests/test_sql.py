"""Grammar, facade and store."""

import pytest

from tidelog.api import Store
from tidelog.errors import ChronicleExists, InvalidArgument, NotExist
from tidelog.plans.sql import SqlTables
from tidelog.plans.statements import Between, Create, Drop, Equals, Insert, Select, parse


def test_statements():
    assert parse("create table Users (Id INT, name varchar(20), x)") == Create("users", [("id", "INT"), ("name", "STRING"), ("x", "STRING")])
    assert parse("DROP TABLE t;") == Drop("t")
    assert parse("INSERT INTO t (a, b) VALUES ('it''s', -5)") == Insert("t", ["a", "b"], ["it's", "-5"])
    assert parse("INSERT INTO t VALUES (NULL, +5, 1.50)") == Insert("t", None, [None, "+5", "1.50"])
    assert parse("SELECT * FROM t") == Select("t", None)
    assert parse("SELECT a, B FROM t WHERE a = NULL") == Select("t", ["a", "b"], Equals("a", None))
    assert parse("SELECT a FROM t WHERE __ts BETWEEN 3 AND 9") == Select("t", ["a"], Between(3, 9))
    assert parse("SELECT a FROM t WHERE __ts = 5").where == Equals("__ts", "5")


@pytest.mark.parametrize("sql", ["UPDATE t SET a = 1", "SELECT a FROM t extra", "INSERT INTO t VALUES (TRUE)", "SELECT a FROM t WHERE a = 1e5", "CREATE TABLE t ()", "SELECT FROM t", "", "SELECT a FROM t WHERE a > 1", "CREATE TABLE t (a blob)"])
def test_refused(sql):
    with pytest.raises(InvalidArgument):
        parse(sql)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def test_tables(store):
    db = SqlTables(store)
    db.execute("CREATE TABLE users (id INT, name STRING, region STRING)")
    db.execute("CREATE TABLE orders (id INT)")
    assert db.tables() == ["users", "orders"]
    first = db.execute("INSERT INTO users VALUES (1, 'Ann', 'us-east')")
    last = db.execute("INSERT INTO users (id, name, id) VALUES (2, NULL, 7)")
    assert [r.asDict() for r in db.execute("SELECT * FROM users").collect()] == [
        {"__ts": first, "id": "1", "name": "Ann", "region": "us-east"},
        {"__ts": last, "id": "2", "name": None, "region": None},
    ]
    count = lambda where: db.execute(f"SELECT id FROM users WHERE {where}").count()
    assert (count("id = 1"), count("id = '1'"), count("name = NULL"), count("nosuch = 3")) == (1, 1, 1, 0)
    assert count(f"__ts BETWEEN {first} AND {last}") == 2 and count(f"__ts BETWEEN {first} AND {first}") == 1
    for sql in ("CREATE TABLE users (a)", "CREATE TABLE __x (a)", "CREATE TABLE y (a, a)", "DROP TABLE nosuch", "INSERT INTO users (nosuch) VALUES (1)", "SELECT * FROM nosuch", f"SELECT id FROM users WHERE __ts BETWEEN {last} AND {first}"):
        with pytest.raises(InvalidArgument):
            db.execute(sql)
    db.execute("DROP TABLE users")
    assert db.tables() == ["orders"]
    db.execute("CREATE TABLE users (id INT)")
    assert db.tables() == ["users", "orders"] and db.execute("SELECT * FROM users").count() == 2


def test_store(store):
    with pytest.raises(InvalidArgument):
        store.create_chronicle("")
    store.create_chronicle("c")
    with pytest.raises(ChronicleExists):
        store.create_chronicle("c")
    with pytest.raises(NotExist):
        store.acquire_story("nosuch", "s")
    s = store.acquire_story("c", "s")
    assert store.acquire_story("c", "s") is s and store.show_stories("c") == ["s"]
    at = [s.log_event(f"r{i}") for i in range(5)]
    assert s.log_event("") == 0 and s.log_event_durable("r5") > at[-1]
    assert [r["record"] for r in store.replay("c", "s", at[1], at[3]).collect()] == ["r1", "r2"]
    assert [r["record"] for r in s.playback(2).collect()] == ["r4", "r5"]
    assert store.playback_report("c", "s", 3)["total_events"] == 3
    store.release_story("c", "s")
    store.destroy_story("c", "s")
    assert store.show_stories("c") == [] and store.replay("c", "s").count() == 0
    store.acquire_story("c", "s").log_event_durable("again")
    assert [r["record"] for r in store.replay("c", "s").collect()] == ["again"]
    store.destroy_chronicle("c")
    assert store.show_chronicles() == []


def test_values(store):
    t = store.put("k", "one")
    store.put("k", "two")
    from tidelog.operators import kv

    values = store.values()
    assert kv.get(values, "k", t).head()["value"] == "one" and kv.latest(values).head()["value"] == "two"
    assert store.publish("topic", "") == 0 and store.publish("topic", "x") > 0


def test_shell_and_tools(store, spark, tmp_path):
    from tidelog.cli import Shell
    from tidelog.operators.catalog import find_variable

    shell = Shell(store)
    assert shell.run("-c c") == ["ok"] and shell.run("-a c s") == ["ok"]
    at = int(shell.run("-w hello world")[0])
    assert shell.run("-p 5") == [f"{at} hello world"] and shell.run(f"-r {at} {at + 1}") == [f"{at} hello world"]
    assert shell.run("-l") == ["c"] and shell.run("-l c") == ["s"]
    store.record_interaction("c", "chat", "hi", "hello")
    store.retrieve("c", "chat", str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["user: hi, assistant: hello"]
    samples = spark.createDataFrame([(5 * 10**9 + 7_000, "node 1/a", "i", "load", {"k": 1.5, "bad": float("nan")})], "ts_ns long, producer string, instance string, schema string, metrics map<string,double>")
    store.store_metrics(samples, "metrics")
    row = store.replay("metrics", "load_node_1_a").head()
    assert row["event_time"] == 5 * 10**9 + 7_000 and '"timestamp":"5.000007"' in row["record"] and '"bad":null' in row["record"]
    assert [r["value"] for r in find_variable(store.log(), "*").collect()] == ["c", "metrics"]
    assert [r["value"] for r in find_variable(store.log(), "stories(c)").collect()] == ["chat", "s"]
    assert store.query_report("c", "s", 1, at + 1)["total_events"] == 1
    assert shell.run("-d c") == ["ok"] and shell.run("-l") == [] and shell.run("-disconnect") is None


def test_manifest(spark, tmp_path):
    from tidelog.sources.manifest import files_to_read, read_manifest, stream_manifest

    lines = [
        '{"op":"PUBLISH","chronicle":"c","story":"s","file":"a","writer_start":1,"incarnation":1,"start":0,"end":10}',
        '{"op":"PUBLISH","chronicle":"c","story":"s","file":"b","writer_start":1,"incarnation":3,"start":10,"end":20}',
        '{"op":"PUBLISH","chronicle":"c","story":"t","file":"x","writer_start":1,"incarnation":3,"start":10,"end":20}',
        '{"op":"DELETE","chronicle":"c","story":"s","writer_start":1,"incarnation_bound":2}',
        '{"op":"PUBL',
    ]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/log.json").write_text("\n".join(lines))
    m = read_manifest(spark, str(tmp_path / "m"))
    assert m.count() == 4
    names = lambda lo, hi: sorted(r["file"] for r in files_to_read(m, "c", "s", lo, hi).collect())
    assert names(0, 30) == ["b"] and names(0, 10) == [] and names(19, 20) == ["b"]
    assert stream_manifest(spark, str(tmp_path / "m")).isStreaming
