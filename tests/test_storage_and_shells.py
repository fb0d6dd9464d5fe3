import json
import sqlite3
import threading
import urllib.error
import urllib.request

import pytest

from cellgrain import Engine, cli
from cellgrain.catalog import Cube, check_budget, choose_layout
from cellgrain.doctor import checks
from cellgrain.rest import Service
from cellgrain.streaming import cubes


@pytest.fixture(scope="module")
def small(spark):
    e = Engine(spark)
    e.load_frame({"customer": [1, 1, 2, None], "day": [1, 2, 2, 3], "q": [1.0, 2.0, 5.0, 7.0]}, ["customer", "day"], "q", "sales", ordered_dims=["day"])
    e.load_dimension({"customer": [1, 2, 2], "region": ["n", "x", "s"], "limit_": [5.0, 1.0, 9.0]}, "customer", attributes=["region"], measures=["limit_"])
    e.add_hierarchy("day", "week", {1: "w1", 2: "w1", 3: "w2"})
    e.grant("one", "customer", [1], permissive=False)
    e.grant("one", "day")
    return e


QUERY = "SELECT week, SUM(q * limit_) AS x, COUNT(*) AS n FROM sales WHERE region IN ('n', 's') GROUP BY week"


def test_save_and_open(spark, small, tmp_path):
    small.save(str(tmp_path / "db"), partition_by=["day"])
    again = Engine.open(spark, str(tmp_path / "db"))
    assert again.sql(QUERY).rows == small.sql(QUERY).rows == [("w1", 5.0 + 10.0 + 45.0, 3)]
    assert again.catalog.roles["one"].permissive is False and again.sql("SELECT SUM(q) FROM sales", "one").rows == [(3.0,)]
    assert again.catalog.dimension("customer").labels() == [1, 2, None]
    assert again.sql("SELECT customer, COUNT(*) AS n FROM sales GROUP BY customer").rows == [(1, 2), (2, 1), (None, 1)]


def test_dictionaries_only_grow(spark):
    e = Engine(spark)
    e.load_frame({"d": [10, 20, 30], "v": [1.0, 1.0, 1.0]}, ["d"], "v", "a")
    e.load_frame({"d": [5, 40, 20], "v": [1.0, 1.0, 1.0]}, ["d"], "v", "b")
    d = e.catalog.dimension("d")
    assert d.labels() == [10, 20, 30, 5, 40] and d.ordinal(5) == 3 and d.label(0) == 10 and 40 in d and 41 not in d and len(d) == 5
    with pytest.raises(KeyError):
        d.ordinal(99)
    assert e.load_frame({"d": [1], "v": [2.0]}, ["d"], "v", "a").version == 2
    with pytest.raises(KeyError):
        d.encode(spark.createDataFrame([(77,)], "d long"))


def test_load_errors(spark):
    e = Engine(spark)
    with pytest.raises(KeyError):
        e.load_frame({"d": [1]}, ["d"], "missing")
    with pytest.raises(ValueError):
        e.load_frame({"d": [1], "v": [1.0]}, ["d"], "v", agg="median")
    e.load_frame({"d": [1, 2], "v": [1.0, 2.0]}, ["d"], "v", "f")
    with pytest.raises(KeyError):
        e.add_hierarchy("d", "p", {1: "a"})
    with pytest.raises(ValueError):
        e.add_cube(Cube("g", "v", ["nope"], e.cube("f").cells))
    e.add_hierarchy("d", "p", ["a", "b"])
    assert e.sql("SELECT p, SUM(v) AS s FROM f GROUP BY p").rows == [("a", 1.0), ("b", 2.0)]


def test_stats_and_policy(small):
    s = small.stats("sales")
    assert s["nnz"] == 4 and s["total_cells"] == 9 and 0 < s["fill_factor"] < 1 and "sales" in small.summary()
    assert choose_layout(10, 10_000_000, 3) == "sparse_coo" and choose_layout(90, 100, 2) == "dense"
    with pytest.raises(MemoryError):
        check_budget(1, 1 << 40, 2, "dense")


def test_database_scan(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE f (a INT, v REAL)")
    con.executemany("INSERT INTO f VALUES (?, ?)", [(i % 3, float(i)) for i in range(10)])
    e = Engine(spark)
    e.load_sql("SELECT a, v FROM f WHERE v > 2", con, ["a"], "v", "f")
    assert e.sql("SELECT a, SUM(v) AS s FROM f GROUP BY a").rows == [(0, 18.0), (1, 11.0), (2, 13.0)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "sales.csv").write_text("customer,date,quantity\n1,1,2.5\n1,2,1\n2,2,4\n", encoding="utf-8")
    (tmp_path / "customers.csv").write_text("customer,region\n1,юг\n2,север\n", encoding="utf-8")
    (tmp_path / "dates.csv").write_text("date,month\n1,M1\n2,M2\n", encoding="utf-8")

    def run(db, *args, code=0):
        assert cli.main(["--db", str(tmp_path / db), *args]) == code
        return capsys.readouterr()

    run("a", "load", str(tmp_path / "sales.csv"), "--dims", "customer,date", "--measure", "quantity", "--name", "sales", "--out", str(tmp_path / "b"))
    run("b", "load", str(tmp_path / "customers.csv"), "--key", "customer", "--attributes", "region", "--out", str(tmp_path / "c"))
    assert "hierarchy date -> month" in run("c", "hierarchy", str(tmp_path / "dates.csv"), "--child", "date", "--parent", "month", "--out", str(tmp_path / "d")).out
    out = run("d", "--format", "csv", "query", "SELECT month, SUM(quantity) AS s FROM sales WHERE region = 'юг' GROUP BY month").out
    assert out == "month,s\nM1,2.5\nM2,1.0\n"
    assert json.loads(run("d", "--format", "json", "query", "SELECT COUNT(*) AS n FROM sales").out) == [{"n": 3}]
    assert "frame sales" in run("d", "explain", "SELECT SUM(quantity) FROM sales").out and "[" in run("d", "decompose", "SELECT SUM(quantity) FROM sales").out
    assert '"nnz": 3' in run("d", "info").out and "laws" in run("d", "signature").out and "pyspark" in run("d", "doctor").out
    assert "QuerySyntaxError" in run("d", "query", "SELECT", code=2).err and "KeyError" in run("d", "query", "SELECT SUM(x) FROM sales", code=3).err
    said = []
    lines = iter([r"\i", "SELECT COUNT(*) AS n FROM sales", "SELECT nope", r"\e SELECT COUNT(*) AS n FROM sales", r"\s SELECT COUNT(*) AS n FROM sales", r"\q"])
    cli.shell(cli.parser().parse_args(["--db", str(tmp_path / "d"), "shell"]), lambda _: next(lines), said.append)
    assert len(said) == 5 and "BindError" in said[2]


def test_service(small):
    service = Service(small)
    assert service.handle("GET", "/health") == (200, {"status": "ok"})
    assert service.handle("GET", "/catalog")[1]["cubes"] == {"sales": ["customer", "day"]} and service.handle("GET", "/cube/sales")[1]["nnz"] == 4
    status, answer = service.handle("POST", "/query", {"sql": "SELECT SUM(q) AS s FROM sales"}, {"X-Role": "one"})
    assert status == 200 and answer["rows"] == [[3.0]] and answer["row_count"] == 1
    assert [service.handle("POST", "/query", {"sql": s})[0] for s in ("SELECT", "SELECT SUM(nope) FROM sales", "SELECT SUM(q) FROM x")] == [400, 404, 400]
    small.grant("shut", "week", permissive=False)
    assert service.handle("POST", "/explain", {"sql": "SELECT SUM(q) FROM sales", "role": "shut"})[0] == 403
    assert service.handle("POST", "/query", {})[0] == 400 and service.handle("GET", "/nowhere")[0] == 404 and service.handle("GET", "/cube/none")[0] == 404
    server = service.server(port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert json.load(urllib.request.urlopen(f"{url}/health")) == {"status": "ok"}
        request = urllib.request.Request(f"{url}/query", json.dumps({"sql": "SELECT COUNT(*) AS n FROM sales"}).encode(), {"Content-Type": "application/json"})
        assert json.load(urllib.request.urlopen(request))["rows"] == [[4]]
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(urllib.request.Request(f"{url}/query", b"not json"))
    finally:
        server.shutdown()


def test_doctor(spark):
    assert all(good for _, good, _ in checks(spark))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, float(i), i) for i in range(30)], "a long, v double, n long").repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cube, mark = str(tmp_path / "cube"), str(tmp_path / "mark")
    first = {r["a"]: (r["value"], r["__rows"]) for r in cubes.maintain(stream(), ["a"], "v", cube, mark).collect()}
    assert first == {0: (135.0, 10), 1: (145.0, 10), 2: (155.0, 10)}
    rows.where("n < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = {r["a"]: (r["value"], r["__rows"]) for r in cubes.maintain(stream(), ["a"], "v", cube, mark).collect()}
    assert again == {0: (135.0, 11), 1: (146.0, 11), 2: (157.0, 11)}  # only what is new was taken in
    cubes.compact(spark, cube, ["a"], str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 3
    query = cubes.live(stream(), ["a"], "v").writeStream.format("memory").queryName("live_cube").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["a"]: r["value"] for r in spark.table("live_cube").collect()} == {0: 135.0, 1: 146.0, 2: 157.0}
