import duckdb
import numpy as np
import pandas as pd
import pytest

from cellgrain import AccessDenied, BindError, Engine

N = 4000


@pytest.fixture(scope="module")
def frames():
    r = np.random.default_rng(11)
    sales = pd.DataFrame({"customer": r.integers(0, 12, N), "product": r.integers(0, 6, N), "date": r.integers(0, 12, N), "quantity": r.random(N).round(3)})
    products = pd.DataFrame({"product": range(6), "category": ["A", "B"] * 3, "price": (r.random(6) * 10).round(2)})
    customers = pd.DataFrame({"customer": range(12), "region": ["север", "юг", "запад"] * 4})
    plan = pd.DataFrame({"product": r.integers(0, 6, 300), "period": r.integers(0, 12, 300), "w": r.random(300).round(3)})
    return sales, products, customers, plan


@pytest.fixture(scope="module")
def engine(spark, frames):
    sales, products, customers, plan = frames
    e = Engine(spark, cache=True)
    e.load_frame(sales, ["customer", "product", "date"], "quantity", "sales", ordered_dims=["date"])
    e.load_dimension(products, "product", attributes=["category"], measures=["price"])
    e.load_dimension(customers, "customer", attributes=["region"])
    e.add_hierarchy("date", "month", {d: f"M{d // 3}" for d in range(12)}, True)
    e.add_hierarchy("month", "half", {f"M{i}": f"H{i // 2}" for i in range(4)})
    e.load_frame(plan, ["product", "period"], "w", "plan", ordered_dims=["period"])
    return e


@pytest.fixture(scope="module")
def con(frames):
    sales, products, customers, plan = frames
    flat = sales.merge(products, on="product").merge(customers, on="customer")
    flat["month"], flat["half"] = flat.date.map(lambda d: f"M{d // 3}"), flat.date.map(lambda d: f"H{d // 6}")
    c = duckdb.connect()
    c.register("flat", flat), c.register("plan", plan), c.register("sales", sales)
    c.execute("CREATE VIEW cells AS SELECT customer, product, date, sum(quantity) AS v, count(*) AS n FROM sales GROUP BY ALL")
    return c


def same(got: pd.DataFrame, want: pd.DataFrame):
    cols = list(got.columns)
    assert sorted(cols) == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


CASES = [
    ("SELECT SUM(quantity) AS s FROM sales", "SELECT sum(quantity) AS s FROM flat"),
    ("SELECT customer, month, SUM(quantity*price) AS rev FROM sales JOIN product ON sales.product=product.product WHERE region='юг' GROUP BY customer, month", "SELECT customer, month, sum(quantity*price) AS rev FROM flat WHERE region='юг' GROUP BY ALL"),
    ("SELECT half, AVG(quantity) a, COUNT(*) n, COUNT(DISTINCT customer) d FROM sales GROUP BY half", "SELECT half, avg(quantity) a, count(*) n, count(DISTINCT customer) d FROM flat GROUP BY ALL"),
    ("SELECT month, MAX(quantity) m, MIN(quantity) k FROM sales WHERE category='B' GROUP BY month", "SELECT 'M' || (date // 3) AS month, max(v) m, min(v) k FROM cells WHERE product % 2 = 1 GROUP BY ALL"),
    ("SELECT product, SUM(CASE WHEN region='север' THEN quantity WHEN date >= 6 THEN quantity*2 ELSE 1 END) x FROM sales GROUP BY product", "SELECT product, sum(CASE WHEN region='север' THEN quantity WHEN date >= 6 THEN quantity*2 ELSE 1 END) x FROM flat GROUP BY ALL"),
    ("SELECT month, SUM(quantity) s FROM sales WHERE NOT (region='север' OR category='A') AND date BETWEEN 2 AND 9 AND customer IN (SELECT customer FROM customer WHERE region <> 'запад') GROUP BY month HAVING s > 1 ORDER BY s DESC LIMIT 2", "SELECT month, sum(quantity) s FROM flat WHERE NOT (region='север' OR category='A') AND date BETWEEN 2 AND 9 AND region <> 'запад' GROUP BY ALL HAVING s > 1 ORDER BY s DESC LIMIT 2"),
    ("SELECT product, SUM(quantity*w) x, COUNT(*) n, SUM(quantity) q, SUM(w) ww FROM sales JOIN plan GROUP BY product", "SELECT product, x, n, q, ww FROM (SELECT product, sum(quantity*w) x, count(*) n FROM sales JOIN plan USING (product) GROUP BY ALL) JOIN (SELECT product, sum(quantity) q FROM sales GROUP BY ALL) USING (product) JOIN (SELECT product, sum(w) ww FROM plan GROUP BY ALL) USING (product)"),
    ("SELECT date, SUM(quantity*w) x, COUNT(*) n FROM sales JOIN plan ON sales.date <= plan.period WHERE category='A' GROUP BY date", "SELECT date, sum(quantity*w) x, count(*) n FROM flat JOIN plan ON flat.product=plan.product AND flat.date <= plan.period WHERE category='A' GROUP BY ALL"),
    ("SELECT product, date, SUM(quantity) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) w, AVG(quantity) OVER (PARTITION BY product ORDER BY date) a, MAX(quantity) OVER (ORDER BY date) m FROM sales GROUP BY product, date", "SELECT product, date, sum(s) OVER (PARTITION BY product ORDER BY date RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) w, sum(s) OVER p / sum(k) OVER p a, max(v) OVER p m FROM (SELECT product, date, sum(v) s, sum(n) k, max(v) v FROM cells GROUP BY ALL) WINDOW p AS (PARTITION BY product ORDER BY date)"),
    ("SELECT DISTINCT product, half FROM sales WHERE region='запад'", "SELECT DISTINCT product, half FROM flat WHERE region='запад'"),
    ("SELECT SUM(quantity*quantity) s, AVG(quantity*quantity) a FROM sales", "SELECT sum(v*v) s, sum(v*v)/sum(n) a FROM cells"),
    ("SELECT product, SUM(price) p, COUNT(*) n FROM product GROUP BY product", "SELECT product, max(price) p, 1 n FROM flat GROUP BY ALL"),
    ("SELECT COUNT(CASE WHEN region='юг' THEN 1 END) k, AVG(CASE WHEN region='юг' THEN quantity END) a, AVG(CASE WHEN region='юг' THEN quantity ELSE 0 END) z, SUM(2) two FROM sales", "SELECT count(CASE WHEN region='юг' THEN 1 END) k, avg(CASE WHEN region='юг' THEN quantity END) a, avg(CASE WHEN region='юг' THEN quantity ELSE 0 END) z, 2*count(*) two FROM flat"),
    ("SELECT SUM(quantity) s, COUNT(*) n, AVG(quantity) a, MAX(quantity) m FROM sales WHERE customer = 77", "SELECT 0.0 s, 0 n, 0.0 a, 0.0 m"),
    ("SELECT SUM(quantity) / (COUNT(*) - COUNT(*)) z FROM sales", "SELECT 0.0 z"),
    ("SELECT customer c, 1 AS one, -SUM(quantity) neg FROM sales GROUP BY customer", "SELECT customer c, 1.0 one, -sum(quantity) neg FROM flat GROUP BY ALL"),
    ("SELECT SUM(quantity * price * price) s FROM sales WHERE half = 'H1'", "SELECT sum(quantity*price*price) s FROM flat WHERE half='H1'"),
]


@pytest.mark.parametrize(("query", "oracle"), CASES, ids=[q[:60] for q, _ in CASES])
def test_against_duckdb(engine, con, query, oracle):
    same(engine.sql(query).to_pandas(), con.sql(oracle).df())


NULLS = [
    ("SELECT product, SUM(q) s, COUNT(*) n, COUNT(q) k FROM f GROUP BY product", "SELECT product, coalesce(sum(q), 0) s, count(*) n, count(q) k FROM t GROUP BY ALL"),
    ("SELECT customer, COUNT(*) n FROM f WHERE product IS NULL GROUP BY customer", "SELECT customer, count(*) n FROM t WHERE product IS NULL GROUP BY ALL"),
    ("SELECT customer, AVG(q) a FROM f WHERE product IS NOT NULL GROUP BY customer", "SELECT customer, avg(q) a FROM t WHERE product IS NOT NULL GROUP BY ALL"),
    ("SELECT COUNT(*) n FROM f WHERE product <> 1", "SELECT count(*) n FROM t WHERE product <> 1"),
    ("SELECT COUNT(*) n FROM f WHERE NOT product = 1", "SELECT count(*) n FROM t WHERE NOT product = 1"),
    ("SELECT COUNT(*) n FROM f WHERE product NOT IN (1, 2)", "SELECT count(*) n FROM t WHERE product NOT IN (1, 2)"),
    ("SELECT COUNT(*) n FROM f WHERE NOT (product IS NOT NULL)", "SELECT count(*) n FROM t WHERE product IS NULL"),
    ("SELECT COUNT(*) n FROM f WHERE NOT (product = 1 AND customer = 2)", "SELECT count(*) n FROM t WHERE NOT (product = 1 AND customer = 2)"),
    ("SELECT COUNT(*) n FROM f WHERE product = 1 OR customer > 2", "SELECT count(*) n FROM t WHERE product = 1 OR customer > 2"),
    ("SELECT COUNT(DISTINCT product) d FROM f", "SELECT count(DISTINCT product) d FROM t"),
    ("SELECT SUM(CASE WHEN product = 1 THEN q ELSE 10 END) s FROM f", "SELECT sum(CASE WHEN product = 1 THEN coalesce(q, 0) ELSE 10 END) s FROM t"),
]


@pytest.mark.parametrize(("query", "oracle"), NULLS)
def test_nulls(spark, query, oracle):
    r = np.random.default_rng(5)
    t = pd.DataFrame({"customer": r.integers(0, 5, 1500), "product": r.integers(0, 4, 1500).astype(float), "q": r.random(1500).round(3)})
    t.loc[r.choice(1500, 270, replace=False), "product"] = np.nan
    t.loc[r.choice(1500, 210, replace=False), "q"] = np.nan
    e = Engine(spark)
    e.load_frame(t, ["customer", "product"], "q", "f")
    c = duckdb.connect()
    c.execute("CREATE TABLE t AS SELECT customer, CASE WHEN isnan(product) THEN NULL ELSE product END product, CASE WHEN isnan(q) THEN NULL ELSE q END q FROM t")
    same(e.sql(query).to_pandas(), c.sql(oracle).df())


@pytest.mark.parametrize(
    ("query", "error"),
    [
        ("SELECT SUM(quantity) FROM nowhere", BindError), ("SELECT customer FROM sales", BindError), ("SELECT region, SUM(quantity) FROM sales GROUP BY region", BindError),
        ("SELECT customer, SUM(quantity) FROM sales GROUP BY customer, customer", BindError), ("SELECT SUM(quantity) FROM sales WHERE unknown = 1", BindError), ("SELECT SUM(nothing) FROM sales", KeyError),
        ("SELECT SUM(quantity) FROM sales WHERE quantity > 1", BindError), ("SELECT SUM(quantity/price) FROM sales", BindError), ("SELECT MIN(quantity*2) FROM sales", BindError),
        ("SELECT COUNT(DISTINCT region) FROM sales", BindError), ("SELECT customer, COUNT(DISTINCT customer) FROM sales GROUP BY customer", BindError), ("SELECT SUM(DISTINCT quantity) FROM sales", BindError),
        ("SELECT SUM(w) FROM sales JOIN plan GROUP BY customer", BindError), ("SELECT SUM(quantity) FROM sales JOIN plan ON sales.date < plan.date", BindError), ("SELECT SUM(quantity) FROM sales WHERE half < 'H1'", ValueError),
        ("SELECT customer, SUM(quantity) OVER () FROM sales GROUP BY customer", BindError), ("SELECT customer, SUM(quantity) OVER (ORDER BY date) FROM sales GROUP BY customer", BindError),
        ("SELECT SUM(quantity) s FROM sales HAVING nope > 1", BindError), ("SELECT SUM(quantity) s FROM sales ORDER BY 3", BindError), ("SELECT SUM(quantity) FROM sales WHERE category > 5", BindError),
        ("SELECT customer, SUM(quantity) FROM sales WHERE customer IN (SELECT product FROM product) GROUP BY customer", BindError),
    ],
)
def test_errors(engine, query, error):
    with pytest.raises(error):
        engine.sql(query).rows


def test_result_set(engine):
    r = engine.sql("SELECT customer, SUM(quantity) AS s FROM sales GROUP BY customer")
    assert r.columns == ["customer", "s"] and len(r) == 12 and r.column("customer") == list(range(12)) and r[0] == r.rows[0] == next(iter(r))
    assert r.to_dicts()[3]["customer"] == 3 and "total_seconds" in r.stats
    assert "... 10 more" in r.to_text(2) and "(12 rows)" in str(engine.sql("SELECT customer, SUM(quantity) AS s FROM sales GROUP BY customer"))
    with pytest.raises(KeyError):
        r.column("nope")


def test_plan_cache_and_labels(engine):
    q = "SELECT SUM(quantity) FROM sales WHERE region = 'a  b'"
    engine.sql(q)
    before = engine.hits
    assert engine.sql(q).columns == ["SUM(quantity)"] and engine.hits == before + 1
    engine.sql("SELECT SUM(quantity) FROM sales WHERE region = 'a b'")
    assert engine.hits == before + 1  # another literal is another query


def test_explain(engine):
    q = "SELECT customer, month, SUM(quantity*price) AS revenue FROM sales JOIN product ON sales.product=product.product WHERE region='юг' GROUP BY customer, month"
    assert engine.einsum_of(q) == ["abc,b,cd,a->ad"]
    chain = engine.decompose(q)[0]
    assert [(len(c["lambda"]), len(c["mu"])) for c in chain] == [(0, 1), (0, 1), (1, 0)]
    assert engine.term(q)[0].startswith("sum[product, date](") and "frame sales" in engine.explain(q)
    assert "HashAggregate" in engine.explain(q, physical=True)


def test_facts_are_reduced_before_they_are_joined(engine):
    """Eager aggregation: a fact is aggregated to the joined axes below the join."""
    plan = engine.explain("SELECT product, SUM(quantity*w) AS x FROM sales JOIN plan GROUP BY product", physical=True)
    tree = plan[plan.index("== Physical Plan ==") : plan.index("(1)")] if "(1)" in plan else plan
    assert tree.count("HashAggregate") >= 4 and "Join" in tree and tree.index("Join") < tree.rindex("HashAggregate")


def test_security(spark, frames, engine):
    sales = frames[0]
    e = Engine(spark, engine.catalog)
    e.grant("some", "customer", [0, 3, 6, 9])
    e.grant("fixed", "product", None, can_project=False)
    e.grant("strict", "customer", [0], permissive=False)
    e.grant("months", "month", ["M1"])
    own = sales[sales.customer % 3 == 0]
    assert e.sql("SELECT SUM(quantity) FROM sales", "some")[0][0] == pytest.approx(own.quantity.sum())
    assert e.sql("SELECT COUNT(DISTINCT customer) AS d FROM sales", "some")[0][0] == 4
    assert e.sql("SELECT MIN(quantity) AS m FROM sales", "some")[0][0] == pytest.approx(own.groupby(["customer", "product", "date"]).quantity.sum().min())
    assert e.sql("SELECT COUNT(*) AS n FROM sales", "months")[0][0] == len(sales[sales.date // 3 == 1])
    assert len(e.sql("SELECT product, SUM(quantity) AS s FROM sales GROUP BY product", "fixed")) == 6
    for query, role, error in (("SELECT SUM(quantity) FROM sales", "fixed", AccessDenied), ("SELECT SUM(quantity) FROM sales", "strict", AccessDenied), ("SELECT SUM(quantity) FROM sales", "nobody", KeyError)):
        with pytest.raises(error):
            e.sql(query, role)


def test_facts_at_two_levels_of_a_hierarchy(spark, engine, con, frames):
    """A daily fact and a monthly one are linked through the calendar."""
    goal = pd.DataFrame({"month": ["M0", "M1", "M2", "M3"], "goal": [1.0, 2.0, 3.0, 4.0]})
    e = Engine(spark, engine.catalog)
    e.load_frame(goal, ["month"], "goal", "goals")
    con.register("goals", goal)
    same(e.sql("SELECT month, SUM(quantity*goal) AS x FROM sales JOIN goals GROUP BY month").to_pandas(), con.sql("SELECT month, sum(quantity*goal) AS x FROM flat JOIN goals USING (month) GROUP BY ALL").df())


def test_theta_join_is_guarded(spark, monkeypatch):
    from cellgrain.plans import compiler

    monkeypatch.setattr(compiler, "THETA_CELLS", 100)
    e = Engine(spark)
    e.load_frame({"a": range(20), "x": range(20)}, ["a"], "x", "f")
    e.load_frame({"b": range(20), "y": range(20)}, ["b"], "y", "g")
    with pytest.raises(BindError):
        e.sql("SELECT COUNT(*) AS n FROM f JOIN g ON f.a < g.b")
