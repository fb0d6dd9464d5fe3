import pytest

from cellgrain.errors import BindError, QuerySyntaxError
from cellgrain.plans import nodes as n
from cellgrain.plans.parser import parse, tokenize
from cellgrain.plans.terms import Measure, normalize


def test_tokens():
    kinds = [(t.kind, t.value) for t in tokenize("select Größe, 'it''s' -- note\n <> 1.5e2 \"group\" .5")]
    assert kinds == [("keyword", "SELECT"), ("name", "Größe"), ("sign", ","), ("string", "it's"), ("sign", "!="), ("number", 150.0), ("name", "group"), ("number", 0.5), ("end", None)]


def test_select():
    q = parse("SELECT a, SUM(x*y)/COUNT(*) AS r FROM f JOIN g ON f.a = g.b LEFT JOIN h WHERE NOT a IN (1, -2) AND (b = 'v' OR c IS NOT NULL) GROUP BY a HAVING r > 1 ORDER BY 2 DESC, a LIMIT 5;")
    assert q.sources == ["f", "g", "h"] and [j.outer for j in q.joins] == [False, True]
    assert q.joins[0].on == n.Compare("=", n.Name("a", "f"), n.Name("b", "g"))
    assert q.items[1].label == "r" and str(q.items[1].expr) == "(SUM((x * y)) / COUNT(*))"
    assert q.where == n.Both(n.Negation(n.Among(n.Name("a"), (n.Literal(1), n.Literal(-2)))), n.Either(n.Compare("=", n.Name("b"), n.Literal("v")), n.IsNull(n.Name("c"), True)))
    assert q.order == (n.Order(n.Literal(2), True), n.Order(n.Name("a"))) and q.limit == 5


def test_windows_case_and_labels():
    q = parse("SELECT SUM(x) OVER (PARTITION BY p ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), AVG(CASE WHEN a < 3 THEN x ELSE 0 END) total FROM f GROUP BY p, d")
    over = q.items[0].expr.over
    assert (over.back, over.order, over.partition) == (2, n.Name("d"), (n.Name("p"),))
    assert q.items[0].label.startswith("SUM(x) OVER") and q.items[1].label == "total"


def test_distinct_is_grouping():
    assert parse("SELECT DISTINCT a, b FROM f").group == (n.Name("a"), n.Name("b"))


@pytest.mark.parametrize(
    "text",
    [
        "SELECT", "SELECT a FROM", "SELECT a FROM f extra words here", "SELECT 'open", "SELECT DISTINCT a FROM f GROUP BY a", "SELECT DISTINCT SUM(a) FROM f",
        "SELECT SUM(x) OVER (ORDER BY d ROWS BETWEEN 1 FOLLOWING AND CURRENT ROW) FROM f", "SELECT SUM(CASE ELSE 1 END) FROM f", "SELECT a FROM f WHERE a", "SELECT a FROM f LIMIT x", "SELECT a ? b",
        "SELECT SUM(x FROM f", "SELECT a FROM f WHERE a NOT 5",
    ],
)
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError) as e:
        parse(text)
    assert "line 1" in str(e.value) and "^" in str(e.value)


def resolve(name):
    return Measure(name.name, name.name)


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("a", ["a"]), ("a*b - c", ["a * b", "-1 * c"]), ("2*(a+b)/4", ["0.5 * a", "0.5 * b"]), ("-(a-1)", ["-1 * a", "1"]), ("3", ["3"]),
        ("CASE WHEN x = 1 THEN a ELSE 2*b END", ["a * [x = 1]", "2 * b * [NOT x = 1]"]), ("CASE WHEN x = 1 THEN 0 ELSE a END", ["a * [NOT x = 1]"]),
    ],
)
def test_terms(text, terms):
    expr = parse(f"SELECT SUM({text}) FROM f").items[0].expr.arg
    assert [str(t) for t in normalize(expr, resolve)] == terms


@pytest.mark.parametrize("text", ["a/b", "a/0", "SUM(a)", "'x'", "a/(2-2)"])
def test_terms_that_are_refused(text):
    with pytest.raises(BindError):
        normalize(parse(f"SELECT SUM({text}) FROM f").items[0].expr.arg, resolve)
