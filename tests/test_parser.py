import pytest

from lattica.cypher import ast as A
from lattica.cypher.parser import parse
from lattica.errors import ParseError
from lattica.rules.parser import parse_program


def test_precedence():
    tree = parse("RETURN 1 + 2 * 3 ^ 2 AS x, NOT a = b OR c AND d AS y")
    (x, _), (y, _) = tree.clauses[0].items
    assert x == ("bin", "+", ("lit", 1), ("bin", "*", ("lit", 2), ("bin", "^", ("lit", 3), ("lit", 2))))
    assert y[0] == "or" and y[1][0] == "not" and y[2][0] == "and"


@pytest.mark.parametrize(
    ("text", "low", "high", "direction"),
    [("-[:R*]->", 1, None, "out"), ("<-[:R*2]-", 2, 2, "in"), ("-[:R*..3]-", 1, 3, "both"), ("-[:R*2..]->", 2, None, "out"), ("-[:R*0..1]->", 0, 1, "out")],
)
def test_variable_length(text, low, high, direction):
    rel = parse(f"MATCH (a){text}(b) RETURN a").clauses[0].patterns[0].elements[1]
    assert (rel.low, rel.high, rel.direction) == (low, high, direction)


def test_quantified_group():
    group = parse("MATCH (a) ((x)-[:R]->(y) WHERE x.v > 1){2,5} (b) RETURN x").clauses[0].patterns[0].elements[1]
    assert isinstance(group, A.GroupPat) and (group.low, group.high) == (2, 5)


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "RETURN 'x", "MATCH (a) RETURN", "RETURN 1 UNION RETURN 2 UNION ALL RETURN 3", "FOO (a)"])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_strings_and_comments():
    tree = parse("RETURN 'it\\'s \\u0041' AS a, \"q\" AS b // end\n, `odd name`.x AS c")
    assert tree.clauses[0].items[0][0] == ("lit", "it's A")
    assert tree.clauses[0].items[2][0] == ("prop", ("var", "odd name"), "x")


def test_program():
    p = parse_program("MODULE m\nCREATE RULE r PRIORITY 2 AS MATCH (a)-[e:E]->(b) WHERE a IS NOT q, (a, b) IS s TO c AND e.w > 1 FOLD n = COUNT(*) WHERE n > 1 YIELD KEY a, n AS PROB\nQUERY r WHERE a.x = 1 RETURN a.x AS x")
    c = p.clauses[0]
    assert p.module == "m" and c.priority == 2 and [(r.names, r.rule, r.negated) for r in c.refs] == [(["a"], "q", True), (["a", "b", "c"], "s", False)]
    assert c.yields[1].prob and len(c.where) == 1 and len(c.having) == 1 and p.steps[0].kind == "query"
