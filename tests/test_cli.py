from hypothesis import given, settings
from hypothesis import strategies as st

from outlens.operators.relational import pretty
from outlens.plans.ast import Binary, Literal, Name, Unary
from outlens.plans.cli import execute, formatted, prompt
from outlens.plans.lexer import statements
from outlens.plans.parser import Parser
from outlens.plans.session import Session


def test_prompt(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1.5, "a"), (2.0, None)], "x double, k string"))
    lines = iter(["SELECT x", "FROM t WHERE x > 1.7;", "SELECT * FROM nothing;", "quit"])
    out = []
    prompt(s, lambda _: next(lines), out.append)
    assert "2" in out[0] and "1.5" not in out[0] and out[1].startswith("error")
    assert "| 1.5 | a |" in execute(s, "SELECT * FROM t") and "| 2   | - |" in execute(s, "SELECT * FROM t")


def test_wide_rows_are_listed(spark):
    wide = spark.range(1).selectExpr(*[f"{i} AS c{i}" for i in range(12)])
    assert pretty(wide).splitlines()[11] == "c11: 11"


def test_formats():
    assert formatted([{"a": 1, "b": "x"}], "csv").splitlines() == ["a,b", "1,x"]
    assert formatted([], "JSON") == "[]"


atoms = st.sampled_from([Binary(">", Name("x"), Literal(1.5)), Binary("=", Name("k"), Literal("it's")), Binary("<>", Name("x"), Literal(2))])
trees = st.recursive(atoms, lambda t: st.one_of(st.builds(Unary, st.just("NOT"), t), st.builds(Binary, st.sampled_from(["AND", "OR"]), t, t)), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(trees)
def test_conditions_survive_their_text(tree):
    assert Parser(tree.sql()).boolean() == tree


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab'; \n", max_size=8), min_size=1, max_size=4))
def test_strings_survive_splitting(texts):
    parts = ["SELECT '" + t.replace("'", "''") + "' FROM t" for t in texts]
    assert statements(";".join(parts)) == parts
