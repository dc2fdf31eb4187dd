"""Where values of credential contexts begin and end."""

import pytest

from strideway.llm import guess_cost


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("password: Xk9,mQ2vR7tLp0", [("password", "Xk9,mQ2vR7tLp0")]),
        ("pwd=a;b\"c'd<e>f, next", [("pwd", "a;b\"c'd<e>f")]),
        ("password" + " " * 9 + "= Zq8vRt2LmX91kd", [("password", "Zq8vRt2LmX91kd")]),
        ("api_key:" + " \t" * 30 + "Zq8vRt2LmX91kd", [("api_key", "Zq8vRt2LmX91kd")]),
        ("Secret: password: Zq8vRt2LmX91kd", [("password", "Zq8vRt2LmX91kd")]),
        ('secret: "db_password: Zq8v"', [("password", "Zq8v")]),
        ("secret: password:\nx", [("secret", "password:")]),
        ('{"password":"abc","token":"xyz"}', [("password", "abc"), ("token", "xyz")]),
        ("{password:abc,token:xyz}", [("password", "abc"), ("token", "xyz}")]),
        ("password=abc,my-token=xyz; n", [("password", "abc"), ("token", "xyz")]),
        ('"url?token=abc","next":"Q7"', [("token", "abc")]),
        ("<b>token: abc</b><i>", [("token", "abc")]),
        ('password: "" x', []),
        ('password: "Zq8vRt2', [("password", "Zq8vRt2")]),
        ("password:\nabc", []),
    ],
)
def test_values(text, want):
    got = list(guess_cost.values(text))
    assert [(k, v) for _, k, v in got] == want
    assert all(text[p : p + len(v)] == v for p, _, v in got)


def test_long_texts_end():
    assert [v for _, _, v in guess_cost.values("token:" * 20000 + "x")] == ["x"]
    assert list(guess_cost.values("token" + " " * 200000)) == []
    assert len(list(guess_cost.values("token=a," * 20000))) == 20000


def test_hint_lets_wide_columns_through(spark):
    docs = spark.createDataFrame([(1, "password" + " " * 20 + "=" + " " * 20 + "Zq8vRt2LmX91kd"), (2, "password: Xk9,mQ2vR7tLp0")],
        "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_chars, r.secret) for r in guess_cost.scan(docs).collect()) == [(1, 14, True), (2, 14, True)]
