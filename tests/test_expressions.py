import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold.errors import DefinitionError
from chronofold.functions.compile import Compiler, column_env
from chronofold.functions.evaluate import EvalError, Evaluator
from chronofold.functions.syntax import parse, parse_span

NOW = dt.datetime(2024, 6, 1, 12, tzinfo=dt.timezone.utc)
ROWS = [
    ("Hello World", 5, 2.5, True, dt.datetime(2024, 3, 5, 10, 20, 30), ["a", None, "b"]),
    (None, None, None, None, None, None),
    ("  x\t", -7, -2.5, False, dt.datetime(2023, 12, 31, 23, 59, 59), []),
    ("1,2,,3", 0, 3.0, True, dt.datetime(2024, 2, 29), ["x"]),
    ("42", 2**62, 1e20, False, dt.datetime(2024, 1, 1), ["1"]),
]
KINDS = {"s": "string", "n": "integer", "x": "number", "b": "boolean", "t": "datetime", "a": "array:string"}
TEXTS = r"""
s | n+1 | n*4 | n-1 | n/2 | 7/n | x/2 | 1.0/n | n ** 2 | x ** 2 | n > 3 | n >= x | s == "42" | s == n | n == x | b and true | b or n > 1 | not b | -n | -x | s > "H" | t > t | t + 1d > t | t - 2h
t - (t - 1d) | if b then n else 0 | if n > 0 then 1 else 2.5 | s[0] | s[-1] | a[0] | a[-1] | a[5] | str::to_lowercase(s) | str::to_uppercase(s) | str::trim(s) | str::substring(s,1,3) | str::substring(s,n,2)
starts_with(s,"H") | ends_with(s,"d") | contains(s,"o") | contains(a,"a") | contains(a,null) | replace(s,"o","0") | replace(s,"","-") | regex_match(s,"^[A-Z]") | regex_extract(s,"(\\w)o") | regex_extract(s,"l+")
to_string(x) | to_string(n) | to_string(b) | to_string(s) | len(s) | len(a) | math::abs(n) | math::abs(x) | floor(x) | ceil(x) | round(x) | min(n,x) | max(n,3) | days_between(t,now()) | hours_between(t,now())
minutes_between(t,now()) | days_since(t) | year_of(t) | month_of(t) | day_of(t) | hour_of(t) | minute_of(t) | day_of_week(t) | date_trunc(t,"month") | date_trunc(t,"week") | to_int(s) | to_int(x) | to_int(b)
parse_datetime("2024-01-02 03:04","%Y-%m-%d %H:%M") | to_float(s) | to_float(n) | coalesce(s,"d") | coalesce(n,x) | split(s,",") | split(s,"o")[1] | join(a,"-") | null == s | s != null | n == null | zz | q.r
3d * 2 > 5d | 1h - 2h | not b == true | 2 ** 63 | n * n | contains(s,n) | min(s,1) | a == a | split(s,"")
"""


def test_compiled_expressions_give_what_the_evaluator_gives(spark):
    texts = [t.strip() for line in TEXTS.strip().split("\n") for t in line.split(" | ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, s string, n bigint, x double, b boolean, t timestamp, a array<string>")
    compile_, evaluate = Compiler(column_env(KINDS), F.lit(NOW).cast("timestamp")), Evaluator(NOW)
    typed = [compile_(t) for t in texts]
    got = df.select("i", *(F.struct((F.unix_micros(c.value) if c.kind == "datetime" else c.value).alias("v"), (c.error if c.error is not None else F.lit(None).cast("string")).alias("e")).alias(f"c{k}") for k, c in enumerate(typed))).orderBy("i").collect()
    for row, out in zip(ROWS, got):
        env = dict(zip("snxbta", row))
        env["t"] = row[4].replace(tzinfo=dt.timezone.utc) if row[4] else None
        for k, text in enumerate(texts):
            value, error = out[f"c{k}"]
            try:
                want = evaluate(parse(text), env)
            except EvalError:
                assert error is not None, (text, row)
                continue
            if isinstance(want, dt.timedelta):
                want = want // dt.timedelta(microseconds=1)
            if isinstance(want, dt.datetime):
                want = int(want.timestamp() * 1_000_000)
            assert error is None and value == want, (text, row, value, error, want)


@pytest.mark.parametrize(("text", "value"), [("-2 ** 2", 4), ("2 ** 3 ** 2", 512), ("not true == false", True), ("1 + 2 * 3", 7), ("-7 / 2", -3), ("'a\\n' + \"b\"", "a\nb"), ("if 1 > 2 then 1 else 2", 2), ("event.items.0", 9), ("5 >= 5 and 1 != 2 || false", True)])
def test_binding_and_literals(text, value):
    assert Evaluator(NOW)(parse(text), {"event": {"items": [9]}}) == value


@pytest.mark.parametrize("text", ["", "1 +", "(1", "a..b", "if 1 then 2", "'open", "1 ^ 2", "f(1,", "and"])
def test_mistakes_name_their_place(text):
    with pytest.raises(DefinitionError):
        parse(text)


def test_any_is_read_as_what_stands_beside_it(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,)], "v string")
    c = Compiler(column_env({"v": "any"}))
    more, same = c("v > 3"), c("v == 5")
    got = df.select(more.value, more.error.isNotNull(), same.value).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (None, True, False), (None, True, False)]


def test_compile_time_refusals():
    c = Compiler(lambda _: None)
    for text in ("nope(1)", "len()", "regex_match('a', '(?=b)')", "regex_match('a', '(')", "if true then 1 else 'a'", "parse_datetime('a', '%Q')"):
        with pytest.raises(DefinitionError):
            c(text)


def test_spans():
    assert parse_span("90m") == 5_400_000_000
    for bad in ("90", "d", "1w", "-1d"):
        with pytest.raises(DefinitionError):
            parse_span(bad)
