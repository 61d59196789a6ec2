import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import numeric, sequences, text
from marlstone.functions.text import LATIN
from marlstone.operators import daily


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")


@pytest.mark.parametrize("a, b, want", [((0, 1, 2), (0, 2), 0.2), ((1,), (4,), 1.5), ((0, 0, 1), (0, 1, 1), 0.0), ((), (1,), 0.0)])
def test_dtw(spark, a, b, want):
    assert one(spark, sequences.dtw(arr(*a), arr(*b))) == pytest.approx(want)


@pytest.mark.parametrize("u, v, want", [((1, 0, 0), (0, 0, 1), 2.0), ((2, 2), (1, 3), 0.25), ((0, 0), (1, 3), 4.0), ((-1, 1), (0, 1), 0.0)])
def test_wasserstein(spark, u, v, want):
    assert one(spark, sequences.wasserstein(arr(*u), arr(*v))) == pytest.approx(want)


def test_distances_against_plain_code(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(size=8).tolist(), rng.normal(size=int(rng.integers(1, 8))).tolist(), rng.random(6).tolist(), rng.random(6).tolist()) for _ in range(30)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, u array<double>, v array<double>")
    got = df.select("a", "b", "u", "v", sequences.dtw(F.col("a"), F.col("b")).alias("d"), sequences.wasserstein(F.col("u"), F.col("v")).alias("w")).collect()
    for r in got:
        t = np.full((len(r.a) + 1, len(r.b) + 1), np.inf)
        t[0, 0] = 0
        for i, x in enumerate(r.a):
            for j, y in enumerate(r.b):
                t[i + 1, j + 1] = abs(x - y) + min(t[i, j], t[i, j + 1], t[i + 1, j])
        assert r.d == pytest.approx(t[-1, -1] / (len(r.a) + len(r.b)))
        assert r.w == pytest.approx(np.abs(np.cumsum(np.array(r.u) / sum(r.u)) - np.cumsum(np.array(r.v) / sum(r.v))).sum())


def test_order_statistics(spark):
    s = one(spark, sequences.order_stats(arr(100, 100, 300, 0, -5)))
    assert s.n == 3 and s["repeat"] == pytest.approx(2 / 3) and s.max_share == pytest.approx(0.6) and s.entropy == pytest.approx(0.864974, abs=1e-6)
    assert tuple(one(spark, sequences.order_stats(arr()))) == (0, 0.0, 0.0, 0.0)
    assert one(spark, sequences.order_stats(arr(50, 49)))["repeat"] == 1.0  # 50 rounds half to even


def test_depth(spark):
    assert one(spark, sequences.weighted_imbalance(arr(100, 200, 300), arr(90, 180, 270))) == pytest.approx(0.0526316, abs=1e-6)
    assert one(spark, sequences.depth_slope(arr(100, 200, 300), F.lit(3))) == pytest.approx(0.4166667, abs=1e-6)
    assert one(spark, sequences.weighted_imbalance(arr(), arr(1))) == 0.0 and one(spark, sequences.depth_slope(arr(5), F.lit(1))) == 0.0


def test_numbers(spark):
    df = spark.createDataFrame([("1.5", float("nan")), ("abc", 2.0), (None, None)], "a string, b double")
    assert [r.x for r in df.select(numeric.number(df, "a", 7).alias("x")).collect()] == [1.5, 7.0, 7.0]
    assert [r.x for r in df.select(numeric.number(df, "b").alias("x")).collect()] == [0.0, 2.0, 0.0]
    assert [r.x for r in df.select(numeric.number(df, "absent", 3).alias("x")).collect()] == [3.0] * 3
    assert one(spark, numeric.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, numeric.minute_of_day(F.lit(1778118226000))) == pytest.approx(583.766667, abs=1e-6)
    assert one(spark, numeric.plain_date(F.lit("2026-05-07"))) == "20260507"
    assert one(spark, sequences.parse_sequence(F.lit("1;;2.5;"))) == [1.0, 2.5] and one(spark, sequences.parse_sequence(F.lit(None).cast("string"))) == [0.0]


def test_levels(spark):
    good = '[{"price":2.0,"volume":3.0,"order":[{"volume":1.0}],"bigOrderPercent":0.2},{"volume":4.0}]'
    rows = spark.createDataFrame([(good,), ("not json",), (None,), ("[]",)], "raw string").select(daily.parse_levels(F.col("raw")).alias("x")).collect()
    assert [len(r.x) for r in rows] == [2, 0, 0, 0]
    assert rows[0].x[0].orders == [1.0] and rows[0].x[1].price == 0.0 and rows[0].x[1].orders == []


def test_text(spark):
    assert one(spark, text.normal_numbers(F.lit("1,000 万元，百分之十 和 3 4 %"))) == "1000万元，10% 和 34%"
    assert one(spark, text.clean(F.lit(" a \t b\n\n\n\nc "))) == "a b\n\nc"
    assert one(spark, text.sentences(F.lit("甲段。 乙段！丙"))) == ["甲段。", "乙段！", "丙"]
    assert [one(spark, text.is_heading(F.lit(x))) for x in ("第一节 财务", "1.2、范围", "（三）其他", "普通的话", "x" * 101)] == [True, True, True, False, False]
    assert one(spark, text.tokens(F.lit("2024年净利润为20.5%，of x"))) == ["2024", "年净", "利润", "20.5%", "of", "x"]
    assert one(spark, text.html_text(F.lit("<p>A&amp;B</p><script>x<y</script><b>C</b>"))) == "A&B\nC"


@pytest.mark.parametrize(
    "reply, want",
    [("解析……\n答案：A、C", "AC"), ("答案:B\n更正 答案: D", "D"), ("The answer: b and a", "BAD"), ("答案：均为错误", ""), ("x\nB", "B"), (None, ""), ("", "")],
)
def test_answer_letters(spark, reply, want):
    assert one(spark, F.array_join(text.answer_letters(F.lit(reply).cast("string")), "")) == want


def test_structured_letters(spark):
    reply = "A: 成立\nB：不成立\nC - 正确\nD: 错误"
    assert one(spark, text.structured_letters(F.lit(reply))) == ["A", "C"]
    assert one(spark, text.structured_letters(F.lit("A: 成立\nA: 不成立"))) == []
    assert one(spark, text.structured_letters(F.lit("答案：BD"))) == ["B", "D"]


def test_signature(spark):
    s = one(spark, text.signature(F.lit("the cost rose 12% to 3.5"), LATIN))
    assert set(s.terms) >= {"the", "cost", "rose", "12%"} and set(s.numbers) == {"12%", "3.5"}


def test_character_references(spark):
    import html

    texts = ["a &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9;&#128512;", "&", "&&amp;", "&nosuch; &#0; &#xD800; &#99999999; x&", "", None, "&quot;&#39;&apos;&euro;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", text.unescaped(F.col("t")).alias("u")).collect()}
    for i, t in enumerate(texts):
        if i != 3:
            assert got[i] == (None if t is None else html.unescape(t)), t
    assert got[3] == texts[3]
    assert df.limit(1).select(text.html_text(F.lit("<p>a&nbsp;b</p><script>x</script>&eacute;")).alias("t")).first().t == "a b\né"
