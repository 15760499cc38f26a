import math

import pytest
from pyspark.sql import functions as F

from pairlog.functions import scalar as S, special as B, vectors as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_run_code(spark):
    r = one(spark, **S.parse_run_code(F.lit("f20h1")))
    assert tuple(r) == ("Face", 20, "Homogeneous", 1)
    assert tuple(one(spark, **S.parse_run_code(F.lit("other")))) == (None, None, None, None)


def test_identifier_round_trip(spark):
    joined = S.make_ssid(F.lit("h50s2"), F.lit(7))
    assert one(spark, x=joined).x == "h50s2_7"
    parts = S.split_identifier(joined, ["run", "id", "absent"])
    assert tuple(one(spark, **parts)) == ("h50s2", "7", None)


def test_text_rules(spark):
    assert one(spark, x=S.clean_hashtag(F.lit(" #Nuclear-Power_1! "))).x == "nuclearpower_1"
    assert one(spark, x=S.text_violations(F.lit("short"))).x == ["too_short"]
    assert one(spark, x=S.text_violations(F.lit("x" * 281))).x == ["too_long"]
    assert one(spark, x=S.text_violations(F.lit("x" * 50))).x == []
    assert one(spark, x=S.hashtag_violations(F.lit("#Japan"))).x == ["banned"]
    assert one(spark, x=S.hashtag_violations(F.lit("two words"))).x == ["has_space"]
    tags = F.array(F.lit("a"), F.lit(None), F.lit(None), F.lit("b"))
    assert one(spark, x=S.has_duplicates(tags)).x is False
    assert one(spark, x=S.has_duplicates(F.array(F.lit("a"), F.lit("a")))).x is True


def test_labels(spark):
    r = one(spark, a=S.rating_label(F.lit(7)), b=S.rating_label(F.lit(None).cast("int")), c=S.lookup(F.lit(3), {1: "x"}),
            d=S.factor_order(F.lit("b"), ["a", "b"]), e=S.factor_order(F.lit("z"), ["a", "b"]),
            f=S.wrap_round(F.lit(41)), g=S.significance_stars(F.lit(0.02)))
    assert tuple(r) == ("Strongly agree (7)", None, None, 2, None, 1, "*")


def test_log_base(spark):
    r = one(spark, e=S.log_base(F.lit(math.e)), two=S.log_base(F.lit(20), 2), ten=S.log_base(F.lit(100.0), 10),
            zero=S.log_base(F.lit(0.0)), none=S.log_base(F.lit(None).cast("double"), 2))
    assert r.e == pytest.approx(1.0) and r.two == pytest.approx(4.3219281) and r.ten == pytest.approx(2.0)
    assert r.zero == -math.inf and r.none is None


def test_recorded_date(spark):
    r = one(spark, a=S.parse_recorded_date(F.lit("5/22/2024 12:30")), b=S.parse_recorded_date(F.lit("soon")))
    assert str(r.a) == "2024-05-22 12:30:00" and r.b is None


def test_rated(spark):
    d = spark.createDataFrame([(None, None, 5, None, None), (None,) * 5],
                              ", ".join(f"{c} int" for c in S.IMPRESSIONS))
    rows = d.select(S.rated_impression().alias("i"), S.rated_value().alias("v")).collect()
    assert [tuple(r) for r in rows] == [("maturity", 5), (None, None)]


def test_softmax_and_argmax(spark):
    arr = F.array(F.lit(0.1), F.lit(0.9), F.lit(0.9))
    r = one(spark, s=V.softmax_tau(arr, 0.2), i=V.argmax(arr), big=V.softmax_tau(F.array(F.lit(5000.0), F.lit(0.0))))
    want = [math.exp(x / 0.2) for x in (0.1, 0.9, 0.9)]
    assert r.s == pytest.approx([w / sum(want) for w in want])
    assert r.i == 1 and r.big == pytest.approx([1.0, 0.0])


def test_cosine(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(-1.0))
    r = one(spark, o=V.cosine(a, b), s=V.cosine(a, a), z=V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))))
    assert r.o == pytest.approx(0.0) and r.s == pytest.approx(1.0) and r.z is None


def test_student_t(spark):
    r = one(spark, a=B.student_t_p(F.lit(2.0), F.lit(10)), b=B.student_t_p(F.lit(2.2281388520), F.lit(10)),
            c=B.student_t_p(F.lit(0.0), F.lit(3)), n=B.student_t_p(F.lit(None).cast("double"), F.lit(3)),
            q=B.student_t_quantile(F.lit(0.975), F.lit(10)))
    assert r.a == pytest.approx(0.0733880, abs=1e-7) and r.b == pytest.approx(0.05, abs=1e-9)
    assert r.c == pytest.approx(1.0) and r.n is None and r.q == pytest.approx(2.2281388520, abs=1e-8)


def test_student_t_large_df(spark):
    # with a million degrees of freedom the t distribution is the normal one
    p = one(spark, x=B.student_t_p(F.lit(1.959963984540054), F.lit(1_000_000))).x
    assert p == pytest.approx(0.05, abs=1e-6)


def exact_binomial(k, n):
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


@pytest.mark.parametrize("k,n", [(0, 5), (3, 10), (5, 10), (8, 9), (140, 300), (480, 1000), (2600, 5000)])
def test_binomial(spark, k, n):
    assert one(spark, p=B.binomial_half_p(F.lit(k), F.lit(n))).p == pytest.approx(exact_binomial(k, n), rel=1e-8)


def test_beta_edges(spark):
    r = one(spark, none=B.binomial_half_p(F.lit(0), F.lit(0)), q=B.beta_quantile(F.lit(0.5), F.lit(3.0), F.lit(3.0)))
    assert r.none is None and r.q == pytest.approx(0.5)


def test_binomial_of_rows_without_trials(spark):
    d = spark.createDataFrame([(0, 0), (3, 10), (0, 5), (2, None)], "k int, n int").repartition(1)
    got = {(r.k, r.n): r.p for r in d.select("k", "n", B.binomial_half_p("k", "n").alias("p")).collect()}
    assert got[0, 0] is None and got[2, None] is None
    assert got[3, 10] == pytest.approx(exact_binomial(3, 10)) and got[0, 5] == pytest.approx(0.0625)


def normal_tail(z):
    return math.erfc(z / math.sqrt(2))


@pytest.mark.parametrize("df", [10**8, 10**10, 10**12, 10**15])
@pytest.mark.parametrize("t", [0.5, 1.96, 5.0, 10.0])
def test_student_t_of_any_size(spark, df, t):
    """Beyond a hundred million degrees of freedom: the normal tail and the first term of its expansion."""
    first = 2 * math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * (t**3 + t) / 4 / df
    assert one(spark, p=B.student_t_p(F.lit(t), F.lit(df))).p == pytest.approx(normal_tail(t) + first, rel=1e-9)


@pytest.mark.parametrize("t", [1e-6, 0.01, 1.0, 30.0, 1e6])
def test_student_t_closed_forms(spark, t):
    r = one(spark, one=B.student_t_p(F.lit(t), F.lit(1)), two=B.student_t_p(F.lit(t), F.lit(2)))
    assert r.one == pytest.approx(2 / math.pi * math.atan2(1, t), rel=1e-11)
    assert r.two == pytest.approx(2 / ((2 + t * t) + t * math.sqrt(2 + t * t)), rel=1e-11)


def test_quantiles_invert(spark):
    for prob in (0.6, 0.9, 0.975, 0.9999):
        r = one(spark, **{f"d{i}": B.student_t_p(B.student_t_quantile(F.lit(prob), F.lit(df)), F.lit(df))
                          for i, df in enumerate((1.0, 1.3, 2.0, 3.9, 4.0, 11.0, 500.0, 1e6, 1e12))})
        assert list(r) == pytest.approx([2 * (1 - prob)] * 9, rel=1e-9)
    assert one(spark, q=B.student_t_quantile(F.lit(0.975), F.lit(1))).q == pytest.approx(12.706204736432095, rel=1e-10)
    for prob in (0.025, 0.5, 0.975):
        shapes = [(1.0, 1.0), (1.0, 900.0), (900.0, 1.0), (3.0, 40.0), (0.5, 0.5), (2000.0, 1500.0), (1e9, 1e9)]
        r = one(spark, **{f"q{i}": B.beta_inc(F.lit(a), F.lit(b), B.beta_quantile(F.lit(prob), F.lit(a), F.lit(b))) for i, (a, b) in enumerate(shapes)})
        assert list(r) == pytest.approx([prob] * len(shapes), rel=1e-7)
    assert one(spark, q=B.beta_quantile(F.lit(0.025), F.lit(1.0), F.lit(900.0))).q == pytest.approx(1 - 0.975 ** (1 / 900), rel=1e-9)


def test_beta_borders(spark):
    r = one(spark, zero=B.beta_inc(F.lit(2.0), F.lit(3.0), F.lit(0.0)), all=B.beta_inc(F.lit(2.0), F.lit(3.0), F.lit(1.0)),
            none=B.beta_inc(F.lit(None).cast("double"), F.lit(3.0), F.lit(0.0)), half=B.beta_inc(F.lit(2.0), F.lit(2.0), F.lit(0.3)))
    assert (r.zero, r.all, r.none) == (0.0, 1.0, None) and r.half == pytest.approx(0.3**2 * (3 - 0.6), rel=1e-11)


def test_large_binomials(spark):
    n = 10**10
    k = n // 2 - 150_000
    z = (n / 2 - k - 0.5) / math.sqrt(n / 4)  # with the correction for whole numbers
    assert one(spark, p=B.binomial_half_p(F.lit(k), F.lit(n))).p == pytest.approx(normal_tail(z), rel=1e-6)
