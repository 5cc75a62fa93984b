"""Hand-computed cases of the text and parsing functions."""
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from probity.functions import parse as P
from probity.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(1, value)], "k int, t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("value, want", [("", 0.0), ("a", 0.0), ("abab", 1.0), (None, 0.0)])
def test_entropy(spark, value, want):
    assert T.char_entropy(spark.createDataFrame([(1, value)], "k int, t string"), "k", "t").first()[1] == pytest.approx(want)


@pytest.mark.parametrize(
    "f, value, want",
    [
        (lambda t: T.lexical_diversity(T.words(t)), "слово", 0.0),
        (lambda t: T.lexical_diversity(T.words(t)), "Да да нет", 2 / 3),
        (T.caps_share, "123!", 0.0),
        (T.caps_share, "AbC", 2 / 3),
        (T.emoji_density, "😀😀x🌀", 0.5),
        (T.emoji_density, "日本", 0.5),
        (lambda t: T.url_patterns(t)["short_urls"], "https://reddit.com/x", 1),
        (T.keywords_present, "кредит кредит", 1),
        (T.keywords_present, "доход", 0),
        (T.repeated_runs, "ааа!!!", 2),
        (T.repeated_runs, "\n\n\n", 0),
        (T.first_word, "   ", ""),
        (T.first_word, " Да нет", "да"),
        (T.script_share, "Ива", 1.0),
        (T.script_share, "  ", None),
        (lambda t: F.size(T.sentences(t)), "Одно. Два!! ... Три", 3),
        (P.compact_number, "2.01K", 2009),
        (P.compact_number, None, 0),
        (P.compact_number, "99999999999999999999", None),
        (lambda t: P.compact_decimal(t).cast("string"), "99999999999999999999", "100000000000000000000"),
        (lambda t: P.compact_decimal(t).cast("string"), "99999999999999999999 x", "99999999999999999999"),
        (lambda t: P.compact_decimal(t).cast("string"), "9" * 39 + "k", None),
        (P.compact_number, "١٢", 12),
        (P.compact_number, "१.५K", 1500),
        (P.compact_number, "-3", 3),
        (lambda t: P.day_first_date(t).cast("string"), "3.4.71", "1971-04-03"),
        (lambda t: P.day_first_date(t).cast("string"), "3/4/2011", "2011-04-03"),
        (lambda t: P.day_first_date(t).cast("string"), "31.02.2011", None),
        (P.strip_tags, "a<br>b&amp;c <b>d</b>", "a\nb&c d"),
        (P.bot_label, "<b>Получить  карточку бота</b>", 1),
        (P.bot_label, "Этот аккаунт не помечен как бот", 0),
        (P.bot_label, "...", None),
        (lambda t: P.registration_date(t).cast("string"), "Регистрация: <i>01.02.2019</i>", "2019-02-01"),
        (P.unwrap_ajax, '{"data": ["<a>", "b"]}', "<a>b"),
        (P.unwrap_ajax, "<p>x", "<p>x"),
        (P.unwrap_ajax, '{"data":{"a":1,"b":2}}', "ab"),
        (P.unwrap_ajax, '{"data":null}', '{"data":null}'),
        (P.unwrap_ajax, '{"data":5}', '{"data":5}'),
        (P.unwrap_ajax, '{"data":["a"],"data":["b"]}', "b"),
        (P.unwrap_ajax, '{"x":NaN,"data":["q","\\ud800"]}', "q?"),
        (P.unwrap_ajax, '{"a":' * 5000, '{"a":' * 5000),
        (lambda t: P.json_array_after(t, "k:"), 'k: [1] k:["a]\\"[",[2],"\\\\"] x]', '["a]\\"[",[2],"\\\\"]'),
        (lambda t: P.json_array_after(t, "k:"), 'k:["open]', None),
        (lambda t: P.json_array_after(t, "k:"), "k:[[]", None),
        (lambda t: P.json_array_after(t, "k:"), "nothing", None),
        (lambda t: F.length(P.json_array_after(t, "k:")), "k:[" + '"\\u0436\\"]",' * 20000 + "0]]", 20000 * 12 + 3),
        (lambda t: P.features_in_text(t)["hashtags"], "#ab x#cd #e @user.1 https://x.y)", ["ab"]),
    ],
)
def test_function(spark, f, value, want):
    got = one(spark, value, f)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_entropy_sorts_no_characters(spark):
    texts = ["", "a", "aa", "Aab", "😀😀x", "éÉ", None, "".join(chr(0x4E00 + i) for i in range(6000))] + ["word %d" % i for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", T.entropy(F.col("t")).alias("e"), T.letters(F.col("t")).alias("n"))
    got = {r["i"]: (r["e"], r["n"]) for r in df.collect()}

    def want(t):
        c = Counter(t.lower()) if t else {}
        n = sum(c.values())
        return -sum(k / n * math.log2(k / n) for k in c.values()) if n > 1 else 0.0

    for i, t in enumerate(texts):
        assert abs(got[i][0] - want(t)) < 1e-9
        assert got[i][1] == sum(x.isalpha() for x in t or "")
    assert "array_sort" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_linguistic_features_are_found_once(spark):
    from probity.operators import profile_features as P

    rows = spark.createDataFrame([(1, 7, "One two. Two three!"), (2, 7, "two"), (3, 8, "x"), (4, -1, "y")], "id long, from_id long, text string")
    out = P.linguistic(rows)
    assert {r["user_id"]: (r["vocab_size"], round(r["mattr"], 6)) for r in out.collect()} == {7: (3, 0.6), 8: (1, 1.0)}
    # the sentences' words alone are looked for behind the stored ones
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
