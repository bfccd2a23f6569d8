"""Letter repair, word joins and the provenance of words."""

import pytest
from pyspark.sql import functions as F

from sarnai.functions import text as T
from sarnai.operators import letters, lexicon

WORDS = [("бәәдл", 50), ("бәәнт", 9), ("һалун", 20), ("күн", 90), ("көвүн", 70), ("дуһар", 30), ("сән", 40), ("бодна", 50), ("бод", 40), ("ямаран", 12)]


@pytest.fixture(scope="module")
def known(spark):
    w = "word string, n long"
    return letters.Lexicon(spark.createDataFrame(WORDS, w), spark.createDataFrame([("доктор",)], "word string"), spark.createDataFrame([("көвүн",)], "word string"))


TEXTS = [
    (1, "Бяядл галун, кюн докторас.", "hard", "Бәәдл һалун, күн докторас."), (2, "hалун сән", "hard", "һалун сән"), (3, "и в на что с по", "", "и в на что с по"),
    (4, None, "", None), (5, "", "", ""), (6, "Дугарна кюн-ковун ГАЛУН!", "hard", "Дуһарна күн-көвүн ҺАЛУН!"), (7, "Сян бяянт", "hard", "Сән бәәнт"),
    (8, "бод галун", "vocab", "бод һалун"), (9, "йамаран", "hard", "ямаран"), (10, "күн ковун", "", "күн ковун"), (11, "12 !?", "", "12 !?"),
]


def test_repair(spark, known):
    rows = spark.createDataFrame([t[:2] for t in TEXTS], "id long, text string")
    got = {r.id: r for r in letters.repair(rows, "id", "text", known).collect()}
    assert {k: (r.flag, r.fixed) for k, r in got.items()} == {i: (flag, fixed) for i, _, flag, fixed in TEXTS}
    assert [(f.before, f.after) for f in got[8].fixes] == [("галун", "һалун")]
    assert got[3].russian and got[4].fixes is None


def test_forced_repair_keeps_names(spark, known):
    rows = spark.createDataFrame([(1, "күн ковун"), (2, "күн Галун"), (3, "Галун күн. Галун")], "id long, text string")
    got = {r.id: r.fixed for r in letters.repair(rows, "id", "text", known, force=True).collect()}
    assert got == {1: "күн көвүн", 2: "күн Галун", 3: "Һалун күн. Һалун"}


def test_no_texts(spark, known):
    assert letters.repair(spark.createDataFrame([], "id long, text string"), "id", "text", known).count() == 0


def test_provenance(spark):
    tokens = spark.createDataFrame([(1, w) for w in ("эк", "эк-эцк", "эк-ән", "келн-мелн", "-эцк", "шин")], "id long, word string")
    row = lexicon.provenance(tokens, spark.createDataFrame([("эк",)], "word string"), "id").first()
    assert (row.n_dict, row.n_split, row.n_model) == (1, 2, 3)


def test_russian_needs_cyrillic_words(spark):
    rows = spark.createDataFrame([("и the в a на 1",), ("a b",), ("күн һалун сән",)], "t string")
    assert [r[0] for r in rows.select(T.is_russian(F.col("t"))).collect()] == [True, False, False]


def test_goes_right(spark):
    freq = spark.createDataFrame([("morid", 198), ("dēn", 2012), ("bid", 5), ("dü", 9057)], "word string, n long")
    triples = spark.createDataFrame([("mori", "d", "ēn"), ("bi", "d", "ü"), ("mori", "d", "x")], "a string, b string, c string")
    assert {(r.a, r.c): r.right for r in lexicon.goes_right(triples, freq).collect()} == {("mori", "ēn"): True, ("bi", "ü"): True, ("mori", "x"): False}


def test_pen_lifts(spark):
    freq = spark.createDataFrame([(w, 9) for w in ("duun", "duudaqsan", "duula", "mori", "kele", "bēr")], "word string, n long")
    pairs = spark.createDataFrame([("d", "uu"), ("kele", "bēr")], "a string, b string")
    got = {r.a: (r.gain, r.lifted) for r in lexicon.pen_lifts(pairs, freq, 0.5).collect()}
    assert got["d"][1] and got["kele"] == (None, False)
