"""Scalar functions against fixed vectors."""

import pytest
from pyspark.sql import functions as F

from weftwise.functions import aliases, phonetic, registry, similarity, text


def values(spark, rows, *columns):
    n = len(rows[0])
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(n)))
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_normalize(spark):
    rows = [("Döllinger", "doellinger", "dollinger"), ("Weiß-Müller", "weiss mueller", "weiss muller"), ("Max   Mustermann", "max mustermann", "max mustermann"), ("  Meyer\t", "meyer", "meyer"), ("Renée", "ren e", "ren e"), ("O'Neil", "o neil", "o neil"), ("123", "", ""), (None, "", "")]
    got = values(spark, [(r[0],) for r in rows], text.normalize_a(F.col("c0")), text.normalize_b(F.col("c0")))
    assert got == [r[1:] for r in rows]


def test_koelner(spark):
    # Codes by the published rules.
    codes = {"meyer": "67", "maier": "67", "selner": "8567", "sellner": "8567", "": "", "mueller": "657", "mueller123": "657", "karl": "475", "carl": "475", "philipp": "351", "filip": "351", "xaver": "4837", "maxx": "64848", "schmidt": "862", "christian": "47826", "anna": "06", "mam": "66", "weiss kruger": "384747", "h": "", "hh": ""}
    assert [x for (x,) in values(spark, [(k,) for k in codes], phonetic.koelner(F.col("c0")))] == list(codes.values())


def test_first_letters_and_aliases(spark):
    want = {"Sel": "Sel,Zel,Cel", "Gal": "Gal,Kal,Qal,Cal", "Car": "Car,Gar,Kar,Qar,Sar,Zar", "Bau": "Bau,Pau", "Lan": "Lan", "": "", "sel": "sel,zel,cel"}
    got = values(spark, [(k,) for k in want], phonetic.first_letter_variants(F.col("c0")))
    assert [set(x) for (x,) in got] == [set(v.split(",")) for v in want.values()]
    names = {"mike": {"mai", "mar"}, "maik": {"mik", "mar"}, "philipp": set(), "emma": set(), "marc": set(), "stefan": set()}
    assert [set(x) for (x,) in values(spark, [(k,) for k in names], aliases.alias_prefixes(F.col("c0"), aliases.FIRST_NAMES))] == list(names.values())
    assert {x for r in values(spark, [("meyer",)], aliases.alias_prefixes(F.col("c0"), aliases.LAST_NAMES)) for x in r[0]} == {"mai", "may", "mei"}


def test_match_quality(spark):
    rows = [("Maik", "Maik", 1.0), ("M", "Maik", 0.25), ("Selner", "Sellner", 1.0), ("Meyer", "Zzzzzzzzzz", 0.0), ("Meyer", "Maier", 0.95), ("Mike", "Maik", 0.85), ("Müller", "Mueller", 1.0), ("L", "Lander", 1 / 6), ("L", "Lehmann", 1 / 7), ("Fellner", "Sellner", 6 / 7), ("H", "HH", 0.85), ("123", "Anna", 0.0)]
    got = values(spark, [r[:2] for r in rows], similarity.match_quality(F.col("c0"), F.col("c1")))
    assert [x for (x,) in got] == pytest.approx([r[2] for r in rows])


def test_points(spark):
    lit = F.lit
    row = spark.range(1).select(
        *[similarity.stage_points(lit(float(a)), lit(float(b))) for a, b in ((1, 1), (0, 0), (1, 0.1667), (1, 0), (0, 1))],
        *[similarity.representation_points(lit(a), lit(b)) for a, b in ((4, 4), (3, 4), (2, 4), (1, 4), (0, 0), (1, 1))],
        *[similarity.uniqueness_points(lit(n)) for n in (1, 2, 3, 5, 0)],
        *[similarity.hint_matches(lit(h), lit(n)) for h, n in (("Land", "Lander"), ("LAND", "lander"), ("Land", "Meyer"), ("", "Lander"))],
        similarity.with_hint(lit(45), lit(True)),
    ).first()
    assert list(row) == [50, 0, 23, 18, 33, 30, 20, 10, 0, 0, 30, 20, 10, 0, 0, 0, True, True, False, False, 50]


def test_parsing(spark):
    tags = {"<firstname>Maik</firstname>": "Maik", "<main>Maik <last>Lander</last></main>": "Maik Lander", "<empty></empty>": "", None: ""}
    assert [x for (x,) in values(spark, [(k,) for k in tags], text.strip_tags(F.col("c0")))] == list(tags.values())
    words = {'[{"word":"Maik","start":0,"confidence":0.9},{"word":"Lander"}]': "Maik Lander", "": None, "not json": None, "[]": None, '{"word":"x"}': None, '[{"word":5}]': None, '[{"word":""}]': None, None: None}
    assert [x for (x,) in values(spark, [(k,) for k in words], text.structured_words(F.col("c0")))] == list(words.values())
    lists = [x for (x,) in values(spark, [(" A.example.com , B.example.com ",), (" , , ",), (None,)], text.parse_list(F.col("c0"), lower=True))]
    assert lists == [["a.example.com", "b.example.com"], [], []]
    split = values(spark, [("Anna von der Heide",), ("Anna",), (" Anna  Maria ",)], text.split_first(F.col("c0")), text.split_last(F.col("c0")))
    assert split == [("Anna", "von der Heide"), ("Anna", ""), ("Anna", "Maria")]
    assert [x for (x,) in values(spark, [("a@B.c",), ("a@b@C",), ("none",), ("x@",), (None,)], text.email_domain(F.col("c0")))] == ["b.c", "c", "", "", ""]


def test_functions_by_name(spark):
    assert set(registry.register(spark)) == set(registry.FUNCTIONS)
    df = spark.createDataFrame([("Weiß-Müller\t", "Mueller Weis", "a@B.C"), ("", "", ""), (None, "x", None), ("Maik", "Mike", "x@"), ("Schmidt", "Schmitt", "none")], "a string, b string, e string")
    a, b = F.col("a"), F.col("b")
    pairs = {
        "trim_all(a)": text.utrim(a), "normalize_a(a)": text.normalize_a(a), "normalize_b(a)": text.normalize_b(a), "sound_code(normalize_b(a))": phonetic.koelner(text.normalize_b(a)), "email_domain(e)": text.email_domain(F.col("e")),
        "fuzzy_ratio(a, b)": similarity.fuzzy_ratio(a, b), "match_quality(a, b)": similarity.match_quality(a, b), "stage_points(0.25, match_quality(a, b))": similarity.stage_points(F.lit(0.25), similarity.match_quality(a, b)),
    }
    for sql, column in pairs.items():
        assert df.select((F.expr(sql).eqNullSafe(column)).alias("same")).filter("not same").isEmpty(), sql
