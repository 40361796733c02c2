import hashlib

from pyspark.sql import functions as F

from rowscrub.functions import names as N


def test_transliterate(column):
    values = ["Щука", "Объезд", "Юля Жук", "Ўзбек", "plain-1", "Ёж", None]
    assert column(N.transliterate, *values) == ["shchuka", "obezd", "yulya zhuk", "Ўzbek", "plain-1", "ezh", None]
    whole = "".join(N.CYRILLIC_TO_LATIN)
    latin = "".join(N.CYRILLIC_TO_LATIN.values())
    assert column(N.transliterate, whole, whole.upper()) == [latin, latin]


def test_every_letter(column):
    """The whole table once more, written out here and not taken from the engine."""
    want = (
        "а a б b в v г g д d е e ё e ж zh з z и i й y к k л l м m н n о o п p р r с s т t у u ф f х kh ц ts ч ch ш sh щ shch ы y э e ю yu я ya"
    ).split()
    letters, latin = want[::2], want[1::2]
    assert column(N.transliterate, *letters) == latin
    assert column(N.transliterate, *[c.upper() for c in letters]) == latin
    assert column(N.transliterate, "ъ", "ь", "Ъ", "Ь") == [""] * 4
    assert [c for c in ("ru", "kg", "uz", "tm", "ua", "by", "nl", "az", "kz", "en") if column(N.valid_country, c)[0]] == "ru kg uz tm ua by nl az".split()


def test_sanitize_name(column):
    values = ["Мой файл, v1.2", "!!!", "a..b", "-x-", "", None]
    assert column(N.sanitize_name, *values) == ["moy_fayl_v1_2", "data", "a_b", "x", "data", None]


def test_output_name(spark):
    cases = [
        ("ru", "Мой файл.csv", "acme-ru-moy_fayl_csv-2023-v1.parquet", True),
        ("KG", "dir/a.tar.gz", "acme-kg-a_tar_gz-2023-v1.parquet", True),
        ("nl", ".hidden", "acme-nl-hidden-2023-v1.parquet", True),
        ("nl", "x.CSV", "acme-nl-x_CSV-2023-v1.parquet", False),
        ("kz", "a.csv", None, False),
        (None, "a.csv", None, False),
    ]
    df = spark.createDataFrame([(i, c, n) for i, (c, n, _, _) in enumerate(cases)], "i int, c string, n string")
    name = N.output_name(F.col("c"), F.col("n"), F.lit(2023), "acme")
    got = df.select("i", name.alias("o"), N.valid_output_name(name, "acme").alias("ok")).orderBy("i").collect()
    assert [(r["o"], r["ok"]) for r in got] == [(o, ok) for _, _, o, ok in cases]


def test_valid_names(column):
    names = ["acme-ru-a-2023-v1.parquet", "acme-kz-a-2023-v1.parquet", "acme-ru-a-23-v1.parquet", "", None, "acme-ru-a-2023-v1.parquetx"]
    assert column(lambda c: N.valid_output_name(c, "acme"), *names) == [True] + [False] * 5
    assert column(N.valid_country, "KG", "kz", None) == [True, False, False]


def test_hashes(column):
    assert column(N.short_hash, "ab", "ю") == [hashlib.md5(v.encode()).hexdigest()[:20] for v in ("ab", "ю")]
    assert column(N.content_hash, "ab") == [hashlib.sha256(b"ab").hexdigest()]


def test_prefix_is_no_pattern(column):
    names = ("a.b-ru-x-2024-v1.parquet", "aXb-ru-x-2024-v1.parquet")
    assert column(lambda c: N.valid_output_name(c, "a.b"), *names) == [True, False]
