from datetime import date

import pytest
from pyspark.sql import functions as F

from parlance.functions import lexicon
from parlance.functions import text as T
from parlance.operators import tagging


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in df.select(f(F.col("x")).alias("y")).collect()]


def test_turkish_letters_fold(spark):
    got = one(spark, T.normalize_text, "İSTANBUL’da Çığ, ŞÖLEN—Ünlü!", "ﬁnal x", None, "a_b-c.d  e")
    assert got == ["istanbul da cig solen-unlu", "final x", None, "a_b-c.d e"]
    assert one(spark, T.normalize_light, "Çok ŞÛkÎr") == ["çok şukir"]
    assert one(spark, T.normalize_name_key, "AK PARTİ GRUBU ADINA MEMET, ATİLA'", None) == ["mehmet atilla", ""]
    assert one(spark, T.slug_event, "15 July / OHAL-Şok") == ["15_july___ohal_sok"]


@pytest.mark.parametrize("raw,want", [("5.2007", date(2007, 5, 1)), ("03.11.2002", date(2002, 11, 3)), ("3 Kasım 2002", date(2002, 11, 3)), ("Kasım 2002", date(2002, 11, 1)), ("31.02.2002", None), ("13.2002", None), ("x", None), (None, None)])
def test_local_dates(spark, raw, want):
    assert one(spark, T.parse_local_date, raw) == [want]


def test_numbers_and_labels(spark):
    assert one(spark, T.to_number, "1,5", "x", None) == [1.5, None, None]
    assert one(spark, T.to_rate, "1500000", "2,5") == [1.5, 2.5]
    assert one(spark, lambda c: T.range_label(c, [(1, 5, "a"), (6, 9, "b")]), "3", "9", "20", "q") == ["a", "b", "Bilinmiyor", "Hata"]
    assert one(spark, T.speaker_confidence, "AB", "ALİ Veli", "ÇAĞ") == [0.0, 4 / 7, 1.0]


def test_windows_and_double_counts(spark):
    text = "x" * 100 + " ekonomik kriz sorun destek " + "y" * 120
    df = spark.createDataFrame([(1, text), (2, "stand-by anlasmasi"), (3, "")], "speech_id int, text string")
    rows = tagging.concept_edges(df, ["speech_id"]).collect()
    assert len(rows) == 1  # stand-by alone doesn't pass the prefilter
    r = rows[0]
    assert (r.concept, r.mention_count, r.pos, r.neg) == ("economy", 2, 2, 4)  # one word matches two patterns: two windows
    assert r.salience == pytest.approx(2 + 0.35 * 6) and r.label == "negative"
    assert len(lexicon.CONCEPTS) == 12 and len(lexicon.POSITIVE) == 21 and len(lexicon.NEGATIVE) == 23


def test_dates_with_month_names_and_session_starts(spark):
    from parlance.operators import turns

    rows = [("3 Kasım 2002 Pazar", "3Kasım2002"), ("TBMM\n12  Ağustos  1999", "12Ağustos1999"), ("7 . 2003", "7.2003"), ("3 March 2002", "Bilinmiyor"), ("", "Bilinmiyor")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", turns.first_date(F.col("t")).alias("got")).collect())
    texts = [("head\n  Açılma Saati: 15.00\nbody", "\n  Açılma Saati: 15.00\nbody"), ("head\nbirinci oturum", "\nbirinci oturum"), ("x Açılma Saati", None), ("BİRİNCİ OTURUM\na", "BİRİNCİ OTURUM\na")]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select("t", turns.trim_to(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [w or t for t, w in texts]
