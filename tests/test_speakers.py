from pyspark.sql import functions as F

from parlance.functions import speakers as S
from parlance.operators import directed, turns


def one(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_speaker_lines(spark):
    lines = ["ALİ ÇELİK (Ankara) - Sayın Başkan, değerli üyeler", "AYŞE ŞAHİN -", "MEHMET ÖZ 12", "12. BİRLEŞİM", "Açılma Saati: 14.00", "XIV", "12 34", "BİRİNCİ OTURUM", "ali çelik", "Sayfa 3", "A", None]
    got = one(spark, S.speaker_line, lines)
    assert (got[0].speaker, got[0].meta, got[0].speech, got[0].variant) == ("ALİ ÇELİK", "Ankara", "Sayın Başkan, değerli üyeler", "inline")
    assert (got[1].speaker, got[1].variant) == ("AYŞE ŞAHİN", "header_only") and got[2:] == [None] * 10
    assert one(spark, S.looks_like_speaker, lines) == [False, True, True, False, False, False, False, False, False, False, False, None]
    assert one(spark, S.is_garbage, lines)[3:5] == [True, True] and one(spark, S.is_garbage, ["içindekiler", "kâtip üyeler : x", "katip"]) == [True, True, False]


def test_party_labels(spark):
    got = one(spark, S.party_label, ["İYİ Parti", " Yeni Yol ", "22", "CHP'den istifa", "AK PARTİ GRUBU", "nan", "", None, "Başka"])
    assert got == ["İYİ Parti", "YENİ YOL Partisi", None, None, "Adalet ve Kalkınma Partisi", None, None, None, None]


def test_sanitize_takes_long_gaps_in_one_pass(spark):
    # going back over white space would take the cube of its length
    text = "kanun" + " \n" * 4000 + "- AN" + "\n" * 4000 + "KARA"
    assert one(spark, S.sanitize, [text]) == ["kanun \n" + " \n" * 3999 + "- ANKARA"]


def test_sanitize(spark):
    text = "kanun tekli\n\nfi ve AN\n\n\nKARA, Meclis\n\nBaşkanı “söz” – aldı\r\n\r\n\r\n\r\nson…  bitti"
    # a break is closed before lower case and after a short left part, whatever the sentence
    assert one(spark, S.sanitize, [text, None, ""]) == ['kanun teklifi ve ANKARA, MeclisBaşkanı "söz" - aldıson... bitti', "", ""]


def test_sanitize_joins_parts_as_the_plain_loop(spark):
    """Compatibility form first; a right part is no left part in the same round; parts of 12 and 13 letters."""
    import random
    import re
    import unicodedata

    letters = "A-Za-zÇĞİÖŞÜÂÎÛçğıöşüâîû"
    parts = re.compile(rf"([{letters}]{{1,12}})\s*\n\s*\n\s*([{letters}'][{letters}']{{0,12}})")
    signs = {"\u2013": "-", "\u2014": "-", "\u2212": "-", "\x96": "-", "\xad": "", "\u200b": "", "\u2019": "'", "\x85": "...", "\u201c": '"'}

    def join(m):
        a, b = m.groups()
        return a + b if b[0].islower() or (a.isupper() and b.isupper() and len(a) + len(b) <= 24) or (a[-1].islower() and len(a) <= 6) else m.group(0)

    def plain(t):
        t = unicodedata.normalize("NFKC", t).replace("\r\n", "\n").replace("\r", "\n")
        for old, new in signs.items():
            t = t.replace(old, new)
        for _ in range(8):
            t = parts.sub(join, t)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))

    rng = random.Random(11)
    word = lambda: "".join(rng.choice(rng.choice(["AİŞ", "aışç", "AB", "aB'"])) for _ in range(rng.choice([1, 2, 5, 6, 7, 11, 12, 13, 14, 20])))
    same = lambda: rng.choice([str.upper, str.lower, str])(word().replace("i", "ı"))
    gaps = ["\n\n", " \n\n\n", "\r\n \r\n", "\n", " ", "\n\u3000\n", "\u2028\n\n", "\x1c\n\n", "\n\n- ", "\x85\n\n", "\xad"]
    texts = ["ﬁrma ㎏ Ａ\n\nＢ x²", "a\n\nB\n\nC", "Meclislerin\n\nBaşkan\n\nlar", "\n\n".join("A" * 1 for _ in range(9)), "x\n\n" * 400 + "x", "A" * 12 + "\n\n" + "B" * 13, "A" * 11 + "\n\n" + "B" * 13, "C" * 14 + "\n\n" + "B" * 12]
    texts += ["".join(same() + rng.choice(gaps[:3] if rng.random() < 0.7 else gaps) for _ in range(rng.randint(2, 12))) for _ in range(600)]
    assert one(spark, S.sanitize, texts) == [plain(t) for t in texts]


def test_merge_split_lines(spark):
    rows = ["ALİ ÇELİK", " - Teşekkür ederim", "", "AYŞE ŞAHİN", "MEHMET ÖZ", ": evet", "- yok"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(rows)], "doc int, pos int, line string")
    got = [r.line for r in turns.merge_split_lines(df, "doc").orderBy("pos").collect()]
    assert got == ["ALİ ÇELİK - Teşekkür ederim", "", "AYŞE ŞAHİN", "MEHMET ÖZ - evet", "- yok"]


def test_resolution_stages(spark):
    roster = spark.createDataFrame([("22", "Ali Çelik", 1, "A"), ("22", "Ayşe Nur Şahin", 2, "B"), ("23", "Veli Can", 3, "C"), ("22", "Alı Kara", 4, "D")], "term string, clean_name string, row int, party string")
    roster = turns.roster_index(roster, "term", "clean_name", "row")
    names = ["ALİ ÇELİK", "SAYIN ALİ ÇELİKOĞLU", "ŞAHİN AYŞE", "VELİ CAN", "BAŞKAN VEKİLİ", "BAŞBAKAN", "İZZET ÇELİK", "CHP GRUBU ADINA BİRİ", "x", None]
    df = spark.createDataFrame([(n, "22") for n in names], "speaker string, term string")
    got = {r.speaker: (r.party, r.clean_name, r.stage) for r in turns.resolve_speakers(df, roster).collect()}
    assert got["ALİ ÇELİK"] == ("A", "Ali Çelik", "exact") and got["SAYIN ALİ ÇELİKOĞLU"] == ("A", "Ali Çelik", "near")
    assert got["ŞAHİN AYŞE"] == ("B", "Ayşe Nur Şahin", "near") and got["VELİ CAN"] == ("C", "Veli Can", "anywhere")
    assert got["BAŞKAN VEKİLİ"][:2] == turns.PRESIDING and got["BAŞBAKAN"][2] == "unknown" and got["İZZET ÇELİK"][1] == "İZZET ÇETİN"
    assert got["CHP GRUBU ADINA BİRİ"] == ("Cumhuriyet Halk Partisi", "CHP GRUBU ADINA BİRİ", "prefix") and got["x"] == ("Bilinmeyen", "X", "unknown") and got[None][2] == "unknown"
    assert len(got) == len(names)


def test_directed_mentions(spark):
    texts = spark.createDataFrame([(1, "A", "b partisi krizi sorun, reform icin destek"), (2, "B", "b partisi"), (3, "C", "a partisi")], "id int, party string, text string")
    w = directed.target_windows(texts, {"A": ["a partisi"], "B": ["b partisi", "be"]}, "party")
    got = directed.directed_mentions(w, ["id", "party", "target"]).collect()
    assert len(got) == 1
    r = got[0]
    # one mention, two negative and one positive hit, one topic hit: 1 + 0.35 * 3 + 0.2
    assert (r.target, r.mention_count, r.pos, r.neg, r.topic) == ("B", 1, 1, 2, "reform") and abs(r.total_weight - 2.25) < 1e-9
    assert r.frame_label == "negative" and abs(r.negative_weight - 2.25 * 0.25) < 1e-9 and r.positive_weight == 0
