from parlance.sources import readers


def test_csv_encoding_is_decided_on_all_lines(spark, tmp_path):
    text = "ad;il\nAyse;Ankara\nAyşe;Muğla\nİnci;Kırşehir €\n"
    for name, data in (("cp1254", text.encode("cp1254")), ("utf8", text.encode()), ("bom", text.encode("utf-8-sig"))):
        (tmp_path / name).write_bytes(data)
        df = readers.csv_flexible(spark, str(tmp_path / name))
        assert df.columns == ["ad", "il"]
        assert [tuple(r) for r in df.collect()] == [("Ayse", "Ankara"), ("Ayşe", "Muğla"), ("İnci", "Kırşehir €")]
    (tmp_path / "latin1").write_bytes(b"a,b\n1,\xf0\x81\n")
    assert readers.csv_flexible(spark, str(tmp_path / "latin1")).first().b == "\xf0\x81"
    (tmp_path / "head").write_bytes("şehir,b\n1,2\n".encode("cp1254"))
    assert readers.csv_flexible(spark, str(tmp_path / "head")).columns == ["şehir", "b"]


def test_market_documents(spark):
    full = '{"chart":{"result":[{"timestamp":[86400,172800,259200],"indicators":{"quote":[{"open":[1,2,3],"high":[2,3],"close":[1.5,null,2.5],"volume":[10,20,30]}],"adjclose":[{"adjclose":[1.4]}]}},{"timestamp":[1]}]}}'
    docs = spark.createDataFrame([("a", full), ("none", '{"chart":{"result":[]}}'), ("bare", '{"chart":{"result":[{"timestamp":[1,2]}]}}'), ("bad", '{"chart": oops'), ("null", None)], "k string, j string")
    got = [tuple(r) for r in readers.chart(docs, "j", ["k"]).orderBy("timestamp").collect()]
    assert [(r[0], r[1], str(r[2]), *r[3:]) for r in got] == [("a", 86400, "1970-01-02", 1.0, 2.0, None, 1.5, 1.4, 10), ("a", 259200, "1970-01-04", 3.0, None, None, 2.5, None, 30)]
    assert sorted(r.k for r in readers.malformed(docs, "j").collect()) == ["bad", "null"]


def test_indicator_documents(spark):
    one = '[{"page":1},[{"indicator":{"id":"X"},"date":"2003","value":1.5},{"date":"2003","value":0.5},{"date":"1999","value":7},{"date":"2004","value":null},{"date":"x","value":1},{"date":"2005","value":"n/a"}]]'
    docs = spark.createDataFrame([("X", "gdp", one), ("Y", "cpi", '[{"message":"none"}]'), ("Z", "bad", "not json"), ("W", "cpi", '[{},[{"date":"2005","value":"3"}]]')], "c string, n string, j string")
    long = readers.indicators(docs, "j", "c", "n", 2002, 2010)
    assert sorted(((r.year, r.code, r.name, r.value) for r in long.collect()), key=str) == sorted([(2003, "X", "gdp", 1.5), (2003, "X", "gdp", 0.5), (2004, "X", "gdp", None), (2005, "X", "gdp", None), (2005, "W", "cpi", 3.0)], key=str)
    assert sorted(tuple(r) for r in readers.indicators_wide(long, ["gdp", "cpi"]).collect()) == [(2003, 0.5, None), (2005, None, 3.0)]


def test_rate_documents(spark):
    usd = lambda inner, attr="CurrencyCode": f'<Tarih_Date><Currency CurrencyCode="EUR"><ForexBuying>9</ForexBuying></Currency><Currency {attr}="USD">{inner}</Currency></Tarih_Date>'
    docs = [("both", usd("<ForexBuying>1.5</ForexBuying><ForexSelling>2,5</ForexSelling>")), ("one", usd("<ForexBuying/><ForexSelling>2</ForexSelling>", "Kod")), ("none", usd("<ForexBuying/>")), ("other", '<Tarih_Date><Currency CurrencyCode="EUR"><ForexBuying>9</ForexBuying></Currency></Tarih_Date>'), ("bad", "<Tarih"), ("null", None)]
    got = readers.rates(spark.createDataFrame(docs, "k string, x string"), "x", ["k"])
    assert sorted(tuple(r) for r in got.collect()) == [("both", 1.5, 2.5, 2.0, 2.5, 1.5), ("one", None, 2.0, 2.0, 2.0, 2.0)]
