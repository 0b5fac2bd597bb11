"""Registered queries: speaker lines, speaker resolution, directed mentions, text audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import speakers as S
from parlance.functions import text as T
from parlance.operators import audit, directed, tagging, turns
from parlance.sources.tables import spread

from . import fixtures as X
from .registry import query
from .sqlkit import bal, r6, rounded
from .text_queries import NEG, POS, STEMS, _ascii, _tag_texts, _ASCII, _D

# lines of transcripts made from the rows of part; the expression means the same in both engines
_LINE = """CASE p_partkey % 13 WHEN 0 THEN upper(p_name) || ' (Ankara) - ' || p_brand WHEN 1 THEN upper(p_name) || ' -' WHEN 2 THEN '12. BİRLEŞİM'
  WHEN 3 THEN 'Sayfa 44' WHEN 4 THEN 'XIV' WHEN 5 THEN p_name WHEN 6 THEN upper(p_name) WHEN 7 THEN '- devam ' || p_brand WHEN 8 THEN upper(p_name) || ' 77'
  WHEN 9 THEN 'BİRİNCİ OTURUM' WHEN 10 THEN upper(p_name) || ' ' || upper(p_type) || ' (' || p_brand || ') : söz' WHEN 11 THEN '12 34' ELSE ': ' || p_type END"""
_LINES = f"ln AS (SELECT p_partkey, p_partkey // 40 AS doc, p_partkey % 40 AS pos, {_LINE} AS line FROM part)"


def _lines(spark, sf):
    p = X.table(spark, sf, "part")
    return p.select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("doc"), (F.col("p_partkey") % 40).alias("pos"), F.expr(_LINE).alias("line"))


_GARBAGE = "regexp_matches(upper({0}), '" + "|".join(S.GARBAGE).replace("Açılma Saati", "AÇILMA SAATI").replace("Kapanma Saati", "KAPANMA SAATI").replace("Başkanlık Divanı", "BAŞKANLIK DIVANI").replace("Sayfa", "SAYFA") + "')"
_TOKENS = r"list_filter(string_split_regex(regexp_replace({0}, '\([^)]*\)', ' ', 'g'), '[\s./-]+'), lambda t: t <> '')"


def _speaks(c: str) -> str:
    """SQL of looks_like_speaker for a column."""
    line = rf"regexp_replace(trim({c}), '\s+\d+\s*$', '')"
    bare = rf"regexp_replace({line}, '\([^)]*\)', ' ', 'g')"
    letters, small = rf"len(regexp_extract_all({bare}, '\p{{L}}'))", rf"len(regexp_extract_all({bare}, '\p{{Ll}}'))"
    tokens = _TOKENS.format(line)
    words = ", ".join(f"'{w}'" for w in S.NOT_NAMES)
    return rf"""(length({line}) BETWEEN 3 AND 180 AND NOT {_GARBAGE.format(line)} AND {letters} >= 3 AND ({letters} - {small}) / {letters}::DOUBLE >= 0.78
      AND len({tokens}) BETWEEN 1 AND 18 AND NOT (len({tokens}) <= 3 AND len(list_filter({tokens}, lambda t: NOT regexp_full_match(t, '[IVXLCM]+'))) = 0)
      AND len(list_filter({tokens}, lambda t: NOT regexp_full_match(t, '\d+'))) > 0 AND len(list_filter({tokens}, lambda t: regexp_full_match(t, '\d+'))) <= 1
      AND NOT (len({tokens}) <= 3 AND len(list_filter({tokens}, lambda t: t IN ({words}))) > 0))"""


@query("line_is_garbage", f"WITH {_LINES} SELECT p_partkey, {_GARBAGE.format('line')} AS garbage FROM ln")
def line_is_garbage(spark, sf):
    return _lines(spark, sf).select("p_partkey", S.is_garbage(F.col("line")).alias("garbage"))


@query("looks_like_speaker", f"WITH {_LINES} SELECT p_partkey, {_speaks('line')} AS speaker FROM ln")
def looks_like_speaker(spark, sf):
    return _lines(spark, sf).select("p_partkey", S.looks_like_speaker(F.col("line")).alias("speaker"))


def _form(pattern: str, group: int) -> str:
    return f"trim(regexp_extract(line, '{pattern.replace(chr(39), chr(39) * 2)}', {group}))"


_NAME_OF = lambda p: rf"regexp_replace({_form(p, 1)}, '\s+\d+\s*$', '')"


@query("extract_speaker_line", rf"""WITH {_LINES}, f AS (SELECT p_partkey, line, {_NAME_OF(S.INLINE)} AS n1, {_form(S.INLINE, 2)} AS m1, {_form(S.INLINE, 3)} AS s1, {_NAME_OF(S.HEADER)} AS n2, {_form(S.HEADER, 2)} AS m2 FROM ln),
  g AS (SELECT *, n1 <> '' AND {_speaks('n1')} AS a, n2 <> '' AND {_speaks('n2')} AS b FROM f)
  SELECT p_partkey, CASE WHEN a THEN n1 ELSE n2 END AS speaker, CASE WHEN a THEN m1 ELSE m2 END AS meta, CASE WHEN a THEN s1 ELSE '' END AS speech, CASE WHEN a THEN 'inline' ELSE 'header_only' END AS variant FROM g WHERE a OR b""")
def extract_speaker_line(spark, sf):
    return _lines(spark, sf).select("p_partkey", S.speaker_line(F.col("line")).alias("s")).where("s is not null").select("p_partkey", "s.*")


@query("merge_split_lines", rf"""WITH {_LINES}, n AS (SELECT doc, pos, trim(line) AS line, {_speaks('line')} AS name, regexp_matches(line, '^\s*[-:]\s*(.*)$') AS rest FROM ln),
  k AS (SELECT *, coalesce(lag(name) OVER w AND rest, false) AS link FROM n WINDOW w AS (PARTITION BY doc ORDER BY pos)), r AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM k),
  t AS (SELECT *, (row_number() OVER (PARTITION BY doc, run ORDER BY pos) - 1) % 2 = 1 AS taken FROM r), u AS (SELECT *, lead(taken) OVER w AS take, lead(line) OVER w AS nxt FROM t WINDOW w AS (PARTITION BY doc ORDER BY pos))
  SELECT doc, pos, CASE WHEN take THEN trim(line || ' - ' || trim(regexp_extract(nxt, '^\s*[-:]\s*(.*)$', 1))) ELSE line END AS line FROM u WHERE NOT taken""")
def merge_split_lines(spark, sf):
    return turns.merge_split_lines(_lines(spark, sf).select("doc", "pos", "line"), "doc")


# what is no letter becomes a break of several lines and a dash, and words are broken before, in and after their parts
_GAP = r"\s*\n\s*\n\s*"
_JOINED = "|".join([rf"([A-Za-z]{{1,12}}){_GAP}([a-z][A-Za-z]{{0,12}})", rf"([A-Z]{{1,11}}){_GAP}([A-Z]{{13}}|[A-Z]{{1,12}}\b)", rf"([A-Z]{{12}}){_GAP}([A-Z]{{1,12}}\b)", rf"([A-Za-z]{{0,5}}[a-z]){_GAP}([A-Za-z]{{1,13}})", rf"([A-Za-z]{{1,12}}{_GAP}[A-Za-z]{{1,13}})"])
_ROUNDS = "broken"
for _ in range(8):
    _ROUNDS = rf"regexp_replace({_ROUNDS}, '{_JOINED}', '\1\2\3\4\5\6\7\8\9', 'g')"


@query("sanitize_transcript", rf"""WITH nl AS (SELECT chr(10) AS n), br AS (SELECT doc_id, replace(replace(replace(regexp_replace(text, '[^a-zA-Z ]+', ' ' || n || n || n || '- ', 'g'), 'ing', 'IN' || n || ' ' || n || 'G'), 'sth', 'st' || n || n || 'h'), 'den', 'd' || n || n || 'En') AS broken FROM documents, nl)
  SELECT doc_id, md5(regexp_replace(regexp_replace({_ROUNDS}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM br""")
def sanitize_transcript(spark, sf):
    # line ends in three spellings and a long dash
    broken = F.regexp_replace("text", "[^a-zA-Z ]+", " \r\n\r\r\n— ")
    for old, new in (("ing", "IN\r \r\nG"), ("sth", "st\r\n\r\nh"), ("den", "d\n\nEn")):
        broken = F.replace(broken, F.lit(old), F.lit(new))
    return X.table(spark, sf, "documents").select("doc_id", F.md5(S.sanitize(broken).cast("binary")).alias("text"))


_LABEL = """CASE p_partkey % 9 WHEN 0 THEN ' Doğru Yol Partisi ' WHEN 1 THEN 'Yeni Yol' WHEN 2 THEN '12' WHEN 3 THEN p_name || ' istifa' WHEN 4 THEN 'mhp ' || p_brand WHEN 5 THEN p_brand WHEN 6 THEN ' ' WHEN 7 THEN 'NaN' ELSE 'x CUMHURİYET HALK y' END"""


@query("party_label_clean", f"SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Doğru Yol Partisi' WHEN 1 THEN 'YENİ YOL Partisi' WHEN 4 THEN 'Milliyetçi Hareket Partisi' WHEN 8 THEN 'Cumhuriyet Halk Partisi' END AS party FROM part")
def party_label_clean(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", S.party_label(F.expr(_LABEL)).alias("party"))


# a roster of every fifth part's words, and speakers in the forms that the stages of the cascade meet
_SPOKEN = """CASE p_partkey % 8 WHEN 0 THEN upper(p_name || ' ' || p_type) WHEN 1 THEN 'SAYIN ' || upper(p_name || ' ' || p_type) WHEN 2 THEN upper(p_type || ' ' || p_name)
  WHEN 3 THEN 'BAŞKAN ' || upper(p_name) WHEN 4 THEN 'MHP ' || p_brand WHEN 5 THEN upper(p_name) WHEN 6 THEN 'İZZET ÇELİK' ELSE p_brand || ' ' || p_type END"""
_KEY = r"trim(regexp_replace(lower(translate(translate(upper({0}), 'ÇĞİÖŞÜÂÎÛI', 'CGIOSUAIUI'), '.,''', '   ')), '\s+', ' ', 'g'))"
_RESOLVE = rf"""ro AS (SELECT p_size % 3 AS term, lower(p_name || ' ' || p_type) AS name_key, max(p_partkey) AS row, min(p_partkey) AS place, arg_max(p_brand, p_partkey) AS party, arg_max(p_name || ' ' || p_type, p_partkey) AS clean_name FROM part WHERE p_partkey % 5 = 0 GROUP BY ALL),
  sp AS (SELECT DISTINCT {_SPOKEN} AS speaker, p_size % 4 AS term FROM part WHERE p_partkey % 5 <> 0), sk AS (SELECT *, {_KEY.format('speaker')} AS k, string_split({_KEY.format('speaker')}, ' ') AS ws FROM sp),
  nr AS (SELECT s.speaker, s.term, arg_min(party, place) AS party, arg_min(clean_name, place) AS clean_name FROM sk s JOIN ro r ON s.term = r.term AND ((length(name_key) > 5 AND contains(k, name_key)) OR
    (len(list_intersect(ws, string_split(name_key, ' '))) >= 2 AND (len(list_intersect(ws, string_split(name_key, ' '))) = len(list_distinct(ws)) OR len(list_intersect(ws, string_split(name_key, ' '))) = len(list_distinct(string_split(name_key, ' ')))))) GROUP BY ALL),
  an AS (SELECT name_key, arg_max(party, row) AS party, arg_max(clean_name, row) AS clean_name FROM ro GROUP BY 1),
  rs AS (SELECT s.speaker, s.term, CASE WHEN k = 'izzet celik' THEN 'Adalet ve Kalkınma Partisi' WHEN contains(k, 'baskan') THEN 'MECLİS BAŞKANLIĞI' ELSE coalesce(e.party, nr.party, an.party, CASE WHEN contains(s.speaker, 'MHP') THEN 'Milliyetçi Hareket Partisi' END, 'Bilinmeyen') END AS party,
    CASE WHEN k = 'izzet celik' THEN 'İZZET ÇETİN' WHEN contains(k, 'baskan') THEN 'BAŞKAN' ELSE coalesce(e.clean_name, nr.clean_name, an.clean_name, upper(s.speaker)) END AS clean_name
    FROM sk s LEFT JOIN ro e ON e.term = s.term AND e.name_key = s.k LEFT JOIN nr ON nr.speaker = s.speaker AND nr.term = s.term LEFT JOIN an ON an.name_key = s.k)"""


def _spoken(spark, sf):
    p = X.table(spark, sf, "part")
    return p.where("p_partkey % 5 <> 0").select("p_partkey", F.expr(_SPOKEN).alias("speaker"), (F.col("p_size") % 4).alias("term"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'BAKANLAR KURULU' ELSE p_brand END").alias("party"))


def _roster(spark, sf):
    p = X.table(spark, sf, "part").where("p_partkey % 5 = 0")
    r = p.select((F.col("p_size") % 3).alias("term"), F.concat_ws(" ", "p_name", "p_type").alias("clean_name"), F.col("p_partkey").alias("row"), F.col("p_brand").alias("party"))
    return turns.roster_index(r, "term", "clean_name", "row")


@query("resolve_speaker", f"WITH {_RESOLVE} SELECT * FROM rs")
def resolve_speaker(spark, sf):
    return turns.resolve_speakers(_spoken(spark, sf), _roster(spark, sf)).drop("stage")


@query("reresolve_dataset", f"""WITH {_RESOLVE}, d AS (SELECT {_SPOKEN} AS speaker, p_size % 4 AS term, CASE WHEN p_partkey % 3 = 0 THEN 'BAKANLAR KURULU' ELSE p_brand END AS now FROM part WHERE p_partkey % 5 <> 0),
  f AS (SELECT now, CASE WHEN now = 'BAKANLAR KURULU' AND party = 'Bilinmeyen' THEN now ELSE party END AS new_party, clean_name AS new_speaker FROM d JOIN rs USING (speaker, term)) SELECT new_party, new_speaker, count(*) AS n, count(*) FILTER (WHERE now <> new_party) AS changed FROM f GROUP BY ALL""")
def reresolve_dataset(spark, sf):
    r = turns.reresolve(_spoken(spark, sf), _roster(spark, sf))
    return r.groupBy("new_party", "new_speaker").agg(F.count("*").alias("n"), F.count_if(F.col("party") != F.col("new_party")).alias("changed"))


@query("speech_filters", rf"""WITH s AS (SELECT source, doc_id, len(regexp_extract_all({_ASCII}, '[a-z]+')) AS n, length(text) AS chars FROM documents) SELECT CASE WHEN source = 'src1' THEN 'role' WHEN doc_id % 10 = 3 THEN 'date' WHEN n < 60 OR chars < 400 THEN 'short' ELSE 'kept' END AS step, count(*) AS rows FROM s GROUP BY 1""")
def speech_filters(spark, sf):
    d = X.table(spark, sf, "documents")
    day = F.when(F.col("doc_id") % 10 != 3, F.lit("2003-05-01").cast("date"))
    s = d.select("text", F.col("source").alias("party"), day.alias("date"), T.count_words(_ascii()).alias("word_count"))
    return tagging.speech_filters(s, ["src1"], "2002-01-01", "2004-01-01", 60, 400)[1]


# directed mentions: documents of a language name other languages by words
_ALIASES = {"en": ["der die", "de"], "fr": ["the", "of and"], "de": ["que", "el la"], "es": ["und", "le"]}
_ALIAS = {k: [rf"\b{a.replace(' ', chr(92) + 's+')}\b" for a in v] for k, v in _ALIASES.items()}
_TW = "dd AS (SELECT doc_id, lang, " + _ASCII + " AS t FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')), tw AS (" + " UNION ALL ".join(
    f"""SELECT doc_id, lang AS source, '{k}' AS target, unnest(list_transform(range(1, len(hits) + 1), lambda i: [coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0), length(hits[i])])) AS loc, t
    FROM (SELECT doc_id, lang, t, string_split_regex(t, '{p}') AS parts, regexp_extract_all(t, '{p}') AS hits FROM dd WHERE lang <> '{k}')"""
    for k, ps in _ALIAS.items()
    for p in ps
) + "), kw AS (SELECT doc_id, source, target, loc[1] AS start, substring(t, (greatest(loc[1] - 120, 0) + 1)::BIGINT, (least(loc[1], 120) + loc[2] + 120)::BIGINT) AS win FROM tw)"
_HITS = lambda ps: " + ".join(f"len(regexp_extract_all(win, '{p}'))" for p in ps)
_TOPICS = "tp AS (SELECT *, " + ", ".join(f"{_HITS(ps)} AS h{i}" for i, (_, _, _, ps) in enumerate(STEMS)) + f", {_HITS(POS)} AS pos, {_HITS(NEG)} AS neg FROM kw), tq AS (SELECT *, greatest(h0, h1, h2) AS hits, CASE WHEN greatest(h0, h1, h2) = 0 THEN NULL WHEN h0 = greatest(h0, h1, h2) THEN '{STEMS[0][0]}' WHEN h1 = greatest(h0, h1, h2) THEN '{STEMS[1][0]}' ELSE '{STEMS[2][0]}' END AS topic FROM tp)"


def _targets(spark, sf):
    d = X.table(spark, sf, "documents").where(F.col("lang").isin(list(_ALIASES))).select("doc_id", "lang", "text")
    d = spread(d).select("doc_id", F.col("lang").alias("source"), _ascii().alias("text"))
    return directed.target_windows(d, _ALIASES, "source")


@query("target_windows", f"WITH {_TW} SELECT doc_id, source, target, md5(win) AS win, count(*) AS n FROM kw GROUP BY ALL")
def target_windows(spark, sf):
    w = _targets(spark, sf)
    return w.groupBy("doc_id", "source", "target", F.md5(F.col("window").cast("binary")).alias("win")).agg(F.count("*").alias("n"))


@query("window_topic", f"WITH {_TW}, {_TOPICS} SELECT topic, count(*) AS windows, sum(hits)::BIGINT AS hits FROM tq GROUP BY 1")
def window_topic(spark, sf):
    t = directed.with_topic(_targets(spark, sf), STEMS)
    return t.groupBy("topic").agg(F.count("*").alias("windows"), F.sum("topic_hits").cast("bigint").alias("hits"))


@query("directed_mentions", f"""WITH {_TW}, {_TOPICS}, s AS (SELECT doc_id, source, target, count(*) AS mention_count, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg, sum(hits)::BIGINT AS topic_hits FROM tq GROUP BY ALL),
  d1 AS (SELECT doc_id, target, topic, sum(hits) AS h FROM tq WHERE topic IS NOT NULL GROUP BY ALL), d2 AS (SELECT doc_id, target, arg_max(topic, (h, -CASE topic WHEN '{STEMS[0][0]}' THEN 0 WHEN '{STEMS[1][0]}' THEN 1 ELSE 2 END)) AS topic FROM d1 GROUP BY ALL),
  v AS (SELECT s.*, mention_count + 0.35::DOUBLE * (pos + neg) + 0.2::DOUBLE * least(topic_hits, 5) AS total, {bal('pos', 'neg')} AS score FROM s),
  x AS (SELECT *, CASE WHEN abs(score) < 0.2 THEN 0 ELSE total * greatest(score, 0) END AS pw, CASE WHEN abs(score) < 0.2 THEN 0 ELSE total * abs(least(score, 0)) END AS nw FROM v)
  SELECT doc_id, source, target, mention_count, pos, neg, topic_hits, topic, {r6('total')} AS total_weight, {r6('pw')} AS positive_weight, {r6('nw')} AS negative_weight, {r6('pw - nw')} AS net_weight, {r6('score')} AS frame_score,
  CASE WHEN score >= 0.2 THEN 'positive' WHEN score <= -0.2 THEN 'negative' ELSE 'mixed' END AS frame_label FROM x LEFT JOIN d2 USING (doc_id, target)""")
def directed_mentions(spark, sf):
    return rounded(directed.directed_mentions(_targets(spark, sf), ["doc_id", "source", "target"], STEMS, POS, NEG))


# text audit
@query("chamber_text_stats", X.with_m(f"""s AS (SELECT speech_id, {bal('sum(pos)', 'sum(neg)')} AS score FROM m GROUP BY 1), l AS (SELECT CASE WHEN score >= 0.2 THEN 'positive' WHEN score <= -0.2 THEN 'negative' ELSE 'mixed' END AS label, least(floor((score + 1) / 2 * 35), 34)::INTEGER AS bin FROM s)
  SELECT 'label' AS kind, v.label AS name, count(l.label) AS n FROM (VALUES ('positive'), ('mixed'), ('negative')) v(label) LEFT JOIN l ON l.label = v.label GROUP BY ALL UNION ALL SELECT 'bin', bin::VARCHAR, count(*) FROM l GROUP BY ALL"""))
def chamber_text_stats(spark, sf):
    return audit.label_stats(X.mentions(spark, sf).groupBy("speech_id").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


_AUDIT_TOKENS = "regexp_extract_all(translate(replace(lower(text), 'i̇', 'i'), 'âîû', 'aiu'), '[a-zçğıöşüâîû]{2,}')"
_STOP = "('the', 'of', 'der', 'que')"
_AUDIT = f"""t AS (SELECT doc_id, lang, source, unnest({_AUDIT_TOKENS}) AS word FROM documents), w AS (SELECT word, count(*) AS term_freq, count(DISTINCT doc_id) AS doc_freq, count(DISTINCT source) AS term_span, count(DISTINCT lang) AS party_span FROM t GROUP BY 1),
  k AS (SELECT *, doc_freq / (SELECT count(*) FROM documents)::DOUBLE AS doc_ratio FROM w ORDER BY term_freq DESC, word LIMIT 400),
  c AS (SELECT *, CASE WHEN regexp_full_match(word, '{audit.SUFFIX}') THEN 'suffix_fragment' WHEN word IN {_STOP} THEN 'existing_stopword' WHEN word IN {tuple(audit.PROCEDURE)} THEN 'parliamentary_procedure' WHEN word IN {tuple(audit.ARTIFACT)} THEN 'transcript_artifact'
    WHEN doc_ratio >= 0.09 AND term_span = 20 THEN 'generic_high_coverage' WHEN party_span >= 2 AND doc_ratio >= 0.04 THEN 'cross_party_generic' WHEN term_freq >= 400 AND term_span = 20 THEN 'high_frequency_generic' ELSE 'content_or_borderline' END AS category FROM k),
  a AS (SELECT *, CASE WHEN category IN ('suffix_fragment', 'parliamentary_procedure', 'transcript_artifact') THEN 'add_stopword' WHEN category = 'existing_stopword' THEN 'already_present' WHEN category = 'content_or_borderline' THEN 'keep_for_now' ELSE 'review_first' END AS recommendation FROM c)"""


def _candidates(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("term"), F.col("lang").alias("party"))
    return audit.candidates(d, 400, ["the", "of", "der", "que"], terms=20, parties=2, often=400)


@query("stopword_category", f"WITH {_AUDIT} SELECT word, term_freq, doc_freq, term_span, party_span, {r6('doc_ratio')} AS doc_ratio, category, recommendation FROM a")
def stopword_category(spark, sf):
    return rounded(_candidates(spark, sf))


@query("stopword_union", f"WITH {_AUDIT} SELECT word FROM a WHERE recommendation IN ('add_stopword', 'review_first') UNION SELECT unnest({[*audit.EXTRA, 'the', 'of']!r})")
def stopword_union(spark, sf):
    return audit.stopwords(_candidates(spark, sf), ["the", "of"])


@query("audit_summary", f"WITH {_AUDIT}, s AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id) AS r FROM documents) SELECT source AS term, (SELECT count(*) FROM documents) AS full_rows, count(*) AS sampled, (SELECT count(*) FROM a) AS candidates, (SELECT count(*) FROM a WHERE recommendation IN ('add_stopword', 'review_first')) AS selected FROM s WHERE r <= 50 GROUP BY source")
def audit_summary(spark, sf):
    from parlance.operators.sampling import per_group

    d = X.table(spark, sf, "documents")
    return audit.summary(d, per_group(d, ["source"], "doc_id", 50, 42), _candidates(spark, sf), "source").withColumnRenamed("source", "term")
