"""Transcripts to speech turns, and speakers to roster names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import speakers as S
from parlance.functions.text import fuzzy_name, normalize_name_key

from .lineage import cut


def numbered_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def merge_split_lines(lines: DataFrame, key: str, name: Column | None = None) -> DataFrame:
    """A name line followed by a line that starts with - or : becomes ``name - speech``; the second is consumed.

    Lines are stripped. In a run of lines that are both, a line is consumed only if the one before wasn't.
    """
    rows = lines.withColumn("line", S.strip(F.col("line")))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumns({"_name": S.looks_like_speaker(F.col("line")) if name is None else name, "_rest": F.col("line").rlike(S.CONTINUES)})
    link = rows.withColumn("_link", F.coalesce(F.lag("_name").over(w) & F.col("_rest"), F.lit(False)))
    # position inside the run of linked lines: odd ones are consumed
    link = link.withColumn("_run", F.sum((~F.col("_link")).cast("int")).over(w))
    link = link.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_run").orderBy("pos")) - 1)
    link = link.withColumn("_taken", F.col("_k") % 2 == 1)
    link = link.withColumn("_next", F.when(F.lead("_taken").over(w), S.strip(F.regexp_extract(F.lead("line").over(w), S.CONTINUES, 1))))
    out = link.where("not _taken").withColumn("line", F.when(F.col("_next").isNull(), F.col("line")).otherwise(S.strip(F.concat("line", F.lit(" - "), "_next"))))
    return out.select(*lines.columns)


def segment_turns(lines: DataFrame, key: str, is_speaker: Column, least: int = 15) -> DataFrame:
    """A speaker line opens a turn and later lines append; what is before the first speaker, and turns of up to ``least`` characters, go."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("_s", is_speaker).withColumn("turn", F.sum(F.col("_s").cast("int")).over(w)).where("turn > 0")
    parts = F.array_sort(F.collect_list(F.when(~F.col("_s"), F.struct("pos", "line"))))
    turns = rows.groupBy(key, "turn").agg(F.max(F.when(F.col("_s"), F.col("line"))).alias("speaker"), F.array_join(F.transform(parts, lambda x: x.line), " ").alias("speech"))
    return turns.where(F.length("speech") > least)


def line_classes(lines: DataFrame, key: str, classes: dict[str, Column]) -> DataFrame:
    """Lines of each class per transcript; the first class that holds counts, the rest is ``other``."""
    name = F.lit("other")
    for c, holds in reversed(classes.items()):
        name = F.when(holds, c).otherwise(name)
    rows = lines.withColumn("_c", name)
    return rows.groupBy(key).agg(*[F.count_if(F.col("_c") == c).alias(c) for c in (*classes, "other")])


# fixed values: month names and session starts of the transcripts
MONTHS = ["Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık"]
SESSION_STARTS = ["Açılma Saati", "BİRİNCİ OTURUM"]
#: A day, a month's name or a dot, perhaps a dot or letters, and a year.
DATE = rf"[0-9]{{1,2}}\s*(?:{'|'.join(MONTHS)}|\.)\s*(?:\.|[A-Za-z]*)\s*[0-9]{{4}}"
#: A line that begins with a session start, in any case.
SESSION_START = rf"(?iu)(?:^|\n)\s*(?:{'|'.join(SESSION_STARTS)})"


def trim_to(text: Column, marker: str = SESSION_START) -> Column:
    """The text from the first marker on (by default a line that begins a session); all of it without one."""
    at = F.regexp_instr(text, F.lit(marker))
    return F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)


def first_date(text: Column, pattern: str = DATE, none: str = "Bilinmiyor") -> Column:
    """The first date in the text without its spaces."""
    found = F.replace(F.regexp_extract(text, pattern, 0), F.lit(" "), F.lit(""))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(none))


def forward_fill(rows: DataFrame, order: str, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Blank cells take the last value above.

    Rows are dealt out by range, so no task gets a whole table or group. Each part is filled alone;
    the cells that are then still blank take the last value of the parts before it.
    """
    keys = keys or []
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys, order).withColumns({"_part": F.spark_partition_id(), "_tie": F.monotonically_increasing_id()})
    dealt = cut(dealt)
    w = Window.partitionBy("_part", *keys).orderBy(order, "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumns({c: F.last(F.nullif(F.trim(c), F.lit("")), True).over(w) for c in columns})
    # one row per part and group that it holds: at most the parts plus the groups
    value = {c: F.nullif(F.trim(c), F.lit("")) for c in columns}
    last = dealt.groupBy("_part", *keys).agg(*[F.max_by(value[c], F.when(value[c].isNotNull(), F.struct(order, "_tie"))).alias(c) for c in columns])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(F.col("_part").alias("_in"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.last(c, True).over(before).alias(f"_v{i}") for i, c in enumerate(columns)])
    same = filled["_part"] == last["_in"]
    for i, k in enumerate(keys):
        same = same & filled[k].eqNullSafe(last[f"_k{i}"])
    out = filled.join(last, same, "left")
    return out.select(*[F.coalesce(c, f"_v{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in rows.columns])


def roster_party(raw: Column, changed: Column | None = None, longest: int = 80) -> Column:
    """The party of a roster row: the one changed to, else the one that the label names, else the label itself.

    Labels that can't be a party (digits, several names, over ``longest`` letters) are unknown. null: blank.
    """
    text = S.strip(F.coalesce(raw, F.lit("")))
    odd = F.contains(text, F.lit(" · ")) | text.rlike(r"^\d+$") | (F.length(text) > longest)
    own = F.coalesce(S.party_label(text), F.when(odd, "Bilinmeyen").otherwise(text))
    return own if changed is None else F.coalesce(S.party_label(F.coalesce(changed, F.lit(""))), own)


def roster_index(roster: DataFrame, term: str, name: str, order: str, party: str | None = None, changed: str | None = None) -> DataFrame:
    """One row per (term, name key): the last one, with ``place``, the order of the first row of that key.

    ``party`` and ``changed`` name columns that ``roster_party`` makes one party of. Rows of equal order: the
    largest in all columns stays. Columns name_key and place are made anew. Partially aggregated, so a key
    with very many rows is no group in one task.
    """
    rows = roster.drop("name_key", "place").withColumn("name_key", normalize_name_key(F.col(name)))
    if party is not None:
        rows = rows.withColumn(party, roster_party(F.col(party), None if changed is None else F.col(changed)))
    others = [c for c in rows.columns if c not in (term, "name_key", order)]
    last = F.max(F.struct(order, *others)).alias("_last")
    out = rows.groupBy(term, "name_key").agg(last, F.min(order).alias("place"))
    return out.select(*[F.col(c) if c in (term, "name_key") else F.col("_last")[c].alias(c) for c in rows.columns], "place")


def name_index(index: DataFrame, order: str = "row") -> DataFrame:
    """One row per name key of a roster index, whatever its term: the last one."""
    last = F.max(F.struct(order, *[c for c in index.columns if c not in ("name_key", order)])).alias("_last")
    return index.groupBy("name_key").agg(last).select(*[F.col(c) if c == "name_key" else F.col("_last")[c].alias(c) for c in index.columns])


# Names that are settled by hand (party, name), and the role of the presiding officer.
OVERRIDES = {
    "izzet celik": ("Adalet ve Kalkınma Partisi", "İZZET ÇETİN"),
    "reyhan balandi": ("Adalet ve Kalkınma Partisi", "REYHAN BALANDI"),
    "cicek": ("Adalet ve Kalkınma Partisi", "CEMİL ÇİÇEK"),
    "sidika aydogan": ("Cumhuriyet Halk Partisi", "SIDIKA AYDOĞAN"),
    "feridun fikrat baloglu": ("Cumhuriyet Halk Partisi", "FERİDUN FİKRET BALOĞLU"),
    "fevzi berdibek": ("Adalet ve Kalkınma Partisi", "FEVZİ BERDİBEK"),
    "idris naim sahih": ("Adalet ve Kalkınma Partisi", "İDRİS NAİM ŞAHİN"),
    "baskan": ("MECLİS BAŞKANLIĞI", "BAŞKAN"),
    "basan": ("MECLİS BAŞKANLIĞI", "BAŞKAN"),
}
PRESIDING = ("MECLİS BAŞKANLIĞI", "BAŞKAN")
ROLES = ["MECLİS BAŞKANLIĞI", "KOMİSYON SÖZCÜSÜ", "Bilinmeyen", "BAKANLAR KURULU"]
#: Letters by which a contained roster name is looked up; shorter names are never contained ones.
_GRAM = 6


def resolve_speakers(names: DataFrame, roster: DataFrame, name: str = "speaker", term: str = "term") -> DataFrame:
    """(speaker, term, party, clean_name, stage) of each distinct (speaker, term).

    The first stage that holds: override, presiding officer, exact in the term, a roster name of the term
    that is contained or fuzzy (the first in the roster, by the first row of its key, with the value of its
    last), exact in any term, party from the prefix, unknown. ``roster`` is a roster index (term, name_key, row, place, party, clean_name). The contained stage joins on
    six letters, the fuzzy one on shared words, so neither is a product of names and roster; Spark
    chooses the join by the roster's size. null speaker: the empty name.
    """
    q = names.select(name, term).distinct().withColumn("name_key", normalize_name_key(F.col(name)))
    fixed = F.create_map(*[F.lit(x) for k, v in OVERRIDES.items() for x in (k, v[0])]), F.create_map(*[F.lit(x) for k, v in OVERRIDES.items() for x in (k, v[1])])
    chair = F.contains("name_key", F.lit("baskan")) & ~F.contains("name_key", F.lit("basbakan"))
    known = lambda k: F.coalesce(fixed[k][F.col("name_key")], F.when(chair, PRESIDING[k]))
    q = q.withColumns({"p0": known(0), "n0": known(1)})
    q = q.join(roster.select(term, "name_key", F.col("party").alias("p1"), F.col("clean_name").alias("n1")), [term, "name_key"], "left")
    other = roster.select(term, F.col("name_key").alias("_k"), F.col("party").alias("_p"), F.col("clean_name").alias("_c"), F.col("place").alias("_row"))
    open_ = q.where("p0 is null and p1 is null").select(name, term, "name_key")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name_key") - _GRAM + 1, F.lit(1))), lambda i: F.substring("name_key", i, F.lit(_GRAM))))
    held = open_.withColumn("_g", F.explode(grams)).join(other.where(F.length("_k") >= _GRAM).withColumn("_g", F.left("_k", F.lit(_GRAM))), [term, "_g"]).where(F.contains("name_key", F.col("_k")))
    words = lambda df, c: df.withColumn("_w", F.explode(F.array_distinct(F.split(c, " "))))
    fuzzy = words(open_, F.col("name_key")).join(words(other, F.col("_k")), [term, "_w"]).where(fuzzy_name(F.col("name_key"), F.col("_k")))
    pick = [name, term, "_p", "_c", "_row"]
    near = held.select(pick).unionByName(fuzzy.select(pick)).groupBy(name, term).agg(F.min_by(F.struct("_p", "_c"), "_row").alias("_n"))
    near = near.select(name, term, F.col("_n._p").alias("p2"), F.col("_n._c").alias("n2"))
    anywhere = name_index(roster).select("name_key", F.col("party").alias("p3"), F.col("clean_name").alias("n3"))
    out = q.join(near, [name, term], "left").join(anywhere, "name_key", "left")
    prefix = S.party_from_prefix(F.col(name))
    stage = F.when(F.col("p0").isNotNull(), "fixed").when(F.col("p1").isNotNull(), "exact").when(F.col("p2").isNotNull(), "near").when(F.col("p3").isNotNull(), "anywhere").when(prefix.isNotNull(), "prefix").otherwise("unknown")
    upper = S.strip(F.upper(F.coalesce(F.col(name), F.lit(""))))
    return out.select(name, term, F.coalesce("p0", "p1", "p2", "p3", prefix, F.lit("Bilinmeyen")).alias("party"), F.coalesce("n0", "n1", "n2", "n3", upper).alias("clean_name"), stage.alias("stage"))


def reresolve(rows: DataFrame, roster: DataFrame, name: str = "speaker", term: str = "term", party: str = "party") -> DataFrame:
    """``rows`` with new_party and new_speaker from the cascade above.

    Blank names and words that no name has keep what they have (unknown if blank); a role label stays
    where the cascade finds nothing.
    """
    found = resolve_speakers(rows, roster, name, term).select(F.col(name).alias("_s"), F.col(term).alias("_t"), F.col("party").alias("_p"), "clean_name")
    out = rows.join(found, rows[name].eqNullSafe(F.col("_s")) & rows[term].eqNullSafe(F.col("_t")), "left")
    speaker, now = S.strip(F.coalesce(F.col(name), F.lit(""))), S.strip(F.coalesce(F.col(party), F.lit("")))
    skip = (speaker == "") | F.upper(speaker).isin(S.NOT_NAMES)
    new = F.when(skip, F.when(now == "", "Bilinmeyen").otherwise(now)).when(now.isin(ROLES) & (F.col("_p") == "Bilinmeyen"), now).otherwise(F.col("_p"))
    clean = F.when(skip, speaker).otherwise(F.coalesce(F.nullif("clean_name", F.lit("")), speaker))
    return out.select(*[rows[c] for c in rows.columns], new.alias("new_party"), clean.alias("new_speaker"))
