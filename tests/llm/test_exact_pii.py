import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from parlance.llm import exact_dedup, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(x) for x in reversed(d)]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def brute(text):
    out = []
    for o, (kind, pat) in enumerate(BASE.items()):
        for m in re.finditer(pat, text or ""):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [
    None, "", "a@b.c", "é😀 mail x.y+z@ex-1.example.com, and a@b and @c.d", "a@b.c_d@e.f a@b.c@d.e", "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.02.3.000255 1.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 378282246310005", "+1 (499) 555-6503 and +12 and ++49 30 1234567. +4111 1111 1111 1111 1111",
    "9" * 30000, "a" * 30000, "a@b.c " * 1500, "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433", "my ssn 123-45-6789", "nothing 123-45-6789",
    "١٢٣@b.c 4\n111", "1 " * 5000,
]


def test_pii_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in pii.digests(pii.find_spans(docs)).collect():
        want = brute(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), TEXTS[r.doc_id][:80]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in BASE] == want
        for k in BASE:
            assert r[f"n_{k}"] == sum(x.startswith(k + ":") for x in want)
        if TEXTS[r.doc_id] and "GB82" in TEXTS[r.doc_id]:
            assert r.spans.count("iban") == 1
    spans = {r.doc_id: r.spans for r in pii.digests(pii.find_spans(docs)).collect()}
    assert "ssn:7:18" in spans[12] and "ssn" not in spans[13]


def test_pii_redacts_and_takes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.c, +1 (499) 555-6503!", "x", None), (None, None, "y", 2), (1, "to a@b.c, +1 (499) 555-6503!", "x", None)], "doc_id long, text string, _m_email string, pii_spans int")
    got = [tuple(r) for r in pii.redact(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "to [EMAIL], [PHONE]!", "x", None)] * 2 + [(None, None, "y", 2)], key=str)
    assert pii.digests(pii.find_spans(docs.limit(0))).count() == 0


def check_groups(rows, got):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    assert sum(r.kept for r in got) == len(groups)
    for r in got:
        g = next(g for t, g in groups.items() if r.text_digest == t)
        assert r.group_size == len(g) and r.keep_id == max((x for x in g if x is not None), default=None)


def test_exact_duplicates(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "a"), (None, "b"), (7, "A" * 100000), (8, "A" * 100000), (9, "a ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    for digest in (exact_dedup.sha256, lambda t: F.unhex(F.lit("00")), lambda t: F.substring(t, 1, 1).cast("binary")):  # collisions too
        got = exact_dedup.exact_duplicates(docs, digest=digest)
        if digest is exact_dedup.sha256:
            by = {hashlib.sha256((t or "").encode()).digest(): t or "" for _, t in rows}
            check_groups(rows, [type("R", (), r.asDict() | {"text_digest": by[bytes(r.digest)]}) for r in got.collect()])
        else:
            counts = sorted((r.keep_id or 0, r.group_size) for r in got.where("kept").collect())
            assert counts == [(0, 1), (3, 2), (4, 4), (8, 2), (9, 1)]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 3, 4, 8, 9]


def test_pii_takes_addresses_with_zero_parts(spark):
    texts = ["10.0.0.1", "0.0.0.0", "127.0.0.1 192.168.0.1", "00.000.0.0255", "0.0.0.256 0.0.0.0256", "1.2.3." + "0" * 4000, "8.8.8.8"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(pii.find_spans(docs)).collect()}
    assert [got[i].n_ip for i in range(len(texts))] == [sum(x.startswith("ip:") for x in brute(t)) for t in texts] == [1, 1, 2, 1, 0, 1, 1]
    assert pii.redact(docs.where("doc_id = 0")).first().text == "[IP]"


def test_filter_holds_all_and_a_later_batch_merges(spark):
    docs = spark.createDataFrame([(i, f"text {i % 400}") for i in range(1000)], "doc_id long, text string")
    runs = exact_dedup.flush(docs)
    level = exact_dedup.compact(runs)
    some = level.where("keep_id % 3 = 0").select("digest")
    maps, bits = exact_dedup.filter_of(some)
    left = exact_dedup.probed(level, "digest", maps, bits)
    assert some.join(left, "digest", "left_anti").count() == 0 and left.count() <= 1.3 * some.count()
    later = spark.createDataFrame([(5000 + i, f"text {i}") for i in range(350, 450)], "doc_id long, text string")
    merged = exact_dedup.merge(level, exact_dedup.flush(later))
    both = exact_dedup.compact(exact_dedup.flush(docs.unionByName(later)))
    want = sorted((bytes(r.digest), r.keep_id, r.n) for r in both.collect())
    assert sorted((bytes(r.digest), r.keep_id, r.n) for r in merged.collect()) == want and len(want) == 450
    first = exact_dedup.merge(exact_dedup.compact(runs, "smallest"), exact_dedup.flush(later), "smallest")
    assert {r.keep_id for r in first.collect()} == {*range(400), *range(5400, 5450)}
