import hashlib

from pyspark.sql import functions as F

from kindred.llm import fingerprint as fp
from kindred.llm.common import two_columns


def prints(df, pattern=fp.PARAGRAPHS):
    out = fp.with_fingerprint(two_columns(df), "text", "own", pattern)
    return {r.doc_id: r.p for r in out.select("doc_id", fp.as_text("own").alias("p")).collect()}


def test_order_does_not_matter_and_count_does(make):
    got = prints(make([(1, "a\nb\nc"), (2, "c\na\nb"), (3, "a\nb\nc\nc"), (4, "a\nb"), (5, ""), (6, None)]))
    assert got[1] == got[2]
    assert len({got[1], got[3], got[4], got[5]}) == 4
    assert got[5] == got[6] == "0" * len(got[5])


def test_insertion_and_deletion_without_the_rest(make):
    docs = two_columns(make([(1, "a\nb\nc"), (2, "d\nd"), (3, "a\nd\nb\nd\nc")]))
    p = fp.with_fingerprint(docs, "text", "p")
    one, two, three = (
        p.filter(F.col("doc_id") == i).select(F.col("p_wide").alias(f"{n}_wide"), F.col("p_strata").alias(f"{n}_strata"))
        for i, n in ((1, "a"), (2, "b"), (3, "c"))
    )
    row = fp.combine(one.join(two).join(three), "a", "b", "sum")
    row = fp.combine(row, "c", "b", "rest", delete=True)
    got = row.select(*[fp.as_text(n).alias(n) for n in ("a", "c", "sum", "rest")]).first()
    assert got.sum == got.c and got.rest == got.a


def test_likeness_follows_the_share_of_common_units(make, spark):
    pairs = []
    for i, (n, common) in enumerate([(5, 5), (5, 0), (200, 200), (200, 100), (200, 0), (3000, 2000), (3000, 300)]):
        a = [f"u{i}-{j}" for j in range(n)]
        b = a[:common] + [f"v{i}-{j}" for j in range(n - common)]
        pairs.append((i, "\n".join(a), "\n".join(b), common / (2 * n - common)))
    df = spark.createDataFrame(pairs, "i int, a string, b string, want double")
    df = fp.with_fingerprint(fp.with_fingerprint(df, "a", "x"), "b", "y")
    for r in fp.with_likeness(df, "x", "y", "near").collect():
        assert abs(r.near - r.want) < 0.3 and (r.want != 1 or r.near == 1), (r.i, r.near, r.want)


def test_report_against_brute_force(make, prose):
    texts = [prose(i, n) for i, n in enumerate([1, 3, 40, 300, 3000])] + ["", None, "é😀x", "same", "same"]
    ids = [5, -3, 900, 17, 4, 44, 45, 46, 47, 48]
    got = {r.doc_id: r for r in fp.fingerprint_report(two_columns(make(list(zip(ids, texts))))).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].fingerprint == got[i].edited_fingerprint) <= (got[i].near_edited == 1)
    assert got[47].fingerprint == got[48].fingerprint and got[48].near_next == 1


def test_ties_nulls_and_the_empty_table(make):
    assert fp.fingerprint_report(two_columns(make([]))).collect() == []
    rows = fp.fingerprint_report(two_columns(make([(1, "a"), (1, "a"), (None, "b"), (2, "c d")]))).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "2", "None"]
    alone = fp.fingerprint_report(two_columns(make([(1, "abcd")]))).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
