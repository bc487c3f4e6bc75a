import hashlib
import random

from threadtide.llm import lempelziv as lz

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute_phrases(text):
    seen, out, start = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            out.append(text[start:end])
            start = end
    return out


def test_phrases_match_the_character_loop():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc" if rng.random() < 0.5 else "aé漢") for _ in range(rng.randrange(0, 80)))
        assert lz.phrases(text, 0, set()) == brute_phrases(text)
        parsed = lz.Parsed(text, lz._Powers())
        cut, tail = rng.randrange(len(text) + 1), "abab" * 3
        whole, slots = parsed.edited(cut, tail)
        assert whole == text[:cut] + tail
        assert list(slots) == list(lz.Parsed(whole, lz._Powers()).slots)


def test_likeness_estimates_the_share_of_phrases(spark):
    texts = [r.text for r in spark.read.parquet(DOCS).select("text").limit(40).collect()]
    for a, b in zip(texts, texts[1:] + [t[: len(t) // 2] for t in texts[:5]]):
        x, y = set(brute_phrases(a)), set(brute_phrases(b))
        p, q = lz.Parsed(a, lz._Powers()), lz.Parsed(b, lz._Powers())
        assert abs(lz.likeness(p.slots, q.slots) - len(x & y) / len(x | y)) < 0.2
        assert list(lz.slots_of(lz.fingerprint(p.slots))) == list(p.slots)


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(t) // 3
        whole = t[: len(t) - third] + after[:third]
        p, q, r = (lz.Parsed(x, lz._Powers()).slots for x in (t, whole, after))
        out.append((i, len(t), hashlib.sha256(whole.encode()).hexdigest(), lz.fingerprint(p), lz.fingerprint(q), lz.likeness(p, q), lz.likeness(p, r)))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, bucket string")
    got = [tuple(r) for r in lz.fingerprints(frame).collect()]
    order = lambda r: (r[0] is None, -(r[0] or 0), r[2], r[3])
    assert sorted(got, key=order) == sorted(expected(rows), key=order)


def test_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).select("doc_id", "text").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, "a")])
    check(spark, [(5, None), (5, ""), (-3, "abcabcabc" * 5000), (9, "é漢 x"), (None, "nothing"), (None, None), (10**15, "same"), (10**15 + 1, "same")])
    assert lz.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
