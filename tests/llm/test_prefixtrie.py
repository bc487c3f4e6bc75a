import hashlib
import random
import zlib
from collections import defaultdict

from threadtide.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own, members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    for c, turns in own.items():
        h, first = zlib.crc32(str(c).encode()) % 6, c - abs(c) % 100 * (1 if c >= 0 else -1)
        whole = tuple(own.get(first, [])[:h] + turns[h:])
        ends[whole].append(c)
        for k in range(len(whole) + 1):
            members[whole[:k]].append(c)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    saved, leaves = {}, {}
    for s in sorted(members, key=len, reverse=True):
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1]) if s else 0) + sum(saved[k] for k in kids[s])
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], digest(ends[s])) for s, m in members.items()
    )


def same(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, chars string, part int")
    got = prefixtrie.trie(frame)
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_turns(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(40), 100, 105, 1999, 250, 251, -5, -120, -100, 10**15]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([turn, turn, None, 2]), rng.choice(["user", "user", None, ""]), rng.choice(["a", "b", "", None, "é" * 60, "é" * 60 + "z", "longer text"])))
    rows += rows[:30] + [(None, 1, "user", "a"), (None, None, None, None)]
    assert same(spark, rows)


def test_copies_long_conversations_and_popular_turns(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "HOT_PARENTS", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(300, 380) for t in range(7)]  # one group of copies
    rows += [(400, t, "assistant", f"turn {t % 50}") for t in range(3000)]  # one conversation over several ranges
    rows += [(c, t, "user", "hello" if t == 0 else f"{c}-{t}") for c in range(1000, 5000, 100) for t in range(8)]
    assert same(spark, rows)


def test_empty_table(spark):
    assert prefixtrie.trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
