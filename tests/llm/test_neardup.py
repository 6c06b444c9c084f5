import random
import re

import oddrows
import pytest

from basalt.llm import graph, neardup


def brute(rows, width, percent):
    """component of each row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(rows)]


def variants(seed, families, size, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 160))]
        for _ in range(size):
            w = list(words)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "edits"), [(2, 16), (5, 8)])
def test_as_brute_force(spark, width, edits):
    rows = variants(width, 4, 60, edits)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(oddrows.docs(spark, rows), width).collect())
    want = sorted(brute(rows, width, 80))
    assert got == want
    assert 4 < len({c for *_, c in want}) < len(rows)


def test_anchored_links_lose_nothing(spark):
    """Differences from an anchor decide as full sets do."""
    rng = random.Random(1)
    base = list(range(100))

    def edited(of, n):
        gone = set(rng.sample(sorted(of), n))
        return (of - gone) | {rng.randint(1000, 1400) for _ in range(n)}

    parents = [edited(set(base), rng.randint(4, 16)) for _ in range(12)]
    sets = {f"{i:02d}": edited(parents[i % 12], rng.randint(0, 6)) for i in range(70)}
    alike = lambda s, t: 100 * len(s & t) >= 80 * len(s | t)
    anchor = set(base)
    rows = [(b"anchor", k.encode(), len(s), k.encode() if not alike(s, anchor) else b"main", alike(s, anchor), sorted(s ^ anchor)) for k, s in sets.items()]
    df = spark.createDataFrame(rows, "anchor binary, class binary, n long, component binary, linked boolean, difference array<bigint>")
    got = {frozenset((bytes(r.a).decode(), bytes(r.b).decode())) for r in neardup._anchored_links(df, 80).collect()}
    name = {k: c for _, kb, _, c, *_ in rows for k in [kb.decode()]}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and name[a] != name[b] and alike(sets[a], sets[b])}
    assert got == want and want


def test_odd_rows(spark):
    docs = oddrows.docs(spark)
    got = neardup.groups(docs, 2).collect()
    assert len(got) == len(oddrows.ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 1 and not by[5].kept and by[7].component_id == 7
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (2, 3, 4))
    kept = neardup.keep_one(docs, 2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9)] + [(True, 0)] * 2
    assert neardup.groups(oddrows.docs(spark, []), 2).count() == 0
    assert neardup.keep_one(oddrows.docs(spark, []), 2).count() == 0


def test_components(spark):
    chain = [(f"n{i:03d}".encode(), f"n{i + 1:03d}".encode()) for i in range(40)] + [(b"x", b"y"), (b"y", b"x"), (b"z", b"z")]
    got = {bytes(r.node): bytes(r.component) for r in graph.components(spark.createDataFrame(chain, "a binary, b binary")).collect()}
    assert all(got[f"n{i:03d}".encode()] == b"n000" for i in range(41)) and got[b"y"] == b"x" and b"z" not in got
    assert graph.components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_likeness_below_the_odds_is_refused(spark):
    with pytest.raises(ValueError, match="80"):
        neardup.link(oddrows.docs(spark), 2, 79)


def passage_rows(n, seed=4):
    """n documents with a passage in common and nothing else, some of them with a near copy."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(46)]
    rows = []
    for i in range(n):
        w = passage + [f"u{i}_{k}" for k in range(54)]
        rows.append((len(rows), " ".join(w)))
        if i % 97 == 0:
            w[rng.randrange(50, 100)] = "changed"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    """Rows that joins give stay in proportion to the documents; every near copy is found."""
    made = []
    write = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df: made.append(write(df)) or made[-1])
    sizes = []
    monkeypatch.setattr(neardup, "drop", lambda *t: sizes.extend(x.count() for x in t if x in made))
    rows = passage_rows(20_000)
    got = {r.doc_id: r.component_id for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 2).collect()}
    twins = {i: i - 1 for (i, t) in rows if " changed" in t}
    assert twins and got == {i: twins.get(i, i) for i, _ in rows}
    assert max(sizes) < 64 * len(rows)


def test_lists_beyond_the_pairing_limit_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRED", 2)
    rows = variants(3, 4, 50, 12) + [(1000 + i, t) for i, t in passage_rows(150)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.groups(oddrows.docs(spark, rows), 2).collect())
    assert got == sorted(brute(rows, 2, 80))
