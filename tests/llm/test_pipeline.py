import itertools
from pathlib import Path

import oddrows
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basalt.llm import pieces, quality, words
from basalt.llm.common import materialize
from basalt.llm.queries import op3_quality
from conftest import SF


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
        n = docs.count()
        assert 0 < n <= before, name
        before = n
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    assert docs.filter("n_pieces < size(ids)").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == before


def own_lines(rows):
    """Rule 7 over (doc_id, text, source)."""
    trim = lambda line: line.strip("".join(map(chr, range(33))))
    sites = {}
    for _, text, source in rows:
        for line in text.split("\n"):
            sites.setdefault(trim(line), set()).add(source or "")
    shared = {line for line, s in sites.items() if line and len(s) >= 10}
    out = {}
    for i, text, _ in rows:
        kept = [line for line in text.split("\n") if trim(line) not in shared]
        out[i] = "\n".join(kept) if any(map(trim, kept)) else text
    return out


def shingle_set(text, width, delete=b""):
    w = words.split(text, delete)
    return {tuple(w[i : i + min(width, len(w))]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def one_of_each(texts):
    """Rule 10: the least id of each component of documents of Jaccard similarity 0.8."""
    sets = {i: s for i, t in texts.items() if (s := shingle_set(t, 5))}
    lead = {i: i for i in texts}

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            lead[b] = a
    return {i for i in texts if top(i) == i}


def without_items(texts, items):
    """Rule 2: documents that hold less than 80 % of every item's shingles."""
    items = [(s, min(5, len(words.split(t, words.PUNCTUATION)))) for t in items if (s := shingle_set(t, 5, words.PUNCTUATION))]
    out = set()
    for i, t in texts.items():
        held = {w: shingle_set(t, w, words.PUNCTUATION) for w in range(1, 6)}
        if not any(100 * len(s & held[w]) >= 80 * len(s) for s, w in items):
            out.add(i)
    return out


def best_cut(p, text):
    """The best segmentation's score, over all places where a piece may end."""
    text = (" " + text).replace(" ", pieces.SPACE)
    longest = max(map(len, p.ids))
    best = [0.0] + [-1e300] * len(text)
    for at in range(len(text)):
        for end in range(at + 1, min(len(text), at + longest) + 1):
            i = p.ids.get(text[at:end])
            if i is not None:
                best[end] = max(best[end], best[at] + p.score[i])
            elif end == at + 1:
                best[end] = max(best[end], best[at] + p.unknown)
    return best[-1]


def test_stages_as_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    may_learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), may_learn)
    rows = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    assert len({i for i, *_ in rows}) == len(rows)
    good = [r for r, q in zip(rows, model.quality([t for _, t, _ in rows]), strict=True) if q >= 0.3]
    scored = {r.doc_id: r.predicted for r in op3_quality(spark, SF).collect()}
    assert {i for i, p in scored.items() if p} == {i for i, *_ in good}
    lines = own_lines(good)
    single = {i: lines[i] for i in one_of_each(lines)}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: single[i] for i in without_items(single, items)}
    assert len(rows) > len(good) and lines != {i: t for i, t, _ in good} and len(lines) > len(single) > len(clean) > 0
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], ({i: t for i, t, _ in good}, lines, single, clean), strict=True):
        docs = materialize(stage(spark, docs, SF))
        assert {r.doc_id: r.text or "" for r in docs.collect()} == want, name
    p = pieces.Pieces.from_model(Path(corpus_pipeline.PIECES).read_bytes())
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert set(got) == set(clean)
    for i in sorted(clean, key=lambda i: len(clean[i]))[:20]:
        assert got[i].score == pytest.approx(best_cut(p, clean[i]), rel=1e-9)
        assert p.decode(got[i].ids) == clean[i]


def test_stages_on_odd_rows(spark):
    for rows in (None, []):
        for _, stage in corpus_pipeline.STAGES:
            docs = oddrows.docs(spark, rows)
            out = stage(spark, docs, SF)
            assert out.count() <= docs.count()
