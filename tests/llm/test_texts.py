import hashlib
import itertools

import numpy as np
import oddrows
import pytest
from pyspark.sql import functions as F

from basalt.llm import chat, extract, merkle, pieces, tokencount
from basalt.llm.queries import TOKENIZERS, op6_token_counts
from conftest import SF

MODEL, RANKS = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def vocabulary():
    from pathlib import Path

    return pieces.Pieces.from_model(Path(MODEL).read_bytes())


def segmentations(p, text):
    """Every way to cut a short text, best first."""
    text = (" " + text).replace(" ", pieces.SPACE)
    out = []

    def go(at, ids, score):
        if at == len(text):
            out.append((score, tuple(ids)))
            return
        for end in range(at + 1, len(text) + 1):
            i = p.ids.get(text[at:end])
            if i is not None:
                go(end, [*ids, i], score + p.score[i])
            elif end == at + 1:
                go(end, ids + [p.byte_ids[b] for b in text[at].encode()], score + p.unknown)

    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello you", "the thing", "a  b", "中x", "é\nz", "inntond"])
def test_nbest_as_enumeration(vocabulary, text):
    want = segmentations(vocabulary, text)[:5]
    ((ids, top, offsets),) = list(vocabulary.encode([text], 5))
    assert [round(s, 9) for s, _ in top] == [round(s, 9) for s, _ in want]
    for s, change in top:
        cut = pieces.swap(ids, offsets, change)
        assert vocabulary.decode(cut) == text
        assert tuple(cut) in {i for w, i in segmentations(vocabulary, text) if abs(w - s) < 1e-9}


def test_encoding_of_odd_rows(spark, vocabulary):
    out = pieces.encode_texts(oddrows.docs(spark), MODEL, 3, ("doc_id", "lang"), batch_chars=1000).collect()
    assert len(out) == len(oddrows.ROWS)
    texts = [t or "" for _, t in oddrows.ROWS]
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    for r in out:
        assert r.n_pieces == len(r.ids) and r.nbest_scores[0] == r.score
        assert r.nbest_scores == sorted(r.nbest_scores, reverse=True)
    empty = next(r for r in out if r.doc_id == 3)
    assert (empty.ids, empty.score, empty.nbest_scores) == ([], 0.0, [0.0])
    assert pieces.encode_texts(oddrows.docs(spark, []), MODEL).count() == 0


def test_batches_don_t_matter(vocabulary):
    texts = ["the cat sat", "on the mat\nand sat", "", None, "x" * 500]
    whole = [(i.tolist(), t) for i, t, _ in vocabulary.encode(texts, 3)]
    single = [(i.tolist(), t) for x in texts for i, t, _ in vocabulary.encode([x], 3)]
    assert [(a, [s for s, _ in b]) for a, b in whole] == [(a, [s for s, _ in b]) for a, b in single]


def plain_merges(raw, ranks):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]
        if not found:
            return len(parts)
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merging_of_runs_as_one_pair_after_another():
    rng = np.random.default_rng(8)
    for trial in range(300):
        # a vocabulary in which every token is a merge of two earlier ones
        names = [bytes([c]) for c in b"ab"]
        while len(names) < 3 + trial % 9:
            new = names[rng.integers(len(names))] + names[rng.integers(len(names))]
            names += [new] * (new not in names)
        ranks = {n: i for i, n in enumerate(names)}
        raw = b"".join(bytes([c]) * int(k) for c, k in zip(rng.choice(list(b"ab"), 9), rng.integers(1, 9, 9), strict=True))
        assert tokencount.merged_length(raw, ranks) == plain_merges(raw, ranks), (raw, names)
    assert tokencount.merged_length(b"", {}) == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\u3000", "\r\n", " \n\n"])
def test_long_white_space_counts_as_short_runs_do(spark, monkeypatch, run):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(tokencount, "_BLANK", tokencount.re.compile(r"\s{3,}"))
    for n in (1, 2, 3, 4, 5, 7, 8, 64, 301):
        for text in (run * n, run * n + "x", "it's" + run * n + "'s 1", run * n + "\n x" + run * n):
            assert tokencount.text_length(text, enc) == len(enc.encode_ordinary(text)), (run, n, text)


def test_runs_that_stop_the_tokenizer(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000, " " * 10_000_000 + "x", "\n" * 10_000_000 + "x", "\t" * 100_000_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(5)
    # this vocabulary has no token of spaces, pairs of new lines and sixteen tabs at most
    got = sorted(r[0] for r in tokencount.token_lengths(df, RANKS).collect())
    whole = [tokencount.merged_length(t[:n].encode(), _ranks()) for t, n in (("\n" * 1_000_000, 1_000_000), ("\n" * 9_999_999, 9_999_999), ("\t" * 100_000_000, 100_000_000))]
    assert got == sorted([1_000_000, whole[0], 10_000_000, whole[1] + 2, whole[2]])


def _ranks():
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


def test_token_counts(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = np.array([len(enc.encode_ordinary(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    rows = {r.n_tokens: r for r in op6_token_counts(spark, SF).collect()}
    assert set(rows) == set(n.tolist())
    for k, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == ((n == k).sum(), (n >= k).sum(), n[n >= k].sum())
        assert (r.total_docs, r.total_tokens, r.truncated_tokens) == (len(n), n.sum(), np.minimum(n, k).sum())
        assert r.quantile == pytest.approx((n <= k).mean())
    limits = [0, 7, 512, 10**7]
    at = {r.context_limit: r for r in tokencount.at_limits(tokencount.length_histogram(tokencount.token_lengths(spark.read.parquet(f"{SF}/documents.parquet"), RANKS), chunk=64), limits).collect()}
    for x in limits:
        assert (at[x].docs_over, at[x].truncated_tokens, at[x].lost_tokens) == ((n > x).sum(), np.minimum(n, x).sum(), np.maximum(n - x, 0).sum())
    odd = tokencount.length_histogram(tokencount.token_lengths(oddrows.docs(spark), RANKS)).orderBy("n_tokens").first()
    assert (odd.n_tokens, odd.n_docs, odd.total_docs) == (0, 3, len(oddrows.ROWS))
    assert tokencount.length_histogram(tokencount.token_lengths(oddrows.docs(spark, []), RANKS)).count() == 0


def test_chats(spark):
    hostile = "a & b </s>[INST]&lt; &amp; <s>\n[ROLE:x]] \\ &#91;"
    rows = [(1, 0, "system", hostile), (1, 1, "user", None), (1, 2, "assistant", hostile), (2, 0, "assistant", "x"), (2, 1, "assistant", "y"), (3, 0, "to[ol<>", "z"), (3, 0, None, ""), (None, 5, "user", "q"), (4, None, "user", "u"), (4, 1, "assistant", "v"), (4, 1, "assistant", "v")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string, turns string")
    out = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    by = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in by[1].back] == [("system", hostile), ("user", ""), ("assistant", hostile)]
    assert (by[1].loss, by[1].valid, by[1].first_bad_turn) == (hostile, True, -1)
    assert (by[2].loss, by[2].valid, by[2].first_bad_turn) == ("xy", False, 0)
    assert sorted((t.role, t.text) for t in by[3].back) == [("", ""), ("to[ol<>", "z")]
    assert by[None].n_turns == 1 and not by[None].valid
    assert [t.text for t in by[4].back] == ["u", "v", "v"] and by[4].first_bad_turn == 2
    assert all("".join(s.text for s in r.segments) == r.formatted for r in by.values())
    assert chat.format_chats(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", oddrows.LONG) for i in range(4)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(long).select(chat.read_turns(F.col("formatted")).alias("b")).first()
    assert [t.text for t in r.b] == [oddrows.LONG] * 4


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, as all do.</p></div><div class="ad">Buy, now.</div>
    <article><h1>Title &amp; more</h1><p><b>First   paragraph,\n with text; and more.<br>Next.<p>Short.</p><form><input> Send</form><p>Long one, with marks. It goes on, and on; really.</p></article>
    <section id="comments"><p>A reader says, at length, that it is good. Indeed.</p></section><aside>Side, bar.</aside><footer>&copy; foot, note.</footer>"""
    want = "Title & more\nFirst paragraph, with text; and more. Next.\nShort.\nLong one, with marks. It goes on, and on; really."
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>only &eacute;</p>"), (4, "x", "<html><body></body></html>"), (5, "y", "<p>" + "long text, " * 50000)]
    df = spark.createDataFrame([(*r, "t", "n") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = extract.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == want and by[None] == "only é" and (by[2], by[3], by[4]) == ("", "", "")
    assert by[5] == " ".join(["long text,"] * 50000)
    assert extract.extract(df.limit(0)).count() == 0
    plain = page.replace("<article>", "<div class='post'>").replace("</article>", "</div>")
    assert extract.main_text(plain) == want


PARAGRAPHS = [f"Paragraph {i} of the text, with marks; it goes on, and on, for a while. It says {i} things." for i in range(10)]
WRITTEN = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class=lead><p>{PARAGRAPHS[0]}</p></div><div class=text>{WRITTEN[WRITTEN.index('</p>') + 4 :]}</div></body>",
        f"<body><article><p>{PARAGRAPHS[0]}</p></article><article>{WRITTEN[WRITTEN.index('</p>') + 4 :]}</article></body>",
        f"<body><div><p>{PARAGRAPHS[0]}</p></div><main>{WRITTEN[WRITTEN.index('</p>') + 4 :]}</main></body>",
        *[f"<body><div class='{c}'>{WRITTEN}</div><div class=sidebar><p>Aside.</p></div></body>" for c in ("post has-sidebar", "no-comments", "post withSidebar", "widget", "comments")],
        *[f"<body><div {a}>{WRITTEN}</div></body>" for a in ("title='a hidden gem'", "data-hidden", "data-class=nav", "data-x='id=menu'", 'data-x="style=display:none"')],
    ],
)
def test_all_of_the_article_is_kept(page):
    assert extract.main_text(page) == "\n".join(PARAGRAPHS)


def test_hidden_and_hinted_parts_stay_out():
    for a in ("hidden", "HIDDEN", "title='x' hidden", "aria-hidden=true", "style='display: none'", "class='no-js nav'", "id=sidebarNav", 'role="navigation"'):
        assert extract.main_text(f"<div>{WRITTEN}</div><div {a}><p>{PARAGRAPHS[0]} Out.</p></div>") == "\n".join(PARAGRAPHS), a
    assert extract.main_text(f"<article><p>{PARAGRAPHS[0]}</p></article><section id=comments>{WRITTEN}</section>") == PARAGRAPHS[0]
    assert extract.main_text(f"<div class=ad>{PARAGRAPHS[0]}, now.</div><article><p>{PARAGRAPHS[0]}</p></article>") == PARAGRAPHS[0]


def test_fingerprints(spark):
    rows = [(5, "a b c d e\nf g h"), (5, "second of five"), (3, None), (9, "x" * 10 + "é中" * 5), (7, "a b c d e\nf g h"), (None, "last, without an id"), (1, oddrows.LONG)]
    docs = oddrows.docs(spark, rows)
    got = merkle.compare_with_edit(docs).collect()
    assert len(got) == len(rows)
    order = [9, 7, 5, 5, 3, 1, None]
    chain = {r.doc_id: (r.text, r.next_text) for r in merkle.with_next(docs).collect() if r.doc_id != 5}
    assert chain[None][1] == "x" * 10 + "é中" * 5 and chain[3][1] == oddrows.LONG and chain[1][1] == "last, without an id"
    assert [k for k in order if k in chain] == [9, 7, 3, 1, None]
    for r in got:
        if r.doc_id in chain:
            text, nxt = (x or "" for x in chain[r.doc_id])
            k = len(text) // 3
            assert r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + nxt[:k]).encode()).hexdigest()
            assert r.n_chars == len(text) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    prints = {r.n_chars: r.fingerprint for r in got if r.n_chars == 15}
    assert len({r.fingerprint for r in got if r.n_chars == 15 and r.doc_id in (5, 7)}) == 1 and prints
    assert merkle.compare_with_edit(oddrows.docs(spark, [])).count() == 0
    assert len({r.fingerprint for r in got}) == len(rows) - 1


def test_next_document_as_brute_force(spark):
    rows = [(i * i % 1009, f"text {i}") for i in range(300)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = {r.doc_id: r.next_text for r in merkle.with_next(oddrows.docs(spark, rows)).collect()}
    by = sorted(rows, reverse=True)
    assert got == {a[0]: b[1] for a, b in itertools.pairwise([*by, by[0]])}


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a b\nc d\ne f", "a b\nc x\ne f")], "x string, y string")
    df = merkle.with_tree(merkle.with_tree(df, F.col("x"), "p"), F.col("y"), "q")
    assert df.select(merkle.differing_paragraphs(F.col("p"), F.col("q"))).first()[0] == [1]


def test_native_operators_run_no_python(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    for df in (chat.format_chats(conv), merkle.compare_with_edit(spark.read.parquet(f"{SF}/documents.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def k_best(p, text, k):
    """The k best scores of cutting a text, by keeping the k best at each place."""
    text = (" " + text).replace(" ", pieces.SPACE)
    best = [[0.0]] + [[] for _ in text]
    for end in range(1, len(text) + 1):
        cand = []
        for start in range(max(0, end - 16), end):
            i = p.ids.get(text[start:end])
            if i is not None or end == start + 1:
                cand += [s + (p.unknown if i is None else p.score[i]) for s in best[start]]
        best[end] = sorted(cand, reverse=True)[:k]
    return best[-1]


@pytest.mark.parametrize("text", ["a" * 40, "a" * 700, "ha" * 400, "-" * 600, "x" * 513, "中" * 520, "z" * 511])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_runs_of_one_letter_as_k_best(vocabulary, text, n):
    ((ids, top, offsets),) = list(vocabulary.encode([text], n))
    assert [s for s, _ in top] == k_best(vocabulary, text, n)
    cuts = [tuple(pieces.swap(ids, offsets, change)) for _, change in top]
    assert len(set(cuts)) == len(cuts) and all(vocabulary.decode(list(c)) == text for c in cuts)


@pytest.mark.parametrize("text", ["a" * 100_000, "ha" * 50_000, "0123456789abcdef" * 6_000])
def test_long_runs_take_linear_time(vocabulary, text):
    import time

    def seconds(t):
        began = time.process_time()
        ((ids, top, _),) = list(vocabulary.encode([t], 3))
        assert vocabulary.decode(ids.tolist()) == t and len(top) == 3
        return time.process_time() - began

    quarter = seconds(text[: len(text) // 4])
    assert seconds(text) < 5 + 12 * quarter


def test_scores_of_the_file_count_unless_they_are_ranks(vocabulary):
    p = pieces.Pieces(["", "▁", "a", "b", "ab", *[""] * 256], {b: 5 + b for b in range(256)}, [0, -1.0, -2.0, -2.5, -5.5, *[0] * 256])
    ((ids, top, _),) = list(p.encode(["ab"], 2))
    assert ids.tolist() == [1, 2, 3] and [s for s, _ in top] == [-5.5, -6.5] and p.unknown == -15.5
    assert vocabulary.score[261] == pytest.approx(-np.log(4.0), abs=1e-6)  # the third piece of a file of ranks


def test_documents_are_encoded_once(spark):
    """What length_histogram() returns reads the written histogram, not the texts."""
    out = tokencount.length_histogram(tokencount.token_lengths(oddrows.docs(spark), RANKS))
    assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()


def true_article(page):
    """The article of the driver's pages, cut out by its tags, in plain steps."""
    import html
    import re

    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    inside = re.sub(r"</?(p|h1|li|ul|div)\b[^>]*>", "\n", inside).replace("<br>", " ")
    lines = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", inside).split("\n"))
    return "\n".join(x for x in lines if x)


def test_ratios_select_the_article(spark, monkeypatch):
    """With or without its tag, the article of every page is found; with all ratios equal it isn't."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").filter("html IS NOT NULL").collect()]
    want = [true_article(p) for p in pages]
    unmarked = [p.replace("<article>", "<div class=c1>").replace("</article>", "</div>") for p in pages]
    assert [extract.main_text(p) for p in pages] == want
    assert [extract.main_text(p) for p in unmarked] == want
    monkeypatch.setattr(extract, "path_ratios", lambda blocks: [1.0] * len(blocks))
    for p, u, w in zip(pages, unmarked, want, strict=True):
        assert extract.main_text(p) != w and extract.main_text(u) != w


def without_names(page):
    """A page whose tags and names tell nothing: neutral divs, classes and ids."""
    import re

    number = itertools.count()
    page = re.sub(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", lambda m: f'{m[1]}="k{next(number)}"', page)
    return re.sub(r"<(/?)(article|nav|header|footer|aside|form|section|main)\b[^>]*>", r"<\1div>", page)


def test_ratios_decide_where_names_are_scrambled(spark, monkeypatch):
    """With the weights of names kept and ratios constant, no page is right; the ratios alone find nearly all articles."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").filter("html IS NOT NULL").collect()]
    want, bare = [true_article(p) for p in pages], [without_names(p) for p in pages]
    right = lambda: sum(extract.main_text(p) == w for p, w in zip(bare, want, strict=True))
    by_ratio = right()
    monkeypatch.setattr(extract, "path_ratios", lambda blocks: [b.weight for b in blocks])
    assert by_ratio >= 0.9 * len(pages) and right() <= 0.05 * len(pages)


@pytest.mark.parametrize("name", ["class='sharing'", "id='reply'", "id='notice'", "class='cookie newsletter'"])
def test_names_of_paragraphs_in_an_article_take_nothing_out(name):
    p = [f"<p>{x}</p>" for x in PARAGRAPHS[:3]]
    page = f"<body><article>{p[0]}<p {name}>{SAID}</p>{p[1]}{p[2]}</article></body>"
    assert extract.main_text(page) == "\n".join([PARAGRAPHS[0], SAID, *PARAGRAPHS[1:3]])
    assert SAID not in extract.main_text(page.replace(f"<p {name}>{SAID}</p>", f"<div {name}>{SAID}</div>"))


def test_formulas_are_text():
    said = "The sum <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding='tex'>x + 1</annotation></math> is given, as they say."
    page = f"<article><p>{PARAGRAPHS[0]}</p><p>{said}</p></article>"
    assert extract.main_text(page) == f"{PARAGRAPHS[0]}\nThe sum x+1 is given, as they say."


SAID = "Shares rose to 12 dollars on Monday, traders said."


@pytest.mark.parametrize("holder", ["article", "div class=x"])
@pytest.mark.parametrize("element", ["p class='share-price'", "p id='search-results'", "p class='comment-on-law'", "section class='related-work'", "dialog open", "menu"])
def test_names_alone_take_nothing_out(holder, element):
    tag, end = element.split()[0], holder.split()[0]
    said = f"<{element}>{'<li>' * (tag == 'menu')}{SAID}</{tag}>"
    p = [f"<p>{x}</p>" for x in PARAGRAPHS[:3]]
    assert extract.main_text(f"<body><{holder}>{p[0]}{said}{p[1]}{p[2]}</{end}></body>") == "\n".join([PARAGRAPHS[0], SAID, *PARAGRAPHS[1:3]])
    assert extract.main_text(f"<body><{holder}>{''.join(p)}{said}</{end}></body>") == "\n".join([*PARAGRAPHS[:3], SAID])


@pytest.mark.parametrize("text", ["Copyright 2024 Example Inc. All rights reserved.", "© 2024 Example", "Terms and contact"])
@pytest.mark.parametrize("k", [3, 10])
def test_unmarked_footers_stay_out(text, k):
    w = "".join(f"<p>{x}</p>" for x in PARAGRAPHS[:k])
    want = "\n".join(["A title", *PARAGRAPHS[:k]])
    for page in (f"<div class=c1><h1>A title</h1>{w}</div><div class='c3'><p>{text}</p></div>", f"<div id=all><div class=c1><h1>A title</h1>{w}</div><div class=c3><p>{text}</p></div></div>", f"<h1>A title</h1>{w}<div class=c3><p>{text}</p></div>"):
        assert extract.main_text(f"<body>{page}</body>") == want


def test_short_blocks_within_the_article_stay():
    w = "".join(f"<p>{x}</p>" for x in PARAGRAPHS[:5])
    inner = f"<h1>A title</h1>{w}<h2>Things</h2><ul><li>one thing</li><li>two</ul><p>{PARAGRAPHS[6]}</p><table><tr><td>a<td>12</table>"
    want = "\n".join(["A title", *PARAGRAPHS[:5], "Things", "one thing", "two", PARAGRAPHS[6], "a", "12"])
    around = "<div class=m><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>{}<div class=r><a href=q>Read this other one</a></div>"
    assert extract.main_text(around.format(f"<div class=c1>{inner}</div>")) == want
    assert extract.main_text(around.format(f"<article>{inner}<div class=ad>Buy it now, at once. Really. Do.</div></article>")) == want


def test_path_sums_as_a_plain_parser_has_them():
    """Of well-formed pages: text and marks of each path of tags."""
    import re
    from collections import Counter
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.at, self.n, self.marks, self.linked, self.k = [], Counter(), Counter(), Counter(), Counter()

        def handle_starttag(self, tag, attrs):
            self.at.append(tag)

        def handle_endtag(self, tag):
            self.at.pop()

        def handle_data(self, data):
            if text := " ".join(data.split()):
                path = tuple(t for t in self.at if t != "a")
                self.n[path] += len(text)
                self.marks[path] += len(re.findall(r"[.,;:!?]", text))
                self.linked[path] += len(text) * ("a" in self.at)
                self.k[path] += 1

    page = f"<html><body><div>{WRITTEN}<ul><li>one, two</li><li><a>three</a></li></ul></div><section>{WRITTEN[:200].rpartition('<p>')[0]}<h2>Head.</h2></section></body></html>"
    plain = Plain()
    plain.feed(page)
    got = sorted(extract.path_sums(extract.Page(page).blocks).values())
    assert got == sorted((plain.n[p], plain.marks[p], plain.linked[p], plain.k[p]) for p in plain.n) and len(got) == 4


def test_templates_that_could_not_be_read_back_are_refused():
    roles = {"user": chat.Turn("### User:", "</s>")}
    for bad in ({"roles": roles}, {"roles": {"user": chat.Turn("<u>", "\\n")}}, {"other": chat.Turn("[x]", "[/x]")}, {"roles": {"user": chat.Turn("<u>", "</u>"), "tool": chat.Turn("<u>", "</t>")}}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def plain_tree(text, width=4):
    """Root, sections as lists of (hash, spans) of paragraphs, by hashlib."""
    import re

    import xxhash

    lines = []
    for p in (text or "").split("\n"):
        words = re.findall(r"\S+", p, re.ASCII)
        cut = re.findall(r"\S+(?:\s+\S+){0,%d}" % (width - 1), p, re.ASCII)
        assert sum(len(re.findall(r"\S+", c, re.ASCII)) for c in cut) == len(words)
        spans = [xxhash.xxh64_intdigest(c.encode(), 42) >> 32 for c in cut]
        lines.append((hashlib.sha256(p.encode()).hexdigest(), spans))
    sections, now = [], []
    for i, (h, spans) in enumerate(lines):
        now.append((h, spans))
        if h[0] in "08" or i == len(lines) - 1:
            sections.append((hashlib.sha256("".join(f"{h}{len(s):010X}" for h, s in now).encode()).hexdigest(), now))
            now = []
    return hashlib.sha256("".join(h for h, _ in sections).encode()).hexdigest(), sections


def plain_likeness(a, b):
    if a[0] == b[0]:
        return 1.0, 0
    sa, sb = dict(a[1]), dict(b[1])
    same = sum(len(s) for h in sa.keys() & sb.keys() for _, s in sa[h])
    own = lambda x, y: {h: s for k, ps in x.items() if k not in y for h, s in ps}
    pa, pb = own(sa, sb), own(sb, sa)
    same += sum(len(pa[h]) for h in pa.keys() & pb.keys())
    every = lambda x: {h for ps in x.values() for h, _ in ps}
    xa = {s for h, spans in pa.items() if h not in every(sb) for s in spans}
    xb = {s for h, spans in pb.items() if h not in every(sa) for s in spans}
    whole = same + len(xa | xb)
    return (same + len(xa & xb)) / whole if whole else 1.0, len(pa.keys() - pb.keys())


def test_fingerprints_as_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    by = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in merkle.compare_with_edit(docs).collect()}
    assert len(got) == len(texts)
    for (i, t), (_, nxt) in itertools.pairwise([*by, by[0]]):
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        a, e, x = map(plain_tree, (t, edited, nxt))
        least = lambda hashes, n: ".".join(sorted({h[:16] for h in hashes})[:n])
        below = lambda tree: [p for _, ps in tree[1] for p in ps]
        line = lambda tree: f"{tree[0]}:{sum(len(s) for _, s in below(tree))}:{least((h for h, _ in tree[1]), 16)}:{least((h for h, _ in below(tree)), 32)}"
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (line(a), line(e)) and len(r.fingerprint) < 1000
        near, n = plain_likeness(a, e)
        assert r.near_edited == pytest.approx(near, rel=1e-12) and r.n_edited_paragraphs == n
        assert r.near_next == pytest.approx(plain_likeness(a, x)[0], rel=1e-12)


def test_fingerprints_alone_estimate_likeness(spark):
    lines = [f"paragraph {i} of some text" for i in range(400)]
    rows = [("\n".join(lines[:20]), "\n".join(lines[10:20])), ("\n".join(lines), "\n".join(lines[100:])), ("a", "b"), ("", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, y string")
    df = merkle.with_tree(merkle.with_tree(df, F.col("x"), "p"), F.col("y"), "q").select("i", merkle.estimated_likeness(merkle.fingerprint(F.col("p")), merkle.fingerprint(F.col("q"))).alias("k"))
    got = [r.k for r in df.orderBy("i").collect()]
    assert got[0] == 0.5 and abs(got[1] - 0.75) < 0.25 and got[2:] == [0.0, 1.0]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_ranks_among_points(spark, n):
    import bisect

    points = sorted([(i * 37) % 11 - 3 for i in range(n)])
    df = spark.range(-5, 12).select("id", merkle._rank(points, F.col("id"), lambda c, v: c <= v).alias("a"), merkle._rank(points, F.col("id"), lambda c, v: c < v).alias("b"))
    assert all((r.a, r.b) == (bisect.bisect_right(points, r.id), bisect.bisect_left(points, r.id)) for r in df.collect())


def test_an_inserted_line_marks_only_itself(spark):
    lines = [f"line {i} of the text, some words" for i in range(200)]
    moved = lines[:50] + ["a new line"] + lines[50:]
    df = spark.createDataFrame([("\n".join(moved), "\n".join(lines))], "x string, y string")
    df = merkle.with_tree(merkle.with_tree(df, F.col("x"), "p"), F.col("y"), "q")
    r = df.select(merkle.differing_paragraphs(F.col("p"), F.col("q")).alias("d"), merkle.n_differing(F.col("p"), F.col("q")).alias("n"), merkle.differing_paragraphs(F.col("q"), F.col("p")).alias("e"), merkle.likeness(F.col("p"), F.col("q")).alias("k")).first()
    assert (r.d, r.n, r.e) == ([50], 1, []) and 0.98 < r.k < 1


def test_next_document_of_one_id_for_many(spark):
    """A third of all rows without an id, and a third with the same, are dealt over many ranges."""
    rows = [(None, f"none {i}") for i in range(400)] + [(5, f"five {i}") for i in range(400)] + [(10 + i, f"own {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = merkle.with_next(df).collect()
    assert len(out) == len(rows) and sorted(r.next_text for r in out) == sorted(t for _, t in rows)
    follow = {r.text: r.next_text for r in out}
    at, seen = "own 399", []
    while at not in seen[:1]:
        seen.append(at)
        at = follow[at]
    ids = {t: i for i, t in rows}
    order = [ids[t] for t in seen]
    assert len(seen) == len(rows) and order[:400] == list(range(409, 9, -1)) and set(order[400:800]) == {5} and set(order[800:]) == {None}
