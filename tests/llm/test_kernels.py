"""The operators' plain functions against brute force, without Spark."""

from __future__ import annotations

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import anchors, bpe, classifier, common, decontaminate, language_model, neardup, pages, phrases, rules, suffixes

tiktoken = pytest.importorskip("tiktoken")
vocabulary = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    path = vocabulary.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeilnorst  \n.' é0"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_is_exact_and_goes_back(codec, reference, text):
    ids = codec.encode(text)
    assert list(ids) == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_long_pieces(codec, reference):
    for text in ("a" * 3000, "ab" * 2000, "thethe" * 400, "", "é" * 500):
        assert list(codec.encode(text)) == reference.encode_ordinary(text)
    assert list(codec.encode(None)) == []


def test_rules_counts():
    assert rules.judge(None)[:6] == (0, 0, 0, 0, 0, True)
    row = rules.judge("a b c d\na b c e\n\na b c d\n#$ x")
    assert row[:5] == (14, 15, 2, 1, 11)  # a b c thrice, b c d twice
    prose = "The house is on the hill and it was built for the people that came by from the town with all of it. " * 1
    assert rules.judge(prose * 1)[5] is True  # under 50 words


def test_rules_tell_symbols_from_prose():
    random.seed(1)
    common_words = rules.COMMON["en"].split()
    words = [random.choice(common_words) if random.random() < 0.36 else "".join(random.choice("etaoinsh") for _ in range(6)) for _ in range(400)]
    assert rules.judge(" ".join(words) + ".")[8]
    assert not rules.judge(" ".join(w + "&&&" for w in words))[8]
    assert not rules.judge(" ".join(w.upper() + "!!" for w in words))[8]


def test_js_distance_bounds():
    p, q = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert rules.js_distance(p, p) < 1e-6 and abs(rules.js_distance(p, q) - 1) < 1e-9


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=15), st.text("abc", min_size=1, max_size=30), st.integers(0, 5))
def test_myers(pattern, text, budget):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    assert decontaminate.least_distance(pattern, text, budget)[0] == min(min(row[1:]), budget + 1)


def test_pieces_cover_the_item():
    item = "x" * 53
    found = decontaminate.pieces(item, 4)
    assert len(found) == 5 and "".join(p for _, p in found) == item


def _covered(texts, window):
    where: dict = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            where.setdefault(t[i : i + window], []).append((k, i))
    out = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                out[k][i : i + window] = b"\1" * window
    return out


def _flags(ranges, n):
    out = bytearray(n)
    for a, b in anchors.covered(np.array(ranges), n):
        out[a:b] = b"\1" * (b - a)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=5))
def test_interval_tree_covers_what_repeats(spans):
    got = suffixes.compare(spans, [1] * len(spans), 5)
    assert [_flags(r, len(s)) for r, s in zip(got, spans, strict=True)] == _covered(spans, 5)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=4, max_size=25), min_size=1, max_size=5))
def test_automata_cover_what_recurs(spans):
    got = phrases.compare([b" ".join(s) for s in spans], [1] * len(spans), 4)
    assert [_flags(r, len(s)) for r, s in zip(got, spans, strict=True)] == _covered([tuple(s) for s in spans], 4)


def test_maximal_repeats_name_all_places():
    symbols = np.frombuffer(b"xabcdyabcdzabcd", np.uint8).astype(np.int64)
    assert [(n, sorted(p.tolist())) for n, p in suffixes.maximal_repeats(symbols, 3)] == [(4, [1, 6, 11])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_blocks_part_the_windows(symbols):
    hashed = common.mix(np.array(symbols, np.uint64) + np.uint64(1))
    found = anchors.blocks(hashed, 8, 3)
    starts = [w for at, windows, *_ in found for a, n in zip(at, windows, strict=True) for w in range(a, a + n)]
    assert starts == list(range(max(0, len(symbols) - 7)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 10))
def test_sliding_min(values, width):
    x = np.array(values, np.uint64)
    if len(x) >= width:
        assert anchors.sliding_min(x, width).tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_minhash_estimates_similarity():
    random.seed(4)
    items = [random.getrandbits(64) for _ in range(1200)]
    a, b = np.array(items[:1000], np.uint64), np.array(items[200:], np.uint64)
    share = (neardup.minima(a) == neardup.minima(b)).mean()
    assert abs(share - 800 / 1200) < 0.12


def test_shingles_of_short_texts():
    known = common.Hashes()
    assert len(neardup.shingles([], 2, known)) == 0
    assert len(neardup.shingles([b"a"], 2, known)) == 1
    assert len(neardup.shingles(b"a b a b a".split(), 2, known)) == 2


def test_isotonic_rises():
    random.seed(2)
    x = np.array([random.random() for _ in range(200)])
    y = (np.array([random.random() for _ in range(200)]) < x).astype(float)
    knots, levels = classifier.isotonic(x, y)
    assert (np.diff(knots) > 0).all() and levels[0] < levels[-1]


def test_statistics_of_odd_texts():
    for text in (None, "", " \n\t", "a" * 10_000, "\U0001f600 é"):
        row = classifier.statistics(text)
        assert len(row) == len(classifier.NAMES) and np.isfinite(row).all()


def test_gradients_match_differences():
    """Each weight's gradient against the loss a little to either side, over windows with texts that begin and end inside."""
    random_ = np.random.default_rng(4)
    net = language_model.Network(40)
    net.w = {k: v.astype(np.float64) + random_.normal(size=v.shape) * 0.1 for k, v in net.w.items()}
    inputs, targets = random_.integers(0, 60, (6, 3)), random_.integers(0, 60, (6, 3))
    fresh, used = np.zeros((6, 3), bool), np.ones((6, 3), bool)
    fresh[0, :2] = fresh[3, 1] = True
    used[4:, 2] = False
    state = random_.normal(size=(3, language_model.STATE))
    loss, found, _ = net.gradients(inputs, targets, fresh, used, state)
    table = np.zeros_like(net.w["table"])
    table[found.pop("rows")] = found["table"]
    found["table"] = table
    for k, w in net.w.items():
        for at in random_.integers(0, w.size, 12).tolist() + [int(np.abs(found[k]).argmax())]:
            kept, ends = w.flat[at], []
            for step in (1e-5, -1e-5):
                w.flat[at] = kept + step
                ends.append(net.gradients(inputs, targets, fresh, used, state)[0])
            w.flat[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - found[k].flat[at]) < 1e-5, k
    assert loss > 0


def test_learning_lowers_the_loss():
    random_ = np.random.default_rng(1)
    net = language_model.Network(40)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    inputs, targets = random_.integers(0, 60, (5, 3)), random_.integers(0, 60, (5, 3))
    fresh, used = np.zeros((5, 3), bool), np.ones((5, 3), bool)
    fresh[0] = fresh[2, 1] = True

    def loss() -> float:
        states, _ = net.run(inputs, fresh, np.zeros((3, language_model.STATE)))
        return -net.log_probs(states.reshape(-1, language_model.STATE), targets.ravel())[0].sum()

    before = loss()
    for _ in range(30):
        net.learn(inputs, targets, fresh, used, np.zeros((3, language_model.STATE)), {"t": 0, "rate": 0.01})
    assert loss() < before * 0.9


def test_learning_keeps_the_memory_of_its_arrays():
    """Arrays mapped anew for each window took a third of the time of learning, in page faults."""
    import resource

    random_ = np.random.default_rng(1)
    net = language_model.Network(300)
    texts = [random_.integers(0, 300, 400).astype(np.int32) for _ in range(300)]
    language_model.learn_all(net, iter(texts), 0, 120_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    language_model.learn_all(net, iter(texts), 0, 120_000)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 10_000


def test_words_are_read_in_bulk_as_one_by_one():
    words = [b"", b"a", b"abcd", b"abcde", b"abcdefgh", b"abcdefghi", b"ab.", b"what?", b"so!", b"and,", b"so;", b"(x)", "é".encode(), "wörter,".encode(), b"\xff"]
    assert language_model.shapes_of(words).tolist() == [language_model.shape(w) for w in words]
    hashes = language_model.hashes_of([b"", b"so!", b"a", b"ab."])
    reader = language_model.Reader(hashes, np.array([9, 7, 5, 3]), 3)
    texts = ["A so! new, ab.", None, "a " * 9, "\xa0 x\x1cy\x0bz ", *[str(k) for k in range(5000)]]
    for text, ids in zip(texts, reader.ids_of(texts), strict=True):
        known = {b"": 0, b"so!": 1, b"a": 2}
        assert ids.tolist() == [known.get(w, 3 + language_model.shape(w)) for w in language_model.tokens(text)]
    assert [reader.read(w)[1:] for w in (b"", b"ab.", b"none")] == [(0, 9), (3 + language_model.shape(b"ab."), 3), (3 + language_model.shape(b"none"), -1)]
    none = language_model.Reader(hashes[:0], np.zeros(0, np.int64), 0)
    assert none.read(b"a")[1:] == (language_model.shape(b"a"), -1)


def test_words_of_texts_are_those_of_each_text():
    """Found, hashed and given shapes in bulk, as stretches of bytes."""
    long = ["x" * n + tail for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 1000) for tail in ("", ".", "é", "\0")]
    texts = ["", None, " ", "A so! new,", "\t\n\x0b\x0c\r end", "\x1c\x85\xa0\u2003 a\0 a \0a", "no space at the end", *long, " ".join(long), "\ud800 odd", "ÀÉ " * 700, ""]
    found, sizes = language_model.Words.of(texts)
    each = [language_model.tokens(t) for t in texts]
    words = [w for some in each for w in some]
    assert sizes.tolist() == [len(some) for some in each]
    assert [found.bytes[a : a + n].tobytes() for a, n in zip(found.starts.tolist(), found.sizes.tolist(), strict=True)] == words
    hashes = found.hashes()
    assert found.shapes(np.arange(len(words))).tolist() == [language_model.shape(w) for w in words]
    alone = {w: language_model.hashes_of([w])[0] for w in set(words)}
    assert hashes.tolist() == [alone[w] for w in words] and len(set(alone.values())) == len(alone)
    none, sizes = language_model.Words.of([])
    assert none.hashes().tolist() == sizes.tolist() == []


def test_tables_find_every_word_and_no_other():
    words = [str(k * k).encode() for k in range(40_000)]
    hashes = language_model.hashes_of(words)
    assert len(set(hashes.tolist())) == len(words)
    for n in (0, 1, 5, 30_000):
        reader = language_model.Reader(hashes[:n], np.arange(n), n // 2)
        assert reader.places(hashes).tolist() == [*range(n), *[n] * (len(words) - n)]
    # all in the last slots of the table, so that the search goes round
    near = np.uint64(language_model.common.MASK) - np.arange(9, dtype=np.uint64)
    assert language_model.Reader(near[:6], np.arange(6), 3).places(near).tolist() == [0, 1, 2, 3, 4, 5, 6, 6, 6]


def test_words_are_not_read_one_by_one():
    """An object and a search for each word took more of op2's time than scoring."""
    import time

    random_ = np.random.default_rng(6)
    texts = [" ".join(map(str, random_.zipf(1.3, 500) % 60_000)) for _ in range(800)]
    words = [str(k).encode() for k in range(60_000)]
    reader = language_model.Reader(language_model.hashes_of(words), np.arange(60_000), 1000)
    list(reader.ids_of(texts))

    def seconds(read) -> float:
        begun = time.process_time()
        read()
        return time.process_time() - begun

    number = {w: k for k, w in enumerate(words)}
    singly = min(seconds(lambda: [[number.get(w, 0) for w in language_model.tokens(t)] for t in texts]) for _ in range(5))
    assert min(seconds(lambda: list(reader.ids_of(texts))) for _ in range(5)) < singly


def test_large_odds_do_not_overflow():
    odds, sums = language_model._softmax(np.array([[1000.0, 999.0, -1000.0], [3.0, 3.0, 3.0]], np.float32))
    assert np.allclose(odds / sums[:, None], [[0.731059, 0.268941, 0], [1 / 3] * 3])


def test_rows_are_summed_by_word():
    random_ = np.random.default_rng(3)
    for n, most in ((1, 1), (500, 1), (500, 7), (500, 100_000)):
        rows, words = random_.normal(size=(n, 4)), random_.integers(0, most, n)
        found, kinds = language_model._summed(rows, words)
        assert kinds.tolist() == sorted(set(words.tolist())) and np.allclose(found, [rows[words == k].sum(axis=0) for k in kinds])


def test_lanes_hold_every_token_once():
    texts = [np.arange(n) + 100 * n for n in (3, 1, 7, 2)]
    inputs, targets, numbers, fresh = language_model.lanes_of(texts, 2, 9)
    for k, t in enumerate(texts):
        assert sorted(targets[numbers == k].tolist()) == sorted(t.tolist())
    assert fresh.sum() == 4 and set(inputs[fresh].tolist()) == {9}


def test_log_probs_sum_to_one():
    net = language_model.Network(40)
    state = np.random.default_rng(2).normal(size=(1, language_model.STATE)).astype(np.float32)
    every = np.arange(40 + language_model.SHAPES)
    got, _ = net.log_probs(np.repeat(state, len(every), axis=0), every)
    assert abs(np.exp(got).sum() - 1) < 1e-4


def test_scoring_ignores_how_texts_are_laid_out():
    net = language_model.Network(30)
    texts = [np.arange(n) % 30 for n in (40, 3, 75, 1)]
    together = language_model.log10_probs(net, texts, 0)
    alone = [language_model.log10_probs(net, [t], 0)[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>x", "x"),
        ("<nav><a href=a>menu</a></nav><article><h1>T &amp; t</h1><p>One,\n two<br>three<p>Four</article><footer>f</footer>", "T & t\nOne, two three\nFour"),
        ('<div class="sidebar"><p>a, b, c, d</p></div><div id="content"><p>Long text, with commas, goes here.</p><div class="comments"><p>me, too</p></div></div>', "Long text, with commas, goes here."),
        ("<script>var x='<p>no</p>'</script><style>p{}</style><main><p>yes, this</p></main>", "yes, this"),
        ("<form><p>Name, please</p></form><article><p>Body text.</p></article>", "Body text."),
        ("<form id=aspnetForm><nav><a href=a>m</a></nav><h1>Title</h1><p>One, long text.</p><p>Two.</p></form>", "Title\nOne, long text.\nTwo."),
        ("<body><form id=aspnetForm><article><p>One, long text.</p></article><div class=footer>x</div></form>", "One, long text."),
        ('<div class="post reader-view"><h1>T</h1><p>One, long text.</p></div>', "T\nOne, long text."),
        ('<div class="article-content has-sidebar"><p>One, long text.</p><p>Two.</p><div class="sidebar"><p>no</p></div></div>', "One, long text.\nTwo."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold, and more, here.</p>", "Let x=2 hold, and more, here."),
        ("<article><svg viewBox=a><path d=b/><p>One, text.</p><p>Two.</p></article>", "One, text.\nTwo."),
        ("<article><template><p>One, text.</p><p>Two.</p></article>", "One, text.\nTwo."),
        ("<article><svg><title>no</title><g><text>no</text></g></svg><p>One, text.</p></article>", "One, text."),
        ("<nav><ul><li><a href=a>m</a><article><h1>T</h1><p>One, text.</p><p>Two.</p></article>", "T\nOne, text.\nTwo."),
        ('<div class="ad"><p>A long, long, long notice, here.</p></div><article><p>Of.</p></article>', "Of."),
        ('<aside><p>A long, long, long notice, here.</p><p>And more, of it.</p></aside><main><p>Of.</p></main>', "Of."),
        ('<div class="comments"><h1>c</h1><p>me, too, and a long one at that</p><p>more</p></div><p>Body.</p>', "Body."),
        ("<p>1 < 2 and a<b, c", "1 < 2 and a"),
        ('<p>One <a href="x>two</a> three, four.</p>', "One two three, four."),
        ('<p title="a > b">One</p><p title=\'a > b\'>Two</p>', "One\nTwo"),
    ],
)
def test_pages(page, text):
    assert pages.article(page) == text


@pytest.mark.parametrize("unit", ["<b>", "<p><b>", "<dt><b>", "<li><ul>"])
def test_elements_take_few_calls(unit):
    """Sums and lookups by Python functions took half of the time of a page of many elements."""
    import sys

    calls = 0

    def count(frame, event, arg) -> None:
        nonlocal calls
        calls += event == "call"

    page = "<article><p>Text, first.</p>" + unit * 1000 + "</article>"
    sys.setprofile(count)
    try:
        pages.article(page)
    finally:
        sys.setprofile(None)
    assert calls < 18_000 * unit.count("<")


@pytest.mark.parametrize("unit", ["<x ", '<a "', "</b>", "<b>", "<div>", "<i><div></i>", "<title>", "<!--", "<svg>", "<p><b>", "<dt><b>", '<a b="', "<a b='\"", "<li><ul>", "< ", "</", "<a =", "<td><table>", "a&", "<b></i>"])
def test_pages_of_a_megabyte_take_linear_time(unit):
    import time

    page = "<article><p>Text, first.</p>" + unit * (1_000_000 // len(unit)) + "</article>"
    begun = time.process_time()
    pages.article(page)
    assert time.process_time() - begun < 8


def test_deep_pages_keep_their_text():
    page = "<article>" + "<div>" * 3000 + "<p>One, text.</p>" + "</div>" * 3000 + "<p>Two, text.</p></article>"
    assert pages.article(page) == "One, text.\nTwo, text."


def test_pages_of_the_table_give_their_articles():
    """Against the text between each page's article tags, block by block."""
    import html
    import re

    duckdb = pytest.importorskip("duckdb")
    for (page,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert pages.article(page) == "\n".join(x for x in parts if x)


def test_codec_memos_are_compact_and_go_with_the_operator():
    codec = bpe.own_codec(*bpe.default_vocabulary())
    assert bpe.own_codec(*bpe.default_vocabulary()) is codec  # kept from task to task
    codec.encode("token, token said so")
    assert all(type(x) is bytes for x in [*codec.newer.values(), *codec.newer_pieces.values()])
    assert " said" not in codec.newer_pieces  # of one piece, and remembered as a word
    codec.older, codec.newer = codec.newer, {}
    codec.encode("a token")
    assert "token" in codec.newer and "token" not in codec.older
    next(rules._judge_all(iter([[None]])))
    assert bpe.codec.cache_info().currsize == 0
