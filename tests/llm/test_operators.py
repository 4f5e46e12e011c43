"""The operators over small frames with nulls, ties, repeated rows and clashing names."""

from __future__ import annotations

import collections
import hashlib
import math

import pytest

from sluice.llm import bpe, classifier, common, decontaminate, language_model, lines, neardup, pages, phrases, rules, suffixes

LINE = "This very line stands in many documents, as boilerplate does."
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k * (seed + 3) + k // 5) % len(WORDS)] + str((seed * 31 + k * 17) % 97) for k in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    common.shared_dir(spark)
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed")
    texts = [base, near, base, None, "", " \n ", words(2, 90), words(3, 40) + "\n" + LINE, LINE.upper() + "\nown line", "x\n" + LINE, LINE, LINE, words(4, 60) + " " + words(9, 50), words(9, 50) + " " + words(5, 60)]
    rows = [(k, t, "en", "kept", k) for k, t in enumerate(texts)]
    rows += [(2, base, "en", "again", 2), (None, words(6, 30), "en", "none", 0)]
    # columns named like the operators' own
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, n long").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def brute(texts: list, window: int, join) -> list:
    where: dict = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - window + 1):
            where.setdefault(t[i : i + window], []).append((k, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + window] = b"\1" * window
    return sorted((len(t), sum(g), join([x for x, y in zip(t, g, strict=True) if not y])) for t, g in zip(texts, gone, strict=True))


@pytest.mark.parametrize("most_blocks", [2000, 1])
def test_suffix_dedup(docs, most_blocks):
    found = suffixes.removed(docs, length=40, anchor=12, most_blocks=most_blocks).collect()
    want = brute([(r["text"] or "").encode() for r in docs.collect()], 40, bytes)
    assert sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in found) == want


@pytest.mark.parametrize("most_blocks", [2000, 1])
def test_phrase_dedup(docs, most_blocks):
    found = phrases.removed(docs, words=12, anchor=4, most_blocks=most_blocks).collect()
    want = brute([tuple((r["text"] or "").split()) for r in docs.collect()], 12, " ".join)
    assert sorted((r["n_words"], r["n_removed"], r["kept"]) for r in found) == want


def test_line_dedup(docs):
    found = {(r["doc_id"], r["kept"]): r for r in lines.restore(docs).collect()}
    # keys at 7, 8, 9, 10, 11: five documents, of which 11 keeps its line
    assert found[11, "kept"]["_lines"].kept == LINE and found[11, "kept"]["_lines"].n_dropped == 0
    assert found[10, "kept"]["_lines"].kept == "" and found[10, "kept"]["_lines"].n_dropped == 1
    assert found[8, "kept"]["_lines"].kept == "own line"
    assert found[9, "kept"]["_lines"].kept == "x"
    assert found[3, "kept"]["_lines"].n_lines == 1 and found[3, "kept"]["_lines"].kept == ""
    assert found[5, "kept"]["_lines"].n_lines == 2


@pytest.mark.parametrize("batches", [1, 4, 11])
def test_line_runs_against_brute_force(spark, batches):
    """With eleven batches runs are compacted twice over."""
    import random

    random.seed(batches)
    rows = [(random.randrange(60), random.choice("abcdefghij")) for _ in range(400)]
    where: dict = {}
    for doc, key in rows:
        where.setdefault(key, set()).add(doc)
    keys = spark.createDataFrame(rows, "doc long, key string").selectExpr("doc", "unhex(md5(key)) as key")
    names = {hashlib.md5(k.encode()).digest(): k for k in where}
    found = {names[bytes(r["key"])]: r["keeper"] for r in lines.repeated(common.table(keys, "keys"), batches, 25).collect()}
    assert found == {k: max(d) for k, d in where.items() if len(d) >= 25}


def test_line_runs_join_without_exchange(spark):
    keys = spark.range(1000).selectExpr("id as key", "id as keeper", "1L as n")
    run = common.sorted_table(keys, "run0", "key")
    batch = keys.groupBy("key").agg(lines.F.max("keeper").alias("keeper"))
    with common.settings(spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
        plan = batch.join(run.select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.rindex("FileScan") - 200 :]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Sort [" not in side
    common.drop(run)


def test_line_dedup_passes_clashing_columns_through(spark):
    rows = [(k, LINE, 7, 8, 9, 10) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc long, _row long, drop long, `_lines` long")
    found = lines.restore(docs, "x")
    assert found.columns == [*docs.columns, "x"]
    assert sorted((r["doc_id"], r["_doc"], r["drop"], r["x"].kept) for r in found.collect()) == [(k, 7, 9, LINE if k == 4 else "") for k in range(5)]


def test_near_dedup(docs):
    found = neardup.linked(docs, size=2).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by_id[0] == by_id[1] == by_id[2] == {0}
    assert by_id[8] == by_id[9] == by_id[10] == by_id[11] == {8}
    assert by_id[3] == {3} and by_id[4] == {4} and by_id[5] == {5}  # no words: linked with nothing
    assert len(found) == docs.count()
    kept = neardup.distinct(docs, size=2)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert not {1, 2, 9, 10, 11} & set(ids) and {0, 3, 4, 5, 6, 8} <= set(ids)
    assert kept.where("doc_id is null").count() == 1


def test_near_dedup_meets_third_leader(spark, monkeypatch):
    """1 is near to 0, the leader of their one common band, but shares bands with two hubs of higher rank (2 and 3)."""
    base = words(1, 120)
    texts = {0: base, 1: base.replace(base.split()[60], "changed")} | {k: words(k + 20, 120) for k in range(2, 30)}
    bands = {0: [1, *range(40, 46)], 1: [1, 2, 3], 2: [2, *range(10, 16)], 3: [3, *range(20, 26)]}
    bands |= {k: list(range(10, 16)) for k in range(4, 12)} | {k: list(range(20, 26)) for k in range(12, 19)} | {k: list(range(40, 46)) for k in range(19, 21)}
    docs = spark.createDataFrame([(k, texts[k]) for k in bands], "doc_id long, text string")
    sign = neardup._sign

    def placed(docs, size):
        given = spark.createDataFrame(list(bands.items()), "doc_id long, bands array<long>")
        out = sign(docs, size).drop("bands").join(given, "doc_id")
        alike = out.drop("signature").selectExpr("*", "array_repeat(0L, 16) as signature")
        return alike.select("doc_id", "row", "key", "n_shingles", "bands", "signature")

    monkeypatch.setattr(neardup, "_sign", placed)
    found = {r["doc_id"]: r["component_id"] for r in neardup.linked(docs, size=2).collect()}
    assert found[0] == found[1] == 0 and all(found[k] == k for k in bands if k > 1)


def test_near_dedup_of_repeated_ids(spark):
    """Of 5's three texts one is near to 1, and two others are near to nothing."""
    base = words(1, 120)
    texts = [(1, base), (5, base.replace(base.split()[60], "changed")), (5, words(40, 90)), (5, words(41, 90)), (5, words(41, 90)), (5, words(41, 90).upper())]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = sorted((r["doc_id"], r["text"].lower()) for r in neardup.distinct(docs, size=2).collect())
    assert kept == sorted([(1, base), (5, words(40, 90)), (5, words(41, 90))])


@pytest.mark.parametrize(("size", "tile"), [(2, 512), (2, 4), (5, 4)])
def test_near_dedup_against_brute_force(spark, monkeypatch, size, tile):
    """Families of edited copies, some near to one another and many a little too far, dealt into small tiles."""
    import random

    random.seed(size)
    texts = []
    for family in range(3):
        base = words(family + 50, 150).split()
        for _ in range(60):
            edited = list(base)
            for _ in range(random.randrange(25 if size == 2 else 8)):
                edited[random.randrange(150)] = f"new{random.randrange(10**6)}"
            texts.append(" ".join(edited))
    texts += [words(k, 60) for k in range(20)]
    sets = [set(zip(*[t.split()[k:] for k in range(size)], strict=False)) for t in texts]
    least = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    monkeypatch.setattr(neardup._across, "__defaults__", (tile,))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.linked(docs, size=size).collect()}
    assert [found[k] for k in range(len(texts))] == least
    assert len(set(least)) > 25


def test_near_dedup_passes_clashing_columns_through(spark):
    rows = [(1, words(1, 60), 7, 8, 9), (2, words(1, 60), 7, 8, 9), (3, words(2, 60), 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, row long, `id` long")
    assert sorted(map(tuple, neardup.distinct(docs).collect())) == [rows[0], rows[2]]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert all(found[k] == 0 for k in range(31)) and found[101] == 100


def test_decontamination(spark, docs):
    item = words(2, 30)
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "short"), (4, words(2, 60)[200:400].replace("alpha", "alpho"))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, items).collect()}
    assert (6, 1) in found and {d for d, _ in found} == {6}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1


def test_decontamination_of_short_items(spark):
    docs = spark.createDataFrame([(1, "So: what is the CAPITAL of France? Paris."), (2, "what is the capital of francesca"), (3, "what is the capitol of france"), (4, "What is the capital of France"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is the capital of France?"), (8, " ?! "), (9, None)], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["distance"], r["found_end"]) for r in decontaminate.matches(docs, items).collect())
    assert found == [(1, 7, 0, 31), (4, 7, 0, 28)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [2, 3, 5]


def test_bpe_digest(docs):
    found = bpe.digest(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[3]["n_tokens"] == 0 and by_id[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by_id[11]["decoded_sha256"] == hashlib.sha256(LINE.encode()).hexdigest()


def test_rules_keep(docs):
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    assert not {3, 4, 5, 10} & {r["doc_id"] for r in kept.collect()}


def test_classifier_without_labels_and_with_nulls(spark, docs):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert all(abs(r["score"] - 0.5) < 0.02 for r in classifier.scored(docs, labels).collect())


def test_classifier_learns(spark):
    rows = [(k, words(k, 80) if k % 2 else " ".join([WORDS[k % 24].upper() + "&&&"] * 80), k % 2) for k in range(240)]
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = {r["doc_id"]: r for r in classifier.scored(both.select("doc_id", "text"), both.select("doc_id", "quality")).collect()}
    held = [r for r in found.values() if r["held_out"]]
    assert held and sum(r["predicted"] == r["doc_id"] % 2 for r in held) / len(held) > 0.95


def test_language_model(docs, monkeypatch):
    monkeypatch.setattr(language_model, "EPOCHS", 1)
    found = language_model.scored(docs).collect()
    assert len(found) == docs.count()
    none = [r for r in found if r["doc_id"] == 3][0]
    assert none["n_tokens"] == 1 and none["score"] < 0 and none["base_score"] < 0
    assert all(r["n_known"] <= r["n_tokens"] and r["score"] <= 0 for r in found)


def test_language_model_learns_from_all_rows(spark):
    """What stands only in texts too long for the sample is learned too."""
    rows = [(k, words(k, 60)) for k in range(40)] + [(k, "ping pong " * 6000) for k in range(100, 112)]
    docs = spark.createDataFrame(rows + [(1000, "ping pong " * 40), (1001, "ping ping " * 40)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_model.scored(docs).collect()}
    assert found[1000]["score"] / found[1000]["n_tokens"] > -0.3
    assert found[1000]["score"] > found[1001]["score"] + 20


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_counts_of_words_are_whole(spark, monkeypatch, most):
    """Whatever a task holds of them at a time."""
    monkeypatch.setattr(language_model, "FLUSH", most)
    monkeypatch.setattr(language_model, "READ", 100)
    texts = [None, "", *[words(k, 40) + " " + "Word " * k for k in range(60)], "a" * 70 + " é!"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    expected = collections.Counter(w for t in texts for w in language_model.tokens(t))
    found = {r["h"]: (r["shape"], r["n"]) for r in language_model.counted(docs).collect()}
    hashes = language_model.hashes_of(list(expected)).view(language_model.np.int64).tolist()
    assert found == {h: (language_model.shape(w), n) for h, (w, n) in zip(hashes, expected.items(), strict=True)}


def test_texts_are_read_into_ids_that_learning_takes(spark):
    """Learning read every text a second time, and scoring a third."""
    np = language_model.np
    texts = ["A so! new, ab. new, none", None, "a " * 300, "", "\xa0 x\x1cy"]
    given = spark.createDataFrame([(k or None, k, True, False, t) for k, t in enumerate(texts)], "doc_id long, at long, learn boolean, begins boolean, text string")
    tables = (language_model.hashes_of([b"", b"so!", b"a", b"ab."]), np.array([9, 7, 5, 3]), 3)
    shape_log = np.arange(language_model.SHAPES) / 8
    read = language_model.read_texts(given, tables, 2.5, shape_log)
    found = {r["at"]: r for r in read.collect()}
    reader = language_model.Reader(*tables)
    for k, text in enumerate(texts):
        each = [reader.read(w) for w in language_model.tokens(text)]
        row = found[k]
        assert row["doc_id"] == (k or None) and row["n_tokens"] == len(each) and row["n_known"] == sum(n > 0 for _, _, n in each)
        assert np.frombuffer(row["ids"], language_model.ids_kind(3)).tolist() == [i for _, i, _ in each]
        logs = [math.log10(max(n, 0) + 1) for _, _, n in each]
        assert abs(row["base_score"] - sum(x - 2.5 for x in logs)) < 1e-9
        assert abs(row["own"] - sum(x - shape_log[i - 3] for x, (_, i, _) in zip(logs, each, strict=True) if i >= 3)) < 1e-9
        rare = sorted(np.uint64(h).view(np.int64).item() for h, _, n in each if n < 0)
        assert [h for h, n in zip(row["rare"], row["times"], strict=True) for _ in range(n)] == rare
    assert language_model.ids_kind(65_000) == "<u2" and language_model.ids_kind(1 << 16) == "<i4"
    before = language_model.Network(3)
    after = language_model.learned(read.select("at", "n_tokens", "ids"), before, 0, 320)
    assert not np.array_equal(after.w["words"], before.w["words"])


def test_language_model_windows_hold_every_token():
    texts = [language_model.np.arange(n) + 1 for n in (1, 5, 32, 33, 1000, *[7] * 200)]
    seen = [t for _, targets, _, used in language_model.windows(iter(texts), 0) for t in targets[used].tolist()]
    assert sorted(seen) == sorted(x for t in texts for x in t.tolist())


def test_extraction(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "u", "<article><p>a, b</p></article>"), (2, "u", "<article><p>a, b</p></article>")], "page_id long, url string, html string")
    assert sorted(r[0] for r in rows.select(pages.extracted("html")).collect()) == ["", "a, b", "a, b"]


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert rules.keep(empty).count() == 0
    assert lines.restore(empty).count() == 0
    assert neardup.linked(empty).count() == 0
    assert neardup.distinct(empty).count() == 0
    assert decontaminate.matches(empty, items).count() == 0
    assert decontaminate.clean(empty, items).count() == 0
    assert bpe.digest(empty).count() == 0
    assert suffixes.removed(empty).count() == 0
    assert phrases.removed(empty).count() == 0
    assert classifier.scored(empty, labels).count() == 0
    assert language_model.scored(empty).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path, docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    prose = lambda seed: " ".join(w if k % 3 else rules.COMMON["en"].split()[(k // 3 * (seed + 2)) % 20] for k, w in enumerate(words(seed, 160).split()))
    plain = {k: prose(k + 20) for k in range(8)}
    texts = plain | {20: plain[0], 21: plain[1] + " end", 30: "&&& " * 80, 31: plain[2][:300] + " " + words(70, 40)}
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    (tmp_path / "documents.parquet").parent.mkdir(exist_ok=True)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, words(70, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {k: t for k, t in texts.items() if rules.judge(t)[8] and k not in (20, 21) and words(70, 30) not in t}
    codec = bpe.Codec(*bpe.default_vocabulary())
    assert set(found) == set(left) and left
    for k, t in left.items():
        assert found[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, codec.encode(t))).encode()).hexdigest()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_empty_tables(spark, tmp_path, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Against plain Python: nulls, repeated ids with equal and with different texts, and columns named like the stages' own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["_id", "_row", "_doc", "_drop", "_lines", "_text_key", "whole", "row", "id", "k", "n_chars"]
    a, b, c = words(1, 90), words(2, 90), words(3, 90)
    texts = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, None), (3, None), (4, ""), (5, c + "\n" + LINE), *((k, f"{words(k, 70)}\n{LINE}") for k in range(6, 10))]
    rows = [(k, t, *range(len(names) - 1), len(t or "")) for k, t in texts]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` long" for n in names)]))
    spark.createDataFrame([(1, c[:200]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)

    def after(name: str) -> list:
        found = stage[name](spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        return sorted(map(tuple, found.collect()), key=repr)

    same = lambda x: sorted(x, key=repr)
    extra = tuple(range(len(names) - 1))
    assert after("quality_rules") == same(r for r in rows if rules.judge(r[1])[8])
    short = [r if r[0] not in (5, 6, 7, 8) else (r[0], r[1].split("\n")[0], *extra, len(r[1].split("\n")[0])) for r in rows]
    assert after("line_dedup") == same(short)
    # of 1's texts a is the group's least; b is near to nothing; 2 and one of the equal rows go
    assert after("near_dedup") == same([*rows[1:3], *rows[4:]])
    assert after("decontamination") == same(r for r in rows if r[0] != 5)
    assert len(stage["byte_bpe"](spark, docs, str(tmp_path)).collect()) == len(rows)


def test_nothing_is_removed_by_hashes_alone(spark, docs):
    """Where the operator's comparison finds nothing, no count of equal hashes makes a verdict."""
    from sluice.llm import anchors

    blind = lambda spans, counts, window: [[] for _ in spans]
    for most in (2000, 1):
        assert not anchors.repeated(docs, 40, 12, suffixes.byte_hashes, suffixes._slicer, blind, suffixes.byte_hashes, 1 << 19, most).collect()
        assert not anchors.repeated(docs, 12, 4, phrases.word_hashes, phrases._slicer, blind, phrases.word_hashes, 1 << 20, most).collect()


def test_further_copies_are_told_by_their_symbols():
    from sluice.llm import anchors

    data = b"abcdefgh" * 4
    part_of = suffixes._slicer(data)
    right, wrong = anchors.digest(data[8:16]), anchors.digest(b"another!")
    assert anchors.confirmed(part_of, [8, 20], [[0, 8], [0, 8]], [right, wrong], 32) == [(8, 16)]
    assert anchors.confirmed(part_of, None, None, None, 32) == []


def test_repeats_across_chunk_borders(spark, monkeypatch):
    """A passage that stands twice in one long text, over the border where its blocks are cut."""
    import random

    random.seed(3)
    noise = lambda n: "".join(random.choice("abcdefghij klmnop") for _ in range(n))
    passage = noise(700)
    border = 1 << 20
    text = noise(border - 350) + passage + noise(5000) + passage + noise(100)
    docs = spark.createDataFrame([(1, text), (2, "a"), (3, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffixes.removed(docs).collect()}
    assert found[1]["n_bytes"] == len(text) and 1400 <= found[1]["n_removed"] <= 1406 and found[1]["n_spans"] == 2
    assert found[2]["n_removed"] == found[3]["n_removed"] == 0


def test_held_out_texts_are_likelier_by_the_network_than_by_counts(spark):
    found = language_model.op2_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert found["sum(score)"] > found["sum(base_score)"] + 0.2 * found["sum(n_tokens)"]


def test_held_out_quality_is_told(spark):
    """The share of pairs of held-out documents, of either label, that the scores order rightly."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in classifier.op1_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out").collect() if labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, q in rows if q == 1], [s for s, q in rows if q == 0]
    assert len(good) > 10 and len(bad) > 10
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
