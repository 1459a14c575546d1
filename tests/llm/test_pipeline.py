import pytest

import corpus_pipeline as P
from siftgrain.llm.store import write_table
from tests.llm.helpers import awkward, docs, empty, prose
from tests.llm.test_similar import brute_spans, groups, shingles

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents ahead of each stage, and the result."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, f in P.STAGES:
        out.append(write_table(f(spark, out[-1], SF), "test")[0])
    return [df.collect() for df in out]


def test_the_stages_are_the_ones_asked_for():
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "SentencePiece"]


def test_columns(stages):
    for rows in stages[1:-1]:
        assert list(rows[0].asDict()) == P.COLUMNS


def test_language_keeps_clean_documents(stages):
    kept = {r.doc_id for r in stages[1]}
    lost = [r for r in stages[0] if r.doc_id not in kept]
    assert not [r for r in lost if r.lang and any(c.isalpha() for c in r.text or "")]


def test_language_rejects_what_is_of_no_learned_language(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, "это текст на другом языке, которого никто не учил"), (-2, "123 !!"), (-3, None), (-4, "你好，这是另一种语言的文字。"), (-5, "A.")]
    more = spark.createDataFrame([(i, t, None, "s", None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.by_language(spark, df.unionByName(more), SF).filter("doc_id < 0").collect()}
    assert kept == {-5}


def test_rows_of_one_id_and_different_texts(spark):
    x, y, z = prose(60, 11), prose(60, 12), prose(60, 13)
    rows = [(1, x, "en"), (1, y, "en"), (1, y, "en"), (2, y, "en"), (3, x, "en"), (3, z, "en"), (4, z, "en"), (5, x + " w", "en"), (5, x, "en"), (None, x, "en"), (6, None, "en"), (6, None, "en")]
    out = P.without_near_copies(spark, docs(spark, rows), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, x), (1, y), (3, z), (None, x), (6, None)], key=str)
    near = [(7, x, "en"), (7, x + " w", "en"), (8, x, "en")]
    assert P.without_near_copies(spark, docs(spark, near), SF).count() == 1


def test_blank_rests_go_and_no_text_is_rewritten_to_see_it(spark, monkeypatch):
    rests = [(1, 9, " \t\n\x0b\x0c\r "), (2, 9, "\u00a0"), (3, 9, "\n a \n"), (4, 0, ""), (5, 9, ""), (6, 9, "\x00"), (7, 9, "é"), (8, 9, "\u2003\n")]
    cut = spark.createDataFrame([(i, n, bytearray(t.encode()), "en", "s") for i, n, t in rests], "doc_id long, n_bytes long, kept binary, lang string, source string")
    monkeypatch.setattr(P.suffix_dedup, "remove_repeats", lambda docs, derive, **_: derive(cut))
    out = P.without_repeats(spark, cut, SF)
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {i: (t, len(t)) for i, _, t in rests if i not in (1, 5)}
    assert "regexp_replace" not in out._jdf.queryExecution().toString()


def test_contaminated_rows_with_a_null_id_go(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 15)
    rows = [(None, "clean words " + item, "en"), (None, "clean words alone", "en"), (1, item, "en"), (1, "other", "en"), (2, None, "en")]
    out = P.without_benchmark(spark, docs(spark, rows), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(None, "clean words alone"), (1, "other"), (2, None)], key=str)


def test_one_of_each_group_stays(stages):
    sets = {r.doc_id: shingles(r.text) for r in stages[1]}
    label = groups([(i, i) for i in sets], lambda a, b: sets[a] and min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert {r.doc_id for r in stages[2]} == {i for i in label if label[i] == i}


def test_repeats_are_cut(stages):
    want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in brute_spans([(r.doc_id, (r.text or "").encode()) for r in stages[2]], 50)}
    got = {r.doc_id: r.text for r in stages[3]}
    for i, text in got.items():
        assert text.encode().decode() == text and len(text) - len(want[i]) in range(0, 200) and (text == want[i] or text.isascii() is False)
    assert all(not want[i].strip() for i in set(want) - set(got))


def test_contaminated_documents_go(spark, stages):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    hit = {r.doc_id for r in stages[3] for w in [words(r.text)] if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
    assert {r.doc_id for r in stages[4]} == {r.doc_id for r in stages[3]} - hit


def test_tokens_decode_to_the_texts(stages):
    texts = {r.doc_id: r.text for r in stages[4]}
    assert {r.doc_id: r.text for r in stages[5]} == texts and all(r.n_tokens == len(r.ids) for r in stages[5])


def test_run_is_the_stages_in_order(spark, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in P.run(spark, SF).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[-1])


@pytest.mark.parametrize("k", range(5))
def test_each_stage_stands_awkward_documents(spark, k):
    f = P.STAGES[k][1]
    out = f(spark, docs(spark), SF)
    assert 0 < out.count() <= len(awkward())
    if k < 4:
        assert out.columns == P.COLUMNS
    assert f(spark, empty(spark), SF).count() == 0
