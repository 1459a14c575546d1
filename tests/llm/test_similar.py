import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgrain.llm import decontaminate, embedding_dedup, jaccard_join, suffix_dedup
from siftgrain.llm.store import only_ids, without_ids
from siftgrain.llm.suffix_array import maximal_repeats
from tests.llm.helpers import DATA, awkward, docs, empty, prose, thue_morse


def shingles(text, n=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, similar):
    label = {i: i for i in {i for i, _ in rows}}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(rows) for b, y in rows[:k] if a != b and similar(x, y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def edited(words, share, r):
    out = list(words)
    for _ in range(int(len(out) * share)):
        out[r.randrange(len(out))] = f"w{r.randrange(10**6)}"
    return " ".join(out)


def corpus():
    """Copies with more and more edits, around the threshold, of texts of many sizes."""
    r, rows = random.Random(4), []
    for size in (1, 3, 5, 6, 9, 14, 30, 70, 150, 400, 1500):
        base = prose(size, size).split()
        rows += [edited(base, share, r) for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1)]
        rows += [" ".join(base[k:]) for k in range(0, min(size // 5 + 1, 8))]
    hot = prose(60, 99).split()
    rows += [edited(hot, 0.035, r) for _ in range(60)]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_jaccard_join_loses_no_link(spark):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    want = groups([(i, i) for i, _ in rows], lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i, _ in rows}


def test_jaccard_join_is_its_sql(spark, same):
    same(jaccard_join.query(spark, DATA), jaccard_join.SQL)


def test_segments_of_pairs_at_the_threshold_share_a_content():
    from fractions import Fraction

    r, t, plans = np.random.default_rng(3), Fraction(4, 5), {}
    for size in (1, 2, 4, 5, 8, 9, 20, 63, 64, 127, 128, 500, 1023, 1024, 3000):
        for _ in range(12):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            for drop, add in ((0, 0), (size // 5, 0), (0, size // 4), (size // 10, size // 10)):
                b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, add, dtype=np.uint64)]))
                both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 5 * both >= 4 * union:
                    common = np.isin(a, r.permutation(a)[: size // 3])
                    rare_b = ~np.isin(b, a[common])
                    ka, kb = jaccard_join.index_keys(a, ~common, t, plans), jaccard_join.index_keys(b, rare_b, t, plans)
                    assert len(np.intersect1d(ka, kb)), (size, drop, add)
                    d = np.bitwise_count(fold(jaccard_join.sketch(a), jaccard_join.sketch(b))).sum()
                    assert d <= union - both


def fold(a, b):
    a, b = a.view(np.uint64), b.view(np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return a ^ b


def test_jaccard_join_of_awkward_documents(spark):
    rows = jaccard_join.similar_groups(docs(spark)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == len(awkward())
    assert got[2][1] == 1 and got[3][1] == 1 and got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6) and got[8] == (1, 7) and got[None][1] is None
    assert jaccard_join.similar_groups(empty(spark)).count() == 0


def check_groups(spark, rows):
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    want = groups([(k, k) for k in sets], lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    least = {}
    for k, label in want.items():
        least[label] = min(least.get(label, rows[k][0]), rows[k][0])
    got = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(sets[k]), least[want[k]]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_words_do_not_collide(spark, size):
    a, b = thue_morse(size)
    check_groups(spark, [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, f"{a} {b}"), (6, b)])
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    rows = decontaminate.contamination(spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}")], "doc_id long, text string"), items).collect()
    assert {r.doc_id: r.n_hit for r in rows} == {1: 1, 2: 0, 3: 1}


def test_exact_sets_are_sets_of_words():
    r = random.Random(3)
    texts = [" ".join(r.choice("ab") * r.randint(1, 2) for _ in range(r.randint(0, 40))) for _ in range(60)] + [thue_morse(2048)[0], thue_morse(2048)[1], "A b", "a B"]
    raw = [t.encode() for t in texts]
    got = jaccard_join.exact_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), 5)
    for i, x in enumerate(texts):
        for j, y in enumerate(texts[:i]):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(x) & shingles(y))
        assert len(got[i]) == len(shingles(x))


def test_rows_of_one_id_and_different_texts(spark):
    x, y, z = prose(40, 1), prose(40, 2), prose(40, 3)
    check_groups(spark, [(1, x), (1, y), (2, y), (3, x), (3, z), (4, z), (5, None), (5, prose(9, 9)), (5, prose(9, 9)), (-7, z)])


def test_a_content_of_many_records(spark, monkeypatch):
    # small blocks: near copies in many, a component of its own, and some that a boilerplate alone brings together
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    r = random.Random(6)
    hot, other = prose(120, 71).split(), prose(120, 72).split()
    rows = [edited(hot, 0.03, r) for _ in range(90)] + [edited(hot[:95] + other[95:], 0.03, r) for _ in range(40)] + [edited(other, 0.05, r) for _ in range(40)]
    rows += [" ".join(hot[:60]) + " " + prose(60, 500 + k) for k in range(40)] + [" ".join(hot)] * 30
    r.shuffle(rows)
    check_groups(spark, list(enumerate(rows)))


def test_thresholds_below_a_half_are_refused(spark):
    with pytest.raises(ValueError):
        jaccard_join.similar_groups(spark.range(1).selectExpr("id AS doc_id", "'a' AS text"), threshold=0.4)


def brute_spans(rows, w):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        for k in range(len(t) - w + 1):
            first.setdefault(t[k : k + w], i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - w + 1 if i is not None else 0):
            if first[t[k : k + w]] < i:
                gone[k : k + w] = True
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


def removed(df, **options):
    rows = suffix_dedup.remove_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), bytes(r.kept)) for r in rows), key=str)


@pytest.mark.parametrize("hot", [1, 2, 4096])
def test_repeats_are_those_of_brute_force(spark, hot):
    r = random.Random(8)
    passage = prose(70, 7)
    rows = [(i, f"{prose(r.randint(0, 60), i)} {passage[r.randint(0, 99):]} {prose(r.randint(0, 30), -i)}" if i % 3 else prose(40, i // 6)) for i in range(60)]
    rows += [(100, "ab" * 200), (101, "ab" * 100 + "c"), (102, "ba" * 60), (103, "é" * 80), (104, "xé" + "é" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removed(df, hot_contexts=hot) == brute_spans([(i, t.encode()) for i, t in rows], 50)


def test_hot_anchors_at_default_settings(spark):
    passage = prose(12, 7)[:64]
    rows = [(i, f"{prose(4, i)} {passage} {prose(4, 10_000 + i)}".encode()) for i in range(2600)]
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    h, row, first, last = suffix_dedup._anchors(data, at, 50, suffix_dedup.GRAM)
    back = suffix_dedup._by_hash(h, row, 1)[3]
    assert suffix_dedup._different(data, back, first, last, 50).max() >= suffix_dedup.HOT_CONTEXTS
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    assert removed(df) == brute_spans(rows, 50)


def test_a_text_in_pieces(spark, monkeypatch):
    text = prose(2000, 5)
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(data)])
    whole = suffix_dedup._anchors(data, at, 50, 20)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 700)
    pieces = suffix_dedup._anchors(data, at, 50, 20)
    of = lambda x: [(int(h), int(s)) for h, _, a, b in zip(*x, strict=True) for s in range(a, b + 1)]
    assert of(whole) == of(pieces) and len(of(whole)) == len(data) - 49


def test_anchors_are_hashed_in_pieces_that_a_cache_holds(monkeypatch):
    """Each byte has 8 bytes of hashes that are gone over a dozen times; half a MB of them stays in a core's cache."""
    seen, hashes = [], suffix_dedup.K.rolling_hash
    monkeypatch.setattr(suffix_dedup.K, "rolling_hash", lambda data, size: seen.append(len(data)) or hashes(data, size))
    texts = [prose(n, k % 40).encode() for k, n in enumerate([0, 1, 9, 30, 400] * 40 + [30_000])]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, row, first, last = suffix_dedup._anchors(data, at, 50, 20)
    assert len(data) > 1 << 18 and max(seen) <= 1 << 16
    # every string of a row has an anchor, and equal strings have equal ones
    strings = [(k, s) for k, a, b in zip(row, first, last, strict=True) for s in range(a, b + 1)]
    assert strings == [(k, s) for k in range(len(texts)) for s in range(at[k], at[k + 1] - 49)]
    of = {}
    for (_, s), x in zip(strings, np.repeat(h, last - first + 1).tolist(), strict=True):
        assert of.setdefault(data[s : s + 50].tobytes(), x) == x


@pytest.mark.parametrize("hot", [2, 4096])
def test_a_unit_and_a_part_exchange_one_row(hot):
    """Rows by block and part grow with the square of the corpus; those of a unit's blocks are one."""
    passage = prose(70, 7)
    texts = [(i, f"{prose(30, i)} {passage[i % 90 :]} {prose(20, i // 9)}".encode()) for i in range(96)]
    blocks, parts, shares = [], 5, 3
    for k in range(0, 96, 8):
        own = [t for _, t in texts[k : k + 8]]
        body = suffix_dedup._squeezed(np.frombuffer(b"".join(own), np.uint8))
        blocks.append({"unit": k // 48, "block": k // 8, "ids": [i for i, _ in texts[k : k + 8]], "ends": np.cumsum([len(t) for t in own]).tolist(), "body": body})
    told = list(suffix_dedup._announcements(blocks, 50, 20, parts))
    assert len(told) <= 2 * parts and max(len(r["blocks"]) for r in told) == 6
    answers = [x for p in range(parts) for x in suffix_dedup._answered([r for r in told if r["part"] == p], hot)]
    held = []
    for unit in (0, 1):
        rows = list(suffix_dedup._unit_contexts([b for b in blocks if b["unit"] == unit], [x for x in answers if x["unit"] == unit], 50, 20, parts, shares))
        assert 0 < len(rows) <= shares
        held += rows
    cuts = [r for s in range(shares) for r in suffix_dedup._grouped(suffix_dedup._spans([r for r in held if r["share"] == s], 50)).to_pylist()]
    assert len(cuts) <= 2 * shares
    got = []
    for unit in (0, 1):
        by_block = suffix_dedup._unit_cuts([c["cuts"] for c in cuts if c["unit"] == unit])
        for b in blocks:
            if b["unit"] == unit:
                out = suffix_dedup._cut(b, pa.nulls(8), by_block.get(b["block"]), False).to_pylist()
                got += [(r["id"], r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), len(r["spans"]), r["kept"]) for r in out]
    assert sorted(got, key=str) == brute_spans(texts, 50)


def test_parts_grow_before_they_become_many():
    assert [suffix_dedup._parts(n, 10) for n in (0, 35, 2560, 5120, 20_480, 204_800)] == [1, 3, 256, 256, 256, 2560]


def test_repeats_of_a_whole_table(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in brute_spans(rows, 50)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, DATA).collect()} == want


def test_repeats_are_those_of_the_sql(spark, same):
    same(suffix_dedup.query(spark, DATA), suffix_dedup.SQL)


def test_repeats_of_awkward_documents(spark):
    got = removed(docs(spark))
    want = brute_spans([(i, (t or "").encode()) for i, t, _ in awkward()], 50)
    assert got == want
    assert removed(empty(spark)) == []


def test_whole_characters_stay(spark):
    a, b = "é" * 60, "x" + "é" * 59 + "y"
    out = suffix_dedup.remove_repeats(spark.createDataFrame([(1, a, "p"), (2, b, "q")], "doc_id long, text string, source string"), carry=("source",), whole_chars=True).orderBy("doc_id").collect()
    assert bytes(out[1].kept).decode() == "xy" and [r.source for r in out] == ["p", "q"]


def test_maximal_repeats_have_all_occurrences():
    text = b"abcdefgh|xabcdefgh|yabcdefg|zz"
    data = np.frombuffer(text, np.uint8)
    order, first, last, length = maximal_repeats(data, 3, 32, np.arange(len(data)) == 0)
    found = {(bytes(data[order[f] : order[f] + n]), l - f + 1) for f, l, n in zip(first, last, length, strict=True)}
    assert (b"abcdefgh|", 2) in found and (b"abcdefg", 3) in found
    assert not any(g.startswith(b"bcdefg") for g, _ in found)


def test_decontamination_is_its_sql(spark, same):
    same(decontaminate.query(spark, DATA), decontaminate.SQL)


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    tables = [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark")]
    want = sorted(map(tuple, decontaminate.contamination(*tables).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 400)
    assert sorted(map(tuple, decontaminate.contamination(*tables).collect()), key=str) == want


def test_decontamination_of_awkward_tables(spark):
    items = spark.createDataFrame([(1, prose(30, 1)), (2, None), (3, ""), (4, "ONE"), (None, prose(40, 13)), (4, "one"), (10, prose(200, 4)[100:300])], "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = decontaminate.contamination(docs(spark), items).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in rows}
    assert len(rows) == len(awkward())
    assert got[1] == (120, 30, ["1"]) and got[7] == (1, 1, ["4"]) and got[4] == (0, 0, []) and got[13][2] == ["10"] and got[None][1] == 30
    assert decontaminate.contamination(empty(spark), items).count() == 0
    assert decontaminate.contamination(docs(spark), items.filter("false")).filter("contaminated").count() == 0


def near(words, window, slop):
    """Least spans by definition."""
    want, wide, out = set(window), len(window) + slop, set()
    for f in range(len(words)):
        for z in range(f, min(len(words), f + wide)):
            if want <= set(words[f : z + 1]):
                out.add((f, z))
                break
    return {(f, z) for f, z in out if not any(f <= g and y <= z and (f, z) != (g, y) for g, y in out)}


def test_proximity(spark):
    r = random.Random(2)
    rows = [(1, "a x b y c"), (2, "c b a"), (3, "a x x x x b c"), (4, "a b"), (5, "c q a b"), (6, None), (None, "b a c")]
    rows += [(10 + k, " ".join(r.choice("abcxyz") for _ in range(r.randint(0, 60)))) for k in range(25)]
    items = [(1, "a b c"), (2, "x a x"), (3, "y"), (4, None), (None, "a")]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, str(k), f, z) for i, t in rows for k, item in items if k and item for f, z in near((t or "").split(), item.split(), 2)}
    assert {tuple(x) for x in decontaminate.near_matches(*frames, slop=2).collect()} == want
    # a window of 10 words that stands spread over more than its length
    w = prose(10, 3).split()
    rows = [(1, " ".join(prose(20, 4).split() + w[:9] + ["q", "q"] + w[9:])), (2, " ".join(w[:9] + ["q"] * 3 + w[9:])), (3, " ".join(w[::-1]))]
    got = decontaminate.near_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string"), slop=2).collect()
    assert {(x.doc_id, x["first"], x["last"]) for x in got} == {(1, 20, 31), (3, 0, 9)}


def test_a_stored_index_answers_as_a_scan_does(spark, tmp_path):
    tables = [spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark")]
    decontaminate.write_index(tables[0], str(tmp_path / "index"))
    want = sorted(map(tuple, decontaminate.contamination(*tables).collect()), key=str)
    assert sorted(map(tuple, decontaminate.search_index(spark, str(tmp_path / "index"), tables[1]).collect()), key=str) == want


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 32))
    x = np.concatenate([x, x[:120] + 0.12 * r.standard_normal((120, 32)), x[:60] + 0.2 * r.standard_normal((60, 32)), np.repeat(x[:1], 30, 0)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {q.vec_id: q for q in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(q.n_links for q in got.values()) >= 0.98 * links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in got)
    want = groups([(i, i) for i in range(len(x))], lambda a, b: links[a, b])
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.98
    assert all(q.kept == (q.vec_id == q.component_id) for q in got.values())


def test_embeddings_blocks_and_odd_vectors(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = r.standard_normal(16)
    rows = [(i, (base + 0.02 * r.standard_normal(16)).tolist()) for i in range(700)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [float("inf")] + [1.0] * 15), (1006, [1.0] * 8), (1007, [1e300] * 16), (1008, [1.0] * 16), (None, base.tolist()), (1009, [2.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("unit", F.lit(1))
    got = {q.vec_id: q for q in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i].n_links == 699 and got[i].component_id == 0 for i in range(700))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1007))
    assert got[1007].n_links == 2 and got[1009].component_id == 1007 and got[None].component_id is None
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0


def test_ids_by_bitmap(spark):
    df = spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("gone_id", F.lit(1)).union(spark.sql("SELECT CAST(NULL AS BIGINT), 1"))
    some = spark.createDataFrame([(k,) for k in range(0, 2000, 7)], "doc_id long")
    assert only_ids(df, some, "doc_id").count() == some.count()
    left = without_ids(df, some, "doc_id")
    assert left.count() == 2001 - some.count() and left.columns == df.columns
    assert without_ids(df, some.filter("false"), "doc_id").count() == 2001
