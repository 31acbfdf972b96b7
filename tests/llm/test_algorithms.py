import random
from collections import Counter
from itertools import combinations
from unittest.mock import Mock

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marrow.llm import cooccur, packing, spans, splitter

# --- items that appear together --------------------------------------------------------------------------------


def brute_pairs(baskets):
    n = Counter(p for b in baskets for p in combinations(sorted(set(b)), 2))
    return n, Counter(x for b in baskets for x in set(b))


def test_pairs_by_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(30)] + ["é", "中", "z z", "A-b", "a_B"]
    rows = [(k, [rnd.choice(words) for _ in range(rnd.randint(0, 6))] + ["hot"] * (k % 3 == 0), k) for k in range(900)]
    rows += [(k, t, k) for k, t, _ in rows[:100]] + [(5000, None, 0), (5001, [None, "", " - "], 0), (None, ["x"], 0), (7, ["old"], -1)]
    df = spark.createDataFrame(rows, "ord long, tags array<string>, v long").withColumnRenamed("v", "loaded_at").selectExpr("ord", "tags", "timestamp_seconds(loaded_at) AS loaded_at", "1 AS item_a", "2 AS n")
    key = lambda t: "-".join(x for x in t.lower().replace("_", " ").replace("-", " ").split() if x)
    baskets = {k: {key(x) for x in t} for k, t, _ in rows[:900]}
    both, one = brute_pairs(baskets.values())
    got = {(r["item_a"], r["item_b"]): r for r in cooccur.together(df).collect()}
    assert {k: r["n_ab"] for k, r in got.items()} == {k: n for k, n in both.items() if n >= 5}
    r = got[("a-b", "hot")]
    assert (r["n_a"], r["n_b"], r["n"]) == (one["a-b"], one["hot"], 902) and abs(r["lift"] - r["n_ab"] * 902 / (r["n_a"] * r["n_b"])) < 1e-9
    often = {(r["item_a"], r["item_b"]) for r in cooccur.unusually_often(df).collect()}
    assert often == {k for k, n in both.items() if n >= 5 and n * 902 >= 3 * one[k[0]] * one[k[1]]}
    assert cooccur.together(df.limit(0)).count() == 0


def test_gram_in_slices(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "SLICE", 50)
    record, item = np.repeat(np.arange(20), 15), np.tile(np.arange(15), 20)
    total = Counter()
    for k, n in cooccur._gram_of_block(record, item, 100):
        total.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
    assert total == Counter({a * 100 + b: 20 for a in range(15) for b in range(a, 15)})
    big = spark.createDataFrame([([f"x{k:04d}" for k in range(600)],)] * 3, "items array<string>")
    assert cooccur.gram(big).where("n = 3").count() == 600 * 601 // 2 + 1


def test_gram_passed_on_within_a_batch(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [[f"v{k:03d}" for k in rnd.sample(range(200), 40)] for _ in range(60)]
    both, one = brute_pairs(rows)
    want = {(None, None): 60} | dict(both) | {(x, x): n for x, n in one.items()}
    runs = []
    baskets = Mock()
    baskets.mapInArrow.side_effect = lambda run, schema: runs.append(run) or Mock()
    cooccur.gram(baskets)
    monkeypatch.setattr(cooccur, "SLICE", 500)
    monkeypatch.setattr(cooccur, "KEPT", 2000)
    for size in (7, 60):  # several batches of several slices, and one
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + size])], names=["items"]) for k in range(0, 60, size)]
        got, n_batches = Counter(), 0
        for out in runs[0](iter(batches)):
            n_batches += 1
            for r in out.to_pylist():
                got[(r["item_a"], r["item_b"])] += r["n"]
        assert n_batches > 3 and got == want


# --- splitting -------------------------------------------------------------------------------------------------


def check_pieces(text, limit, overlap, got):
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in got)
    assert all(x[1] - y[0] == overlap for x, y in zip(got, got[1:]))
    assert all(y[1] > x[1] for x, y in zip(got, got[1:]))


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab .\n#-`é中\r"), max_size=400), st.integers(10, 60), st.sampled_from(["a.md", "a.go", "a.csv", None]))
def test_pieces_rebuild_the_text(text, limit, path):
    overlap = limit // 5
    got = splitter.pieces(text, splitter.kind_of(path), limit, overlap)
    check_pieces(text, limit, overlap, got)
    assert "".join(text[a + (overlap if k else 0) : b] for k, (a, b, _) in enumerate(got)) == text


def test_natural_boundaries():
    para = "Word word word. " * 6
    text = "\n\n".join([para.strip()] * 8)
    got = splitter.pieces(text, "prose", 250, 20)
    assert {n for *_, n in got[:-1]} == {"paragraph"}
    assert {n for *_, n in splitter.pieces("x" * 1000, "prose", 100, 10)[:-1]} == {"hard"}
    code = "def f():\n    a = 1\n    b = 2\n\n" * 20
    assert {n for *_, n in splitter.pieces(code, "code", 100, 10)[:-1]} == {"declaration"}
    assert {n for *_, n in splitter.pieces("a,b,c\n" * 100, "lines", 50, 5)[:-1]} == {"line"}
    fenced = "# One\n\n```\n" + "# no heading\n\ncode\n\n" * 6 + "```\n\n# Two\n\n" + para
    cut = [b for _, b, n in splitter.pieces(fenced, "prose", 200, 5) if n in ("heading", "paragraph")]
    assert all(b <= 10 or b >= fenced.index("```\n\n# Two") for b in cut)
    crlf = "x" * 99 + "\r\n" + "y" * 300
    assert all(crlf[b - 1 : b + 1] != "\r\n" for _, b, _ in splitter.pieces(crlf, "prose", 100, 10))
    with pytest.raises(ValueError):
        splitter.pieces("x" * 99, "prose", 10, 5)


def test_boundaries_take_linear_time():
    import time

    texts = ["\n" * 200_000, " \n" * 200_000, "x\n" + "\t\r\n" * 200_000 + "y", "." * 400_000, "`" * 400_000, "\u3000" * 400_000]
    began = time.perf_counter()
    for text in texts:
        for kind in ("prose", "code", "lines"):
            splitter.boundaries(text, kind)
    assert time.perf_counter() - began < 10
    text = "a\n\n\n  b\nc\n \t\r\n}\n\nd"
    assert [[int(k) for k in at] for name, at in splitter.boundaries(text, "code")[:2]] == [[len(text) - 1], [4, 14, 17]]


def test_a_natural_cut_comes_before_a_hard_one():
    got = splitter.pieces("heading of it\n" + "x" * 300, "prose", 100, 5)
    assert got[0] == (0, 14, "line") and {n for *_, n in got[1:-1]} == {"hard"}


def test_only_the_latest_delivery_is_cut(spark):
    rows = [(1, "a " * 100, 1), (1, "b " * 200, 3), (1, "c " * 300, 2), (2, "old " * 100, 1), (2, "short", 2), (3, "x " * 100, None), (3, "y " * 100, 0), (4, "late " * 50, 5), (4, None, 1)]
    df = spark.createDataFrame(rows, "ord long, content string, v long").selectExpr("ord", "content", "NULL AS file_path", "timestamp_seconds(v) AS loaded_at")
    got = splitter.split_oversized(df, 100, 10, text=True).collect()
    assert {r["ord"]: r["piece"][0] for r in got} == {1: "b", 3: "y", 4: "l"} or {r["ord"] for r in got} == {1, 3, 4}
    assert {c for r in got for c in r["piece"] if r["ord"] == 1} == {"b", " "} and sum(1 for r in got if r["ord"] == 1 and r["piece_no"] == 0) == 1
    assert {r["ord"] for r in splitter.split_oversized(df, 100, 10).collect()} == {1, 3, 4}


def test_split_table(spark):
    rows = [(1, "w " * 300, "a.md", "v"), (1, "w " * 300, "a.md", "v"), (2, "short", "a.md", ""), (3, None, None, ""), (4, "", "", ""), (5, "x" * 100, None, ""), (6, "x" * 101, None, ""), (None, "x" * 500, None, ""), (7, "é" * 200_000, "b.go", "")]
    df = spark.createDataFrame(rows, "ord long, content string, file_path string, piece string")
    got = splitter.split_oversized(df, 100, 20, text=True)
    assert {r["ord"] for r in got.select("ord").collect()} == {1, 6, 7}
    one = sorted(((r["piece_no"], r["start"], r["length"], r["piece"]) for r in got.where("ord = 1").collect()))
    assert [r[0] for r in one] == list(range(len(one))) and all(p == ("w " * 300)[a : a + n] for _, a, n, p in one)
    assert splitter.split_oversized(df, 100, 20, only_oversized=False).select("ord").distinct().count() == 5
    assert splitter.split_oversized(df.limit(0), 100, 20).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_packs_everything(sizes):
    have = Counter(sizes)
    used = Counter()
    for f in packing.plan(dict(have), 40):
        assert sum(s * k for s, k in f.sizes) <= 40 and f.times > 0
        for s, k in f.sizes:
            used[s] += k * f.times
    assert used == have


def test_exact_complements_are_found_whenever_they_exist():
    have = np.ones(1002, np.int64)
    index = packing._Sums(have)
    have[:] = 0
    have[402:801:2] = have[101] = 1  # 151 first sizes are in vain
    assert sum(index.exact(1001, Counter()) or ()) == 1001
    rnd = random.Random(4)
    for _ in range(200):
        have = np.array([0] + [rnd.choice((1, 2, 3)) for _ in range(200)])
        index = packing._Sums(have)
        kept = set(rnd.sample(range(1, 201), rnd.randint(1, 12)))
        have[[k for k in range(201) if k not in kept]] = 0
        held = Counter({max(kept): 1})
        gap = rnd.randint(1, 200)
        left = [s for s in sorted(kept) for _ in range(int(have[s]) - held[s])]
        got = index.exact(gap, held)
        assert (got is not None) == any(sum(c) == gap for n in (1, 2, 3) for c in combinations(left, n))
        assert got is None or sum(got) == gap and not Counter(got) - Counter(left)


def test_plan_is_tight():
    rnd = random.Random(2)
    sizes = Counter(min(2048, int(rnd.lognormvariate(5.5, 1)) + 1) for _ in range(20_000))
    containers = sum(f.times for f in packing.plan(dict(sizes), 2048))
    assert containers <= -(-sum(s * n for s, n in sizes.items()) // 2048) * 1.002 + 1


def test_pack_table(spark):
    rows = [(k, n, "x") for k, n in enumerate([0, None, 5, 5, 10, 11, 25, 7, 3] + [4] * 3000)]
    rows.append((2, 5, "repeated"))
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, size string")
    got = packing.pack(df, 10).collect()
    fill, per_doc = Counter(), Counter()
    for r in got:
        fill[r["container"]] += r["size"]
        per_doc[r["doc_id"]] += r["size"]
        assert r["first_unit"] == r["part"] * 10
    assert max(fill.values()) <= 10
    want = Counter()
    for k, n, _ in rows:
        want[k] += n or 0
    assert per_doc == want
    assert Counter(r["doc_id"] for r in got)[6] == 3 and Counter(r["doc_id"] for r in got)[5] == 2 and all(n == 1 for k, n in Counter(r["doc_id"] for r in got).items() if k not in (2, 5, 6))
    assert {r["container"] for r in got if r["size"] == 0} == {0}
    again = packing.pack(df.repartition(7), 10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    empty = packing.pack(df.limit(0), 10)
    assert empty.count() == 0 and packing.fill_report(empty, 10).first()["containers"] == 0
    assert packing.fill_report(packing.pack(df, 10), 10).first()["most"] <= 10


# --- spans -----------------------------------------------------------------------------------------------------


def brute_spans(texts, least):
    where = {}
    for d, t in texts:
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(d)
    out = {}
    for d, t in texts:
        starts = [i for i in range(len(t or "") - least + 1) if len(where[t[i : i + least]]) > 1]
        runs = []
        for i in starts:
            if runs and i <= runs[-1][1] + 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        out.setdefault(d, set()).update((a, b - a + least) for a, b in runs)
    return {(d, a, n) for d, s in out.items() for a, n in s}


def test_spans_by_brute_force(spark):
    rnd = random.Random(3)
    letters = "abcdefgé中 "
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    common = [word(20), word(21), word(60), word(400), "=" * 90]
    texts = []
    for d in range(60):
        parts = [word(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            c = rnd.choice(common)
            a = rnd.randint(0, max(0, len(c) - 19))
            parts += [c[a : a + rnd.randint(15, 80)], word(rnd.randint(0, 40))]
        texts.append((d, "".join(parts)))
    texts += [(100, texts[5][1]), (101, texts[5][1]), (102, None), (103, ""), (104, "short"), (105, word(30) * 2), (106, word(20)), (107, common[0]), (108, "x" + common[0]), (109, common[0][:19])]
    df = spark.createDataFrame([(d, t, 0) for d, t in texts], "doc_id long, text string, doc long")
    got = {(r["doc_id"], r["span_start"], r["span_length"]) for r in spans.shared_spans(df, 20).collect()}
    assert got == brute_spans(texts, 20)
    assert {r["doc_id"] for r in spans.shared_documents(df, 20).collect()} == {d for d, *_ in got}
    share = {r["doc_id"]: r for r in spans.shared_share(df, 20).collect()}
    assert len(share) == len(texts) and share[102]["shared_share"] == 0 and share[107]["shared_share"] == 1
    covered = {}
    for d, a, n in got:
        covered.setdefault(d, set()).update(range(a, a + n))
    assert {d: r["shared_chars"] for d, r in share.items() if r["shared_chars"]} == {d: len(s) for d, s in covered.items()}


def test_strong_keys():
    rnd = np.random.default_rng(7)
    chars = np.r_[rnd.integers(0, 0x110000, 3000), np.full(2000, 97)].astype(np.uint32)
    start = np.arange(len(chars) - 49)
    got = spans.strong(chars, start, 50)
    c = [[int(x) for x in row] for row in spans._coefficients[50]]
    for at in (0, 17, 4200, 4950):
        sums = [(c[0][k] + sum(int(chars[at + i]) * c[i + 1][k] for i in range(50))) % (1 << 64) for k in (0, 1)]
        assert int(got[at]) == sums[0] >> 32 | sums[1] >> 32 << 32
    assert len(np.unique(got)) == 3001 and np.array_equal(spans.strong(chars, start[::-1], 50)[::-1], got)
    assert len(spans.strong(chars, start[:0], 50)) == 0


def test_spans_of_repetitive_texts(spark):
    runs = [(1, "=" * 700), (2, "x" + "=" * 650), (3, "ab" * 400 + "z"), (4, "q" + "ab" * 300), (5, "=" * 150), (6, "abc" * 90), (7, "-" * 500)]
    df = spark.createDataFrame(runs, "doc_id long, text string")
    got = {(r["doc_id"], r["span_start"], r["span_length"]) for r in spans.shared_spans(df).collect()}
    assert got == brute_spans(runs, 200)


def test_spans_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a" * 500), (1, "a" * 500)], "doc_id long, text string")
    assert spans.shared_spans(df.limit(0)).count() == 0
    assert spans.shared_documents(df).count() == 0  # one record, however often it is there
    both = df.unionByName(spark.createDataFrame([(2, "b" + "a" * 200), (3, "c" + "a" * 199), (4, None)], "doc_id long, text string"))
    assert sorted(map(tuple, spans.shared_spans(both).collect())) == [(1, 0, 500), (2, 1, 200)]


def test_anchors_of_long_texts(monkeypatch):
    rnd = np.random.default_rng(1)
    chars = rnd.integers(97, 100, 5000).astype(np.uint32)
    whole = spans.anchors(chars, 20)
    monkeypatch.setattr(spans, "_PIECE", 700)
    parts = spans.anchors(chars, 20)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and whole[2].sum() == 5000 - 19
