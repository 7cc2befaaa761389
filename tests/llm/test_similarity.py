import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cubeloom.llm import decontaminate, embeddings, lines, lsh, minhash, substrings
from cubeloom.llm._common import read
from cubeloom.llm.components import components
from cubeloom.llm.licenses import words


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components(spark, one_task):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (2000, None)]
    want = Union()
    for a, b in edges:
        if b is not None and a != b:
            want.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {x: want.find(x) for x in list(want)}
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


# ---- embeddings


def embedding_rows():
    draw = np.random.default_rng(4)
    rows = []
    for i in range(300):
        base = draw.standard_normal(16)
        for _ in range(draw.integers(1, 4)):
            rows.append((len(rows), (base + draw.standard_normal(16) * draw.choice([0.05, 0.25])).tolist(), int(i % 2)))
    rows += [(len(rows) + i, rows[5][1], 0) for i in range(40)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1e300] * 16, [2e300] * 16, [1.0] * 8]
    rows += [(5000 + i, v, 0) for i, v in enumerate(odd)] + [(6000, rows[0][1], None), (None, rows[0][1], 0)]
    return rows


@pytest.mark.parametrize("cell,block", [(2000, 3000), (60, 25)])
def test_embeddings_equal_brute_force(spark, cell, block):
    rows = embedding_rows()
    sound = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, union = Counter(), Union()
    for x, (i, v, lab) in enumerate(sound):
        for j, w, other in sound[:x]:
            if lab == other and len(v) == len(w):
                a, b = v / np.abs(v).max(), w / np.abs(w).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    union.join(i, j)
    df = spark.createDataFrame([(i, v, lab, 7) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, cell=cell, block=block).collect()}
    want = {i: (links[i], union.find(i) if i is not None else None, i is not None and union.find(i) == i) for i, _, _ in rows}
    assert got == want


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- documents


def text_rows(n=90):
    draw = random.Random(5)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(3000)]
    rows = []
    for _ in range(n):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(3, 250))]
        for _ in range(draw.choice([1, 1, 2, 5])):
            own = [w if draw.random() > draw.choice([0, 0.01, 0.02, 0.05]) else draw.choice(vocabulary) for w in base]
            rows.append((len(rows), "\n".join(" ".join(own[i : i + 25]) for i in range(0, len(own), 25))))
    rows += [(1000, None), (1001, ""), (1002, "!!!"), (1003, "!!!"), (1004, "A, b"), (1005, "a b"), (1006, rows[3][1]), (1006, rows[3][1])]
    return rows


def weighted_jaccard(x, y, idf):
    a, b = ({i: c * float(idf[i & minhash.MASK]) for i, c in zip(v[0].tolist(), v[1].tolist(), strict=True)} for v in (x, y))
    low = sum(min(a[i], b[i]) for i in a.keys() & b.keys())
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute_classes(rows):
    s = [minhash.shingles((t or "").encode()) for _, t in rows]
    df = Counter(i for ids, _, _ in s for i in (ids & minhash.MASK).tolist())
    slots = np.zeros(1 << 20)
    for k, n in df.items():
        slots[k] = n
    idf = minhash.inverse_frequencies(slots, len(rows))
    u = Union()
    for x in range(len(rows)):
        u.find(x)
        for y in range(x):
            if s[x][2] == s[y][2] or (len(s[x][0]) and len(s[y][0]) and weighted_jaccard(s[x], s[y], idf) >= 0.8):
                u.join(x, y)
    first = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        first[u.find(x)].append(i)
    return Counter((rows[x][0], min(first[u.find(x)])) for x in range(len(rows)))


@pytest.mark.parametrize("most,small", [(300_000, 64), (0, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, most, small):
    monkeypatch.setattr(lsh, "SMALL", small)
    monkeypatch.setattr(lsh, "EXACT_BLOCK", 3 if small == 2 else 500)
    rows = text_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int")
    got = minhash.near_duplicates(df, most_broadcast=most).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_classes(rows)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).count() == 0
    assert lines.near_duplicate_lines(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame([(1, "some words here")], "item_id long, text string")).count() == 0


def test_samples_agree_as_often_as_weighted_jaccard():
    draw = np.random.default_rng(2)
    ids = np.unique(draw.integers(0, 1 << 32, 3000, dtype=np.uint32))
    w = draw.choice([1.0, 2.0, 5.0], len(ids)).astype(np.float32)
    got, want = [], []
    for k in range(60):
        a, b = np.sort(draw.choice(len(ids), 200, False)), None
        b = np.sort(np.concatenate([a[: 150 + k // 2], draw.choice(np.setdiff1d(np.arange(len(ids)), a), 30, False)]))
        both = np.intersect1d(a, b)
        want.append(w[both].sum() / (w[a].sum() + w[b].sum() - w[both].sum()))
        got.append((minhash.samples(ids[a], w[a]) == minhash.samples(ids[b], w[b])).mean())
    assert abs(np.mean(got) - np.mean(want)) < 0.03


def test_link_matrix_equals_pairs():
    draw = np.random.default_rng(3)
    weight = draw.choice([0.5, 1.0, 3.0], 400).astype(np.float32)
    base = np.sort(draw.choice(400, 60, False)).astype(np.uint64)
    sets = [np.unique(np.concatenate([draw.choice(base, 55, False), draw.choice(400, draw.integers(0, 12), False).astype(np.uint64)])) for _ in range(300)]
    vectors = [(v, weight[v.astype(int)]) for v in sets]
    apart = draw.random((150, 150)) < 0.9
    got = lsh.link_matrix(vectors[:150], vectors[150:], apart, 0.8)
    want = np.array([[lsh.share(a, b) >= 0.8 for b in vectors[150:]] for a in vectors[:150]]) & apart
    assert 0 < want.sum() < want.size and (got == want).all()


# ---- lines


def test_lines_equal_brute_force(spark):
    rows = [r for r in text_rows(60) if r[0] != 1006]
    flat = [(i, n, lines.level(x)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if lines.level(x)]
    sets = [set(lines.shingle_set(x).tolist()) for _, _, x in flat]
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    u = Union()
    for x in range(len(flat)):
        u.find(x)
        for y in range(x):
            if flat[x][2] == flat[y][2] or similar(sets[x], sets[y]):
                u.join(x, y)
    want = {flat[x][:2]: flat[u.find(x)][:2] for x in range(len(flat))}
    got = lines.near_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line"]): (r["class_doc_id"], r["class_line"]) for r in got} == want
    assert all(r["kept"] == ((r["doc_id"], r["line"]) == (r["class_doc_id"], r["class_line"])) for r in got)


@pytest.mark.parametrize("hot,entries", [(64, 1 << 19), (4, 300)])
def test_shared_buckets_equal_a_plain_count(spark, monkeypatch, hot, entries):
    """Every entry of every bucket that items share, also of buckets that most items share."""
    monkeypatch.setattr(lsh, "ENTRIES", entries)
    monkeypatch.setattr(lsh, "HOT", hot)
    draw = np.random.default_rng(5)
    sigs = draw.integers(0, 12, (700, 9)).astype(np.uint16)
    sigs[:300, :3] = 7  # a bucket of very many
    sigs[200:320, 3:6] = 8
    items = [(1_000 - i if i % 2 else -i, sigs[i].tobytes()) for i in range(700)]
    items += items[:250]  # items may come several times
    members = defaultdict(set)
    for k, sig in items:
        for band in range(3):
            members[band, sig[6 * band : 6 * band + 6]].add(k)
    want = Counter((min(ks), k) for ks in members.values() if len(ks) > 1 for k in ks)
    table = lsh.shared_buckets(spark.createDataFrame(items, "k long, sig binary").repartition(3), 3)
    got = table.collect()
    assert Counter((r["first"], r["k"]) for r in got) == want and len({r["bucket"] for r in got}) == sum(len(ks) > 1 for ks in members.values())
    assert lsh.shared_buckets(spark.createDataFrame([], "k long, sig binary"), 3).count() == 0


def shuffled_records(spark, run):
    """Records that all stages of run write to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        seen = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (seen.apply(i) for i in range(seen.size()))}

    before = max(stages(), default=-1)
    run()
    return sum(n for stage, n in stages().items() if stage > before)


def test_lines_do_not_shuffle_a_row_for_each_band(spark):
    draw = random.Random(8)
    rows = [(i, "\n".join("".join(draw.choices("abcdefgh", k=40)) for _ in range(40))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert shuffled_records(spark, lambda: lines.near_duplicate_lines(docs).collect()) < 4_000 * lines.BANDS


# ---- benchmark


def test_leaks(spark):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("klmnopqr") for _ in range(draw.randint(3, 8))) for _ in range(4000)]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(draw.randint(15, 60))) + ". " + " ".join(say(6)) + ".") for i in range(40)] + [(90, None), (91, "")]
    rows, want = [], set()
    for d in range(120):
        text = say(draw.randint(20, 400))
        if d % 3 == 0:
            i, item = items[d // 3]
            ws = item.split()
            if d % 2:  # a paraphrase: some words change
                ws = [w if draw.random() > 0.15 else draw.choice(vocabulary) for w in ws]
            at = draw.randrange(len(text))
            text[at:at] = ws
            want.add((d, i))
        rows.append((d, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "word " * 30_000)]
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert {r["doc_id"] for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def planted(draw, items, docs, share):
    """Documents of rare words, `share` of which hold an item word for word."""
    rows = []
    for d in range(docs):
        text = [f"w{draw.randrange(60_000)}" for _ in range(draw.randint(60, 200))]
        if draw.random() < share:
            at = draw.randrange(len(text))
            text[at:at] = draw.choice(items)[1].split()
        rows.append((d, " ".join(text)))
    return rows


def compared(rows, items):
    """Pairs by comparing every stretch of every document with every item."""
    want = set()
    common, masks = decontaminate.common_subsequence, decontaminate._masks
    for i, item in items:
        ws = words(item.encode())
        m, answer = len(ws), decontaminate.answer_length(item, len(ws))
        whole, tail, need = masks(ws), masks(ws[m - answer :]), 0.6 if m >= 10 else 0.9
        for d, text in rows:
            doc = words(text.encode())
            parts = (doc[at : at + m + m // 4 + 4] for at in range(len(doc)))
            if any(common(whole, p, m) >= need * m and common(tail, p, answer) >= 0.5 * answer for p in parts if sum(w in whole for w in p) >= need * m):
                want.add((d, i))
    return want


def leak_pairs(spark, rows, items):
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_short_items_in_many_documents(spark):
    draw = random.Random(8)
    for size in (14, 18, 23, 6):
        items = [(0, " ".join(f"i{draw.randrange(5_000)}" for _ in range(size)))]
        rows = planted(draw, items, 150, 0.33)
        want = compared(rows, items)
        assert len(want) > 30 and leak_pairs(spark, rows, items) == want


def test_long_items(spark):
    draw = random.Random(10)
    items = [(i, " ".join(f"i{draw.randrange(5_000)}" for _ in range(size))) for i, size in enumerate((110, 150, 200, 400))]
    rows = planted(draw, items, 60, 0.5)
    want = compared(rows, items)
    assert {i for _, i in want} == {0, 1, 2, 3} and leak_pairs(spark, rows, items) == want


def test_long_items_are_close_in_the_latent_space(spark, monkeypatch):
    made = decontaminate.Held.__init__

    def without(self, *args):
        made(self, *args)
        self.least = self.least * 1_000_000  # finds nothing, in the workers too

    monkeypatch.setattr(decontaminate.Held, "__init__", without)
    draw = random.Random(10)
    items = [(i, " ".join(f"i{draw.randrange(5_000)}" for _ in range(size))) for i, size in enumerate((150, 400))]
    rows = planted(draw, items, 60, 0.5)
    assert leak_pairs(spark, rows, items) == compared(rows, items)


def test_leaks_equal_a_full_comparison(spark, small):
    draw = random.Random(9)
    vocabulary = [f"v{int(draw.paretovariate(0.6))}" for _ in range(3_000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(3, 70))) + ". " + " ".join(draw.choice(vocabulary) for _ in range(4))) for i in range(25)]
    rows = []
    for d in range(150):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(0, 300))]
        ws = [x for w in draw.choice(items)[1].split() for x in ([w] if draw.random() < 0.7 else draw.choice([[], [draw.choice(vocabulary)], [w, draw.choice(vocabulary)]]))]
        at = draw.randint(0, len(text))
        text[at:at] = ws
        rows.append((d, " ".join(text)))
    want = compared(rows, items)
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 60 and {(r["doc_id"], r["item_id"]) for r in found if r["cover"] is None} == want
    whole = dict(rows)
    for r in found:  # what is no copy holds most of the item in some order
        if r["cover"] is not None:
            least_cosine, least_cover, least_order, least_answer = decontaminate.PARAPHRASE
            assert r["cosine"] >= least_cosine and r["cover"] >= least_cover and r["overlap"] >= least_order and r["answer"] >= least_answer
            assert len(set(words(items[r["item_id"]][1].encode())) & set(words(whole[r["doc_id"]].encode()))) > 3


def test_paraphrases(spark):
    """Items with their parts in another order and other words in places: at least nine in ten are found, by the latent space."""
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("klmnopqr") for _ in range(draw.randint(3, 8))) for _ in range(4000)]
    say = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(draw.randint(20, 50))) + ". " + " ".join(say(6)) + ".") for i in range(40)]
    rows, want = [], set()
    for d in range(300):
        text = say(draw.randint(40, 300))
        if d % 2:
            i, item = items[draw.randrange(40)]
            ws, n = item.replace(".", "").split(), draw.randint(3, 5)
            parts = [ws[len(ws) * k // n : len(ws) * (k + 1) // n] for k in range(n)]
            draw.shuffle(parts)
            at = draw.randrange(len(text))
            text[at:at] = [w if draw.random() > 0.1 else draw.choice(vocabulary) for p in parts for w in p]
            want.add((d, i))
        rows.append((d, " ".join(text)))
    found = leak_pairs(spark, rows, items)
    assert len(want & found) >= 0.9 * len(want) > 100 and found <= want
    assert len(want & compared(rows, items)) < 0.8 * len(want)


def test_verbatim_items_are_found(spark, small):
    docs, items = read(spark, small, "documents"), read(spark, small, "benchmark")
    spaced = {r["doc_id"]: b" " + b" ".join(words((r["text"] or "").encode())) + b" " for r in docs.collect()}
    want = {(d, r["item_id"]) for r in items.collect() for d, t in spaced.items() if b" " + b" ".join(words(r["text"].encode())) + b" " in t}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}


def test_subsequence_bits():
    draw = random.Random(1)
    for _ in range(200):
        a, b = [[draw.choice("abcd") for _ in range(draw.randint(1, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate._masks(a), b, len(a)) == table[-1][-1]


# ---- substrings


def brute_repeats(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeat_rows():
    draw = random.Random(6)
    say = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    passages = [say(n) for n in (399, 400, 401, 900, 3000)]
    rows = []
    for i in range(60):
        text = say(draw.randint(0, 900))
        for _ in range(draw.choice([0, 1, 2])):
            p = draw.choice(passages)
            a = draw.randrange(len(p) // 2)
            text += (p if draw.random() < 0.6 else p[a : a + draw.randint(350, 700)]) + say(draw.randint(0, 500))
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, "ab" * 700), (103, "z" * 1500), (104, "ha " * 133), (105, rows[4][1]), (105, rows[4][1]), (106, passages[4][:1000] * 2), (107, say(270_000) + passages[3])]
    return rows


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows()
    df = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, h binary")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(df).collect())
    assert got == brute_repeats(rows, 400)


# ---- odd tables


def test_vectors_without_names_or_with_others(spark):
    rows = [(None, [1.0, 0.0], 1, 9), (None, [1.0, 0.0], 1, 9), (3, [1.0, 0.0], 1, 9), (4, [1.0, 0.01], 1, 9), (5, [1.0, 0.0], None, 9), (6, None, 1, 9)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, root int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [("3", 1, "3", True), ("4", 1, "3", False), ("5", 0, "5", True), ("6", 0, "6", True), ("None", 0, "None", False), ("None", 0, "None", False)]


def test_repeats_of_documents_with_text_names(spark):
    rows = [("a", "x" * 50 + "".join(chr(97 + i % 26) for i in range(500))), ("b", "".join(chr(97 + i % 26) for i in range(500)) + "y"), ("c", "short"), (None, None)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (550, 500), "b": (501, 500), "c": (5, 0), None: (0, 0)}


def test_leaks_of_odd_tables(spark):
    item = " ".join(f"w{i}" for i in range(20)) + ". the answer is w3 w4 w5."
    rows = [(1, "before " + item, 5, "x"), (1, item, 5, "x"), (1, "nothing here", 6, "y"), (None, item, 7, "z"), (2, "nothing there", 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, words string")
    items = spark.createDataFrame([(7, item, "a"), (8, item, "b"), (8, item, "b"), (None, None, "c")], "item_id long, text string, doc_id string")
    got = decontaminate.leaks(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("1", 7), ("1", 8), ("None", 7), ("None", 8)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]


def shuffled_rows(df):
    """Rows that the plan of df, which was run, sent through its shuffles."""

    def below(node):
        kind = node.getClass().getSimpleName()
        n = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        children = node.children()
        return n + sum(map(below, inner + [children.apply(i) for i in range(children.size())]))

    return below(df._jdf.queryExecution().executedPlan())


def test_leaks_shuffle_only_documents_with_candidates(spark):
    draw = random.Random(3)
    items = [(i, " ".join(f"i{draw.randrange(5_000)}" for _ in range(30))) for i in range(5)]
    rows = planted(draw, items, 1_500, 0.02) + [(None, items[0][1]), (7, items[1][1]), (7, "none of these"), (9_000, None)]
    want = compared([r for r in rows if r[0] is not None and r[1]], items) | {(None, 0)}
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = decontaminate.leaks(docs, tests, most_broadcast=0)
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and sorted(map(str, got)) == sorted(map(str, decontaminate.leaks(docs, tests).collect()))
    assert 0 < shuffled_rows(found) < 750
