"""The corpus operators against brute force, on small fixtures with the awkward cases in them."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from conftest import DATA
from pyspark.sql import functions as F
from test_catalog import canon

from graphloom.llm import ann, bpe, chat, common, decontaminate, langid, ngram_join, queries, substring_dedup, token_frames, toxicity, urlfilter
from graphloom.llm.components import components

DOCS = "doc_id long, text string, group_id string, n_chars long"


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Ids and texts with copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(4)
    passage = words(rng, 70, 10**6)
    texts = [words(rng, rng.randrange(60, 160)) for _ in range(30)]
    texts += [texts[0], texts[0] + " end", texts[1].replace("w1", "v1")]
    texts += [f"{words(rng, 150)} {passage} {words(rng, 150)}" for _ in range(4)]
    texts += [words(rng, 6000), "", None, "one", "one", "   ", "of " * 300]
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5])]
    return [(i, t, "clash", len(t) if t is not None else None) for i, t in rows]


def make(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, oracle, name):
    df = queries.queries()[name](spark, str(DATA))
    want = oracle.sql(queries.oracle_sql()[name])
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(None, 3), (4, 4)]
    label = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}
    for _ in range(60):
        for a, b in pairs:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows, n=50):
    first, cover = {}, {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}):
        w = substring_dedup.VISIBLE.findall(t)
        for k in range(len(w) - n + 1):
            if first.setdefault(tuple(w[k : k + n]), i) < i:
                cover.setdefault(i, set()).update(range(k, k + n))
    return cover


def test_substring_dedup(spark, corpus):
    docs = make(spark, corpus)
    found = substring_dedup.repeats(docs)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).update(range(r["begin"], r["end"]))
    want = brute_spans(corpus)
    assert got == want and len(want) >= 4
    cut = substring_dedup.cut(docs, found)
    assert cut.columns == docs.columns and cut.count() == len(corpus)
    for r in cut.collect():
        if r["doc_id"] in want and r["text"] is not None:
            full = substring_dedup.VISIBLE.findall(next(t for i, t, *_ in corpus if i == r["doc_id"]))
            assert substring_dedup.VISIBLE.findall(r["text"]) == [w for k, w in enumerate(full) if k not in want[r["doc_id"]]]
            assert r["n_chars"] == len(r["text"])
    assert substring_dedup.repeats(make(spark, [])).count() == 0
    assert substring_dedup.choose_bands(1.0, 0.99) == 1 and substring_dedup.choose_bands(0.8, 0.99) == 3


def test_substring_dedup_edited(spark):
    """Lines with a word in every few changed keep no run of 50 words; held against the Jaccard of all pairs."""
    rng = random.Random(8)
    rows, doc = [], 0
    for step in (9, 13, 17, 21, 25, 30, 40):
        line = words(rng, 120, 10**6).split()
        for shift in range(3):
            new = [f"x{rng.randrange(10**6)}" if k % step == shift else w for k, w in enumerate(line)]
            rows.append((doc, f"{words(rng, 60)}\n{' '.join(new)}\nshort end"))
            doc += 1
    rows += [(doc, rows[3][1]), (doc + 1, f"{rows[6][1]}\n{rows[6][1]}"), (None, rows[0][1]), (doc + 2, "")]
    docs = make(spark, [(i, t, "g", len(t)) for i, t in rows])
    lines = []
    for i, t in rows:
        at = 0
        for line in t.split("\n") if i is not None else []:
            w = line.split()
            if len(w) >= 50:
                lines.append((i, at, [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
            at += len(w)
    want = brute_spans(rows)
    verbatim = {(i, k) for i, at in want.items() for k in at}
    for i, at, grams in lines:
        for j, _, other in lines:
            both = set(grams) & set(other)
            if j < i and len(both) >= 0.5 * len(set(grams) | set(other)):
                shared = [k for k, x in enumerate(grams) if x in both]
                want.setdefault(i, set()).update(range(at + shared[0], at + shared[-1] + 5))
    got = {}
    for r in substring_dedup.repeats(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["begin"], r["end"]))
    assert got == want
    assert sum(len(x) for x in want.values()) > len(verbatim) + 500


def test_substring_dedup_hot_lines(spark, monkeypatch):
    """Many near lines, and many unlike ones with a passage of half their words: the same words go as by all pairs, without a row a pair."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 500)
    rng = random.Random(12)
    hot, passage = words(rng, 120, 10**6).split(), words(rng, 45, 10**6)
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in hot) for _ in range(60)]
    texts += [f"{words(rng, 25, 10**6)} {passage} {words(rng, 25, 10**6)}" for _ in range(60)]
    grams = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in map(str.split, texts)]
    want = {}
    for i, y in enumerate(grams):
        for x in grams[:i]:
            both = set(x) & set(y)
            if len(both) >= 0.5 * len(set(x) | set(y)):
                shared = [k for k, g in enumerate(y) if g in both]
                want.setdefault(i, set()).update(range(shared[0], shared[-1] + 5))
    docs = make(spark, [(i, t, "g", len(t)) for i, t in enumerate(texts)])
    found = substring_dedup.edited(docs.select("doc_id", "text"), 4, 50, 5, 0.5, 0.99).collect()
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], set()).update(range(r["begin"], r["begin"] + r["n"]))
    assert got == want and len(want) >= 50
    assert len(found) < 8 * len(want)
    assert len({r["component"] for r in components(spark.createDataFrame([(r["doc_id"], r["keeper"]) for r in found], "a long, b long")).collect()}) == 1


def brute_groups(rows, n, t):
    """(doc_id, group_id, group_size): all pairs of rows; rows of one id are linked."""
    sets = []
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}):
        g, _ = ngram_join.gram_sets([text], n)
        if len(g):
            sets.append((i, set(g.tolist())))
    label = {i: i for i, _ in sets}
    pairs = [(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) >= t * len(a | b) - 1e-9]
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    sizes = Counter(label.values())
    return {(i, g, sizes[g]) for i, g in label.items() if sizes[g] > 1}


@pytest.mark.parametrize(("n", "t"), [(5, 0.36), (2, 0.5), (1, 0.3)])
def test_ngram_join(spark, corpus, n, t):
    want = brute_groups(corpus, n, t)
    docs = make(spark, corpus)
    found = ngram_join.near_duplicates(docs, n=n, threshold=t, frequent=0.1)
    assert {tuple(r) for r in found.collect()} == want and want
    kept = ngram_join.keep_one(docs, found)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in corpus} - {i for i, g, _ in want if i != g}
    assert ngram_join.near_duplicates(make(spark, []), n=n).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_ngram_join_hot_groups(spark, n, monkeypatch):
    """Many near copies, a passage that many unlike documents share, and ids with several unlike rows; small slices."""
    monkeypatch.setattr(ngram_join, "SLICE_DOCS", 8)
    rng = random.Random(n)
    shared, hot = words(rng, 40, 10**6), words(rng, 120, 10**6).split()
    texts = [f"{words(rng, rng.randrange(5, 200), 10**6)} {shared} {words(rng, rng.randrange(5, 90), 10**6)}" for _ in range(60)]
    texts += [" ".join("x%d" % rng.randrange(10**6) if rng.random() < 0.06 else w for w in hot) for _ in range(70)]
    x, y, z = (words(rng, 40, 10**6) for _ in range(3))
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)]
    rows += [(500, f"{x} {y}", "", 0), (500, f"{x} {z}", "", 0), (501, f"{y} {z}", "", 0), (502, x, "", 0), (502, texts[3], "", 0), (503, z, "", 0), (503, z, "", 0)]
    want = brute_groups(rows, n, 0.36)
    for share in (0.01, 0.3):
        found = ngram_join.near_duplicates(make(spark, rows), n=n, threshold=0.36, frequent=share)
        assert {tuple(r) for r in found.collect()} == want and want


def test_ngram_join_shared_passage(spark, monkeypatch):
    """A passage of a third of 300 unlike texts makes no pairs of them; near copies among them are found."""
    rng = random.Random(6)
    passage = words(rng, 50, 10**6)
    texts = [f"{words(rng, 60, 10**6)} {passage} {words(rng, 40, 10**6)}" for _ in range(300)]
    texts += [texts[3] + " end", texts[4].replace("w1", "v1"), texts[5][40:]]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    asked, verify = [], ngram_join.verify

    def counted(docs, pairs, n):
        asked.append(pairs.count())
        return verify(docs, pairs, n)

    monkeypatch.setattr(ngram_join, "verify", counted)
    found = ngram_join.near_duplicates(make(spark, rows), frequent=1.1)
    want = brute_groups(rows, 5, 0.36)
    assert {tuple(r) for r in found.collect()} == want and len(want) >= 4
    assert sum(asked) < len(rows)


def test_ngram_join_lists_are_one_row(spark):
    """A list of documents that share grams leaves its shard as one row, whatever the number of its members."""
    rng = random.Random(8)
    texts = [words(rng, 80, 10**6) for _ in range(2)]
    rows = [(i - 40, texts[i // 40], "", 0) for i in range(80)]
    found = ngram_join.collisions(make(spark, rows), 5, 0.36, np.zeros(0, np.uint64), np.zeros(0, np.int64), 10_000).where("kind = 0").collect()
    assert {tuple(r["docs"]) for r in found} == {tuple(range(-40, 0)), tuple(range(40))}
    assert len(found) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ngram_join_joins_groups_by_few_pairs(spark, monkeypatch):
    """A group of near copies is joined by a pair a document; all its pairs were verified, and its sets travelled for each."""
    rng, asked = random.Random(6), []
    base = words(rng, 200, 10**6).split()
    rows = [(k, " ".join([*base[:20], f"own{k}", *base[20 : 150 + 5 * k]]), None, 0) for k in range(7)]
    rows += [(100 + k, words(rng, 20, 10**6), None, 0) for k in range(800)]  # else the copies' grams are frequent
    verify = ngram_join.verify
    monkeypatch.setattr(ngram_join, "verify", lambda docs, pairs, n: asked.append(pairs.count()) or verify(docs, pairs, n))
    got = ngram_join.near_duplicates(make(spark, rows))
    assert {tuple(r) for r in got.collect()} == {(k, 0, 7) for k in range(7)}
    assert sum(asked) <= 7


def test_gram_sets_travel_as_steps():
    grams = np.sort(np.random.default_rng(2).integers(0, 1 << 64, 400, np.uint64))
    for width in (ngram_join.EXACT, ngram_join.BOUND):
        packed = ngram_join.to_bytes(grams, width)
        assert (ngram_join.from_bytes(packed, width) == grams >> np.uint64(64 - 8 * width)).all()
        assert len(pa.compress(packed, "lz4_raw", asbytes=True)) < 0.95 * len(packed)


def test_ngram_join_bound(spark):
    """16 bits of a hash never give less than the exact similarity, and little more."""
    rng = random.Random(9)
    base = words(rng, 300, 10**6)
    rows = [(i, f"{' '.join(base.split()[: 40 * i])} {words(rng, 300 - 40 * i, 10**6)}", "", 0) for i in range(7)] + [(7, base, "", 0)]
    pairs = spark.createDataFrame([(a, b, 1) for a in range(8) for b in range(a)], "hub long, other long, part long")
    exact, bound = ({(r["hub"], r["other"]): r["jaccard"] for r in ngram_join.compare(make(spark, rows), pairs, 5, w).collect()} for w in (ngram_join.EXACT, ngram_join.BOUND))
    assert len(exact) == 28 and all(exact[k] <= bound[k] < exact[k] + 0.03 for k in exact)


def test_toxic_worker_gives_back(monkeypatch):
    """The stage after toxicity gets its worker without what the toxicity task took."""
    back = []
    monkeypatch.setattr(toxicity, "give_back", lambda: back.append(1), raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})
    assert sum(b.num_rows for b in toxicity.keep_clean(iter([batch]), 1, toxicity.Field(), None)) == 2 and back


def test_passages_are_packed_lean():
    """Packing holds little beside the paragraphs themselves, and empties what it was given."""
    rng = np.random.default_rng(1)
    n, docs = 400_000, np.repeat(np.arange(1000), 400)
    held = [(docs[a : a + 40_000], np.tile(np.arange(400, dtype=np.uint32), 100), np.repeat(rng.integers(0, 1 << 63, 4000, np.uint64), 10), rng.integers(0, 1 << 32, 40_000, np.uint32)) for a in range(0, n, 40_000)]
    want = Counter(np.concatenate([h[3] for h in held]).tolist())
    tracemalloc.start()
    out = substring_dedup.packed(held, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and Counter(np.frombuffer(b"".join(out["prints"]), np.uint32).tolist()) == want
    assert peak < 2.8 * 24 * n


def test_bpe_decodes_by_bytes():
    """Texts are cut from the tokens' bytes: cut characters, empty texts, several queries."""
    coder = bpe.session(bpe.load())
    texts = ["", "é", "a b  c", "\u4e2d\u6587 \U0001f600", ""] * 3
    ids, counts = coder.coder.encode_texts(texts)
    assert coder.decode(ids, counts) == texts
    byte = coder.v.byte_ids[np.frombuffer("é".encode(), np.uint8)]
    assert coder.decode(byte, np.array([1, 0, 1])) == ["\ufffd", "", "\ufffd"]
    column = pa.array([b"ab", b"", b"cde", b"f"], pa.binary())
    assert bytes(bpe.laid_out(column.slice(1, 2))) == b"cde" and bytes(bpe.laid_out(column[:0])) == b""


def test_give_back():
    """Freed memory leaves the process although a block above it is still held."""

    def resident():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    blocks = [np.ones(12_000) for _ in range(2000)]
    pin, full = blocks[::50], resident()
    del blocks
    common.give_back()
    assert len(pin) == 40 and full - resident() > 120


def test_workers_forget_other_operators():
    # a worker kept BPE's session, about 100 MB of it, through all stages that followed
    coder = bpe.session(bpe.Vocabulary([bytes([b]) for b in range(256)], np.arange(256, dtype=np.int32), *np.zeros((3, 0), np.int32)))
    common.give_back(bpe._sessions)
    assert [*bpe._sessions.values()] == [coder]
    assert list(toxicity.keep_clean(iter([]), 0, toxicity.Field(), None)) == [] and not bpe._sessions


def test_ngram_join_ids(spark):
    with pytest.raises(ValueError, match="whole number"):
        ngram_join.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randrange(15, 60), 3000)) for i in range(25)] + [(90, None), (91, ""), (None, "x y z"), (92, "too short")]
    rows, want = [], set()
    for d in range(160):
        text = words(rng, 200, 3000)
        if d % 4 == 0:
            i, item = items[d // 4 % 25]
            said = [w if rng.random() > 0.08 * (d % 8 == 4) else "changed" for w in item.split()]
            text = f"{text} {' '.join(said)} {words(rng, 90, 3000)}"
            want.add((d, i))
        rows.append((d, text, "clash", 1))
    rows += [(None, items[0][1], "", 1), (500, None, "", 1), (501, "", "", 1)]
    docs, bench = make(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    kept = decontaminate.drop_contaminated(docs, found)
    assert kept.count() == len(rows) - len({d for d, _ in got}) and kept.columns == docs.columns
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(make(spark, []), bench).count() == 0


def test_decontamination_by_brute_force(spark):
    """Every item against every stretch of every text, by the plain rule; items of 3 to 60 words, changed by 0 to 30 %."""
    rng = random.Random(12)
    lengths = [3, 5, 7, 7, 9, 12, 15, 15, 18, 20, 24, 28, 32, 40, 50, 60]
    items = [(i, words(rng, lengths[i % len(lengths)], 20_000)) for i in range(64)]
    rows = []
    for d in range(256):
        part = items[d % 64][1].split()
        said = [w if rng.random() >= (0, 0.1, 0.2, 0.3)[d // 64] else "other" for w in part]
        rows.append((d, f"{words(rng, rng.randrange(20, 300), 20_000)} {' '.join(said)} {words(rng, 60, 20_000)}", "", 0))
    rows += [(3, rows[3][1], "", 0), (300, items[0][1], "", 0), (301, " ".join(t for _, t in items), "", 0), (302, "w1 " * 3000, "", 0)]
    want = set()
    for d, text, *_ in rows:
        doc = text.split()
        for i, item in items:
            w = item.split()
            if len(w) < 8:
                if any(doc[k : k + len(w)] == w for k in range(len(doc))):
                    want.add((d, i))
                continue
            for k in {max(0, j - len(w)) for j, x in enumerate(doc) if x in w}:
                stretch = doc[k : k + 2 * len(w) + 32]
                ratio = lcs(w, stretch) / len(w)
                if ratio >= 0.8 or ratio >= 0.6 and lcs(stretch, w[-5:]) >= 3:
                    want.add((d, i))
                    break
    found = decontaminate.contaminated(make(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    size = dict((i, len(t.split())) for i, t in items)
    assert not got - want
    assert {p for p in want if size[p[1]] < 8} <= got
    for low, high in ((8, 17), (17, 33), (33, 99)):
        mine = {p for p in want if low <= size[p[1]] < high}
        assert len(mine & got) >= 0.93 * len(mine), (low, len(mine & got), len(mine))


@pytest.mark.parametrize("clash", ["gone", "spans", "GONE_"])
def test_clashing_columns(spark, clash):
    rng = random.Random(5)
    text = words(rng, 120, 10**6)
    docs = make(spark, [(1, text, "a", 1), (2, text, "b", 1), (3, None, "c", 1), (None, text, "d", 1)]).withColumnRenamed("group_id", clash)
    cut = substring_dedup.cut(docs, substring_dedup.repeats(docs))
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {1: text, 2: "", 3: None, None: text}
    kept = ngram_join.keep_one(docs, ngram_join.near_duplicates(docs))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, None}
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs, decontaminate.contaminated(docs, bench))
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {3, None}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randrange(8) for _ in range(rng.randrange(1, 70))] for _ in range(2)]
        item = decontaminate.Item(np.array(a, np.uint64), 5)
        assert item.common(b) == lcs(a, b)
        assert item.answered(b) == pytest.approx(lcs(b, a[-5:]) / len(a[-5:]))


def test_lcs_of_stretches_together():
    """Items of up to and beyond 64 words, many stretches and few: as one by one, without a step in Python for every word."""
    rng = random.Random(3)
    for size, stretches in ((1, 40), (63, 40), (64, 40), (65, 40), (90, 40), (30, 2)):
        item = decontaminate.Item(np.array([rng.randrange(50) for _ in range(size)], np.uint64), 5)
        known = np.arange(60, dtype=np.uint64)
        h = np.array([rng.randrange(90) for _ in range(700)], np.uint64)
        where = decontaminate.uses(known, h)
        lo = np.array([rng.randrange(600) for _ in range(stretches)])
        hi = lo + np.array([rng.randrange(100) for _ in lo])
        want = np.array([item.common(h[a:b].tolist()) for a, b in zip(lo, hi)])
        got = item.common_all(where, known, h, lo, hi, 0.2)
        assert ((got == want) | (got == 0) & (want < 0.2 * size)).all() and got.any()
    at = [np.array(x) for x in ([4, 4, 4, 4, 4, 7, 4], [3, 0, 1, 2, 1, 3, 5])]
    item, passage = decontaminate.settled_once(*at, np.array([0, 0, 0, 1, 1, 1]))
    assert list(zip(item.tolist(), passage.tolist())) == [(4, 0), (4, 2), (4, 3), (4, 5), (7, 3)]


ODD = ["", " ", "  a", "a  b", "a \n b", "it's don't  we'll", "½ x² ٣ 日本語", "\x1c a \x1cb", "a b  c", "x" * 700 + " y", "🎉 ok🎉\t\tq \r\n z", "é ño ", "0123456789" * 40, "a" * 301, "ab" * 999 + "a", "é" * 333, "etaoin" * 700 + "x"]


def test_bpe_and_frames(spark, corpus, tmp_path):
    coding = token_frames.tokenizer()
    rows = corpus + [(1000 + k, t, "", 0) for k, t in enumerate(ODD)]
    docs = make(spark, rows)
    want = sorted((repr(i), None if t is None else coding.encode_ordinary(t)) for i, t, *_ in rows)
    coded = bpe.encode(docs, check=True)
    got = coded.collect()
    assert sorted((repr(r["doc_id"]), r["tokens"]) for r in got) == want
    assert all(r["round_trip"] or r["tokens"] is None for r in got)
    back = bpe.decode(coded)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((repr(i), t) for i, t, *_ in rows)
    assert bpe.encode(make(spark, [])).count() == 0
    shards = token_frames.token_shards(docs, shard_bytes=4000)
    read = []
    for r in shards.collect():
        reader = token_frames.ShardReader.of_bytes(bytes(r["data"]))
        read += [(repr(d), None if (x := reader.tokens(k)) is None else x.tolist()) for k, d in enumerate(reader.doc_ids)]
    assert sorted(read) == want and shards.count() > 3
    stored = token_frames.write_shards(shards, str(tmp_path / "out")).collect()
    one = token_frames.ShardReader.of_file(stored[0]["path"])
    one.read([one.doc_ids[0]])
    assert one.frames_read <= 2
    damaged = bytearray(shards.first()["data"])
    damaged[len(damaged) // 3] ^= 255
    with pytest.raises(Exception):  # noqa: B017  any of zstd's or our own complaints
        bad = token_frames.ShardReader.of_bytes(bytes(damaged))
        [bad.tokens(k) for k in range(len(bad.doc_ids))]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(3, x[3].tolist(), 1), (None, x[0].tolist(), 0), (900, None, 0), (901, [1.0], 0), (902, [float("nan")] * 24, 0)]
    got = {}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for r in ann.knn(table, k=8, part_rows=200, query_rows=300).collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour_id"]
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    best = np.argsort(far, axis=1)[:, :8]
    assert sorted(got) == list(range(700)) and all(len(v) == 8 for v in got.values())
    assert np.mean([len(set(got[i].values()) & set(best[i])) / 8 for i in got]) >= 0.9
    assert ann.knn(table.where("vec_id = 1")).count() == 0 and ann.knn(table.where("false")).count() == 0
    # queries against all rows, with more of them than a block, and a crowd of equal vectors
    crowd = spark.createDataFrame([(i, x[i % 700 if i < 1000 else 0].tolist()) for i in range(1600)], "vec_id long, embedding array<float>")
    asked = {}
    for r in ann.knn(crowd, k=5, part_rows=300, query_rows=16, queries=F.col("vec_id") % 20 == 0).collect():
        asked.setdefault(r["vec_id"], []).append((r["distance"], r["neighbour_id"], r["rank"]))
    assert sorted(asked) == list(range(0, 1600, 20))
    full = np.stack([x[i % 700 if i < 1000 else 0] for i in range(1600)]).astype(np.float64)
    hits = total = 0
    for i, rows in asked.items():
        gap = np.sqrt(((full - full[i]) ** 2).sum(1))
        gap[i] = np.inf
        want = np.lexsort((np.arange(1600), gap))[:5]
        assert [r for *_, r in sorted(rows)] == [1, 2, 3, 4, 5]
        hits += sum(g <= gap[want[-1]] + 1e-9 for g, *_ in rows)
        total += 5
        if i >= 1000:
            assert [n for _, n, _ in sorted(rows)] == want.tolist()
    assert hits >= 0.95 * total


def test_packed_inner_products():
    rng = np.random.default_rng(4)
    for d in (5, 24, 64, 100):
        signs, q = rng.random((40, d)) < 0.5, rng.standard_normal((7, d)).astype(np.float32)
        got, lost = ann.inner_products(ann.words_of(signs), q)
        want = q @ (signs * 2.0 - 1).T / np.sqrt(d)
        assert (np.abs(got - want) <= 2 * lost[:, None] + 1e-4).all()


def test_chat(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, None, None), (1, 4, "user", "<|im_end|>"), (None, None, "user", "x"), (2, 1, "user", "")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1]["chat"] == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n<|im_start|>user\n< |im_end|><|im_end|>"
    assert (got[1]["n_turns"], got[1]["n_merged"], got[2]["chat"]) == (4, 3, "<|im_start|>user\n<|im_end|>")
    assert None in got
    forged = spark.createDataFrame([(1, 1, "a<|im_end|>b", "x", "clash"), (1, 1, "a", "y", "clash"), (1, 1, "a", "y", "clash")], "conv_id long, turn int, role string, text string, t string")
    row = chat.format_chats(forged).first()
    assert row["chat"] == "<|im_start|>a\ny\ny<|im_end|>\n<|im_start|>a< |im_end|>b\nx<|im_end|>" and (row["n_turns"], row["n_merged"]) == (3, 2)
    assert chat.format_chats(forged.where("false")).count() == 0
    long = spark.createDataFrame([(1, k, "user" if k % 3 else "tool", "w " * 50) for k in range(5000)], "conv_id long, turn int, role string, text string")
    row = chat.format_chats(long).first()
    assert (row["n_turns"], row["n_merged"]) == (5000, 3334) and row["chat"].count("w ") == 250_000


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for d in range(400):
        w = words(rng, 60, 500).split()
        if d % 5 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["idiotic", "foul"])
        rows.append((d, " ".join(w), "", 0))
        labels.append((d, int(d % 5 == 0)))
    labels += [(None, 1), (9999, 1), (7, None)]
    docs, marks = make(spark, rows + [(None, None, "", 0), (-1, "", "", 0)]), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert {i for i, r in got.items() if r["toxic"]} == {d for d in range(0, 400, 5)}
    for s in got[0]["spans"]:
        assert re.fullmatch("(idiotic|foul)( (idiotic|foul))*", rows[0][1][s["start"] : s["end"]])
    assert toxicity.drop_toxic(docs, model).count() == 322
    assert toxicity.score(make(spark, []), model).count() == 0
    assert not toxicity.train(docs, marks.where("false")).words


def test_marginals():
    rng = np.random.default_rng(1)
    emit, step = rng.normal(size=5), rng.normal(size=(2, 2))
    total = np.zeros(5)
    z = 0.0
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        p = np.exp(sum(emit[k] for k in range(5) if y[k]) + sum(step[a, b] for a, b in zip(y, y[1:])))
        z += p
        total += p * np.array(y)
    post, _, _ = toxicity.marginals(emit, np.array([0]), np.array([5]), step)
    assert post == pytest.approx(total / z)


def test_marginals_of_long_chains(monkeypatch):
    """Cut into segments or not, chains of any length have the same messages."""
    rng = np.random.default_rng(2)
    length = np.array([1, 2, 3, 4, 7, 8, 9, 30, 31, 500])
    begin = np.cumsum(length) - length
    emit, step = rng.normal(size=length.sum()) * 4, rng.normal(size=(2, 2)) * 3
    monkeypatch.setattr(toxicity, "SEGMENT", 10**6)
    whole = toxicity.marginals(emit, begin, length, step)
    for segment in (1, 3, 4, 128):
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        for x, y in zip(whole, toxicity.marginals(emit, begin, length, step)):
            assert y == pytest.approx(x, abs=1e-9)


def test_toxicity_by_brute_force(spark):
    """Every row's score, peak and spans, from the plain recursion over its sentences; odd rows among them."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["vile", "calm", "tree", "Vile", "water.", "so\n", "é!", "stone"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += [None, "", " . \n!", texts[0], "vile " * 4000, "calm tree " * 3000, "no end here " * 500 + "vile"]
    docs = make(spark, [(k % 60, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "vile vile", "", 0)])
    train = make(spark, [(k, ("vile " if k % 4 == 0 else "calm ") + words(rng, 20, 300), "", 0) for k in range(200)])
    model = toxicity.train(train, spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int"))
    lookup = toxicity.Rows(model)

    def plain(text):
        found = [(m.group(), *m.span()) for m in toxicity.TOKEN.finditer(text or "")]
        score, peak, hot, chain = 0.0, 0.0, [], []
        for k, (w, *_) in enumerate([*found, (".", 0, 0)]):
            if w[0] not in toxicity.ENDS:
                chain.append(k)
                continue
            rows = [0, *(lookup[found[c][0]] for c in chain), 0]
            emit = [model.bias + model.weights[b, 0] + model.weights[a, 1] + model.weights[c, 2] for a, b, c in zip(rows, rows[1:], rows[2:])]
            n, s = len(emit), model.step
            f, g = np.zeros((n, 2)), np.zeros((n, 2))
            for i in range(n):
                for y in (0, 1):
                    f[i, y] = y * emit[i] + (np.logaddexp(f[i - 1, 0] + s[0, y], f[i - 1, 1] + s[1, y]) if i else 0)
            for i in range(n - 2, -1, -1):
                for y in (0, 1):
                    g[i, y] = np.logaddexp(g[i + 1, 0] + s[y, 0], g[i + 1, 1] + s[y, 1] + emit[i + 1])
            for i, c in enumerate(chain):
                p = 1 / (1 + np.exp(f[i, 0] + g[i, 0] - f[i, 1] - g[i, 1]))
                peak = max(peak, p)
                if p >= 0.5:
                    score += p
                    hot.append(c)
            chain = []
        spans = []
        for c in hot:
            if spans and spans[-1][2] == c - 1:
                spans[-1] = (spans[-1][0], found[c][2], c)
            else:
                spans.append((found[c][1], found[c][2], c))
        return round(score, 4), round(peak, 4), [s[:2] for s in spans]

    got = sorted((repr(r["doc_id"]), round(r["toxicity"], 4), round(r["peak"], 4), [tuple(s) for s in r["spans"]], r["toxic"]) for r in toxicity.score(docs, model).collect())
    want = []
    for r in docs.collect():
        score, peak, spans = plain(r["text"])
        want.append((repr(r["doc_id"]), pytest.approx(score, abs=2e-3), pytest.approx(peak, abs=2e-4), spans, score >= model.enough))
    assert len(got) == len(want)
    left = list(got)
    for w in want:
        left.remove(next(g for g in left if all(x == y for x, y in zip(w, g))))
    assert model.words and any(w[4] for w in want) and not all(w[4] for w in want)


def ppm(texts, text, order):
    counts = {}
    for t in texts:
        b = [None] * order + list(t.encode())
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts.setdefault(tuple(b[i - k : i]), Counter())[b[i]] += 1
    bits, b = 0.0, [None] * order + list(text.encode())
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            c = counts.get(tuple(b[i - k : i]))
            if c is None:
                continue
            total = sum(c.values()) + len(c)
            if b[i] in c:
                bits -= np.log2(c[b[i]] / total)
                break
            bits -= np.log2(len(c) / total)
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [1, 2, 3])
def test_ppm_code_lengths(order):
    by = {"a": ["the cat sat", "then that"], "b": ["une chatte", "été où"]}
    model = langid.fit(by, order)
    for text in ("the hat", "été", "zzz € q", "x"):
        assert model.bits([text])[0] == pytest.approx([ppm(by[k], text, order) for k in ("a", "b")], rel=1e-5)
    assert model.bits([None, ""]).sum() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    got = langid.identify(rest, model).join(rest, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.93 * rest.count()
    odd = make(spark, [(1, None, "", 0), (2, "", "", 0)])
    assert {r["doc_id"]: (r["lang_pred"], r["bits"]) for r in langid.identify(odd, model).collect()} == {1: (None, None), 2: (None, 0.0)}


def test_globs():
    rng = random.Random(8)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + ["*", "", "a" * 70 + "*"]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + ["a" * 90, "é"]
    hits = urlfilter.Automaton(globs).matches(texts)
    for g, glob in enumerate(globs):
        rule = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob), re.S)
        assert [bool(rule.fullmatch(t)) for t in texts] == hits[:, g].tolist()


def test_url_nulls(spark):
    rows = [(1, None), (2, "  "), (3, "HTTP://M.Example.com:80#x"), (3, "HTTP://M.Example.com:80#x")]
    got = [tuple(r) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    assert sorted(got, key=str) == sorted([(1, None, "", False), (2, None, "", False), *[(3, "http://m.example.com/", "0", True)] * 2], key=str)
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string, rules string, blocked int")).count() == 0


def test_url_forms(spark):
    forms = {
        "http://a.example.com//x//y": "http://a.example.com/x/y",
        "https://h:443?q=1//2": "https://h/?q=1//2",
        "HTTP://H/A///b//?u=http://z//q#f": "http://h/a/b/?u=http://z//q",
        "//x//y": "/x/y",
        "http:///p": "http:///p",
    }
    rows = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(forms)], "page_id long, url string, canonical_url string, rid string")
    assert [r[0] for r in rows.orderBy("page_id").select(urlfilter.canonical(F.col("url"))).collect()] == list(forms.values())
    long = "http://h/" + "ab/" * 300_000
    got = urlfilter.filter_urls(spark.createDataFrame([(1, long + "feed"), (2, long)], "page_id long, url string"), ["*/feed"]).collect()
    assert [r["blocked"] for r in sorted(got)] == [True, False]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA))
        docs = P.materialize(docs, name)
        assert docs.columns == columns and docs.count() > 0
    last = P.STAGES[-1][1](spark, docs, str(DATA))
    coding = token_frames.tokenizer()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["tokens"] for r in last.collect()}
    assert got == {i: coding.encode_ordinary(t) for i, t in texts.items()}
    assert not brute_spans([(r[0], r[1]) for r in texts.items()])
    assert isinstance(coding, tiktoken.Encoding)
