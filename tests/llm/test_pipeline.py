"""The corpus pipeline, stage by stage against brute force, over rows with the awkward cases."""

import random
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import DOCS, WORD, corpus, library_ids, linked, windows_removed, write  # noqa: E402


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    r = random.Random(12)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "ter", "en", "su"]) for _ in range(r.randint(1, 4)))
    rows = [*corpus(), *[(100 + i, " ".join(word() for _ in range(150))) for i in range(30)]]
    shared = " ".join(word() for _ in range(60))
    rows += [(200 + i, " ".join(word() for _ in range(80)) + "\n" + shared + "\n" + " ".join(word() for _ in range(80)) + " token=abcdefgh1") for i in range(5)]
    rows += [(300, rows[-1][1]), (301, rows[-10][1])]
    d = str(tmp_path_factory.mktemp("pipe"))
    write(spark, d, "documents", [(i, t, "en", None, None, 7, "clash") for i, t in rows], DOCS)
    kept, docs = {}, spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        if name != "packing":
            assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
    return d, [(i, t) for i, t in rows], kept


def test_stages_follow_each_other(run):
    from pagelake.llm.secrets import base_spans, candidates, cut_of, masked, spans

    _, rows, kept = run
    good = kept["quality_rules"]
    assert {x.doc_id for x in good} >= {i for i, _ in rows if i >= 100} and not {x.doc_id for x in good} & {0, 1, 2, 9, 10}
    assert all(x.sequence_id == "clash" and x.n_words == 7 for x in good)
    near = {x.doc_id: x.text for x in kept["simhash_near_dedup"]}
    assert {300, 301, 4, 5}.isdisjoint(near) and {200, 201} <= set(near)
    assert len(kept["simhash_near_dedup"]) == len(near)
    left = {x.doc_id: x for x in kept["substring_dedup"]}
    want = {i: n for i, n, _, _ in windows_removed(near.items())}
    gone = {i: g for i, _, g, _ in windows_removed(near.items())}
    for i, x in left.items():
        assert len(WORD.findall(x.text)) == want[i] - gone[i]
        assert x.text == near[i] if not gone[i] else x.n_chars == len(x.text)
    assert all(gone[i] == 60 for i in (201, 202, 203, 204)) and gone[200] == 0
    texts = [x.text for x in left.values()]
    cut = cut_of([(p, b - a, 1) for t in texts for a, b, p in candidates(t, [(i, j) for i, _, j in base_spans(t)])])
    for x in kept["secret_scan"]:
        t = left[x.doc_id].text
        assert x.text == masked(t, spans(t, cut))
    assert "token=" not in {x.doc_id: x.text for x in kept["secret_scan"]}[200]
    ends = Counter()
    for p in kept["packing"]:
        ends[p.doc_id] += p.length
    assert ends == {x.doc_id: len(library_ids(x.text)) for x in kept["secret_scan"]}


def test_run_is_the_stages(spark, run):
    d, _, kept = run
    a, b = defaultdict(int), defaultdict(int)
    for p in corpus_pipeline.run(spark, d).collect():
        a[p.doc_id] += p.length
    for p in kept["packing"]:
        b[p.doc_id] += p.length
    assert a == b


def test_near_dedup_keeps_one_of_each_group(spark, run):
    import xxhash

    _, _, kept = run
    docs = kept["quality_rules"]

    def fp(t):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {x.doc_id: fp(x.text) for x in docs}
    find = linked(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(least.get(find(p), i), i)
    assert {x.doc_id for x in kept["simhash_near_dedup"]} == set(least.values())


def shingle_set(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_near_dedup_finds_planted_copies_of_jaccard_080_and_more(spark):
    r = random.Random(21)
    rows, near, far = [], set(), set()
    for i in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(120, 400))]
        rows.append((10 * i, " ".join(words)))
        for k, want in ((1, 0.8), (2, 0.88), (3, 0.95), (4, 0.7)):
            copy = list(words)
            places = r.sample(range(5, len(words) - 5), len(words) // 10)
            for p in places:  # as many words changed as the wanted similarity lets
                tried = copy[:p] + [f"n{r.randrange(10**6)}"] + copy[p + 1 :]
                if jaccard(" ".join(words), " ".join(tried)) < want:
                    break
                copy = tried
            last = " ".join(copy)
            if want < 0.8:
                for p in r.sample(range(len(copy)), 4):
                    copy[p] = f"m{r.randrange(10**6)}"
                last = " ".join(copy)
            j = jaccard(" ".join(words), last)
            if want >= 0.8:
                assert j >= want
                near.add(10 * i + k)
                rows.append((10 * i + k, last))
            elif j < 0.75 and all(jaccard(t, last) < 0.8 for d, t in rows if d // 10 == i):
                far.add(10 * i + k)
                rows.append((10 * i + k, last))
    assert len(near) == 180 and len(far) > 20
    docs = spark.createDataFrame([(i, t, "en", None, len(t), 7, "clash") for i, t in rows], DOCS)
    kept = {x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - near


def test_near_classes_equal_brute_force(spark):
    from pagelake.llm.neardup import near_classes

    r = random.Random(22)
    texts = ["", " \n", "one two", "One\ttwo", "one two three"]
    for _ in range(6):  # crowds that drift: their ends are linked only through others
        words = [f"w{r.randrange(900)}" for _ in range(100)]
        for _ in range(12):
            words[r.randrange(100)] = f"n{r.randrange(10**6)}"
            if r.random() < 0.5:
                words[r.randrange(100)] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", None, len(t), 7, "clash") for i, t in enumerate(texts)], DOCS)
    from hashlib import md5

    root = {bytes(x.key): bytes(x.root) for x in near_classes(docs).collect()}
    assert root == {bytes(x.key): bytes(x.root) for x in near_classes(docs, hot=2).collect()}  # every shard is cut again
    found = [root.get(md5(t.encode()).digest(), t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle_set(t) or {tuple(WORD.findall(t.lower()))} for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    assert all((found[i] == found[j]) == (find(i) == find(j)) for i, j in pairs)


def test_near_classes_link_texts_that_share_one_hot_shard_alone(spark):
    from hashlib import md5

    from pagelake.llm.neardup import bands, near_classes, shingles

    a = "w572 w834 w720 w132 w606 w595 w962 w756 w661 w143 w338 w827 w175"
    b = a[:-3] + "96"
    c = f"w129 w735 {a} w831 w994"  # the least class of that shard; too far from a and b to link them
    of = lambda t: set(bands(shingles(t.encode())).tolist())
    assert jaccard(a, b) == 0.8 and max(jaccard(a, c), jaccard(b, c)) < 0.8
    assert len(of(a) & of(b)) == 1 and of(a) & of(b) <= of(c)
    docs = spark.createDataFrame([(i, t, "en", None, len(t), 7, "clash") for i, t in enumerate((a, b, c))], DOCS)
    want = {md5(t.encode()).digest() for t in (a, b)}
    for hot in (20_000, 3, 2, 1):
        assert {bytes(x.key): bytes(x.root) for x in near_classes(docs, hot=hot).collect()} == dict.fromkeys(want, min(want))


def test_tree_pairs_are_the_pairs_within_the_radius_whatever_is_hot(spark):
    from pagelake.llm.neardup import LONGS, RADIUS, SMALL, WIDE, tree_pairs

    r = random.Random(24)
    key = lambda: r.randbytes(16)
    crowd, rows = key(), []
    for band in (1, 2):
        centre = r.getrandbits(64 * LONGS)
        for i in range(70):
            fp = centre
            for k in r.sample(range(64 * LONGS), r.randrange(150)):
                fp ^= 1 << k
            mine = key()
            rows.append((band, mine, r.choice([1, 4, 5, 7, 8, 9, 10, 12, 15, 16, 100, 125, 126]), fp, crowd if i % 3 == 0 else mine if i % 3 == 1 else bytes([i % 4]) * 16))
    near = lambda m, n, d: 5 * min(m, n) >= 4 * max(m, n) and d <= (WIDE if min(m, n) < SMALL else RADIUS)
    want = {(x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1] and x[4] != y[4] and near(x[2], y[2], (x[3] ^ y[3]).bit_count())}
    assert len(want) > 300
    apart = spark.createDataFrame([(b, k, n, fp.to_bytes(8 * LONGS), root) for b, k, n, fp, root in rows], "band long, key binary, n int, fp binary, root binary")
    for hot in (1000, 69, 8, 1):
        found = [(bytes(x.a), bytes(x.b)) for x in tree_pairs(apart, hot).collect()]
        assert len(found) == len(want) and set(found) == want


def test_near_dedup_goes_by_text_when_doc_ids_are_null_or_repeat(spark):
    r = random.Random(23)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(100))
    a, b, c, d, e, f = (text() for _ in range(6))
    near = lambda t: t + " more"
    rows = [(None, a), (None, b), (None, b), (None, near(c)), (5, c), (7, d), (7, e), (7, e), (8, near(f)), (8, f), (9, f), (6, near(d))]
    docs = spark.createDataFrame([(i, t, "en", None, len(t), 7, "clash") for i, t in rows], DOCS)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter([(None, a), (None, b), (5, c), (6, near(d)), (7, e), (8, min(f, near(f)))])


def test_bitmap_lets_every_key_pass_however_small_it_is(spark):
    from pagelake.llm._common import passing

    rows = spark.createDataFrame([(i if i % 50 else None,) for i in range(2000)], "k long")
    keys = spark.createDataFrame([(i,) for i in range(0, 2000, 7)], "other long")
    for bits in (4, 15, 16, 26):
        hit, miss = (sorted(x.k or -1 for x in d.collect()) for d in passing(rows, "k", keys, bits))
        assert sorted(hit + miss) == sorted(i if i % 50 else -1 for i in range(2000))
        assert not set(miss) & {-1, *range(0, 2000, 7)}
        if bits == 26:
            assert set(hit) == {-1, *[i for i in range(0, 2000, 7) if i % 50]}
    assert passing(rows, "k", keys.limit(0))[0].count() == 40


def test_pipeline_over_an_empty_table_and_one_of_nulls(spark, tmp_path):
    write(spark, str(tmp_path), "documents", [], DOCS)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(None,) * 7] * 3, DOCS)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), DOCS)
        assert [tuple(x) for x in docs.collect()] == [(None,) * 7]


def test_near_dedup_recall_over_documents(spark):
    """Of pairs of five-word Jaccard 0.8 and more, found by brute force over a table, none stays whole."""
    sf = "/root/testdata/sf0.001"
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
    except Exception:
        pytest.skip("no documents table here")
    texts = {x.doc_id: shingle_set(x.text or "") for x in docs.collect()}
    kept = {x.doc_id for x in corpus_pipeline.near_dedup_stage(spark, docs, sf).collect()}
    ids = sorted(i for i in kept if texts[i])
    assert not [(i, j) for k, i in enumerate(ids) for j in ids[:k] if 5 * len(texts[i] & texts[j]) >= 4 * len(texts[i] | texts[j])]
