"""Near-duplicates, decontamination, piece BPE and token files against brute force."""

import hashlib
import random
import re
import zlib

import pytest

UP = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORDS = [f"w{i}" for i in range(4000)]


def components(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def similar_docs(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for group in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((n * 7 + 1, (" " if group % 2 else "\n\t").join(own).title()))
            n += 1
    # chains: each text is like the next, the ends are not
    base = [f"c{i}" for i in range(120)]
    for step in range(8):
        rows.append((n * 7 + 1, " ".join(base[step * 2 : step * 2 + 100])))
        n += 1
    rows += [(5000, None), (5001, ""), (5002, " \t\n "), (5003, "one two"), (5004, "ONE TWO"), (5005, "one"), (5006, "x " * 30000), (5007, "X " * 30000)]
    return rows


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def test_near_duplicates_match_brute_force(make):
    from rugosa.llm.near_duplicates import near_duplicates

    rows = similar_docs()
    sets = {d: shingles(t) for d, t in rows}
    full = [d for d in sets if sets[d]]
    edges = [
        (a, b)
        for i, a in enumerate(full)
        for b in full[:i]
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = components(sets, edges)
    got = near_duplicates(make(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        d: (len(sets[d]), want[d], want[d] == d) for d in sets
    }
    assert len(got) == len(rows) and len(set(want.values())) < len(rows)


def test_near_duplicates_edges(make):
    from rugosa.llm.near_duplicates import near_duplicates

    assert near_duplicates(make([])).collect() == []
    got = near_duplicates(make([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(1, 1), (1, 1), (2, 1)]
    assert sorted((r.n_shingles, r.component_id or 0) for r in got if r.doc_id is None) == [(0, 0), (2, 1)]


def test_signature_distance_holds_for_similar_sets():
    import numpy as np

    from rugosa.llm.near_duplicates import DISTANCE, signatures

    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(20, 400))
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        own = int(n * 0.08)  # Jaccard about 0.86
        a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, own, dtype=np.uint64)]))
        s = signatures([a, b])
        assert (s[0] != s[1]).sum() <= DISTANCE


def test_components_of_paths_stars_and_loops(spark):
    from rugosa.llm.components import components as connected

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(90)] + [(7, 7), (3, 4), (4, 3)]
    edges += [(rng.randint(400, 600), rng.randint(400, 600)) for _ in range(90)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    got = connected(spark.createDataFrame([*edges, (None, 5)], "u long, v long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(nodes)
    assert connected(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_hits(text, items):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(word, (t or "").translate(UP))
    doc = split(text)
    hit, found = set(), set()
    for item, t in items:
        w = split(t)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == w[i : i + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(item))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def benchmark_rows():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 30)))) for i in range(30)]
    items += [(40, None), (41, ""), (42, "Été À la"), (43, items[0][1]), (44, "..!")]
    docs = [(0, None), (1, ""), (2, "plain text"), (3, "x, Été-à   LA, y")]
    for i in range(60):
        own = [rng.choice(WORDS) for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(30)][1].split()
            a = rng.randrange(len(w))
            own[rng.randrange(len(own)) : 0] = w[a:] if rng.random() < 0.5 else w
        docs.append((10 + i, ("; " if i % 2 else " ").join(own).upper() if i % 3 else " ".join(own)))
    return docs, items


@pytest.mark.parametrize("block", [8_000_000, 2_000])
def test_decontamination_matches_brute_force(spark, make, monkeypatch, block):
    from rugosa.llm import contamination

    monkeypatch.setattr(contamination, "BLOCK_CHARS", block)
    docs, items = benchmark_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination.digest(make(docs), bench).collect()}
    for d, t in docs:
        n, hit, n_items, sha = brute_hits(t, items)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, n_items, sha), d
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert sum(r.contaminated for r in got.values()) > 5


def test_decontamination_spans_and_empty_tables(spark, make):
    from rugosa.llm.contamination import digest, hits

    text = "Vor — É a-b, c D e f g h i j k l m! nach"
    bench = spark.createDataFrame([(1, "é A B C d e f g h i j k l M")], "item_id long, text string")
    (row,) = hits(make([(1, text)]), bench).collect()
    # É is no ASCII letter and stays as it is, so the window starts after it
    assert [text[s.start : s.end] for s in row.spans] == ["a-b, c D e f g h i j k l m"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in digest(make([(1, "a b")]), none).collect()] == [False]
    assert digest(make([]), bench).collect() == []


TEXTS = [
    None, "", " ", "   ", "a", "  Hello  world\nfoo\tbar  é　x ﬁ ▁▁ a▁b ", "\x00<0x0A></s><s>", "😀 " * 3, "x" * 5000 + " y", " lead", "trail ",
    "a  b", "\n\n \n", "don't 's 't x 12 34é", "\xad \xad a \xad b", "<|endoftext|> x <|endoftext|>y", "日本語のテキスト " * 40, "word " * 20000,
]


def test_piece_bpe_equals_the_library(make):
    import sentencepiece

    from rugosa.llm.piece_bpe import digest_documents, encode_documents
    from rugosa.llm.queries import tokenizer

    model = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab e\n▁ éз😀.,") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    docs = make(list(enumerate(texts)))
    got = {r.doc_id: r for r in encode_documents(docs, model, check="texts").collect()}
    short = {r.doc_id: r for r in digest_documents(docs, model).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert got[i].ids == ids and got[i].decoded == lib.decode(ids), repr(t)
        assert short[i].n_tokens == len(ids)
        assert short[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert digest_documents(make([]), model).collect() == []


def test_token_files_round_trip(make, spark):
    from tokenizers import Tokenizer

    from rugosa.llm.common import fresh_path
    from rugosa.llm.queries import tokenizer
    from rugosa.llm.token_files import read_files, token_files

    file = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(file)
    texts = TEXTS * 3
    ids = [[*lib.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    path = fresh_path(spark, "test-files")
    got = {r.doc_id: r for r in token_files(make([(i, texts[i]) for i in order]), file, 2, path).collect()}
    back = {r.doc_id: r.ids for r in read_files(spark, path, ids=True).collect()}
    start = 0
    for i, own in enumerate(ids):
        assert back[i] == own
        data = b"".join(x.to_bytes(4, "little") for x in own)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(own), zlib.crc32(data))
        start += len(own)


def test_token_files_of_nothing_and_of_repeated_rows(make):
    from rugosa.llm.queries import tokenizer
    from rugosa.llm.token_files import token_files

    file = tokenizer("byte_bpe_50k.json")
    assert token_files(make([]), file, 2).collect() == []
    got = token_files(make([(1, None), (1, None), (None, "a")]), file, 2).collect()
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in got) == [(0, 0, 2), (1, 2, 1), (1, 3, 1)]


def test_code_lengths_are_optimal_under_the_limit():
    import heapq

    import numpy as np

    from rugosa.llm.token_files import code_lengths

    rng = np.random.default_rng(3)
    w = np.sort(rng.integers(1, 10**6, 300)) ** 2
    heap = [(int(x), i) for i, x in enumerate(w)]
    heapq.heapify(heap)
    cost, n = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], n))
        n += 1
    free = code_lengths(w, 40)
    assert int((free * w).sum()) == cost  # Huffman's cost
    tight = code_lengths(w, 9)
    assert tight.max() <= 9 and sum(2.0 ** -tight) <= 1 and int((tight * w).sum()) >= cost
    # by exhaustion: four symbols, two bits at most, leaves one answer
    assert code_lengths(np.array([1, 2, 4, 100]), 2).tolist() == [2, 2, 2, 2]
    assert code_lengths(np.array([1, 2, 4, 100]), 3).tolist() == [3, 3, 2, 1]


def test_remembered_values_stay_within_their_bytes():
    """Thousands of long unspaced keys are never kept; the others stay within the
    bound, frequent ones through changes of generation."""
    from rugosa.llm.common import Remembered

    asked = []

    def learn(keys):
        asked.extend(keys)
        return [k.encode() * 2 for k in keys]

    memory = Remembered(400_000, longest=64)
    for i in range(2000):
        keys = [["often", "x" * 2000 + str(i), f"key{i}"], [], ["often", f"key{i}"]]
        got = memory.values(keys, learn)
        assert got == [[k.encode() * 2 for k in own] for own in keys]
        held = {**memory.old, **memory.young}
        assert max(map(len, held)) <= 64
        assert sum(Remembered.ENTRY + 2 * len(k) + len(v) for k, v in held.items()) <= 400_000 + 1000
    assert asked.count("often") == 1 and len(asked) == 4001


def test_mail_hosts_in_a_long_run_of_letters(spark):
    """A megabyte of letters before an address takes no quadratic time."""
    import time

    from pyspark.sql import functions as F

    from rugosa.llm.url_filter import MAIL

    texts = ["a" * 1_000_000, "x" * 300_000 + "@host.example", "a@b.c_x@d.e, y@f.g@h.i <m.n-o@p.q.r>", ""]
    df = spark.createDataFrame([(t,) for t in texts], "html string")
    began = time.time()
    got = [r[0] for r in df.select(F.regexp_extract_all("html", F.lit(MAIL), F.lit(1))).collect()]
    assert time.time() - began < 20
    assert got == [[], ["host.example"], ["b.c", "d.e", "f.g", "p.q.r"], []]


@pytest.mark.parametrize("block", [8_000_000, 300])
def test_decontamination_judges_rows_of_one_doc_id_apart(spark, make, monkeypatch, block):
    from rugosa.llm import contamination

    monkeypatch.setattr(contamination, "BLOCK_CHARS", block)
    a = " ".join(f"a{i}" for i in range(13))
    b = " ".join(f"b{i}" for i in range(13))
    bench = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    docs = [(1, a), (1, "x y z"), (None, "p " + a), (None, b + " q"), (2, f"- {a}; {b} -"), (3, None)]
    rows = contamination.hits(make(docs), bench).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items, [(s.start, s.end) for s in r.spans]) for r in rows)
    want = [
        ("1", 3, 0, [], []),
        ("1", 13, 13, ["1"], [(0, len(a))]),
        ("2", 26, 26, ["1", "2"], [(2, 4 + len(a) + len(b))]),
        ("3", 0, 0, [], []),
        ("None", 14, 13, ["1"], [(2, 2 + len(a))]),
        ("None", 14, 13, ["2"], [(0, len(b))]),
    ]
    assert got == sorted(want)


def test_near_duplicates_of_texts_that_share_a_doc_id(make):
    from rugosa.llm.near_duplicates import near_duplicates

    a, b = (" ".join(f"{p}{i}" for i in range(120)) for p in "ab")
    docs = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, b + " z"), (5, "another text of its own altogether"), (1, a)]
    rows = near_duplicates(make(docs)).collect()
    assert len(rows) == len(docs)
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)}


def test_shared_members_are_listed_once(spark):
    from rugosa.llm.components import shared_members

    keys = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (2, 10), (3, 14), (3, 14), (4, 9), (4, 8), (4, 9)], "key long, id long")
    got = sorted(tuple(r) for r in shared_members(keys, "once").collect())
    assert got == [(1, 10), (1, 12), (4, 8), (4, 9)]
    assert shared_members(keys.limit(0), "once").collect() == []


def test_filter_keeps_what_is_wanted_and_little_else(spark):
    """Only rows that the exact join may need are shuffled with their texts."""
    from rugosa.llm.common import possibly_among

    rows = spark.range(20_000).selectExpr("id", "xxhash64(id) as h", "'x' as `_word`")
    wanted = rows.where("id % 40 = 0").select("h")
    got = possibly_among(rows.withColumnRenamed("_word", "word"), "h", wanted, "filter")
    assert got.columns == ["id", "h", "word"]
    ids = {r.id for r in got.collect()}
    assert ids >= set(range(0, 20_000, 40)) and len(ids) < 600
    assert possibly_among(rows.select("h"), "h", wanted.limit(0), "filter").count() == 0


@pytest.mark.parametrize("counted", [1, 1 << 18])
def test_profile_tells_elements_that_other_sets_hold(spark, monkeypatch, counted):
    """Counts by block are of the elements that another set holds, also when hashes are
    counted run by run first."""
    import numpy as np

    from rugosa.llm import near_duplicates as N

    monkeypatch.setattr(N, "COUNTED", counted)
    sets = {1: [5, -7, 1 << 60], 2: [5, 40], 3: [99], 4: [-7, 5, 41]}
    made = lambda i, text: np.array(sorted(map(int, text.split())), dtype=np.int64).view(np.uint64)
    table = spark.createDataFrame([(i, " ".join(map(str, s))) for i, s in sets.items()], "id long, set string").coalesce(1)
    rows = {r.id: r for r in N.held_profile(table, made).collect()}
    assert {i: rows[i].size for i in rows} == {i: len(s) for i, s in sets.items()}
    for i, own in sets.items():
        counts = [(rows[i][f"w{b // 4}"] >> (16 * (b % 4))) & 0xFFFF for b in range(N.BLOCKS)]
        held = [x for x in own if any(x in s for j, s in sets.items() if j != i)]
        assert counts == [sum(x % N.BLOCKS == b for x in held) for b in range(N.BLOCKS)]


def test_remembered_values_are_looked_up_once_a_call():
    """The work of Python itself follows the different keys of a call."""
    from rugosa.llm.common import Remembered

    asked = []

    class Counted(dict):
        looked = 0

        def get(self, *a):
            Counted.looked += 1
            return super().get(*a)

    def learn(keys):
        asked.extend(keys)
        return [k.encode() for k in keys]

    memory = Remembered(1 << 20)
    memory.young, memory.old = Counted(), Counted()
    long = "z" * 100
    assert memory.values([["a", "b", long] * 1000, ["a"] * 1000], learn) == [[b"a", b"b", long.encode()] * 1000, [b"a"] * 1000]
    assert Counted.looked <= 6 and asked == ["a", "b", long] and sorted(memory.young) == ["a", "b"]


def test_text_slices_are_bounded_by_rows_and_bytes():
    import pyarrow as pa

    from rugosa.llm.token_files import text_slices

    texts = ["é" * 10, None, "", "a" * 50, "b" * 5, "c" * 5, "d" * 20, "", "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]).slice(0)
    got = [p.column(1).to_pylist() for p in text_slices(batch, most=3, n_bytes=25)]
    assert [t for p in got for t in p] == texts
    assert got == [texts[:3], texts[3:4], texts[4:7], texts[7:]]
    assert [p.column(0).to_pylist() for p in text_slices(batch.slice(4), most=2, n_bytes=1 << 20)] == [[4, 5], [6, 7], [8]]
    assert list(text_slices(batch.slice(0, 0))) == []


def test_pieces_of_short_segments_follow_the_agenda(monkeypatch):
    """The list form of the agenda merges as the heap does, with ties and without."""
    import random

    from rugosa.llm import piece_bpe
    from rugosa.llm.queries import tokenizer

    model = piece_bpe.PieceBpe(tokenizer("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = ["", "▁", "aaaaaaa", "▁中x\n\n,,,"] + ["".join(rng.choices("▁aethinoséÉ.,\n$", k=rng.randint(1, 40))) for _ in range(500)]
    short = [model._merge_short(t) for t in texts]
    model.order = tied = {p: round(o, -3) for p, o in model.order.items()}
    short_tied = [model._merge_short(t) for t in texts]
    monkeypatch.setattr(piece_bpe, "SHORT", -1)
    assert short_tied == [model.merge(t) for t in texts] and len(set(tied.values())) < len(tied)
    model = piece_bpe.PieceBpe(tokenizer("piece_bpe_32k.model"))
    assert short == [model.merge(t) for t in texts]


def test_words_are_learned_once_whatever_follows():
    from rugosa.llm import piece_bpe, token_files
    from rugosa.llm.queries import tokenizer

    texts = ["so thinghe came", "so thinghe, came", "to thinghe.\nThe thinghe's <|endoftext|>x<|endoftext|> a_b é, 中. x̂,", "of thinghe$$$ (thinghe) they're, I²."]
    pieces = piece_bpe.Encoder(tokenizer("piece_bpe_32k.model"), "texts")
    merged, merge = [], pieces.model.merge
    pieces.model.merge = lambda t: merged.append(t) or merge(t)
    for t in texts:
        assert pieces.encode([t])[0].tolist() == pieces.library.encode(t)
    assert [t for t in merged if t.startswith("▁thinghe")] == ["▁thinghe"]

    files = token_files.SegmentEncoder(tokenizer("byte_bpe_50k.json"))
    asked, spaced = [], files.spaced
    files.spaced = lambda keys: asked.extend(keys) or spaced(keys)
    for t in texts:
        assert files.encode([t], 2) == files.whole([t])
    assert [k for k in asked if k.startswith("thinghe")] == ["thinghe"]


def test_texts_cut_by_arrow_and_by_python_agree():
    from rugosa.llm import piece_bpe, token_files

    texts = ["a b c", "a", "", " a b", "a  b", "a▁b c", "é b 中 c", "a b "]
    for own in ([t] for t in texts):
        heads, later = token_files.cut_texts(own)
        assert [heads[0], *later.to_pylist()[0]] == token_files.segments(own[0])
        assert piece_bpe.cut_texts(own).to_pylist() == [piece_bpe.segments(own[0])]
    assert piece_bpe.cut_texts(texts).to_pylist() == list(map(piece_bpe.segments, texts))
    assert token_files.cut_texts([])[1].to_pylist() == [] and piece_bpe.cut_texts([]).to_pylist() == []


def test_a_worker_frees_what_another_operator_left(make):
    """The encoder of a worker does not outlive tasks that need none."""
    from rugosa.llm import common
    from rugosa.llm.piece_bpe import digest_documents
    from rugosa.llm.queries import tokenizer

    table = make([(i, "some words here") for i in range(8)])

    def held():
        return lambda part: [(len(common._kept),) for _ in part]

    def left(keeps):
        return {r[0] for r in common.arrow_rows(common.id_text(table), "n int", ["n"], held, keeps=keeps).collect()}

    assert digest_documents(table, tokenizer("piece_bpe_32k.model")).count() == 8
    left(True)
    assert left(False) == {0}
    common.worker_object(("a",), list)
    assert common.worker_object(("a",), lambda: None) == [] and common.worker_object(("b",), dict) == {} and len(common._kept) == 1
    common.drop_worker_object()
    assert common._kept == {}


def test_profile_rows_may_go_by_number(spark):
    """Sets named by a number have the profile that they have by id."""
    import numpy as np

    from rugosa.llm import near_duplicates as N

    sets = [range(10), range(5, 20), range(100, 130), [7], range(100, 130)]
    rows = [(9**15 + i, np.array(s, dtype=np.int64).tobytes(), i) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "id long, set binary, number long")
    assert sorted(map(tuple, N.held_profile(table).collect())) == sorted(map(tuple, N.held_profile(table.drop("number")).collect()))
