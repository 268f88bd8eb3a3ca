"""Operators against plain brute-force versions of themselves."""

import base64
import hashlib
import heapq
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from pyspark.sql import functions as F

import corpus_pipeline
from busnet.llm import bpe, decontam, hashing, induced, minhash, queries, sharding, suffix, topk, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")


def _shingles(text, size):
    w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def _components(sets, percent):
    ids = sorted(sets)
    root = {i: i for i in ids}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = root[i], root[j]
                root = {x: (min(a, b) if r in (a, b) else r) for x, r in root.items()}
    return root


def test_near_copies_that_form_one_family(spark):
    """Copies with a few changed words each: linked in chains, many pairs just below the threshold."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = base[:]
        for _ in range(rng.randrange(7)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.Similarity(shingle=4)).collect()}
    assert found == _components({i: _shingles(t, 4) for i, t in rows}, 80)


def test_sketch_agrees_with_the_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = minhash.sketch(pool[:800], 128), minhash.sketch(pool[100:], 128)
    assert abs((a == b).mean() - 700 / 900) < 0.12
    assert (minhash.sketch(pool[:1], 128) < 2**64 - 1).all()  # one element fills every coordinate


def test_decontamination_windows(spark):
    """Every window with a similarity of 0.8 or more, and no other document."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(50)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 60)))) for i in range(12)]
    rows = []
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 40))]
        if i % 3:
            inside = rng.choice(items)[1].split()
            if i % 3 == 2:
                inside[rng.randrange(2)] = "changed"
            text += inside + [word() for _ in range(rng.randrange(10))]
        rows.append((i, " ".join(text)))
    found = {(r.doc_id, r.item_id) for r in decontam.matches(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    wanted = set()
    for doc, text in rows:
        w = text.split()
        for item, passage in items:
            p = passage.split()
            if any(decontam.similarity(bag(w[s : s + len(p)]), bag(p)) >= 0.8 for s in range(len(w) - len(p) + 1)):
                wanted.add((doc, item))
    assert found == wanted and len(wanted) > 70


def test_documents_shorter_than_the_item(spark):
    """An item without some of its first or last words, alone in its document: found as far as the similarity goes."""
    items = [(i, " ".join(f"i{i}w{k}" for k in range(n))) for i, n in enumerate((24, 60, 100))]
    cut = [(i, a, b) for i, (_, t) in enumerate(items) for a in (0, 1, 5) for b in (0, 1, 2, 9, 14, 20)]
    rows = [(d, " ".join(items[i][1].split()[a : len(items[i][1].split()) - b])) for d, (i, a, b) in enumerate(cut)] + [(900, "i0w0 i0w1 i0w2"), (901, "")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted = {}
    for d, (i, a, b) in enumerate(cut):
        whole = len(items[i][1].split()) - 4
        left = whole - a - b
        if left > 0 and left / whole >= 0.8:
            wanted[d] = (i, 0, left + 4, round(left / whole, 9))
    found = [(r.doc_id, (r.item_id, r.at, r.n_words, round(r.similarity, 9))) for r in decontam.matches(docs, benchmark).collect()]
    assert dict(found) == wanted and len(found) == len(wanted)
    assert {r.doc_id for r in decontam.clean(docs, benchmark).collect()} == {d for d, _ in rows} - set(wanted)


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60))
        plain = sorted(range(len(text)), key=lambda i: text.tolist()[i:])
        order = induced.suffix_array(text)
        assert order.tolist() == plain
        shared = induced.permuted_common_prefixes(text, order, 7)
        for a, b in zip(plain[1:], plain):
            n = 0
            while n < 7 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[a] == n


def test_names_are_sorted_in_rounds():
    """The suffix array of half a megabyte costs no walk over the names of its substrings."""
    rng = np.random.default_rng(2)
    text = rng.integers(1, 28, 500000)
    numbers = list(range(len(text)))

    def least(work):
        took = []
        for _ in range(3):
            begun = time.process_time()
            work()
            took.append(time.process_time() - begun)
        return min(took)

    # 52 times as long as the sum when lists were walked, now 11 times
    assert least(lambda: induced.suffix_array(text)) < 24 * least(lambda: sum(n for n in numbers))
    names = np.append(rng.integers(1, 3, 500), 0)
    for some in (names, np.append(np.ones(300, np.int64), 0), np.zeros(1, np.int64)):
        assert induced.sort_names(some).tolist() == sorted(range(len(some)), key=lambda i: some.tolist()[i:])


def test_segments_by_anchor():
    """Whatever the blocks, equal windows have one anchor, all windows are in a segment, and anchors can be picked."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99 + i % 5, n).astype(np.uint8) for i, n in enumerate([0, 49, 50, 51, 700, 3000, 120, 200000, 90])]
    texts += [texts[4][100:600], np.full(1500, 97, np.uint8), texts[7][131000:131200]]
    data, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    rule = suffix.Settings()
    doc, start, windows, anchor = suffix.segments(data, offsets, rule)
    assert windows.max() <= rule.most
    seen, of = np.zeros(len(data), int), {}
    for d, s, w, a in zip(doc.tolist(), start.tolist(), windows.tolist(), anchor.tolist()):
        assert offsets[d] <= s and s + w + rule.length - 1 <= offsets[d + 1]
        seen[s : s + w] += 1
        for k in range(s, s + w):
            assert of.setdefault(data[k : k + rule.length].tobytes(), a) == a
    full = np.zeros(len(data), int)
    for a, b in zip(offsets, offsets[1:]):
        full[a : max(a, b - rule.length + 1)] = 1
    assert (seen == full).all()
    for some in (np.unique(anchor)[::3], np.array([5, 2**64 - 1], np.uint64), np.zeros(0, np.uint64)):
        mine = np.isin(anchor, some)
        for got, want in zip(suffix.segments(data, offsets, rule, some[::-1]), (doc, start, windows, anchor)):
            assert got.tolist() == want[mine].tolist()


def test_hashes_of_short_strings():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    for k in (1, 3, 7, 8, 9, 16, 20, 24):
        found = hashing.kgrams(data, k)
        plain = [data[i : i + k].tobytes() for i in range(len(data) - k + 1)]
        assert len(found) == len(plain) and len(set(zip(plain, found.tolist()))) == len(set(plain)) == len(np.unique(found))


def test_removed_bytes_of_texts_that_repeat_themselves(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choice("ab") for _ in range(80)) for _ in range(6)] + ["a" * 900, "ab" * 400]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(4))) + "xyz"[: i % 3]) for i in range(60)]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), suffix.Settings(batch=4096)).collect()}
    for i, text in rows:
        earlier = {t[k : k + 50] for j, t in rows if j < i for k in range(len(t) - 49)}
        gone = np.zeros(len(text) + 1, bool)
        for k in range(len(text) - 49):
            if text[k : k + 50] in earlier:
                gone[k : k + 50] = True
        assert found[i] == (gone.sum(), (gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum() if len(text) else 0)


def test_segments_are_the_maximal_ones():
    def recursive(scores, at=0):
        best = None
        for i in range(len(scores)):
            for j in range(i + 1, len(scores) + 1):
                s = sum(scores[i:j])
                if s > 0 and (best is None or s > best[2]):
                    best = (i, j, s)
        if best is None:
            return []
        i, j, s = best
        return recursive(scores[:i], at) + [(at + i, at + j, s)] + recursive(scores[j:], at + j)

    rng = random.Random(4)
    for _ in range(200):
        # distinct powers keep sums apart, so the best segment is unique
        scores = [rng.choice((-1, 1)) * rng.randrange(1, 1000) + rng.random() for _ in range(rng.randrange(12))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == [(a, b) for a, b, _ in recursive(scores)]


def test_toxicity_held_out(spark):
    """On sf 0.1: with the 40 toxic rows of sf 0.01 there is little to learn from or to count."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert len(rows) > 900 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.7


def test_language_held_out(spark):
    found = queries.op8_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.collect())


def test_bpe_is_that_of_the_public_library(documents):
    path = public_tokenizers.path(queries.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN)
    find = regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(1)
    texts = list(documents.text) + ["a" * 3000, "x1" * 500, " \n\t\x1c\x85\xa0  end"]
    texts += ["".join(rng.choice(" \naZé中٣!'s​😀" + chr(rng.randrange(32, 0xD7FF))) for _ in range(50)) for _ in range(300)]
    for text in texts:
        ids, _ = codec.encode(find(text))
        assert ids.tolist() == theirs.encode_ordinary(text)
        assert codec.decode(ids).tobytes() == text.encode()


def test_perfect_hash_is_minimal():
    keys = hashing.mix(np.arange(5000, dtype=np.uint64))
    assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(5000))


def test_schedule_is_that_of_one_group_at_a_time():
    rng = random.Random(8)
    for _ in range(50):
        sizes = sorted({rng.randrange(1, 60) for _ in range(12)}, reverse=True)
        counts = [rng.randrange(1, 90) for _ in sizes]
        queue, plain = sharding.LeastLoaded(5), [(0, s) for s in range(5)]
        for size, count in zip(sizes, counts):
            given = [0] * 5
            for _ in range(count):
                load, s = plain[0]
                heapq.heapreplace(plain, (load + size, s))
                given[s] += 1
            assert queue.place(size, count) == given


def test_shards(spark, documents):
    found = queries.op10_sharding(spark, SF).toPandas().set_index("doc_id")
    assert len(found) == len(documents)
    for doc, text in documents.text.items():
        assert found["size"][doc] == len(text.encode()) + 1 and found.text_crc32[doc] == zlib.crc32(text.encode())
    assert (found.groupby(documents.text).shard.nunique() == 1).all()
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    loads = [(0, s) for s in range(16)]
    for size in sorted(found.groupby(documents.text)["size"].sum(), reverse=True):
        heapq.heapreplace(loads, (loads[0][0] + size, loads[0][1]))
    assert found.groupby("shard")["size"].sum().to_dict() == {s: load for load, s in loads}


def test_search_in_many_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-3, 4, 5) / 8).tolist()) for i in range(300)]
    found = topk.search(spark.createDataFrame(rows, "id long, embedding array<double>"), F.col("id") % 20 == 0, topk.Settings(k=7, pivots=6, sample=40, block=64)).collect()
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows}
    for q in range(0, 300, 20):
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:7]
        assert sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]


def test_pipeline(spark, documents):
    """The rows of run() against a plain version of each stage."""
    found = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    texts = {int(d): t for d, t in documents.text.items() if any(c.isalpha() for c in t)}
    seen, cut = set(), {}
    for doc in sorted(texts):
        all_lines = texts[doc].split("\n")
        counted = [i for i, x in enumerate(all_lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for a, b in zip(counted, counted[1:]):
            key = (all_lines[a], all_lines[b])
            if key in seen:
                gone |= {a, b}
            seen.add(key)
        for a in counted:
            if len(all_lines[a].split()) >= 13:
                if all_lines[a] in seen:
                    gone.add(a)
                seen.add(all_lines[a])
        if not counted or gone != set(counted):
            cut[doc] = "\n".join(x for i, x in enumerate(all_lines) if i not in gone)
    root = _components({d: _shingles(t, 5) for d, t in cut.items()}, 80)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items = [r.text.lower().split() for r in benchmark]
    wanted = {}
    for doc, text in cut.items():
        w = text.lower().split()
        mine = set(bag(w))
        dirty = any(
            mine & set(bag(p)) and any(decontam.similarity(bag(w[s : s + len(p)]), bag(p)) >= 0.8 for s in range(len(w) - len(p) + 1)) for p in items
        )
        if root[doc] == doc and not dirty:
            wanted[doc] = text
    assert set(found) == set(wanted)
    assert all(found[d][1] == hashlib.sha256(t.encode()).hexdigest() for d, t in wanted.items())
