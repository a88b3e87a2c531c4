import hashlib
import pickle
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.conftest import AWKWARD
from turnwise.llm import (
    binary,
    bpe,
    chat,
    common,
    components,
    embedding_dedup,
    encoder,
    licenses,
    mixing,
    near_dedup,
    quality,
    queries,
    token_counts,
    toxicity,
)

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [r[1] or "" for r in AWKWARD]


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_sql(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    rel = con.sql(sql)
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def in_order(df, *columns):
    return sorted((tuple(r[c] for c in sorted(columns or df.columns)) for r in df.collect()), key=repr)


# 1 ---------------------------------------------------------------------------------------------------------


def test_pack_and_unpack_every_width():
    v = np.array([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        assert (binary.unpack(*binary.pack(v[:n]), n) == v[:n]).all()


def test_token_files_round_trip(spark, awkward, empty):
    path = common.fresh_path(spark, "t")
    binary.write(awkward, path, JSON)
    got = {}
    for r in binary.read_back(spark, path).collect():
        got.setdefault(r["doc_id"], []).append(r)
    lib = Tokenizer.from_file(JSON)
    start = 0
    for i, text in sorted(((r[0], r[1] or "") for r in AWKWARD), key=lambda x: (x[0] is not None, x[0])):
        ids = lib.encode(text, add_special_tokens=False).ids + [2]
        r = next(x for x in got[i] if x["start"] == start)
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = common.fresh_path(spark, "t")
    binary.write(empty, path, JSON)
    assert binary.read_back(spark, path).count() == 0


def test_pieces_give_the_ids_of_whole_texts():
    r = random.Random(2)
    letters = "".join(map(chr, range(256))) + "中é 'st  \n"
    texts = TEXTS + ["".join(r.choice([r.choice(letters), " ", "ab", "<|endoftext|>"]) for _ in range(r.randrange(80))) for _ in range(3000)]
    lib = Tokenizer.from_file(JSON)
    e = encoder.PieceEncoder(JSON)
    for got, want in zip(e.encode(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, e.dtype).tolist() == want.ids


def thue_morse(n):
    """Words of two letters and their complements, which collide under any running polynomial modulo 2^64."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_pieces_are_told_apart_by_their_bytes(monkeypatch):
    lib = Tokenizer.from_file(JSON)
    for n in (16, 1024, 2048, 4096):
        x, y = thue_morse(n)
        texts = [x, y, f"{x} {y}", f"é{y} {x}", "".join(["ab\0", "ab"])]
        e = encoder.PieceEncoder(JSON)
        for got, t in zip(e.encode(texts), texts):
            assert np.frombuffer(got, e.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids
        first, *rest = bpe.Words(public_tokenizers.PATTERN).numbered([x, y])[0].tolist()
        assert [first] != rest
        assert near_dedup.word_hashes(x) != near_dedup.word_hashes(y)
    # even where hashes say nothing
    texts = [" ".join(f"w{i % 97} longer{i % 89}thanfifteenbytes" for i in range(k, k + 400)) for k in range(3)]
    monkeypatch.setattr(encoder, "mixed_bits", lambda h: h & np.uint64(3))
    monkeypatch.setattr(bpe, "mixed_bits", lambda h: h & np.uint64(3))
    e, words, new = encoder.PieceEncoder(JSON), bpe.Words(public_tokenizers.PATTERN), []
    for t, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, e.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids
        at, _, fresh = words.numbered([t])
        new += fresh
        assert b"".join(new[i] for i in at) == t.encode()


# 2 ---------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["toxic"] for r in common.read(spark, "/root/testdata/sf0.01", "labels").collect()}
    rows = [r for r in queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(p == y for p, y in known) / len(known)
    assert right > 0.93 and sum(p > y for p, y in known) <= 0.02 * len(known)


def test_toxicity_tolerates_gaps_and_signs():
    r = random.Random(1)
    word = lambda: "".join(r.choice(["ba", "lo", "ti", "er", "an"]) for _ in range(r.randrange(1, 4)))
    clean = [" ".join(word() for _ in range(30)) for _ in range(120)]
    bad = [c + f" {r.choice(['grumblix', 'zorkface'])} and {r.choice(['grumblix', 'zorkface'])}" for c in clean[:60]]
    m = toxicity.fit(clean[60:] + bad, [False] * 60 + [True] * 60)
    assert m.scores(["lo ba g r u m b l i x ti ti z.o.r.k.f.a.c.e", "an er grum-bl.ix, zork*face"]).min() > 0.7
    low, slipped = m.scores([clean[0], "lo ba grumqblix zorkjface an"])
    assert low < 0.3 and slipped > 10 * low


def test_kernel_against_counting():
    """The folded table and the landmarks' kernel, against subsequences counted one by one."""
    from itertools import combinations

    r = random.Random(8)
    words = [bytes([0, *(r.randrange(1, 27) for _ in range(r.randrange(3, 9))), 0]) for _ in range(40)]
    words += [words[0][:3] + bytes([5]) + words[0][3:], words[1]]

    def weights(w):
        out = {}
        for at in combinations(range(len(w)), 4):
            if at[3] - at[0] <= toxicity.REACH:
                key = tuple(w[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[3] - at[0] - 3)
        return out

    def norm(w):  # by length, as the operator has it: of each subsequence by itself
        return sum(toxicity.DECAY ** (2 * (at[3] - at[0] - 3)) for at in combinations(range(len(w)), 4) if at[3] - at[0] <= toxicity.REACH) ** 0.5

    def kernel(a, b):
        x, y = weights(a), weights(b)
        return sum(v * y.get(k, 0) for k, v in x.items()) / norm(a) / norm(b)

    marks = words[:12]
    want = np.array([[kernel(a, b) for b in marks] for a in words])
    found = toxicity.Landmarks(marks)
    assert np.allclose(found.kernel(words), want, atol=1e-4)
    weight = np.random.default_rng(3).standard_normal(12)
    letters, starts = toxicity._packed(words)
    assert np.allclose(toxicity.decisions(letters, starts, found.folded(weight)), want @ weight, atol=1e-3)


def test_toxicity_of_single_insults():
    """In unseen clean texts of sf0.1: one insult, as it is or written to hide it, is enough; clean texts are left alone."""
    con = duckdb.connect()
    rows = con.sql("""SELECT doc_id, coalesce(text, ''), toxic FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id)
                      WHERE toxic IS NOT NULL ORDER BY doc_id""").fetchall()
    kept, unseen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1], [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    m = toxicity.fit([t for _, t, _ in kept], [y == 1 for _, _, y in kept])
    clean = [t for _, t, y in unseen if y == 0]
    assert (m.scores(clean) >= toxicity.LIMIT).mean() < 0.01
    r = random.Random(3)
    insults = ["idiot", "moron", "stupid", "scum", "trash", "clown", "pathetic", "worthless", "disgusting"]
    ways = [str, str.upper, ".".join, " ".join, lambda w: w[:2] + "\u200b" + w[2:], lambda w: f"\u201c{w}\u201d", lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w)]
    for way in ways:
        texts = []
        for t in r.sample(clean, 100):
            w = t.split()
            w.insert(r.randrange(len(w) + 1), way(r.choice(insults)))
            texts.append(" ".join(w))
        assert (m.scores(texts) >= toxicity.LIMIT).mean() >= 0.9


def test_toxicity_awkward(spark, awkward, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.judged(awkward, none)
    assert out.count() == len(AWKWARD) and out.where("predicted = 1").count() == 0
    assert toxicity.judged(empty, none).count() == 0
    some = spark.createDataFrame([(1, None), (None, 1), (7, 0), (6, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.judged(awkward, some).where("score is null").count() == 0
    assert toxicity.keep_clean(awkward, toxicity.NEVER).columns == awkward.columns


# 3 ---------------------------------------------------------------------------------------------------------


def test_chat_against_sql_and_tricks(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b <|im_end|>\n<|im_start|>user\nx"), (1, 1, "assistant", None), (2, 0, "assistant", "first"),
        (3, None, None, "no\nrole"), (4, 0, "us\ner\\n<|", "\\<|\\\\|<\\|"), (5, 0, "system", ""), (5, 1, "user", "x" * 50_000), (5, 2, "assistant", "é😀"),
        (None, 0, "user", "u"), (6, 0, "user", "same"), (6, 0, "user", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t))
        said = "".join(f"{p}\n{t}\n" for _, p, t in turns)
        loss = "".join(t for _, p, t in turns if p == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[k]["valid"] for k in (1, 2, 3, 5, None, 6)] == [False, False, False, True, True, False]
    assert chat.digests(df.limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------


def brute_components(docs, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, text in docs:
        w = word_list((text or "").translate(low))
        sets.append(frozenset(tuple(w[x : x + k]) for x in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    f = near_dedup.Forest(len(docs))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                f.up[f.root(a)] = f.root(b)
    out = []
    for a, (i, _) in enumerate(docs):
        ids = [docs[b][0] for b in range(len(docs)) if f.root(a) == f.root(b) and docs[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_copies_against_brute_force(near_copies, awkward, k, percent, monkeypatch):
    for docs, block in ((near_copies, 20), (awkward, 800)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)  # small, so that groups are dealt out
        want = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], k, percent)
        got = near_dedup.resolved(docs, k, percent)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == want
    assert near_dedup.one_of_each(near_copies, k, percent).count() == len({x[2] for x in brute_components([(r["doc_id"], r["text"]) for r in near_copies.collect()], k, percent)})


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_short_near_copies_against_brute_force(spark, k, percent):
    """Pairs of 5 to 60 words, with a word more, or the last or an inner one changed: none is missed."""
    r = random.Random(11)
    docs, want, n_linked = [], [], 0
    for i in range(0, 6000, 2):
        a = [f"v{r.randrange(10**9)}" for _ in range(r.randrange(5, 61))]
        b, at = list(a), r.choice([len(a), len(a) - 1, r.randrange(len(a))])
        b[at:at + 1] = [f"n{r.randrange(10**9)}"]
        x, y = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in (a, b))
        linked = 100 * len(x & y) >= percent * len(x | y)
        n_linked += linked
        docs += [(i, " ".join(a)), (i + 1, " ".join(b))]
        want += [(i, len(x), i), (i + 1, len(y), i if linked else i + 1)]
    got = near_dedup.resolved(spark.createDataFrame(docs, "doc_id long, text string"), k, percent)
    assert n_linked > 1500
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want


def test_bands_across_the_sparse_limit(monkeypatch):
    """Sets on both sides of the limit share bands, as do those over it."""
    monkeypatch.setattr(near_dedup, "SPARSE", 900)
    r = np.random.default_rng(4)
    for n in (700, 880, 899, 901, 1000, 1058, 1200):
        s = np.unique(r.integers(0, 2**64, n, np.uint64))
        for part in (s[r.permutation(n)[: -(-85 * n // 100)]], s[r.permutation(n)[: n - 1]]):
            assert set(near_dedup.band_keys(s, 85)) & set(near_dedup.band_keys(np.sort(part), 85))


def test_near_copies_of_null_and_repeated_ids(spark):
    """Rows without an id link others; texts of one id are each linked; of a component of null ids one stays."""
    r = random.Random(21)
    a, c, z = ([f"v{r.randrange(10**9)}" for _ in range(60)] for _ in range(3))
    less = lambda w, n: " ".join(w[n:])
    x, y = thue_morse(2048)
    docs = [(7, less(a, 0)), (None, less(a, 6)), (8, less(a, 11)), (5, less(c, 0)), (5, less(z, 0)), (2, less(c, 3)), (None, less(z, 2))]
    docs += [(None, f"alone {i} {r.randrange(10**9)} in its own way of words") for i in range(60)] + [(None, "the same text here twice")] * 2
    docs += [(31, f"{x} and some more words"), (30, f"{y} and some more words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 85), (5, 80)):
        want = brute_components(docs, k, percent)
        got = near_dedup.resolved(df, k, percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == want
    assert dict((i, c) for i, _, c in want if i in (7, 8, 30, 31)) == {7: 7, 8: 7, 30: 30, 31: 31}
    rows = [tuple(r) for r in near_dedup.one_of_each(df).collect()]
    assert sorted((r for r in rows if r[0] is not None), key=repr) == sorted([(7, less(a, 0)), (2, less(c, 3)), (5, less(z, 0)), docs[-2], docs[-1]], key=repr)
    assert len([r for r in rows if r[0] is None]) == 61


def test_near_copies_awkward(awkward, empty):
    assert near_dedup.resolved(empty).count() == 0
    one = near_dedup.one_of_each(awkward)
    ids = sorted(str(r["doc_id"]) for r in one.collect())
    assert one.columns == awkward.columns and ids == sorted(map(str, [1, 10, 11, 2, 3, 4, 5, 6, 7, 8, None]))


def test_registers_estimate_the_similarity():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 2**64, 4000, np.uint64), r.integers(0, 2**64, 4000, np.uint64)
    x, y = near_dedup.registers(np.unique(a)), near_dedup.registers(np.unique(np.concatenate([a[:3000], b[:1000]])))
    assert abs((x == y).mean() - 3000 / 5000) < 0.12


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    r.shuffle(links)
    df = spark.createDataFrame([p if r.random() < 0.5 else p[::-1] for p in links], "u long, v long")
    got = {x["node"]: x["component"] for x in components.components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}


# 5 ---------------------------------------------------------------------------------------------------------


def test_quality_against_sql(awkward, empty):
    some = awkward.where("doc_id not in (1, 6)")  # by SQL the long text takes minutes
    assert in_order(quality.judged(some)) == by_sql(quality.OP5_SQL, documents=some.select("doc_id", "text"))
    r = quality.judged(awkward.where("doc_id = 6")).first()
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (20_000, 20_000, True)
    assert quality.judged(empty).count() == 0
    kept = quality.keep_clean(awkward)
    want = {r["doc_id"] for r in quality.judged(awkward).where("kept").collect()}
    assert kept.columns == awkward.columns and {r["doc_id"] for r in kept.collect()} == want


def test_quality_keeps_clean_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.read(spark, sf, "labels").where("quality is not null")
    got = quality.judged(common.read(spark, sf, "documents")).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert all(r["kept"] for r in got if r["quality"] == 1)
    assert sum(r["kept"] for r in got if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in got)


# 6 ---------------------------------------------------------------------------------------------------------


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 25)
    r = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, 2):
        centre = r.standard_normal((6, 10))
        for c in centre:
            for _ in range(20):
                v = c + r.standard_normal(10) * r.choice([0.0, 0.1, 0.4])
                rows.append((n, [float(x) for x in v.astype(np.float32)], label))
                n += 1
    bad = [None, [], [0.0] * 10, [1.0] * 9 + [None], [1.0] * 9 + [float("nan")], [float("inf")] * 10, [1.0] * 4]
    rows += [(n + i, v, 0) for i, v in enumerate(bad)] + [(n + 50, [1.0] * 10, None), (n + 51, [1.0] * 10, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    good = [x for x in rows if x[0] < n]
    f = near_dedup.Forest(len(good))
    links = np.zeros(len(good), int)
    for a in range(len(good)):
        for b in range(a):
            u, v = np.array(good[a][1]), np.array(good[b][1])
            if good[a][2] == good[b][2] and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
                links[a] += 1
                links[b] += 1
                f.up[max(f.root(a), f.root(b))] = min(f.root(a), f.root(b))
    want = [(i, int(links[i]), f.root(i)) for i in range(len(good))] + [(x[0], 0, x[0]) for x in rows if x[0] >= n]
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in embedding_dedup.resolved(df).collect())
    assert links.sum() > 100 and got == want
    assert embedding_dedup.resolved(df.limit(0)).count() == 0


def test_embeddings_of_null_and_repeated_ids(spark):
    turn = lambda t: [float(np.cos(t)), float(np.sin(t))]
    rows = [(1, turn(0.0), 0), (None, turn(0.1), 0), (9, turn(2.0), 1), (5, turn(0.0), 2), (5, turn(0.05), 2), (6, turn(0.1), 2), (None, turn(1.0), 3), (None, turn(1.0), 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in embedding_dedup.resolved(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (None, 1, 1), (9, 0, 9), (5, 2, 5), (5, 2, 5), (6, 2, 5), (None, 1, None), (None, 1, None)], key=repr)


# 7 ---------------------------------------------------------------------------------------------------------


def test_counts_and_cache(spark, awkward, empty, monkeypatch):
    cache = common.fresh_path(spark, "cache")
    assert token_counts.counted(empty, JSON, cache).count() == 0
    lib = Tokenizer.from_file(JSON)
    want = sorted(((i, len((t or "").encode()), n, n > 512) for i, t, *_ in AWKWARD for n in [len(lib.encode(t or "", add_special_tokens=False).ids)]), key=repr)
    get = lambda: sorted((tuple(r) for r in token_counts.counted(awkward, JSON, cache).collect()), key=repr)
    assert get() == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, *_ in AWKWARD})
    assert get() == want and spark.read.parquet(cache).count() == stored  # nothing is encoded again


def test_each_content_is_encoded_once(spark, tmp_path, monkeypatch):
    """Repeated rows, copies and null ids: the encoder, which writes down what it is asked, sees a content once."""
    log = str(tmp_path / "asked")

    class Noting:
        dtype = np.dtype("<u2")

        def encode(self, texts):
            with open(log, "a") as f:
                f.writelines(f"{zlib.crc32(t.encode())}\n" for t in texts)
            return [b"00" * len(t) for t in texts]

    made = Noting()
    monkeypatch.setattr(token_counts, "encoder", lambda path: made)
    rows = [(i % 7 if i % 3 else None, f"text {i % 11}") for i in range(400)] + [(1, "the same")] * 50 + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    cache = common.fresh_path(spark, "cache")
    for _ in range(2):
        out = token_counts.counted(df, JSON, cache)
        assert out.count() == len(rows)
    with open(log) as f:
        asked = f.read().split()
    assert len(asked) == len(set(asked)) == len({t or "" for _, t in rows})


def test_counts_of_other_tokenizers(spark, awkward):
    import sentencepiece

    pieces = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces)
    got = token_counts.counted(awkward, pieces, common.fresh_path(spark, "cache"))
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=repr) == sorted(((i, len(lib.encode(t or ""))) for i, t, *_ in AWKWARD), key=repr)
    words = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(words)
    got = token_counts.counted(awkward, words, common.fresh_path(spark, "cache"))
    want = [(i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in AWKWARD]
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


# 8 ---------------------------------------------------------------------------------------------------------


def test_byte_bpe_against_the_library(awkward, empty):
    ranks = bpe.ranks_of(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in AWKWARD:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = bpe.encoded(awkward, RANKS, public_tokenizers.PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encoded(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_merges_of_long_words():
    ranks = bpe.ranks_of(RANKS)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(6)
    for _ in range(200):
        w = bytes(r.choice(b"abcthein  \xc3\xa9") for _ in range(r.randrange(1, 200)))
        assert bpe.merge_heap(w, ranks) == lib._encode_single_piece(w)


def test_words_are_numbered_anew(awkward, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 10)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    got = sorted(map(repr, bpe.encoded(awkward, RANKS, public_tokenizers.PATTERN).collect()))
    monkeypatch.undo()
    assert got == sorted(map(repr, bpe.encoded(awkward, RANKS, public_tokenizers.PATTERN).collect()))


# 9 ---------------------------------------------------------------------------------------------------------


def test_mixing_against_sql(awkward, empty):
    docs = awkward.select("doc_id", "text", "source")
    got = [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in in_order(mixing.taken(docs))]
    want = [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in by_sql(mixing.OP9_SQL, documents=docs)]
    assert got == want
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixing_meets_targets_and_repeats(spark):
    docs = common.read(spark, SF, "documents")
    one, two = in_order(mixing.taken(docs)), in_order(mixing.taken(docs.repartition(5)))
    assert one == two
    t = mixing.taken(docs)
    by = t.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t"), F.max("size").alias("most"))
    assert all(abs(r["n"] - r["t"]) <= r["most"] / 2 + 1 for r in by.collect())
    assert t.where("taken > 2 * size").count() == 0
    words = mixing.mixed(docs).agg(F.sum(mixing.size_of())).first()[0]
    assert words == t.agg(F.sum("taken")).first()[0] and mixing.mixed(docs).columns == docs.columns


def test_mixing_among_rows_of_one_id(spark):
    """The cut falls among texts of one id, among rows without one, and among rows alike in all."""
    texts = {"a": [(1, f"w{i} " * 10) for i in range(100)], "b": [(None, f"w{i} " * 10) for i in range(100)], "c": [(None, "x " * 10)] * 100}
    docs = [(i, t, s) for s, rows in texts.items() for i, t in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    got = mixing.taken(df)
    by = {r["target"]: r["n"] for r in got.groupBy("target").agg(F.sum("taken").alias("n")).collect()}
    assert all(abs(n - t) <= 5 for t, n in by.items()) and sum(by.values()) in range(4480, 4521)
    want = by_sql(mixing.OP9_SQL, documents=df)
    near = lambda rows: [tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows]
    assert near(in_order(got)) == near(want)
    assert mixing.mixed(df).agg(F.sum(mixing.size_of())).first()[0] == sum(by.values())


# 10 --------------------------------------------------------------------------------------------------------


def test_licenses_against_sql(spark, awkward, empty):
    """All windows against all templates: bands lose nothing, whole licences and notices are found."""
    r = random.Random(9)
    docs = [(i, t, None) for i, t, *_ in AWKWARD]
    for i in range(90):  # templates within text, with a few words changed
        name, text = r.choice(licenses.template_rows())
        w = text.split()
        for _ in range(r.randrange(0, 1 + len(w) // 25)):
            w[r.randrange(len(w))] = "changed"
        around = [f"v{r.randrange(99)}" for _ in range(r.randrange(0, 90))]
        at = r.randrange(len(around) + 1)
        docs.append((100 + i, " ".join(around[:at] + w + around[at:]), "x"))
    df = spark.createDataFrame(docs, "doc_id long, text string, license string").repartition(5)
    got = in_order(licenses.scanned(df))
    assert len(got) > 90 and got == by_sql(licenses.OP10_SQL, documents=df.select("doc_id", "text"))
    assert len({x[2] for x in got}) > 15
    assert licenses.scanned(empty).count() == 0


def test_licenses_of_a_table(spark, awkward):
    """Templates may be null, empty, short or alike; and no more than one scan takes."""
    rows = [(None, "the cat sat on the mat and"), ("a", "the cat sat on the mat and"), ("b", None), ("c", "too short"), ("d", "")]
    t = spark.createDataFrame(rows, "license string, text string")
    got = licenses.scanned(awkward, t).collect()
    assert {r["doc_id"] for r in got} == {1, 9} and all(r["containment"] == 1 for r in got)
    assert licenses.scanned(awkward, t.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scanned(awkward, spark.range(licenses.MOST + 1).selectExpr("id AS license", "'x' AS text"))


# the queries and the pipeline ------------------------------------------------------------------------------


def test_native_operators_run_no_python(spark):
    import io
    from contextlib import redirect_stdout

    for df in (queries.op3_chat_format(spark, SF), queries.op5_quality_rules(spark, SF), queries.op10_license_scan(spark, SF)):
        out = io.StringIO()
        with redirect_stdout(out):
            df.explain()
        assert not re.search("Python|Pandas|InArrow", out.getvalue())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in sorted(df.columns)]
    near = lambda row: tuple(round(x, 4) if isinstance(x, float) else x for x in row)
    assert [near(r) for r in in_order(df)] == sorted((near([r[i] for i in at]) for r in rel.fetchall()), key=repr)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = common.read(spark, SF, "documents")
    steps = {}
    for name, stage in p.STAGES:
        docs = common.written(stage(spark, docs, SF), "test")
        steps[name] = docs
    first = common.read(spark, SF, "documents")
    model = toxicity.trained(first, common.read(spark, SF, "labels"))
    clean = {r["doc_id"] for r in toxicity.scored(first, model).where("score < 0.7").collect()}
    assert {r["doc_id"] for r in steps["toxicity"].collect()} == clean
    good = {r["doc_id"] for r in quality.judged(steps["toxicity"]).where("kept").collect()}
    assert {r["doc_id"] for r in steps["quality"].collect()} == good
    want = brute_components([(r["doc_id"], r["text"]) for r in steps["quality"].collect()], 5, 80)
    assert {r["doc_id"] for r in steps["near_dedup"].collect()} == {i for i, _, c in want if i == c}
    assert all(steps[n].columns == first.columns for n in ("toxicity", "quality", "near_dedup", "mixing"))
    assert steps["byte_bpe"].count() == steps["mixing"].count()
    taken = mixing.taken(steps["near_dedup"]).where("size > 0").agg(F.sum(F.col("taken") / F.col("size"))).first()[0]
    assert steps["mixing"].where("trim(text) <> ''").count() == taken


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, tmp_path):
    """Nulls, empty and long texts, repeated rows, null ids: every stage gives what its docstring says."""
    import corpus_pipeline as p

    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    out = p.run(spark, str(tmp_path / "some")).collect()
    passed = quality.keep_clean(docs)
    want = mixing.taken(near_dedup.one_of_each(passed)).collect()
    size = {r["doc_id"]: (r["taken"] // r["size"]) if r["size"] else 0 for r in want}
    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got and got == {k: n for k, n in size.items() if n}
    assert all(len(r["ids_sha256"]) == len(r["decoded_sha256"]) == 64 for r in out)
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def _workers(spark) -> list[int]:
    """MB of each Python worker."""
    import os

    root = int(spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid())
    of = {int(p): open(f"/proc/{p}/stat").read().rsplit(")", 1)[1].split() for p in os.listdir("/proc") if p.isdigit()}
    inside = lambda p: p == root or p in of and inside(int(of[p][1]))
    return sorted(int(of[p][21]) * os.sysconf("SC_PAGESIZE") >> 20 for p in of if p != root and inside(p))


def test_workers_give_back_the_memory_of_a_fit(spark):
    """A worker is used again and waits in a pool, so what a task has freed must not stay with it."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    data = [(i, " ".join(word() for _ in range(250)) + " vexatrix" * (i % 4 == 0), int(i % 4 == 0)) for i in range(2400)]
    rows = spark.createDataFrame(data, "doc_id long, text string, toxic int").repartition(4).cache()
    rows.mapInArrow(lambda batches: batches, rows.schema).count()
    before = _workers(spark)
    toxicity.trained(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    rows.unpersist()
    after = _workers(spark)
    assert after[-1] < before[-1] + 60, (before, after)


def test_a_child_process_returns_or_fails():
    assert pickle.loads(toxicity._by_child(len, "abc")) == 3
    with pytest.raises(RuntimeError):
        toxicity._by_child(len, 3)


def _awkward_links(seed: int) -> list[tuple]:
    """Chains, stars, rings and random links, repeated, reversed and from a node to itself, with negative ids."""
    r = random.Random(seed)
    ids = list({r.randrange(-(2**62), 2**62) for _ in range(900)})
    r.shuffle(ids)
    got = [(ids[i], ids[i + 1]) for i in range(0, 200)]
    got += [(ids[300], ids[i]) for i in range(301, 400)] + [(ids[499], ids[i]) for i in range(400, 499)]
    got += [(ids[500 + i], ids[500 + (i + 1) % 60]) for i in range(60)]
    got += [(r.choice(ids[600:]), r.choice(ids[600:])) for _ in range(150)]
    got += [(v, u) for u, v in r.sample(got, 80)] + [(ids[7], ids[7])] + r.sample(got, 50)
    r.shuffle(got)
    return got


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    links = _awkward_links(5)
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in links:
        a, b = sorted((root(u), root(v)))
        up[b] = a
    want = {x: root(x) for x in up if root(x) != x}
    got = components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()
    assert len(got) == len(want) and {x["node"]: x["component"] for x in got} == want
    assert components.components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_few_links_take_few_stages(spark):
    """The driver keeps record of each stage and task: rounds over a long chain had some hundreds."""
    sc = spark.sparkContext
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    sc.setJobGroup("few-links", "components")
    try:
        assert components.components(chain).where("component = 0").count() == 300
        jobs = sc.statusTracker().getJobIdsForGroup("few-links")
        assert sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs) <= 15
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
