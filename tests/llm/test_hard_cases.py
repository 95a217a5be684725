"""Texts that break careless hashing, and texts so long that only linear work ends."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwright.llm import common, line_clean, minhash, secrets, shard, suffix_index, token_orc, unigram, url_trie, warc
from tests_llm_brute import brute_repeats

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


class Constant:
    """A hash under which all slices collide."""

    def __init__(self, data, seed):
        pass

    def of(self, start, end):
        return np.zeros(len(start), np.uint64)


@pytest.mark.parametrize("weak", [False, True])
def test_ids_of_long_alike_words(monkeypatch, weak):
    from tokenizers import Tokenizer

    if weak:
        monkeypatch.setattr(common, "Prefixes", Constant)
    t, e, m = Tokenizer.from_file(BPE), token_orc.Encoder(BPE), unigram.Model(PIECES)
    for n in (64, 1024, 2048, 4096):
        s, o = thue_morse(n)
        texts = [f"{s} {o} {s}", o, f"{s[:-1]} {o}", s, "", f"x {s}"]
        ids, at = e.encode(pa.array(texts))
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        raw = [x.encode() for x in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, cut = m.encode(data, offsets)
        alone = [m.encode(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0].tolist() for r in raw]
        assert [ids[cut[k] : cut[k + 1]].tolist() for k in range(len(texts))] == alone
        back, ends = m.decode(ids, cut)
        assert back.tobytes() == b"".join(raw) and np.array_equal(ends, offsets)


def test_hashes_tell_words_apart_that_a_power_of_two_does_not():
    s, o = thue_morse(4096)
    data = np.frombuffer((s + o + s).encode(), np.uint8)
    start = np.arange(0, 3 * 4096, 4096)
    a, b, c = common.Prefixes(data, 23).of(start, start + 4096).tolist()
    assert a == c != b
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 50_000).astype(np.uint8)
    begin, size = rng.integers(0, 49_000, 3000), rng.integers(0, 1000, 3000)
    again = np.concatenate([data[:7], *(data[x : x + n] for x, n in zip(begin, size, strict=True))])
    other = 7 + np.cumsum(size) - size
    assert np.array_equal(common.Prefixes(data, 5).of(begin, begin + size), common.Prefixes(again, 5).of(other, other + size))


def test_alike_words_are_other_shingles_and_other_windows(spark):
    s, o = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(3))
    docs = spark.createDataFrame([(1, f"{s} {rest}"), (2, f"{o} {rest}"), (3, f"{s} {rest}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 5).collect()) == [(1, 1), (2, 2), (3, 1)]
    rows = [(1, s), (2, o), (3, s + o)]
    got = suffix_index.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rows))


def test_texts_that_are_nowhere_else_stay_under_a_repeated_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " more"
    rows = [(1, a), (5, a), (5, b), (7, near), (7, c), (9, b + " too"), (5, a), (11, a.upper()), (7, c), (12, None), (12, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4, 5):
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size).collect()}
        n = 41 - size
        assert got == {(1, n, 1, True), (5, n, 1, False), (5, n, 5, True), (7, n + 1, 1, False), (7, n, 7, True), (9, n + 1, 5, False), (11, n, 1, False), (12, 0, 12, True), (12, n, 1, False), (None, n, None, True)}
    left = sorted(map(tuple, minhash.deduplicate(df).collect()), key=str)
    assert left == sorted([(1, a), (5, b), (7, c), (7, c), (12, None), (None, a)], key=str)


def test_recall_close_to_the_limit(spark):
    """Planted pairs of similarity 0.80 to 0.85: all of them are found."""
    rng = random.Random(31)
    rows, pairs = [], 0
    for k in range(300):
        w = [f"{k}w{i}" for i in range(104)]
        # Shingles of five: a word in the middle takes five of a hundred, and 100 - x of 100 + x is at least 0.8 up to x = 11.
        other = list(w)
        for at in rng.sample(range(10, 90, 10), 2):
            other[at] = f"z{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    for k in range(300):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(100)} for t in (rows[2 * k][1], rows[2 * k + 1][1]))
        assert 0.8 <= len(x & y) / len(x | y) < 0.85
        pairs += got[2 * k + 1] == 2 * k
    assert pairs == 300


def test_blocks_of_a_large_bucket_compare_all_its_members(spark, monkeypatch):
    """Many documents that share half of their words, in pairs: only the members of a pair are linked."""
    rng = random.Random(41)
    common_part = [f"c{i}" for i in range(70)]
    rows = []
    for k in range(120):
        own = [f"{k}x{i}" for i in range(30)]
        rows += [(2 * k, " ".join(common_part + own)), (2 * k + 1, " ".join([*common_part, *own, f"z{rng.randrange(10**9)}"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (minhash.BLOCK, 7):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df, 5).collect()} == {(d, d - d % 2) for d, _ in rows}


def best_window(token, window):
    return max(-sum(c / window * math.log2(c / window) for c in (w.count(x) for x in set(w))) for w in (token[i : i + window] for i in range(len(token) - window + 1)))


def test_entropy_of_tokens_of_all_lengths(spark):
    rng = random.Random(9)
    some = ["".join(rng.choice(pool) for _ in range(n)) for n in (24, 25, 60, 500, 5000) for pool in ("0123456789abcdef", "abcAB01+/_-", "xyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")]
    rows = spark.createDataFrame([(t,) for t in some], "t string").select("t", secrets.top_entropy(F.col("t")).alias("h")).collect()
    assert len(rows) == len(some) and all(abs(r.h - best_window(r.t, secrets.WINDOW)) < 1e-9 for r in rows)


def test_very_long_tokens_and_very_many_secrets_end_in_seconds(spark):
    rng = random.Random(11)
    token = "".join(rng.choice("ABCDEFGHIJLMNOPQRSTUVW012345678") for _ in range(1_000_000))
    key = "deadbeef" * 3
    texts = {1: f"é😀 {token} end", 2: "x" * 1_000_000, 3: "-" * 300_000 + "_" * 300_000, 4: f"é{key} " * 20_000, 5: "A" * 600_000 + "7"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    before = time.time()
    found = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert time.time() - before < 60
    assert found[1].spans == f"entropy:3:{len(token) + 3}" and clean[1] == "é😀 [SECRET] end"
    assert found[2].spans == found[3].spans == found[5].spans == "" and all(clean[k] == texts[k] for k in (2, 3, 5))
    assert found[4].n_hex == 20_000 and clean[4] == "é[SECRET] " * 20_000
    want = ",".join(f"hex:{26 * k + 1}:{26 * k + 25}" for k in range(20_000))
    assert found[4].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def rule_by_hand(rules, host, path):
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, "allow")


@pytest.mark.parametrize("max_rules", [10**6, 0])
def test_many_rules_of_few_hosts_against_brute_force(spark, max_rules):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abé/") for _ in range(rng.randrange(5)))
    hosts = ["com", "a.com", "b.a.com", "net", "", "x/y"]
    rules = [(rng.choice(hosts), rng.choice(["/", ""]) + word(), rng.choice(["allow", "block"])) for _ in range(300)]
    urls = [(k, f"http://{rng.choice(['', 'a.', 'b.a.', 'c.b.a.'])}{rng.choice(['com', 'net', 'org', 'xcom'])}/{word()}{word()}") for k in range(600)]
    urls += [(None, "http://com/"), (1, urls[1][1]), (7, None), *((1000 + k, "http://a.com/a") for k in range(300))]
    got = url_trie.judge(spark.createDataFrame(urls, "page_id long, url string"), rules, max_rules=max_rules).collect()
    assert sorted(map(str, (r.page_id for r in got))) == sorted(str(k) for k, _ in urls)
    for r in got:
        assert (r.rule, r.verdict) == rule_by_hand(rules, r.host, r.path)


def test_a_million_rules_of_one_host():
    before = time.time()
    trie = url_trie.Trie(("big.com", f"/{k:x}q", "block" if k % 3 else "allow") for k in range(url_trie.MAX_RULES))
    assert time.time() - before < 60
    before = time.time()
    for k in range(0, url_trie.MAX_RULES, 10):
        assert trie.find("www.big.com", f"/{k:x}q/rest") == (f"big.com/{k:x}q", "block" if k % 3 else "allow")
        assert trie.find("big.com", f"/{k:x}z") is None
    assert time.time() - before < 20


def test_lines_of_many_languages_against_brute_force(spark):
    from test_pipeline import bad_line

    lines = [
        "天气很好，我们去公园散步。", "他说：今天没有时间", "首页", "これは長い文章です。", "これは長い文章ですけれども", "هل هذا سؤال؟", "یہ ایک جملہ ہے۔", "यह एक वाक्य है।", "Menü | Suche | Kontakt",
        "Startseite und noch mehr Dinge: ja", "Weiter geht es mit dem Text.", "Zurück", "zurückgelegt: drei Kilometer am Tag", "Précédent: suivant", "Leer más…", "Inicio: el comienzo de todo!",
        "Alle Rechte vorbehalten, seit dem Jahr 2001.", "Tous droits réservés. Merci à vous.", "Cet article utilise des cookies: oui.", "https://a.example/x?y=1 is here.", "See www.example.com for more of this long text.",
        "www.example.com/a/very/long/path/of/a/page.", "Homeward bound we went; nothing else", "home; sweet home of ours", "a b c d: e", "a b c: d", "Next!", "next_one: a b c d", "##$$ two: x", "ไทยไม่มีช่องว่างระหว่างคำ: ใช่",
    ]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select("t", line_clean.line_fails(F.col("t")).alias("bad")).collect()
    assert {r.t: r.bad for r in got} == {x: bad_line(x) for x in lines}
    page = "\n".join(f"今天是第{k}天，我们一起去看了第{k + 3}部电影，大家都很高兴。" for k in range(12))
    r = line_clean.quality(spark.createDataFrame([(1, page)], "doc_id long, text string")).first()
    assert r.n_lost_chars == 0


def test_line_rules_match_their_sql(spark, tmp_path):
    """The SQL of op9 on lines of many languages."""
    import duckdb

    from meshwright.llm.oracle import ORACLE
    from test_pipeline import MENU, PHRASES

    rng = random.Random(51)
    some = [*MENU, *PHRASES, "word", "Wort", "über", "漢字かな交じりの文です", "。", "：", "؟", " | ", ".", "; ", "https://x.example/abc", "www.x.example", "é", "#", " ", "  "]
    texts = ["\n".join("".join(rng.choice(some) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "d.parquet")
    df.coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = duck.execute(ORACLE["op9_line_clean"])
    names = [x[0] for x in found.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())
    rows = line_clean.quality(df)
    assert sorted(tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()) == want


def test_responses_with_one_record_id_are_told_apart(spark):
    rows = [
        ("r", "http://x.org/", 10, 200, {"etag": "1", "of": "old"}), ("r", "http://x.org/", 30, 200, {"etag": "2", "of": "new"}), ("r", "http://y.org/", 30, 200, {"etag": "2", "of": "y"}),
        ("r", "http://x.org/", 50, 200, {"etag": "3", "of": "b"}), ("r", "http://x.org/", 50, 200, {"etag": "3", "of": "a"}),
        ("q", "http://x.org/", 20, 304, {"etag": "1", "n": "first"}), ("q", "http://x.org/", 40, 304, {"etag": "2", "n": "second"}), ("q", "http://y.org/", 40, 304, {"etag": "2", "n": "third"}),
        ("q", "http://x.org/", 60, 304, {"etag": "3", "n": "fourth"}),
    ]
    rng = random.Random(61)
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "record_id string, uri string, ts long, status int, headers map<string,string>").repartition(3)
        got = {r.headers["n"]: r.headers["of"] for r in warc.resolve(df).collect()}
        assert got == {"first": "old", "second": "new", "third": "y", "fourth": "a"}


def test_arrays_are_in_alphabetical_order():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    raw = data.tobytes()
    for gram in (20, 40, 50):
        text, c = suffix_index.runs(data, np.array([0, len(data)]), gram, None)
        ordered = suffix_index.in_order(c | {"doc": text})
        high = ordered["high"].tolist()
        assert high == sorted(high) and len(high)
        for k in range(len(high)):
            begin = int(ordered["start"][k])
            first = ordered["high"][k].tobytes()[::-1] + ordered["middle"][k].tobytes()[::-1] + (ordered["low"][k].tobytes()[::-1][4:] if gram == 20 else b"")
            # The sampled suffix lies inside every window of its run.
            assert raw.find(first, begin + int(ordered["count"][k]) - 1, begin + 50) >= 0
        begins = [(h.tobytes()[::-1], m.tobytes()[::-1]) for h, m in zip(ordered["high"], ordered["middle"], strict=True)]
        assert begins == sorted(begins)
        back = suffix_index.unpacked(suffix_index.packed(ordered | {"sub": text}), len(high))
        assert all(np.array_equal(back[k], ordered[k]) for k in ("high", "middle", "low", "body", "start", "count"))


def test_a_stored_index_takes_batch_after_batch(spark, tmp_path):
    """Each batch loses what stands in earlier ones; levels of equal size merge, the others stay as they are."""
    rng = random.Random(71)
    pool = ["".join(rng.choice("abc ") for _ in range(rng.randrange(40, 90))) for _ in range(12)]
    rows = [(k, "".join(rng.choice(pool) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(rng.randrange(6)))) for k in range(70)]
    rows[3], rows[40] = (3, None), (40, rows[1][1])
    want = {r[0]: r for r in brute_repeats(rows)}
    index = suffix_index.Index(spark, f"file://{tmp_path}/index", deals=3)
    shapes = []
    for k in range(7):
        got = index.add(spark.createDataFrame(rows[10 * k : 10 * k + 10], "doc_id long, text string")).collect()
        assert sorted(map(tuple, got)) == [want[d] for d, _ in rows[10 * k : 10 * k + 10]]
        shapes.append([r["rank"] for r in index.versions()])
    assert shapes == [[0], [1], [1, 0], [2], [2, 0], [2, 1], [2, 1, 0]]
    assert sum(w[2] > 0 for w in want.values()) > 20
    with pytest.raises(ValueError, match="must be above"):
        index.add(spark.createDataFrame([(69, "again")], "doc_id long, text string"))
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert index.add(nothing).count() == 0 and [r["rank"] for r in index.versions()] == [3]
    assert index.add(spark.createDataFrame([(100, rows[1][1]), (None, rows[1][1])], "doc_id long, text string")).where("n_removed > 0").count() == (len(rows[1][1]) >= 50)


def test_groups_stay_together_where_the_quotas_allow_it(spark):
    """Groups far smaller than a shard: all links could be kept, and nearly all are; loads differ by two texts at most."""
    rng = random.Random(81)
    texts = [t for k in range(400) for t in [f"{k:04d}" * rng.randrange(5, 25)] * rng.randrange(1, 5)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.shard, r.size) for r in shard.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=6).collect()}
    places, loads = {}, [0] * 6
    for d, t in enumerate(texts):
        places.setdefault(t, []).append(got[d][0])
        loads[got[d][0]] += got[d][1]
    links = sum(len(p) * (len(p) - 1) // 2 for p in places.values())
    cut = sum(a != b for p in places.values() for a, b in itertools.combinations(p, 2))
    assert cut <= links / 50 and max(loads) - min(loads) <= 2 * max(size for _, size in got.values())


def test_a_hot_group_fills_shard_after_shard(spark):
    """A group of a third of all bytes is cut into as few pieces as its size allows, and loads stay even."""
    texts = ["h" * 100] * 800 + [f"{k:05d}" * 20 for k in range(1600)]
    out = shard.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    loads, hot = {}, set()
    for r in out:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        if r.doc_id < 800:
            hot.add(r.shard)
    assert len(loads) == 24 and max(loads.values()) - min(loads.values()) <= 2 * 108 and len(hot) <= 9
