"""The training-data operators: SQL, brute force, round trips, edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridquarry.llm import arrays, chat, common, dedup, groups, jaccard, language, licenses, mixing, packing, queries, sharding, toxicity, vectors
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
EDGES = [
    (1, "Hello World this is a Text of words", "en", "b", 3), (2, "hello world THIS is a text of words", "en", None, 3), (2, "hello world THIS is a text of words", "en", None, 3),
    (3, None, None, "a", None), (4, "", "en", "a", 0), (None, "Ünïcode ÄÖ text with MIT License inside", "de", "a", 5), (5, LONG, "en", "", 9), (6, "  \t ", "en", "c", 4), (7, "ÄHello", "fr", "b", 6), (8, "ähello", "fr", "b", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns with the names that operators use inside."""
    for name in ("id", "row", "kept", "keep_id", "record", "draw", "cell", "size", "bucket", "digest", "norm", "key", "shard", "slot", "v", "w", "y", "n", "score", "found", "bit", "token", "piece", "length", "count", "component_id", "lang_pred", "plan", "whole"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name], connect(SF))


# --- exact dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("digest", [dedup._md5, lambda t: F.crc32(t) % 2])
def test_exact_dedup(docs, clashing, digest):
    for df in (docs, clashing):
        got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in dedup.exact_dedup(df, keep="largest", digest=digest).collect())
        rows = [(i, lowered(t)) for i, t, *_ in EDGES]
        want = []
        for i, t in rows:
            own = [j for j, u in rows if u == t]
            keep = max((j for j in own if j is not None), default=None)
            want.append((i or -1, keep, len(own), i == keep))
        assert got == sorted(want)


@pytest.mark.parametrize("digest", [dedup._md5, lambda t: F.crc32(t) % 2])
def test_drop_copies(spark, docs, clashing, empty, digest):
    assert dedup.drop_copies(clashing, digest=digest).columns == clashing.columns
    assert sorted(r["doc_id"] or -1 for r in dedup.drop_copies(docs, digest=digest).collect()) == [-1, 1, 3, 5, 6, 7, 8]
    rows = [(1, "t", "a"), (1, "t", "b"), (1, "T", "c"), (2, "t", "d"), (None, "t", "e"), (None, "u", "f"), (None, "U", "g"), (3, None, "h"), (3, "", "i"), (1, "v", "j")]
    got = dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3), digest=digest).collect()
    assert sorted((str(r["doc_id"]), lowered(r["text"])) for r in got) == [("1", "t"), ("1", "v"), ("3", ""), ("None", "u")]
    assert dedup.drop_copies(empty).count() == 0 and dedup.exact_dedup(empty).count() == 0


# --- mixing


def fill(sizes, weights, total, epochs):
    target, left = {}, dict(weights)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > epochs * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = epochs * sizes[s]
            del left[s]
    return target


@pytest.mark.parametrize("seed", range(3))
def test_water_filling(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{k}": int(v) for k, v in enumerate(rng.integers(0, 1000, 12))}
    weights = {s: float(w) for s, w in zip(sizes, rng.integers(1, 9, 12))}
    total = 1.5 * sum(sizes.values())
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(df, total).collect()}
    want = fill(sizes, weights, total, 2.0)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_mix_edges(docs, clashing, empty):
    first = sorted((str(r["doc_id"]), r["size"], r["taken"], r["target"]) for r in mixing.mix_sources(clashing).collect())
    assert first == sorted((str(r["doc_id"]), r["size"], r["taken"], r["target"]) for r in mixing.mix_sources(docs.repartition(3)).collect())
    assert all(taken <= 2 * size for _, size, taken, _ in first)
    got = {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()}
    assert got[3] == got[4] == got[6] == 0 and got[5] == 30_000 and got[1] == 8
    assert mixing.mix_sources(empty).count() == 0 and mixing.repeat_rows(empty).count() == 0
    assert mixing.repeat_rows(clashing).columns == clashing.columns


def test_mix_comes_near_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most"))
    assert all(abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1 for r in mix.collect())
    assert mixing.repeat_rows(docs).count() == mixing.mix_sources(docs).agg(F.sum("repeats")).first()[0]


@pytest.mark.parametrize("size, copies", [(1, 1000), (7, 50)])
def test_equal_rows_are_taken_one_by_one(spark, size, copies):
    """A third of all rows repeat one id and text: their source still comes within half a row of its target."""
    same = [(1, "w " * size, "b", "x")] * copies
    rows = same + [(100 + k, "w " * (1 + k % 5), s, "x") for s in "ac" for k in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(5)
    mix = mixing.mix_sources(df, max_epochs=9.0)
    for r in mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2
    want = {tuple(r) for r in mix.groupBy("source").agg(F.sum("repeats")).collect()}
    assert {tuple(r) for r in mixing.repeat_rows(df, max_epochs=9.0).groupBy("source").count().collect()} == want


def test_order_of_sources(spark):
    names = ["b", None, "", "a", "Z", "é", "aa"]
    df = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    got = {r["source"]: r["weight"] for r in mixing.weigh_in_order(df, (5.0, 2.0, 1.0)).collect()}
    assert got == dict(zip(["", "Z", "a", "aa", "b", "é", None], [5.0, 2.0, 1.0, 5.0, 2.0, 1.0, 5.0]))


# --- sharding


@pytest.mark.parametrize("law", ["rows", "key"])
def test_sharding(docs, clashing, empty, law):
    rows = sharding.shuffle_into_shards(clashing, 3, law, bucket_bytes=1000).collect()
    assert sorted(str(r["record"]["doc_id"]) for r in rows) == sorted(str(e[0]) for e in EDGES)
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    if law == "rows":
        counts = [sum(r["shard"] == s for r in rows) for s in range(3)]
        assert max(counts) - min(counts) <= 1
    assert sharding.shuffle_into_shards(empty, 3, law).count() == 0


def test_key_law_moves_rows_into_the_new_shard_only(spark):
    df = spark.range(500).select(sharding.shard_of(F.col("id"), 8).alias("a"), sharding.shard_of(F.col("id"), 9).alias("b"))
    assert all(r["a"] == r["b"] or r["b"] == 8 for r in df.collect())


def test_shuffle_is_even(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    got = [(r["record"]["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(df, bucket_bytes=50_000).collect()]
    place = np.array([8 * slot + shard for _, shard, slot in got], float)
    assert abs(np.corrcoef([i for i, *_ in got], place)[0, 1]) < 0.06


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(EDGES) and set(docs.columns) < set(back.columns)


def test_op5_equals_brute_force(spark):
    """The whole query: every row once, sizes and checksums, and the law."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.QUERIES["op5_sharding"](spark, SF).collect()
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t) + 1, zlib.crc32(t)) for i, t in raw.items())
    slots = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_op3_equals_brute_force(spark):
    """The whole query: every document's ids in pieces, sequences gapless and not above 2048, and few of them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.QUERIES["op3_packing"](spark, SF).collect()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*exact.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= 1.02 * sum(ends.values()) / 2048 + 1


# --- packing


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 33, 300)
    sequence, offset, used = packing.sum_of_squares(sizes, 32)
    fill_, count = [], {}
    for k, s in enumerate(sizes.tolist()):  # the rule, tried out on every open gap
        options = {}
        for gap in [g for g, n in count.items() if n and s <= g < 32] or [32]:
            after = dict(count)
            if gap < 32:
                after[gap] -= 1
            if gap > s:
                after[gap - s] = after.get(gap - s, 0) + 1
            options[gap] = (sum(v * v for v in after.values()), gap, after)
        cost, gap, after = min(options.values(), key=lambda o: o[:2])
        assert offset[k] == 32 - gap
        count = after
    ends = {}
    for k in np.lexsort((offset, sequence)):
        assert offset[k] == ends.get(sequence[k], 0)
        ends[sequence[k]] = offset[k] + sizes[k]
    assert len(ends) == used and max(ends.values()) <= 32


def test_pack_documents(docs, clashing, empty):
    rows = packing.pack_documents(clashing, capacity=64, with_ids=True).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text, *_ in EDGES:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 64
    assert packing.pack_documents(empty).count() == 0


def test_fast_ids_equal_the_defining_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(1)
    letters = list("abcXYZ 01.,!'\n\t  éüßñÀ ſ日本́😀<|endoftext|>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["", "<|endoftext|>", "it's we'll  x\n\n y"]
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.text_encoder(None, None)(texts) == [exact.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("n", [300, 3000, 20_000])
@pytest.mark.parametrize("kind", ["even", "short", "skewed"])
def test_packing_wastes_little(n, kind):
    rng = np.random.default_rng(2)
    sizes = {"even": lambda: rng.integers(1, 2048, n), "short": lambda: rng.integers(1, 700, n), "skewed": lambda: np.minimum(2047, 1 + rng.lognormal(5, 1.2, n)).astype(int)}[kind]()
    _, _, used = packing.pack_block(sizes, 2048)
    least = max(sizes.sum() / 2048, (sizes > 1024).sum())
    assert used <= 1.01 * least + 3


# --- licences


def test_license_edges(docs, clashing, empty):
    got = {r["record"]["doc_id"]: r for r in licenses.scan_licenses(clashing).collect()}
    assert [f["label"] for f in got[None]["found"]] == ["mit"] and got[5]["n_words"] == 30_000 and got[3]["n_words"] == 0
    assert licenses.scan_licenses(empty).count() == 0


def test_license_places(spark):
    texts = ["MIT License mit license permit license", "gnu General-Public\nLicense version 3", "license mit", "The MIT mit Licenses", "x" + " mit license" * 500, "licensed under cc by nc 4.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["record"]["doc_id"]: [(f["label"], f["first"]) for f in r["found"]] for r in licenses.scan_licenses(df).collect()}
    assert sorted(got[0]) == [("mit", 0), ("mit", 2)] and got[1] == [("gpl", 1), ("gpl-3.0", 0)] or sorted(got[1]) == [("gpl", 1), ("gpl-3.0", 0)]
    assert got[2] == [] and got[3] == [] and len(got[4]) == 500 and got[5] == [("cc-by-nc", 2)]


# --- n-gram Jaccard join


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    best = {}
    for x, (i, s) in enumerate(sets):
        best.setdefault(root(x), []).append(i)
    return sorted((str(i), len(s), str(min((j for j in best[root(x)] if j is not None), default=None))) for x, (i, s) in enumerate(sets))


def near_copies(rng, n_groups=6, size=14):
    words = [f"w{k}" for k in range(3000)]
    rows, passage = [], list(rng.choice(words, 60))
    for _ in range(n_groups):
        base = list(rng.choice(words, rng.integers(8, 150)))
        for _ in range(size):
            text = list(base)
            for at in rng.integers(0, len(text), rng.integers(0, 3)):
                text[at] = str(rng.choice(words))
            if rng.random() < 0.3:
                text += passage
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join([*passage, *rng.choice(words, int(m))])) for k, m in enumerate(rng.integers(0, 12, 25))]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(groups, "PAIRED", 3)
    rows = near_copies(np.random.default_rng(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.jaccard_components(df).collect())
    assert got == brute(rows)


def test_jaccard_edges(docs, clashing, empty):
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.jaccard_components(clashing).collect())
    assert got == [x if x[1] else (x[0], 0, x[0]) for x in brute([e[:2] for e in EDGES])]
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.one_of_each(clashing).columns == clashing.columns


def test_set_trie():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64)[::-1].copy() for _ in range(200)]
    trie = jaccard.SetTrie()
    for k, s in enumerate(sets):
        trie.add(s, k)
    want = {(k, j) for j, s in enumerate(sets[:50]) for k, o in enumerate(sets) if 100 * len(np.intersect1d(s, o)) >= 60 * len(np.union1d(s, o))}
    assert sorted((k, j) for k, near in trie.similar(sets[:50], 60) for j in near) == sorted(want)


@pytest.mark.parametrize("n", range(10))
def test_blocks_of_few_words(spark, n):
    """Blocks whose texts hold n words in all, in one text and in several."""
    for texts in ([" ".join(f"w{k}" for k in range(n))], [f"w{k}" for k in range(n)] or [""], [None, " ".join(["x"] * n)]):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        tokens, counts = arrays.shingle_sets(batch, 5)
        assert counts.tolist() == [len(shingles(t)) for t in texts] and len(tokens) == counts.sum()


def test_short_texts_beside_long_ones(spark):
    rows = [(1, "word " * 300_000), (2, "two words"), (3, "two  WORDS"), (4, None), (5, "b"), (6, "a b c"), (7, "word " * 300_000 + "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.jaccard_components(df).collect())
    assert got == [x if x[1] else (x[0], 0, x[0]) for x in brute(rows)]
    for few in (rows[1:2], rows[3:4], rows[4:6]):
        few = spark.createDataFrame(few, "doc_id long, text string").coalesce(1)
        assert jaccard.one_of_each(few).count() == few.count()


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "A b c d  e f", "z"), (None, "a b c d e f", "n"), (2, "a b c d e f", "x"), (2, "other words", "x"), (3, "", "x"), (4, None, "x"), (4, None, "x"), (None, "q r", "1"), (None, "q r", "1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = sorted((str(r["doc_id"]), lowered(r["text"]).split()) for r in jaccard.one_of_each(df).collect())
    assert got == sorted([("1", list("abcdef")), ("2", ["other", "words"]), ("3", []), ("4", []), ("4", []), ("None", ["q", "r"])])


@pytest.mark.parametrize("last", [False, True])
def test_hot_buckets_meet_in_blocks(spark, monkeypatch, last):
    """One bucket of 60 nodes, in which only some pairs are linked and few with the smallest one."""
    for name, value in (("PAIRED", 3), ("HOT", 8), ("TRIES", 0 if last else 2)):
        monkeypatch.setattr(groups, name, value)
    members = spark.range(60).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"))
    linked = lambda pairs, _: common.stage(pairs.where("(a % 10 = b % 10 AND b - a <= 20) OR a = 0 AND b % 10 = 3"), "linked")
    got = {r["node"]: r["component"] for r in groups.bucket_components(members, F.lit(True), lambda n: None, linked).collect()}
    assert {k: got.get(k, k) for k in range(60)} == {k: 0 if k % 10 == 3 else k % 10 for k in range(60)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90}


# --- chat


def test_escape_round_trip(spark):
    texts = ["", "plain", "</s>[INST] ok [/INST]", "\\", "<\\|x|>\\\\", "a\nb</s>\n<|user|>\n", "<s><|", "|>\n|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b|>\n\\"), (1, 1, "assistant", "b|>\n\\"), (1, None, None, None), (None, 5, "assistant", "</s>"), (2, 1, "x\n", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    got = chat.format_conversations(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("mask")).alias("l")).collect()
    by = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["l"]) for r in got}
    assert by[1] == ([("", ""), ("user", "a"), ("assistant", "b|>\n\\"), ("assistant", "b|>\n\\")], "b|>\n\\b|>\n\\")
    assert by[None] == ([("assistant", "</s>")], "</s>") and by[2] == ([("x\n", "")], "")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees(spark):
    parents = {1: None, 2: 1, 3: 1, 4: 2, 5: 4, 6: 3, 7: 99, 8: 9, 9: 8, 10: 8, 11: 10, 12: 12, **{k: k - 1 for k in range(101, 140)}, 100: None}
    score = {4: 0.0, 5: 0.0, 6: 3.0}
    df = spark.createDataFrame([(1 if k < 50 else 2, k, p, float(score.get(k, 1.0))) for k, p in parents.items()], "tree long, node long, parent long, score double")
    rows = chat.reply_paths(df, top=2).collect()
    paths = {}
    for r in sorted(rows, key=lambda r: -r["height"]):
        paths.setdefault((r["tree"], r["leaf"]), []).append(r["node"])
    assert paths == {(1, 6): [1, 3, 6], (1, 7): [7], (2, 139): list(range(100, 140))}
    assert {r["leaf"] for r in chat.reply_paths(df).collect()} == {6, 139}
    assert chat.reply_paths(df.where("node BETWEEN 8 AND 12")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_reply_trees_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    parent = {k: int(rng.integers(0, k)) if k > 3 and rng.random() < 0.9 else None for k in range(60)}
    parent |= {4: 5, 5: 6, 6: 4}  # a cycle, with what hangs from it
    score = {k: float(rng.integers(0, 5)) for k in parent}

    def walk(k):
        path = [k]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
            if len(path) > 60:
                return None
        return path

    paths = {k: walk(k) for k in parent if k not in parent.values()}
    paths = {k: p for k, p in paths.items() if p}
    tree = {k: p[-1] for k, p in paths.items()}
    best = {t: sorted((k for k in paths if tree[k] == t), key=lambda k: (-np.mean([score[j] for j in paths[k]]), k))[:2] for t in set(tree.values())}
    want = sorted((k, j, h) for t, leaves in best.items() for k in leaves for h, j in enumerate(paths[k]))
    root = {k: (walk(k) or [-1])[-1] for k in parent}
    df = spark.createDataFrame([(root[k], k, p, score[k]) for k, p in parent.items()], "tree long, node long, parent long, score double")
    assert sorted((r["leaf"], r["node"], r["height"]) for r in chat.reply_paths(df, top=2).collect()) == want


# --- embeddings


def test_embedding_groups_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 64))
    for k in range(100):  # clusters around the threshold, and a large tight one
        base = x[k % 5]
        x = np.concatenate([x, [base + rng.normal(size=64) * rng.uniform(0.02, 0.45)]])
    x = np.concatenate([x, x[:3], x[:1] * 2.5])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0] * 32), (1004, [float("inf")] + [1.0] * 63), (1005, []), (1006, [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = {r["vec_id"]: r for r in vectors.embedding_groups(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert found >= 0.97 * (near.sum() - len(x)) and all(got[k]["n_links"] <= near[k].sum() - 1 for k in range(len(x)))
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k, _ in odd)
    assert vectors.embedding_groups(df.limit(0)).count() == 0


def test_hadamard():
    x = np.eye(8)
    h = vectors.hadamard(x)
    assert (h @ h.T == 8 * np.eye(8)).all()


@pytest.mark.parametrize("dim, n", [(64, 500), (64, 50_000), (384, 50_000), (768, 50_000), (1024, 10_000), (100, 10_000_000)])
def test_recall_at_the_threshold(dim, n):
    """Fresh pairs at a cosine of exactly 0.9 share a bucket, and unrelated ones hardly ever."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(1000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = b = rng.normal(size=a.shape)
    b = b - (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    bits = vectors.table_bits(n)
    tables = vectors.choose_tables(dim, bits, 0.9)
    keys = [[vectors.table_keys(x, t, bits) for t in range(tables)] for x in (a, b, other)]
    shared = lambda p, q: np.mean([(x[:, :, None] == y[:, None, :]).any((1, 2)) for x, y in zip(p, q)], axis=0)
    assert (shared(keys[0], keys[1]) > 0).mean() >= 0.97
    assert shared(keys[0], keys[2]).mean() <= 64 * 16 / 2**bits + 2e-3


def test_link_groups_hold_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    found = spark.range(2500).select(F.col("id").alias("node"), F.when(F.col("id") < 2000, 0).otherwise(F.col("id") - F.col("id") % 3).cast("long").alias("component"))
    binary = found.select("node", F.lit(1).cast("long").alias("times"), F.lit(b"").alias("v"))
    rows, keys = vectors.link_work(binary, found)
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col("component")).alias("c")).collect()
    # one component of 125 blocks: grouped by a hash to 2500 // 64 tasks, a group had some 6,000 rows
    assert max(r["n"] for r in groups) < 8 * 16 and len([r for r in groups if r["c"] == 0]) == 125 * 126 // 2
    met = rows.where("component = 0").groupBy("node").count()
    assert met.count() == 2000 and met.where("count <> 125").isEmpty()


def test_one_component_of_many_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=8) + rng.normal(size=(200, 8)) * 0.22
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.9).sum(1) - 1
    got = vectors.embedding_groups(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    big = {r["vec_id"] for r in got if r["component_id"] == 0}
    assert len(big) > 100 and {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))


# --- language and toxicity


def test_language(spark):
    got = queries.QUERIES["op2_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.95


def test_language_edges(docs, clashing, empty):
    filters = language.learn_languages(clashing)
    got = {r["record"]["doc_id"]: r["lang_pred"] for r in language.identify(clashing, filters).collect()}
    assert got[3] == got[4] == got[6] == "und" and got[5] == "en"
    assert language.identify(docs, language.learn_languages(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.keep_identified(clashing).columns == clashing.columns


def test_filters_correct_false_positives():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    f = language.LanguageFilters.build(["a", "b"], hashes, np.arange(4000) % 2)
    assert (f.false_positives < 0.01).all()
    masks = np.bitwise_and.reduce([f.cells[at, 0] for at in f.places(hashes)])
    assert ((masks >> (np.arange(4000) % 2).astype(np.uint64)) & np.uint64(1) == 1).all()
    other = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    masks = np.bitwise_and.reduce([f.cells[at, 0] for at in f.places(other)])
    assert (masks & np.uint64(1)).mean() == pytest.approx(f.false_positives[0], abs=0.002)


def text_grams(text):
    """3- and 4-grams of lower-cased letters, each run of other signs one boundary, which stands at the ends only."""
    signs = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    return [signs[k : k + n] for n in (3, 4) for k in range(len(signs) - n + 1) if " " not in signs[k + 1 : k + n - 1]]


def test_language_equals_brute_force(spark):
    """Sets of n-grams instead of filters, over whole texts: shares, and the language of the largest."""
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in docs}
    stands, texts = {}, {}
    for i, text, lang in docs:
        if lang and text is not None and not held[i]:
            texts[lang] = texts.get(lang, 0) + 1
            for g in set(text_grams(text)):
                stands.setdefault(lang, {}).setdefault(g, 0)
                stands[lang][g] += 1
    sets = {lang: {g for g, n in s.items() if n >= min(texts[lang], max(2, language.SHARE * texts[lang]))} for lang, s in stands.items()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_language"](spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        grams, r = text_grams(text), got[i]
        assert r["held_out"] == held[i]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        share = {lang: sum(g in s for g in grams) / max(1, len(grams)) for lang, s in sets.items()}
        near = 0.02 + 2 / max(1, len(grams))  # two n-grams that are not there may look as if they were
        assert share[r["lang_pred"]] >= max(share.values()) - near and r["score"] == pytest.approx(share[r["lang_pred"]], abs=near)


def test_language_of_texts_above_a_block(spark):
    rows = [(1, "the house and the garden are here", "en"), (2, "das haus und der garten sind hier", "de")] * 2
    rows = [(k, *r[1:]) for k, r in enumerate(rows)] + [(10, "und der garten " * 100_000, "xx"), (11, "the house " * 150_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    filters = language.learn_languages(df.where("doc_id < 10"))
    got = {r["record"]["doc_id"]: r["lang_pred"] for r in language.identify(df, filters).collect()}
    assert got[10] == "de" and got[11] == "en" and got[0] == "en"


@pytest.mark.parametrize("least, kept", [(0.1, {1, 2}), (0.95, {1})])
def test_keep_identified_threshold(spark, least, kept):
    rows = [(1, "the house", "en"), (9, "the house", "en"), (2, "the house zzzz qqqq xxxx", None), (3, "qqqq xxxx zzzz", None), (4, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in language.keep_identified(df, least).collect()} - {9} == kept


def test_toxicity(spark):
    """Held-out documents in all languages: none that is clean is caught, and nearly all toxic ones are."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    got = queries.QUERIES["op10_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n.get((0, 1), 0) <= 2 and n[1, 1] >= 0.93 * (n[1, 1] + n.get((1, 0), 0))


def test_scores_equal_brute_force(spark):
    """A model's votes and score of texts of several blocks, word by word."""
    rng = np.random.default_rng(3)
    words = ["idiots", "Moron", "clean", "a", "AB", "trashy", "good!", "stupid!!!", "wörter", "pathetically"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 40, 60)] + [None, "", "idiot " * 200_000, "fine " * 250_000]
    tied = {("words", "idiots"): 2, ("words", "moron"): 0, (5, "trash"): 1, (6, "pathet"): 2}
    hashed = {}
    for (kind, w), tier in tied.items():
        h = arrays.hash_word(w) if kind == "words" else int(arrays.mix(np.array([arrays.hash_word(w)], np.uint64) + np.uint64(kind))[0])
        hashed[h] = 3 * (0 if kind == "words" else 1 + toxicity.STEMS.index(kind)) + tier
    model = toxicity.Toxicity(np.array(sorted(hashed), np.uint64), np.array([hashed[h] for h in sorted(hashed)]), rng.normal(size=1 + len(toxicity.VOTERS) + 3))
    want = []
    for text in texts:
        own = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text or "").lower().split()]
        votes, hits = np.zeros(len(toxicity.VOTERS)), 0
        for w in own:
            found = [3 * 0 + tied["words", w]] if ("words", w) in tied else []
            found += [3 * (1 + j) + tied[n, w[:n]] for j, n in enumerate(toxicity.STEMS) if len(w.encode()) > n and (n, w[:n]) in tied]
            votes[found] = 1
            hits += bool(found)
        insults, marks = sum(w in toxicity.INSULTS for w in own), (text or "").count("!")
        upper, lower = (sum(a <= c <= b for c in text or "") for a, b in (("A", "Z"), ("a", "z")))
        votes[toxicity.PARTS :] = [hits >= 1, hits >= 2, hits > 0 and hits >= 0.01 * len(own), insults >= 1, insults >= 2, upper > lower, marks > 0.05 * max(1, len(own))]
        x = np.concatenate([[1], votes, [np.log1p(hits), np.log1p(100 * hits / max(1, len(own))), np.log1p(len(own)) / 10]])
        want.append(1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, model).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want)


def test_toxicity_edges(spark, docs, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.learn_toxicity(clashing, known)
        assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(clashing, model).collect())
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_label_model_outvotes_a_wrong_label():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.2
    votes = np.stack([np.where(rng.random(2000) < 0.95, truth, ~truth) for _ in range(5)], 1).astype(float)
    label = truth.copy()
    label[:20] = ~label[:20]
    everything = np.concatenate([votes, label[:, None], votes[:, :1]], 1)
    posterior, accuracy, correlation = toxicity.label_model(everything)
    assert ((posterior > 0.5) == truth).mean() > 0.99 and accuracy[:6].min() > 0.9
    assert correlation[0, 6] > 0.99 and abs(correlation[0, 1]) < 0.2
    assert toxicity.label_model(np.zeros((5, 3)))[0].max() < 0.5


def test_repeated_ids_do_not_multiply(spark):
    docs = spark.createDataFrame([(1, "you idiot moron")] * 30 + [(k, "all is fine here") for k in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 20 + [(k, 0) for k in range(2, 30)], "doc_id long, toxic int")
    scores = toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs, labels)).collect()
    assert len(scores) == 58 and all(0 <= r["score"] <= 1 for r in scores)


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = []
    for name, function in corpus_pipeline.STAGES[:3]:
        docs = common.stage(function(spark, docs, SF), name)
        assert docs.columns == DOCS.replace(",", "").split()[::2]
        sizes.append(docs.count())
    kept = {r["doc_id"] for r in docs.collect()}
    texts = [(i, t) for i, t in known.items() if any(c.isalpha() for c in t or "")]
    assert sizes[0] == len(texts)
    first = {}
    for i, t in sorted(texts):
        first.setdefault(lowered(t), i)
    rows = [(i, known[i]) for i in sorted(first.values())]
    assert kept == {int(i) for i, n, c in brute(rows) if i == c or not n}
    docs = common.stage(corpus_pipeline.mix(spark, docs, SF), "mix")
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


def test_pipeline_edges(spark, clashing, empty):
    """Nulls, short and long texts, repeated rows and clashing names go through all stages; so does an empty table."""
    import corpus_pipeline

    for docs in (clashing, empty):
        n = docs.count()
        for name, function in corpus_pipeline.STAGES[:-1]:
            columns, docs = docs.columns, common.stage(function(spark, docs, SF), name)
            assert docs.columns == columns
            if name != "mixing":
                assert docs.count() <= n
                n = docs.count()
            if name == "jaccard":
                assert {(r["doc_id"], r["text"][:5]) for r in docs.collect()} == ({(1, "Hello"), (None, "Ünïco"), (5, "word "), (7, "ÄHell"), (8, "ähell")} if n else set())
        assert corpus_pipeline.pack(spark, docs, SF).where("piece = 0").count() == docs.count()
