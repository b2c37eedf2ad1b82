"""Token files, whitening and alignment against brute force."""

import collections
import hashlib
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridquarry.llm import alignment, tokens, whitening

SF = "/root/testdata/sf0.001"
ODD = ["", "a", " ", "  two  spaces", "<|endoftext|> x <|ENDOFTEXT|>", "</s> <unk> <0x41>", "漢字かな交じり文 ñ 😀😀", "\n\n\t tab\x0b\x0c\r", "▁ under", "=" * 777 + "漢" * 300, "ﬁ ½ Å Å", "\x00\x01", "x​y", "ΑΣ ΣΑΣ. ΟΔΟΣ'", "àÉ×÷ßÿ÷Á1٣²ªx", "I'LL a'dx ''s !'s 12a3", "İI ǅ", "a\x1cb\x85c\xa0d"]


def documents(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "row": F.lit(1), "n_tokens": F.lit(2)}).repartition(3)


# --- token files ----------------------------------------------------------------------------------------------------

RNG = np.random.default_rng(0)
SEQUENCES = [np.zeros(0), [5], np.full(1000, 7), np.tile([1, 2], 500), np.r_[np.full(37, 3), np.tile([3, 3, 4], 60)], RNG.integers(0, 5, 3000), RNG.zipf(1.3, 5000) % 100, np.repeat(RNG.integers(0, 4, 500), RNG.integers(1, 9, 500))]


@pytest.mark.parametrize("k", range(len(SEQUENCES)))
def test_grammar_round_trip(k):
    ids = np.array(SEQUENCES[k], np.uint32)
    made = tokens.re_pair(ids)
    grammar = tokens.Grammar.from_bytes(made.to_bytes())
    assert (grammar.expand() == ids).all() and len(grammar.expand()) == len(ids) == len(grammar)
    for j, pair in enumerate(grammar.rules):  # rules are made of what is below them, and know how long they are
        assert max(pair) < grammar.first + j
        assert grammar.lengths[j] == len(grammar.expand(np.array([grammar.first + j], np.uint32)))
    for _ in range(100):
        a, b = sorted(RNG.integers(-3, len(ids) + 5, 2).tolist())
        assert grammar.slice(a, b).tolist() == ids[max(a, 0) : max(b, 0)].tolist()
    with pytest.raises(ValueError, match="damaged"):
        tokens.Grammar.from_bytes(made.to_bytes()[:-1] + b"x")


def test_grammar_replaces_frequent_pairs():
    ids = np.tile(np.arange(64), 200).astype(np.uint32)
    made = tokens.re_pair(ids)
    assert len(made.sequence) <= 16 and len(made.rules) < 200  # a tree of rules for the period, and one for periods
    assert not len(tokens.re_pair(np.arange(5000, dtype=np.uint32)).rules)
    counts = collections.Counter(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))
    assert all(counts[tuple(p)] >= tokens.LEAST_COUNT for p in made.rules[made.rules.max(1) < made.first].tolist())


def test_pairs_are_counted_exactly():
    """More pairs than cells count: those that share a cell are told apart."""
    keys = RNG.permutation(np.repeat(np.arange(150_000, dtype=np.uint64) * np.uint64(7919), RNG.integers(1, 12, 150_000)))
    may, of, pairs, counts = tokens._frequent(keys, 8)
    want = {k: n for k, n in collections.Counter(keys.tolist()).items() if n >= 8}
    assert dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == want and len(pairs) == len(want)
    assert (pairs[of[of >= 0]] == keys[may[of >= 0]]).all() and (of >= 0).sum() == sum(want.values())


def test_words_encode_as_whole_texts(spark):
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encode = tokens.word_encoder()
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["'stmdrvel", "'aésSÉ×÷ß1!|<oftext>", "a漢'!é \n\x1c", "'' lrvx\t29ÿ"])
def test_units_are_split_as_the_library_splits(letters):
    """All texts of an array at once, of few letters, so that every neighbourhood occurs; repeated and empty texts among them."""
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["".join(RNG.choice(list(letters), RNG.integers(0, 30))) for _ in range(2000)] + ["", " ", letters, letters, "<|endoftext|>" + letters]
    want = [exact.encode(x, add_special_tokens=False).ids for x in texts]
    got = tokens.texts_encoder()(pa.array(["x", *texts, "x"]).slice(1, len(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    for few in ([], [""], ["", " "], ["漢"]):
        assert [len(x) // 4 for x in tokens.texts_encoder()(pa.array(few, pa.string()))] == [len(exact.encode(x, add_special_tokens=False).ids) for x in few]


def test_frequent_keys_are_made_once():
    """A full table does not forget what every batch asks for, and holds no more than it may."""
    made = collections.Counter()
    table = tokens.Remembered(lambda k: made.update([k]) or str(k), 100)
    for k in range(1, 500):
        assert table.of([0, -1, *range(20 * k, 20 * k + 20)]) == ["0", "-1", *map(str, range(20 * k, 20 * k + 20))]
        assert len(table.young) + len(table.old) <= 100
    assert set(made.values()) == {1}


def brute_ids(rows, encode, end=2):
    at, out = 0, []
    for i, text in rows:
        ids = [*encode(text or ""), end]
        out.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        at += len(ids)
    return out


def test_op13_equals_brute_force(spark):
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = [x[:4] for x in brute_ids(rows, lambda t: exact.encode(t, add_special_tokens=False).ids)]
    assert sorted(map(tuple, tokens.op13_tokens(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_token_files_of_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, clashing names, several shards, ranges across them."""
    exact = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, None, "long " * 3000, "same", "same", "other"]
    ids = [*range(len(ODD)), None, 100, 7, 7, 7]
    path = str(tmp_path / "files")
    tokens.write_token_files(documents(spark, texts, ids), path, shard_tokens=40)
    got = sorted(map(tuple, tokens.read_token_files(spark, path, with_ids=True).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    whole = np.concatenate([np.frombuffer(r[4], "<u4") for r in got])
    want = collections.Counter((i, tuple([*exact.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in zip(ids, texts, strict=True))
    assert collections.Counter((r[0], tuple(np.frombuffer(r[4], "<u4").tolist())) for r in got) == want
    assert all(r[3] == zlib.crc32(r[4]) and 4 * r[2] == len(r[4]) for r in got)
    assert spark.read.parquet(f"{path}/shards").count() > 3
    ranges = [("a", 0, 10), ("b", 35, len(whole) - 3), ("c", len(whole) - 1, len(whole) + 9), ("none", len(whole), len(whole) + 9), ("empty", 5, 5)]
    found = collections.defaultdict(list)
    for r in tokens.read_ranges(spark, path, spark.createDataFrame(ranges, "name string, start long, stop long")).orderBy("name", "at").collect():
        found[r["name"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert dict(found) == {n: whole[a:b].tolist() for n, a, b in ranges if len(whole[a:b])}
    empty = str(tmp_path / "empty")
    tokens.write_token_files(documents(spark, ["x"]).limit(0), empty)
    assert tokens.read_token_files(spark, empty).count() == 0


# --- whitening ------------------------------------------------------------------------------------------------------


def test_polarised_sums_are_exact():
    y = RNG.integers(-(2**47), 2**47, (500, 5))
    squares = np.zeros((5, 5), object)
    for i in range(5):
        for j in range(i, 5):
            squares[i, j] = int(whitening.square_sums(y[:, [i]] + (y[:, [j]] if j > i else 0))[0])
    want = [[2 * sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening.polarised(squares).tolist() == want


def test_op12_equals_brute_force(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = {k: np.floor(256 * np.array(v, float)).astype(int) for k, v in rows.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - fit.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    got = collections.defaultdict(dict)
    for r in whitening.op12_whitening(spark, SF).collect():
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["explained"] == pytest.approx(values[-r["component"]] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9
        got[r["component"]][r["vec_id"]] = r["whitened"]
    assert sorted(got) == [1, 2, 3, 4]
    for k, column in got.items():
        want = {i: float((v - fit.mean(0)) @ vectors[:, -k] / np.sqrt(values[-k])) for i, v in x.items()}
        sign = np.sign(sum(want[i] * column[i] for i in want))
        assert [column[i] for i in want] == pytest.approx([sign * v for v in want.values()], abs=1e-8)


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, []), (7, [-0.001, 3.0]), (8, [1.0, 2.0, 3.0]), (None, [0.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit("c"), "v": F.lit(2)})
    got = whitening.whiten(df).collect()
    by = collections.Counter((r["vec_id"], r["component"], r["n"]) for r in got)
    assert by == {(1, 1, 3): 2, (1, 2, 3): 2, (7, 1, 3): 1, (7, 2, 3): 1, (None, 1, 3): 1, (None, 2, 3): 1, (8, 1, 1): 1, (8, 2, 1): 1, (8, 3, 1): 1}
    alone = [r for r in got if r["vec_id"] == 8]  # one vector of its length has no variance
    assert all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in alone)
    pair = {(r["vec_id"], r["component"]): r for r in got}
    fit = np.array([[128, 256], [-1, 768], [0, -512]])
    assert pair[7, 1]["deviation"] == int(((3 * fit[1] - fit.sum(0)) ** 2).sum())
    assert sum(pair[7, k]["explained"] for k in (1, 2)) == pytest.approx(1) and pair[7, 1]["identity_error"] < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="exact sums"):
        whitening.whiten(spark.createDataFrame([(1, [1e14]), (2, [2.0])], "vec_id long, embedding array<double>")).collect()


def test_exact_where_doubles_are_not():
    """Two dimensions that differ by one unit in a large common part: their covariance keeps every digit."""
    squares, y = np.zeros((2, 2), object), np.array([[2**40 + k, 2**40 + k + (k == 3)] for k in range(8)]) - 2**40
    for i, j in ((0, 0), (0, 1), (1, 1)):
        squares[i, j] = int(whitening.square_sums(y[:, [i]] + (y[:, [j]] if j > i else 0))[0])
    double = whitening.polarised(squares)
    assert Fraction(int(double[0, 1]), 2) == sum(Fraction(int(a)) * int(b) for a, b in y)


# --- alignment ------------------------------------------------------------------------------------------------------

BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTE.encode_special_tokens = True
PIECE = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}


def brute_alignment(text):
    """n_a, n_b, n_groups, n_links, digest, links by a walk over both sides."""
    ids_a, ids_b = (BYTE.encode(" " + text, add_special_tokens=False).ids, PIECE.encode(text)) if text else ([], [])
    said_a = [bytes(letters()[c] for c in BYTE.id_to_token(k)) for k in ids_a]
    said_b = []
    for k in ids_b:
        p = PIECE.id_to_piece(k)
        said_b.append(bytes([int(p[3:5], 16)]) if PIECE.is_byte(k) else p.replace("▁", " ").encode())
    if not text or b"".join(said_a) != (" " + text).encode() or b"".join(said_b) != (" " + text).encode():
        return 0, 0, 0, 0, "", collections.Counter()
    end_a, end_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
    groups, links, i, j = [], collections.Counter(), 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        a, b = ids_a[i : end_a.index(cut) + 1], ids_b[j : end_b.index(cut) + 1]
        i, j = i + len(a), j + len(b)
        groups.append((a, b))
        links.update((x, y) for x in a for y in b)
    said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return len(ids_a), len(ids_b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest(), links


def brute_rows(texts):
    found = [brute_alignment(x) for x in texts]
    counts = collections.Counter(p for f in found for p in f[5])
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(*f[:4], sum(m for p, m in f[5].items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in f[5].items()), f[4]) for f in found]


def test_cuts_by_divide_and_conquer():
    for n in (1, 2, 3, 50, 400):
        for density in (2, 5, 40):
            a, b = (np.unique(np.append(RNG.integers(1, density * n + 2, n), density * n + 2)) for _ in range(2))
            got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
            assert got.tolist() == np.intersect1d(a, b).tolist()


@pytest.mark.parametrize("hot", [0, 50, 1 << 18])
def test_alignment_of_odd_tables(spark, hot):
    """Nulls, empty and long texts, texts that a side cannot spell, repeated rows, clashing names; counts of few hot pairs or of all."""
    texts = [*ODD, None, "same text here", "same text here", "the of and " * 400, None]
    got = alignment.align_tokenizers(documents(spark, texts), hot_pairs=hot)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == [(k, *row) for k, row in enumerate(brute_rows(texts))]


def test_op11_equals_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = alignment.op11_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = [(i, *row) for (i, _), row in zip(rows, brute_rows([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got.collect())) == want
    assert alignment.align_tokenizers(documents(spark, ["x"]).limit(0)).count() == 0
