from __future__ import annotations

import itertools
import random

import pyarrow as pa
import pytest
import sentencepiece
from hostlake.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def bpe():
    return pieces.load_vocabulary()


def odd_texts():
    rng = random.Random(4)
    texts = ["", " ", "  ", "a", " a\tb  ", "x" * 300, "ab" * 200 + " c", "日本語のテキスト 🎉 ok\n\n \n", "Ünïcödé—“quotes” … 12345 +1 (947) 555-7668", "http://a.b/c?d=e&f=%20", "▁ lower", "a     b         c", "..............!!!!", "\x00\x01 ​", *(" " * i + "x" for i in range(2, 40)), "      " * 20, "the    " * 9]
    texts += ["".join(rng.choice("etaoin  srhl.,'\n-XQ9é中") for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    return texts


def test_ids_equal_the_library(spark, bpe, library, tmp_path, monkeypatch):
    texts = odd_texts()
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "hello world", None), (3, None, None), (3, "again", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((str(i), library.encode(t or "")) for i, t, _ in rows)
    for source, size, lattice in ((docs, 32 << 20, 128), (docs, 500, 128), (docs.repartition(3), 500, 8)):
        monkeypatch.setattr(pieces, "CHUNK_BYTES", size)
        monkeypatch.setattr(pieces, "PART_BYTES", size // 4)
        monkeypatch.setattr(pieces, "SLICE", size // 8)
        monkeypatch.setattr(pieces, "LATTICE", lattice)
        got = pieces.encoded(source, bpe).collect()
        assert sorted((str(r.doc_id), r.ids) for r in got) == want
    done = pieces.op6_pieces(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in done) and len(done) == len(rows)
    assert pieces.encoded(docs.limit(0), bpe).collect() == []


def test_long_words_equal_the_library(bpe, library):
    cut = pieces.cutter(bpe)
    for t in odd_texts():
        words, ends = cut(pa.array([t, None]))
        assert ends.tolist() == [len(words)] * 2
        assert [i for w in words.to_pylist() for i in pieces.segment_long(w, bpe)] == library.encode(t)


def segmented(spark, words, vocabulary):
    rows = pieces.segmented(spark.createDataFrame([(w,) for w in set(words)], "word string"), vocabulary).collect()
    ids = pieces.resolved(pa.array([r.ids for r in rows], pa.list_(pa.int32())), vocabulary).to_pylist()
    return dict(zip([r.word for r in rows], ids, strict=True))


def test_bpe_path_equals_merges(spark):
    """Random vocabularies, with many overlapping and repeated merges, against a slow merge loop."""
    rng = random.Random(3)
    for trial in range(4):
        scores = dict.fromkeys("ab▁", 0.0)
        while len(scores) < 30:
            piece = "".join(rng.choice(list(scores)) for _ in range(2))
            if len(piece) < 20:
                scores.setdefault(piece, -float(len(scores)) if trial else -float(len(piece)))
        vocabulary = pieces.Vocabulary("bpe", scores, {p: i + 1 for i, p in enumerate(scores)}, -1, 0)
        try:
            vocabulary.halves()
        except ValueError:
            continue
        words = {"".join(rng.choice("aab▁c") for _ in range(rng.randrange(1, 30))) for _ in range(150)}
        got = segmented(spark, words, vocabulary)
        assert len(got) > len(words) / 2
        for w in words:
            parts = list(w)
            while True:
                best = min(((-scores[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in scores), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
            want = [vocabulary.ids.get(p, 0) for p in parts]
            assert got.get(w, want) == want == pieces.segment_long(w, vocabulary), (w, parts)


def test_halves_merged_late_are_refused():
    scores = {"a": 0.0, "b": 0.0, "ab": -2.0, "aba": -1.0}
    with pytest.raises(ValueError, match="merged after"):
        pieces.Vocabulary("bpe", scores, {p: i for i, p in enumerate(scores)}, -1, 9).halves()


def test_whole_table_equals_the_library(spark, sf, bpe, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in pieces.op6_pieces(spark, sf).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i].ids == library.encode(t) and got[i].n_tokens == len(got[i].ids) and got[i].round_trip for i, t in texts.items())


def best_path(word, scores, floor):
    """Brute force over all segmentations."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:], strict=False)]
        if all(p in scores or len(p) == 1 for p in parts):
            worth = sum(scores.get(p, floor) for p in parts)
            best = max(best or (worth, parts), (worth, parts), key=lambda x: x[0])
    return best


def test_viterbi_fold(spark):
    rng = random.Random(9)
    scores = {c: -rng.random() * 9 for c in "abc"} | {"".join(p): -rng.random() * 9 for n in (2, 3) for p in itertools.product("abc", repeat=n) if rng.random() < 0.5}
    vocabulary = pieces.Vocabulary("unigram", scores, {p: i + 1 for i, p in enumerate(scores)}, -1, 0)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    got = segmented(spark, words, vocabulary)
    assert got.keys() == set(words)
    floor = min(scores.values()) - 10
    spelled = {i: p for p, i in vocabulary.ids.items()}
    for w, ids in got.items():
        worth, parts = best_path(w, scores, floor)
        assert sum(scores[spelled[i]] if i else floor for i in ids) == pytest.approx(worth)
        assert ids == pieces.segment_long(w, vocabulary) == [vocabulary.ids.get(p, 0) for p in parts]


def test_decoding(spark, bpe, library):
    rows = [(1, library.encode("héllo  wörld\n🎉")), (2, []), (3, None), (4, [3 + 0xFF, 10**6])]
    got = {r.i: r.decoded for r in pieces.decoded(spark.createDataFrame(rows, "i int, ids array<int>"), bpe).collect()}
    assert got == {1: "héllo  wörld\n🎉", 2: "", 3: None, 4: "�"}
