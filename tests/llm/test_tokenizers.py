"""Byte-level BPE against the tiktoken library, alignment against its definition."""

import base64
import hashlib
import random
import tracemalloc
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from loglens.llm import alignment, byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    lines = map(bytes.split, open(RANKS, "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in lines}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary(spark):
    return byte_bpe.load(spark, RANKS, public_tokenizers.PATTERN)


def awkward(seed, n=300):
    """Texts of runs that pre-tokens end at, or do not."""
    rng = random.Random(seed)
    parts = ["word", "don't", " 'll", "'re", "'", "  ", "\n", "\t \n", " 12", "345", "東京", "été", "!?", " ...", "<|endoftext|>", "a" * 60,
             " " * 50, "9" * 40, "\x1c", " ", "x'", "🙂"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("chunk, overlap", [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (200, 80), (40, 40)])
def test_encoding(spark, odd, documents, reference, vocabulary, chunk, overlap):
    docs = odd.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("part"), F.lit(3).alias("body")).unionByName(
        spark.createDataFrame([(500 + i, awkward(i), 1, 2, 3) for i in range(40)], "doc_id bigint, text string, row int, part int, body int")
    )
    got = byte_bpe.encode(docs, vocabulary, chunk=chunk, overlap=overlap)
    assert got.columns == [*docs.columns, "token_ids"]
    got = got.withColumn("decoded", byte_bpe.decode("token_ids", vocabulary)).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or "")
    want = sorted(docs.collect(), key=key)
    assert [tuple(r)[:5] for r in sorted(got, key=key)] == [tuple(r) for r in want]
    for r in got:
        assert r["token_ids"] == reference.encode_ordinary(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").encode()


def test_chunks_that_do_not_meet(spark, reference, vocabulary):
    texts = ["a" * 5000, "x " + "b" * 900 + " y z " * 200, " " * 3000 + "end", "c d " * 400 + "é" * 700 + " e" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in byte_bpe.encode(docs, vocabulary, chunk=300, overlap=100).collect():
        assert r["token_ids"] == reference.encode_ordinary(r["text"])


def test_meeting():
    codec = byte_bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    text = "one two three four five six seven eight"
    assert byte_bpe.meeting(codec, text, 10, 29, 4) == 13  # the chunk cuts "three", which ends at 13
    assert byte_bpe.meeting(codec, "a" * 39, 10, 29, 4) is None


def test_unknown_id_and_null(spark, vocabulary):
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(byte_bpe.decode("ids", vocabulary)).collect()] == [None, b""]
    with pytest.raises(Exception, match="KeyError"):
        spark.createDataFrame([([99_999],)], "ids array<int>").select(byte_bpe.decode("ids", vocabulary)).collect()


def test_ids_are_held_in_runs():
    """A worker holds a run of the ids of its rows, not all 8,000,000 (32 MB)."""
    tracemalloc.start()
    try:
        sizes = [len(run) for run in byte_bpe._lists(array("i", bytes(80_000)) for _ in range(400))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == 400 and max(sizes) == 14
    assert peak < 8_000_000
    assert [len(run) for run in byte_bpe._lists([array("i"), array("i", [1])])] == [2]
    assert list(byte_bpe._lists([])) == []


def test_runs_of_lists():
    lists = [None, [], [1] * 300_000, [2], None, [3] * byte_bpe.RUN, [], [4] * 9, None]
    column = pa.array([[0], *lists], pa.list_(pa.int32())).slice(1)
    runs = list(byte_bpe._runs(column))
    assert [x for run in runs for x in run.to_pylist()] == lists
    assert max(sum(map(len, filter(None, run.to_pylist()))) for run in runs) == 300_000
    assert list(byte_bpe._runs(column.slice(0, 0))) == []


def test_packed_and_decoded_in_runs(spark, vocabulary):
    token = {rank: token for token, rank in byte_bpe.rank_table(open(RANKS, "rb").read()).items()}
    lists = [None, [], [300] * 300_000, [2], None, [5000, 7] * 150_000, [], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>").coalesce(1)
    both = byte_bpe.packed_and_decoded("ids", vocabulary)
    got = df.select("i", both.alias("both"), byte_bpe.packed("ids").alias("packed"), byte_bpe.decode("ids", vocabulary).alias("decoded"))
    for r in got.collect():
        ids = lists[r["i"]]
        want = (None, None) if ids is None else (np.array(ids, "<u4").tobytes(), b"".join(map(token.get, ids)))
        assert (r["both"]["packed"], r["both"]["decoded"]) == want == (r["packed"], r["decoded"])


def test_texts_of_several_runs(spark, reference, vocabulary):
    texts = ["", *(f"{i} two three\n" * 1000 for i in range(150)), "", "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = byte_bpe.encode(docs, vocabulary).collect()
    assert sum(len(r["token_ids"]) for r in got) > 2 * byte_bpe.RUN
    assert {r["doc_id"]: r["token_ids"] for r in got} == {i: reference.encode_ordinary(t) for i, t in enumerate(texts)}


def test_texts_are_encoded_once(spark, documents, vocabulary, capsys):
    """Though three columns come from the ids."""
    docs = byte_bpe.encode(documents, vocabulary)
    docs.select(F.size("token_ids"), byte_bpe.packed("token_ids"), byte_bpe.decode("token_ids", vocabulary)).explain()
    plan = capsys.readouterr().out
    short, _ = plan.split("Union")[1].split("BroadcastHashJoin" if "BroadcastHashJoin" in plan else "SortMergeJoin", 1)
    assert short.count("encode_whole(") == 1


def test_encoding_of_an_empty_table(none, vocabulary):
    assert byte_bpe.encode(none, vocabulary).count() == 0


def test_op12(spark, reference):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]
        ids = reference.encode_ordinary(text)
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), text.encode())]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *sha]


# Alignment


class Reference:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.letters = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = [b for b in range(256) if b not in self.letters.values()]
        self.letters |= {chr(256 + i): b for i, b in enumerate(rest)}

    def tokens(self, text):
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        return a, b

    def aligned(self, text):
        """(n_a, n_b, groups, links), or none."""
        if not text:
            return None
        a, b = self.tokens(text)
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return None
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, first = [], 0
        for i, low, high in spans[0]:
            while spans[1][first][2] <= low:
                first += 1
            at = first
            while at < len(spans[1]) and spans[1][at][1] < high:
                links.append((i, spans[1][at][0]))
                at += 1
        cuts = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        sides = [[[] for _ in cuts] for _ in spans]
        for side, groups in zip(spans, sides, strict=True):
            for i, _, end in side:
                groups[bisect_left(cuts, end)].append(str(i))
        return len(a), len(b), [",".join(x) + "|" + ",".join(y) for x, y in zip(*sides, strict=True)], links

    def measures(self, docs):
        known = {text: self.aligned(text) for _, text in docs}
        counts = Counter(link for _, text in docs if known[text] for link in known[text][3])
        best = {}
        for (_, b), n in counts.items():
            best[b] = max(n, best.get(b, 0))
        for doc_id, text in docs:
            if known[text] is None:
                yield doc_id, 0, 0, 0, 0, 0, 0, ""
                continue
            n_a, n_b, groups, links = known[text]
            n_best = sum(counts[link] == best[link[1]] for link in links)
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            yield doc_id, n_a, n_b, len(groups), len(links), n_best, sum(counts[link] for link in links), sha


@pytest.fixture(scope="module")
def pair(spark):
    path = public_tokenizers.path
    return alignment.load(spark, path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [alignment.HEAD, 300, 0])
def test_alignment(spark, odd, pair, head):
    extra = [awkward(i, 60) for i in range(30)] + ["▁ piece", "<0x41> <s>", "zero\x00byte", "ﬁ ½", " lead", "<|endoftext|>"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 300)), "doc_id bigint, text string"))
    docs = docs.withColumn("key", F.lit("x")).withColumn("copies", F.lit(1)).withColumn("slot", F.lit(2))
    want = Reference().measures([(r[0], r[1]) for r in docs.collect()])
    got = alignment.measures(docs, pair, head=head).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_with_hot_texts(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_KEYS", 3)
    docs = spark.range(90).selectExpr("id as doc_id", "if(id % 2 = 0, 'the hot text', concat('text number ', id % 7)) as text")
    want = Reference().measures([(r[0], r[1]) for r in docs.collect()])
    assert sorted(map(tuple, alignment.measures(docs, pair).select(*COLUMNS).collect())) == sorted(want)


def test_alignment_of_an_empty_table(none, pair):
    assert alignment.measures(none, pair).count() == 0


@pytest.fixture(scope="module")
def aligner():
    path = public_tokenizers.path
    return alignment.Aligner(*(open(path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def test_units_join_to_the_tokens_of_the_text(aligner):
    """With every kind of white space and control character around spaces."""
    rng = random.Random(8)
    odd = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "a", "é", "'s", "9", "!", "東", "word", "The"]
    texts = ["".join(rng.choice(odd) for _ in range(40)) for _ in range(1500)] + [awkward(i, 50) for i in range(40)]
    cut = 0
    for text in texts:
        units = aligner.units(text)
        assert " ".join(units) == text
        cut += len(units) > 1
        assert [i for u in units for i in aligner.a.encode(" " + u).ids] == aligner.a.encode(" " + text).ids
        assert [i for u in units for i in aligner.b.encode(u)] == aligner.b.encode(text)
    assert cut > 500


def test_blocks_and_batches_of_units(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 10)
    texts = [" ".join(f"w{i % 37}" for i in range(300)), "a ▁ b", "one", "w1  w2 w1 w1"]
    got = aligner.align(texts)
    assert [g is None for g in got] == [False, True, False, False]
    for text, found in zip(texts, got, strict=True):
        if found:
            n_a, n_b, groups, links = Reference().aligned(text)
            assert found[0] == [n_a, n_b, len(groups), len(links)]
            assert found[1] == hashlib.sha256(";".join(groups).encode()).hexdigest()
            pairs = Counter()
            for a, b, n in zip(*(x.tolist() for x in found[2:]), strict=True):
                pairs[a, b] += n
            assert pairs == Counter(links)
    assert aligner.align(["▁"]) == [None] and aligner.align([]) == []


def test_op13(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op13_alignment(spark, "/root/testdata/sf0.001").select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(Reference().measures(docs))


def test_lines_of_plain_units_give_the_same(aligner):
    path = public_tokenizers.path
    file_a, file_b = (open(path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    assert alignment.merges_by_rank(file_a)
    fast = alignment.Aligner(file_a, file_b, True)
    draw = random.Random(7)
    letters = "abcdeéßñŁ'sTh09.,-#<|>endoftext\n "
    units = ["".join(draw.choices(letters, k=draw.randrange(1, 40))) for _ in range(20_000)]
    units = [u for u in dict.fromkeys(u.strip() for u in units) if alignment._PLAIN.fullmatch(u)]
    units += ["<|endoftext|>", "ĳ", "a" * 500, "x  y", "it's\n\n  don't", "ŉ", "ǆ"]
    assert fast.on_a_line(units[:1000]) is not None
    assert fast.aligned_units(units) == aligner.aligned_units(units)
    mixed = ["日本", *units[:50], "", " a", "b ", "a" * 600, "\t"]
    assert fast.known_units(mixed) == aligner.known_units(mixed)


def test_merges_out_of_order_are_not_by_rank():
    import json

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = json.load(open(path))
    whole["model"]["merges"][300:302] = whole["model"]["merges"][301:299:-1]
    assert not alignment.merges_by_rank(json.dumps(whole).encode())
