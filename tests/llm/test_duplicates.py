"""SimHash, suffix dedup and line dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from loglens.llm import components, line_dedup, parsing, simhash, suffix_dedup
from tests.llm.conftest import COLUMNS


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, max_bits=2):
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= max_bits:
                parent[root(a)] = root(b)
    return {p: root(p) for p in distinct}


def brute_near(rows, max_bits=2):
    prints = [brute_print(text) for _, text in rows]
    roots = brute_components(prints, max_bits)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        ids = [x for x in (least.get(roots[p]), doc_id) if x is not None]
        least[roots[p]] = min(ids) if ids else None
    return [(doc_id, f"{p:016x}", least[roots[p]]) for (doc_id, _), p in zip(rows, prints)]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_near_duplicates(table, request):
    docs = request.getfixturevalue(table)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_near(pairs(docs)), key=repr)


@pytest.mark.parametrize("max_bits", [0, 4])
def test_other_distances(odd, max_bits):
    got = [tuple(r) for r in simhash.near_duplicates(odd, max_bits=max_bits).collect()]
    assert sorted(got, key=repr) == sorted(brute_near(pairs(odd), max_bits), key=repr)


def test_odd_distance_is_refused(odd):
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd, max_bits=3)


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = brute_near(pairs(odd))
    want = Counter(p for _, p, _ in rows if p)
    groups = defaultdict(list)
    prints = {p: root for p, root in brute_components([int(p, 16) for _, p, _ in rows]).items()}
    for doc_id, p, _ in rows:
        groups[prints[int(p, 16)]].append(doc_id)
    expected = sorted((min((x for x in ids if x is not None), default=None) for ids in groups.values()), key=repr)
    assert want and sorted((r.doc_id for r in kept.collect()), key=repr) == expected


def test_empty_duplicates(none):
    assert simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, x) for x in range(101, 180)]
    edges = spark.createDataFrame(path + star + [(7, 7), (100, 101), (None, 4)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}


def brute_removed(rows, width):
    starts = Counter()
    for _, body in rows:
        starts.update(body[i : i + width] for i in range(len(body) - width + 1))
    for doc_id, body in rows:
        gone = bytearray(len(body))
        for i in range(len(body) - width + 1):
            if starts[body[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        yield doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def removed(docs, **how):
    for r in suffix_dedup.remove_repeats(docs, **how).collect():
        cut = sum(s.end - s.start for s in r.removed)
        assert r.n_bytes - len(r.kept) == cut
        yield r.doc_id, r.n_bytes, cut, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_LIMIT, 2])
@pytest.mark.parametrize("table", ["odd", "documents"])
def test_remove_repeats(table, limit, request):
    docs = request.getfixturevalue(table)
    rows = [(i, (t or "").encode()) for i, t in pairs(docs)]
    assert sorted(removed(docs, group_limit=limit), key=repr) == sorted(brute_removed(rows, 200), key=repr)


def test_repeats_across_slices(odd, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t in pairs(odd)]
    schema = COLUMNS.split(", lang")[0]
    long = b"".join(body for _, body in rows[:30])
    docs = odd.sparkSession.createDataFrame([(1, long.decode()), (2, long[777:].decode(errors="ignore"))], schema)
    rows = [(i, t.encode()) for i, t in pairs(docs)]
    assert len(long) > parsing.SLICE
    assert sorted(removed(docs)) == sorted(brute_removed(rows, 200))


def test_many_copies_of_one_row(spark):
    """10,000 rows with the same null id and text: each has the runs of one."""
    words = " ".join(f"w{i * 7919 % 1000}" for i in range(150))
    docs = spark.range(10_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(words).alias("text"))
    got = suffix_dedup.remove_repeats(docs)
    n = len(words.encode())
    want = [(None, n, b"", [(0, n)])]
    assert [(r.doc_id, r.n_bytes, bytes(r.kept), list(map(tuple, r.removed))) for r in got.distinct().collect()] == want
    assert got.count() == 10_000


@pytest.mark.parametrize("hot", [1, 3])
def test_copies_of_hot_entries(odd, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ENTRIES", hot)
    want = sorted(removed(odd), key=repr)
    monkeypatch.setattr(suffix_dedup, "HOT_ENTRIES", 1 << 40)
    assert sorted(removed(odd), key=repr) == want


def test_no_repeats(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def brute_lines(rows, max_ratio=line_dedup.MAX_RATIO, min_pages=line_dedup.MIN_PAGES):
    pages, seen = Counter(s for _, s, _ in rows), Counter()
    for _, source, text in rows:
        seen.update((source, line) for line in {*(text or "").split("\n")} if line.strip(" \t\n\r\x0b\x0c"))
    for doc_id, source, text in rows:
        lines = (text or "").split("\n")
        bad = [seen[source, x] >= min_pages and seen[source, x] > max_ratio * pages[source] for x in lines]
        yield doc_id, source, sum(bad), "\n".join(x for x, b in zip(lines, bad) if not b) if any(bad) else text


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_line_dedup(table, request):
    docs = request.getfixturevalue(table)
    cleaned = line_dedup.drop_boilerplate(docs, dropped="dropped", min_pages=8)
    assert cleaned.columns == [*docs.columns, "dropped"]
    got = [(r.doc_id, r.source, r.dropped, r.text) for r in cleaned.collect()]
    want = list(brute_lines([(r.doc_id, r.source, r.text) for r in docs.collect()], min_pages=8))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert table == "documents" or sum(r[2] for r in want) > 40


def test_line_dedup_of_nothing(none):
    assert line_dedup.drop_boilerplate(none).count() == 0


def test_small_hosts_are_cleaned(spark):
    """A host of nine pages with a footer on each, and one of three; a line on two pages of a small host stays."""
    pages = [(i, "nine", f"body {i}\nfooter\n{'twice' if i < 2 else 'other ' + str(i)}") for i in range(9)]
    pages += [(10 + i, "three", f"text {i}\nHome | About") for i in range(3)]
    pages += [(20 + i, "two", "same on both") for i in range(2)]
    docs = spark.createDataFrame(pages, "doc_id bigint, source string, text string")
    got = {r.doc_id: (r.text, r.dropped) for r in line_dedup.drop_boilerplate(docs, dropped="dropped").collect()}
    assert got[0] == ("body 0\ntwice", 1) and got[8] == ("body 8\nother 8", 1)
    assert got[11] == ("text 1", 1) and got[20] == ("same on both", 0)


def test_most_header_and_footer_lines_are_caught(spark):
    """Lines in at least 0.5 % of the documents, which come first or last in 90 % of them."""
    docs = [(r.doc_id, r.source, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text").collect()]
    seen, at_end = Counter(), Counter()
    for _, _, text in docs:
        lines = [x for x in text.split("\n") if x.strip()]
        seen.update(set(lines))
        at_end.update({*lines[:1], *lines[-1:]})
    edges = {x for x, n in seen.items() if n >= 0.005 * len(docs) and at_end[x] >= 0.9 * n}
    found = line_dedup.boilerplate(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("host", "line").collect()
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in edges], "x string").selectExpr("x", "xxhash64(x)").collect()}
    bad = {(r.host, r.line) for r in found}
    held = [(source, hashed[x]) in bad for _, source, text in docs for x in edges.intersection(text.split("\n"))]
    assert len(held) > 3000 and sum(held) > 0.6 * len(held)
