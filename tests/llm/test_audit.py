"""The filter audit and its tries against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loglens.llm import filter_audit, text_tries
from tests.conftest import rows


def brute_masks(docs, labels):
    good, toxic = defaultdict(bool), defaultdict(bool)
    for doc_id, q, t in labels:
        good[doc_id] |= q == 1
        toxic[doc_id] |= t == 1
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > least[text],
        }
        known = doc_id is not None
        out.append((part or "", {f for f, x in fails.items() if x}, known and good[doc_id], known and toxic[doc_id]))
    return out


def brute_report(docs, labels):
    masks = brute_masks(docs, labels)
    out = {}
    for order in permutations("ABCDE"):
        left = masks
        for step, f in enumerate(order, 1):
            kept = [m for m in left if f not in m[1]]
            gone = [m for m in left if f in m[1]]
            for part in {m[0] for m in masks}:
                mine = [m for m in gone if m[0] == part]
                fails = sum(m[0] == part and f in m[1] for m in masks)
                out[part, "".join(order), step] = [
                    sum(m[0] == part for m in kept), len(mine), fails - len(mine),
                    sum(m[0] == part and m[1] == {f} for m in masks), sum(m[2] for m in mine), sum(m[3] for m in mine),
                ]
            left = kept
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


@pytest.fixture(scope="module")
def labels(spark):
    rng = random.Random(3)
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 100, 2)]
    return spark.createDataFrame(marks + marks[:5] + [(4, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("trie_bytes, ranges", [(text_tries.TRIE_BYTES, text_tries.RANGES), (3000, 3)])
def test_audit(spark, odd, labels, trie_bytes, ranges):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    marks = [tuple(r) for r in labels.collect()]
    got = filter_audit.report(filter_audit.masks(odd, labels, trie_bytes=trie_bytes, ranges=ranges))
    assert rows(got) == sorted(brute_report(docs, marks), key=repr)


def test_empty_tables(spark, none, odd, labels):
    assert filter_audit.report(filter_audit.masks(none, labels)).count() == 0
    docs = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    assert rows(filter_audit.report(filter_audit.masks(odd, labels.limit(0)))) == sorted(brute_report(docs, []), key=repr)


texts = st.lists(st.tuples(st.text("abé", max_size=6).map(str.encode), st.integers(-3, 3), st.sampled_from("xy")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_trie_holds_the_least_id_of_every_text(found):
    trie, least = text_tries.Trie(), {}
    for text, doc_id, part in found:
        trie.insert(text, doc_id, len, part)
        least[text] = min(doc_id, least.get(text, doc_id))
    n = Counter((t, i, p) for t, i, p in found if least[t] == i)
    assert sorted(trie.walk()) == sorted((t, i, len(t), p, c) for (t, i, p), c in n.items())


def test_ranges_adapt_to_common_beginnings():
    rng = random.Random(1)
    common = b"the same beginning of very many texts "
    sample = [(common + rng.randbytes(30), 100.0) for _ in range(900)] + [(rng.randbytes(30), 100.0) for _ in range(100)]
    ranges = text_tries.cut_ranges(sample, 50, 10_000)
    held = Counter(ranges.of(text) for text, _ in sample)
    assert len(held) >= 45 and max(held.values()) <= 25
    assert len({len(b) for b in ranges.bounds}) > 1 and max(map(len, ranges.bounds)) < 68


def test_one_prefix_of_many_texts_gets_slots():
    sample = [(b"x" * text_tries.PREFIX, 1000.0) for _ in range(500)]
    ranges = text_tries.cut_ranges(sample, 50, 10_000)
    assert ranges.bounds == () and ranges.slots == (50,)
    texts = [b"x" * 600 + str(i).encode() for i in range(5000)]
    held = Counter(ranges.of(t) for t in texts)
    assert len(held) == 50 and max(held.values()) < 200


def test_copies_travel_once_a_task(spark):
    """Of a text that a third of all rows hold, every task sends one row."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('copy ', 100), concat('text ', id)) as text", "'s' as part")
    docs = docs.repartition(6)
    found = text_tries.find_ranges(docs, "text")
    own = docs.selectExpr("doc_id", "part", "cast(text as binary) as body").mapInArrow(
        text_tries._own_tries(found, len, 1 << 24), text_tries._TEXTS
    )
    assert own.filter("value = 500").count() == 6
    first = text_tries.first_copies(docs, len)
    assert [r["doc_id"] for r in first.filter("value = 500").collect()] == [0]
    assert first.count() == 20_001
