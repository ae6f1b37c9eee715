"""Near-duplicates, shared passages, benchmark contamination, and the pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graticule.llm import bpe, decontaminate, near_dup, quality_rules, secret_scan, substring_dedup
from graticule.llm.components import components

from .conftest import WORDS, prose


def plain_shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(rows, size, percent):
    sets = {i: plain_shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(seed, n, edits, words=60):
    """n variants of a text, each with some words changed."""
    draw = random.Random(seed)
    base = [draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(draw.choice(edits)):
            own[draw.randrange(words)] = draw.choice(WORDS) + str(draw.randint(0, 10**6))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("edits", "parts"), [((0, 1, 2, 3, 4), False), ((3, 4, 5, 6, 7), False), ((0, 1, 2, 3, 4), True), ((3, 4, 5, 6, 7), True)])
def test_near_duplicates_are_those_of_brute_force(spark, edits, parts, monkeypatch):
    for name, value in (("BLOCK", 16), ("MEETINGS", 2), *((("LARGE_BUCKET", 6), ("LARGE", 2)) if parts else ())):
        monkeypatch.setattr(near_dup, name, value)  # many blocks, so that classes outside the stars meet across blocks; buckets in parts
    texts = family(1, 90, edits) + family(2, 30, (0, 1)) + [prose(i) for i in range(30)] + ["", None, "one", "One", "one two"]
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == plain_components(rows, 2, 80)


def test_near_duplicates_on_awkward_rows(awkward, nothing):
    rows = near_dup.near_duplicates(awkward, 2, 80).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].kept and by[2].component_id == 1 and not by[2].kept and by[9].component_id == 1
    assert by[3].n_shingles == 0 and by[3].kept and by[4].kept and by[6].kept and by[5].kept and by[None].kept
    left = near_dup.deduplicate(awkward, 2, 80)
    assert left.columns == awkward.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if r.kept}
    assert near_dup.near_duplicates(nothing).count() == 0


def test_deduplicate_judges_texts_not_ids(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a), (2, a + " tail"), (2, prose(4)), (None, a + " end"), (None, prose(5)), (None, prose(6)), (None, None), (None, ""), (None, ""), (3, c), (3, c)]
    rows += [(None, b), (None, b), (None, b.upper()), (None, b + " more")]  # one group without any doc_id
    docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "doc_id long, text string, node string, key int")
    left = near_dup.deduplicate(docs, 2, 80)
    assert left.columns == docs.columns
    got = [r.key for r in left.collect()]
    assert sorted(k for k in got if k < 11) == [0, 2, 4, 5, 6, 7, 8, 9, 10] and len([k for k in got if k >= 11]) == 1


def test_rows_without_id_are_not_multiplied(spark, monkeypatch):
    """Many rows that share a null id, or one id, with different texts: each class reads its own text only."""
    texts = family(5, 40, (0, 1, 2)) + [prose(i) for i in range(20)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)]
    moved = []
    plain = near_dup._full_sets
    monkeypatch.setattr(near_dup, "_full_sets", lambda own, wanted, size: (moved.append(own.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")) & (F.xxhash64("text") == F.col("th"))).count()), plain(own, wanted, size))[1])
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert len(got) == len(rows) and moved and max(moved) <= len(set(texts))


def test_signatures_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    mix = near_dup._mixed
    equal = np.mean(near_dup.signature(np.unique(mix(a))) == near_dup.signature(np.unique(mix(b))))
    assert abs(equal - 800 / 1200) < 0.12
    assert near_dup.needed(252, 80, 1e-6) < 0.8 * 252


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(200, 200), (300, 301), (301, 300), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substrings_are_those_of_brute_force(spark):
    draw = random.Random(5)
    passages = [prose(100 + i, 40) for i in range(6)]
    texts = []
    for _ in range(60):
        texts.append(prose(draw.randint(0, 40), draw.randint(1, 90)) + "".join(draw.choice(passages)[draw.randint(0, 60) :] for _ in range(draw.randint(0, 3))) + prose(draw.randint(0, 999), 20))
    texts += ["ab" * 400, "a" * 700, "a" * 99, "a" * 100, "é" * 300, "", None, "中文" * 90]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.digests(substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == substring_dedup.brute_force(rows)


def test_records_hold_every_string_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 512)
    texts = [prose(i % 3, 300).encode() + prose(50, 80).encode() for i in range(6)] + [b"x" * 99, b"ab" * 300]
    seen = {i: [] for i in range(len(texts))}
    for text, place in substring_dedup.records((i, 0, t) for i, t in enumerate(texts)):
        for row, (doc, _, at, right, left) in zip(text, place.tolist(), strict=True):
            raw = texts[doc]
            assert bytes(row[:right]) == raw[at : at + right] and bytes(row[substring_dedup.SPAN :][:left]) == raw[at - left : at][::-1]
            seen[doc] += range(at - left, at + right - substring_dedup.SPAN + 1)
    assert all(sorted(p) == list(range(len(texts[i]) - substring_dedup.SPAN + 1)) for i, p in seen.items())


def without_spark(rows, buckets, batch=5, m=3):
    """The stages of substring_dedup called one after another: results, and how many rows went across boundaries."""
    batches = lambda: [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + batch]], pa.int64()), pa.array([r[1] for r in rows[i : i + batch]])], names=["doc_id", "text"]) for i in range(0, len(rows), batch)]
    drawn = b"".join(x for b in substring_dedup._drawer(batches()) for x in b.column("record").to_pylist())
    splitters = substring_dedup.Splitters(np.frombuffer(drawn, np.uint8).reshape(-1, substring_dedup.WIDTH), buckets)
    listed = [r for b in substring_dedup._lister(splitters)(batches()) for r in b.to_pylist()]
    assert all(r["bucket"] is None or 0 <= r["bucket"] < splitters.count for r in listed)

    def dealt(found):
        found = sorted(found, key=lambda r: (r["bucket"] is not None, r["bucket"] or 0))
        return [pa.RecordBatch.from_pylist(found[i : i + 7], substring_dedup._FOUND_SCHEMA) for i in range(0, len(found), 7)]

    found = [r for b in substring_dedup._passing(substring_dedup._comparer(splitters, m))(dealt(listed)) for r in b.to_pylist()]
    across = [r for r in found if r["blob"] is not None]
    spans = {}
    for r in [r for r in found if r["blob"] is None] + [r for b in substring_dedup._compare_strings(dealt(across)) for r in b.to_pylist()]:
        spans.setdefault((r["doc"], r["th"]), []).append((r["lo"], r["hi"]))
    out = {}
    for doc, text in rows:
        raw = (text or "").encode()
        kept, gone, pieces = substring_dedup.cut(raw, spans.get((doc, substring_dedup.text_hash(text)), []))
        out[doc] = (len(raw), gone, pieces, hashlib.sha256(kept).hexdigest())
    return out, len(across)


@pytest.mark.parametrize(("chunk", "bucket", "splitters", "buckets"), [(1 << 18, 10**6, 4096, 1), (300, 5, 4096, 40), (120, 50, 3, 40), (300, 5, 4096, 300), (1 << 18, 50, 3, 300)])
def test_substrings_across_buckets_and_boundaries(monkeypatch, chunk, bucket, splitters, buckets):
    for name, value in (("CHUNK", chunk), ("BUCKET", bucket), ("SPLITTERS", splitters)):
        monkeypatch.setattr(substring_dedup, name, value)
    crossed = 0
    for seed in range(4):
        draw = random.Random(seed)
        word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 6)))
        passages = [" ".join(word() for _ in range(draw.randint(15, 80))) for _ in range(4)]
        rows = []
        for i in range(40):
            text = ""
            for _ in range(draw.randint(0, 5)):
                passage = draw.choice(passages)
                text += draw.choice([passage, passage[draw.randrange(len(passage)) :], "\0" * draw.randint(1, 150), "é中" * draw.randint(1, 80), " ".join(word() for _ in range(draw.randint(1, 50)))])
            rows.append((3 * i - 20, text))
        draw.shuffle(rows)
        got, across = without_spark(rows, buckets)
        assert got == substring_dedup.brute_force(rows)
        crossed += across
    assert crossed > 0 or buckets == 1


def test_substrings_on_awkward_rows(spark, awkward, nothing):
    rows = substring_dedup.deduplicate(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].n_bytes == 0 and by[4].n_removed == 0 and by[1].n_removed == 0
    twice = [r for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and all(r.n_removed == r.n_bytes and r.n_spans == 1 and r.kept == b"" for r in twice)
    other = spark.createDataFrame([(1, "x" * 30 + prose(1)), (1, prose(2))], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.deduplicate(other).collect()) == [0, 0]
    assert substring_dedup.deduplicate(nothing).count() == 0


def test_multikey_order_is_lexicographic():
    draw = np.random.default_rng(1)
    words = [draw.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    assert [tuple(int(w[i]) for w in words) for i in substring_dedup.multikey_order(words)] == sorted(zip(*(w.tolist() for w in words)))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items):
    out = {}
    windows = [(i, tuple(w[k : k + min(10, len(w))])) for i, t in items if (w := plain_words(t)) for k in range(max(1, len(w) - 9))]
    for doc_id, text in docs:
        own, hit, met = plain_words(text), set(), set()
        for i, gram in windows:
            for k in range(len(own) - len(gram) + 1):
                if tuple(own[k : k + len(gram)]) == gram:
                    hit.update(range(k, k + len(gram)))
                    met.add(str(i))
        out[doc_id] = (len(own), len(hit), len(met), sorted(met))
    return out


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, -1])
def test_contamination_is_that_of_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    items = [(1, prose(1, 30)), (2, "Tiny item"), (3, prose(1, 30)[40:]), (4, None), (5, ""), (10, "one two three four five six seven eight nine ten"), (11, "a a a a a a a a a a a")]
    docs = [(0, prose(9) + " " + prose(1, 30) + " " + prose(8)), (1, prose(1, 30).upper()), (2, "x tiny, ITEM y tiny"), (3, None), (4, ""), (5, "a " * 40), (6, "ONE-two three.four five six seven eight nine ten!"), (7, prose(1, 30)[20:90]), (8, prose(7)), (9, "É é one two")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.item_ids) for r in decontaminate.contamination(a, b).collect()}
    assert got == plain_contamination(docs, items)
    assert {r.doc_id for r in decontaminate.decontaminate(a, b).collect()} == {i for i, x in got.items() if not x[1]}


def test_contamination_on_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, prose(1, 20), 3)], "item_id long, text string, doc_id int")
    rows = decontaminate.contamination(awkward, items).collect()
    assert len(rows) == awkward.count() and {r.doc_id for r in rows if r.contaminated} == {1, 2, 9}
    left = decontaminate.decontaminate(awkward, items)
    assert left.columns == awkward.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if not r.contaminated}
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(awkward, items.where("false")).collect())


def test_winnowing_uses_no_python(spark, awkward):
    plan = decontaminate.contamination(awkward, awkward.selectExpr("doc_id AS item_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [i for i, r in docs.items() if quality_rules.verdict(quality_rules.repetition(r.text))[1]]
    groups = plain_components([(i, docs[i].text) for i in left], 5, 80)
    left = [i for i in left if groups[i][1] == i]
    hit = plain_contamination([(i, docs[i].text) for i in left], items)
    left = [i for i in left if not hit[i][1]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == sorted(left) and all(r.decodes and r.n_tokens == len(r.ids) for r in got.values())
    decoder = bpe.Decoder(bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)))
    for i in left:
        text = decoder.decode(np.array(got[i].ids, np.int32))
        if not secret_scan.base_spans(docs[i].text):
            assert hashlib.sha256(text.encode()).digest() == hashlib.sha256(docs[i].text.encode()).digest() or "[secret]" in text
        else:
            assert "[secret]" in text and not secret_scan.base_spans(text)
