"""Files, mixing, sharding, the pipeline and the registered queries."""

import io
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from meridia.llm import mixing, sharding, token_files, warc
from meridia.llm import queries as Q
from meridia.llm._store import shared
from tests.llm import brute
from tests.test_oracles import table

TOKENIZER = Q.vocabulary()
ODD = ["a b", "a   b", "x　y z", " ", "a b\n", "\n", " \n a", "a<|endoftext|> b", "x <|endoftext|> y", "don't we'll  it's", " a   b c d", "a\x1c b", "١٢ ٣"]


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="the vocabulary isn't here")
def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = brute.odd_texts(7) + ODD + ["the same words again and again " * 40] * 3
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "twice"), (None, "no id")]
    manifest = token_files.write_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shared(spark), TOKENIZER, shard_ids=700)
    got = sorted(map(tuple, token_files.read_shards(manifest).collect()), key=lambda r: r[1])
    ids = defaultdict(list)
    for k, t in rows:
        ids[k].append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    at = 0
    for k, start, n, crc, _ in got:
        assert start == at and (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[k]]
        at += n
    order = [k for k, *_ in got]
    assert order == sorted(order, key=lambda k: -1 if k is None else k) and Counter(order) == Counter(k for k, _ in rows)
    assert len({r[4] for r in got}) > 3
    for path in {r[4] for r in got}:
        shard = token_files.Shard(path)
        whole = shard.ids()
        for a, b in ((0, 1), (3, 90), (len(whole) // 2, len(whole)), (5, 5)):
            assert shard.decode_range(a, b).tolist() == whole[a:b].tolist()
        assert len(whole) == shard.head["n_ids"] == shard.section("counts").sum()


def test_token_files_of_empty_table_long_text_and_clashing_names(spark):
    rows = [(i, "the same words again and again " * (20_000 if i == 1 else 2), "x", "y", -1) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, _text string, start long")
    read = lambda df: token_files.read_shards(token_files.write_shards(df, shared(spark), TOKENIZER)).orderBy("start").collect()
    got = read(docs)
    assert [r.doc_id for r in got] == [0, 1, 2, 3] and got[1].n_tokens > 100_000 and got[0].ids_crc32 == got[2].ids_crc32
    assert read(docs.limit(0)) == []


def test_other_white_space():
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace() and chr(c) not in " \t\n\x0b\x0c\r"]
    text = "".join(f"a{chr(c)}" for c in [*range(0x20, 0x300), *range(0x1600, 0x1700), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010)]) + "".join(spaces)
    raw = text.encode()
    want = [len(text[:i].encode()) for i, c in enumerate(text) if c in spaces]
    assert token_files._other_spaces(np.frombuffer(raw, np.uint8)).tolist() == want


def test_repair_of_random_ids():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 20_000):
        ids = rng.integers(0, 6, n).astype(np.uint32)
        counts = np.array([n // 3, n - n // 3])
        seq, rules, after = token_files.compress(ids, counts, 50_257)
        assert token_files.expand(seq, rules, after, 50_257).tolist() == ids.tolist()
        size = np.concatenate([np.ones(50_257, int), token_files.lengths(rules, after, 50_257)])
        assert size[seq].sum() == n and (n < 20_000 or len(seq) < 0.55 * n)


def test_repair_of_a_large_vocabulary():
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.tile([70_001, 69_999, 3], 400), rng.integers(0, 70_002, 500)]).astype(np.uint32)
    for first in (70_002, 65_536, 65_400):
        own = np.minimum(ids, first - 1)
        seq, rules, after = token_files.compress(own, np.array([700, 1000]), first)
        assert seq.dtype == np.uint32 and len(rules) and token_files.expand(seq, rules, after, first).tolist() == own.tolist()
    with pytest.raises(ValueError, match="vocabulary"):
        token_files.compress(ids, np.array([1700]), 50_257)


def test_rules_stand_for_frequent_pairs():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 30, 20_000).astype(np.uint32)
    _, rules, after = token_files.compress(ids, np.array([20_000]), 65_000)
    seen = Counter(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))
    assert all(seen[tuple(r)] >= token_files.FREQUENT for r in rules[: after[0]].tolist())


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50_000, 300)
    docs = [np.concatenate([passage, rng.integers(0, 50_000, 40), [0]]) for _ in range(400)]
    cases = [(np.concatenate(docs), [len(d) for d in docs]), (np.tile(np.append(passage, 0), 3000), [301] * 3000), (np.zeros(100_000), [100_000])]
    for ids, counts in ((i.astype(np.uint32), np.array(c)) for i, c in cases):
        seq, rules, after = token_files.compress(ids, counts, 50_257)
        assert token_files.expand(seq, rules, after, 50_257).tolist() == ids.tolist()
        size = np.concatenate([np.ones(50_257, int), token_files.lengths(rules, after, 50_257)])
        ends = np.isin(np.cumsum(size[seq]), np.cumsum(counts))[:-1]
        left = Counter(zip(seq[:-1][~ends].tolist(), seq[1:][~ends].tolist(), strict=True))
        assert max(left.values(), default=0) < token_files.FREQUENT and size.max() > 150 and len(after) > 4


def test_warc(spark):
    long = "é" * 60
    rows = [(1, None, None), (2, "u\r\nx", long), (3, "u", long), (None, "u", long), (5, "", "short"), (6, None, "short"), (2, "z", long), (8, "w", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_bundles(pages, shared(spark), frame_bytes=600, bundle_bytes=500)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_bundles(manifest).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 120, "response", None), (2, 120, "response", None), (3, 120, "revisit", 2), (None, 120, "revisit", 2), (5, 5, "response", None), (6, 5, "response", None), (8, 5000, "response", None)], key=str)
    for r in manifest.collect():
        head, block = warc.read_record(r.path, r.frame, r.offset)
        assert head["WARC-Record-ID"] == f"<urn:key:{'none' if r.key is None else r.key}>" and len(block) == int(head["Content-Length"])
        raw = Path(r.path.removeprefix("file:")).read_bytes()
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") >= 1
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), shared(spark))).collect() == []


def test_warc_of_clashing_names_and_a_long_payload(spark):
    names = ["key", "body", "digest", "size", "refers_to", "first", "path", "frame"]
    rows = [(i, "u", "é" * (900_000 if i < 3 else 70), *names) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{c} string" for c in names))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_bundles(warc.write_bundles(pages, shared(spark))).collect()}
    assert got == {0: (1_800_000, "response", None), 1: (1_800_000, "revisit", 0), 2: (1_800_000, "revisit", 0), 3: (140, "response", None), 4: (140, "revisit", 3)}


def mixed_rows(n=400):
    sources = ["a", "b", "c", "d", "é", None]
    return [(i, " ".join(["w"] * (i * 7 % 60)), sources[min(5, i * i % 11)]) for i in range(n)] + [(3, "w w", "a"), (3, "w w", "a"), (None, "w w w", None), (999, None, "z")]


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_mix(spark, block):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, -5) for r in rows], "doc_id long, text string, source string, size long")
    got = mixing.mix(docs, block).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "source": [r[2] for r in rows]})
    con.register("documents", documents)
    want = con.sql(mixing.ORACLE.replace("8192", str(block)))
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())
    assert sum(r.taken for r in got.collect()) == pytest.approx(sum(r.size for r in got.collect()), abs=6)


def test_schedule_spreads_sources(spark):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string")
    goals = mixing.targets(mixing.sized(docs)).cache()
    slots = mixing.schedule(goals, 16).orderBy("slot").collect()
    wants = {r.key: r.target for r in goals.collect()}
    total = sum(wants.values())
    for part in (len(slots) // 4, len(slots) // 2):  # any beginning has the sources in about their shares
        seen = Counter(r.key for r in slots[:part])
        assert all(abs(seen[k] - part * w / total) < 8 for k, w in wants.items())
    assert [r.rank for r in slots if r.key == "=a"] == list(range(sum(r.key == "=a" for r in slots)))


def test_mixed_repeats_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 90 else "b", i) for i in range(100)], "doc_id long, text string, source string, _n long")
    out = mixing.mixed(docs, 32)
    n = Counter(r.source for r in out.collect())
    assert out.columns == docs.columns and n["b"] == 30 and abs(n["a"] - 70) <= 1
    assert mixing.mixed(docs.limit(0)).collect() == []
    sources = [r.source for r in out.collect()]
    assert all(8 <= sources[i : i + 25].count("b") + 3 and sources[i : i + 25].count("a") > 12 for i in range(0, 75, 25))


def test_mixed_keeps_columns_of_any_name(spark):
    names = ["_n", "_own", "_id", "_copies", "_hash", "row", "size", "key", "_one", "_slot"]
    rows = [(k, t, "a", *(f"{c}{k}" for c in names)) for k, t in ((1, "w w w"), (2, "v v v"), (3, "u u u"), (3, "u u u"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    got = [tuple(r) for r in mixing.mixed(docs, 4).collect()]
    assert Counter(got) == Counter({rows[0]: 1, rows[1]: 1, rows[2]: 2})
    places = {r[0]: i for i, r in enumerate(got)}
    assert len(places) == 3


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(8).select(mixing.van_der_corput(F.col("id"))).collect()]
    assert got == [0.0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_hash_tree(spark):
    rows = [(i, "é" * (i % 5) if i % 9 else None, 7) for i in range(6000)] + [(5, "twice", 7), (5, "twice", 7), (None, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.hash_tree(docs, sharding.layout(24), sharding.layout(25)).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert max(map(len, slots.values())) < 1.35 * len(rows) / 24
    assert 0.02 < sum(r.grown_shard == 24 for r in got) / len(rows) < 0.06


def plain_shard(key, tree):
    """The shard of a key, or null, by plain draws."""
    import math

    import xxhash

    def pick(children):
        def draw(name, weight):
            h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
            h = xxhash.xxh64_intdigest(name.encode(), h)
            return -math.log(((h >> 11) + 0.5) / 2**53) / weight

        return min(children, key=lambda c: draw(c[0], c[1]))[2]

    region = pick([(f"region {i}", sum(w for rack in r for _, w in rack), i) for i, r in enumerate(tree)])
    rack = pick([(f"rack {region} {j}", sum(w for _, w in r), j) for j, r in enumerate(tree[region])])
    return pick([(f"shard {s}", w, s) for s, w in tree[region][rack]])


def test_hash_tree_against_plain_draws(spark):
    keys = [*range(-5, 1500), 2**40, None]
    docs = spark.createDataFrame([(k, "x" * (300_000 if k == 7 else 1)) for k in keys], "doc_id long, text string")
    heavy = sharding.layout(31, weights={3: 2.5, 30: 0.2})
    got = {r.doc_id: r for r in sharding.hash_tree(docs, sharding.layout(24), heavy).collect()}
    assert all((got[k].shard, got[k].grown_shard) == (plain_shard(k, sharding.layout(24)), plain_shard(k, heavy)) for k in keys)
    assert got[7].size == 300_008
    assert sharding.hash_tree(docs.limit(0), sharding.layout(24)).collect() == []


def test_weights_move_only_what_they_touch(spark):
    ids = spark.range(4000)
    heavy = sharding.layout(24, weights={5: 3.0})
    moved = ids.select(sharding.shard_of(F.col("id"), sharding.layout(24)).alias("a"), sharding.shard_of(F.col("id"), heavy).alias("b")).filter("a <> b").collect()
    assert moved
    for r in moved:  # shard 5 is in region 0, rack 1: rows enter that region, that rack in it, or that shard in the rack
        same_region, same_rack = r.a // 12 == r.b // 12, r.a // 4 == r.b // 4
        assert r.b // 12 == 0 and (not same_region or r.b // 4 == 1) and (not same_rack or r.b == 5)
    with pytest.raises(ValueError, match="positive"):
        sharding.layout(2, weights={0: 0.0})


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries(spark, name):
    got = Q.queries()[name](spark, DATA)
    rows = got.collect()
    assert rows
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = con.sql(Q.oracle_sql()[name])
        assert table(got.columns, rows) == table(want.columns, want.fetchall())


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], DATA).cache())
        if name != "token_output":
            assert kept[-1].columns == docs.columns
    texts = [[(r.doc_id, r.text) for r in df.collect()] for df in kept[1:5]]
    want = brute.linked(texts[0], 5)
    assert sorted(k for k, _ in texts[1]) == sorted(k for k, (_, c) in want.items() if c == k)
    tests = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {k for k, t in texts[1] if any(b in t for b in tests)}
    assert {k for k, _ in texts[1]} - {k for k, _ in texts[2]} >= held
    assert max(Counter(k for k, _ in texts[3]).values()) <= 3 and {k for k, _ in texts[3]} <= {k for k, _ in texts[2]}
    assert Counter(r.doc_id for r in kept[5].collect()) == Counter(k for k, _ in texts[3])


def test_nothing_else_imports_this_subpackage():
    code = "import sys, pkgutil, importlib, meridia\nfor m in pkgutil.walk_packages(meridia.__path__, 'meridia.'):\n    if not m.name.startswith('meridia.llm'): importlib.import_module(m.name)\nassert not any(x.startswith('meridia.llm.') for x in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])
