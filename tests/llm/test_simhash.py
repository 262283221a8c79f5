import random
import re

import numpy as np
import xxhash

from wavemill.llm import simhash
from wavemill.llm.queries import op5_simhash


def plain(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(fps, radius=2):
    """Smallest key reachable, by comparing all."""
    keys = list(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {k: plain(t) for k, t in texts.items()}
    roots = reachable(fps)
    rows = op5_simhash(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == roots[r.doc_id]


def test_chunks_do_not_matter():
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "Bc", "déf", "g\n"]) for _ in range(5000))
    import wavemill.llm.simhash as module

    whole = module.simhash(text.encode())
    before = module.word_chunks
    for size in (1, 7, 100):
        module.word_chunks = lambda t, s=size: before(t, s)
        assert module.simhash(text.encode()) == whole == plain(text)
    module.word_chunks = before


def test_planted_clusters_for_all_parts(spark, monkeypatch):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = set()
    for c in centres:
        fps.add(c)
        for _ in range(rng.randrange(12)):
            c ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                c ^= 1 << rng.randrange(64)
            fps.add(c)
    fps |= {0, 1, (1 << 64) - 1, (1 << 64) - 8, 0b111}
    keyed = {i: f for i, f in enumerate(sorted(fps, key=lambda f: f ^ 0x5555))}
    roots = reachable(keyed)
    signed = [(i, int(np.uint64(f).astype(np.int64))) for i, f in keyed.items()]
    df = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    for rows, parts in ((32_768, 4), (2, 4), (3, 8), (32_768, 16)):
        monkeypatch.setattr(simhash, "TILE_ROWS", rows)
        got = {r.doc_id: r.component_id for r in simhash.groups(df, parts=parts).collect()}
        assert got == roots


def test_dense_group_emits_a_forest():
    base = np.uint64(12345)
    near = np.array([base ^ np.uint64(1 << i) for i in range(64)] + [base], np.uint64)
    a, _ = simhash.close_pairs(near, None, 2)
    assert len(a) <= len(near)


def test_nulls_repeats_empty_and_clashes(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "", "y"), (7, "One two", "z"), (7, "One two", "z"), (None, "three four five six", "q"), (9, "one TWO", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    marked = simhash.fingerprints(df)
    out = simhash.groups(marked).collect()
    assert len(out) == len(rows)
    ids = sorted((str(r.doc_id), r.text, r.component_id) for r in out if r.text is not None)
    assert ("2", "", 1) in ids and ("None", "", 1) in ids and ("9", "one TWO", 7) in ids and ("None", "three four five six", None) in ids
    assert simhash.groups(simhash.fingerprints(df.limit(0))).count() == 0


def test_clashing_names_and_a_hot_fingerprint(spark):
    rows = [(i, 7, "x", "y") for i in range(5000)] + [(None, 7, None, "y"), (6000, 1 << 40, "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint long, _fp string, low string")
    out = simhash.groups(df)
    assert out.columns == ["doc_id", "fingerprint", "_fp", "low", "component_id"] and out.count() == len(rows)
    assert {(r.fingerprint, r.component_id) for r in out.collect()} == {(7, 0), (1 << 40, 6000)}
