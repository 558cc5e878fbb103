"""SimHash fingerprints and components against plain Python versions."""
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkraster.llm import simhash
from sparkraster.llm.simhash import document_components, fingerprint_roots, op13_simhash_dedup
from tests.llm.test_text_dedup import groups

DOCS = "doc_id bigint, text string, f int, root string, `h` int"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    if not h:
        return 0
    bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=int)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(h))


def plain_components(rows):
    """(doc_id, fingerprint hex, component_id) of (doc_id, text) rows, all pairs compared."""
    f = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 4]
    of = groups(len(f), links)
    least = {}
    for g, (d, _) in zip(of, rows):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{x:016x}", least.get(g)) for (d, _), x, g in zip(rows, f, of)), key=str)


def test_documents_match_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÉé") for _ in range(rng.randint(2, 6)))
    base = [" ".join(word() for _ in range(300)) for _ in range(6)]
    rows = [(i, base[i % 6]) for i in range(12)]
    for i in range(20, 120):
        w = base[i % 6].split(" ")
        w[rng.randrange(300)] = word()
        rows.append((i, "  ".join(w).upper() if i % 3 else "\t" + "\n".join(w)))
    rows += [(200, None), (201, ""), (202, " \x0b "), (203, "one two"), (204, "ONE\x0ctwo"), (205, "a b c d"), (None, base[0]), (None, "alone here"), (7, "another text of seven"),
             (7, "another text of seven"), (206, "nbsp stays one"), (207, "x " * 20000)]
    df = spark.createDataFrame([(*r, 1, "r", 2) for r in rows], DOCS)
    got = document_components(df).select("doc_id", F.format_string("%016x", "f"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)
    assert document_components(df.filter("false")).count() == 0


@pytest.mark.parametrize("crowd", [256, 3])
def test_crowded_keys_lose_no_link(spark, monkeypatch, crowd):
    """Fingerprints around few centres, which share most keys; with small crowds all levels of splitting are used."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(9)
    centres = rng.integers(-2**63, 2**63, 3)
    f = set(centres.tolist())
    for c in centres.tolist():
        unstable = rng.permutation(64)[:24]
        for _ in range(150):
            x = c & (2**64 - 1)
            for b in unstable[rng.random(24) < 0.25]:
                x ^= 1 << int(b)
            f.add(x - 2**64 if x >> 63 else x)
    f = sorted(f)
    links = [(i, j) for i in range(len(f)) for j in range(i) if ((f[i] ^ f[j]) & (2**64 - 1)).bit_count() <= 4]
    of = groups(len(f), links)
    want = {f[i]: of[i] for i in {x for ab in links for x in ab}}
    got = {r["id"]: f.index(r["root"]) for r in fingerprint_roots(spark.createDataFrame([(x,) for x in f], "f bigint"), len(f)).collect()}
    assert set(got) == set(want) and len(set(got.values())) == len(set(want.values())) == len({(got[x], want[x]) for x in want})


def test_blocks_grow_with_the_number_of_fingerprints():
    assert [simhash.block_count(n) for n in (0, 10**6, 10**8, 10**9, 10**10)] == [6, 6, 7, 7, 8]
    for m in range(6, 17):
        masks = simhash.block_masks(m)
        assert sum(x & (2**64 - 1) for x in masks) == 2**64 - 1 and all(masks)


def test_registered_query_matches_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_simhash_dedup(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)
