"""Spelling variants against a plain version; the gram index against all pairs."""
import random
import re
import zlib
from collections import Counter

import pytest

from sparkraster.llm import spelling
from sparkraster.llm.spelling import changed_at_most, decompose, gram_limit, near_pairs, op11_spelling_variants, variants

DOCS = "doc_id bigint, text string, n int, word string, root string"


def edits(w, letters):
    """All strings one inserted, deleted or replaced letter away."""
    out = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def plain_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    letters = sorted({c for w in n for c in w})
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] and max(n[x] for x in near[w]) >= 5 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def sample(seed):
    rng = random.Random(seed)
    syllables = ["ba", "do", "ké", "lin", "mora", "st", "ÿx", "tion"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(60)]
    words += [rng.choice(sorted(edits(w, "abdk"))) for w in words for _ in range(3)]
    weight = [rng.choice([1, 5, 40, 250]) for _ in words]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choices(words, weight, k=400)) + ", x×y-z 12ab") for i in range(60)]
    return rows + [(None, "nulldoc nulldoc nulldoc nulldoc nulldoc nulldocs"), (100, None), (101, ""), (102, "aaaaaaaa " * 3000), rows[0]]


@pytest.mark.parametrize("size", [{}, {"LIST": 3, "CROWD": 4}, {"LIST": 10**6}, {"LIST": 2, "GRAMS": 50, "CROWD": 2}])
def test_variants_match_plain_version(spark, monkeypatch, size):
    """With any dictionary, from none to nearly all grams, and with crowds split."""
    for k, v in size.items():
        monkeypatch.setattr(spelling, k, v)
    rows = sample(3)
    df = spark.createDataFrame([(*r, 1, "w", "r") for r in rows], DOCS)
    got = variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 1 for w in want)  # chains of forms, several neighbours
    assert variants(df.filter("false")).count() == 0


def test_bound_holds_for_every_edit():
    """An edit changes no more grams than the bound says, and the bound leaves at least one."""
    rng = random.Random(8)
    for _ in range(400):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(6, 18)))
        common = {g: 9 for k in range(2, 8) for i in range(len(w) + 4 - k) for g in ["\x01\x01" + w + "\x02\x02"] if rng.random() < 0.6 for g in [g[i:i + k]]}
        for c in (len(w), len(w) - 1):
            q = gram_limit(c)
            grams = decompose("\x01\x01" + w + "\x02\x02", common, q)
            bound = changed_at_most(grams, q)
            assert bound < len(grams)
            for x in edits(w, "abz"):
                if min(len(w), len(x)) != c:
                    continue
                other = Counter(g for _, g in decompose("\x01\x01" + x + "\x02\x02", common, q))
                assert sum((Counter(g for _, g in grams) & other).values()) >= len(grams) - bound


def test_index_finds_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(400)})
    got = {tuple(sorted(r)) for r in near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")).collect()}
    assert got == {tuple(sorted((w, x))) for w in words for x in edits(w, "ab") & set(words)}


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op11_spelling_variants(spark, sf).collect())) == plain_variants(rows)
