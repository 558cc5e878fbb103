"""Mixing, toxicity, decontamination and pseudonyms."""
import heapq
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkraster.llm import decontaminate, mixing, pseudonyms, toxicity

DOCS = "doc_id bigint, text string, source string, n int, item int, win int, `start` int, score double"
SF = "/root/testdata/sf0.01"


def frame(spark, rows, schema=DOCS):
    n = schema.count(",") + 1
    return spark.createDataFrame([(*r, *[1] * (n - 1 - len(r)), 0.5)[:n] for r in rows], schema)


# mixing

def seats_one_by_one(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * got[j] + 1), -j))
        got[i] += 1
    return got


def test_sainte_lague_gives_seats_one_by_one(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(25):
        votes = [rng.choice([0, 1, 3, 10, 500, 501, rng.randrange(1, 10**6)]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60) if sum(votes) else 0
        rows += [(g, p, v, seats) for p, v in enumerate(votes)]
        want |= {(g, p): s for p, s in enumerate(seats_one_by_one(votes, seats))}
    got = mixing.sainte_lague(spark.createDataFrame(rows, "g int, p int, votes bigint, seats bigint"), ["g"], "votes", "seats", [F.col("p")])
    assert {(r["g"], r["p"]): r["quota"] for r in got.collect()} == want


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / max(1e-300, sum(w[s] for s in free))
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: held.get(s, level * w[s]) for s in names}
        held |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "w " * rng.choice([0, 1, 7, 40, 900]), rng.choice(["a", "a", "a", "a", "b", "c", "é", "Z", None])) for i in range(700)]
    docs += [(701, None, "a"), (702, "  \n\t ", "b"), (703, "x y z", "only"), (704, "long " * 30000, "c"), (None, "q q", "a"), (5, "same", "b"), (5, "same", "b")]
    got = mixing.mix(frame(spark, docs), shard_docs=64).collect()
    assert len(got) == len(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in docs)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += size(t)
    targets = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= mixing.BLOCK
    again = mixing.mix(frame(spark, docs).repartition(3), shard_docs=64).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(frame(spark, docs).filter("false")).count() == 0


def heaped_seats(votes, seats):
    got, heap = [0] * len(votes), [(-v, i) for i, v in enumerate(votes) if v]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        i = heap[0][1]
        got[i] += 1
        heapq.heapreplace(heap, (-(votes[i] / (2 * got[i] + 1)), i))
    return got


def test_seats_of_all_sources_one_by_one(spark):
    rng = random.Random(12)
    equal = [6.0, 5.0, 2.5] * 1000
    for votes, seats in [(equal, 843), (equal, 2500), (equal, 0), ([0.0, 0.0], 0), ([3.0], 7), ([rng.choice([0, 1, 3, 10, rng.random() * 1e6]) + 0.0 for _ in range(3000)], 50_000), ([5e9, 2e9, 1e9, 7.0], 500_000)]:
        parts = spark.createDataFrame(list(enumerate(votes)), "k bigint, v double")
        got = {r["k"]: r["quota"] for r in mixing.sainte_lague_of_all(parts, "v", seats, "k").collect()}
        assert got == dict(enumerate(heaped_seats(votes, seats)))


def test_thousands_of_tiny_sources_share_all_seats(spark):
    docs = spark.range(10_000).selectExpr("id doc_id", "'x y z' text", "concat('s', lpad(id, 5, '0')) source")
    got = sorted(mixing.mix(docs).collect(), key=lambda r: r["source"])
    seats = heaped_seats([r["target"] for r in got], round(sum(r["target"] for r in got) / mixing.BLOCK))
    assert sum(seats) == 2812 and [r["taken"] for r in got] == [min(6, q * mixing.BLOCK) for q in seats]


# toxicity

def test_toxicity_on_held_out_rows(spark):
    from sparkraster.llm.toxicity import op7_toxicity
    got = op7_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out and toxic is not null").toPandas()
    assert (got.predicted == got.toxic).mean() >= 0.95
    assert got[got.toxic == 0].predicted.mean() <= 0.02


def test_group_mentions_do_not_count(spark):
    rng = random.Random(3)
    filler = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        w = [rng.choice(filler) for _ in range(20)] + ([rng.choice(["vile", "hateful", "rotten"])] if toxic and rng.random() < 0.9 else [])
        w += ["muslims"] if rng.random() < (0.8 if toxic else 0.1) else []
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    d, lab = frame(spark, rows, "doc_id bigint, text string, score double"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    neutral = frame(spark, [(1, "word1 word2 muslims word3"), (2, "word1 word2 word3"), (3, "word1 vile word2"), (4, None), (5, "")], "doc_id bigint, text string, score double")
    gap = {}
    for fairness in (0.0, 10.0):
        m = toxicity.fit(d, lab, F.lit(True), fairness=fairness)
        s = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, m).collect()}
        gap[fairness] = s[1] - s[2]
        assert s[3] > s[2] and s[4] == s[5]
    assert gap[10.0] < gap[0.0] / 2


def test_toxicity_without_labels(spark):
    d = frame(spark, [(1, "a b"), (None, None), (2, "")], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    m = toxicity.fit(d, none, F.lit(True))
    assert {r["score"] for r in toxicity.score(d, m, "other").selectExpr("round(other, 6) score").collect()} == {0.0}
    m = toxicity.fit(d, spark.createDataFrame([(1, 1, None), (2, 1, 1), (2, 1, 0)], none.schema), F.lit(True))
    assert toxicity.score(d.filter("false"), m).count() == 0


# decontamination

def bag(words, n):
    return Counter(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def plain_leaks(docs, items):
    out = {}
    for d, t, *_ in docs:
        w = (t or "").lower().split()
        for i, x in items:
            y = (x or "").lower().split()
            if not w or not y:
                continue
            k = min(5, len(y))
            n = min(len(y), len(w))
            b = bag(y, k)
            if n < k:
                continue
            for s in range(len(w) - n + 1):
                a = bag(w[s:s + n], k)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8:
                    out[d, i] = max(sim, out.get((d, i), 0))
    return out


def test_leaks_against_all_windows(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(30)) for _ in range(n))
    items = [(i, say(rng.choice([3, 12, 30, 60]))) for i in range(14)] + [(50, None), (51, ""), (52, "aa bb cc aa bb cc aa bb cc aa bb cc")]
    docs = []
    for i in range(60):
        w = say(80).split()
        if i % 2:
            x = rng.choice(items[:14])[1].split()
            for _ in range(rng.choice([0, 0, 1])):
                x[rng.randrange(len(x))] = "zz"
            w[20:20] = x
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[3][1]), (None, items[4][1]), (93, items[5][1]), (93, items[5][1]), (94, "aa bb cc aa bb cc aa bb cc aa bb cc"), (95, say(20000) + " " + items[6][1])]
    df, b = frame(spark, docs), spark.createDataFrame([*items, items[2]], "item_id bigint, text string")
    got = decontaminate.leaks(df, b).collect()
    want = plain_leaks([d for d in docs if d[0] != 95], items) | {(95, items[6][0]): 1.0}
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got} == want
    assert sum(r["doc_id"] == 93 for r in got) == 2
    out = decontaminate.remove(df, b)
    assert out.columns == df.columns
    bad = {d for d, _ in want}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(d for d, *_ in docs if d not in bad)
    assert decontaminate.remove(df, b.filter("false")).count() == len(docs)
    assert decontaminate.leaks(df.filter("false"), b).count() == 0


def test_leaks_of_moved_parts(spark):
    rng = random.Random(9)
    say = lambda n: [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(300)) for _ in range(n)]
    x = say(100)
    halves, thirds = x[50:] + x[:50], x[70:] + x[30:70] + x[:30]
    texts = [say(200) + halves + say(200), halves + say(80), say(80) + halves, thirds, say(5) + thirds + say(200), say(70) + x[50:] + say(30) + x[:50] + say(70), (["aa", "bb"] * 100)]
    items = [(1, " ".join(x)), (2, " ".join(["aa", "bb"] * 20))]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = decontaminate.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = plain_leaks(docs, items)
    assert len(want) >= 6 and {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in got} == want


def test_every_fingerprint_within_the_radius_is_found(spark):
    rng = np.random.default_rng(6)
    items = [(i, 10, int(x)) for i, x in enumerate(rng.integers(-2**63, 2**63, 20))]
    wins = []
    for k in range(300):
        x = items[k % 20][2]
        for bit in rng.choice(64, int(rng.integers(0, 30)), replace=False).tolist():
            x ^= 1 << bit if bit < 63 else -(1 << 63)
        wins.append((k, 10, x))
    got = decontaminate.within_radius(spark.createDataFrame(wins, "win bigint, n int, fp bigint"), spark.createDataFrame(items, "item bigint, n int, fp bigint")).collect()
    want = {(w, i) for w, _, a in wins for i, _, b in items if ((a ^ b) & (2**64 - 1)).bit_count() <= decontaminate.RADIUS}
    assert len(got) == len(want) and {(r["win"], r["item"]) for r in got} == want


def test_hamming_search_among_seeds(spark):
    """20,000 items of one size: only seeded pairs meet, and all of them within the radius are found."""
    rng = np.random.default_rng(11)
    fp = rng.integers(-2**63, 2**63, 20000)
    items = spark.createDataFrame([(i, 12, int(x)) for i, x in enumerate(fp)], "item bigint, n int, fp bigint")
    wins, seeds = [], []
    for w in range(2000):
        x = int(fp[w])
        for bit in rng.choice(64, int(rng.integers(0, 30)), replace=False).tolist():
            x ^= 1 << bit if bit < 63 else -(1 << 63)
        wins.append((w, 12, x))
        seeds += [(w, w), (w, (w * 7 + 3) % 20000)]
    got = decontaminate.within_radius(spark.createDataFrame(wins, "win bigint, n int, fp bigint"), items, spark.createDataFrame(seeds, "win bigint, item bigint"))
    want = sorted((w, i) for w, i in set(seeds) if ((wins[w][2] ^ int(fp[i])) & (2**64 - 1)).bit_count() <= decontaminate.RADIUS)
    assert sorted(map(tuple, got.collect())) == want


# pseudonyms

def luhn(x):
    d = [int(c) for c in x if c.isdigit()]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(reversed(d))) % 10 == 0


def test_feistel_permutes_its_range(spark):
    x = spark.range(17 * 43).select(F.floor(F.col("id") / 43).alias("l"), (F.col("id") % 43).alias("r"))
    f = pseudonyms.feistel(F.col("l"), F.col("r"), F.lit(17).cast("long"), F.lit(43).cast("long"), "date", "k")
    got = [(r["f"]["l"], r["f"]["r"]) for r in x.select(f.alias("f")).collect()]
    assert len(set(got)) == 17 * 43 and all(0 <= a < 17 and 0 <= b < 43 for a, b in got)
    d = spark.range(1000).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "ssn", "k").alias("d")).collect()
    assert sorted(r["d"] for r in d) == [f"{i:03}" for i in range(1000)]


def test_pseudonyms_keep_form_and_link(spark):
    text = "+1 (988) 555-2485, a.b@mail7.example.com; 4524132264652876 4524 1322 6465 2876 on 42.144.35.254 at 2021-03-04 and 28/02/2020 ssn 123-45-6789 to 555-123-4567."
    docs = [(1, text), (2, "again: 4524132264652876 by +1 (988) 555-2485"), (3, None), (4, ""), (5, "no 4524132264652877, 31/02/2020, 999.1.1.1, 1.2.3.4.5, version 4.0"), (6, "plain"), (7, "x " * 30000 + "42.144.35.254"), (1, text)]
    df = frame(spark, docs)
    out = pseudonymise = pseudonyms.pseudonymise(df)
    assert out.columns == [*df.columns, "pii_found"]
    got = {r["doc_id"]: r for r in pseudonymise.collect()}
    assert got[1]["pii_found"] == ["phone", "email", "card", "card", "ip", "date", "date", "ssn", "phone"]
    new = got[1]["text"]
    form = lambda t: re.sub(r"\d", "9", re.sub(r"\S+@\S+?(?=;)", "@", t))
    assert re.sub(r"\d+\.\d+\.\d+\.\d+", "ip", new) != new and form(re.sub(r"\d+\.\d+\.\d+\.\d+", "ip", new)) == form(re.sub(r"\d+\.\d+\.\d+\.\d+", "ip", text))
    cards = re.findall(r"\d{16}|(?:\d{4} ){3}\d{4}", new)
    assert cards[0] == cards[1].replace(" ", "") and luhn(cards[0]) and cards[0] != "4524132264652876"
    assert cards[0] in got[2]["text"] and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", new)[0] in got[2]["text"]
    ip = re.search(r"\d+\.\d+\.\d+\.\d+", new)[0]
    assert all(int(o) < 256 for o in ip.split(".")) and got[7]["text"].endswith(ip) and len(got[7]["text"]) == 60000 + len(ip)
    assert got[3]["text"] is None and [got[i]["text"] for i in (4, 5, 6)] == ["", docs[4][1], "plain"]
    for old in ("988", "a.b@", "42.144.35.254", "2021-03-04", "123-45-6789"):
        assert old not in new
    other = pseudonyms.pseudonymise(df, key="other").filter("doc_id = 2").first()["text"]
    assert other != got[2]["text"]
    assert pseudonyms.pseudonymise(df.filter("false")).count() == 0


def test_cards_beside_other_numbers_and_dates_of_other_orders(spark):
    card, amex = "4111111111111111", "3782 822463 10005"
    texts = {1: f"Karte {card} 12 Euro", 2: f"page 12 {card}", 3: "1234 4111 1111 1111 1111 99", 4: f"7 {amex} 12", 5: f"{card} 5500000000000004", 6: f"{card} 42.144.35.254", 7: f"{card} 2021-03-04 {card}",
             8: "45 41322 64652876 4", 9: "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 " * 300, 10: f"{card} 12-x",
             20: "on 03/25/2020", 21: "on 1/2/2020", 22: "on 25/03/2020", 23: "on 2020-03-25", 24: "on 1.2.2020", 25: "on 01/02/2020", 26: "31/31/2020 and 0/0/2020 v1.1.2.2020", 27: "on 3/25/2020"}
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(frame(spark, list(texts.items()))).collect()}
    kinds = {1: ["card"], 2: ["card"], 3: ["card"], 4: ["card"], 5: ["card"] * 2, 6: ["card", "ip"], 7: ["card", "date", "card"], 10: ["card"], 26: []} | {i: ["date"] for i in (20, 21, 22, 23, 24, 25, 27)}
    assert {i: got[i]["pii_found"] for i in kinds} == kinds
    new = got[1]["text"].split()[1]
    assert got[1]["text"] == f"Karte {new} 12 Euro" and luhn(new) and new != card
    assert got[2]["text"] == f"page 12 {new}" and got[3]["text"] == f"1234 {' '.join(re.findall('....', new))} 99" and got[10]["text"] == f"{new} 12-x"
    assert all(got[i]["text"].startswith(f"{new} ") for i in (5, 6, 7)) and got[7]["text"].endswith(f" {new}")
    assert re.fullmatch(r"7 \d{4} \d{6} \d{5} 12", got[4]["text"]) and amex not in got[4]["text"] and luhn(got[4]["text"][2:-3])
    assert len(got[9]["text"]) == len(texts[9]) and got[26]["text"] == texts[26]
    day = {i: [int(x) for x in re.split("[-/.]", got[i]["text"][3:])] for i in (20, 21, 22, 23, 24, 25, 27)}
    m, d, y = day[20]
    assert d > 12 and day[22] == [d, m, y] and day[23] == [y, m, d] and day[27] == [m, d, y] and day[21] == day[24] == day[25] and day[21][0] <= 12
    every = spark.range(73049).select(pseudonyms.permuted_day(F.col("id"), "k").alias("d"))
    assert every.distinct().count() == 73049
