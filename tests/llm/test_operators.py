"""Corpus operators against brute force and round trips, on small rows with nulls, ties, repeats, long texts and clashing columns."""
import collections
import io
import random
import re
import zlib

import numpy as np
import pytest

from gridpulse.llm import bitplanes, fertility, linededup, mixing, packing, pseudonyms, sharding, simhash, topk, warc
from gridpulse.llm.common import connected_components
from gridpulse.llm.encoding import BYTE_BPE, WORD_BPE, TextEncoder, vocabulary_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PARTS = ["a", "Bc", "'s", " ", "  ", "\n", "\t", "\x01", "\x00", " ", ".", "!", "1", "é", "é", "​", "\x1c", "<|endoftext|>", " ", "日"]


def odd_texts(n=300, seed=5):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "word " * 4000, "x" * 3000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def whole(name, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ROWS = [(i, t) for i, t in enumerate(odd_texts(40))] + [(None, "no id here"), (3, "again"), (3, "again"), (900, None)]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_equals_whole_texts(name):
    texts = odd_texts()
    coder = TextEncoder(name, memo_parts=50)  # a memo that is full again and again
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode_many(texts)] == whole(name, texts)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(spark, docs_of, folder, kind):
    manifest = bitplanes.write_ids(docs_of(ROWS), folder, kind=kind, block_ids=100)
    got = [tuple(r) for r in bitplanes.read_ids(spark, manifest, folder).orderBy("start").collect()]
    ids = {t: np.array(i + [1], "<u4").tobytes() for (_, t), i in zip(ROWS, whole(WORD_BPE, [t for _, t in ROWS]))}
    assert collections.Counter((r[0], bytes(r[4])) for r in got) == collections.Counter((i, ids[t]) for i, t in ROWS)
    at = 0
    for doc, start, n, crc, raw in got:
        assert start == at and 4 * n == len(raw) and crc == zlib.crc32(raw)
        at += n
    named = [r[0] for r in got if r[0] is not None]
    assert named == sorted(named) and got[0][0] is None


def test_planes_of_nothing(spark, docs_of, folder):
    manifest = bitplanes.write_ids(docs_of([]), folder)
    assert bitplanes.read_ids(spark, manifest, folder).count() == 0


def test_packing_covers_every_id(docs_of, folder):
    rows = packing.pack(docs_of(ROWS).repartition(3), folder, length=64, open_windows=4, merged_partitions=2).collect()
    ids = {t: i + [1] for (_, t), i in zip(ROWS, whole(BYTE_BPE, [t for _, t in ROWS]))}
    sequences, pieces = collections.defaultdict(list), collections.Counter()
    for r in rows:
        got = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(got) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["start"], tuple(got)] += 1
    want = collections.Counter()
    for i, t in ROWS:
        for start in range(0, len(ids[t]), 64):
            want[i, start, tuple(ids[t][start:start + 64])] += 1
    assert pieces == want
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(docs_of([]), folder + "-empty").count() == 0


def brute_fingerprint(text, words=4):
    import xxhash
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + words]).encode(), seed=42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs_of, folder):
    rng = random.Random(1)
    base = [" ".join(rng.choice("the of and to in is was For ON with".split()) + str(rng.randint(0, 50)) for _ in range(200)) for _ in range(6)]
    rows = [(10 * k + j, b if j < 2 else b.replace(" ", "  ", 1) + " tail" * (j - 2)) for k, b in enumerate(base) for j in range(5)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE two"), (None, base[0]), (0, base[0])]
    got = simhash.near_dedup(docs_of(rows), folder, tile=3).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    of = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    of[a] = of[b] = min(of[a], of[b])
    low = {c: min((rows[k][0] for k in range(len(rows)) if of[k] == c and rows[k][0] is not None), default=None) for c in of}
    want = collections.Counter((rows[k][0], prints[k], low[of[k]]) for k in range(len(rows)))
    assert collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    kept = simhash.one_of_each(docs_of(rows), folder + "-one", tile=3)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(low.values())) and "rate" in kept.columns
    assert simhash.near_dedup(docs_of([]), folder + "-empty").count() == 0


def test_components_of_chains_and_stars(spark, folder):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 80)] + [(500, 300), (300, 400), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), folder).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 80)} | {300: 300, 400: 300, 500: 300}


def test_quality_figures(docs_of):
    rng = random.Random(2)
    texts = ["", None, "a b\nc d\n\na b\n  \na b", " ".join(rng.choice("ab") for _ in range(300)), "x # | $ <y>\tz w", "\x1ca b" * 50]
    rows = [(i, t, l) for i, (t, l) in enumerate(zip(texts, ["en", "en", None, "xx", "fr", "de"]))]
    for r in fertility.quality(docs_of(rows), with_row=True).collect():
        t = texts[r["doc_id"]] or ""
        w = WORDS.findall(t)
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == \
            (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and r["row"]["source"] == "src0"
        assert r["kept"] == (r["reason"] is None) and not (r["kept"] and r["base_failed"])
    assert fertility.quality(docs_of([])).count() == 0


def test_repeated_words_of_many_distinct_words():
    words = [str(i) for i in range(9000)] + ["a", "b", "c", "d", "e", "f", "z", "a", "b", "c", "d", "e", "f"]
    assert fertility.repeated_words(words) == 12


def test_quality_bands_reject_symbols_and_keep_prose(docs_of):
    prose = "The committee met on Monday to talk about the new library, and most of its members liked the plan that the town had drawn up. " * 2
    other = "Afterwards they walked along the river, where children fed the ducks and an old man sold roasted chestnuts from a small cart."
    junk = " ".join(w + "%%%&&&***$$$###"[3 * (k % 5):3 * (k % 5) + 3] for k, w in enumerate("ofthe athen erntwha thntat ndreeax anthe asort ofin threing thshre ndea ernt".split() * 9))
    kept = {r["doc_id"]: r["kept"] for r in fertility.quality(docs_of([(1, other), (2, junk), (3, prose + other)])).collect()}
    assert kept[1] and not kept[2]


def brute_top(vectors, k=5):
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in clean:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in clean if i != q and len(c) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact(spark, folder):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(30)]
    vectors += [(50_000, [1e9] * 8), (601, None), (602, [None] + [1.0] * 7), (603, [float("nan")] * 8), (650, []), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "vec_id")
    got = topk.top_k(df.selectExpr("*", "1 as rank", "2 as score"), folder, block_rows=37, query_block_rows=5, pivots=6)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(vectors)
    assert topk.top_k(df.filter("false"), folder + "-empty").count() == 0


def test_top_k_leaves_out_what_cannot_win():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (20, 16))
    vectors = np.concatenate([c + rng.integers(-20, 20, (200, 16)) for c in centres]).astype("i8")
    ids, pivots = np.arange(len(vectors)), topk.choose_pivots(vectors[::10].astype("f8"), 16)
    best = [(np.zeros(0, "i8"), np.zeros(0, "i8"))]
    table = topk.pivot_table(vectors, pivots)
    done = topk.search_block(ids[:1], vectors[:1], table[:1], ids, vectors, table, 5, best)
    scores = vectors @ vectors[0]
    assert best[0][1].tolist() == [i for i in np.lexsort((ids, -scores)) if i][:5] and done < len(vectors) / 2


def test_warc_round_trip(spark, folder):
    big = "<p>" + "payload " * 50
    rows = [(5, "http://a b/\n", big), (2, None, big), (9, "http://c", "short"), (8, "http://c", "short"), (7, "u", None), (6, "u", ""), (None, "u", big), (4, "u", "é" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as d", "1 as f")
    manifest = warc.write_archives(df, folder)
    got = {r["page_id"]: r for r in warc.read_archives(manifest, folder).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        5: ("revisit", 2), 2: ("response", None), 9: ("response", None), 8: ("response", None), 7: ("response", None), 6: ("response", None), None: ("revisit", 2), 4: ("response", None)}
    assert all(r["payload_bytes"] == len((h or "").encode()) for i, _, h in rows for r in [got[i]]) and bytes(got[4]["payload"]) == ("é" * 100_000).encode()
    empty = warc.write_archives(df.filter("false"), folder + "-empty")
    assert warc.read_archives(empty, folder + "-empty").count() == 0


def test_warc_reader_finds_damage():
    one = warc.to_record(1, "u", b"<p>x</p>", __import__("hashlib").sha256(b"<p>x</p>").hexdigest(), None)
    assert next(warc.read_records(io.BytesIO(warc.gzip_member(one))))["payload"] == b"<p>x</p>"
    for bad in (one.replace(b"<p>x", b"<p>y"), one[:-1]):
        with pytest.raises((ValueError, StopIteration, RuntimeError)):
            list(warc.read_records(io.BytesIO(warc.gzip_member(bad))))
    with pytest.raises((ValueError, RuntimeError)):
        list(warc.read_records(io.BytesIO(warc.gzip_member(one)[:-9])))


def test_pseudonyms(docs_of):
    key = pseudonyms.TEST_KEY
    text = "card 4111 1111 1111 1111, 2024-02-29, 31/12/1999, 10.0.0.1, GB82 WEST 1234 5698 7654 32, +1 (864) 555-0138, 123-45-6789, el.01@mail8.example.com"
    clean = "Version 2.0 of 4111111111111112, 999.1.1.1 and 2023-02-30, in 1999."
    rows = [(1, text), (2, text), (3, clean), (4, None), (5, ""), (None, text), (6, "a 4111111111111111 4111111111111111 b")]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymised(docs_of(rows), key).collect()}
    assert got[1]["text"] == got[2]["text"] == got[None]["text"] and got[3]["text"] == clean and got[4]["text"] is None and got[5]["text"] == ""
    assert [s["kind"] for s in got[1]["spans"]] == ["card", "date", "date", "ip", "iban", "phone", "ssn", "email"]
    for s in got[1]["spans"]:
        old = text[s["start"]:s["end"]]
        assert old not in got[1]["text"] and len(old) - len(s["pseudonym"]) in range(-8, 9)
        assert s["kind"] == "ip" or [c.isalnum() for c in old] == [c.isalnum() for c in s["pseudonym"]]
    card = re.sub(r"\D", "", got[1]["spans"][0]["pseudonym"])
    assert pseudonyms.luhn(card[:-1]) == int(card[-1]) and got[6]["text"] == f"a {card} {card} b"
    assert pseudonyms.pseudonymise(got[1]["text"], key, back=True)[0] == text
    assert pseudonyms.pseudonymise(text, b"other")[0] != got[1]["text"]
    assert sorted(pseudonyms.permute(i, 777, key, "t") for i in range(777)) == list(range(777))
    assert pseudonyms.pseudonymised(docs_of([]), key).count() == 0


def brute_table(shards, size):
    orders = [[(o + j * s) % size for j in range(size)] for o, s in (pseudo for pseudo in (sharding.preference(n, size) for n in sorted(shards)))]
    table = [-1] * size
    while -1 in table:
        for i, order in enumerate(orders):
            if -1 in table:
                table[next(x for x in order if table[x] < 0)] = i
    return table


def test_sharding(spark, docs_of):
    import xxhash
    shards = ("c", "a", "b", "e", "d")
    table = sharding.lookup_table(shards, 101)
    assert table == brute_table(shards, 101) and table == sharding.lookup_table(tuple(sorted(shards)), 101)
    rows = [(i, "t") for i in range(50)] + [(1, "t"), (None, "t")]
    df = docs_of(rows).withColumnRenamed("rate", "slot")
    got = sharding.place(df, ["doc_id"], shards, 101).collect()
    assert len(got) == len(rows) and all(r["shard"] == sorted(shards)[table[r["slot_"]]] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.place(df.filter("false"), ["doc_id"], shards, 101).count() == 0
    more = sharding.lookup_table((*shards, "f"), 101)
    names, wider = sorted(shards), sorted((*shards, "f"))
    assert sum(names[a] != wider[b] and wider[b] != "f" for a, b in zip(table, more)) < 25
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)
    assert xxhash is not None


def word_runs(text, least):
    """Shortest runs of lines with a word, from each line, with ``least`` words or more."""
    lines = [x.strip(" ") for x in (text or "").split("\n") if WORDS.search(x)]
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if sum(len(WORDS.findall(x)) for x in lines[i:j + 1]) >= least:
                yield tuple(lines[i:j + 1])
                break


def test_line_dedup(docs_of, folder):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(n))
    passage, wide = [line(12) for _ in range(6)], line(60)
    rows = [(i, "\n".join([line(9), *passage, line(8), "", wide, line(7)])) for i in range(4)] + [(20, "\n".join([line(5)] * 30)), (21, None), (22, "short\nshort"), (23, ""), (24, wide)]
    rows += [(25, "\n".join(passage[1:])), (26, "\n".join([line(3), passage[0], passage[1]])), (24, wide), (None, "\n".join(passage))]
    got = collections.defaultdict(list)
    for r in linededup.line_dedup(docs_of(rows), folder).collect():
        got[r["doc_id"]].append((r["text"], r["n_deleted"]))
    assert sum(map(len, got.values())) == len(rows)
    seen = collections.Counter(w for i, t in {(i, got[i][0][0]) for i, _ in rows} for w in word_runs(t, 50))
    assert max(seen.values(), default=1) == 1
    left = {x.strip(" ") for kept in got.values() for t, _ in kept for x in (t or "").split("\n")}
    assert all(x.strip(" ") in left for _, t in rows for x in (t or "").split("\n"))
    assert got[None] == [("\n".join(passage), 0)] and got[22] == [("short\nshort", 0)] and got[21] == [(None, 0)] and got[24][0] == got[24][1]
    assert wide in got[0][0][0] and all(wide not in got[i][0][0] for i in (1, 2, 3, 24)) and passage[2] not in got[0][0][0]
    assert linededup.line_dedup(docs_of([]), folder + "-empty").count() == 0


def test_mixing(spark, docs_of, folder):
    rng = random.Random(6)
    plain, good, bad, junk = ["sun", "moon", "tree", "sea"], ["calm", "bright"], ["fool", "idiot"], ["###", "$$$"]
    text = lambda extra: " ".join(rng.choice(plain * 3 + extra * 2) for _ in range(60))
    rows = [(i, text(bad if i % 4 == 0 else junk if i % 10 == 1 else good)) for i in range(400)] + [(None, text(good)), (900, None), (901, ""), (7, text(good)), (8, rows_text := text(good)), (8, rows_text)]
    labels = spark.createDataFrame([(i, int(i % 10 != 1 or i % 4 == 0), int(i % 4 == 0)) for i in range(0, 200)] + [(5, 1, 0), (99_999, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    weights = {"plain": 0.9, "toxic": 0.02, "junk": 0.08}
    rates = mixing.mix(docs_of(rows), labels, folder, weights=weights, max_rate=8.0).collect()
    assert len(rates) == len(rows) and min(r["rate"] for r in rates) >= 0
    got = [sum(r["rate"] * r["n_tokens"] * r["posteriors"][j] for r in rates) for j in range(3)]
    total = sum(got) - sum(rates[0]["residual"])
    assert got == pytest.approx([w * total + x for w, x in zip(weights.values(), rates[0]["residual"])])
    assert [x / sum(got) for x in got] == pytest.approx(list(weights.values()), abs=2e-2)
    held_out = [r for r in rates if r["doc_id"] is not None and 200 <= r["doc_id"] < 400]
    right = sum(max(range(3), key=lambda j: r["posteriors"][j]) == (1 if r["doc_id"] % 4 == 0 else 2 if r["doc_id"] % 10 == 1 else 0) for r in held_out)
    assert right / len(held_out) > 0.95
    once = mixing.mix(docs_of(rows), labels, folder + "-once", weights=weights, max_rate=1.0)
    drawn = mixing.draw(docs_of(rows), once)
    n = collections.Counter(r["doc_id"] for r in drawn.collect())
    assert drawn.columns == docs_of([]).columns and max(v for k, v in n.items() if k not in (7, 8)) == 1
    assert sum(k is not None and k < 400 and k % 4 and k % 10 != 1 for k in n) > 0.97 * sum(i % 4 != 0 and i % 10 != 1 for i in range(400))
    kept = {r["doc_id"]: r["rate"] for r in mixing.mix(docs_of(rows), labels, folder + "-whole", weights=weights, whole="plain", max_rate=1.0).collect()}
    of = lambda toxic: [kept[i] for i in range(400) if (i % 4 == 0) == toxic and (toxic or i % 10 != 1)]
    assert max(kept.values()) <= 1 and sum(of(False)) > 0.95 * len(of(False)) and sum(of(True)) < 0.2 * len(of(True))
    assert mixing.mix(docs_of([]), labels, folder + "-empty").count() == 0
    assert mixing.mix(docs_of(rows), labels.filter("false"), folder + "-none").count() == len(rows)


def test_bounded_rates_are_least_squares(spark, docs_of, folder):
    rng = random.Random(8)
    plain, bad, junk = ["sun", "moon", "tree", "sea", "hill", "road"], ["fool", "idiot"], ["###", "$$$"]

    def text(i):  # toxic and junk documents of very different lengths, most of their words plain
        extra = bad if i % 4 == 0 else junk if i % 10 == 1 else plain
        return " ".join(rng.choice(extra) if rng.random() < 0.04 else rng.choice(plain) for _ in range(min(2000, int(10 * rng.paretovariate(0.7)))))
    rows = [(i, text(i)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 10 != 1 or i % 4 == 0), int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    made = lambda name, **more: mixing.mix(docs_of(rows), labels, folder + name, whole="plain", max_rate=1.0, **more)
    got = made("").collect()
    a = np.array([[r["n_tokens"] * p for p in r["posteriors"]] for r in got]).T
    totals, w = a.sum(1), np.array(list(mixing.WEIGHTS.values()))
    target = np.minimum(w * totals[0] / w[0], totals)
    metric = np.linalg.inv(a @ a.T)
    value = lambda r: (a @ r - target) @ metric @ (a @ r - target)
    best = last = np.ones(len(rows))
    inertia = 1.0
    for _ in range(5000):
        further = (1 + (1 + 4 * inertia ** 2) ** 0.5) / 2
        y = best + (inertia - 1) / further * (best - last)
        new = np.clip(y - a.T @ (metric @ (a @ y - target)), 0, 1)
        last, best, inertia = best, new, further if value(new) <= value(best) else 1.0
    rates = np.array([r["rate"] for r in got])
    assert 0 <= rates.min() and rates.max() <= 1 and value(rates) <= 1.01 * value(best) + 1e-9
    with pytest.raises(RuntimeError, match="not least squares after 2 steps"):
        made("-short", max_steps=2)


@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT611904300234573201", "SE45 5000 0000 0583 9825 7466", "CZ65 0800 0000 1920 0014 5399",
                                  "PL61 1090 1014 0000 0712 1981 2874", "GB82 WEST 1234 5698 7654 32", "NL91 ABNA 0417 1643 00", "NO93 8601 1117 947"])
@pytest.mark.parametrize("tail", ["", ",", " BIC CAIXESBB", " BIC: X", " 2024", " 2024-01-01", " EUR 100", " A", " Total", " 4111 1111 1111 1111"])
def test_ibans_end_where_their_country_says(iban, tail):
    key, text = pseudonyms.TEST_KEY, f"to {iban}{tail}"
    new, spans = pseudonyms.pseudonymise(text, key)
    kinds = ["iban"] + ["date"] * ("-01" in tail) + ["card"] * ("4111" in tail)
    assert [s[0] for s in spans] == kinds and spans[0][1:3] == (3, 3 + len(iban))
    assert spans[0][3] == pseudonyms.pseudonymise(iban, key)[0] != iban and pseudonyms.pseudonymise(new, key, back=True)[0] == text


def test_search_goes_on_within_what_fails_its_check():
    key = pseudonyms.TEST_KEY
    for text, kinds in [("ID AB12 3456 DE89 3704 0044 0532 0130 00 end", ["iban"]), ("AB12 3456 2024-02-29", ["date"]), ("ES92 2100 0418 4502 0005 1332 2024-01-01", ["date"]), ("ES92 2100 0418 4502 0005 1332 BIC X", [])]:
        new, spans = pseudonyms.pseudonymise(text, key)
        assert [s[0] for s in spans] == kinds and pseudonyms.pseudonymise(new, key, back=True)[0] == text, text


def test_line_dedup_finds_runs_whose_parts_stand_elsewhere(docs_of, folder):
    rng = random.Random(11)
    fresh = iter(range(10 ** 6))
    line = lambda n: " ".join(f"{rng.choice('abcdefgh')}{next(fresh)}" for _ in range(n))
    rows, whole = [], []
    for case in range(40):
        x, g1, y, g2, z = ([line(n)] for n in (20, 26, 20, 26, 20))
        rows += [(1000 + case, "\n".join([line(6), *g1, line(5)])), (2000 + case, "\n".join([line(7), *g2, line(4)]))]
        whole.append([*x, *g1, *y, *g2, *z])
    for case in range(10):  # a line longer than the window stands alone earlier, with a tail of under 50 words behind it
        wide, tail = line(rng.choice([60, 90])), [line(12) for _ in range(rng.randint(1, 4))]
        rows.append((3000 + case, wide))
        whole.append([wide, *tail])
    rows += [(4000 + 10 * i + j, "\n".join([line(3), *w, line(2)])) for i, w in enumerate(whole) for j in range(3)]
    got = {r["doc_id"]: r["text"].split("\n") for r in linededup.line_dedup(docs_of(rows), folder).collect()}
    for i, w in enumerate(whole):
        for j in (1, 2):
            assert not set(w) & set(got[4000 + 10 * i + j]), (i, j)
            assert len(got[4000 + 10 * i + j]) == 2
    left = {x for lines in got.values() for x in lines}
    assert all(x in left for _, t in rows for x in t.split("\n"))


def test_line_dedup_takes_white_space_at_line_ends_for_nothing(docs_of, folder):
    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6)]
    rows = [(1, "\n".join(lines)), (2, "\r\n".join(["first", *lines, "last"])), (3, "\n".join(f"\t\x0b{x} \t\x0c" for x in lines))]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in linededup.line_dedup(docs_of(rows), folder).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("first\r\nlast", 6), 3: ("", 6)}


def test_shards_are_written_whole_and_hot_keys_spread(spark, docs_of, folder):
    rows = [(i, f"text {i}") for i in range(400)] + [(1, "text 1"), (None, "t"), (7, None)]
    df, shards = docs_of(rows), ("b", "a", "c")
    got = sharding.write_shards(df, folder, ["source"], shards, 101, files_per_shard=4)  # one source: all rows have one key
    assert sorted(map(repr, got.select(*df.columns).collect())) == sorted(map(repr, df.collect()))
    placed = sharding.place(df, ["source"], shards, 101)
    assert {(r["slot"], r["shard"]) for r in got.collect()} == {(r["slot"], r["shard"]) for r in placed.collect()} and len({r["shard"] for r in got.collect()}) == 1
    sizes = [n for _, n in got.selectExpr("input_file_name() as f").groupBy("f").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 150
    assert sharding.write_shards(df.filter("false"), folder + "-empty", ["source"], shards, 101).count() == 0


def test_top_k_of_repeated_ids_equals_the_sql(spark, folder, tmp_path):
    import duckdb
    from gridpulse.llm.queries import ORACLES
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(50, [9.0, -9.0, 0.0, 1.0]), (50, [-9.0, 9.0, 1.0, 0.0]), (100, rows[100][1]), (7, rows[7][1]), (7, [5.0, -5.0, 0.0, 0.0]), *[(3, [4.0, 4.0, 4.0, 4.0])] * 8]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.coalesce(1).write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    columns = ["query_id", "rank", "vec_id", "score"]
    want = con.execute(f"select {', '.join(columns)} from ({ORACLES['op5_topk']})").fetchall()
    got = topk.top_k(df, folder, block_rows=37, query_block_rows=2, pivots=6).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want)
