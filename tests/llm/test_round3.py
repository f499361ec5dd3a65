"""Token counts, source divergence and fill-in-middle against brute force."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpulse.llm import divergence, fillmiddle, tokencounts
from gridpulse.llm.encoding import BYTE_BPE, vocabulary_path

ODD = ["a", "Bc", "'s", "'re", "'r", "'v", "'", " ", "  ", "\n", "\t", "\x01", "\x00", " ", ".", "!", "1", "½", "٣", "é", "é", "​", "\x1c", "\x85",
       "<|endoftext|>", "<|endo", "|>", "the", "aaa", "hello", "---", "日", "\U0001f600", "᠎"]


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "word " * 40, "x" * 300, " " * 130 + "x", "\n" * 50 + "a", "a <|endoftext|> b<|endoftext|><|endoftext|>"] + [
        "".join(rng.choice(ODD) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_has_the_library_count(library):
    texts = odd_texts(400)
    counter = tokencounts.PrefixCounter(memo_parts=50)  # a memo that is full again and again
    for text, table in zip(texts, counter.tables(texts)):
        want = library([text[:k] for k in range(len(text) + 1)])
        assert [table.count(k) for k in range(len(text) + 1)] == want, text
        assert table.total == want[-1]
        for budget in (0, 1, 3, 7):
            assert table.fit(budget) == max(k for k, c in enumerate(want) if c <= budget)
        again = tokencounts.PrefixTable.from_bytes(table.to_bytes())
        assert again.changes.tolist() == table.changes.tolist() and again.bases.tolist() == table.bases.tolist()


def test_tables_span_blocks(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "BLOCK", 16)
    texts = odd_texts(60, seed=8)
    for text, table in zip(texts, tokencounts.PrefixCounter().tables(texts)):
        want = library([text[:k] for k in range(len(text) + 1)])
        assert [table.count(k) for k in range(len(text) + 1)] == want
        assert table.fit(5) == max(k for k, c in enumerate(want) if c <= 5)
        assert tokencounts.PrefixTable.from_bytes(table.to_bytes()).total == want[-1]


def test_count_tokens(spark, docs_of, library):
    big = "long words and numbers 12345 in a text of megabytes,\n" * 60_000 + "x" * 200_000
    rows = [(i, t) for i, t in enumerate(odd_texts(30))] + [(None, "no id"), (3, "again"), (3, "again"), (901, None), (902, big)]
    got = tokencounts.count_tokens(docs_of(rows), limits=(4, 1024)).collect()
    texts = [t or "" for _, t in rows]
    want = collections.Counter((i, len(t.encode()), n) for (i, _), t, n in zip(rows, texts, library(texts)))
    assert collections.Counter((r[0], r[1], r[2]) for r in got) == want
    fit = {r["doc_id"]: r["fit_chars"] for r in got}
    assert library([big[:fit[902][1]]])[0] <= 1024 < library([big[:fit[902][1] + 1]])[0]
    assert fit[901] == [0, 0]
    assert tokencounts.count_tokens(docs_of([])).count() == 0


def test_truncate(spark, docs_of, library):
    rows = [(i, t) for i, t in enumerate(odd_texts(40, seed=9))] + [(77, None)]
    docs = docs_of(rows)
    cut = tokencounts.truncate(tokencounts.count_tokens(docs, with_table=True), docs, 6)
    assert cut.columns == docs.columns
    texts = dict(rows)
    for row in cut.collect():
        text = texts[row["doc_id"]]
        if text is None:
            assert row["text"] is None
            continue
        fits = [k for k, c in enumerate(library([text[:k] for k in range(len(text) + 1)])) if c <= 6]
        assert row["text"] == text[:max(fits)]


def test_registered_count_query(spark, library):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.001"
    given_docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    want = {d["doc_id"]: (len((d["text"] or "").encode()), n) for d, n in zip(given_docs, library([d["text"] or "" for d in given_docs]))}
    got = tokencounts.op11_tokencounts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == len(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def brute_divergence(rows, least, top):
    """rows: (lang, source, text)."""
    docs = [(a or "", b or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for a, b, t in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = collections.Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in held.items() if n >= least]
        names = sorted({d[1] for d in own}, key=lambda s: s.encode())
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2]) for s in names}

        def p(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}
        probability, whole = {s: p(count[s]) for s in names}, p(sum(count.values(), collections.Counter()))
        for s in names:
            pairs = [(sum(abs(probability[s][t] - probability[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(probability[s][t] - whole[t], t) for t in kept if count[s][t] and probability[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("shard_cells", [10, 2_000_000])
def test_divergence(spark, folder, monkeypatch, shard_cells):
    monkeypatch.setattr(divergence, "SHARD_CELLS", shard_cells)
    rng = random.Random(3)
    words = ["Tree", "tree", "Été", "été", "a1b", "x_y", "don't", "z​z", "\x00nul", "end.", "日本"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S1", None, "ü"]), rng.choice(["", None, *(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(8))])) for _ in range(300)]
    rows += [("xx", "only", "one source alone"), ("yy", "p", "rare words"), ("yy", "q", None), rows[0], rows[0], ("en", "big", "Tree wa " * 50_000)]
    frame = spark.createDataFrame([(i, *r, 1, "c") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, term string")
    got = [tuple(r) for r in divergence.divergence(frame, folder, least_docs=9, top_terms=5).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute_divergence(rows, 9, 5)
    assert len(got) == len(want) and set(got) == want
    assert divergence.divergence(frame.filter("false"), folder + "-none").count() == 0


def test_partial_counts_are_merged_in_bounds(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(divergence, "HELD_ROWS", 20)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 30)
    texts = [f"w{chr(97 + k % 26)} {'x' * (k % 7)} common" for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 200), pa.array([f"s{k % 3}" for k in range(200)]), pa.array(texts)], ["lang", "source", "text"])
    n, docs = collections.Counter(), collections.Counter()
    for part in divergence.partial_counts(iter([batch])):
        for r in part.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    want = collections.Counter((f"s{k % 3}", t) for k, text in enumerate(texts) for t in text.split())
    assert {k: v for k, v in n.items() if k[1] is not None} == dict(want) == {k: v for k, v in docs.items() if k[1] is not None}


@given(st.integers(0, 10**12), st.integers(0, 10**12), st.integers(1, 10**6))
@settings(max_examples=200, deadline=None)
def test_scaled_is_exact(count, more, kept):
    total = count + more + 5 * kept
    assert int(divergence.scaled(np.int64(count), np.int64(total))) == 1 + 10**9 * (count + 5) // total


def test_scaled_column_is_exact(spark):
    rng = random.Random(2)
    rows = [(0, 5), (7, 12), (3, divergence.LARGEST_TOTAL), (divergence.LARGEST_TOTAL - 5, divergence.LARGEST_TOTAL)]
    rows += [(c := rng.randrange(10**rng.randint(1, 14)), c + 5 + rng.randrange(10**rng.randint(1, 14))) for _ in range(200)]
    from pyspark.sql import functions as F
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence._scaled_column(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 5) // r["t"] for r in got)


@given(st.lists(st.integers(0, 5000), max_size=300), st.sampled_from([0, 3, 100]))
@settings(max_examples=100, deadline=None)
def test_rank_index_is_exact(lengths, error):
    offsets = np.cumsum([0, *lengths])
    index = fillmiddle.RankIndex(offsets, error)
    assert index.offsets(range(len(offsets))) == offsets.tolist()
    assert abs(index.residuals.astype(int)).max() <= error + 1


def test_rank_index_of_even_lines_is_one_segment():
    assert len(fillmiddle.RankIndex(np.arange(0, 80 * 5000, 80)).starts) == 1


def brute_arrange(i, text, rate=100):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate", [100, 40])
def test_fill_in_middle(spark, docs_of, rate):
    rng = random.Random(6)
    parts = ["a", "é", "\U0001f600", "\n", "\n\n", "\r\n", "\x00", "<", "<P", "S>", "some words", " ", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "has <M> inside\nx"), (403, "no newline"), (404, "\n"), (None, "a\nb\nc\n"), (7, "twice\nhere"), (7, "twice\nhere"), (405, "a line of a long text\n" * 200_000 + "end")]
    from pyspark.sql import functions as F
    done = fillmiddle.fill_in_middle(docs_of(rows), rate=rate)
    got = done.withColumn("back", fillmiddle.restored(F.col("form"), F.col("output"))).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i, *brute_arrange(i, t or "", rate), t or "") for i, t in rows)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}
    assert fillmiddle.fill_in_middle(docs_of([])).count() == 0
