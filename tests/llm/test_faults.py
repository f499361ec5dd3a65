"""Calibrated mixing against numpy, foreign WARC records, odd secrets and numbers, clashing names."""
import base64
import collections
import hashlib
import io
import math

import numpy as np
import pytest
import xxhash

from gridpulse.llm import mixing, pseudonyms, simhash, warc
from gridpulse.llm.common import file_system, run_folder

SMALL = "/root/testdata/sf0.01"


def softmax(e, theta):
    z = np.concatenate([np.zeros((len(e), 1)), theta[0] * e + np.array(theta[1:])], 1)
    w = np.exp(z - z.max(1, keepdims=True))
    return w / w.sum(1, keepdims=True)


def brute_evidence(features, k_of, fitted, scored, k):
    """Naive Bayes of ``fitted`` rows, evidence of ``scored`` rows, by the rule that the module states."""
    sizes = [sum(k_of[i] == j for i in fitted) for j in range(k)]
    n, odds = len(fitted), {}
    counts = [collections.Counter(f for i in fitted if k_of[i] == j for f in features[i]) for j in range(k)]
    for f in set().union(*counts):
        rate, chance = sum(c[f] for c in counts) / n, []
        for j in range(k):
            deviation = abs(counts[j][f] - sizes[j] * rate) / math.sqrt(sizes[j] * rate * (1 - rate) * (1 - sizes[j] / n) + 0.25)
            chance.append((counts[j][f] + 10 * rate) / (sizes[j] + 10) if deviation > 4 else rate)
        odds[f] = [round(math.log(c / chance[0]), 5) for c in chance[1:]]
    zero = [0.0] * (k - 1)
    return np.array([[sum(odds.get(f, zero)[j] for f in features[i]) * min(1, 400 / max(1, len(features[i]))) for j in range(k - 1)] for i in scored])


@pytest.fixture(scope="module")
def small(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rates = mixing.mix(docs, labels, run_folder(spark, "test")).collect()
    return docs.collect(), labels.collect(), rates


def test_posteriors_by_brute_force(spark, small):
    docs, labels, rates = small
    feature = lambda w: (xxhash.xxh64_intdigest(w.encode(), seed=42) - ((xxhash.xxh64_intdigest(w.encode(), seed=42) >> 63) << 64)) % mixing.FEATURES
    split = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t.lower()) if w]
    features = {d.doc_id: {feature(w) for w in split(d.text or "")} for d in docs}
    k_of = {r.doc_id: 0 if r.quality == 1 and not r.toxic else 1 if r.toxic else 2 for r in labels if r.doc_id in features}
    # the calibration: zero gradient on held-out evidence, halves as the module deals them
    from pyspark.sql import functions as F
    half = dict(map(tuple, spark.createDataFrame([(i,) for i in k_of], "doc_id long").select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")).collect()))
    sides = [[i for i in k_of if half[i] == h] for h in (0, 1)]
    e = np.concatenate([brute_evidence(features, k_of, sides[1 - h], sides[h], 3) for h in (0, 1)])
    y = np.eye(3)[[k_of[i] for h in (0, 1) for i in sides[h]]]
    model = mixing.fit_classifier(*(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels")), run_folder(spark, "test"))
    theta, p = model[0], softmax(e, model[0])
    sizes = [list(k_of.values()).count(j) + 1 for j in range(3)]
    start = [1.0, *(math.log(s / sizes[0]) for s in sizes[1:])]
    gradient = [((y - p)[:, 1:] * e).sum(), *(y - p).sum(0)[1:]]
    assert [g - (t - s) for g, t, s in zip(gradient, theta, start)] == pytest.approx([0, 0, 0], abs=0.05)
    want = softmax(brute_evidence(features, k_of, list(k_of), [r["doc_id"] for r in rates], 3), theta)
    assert np.abs(want - np.array([r["posteriors"] for r in rates])).max() < 1e-3


def test_small_mixture_is_no_corner(small):
    _, labels, rates = small
    a = np.array([[r["n_tokens"] * p for p in r["posteriors"]] for r in rates]).T
    w, totals = np.array(list(mixing.WEIGHTS.values())), a.sum(1)
    target, metric = min(totals / w) * w, np.linalg.inv(a @ a.T)
    value = lambda r: (a @ r - target) @ metric @ (a @ r - target)
    best = last = np.ones(len(rates))
    inertia = 1.0
    for _ in range(5000):
        further = (1 + (1 + 4 * inertia ** 2) ** 0.5) / 2
        y = best + (inertia - 1) / further * (best - last)
        new = np.clip(y - a.T @ (metric @ (a @ y - target)), 0, mixing.MAX_RATE)
        last, best, inertia = best, new, further if value(new) <= value(best) else 1.0
    got = np.array([r["rate"] for r in rates])
    assert got.min() >= 0 and got.max() <= mixing.MAX_RATE and value(got) <= 1.01 * value(best) + 1e-9
    assert rates[0]["residual"] == pytest.approx((a @ got - target).tolist(), abs=1e-3 * target.max())
    domain = {r.doc_id: "toxic" if r.toxic else "plain" if r.quality else "junk" for r in labels}
    means = collections.defaultdict(list)
    for r in rates:
        means[domain.get(r["doc_id"])].append(r["rate"])
    assert all(np.mean(x) > 0 for x in means.values()) and np.mean(means["plain"]) > 0.6 > np.mean(means["toxic"])


def record(kind, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>", "WARC-Date": warc.DATE, "Content-Length": len(block)} | {k.replace("_", "-"): v for k, v in more.items()}
    return warc.gzip_member("\r\n".join(["WARC/1.0", *(f"{k}: {v}" for k, v in head.items()), "", ""]).encode() + block + b"\r\n\r\n")


def test_foreign_records(spark, folder):
    body, sha1 = b"<p>body</p>", lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    plain = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    http = dict(Content_Type="application/http; msgtype=response", WARC_Target_URI="http://a/")
    archive = b"".join([record("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
                        record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
                        record("response", plain, WARC_Payload_Digest=f"sha1:{sha1(body)}", WARC_Block_Digest=f"SHA1:{sha1(plain)}", **http),
                        record("response", plain, WARC_Payload_Digest=f"sha256:{hashlib.sha256(body).hexdigest()}", **http),
                        record("response", plain, WARC_Payload_Digest="blake9:00", **http),
                        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:1>", **http)])
    got = list(warc.read_records(io.BytesIO(archive)))
    assert [r["warc-type"] for r in got] == ["warcinfo", "request", "response", "response", "response", "revisit"]
    assert [r["payload"] for r in got[2:5]] == [body] * 3 and got[5]["payload_bytes"] is None
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/x.warc.gz", compression=None) as out:
        out.write(archive)
    manifest = spark.createDataFrame([(0, "x.warc.gz")], "shard long, file string")
    rows = warc.read_archives(manifest, folder).collect()
    assert [(r["page_id"], r["record_type"], r["payload_bytes"]) for r in rows] == [(None, "response", len(body))] * 3 + [(None, "revisit", None)]
    whole = record("response", plain, WARC_Payload_Digest=f"sha1:{sha1(body + b'x')}", **http)
    for bad in (whole, record("response", plain, WARC_Block_Digest=f"sha1:{sha1(b'')}", **http), warc.gzip_member(b"WARC/1.0\r\nWARC-Type: resp"),
                warc.gzip_member(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 90\r\n\r\nshort"), b"no gzip at all", record("response", plain)[:-3],
                warc.gzip_member(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n\r\n\r\n")):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_records(io.BytesIO(bad)))


def test_letters_only_secrets_are_replaced_everywhere():
    key, secret = pseudonyms.TEST_KEY, "ghp_" + "AbCdEfGhIjKl" * 3
    alone, beside = (pseudonyms.pseudonymise(t, key) for t in (f"token {secret} here", f"token {secret} here 7"))
    assert [s[0] for s in alone[1]] == ["secret"] and alone[1][0][3] == beside[1][0][3] and secret not in alone[0]


def test_numbers_are_validated_and_linked():
    key = pseudonyms.TEST_KEY
    made = lambda text: pseudonyms.pseudonymise(text, key)
    for wrong in ("000-00-0000", "666-12-3456", "987-65-4321", "123-00-4567", "123-45-0000"):
        assert made(f"no {wrong}.")[0] == f"no {wrong}."
    for right in ("001-01-0001", "665-99-9999", "667-01-0001", "899-99-9999", "123-45-6789"):
        (kind, *_, new), = made(f"ssn {right}.")[1]
        area, group, serial = map(int, new.split("-"))
        assert kind == "ssn" and 1 <= area <= 899 and area != 666 and group and serial
        assert pseudonyms.pseudonymise(f"ssn {new}.", key, back=True)[0] == f"ssn {right}."
    phones = {"".join(c for c in made(f"call {p} now")[1][0][3] if c.isdigit())[-10:] for p in ("+1 864 555 0138", "864-555-0138", "+18645550138", "+1 (864) 555-0138")}
    assert len(phones) == 1 and phones != {"8645550138"}
    assert made("version 1.2.3.4 and v1.2.3.4")[1] == [] and made("at 1.2.3.4 now")[1][0][0] == "ip"
    new = made("john@smithfamily.org, ann@smithfamily.org")[0]
    hosts = {x.rstrip(",").split("@")[1] for x in new.split()}
    assert "smithfamily" not in new and len(hosts) == 1 and hosts.pop().endswith(".org")


def test_one_of_each_keeps_clashing_columns(spark, folder):
    rows = [(i, f"some words of document {i} that differ " + "abcdefgh"[i] * 30, "keep", "x", "y", "z") for i in range(5)] + [(9, "same text", "keep", "x", "y", "z")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, __i string, __h string, i_ string, h_ string")
    got = simhash.one_of_each(df, folder).collect()
    assert {tuple(r)[2:] for r in got} == {("keep", "x", "y", "z")} and sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4, 9]
