"""Archives, mixing, vectors, the pipeline."""

import base64
import hashlib
import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import embedding_dedup, mixing, warc


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}\r\n\r\nWARC/1.1 é</p>", 1) for i in range(40)] + [(100, None, None, 1), (101, "http://h/a b", "", 1), (None, "u", "only", 1)]
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, sha int")).collect()}
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    for i, _, h, _ in rows:
        b = (h or "").encode()
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        again = i is not None and last[h or ""] != i
        assert (r.record_type, r.refers_to) == (("revisit", last[h or ""]) if again else ("response", None))
    assert warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string, sha int").limit(0)).count() == 0
    small = warc.round_trip(spark.createDataFrame(rows[:14], "page_id long, url string, html string, sha int"), least=10**6)
    assert {r.record_type for r in small.collect()} == {"response"}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = warc.arc_version_block(version, "x.arc", "20010203040506") + warc.arc_record(version, "http://a/b c", "20010203040506", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npay\nload\n") + warc.arc_record(version, "dns:x", "20010203", b"1.2.3.4\n", mime="text/dns")
    block, page, dns = warc.parse_arc(data)
    assert block[0]["version"] == str(version) and page[0]["url"] == "http://a/b%20c"
    (head, body), = warc.parse_warc(warc.convert(*page) + warc.END)
    assert head["warc-type"] == "response" and head["warc-date"] == "2001-02-03T04:05:06Z" and body.endswith(b"pay\nload\n")
    assert head["warc-payload-digest"] == "sha1:" + warc.sha1_32(b"pay\nload\n")
    assert next(iter(warc.parse_warc(warc.convert(*dns) + warc.END)))[0]["warc-type"] == "resource"
    assert next(iter(warc.parse_warc(warc.convert(*block) + warc.END)))[0]["warc-type"] == "warcinfo"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-3]))


def test_arc_files_are_converted(spark, tmp_path):
    import gzip

    pages = [(f"http://h/{i}", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + bytes([i]) * i * 50) for i in range(20)]
    for version in (1, 2):
        parts = [warc.arc_version_block(version, f"{version}.arc", "2001")] + [warc.arc_record(version, u, "20020304", c) for u, c in pages]
        (tmp_path / f"{version}.arc").write_bytes(b"".join(parts))
        (tmp_path / f"{version}.arc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "other.txt").write_bytes(b"no archive")
    got = warc.convert_archives(spark, str(tmp_path)).collect()
    assert len(got) == 4 * 21 and sum(r.kind == "warcinfo" for r in got) == 4
    for r in got:
        ((head, block),) = warc.parse_warc(r.warc)
        if r.record:
            assert (r.url, block) == pages[r.record - 1] and head["warc-date"] == "2002-03-04T00:00:00Z" and head["warc-type"] == "response"


def test_warc_of_long_pages_and_line_ends(spark):
    texts = ["\r\n", "\r\n\r\n", "x\r\n\r\n\r\n", "WARC/1.1\r\n\r\n", "\r", "é" * 3_000_000, "a\r\n" * 200_000, ""]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].payload_bytes == len(t.encode()) and got[i].payload_digest == warc.sha1_32(t.encode()) and got[i].url == f"urn:page:{i}"


def test_mixing_is_never_a_block_away():
    rnd = random.Random(1)
    for _ in range(20):
        slots = {f"s{i}": rnd.randint(1, 40) for i in range(rnd.randint(1, 12))}
        order, q = mixing.period_of(slots), sum(slots.values())
        for s, w in slots.items():
            n = np.cumsum([x == s for x in order])
            assert (np.abs(n - np.arange(1, q + 1) * w / q) < 1).all() and n[-1] == w


def test_mixing_places_every_row_once(spark):
    rows = [(i, None if i % 50 == 0 else f"s{(i * i) % 7 % 4}", i) for i in range(3000)] + [(None, "s1", 0), (5, "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot int")
    got = mixing.mix(df, {"s0": 3, "s1": 1, "s2": 1, "s3": 1}).toPandas()
    assert len(got) == len(rows) and got.mix_position.is_unique
    slots = got.groupby("mix_slot").source.nunique(dropna=False)
    assert (slots == 1).all() and sorted(slots.index) == list(range(len(slots)))
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_keeps_columns_of_any_name_and_splits_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "RUN", 4)
    names = ["s", "h", "g", "b", "r", "row", "no", "slots", "before", "name", "_s", "_h"]
    rows = [(None if i % 3 == 0 else 7, "abc"[i % 2], *([i] * len(names)), {"k": i}) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, " + ", ".join(f"{n} int" for n in names) + ", m map<string,int>")
    got = mixing.mix(df)
    assert got.columns == [*df.columns, "mix_block", "mix_slot", "mix_position"]
    out = got.collect()
    assert sorted(r["_s"] for r in out) == list(range(700)) and all(r[n] == r["_s"] for r in out for n in names) and all(r.m["k"] == r["_s"] for r in out)
    assert len({r.mix_position for r in out}) == 700


def test_mixing_bounds_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(1000)], "doc_id long, source string")
    got = mixing.mix(df).toPandas()
    assert got.mix_position.is_unique and got.mix_slot.nunique() <= 12 and (got.groupby("mix_slot").source.nunique() == 1).all()


def test_mixing_places_against_arithmetic(spark):
    """Places of all rows from the definition: ranks by hash within a source, the earliest due released block per slot."""
    rows = [(i, f"s{i % 7 % 3}") for i in range(1500)]
    weights = {"s0": 5.0, "s1": 2.0, "s2": 0.5}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=4).orderBy("mix_position").collect()
    blocks = {s: -(-sum(x == s for _, x in rows) // 4) for s in weights}

    def ideal(v):  # slots used when each source has had v times its weight, or all it has
        return sum(min(Fraction(weights[s]) * v, blocks[s]) for s in weights)

    done, order = dict.fromkeys(weights, 0), []
    for slot in range(sum(blocks.values())):
        due = {}
        for s, k in done.items():
            if k < blocks[s] and ideal(k / Fraction(weights[s])) < slot + 1:
                due[s] = (-(-ideal((k + 1) / Fraction(weights[s])) // 1), -weights[s], s)
        s = min(due, key=due.get)
        done[s] += 1
        order.append(s)
    assert [x for x, _ in itertools.groupby((r.mix_slot, r.source) for r in got)] == list(enumerate(order))
    for s in weights:
        assert [k for _, k in sorted({(r.mix_slot, r.mix_block) for r in got if r.source == s})] == list(range(blocks[s]))


def test_mixing_pools_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    df = spark.createDataFrame([(i, f"s{i % 5}") for i in range(200)], "doc_id long, source string")
    got = mixing.mix(df).toPandas()
    assert len(got) == 200 and got.mix_position.is_unique


@pytest.mark.parametrize("weights", [[1, 1, 1], [0.7, 0.2999, 0.0001], [n**0.5 for n in range(2, 40)]])
def test_mixing_keeps_the_exact_targets_over_long_runs(weights):
    blocks = [max(1, int(20_000 * w / sum(weights))) for w in weights]
    done, left, ideal = np.zeros(len(blocks)), np.array(blocks, dtype=float), np.zeros(len(blocks))
    for i, k in mixing.schedule(blocks, weights):
        assert k == done[i]
        done[i] += 1
        room = 1.0  # the ideal mixture: all that have rows left grow by their weights
        while room > 1e-9 and (left > 1e-9).any():
            own = np.where(left > 1e-9, weights, 0.0)
            step = min(room, (left[own > 0] / own[own > 0]).min() * own.sum())
            grown = own / own.sum() * step
            ideal, left, room = ideal + grown, left - grown, room - step
        assert (np.abs(done - ideal) < 1 + 1e-6).all()
    assert done.tolist() == blocks


@pytest.mark.parametrize("most", [3, 1000])
def test_mixing_weighs_each_of_many_sources(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MOST_SOURCES", most)
    df = spark.createDataFrame([(s * 1000 + k, f"s{s:03}") for s in range(250) for k in range(3)] + [(10**6 + k, "big") for k in range(400)], "doc_id long, source string")
    weights = {f"s{s:03}": s + 1.0 for s in range(250)} | {"big": 5000.0}
    got = mixing.mix(df, weights, block_rows=1).orderBy("mix_position").toPandas()
    assert got.mix_position.tolist() == list(range(len(df.collect())))
    # The schedule is kept per source: rows 0, 1, 2 of each stand where its own weight puts them.
    names = sorted(["big", *(f"s{s:03}" for s in range(250))])
    want = [names[i] for i, _ in mixing.schedule([400 if s == "big" else 3 for s in names], [weights[s] for s in names])]
    assert got.source.tolist() == want
    first = got.groupby("source").mix_position.max()
    assert first["s249"] < first["s100"] < first["s010"]


def vectors(rnd, n, dim=64):
    base = rnd.standard_normal((n // 8, dim))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + rnd.standard_normal(dim) * (0.25 if i % 3 else 0.0)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    return rows


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ONE_CELL", 50)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rows = vectors(np.random.default_rng(5), 800)
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, rows[0][1], None), (904, [1.0, 2.0], 0), (905, [1.0, 2.0], 0), (906, [1.0, None], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links = found = 0
    for label in (0, 1):
        own = [r for r in rows if r[2] == label and r[1] and len(r[1]) == 64 and np.isfinite(r[1]).all() and any(r[1])]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.93
        np.fill_diagonal(near, False)
        n = near.sum(axis=1)
        have = np.array([got[r[0]].n_links for r in own])
        assert (have <= n).all()
        links, found = links + n.sum(), found + have.sum()
    assert links > 500 and found / links >= 0.9
    for i in (900, 901, 902, 903, 906):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[905].n_links, got[905].component_id, got[905].kept) == (1, 904, False)
    assert len(got) == len(rows)


def test_vectors_of_repeated_ids_clashing_columns_and_none(spark):
    names = ["id", "v", "key", "group", "weight", "component", "cells"]
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (None, [1.0, 0.0], 0), (3, [], 0), (4, [0.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, *(["x"] * len(names))) for r in rows], "vec_id long, embedding array<double>, label int, " + ", ".join(f"{n} string" for n in names))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (None, 3, None)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rnd = np.random.default_rng(3)
    turn = embedding_dedup.rotation(64)
    x, q, p = (embedding_dedup.unit(rnd.standard_normal((n, 64))) for n in (3000, 50, 1))
    code, factor, length = embedding_dedup.encode(x - p[0], turn)
    about, width = embedding_dedup.estimate(q, p[0], code, factor, length, (x - p[0]) @ p[0], turn)
    error = about - q @ x.T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= width).mean() > 0.999


def test_pipeline(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    out = c.run(spark, d)
    assert set(out.columns) == {"doc_id", "ids", "n_tokens"} and 0 < out.count() <= spark.read.parquet(f"{d}/documents.parquet").count()
