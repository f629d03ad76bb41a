import hashlib
import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard

from tidewatch.llm import ann, warc
from tidewatch.llm import queries as Q


def warc_rows(rows):
    first = {}
    for i, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        low = first.get(html or "")
        revisit = len(raw) >= 100 and i is not None and low < i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", low if revisit else None))
    return out


def test_warc_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    rows += [(1000, None), (1001, ""), (1002, "é" * 60), (1003, "é" * 60), (1004, "y" * 99), (1005, "y" * 99), (1006, "z" * 3_000_000), (1007, "z" * 3_000_000), (1007, "z" * 3_000_000), (None, "q" * 200), (None, "\r\n\r\n" * 50), (1008, "q" * 200)]
    df = spark.createDataFrame([(i, "http://a/\nb" if i and i % 2 else None, h, "payload") for i, h in rows], "page_id long, url string, html string, payload string")
    bundles = warc.write_bundles(df, frame_bytes=1 << 14, bundle_bytes=1 << 16).cache()
    out = warc.read_bundles(bundles)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted([tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=key) == sorted(warc_rows(rows), key=key)
    by_id = {r.page_id: r for r in out.collect()}
    assert bytes(by_id[1002].payload) == ("é" * 60).encode() and bytes(by_id[1003].payload) == b""
    assert [r.page_id for r in warc.lookup(bundles, page_ids=[1004]).collect()] == [1004]
    assert len({r.record_id for r in out.collect()}) == len(rows) and [r.page_id for r in warc.lookup(bundles, [by_id[1002].record_id]).collect()] == [1002]
    content = bundles.first().content  # any Zstandard reader can unpack a bundle
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(content)), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC-Date: ") >= 1 and f"WARC-Refers-To: <{by_id[1002].record_id}>".encode() in b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(b.content)), read_across_frames=True).read() for b in bundles.collect())
    assert warc.read_bundles(warc.write_bundles(df.where("false"))).count() == 0


def brute_nearest(rows, every=50, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in good:
        if i % every == 0:
            s = np.round(unit @ (v / np.linalg.norm(v)), 12)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_nearest_recall_and_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in Q.op5_additive_quantisation(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.9
    for own in got.values():
        assert own == sorted(own, key=lambda p: (-p[1], p[0]))


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.standard_normal(8)]) for i in range(60)]
    rows += [(i, [1.0] * 8) for i in range(100, 160)] + [(50, None), (200, [0.0] * 8), (250, [float("nan")] * 8), (300, [1.0, None] + [0.0] * 6), (None, [2.0] * 8), (350, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows)
    assert got.keys() == want.keys() == {0, 50, 100, 150}
    assert got[100] == [101, 102, 103, 104, 105] and got[150] == [100, 101, 102, 103, 104]
    assert ann.nearest(df.where("false")).count() == 0 and ann.nearest(df.where("vec_id = 100")).count() == 0


def recall(spark, ids, x, every, path):
    """Recall at 5 of nearest over unit vectors against brute force."""
    pq.write_table(pa.table({"vec_id": pa.array(ids), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}), path, row_group_size=len(x) // 8)
    got = {}
    for r in ann.nearest(spark.read.parquet(path), every=every).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, total, wide = 0, 0, x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    for i in np.flatnonzero(ids % every == 0):
        s = wide @ wide[i]
        s[i] = -2
        hits += len(got.get(int(ids[i]), set()) & {int(ids[j]) for j in np.argsort(-s)[:5]})
        total += 5
    return hits / total


def test_nearest_recall_does_not_fall_with_the_table(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    given = recall(spark, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32), 50, str(tmp_path / "given.parquet"))
    x = np.random.default_rng(4).standard_normal((100_000, 64)).astype(np.float32)
    made = recall(spark, np.arange(len(x)), x, 1000, str(tmp_path / "made.parquet"))
    print(f"recall at 5: sf0.1 {given:.4f}, 100,000 vectors {made:.4f}")
    assert given >= 0.999 and made >= 0.999


def test_vectors_of_each_length_are_searched_among_themselves(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8 if i % 3 else 5).tolist()) for i in range(120)] + [(50, rng.standard_normal(8).tolist())]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, books=4, words=8, sample=64)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (0, 100):
        v = dict(rows)[q]
        own = [(i, np.array(x)) for i, x in rows if len(x) == len(v) and i != q]
        cosine = {i: float(x @ np.array(v) / np.linalg.norm(x) / np.linalg.norm(v)) for i, x in own if i != 50}
        assert [i for i in got[q] if i != 50] == [i for i in sorted(cosine, key=lambda i: (-cosine[i], i)) if i in got[q]] and len(got[q]) == 5
    assert len(got[50]) == 5  # a repeated id is answered once
