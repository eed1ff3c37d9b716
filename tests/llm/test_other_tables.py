"""Embeddings, archives, components and the pipeline."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest

from quotecurve.llm import hnsw, warc
from quotecurve.llm.common import components


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 200), (None, 3), (101, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: r for n, r in got.items() if n != r} == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}}


@pytest.mark.parametrize("shard", [4096, 60])
def test_embeddings_against_brute_force(spark, shard):
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(12, 16))
    for k in range(300):
        v = centres[k % 12] + rng.normal(size=16) * (0.15 if k % 3 else 1.0)
        rows.append((k, v.tolist(), k % 2 if k % 29 else None))
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, [1.0] * 3, 0), (305, [], 0)]
    rows += [(1, rows[1][1], 1), (None, rows[1][1], 1), (306, [float("inf")] * 16, 1), (307, [x * 1e200 for x in rows[1][1]], 1)]
    data = [(*r, 5, "x") for r in rows]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, row long, id string")
    unit = []
    for _, v, label in rows:
        fine = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        x = np.array(v) / np.abs(v).max() if fine else None
        unit.append(x / np.linalg.norm(x) if fine else None)
    links = [[] for _ in rows]
    for i, x in enumerate(unit):
        for j, y in enumerate(unit):
            if i != j and x is not None and y is not None and len(x) == len(y) and rows[i][2] == rows[j][2] and x @ y >= 0.93:
                links[i].append(j)
    want = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    got = [tuple(r) for r in hnsw.near_duplicates(frame, shard=shard).collect()]
    found = sum(r[1] for r in got) / sum(r[1] for r in want)
    assert found >= 0.9
    if found == 1:
        assert sorted(got, key=str) == sorted(want, key=str)
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [4096, 8])
def test_equal_vectors_are_one_node(spark, shard):
    """Copies count as vectors of their own; a label of its own keeps them apart."""
    rng = np.random.default_rng(4)
    far, near = rng.normal(size=8), rng.normal(size=8)
    rows = [(k, far.tolist(), "a") for k in range(50)] + [(50 + k, near.tolist(), "a") for k in range(40)]
    rows += [(90, (near * 2).tolist(), "a"), (91, far.tolist(), "b"), (92, far.tolist(), None), (93, (near + 1e-3).tolist(), "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r["id"]: tuple(r)[1:3] for r in hnsw.near_duplicates(frame, shard=shard).collect()}
    assert all(got[k] == (49, 0) for k in range(50))
    assert all(got[k] == (41, 50) for k in [*range(50, 91), 93])
    assert got[91] == (0, 91) and got[92] == (0, 92)


def test_graph_finds_links_by_beams_and_by_whole_shards():
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(150, 16)).repeat(12, axis=0) + rng.normal(size=(1800, 16)) * 0.12
    vectors = np.concatenate([vectors, rng.normal(size=16) + rng.normal(size=(400, 16)) * 0.02])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = hnsw.Graph(unit)
    assert graph.audited_beam(0.93, unit) * hnsw._WIDE < len(unit)
    row, node = graph.within(unit, 0.93, hnsw.BEAM)
    row, node = np.divmod(np.unique(row * len(unit) + node), len(unit))
    real = hnsw._cosines(unit, row, node) >= 0.93
    truth = unit @ unit.T >= 0.93
    assert truth[row[real], node[real]].all() and real.sum() >= 0.99 * truth.sum()
    assert truth[-400:, -400:].sum() == ((row >= 1800) & (node >= 1800) & real).sum()
    assert np.allclose(hnsw._cosines(unit, row[:9], node[:9]), (unit[row[:9]] * unit[node[:9]]).sum(axis=1))


def test_large_groups_are_found_whole(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=32)
    rows = [(k, (centre + rng.normal(size=32) * 0.05).tolist(), 1) for k in range(400)]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 399 and r["component_id"] == 0 for r in got)


def test_zip64_directory():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k in range(66_000):
            z.writestr(f"f{k}", str(k))
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as member:
            member.write(b"wide member")
        z.writestr("packed", "x" * 500, compress_type=zipfile.ZIP_DEFLATED)
    raw = data.getvalue()
    found = warc.members(lambda at, n: raw[at : at + n], len(raw))
    assert len(found) == 66_001 and "packed" not in found
    for name, text in (("f65999", b"65999"), ("wide", b"wide member")):
        header, size = found[name]
        start = warc.member_start(lambda at, n: raw[at : at + n], header)
        assert raw[start : start + size] == text


def test_archives_give_back_the_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rng = random.Random(1)
    body = ["".join(rng.choice("abé<>\r\n ") for _ in range(n)) for n in (0, 99, 120, 400, 50_000)]
    rows = [(k, f"http://h/{k}?q=%20 é\n", body[k % 5]) for k in range(40)]
    rows += [(50, None, None), (None, "u", body[3]), (None, "u", "short"), (3, rows[3][1], body[3])]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    archives = warc.write_archives(pages)
    assert archives.count() > 1
    got = [tuple(r) for r in warc.read_archives(archives).collect()]
    least = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            least[html] = min(page, least.get(html, page))
    want = []
    for page, url, html in rows:
        data = (html or "").encode()
        first = least.get(html)
        again = first is not None and page != first
        kind = "revisit" if again else "response"
        want.append((page, url, kind, None if again else data, len(data), hashlib.sha256(data).hexdigest(), first if again else None))
    assert sorted([(*r[:3], r[3] and bytes(r[3]), *r[4:]) for r in got], key=str) == sorted(
        [(*r[:3], r[3] and bytes(r[3]), *r[4:]) for r in want], key=str
    )
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_pipeline_stages_on_messy_rows(spark, messy, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = messy
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == messy.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.count() > 0


def test_pipeline_on_given_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 0
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
