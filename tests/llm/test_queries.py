"""The registered queries, on the smallest tables, against plain Python."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.test_search_operators import plain_components, plain_fingerprint
from tests.llm.test_text_operators import W, plain_spans, plain_targets
from tidemark.llm import pii, queries, quality_model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "", r.source) for r in queries.table(spark, SF, "documents").collect()]


def test_spans(spark, docs):
    got = {r.doc_id: r for r in queries.op2_pii_spans(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        spans = sorted(plain_spans(text), key=lambda s: (s[1], pii.BASE.index(s[0])))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and {x for x in joined.split(",") if x} <= set(got[i].spans.split(","))


def test_groups(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash_groups(spark, SF).collect()}
    fps = [plain_fingerprint(t) for _, t, _ in docs]
    groups = plain_components([i for i, *_ in docs], fps)
    assert got == {i: (f"{fps[n]:016x}", groups[n]) for n, (i, *_) in enumerate(docs)}


def test_mix(spark, docs):
    rows = queries.op9_source_mix(spark, SF).collect()
    size = {i: len(W.findall(t)) for i, t, _ in docs}
    names = sorted({s for *_, s in docs}, key=lambda s: (s is None, (s or "").encode()))
    sums = [sum(size[i] for i, _, s in docs if s == n) for n in names]
    want = dict(zip(names, plain_targets(sums, [(1, 2, 3)[n % 3] for n in range(len(names))]), strict=True))
    source = {i: s for i, _, s in docs}
    assert len(rows) == len(docs) and all(r["size"] == size[r.doc_id] and abs(r.target - want[source[r.doc_id]]) < 1e-6 * (1 + r.target) and r.taken <= 3 * r["size"] for r in rows)


def test_verdicts(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = {r.page_id: r.url for r in queries.table(spark, SF, "pages").collect()}
    for r in queries.op6_url_verdicts(spark, SF).collect():
        m = re.match(r".*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[0]) and (not best or r.verdict == best[1])


def test_scores_equal_an_independent_discriminant(spark, docs):
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    x = {i: np.array(quality_model.statistics(t)) for i, t, _ in docs}
    known = [i for i in x if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    by = [np.array([x[i] for i in known if labels[i] == k]) for k in (0, 1)]
    scatter = [(m - m.mean(0)).T @ (m - m.mean(0)) for m in by]
    pooled = sum(scatter) / (len(known) - 2)
    spread = np.diag(pooled) + 1e-6
    pooled = (1 - quality_model.TO_DIAGONAL) * pooled + quality_model.TO_DIAGONAL * np.diag(spread)

    def density(k, v):
        a = max(quality_model.TO_POOLED, len(v) / (len(v) + len(by[k])))
        cov = (1 - a) * scatter[k] / (len(by[k]) - 1) + a * pooled + 1e-6 * np.diag(spread)
        gap = v - by[k].mean(0)
        return np.log(len(by[k]) / len(known)) - 0.5 * (np.linalg.slogdet(cov)[1] + gap @ np.linalg.solve(cov, gap))

    for r in queries.op7_quality_scores(spark, SF).collect():
        z = (density(1, x[r.doc_id]) - density(0, x[r.doc_id])) / quality_model.TEMPERATURE
        want = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_archives_equal_their_sql(spark, tmp_path):
    payloads = ["a", "b", "a", None, "", "ä" * 5000, "b", "a", "x\r\n\r\ny", "ä" * 5000, "WARC/1.0\r\n"]
    rows = [(n, f"http://h/{n}", p) for n, p in enumerate(payloads)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op10_archive_round_trip(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op10_archive_round_trip"])
    assert [d[0] for d in want.description] == got.columns
    assert sorted(want.fetchall()) == sorted(map(tuple, got.collect()), key=lambda r: r[0]) and sum(r.record_type == "revisit" for r in got.collect()) == 5
